"""Exact token counts at every prefix of a text, by prefix dynamic programming over a byte-pair vocabulary."""

from __future__ import annotations

import functools
import json
import unicodedata
from itertools import accumulate

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamis.llm.common import chunks, flat_texts, in_task, word_hashes

#: Characters whose lower case, composition and letter class are the same in Python and in the library. Fixed values.
_PLAIN = regex.compile(r"[\x00-ɏΑ-Ρα-ωА-я‐-‧‰-⁞₠-₿]*+")
#: The vocabulary's own split pattern, with white space spelled out. Fixed values.
_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\t-\r \x85\xa0  -     　\p{L}\p{N}]+")
#: Pieces and token pairs that a task remembers.
_CACHE_PIECES, _CACHE_PAIRS = 500_000, 500_000
END = "</w>"


class PrefixCounter:
    """Token counts of texts under one vocabulary file (BPE with word ends).

    Within a piece, `inner[i]` is the last token of the encoding of the first i symbols when more follow; it is the
    only vocabulary entry that ends there and may follow the last token of what stands before it. `ended[i]` is the
    count when the piece stops at i, where the last symbol carries the word end. Both follow from shorter prefixes.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.vocab = spec["model"]["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.rank = {m: i for i, m in enumerate(merges)}
        self.token = {n: t for t, n in self.vocab.items()}
        self.longest = max(map(len, self.vocab))
        specials = [t["content"] for t in spec.get("added_tokens", [])]
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(specials, key=len, reverse=True))) + ")") if specials else None
        self.symbol = _byte_symbols()
        self.pieces: dict[str, int] = {}
        self.follows: dict[int, bool] = {}
        self.totals: dict[int, int] = {}

    def _encode(self, symbols: list[str]) -> list[str]:
        symbols = list(symbols)
        while len(symbols) > 1:
            best = min(range(len(symbols) - 1), key=lambda i: self.rank.get((symbols[i], symbols[i + 1]), 1 << 60))
            if (symbols[best], symbols[best + 1]) not in self.rank:
                break
            symbols[best : best + 2] = [symbols[best] + symbols[best + 1]]
        return symbols

    @staticmethod
    def _symbols(token: str) -> list[str]:
        return [*token[: -len(END) - 1], token[-len(END) - 1 :]] if token.endswith(END) and len(token) > len(END) else list(token)

    def _check(self, key: int) -> bool:
        """Whether the encoding of two tokens' text is those two tokens (no left one: the right by itself)."""
        left, right = self.token.get((key >> 20) - 1, ""), self.token[key & 0xFFFFF]
        if len(self.follows) >= _CACHE_PAIRS:
            self.follows.clear()
        ok = self._encode((self._symbols(left) if left else []) + self._symbols(right)) == ([left, right] if left else [right])
        self.follows[key] = ok
        return ok

    def _inner(self, text: str) -> tuple[list[int], list[int]]:
        """Last token (its id plus one) and count of the encoding of every proper prefix, where more follows."""
        last, count, number, follows, check, longest = [0], [0], self.vocab.get, self.follows.get, self._check, self.longest
        for i in range(1, len(text)):
            for j in range(i - longest if i > longest else 0, i):
                token = number(text[j:i])
                if token is not None:
                    key = last[j] << 20 | token
                    ok = follows(key)
                    if ok or (ok is None and check(key)):
                        last.append(token + 1)
                        count.append(count[j] + 1)
                        break
        return last, count

    def _ended(self, text: str, i: int, last: list[int], count: list[int]) -> int:
        """Count of the piece that stops after i symbols."""
        for j in range(max(0, i - self.longest), i):
            token = self.vocab.get(text[j:i] + END)
            if token is not None:
                key = last[j] << 20 | token
                ok = self.follows.get(key)
                if ok or (ok is None and self._check(key)):
                    return count[j] + 1
        raise ValueError(f"the vocabulary has no encoding of {text[:i]!r}")

    def piece_counts(self, piece: str) -> list[int]:
        """Counts of the piece's prefixes of 1, 2, ... bytes; the last is the whole piece's."""
        text = "".join(self.symbol[b] for b in piece.encode("utf-8"))
        last, count = self._inner(text)
        return [self._ended(text, i, last, count) for i in range(1, len(text) + 1)]

    def piece_total(self, piece: str) -> int:
        known = self.pieces.get(piece)
        if known is None:
            text = piece if piece.isascii() and piece.isalnum() else "".join(self.symbol[b] for b in piece.encode("utf-8"))
            known = self._ended(text, len(text), *self._inner(text))
            if len(self.pieces) >= _CACHE_PIECES:
                self.pieces.clear()
            if len(piece) <= 64:
                self.pieces[piece] = known
        return known

    def normalized_pieces(self, text: str) -> list[str | None]:
        """The pieces in order; None stands for a special string."""
        out: list[str | None] = []
        for part in self.special.split(text) if self.special and "<|" in text else [text]:
            if self.special and self.special.fullmatch(part):
                out.append(None)
            elif _PLAIN.fullmatch(part) and "Σ" not in part:
                out += _PIECES.findall(unicodedata.normalize("NFC", part).lower())
            elif part:
                raw = self.library.normalizer.normalize_str(part)
                out += [raw[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(raw)]
        return out

    def piece_ends(self, text: str) -> list[int]:
        """Cumulative token counts at the end of every piece."""
        known, count = self.pieces.get, self.piece_total
        return list(accumulate(1 if piece is None else known(piece) or count(piece) for piece in self.normalized_pieces(text)))

    def batch_ends(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cumulative counts at piece ends for many texts at once, text after text, and the texts' ranges in them."""
        simple = self._simple(data, offsets)
        starts, ends, folded = _simple_pieces(data, offsets)
        text = np.searchsorted(offsets, starts, side="right") - 1
        ok = simple[text]
        starts, ends, text = starts[ok], ends[ok], text[ok]
        hashes, first, back = np.unique(word_hashes(folded, starts, ends), return_index=True, return_inverse=True)
        known, counts, raw = self.totals, np.zeros(len(hashes), np.int64), folded.tobytes()
        for i, (h, at) in enumerate(zip(hashes.tolist(), first.tolist())):
            n = known.get(h)
            if n is None:
                if len(known) >= _CACHE_PIECES:
                    known.clear()
                n = known[h] = self.piece_total(raw[starts[at] : ends[at]].decode())
            counts[i] = n
        own = counts[back] if len(back) else np.zeros(0, np.int64)
        sizes = np.bincount(text, minlength=len(offsets) - 1)
        odd = {}
        for i in np.flatnonzero(~simple):
            odd[i] = np.array(self.piece_ends(data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace")), np.int64)
            sizes[i] = len(odd[i])
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        out = np.zeros(bounds[-1], np.int64)
        place = np.ones(bounds[-1], bool)
        for i, e in odd.items():
            place[bounds[i] : bounds[i + 1]] = False
        out[place] = own
        sums = np.concatenate([[0], np.cumsum(out)])
        out = sums[1:] - np.repeat(sums[bounds[:-1]], sizes)
        for i, e in odd.items():
            out[bounds[i] : bounds[i + 1]] = e
        return out, bounds

    @staticmethod
    def _simple(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Texts of ASCII and Latin-1 letters alone, without characters that the fast split does not read."""
        lead = np.zeros(len(data), bool)
        lead[1:] = data[:-1] == 0xC3
        bad = (data >= 0x80) & ~((data == 0xC3) | (lead & (data != 0x97) & (data != 0xB7)))
        bad |= (data < 0x20) & ~((data >= 9) & (data <= 13))
        bad |= data == 0x7C  # a special string has it
        sums = np.concatenate([[0], np.cumsum(bad)])
        return sums[offsets[1:]] == sums[offsets[:-1]]

    def fit(self, text: str, budget: int) -> tuple[int, int]:
        """(whole pieces, further bytes of the next piece) of the longest prefix of at most budget tokens."""
        total = 0
        pieces = self.normalized_pieces(text)
        for i, piece in enumerate(pieces):
            counts = [1] if piece is None else self.piece_counts(piece)
            if total + counts[-1] > budget:
                return i, max((k + 1 for k, c in enumerate(counts[:-1]) if total + c <= budget), default=0)
            total += counts[-1]
        return len(pieces), 0


def _byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = [""] * 256
    for b in plain:
        out[b] = chr(b)
    for n, b in enumerate(b for b in range(256) if b not in set(plain)):
        out[b] = chr(256 + n)
    return out


#: Byte classes of the fast split: 0 white space, 1 letter (also every byte of a Latin-1 letter), 2 digit, 3 other.
_CLASS = np.full(256, 3, np.uint8)
_CLASS[[0x20, *range(9, 14)]] = 0
_CLASS[[*range(65, 91), *range(97, 123), *range(0x80, 0x100)]] = 1
_CLASS[[*range(48, 58)]] = 2
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def _simple_pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the pieces of simple texts, and the bytes in lower case."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), data
    low = _FOLD[data]
    low[1:] += ((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)).astype(np.uint8) * np.uint8(0x20)
    kind = _CLASS[data]
    start = np.ones(n + 1, bool)
    start[1:n] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
    start[offsets] = True
    # an apostrophe that begins a piece takes the letters of a contraction with it
    at = np.flatnonzero((data == 39) & start[:n])
    after = np.full((len(at), 2), 0, np.uint8)
    end = offsets[np.searchsorted(offsets, at, side="right")]
    for k in (1, 2):
        inside = at + k < end
        after[inside, k - 1] = low[at[inside] + k]
    one = np.isin(after[:, 0], np.frombuffer(b"stmd", np.uint8))
    pairs = after[:, 0].astype(np.int64) << 8 | after[:, 1]
    two = ~one & np.isin(pairs, [ord(x) << 8 | ord(y) for x, y in ("re", "ve", "ll")])
    start[at[one] + 1] = start[at[two] + 1] = False
    start[at[one] + 2] |= (at[one] + 2 <= end[one])
    start[at[two] + 3] |= (at[two] + 3 <= end[two])
    edges = np.flatnonzero(start)
    starts, ends = edges[:-1], edges[1:]
    keep = kind[starts] != 0
    return starts[keep], ends[keep], low


@functools.cache
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def token_prefixes(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", with_prefixes: bool = True) -> DataFrame:
    """Per row: id, n_bytes (UTF-8), n_tokens and, with_prefixes, prefix_tokens, the count at the end of every piece.

    Null and empty texts have no bytes and no tokens; ids may be null or repeat, every row is counted by itself.
    Other columns are not carried. Special strings inside a text count as one token each, as the library has it;
    nothing is added, cut or padded. tokenizer_path must be readable on the executors.
    """
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])
    if with_prefixes:
        schema = schema.add("prefix_tokens", T.ArrayType(T.IntegerType()))

    def count(batches):
        import pyarrow as pa

        prefix = counter(tokenizer_path)
        for batch in batches:
            data, offsets = flat_texts(batch.column(2))
            for a, b in chunks(offsets):
                ends, bounds = prefix.batch_ends(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                last = np.where(bounds[1:] > bounds[:-1], ends[np.maximum(bounds[1:] - 1, 0)] if len(ends) else 0, 0)
                columns = [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(last, pa.int64())]
                if with_prefixes:
                    columns.append(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ends, pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    rows = docs.select(F.col(id_col), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), F.col(text_col).alias("_text"))
    return rows.mapInArrow(in_task(count), schema)


def tokens_within(prefixes: DataFrame, budget: int) -> DataFrame:
    """From stored prefix counts alone: over_limit, and pieces_within, the whole pieces that fit into the budget."""
    return prefixes.withColumn("over_limit", F.col("n_tokens") > budget).withColumn("pieces_within", F.size(F.filter("prefix_tokens", lambda n: n <= budget)))
