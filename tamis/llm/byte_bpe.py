"""Byte-level BPE by prefix dynamic programming: every byte prefix keeps its one valid last token.

A vocabulary of ranks has exactly one encoding of any bytes. Its last token is the one vocabulary entry that ends there
and that may follow the last token of what stands before it; two tokens may stand side by side where the encoding of their
joined bytes is those two. So one number a byte, `last`, holds the encodings of all prefixes: a text is read back from its
end, bytes put behind it continue the table, and after an edit only the bytes behind it within its piece are worked out anew.
"""

from __future__ import annotations

import base64
import functools
from bisect import bisect_right
from itertools import islice

import numpy as np
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamis.llm.common import SHORT, Loads, chunks, flat_texts, in_task, mix_pair

#: Pieces, longest piece and token pairs that a task remembers; a table beyond is emptied, which costs time alone.
_CACHE_PIECES, _CACHE_BYTES, _CACHE_PAIRS = 400_000, 64, 1_000_000
#: Pieces that are held at once while a text is encoded.
_STEP = 100_000
#: Characters behind its end that can change where a piece ends: the white space left to the next piece and what follows it, or both letters of a contraction.
_AHEAD = 2


class _Pieces(dict):
    """Packed ids (little-endian unsigned 32-bit) of each piece; unknown pieces are encoded when asked for."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, piece: str) -> bytes:
        raw = piece.encode("utf-8", "replace")
        ids = self.encode(raw)
        if len(raw) <= _CACHE_BYTES:
            if len(self) >= _CACHE_PIECES:
                self.clear()
            self[piece] = ids
        return ids


class BytePairs:
    """Encodings under one vocabulary of ranks and one pattern that splits texts into pieces."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.bytes = {n: t for t, n in ranks.items()}
        sizes = sorted({len(t) for t in ranks}, reverse=True)
        self.sizes = [[k for k in sizes if k <= n] for n in range(sizes[0] + 1)]
        self.edges: dict[tuple[int, int], list[tuple[bytes, int]] | None] = {}
        self.follows: dict[int, bool] = {}
        self.split = regex.compile(pattern)
        self.pieces = _Pieces(self._packed)

    @classmethod
    def read(cls, path: str, pattern: str) -> BytePairs:
        with open(path, "rb") as f:
            return cls({base64.b64decode(t): int(n) for t, n in map(bytes.split, f)}, pattern)

    def merged(self, raw: bytes, whole: bool = True) -> list[bytes]:
        """Encoding by the definition: join the neighbours of lowest rank, the leftmost first, while any can be joined.
        Not whole: stop when two parts are left."""
        parts = [raw[i : i + 1] for i in range(len(raw))]
        while len(parts) > (1 if whole else 2):
            rank, at = min((self.ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _edge(self, token: int, side: int) -> list[tuple[bytes, int]] | None:
        """The parts of a token that lie at its end (side 1) or start (0) while it is put together, and the rank at which
        each is joined into the next; None if the vocabulary joins a part earlier than that part is made."""
        raw, out, later = self.bytes[token], [], 1 << 60
        while True:
            out.append((raw, later))
            if len(raw) == 1:
                return out[::-1]
            own, parts = self.ranks[raw], self.merged(raw, whole=False)
            if len(parts) != 2 or max(self.ranks[x] for x in parts) > own:
                return None
            raw, later = parts[side], own

    def _check(self, key: int) -> bool:
        """Whether the right token may follow the left: no join across the border comes before the joins on either side."""
        left, right = key >> 32, key & 0xFFFFFFFF
        if len(self.follows) >= _CACHE_PAIRS:
            self.follows.clear()
        for token, side in ((left - 1, 1), (right, 0)) if left else ():
            if (token, side) not in self.edges:
                self.edges[token, side] = self._edge(token, side)
        a, b = (self.edges[left - 1, 1], self.edges[right, 0]) if left else (None, None)
        if not a or not b:
            own = [self.bytes[right]] if not left else [self.bytes[left - 1], self.bytes[right]]
            ok = self.merged(b"".join(own)) == own
        else:
            i = j = 0
            while True:
                (x, upper), (y, other) = a[i], b[j]
                rank = self.ranks.get(x + y)
                if rank is not None and rank < upper and rank <= other:
                    ok = False
                    break
                if upper == other == 1 << 60:
                    ok = True
                    break
                if upper <= other:
                    i += 1
                else:
                    j += 1
        self.follows[key] = ok
        return ok

    def extend(self, raw: bytes, last: list[int]) -> list[int]:
        """Carry last, the table of a prefix of raw, on to its end."""
        number, follows, check, sizes, longest = self.ranks.get, self.follows.get, self._check, self.sizes, len(self.sizes) - 1
        for i in range(len(last) + 1, len(raw) + 1):
            for size in sizes[i if i < longest else longest]:
                token = number(raw[i - size : i])
                if token is not None:
                    key = (last[i - size - 1] + 1) << 32 | token if size < i else token
                    ok = follows(key)
                    if ok or (ok is None and check(key)):
                        last.append(token)
                        break
            else:
                raise ValueError(f"the vocabulary has no token for the byte {raw[i - 1]}")
        return last

    def tokens(self, last: list[int] | np.ndarray, end: int) -> list[int]:
        """Encoding of a piece's first `end` bytes, read from its table backwards."""
        out = []
        while end:
            token = int(last[end - 1])
            out.append(token)
            end -= len(self.bytes[token])
        return out[::-1]

    def _packed(self, raw: bytes) -> bytes:
        token = self.ranks.get(raw)
        ids = [token] if token is not None else self.tokens(self.extend(raw, []), len(raw))
        return np.array(ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """Packed ids of a whole text."""
        found, ids = (m[0] for m in self.split.finditer(text)), self.pieces.__getitem__
        if len(text) <= _STEP:
            return b"".join(map(ids, self.split.findall(text)))
        out = []
        while part := b"".join(map(ids, islice(found, _STEP))):
            out.append(part)
        return b"".join(out)

    def table(self, text: str) -> Prefixes:
        return Prefixes(self, text)


class Prefixes:
    """The last token of every byte prefix of a text, piece by piece; appends and edits leave the table exact.

    `starts` are the pieces' first characters, `last` the table of each piece. `worked` counts the bytes whose entry has
    been worked out so far.
    """

    def __init__(self, pairs: BytePairs, text: str = ""):
        self.pairs, self.text, self.starts, self.last, self.worked = pairs, "", [], [], 0
        self.edit(0, 0, text)

    def append(self, more: str) -> None:
        self.edit(len(self.text), 0, more)

    def edit(self, at: int, removed: int, put: str) -> None:
        """Put a string in the place of `removed` characters from character `at` on.

        Pieces that end _AHEAD characters before the edit stay. From there on the text is split anew until a piece starts,
        behind the edit, where one started before; the rest is kept. A new piece that begins as the old one did keeps the
        entries of the bytes they share.
        """
        at, removed = min(max(at, 0), len(self.text)), max(removed, 0)
        text = self.text[:at] + put + self.text[at + removed :]
        ends = [*self.starts[1:], len(self.text)] if self.starts else []
        keep = bisect_right(ends, at - _AHEAD)
        begin, shift, behind = (self.starts[keep] if keep < len(self.starts) else ends[-1] if ends else 0), len(put) - removed, at + len(put)
        old = {s + shift: i for i, s in enumerate(self.starts) if s >= at + removed}
        starts, last, rest = self.starts[:keep], self.last[:keep], None
        for n, found in enumerate(self.pairs.split.finditer(text, begin)):
            if found.start() >= behind and found.start() in old:
                rest = old[found.start()]
                break
            raw, same = found[0].encode("utf-8", "replace"), []
            if keep + n < len(self.starts) and self.starts[keep + n] == found.start():
                same = self.last[keep + n][: len(self.text[found.start() : min(at, found.end())].encode("utf-8", "replace"))]
            self.worked += len(raw) - len(same)
            starts.append(found.start())
            last.append(self.pairs.extend(raw, list(same)))
        if rest is not None:
            starts += [s + shift for s in self.starts[rest:]]
            last += self.last[rest:]
        self.text, self.starts, self.last = text, starts, last

    def tokens(self) -> list[int]:
        return [t for last in self.last for t in self.pairs.tokens(last, len(last))]


#: The split pattern that _Split follows: contractions, letters, digits, others, white space. Fixed value.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bytes of text that are encoded at once, and slots for pairs of tokens.
_BULK, _SLOTS = 4 << 20, 1 << 21


@functools.cache
def _classes() -> np.ndarray:
    """Of every character: 1 letter, 2 digit, 0 white space, 3 other."""
    every = "".join(chr(c) if not 0xD800 <= c < 0xE000 else "\x01" for c in range(0x110000))
    kinds = np.full(len(every), 3, np.uint8)
    for pattern, kind in ((r"\p{L}+", 1), (r"\p{N}+", 2), (r"\s+", 0)):
        for m in regex.finditer(pattern, every):
            kinds[m.start() : m.end()] = kind
    return kinds


def _split(points: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where the matches of WORDS start, for texts of code points one after the other; bounds has the texts' ends too.

    A match is a run of one class, but: the last white space of a run goes with the next run if it is a blank, and is a
    match of its own if it is another character; an apostrophe alone takes the letters of a contraction.
    """
    n = len(points)
    kinds = _classes()[points]
    edge = np.ones(n + 1, bool)
    edge[1:n] = kinds[1:] != kinds[:-1]
    first = np.zeros(n + 1, bool)
    first[bounds] = True
    edge |= first
    start = edge.copy()
    ends = np.flatnonzero(edge[1:]) + 1
    last = ends - 1
    space = last[(kinds[last] == 0) & ~first[ends]]
    start[space] = True
    blank = space[points[space] == 0x20]
    start[blank + 1] = False
    mark = np.flatnonzero((points == 39) & start[:n] & edge[1:])
    stop = bounds[np.searchsorted(bounds, mark, side="right")]
    after = np.zeros((len(mark), 2), np.int64)
    for k in (1, 2):
        inside = mark + k < stop
        after[inside, k - 1] = points[mark[inside] + k]
    one = np.isin(after[:, 0], [ord(c) for c in "stmd"])
    two = ~one & np.isin(after[:, 0] << 32 | after[:, 1], [ord(a) << 32 | ord(b) for a, b in ("re", "ve", "ll")])
    for found, size in ((mark[one], 2), (mark[two], 3)):
        start[found + 1] = False
        behind = found + size
        same = (behind < n) & ~first[np.minimum(behind, n)]
        start[behind[same & (kinds[np.minimum(behind, n - 1)] == 1)]] = True
    start[n] = True
    return np.flatnonzero(start)


class Bulk:
    """The prefix tables of many short pieces at once, byte by byte; see BytePairs for one piece."""

    def __init__(self, known: BytePairs):
        self.known = known
        self.sizes = np.zeros(max(known.bytes) + 1, np.int64)
        for n, t in known.bytes.items():
            self.sizes[n] = len(t)
        short = [(t, n) for t, n in known.ranks.items() if len(t) <= SHORT]
        flat = np.frombuffer(b"".join(t for t, _ in short), np.uint8)
        size = np.array([len(t) for t, _ in short])
        self.low, self.high = Loads(flat).keys(np.cumsum(size) - size, size)
        self.token = np.array([n for _, n in short], np.int64)
        self.mask = np.uint64((1 << (4 * len(short)).bit_length()) - 1)
        self.slots = np.full(int(self.mask) + 1, -1, np.int64)
        slot, self.probes = (mix_pair(self.low, self.high) & self.mask).astype(np.int64), 0
        left = np.arange(len(short))
        while len(left):
            free = left[self.slots[slot[left]] < 0]
            self.slots[slot[free]] = free
            left = left[self.slots[slot[left]] != left]
            slot[left] = (slot[left] + 1) & int(self.mask)
            self.probes += 1
        self.keys, self.fine = np.zeros(_SLOTS, np.uint64), np.zeros(_SLOTS, bool)

    def _tokens(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The token of each string, -1 for none."""
        out = np.full(len(low), -1, np.int64)
        slot, left = (mix_pair(low, high) & self.mask).astype(np.int64), np.arange(len(low))
        for _ in range(self.probes):
            at = self.slots[slot[left]]
            left, at = left[at >= 0], at[at >= 0]
            if not len(left):
                break
            same = (self.low[at] == low[left]) & (self.high[at] == high[left])
            out[left[same]] = self.token[at[same]]
            left = left[~same]
            slot[left] = (slot[left] + 1) & int(self.mask)
        return out

    def _follow(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether each token may follow the one before (0: none, else its id plus one); answers are kept in slots."""
        key = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64) | np.uint64(1 << 63)
        slot = (mix_pair(key, key) & np.uint64(_SLOTS - 1)).astype(np.int64)
        known = self.keys[slot] == key
        out = self.fine[slot]
        if not known.all():
            ask, back = np.unique(key[~known], return_inverse=True)
            answers = np.array([self.known._check(k) for k in (ask & np.uint64((1 << 63) - 1)).tolist()], bool)
            out[~known] = answers[back]
            slot = (mix_pair(ask, ask) & np.uint64(_SLOTS - 1)).astype(np.int64)
            self.keys[slot] = ask
            self.fine[slot] = answers & (self.keys[slot] == ask)
            self.keys[slot[self.keys[slot] != ask]] = 0
        return out

    def tables(self, loads: Loads, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The last token of every prefix of pieces that start at `at`, of `size` bytes each (longest first)."""
        last = np.full((len(at), int(size[0]) if len(size) else 0), -1, np.int64)
        for i in range(1, last.shape[1] + 1):
            rows = np.arange(int(np.searchsorted(-size, -i, side="right")))
            for k in range(i, 0, -1):
                token = self._tokens(*loads.keys(at[rows] + (i - k), k))
                some = np.flatnonzero(token >= 0)
                before = last[rows[some], i - k - 1] + 1 if k < i else np.zeros(len(some), np.int64)
                ok = some[self._follow(before, token[some])]
                last[rows[ok], i - 1] = token[ok]
                rows = np.delete(rows, ok)
                if not len(rows):
                    break
            else:
                raise ValueError("the vocabulary has no token for a byte")
        return last

    def encode(self, loads: Loads, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of pieces, one after the other, and the pieces' bounds in them."""
        order = np.argsort(-size, kind="stable")
        last, end = self.tables(loads, at[order], size[order]), size[order].copy()
        rows, found, steps = np.arange(len(order)), [], 0
        while len(rows):
            token = last[rows, end[rows] - 1]
            found.append((order[rows], np.full(len(rows), steps), token))
            end[rows] -= self.sizes[token]
            rows, steps = rows[end[rows] > 0], steps + 1
        if not found:
            return np.zeros(0, np.int64), np.zeros(len(at) + 1, np.int64)
        piece, step, token = map(np.concatenate, zip(*found))
        ids = token[np.lexsort((-step, piece))]
        return ids, np.concatenate([[0], np.cumsum(np.bincount(piece, minlength=len(at)))])

    def texts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of UTF-8 texts, one after the other, and the texts' bounds in them."""
        try:
            points = np.frombuffer(str(data.data, "utf-8").encode("utf-32-le"), np.uint32)
        except UnicodeDecodeError:
            each = [str(data[a:b].data, "utf-8", "replace").encode() for a, b in zip(offsets[:-1], offsets[1:])]
            return self.texts(np.frombuffer(b"".join(each), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in each])]).astype(np.int64))
        if not len(points):
            return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
        place = np.concatenate([np.flatnonzero(data & 0xC0 != 0x80), [len(data)]])
        edges = place[_split(points, np.searchsorted(place, offsets))]
        starts, size = edges[:-1], np.diff(edges)
        bounds = np.searchsorted(starts, offsets)
        counts, begin, pool = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64), []
        loads, short = Loads(data), np.flatnonzero(size <= SHORT)
        low, high = loads.keys(starts[short], size[short])
        hashes, first, back = np.unique(mix_pair(low, high), return_index=True, return_inverse=True)
        odd = (low[first][back] != low) | (high[first][back] != high)  # strings of one hash
        if odd.any():
            keys, first, back = np.unique(np.stack([low, high], 1), axis=0, return_index=True, return_inverse=True)
            back = back.reshape(-1)
        ids, own = self.encode(loads, starts[short][first], size[short][first])
        counts[short], begin[short] = np.diff(own)[back], own[:-1][back]
        pool.append(ids)
        total = len(ids)
        for i in np.flatnonzero(size > SHORT).tolist():
            ids = np.frombuffer(self.known.pieces[str(data[edges[i] : edges[i + 1]].data, "utf-8")], "<u4").astype(np.int64)
            counts[i], begin[i] = len(ids), total
            total += len(ids)
            pool.append(ids)
        sums = np.concatenate([[0], np.cumsum(counts)])
        return np.concatenate(pool)[np.repeat(begin - sums[:-1], counts) + np.arange(sums[-1])], sums[bounds]


@functools.cache
def pairs(path: str, pattern: str) -> BytePairs:
    return BytePairs.read(path, pattern)


@functools.cache
def bulk(path: str) -> Bulk:
    return Bulk(pairs(path, WORDS))


def _texts(column):
    """Each text of an Arrow string column; null is empty, bytes that are no UTF-8 become U+FFFD."""
    data, offsets = flat_texts(column)
    raw = memoryview(data)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        yield str(raw[a:b], "utf-8", "replace")


def encode_texts(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_prefixes: bool = False) -> DataFrame:
    """Per row: id, n_tokens, token_ids (little-endian unsigned 32-bit integers) and, with_prefixes, last_tokens.

    Each match of the pattern is encoded by itself, by the ranks; there are no special tokens. last_tokens has, for every
    byte of the text, the last token of its piece's encoding up to that byte. Null and empty texts have no tokens; ids may
    be null or repeat, every row is encoded by itself; other columns are not carried. ranks_path must be readable on the
    executors. One pass without a shuffle; a task holds one text's ids and a bounded table of pieces.
    """
    fields = [T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("token_ids", T.BinaryType())]
    schema = T.StructType([*fields, T.StructField("last_tokens", T.ArrayType(T.IntegerType()))] if with_prefixes else fields)

    def run(batches):
        import pyarrow as pa

        known = pairs(ranks_path, pattern)
        for batch in batches:
            data, offsets = flat_texts(batch.column(1))
            for a, b in chunks(offsets, _BULK):
                own, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                tables = None
                if pattern == WORDS and not with_prefixes:
                    ids, bounds = bulk(ranks_path).texts(own, at)
                    packed, counts = ids.astype("<u4").tobytes(), np.diff(bounds)
                else:
                    texts = [str(own[x:y].data, "utf-8", "replace") for x, y in zip(at[:-1], at[1:])]
                    if with_prefixes:
                        found = [known.table(t) for t in texts]
                        tables = pa.array([[t for last in x.last for t in last] for x in found], pa.list_(pa.int32()))
                        each = [np.array(x.tokens(), "<u4").tobytes() for x in found]
                    else:
                        each = [known.encode(t) for t in texts]
                    packed, counts = b"".join(each), np.array([len(x) // 4 for x in each])
                ends = np.concatenate([[0], np.cumsum(4 * counts)]).astype(np.int32)
                columns = [batch.column(0).slice(a, b - a), pa.array(counts, pa.int64()), pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(ends), pa.py_buffer(packed)])]
                yield pa.RecordBatch.from_arrays(columns if tables is None else [*columns, tables], names=schema.names)

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(in_task(run), schema)


def decode_tokens(encoded: DataFrame, ranks_path: str, pattern: str, ids_col: str = "token_ids") -> DataFrame:
    """The rows with their ids replaced by `decoded`, the bytes that the ids stand for; null ids give no bytes.

    An id that the vocabulary lacks raises an error, as the library has it.
    """
    rest = [f for f in encoded.schema.fields if f.name != ids_col]
    schema = T.StructType([*encoded.schema.fields, T.StructField("decoded", T.BinaryType())])

    def run(batches):
        import pyarrow as pa

        known = pairs(ranks_path, pattern)
        lookup = known.bytes.__getitem__
        for batch in batches:
            packed = batch.column(len(rest))
            for first in range(0, batch.num_rows, 500):
                own = packed.slice(first, 500)
                raw = [b"".join(map(lookup, np.frombuffer(x.as_buffer(), "<u4").tolist())) if x.is_valid and len(x.as_buffer()) else b"" for x in own]
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(first, 500) for i in range(len(rest))), own, pa.array(raw, pa.binary())], names=[*(f.name for f in rest), ids_col, "decoded"])

    ordered = T.StructType([*rest, encoded.schema[ids_col], schema["decoded"]])
    return encoded.select(*(F.col(f"`{f.name}`") for f in rest), F.col(ids_col)).mapInArrow(in_task(run), ordered)


def apply_edits(docs: DataFrame, edits: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Texts after edits and their encodings, worked out anew near the edits only: id, text, n_tokens, token_ids, worked_bytes.

    edits has the id, seq, at (a character), removed (characters) and put; a text's edits apply in order of seq, and an edit
    beyond the end appends. Null positions and counts are 0, null strings empty, null texts empty. Texts without edits, and
    edits whose id (null too) has no text, give no row; rows that share an id each get all its edits. worked_bytes counts
    the bytes whose last token was worked out, those of the first encoding not counted. Edits of one text are read by one
    task, in order, as each builds on the one before.
    """
    todo = F.array_sort(F.collect_list(F.struct(F.coalesce("seq", F.lit(0)).cast("long").alias("seq"), F.coalesce("at", F.lit(0)).cast("long").alias("at"), F.coalesce("removed", F.lit(0)).cast("long").alias("removed"), F.coalesce("put", F.lit("")).alias("put"))))
    lists = edits.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(todo.alias("_todo"))
    rows = docs.select(F.col(id_col), F.coalesce(text_col, F.lit("")).alias("text")).join(lists, F.col(id_col) == F.col("_id")).drop("_id")
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("text", T.StringType()), T.StructField("n_tokens", T.LongType()), T.StructField("token_ids", T.BinaryType()), T.StructField("worked_bytes", T.LongType())])

    def run(batches):
        import pyarrow as pa

        known = pairs(ranks_path, pattern)
        for batch in batches:
            for i, (text, own) in enumerate(zip(_texts(batch.column(1)), batch.column(2))):
                table = known.table(text)
                before = table.worked
                for e in own.as_py():
                    table.edit(e["at"], e["removed"], e["put"])
                ids = table.tokens()
                columns = [batch.column(0).slice(i, 1), pa.array([table.text]), pa.array([len(ids)], pa.int64()), pa.array([np.array(ids, "<u4").tobytes()], pa.binary()), pa.array([table.worked - before], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.mapInArrow(in_task(run), schema)


def ids_within(packed: Column, budget: int) -> Column:
    """The first `budget` tokens of packed ids."""
    return F.substring(packed, 1, 4 * budget)
