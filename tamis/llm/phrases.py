"""Phrase collocations by Toivonen's sampling: a sample proposes, a full pass counts, and misses are counted in turn.

A sample proposes the words and phrases that seem frequent. One pass over everything then counts, exactly, every word and
every phrase whose parts of one word less are both proposed: the proposed phrases and their negative border. What turns out
frequent without having been proposed may be part of frequent phrases that were not counted; another pass counts just those
phrases, and so on until nothing new is frequent. Proposals reach the tasks as bit maps of a fixed size: two phrases that
share a bit make a task count more than it must, never less. The passes count 64-bit codes, which are short and of one
length; codes that two phrases share make a phrase seem more frequent, never less, and a last pass counts the texts of the
phrases whose codes are frequent.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tamis.llm.common import SHORT, Loads, chunks, flat_texts, in_task, join_codes, materialize, mix_pair, word_hashes

#: Share of the rows that proposes, and the count in it from which a phrase is proposed.
SAMPLE, PROPOSED = 0.125, 2
#: Bits of the map of one length of phrase, as a power of two (8 MB); bytes of text whose phrases are counted at once, and
#: codes that are added up before they leave the task.
_BITS, _STEP, _HELD = 26, 2 << 20, 3_000_000
#: Parts of a language that are ranked by themselves before its best are ranked together.
_PARTS = 64
#: Language of rows without one.
NO_LANGUAGE = "und"

#: 1 ends a word, 2 ends a piece too.
_ENDS = np.zeros(256, np.uint8)
_ENDS[[0x20, 0x09]] = 1
_ENDS[[*b".,;:!?\n\x0b\x0c\r"]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Maps:
    """For phrases of 1, 2, ... words, a bit map of those named so far."""

    def __init__(self, longest: int):
        self.bits = [np.zeros(1 << (_BITS - 6), np.uint64) for _ in range(longest)]

    def has(self, k: int, codes: np.ndarray) -> np.ndarray:
        at = codes & np.uint64((1 << _BITS) - 1)
        return (self.bits[k - 1][(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)

    def propose(self, found: DataFrame) -> bool:
        """Put found codes (k, code) into the maps; whether one was not in there. What reaches the driver are cells of the
        maps, a fixed number at most, whatever is found."""
        at = F.col("code").bitwiseAND((1 << _BITS) - 1)
        rows = found.groupBy("k", F.shiftright(at, 6).alias("cell")).agg(F.bit_or(F.expr("shiftleft(1L, cast(code & 63 as int))")).alias("bits")).toArrow()
        k, cell, bits = (rows.column(c).to_numpy() for c in ("k", "cell", "bits"))
        fresh = False
        for own in range(1, len(self.bits) + 1):
            at, new = cell[k == own], bits[k == own].view(np.uint64)
            fresh |= bool((new & ~self.bits[own - 1][at]).any())
            self.bits[own - 1][at] |= new
        return fresh

    def __getstate__(self) -> list[bytes]:
        return [zlib.compress(b, 1) for b in self.bits]

    def __setstate__(self, packed: list[bytes]) -> None:
        self.bits = [np.frombuffer(zlib.decompress(b), np.uint64) for b in packed]

    def copy(self) -> Maps:
        other = Maps(len(self.bits))
        other.bits = [b.copy() for b in self.bits]
        return other


class _Grams:
    """The words of texts in lower case and the codes of all phrases of up to `longest` of them."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, tags: np.ndarray, longest: int):
        self.low = _LOWER[data]
        kinds = _ENDS[data]
        n, inside = len(data), kinds == 0
        first, last = inside.copy(), inside.copy()
        if n:
            same = inside[1:] & inside[:-1]
            cut = np.zeros(n + 1, bool)
            cut[offsets] = True
            same &= ~cut[1:n]
            first[1:] &= ~same
            last[:-1] &= ~same
        self.starts, self.ends = np.flatnonzero(first).astype(np.int32), (np.flatnonzero(last) + 1).astype(np.int32)
        self.text = (np.searchsorted(offsets, self.starts, side="right") - 1).astype(np.int32)
        piece = np.searchsorted(np.flatnonzero(kinds == 2).astype(np.int32), self.starts)
        size = self.ends - self.starts
        codes = mix_pair(*Loads(self.low).keys(self.starts, np.minimum(size, SHORT)))
        if (long := np.flatnonzero(size > SHORT)).size:
            codes[long] = word_hashes(self.low, self.starts[long], self.ends[long])
        codes = join_codes(tags[self.text], codes)
        #: linked[k - 1] and codes[k - 1]: whether k words stand in one piece from each word on, and their code.
        self.linked, self.codes = [np.ones(len(codes), bool)], [codes]
        together = (piece[1:] == piece[:-1]) & (self.text[1:] == self.text[:-1])
        for k in range(2, longest + 1):
            m = max(0, len(codes) - k + 1)
            self.linked.append(self.linked[-1][:m] & together[k - 2 : k - 2 + m])
            self.codes.append(join_codes(self.codes[-1][:m], codes[k - 1 : k - 1 + m]))

    def chosen(self, k: int, maps: Maps | None) -> np.ndarray:
        """Phrases of k words, by their first word, whose parts of k - 1 words are both in the maps; no maps: none."""
        m = len(self.codes[k - 1])
        if maps is None:
            return np.zeros(m, bool)
        parts = maps.has(k - 1, self.codes[k - 2])
        return self.linked[k - 1] & parts[:m] & parts[1 : m + 1]

    def phrases(self, at: np.ndarray, k: int):
        """The texts of phrases of k words that start at words `at`, as an Arrow array."""
        import pyarrow as pa

        size = np.stack([self.ends[at + j] - self.starts[at + j] for j in range(k)], axis=1).astype(np.int64)
        stop = np.cumsum(size.sum(axis=1) + k - 1)
        out = np.full(int(stop[-1]) if len(stop) else 0, 0x20, np.uint8)
        place = np.concatenate([[0], stop[:-1]])
        for j in range(k):
            own = size[:, j]
            inner = np.arange(int(own.sum())) - np.repeat(np.cumsum(own) - own, own)
            out[np.repeat(place, own) + inner] = self.low[np.repeat(self.starts[at + j], own) + inner]
            place = place + own + 1
        offsets = np.concatenate([[0], stop]).astype(np.int64)
        return pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(out)]).cast(pa.string())


def _tagged(languages):
    """The code of each row's language, which it is, and the languages."""
    coded = languages.dictionary_encode()
    data, offsets = flat_texts(coded.dictionary)
    tags = word_hashes(data, offsets[:-1], offsets[1:]) if len(offsets) > 1 else np.zeros(0, np.uint64)
    own = coded.indices.to_numpy()
    return tags[own] if len(tags) else np.zeros(0, np.uint64), own, coded.dictionary


def _distinct(codes: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each code once, a place where it stands, and its number or the sum of its weights."""
    order = np.argsort(codes)
    codes = codes[order]
    head = np.flatnonzero(np.concatenate([np.ones(min(1, len(codes)), bool), codes[1:] != codes[:-1]]))
    n = np.diff(np.append(head, len(codes))) if weights is None else np.add.reduceat(weights[order], head) if len(head) else weights
    return codes[head], order[head], n


def _codes(rows: DataFrame, longest: int, sent: Broadcast, words: bool, least: int) -> DataFrame:
    """(k, code) of the phrases that the second maps sent choose and the first do not, and which occur `least` times or
    more; words: of words too."""

    def added(held):
        import pyarrow as pa

        for k, parts in held.items():
            codes, _, n = _distinct(*map(np.concatenate, zip(*parts)))
            for c in range(0, len(codes), 200_000):
                own = codes[c : c + 200_000].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), k, np.int8)), pa.array(own), pa.array(n[c : c + 200_000])], names=["k", "code", "n"])

    def run(batches):
        before, now = sent.value
        held, size = {}, 0
        for batch in batches:
            data, offsets = flat_texts(batch.column(1))
            for a, b in chunks(offsets, _STEP):
                tags, *_ = _tagged(batch.column(0).slice(a, b - a))
                grams = _Grams(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], tags, longest)
                for k in range(1 if words else 2, longest + 1):
                    if k > 1 and now is None:
                        break
                    codes, _, n = _distinct(grams.codes[k - 1][grams.chosen(k, now) & ~grams.chosen(k, before)] if k > 1 else grams.codes[0])
                    held.setdefault(k, []).append((codes, n))
                    size += len(codes)
                if size >= _HELD:
                    yield from added(held)
                    held, size = {}, 0
        yield from added(held)

    counts = rows.mapInArrow(in_task(run), "k tinyint, code long, n long")
    return counts.groupBy("k", "code").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("k", "code")


def _texts(rows: DataFrame, longest: int, sent: Broadcast) -> DataFrame:
    """(lang, phrase, n): parts of the counts of the phrases in the maps sent, and with phrase null of all words."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            data, offsets = flat_texts(batch.column(1))
            for a, b in chunks(offsets, 2 * _STEP):
                languages = batch.column(0).slice(a, b - a)
                tags, which, names = _tagged(languages)
                grams = _Grams(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], tags, longest)
                yield pa.RecordBatch.from_arrays([names, pa.nulls(len(names), pa.string()), pa.array(np.bincount(which[grams.text], minlength=len(names)))], names=["lang", "phrase", "n"])
                for k in range(1, longest + 1):
                    some = np.flatnonzero(grams.linked[k - 1] & sent.value.has(k, grams.codes[k - 1]))
                    _, first, n = _distinct(grams.codes[k - 1][some])
                    for c in range(0, len(first), 50_000):
                        at = some[first[c : c + 50_000]]
                        yield pa.RecordBatch.from_arrays([languages.take(pa.array(grams.text[at])), grams.phrases(at, k), pa.array(n[c : c + 50_000])], names=["lang", "phrase", "n"])

    return rows.mapInArrow(in_task(run), "lang string, phrase string, n long")


def phrase_counts(docs: DataFrame, least: int, longest: int = 3, text_col: str = "text", lang_col: str = "lang", sample: float = SAMPLE) -> DataFrame:
    """(lang, phrase, n) of every phrase of up to `longest` words that occurs at least `least` times, and with phrase null
    the number of words of each language. Exact, whatever the sample holds: it decides what is counted when."""
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(NO_LANGUAGE)).alias("lang"), F.col(text_col).alias("text"))
    some, maps, send = rows.where(F.rand(17) < sample), Maps(longest), docs.sparkSession.sparkContext.broadcast
    for k in range(1, longest):
        sent = send((None, maps if k > 1 else None))
        maps.propose(_codes(some, longest, sent, k == 1, PROPOSED).where(F.col("k") == k))
        sent.destroy()
    old, frequent = None, Maps(longest)
    while True:
        sent = send((old, maps))
        found = materialize(_codes(rows, longest, sent, old is None, least), "codes")
        sent.destroy()
        old = maps.copy()
        frequent.propose(found)
        if not maps.propose(found.where(F.col("k") < longest)):
            break
    sent = send(frequent)
    out = materialize(_texts(rows, longest, sent).groupBy("lang", "phrase").agg(F.sum("n").alias("n")).where((F.col("n") >= least) | F.col("phrase").isNull()), "phrases")
    sent.destroy()
    return out


def mine_phrases(docs: DataFrame, least: int = 10, longest: int = 3, inside: int = 50, top: int = 2000, text_col: str = "text", lang_col: str = "lang", sample: float = SAMPLE) -> DataFrame:
    """Per language the `top` phrases of 2 to `longest` words by score: lang, rank, phrase, a, l, r, n, score.

    Texts are lower-cased (A to Z) and split into pieces at . , ; : ! ? and line ends, pieces into words at blanks and tabs.
    a is the number of times the phrase stands inside pieces, overlaps included, at least `least`. Cut after its first k
    words, l and r are the counts of the two parts and the score is floor(1000000 a a / (l r)), in exact decimals; the cut
    of lowest score counts, of several the one of least k. n is the number of the language's words. Phrases inside a longer
    one that occurs at least `inside` per cent as often are left out. Ranks go by score, a (both falling) and the phrase's
    bytes. Null texts and texts without words have none, null languages are `und`, repeated rows count again, other columns
    do not matter; an empty table gives no rows.
    """
    counts = phrase_counts(docs, least, longest, text_col, lang_col, sample)
    total = counts.where(F.col("phrase").isNull()).groupBy("lang").agg(F.sum("n").alias("n"))
    frequent = counts.where(F.col("phrase").isNotNull()).select("lang", "phrase", F.col("n").alias("a"))
    long = frequent.withColumn("words", F.split("phrase", " ")).where(F.size("words") > 1)
    part = lambda begin, size: F.array_join(F.slice("words", begin, size), " ")
    cuts = long.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("words") - 1))).select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("left"), part(F.col("k") + 1, F.size("words")).alias("right"))
    sides = [frequent.select("lang", F.col("phrase").alias(side), F.col("a").alias(name)) for side, name in (("left", "l"), ("right", "r"))]
    scored = cuts.join(sides[0], ["lang", "left"]).join(sides[1], ["lang", "right"])
    wide = "cast({} as decimal(16, 0))".format
    scored = scored.withColumn("score", F.expr(f"(1000000 * {wide('a')} * {wide('a')}) div ({wide('l')} * {wide('r')})"))
    lowest = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    pairs = F.sequence(F.lit(2), F.size("words") - 1)
    spans = F.flatten(F.transform(pairs, lambda size: F.transform(F.sequence(F.lit(1), F.size("words") - size + 1), lambda begin: F.array_join(F.slice("words", begin, size), " "))))
    longer = long.where(F.size("words") > 2).select("lang", F.explode(spans).alias("phrase"), F.col("a").alias("outer")).groupBy("lang", "phrase").agg(F.max("outer").alias("outer"))
    kept = lowest.join(longer, ["lang", "phrase"], "left").where(F.col("outer").isNull() | (F.col("outer") * 100 < F.col("a") * inside))
    rows = kept.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score"))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(_PARTS))).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    best = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return best.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
