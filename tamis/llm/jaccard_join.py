"""Jaccard self-join of documents on word shingles with token-combination prefixes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamis.llm.common import chunks, flat_texts, gram_hash, in_task, materialize, mix, word_hashes, word_spans
from tamis.llm.components import connected_components

#: A shingle is frequent if it is in more than this share of all shingle occurrences (and in LEAST_FREQUENT documents):
#: there can be no more than 2**20 such shingles, 8 MB, whatever the corpus; they are broadcast.
FREQUENT_SHARE, LEAST_FREQUENT = 2.0**-20, 200
#: Frequent shingles are combined in pairs where so many signatures must withstand losses; in larger sets, of which the
#: pairs would be too many, they are signatures by themselves. Sets near the border, which may link across it, do both.
MOST_COMBINED = 24
#: The commonest words, whose counts say how rare a shingle is; they are broadcast (9 bytes each).
COMMON_WORDS = 2**16
#: Shingles that a task counts at a time, and the least count at which it reports one.
FLUSH_SHINGLES, REPORT = 1 << 21, 3
#: Up to so many ids of documents to be compared are broadcast (8 bytes each); beyond, they are joined.
SENT_IDS = 200_000
#: Documents of a bucket that are all paired at once; in larger buckets each is paired with those LEAPS places on, and
#: pairs across components follow.
SMALL_BUCKET, LEAPS = 4, (1, 2, 4)
#: Sets whose digests a task remembers.
SEEN = 500_000
#: Bits of a set's parity map: a power of two, at least LEAST_BITS and BITS_PER a shingle, MOST_BITS in all. Sets differ in as
#: many shingles at least as their maps in bits, which bounds the overlap from above.
LEAST_BITS, BITS_PER, MOST_BITS = 2**9, 1, 2**17
#: Shingles of a group of documents whose sets one task holds (8 bytes each) to verify the pairs among them.
GROUP = 1 << 21
#: Documents of a mixed bucket that one task compares with as many others, by their parity maps; of a set of more than LONG
#: shingles each LONG count as one more document, so that the maps of a block take some 8 MB at most.
BLOCK, LONG = 2**14, 2048
#: Pairs of a document with one component of a mixed bucket, likeliest first, that are verified at first, and how many times as
#: many are where there were more and the two are still apart.
FIRST, WIDER = 4, 16
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int, common: tuple[np.ndarray, np.ndarray] | None = None):
    """(text, shingle, set sizes, commonness), by text and shingle without repeats; commonness is None without `common`.

    A text of fewer than n words has one shingle. A shingle is as common as its words are together; common holds word
    hashes in order and the commonness of each (0 for other words).
    """
    data = _LOWER[data]
    starts, ends, bounds = word_spans(data, offsets)
    codes = word_hashes(data, starts, ends)
    grams = gram_hash(codes, n)
    at = np.arange(len(grams))
    text = np.searchsorted(bounds, at, side="right") - 1
    ok = at + n <= bounds[text + 1] if len(at) else np.zeros(0, bool)
    words = np.diff(bounds)
    short = np.flatnonzero((words > 0) & (words < n))
    few = np.zeros(len(short), np.uint64)
    for width in range(1, n):
        own = words[short] == width
        few[own] = gram_hash(codes, width)[bounds[short[own]]]
    first, last = np.concatenate([at[ok], bounds[short]]), np.concatenate([at[ok] + n, bounds[short + 1]])
    text = np.concatenate([text[ok], short])
    token = np.concatenate([grams[ok], few])
    order = np.lexsort((token, text))
    text, token = text[order], token[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (token[1:] != token[:-1])
    score = None
    if common is not None:
        known, level = common
        found = np.minimum(np.searchsorted(known, codes), max(len(known) - 1, 0))
        own = np.where(known[found] == codes, level[found], 0) if len(known) else np.zeros(len(codes), np.int64)
        upto = np.concatenate([[0], np.cumsum(own, dtype=np.int64)])
        score = (upto[last] - upto[first])[order][new]
    text, token = text[new], token[new]
    return text, token, np.bincount(text, minlength=len(offsets) - 1), score


def _sets(batch, n: int, common=None):
    data, offsets = flat_texts(batch.column(1))
    ids = batch.column(0).to_numpy(zero_copy_only=False)
    for a, b in chunks(offsets):
        yield ids[a:b], *shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], n, common)


def _fold(sizes, values) -> np.ndarray:
    """Sum of the values of each text (wrapping)."""
    sums = np.concatenate([[np.uint64(0)], np.cumsum(values, dtype=np.uint64)])
    ends = np.cumsum(sizes)
    return sums[ends] - sums[ends - sizes]


def parity_maps(token: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """For each set (shingles in order of the sets), which of its bits an odd number of shingles falls on, by the low bits of the
    hash: the halves of a map, joined by exclusive or, are the set's map of half the bits."""
    bits = np.full(len(sizes), LEAST_BITS)
    while (short := (bits < BITS_PER * sizes) & (bits < MOST_BITS)).any():
        bits[short] *= 2
    out, ends = [b""] * len(sizes), np.cumsum(sizes)
    for width in np.unique(bits).tolist():
        at = np.flatnonzero(bits == width)
        step = 1 + (1 << 20) // width
        for c in range(0, len(at), step):
            some = at[c : c + step]
            place = np.concatenate([token[ends[i] - sizes[i] : ends[i]] for i in some]) & np.uint64(width - 1)
            count = np.bincount(np.repeat(np.arange(len(some)) * width, sizes[some]) + place.astype(np.int64), minlength=len(some) * width)
            maps = np.packbits((count & 1).astype(np.uint8).reshape(len(some), width), axis=1, bitorder="little")
            for i, row in zip(some.tolist(), maps):
                out[i] = row.tobytes()
    return out


def _folded(maps: np.ndarray, width: int) -> np.ndarray:
    """Maps (one a row, as 64-bit words) brought to so many words."""
    return maps if maps.shape[1] == width else np.bitwise_xor.reduce(maps.reshape(len(maps), -1, width), axis=1)


def most_common(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Upper bound of the overlap of sets of n and m shingles, for rows of parity maps; x or y may be one row."""
    width = min(x.shape[1], y.shape[1])
    differ = np.bitwise_count(_folded(x, width) ^ _folded(y, width)).sum(1, dtype=np.int64)
    return np.minimum((n + m - differ) // 2, np.minimum(n, m))


def profiles(docs: DataFrame, n: int) -> DataFrame:
    """docs(id, text) -> (id, n_shingles, s1, s2, parity): set size, two 64-bit digests of the set, its parity map."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            data, offsets = flat_texts(batch.column(1))
            for a, b in chunks(offsets):
                text, token, sizes, _ = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], n)
                s1, s2 = _fold(sizes, mix(token)), _fold(sizes, mix(token ^ np.uint64(0xA5A5A5A55A5A5A5A)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(sizes.astype(np.int64)), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), pa.array(parity_maps(token, sizes), pa.binary())], names=["id", "n_shingles", "s1", "s2", "parity"])

    return docs.mapInArrow(in_task(run), "id long, n_shingles long, s1 long, s2 long, parity binary")


def frequencies(docs: DataFrame, n: int, total: int) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """The frequent shingles, and the common words with log2 of their counts, from every task's counts.

    Both are bounded whatever the corpus, and which ones they are only matters for speed.
    """

    def run(batches):
        import pyarrow as pa

        def report(held):
            for kind, parts in enumerate(held):
                token, count = np.unique(np.concatenate(parts), return_counts=True)
                keep = count >= (REPORT, 4 * REPORT)[kind]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(keep.sum(), kind, np.int32)), pa.array(token[keep].view(np.int64)), pa.array(count[keep].astype(np.int64))], names=["kind", "token", "n"])

        held, size = ([], []), 0
        for batch in batches:
            data, offsets = flat_texts(batch.column(1))
            for a, b in chunks(offsets):
                part, edges = _LOWER[data[offsets[a] : offsets[b]]], offsets[a : b + 1] - offsets[a]
                held[0].append(shingle_sets(part, edges, n)[1])
                held[1].append(word_hashes(part, *word_spans(part, edges)[:2]))
                size += len(held[0][-1])
                if size >= FLUSH_SHINGLES:
                    yield from report(held)
                    held, size = ([], []), 0
        if size:
            yield from report(held)

    counts = materialize(docs.mapInArrow(in_task(run), "kind int, token long, n long").groupBy("kind", "token").agg(F.sum("n").alias("n")), "shingle-counts")
    least = max(LEAST_FREQUENT, total * FREQUENT_SHARE)
    often = counts.where((F.col("kind") == 0) & (F.col("n") > least)).select("token").toArrow().column(0).to_numpy()
    words = counts.where("kind = 1").orderBy(F.desc("n"), "token").limit(COMMON_WORDS).select("token", "n").toArrow()
    hashes, times = words.column(0).to_numpy().view(np.uint64), words.column(1).to_numpy()
    order = np.argsort(hashes)
    return np.sort(often.view(np.uint64)), (hashes[order], np.log2(np.maximum(times[order], 2)).astype(np.uint8))


def _ordered(text, token, sizes, score, known, percent: int, live):
    """The shingles of the live texts in prefix order: (text, shingle, set size, first entry, prefix need, rare ones)."""
    found = np.minimum(np.searchsorted(known, token), max(len(known) - 1, 0))
    often = known[found] == token if len(known) else np.zeros(len(token), bool)
    on = live[text]
    text, token, often = text[on], token[on], often[on]
    order = np.lexsort((token, score[on], often, text))
    text, token, often = text[order], token[order], often[order]
    own = np.where(live, sizes, 0)
    return text, token, own, np.cumsum(own) - own, sizes - -(-percent * sizes // 100) + 1, np.bincount(text[~often], minlength=len(sizes))


def signatures(docs: DataFrame, n: int, percent: int, frequent: np.ndarray, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(sig, s1, id, n): the signatures of every set; two sets that link have one in common.

    The shingles are ordered rare ones first, by the commonness of their words and then by hash within a class. At most size - ceil(t * size) of a set's shingles
    are missing from a set that links. Rare shingles are signatures by themselves, frequent ones in pairs; the prefix is
    extended until that many losses and one more cannot take every signature of it: each rare shingle counts one, m
    frequent ones count m - 1. The set whose prefix reaches less far then shares a whole signature with the other.
    Sets for which that makes too many pairs take frequent shingles one by one, in the same order (MOST_COMBINED).
    """
    sent = docs.sparkSession.sparkContext.broadcast((frequent, common))
    border = max(k for k in range(1, 100 * MOST_COMBINED) if k - -(-percent * k // 100) + 1 <= MOST_COMBINED)

    def run(batches):
        import pyarrow as pa

        (known, common), seen = sent.value, {}
        for batch in batches:
            for ids, text, token, sizes, score in _sets(batch, n, common):
                digest = _fold(sizes, mix(token))
                # equal sets have equal signatures: of those in this task only ever smaller ids speak
                first = np.zeros(len(ids), bool)
                order = np.lexsort((ids, digest))
                order = order[sizes[order] > 0]
                lead = order[_edges_of(digest[order])[:-1]] if len(order) else order
                for i, key, own in zip(lead.tolist(), digest[lead].tolist(), ids[lead].tolist()):
                    if own < seen.get(key, own + 1):
                        first[i], seen[key] = True, own
                if len(seen) > SEEN:
                    seen = {}
                text, token, own, start, need, rare = _ordered(text, token, sizes, score, known, percent, first)
                rank = np.arange(len(text)) - start[text]
                often = rank >= rare[text]
                alone = 100 * sizes > percent * border  # may link with a set beyond the border
                single = (~often | alone[text]) & (rank < need[text])
                sig, who = [token[single]], [text[single]]
                more = np.where((rare < need) & (percent * sizes <= 100 * border), np.minimum(own - rare, need - rare + 1), 0)
                for i in np.flatnonzero((more > 1) & first).tolist():
                    p = token[start[i] + rare[i] : start[i] + rare[i] + more[i]]
                    x, y = np.triu_indices(len(p), 1)
                    low, high = np.minimum(p[x], p[y]), np.maximum(p[x], p[y])
                    sig.append(mix(low * np.uint64(0x9E3779B97F4A7C15) + high))
                    who.append(np.full(len(x), i))
                sig, who = np.concatenate(sig), np.concatenate(who)
                for c in range(0, len(sig), 200_000):
                    w = who[c : c + 200_000]
                    yield pa.RecordBatch.from_arrays([pa.array(sig[c : c + 200_000].view(np.int64)), pa.array(digest[w].view(np.int64)), pa.array(ids[w]), pa.array(sizes[w].astype(np.int64))], names=["sig", "s1", "id", "n"])

    return docs.mapInArrow(in_task(run), "sig long, s1 long, id long, n long")


def _by_bucket(batches, handle, width: int):
    """Call handle with the columns of whole buckets (rows come sorted by their first column), many at a time."""
    held, size = [], 0
    for batch in batches:
        cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(width)]
        if not len(cols[0]):
            continue
        if held and size >= 50_000:
            change = np.flatnonzero(cols[0] != held[-1][0][-1])
            if len(change):
                head, cols = [c[: change[0]] for c in cols], [c[change[0] :] for c in cols]
                held.append(head)
                yield from handle([np.concatenate(x) for x in zip(*held)])
                held, size = [], 0
        held.append(cols)
        size += len(cols[0])
    if held:
        yield from handle([np.concatenate(x) for x in zip(*held)])


def _edges_of(keys: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]])) if len(keys) else np.zeros(1, np.int64)


def _pair_rows(a, b):
    import pyarrow as pa

    low, high = np.minimum(a, b), np.maximum(a, b)
    order = np.lexsort((high, low))
    low, high = low[order], high[order]
    new = np.ones(len(low), bool)
    new[1:] = (low[1:] != low[:-1]) | (high[1:] != high[:-1])
    new &= low != high
    low, high = low[new], high[new]
    for i in range(0, len(low), 200_000):
        yield pa.RecordBatch.from_arrays([pa.array(low[i : i + 200_000]), pa.array(high[i : i + 200_000])], names=["a", "b"])


def buckets(sigs: DataFrame, percent: int) -> DataFrame:
    """Pairs (id, b) of possible size from signatures that different sets share: all of a small bucket; in a larger one each
    set with those LEAPS places on by size. Members of larger buckets follow as rows (sig, id, n, m, key) without b: m sets
    share the signature, and key tells which."""

    def run(batches):
        import pyarrow as pa

        names = ["sig", "id", "n", "m", "key", "b"]

        def handle(cols):
            sig, s1, ids, n = cols
            order = np.lexsort((ids, s1, sig))
            sig, s1, ids, n = sig[order], s1[order], ids[order], n[order]
            new = np.ones(len(sig), bool)
            new[1:] = (sig[1:] != sig[:-1]) | (s1[1:] != s1[:-1])
            sig, ids, n = sig[new], ids[new], n[new]
            m = np.repeat(np.diff(_edges_of(sig)), np.diff(_edges_of(sig)))
            sig, ids, n, m = (x[m > 1] for x in (sig, ids, n, m))
            order = np.lexsort((ids, n, sig))
            sig, ids, n, m = (x[order] for x in (sig, ids, n, m))
            edges = _edges_of(sig)
            size = np.diff(edges)
            left = np.repeat(edges[1:], size) - np.arange(len(sig))  # places up to the bucket's end
            a, b = [ids[:0]], [ids[:0]]
            for step in range(1, 1 + max(SMALL_BUCKET - 1, *LEAPS)):
                can = np.flatnonzero((left > step) & ((m <= SMALL_BUCKET) | (step in LEAPS)))
                fit = can[100 * n[can] >= percent * n[can + step]]
                a.append(ids[fit])
                b.append(ids[fit + step])
            for pair in _pair_rows(np.concatenate(a), np.concatenate(b)):
                none = pa.nulls(pair.num_rows, pa.int64())
                yield pa.RecordBatch.from_arrays([none, pair.column(0), none, none, none, pair.column(1)], names=names)
            key = np.repeat(np.add.reduceat(mix(ids.view(np.uint64)), edges[:-1]), size) if len(ids) else ids.view(np.uint64)
            large = m > SMALL_BUCKET
            columns = [pa.array(x[large]) for x in (sig, ids, n, m.astype(np.int64), key.view(np.int64))]
            yield pa.RecordBatch.from_arrays([*columns, pa.nulls(int(large.sum()), pa.int64())], names=names)

        yield from _by_bucket(batches, handle, 4)

    return sigs.repartition("sig").sortWithinPartitions("sig").mapInArrow(in_task(run), "sig long, id long, n long, m long, key long, b long")


def links_across(rows: DataFrame, percent: int, first: int) -> DataFrame:
    """rows(sig, g, o, left, minor, here, id, n, component, parity) of mixed buckets -> (a, b, bound, more): pairs across
    components that the parity maps do not rule out, and the similarity in thousandths that they allow.

    The documents of group g (left) are compared with those of block o (here); two minor ones where the smaller id is left.
    Of the pairs of a left document with one component the `first` likeliest are given; more is its id where there were others.
    """

    def compare(left, minor, here, ids, n, comp, parity):
        order = np.lexsort((ids, n))
        left, minor, here, ids, n, comp = (x[order] for x in (left, minor, here, ids, n, comp))
        comp = np.unique(comp, return_inverse=True)[1]
        parity = [parity[i] for i in order.tolist()]
        width = np.array([len(p) // 8 for p in parity])
        edges = _edges_of(width)  # maps grow with the sets
        kinds = [(int(width[x]), x, y) for x, y in zip(edges[:-1].tolist(), edges[1:].tolist())]
        maps = {(w, w): np.frombuffer(b"".join(parity[x:y]), np.uint64).reshape(y - x, w) for w, x, y in kinds}
        out = []
        for i in np.flatnonzero(left).tolist():
            low, high = np.searchsorted(n, -(-percent * n[i] // 100)), np.searchsorted(n, 100 * n[i] // percent, side="right")
            fit = here[low:high] & (comp[low:high] != comp[i]) & (~minor[low:high] | (ids[low:high] > ids[i]))
            j = low + np.flatnonzero(fit)
            if not len(j):
                continue
            own, most = np.frombuffer(parity[i], np.uint64)[None], np.zeros(len(j), np.int64)
            for w, x, y in kinds:
                a, b = np.searchsorted(j, (x, y))
                if a < b:
                    v = min(w, own.shape[1])
                    if (w, v) not in maps:
                        maps[w, v] = _folded(maps[w, w], v)
                    most[a:b] = most_common(maps[w, v][j[a:b] - x], own, n[j[a:b]], n[i])
            ok = (100 + percent) * most >= percent * (n[j] + n[i])
            j, most = j[ok], most[ok]
            bound = 1000 * most // (n[j] + n[i] - most)
            more = np.zeros(len(j), bool)
            if len(j) > first:
                order = np.lexsort((ids[j], -bound, comp[j]))
                j, bound = j[order], bound[order]
                edges = _edges_of(comp[j])
                size = np.diff(edges)
                keep = np.arange(len(j)) - np.repeat(edges[:-1], size) < first
                more = np.repeat(size > first, size)[keep]
                j, bound = j[keep], bound[keep]
            out.append((np.minimum(ids[j], ids[i]), np.maximum(ids[j], ids[i]), bound, more, np.full(len(j), ids[i])))
        return [np.concatenate(x) for x in zip(*out)] if out else None

    def run(batches):
        import pyarrow as pa

        def settle(held):
            found = compare(*(np.concatenate(x) for x in zip(*(h[:6] for h in held))), [p for h in held for p in h[6]])
            for c in range(0, len(found[0]) if found else 0, 200_000):
                a, b, bound, more, who = (x[c : c + 200_000] for x in found)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(bound), pa.array(who, mask=~more)], names=["a", "b", "bound", "more"])

        held, key = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            place = [batch.column(i).to_numpy() for i in range(3)]
            edges = np.flatnonzero(np.concatenate([[True], np.any([x[1:] != x[:-1] for x in place], axis=0), [True]]))
            for x, y in zip(edges[:-1].tolist(), edges[1:].tolist()):
                now = tuple(p[x] for p in place)
                if held and key != now:
                    yield from settle(held)
                    held = []
                key = now
                part = batch.slice(x, y - x)
                held.append((*(part.column(i).to_numpy(zero_copy_only=False) for i in range(3, 9)), part.column(9).to_pylist()))
        if held:
            yield from settle(held)

    columns = ["sig", "g", "o", "left", "minor", "here", "id", "n", "component", "parity"]
    dealt = rows.select(*columns).repartition("sig", "g", "o").sortWithinPartitions("sig", "g", "o")
    return dealt.mapInArrow(in_task(run), "a long, b long, bound long, more long").distinct()


def _may_link(pairs: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """(a, b, bound) of the pairs that the parity maps do not rule out; bound is the similarity in thousandths that they allow."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            n, m = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            x, y = batch.column(4).to_pylist(), batch.column(5).to_pylist()
            most = np.zeros(len(n), np.int64)
            width = np.array([[len(p), len(q)] for p, q in zip(x, y)])
            for w, v in np.unique(width, axis=0):
                at = np.flatnonzero((width == (w, v)).all(1))
                for c in range(0, len(at), 1 + (1 << 22) // int(w + v)):
                    j = at[c : c + 1 + (1 << 22) // int(w + v)]
                    most[j] = most_common(*(np.frombuffer(b"".join(z[i] for i in j), np.uint64).reshape(len(j), k // 8) for z, k in ((x, w), (y, v))), n[j], m[j])
            ok = np.flatnonzero((100 + percent) * most >= percent * (n + m))
            bound = 1000 * most // np.maximum(n + m - most, 1)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ok)), batch.column(1).take(pa.array(ok)), pa.array(bound[ok])], names=["a", "b", "bound"])

    x = known.select(F.col("id").alias("a"), F.col("n_shingles").alias("n"), F.col("parity").alias("x"))
    y = known.select(F.col("id").alias("b"), F.col("n_shingles").alias("m"), F.col("parity").alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "n", "m", "x", "y").mapInArrow(in_task(run), "a long, b long, bound long")


def _best(pairs: DataFrame) -> DataFrame:
    """Of the pairs of each document the one that the parity maps make likeliest."""
    both = pairs.select(F.col("a").alias("u"), F.col("b").alias("v"), "bound").unionByName(pairs.select(F.col("b").alias("u"), F.col("a").alias("v"), "bound"))
    top = both.groupBy("u").agg(F.max_by("v", F.struct("bound", -F.col("v"))).alias("v"))
    return top.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct()


def _packed_sets(docs: DataFrame, n: int) -> DataFrame:
    """docs(id, text, group) -> (id, tokens, group): the whole set in order of the hashes. A task gives equal sets of one id
    once."""

    def run(batches):
        import pyarrow as pa

        seen: set = set()
        for batch in batches:
            group = batch.column(2).to_numpy(zero_copy_only=False)
            at = 0
            for ids, text, token, sizes, _ in _sets(batch, n):
                digest = _fold(sizes, mix(token))
                fresh = [i for i, key in enumerate(zip(ids.tolist(), digest.tolist())) if key not in seen and not seen.add(key)]
                if len(seen) > SEEN:
                    seen = set()
                ends, raw = np.cumsum(sizes), token.tobytes()
                tokens = [raw[8 * int(ends[i] - sizes[i]) : 8 * int(ends[i])] for i in fresh]
                yield pa.RecordBatch.from_arrays([pa.array(ids[fresh]), pa.array(tokens, pa.binary()), pa.array(group[at : at + len(ids)][fresh])], names=["id", "tokens", "group"])
                at += len(ids)

    return docs.select("id", "text", "group").mapInArrow(in_task(run), "id long, tokens binary, group long")


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two whole sets, in order of the hashes, link."""
    at = np.searchsorted(x, y)
    both = int((x[np.minimum(at, len(x) - 1)] == y).sum()) if len(x) else 0
    return 100 * both >= percent * (len(x) + len(y) - both)


def _verified_by_group(pairs: DataFrame, rows: DataFrame, node: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(links, far): the pairs that link, by their whole sets, and the pairs that are left. Each set travels once, to the task of
    the group of documents that pairs connect; groups of more than GROUP shingles in all are not gathered, but left."""
    group = materialize(connected_components(pairs.select(F.col("a").alias("u"), F.col("b").alias("v"))), "groups")
    size = group.join(node.select(F.col("id").alias("g"), "n_shingles"), F.col("node") == F.col("g")).groupBy(F.col("component").alias("c")).agg(F.sum("n_shingles").alias("total")).where(F.col("total") <= GROUP)
    small = materialize(group.join(size.select("c"), F.col("component") == F.col("c"), "left_semi").select(F.col("node").alias("used"), F.col("component").alias("group")), "groups-small")
    dealt = pairs.join(small.withColumnRenamed("used", "a"), "a", "left")
    known = F.broadcast(small) if small.count() <= SENT_IDS else small
    sets = _packed_sets(rows.join(known, rows["id"] == known["used"]), words)
    near = dealt.where("group is not null").select(F.col("a").alias("id"), F.lit(None).cast("binary").alias("tokens"), "group", "b")

    def check(batches):
        import pyarrow as pa

        now, held = None, {}
        for batch in batches:
            u, v = [], []
            for i, (key, id_, b) in enumerate(zip(*(batch.column(c).to_pylist() for c in (2, 0, 3)))):
                if key != now:
                    now, held = key, {}
                if b is None:  # a group's sets come before its pairs
                    held.setdefault(id_, []).append(np.frombuffer(batch.column(1)[i].as_py(), np.uint64))
                elif any(_linked(x, y, percent) for x in held.get(id_, ()) for y in held.get(b, ())):
                    u.append(id_)
                    v.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    mixed = sets.withColumn("b", F.lit(None).cast("long")).unionByName(near).select("id", "tokens", "group", "b")
    links = mixed.repartition("group").sortWithinPartitions("group", F.asc_nulls_first("b")).mapInArrow(in_task(check), "u long, v long")
    return links, materialize(dealt.where("group is null").select("a", "b", "bound"), "pairs-far")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs that link, by their whole sets."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            ok = [_linked(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), percent) for x, y in zip(batch.column(2), batch.column(3))]
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["u", "v"])

    x = sets.select(F.col("id").alias("a"), F.col("tokens").alias("x"))
    y = sets.select(F.col("id").alias("b"), F.col("tokens").alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(in_task(run), "u long, v long")


def _only(rows: DataFrame, used: DataFrame) -> DataFrame:
    """The rows with a used id."""
    used = materialize(used.distinct(), "used")
    return rows.join(F.broadcast(used) if used.count() <= SENT_IDS else used, rows["id"] == used["used"], "left_semi").withColumn("group", F.lit(0).cast("long"))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, percent: int = 90) -> DataFrame:
    """Per row of docs: id, n_shingles, component_id.

    Two documents link when 100 * intersection >= percent * union of their sets of `words`-word shingles (A-Z in lower
    case; fewer words are one shingle). component_id is the smallest id reachable by links, the document's own included.
    Documents without words or text have no shingles and link with nothing. Rows with a null id get a null component
    and are compared with nothing; rows that share an id are one node. Equal sets are joined by their digest, one of
    them is compared with the others. Other columns are not carried; ids are integers; percent is above 50.

    Every pair of different sets that links is found (`signatures`) and verified on whole sets, unless the two are in one
    component already. In large buckets only neighbours by size are written as pairs; documents outside a bucket's largest
    component are compared with the rest of it in place by parity maps, and only what these do not rule out is written, for each
    document and component the likeliest first, the others where the two stay apart.
    """
    if not 50 < percent <= 100:
        raise ValueError("percent must be above 50")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    known = materialize(profiles(rows, words), "profiles")
    rows = rows.where("id is not null")
    total = known.agg(F.sum("n_shingles")).first()[0] or 0
    counted = frequencies(rows, words, total)
    bucket = materialize(buckets(signatures(rows, words, percent, *counted), percent), "buckets")
    node = known.where("n_shingles > 0 and id is not null").groupBy("s1", "s2").agg(F.min("id").alias("node"), F.min("n_shingles").alias("n_shingles"), F.min_by("parity", "id").alias("parity"))
    node = materialize(node.select("s1", "s2", F.col("node").alias("id"), "n_shingles", "parity"), "nodes")
    tried = bucket.where("b is not null").select(F.col("id").alias("a"), "b").distinct()
    pairs = materialize(_may_link(tried, node, percent), "pairs")
    links, label = _proven(pairs, None, rows, node, words, percent)
    large, first, again = bucket.where("b is null"), FIRST, None
    while (found := _across(large, label, node, percent, first, again)) is not None:
        links, label = _proven(found.select("a", "b", "bound").distinct(), links, rows, node, words, percent)
        again = _apart(found.where("more is not null"), label).select(F.col("more").alias("again")).distinct()
        again, first = materialize(again, "again"), first * WIDER
        if again.isEmpty():
            break
    keys = node.select("s1", "s2", F.col("id").alias("node")).join(label.withColumnRenamed("node", "l"), F.col("node") == F.col("l"), "left").select(F.col("s1").alias("k1"), F.col("s2").alias("k2"), F.coalesce("component", "node").alias("component"))
    some = F.col("n_shingles") > 0
    out = known.where(some).join(keys, (F.col("s1") == F.col("k1")) & (F.col("s2") == F.col("k2")), "left").select("id", "n_shingles", "component")
    out = out.unionByName(known.where(~some).select("id", "n_shingles", F.lit(None).cast("long").alias("component")))
    return out.select(F.col("id").alias(id_col), "n_shingles", F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id"))


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("used")).union(pairs.select("b"))


def _apart(pairs: DataFrame, label: DataFrame) -> DataFrame:
    """The pairs (a, b, ...) whose ends are in different components, or in none."""
    x, y = label.select(F.col("node").alias("a"), F.col("component").alias("x")), label.select(F.col("node").alias("b"), F.col("component").alias("y"))
    return pairs.join(x, "a", "left").join(y, "b", "left").where(F.coalesce("x", "a") != F.coalesce("y", "b")).drop("x", "y")


def _proven(pairs: DataFrame, before: DataFrame | None, rows: DataFrame, node: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(links, label): the links before and those of pairs(a, b, bound) by whole sets, and the components that they make."""
    links, far = _verified_by_group(pairs, rows, node, words, percent)
    links = links if before is None else links.unionByName(before)
    if far.isEmpty():
        links = materialize(links, "links")
        return links, materialize(connected_components(links), "labels")
    # each document's likeliest pair first; of the others only those whose ends are not joined by then
    sets = _packed_sets(_only(rows, _ends(far)), words)
    links = materialize(links.unionByName(_verified(_best(far), sets, percent)), "links")
    label = materialize(connected_components(links), "labels")
    others = materialize(_apart(far, label), "pairs-apart")
    if not others.isEmpty():
        links = materialize(links.unionByName(_verified(others, _packed_sets(_only(rows, _ends(others)), words), percent)), "links")
        label = materialize(connected_components(links), "labels")
    return links, label


def _across(large: DataFrame, label: DataFrame, node: DataFrame, percent: int, first: int, again: DataFrame | None) -> DataFrame | None:
    """Pairs (a, b, bound, more) across the components that large buckets still hold, as links_across gives them; None where no
    bucket holds several. The documents of `again`, or else those outside a bucket's largest component, are compared with all."""
    named = large.join(label, large["id"] == label["node"], "left").select("sig", "id", "n", "m", "key", F.coalesce("component", "id").alias("component"))
    weight = F.sum(1 + F.floor(F.least("n", F.lit(MOST_BITS // BITS_PER)) / LONG)).alias("w")
    count = named.groupBy("sig", "m", "key", "component").agg(F.count("*").alias("k"), weight)
    top = F.struct("k", "component")
    mixed = count.groupBy("sig", "m", "key").agg(F.max_by("component", top).alias("largest"), F.sum("w").alias("w"), F.max_by("w", top).alias("main"), F.count("*").alias("kinds")).where("kinds > 1")
    # buckets of the same documents are compared once
    pick = [F.min_by(c, "sig").alias(c) for c in ("largest", "w", "main")]
    mixed = mixed.groupBy("key", "m").agg(*pick, F.min("sig").alias("s")).drop("key", "m")
    if again is not None:
        mixed = mixed.join(large.join(again, F.col("id") == F.col("again")).select(F.col("sig").alias("s")).distinct(), "s", "left_semi")
    mixed = materialize(mixed, "mixed")
    if mixed.isEmpty():
        return None
    held = named.drop("m", "key").join(mixed, F.col("sig") == F.col("s"))
    if again is None:
        held = held.withColumn("minor", F.col("component") != F.col("largest"))
    else:
        held = held.join(again, F.col("id") == F.col("again"), "left").withColumn("minor", F.col("again").isNotNull()).withColumn("main", F.lit(0))
    dealt = lambda salt, parts: F.pmod(F.xxhash64("id", F.lit(salt)), parts).cast("int")
    held = held.withColumn("blocks", F.ceil(F.col("w") / BLOCK).cast("int")).withColumn("groups", F.ceil((F.col("w") - F.col("main")) / BLOCK).cast("int"))
    held = held.withColumn("block", dealt(0, F.col("blocks"))).withColumn("group", dealt(1, F.col("groups")))
    every = F.transform(F.sequence(F.lit(0), F.col("groups") - 1), lambda g: F.struct(g.alias("g"), F.col("block").alias("o")))
    each = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.col("group").alias("g"), o.alias("o")))
    held = held.withColumn("to", F.explode(F.when(F.col("minor"), F.array_union(every, each)).otherwise(every))).select("*", "to.g", "to.o")
    left, here = F.col("minor") & (F.col("g") == F.col("group")), F.col("o") == F.col("block")
    maps = _only(node, named.join(mixed, F.col("sig") == F.col("s"), "left_semi").select(F.col("id").alias("used")))
    maps = maps.select(F.col("id").alias("p_id"), F.col("n_shingles").alias("p_n"), "parity")
    held = held.withColumn("left", left).withColumn("here", here).join(maps, (F.col("id") == F.col("p_id")) & (F.col("n") == F.col("p_n")))
    return materialize(links_across(held, percent, first), "across")
