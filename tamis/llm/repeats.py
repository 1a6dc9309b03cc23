"""Anchored fragments: the stretches of documents that may repeat, gathered by content so that equal stretches meet.

Both exact-repeat operators ask which windows of `span` codes (words or bytes) also start elsewhere. A window's anchor is
the smallest hash among its grams of `k` codes; equal windows have equal anchors at equal offsets. So

1. every task lists the anchors of its documents, and the anchors that occur once in the whole corpus are dropped: no
   window that they stand for repeats (`repeated_anchors`);
2. texts equal to a text with a smaller id are set aside (`copies`): all their windows repeat, and nothing else does so
   because of them;
3. windows with a repeated anchor are cut into fragments, the runs of windows of one anchor occurrence
   (`anchored_fragments`); a fragment equal to an earlier one of the same task is settled there;
4. fragments of one anchor meet in one task, which decides exactly (the operators' own step).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamis.llm.common import byte_codes, chunks, flat_texts, gram_hash, in_task, materialize, minimizers, mix, word_hashes, word_spans

#: A task settles so many anchors, or so many bytes of text, at a time.
FLUSH_ANCHORS, FLUSH_BYTES = 1 << 21, 24 << 20
#: Up to so many copies are set aside by a broadcast of their ids (16 bytes each); beyond, by a join.
SENT_COPIES = 500_000
#: The end of a copy's span, beyond any text.
WHOLE = 1 << 40


@dataclass(frozen=True)
class Unit:
    """What a window counts: `span` codes a window, anchors of `k` codes.

    within: whether an earlier start in the same document counts as well as any start in a smaller one.
    """

    words: bool
    span: int
    k: int
    within: bool

    def codes(self, data: np.ndarray, offsets: np.ndarray):
        """(codes, bounds by text, byte start and end of each code)."""
        if self.words:
            starts, ends, bounds = word_spans(data, offsets)
            return word_hashes(data, starts, ends), bounds, starts, ends
        at = np.arange(len(data))
        return byte_codes(data), offsets, at, at + 1

    def digests(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """128 bits of BLAKE2b of the codes of each span, in two halves: of the bytes, or of the words joined by a space."""
        raw = data.tobytes()
        spans = (raw[a:b] for a, b in zip(starts.tolist(), ends.tolist()))
        if self.words:
            spans = (b" ".join(s.split()) for s in spans)
        both = np.frombuffer(b"".join(blake2b(s, digest_size=16).digest() for s in spans), np.uint64).reshape(-1, 2)
        return both[:, 0].copy(), both[:, 1].copy()


def _buckets(spark) -> int:
    want = 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    return 1 << min(16, max(8, want.bit_length()))


def _list_anchors(unit: Unit, buckets: int):
    """Blobs of anchors by bucket: kind 0 to be matched (one per anchor and flush), kind 1 already known to repeat."""

    def blob(c, kind, g, ids):
        base = int(ids.min())
        wide = int(ids.max()) - base >= 1 << 32
        rel = (ids - base).astype(np.int64 if wide else np.uint32)
        return (c, kind, base, wide, (g & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes(), (g >> np.uint64(32)).astype(np.uint16).tobytes(), rel.tobytes())

    def flush(gs, ids, turn):
        g, who = np.concatenate(gs) >> np.uint64(8), np.concatenate(ids)
        order = np.argsort(g, kind="stable")
        g, who = g[order], who[order]
        first = np.ones(len(g), bool)
        first[1:] = g[1:] != g[:-1]
        again = ~first
        again[:-1] |= ~first[1:]
        out = []
        shift = np.uint64(56 - (buckets.bit_length() - 1))
        mask = (np.uint64(1) << np.uint64(48)) - np.uint64(1)
        if again.any():
            at = np.flatnonzero(again)
            for i, part in enumerate(np.array_split(at, max(1, len(at) // 50_000))):
                out.append(blob((turn * 131 + i) % buckets, 1, g[part] & mask, who[part]))
        ask, known = g[first], again[first]
        who = who[first]
        c = (ask >> shift).astype(np.int64)
        edges = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1], [True]]))
        for a, b in zip(edges[:-1], edges[1:]):
            part = np.arange(a, b)
            for kind, sel in ((0, part[~known[part]]), (2, part[known[part]])):
                if len(sel):
                    out.append(blob(int(c[a]), kind, ask[sel] & mask, who[sel]))
        return out

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        names = ["c", "kind", "base", "wide", "lo", "hi", "who"]
        types = [pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.binary(), pa.binary(), pa.binary()]
        gs, ids, held, turn = [], [], 0, TaskContext.get().partitionId()

        def rows():
            out = flush(gs, ids, turn)
            for i in range(0, len(out), 4096):
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out[i : i + 4096]), types)], names=names)

        for batch in batches:
            data, offsets = flat_texts(batch.column(1))
            doc_ids = batch.column(0).to_numpy(zero_copy_only=False)
            for a, b in chunks(offsets):
                codes, bounds, _, _ = unit.codes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                grams = gram_hash(codes, unit.k)
                chosen, _ = minimizers(grams, bounds, unit.k, unit.span - unit.k + 1)
                at = np.flatnonzero(chosen)
                gs.append(grams[at])
                ids.append(doc_ids[a + np.searchsorted(bounds, at, side="right") - 1])
                held += len(at)
                if held >= FLUSH_ANCHORS:
                    yield from rows()
                    gs, ids, held = [], [], 0
                    turn += 7919
        if held:
            yield from rows()

    return run


def _match_anchors(batches):
    """Of one bucket's blobs: (id, low 32 bits of the anchor) wherever the anchor repeats."""
    import pyarrow as pa

    def unpack(kind, base, wide, lo, hi, who):
        g = np.frombuffer(lo, np.uint32).astype(np.uint64) | (np.frombuffer(hi, np.uint16).astype(np.uint64) << np.uint64(32))
        return g, np.frombuffer(who, np.int64 if wide else np.uint32).astype(np.int64) + base, np.full(len(g), kind, np.int8)

    def settle(held):
        g, who, kind = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(g, kind="stable")
        g, who, kind = g[order], who[order], kind[order]
        same = np.zeros(len(g), bool)
        same[1:] = g[1:] == g[:-1]
        hit = same.copy()
        hit[:-1] |= same[1:]
        sel = hit & (kind == 0)
        return who[sel], g[sel]

    def emit(who, g):
        low = (g & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)
        for i in range(0, len(who), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(who[i : i + 100_000]), pa.array(low[i : i + 100_000])], names=["id", "g"])

    at, held = None, []
    for batch in batches:
        for c, kind, base, wide, lo, hi, who in zip(*(col.to_pylist() for col in batch.columns)):
            g, ids, k = unpack(kind, base, wide, lo, hi, who)
            if kind == 1:
                yield from emit(ids, g)
                continue
            if c != at and held:
                yield from emit(*settle(held))
                held = []
            at = c
            held.append((g, ids, k))
    if held:
        yield from emit(*settle(held))


def repeated_anchors(docs: DataFrame, unit: Unit) -> DataFrame:
    """docs(id long, text string) -> (id, anchors array<int>) for the documents with anchors that repeat in the corpus.

    Anchors are told by 56 bits while they are matched and by 32 within a document: a chance agreement only lets a window
    through that the exact step then drops.
    """
    buckets = _buckets(docs.sparkSession)
    blobs = docs.mapInArrow(in_task(_list_anchors(unit, buckets)), "c int, kind int, base long, wide boolean, lo binary, hi binary, who binary")
    pairs = blobs.repartition("c").sortWithinPartitions("c").mapInArrow(in_task(_match_anchors), "id long, g int")
    return pairs.groupBy("id").agg(F.collect_list("g").alias("anchors"))


def spans_of(mask: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end of every run of true entries that stays within one text."""
    edge = np.zeros(len(mask) + 1, bool)
    edge[bounds] = True
    prev = np.concatenate([[False], mask[:-1]]) & ~edge[:-1]
    nxt = np.concatenate([mask[1:], [False]]) & ~edge[1:]
    return np.flatnonzero(mask & ~prev), np.flatnonzero(mask & ~nxt) + 1


def anchored_fragments(rows: DataFrame, unit: Unit) -> DataFrame:
    """rows(id long, h long, text, anchors) -> fragments (g, f1, f2, id, h, pos, n, bytes) and settled spans.

    A fragment is n consecutive windows with one anchor occurrence, from code pos on; bytes is its text. Rows with null
    bytes are settled, runs of windows whose equals start earlier in the same task (their g only deals them out).
    """

    def fragments(data, offsets, ids, hs, anchors):
        codes, bounds, starts, ends = unit.codes(data, offsets)
        grams = gram_hash(codes, unit.k)
        chosen, least = minimizers(grams, bounds, unit.k, unit.span - unit.k + 1)
        low = ((least >> np.uint64(8)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        live = np.zeros(len(least), bool)
        for i, own in enumerate(anchors):
            a, b = bounds[i], min(bounds[i + 1], len(least))
            if own is not None and b > a:
                live[a:b] = np.isin(low[a:b], own)
        live &= least > 0
        # a run of windows with one anchor; the same gram may be chosen at two places, so the place is found as well
        at = np.flatnonzero(chosen)
        place = np.full(len(least) + 1, -1, np.int64)
        look = np.flatnonzero(live)
        nth = np.searchsorted(at, look)
        while len(look):
            # the leftmost chosen gram from the window's start on that equals its least
            got = at[nth]
            hit = grams[got] == least[look]
            place[look[hit]] = got[hit]
            look, nth = look[~hit], nth[~hit] + 1
        live = place[:-1] >= 0
        edge = np.zeros(len(live) + 1, bool)
        edge[bounds[bounds <= len(live)]] = True
        new = live.copy()
        new[1:] &= (place[1:-1] != place[:-2]) | edge[1:-1]
        first = np.flatnonzero(new)
        stop = live.copy()
        stop[:-1] &= (place[1:-1] != place[:-2]) | edge[1:-1]
        last = np.flatnonzero(stop)
        if not len(first):
            return None
        n = last - first + 1
        doc = np.searchsorted(bounds, first, side="right") - 1
        tail = last + unit.span  # one past the fragment's last code
        a, b = starts[first], ends[tail - 1]
        f1, f2 = unit.digests(data, a, b)
        return least[first], f1, f2, ids[doc], hs[doc], first - bounds[doc], n, a, b

    def run(batches):
        import pyarrow as pa

        names = ["g", "f1", "f2", "id", "h", "pos", "n", "bytes"]
        held, texts, size = [], [], 0

        def flush():
            g, f1, f2, ids, hs, pos, n, start, end = (np.concatenate(x) for x in zip(*held))
            settled = later_copies(g, f1, f2, ids, hs, pos, unit.within)
            i, h, first, last = merged(*(x[settled] for x in (ids, hs, pos)), pos[settled] + n[settled] - 1 + unit.span)
            zero = np.zeros(len(i), np.int64)
            for c in range(0, len(i), 50_000):
                j = slice(c, c + 50_000)
                yield pa.RecordBatch.from_arrays([*(pa.array(x[j]) for x in (mix((i + first).view(np.uint64)).view(np.int64), zero, zero, i, h, first, last - first - unit.span + 1)), pa.nulls(len(i[j]), pa.binary())], names=names)
            whole = np.concatenate(texts)
            open_ = np.flatnonzero(~settled)
            for c in range(0, len(open_), 10_000):
                j = open_[c : c + 10_000]
                size = end[j] - start[j]
                stops = np.cumsum(size)
                at = np.arange(stops[-1]) + np.repeat(start[j] - (stops - size), size)
                payload = pa.Array.from_buffers(pa.binary(), len(j), [None, pa.py_buffer(np.concatenate([[0], stops]).astype(np.int32)), pa.py_buffer(whole[at])])
                yield pa.RecordBatch.from_arrays([*(pa.array(x[j].view(np.int64)) for x in (g, f1, f2)), *(pa.array(x[j]) for x in (ids, hs, pos, n)), payload], names=names)

        for batch in batches:
            data, offsets = flat_texts(batch.column(2))
            ids, hs = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            edges, flat = batch.column(3).offsets.to_numpy(), batch.column(3).values.to_numpy().view(np.uint32)
            for a, b in chunks(offsets):
                part = data[offsets[a] : offsets[b]]
                own = [flat[edges[i] : edges[i + 1]] for i in range(a, b)]
                got = fragments(part, offsets[a : b + 1] - offsets[a], ids[a:b], hs[a:b], own)
                if got is None:
                    continue
                held.append((*got[:7], got[7] + size, got[8] + size))
                texts.append(part)
                size += len(part)
                if size >= FLUSH_BYTES:
                    yield from flush()
                    held, texts, size = [], [], 0
        if held:
            yield from flush()

    return rows.mapInArrow(in_task(run), "g long, f1 long, f2 long, id long, h long, pos long, n long, bytes binary")


def later_copies(g, f1, f2, ids, hs, pos, within: bool) -> np.ndarray:
    """Fragments whose whole content starts earlier among those given; rows that repeat one place are not earlier."""
    order = np.lexsort((pos, hs, ids, f2, f1, g))
    a = [x[order] for x in (g, f1, f2, ids, hs, pos)]
    new = np.ones(len(order), bool)
    new[1:] = (a[0][1:] != a[0][:-1]) | (a[1][1:] != a[1][:-1]) | (a[2][1:] != a[2][:-1])
    lead = np.flatnonzero(new)[np.cumsum(new) - 1]
    later = a[3] != a[3][lead]
    if within:
        later |= (a[4] != a[4][lead]) | (a[5] != a[5][lead])
    out = np.zeros(len(order), bool)
    out[order] = later
    return out


def merged(ids, hs, first, last):
    """Spans of codes, joined where they touch within one document."""
    if not len(ids):
        return ids, hs, first, last
    order = np.lexsort((first, hs, ids))
    ids, hs, first, last = ids[order], hs[order], first[order], last[order]
    doc = np.ones(len(ids), bool)
    doc[1:] = (ids[1:] != ids[:-1]) | (hs[1:] != hs[:-1])
    # documents are set apart on one line, so that one running maximum serves them all
    base = (np.cumsum(doc) - 1) * (int(last.max()) + 2)
    reach = np.maximum.accumulate(last + base)
    new = doc.copy()
    new[1:] |= first[1:] + base[1:] > reach[:-1]
    at = np.flatnonzero(new)
    stop = np.concatenate([at[1:], [len(ids)]]) - 1
    return ids[at], hs[at], first[at], reach[stop] - base[stop]


def least_of(keys: list[np.ndarray], value: np.ndarray) -> np.ndarray:
    """For every entry, the least value among the entries with equal keys."""
    order = np.lexsort((value, *keys))
    new = np.ones(len(order), bool)
    new[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
    out = np.empty_like(value)
    out[order] = value[order][np.flatnonzero(new)[np.cumsum(new) - 1]]
    return out


def settle_fragments(fragments: DataFrame, unit: Unit, decide: Callable, chunk_bytes: int = 1 << 20) -> DataFrame:
    """Fragments of one anchor meet; (id, h, first, last) are the codes that repeated windows cover.

    decide(data, offsets, n, doc, pos) gets the texts of whole anchor groups end to end, with the number of windows, the
    rank of the document and the first code of each fragment. It returns a flat boolean array: for every window of every
    fragment, one after another, whether an equal window starts earlier.
    """

    def run(batches):
        import pyarrow as pa

        def settle(held):
            g, f1, f2, ids, hs, pos, n = (np.concatenate(x) for x in zip(*(h[:7] for h in held)))
            texts = [t for h in held for t in h[7]]
            copies = later_copies(g, f1, f2, ids, hs, pos, unit.within)
            whole, rest = np.flatnonzero(copies), np.flatnonzero(~copies)
            groups, sizes = np.unique(g[rest], return_counts=True)
            rest = rest[np.isin(g[rest], groups[sizes > 1])]
            out = [(ids[whole], hs[whole], pos[whole], pos[whole] + n[whole] - 1 + unit.span)]
            if len(rest):
                rest = rest[np.lexsort((pos[rest], hs[rest], ids[rest]))]
                step = np.zeros(len(rest), bool)
                step[1:] = ids[rest][1:] != ids[rest][:-1]
                if unit.within:
                    step[1:] |= hs[rest][1:] != hs[rest][:-1]
                docs = np.cumsum(step)
                lengths = np.array([len(texts[i]) for i in rest])
                ends = np.cumsum(lengths)
                data = np.frombuffer(b"".join(texts[i] for i in rest), np.uint8)
                hit = decide(data, np.concatenate([[0], ends]), n[rest], docs, pos[rest])
                bounds = np.concatenate([[0], np.cumsum(n[rest])])
                a, b = spans_of(hit, bounds)
                k = np.searchsorted(bounds, a, side="right") - 1
                first = pos[rest][k] + a - bounds[k]
                out.append((ids[rest][k], hs[rest][k], first, first + (b - a) - 1 + unit.span))
            ids, hs, first, last = merged(*(np.concatenate(x) for x in zip(*out)))
            for i in range(0, len(ids), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[i : i + 100_000]) for x in (ids, hs, first, last)], names=["id", "h", "first", "last"])

        held, size, last_g = [], 0, None
        for batch in batches:
            done = batch.column(7).is_null().to_numpy(zero_copy_only=False)
            if done.any():
                i, h, pos, n = (batch.column(c).to_numpy(zero_copy_only=False)[done] for c in (3, 4, 5, 6))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (i, h, pos, pos + n - 1 + unit.span)], names=["id", "h", "first", "last"])
                batch = batch.filter(pa.array(~done))
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(7)]
            texts = batch.column(7).to_pylist()
            a = 0
            g = cols[0]
            while a < len(g):
                # whole groups only: cut where g changes once enough is held
                if held and size >= chunk_bytes and g[a] != last_g:
                    yield from settle(held)
                    held, size = [], 0
                change = np.flatnonzero(g[a + 1 :] != g[a:-1]) + a + 1
                b = len(g)
                if len(change):
                    sums = np.cumsum([len(t) for t in texts[a:]])
                    over = change[np.searchsorted(sums[change - a - 1], max(0, chunk_bytes - size))] if sums[change[-1] - a - 1] >= chunk_bytes - size else len(g)
                    b = int(over)
                held.append(([c[a:b] for c in cols] + [texts[a:b]]))
                size += sum(map(len, texts[a:b]))
                last_g = g[b - 1]
                a = b
        if held:
            yield from settle(held)

    return fragments.repartition("g").sortWithinPartitions("g").mapInArrow(in_task(run), "id long, h long, first long, last long")


def copies(docs: DataFrame) -> DataFrame:
    """(id, h) of the rows whose whole text also stands in a row with a smaller id."""
    own = docs.select("id", "h", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("sha"))
    first = own.groupBy("sha").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("sha").alias("k"), "first")
    return own.join(first, F.col("sha") == F.col("k")).where("id > first").select("id", "h").distinct()


def repeated_spans(docs: DataFrame, unit: Unit, decide: Callable) -> DataFrame:
    """docs(id long not null, h long, text) -> (id, h, spans array<struct<first,last>>): the codes that repeat.

    A text that is set aside as a copy has the one span [0, WHOLE).
    """
    set_aside = materialize(copies(docs), "copies")
    few = set_aside.count() <= SENT_COPIES
    c = set_aside.select(F.col("id").alias("c_id"), F.col("h").alias("c_h"))
    rest = docs.join(F.broadcast(c) if few else c, (F.col("id") == F.col("c_id")) & (F.col("h") == F.col("c_h")), "left_anti")
    anchors = repeated_anchors(rest.select("id", "text"), unit)
    parts = anchored_fragments(rest.join(anchors, "id").select("id", "h", "text", "anchors"), unit)
    spans = settle_fragments(parts, unit, decide).unionByName(set_aside.select("id", "h", F.lit(0).cast("long").alias("first"), F.lit(WHOLE).alias("last")))
    return spans.groupBy("id", "h").agg(F.collect_list(F.struct("first", "last")).alias("spans"))


def clipped(first: list[int] | None, last: list[int] | None, n: int, span: int) -> list[tuple[int, int]]:
    """The spans of a text of n codes; a copy's span is all of it, or nothing where no window fits in."""
    if not first:
        return []
    if max(last) >= WHOLE:
        return [(0, n)] if n >= span else []
    return sorted(zip(first, last))
