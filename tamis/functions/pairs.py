"""Pairs of words that stand near each other, counted and weighed inside tasks over flat arrays.

Words are told by their codes and dealt out to buckets by them; a block is what a task weighs: the pairs of the words of two
buckets, with those buckets' words. A pair is counted once, the word of the smaller code first.
"""

from __future__ import annotations

import numpy as np

from tamis.functions.batches import chunks, counted, flat_texts, in_task, lower_texts, token_spans

#: Pairs that a step sorts, and about as many as a block is meant to hold; words that a step of words holds; rows of a result.
PAIRS, WORDS, ROWS = 1 << 23, 1 << 19, 1 << 16


def bucket_of(codes: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each code; it grows with the code."""
    return (((codes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def block_of(low, high, buckets: int):
    """The number of the block of two buckets, the lower first."""
    return low * buckets - low * (low + 1) // 2 + high


def buckets_for(pairs: int, tasks: int, least: int = 1 << 20) -> int:
    """How many buckets make blocks of about PAIRS pairs, and enough of them for so many tasks unless there are few pairs."""
    blocks = max(-(-pairs // PAIRS), tasks if pairs > least else 1)
    return next(b for b in range(1, blocks + 1) if b * (b + 1) // 2 >= blocks)


def _spelled(data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """An Arrow column of stretches of UTF-8 bytes."""
    import pyarrow as pa

    size = ends - starts
    offsets = np.concatenate([[0], np.cumsum(size)])
    own = data[np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], size)]
    return pa.Array.from_buffers(pa.large_string(), len(size), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(own)])


def words_in_task(window: int):
    """A step over Arrow batches of one text column: rows (code, word, n), and one of a null word for the number of pairs."""

    def merged(parts):
        import pyarrow as pa

        codes, first, place = np.unique(np.concatenate([c for c, _, _ in parts]), return_index=True, return_inverse=True)
        n = np.bincount(place, np.concatenate([n for _, _, n in parts]), len(codes)).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(codes.view(np.int64)), pa.concat_arrays([w for _, w, _ in parts]).take(pa.array(first)).cast(pa.string()), pa.array(n)], names=["code", "word", "n"])

    def run(batches):
        import pyarrow as pa

        parts, held, pairs = [], 0, 0
        for batch in batches:
            for a, b in chunks(flat_texts(batch.column(0))[1]):
                data, offsets = lower_texts(batch.column(0).slice(a, b - a))
                starts, ends, codes, at = token_spans(data, offsets)
                size = np.bincount(at, minlength=b - a)
                far = np.maximum(np.minimum(size, window + 1) - 1, 0)
                pairs += int((far * size - far * (far + 1) // 2).sum())
                if len(codes):
                    codes, first, n = np.unique(codes, return_index=True, return_counts=True)
                    parts.append((codes, _spelled(data, starts[first], ends[first]), n))
                    held += len(codes)
                if held > WORDS:
                    yield merged(parts)
                    parts, held = [], 0
        if parts:
            yield merged(parts)
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int64()), pa.array([None], pa.string()), pa.array([pairs], pa.int64())], names=["code", "word", "n"])

    return in_task(run)


def buckets_in_task(buckets: int):
    """A step over Arrow batches of (code, word, n): rows (bucket, data) of the words of a bucket, see _words_of()."""

    def packed(parts):
        import pyarrow as pa

        codes, words, n = (pa.concat_arrays([p.column(i) for p in parts]) for i in range(3))
        codes, n = codes.to_numpy().view(np.uint64), n.to_numpy()
        order = codes.argsort()
        own = bucket_of(codes[order], buckets)
        data, offsets = flat_texts(words.cast(pa.large_string()).take(pa.array(order)))
        edges = own.searchsorted(np.arange(buckets + 1))
        some = [i for i in range(buckets) if edges[i] < edges[i + 1]]
        out = []
        for i in some:
            a, b = edges[i], edges[i + 1]
            head = np.array([i, b - a], np.int64)
            out.append(b"".join(x.tobytes() for x in (head, codes[order[a:b]], n[order[a:b]], offsets[a : b + 1] - offsets[a], data[offsets[a] : offsets[b]])))
        return pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(out, pa.binary())], names=["bucket", "data"])

    def run(batches):
        parts, held = [], 0
        for batch in batches:
            parts.append(batch)
            held += batch.num_rows
            if held > WORDS:
                yield packed(parts)
                parts, held = [], 0
        if held:
            yield packed(parts)

    return in_task(run)


def _words_of(data: bytes):
    """Bucket, codes, frequencies and words of a row of buckets_in_task()."""
    import pyarrow as pa

    bucket, k = np.frombuffer(data, np.int64, 2)
    codes, n = np.frombuffer(data, np.uint64, k, 16), np.frombuffer(data, np.int64, k, 16 + 8 * k)
    offsets = np.frombuffer(data, np.int64, k + 1, 16 + 16 * k)
    return int(bucket), codes, n, pa.Array.from_buffers(pa.large_string(), int(k), [None, pa.py_buffer(offsets), pa.py_buffer(data[24 + 24 * k :])])


def _blocks(codes: np.ndarray, at: np.ndarray, window: int, buckets: int):
    """(block, data) of the pairs of a run of words of the texts `at`, see _pairs_of(); PAIRS pairs at a time."""
    step = max(PAIRS // window, 1)
    for a in range(0, len(codes), step):
        b = min(a + step, len(codes))
        last = min(b + window, len(codes))
        own, place = np.unique(codes[a:last], return_inverse=True)
        text, home = at[a:last], bucket_of(own, buckets)
        bits = np.int64(max(int(len(own) - 1).bit_length(), 1))
        of_low, of_high = block_of(home, 0, buckets) << (2 * bits) | np.arange(len(own)) << bits, home << (2 * bits) | np.arange(len(own))
        keys = []
        for d in range(1, window + 1):
            m = min(b - a, last - a - d)
            if m <= 0:
                break
            near = text[:m] == text[d : d + m]
            x, y = place[:m][near], place[d : d + m][near]
            keys.append(of_low[np.minimum(x, y)] + of_high[np.maximum(x, y)])
        keys = np.concatenate([np.zeros(0, np.int64), *keys])
        if not len(keys):
            continue
        keys.sort()
        new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        n = np.diff(new, append=len(keys)).astype(np.uint32)
        keys = keys[new]
        block = keys >> (2 * bits)
        low, high = (keys >> bits) & ((1 << bits) - 1), keys & ((1 << bits) - 1)
        edges = np.concatenate([[0], np.flatnonzero(block[1:] != block[:-1]) + 1, [len(block)]])
        mark, number = np.zeros(len(own), bool), np.zeros(len(own), np.uint32)
        for i, j in zip(edges[:-1], edges[1:]):
            sides = []
            for side in (low[i:j], high[i:j]):
                first, end = int(side.min()), int(side.max()) + 1
                mark[first:end] = False
                mark[side] = True
                used = np.flatnonzero(mark[first:end]) + first
                number[used] = np.arange(len(used), dtype=np.uint32)
                sides.append((own[used], number[side]))
            head = np.array([j - i, len(sides[0][0]), len(sides[1][0])], np.int64)
            yield int(block[i]), b"".join(x.tobytes() for x in (head, sides[0][0], sides[1][0], sides[0][1], sides[1][1], n[i:j]))


def _pairs_of(data: bytes):
    """Of a row of _blocks(): the codes of either side's words, of each pair the places of its words there, how often it is met."""
    k, low, high = (int(x) for x in np.frombuffer(data, np.int64, 3))
    at = 24 + 8 * (low + high)
    return np.frombuffer(data, np.uint64, low, 24), np.frombuffer(data, np.uint64, high, 24 + 8 * low), *(np.frombuffer(data, np.uint32, k, at + 4 * k * i) for i in range(3))


def pairs_in_task(window: int, buckets: int):
    """A step over Arrow batches of one text column: rows (block, met, data) of its pairs."""

    def packed(parts):
        import pyarrow as pa

        rows = _blocks(np.concatenate([c for c, _ in parts]), np.concatenate([t for _, t in parts]), window, buckets)
        for block, data in rows:
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([True]), pa.array([data], pa.binary())], names=["block", "met", "data"])

    def run(batches):
        parts, held, texts = [], 0, 0
        for batch in batches:
            for a, b in chunks(flat_texts(batch.column(0))[1]):
                _, _, codes, at = token_spans(*lower_texts(batch.column(0).slice(a, b - a)))
                parts.append((codes, at + texts))
                held, texts = held + len(codes), texts + b - a
                if held * window > PAIRS:
                    yield from packed(parts)
                    parts, held = [], 0
        if held:
            yield from packed(parts)

    return in_task(run)


def weighed_in_task(total: float):
    """A step over the Arrow batches (block, met, data) of one block: rows (word, neighbour, n, pmi) of its pairs from either
    side, of those alone that are met more often than by chance; total is the number of pairs, each from either side."""

    def summed(keys, n):
        width, top = int(keys.max()).bit_length(), int(n.max()).bit_length()
        if width + top > 63:
            return counted(keys, n)
        both = (keys << top) | n
        both.sort()
        keys, n = both >> top, both & ((1 << top) - 1)
        new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        return keys[new], np.add.reduceat(n, new)

    def run(batches):
        import pyarrow as pa

        known, met = {}, []
        for batch in batches:
            for is_met, data in zip(batch.column(1).to_pylist(), batch.column(2)):
                if is_met:
                    met.append(_pairs_of(data.as_py()))
                else:
                    bucket, *words = _words_of(data.as_py())
                    known.setdefault(bucket, []).append(words)
        if not met:
            return
        sides = []
        for bucket in (min(known), max(known)):
            codes, f = (np.concatenate([p[i] for p in known[bucket]]) for i in (0, 1))
            order = codes.argsort()
            sides.append((codes[order], f[order].astype(float), pa.concat_arrays([p[2] for p in known[bucket]]).take(pa.array(order)).cast(pa.string())))
        (low_codes, low_f, low_words), (high_codes, high_f, high_words) = sides
        wide, same = len(high_codes), len(known) == 1
        keys, n = [], []
        while met:
            low, high, i, j, k = met.pop()
            keys.append(low_codes.searchsorted(low)[i] * wide + high_codes.searchsorted(high)[j])
            n.append(k.astype(np.int64))
        keys, n = summed(np.concatenate(keys), np.concatenate(n))
        for a in range(0, len(keys), ROWS):
            low, high = np.divmod(keys[a : a + ROWS], wide)
            own = (low == high) & same
            times = np.where(own, 2, 1) * n[a : a + ROWS]
            pmi = np.floor(np.log2(times * total / (low_f[low] * high_f[high])) * 1e6 + 0.5) / 1e6
            keep = pmi > 0
            low, high, own, times, pmi = low[keep], high[keep], own[keep], times[keep], pmi[keep]
            a_words, b_words, other = low_words.take(pa.array(low)), high_words.take(pa.array(high)), pa.array(np.flatnonzero(~own))
            columns = [pa.concat_arrays([x, y.take(other)]) for x, y in ((a_words, b_words), (b_words, a_words), (pa.array(times), pa.array(times)), (pa.array(pmi), pa.array(pmi)))]
            yield pa.RecordBatch.from_arrays(columns, names=["word", "neighbour", "n", "pmi"])

    return in_task(run)
