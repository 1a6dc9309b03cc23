"""Texts inside tasks, as flat byte arrays: their words, as tokens() has them, and the words' codes."""

from __future__ import annotations

import ctypes
import gc

import numpy as np

from tamis.functions.text import STOP_WORDS

#: Bytes of text that one vectorised step holds; a longer text is a step of its own.
CHUNK_BYTES = 1 << 20

_PLACES = 64
_PLACED = np.random.default_rng(20240229).integers(0, 2**64, 256 * _PLACES, dtype=np.uint64)

#: Bytes that words are made of, but for those of Hangul.
_LETTERS = np.zeros(256, dtype=bool)
_LETTERS[np.frombuffer(b"abcdefghijklmnopqrstuvwxyz0123456789-", np.uint8)] = True


def in_task(run):
    """run, a generator over Arrow batches, that gives freed memory back to the machine when its task ends: the Python
    workers outlive their tasks, and what they keep counts against the executor."""

    def task(batches):
        import pyarrow as pa

        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # not every C library has it
                pass

    return task


def flat_texts(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n+1 offsets of an Arrow string column, without copying; null counts as empty."""
    import pyarrow as pa

    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        column, kind = column.cast(pa.string()), np.int32
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    if offsets is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES):
    """(first, last) row ranges that hold about limit bytes each."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that near sums do not stay near."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(32)
    return h


def join_codes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One code for a then b; not linear, so that no pattern of letters cancels out as in sums of powers modulo 2**64."""
    h = a * np.uint64(0x9E3779B97F4A7C15) + b
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of every word: each byte at its place within the word stands for a random number; their sum and the length are
    mixed. Numbers come from a table for the first _PLACES bytes and are mixed anew for each further stretch of as many."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    size = ends - starts
    stop = np.cumsum(size)
    place = np.arange(int(stop[-1])) - np.repeat(stop - size, size)
    value = _PLACED[(place & (_PLACES - 1)) << 8 | data[place + np.repeat(starts, size)]]
    if int(size.max()) > _PLACES:
        far = np.flatnonzero(place >= _PLACES)
        value[far] = mix(value[far] + (place[far] >> 6).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(value, dtype=np.uint64)])
    return mix(sums[stop] - sums[stop - size] + size.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


def lower_texts(column) -> tuple[np.ndarray, np.ndarray]:
    """flat_texts() in lower case."""
    import pyarrow as pa
    import pyarrow.compute as pc

    data, offsets = flat_texts(column)
    if b"\xc4\xb0" in data.tobytes():  # one letter that becomes two, of which the second ends a word
        return flat_texts(pa.array([(x or "").lower() for x in column.to_pylist()], pa.large_string()))
    return (data, offsets) if not len(data) else flat_texts(pc.utf8_lower(column))


def token_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends, codes and texts (by number) of the words that tokens() has of texts in lower case, in order."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    inside = _LETTERS[data]
    lead = np.flatnonzero((data >= 0xEA) & (data <= 0xED))
    if len(lead):
        a, b, c = data[lead], data[lead + 1], data[lead + 2]
        lead = lead[((a > 0xEA) | (b >= 0xB0)) & ((a < 0xED) | (b < 0x9E) | ((b == 0x9E) & (c <= 0xA3)))]
        for i in range(3):
            inside[lead + i] = True
    before, after = np.ones(n, bool), np.ones(n, bool)
    before[1:] = ~inside[:-1]
    after[:-1] = ~inside[1:]
    before[offsets[:-1][offsets[:-1] < n]] = True
    after[offsets[1:][offsets[1:] > 0] - 1] = True
    starts, ends = np.flatnonzero(inside & before), np.flatnonzero(inside & after) + 1
    size = ends - starts
    long = (size > 1) & ~((size == 3) & (data[starts] >= 0xEA))
    starts, ends = starts[long], ends[long]
    codes = word_hashes(data, starts, ends)
    at = np.minimum(np.searchsorted(_STOP, codes), len(_STOP) - 1)
    kept = _STOP[at] != codes
    starts, ends, codes = starts[kept], ends[kept], codes[kept]
    return starts, ends, codes, np.searchsorted(offsets, starts, side="right") - 1


#: Letters from common to rare; whatever else is rarer.
_COMMON = {ord(c): i for i, c in enumerate(" etaoinsrhldcumfpgwybvkxjqz")}


class Finder:
    """Which of some strings texts hold. Of each string of four bytes or more its rarest four are looked for, all strings' at
    once; the whole string, and shorter ones, only where those are found."""

    def __init__(self, strings):
        self.strings = [s.encode() for s in strings]
        self.short = [i for i, s in enumerate(self.strings) if len(s) < 4]
        of: dict[int, list[int]] = {}
        for i, s in enumerate(self.strings):
            if len(s) >= 4:
                rare = max((s[a : a + 4] for a in range(len(s) - 3)), key=lambda g: sum(_COMMON.get(c, 40) for c in g))
                of.setdefault(int.from_bytes(rare, "little"), []).append(i)
        self.grams = np.array(sorted(of), np.uint32)
        self.own = [of[int(g)] for g in self.grams]
        self.table = np.zeros(1 << 16, bool)
        self.table[self._place(self.grams)] = True

    @staticmethod
    def _place(grams: np.ndarray) -> np.ndarray:
        return (grams * np.uint32(0x9E3779B1)) >> np.uint32(16)

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> list[list[int]]:
        """The numbers of the strings that each text holds, in order."""
        texts = [data[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:])]
        found = [[i for i in self.short if self.strings[i] in t] for t in texts]
        if len(data) >= 4 and len(self.grams):
            wide = data.astype(np.uint32)
            grams = wide[:-3] | wide[1:-2] << np.uint32(8) | wide[2:-1] << np.uint32(16) | wide[3:] << np.uint32(24)
            at = np.flatnonzero(self.table[self._place(grams)])
            place = np.minimum(self.grams.searchsorted(grams[at]), len(self.grams) - 1)
            hit = self.grams[place] == grams[at]
            at, place = at[hit], place[hit]
            for key in np.unique((np.searchsorted(offsets, at, side="right") - 1) * len(self.grams) + place).tolist():
                row, place = divmod(key, len(self.grams))
                found[row] += [i for i in self.own[place] if self.strings[i] in texts[row]]
        return [sorted(f) for f in found]


def codes_of(words: list[str]) -> np.ndarray:
    """The codes that token_spans() has for words."""
    raw = [w.encode() for w in words]
    ends = np.cumsum([len(w) for w in raw], dtype=np.int64)
    return word_hashes(np.frombuffer(b"".join(raw), np.uint8), ends - [len(w) for w in raw], ends)


def counted(codes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different codes and the sums of their numbers."""
    codes, place = np.unique(codes, return_inverse=True)
    return codes, np.bincount(place, n, len(codes)).astype(np.int64)


_STOP = np.sort(codes_of(STOP_WORDS))
