"""Shared pieces of the training-data operators: where intermediate tables go, and text as flat byte arrays."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from tamis.functions.batches import _PLACED, CHUNK_BYTES, chunks, flat_texts, in_task, join_codes, mix, word_hashes  # noqa: F401

_SEPARATORS = np.zeros(256, dtype=bool)
_SEPARATORS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode (tests) a folder of our own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tamis-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts the lineage and survives a lost executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tamis-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words [^\\x20\\x09-\\x0D]+ and, for each text, the range of its words (n+1 bounds)."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~_SEPARATORS[data]
    before, after = np.ones(n, bool), np.ones(n, bool)
    before[1:] = ~inside[:-1]
    after[:-1] = ~inside[1:]
    before[offsets[:-1][offsets[:-1] < n]] = True
    after[offsets[1:][offsets[1:] > 0] - 1] = True
    starts = np.flatnonzero(inside & before)
    ends = np.flatnonzero(inside & after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


#: Bytes up to which a string is told from others by two numbers, and what to keep of them for each length.
SHORT = 15
_LOW = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1] * 8, np.uint64)
_HIGH = np.array([0] * 9 + [(1 << 8 * k) - 1 for k in range(1, 8)], np.uint64)


class Loads:
    """Eight bytes from any place of a buffer, as a number."""

    def __init__(self, data: np.ndarray):
        padded = np.concatenate([data, np.zeros(16, np.uint8)])
        self.view = np.ndarray((len(data) + 9,), "<u8", padded, strides=(1,))

    def keys(self, at: np.ndarray, size: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
        """Two numbers that tell any strings of up to SHORT bytes apart: their bytes, and their length on top."""
        high = self.view[at + 8] & _HIGH[size]
        return self.view[at] & _LOW[size], high | np.uint64(1 << 56) * np.asarray(size).astype(np.uint64)


def mix_pair(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """One well mixed number of two."""
    h = (low ^ (high * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(29)


def gram_hash(codes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k codes (len(codes) - k + 1 of them, at least none): halves are joined, and halves of those."""
    n = len(codes)
    if n < k:
        return np.zeros(0, np.uint64)
    out, size, power, width = None, 0, codes, 1
    while True:
        if k & width:
            m = n - size - width + 1
            out = power[:m] if out is None else join_codes(out[:m], power[size : size + m])
            size += width
        if 2 * width > k:
            return mix(out)
        m = n - 2 * width + 1
        power, width = join_codes(power[:m], power[width : width + m]), 2 * width


def byte_codes(data: np.ndarray) -> np.ndarray:
    return _PLACED[data]


def sliding(x: np.ndarray, w: int, pick) -> np.ndarray:
    """pick (np.minimum or np.maximum) over every window of w entries."""
    if len(x) < w:
        return x[:0]
    out, k = x, 1
    while 2 * k <= w:
        out = pick(out[:-k], out[k:])
        k *= 2
    if k < w:
        out = pick(out[: len(out) - (w - k)], out[w - k :])
    return out


def ranges_mask(n: int, firsts: np.ndarray, lasts: np.ndarray) -> np.ndarray:
    """Boolean mask of n entries, true in each [first, last)."""
    step = np.zeros(n + 1, np.int64)
    ok = lasts > firsts
    np.add.at(step, firsts[ok], 1)
    np.add.at(step, lasts[ok], -1)
    return np.cumsum(step[:-1]) > 0


def minimizers(grams: np.ndarray, bounds: np.ndarray, k: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Content-chosen positions: for every window of w consecutive grams within one text, the smallest gram.

    bounds are the texts' ranges in codes (a gram starts at each code but the last k-1 of its text). Returns the mask
    of chosen gram positions and, for every position, the smallest gram of the window that starts there (0 where no
    whole window of k+w-1 codes of one text starts). Equal windows have equal choices wherever they stand.
    """
    n = len(grams)
    least = np.zeros(n, np.uint64)
    lows = sliding(grams, w, np.minimum)
    whole = ranges_mask(n, bounds[:-1], np.maximum(bounds[1:] - (k + w - 2), bounds[:-1])) if n else np.zeros(0, bool)
    least[: len(lows)] = lows
    least[~whole] = 0
    padded = np.concatenate([np.zeros(w - 1, np.uint64), least])
    return (sliding(padded, w, np.maximum) == grams) & (grams > 0), least
