"""Byte-level deduplication: suffixes sorted by the difference-cover method, then adjacent prefixes compared."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamis.llm.common import in_task

from tamis.llm.repeats import Unit, clipped, repeated_spans

#: Bytes of the strings that are compared, and of an anchor.
SPAN, ANCHOR = 100, 32
_ROWS = 20_000


def _names(keys: np.ndarray) -> tuple[np.ndarray, int]:
    """Dense ranks from 1, and how many there are."""
    found, back = np.unique(keys, return_inverse=True)
    return back.astype(np.int64) + 1, len(found)


def suffix_order(codes: np.ndarray) -> np.ndarray:
    """Starts of all suffixes of codes (positive integers) in ascending order, by the difference cover {1, 2} modulo 3."""
    n = len(codes)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: codes[i:].tolist()), np.int64)
    s = np.zeros(n + 4, np.int64)
    s[:n] = codes
    # sort the triples at the sampled positions; names are their ranks
    sampled = np.concatenate([np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)])
    pair, _ = _names(s[sampled] * (int(s.max()) + 1) + s[sampled + 1])
    name, kinds = _names(pair * (int(s.max()) + 1) + s[sampled + 2])
    rank = np.zeros(n + 4, np.int64)
    if kinds == len(sampled):
        rank[sampled] = name
    else:  # recurse on the names: first the positions 1 modulo 3, then those 2 modulo 3
        order = suffix_order(name)
        rank[sampled[order]] = np.arange(1, len(order) + 1)
    by_rank = sampled[np.argsort(rank[sampled])]
    by_rank = by_rank[by_rank < n]
    # the remaining suffixes: a code, then a sampled suffix
    others = np.arange(0, n, 3)
    big = int(rank.max()) + 2
    others = others[np.argsort(s[others] * big + rank[others + 1], kind="stable")]
    # merge: count the sampled suffixes before each other one, by residue
    ones, twos = by_rank[by_rank % 3 == 1], by_rank[by_rank % 3 == 2]
    before = np.searchsorted(s[ones] * big + rank[ones + 1], s[others] * big + rank[others + 1])
    two, _ = _names(np.concatenate([s[twos] * (int(s.max()) + 1) + s[twos + 1], s[others] * (int(s.max()) + 1) + s[others + 1]]))
    before += np.searchsorted(two[: len(twos)] * big + rank[twos + 2], two[len(twos) :] * big + rank[others + 2])
    out = np.empty(n, np.int64)
    at = before + np.arange(len(others))
    taken = np.zeros(n, bool)
    taken[at] = True
    out[at] = others
    out[~taken] = by_rank
    return out


def prefix_repeats(span: int):
    """Whether each window of span bytes starts earlier: sort the suffixes, compare neighbours' prefixes."""

    def decide(data, offsets, n, doc, pos):
        total = int(n.sum())
        owner = np.repeat(np.arange(len(n)), n)
        first = np.cumsum(n) - n
        start = offsets[owner] + np.arange(total) - first[owner]
        window = np.full(len(data), -1, np.int64)
        window[start] = np.arange(total)
        order = window[suffix_order(data.astype(np.int64) + 1)]
        order = order[order >= 0]
        a = start[order]
        same = np.zeros(len(order), bool)
        reach = np.arange(span)
        for i in range(1, len(order), _ROWS):
            j = slice(i, i + _ROWS)
            same[j] = (data[a[j][:, None] + reach] == data[a[i - 1 : i - 1 + len(a[j])][:, None] + reach]).all(axis=1)
        lead = np.flatnonzero(~same)
        when = doc[owner[order]] << 40 | (pos[owner[order]] + order - first[owner[order]])
        least = np.minimum.reduceat(when, lead) if len(when) else when
        out = np.zeros(total, bool)
        out[order] = when > np.repeat(least, np.diff(np.concatenate([lead, [len(order)]])))
        return out

    return decide


def dedup_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN, anchor: int = ANCHOR, with_text: bool = False) -> DataFrame:
    """Per row of docs: id, n_bytes, n_removed, n_spans, kept_sha256 and, with_text, kept_bytes.

    A byte goes if some string of `span` bytes that covers it also starts earlier: in a document with a smaller id, or
    before in the same document; overlaps count and strings are those of the input. Null texts are empty; rows with a
    null id are compared with nothing and keep all; rows that repeat both id and text are one document, other rows of
    one id go by the hash of their text. Other columns are not carried. Ids are integers.

    Suffixes are sorted where they may matter: the fragments of one anchor (see repeats) meet in one task, which sorts
    their suffixes by the difference-cover method and compares the first span bytes of neighbours.
    """
    unit = Unit(words=False, span=span, k=anchor, within=True)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("h"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    spans = repeated_spans(rows.where("id is not null"), unit, prefix_repeats(span))
    s = spans.select(F.col("id").alias("s_id"), F.col("h").alias("s_h"), F.col("spans.first").alias("a"), F.col("spans.last").alias("b"))
    joined = rows.join(s, (F.col("id") == F.col("s_id")) & (F.col("h") == F.col("s_h")), "left").select("id", "text", "a", "b")

    def cut(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for text, a, b in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
                raw = text.encode()
                runs: list[list[int]] = []
                for x, y in clipped(a, b, len(raw), span):
                    if runs and x <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], y)
                    else:
                        runs.append([x, y])
                edges = [0, *(e for r in runs for e in r), len(raw)]
                kept = b"".join(raw[x:y] for x, y in zip(edges[::2], edges[1::2])) if runs else raw
                out.append((len(raw), len(raw) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), kept if with_text else None))
            cols = list(zip(*out)) if out else [[]] * 5
            arrays = [batch.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())]
            names = [id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if with_text:
                arrays.append(pa.array(cols[4], pa.binary()))
                names.append("kept_bytes")
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return joined.mapInArrow(in_task(cut), f"`{id_col}` long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_bytes binary" * with_text)
