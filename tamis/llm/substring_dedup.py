"""Substring deduplication over words with fixed-block anchors."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamis.llm.common import gram_hash, in_task, ranges_mask, word_hashes, word_spans
from tamis.llm.repeats import Unit, clipped, least_of, repeated_spans

#: Words of a window, and of a reference block: any window holds a whole block, wherever blocks are counted from.
SPAN, BLOCK = 50, 25
#: References that a probed block is extended against one by one; windows that are open then are looked up whole.
ROUNDS = 4


def block_repeats(span: int, block: int, rounds: int = ROUNDS):
    """Whether each window starts in a smaller document: probe the references' blocks, then extend the hits."""

    def decide(data, offsets, n, doc, pos):
        starts, ends, bounds = word_spans(data, offsets)
        codes = word_hashes(data, starts, ends)
        owner = np.repeat(np.arange(len(n)), np.diff(bounds))
        first, last = bounds[owner], bounds[owner + 1]
        grams = gram_hash(codes, block)
        at = np.flatnonzero(np.arange(len(grams)) + block <= last[: len(grams)])
        # index: the blocks that begin at every block-th word of a document, those of smaller documents first
        refs = at[(pos[owner[at]] + at - first[at]) % block == 0]
        refs = refs[np.lexsort((doc[owner[refs]], grams[refs]))]
        keys = grams[refs]
        repeated = np.zeros(len(codes), bool)  # by the first word of a window
        # probe: every rolling block of every document
        hit, nth = at, np.searchsorted(keys, grams[at])
        for _ in range(rounds):
            ok = nth < len(keys)
            hit, nth = hit[ok], nth[ok]
            ok = (keys[nth] == grams[hit]) & (doc[owner[refs[nth]]] < doc[owner[hit]])
            hit, nth = hit[ok], nth[ok]
            # extend the hit word by word to both sides, as far as a window around the block can reach
            ref = refs[nth]
            left, right = np.zeros(len(hit), np.int64), np.zeros(len(hit), np.int64)
            for side, reach, edge in ((-1, left, first), (1, right, last)):
                live = np.arange(len(hit))
                for step in range(1, span - block + 1):
                    shift = -step if side < 0 else block - 1 + step
                    x, y = hit[live] + shift, ref[live] + shift
                    ok = (x >= edge[hit[live]]) & (y >= edge[ref[live]]) if side < 0 else (x < edge[hit[live]]) & (y < edge[ref[live]])
                    ok[ok] = codes[x[ok]] == codes[y[ok]]
                    live = live[ok]
                    reach[live] = step
            whole = left + block + right >= span
            repeated |= ranges_mask(len(codes), (hit - left)[whole], (hit + right + block - span)[whole] + 1)
            # a block goes on to its next reference while some window around it is open
            opened = np.concatenate([[0], np.cumsum(~repeated)])
            low, high = np.maximum(hit - (span - block), first[hit]), np.minimum(hit, last[hit] - span)
            ok = (low <= high) & (opened[np.maximum(high, low) + 1] > opened[low])
            hit, nth = hit[ok], nth[ok] + 1
        windows = np.concatenate([np.arange(a, a + k) for a, k in zip(bounds[:-1], n)]) if len(n) else np.zeros(0, np.int64)
        ok = nth < len(keys)
        hit, nth = hit[ok], nth[ok]
        ok = (keys[nth] == grams[hit]) & (doc[owner[refs[nth]]] < doc[owner[hit]])
        if ok.any():
            # blocks with many surroundings: the whole windows around them are looked up, which extends to all references at once
            near = ranges_mask(len(codes), np.maximum(hit[ok] - (span - block), 0), hit[ok] + 1)[windows]
            own = doc[owner[windows]]
            repeated[windows[near & (least_of([gram_hash(codes, span)[windows]], own) < own)]] = True
        return repeated[windows]

    return decide


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN, block: int = BLOCK, with_text: bool = False) -> DataFrame:
    """Per row of docs: id, n_words, n_removed, kept_sha256 and, with_text, kept_text (kept words joined by one space).

    A word goes if some window of `span` consecutive words that covers it also starts in a document with a smaller id;
    windows are those of the input. Null texts have no words; rows with a null id are compared with nothing and keep all
    their words; rows that repeat an id are no smaller than each other; texts shorter than a window keep all. Other
    columns are not carried. Ids are integers.
    """
    if span < 2 * block - 1:
        raise ValueError("a window must be able to hold a whole block")
    unit = Unit(words=True, span=span, k=max(1, span // 3), within=False)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("h"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    spans = repeated_spans(rows.where("id is not null"), unit, block_repeats(span, block))
    s = spans.select(F.col("id").alias("s_id"), F.col("h").alias("s_h"), F.col("spans.first").alias("a"), F.col("spans.last").alias("b"))
    joined = rows.join(s, (F.col("id") == F.col("s_id")) & (F.col("h") == F.col("s_h")), "left").select("id", "text", "a", "b")

    def cut(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for text, a, b in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
                words = text.encode().split()
                kept = words
                if runs := clipped(a, b, len(words), span):
                    gone = ranges_mask(len(words), *np.array(runs).T)
                    kept = [w for w, g in zip(words, gone.tolist()) if not g]
                shown = b" ".join(kept)
                out.append((len(words), len(words) - len(kept), hashlib.sha256(shown).hexdigest(), shown.decode() if with_text else None))
            cols = list(zip(*out)) if out else [[], [], [], []]
            arrays = [batch.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())]
            names = [id_col, "n_words", "n_removed", "kept_sha256"]
            if with_text:
                arrays.append(pa.array(cols[3], pa.string()))
                names.append("kept_text")
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return joined.mapInArrow(in_task(cut), f"`{id_col}` long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text)
