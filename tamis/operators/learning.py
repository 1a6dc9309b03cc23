"""Word vectors, subword centroids, neighbours, and how well detectors and vectors do."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamis.functions.batches import chunks, in_task, lower_texts, mix, token_spans
from tamis.functions.text import text_or_empty, tokens

#: Tokens that a task learns word vectors from at a time, and the most words whose codes are sent to tasks (8 bytes each).
BLOCK, SENT_WORDS = 4_000_000, 8_000_000
#: Tokens of one step, negative samples that it shares, how many of them a pair counts for, and the rate to begin with.
STEP, SHARED, NEGATIVES, RATE = 1024, 32, 5, 0.025
#: Steps' worth of pairs by which a word moves at a time, so that frequent words do not overshoot.
MOST_STEPS = 40


def _dealt(docs: DataFrame, least: int) -> DataFrame:
    """The rows in `least` partitions at least, so that few large files are learned from in parallel."""
    return docs if docs.rdd.getNumPartitions() >= least else docs.repartition(least)


def _counted(texts: DataFrame) -> DataFrame:
    """(word, code, n): how often each word stands in all texts."""

    def count(batches):
        import pyarrow as pa

        for batch in batches:
            data, offsets = lower_texts(batch.column(0))
            for a, b in chunks(offsets):
                own = data[offsets[a] : offsets[b]]
                starts, ends, codes, _ = token_spans(own, offsets[a : b + 1] - offsets[a])
                codes, at, n = np.unique(codes, return_index=True, return_counts=True)
                text = own.tobytes()
                words = [text[x:y].decode() for x, y in zip(starts[at].tolist(), ends[at].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(codes.view(np.int64)), pa.array(n.astype(np.int64))], names=["word", "code", "n"])

    return texts.mapInArrow(in_task(count), "word string, code long, n long").groupBy("word", "code").agg(F.sum("n").alias("n"))


def _only_known(texts: DataFrame, known: DataFrame) -> DataFrame:
    """The texts with their known words alone, by a join of every word."""
    each = texts.select(F.monotonically_increasing_id().alias("_row"), F.posexplode(tokens("text")).alias("p", "word"))
    kept = each.join(known.select("word"), "word", "left_semi").groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("p", "word"))).alias("w"))
    return kept.select(F.array_join(F.col("w.word"), " ").alias("text"))


def _begun(codes: np.ndarray, size: int, seed: int) -> np.ndarray:
    """The vectors that words begin with: small random numbers that hang on the word and the seed alone."""
    first = mix(codes ^ np.uint64(seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
    cells = mix(first[:, None] + np.arange(1, size + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return ((cells >> np.uint64(40)).astype(np.float32) / np.float32(1 << 24) - np.float32(0.5)) / np.float32(size)


def _stepped(table: np.ndarray, words: np.ndarray, gradient: np.ndarray, pairs: np.ndarray, rate: float) -> None:
    """Move each word by the sum of what its places say; a word of many pairs moves by MOST_STEPS average ones."""
    order = np.argsort(words, kind="stable")
    kinds, first = np.unique(words[order], return_index=True)
    total = np.add.reduceat(pairs[order], first)
    moves = np.add.reduceat(gradient[order], first, axis=0)
    table[kinds] += moves * (rate * np.minimum(1, MOST_STEPS / np.maximum(total, 1e-9)))[:, None].astype(np.float32)


def _learn(word: np.ndarray, text: np.ndarray, start: np.ndarray, window: int, rounds: int, rng) -> np.ndarray:
    """Vectors of the words 0, 1, ... by skip-gram with negative samples over a block of tokens: word and text by number, in
    order. A pair at a distance d counts (window - d + 1) / window, as if windows were drawn from 1 to window."""
    vectors, context = start.copy(), np.zeros_like(start)
    share = np.cumsum(np.bincount(word, minlength=len(start)) ** 0.75)
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -30, 30)))
    steps = range(0, len(word), STEP)
    for done, at in enumerate([x for _ in range(rounds) for x in steps]):
        w, t = word[at : at + STEP], text[at : at + STEP]
        x, c = vectors[w], context[w]
        gx, gc, pairs = np.zeros_like(x), np.zeros_like(c), np.zeros(len(w), np.float32)
        for d in range(1, min(window, len(w) - 1) + 1):
            on = (t[d:] == t[:-d]).astype(np.float32) * np.float32((window - d + 1) / window)
            for i, j in ((slice(None, -d), slice(d, None)), (slice(d, None), slice(None, -d))):
                g = ((1 - sigmoid(np.einsum("ij,ij->i", x[i], c[j]))) * on)[:, None].astype(np.float32)
                gx[i] += g * c[j]
                gc[j] += g * x[i]
                pairs[i] += on
        other = np.searchsorted(share, rng.random(SHARED) * share[-1], side="right")
        far = context[other]
        g = (-sigmoid(x @ far.T) * (pairs * np.float32(NEGATIVES / SHARED))[:, None]).astype(np.float32)
        rate = RATE * max(1e-4, 1 - done / (rounds * len(steps)))
        _stepped(vectors, w, gx + g @ far, pairs, rate)
        _stepped(context, np.concatenate([w, other]), np.concatenate([gc, g.T @ x]), np.concatenate([pairs, -g.sum(0)]), rate)
    return vectors


def train_word_vectors(docs: DataFrame, size: int = 64, window: int = 5, least: int = 3, rounds: int = 1, partitions: int = 8, seed: int = 42, text_col: str = "text") -> DataFrame:
    """(word, vector) by skip-gram with negative samples over the tokens of all texts, for each word that stands there `least`
    times or more; rarer words are left out before windows are laid.

    Tasks learn from blocks of BLOCK tokens, all from the same beginnings; a word's vector is the mean of what the blocks
    that hold it have found, by its count there. No task holds more than a block's words, and no vector passes the driver.
    The codes of the words go to the tasks, SENT_WORDS at most; beyond that, words are joined."""
    texts = _dealt(docs.select(text_or_empty(text_col).alias("text")), partitions)
    known = _counted(texts).where(F.col("n") >= least)
    codes = known.select("code").limit(SENT_WORDS + 1).toArrow().column(0).to_numpy().view(np.uint64)
    joined = len(codes) > SENT_WORDS
    if joined:
        texts = _only_known(texts, known)
    sent = docs.sparkSession.sparkContext.broadcast(None if joined else np.sort(codes))

    def learn(batches):
        import pyarrow as pa

        known, held, names, n, row = sent.value, [], {}, 0, 0

        def found(parts):
            code, text = (np.concatenate(x) for x in zip(*parts))
            kinds, word, times = np.unique(code, return_inverse=True, return_counts=True)
            vectors = _learn(word, text, _begun(kinds, size, seed), window, rounds, np.random.default_rng(seed))
            for a in range(0, len(kinds), 10_000):
                part = (vectors[a : a + 10_000] * times[a : a + 10_000, None]).astype(np.float32)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * size), pa.array(part.ravel()))
                word_of = pa.array([names[x] for x in kinds[a : a + 10_000].tolist()], pa.string())
                yield pa.RecordBatch.from_arrays([word_of, pa.array(times[a : a + 10_000].astype(np.int64)), flat], names=["word", "n", "sums"])

        for batch in batches:
            data, offsets = lower_texts(batch.column(0))
            for a, b in chunks(offsets):
                own = data[offsets[a] : offsets[b]]
                starts, ends, code, text = token_spans(own, offsets[a : b + 1] - offsets[a])
                if known is not None:
                    at = np.minimum(known.searchsorted(code), max(len(known) - 1, 0))
                    fit = known[at] == code if len(known) else np.zeros(len(code), bool)
                    starts, ends, code, text = starts[fit], ends[fit], code[fit], text[fit]
                kinds, at = np.unique(code, return_index=True)
                raw = own.tobytes()
                for key, x, y in zip(kinds.tolist(), starts[at].tolist(), ends[at].tolist()):
                    if key not in names:
                        names[key] = raw[x:y].decode()
                held.append((code, text + row))
                n, row = n + len(code), row + b - a
                if n >= BLOCK:
                    yield from found(held)
                    held, names, n = [], {}, 0
        if n:
            yield from found(held)

    # words are dealt out before they are added up, as sums of doubles take twice the room of what is added
    parts = texts.mapInArrow(in_task(learn), "word string, n long, sums array<float>").repartition("word")
    mean = F.array(*[F.sum(F.get("sums", F.lit(i))) / F.sum("n") for i in range(size)])
    return parts.groupBy("word").agg(mean.alias("vector"))


def subwords(word: Column) -> Column:
    """The word between < and >, and its distinct runs of three to five characters."""
    whole = F.concat(F.lit("<"), word, F.lit(">"))
    runs = lambda k: F.when(F.length(whole) >= k, F.transform(F.sequence(F.lit(1), F.length(whole) - (k - 1)), lambda i: F.substring(whole, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.array(whole), runs(3), runs(4), runs(5)))


def _mean(c: str, width: int) -> Column:
    return F.array(*[F.avg(F.get(c, F.lit(i))) for i in range(width)])


def subword_centroids(vectors: DataFrame, width: int, least: int = 5) -> DataFrame:
    """(sub, words, centroid): mean vector of the words that hold each subword, of at least `least` words."""
    rows = vectors.select("vector", F.explode(subwords(F.col("word"))).alias("sub"))
    return rows.groupBy("sub").agg(F.count("*").alias("words"), _mean("vector", width).alias("centroid")).where(F.col("words") >= least)


def unknown_vectors(words: DataFrame, centroids: DataFrame, width: int, most: int = 40) -> DataFrame:
    """(word, vector): mean of the centroids of a word's specific subwords (of `most` words or fewer); null if it has none."""
    parts = words.select("word").distinct().select("word", F.explode(subwords(F.col("word"))).alias("sub"))
    met = parts.join(centroids.where(F.col("words") <= most).select("sub", "centroid"), "sub")
    found = met.groupBy(F.col("word").alias("_w")).agg(_mean("centroid", width).alias("vector"))
    return words.select("word").distinct().join(found, F.col("word") == F.col("_w"), "left").select("word", "vector")


def neighbour_recall(neighbours: DataFrame, vectors: DataFrame, id_col: str = "vec_id", label_col: str = "label") -> DataFrame:
    """One row: queries, and the share of them with a neighbour of their own label."""
    a = vectors.select(F.col(id_col).alias("query_id"), F.col(label_col).alias("x"))
    b = vectors.select(F.col(id_col).alias("_n"), F.col(label_col).alias("y"))
    hit = neighbours.join(a, "query_id").join(b, F.col(id_col) == F.col("_n")).groupBy("query_id").agg(F.max((F.col("x") == F.col("y")).cast("int")).alias("hit"))
    return hit.agg(F.count("*").alias("queries"), F.round(F.avg("hit"), 6).alias("recall"))


def corpus_hash(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """One row: a SHA-256 of the corpus that does not hang on the order of its rows; hashed in 4,096 parts, then over those."""
    each = docs.select(F.sha2(F.coalesce(text_col, F.lit("")), 256).alias("h"))
    parts = each.groupBy(F.substring("h", 1, 3).alias("p")).agg(F.sha2(F.array_join(F.sort_array(F.collect_list("h")), ""), 256).alias("h"))
    return parts.agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("p", "h"))), lambda x: x["h"]), ""), 256).alias("corpus_sha"))


def scorecard(judged: DataFrame, by: str | None = None) -> DataFrame:
    """judged(predicted, actual) -> tp, fp, tn, fn, precision, recall, f1, by a column if asked for."""
    p, a = F.col("predicted"), F.col("actual")
    counts = [F.count_if(p & a).alias("tp"), F.count_if(p & ~a).alias("fp"), F.count_if(~p & ~a).alias("tn"), F.count_if(~p & a).alias("fn")]
    g = judged.groupBy(by).agg(*counts) if by else judged.agg(*counts)
    share = lambda x, y: F.when(y > 0, F.round(x / y, 6)).otherwise(0.0)
    return g.withColumn("precision", share(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", share(F.col("tp"), F.col("tp") + F.col("fn"))).withColumn("f1", share(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")))
