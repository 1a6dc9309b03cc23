"""The retrieval store: term postings, document frequencies, BM25, co-occurrence, dense neighbours."""

from __future__ import annotations

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from tamis.functions.batches import chunks, codes_of, flat_texts, in_task, lower_texts, token_spans
from tamis.functions.pairs import buckets_for, buckets_in_task, pairs_in_task, weighed_in_task, words_in_task
from tamis.functions.text import tokens

#: Up to so many different words of the queries are broadcast; so many queries go to the tasks at a time.
SENT_TERMS, SENT_QUERIES = 200_000, 20_000


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(term, id, tf)."""
    return docs.select(id_col, F.explode(tokens(text_col)).alias("term")).groupBy("term", id_col).agg(F.count("*").alias("tf"))


def inverse_frequencies(posted: DataFrame, n_docs: int) -> DataFrame:
    """(term, df, idf) with the BM25 form ln((N - df + 0.5) / (df + 0.5) + 1)."""
    df = posted.groupBy("term").agg(F.count("*").alias("df"))
    return df.withColumn("idf", F.log((F.lit(float(n_docs)) - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1))


def met_terms(docs: DataFrame, terms: list[str], id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(term, id, len, tf) of the texts that hold some of the terms, and one row: n, mean, of the lengths of all texts in tokens."""
    codes = codes_of(terms)
    order = codes.argsort()
    sent = docs.sparkSession.sparkContext.broadcast((codes[order], [terms[i] for i in order]))

    def sizes(batches):
        import pyarrow as pa

        for batch in batches:
            for a, b in chunks(flat_texts(batch.column(0))[1]):
                n = len(token_spans(*lower_texts(batch.column(0).slice(a, b - a)))[0])
                yield pa.RecordBatch.from_arrays([pa.array([b - a], pa.int64()), pa.array([n], pa.int64())], names=["n", "size"])

    def find(batches):
        import pyarrow as pa

        codes, terms = sent.value
        names = pa.array(terms, pa.string())
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for a, b in chunks(flat_texts(texts)[1]):
                _, _, own, at = token_spans(*lower_texts(texts.slice(a, b - a)))
                size = np.bincount(at, minlength=b - a)
                place = np.minimum(codes.searchsorted(own), max(len(codes) - 1, 0))
                hit = codes[place] == own if len(codes) else np.zeros(len(own), bool)
                key, tf = np.unique(at[hit] * max(len(codes), 1) + place[hit], return_counts=True)
                row, term = key // max(len(codes), 1), key % max(len(codes), 1)
                columns = [ids.slice(a, b - a).take(pa.array(row)), pa.array(size[row].astype(np.int32)), names.take(pa.array(term)), pa.array(tf.astype(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, names=[id_col, "len", "term", "tf"])

    kinds = StructType([docs.schema[id_col], StructField("len", IntegerType()), StructField("term", StringType()), StructField("tf", LongType())])
    posted = docs.select(id_col, text_col).mapInArrow(in_task(find), kinds).groupBy("term", id_col, "len").agg(F.sum("tf").alias("tf"))
    whole = docs.select(text_col).mapInArrow(in_task(sizes), "n long, size long").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), (F.sum("size") / F.sum("n")).alias("mean"))
    return posted, whole


def text_sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, len): tokens of every row's text."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for a, b in chunks(flat_texts(texts)[1]):
                size = np.bincount(token_spans(*lower_texts(texts.slice(a, b - a)))[3], minlength=b - a)
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array(size.astype(np.int32))], names=[id_col, "len"])

    return docs.select(id_col, text_col).mapInArrow(in_task(run), StructType([docs.schema[id_col], StructField("len", IntegerType())]))


def bm25_search(docs: DataFrame, queries: DataFrame, k: int = 10, k1: float = 1.5, b: float = 0.75, id_col: str = "doc_id", text_col: str = "text", query_col: str = "item_id", query_text_col: str = "text") -> DataFrame:
    """(query, rank, id, score): the k best documents of every query; a query's repeated words count repeatedly.

    Words that no query holds are dropped before anything is shuffled, in the task that reads the text, or, beyond SENT_TERMS
    of them, by a join.
    """
    q = queries.select(F.col(query_col).alias("query_id"), F.explode(tokens(query_text_col)).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qn"))
    terms = q.select("term").distinct()
    asked = terms.limit(SENT_TERMS + 1).toArrow().column(0).to_pylist()
    if len(asked) <= SENT_TERMS:
        posted, whole = met_terms(docs, asked, id_col, text_col)
    else:
        rows = docs.select(id_col, tokens(text_col).alias("w")).select(id_col, "w", F.size("w").alias("len"))
        whole = rows.agg(F.count("*").alias("n"), F.avg("len").alias("mean"))
        posted = rows.select(id_col, "len", F.explode("w").alias("term")).join(terms, "term", "left_semi").groupBy("term", id_col, "len").agg(F.count("*").alias("tf"))
    whole = whole.first()
    hits = posted.join(inverse_frequencies(posted, whole.n), "term").join(q, "term")
    part = F.col("qn") * F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.lit(whole.mean)))
    score = hits.groupBy("query_id", id_col).agg(F.round(F.sum(part), 4).alias("score"))
    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), id_col)
    return score.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k)


def _met(docs: DataFrame, window: int, text_col: str) -> DataFrame:
    """(a, b, n): how often two words, a before b in their order or both equal, stand within `window` tokens."""
    w = docs.select(tokens(text_col).alias("w"))
    ahead = lambda w, d: F.zip_with(F.slice(w, F.lit(1), F.size(w) - d), F.slice(w, d + 1, F.size(w) - d), lambda x, y: F.struct(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")))
    steps = lambda w: F.when(F.size(w) > 1, F.sequence(F.lit(1), F.least(F.size(w) - 1, F.lit(window))))
    # an array of arrays, so that no filter of empty ones works the pairs out a second time
    pairs = F.transform(F.array("w"), lambda w: F.flatten(F.transform(steps(w), lambda d: ahead(w, d))))
    return w.select(F.explode(pairs).alias("p")).select(F.explode("p").alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("n"))


def _both_ways(met: DataFrame) -> DataFrame:
    """Rows of _met as (word, neighbour, ...), each pair from either side; a word met by itself is one row of twice the count."""
    same, rest = F.col("a") == F.col("b"), [c for c in met.columns if c not in ("a", "b", "n")]
    one = lambda x, y: F.struct(F.col(x).alias("word"), F.col(y).alias("neighbour"))
    sides = F.explode(F.when(same, F.array(one("a", "b"))).otherwise(F.array(one("a", "b"), one("b", "a")))).alias("p")
    return met.select(sides, F.when(same, F.col("n") * 2).otherwise(F.col("n")).alias("n"), *rest).select("p.word", "p.neighbour", "n", *rest)


def cooccurrence(docs: DataFrame, window: int = 5, text_col: str = "text") -> DataFrame:
    """(word, neighbour, n): how often a word stands within `window` tokens of another."""
    return _both_ways(_met(docs, window, text_col))


def pmi(docs: DataFrame, window: int = 5, text_col: str = "text") -> DataFrame:
    """(word, neighbour, n, pmi) with positive pointwise mutual information; both shares are of the number of pairs.

    Words are told by 64-bit codes. Tasks count the pairs of their texts and deal them out in blocks, the pairs of the words of
    two buckets; a block's pairs are added up and weighed by one task, beside the words of those buckets."""
    texts, spark = docs.select(text_col), docs.sparkSession
    words = texts.mapInArrow(words_in_task(window), "code long, word string, n long").groupBy("code", "word").agg(F.sum("n").alias("n")).persist(StorageLevel.DISK_ONLY)
    pairs = words.where("word is null").agg(F.sum("n")).first()[0] or 0
    buckets = buckets_for(pairs, 2 * spark.sparkContext.defaultParallelism)
    block = lambda low, high: F.shiftright(low * (2 * buckets - 1 - low), 1) + high  # noqa: E731 (block_of)
    every = F.sequence(F.lit(0).cast("long"), F.lit(buckets - 1).cast("long"))
    each = F.explode(F.transform(every, lambda k: block(F.least("bucket", k), F.greatest("bucket", k)))).alias("block")
    known = words.where("word is not null").mapInArrow(buckets_in_task(buckets), "bucket long, data binary").select(each, F.lit(False).alias("met"), "data")
    rows = known.unionByName(texts.mapInArrow(pairs_in_task(window, buckets), "block long, met boolean, data binary"))
    blocks = rows.repartitionById(buckets * (buckets + 1) // 2, F.col("block").cast("int"))
    return blocks.mapInArrow(weighed_in_task(float(2 * pairs or 1)), "word string, neighbour string, n long, pmi double")


def related_words(docs: DataFrame, k: int = 10, window: int = 5, text_col: str = "text") -> DataFrame:
    """(word, rank, neighbour, pmi): the k most related words of every word."""
    rank = Window.partitionBy("word").orderBy(F.desc("pmi"), "neighbour")
    return pmi(docs, window, text_col).withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k).select("word", "rank", "neighbour", "pmi")


def dense_search(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, id, score): the k nearest other rows by cosine (in double precision) of a stated query set.

    The queries go to the tasks in blocks of SENT_QUERIES at most; a task multiplies its rows with a block and keeps the k
    best of each query, so that no pair beyond those is shuffled. Null vectors and those without length are near nothing."""
    import numpy as np

    def matrix(column):
        sizes = np.diff(column.offsets.to_numpy())
        wide = int(sizes.max()) if len(sizes) else 0
        x = np.zeros((len(column), wide))
        ok = sizes == wide
        if wide and ok.any():
            x[ok] = column.filter(pa_array(ok)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, wide)
        norm = np.linalg.norm(x, axis=1)
        return x / np.where(norm > 0, norm, 1)[:, None], norm > 0

    def pa_array(x):
        import pyarrow as pa

        return pa.array(x)

    spark = vectors.sparkSession
    rows = vectors.where(F.col(vector_col).isNotNull() & F.col(id_col).isNotNull()).select(id_col, vector_col)
    asked = queries.where(F.col(vector_col).isNotNull() & F.col(id_col).isNotNull()).select(id_col, vector_col)
    blocks = max(1, -(-asked.count() // SENT_QUERIES))
    out = None
    for block in range(blocks):
        part = asked.where(F.pmod(F.xxhash64(id_col), F.lit(blocks)) == block).toArrow()
        ids = part.column(0).to_numpy()
        q, q_ok = matrix(part.column(1).combine_chunks()) if len(ids) else (np.zeros((0, 0)), np.zeros(0, bool))
        sent = spark.sparkContext.broadcast((ids[q_ok], q[q_ok]))

        def best(batches):
            import pyarrow as pa

            ids, q = sent.value
            for batch in batches:
                if not batch.num_rows or not len(ids):
                    continue
                own = batch.column(0).to_numpy()
                x, ok = matrix(batch.column(1))
                own, x = own[ok], x[ok]
                if x.shape[1] != q.shape[1]:
                    continue
                found = []
                for a in range(0, len(q), 256):
                    scores = np.round(x @ q[a : a + 256].T, 6)
                    for j in range(scores.shape[1]):
                        at = np.flatnonzero(own != ids[a + j])
                        s = scores[at, j]
                        if len(s) > k:
                            near = s >= np.partition(s, len(s) - k)[len(s) - k]
                            at, s = at[near], s[near]
                        order = np.lexsort((own[at], -s))[:k]
                        found.append((np.full(len(order), ids[a + j]), own[at][order], s[order]))
                columns = [np.concatenate(c) for c in zip(*found)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query_id", "id", "score"])

        met = rows.mapInArrow(best, f"query_id long, `{id_col}` long, score double")
        out = met if out is None else out.unionByName(met)
    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), id_col)
    return out.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k)
