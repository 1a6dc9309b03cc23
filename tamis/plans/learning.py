"""Registered queries on word vectors, neighbours, scorecards and sources, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tamis.functions.normalize import normalize_corpus
from tamis.functions.text import tokens
from tamis.operators import injection as inj, learning as ln, store
from tamis.plans import derived_sql as ds
from tamis.functions import injection_rules as ir
from tamis.plans.injection import _scan_sql
from tamis.sources import derived
from tamis.sources.tables import added_lines, table

WIDTH, LEAST = 64, 20


def _words(s, f):
    """Frequent words of documents, each with the embedding that the MD5 of the word points to."""
    w = table(s, f, "documents").select(F.explode(tokens("text")).alias("word")).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST)
    e = table(s, f, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vector"))
    return w.withColumn("k", F.conv(F.substring(F.md5("word"), 1, 6), 16, 10).cast("long") % F.lit(e.count())).join(e, F.col("k") == F.col("vec_id")).select("word", "vector")


def _components(rows, c):
    """A row for each component of vector c; a null vector is one row. Zeros are positive."""
    keys = [k for k in rows.columns if k != c]
    return rows.select(*keys, F.posexplode_outer(c).alias("pos", "value")).withColumn("value", F.round("value", 5) + F.lit(0.0))


def _unknown(s, f):
    q = table(s, f, "benchmark").select(F.explode(tokens("text")).alias("word")).distinct()
    return ln.unknown_vectors(q, ln.subword_centroids(_words(s, f), WIDTH), WIDTH)


def _neighbours(s, f):
    v = table(s, f, "embeddings")
    return store.dense_search(v, v.where("vec_id % 100 = 0"), 10)


def _judged(s, f):
    d = derived.inbox(table(s, f, "documents"))
    return inj.injected(d).select("lang", F.col("injected").alias("predicted"), (F.col("doc_id") % len(derived.PHRASES) % 2 == 0).alias("actual"))


def _patches(s, f):
    files = derived.source_files(table(s, f, "documents"))
    lines = F.split("content", "\n")
    return files.select(F.col("path").alias("commit"), F.concat(F.lit("--- /dev/null\n+++ b/"), "path", F.lit("\n@@ -0,0 +1,"), F.size(lines).cast("string"), F.lit(" @@\n+"), F.array_join(lines, "\n+")).alias("patch"))


QUERIES = {
    "nrm_corpus": lambda s, f: normalize_corpus(derived.inbox(table(s, f, "documents"))).select("doc_id", F.sha2("normalized", 256).alias("sha"), "transforms"),
    "emb_word_vectors": lambda s, f: ln.train_word_vectors(table(s, f, "documents")).select("word", F.size("vector").alias("width")),
    "emb_subwords": lambda s, f: _components(ln.subword_centroids(_words(s, f), WIDTH), "centroid"),
    "emb_unknown": lambda s, f: _components(_unknown(s, f), "vector"),
    "emb_recall": lambda s, f: ln.neighbour_recall(_neighbours(s, f), table(s, f, "embeddings")),
    "emb_corpus_hash": lambda s, f: ln.corpus_hash(table(s, f, "documents")),
    "emb_scorecard": lambda s, f: ln.scorecard(_judged(s, f), "lang"),
    "src_added_lines": lambda s, f: added_lines(_patches(s, f)).select("file", "line_no", "line"),
}

_SUBS = "list_distinct(list_concat(['<' || word || '>'], flatten(list_transform([3, 4, 5], lambda k: list_transform(range(1, greatest(length(word) + 2 - k + 1, 0) + 1), lambda i: substr('<' || word || '>', i, k))))))"
_VECTORS = f"wv AS (SELECT word, CAST(embedding AS DOUBLE[]) AS vector FROM (SELECT word, CAST('0x' || substr(md5(word), 1, 6) AS BIGINT) % (SELECT count(*) FROM embeddings) AS k FROM (SELECT unnest({ds.words('text')}) AS word FROM documents) GROUP BY word HAVING count(*) >= {LEAST}) JOIN embeddings ON vec_id = k)"
_MEAN = lambda c: "[" + ", ".join(f"avg({c}[{i + 1}])" for i in range(WIDTH)) + "]"
_CENTROIDS = f"{_VECTORS}, cen AS (SELECT sub, count(*) AS words, {_MEAN('vector')} AS centroid FROM (SELECT vector, unnest({_SUBS}) AS sub FROM wv) GROUP BY sub HAVING count(*) >= 5)"

ORACLE = {
    "emb_subwords": f"WITH {_CENTROIDS} SELECT sub, words, CAST(unnest(range({WIDTH})) AS INTEGER) AS pos, round(unnest(centroid), 5) + 0.0 AS value FROM cen",
    "emb_unknown": f"WITH {_CENTROIDS}, q AS (SELECT DISTINCT unnest({ds.words('text')}) AS word FROM benchmark), m AS (SELECT word, {_MEAN('centroid')} AS vector FROM (SELECT word, unnest({_SUBS}) AS sub FROM q) JOIN cen USING (sub) WHERE words <= 40 GROUP BY word) SELECT word, CAST(unnest(range({WIDTH})) AS INTEGER) AS pos, round(unnest(vector), 5) + 0.0 AS value FROM m UNION ALL SELECT word, NULL, NULL FROM q WHERE word NOT IN (SELECT word FROM m)",
    "emb_recall": "WITH s AS (SELECT q.vec_id AS query_id, q.label = v.label AS same, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 6) DESC, v.vec_id) AS r FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0), h AS (SELECT query_id, max(CAST(same AS INT)) AS hit FROM s WHERE r <= 10 GROUP BY 1) SELECT count(*) AS queries, round(avg(hit), 6) AS recall FROM h",
    "emb_corpus_hash": "WITH e AS (SELECT sha256(coalesce(text, '')) AS h FROM documents), p AS (SELECT substr(h, 1, 3) AS p, sha256(string_agg(h, '' ORDER BY h)) AS h FROM e GROUP BY 1) SELECT sha256(string_agg(h, '' ORDER BY p)) AS corpus_sha FROM p",
    "emb_scorecard": f"WITH {ds.INBOX}, {_scan_sql(ir.RULES)}, j AS (SELECT lang, doc_id IN (SELECT doc_id FROM found) AS p, doc_id % {len(derived.PHRASES)} % 2 = 0 AS a FROM inbox), g AS (SELECT lang, count_if(p AND a) AS tp, count_if(p AND NOT a) AS fp, count_if(NOT p AND NOT a) AS tn, count_if(NOT p AND a) AS fn FROM j GROUP BY 1) SELECT *, CASE WHEN tp + fp > 0 THEN round(tp / (tp + fp), 6) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN round(tp / (tp + fn), 6) ELSE 0 END AS recall, CASE WHEN tp + fp + fn > 0 THEN round(2 * tp / (2 * tp + fp + fn), 6) ELSE 0 END AS f1 FROM g",
    "src_added_lines": f"WITH {ds.FILES} SELECT path AS file, CAST(unnest(range(1, len(ls) + 1)) AS BIGINT) AS line_no, unnest(ls) AS line FROM (SELECT path, string_split(content, chr(10)) AS ls FROM files)",
}
