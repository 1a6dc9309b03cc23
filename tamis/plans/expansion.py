"""Registered queries on stems, synonyms, query expansion and weighted search, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tamis.functions import words as wd
from tamis.functions.text import tokens
from tamis.operators import expansion as ex, store
from tamis.plans import derived_sql as ds
from tamis.sources.tables import table

NOW = "2026-01-01 00:00:00"


def _terms(docs):
    return docs.select(F.explode(tokens("text")).alias("word")).distinct()


def _memories(docs):
    """Documents as memories with a confidence, accesses and a time of the last one that go by their id."""
    n = F.col("doc_id")
    return docs.select(n.alias("id"), F.col("text").alias("content"), F.round(0.3 + (n % 7) / 10, 6).alias("confidence"), (n % 5).alias("access_count"), F.timestamp_seconds(F.lit(1_700_000_000) + (n * 7919) % 20_000_000).alias("accessed_at"))


def _known(docs):
    """Words of documents with one stem as synonyms of each other."""
    return ex.synonyms(_terms(docs).select(wd.stem(F.col("word")).alias("group"), "word"))


def _related(docs):
    """For each word, the first other words of documents with its first four characters, in their order."""
    w = _terms(docs).where(F.length("word") > 4).withColumn("head", F.left("word", F.lit(4)))
    from pyspark.sql import Window

    at = w.withColumn("i", F.row_number().over(Window.partitionBy("head").orderBy("word")))
    return at.join(at.select("head", F.col("word").alias("neighbour"), F.col("i").alias("j")), "head").where("j between i + 1 and i + 3").select("word", (F.col("j") - F.col("i")).alias("rank"), "neighbour")


def _expanded(s, f):
    docs = table(s, f, "documents")
    return ex.expand_queries(table(s, f, "benchmark"), _known(docs), _related(docs))


def _found(s, f):
    q = table(s, f, "benchmark")
    return ex.memory_search(_memories(table(s, f, "documents")), ex.expand_queries(q).select("query_id", "term"), F.lit(NOW))


QUERIES = {
    "txt_stems": lambda s, f: _terms(table(s, f, "documents")).select("word", wd.stem(F.col("word")).alias("stem"), wd.transliterate(F.col("word")).alias("other")),
    "txt_synonyms": lambda s, f: _known(table(s, f, "documents")),
    "mem_keys": lambda s, f: ex.term_keys(table(s, f, "documents")).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf")),
    "mem_expand": _expanded,
    "mem_search": _found,
}


def stem(w: str) -> str:
    """The suffix rules as one pattern each, tried in order."""
    rules = " ".join(f"WHEN regexp_matches({w}, '{s}$') AND length(regexp_replace({w}, '{s}$', '{p}')) >= {n} THEN regexp_replace({w}, '{s}$', '{p}')" for s, p, n in wd.STEM_RULES)
    return f"CASE WHEN length({w}) < {wd.STEM_LEAST} THEN {w} {rules} ELSE {w} END"


def _loan(w: str) -> str:
    pairs = [*wd.LOANWORDS.items(), *((en, ko) for ko, en in wd.LOANWORDS.items())]
    return f"(CASE {w} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in pairs) + " END)"


_W = f"w AS (SELECT DISTINCT unnest({ds.words('text')}) AS word FROM documents), st AS MATERIALIZED (SELECT word, {stem('word')} AS stem, {_loan('word')} AS other FROM w)"
_KNOWN = f"{_W}, known AS MATERIALIZED (SELECT a.word, b.word AS synonym FROM st a JOIN st b ON a.stem = b.stem AND a.word <> b.word)"
_RELATED = "rel AS (SELECT word, list_slice(list(word) OVER (PARTITION BY substr(word, 1, 4) ORDER BY word ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING), 1, 3) AS ns FROM w WHERE length(word) > 4)"
_OWN = f"own AS (SELECT query_id, w, min(p) AS p FROM (SELECT item_id AS query_id, unnest(range(len(ws))) AS p, unnest(ws) AS w FROM (SELECT item_id, {ds.words('text')} AS ws FROM benchmark)) GROUP BY 1, 2), o2 AS (SELECT *, {stem('w')} AS s, {_loan('w')} AS t FROM own)"
_KEYS = f"keys AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(list_filter([word, CASE WHEN stem <> word THEN stem END, other], lambda x: x IS NOT NULL)) AS term FROM (SELECT doc_id, unnest({ds.words('text')}) AS word FROM documents) JOIN st USING (word)) GROUP BY 1, 2)"

ORACLE = {
    "txt_stems": f"WITH {_W} SELECT * FROM st",
    "txt_synonyms": f"WITH {_KNOWN} SELECT * FROM known",
    "mem_keys": f"WITH {_W}, {_KEYS} SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS tf FROM keys GROUP BY 1",
    "mem_expand": f"""WITH {_KNOWN}, {_RELATED}, {_OWN}, e AS (SELECT query_id, p, 0 AS step, w AS term, 'original' AS source, NULL AS related_to, '' AS n FROM own UNION ALL SELECT query_id, p, 1, synonym, 'synonym', w, synonym FROM own JOIN known ON word = w
UNION ALL SELECT query_id, p, 2, s, 'stem', w, '' FROM o2 WHERE s <> w UNION ALL SELECT query_id, p, 3, t, 'transliteration', w, '' FROM o2 WHERE t IS NOT NULL UNION ALL SELECT query_id, p, 4, synonym, 'synonym', t, synonym FROM o2 JOIN known ON word = t
UNION ALL SELECT query_id, p, 5, unnest(ns), 'cooccurrence', w, CAST(unnest(range(len(ns))) AS VARCHAR) FROM own JOIN rel ON rel.word = w)
SELECT query_id, term, source, related_to FROM e QUALIFY row_number() OVER (PARTITION BY query_id, term ORDER BY step > 0, p, step, n) = 1""",
    "mem_search": f"""WITH {_W}, {_KEYS}, {_OWN}, e AS (SELECT DISTINCT query_id, w AS term FROM own UNION SELECT query_id, s FROM o2 WHERE s <> w UNION SELECT query_id, t FROM o2 WHERE t IS NOT NULL),
q AS (SELECT DISTINCT query_id, term FROM e), f AS MATERIALIZED (SELECT term AS q, {stem('term')} AS s, {_loan('term')} AS t FROM (SELECT DISTINCT term FROM q)), d AS (SELECT doc_id, len({ds.words('text')}) AS len FROM documents), n AS (SELECT count(*) AS n, avg(len) AS mean FROM d),
df AS (SELECT q, ln((n - count(*) + 0.5) / (count(*) + 0.5) + 1) AS idf FROM f JOIN keys ON term = q, n GROUP BY q, n),
pairs AS (SELECT q, doc_id FROM f JOIN keys ON term = q UNION SELECT q, doc_id FROM f JOIN keys ON term = s UNION SELECT q, doc_id FROM f JOIN keys ON term = t),
m AS (SELECT p.q, p.doc_id, coalesce(a.tf, b.tf * 0.7::DOUBLE, c.tf * 0.6::DOUBLE) AS tf FROM pairs p JOIN f ON f.q = p.q LEFT JOIN keys a ON a.doc_id = p.doc_id AND a.term = f.q LEFT JOIN keys b ON b.doc_id = p.doc_id AND b.term = f.s LEFT JOIN keys c ON c.doc_id = p.doc_id AND c.term = f.t),
sums AS (SELECT query_id, m.doc_id, sum(idf * m.tf * 2.5 / (m.tf + 1.5 * (0.25 + 0.75 * len / mean))) AS s FROM m JOIN df ON df.q = m.q JOIN q ON q.term = m.q JOIN d ON d.doc_id = m.doc_id, n GROUP BY 1, 2),
r AS (SELECT query_id, doc_id AS id, round(s * exp(-0.005 * (epoch(TIMESTAMP '{NOW}') - (1700000000 + (doc_id * 7919) % 20000000)) / 86400) * (0.5 + round(0.3 + (doc_id % 7) / 10, 6) * 0.5) * (1 + ln(1 + doc_id % 5) * 0.1), 6) AS score FROM sums)
SELECT query_id, id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM r WHERE score > 0 QUALIFY rank <= 10""",
}
