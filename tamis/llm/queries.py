"""The registered queries of the training-data operators, with their SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TOKENIZER = "word_bpe_49k.json"
TOKEN_LIMIT = 2048
#: Ranks of op11.
RANKS = "byte_bpe_50k.tiktoken"
#: Scores from which a document is called toxic.
TOXIC = 0.7


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tamis.llm.token_counts import token_prefixes, tokens_within

    counts = token_prefixes(read(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))
    return tokens_within(counts, TOKEN_LIMIT).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tamis.llm.sharding import shard_documents

    return shard_documents(read(spark, sf_dir, "documents"), shards=40)


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tamis.llm.mixing import mix_sources

    docs = read(spark, sf_dir, "documents")
    return mix_sources(docs).select("doc_id", "source", "mix_epoch", "mix_slice")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tamis.llm.decontamination import flag_contaminated

    return flag_contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tamis.llm.chat_format import format_windows, read_back

    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", hard), (-1, 1, "assistant", hard)], turns.schema)
    return read_back(format_windows(turns.unionByName(extra)), in_order=True)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tamis.llm.substring_dedup import dedup_substrings

    return dedup_substrings(read(spark, sf_dir, "documents"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tamis.llm.suffix_dedup import dedup_bytes

    return dedup_bytes(read(spark, sf_dir, "documents"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tamis.llm.jaccard_join import jaccard_components

    return jaccard_components(read(spark, sf_dir, "documents"), words=3, percent=90)


OP9_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i + 1:i + 3], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(0, CASE WHEN len(ws) = 0 THEN 0 ELSE greatest(1, len(ws) - 2) END)) AS i FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM both_ JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 90 * (x.n + y.n - k)),
reach(a, b) AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a)
SELECT w.doc_id, CAST(coalesce(max(n.n), 0) AS BIGINT) AS n_shingles, least(w.doc_id, coalesce(min(reach.b), w.doc_id)) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN reach ON reach.a = w.doc_id GROUP BY w.doc_id
"""

def learned_toxicity(docs: DataFrame, labels: DataFrame):
    """The model learned from the labelled rows whose crc32(doc_id as text) modulo 3 is not 1."""
    from tamis.llm.toxicity import fit_toxicity, labelled_sentences

    return fit_toxicity(labelled_sentences(docs, labels.where(~held_out())))


def held_out():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tamis.llm.toxicity import score_toxicity

    docs = read(spark, sf_dir, "documents")
    scores = score_toxicity(docs, learned_toxicity(docs, read(spark, sf_dir, "labels")))
    return scores.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tamis.llm.embedding_dedup import near_duplicates

    return near_duplicates(read(spark, sf_dir, "embeddings"), least=0.9)


OP3_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
reach(a, b) AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
n AS (SELECT a, count(*) AS n FROM link GROUP BY a),
c AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, least(vec_id, coalesce(c.m, vec_id)) AS component_id, vec_id <= coalesce(c.m, vec_id) AS kept
FROM v LEFT JOIN n ON n.a = vec_id LEFT JOIN c ON c.a = vec_id
"""

OP8_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(ws[i + 1:i + 50], ' ')) AS k FROM (SELECT doc_id, ws, unnest(range(0, len(ws) - 49)) AS i FROM w)),
firsts AS (SELECT k, min(doc_id) AS m FROM win GROUP BY k),
hit AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM win JOIN firsts USING (k) WHERE m < doc_id),
isle AS (SELECT doc_id, i, sum(CASE WHEN p IS NULL OR i > p + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS n FROM hit),
span AS (SELECT doc_id, n, min(i) AS a, max(i) + 50 AS b FROM isle GROUP BY doc_id, n),
gap AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS f, a AS t, b - a AS gone FROM span
        UNION ALL SELECT w.doc_id, coalesce(max(b), 0), max(len(ws)), 0 FROM w LEFT JOIN span USING (doc_id) GROUP BY w.doc_id),
kept AS (SELECT doc_id, flatten(list(ws[f + 1:t] ORDER BY f)) AS ks, sum(gone) AS n_removed FROM gap JOIN w USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(n_removed AS BIGINT) AS n_removed, sha256(array_to_string(ks, ' ')) AS kept_sha256 FROM kept JOIN w USING (doc_id)
"""

OP10_SQL = r"""
WITH w AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
win AS (SELECT doc_id, i, md5(substr(x, 2 * i + 1, 200)) AS k FROM (SELECT doc_id, x, unnest(range(0, strlen(x) // 2 - 99)) AS i FROM w)),
firsts AS (SELECT k, min((doc_id, i)) AS m FROM win GROUP BY k),
hit AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM win JOIN firsts USING (k) WHERE m < (doc_id, i)),
isle AS (SELECT doc_id, i, sum(CASE WHEN p IS NULL OR i > p + 100 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS n FROM hit),
span AS (SELECT doc_id, n, min(i) AS a, max(i) + 100 AS b FROM isle GROUP BY doc_id, n),
gap AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS f, a AS t, b - a AS gone FROM span
        UNION ALL SELECT w.doc_id, coalesce(max(b), 0), max(strlen(x) // 2), 0 FROM w LEFT JOIN span USING (doc_id) GROUP BY w.doc_id),
kept AS (SELECT doc_id, string_agg(substr(x, 2 * f + 1, 2 * (t - f)), '' ORDER BY f) AS kx, sum(gone) AS n_removed, count(*) - 1 AS n_spans FROM gap JOIN w USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(strlen(x) // 2 AS BIGINT) AS n_bytes, CAST(n_removed AS BIGINT) AS n_removed, CAST(n_spans AS BIGINT) AS n_spans, sha256(unhex(kx)) AS kept_sha256 FROM kept JOIN w USING (doc_id)
"""


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tamis.llm.byte_bpe import decode_tokens, encode_texts

    vocabulary = public_tokenizers.path(RANKS), public_tokenizers.PATTERN
    decoded = decode_tokens(encode_texts(read(spark, sf_dir, "documents"), *vocabulary), *vocabulary)
    return decoded.select("doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tamis.llm.hard_negatives import mine_hard_negatives

    rows = read(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_hard_negatives(rows.withColumn("label", moved), F.col("vec_id") % 100 == 0)


OP12_SQL = """
WITH v AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.id AS anchor, b.id, a.label = b.label AS same, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score FROM v a JOIN v b ON a.id <> b.id WHERE a.id % 100 = 0),
p AS (SELECT anchor, id, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id) <= 5)
SELECT p.anchor AS anchor_id, p.id AS positive_id, CAST(row_number() OVER (PARTITION BY p.anchor, p.id ORDER BY s.score DESC, s.id) AS INTEGER) AS rank, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor = p.anchor AND NOT s.same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score QUALIFY rank <= 5
"""

def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tamis.llm.phrases import mine_phrases

    return mine_phrases(read(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
g AS (SELECT lang, ws, k, unnest(range(0, len(ws) - k + 1)) AS i FROM w, (VALUES (1), (2), (3)) AS ks(k)),
f AS (SELECT lang, k, ws[i + 1:i + k] AS words, count(*) AS a FROM g GROUP BY ALL),
t AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
cut AS (SELECT lang, k, words, a, unnest(range(1, k)) AS c FROM f WHERE k > 1 AND a >= 10),
scored AS (SELECT cut.lang, cut.k, cut.words, cut.a, c, x.a AS l, y.a AS r, CAST((CAST(1000000 AS HUGEINT) * cut.a * cut.a) // (CAST(x.a AS HUGEINT) * y.a) AS BIGINT) AS score
           FROM cut JOIN f x ON x.lang = cut.lang AND x.words = cut.words[1:c] JOIN f y ON y.lang = cut.lang AND y.words = cut.words[c + 1:cut.k]),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, words ORDER BY score, c) = 1),
inner_ AS (SELECT lang, words[i + 1:i + 2] AS words, max(a) AS o FROM (SELECT lang, words, a, unnest(range(0, 2)) AS i FROM f WHERE k = 3 AND a >= 10) GROUP BY ALL),
kept AS (SELECT lowest.* FROM lowest LEFT JOIN inner_ ON inner_.lang = lowest.lang AND inner_.words = lowest.words WHERE o IS NULL OR 100 * o < 50 * a)
SELECT kept.lang, row_number() OVER (PARTITION BY kept.lang ORDER BY score DESC, a DESC, array_to_string(words, ' ')) AS rank, array_to_string(words, ' ') AS phrase, a, l, r, n, score
FROM kept JOIN t ON t.lang = kept.lang QUALIFY rank <= 2000
"""

QUERIES = {
    "op1_source_mixing": op1_source_mixing,
    "op2_toxicity": op2_toxicity,
    "op3_embedding_dedup": op3_embedding_dedup,
    "op4_decontamination": op4_decontamination,
    "op5_chat_format": op5_chat_format,
    "op6_token_counts": op6_token_counts,
    "op7_sharding": op7_sharding,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_byte_bpe": op11_byte_bpe,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_phrases": op13_phrases,
}
ORACLE: dict[str, str] = {"op3_embedding_dedup": OP3_SQL, "op8_substring_dedup": OP8_SQL, "op9_jaccard_join": OP9_SQL, "op10_suffix_dedup": OP10_SQL, "op12_hard_negatives": OP12_SQL, "op13_phrases": OP13_SQL}
