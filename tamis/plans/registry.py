"""The registered queries of the trust and retrieval operators, each over its whole table, with the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tamis.functions import normalize
from tamis.functions import text as tx
from tamis.operators import audit, detect, secrets, sessions, store, web
from tamis.plans import derived_sql as ds
from tamis.sources import derived
from tamis.sources.tables import table


def _q(name, f):
    return lambda spark, folder: f(table(spark, folder, name))


def _words(c: str) -> str:
    """tokens() in SQL."""
    stop = ", ".join(f"'{w}'" for w in tx.STOP_WORDS)
    return f"list_filter(string_split_regex(regexp_replace(lower(coalesce({c}, '')), '[^a-z가-힣0-9 \\t\\n\\r\\f-]', ' ', 'g'), '[ \\t\\n\\r\\f]+'), lambda w: length(w) > 1 AND NOT list_contains([{stop}], w))"


_RAW = "list_filter(string_split_regex(coalesce(text, ''), '[ \\t\\n\\r\\f\\x0B]+'), lambda w: w <> '')"


def _mask(v: str) -> str:
    return f"(CASE WHEN length({v}) <= 8 THEN substr({v}, 1, 1) || repeat('*', greatest(3, length({v}) - 1)) ELSE substr({v}, 1, 4) || repeat('*', least(12, length({v}) - 6)) || right({v}, 2) END)"


def _re2(pattern: str) -> str:
    """A rule's pattern for an engine without look-around; what the one look-ahead excludes is excluded afterwards."""
    p = pattern.replace("(?<![A-Za-z0-9_])", "\\b").replace("(?![A-Za-z0-9_])", "\\b")
    a = p.find("(?!")
    if a >= 0:
        p = p[:a] + p[p.index("[^\\s:/@", a) :]
    return p.replace("{8,2000}", "{8,}").replace("{0,8000}?", "*?").replace("'", "''")  # there, no bound may exceed 1000


_URI_STAND_IN = "^[^:]*:(\\$\\{?[A-Za-z_]|<|(?i:pass(?:word|wd)?|pwd|user(?:name)?|changeme|example|placeholder|secret|token|xxx+|test|redacted|dummy)@)"


def _placeholder(v: str, illustrative: bool = True) -> str:
    s = f"trim({v})"
    low = f"lower({s})"
    runs = f" OR regexp_matches(regexp_replace({low}, '[^a-z]', '', 'g'), '{secrets.LETTER_RUNS}') OR regexp_matches(regexp_replace({low}, '[^0-9]', '', 'g'), '{secrets.DIGIT_RUNS}')" if illustrative else ""
    return (
        f"({s} = '' OR regexp_matches({s}, '^\\$\\{{?[A-Za-z0-9_]+\\}}?$') OR regexp_matches({s}, '(?i)\\b(?:process\\.env|os\\.environ|getenv|ENV\\[)') OR regexp_matches({s}, '(?i)^[*x._\\-]+$')"
        f" OR regexp_matches({s}, '{secrets.PLACEHOLDER}') OR len(list_distinct(string_split(regexp_replace({s}, '[-_./+=]', '', 'g'), ''))) <= 2{runs})"
    )


def _entropy(v: str) -> str:
    return f"list_sum(list_transform(list_distinct(string_split({v}, '')), lambda d: -(len(list_filter(string_split({v}, ''), lambda x: x = d)) / length({v})) * log2(len(list_filter(string_split({v}, ''), lambda x: x = d)) / length({v}))))"


def _shape(v: str) -> str:
    classes = " + ".join(f"CAST(regexp_matches({v}, '{p}') AS INT)" for p in ("[a-z]", "[A-Z]", "[0-9]"))
    return f"(length({v}) >= 8 AND NOT regexp_matches({v}, '(?i)^https?://') AND length({v}) - length(replace({v}, '/', '')) < 2 AND NOT regexp_matches({v}, '^v?[0-9][0-9.\\-_]*$') AND ({classes} >= 2 OR {_entropy(v)} >= 3.5))"


_RULES = ", ".join(f"({i}, '{r.rule}', '{r.severity}', {str(r.generic).lower()})" for i, r in enumerate(secrets.RULES))
_BY_RULE = " UNION ALL ".join(f"SELECT doc_id, line_no, line, {i} AS ord, unnest(regexp_extract_all(line, '{_re2(r.pattern)}', {r.group})) AS value FROM lines" for i, r in enumerate(secrets.RULES))
_SECRETS = f"""
WITH lines AS (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS line_no, unnest(ls) AS line FROM (SELECT doc_id, string_split_regex(text, '\\r?\\n') AS ls FROM documents WHERE text IS NOT NULL)),
rules(ord, rule, severity, generic) AS (VALUES {_RULES}),
raw AS ({_BY_RULE}),
kept AS (SELECT * FROM raw JOIN rules USING (ord) WHERE NOT {_placeholder("value")} AND (NOT generic OR {_shape("value")}) AND NOT (rule = 'uri-userinfo' AND regexp_matches(value, '{_URI_STAND_IN}'))),
found AS (SELECT *, {_mask("trim(value)")} AS masked, trim(replace(line, value, {_mask("trim(value)")})) AS shown FROM kept QUALIFY row_number() OVER (PARTITION BY doc_id, line_no, value ORDER BY ord) = 1),
findings AS (SELECT doc_id, CAST(line_no AS INT) AS line_no, rule, severity, masked, CASE WHEN length(shown) > 160 THEN substr(shown, 1, 157) || '...' ELSE shown END AS evidence, substr(sha256(value), 1, 16) AS fingerprint FROM found)
"""
_REDACT = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), lines AS (SELECT doc_id, 1 AS line_no, t AS line FROM d), rules(ord, rule, severity, generic) AS (VALUES {_RULES}), raw AS ({_BY_RULE}),
kept AS (SELECT DISTINCT doc_id, value FROM raw JOIN rules USING (ord) WHERE NOT {_placeholder("value", False)} AND NOT (rule = 'uri-userinfo' AND regexp_matches(value, '{_URI_STAND_IN}'))),
v AS (SELECT doc_id, list(value ORDER BY length(value) DESC, value) AS vs FROM kept GROUP BY 1)
SELECT doc_id, CAST(coalesce(len(vs), 0) AS BIGINT) AS secrets_redacted, sha256(CASE WHEN vs IS NULL THEN t ELSE list_reduce(list_prepend(t, vs), lambda acc, v: replace(acc, v, {_mask("trim(v)")})) END) AS text_sha256 FROM d LEFT JOIN v USING (doc_id)
"""

_BM25 = f"""
WITH d AS (SELECT doc_id, {_words("text")} AS w FROM documents), n AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM d),
p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM d) GROUP BY 1, 2),
f AS (SELECT term, ln((n - count(*) + 0.5) / (count(*) + 0.5) + 1) AS idf FROM p, n GROUP BY term, n),
q AS (SELECT item_id AS query_id, term, count(*) AS qn FROM (SELECT item_id, unnest({_words("text")}) AS term FROM benchmark) GROUP BY 1, 2),
s AS (SELECT query_id, doc_id, round(sum(qn * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(w) / mean))), 4) AS score FROM q JOIN p USING (term) JOIN f USING (term) JOIN d USING (doc_id), n GROUP BY 1, 2)
SELECT query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INT) AS rank FROM s QUALIFY rank <= 10
"""
_NEAR = " UNION ALL ".join(f"SELECT a.w AS word, b.w AS neighbour FROM t a JOIN t b ON a.doc_id = b.doc_id AND b.i = a.i + {k}" for k in (-5, -4, -3, -2, -1, 1, 2, 3, 4, 5))
_PMI = f"""
WITH t AS (SELECT doc_id, unnest(range(len(w))) AS i, unnest(w) AS w FROM (SELECT doc_id, {_words("text")} AS w FROM documents)),
n AS (SELECT word, neighbour, count(*) AS n FROM ({_NEAR}) GROUP BY 1, 2), s AS (SELECT sum(n) AS total FROM n), f AS (SELECT w, count(*) AS f FROM t GROUP BY 1)
SELECT * FROM (SELECT word, neighbour, n, round(log2(n * CAST(total AS DOUBLE) / (a.f * b.f)), 6) AS pmi FROM n JOIN f a ON a.w = word JOIN f b ON b.w = neighbour, s) WHERE pmi > 0
"""
_TOPIC_STOP = ", ".join(f"'{w}'" for w in [*tx.STOP_WORDS, *sessions.NOISE_WORDS])
_TOPICS = f"""
WITH w AS (SELECT conv_id, unnest(list_distinct(list_filter(string_split_regex(regexp_replace(lower(coalesce(text, '')), '[^a-z가-힣0-9 \\t\\n\\r\\f-]', ' ', 'g'), '[ \\t\\n\\r\\f]+'),
  lambda w: length(w) > 2 AND NOT list_contains([{_TOPIC_STOP}], w) AND NOT regexp_matches(w, '^[0-9a-f]{{6,}}$') AND NOT regexp_matches(w, '^[0-9]+$') AND NOT starts_with(w, '-home-') AND NOT (contains(w, '-') AND regexp_matches(w, '[0-9a-f]{{4,}}'))))) AS topic FROM conversations WHERE role = 'user'),
n AS (SELECT conv_id, topic, count(*) AS n FROM w GROUP BY 1, 2 HAVING count(*) >= 3)
SELECT conv_id, topic, n, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY n DESC, topic) AS INT) AS rank FROM n QUALIFY rank <= 10
"""


def _normalized(d):
    text, steps = normalize.normalized("text")
    return d.select("doc_id", F.sha2(text, 256).alias("sha"), F.array_join(steps, ",").alias("steps"))


def _nrm_sql() -> str:
    steps = [
        ("invisible", "regexp_replace({}, '[\\x{{200B}}-\\x{{200F}}\\x{{2060}}-\\x{{2069}}\\x{{FEFF}}\\x{{202A}}-\\x{{202E}}]', '', 'g')"),
        ("look_alikes", f"translate({{}}, '{''.join(normalize.LOOK_ALIKES)}', '{''.join(normalize.LOOK_ALIKES.values())}')"),
        ("full_width", "translate({}, (SELECT string_agg(chr(CAST(i AS INT)), '' ORDER BY i) FROM range(65281, 65375) t(i)), (SELECT string_agg(chr(CAST(i AS INT)), '' ORDER BY i) FROM range(33, 127) t(i)))"),
        ("blanks", "regexp_replace(regexp_replace({}, '[ \\t\\r\\f\\x0B]{{2,}}', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')"),
    ]
    sql = "SELECT doc_id, coalesce(text, '') AS t0 FROM documents"
    for i, (_, step) in enumerate(steps):
        sql = f"SELECT *, {step.format(f't{i}')} AS t{i + 1} FROM ({sql})"
    names = ", ".join(f"CASE WHEN t{i + 1} <> t{i} THEN '{name}' END" for i, (name, _) in enumerate(steps))
    return f"SELECT doc_id, sha256(t{len(steps)}) AS sha, concat_ws(',', {names}) AS steps FROM ({sql})"


QUERIES = {
    "nrm_text": _q("documents", _normalized),
    "sec_scan": _q("documents", secrets.scan_secrets),
    "sec_scorecard": _q("documents", lambda d: secrets.secret_scorecard(d, ["lang", "source"])),
    "sec_redact": _q("documents", lambda d: secrets.redact(d).select("doc_id", "secrets_redacted", F.sha2("text", 256).alias("text_sha256"))),
    "sec_reuse": _q("documents", lambda d: secrets.reused_secrets(secrets.scan_secrets(d))),
    "det_characters": _q("documents", detect.character_histogram),
    "det_entropy": _q("documents", detect.text_entropy),
    "det_entropy_windows": _q("documents", detect.entropy_windows),
    "det_repetition": _q("documents", detect.repetition),
    "det_script_mixing": lambda spark, folder: detect.script_mixing(derived.notices(table(spark, folder, "documents"))),
    "det_encoding": _q("documents", detect.encoding_signs),
    "det_token_statistics": _q("documents", detect.token_statistics),
    "det_token_repetition": _q("documents", detect.repeated_tokens),
    "det_caps_runs": _q("documents", detect.caps_runs),
    "txt_tokens": _q("documents", lambda d: d.select("doc_id", tx.tokens("text").alias("w")).select("doc_id", F.size("w").cast("long").alias("n_tokens"), F.size(F.array_distinct("w")).cast("long").alias("n_distinct"), F.sha2(F.array_join("w", " "), 256).alias("sha"))),
    "txt_bigrams": _q("documents", lambda d: d.select(F.explode(tx.bigrams(tx.tokens("text"))).alias("bigram")).groupBy("bigram").agg(F.count("*").alias("n"))),
    "mem_postings": _q("documents", store.postings),
    "mem_idf": lambda s, f: store.inverse_frequencies(store.postings(table(s, f, "documents")), table(s, f, "documents").count()).select("term", "df", F.round("idf", 6).alias("idf")),
    "mem_bm25": lambda s, f: store.bm25_search(table(s, f, "documents"), table(s, f, "benchmark")),
    "mem_pmi": _q("documents", store.pmi),
    "emb_dense_search": _q("embeddings", lambda v: store.dense_search(v, v.where("vec_id % 100 = 0"))),
    "ses_topics": _q("conversations", sessions.session_topics),
    "ses_rollup": _q("conversations", sessions.session_rollup),
    "ses_replies": _q("conversations", sessions.replies),
    "web_domains": _q("pages", web.page_domains),
    "web_feeds": _q("pages", web.feeds),
    "doc_chunks": _q("documents", web.chunk_paragraphs),
    "aud_snapshot": lambda s, f: audit.snapshot_diff(table(s, f, "documents"), secrets.redact(table(s, f, "documents")), "doc_id", "text"),
    "aud_line_units": _q("documents", audit.line_units),
    "aud_activity_windows": _q("events", audit.activity_windows),
    "aud_exposure": _q("events", lambda e: audit.exposure_levels(e, "error", "purchase")),
    "aud_tokens": _q("documents", audit.actionable_tokens),
}

ORACLE = {
    "nrm_text": _nrm_sql(),
    "sec_redact": _REDACT,
    "sec_scan": _SECRETS + "SELECT * FROM findings",
    "sec_scorecard": _SECRETS + "SELECT lang, source, rule, severity, count(*) AS findings, count(DISTINCT fingerprint) AS credentials, count(DISTINCT doc_id) AS documents FROM findings JOIN documents USING (doc_id) GROUP BY 1, 2, 3, 4",
    "sec_reuse": _SECRETS + "SELECT fingerprint, count(DISTINCT doc_id) AS documents, count(*) AS places FROM findings GROUP BY 1 HAVING count(DISTINCT doc_id) > 1",
    "det_characters": "SELECT doc_id, ch, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, '')) AS ch FROM documents) WHERE ch <> '' GROUP BY 1, 2",
    "det_entropy": "SELECT doc_id, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6) AS entropy FROM (SELECT doc_id, ch, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, '')) AS ch FROM documents) WHERE ch <> '' GROUP BY 1, 2) GROUP BY 1",
    "det_script_mixing": f"WITH {ds.NOTICES} SELECT doc_id, CAST(i AS INT) AS sentence_no, 'high' AS severity FROM (SELECT doc_id, unnest(range(len(s))) AS i, unnest(s) AS s FROM (SELECT doc_id, string_split_regex(text, '[.!?\\n]+') AS s FROM notices)) WHERE regexp_matches(s, '[A-Za-zÀ-ɏ]') AND regexp_matches(s, '[Ѐ-ӿ]')",
    "det_encoding": """SELECT doc_id, round(v / n, 6) AS invisible, v / n > 0.05 AS hidden, length(t) >= 20 AND b / n > 0.03 AND regexp_matches(t, '[A-Za-z0-9+/=]{40}') AS base64_like, length(t) >= 20 AND p / n > 0.05 AND x > 5 AS percent_like
FROM (SELECT doc_id, coalesce(text, '') AS t, greatest(length(coalesce(text, '')), 1) AS n, len(regexp_extract_all(text, '[\\x{200B}-\\x{200F}\\x{2060}-\\x{2069}\\x{FEFF}\\x{202A}-\\x{202E}]')) AS v, len(regexp_extract_all(text, '[+=]')) AS b, len(regexp_extract_all(text, '%')) AS p, len(regexp_extract_all(text, '%[0-9A-Fa-f]{2}')) AS x FROM documents)""",
    "det_token_statistics": f"""SELECT doc_id, CAST(len(w) AS BIGINT) AS total_tokens, CAST(len(list_distinct(list_transform(w, lambda x: lower(x)))) AS BIGINT) AS unique_tokens, CASE WHEN len(w) > 0 THEN round(CAST(list_sum(list_transform(w, lambda x: length(x))) AS DOUBLE) / len(w), 2) ELSE 0.0 END AS mean_length,
CASE WHEN l > 0 THEN round(CAST(u AS DOUBLE) / l, 3) ELSE 0.0 END AS uppercase_ratio, CAST(len(list_filter(w, lambda x: length(x) > 50)) AS BIGINT) AS long_tokens, CAST(len(list_filter(w, lambda x: regexp_matches(x, '[A-Za-zÀ-ɏ]') AND regexp_matches(x, '[Ѐ-ӿ]'))) AS BIGINT) AS mixed_tokens
FROM (SELECT doc_id, {_RAW} AS w, len(regexp_extract_all(coalesce(text, ''), '[A-Za-z]')) AS l, len(regexp_extract_all(coalesce(text, ''), '[A-Z]')) AS u FROM documents)""",
    "det_token_repetition": f"SELECT doc_id, lower(w) AS token, count(*) AS n FROM (SELECT doc_id, unnest({_RAW}) AS w FROM documents) GROUP BY 1, 2 HAVING count(*) >= 10",
    "det_caps_runs": f"""SELECT doc_id, CAST(min(p) AS INT) AS first_token, count(*) AS n FROM (SELECT doc_id, p, p - row_number() OVER (PARTITION BY doc_id ORDER BY p) AS island FROM (SELECT doc_id, unnest(range(len(w))) AS p, regexp_replace(unnest(w), '[^a-zA-Z]', '', 'g') AS a FROM (SELECT doc_id, {_RAW} AS w FROM documents)) WHERE length(a) >= 2 AND a = upper(a)) GROUP BY doc_id, island HAVING count(*) >= 5""",
    "txt_tokens": f"SELECT doc_id, CAST(len(w) AS BIGINT) AS n_tokens, CAST(len(list_distinct(w)) AS BIGINT) AS n_distinct, sha256(array_to_string(w, ' ')) AS sha FROM (SELECT doc_id, {_words('text')} AS w FROM documents)",
    "txt_bigrams": f"SELECT w[i] || ' ' || w[i + 1] AS bigram, count(*) AS n FROM (SELECT w, unnest(range(1, len(w))) AS i FROM (SELECT {_words('text')} AS w FROM documents)) GROUP BY 1",
    "mem_postings": f"SELECT term, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest({_words('text')}) AS term FROM documents) GROUP BY 1, 2",
    "mem_idf": f"WITH n AS (SELECT count(*) AS n FROM documents) SELECT term, count(*) AS df, round(ln((n - count(*) + 0.5) / (count(*) + 0.5) + 1), 6) AS idf FROM (SELECT DISTINCT doc_id, unnest({_words('text')}) AS term FROM documents), n GROUP BY term, n",
    "mem_bm25": _BM25,
    "mem_pmi": _PMI,
    "emb_dense_search": "WITH s AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 6) AS score FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0) SELECT query_id, vec_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s QUALIFY rank <= 10",
    "ses_topics": _TOPICS,
    "ses_rollup": """SELECT conv_id, count(*) AS n_messages, count_if(role = 'user') AS n_user, count_if(role = 'assistant') AS n_assistant, CAST(sum(length(coalesce(text, ''))) AS BIGINT) AS n_chars, min(turn) AS first_turn, max(turn) AS last_turn,
coalesce(substr(string_split(arg_min(coalesce(text, ''), turn) FILTER (role = 'user'), chr(10))[1], 1, 120), 'Empty session') || ' [' || count(*) || ' messages]' AS summary FROM conversations GROUP BY conv_id""",
    "ses_replies": """SELECT conv_id, turn, turn - asked AS waited, CAST(c AS BIGINT) AS request_chars FROM (SELECT conv_id, turn, role, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER w AS asked, last_value(CASE WHEN role = 'user' THEN length(coalesce(text, '')) END IGNORE NULLS) OVER w AS c FROM conversations
WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)) WHERE role = 'assistant' AND asked IS NOT NULL""",
    "web_domains": "SELECT page_id, CASE WHEN coalesce(d, '') = '' THEN 'web' ELSE d END AS domain FROM (SELECT page_id, substr(regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '^www\\.', ''), '[^a-zA-Z0-9_-]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 80) AS d FROM pages)",
    "web_feeds": "SELECT page_id, regexp_matches(substr(regexp_replace(coalesce(html, ''), '^[ \\t\\n\\r\\f]+', ''), 1, 1000), '(?is)^(?:<\\?xml.*?\\?>[ \\t\\n\\r\\f]*)?<(?:rss|feed)\\b') AS is_feed FROM pages",
    "aud_snapshot": f"SELECT doc_id, CASE WHEN sha256(coalesce(text, '')) = text_sha256 THEN 'unchanged' ELSE 'changed' END AS change FROM documents JOIN ({_REDACT}) USING (doc_id)",
    "aud_line_units": "SELECT doc_id, unit, CAST(row_number() OVER (PARTITION BY doc_id, unit ORDER BY p) AS INT) AS nth FROM (SELECT doc_id, unnest(range(len(l))) AS p, trim(unnest(l)) AS unit FROM (SELECT doc_id, string_split_regex(text, '\\r?\\n') AS l FROM documents)) WHERE unit <> ''",
    "aud_activity_windows": """WITH s AS (SELECT user_id, ts - INTERVAL 2 SECOND AS a, ts + INTERVAL 600 SECOND AS b FROM events),
m AS (SELECT *, max(b) OVER (PARTITION BY user_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR a > reach THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island FROM m)
SELECT user_id, min(a) AS opened, max(b) AS closed, count(*) AS n FROM i GROUP BY user_id, island""",
    "aud_exposure": "SELECT user_id, ts, event_id, event_type, ['clean', 'exposed', 'tainted'][1 + max(CASE event_type WHEN 'error' THEN 2 WHEN 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)] AS level FROM events",
    "aud_tokens": "SELECT DISTINCT doc_id, kind, lower(token) AS token FROM (SELECT doc_id, 'email' AS kind, unnest(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}')) AS token FROM documents UNION ALL SELECT doc_id, 'url', unnest(regexp_extract_all(text, 'https?://[^ \\t\\n\\r\\f\"''<>)]+')) FROM documents UNION ALL SELECT doc_id, 'path', unnest(regexp_extract_all(text, '~/[A-Za-z0-9._/-]+')) FROM documents)",
}


def _vault(f):
    return lambda spark, folder: f(derived.vault(table(spark, folder, "documents")))


def _in_vault(sql: str) -> str:
    return sql.replace("WITH ", f"WITH {ds.VAULT}, ", 1).replace("FROM documents WHERE", "FROM vault WHERE").replace("AS t FROM documents)", "AS t FROM vault)")


QUERIES |= {
    "sec_vault_scan": _vault(secrets.scan_secrets),
    "sec_vault_redact": _vault(lambda d: secrets.redact(d).select("doc_id", "secrets_redacted", F.sha2("text", 256).alias("text_sha256"))),
    "sec_vault_reuse": _vault(lambda d: secrets.reused_secrets(secrets.scan_secrets(d))),
    "sec_vault_present": _vault(lambda d: secrets.still_present(secrets.scan_secrets(d).select("doc_id", "fingerprint"), secrets.scan_secrets(d.where("doc_id % 2 = 0"))).distinct()),
    "sec_vault_hint": _vault(lambda d: d.select("doc_id", F.col("text").rlike(secrets.HINT).alias("hint"))),
}
ORACLE |= {
    "sec_vault_scan": _in_vault(_SECRETS + "SELECT * FROM findings"),
    "sec_vault_redact": _in_vault(_REDACT),
    "sec_vault_reuse": _in_vault(_SECRETS + "SELECT fingerprint, count(DISTINCT doc_id) AS documents, count(*) AS places FROM findings GROUP BY 1 HAVING count(DISTINCT doc_id) > 1"),
    "sec_vault_present": _in_vault(_SECRETS + "SELECT DISTINCT doc_id, fingerprint, fingerprint IN (SELECT fingerprint FROM findings WHERE doc_id % 2 = 0) AS still_present FROM findings"),
    "sec_vault_hint": f"WITH {ds.VAULT} SELECT doc_id, regexp_matches(text, {ds.re2(secrets.HINT)}) AS hint FROM vault",
}


def _merge() -> None:
    """Queries of the other plan modules join those of this one."""
    from tamis.plans import audits, code, directives, expansion, injection, knowledge, learning, pages

    for module in (injection, directives, expansion, code, knowledge, pages, audits, learning):
        QUERIES.update(module.QUERIES)
        ORACLE.update(module.ORACLE)


_merge()
