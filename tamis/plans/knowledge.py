"""Registered queries on observations, the concept graph and sessions, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tamis.functions import injection_rules as ir
from tamis.operators import graph, knowledge as kn
from tamis.operators.injection import injected
from tamis.plans import derived_sql as ds
from tamis.sources import derived
from tamis.sources.tables import merge_store, table


def _store(d):
    """Observations of documents, with confidence, accesses and validity that go by their id."""
    h = F.conv(F.substring("id", 1, 4), 16, 10).cast("int")
    o = kn.extract_observations(d, "source")
    return o.withColumn("confidence", F.round(0.3 + (h % 6) / 10, 6)).withColumn("access_count", h % 4).withColumn("valid", h % 7 != 0)


def _on_store(f):
    return lambda spark, folder: f(_store(table(spark, folder, "documents")))


def _talks(f):
    return lambda spark, folder: f(derived.transcripts(table(spark, folder, "conversations")))


def _renamed(f):
    """An update of the store that counts accesses as accessCount."""
    return lambda o: f(o.withColumnRenamed("access_count", "accessCount"), o.where("id < '8'")).select("id", "confidence", F.col("accessCount").alias("access_count"), "valid")


def _ingest(spark, folder):
    docs = derived.inbox(table(spark, folder, "documents"))
    flagged = injected(docs).where("injected").select("doc_id")
    return kn.ingest(docs, flagged, None, "source").select("id", "source_id", "domain", "topic")


def _calls(m):
    c = m.select("conv_id", "turn", F.posexplode("calls").alias("call", "c"))
    return kn.paired_calls(c.select("conv_id", "turn", "call", F.col("c.name").alias("name")), c.where("call <> 1").select("conv_id", "turn", "call", F.col("c.result").alias("result")), ["conv_id", "turn", "call"])


QUERIES = {
    "mem_observations": lambda s, f: kn.extract_observations(table(s, f, "documents"), "source"),
    "mem_topics": lambda s, f: kn.topics(kn.sentences(table(s, f, "documents"))).groupBy("topic").agg(F.count("*").alias("n")),
    "mem_ingest": _ingest,
    "mem_find": _on_store(lambda o: kn.find_observations(o, any_tag=["testing", "ai", "git", "backend", "debug"]).select("id", "domain", "topic")),
    "mem_statistics": _on_store(kn.store_statistics),
    "mem_touched": _on_store(lambda o: kn.touched(o, o.where("id < '4'")).select("id", "access_count")),
    "mem_confirmed": _on_store(_renamed(graph.confirm)),
    "mem_invalidated": _on_store(_renamed(graph.invalidate)),
    "mem_forgotten": _on_store(lambda o: graph.forget(o, o.where("topic like 'a%'")).select("id")),
    "mem_merged": _on_store(lambda o: merge_store(o.where("id < 'a'"), o).select("id", "domain")),
    "mem_lean": _on_store(kn.lean_view),
    "gra_nodes": _on_store(graph.concept_nodes),
    "gra_edges": _on_store(graph.concept_edges),
    "gra_tunnels": _on_store(graph.tunnels),
    "gra_expand": _on_store(lambda o: graph.expand(o.where("id < '02'").select(F.concat(F.lit("topic:"), "topic").alias("node")), graph.concept_edges(o), 2)),
    "kno_keywords": _on_store(lambda o: kn.common_keywords(o, share=0.01)),
    "kno_junk": lambda s, f: kn.sentences(derived.inbox(table(s, f, "documents"))).select("doc_id", "n", kn.is_junk(F.col("sentence")).alias("junk")),
    "kno_tips": _on_store(kn.tips),
    "kno_facts": _on_store(kn.facts),
    "kno_browse": _on_store(kn.knowledge),
    "kno_report": _on_store(kn.knowledge_report),
    "txt_tags": lambda s, f: derived.inbox(table(s, f, "documents")).select("doc_id", kn.tags_of(F.col("text")).alias("tags")),
    "txt_labels": lambda s, f: derived.inbox(table(s, f, "documents")).select("doc_id", kn.label(F.col("text")).alias("label")),
    "ses_intents": _talks(lambda m: m.where("role = 'user'").select("conv_id", "turn", kn.intent_of(F.col("text")).alias("intent"))),
    "ses_tools": _talks(kn.session_tools),
    "ses_calls": _talks(_calls),
    "ses_approaches": _talks(lambda m: m.where("role = 'assistant'").select("conv_id", "turn", kn.approach_of(F.col("calls")).alias("approach"))),
    "ses_domains": _talks(lambda m: m.select("conv_id", "turn", F.explode("calls").alias("c")).select("conv_id", "turn", kn.domain_of_path(F.regexp_replace("c.path", "/src/.*$", "")).alias("domain"))),
    "ses_observations": _talks(kn.session_observations),
}

_SENTENCES = "sent AS (SELECT * FROM (SELECT doc_id, n, trim(regexp_replace(s, '^[ \\t\\r\\f]+|[ \\t\\r\\f]+$', '', 'g')) AS sentence FROM (SELECT doc_id, unnest(range(len(p))) AS n, unnest(p) AS s FROM (SELECT doc_id, string_split_regex(coalesce(text, ''), '[.!?\\n]') AS p FROM {src}))) WHERE length(sentence) > 15 AND length(sentence) < 500 AND NOT regexp_matches(sentence, '(?i)^[<{{]|task-notification|system-reminder|┌──') AND NOT regexp_matches(sentence, '^[0-9]+$'))"
_TOPICS = f"""w AS (SELECT *, {ds.words('sentence')} AS w FROM sent), tot AS (SELECT count(*) AS c FROM w WHERE len(w) > 0), df AS (SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, n, unnest(w) AS term FROM w) GROUP BY term),
each AS (SELECT doc_id, n, p, term, count(*) OVER (PARTITION BY doc_id, n, term) * (ln((CAST(c AS DOUBLE) + 1) / (df + 1)) + 1) AS v FROM (SELECT doc_id, n, unnest(range(len(w))) AS p, unnest(w) AS term FROM w) JOIN df USING (term), tot),
nx AS (SELECT *, lead(term) OVER o AS nt, lead(v) OVER o AS v2 FROM each WINDOW o AS (PARTITION BY doc_id, n ORDER BY p)),
opt AS (SELECT doc_id, n, round(v, 6) AS v, -p AS p, term AS topic FROM nx UNION ALL SELECT doc_id, n, round((v + v2) * 1.5, 6), -p - 1000000, term || ' ' || nt FROM nx WHERE v > 1 AND v2 > 1),
best AS (SELECT doc_id, n, topic FROM opt QUALIFY row_number() OVER (PARTITION BY doc_id, n ORDER BY v DESC, p DESC, topic DESC) = 1), topics AS (SELECT sent.*, coalesce(topic, 'general') AS topic FROM sent LEFT JOIN best USING (doc_id, n))"""
_LABEL = lambda c, o: f"(SELECT CASE WHEN l = '' THEN '{o}' ELSE l END FROM (SELECT substr(regexp_replace(regexp_replace(regexp_replace(coalesce({c}, ''), '[^\\p{{L}}\\p{{N}}._:-]+', '-', 'g'), '-+', '-', 'g'), '^[-.:]+|[-.:]+$', '', 'g'), 1, 80) AS l))"
_TAGS = lambda c: "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(lower({c}), '(?i){p}') THEN '{t}' END" for t, p in kn.TAGS) + "], lambda x: x IS NOT NULL)"
_CHILD = lambda x: f"list_filter({x}, lambda t: contains(t, ':') OR len(list_filter({x}, lambda s: starts_with(s, t || ':'))) = 0)"
_OBS = f"""{_TOPICS}, chosen AS (SELECT doc_id, topic, arg_min(sentence, n - 1000000000 * length(sentence)) AS content FROM topics GROUP BY 1, 2),
named AS (SELECT doc_id AS source_id, content, {_LABEL('source', 'unknown')} AS domain, {_LABEL('topic', 'general')} AS topic FROM chosen JOIN documents USING (doc_id)),
obs AS (SELECT id, source_id, domain, topic, content, {_CHILD('tg')} AS tags, 0.7::DOUBLE AS confidence, 0 AS access_count, true AS valid FROM (SELECT *, {_TAGS('content')} AS tg FROM (SELECT *, substr(sha256(domain || ':' || topic || ':' || substr(content, 1, 50)), 1, 12) AS id FROM named) QUALIFY row_number() OVER (PARTITION BY id ORDER BY source_id, content, domain, topic) = 1))"""
_S = f"WITH {_SENTENCES.format(src='documents')}, {_OBS}, store AS (SELECT * REPLACE (round(0.3 + (h % 6) / 10, 6) AS confidence, h % 4 AS access_count, h % 7 <> 0 AS valid) EXCLUDE h FROM (SELECT *, CAST('0x' || substr(id, 1, 4) AS INT) AS h FROM obs))".replace("SELECT * REPLACE (round(0.3 + (h % 6) / 10, 6) AS confidence, h % 4 AS access_count, h % 7 <> 0 AS valid) EXCLUDE h", "SELECT * EXCLUDE (h) REPLACE (round(0.3 + (h % 6) / 10, 6) AS confidence, CAST(h % 4 AS INT) AS access_count, h % 7 <> 0 AS valid)")
_STANDING = lambda c: f"(({'regexp_matches(' + c + ', ' + ds.re2(ir.EXPOSE) + ')'} AND regexp_matches({c}, {ds.re2(ir.SECRET_FILE)})) OR (regexp_matches({c}, {ds.re2(ir.RUN)}) AND regexp_matches({c}, {ds.re2(ir.SCRIPT_URL)}) AND (regexp_matches({c}, '(?i)http://') OR regexp_matches({c}, {ds.re2(ir.STANDING)}))) OR (regexp_matches({c}, {ds.re2(ir.STANDING)}) AND regexp_matches({c}, '(?i)https?://') AND regexp_matches({c}, {ds.re2(ir.FETCH)}) AND regexp_matches({c}, {ds.re2(ir.TO_SHELL)})))"
_TRIGGER = "CASE " + " ".join(f"WHEN regexp_matches(content, {ds.lit('(?i)' + p)}) THEN '{t}'" for t, p in kn.TIPS) + " END"
_UNTAG = "trim(regexp_replace(content, '^\\[[^\\]]+\\]\\s*', ''))"
_NO_TIP = ", ".join(f"'{w}'" for w in kn.NO_TIP)
_TIPS = f"""tips AS (SELECT id, {_TRIGGER} AS trigger, trim(regexp_replace({_UNTAG}, '\\s+', ' ', 'g')) AS advice, domain, round(least(0.8, confidence + 0.1), 6) AS confidence FROM store WHERE valid AND length(content) BETWEEN 15 AND 200 AND NOT starts_with(content, '[수정]') AND NOT regexp_matches(content, '^\\[.*\\]\\s*(명령어|파일|패턴|코드|에이전트)') AND lower(regexp_extract(content, '^(\\S*)', 1)) NOT IN ({_NO_TIP}) AND NOT regexp_matches(content, '^\\||\\|---|대신\\s+.{{0,5}}$|^\\*\\*|^>') AND {_TRIGGER} IS NOT NULL AND length(trim(regexp_replace({_UNTAG}, '\\s+', ' ', 'g'))) >= 15)"""
_FACTS = f"facts AS (SELECT id, s AS statement, domain, access_count + 1 AS references FROM (SELECT *, {_UNTAG} AS s FROM store) WHERE valid AND length(content) BETWEEN 10 AND 150 AND regexp_matches(s, '{kn.FACTS}') AND NOT regexp_matches(s, '^\\||^```|^http|^#|^\\*\\*|^>|대신|하지만|근본적') AND length(s) >= 15 AND NOT regexp_matches(s, '[:\\-—]$'))".replace("AS references", 'AS "references"')
_KNOW = f"know AS (SELECT * FROM (SELECT 'tip' AS tier, id, advice AS content, domain FROM tips UNION ALL SELECT 'fact', id, statement, domain FROM facts) WHERE NOT {_STANDING('content')})"
_EDGES = "edges AS (SELECT src, dst, relation, count(*) AS weight FROM (SELECT 'domain:' || domain AS src, 'topic:' || topic AS dst, 'contains' AS relation FROM store UNION ALL SELECT 'topic:' || topic, 'tag:' || t, 'related' FROM (SELECT topic, unnest(tags) AS t FROM store)) GROUP BY 1, 2, 3)"
_JUNK = "length(trim(sentence)) < 12 OR " + " OR ".join(f"regexp_matches(trim(sentence), {ds.lit(p)})" for p in kn.JUNK)
_INTENT = lambda c: "CASE " + " ".join(f"WHEN regexp_matches(lower({c}), {ds.lit('(?i)' + p)}) THEN '{n}'" for n, p in kn.INTENTS) + " END"
_STEP = "CASE x " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in kn.STEPS.items()) + " ELSE x || ' 사용' END"
_APPROACH = f"array_to_string(list_transform(list_filter(list_transform(calls, lambda c, i: CASE WHEN list_position(list_transform(calls, lambda d: d.name), c.name) = i THEN c.name END), lambda x: x IS NOT NULL), lambda x: {_STEP}), ' → ')"
_LANG = "CASE regexp_extract(c.path, '([^.]*)$', 1) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in kn.LANGUAGES.items()) + " END"
_T = f"WITH {ds.TRANSCRIPTS}"
_OBSERVED = f"""{_T}, a AS (SELECT *, coalesce(text, '') AS t, len(calls) AS nc, {_APPROACH} AS approach FROM transcripts),
b AS (SELECT *, last_value(CASE WHEN role = 'user' AND length(t) > 10 AND NOT starts_with(t, '<') THEN t END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS request,
CASE WHEN role = 'assistant' AND length(t) > 10 THEN CASE WHEN nc > 0 THEN approach ELSE substr(t, 1, 80) END END AS said,
role = 'assistant' AND len(list_filter(calls, lambda c: regexp_matches(c.result, '(?i)error|fail|denied|not found'))) > 0 AS bad, CASE WHEN role = 'assistant' AND nc > 0 AND len(list_filter(calls, lambda c: regexp_matches(c.result, '(?i)error|fail'))) = 0 THEN approach END AS fine FROM a),
c AS (SELECT *, {_INTENT('request')} AS intent, last_value(said IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS was, first_value(said IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS thn, first_value(fine IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS fix FROM b),
d AS (SELECT *, lag(role) OVER o AS b_role, lag(nc) OVER o AS b_nc, lag(approach) OVER o AS b_approach, lag(intent) OVER o AS b_intent, trim(replace(replace(regexp_extract(t, '{kn.INSIGHT}', 1), '**', ''), '`', '')) AS insight FROM c WINDOW o AS (PARTITION BY conv_id ORDER BY turn)),
e AS (SELECT * FROM d WHERE length(t) >= 20 AND NOT starts_with(t, '<') AND NOT starts_with(t, '{{'))
SELECT conv_id, turn, 'approach' AS kind, '[' || intent || '] ' || approach AS text FROM e WHERE role = 'assistant' AND nc >= 2 AND intent IS NOT NULL AND length(approach) > 20
UNION ALL SELECT conv_id, turn, 'correction', '[수정] ' || substr(was, 1, 40) || ' 대신 ' || substr(thn, 1, 40) FROM e WHERE role = 'user' AND regexp_matches(t, {ds.lit(kn.CORRECTION)}) AND length(was) > 10 AND length(thn) > 10
UNION ALL SELECT conv_id, turn, 'recovery', '에러 복구: ' || coalesce(list_filter(calls, lambda c: regexp_matches(c.result, '(?i)error'))[1].name, '도구') || ' 실패 후 ' || fix || '로 해결' FROM e WHERE bad AND fix IS NOT NULL
UNION ALL SELECT conv_id, turn, 'validated', '[' || b_intent || ':성공] ' || b_approach FROM e WHERE role = 'user' AND regexp_matches(t, '{kn.APPROVAL}') AND b_role = 'assistant' AND b_nc >= 2 AND b_intent IS NOT NULL AND length(b_approach) > 20
UNION ALL SELECT conv_id, turn, 'insight', '[인사이트] ' || insight FROM e WHERE role = 'assistant' AND length(t) > 100 AND nc = 0 AND length(insight) > 20 AND length(insight) < 120
UNION ALL SELECT conv_id, turn, 'edit', '[' || intent || ':' || {_LANG} || '] 코드 수정으로 해결' FROM (SELECT conv_id, turn, intent, unnest(calls) AS c FROM e WHERE role = 'assistant' AND intent IS NOT NULL) WHERE c.name = 'Edit' AND {_LANG} IS NOT NULL"""

ORACLE = {
    "mem_observations": f"WITH {_SENTENCES.format(src='documents')}, {_OBS} SELECT * FROM obs",
    "mem_topics": f"WITH {_SENTENCES.format(src='documents')}, {_TOPICS} SELECT topic, count(*) AS n FROM topics GROUP BY 1",
    "mem_find": f"{_S} SELECT id, domain, topic FROM store WHERE valid AND list_has_any(tags, ['testing', 'ai', 'git', 'backend', 'debug'])",
    "mem_statistics": f"{_S} SELECT count(*) AS total, count_if(valid) AS valid, count(DISTINCT domain) AS domains, count(DISTINCT topic) AS topics, round(avg(confidence) FILTER (valid), 6) AS mean_confidence, round(avg(access_count) FILTER (valid), 6) AS mean_access FROM store",
    "mem_touched": f"{_S} SELECT id, access_count + CAST(id < '4' AS INT) AS access_count FROM store",
    "mem_confirmed": f"{_S} SELECT id, CASE WHEN id < '8' THEN least(1.0, confidence + 0.1) ELSE confidence END AS confidence, CASE WHEN id < '8' THEN access_count + 1 ELSE access_count END AS access_count, valid FROM store",
    "mem_invalidated": f"{_S} SELECT id, CASE WHEN id < '8' THEN 0.0 ELSE confidence END AS confidence, access_count, CASE WHEN id < '8' THEN false ELSE valid END AS valid FROM store",
    "mem_forgotten": f"{_S} SELECT id FROM store WHERE NOT starts_with(topic, 'a')",
    "mem_merged": f"{_S} SELECT id, domain FROM store",
    "mem_lean": f"{_S} SELECT id, content, domain, tags, true AS trusted FROM store WHERE valid AND NOT {_STANDING('content')}",
    "gra_nodes": f"{_S} SELECT type || ':' || name AS node, type, count(DISTINCT id) AS weight FROM (SELECT id, 'domain' AS type, domain AS name FROM store UNION ALL SELECT id, 'topic', topic FROM store UNION ALL SELECT id, 'tag', unnest(tags) FROM store) GROUP BY 1, 2",
    "gra_edges": f"{_S}, {_EDGES} SELECT * FROM edges",
    "gra_tunnels": f"{_S}, d AS (SELECT DISTINCT domain, topic FROM store) SELECT a.domain AS src, b.domain AS dst, topic, 2 AS weight FROM d a JOIN d b USING (topic) WHERE a.domain < b.domain",
    "gra_expand": f"{_S}, {_EDGES}, both_ AS (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges), h0 AS (SELECT DISTINCT 'topic:' || topic AS node FROM store WHERE id < '02'), h1 AS (SELECT DISTINCT b AS node FROM both_ WHERE a IN (SELECT node FROM h0) AND b NOT IN (SELECT node FROM h0)), h2 AS (SELECT DISTINCT b AS node FROM both_ WHERE a IN (SELECT node FROM h1) AND b NOT IN (SELECT node FROM h0) AND b NOT IN (SELECT node FROM h1)) SELECT node, 0 AS hop FROM h0 UNION ALL SELECT node, 1 FROM h1 UNION ALL SELECT node, 2 FROM h2",
    "kno_keywords": f"{_S}, kw AS (SELECT domain, word, count(*) AS n FROM (SELECT domain, unnest(list_distinct({ds.words('content')})) AS word FROM store) GROUP BY 1, 2), g AS (SELECT domain, count(*) AS size FROM store GROUP BY 1) SELECT domain, word, n FROM kw JOIN g USING (domain) WHERE n >= 0.01 * size QUALIFY row_number() OVER (PARTITION BY domain ORDER BY n DESC, word) <= 10",
    "kno_junk": f"WITH {ds.INBOX}, {_SENTENCES.format(src='inbox')} SELECT doc_id, n, {_JUNK} AS junk FROM sent",
    "kno_tips": f"{_S}, {_TIPS} SELECT * FROM tips",
    "kno_facts": f"{_S}, {_FACTS} SELECT * FROM facts",
    "kno_browse": f"{_S}, {_TIPS}, {_FACTS}, {_KNOW} SELECT * FROM know",
    "kno_report": f"{_S}, {_TIPS}, {_FACTS}, {_KNOW}, k AS (SELECT domain, count_if(tier = 'tip') AS tips, count_if(tier = 'fact') AS facts FROM know GROUP BY 1) SELECT domain, count(*) AS observations, coalesce(max(k.tips), 0) AS tips, coalesce(max(k.facts), 0) AS facts FROM store LEFT JOIN k USING (domain) GROUP BY 1",
    "txt_tags": f"WITH {ds.INBOX} SELECT doc_id, {_CHILD('tg')} AS tags FROM (SELECT doc_id, {_TAGS('text')} AS tg FROM inbox)",
    "txt_labels": f"WITH {ds.INBOX} SELECT doc_id, {_LABEL('text', 'unknown')} AS label FROM inbox",
    "ses_intents": f"{_T} SELECT conv_id, turn, {_INTENT('text')} AS intent FROM transcripts WHERE role = 'user'",
    "ses_tools": f"{_T}, c AS (SELECT conv_id, turn, c FROM (SELECT conv_id, turn, unnest(calls) AS c FROM transcripts)) SELECT t.conv_id, coalesce(list_sort(list(DISTINCT c.name) FILTER (c.name IS NOT NULL)), []) AS tools, coalesce(list_sort(list(DISTINCT c.path) FILTER (c.name IN ('Edit', 'Write'))), []) AS files, arg_max(regexp_replace(c.path, '/[^/]*$', ''), (c.turn, c.c.path)) AS folder FROM (SELECT DISTINCT conv_id FROM transcripts) t LEFT JOIN c ON c.conv_id = t.conv_id GROUP BY 1".replace("c.name", "c.c.name").replace("c.path, '/", "c.c.path, '/").replace("DISTINCT c.path", "DISTINCT c.c.path"),
    "ses_calls": f"{_T}, c AS (SELECT conv_id, turn, unnest(range(len(calls))) AS call, unnest(calls) AS c FROM transcripts) SELECT conv_id, turn, CAST(call AS INT) AS call, c.name AS name, CASE WHEN call <> 1 THEN c.result END AS result FROM c",
    "ses_approaches": f"{_T} SELECT conv_id, turn, {_APPROACH} AS approach FROM transcripts WHERE role = 'assistant'",
    "ses_domains": f"{_T} SELECT conv_id, turn, regexp_extract(c.path, '^/work/([^/]*)/', 1) AS domain FROM (SELECT conv_id, turn, unnest(calls) AS c FROM transcripts)",
    "ses_observations": _OBSERVED,
}
