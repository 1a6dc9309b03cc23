"""Registered queries on changes, activity and streams, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tamis.operators import audit, injection as inj, sessions, tripwire as tw
from tamis.plans import derived_sql as ds
from tamis.plans.knowledge import _talks
from tamis.sources import derived
from tamis.sources.tables import table
from tamis.streaming import guards

NOW = "2024-01-20 00:00:00"


def _docs(s, f):
    return table(s, f, "documents")


def _units(s, f):
    return audit.unit_diff(audit.line_units(_docs(s, f)), audit.line_units(derived.inbox(_docs(s, f))))


def _lines(s, f):
    """Lines of the changed documents: added at every third place, by one of two writers."""
    rows = derived.inbox(_docs(s, f)).select("doc_id", F.posexplode(F.split("text", "\\n")).alias("pos", "unit"))
    return rows.withColumn("added", (F.col("pos") + F.col("doc_id")) % 3 != 0).withColumn("writer", F.when(F.col("pos") % 7 < 4, "a").otherwise("b"))


def _writes(s, f):
    return table(s, f, "events").select("user_id", "ts", "event_id", F.col("event_type").alias("writer"))


def _changes(s, f):
    e = table(s, f, "events").where("event_type = 'purchase'")
    return e.select("event_id", "user_id", "ts")


def _tiered(s, f):
    d = derived.inbox(_docs(s, f))
    threat = inj.standing_directive(F.col("text"))
    rules = [("S2", "SUSPECT", threat.isNotNull()), ("H1", "HOLD", inj.sensitive(F.col("text"))), ("N1", "NOTICE", F.col("doc_id") % 2 == 0)]
    return tw.tiers(d, rules).select("doc_id", "rules", "tier")


def _sessions(s, f):
    m = table(s, f, "conversations")
    r = sessions.session_rollup(m).select("conv_id", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("conv_id") % 9).cast("int")).alias("day"), F.col("summary").alias("title"), "n_messages", F.concat(F.lit("p"), F.col("conv_id") % 5).alias("project"))
    t = sessions.session_topics(m, least=1).groupBy(F.col("conv_id").alias("_c")).agg(F.collect_set("topic").alias("topics"))
    return r.join(t, F.col("conv_id") == F.col("_c"), "left").drop("_c")


def _exposed(s, f):
    e = table(s, f, "events")
    levels = audit.exposure_levels(e, "error", "purchase").select("event_id", "level")
    actions = inj.judge_commands(derived.command_log(e)).select(F.col("event_id").alias("_e"), "user_id", "decision")
    return tw.escalated(actions.join(levels, F.col("_e") == F.col("event_id"))).select("event_id", "decision", "level", "final")


def _indicators(s, f):
    return audit.novel_tokens(audit.actionable_tokens(derived.command_log(table(s, f, "events").where("event_id % 3 = 0")), "event_id", "command"), audit.actionable_tokens(_docs(s, f)))


QUERIES = {
    "aud_unit_diff": lambda s, f: _units(s, f).select("doc_id", "unit", "nth", "change"),
    "aud_hunks": lambda s, f: tw.hunks(_lines(s, f)).select("doc_id", "writer", "first_pos", "lines", F.sha2("text", 256).alias("sha")),
    "aud_budget": lambda s, f: tw.within_budget(tw.hunks(_lines(s, f)), 500, F.length("text")).select("doc_id", "first_pos", "screened"),
    "aud_attribution": lambda s, f: audit.attribute_changes(_changes(s, f).groupBy("user_id").agg(F.min("ts").alias("accepted_at")), _writes(s, f), "user_id").select("user_id", "accepted_at", "written_at"),
    "aud_inside": lambda s, f: tw.inside_activity(_changes(s, f), audit.activity_windows(table(s, f, "events").where("event_type = 'error'"), 2, 3600)),
    "aud_tiers": _tiered,
    "aud_baseline": lambda s, f: tw.next_baseline(_docs(s, f), derived.inbox(_docs(s, f)), _tiered(s, f)).select("doc_id", F.sha2("text", 256).alias("sha"), "held"),
    "aud_again": lambda s, f: tw.accepted_again(derived.inbox(_docs(s, f)).select("doc_id", F.sha2(F.when(F.col("doc_id") % 2 == 0, F.col("text")).otherwise(F.regexp_replace("text", "\\n[^\\n]*$", "")), 256).alias("sha")), _docs(s, f).select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha")), "doc_id").select("doc_id", "silent"),
    "aud_tripwire": lambda s, f: tw.tripped(derived.command_log(table(s, f, "events")), _indicators(s, f)),
    "aud_novel": _indicators,
    "aud_retained": lambda s, f: tw.retained(table(s, f, "events"), F.lit(NOW).cast("timestamp")).select("event_id"),
    "aud_escalated": _exposed,
    "sink_index": lambda s, f: tw.session_index(_sessions(s, f)),
    "sink_digest": lambda s, f: tw.daily_digest(_sessions(s, f)),
    "sink_export": _talks(lambda m: guards.guard_stream(m).select("conv_id", "turn", "role", F.sha2("masked", 256).alias("sha"), "secrets_redacted")),
    "str_guard": lambda s, f: guards.streamed(s, f, "documents", lambda d: guards.guard_stream(d).select("doc_id", "verdict", F.col("secrets_redacted").cast("long").alias("secrets_redacted"))),
    "str_actions": lambda s, f: guards.streamed(s, f, "events", lambda e: inj.judge_commands(derived.command_log(e)).select("event_id", "decision", "rule")),
    "str_tripwire": lambda s, f: guards.streamed(s, f, "events", lambda e: tw.tripped(derived.command_log(e), _indicators(s, f))),
    "str_counts": lambda s, f: guards.streamed(s, f, "events", lambda e: guards.counts_by_window(e, "1 hour", "1 day"), "complete"),
    "str_sliding": lambda s, f: guards.streamed(s, f, "events", lambda e: guards.counts_by_window(e, "2 hours", "1 day", "1 hour"), "complete"),
    "str_bursts": lambda s, f: guards.streamed(s, f, "events", lambda e: guards.bursts(e, "10 minutes", "1 day"), "complete"),
    "str_once": lambda s, f: guards.streamed(s, f, "events", lambda e: guards.once(e, "1 day").select("event_id", "user_id")),
    "str_exposure": lambda s, f: guards.streamed(s, f, "events", lambda e: guards.exposure_stream(e, "error", "purchase"), "complete"),
}

_LINE_UNITS = lambda src: f"SELECT doc_id, unit, CAST(row_number() OVER (PARTITION BY doc_id, unit ORDER BY p) AS INT) AS nth FROM (SELECT doc_id, unnest(range(len(l))) AS p, trim(unnest(l)) AS unit FROM (SELECT doc_id, string_split_regex(text, '\\r?\\n') AS l FROM {src})) WHERE unit <> ''"
_HUNKS = f"""WITH {ds.INBOX}, l AS (SELECT doc_id, unnest(range(len(ls))) AS pos, unnest(ls) AS unit FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM inbox)), a AS (SELECT *, CASE WHEN pos % 7 < 4 THEN 'a' ELSE 'b' END AS writer FROM l WHERE (pos + doc_id) % 3 <> 0),
m AS (SELECT *, CASE WHEN pos - lag(pos) OVER w = 1 AND writer = lag(writer) OVER w THEN 0 ELSE 1 END AS new FROM a WINDOW w AS (PARTITION BY doc_id ORDER BY pos)), i AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM m),
hunk AS (SELECT doc_id, min(writer) AS writer, CAST(min(pos) AS INT) AS first_pos, count(*) AS lines, string_agg(unit, chr(10) ORDER BY pos) AS text FROM i GROUP BY doc_id, island)"""
_WINDOWS = """s AS (SELECT user_id, ts - INTERVAL 2 SECOND AS a, ts + INTERVAL 3600 SECOND AS b FROM events WHERE event_type = 'error'), m AS (SELECT *, max(b) OVER (PARTITION BY user_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR a > reach THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island FROM m), win AS (SELECT user_id, min(a) AS opened, max(b) AS closed FROM i GROUP BY user_id, island)"""


def _tier_sql() -> str:
    from tamis.functions import injection_rules as ir
    from tamis.plans.injection import _any
    from tamis.plans.knowledge import _STANDING

    return f"flags AS (SELECT doc_id, {_STANDING('text')} AS s2, {_any(ir.SENSITIVE, 'text')} AS h1, doc_id % 2 = 0 AS n1 FROM inbox), tiered AS (SELECT doc_id, list_filter([CASE WHEN s2 THEN 'S2' END, CASE WHEN h1 THEN 'H1' END, CASE WHEN n1 THEN 'N1' END], lambda x: x IS NOT NULL) AS rules, CASE WHEN s2 THEN 'SUSPECT' WHEN h1 THEN 'HOLD' WHEN n1 THEN 'NOTICE' ELSE 'SILENT' END AS tier FROM flags)"


def _token_sql(source: str, key: str, c: str) -> str:
    kinds = {"email": "[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}", "url": "https?://[^ \\t\\n\\r\\f\"''<>)]+", "path": "~/[A-Za-z0-9._/-]+"}
    return "SELECT DISTINCT " + key + ", kind, lower(token) AS token FROM (" + " UNION ALL ".join(f"SELECT {key}, '{k}' AS kind, unnest(regexp_extract_all({c}, '{p}')) AS token FROM {source}" for k, p in kinds.items()) + ")"


_NOVEL = f"WITH {ds.COMMANDS}, third AS (SELECT * FROM commands WHERE event_id % 3 = 0), known AS ({_token_sql('documents', 'doc_id', 'text')}), novel AS (SELECT event_id, kind, token FROM ({_token_sql('third', 'event_id', 'command')}) WHERE (kind, token) NOT IN (SELECT (kind, token) FROM known))"
_TRIP = f"{_NOVEL} SELECT event_id, kind, token FROM ({_token_sql('commands', 'event_id', 'command')}) WHERE (kind, token) IN (SELECT (kind, token) FROM novel)"


def _commands_sql() -> str:
    from tamis.plans.injection import ORACLE as INJECTION

    return INJECTION["act_commands"]


ORACLE = {
    "aud_unit_diff": f"WITH {ds.INBOX}, a AS ({_LINE_UNITS('documents')}), b AS ({_LINE_UNITS('inbox')}) SELECT *, 'added' AS change FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a) UNION ALL SELECT *, 'removed' FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)",
    "aud_hunks": f"{_HUNKS} SELECT doc_id, writer, first_pos, lines, sha256(text) AS sha FROM hunk",
    "aud_budget": f"{_HUNKS} SELECT doc_id, first_pos, sum(length(text)) OVER (PARTITION BY doc_id ORDER BY length(text), first_pos ROWS UNBOUNDED PRECEDING) <= 500 AS screened FROM hunk",
    "aud_attribution": "WITH c AS (SELECT user_id, min(ts) AS accepted_at FROM events WHERE event_type = 'purchase' GROUP BY 1) SELECT c.user_id, accepted_at, min(ts) AS written_at FROM c LEFT JOIN events e ON e.user_id = c.user_id AND ts > accepted_at GROUP BY 1, 2",
    "aud_inside": f"WITH {_WINDOWS} SELECT event_id, user_id, ts, EXISTS (SELECT 1 FROM win w WHERE w.user_id = e.user_id AND e.ts BETWEEN opened AND closed) AS inside FROM events e WHERE event_type = 'purchase'",
    "aud_tiers": f"WITH {ds.INBOX}, {_tier_sql()} SELECT * FROM tiered",
    "aud_baseline": f"WITH {ds.INBOX}, {_tier_sql()} SELECT d.doc_id, sha256(CASE WHEN tier IN ('SILENT', 'NOTICE') THEN i.text ELSE d.text END) AS sha, tier NOT IN ('SILENT', 'NOTICE') AS held FROM documents d JOIN inbox i ON i.doc_id = d.doc_id JOIN tiered t ON t.doc_id = d.doc_id",
    "aud_again": f"WITH {ds.INBOX} SELECT i.doc_id, CASE WHEN i.doc_id % 2 = 0 THEN i.text ELSE regexp_replace(i.text, '\\n[^\\n]*$', '') END = coalesce(d.text, '') AS silent FROM inbox i JOIN documents d USING (doc_id)",
    "aud_novel": f"{_NOVEL} SELECT * FROM novel",
    "aud_tripwire": _TRIP,
    "aud_retained": f"SELECT event_id FROM events WHERE ts >= TIMESTAMP '{NOW}' - INTERVAL 30 DAY QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 8",
    "aud_escalated": f"WITH c AS ({_commands_sql()}), l AS (SELECT event_id, (['clean', 'exposed', 'tainted'])[1 + max(CASE event_type WHEN 'error' THEN 2 WHEN 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)] AS level FROM events) SELECT event_id, decision, level, CASE WHEN level = 'tainted' AND decision = 'ask' THEN 'deny' WHEN level = 'tainted' AND decision = 'allow' THEN 'ask' ELSE decision END AS final FROM c JOIN l USING (event_id)",
    "str_actions": _commands_sql(),
    "str_tripwire": _TRIP,
    "str_counts": "SELECT date_trunc('hour', ts) AS opened, date_trunc('hour', ts) + INTERVAL 1 HOUR AS closed, event_type, count(*) AS n FROM events GROUP BY 1, 2, 3",
    "str_sliding": "SELECT date_trunc('hour', ts) - k * INTERVAL 1 HOUR AS opened, date_trunc('hour', ts) - k * INTERVAL 1 HOUR + INTERVAL 2 HOUR AS closed, event_type, count(*) AS n FROM events, (SELECT unnest([0, 1]) AS k) GROUP BY 1, 2, 3",
    "str_bursts": "WITH m AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 10 MINUTE THEN 0 ELSE 1 END AS new FROM events), i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS island FROM m) SELECT user_id, min(ts) AS opened, max(ts) + INTERVAL 10 MINUTE AS closed, count(*) AS n FROM i GROUP BY user_id, island",
    "str_once": "SELECT DISTINCT event_id, user_id FROM events",
    "str_exposure": "SELECT user_id, (['clean', 'exposed', 'tainted'])[1 + max(CASE event_type WHEN 'error' THEN 2 WHEN 'purchase' THEN 1 ELSE 0 END)] AS level FROM events GROUP BY 1",
}
