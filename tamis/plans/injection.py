"""Registered queries on injected instructions and commands, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tamis.functions import injection_rules as ir
from tamis.operators import injection as inj
from tamis.plans import derived_sql as ds
from tamis.sources import derived
from tamis.sources.tables import table

OTHERS = [r for r in ir.RULES if ir.looks_around(r[2])]
#: For engines without backtracking, forms of the rules that look around which find the same in the given tables: a pattern,
#: and one that no evidence may match. None: nothing there is like it.
FORMS = {
    "role-override-identity-swap": (r"(?is)\byou\s+are\s+(?:no\s+longer|not)\s+\w+.{0,40}you\s+are\s+(?:now\s+)?\w+", None),
    "delimiter-xml-injection": (r"(?i)</?\s*(?:system|assistant|user|human|tool_result|function_response|message|prompt|instruction|context)\s*>", None),
    "evasion-homoglyph": (r"(?i)[А-яЀ-Џѐ-џ]{2,}.{0,120}?(?:ignore|system|prompt|instruction)", None),
    "indirect-comment-injection": (r"(?i)<!--[^>]*(?:ignore|system\s+prompt|instruction|override)[^>]*-->", None),
    "advanced-leetspeak": (r"(?i)[i1l][gq9][n|\\/][o0][r|][e3]\s+[a@4][l1][l1]\s+[p|][r|][e3][v|][i1l][o0][u|][s5$]", r"(?i)^ignore\s+all\s+previous"),
    "advanced-leetspeak-system": (r"(?i)[s5$][yh][s5$][t7][e3][m|]\s+[p|][r|][o0][m|][p|][t7]", r"(?i)^system\s+prompt"),
    "advanced-code-block-system": None,
    "advanced-padding-injection": None,
    "advanced-authority-code": None,
}


def _inbox(f):
    return lambda spark, folder: f(derived.inbox(table(spark, folder, "documents")))


def _commands(f):
    return lambda spark, folder: f(derived.command_log(table(spark, folder, "events")))


def _found(d):
    return inj.content_findings(d)


QUERIES = {
    "det_rules": _inbox(inj.scan_rules),
    "det_rules_backtracking": _inbox(lambda d: inj.scan_rules(d, OTHERS)),
    "det_rules_chosen": _inbox(lambda d: inj.scan_rules(d, [r for r in ir.RULES if r[0].startswith(("role", "exfil", "tool"))], least="critical", disabled=("exfil-positional",), custom=[("custom-flowers", "critical", "(?i)\\bplants need water\\b")], most=2).select("doc_id", "rule", "severity", "evidence")),
    "det_injected": _inbox(lambda d: inj.injected(d).select("doc_id", "injected")),
    "det_intents": _inbox(inj.intents),
    "det_arguments": _inbox(inj.arguments),
    "det_sensitive": _inbox(lambda d: d.select("doc_id", inj.sensitive(F.col("text")).alias("sensitive"))),
    "det_persistent": _inbox(inj.persistent_directives),
    "det_verdict": _inbox(lambda d: inj.verdicts(d, _found(d))),
    "det_windows": _inbox(inj.window_verdicts),
    "det_gate": _inbox(lambda d: inj.gate(_found(d))),
    "det_spotlight": _inbox(lambda d: inj.spotlight(d, "k").select("doc_id", F.sha2("text", 256).alias("sha"), inj.forged_mark(F.col("text")).alias("marked"))),
    "det_sanitize": _inbox(lambda d: inj.sanitize(d, inj.verdicts(d, _found(d)), "k").select("doc_id", "verdict", F.sha2("shown", 256).alias("shown_sha"), F.col("stored").isNotNull().alias("stored"))),
    "det_seams": _inbox(lambda d: inj.verdicts(d, inj.content_findings(inj.seams(d, "source", "text")))),
    "act_commands": _commands(lambda c: inj.judge_commands(c).select("event_id", "decision", "rule")),
    "act_writes": _commands(lambda c: inj.judge_writes(c).select("event_id", "decision", "rule")),
    "act_fetches": _commands(lambda c: c.select("event_id", inj.fetches_web(F.col("command")).alias("fetches"))),
    "act_public": _commands(lambda c: c.select("event_id", "url", inj.is_public(F.col("url")).alias("public"))),
}


def _evidence(c: str, pattern: str) -> str:
    e = f"regexp_extract({c}, {ds.re2(pattern)}, 0)"
    return f"CASE WHEN length({e}) > 120 THEN substr({e}, 1, 120) || '...' ELSE {e} END"


def _scan_sql(rules, source: str = "inbox", key: str = "doc_id") -> str:
    """CTE parts: plain(key, t, n) and found(key, ord, rule, severity, evidence, original)."""
    def one(c, i, r):
        form = FORMS.get(r[0], (r[2], None))
        if form is None:
            return []
        veto = f" AND NOT regexp_matches(regexp_extract({c}, {ds.re2(form[0])}, 0), {ds.re2(form[1])})" if form[1] else ""
        return [f"SELECT {key}, {i} AS ord, {ds.lit(r[0])} AS rule, '{r[1]}' AS severity, {_evidence(c, form[0])} AS evidence, {str(c == 't').lower()} AS original FROM plain WHERE regexp_matches({c}, {ds.re2(form[0])}){veto}"]

    rows = " UNION ALL ".join(x for i, r in enumerate(rules) for c in ("n", "t") for x in one(c, i, r))
    return f"plain AS MATERIALIZED (SELECT {key}, coalesce(text, '') AS t, {ds.decoded(chr(99) + 'oalesce(text, ' + chr(39) * 2 + ')')} AS n FROM {source}), every AS ({rows}), found AS (SELECT * FROM every QUALIFY row_number() OVER (PARTITION BY {key}, ord ORDER BY original) = 1)"


def _intent_sql(source: str = "inbox", key: str = "doc_id") -> str:
    low = "regexp_replace(lower(coalesce(text, '')), '[ \\t\\n\\r\\f]+', ' ', 'g')"
    parts = []
    for i, (name, phrases) in enumerate(ir.INTENTS.items()):
        w = " + ".join(f"CASE WHEN contains(t, {ds.lit(p)}) THEN {v}::DOUBLE ELSE 0::DOUBLE END" for p, v in phrases.items())
        n = " + ".join(f"CAST(contains(t, {ds.lit(p)}) AS INT)" for p in phrases)
        parts.append(f"SELECT {key}, t, tokens, {i} AS ord, '{name}' AS name, {w} AS w, {n} AS n, {sum(phrases.values())}::DOUBLE AS all_w FROM low")
    return f"""low AS (SELECT {key}, t, len(regexp_extract_all(t, '[a-z0-9]+|[^a-z0-9 \\t\\n\\r\\f]+')) AS tokens FROM (SELECT {key}, {low} AS t FROM {source})), kinds AS ({' UNION ALL '.join(parts)}),
scored AS (SELECT *, round(least(1.0, w / all_w * 0.7 + CASE WHEN n <= 1 AND w < 0.6 THEN n / greatest(tokens, 1) * 0.3 ELSE least(n / greatest(tokens, 1), 0.5) END * 0.6), 6) AS score FROM kinds),
intent AS (SELECT {key}, CASE WHEN score < 0.45 THEN 'clean' ELSE name END AS category, score, round(least(1.0, CASE WHEN trim(t) = '' THEN 1.0 WHEN score < 0.1 THEN 0.95 WHEN score < 0.2 THEN 0.7 WHEN score < 0.4 THEN score + 0.5 WHEN score < 0.6 THEN score * 0.3 + 0.6 ELSE score * 0.25 + 0.75 END), 6) AS confidence, CAST(n AS BIGINT) AS n_matched
FROM scored QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY score DESC, ord) = 1)"""


def _any(patterns, c: str) -> str:
    return "(" + " OR ".join(f"regexp_matches({c}, {ds.re2(p)})" for p in patterns) + ")"


def _arguments_sql() -> str:
    parts = []
    for name, severity, patterns, needs in ir.ARGUMENTS:
        last = name in ("logic-authority-impersonation", "logic-example-injection")
        order = list(reversed(patterns)) if last else patterns
        evidence = "CASE " + " ".join(f"WHEN regexp_matches(t, {ds.re2(p)}) THEN regexp_extract(t, {ds.re2(p)}, 0)" for p in order) + " END"
        sure = "1.0::DOUBLE"
        if name == "logic-authority-impersonation":
            sure = "CASE WHEN regexp_matches(t, '(?i)\\b(?:override|disable|bypass|lift|remove|ignore|forget)\\b') THEN 1.0::DOUBLE ELSE 0.6::DOUBLE END"
        if name == "logic-example-injection":
            sure = "CASE WHEN " + " + ".join(f"CAST(regexp_matches(t, {ds.re2(p)}) AS INT)" for p in patterns) + " >= 2 THEN 1.0::DOUBLE ELSE 0.7::DOUBLE END"
        level = f"CASE WHEN {sure} >= 0.9 THEN 'critical' ELSE 'high' END" if last else f"'{severity}'"
        parts.append(f"SELECT doc_id, '{name}' AS rule, {level} AS severity, substr({evidence}, 1, 200) AS evidence, {sure} AS confidence FROM b WHERE {_any(patterns, 't')}" + (f" AND {_any(ir.SENSITIVE, 't')}" if needs else ""))
    return f"WITH {ds.INBOX}, b AS (SELECT doc_id, text AS t FROM inbox WHERE length(text) >= 15) " + " UNION ALL ".join(parts)


_RANK = "CASE severity WHEN 'low' THEN 0 WHEN 'medium' THEN 1 WHEN 'high' THEN 2 ELSE 3 END"


def verdict_sql(source: str = "inbox", key: str = "doc_id", before: str = ds.INBOX, more: str = "") -> str:
    """CTE parts up to verdict(key, verdict, severity, labels). more: further findings, as UNION ALL SELECT ..."""
    return f"""WITH {before}, {_scan_sql(ir.RULES, source, key)}, {_intent_sql(source, key)},
hits AS (SELECT {key}, ord, rule, severity FROM found UNION ALL SELECT {key}, {len(ir.RULES)}, 'semantic-' || category, CASE WHEN score > 0.7 THEN 'critical' WHEN score > 0.5 THEN 'high' ELSE 'medium' END FROM intent WHERE score > 0.45 AND category <> 'clean'{more}),
ranked AS (SELECT *, {_RANK} AS r FROM hits),
g AS (SELECT {key}, max(r) AS worst, list(rule ORDER BY ord) AS rules, arg_min(rule, ord - 100000 * r) AS leads FROM ranked GROUP BY {key}),
verdict AS (SELECT {key}, CASE WHEN worst >= 3 THEN 'block' WHEN worst >= 2 THEN 'warn' ELSE 'allow' END AS verdict, (['low', 'medium', 'high', 'critical'])[worst + 1] AS severity, CASE WHEN leads IS NULL THEN [] ELSE list_slice(list_concat([leads], list_filter(rules, lambda x: x <> leads)), 1, 5) END AS labels FROM (SELECT DISTINCT {key} FROM {source}) LEFT JOIN g USING ({key}))"""


def _judge_sql(rules, source: str, texts: list[str]) -> str:
    def hit(kind):
        def on(name, pattern):
            extra = ""
            if "(?!.*\\.sample$)" in pattern:
                pattern, extra = pattern.replace("(?!.*\\.sample$)", ""), " AND NOT ends_with(lower(c), '.sample')"
            return "(" + " OR ".join(f"regexp_matches({t}, {ds.re2(pattern)})" for t in texts) + f"){extra}"

        return "CASE " + " ".join(f"WHEN {on(r, p)} THEN '{r}'" for r, d, p in rules if d == kind) + " END"

    return f"SELECT event_id, CASE WHEN deny IS NOT NULL THEN 'deny' WHEN ask IS NOT NULL THEN 'ask' ELSE 'allow' END AS decision, coalesce(deny, ask) AS rule FROM (SELECT event_id, {hit('deny')} AS deny, {hit('ask')} AS ask FROM {source})"


_COMMAND = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(command), '\\\\([A-Za-z0-9/.:_-])', '\\1', 'g'), '[''\"`]', '', 'g'), '\\$\\{IFS\\}|\\$IFS', ' ', 'g'), '[ \\t\\n\\r\\f]+', ' ', 'g')"
_HOST = "lower(regexp_extract(url, '(?i)^https?://(?:[^/?#@]*@)?(\\[[^\\]]*\\]|[^/?#:]*)', 1))"
_NUMBER = " + ".join(f"CAST(split_part(host, '.', {i + 1}) AS BIGINT) * {1 << (24 - 8 * i)}" for i in range(4))
_INSIDE = " OR ".join(f"n BETWEEN {a} AND {b}" for a, b in inj.reserved_ranges())
_MARK = "'⟦UNTRUSTED-DATA ' || substr(sha256('k' || CAST(doc_id AS VARCHAR)), 1, 16) || '⟧'"
_NEUTRAL = "regexp_replace({}, '(?i)[⟦\\[]+[\\s\\x{{200B}}-\\x{{200F}}\\x{{2060}}]*(UNTRUSTED-DATA)', '(\\1', 'g')"
_CHOSEN = [r for r in ir.RULES if r[0].startswith(("role", "exfil", "tool")) and r[1] == "critical" and r[0] != "exfil-positional"] + [("custom-flowers", "critical", "(?i)\\bplants need water\\b")]

ORACLE = {
    "det_rules_backtracking": f"WITH {ds.INBOX}, {_scan_sql(OTHERS)} SELECT * FROM found",
    "det_rules": f"WITH {ds.INBOX}, {_scan_sql(ir.RULES)} SELECT * FROM found",
    "det_rules_chosen": f"WITH {ds.INBOX}, {_scan_sql(_CHOSEN)} SELECT doc_id, rule, severity, evidence FROM found QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY original, ord) <= 2",
    "det_injected": f"WITH {ds.INBOX}, {_scan_sql(ir.RULES)} SELECT doc_id, doc_id IN (SELECT doc_id FROM found) AS injected FROM inbox",
    "det_intents": f"WITH {ds.INBOX}, {_intent_sql()} SELECT * FROM intent",
    "det_arguments": _arguments_sql(),
    "det_sensitive": f"WITH {ds.INBOX} SELECT doc_id, {_any(ir.SENSITIVE, 'text')} AS sensitive FROM inbox",
    "det_persistent": f"""WITH {ds.INBOX}, t AS (SELECT doc_id, text AS t FROM inbox), r AS (SELECT doc_id, CASE WHEN {_any([ir.EXPOSE], 't')} AND {_any([ir.SECRET_FILE], 't')} THEN 'sends a key file'
WHEN ({_any([ir.RUN], 't')} AND {_any([ir.SCRIPT_URL], 't')} AND (regexp_matches(t, '(?i)http://') OR {_any([ir.STANDING], 't')})) OR ({_any([ir.STANDING], 't')} AND regexp_matches(t, '(?i)https?://') AND {_any([ir.FETCH], 't')} AND {_any([ir.TO_SHELL], 't')}) THEN 'fetches and runs a script' END AS reason FROM t) SELECT * FROM r WHERE reason IS NOT NULL""",
    "det_verdict": verdict_sql() + " SELECT * FROM verdict",
    "det_gate": verdict_sql() + " SELECT doc_id, count(*) AS violations, (['low', 'medium', 'high', 'critical'])[max(r) + 1] AS worst FROM ranked WHERE r >= 2 GROUP BY doc_id",
    "det_windows": verdict_sql("wins", "k", ds.INBOX + f", wins AS (SELECT doc_id * 100000 + s AS k, doc_id, substr(text, s * {inj.STEP} + 1, {inj.WINDOW}) AS text FROM (SELECT doc_id, text, unnest(range(0, CASE WHEN length(text) <= {inj.WINDOW} THEN 1 ELSE CAST(ceil(length(text) / {inj.STEP}) AS BIGINT) END)) AS s FROM inbox))") + " SELECT k // 100000 AS doc_id, (['allow', 'warn', 'block'])[max(CASE verdict WHEN 'block' THEN 3 WHEN 'warn' THEN 2 ELSE 1 END)] AS verdict, count(*) AS windows FROM verdict GROUP BY 1",
    "det_spotlight": f"WITH {ds.INBOX} SELECT doc_id, sha256({_MARK} || ' BEGIN' || chr(10) || {_NEUTRAL.format('text')} || chr(10) || {_MARK} || ' END') AS sha, true AS marked FROM inbox",
    "det_seams": verdict_sql("seam", "doc_id", ds.INBOX + ", seam AS (SELECT doc_id, right(coalesce(source, ''), 2048) || chr(10) || left(text, 2048) AS text FROM inbox)") + " SELECT * FROM verdict",
    "act_commands": f"WITH {ds.COMMANDS}, c AS (SELECT event_id, {_COMMAND} AS c, trim(command) AS raw FROM commands) " + _judge_sql(ir.COMMANDS, "c", ["c", "raw"]),
    "act_writes": f"WITH {ds.COMMANDS}, c AS (SELECT event_id, path AS c FROM commands) " + _judge_sql(ir.PATHS, "c", ["c"]),
    "act_fetches": f"WITH {ds.COMMANDS} SELECT event_id, regexp_matches(command, '(?i)\\b(?:curl|wget|Invoke-WebRequest|iwr|Invoke-RestMethod|irm)\\b') AND regexp_matches(command, '(?i)\\bhttps?://') AS fetches FROM commands",
    "act_public": f"""WITH {ds.COMMANDS}, h AS (SELECT event_id, url, {_HOST} AS host FROM commands), v AS (SELECT *, CASE WHEN regexp_matches(host, '^\\d{{1,3}}(\\.\\d{{1,3}}){{3}}$') THEN {_NUMBER} END AS n FROM h)
SELECT event_id, url, CASE WHEN host = '' THEN false WHEN n IS NOT NULL THEN NOT ({_INSIDE}) WHEN starts_with(host, '[') THEN NOT regexp_matches(host, '^\\[(::1|::|fe[89ab].*|f[cd].*|::ffff:.*)\\]$') ELSE NOT regexp_matches(host, '^(localhost|.*\\.localhost|.*\\.local|.*\\.internal)$') END AS public FROM v""",
}
