"""Registered queries on directives to agents and on capabilities of commands and texts, with their SQL."""

from __future__ import annotations

from tamis.functions import capability_rules as cr
from tamis.functions import directive_rules as dr
from tamis.operators import capabilities as cap
from tamis.operators import directives as di
from tamis.operators import injection as inj
from tamis.plans import derived_sql as ds
from tamis.plans.injection import verdict_sql
from tamis.sources import derived
from tamis.sources.tables import table


def _notices(f):
    return lambda spark, folder: f(derived.notices(table(spark, folder, "documents")))


def _commands(f):
    return lambda spark, folder: f(derived.command_log(table(spark, folder, "events")))


def _judged(d):
    return inj.verdicts(d, inj.content_findings(d).unionByName(di.directive_findings(d)))


QUERIES = {
    "det_directives": _notices(lambda d: di.agent_directives(d)),
    "det_directive_decides": _notices(lambda d: di.directive_findings(d, first=0)),
    "det_directive_verdict": _notices(_judged),
    "det_capabilities": _notices(lambda d: cap.content_capabilities(d)),
    "act_capabilities": _commands(lambda c: cap.command_capabilities(c)),
    "act_decisions": _commands(lambda c: cap.decide(c, cap.command_capabilities(c))),
}


def _m(t: str, pattern: str) -> str:
    return f"regexp_matches({t}, {ds.re2(pattern)})"


def holds(t: str, condition) -> str:
    """A condition over signals in SQL."""
    if isinstance(condition, str):
        return _m(t, cr.SIGNALS[condition])
    kind, *parts = condition
    if kind in ("all", "any"):
        return "(" + (" AND " if kind == "all" else " OR ").join(holds(t, p) for p in parts) + ")"
    if kind == "within":
        return f"len(list_filter(regexp_extract_all({t}, {ds.re2(parts[0])}), lambda x: {_m('x', parts[1])})) > 0"
    if kind == "urls":
        return f"len(list_filter(regexp_extract_all({t}, {ds.re2(parts[0])}, 1), lambda x: NOT {_m('x', parts[1])})) > 0"
    stages = f"list_filter(list_transform(string_split_regex({t}, '\\|+'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '')"
    at = f"list_position(list_transform({stages}, lambda x: {_m('x', parts[0])}), true)"
    later = _m("x", parts[1]) + (f" OR {_m('x', cr.SIGNALS['sends'])}" if kind == "dump" else "")
    return f"(coalesce({at}, 0) > 0 AND len(list_filter(({stages})[coalesce({at}, 0) + 1:], lambda x: {later})) > 0)"


def resolved(t: str, keep_lines: bool) -> str:
    for pattern, put in ((r'"?\$\{HOME:0:1\}"?', "/"), (r"\$\{(?:HOME|PWD|ROOT)[^}]*\}", "/__ROOTED__"), (r"\\([A-Za-z0-9/.:_-])", "\\1"), ("['\"`]", ""), (r"\$\{IFS\}|\$IFS", " "), *([(r"\\\r?\n", " "), (r"[ \t\r\f\x0B]+", " ")] if keep_lines else [(r"[ \t\n\r\f\x0B]+", " ")])):
        t = f"regexp_replace({t}, {ds.lit(pattern)}, {ds.lit(put)}, 'g')"
    return f"trim({t})"


def _capabilities(source: str, key: str, forms: list[str], kind: str) -> str:
    """Rows (key, ord, capability, decision): of each group the first that a form has."""
    parts = []
    for i, (name, group, decision, where, condition) in enumerate(cr.CAPABILITIES):
        if where in ("both", kind):
            parts += [f"SELECT {key}, w, '{f}' AS form, '{group}' AS g, {i} AS ord, '{name}' AS capability, '{decision}' AS decision FROM {source} WHERE {holds(f, condition)}" for f in forms]
    return f"SELECT DISTINCT {key}, ord, capability, decision FROM (SELECT * FROM ({' UNION ALL '.join(parts)}) QUALIFY ord = min(ord) OVER (PARTITION BY {key}, w, form, g))"


#: A block ends behind the last line end among its first 1,001 characters but the first, or behind its first line.
_TAIL = "length(regexp_extract(substr(rest, 1, 1001), '[^\\n]*\\z'))"
_CUT = f"CASE WHEN length(rest) <= 1000 THEN length(rest) WHEN length(substr(rest, 1, 1001)) - {_TAIL} >= 2 THEN length(substr(rest, 1, 1001)) - {_TAIL} WHEN rest[1] = chr(10) THEN 1 WHEN strpos(rest, chr(10)) > 0 THEN strpos(rest, chr(10)) ELSE length(rest) END"
_WINDOWS = f"""cutting(doc_id, i, block, rest) AS (SELECT doc_id, 0, '', text FROM notices UNION ALL SELECT doc_id, i + 1, substr(rest, 1, {_CUT}), substr(rest, 1 + {_CUT}) FROM cutting WHERE rest <> ''),
b AS (SELECT doc_id, list(block ORDER BY i) AS bs FROM cutting WHERE i > 0 GROUP BY doc_id), windows AS MATERIALIZED (SELECT doc_id, w, raw, {resolved('raw', True)} AS res FROM (SELECT doc_id, w, bs[w] || coalesce(bs[w + 1], '') AS raw FROM (SELECT doc_id, bs, unnest(range(1, greatest(2, len(bs)))) AS w FROM b WHERE len(bs) > 0) WHERE {_m('raw', cap.HINT)})),
caps AS MATERIALIZED ({_capabilities('windows', 'doc_id', ['raw', 'res'], 'content')})"""
_ALL_WINDOWS = _WINDOWS.replace(f" WHERE {_m('raw', cap.HINT)}", "")
_COMMAND_CAPS = f"c AS MATERIALIZED (SELECT event_id, 0 AS w, {resolved('command', False)} AS res FROM commands), caps AS ({_capabilities('c', 'event_id', ['res'], 'command')})"
_FOLD = f"translate(regexp_replace(text, {ds.lit(dr.INVISIBLE)}, '', 'g'), '{''.join(dr.CONFUSABLES)}', '{''.join(dr.CONFUSABLES.values())}')"


def _spans(source: str, key: str, t: str, patterns: dict[str, str]) -> str:
    each = " UNION ALL ".join(f"SELECT {key}, '{k}' AS kind, string_split_regex({t}, {ds.re2(p)}) AS gaps, regexp_extract_all({t}, {ds.re2(p)}) AS hits FROM {source}" for k, p in patterns.items())
    return f"(SELECT {key}, kind, e - h AS b, e FROM (SELECT {key}, kind, h, sum(g + h) OVER (PARTITION BY {key}, kind ORDER BY i) AS e FROM (SELECT {key}, kind, i, length(gaps[i]) AS g, length(hits[i]) AS h FROM (SELECT {key}, kind, gaps, hits, unnest(range(1, len(hits) + 1)) AS i FROM ({each})))))"


def _near(name: str, a: str, b: str) -> str:
    spans = _spans("(SELECT * FROM n WHERE " + _m("t", a) + " AND " + _m("t", b) + ")", "doc_id", "t", {"a": a, "b": b})
    return f"SELECT DISTINCT x.doc_id, '{name}' AS directive FROM {spans} x JOIN {spans} y ON x.doc_id = y.doc_id AND x.kind = 'a' AND y.kind = 'b' AND y.b >= x.b - {dr.NEAR} AND y.e <= x.e + {dr.NEAR}"


def _agent(t: str) -> str:
    return f"({_m(t, dr.ADDRESSED)} AND {_m(t, dr.ACTION)} AND ({_m(t, dr.STRONG_SECRET)} OR {_m(t, dr.WEAK_SECRET)} OR ({_m(t, '(?i)https?://')} AND {_m(t, dr.SENDS_TO_URL)})))"


_SENTENCES = f"(SELECT * FROM (SELECT doc_id, unnest(range(len(ss))) AS s, unnest(ss) AS t FROM (SELECT doc_id, string_split_regex(t, {ds.lit(dr.SENTENCE_END)}) AS ss FROM n)) WHERE {_m('t', dr.OVERRIDE)} AND {_m('t', dr.RULES_NOUN)})"
_SIGNS = _spans(_SENTENCES, "doc_id, s", "t", {"verb": dr.OVERRIDE, "object": dr.RULES_NOUN, "negation": dr.NEGATION})
_AHEAD = f"(SELECT n.doc_id, string_split(substr(t, CAST(e AS BIGINT) + 1, {dr.FETCH_REACH}), chr(10))[1] AS x FROM n JOIN {_spans('n', 'doc_id', 't', {'f': dr.FETCH_TOOL})} f ON f.doc_id = n.doc_id)"
_REMOTE = f"SELECT doc_id FROM {_AHEAD} WHERE CASE WHEN regexp_extract(x, {ds.re2(dr.HOST)}, 1) <> '' THEN NOT regexp_matches(regexp_extract(x, {ds.re2(dr.HOST)}, 1), {ds.re2(dr.LOOPBACK)}) ELSE NOT {_m('x', dr.LOOPBACK_NAMED)} END"
_PLAIN = {
    "directive-assemble-run": f"{_m('t', dr.COMMAND_RUN)} AND doc_id IN ({_REMOTE})",
    "directive-secret-in-url": f"len(list_filter(regexp_extract_all(t, {ds.re2(dr.URL)}), lambda x: {_m('x', dr.SECRET_IN_URL)})) > 0 OR {_m('t', dr.TOKEN_MARKER)}",
    "directive-role-hijack": _m("t", dr.ROLE),
    "directive-registry-repoint": f"regexp_extract(t, {ds.re2(dr.REGISTRY)}, 1) <> '' AND NOT regexp_matches(regexp_extract(t, {ds.re2(dr.REGISTRY)}, 1), {ds.re2(dr.OFFICIAL)})",
    "directive-approve-merge": f"({_m('t', dr.APPROVES)} AND {_m('t', dr.WAIVES)}) OR ({_m('t', dr.REVIEWER)} AND {_m('t', dr.EXCUSES)})",
    "directive-output-exfil": _m("t", dr.OUTPUT_AWAY),
    "directive-pii-public": _m("t", dr.PRIVATE_OUT),
    "directive-agent-addressed": f"{_agent('t')} AND len(list_filter(string_split_regex(t, {ds.lit(dr.PARAGRAPH)}), lambda x: {_agent('x')})) > 0",
    "directive-http-installer": f"{_m('t', cr.SIGNALS['fetches_plain_http'])} AND doc_id IN (SELECT doc_id FROM caps WHERE capability = 'fetch-exec-pipe')",
    "directive-fetch-exec": f"doc_id IN (SELECT doc_id FROM caps WHERE capability IN ({', '.join(map(ds.lit, dr.FETCH_EXEC))}))",
}
_EVERY = " UNION ALL ".join(
    [f"SELECT doc_id, '{name}' AS directive FROM n WHERE {c}" for name, c in _PLAIN.items()]
    + [_near("directive-decode-run", dr.ENCODED, dr.RUNS), _near("directive-secret-exfil", dr.STRONG_SECRET, dr.EXPOSE), _near("directive-secret-exfil", dr.WEAK_SECRET, dr.SEND), _near("directive-tls-downgrade", dr.TLS_OFF, dr.AGENT_FRAMING)]
    + [f"""SELECT DISTINCT v.doc_id, 'directive-override' FROM signs v WHERE v.kind = 'verb' AND EXISTS (SELECT 1 FROM signs o WHERE o.doc_id = v.doc_id AND o.s = v.s AND o.kind = 'object' AND o.b >= v.b - {dr.REACH} AND o.b < v.e + {dr.REACH})
AND NOT EXISTS (SELECT 1 FROM signs o WHERE o.doc_id = v.doc_id AND o.s = v.s AND o.kind = 'negation' AND o.e <= v.b AND o.b >= v.b - {dr.NEGATED})"""]
)
_ORDER = f"CAST(list_position([{', '.join(map(ds.lit, dr.DIRECTIVES))}], directive) - 1 AS INTEGER)"
_DIRECTIVES = f"{ds.NOTICES}, n AS MATERIALIZED (SELECT doc_id, {_FOLD} AS t FROM notices), {_WINDOWS}, signs AS MATERIALIZED (SELECT * FROM {_SIGNS}), directives AS (SELECT DISTINCT doc_id, {_ORDER} AS ord, directive FROM ({_EVERY}))"

ORACLE = {
    "det_directives": f"WITH RECURSIVE {_DIRECTIVES} SELECT * FROM directives",
    "det_directive_decides": f"WITH RECURSIVE {_DIRECTIVES} SELECT doc_id, min(ord) AS ord, arg_min(directive, ord) AS rule, 'high' AS severity FROM directives GROUP BY doc_id",
    "det_directive_verdict": "WITH RECURSIVE" + verdict_sql("notices", "doc_id", _DIRECTIVES, " UNION ALL SELECT doc_id, min(ord) + 10000, arg_min(directive, ord), 'high' FROM directives GROUP BY doc_id").removeprefix("WITH") + " SELECT * FROM verdict",
    "det_capabilities": f"WITH RECURSIVE {ds.NOTICES}, {_ALL_WINDOWS} SELECT * FROM caps",
    "act_capabilities": f"WITH {ds.COMMANDS}, {_COMMAND_CAPS} SELECT * FROM caps",
    "act_decisions": f"WITH {ds.COMMANDS}, {_COMMAND_CAPS} SELECT event_id, CASE min(CASE decision WHEN 'deny' THEN 0 WHEN 'ask' THEN 1 END) WHEN 0 THEN 'deny' WHEN 1 THEN 'ask' ELSE 'allow' END AS decision, arg_min(capability, ord) AS capability FROM commands LEFT JOIN (SELECT * FROM caps QUALIFY rank() OVER (PARTITION BY event_id ORDER BY decision = 'deny' DESC) = 1) USING (event_id) GROUP BY event_id",
}
