"""Registered queries on source files, settings and tests, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tamis.operators import code, files as fl
from tamis.plans import derived_sql as ds
from tamis.sources import derived
from tamis.sources.tables import table

IGNORED = ["*.7", ".env.1*", "build/", "# comment"]
NOW = "2024-06-01 00:00:00"


def _files(f):
    return lambda spark, folder: f(derived.source_files(table(spark, folder, "documents")))


def _patterns(f):
    return f.sparkSession.createDataFrame([(p,) for p in IGNORED], "pattern string")


def _added(f):
    return code.code_lines(f).where("line_no % 2 = 1").select("path", "line_no")


def _versions(f):
    entries = fl.settings(f)
    return fl.missing_settings(entries.where("line_no < 5"), entries.where("key like 'D%'"))


QUERIES = {
    "code_lines": _files(code.line_findings),
    "code_empty_catch": _files(code.empty_catches),
    "code_unreachable": _files(code.unreachable_lines),
    "code_function_lengths": _files(code.function_lengths),
    "code_long_functions": _files(lambda f: code.long_functions(f, 4)),
    "code_deep_nesting": _files(lambda f: code.deep_nesting(f, 3)),
    "code_nested_loops": _files(code.nested_loops),
    "code_sync_calls": _files(code.sync_calls),
    "code_unused_imports": _files(code.unused_imports),
    "code_commented": _files(code.commented_code),
    "code_scores": _files(lambda f: code.review_scores(f, code.review(f))),
    "code_diff_review": _files(lambda f: code.diff_review(code.line_findings(f), _added(f)).select("path", "line_no", "rule")),
    "code_repeated_blocks": _files(lambda f: fl.repeated_blocks(f.select(F.lit("all").alias("path"), F.concat("content", F.lit("\n"), "content", F.lit("\n"), "content", F.lit("\n"), "content").alias("content"), F.col("path").alias("p")).select(F.col("p").alias("path"), "content"))),
    "map_inventory": _files(fl.inventory),
    "map_imports": _files(fl.imports),
    "map_exports": _files(lambda f: code.names_of(f, code.EXPORTS)),
    "map_functions": _files(lambda f: code.names_of(f, code.FUNCTIONS)),
    "map_classes": _files(lambda f: code.names_of(f, code.CLASSES)),
    "map_dependencies": _files(fl.dependencies),
    "map_entry_points": _files(lambda f: fl.entry_points(f, fl.dependencies(f))),
    "map_hotspots": _files(lambda f: fl.hotspots(fl.dependencies(f))),
    "map_languages": _files(lambda f: code.language_totals(fl.inventory(f))),
    "map_folders": _files(lambda f: code.folder_summary(f, fl.dependencies(f))),
    "cfg_settings": _files(fl.settings),
    "cfg_issues": _files(lambda f: code.setting_issues(fl.settings(f))),
    "cfg_unignored": _files(lambda f: code.unignored_secrets(fl.settings(f), _patterns(f))),
    "cfg_conflicts": _files(lambda f: fl.conflicting_settings(fl.settings(f))),
    "cfg_missing": _files(_versions),
    "cfg_undefined": _files(code.undefined_settings),
    "tst_inventory": _files(code.test_inventory),
    "tst_broken_imports": _files(code.broken_imports),
    "tst_stale_mocks": _files(code.stale_mocks),
    "tst_outdated": _files(lambda f: code.outdated_tests(f.unionByName(f.select(F.regexp_replace("path", r"\.(test\.)?ts$", "_copy.js").alias("path"), "content", (F.col("mtime") + F.expr("interval 1 day")).alias("mtime")).withColumn("path", F.regexp_replace("path", "_copy", ""))), NOW)),
    "tst_untested": _files(code.untested_sources),
}

_L = f"WITH RECURSIVE {ds.FILES}, js AS (SELECT * FROM files WHERE regexp_matches(path, '\\.(ts|tsx|js|jsx|mjs|cjs)$')), lines AS (SELECT path, unnest(range(1, len(ls) + 1)) AS line_no, unnest(ls) AS line FROM (SELECT path, string_split(content, chr(10)) AS ls FROM files))"
_BARE = "regexp_replace(line, '''[^'']*''|\"[^\"]*\"', '', 'g')"


def _line_sql(source: str = "lines") -> str:
    out = []
    for rule, severity, category, pattern, skip in code.LINE_RULES:
        pattern = pattern.replace("(?-i:", "(?-i:")
        on = f"regexp_matches(line, {ds.re2(pattern)})"
        if rule == "missing-await":
            on = f"regexp_matches({_BARE}, {ds.re2(pattern)}) AND NOT contains({_BARE}, '.then(') AND NOT contains({_BARE}, 'await') AND NOT regexp_matches({_BARE}, '\\b(return|new)\\s+(fetch|readFile|writeFile|mkdir|readdir)\\s*\\(')"
        if rule == "hardcoded-secret":
            on += " AND NOT starts_with(ltrim(line), '*')"
        if skip:
            on += " AND NOT starts_with(ltrim(line), '//')"
        out.append(f"SELECT path, line_no, '{rule}' AS rule, '{severity}' AS severity, '{category}' AS category FROM {source} WHERE {on}")
    out.append(f"SELECT path, line_no, 'sql-concatenation', 'critical', 'security' FROM {source} WHERE NOT starts_with(ltrim(line), '//') AND NOT regexp_matches(line, {ds.re2(code._BOUND)}) AND (regexp_matches(line, {ds.re2(code._TEMPLATE)}) OR (regexp_matches(line, {ds.re2(code._SQL)}) AND regexp_matches(line, {ds.re2(code._JOINED)})))")
    return " UNION ALL ".join(out)


def _as(body: str, rule: str, severity: str, category: str) -> str:
    return f"SELECT path, CAST(line_no AS INT) AS line_no, '{rule}' AS rule, '{severity}' AS severity, '{category}' AS category FROM ({body})"


_DEPTH = "depth AS (SELECT *, sum(step) OVER (PARTITION BY path ORDER BY line_no) AS now, sum(step) OVER (PARTITION BY path ORDER BY line_no) - step AS was FROM (SELECT *, len(regexp_extract_all(line, '\\{')) AS opens, len(regexp_extract_all(line, '\\{')) - len(regexp_extract_all(line, '\\}')) AS step FROM lines))"
_INDENT = lambda c: f"(length({c}) - length(regexp_replace({c}, '^\\s+', '')))"
_CATCH = "SELECT path, 1 + length(h) - length(replace(h, chr(10), '')) AS line_no FROM (SELECT path, array_to_string(list_slice(parts, 1, i), '') || array_to_string(list_slice(found, 1, i - 1), '') AS h FROM (SELECT path, parts, found, unnest(range(1, len(found) + 1)) AS i FROM (SELECT path, string_split_regex(content, 'catch\\s*\\([^)]*\\)\\s*\\{\\s*\\}') AS parts, regexp_extract_all(content, 'catch\\s*\\([^)]*\\)\\s*\\{\\s*\\}') AS found FROM {})))"
_REACH = " AND ".join(f"NOT starts_with(t, '{s}')" for s in code._REACHED)
_UNREACHABLE = f"SELECT path, line_no FROM (SELECT *, trim(line) AS t, lag(line) OVER (PARTITION BY path ORDER BY line_no) AS before FROM lines) WHERE regexp_matches(before, '^\\s*(return|throw)\\b') AND NOT regexp_matches(rtrim(before), '[\\[{{(]$') AND t NOT IN ('', '}}', '}})', '}});', '}},') AND {_REACH} AND {_INDENT('line')} > {_INDENT('before')}"
_FUNCTIONS = f"SELECT s.path, s.line_no, CAST(min(c.line_no) - s.line_no + 1 AS BIGINT) AS length FROM depth s JOIN depth c ON c.path = s.path AND c.line_no >= s.line_no AND c.now <= s.was AND (c.line_no > s.line_no OR c.opens > 0) WHERE regexp_matches(s.line, {ds.re2(code._FUNCTION)}) AND ((c.now <= c.was AND c.step <= 0) OR (c.opens > 0 AND c.step = 0)) GROUP BY 1, 2"
_NESTING = lambda k: f"SELECT path, line_no FROM (SELECT *, coalesce(sum(ticks) OVER (PARTITION BY path ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 AS open, replace(line, chr(9), '  ') AS plain FROM (SELECT *, len(regexp_extract_all(line, '`')) AS ticks FROM lines)) WHERE ticks = 0 AND open = 0 AND length(trim(plain)) >= 3 AND {_INDENT('plain')} // 2 >= {k}"
_LOOPS = f"""SELECT path, hit AS line_no FROM (SELECT path, o, min(CASE WHEN line_no > o AND now <= o_was THEN line_no END) AS ends, min(CASE WHEN line_no > o AND inner_ THEN line_no END) AS hit FROM (
SELECT b.path, b.line_no, b.now, a.line_no AS o, a.was AS o_was, regexp_matches({_BARE.replace('line', 'b.line')}, '\\b(for|while)\\s*\\(|\\.(find|filter|some|every|includes|indexOf|map|forEach|reduce)\\s*\\(') AS inner_ FROM depth a JOIN depth b ON a.path = b.path AND b.line_no >= a.line_no AND b.line_no < a.line_no + 40 WHERE regexp_matches({_BARE.replace('line', 'a.line')}, '\\b(for|while)\\s*\\(')) GROUP BY 1, 2) WHERE hit IS NOT NULL AND (ends IS NULL OR hit <= ends) GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY path ORDER BY hit) <= 5"""
_SYNC = "SELECT path, line_no FROM (SELECT *, bool_or(regexp_matches(line, '\\basync\\b')) OVER (PARTITION BY path) AS a FROM lines) WHERE a AND regexp_matches(line, '\\b(readFileSync|writeFileSync|mkdirSync|readdirSync|statSync|unlinkSync|renameSync|copyFileSync)\\b') AND NOT starts_with(ltrim(line), '//') QUALIFY row_number() OVER (PARTITION BY path ORDER BY line_no) <= 3"
_COMMENTED = f"SELECT path, min(line_no) AS line_no, count(*) AS length FROM (SELECT path, line_no, line_no - row_number() OVER (PARTITION BY path ORDER BY line_no) AS i FROM lines WHERE regexp_matches(line, {ds.re2(code._COMMENTED)})) GROUP BY path, i HAVING count(*) >= 3"
_ALL = f"""{_L.replace("FROM (SELECT path, string_split(content, chr(10)) AS ls FROM files)", "FROM (SELECT path, string_split(content, chr(10)) AS ls FROM js)")}, {_DEPTH}, every AS ({_line_sql()} UNION ALL {_as(_CATCH.replace('FROM {}', 'FROM js'), 'empty-catch', 'warning', 'error_handling')} UNION ALL {_as(_UNREACHABLE, 'unreachable', 'warning', 'bug')}
UNION ALL {_as(f'SELECT * FROM ({_FUNCTIONS}) WHERE length > 80', 'long-function', 'warning', 'ai_slop')} UNION ALL {_as(_NESTING(6), 'deep-nesting', 'suggestion', 'ai_slop')} UNION ALL {_as(_LOOPS, 'nested-loop', 'warning', 'performance')} UNION ALL {_as(_SYNC, 'sync-call', 'suggestion', 'performance')} UNION ALL {_as(_COMMENTED, 'commented-code', 'info', 'dead_code')})"""
_EXT = "lower(regexp_extract(path, '([^.]*)$', 1))"
_IS_JS = f"{_EXT} IN ('ts', 'tsx', 'js', 'jsx', 'mjs', 'cjs')"
_x = lambda p, c="content": f"regexp_extract_all({c}, {ds.re2(p)}, 1)"


def _concat(parts: list[str]) -> str:
    return parts[0] if len(parts) == 1 else f"list_concat({parts[0]}, {_concat(parts[1:])})"


def _names_sql(kinds) -> str:
    cases = " ".join(f"WHEN lang = '{k}' THEN {_concat([_x(p) for p in ps])}" for k, ps in kinds.items())
    return f"{_L} SELECT DISTINCT path, name FROM (SELECT path, unnest(flatten(list_transform(found, lambda x: CASE WHEN contains(x, '''') OR contains(x, '\"') THEN regexp_extract_all(x, '[\"''](\\w+)[\"'']', 1) ELSE [x] END))) AS name FROM (SELECT path, CASE {cases} ELSE [] END AS found FROM (SELECT path, content, CASE WHEN {_IS_JS} THEN 'js' ELSE {_EXT} END AS lang FROM files)))"


_JS_IMPORTS = _concat([_x(p) for p in ("import\\s+[^;]{0,500}?from\\s+[\"']([^\"']+)[\"']", "import\\s+[\"']([^\"']+)[\"']", "require\\s*\\(\\s*[\"']([^\"']+)[\"']\\s*\\)")])
_PY_IMPORTS = _concat([_x("(?m)^from\\s+([A-Za-z0-9_.]+)\\s+import"), _x("(?m)^import\\s+([A-Za-z0-9_.]+)")])
_GO_IMPORTS = f"list_concat({_x('import\\s+\"([^\"]+)\"')}, flatten(list_transform({_x('import\\s*\\(([^)]*)\\)')}, lambda x: regexp_extract_all(x, '\"([^\"]+)\"', 1))))"
_IMPORTS = f"imports AS (SELECT DISTINCT path, target FROM (SELECT path, unnest(CASE WHEN {_IS_JS} THEN {_JS_IMPORTS} WHEN {_EXT} = 'py' THEN {_PY_IMPORTS} WHEN {_EXT} = 'go' THEN {_GO_IMPORTS} WHEN {_EXT} = 'rs' THEN {_x('use\\s+([A-Za-z0-9_:]+)')} WHEN {_EXT} IN ('java', 'kt') THEN {_x('import\\s+(?:static\\s+)?([A-Za-z0-9_.]+)')} ELSE [] END) AS target FROM files))"
_SUFFIX = "['', '.ts', '.tsx', '.js', '.jsx', '.py', '/index.ts', '/index.tsx', '/index.js', '/index.jsx']"
_DEPS = f"{_IMPORTS}, rel AS (SELECT * FROM imports WHERE starts_with(target, './') OR starts_with(target, '../')), tried AS (SELECT src, target, i, base || ({_SUFFIX})[i] AS dst FROM (SELECT path AS src, target, unnest(range(1, 11)) AS i, regexp_replace(regexp_replace(path, '[^/]*$', '') || substr(target, 3), '\\.js$', '') AS base FROM rel)), met AS (SELECT src, target, arg_min(dst, i) AS dst FROM tried WHERE dst IN (SELECT path FROM files) GROUP BY 1, 2), deps AS (SELECT DISTINCT src, dst FROM met)"
_SETTINGS = "settings AS (SELECT path, line_no, trim(regexp_extract(t, '^([^=]*)=', 1)) AS key, regexp_replace(trim(regexp_extract(t, '^[^=]*=(.*)$', 1)), '^[\"'']|[\"'']$', '') AS value FROM (SELECT path, line_no, trim(line) AS t FROM lines WHERE regexp_matches(path, '(^|/)\\.env[^/]*$')) WHERE t <> '' AND NOT starts_with(t, '#') AND contains(t, '='))"
_INSECURE = " OR ".join(f"(regexp_matches(key, {ds.re2(k)}) AND regexp_matches(value, {ds.re2(v)}))" for k, v in code.INSECURE)
_TESTS = f"tests AS (SELECT path, regexp_matches(path, {ds.re2(code._TEST)}) AS is_test, CAST(CASE WHEN NOT regexp_matches(path, {ds.re2(code._TEST)}) THEN 0 WHEN {_EXT} IN ('ts', 'js', 'tsx', 'jsx') THEN len({_x('(?m)^\\s*(?:await\\s+)?((?:it|test))\\s*\\(')}) WHEN {_EXT} = 'py' THEN len({_x('(def)\\s+test_\\w+\\s*\\(')}) ELSE len({_x('(func)\\s+Test\\w+\\s*\\(')}) END AS BIGINT) AS tests FROM files WHERE {_EXT} IN ('ts', 'js', 'py', 'go', 'tsx', 'jsx'))"
_LANG = "CASE " + " ".join(f"WHEN {_EXT} = '{e}' THEN '{n}'" for e, n in fl.LANGUAGES.items()) + " END"

ORACLE = {
    "code_lines": f"{_L} {_line_sql()}",
    "code_empty_catch": f"{_L} {_as(_CATCH.replace('FROM {}', 'FROM files'), 'empty-catch', 'warning', 'error_handling')}",
    "code_unreachable": f"{_L} {_as(_UNREACHABLE, 'unreachable', 'warning', 'bug')}",
    "code_function_lengths": f"{_L}, {_DEPTH} {_FUNCTIONS}",
    "code_long_functions": f"{_L}, {_DEPTH} {_as(f'SELECT * FROM ({_FUNCTIONS}) WHERE length > 4', 'long-function', 'warning', 'ai_slop')}",
    "code_deep_nesting": f"{_L} {_as(_NESTING(3), 'deep-nesting', 'suggestion', 'ai_slop')}",
    "code_nested_loops": f"{_L}, {_DEPTH} {_as(_LOOPS, 'nested-loop', 'warning', 'performance')}",
    "code_sync_calls": f"{_L} {_as(_SYNC, 'sync-call', 'suggestion', 'performance')}",
    "code_unused_imports": f"{_L}, jl AS (SELECT * FROM lines WHERE {_IS_JS}), names AS (SELECT DISTINCT path, name FROM (SELECT path, unnest(list_concat(flatten(list_transform(regexp_extract_all(line, '^import\\s+(?:type\\s+)?[^{{]*\\{{([^}}]*)\\}}', 1), lambda x: list_transform(string_split(x, ','), lambda y: regexp_extract(trim(y), '(\\S*)$', 1)))), regexp_extract_all(line, '^import\\s+(\\w+)\\s*(?:,|from)', 1))) AS name FROM jl) WHERE name <> ''), used AS (SELECT path, unnest(regexp_extract_all(line, '(\\w+)', 1)) AS name FROM jl WHERE NOT regexp_matches(line, '^import\\s')) SELECT * FROM names ANTI JOIN used USING (path, name)",
    "code_commented": f"{_L} SELECT path, CAST(line_no AS INT) AS line_no, length FROM ({_COMMENTED})",
    "code_scores": f"{_ALL}, n AS (SELECT *, row_number() OVER (PARTITION BY path, severity ORDER BY line_no, rule) AS n FROM every), t AS (SELECT path, count(*) AS findings, sum(CASE severity WHEN 'critical' THEN 15 WHEN 'warning' THEN 8 WHEN 'suggestion' THEN 3 ELSE 1 END / sqrt(n)) AS lost FROM n GROUP BY path) SELECT path, coalesce(findings, 0) AS findings, CAST(greatest(0, round(100 - coalesce(lost, 0))) AS INT) AS score FROM files LEFT JOIN t USING (path)",
    "code_diff_review": f"{_L} SELECT DISTINCT path, CAST(line_no AS INT) AS line_no, rule FROM ({_line_sql()}) WHERE line_no % 2 = 1",
    "code_repeated_blocks": f"""{_L}, b AS (SELECT path, array_to_string(list_slice(ls, i, i + 4), chr(10)) AS block FROM (SELECT path, ls, unnest(range(1, len(ls) - 3)) AS i FROM (SELECT path, list_filter(list_transform(string_split(content || chr(10) || content || chr(10) || content || chr(10) || content, chr(10)), lambda l: regexp_replace(trim(l), '\\s+', ' ', 'g')), lambda l: l <> '') AS ls FROM files)))
SELECT path, block, count(*) AS n FROM b GROUP BY 1, 2 HAVING count(*) >= 4""",
    "map_inventory": f"{_L} SELECT path, {_LANG} AS language, CAST(strlen(content) AS INT) AS size, CAST(len(string_split(content, chr(10))) AS INT) AS lines FROM files",
    "map_imports": f"{_L}, {_IMPORTS} SELECT * FROM imports",
    "map_exports": _names_sql(code.EXPORTS),
    "map_functions": _names_sql(code.FUNCTIONS),
    "map_classes": _names_sql(code.CLASSES),
    "map_dependencies": f"{_L}, {_DEPS} SELECT * FROM deps",
    "map_entry_points": f"{_L}, {_DEPS} SELECT path FROM files WHERE path NOT IN (SELECT dst FROM deps)",
    "map_hotspots": f"{_L}, {_DEPS} SELECT dst AS path, count(*) AS imported_by FROM deps GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
    "map_languages": f"{_L} SELECT language, count(*) AS files, CAST(sum(n) AS BIGINT) AS lines FROM (SELECT {_LANG} AS language, len(string_split(content, chr(10))) AS n FROM files) WHERE language IS NOT NULL GROUP BY 1",
    "map_folders": f"{_L}, {_DEPS}, f AS (SELECT regexp_replace(path, '/[^/]*$', '') AS folder, path IN (SELECT dst FROM deps) AS used FROM files) SELECT folder, count(*) AS files, count_if(used) AS imported, count_if(NOT used) AS entry_points FROM f GROUP BY 1",
    "cfg_settings": f"{_L}, {_SETTINGS} SELECT path, CAST(line_no AS INT) AS line_no, key, value FROM settings",
    "cfg_issues": f"{_L}, {_SETTINGS} SELECT path, line_no, key, 'insecure' AS issue FROM settings WHERE {_INSECURE} UNION ALL SELECT path, line_no, key, 'deprecated' FROM settings WHERE starts_with(key, 'REACT_APP_') OR starts_with(key, 'EXPERIMENTAL_') OR starts_with(key, 'OLD_API_')",
    "cfg_unignored": f"{_L}, {_SETTINGS} SELECT DISTINCT path FROM settings WHERE regexp_matches(key, '{code.SECRET_KEYS}') AND value <> '' AND NOT ends_with(path, '.7') AND NOT starts_with(regexp_extract(path, '([^/]*)$', 1), '.env.1') AND NOT starts_with(path, 'build/')",
    "cfg_conflicts": f"{_L}, {_SETTINGS} SELECT key, count(DISTINCT value) AS values, count(DISTINCT path) AS files FROM settings GROUP BY key HAVING count(DISTINCT value) > 1 AND count(DISTINCT path) > 1",
    "cfg_missing": f"{_L}, {_SETTINGS} SELECT DISTINCT key FROM settings WHERE line_no < 5 AND key NOT IN (SELECT key FROM settings WHERE starts_with(key, 'D'))",
    "cfg_undefined": f"{_L}, {_SETTINGS}, refs AS (SELECT DISTINCT path, key FROM (SELECT path, unnest(CASE WHEN {_IS_JS} THEN regexp_extract_all(content, 'process\\.env\\.([A-Z_][A-Z0-9_]*)', 1) WHEN {_EXT} = 'py' THEN regexp_extract_all(content, 'os\\.(?:environ\\[[''\"]|getenv\\([''\"])([A-Z_][A-Z0-9_]*)', 1) ELSE [] END) AS key FROM files)) SELECT path, key FROM refs WHERE key NOT IN (SELECT key FROM settings)",
    "tst_inventory": f"{_L}, {_TESTS} SELECT * FROM tests",
    "tst_broken_imports": f"{_L}, {_DEPS} SELECT path, target FROM rel ANTI JOIN (SELECT src AS path, target FROM met) USING (path, target)",
    "tst_stale_mocks": f"{_L}, fns AS ({_names_sql(code.FUNCTIONS)[len(_L):]}), mocks AS (SELECT DISTINCT path, unnest(regexp_extract_all(content, '(?:jest|vi)\\.(?:mock|spyOn)\\s*\\(\\s*[''\"]([^''\"]+)[''\"]', 1)) AS mock FROM files WHERE regexp_matches(path, {ds.re2(code._TEST)})), known AS (SELECT name FROM fns UNION SELECT regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\\.[^.]+$', '') FROM files) SELECT path, mock FROM mocks WHERE regexp_replace(regexp_extract(mock, '([^/]*)$', 1), '\\.[tj]sx?$', '') NOT IN (SELECT name FROM known)",
    "tst_untested": f"{_L}, {_DEPS}, {_TESTS} SELECT path FROM tests WHERE NOT is_test AND path NOT IN (SELECT dst FROM deps JOIN tests ON tests.path = src AND is_test) AND NOT regexp_matches(path, '(^|/)index\\.[tj]s$|\\.d\\.ts$')",
}
