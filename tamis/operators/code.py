"""Review of a files(path, content, mtime) table: line rules, structure, names, settings, tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamis.operators.files import dependencies, imports, settings

#: Line rules: (rule, severity, category, pattern, whether lines that begin with // are left out). Fixed values.
LINE_RULES = [
    ("console", "warning", "bug", r"\bconsole\.(log|error|warn|debug|info|trace)\s*\(", True),
    ("unfinished", "info", "bug", r"(?i)//\s*(TODO|FIXME|HACK|XXX)\b", False),
    ("loose-null", "suggestion", "bug", r"[^!=]==[^=]\s*(null|undefined)\b", True),
    ("obvious-comment", "warning", "ai_slop", r"(?i)//\s*(?:increment\s+\w+\s+by\s+\d+|set\s+\w+\s+to\s+|declare\s+(a\s+)?(new\s+)?variable|import\s+\w+|define\s+(a\s+)?(the\s+)?function|return\s+the\s+(result|value|output)|initialize\s+(the\s+)?\w+\s+(variable|array|object)|loop\s+(through|over)\s+(the\s+)?(array|list|items|elements)|check\s+if\s+\w+\s+is\s+(null|undefined|true|false|empty)|create\s+(a\s+)?(new\s+)?(instance|object)\s+of|call\s+(the\s+)?\w+\s+(function|method)|add\s+\w+\s+to\s+(the\s+)?(array|list|map|set|object)|export\s+(the\s+)?(function|class|interface|type|const))", False),
    ("type-assertion", "warning", "ai_slop", r"\bas\s+(any|unknown)\b", True),
    ("hardcoded-secret", "critical", "security", r"""(?i)(?:api[_-]?key|apikey)\s*[:=]\s*["'`][A-Za-z0-9_\-]{16,}["'`]|(?:password|passwd|pwd)\s*[:=]\s*["'`][^"'`]{4,}["'`]|(?:secret|token)\s*[:=]\s*["'`][A-Za-z0-9_\-]{16,}["'`]|(?-i:(?:AKIA|ASIA)[A-Z0-9]{16}|-----BEGIN\s+(RSA\s+)?PRIVATE\s+KEY-----|ghp_[A-Za-z0-9_]{36}|sk-[A-Za-z0-9]{32,})""", True),
    ("eval", "critical", "security", r"\b(eval|Function)\s*\(", True),
    ("inner-html", "critical", "security", r"\.innerHTML\s*=", False),
    ("missing-await", "warning", "performance", r"^[^.]*\b(fetch|readFile|writeFile|mkdir|readdir)\s*\(", True),
]
_SQL = r"(?i)\b(?:SELECT|INSERT\s+INTO|UPDATE|DELETE\s+FROM|DROP)\b"
_JOINED, _TEMPLATE, _BOUND = r"""["'`]\s*\+|\+\s*["'`]""", r"(?i)`[^`]*\b(?:SELECT|INSERT\s+INTO|UPDATE|DELETE\s+FROM|DROP)\b[^`]*\$\{", r"\?\s*[,)\]]|\$\d+"
_QUOTED = r"""'[^']*'|"[^"]*\""""
#: What a finding of each severity costs. Fixed values.
PENALTY = {"critical": 15, "warning": 8, "suggestion": 3, "info": 1}
_JS = ("ts", "tsx", "js", "jsx", "mjs", "cjs")


def extension(path: Column) -> Column:
    return F.lower(F.element_at(F.split(path, "\\."), -1))


def code_lines(files: DataFrame) -> DataFrame:
    """(path, line_no from 1, line)."""
    return files.select("path", F.posexplode(F.split("content", "\\n")).alias("p", "line")).select("path", (F.col("p") + 1).alias("line_no"), "line")


def line_findings(files: DataFrame) -> DataFrame:
    """(path, line_no, rule, severity, category) of the line rules, and of SQL put together from strings."""
    rows = code_lines(files)
    comment = F.ltrim("line").startswith("//")
    bare = F.regexp_replace("line", _QUOTED, "")
    hits = []
    for rule, severity, category, pattern, skip in LINE_RULES:
        on = F.col("line").rlike(pattern)
        if rule == "missing-await":
            on = bare.rlike(pattern) & ~bare.contains(".then(") & ~bare.contains("await") & ~bare.rlike(r"\b(return|new)\s+(fetch|readFile|writeFile|mkdir|readdir)\s*\(")
        if rule == "hardcoded-secret":
            on = on & ~F.ltrim("line").startswith("*")
        if skip:
            on = on & ~comment
        hits.append((on, rule, severity, category))
    sql = ~comment & ~F.col("line").rlike(_BOUND) & (F.col("line").rlike(_TEMPLATE) | (F.col("line").rlike(_SQL) & F.col("line").rlike(_JOINED)))
    hits.append((sql, "sql-concatenation", "critical", "security"))
    found = F.array_compact(F.array(*[F.when(on, F.struct(F.lit(r).alias("rule"), F.lit(s).alias("severity"), F.lit(c).alias("category"))) for on, r, s, c in hits]))
    return rows.select("path", "line_no", F.explode(found).alias("f")).select("path", "line_no", "f.*")


def _finding(rows: DataFrame, rule: str, severity: str, category: str) -> DataFrame:
    return rows.select("path", F.col("line_no").cast("int").alias("line_no"), F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), F.lit(category).alias("category"))


def empty_catches(files: DataFrame) -> DataFrame:
    """Catch blocks without a statement, whatever lines they span; the line is that of the catch."""
    parts = files.select("path", F.posexplode(F.split("content", r"catch\s*\([^)]*\)\s*\{\s*\}")).alias("p", "part"), F.col("content").alias("c"))
    whole = files.select(F.col("path").alias("w"), F.regexp_extract_all("content", F.lit(r"(catch\s*\([^)]*\)\s*\{\s*\})"), F.lit(1)).alias("found"))
    upto = Window.partitionBy("path").orderBy("p").rowsBetween(Window.unboundedPreceding, 0)
    ends = lambda c: F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))
    rows = parts.join(whole, F.col("path") == F.col("w")).withColumn("match", F.get("found", F.col("p")))
    rows = rows.withColumn("inner", F.coalesce(ends(F.get("found", F.col("p") - 1)), F.lit(0)))
    rows = rows.withColumn("line_no", F.sum(ends(F.col("part")) + F.col("inner")).over(upto) + 1).where("match is not null")
    return _finding(rows, "empty-catch", "warning", "error_handling")


#: Beginnings of lines after which a return does not make the line unreachable. Fixed values.
_REACHED = ("//", "/*", "*", "case ", "default:", "else", "catch", "finally", "export", "function", "const ", "class ")


def unreachable_lines(files: DataFrame) -> DataFrame:
    """Lines, deeper than a return or throw right before them, that nothing reaches."""
    rows = code_lines(files).withColumn("before", F.lag("line").over(Window.partitionBy("path").orderBy("line_no")))
    t = F.trim("line")
    ends = F.col("before").rlike(r"^\s*(return|throw)\b") & ~F.rtrim("before").rlike(r"[\[{(]$")
    depth = lambda c: F.length(c) - F.length(F.regexp_replace(c, r"^\s+", ""))
    open_ = ~t.isin("", "}", "})", "});", "},")
    for s in _REACHED:
        open_ = open_ & ~t.startswith(s)
    return _finding(rows.where(ends & open_ & (depth(F.col("line")) > depth(F.col("before")))), "unreachable", "warning", "bug")


def _depths(files: DataFrame) -> DataFrame:
    """Lines with the brace depth before (was) and after (now) each."""
    count = lambda c: F.length("line") - F.length(F.replace(F.col("line"), F.lit(c), F.lit("")))
    rows = code_lines(files).withColumn("opens", count("{")).withColumn("step", count("{") - count("}"))
    upto = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("now", F.sum("step").over(upto)).withColumn("was", F.col("now") - F.col("step"))


_FUNCTION = r"^(\s*)(export\s+)?(async\s+)?function\s+\w+|^(\s*)(export\s+)?(const|let|var)\s+\w+\s*=\s*(async\s+)?\("


def function_lengths(files: DataFrame) -> DataFrame:
    """(path, line_no, length) of every function: from its first line to the one on which its braces close again."""
    rows = _depths(files)
    starts = rows.where(F.col("line").rlike(_FUNCTION)).select("path", "line_no", "was")
    # the first later line whose depth is back at that of the start: per depth, the next line that closes to it
    closes = rows.where("now <= was and step <= 0 or (opens > 0 and step = 0)").select(F.col("path").alias("c_path"), F.col("line_no").alias("c_line"), F.col("now").alias("c_now"), F.col("opens").alias("c_opens"))
    met = starts.join(closes, (F.col("path") == F.col("c_path")) & (F.col("c_line") >= F.col("line_no")) & (F.col("c_now") <= F.col("was")) & ((F.col("c_line") > F.col("line_no")) | (F.col("c_opens") > 0)))
    return met.groupBy("path", "line_no").agg((F.min("c_line") - F.col("line_no") + 1).cast("long").alias("length"))


def long_functions(files: DataFrame, most: int = 80) -> DataFrame:
    return _finding(function_lengths(files).where(F.col("length") > most), "long-function", "warning", "ai_slop")


def deep_nesting(files: DataFrame, most: int = 6) -> DataFrame:
    """Lines indented by `most` pairs of blanks or more, outside template literals."""
    ticks = F.length(F.regexp_replace(F.regexp_replace("line", r"\\\\", ""), r"\\`", "")) - F.length(F.replace(F.regexp_replace(F.regexp_replace("line", r"\\\\", ""), r"\\`", ""), F.lit("`"), F.lit("")))
    before = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    rows = code_lines(files).withColumn("ticks", ticks).withColumn("open", F.coalesce(F.sum("ticks").over(before), F.lit(0)) % 2)
    plain = F.replace(F.col("line"), F.lit("\t"), F.lit("  "))
    indent = F.length(plain) - F.length(F.regexp_replace(plain, r"^\s+", ""))
    return _finding(rows.where((F.col("ticks") == 0) & (F.col("open") == 0) & (F.length(F.trim(plain)) >= 3) & (F.floor(indent / 2) >= most)), "deep-nesting", "suggestion", "ai_slop")


def nested_loops(files: DataFrame, reach: int = 40, most: int = 5) -> DataFrame:
    """The first loop or array call within a loop's braces and `reach` lines, `most` a file."""
    bare = F.regexp_replace("line", _QUOTED, "")
    loop = bare.rlike(r"\b(for|while)\s*\(")
    rows = _depths(files).withColumn("loop", loop).withColumn("inner", loop | bare.rlike(r"\.(find|filter|some|every|includes|indexOf|map|forEach|reduce)\s*\("))
    outer = rows.where("loop").select(F.col("path").alias("o_path"), F.col("line_no").alias("o_line"), F.col("was").alias("o_was"))
    near = outer.join(rows, (F.col("path") == F.col("o_path")) & (F.col("line_no") >= F.col("o_line")) & (F.col("line_no") < F.col("o_line") + reach))
    # the loop ends on the first later line at its own depth; what stands on that line still counts
    span = near.groupBy("o_path", "o_line").agg(F.min(F.when((F.col("line_no") > F.col("o_line")) & (F.col("now") <= F.col("o_was")), F.col("line_no"))).alias("ends"), F.min(F.when((F.col("line_no") > F.col("o_line")) & F.col("inner"), F.col("line_no"))).alias("hit"))
    hits = span.where("hit is not null and (ends is null or hit <= ends)").select(F.col("o_path").alias("path"), F.col("hit").alias("line_no")).distinct()
    hits = hits.withColumn("n", F.row_number().over(Window.partitionBy("path").orderBy("line_no"))).where(F.col("n") <= most)
    return _finding(hits, "nested-loop", "warning", "performance")


def sync_calls(files: DataFrame, most: int = 3) -> DataFrame:
    """Blocking file calls in files that use async, `most` a file."""
    rows = code_lines(files).withColumn("async", F.max(F.col("line").rlike(r"\basync\b")).over(Window.partitionBy("path")))
    hits = rows.where(F.col("async") & F.col("line").rlike(r"\b(readFileSync|writeFileSync|mkdirSync|readdirSync|statSync|unlinkSync|renameSync|copyFileSync)\b") & ~F.ltrim("line").startswith("//"))
    return _finding(hits.withColumn("n", F.row_number().over(Window.partitionBy("path").orderBy("line_no"))).where(F.col("n") <= most), "sync-call", "suggestion", "performance")


def unused_imports(files: DataFrame) -> DataFrame:
    """(path, name): names that a script imports and no other line of it holds."""
    rows = code_lines(files.where(extension(F.col("path")).isin(*_JS)))
    named = F.flatten(F.transform(F.regexp_extract_all("line", F.lit(r"^import\s+(?:type\s+)?[^{]*\{([^}]*)\}"), F.lit(1)), lambda x: F.split(x, ",")))
    names = F.concat(F.transform(named, lambda x: F.element_at(F.split(F.trim(x), r"\s+as\s+"), -1)), F.regexp_extract_all("line", F.lit(r"^import\s+(\w+)\s*(?:,|from)"), F.lit(1)))
    imported = rows.select("path", F.explode(names).alias("name")).where("name <> ''").distinct()
    used = rows.where(~F.col("line").rlike(r"^import\s")).select("path", F.explode(F.array_distinct(F.regexp_extract_all("line", F.lit(r"(\w+)"), F.lit(1)))).alias("name")).distinct()
    return imported.join(used, ["path", "name"], "left_anti")


_COMMENTED = r"^\s*//\s*(const|let|var|function|class|if|for|while|return|import|export|try|switch|await|async|\w+\s*\(|\w+\s*=\s*[^=])"


def commented_code(files: DataFrame, least: int = 3) -> DataFrame:
    """(path, line_no, length) of runs of at least `least` lines of commented-out code."""
    rows = code_lines(files).where(F.col("line").rlike(_COMMENTED))
    island = rows.withColumn("i", F.col("line_no") - F.row_number().over(Window.partitionBy("path").orderBy("line_no")))
    return island.groupBy("path", "i").agg(F.min("line_no").alias("line_no"), F.count("*").alias("length")).where(F.col("length") >= least).select("path", "line_no", "length")


def review(files: DataFrame) -> DataFrame:
    """All findings of scripts: (path, line_no, rule, severity, category)."""
    js = files.where(extension(F.col("path")).isin(*_JS))
    out = line_findings(js).withColumn("line_no", F.col("line_no").cast("int"))
    for part in (empty_catches(js), unreachable_lines(js), long_functions(js), deep_nesting(js), nested_loops(js), sync_calls(js), _finding(commented_code(js), "commented-code", "info", "dead_code")):
        out = out.unionByName(part)
    return out


def review_scores(files: DataFrame, findings: DataFrame) -> DataFrame:
    """(path, findings, score): 100 less a penalty for each finding, which falls with the square root of its number."""
    cost = F.coalesce(*[F.when(F.col("severity") == s, F.lit(float(p))) for s, p in PENALTY.items()])
    nth = findings.withColumn("n", F.row_number().over(Window.partitionBy("path", "severity").orderBy("line_no", "rule")))
    total = nth.groupBy("path").agg(F.count("*").alias("findings"), F.sum(cost / F.sqrt("n")).alias("lost"))
    rows = files.select("path").distinct().join(total, "path", "left")
    return rows.select("path", F.coalesce("findings", F.lit(0)).alias("findings"), F.greatest(F.lit(0), F.round(100 - F.coalesce("lost", F.lit(0.0))).cast("int")).alias("score"))


def diff_review(findings: DataFrame, added: DataFrame) -> DataFrame:
    """Findings on lines that a change added, each once: added(path, line_no)."""
    return findings.join(added.select("path", F.col("line_no").cast("int").alias("line_no")).distinct(), ["path", "line_no"], "left_semi").dropDuplicates(["path", "line_no", "rule"])


#: What names a file exports, defines and declares, by its extension. Fixed values.
EXPORTS = {"js": [r"export\s+(?:default\s+)?(?:async\s+)?(?:function|const|let|var|class|type|interface|enum|abstract\s+class)\s+(\w+)"], "py": [r"__all__\s*=\s*\[([^\]]*)\]"], "rs": [r"pub\s+(?:fn|struct|enum|trait|type|const|static|mod)\s+(\w+)"], "go": [r"func\s+(?:\([^)]*\)\s+)?([A-Z]\w*)\s*\(", r"type\s+([A-Z]\w*)\s+"]}
FUNCTIONS = {"js": [r"function\s+(\w+)\s*\(", r"(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s+)?(?:\([^)]*\)|[^=])\s*=>", r"(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s+)?function"], "py": [r"def\s+(\w+)\s*\("], "rs": [r"fn\s+(\w+)\s*[(<]"], "go": [r"func\s+(?:\([^)]*\)\s+)?(\w+)\s*\("]}
CLASSES = {"js": [r"class\s+(\w+)"], "py": [r"class\s+(\w+)"], "rs": [r"(?:struct|enum|trait)\s+(\w+)"], "go": [r"type\s+(\w+)\s+struct"]}


def names_of(files: DataFrame, kinds: dict[str, list[str]]) -> DataFrame:
    """(path, name), each once, of the patterns for the file's language; a quoted list gives the names in it."""
    ext = extension(F.col("path"))
    lang = F.when(ext.isin(*_JS), "js").otherwise(ext)
    found = F.coalesce(*[F.when(lang == k, F.concat(*[F.regexp_extract_all("content", F.lit(p), F.lit(1)) for p in ps])) for k, ps in kinds.items()])
    single = F.flatten(F.transform(found, lambda x: F.when(x.contains("'") | x.contains('"'), F.regexp_extract_all(x, F.lit("[\"'](\\w+)[\"']"), F.lit(1))).otherwise(F.array(x))))
    return files.select("path", F.explode(F.array_distinct(single)).alias("name"))


def language_totals(inventory: DataFrame) -> DataFrame:
    """(language, files, lines) of the files of known languages."""
    return inventory.where("language is not null").groupBy("language").agg(F.count("*").alias("files"), F.sum("lines").cast("long").alias("lines"))


def folder_summary(files: DataFrame, deps: DataFrame) -> DataFrame:
    """(folder, files, imported, entry_points): what a newcomer sees of each folder."""
    folder = F.regexp_replace("path", "/[^/]*$", "")
    used = deps.select(F.col("dst").alias("u")).distinct()
    rows = files.select("path", folder.alias("folder")).join(used, F.col("path") == F.col("u"), "left")
    return rows.groupBy("folder").agg(F.count("*").alias("files"), F.count("u").alias("imported"), F.count_if(F.col("u").isNull()).alias("entry_points"))


#: Settings that should not stand so in production: key and value. Fixed values.
INSECURE = [("(?i)^DEBUG$", "(?i)^true$"), ("(?i)^NODE_ENV$", "(?i)^development$"), ("(?i)^LOG_LEVEL$", "(?i)^(debug|trace)$"), ("(?i)^CORS_ORIGIN$", "^\\*$"), ("(?i)^DISABLE_AUTH", "(?i)^(true|1|yes)$"), ("(?i)^VERIFY_SSL$", "(?i)^(false|0|no)$"), ("(?i)^TLS_REJECT_UNAUTHORIZED$", "^0$")]
DEPRECATED = ["REACT_APP_", "EXPERIMENTAL_", "OLD_API_"]
SECRET_KEYS = "(?i)password|secret|api[_-]?key|token|private[_-]?key|access[_-]?key|auth|credential|database[_-]?url|connection[_-]?string|smtp|aws[_-]?|stripe|twilio|sendgrid"


def setting_issues(entries: DataFrame, deprecated: list[str] = DEPRECATED) -> DataFrame:
    """(path, line_no, key, issue): insecure values and deprecated prefixes."""
    risky = F.lit(False)
    for key, value in INSECURE:
        risky = risky | (F.col("key").rlike(key) & F.col("value").rlike(value))
    old = F.lit(False)
    for prefix in deprecated:
        old = old | F.col("key").startswith(prefix)
    found = F.array_compact(F.array(F.when(risky, F.lit("insecure")), F.when(old, F.lit("deprecated"))))
    return entries.select("path", "line_no", "key", F.explode(found).alias("issue"))


def unignored_secrets(entries: DataFrame, patterns: DataFrame) -> DataFrame:
    """Paths of settings files with secret keys that no ignore pattern covers (names, paths, folders, leading or trailing *)."""
    secret = entries.where(F.col("key").rlike(SECRET_KEYS) & (F.col("value") != "") & ~F.col("path").rlike("\\.(example|template|sample)$")).select("path").distinct()
    name, p = F.element_at(F.split("path", "/"), -1), F.col("pattern")
    covers = (p == name) | (p == F.col("path")) | (p.endswith("/") & F.col("path").startswith(p)) | (p.startswith("*") & name.endswith(F.substring(p, 2, 1000))) | (p.endswith("*") & name.startswith(F.left(p, F.length(p) - 1)))
    return secret.join(F.broadcast(patterns.select("pattern").where("pattern <> '' and not pattern like '#%'").distinct()), covers, "left_anti")


def undefined_settings(files: DataFrame) -> DataFrame:
    """(path, key): settings that code reads and no settings file defines."""
    ext = extension(F.col("path"))
    js = F.concat(*[F.regexp_extract_all("content", F.lit(p), F.lit(1)) for p in ("process\\.env\\.([A-Z_][A-Z0-9_]*)", "process\\.env\\[['\"]([A-Z_][A-Z0-9_]*)['\"]\\]", "import\\.meta\\.env\\.([A-Z_][A-Z0-9_]*)")])
    py = F.regexp_extract_all("content", F.lit("os\\.(?:environ\\[['\"]|getenv\\(['\"])([A-Z_][A-Z0-9_]*)"), F.lit(1))
    go = F.regexp_extract_all("content", F.lit("os\\.(?:Getenv|LookupEnv)\\([ \\t\\n]*[\"']([A-Z_][A-Z0-9_]*)[\"']"), F.lit(1))
    read = F.when(ext.isin(*_JS), js).when(ext == "py", py).when(ext == "go", go)
    refs = files.select("path", F.explode(F.array_distinct(read)).alias("key"))
    return refs.join(settings(files).select("key").distinct(), "key", "left_anti").select("path", "key")


_TEST = r"\.(test|spec)\.[tj]s$|(^|/)test_[^/]*\.py$|_test\.go$"


def test_inventory(files: DataFrame) -> DataFrame:
    """(path, is_test, tests) of source files; tests are counted by the form of the language."""
    ext = extension(F.col("path"))
    js, py, go = r"(?m)^\s*(?:await\s+)?(?:it|test)\s*\(", r"def\s+test_\w+\s*\(", r"func\s+Test\w+\s*\("
    count = F.when(ext.isin("ts", "js", "tsx", "jsx"), F.regexp_count("content", F.lit(js))).when(ext == "py", F.regexp_count("content", F.lit(py))).when(ext == "go", F.regexp_count("content", F.lit(go)))
    is_test = F.col("path").rlike(_TEST)
    return files.where(ext.isin("ts", "js", "py", "go", "tsx", "jsx")).select("path", is_test.alias("is_test"), F.when(is_test, count).otherwise(0).cast("long").alias("tests"))


def broken_imports(files: DataFrame) -> DataFrame:
    """(path, target): relative imports that name no file."""
    rel = imports(files).where("target like './%' or target like '../%'")
    good = dependencies(files, with_target=True).select(F.col("src").alias("path"), "target").distinct()
    return rel.join(good, ["path", "target"], "left_anti")


def stale_mocks(files: DataFrame) -> DataFrame:
    """(path, mock): mocked names in tests that no file of the table defines and no relative import explains."""
    pattern = r"""(?:jest|vi)\.(?:mock|spyOn)\s*\(\s*['"]([^'"]+)['"]"""
    mocks = files.where(F.col("path").rlike(_TEST)).select("path", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(pattern), F.lit(1)))).alias("mock"))
    base = F.regexp_replace(F.element_at(F.split("mock", "/"), -1), "\\.[tj]sx?$", "")
    known = names_of(files, FUNCTIONS).select(F.col("name").alias("base")).union(files.select(F.regexp_replace(F.element_at(F.split("path", "/"), -1), "\\.[^.]+$", ""))).distinct()
    return mocks.withColumn("base", base).join(known, "base", "left_anti").select("path", "mock")


def outdated_tests(files: DataFrame, now: str, days: int = 90) -> DataFrame:
    """(path, source): tests older than `days` whose source, by the name without .test or .spec, changed later."""
    tests = files.where(F.col("path").rlike(r"\.(test|spec)\.[tj]s$")).select("path", F.col("mtime").alias("t"), F.regexp_replace("path", r"\.(test|spec)\.[tj]s$", "").alias("stem"))
    source = files.where(~F.col("path").rlike(_TEST)).select(F.col("path").alias("source"), F.col("mtime").alias("s"), F.regexp_replace("path", r"\.[^./]+$", "").alias("stem"))
    old = F.col("t") < F.to_timestamp(F.lit(now)) - F.make_dt_interval(days=F.lit(days))
    return tests.join(source, "stem").where(old & (F.col("s") > F.col("t"))).select("path", "source")


def untested_sources(files: DataFrame) -> DataFrame:
    """Source files, but indexes and declarations, that no test imports: path."""
    rows = test_inventory(files)
    seen = dependencies(files).join(rows.where("is_test").select(F.col("path").alias("src")), "src", "left_semi").select(F.col("dst").alias("path")).distinct()
    plain = rows.where(~F.col("is_test") & ~F.col("path").rlike(r"(^|/)index\.[tj]s$|\.d\.ts$"))
    return plain.select("path").join(seen, "path", "left_anti")
