"""Audits of a files(path, content) table: settings, imports, dependencies, roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Languages by extension. Fixed values.
LANGUAGES = {"ts": "TypeScript", "tsx": "TypeScript", "js": "JavaScript", "jsx": "JavaScript", "mjs": "JavaScript", "cjs": "JavaScript", "py": "Python", "go": "Go", "rs": "Rust", "java": "Java", "kt": "Kotlin", "rb": "Ruby", "php": "PHP", "c": "C", "cpp": "C++", "cc": "C++", "h": "C", "hpp": "C++", "cs": "C#", "swift": "Swift", "scala": "Scala", "lua": "Lua", "sh": "Shell", "bash": "Shell", "zsh": "Shell", "json": "JSON", "yaml": "YAML", "yml": "YAML", "toml": "TOML", "xml": "XML", "html": "HTML", "css": "CSS", "scss": "SCSS", "sql": "SQL", "md": "Markdown", "vue": "Vue", "svelte": "Svelte"}


def inventory(files: DataFrame) -> DataFrame:
    """(path, language, size, lines)."""
    names = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return files.select("path", names[F.lower(F.element_at(F.split("path", "\\."), -1))].alias("language"), F.octet_length("content").alias("size"), F.size(F.split("content", "\\n")).alias("lines"))


def imports(files: DataFrame) -> DataFrame:
    """(path, target): what a file imports, by its language's form."""
    ext = F.lower(F.element_at(F.split("path", "\\."), -1))
    js = F.concat(*[F.regexp_extract_all("content", F.lit(p), F.lit(1)) for p in ("import\\s+[^;]{0,500}?from\\s+[\"']([^\"']+)[\"']", "import\\s+[\"']([^\"']+)[\"']", "require\\s*\\(\\s*[\"']([^\"']+)[\"']\\s*\\)")])
    go = F.concat(F.regexp_extract_all("content", F.lit("import\\s+\"([^\"]+)\""), F.lit(1)), F.flatten(F.transform(F.regexp_extract_all("content", F.lit("import\\s*\\(([^)]*)\\)"), F.lit(1)), lambda x: F.regexp_extract_all(x, F.lit("\"([^\"]+)\""), F.lit(1)))))
    rust = F.regexp_extract_all("content", F.lit("use\\s+([A-Za-z0-9_:]+)"), F.lit(1))
    java = F.regexp_extract_all("content", F.lit("import\\s+(?:static\\s+)?([A-Za-z0-9_.]+)"), F.lit(1))
    py = F.concat(*[F.regexp_extract_all("content", F.lit(p), F.lit(1)) for p in ("(?m)^from\\s+([A-Za-z0-9_.]+)\\s+import", "(?m)^import\\s+([A-Za-z0-9_.]+)")])
    found = F.when(ext.isin("ts", "tsx", "js", "jsx", "mjs", "cjs"), js).when(ext == "py", py).when(ext == "go", go).when(ext == "rs", rust).when(ext.isin("java", "kt"), java).otherwise(F.array().cast("array<string>"))
    return files.select("path", F.explode(F.array_distinct(found)).alias("target"))


def dependencies(files: DataFrame, with_target: bool = False) -> DataFrame:
    """(src, dst), and the target as written if asked for: imports by relative path that name a file of the table; the first
    suffix that exists wins."""
    rel = imports(files).where("target like './%' or target like '../%'")
    folder = F.slice(F.split("path", "/"), 1, F.size(F.split("path", "/")) - 1)
    steps = F.aggregate(F.split("target", "/"), folder, lambda acc, s: F.when(s == ".", acc).when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(s))))
    base = F.regexp_replace(F.array_join(steps, "/"), "\\.js$", "")
    suffixes = ["", ".ts", ".tsx", ".js", ".jsx", ".py", "/index.ts", "/index.tsx", "/index.js", "/index.jsx"]
    tried = rel.select(F.col("path").alias("src"), "target", F.posexplode(F.array(*[F.concat(base, F.lit(s)) for s in suffixes])).alias("ord", "dst"))
    known = tried.join(files.select(F.col("path").alias("dst")), "dst")
    return known.groupBy("src", "target").agg(F.min_by("dst", "ord").alias("dst")).select("src", "dst", *["target"] * with_target).distinct()


def entry_points(files: DataFrame, deps: DataFrame) -> DataFrame:
    """Files that nothing imports."""
    return files.select("path").join(deps.select(F.col("dst").alias("path")), "path", "left_anti")


def hotspots(deps: DataFrame, k: int = 10) -> DataFrame:
    """The k files imported most: path, imported_by."""
    return deps.groupBy(F.col("dst").alias("path")).agg(F.count("*").alias("imported_by")).orderBy(F.desc("imported_by"), "path").limit(k)


def settings(files: DataFrame) -> DataFrame:
    """(path, line_no, key, value) of KEY=value lines of .env files, without comments and quotes."""
    lines = files.where(F.col("path").rlike("(^|/)\\.env[^/]*$")).select("path", F.posexplode(F.split("content", "\\r?\\n")).alias("p", "line"))
    line = F.trim("line")
    kv = lines.where((line != "") & ~line.startswith("#") & line.contains("=")).select("path", (F.col("p") + 1).alias("line_no"), F.split(F.trim("line"), "=", 2).alias("kv"))
    return kv.select("path", "line_no", F.trim(F.col("kv")[0]).alias("key"), F.regexp_replace(F.trim(F.col("kv")[1]), "^[\"']|[\"']$", "").alias("value"))


def conflicting_settings(entries: DataFrame) -> DataFrame:
    """Keys with different values in different files: key, values, files."""
    return entries.groupBy("key").agg(F.countDistinct("value").alias("values"), F.countDistinct("path").alias("files")).where("values > 1 and files > 1")


def missing_settings(example: DataFrame, actual: DataFrame) -> DataFrame:
    """Keys of the example that the actual settings lack."""
    return example.select("key").subtract(actual.select("key"))


def repeated_blocks(files: DataFrame, lines: int = 5, least: int = 4) -> DataFrame:
    """(path, block, n): blocks of consecutive non-empty lines, blanks joined, that a file holds at least `least` times."""
    rows = files.select("path", F.posexplode(F.split("content", "\\n")).alias("p", "l")).select("path", "p", F.regexp_replace(F.trim("l"), "\\s+", " ").alias("l")).where("l <> ''")
    w = Window.partitionBy("path").orderBy("p").rowsBetween(0, lines - 1)
    blocks = rows.withColumn("b", F.collect_list("l").over(w)).where(F.size("b") == lines)
    return blocks.groupBy("path", F.array_join("b", "\n").alias("block")).agg(F.count("*").alias("n")).where(F.col("n") >= least)
