"""Sources: the Parquet tables of a folder, JSON record stores, session logs, file trees, patches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def observation_store(spark: SparkSession, folder: str) -> DataFrame:
    """JSON records, one a line; corrupt lines are skipped, of records with one id the last valid one stays."""
    schema = "id string, content string, domain string, topic string, tags array<string>, confidence double, accessCount long, valid boolean, accessedAt string, _bad string"
    rows = spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(folder)
    rows = rows.where("_bad is null and id is not null").drop("_bad")
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("accessedAt"), F.desc("content")))).where("_n = 1").drop("_n")


def merge_store(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """existing with the records of incoming whose id it does not know."""
    return existing.unionByName(incoming.join(existing.select("id"), "id", "left_anti"), allowMissingColumns=True)


def file_tree(spark: SparkSession, folder: str, largest: int = 1 << 20) -> DataFrame:
    """(path, size, text, skipped): files of a tree; large and binary ones are named with the reason and carry no text."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    reason = F.when(F.col("length") > largest, "large").when(F.instr(F.substring("content", 1, 65536).cast("string"), "\x00") > 0, "binary")
    return files.select("path", F.col("length").alias("size"), F.when(reason.isNull(), F.decode("content", "UTF-8")).alias("text"), reason.alias("skipped"))


def session_log(spark: SparkSession, folder: str) -> DataFrame:
    """(file, session_id, ts, role, text) of JSONL transcripts whose content is a string or an array of text blocks."""
    lines = spark.read.text(folder).select("value", F.col("_metadata.file_path").alias("file"))
    row = F.from_json("value", "type string, sessionId string, timestamp string, message struct<role:string,content:string>")
    parsed = lines.select("file", row.alias("r")).where("r.message.role is not null")
    blocks = F.from_json("r.message.content", "array<struct<type:string,text:string>>")
    text = F.when(F.col("r.message.content").startswith("["), F.array_join(F.transform(F.filter(blocks, lambda b: b["type"] == "text"), lambda b: b["text"]), "\n")).otherwise(F.col("r.message.content"))
    return parsed.select("file", F.col("r.sessionId").alias("session_id"), F.to_timestamp("r.timestamp").alias("ts"), F.col("r.message.role").alias("role"), text.alias("text"))


def added_lines(patches: DataFrame, id_col: str = "commit", text_col: str = "patch") -> DataFrame:
    """(id, file, line_no, line) of the lines that unified patches add."""
    rows = patches.select(id_col, F.posexplode(F.split(text_col, "\\n")).alias("p", "l"))
    order = Window.partitionBy(id_col).orderBy("p").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("file", F.last(F.when(F.col("l").startswith("+++ "), F.regexp_extract("l", "^\\+\\+\\+ (?:b/)?(.*)$", 1)), ignorenulls=True).over(order))
    header = F.col("l").startswith("@@")
    rows = rows.withColumn("hunk", F.sum(header.cast("int")).over(order)).withColumn("start", F.last(F.when(header, F.regexp_extract("l", "\\+(\\d+)", 1).cast("int")), ignorenulls=True).over(order))
    added = F.col("l").startswith("+") & ~F.col("l").startswith("+++ ")
    kept = added | F.col("l").startswith(" ")
    rows = rows.withColumn("n", F.sum(kept.cast("int")).over(Window.partitionBy(id_col, "hunk").orderBy("p").rowsBetween(Window.unboundedPreceding, 0)))
    return rows.where(added & F.col("start").isNotNull()).select(id_col, "file", (F.col("start") + F.col("n") - 1).alias("line_no"), F.substring("l", 2, 1 << 30).alias("line"))
