"""Change audits: snapshots, units, attribution, activity windows, as joins and windows over keyed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def snapshot_diff(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """(key, change): created, changed, deleted or unchanged, by the SHA-256 of the value (null values: as empty)."""
    sha = lambda c: F.sha2(F.coalesce(F.col(c).cast("string"), F.lit("")), 256)
    a = before.select(F.col(key).alias("a_key"), sha(value).alias("a_sha"))
    b = after.select(F.col(key).alias("b_key"), sha(value).alias("b_sha"))
    both = a.join(b, F.col("a_key") == F.col("b_key"), "full_outer")
    change = F.when(F.col("a_key").isNull(), "created").when(F.col("b_key").isNull(), "deleted").when(F.col("a_sha") != F.col("b_sha"), "changed").otherwise("unchanged")
    return both.select(F.coalesce("a_key", "b_key").alias(key), change.alias("change"))


def line_units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, unit, nth): non-empty lines, repeats numbered from 1."""
    lines = docs.select(id_col, F.posexplode(F.split(text_col, "\\r?\\n")).alias("p", "line")).select(id_col, "p", F.trim("line").alias("unit")).where("unit <> ''")
    return lines.select(id_col, "unit", F.row_number().over(Window.partitionBy(id_col, "unit").orderBy("p")).alias("nth"))


def unit_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Units added and removed between two unit tables: id, unit, nth, change."""
    return after.exceptAll(before).withColumn("change", F.lit("added")).unionByName(before.exceptAll(after).withColumn("change", F.lit("removed")))


def attribute_changes(changes: DataFrame, writes: DataFrame, key: str, at: str = "ts") -> DataFrame:
    """changes(key, accepted_at) with the earliest write of the key after acceptance: written_at, writer (null: unknown)."""
    w = writes.select(F.col(key).alias("w_key"), F.col(at).alias("w_at"), "writer")
    met = changes.join(w, (F.col(key) == F.col("w_key")) & (F.col("w_at") > F.col("accepted_at")), "left")
    return met.groupBy(key, "accepted_at").agg(F.min("w_at").alias("written_at"), F.min_by("writer", "w_at").alias("writer"))


def activity_windows(events: DataFrame, lead: int = 2, tail: int = 600, key: str = "user_id", at: str = "ts") -> DataFrame:
    """(key, opened, closed, n): [t - lead, t + tail] seconds around every event, merged where they touch."""
    spans = events.select(key, (F.col(at) - F.make_dt_interval(secs=F.lit(lead))).alias("a"), (F.col(at) + F.make_dt_interval(secs=F.lit(tail))).alias("b"))
    before = Window.partitionBy(key).orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1)
    marked = spans.withColumn("reach", F.max("b").over(before)).withColumn("new", (F.col("reach").isNull() | (F.col("a") > F.col("reach"))).cast("int"))
    island = marked.withColumn("island", F.sum("new").over(Window.partitionBy(key).orderBy("a", "b").rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(key, "island").agg(F.min("a").alias("opened"), F.max("b").alias("closed"), F.count("*").alias("n")).select(key, "opened", "closed", "n")


def exposure_levels(events: DataFrame, flagged: str, external: str, key: str = "user_id", at: str = "ts", kind: str = "event_type") -> DataFrame:
    """Per event: key, at, kind, level at that moment: clean, exposed once an external result was seen, tainted once a
    flagged one was; the level only rises."""
    rank = F.when(F.col(kind) == flagged, 2).when(F.col(kind) == external, 1).otherwise(0)
    so_far = Window.partitionBy(key).orderBy(at, "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return events.select(key, at, "event_id", kind, F.element_at(F.array(*map(F.lit, ("clean", "exposed", "tainted"))), F.max(rank).over(so_far) + 1).alias("level"))


def actionable_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, kind, token) of e-mail addresses, URLs and home paths, lower-cased, each once a text."""
    kinds = {"email": "[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}", "url": "https?://[^ \\t\\n\\r\\f\"'<>)]+", "path": "~/[A-Za-z0-9._/-]+"}

    def of(kind: str, pattern: str):
        return F.transform(F.regexp_extract_all(F.col(text_col), F.lit(pattern), F.lit(0)), lambda v: F.struct(F.lit(kind).alias("kind"), F.lower(v).alias("token")))

    found = F.flatten(F.array(*[of(k, p) for k, p in kinds.items()]))
    return docs.select(id_col, F.explode(F.array_distinct(found)).alias("t")).select(id_col, "t.kind", "t.token")


def novel_tokens(found: DataFrame, accepted: DataFrame) -> DataFrame:
    """Tokens that no accepted document carries."""
    return found.join(accepted.select("kind", "token").distinct(), ["kind", "token"], "left_anti")
