"""Stream forms of the operators: per-record guards, windowed counts, sessions, deduplication, exposure by key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamis.operators.secrets import found_values
from tamis.functions.text import mask, text_or_empty


def guard_stream(records: DataFrame, text_col: str = "text") -> DataFrame:
    """records with masked text, secrets_redacted and verdict; stateless, so it runs on batches and streams alike."""
    out = records.withColumn("_values", found_values(text_or_empty(text_col)))
    masked = F.aggregate("_values", text_or_empty(text_col), lambda acc, v: F.replace(acc, v, mask(F.trim(v))))
    return out.withColumn("masked", masked).withColumn("secrets_redacted", F.size("_values")).withColumn("verdict", F.when(F.size("_values") > 0, "warn").otherwise("allow")).drop("_values")


def quarantine_sink(stream: DataFrame, stored: str, quarantined: str, checkpoint: str):
    """Start a query that writes each batch's allowed rows to one table folder and the others to another."""

    def split(batch: DataFrame, number: int) -> None:
        batch.persist()
        batch.where("verdict = 'allow'").write.mode("append").parquet(stored)
        batch.where("verdict <> 'allow'").write.mode("append").parquet(quarantined)
        batch.unpersist()

    return stream.writeStream.foreachBatch(split).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counts_by_window(events: DataFrame, width: str, late: str, slide: str | None = None, at: str = "ts", kind: str = "event_type") -> DataFrame:
    """(opened, closed, kind, n): counts by tumbling (or sliding) window; rows later than the watermark are dropped."""
    w = F.window(at, width, slide) if slide else F.window(at, width)
    grouped = events.withWatermark(at, late).groupBy(w.alias("w"), kind).agg(F.count("*").alias("n"))
    return grouped.select(F.col("w.start").alias("opened"), F.col("w.end").alias("closed"), kind, "n")


def bursts(events: DataFrame, gap: str, late: str, at: str = "ts", key: str = "user_id") -> DataFrame:
    """(key, opened, closed, n): activity of a key with no pause longer than gap."""
    grouped = events.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return grouped.select(key, F.col("w.start").alias("opened"), F.col("w.end").alias("closed"), "n")


def once(events: DataFrame, late: str, at: str = "ts", key: str = "event_id") -> DataFrame:
    """Each key once, however often the source delivers it within the watermark."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def exposure_stream(events: DataFrame, flagged: str, external: str, key: str = "user_id", kind: str = "event_type") -> DataFrame:
    """(key, level): the highest level that a key's events have reached, in update mode; it only rises."""
    rank = F.when(F.col(kind) == flagged, 2).when(F.col(kind) == external, 1).otherwise(0)
    top = events.groupBy(key).agg(F.max(rank).alias("r"))
    return top.select(key, F.element_at(F.array(*map(F.lit, ("clean", "exposed", "tainted"))), F.col("r") + 1).alias("level"))


def scratch(spark) -> str:
    """A folder that driver and executors share: below spark.checkpoint.dir; in local mode without one, a temporary folder."""
    import re
    import tempfile
    import uuid

    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tamis-stream-")
    return f"{folder}/stream-{uuid.uuid4().hex}"


def streamed(spark, folder: str, name: str, transform, mode: str = "append") -> DataFrame:
    """The result of a stream over what a table holds now: read as a stream, transformed, written, read back. In complete mode
    every batch replaces the result, so that windows which the watermark has not closed yet are there too."""
    path = f"{folder}/{name}.parquet"
    source = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path.replace(".parquet", ".parque[t]"))
    for field in source.schema.fields:
        if field.dataType.typeName() == "timestamp_ntz":  # watermarks need an instant
            source = source.withColumn(field.name, F.col(field.name).cast("timestamp"))
    out, place = transform(source), scratch(spark)
    writer = out.writeStream.option("checkpointLocation", f"{place}/state").trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", f"{place}/rows").outputMode("append").start()
    else:
        query = writer.outputMode(mode).foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{place}/rows")).start()
    query.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{place}/rows")


def folded_counts(known: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Counts with those of a new batch added: co-occurrence and document counts are kept up to date without a new pass."""
    return known.unionByName(new).groupBy(*keys).agg(F.sum("n").alias("n"))
