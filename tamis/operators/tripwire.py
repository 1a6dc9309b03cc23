"""Changes against a baseline after they are told apart: hunks, screening, activity, tiers, baselines, indicators, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamis.operators.audit import actionable_tokens

TIERS = ["SILENT", "NOTICE", "HOLD", "SUSPECT"]


def accepted_again(changes: DataFrame, history: DataFrame, key: str, sha: str = "sha") -> DataFrame:
    """changes with silent: whether the new content is one that was accepted for the key before."""
    past = history.groupBy(F.col(key).alias("_h")).agg(F.collect_set(sha).alias("_past"))
    out = changes.join(past, F.col(key) == F.col("_h"), "left")
    return out.withColumn("silent", F.coalesce(F.array_contains("_past", F.col(sha)), F.lit(False))).drop("_h", "_past")


def hunks(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """lines(key, pos, unit, added, writer) -> (key, writer, first_pos, lines, text): maximal runs of added lines of one writer."""
    added = lines.where("added")
    order = Window.partitionBy(key).orderBy("pos")
    near = added.withColumn("new", (F.lag("pos").over(order).isNull() | (F.col("pos") - F.lag("pos").over(order) > 1) | ~F.lag("writer").over(order).eqNullSafe(F.col("writer"))).cast("int"))
    island = near.withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    g = island.groupBy(key, "island").agg(F.min("writer").alias("writer"), F.min("pos").alias("first_pos"), F.count("*").alias("lines"), F.sort_array(F.collect_list(F.struct("pos", "unit"))).alias("u"))
    return g.select(key, "writer", "first_pos", "lines", F.array_join(F.transform("u", lambda x: x["unit"]), "\n").alias("text"))


def within_budget(parts: DataFrame, characters: int, priority: Column, key: str = "doc_id", order: str = "first_pos") -> DataFrame:
    """parts with screened: whether it fits, in order of priority, into the characters that a key's screening may cost."""
    upto = Window.partitionBy(key).orderBy(priority, order).rowsBetween(Window.unboundedPreceding, 0)
    return parts.withColumn("screened", F.sum(F.length("text")).over(upto) <= characters)


def inside_activity(changes: DataFrame, windows: DataFrame, key: str = "user_id", at: str = "ts") -> DataFrame:
    """changes with inside: whether its time lies in one of the key's merged windows (which do not overlap)."""
    w = windows.select(F.col(key).alias("_k"), "opened", "closed")
    met = changes.join(w, (F.col(key) == F.col("_k")) & (F.col(at) >= F.col("opened")) & (F.col(at) <= F.col("closed")), "left")
    return met.withColumn("inside", F.col("_k").isNotNull()).drop("_k", "opened", "closed")


def tiers(changes: DataFrame, rules: list[tuple[str, str, Column]]) -> DataFrame:
    """changes with rules, all that hold in order, and tier, that of the first one; SILENT where none holds."""
    held = F.array_compact(F.array(*[F.when(on, F.lit(name)) for name, _, on in rules]))
    tier = F.coalesce(*[F.when(on, F.lit(t)) for _, t, on in rules], F.lit("SILENT"))
    return changes.withColumn("rules", held).withColumn("tier", tier)


def next_baseline(before: DataFrame, after: DataFrame, tiered: DataFrame, key: str = "doc_id", value: str = "text") -> DataFrame:
    """(key, value, held): what is accepted from now on: the new value of silent and noticed changes, the old one of held and
    suspect ones; keys without a tier keep the old value, new ones that are held have none."""
    a, b = before.select(F.col(key).alias("_a"), F.col(value).alias("_old")), after.select(F.col(key).alias("_b"), F.col(value).alias("_new"))
    t = tiered.select(F.col(key).alias("_t"), "tier").dropDuplicates(["_t"])
    rows = a.join(b, F.col("_a") == F.col("_b"), "full_outer").withColumn(key, F.coalesce("_a", "_b")).join(t, F.col(key) == F.col("_t"), "left")
    on = F.coalesce(F.col("tier").isin("SILENT", "NOTICE"), F.lit(False))
    return rows.select(key, F.when(on, F.col("_new")).otherwise(F.col("_old")).alias(value), F.coalesce(~F.col("tier").isin("SILENT", "NOTICE"), F.lit(False)).alias("held"))


def tripped(commands: DataFrame, indicators: DataFrame, id_col: str = "event_id", command_col: str = "command") -> DataFrame:
    """(id, kind, token): commands that use a token of a held document. Works on streams with static indicators as well."""
    used = actionable_tokens(commands, id_col, command_col)
    return used.join(indicators.select("kind", "token").distinct(), ["kind", "token"]).select(id_col, "kind", "token")


def retained(records: DataFrame, now: Column, days: int = 30, most: int = 8, key: str = "user_id", at: str = "ts", tie: str = "event_id") -> DataFrame:
    """Records of the last `days`, the latest `most` of each key."""
    fresh = records.where(F.col(at) >= now - F.make_dt_interval(days=F.lit(days)))
    return fresh.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(at), F.desc(tie)))).where(F.col("_n") <= most).drop("_n")


def escalated(actions: DataFrame) -> DataFrame:
    """actions(decision, level) with final: asked instead of allowed once exposed, denied instead of asked once tainted."""
    d, level = F.col("decision"), F.col("level")
    out = F.when((level == "tainted") & (d == "ask"), "deny").when((level != "clean") & (d == "allow") & (level == "tainted"), "ask").otherwise(d)
    return actions.withColumn("final", out)


def session_index(sessions: DataFrame, link: str = "conv_id") -> DataFrame:
    """(section, name, links): sessions(link, day, project, topics) by project, topic and day, newest first, each link once."""
    s = sessions.dropDuplicates([link])
    parts = [s.select(F.lit("project").alias("section"), F.col("project").alias("name"), "day", link), s.select(F.lit("topic").alias("section"), F.explode("topics").alias("name"), "day", link), s.select(F.lit("day").alias("section"), F.col("day").cast("string").alias("name"), "day", link)]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2]).where("name is not null")
    newest = F.array_sort(F.collect_set(F.struct(F.col("day"), F.col(link).alias("link"))), lambda a, b: F.when(a["day"] > b["day"], -1).when(a["day"] < b["day"], 1).when(a["link"] < b["link"], -1).when(a["link"] > b["link"], 1).otherwise(0))
    return rows.groupBy("section", "name").agg(F.transform(newest, lambda x: x["link"]).alias("links"))


def daily_digest(sessions: DataFrame, link: str = "conv_id") -> DataFrame:
    """(day, sessions, messages, titles) of sessions(link, day, title, n_messages)."""
    g = sessions.groupBy("day").agg(F.count("*").alias("sessions"), F.sum("n_messages").alias("messages"), F.sort_array(F.collect_list(F.struct(link, "title"))).alias("t"))
    return g.select("day", "sessions", "messages", F.transform("t", lambda x: x["title"]).alias("titles"))
