"""The concept graph over observations, and keyed updates of the store."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def concept_nodes(observations: DataFrame) -> DataFrame:
    """observations(id, domain, topic, tags) -> (node, type, weight): domains, topics and tags with their observations."""
    kinds = F.array(F.struct(F.lit("domain").alias("type"), F.col("domain").alias("name")), F.struct(F.lit("topic").alias("type"), F.col("topic").alias("name")))
    tags = F.transform(F.coalesce("tags", F.array().cast("array<string>")), lambda t: F.struct(F.lit("tag").alias("type"), t.alias("name")))
    rows = observations.select("id", F.explode(F.concat(kinds, tags)).alias("k")).where("k.name is not null")
    return rows.groupBy(F.concat_ws(":", "k.type", "k.name").alias("node"), F.col("k.type").alias("type")).agg(F.countDistinct("id").alias("weight"))


def concept_edges(observations: DataFrame) -> DataFrame:
    """(src, dst, relation, weight): domain contains topic, topic related to tag."""
    edge = lambda kind, c, other, name, relation: F.struct(F.concat(F.lit(f"{kind}:"), c).alias("src"), F.concat(F.lit(f"{other}:"), name).alias("dst"), F.lit(relation).alias("relation"))
    contains = F.when(F.col("domain").isNotNull(), F.array(edge("domain", F.col("domain"), "topic", F.col("topic"), "contains"))).otherwise(F.array())
    related = F.transform(F.coalesce("tags", F.array().cast("array<string>")), lambda t: edge("topic", F.col("topic"), "tag", t, "related"))
    kinds = "array<struct<src:string,dst:string,relation:string>>"
    rows = observations.where("topic is not null").select(F.explode(F.concat(contains.cast(kinds), related.cast(kinds))).alias("e"))
    return rows.groupBy("e.src", "e.dst", "e.relation").agg(F.count("*").alias("weight"))


def tunnels(observations: DataFrame) -> DataFrame:
    """(src, dst, topic, weight): pairs of domains, in lexical order, that share a topic; each is an edge of weight 2."""
    d = observations.where("domain is not null and topic is not null").select("domain", "topic").distinct()
    return d.alias("a").join(d.alias("b"), (F.col("a.topic") == F.col("b.topic")) & (F.col("a.domain") < F.col("b.domain"))).select(F.col("a.domain").alias("src"), F.col("b.domain").alias("dst"), F.col("a.topic").alias("topic"), F.lit(2).alias("weight"))


def expand(starts: DataFrame, edges: DataFrame, hops: int = 2) -> DataFrame:
    """starts(node) -> (node, hop): every node within so many undirected hops, with the first hop that meets it."""
    each = F.explode(F.array(F.struct(F.col("src").alias("a"), F.col("dst").alias("b")), F.struct(F.col("dst").alias("a"), F.col("src").alias("b")))).alias("e")
    both = edges.select(each).select("e.a", "e.b").distinct()
    seen = starts.select("node").distinct().withColumn("hop", F.lit(0))
    for _ in range(hops):
        # every node goes on with itself and its neighbours, so that what came before is read once
        near = seen.join(both, F.col("node") == F.col("a"), "left")
        stay, go = F.struct("node", "hop"), F.struct(F.col("b").alias("node"), (F.col("hop") + 1).alias("hop"))
        seen = near.select(F.explode(F.when(F.col("a").isNull(), F.array(stay)).otherwise(F.array(stay, go))).alias("s")).groupBy("s.node").agg(F.min("s.hop").alias("hop"))
    return seen


def confirm(store: DataFrame, ids: DataFrame) -> DataFrame:
    """store with confidence raised by 0.1, to 1 at most, and one more access, for the given ids."""
    hit = ids.select(F.col("id").alias("_hit")).distinct()
    on = F.col("_hit").isNotNull()
    out = store.join(hit, F.col("id") == F.col("_hit"), "left")
    return out.withColumn("confidence", F.when(on, F.least(F.lit(1.0), F.col("confidence") + 0.1)).otherwise(F.col("confidence"))).withColumn("accessCount", F.when(on, F.col("accessCount") + 1).otherwise(F.col("accessCount"))).drop("_hit")


def invalidate(store: DataFrame, ids: DataFrame) -> DataFrame:
    """store with valid false and confidence 0 for the given ids."""
    hit = ids.select(F.col("id").alias("_hit")).distinct()
    on = F.col("_hit").isNotNull()
    out = store.join(hit, F.col("id") == F.col("_hit"), "left")
    return out.withColumn("valid", F.when(on, F.lit(False)).otherwise(F.col("valid"))).withColumn("confidence", F.when(on, F.lit(0.0)).otherwise(F.col("confidence"))).drop("_hit")


def forget(store: DataFrame, ids: DataFrame) -> DataFrame:
    return store.join(ids.select("id").distinct(), "id", "left_anti")


def closest(targets: DataFrame, candidates: DataFrame, most: int = 3) -> DataFrame:
    """(target, candidate, distance): of the candidates with the target's first letter, the closest by edit distance."""
    c = candidates.select("candidate", F.lower(F.substring("candidate", 1, 1)).alias("k")).distinct()
    pairs = targets.select("target", F.lower(F.substring("target", 1, 1)).alias("k")).distinct().join(c, "k").withColumn("distance", F.levenshtein("target", "candidate")).where(F.col("distance") <= most)
    return pairs.withColumn("n", F.row_number().over(Window.partitionBy("target").orderBy("distance", "candidate"))).where("n = 1").select("target", "candidate", "distance")
