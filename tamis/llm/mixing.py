"""Temperature mixing of sources, realised as budgeted block permutations with DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamis.llm.common import materialize

#: Blocks of one source's permutation.
BLOCKS = 256
#: Slices of the mixed order.
SLICES = 4096
#: Up to so many sources their plan is broadcast (about 100 bytes a source); beyond, it is joined.
BROADCAST_SOURCES = 50_000
#: The exponent is bisected in rounds of so many cuts each.
GRID, ROUNDS = 32, 4


def word_count(text_col: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def temperature(sources: DataFrame, entropy_share: float, max_repeats: float) -> float:
    """The smallest exponent in [0, 1] whose weights share**exponent meet both targets.

    sources(share double > 0). The entropy of the weights falls as the exponent grows: it is to be at most entropy_share
    of the entropy of equal weights. Repetition falls too: the most repeated source is to be read at most max_repeats
    times as often as the least repeated one. Where not even 1 meets them, it is 1 (the natural shares).
    """
    low, high = 0.0, 1.0
    for _ in range(ROUNDS):
        tried = [low + (high - low) * i / GRID for i in range(GRID + 1)]
        powers = sources.select("share", F.explode(F.array(*map(F.lit, tried))).alias("exponent")).withColumn("p", F.pow("share", F.col("exponent"))).withColumn("again", F.log("p") - F.log("share"))
        fit = powers.groupBy("exponent").agg(F.sum("p").alias("z"), F.sum(F.col("p") * F.log("p")).alias("plp"), F.max("again").alias("most"), F.min("again").alias("least"), F.count("*").alias("n"))
        entropy = F.log("z") - F.col("plp") / F.col("z")
        met = fit.select("exponent", ((entropy <= entropy_share * F.log("n") + 1e-12) & (F.col("most") - F.col("least") <= F.log(F.lit(max_repeats)) + 1e-12)).alias("met")).collect()
        passing = [r.exponent for r in met if r.met]
        if not passing:
            return high
        high = min(passing)
        below = [x for x in tried if x < high]
        if not below:
            return high
        low = max(below)
    return high


def mix_plan(docs: DataFrame, entropy_share: float = 0.95, max_repeats: float = 4.0, seed: int = 7, source_col: str = "source", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per source: _source, tokens, weight, whole (full epochs), cut_block and cut_key of the part epoch.

    The budget is the smallest at which every source is read at least once in full, so mixing drops nothing.
    """
    rows = docs.select(F.col(source_col).alias("_source"), _block(id_col, seed).alias("block"), _key(id_col, seed).alias("key"), word_count(text_col).alias("t"))
    blocks = materialize(rows.groupBy("_source", "block").agg(F.sum("t").alias("t")), "mix-blocks")
    sources = blocks.groupBy("_source").agg(F.sum("t").alias("tokens"))
    total = sources.agg(F.sum("tokens")).first()[0] or 0
    full = sources.where("tokens > 0").withColumn("share", F.col("tokens") / F.lit(float(max(total, 1))))
    exponent = temperature(full.select("share"), entropy_share, max_repeats)
    powers = full.withColumn("p", F.pow("share", F.lit(exponent)))
    sums = powers.agg(F.sum("p").alias("z"), F.max(F.col("tokens") / F.col("p")).alias("m")).first()
    if sums.z is None:
        return sources.select("_source", "tokens", F.lit(0.0).alias("weight"), F.lit(1.0).alias("epochs"), F.lit(1).alias("whole"), F.lit(0).alias("cut_block"), F.lit(None).cast("long").alias("cut_key"))
    plan = sources.join(powers.select(F.col("_source").alias("s"), "p"), F.col("_source").eqNullSafe(F.col("s")), "left").select("_source", "tokens", (F.coalesce("p", F.lit(0.0)) / sums.z).alias("weight"), F.coalesce(F.greatest(F.lit(1.0), F.col("p") * F.lit(sums.m) / F.col("tokens")), F.lit(1.0)).alias("epochs"))
    plan = plan.withColumn("whole", F.floor(F.col("epochs") + 1e-9).cast("int")).withColumn("quota", F.greatest(F.lit(0.0), F.col("epochs") - F.col("whole")) * F.col("tokens"))
    # the part epoch: blocks in order while they fit, then rows of the next block while they fit
    by_source = Window.partitionBy("_source").orderBy("block")
    p = plan.select(F.col("_source").alias("s"), "quota")
    part = blocks.withColumn("upto", F.sum("t").over(by_source)).join(p, F.col("_source").eqNullSafe(F.col("s"))).where("upto > quota")
    cut = materialize(part.groupBy("_source").agg(F.min("block").alias("cut_block"), F.min_by(F.col("quota") - F.col("upto") + F.col("t"), "block").alias("left")), "mix-cuts")
    c = cut.select(F.col("_source").alias("s"), "cut_block", "left")
    last = rows.join(_bounded(c), F.col("_source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("cut_block")))
    in_block = Window.partitionBy("_source").orderBy("key").rangeBetween(Window.unboundedPreceding, 0)
    keys = last.withColumn("upto", F.sum("t").over(in_block)).where("upto <= left").groupBy("_source").agg(F.max("key").alias("cut_key"))
    k = keys.select(F.col("_source").alias("s2"), "cut_key")
    out = plan.join(c, F.col("_source").eqNullSafe(F.col("s")), "left").join(k, F.col("_source").eqNullSafe(F.col("s2")), "left")
    return materialize(out.select("_source", "tokens", "weight", "epochs", "whole", F.coalesce("cut_block", F.lit(BLOCKS)).alias("cut_block"), "cut_key"), "mix-plan")


def _block(id_col: str, seed: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), F.lit(BLOCKS)).cast("int")


def _key(id_col: str, seed: int) -> Column:
    return F.xxhash64(F.lit(seed + 1), F.col(id_col))


def _bounded(small: DataFrame) -> DataFrame:
    return F.broadcast(small) if small.count() <= BROADCAST_SOURCES else small


def mix_sources(docs: DataFrame, entropy_share: float = 0.95, max_repeats: float = 4.0, seed: int = 7, source_col: str = "source", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, each row as often as the mix reads it, with mix_epoch (from 0) and mix_slice.

    Tokens are words. A source's rows are permuted in BLOCKS blocks by a seeded hash; whole epochs take all blocks, the
    part epoch takes blocks, then rows, while they fit its budget. mix_slice says where in the mixed order a row stands:
    in every stretch of slices sources stand in their target weights. Null is a source like others; sources without
    tokens are read once; rows with null or repeated ids share a place; empty tables give empty results. Columns of docs
    are kept, whatever their names, but for mix_epoch and mix_slice.
    """
    plan = mix_plan(docs, entropy_share, max_repeats, seed, source_col, id_col, text_col)
    plan = plan.select(F.struct("epochs", "whole", "cut_block", "cut_key").alias("_mix_plan"), F.struct(F.col("_source").alias("v")).alias("_mix_source"))
    kept = [F.col(f"_mix_row.`{c}`").alias(c) for c in docs.columns if c not in ("mix_epoch", "mix_slice")]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_mix_row"), F.struct(F.col(source_col).alias("v")).alias("_mix_own"), _block(id_col, seed).alias("_mix_block"), _key(id_col, seed).alias("_mix_key"))
    joined = rows.join(_bounded(plan), F.col("_mix_own.v").eqNullSafe(F.col("_mix_source.v")))
    part = (F.col("_mix_block") < F.col("_mix_plan.cut_block")) | ((F.col("_mix_block") == F.col("_mix_plan.cut_block")) & (F.col("_mix_key") <= F.coalesce(F.col("_mix_plan.cut_key"), F.lit(-(2**63)))))
    more = (F.col("_mix_plan.epochs") - F.col("_mix_plan.whole") > 1e-9) & part
    times = F.col("_mix_plan.whole") + more.cast("int")
    epochs = joined.withColumn("mix_epoch", F.explode(F.sequence(F.lit(0), times - 1)))
    place = (F.col("mix_epoch") + (F.col("_mix_block") + F.pmod(F.col("_mix_key"), F.lit(1000)) / 1000.0) / BLOCKS) / F.col("_mix_plan.epochs")
    return epochs.select(*kept, "mix_epoch", F.least(F.lit(SLICES - 1), F.floor(place * SLICES)).cast("int").alias("mix_slice"))
