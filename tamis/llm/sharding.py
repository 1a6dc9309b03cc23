"""Sharding: the smallest feasible shard capacity over ordered atomic groups of equal texts, and the cuts there."""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tamis.llm.common import materialize

#: Bytes that every document takes besides its text. Fixed value.
ROW_BYTES = 16
#: Rows of a group are dealt to so many parts, so that a group of any size stays spread.
SALTS = 64
#: Ranges of the group order, each with a running sum of its own.
RANGES = 4096
#: Summary cells that one refinement brings to the driver, whatever the number of groups.
CELLS = 1 << 16


class _Boundaries:
    """What the driver knows of the sorted group ends: some ends, and the gaps in which further ends may lie."""

    def __init__(self, ends: list[int], unknown: list[tuple[int, int]]):
        self.ends = sorted({0, *ends})
        self.unknown = sorted(unknown)

    def floor(self, x: int) -> int:
        return self.ends[bisect_right(self.ends, x) - 1]

    def reach(self, x: int) -> int:
        """The most that the largest end up to x can be."""
        i = bisect_right(self.unknown, (x, float("inf"))) - 1
        return x if i >= 0 and self.unknown[i][0] < x < self.unknown[i][1] else self.floor(x)

    def walk(self, capacity: int, shards: int, step) -> list[int]:
        at, cuts = 0, []
        for _ in range(shards):
            at = step(at + capacity)
            cuts.append(at)
        return cuts


def _least(low: int, high: int, holds) -> int:
    """Smallest value in (low, high] for which holds is true; high holds."""
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (low, mid) if holds(mid) else (mid, high)
    return high


def _summary(groups: DataFrame, ranges: list[tuple[int, int]], width: int) -> tuple[list[int], list[tuple[int, int]]]:
    within = F.lit(False)
    for a, b in ranges:
        within = within | F.col("g_end").between(a, b)
    cells = groups.where(within).groupBy(F.floor(F.col("g_end") / F.lit(width)).alias("cell")).agg(F.min("g_end").alias("a"), F.max("g_end").alias("b"), F.count("*").alias("n"))
    rows = cells.select("a", "b", "n").collect()
    return [x for r in rows for x in (r.a, r.b)], [(r.a, r.b) for r in rows if r.n > 2]


def minimax_cuts(groups: DataFrame, total: int, largest: int, shards: int) -> tuple[int, list[int]]:
    """(capacity, ends of the shards) for groups(g_end long), the running sums of the ordered group sizes.

    The driver bisects over summaries: CELLS cells with the smallest and largest end in each. Where the greedy check
    cannot tell whether a capacity fits, the cells that decide are summed anew, finer, until it can. The result is that
    of a greedy check over all groups, while the driver never holds more than the cells.
    """
    if total <= 0:
        return 0, [0] * shards
    known = _Boundaries(*_summary(groups, [(0, total)], max(1, -(-total // CELLS))))
    while True:
        sure = lambda c: known.walk(c, shards, known.floor)[-1] >= total
        maybe = lambda c: known.walk(c, shards, known.reach)[-1] >= total
        start = max(largest, -(-total // shards)) - 1
        best, first = _least(start, total, sure), _least(start, total, maybe)
        if best == first:
            return best, known.walk(best, shards, known.floor)
        low, high = [0, *known.walk(first, shards, known.floor)], [0, *known.walk(best, shards, known.reach)]
        asked = sorted((a + first, min(b + best, total)) for a, b in zip(low, high) if a + first <= total)
        hit = [(a, b) for a, b in known.unknown if any(x < b and y > a for x, y in asked)]
        ranges: list[tuple[int, int]] = []
        for x, y in asked:
            inside = [(a, b) for a, b in hit if x < b and y > a]
            if inside:
                a, b = min(i[0] for i in inside), max(i[1] for i in inside)
                if ranges and a <= ranges[-1][1]:
                    ranges[-1] = (ranges[-1][0], max(b, ranges[-1][1]))
                else:
                    ranges.append((a, b))
        width = max(1, sum(b - a for a, b in ranges) // CELLS)
        ends, unknown = _summary(groups, ranges, width)
        kept = [g for g in known.unknown if not any(a <= g[0] and g[1] <= b for a, b in ranges)]
        known = _Boundaries([*known.ends, *ends], [*kept, *unknown])


def shard_documents(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of docs with its shard: id, size, text_crc32, law, shard, slot, grown_shard; law is 'bytes'.

    size is the text's UTF-8 bytes plus 16 (null text: 16; its crc32 is that of no bytes). Rows of equal texts form one
    atomic group (null texts another) and share a shard. Groups larger than a fair share take a shard each; the rest,
    ordered by the hash of their text, is cut where the largest shard is smallest. Slots count from 0 without gaps;
    repeated rows get slots of their own, null ids are ordinary ids. Fewer groups than shards leave shards empty; an
    empty table gives an empty result. Other columns are not carried.
    """
    rows = docs.select(
        F.col(id_col),
        (F.coalesce(F.octet_length(text_col), F.lit(0)) + ROW_BYTES).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col(text_col).cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.coalesce(F.unhex(F.sha2(F.col(text_col).cast("binary"), 256)), F.lit(b"")).alias("_key"),
        F.pmod(F.xxhash64(F.col(id_col)), F.lit(SALTS)).cast("int").alias("_salt"),
    )
    parts = materialize(rows.groupBy("_key", "_salt").agg(F.count("*").alias("n"), F.sum("size").alias("b")), "shard-parts")
    sizes = parts.groupBy("_key").agg(F.sum("b").alias("b"))
    totals = sizes.agg(F.coalesce(F.sum("b"), F.lit(0)).alias("t")).first()
    total, giants, largest = totals.t, [], 0
    for r in sizes.orderBy(F.desc("b"), "_key").limit(shards).collect():
        if len(giants) < shards - 1 and r.b * (shards - len(giants)) > total:
            giants.append(bytes(r._key))
            total -= r.b
        else:
            largest = r.b
            break
    alone = F.col("_key").isin([F.lit(k) for k in giants]) if giants else F.lit(False)
    ordered = parts.withColumn("_alone", alone).withColumn("_range", F.when(F.col("_alone"), -1).otherwise(F.coalesce(F.conv(F.substring(F.hex("_key"), 1, 3), 16, 10).cast("int"), F.lit(0))))
    by_range, by_key = Window.partitionBy("_range").orderBy("_key", "_salt").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("_range", "_key")
    placed = materialize(
        ordered.withColumn("b0", F.coalesce(F.sum("b").over(by_range), F.lit(0)))
        .withColumn("n0", F.coalesce(F.sum("n").over(by_range), F.lit(0)))
        .withColumn("g0", F.min("b0").over(by_key))
        .withColumn("g1", F.max(F.col("b0") + F.col("b")).over(by_key))
        .withColumn("gn0", F.min("n0").over(by_key)),
        "shard-order",
    )
    bases, at_b, at_n = [], 0, 0
    for r in sorted(placed.where(~F.col("_alone")).groupBy("_range").agg(F.sum("b").alias("b"), F.sum("n").alias("n")).collect()):
        bases.append((r._range, at_b, at_n))
        at_b, at_n = at_b + r.b, at_n + r.n
    base = docs.sparkSession.createDataFrame([*bases, (-1, 0, 0)], "_range int, base_b long, base_n long")
    # base holds RANGES + 1 rows at most
    placed = placed.join(F.broadcast(base), "_range").select("_key", "_salt", "_alone", (F.col("base_b") + F.col("g0")).alias("g_start"), (F.col("base_b") + F.col("g1")).alias("g_end"), (F.col("base_n") + F.col("n0")).alias("n_before"), (F.col("n0") - F.col("gn0")).alias("n_in_group"))
    rest = placed.where(~F.col("_alone"))
    _, cuts = minimax_cuts(rest.select("g_end"), total, largest, shards - len(giants))
    inner = sorted({c for c in cuts if 0 < c < total})
    firsts = {r.g_start: r.n for r in rest.where(F.col("g_start").isin(inner)).groupBy("g_start").agg(F.min("n_before").alias("n")).collect()} if inner else {}
    starts = [0, *inner]
    numbers = F.array(*[F.lit(firsts.get(c, 0)).cast("long") for c in starts])
    nth = F.size(F.filter(F.array(*[F.lit(c).cast("long") for c in starts]), lambda c: c <= F.col("g_start"))) - 1
    giant_no = F.coalesce(*[F.when(F.col("_key") == F.lit(k), F.lit(i)) for i, k in enumerate(giants)]) if giants else F.lit(0)
    placed = placed.withColumn("_nth", nth).select(
        "_key",
        "_salt",
        F.when(F.col("_alone"), giant_no).otherwise(F.col("_nth") + len(giants)).cast("int").alias("shard"),
        F.when(F.col("_alone"), F.col("n_in_group")).otherwise(F.col("n_before") - F.get(numbers, F.col("_nth"))).alias("_first"),
    )
    in_part = Window.partitionBy("_key", "_salt").orderBy(id_col)
    return rows.join(placed, ["_key", "_salt"]).select(id_col, "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("_first") + F.row_number().over(in_part) - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
