"""Hard negatives of anchors by best-first search in an R-tree that is packed by sort-tile-recursion.

Vectors become integers, so that every score is exact. Rows are sorted by slabs of one component, slabs within those of the
next, and a third component; runs of SHARD rows are the tree's lower part, one shard each, packed further within the task
that searches it. The upper part is a list of boxes of a fixed number at most. An anchor searches its own shard first; what
it finds there bounds the boxes that can hold better rows, and it travels to those shards alone.
"""

from __future__ import annotations

import heapq
import itertools

import numpy as np
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tamis.llm.common import in_task, materialize

#: Rows of a shard, of a leaf, children of a node, and anchors that search a shard in one task (about).
SHARD, LEAF, FAN, BLOCK = 8192, 256, 16, 4096
#: Rows on which slabs are fitted, and bytes of the upper boxes, which go to every task.
SAMPLE, TOP_BYTES = 20_000, 32 << 20
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


def _matrix(column, width: int, exact: bool) -> np.ndarray:
    """Rows of an Arrow list column, as doubles that hold every score exactly, or else as Python's integers."""
    flat = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64 if exact else object).reshape(-1, width)


def _held(scores: np.ndarray) -> np.ndarray:
    """Scores as 64 bits hold them."""
    return np.minimum(np.maximum(scores, _LEAST), _MOST) if scores.dtype == object else scores


def _tiled(x: np.ndarray, leaf: int) -> np.ndarray:
    """Sort-tile-recursive order of rows, by the three components of largest spread."""
    spread = np.argsort(-(x.max(axis=0) - x.min(axis=0)), kind="stable")[:3] if len(x) and x.shape[1] else []
    parts, leaves = [np.arange(len(x))], max(1, -(-len(x) // leaf))
    for depth, c in enumerate(spread):
        slabs = round(leaves ** (1 / len(spread))) if depth + 1 < len(spread) else 1
        parts = [s for p in parts for s in np.array_split(p[np.argsort(x[p, c], kind="stable")], max(1, min(slabs, len(p))))]
    return np.concatenate(parts)


class Tree:
    """A packed tree over the rows of one shard: levels of boxes, from the leaves' up."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, leaf: int = LEAF, fan: int = FAN):
        order = _tiled(x, leaf)
        self.ids, self.labels, self.x, self.leaf, self.fan = ids[order], labels[order], x[order], leaf, fan
        cut = np.arange(0, len(x), leaf)
        self.levels = [self._boxes(self.x, self.x, self.labels, self.labels, cut)] if len(x) else []
        while self.levels and len(self.levels[-1][0]) > 1:
            self.levels.append(self._boxes(*self.levels[-1], np.arange(0, len(self.levels[-1][0]), fan)))

    @staticmethod
    def _boxes(low, high, first, last, cut):
        return np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut), np.minimum.reduceat(first, cut), np.maximum.reduceat(last, cut)

    def search(self, q: np.ndarray, own: int, label: int, same: bool, windows: list[tuple], floors: list, k: int) -> list[list[tuple]]:
        """For each window of scores, its first k rows (-score, id) of the same label or of others, without the row `own`.

        The queue holds nodes by the largest score that their boxes allow. A box goes if its scores lie outside all windows,
        or below the k-th best of each; rows that tie with the k-th still count, as their ids may be smaller.
        """
        found: list[list[tuple]] = [[] for _ in windows]
        if not self.levels:
            return found
        least = [low if floor is None else max(low, floor) for (low, _), floor in zip(windows, floors)]
        plus, minus = np.maximum(q, 0), np.minimum(q, 0)
        queue, ticket = [], itertools.count()

        def push(level, a, b):
            low, high, first, last = (v[a:b] for v in self.levels[level])
            top, bottom = _held(high @ plus + low @ minus), _held(low @ plus + high @ minus)
            for i in range(len(top)):
                if not same or first[i] <= label <= last[i]:
                    if any(top[i] >= t and bottom[i] <= w[1] for t, w in zip(least, windows)):
                        heapq.heappush(queue, (-top[i], next(ticket), level, a + i, bottom[i]))

        push(len(self.levels) - 1, 0, 1)
        while queue:
            top, _, level, node, bottom = heapq.heappop(queue)
            top = -top
            if top < min(least):
                break
            if not any(top >= t and bottom <= w[1] for t, w in zip(least, windows)):
                continue
            if level:
                push(level - 1, node * self.fan, min((node + 1) * self.fan, len(self.levels[level - 1][0])))
                continue
            rows = slice(node * self.leaf, (node + 1) * self.leaf)
            ids = self.ids[rows]
            fine = (self.labels[rows] == label) == same
            fine &= ids != own
            scores, ids = _held((self.x[rows] @ q)[fine]), ids[fine]
            for w, (t, (_, high)) in enumerate(zip(least, windows)):
                some = np.flatnonzero((scores >= t) & (scores <= high))
                if not len(some):
                    continue
                if len(some) > k:
                    some = some[np.lexsort((ids[some], -scores[some]))[:k]]
                found[w] = heapq.nsmallest(k, found[w] + list(zip((-scores[some]).tolist(), ids[some].tolist())))
                if len(found[w]) == k:
                    least[w] = max(t, -found[w][-1][0])
        return found


def _windows(scores: list | None, percents: tuple[int, int]) -> list[tuple]:
    """What a negative's score may be, for each positive's score; no scores: one window that holds all."""
    if scores is None:
        return [(float("-inf"), float("inf"))]
    return [(-(-percents[0] * p // 100), percents[1] * p // 100) for p in scores]


def _packed(rows: DataFrame, n: int, sample: np.ndarray, most: int) -> DataFrame:
    """Rows (id, label, v) as shards: shard, and, in the first row of each, its box: low, high, first, last (labels)."""
    tiles, kind = max(1, -(-n // most)), rows.schema["v"].dataType
    slabs, spread = max(1, round(tiles ** (1 / 3))), np.argsort(-sample.std(axis=0), kind="stable")[:3].tolist() if sample.size else []
    at = lambda c: F.coalesce(F.try_element_at("v", F.lit(c + 1)), F.lit(0)).cast("long")
    below = lambda cuts, c: F.size(F.filter(F.lit([int(x) for x in cuts]), lambda cut: cut <= at(c))) if len(cuts) else F.lit(0)
    keys: list[Column] = [F.size("v")]
    if len(spread) == 3 and slabs > 1:
        shares = np.arange(1, slabs) / slabs
        first = np.unique(np.quantile(sample[:, spread[0]], shares).astype(np.int64))
        slab = np.searchsorted(first, sample[:, spread[0]], side="right")
        second = [np.unique(np.quantile(own, shares).astype(np.int64)) if len(own := sample[slab == s, spread[1]]) else np.zeros(0, np.int64) for s in range(len(first) + 1)]
        keys += [below(first, spread[0]), F.coalesce(*(F.when(F.col("_slab") == s, below(cuts, spread[1])) for s, cuts in enumerate(second)), F.lit(0))]
        rows = rows.withColumn("_slab", keys[1])
    keys += [at(spread[-1]) if spread else F.lit(0), F.xxhash64("id")]
    names = [f"_{i}" for i in range(len(keys))]
    dealt = rows.withColumns(dict(zip(names, keys))).repartitionByRange(tiles, *names).sortWithinPartitions(*names).select("id", "label", "v")
    schema = T.StructType([T.StructField("shard", T.LongType()), *dealt.schema.fields, T.StructField("low", kind), T.StructField("high", kind), T.StructField("first", T.LongType()), T.StructField("last", T.LongType())])

    def run(batches):
        import pyarrow as pa

        part, held, number = TaskContext.get().partitionId() << 24, [], itertools.count()

        def shard(table):
            width = len(table.column("v")[0])
            x = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            labels = table.column("label").to_numpy()
            once = lambda value, kind: pa.concat_arrays([pa.array([value], kind), pa.nulls(len(x) - 1, kind)])
            kind = table.schema.field("v").type
            columns = [pa.array(np.full(len(x), part | next(number))), *(table.column(c).combine_chunks() for c in ("id", "label", "v")), once(x.min(axis=0).tolist(), kind), once(x.max(axis=0).tolist(), kind), once(int(labels.min()), pa.int64()), once(int(labels.max()), pa.int64())]
            return pa.Table.from_arrays(columns, names=schema.names).to_batches()

        def cut(table, last):
            """Whole shards off the front: of one width, and of the largest size but for the last of a width."""
            widths = np.asarray(table.column("v").combine_chunks().value_lengths())
            edges = [0, *(np.flatnonzero(np.diff(widths)) + 1).tolist(), len(widths)]
            for a, b in zip(edges, edges[1:]):
                while b - a >= most or (a < b and (last or b < len(widths))):
                    yield table.slice(a, min(most, b - a))
                    a = min(a + most, b)
            held[:] = table.slice(a).to_batches() if not last and a < len(widths) else []

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(b.num_rows for b in held) >= most:
                for own in cut(pa.Table.from_batches(held), False):
                    yield from shard(own)
        if held:
            for own in cut(pa.Table.from_batches(held), True):
                yield from shard(own)

    return dealt.mapInArrow(in_task(run), schema)


def _tops(packed: DataFrame) -> tuple[DataFrame, dict]:
    """(group, shard) of all shards, and for each width the boxes of the groups: ids, low, high, first and last labels."""
    boxes = packed.where(F.col("low").isNotNull()).select("shard", F.size("low").alias("width"), "low", "high", "first", "last", F.shiftright("shard", 24).alias("part"))
    most = boxes.agg(F.max("part").alias("part"), F.countDistinct("width").alias("widths"), F.max("width").alias("width"), (F.max(F.col("shard").bitwiseAND((1 << 24) - 1)) + 1).alias("each")).first()
    if most.part is None:
        return boxes.select(F.col("part").alias("group"), "shard"), {}
    #: Groups of neighbouring parts, one for each shard while there are few.
    room = max(1, TOP_BYTES // (16 * max(1, most.width) * most.widths))
    whole = (most.part + 1) * most.each <= room
    step = max(1, -(-(most.part + 1) // room))
    group = F.col("shard") if whole else F.floor(F.col("part") / step)
    grouped = boxes.withColumn("group", group.cast("long"))

    def box(key, table):
        import pyarrow as pa

        low, high = (np.array(table.column(c).to_pylist(), dtype=np.int64) for c in ("low", "high"))
        return pa.table({"group": [key[0].as_py()], "width": pa.array([key[1].as_py()], pa.int32()), "low": pa.array([low.min(axis=0).tolist()], pa.list_(pa.int64())), "high": pa.array([high.max(axis=0).tolist()], pa.list_(pa.int64())), "first": [min(table.column("first").to_pylist())], "last": [max(table.column("last").to_pylist())]})

    rows = grouped.groupBy("group", "width").applyInArrow(box, "group long, width int, low array<long>, high array<long>, first long, last long").toArrow()
    widths = rows.column("width").to_numpy()
    out = {}
    for w in np.unique(widths).tolist():
        own = rows.take(np.flatnonzero(widths == w))
        low, high = (own.column(c).combine_chunks().flatten().to_numpy().reshape(-1, w) for c in ("low", "high"))
        out[w] = own.column("group").to_numpy(), low, high, own.column("first").to_numpy(), own.column("last").to_numpy()
    return materialize(grouped.select("group", "shard"), "groups"), out


def _routed(queries: DataFrame, tops: dict, same: bool, percents: tuple[int, int], exact: bool) -> DataFrame:
    """The queries with each group whose box can hold a row that they are after."""
    sent = queries.sparkSession.sparkContext.broadcast(tops)
    names = queries.columns

    def run(batches):
        import pyarrow as pa

        for whole in batches:
            for begin in range(0, whole.num_rows, 512):
                batch = whole.slice(begin, 512)
                widths = np.asarray(batch.column(names.index("v")).value_lengths())
                for w in np.unique(widths).tolist():
                    if w not in sent.value:
                        continue
                    rows = np.flatnonzero(widths == w)
                    own = batch.take(pa.array(rows))
                    groups, low, high, first, last = sent.value[w]
                    q = _matrix(own.column(names.index("v")), w, exact)
                    plus, minus = np.maximum(q, 0), np.minimum(q, 0)
                    low, high = (b.astype(q.dtype) for b in (low, high))
                    top, bottom = _held(plus @ high.T + minus @ low.T), _held(plus @ low.T + minus @ high.T)
                    fine = np.zeros(top.shape, bool)
                    for i, (scores, floors) in enumerate(zip(own.column(names.index("scores")).to_pylist(), own.column(names.index("floors")).to_pylist())):
                        given = {f["w"]: f["floor"] for f in floors or ()}
                        for n, (a, b) in enumerate(_windows(scores, percents)):
                            fine[i] |= ((top[i] >= max(a, given.get(n, a))) & (bottom[i] <= b)).astype(bool)
                    if same:
                        labels = own.column(names.index("label")).to_numpy()
                        fine &= (first[None, :] <= labels[:, None]) & (labels[:, None] <= last[None, :])
                    at, to = np.nonzero(fine)
                    for c in range(0, len(at), 4096):
                        part = own.take(pa.array(at[c : c + 4096]))
                        yield pa.RecordBatch.from_arrays([*part.columns, pa.array(groups[to[c : c + 4096]])], names=[*names, "group"])

    return queries.mapInArrow(in_task(run), T.StructType([*queries.schema.fields, T.StructField("group", T.LongType())]))


def _searched(queries: DataFrame, packed: DataFrame, blocks: int, same: bool, k: int, percents: tuple[int, int], exact: bool) -> DataFrame:
    """(anchor, w, id, score): of every query, the first k rows in each window within the shard that it names."""

    def run(left, right):
        import pyarrow as pa

        out = []
        if left.num_rows and right.num_rows:
            width = len(right.column("v")[0])
            tree = Tree(right.column("id").to_numpy(), right.column("label").to_numpy(), _matrix(right.column("v"), width, exact))
            vectors = _matrix(left.column("v"), width, exact)
            for q, own, label, scores, floors in zip(vectors, *(left.column(c).to_pylist() for c in ("id", "label", "scores", "floors"))):
                windows, given = _windows(scores, percents), {f["w"]: f["floor"] for f in floors or ()}
                for w, rows in enumerate(tree.search(q, own, label, same, windows, [given.get(n) for n in range(len(windows))], k)):
                    out += [(own, w, i, int(-s)) for s, i in rows]
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64()]
        return pa.table([pa.array(c, t) for c, t in zip(list(zip(*out)) or [[]] * 4, types)], names=["anchor", "w", "id", "score"])

    asked = queries.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)))
    there = packed.select(*(F.col(c).alias(c) for c in ("shard", "id", "label", "v")), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"))
    return asked.groupBy("shard", "block").cogroup(there.groupBy("shard", "block")).applyInArrow(run, "anchor long, w int, id long, score long")


def _first(rows: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor", "w").orderBy(F.col("score").desc(), "id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _best(queries: DataFrame, packed: DataFrame, shards: DataFrame, tops: dict, blocks: int, same: bool, k: int, percents: tuple[int, int], exact: bool, name: str) -> DataFrame:
    """(anchor, w, id, score, rank) over all shards: the anchor's own first, then those that can still hold better rows."""
    near = materialize(_searched(queries, packed, blocks, same, k, percents, exact), f"{name}-near")
    full = near.groupBy("anchor", "w").agg(F.count("id").alias("n"), F.min("score").alias("floor")).where(F.col("n") >= k)
    floors = full.groupBy("anchor").agg(F.collect_list(F.struct("w", "floor")).alias("found"))
    bounded = queries.drop("floors").join(floors, F.col("id") == F.col("anchor"), "left").select(*(F.col("found").alias("floors") if c == "floors" else F.col(c) for c in queries.columns))
    routed = _routed(bounded, tops, same, percents, exact)
    dealt = routed.withColumnRenamed("shard", "home").join(shards, "group").where(F.col("home") != F.col("shard")).drop("home", "group")
    return _first(near.unionByName(_searched(dealt, packed, blocks, same, k, percents, exact)), k)


def _whole(vector: Column, scale: int) -> Column:
    """floor(scale * x) of every component, in double precision; beyond 64 bits the largest such number."""
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))


def mine_hard_negatives(vectors: DataFrame, anchors: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = 256, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, shard: int = SHARD) -> DataFrame:
    """For the rows that meet `anchors` (a condition on id_col): anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Components become floor(scale * x). A score is the inner product with the anchor; higher ones come first, then smaller
    ids. An anchor's positives are its first `positives` other rows of its label; the negatives of a positive are the first
    `negatives` rows of other labels whose score is from `low` to `high` per cent of the positive's. Fewer are returned
    where there are fewer; an anchor without positives, or a positive without negatives, gives no row.
    Rows with a null id, label or vector, an empty vector, or a null or non-finite component take no part. Of rows that share
    an id the one of smallest label, then vector, stands for all. Vectors of other lengths never meet. Components and scores
    beyond 64 bits count as the largest such number. Ids and labels are integers; other columns do not matter. Slabs are
    fitted on SAMPLE rows, all rows are indexed, and the search is exact.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).alias("_v"), F.coalesce(anchors, F.lit(False)).alias("anchor"))
    fine = F.col("id").isNotNull() & F.col("label").isNotNull() & (F.size("_v") > 0) & F.forall("_v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = rows.where(F.coalesce(fine, F.lit(False))).select("id", "label", "anchor", _whole(F.col("_v"), scale).alias("v"))
    rows = rows.groupBy("id").agg(F.min(F.struct("label", "v", "anchor")).alias("r")).select("id", "r.label", "r.v", "r.anchor")
    rows = materialize(rows, "integers")
    most = rows.agg(F.count("id").alias("n"), F.max(F.greatest(F.array_max("v").cast("double"), -F.array_min("v").cast("double"))).alias("most"), F.max(F.size("v")).alias("width"), F.sum(F.col("anchor").cast("long")).alias("anchors")).first()
    largest = most.most or 0
    exact = largest**2 * (most.width or 1) < 1 << 52
    kind = "smallint" if largest < 1 << 15 else "int" if largest < 1 << 31 else "long"
    some = rows.where(F.size("v") == most.width).select("v", F.xxhash64("id").alias("o")).orderBy("o").limit(SAMPLE).select("v").toArrow().column(0).combine_chunks()
    sample = some.flatten().to_numpy(zero_copy_only=False).reshape(-1, most.width or 1)
    packed = materialize(_packed(rows.select("id", "label", F.col("v").cast(f"array<{kind}>").alias("v")), most.n, sample, shard), "shards")
    shards, tops = _tops(packed)
    blocks = max(1, -(-(most.anchors or 0) // BLOCK))
    asked = packed.join(rows.where("anchor").select(F.col("id").alias("_asked")), F.col("id") == F.col("_asked"), "left_semi")
    asked = materialize(asked.select("shard", "id", "label", "v", F.lit(None).cast("array<long>").alias("scores"), F.lit(None).cast("array<struct<w:int,floor:long>>").alias("floors")), "anchors")
    percents = (low, high)
    friends = materialize(_best(asked, packed, shards, tops, blocks, True, positives, percents, exact, "positives"), "positives")
    scores = friends.groupBy(F.col("anchor").alias("_a")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "score"))), lambda r: r["score"]).alias("scores"))
    again = materialize(asked.drop("scores").join(scores, F.col("id") == F.col("_a")).select(*asked.columns), "anchors-scored")
    others = _best(again, packed, shards, tops, blocks, False, negatives, percents, exact, "negatives")
    friends = friends.select("anchor", (F.col("rank") - 1).alias("w"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = others.withColumnRenamed("id", "negative_id").withColumnRenamed("score", "negative_score").join(friends, ["anchor", "w"])
    return out.select(F.col("anchor").alias("anchor_id"), "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")

