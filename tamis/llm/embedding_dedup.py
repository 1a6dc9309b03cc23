"""Near-duplicate embeddings by a forest of random-projection trees with spill."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamis.llm.common import in_task, materialize
from tamis.llm.components import connected_components

#: Trees, rows that a leaf should hold, and the rows (by the hash of their id) on which splits are fitted.
TREES, LEAF, SAMPLE = 10, 400, 40_000
#: Spill on either side of a split and the spread below which a node is not split, in units of 1/sqrt(dimension), the
#: spread of unit vectors without structure.
SPILL, TIGHT = 0.12, 0.4
#: Rows of a leaf that one task compares; a larger leaf is compared in pairs of blocks of this size.
BLOCK = 4096
_TILE = 512


class Forest:
    """Trees as flat arrays: a node has a direction, a threshold and two children (>= 0 a node, < 0 the leaf ~child)."""

    def __init__(self, sample: np.ndarray, rows: int, trees: int = TREES, leaf: int = LEAF, seed: int = 11):
        self.width = sample.shape[1] if len(sample) else 1
        self.directions, self.thresholds, self.children, self.roots, self.leaves = [], [], [], [], 0
        self.rng = np.random.default_rng(seed)
        self.unit = 1 / np.sqrt(self.width)
        small = max(8, leaf * len(sample) / max(rows, 1))
        for _ in range(trees):
            self.roots.append(self._split(sample, np.arange(len(sample)), small, 0))
        self.directions = np.array(self.directions).reshape(-1, self.width)
        self.thresholds, self.children = np.array(self.thresholds), np.array(self.children, np.int64).reshape(-1, 2)
        del self.rng

    def _leaf(self) -> int:
        self.leaves += 1
        return -self.leaves

    def _split(self, x, own, small, depth) -> int:
        if len(own) <= small or depth >= 40:
            return self._leaf()
        for _ in range(3):
            direction = self.rng.standard_normal(self.width)
            direction /= np.linalg.norm(direction)
            at = x[own] @ direction
            middle = np.median(at)
            left, right = own[at <= middle + SPILL * self.unit], own[at >= middle - SPILL * self.unit]
            if at.std() >= TIGHT * self.unit and max(len(left), len(right)) <= 0.8 * len(own):
                break
        else:
            return self._leaf()
        node = len(self.thresholds)
        self.directions.append(direction)
        self.thresholds.append(middle)
        self.children.append([0, 0])
        self.children[node] = [self._split(x, left, small, depth + 1), self._split(x, right, small, depth + 1)]
        return node

    def route(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of every leaf that a row falls into; leaves are numbered through all trees."""
        rows, leaves = [], []
        todo = [(root, np.arange(len(x))) for root in self.roots]
        while todo:
            node, own = todo.pop()
            if not len(own):
                continue
            if node < 0:
                rows.append(own)
                leaves.append(np.full(len(own), -node - 1))
                continue
            at = x[own] @ self.directions[node]
            todo.append((self.children[node][0], own[at <= self.thresholds[node] + SPILL * self.unit]))
            todo.append((self.children[node][1], own[at >= self.thresholds[node] - SPILL * self.unit]))
        if not rows:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        rows, leaves = np.concatenate(rows), np.concatenate(leaves)
        order = np.lexsort((leaves, rows))
        return rows[order], leaves[order]


def _unit_rows(flat: np.ndarray, width: int, columns: int) -> np.ndarray:
    x = flat.reshape(-1, width).astype(np.float64)
    x = x / np.linalg.norm(x, axis=1)[:, None]
    return np.pad(x, ((0, 0), (0, max(0, columns - width))))[:, :columns]


def _routed(vectors: DataFrame, forest: Forest, blocks: dict[int, int] | None) -> DataFrame:
    """blocks None: (leaf, n) counts of every batch; else one row for each vector and block pair of its leaves."""
    sent = vectors.sparkSession.sparkContext.broadcast((forest, blocks))

    def run(batches):
        import pyarrow as pa

        trees, split = sent.value
        for batch in batches:
            if not batch.num_rows:
                continue
            widths = np.diff(batch.column(2).offsets.to_numpy())
            for width in np.unique(widths):
                own = np.flatnonzero(widths == width)
                part = batch.take(pa.array(own))
                flat = part.column(2).flatten().to_numpy(zero_copy_only=False)
                row, leaf = trees.route(_unit_rows(flat, width, trees.width))
                if split is None:
                    kinds, n = np.unique(leaf, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(n.astype(np.int64))], names=["leaf", "n"])
                    continue
                bounds = np.searchsorted(row, np.arange(len(own) + 1))
                raw, size = np.ascontiguousarray(flat).tobytes(), int(width) * flat.dtype.itemsize
                packed = leaf.astype(np.int32).tobytes()
                ids, copies = part.column(0).to_numpy(), part.column(1).to_numpy()
                out = []
                for r, f in zip(row.tolist(), leaf.tolist()):
                    many = split.get(f, 1)
                    mine = int(ids[r]) % many
                    for other in range(many):
                        out.append((f, int(width), min(mine, other), max(mine, other), mine, ids[r], copies[r], packed[4 * bounds[r] : 4 * bounds[r + 1]], raw[size * r : size * (r + 1)]))
                names = ["leaf", "width", "i", "j", "mine", "id", "copies", "leaves", "vector"]
                types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
                for c in range(0, len(out), 20_000):
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out[c : c + 20_000]), types)], names=names)

    schema = "leaf long, n long" if blocks is None else "leaf long, width int, i int, j int, mine int, id long, copies long, leaves binary, vector binary"
    return vectors.mapInArrow(in_task(run), schema)


def _labels(links: np.ndarray) -> np.ndarray:
    """For a boolean adjacency, the smallest index of each row's component."""
    label = np.arange(len(links))
    while True:
        new = label.copy()
        for a in range(0, len(links), _TILE):
            part = np.where(links[a : a + _TILE], label[None, :], len(links)).min(axis=1)
            new[a : a + _TILE] = np.minimum(new[a : a + _TILE], part)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def _compare(dtype: str, least: float):
    """One leaf, or two blocks of it: (u, v, k): u has k links met here first, and is joined to v."""

    def run(table):
        import pyarrow as pa

        table = table.sort_by("id")
        ids, copies, mine = (table.column(c).to_numpy() for c in ("id", "copies", "mine"))
        leaf, i, j = table.column("leaf")[0].as_py(), table.column("i")[0].as_py(), table.column("j")[0].as_py()
        x = np.frombuffer(b"".join(table.column("vector").to_pylist()), dtype).reshape(len(ids), -1).astype(np.float64)
        x /= np.linalg.norm(x, axis=1)[:, None]
        sets = [np.frombuffer(b, np.int32) for b in table.column("leaves").to_pylist()]
        flat, who = np.concatenate(sets), np.repeat(np.arange(len(ids)), [len(s) for s in sets])
        early = flat < leaf
        kinds, back = np.unique(flat[early], return_inverse=True)
        met = np.zeros((len(ids), len(kinds)), np.float32)
        met[who[early], back] = 1
        links = np.zeros((len(ids), len(ids)), bool)
        count = np.zeros(len(ids), np.int64)
        for a in range(0, len(ids), _TILE):
            near = x[a : a + _TILE] @ x.T >= least
            near[np.arange(len(near)), np.arange(a, a + len(near))] = False
            if i != j:
                near &= mine[a : a + _TILE, None] != mine[None, :]
            links[a : a + _TILE] = near
            fresh = near & (met[a : a + _TILE] @ met.T == 0)
            count[a : a + _TILE] = fresh.astype(np.float64) @ copies
        label = _labels(links)
        some = (count > 0) | (label != np.arange(len(ids)))
        return pa.table({"u": ids[some], "v": ids[label][some], "k": count[some]})

    return run


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = 0.9, trees: int = TREES, leaf: int = LEAF) -> DataFrame:
    """Per row: id, n_links, component_id, kept, by cosine (in double precision) of at least `least`.

    Rows are split by random projections again and again, with spill on both sides, in several trees; rows that share a
    leaf are compared, each pair once: in the first leaf they share. n_links counts the other rows linked directly,
    component_id is the smallest id that links reach, kept says whether that is the row's own. Links below `least` never
    occur; a few above may be missed (recall against brute force is tested; equal vectors are always linked).
    Null and empty vectors, zero vectors and those with null or non-finite components link with nothing; vectors of
    different lengths do not link. Rows with a null id link with nothing and get a null component, kept false; rows that
    share an id are one node. Other columns are not carried; ids are integers. Splits are fitted on a sample of at most
    SAMPLE rows, all rows are indexed. A leaf of any size is compared in blocks of BLOCK rows.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[vector_col].dataType
    wide = not isinstance(kind.elementType, T.FloatType)
    v = F.col(vector_col).cast("array<double>") if wide else F.col(vector_col)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v"))
    fine = F.col("id").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0)
    good = F.coalesce(fine, F.lit(False))
    groups = materialize(rows.where(good).groupBy("v").agg(F.min("id").alias("id"), F.countDistinct("id").alias("copies")).select("id", "copies", "v"), "vectors")
    n = groups.count()
    first = groups.select("v", F.xxhash64("id").alias("o")).orderBy("o").limit(SAMPLE).select("v").toArrow().column(0)
    first = first.combine_chunks()
    widths = np.diff(first.offsets.to_numpy())
    kinds, times = np.unique(widths, return_counts=True)
    width = int(kinds[np.argmax(times)]) if len(kinds) else 1
    sample = first.take(np.flatnonzero(widths == width)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
    forest = Forest(sample / np.linalg.norm(sample, axis=1)[:, None] if len(sample) else sample, n, trees, leaf)
    sizes = {r.leaf: r.n for r in _routed(groups, forest, None).groupBy("leaf").agg(F.sum("n").alias("n")).where(F.col("n") > BLOCK).collect()}
    routed = _routed(groups, forest, {k: -(-m // BLOCK) for k, m in sizes.items()})
    met = routed.groupBy("leaf", "width", "i", "j").applyInArrow(_compare("float64" if wide else "float32", least), "u long, v long, k long")
    met = materialize(met, "met")
    count = met.groupBy("u").agg(F.sum("k").alias("k"))
    label = connected_components(met.select("u", "v"))
    keys = groups.select(F.col("v").alias("key"), F.col("id").alias("node"), "copies").join(count, F.col("node") == F.col("u"), "left").drop("u").join(label.withColumnRenamed("node", "l"), F.col("node") == F.col("l"), "left")
    keys = keys.select("key", "copies", F.coalesce("k", F.lit(0)).alias("k"), F.coalesce("component", "node").alias("component"))
    own = F.when(good, F.col("v"))
    out = rows.withColumn("own", own).join(keys, F.col("own") == F.col("key"), "left")
    out = out.select(F.col("id").alias(id_col), F.coalesce(F.col("k") + F.col("copies") - 1, F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("component_id") == F.col(id_col), F.lit(False)))
