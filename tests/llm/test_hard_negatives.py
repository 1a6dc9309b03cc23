"""op12 against all pairs, with boxes that prune and boxes that cannot."""

import math
import random

import numpy as np
import pytest

from tamis.llm import hard_negatives
from tamis.llm.hard_negatives import Tree, mine_hard_negatives
from pyspark.sql import functions as F

SCHEMA = "vec_id long, embedding array<double>, label int"


def by_hand(rows, every, k=5, m=5, low=80, high=100, scale=256):
    best = {}
    for i, v, label in rows:
        if i is None or label is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        whole = [max(min(math.floor(scale * x), 2**63 - 1), -(2**63)) for x in v]
        if i not in best or (label, whole) < best[i]:
            best[i] = (label, whole)
    out = []
    for a, (label, q) in best.items():
        if a % every:
            continue
        clip = lambda x: max(min(x, 2**63 - 1), -(2**63))
        scores = [(-clip(sum(x * y for x, y in zip(q, v))), i, other == label) for i, (other, v) in best.items() if i != a and len(v) == len(q)]
        for p, i, _ in sorted(s for s in scores if s[2])[:k]:
            fine = sorted(s for s in scores if not s[2] and low * -p <= 100 * -s[0] <= high * -p)[:m]
            out += [(a, i, n + 1, j, -p, -s) for n, (s, j, _) in enumerate(fine)]
    return sorted(out)


def clustered(n, width, seed, spread=0.1, labels=4):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((12, width))
    x = centres[rng.integers(0, 12, n)] + spread * rng.standard_normal((n, width))
    return [(i, v.tolist(), int(rng.integers(0, labels))) for i, v in enumerate(x)]


@pytest.mark.parametrize("shard,top", [(8192, 32 << 20), (64, 32 << 20), (40, 700)])
def test_all_pairs(spark, monkeypatch, shard, top):
    monkeypatch.setattr(hard_negatives, "TOP_BYTES", top)
    monkeypatch.setattr(hard_negatives, "BLOCK", 7)
    rows = clustered(700, 6, shard) + [(700 + i, [0.5] * 6, i % 3) for i in range(60)]
    got = mine_hard_negatives(spark.createDataFrame(rows, SCHEMA).repartition(3), F.col("vec_id") % 20 == 0, shard=shard).collect()
    assert sorted(map(tuple, got)) == by_hand(rows, 20) and len(got) > 100


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0], 1), (1, [1.0, 2.0], 1), (2, [1.0, 1.9], 2), (3, None, 1), (4, [], 1), (5, [nan, 1.0], 2), (6, [inf, 1.0], 2), (7, [None, 1.0], 2), (None, [1.0, 2.0], 2), (8, [1.0, 2.0], None)]
    rows += [(9, [1.0, 2.0, 3.0], 2), (10, [1.0, 2.0, 3.0], 2), (20, [1.0, 2.0, 2.9], 5), (2, [1.0, 1.95], 2), (2, [9.0, 9.0], 1), (0, [1.0, 2.0], 1), (30, [-1.0, 0.0], 7), (31, [-1.0, -0.1], 7)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"id": F.lit("x"), "v": F.lit("y"), "shard": F.lit("z"), "rank": F.lit(None)})
    got = mine_hard_negatives(df, F.col("vec_id") % 10 == 0).collect()
    assert sorted(map(tuple, got)) == by_hand([(i, v, b) for i, v, b in rows], 10)
    assert mine_hard_negatives(df.limit(0), F.col("vec_id") % 10 == 0).count() == 0


def test_numbers_beyond_doubles_are_exact(spark):
    rng = random.Random(2)
    rows = [(i, [rng.choice([-1, 1]) * 10 ** rng.uniform(8, 10) for _ in range(3)], i % 2) for i in range(40)]
    huge = rows + [(40 + i, [1e30, -1e30, 5.0], i % 2) for i in range(6)]
    for own in (rows, huge):
        got = mine_hard_negatives(spark.createDataFrame(own, SCHEMA), F.col("vec_id") % 10 == 0).collect()
        assert sorted(map(tuple, got)) == by_hand(own, 10) and got


def test_the_search_leaves_boxes_out():
    rows = clustered(6000, 4, 9, spread=0.02)
    x = np.floor(256 * np.array([r[1] for r in rows]))
    tree = Tree(np.arange(6000), np.array([r[2] for r in rows]), x, leaf=64)
    read = []
    kept, tree.x = tree.x, type("Rows", (), {"__getitem__": lambda _, rows: read.append(rows) or kept[rows]})()
    for q in range(0, 6000, 600):
        found = tree.search(x[q], q, rows[q][2], True, [(float("-inf"), float("inf"))], [None], 5)[0]
        scores = x @ x[q]
        want = sorted((-scores[i], i) for i in range(6000) if i != q and rows[i][2] == rows[q][2])[:5]
        assert found == want
    assert len(read) < 0.3 * 10 * 6000 / 64
