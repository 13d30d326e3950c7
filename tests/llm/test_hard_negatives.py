import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from answerloom.llm import hard_negatives as hn

ANCHOR = "vec_id % 10 = 0"


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("q", F.lit("x")).withColumn("rank", F.lit(0))


def brute(rows):
    kept = {}
    for vec_id, v, label in rows:
        if vec_id is None or label is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        q = [math.floor(256 * float(np.float32(x))) for x in v]
        if sum(x * x for x in q) < 2**62:
            kept[vec_id] = min(kept.get(vec_id, (label, q)), (label, q))
    out = set()
    for a, (label, q) in kept.items():
        if a % 10:
            continue
        scored = sorted((-sum(x * y for x, y in zip(q, p)), i, own) for i, (own, p) in kept.items() if i != a and len(p) == len(q))
        for ps, p, _ in [s for s in scored if s[2] == label][:5]:
            inside = [s for s in scored if s[2] != label and 30 * -ps <= 100 * -s[0] <= 90 * -ps][:10]
            out |= {(a, p, r, n, -ps, -ns) for r, (ns, n, _) in enumerate(inside, 1)}
    return out


def cloud(n, d, seed, spread, labels=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, d))
    return [(i, (centres[i % 5] + spread * rng.normal(size=d)).astype(np.float32).tolist(), int(rng.integers(labels))) for i in range(n)]


@pytest.mark.parametrize(("block", "shard", "spread"), [(hn.BLOCK, hn.SHARD, 0.3), (7, 50, 0.3), (13, 1000, 0.0), (1000, 40, 5.0)])
def test_rows_agree_with_brute_force(spark, monkeypatch, block, shard, spread):
    monkeypatch.setattr(hn, "BLOCK", block)
    monkeypatch.setattr(hn, "SHARD", shard)
    rows = cloud(400, 8, 3, spread) + [(None, [1.0] * 8, 1), (1000, None, 1), (1010, [1.0] * 8, None), (1020, [], 1), (1030, [None] * 8, 2),
                                       (1040, [float("nan")] * 8, 2), (1050, [float("inf")] * 8, 1), (1060, [1e30] * 8, 0), (1070, [1.0] * 3, 0), (1080, [2.0] * 3, 0),
                                       (1081, [0.7] * 3, 1), (1090, [0.0] * 8, 1), (1091, [3e4] * 8, 2), (5, [0.5] * 8, 2), (5, [0.25] * 8, 2)]
    got = {tuple(r) for r in hn.mine(table(spark, rows), F.expr(ANCHOR)).collect()}
    assert got == brute(rows)
    assert got


def test_lone_rows_and_empty_table(spark):
    for rows in ([], [(0, [1.0, 2.0], 1)], [(0, [1.0], 1), (1, [1.0], 2)], [(0, [1.0], 1), (1, [1.0], 1)]):
        assert hn.mine(table(spark, rows), F.expr(ANCHOR)).count() == 0


def test_tree_spans_with_bounded_depth():
    rng = random.Random(2)
    points = np.array([[i + rng.random() / 3, 0.0] for i in range(120)])  # a chain
    parent, length = hn.spanning_tree(points)
    depth = [0] * 120
    for node in range(120):
        at = node
        while parent[at] >= 0:
            assert length[at] >= abs(points[at][0] - points[parent[at]][0]) - 1e-9
            at, depth[node] = parent[at], depth[node] + 1
        assert at == 0
    assert max(depth) <= hn.DEPTH


def test_bounds_skip_candidates_that_no_window_meets():
    rows = cloud(3000, 8, 1, 0.01)
    vectors = np.floor(256 * np.array([v for _, v, _ in rows])).astype(np.int32)
    ids = np.arange(3000)
    walk = hn.Walk(ids, vectors, vectors[::50])
    got = {(node, tuple(at.tolist())) for node, _, at, _ in walk.run([[hn.WHOLE]] * 60, 5)}
    assert walk.scored < 0.7 * 60 * 3000
    scores = vectors[::50].astype(np.int64) @ vectors.T.astype(np.int64)
    assert got == {(i, tuple(np.lexsort((ids, -s))[:5].tolist())) for i, s in enumerate(scores)}
