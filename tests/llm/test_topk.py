import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rastrum.llm import topk


def brute(rows, k=5):
    ok = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, v in {(i, tuple(v)) for i, v in ok if i is not None and i % 50 == 0}:
        best = sorted(((-sum(a * b for a, b in zip(v, w)), (j is None, j or 0)) for j, w in ok if j != i and len(w) == len(v)))[:k]
        out += [(i, r + 1, None if j[0] else j[1], -s) for r, (s, j) in enumerate(best)]
    return sorted(out, key=repr)


def got(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("id", F.lit("x")).repartition(3)
    vectors = topk.integer_vectors(df, "vec_id", "embedding")
    return sorted(map(tuple, topk.top_k(vectors, F.col("id") % 50 == 0, 5).collect()), key=repr)


def test_odd_rows(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(120)]
    rows += [(200 + i, rows[3][1]) for i in range(30)] + [(None, rows[3][1]), (150, None), (250, []), (300, [float("nan")] * 8), (350, [None] * 8), (400, [float("inf")] * 8), (450, [1.0, 2.0]), (451, [1.0, 3.0]), (7, rows[7][1])]
    assert got(spark, rows) == brute(rows)


def test_few_and_none(spark):
    rows = [(50, [1.0, 2.0]), (51, [-1.0, 0.5]), (52, [0.0, 0.0])]
    assert got(spark, rows) == brute(rows) and len(got(spark, rows)) == 2
    assert got(spark, []) == [] and got(spark, [(1, [1.0])]) == []


@pytest.mark.parametrize("n", [16, 700])
def test_bounds_find_the_best(n, monkeypatch):
    rng = np.random.default_rng(n)
    v = rng.integers(-400, 400, (n, 24))
    v[: n // 4] = v[0]
    q = v[:9]
    low, high = v.min(axis=0), v.max(axis=0)
    step = np.maximum(1, -(-(high - low + 1) // 256))
    cells = (v - low) // step
    best = topk.best_of_block(q, np.arange(9), np.arange(n), cells, low, step, v, 5)
    for i in range(9):
        want = sorted((-int(v[j] @ q[i]), j) for j in range(n) if j != i)[:5]
        assert sorted((-s, j) for a, j, s in best if a == i) == want


def test_query_blocks_agree(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(400)]
    one = got(spark, rows)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 2)
    monkeypatch.setattr(topk, "BLOCK_ROWS", 37)
    assert got(spark, rows) == one == brute(rows)
