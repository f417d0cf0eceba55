import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rastrum.llm import embedding_dedup as ed

SHAPE = "vec_id long, embedding array<float>, label int"


def brute(rows, threshold=0.93):
    ok, units = [], []
    for k, (i, v, label) in enumerate(rows):
        if label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            u = np.array(v, np.float32).astype(np.float64)
            ok.append(k)
            units.append(u / np.linalg.norm(u))
    root = {k: k for k in ok}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    n = dict.fromkeys(range(len(rows)), 0)
    for a in range(len(ok)):
        for b in range(a):
            x, y = ok[a], ok[b]
            if rows[x][2] == rows[y][2] and len(units[a]) == len(units[b]) and units[a] @ units[b] >= threshold:
                n[x] += 1
                n[y] += 1
                root[find(x)] = find(y)
    least = {}
    for k in ok:
        if rows[k][0] is not None:
            least[find(k)] = min(least.get(find(k), rows[k][0]), rows[k][0])
    out = []
    for k, (i, _, _) in enumerate(rows):
        c = least.get(find(k)) if k in root else i
        out.append((i, n[k], c, i is not None and i == c))
    return sorted(out, key=repr)


def frame(spark, rows):
    df = spark.createDataFrame(rows, SHAPE).repartition(3)
    for c in ("v", "node", "code", "weight", "links", "home", "root"):
        df = df.withColumn(c, F.lit("x"))
    return df


def got(spark, rows, recall=1.0):
    return sorted(map(tuple, ed.near_duplicates(frame(spark, rows), recall=recall).collect()), key=repr)


def drawn(seed, groups, each, dim=12, noise=0.08, labels=3):
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(groups):
        centre = rng.normal(size=dim)
        centre /= np.linalg.norm(centre)
        for _ in range(rng.integers(1, each + 1)):
            rows.append((centre + noise * rng.normal(size=dim) * rng.choice([0, 1, 1.6]), int(rng.integers(labels))))
    order = rng.permutation(len(rows))
    return [(int(order[k]), (v * rng.uniform(0.5, 3)).tolist(), label) for k, (v, label) in enumerate(rows)]


ODD = [(None, [1.0, 2.0, 0.0], 1), (900, [1.0, 2.0, 0.0], 1), (901, [2.0, 4.0, 0.1], 1), (902, [2.0, 4.0, 0.1], None), (903, None, 1), (904, [], 1), (905, [0.0, 0.0, 0.0], 1), (906, [float("nan"), 1.0, 1.0], 1), (907, [1.0, None, 1.0], 1),
       (908, [float("inf"), 1.0, 1.0], 1), (909, [3.0], 1), (910, [5.0], 1), (911, [-5.0], 1), (912, [1.0, 2.0], 1), (900, [1.0, 2.0, 0.0], 1), (913, [3e38, 3e38, 0.0], 1), (914, [1e38, 1e38, 1e30], 1), (915, [1e-30, 1e-30, 0.0], 1), (None, [0.0], 2)]


def test_odd_rows(spark):
    assert got(spark, ODD) == brute(ODD)
    assert got(spark, []) == []


@pytest.mark.parametrize("seed", range(2))
def test_every_link_at_full_recall(spark, seed, monkeypatch):
    rows = drawn(seed, 150, 5) + drawn(9, 1, 60, noise=0.05)
    want = brute(rows)
    assert sum(r[1] > 0 for r in want) > 100
    assert got(spark, rows) == want
    monkeypatch.setattr(ed, "PIECE", 16)
    monkeypatch.setattr(ed, "SLICE", 5)
    assert got(spark, rows) == want


def test_chains(spark):
    step = math.acos(0.935)
    rows = [(1000 - k, [math.cos(k * step), math.sin(k * step), 0.0, 0.0], 1) for k in range(12)]
    assert got(spark, rows) == brute(rows)


def test_recall_is_measured(spark):
    rows = drawn(5, 400, 6, dim=24, noise=0.03, labels=2)
    nodes = ed.distinct_vectors(frame(spark, rows), "vec_id", "embedding", "label")
    index = ed.fit(nodes, 0.93, 0.999)
    assert 0 < index.limit < 2 - 2 * 0.93
    assert ed.measured_recall(nodes, index, 0.93) >= 0.99
    want, have = brute(rows), got(spark, rows, 0.999)
    assert sum(r[1] for r in have) >= 0.99 * sum(r[1] for r in want)
    assert all(a[0] == b[0] and a[1] <= b[1] for a, b in zip(have, want))


def test_traversal_visits_all_that_is_near():
    rng = np.random.default_rng(3)
    unit = ed._unit(rng.normal(size=(400, 10)))
    index = ed.MultiIndex({10: (ed._codebook(unit[:, :5], 9), ed._codebook(unit[:, 5:], 7))}, 0.5)
    codes, away = index.excess(unit)
    row, column, mask = ed._visited(away, index.limit)
    seen = {(r, c): m for r, c, m in zip(row.tolist(), column.tolist(), mask.tolist())}
    for i in range(400):
        for a in range(9):
            for b in range(7):
                assert bool(seen.get((i, a), 0) >> b & 1) == (away[0][i, a] + away[1][i, b] <= 0.5)
        d = ((unit - unit[i]) ** 2).sum(axis=1)
        for j in np.flatnonzero(d <= 0.5):
            assert seen.get((i, int(codes[0][j])), 0) >> int(codes[1][j]) & 1
