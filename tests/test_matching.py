"""Small hand-made cases: assignment, thresholds at the edge, ties, metric denominators, rankings."""
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from rastrum.operators import graph, masks, matching, metrics, raster, splits, vectors
from rastrum.operators.matching import _best_assignment


def brute(edges):
    best = (0, 0.0)
    for n in range(len(edges), 0, -1):
        for combo in itertools.combinations(edges, n):
            if len({e[0] for e in combo}) == n and len({e[1] for e in combo}) == n:
                best = max(best, (n, sum(e[2] for e in combo)))
        if best[0] == n:
            break
    return best


def test_assignment_against_brute_force():
    rng = random.Random(5)
    for _ in range(150):
        pairs = {(rng.randint(1, 4), rng.randint(1, 4)) for _ in range(rng.randint(1, 8))}
        edges = [(a, b, rng.choice([0.25, 0.3, 0.5, 0.5, 0.9])) for a, b in sorted(pairs)]
        got = _best_assignment(edges)
        assert len({a for a, _, _ in got}) == len(got) == len({b for _, b, _ in got})
        n, total = brute(edges)
        assert (len(got), round(sum(w for *_, w in got), 9)) == (n, round(total, 9))


def test_cardinality_before_overlap():
    # taking the 0.9 pair first would leave p2 unmatched
    assert len(_best_assignment([(1, 1, 0.9), (1, 2, 0.3), (2, 1, 0.3)])) == 2


def test_ties_take_low_ids():
    assert _best_assignment([(2, 1, 0.5), (1, 1, 0.5)]) == [(1, 1, 0.5)]


def boxes(spark, rows, cols):
    return spark.createDataFrame(rows, cols)


P = "image_id bigint, method string, proposal_id bigint, x1 bigint, y1 bigint, x2 bigint, y2 bigint, score double"
T = "image_id bigint, truth_id bigint, x1 bigint, y1 bigint, x2 bigint, y2 bigint"


@pytest.mark.parametrize("box,threshold,hit", [((0, 0, 10, 1), 0.10, True), ((0, 0, 5, 5), 0.25, True), ((0, 0, 10, 5), 0.50, True), ((0, 0, 10, 4), 0.50, False)])
def test_threshold_edges(spark, box, threshold, hit):
    p = boxes(spark, [(1, "m", 1, *box, 0.5)], P)
    t = boxes(spark, [(1, 1, 0, 0, 10, 10)], T)
    d = matching.match_strict(p, t, masks.box_pairs(p, t), threshold).first()
    assert d["matched"] is hit
    assert d["decision_reason"] == (matching.MATCHED if hit else matching.BELOW)


def test_metric_triple(spark):
    """Micro .5, macro 2/3, image 1, precision .5, clean burden 1."""
    t = boxes(spark, [(1, 1, 0, 0, 5, 5), (2, 1, 0, 0, 5, 5), (2, 2, 10, 10, 15, 15), (2, 3, 20, 20, 25, 25)], T)
    p = boxes(spark, [(1, "m", 1, 0, 0, 5, 5, .9), (2, "m", 1, 0, 0, 5, 5, .9), (2, "m", 2, 6, 0, 9, 3, .8), (3, "m", 1, 0, 0, 4, 4, .7)], P)
    images = spark.createDataFrame([(1,), (2,), (3,)], "image_id bigint")
    base = matching.image_method_base(p, t, images, spark.createDataFrame([("m",)], "method string"))
    meta = images.select("image_id", F.lit("c").alias("category"), F.lit("g").alias("acquisition_group_id"), F.lit(1.0).alias("seconds"))
    ev = metrics.image_evaluations(metrics.scoped_assignments(masks.box_pairs(p, t), p), base, meta)
    a = metrics.aggregate(ev).first()
    assert (a["micro_component_sensitivity"], a["macro_per_positive_image_recall"], a["image_level_detection_sensitivity"]) == (0.5, 0.666667, 1.0)
    assert (a["proposal_precision"], a["clean_false_proposals_per_image"], a["clean_images_with_any_proposal"]) == (0.5, 1.0, 1.0)
    unranked = metrics.by_scope(ev, {"1": "top_1"}, ranked=False).first()
    assert unranked["sensitivity"] is None


@pytest.mark.parametrize("ranks,ok", [((1, 2), True), ((1, 1), False), ((1, None), False), ((1, 3), False), ((2, 1), False)])
def test_rankings(spark, ranks, ok):
    rows = [(1, "m", 1, 0.9, ranks[0]), (1, "m", 2, 0.8, ranks[1])]
    df = spark.createDataFrame(rows, "image_id bigint, method string, proposal_id bigint, score double, rank bigint")
    assert matching.ranking_faults(df).first()["valid"] is ok


def test_split_contested_group_matches_whole(spark):
    """Splitting an oversized group into components gives the same total."""
    rng = random.Random(3)
    rows = [(1, "m", a, b, rng.choice([0.3, 0.4, 0.6])) for a, b in {(rng.randint(1, 30), rng.randint(1, 30)) for _ in range(45)}]
    e = spark.createDataFrame(rows, "image_id bigint, method string, proposal_id bigint, truth_id bigint, mask_iou double")
    total = lambda: tuple(matching.assign_one_to_one(e).agg(F.count("*"), F.round(F.sum("mask_iou"), 6)).first())
    whole = total()
    spark.conf.set("spark.rastrum.assignmentEdges", "3")
    try:
        assert total() == whole
    finally:
        spark.conf.unset("spark.rastrum.assignmentEdges")


def test_components_on_a_chain(spark):
    n = 200
    nodes = spark.range(n).withColumnRenamed("id", "node")
    edges = spark.range(n - 1).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst")).where("id <> 99")
    got = graph.connected_components(nodes, edges).groupBy("component").count().orderBy("component").collect()
    assert [(r[0], r[1]) for r in got] == [(0, 100), (100, 100)]


def test_run_length_code(spark):
    runs = spark.createDataFrame([(1, 1, 0, 0, 3), (1, 1, 1, 0, 3), (1, 1, 2, 1, 2)], "image_id bigint, box_id bigint, y bigint, x0 bigint, x1 bigint")
    code = [r["length"] for r in masks.rle_encode(runs, ["image_id", "box_id"], 3, 3).orderBy("position").collect()]
    assert code == [0, 6, 1, 1, 1]
    back = {(r["y"], r["x0"], r["x1"]) for r in masks.rle_decode(masks.rle_encode(runs, ["image_id", "box_id"], 3, 3), ["image_id", "box_id"], 3).collect()}
    assert back == {(0, 0, 3), (1, 0, 3), (2, 1, 2)}


def test_code_of_odd_masks(spark):
    """Runs that overlap, touch, repeat, reach the frame's end or start at its first pixel."""
    rng, w, h = random.Random(4), 5, 4
    rows = [(1, m, y, x, rng.randint(x + 1, w)) for m in range(60) for _ in range(rng.randint(1, 6)) for y, x in [(rng.randrange(h), rng.randrange(w))]] + [(1, 60, y, 0, w) for y in range(h)]
    lit, want = {}, {}
    for _, m, y, a, b in rows:
        lit.setdefault(m, set()).update(y * w + x for x in range(a, b))
    for m, on in lit.items():
        want[m] = [0] * (0 in on) + [len(list(g)) for _, g in itertools.groupby(range(w * h), lambda i: i in on)]
    runs = spark.createDataFrame(rows, "image_id bigint, box_id bigint, y bigint, x0 bigint, x1 bigint")
    got, ids = {}, ["image_id", "box_id"]
    code = masks.rle_encode(runs, ids, w, h)
    for r in code.orderBy("position").collect():
        assert r["bit"] == r["position"] % 2
        got.setdefault(r["box_id"], []).append(r["length"])
    assert got == want
    back = {}
    for r in masks.rle_decode(code, ids, w).collect():
        back.setdefault(r["box_id"], set()).update(r["y"] * w + x for x in range(r["x0"], r["x1"]))
    assert back == lit


def test_codec_shuffles_no_runs(spark):
    """Boxes are numbered in one exchange; their masks, codes and runs stay where they are."""
    plan = entry.queries()["f13_rle_codec"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "Generate" not in plan


def test_codes_of_many_masks_at_once(spark, monkeypatch):
    """Masks are coded as flat arrays, a few runs at a time; empty runs hold nothing and boxes without pixels have no row."""
    monkeypatch.setattr(masks.rl, "ROWS", 7)
    rng, w, h = random.Random(5), 6, 5
    def brute_code(on):
        return [0] * (0 in on) + [len(list(g)) for _, g in itertools.groupby(range(w * h), lambda i: i in on)]
    boxes = [(m, x, y, x + rng.randint(0, w - x), y + rng.randint(0, h - y)) for m in range(80) for x, y in [(rng.randrange(w), rng.randrange(h))]] + [(80, 0, 0, w, h), (81, 0, 1, w, 3)]
    want = {m: brute_code({y * w + x for y in range(b, d) for x in range(a, c)}) for m, a, b, c, d in boxes if c > a and d > b}
    codes = masks.box_codes(spark.createDataFrame(boxes, "box_id bigint, x1 bigint, y1 bigint, x2 bigint, y2 bigint"), ["box_id"], w, h)
    assert {r["box_id"]: [int(n) for n in r["code"].split(",")] for r in codes.collect()} == want
    assert all(r["runs"] == len(want[r["box_id"]]) for r in codes.collect())
    assert "MapInArrow" in entry.queries()["f13_rle_codec"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    rows = [(1, 0, 0, 2), (1, 0, 4, 4), (1, 2, 3, 3), (1, 3, 1, 6), (2, 1, 2, 2)]
    code = masks.rle_encode(spark.createDataFrame(rows, "m bigint, y bigint, x0 bigint, x1 bigint"), ["m"], w, h)
    got = {}
    for r in code.orderBy("position").collect():
        got.setdefault(r["m"], []).append(r["length"])
    assert got == {1: brute_code({0, 1, *range(19, 24)}), 2: [w * h]}


def test_large_banks_meet_in_blocks(spark, monkeypatch):
    """Exact neighbours from blocks of both sides of one table, without a row for a pair."""
    rng = np.random.default_rng(6)
    x = np.round(rng.normal(size=(400, 3)) * 2) / 2  # many ties
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    v = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    monkeypatch.setattr(vectors, "QUERY_ROWS", 70)
    monkeypatch.setattr(vectors, "BANK_ROWS", 30)
    spark.conf.set("spark.rastrum.memoryRows", "10")
    try:
        near = vectors.knn(v.where("vec_id % 2 = 1"), v.where("vec_id % 2 = 0"), 4)
        plan = near._jdf.queryExecution().executedPlan().toString()
        got = sorted((r["query_id"], r["rank"], r["vec_id"]) for r in near.collect())
    finally:
        spark.conf.unset("spark.rastrum.memoryRows")
    want = []
    for q in range(1, 400, 2):
        d = sorted((math.dist(x[q], x[i]), i) for i in range(0, 400, 2))[:4]
        want += [(q, n + 1, i) for n, (_, i) in enumerate(d)]
    assert got == sorted(want) and "Join" not in plan and "CartesianProduct" not in plan


def test_share_split_keeps_groups_and_ratio(spark):
    g = spark.range(400).select(F.col("id").alias("group_key"), (F.col("id") % 3 + 1).alias("size"), F.lit("o").alias("outcome"), F.lit("c").alias("category"))
    got = {r["split"]: r["n"] for r in splits.share_split(g, ["outcome", "category"]).groupBy("split").agg(F.sum("size").alias("n")).collect()}
    total = sum(got.values())
    for s, w in (("train", .7), ("validation", .15), ("test", .15)):
        assert abs(got[s] - w * total) <= 3


def test_ellipse_kernel():
    assert sorted(raster.ellipse(2)) == sorted([(-2, 0), (2, 0)] + [(dy, dx) for dy in (-1, 0, 1) for dx in range(-2, 3)])


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pairs_of_masks_shuffle_no_runs(spark):
    """Odd masks against pixel sets, and masks that are dealt out by image are not shuffled again."""
    rng = random.Random(5)
    def cells(n):
        return {(rng.randint(0, 9), rng.randint(0, 9)) for _ in range(n)}
    p = {(i, "AN"[i % 2], k): cells(rng.choice([1, 12, 30])) for i in range(4) for k in range(5)}
    t = {(i, k): cells(rng.choice([2, 20])) for i in range(4) for k in range(4)}
    p[0, "A", 9] = {(y, x) for y in range(3) for x in range(3)} - {(1, 1)}  # its centroid lies in a truth that it does not touch
    t[0, 9] = {(1, 1)}
    rows = lambda d: [(*k, y, x, x + 1) for k, v in d.items() for y, x in v]
    pr = spark.createDataFrame(rows(p), "image_id bigint, method string, proposal_id bigint, y bigint, x0 bigint, x1 bigint")
    tr = spark.createDataFrame(rows(t), "image_id bigint, truth_id bigint, y bigint, x0 bigint, x1 bigint")
    want = {}
    for (i, m, k), a in p.items():
        c = (sum(y for y, _ in a) // len(a), sum(x for _, x in a) // len(a))
        for (j, n), b in t.items():
            if i == j and (a & b or c in b):
                want[i, m, k, n] = (round(len(a & b) / len(a | b), 9), c in b)
    for tiles in (True, False):
        found = masks.pair_matrix(masks.whole_masks(pr, ["method", "proposal_id"]), masks.whole_masks(tr, ["truth_id"]), tiles)
        assert {tuple(r)[:4]: (round(r["mask_iou"], 9), r["centroid_inside"]) for r in found.collect()} == want
    b = spark.createDataFrame([(1, "m", 1, 1, 0, 0, 4, 4)], "image_id bigint, method string, proposal_id bigint, truth_id bigint, x1 bigint, y1 bigint, x2 bigint, y2 bigint").repartition(4, "image_id")
    m = masks.pair_matrix(masks.box_masks(b, ["image_id", "method", "proposal_id"]), masks.box_masks(b, ["image_id", "truth_id"]), False)
    assert m.first()["mask_iou"] == 1.0 and _plan(m).count("Exchange hashpartitioning") <= 2


def test_run_overlaps_shuffle_no_runs(spark):
    """Masks of odd shape against pixel sets; runs stay in the task that holds their pair."""
    rng = random.Random(8)
    made = lambda n: {(i, k): {(rng.randint(0, 40), x) for a in (rng.randint(0, 30),) for x in range(a, a + 9)} | {(rng.randint(0, 40), rng.randint(0, 40)) for _ in range(60)} for i in range(3) for k in range(n)}
    p, t = made(6), made(4)
    rows = lambda d: [(*k, y, x, x + 1) for k, v in d.items() for y, x in sorted(v)]
    pr, tr = (masks.whole_masks(spark.createDataFrame(rows(d), f"image_id bigint, {n} bigint, y bigint, x0 bigint, x1 bigint"), [n]) for d, n in ((p, "p"), (t, "t")))
    want = {(i, k, n, len(a & b)) for (i, k), a in p.items() for (j, n), b in t.items() if i == j and a & b}
    for tiles in (True, False):
        assert {tuple(r) for r in masks.run_overlaps(pr, tr, ["p"], ["t"], tiles).collect()} == want
    plan = _plan(entry.queries()["j13_run_overlap_join"](spark, "/root/testdata/sf0.001"))
    assert not any("Exchange hashpartitioning" in x and (", y#" in x or "runs#" in x) for x in plan.splitlines()) and "Exchange hashpartitioning(image_id" in plan


def test_stars_are_settled_without_python(spark):
    """A truth with many proposals, and the reverse, needs no solver; scopes are bits of one row a pair."""
    e = spark.createDataFrame([(1, "m", a, 1, w) for a, w in ((1, 0.4), (2, 0.6), (3, 0.6))] + [(2, "m", 1, b, w) for b, w in ((5, 0.3), (4, 0.3))],
                              "image_id bigint, method string, proposal_id bigint, truth_id bigint, mask_iou double")
    assert {tuple(r)[:4] for r in matching.assign_one_to_one(e).collect()} == {(1, "m", 2, 1), (2, "m", 1, 4)}
    at = e.withColumn("points", F.when(F.col("proposal_id") == 2, 1).otherwise(3).cast("bigint"))
    assert {(r["image_id"], r["proposal_id"], r["truth_id"], r["points"]) for r in matching.assign_one_to_one(at).collect()} == {(1, 2, 1, 1), (1, 3, 1, 2), (2, 1, 4, 3)}
    scoped = metrics.scoped_assignments(e.withColumn("rank", F.col("proposal_id")), None)
    # rank 1 alone is proposal 1 of the first image; at every other scope proposal 2 takes the truth
    assert {(r["image_id"], r["proposal_id"], r["truth_id"], r["points"]) for r in scoped.collect()} == {(1, 1, 1, 8), (1, 2, 1, 119), (2, 1, 4, 123)}


def test_points_match_separate_runs(spark):
    rng = random.Random(8)
    rows = [(i, a, b, rng.choice([0.3, 0.4, 0.6]), rng.randint(1, 7)) for i in range(30) for a, b in {(rng.randint(1, 4), rng.randint(1, 4)) for _ in range(6)}]
    e = spark.createDataFrame(rows, "image_id bigint, proposal_id bigint, truth_id bigint, mask_iou double, points bigint")
    got = matching.assign_one_to_one(e, ["image_id"]).collect()
    for bit in (1, 2, 4):
        for i in range(30):
            alone = [r for c in matching._components_of([(a, b, w) for j, a, b, w, p in rows if j == i and p & bit]) for r in _best_assignment(c)]
            here = [r for r in got if r["image_id"] == i and r["points"] & bit]
            assert (len(here), round(sum(r["mask_iou"] for r in here), 6)) == (len(alone), round(sum(r[2] for r in alone), 6))
