"""Matching proposals to truths: permissive many-to-one, and strict one-to-one."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..core import checkpointed, conf_int
from ..scale import ranked
from .graph import connected_components

EDGE_LIMIT_KEY = "spark.rastrum.assignmentEdges"
# The one-to-one policy.
PRIMARY_IOU = 0.25
IOU_THRESHOLDS = (0.10, 0.25, 0.50)
TOP_K = (1, 3, 5, 8)
SLACK = 1e-12
# Decision reasons.
MATCHED = "matched_primary_mask_iou_at_or_above_threshold"
NO_TRUTH = "unmatched_clean_image_has_no_truth_instances"
COMPETITION = "unmatched_one_to_one_competition"
BELOW = "unmatched_primary_mask_iou_below_threshold"


def rank_proposals(proposals: DataFrame, by: Sequence[str] = ("image_id", "method"), hot: bool | None = None) -> DataFrame:
    """1-based rank: score descending, id ascending. ``hot`` where it is known whether a group is large, else it is counted."""
    return ranked(proposals, list(by), [("score", False), ("proposal_id", True)], "rank", hot)


def image_method_base(proposals: DataFrame, truths: DataFrame, images: DataFrame, methods: DataFrame) -> DataFrame:
    """Proposal and truth counts of every expected (image, method), zeros included."""
    base = images.select("image_id").distinct().crossJoin(F.broadcast(methods))  # the method list is a handful of rows
    pc = proposals.groupBy("image_id", "method").agg(F.count("*").alias("proposal_count"))
    tc = truths.groupBy("image_id").agg(F.count("*").alias("truth_count"))
    z = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return (base.join(pc, ["image_id", "method"], "left").join(tc, "image_id", "left")
            .select("image_id", "method", z("proposal_count"), z("truth_count")))


# ---- permissive ---------------------------------------------------------------------------
def first_match(pairs: DataFrame, iou: float = 0.1, overlap: float = 0.25, centroid: bool = True) -> DataFrame:
    """Per proposal the first qualifying truth, else none, and the IoU to record.

    The recorded IoU is the best among the truths examined: up to the first that qualifies.
    """
    ok = (F.col("mask_iou") >= iou) | (F.col("truth_overlap") >= overlap)
    if centroid:
        ok = ok | F.col("centroid_inside")
    key = ["image_id", "method", "proposal_id"]
    first = pairs.groupBy(*key).agg(F.min(F.when(ok, F.col("truth_id"))).alias("matched_truth"))
    seen = pairs.join(first, key).where(F.col("matched_truth").isNull() | (F.col("truth_id") <= F.col("matched_truth")))
    return seen.groupBy(*key).agg(F.first("matched_truth").alias("matched_truth"), F.max("mask_iou").alias("iou"))


def match_permissive(proposals: DataFrame, truths: DataFrame, pairs: DataFrame, base: DataFrame, hot: bool | None = None, **rule) -> DataFrame:
    """The thirteen permissive outputs per (image, method)."""
    hit = first_match(pairs, **rule)
    p = rank_proposals(proposals, hot=hot).join(hit, ["image_id", "method", "proposal_id"], "left")
    m = F.col("matched_truth").isNotNull()
    g = p.groupBy("image_id", "method").agg(
        F.min(F.when(m, F.col("rank"))).alias("first_rank"), F.sum(m.cast("bigint")).alias("tp"),
        F.count_distinct("matched_truth").alias("found"), F.avg(F.when(m, F.col("iou"))).alias("mean_iou"), F.max(F.when(m, F.col("iou"))).alias("best_iou"))
    j = base.join(g, ["image_id", "method"], "left")
    positive = F.col("truth_count") > 0
    tp, found = F.coalesce("tp", F.lit(0)), F.coalesce("found", F.lit(0))
    hits = [F.when(F.col("first_rank").isNotNull(), F.col("first_rank") <= k).when(positive, F.lit(False)).alias(f"top_{k}_hit") for k in TOP_K]
    return j.select(
        "image_id", "method", F.col("first_rank").alias("first_true_anomaly_proposal_rank"), *hits, tp.alias("true_positive_proposals"),
        (F.col("proposal_count") - tp).alias("false_positive_proposals"), (F.col("truth_count") - found).alias("false_negative_anomalies"),
        F.when(F.col("proposal_count") > 0, tp / F.col("proposal_count")).otherwise(0.0).alias("proposal_precision"),
        F.when(positive, found / F.col("truth_count")).alias("proposal_recall"),
        F.coalesce("mean_iou", F.lit(0.0)).alias("mean_iou"), F.coalesce("best_iou", F.lit(0.0)).alias("best_iou"))


# ---- strict -------------------------------------------------------------------------------
EDGE = ["proposal_id", "truth_id", "mask_iou"]


def _best_assignment(edges: list[tuple[int, int, float]]) -> list[tuple[int, int, float]]:
    """Largest matching, of those the one with the greatest total IoU (lowest ids first on ties).

    Cheapest augmenting paths over the sparse graph: each keeps the matching optimal for its size.
    """
    edges = sorted(edges)
    left = sorted({e[0] for e in edges})
    adj: dict[int, list[tuple[int, float]]] = {}
    for a, b, w in edges:
        adj.setdefault(a, []).append((b, w))
    weight = {(a, b): w for a, b, w in edges}
    mate_l: dict[int, int] = {}
    mate_r: dict[int, int] = {}
    while True:
        dist = {a: 0.0 for a in left if a not in mate_l}
        via: dict[int, int] = {}
        best_r: dict[int, float] = {}
        queue = list(dist)
        while queue:
            nxt = []
            for a in queue:
                for b, w in adj[a]:
                    if mate_l.get(a) == b:
                        continue
                    d = dist[a] - w
                    if b not in best_r or d < best_r[b] - SLACK:
                        best_r[b], via[b] = d, a
                        if b in mate_r:
                            a2 = mate_r[b]
                            d2 = d + weight[(a2, b)]
                            if a2 not in dist or d2 < dist[a2] - SLACK:
                                dist[a2] = d2
                                nxt.append(a2)
            queue = nxt
        free = [(d, b) for b, d in best_r.items() if b not in mate_r]
        if not free:
            return [(a, b, weight[(a, b)]) for a, b in sorted(mate_l.items())]
        low = min(d for d, _ in free)
        b = min(b for d, b in free if d <= low + SLACK)
        while True:
            a = via[b]
            prev = mate_l.get(a)
            mate_l[a], mate_r[b] = b, a
            if prev is None:
                break
            b = prev


def _components_of(edges: list[tuple[int, int, float]]) -> list[list[tuple[int, int, float]]]:
    parent: dict[tuple[str, int], tuple[str, int]] = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x
    for a, b, _ in edges:
        ra, rb = find(("p", a)), find(("t", b))
        if ra != rb:
            parent[rb] = ra
    groups: dict[tuple[str, int], list[tuple[int, int, float]]] = {}
    for e in edges:
        groups.setdefault(find(("p", e[0])), []).append(e)
    return list(groups.values())


def _best_at_points(edges: list[tuple[int, int, float, int]]) -> list[tuple[int, int, float, int]]:
    """Best assignment at every operating point (bit) of the edges' last member; points with the same edges share one."""
    alive: dict[tuple[int, ...], int] = {}
    bits = 0
    for e in edges:
        bits |= e[3]
    while bits:
        bit = bits & -bits
        bits ^= bit
        there = tuple(i for i, e in enumerate(edges) if e[3] & bit)
        alive[there] = alive.get(there, 0) | bit
    won: dict[tuple[int, int, float], int] = {}
    for there, points in alive.items():
        for c in _components_of([edges[i][:3] for i in there]):
            for r in _best_assignment(c):
                won[r] = won.get(r, 0) | points
    return [(*r, points) for r, points in won.items()]


def _solve(keys: Sequence[str], at_points: bool):
    """Solver over a bucket that holds many whole groups (one call per bucket, not per tiny group)."""
    cols = [*keys, *(EDGE if not at_points else [*EDGE, "points"])]
    wide = len(cols) - len(keys)

    def best(edges: list[tuple]) -> list[tuple]:
        return _best_at_points(edges) if at_points else [r for c in _components_of(edges) for r in _best_assignment(c)]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        groups: dict[tuple, list[tuple]] = {}
        for row in zip(*[pdf[c].tolist() for c in cols]):
            groups.setdefault(row[:-wide], []).append(row[-wide:])
        rows = [(*k, *r) for k, edges in groups.items() for r in best(edges)]
        return pd.DataFrame(rows, columns=cols)
    return run


def _solve_buckets(edges: DataFrame, keys: Sequence[str], schema: str, rows: int) -> DataFrame:
    """Spread whole groups over enough hash buckets that each holds about 100,000 edges."""
    buckets = max(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows // 100_000 + 1)
    return (edges.withColumn("__bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets))).groupBy("__bucket")
            .applyInPandas(_solve(keys, "points" in edges.columns), schema))


def assign_one_to_one(edges: DataFrame, keys: Sequence[str] = ("image_id", "method")) -> DataFrame:
    """Maximum-cardinality, then maximum-IoU assignment inside each group of eligible edges.

    A component that is a star (one end shared by all its edges) is settled in the JVM: its best edge wins, ties
    to the lowest id. Only the rest goes to the small solver, one group per task; a group with more such edges than
    the configured limit is first split into its connected components. Where edges carry ``points``, the bits of
    the operating points at which they exist, every point has its own assignment, and a row's bits say where it won.
    Windows keep the layout of edges that are dealt out by a key, so those are not shuffled again.
    """
    keys = list(keys)
    at_points = "points" in edges.columns
    cols = [*keys, *EDGE, *(["points"] if at_points else [])]
    sides = {"p": [*keys, "proposal_id"], "t": [*keys, "truth_id"]}
    of = {k: Window.partitionBy(*v) for k, v in sides.items()}
    better = {"p": of["p"].orderBy(F.desc("mask_iou"), "truth_id"), "t": of["t"].orderBy(F.desc("mask_iou"), "proposal_id")}
    better = {k: w.rowsBetween(Window.unboundedPreceding, -1) for k, w in better.items()}
    taken = lambda k: F.coalesce(F.bit_or("points").over(better[k]), F.lit(0).cast("bigint"))
    e = edges.select(*cols) if at_points else edges.select(*cols, F.lit(1).cast("bigint").alias("points"))
    d = e.withColumn("__dp", F.count("*").over(of["p"]))
    d = d.withColumn("__dt", F.count("*").over(of["t"])).withColumn("__mp", F.max("__dp").over(of["t"])).withColumn("__ct", taken("t"))
    d = d.withColumn("__mt", F.max("__dt").over(of["p"])).withColumn("__cp", taken("p"))
    star = F.when((F.col("__dp") == 1) & (F.col("__mp") == 1), F.col("__ct")).when((F.col("__dt") == 1) & (F.col("__mt") == 1), F.col("__cp"))
    won = F.col("points").bitwiseAND(F.bitwise_not("__taken"))
    # read several times below; the pairs behind it are far larger. Of a star only the winners stay
    d = checkpointed(d.withColumn("__taken", star).where(F.col("__taken").isNull() | (won != 0)).select(*keys, *EDGE, "points", "__taken"))
    alone = d.where(F.col("__taken").isNotNull()).withColumn("points", won).select(*cols)
    rest = d.where(F.col("__taken").isNull()).select(*cols)
    limit = conf_int(edges.sparkSession, EDGE_LIMIT_KEY, 50_000)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rest.select(*keys).schema) + ", proposal_id bigint, truth_id bigint, mask_iou double" + (", points bigint" if at_points else "")
    counts = rest.groupBy(*keys).agg(F.count("*").alias("__n"))
    seen = counts.agg(F.max("__n").alias("top"), F.sum("__n").alias("all")).first()
    total = int(seen["all"] or 0)
    if total == 0 or seen["top"] <= limit:
        return alone.unionByName(_solve_buckets(rest, keys, schema, total))
    sizes = counts.where(F.col("__n") > limit)
    big = rest.join(sizes.drop("__n"), keys, "left_semi")
    small = rest.join(sizes.drop("__n"), keys, "left_anti")
    tag = lambda side, c: F.concat_ws("\0", *[F.col(k).cast("string") for k in keys], F.lit(side), F.col(c).cast("string"))
    graph = big.select("*", tag("p", "proposal_id").alias("src"), tag("t", "truth_id").alias("dst"))
    nodes = graph.select(F.col("src").alias("node")).distinct()
    comp = connected_components(nodes, graph.select("src", "dst")).withColumnRenamed("node", "src")
    parts = graph.join(comp, "src").drop("src", "dst")
    solved = _solve_buckets(parts, [*keys, "component"], schema.replace(", proposal_id", ", component string, proposal_id"), total)
    return alone.unionByName(_solve_buckets(small, keys, schema, total)).unionByName(solved.drop("component"))


def eligible(pairs: DataFrame, threshold: float) -> DataFrame:
    return pairs.where(F.col("mask_iou") + SLACK >= threshold)


def match_strict(proposals: DataFrame, truths: DataFrame, pairs: DataFrame, threshold: float = PRIMARY_IOU) -> DataFrame:
    """One decision row per proposal: assigned truth, evidence and the reason."""
    key = ["image_id", "method", "proposal_id"]
    got = assign_one_to_one(eligible(pairs, threshold)).select(*key, F.col("truth_id").alias("assigned_truth_id"))
    evidence = ["mask_iou", "mask_dice", "truth_overlap", "proposal_overlap", "centroid_inside"]
    # best pair per proposal: highest IoU, lowest truth id on ties; a proposal has at most one assigned truth
    order, fact = F.struct("mask_iou", -F.col("truth_id")), F.struct("truth_id", *evidence)
    seen = pairs.join(got, key, "left").groupBy(*key).agg(
        F.max_by(fact, order).alias("b"), F.max_by(F.when(F.col("truth_id") == F.col("assigned_truth_id"), fact), F.when(F.col("truth_id") == F.col("assigned_truth_id"), order)).alias("m"),
        F.max("assigned_truth_id").alias("assigned_truth_id"))
    has = truths.select("image_id").distinct().withColumn("has_truth", F.lit(True))
    j = proposals.select(*key, "score").join(has, "image_id", "left").join(seen, key, "left")
    ev = F.coalesce("m", "b")
    matched = F.col("assigned_truth_id").isNotNull()
    reason = (F.when(matched, MATCHED).when(F.col("has_truth").isNull(), NO_TRUTH)
              .when(F.coalesce(F.col("b.mask_iou"), F.lit(0.0)) + SLACK >= threshold, COMPETITION).otherwise(BELOW))
    return j.select(*key, "score", "assigned_truth_id", matched.alias("matched"), F.lit(threshold).alias("match_threshold"),
                    *[F.coalesce(ev[c], F.lit(0.0)).alias(c) for c in evidence[:-1]],
                    F.coalesce(ev["centroid_inside"], F.lit(False)).alias("centroid_inside_truth_diagnostic"), reason.alias("decision_reason"))


def unmatched_truths(truths: DataFrame, methods: DataFrame, decisions: DataFrame) -> DataFrame:
    all_ = truths.select("image_id", "truth_id").crossJoin(F.broadcast(methods))
    return all_.join(decisions.where("matched").select("image_id", "method", F.col("assigned_truth_id").alias("truth_id")),
                     ["image_id", "method", "truth_id"], "left_anti")


def replay_differences(stored: DataFrame, replayed: DataFrame) -> DataFrame:
    """Decision rows that appear on one side only; empty when stored evidence reproduces itself."""
    cols = ["image_id", "method", "proposal_id", "assigned_truth_id", "matched", "decision_reason"]
    a, b = stored.select(*cols), replayed.select(*cols)
    return (a.exceptAll(b).withColumn("side", F.lit("stored")).unionByName(b.exceptAll(a).withColumn("side", F.lit("replayed"))))


# ---- ranking rules ------------------------------------------------------------------------
def ranking_faults(ranked_set: DataFrame, by: Sequence[str] = ("image_id", "method")) -> DataFrame:
    """Groups whose stored ranks are not unique, contiguous and in score/id order, with the counts."""
    by = list(by)
    want = ranked(ranked_set, by, [("score", False), ("proposal_id", True)], "__want")
    g = want.groupBy(*by).agg(
        F.count("*").alias("proposals"), F.count_distinct("rank").alias("distinct_ranks"), F.min("rank").alias("lowest"), F.max("rank").alias("highest"),
        F.sum((F.col("rank").isNull() | F.col("score").isNull()).cast("bigint")).alias("missing"),
        F.sum((F.coalesce(F.col("rank") != F.col("__want"), F.lit(True))).cast("bigint")).alias("out_of_order"))
    bad = ((F.col("missing") > 0) | (F.col("distinct_ranks") != F.col("proposals")) | (F.col("lowest") != 1)
           | (F.col("highest") != F.col("proposals")) | (F.col("out_of_order") > 0))
    return g.withColumn("valid", ~F.coalesce(bad, F.lit(True)))
