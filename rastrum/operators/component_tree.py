"""All components of a map at all thresholds from one labelling, and the calibration curve read from them.

A pixel's level is the number of thresholds it reaches. Pixels are joined in falling order of level: a
component is born with its first pixel, changes when pixels or other components join it, and each state
is one row that lives at the levels ``low < level <= high``. No pixel is copied for a threshold.

Maps are cut into blocks of ``2^bits`` pixels a side, dealt out over all executors. A component that holds no
pixel at the edge of its block is settled there. Of the others only the edge pixels go on, with the
sums that reached them at each level and the tree that joins them; four blocks make the next
round's block. So no task sees a whole image, and what a round moves grows with the blocks' outlines.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..core import checkpointed, ratio
from .matching import assign_one_to_one
from .vectors import threshold_cell, thresholds

SIDE = 31  # bits of x in a pixel's number, which orders pixels by reading
DELTA, EDGE, SETTLED = 0, 1, 2
BOX = ["first", "y1", "x1", "y2", "x2"]  # the smallest of the first three, the largest of the last two
SUMS = ["area", "score", *BOX]
STATE = ("image_id bigint, kind int, node bigint, other bigint, low int, level int, truth bigint, area bigint, score double, "
         "first bigint, y1 bigint, x1 bigint, y2 bigint, x2 bigint, hits array<struct<truth_id:bigint,n:bigint>>")
#: rows of whole blocks that a task holds as numpy arrays and states at a time, whatever the size of the input
GROUP_ROWS = 40_000
BLANK = {"other": -1, "low": 0, "truth": -1, "area": 0, "score": 0.0, **dict.fromkeys(BOX, 0), "hits": None}
COLUMNS = ["image_id", "kind", "node", "other", "low", "level", "truth", *SUMS, "hits"]


class _Sums:
    """Area, highest value, first pixel and box of each set, combined at positions."""

    def __init__(self, n: int):
        top = np.iinfo(np.int64).max
        self.cols = {"area": np.zeros(n, np.int64), "score": np.full(n, -np.inf), "first": np.full(n, top), "y1": np.full(n, top),
                     "x1": np.full(n, top), "y2": np.full(n, -1, np.int64), "x2": np.full(n, -1, np.int64)}

    def add(self, at: np.ndarray, values: dict[str, np.ndarray]) -> None:
        np.add.at(self.cols["area"], at, values["area"])
        for c in ("score", "y2", "x2"):
            np.maximum.at(self.cols[c], at, values[c])
        for c in ("first", "y1", "x1"):
            np.minimum.at(self.cols[c], at, values[c])

    def take(self, at: np.ndarray) -> dict[str, np.ndarray]:
        return {c: v[at] for c, v in self.cols.items()}


class Forest:
    """Sets of nodes; a set's root is its smallest node."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def find(self, at: np.ndarray) -> np.ndarray:
        root = self.up[at]
        while True:
            above = self.up[root]
            if np.array_equal(above, root):
                self.up[at] = root
                return root
            root = above

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            np.minimum.at(self.up, np.maximum(a, b), np.minimum(a, b))
            a, b = self.find(a), self.find(b)
            a, b = a[a != b], b[a != b]


def _neighbours(image, y, x, bits):
    """Pairs of 8-neighbours inside one block, as positions in the nodes sorted by (image, y, x)."""
    tall, wide = int(y.max()) + 2, int(x.max()) + 2
    key = (image * tall + y) * wide + x
    for dy, dx in ((0, 1), (1, -1), (1, 0), (1, 1)):
        other = key + dy * wide + dx
        at = np.minimum(np.searchsorted(key, other), len(key) - 1)
        here = np.flatnonzero((key[at] == other) & ((y >> bits) == ((y + dy) >> bits)) & ((x >> bits) == ((x + dx) >> bits)))
        yield here, at[here]


def _settle(bits: int, last_y: int, last_x: int):
    """One round over a group of whole blocks: settled states, and what open components hand on."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        images, code = np.unique(pdf["image_id"].to_numpy(), return_inverse=True)
        kind = pdf["kind"].to_numpy()
        sums, joins = kind == DELTA, kind == EDGE
        d = {c: pdf[c].to_numpy()[sums] for c in ("node", "level", "truth", *SUMS)}
        d_image = code[sums]
        order = np.lexsort((d["node"], d_image))
        new = np.ones(len(order), bool)
        new[1:] = (np.diff(d_image[order]) != 0) | (np.diff(d["node"][order]) != 0)
        image, node = d_image[order][new], d["node"][order][new]
        at = np.empty(len(order), np.int64)
        at[order] = np.cumsum(new) - 1
        n = len(node)
        y, x = node >> SIDE, node & ((1 << SIDE) - 1)
        top = np.zeros(n, np.int64)
        np.maximum.at(top, at, d["level"])
        edge = (1 << bits) - 1
        border = (((y & edge) == 0) & (y > 0)) | (((y & edge) == edge) & (y < last_y)) | (((x & edge) == 0) & (x > 0)) | (((x & edge) == edge) & (x < last_x))

        ends = [(a, b, np.minimum(top[a], top[b])) for a, b in _neighbours(image, y, x, bits)]
        if joins.any():
            place = pd.Series(np.arange(n), index=pd.MultiIndex.from_arrays([image, node]))
            find = lambda c: place.loc[pd.MultiIndex.from_arrays([code[joins], pdf[c].to_numpy()[joins]])].to_numpy()
            ends.append((find("node"), find("other"), pdf["level"].to_numpy()[joins]))
        a, b, w = (np.concatenate(c) for c in zip(*ends))
        by_w, by_level = np.argsort(-w, kind="stable"), np.argsort(-d["level"], kind="stable")
        a, b, w = a[by_w], b[by_w], w[by_w]
        d, at = {c: v[by_level] for c, v in d.items()}, at[by_level]

        sets, total = Forest(n), _Sums(n)
        since = np.zeros(n, np.int64)
        gate = np.where(border, np.arange(n), n)  # the edge pixel that speaks for an open set
        hits: dict[int, dict[int, int]] = {}
        hit = np.zeros(n, bool)
        out: list[pd.DataFrame] = []

        def emit(kind_, where, **cols):
            if len(where):
                out.append(pd.DataFrame({**BLANK, "image_id": images[image[where]], "kind": kind_, "node": node[where], **cols}))

        def close(roots, low):
            found = [[{"truth_id": t, "n": c} for t, c in sorted(hits[r].items())] if h else [] for r, h in zip(roots.tolist(), hit[roots].tolist())]
            emit(SETTLED, roots, low=low, level=since[roots], hits=pd.Series(found, dtype=object), **total.take(roots))

        for k in np.unique(np.concatenate([d["level"], w]))[::-1].tolist():
            here = slice(np.searchsorted(-d["level"], -k), np.searchsorted(-d["level"], -k, "right"))
            pairs = slice(np.searchsorted(-w, -k), np.searchsorted(-w, -k, "right"))
            come = sets.find(at[here])
            ra, rb = sets.find(a[pairs]), sets.find(b[pairs])
            ra, rb = ra[ra != rb], rb[ra != rb]
            touched = np.unique(np.concatenate([come, ra, rb]))
            closed = touched[(gate[touched] == n) & (since[touched] > 0)]
            close(closed, k)
            sets.join(ra, rb)
            root = sets.find(touched)
            spoken = gate[touched] < n
            mouth = gate[touched][spoken]
            np.minimum.at(gate, root[spoken], mouth)
            speaker = gate[root[spoken]]
            apart = mouth != speaker
            emit(EDGE, speaker[apart], other=node[mouth[apart]], level=k)

            # what was settled or arrives now goes to the set, or through the edge pixel of an open one
            goal = sets.find(closed)
            shut = gate[goal] == n
            moved = closed[shut & (goal != closed)]
            total.add(sets.find(moved), total.take(moved))
            for r, g in zip(moved[hit[moved]].tolist(), sets.find(moved[hit[moved]]).tolist()):
                mine = hits.setdefault(g, {})
                for t, c in hits.pop(r).items():
                    mine[t] = mine.get(t, 0) + c
                hit[g] = True
            handed = closed[~shut]
            plain = total.take(handed)
            for i, r in enumerate(handed.tolist()):
                if hit[r]:
                    for t, c in hits.pop(r).items():
                        emit(DELTA, gate[goal[~shut][i:i + 1]], level=k, truth=t, **{**{s: v[i:i + 1] for s, v in plain.items()}, "area": c})
                        plain["area"][i] -= c
            emit(DELTA, gate[goal[~shut]], level=k, truth=-1, **plain)

            goal = sets.find(at[here])
            shut = gate[goal] == n
            values = {c: d[c][here] for c in SUMS}
            total.add(goal[shut], {c: v[shut] for c, v in values.items()})
            told = shut & (d["truth"][here] >= 0)
            for g, t, c in zip(goal[told].tolist(), d["truth"][here][told].tolist(), values["area"][told].tolist()):
                mine = hits.setdefault(g, {})
                mine[t] = mine.get(t, 0) + c
            hit[goal[told]] = True
            stay = np.where(border[at[here]], at[here], gate[goal])[~shut]
            emit(DELTA, stay, level=k, truth=d["truth"][here][~shut], **{c: v[~shut] for c, v in values.items()})
            since[root] = k
        roots = np.flatnonzero((sets.up == np.arange(n)) & (gate == n) & (since > 0))
        close(roots, 0)
        if not out:
            return pd.DataFrame({c: [] for c in COLUMNS})
        done = pd.concat(out, ignore_index=True)
        delta = done["kind"] == DELTA
        same = done[delta].groupby(["image_id", "kind", "node", "level", "truth"], as_index=False).agg({"area": "sum", **dict.fromkeys(("score", "y2", "x2"), "max"), **dict.fromkeys(("first", "y1", "x1"), "min")})
        return pd.concat([done[~delta], same.assign(other=-1, low=0, hits=None)], ignore_index=True)[COLUMNS]
    return run


def component_tree(pixels: DataFrame, bits: int = 7, rows: int = GROUP_ROWS) -> DataFrame:
    """(image_id, low, high, area, score, first, x1, y1, x2, y2, hits): the states of all 8-connected components.

    ``pixels``: image_id, y, x (each from 0, below 2^31), level (a pixel below every threshold has 0 and takes no
    part), v, truth (a number from 0, null outside any truth). A state is the component at every level in
    ``low < level <= high``; ``first`` numbers its first pixel in reading order, ``hits`` counts its pixels
    in each truth. Blocks are dealt into groups of about ``rows`` rows. No pixels: no rows.
    """
    number = F.shiftleft(F.col("y").cast("bigint"), SIDE) + F.col("x")
    state = checkpointed(pixels.where("level > 0").select(
        "image_id", F.lit(DELTA).alias("kind"), number.alias("node"), F.lit(-1).cast("bigint").alias("other"), F.lit(0).alias("low"), F.col("level").cast("int").alias("level"),
        F.coalesce("truth", F.lit(-1)).cast("bigint").alias("truth"), F.lit(1).cast("bigint").alias("area"), F.col("v").cast("double").alias("score"), number.alias("first"),
        F.col("y").cast("bigint").alias("y1"), F.col("x").cast("bigint").alias("x1"), (F.col("y") + 1).cast("bigint").alias("y2"), (F.col("x") + 1).cast("bigint").alias("x2")))
    seen = state.agg(F.max(F.col("y2") - 1).alias("y"), F.max(F.col("x2") - 1).alias("x"), F.count("*").alias("n")).first()
    last_y, last_x, size = seen["y"] or 0, seen["x"] or 0, seen["n"]
    settled = None
    while True:
        block = [F.shiftright(F.shiftright("node", SIDE), bits), F.shiftright(F.col("node").bitwiseAND((1 << SIDE) - 1), bits)]
        groups = max(8, size // rows)
        carried = state.select("image_id", "kind", "node", "other", "level", "truth", *SUMS)
        out = checkpointed(carried.groupBy(F.pmod(F.xxhash64("image_id", *block), F.lit(groups)).alias("__group")).applyInPandas(_settle(bits, last_y, last_x), STATE))
        done = out.where(F.col("kind") == SETTLED)
        settled = done if settled is None else settled.unionByName(done)
        if max(last_y, last_x) >> bits == 0:
            return settled.select("image_id", "low", F.col("level").alias("high"), "area", "score", "first", "x1", "y1", "x2", "y2", "hits")
        state, bits = out.where(F.col("kind") != SETTLED), bits + 1
        size = state.count()


def at_thresholds(tree: DataFrame, minimum: int = 16, keep: int = 8) -> DataFrame:
    """Ranked proposals of each image at each level: large enough, by score, area and box, the first ``keep``."""
    w = Window.partitionBy("image_id", "level").orderBy(F.desc("score"), F.desc("area"), "x1", "y1", "x2", "y2", "first")
    alive = tree.where(F.col("area") >= minimum).withColumn("level", F.explode(F.sequence(F.col("low") + 1, F.col("high"))))
    return alive.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= keep).drop("low", "high")


def candidate_thresholds(maps: DataFrame, count: int = 101) -> list[float]:
    """Distinct pooled quantiles of a map's values, rising, and the next single-precision number above the maximum."""
    values = thresholds(maps, count).first()["thr"]
    return [*values, float(np.nextafter(np.float32(values[-1]), np.float32(np.inf)))] if values else []


def calibration_points(maps: DataFrame, truths: DataFrame, images: DataFrame, minimum: int = 16, keep: int = 8, count: int = 101,
                       iou: float = 0.25) -> tuple[DataFrame, DataFrame]:
    """(curve, categories): every measure of every candidate threshold, and the sensitivity of each category.

    ``maps``: image_id, y, x, v; values that are null or not finite take no part. ``truths``: image_id, y, x, truth (a
    number from 0; one row a pixel). ``images``: image_id, clean, category, one row each. A clean image's truths
    are not looked at. ``point`` counts from the highest threshold, 0. Proposals and truths are assigned one to
    one; an image without proposals counts with zeros, a positive one without truths has no recall, and a
    measure without a denominator is null. No finite value in any map: no points.
    """
    finite = maps.where(F.col("v").isNotNull() & ~F.isnan("v") & (F.abs("v") < float("inf")))
    cuts = candidate_thresholds(finite, count)
    spark = maps.sparkSession
    points = spark.createDataFrame([(len(cuts) - i, i, t) for i, t in enumerate(cuts, 1)], "point int, level int, threshold double")
    positive = images.where(~F.col("clean")).select("image_id", "category")
    told = truths.join(positive, "image_id", "left_semi")
    cells = threshold_cell(finite.select("image_id", "y", "x", "v"), cuts, "level") if cuts else finite.select("image_id", "y", "x", "v", F.lit(0).alias("level"))
    tree = component_tree(cells.join(told.select("image_id", "y", "x", "truth"), ["image_id", "y", "x"], "left"))
    top = checkpointed(at_thresholds(tree, minimum, keep))

    size = told.groupBy("image_id", F.col("truth").alias("truth_id")).agg(F.count("*").alias("truth_area"))
    met = top.select("image_id", "level", F.col("rank").alias("proposal_id"), "area", F.explode("hits").alias("h")).select("*", "h.truth_id", "h.n")
    pairs = met.join(size, ["image_id", "truth_id"]).withColumn("mask_iou", F.col("n") / (F.col("area") + F.col("truth_area") - F.col("n")))
    links = assign_one_to_one(pairs.where(F.col("mask_iou") + 1e-12 >= iou), ["image_id", "level"])
    wanted = size.groupBy("image_id").agg(F.count("*").alias("truths"))
    matched = links.groupBy("image_id", "level").agg(F.count("*").alias("m"))
    found = checkpointed(matched.join(positive, "image_id").join(wanted, "image_id"))

    known = images.join(wanted, "image_id", "left").agg(
        F.count("*").alias("images"), F.count(F.when(F.col("clean"), 1)).alias("cleans"), F.count(F.when(~F.col("clean"), 1)).alias("positives"),
        F.count(F.when(~F.col("clean") & (F.col("truths") > 0), 1)).alias("with_truth"), F.sum(F.when(~F.col("clean"), F.col("truths"))).alias("truths"))
    per_image = top.groupBy("image_id", "level").agg(F.count("*").alias("n")).join(images.select("image_id", "clean"), "image_id")
    offered = per_image.groupBy("level").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("clean"), F.col("n"))).alias("clean_n"), F.count(F.when(F.col("clean"), 1)).alias("clean_any"))
    reached = found.groupBy("level").agg(F.sum("m").alias("m"), F.sum(F.col("m") / F.col("truths")).alias("recall"), F.count("*").alias("detected"))
    z = lambda c: F.coalesce(c, F.lit(0))
    curve = (points.join(offered, "level", "left").join(reached, "level", "left").crossJoin(F.broadcast(known)).select(  # one row
        "point", "threshold", ratio(z("clean_n"), F.col("cleans")).alias("clean_fp"), ratio(z("clean_any"), F.col("cleans")).alias("clean_any"),
        ratio(z("m"), F.col("truths")).alias("sensitivity"), ratio(z("recall"), F.col("with_truth")).alias("macro_recall"),
        ratio(z("detected"), F.col("positives")).alias("image_sensitivity"), ratio(z("m"), z("n")).alias("precision"), ratio(z("n"), F.col("images")).alias("proposals_per_image")))
    kinds = positive.join(wanted, "image_id", "left").groupBy("category").agg(F.sum("truths").alias("truths"))
    hit = found.groupBy("level", F.col("category").alias("hit_category")).agg(F.sum("m").alias("m"))
    grid = kinds.crossJoin(F.broadcast(points)).withColumnRenamed("level", "at")  # categories x at most count + 1 points
    by_kind = grid.join(hit, (F.col("at") == F.col("level")) & F.col("category").eqNullSafe(F.col("hit_category")), "left")
    return curve, by_kind.select("point", "threshold", "category", ratio(z("m"), F.col("truths")).alias("sensitivity"))
