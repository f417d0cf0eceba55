"""Regions as rows of runs, their morphology by intervals, splitting and greedy merging.

A region's row is ``(ids..., y, runs, height, width)``: its sorted, disjoint, half-open runs ``(a, b)`` and
the size of its frame, which may differ from image to image. ``ids`` begins with ``image_id``. Dilation
widens runs, erosion intersects narrowed ones; a kernel is a list of rows ``(dy, a, b)``, so the work
grows with the kernel's height and the number of runs, not with its area or the frame's. All steps
group by the ids and ``y``, so rows that are dealt out by the ids are not shuffled again. Outside the
frame counts as set for erosion and as clear for dilation. Heat is one array a row of pixels.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..core import any_row, checkpointed
from .component_tree import Forest
from .graph import connected_components
from .raster import SMALL_FRAME, hull_area

IMAGE = ("image_id",)
SIZE = ["height", "width"]
CELL = 64
STRIP = 256  # rows of a frame whose parts one task labels
LABEL_ROWS = 20_000  # rows dealt into one group for labelling


# ---- runs as columns ------------------------------------------------------------------------
def run(a: Column, b: Column) -> Column:
    return F.struct(a.cast("int").alias("a"), b.cast("int").alias("b"))


def merged(runs: Column) -> Column:
    """Sorted disjoint runs; touching ones become one."""
    def add(done: Column, r: Column) -> Column:
        last = F.element_at(done, -1)
        joined = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(run(last["a"], F.greatest(last["b"], r["b"]))))
        return F.when((F.size(done) > 0) & (F.get(done, F.size(done) - 1)["b"] >= r["a"]), joined).otherwise(F.concat(done, F.array(r)))
    return F.aggregate(F.array_sort(runs), F.expr("CAST(array() AS array<struct<a:int,b:int>>)"), add)


def common(x: Column, y: Column) -> Column:
    """Runs of what both hold."""
    cut = F.transform(x, lambda r: F.filter(F.transform(y, lambda s: run(F.greatest(r["a"], s["a"]), F.least(r["b"], s["b"]))), lambda t: t["a"] < t["b"]))
    return F.flatten(cut)


def holes(x: Column, width: Column) -> Column:
    """Runs of the frame's row that are not in ``x``."""
    starts = F.concat(F.array(F.lit(0)), F.transform(x, lambda r: r["b"]))
    ends = F.concat(F.transform(x, lambda r: r["a"]), F.array(width.cast("int")))
    return F.filter(F.zip_with(starts, ends, run), lambda t: t["a"] < t["b"])


def without(x: Column, y: Column, width: Column) -> Column:
    return common(x, holes(y, width))


def length(runs: Column) -> Column:
    return F.aggregate(runs, F.lit(0).cast("bigint"), lambda n, r: n + r["b"] - r["a"])


def picked(runs: Column, values: Column) -> Column:
    """Values of a row of pixels under runs."""
    return F.flatten(F.transform(runs, lambda r: F.slice(values, r["a"] + 1, r["b"] - r["a"])))


def where_runs(runs: Column, values: Column, least: Column) -> Column:
    """Runs of the pixels under ``runs`` whose value is at least ``least``."""
    xs = F.flatten(F.transform(runs, lambda r: F.sequence(r["a"], r["b"] - 1)))
    return merged(F.transform(F.filter(xs, lambda x: F.get(values, x) >= least), lambda x: run(x, x + 1)))


# ---- kernels ----------------------------------------------------------------------------------
def _kernel_row(dy: Column, reach: Column) -> Column:
    return F.struct(dy.cast("int").alias("dy"), (-reach).cast("int").alias("a"), reach.cast("int").alias("b"))


def ellipse(radius: Column) -> Column:
    """Rows of an elliptical kernel of size ``2 * radius + 1``; the radius may differ from row to row."""
    r = radius.cast("int")
    return F.transform(F.sequence(-r, r), lambda dy: _kernel_row(dy, F.when(r == 0, 0).otherwise(F.bround(r * F.sqrt((r * r - dy * dy) / (r * r))))))


def square(radius: int) -> Column:
    return F.array(*[_kernel_row(F.lit(dy), F.lit(radius)) for dy in range(-radius, radius + 1)])


# ---- tables of rows ---------------------------------------------------------------------------
def rows_of_pixels(pixels: DataFrame, frames: DataFrame, ids: Sequence[str] = IMAGE) -> DataFrame:
    """Rows of (ids, y, x) pixels; ``frames``: image_id, height, width."""
    rows = pixels.groupBy(*ids, "y").agg(F.collect_set("x").alias("xs")).withColumn("runs", merged(F.transform("xs", lambda x: run(x, x + 1)))).drop("xs")
    return rows.join(frames, "image_id").select(*ids, "y", "runs", *SIZE)


def pixels_of_rows(rows: DataFrame, *keep: str) -> DataFrame:
    return rows.select(*keep, "y", F.explode("runs").alias("r")).select(*keep, "y", F.explode(F.sequence(F.col("r.a"), F.col("r.b") - 1)).alias("x"))


def _grouped(rows: DataFrame, ids: Sequence[str], runs: Column) -> DataFrame:
    return rows.groupBy(*ids, "y", *SIZE).agg(runs.alias("runs")).select(*ids, "y", "runs", *SIZE).where(F.size("runs") > 0)


def union(rows: DataFrame, ids: Sequence[str]) -> DataFrame:
    """One row for each (ids, y) of several."""
    return _grouped(rows, ids, merged(F.flatten(F.collect_list("runs"))))


def dilated(rows: DataFrame, ids: Sequence[str], kernel: Column) -> DataFrame:
    r = rows.select(*ids, "y", "runs", *SIZE, F.explode(kernel).alias("k")).withColumn("y", F.col("y") + F.col("k.dy")).where((F.col("y") >= 0) & (F.col("y") < F.col("height")))
    wide = F.transform("runs", lambda t: run(F.greatest(t["a"] + F.col("k.a"), F.lit(0)), F.least(t["b"] + F.col("k.b"), F.col("width"))))
    return union(r.withColumn("runs", F.filter(wide, lambda t: t["a"] < t["b"])), ids)


def eroded(rows: DataFrame, ids: Sequence[str], kernel: Column) -> DataFrame:
    r = rows.select(*ids, "y", "runs", *SIZE, kernel.alias("rows"), F.explode(kernel).alias("k")).withColumn("y", F.col("y") - F.col("k.dy")).where((F.col("y") >= 0) & (F.col("y") < F.col("height")))
    narrow = F.transform("runs", lambda t: run(F.when(t["a"] <= 0, F.lit(0)).otherwise(F.greatest(t["a"] - F.col("k.a"), F.lit(0))), F.when(t["b"] >= F.col("width"), F.col("width")).otherwise(F.least(t["b"] - F.col("k.b"), F.col("width")))))
    r = r.withColumn("runs", F.filter(narrow, lambda t: t["a"] < t["b"]))
    g = r.groupBy(*ids, "y", *SIZE).agg(F.collect_list("runs").alias("lists"), F.first("rows").alias("rows"))
    needed = F.size(F.filter("rows", lambda k: (F.col("y") + k["dy"] >= 0) & (F.col("y") + k["dy"] < F.col("height"))))
    both = F.aggregate("lists", F.array(run(F.lit(0), F.col("width"))), common)
    return g.where(F.size("lists") == needed).withColumn("runs", both).select(*ids, "y", "runs", *SIZE).where(F.size("runs") > 0)


def opened(rows: DataFrame, ids: Sequence[str], kernel: Column) -> DataFrame:
    return dilated(eroded(rows, ids, kernel), ids, kernel)


def closed(rows: DataFrame, ids: Sequence[str], kernel: Column) -> DataFrame:
    return eroded(dilated(rows, ids, kernel), ids, kernel)


def measures(rows: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Area and half-open box of every region."""
    return rows.groupBy(*ids, *SIZE).agg(
        F.sum(length(F.col("runs"))).alias("area"), F.min(F.get("runs", F.lit(0))["a"]).alias("x1"), F.min("y").alias("y1"),
        F.max(F.element_at("runs", -1)["b"]).alias("x2"), (F.max("y") + 1).alias("y2"))


def _labelled(ids: Sequence[str], reach: int):
    """Adds to runs (ids, y, a, b) the first run of the part they belong to within their strip."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(__of=pdf.groupby([*ids], sort=False).ngroup()).sort_values(["__of", "y", "a"], ignore_index=True)
        of, y, a, b = (pdf[c].to_numpy(np.int64) for c in ("__of", "y", "a", "b"))
        row, wide = of * (int(y.max()) + 2) + y, int(b.max()) + 3
        at = lambda row, x: row * wide + x + 1  # noqa: E731  ends and starts rise with it
        low = np.searchsorted(at(row, b), at(row + 1, a - reach), "right")
        high = np.searchsorted(at(row, a), at(row + 1, b + reach), "left")
        high = np.where((y + 1) % STRIP == 0, low, np.maximum(high, low))
        near = high - low
        up = np.repeat(np.arange(len(y)), near)
        sets = Forest(len(y))
        sets.join(up, np.arange(len(up)) - np.repeat(np.cumsum(near) - near - low, near))
        root = sets.find(np.arange(len(y)))
        return pdf.drop(columns=["__of", "__group"]).assign(first_y=y[root], first_a=a[root].astype(np.int32))
    return run


def parts(rows: DataFrame, ids: Sequence[str], diagonal: bool = True) -> DataFrame:
    """Rows of the 8-connected (else 4-connected) parts of every region, with ``first`` = (y, a) of the part's first run.

    The smallest run of a part is its first in reading order. Runs that touch in neighbouring rows are joined in the task
    that holds their strip of STRIP rows; only what crosses from strip to strip is joined over all tasks."""
    ids = list(ids)
    rows = checkpointed(rows.select(*ids, "y", "runs", *SIZE))
    strip = F.floor(F.col("y") / STRIP)
    groups = max(8, rows.count() // LABEL_ROWS)
    flat = rows.select(*ids, F.col("y").cast("bigint").alias("y"), *SIZE, F.explode("runs").alias("r"), F.pmod(F.xxhash64(*ids, strip), F.lit(groups)).alias("__group")).select("*", "r.*").drop("r")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in flat.drop("__group").schema)
    found = checkpointed(flat.groupBy("__group").applyInPandas(_labelled(ids, 1 if diagonal else 0), f"{kinds}, first_y bigint, first_a int"))
    first = F.struct(F.col("first_y").alias("y"), F.col("first_a").alias("a"))
    if any_row(found.where(F.col("y") >= STRIP)):
        found = found.withColumn("node", F.struct(*ids, "first_y", "first_a"))
        reach = 1 if diagonal else 0
        above = found.where(F.col("y") % STRIP == STRIP - 1).select(*ids, (F.col("y") + 1).alias("y"), F.col("a").alias("p_a"), F.col("b").alias("p_b"), F.col("node").alias("src"))
        below = found.where((F.col("y") % STRIP == 0) & (F.col("y") > 0)).select(*ids, "y", "a", "b", F.col("node").alias("dst"))
        edges = above.join(below, [*ids, "y"]).where((F.col("a") < F.col("p_b") + reach) & (F.col("p_a") < F.col("b") + reach)).select("src", "dst").distinct()
        label = connected_components(found.select("node").distinct(), edges)
        found, first = found.join(label, "node"), F.struct(F.col("component.first_y").alias("y"), F.col("component.first_a").alias("a"))
    y = F.col("y").cast(rows.schema["y"].dataType)
    return found.groupBy(*ids, first.alias("first"), y.alias("y"), *SIZE).agg(F.array_sort(F.collect_list(run(F.col("a"), F.col("b")))).alias("runs")).select(*ids, "first", "y", "runs", *SIZE)


def outer_contours(rows: DataFrame, frames: DataFrame) -> DataFrame:
    """Rows of the outlines that face the outside, one pixel wide: pixels of an image's region next to (not just
    diagonally) the frame's edge or background that reaches it. Outlines of holes, and regions inside holes, are left out.

    ``frames``: image_id, height, width. Background is 4-connected, so its parts are those that 8-connected regions divide."""
    none = F.expr("CAST(array() AS array<struct<a:int,b:int>>)")
    every = frames.select("image_id", *SIZE, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("height").cast("bigint") - 1)).alias("y"))
    back = every.join(rows.select("image_id", "y", "runs"), ["image_id", "y"], "left").withColumn("runs", holes(F.coalesce("runs", none), F.col("width")))
    found = checkpointed(parts(back.where(F.size("runs") > 0), IMAGE, diagonal=False))
    at_edge = (F.col("y") == 0) | (F.col("y") == F.col("height") - 1) | F.exists("runs", lambda r: (r["a"] == 0) | (r["b"] == F.col("width")))
    outer = found.join(found.where(at_edge).select("image_id", "first").distinct(), ["image_id", "first"], "left_semi")
    plus = F.array(*[_kernel_row(F.lit(dy), F.lit(reach)) for dy, reach in ((-1, 0), (0, 1), (1, 0))])
    near = dilated(outer, IMAGE, plus).select("image_id", "y", F.col("runs").alias("near"))
    width = F.col("width")
    edge = F.when((F.col("y") == 0) | (F.col("y") == F.col("height") - 1), F.array(run(F.lit(0), width))).otherwise(F.array(run(F.lit(0), F.lit(1)), run(width - 1, width)))
    faced = merged(F.concat(F.coalesce("near", none), edge))
    return rows.join(near, ["image_id", "y"], "left").select("image_id", "y", common(F.col("runs"), faced).alias("runs"), *SIZE).where(F.size("runs") > 0)


def leading_parts(rows: DataFrame, keep: int = 8) -> DataFrame:
    """(image_id, rank, area, x1, y1, x2, y2) of the first 8-connected parts of each image's region, numbered as two-row labelling
    meets them: by their first 2 x 2 block in reading order (no block holds two parts)."""
    start, end = F.get("runs", 0)["a"], F.element_at("runs", -1)["b"]
    block = F.struct(F.floor(F.col("y") / 2).alias("y"), F.floor(start / 2).alias("x"))
    g = parts(rows, IMAGE).groupBy("image_id", "first").agg(F.min(block).alias("block"), F.sum(length(F.col("runs"))).alias("area"), F.min(start).cast("bigint").alias("x1"), F.min("y").alias("y1"), F.max(end).cast("bigint").alias("x2"), (F.max("y") + 1).alias("y2"))
    w = Window.partitionBy("image_id").orderBy("block")
    return g.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= keep).select("image_id", "rank", "area", "x1", "y1", "x2", "y2")


def baseline_masks(edges: DataFrame, strength: DataFrame, frames: DataFrame, level: float = 128, keep: int = 8) -> DataFrame:
    """(method, image_id, rank, area, x1, y1, x2, y2) of the two simple methods: outlines of the edges, and strength above a level.

    ``edges``: image_id, y, x; ``strength``: image_id, y, x, v. An image without parts has no rows; null strength is not above."""
    contour = leading_parts(outer_contours(rows_of_pixels(edges, frames), frames), keep).withColumn("method", F.lit("contour-only baseline"))
    fixed = leading_parts(rows_of_pixels(strength.where(F.col("v") > level).select("image_id", "y", "x"), frames), keep).withColumn("method", F.lit("fixed-threshold baseline"))
    return contour.unionByName(fixed)


def heat_rows(pixels: DataFrame, value: str = "v") -> DataFrame:
    """(image_id, y, v): one array a row of pixels, x from 0."""
    return pixels.groupBy("image_id", "y").agg(F.transform(F.array_sort(F.collect_list(F.struct("x", F.col(value).cast("double").alias("v")))), lambda p: p["v"]).alias("v"))


def with_heat(rows: DataFrame, heat: DataFrame) -> DataFrame:
    return rows.join(heat, ["image_id", "y"])


# ---- splitting ----------------------------------------------------------------------------------
# Fixed values of the two ways to split a region.
SPLIT = {"least_share": 0.035, "percentile": 0.78, "deviations": 0.8, "of_maximum": 0.45, "least_seed": 12, "seed_share": 0.025, "most_seeds": 8, "least_grow": 7, "grow_share": 0.12, "least_part": 20, "coverage": 0.35}
FRAGMENT = {"least_part": 12, "box_share": 0.05, "dominant": 0.82, "most_parts": 40, "reach": 3}


def _odd(c: Column) -> Column:
    n = F.floor(c).cast("int")
    return F.when(n % 2 == 0, n + 1).otherwise(n)


def split_at_peaks(rows: DataFrame, heat: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Rows with ``part``: regions with several hot spots are divided among them, others keep part 0.

    Spots are what is above the region's own level of heat, opened, and large enough. They grow at the
    same pace; a pixel belongs to the first spot, in reading order, that reaches it. What no spot reaches goes."""
    ids = list(ids)
    rows = checkpointed(rows.select(*ids, "y", "runs", *SIZE))
    size = measures(rows, ids).select(*ids, "area", (F.col("height") * F.col("width")).alias("pixels")).where(F.col("area") >= F.col("pixels") * SPLIT["least_share"])
    large = with_heat(rows.join(size, ids), heat)
    values = large.select(*ids, F.explode(picked(F.col("runs"), F.col("v"))).alias("v"))
    level = values.groupBy(*ids).agg(F.greatest(F.percentile("v", F.lit(SPLIT["percentile"])), F.avg("v") + SPLIT["deviations"] * F.stddev_pop("v"), F.max("v") * SPLIT["of_maximum"]).alias("level"))
    high = large.join(level, ids).withColumn("runs", where_runs(F.col("runs"), F.col("v"), F.col("level"))).where(F.size("runs") > 0)
    spots = checkpointed(parts(opened(high, ids, square(1)), ids).join(size, ids))
    seeds = spots.groupBy(*ids, "first", "area").agg(F.sum(length(F.col("runs"))).alias("own")).where(F.col("own") > F.greatest(F.lit(SPLIT["least_seed"]), F.col("area") * SPLIT["seed_share"]))
    order = Window.partitionBy(*ids)
    seeds = (seeds.withColumn("n", F.count("*").over(order)).withColumn("part", F.row_number().over(order.orderBy("first")))
             .where((F.col("n") >= 2) & (F.col("part") <= SPLIT["most_seeds"])).select(*ids, "first", "part"))
    radius = ((_odd(F.greatest(F.lit(SPLIT["least_grow"]), F.floor(F.sqrt("area") * SPLIT["grow_share"]))) - 1) / 2).cast("int")
    grown = spots.join(seeds, [*ids, "first"]).withColumn("radius", radius).select(*ids, "part", "radius", "y", "runs", *SIZE)
    key = [*ids, "part", "radius"]
    reached = dilated(dilated(grown, key, ellipse(F.col("radius"))), key, ellipse(F.col("radius")))
    inside = reached.join(rows.select(*ids, "y", F.col("runs").alias("own")), [*ids, "y"]).withColumn("runs", common(F.col("runs"), F.col("own")))

    def claim(done: Column, s: Column) -> Column:
        free = without(s["runs"], done["taken"], F.col("width"))
        return F.struct(merged(F.concat(done["taken"], s["runs"])).alias("taken"), F.concat(done["got"], F.array(F.struct(s["part"].alias("part"), free.alias("runs")))).alias("got"))
    nothing = F.expr("CAST(named_struct('taken', array(), 'got', array()) AS struct<taken:array<struct<a:int,b:int>>,got:array<struct<part:int,runs:array<struct<a:int,b:int>>>>>)")
    claims = inside.groupBy(*ids, "y", *SIZE).agg(F.array_sort(F.collect_list(F.struct("part", "runs"))).alias("all")).withColumn("got", F.aggregate("all", nothing, claim)["got"])
    claimed = claims.select(*ids, "y", *SIZE, F.explode("got").alias("g")).select(*ids, "g.part", "y", "g.runs", *SIZE).where(F.size("g.runs") > 0)
    areas = claimed.groupBy(*ids, "part").agg(F.sum(length(F.col("runs"))).alias("own"))
    kept = F.count(F.when(F.col("own") > SPLIT["least_part"], 1))
    split = areas.groupBy(*ids).agg(kept.alias("kept"), F.sum("own").alias("covered")).join(size, ids).where((F.col("kept") > 1) & (F.col("covered") / F.greatest("area", F.lit(1)) > SPLIT["coverage"])).select(*ids)
    divided = claimed.join(areas.where(F.col("own") > SPLIT["least_part"]).select(*ids, "part"), [*ids, "part"]).join(split, ids)
    whole = rows.join(split, ids, "left_anti").select(*ids, F.lit(0).alias("part"), "y", "runs", *SIZE)
    return whole.unionByName(divided.select(*ids, "part", "y", "runs", *SIZE))


def split_fragments(rows: DataFrame, raw: DataFrame, minimum: int, ids: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(rows, raw rows) with ``part``: regions of several parts, none dominant, are taken apart.

    A part's raw mask is the region's raw mask close to it. Parts are numbered in reading order."""
    ids = list(ids)
    rows = checkpointed(rows.select(*ids, "y", "runs", *SIZE))
    found = checkpointed(parts(rows, ids))
    box = measures(rows, ids)
    sizes = found.groupBy(*ids, "first").agg(F.sum(length(F.col("runs"))).alias("own")).where(F.col("own") >= max(FRAGMENT["least_part"], minimum // 2))
    order = Window.partitionBy(*ids)
    sizes = sizes.withColumn("n", F.count("*").over(order)).withColumn("largest", F.max("own").over(order)).withColumn("part", F.row_number().over(order.orderBy("first"))).join(box, ids)
    wide = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1")) >= F.col("height") * F.col("width") * FRAGMENT["box_share"]
    apart = sizes.where((F.col("n") >= 2) & wide & (F.col("largest") / F.greatest("area", F.lit(1)) <= FRAGMENT["dominant"]) & (F.col("part") <= FRAGMENT["most_parts"])).select(*ids, "first", "part")
    divided = found.join(apart, [*ids, "first"]).select(*ids, "part", "y", "runs", *SIZE)
    near = dilated(divided, [*ids, "part"], square(FRAGMENT["reach"]))
    split = apart.select(*ids).distinct()
    raw = raw.select(*ids, "y", "runs", *SIZE)
    raw_parts = near.join(raw.select(*ids, "y", F.col("runs").alias("raw")), [*ids, "y"]).withColumn("runs", common(F.col("runs"), F.col("raw"))).where(F.size("runs") > 0)
    whole, raw_whole = (d.join(split, ids, "left_anti").select(*ids, F.lit(0).alias("part"), "y", "runs", *SIZE) for d in (rows, raw))
    return whole.unionByName(divided), raw_whole.unionByName(raw_parts.select(*ids, "part", "y", "runs", *SIZE))


# ---- merging --------------------------------------------------------------------------------------
# Fixed values of the two ways to merge.
OVERLAP_MERGE = {"overlap": 0.24, "containment": 0.72, "coherence": 0.44}
SIMILAR_MERGE = {"iou": 0.08, "distance": 0.13, "delta": 0.28, "contact_delta": 0.35, "contact_radius": 7, "close_share": 0.012, "least_close": 3}
PAIR = ["image_id", "left", "right"]
#: images with at most so many items, and SMALL_FRAME pixels, are merged where the image is dealt out; others in rounds over all tasks
SMALL_ITEMS = 256


def _largest_and_number(rows: list[tuple[int, list]]) -> tuple[int, int]:
    """Area of the largest 8-connected part of (y, runs) rows, and how many parts there are."""
    root: list[int] = []
    own: list[int] = []

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i
    above, last = [], None
    for y, runs in sorted(rows, key=lambda r: r[0]):
        here = []
        for r in runs:
            i = len(root)
            root.append(i)
            own.append(r["b"] - r["a"])
            for a, b, j in above if last == y - 1 else ():
                if a <= r["b"] and r["a"] <= b and find(i) != find(j):
                    own[find(i)] += own[find(j)]
                    root[find(j)] = find(i)
            here.append((r["a"], r["b"], i))
        above, last = here, y
    tops = [i for i, j in enumerate(root) if i == j]
    return max((own[i] for i in tops), default=0), len(tops)


def shapes(rows: DataFrame, ids: Sequence[str], batch: int = 50_000) -> DataFrame:
    """(ids, largest, peaks, hull_area) of regions: ``rows`` hold ids, y, runs and the runs of peaks.

    Regions are dealt into groups of about ``batch`` rows, many regions a group, runs only."""
    ids = list(ids)
    groups = max(8, rows.count() // batch)

    def shape(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for k, g in pdf.groupby(ids):
            largest = _largest_and_number(list(zip(g["y"], g["runs"])))[0]
            ends = [p for y, r in zip(g["y"], g["runs"]) for p in ((r[0]["a"], y), (r[-1]["b"] - 1, y))]
            out.append((*k, largest, _largest_and_number(list(zip(g["y"], g["peaks"])))[1], hull_area(ends)))
        return pd.DataFrame(out, columns=[*ids, "largest", "peaks", "hull_area"])
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ids)
    return rows.select(*ids, "y", "runs", "peaks").groupBy(F.pmod(F.xxhash64(*ids), F.lit(groups)).alias("__group")).applyInPandas(shape, f"{kinds}, largest bigint, peaks bigint, hull_area double")


def coherence(rows: DataFrame, heat: DataFrame, ids: Sequence[str]) -> DataFrame:
    """(ids, area, coherence) of regions that may have several parts: mean of the share of the largest part,
    of the area in its hull, of even heat and of how few peaks there are."""
    ids = list(ids)
    hot = checkpointed(with_heat(rows.select(*ids, "y", "runs", *SIZE), heat))
    values = hot.select(*ids, F.explode(picked(F.col("runs"), F.col("v"))).alias("v")).groupBy(*ids).agg(F.count("*").alias("area"), F.stddev_pop("v").alias("sd"), F.percentile("v", F.lit(0.85)).alias("p85"))
    peaks = checkpointed(hot.join(values, ids).withColumn("peaks", where_runs(F.col("runs"), F.col("v"), F.col("p85"))).drop("v"))
    j = peaks.select(*ids, "area", "sd").distinct().join(shapes(peaks, ids), ids)
    shares = [F.col("largest") / F.col("area"), F.least(F.col("area") / F.greatest("hull_area", F.lit(1.0)), F.lit(1.0)), 1 - F.least(F.col("sd") / 90, F.lit(1.0)), 1.0 / F.least(F.greatest("peaks", F.lit(1)), F.lit(5))]
    return j.select(*ids, "area", ((shares[0] + shares[1] + shares[2] + shares[3]) / 4).alias("coherence"))


def _meeting(boxes: DataFrame, grow: int) -> DataFrame:
    """Pairs of an image's items whose boxes, grown by some pixels, share a cell and touch."""
    cells = lambda lo, hi: F.sequence(F.floor((F.col(lo) - grow) / CELL), F.floor((F.col(hi) - 1 + grow) / CELL))
    side = lambda p: boxes.select("image_id", F.col("item").alias(p), *[F.col(c).alias(f"{p}_{c}") for c in ("x1", "y1", "x2", "y2", "area")],
                                  F.explode(cells("x1", "x2")).alias("cx"), *SIZE, "y1", "y2").withColumn("cy", F.explode(cells("y1", "y2"))).drop("y1", "y2")
    a, b = side("left"), side("right").drop(*SIZE)
    near = a.join(b, ["image_id", "cx", "cy"]).where("left < right")
    for lo, hi in (("x1", "x2"), ("y1", "y2")):
        near = near.where((F.col(f"left_{lo}") < F.col(f"right_{hi}") + grow) & (F.col(f"right_{lo}") < F.col(f"left_{hi}") + grow))
    return near.drop("cx", "cy").dropDuplicates(PAIR)


def _overlap(p: str) -> Column:
    lo, hi = (f"{p}1", f"{p}2")
    return F.greatest(F.least(F.col(f"left_{hi}"), F.col(f"right_{hi}")) - F.greatest(F.col(f"left_{lo}"), F.col(f"right_{lo}")), F.lit(0))


def _box(p: str) -> Column:
    return (F.col(f"{p}_x2") - F.col(f"{p}_x1")) * (F.col(f"{p}_y2") - F.col(f"{p}_y1"))


def _rows_of(rows: DataFrame, pairs: DataFrame, side: str) -> DataFrame:
    return pairs.select(*PAIR).join(rows.withColumnRenamed("item", side), ["image_id", side])


def _together(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """Rows of the union of each pair."""
    cols = [*PAIR, "y", "runs", *SIZE]
    return union(_rows_of(rows, pairs, "left").select(*cols).unionByName(_rows_of(rows, pairs, "right").select(*cols)), PAIR)


def _touched(pairs: DataFrame, changed: DataFrame | None) -> DataFrame:
    """Of pairs only those with an item that changed."""
    if changed is None:
        return pairs
    c = changed.select("image_id", F.col("left").alias("new"))
    return pairs.join(c, "image_id").where((F.col("left") == F.col("new")) | (F.col("right") == F.col("new"))).drop("new")


Scorer = Callable[[DataFrame, "DataFrame | None"], DataFrame]


def agglomerated(rows: DataFrame, scored: Scorer, finished: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, members) after merging in each image, again and again, the first pair of items that ``scored`` returns.

    ``scored(rows, changed)`` gives the pairs that may merge, of changed items only if some are named. One
    pair an image is merged in a round, so rounds are bounded by the merges of the busiest image; pairs of
    items that did not change keep their score, and images without a pair leave the rounds. ``finished`` reshapes
    united items. Members: image_id, item, into."""
    rows = checkpointed(rows.select("image_id", "item", "y", "runs", *SIZE))
    members = checkpointed(rows.select("image_id", "item", F.col("item").alias("into")).distinct())
    pairs = checkpointed(scored(rows, None).select(*PAIR))
    settled: list[tuple[DataFrame, DataFrame]] = []
    while any_row(pairs):
        chosen = checkpointed(pairs.groupBy("image_id").agg(F.min(F.struct("left", "right")).alias("p")).select("image_id", "p.left", "p.right"))
        settled.append(tuple(d.join(chosen.select("image_id"), "image_id", "left_anti") for d in (rows, members)))
        rows, members = (d.join(chosen.select("image_id"), "image_id", "left_semi") for d in (rows, members))
        moved = chosen.select("image_id", F.explode(F.array("left", "right")).alias("item"), "left")
        new = union(rows.join(moved, ["image_id", "item"]).drop("item").withColumnRenamed("left", "item"), ["image_id", "item"])
        if finished is not None:
            new = finished(new)
        rows = checkpointed(rows.join(moved, ["image_id", "item"], "left_anti").unionByName(new.select(*rows.columns)))
        into = chosen.select("image_id", F.col("right").alias("into"), "left")
        members = checkpointed(members.join(into, ["image_id", "into"], "left").select("image_id", "item", F.coalesce("left", "into").alias("into")))
        gone = moved.select("image_id", "item")
        kept = pairs.join(gone.withColumnRenamed("item", "left"), ["image_id", "left"], "left_anti").join(gone.withColumnRenamed("item", "right"), ["image_id", "right"], "left_anti")
        pairs = checkpointed(kept.select(*PAIR).unionByName(scored(rows, chosen).select(*PAIR)))
    for r, m in settled:
        rows, members = rows.unionByName(r), members.unionByName(m)
    return rows, members


class _Item(NamedTuple):
    """An item of a small frame: its pixels, area, half-open box (y1, x1, y2, x2) and mean features."""
    mask: np.ndarray
    area: int
    box: tuple[int, int, int, int]
    means: tuple[float, ...]


def _item(mask: np.ndarray, features: Sequence[np.ndarray]) -> _Item:
    ys, xs = np.flatnonzero(mask.any(axis=1)), np.flatnonzero(mask.any(axis=0))
    area = int(np.count_nonzero(mask))
    return _Item(mask, area, (int(ys[0]), int(xs[0]), int(ys[-1]) + 1, int(xs[-1]) + 1), tuple(float(f[mask].sum()) / area / 255 for f in features))


def _runs_of(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, starts and ends of the runs of a mask in reading order."""
    step = np.diff(mask.astype(np.int8), axis=1, prepend=0, append=0)
    ys, a = np.nonzero(step == 1)
    return ys, a, np.nonzero(step == -1)[1]


def _rows_in(mask: np.ndarray) -> list[tuple[int, list]]:
    rows: dict[int, list] = {}
    for y, a, b in zip(*(c.tolist() for c in _runs_of(mask))):
        rows.setdefault(y, []).append({"a": a, "b": b})
    return list(rows.items())


def _mask_dilated(mask: np.ndarray, r: int) -> np.ndarray:
    """As ``dilated`` by ``ellipse(r)``."""
    h, w = mask.shape
    sums = np.zeros((h, w + 2 * r + 1), np.int32)
    np.cumsum(mask, axis=1, out=sums[:, r + 1:r + w + 1])
    sums[:, r + w + 1:] = sums[:, r + w:r + w + 1]
    out = np.zeros_like(mask)
    for dy in range(-min(r, h - 1), min(r, h - 1) + 1):
        reach = int(np.round(r * np.sqrt((r * r - dy * dy) / (r * r))))
        wide = sums[:, r + reach + 1:r + reach + 1 + w] > sums[:, r - reach:r - reach + w]
        out[max(dy, 0):h + min(dy, 0)] |= wide[max(-dy, 0):h - max(dy, 0)]
    return out


def _mask_closed(mask: np.ndarray, r: int) -> np.ndarray:
    return ~_mask_dilated(~_mask_dilated(mask, r), r)


def _mask_coherence(mask: np.ndarray, heat: np.ndarray) -> float:
    """As ``coherence``, of one region."""
    values = np.sort(heat[mask])
    at = (len(values) - 1) * 0.85
    lo, hi = int(np.floor(at)), int(np.ceil(at))
    p85 = values[lo] if values[lo] == values[hi] else (hi - at) * values[lo] + (at - lo) * values[hi]
    rows = _rows_in(mask)
    hull = hull_area([p for y, r in rows for p in ((r[0]["a"], y), (r[-1]["b"] - 1, y))])
    peaks = _largest_and_number(_rows_in(mask & (heat >= p85)))[1]
    shares = [_largest_and_number(rows)[0] / len(values), min(len(values) / max(hull, 1.0), 1.0), 1 - min(values.std() / 90, 1.0), 1.0 / min(max(peaks, 1), 5)]
    return (shares[0] + shares[1] + shares[2] + shares[3]) / 4


def _shared_box(p: _Item, q: _Item) -> int:
    return max(min(p.box[2], q.box[2]) - max(p.box[0], q.box[0]), 0) * max(min(p.box[3], q.box[3]) - max(p.box[1], q.box[1]), 0)


def _box_area(p: _Item) -> int:
    return (p.box[2] - p.box[0]) * (p.box[3] - p.box[1])


May = Callable[[_Item, _Item, Sequence[np.ndarray]], bool]
Unite = Callable[[np.ndarray], np.ndarray]


def _to_fixpoint(items: dict[int, _Item], features: Sequence[np.ndarray], may: May, unite: Unite) -> dict[int, int]:
    """Merges the first pair that may, again and again; what each item went into. A pair is looked at again only when it changed."""
    into, age = {k: k for k in items}, dict.fromkeys(items, 0)
    todo = [(p, q, 0, 0) for p in items for q in items if p < q]
    heapq.heapify(todo)
    while todo:
        p, q, p_age, q_age = heapq.heappop(todo)
        if age.get(p) != p_age or age.get(q) != q_age or not may(items[p], items[q], features):
            continue
        items[p] = _item(unite(items[p].mask | items[q].mask), features)
        age[p] += 1
        del items[q], age[q]
        into = {k: p if v == q else v for k, v in into.items()}
        for k in items:
            if k != p:
                a, b = min(k, p), max(k, p)
                heapq.heappush(todo, (a, b, age[a], age[b]))
    return into


def _lists(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """Where each row's list begins among the values (one more at the end), and the values."""
    lists = column.combine_chunks()
    return np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))]), lists.flatten()


def _merge_frames(names: Sequence[str], may: May, unite: Unite):
    """Merges over a group of whole small images; an image whose features do not fill its frame is left out."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by([(c, "ascending") for c in ("image_id", "item", "y")])  # features, without an item, come last
        y, height, width = (pc.fill_null(table[c], 0).to_numpy() for c in ("y", "height", "width"))
        code = table["image_id"].combine_chunks().dictionary_encode().indices.to_numpy()
        item = pc.fill_null(table["item"].combine_chunks().dictionary_encode().indices, -1).to_numpy()
        begin, runs = _lists(table["runs"])
        a, b = runs.field("a").to_numpy(), runs.field("b").to_numpy()
        values = {n: _lists(table[n]) for n in names}
        values = {n: (at, v.null_count, v.to_numpy(zero_copy_only=False)) for n, (at, v) in values.items()}
        got: dict[str, list[np.ndarray]] = {c: [] for c in ("item", "y", "n", "a", "b", "member", "into")}
        edges = np.flatnonzero(np.diff(code, prepend=-1, append=-1))
        for start, end in zip(edges[:-1].tolist(), edges[1:].tolist()):
            last = start + int(np.count_nonzero(item[start:end] >= 0))
            h, w = int(height[start]), int(width[start])
            full = last > start and np.array_equal(y[last:end], np.arange(h)) and all(not null and (np.diff(at[last:end + 1]) == w).all() for at, null, _ in values.values())
            if not full:
                continue
            features = [v[at[last]:at[end]].reshape(h, w) for at, _, v in values.values()]
            of = np.flatnonzero(np.diff(item[start:last], prepend=-2, append=-2)) + start
            items = {}
            for i, j in zip(of[:-1].tolist(), of[1:].tolist()):
                first = np.repeat(y[i:j], np.diff(begin[i:j + 1])) * w
                step = np.zeros(h * w + 1, np.int8)
                step[first + a[begin[i]:begin[j]]] += 1
                step[first + b[begin[i]:begin[j]]] -= 1
                items[i] = _item(np.cumsum(step[:-1], dtype=np.int8).astype(bool).reshape(h, w), features)
            into = _to_fixpoint(items, features, may, unite)
            got["member"].append(np.array(list(into), np.int64))
            got["into"].append(np.array(list(into.values()), np.int64))
            for k, it in items.items():
                ys, r_a, r_b = _runs_of(it.mask)
                rows, n = np.unique(ys, return_counts=True)
                for c, v in (("item", np.full(len(rows), k)), ("y", rows), ("n", n), ("a", r_a), ("b", r_b)):
                    got[c].append(v)
        done = {c: np.concatenate([np.zeros(0, np.int64), *v]) for c, v in got.items()}
        rows, members = len(done["item"]), len(done["member"])
        at = np.concatenate([done["item"], done["member"]])
        lists = np.concatenate([[0], np.cumsum(done["n"]), np.full(members, done["n"].sum())])
        runs = pa.ListArray.from_arrays(pa.array(lists, pa.int32()), pa.StructArray.from_arrays([pa.array(done[c], pa.int32()) for c in "ab"], ["a", "b"]))
        goal = pa.concat_arrays([pa.nulls(rows, pa.int64()), pa.array(done["into"])])
        row = pa.concat_arrays([pa.array(done["y"]).cast(table.schema.field("y").type), pa.nulls(members, table.schema.field("y").type)])
        return pa.table({"image_id": table["image_id"].take(pa.array(at)), "item": table["item"].take(pa.array(at)), "into": table["item"].take(goal),
                         "y": row, "runs": runs, "height": table["height"].take(pa.array(at)), "width": table["width"].take(pa.array(at))})
    return run


def merged_by_image(rows: DataFrame, features: DataFrame, names: Sequence[str], may: May, unite: Unite, pixels: int = 1 << 20) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, members) of small images, merged in the task that holds the image, and the rows of all others.

    Small is a frame of up to SMALL_FRAME pixels with up to SMALL_ITEMS items, all its pixels with features. Images are
    dealt into groups of about ``pixels`` pixels."""
    rows = checkpointed(rows.select("image_id", "item", "y", "runs", *SIZE))
    area = F.max(F.col("height").cast("bigint") * F.col("width"))
    small = checkpointed(rows.groupBy("image_id").agg(area.alias("pixels"), F.size(F.collect_set("item")).alias("items")).where((F.col("pixels") <= SMALL_FRAME) & (F.col("items") <= SMALL_ITEMS)))
    groups = max(8, (small.agg(F.sum("pixels")).first()[0] or 0) // pixels)
    dealt = F.pmod(F.xxhash64("image_id"), F.lit(groups)).alias("__group")
    kind = {f.name: f.dataType for f in rows.schema}
    null = lambda c: F.lit(None).cast(kind[c]).alias(c)
    told = features.select("image_id", null("item"), F.col("y").cast(kind["y"]).alias("y"), null("runs"), *[null(c) for c in SIZE], *names)
    both = rows.select("*", *[F.lit(None).cast("array<double>").alias(n) for n in names]).unionByName(told).join(small.select("image_id"), "image_id", "left_semi")
    text = lambda c: kind[c].simpleString()
    schema = f"image_id {text('image_id')}, item {text('item')}, into {text('item')}, y {text('y')}, runs array<struct<a:int,b:int>>, height {text('height')}, width {text('width')}"
    out = checkpointed(both.groupBy(dealt).applyInArrow(lambda t: _merge_frames(names, may, unite)(t.drop_columns(["__group"]) if "__group" in t.column_names else t), schema))
    members = out.where(F.col("y").isNull()).select("image_id", "item", "into")
    rest = rows.join(members.select("image_id").distinct(), "image_id", "left_anti")
    return out.where(F.col("y").isNotNull()).drop("into"), members, rest


def _with_rest(rows: DataFrame, features: DataFrame, names: Sequence[str], may: May, unite: Unite, scored: Scorer, finished: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    done, members, rest = merged_by_image(rows, features, names, may, unite)
    if not any_row(rest):
        return done, members
    more = agglomerated(rest, scored, finished)
    return done.unionByName(more[0]), members.unionByName(more[1])


def _may_overlap(p: _Item, q: _Item, features: Sequence[np.ndarray]) -> bool:
    inside = _shared_box(p, q)
    if not inside:
        return False
    contained = inside / max(min(_box_area(p), _box_area(q)), 1) >= OVERLAP_MERGE["containment"]
    if not contained and np.count_nonzero(p.mask & q.mask) / max(min(p.area, q.area), 1) < OVERLAP_MERGE["overlap"]:
        return False
    return _mask_coherence(p.mask | q.mask, features[0]) >= OVERLAP_MERGE["coherence"]


def _may_similar(p: _Item, q: _Item, features: Sequence[np.ndarray]) -> bool:
    inside = _shared_box(p, q)
    if inside / max(_box_area(p) + _box_area(q) - inside, 1) > SIMILAR_MERGE["iou"]:
        return True
    texture, colour = (abs(m - n) for m, n in zip(p.means, q.means))
    apart = [(p.box[i] + p.box[i + 2]) / 2 - (q.box[i] + q.box[i + 2]) / 2 for i in (0, 1)]
    if np.sqrt(apart[0] ** 2 + apart[1] ** 2) < max(p.mask.shape) * SIMILAR_MERGE["distance"] and texture < SIMILAR_MERGE["delta"] and colour < SIMILAR_MERGE["delta"]:
        return True
    r = SIMILAR_MERGE["contact_radius"]
    near = all(p.box[i] < q.box[i + 2] + r and q.box[i] < p.box[i + 2] + r for i in (0, 1))
    return near and texture < SIMILAR_MERGE["contact_delta"] and bool((_mask_dilated(p.mask, r) & q.mask).any())


def _gaps_closed(mask: np.ndarray) -> np.ndarray:
    size = max(SIMILAR_MERGE["least_close"], int(min(mask.shape) * SIMILAR_MERGE["close_share"]))
    return _mask_closed(mask, size // 2)


def merge_overlaps(rows: DataFrame, heat: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Unite items of an image that overlap, or lie in each other's box, where the union is coherent."""
    def scored(rows: DataFrame, changed: DataFrame | None) -> DataFrame:
        near = _touched(_meeting(measures(rows, ["image_id", "item"]), 0), changed)
        near = checkpointed(near)
        shared = (_rows_of(rows, near, "left").select(*PAIR, "y", F.col("runs").alias("l_runs")).join(_rows_of(rows, near, "right").select(*PAIR, "y", "runs"), [*PAIR, "y"])
                  .groupBy(*PAIR).agg(F.sum(length(common(F.col("l_runs"), F.col("runs")))).alias("shared")))
        overlap = F.coalesce("shared", F.lit(0)) / F.greatest(F.least("left_area", "right_area"), F.lit(1))
        containment = _overlap("x") * _overlap("y") / F.greatest(F.least(_box("left"), _box("right")), F.lit(1))
        fit = checkpointed(near.join(shared, PAIR, "left").where((overlap >= OVERLAP_MERGE["overlap"]) | (containment >= OVERLAP_MERGE["containment"])).select(*PAIR))
        if not any_row(fit):
            return fit
        return coherence(_together(rows, fit), heat, PAIR).where(F.col("coherence") >= OVERLAP_MERGE["coherence"])
    return _with_rest(rows, heat, ["v"], _may_overlap, lambda mask: mask, scored)


def merge_similar(rows: DataFrame, features: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Unite items whose boxes overlap, that are close and alike in texture and colour, or that touch and have
    like texture; a union's small gaps are closed. ``features``: image_id, y, texture, colour (arrays)."""
    def closed_union(new: DataFrame) -> DataFrame:
        size = _odd(F.greatest(F.lit(SIMILAR_MERGE["least_close"]), F.floor(F.least("height", "width") * SIMILAR_MERGE["close_share"])))
        return closed(new, ["image_id", "item"], ellipse(((size - 1) / 2).cast("int")))

    def scored(rows: DataFrame, changed: DataFrame | None) -> DataFrame:
        ids = ["image_id", "item"]
        lit = rows.join(features, ["image_id", "y"]).select(*ids, *[F.aggregate(picked(F.col("runs"), F.col(c)), F.lit(0.0), lambda s, v: s + v).alias(c) for c in ("texture", "colour")])
        means = checkpointed(measures(rows, ids).join(lit.groupBy(*ids).agg(F.sum("texture").alias("texture"), F.sum("colour").alias("colour")), ids)
                             .withColumn("texture", F.col("texture") / F.col("area") / 255).withColumn("colour", F.col("colour") / F.col("area") / 255))
        reach = F.greatest("height", "width") * SIMILAR_MERGE["distance"]
        centre = [((F.col(f"{p}1") + F.col(f"{p}2")) / 2).alias(p) for p in "xy"]
        points = means.select(*ids, *centre, *SIZE, reach.alias("reach")).withColumn("cx", F.floor(F.col("x") / F.col("reach"))).withColumn("cy", F.floor(F.col("y") / F.col("reach")))
        around = [F.explode(F.sequence(F.col(c) - 1, F.col(c) + 1)).alias(c) for c in ("cx", "cy")]
        a = points.select("image_id", F.col("item").alias("left"), F.col("x").alias("l_x"), F.col("y").alias("l_y"), "reach", around[0], "cy").select("image_id", "left", "l_x", "l_y", "reach", "cx", around[1])
        close = (a.join(points.select("image_id", F.col("item").alias("right"), "x", "y", "cx", "cy"), ["image_id", "cx", "cy"]).where("left < right")
                 .where(F.sqrt(F.pow(F.col("l_x") - F.col("x"), 2) + F.pow(F.col("l_y") - F.col("y"), 2)) < F.col("reach")).select(*PAIR, F.lit(True).alias("close")))
        near = checkpointed(_touched(_meeting(means, SIMILAR_MERGE["contact_radius"] + 1), changed))
        wide = dilated(rows.join(near.select("image_id", F.col("left").alias("item")).distinct(), ids), ids, ellipse(F.lit(SIMILAR_MERGE["contact_radius"])))
        contact = (_rows_of(wide, near, "left").select(*PAIR, "y", F.col("runs").alias("l_runs")).join(_rows_of(rows, near, "right").select(*PAIR, "y", "runs"), [*PAIR, "y"])
                   .where(F.size(common(F.col("l_runs"), F.col("runs"))) > 0).select(*PAIR).distinct().withColumn("contact", F.lit(True)))
        shared = _overlap("x") * _overlap("y")
        boxes = near.select(*PAIR, (shared / F.greatest(_box("left") + _box("right") - shared, F.lit(1)) > SIMILAR_MERGE["iou"]).alias("boxes"))
        facts = boxes.join(_touched(close, changed), PAIR, "full").join(contact, PAIR, "left")
        for side in ("left", "right"):
            facts = facts.join(means.select("image_id", F.col("item").alias(side), F.col("texture").alias(f"{side}_texture"), F.col("colour").alias(f"{side}_colour")), ["image_id", side])
        texture, colour = (F.abs(F.col(f"left_{c}") - F.col(f"right_{c}")) for c in ("texture", "colour"))
        alike = F.coalesce("close", F.lit(False)) & (texture < SIMILAR_MERGE["delta"]) & (colour < SIMILAR_MERGE["delta"])
        return facts.where(F.coalesce("boxes", F.lit(False)) | alike | (F.coalesce("contact", F.lit(False)) & (texture < SIMILAR_MERGE["contact_delta"]))).select(*PAIR)
    return _with_rest(rows, features, ["texture", "colour"], _may_similar, _gaps_closed, scored, closed_union)
