"""Boxes and run-length masks as interval tables; overlaps as cell-bucketed equi-joins.

A mask is a set of half-open runs ``(image_id, <mask id>, y, x0, x1)``. Overlap joins bucket both
sides into grid cells, so only shapes that share a cell ever meet - not all pairs of an image.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import area, mask_dice, mask_iou, share
from . import run_length as rl

CELL = 16


def _cells(lo: Column, hi: Column, size: int) -> Column:
    """Cell numbers a half-open, non-empty interval touches."""
    return F.sequence(F.floor(lo / size), F.floor((hi - 1) / size))


def tiled(boxes: DataFrame, size: int = CELL) -> DataFrame:
    b = boxes.where((F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1")))
    return (b.withColumn("tx", F.explode(_cells(F.col("x1"), F.col("x2"), size)))
            .withColumn("ty", F.explode(_cells(F.col("y1"), F.col("y2"), size))))


def box_overlaps(left: DataFrame, right: DataFrame, on: Sequence[str], size: int = CELL,
                 l_prefix: str = "l_", r_prefix: str = "r_", tiles: bool = True) -> DataFrame:
    """Pairs of boxes that intersect, with the intersection area, each pair once.

    Both sides are cut into tiles; a pair is kept only in the tile that owns the top-left corner
    of its intersection, so no de-duplication is needed. Without ``tiles``, for groups known to be
    small, boxes meet on ``on`` alone, which keeps the partitioning they have.
    """
    if not tiles:
        solid = (F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1"))
        side = lambda d, p: d.where(solid).select(*on, *[F.col(c).alias(p + c) for c in d.columns if c not in on])
        over = lambda a, b: F.least(F.col(f"{l_prefix}{b}"), F.col(f"{r_prefix}{b}")) - F.greatest(F.col(f"{l_prefix}{a}"), F.col(f"{r_prefix}{a}"))
        return side(left, l_prefix).join(side(right, r_prefix), list(on)).where((over("x1", "x2") > 0) & (over("y1", "y2") > 0)).withColumn("intersection", over("x1", "x2") * over("y1", "y2"))
    lt = tiled(left, size).select(*on, "tx", "ty", *[F.col(c).alias(l_prefix + c) for c in left.columns if c not in on])
    rt = tiled(right, size).select(*on, "tx", "ty", *[F.col(c).alias(r_prefix + c) for c in right.columns if c not in on])
    j = lt.join(rt, [*on, "tx", "ty"])
    L, R = (lambda c: F.col(l_prefix + c)), (lambda c: F.col(r_prefix + c))
    left_x, top_y = F.greatest(L("x1"), R("x1")), F.greatest(L("y1"), R("y1"))
    w, h = F.least(L("x2"), R("x2")) - left_x, F.least(L("y2"), R("y2")) - top_y
    return (j.where((w > 0) & (h > 0) & (F.floor(left_x / size) == F.col("tx")) & (F.floor(top_y / size) == F.col("ty")))
            .withColumn("intersection", w * h).drop("tx", "ty"))


def run_overlaps(left: DataFrame, right: DataFrame, left_ids: Sequence[str], right_ids: Sequence[str], tiles: bool = True) -> DataFrame:
    """Intersection area of every overlapping pair of masks of the same image.

    A mask is one row (`box_masks`, `whole_masks`). Masks meet where their boxes do, as in `box_overlaps`, and runs are compared
    row by row inside the task that holds the pair, so no run is shuffled.
    """
    key = ["image_id", *left_ids, *right_ids]
    met = box_overlaps(left, right, ["image_id"], tiles=tiles).select(
        "image_id", *[F.col(f"l_{c}").alias(c) for c in left_ids], *[F.col(f"r_{c}").alias(c) for c in right_ids],
        F.col("l_runs").alias("__p"), F.col("r_runs").alias("__t"), F.col("r_y1").alias("__top"), F.col("r_y2").alias("__end"))
    one = met.select(*key, "__t", "__top", "__end", F.explode("__p").alias("__a")).where((F.col("__a.y") >= F.col("__top")) & (F.col("__a.y") < F.col("__end")))
    both = one.select(*key, "__a", F.explode("__t").alias("__b"))
    over = F.least("__a.x1", "__b.x1") - F.greatest("__a.x0", "__b.x0")
    return both.where((F.col("__a.y") == F.col("__b.y")) & (over > 0)).groupBy(*key).agg(F.sum(over).alias("intersection"))


def run_stats(runs: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Area, centroid (floored mean pixel) and half-open box of each mask."""
    n = F.col("x1") - F.col("x0")
    return runs.groupBy("image_id", *ids).agg(
        F.sum(n).alias("area"), F.floor(F.sum(F.col("y") * n) / F.sum(n)).alias("cy"),
        F.floor(F.sum((F.col("x0") + F.col("x1") - 1) * n / 2) / F.sum(n)).alias("cx"),
        F.min("x0").alias("x_min"), F.min("y").alias("y_min"), F.max("x1").alias("x_max"), (F.max("y") + 1).alias("y_max"))


def _measures(inter: Column, pa: Column, ta: Column) -> list[Column]:
    return [mask_iou(inter, pa, ta).alias("mask_iou"), mask_dice(inter, pa, ta).alias("mask_dice"),
            share(inter, ta).alias("truth_overlap"), share(inter, pa).alias("proposal_overlap")]


RUNS = "array<struct<y:bigint,x0:bigint,x1:bigint>>"


def box_masks(boxes: DataFrame, keep: Sequence[str]) -> DataFrame:
    """One row a mask: ``keep``, its box and its runs, an array. Nothing is shuffled."""
    row = lambda y: F.struct(y.alias("y"), F.col("x1").alias("x0"), F.col("x2").alias("x1"))
    solid = (F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1"))
    return boxes.where(solid).select(*keep, "x1", "y1", "x2", "y2", F.transform(F.sequence(F.col("y1"), F.col("y2") - 1), row).cast(RUNS).alias("runs"))


def whole_masks(runs: DataFrame, ids: Sequence[str]) -> DataFrame:
    """`box_masks` of masks given as rows of runs."""
    return runs.groupBy("image_id", *ids).agg(
        F.min("x0").alias("x1"), F.min("y").alias("y1"), F.max("x1").alias("x2"), (F.max("y") + 1).alias("y2"),
        F.collect_list(F.struct("y", "x0", "x1")).cast(RUNS).alias("runs"))


def pair_matrix(proposals: DataFrame, truths: DataFrame, tiles: bool = True) -> DataFrame:
    """Pair evidence of every proposal and truth that touch (overlap, or centroid inside).

    A mask is one row (`box_masks`, `whole_masks`). Masks meet where their boxes do, as in `box_overlaps`, and only the runs of
    such pairs are compared, inside the task that holds the pair. Pairs that do not touch all measure zero and are left implicit.
    """
    key = ["image_id", "method", "proposal_id", "truth_id"]
    met = box_overlaps(proposals, truths, ["image_id"], tiles=tiles)
    met = met.select("image_id", F.col("l_method").alias("method"), F.col("l_proposal_id").alias("proposal_id"), F.col("r_truth_id").alias("truth_id"), F.col("l_runs").alias("p"), F.col("r_runs").alias("t"))
    n = lambda r: r["x1"] - r["x0"]
    zero = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("y"), F.lit(0.0).alias("x"))
    mass = lambda c: F.aggregate(c, zero, lambda s, r: F.struct((s["n"] + n(r)).alias("n"), (s["y"] + r["y"] * n(r)).alias("y"), (s["x"] + (r["x0"] + r["x1"] - 1) * n(r) / 2).alias("x")))
    met = met.withColumn("m", mass("p")).withColumn("ta", mass("t")["n"])
    met = met.select(*key, "p", "t", F.col("m.n").alias("pa"), "ta", F.floor(F.col("m.y") / F.col("m.n")).alias("cy"), F.floor(F.col("m.x") / F.col("m.n")).alias("cx"))
    facts = [*key, "pa", "ta", "cy", "cx"]
    each = met.select(*facts, "t", F.explode("p").alias("a")).select(*facts, "a", F.explode("t").alias("b"))
    same, at = F.col("a.y") == F.col("b.y"), F.col("b.y") == F.col("cy")
    over = F.greatest(F.least("a.x1", "b.x1") - F.greatest("a.x0", "b.x0"), F.lit(0).cast("bigint"))
    inside = at & (F.col("cx") >= F.col("b.x0")) & (F.col("cx") < F.col("b.x1"))
    g = each.where(same | at).groupBy(*key).agg(F.sum(F.when(same, over).otherwise(0)).alias("intersection"), F.max(inside).alias("inside"), F.max("pa").alias("pa"), F.max("ta").alias("ta"))
    return g.where((F.col("intersection") > 0) | F.col("inside")).select(*key, *_measures(F.col("intersection"), F.col("pa"), F.col("ta")), F.col("inside").alias("centroid_inside"))


def box_pairs(proposals: DataFrame, truths: DataFrame, tiles: bool = True, keep: Sequence[str] = ()) -> DataFrame:
    """`pair_matrix` for rectangular masks, straight from the boxes (centroid is always inside the box).

    ``keep`` names further columns of the proposals to hand on."""
    p = proposals.select("image_id", "method", "proposal_id", "x1", "y1", "x2", "y2", *keep)
    t = truths.select("image_id", "truth_id", "x1", "y1", "x2", "y2")
    j = box_overlaps(p, t, ["image_id"], tiles=tiles)
    a = lambda s: area(*[F.col(f"{s}_{c}") for c in ("x1", "y1", "x2", "y2")])
    cx, cy = F.floor((F.col("l_x1") + F.col("l_x2") - 1) / 2), F.floor((F.col("l_y1") + F.col("l_y2") - 1) / 2)
    inside = (cx >= F.col("r_x1")) & (cx < F.col("r_x2")) & (cy >= F.col("r_y1")) & (cy < F.col("r_y2"))
    return j.select("image_id", F.col("l_method").alias("method"), F.col("l_proposal_id").alias("proposal_id"),
                    F.col("r_truth_id").alias("truth_id"), *_measures(F.col("intersection"), a("l"), a("r")), inside.alias("centroid_inside"), *[F.col(f"l_{c}").alias(c) for c in keep])


# ---- run-length code ----------------------------------------------------------------------
def _fields(df: DataFrame, names: Sequence[str], more: str) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in names) + f", {more}"


def box_codes(boxes: DataFrame, ids: Sequence[str], width: int, height: int) -> DataFrame:
    """Each box's mask coded, decoded and coded again: (ids, code, runs), the lengths joined by commas and their number.

    A mask stays in its task from its box to its code; boxes that hold no pixel have no row."""
    ids = list(ids)
    solid = (F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1"))

    def made(part: pa.RecordBatch) -> dict[str, pa.Array]:
        x1, y1, x2, y2 = (rl.numbers(part.column(c)) for c in ("x1", "y1", "x2", "y2"))
        rows = y2 - y1
        size, lengths = rl.encode(rows, np.repeat(y1, rows) + rl.within(rows), np.repeat(x1, rows), np.repeat(x2, rows), width, height)
        size, lengths = rl.encode(*rl.decode(size, lengths, width), width, height)
        return {"code": pc.binary_join(rl.list_of(size, pa.array(lengths).cast(pa.string())), ","), "runs": pa.array(size)}
    rows = boxes.where(solid).select(*ids, "x1", "y1", "x2", "y2")
    return rows.mapInArrow(rl.batches(ids, lambda b: rl.numbers(b.column(b.schema.get_field_index("y2"))) - rl.numbers(b.column(b.schema.get_field_index("y1"))), made), _fields(rows, ids, "code string, runs bigint"))


def rle_encode(runs: DataFrame, ids: Sequence[str], width: int, height: int) -> DataFrame:
    """Zero-first run lengths in row order, one row per run: (ids, position, bit, length)."""
    ids = list(ids)

    def made(part: pa.RecordBatch) -> dict[str, pa.Array]:
        size, y = rl.lists(part.column("y"))
        size, lengths = rl.encode(size, rl.numbers(y), *(rl.numbers(rl.lists(part.column(c))[1]) for c in ("x0", "x1")), width, height)
        return {"code": rl.list_of(size, pa.array(lengths))}
    whole = runs.groupBy(*ids).agg(F.collect_list(F.struct("y", "x0", "x1")).alias("r")).select(*ids, "r.y", "r.x0", "r.x1")
    coded = whole.mapInArrow(rl.batches(ids, lambda b: rl.lists(b.column("y"))[0], made), _fields(whole, ids, "code array<bigint>"))
    each = coded.select(*ids, F.posexplode("code").alias("position", "length"))
    return each.select(*ids, F.col("position").cast("bigint").alias("position"), (F.col("position") % 2).alias("bit"), "length")


def rle_decode(code: DataFrame, ids: Sequence[str], width: int) -> DataFrame:
    """Back to runs per row."""
    ids = list(ids)

    def made(part: pa.RecordBatch) -> dict[str, pa.Array]:
        size, lengths = rl.lists(part.column("code"))
        size, *runs = rl.decode(size, rl.numbers(lengths), width)
        return {c: rl.list_of(size, pa.array(v)) for c, v in zip(("y", "x0", "x1"), runs)}
    whole = code.groupBy(*ids).agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "length"))), lambda c: c["length"]).alias("code"))
    back = whole.mapInArrow(rl.batches(ids, lambda b: rl.lists(b.column("code"))[0], made), _fields(whole, ids, "y array<bigint>, x0 array<bigint>, x1 array<bigint>"))
    return back.select(*ids, F.explode(F.arrays_zip("y", "x0", "x1")).alias("r")).select(*ids, "r.*")
