"""Per-pixel and region operators on raster tables ``(image_id, y, x, bands...)``.

Stencils are windows along a row and then along a column, so the unit of work is one row or one
column of an image, never an image. Masks are sets of pixels or runs. Box filters clip at the
frame; 3 x 3 and 5 x 5 kernels mirror at the frame.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scale import exact_quantiles
from . import small_frames as sf
from .graph import connected_components

PIXEL = ["image_id", "y", "x"]
# Weights of the seven evidence maps.
EVIDENCE = {"sobel": 0.18, "laplacian": 0.12, "edges": 0.16, "texture": 0.20, "lbp": 0.12, "colour": 0.16, "threshold": 0.06}
MAPS = ("blur", "sobel", "laplacian", "texture", "lbp", "colour", "edges", "threshold", "strength")
SHARPEN = ((0, -1, 0), (-1, 5.2, -1), (0, -1, 0))
SOBEL_X = ((-1, 0, 1), (-2, 0, 2), (-1, 0, 1))
SOBEL_Y = ((-1, -2, -1), (0, 0, 0), (1, 2, 1))
LAPLACE = ((0, 1, 0), (1, -4, 1), (0, 1, 0))


def _row() -> Window:
    return Window.partitionBy("image_id", "y").orderBy("x")


def _col() -> Window:
    return Window.partitionBy("image_id", "x").orderBy("y")


# ---- colour and point operators -------------------------------------------------------------
def gray(b: Column, g: Column, r: Column) -> Column:
    return F.round(0.114 * b + 0.587 * g + 0.299 * r).cast("bigint")


def hsv(b: Column, g: Column, r: Column) -> dict[str, Column]:
    """Hue in half degrees, saturation and value in 0..255."""
    top, low = F.greatest(b, g, r), F.least(b, g, r)
    d = (top - low).cast("double")
    h = (F.when(d == 0, 0.0).when(top == r, 60 * (g - b) / d).when(top == g, 120 + 60 * (b - r) / d).otherwise(240 + 60 * (r - g) / d))
    return {"h": F.when(h < 0, h + 360).otherwise(h) / 2, "s": F.when(top == 0, 0.0).otherwise(255 * d / top), "v": top}


def lab(b: Column, g: Column, r: Column) -> dict[str, Column]:
    """CIE L*a*b* (D65), scaled to the 0..255 storage convention."""
    def linear(c: Column) -> Column:
        s = c / 255.0
        return F.when(s > 0.04045, F.pow((s + 0.055) / 1.055, F.lit(2.4))).otherwise(s / 12.92)
    R, G, B = linear(r), linear(g), linear(b)
    X, Y, Z = (0.412453 * R + 0.357580 * G + 0.180423 * B) / 0.950456, 0.212671 * R + 0.715160 * G + 0.072169 * B, (0.019334 * R + 0.119193 * G + 0.950227 * B) / 1.088754
    f = lambda t: F.when(t > 0.008856, F.pow(t, F.lit(1 / 3))).otherwise(7.787 * t + 16 / 116)
    L = F.when(Y > 0.008856, 116 * F.pow(Y, F.lit(1 / 3)) - 16).otherwise(903.3 * Y)
    return {"l": L * 255 / 100, "a": 500 * (f(X) - f(Y)) + 128, "bb": 200 * (f(Y) - f(Z)) + 128}


def brightness_contrast(v: Column, brightness: int = 0, contrast: int = 0) -> Column:
    return F.least(F.bround(F.abs((1.0 + contrast / 100.0) * v + brightness)), F.lit(255.0)).cast("bigint")


def alpha_blend(v: Column, alpha: Column, handling: str) -> Column:
    """Drop alpha, or blend over black or white with rounded integers."""
    if handling == "drop":
        return v
    over = F.lit(0) if handling == "black" else F.lit(255)
    return F.floor((v * alpha + over * (255 - alpha) + 127) / 255)


def minmax(df: DataFrame, columns: Sequence[str], top: float = 255.0) -> DataFrame:
    """Stretch each band of each image to 0..top; the range comes from a combined aggregate, not a window."""
    r = df.groupBy("image_id").agg(*[a for c in columns for a in (F.min(c).alias(f"__lo_{c}"), F.max(c).alias(f"__hi_{c}"))])
    j = df.join(r, "image_id")
    scaled = {c: F.when(F.col(f"__hi_{c}") > F.col(f"__lo_{c}"), (F.col(c) - F.col(f"__lo_{c}")) * top / (F.col(f"__hi_{c}") - F.col(f"__lo_{c}"))).otherwise(F.lit(0.0)) for c in columns}
    return j.select(*[scaled[c].alias(c) if c in scaled else F.col(c) for c in df.columns])


# ---- stencils -----------------------------------------------------------------------------
def neighbours(df: DataFrame, v: str, border: str = "mirror") -> DataFrame:
    """Nine values per pixel as ``n[0..8]`` in row order; two windows in all."""
    side = lambda w, back: F.coalesce(F.lag(F.col(back)).over(w), F.lead(F.col(back)).over(w) if border == "mirror" else F.col(back), F.col(back))
    other = lambda w, back: F.coalesce(F.lead(F.col(back)).over(w), F.lag(F.col(back)).over(w) if border == "mirror" else F.col(back), F.col(back))
    h = df.withColumn("__h", F.array(side(_row(), v), F.col(v), other(_row(), v)))
    return h.withColumn("n", F.concat(side(_col(), "__h"), F.col("__h"), other(_col(), "__h"))).drop("__h")


def kernel(k: Sequence[Sequence[float]]) -> Column:
    """Weighted sum of ``n`` under a 3 x 3 kernel; zero weights cost nothing."""
    out = F.lit(0.0)
    for i, w in enumerate(x for row in k for x in row):
        if w:
            out = out + F.element_at("n", i + 1) * float(w)
    return out


def gaussian5(df: DataFrame, v: str, name: str) -> DataFrame:
    """Separable 1-4-6-4-1 blur."""
    def pass_(d: DataFrame, w, c: str, out: str) -> DataFrame:
        a1, b1 = F.lag(c).over(w), F.lead(c).over(w)
        a2, b2 = F.lag(c, 2).over(w), F.lead(c, 2).over(w)
        m = F.col(c)
        l1, r1 = F.coalesce(a1, b1, m), F.coalesce(b1, a1, m)
        l2 = F.coalesce(a2, F.when(a1.isNull(), b2).otherwise(m), m)
        r2 = F.coalesce(b2, F.when(b1.isNull(), a2).otherwise(m), m)
        return d.withColumn(out, (l2 + 4 * l1 + 6 * m + 4 * r1 + r2) / 16.0)
    return pass_(pass_(df, _row(), v, "__g"), _col(), "__g", name).drop("__g")


def box_sums(df: DataFrame, sums: Mapping[str, Column], r: int) -> DataFrame:
    """Sums over a (2r+1)-square around each pixel, clipped at the frame, plus the pixel count ``n``."""
    d = df.select("*", *[e.cast("double").alias(f"__a_{k}") for k, e in sums.items()])
    h, w = _row().rangeBetween(-r, r), _col().rangeBetween(-r, r)
    d = d.select("*", F.count(F.lit(1)).over(h).alias("__cn"), *[F.sum(f"__a_{k}").over(h).alias(f"__b_{k}") for k in sums])
    return d.select(*df.columns, F.sum("__cn").over(w).alias("n"), *[F.sum(f"__b_{k}").over(w).alias(k) for k in sums])


def box_stats(df: DataFrame, v: str, r: int) -> DataFrame:
    """Local mean and population deviation."""
    s = box_sums(df, {"__s": F.col(v), "__q": F.col(v) * F.col(v)}, r)
    mean = F.col("__s") / F.col("n")
    return s.withColumn("local_mean", mean).withColumn("local_std", F.sqrt(F.greatest(F.col("__q") / F.col("n") - mean * mean, F.lit(0.0)))).drop("__s", "__q", "n")


def lbp(df: DataFrame, v: str) -> DataFrame:
    """Eight-neighbour binary pattern, clockwise from the top left; the frame repeats its edge."""
    n = neighbours(df, v, "repeat")
    bits = F.lit(0)
    for bit, i in enumerate((0, 1, 2, 5, 8, 7, 6, 3)):
        bits = bits + (F.element_at("n", i + 1) >= F.col(v)).cast("int") * (1 << bit)
    return n.withColumn("lbp", bits).drop("n")


def gradient(df: DataFrame, v: str) -> DataFrame:
    n = neighbours(df, v)
    return n.select(*df.columns, kernel(SOBEL_X).alias("gx"), kernel(SOBEL_Y).alias("gy")).withColumn("magnitude", F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")))


def adaptive_threshold(df: DataFrame, v: str, r: int, offset: float = -2.0) -> DataFrame:
    """Foreground where the value exceeds its local mean minus the offset."""
    return box_stats(df, v, r).withColumn("foreground", F.col(v) > F.col("local_mean") - offset).drop("local_mean", "local_std")


# ---- geometry -----------------------------------------------------------------------------
def resize_area(df: DataFrame, bands: Sequence[str], size: tuple[int, int], target: tuple[int, int]) -> DataFrame:
    """Area-weighted resampling from (height, width) to a smaller target."""
    (h, w), (th, tw) = size, target

    def spans(c: str, n: int, m: int, out: str) -> Column:
        lo, hi = F.col(c) * F.lit(m / n), (F.col(c) + 1) * F.lit(m / n)
        cells = F.sequence(F.floor(lo + 1e-9), F.least(F.floor(hi - 1e-9), F.lit(m - 1)))
        return F.explode(F.transform(cells, lambda k: F.struct(k.alias("k"), (F.least(hi, k + 1.0) - F.greatest(lo, k.cast("double"))).alias("w")))).alias(out)
    d = df.select("image_id", "x", *bands, spans("y", h, th, "ty")).select("image_id", *bands, "ty", spans("x", w, tw, "tx"))
    wt = F.col("ty.w") * F.col("tx.w")
    return (d.select("image_id", F.col("ty.k").alias("y"), F.col("tx.k").alias("x"), wt.alias("wt"), *bands).groupBy(*PIXEL)
            .agg(*[(F.sum(F.col(b) * F.col("wt")) / F.sum("wt")).alias(b) for b in bands]))


def letterbox(df: DataFrame, size: tuple[int, int], side: int) -> DataFrame:
    """Shift a resized map into the middle of a square; the padding stays implicit."""
    dy, dx = (side - size[0]) // 2, (side - size[1]) // 2
    return df.withColumn("y", F.col("y") + dy).withColumn("x", F.col("x") + dx)


def restore_map(df: DataFrame, small: tuple[int, int], size: tuple[int, int], offset: tuple[int, int] = (0, 0)) -> DataFrame:
    """Nearest-cell projection of a small map back onto the full frame."""
    rep = lambda c, n, m, o: F.explode(F.sequence(F.ceil((F.col(c) - o) * F.lit(m / n) - 1e-9), F.ceil((F.col(c) - o + 1) * F.lit(m / n) - 1e-9) - 1))
    inside = df.where(F.col("y").between(offset[0], offset[0] + small[0] - 1) & F.col("x").between(offset[1], offset[1] + small[1] - 1))
    d = inside.withColumn("__y", rep("y", small[0], size[0], offset[0])).withColumn("__x", rep("x", small[1], size[1], offset[1]))
    return d.drop("y", "x").withColumnRenamed("__y", "y").withColumnRenamed("__x", "x")


def crop(df: DataFrame, boxes: DataFrame, share: float = 0.18, least: int = 12) -> DataFrame:
    """Pixels of the padded box, re-based to its corner; boxes carry image_id, box_id, x1..y2.

    A box is turned into its rows, so pixels meet boxes in an equi-join on (image, row).
    """
    pad = F.greatest(F.lit(least), F.floor(F.greatest(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")) * share))
    b = boxes.select("image_id", "box_id", F.greatest(F.col("x1") - pad, F.lit(0)).alias("bx1"), (F.col("x2") + pad).alias("bx2"), F.greatest(F.col("y1") - pad, F.lit(0)).alias("by1"), (F.col("y2") + pad).alias("by2"))
    rows = b.withColumn("y", F.explode(F.sequence("by1", F.col("by2") - 1)))
    j = df.join(rows, ["image_id", "y"]).where((F.col("x") >= F.col("bx1")) & (F.col("x") < F.col("bx2")))
    return j.withColumn("crop_y", F.col("y") - F.col("by1")).withColumn("crop_x", F.col("x") - F.col("bx1")).drop("bx1", "bx2", "by1", "by2")


# ---- masks --------------------------------------------------------------------------------
def ellipse(radius: int) -> list[tuple[int, int]]:
    """Offsets of the usual elliptical structuring element of size 2r+1."""
    return [(dy, dx) for dy in range(-radius, radius + 1) for dx in range(-radius, radius + 1)
            if abs(dx) <= int(round(radius * ((radius * radius - dy * dy) / (radius * radius)) ** 0.5))]


def square(radius: int) -> list[tuple[int, int]]:
    return [(dy, dx) for dy in range(-radius, radius + 1) for dx in range(-radius, radius + 1)]


def dilate(mask: DataFrame, offsets: Sequence[tuple[int, int]], height: int, width: int, ids: Sequence[str] = ("image_id",)) -> DataFrame:
    """Every pixel a mask pixel reaches; offsets of one row become one interval before the explode."""
    rows: dict[int, list[int]] = {}
    for dy, dx in offsets:
        rows.setdefault(dy, []).append(dx)
    spans = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(min(v)).alias("a"), F.lit(max(v)).alias("b")) for dy, v in sorted(rows.items())])
    d = mask.select(*ids, "y", "x", F.explode(spans).alias("s")).select(*ids, (F.col("y") + F.col("s.dy")).alias("y"), "x", "s.a", "s.b")
    d = d.where((F.col("y") >= 0) & (F.col("y") < height))
    xs = F.sequence(F.greatest(F.col("x") + F.col("a"), F.lit(0)), F.least(F.col("x") + F.col("b"), F.lit(width - 1)))
    return d.select(*ids, "y", F.explode(xs).alias("x")).distinct()


def frame(mask: DataFrame, height: int, width: int, ids: Sequence[str] = ("image_id",)) -> DataFrame:
    """All pixels of the frames the mask's images use."""
    return (mask.select(*ids).distinct().withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(height - 1)).cast("array<bigint>")))
            .withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(width - 1)).cast("array<bigint>"))))


def erode(mask: DataFrame, offsets: Sequence[tuple[int, int]], height: int, width: int, ids: Sequence[str] = ("image_id",)) -> DataFrame:
    key = [*ids, "y", "x"]
    outside = frame(mask, height, width, ids).join(mask, key, "left_anti")
    return mask.select(*key).join(dilate(outside, [(-a, -b) for a, b in offsets], height, width, ids), key, "left_anti")


def opened(mask: DataFrame, offsets, height: int, width: int, ids=("image_id",)) -> DataFrame:
    return dilate(erode(mask, offsets, height, width, ids), offsets, height, width, ids)


def closed(mask: DataFrame, offsets, height: int, width: int, ids=("image_id",)) -> DataFrame:
    return erode(dilate(mask, offsets, height, width, ids), offsets, height, width, ids)


def multiscale_union(seed: DataFrame, radii: Sequence[int], height: int, width: int) -> DataFrame:
    """Union of closings of the opened seed at several kernel sizes."""
    base = opened(seed, square(1), height, width)
    out = None
    for r in radii:
        c = closed(base, ellipse(r), height, width)
        out = c if out is None else out.unionByName(c)
    return out.distinct()


def mask_gradient(mask: DataFrame, offsets, height: int, width: int) -> DataFrame:
    return dilate(mask, offsets, height, width).join(erode(mask, offsets, height, width), PIXEL, "left_anti")


def context_ring(mask: DataFrame, outer: int, height: int, width: int, ids=("image_id",), inner: int = 1) -> DataFrame:
    """Elliptical dilation minus a slight square one."""
    near = dilate(mask, square(inner), height, width, ids) if inner else mask.select(*ids, "y", "x")
    return dilate(mask, ellipse(outer), height, width, ids).join(near, [*ids, "y", "x"], "left_anti")


# ---- components -----------------------------------------------------------------------------
def mask_runs(mask: DataFrame) -> DataFrame:
    """Maximal horizontal runs (image_id, y, x0, x1) of a pixel mask."""
    new = F.when(F.col("x") - F.lag("x").over(_row()) == 1, 0).otherwise(1)
    isl = mask.select(*PIXEL, new.alias("s")).withColumn("g", F.sum("s").over(_row().rowsBetween(Window.unboundedPreceding, 0)))
    return isl.groupBy("image_id", "y", "g").agg(F.min("x").alias("x0"), (F.max("x") + 1).alias("x1")).drop("g")


def label_components(mask: DataFrame, height: int, width: int, diagonal: bool = True) -> DataFrame:
    """Pixels with the label of their component: the smallest flat index inside it.

    Pixels collapse to runs; runs of neighbouring rows meet in a cell-bucketed equi-join and the
    labels spread over the run graph.
    """
    runs = mask_runs(mask).withColumn("node", F.col("image_id") * (height * width) + F.col("y") * width + F.col("x0"))
    reach, cell = (1 if diagonal else 0), 32
    span = lambda d, p, grow: d.select("image_id", "y", F.col("node").alias(f"{p}n"), F.col("x0").alias(f"{p}0"), F.col("x1").alias(f"{p}1"),
                                       F.explode(F.sequence(F.floor((F.col("x0") - grow) / cell), F.floor((F.col("x1") - 1 + grow) / cell))).alias("cx"))
    a, b = span(runs, "a", reach), span(runs, "b", 0).withColumn("y", F.col("y") - 1)
    edges = a.join(b, ["image_id", "y", "cx"]).where((F.col("b0") < F.col("a1") + reach) & (F.col("b1") > F.col("a0") - reach)).select(F.col("an").alias("src"), F.col("bn").alias("dst"))
    lab = connected_components(runs.select("node"), edges)
    return (runs.join(lab, "node").select("image_id", "y", F.explode(F.sequence("x0", F.col("x1") - 1)).alias("x"), (F.col("component") - F.col("image_id") * (height * width)).alias("label")))


def region_stats(labelled: DataFrame, height: int, width: int, value: str | None = None) -> DataFrame:
    """Area, half-open box, centroid, aspect and boundary-pixel perimeter of every region."""
    key = ["image_id", "label"]
    g = labelled.groupBy(*key).agg(
        F.count("*").alias("area"), F.min("x").alias("x1"), F.min("y").alias("y1"), (F.max("x") + 1).alias("x2"), (F.max("y") + 1).alias("y2"),
        F.avg("x").alias("cx"), F.avg("y").alias("cy"), *([F.max(value).alias("score"), F.avg(value).alias("mean_value")] if value else []))
    four = F.array(*[F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx")) for a, b in ((0, 1), (0, -1), (1, 0), (-1, 0))])
    hits = (labelled.select(*key, "y", "x", F.explode(four).alias("o")).select(*key, (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x")))
    inner = (labelled.select(*key, "y", "x").join(hits.groupBy(*key, "y", "x").agg(F.count("*").alias("k")), [*key, "y", "x"], "left").groupBy(*key).agg(F.count(F.when(F.coalesce("k", F.lit(0)) < 4, 1)).alias("perimeter")))
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    return (g.join(inner, key).withColumn("relative_area", F.col("area") / F.lit(height * width)).withColumn("aspect", F.greatest(w / h, h / w)))


def fill_holes(mask: DataFrame, height: int, width: int, largest: int | None = None) -> DataFrame:
    """Fill background components that do not touch the frame (only small ones if a size is given)."""
    back = frame(mask, height, width).join(mask, PIXEL, "left_anti")
    lab = label_components(back, height, width, diagonal=largest is not None)
    edge = (F.col("y") == 0) | (F.col("x") == 0) | (F.col("y") == height - 1) | (F.col("x") == width - 1)
    s = lab.groupBy("image_id", "label").agg(F.count("*").alias("area"), F.max(edge.cast("int")).alias("edge")).where("edge = 0")
    if largest is not None:
        s = s.where(F.col("area") <= largest)
    return mask.select(*PIXEL).unionByName(lab.join(s, ["image_id", "label"], "left_semi").select(*PIXEL))


def keep_dominant(labelled: DataFrame, minimum: int = 1) -> DataFrame:
    """Largest component of each image (smallest label on ties) if it reaches the minimum area."""
    s = labelled.groupBy("image_id", "label").agg(F.count("*").alias("area"))
    best = s.groupBy("image_id").agg(F.max_by(F.struct("label", "area"), F.struct(F.col("area"), -F.col("label"))).alias("b")).where(F.col("b.area") >= minimum)
    return labelled.join(best.select("image_id", F.col("b.label").alias("label")), ["image_id", "label"], "left_semi")


def drop_small(labelled: DataFrame, minimum: int) -> DataFrame:
    s = labelled.groupBy("image_id", "label").agg(F.count("*").alias("area")).where(F.col("area") >= minimum)
    return labelled.join(s, ["image_id", "label"], "left_semi")


def rank_components(stats: DataFrame, minimum: int, keep: int = 8) -> DataFrame:
    """Components by mean heat, then area, then box; all descending."""
    w = Window.partitionBy("image_id").orderBy(*[F.desc(c) for c in ("mean_value", "area", "x1", "y1", "x2", "y2")])
    return stats.where(F.col("area") >= minimum).withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= keep)


def extract_proposals(maps: DataFrame, threshold: Column, height: int, width: int, minimum: int = 16, keep: int = 8) -> tuple[DataFrame, DataFrame]:
    """(ranked regions, labelled pixels) of a distance map cut at a threshold."""
    lab = label_components(maps.where(F.col("v") >= threshold).select(*PIXEL), height, width).join(maps.select(*PIXEL, "v"), PIXEL)
    s = lab.groupBy("image_id", "label").agg(F.count("*").alias("area"), F.max("v").alias("score"), F.min("x").alias("x1"), F.min("y").alias("y1"), (F.max("x") + 1).alias("x2"), (F.max("y") + 1).alias("y2"))
    w = Window.partitionBy("image_id").orderBy(F.desc("score"), F.desc("area"), "x1", "y1", "x2", "y2")
    top = s.where(F.col("area") >= minimum).withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= keep)
    return top, lab.join(top.select("image_id", "label", "rank"), ["image_id", "label"])


def valid_area(df: DataFrame, v: str, height: int, width: int, margin: int, limit: int) -> DataFrame:
    """Pixels outside the margin and outside uniformly dark border rows and columns."""
    dark = lambda k: df.groupBy("image_id", k).agg(F.avg(v).alias("m"), F.stddev_pop(v).alias("s")).where("m < 18 and s < 8")
    rows = dark("y").where((F.col("y") < limit) | (F.col("y") >= height - limit)).select("image_id", "y")
    cols = dark("x").where((F.col("x") < limit) | (F.col("x") >= width - limit)).select("image_id", "x")
    inside = F.col("y").between(margin, height - 1 - margin) & F.col("x").between(margin, width - 1 - margin)
    return df.where(inside).join(rows, ["image_id", "y"], "left_anti").join(cols, ["image_id", "x"], "left_anti").select(*PIXEL)


def border_penalty(mask: DataFrame, valid: DataFrame, height: int, width: int, radius: int = 4) -> DataFrame:
    """Share of each mask that lies near an invalid pixel."""
    bad = frame(mask, height, width).join(valid, PIXEL, "left_anti")
    near = dilate(bad, square(radius), height, width).withColumn("near", F.lit(1))
    return mask.join(near, PIXEL, "left").groupBy("image_id").agg((F.count("near") / F.count("*")).alias("border_penalty"))


def correct_mask(mask: DataFrame, boxes: DataFrame, height: int, width: int, invert: bool = False, steps: int = 0, remove_small: int = 0) -> DataFrame:
    """Reviewer correction: bound to the box, invert, dilate or erode n steps, drop small parts."""
    b = boxes.select("image_id", "x1", "y1", "x2", "y2")
    inside = lambda d: d.join(b, "image_id").where((F.col("x") >= F.col("x1")) & (F.col("x") < F.col("x2")) & (F.col("y") >= F.col("y1")) & (F.col("y") < F.col("y2"))).select(*PIXEL)
    out = inside(mask)
    if invert:
        out = inside(frame(boxes, height, width)).join(mask, PIXEL, "left_anti")
    for _ in range(abs(steps)):
        out = dilate(out, ellipse(1), height, width) if steps > 0 else erode(out, ellipse(1), height, width)
    return drop_small(label_components(out, height, width), remove_small).select(*PIXEL) if remove_small else out


# ---- votes, tiles, entropy ------------------------------------------------------------------
def vote_fusion(df: DataFrame, maps: Mapping[str, float], strength: str, minimum_votes: int = 2) -> DataFrame:
    """Votes of maps above their own percentile, fused strength, and the seed it yields."""
    long = df.unpivot(["image_id"], [F.col(m).cast("double").alias(m) for m in maps], "name", "v")
    q = None
    for p in sorted(set(maps.values())):
        part = exact_quantiles(long.where(F.col("name").isin([m for m, x in maps.items() if x == p])), ["image_id", "name"], "v", {"t": p})
        q = part if q is None else q.unionByName(part)
    wide = q.groupBy("image_id").agg(*[F.max(F.when(F.col("name") == m, F.col("t"))).alias(f"__t_{m}") for m in maps])
    votes = F.lit(0)
    for m in maps:
        votes = votes + (F.col(m) >= F.greatest(F.col(f"__t_{m}"), F.lit(1.0))).cast("int")
    d = df.join(wide, "image_id").select(*PIXEL, (0.58 * F.col(strength) + 32.0 * votes).alias("fused"), votes.alias("votes"))
    d = minmax(d, ["fused"])
    cut = exact_quantiles(d.select("image_id", F.round("fused", 9).alias("f")), ["image_id"], "f", {"cut": 0.82})
    return d.join(cut, "image_id").withColumn("seed", (F.round("fused", 9) >= F.col("cut")) & (F.col("votes") >= minimum_votes)).drop("cut")


def entropy(df: DataFrame, keys: Sequence[str], v: str, bins: int = 32) -> DataFrame:
    """Histogram entropy over 32 levels of 0..255, divided by five bits."""
    b = df.groupBy(*keys, F.floor(F.col(v) * bins / 256).alias("bin")).agg(F.count("*").alias("n"))
    t = b.groupBy(*keys).agg(F.sum("n").alias("t"))
    p = F.col("n") / F.col("t")
    return b.join(t, list(keys)).groupBy(*keys).agg((F.sum(-p * F.log2(p)) / 5.0).alias("entropy"))


# ---- candidates -----------------------------------------------------------------------------
def reject_reason(minimum: int, image_area: int, largest: float = 0.85) -> Column:
    """First rule a candidate breaks, in order; null when it stays."""
    c = F.col
    return (F.when((c("area") < minimum) | (c("area") / image_area > largest), "area").when(F.least("w", "h") < 3, "invalid_geometry")
            .when((c("invalid_fraction") > 0.25) | ((c("near_fraction") > 0.72) & (c("context_strength") < 0.58)), "border_band")
            .when((c("box_share") > 0.22) & (c("coherence") < 0.52), "broad_low_coherence")
            .when((c("border_penalty") > 0.55), "border_evidence").when((c("area") < int(minimum * 1.5)) & (c("contextual_peak") < 0.45), "tiny_low_evidence"))


def funnel(candidates: DataFrame, stages: Sequence[str]) -> DataFrame:
    """Candidates still alive after each stage and the score range, per image.

    Scores are rounded as SQL rounds doubles: ten times the score to the nearest integer."""
    r1 = lambda c: F.round(c * 10) / 10
    base = candidates.groupBy("image_id").agg(F.count("*").alias("raw"), *[F.count(F.when(F.col(s), 1)).alias(s) for s in stages],
                                              r1(F.min("score")).alias("minimum_score"), r1(F.max("score")).alias("maximum_score"))
    med = exact_quantiles(candidates, ["image_id"], "score", {"median_score": 0.5}).withColumn("median_score", r1(F.col("median_score")))
    return base.join(med, "image_id")


def candidate_evidence(masks: DataFrame, maps: DataFrame, reference: float, height: int, width: int, radius: int = 2) -> DataFrame:
    """Inside mean and q95, high share, ring contrast and local agreement of every mask."""
    ids = ["image_id", "proposal_id"]
    ring = dilate(masks, ellipse(radius), height, width, ids).join(masks.select(*ids, "y", "x"), [*ids, "y", "x"], "left_anti")
    px = masks.select(*ids, "y", "x", F.lit(True).alias("inside")).unionByName(ring.withColumn("inside", F.lit(False))).join(maps.select(*PIXEL, "v"), PIXEL)
    inside, high = F.col("inside"), F.col("v") > reference
    n = lambda c: F.count(F.when(c, 1))
    g = px.groupBy(*ids).agg(F.avg(F.when(inside, F.col("v"))).alias("inside_mean"), F.avg(F.when(~inside, F.col("v"))).alias("ring_mean"), n(inside).alias("area"), n(inside & high).alias("hi"), n(high).alias("hl"))
    q = exact_quantiles(px.where(inside), ids, "v", {"inside_q95": 0.95})
    return g.join(q, ids).select(*ids, "inside_mean", "inside_q95", (F.col("hi") / F.col("area")).alias("high_fraction"), (F.col("inside_mean") - F.coalesce("ring_mean", "inside_mean")).alias("ring_contrast"),
                                 F.when(F.col("hl") > 0, F.col("hi") / F.col("hl")).otherwise(0.0).alias("local_agreement"))


def suppress_overlaps(boxes: DataFrame, by: str = "image_id") -> DataFrame:
    """Greedy suppression without collecting a group: a box that beats all undecided rivals is kept,
    its rivals fall, and the rest goes round again - the same result as one sequential sweep.

    ``boxes``: image_id, box_id, score, x1..y2. Rivals overlap by IoU > .28, box share > .68 or
    mask share > .18 (the mask of a box is the box).
    """
    from ..core import checkpointed
    from ..functions.exprs import area
    from .masks import box_overlaps
    b = boxes.select(by, "box_id", "score", "x1", "y1", "x2", "y2")
    j = box_overlaps(b, b, [by])
    a = lambda s: area(*[F.col(f"{s}_{c}") for c in ("x1", "y1", "x2", "y2")])
    i = F.col("intersection")
    clash = (i / F.greatest(a("l") + a("r") - i, F.lit(1)) > 0.28) | (i / F.greatest(F.least(a("l"), a("r")), F.lit(1)) > 0.18)
    better = (F.col("l_score") > F.col("r_score")) | ((F.col("l_score") == F.col("r_score")) & (F.col("l_box_id") < F.col("r_box_id")))
    edges = checkpointed(j.where(clash & better).select(by, F.col("l_box_id").alias("win"), F.col("r_box_id").alias("lose")))
    key = [by, "box_id"]
    state = checkpointed(b.select(*key).withColumn("kept", F.lit(None).cast("boolean")))
    while True:  # each round settles the best undecided box of every image at least
        open_ = state.where("kept is null").select(*key)
        live = edges.join(open_.withColumnRenamed("box_id", "win"), [by, "win"], "left_semi").join(open_.withColumnRenamed("box_id", "lose"), [by, "lose"], "left_semi")
        keep = open_.join(live.select(by, F.col("lose").alias("box_id")).distinct(), key, "left_anti")
        fall = live.join(keep.withColumnRenamed("box_id", "win"), [by, "win"], "left_semi").select(by, F.col("lose").alias("box_id")).distinct()
        news = keep.withColumn("n", F.lit(True)).unionByName(fall.withColumn("n", F.lit(False)))
        state = checkpointed(state.join(news, key, "left").select(*key, F.coalesce("kept", "n").alias("kept")))
        if state.where("kept is null").limit(1).isEmpty():
            return state


# ---- edges and region contrast ----------------------------------------------------------------
def edge_hysteresis(df: DataFrame, v: str, low: float, high: float, height: int, width: int) -> DataFrame:
    """Gradient ridges above ``low`` whose 8-connected chain holds one above ``high``."""
    g = gradient(df, v)
    n = neighbours(g.select(*PIXEL, "gx", "gy", "magnitude"), "magnitude", "repeat")
    at = lambda i: F.element_at("n", i + 1)
    ax, ay = F.abs("gx"), F.abs("gy")
    flat, steep = ay <= 0.41421356 * ax, ay >= 2.41421356 * ax
    same = F.col("gx") * F.col("gy") > 0
    a = F.when(flat, at(3)).when(steep, at(1)).when(same, at(0)).otherwise(at(2))
    b = F.when(flat, at(5)).when(steep, at(7)).when(same, at(8)).otherwise(at(6))
    ridge = n.where((F.col("magnitude") > low) & (F.col("magnitude") >= a) & (F.col("magnitude") >= b)).select(*PIXEL, (F.col("magnitude") > high).alias("strong"))
    lab = label_components(ridge.select(*PIXEL), height, width).join(ridge, PIXEL)
    strong = lab.where("strong").select("image_id", "label").distinct()
    return lab.join(strong, ["image_id", "label"], "left_semi").select(*PIXEL)


def region_contrast(df: DataFrame, regions: DataFrame, bands: Sequence[str], texture: str, height: int, width: int, radius: int = 2, ids: Sequence[str] = ("image_id", "label")) -> DataFrame:
    """Texture, colour and entropy of each region against the ring around it."""
    ids = list(ids)
    ring = context_ring(regions, radius, height, width, ids, inner=1)
    px = (regions.select(*ids, "y", "x").withColumn("inside", F.lit(True)).unionByName(ring.withColumn("inside", F.lit(False)))).join(df, PIXEL)
    side = lambda c, i: F.avg(F.when(F.col("inside") == i, F.col(c)))
    g = px.groupBy(*ids).agg(*[e for c in (*bands, texture) for e in (side(c, True).alias(f"__i_{c}"), F.coalesce(side(c, False), side(c, True)).alias(f"__o_{c}"))])
    e = entropy(px, [*ids, "inside"], texture)
    en = e.groupBy(*ids).agg(F.max(F.when(F.col("inside"), F.col("entropy"))).alias("ei"), F.coalesce(F.max(F.when(~F.col("inside"), F.col("entropy"))), F.lit(0.0)).alias("eo"))
    gap = lambda c: F.col(f"__i_{c}") - F.col(f"__o_{c}")
    colour = F.lit(0.0)
    for c in bands:
        colour = colour + gap(c) * gap(c)
    return g.join(en, ids).select(*ids, F.least(F.abs(gap(texture)) / 80, F.lit(1.0)).alias("local_texture_contrast"), F.least(F.sqrt(colour) / 60, F.lit(1.0)).alias("local_colour_contrast"),
                                  F.least(F.abs(F.col("ei") - F.col("eo")), F.lit(1.0)).alias("local_entropy_contrast"), F.least((F.abs(gap(texture)) + F.sqrt(colour)) / 100, F.lit(1.0)).alias("novelty"))


def feature_maps(df: DataFrame, height: int, width: int, radius: int = 7, level: int = 128, maps: Sequence[str] = MAPS) -> DataFrame:
    """All maps of the classical detector on one table: gradients, texture, pattern, colour, threshold, strength.

    ``df``: image_id, y, x, b, g, r and columns to keep. Maps are stretched to 0..255 per image before they are fused. Frames of up to
    SMALL_FRAME pixels are dealt out by image once and handled in that task, and stay together there; larger ones pixel by pixel.
    ``maps`` names the maps that are wanted, all by default.
    """
    base = df.withColumn("gray", gray(F.col("b"), F.col("g"), F.col("r")))
    if height * width <= SMALL_FRAME:
        return sf.by_image(sf.dealt(base), base.columns, list(maps), sf.detector_maps(EVIDENCE, (SOBEL_X, SOBEL_Y, LAPLACE), radius, level))
    blur = gaussian5(base, "gray", "blur")
    n = neighbours(blur, "blur")
    gx, gy = kernel(SOBEL_X), kernel(SOBEL_Y)
    d = n.select(*blur.columns, F.sqrt(gx * gx + gy * gy).alias("sobel"), F.abs(kernel(LAPLACE)).alias("laplacian"))
    d = box_stats(d, "gray", radius).drop("local_mean").withColumnRenamed("local_std", "texture")
    d = box_stats(lbp(d, "gray"), "lbp", radius).withColumn("lbp", F.abs(F.col("lbp") - F.col("local_mean"))).drop("local_mean", "local_std")
    s = box_sums(d, {"__b": F.col("b"), "__g": F.col("g"), "__r": F.col("r")}, radius)
    dev = lambda c: F.col(c) - F.col(f"__{c}") / F.col("n")
    d = s.withColumn("colour", F.sqrt(dev("b") * dev("b") + dev("g") * dev("g") + dev("r") * dev("r"))).drop("__b", "__g", "__r", "n")
    d = minmax(d, ["sobel", "laplacian", "texture", "lbp", "colour"])
    edges = edge_hysteresis(blur.select(*PIXEL, "blur"), "blur", 55, 165, height, width).withColumn("edges", F.lit(255.0))
    d = d.join(edges, PIXEL, "left").withColumn("edges", F.coalesce("edges", F.lit(0.0))).withColumn("threshold", F.when(F.col("blur") <= level, 255.0).otherwise(0.0))
    total = F.lit(0.0)
    for k, w in EVIDENCE.items():
        total = total + w * F.col(k)
    return minmax(d.withColumn("strength", total), ["strength"]).select(*base.columns, *maps)


# ---- equalisation, stability, coherence --------------------------------------------------------
#: frames of at most so many pixels are equalised where their image is dealt out
SMALL_FRAME = 65_536


def tile_equalise(df: DataFrame, v: str, height: int, width: int, tiles: tuple[int, int] = (8, 8), clip: float = 2.2) -> DataFrame:
    """Clip-limited equalisation of 0..255 levels per tile, blended bilinearly between tile centres.

    The clipped excess is spread evenly over the 256 levels (as a real number). A pixel becomes a row that counts in its
    own tile and a row for each of the up to four tiles whose curves it needs; running sums over a tile's rows give
    the curve just at those levels. Frames of up to SMALL_FRAME pixels are dealt out by image, so a pixel is shuffled
    once; larger ones by tile, so no task needs a whole frame.
    """
    th, tw = height // tiles[0], width // tiles[1]
    size = th * tw
    limit = max(clip * size / 256.0, 1.0)
    key = ["image_id", "ty", "tx"]

    def near(c: str, step: int, count: int) -> list[tuple[Column, Column]]:
        p = (F.col(c) + 0.5) / step - 0.5
        lo = F.floor(p)
        cl = lambda k: F.greatest(F.lit(0), F.least(k, F.lit(count - 1))).cast("bigint")
        return [(cl(lo), 1 - (p - lo)), (cl(lo + 1), p - lo)]
    row = lambda ty, tx, wt: F.struct(ty.cast("bigint").alias("ty"), tx.cast("bigint").alias("tx"), wt.cast("double").alias("wt"))
    own = row(F.floor(F.col("y") / th), F.floor(F.col("x") / tw), F.lit(None))  # no weight: it only counts
    needed = [row(ty, tx, wy * wx) for ty, wy in near("y", th, tiles[0]) for tx, wx in near("x", tw, tiles[1])]
    small = height * width <= SMALL_FRAME
    d = df.select(*PIXEL, F.col(v).alias("level"))
    d = (d.repartition("image_id") if small else d).select(*PIXEL, "level", F.explode(F.array(own, *needed)).alias("q")).select(*PIXEL, "level", "q.*")
    d = d if small else d.repartition(*key)
    at = Window.partitionBy(*key, "level")
    counts = F.col("wt").isNull()
    d = d.withColumn("n", F.count(F.when(counts, 1)).over(at)).withColumn("first", counts & (F.row_number().over(at.orderBy(F.col("wt").asc_nulls_first(), "y", "x")) == 1))
    kept = F.when(F.col("first") & F.col("level").between(0, 255), F.least(F.col("n"), F.lit(limit))).otherwise(0.0)
    over = F.when(F.col("first"), F.greatest(F.col("n") - limit, F.lit(0.0))).otherwise(0.0)
    tile = Window.partitionBy(*key)
    d = d.withColumn("below", F.sum(kept).over(tile.orderBy("level").rangeBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("excess", F.sum(over).over(tile))
    lut = (F.col("below") + (F.col("level") + 1) * F.col("excess") / 256.0) * 255.0 / size
    return d.where(~counts & F.col("level").between(0, 255)).groupBy(*PIXEL).agg(F.sum(F.col("wt") * lut).alias(v))


def saliency_support(df: DataFrame, v: str, radius: int = 7, small: bool = False) -> DataFrame:
    """Pixels whose gradient plus local deviation reaches the image's upper quartile.

    ``small``: frames hold at most SMALL_FRAME pixels, so images are dealt out whole and each stencil finds its pixels there."""
    df = df.repartition("image_id") if small else df
    d = gaussian5(df.select(*PIXEL, v), v, "__blur")
    n = neighbours(d, "__blur")
    gx, gy = kernel(SOBEL_X), kernel(SOBEL_Y)
    s = box_stats(n.select(*PIXEL, v, F.sqrt(gx * gx + gy * gy).alias("__m")), v, radius).select(*PIXEL, F.round(F.col("__m") + F.abs(F.col(v) - F.col("local_mean")), 9).alias("s"))
    cut = exact_quantiles(s, ["image_id"], "s", {"cut": 0.75}, False if small else None)
    return s.join(cut, "image_id").where(F.col("s") >= F.round("cut", 9)).select(*PIXEL)


def mask_stability(df: DataFrame, mask: DataFrame, v: str, height: int, width: int, radius: int = 7) -> DataFrame:
    """Mean overlap of the salient part of a mask under brightness, gain and rescale changes.

    All variants run as one table: the variant number joins the image key. Added noise is a hash of
    the pixel, so a rerun gives the same value.
    """
    noise = (F.pmod(F.col("y") * 7919 + F.col("x") * 104729 + F.col("image_id") * 31, F.lit(9)) - 4)
    cap = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(255.0), c.cast("double")))
    small = (max(1, round(height * 0.75)), max(1, round(width * 0.75)))
    scaled = restore_map(resize_area(df.select(*PIXEL, v), [v], (height, width), small), small, (height, width))
    k = F.col("image_id") * 8
    base = df.select(*PIXEL, v, F.explode(F.array(*[F.struct(F.lit(i).alias("i"), cap(c).alias("w")) for i, c in enumerate((F.col(v), F.col(v) + 12, F.col(v) * 1.08, F.col(v) + noise))])).alias("q"))
    allv = base.select((k + F.col("q.i")).alias("image_id"), "y", "x", F.col("q.w").alias(v)).unionByName(scaled.select((k + 4).alias("image_id"), "y", "x", v))
    sup = saliency_support(allv, v, radius, height * width <= SMALL_FRAME).select(F.floor(F.col("image_id") / 8).alias("image_id"), (F.col("image_id") % 8).alias("i"), "y", "x").join(mask, PIXEL, "left_semi")
    # pixels of the mask with the set of variants (at most five) that support them
    per = sup.groupBy(*PIXEL).agg(F.max((F.col("i") == 0).cast("int")).alias("b"), *[F.max((F.col("i") == j).cast("int")).alias(f"s{j}") for j in range(1, 5)])
    def part(j: int) -> Column:
        both, either = F.sum(F.col("b") * F.col(f"s{j}")), F.sum(F.greatest("b", f"s{j}"))
        return F.when(either > 0, both / either).otherwise(F.lit(1.0))
    g = per.groupBy("image_id").agg(((part(1) + part(2) + part(3) + part(4)) / 4).alias("stability"))
    # a mask no variant supports is perfectly stable: nothing changed
    return mask.select("image_id").distinct().join(g, "image_id", "left").select("image_id", F.coalesce("stability", F.lit(1.0)).alias("stability"))


def hull_area(points: list[tuple[float, float]]) -> float:
    """Area of the convex hull (monotone chain)."""
    pts = sorted(set(points))
    if len(pts) < 3:
        return 0.0

    def half(seq):
        out: list[tuple[float, float]] = []
        for p in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]
    ring = half(pts) + half(reversed(pts))
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1]))) / 2


def hull_areas(labelled: DataFrame, rows: int = 100_000) -> DataFrame:
    """Hull area per region from the ends of its rows: two points per row reach Python, not the pixels.

    Regions are dealt into as many groups as hold about ``rows`` rows each."""
    import pandas as pd
    ends = labelled.groupBy("image_id", "label", "y").agg(F.min("x").alias("a"), F.max("x").alias("b"))
    buckets = max(64, ends.count() // rows)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = [(i, l, hull_area([p for y, a, b in zip(g["y"], g["a"], g["b"]) for p in ((a, y), (b, y))])) for (i, l), g in pdf.groupby(["image_id", "label"])]
        return pd.DataFrame(out, columns=["image_id", "label", "hull_area"])
    return ends.withColumn("__b", F.pmod(F.xxhash64("image_id", "label"), F.lit(buckets))).groupBy("__b").applyInPandas(run, "image_id bigint, label bigint, hull_area double")


def coherence(labelled: DataFrame, height: int, width: int) -> DataFrame:
    """Connectedness, solidity, heat consistency and single-peakedness of regions, and their mean.

    ``labelled``: image_id, label, y, x, v (heat). A region may have several parts, as a union of
    masks has; connectedness is the share of its largest one.
    """
    key = ["image_id", "label"]
    pixels = height * width
    parts = label_components(labelled.select((F.col("image_id") * pixels + F.col("label")).alias("image_id"), "y", "x"), height, width)
    largest = (parts.groupBy("image_id", "label").agg(F.count("*").alias("part")).groupBy("image_id").agg(F.max("part").alias("part"))
               .select(F.floor(F.col("image_id") / pixels).alias("image_id"), (F.col("image_id") % pixels).alias("label"), "part"))
    g = labelled.groupBy(*key).agg(F.count("*").alias("area"), F.stddev_pop("v").alias("sd"))
    q = exact_quantiles(labelled, key, "v", {"p85": 0.85})
    top = labelled.join(q, key).where(F.col("v") >= F.col("p85"))
    peaks = label_components(top.select(*PIXEL), height, width).withColumnRenamed("label", "peak").join(labelled.select(*PIXEL, "label"), PIXEL).groupBy(*key).agg(F.count_distinct("peak").alias("peaks"))
    j = g.join(largest, key).join(hull_areas(labelled), key).join(peaks, key, "left")
    connected = F.col("part") / F.col("area")
    solidity = F.least(F.col("area") / F.greatest(F.col("hull_area"), F.lit(1.0)), F.lit(1.0))
    heat = 1 - F.least(F.col("sd") / 90, F.lit(1.0))
    single = 1.0 / F.least(F.greatest(F.coalesce("peaks", F.lit(1)), F.lit(1)), F.lit(5))
    return j.select(*key, "area", connected.alias("connectedness"), solidity.alias("solidity"), heat.alias("heat_consistency"), single.alias("peak_score"), ((connected + solidity + heat + single) / 4).alias("coherence"))


# ---- specular highlights ------------------------------------------------------------------------
# Thresholds, scales and weights of the optical score.
SPECULAR = {"bright": 0.88, "high": 0.82, "pale": 0.22, "chroma": 75.0, "spread": 64.0, "slope": 128.0}
OPTICAL_WEIGHTS = {"bright_low_saturation": 0.22, "high_value": 0.12, "low_saturation": 0.12, "channel_similarity": 0.12, "low_chroma": 0.12,
                   "intensity_smoothness": 0.10, "low_entropy": 0.08, "brightness_contrast": 0.07, "compactness": 0.05}
SPECULAR_RULE = {"penalty_weight": 0.65, "rejection": 0.50, "structure": 0.42, "safeguard": 0.2, "most_safeguard": 0.95, "most_penalty": 0.85}


def _unit(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def specular_evidence(df: DataFrame, regions: DataFrame, metrics: DataFrame, height: int, width: int, radius: int = 2, ids: Sequence[str] = ("image_id", "label")) -> DataFrame:
    """How much each region looks like a reflection, and what speaks for a crack or pits instead.

    ``df``: image_id, y, x, b, gg, r, gray; ``regions``: ids, y, x; ``metrics``: ids, entropy,
    boundary_smoothness, geometric_irregularity, scale_agreement, local_texture_contrast, component_count.
    The core of a region is its erosion where at least eight pixels are left, else all of it; the
    aspect is that of its upright box. One stencil pass and one join bring the pixels together.
    """
    ids = list(ids)
    key = [*ids, "y", "x"]
    n = neighbours(df.select(*PIXEL, "b", "gg", "r", "gray"), "gray")
    gx, gy = kernel(SOBEL_X), kernel(SOBEL_Y)
    hs, la = hsv(F.col("b"), F.col("gg"), F.col("r")), lab(F.col("b"), F.col("gg"), F.col("r"))
    pixels = n.select(*PIXEL, F.col("gray").cast("double").alias("gray"), F.sqrt(gx * gx + gy * gy).alias("slope"), (hs["v"] / 255.0).alias("value"), (hs["s"] / 255.0).alias("sat"),
                      (F.greatest("b", "gg", "r") - F.least("b", "gg", "r")).alias("range"), F.sqrt(F.pow(la["a"] - 128, 2) + F.pow(la["bb"] - 128, 2)).alias("chroma"))
    core = erode(regions.select(*key), square(1), height, width, ids).withColumn("core", F.lit(True))
    inside = regions.select(*key).join(core, key, "left").select(*key, F.lit(True).alias("inside"), F.coalesce("core", F.lit(False)).alias("core"))
    ring = context_ring(regions, radius, height, width, ids).select(*key, F.lit(False).alias("inside"), F.lit(False).alias("core"))
    px = inside.unionByName(ring).join(pixels, PIXEL)
    own = lambda f, c, on="inside": f(F.when(F.col(on), c))
    share = lambda c: own(F.avg, c.cast("double"))
    g = px.groupBy(*ids).agg(
        share((F.col("value") > SPECULAR["bright"]) & (F.col("sat") < SPECULAR["pale"])).alias("bright_low_saturation"), share(F.col("value") > SPECULAR["high"]).alias("high_value"),
        own(F.avg, F.col("sat")).alias("sat"), own(F.avg, F.col("range")).alias("range"), own(F.avg, F.col("chroma")).alias("chroma"), own(F.avg, F.col("value")).alias("mean_value"),
        own(F.stddev_pop, F.col("gray")).alias("spread"), F.avg(F.when(~F.col("inside"), F.col("gray"))).alias("around"), own(F.count, F.lit(1)).alias("area"), own(F.count, F.lit(1), "core").alias("core_area"),
        own(F.stddev_pop, F.col("gray"), "core").alias("core_spread"), own(F.avg, F.col("slope"), "core").alias("core_slope"), own(F.avg, F.col("slope")).alias("all_slope"),
        (own(F.max, F.col("x")) - own(F.min, F.col("x")) + 1).alias("w"), (own(F.max, F.col("y")) - own(F.min, F.col("y")) + 1).alias("h"))
    c = F.col
    j = g.join(metrics, ids)
    cored = c("core_area") >= 8
    j = j.withColumns({
        "low_saturation": 1 - c("sat"), "channel_similarity": 1 - c("range") / 255, "low_chroma": 1 - F.least(c("chroma") / SPECULAR["chroma"], F.lit(1.0)),
        "intensity_smoothness": 1 - F.least(c("spread") / SPECULAR["spread"], F.lit(1.0)), "low_entropy": 1 - F.least(c("entropy"), F.lit(1.0)),
        "brightness_contrast": _unit(c("mean_value") - F.coalesce(c("around") / 255, c("mean_value"))), "compactness": _unit(0.55 * c("boundary_smoothness") + 0.45 * (1 - c("geometric_irregularity"))),
        "core_texture": F.least(F.when(cored, c("core_spread")).otherwise(c("spread")) / SPECULAR["spread"], F.lit(1.0)),
        "core_gradient": F.least(F.when(cored, c("core_slope")).otherwise(c("all_slope")) / SPECULAR["slope"], F.lit(1.0)),
        "aspect": F.greatest(c("w") / c("h"), c("h") / c("w")), "occupancy": c("area") / (c("w") * c("h"))})
    optical = F.lit(0.0)
    for name, weight in OPTICAL_WEIGHTS.items():
        optical = optical + weight * c(name)
    j = j.withColumn("structural_strength", _unit(F.greatest("core_texture", "core_gradient", "geometric_irregularity")))
    gate = _unit(0.55 * c("mean_value") + 0.45 * c("high_value"))
    elongation, thin = _unit((c("aspect") - 2.5) / 5), _unit((0.42 - c("occupancy")) / 0.32)
    return j.select(
        *ids, _unit(_unit(optical) * (0.30 + 0.70 * gate) * (0.65 + 0.35 * (1 - c("structural_strength")))).alias("specular_likelihood"), "structural_strength",
        _unit(F.greatest(elongation, 0.65 * elongation + 0.35 * thin) * (0.65 + 0.35 * c("scale_agreement"))).alias("crack_safeguard"),
        _unit(F.greatest(_unit((c("component_count") - 1) / 4), c("geometric_irregularity") * F.greatest("core_texture", "local_texture_contrast"))).alias("pitting_safeguard"))


def specular_decision(evidence: DataFrame, crack_weight: float = 0.9, pitting_weight: float = 0.9) -> DataFrame:
    """Add the effective likelihood, the penalty on a score, the safeguard at work and the decision."""
    c, rule = F.col, SPECULAR_RULE
    guard = F.least(F.greatest(crack_weight * c("crack_safeguard"), pitting_weight * c("pitting_safeguard")), F.lit(rule["most_safeguard"]))
    e = evidence.withColumn("effective_specular_likelihood", c("specular_likelihood") * (1 - guard))
    e = e.withColumn("penalty", F.least(c("effective_specular_likelihood") * rule["penalty_weight"], F.lit(rule["most_penalty"])))
    rejected = (c("effective_specular_likelihood") >= rule["rejection"]) & (c("structural_strength") < rule["structure"])
    which = (F.when((c("crack_safeguard") >= c("pitting_safeguard")) & (c("crack_safeguard") > rule["safeguard"]), "crack")
             .when(c("pitting_safeguard") > rule["safeguard"], "pitting").otherwise("none"))
    return e.select("*", which.alias("safeguard"), F.when(rejected, "rejected").when(c("penalty") > 0.01, "penalized").otherwise("retained").alias("decision"),
                    F.when(rejected, "high_specular_likelihood").alias("reason"))
