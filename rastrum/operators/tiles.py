"""Scores of overlapping tiles at several scales, from sums a cell.

All borders of all tiles and of the rings around them, at every scale, cut a frame into cells. A pixel is added to
its one cell before anything is exchanged; tiles and rings add cells, so their cost does not grow with
their area. Pixels of one cell have one score, so pixels are joined with it once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core import checkpointed
from ..scale import exact_quantiles
from . import small_frames as sf

SCALES = (0.08, 0.16, 0.28)  # fixed values: tile sides as shares of the shorter side of a frame
LEAST = 24
TILE = ["image_id", "scale", "ty", "tx"]


def _scales(ratios: Sequence[float], least: int) -> Column:
    """[(size, step, rest, last_y, last_x)]: a tile every ``step`` = half a side, the last one that still fits."""
    def one(ratio: float) -> Column:
        size = F.greatest(F.lit(least), F.floor(F.least("height", "width") * ratio)).cast("int")
        step = F.floor(size / 2).cast("int")
        last = lambda side: F.floor(F.greatest(F.col(side) - size, F.lit(0)) / step).cast("int")
        return F.struct(size.alias("size"), step.alias("step"), (size - 2 * step).alias("rest"), last("height").alias("last_y"), last("width").alias("last_x"))
    return F.array(*[one(r) for r in ratios])


def _cells(at: str) -> Column:
    """Number of the cell at each scale: twice the step it lies in, and one more past the rest that odd sizes reach into."""
    return F.transform("scales", lambda s: (F.floor(F.col(at) / s["step"]) * 2 + F.when(F.col(at) % s["step"] >= s["rest"], 1).otherwise(0)).cast("int"))


def _tiles(cell: Column, last: Column, ring: int) -> Column:
    """Numbers of the tiles (with ``ring`` = 1: of the rings) that hold a cell."""
    step = F.floor(cell / 2)
    return F.filter(F.sequence(F.greatest(step - 2 - ring, F.lit(0)), F.greatest(F.least(step + ring, last), F.greatest(step - 2 - ring, F.lit(0)))),
                    lambda i: (i <= last) & (i <= step + ring) & ((i >= step - 1 - ring) | (cell % 2 == 0)))


def _placed(cells: DataFrame, ring: int) -> DataFrame:
    """Every cell with the tiles that hold it at each scale."""
    each = cells.withColumn("s", F.explode(F.arrays_zip(F.col("cy"), F.col("cx"), F.col("scales"), F.sequence(F.lit(0), F.size("cy") - 1).alias("n")))).select(
        *[c for c in cells.columns if c not in ("cy", "cx", "scales")], F.col("s.n").alias("scale"), F.col("s.cy").alias("y"), F.col("s.cx").alias("x"), F.col("s.scales").alias("size"))
    rows = each.withColumn("ty", F.explode(_tiles(F.col("y"), F.col("size.last_y"), ring)))
    return rows.withColumn("tx", F.explode(_tiles(F.col("x"), F.col("size.last_x"), ring)))


def tile_features(cells: DataFrame, levels: DataFrame, maps: Sequence[str], bands: Sequence[str], image_means: DataFrame) -> DataFrame:
    """(image_id, scale, ty, tx, features...): map means against the image's, colour and deviation against the ring, entropy."""
    step = lambda c: F.floor(F.col(c) / 2)
    within = lambda c, t: (F.col(t) <= step(c)) & ((F.col(t) >= step(c) - 1) | ((F.col(t) == step(c) - 2) & (F.col(c) % 2 == 0)))
    inside = within("y", "ty") & within("x", "tx")
    ring = _placed(cells, 1).withColumn("__in", inside)
    own = lambda c: F.sum(F.when(F.col("__in"), F.col(c)))
    s = ring.groupBy(*TILE).agg(own("n").alias("n"), F.sum("n").alias("rn"), *[own(m).alias(m) for m in maps],
                                *[f(c).alias(f"{p}{c}") for p, f in (("i_", own), ("r_", F.sum)) for c in (*bands, "g1", "g2")])
    dev = lambda p, n: F.sqrt(F.greatest(F.col(f"{p}g2") / F.col(n) - F.pow(F.col(f"{p}g1") / F.col(n), F.lit(2.0)), F.lit(0.0)))
    apart = sum((F.pow(F.col(f"i_{b}") / F.col("n") - F.col(f"r_{b}") / F.col("rn"), F.lit(2.0)) for b in bands), F.lit(0.0))
    means = image_means.select(F.col("image_id").alias("__image"), *[F.col(m).alias(f"__{m}") for m in maps])
    held = _placed(levels, 0).groupBy(*TILE, "bin").agg(F.sum("n").alias("n"))
    # - sum p log2 p = log2 t - (sum n log2 n) / t
    entropy = held.groupBy(*TILE).agg(((F.log2(F.sum("n")) - F.sum(F.col("n") * F.log2("n")) / F.sum("n")) / 5.0).alias("entropy"))
    return (s.join(means, F.col("image_id") == F.col("__image")).join(entropy, TILE).select(
        *TILE, *[(F.col(m) / F.col("n") / F.greatest(F.col(f"__{m}") * 2.5, F.lit(20.0))).alias(m) for m in maps],
        (F.sqrt(apart) / 45.0).alias("colour_from_ring"), F.greatest("entropy", F.lit(0.0)).alias("entropy"), (F.abs(dev("i_", "n") - dev("r_", "rn")) / 35.0).alias("deviation_from_ring")))


def tile_scores(df: DataFrame, frames: DataFrame | None, maps: Sequence[str], bands: Sequence[str], gray: str = "gray",
                ratios: Sequence[float] = SCALES, least: int = LEAST) -> DataFrame:
    """(image_id, y, x, tile_score) of every pixel: the mean score of the tiles over it, 0 where none fits.

    ``df``: image_id, y, x, the ``maps`` whose means count, the colour ``bands`` and ``gray`` (0 to 255). ``frames``:
    image_id, height, width, one row an image; frames may differ in size. A feature is cut at its 97th
    percentile over all tiles of the image, then divided by the 90th; a tile's score is the mean of its features
    within 0 and 1. A pixel that is missing from ``df`` adds nothing and gets no row.

    Without ``frames``, ``df`` has height and width itself and holds images of small frames whole, one after the other, as
    `small_frames.dealt` and what follows it row by row leave them; they are scored where they are.
    """
    if frames is None:
        d = df.select("image_id", "y", "x", "height", "width", *dict.fromkeys((gray, *maps, *bands)))
        return sf.by_image(d, ["image_id", "y", "x"], ["tile_score"], sf.tile_means(maps, bands, gray, ratios, least))
    sized = frames.select("image_id", _scales(ratios, least).alias("scales"))
    pixels = df.join(sized, "image_id").select("image_id", "y", "x", F.col(gray).cast("double").alias("__gray"), *[F.col(c).cast("double").alias(c) for c in (*maps, *bands)],
                                               "scales", _cells("y").alias("cy"), _cells("x").alias("cx"))
    key = ["image_id", "cy", "cx"]
    one = F.first("scales").alias("scales")
    cells = checkpointed(pixels.groupBy(*key).agg(one, F.count("*").alias("n"), F.sum("__gray").alias("g1"), F.sum(F.col("__gray") * F.col("__gray")).alias("g2"),
                                                  *[F.sum(c).alias(c) for c in dict.fromkeys((*maps, *bands))]))
    levels = pixels.groupBy(*key, F.floor(F.col("__gray") / 8).alias("bin")).agg(one, F.count("*").alias("n"))
    means = cells.groupBy("image_id").agg(*[(F.sum(m) / F.sum("n")).alias(m) for m in maps])
    features = checkpointed(tile_features(cells, levels, maps, bands, means))
    names = [c for c in features.columns if c not in TILE]
    by = ["image_id", "name"]
    long = features.unpivot(TILE, names, "name", "f")
    cut = long.join(exact_quantiles(long, by, "f", {"top": 0.97}), by).withColumn("f", F.least("f", "top")).drop("top")
    scaled = cut.join(exact_quantiles(cut, by, "f", {"unit": 0.90}), by).select(*TILE, (F.col("f") / F.greatest("unit", F.lit(1e-6))).alias("f"))
    score = scaled.groupBy(*TILE).agg(F.greatest(F.least(F.avg("f"), F.lit(1.0)), F.lit(0.0)).alias("score"))
    over = _placed(cells.select(*key, "scales", F.col("cy").alias("key_y"), F.col("cx").alias("key_x")), 0).join(score, TILE)
    mean = over.groupBy("image_id", F.col("key_y").alias("cy"), F.col("key_x").alias("cx")).agg(F.avg("score").alias("tile_score"))
    return pixels.select(*key, "y", "x").join(mean, key, "left").select("image_id", "y", "x", F.coalesce("tile_score", F.lit(0.0)).alias("tile_score"))
