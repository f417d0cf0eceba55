"""Detector maps and tile scores of small frames: whole images in one task, many at a time, as flat arrays.

Pixels are dealt out by image once and sorted; a task holds about ``PIXELS`` of them, or one image. Frames may differ in size and
lack pixels: a neighbour is the next pixel of the row or column that is there, as in the stencils of `raster`. A null
(NaN here) is missing: sums pass over it and what is made from it alone stays null. A pixel is expected once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .component_tree import Forest

PIXELS = 100_000
#: cells of frames that are summed at a time
CELLS = 1 << 17
Columns = dict[str, np.ndarray]


def dealt(df: DataFrame) -> DataFrame:
    """Each image whole in one partition, its pixels one after the other; pixels without an image are dropped."""
    return df.where("image_id is not null").repartition("image_id").sortWithinPartitions("image_id", "y", "x")


def by_image(df: DataFrame, keep: Sequence[str], out: Sequence[str], made: Callable[[Columns], Columns]) -> DataFrame:
    """``keep`` and the doubles ``out`` that ``made`` finds for runs of whole images of a `dealt` table, or of one that was made from it row by row."""
    schema = ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep] + [f"`{c}` double" for c in out])

    def finish(table: pa.Table) -> Iterator[pa.RecordBatch]:
        cols = {c: _floats(table.column(c)) if c not in ("image_id", "y", "x") else _whole(table.column(c)) for c in table.column_names}
        found = made(cols)
        new = [pa.array(found[c], pa.float64(), from_pandas=True) for c in out]  # NaN is null again
        yield from pa.table([table.column(c) for c in keep] + new, names=[*keep, *out]).to_batches(max_chunksize=20_000)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for part in parts:
            if not part.num_rows:
                continue
            held.append(part)
            rows += part.num_rows
            ids = part.column(part.schema.get_field_index("image_id"))
            if rows < PIXELS or ids[0] == ids[-1] and held[0].column("image_id")[0] == ids[-1]:
                continue
            table = pa.Table.from_batches(held)
            ids = _whole(table.column("image_id"))
            last = int(np.flatnonzero(ids != ids[-1])[-1]) + 1  # the last image may go on
            yield from finish(table.slice(0, last))
            held, rows = table.slice(last).to_batches(), table.num_rows - last
        if held:
            yield from finish(pa.Table.from_batches(held))
    return df.mapInArrow(run, schema)


def _whole(column: pa.ChunkedArray) -> np.ndarray:
    return column.cast(pa.int64()).to_numpy()


def _floats(column: pa.ChunkedArray) -> np.ndarray:
    return column.cast(pa.float64(), safe=False).to_numpy()


def _first(*options: np.ndarray) -> np.ndarray:
    out = options[0]
    for other in options[1:]:
        out = np.where(np.isnan(out), other, out)
    return out


def _heads(*keys: np.ndarray) -> np.ndarray:
    """Where a group of equal keys begins."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return new


class _Lines:
    """Pixels along rows or along columns."""

    def __init__(self, image: np.ndarray, line: np.ndarray, at: np.ndarray, order: np.ndarray, radius: int):
        new = _heads(image[order], line[order])
        n = len(order)
        self.order, self.back = order, np.empty(n, np.int64)
        self.back[order] = np.arange(n)
        self.number = np.cumsum(new) - 1
        along = at[order]
        key = self.number * (int(along.max(initial=0)) - int(along.min(initial=0)) + 2 * radius + 2) + along
        self.lo, self.hi = np.searchsorted(key, key - radius, "left"), np.searchsorted(key, key + radius, "right")

    def step(self, by: int) -> np.ndarray:
        """The pixel ``by`` places on in the line; -1 where the line has ended."""
        n = len(self.order)
        to = np.arange(n) + by
        ok = (to >= 0) & (to < n)
        ok[ok] = self.number[to[ok]] == self.number[ok]
        out = np.full(n, -1)
        out[self.order[ok]] = self.order[to[ok]]
        return out

    def sums(self, v: np.ndarray) -> np.ndarray:
        """Sums over the pixels of the line at most the radius away; NaN where all are missing."""
        def total(x: np.ndarray) -> np.ndarray:
            run = np.concatenate([np.zeros(1), np.cumsum(x)])
            return run[self.hi] - run[self.lo]
        w = v[self.order]
        there = ~np.isnan(w)
        s = total(np.where(there, w, 0.0))
        return (s if there.all() else np.where(total(there) > 0, s, np.nan))[self.back]


class Stencils:
    """Neighbours and box sums of the pixels of whole images, sorted by image, y and x."""

    def __init__(self, image: np.ndarray, y: np.ndarray, x: np.ndarray, radius: int):
        self.rows = _Lines(image, y, x, np.arange(len(image)), radius)
        self.cols = _Lines(image, x, y, np.lexsort((y, x, image)), radius)
        self.steps = {(line, by): getattr(self, line).step(by) for line in ("rows", "cols") for by in (-2, -1, 1, 2)}

    def get(self, v: np.ndarray, line: str, by: int) -> np.ndarray:
        at = self.steps[line, by]
        return np.where(at >= 0, v[at], np.nan)

    def gaussian(self, v: np.ndarray) -> np.ndarray:
        for line in ("rows", "cols"):
            a1, b1, a2, b2 = (self.get(v, line, by) for by in (-1, 1, -2, 2))
            l1, r1 = _first(a1, b1, v), _first(b1, a1, v)
            l2, r2 = _first(a2, np.where(np.isnan(a1), b2, v), v), _first(b2, np.where(np.isnan(b1), a2, v), v)
            v = (l2 + 4 * l1 + 6 * v + 4 * r1 + r2) / 16.0
        return v

    def nine(self, v: np.ndarray, mirror: bool = True) -> list[np.ndarray]:
        left, right = self.get(v, "rows", -1), self.get(v, "rows", 1)
        row = [_first(left, right, v), v, _first(right, left, v)] if mirror else [_first(left, v), v, _first(right, v)]
        up, down, here = self.steps["cols", -1], self.steps["cols", 1], np.arange(len(v))
        above = np.where(up >= 0, up, np.where(down >= 0, down, here) if mirror else here)
        below = np.where(down >= 0, down, np.where(up >= 0, up, here) if mirror else here)
        return [r[above] for r in row] + row + [r[below] for r in row]

    def box_sums(self, *values: np.ndarray) -> list[np.ndarray]:
        """Sums in a square and, first, its number of pixels."""
        return [self.cols.sums(self.rows.sums(v)) for v in (np.ones(len(values[0])), *values)]

    def deviation(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Local mean and population deviation."""
        n, s, q = self.box_sums(v, v * v)
        mean = s / n
        return mean, np.sqrt(np.fmax(q / n - mean * mean, 0.0))


def _kernel(nine: list[np.ndarray], k: Sequence[Sequence[float]]) -> np.ndarray:
    out = np.zeros(len(nine[0]))
    for v, w in zip(nine, (x for row in k for x in row)):
        if w:
            out = out + v * float(w)
    return out


def _stretched(v: np.ndarray, first: np.ndarray, image: np.ndarray) -> np.ndarray:
    """0 to 255 within each image; 0 where an image is flat."""
    lo, hi = np.fmin.reduceat(v, first)[image], np.fmax.reduceat(v, first)[image]
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(hi > lo, (v - lo) * 255.0 / (hi - lo), 0.0)


def _ridges(image: np.ndarray, y: np.ndarray, x: np.ndarray, st: Stencils, gx: np.ndarray, gy: np.ndarray, low: float, high: float) -> np.ndarray:
    """Which pixels are gradient ridges above ``low`` in an 8-connected chain with one above ``high``."""
    m = np.sqrt(gx * gx + gy * gy)
    n = st.nine(m, False)
    ax, ay = np.abs(gx), np.abs(gy)
    which = [ay <= 0.41421356 * ax, ay >= 2.41421356 * ax, gx * gy > 0]
    a, b = np.select(which, [n[3], n[1], n[0]], n[2]), np.select(which, [n[5], n[7], n[8]], n[6])
    at = np.flatnonzero((m > low) & (m >= a) & (m >= b))
    out = np.zeros(len(m), bool)
    if not len(at):
        return out
    number = np.cumsum(_heads(image))[at]
    ys, xs = y[at] - y[at].min(), x[at] - x[at].min()
    wide = int(xs.max()) + 2
    key = (number * (int(ys.max()) + 2) + ys) * wide + xs
    sets = Forest(len(at))
    for dy, dx in ((0, 1), (1, -1), (1, 0), (1, 1)):
        other = key + dy * wide + dx
        to = np.minimum(np.searchsorted(key, other), len(key) - 1)
        here = np.flatnonzero((key[to] == other) & (xs + dx >= 0))
        sets.join(sets.find(here), sets.find(to[here]))
    root = sets.find(np.arange(len(at)))
    strong = np.zeros(len(at), bool)
    strong[root[m[at] > high]] = True
    out[at[strong[root]]] = True
    return out


def detector_maps(evidence: Mapping[str, float], kernels: Sequence, radius: int, level: float, low: float = 55, high: float = 165) -> Callable[[Columns], Columns]:
    """The maps of `raster.feature_maps` from image_id, y, x, b, g, r and gray; ``kernels``: Sobel x, Sobel y, Laplace."""
    def made(c: Columns) -> Columns:
        image, y, x, gray = c["image_id"], c["y"], c["x"], c["gray"]
        new = _heads(image)
        first, number = np.flatnonzero(new), np.cumsum(new) - 1
        st = Stencils(image, y, x, radius)
        blur = st.gaussian(gray)
        nine = st.nine(blur)
        gx, gy, lap = (_kernel(nine, k) for k in kernels)
        around = st.nine(gray, False)
        pattern = np.zeros(len(gray))
        for bit, i in enumerate((0, 1, 2, 5, 8, 7, 6, 3)):
            pattern = pattern + np.where(np.isnan(around[i]) | np.isnan(gray), np.nan, around[i] >= gray) * (1 << bit)
        n, *sums = st.box_sums(c["b"], c["g"], c["r"])
        db, dg, dr = (c[k] - s / n for k, s in zip("bgr", sums))
        maps = {"sobel": np.sqrt(gx * gx + gy * gy), "laplacian": np.abs(lap), "texture": st.deviation(gray)[1],
                "lbp": np.abs(pattern - st.deviation(pattern)[0]), "colour": np.sqrt(db * db + dg * dg + dr * dr)}
        out = {"blur": blur} | {k: _stretched(v, first, number) for k, v in maps.items()}
        out["edges"] = np.where(_ridges(image, y, x, st, gx, gy, low, high), 255.0, 0.0)
        out["threshold"] = np.where(blur <= level, 255.0, 0.0)
        total = np.zeros(len(gray))
        for k, w in evidence.items():
            total = total + w * out[k]
        out["strength"] = _stretched(total, first, number)
        return out
    return made


# ---- tiles ----------------------------------------------------------------------------------
def _quantile(v: np.ndarray, p: float) -> np.ndarray:
    """Quantiles of rows, NaN ignored, with linear interpolation."""
    s = np.sort(v, axis=1)
    n = np.count_nonzero(~np.isnan(v), axis=1)
    at = p * np.maximum(n - 1, 0)
    lo, hi, part = np.floor(at).astype(int), np.ceil(at).astype(int), at - np.floor(at)
    row = np.arange(len(v))
    a, b = s[row, lo], s[row, hi]
    return np.where(a == b, a, a * (1 - part) + b * part)


def _scored(n: int, height: int, width: int, cell: np.ndarray, counts: np.ndarray, cols: Columns, means: Columns, maps: Sequence[str], bands: Sequence[str],
            shape: tuple[int, int], ratios: Sequence[float], least: int) -> np.ndarray:
    """Tile scores of ``n`` frames of one size, as n x tall x wide; ``cell`` numbers pixels in that array of frames."""
    tall, wide = shape
    y0, x0, size, step = [], [], [], []
    for ratio in ratios:
        s = max(least, int(min(height, width) * ratio))
        ys, xs = np.arange(0, max(height - s + 1, 1), s // 2), np.arange(0, max(width - s + 1, 1), s // 2)
        y0.append(np.repeat(ys, len(xs)))
        x0.append(np.tile(xs, len(ys)))
        size.append(np.full(len(ys) * len(xs), s))
        step.append(np.full(len(ys) * len(xs), s // 2))
    y0, x0, size, step = (np.concatenate(v) for v in (y0, x0, size, step))
    clip = lambda v, top: np.clip(v, 0, top)
    own = (y0, clip(y0 + size, tall), x0, clip(x0 + size, wide))
    ring = (clip(y0 - step, tall), clip(y0 + size + step, tall), clip(x0 - step, wide), clip(x0 + size + step, wide))

    def added(v: np.ndarray) -> np.ndarray:
        """Sums of all pixels above and left of a corner, from which a rectangle takes four."""
        run = np.zeros((n, tall + 1, wide + 1))
        run[:, 1:, 1:] = np.bincount(cell, weights=v, minlength=n * tall * wide).reshape(n, tall, wide).cumsum(1).cumsum(2)
        return run

    def inside(run: np.ndarray, box: tuple) -> np.ndarray:
        a, b, c, d = box
        return run[:, b, d] - run[:, a, d] - run[:, b, c] + run[:, a, c]
    gray = cols["__gray"]
    some = lambda v: np.nan_to_num(v)
    runs = {"n": added(counts), "g1": added(some(gray)), "g2": added(some(gray * gray)), **{k: added(some(cols[k])) for k in dict.fromkeys((*maps, *bands))}}
    i = {k: inside(v, own) for k, v in runs.items()}
    r = {k: inside(runs[k], ring) for k in ("n", "g1", "g2", *bands)}
    with np.errstate(divide="ignore", invalid="ignore"):
        dev = lambda s: np.sqrt(np.fmax(s["g2"] / s["n"] - (s["g1"] / s["n"]) ** 2, 0.0))
        apart = sum((i[b] / i["n"] - r[b] / r["n"]) ** 2 for b in bands) if bands else np.zeros_like(i["n"])
        bins = np.where(np.isnan(gray), -1.0, np.floor(gray / 8))
        spread = np.zeros_like(i["n"])
        for b in np.unique(bins):
            k = np.rint(inside(added((bins == b) * counts), own))
            spread += k * np.log2(np.maximum(k, 1.0))
        features = [i[m] / i["n"] / np.maximum(means[m][:, None] * 2.5, 20.0) for m in maps]
        features += [np.sqrt(apart) / 45.0, np.maximum((np.log2(i["n"]) - spread / i["n"]) / 5.0, 0.0), np.abs(dev(i) - dev(r)) / 35.0]
        valid = i["n"] > 0.5
        total, used = np.zeros_like(i["n"]), np.zeros_like(i["n"])
        for f in features:
            f = np.where(valid, f, np.nan)
            f = np.where(valid, np.fmin(f, _quantile(f, 0.97)[:, None]), np.nan)
            f = f / np.maximum(_quantile(f, 0.90)[:, None], 1e-6)
            total, used = total + np.nan_to_num(f), used + ~np.isnan(f)
        score = np.where(valid, np.clip(total / used, 0.0, 1.0), 0.0)

    def spread_out(v: np.ndarray) -> np.ndarray:
        d = np.zeros((n, tall + 1, wide + 1))
        a, b, c, e = own
        for at, to, sign in ((a, c, 1), (b, c, -1), (a, e, -1), (b, e, 1)):
            np.add.at(d, (slice(None), at, to), sign * v)
        return d.cumsum(1).cumsum(2)[:, :tall, :wide]
    over = np.rint(spread_out(valid.astype(float)))
    return np.where(over > 0, np.clip(spread_out(score), 0.0, None) / np.maximum(over, 1.0), 0.0)


def tile_means(maps: Sequence[str], bands: Sequence[str], gray: str, ratios: Sequence[float], least: int) -> Callable[[Columns], Columns]:
    """`tiles.tile_scores` of whole images from image_id, y, x, height, width, gray, maps and bands."""
    names = list(dict.fromkeys((*maps, *bands)))

    def made(c: Columns) -> Columns:
        new = _heads(c["image_id"])
        first, number = np.flatnonzero(new), np.cumsum(new) - 1
        size = np.diff(np.append(first, len(new)))
        height, width = (c[k][first].astype(int) for k in ("height", "width"))
        means = {m: np.add.reduceat(np.nan_to_num(c[m]), first) / size for m in maps}
        out = np.zeros(len(new))
        reach = 2 * np.maximum(least, np.floor(np.minimum(height, width) * max(ratios)).astype(int))
        near = (c["y"] < (height + reach)[number]) & (c["x"] < (width + reach)[number])  # no ring reaches further
        for h, w in np.unique(np.stack([height, width], 1), axis=0):
            images = np.flatnonzero((height == h) & (width == w))
            here = np.zeros(len(first), bool)
            here[images] = True
            seen = near & here[number]
            tall, wide = (max(int(side), int(c[k][seen].max(initial=0)) + 1) for side, k in ((h, "y"), (w, "x")))
            some = max(1, CELLS // (tall * wide))
            for at in range(0, len(images), some):
                part = images[at:at + some]
                place = np.full(len(first), -1)
                place[part] = np.arange(len(part))
                pick = np.flatnonzero((place[number] >= 0) & near)
                cell = (place[number[pick]] * tall + c["y"][pick]) * wide + c["x"][pick]
                cols = {"__gray": c[gray][pick]} | {k: c[k][pick] for k in names}
                found = _scored(len(part), int(h), int(w), cell, np.ones(len(pick)), cols, {m: v[part] for m, v in means.items()}, maps, bands, (tall, wide), ratios, least)
                out[pick] = found.reshape(-1)[cell]
        return {"tile_score": out}
    return made
