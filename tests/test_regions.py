"""Run morphology, splitting and merging against plain grids and a sequential fixpoint."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from rastrum.operators import raster, regions

IDS = ["image_id", "item"]


def spans(radius):
    if radius == 0:
        return [(0, 0)]
    return [(dy, int(round(radius * ((radius * radius - dy * dy) / (radius * radius)) ** 0.5))) for dy in range(-radius, radius + 1)]


def shifted(mask, kernel, outside):
    """Values of ``mask`` under every cell of a kernel (rows of reach)."""
    h, w = mask.shape
    r = max(max(abs(dy), reach) for dy, reach in kernel)
    big = np.full((h + 2 * r, w + 2 * r), outside)
    big[r:r + h, r:r + w] = mask
    return [big[r + dy:r + dy + h, r + dx:r + dx + w] for dy, reach in kernel for dx in range(-reach, reach + 1)]


def dilate(mask, kernel):
    return np.logical_or.reduce(shifted(mask, kernel, False))


def erode(mask, kernel):
    return np.logical_and.reduce(shifted(mask, kernel, True))


SQUARE = [(-1, 1), (0, 1), (1, 1)]


def parts(mask):
    """8-connected parts in reading order of their first pixel."""
    left, out = {(int(y), int(x)) for y, x in zip(*np.nonzero(mask))}, []
    for start in sorted(left):
        if start not in left:
            continue
        todo, part = [start], np.zeros_like(mask)
        left.discard(start)
        while todo:
            y, x = todo.pop()
            part[y, x] = True
            near = {(y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1)} & left
            left -= near
            todo += near
        out.append(part)
    return out


def box(mask):
    ys, xs = np.nonzero(mask)
    return xs.min(), ys.min(), xs.max() + 1, ys.max() + 1


def area(b):
    return max(0, b[2] - b[0]) * max(0, b[3] - b[1])


def shared(a, b):
    return max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1]))


def coherence(mask, heat):
    v, n = heat[mask], mask.sum()
    ys, xs = np.nonzero(mask)
    hull = raster.hull_area([(int(x), int(y)) for y in set(ys) for x in (xs[ys == y].min(), xs[ys == y].max())])
    peaks = len(parts(mask & (heat >= np.percentile(v, 85))))
    return np.mean([max(p.sum() for p in parts(mask)) / n, min(n / max(hull, 1), 1), 1 - min(v.std() / 90, 1), 1 / min(max(peaks, 1), 5)])


def rows_of(spark, masks):
    """Rows of {(image, item): mask}."""
    frames = {i: m.shape for (i, _), m in masks.items()}
    cells = [(i, k, int(y), int(x)) for (i, k), m in masks.items() for y, x in zip(*np.nonzero(m))]
    f = spark.createDataFrame([(i, h, w) for i, (h, w) in frames.items()], "image_id long, height int, width int")
    return regions.rows_of_pixels(spark.createDataFrame(cells, "image_id long, item int, y int, x int").repartition(4), f, IDS)


def heat_of(spark, heats, value="v"):
    cells = [(i, y, x, float(h[y, x])) for i, h in heats.items() for y in range(h.shape[0]) for x in range(h.shape[1])]
    return regions.heat_rows(spark.createDataFrame(cells, f"image_id long, y int, x int, {value} double").repartition(4), value).withColumnRenamed("v", value)


def masks_of(rows, ids, shapes):
    out = {}
    for r in regions.pixels_of_rows(rows, *ids).collect():
        key = tuple(r[c] for c in ids)
        out.setdefault(key, np.zeros(shapes[key[0]], bool))[r["y"], r["x"]] = True
    return out


def same(got, want):
    want = {k: m for k, m in want.items() if m.any()}
    assert got.keys() == want.keys()
    for k, m in want.items():
        assert (got[k] == m).all(), k


def blobs(rng, shape, n, size):
    m = np.zeros(shape, bool)
    for _ in range(n):
        y, x = rng.integers(0, shape[0]), rng.integers(0, shape[1])
        m[y:y + rng.integers(1, size), x:x + rng.integers(1, size)] = True
    return m


def test_interval_morphology(spark):
    rng = np.random.default_rng(0)
    masks = {(i, k): blobs(rng, (20 + 3 * i, 31 - 4 * i), 9, 8) for i in range(4) for k in range(2)}
    shapes = {i: m.shape for (i, _), m in masks.items()}
    rows = rows_of(spark, masks)
    for kernel, plain in ((regions.square(1), SQUARE), (regions.ellipse(F.lit(3)), spans(3)), (regions.ellipse(F.lit(0)), spans(0))):
        for ours, theirs in ((regions.dilated, dilate), (regions.eroded, erode), (regions.opened, lambda m, k: dilate(erode(m, k), k)), (regions.closed, lambda m, k: erode(dilate(m, k), k))):
            same(masks_of(ours(rows, IDS, kernel), IDS, shapes), {k: theirs(m, plain) for k, m in masks.items()})
    found = masks_of(regions.parts(rows, IDS).select(*IDS, "first.y", "first.a", "runs", F.col("y").alias("row")).select(*IDS, F.struct("y", "a").alias("first"), "runs", F.col("row").alias("y")), [*IDS, "first"], shapes)
    for k, m in masks.items():
        assert [found[i].tolist() for i in sorted(found) if i[:2] == k] == [p.tolist() for p in parts(m)]
    got = {(r["image_id"], r["item"]): (r["area"], r["x1"], r["y1"], r["x2"], r["y2"]) for r in regions.measures(rows, IDS).collect()}
    assert got == {k: (int(m.sum()), *map(int, box(m))) for k, m in masks.items()}


def test_morphology_shuffles_once(spark):
    rows = rows_of(spark, {(1, 0): np.ones((9, 9), bool)}).repartition(*IDS)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = regions.closed(regions.opened(rows, IDS, regions.square(1)), IDS, regions.ellipse(F.lit(2)))._jdf.queryExecution().executedPlan().toString()
        alone = rows._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert plan.count("Exchange ") == alone.count("Exchange ")


def brute_split(mask, heat):
    n = int(mask.sum())
    if n < mask.size * 0.035:
        return [mask]
    v = heat[mask]
    level = max(np.percentile(v, 78), v.mean() + 0.8 * v.std(), v.max() * 0.45)
    seeds = [p for p in parts(dilate(erode(mask & (heat >= level), SQUARE), SQUARE)) if p.sum() > max(12, n * 0.025)]
    if len(seeds) < 2:
        return [mask]
    grow = max(7, int(np.sqrt(n) * 0.12))
    kernel = spans((grow + 1 - grow % 2) // 2)
    taken, out = np.zeros_like(mask), []
    for seed in seeds[:8]:
        part = dilate(dilate(seed, kernel), kernel) & mask & ~taken
        taken |= part
        out.append(part)
    large = [p for p in out if p.sum() > 20]
    return large if len(large) > 1 and taken.sum() / n > 0.35 else [mask]


def test_split_at_peaks(spark):
    rng = np.random.default_rng(1)
    masks, heats = {}, {}
    for i in range(20):
        shape = (64, 64) if i % 2 else (48, 70)
        heat = rng.uniform(0, 30, shape)
        for _ in range(rng.integers(1, 12)):
            y, x = rng.integers(5, shape[0] - 12), rng.integers(5, shape[1] - 12)
            heat[y:y + 8, x:x + 8] = rng.uniform(150, 250)
        heats[i] = heat
        masks[i, 0] = np.ones(shape, bool) if i < 3 else blobs(rng, shape, 8, 40)
        masks[i, 1] = blobs(rng, shape, 1, 8)
    want = {(i, k, p): m for (i, k), mask in masks.items() for p, m in enumerate(brute_split(mask, heats[i]))}
    got = masks_of(regions.split_at_peaks(rows_of(spark, masks), heat_of(spark, heats), IDS), [*IDS, "part"], {i: h.shape for i, h in heats.items()})
    renamed = {}
    for k in sorted(got):
        renamed[(*k[:2], sum(o[:2] == k[:2] for o in renamed))] = got[k]
    assert sum(p > 0 for _, _, p in want) > 10
    same(renamed, want)


def test_split_fragments(spark):
    rng = np.random.default_rng(2)
    raws = {(i, 0): blobs(rng, (64, 64), 5 + i, 14) for i in range(12)}
    raws[20, 0] = np.zeros((50, 40), bool)
    raws[20, 0][2:40, 3:30] = True  # one part
    raws[21, 0] = raws[20, 0].copy()
    raws[21, 0][45:49, 33:38] = True  # one part dominates
    masks = {k: m & (rng.random(m.shape) < 0.97) for k, m in raws.items()}
    want, want_raw, minimum = {}, {}, 40
    for (i, k), m in masks.items():
        large = [p for p in parts(m) if p.sum() >= max(12, minimum // 2)]
        if len(large) < 2 or area(box(m)) < m.size * 0.05 or max(p.sum() for p in large) / m.sum() > 0.82:
            want[i, k, 0], want_raw[i, k, 0] = m, raws[i, k]
            continue
        for j, p in enumerate(large[:40]):
            want[i, k, j + 1], want_raw[i, k, j + 1] = p, raws[i, k] & dilate(p, [(dy, 3) for dy in range(-3, 4)])
    rows, raw = regions.split_fragments(rows_of(spark, masks), rows_of(spark, raws), minimum, IDS)
    shapes = {i: m.shape for (i, _), m in masks.items()}
    assert any(p > 1 for _, _, p in want) and any(p == 0 for _, _, p in want)
    same(masks_of(rows, [*IDS, "part"], shapes), want)
    same(masks_of(raw, [*IDS, "part"], shapes), want_raw)


def fixpoint(items, may, unite):
    """First pair of the list that may merge, united in the first's place, until none may."""
    items = [({k}, m) for k, m in items]
    while True:
        pair = next(((a, b) for a in range(len(items)) for b in range(a + 1, len(items)) if may(items[a][1], items[b][1])), None)
        if pair is None:
            return items
        a, b = pair
        items[a] = (items[a][0] | items[b][0], unite(items[a][1], items[b][1]))
        del items[b]


def overlapping(heat):
    def may(a, b):
        inside = shared(box(a), box(b)) / max(min(area(box(a)), area(box(b))), 1)
        if (a & b).sum() / max(min(a.sum(), b.sum()), 1) < 0.24 and inside < 0.72:
            return False
        return coherence(a | b, heat) >= 0.44
    return may


def check_merge(spark, masks, merged, may_of, unite_of):
    want, into = {}, {}
    for i in {i for i, _ in masks}:
        for ks, m in fixpoint([(k, m) for (j, k), m in sorted(masks.items()) if j == i], may_of(i), unite_of(i)):
            want[i, min(ks)] = m
            into.update({(i, k): min(ks) for k in ks})
    rows, members = merged
    same(masks_of(rows, IDS, {i: m.shape for (i, _), m in masks.items()}), want)
    assert {(r["image_id"], r["item"]): r["into"] for r in members.collect()} == into
    return len(masks) - len(want)


def test_merge_overlaps(spark):
    rng = np.random.default_rng(3)
    masks, heats = {}, {}
    for i in range(4):
        shape = (40, 56) if i % 2 else (64, 48)
        heats[i] = rng.uniform(60, 110, shape)
        heats[i][10:20, 10:30] += 90
        for k in range(5):
            masks[i, k] = blobs(rng, shape, 1 + k % 3, 22)
    merges = check_merge(spark, masks, regions.merge_overlaps(rows_of(spark, masks), heat_of(spark, heats)), lambda i: overlapping(heats[i]), lambda i: np.logical_or)
    assert 2 < merges < 16


@pytest.mark.parametrize("spread", [20, 160])
def test_merge_similar(spark, spread):
    rng = np.random.default_rng(4)
    masks, texture, colour = {}, {}, {}
    branches = set()
    for i in range(2):
        shape = (90, 120) if i % 2 else (100, 80)
        ramp = np.add.outer(np.arange(shape[0]), np.arange(shape[1]))
        texture[i], colour[i] = 40 + spread * (ramp // 30 % 2) + rng.uniform(0, 5, shape), 60 + spread * (ramp // 45 % 2) + rng.uniform(0, 5, shape)
        for k in range(6):
            masks[i, k] = blobs(rng, shape, 1, 16)
    # pairs that merge for one reason each: boxes overlap, close and alike, touching with like texture
    texture[9], colour[9] = np.full((100, 80), 100.0), np.full((100, 80), 50.0)
    texture[9][:40, :31], texture[9][:40, 31:] = 0, 250
    for k, (y, x, h, w) in enumerate([(5, 10, 20, 24), (5, 28, 20, 24), (50, 5, 3, 3), (50, 17, 3, 3), (70, 5, 20, 20), (70, 29, 20, 20)]):
        masks[9, k] = np.zeros((100, 80), bool)
        masks[9, k][y:y + h, x:x + w] = True

    def may_of(i):
        def may(a, b):
            p, q = box(a), box(b)
            s = shared(p, q)
            distance = np.hypot((p[0] + p[2] - q[0] - q[2]) / 2, (p[1] + p[3] - q[1] - q[3]) / 2) / max(a.shape)
            t, c = (abs(f[i][a].mean() - f[i][b].mean()) / 255 for f in (texture, colour))
            why = (s / max(area(p) + area(q) - s, 1) > 0.08, distance < 0.13 and t < 0.28 and c < 0.28, bool((dilate(a, spans(7)) & b).any()) and t < 0.35)
            branches.update([n for n, w in enumerate(why) if w and sum(why) == 1])
            return any(why)
        return may

    def unite_of(i):
        def unite(a, b):
            size = max(3, int(min(a.shape) * 0.012))
            k = spans((size + 1 - size % 2) // 2)
            return erode(dilate(a | b, k), k)
        return unite

    features = heat_of(spark, texture, "texture").join(heat_of(spark, colour, "colour"), ["image_id", "y"])
    merges = check_merge(spark, masks, regions.merge_similar(rows_of(spark, masks), features), may_of, unite_of)
    assert merges > 3 and branches == {0, 1, 2}


def both_ways(monkeypatch, merge):
    """Results of merging image by image, in how many checkpoints, and of merging in rounds over all tasks."""
    calls, plain = [], regions.checkpointed
    monkeypatch.setattr(regions, "checkpointed", lambda d: calls.append(1) or plain(d))
    got = []
    for limit in (regions.SMALL_ITEMS, 2):  # with 2, images of more items go in rounds and the others do not
        monkeypatch.setattr(regions, "SMALL_ITEMS", limit)
        rows, members = merge()
        got.append(({(r["image_id"], r["item"], r["y"], *[tuple(t) for t in r["runs"]]) for r in rows.collect()}, {tuple(r) for r in members.select("image_id", "item", "into").collect()}))
        got[-1] += (len(calls),)
    return got


@pytest.mark.parametrize("strip", [5, 256])
def test_parts_by_strips(spark, monkeypatch, strip):
    rng = np.random.default_rng(5)
    masks = {(i, k): rng.random((31, 24)) < 0.35 + 0.1 * k for i in range(2) for k in range(2)}
    masks[2, 0] = np.zeros((31, 24), bool)
    masks[2, 0][3:28, 2] = masks[2, 0][3:28, 9] = masks[2, 0][27, 2:10] = True  # its two arms meet in the last strip
    monkeypatch.setattr(regions, "STRIP", strip)
    if strip == 256:  # one strip a frame: no rounds over all tasks
        monkeypatch.setattr(regions, "connected_components", None)
    got: dict = {}
    for r in regions.parts(rows_of(spark, masks), IDS).collect():
        got.setdefault((r["image_id"], r["item"], *r["first"]), set()).update((r["y"], x) for t in r["runs"] for x in range(t["a"], t["b"]))
    want = {}
    for key, mask in masks.items():
        for p in parts(mask):
            pixels = {(int(y), int(x)) for y, x in zip(*np.nonzero(p))}
            want[*key, *min(pixels)] = pixels
    assert got == want


def test_merges_of_small_images_take_no_rounds(spark, monkeypatch):
    rng = np.random.default_rng(7)
    masks, heats = {}, {}
    for i in range(3):
        heats[i] = rng.uniform(60, 110, (30, 36))
        for k in range(2 + i):
            masks[i, k] = np.zeros((30, 36), bool)
            masks[i, k][2:20, 3 * k:3 * k + 9] = True
    overlaps = both_ways(monkeypatch, lambda: regions.merge_overlaps(rows_of(spark, masks), heat_of(spark, heats)))
    assert overlaps[0][:2] == overlaps[1][:2] and overlaps[0][2] <= 3
    assert sum(a != b for _, a, b in overlaps[0][1]) >= 4


def test_similar_merges_agree_in_rounds(spark, monkeypatch):
    rng = np.random.default_rng(8)
    masks = {(i, k): blobs(rng, (60, 70), 1, 9) for i in range(2) for k in range(2 + 2 * i)}
    texture, colour = ({i: c + 90 * (np.add.outer(np.arange(60), np.arange(70)) // 20 % 2) for i in range(2)} for c in (20.0, 60.0))
    features = heat_of(spark, texture, "texture").join(heat_of(spark, colour, "colour"), ["image_id", "y"])
    gone = features.where("image_id = 1 or y <> 5")  # an image whose features do not fill its frame
    for f in (features, gone):
        with monkeypatch.context() as m:
            similar = both_ways(m, lambda: regions.merge_similar(rows_of(spark, masks), f))
        assert similar[0][:2] == similar[1][:2]


def outside(mask):
    """Background that reaches the frame's edge by 4-neighbours, with a frame of background around."""
    h, w = mask.shape
    free = np.pad(~mask, 1, constant_values=True)
    seen, todo = np.zeros_like(free), [(0, 0)]
    while todo:
        y, x = todo.pop()
        if 0 <= y < h + 2 and 0 <= x < w + 2 and free[y, x] and not seen[y, x]:
            seen[y, x] = True
            todo += [(y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)]
    return seen


def test_baselines_of_nested_regions(spark):
    rng = np.random.default_rng(9)
    masks = {i: rng.random(s) < share for i, (s, share) in enumerate([((14, 17), 0.55), ((14, 17), 0.8), ((9, 9), 0.3), ((1, 6), 0.5), ((6, 1), 0.7), ((4, 4), 0.0)])}
    nested = np.zeros((15, 15), bool)
    for r, on in ((7, True), (6, False), (4, True), (3, False), (1, True)):  # rings in rings
        nested[7 - r:8 + r, 7 - r:8 + r] = on
    masks[6] = np.pad(nested, 2)
    frames = spark.createDataFrame([(i, *m.shape) for i, m in masks.items()], "image_id bigint, height int, width int")
    pixels = [(i, int(y), int(x)) for i, m in masks.items() for y, x in zip(*np.nonzero(m))]
    edges = spark.createDataFrame(pixels, "image_id bigint, y bigint, x bigint")
    strength = spark.createDataFrame([(i, y, x, 129.0 if (y + x) % 5 else 128.0) for i, y, x in pixels], "image_id bigint, y bigint, x bigint, v double")
    want = set()
    for i, m in masks.items():
        o = outside(m)
        contour = m & (o[:-2, 1:-1] | o[2:, 1:-1] | o[1:-1, :-2] | o[1:-1, 2:])
        ys, xs = np.mgrid[:m.shape[0], :m.shape[1]]
        for method, mask in (("contour-only baseline", contour), ("fixed-threshold baseline", m & ((ys + xs) % 5 > 0))):
            order = sorted(parts(mask), key=lambda p: min((int(y) // 2, int(x) // 2) for y, x in zip(*np.nonzero(p))))
            want |= {(method, i, k, int(p.sum()), *map(int, box(p))) for k, p in enumerate(order[:8], 1)}
    got = regions.baseline_masks(edges, strength, frames).select("method", "image_id", "rank", "area", "x1", "y1", "x2", "y2").collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert sum(r["image_id"] == 6 and r["method"] == "contour-only baseline" for r in got) == 1  # only the outermost ring
