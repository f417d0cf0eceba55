"""Hand-made rasters for the operators that have no SQL oracle."""
import numpy as np
from pyspark.sql import functions as F

from rastrum.operators import raster


def grid(spark, fn, n=8):
    return spark.createDataFrame([(1, y, x, float(fn(y, x))) for y in range(n) for x in range(n)], "image_id bigint, y bigint, x bigint, v double")


def test_hull():
    assert raster.hull_area([(0, 0), (4, 0), (4, 4), (0, 4), (2, 2)]) == 16
    assert raster.hull_area([(0, 0), (1, 1), (2, 2)]) == 0


def test_square_region_is_coherent(spark):
    d = grid(spark, lambda y, x: 100).where("y between 2 and 5 and x between 2 and 5").withColumn("label", F.lit(18).cast("bigint"))
    r = raster.coherence(d, 8, 8).first()
    assert (r["area"], r["solidity"], r["heat_consistency"], r["peak_score"], r["coherence"]) == (16, 1.0, 1.0, 1.0, 1.0)


def test_flat_image_is_stable(spark):
    d = grid(spark, lambda y, x: 200 if 2 <= y <= 5 and 2 <= x <= 5 else 20)
    r = raster.mask_stability(d, d.where("v > 100").select("image_id", "y", "x"), "v", 8, 8, 2).first()
    assert 0.5 <= r["stability"] <= 1.0


def test_feature_maps_cover_the_frame(spark):
    d = grid(spark, lambda y, x: 255 if x == 4 else 30).select("image_id", "y", "x", *[F.col("v").alias(c) for c in "bgr"])
    f = raster.feature_maps(d, 8, 8, radius=2)
    assert f.count() == 64
    lo, hi = f.agg(F.min("strength"), F.max("strength")).first()
    assert (lo, hi) == (0.0, 255.0)


def brute_parts(cells):
    """8-connected parts of a set of (y, x)."""
    left, out = set(cells), []
    while left:
        todo, part = [left.pop()], set()
        while todo:
            y, x = todo.pop()
            part.add((y, x))
            near = {(y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1)} & left
            left -= near
            todo += near
        out.append(part)
    return out


def test_coherence_against_brute_force(spark):
    rng = np.random.default_rng(4)
    rows, want = [], {}
    for image in range(12):
        cells = {(int(y), int(x)) for y, x in rng.integers(0, 12, (30, 2))}
        heat = {c: float(rng.integers(0, 256)) for c in cells}
        rows += [(image, 7, y, x, heat[y, x]) for y, x in cells]
        v = np.array(list(heat.values()))
        peaks = len(brute_parts([c for c in cells if heat[c] >= np.percentile(v, 85)]))
        area = raster.hull_area(list(cells))
        connected = max(map(len, brute_parts(cells))) / len(cells)
        parts = (connected, min(len(cells) / max(area, 1), 1.0), 1 - min(v.std() / 90, 1.0), 1 / min(max(peaks, 1), 5))
        want[image] = (*parts, sum(parts) / 4)
    df = spark.createDataFrame(rows, "image_id bigint, label bigint, y bigint, x bigint, v double")
    got = {r["image_id"]: tuple(r[c] for c in ("connectedness", "solidity", "heat_consistency", "peak_score", "coherence")) for r in raster.coherence(df, 12, 12).collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[i], want[i]) for i in want)


def test_highlight_crack_and_pits(spark):
    """A smooth bright disc looks specular; a thin dark line and scattered spots are safeguarded."""
    def evidence(fn, region, **metrics):
        n = 48
        df = spark.createDataFrame([(1, y, x, *[fn(y, x)] * 4) for y in range(n) for x in range(n)], "image_id bigint, y bigint, x bigint, b bigint, gg bigint, r bigint, gray bigint")
        reg = spark.createDataFrame([(1, y, x) for y in range(n) for x in range(n) if region(y, x)], "image_id bigint, y bigint, x bigint")
        base = {"entropy": 0.0, "boundary_smoothness": 0.9, "geometric_irregularity": 0.1, "scale_agreement": 0.75, "local_texture_contrast": 0.0, "component_count": 1} | metrics
        m = spark.createDataFrame([(1, *base.values())], "image_id bigint, " + ", ".join(f"{k} {'bigint' if k == 'component_count' else 'double'}" for k in base))
        return raster.specular_decision(raster.specular_evidence(df, reg, m, n, n, 2, ["image_id"])).first()
    disc = lambda y, x: (y - 24) ** 2 + (x - 24) ** 2 <= 100
    line = lambda y, x: y == x or y == x + 1
    bright = evidence(lambda y, x: 250 if disc(y, x) else 90, disc)
    dark = evidence(lambda y, x: (30 + 70 * ((y + x) % 2)) if disc(y, x) else 90, disc)
    crack = evidence(lambda y, x: 20 if 22 <= y <= 23 else 120, lambda y, x: 22 <= y <= 23)
    pits = evidence(lambda y, x: 40 if disc(y, x) else 120, disc, component_count=5)
    assert bright["specular_likelihood"] > 0.8 and bright["decision"] == "rejected" and bright["reason"] == "high_specular_likelihood"
    assert dark["specular_likelihood"] < 0.3 and crack["crack_safeguard"] > 0.8 and crack["safeguard"] == "crack" and pits["pitting_safeguard"] >= 0.5


def test_chain_of_overlapping_boxes_settles(spark):
    """Each box overlaps the next and scores less: every other one stays."""
    boxes = spark.createDataFrame([(1, i, float(1000 - i), 6 * i, 0, 6 * i + 10, 10) for i in range(24)], "image_id bigint, box_id bigint, score double, x1 bigint, y1 bigint, x2 bigint, y2 bigint")
    kept = {r["box_id"] for r in raster.suppress_overlaps(boxes).where("kept").collect()}
    assert kept == set(range(0, 24, 2))


def test_long_annotation_lines_are_checked_to_the_end(spark):
    from rastrum.operators.registry import yolo_rows

    files = spark.createDataFrame([(1, "0 " + "0.5 " * 12_000 + "7.0", 10, 10), (2, "0 " + "0.5 " * 12_000, 10, 10)], "image_id bigint, text string, width bigint, height bigint")
    assert {r["image_id"]: r["valid"] for r in yolo_rows(files).collect()} == {1: False, 2: True}


def test_tile_equalise_by_image_and_by_tile(spark, monkeypatch):
    """Both layouts against numpy; pixels of a small frame are shuffled once and no tile becomes 256 rows."""
    import numpy as np
    rng = np.random.default_rng(4)
    images = {1: rng.integers(0, 256, (12, 8)), 2: rng.integers(0, 3, (12, 8))}
    d = spark.createDataFrame([(i, y, x, int(a[y, x])) for i, a in images.items() for y in range(12) for x in range(8)], "image_id bigint, y bigint, x bigint, v bigint")
    want = {}
    for i, a in images.items():
        luts = {}
        for ty in range(3):
            for tx in range(2):
                n = np.bincount(a[ty * 4:ty * 4 + 4, tx * 4:tx * 4 + 4].ravel(), minlength=256).astype(float)
                luts[ty, tx] = (np.cumsum(np.minimum(n, 1.0)) + np.arange(1, 257) * np.maximum(n - 1.0, 0).sum() / 256) * 255 / 16
        for y in range(12):
            for x in range(8):
                py, px = (y + 0.5) / 4 - 0.5, (x + 0.5) / 4 - 0.5
                ly, lx = int(np.floor(py)), int(np.floor(px))
                at = lambda ty, tx: luts[min(max(ty, 0), 2), min(max(tx, 0), 1)][a[y, x]]
                want[i, y, x] = sum((py - ly if dy else 1 - py + ly) * (px - lx if dx else 1 - px + lx) * at(ly + dy, lx + dx) for dy in (0, 1) for dx in (0, 1))
    for small in (raster.SMALL_FRAME, 1):
        monkeypatch.setattr(raster, "SMALL_FRAME", small)
        e = raster.tile_equalise(d, "v", 12, 8, (3, 2))
        got = {(r["image_id"], r["y"], r["x"]): r["v"] for r in e.collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
        assert e._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1].count("Exchange hashpartitioning") == (1 if small > 1 else 2)


def test_small_frames_are_dealt_out_once(spark, monkeypatch):
    """Stability is the same either way; stencils of small frames shuffle pixels by image only."""
    d = grid(spark, lambda y, x: (y * 37 + x * 91) % 256).unionByName(grid(spark, lambda y, x: (y * y * 5 + x * 13) % 256).withColumn("image_id", F.lit(2).cast("bigint")))
    mask = d.where("v > 90").select("image_id", "y", "x")
    got = []
    for small in (raster.SMALL_FRAME, 1):
        monkeypatch.setattr(raster, "SMALL_FRAME", small)
        got.append({r[0]: round(r[1], 9) for r in raster.mask_stability(d, mask, "v", 8, 8, 2).collect()})
    assert got[0] == got[1] and len(got[0]) == 2
    plan = lambda small: raster.saliency_support(d, "v", 2, small)._jdf.queryExecution().executedPlan().toString()
    stencil = lambda p: sum("Exchange hashpartitioning(image_id" in x and (", y#" in x or ", x#" in x) for x in p.splitlines())
    assert stencil(plan(True)) == 0 < stencil(plan(False))


def odd_images(spark):
    """Frames of several sizes up to 12 x 9: noise, flat, one pixel, one row, with pixels missing and with nulls."""
    rng = np.random.default_rng(7)
    sizes = {1: (12, 9), 2: (8, 8), 3: (1, 1), 4: (1, 9), 5: (12, 2), 6: (10, 9), 7: (6, 6), 8: (12, 9)}
    rows = []
    for i, (h, w) in sizes.items():
        a = rng.integers(0, 256, (h, w, 3)) if i not in (2, 8) else np.full((h, w, 3), 90)
        if i == 8:
            a[3:9, 2:7] = 250
        for y in range(h):
            for x in range(w):
                if i == 6 and rng.random() < 0.3:
                    continue
                rows.append((i, y, x, *([None] * 3 if i == 7 and rng.random() < 0.2 else map(int, a[y, x]))))
    return spark.createDataFrame(rows, "image_id bigint, y bigint, x bigint, b bigint, g bigint, r bigint").repartition(5)


def test_maps_of_small_frames_equal_those_by_pixel(spark, monkeypatch):
    """Images dealt out whole give the same maps as stencils by row and column, with one exchange of their pixels."""
    d = odd_images(spark)
    monkeypatch.setattr(raster.sf, "PIXELS", 50)
    got = []
    for small in (raster.SMALL_FRAME, 1):
        monkeypatch.setattr(raster, "SMALL_FRAME", small)
        f = raster.feature_maps(d, 12, 9, radius=2)
        got.append({(r["image_id"], r["y"], r["x"]): r.asDict() for r in f.collect()})
        columns = f.columns
        if small > 1:
            assert f._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1].count("Exchange hashpartitioning") == 1
            assert raster.feature_maps(d.limit(0), 12, 9, radius=2).count() == 0
    assert got[0].keys() == got[1].keys() and set(columns) >= {"b", "gray", *raster.MAPS}
    for k, one in got[0].items():
        for c in columns:
            a, b = one[c], got[1][k][c]
            assert a == b or (a is not None and b is not None and abs(a - b) < 1e-9), (k, c, a, b)
    assert {r["edges"] for r in got[0].values()} == {0.0, 255.0}
