"""Components at all thresholds and the calibration curve, against labelling each threshold alone."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from rastrum.operators import component_tree as ct
from tests.test_raster import brute_parts

NAN = float("nan")


def states_by_level(tree):
    """{(image, level, first, area, score, box, hits)} of a collected tree; a component has one state a level."""
    out = []
    for r in tree.collect():
        hits = tuple((h["truth_id"], h["n"]) for h in r["hits"])
        out += [(r["image_id"], k, r["first"], r["area"], r["score"], r["x1"], r["y1"], r["x2"], r["y2"], hits) for k in range(r["low"] + 1, r["high"] + 1)]
    assert len(out) == len(set(out))
    return set(out)


def brute_states(maps, levels, truths):
    out = set()
    for image, values in maps.items():
        for k in range(1, max(levels[image].values()) + 1):
            for part in brute_parts({p for p, lv in levels[image].items() if lv >= k}):
                ys, xs = [p[0] for p in part], [p[1] for p in part]
                hits = {}
                for p in part:
                    if p in truths.get(image, {}):
                        t = truths[image][p]
                        hits[t] = hits.get(t, 0) + 1
                y, x = min(part)
                out.add((image, k, (y << ct.SIDE) + x, len(part), max(values[p] for p in part), min(xs), min(ys), max(xs) + 1, max(ys) + 1, tuple(sorted(hits.items()))))
    return out


def table(spark, maps, levels, truths):
    rows = [(i, y, x, levels[i][y, x], v, truths.get(i, {}).get((y, x))) for i, m in maps.items() for (y, x), v in m.items()]
    return spark.createDataFrame(rows, "image_id bigint, y bigint, x bigint, level int, v double, truth bigint")


def smooth(seed, h, w, steps):
    """A map with plateaus and with peaks that lie across blocks."""
    rng = np.random.default_rng(seed)
    v = rng.random((h, w))
    for _ in range(2):
        p = np.pad(v, 1, mode="edge")
        v = sum(p[a:a + h, b:b + w] for a in range(3) for b in range(3)) / 9
    v = np.floor((v - v.min()) / (v.max() - v.min()) * steps)
    return {(y, x): float(v[y, x]) for y in range(h) for x in range(w)}


@pytest.mark.parametrize("bits", [1, 2, 3, 7])
def test_blocks_of_any_size_give_the_states_of_each_threshold(spark, bits):
    maps = {1: smooth(1, 19, 23, 12), 2: smooth(2, 8, 8, 5), 2**53 + 1: smooth(3, 1, 31, 9), 4: {(0, 0): 3.0}, 5: {(y, x): 2.0 for y in range(9) for x in range(9)}}
    levels = {i: {p: int(v) for p, v in m.items()} for i, m in maps.items()}
    truths = {1: {(y, x): (0 if x < 12 else 7) for y in range(4, 14) for x in range(3, 20)}, 5: {(0, 0): 3, (8, 8): 4}}
    tree = ct.component_tree(table(spark, maps, levels, truths), bits, rows=150)
    assert states_by_level(tree) == brute_states(maps, levels, truths)


def test_a_spiral_over_many_blocks_is_one_component(spark):
    path, y, x, dy, dx, n = set(), 0, 0, 0, 1, 24
    for leg in [n - 1] + [k for k in range(n - 1, 1, -2) for _ in (0, 1)]:
        for _ in range(leg):
            path.add((y, x))
            y, x = y + dy, x + dx
        dy, dx = dx, -dy
    maps = {1: {p: 1.0 + (p[0] * 7 + p[1]) % 3 for p in path}}
    levels = {1: {p: int(v) for p, v in maps[1].items()}}
    got = states_by_level(ct.component_tree(table(spark, maps, levels, {}), 2, rows=50))
    assert got == brute_states(maps, levels, {}) and sum(k == 1 for _i, k, *_ in got) == 1


def test_no_pixel_above_a_threshold(spark):
    none = table(spark, {1: {(0, 0): 1.0}}, {1: {(0, 0): 0}}, {})
    assert ct.component_tree(none).count() == 0 and ct.component_tree(none.limit(0)).count() == 0


def most(edges):
    """Size of the largest one-to-one choice of (proposal, truth) edges, by trying all."""
    if not edges:
        return 0
    (a, b), rest = edges[0], edges[1:]
    return max(most(rest), 1 + most([e for e in rest if e[0] != a and e[1] != b]))


def brute_curve(maps, truths, images, cuts, minimum, keep, iou):
    out, kinds = [], {}
    for cut in cuts:
        clean_n = clean_any = total = matched = wanted = detected = 0
        recalls, per = [], {}
        for i, (clean, kind) in images.items():
            parts = [p for p in brute_parts({q for q, v in maps.get(i, {}).items() if v == v and v >= cut}) if len(p) >= minimum]
            box = lambda p: (min(x for _, x in p), min(y for y, _ in p), max(x for _, x in p), max(y for y, _ in p))
            parts = sorted(parts, key=lambda p: (-max(maps[i][q] for q in p), -len(p), box(p), min(p)))[:keep]
            total += len(parts)
            if clean:
                clean_n, clean_any = clean_n + len(parts), clean_any + bool(parts)
                continue
            regions = {t: {q for q, u in truths.get(i, {}).items() if u == t} for t in set(truths.get(i, {}).values())}
            m = most([(a, t) for a, p in enumerate(parts) for t, r in regions.items() if len(set(p) & r) / len(set(p) | r) + 1e-12 >= iou])
            matched, wanted, detected = matched + m, wanted + len(regions), detected + (m > 0)
            recalls += [m / len(regions)] if regions else []
            got = per.setdefault(kind, [0, 0])
            got[0], got[1] = got[0] + m, got[1] + len(regions)
        cleans = sum(c for c, _ in images.values())
        div = lambda a, b: round(a / b, 9) if b else None
        out.append((cut, div(clean_n, cleans), div(clean_any, cleans), div(matched, wanted), div(sum(recalls), len(recalls)), div(detected, len(images) - cleans), div(matched, total), div(total, len(images))))
        kinds.update({(cut, k): div(a, b) for k, (a, b) in per.items()})
    return out, kinds


def curve_of(spark, maps, truths, images, **how):
    flat = [(i, y, x, v) for i, m in maps.items() for (y, x), v in m.items()]
    told = [(i, y, x, t) for i, m in truths.items() for (y, x), t in m.items()]
    return ct.calibration_points(spark.createDataFrame(flat, "image_id bigint, y bigint, x bigint, v double"), spark.createDataFrame(told, "image_id bigint, y bigint, x bigint, truth bigint"),
                                 spark.createDataFrame([(i, *k) for i, k in images.items()], "image_id bigint, clean boolean, category string"), **how)


def test_curve_equals_each_threshold_alone(spark):
    maps = {i: {p: v / 7 for p, v in smooth(10 + i, 13, 11, 40).items()} for i in range(6)}
    maps[0][0, 0] = NAN
    maps[5] = {(0, 0): 0.0}
    truths = {i: {(y, x): (0 if y < 6 else 1 if x < 6 else 2) for y in (0, 1, 2, 3, 8, 9, 10) for x in range(1 + i % 2, 10) if x != 6} for i in range(5)}
    images = {0: (True, "a"), 1: (False, "a"), 2: (False, "b"), 3: (False, None), 4: (False, "b"), 5: (False, "c"), 6: (True, "a")}  # 5 has no truths, 6 no map
    curve, kinds = curve_of(spark, maps, truths, images, minimum=3, keep=4, count=21, iou=0.1)
    rows = curve.orderBy("threshold").collect()
    cuts = [r["threshold"] for r in rows]
    want, want_kinds = brute_curve(maps, truths, images, cuts, 3, 4, 0.1)
    assert [(r["threshold"], *(None if v is None else round(v, 9) for v in r[2:])) for r in rows] == want
    assert {(r["threshold"], r["category"]): None if r["sensitivity"] is None else round(r["sensitivity"], 9) for r in kinds.collect()} == want_kinds
    assert [r["point"] for r in rows] == list(range(len(rows)))[::-1] and any(0 < r["sensitivity"] < 1 for r in rows)
    assert cuts[-1] > max(v for m in maps.values() for v in m.values() if v == v) and rows[-1]["proposals_per_image"] == 0


def test_curve_of_no_maps(spark):
    curve, kinds = curve_of(spark, {1: {(0, 0): NAN}}, {}, {1: (True, "a")})
    assert curve.count() == 0 and kinds.count() == 0


def test_groups_stay_small(spark, monkeypatch):
    """600,000 pixels: no task is handed more rows at a time than with fewer."""
    plain = ct._settle

    def settle(*args):
        run = plain(*args)

        def bounded(pdf):
            assert len(pdf) <= 60_000
            return run(pdf)
        return bounded
    monkeypatch.setattr(ct, "_settle", settle)
    at = F.explode(F.sequence(F.lit(0), F.lit(63))).alias("i")
    pixels = spark.range(9375).select(F.col("id").alias("image_id"), at).select(
        "image_id", F.floor(F.col("i") / 8).alias("y"), (F.col("i") % 8).cast("bigint").alias("x"), F.lit(1).alias("level"), F.col("i").cast("double").alias("v"), F.lit(None).cast("bigint").alias("truth"))
    tree = ct.component_tree(pixels).agg(F.count("*").alias("n"), F.sum("area").alias("area"), F.min("score").alias("score")).first()
    assert tuple(tree) == (9375, 600_000, 63.0)
