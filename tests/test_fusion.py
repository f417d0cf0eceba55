"""Operating points as bits: the same choices as one run a point."""
import random

from pyspark.sql import functions as F

from rastrum.operators import fusion as fu
from rastrum.operators import matching as mt


def test_assignment_at_every_point(spark):
    rng = random.Random(5)
    rows = [(i, p, t, round(rng.uniform(0.25, 1), 3), rng.randrange(1, 64)) for i in range(40) for p in range(4) for t in range(3) if rng.random() < 0.6]
    e = spark.createDataFrame(rows, "image_id long, proposal_id long, truth_id long, mask_iou double, points long")
    won = mt.assign_one_to_one(e, ["image_id"]).collect()
    each = e.withColumn("bit", F.explode(F.array(*[F.lit(b) for b in range(6)]))).where(F.col("points").bitwiseAND(F.expr("shiftleft(1L, bit)")) != 0).drop("points")
    def totals(rows):
        out = {}
        for k, w in rows:
            n, total = out.get(k, (0, 0.0))
            out[k] = (n + 1, round(total + w, 6))
        return out
    want = totals(((r["bit"], r["image_id"]), r["mask_iou"]) for r in mt.assign_one_to_one(each, ["bit", "image_id"]).collect())
    assert totals(((b, r["image_id"]), r["mask_iou"]) for r in won for b in range(6) if r["points"] >> b & 1) == want


def test_thresholds_by_cells(spark):
    rng = random.Random(6)
    clean = [(round(rng.random() ** 3, 3), round(0.5 + rng.random() / 5000, 6)) for _ in range(400)]  # crowded cells and ties
    grid = fu.fusion_grid(spark)
    scored = fu.score_grid(spark.createDataFrame(clean, "classical double, normality double"), grid)
    rows = {}
    for r in scored.collect():
        rows.setdefault(r["configuration_id"], []).append((r["score"], r["preserved"]))
    for n_clean in (4, 37, 300, 2000):
        for r in fu.budget_thresholds(scored, grid, n_clean).collect():
            mine = rows[r["configuration_id"]]
            room = int(r["budget"] * n_clean + 1e-12) - sum(p for _, p in mine)
            fit = [s for s, p in mine if not p and sum(1 for x, q in mine if not q and x >= s) <= room]
            assert r["threshold"] == (min(fit) if fit else None)
