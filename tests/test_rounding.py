"""Quantiles and rounding agree with SQL to the last bit."""
import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rastrum.operators import raster as ra
from rastrum.scale import exact_quantiles

PAIRS = [(7.2781899999999995, 75.42181), (3.11297, 88.38703), (6.88437, 100.81563), (16.84354, 65.45645999999999)]


@pytest.mark.parametrize("pair", PAIRS)
def test_median_at_a_rounding_boundary(spark, pair):
    rows = spark.createDataFrame([(1, v) for v in pair], "image_id long, score double").withColumn("kept", F.lit(True))
    got = ra.funnel(rows, ["kept"]).first()
    want = duckdb.connect().execute(f"SELECT round(min(v),1), round(median(v),1), round(max(v),1) FROM (VALUES ({pair[0]!r}::DOUBLE), ({pair[1]!r}::DOUBLE)) x(v)").fetchone()
    assert (got["minimum_score"], got["median_score"], got["maximum_score"]) == want


def test_quantiles_between_equal_and_between_different_values(spark):
    """Each quantile is SQL's to the last bit, and two equal neighbours give just their value."""
    rng = np.random.default_rng(11)
    rows = [(g, round(float(rng.random() * 255), 9)) for g in range(300) for _ in range(2 + g % 63)] + [(g, x) for g, x in zip(range(300, 600), rng.random(300).tolist()) for _ in range(64)]
    probs = {"a": 0.82, "b": 0.65, "c": 0.97, "d": 0.25}
    got = {r["g"]: tuple(r[p] for p in probs) for r in exact_quantiles(spark.createDataFrame(rows, "g long, v double"), ["g"], "v", probs, False).collect()}
    con = duckdb.connect()
    con.register("t", pa.table({"g": [g for g, _ in rows], "v": [float(v) for _, v in rows]}))
    want = {r[0]: r[1:] for r in con.execute(f"SELECT g, {', '.join(f'quantile_cont(v, {p})' for p in probs.values())} FROM t GROUP BY g").fetchall()}
    assert got == want
