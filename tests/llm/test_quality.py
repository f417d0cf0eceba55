import math

import numpy as np
from pyspark.sql import functions as F

from rastrum.llm import quality
from tests.conftest import SMALL
from tests.llm.cases import no_docs, odd_docs

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.learn(docs, labels, "quality")
    assert 0 < len(model.rules) < 200
    scores = quality.scored(docs, model).select("row.doc_id", "score")
    rows = scores.where(quality.kept_out("doc_id", 0)).join(labels, "doc_id").select("quality", "score").collect()
    assert len(rows) > 40 and sum((r["score"] >= 0.3) == (r["quality"] == 1) for r in rows) / len(rows) > 0.95


def test_compiled_rules_equal_numpy(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = quality.learn(docs, spark.read.parquet(f"{SMALL}/labels.parquet"), "quality")
    stats = quality.statistics(F.col("text"))
    rows = quality.scored(docs, model).select(*[c.alias(n) for n, c in quality.statistics(F.col("row.text")).items()], "score").toPandas()
    x = rows[list(stats)]
    total = np.full(len(x), model.bias)
    for conditions, weight in model.rules:
        ok = np.ones(len(x), bool)
        for name, at_most, cut in conditions:
            ok &= (x[name] <= cut) if at_most else (x[name] > cut)
        total += weight * ok
    assert np.allclose(1 / (1 + np.exp(-total)), rows["score"])


def test_odd_rows_are_scored(spark):
    labels = spark.createDataFrame([(1, 1), (2, 1), (4, 0), (4, None), (None, 1), (12, 0), (9, 0), (5, 1)], "doc_id long, quality int").withColumn("text", F.lit("x"))
    docs = odd_docs(spark)
    for known in (labels, labels.limit(0), labels.where("quality = 1")):
        out = quality.scored(docs, quality.learn(docs, known, "quality")).collect()
        assert len(out) == docs.count() and all(0 <= r["score"] <= 1 for r in out)
    assert quality.scored(no_docs(spark), quality.learn(no_docs(spark), labels, "quality")).count() == 0
    assert math.isclose(1 / (1 + math.exp(-quality.learn(docs, labels.limit(0), "quality").bias)), 0.5)


def test_sample_is_bounded_and_labels_held_out(spark):
    x = np.random.default_rng(0).random((400, 3))
    model = quality.fit(x, (x[:, 1] > 0.4).astype(float), ["a", "b", "c"])
    assert {n for r, _ in model.rules for n, _, _ in r} == {"b"} or len(model.rules) < 120
