import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as cp
from rastrum.llm import decontam, mixing, neardup, quality
from rastrum.llm.common import written
from tests.conftest import SMALL
from tests.llm.cases import COLUMNS, no_docs, odd_docs


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = docs.count()
    for name, stage in cp.STAGES[:3]:
        out = written(stage(spark, docs, SMALL), "t")
        assert out.columns == COLUMNS and 0 < out.count() < rows, name
        docs, rows = out, out.count()
    model = quality.learn(spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet"), "quality")
    assert quality.scored(docs, model).where("score < 0.3").count() == 0
    assert decontam.matches(docs, spark.read.parquet(f"{SMALL}/benchmark.parquet")).count() == 0
    assert neardup.near_classes(docs).select("class_id").distinct().count() == rows
    mixed = written(cp.mixed(spark, docs, SMALL), "t")
    chosen = mixing.mix(docs).collect()
    assert mixed.count() == sum(2 * c["words"] >= r["size"] for r in chosen for c in r["copies"])
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = sorted((r["doc_id"], zlib.crc32(np.array(lib.encode(r["text"], add_special_tokens=False).ids + [2], "<u4").tobytes())) for r in mixed.collect())
    assert sorted((r["doc_id"], r["ids_crc32"]) for r in cp.tokens(spark, mixed, SMALL).collect()) == want


def test_stages_take_odd_rows(spark):
    for make in (odd_docs, no_docs):
        docs = make(spark)
        for name, stage in cp.STAGES[:4]:
            out = stage(spark, docs, SMALL)
            assert out.columns == docs.columns, name
            assert out.count() <= 2 * docs.count()
        assert cp.tokens(spark, docs, SMALL).count() == docs.count()


def test_run_is_stable(spark):
    a, b = (sorted(map(tuple, cp.run(spark, SMALL).collect())) for _ in range(2))
    assert a == b and len(a) > 100


def test_statistics_are_computed_once(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))

    def copies(df):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        return plan.count("split("), plan.count("array_distinct"), plan.count("regexp_count")

    scores = quality.scored(docs, quality.learn(docs, labels, "quality")).select("row.doc_id", "score")
    assert copies(cp.keep_quality(spark, docs, SMALL)) <= copies(scores)
