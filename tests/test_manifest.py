"""The stored manifest: hashed once for each state of a file, read without texts."""
import hashlib
import time

import pytest
from pyspark.sql import functions as F

from rastrum.plans import catalog
from rastrum.sources import manifest
from rastrum.sources.tables import Tables
from tests.conftest import SMALL

SHAPE = "doc_id long, text string, lang string, source string, n_chars int"


def rows(spark, path):
    return sorted(((r["doc_id"], r["sha256_hash"]) for r in manifest.hashed_texts(spark, path).collect()), key=repr)


def sha(text):
    return None if text is None else hashlib.sha256(text.encode()).hexdigest()


def add(spark, path, docs):
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], SHAPE).coalesce(1).write.mode("append").parquet(path)


def test_new_and_gone_files(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "documents.parquet")
    docs = [(1, "one"), (2, None), (2, None), (3, "")]
    add(spark, path, docs)
    want = sorted(((i, sha(t)) for i, t in docs), key=repr)
    assert rows(spark, path) == want
    kept = manifest._kept(spark, manifest.folder(spark))
    before = kept.select("fingerprint").distinct().count()
    add(spark, path, [(4, "four")])
    assert rows(spark, path) == sorted([*want, (4, sha("four"))], key=repr)
    kept = manifest._kept(spark, manifest.folder(spark))
    assert kept.select("fingerprint").distinct().count() == before + 1  # the first file was not hashed again
    time.sleep(1)
    spark.createDataFrame([(9, "nine", "en", "s", 4)], SHAPE).coalesce(1).write.mode("overwrite").parquet(path)
    assert rows(spark, path) == [(9, sha("nine"))]
    monkeypatch.setattr(manifest, "_KNOWN", {})  # as another session would find it
    assert rows(spark, path) == [(9, sha("nine"))]


@pytest.mark.parametrize("name", ["j08_overlap_perceptual", "j21_duplicate_lookup", "j27_overlap_audit", "a32_overlap_counts"])
def test_audits_read_no_texts(spark, name):
    plan = catalog.QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "text#" not in plan and "documents.parquet" not in plan


def test_hot_keys_are_counted_once(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(manifest, "_KNOWN", {})
    monkeypatch.setattr(manifest, "has_hot_group", lambda df, keys: calls.append(keys) or False)
    for _ in range(3):
        assert Tables(spark, SMALL).boxes.count() > 0
    assert calls == [("image_id",)]
    monkeypatch.undo()
    assert not manifest.hot_key(Tables(spark, SMALL).box_rows, f"{SMALL}/lineitem.parquet", "image_id")
    spark.conf.set("spark.rastrum.hotGroupRows", "2")
    try:
        assert manifest.hot_key(Tables(spark, SMALL).box_rows, f"{SMALL}/lineitem.parquet", "image_id")
        assert Tables(spark, SMALL).boxes.where(F.col("box_id") == 1).count() == spark.read.parquet(f"{SMALL}/lineitem.parquet").select("l_orderkey").distinct().count()
    finally:
        spark.conf.unset("spark.rastrum.hotGroupRows")
