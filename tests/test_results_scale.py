"""Results of large tables: what a task holds, and pairs in one pass."""
from pyspark.sql import functions as F

from rastrum import scale
from rastrum.operators import analysis as an
from rastrum.sources.tables import Tables
from tests.conftest import SMALL


def test_line_items_are_dealt_out_by_size(spark, monkeypatch):
    whole = Tables(spark, SMALL).results.agg(F.count("*"), F.sum("final_proposals"), F.sum("first_true_anomaly_proposal_rank")).first()
    monkeypatch.setattr(scale, "PART_ROWS", 100)
    parts = Tables(spark, SMALL).results.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n"), F.sum("final_proposals").alias("lines"), F.sum("first_true_anomaly_proposal_rank").alias("ranks")).collect()
    assert len(parts) > 20 and max(r["lines"] for r in parts) < 400
    assert tuple(whole) == tuple(sum(r[c] or 0 for r in parts) for c in ("n", "lines", "ranks"))


def test_complete_pairs_in_one_pass(spark):
    scope = Tables(spark, SMALL).scope
    adv = scope.where(F.col("method").isin(an.FUSED, an.CONTEXTUAL) & (F.col("run_status") == "completed"))
    both = adv.groupBy(*an.PAIR_KEYS).agg(F.count_distinct("method").alias("n")).where("n = 2").select(*an.PAIR_KEYS)
    want = an.paired_advanced(scope.join(both, an.PAIR_KEYS, "left_semi"), check=False)
    got = an.paired_advanced(scope, check=False, complete=True)
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty() and not got.isEmpty()
    assert got.count() < an.paired_advanced(scope, check=False).count()
