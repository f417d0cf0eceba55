"""Aggregate metrics with explicit denominators: an undefined figure is null, never zero."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core import r6, ratio
from .matching import IOU_THRESHOLDS, PRIMARY_IOU, SLACK, TOP_K, assign_one_to_one, rank_proposals


SCOPES = [f"iou_{t:.2f}" for t in IOU_THRESHOLDS] + [f"top_{k}" for k in TOP_K]


def scoped_assignments(pairs: DataFrame, proposals: DataFrame) -> DataFrame:
    """One assignment run for every threshold and every rank cut at once.

    The i-th scope is bit i of ``points``, so a pair is one row whatever the number of scopes. Where the pairs
    bring their proposals' ``rank``, the proposals are not ranked again.
    """
    if "rank" not in pairs.columns:
        ranks = rank_proposals(proposals).select("image_id", "method", "proposal_id", "rank")
        pairs = pairs.join(ranks, ["image_id", "method", "proposal_id"])
    iou, rank = F.col("mask_iou") + SLACK, F.col("rank")
    inside = [iou >= t for t in IOU_THRESHOLDS] + [(iou >= PRIMARY_IOU) & (rank <= k) for k in TOP_K]
    points = F.lit(0).cast("bigint")
    for i, c in enumerate(inside):
        points = points + F.when(c, F.lit(1 << i)).otherwise(F.lit(0))
    return assign_one_to_one(pairs.withColumn("points", points).where("points <> 0"), ["image_id", "method"])


def image_evaluations(assigned: DataFrame, base: DataFrame, meta: DataFrame) -> DataFrame:
    """One row per (image, method): counts, matched truths per scope, category and status."""
    there = lambda n: F.col("points").bitwiseAND(F.lit(1 << SCOPES.index(n))) != 0
    names, primary = SCOPES, there(f"iou_{PRIMARY_IOU:.2f}")
    g = assigned.groupBy("image_id", "method").agg(
        *[F.sum(there(n).cast("bigint")).alias(n.replace(".", "")) for n in names],
        F.sum(F.when(primary, F.col("mask_iou"))).alias("iou_sum"),
        F.sum(F.when(primary, 2 * F.col("mask_iou") / (1 + F.col("mask_iou")))).alias("dice_sum"))
    j = base.join(g, ["image_id", "method"], "left").join(meta, "image_id", "left")
    fill = [n.replace(".", "") for n in names]
    return j.select("image_id", "method", "proposal_count", "truth_count", "category", "acquisition_group_id", "seconds",
                    F.when(F.col("truth_count") > 0, "anomaly_present").otherwise("no_anomaly").alias("status"),
                    *[F.coalesce(c, F.lit(0)).alias(c) for c in fill], *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("iou_sum", "dice_sum")])


def _pos() -> Column:
    return F.col("status") == "anomaly_present"


def _sum(cond: Column, c: Column | str) -> Column:
    return F.coalesce(F.sum(F.when(cond, F.col(c) if isinstance(c, str) else c)), F.lit(0))


def aggregate(evals: DataFrame, by: Sequence[str] = ("method",)) -> DataFrame:
    """Micro, macro and image-level sensitivity, precision, clean burden, localisation and cost."""
    pos, clean, one = _pos(), ~_pos(), F.lit(1)
    m = "iou_025"
    return evals.groupBy(*by).agg(
        F.count("*").alias("image_count"), _sum(pos, one).cast("bigint").alias("positive_image_count"), _sum(clean, one).cast("bigint").alias("clean_image_count"),
        _sum(pos, "truth_count").alias("total_truth_instances"), F.sum("proposal_count").alias("total_proposals"), F.sum(m).alias("matched_truth_instances"),
        r6(ratio(F.sum(m), _sum(pos, "truth_count"))).alias("micro_component_sensitivity"),
        r6(F.avg(F.when(pos, F.col(m) / F.col("truth_count")))).alias("macro_per_positive_image_recall"),
        r6(ratio(_sum(pos & (F.col(m) > 0), one), _sum(pos, one))).alias("image_level_detection_sensitivity"),
        r6(ratio(F.sum(m), F.sum("proposal_count"))).alias("proposal_precision"),
        r6(ratio(_sum(clean, "proposal_count"), _sum(clean, one))).alias("clean_false_proposals_per_image"),
        r6(ratio(_sum(clean & (F.col("proposal_count") > 0), one), _sum(clean, one))).alias("clean_images_with_any_proposal"),
        r6(ratio(F.sum("iou_sum"), F.sum(m))).alias("assigned_pair_iou_mean"), r6(ratio(F.sum("dice_sum"), F.sum(m))).alias("assigned_pair_dice_mean"),
        r6(F.avg("seconds")).alias("mean_processing_time_seconds"), r6(ratio(F.sum("proposal_count"), F.count("*"))).alias("mean_proposals_per_image"))


def by_scope(evals: DataFrame, scopes: dict[str, str], ranked: bool = True) -> DataFrame:
    """Matched share of truths for each named scope column, one row per (method, scope)."""
    cols = [r6(ratio(_sum(_pos(), c), _sum(_pos(), "truth_count"))).alias(n) for n, c in scopes.items()]
    wide = evals.groupBy("method").agg(*cols)
    long = wide.unpivot(["method"], [F.col(f"`{n}`") for n in scopes], "scope", "sensitivity")
    return long if ranked else long.withColumn("sensitivity", F.lit(None).cast("double"))


def stratified(evals: DataFrame, field: str) -> DataFrame:
    """Matched share of truths per non-blank stratum; null when the stratum has no truth."""
    return (evals.where(F.coalesce(field, F.lit("")) != "").groupBy("method", F.col(field).alias("stratum"))
            .agg(r6(ratio(_sum(F.col("truth_count") > 0, "iou_025"), F.sum("truth_count"))).alias("sensitivity")))


def nuisance(evals: DataFrame) -> DataFrame:
    clean = evals.where(~_pos() & (F.coalesce("category", F.lit("")) != ""))
    return clean.groupBy("method", "category").agg(r6(ratio(F.sum("proposal_count"), F.count("*"))).alias("false_proposals_per_image"))


# ---- score curves -------------------------------------------------------------------------
def _cumulative(df: DataFrame, score: str, positive: Column) -> DataFrame:
    """Positives and negatives at or above each distinct score; rows collapse before ordering."""
    from ..scale import running_sums
    by_score = df.groupBy(F.col(score).cast("double").alias("s")).agg(
        F.sum(positive.cast("bigint")).alias("p"), F.sum((~positive).cast("bigint")).alias("n"))
    return running_sums(by_score, [], [("s", False)], {"tp": F.col("p"), "fp": F.col("n")})


def average_precision(df: DataFrame, score: str, positive: Column) -> DataFrame:
    """Sum of recall steps times precision over distinct scores."""
    c = _cumulative(df, score, positive)
    return c.agg(r6(F.sum(F.col("p") * F.col("tp") / (F.col("tp") + F.col("fp"))) / F.sum("p")).alias("average_precision"))


def roc_auc(df: DataFrame, score: str, positive: Column) -> DataFrame:
    """Probability that a positive outscores a negative, ties counting half."""
    c = _cumulative(df, score, positive)
    wins = F.sum(F.col("n").cast("double") * (F.col("tp") - F.col("p") / 2.0))
    return c.agg(r6(F.when((F.sum("p") > 0) & (F.sum("n") > 0), wins / (F.sum("p") * F.sum("n")))).alias("roc_auc"))
