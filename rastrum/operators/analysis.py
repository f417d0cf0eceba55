"""Filtering, category summaries, strict pairing and resampling over result tables."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core import any_row, checkpointed, r6
from ..scale import exact_quantiles, ranked
from ..sources.tables import METHODS

FUSED, CONTEXTUAL = METHODS[2], METHODS[3]
PAIR_KEYS = ["experiment_id", "experiment_version", "image_id"]
# Columns the free-text search covers.
SEARCH_COLUMNS = ["experiment_id", "plan_id", "dataset_id", "dataset_version", "dataset_split", "image_filename", "image_id",
                  "anomaly_type", "clean_artefact_type", "image_outcome", "method", "review_status", "run_status"]
PAIR_METRICS = ["final_proposals", "top_1_hit", "top_3_hit", "top_5_hit", "top_8_hit", "proposal_precision", "proposal_recall",
                "mean_iou", "best_iou", "false_positive_proposals", "processing_time_seconds", "first_true_anomaly_proposal_rank"]
OUTCOME_METRICS = ["proposal_precision", "proposal_recall", "mean_iou", "best_iou", "false_positive_proposals",
                   "processing_time_seconds", "first_true_anomaly_proposal_rank"]
LOWER_BETTER = {"false_positive_proposals", "processing_time_seconds", "first_true_anomaly_proposal_rank"}


class PairingError(ValueError):
    """The rows cannot be paired strictly."""


def enrich_results(results: DataFrame, plans: DataFrame, images: DataFrame) -> DataFrame:
    """Results with their plan's dataset scope and their image's category."""
    p = plans.select("plan_id", "dataset_id", "dataset_version", F.col("split").alias("dataset_split"))
    i = images.select("image_id", "anomaly_type", "image_outcome")
    out = results.join(p, "plan_id", "left").join(i, "image_id", "left")
    return out.withColumn("clean_artefact_type",
                          F.when(F.col("image_outcome") == "no_anomaly", F.col("anomaly_type")).otherwise(""))


def positive() -> Column:
    return F.col("image_outcome") == "anomaly_present"


def clean() -> Column:
    return F.col("image_outcome") == "no_anomaly"


# ---- filters ------------------------------------------------------------------------------
def search_rows(df: DataFrame, needle: str) -> DataFrame:
    cols = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in SEARCH_COLUMNS if c in df.columns]
    return df.where(F.lower(F.concat_ws(" ", *cols)).contains(needle.strip().lower())) if needle.strip() else df


def membership(df: DataFrame, filters: Mapping[str, Sequence | None]) -> DataFrame:
    """Keep rows in every list; an empty list does not filter, "N/A" stands for null."""
    for c, values in filters.items():
        values = list(values or [])
        if not values or c not in df.columns:
            continue
        keep = F.col(c).isin(*[v for v in values if v != "N/A"]) if [v for v in values if v != "N/A"] else F.lit(False)
        if "N/A" in values:
            keep = keep | F.col(c).isNull()
        df = df.where(keep)
    return df


def numeric_ranges(df: DataFrame, ranges: Mapping[str, tuple[float | None, float | None]]) -> DataFrame:
    for c, (lo, hi) in ranges.items():
        if lo is not None:
            df = df.where(F.col(c) >= lo)
        if hi is not None:
            df = df.where(F.col(c) <= hi)
    return df


def quick_predicates(experiment: str = "", image: str = "") -> dict[str, Column]:
    rank = F.col("first_true_anomaly_proposal_rank")
    cat, out, method = F.col("anomaly_type"), F.col("image_outcome"), F.col("method")
    # Names of the quick filters.
    return {
        "Current selected experiment": F.col("experiment_id") == experiment,
        "SYN-BALANCED-001": F.col("experiment_id") == "SYN-BALANCED-001",
        "Anomaly images only": positive(),
        "Clean/no-anomaly images only": clean(),
        "Thin cracks only": cat == "thin_crack",
        "Pitting clusters only": cat == "pitting_cluster",
        "Specular highlights only": cat == "specular_highlights",
        "Successful runs only": F.col("run_status") == "completed",
        "Failed runs only": F.col("run_status") == "failed",
        "True anomaly found": rank.isNotNull(),
        "True anomaly missed": (out == "anomaly_present") & rank.isNull(),
        "False-positive cases": F.col("false_positive_proposals") > 0,
        "Zero-proposal clean images": clean() & (F.col("final_proposals") == 0),
        "Refined contextual only": method == CONTEXTUAL,
        "Multi-scale fused only": method == FUSED,
        "Compare advanced methods": method.isin(FUSED, CONTEXTUAL),
        "Compare all methods for selected image": F.col("image_filename") == image,
    }


def result_sort(df: DataFrame, first: str, second: str = "", ascending: bool = False) -> DataFrame:
    keys = [F.col(c).asc_nulls_last() if ascending else F.col(c).desc_nulls_last() for c in (first, second) if c]
    return df.orderBy(*keys)


def analysis_scope(df: DataFrame, experiment: str, version: int, dataset: str | None = None,
                   dataset_version: str | None = None, split: str | None = None) -> DataFrame:
    df = df.where((F.col("experiment_id") == experiment) & (F.col("experiment_version") == version))
    for c, v in (("dataset_id", dataset), ("dataset_version", dataset_version), ("dataset_split", split)):
        if v:
            df = df.where(F.col(c) == v)
    return df


# The named column views.
VIEWS = {
    "essential": ["image_filename", "method", "anomaly_type", "image_outcome", "run_status", "proposal_precision", "proposal_recall"],
    "metrics": ["image_id", "method", "top_1_hit", "top_3_hit", "top_5_hit", "top_8_hit", "proposal_precision", "proposal_recall",
                "mean_iou", "best_iou", "processing_time_seconds"],
    "provenance": ["result_id", "plan_id", "experiment_id", "experiment_version", "dataset_id", "dataset_version", "dataset_split",
                   "recorded_timestamp"],
}


def column_view(df: DataFrame, view: str, custom: Sequence[str] = ()) -> DataFrame:
    return df.select(*[c for c in (custom if view == "custom" else VIEWS[view]) if c in df.columns])


# ---- summaries ----------------------------------------------------------------------------
def _mean_when(cond: Column, col: str) -> Column:
    return F.avg(F.when(cond, F.col(col).cast("double")))


def method_summary(results: DataFrame) -> DataFrame:
    """Per method over completed rows; recall figures use rows whose recall is defined."""
    has = F.col("proposal_recall").isNotNull()
    return (results.where((F.col("run_status") == "completed") & F.col("method").isNotNull()).groupBy("method").agg(
        F.count("*").alias("images"),
        *[r6(_mean_when(has, f"top_{k}_hit")).alias(f"top_{k}_proposal_recall") for k in (1, 3, 5, 8)],
        r6(F.avg("proposal_precision")).alias("proposal_precision"), r6(F.avg("proposal_recall")).alias("proposal_recall"),
        r6(F.avg("false_positive_proposals")).alias("false_proposals_per_image"),
        r6(F.avg("processing_time_seconds")).alias("processing_time_seconds")))


def category_summary(df: DataFrame) -> DataFrame:
    """Twenty measures per category and method; the null category is kept as `unclassified`."""
    done = df.where(F.col("run_status") == "completed").withColumn(
        "category", F.when(F.coalesce(F.col("anomaly_type"), F.lit("")) == "", "unclassified").otherwise(F.col("anomaly_type")))
    keys, rank = ["category", "method"], "first_true_anomaly_proposal_rank"
    std = lambda c, cond=None: r6(F.stddev_samp(F.when(cond, F.col(c)) if cond is not None else F.col(c)))
    base = done.groupBy(*keys).agg(
        F.count_distinct("image_id").alias("images"), F.count_distinct(F.when(positive(), F.col("image_id"))).alias("anomaly_present_images"),
        F.count_distinct(F.when(clean(), F.col("image_id"))).alias("clean_images"),
        r6(F.avg("proposal_precision")).alias("proposal_precision"), std("proposal_precision").alias("proposal_precision_std"),
        r6(_mean_when(positive(), "proposal_recall")).alias("proposal_recall"), std("proposal_recall", positive()).alias("proposal_recall_std"),
        r6(_mean_when(positive(), "mean_iou")).alias("mean_iou"), r6(_mean_when(positive(), "best_iou")).alias("best_iou"),
        r6(F.avg("false_positive_proposals")).alias("mean_false_proposals_per_image"),
        F.sum(F.when(positive(), F.col("false_negative_anomalies")).otherwise(0)).alias("false_negative_count"),
        r6(_mean_when(positive(), rank)).alias("mean_first_true_anomaly_rank"),
        r6(F.avg("processing_time_seconds")).alias("mean_processing_time"), std("processing_time_seconds").alias("processing_time_std"),
        F.sum((clean() & (F.col("final_proposals") == 0)).cast("bigint")).alias("correct_zero_proposal_clean_images"),
        *[r6(_mean_when(positive(), f"top_{k}_hit")).alias(f"top_{k}_proposal_recall") for k in (1, 3, 5, 8)])
    med = (exact_quantiles(done.where(positive()), keys, rank, {"median_first_true_anomaly_rank": 0.5})
           .withColumn("median_first_true_anomaly_rank", r6("median_first_true_anomaly_rank")))
    return base.join(med, keys, "left")


def outcome_summary(df: DataFrame) -> DataFrame:
    done = df.where((F.col("run_status") == "completed") & F.col("image_outcome").isNotNull())
    return done.groupBy("image_outcome", "method").agg(
        F.count_distinct("image_id").alias("images"), r6(F.avg("proposal_precision")).alias("precision"),
        r6(_mean_when(positive(), "proposal_recall")).alias("recall"), r6(F.avg("false_positive_proposals")).alias("false_proposals"),
        F.sum((F.col("final_proposals") == 0).cast("bigint")).alias("zero_proposal_images"))


def category_matrix(df: DataFrame, methods: Sequence[str] = METHODS) -> DataFrame:
    done = df.where(F.col("run_status") == "completed")
    out = done.groupBy(F.coalesce("anomaly_type", F.lit("unclassified")).alias("category")).pivot("method", list(methods)).agg(
        r6(F.avg("proposal_precision")))
    return out.select("category", *[F.col(f"`{m}`").alias(m.replace(" ", "_").replace("-", "_")) for m in methods])


def mean_table(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Per-key means of every numeric column."""
    return df.groupBy(key).agg(*[r6(F.avg(F.col(c).cast("double"))).alias(c) for c in columns])


# ---- strict pairing -----------------------------------------------------------------------
def pairing_faults(df: DataFrame) -> DataFrame:
    """Counts behind every strict-pairing rule; all must be clear for `paired_advanced`."""
    keys = [*PAIR_KEYS, "method"]
    scope_cols = [c for c in ("experiment_id", "experiment_version", "dataset_id", "dataset_version", "dataset_split") if c in df.columns]
    dup = df.groupBy(*keys).count().agg(F.coalesce(F.sum(F.when(F.col("count") > 1, F.col("count"))), F.lit(0)).alias("duplicate_rows"))
    adv = df.where(F.col("method").isin(FUSED, CONTEXTUAL) & (F.col("run_status") == "completed"))
    # distinct values of a scope column are counted through a distinct of the few scope rows
    scopes = adv.select(*scope_cols).distinct().agg(*[F.count_distinct(c).alias(f"distinct_{c}") for c in scope_cols])
    meta = ["image_filename", "anomaly_type", "image_outcome"]
    sides = adv.groupBy(*PAIR_KEYS).agg(
        F.max((F.col("method") == FUSED).cast("int")).alias("f"), F.max((F.col("method") == CONTEXTUAL).cast("int")).alias("c"),
        *[(F.min(F.coalesce(m, F.lit("\0"))) != F.max(F.coalesce(m, F.lit("\0")))).alias(m) for m in meta])
    match = sides.agg(
        F.coalesce(F.sum(F.when((F.col("f") == 1) & (F.col("c") == 0), 1)), F.lit(0)).alias("fused_only"),
        F.coalesce(F.sum(F.when((F.col("f") == 0) & (F.col("c") == 1), 1)), F.lit(0)).alias("contextual_only"),
        *[F.coalesce(F.sum(F.col(m).cast("bigint")), F.lit(0)).alias(f"disagree_{m}") for m in meta])
    return dup.crossJoin(F.broadcast(scopes)).crossJoin(F.broadcast(match))  # three one-row tables


def require_pairable(df: DataFrame) -> None:
    row = pairing_faults(df).first()
    if row["duplicate_rows"]:
        raise PairingError("duplicate experiment/version/image/method rows")
    for c in row.asDict():
        if c.startswith("distinct_") and row[c] != 1:
            raise PairingError(f"strict pairing needs one {c.removeprefix('distinct_')}")
        if c.startswith("disagree_") and row[c]:
            raise PairingError(f"paired rows disagree on {c.removeprefix('disagree_')}")
    if row["fused_only"] or row["contextual_only"]:
        raise PairingError(f"image mismatch: fused-only={row['fused_only']}, contextual-only={row['contextual_only']}")


def metric_outcome(fused: Column, contextual: Column, lower_better: bool = False, eps: float = 1e-9) -> Column:
    d = contextual.cast("double") - fused.cast("double")
    better = d < 0 if lower_better else d > 0
    return (F.when(d.isNull(), "incomparable").when(F.abs(d) <= eps, "equal")
            .when(better, "contextual better").otherwise("fused better"))


def _label(positive_row: Column) -> tuple[Column, Column]:
    o = lambda m: F.col(f"{m}_outcome")
    detect = F.when(positive_row, F.array(o("proposal_precision"), o("proposal_recall"))).otherwise(F.array().cast("array<string>"))
    primary = F.filter(F.concat(detect, F.array(o("false_positive_proposals"))), lambda v: v != "incomparable")
    local = F.when(positive_row, F.array(o("mean_iou"), o("best_iou"))).otherwise(F.array().cast("array<string>"))
    has = F.array_contains
    ctx, fus = has(primary, "contextual better"), has(primary, "fused better")
    lctx, lfus = has(local, "contextual better"), has(local, "fused better")
    none = F.size(primary) == 0
    # Labels and reasons of a comparison.
    undefined = "incomparable because metric is undefined"
    label = (F.when(none, undefined).when(ctx & ~fus, "contextual better").when(fus & ~ctx, "fused better")
             .when(ctx & fus, undefined).otherwise("equal"))
    equal = "Primary detection and false-alarm metrics are equal. "
    reason = (F.when(none, "No comparable detection or false-alarm metric.")
              .when(ctx & ~fus, "Detection and/or false-alarm metric improved without a primary-metric loss.")
              .when(fus & ~ctx, "Detection and/or false-alarm metric favoured fused without a primary-metric loss.")
              .when(ctx & fus, "Primary metrics disagree; no global superiority claim.")
              .when(lctx & ~lfus, equal + "Contextual localisation IoU is higher, reported separately.")
              .when(lfus & ~lctx, equal + "Fused localisation IoU is higher, reported separately.")
              .otherwise(equal + "Localisation is also equal or undefined."))
    return label, reason


def paired_advanced(df: DataFrame, check: bool = True, complete: bool = False) -> DataFrame:
    """One row per image with both methods' metrics, differences and outcomes.

    The pair is built by one grouped pass over the two rows of each image, not by a self-join. ``complete``
    leaves out images that only one method finished, in the same pass.
    """
    if check:
        require_pairable(df)
    data = df.where(F.col("method").isin(FUSED, CONTEXTUAL) & (F.col("run_status") == "completed"))
    side = lambda m, c: F.max(F.when(F.col("method") == m, F.col(c).cast("double")))
    g = data.groupBy(*PAIR_KEYS).agg(
        *[F.max(c).alias(c) for c in ("image_filename", "anomaly_type", "image_outcome")],
        *[side(FUSED, m).alias(f"fused_{m}") for m in PAIR_METRICS], *[side(CONTEXTUAL, m).alias(f"contextual_{m}") for m in PAIR_METRICS],
        *([(F.min("method") != F.max("method")).alias("__both")] if complete else []))
    if complete:
        g = g.where("__both").drop("__both").dropna(subset=PAIR_KEYS)
    g = g.select("*", *[(F.col(f"contextual_{m}") - F.col(f"fused_{m}")).alias(f"difference_{m}") for m in PAIR_METRICS],
                 *[metric_outcome(F.col(f"fused_{m}"), F.col(f"contextual_{m}"), m in LOWER_BETTER).alias(f"{m}_outcome")
                   for m in OUTCOME_METRICS])
    label, reason = _label(positive())
    return g.withColumn("outcome_label", label).withColumn("outcome_reason", reason)


def gallery_bucket() -> Column:
    o = lambda m: F.col(f"{m}_outcome")
    differs = lambda m: ~o(m).isin("equal", "incomparable")
    return (F.when(F.col("outcome_label").startswith("incomparable"), "incomparable/undefined")
            .when(differs("proposal_precision") | differs("proposal_recall"), "detection disagreement")
            .when(differs("false_positive_proposals"), "false-positive disagreement")
            .when(o("mean_iou") == "contextual better", "contextual localisation better")
            .when(o("mean_iou") == "fused better", "fused localisation better").otherwise("equal results"))


def win_tie_loss(paired: DataFrame, category: str | None = None, outcome: str | None = None) -> DataFrame:
    if category:
        paired = paired.where(F.col("anomaly_type") == category)
    if outcome:
        paired = paired.where(F.col("image_outcome") == outcome)
    n = lambda v: F.count(F.when(F.col("outcome_label") == v, 1))
    return paired.agg(n("contextual better").alias("contextual_wins"), n("fused better").alias("fused_wins"),
                      n("equal").alias("ties"), n("incomparable because metric is undefined").alias("incomparable"),
                      F.count("*").alias("images"))


def interpretation(paired: DataFrame) -> DataFrame:
    n = lambda cond: F.count(F.when(cond, 1))
    changed = (F.col("proposal_precision_outcome") != "equal") | (F.col("proposal_recall_outcome") != "equal")
    c = paired.agg(n(clean() & (F.col("difference_false_positive_proposals") < 0)).alias("suppressed"),
                   n(positive() & (F.col("difference_mean_iou") > 0)).alias("localised"),
                   n(F.col("outcome_label") == "equal").alias("ties"), n(positive() & changed).alias("detection_changed"),
                   n(positive()).alias("anomaly_images"), n(clean()).alias("clean_images"))
    # The two sentences of an interpretation.
    none = F.format_string("No measurable improvement was observed under the current benchmark; primary outcomes were equal on %d images.", "ties")
    some = F.format_string(
        "Contextual refinement improved localisation IoU on %d of %d eligible anomaly images and false-alarm suppression on %d of %d clean "
        "images. Precision or recall differed on %d anomaly images; localisation alone is not treated as global superiority.",
        "localised", "anomaly_images", "suppressed", "clean_images", "detection_changed")
    return c.withColumn("sentence", F.when((F.col("suppressed") == 0) & (F.col("localised") == 0), none).otherwise(some))


def bootstrap_audit(paired: DataFrame, metric: str) -> DataFrame:
    """Every pair with whether the bootstrap may use it and why not (the key list stays a table)."""
    ok = F.col(f"difference_{metric}").isNotNull()
    if metric in {"proposal_recall", "mean_iou", "best_iou"}:
        ok = ok & positive()
    return paired.select(*PAIR_KEYS, ok.alias("eligible"),
                         F.when(ok, "None").otherwise("Undefined metric or ineligible clean image").alias("exclusion_reason"))


DRAW_MODULUS = 2147483647
#: a draw at or above the k-th step makes a row count more than k times: the Poisson law of mean one
POISSON_STEPS = tuple(int(DRAW_MODULUS * sum(math.exp(-1) / math.factorial(i) for i in range(k + 1))) for k in range(10))


def draws(b: np.ndarray, u: np.ndarray, seed: int) -> np.ndarray:
    """How often row u counts in replicate b: congruential steps that stay below 2^63, then Poisson."""
    m = DRAW_MODULUS
    x = (u % m * 16807 + u // m * 40692 + b * 48271 + seed * 69621 + 1) % m
    x = (x * 48271 + 11) % m
    x = (x * (x % 65521 + 7) + 13) % m
    x = (x * 69621 + b + 17) % m
    return np.searchsorted(np.array(POISSON_STEPS), x, side="right")


def bootstrap_means(rows: DataFrame, samples: int, seed: int) -> DataFrame:
    """Mean of every bootstrap replicate of (v, u) rows, each counting as often as the Poisson draw of its number ``u`` says.

    A task keeps one sum and one count a replicate and adds its rows up as matrices of bounded
    size, so no draw is ever a row; what is exchanged is ``samples`` rows a task.
    """
    def add(batches):
        b = np.arange(samples, dtype=np.int64)[:, None]
        total, times = np.zeros(samples), np.zeros(samples, np.int64)
        for batch in batches:
            v, u = batch.column("v").to_numpy(), batch.column("u").to_numpy()
            for i in range(0, len(v), 1000):
                w = draws(b, u[None, i:i + 1000], seed)
                total += w @ v[i:i + 1000]
                times += w.sum(axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(b.ravel()), pa.array(total), pa.array(times)], ["b", "s", "w"])

    parts = rows.mapInArrow(add, "b long, s double, w long")
    return parts.groupBy("b").agg(F.sum("s").alias("s"), F.sum("w").alias("w")).where("w > 0").select("b", (F.col("s") / F.col("w")).alias("m"))


def bootstrap_ci(df: DataFrame, value: str, samples: int = 1000, seed: int = 42, confidence: float = 0.95) -> DataFrame:
    """Percentile interval of the resampled mean; both ends null below two values. Rows are numbered in order of value."""
    a = (1 - confidence) / 2
    vals = checkpointed(df.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("v")))  # one number a row, read twice
    rows = checkpointed(ranked(vals, [], [("v", True)], "pos").select("v", (F.col("pos") - 1).alias("u")))
    means = bootstrap_means(rows, samples, seed)
    q = means.agg(F.percentile("m", F.lit(a)).alias("ci_low"), F.percentile("m", F.lit(1 - a)).alias("ci_high"))  # ``samples`` rows
    n = rows.agg(F.count("v").alias("n"))
    return n.join(q, F.lit(True), "left").select(
        "n", *[r6(F.when(F.col("n") >= 2, F.col(c))).alias(c) for c in ("ci_low", "ci_high")])


# ---- audits -------------------------------------------------------------------------------
def scope_audit(df: DataFrame) -> DataFrame:
    """The sixteen audit fields as one row; maps hold methods and categories only."""
    per = df.groupBy("image_id").agg(
        F.max("image_outcome").alias("o"), F.max("anomaly_type").alias("a"),
        F.max((F.col("method") == FUSED).cast("int")).alias("f"), F.max((F.col("method") == CONTEXTUAL).cast("int")).alias("c"))
    n = lambda cond: F.count(F.when(cond, 1))
    img = per.agg(F.count("*").alias("unique_images"), n(F.col("o") == "anomaly_present").alias("anomaly_present_images"),
                  n(F.col("o") == "no_anomaly").alias("clean_no_anomaly_images"), n((F.col("f") == 1) & (F.col("c") == 1)).alias("paired_image_count"),
                  n((F.col("f") == 1) & (F.col("c") == 0)).alias("fused_only_image_count"),
                  n((F.col("f") == 0) & (F.col("c") == 1)).alias("contextual_only_image_count"),
                  n(F.col("f") != F.col("c")).alias("unmatched_advanced_method_rows"))
    dup = df.groupBy(*PAIR_KEYS, "method").count().agg(
        F.coalesce(F.sum(F.when(F.col("count") > 1, F.col("count"))), F.lit(0)).cast("bigint").alias("duplicate_image_method_rows"))
    ids = df.select("experiment_id", "experiment_version").distinct().agg(
        F.when(F.count_distinct("experiment_id") == 1, F.max("experiment_id")).otherwise("multiple").alias("selected_experiment_id"),
        F.when(F.count_distinct("experiment_version") == 1, F.max("experiment_version").cast("string")).otherwise("multiple").alias("selected_experiment_version"))
    rows = df.agg(F.count("*").alias("source_result_rows"), n(F.col("method") == FUSED).alias("fused_rows"),
                  n(F.col("method") == CONTEXTUAL).alias("contextual_rows"), F.count_distinct("method").alias("unique_methods"))
    as_text = lambda d, k, name: d.groupBy(k).count().agg(
        F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", F.col(k), F.col("count")))), ";").alias(name))
    out = img
    for part in (dup, ids, rows, as_text(df, "method", "rows_per_method"), as_text(per.where("a is not null"), "a", "category_counts")):
        out = out.crossJoin(F.broadcast(part))  # one-row tables
    return out


def consistency_check(scope: DataFrame, paired: DataFrame) -> DataFrame:
    left = scope.select("image_id", "anomaly_type").distinct().groupBy("anomaly_type").agg(F.count("*").alias("scope_images"))
    right = paired.groupBy("anomaly_type").agg(F.count("*").alias("paired_images"))
    return left.join(right, "anomaly_type", "full").select(
        "anomaly_type", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("scope_images", "paired_images")]
    ).withColumn("consistent", F.col("scope_images") == F.col("paired_images"))


# ---- ablation -----------------------------------------------------------------------------
# Default weights of the balanced score.
LEADERBOARD_WEIGHTS = {"precision": 0.25, "recall": 0.25, "top_1": 0.2, "iou": 0.2, "false_proposals": 0.1}


def ablation_leaderboard(results: DataFrame, weights: Mapping[str, float] = LEADERBOARD_WEIGHTS) -> DataFrame:
    s = method_summary(results)
    ious = results.groupBy("method").agg(F.avg("mean_iou").alias("__iou"))
    top = s.agg(F.greatest(F.max("false_proposals_per_image"), F.lit(1.0)).alias("__fp_max"))
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    score = (weights["precision"] * z("proposal_precision") + weights["recall"] * z("proposal_recall")
             + weights["top_1"] * z("top_1_proposal_recall") + weights["iou"] * F.col("__iou")
             + weights["false_proposals"] * (1 - F.col("false_proposals_per_image") / F.col("__fp_max")))
    return (s.join(ious, "method").crossJoin(F.broadcast(top)).withColumn("balanced_score", r6(score))
            .drop("__iou", "__fp_max").orderBy(F.desc("balanced_score")))


def contribution_table(board: DataFrame, baseline: str) -> DataFrame:
    cols = ["proposal_precision", "proposal_recall", "top_1_proposal_recall", "false_proposals_per_image", "processing_time_seconds"]
    b = board.where(F.col("method") == baseline).select(*[F.col(c).alias(f"b_{c}") for c in cols])
    return (board.where(F.col("method") != baseline).crossJoin(F.broadcast(b))  # one configuration's row
            .select(F.col("method").alias("configuration_id"), *[r6(F.col(c) - F.col(f"b_{c}")).alias(f"difference_{c}") for c in cols]))


def comparability(snapshots: DataFrame, allow_seed_difference: bool = False) -> DataFrame:
    """One row per guarded setting: how many different values the configurations carry."""
    keys = ["dataset_manifest_hash", "matching_thresholds"] + ([] if allow_seed_difference else ["random_seed"])
    c = snapshots.agg(*[F.count_distinct(F.col(k).cast("string")).alias(k) for k in keys])
    return c.unpivot([], [F.col(k).cast("bigint").alias(k) for k in keys], "setting", "distinct_values").withColumn(
        "comparable", F.col("distinct_values") <= 1)


def paired_effects(df: DataFrame, left: str, right: str, columns: Sequence[str]) -> DataFrame:
    """Histogram of per-image right-minus-left differences for each column."""
    side = lambda m, c: F.max(F.when(F.col("method") == m, F.col(c)))
    g = df.where(F.col("method").isin(left, right)).groupBy("image_id").agg(
        *[(side(right, c) - side(left, c)).alias(c) for c in columns])
    long = g.unpivot(["image_id"], list(columns), "effect", "difference").where(F.col("difference").isNotNull())
    return long.groupBy("effect", "difference").agg(F.count("*").alias("images"))


def require(df: DataFrame, condition: Column, message: str) -> None:
    if any_row(df.where(condition)):
        raise ValueError(message)


