"""Human-review records, review summaries, box evaluation and severity reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..core import r6
from ..functions.exprs import area, severity_label
from .masks import box_overlaps


def largest_components(df: DataFrame, image_area: int, by: Sequence[str], ident: str, keep: int = 12) -> DataFrame:
    """Components of a plausible size, the largest ``keep`` per group."""
    w = Window.partitionBy(*by).orderBy(F.desc("area"), F.asc(ident))
    ok = df.where((F.col("area") >= max(80.0, 0.00025 * image_area)) & (F.col("area") <= 0.35 * image_area))
    return ok.withColumn("pos", F.row_number().over(w).cast("bigint")).where(F.col("pos") <= keep)


def truth_best_box(proposals: DataFrame, truths: DataFrame, methods: DataFrame) -> DataFrame:
    """Best-IoU box of every truth (lowest id on ties) with over- and under-coverage."""
    p = proposals.select("image_id", "method", "proposal_id", "x1", "y1", "x2", "y2")
    t = truths.select("image_id", "truth_id", "x1", "y1", "x2", "y2")
    a = lambda s: area(*[F.col(f"{s}_{c}") for c in ("x1", "y1", "x2", "y2")])
    j = box_overlaps(p, t, ["image_id"])
    iou = F.col("intersection") / (a("l") + a("r") - F.col("intersection"))
    best = (j.select("image_id", F.col("l_method").alias("method"), F.col("r_truth_id").alias("truth_id"), F.col("l_proposal_id").alias("pid"),
                     iou.alias("iou"), F.col("intersection").alias("i"), a("l").alias("pa"))
            .groupBy("image_id", "method", "truth_id").agg(F.max_by(F.struct("iou", "i", "pa"), F.struct(F.col("iou"), -F.col("pid"))).alias("b")))
    ta = F.greatest(area(*[F.col(c) for c in ("x1", "y1", "x2", "y2")]), F.lit(1))
    z = lambda c: F.coalesce(F.col(f"b.{c}"), F.lit(0))
    return (t.crossJoin(F.broadcast(methods)).join(best, ["image_id", "method", "truth_id"], "left")  # a handful of methods
            .select("image_id", "method", "truth_id", F.coalesce("b.iou", F.lit(0.0)).alias("best_iou"),
                    (F.greatest(z("pa") - z("i"), F.lit(0)) / ta).alias("over_coverage"), (F.greatest(ta - z("i"), F.lit(0)) / ta).alias("under_coverage")))


def evaluate_boxes(proposals: DataFrame, truths: DataFrame, pairs: DataFrame, base: DataFrame, methods: DataFrame) -> DataFrame:
    """Per image and method: recall at three IoU levels, mean best IoU, proposals that hit nothing."""
    per_truth = pairs.groupBy("image_id", "method", "truth_id").agg(F.max("mask_iou").alias("b"))
    hit = per_truth.groupBy("image_id", "method").agg(
        *[F.sum((F.col("b") >= t).cast("bigint")).alias(n) for n, t in (("r10", 0.1), ("r25", 0.25), ("r50", 0.5))], F.sum("b").alias("sb"))
    good = (pairs.groupBy("image_id", "method", "proposal_id").agg(F.max("mask_iou").alias("b")).where("b >= 0.25")
            .groupBy("image_id", "method").agg(F.count("*").alias("good")))
    j = base.join(hit, ["image_id", "method"], "left").join(good, ["image_id", "method"], "left")
    n = F.greatest("truth_count", F.lit(1))
    share = lambda c: F.round(F.coalesce(F.col(c), F.lit(0)) / n, 6)
    return j.select("image_id", "method", share("r10").alias("proposal_recall_iou_010"), share("r25").alias("proposal_recall_iou_025"),
                    share("r50").alias("proposal_recall_iou_050"), share("sb").alias("average_best_iou"),
                    (F.col("proposal_count") - F.coalesce("good", F.lit(0))).alias("false_proposals"))


# ---- review summary -----------------------------------------------------------------------
FINAL = "Final Research Evaluation"
DEVELOPMENT = "Development / Test"
RECORD_KEY = ["experiment_id", "experiment_version", "reviewer_id", "image_filename", "method"]


def scope_filter(records: DataFrame, include_development: bool = False, development_only: bool = False) -> DataFrame:
    if development_only:
        return records.where(F.col("experiment_status") == DEVELOPMENT)
    return records if include_development else records.where(F.col("experiment_status") == FINAL)


def top_k_flags(rank: Column, outcome: Column, truth: Column, override: Column) -> dict[str, Column]:
    """Hit flags; null when the image is not eligible and also when nothing was hit."""
    ok = (outcome == "anomaly present") & ((truth != "unknown") | override) & rank.isNotNull()
    return {f"top_{k}": F.when(ok, rank <= k) for k in (1, 3, 5, 8)}


def review_summary(records: DataFrame) -> DataFrame:
    """Seventeen per-method figures; one without a denominator stays null."""
    rank, outcome, truth = F.col("first_accepted_rank"), F.col("image_outcome"), F.col("ground_truth_status")
    reviewed = F.col("review_status").isin("fully_reviewed", "partially_reviewed")
    ok = (outcome == "anomaly present") & (truth.isin("verified ground truth", "reviewer-estimated") | F.col("recall_override")) & rank.isNotNull()
    flags = top_k_flags(rank, outcome, truth, F.col("recall_override"))
    rows = records.select("*", *[c.alias(n) for n, c in flags.items()], reviewed.alias("rv"), ok.alias("ok"))
    n = lambda c: F.count(F.when(c, 1))
    mean = lambda c: r6(F.avg(F.when(F.col("rv"), F.col(c).cast("double"))))
    acc, rej = F.sum(F.when(F.col("rv"), F.col("accepted"))), F.sum(F.when(F.col("rv"), F.col("rejected")))
    return rows.groupBy("method").agg(
        n(F.col("ok")).alias("eligible_images"), n(outcome == "anomaly present").alias("anomaly_present_images"), n(F.col("rv")).alias("reviewed_images"),
        n(F.col("review_status") == "not_reviewed").alias("not_reviewed_images"),
        *[r6(F.avg(F.when(F.col("ok"), F.col(f"top_{k}").cast("double")))).alias(f"top_{k}_proposal_recall") for k in (1, 3, 5, 8)],
        mean("accepted").alias("mean_accepted_proposals_per_image"), mean("rejected").alias("mean_rejected_proposals_per_image"),
        mean("uncertain").alias("mean_uncertain_proposals_per_image"), r6(F.avg("not_reviewed")).alias("mean_not_reviewed_proposals_per_image"),
        mean("rejected").alias("mean_false_proposals_per_image"), r6(F.when(acc + rej > 0, acc / (acc + rej))).alias("annotation_acceptance_rate"),
        mean("review_duration_seconds").alias("mean_review_time_seconds"),
        r6(F.avg(F.when(F.col("ok"), rank))).alias("mean_proposals_reviewed_before_first_useful"))


def first_hit_rank(proposals: DataFrame, accepted: DataFrame, threshold: float = 0.10) -> DataFrame:
    """Smallest proposal rank whose box reaches the IoU with any accepted box, per (image, method)."""
    a = lambda s: area(*[F.col(f"{s}_{c}") for c in ("x1", "y1", "x2", "y2")])
    j = box_overlaps(proposals.select("image_id", "method", "rank", "x1", "y1", "x2", "y2"), accepted.select("image_id", "x1", "y1", "x2", "y2"), ["image_id"])
    hit = j.where(F.col("intersection") / F.greatest(a("l") + a("r") - F.col("intersection"), F.lit(1)) >= threshold)
    return hit.groupBy("image_id", F.col("l_method").alias("method")).agg(F.min("l_rank").alias("first_rank"))


def build_records(base: DataFrame, decisions: DataFrame, first_ranks: DataFrame, reviewed_method: str) -> DataFrame:
    """One record per (image, method): only the reviewed method carries counts, status and duration.

    ``base``: image_id, method, final_proposals, image_outcome, ground_truth_status, duration.
    ``decisions``: image_id, decision, rank - the reviewer's verdicts on the reviewed method.
    """
    n = lambda v: F.sum((F.col("decision") == v).cast("bigint"))
    d = decisions.groupBy("image_id").agg(n("accept").alias("a"), n("reject").alias("r"), n("uncertain").alias("u"), F.count("*").alias("seen"),
                                          F.min(F.when(F.col("decision") == "accept", F.col("rank"))).alias("ar"))
    j = base.join(d, "image_id", "left").join(first_ranks, ["image_id", "method"], "left")
    own, seen = F.col("method") == reviewed_method, F.coalesce("seen", F.lit(0))
    z = lambda c: F.when(own, F.coalesce(F.col(c), F.lit(0)))
    present = F.col("image_outcome") == "anomaly present"
    rank = F.when(present, F.when(own, F.col("ar")).otherwise(F.col("first_rank")))
    out = j.select("image_id", "method", "final_proposals", z("a").alias("accepted"), z("r").alias("rejected"), z("u").alias("uncertain"),
                   F.when(own, F.greatest(F.col("final_proposals") - seen, F.lit(0))).otherwise(F.col("final_proposals")).alias("not_reviewed"),
                   F.when(~own | (seen == 0), "not_reviewed").when(seen < F.col("final_proposals"), "partially_reviewed").otherwise("fully_reviewed").alias("review_status"),
                   F.when(own, F.col("duration")).alias("review_duration_seconds"), rank.alias("first_accepted_rank"), "image_outcome", "ground_truth_status")
    flags = top_k_flags(F.col("first_accepted_rank"), F.col("image_outcome"), F.col("ground_truth_status"), F.lit(False))
    return out.select("*", *[c.alias(f"true_anomaly_found_{n_}") for n_, c in flags.items()])


# ---- severity -----------------------------------------------------------------------------
# Recommended actions per defect type.
ACTIONS = {
    "corrosion": ["Surface cleaning and corrosion mapping", "Ultrasonic thickness measurement", "Recoating assessment"],
    "crack": ["Close visual reinspection", "Dye penetrant testing", "Magnetic particle testing", "Structural repair assessment"],
    "weld_defect": ["Weld inspection", "Magnetic particle testing", "Ultrasonic testing of weld zone"],
    "coating_damage": ["Surface cleaning and recoating", "Check for under-film corrosion"],
    "dent": ["Dimensional survey", "Structural repair assessment"],
    "scratch": ["Visual reinspection", "Touch-up coating or surface protection"],
    "deformation": ["Structural alignment check", "Repair or reinforcement assessment"],
    "pitting": ["Pit depth measurement", "Ultrasonic thickness measurement", "Corrosion protection review"],
    "surface_anomaly": ["Visual reinspection", "Surface cleaning before re-evaluation"],
}
# The closing recommendations.
ESCALATE = "Restrict service or escalate to certified marine/structural inspector before continued operation."
FOLLOW_UP = "Schedule follow-up inspection and compare with maintenance history."
MONITOR = "Document condition and monitor during the next planned inspection interval."


def classify_region(aspect: Column, fill: Column, relative_area: Column) -> Column:
    return (F.when((aspect > 5.5) & (fill < 0.45), "crack").when((relative_area > 0.035) & (fill > 0.35), "corrosion")
            .when(fill < 0.22, "pitting").when(aspect > 3.0, "scratch").otherwise("surface_anomaly"))


def region_confidence(aspect: Column, relative_area: Column) -> Column:
    return F.least(F.lit(0.85), 0.35 + aspect / 12.0 + F.least(relative_area, F.lit(0.2)))


def image_severity(defects: DataFrame, risk: dict[str, float], default: float = 0.4) -> DataFrame:
    """Per image: worst defect plus count and spread, capped at 100, with label and drivers."""
    weight = F.lit(default)
    for kind, w in risk.items():
        weight = F.when(F.col("defect_type") == kind, w).otherwise(weight)
    one = F.least(F.col("relative_area") * 420, F.lit(35.0)) + F.col("confidence") * 25 + weight * 40
    g = defects.withColumn("w", weight).groupBy("image_id").agg(
        F.max(one).alias("worst"), F.count("*").alias("defects"), F.least(F.sum("relative_area"), F.lit(1.0)).alias("spread"),
        F.sum((F.col("w") >= 0.72).cast("bigint")).alias("significant_defects"))
    score = F.least(F.lit(100.0), F.col("worst") + F.least(F.col("defects") * 4, F.lit(18)) + F.least(F.col("spread") * 120, F.lit(22.0)))
    wide, many = F.round("spread", 9) > 0.05, F.col("defects") >= 4
    drivers = F.array_join(F.filter(F.array(
        F.when(F.col("significant_defects") > 0, "structurally significant defects"), F.when(wide, "non-trivial affected area"), F.when(many, "multiple regions"),
        F.when((F.col("significant_defects") == 0) & ~wide & ~many, "confidence and area")), lambda v: v.isNotNull()), "; ")
    return g.withColumn("s", F.round(score, 6)).select("image_id", "defects", F.round("s", 1).alias("score"), severity_label(F.col("s")).alias("label"), drivers.alias("drivers"))


def defect_mix(defects: DataFrame, severity: DataFrame) -> DataFrame:
    """Three commonest types (first seen wins a tie) and the distinct actions in first-seen order.

    Types are counted before anything is collected, so an image carries at most one entry per type.
    """
    types = defects.groupBy("image_id", "defect_type").agg(F.count("*").alias("n"), F.min("box_id").alias("first"))
    plan = F.create_map(*[x for k, v in ACTIONS.items() for x in (F.lit(k), F.array(*[F.lit(a) for a in v]))])
    acts = F.coalesce(F.element_at(plan, F.col("defect_type")), F.array(*[F.lit(a) for a in ACTIONS["surface_anomaly"]]))
    g = types.withColumn("acts", acts).groupBy("image_id").agg(
        F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "first", "defect_type"))).alias("byn"),
        F.array_sort(F.collect_list(F.struct("first", "acts"))).alias("byf"))
    lead = F.array_join(F.transform(F.slice("byn", 1, 3), lambda s: F.concat_ws(" ", (-s["m"]).cast("string"), s["defect_type"])), ", ")
    todo = F.array_distinct(F.flatten(F.transform("byf", lambda s: s["acts"])))
    last = F.when(F.col("label").isin("High", "Critical"), ESCALATE).when(F.col("label") == "Medium", FOLLOW_UP).otherwise(MONITOR)
    return g.join(severity.select("image_id", "label"), "image_id").select(
        "image_id", lead.alias("leading_types"), F.array_join(F.concat(todo, F.array(last)), " | ").alias("actions"))
