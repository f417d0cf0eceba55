"""Result analysis queries: filters, summaries, pairing, ablation."""

from pyspark.sql import functions as F

from ..core import r6
from ..operators import analysis as an
from ..scale import ranked
from ..sources.tables import METHODS
from .registry import query

FUSED, CTX = METHODS[2], METHODS[3]
KEY = ["result_id", "image_id", "method"]
POS = "image_outcome='anomaly_present'"
CLEAN = "image_outcome='no_anomaly'"


@query("j01_enrich_results", "scope", """SELECT result_id, image_id, method, dataset_id, dataset_version, dataset_split, anomaly_type, image_outcome,
  clean_artefact_type FROM scope""")
def _(t):
    return t.scope.select(*KEY, "dataset_id", "dataset_version", "dataset_split", "anomaly_type", "image_outcome", "clean_artefact_type")


@query("p01_search_rows", "scope", """SELECT result_id FROM scope WHERE contains(lower(concat_ws(' ', experiment_id, plan_id, coalesce(dataset_id,''),
  coalesce(dataset_version,''), coalesce(dataset_split,''), image_filename, CAST(image_id AS VARCHAR), coalesce(anomaly_type,''),
  coalesce(clean_artefact_type,''), coalesce(image_outcome,''), method, review_status, run_status)), 'urgent no_anomaly fixed')""")
def _(t):
    return an.search_rows(t.scope, " URGENT no_anomaly fixed ").select("result_id")


@query("p02_isin_filters", "scope", """SELECT result_id FROM scope WHERE method IN ('multi-scale fused method','refined contextual method')
  AND anomaly_type IN ('1-URGENT','5-LOW') AND (first_true_anomaly_proposal_rank IS NULL OR first_true_anomaly_proposal_rank=2)""")
def _(t):
    return an.membership(t.scope, {"method": [FUSED, CTX], "anomaly_type": ["1-URGENT", "5-LOW"], "plan_id": [],
                                   "first_true_anomaly_proposal_rank": ["N/A", 2]}).select("result_id")


@query("p03_numeric_ranges", "scope", """SELECT result_id FROM scope WHERE proposal_recall>=0.3 AND proposal_recall<=0.7 AND processing_time_seconds<=0.05""")
def _(t):
    return an.numeric_ranges(t.scope, {"proposal_recall": (0.3, 0.7), "processing_time_seconds": (None, 0.05)}).select("result_id")


QUICK_SQL = {
    "Current selected experiment": "experiment_id='EXP-1'", "SYN-BALANCED-001": "experiment_id='SYN-BALANCED-001'",
    "Anomaly images only": POS, "Clean/no-anomaly images only": CLEAN, "Thin cracks only": "anomaly_type='thin_crack'",
    "Pitting clusters only": "anomaly_type='pitting_cluster'", "Specular highlights only": "anomaly_type='specular_highlights'",
    "Successful runs only": "run_status='completed'", "Failed runs only": "run_status='failed'",
    "True anomaly found": "first_true_anomaly_proposal_rank IS NOT NULL",
    "True anomaly missed": POS + " AND first_true_anomaly_proposal_rank IS NULL", "False-positive cases": "false_positive_proposals>0",
    "Zero-proposal clean images": CLEAN + " AND final_proposals=0", "Refined contextual only": f"method='{CTX}'",
    "Multi-scale fused only": f"method='{FUSED}'", "Compare advanced methods": f"method IN ('{FUSED}','{CTX}')",
    "Compare all methods for selected image": "image_filename='img_7'",
}


@query("p04_quick_filters", "scope", " UNION ALL ".join(
    f"SELECT '{k}' AS filter, count(*) FILTER (WHERE {v}) AS n FROM scope" for k, v in QUICK_SQL.items()))
def _(t):
    p = an.quick_predicates("EXP-1", "img_7")
    one = t.scope.agg(*[F.count(F.when(c, 1)).alias(k) for k, c in p.items()])
    return one.unpivot([], [F.col(f"`{k}`") for k in p], "filter", "n")


@query("p05_analysis_scope", "scope", """SELECT result_id FROM scope WHERE experiment_id='EXP-1' AND experiment_version=1 AND dataset_id='d1' AND dataset_split='test'""")
def _(t):
    return an.analysis_scope(t.scope, "EXP-1", 1, "d1", None, "test").select("result_id")


@query("p06_column_views", "scope", "SELECT " + ", ".join(an.VIEWS["essential"]) + " FROM scope")
def _(t):
    return an.column_view(t.scope, "essential")


@query("w15_result_sort", "scope", """SELECT result_id, row_number() OVER (ORDER BY proposal_recall DESC NULLS LAST, result_id DESC) AS pos FROM scope""")
def _(t):
    rows = t.scope.select("result_id", "proposal_recall")
    n = rows.agg(F.count("*").alias("n"))  # one row
    up = ranked(rows, [], [("proposal_recall", True), ("result_id", True)], "up")  # places from the end
    return up.crossJoin(F.broadcast(n)).select("result_id", (F.col("n") + 1 - F.col("up")).alias("pos"))


_SUM = """round(avg(CASE WHEN proposal_recall IS NOT NULL THEN CAST(top_1_hit AS INT) END),6) AS top_1_proposal_recall,
  round(avg(CASE WHEN proposal_recall IS NOT NULL THEN CAST(top_3_hit AS INT) END),6) AS top_3_proposal_recall,
  round(avg(CASE WHEN proposal_recall IS NOT NULL THEN CAST(top_5_hit AS INT) END),6) AS top_5_proposal_recall,
  round(avg(CASE WHEN proposal_recall IS NOT NULL THEN CAST(top_8_hit AS INT) END),6) AS top_8_proposal_recall,
  round(avg(proposal_precision),6) AS proposal_precision, round(avg(proposal_recall),6) AS proposal_recall,
  round(avg(false_positive_proposals),6) AS false_proposals_per_image, round(avg(processing_time_seconds),6) AS processing_time_seconds"""
SUMMARY = f", summary AS (SELECT method, count(*) AS images, {_SUM} FROM results WHERE run_status='completed' GROUP BY method)"


@query("a01_method_summary", "results", SUMMARY + "SELECT * FROM summary")
def _(t):
    return an.method_summary(t.results)


@query("a02_category_summary", "scope", f"""SELECT anomaly_type AS category, method, count(DISTINCT image_id) AS images,
  count(DISTINCT CASE WHEN {POS} THEN image_id END) AS anomaly_present_images, count(DISTINCT CASE WHEN {CLEAN} THEN image_id END) AS clean_images,
  round(avg(proposal_precision),6) AS proposal_precision, round(stddev_samp(proposal_precision),6) AS proposal_precision_std,
  round(avg(proposal_recall) FILTER ({POS}),6) AS proposal_recall, round(stddev_samp(proposal_recall) FILTER ({POS}),6) AS proposal_recall_std,
  round(avg(mean_iou) FILTER ({POS}),6) AS mean_iou, round(avg(best_iou) FILTER ({POS}),6) AS best_iou,
  round(avg(false_positive_proposals),6) AS mean_false_proposals_per_image,
  CAST(coalesce(sum(false_negative_anomalies) FILTER ({POS}),0) AS BIGINT) AS false_negative_count,
  round(avg(first_true_anomaly_proposal_rank) FILTER ({POS}),6) AS mean_first_true_anomaly_rank,
  round(median(first_true_anomaly_proposal_rank) FILTER ({POS}),6) AS median_first_true_anomaly_rank,
  round(avg(processing_time_seconds),6) AS mean_processing_time, round(stddev_samp(processing_time_seconds),6) AS processing_time_std,
  count(*) FILTER ({CLEAN} AND final_proposals=0) AS correct_zero_proposal_clean_images,
  {", ".join(f"round(avg(CAST(top_{k}_hit AS INT)) FILTER ({POS}),6) AS top_{k}_proposal_recall" for k in (1, 3, 5, 8))}
  FROM scope WHERE run_status='completed' GROUP BY anomaly_type, method""")
def _(t):
    return an.category_summary(t.scope)


@query("a03_outcome_summary", "scope", f"""SELECT image_outcome, method, count(DISTINCT image_id) AS images, round(avg(proposal_precision),6) AS precision,
  round(avg(proposal_recall) FILTER ({POS}),6) AS recall, round(avg(false_positive_proposals),6) AS false_proposals,
  count(*) FILTER (final_proposals=0) AS zero_proposal_images FROM scope WHERE run_status='completed' GROUP BY 1,2""")
def _(t):
    return an.outcome_summary(t.scope)


@query("a04_category_matrix", "scope", "SELECT anomaly_type AS category, " + ", ".join(
    f"round(avg(proposal_precision) FILTER (method='{m}'),6) AS {m.replace(' ', '_').replace('-', '_')}" for m in METHODS)
    + " FROM scope WHERE run_status='completed' GROUP BY 1")
def _(t):
    return an.category_matrix(t.scope)


_NUM = ["final_proposals", "true_positive_proposals", "proposal_precision", "proposal_recall", "mean_iou", "best_iou", "processing_time_seconds"]


@query("a06_evaluation_tables", "results", "SELECT method, " + ", ".join(f"round(avg({c}),6) AS {c}" for c in _NUM) + " FROM results GROUP BY method")
def _(t):
    return an.mean_table(t.results, "method", _NUM)


# ---- pairing ------------------------------------------------------------------------------
def _out(m, lower):
    cmp = "<0" if lower else ">0"
    return (f"CASE WHEN difference_{m} IS NULL THEN 'incomparable' WHEN abs(difference_{m})<=1e-9 THEN 'equal' "
            f"WHEN difference_{m}{cmp} THEN 'contextual better' ELSE 'fused better' END AS {m}_outcome")


_side = lambda side, m: f"max(CASE WHEN method='{side}' THEN CAST({m} AS DOUBLE) END)"
PAIRED = f""", both_m AS (SELECT image_id FROM scope WHERE method IN ('{FUSED}','{CTX}') AND run_status='completed' GROUP BY image_id HAVING count(DISTINCT method)=2),
pairable AS (SELECT * FROM scope WHERE method IN ('{FUSED}','{CTX}') AND run_status='completed' AND image_id IN (SELECT image_id FROM both_m)),
p0 AS (SELECT experiment_id, experiment_version, image_id, max(image_filename) AS image_filename, max(anomaly_type) AS anomaly_type, max(image_outcome) AS image_outcome,
  {", ".join(f"{_side(FUSED, m)} AS fused_{m}, {_side(CTX, m)} AS contextual_{m}, {_side(CTX, m)}-{_side(FUSED, m)} AS difference_{m}" for m in an.PAIR_METRICS)}
  FROM pairable GROUP BY 1,2,3),
p1 AS (SELECT *, {", ".join(_out(m, m in an.LOWER_BETTER) for m in an.OUTCOME_METRICS)} FROM p0),
p2 AS (SELECT *, list_filter(CASE WHEN {POS} THEN [proposal_precision_outcome, proposal_recall_outcome, false_positive_proposals_outcome]
    ELSE [false_positive_proposals_outcome] END, lambda x: x<>'incomparable') AS pri,
  CASE WHEN {POS} THEN [mean_iou_outcome, best_iou_outcome] ELSE [] END AS loc FROM p1),
p3 AS (SELECT *, list_contains(pri,'contextual better') AS pc, list_contains(pri,'fused better') AS pf,
  list_contains(loc,'contextual better') AS lc, list_contains(loc,'fused better') AS lf FROM p2),
paired AS (SELECT * EXCLUDE (pri, loc, pc, pf, lc, lf),
  CASE WHEN len(pri)=0 OR (pc AND pf) THEN 'incomparable because metric is undefined' WHEN pc THEN 'contextual better' WHEN pf THEN 'fused better' ELSE 'equal' END AS outcome_label,
  CASE WHEN len(pri)=0 THEN 'No comparable detection or false-alarm metric.' WHEN pc AND pf THEN 'Primary metrics disagree; no global superiority claim.'
    WHEN pc THEN 'Detection and/or false-alarm metric improved without a primary-metric loss.'
    WHEN pf THEN 'Detection and/or false-alarm metric favoured fused without a primary-metric loss.'
    WHEN lc AND NOT lf THEN 'Primary detection and false-alarm metrics are equal. Contextual localisation IoU is higher, reported separately.'
    WHEN lf AND NOT lc THEN 'Primary detection and false-alarm metrics are equal. Fused localisation IoU is higher, reported separately.'
    ELSE 'Primary detection and false-alarm metrics are equal. Localisation is also equal or undefined.' END AS outcome_reason FROM p3) """


def paired(t):
    return an.paired_advanced(t.scope, check=False, complete=True)


_PCOLS = ["image_id", "image_filename", "anomaly_type", "image_outcome", "outcome_label", "outcome_reason",
          *[f"{m}_outcome" for m in an.OUTCOME_METRICS]]
_PNUM = [f"{s}_{m}" for m in an.PAIR_METRICS for s in ("fused", "contextual", "difference")]


@query("j18_paired_advanced", "scope", PAIRED + "SELECT " + ", ".join(_PCOLS + [f"round({c},6) AS {c}" for c in _PNUM]) + " FROM paired")
def _(t):
    return paired(t).select(*_PCOLS, *[r6(c).alias(c) for c in _PNUM])


@query("j19_pairing_guards", "scope", f""", adv AS (SELECT * FROM scope WHERE method IN ('{FUSED}','{CTX}') AND run_status='completed'),
 sides AS (SELECT image_id, max(CAST(method='{FUSED}' AS INT)) AS f, max(CAST(method='{CTX}' AS INT)) AS c, count(DISTINCT image_filename)>1 AS mf,
   count(DISTINCT coalesce(anomaly_type,'?'))>1 AS ma, count(DISTINCT coalesce(image_outcome,'?'))>1 AS mo FROM adv GROUP BY experiment_id, experiment_version, image_id)
 SELECT (SELECT CAST(coalesce(sum(n),0) AS BIGINT) FROM (SELECT count(*) AS n FROM scope GROUP BY experiment_id, experiment_version, image_id, method HAVING count(*)>1)) AS duplicate_rows,
  (SELECT count(DISTINCT experiment_id) FROM adv) AS distinct_experiment_id, (SELECT count(DISTINCT experiment_version) FROM adv) AS distinct_experiment_version,
  (SELECT count(DISTINCT dataset_id) FROM adv) AS distinct_dataset_id, (SELECT count(DISTINCT dataset_version) FROM adv) AS distinct_dataset_version,
  (SELECT count(DISTINCT dataset_split) FROM adv) AS distinct_dataset_split,
  count(*) FILTER (f=1 AND c=0) AS fused_only, count(*) FILTER (f=0 AND c=1) AS contextual_only, count(*) FILTER (mf) AS disagree_image_filename,
  count(*) FILTER (ma) AS disagree_anomaly_type, count(*) FILTER (mo) AS disagree_image_outcome FROM sides""")
def _(t):
    return an.pairing_faults(t.scope)


@query("f08_metric_outcome", "scope", PAIRED + "SELECT image_id, " + ", ".join(f"{m}_outcome" for m in an.OUTCOME_METRICS) + " FROM paired")
def _(t):
    return paired(t).select("image_id", *[f"{m}_outcome" for m in an.OUTCOME_METRICS])


@query("f09_paired_label", "scope", PAIRED + "SELECT outcome_label, outcome_reason, count(*) AS n FROM paired GROUP BY 1,2")
def _(t):
    return paired(t).groupBy("outcome_label", "outcome_reason").agg(F.count("*").alias("n"))


@query("f10_gallery_bucket", "scope", PAIRED + """SELECT image_id, CASE WHEN outcome_label LIKE 'incomparable%' THEN 'incomparable/undefined'
  WHEN proposal_precision_outcome NOT IN ('equal','incomparable') OR proposal_recall_outcome NOT IN ('equal','incomparable') THEN 'detection disagreement'
  WHEN false_positive_proposals_outcome NOT IN ('equal','incomparable') THEN 'false-positive disagreement'
  WHEN mean_iou_outcome='contextual better' THEN 'contextual localisation better' WHEN mean_iou_outcome='fused better' THEN 'fused localisation better'
  ELSE 'equal results' END AS gallery FROM paired""")
def _(t):
    return paired(t).select("image_id", an.gallery_bucket().alias("gallery"))


@query("a19_consistency_check", "scope", PAIRED + """SELECT anomaly_type, coalesce(s,0) AS scope_images, coalesce(p,0) AS paired_images, coalesce(s,0)=coalesce(p,0) AS consistent
  FROM (SELECT anomaly_type, count(DISTINCT image_id) AS s FROM scope GROUP BY 1) FULL JOIN (SELECT anomaly_type, count(*) AS p FROM paired GROUP BY 1) USING (anomaly_type)""")
def _(t):
    return an.consistency_check(t.scope, paired(t))


@query("a20_win_tie_loss", "scope", PAIRED + f"""SELECT count(*) FILTER (outcome_label='contextual better') AS contextual_wins, count(*) FILTER (outcome_label='fused better') AS fused_wins,
  count(*) FILTER (outcome_label='equal') AS ties, count(*) FILTER (outcome_label LIKE 'incomparable%') AS incomparable, count(*) AS images
  FROM paired WHERE anomaly_type='2-HIGH' AND {POS}""")
def _(t):
    return an.win_tie_loss(paired(t), "2-HIGH", "anomaly_present")


@query("a21_interpretation_counts", "scope", PAIRED + f""", c AS (SELECT count(*) FILTER ({CLEAN} AND difference_false_positive_proposals<0) AS suppressed,
  count(*) FILTER ({POS} AND difference_mean_iou>0) AS localised, count(*) FILTER (outcome_label='equal') AS ties,
  count(*) FILTER ({POS} AND (proposal_precision_outcome<>'equal' OR proposal_recall_outcome<>'equal')) AS detection_changed,
  count(*) FILTER ({POS}) AS anomaly_images, count(*) FILTER ({CLEAN}) AS clean_images FROM paired)
 SELECT *, CASE WHEN suppressed=0 AND localised=0 THEN 'No measurable improvement was observed under the current benchmark; primary outcomes were equal on '||ties||' images.'
  ELSE 'Contextual refinement improved localisation IoU on '||localised||' of '||anomaly_images||' eligible anomaly images and false-alarm suppression on '||suppressed||' of '||clean_images||' clean images. Precision or recall differed on '||detection_changed||' anomaly images; localisation alone is not treated as global superiority.' END AS sentence FROM c""")
def _(t):
    return an.interpretation(paired(t))


@query("a22_bootstrap_ci", "scope", PAIRED + f""", v AS (SELECT difference_proposal_precision AS v, row_number() OVER (ORDER BY difference_proposal_precision)-1 AS u
   FROM paired WHERE difference_proposal_precision IS NOT NULL), nn AS (SELECT count(*) AS n FROM v),
 d0 AS (SELECT b, v, (u%2147483647*16807+u//2147483647*40692+b*48271+42*69621+1)%2147483647 AS x FROM v, range(1000) r(b)), d1 AS (SELECT b, v, (x*48271+11)%2147483647 AS x FROM d0), d2 AS (SELECT b, v, (x*(x%65521+7)+13)%2147483647 AS x FROM d1),
 d3 AS (SELECT b, v, (x*69621+b+17)%2147483647 AS x FROM d2), d AS (SELECT b, v, {" + ".join(f"CAST(x>={c} AS BIGINT)" for c in an.POISSON_STEPS)} AS w FROM d3),
 m AS (SELECT b, sum(w*v)/sum(w) AS m FROM d GROUP BY b HAVING sum(w)>0)
 SELECT (SELECT n FROM nn) AS n, round(quantile_cont(m, 0.025),6) AS ci_low, round(quantile_cont(m, 0.975),6) AS ci_high FROM m""")
def _(t):
    return an.bootstrap_ci(paired(t), "difference_proposal_precision", samples=1000, seed=42)


@query("a24_bootstrap_audit", "scope", PAIRED + f"""SELECT experiment_id, experiment_version, image_id, difference_mean_iou IS NOT NULL AND {POS} AS eligible,
  CASE WHEN difference_mean_iou IS NOT NULL AND {POS} THEN 'None' ELSE 'Undefined metric or ineligible clean image' END AS exclusion_reason FROM paired""")
def _(t):
    return an.bootstrap_audit(paired(t), "mean_iou")


@query("j25_paired_effects", "scope", f""", g AS (SELECT image_id, max(CASE WHEN method='{CTX}' THEN final_proposals END)-max(CASE WHEN method='{FUSED}' THEN final_proposals END) AS p,
   max(CASE WHEN method='{CTX}' THEN true_positive_proposals END)-max(CASE WHEN method='{FUSED}' THEN true_positive_proposals END) AS q
   FROM scope WHERE method IN ('{FUSED}','{CTX}') GROUP BY image_id)
 SELECT 'final_proposals' AS effect, p AS difference, count(*) AS images FROM g WHERE p IS NOT NULL GROUP BY p
 UNION ALL SELECT 'true_positive_proposals', q, count(*) FROM g WHERE q IS NOT NULL GROUP BY q""")
def _(t):
    return an.paired_effects(t.scope, FUSED, CTX, ["final_proposals", "true_positive_proposals"])


@query("a18_scope_audit", "scope", f""", per AS (SELECT image_id, max(image_outcome) AS o, max(anomaly_type) AS a, max(CAST(method='{FUSED}' AS INT)) AS f, max(CAST(method='{CTX}' AS INT)) AS c FROM scope GROUP BY 1)
 SELECT 'EXP-1' AS selected_experiment_id, '1' AS selected_experiment_version, (SELECT count(*) FROM scope) AS source_result_rows, count(*) AS unique_images,
  (SELECT count(DISTINCT method) FROM scope) AS unique_methods,
  (SELECT string_agg(method||'='||n, ';' ORDER BY method||'='||n) FROM (SELECT method, count(*) AS n FROM scope GROUP BY 1)) AS rows_per_method,
  count(*) FILTER (o='anomaly_present') AS anomaly_present_images, count(*) FILTER (o='no_anomaly') AS clean_no_anomaly_images,
  (SELECT string_agg(a||'='||n, ';' ORDER BY a||'='||n) FROM (SELECT a, count(*) AS n FROM per GROUP BY 1)) AS category_counts,
  (SELECT CAST(coalesce(sum(n),0) AS BIGINT) FROM (SELECT count(*) AS n FROM scope GROUP BY image_id, method HAVING count(*)>1)) AS duplicate_image_method_rows,
  (SELECT count(*) FROM scope WHERE method='{FUSED}') AS fused_rows, (SELECT count(*) FROM scope WHERE method='{CTX}') AS contextual_rows,
  count(*) FILTER (f=1 AND c=1) AS paired_image_count, count(*) FILTER (f=1 AND c=0) AS fused_only_image_count,
  count(*) FILTER (f=0 AND c=1) AS contextual_only_image_count, count(*) FILTER (f<>c) AS unmatched_advanced_method_rows FROM per""")
def _(t):
    return an.scope_audit(t.scope)


_BOARD = SUMMARY + """, board AS (SELECT s.*, round(0.25*proposal_precision+0.25*coalesce(proposal_recall,0)+0.2*coalesce(top_1_proposal_recall,0)+0.2*i.iou
  +0.1*(1-false_proposals_per_image/greatest((SELECT max(false_proposals_per_image) FROM summary),1)),6) AS balanced_score
  FROM summary s JOIN (SELECT method, avg(mean_iou) AS iou FROM results GROUP BY method) i USING (method)) """


@query("a25_ablation_leaderboard", "results", _BOARD + "SELECT * FROM board")
def _(t):
    return an.ablation_leaderboard(t.results)


_DIFF = ["proposal_precision", "proposal_recall", "top_1_proposal_recall", "false_proposals_per_image", "processing_time_seconds"]


@query("a26_contribution_table", "results", _BOARD + "SELECT a.method AS configuration_id, " + ", ".join(
    f"round(a.{c}-b.{c},6) AS difference_{c}" for c in _DIFF) + f" FROM board a, board b WHERE b.method='{CTX}' AND a.method<>b.method")
def _(t):
    return an.contribution_table(an.ablation_leaderboard(t.results), CTX)


@query("a27_comparability_guard", "scope", """SELECT * FROM (SELECT 'dataset_manifest_hash' AS setting, count(DISTINCT dataset_id) AS distinct_values FROM scope
  UNION ALL SELECT 'matching_thresholds', count(DISTINCT experiment_version) FROM scope UNION ALL SELECT 'random_seed', count(DISTINCT plan_id) FROM scope), LATERAL (SELECT distinct_values<=1 AS comparable)""")
def _(t):
    snaps = t.scope.select("method", F.col("dataset_id").alias("dataset_manifest_hash"),
                           F.col("experiment_version").alias("matching_thresholds"), F.col("plan_id").alias("random_seed")).distinct()
    return an.comparability(snaps)
