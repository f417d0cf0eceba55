"""Result-store, matrix, review, severity and scalar queries."""

from pyspark.sql import functions as F

from ..core import r6
from ..functions import exprs as fx
from ..operators import results as rs
from ..operators import review as rv
from ..sources.tables import METHODS
from .registry import query

FUSED, CTX = METHODS[2], METHODS[3]
M_LIST = "(SELECT unnest(['" + "','".join(METHODS) + "']) AS method)"


def method_rows(t):
    return t.results.select("method").distinct()  # four methods


@query("s09_results_scan", "results", "SELECT result_id, image_id, method, recorded_timestamp FROM results WHERE plan_id='plan-3' AND experiment_version=1")
def _(t):
    return rs.results_scan(t.results, "plan-3", 1).select("result_id", "image_id", "method", "recorded_timestamp")


@query("s10_results_upsert", "results", "SELECT result_id, CASE WHEN run_status='failed' THEN 'completed' ELSE run_status END AS run_status FROM results")
def _(t):
    r = t.results
    redo = r.where("run_status = 'failed'").withColumn("run_status", F.lit("completed"))
    return rs.upsert(r, redo, rs.RESULT_KEY).select("result_id", "run_status")


@query("s10_set_execution", "results", """SELECT plan_id, CAST(1 AS BIGINT) AS experiment_version, min(recorded_timestamp) AS started_at, 'completed' AS status, count(*) AS completed_pairs FROM results GROUP BY 1""")
def _(t):
    ex = t.results.groupBy("plan_id", "experiment_version").agg(F.min("recorded_timestamp").alias("started_at"), F.count("*").alias("completed_pairs")).select(
        "plan_id", "experiment_version", F.lit("running").alias("status"), "completed_pairs", F.col("completed_pairs").alias("total_pairs"), "started_at", F.lit(1).alias("updated_at"))
    up = ex.withColumn("status", F.lit("completed")).withColumn("started_at", F.expr("started_at + interval 1 day")).withColumn("updated_at", F.lit(2))
    return rs.set_execution(ex, up).select("plan_id", "experiment_version", "started_at", "status", "completed_pairs")


@query("s11_records_upsert", "reviews", "SELECT record_id, CASE WHEN method='refined contextual method' THEN 'reset' ELSE review_status END AS review_status FROM reviews")
def _(t):
    new = t.reviews.where(F.col("method") == CTX).withColumn("review_status", F.lit("reset"))
    return rs.upsert(t.reviews, new, rv.RECORD_KEY).select("record_id", "review_status")


@query("s11_duplicate_count", "reviews", "SELECT count(*) AS duplicates FROM reviews WHERE method='refined contextual method'")
def _(t):
    return rs.duplicate_count(t.reviews.where(F.col("method") == CTX), t.reviews, rv.RECORD_KEY)


@query("s12_records_scan", "reviews", """SELECT record_id FROM reviews WHERE method='multi-scale fused method' AND experiment_status='Final Research Evaluation' AND CAST(recorded_timestamp AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-12-31'""")
def _(t):
    return rs.records_scan(t.reviews, {"method": FUSED, "experiment_status": "Final Research Evaluation", "date_from": "2024-01-05", "date_to": "2024-12-31"}).select("record_id")


@query("s13_records_delete", "reviews", """SELECT 'kept' AS part, count(*) AS n FROM reviews WHERE experiment_status<>'Development / Test' UNION ALL SELECT 'deleted', count(*) FROM reviews WHERE experiment_status='Development / Test'""")
def _(t):
    kept, gone = rs.delete_where(t.reviews, F.col("experiment_status") == "Development / Test", "experiment_id")
    return kept.agg(F.count("*").alias("n")).select(F.lit("kept").alias("part"), "n").unionByName(gone.agg(F.sum("deleted").alias("n")).select(F.lit("deleted").alias("part"), "n"))


@query("s14_delete_results", "results", "SELECT result_id FROM results WHERE NOT (plan_id='plan-2' AND experiment_version=1)")
def _(t):
    return rs.delete_where(t.results, (F.col("plan_id") == "plan-2") & (F.col("experiment_version") == 1), "plan_id")[0].select("result_id")


def _attempt_rows(t):
    return t.results.select(F.col("plan_id").alias("attempt_id"), "image_id", "method", F.col("run_status").alias("completion_status"))


def _attempts(t):
    g = t.results.groupBy(F.col("plan_id").alias("attempt_id")).agg(F.count("*").alias("attempted"), F.count(F.when(F.col("run_status") == "completed", 1)).alias("completed"))
    k = F.substring("attempt_id", 6, 5).cast("int")
    return g.select("attempt_id", F.when(k == 1, "completed").otherwise("partially_completed").alias("status"), (F.col("attempted") - (k == 2).cast("int") * 5).alias("expected"), "attempted",
                    "completed", (F.col("attempted") - F.col("completed") + (k == 3).cast("int")).alias("failed"), F.lit(0).alias("skipped"))


ATT = """, g AS (SELECT plan_id AS attempt_id, CAST(substr(plan_id,6) AS INT) AS k, count(*) AS attempted, count(*) FILTER (run_status='completed') AS completed FROM results GROUP BY 1,2),
 att AS (SELECT attempt_id, concat_ws('; ', CASE WHEN k=3 THEN 'attempted is not completed + failed + skipped' END, CASE WHEN k=3 THEN 'counters differ from row statuses' END, CASE WHEN k=2 THEN 'attempted exceeds expected' END,
  CASE WHEN k=1 AND attempted>completed THEN 'completed attempt is incomplete' END) AS faults FROM g) """


@query("a33_attempt_invariants", "results", ATT + "SELECT * FROM att")
def _(t):
    return rs.attempt_invariants(_attempt_rows(t), _attempts(t))


@query("s15_append_attempt", "results", ATT + "SELECT plan_id AS attempt_id, image_id, method FROM results WHERE plan_id IN (SELECT attempt_id FROM att WHERE faults='')")
def _(t):
    good = rs.attempt_invariants(_attempt_rows(t), _attempts(t)).where("faults = ''")
    return rs.visible_rows(_attempt_rows(t), good).select("attempt_id", "image_id", "method")


@query("s16_supersession", "results", "SELECT result_id FROM results WHERE run_status<>'failed' OR image_id%2=1")
def _(t):
    s = t.results.where("run_status = 'failed'").select(F.col("result_id").alias("prior_result_id"), F.concat("result_id", F.lit("-r2")).alias("successor_result_id"),
                                                        F.when(F.col("image_id") % 2 == 1, " ").otherwise("rerun").alias("reason"))
    return rs.current_rows(t.results, s).select("result_id")


@query("s17_store_counts", "results reviews plans", """SELECT 'results' AS table_name, count(*) AS row_count FROM results UNION ALL SELECT 'reviews', count(*) FROM reviews UNION ALL SELECT 'plans', count(*) FROM plans""")
def _(t):
    return rs.store_counts({"results": t.results, "reviews": t.reviews, "plans": t.plans}).select("table_name", "row_count")


@query("s18_readonly_scan", "results", "SELECT result_id, image_id FROM results ORDER BY image_id, result_id LIMIT 100")
def _(t):
    return t.results.orderBy("image_id", "result_id").limit(100).select("result_id", "image_id")  # the reader's own row limit


@query("s19_legacy_migrate", "", """, e AS (SELECT event_id, user_id, event_type, CAST(json_extract(props,'$.k') AS BIGINT) AS k FROM events), r AS (SELECT *, event_id%3<>0 AS lack, CASE WHEN k%4=0 THEN NULL WHEN k%4=1 THEN 'contour-only baseline' ELSE 'refined contextual method' END AS m FROM e)
 SELECT event_id, coalesce(m,'refined contextual method') AS method, CASE WHEN coalesce(m,'')='contour-only baseline' THEN 'not_reviewed' ELSE 'partially_reviewed' END AS review_status,
  CASE WHEN coalesce(m,'')<>'contour-only baseline' THEN k END AS accepted, CASE WHEN coalesce(m,'')='contour-only baseline' THEN k ELSE coalesce(CASE WHEN event_id%5=0 THEN NULL ELSE 2 END,0) END AS not_reviewed FROM r WHERE lack""".replace(", e AS", "WITH e AS", 1))
def _(t):
    k = F.get_json_object("props", "$.k").cast("bigint")
    rows = t.read("events").select(
        F.col("event_id"), F.when(F.col("event_id") % 3 == 0, F.col("event_id").cast("string")).alias("record_id"), F.lit(None).cast("string").alias("review_status"), F.when(F.col("event_id") % 5 != 0, 2).alias("not_reviewed"),
        F.when(F.col("event_id") % 3 == 0, "Development / Test").alias("experiment_status"), F.when(k % 4 == 1, METHODS[0]).when(k % 4 > 1, CTX).alias("method"), k.alias("final_proposals"), k.alias("accepted"), k.alias("rejected"), k.alias("uncertain"),
        *[F.lit(None).cast("string").alias(c) for c in ("experiment_id", "reviewer_id", "image_filename", "image_outcome", "ground_truth_status")], F.lit(None).cast("bigint").alias("experiment_version"))
    # review status is always absent in the source, so the id stands in for "has every field"
    legacy = rows.where(F.col("record_id").isNull())
    assert set(rs.LEGACY_REQUIRED) <= set(rows.columns)
    out = rs.migrate_legacy(legacy.withColumn("image_filename", F.col("event_id").cast("string")))
    return out.select(F.col("image_filename").cast("bigint").alias("event_id"), "method", "review_status", "accepted", F.col("not_reviewed").cast("bigint").alias("not_reviewed"))


@query("s20_result_export", "scope", "SELECT result_id, '{\"image_id\":'||image_id||',\"method\":\"'||method||'\"}' AS line FROM scope WHERE image_outcome='no_anomaly'")
def _(t):
    return t.scope.where("image_outcome = 'no_anomaly'").select("result_id", F.to_json(F.struct("image_id", "method")).alias("line"))


@query("s21_candidate_export", "boxes", "SELECT 'run-7' AS run_id, CAST(image_id AS VARCHAR) AS image_id, CAST(box_id AS VARCHAR) AS box_id, coalesce(CASE WHEN flag<>'R' THEN CAST(x1 AS VARCHAR) END,'N/A') AS x1 FROM boxes")
def _(t):
    run = t.spark.createDataFrame([("run-7",)], "run_id string")
    return rs.candidate_export(t.boxes.select("image_id", "box_id", F.when(F.col("flag") != "R", F.col("x1")).alias("x1")), run)


_Y = "printf('%.6f', {})"


@query("s22_yolo_export", "boxes", """SELECT image_id, (box_id-1)//500 AS part, count(*) AS n, string_agg((CASE flag WHEN 'R' THEN 0 ELSE 1 END)||' '||printf('%.6f',(x1+x2)/2.0/48)||' '||printf('%.6f',(y1+y2)/2.0/48)||' '||printf('%.6f',(x2-x1)/48.0)||' '||printf('%.6f',(y2-y1)/48.0), chr(10) ORDER BY box_id) AS boxes
  FROM boxes WHERE flag<>'N' GROUP BY 1,2""")
def _(t):
    reg = t.boxes.select("image_id", "box_id", "x1", "y1", "x2", "y2", (F.col("flag") != "N").alias("accepted"), F.when(F.col("flag") == "R", "rust").otherwise("crack").alias("label"))
    return rs.yolo_export(reg, ["rust", "crack"], 48, 48).select("image_id", "part", F.size(F.split("boxes", "\n")).cast("bigint").alias("n"), "boxes")


@query("s23_artifact_roundtrip", "results", "SELECT count(*) AS rows_checked, CAST(0 AS BIGINT) AS rows_broken FROM results")
def _(t):
    r = t.results.select("result_id", "image_id", "method", "final_proposals")
    signed = r.withColumn("artifact_hash", fx.canonical_hash({c: F.col(c) for c in r.columns}))
    bad = rs.verify_artifact(signed).agg(F.count("*").alias("rows_broken"))
    return signed.agg(F.count("*").alias("rows_checked")).crossJoin(F.broadcast(bad))


@query("s24_attempt_ledger", "", """, e AS (SELECT user_id AS ledger_id, CASE WHEN event_type='signup' THEN 'started' ELSE 'finished' END AS event, event_id%3 AS attempt_id FROM events WHERE event_type IN ('signup','error'))
 SELECT ledger_id, count(*) FILTER (event='started') AS starts, count(*) FILTER (event='finished') AS finishes, count(*) FILTER (event='started')=0 AS may_start,
  coalesce(count(*) FILTER (event='started')=1 AND count(*) FILTER (event='finished')<=1 AND coalesce(min(attempt_id) FILTER (event='finished'), min(attempt_id) FILTER (event='started'))=min(attempt_id) FILTER (event='started'),false) AS consistent FROM e GROUP BY 1""".replace(", e AS", "WITH e AS", 1))
def _(t):
    e = t.read("events").where(F.col("event_type").isin("signup", "error")).select(
        F.col("user_id").alias("ledger_id"), F.when(F.col("event_type") == "signup", "started").otherwise("finished").alias("event"), (F.col("event_id") % 3).alias("attempt_id"))
    return rs.ledger_state(e)


@query("s27_sink_modes", "results", "SELECT result_id FROM results WHERE run_status='failed'")
def _(t):
    return rs.append_new(t.results.where("run_status = 'completed'"), t.results.where("run_status = 'failed'"), rs.RESULT_KEY).select("result_id")


@query("s31_result_rows_build", "results", """, r AS (SELECT *, sha256('{"final_proposals":'||final_proposals||',"true_positive_proposals":'||true_positive_proposals||'}') AS p FROM results)
 SELECT sha256(plan_id||chr(31)||experiment_version||chr(31)||image_id||chr(31)||method) AS result_id, image_id, method, sha256(plan_id) AS specification_hash, run_status AS completion_status,
  CASE WHEN run_status<>'failed' THEN p END AS payload_sha256, CASE WHEN run_status='failed' THEN 'RuntimeError' END AS error_type FROM r""")
def _(t):
    return rs.result_rows(t.results, {"specification_hash": F.sha2("plan_id", 256)}, ["true_positive_proposals", "final_proposals"])


@query("p13_set_valued_rules", "results", """SELECT result_id, concat_ws('; ', CASE WHEN image_id%6=0 THEN 'content_hash is not a SHA-256' END, CASE WHEN method LIKE 'contour%' THEN 'invalid completion status' END, CASE WHEN proposal_recall IS NULL THEN 'scores must be finite' END,
  CASE WHEN first_true_anomaly_proposal_rank-2<=0 THEN 'ranks are positive' END, CASE WHEN image_id%2=0 AND true_positive_proposals>0 THEN 'clean image with truths' END, CASE WHEN image_id%2=1 AND true_positive_proposals=0 THEN 'positive image without truths' END) AS faults FROM results""")
def _(t):
    k = F.col("image_id")
    rows = t.results.select("result_id", F.when(k % 6 != 0, F.sha2("result_id", 256)).otherwise(F.upper(F.sha2("result_id", 256))).alias("content_hash"), F.when(F.col("method").startswith("contour"), "odd").otherwise(F.col("run_status")).alias("completion_status"),
                            F.coalesce("proposal_recall", F.lit(float("nan"))).alias("score"), (F.col("first_true_anomaly_proposal_rank") - 2).alias("rank"),
                            F.when(k % 2 == 0, "no_anomaly").otherwise("anomaly_present").alias("status"), F.col("true_positive_proposals").alias("truths"))
    return rs.row_faults(rows, ["content_hash"])


@query("p18_config_rules", "datasets", """SELECT dataset_id||dataset_version AS config_id, concat_ws('; ', CASE WHEN registered_timestamp%10>8 THEN 'level outside [0, 8]' END, CASE WHEN registered_timestamp%10>=registered_timestamp%7 THEN 'level must be below top' END,
  CASE WHEN registered_timestamp%3=0 THEN 'configuration keys differ' END, CASE WHEN registered_timestamp%4+registered_timestamp%7<=0 THEN 'weights must have a positive total' END) AS faults FROM datasets""")
def _(t):
    k = F.col("registered_timestamp")
    cfg = t.datasets.select(F.concat("dataset_id", "dataset_version").alias("config_id"), (k % 10).alias("level"), (k % 7).alias("top"), (k % 4).alias("w"),
                            F.when(k % 3 == 0, F.array(F.lit("level"))).otherwise(F.array(F.lit("level"), F.lit("top"))).alias("keys"))
    return rs.config_faults(cfg, {"level": (0, 8)}, ["level", "top"], [("level", "top")], ["w", "top"])


# ---- matrix -------------------------------------------------------------------------------
def expected(t):
    return rs.expected_matrix(t.result_images, method_rows(t))


EXP = f", expected AS (SELECT i.image_id, m.method FROM result_images i CROSS JOIN {M_LIST} m) "


@query("j05_expected_matrix", "result_images", EXP + "SELECT * FROM expected")
def _(t):
    return expected(t)


@query("j02_resume_pairs", "results result_images", EXP + "SELECT * FROM expected EXCEPT SELECT image_id, method FROM results WHERE run_status='completed'")
def _(t):
    return rs.resume_pairs(expected(t), t.results)


@query("j03_retry_failed", "results", "SELECT image_id, method FROM results WHERE run_status='failed'")
def _(t):
    return rs.resume_pairs(expected(t), t.results, "retry_failed")


@query("j04_selected_images", "images", """SELECT 'plan-s' AS plan_id, row_number() OVER (ORDER BY image_id) AS position, image_id, split FROM images WHERE split='test'""")
def _(t):
    from ..scale import ranked
    m = ranked(t.images.where("split = 'test'").select("image_id", F.lit("plan-s").alias("plan_id")), ["plan_id"], [("image_id", True)], "position")
    return rs.selected_images(m, t.images).select("plan_id", "position", "image_id", "split")


@query("j06_pairing_audit", "results result_images", EXP + """, j AS (SELECT r.image_id IS NOT NULL AS o, e.image_id IS NOT NULL AS x, run_status FROM results r FULL JOIN expected e ON r.image_id=e.image_id AND r.method=e.method)
 SELECT count(*) FILTER (x) AS expected_rows, count(*) FILTER (o) AS actual_rows, count(*) FILTER (o) AS unique_pairs, count(*) FILTER (NOT o) AS missing_pairs, count(*) FILTER (NOT x) AS unexpected_pairs,
  count(*) FILTER (o AND run_status<>'completed') AS failed_rows, CAST(0 AS BIGINT) AS duplicate_pair_count, false AS complete FROM j""")
def _(t):
    return rs.pairing_audit(t.results, expected(t))


@query("x02_pair_difference", "results result_images", EXP + "SELECT *, 'missing' AS side FROM (SELECT * FROM expected EXCEPT SELECT image_id, method FROM results)")
def _(t):
    return rs.pair_difference(t.results, expected(t))


@query("j26_identity_check", "images", """SELECT image_id AS position, CASE WHEN image_id%7=0 THEN 'missing sample' WHEN image_id%5=0 THEN 'content hash' ELSE 'role' END AS difference FROM images WHERE image_id%7=0 OR image_id%5=0 OR split='test'""")
def _(t):
    sel = t.images.select(F.col("image_id").alias("position"), "image_id", "sha256_hash", F.lit("fit").alias("role"))
    got = t.images.where("image_id % 7 <> 0").select(F.col("image_id").alias("position"), "image_id", F.when(F.col("image_id") % 5 == 0, F.reverse("sha256_hash")).otherwise(F.col("sha256_hash")).alias("sha256_hash"),
                                                     F.when(F.col("split") == "test", "holdout").otherwise("fit").alias("role"))
    return rs.identity_check(sel, got)


@query("w01_next_version", "results", "SELECT plan_id, CAST(2 AS BIGINT) AS next_version, count(*) AS cloned FROM results GROUP BY 1")
def _(t):
    nv = rs.next_version(t.results, "plan_id")
    cl = rs.clone_version(t.results, F.lit(2)).groupBy("plan_id").agg(F.count("*").alias("cloned"))
    return nv.join(cl, "plan_id")


@query("w17_batch_failures", "images", """SELECT row_number() OVER (ORDER BY image_id)-1 AS input_index, sha256_hash AS item_id, CASE WHEN image_id<>min(image_id) OVER (PARTITION BY sha256_hash) THEN 'duplicate id' WHEN width<8 THEN 'failed' ELSE 'completed' END AS status FROM images""")
def _(t):
    return rs.batch_failures(t.images.withColumn("item_id", F.col("sha256_hash")), "image_id", F.col("width") >= 8)


@query("w18_progress_state", "results plans", """SELECT plan_id, CAST(1 AS BIGINT) AS experiment_version, total AS total_pairs, done AS completed_pairs, err AS failed_pairs, CASE WHEN plan_id='plan-4' THEN 'cancelled' WHEN done>=total AND err=0 THEN 'completed' WHEN done>0 THEN 'partially_completed' ELSE 'failed' END AS state
  FROM (SELECT plan_id, count(*) AS total, count(*) FILTER (run_status='completed') AS done, count(*) FILTER (run_status='failed') AS err FROM results GROUP BY 1)""")
def _(t):
    tot = t.results.groupBy("plan_id", "experiment_version").agg(F.count("*").alias("total_pairs")).withColumn("cancelled", F.col("plan_id") == "plan-4")
    return rs.progress_state(t.results, tot)


@query("x01_concat_runs", "results", "SELECT method AS configuration_id, result_id FROM results WHERE method IN ('multi-scale fused method','refined contextual method')")
def _(t):
    part = lambda m: t.results.where(F.col("method") == m).select(F.col("method").alias("configuration_id"), "result_id")
    return part(FUSED).unionByName(part(CTX))


@query("x03_method_symmetric_diff", "results", f""", f AS (SELECT DISTINCT image_id FROM results WHERE method='{FUSED}'), c AS (SELECT DISTINCT image_id FROM results WHERE method='{CTX}')
 SELECT image_id, 'fused only' AS side FROM (SELECT * FROM f EXCEPT SELECT * FROM c) UNION ALL SELECT image_id, 'contextual only' FROM (SELECT * FROM c EXCEPT SELECT * FROM f) UNION ALL SELECT image_id, 'both' FROM (SELECT * FROM f INTERSECT SELECT * FROM c)""")
def _(t):
    f, c = (t.results.where(F.col("method") == m).select("image_id") for m in (FUSED, CTX))
    tag = lambda d, s: d.withColumn("side", F.lit(s))
    return tag(f.subtract(c), "fused only").unionByName(tag(c.subtract(f), "contextual only")).unionByName(tag(f.intersect(c), "both"))


@query("x07_ablation_source_audit", "results result_images", """, r AS (SELECT DISTINCT image_id FROM results) SELECT (SELECT count(*) FROM (SELECT image_id FROM result_images EXCEPT SELECT * FROM r)) AS plan_only, (SELECT count(*) FROM (SELECT * FROM r EXCEPT SELECT image_id FROM result_images)) AS results_only,
  (SELECT count(*) FROM result_images)*12 AS expected_pairs""")
def _(t):
    r, p = t.results.select("image_id").distinct(), t.result_images.select("image_id")
    a = p.subtract(r).agg(F.count("*").alias("plan_only"))
    b = r.subtract(p).agg(F.count("*").alias("results_only"))
    return a.crossJoin(F.broadcast(b)).crossJoin(F.broadcast(p.agg((F.count("*") * len(rs.ABLATIONS)).alias("expected_pairs"))))  # one-row tables


@query("g10_ablation_matrix", "result_images", ", a AS (SELECT * FROM (VALUES " + ",".join(f"('{k}','[{','.join(chr(34) + c + chr(34) for c in v)}]')" for k, v in rs.ABLATIONS.items()) + """) v(configuration_id, d))
 SELECT configuration_id, sha256('{"configuration_id":"'||configuration_id||'","disabled_components":'||d||'}') AS snapshot_hash, (SELECT count(*) FROM result_images) AS images FROM a""")
def _(t):
    cfg = t.spark.createDataFrame(list(rs.ABLATIONS.items()), "configuration_id string, disabled_components array<string>")
    return rs.ablation_matrix(t.result_images, cfg).select("configuration_id", "snapshot_hash", "images")


@query("a23_stage_timings", "results", """SELECT result_id AS run_id, CASE WHEN image_id%3=0 THEN 'match' ELSE '' END AS missing_stages, stage, round(seconds,6) AS seconds FROM (SELECT result_id, image_id, 'detect' AS stage, processing_time_seconds AS seconds FROM results
  UNION ALL SELECT result_id, image_id, 'match', mean_iou FROM results WHERE image_id%3<>0)""")
def _(t):
    m = F.when(F.col("image_id") % 3 == 0, F.create_map(F.lit("detect"), "processing_time_seconds")).otherwise(F.create_map(F.lit("detect"), F.col("processing_time_seconds"), F.lit("match"), F.col("mean_iou")))
    return rs.stage_timings(t.results.select(F.col("result_id").alias("run_id"), m.alias("timings")), ["detect", "match"]).withColumn("seconds", r6("seconds"))


# ---- review -------------------------------------------------------------------------------
@query("p11_scope_filter", "reviews", "SELECT record_id FROM reviews WHERE experiment_status='Development / Test'")
def _(t):
    return rv.scope_filter(t.reviews, development_only=True).select("record_id")


_OK = "image_outcome='anomaly present' AND (ground_truth_status<>'unknown' OR recall_override) AND first_accepted_rank IS NOT NULL"
_RV = "review_status IN ('fully_reviewed','partially_reviewed')"


@query("a05_review_summary", "reviews", f"""SELECT method, count(*) FILTER ({_OK}) AS eligible_images, count(*) FILTER (image_outcome='anomaly present') AS anomaly_present_images, count(*) FILTER ({_RV}) AS reviewed_images, count(*) FILTER (review_status='not_reviewed') AS not_reviewed_images,
  {", ".join(f"round(avg(CASE WHEN first_accepted_rank<={k} THEN 1.0 ELSE 0.0 END) FILTER ({_OK}),6) AS top_{k}_proposal_recall" for k in (1, 3, 5, 8))},
  round(avg(accepted) FILTER ({_RV}),6) AS mean_accepted_proposals_per_image, round(avg(rejected) FILTER ({_RV}),6) AS mean_rejected_proposals_per_image, round(avg(uncertain) FILTER ({_RV}),6) AS mean_uncertain_proposals_per_image,
  round(avg(not_reviewed),6) AS mean_not_reviewed_proposals_per_image, round(avg(rejected) FILTER ({_RV}),6) AS mean_false_proposals_per_image,
  round(CAST(sum(accepted) FILTER ({_RV}) AS DOUBLE)/nullif(sum(accepted) FILTER ({_RV})+sum(rejected) FILTER ({_RV}),0),6) AS annotation_acceptance_rate, round(avg(review_duration_seconds) FILTER ({_RV}),6) AS mean_review_time_seconds,
  round(avg(first_accepted_rank) FILTER ({_OK}),6) AS mean_proposals_reviewed_before_first_useful FROM reviews WHERE experiment_status='Final Research Evaluation' GROUP BY 1""")
def _(t):
    return rv.review_summary(rv.scope_filter(t.reviews))


@query("w05_first_hit_rank", "boxes truths proposals", """, r AS (SELECT *, row_number() OVER (PARTITION BY image_id, method ORDER BY score DESC, proposal_id) AS rank FROM proposals)
 SELECT image_id, method, min(rank) AS first_rank FROM r JOIN truths t USING (image_id) WHERE greatest(least(r.x2,t.x2)-greatest(r.x1,t.x1),0)*greatest(least(r.y2,t.y2)-greatest(r.y1,t.y1),0)>=0.1*((r.x2-r.x1)*(r.y2-r.y1)+(t.x2-t.x1)*(t.y2-t.y1)-greatest(least(r.x2,t.x2)-greatest(r.x1,t.x1),0)*greatest(least(r.y2,t.y2)-greatest(r.y1,t.y1),0)) AND r.x1<t.x2 AND t.x1<r.x2 AND r.y1<t.y2 AND t.y1<r.y2 GROUP BY 1,2""")
def _(t):
    from ..operators.matching import rank_proposals
    return rv.first_hit_rank(rank_proposals(t.proposals), t.truths)


@query("w06_topk_hits", "reviews", "SELECT record_id, " + ", ".join(f"CASE WHEN image_outcome='anomaly present' AND ground_truth_status<>'unknown' AND first_accepted_rank IS NOT NULL THEN first_accepted_rank<={k} END AS top_{k}" for k in (1, 3, 5, 8)) + " FROM reviews")
def _(t):
    f = rv.top_k_flags(F.col("first_accepted_rank"), F.col("image_outcome"), F.col("ground_truth_status"), F.lit(False))
    return t.reviews.select("record_id", *[c.alias(n) for n, c in f.items()])


_DEC = "CASE event_type WHEN 'purchase' THEN 'accept' WHEN 'error' THEN 'reject' ELSE 'uncertain' END"


@query("w07_build_records", "event_rows", f""", b AS (SELECT image_id, m, count(*) AS n, min(rn) FILTER (event_type='error') AS fr FROM event_rows GROUP BY 1,2), d AS (SELECT image_id, {_DEC} AS decision, rn AS rank FROM event_rows WHERE m=3 AND event_type IN ('purchase','error','view')),
 g AS (SELECT image_id, count(*) FILTER (decision='accept') AS a, count(*) FILTER (decision='reject') AS r, count(*) FILTER (decision='uncertain') AS u, count(*) AS seen, min(rank) FILTER (decision='accept') AS ar FROM d GROUP BY 1)
 SELECT image_id, m AS method, n AS final_proposals, CASE WHEN m=3 THEN coalesce(a,0) END AS accepted, CASE WHEN m=3 THEN coalesce(r,0) END AS rejected, CASE WHEN m=3 THEN coalesce(u,0) END AS uncertain, CASE WHEN m=3 THEN greatest(n-coalesce(seen,0),0) ELSE n END AS not_reviewed,
  CASE WHEN m<>3 OR coalesce(seen,0)=0 THEN 'not_reviewed' WHEN seen<n THEN 'partially_reviewed' ELSE 'fully_reviewed' END AS review_status, CASE WHEN image_id%3<>0 THEN CASE WHEN m=3 THEN ar ELSE fr END END AS first_accepted_rank FROM b LEFT JOIN g USING (image_id)""")
def _(t):
    e = t.event_rows
    base = e.groupBy("image_id", F.col("m").alias("method")).agg(F.count("*").alias("final_proposals")).select(
        "*", F.when(F.col("image_id") % 3 == 0, "no anomaly").otherwise("anomaly present").alias("image_outcome"), F.lit("reviewer-estimated").alias("ground_truth_status"), F.lit(60.0).alias("duration"))
    d = e.where((F.col("m") == 3) & F.col("event_type").isin("purchase", "error", "view")).select(
        "image_id", F.when(F.col("event_type") == "purchase", "accept").when(F.col("event_type") == "error", "reject").otherwise("uncertain").alias("decision"), F.col("rn").alias("rank"))
    first = e.where("event_type = 'error'").groupBy("image_id", F.col("m").alias("method")).agg(F.min("rn").alias("first_rank"))
    return rv.build_records(base, d, first, 3).select("image_id", "method", "final_proposals", "accepted", "rejected", "uncertain", "not_reviewed", "review_status", "first_accepted_rank")


# ---- severity and scalars -------------------------------------------------------------------
DEF = """, defects AS (SELECT image_id, box_id, area/2304.0 AS relative_area, CASE WHEN asp>2.2 AND fill<0.45 THEN 'crack' WHEN area/2304.0>0.1 AND fill>0.35 THEN 'corrosion' WHEN fill<0.22 THEN 'pitting' WHEN asp>1.8 THEN 'scratch' ELSE 'surface_anomaly' END AS alt,
   CASE WHEN asp>5.5 AND fill<0.45 THEN 'crack' WHEN area/2304.0>0.035 AND fill>0.35 THEN 'corrosion' WHEN fill<0.22 THEN 'pitting' WHEN asp>3.0 THEN 'scratch' ELSE 'surface_anomaly' END AS defect_type, least(0.85, 0.35+asp/12.0+least(area/2304.0,0.2)) AS confidence
   FROM (SELECT image_id, box_id, (x2-x1)*(y2-y1) AS area, greatest((x2-x1)/CAST(y2-y1 AS DOUBLE),(y2-y1)/CAST(x2-x1 AS DOUBLE)) AS asp, (l_partkey%10)/10.0 AS fill FROM boxes)) """


def defects(t):
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    asp, rel, fill = F.greatest(w / h, h / w), w * h / 2304.0, (F.col("l_partkey") % 10) / 10.0
    return t.boxes.select("image_id", "box_id", rel.alias("relative_area"), rv.classify_region(asp, fill, rel).alias("defect_type"), rv.region_confidence(asp, rel).alias("confidence"))


@query("f07_classify_region", "boxes", DEF + "SELECT image_id, box_id, defect_type, round(confidence,6) AS confidence FROM defects")
def _(t):
    return defects(t).select("image_id", "box_id", "defect_type", r6("confidence").alias("confidence"))


RISK = {"crack": 0.9, "corrosion": 0.75, "pitting": 0.6}
SEV = DEF + """, sev AS (SELECT image_id, defects, round(round(least(100.0, worst+least(defects*4,18)+least(spread*120,22.0)),6),1) AS score, round(least(100.0, worst+least(defects*4,18)+least(spread*120,22.0)),6) AS s, sig, spread FROM (SELECT image_id, count(*) AS defects, least(sum(relative_area),1.0) AS spread,
   max(least(relative_area*420,35.0)+confidence*25+CASE defect_type WHEN 'crack' THEN 0.9 WHEN 'corrosion' THEN 0.75 WHEN 'pitting' THEN 0.6 ELSE 0.4 END*40) AS worst, count(*) FILTER (defect_type IN ('crack','corrosion')) AS sig FROM defects GROUP BY 1)),
 sevl AS (SELECT *, CASE WHEN s>=82 THEN 'Critical' WHEN s>=62 THEN 'High' WHEN s>=35 THEN 'Medium' ELSE 'Low' END AS label FROM sev) """


@query("a35_severity_image", "boxes", SEV + """SELECT image_id, defects, score, label, concat_ws('; ', CASE WHEN sig>0 THEN 'structurally significant defects' END, CASE WHEN round(spread,9)>0.05 THEN 'non-trivial affected area' END, CASE WHEN defects>=4 THEN 'multiple regions' END,
  CASE WHEN sig=0 AND round(spread,9)<=0.05 AND defects<4 THEN 'confidence and area' END) AS drivers FROM sevl""")
def _(t):
    return rv.image_severity(defects(t), RISK)


@query("a36_defect_mix", "boxes", SEV + ", act AS (SELECT * FROM (VALUES " + ",".join("('%s',[%s])" % (k, ",".join(f"'{a}'" for a in v)) for k, v in rv.ACTIONS.items()) + f""") v(defect_type, acts)),
 ty AS (SELECT image_id, defect_type, count(*) AS n, min(box_id) AS first FROM defects GROUP BY 1,2), lead AS (SELECT image_id, string_agg(n||' '||defect_type, ', ' ORDER BY n DESC, first) AS leading_types FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY n DESC, first) AS r FROM ty) WHERE r<=3 GROUP BY 1),
 ac AS (SELECT image_id, a, min((first, i)) AS o FROM (SELECT image_id, first, unnest(acts) AS a, generate_subscripts(acts,1) AS i FROM ty JOIN act USING (defect_type)) GROUP BY 1,2), acs AS (SELECT image_id, string_agg(a, ' | ' ORDER BY o) AS actions FROM ac GROUP BY 1)
 SELECT image_id, leading_types, actions||' | '||CASE WHEN label IN ('High','Critical') THEN '{rv.ESCALATE}' WHEN label='Medium' THEN '{rv.FOLLOW_UP}' ELSE '{rv.MONITOR}' END AS actions FROM lead JOIN acs USING (image_id) JOIN sevl USING (image_id)""")
def _(t):
    d = defects(t)
    return rv.defect_mix(d, rv.image_severity(d, RISK))


@query("f17_duration", "", """SELECT event_id, CASE WHEN event_id%7=0 THEN 0.0 ELSE greatest((event_id%3-1)*90.0,0.0) END AS seconds FROM events""")
def _(t):
    s = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    e = F.date_format(F.timestamp_micros(F.unix_micros(F.date_trunc("second", F.col("ts"))) + (F.col("event_id") % 3 - 1) * 90_000_000), "yyyy-MM-dd'T'HH:mm:ss")
    return t.read("events").select("event_id", fx.duration_seconds(s, F.when(F.col("event_id") % 7 == 0, "soon").otherwise(e)).alias("seconds"))


@query("f18_coercions", "", """SELECT event_id, CASE WHEN event_id%4=0 THEN NULL ELSE CAST(json_extract(props,'$.k') AS BIGINT) END AS as_int, CAST(value AS DOUBLE) AS as_float, CASE WHEN event_id%4<>0 THEN CAST(json_extract(props,'$.k') AS BIGINT)>50 END AS as_bool FROM events""")
def _(t):
    k = F.when(F.col("event_id") % 4 == 0, "").otherwise(F.get_json_object("props", "$.k"))
    return t.read("events").select("event_id", k.try_cast("bigint").alias("as_int"), F.col("value").cast("string").try_cast("double").alias("as_float"), (k.try_cast("bigint") > 50).alias("as_bool"))


@query("f24_json_access", "", "SELECT event_id, CAST(json_extract(props,'$.k') AS BIGINT) AS k FROM events")
def _(t):
    return t.read("events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("f25_review_decision", "boxes", """SELECT image_id, box_id, CASE flag WHEN 'R' THEN 'uncertain' WHEN 'A' THEN 'accept' ELSE 'reject' END AS decision, flag='A' AS accepted, CASE WHEN l_linenumber%3=0 THEN 'unassigned' ELSE 'rust' END AS label, CASE WHEN l_partkey%5=0 THEN 0 ELSE x1 END AS x1 FROM boxes""")
def _(t):
    given = F.when(F.col("flag") == "R", "uncertain")
    decision = F.coalesce(given, F.when(F.col("flag") == "A", "accept").otherwise("reject"))
    label = F.trim(F.when(F.col("l_linenumber") % 3 == 0, "  ").otherwise(" rust "))
    corrected = F.when(F.col("l_partkey") % 5 == 0, F.lit(0).cast("bigint"))
    return t.boxes.select("image_id", "box_id", decision.alias("decision"), (decision == "accept").alias("accepted"), F.when(label == "", "unassigned").otherwise(label).alias("label"), F.coalesce(corrected, "x1").alias("x1"))


@query("f26_na_display", "results", "SELECT result_id, coalesce(CAST(first_true_anomaly_proposal_rank AS VARCHAR),'N/A') AS rank_text, coalesce(CAST(top_1_hit AS VARCHAR),'N/A') AS hit_text FROM results")
def _(t):
    return t.results.select("result_id", fx.na(F.col("first_true_anomaly_proposal_rank")).alias("rank_text"), fx.na(F.col("top_1_hit")).alias("hit_text"))
