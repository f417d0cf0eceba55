"""Result stores, experiment matrices, provenance rules and append-only writes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core import any_row
from ..functions.exprs import canonical_hash, is_sha256, na
from ..scale import ranked
from .registry import listed

RESULT_KEY = ["plan_id", "experiment_version", "image_id", "method"]
# The ablation switches each named configuration turns off.
ABLATIONS = {
    "ABL-FULL": [], "ABL-NO-TEXTURE": ["local_texture_context"], "ABL-NO-COLOUR": ["local_colour_context"], "ABL-NO-ENTROPY": ["local_entropy_context"],
    "ABL-NO-STABILITY": ["stability"], "ABL-NO-BOUNDARY-EDGE": ["internal_boundary_edge"], "ABL-NO-BORDER": ["border_penalty"],
    "ABL-NO-COHERENCE": ["coherence_term"], "ABL-FUSED-ONLY": ["contextual_contrast"], "ABL-RERANK-ONLY": ["multi_scale_fusion"],
    "ABL-RERANK-SPECULAR-SUPPRESS": ["multi_scale_fusion"], "ABL-MINIMAL": ["contextual_contrast", "stability", "multi_scale_fusion", "mask_refinement"],
}


# ---- scans and rewrites -------------------------------------------------------------------
def results_scan(results: DataFrame, plan: str | None = None, version: int | None = None) -> DataFrame:
    if plan:
        results = results.where(F.col("plan_id") == plan)
    if version:
        results = results.where(F.col("experiment_version") == version)
    return results.orderBy("recorded_timestamp")


def upsert(stored: DataFrame, incoming: DataFrame, key: Sequence[str], overwrite: bool = True) -> DataFrame:
    """Incoming rows replace stored rows of the same key; without overwrite a clash is an error."""
    keys = incoming.select(*key).distinct()
    if not overwrite and any_row(stored.join(keys, list(key), "left_semi")):
        raise ValueError("duplicate key")
    return stored.join(keys, list(key), "left_anti").unionByName(incoming.select(*stored.columns))


def duplicate_count(stored: DataFrame, incoming: DataFrame, key: Sequence[str]) -> DataFrame:
    return incoming.join(stored.select(*key).distinct(), list(key), "left_semi").agg(F.count("*").alias("duplicates"))


def set_execution(executions: DataFrame, update: DataFrame) -> DataFrame:
    """Latest state per (plan, version); the first start time is kept."""
    key = ["plan_id", "experiment_version"]
    both = executions.unionByName(update)
    return both.groupBy(*key).agg(F.min("started_at").alias("started_at"), F.max_by(F.struct("status", "completed_pairs", "total_pairs", "updated_at"), "updated_at").alias("s")).select(
        *key, "started_at", "s.*")


def delete_where(table: DataFrame, condition: Column, affected: str) -> tuple[DataFrame, DataFrame]:
    """(remaining rows, affected ids with their row counts)."""
    hit = F.coalesce(condition, F.lit(False))
    return table.where(~hit), table.where(hit).groupBy(affected).agg(F.count("*").alias("deleted"))


def records_scan(records: DataFrame, filters: Mapping[str, object]) -> DataFrame:
    for c in ("experiment_id", "reviewer_id", "image_filename", "method", "experiment_status"):
        if filters.get(c):
            records = records.where(F.col(c) == filters[c])
    day = F.to_date("recorded_timestamp")
    if filters.get("date_from"):
        records = records.where(day >= F.lit(filters["date_from"]).cast("date"))
    if filters.get("date_to"):
        records = records.where(day <= F.lit(filters["date_to"]).cast("date"))
    return records.orderBy(F.desc("recorded_timestamp"))


def current_rows(rows: DataFrame, supersessions: DataFrame) -> DataFrame:
    """Rows no accepted supersession replaces; a supersession needs two rows and a reason."""
    ok = supersessions.where((F.col("prior_result_id") != F.col("successor_result_id")) & (F.trim("reason") != ""))
    return rows.join(ok.select(F.col("prior_result_id").alias("result_id")).distinct(), "result_id", "left_anti")


def store_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in tables.items():
        part = df.agg(F.count("*").alias("row_count")).select(F.lit(name).alias("table_name"), "row_count", F.lit(len(df.columns)).alias("columns"))
        out = part if out is None else out.unionByName(part)
    return out


def append_new(sink: DataFrame, rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows to append to an append-only sink; an identity already present is refused."""
    if any_row(rows.groupBy(*key).count().where("count > 1")) or any_row(rows.join(sink.select(*key), list(key), "left_semi")):
        raise ValueError("duplicate result identity")
    return rows


def write_once(df: DataFrame, path: str) -> None:
    """Parquet artifact that is never overwritten; each row carries its own content hash."""
    cols = {c: F.col(c) for c in df.columns}
    df.withColumn("artifact_hash", canonical_hash(cols)).write.mode("errorifexists").parquet(path)


def verify_artifact(df: DataFrame) -> DataFrame:
    """Rows whose embedded hash does not reproduce."""
    cols = {c: F.col(c) for c in df.columns if c != "artifact_hash"}
    return df.where(canonical_hash(cols) != F.col("artifact_hash"))


# ---- experiment matrix --------------------------------------------------------------------
def expected_matrix(images: DataFrame, methods: DataFrame) -> DataFrame:
    return images.select("image_id").crossJoin(F.broadcast(methods.select("method")))  # the method list is a handful of rows


def resume_pairs(expected: DataFrame, results: DataFrame, mode: str = "resume") -> DataFrame:
    """Pairs still to run: resume skips completed, retry keeps failed, cancel refuses, overwrite keeps all."""
    key = ["image_id", "method"]
    done = results.where("run_status = 'completed'").select(*key)
    if mode == "cancel":
        if any_row(expected.join(done, key, "left_semi")):
            raise ValueError("completed image-method pairs already exist")
        return expected
    if mode == "retry_failed":
        return expected.join(results.where("run_status = 'failed'").select(*key), key, "left_semi")
    return expected.join(done, key, "left_anti") if mode == "resume" else expected


def selected_images(members: DataFrame, images: DataFrame) -> DataFrame:
    """A plan's images in stored order."""
    return members.join(images, "image_id").orderBy("plan_id", "position")


def pairing_audit(results: DataFrame, expected: DataFrame) -> DataFrame:
    """Missing, unexpected, duplicate and failed pairs as one row of counts."""
    key = ["image_id", "method"]
    o = results.groupBy(*key).agg(F.count("*").alias("n"), F.count(F.when(F.col("run_status") != "completed", 1)).alias("bad"))
    j = o.join(expected.select(*key).distinct().withColumn("e", F.lit(1)), key, "full")
    n = lambda c: F.count(F.when(c, 1))
    a = j.agg(n(F.col("e").isNotNull()).alias("expected_rows"), F.coalesce(F.sum("n"), F.lit(0)).alias("actual_rows"), n(F.col("n").isNotNull()).alias("unique_pairs"),
              n(F.col("n").isNull()).alias("missing_pairs"), n(F.col("e").isNull()).alias("unexpected_pairs"), F.coalesce(F.sum("bad"), F.lit(0)).alias("failed_rows"))
    return (a.withColumn("duplicate_pair_count", F.col("actual_rows") - F.col("unique_pairs"))
            .withColumn("complete", (F.col("missing_pairs") + F.col("unexpected_pairs") + F.col("failed_rows") + F.col("duplicate_pair_count")) == 0))


def pair_difference(results: DataFrame, expected: DataFrame) -> DataFrame:
    key = ["image_id", "method"]
    a, b = expected.select(*key), results.select(*key)
    return a.subtract(b).withColumn("side", F.lit("missing")).unionByName(b.subtract(a).withColumn("side", F.lit("unexpected")))


def progress_state(results: DataFrame, totals: DataFrame) -> DataFrame:
    """State of each (plan, version) from its pair counts; a plan without rows is planned."""
    key = ["plan_id", "experiment_version"]
    g = results.groupBy(*key).agg(F.count(F.when(F.col("run_status") == "completed", 1)).alias("done"), F.count(F.when(F.col("run_status") == "failed", 1)).alias("errors"))
    j = totals.join(g, key, "left")
    done, errors = F.coalesce("done", F.lit(0)), F.coalesce("errors", F.lit(0))
    state = (F.when(F.col("done").isNull(), "planned").when(F.col("cancelled"), "cancelled").when((done >= F.col("total_pairs")) & (errors == 0), "completed")
             .when(done > 0, "partially_completed").otherwise("failed"))
    return j.select(*key, "total_pairs", done.alias("completed_pairs"), errors.alias("failed_pairs"), state.alias("state"))


def identity_check(selection: DataFrame, samples: DataFrame) -> DataFrame:
    """Positions where supplied samples differ from the frozen selection, with the reason."""
    a = selection.select("position", *[F.col(c).alias(f"a_{c}") for c in ("image_id", "sha256_hash", "role")])
    b = samples.select("position", *[F.col(c).alias(f"b_{c}") for c in ("image_id", "sha256_hash", "role")])
    j = a.join(b, "position", "full")
    why = (F.when(F.col("b_image_id").isNull(), "missing sample").when(F.col("a_image_id").isNull(), "extra sample").when(F.col("a_image_id") != F.col("b_image_id"), "image order")
           .when(F.col("a_sha256_hash") != F.col("b_sha256_hash"), "content hash").when(F.col("a_role") != F.col("b_role"), "role"))
    return j.select("position", why.alias("difference")).where("difference is not null")


def next_version(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg((F.coalesce(F.max("experiment_version"), F.lit(0)) + 1).alias("next_version"))


def clone_version(rows: DataFrame, version: Column) -> DataFrame:
    return rows.withColumn("experiment_version", version)


def batch_failures(items: DataFrame, order: str, valid: Column) -> DataFrame:
    """Every item with its input index and outcome; a repeated id fails."""
    idx = ranked(items, [], [(order, True)], "input_index")
    seen = items.groupBy("item_id").agg(F.min(order).alias("__first"))
    j = idx.join(seen, "item_id")
    status = F.when(F.col(order) != F.col("__first"), "duplicate id").when(~valid, "failed").otherwise("completed")
    return j.select((F.col("input_index") - 1).alias("input_index"), "item_id", status.alias("status"))


# ---- v2 rows ------------------------------------------------------------------------------
def result_rows(results: DataFrame, hashes: Mapping[str, Column], payload: Sequence[str]) -> DataFrame:
    """Content-addressed result rows with provenance hashes and a canonical JSON payload."""
    ident = F.sha2(F.concat_ws("\x1f", "plan_id", F.col("experiment_version").cast("string"), F.col("image_id").cast("string"), "method"), 256)
    body = F.to_json(F.struct(*[F.col(c) for c in sorted(payload)]), {"ignoreNullFields": "false"})
    failed = F.col("run_status") == "failed"
    return results.select(ident.alias("result_id"), "image_id", "method", *[c.alias(n) for n, c in hashes.items()], F.col("run_status").alias("completion_status"),
                          F.when(~failed, F.sha2(body, 256)).alias("payload_sha256"), F.when(failed, "RuntimeError").alias("error_type"))


def row_faults(rows: DataFrame, hash_columns: Sequence[str]) -> DataFrame:
    """Rule violations of result rows: hash shape, status, JSON, finite scores, positive ranks."""
    f = [F.when(~is_sha256(F.col(c)), F.lit(f"{c} is not a SHA-256")) for c in hash_columns]
    f += [F.when(~F.col("completion_status").isin("completed", "failed", "skipped"), "invalid completion status"),
          F.when(F.isnan("score") | F.col("score").isNull(), "scores must be finite"), F.when(F.col("rank") <= 0, "ranks are positive"),
          F.when((F.col("status") == "no_anomaly") & (F.col("truths") > 0), "clean image with truths"), F.when((F.col("status") == "anomaly_present") & (F.col("truths") == 0), "positive image without truths")]
    return rows.select("result_id", listed(f).alias("faults"))


def canonical_truth(status: DataFrame, objects: DataFrame) -> DataFrame:
    """Verdict on every image's ground truth: objects against its declared status."""
    g = objects.groupBy("image_id").agg(F.count("*").alias("objects"), F.sum("pixels").alias("pixels"), F.count(F.when(F.col("pixels") == 0, 1)).alias("empty"))
    n, px = F.coalesce("objects", F.lit(0)), F.coalesce("pixels", F.lit(0))
    clean = F.col("status") == "no_anomaly"
    v = (F.when(clean & (n == 0), "valid").when(clean & (px == 0), "legacy_empty_clean_mask").when(clean, "clean_with_objects").when(n == 0, "positive_without_objects")
         .when(F.col("empty") > 0, "empty_mask").otherwise("valid"))
    return status.join(g, "image_id", "left").select("image_id", "status", n.alias("objects"), v.alias("verdict"))


def attempt_invariants(rows: DataFrame, attempts: DataFrame) -> DataFrame:
    """Broken counter rules of each attempt; an empty text means it may be appended."""
    n = lambda s: F.count(F.when(F.col("completion_status") == s, 1))
    g = rows.groupBy("attempt_id").agg(F.count("*").alias("stored"), n("completed").alias("oc"), n("failed").alias("of"), n("skipped").alias("os"))
    pairs = rows.groupBy("attempt_id", "image_id", "method").count().groupBy("attempt_id").agg(F.count("*").alias("unique_pairs"))
    j = attempts.join(g, "attempt_id", "left").join(pairs, "attempt_id", "left")
    c = F.col
    f = [F.when(c("attempted") != c("completed") + c("failed") + c("skipped"), "attempted is not completed + failed + skipped"),
         F.when(F.coalesce(c("stored"), F.lit(0)) != c("attempted"), "stored rows differ from attempted"), F.when(c("unique_pairs") != c("stored"), "duplicate pairs"),
         F.when((c("oc") != c("completed")) | (c("of") != c("failed")) | (c("os") != c("skipped")), "counters differ from row statuses"),
         F.when(c("attempted") > c("expected"), "attempted exceeds expected"),
         F.when((c("status") == "completed") & ((c("attempted") != c("expected")) | (c("failed") + c("skipped") > 0)), "completed attempt is incomplete")]
    return j.select("attempt_id", listed(f).alias("faults"))


def append_attempt(rows: DataFrame, attempts: DataFrame, path: str) -> None:
    """Write the rows first and the attempt last; readers join attempts, so half a write is invisible."""
    if any_row(attempt_invariants(rows, attempts).where("faults <> ''")):
        raise ValueError("attempt breaks its invariants")
    rows.write.mode("append").partitionBy("attempt_id").parquet(f"{path}/rows")
    attempts.write.mode("append").parquet(f"{path}/attempts")


def visible_rows(rows: DataFrame, attempts: DataFrame) -> DataFrame:
    return rows.join(attempts.select("attempt_id").distinct(), "attempt_id", "left_semi")


def ledger_state(events: DataFrame) -> DataFrame:
    """Per ledger: may a primary attempt start, and do finishes match their start?"""
    started, finished = F.col("event") == "started", F.col("event") == "finished"
    n = lambda c: F.count(F.when(c, 1))
    g = events.groupBy("ledger_id").agg(n(started).alias("starts"), n(finished).alias("finishes"), F.min(F.when(started, F.col("attempt_id"))).alias("s"),
                                        F.min(F.when(finished, F.col("attempt_id"))).alias("f0"), F.max(F.when(finished, F.col("attempt_id"))).alias("f1"))
    ok = (F.col("starts") == 1) & (F.col("finishes") <= 1) & (F.coalesce("f0", "s") == F.col("s")) & (F.coalesce("f1", "s") == F.col("s"))
    return g.select("ledger_id", "starts", "finishes", (F.col("starts") == 0).alias("may_start"), F.coalesce(ok, F.lit(False)).alias("consistent"))


# ---- exports ------------------------------------------------------------------------------
def candidate_export(rows: DataFrame, run: DataFrame) -> DataFrame:
    """Flat text table: run metadata repeated on every row, nulls shown as N/A."""
    return rows.crossJoin(F.broadcast(run)).select(*[na(F.col(c)).alias(c) for c in [*run.columns, *rows.columns]])  # one metadata row


def yolo_export(regions: DataFrame, classes: Sequence[str], width: int, height: int, parts: int = 500) -> DataFrame:
    """YOLO box and segment lines, one text part per image and 500 regions (parts concatenate in order)."""
    cls = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("label")) - 1
    x1, y1, x2, y2 = [F.col(c).cast("double") for c in ("x1", "y1", "x2", "y2")]
    box = F.format_string("%d %.6f %.6f %.6f %.6f", cls, (x1 + x2) / 2 / width, (y1 + y2) / 2 / height, (x2 - x1) / width, (y2 - y1) / height)
    seg = F.format_string("%d %.6f %.6f %.6f %.6f %.6f %.6f %.6f %.6f", cls, x1 / width, y1 / height, x2 / width, y1 / height, x2 / width, y2 / height, x1 / width, y2 / height)
    ok = regions.where(F.col("accepted") & ~F.col("label").isin("", "unassigned", "ignore"))
    pos = ranked(ok, ["image_id"], [("box_id", True)], "__p")
    rows = pos.select("image_id", F.floor((F.col("__p") - 1) / parts).alias("part"), F.struct("__p", box.alias("b"), seg.alias("s")).alias("r"))
    g = rows.groupBy("image_id", "part").agg(F.array_sort(F.collect_list("r")).alias("r"))
    return g.select("image_id", "part", F.array_join(F.transform("r", lambda v: v["b"]), "\n").alias("boxes"), F.array_join(F.transform("r", lambda v: v["s"]), "\n").alias("segments"))


def unlabelled_accepted(regions: DataFrame) -> DataFrame:
    return regions.where(F.col("accepted") & F.col("label").isin("", "unassigned", "ignore"))


def stage_timings(timings: DataFrame, required: Sequence[str]) -> DataFrame:
    """(run, stage, seconds) rows from a timing map, and the required stages it lacks."""
    lack = F.array_join(F.array_except(F.array(*[F.lit(s) for s in required]), F.map_keys("timings")), ",")
    return timings.select("run_id", lack.alias("missing_stages"), F.explode("timings").alias("stage", "seconds"))


def ablation_matrix(images: DataFrame, configurations: DataFrame) -> DataFrame:
    """Snapshot hash of every configuration and the pairs it has to run."""
    snap = canonical_hash({"configuration_id": F.col("configuration_id"), "disabled_components": F.col("disabled_components")})
    n = images.agg(F.count("*").alias("images"))
    return configurations.withColumn("snapshot_hash", snap).crossJoin(F.broadcast(n))  # one row


def config_faults(configs: DataFrame, ranges: Mapping[str, tuple[float, float]], keys: Sequence[str], ordered: Sequence[tuple[str, str]] = (), weights: Sequence[str] = ()) -> DataFrame:
    """Range, key-set, order and weight-total rules over configuration rows."""
    f = [F.when(F.col(c).isNull() | (F.col(c) < lo) | (F.col(c) > hi), F.lit(f"{c} outside [{lo:g}, {hi:g}]")) for c, (lo, hi) in ranges.items()]
    f += [F.when(F.col(a) >= F.col(b), F.lit(f"{a} must be below {b}")) for a, b in ordered]
    want = F.array(*[F.lit(k) for k in keys])
    f += [F.when(F.size(F.array_union(F.array_except("keys", want), F.array_except(want, F.col("keys")))) > 0, "configuration keys differ")]
    if weights:
        total = F.lit(0.0)
        for w in weights:
            total = total + F.col(w)
        f.append(F.when(total <= 0, "weights must have a positive total"))
    return configs.select("config_id", listed(f).alias("faults"))


# ---- legacy -------------------------------------------------------------------------------
LEGACY_REQUIRED = ["record_id", "review_status", "not_reviewed", "experiment_status"]


def legacy_split(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows lacking a required field, rows that have them all)."""
    lack = F.lit(False)
    for c in LEGACY_REQUIRED:
        lack = lack | F.col(c).isNull()
    return rows.where(lack), rows.where(~lack)


def migrate_legacy(rows: DataFrame) -> DataFrame:
    """Legacy rows in the current shape: defaults per column, baseline methods never reviewed."""
    d = lambda c, v: F.coalesce(F.col(c), F.lit(v)).alias(c)
    method = F.coalesce("method", F.lit("refined contextual method"))
    base = method != "refined contextual method"
    n = F.coalesce("final_proposals", F.lit(0))
    own = lambda c: F.when(~base, F.col(c)).alias(c)
    return rows.select(d("experiment_id", "legacy"), d("experiment_version", 1), d("reviewer_id", "unknown"), d("experiment_status", "Development / Test"), d("image_filename", "unknown"),
                       method.alias("method"), F.when(base, "not_reviewed").otherwise(F.coalesce("review_status", F.lit("partially_reviewed"))).alias("review_status"), n.alias("final_proposals"),
                       own("accepted"), own("rejected"), own("uncertain"), F.when(base, n).otherwise(F.coalesce("not_reviewed", F.lit(0))).alias("not_reviewed"),
                       d("image_outcome", "uncertain"), d("ground_truth_status", "unknown"))
