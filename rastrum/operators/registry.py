"""Dataset registry: scans, registration, ingestion rules, annotations, lifecycle, file manifests."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..core import any_row
from ..functions.exprs import outcome_of, stem, suffix, unsafe_path
from .overlap import duplicate_lookup

# Accepted enumerations of the metadata.
SOURCE_TYPES = ["professor-provided", "public research dataset", "self-captured", "synthetic", "local development image", "other"]
TRUTH_OPTIONS = ["verified expert annotation", "verified dataset annotation", "reviewer-estimated", "no annotation", "unknown"]
ANNOTATION_FORMATS = ["none", "YOLO bounding boxes", "YOLO segmentation", "COCO JSON", "Pascal VOC", "binary masks", "CSV regions", "custom"]
IMAGE_SUFFIXES = [".jpg", ".jpeg", ".png", ".bmp", ".tif", ".tiff", ".webp"]
ANNOTATION_SUFFIXES = [".txt", ".json", ".xml", ".csv", ".png"]
REQUIRED = ["dataset_id", "dataset_name", "dataset_version", "source_type", "source_name", "provider_author", "licence", "date_acquired",
            "domain_category", "ground_truth_status", "annotation_format"]
FINAL_STATUS = "Final Research Evaluation"
REVIEW_OUTCOMES = ["anomaly present", "no anomaly", "uncertain"]


def blank(c: str) -> Column:
    return F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == ""


def listed(parts: list[Column], sep: str = "; ") -> Column:
    """Join the parts that are not null."""
    return F.array_join(F.filter(F.array(*parts), lambda v: v.isNotNull()), sep)


# ---- rules --------------------------------------------------------------------------------
def metadata_faults(meta: DataFrame) -> DataFrame:
    missing = listed([F.when(blank(c), F.lit(c)) for c in REQUIRED], ", ")
    bad = listed([
        F.when(missing != "", F.concat(F.lit("missing: "), missing)),
        F.when(~F.col("source_type").isin(SOURCE_TYPES), "unsupported source type"),
        F.when(~F.col("ground_truth_status").isin(TRUTH_OPTIONS), "unsupported ground-truth status"),
        F.when(~F.col("annotation_format").isin(ANNOTATION_FORMATS), "unsupported annotation format"),
        F.when(F.col("dataset_id").rlike("[^A-Za-z0-9_-]"), "dataset_id characters")])
    return meta.select("dataset_id", "dataset_version", bad.alias("faults"))


def final_gate(meta: DataFrame) -> DataFrame:
    """What a final experiment would still need."""
    problems = listed([
        F.when(F.col("ground_truth_status").isin("unknown", "no annotation"), "verified or reviewer-estimated ground truth"),
        F.when(blank("source_name") | blank("provider_author") | blank("licence"), "source, provider, and licence metadata"),
        F.when(F.lower("licence") == "unknown", "known licence")], ", ")
    return meta.select("dataset_id", "dataset_version", problems.alias("problems"), (problems == "").alias("final_allowed"))


def licence_gate(meta: DataFrame, override: bool = False) -> DataFrame:
    known = ~blank("licence") & (F.lower("licence") != "unknown")
    ok = F.col("redistribution_allowed") & known
    reason = (F.when(ok, "Licence metadata permits redistribution.")
              .otherwise("Licence override recorded." if override else "Unknown or restricted licence: explicit override is required for a public export."))
    return meta.select("dataset_id", "dataset_version", (ok | F.lit(override)).alias("export_allowed"), reason.alias("reason"))


# ---- scans and writes ---------------------------------------------------------------------
def registry_scan(images: DataFrame, dataset_id: str | None = None) -> DataFrame:
    return images.where(F.col("dataset_id") == dataset_id) if dataset_id else images


def register_dataset(datasets: DataFrame, incoming: DataFrame, overwrite: bool = False) -> DataFrame:
    """The registry after registration; an existing (id, version) is refused unless overwritten."""
    key = ["dataset_id", "dataset_version"]
    new = incoming.select(*key)
    if not overwrite and any_row(datasets.join(new, key, "left_semi")):
        raise ValueError("dataset id and version already exist")
    return datasets.join(new, key, "left_anti").unionByName(incoming.select(*datasets.columns))


def latest_metadata(datasets: DataFrame) -> DataFrame:
    """Newest version of every dataset (larger version wins a tie)."""
    row = F.struct(*datasets.columns)
    return (datasets.groupBy(F.col("dataset_id").alias("__d")).agg(F.max_by(row, F.struct("registered_timestamp", "dataset_version")).alias("r")).select("r.*"))


def ingest_manifest(files: DataFrame, meta: dict[str, str]) -> DataFrame:
    """Manifest rows for files: status, suffix, stored name, outcome and duplicate evidence.

    ``files``: image_id, original_filename, sha256_hash, perceptual_hash, width, height, file_size,
    decoded (did the codec open it), anomaly_type. Duplicates refer to the smallest earlier id.
    """
    sfx = suffix(F.col("original_filename"))
    side = lambda c: (F.col(c) < 8) | (F.col(c) > 20000)
    status = (F.when(F.col("file_size") == 0, "zero-byte").when(~sfx.isin(IMAGE_SUFFIXES), "unsupported format").when(~F.col("decoded"), "corrupt")
              .when(side("width") | side("height"), "extreme resolution").otherwise("valid"))
    rows = files.select("*", status.alias("corruption_status"), F.regexp_replace(sfx, r"^\.", "").alias("file_format"),
                        F.concat_ws("_", F.substring("sha256_hash", 1, 12), F.regexp_extract("original_filename", r"([^/]*)$", 1)).alias("stored_filename"),
                        outcome_of(F.col("anomaly_type")).alias("image_outcome"), F.lit("unassigned").alias("split"),
                        F.when(F.coalesce(F.col("anomaly_type"), F.lit("")) != "", F.concat(F.lit("template:"), "anomaly_type")).otherwise("").alias("template_group_id"),
                        *[F.lit(v).alias(k) for k, v in meta.items()])
    # only an opened image has a perceptual hash
    opened = F.col("corruption_status").isin("valid", "extreme resolution")
    return duplicate_lookup(rows.withColumn("perceptual_hash", F.when(opened, F.col("perceptual_hash"))))


def read_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Path, size and content hash of every file under a folder, hashed where it is read."""
    return (spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
            .select("path", F.col("length").alias("file_size"), F.sha2("content", 256).alias("sha256_hash"), "content"))


def review_append(reviews: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted rows, refused rows): a known outcome and a reviewer are required."""
    ok = F.coalesce(F.col("outcome").isin(REVIEW_OUTCOMES) & ~blank("reviewer_id"), F.lit(False))
    return reviews.where(ok), reviews.where(~ok)


def manifest_export(datasets: DataFrame, images: DataFrame) -> DataFrame:
    """One JSON line per registry row; written with ``df.write.text`` from every task at once."""
    line = lambda df, kind: df.select(F.to_json(F.struct(F.lit(kind).alias("table"), F.struct(*sorted(df.columns)).alias("row"))).alias("value"))
    return line(datasets, "datasets").unionByName(line(images, "images"))


# ---- archives and annotations ---------------------------------------------------------------
MEMBER = T.StructType([T.StructField("archive", T.StringType()), T.StructField("name", T.StringType()), T.StructField("kind", T.StringType()),
                       T.StructField("file_size", T.LongType()), T.StructField("content", T.BinaryType())])


def zip_expand(archives: DataFrame) -> DataFrame:
    """Members of each archive as rows; folders, empty and parent-escaping members are dropped."""
    def expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting, size = [], 0
        for batch in batches:
            for path, data in zip(batch["path"], batch["content"]):
                with zipfile.ZipFile(io.BytesIO(data)) as z:
                    for m in z.infolist():
                        parts = m.filename.split("/")
                        if m.is_dir() or not m.file_size or ".." in parts or not parts[-1]:
                            continue
                        dot = parts[-1].rfind(".")
                        kind = "image" if dot > 0 and parts[-1][dot:].lower() in IMAGE_SUFFIXES else "annotation"
                        if waiting and size + m.file_size > 16_000_000:  # members go on in frames of bounded size
                            yield pd.DataFrame(waiting, columns=MEMBER.names)
                            waiting, size = [], 0
                        waiting.append((path, parts[-1], kind, m.file_size, z.read(m)))
                        size += m.file_size
        if waiting:
            yield pd.DataFrame(waiting, columns=MEMBER.names)
    return archives.select("path", "content").mapInPandas(expand, MEMBER)


def annotation_match(images: DataFrame, annotations: DataFrame) -> DataFrame:
    """Annotation file of each image: same stem, first suffix in priority order."""
    order = F.array_position(F.array(*[F.lit(s) for s in ANNOTATION_SUFFIXES]), suffix(F.col("name")))
    a = annotations.select(stem(F.col("name")).alias("stem"), "name", order.alias("pri")).where("pri > 0")
    best = a.groupBy("stem").agg(F.min_by("name", "pri").alias("annotation"))
    return images.withColumn("stem", stem(F.col("original_filename"))).join(best, "stem", "left").drop("stem")


def yolo_rows(files: DataFrame) -> DataFrame:
    """(image_id, valid, classes) from YOLO text: integer class, coordinates within [0, 1]."""
    lines = F.filter(F.split("text", r"\r?\n"), lambda v: F.length(v) > 0)
    parts = F.transform(lines, lambda v: F.split(F.trim(v), r"\s+"))
    nums = lambda p: F.transform(F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))), lambda v: v.try_cast("double"))
    ok = F.forall(parts, lambda p: F.try_element_at(p, F.lit(1)).try_cast("int").isNotNull() & (F.size(p) > 1)
                  & F.forall(nums(p), lambda v: F.coalesce((v >= 0) & (v <= 1), F.lit(False))))
    return files.select("image_id", *[c for c in files.columns if c == "part"], ((F.col("width") > 0) & (F.col("height") > 0) & ok).alias("valid"), F.transform(parts, lambda p: p[0]).alias("classes"))


COCO = "annotations array<struct<id:bigint,category_id:string,bbox:array<double>>>"
VOC = "object array<struct<name:string,bndbox:struct<xmin:double,ymin:double,xmax:double,ymax:double>>>"


def coco_rows(files: DataFrame) -> DataFrame:
    """COCO JSON: unique ids, boxes inside the image; malformed JSON is invalid."""
    j = files.withColumn("a", F.from_json("text", COCO, {"mode": "PERMISSIVE"})["annotations"])
    inside = F.forall("a", lambda x: F.coalesce((F.size(x["bbox"]) == 4) & F.forall(x["bbox"], lambda v: v >= 0)
                      & (x["bbox"][0] + x["bbox"][2] <= F.col("width")) & (x["bbox"][1] + x["bbox"][3] <= F.col("height")), F.lit(False)))
    unique = F.size(F.array_distinct(F.transform("a", lambda x: x["id"]))) == F.size("a")
    parsed = F.try_parse_json("text").isNotNull()
    ok = parsed & F.coalesce(inside & unique, F.lit(True))
    return j.select("image_id", *[c for c in files.columns if c == "part"], (ok & (F.col("width") > 0) & (F.col("height") > 0)).alias("valid"),
                    F.coalesce(F.transform("a", lambda x: x["category_id"]), F.array().cast("array<string>")).alias("classes"))


def _box_ok(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.coalesce((x1 >= 0) & (y1 >= 0) & (x2 <= F.col("width")) & (y2 <= F.col("height")) & (x2 > x1) & (y2 > y1), F.lit(False))


def voc_rows(files: DataFrame) -> DataFrame:
    """Pascal VOC XML: every box ordered and inside the image; malformed XML is invalid."""
    j = files.withColumn("o", F.from_xml("text", VOC, {"rowTag": "annotation"}))
    whole = F.col("text").rlike(r"</annotation>\s*$")
    b = lambda x, c: F.floor(x["bndbox"][c])
    ok = F.coalesce(F.forall(F.col("o.object"), lambda x: _box_ok(b(x, "xmin"), b(x, "ymin"), b(x, "xmax"), b(x, "ymax"))), F.lit(True))
    return j.select("image_id", *[c for c in files.columns if c == "part"], (whole & ok & (F.col("width") > 0)).alias("valid"),
                    F.coalesce(F.transform(F.col("o.object"), lambda x: F.coalesce(x["name"], F.lit("unknown"))), F.array().cast("array<string>")).alias("classes"))


def csv_rows(files: DataFrame) -> DataFrame:
    """CSV with header ``x1,y1,x2,y2,class``: at least one row, every box ordered and inside."""
    lines = F.filter(F.split("text", r"\r?\n"), lambda v: F.length(v) > 0)
    body = F.transform(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), lambda v: F.from_csv(v, F.lit("x1 double, y1 double, x2 double, y2 double, class string")))
    ok = (F.size(body) > 0) & F.forall(body, lambda r: _box_ok(r["x1"], r["y1"], r["x2"], r["y2"]))
    return files.select("image_id", *[c for c in files.columns if c == "part"], ok.alias("valid"), F.transform(body, lambda r: F.coalesce(r["class"], F.lit("unknown"))).alias("classes"))


# ---- reports ------------------------------------------------------------------------------
def validation_report(manifest: DataFrame) -> DataFrame:
    """Totals as one row per dataset; histograms stay tables (`histogram`)."""
    n = lambda c: F.count(F.when(c, 1))
    return manifest.groupBy("dataset_id").agg(
        F.count("*").alias("total_files"), n(F.col("corruption_status") == "valid").alias("valid_images"), n(F.col("corruption_status") != "valid").alias("corrupted_files"),
        n(F.col("duplicate_type") == "exact image duplicate").alias("exact_duplicates"), n(F.col("duplicate_type") == "near duplicate").alias("possible_near_duplicates"),
        n(F.col("image_outcome") != "").alias("annotated_images"), n(F.col("image_outcome") == "").alias("unannotated_images"),
        F.count_distinct("anomaly_type").alias("classes"), F.count_distinct("width", "height").alias("image_sizes"))


def histogram(manifest: DataFrame, *keys: str) -> DataFrame:
    return manifest.groupBy(*keys).agg(F.count("*").alias("images"))


def dataset_dashboard(datasets: DataFrame, manifest: DataFrame) -> DataFrame:
    n = lambda c: F.count(F.when(c, 1))
    g = manifest.groupBy("dataset_id").agg(
        F.count("*").alias("images"), n(F.col("duplicate_type") == "exact image duplicate").alias("exact_duplicates"), n(F.col("duplicate_type") == "near duplicate").alias("near_duplicates"),
        n(F.col("split_eligible")).alias("split_eligible"), F.round(F.avg((F.col("image_outcome") != "").cast("double")), 6).alias("annotation_coverage"),
        F.count_distinct(F.when(F.col("duplicate_group_id") != "", F.col("duplicate_group_id"))).alias("duplicate_groups"), n(F.col("corruption_status") != "valid").alias("validation_warnings"))
    z = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return (datasets.select("dataset_id", "dataset_version", "licence", "ground_truth_status").join(g, "dataset_id", "left")
            .select("dataset_id", "dataset_version", "licence", "ground_truth_status", z("images"),
                    (F.coalesce("images", F.lit(0)) - F.coalesce("exact_duplicates", F.lit(0))).alias("unique_images"), z("split_eligible"), z("annotation_coverage"),
                    z("exact_duplicates"), z("near_duplicates"), z("duplicate_groups"), z("validation_warnings")))


def managed_filter(table: DataFrame, equals: dict[str, str | None], start: str | None = None, end: str | None = None) -> DataFrame:
    for c, v in equals.items():
        if v and v != "All":
            table = table.where(F.col(c) == v)
    if start and end:
        table = table.where(F.to_date(F.timestamp_seconds("registered_timestamp")).between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    return table


def case_validation(cases: DataFrame, categories: Sequence[str], positives: Sequence[str], expected: int) -> DataFrame:
    """Per category: case, failure and distinct-hash counts, and whether the category is balanced."""
    pos = F.col("category").isin(list(positives))
    fail = F.when(~F.col("category").isin(list(categories)), "invalid category").when(F.col("spread") < 2, "blank or invalid image").when(
        pos & (F.col("mask_pixels") == 0), "positive mask is empty").when(~pos & (F.col("mask_pixels") > 0), "clean mask is non-empty")
    n = lambda v: F.count(F.when(fail == v, 1))
    return cases.groupBy("category").agg(
        F.count("*").alias("cases"), n("invalid category").alias("invalid_category"), n("blank or invalid image").alias("blank_images"),
        n("positive mask is empty").alias("empty_positive_masks"), n("clean mask is non-empty").alias("nonempty_clean_masks"),
        F.count_distinct("sha256_hash").alias("unique_sha256"), F.count_distinct("perceptual_hash").alias("unique_perceptual"),
        (F.count("*") == expected).alias("balanced"))


# ---- lifecycle ----------------------------------------------------------------------------
def cleanup_preview(images: DataFrame, plans: DataFrame) -> DataFrame:
    """Files, bytes and linked experiments behind each dataset version."""
    key = ["dataset_id", "dataset_version"]
    i = images.groupBy(*key).agg(F.count("*").alias("files"), F.sum("file_size").alias("total_bytes"))
    p = plans.groupBy(*key).agg(F.count_distinct("experiment_id").alias("linked_experiments"),
                                F.count_distinct(F.when(F.col("status") == FINAL_STATUS, F.col("experiment_id"))).alias("final_experiments"))
    z = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    out = i.join(p, key, "left").select(*key, "files", "total_bytes", (F.col("files") + 1).alias("database_rows"), z("linked_experiments"), z("final_experiments"))
    return out.withColumn("deletable", (F.col("final_experiments") == 0) & (F.col("linked_experiments") == 0))


def cleanup_delete(images: DataFrame, plans: DataFrame, dataset: str, version: str | None = None, unlink: bool = False, cascade: bool = False) -> dict[str, DataFrame]:
    """Remaining images, the trash rows that can restore them, and the plans after unlink or cascade."""
    hit = F.col("dataset_id") == dataset
    if version:
        hit = hit & (F.col("dataset_version") == version)
    linked = plans.where(hit)
    if any_row(linked.where(F.col("status") == FINAL_STATUS)):
        raise ValueError("final research experiments are never deleted or unlinked")
    if any_row(linked) and not (unlink or cascade):
        raise ValueError("dataset is linked to saved experiments")
    kept = plans.where(~(hit & F.lit(cascade)))
    if unlink:
        kept = kept.withColumn("dataset_id", F.when(hit, "[deleted dataset]").otherwise(F.col("dataset_id")))
    return {"images": images.where(~hit), "trash": images.where(hit), "plans": kept}


def restore(images: DataFrame, trash: DataFrame) -> DataFrame:
    return images.join(trash.select("image_id"), "image_id", "left_anti").unionByName(trash.select(*images.columns))


def set_split_eligible(images: DataFrame, ids: DataFrame, eligible: bool) -> DataFrame:
    marked = images.join(ids.select("image_id").distinct().withColumn("__hit", F.lit(True)), "image_id", "left")
    return (marked.withColumn("split_eligible", F.when(F.col("__hit"), F.lit(eligible)).otherwise(F.col("split_eligible")))
            .withColumn("split", F.when(F.col("__hit"), "unassigned").otherwise(F.col("split"))).drop("__hit"))


def backfill(images: DataFrame, datasets: DataFrame) -> DataFrame:
    """Fill columns added later: version, duplicate type, outcome, template and source groups."""
    newest = latest_metadata(datasets).select("dataset_id", F.col("dataset_version").alias("__v"))
    j = images.join(newest, "dataset_id", "left")
    e = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    kind = (F.when(F.col("duplicate_status") == "exact duplicate", "exact image duplicate").when(F.col("duplicate_status") == "possible near duplicate", "near duplicate").otherwise("unique"))
    return (j.withColumn("dataset_version", F.when(e("dataset_version"), F.coalesce("__v", F.lit(""))).otherwise(F.col("dataset_version")))
            .withColumn("duplicate_type", F.when(e("duplicate_type"), kind).otherwise(F.col("duplicate_type")))
            .withColumn("split_eligible", F.col("split_eligible") & (F.col("duplicate_type") != "exact image duplicate"))
            .withColumn("image_outcome", F.when(e("image_outcome"), outcome_of(F.col("anomaly_type"))).otherwise(F.col("image_outcome")))
            .withColumn("template_group_id", F.when(e("template_group_id") & ~e("anomaly_type"), F.concat(F.lit("template:"), "anomaly_type")).otherwise(F.col("template_group_id")))
            .withColumn("source_group_id", F.when(e("source_group_id"), F.coalesce("group_id", F.lit(""))).otherwise(F.col("source_group_id"))).drop("__v"))


# ---- file manifests -----------------------------------------------------------------------
def hash_manifest_verify(declared: DataFrame, actual: DataFrame) -> DataFrame:
    """Status of every path on either side."""
    d = declared.select("path", F.col("sha256").alias("declared_sha"))
    a = actual.select("path", F.col("sha256").alias("actual_sha"))
    status = (F.when(unsafe_path(F.col("path")), "bad path").when(F.col("actual_sha").isNull(), "missing").when(F.col("declared_sha").isNull(), "extra")
              .when(F.col("declared_sha") != F.col("actual_sha"), "changed").otherwise("ok"))
    return d.join(a, "path", "full").select("path", status.alias("status"))


def path_prefix_join(paths: DataFrame, rules: DataFrame, role: str) -> DataFrame:
    """Translate stored paths by prefix rule; unsafe, wrong-role and ambiguous paths are refused.

    A rule matches a path on a folder boundary, so a path meets the rules by an equi-join on its
    own leading folders instead of by testing every rule.
    """
    parts = F.split("stored_path", "/")
    lead = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    unsafe = F.array_contains(F.split(F.regexp_replace("stored_path", r"\\", "/"), "/"), "..") | (F.col("stored_path") == "")
    hits = (paths.select("stored_path", F.explode(F.array_distinct(lead)).alias("stored_prefix")).join(rules, "stored_prefix")
            .groupBy("stored_path").agg(F.count(F.when(F.col("role") == role, 1)).alias("own"), F.count(F.when(F.col("role") != role, 1)).alias("other"),
                                        F.max(F.when(F.col("role") == role, F.struct("stored_prefix", "target"))).alias("rule")))
    j = paths.join(hits, "stored_path", "left")
    own, other = F.coalesce("own", F.lit(0)), F.coalesce("other", F.lit(0))
    status = F.when(unsafe, "refused: unsafe").when(other > 0, "refused: wrong role").when(own > 1, "refused: several rules").when(own == 1, "resolved").otherwise("unmapped")
    moved = F.concat(F.col("rule.target"), F.substr(F.col("stored_path"), F.length("rule.stored_prefix") + 1))
    return j.select("stored_path", status.alias("status"), F.when(status == "resolved", moved).alias("resolved_path"))
