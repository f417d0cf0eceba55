"""Dataset registry, duplicate, overlap and scalar-identity queries over the image binding."""

from pyspark.sql import functions as F


from ..functions import exprs as fx
from ..operators import overlap as ov
from ..operators import registry as rg
from ..scale import ordered_hash
from .registry import query

L, R = "(SELECT * FROM images WHERE dataset_id='d0')", "(SELECT * FROM images WHERE dataset_id='d1')"


@query("s01_registry_scan", "images", "SELECT image_id, dataset_id, sha256_hash, split, file_size FROM images WHERE dataset_id='d1'")
def _(t):
    return rg.registry_scan(t.images, "d1").select("image_id", "dataset_id", "sha256_hash", "split", "file_size")


def _incoming(t):
    return t.datasets.where("dataset_version = 'v2'").withColumn("licence", F.lit("CC-BY"))


@query("s02_register_dataset", "datasets", """SELECT dataset_id, dataset_version, CASE WHEN dataset_version='v2' THEN 'CC-BY' ELSE licence END AS licence, registered_timestamp FROM datasets""")
def _(t):
    return rg.register_dataset(t.datasets, _incoming(t), overwrite=True).select("dataset_id", "dataset_version", "licence", "registered_timestamp")


@query("s03_latest_metadata", "datasets", """SELECT dataset_id, dataset_version, licence, registered_timestamp FROM datasets
  QUALIFY row_number() OVER (PARTITION BY dataset_id ORDER BY registered_timestamp DESC, dataset_version DESC)=1""")
def _(t):
    return rg.latest_metadata(t.datasets).select("dataset_id", "dataset_version", "licence", "registered_timestamp")


_SFX = "CASE image_id%11 WHEN 0 THEN '.gif' WHEN 1 THEN '.JPG' ELSE '.png' END"
_CAT = "CASE image_id%7 WHEN 0 THEN 'thin_crack' WHEN 1 THEN 'normal_texture' WHEN 2 THEN '' ELSE 'pitting_cluster' END"


_OPENED = "perceptual_hash AS seen, CASE WHEN file_size>0 AND image_id%11<>0 AND image_id%13<>0 THEN perceptual_hash END AS perceptual_hash"


@query("s04_ingest_manifest", "images", f""", o AS (SELECT * EXCLUDE (perceptual_hash), {_OPENED} FROM images), ov AS (SELECT DISTINCT perceptual_hash AS h FROM o WHERE perceptual_hash IS NOT NULL),
 oc AS (SELECT sha256_hash, min(image_id) AS first_copy FROM o GROUP BY 1), oh AS (SELECT perceptual_hash AS h, min(image_id) AS m FROM o GROUP BY 1),
 onear AS (SELECT a.h AS perceptual_hash, min(m) AS first_near FROM ov a JOIN ov b ON bit_count(xor(a.h,b.h))<=3 JOIN oh ON b.h=oh.h GROUP BY 1),
 om AS (SELECT o.*, CASE WHEN first_copy<image_id THEN 'exact image duplicate' WHEN first_near<image_id THEN 'near duplicate' ELSE 'unique' END AS duplicate_type,
  CASE WHEN first_copy<image_id THEN first_copy WHEN first_near<image_id THEN first_near END AS canonical_image_id,
  CASE WHEN first_copy<image_id THEN 'sha256:'||sha256_hash WHEN first_near<image_id THEN 'near:'||first_near ELSE '' END AS duplicate_group_id,
  NOT first_copy<image_id AS split_eligible FROM o LEFT JOIN oc USING (sha256_hash) LEFT JOIN onear USING (perceptual_hash)),
 f AS (SELECT *, 'in/doc_'||image_id||{_SFX} AS fname, {_CAT} AS cat FROM om)
 SELECT image_id, substr(sha256_hash,1,12)||'_doc_'||image_id||{_SFX} AS stored_filename, lower(substr({_SFX},2)) AS file_format, CASE WHEN file_size=0 THEN 'zero-byte' WHEN image_id%11=0 THEN 'unsupported format'
   WHEN image_id%13=0 THEN 'corrupt' WHEN width<8 OR height<8 THEN 'extreme resolution' ELSE 'valid' END AS corruption_status,
  CASE WHEN cat IN ('thin_crack','pitting_cluster') THEN 'anomaly_present' WHEN cat<>'' THEN 'no_anomaly' ELSE '' END AS image_outcome, CASE WHEN cat<>'' THEN 'template:'||cat ELSE '' END AS template_group_id,
  'unassigned' AS split, duplicate_type, canonical_image_id, duplicate_group_id, split_eligible, 'lab' AS source FROM f""")
def _(t):
    k = F.col("image_id")
    sfx = F.when(k % 11 == 0, ".gif").when(k % 11 == 1, ".JPG").otherwise(".png")
    cat = F.when(k % 7 == 0, "thin_crack").when(k % 7 == 1, "normal_texture").when(k % 7 == 2, "").otherwise("pitting_cluster")
    files = t.images.select("image_id", F.concat(F.lit("in/doc_"), k.cast("string"), sfx).alias("original_filename"), "sha256_hash", "perceptual_hash", "width", "height", "file_size",
                            (k % 13 != 0).alias("decoded"), cat.alias("anomaly_type"))
    return rg.ingest_manifest(files, {"source": "lab"}).select(
        "image_id", "stored_filename", "file_format", "corruption_status", "image_outcome", "template_group_id", "split", "duplicate_type", "canonical_image_id",
        "duplicate_group_id", "split_eligible", "source")


# ---- annotations derived from the boxes of each image --------------------------------------
def _parts(t):
    """Boxes in annotation files of at most 500 regions, so no file grows with a hot image."""
    return t.boxes.withColumn("part", F.floor((F.col("box_id") - 1) / 500))


@query("s06_annotation_yolo", "boxes", """SELECT image_id, (box_id-1)//500 AS part, bool_and(x2<=40 AND y2<=40) AS valid, count(*) AS regions FROM boxes GROUP BY 1,2""")
def _(t):
    n = lambda c: F.format_string("%.6f", F.col(c) / 40.0)
    line = F.concat_ws(" ", (F.col("l_linenumber") % 4).cast("string"), n("x1"), n("y1"), n("x2"), n("y2"))
    files = _parts(t).groupBy("image_id", "part").agg(F.array_join(F.collect_list(line), "\n").alias("text")).withColumn("width", F.lit(40)).withColumn("height", F.lit(40))
    return rg.yolo_rows(files).select("image_id", "part", "valid", F.size("classes").cast("bigint").alias("regions"))


@query("s06_annotation_coco", "boxes", """SELECT image_id, (box_id-1)//500 AS part, bool_and(x2<=36 AND y2<=36) AND count(DISTINCT l_linenumber)=count(*) AS valid, count(*) AS regions FROM boxes GROUP BY 1,2""")
def _(t):
    ann = F.struct(F.col("l_linenumber").alias("id"), F.col("flag").alias("category_id"), F.array("x1", "y1", F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")).alias("bbox"))
    files = (_parts(t).groupBy("image_id", "part").agg(F.to_json(F.struct(F.collect_list(ann).alias("annotations"))).alias("text")).withColumn("width", F.lit(36)).withColumn("height", F.lit(36)))
    return rg.coco_rows(files).select("image_id", "part", "valid", F.size("classes").cast("bigint").alias("regions"))


@query("s06_annotation_voc", "boxes", """SELECT image_id, (box_id-1)//500 AS part, bool_and(x2<=36 AND y2<=36) AS valid, count(*) AS regions FROM boxes GROUP BY 1,2""")
def _(t):
    obj = F.format_string("<object><name>%s</name><bndbox><xmin>%d</xmin><ymin>%d</ymin><xmax>%d</xmax><ymax>%d</ymax></bndbox></object>", "flag", "x1", "y1", "x2", "y2")
    files = (_parts(t).groupBy("image_id", "part").agg(F.concat(F.lit("<annotation>"), F.array_join(F.collect_list(obj), ""), F.lit("</annotation>")).alias("text"))
             .withColumn("width", F.lit(36)).withColumn("height", F.lit(36)))
    return rg.voc_rows(files).select("image_id", "part", "valid", F.size("classes").cast("bigint").alias("regions"))


@query("s06_annotation_csv", "boxes", """SELECT image_id, (box_id-1)//500 AS part, bool_and(x2<=36 AND y2<=36) AS valid, count(*) AS regions FROM boxes GROUP BY 1,2""")
def _(t):
    row = F.concat_ws(",", *[F.col(c).cast("string") for c in ("x1", "y1", "x2", "y2", "flag")])
    files = (_parts(t).groupBy("image_id", "part").agg(F.concat(F.lit("x1,y1,x2,y2,class\n"), F.array_join(F.collect_list(row), "\n")).alias("text"))
             .withColumn("width", F.lit(36)).withColumn("height", F.lit(36)))
    return rg.csv_rows(files).select("image_id", "part", "valid", F.size("classes").cast("bigint").alias("regions"))


@query("s07_manifest_export", "images datasets", """SELECT 'datasets' AS "table", count(*) AS n FROM datasets UNION ALL SELECT 'images', count(*) FROM images""")
def _(t):
    lines = rg.manifest_export(t.datasets, t.images)
    return lines.select(F.get_json_object("value", "$.table").alias("table")).groupBy("table").agg(F.count("*").alias("n"))


@query("s08_review_append", "", """SELECT event_id, event_type<>'signup' AND user_id%9<>0 AS accepted FROM events""")
def _(t):
    o = F.when(F.col("event_type") == "purchase", "anomaly present").when(F.col("event_type") == "error", "uncertain").when(F.col("event_type") == "signup", "maybe").otherwise("no anomaly")
    rows = t.read("events").select("event_id", o.alias("outcome"), F.when(F.col("user_id") % 9 == 0, "  ").otherwise(F.concat(F.lit("rev-"), "user_id")).alias("reviewer_id"))
    ok, bad = rg.review_append(rows)
    return ok.select("event_id", F.lit(True).alias("accepted")).unionByName(bad.select("event_id", F.lit(False).alias("accepted")))


@query("s25_hash_manifest_build", "", "SELECT 'doc_'||doc_id||'.png' AS path, CAST(strlen(text) AS BIGINT) AS file_size, sha256(text) AS sha256 FROM documents")
def _(t):
    d = t.read("documents")  # the file body is the document text
    return d.select(F.concat(F.lit("doc_"), "doc_id", F.lit(".png")).alias("path"), F.octet_length("text").cast("bigint").alias("file_size"), F.sha2("text", 256).alias("sha256"))


_PATH = "CASE WHEN image_id%23=0 THEN '../'||original_filename ELSE original_filename END"


@query("s26_hash_manifest_verify", "images", f"""SELECT {_PATH} AS path, CASE WHEN image_id%23=0 THEN 'bad path' WHEN image_id%5=0 THEN 'missing' WHEN image_id%7=0 THEN 'extra' WHEN image_id%3=0 THEN 'changed' ELSE 'ok' END AS status
  FROM images WHERE NOT (image_id%5=0 AND image_id%7=0)""")
def _(t):
    k = F.col("image_id")
    rows = t.images.select("image_id", F.when(k % 23 == 0, F.concat(F.lit("../"), "original_filename")).otherwise(F.col("original_filename")).alias("path"), "sha256_hash")
    declared = rows.where(k % 7 != 0).select("path", F.when(k % 3 == 0, F.reverse("sha256_hash")).otherwise(F.col("sha256_hash")).alias("sha256"))
    return rg.hash_manifest_verify(declared, rows.where(k % 5 != 0).select("path", F.col("sha256_hash").alias("sha256")))


def _plans(t):
    return t.images.groupBy("dataset_id", "dataset_version", "split").agg(F.min("image_id").alias("k")).select(
        "dataset_id", "dataset_version", F.concat(F.lit("E-"), "split").alias("experiment_id"), F.when(F.col("split") == "test", "Final Research Evaluation").otherwise("Development / Test").alias("status"))


@query("s28_dataset_cleanup", "images", """SELECT dataset_id, dataset_version, count(*) AS files, CAST(sum(file_size) AS BIGINT) AS total_bytes, count(*)+1 AS database_rows, count(DISTINCT split) AS linked_experiments,
  count(DISTINCT CASE WHEN split='test' THEN 'x' END) AS final_experiments, false AS deletable FROM images GROUP BY 1,2""")
def _(t):
    return rg.cleanup_preview(t.images, _plans(t))


@query("s28_delete_restore", "images", "SELECT image_id, dataset_id, split FROM images")
def _(t):
    dev = _plans(t).where("status <> 'Final Research Evaluation'")
    gone = rg.cleanup_delete(t.images, dev, "d0", cascade=True)
    return rg.restore(gone["images"], gone["trash"]).select("image_id", "dataset_id", "split")


@query("s29_set_split_eligible", "manifest", """SELECT image_id, CASE WHEN image_outcome='' THEN false ELSE split_eligible END AS split_eligible, CASE WHEN image_outcome='' THEN 'unassigned' ELSE split END AS split FROM manifest""")
def _(t):
    return rg.set_split_eligible(t.manifest, t.manifest.where("image_outcome = ''").select("image_id"), False).select("image_id", "split_eligible", "split")


@query("s30_registry_backfill", "images datasets", """, n AS (SELECT dataset_id, dataset_version AS v FROM datasets QUALIFY row_number() OVER (PARTITION BY dataset_id ORDER BY registered_timestamp DESC, dataset_version DESC)=1)
 SELECT image_id, CASE WHEN image_id%2=0 THEN coalesce(v,'') ELSE 'v1' END AS dataset_version, CASE image_id%3 WHEN 0 THEN 'exact image duplicate' WHEN 1 THEN 'near duplicate' ELSE 'unique' END AS duplicate_type,
  image_id%3<>0 AS split_eligible, CASE WHEN image_outcome='' AND anomaly_type<>'' THEN 'no_anomaly' ELSE image_outcome END AS image_outcome, CASE WHEN template_group_id='' THEN 'template:'||anomaly_type ELSE template_group_id END AS template_group_id,
  CASE WHEN image_id%5=0 THEN group_id ELSE source_group_id END AS source_group_id FROM images LEFT JOIN n ON n.dataset_id=source_group_id""")
def _(t):
    k = F.col("image_id")
    old = t.images.select("image_id", F.col("source_group_id").alias("dataset_id"), F.when(k % 2 == 0, "").otherwise("v1").alias("dataset_version"),
                          F.when(k % 3 == 0, "exact duplicate").when(k % 3 == 1, "possible near duplicate").otherwise("unique").alias("duplicate_status"), F.lit("").alias("duplicate_type"), F.lit(True).alias("split_eligible"),
                          "image_outcome", "anomaly_type", "template_group_id", F.when(k % 5 == 0, "").otherwise(F.col("source_group_id")).alias("source_group_id"), "group_id")
    return rg.backfill(old, t.datasets).select("image_id", "dataset_version", "duplicate_type", "split_eligible", "image_outcome", "template_group_id", "source_group_id")


@query("p08_final_gate", "datasets", """, p AS (SELECT dataset_id, dataset_version, concat_ws(', ', CASE WHEN ground_truth_status IN ('unknown','no annotation') THEN 'verified or reviewer-estimated ground truth' END,
  CASE WHEN source_name='' OR provider_author='' OR licence='' THEN 'source, provider, and licence metadata' END, CASE WHEN licence='unknown' THEN 'known licence' END) AS problems FROM datasets)
 SELECT *, problems='' AS final_allowed FROM p""")
def _(t):
    return rg.final_gate(t.datasets)


@query("p09_metadata_rules", "datasets", """SELECT dataset_id, dataset_version, concat_ws('; ', CASE WHEN m<>'' THEN 'missing: '||m END, CASE WHEN source_type='webscrape' THEN 'unsupported source type' END,
  CASE WHEN regexp_matches(dataset_id,'[^A-Za-z0-9_-]') THEN 'dataset_id characters' END) AS faults
  FROM (SELECT *, concat_ws(', ', CASE WHEN provider_author='' THEN 'provider_author' END, CASE WHEN licence='' THEN 'licence' END) AS m FROM datasets)""")
def _(t):
    return rg.metadata_faults(t.datasets)


@query("p10_licence_gate", "datasets", """SELECT dataset_id, dataset_version, redistribution_allowed AND licence NOT IN ('','unknown') AS export_allowed,
  CASE WHEN redistribution_allowed AND licence NOT IN ('','unknown') THEN 'Licence metadata permits redistribution.' ELSE 'Unknown or restricted licence: explicit override is required for a public export.' END AS reason FROM datasets""")
def _(t):
    return rg.licence_gate(t.datasets)


@query("p15_managed_dataset_filter", "datasets", """SELECT dataset_id, dataset_version FROM datasets WHERE source_type='synthetic' AND dataset_version='v0' AND CAST(to_timestamp(registered_timestamp) AT TIME ZONE 'UTC' AS DATE) BETWEEN DATE '1970-01-01' AND DATE '1970-02-01'""")
def _(t):
    return rg.managed_filter(t.datasets, {"source_type": "synthetic", "dataset_version": "v0", "dataset_id": "All"}, "1970-01-01", "1970-02-01").select("dataset_id", "dataset_version")


# ---- duplicates and overlaps ---------------------------------------------------------------
@query("j07_overlap_exact", "images", f"""SELECT sha256_hash, count(DISTINCT l.image_id) AS left_images, count(DISTINCT r.image_id) AS right_images, count(*) AS pairs,
  count(*) FILTER (l.duplicate_status='unique' OR r.duplicate_status='unique') AS unsupported_pairs FROM {L} l JOIN {R} r USING (sha256_hash) GROUP BY 1""")
def _(t):
    return ov.exact_overlaps(t.left, t.right)


_PERC = f"""SELECT l.perceptual_hash AS left_hash, r.perceptual_hash AS right_hash, CAST(bit_count(xor(l.perceptual_hash,r.perceptual_hash)) AS BIGINT) AS distance, count(*) AS pairs,
  count(*) FILTER (l.duplicate_status='unique' OR r.duplicate_status='unique') AS unsupported_pairs FROM {L} l JOIN {R} r ON l.sha256_hash<>r.sha256_hash AND bit_count(xor(l.perceptual_hash,r.perceptual_hash))<=3 GROUP BY 1,2"""


@query("j08_overlap_perceptual", "images", _PERC)
def _(t):
    p = ov.perceptual_overlaps(t.left, t.right)
    return p.select("left_hash", "right_hash", F.col("distance").cast("bigint").alias("distance"), "pairs", "unsupported_pairs")


def _grp(f, c):
    return f"""SELECT '{f}' AS family, {c} AS group_value, count(*) AS pairs FROM {L} l JOIN {R} r USING ({c}) WHERE {c}<>'' GROUP BY 2"""


@query("j09_overlap_groups", "images", " UNION ALL ".join(_grp(f, c) for f, c in ov.GROUP_FIELDS.items()))
def _(t):
    return ov.group_overlaps(t.left, t.right).select("family", "group_value", "pairs")


@query("j10_unsupported_unique", "images", f"""SELECT 'declared_unique_despite_cross_dataset_exact_sha256' AS evidence, count(*) AS pairs FROM {L} l JOIN {R} r USING (sha256_hash) WHERE l.duplicate_status='unique' OR r.duplicate_status='unique'
  UNION ALL SELECT 'declared_unique_despite_unresolved_perceptual_candidate', CAST(coalesce(sum(unsupported_pairs),0) AS BIGINT) FROM ({_PERC})""")
def _(t):
    return ov.unsupported_unique(t.left, t.right)


def _reasons_sql(prefix, ref):
    cand = "(SELECT * FROM images WHERE dataset_id='d0' AND split<>'test')"
    eq = " UNION ".join(f"SELECT c.image_id, '{prefix}:{n}' AS reason FROM {cand} c JOIN {ref} r USING ({c}) WHERE {c}<>''" for n, c in
                        (("exact_sha256", "sha256_hash"), *[(f"{f}_crossing", c) for f, c in ov.GROUP_FIELDS.items()]))
    return eq + f""" UNION SELECT c.image_id, '{prefix}:flagged_perceptual_candidate' FROM {cand} c JOIN {ref} r ON c.sha256_hash<>r.sha256_hash AND bit_count(xor(c.perceptual_hash,r.perceptual_hash))<=3"""


PILOT, HIST = "(SELECT * FROM images WHERE dataset_id='d1' AND image_id%4=3)", "(SELECT * FROM images WHERE split='test')"
REASONS = f", reasons AS ({_reasons_sql('pilot', PILOT)} UNION {_reasons_sql('historical_test', HIST)}) "


def candidates(t):
    return t.left.where("split <> 'test'")


def reasons(t):
    pilot, hist = t.right.where("image_id % 4 = 3"), t.images.where("split = 'test'")
    return ov.overlap_reasons(candidates(t), pilot, "pilot").unionByName(ov.overlap_reasons(candidates(t), hist, "historical_test"))


@query("j11_exclusion_reasons", "images", REASONS + "SELECT image_id, string_agg(reason, ',' ORDER BY reason) AS reasons FROM reasons GROUP BY 1")
def _(t):
    return ov.exclusion_reasons(reasons(t)).select("image_id", F.array_join("reasons", ",").alias("reasons"))


@query("j20_annotation_match", "images", """SELECT image_id, CASE WHEN image_id%2=0 THEN 'ann/doc_'||image_id||'.json' WHEN image_id%3=0 THEN 'ann/doc_'||image_id||'.csv' WHEN image_id%5=0 THEN 'ann/doc_'||image_id||'.PNG' END AS annotation FROM images""")
def _(t):
    k = F.col("image_id")
    name = lambda s: F.concat(F.lit("ann/doc_"), k.cast("string"), F.lit(s)).alias("name")
    ann = (t.images.where(k % 2 == 0).select(name(".json")).unionByName(t.images.where(k % 3 == 0).select(name(".csv")))
           .unionByName(t.images.where(k % 5 == 0).select(name(".PNG"))).unionByName(t.images.select(name(".md"))))
    return rg.annotation_match(t.images, ann).select("image_id", "annotation")


@query("j21_duplicate_lookup", "manifest", "SELECT image_id, duplicate_type, canonical_image_id, duplicate_group_id, split_eligible FROM manifest")
def _(t):
    return t.manifest.select("image_id", "duplicate_type", "canonical_image_id", "duplicate_group_id", "split_eligible")


@query("j23_path_prefix_join", "", """, p AS (SELECT url AS stored_path, regexp_extract(url, '^(http://[^/]+/[^/]+)/', 1) AS pre, regexp_extract(url, '^(http://[^/]+)/', 1) AS host FROM (SELECT DISTINCT url FROM pages)),
 rules AS (SELECT DISTINCT pre, CASE WHEN pre LIKE '%/fr' THEN 'registry_annotation' ELSE 'historical_report' END AS role FROM p WHERE pre<>'' UNION ALL SELECT DISTINCT host, 'historical_report' FROM p WHERE length(host)%5=0 AND host<>''),
 h AS (SELECT stored_path, count(*) FILTER (role='historical_report') AS own, count(*) FILTER (role<>'historical_report') AS other, max(rules.pre) FILTER (role='historical_report') AS rp
   FROM p JOIN rules ON stored_path=rules.pre OR starts_with(stored_path, rules.pre||'/') GROUP BY 1)
 SELECT stored_path, CASE WHEN list_contains(string_split(replace(stored_path, chr(92), '/'),'/'),'..') OR stored_path='' THEN 'refused: unsafe' WHEN coalesce(other,0)>0 THEN 'refused: wrong role' WHEN own>1 THEN 'refused: several rules' WHEN own=1 THEN 'resolved' ELSE 'unmapped' END AS status,
  CASE WHEN NOT (list_contains(string_split(stored_path,'/'),'..') OR stored_path='') AND coalesce(other,0)=0 AND own=1 THEN 'reports'||substr(stored_path, length(rp)+1) END AS resolved_path FROM p LEFT JOIN h USING (stored_path)""".replace(", p AS", "WITH p AS", 1))
def _(t):
    p = t.read("pages").select(F.col("url").alias("stored_path")).distinct()
    pre, host = F.regexp_extract("stored_path", "^(http://[^/]+/[^/]+)/", 1), F.regexp_extract("stored_path", "^(http://[^/]+)/", 1)
    a = p.select(pre.alias("stored_prefix")).where("stored_prefix <> ''").distinct().withColumn("role", F.when(F.col("stored_prefix").endswith("/fr"), "registry_annotation").otherwise("historical_report"))
    b = p.select(host.alias("stored_prefix")).where((F.length("stored_prefix") % 5 == 0) & (F.col("stored_prefix") != "")).distinct().withColumn("role", F.lit("historical_report"))
    return rg.path_prefix_join(p, a.unionByName(b).withColumn("target", F.lit("reports")), "historical_report")


@query("j27_overlap_audit", "images", f""", e AS (SELECT l.duplicate_status='unique' OR r.duplicate_status='unique' AS u FROM {L} l JOIN {R} r USING (sha256_hash)), pp AS ({_PERC})
 SELECT (SELECT count(*) FROM {L}) AS left_image_count, (SELECT count(*) FROM {R}) AS right_image_count, (SELECT count(*) FROM e) AS exact_duplicates, (SELECT CAST(coalesce(sum(pairs),0) AS BIGINT) FROM pp) AS perceptual_candidates,
  {", ".join(f"(SELECT count(*) FROM {L} l JOIN {R} r USING ({c}) WHERE {c}<>'') AS {f}_crossings" for f, c in ov.GROUP_FIELDS.items())},
  (SELECT count(*) FILTER (u) FROM e)+(SELECT CAST(coalesce(sum(unsupported_pairs),0) AS BIGINT) FROM pp) AS unsupported_unique_statuses, 3 AS perceptual_distance_threshold, false AS perceptual_uniqueness_established, false AS confirmatory_test_protected,
  CASE WHEN (SELECT count(*) FROM e)>0 THEN '{ov.EXACT_NOTE}' ELSE '{ov.CLEAR_NOTE}' END AS evidence_classification""")
def _(t):
    return ov.overlap_audit(t.left, t.right)


@query("a13_validation_report", "manifest", """SELECT dataset_id, count(*) AS total_files, count(*) FILTER (corruption_status='valid') AS valid_images, count(*) FILTER (corruption_status<>'valid') AS corrupted_files,
  count(*) FILTER (duplicate_type='exact image duplicate') AS exact_duplicates, count(*) FILTER (duplicate_type='near duplicate') AS possible_near_duplicates, count(*) FILTER (image_outcome<>'') AS annotated_images,
  count(*) FILTER (image_outcome='') AS unannotated_images, count(DISTINCT anomaly_type) AS classes, count(DISTINCT (width,height)) AS image_sizes FROM manifest GROUP BY 1""")
def _(t):
    return rg.validation_report(t.manifest)


@query("a13_size_histogram", "images", "SELECT width, height, count(*) AS images FROM images GROUP BY 1,2")
def _(t):
    return rg.histogram(t.images, "width", "height")


@query("a14_dataset_dashboard", "manifest datasets", """, m AS (SELECT source_group_id AS dataset_id, count(*) AS images, count(*) FILTER (duplicate_type='exact image duplicate') AS e, count(*) FILTER (duplicate_type='near duplicate') AS n, count(*) FILTER (split_eligible) AS s,
   round(avg(CASE WHEN image_outcome<>'' THEN 1 ELSE 0 END),6) AS cov, count(DISTINCT CASE WHEN duplicate_group_id<>'' THEN duplicate_group_id END) AS g, count(*) FILTER (corruption_status<>'valid') AS w FROM manifest GROUP BY 1)
 SELECT dataset_id, dataset_version, licence, ground_truth_status, coalesce(images,0) AS images, coalesce(images,0)-coalesce(e,0) AS unique_images, coalesce(s,0) AS split_eligible, coalesce(cov,0) AS annotation_coverage, coalesce(e,0) AS exact_duplicates,
  coalesce(n,0) AS near_duplicates, coalesce(g,0) AS duplicate_groups, coalesce(w,0) AS validation_warnings FROM datasets LEFT JOIN m USING (dataset_id)""")
def _(t):
    return rg.dataset_dashboard(t.datasets, t.manifest.withColumn("dataset_id", F.col("source_group_id")))


@query("a32_overlap_counts", "images", f"""SELECT 'split' AS dimension, r.split AS value, count(*) AS pairs FROM {L} l JOIN {R} r USING (sha256_hash) GROUP BY 2
  UNION ALL SELECT 'category', r.anomaly_type, count(*) FROM {L} l JOIN {R} r USING (sha256_hash) GROUP BY 2""")
def _(t):
    return ov.overlap_counts(t.left, t.right)


@query("a34_ordered_hash", "images", """, a AS (SELECT dataset_id, row_number() OVER (PARTITION BY dataset_id ORDER BY image_id)-1 AS i, sha256(image_id||','||sha256_hash) AS h FROM images),
 b AS (SELECT dataset_id, i//256 AS i, sha256(string_agg(h, ',' ORDER BY i)) AS h FROM a GROUP BY 1, i//256), c AS (SELECT dataset_id, i//256 AS i, sha256(string_agg(h, ',' ORDER BY i)) AS h FROM b GROUP BY 1, i//256),
 d AS (SELECT dataset_id, i//256 AS i, sha256(string_agg(h, ',' ORDER BY i)) AS h FROM c GROUP BY 1, i//256) SELECT dataset_id, sha256(string_agg(h, ',' ORDER BY i)) AS manifest_hash FROM d GROUP BY 1""")
def _(t):
    row = F.sha2(F.concat_ws(",", F.col("image_id").cast("string"), "sha256_hash"), 256)
    return ordered_hash(t.images, ["dataset_id"], [("image_id", True)], row, "manifest_hash", fan=256, levels=4)


@query("a37_case_validation", "images", """, c AS (SELECT anomaly_type AS category, width%5 AS spread, CASE WHEN image_outcome='anomaly_present' THEN file_size%3 ELSE file_size%2 END AS mask_pixels, anomaly_type IN ('en','fr') AS pos, sha256_hash, perceptual_hash, anomaly_type IN ('en','fr','de') AS known FROM images),
 f AS (SELECT *, CASE WHEN NOT known THEN 'i' WHEN spread<2 THEN 'b' WHEN pos AND mask_pixels=0 THEN 'e' WHEN NOT pos AND mask_pixels>0 THEN 'n' END AS f FROM c)
 SELECT category, count(*) AS cases, count(*) FILTER (f='i') AS invalid_category, count(*) FILTER (f='b') AS blank_images, count(*) FILTER (f='e') AS empty_positive_masks, count(*) FILTER (f='n') AS nonempty_clean_masks,
  count(DISTINCT sha256_hash) AS unique_sha256, count(DISTINCT perceptual_hash) AS unique_perceptual, count(*)=250 AS balanced FROM f GROUP BY 1""")
def _(t):
    pix = F.when(F.col("image_outcome") == "anomaly_present", F.col("file_size") % 3).otherwise(F.col("file_size") % 2)
    cases = t.images.select(F.col("anomaly_type").alias("category"), (F.col("width") % 5).alias("spread"), pix.alias("mask_pixels"), "sha256_hash", "perceptual_hash")
    return rg.case_validation(cases, ["en", "fr", "de"], ["en", "fr"], 250)


# ---- scalar identities ---------------------------------------------------------------------
@query("f11_hamming", "hp", """, z AS (SELECT image_id, sha256_hash AS a, lag(sha256_hash) OVER (PARTITION BY source_group_id ORDER BY image_id) AS b, perceptual_hash AS p, lag(perceptual_hash) OVER (PARTITION BY source_group_id ORDER BY image_id) AS q FROM images)
 SELECT image_id, CAST(bit_count(xor(p,q)) AS BIGINT) AS bits, CAST(len(list_filter(range(1,65), lambda i: substr(a,i,1)<>substr(b,i,1))) AS BIGINT) AS chars FROM z WHERE b IS NOT NULL""")
def _(t):
    from pyspark.sql import Window
    w = Window.partitionBy("source_group_id").orderBy("image_id")
    z = t.images.select("image_id", "sha256_hash", "perceptual_hash", F.lag("sha256_hash").over(w).alias("b"), F.lag("perceptual_hash").over(w).alias("q")).where("b is not null")
    return z.select("image_id", fx.hamming(F.col("perceptual_hash"), F.col("q")).cast("bigint").alias("bits"), fx.string_hamming(F.col("sha256_hash"), F.col("b")).cast("bigint").alias("chars"))


@query("f12_hashing", "images", """SELECT image_id, sha256('{"image_id":'||image_id||',"outcome":'||CASE WHEN image_outcome='' THEN 'null' ELSE '"'||image_outcome||'"' END||',"split":"'||split||'"}') AS canonical_sha256, true AS shaped FROM images""")
def _(t):
    h = fx.canonical_hash({"split": F.col("split"), "image_id": F.col("image_id"), "outcome": F.when(F.col("image_outcome") != "", F.col("image_outcome"))})
    return t.images.select("image_id", h.alias("canonical_sha256"), fx.is_sha256(h).alias("shaped"))


@query("f14_dhash", "images", "SELECT image_id, perceptual_hash FROM images")
def _(t):
    return t.images.select("image_id", "perceptual_hash")


@query("f15_id_derivation", "images", """SELECT image_id, sha256(image_id||chr(31)||sha256_hash||chr(31)||split) AS derived_id, CAST('0x'||substr(sha256('42:'||anomaly_type||':'||image_id),1,12) AS BIGINT) % 2147483648 AS derived_seed FROM images""")
def _(t):
    seed = F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit("42"), "anomaly_type", F.col("image_id").cast("string")), 256), 1, 12), 16, 10).cast("bigint") % 2147483648
    return t.images.select("image_id", F.sha2(F.concat_ws("\x1f", F.col("image_id").cast("string"), "sha256_hash", "split"), 256).alias("derived_id"), seed.alias("derived_seed"))


@query("f16_outcome_from_category", "", f"""SELECT doc_id, CASE WHEN {_CAT.replace('image_id', 'doc_id')} IN ('thin_crack','pitting_cluster') THEN 'anomaly_present' WHEN {_CAT.replace('image_id', 'doc_id')}<>'' THEN 'no_anomaly' ELSE '' END AS outcome FROM documents""")
def _(t):
    k = F.col("doc_id")
    cat = F.when(k % 7 == 0, "thin_crack").when(k % 7 == 1, "normal_texture").when(k % 7 == 2, "").otherwise("pitting_cluster")
    return t.read("documents").select("doc_id", fx.outcome_of(cat).alias("outcome"))


@query("f19_path_parts", "", """SELECT page_id, regexp_replace(regexp_extract(url,'([^/]*)$',1),'(.)[.][^.]*$','\\1') AS stem, lower(regexp_extract(url,'[^/.]([.][^./]*)$',1)) AS suffix,
  starts_with(url,'/') OR list_contains(string_split(url,'/'),'..') OR list_contains(string_split(url,'/'),'') OR trim(url)='' AS unsafe FROM pages""")
def _(t):
    u = F.col("url")
    return t.read("pages").select("page_id", fx.stem(u).alias("stem"), fx.suffix(u).alias("suffix"), fx.unsafe_path(u).alias("unsafe"))




@query("s05_zip_expand", "", """SELECT 'doc_'||doc_id||'.zip' AS archive, 'page.PNG' AS name, 'image' AS kind, octet_length(encode(text)) AS file_size FROM documents WHERE text<>''
  UNION ALL SELECT 'doc_'||doc_id||'.zip', 'page.json', 'annotation', 2 FROM documents""")
def _(t):
    def pack(batches):
        import io
        import zipfile

        import pandas as pd
        for b in batches:
            for k, text in zip(b["doc_id"], b["text"]):
                out = io.BytesIO()
                with zipfile.ZipFile(out, "w") as z:
                    for name, body in (("sub/page.PNG", text), ("page.json", "{}"), ("empty.txt", ""), ("../up.txt", "x"), ("sub/", "")):
                        z.writestr(name, body)
                yield pd.DataFrame({"path": [f"doc_{k}.zip"], "content": [out.getvalue()]})
    archives = t.read("documents").select("doc_id", "text").mapInPandas(pack, "path string, content binary")
    return rg.zip_expand(archives).select("archive", "name", "kind", "file_size")
