"""Identity components, splits, plans, role manifests and set-operation queries."""

from pyspark.sql import functions as F

from ..operators import overlap as ov
from ..operators import splits as sp
from .registry import query
from .registry_queries import REASONS, candidates, reasons

KEYS = ["sha256_hash", "template_group_id", "group_id"]


def comp_sql(src: str, name: str, perceptual: bool, keys: list[str] = KEYS, near: bool = False) -> str:
    """CTEs labelling each image of ``src`` with the smallest image it is tied to."""
    edges = " UNION ".join(f"SELECT a.image_id AS s, b.image_id AS d FROM {src} a JOIN (SELECT {k}, min(image_id) AS image_id FROM {src} WHERE {k}<>'' GROUP BY 1) b USING ({k})" for k in keys)
    if perceptual:
        edges += (f" UNION SELECT a.image_id, b.m FROM {src} a JOIN (SELECT perceptual_hash, min(image_id) AS m FROM {src} GROUP BY 1) b USING (perceptual_hash)"
                  f" UNION SELECT a.m, b.m FROM (SELECT perceptual_hash AS h, min(image_id) AS m FROM {src} GROUP BY 1) a JOIN (SELECT perceptual_hash AS h, min(image_id) AS m FROM {src} GROUP BY 1) b ON bit_count(xor(a.h,b.h))<=3")
    if near:
        edges += (f" UNION SELECT a.image_id, b.image_id FROM {src} a JOIN {src} b ON a.canonical_image_id=b.image_id WHERE a.duplicate_type='near duplicate'"
                  f" UNION SELECT a.image_id, b.m FROM {src} a JOIN (SELECT duplicate_group_id, min(image_id) AS m FROM {src} WHERE duplicate_type='near duplicate' GROUP BY 1) b USING (duplicate_group_id) WHERE a.duplicate_type='near duplicate'")
    return f""", {name}_e AS (SELECT s, d FROM ({edges}) WHERE s<>d UNION SELECT d, s FROM ({edges}) WHERE s<>d),
 {name}_r(node, lab) AS (SELECT image_id, image_id FROM {src} UNION SELECT e.d, r.lab FROM {name}_r r JOIN {name}_e e ON e.s=r.node WHERE r.lab<e.d),
 {name} AS (SELECT node AS image_id, min(lab) AS group_key FROM {name}_r GROUP BY 1)"""


@query("g01_identity_components", "images", comp_sql("images", "comp", True) + "SELECT * FROM comp")
def _(t):
    return sp.identity_components(t.images, KEYS)


def groups_sql(ratios=(0.7, 0.15, 0.15), seed=42, src="manifest", **how):
    return (f", ok AS (SELECT * FROM {src} WHERE corruption_status='valid' AND split_eligible)" + comp_sql("ok", "comp", False, **how) +
            f""", g AS (SELECT group_key, count(*) AS size, arg_min(CASE WHEN image_outcome='' THEN 'unknown' ELSE image_outcome END, image_id) AS outcome, arg_min(anomaly_type, image_id) AS category FROM ok JOIN comp USING (image_id) GROUP BY 1),
 a0 AS (SELECT *, (sum(size) OVER (PARTITION BY outcome, category ORDER BY CAST('0x'||substr(md5('{seed}:'||group_key),1,12) AS BIGINT), group_key ROWS UNBOUNDED PRECEDING)-size/2.0)/sum(size) OVER (PARTITION BY outcome, category) AS mid FROM g),
 assigned AS (SELECT group_key, size, outcome, category, CASE WHEN mid<{ratios[0]} THEN 'train' WHEN mid<{ratios[0] + ratios[1]} THEN 'validation' ELSE 'test' END AS split FROM a0) """)


def _groups(t):
    ok = sp.eligible(t.manifest)
    return sp.split_groups(ok, sp.identity_components(ok, KEYS, perceptual=False))


@query("g02_split_group_stratified", "manifest", groups_sql() + "SELECT * FROM assigned")
def _(t):
    return sp.share_split(_groups(t), ["outcome", "category"])


@query("g03_split_expanded", "manifest", groups_sql((0.6, 0.2, 0.2), 7) + "SELECT * FROM assigned")
def _(t):
    return sp.share_split(_groups(t), ["outcome", "category"], (0.6, 0.2, 0.2), 7)


_MAP = {"en": "test", "fr": "validation"}


@query("g04_split_balanced", "manifest", groups_sql() + "SELECT group_key, size, outcome, category, CASE category WHEN 'en' THEN 'test' WHEN 'fr' THEN 'validation' ELSE 'train' END AS split FROM assigned")
def _(t):
    return sp.balanced_split(_groups(t), mapping=_MAP)


_FINE = "fine AS (SELECT * REPLACE (source_group_id||':'||(image_id//25) AS source_group_id) FROM manifest)"
_NEW = ", " + _FINE + groups_sql(src="fine", keys=[*KEYS, "source_group_id"], near=True) + ", newm AS (SELECT m.* REPLACE (coalesce(a.split, m.split) AS split) FROM fine m LEFT JOIN comp USING (image_id) LEFT JOIN assigned a USING (group_key)) "


def _new(t):
    # the tables' sources are 20 values for all rows; a source here is one of their batches of 25
    fine = t.manifest.withColumn("source_group_id", F.concat("source_group_id", F.lit(":"), F.floor(F.col("image_id") / 25).cast("string")))
    return sp.prepare_split(fine, override_composition=True)


@query("g05_prepare_split", "manifest", _NEW + "SELECT image_id, split FROM newm")
def _(t):
    return _new(t).select("image_id", "split")


def _leak_sql(src):
    part = " UNION ALL ".join(f"SELECT '{r}' AS rule, {k} AS k FROM {src} WHERE split_eligible AND {k}<>'' GROUP BY {k} HAVING count(DISTINCT split)>1" for r, k in
                              (("duplicate_hash_across_splits", "sha256_hash"), ("group_across_splits", "group_id"), ("group_across_splits", "source_group_id"), ("group_across_splits", "template_group_id")))
    return f""", lk AS ({part} UNION ALL SELECT 'near_duplicate_across_splits', duplicate_group_id FROM {src} WHERE split_eligible AND duplicate_type='near duplicate' GROUP BY duplicate_group_id HAVING count(DISTINCT split)>1
   UNION ALL SELECT 'near_duplicate_across_splits', '' FROM {src} a JOIN {src} b ON a.canonical_image_id=b.image_id WHERE a.split_eligible AND b.split_eligible AND a.duplicate_type='near duplicate' AND a.split<>b.split)
 SELECT rule, count(*) FILTER (k IS NOT NULL) AS conflicts FROM (SELECT unnest(['duplicate_hash_across_splits','near_duplicate_across_splits','group_across_splits']) AS rule) LEFT JOIN lk USING (rule) GROUP BY 1"""


@query("a16_leakage_check", "manifest", _leak_sql("manifest"))
def _(t):
    return sp.leakage(t.manifest)


@query("a15_split_composition", "manifest", """, e AS (SELECT * FROM manifest WHERE corruption_status='valid' AND split_eligible), c AS (SELECT DISTINCT anomaly_type FROM e)
 SELECT split, count(*) AS image_count, count(*) FILTER (image_outcome='anomaly_present') AS anomaly_present, count(*) FILTER (image_outcome='no_anomaly') AS no_anomaly,
  (SELECT count(DISTINCT g) FROM (SELECT unnest([source_group_id, template_group_id]) AS g FROM e x WHERE x.split=e.split) WHERE g<>'') AS groups,
  coalesce((SELECT string_agg(anomaly_type, ',' ORDER BY anomaly_type) FROM c WHERE NOT EXISTS (SELECT 1 FROM e y WHERE y.split=e.split AND y.anomaly_type=c.anomaly_type)),'') AS missing_categories FROM e GROUP BY split""")
def _(t):
    return sp.split_composition(t.manifest)


@query("a17_split_blockers", "manifest", """, e AS (SELECT * FROM manifest WHERE split_eligible AND split='test') SELECT concat_ws('; ', CASE WHEN (SELECT count(*) FROM e WHERE image_outcome='anomaly_present')=0 THEN 'test has no positive anomaly image' END,
  CASE WHEN (SELECT count(*) FROM e WHERE image_outcome='no_anomaly')=0 THEN 'test has no negative/clean image' END, CASE WHEN (SELECT count(DISTINCT anomaly_type) FROM e)<2 THEN 'test contains only one category' END,
  'test omits required categories: thin_crack,pitting_cluster,normal_texture,specular_highlights') AS blockers""")
def _(t):
    return sp.split_blockers(t.manifest, "Balanced Synthetic Benchmark")


@query("p07_plan_subset", "images", """SELECT image_id FROM images WHERE split='train' AND (image_outcome<>'anomaly_present' OR anomaly_type IN ('en','fr')) AND (image_outcome<>'no_anomaly' OR anomaly_type IN ('en','de'))""")
def _(t):
    return sp.plan_subset(t.images, "train", "all", ["en", "fr"], ["en", "de"]).select("image_id")


_DRAW = "row_number() OVER (ORDER BY md5('{s}:'||image_id), image_id)"
_BAL = f""", pos AS (SELECT *, {_DRAW.format(s=42)} AS r FROM images WHERE image_outcome='anomaly_present'), neg AS (SELECT *, {_DRAW.format(s=43)} AS r FROM images WHERE image_outcome='no_anomaly'),
 n AS (SELECT least((SELECT count(*) FROM pos),(SELECT count(*) FROM neg),100) AS each), b AS (SELECT image_id FROM pos, n WHERE r<=each UNION ALL SELECT image_id FROM neg, n WHERE r<=each),
 rest AS (SELECT image_id, {_DRAW.format(s=44)} AS r FROM images WHERE image_id NOT IN (SELECT image_id FROM b)), sample AS (SELECT image_id FROM b UNION ALL SELECT image_id FROM rest, n WHERE r<=200-2*each) """


@query("w10_plan_sample", "images", _BAL + "SELECT image_id FROM sample")
def _(t):
    return sp.plan_sample(t.images, 200, 42, balanced=True).select("image_id")


@query("g06_create_plan", "images", f""", s AS (SELECT image_id, sha256_hash, split FROM (SELECT *, {_DRAW.format(s=42)} AS r FROM images WHERE split='train') WHERE r<=300),
 a AS (SELECT row_number() OVER (ORDER BY image_id)-1 AS i, sha256('{{"image_id":'||image_id||',"sha256_hash":"'||sha256_hash||'","split":"'||split||'"}}') AS h FROM s),
 b AS (SELECT i//4096 AS i, sha256(string_agg(h, ',' ORDER BY i)) AS h FROM a GROUP BY i//4096), c AS (SELECT i//4096 AS i, sha256(string_agg(h, ',' ORDER BY i)) AS h FROM b GROUP BY i//4096), d AS (SELECT i//4096 AS i, sha256(string_agg(h, ',' ORDER BY i)) AS h FROM c GROUP BY i//4096)
 SELECT 'plan-x' AS plan_id, (SELECT sha256(string_agg(h, ',' ORDER BY i)) FROM d) AS manifest_hash, (SELECT count(*) FROM s) AS images, 'EXP-1' AS experiment_id, 42 AS seed""")
def _(t):
    return sp.create_plan(t.images, "plan-x", "EXP-1", 300, split="train")[0]


@query("g07_normal_dev_manifest", "images", REASONS + """SELECT image_id, CASE WHEN split='validation' THEN 'calibration_validation' ELSE 'normal_fit' END AS role FROM images WHERE dataset_id='d0' AND split<>'test' AND image_id NOT IN (SELECT image_id FROM reasons)
  AND (split='validation' OR image_outcome='no_anomaly')""")
def _(t):
    return sp.normal_manifest(candidates(t), reasons(t))[0].select("image_id", "role")


_CAND = "cand AS (SELECT * REPLACE ('' AS source_group_id) FROM images WHERE dataset_id='d0' AND split<>'test' AND image_id NOT IN (SELECT image_id FROM reasons))"
_HYB = (REASONS.rstrip() + ", " + _CAND + comp_sql("cand", "c1", True) + """, x1 AS (SELECT group_key FROM cand JOIN c1 USING (image_id) GROUP BY 1 HAVING count(DISTINCT split)>1),
 cand2 AS (SELECT cand.* FROM cand JOIN c1 USING (image_id) WHERE NOT (split='train' AND group_key IN (SELECT group_key FROM x1)))""" + comp_sql("cand2", "c2", True) + """,
 gg AS (SELECT group_key, max(split) AS split, max(CASE WHEN image_outcome='anomaly_present' THEN 1 ELSE 0 END) AS pos, min(anomaly_type) AS category, max(CASE WHEN image_outcome='' THEN 1 ELSE 0 END) AS unl FROM cand2 JOIN c2 USING (image_id) GROUP BY 1),
 cl AS (SELECT group_key, row_number() OVER (PARTITION BY category ORDER BY CAST('0x'||substr(sha256('271828'||chr(31)||group_key),1,12) AS BIGINT), group_key) AS place, count(*) OVER (PARTITION BY category) AS n FROM gg WHERE split='train' AND pos=0 AND unl=0),
 rl AS (SELECT group_key, CASE WHEN place<=least(greatest(1, CAST(round_even(n*0.25,0) AS BIGINT)), n-1) THEN 'hybrid_fusion_fit' ELSE 'hybrid_normal_fit' END AS role FROM cl
   UNION ALL SELECT group_key, 'hybrid_development_holdout' FROM gg WHERE split='validation' UNION ALL SELECT group_key, 'hybrid_fusion_fit' FROM gg WHERE split='train' AND pos=1),
 members AS (SELECT cand2.*, role FROM cand2 JOIN c2 USING (image_id) JOIN rl USING (group_key)) """)


def hybrid(t):
    blank = lambda d: d.withColumn("source_group_id", F.lit(""))  # noqa: E731  (20 sources are too coarse an identity)
    return sp.hybrid_manifest(blank(candidates(t)), reasons(t))


@query("g08_hybrid_manifest", "images", _HYB + "SELECT image_id, role FROM members")
def _(t):
    return hybrid(t)[0].select("image_id", "role")


@query("g09_role_view", "images", _HYB + "SELECT image_id, split FROM members WHERE role='hybrid_normal_fit'")
def _(t):
    return sp.role_view(hybrid(t)[0], "hybrid_normal_fit", "normal_fit_view").select("image_id", "split")


def _simple_roles(t):
    return t.images.withColumn("role", F.when(F.col("split") == "train", "fit").when(F.col("split") == "validation", "calibration").otherwise("holdout"))


_ROLES = ", roles AS (SELECT *, CASE split WHEN 'train' THEN 'fit' WHEN 'validation' THEN 'calibration' ELSE 'holdout' END AS role FROM images)"


@query("x04_role_disjointness", "hp", _ROLES + " " + " UNION ALL ".join(
    f"SELECT '{n}' AS kind, {c} AS value FROM roles WHERE {c}<>'' GROUP BY {c} HAVING count(DISTINCT role)>1" for n, c in (("sha256", "sha256_hash"), *ov.GROUP_FIELDS.items()))
    + """ UNION ALL SELECT 'perceptual', lh||'~'||rh FROM (SELECT lh, rh FROM hp WHERE lh<=rh) h WHERE (SELECT count(DISTINCT role) FROM roles WHERE perceptual_hash IN (h.lh, h.rh))>1""")
def _(t):
    return ov.role_conflicts(_simple_roles(t))


@query("x05_missing_categories", "images", _ROLES + """, ex AS (SELECT unnest(['en','fr','de','xx','thin_crack']) AS c) SELECT role, coalesce(string_agg(c, ',' ORDER BY c) FILTER (c NOT IN (SELECT anomaly_type FROM roles r WHERE r.role=q.role)),'') AS missing FROM (SELECT DISTINCT role FROM roles) q, ex GROUP BY role""")
def _(t):
    return sp.missing_categories(_simple_roles(t).withColumn("category", F.col("anomaly_type")), ["en", "fr", "de", "xx", "thin_crack"])


@query("x06_replay_equality", "images", "SELECT image_id, role FROM (SELECT 1 AS image_id, 'x' AS role) WHERE false")
def _(t):
    a, b = (sp.normal_manifest(candidates(t), reasons(t))[0].select("image_id", "role") for _i in range(2))
    return a.exceptAll(b).unionByName(b.exceptAll(a))


@query("g14_build_specification", "images", _ROLES + """, a AS (SELECT role, row_number() OVER (PARTITION BY role ORDER BY image_id)-1 AS i, sha256(image_id||','||sha256_hash) AS h FROM roles),
 b AS (SELECT role, i//4096 AS i, sha256(string_agg(h, ',' ORDER BY i)) AS h FROM a GROUP BY role, i//4096), c AS (SELECT role, i//4096 AS i, sha256(string_agg(h, ',' ORDER BY i)) AS h FROM b GROUP BY role, i//4096),
 d AS (SELECT role, i//4096 AS i, sha256(string_agg(h, ',' ORDER BY i)) AS h FROM c GROUP BY role, i//4096), m AS (SELECT role, sha256(string_agg(h, ',' ORDER BY i)) AS manifest_hash FROM d GROUP BY role),
 s AS (SELECT m.*, n AS images, 3 AS methods, sha256('classical,hybrid,normal') AS method_hash, n*3 AS expected_pairs FROM m JOIN (SELECT role, count(*) AS n FROM roles GROUP BY 1) USING (role))
 SELECT *, sha256('{"expected_pairs":'||expected_pairs||',"images":'||images||',"manifest_hash":"'||manifest_hash||'","method_hash":"'||method_hash||'","methods":'||methods||',"role":"'||role||'","seed":42}') AS specification_hash FROM s""")
def _(t):
    methods = t.spark.createDataFrame([("classical",), ("normal",), ("hybrid",)], "method string")
    return sp.build_specification(_simple_roles(t), methods, {"seed": F.lit(42)})


@query("p16_spec_verify", "datasets", """SELECT dataset_id||':'||dataset_version AS specification_id, concat_ws('; ', CASE WHEN licence='' THEN 'dataset_hash is not a SHA-256' END, CASE WHEN registered_timestamp%3=0 THEN 'maximum proposal count' END,
  CASE WHEN registered_timestamp%4=0 THEN 'thresholds outside [0, 1]' END, CASE WHEN registered_timestamp%5=0 THEN 'test split used for fitting' END, CASE WHEN registered_timestamp%2=0 THEN 'dirty tree without a diff hash' END) AS faults FROM datasets""")
def _(t):
    k = F.col("registered_timestamp")
    spec = t.datasets.select(F.concat_ws(":", "dataset_id", "dataset_version").alias("specification_id"), F.when(F.col("licence") != "", F.sha2("dataset_id", 256)).otherwise("abc").alias("dataset_hash"),
                             F.lit(5).alias("images"), F.lit(5).alias("image_count"), F.lit(2).alias("methods"), (k % 3).alias("maximum_proposals"),
                             F.when(k % 4 == 0, F.array(F.lit(0.1), F.lit(1.5))).otherwise(F.array(F.lit(0.1), F.lit(0.5))).alias("thresholds"),
                             F.when(k % 5 == 0, F.array(F.lit("train"), F.lit("test"))).otherwise(F.array(F.lit("train"))).alias("fitting_splits"),
                             F.when(k % 2 == 0, "dirty").otherwise("clean").alias("tree_state"), F.lit(None).cast("string").alias("diff_hash"))
    return sp.specification_faults(spec, ["dataset_hash"])
