"""The star-schema tables and the inspection shapes bound onto them.

Every shape has a DataFrame form (used by the engine) and a SQL form (used by the oracles only).
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scale import dealt_out, ranked
from .manifest import hashed_texts, hot_key

# Method names.
METHODS = ("contour-only baseline", "fixed-threshold baseline", "multi-scale fused method", "refined contextual method")
SMALL_IMAGE = 200
BOX_ORDER = [("score", False), ("l_linenumber", True), ("l_partkey", True), ("l_suppkey", True), ("l_shipdate", True)]


def method_name(n):
    out = F.lit(METHODS[3])
    for i in (2, 1, 0):
        out = F.when(n == i, METHODS[i]).otherwise(out)
    return out


class Tables:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}.parquet")

    def hot(self, name: str, rows: DataFrame, *keys: str) -> bool:
        return hot_key(rows, f"{self.root}/{name}.parquet", *keys)

    @cached_property
    def crowded(self) -> bool:
        """Boxes of an image meet on tiles where an image has more than SMALL_IMAGE of them, else on the image alone."""
        return hot_key(self.box_rows, f"{self.root}/lineitem.parquet", "image_id", limit=SMALL_IMAGE)

    # ---- boxes: one row per line item ------------------------------------------------------
    @cached_property
    def box_rows(self) -> DataFrame:
        li = self.read("lineitem")
        x1, y1 = (F.col("l_partkey") % 4) * 8, (F.col("l_suppkey") % 4) * 8
        return li.select(
            F.col("l_orderkey").alias("image_id"), F.col("l_returnflag").alias("flag"),
            x1.alias("x1"), y1.alias("y1"),
            (x1 + 8 + F.col("l_quantity").cast("bigint") % 9).alias("x2"), (y1 + 8 + F.col("l_partkey") % 9).alias("y2"),
            F.col("l_extendedprice").alias("score"), "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate",
            "l_quantity", "l_discount", "l_tax")

    @cached_property
    def boxes(self) -> DataFrame:
        return ranked(self.box_rows, ["image_id"], BOX_ORDER, "box_id", self.hot("lineitem", self.box_rows, "image_id"))

    @property
    def truths(self) -> DataFrame:
        return (self.boxes.where(F.col("flag") == "R")
                .select("image_id", F.col("box_id").alias("truth_id"), "x1", "y1", "x2", "y2"))

    @property
    def proposals(self) -> DataFrame:
        """Ranked proposals; `A` and `N` are two methods over the same truths."""
        cols = ["image_id", "method", "proposal_id", "x1", "y1", "x2", "y2", "score",
                "l_quantity", "l_discount", "l_tax", "l_partkey", "l_suppkey", "l_linenumber"]
        rows = (self.boxes.where(F.col("flag") != "R")
                .select(*[c for c in cols if c not in ("method", "proposal_id")],
                        F.col("flag").alias("method"), F.col("box_id").alias("proposal_id")))
        return rows.select(*cols)

    # ---- results: one row per image and method ---------------------------------------------
    @cached_property
    def results(self) -> DataFrame:
        li, orders = self.read("lineitem"), self.read("orders")
        lines = li.select(
            F.col("l_orderkey").alias("image_id"), (F.col("l_linenumber") % 4).alias("m"), "l_returnflag",
            F.col("l_extendedprice").alias("score"), "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate",
            "l_discount", "l_tax")
        hot = self.hot("lineitem", lines, "image_id")
        dealt = lines if hot else dealt_out(lines, "image_id", li.count())
        rows = ranked(dealt, ["image_id", "m"], BOX_ORDER, "rn", hot and self.hot("lineitem", lines, "image_id", "m"))
        g = rows.groupBy("image_id", "m").agg(
            F.count("*").alias("final_proposals"), F.sum((F.col("l_returnflag") == "R").cast("bigint")).alias("hits"),
            F.min(F.when(F.col("l_returnflag") == "R", F.col("rn"))).alias("rank"),
            F.round(F.avg("l_discount") * 10, 9).alias("mean_iou"), (F.max("l_discount") * 10).alias("best_iou"),
            F.round(F.avg("l_tax"), 9).alias("processing_time_seconds"))
        j = g.join(orders, F.col("image_id") == F.col("o_orderkey"))
        clean = F.col("o_orderstatus") == "O"
        t = 1 + F.col("image_id") % 3
        tp = F.when(clean, 0).otherwise(F.col("hits")).cast("bigint")
        rank = F.when(~clean, F.col("rank"))
        hit = {k: F.when(~clean, F.coalesce(rank <= k, F.lit(False))) for k in (1, 3, 5, 8)}
        return j.select(
            F.concat_ws(":", F.col("image_id").cast("string"), F.col("m").cast("string")).alias("result_id"),
            F.concat(F.lit("plan-"), F.col("image_id") % 5).alias("plan_id"),
            F.lit("EXP-1").alias("experiment_id"), F.lit(1).cast("bigint").alias("experiment_version"), "image_id",
            F.concat(F.lit("img_"), F.col("image_id").cast("string")).alias("image_filename"),
            method_name(F.col("m")).alias("method"), F.lit("automatic").alias("review_status"),
            F.when(F.col("image_id") % 17 == 0, "failed").otherwise("completed").alias("run_status"),
            "final_proposals", rank.alias("first_true_anomaly_proposal_rank"),
            *[hit[k].alias(f"top_{k}_hit") for k in hit],
            tp.alias("true_positive_proposals"), (F.col("final_proposals") - tp).alias("false_positive_proposals"),
            F.when(clean, 0).otherwise(t - F.least(tp, t)).cast("bigint").alias("false_negative_anomalies"),
            (tp / F.col("final_proposals")).alias("proposal_precision"),
            F.when(~clean, F.least(tp, t) / t).alias("proposal_recall"),
            "mean_iou", "best_iou", "processing_time_seconds",
            F.col("o_orderdate").alias("recorded_timestamp"))

    @property
    def plans(self) -> DataFrame:
        """At most five rows: the plan number is image id modulo five."""
        return (self.read("lineitem").select((F.col("l_orderkey") % 5).alias("p")).distinct()
                .select(F.concat(F.lit("plan-"), "p").alias("plan_id"), F.lit("d1").alias("dataset_id"),
                        F.lit("v1").alias("dataset_version"), F.lit("test").alias("split")))

    @property
    def result_images(self) -> DataFrame:
        o = self.read("orders")
        return o.select(F.col("o_orderkey").alias("image_id"), F.col("o_orderpriority").alias("anomaly_type"),
                        F.when(F.col("o_orderstatus") == "O", "no_anomaly").otherwise("anomaly_present").alias("image_outcome"))

    @cached_property
    def scope(self) -> DataFrame:
        from ..operators.analysis import enrich_results
        return enrich_results(self.results, F.broadcast(self.plans), self.result_images)  # at most five rows

    # ---- image manifest: one row per document -----------------------------------------------
    @cached_property
    def images(self) -> DataFrame:
        d, l = hashed_texts(self.spark, f"{self.root}/documents.parquet"), self.read("labels")
        j = d.join(l.select("doc_id", "toxic"), "doc_id", "left")
        sha = F.col("sha256_hash")
        outcome = F.when(F.col("toxic") == 1, "anomaly_present").when(F.col("toxic") == 0, "no_anomaly").otherwise("")
        return j.select(
            F.col("doc_id").alias("image_id"), F.concat(F.lit("d"), F.col("doc_id") % 2).alias("dataset_id"),
            F.lit("v1").alias("dataset_version"), F.concat(F.lit("doc_"), F.col("doc_id"), F.lit(".png")).alias("original_filename"),
            "sha256_hash", "perceptual_hash",
            F.when(F.col("doc_id") % 10 < 7, "train").when(F.col("doc_id") % 10 == 7, "validation").otherwise("test").alias("split"),
            F.col("lang").alias("anomaly_type"), outcome.alias("image_outcome"),
            F.col("source").alias("source_group_id"),
            F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("t:"), F.substring(sha, 1, 8))).otherwise("").alias("template_group_id"),
            F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("g:"), F.floor(F.col("doc_id") / 20))).otherwise("").alias("group_id"),
            F.when(F.col("doc_id") % 3 == 0, "unique").otherwise("").alias("duplicate_status"),
            (1 + F.col("n_chars") % 97).alias("width"), (1 + F.col("n_chars") % 89).alias("height"),
            F.col("n_chars").alias("file_size"),
            F.when(F.col("n_chars") == 0, "zero-byte").otherwise("valid").alias("corruption_status"))

    # ---- reviews: one row per user and method ------------------------------------------------
    @cached_property
    def event_rows(self) -> DataFrame:
        e = self.read("events")
        rows = e.withColumn("m", F.col("event_id") % 4).withColumnRenamed("user_id", "image_id")
        return ranked(rows, ["image_id", "m"], [("ts", True), ("event_id", True)], "rn", self.hot("events", rows, "image_id", "m"))

    @cached_property
    def reviews(self) -> DataFrame:
        def n(kind):
            return F.sum((F.col("event_type") == kind).cast("bigint"))
        g = self.event_rows.groupBy("image_id", "m").agg(
            n("purchase").alias("a"), n("error").alias("r"), n("view").alias("u"), n("signup").alias("nr"),
            F.min("ts").alias("t0"), F.max("ts").alias("t1"), F.count("*").alias("final_proposals"),
            F.min(F.when(F.col("event_type") == "purchase", F.col("rn"))).alias("rank"))
        base = F.col("m") < 3
        user = F.col("image_id")
        secs = (F.unix_micros(F.col("t1").cast("timestamp")) - F.unix_micros(F.col("t0").cast("timestamp"))) / 1e6
        return g.select(
            F.concat_ws(":", user.cast("string"), F.col("m").cast("string")).alias("record_id"),
            F.lit("REV-1").alias("experiment_id"), F.lit(1).cast("bigint").alias("experiment_version"),
            F.concat(F.lit("img_"), user).alias("image_filename"), method_name(F.col("m")).alias("method"),
            F.concat(F.lit("rev-"), user % 7).alias("reviewer_id"),
            F.when(base, "not_reviewed").when(F.col("nr") > 0, "partially_reviewed").otherwise("fully_reviewed").alias("review_status"),
            F.when(user % 5 == 0, "no anomaly").when(user % 5 == 1, "uncertain").otherwise("anomaly present").alias("image_outcome"),
            F.when(user % 4 == 0, "unknown").when(user % 4 == 1, "verified ground truth").otherwise("reviewer-estimated").alias("ground_truth_status"),
            F.when(user % 3 > 0, "Final Research Evaluation").otherwise("Development / Test").alias("experiment_status"),
            F.col("final_proposals"), *[F.when(~base, F.col(c)).alias(nm) for c, nm in
              (("a", "accepted"), ("r", "rejected"), ("u", "uncertain"))],
            F.col("nr").alias("not_reviewed"), F.when((user % 5) > 1, F.col("rank")).alias("first_accepted_rank"), (user % 8 == 0).alias("recall_override"),
            F.when(~base, F.round(secs, 6)).alias("review_duration_seconds"),
            F.col("t0").alias("review_start_time"), F.col("t1").alias("recorded_timestamp"))

    # ---- dataset registry: one row per source and version -------------------------------------
    @cached_property
    def datasets(self) -> DataFrame:
        d = self.read("documents").groupBy("source", (F.col("doc_id") % 3).alias("v")).agg(F.min("doc_id").alias("k"), F.sum("n_chars").alias("ts"))
        k = F.col("k")
        return d.select(
            F.col("source").alias("dataset_id"), F.concat(F.lit("v"), "v").alias("dataset_version"), F.upper("source").alias("dataset_name"),
            F.when(k % 3 == 0, "synthetic").when(k % 3 == 1, "public research dataset").otherwise("webscrape").alias("source_type"), F.col("source").alias("source_name"),
            F.when(k % 5 == 0, "").otherwise("lab").alias("provider_author"), F.when(k % 4 == 0, "unknown").when(k % 4 == 1, "").otherwise("MIT").alias("licence"),
            (k % 2 == 0).alias("redistribution_allowed"), F.lit("2024-01-01").alias("date_acquired"), F.lit("surface").alias("domain_category"),
            F.when(k % 4 == 0, "unknown").when(k % 4 == 1, "no annotation").when(k % 4 == 2, "verified dataset annotation").otherwise("verified expert annotation").alias("ground_truth_status"),
            F.when(k % 2 == 0, "binary masks").otherwise("COCO JSON").alias("annotation_format"), F.col("ts").alias("registered_timestamp"))

    @cached_property
    def manifest(self) -> DataFrame:
        """Images with duplicate evidence."""
        from ..operators.overlap import duplicate_lookup
        return duplicate_lookup(self.images)

    @property
    def left(self) -> DataFrame:
        return self.images.where("dataset_id = 'd0'")

    @property
    def right(self) -> DataFrame:
        return self.images.where("dataset_id = 'd1'")

    # ---- vectors and 8 x 8 rasters ------------------------------------------------------------
    @cached_property
    def vectors(self) -> DataFrame:
        return self.read("embeddings").select("vec_id", "embedding", F.col("label").cast("bigint").alias("label"))

    @property
    def raster(self) -> DataFrame:
        v = self.vectors.select(F.col("vec_id").alias("image_id"), "label", F.posexplode("embedding").alias("i", "f"))
        return v.select("image_id", "label", F.floor(F.col("i") / 8).alias("y"), (F.col("i") % 8).cast("bigint").alias("x"),
                        F.col("f").cast("double").alias("v"))

    @property
    def raster_truth(self) -> DataFrame:
        """Truth pixels of the positive rasters (rows label-5..label-2, four columns)."""
        x0 = F.col("image_id") % 4
        return self.raster.where(
            (F.col("label") >= 5) & F.col("y").between(F.col("label") - 5, F.col("label") - 2) & F.col("x").between(x0, x0 + 3)
        ).select("image_id", "y", "x")


# ---------------------------------------------------------------- SQL forms, for the oracles only
_M = "CASE {} WHEN 0 THEN 'contour-only baseline' WHEN 1 THEN 'fixed-threshold baseline' WHEN 2 THEN 'multi-scale fused method' ELSE 'refined contextual method' END"

SQL = {
    "boxes": """boxes AS (SELECT *, x1+8+CAST(l_quantity AS BIGINT)%9 AS x2, y1+8+l_partkey%9 AS y2,
      row_number() OVER (PARTITION BY image_id ORDER BY score DESC, l_linenumber, l_partkey, l_suppkey, l_shipdate) AS box_id
      FROM (SELECT l_orderkey AS image_id, l_returnflag AS flag, (l_partkey%4)*8 AS x1, (l_suppkey%4)*8 AS y1,
        l_extendedprice AS score, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_discount, l_tax FROM lineitem))""",
    "truths": "truths AS (SELECT image_id, box_id AS truth_id, x1, y1, x2, y2 FROM boxes WHERE flag='R')",
    "proposals": """proposals AS (SELECT image_id, flag AS method, box_id AS proposal_id, x1, y1, x2, y2, score,
      l_quantity, l_discount, l_tax, l_partkey, l_suppkey, l_linenumber FROM boxes WHERE flag<>'R')""",
    "results": f"""results AS (SELECT image_id||':'||m AS result_id, 'plan-'||(image_id%5) AS plan_id, 'EXP-1' AS experiment_id,
      CAST(1 AS BIGINT) AS experiment_version, image_id, 'img_'||image_id AS image_filename, {_M.format('m')} AS method,
      'automatic' AS review_status, CASE WHEN image_id%17=0 THEN 'failed' ELSE 'completed' END AS run_status, final_proposals,
      rk AS first_true_anomaly_proposal_rank,
      CASE WHEN NOT clean THEN coalesce(rk<=1,false) END AS top_1_hit, CASE WHEN NOT clean THEN coalesce(rk<=3,false) END AS top_3_hit,
      CASE WHEN NOT clean THEN coalesce(rk<=5,false) END AS top_5_hit, CASE WHEN NOT clean THEN coalesce(rk<=8,false) END AS top_8_hit,
      tp AS true_positive_proposals, final_proposals-tp AS false_positive_proposals,
      CASE WHEN clean THEN 0 ELSE t-least(tp,t) END AS false_negative_anomalies,
      tp/CAST(final_proposals AS DOUBLE) AS proposal_precision, CASE WHEN NOT clean THEN least(tp,t)/CAST(t AS DOUBLE) END AS proposal_recall,
      mean_iou, best_iou, processing_time_seconds, o_orderdate AS recorded_timestamp
      FROM (SELECT g.*, o_orderdate, o_orderstatus='O' AS clean, 1+image_id%3 AS t,
          CASE WHEN o_orderstatus='O' THEN 0 ELSE hits END AS tp, CASE WHEN o_orderstatus<>'O' THEN rk0 END AS rk
        FROM (SELECT image_id, m, count(*) AS final_proposals, CAST(sum(CASE WHEN l_returnflag='R' THEN 1 ELSE 0 END) AS BIGINT) AS hits,
            min(CASE WHEN l_returnflag='R' THEN rn END) AS rk0, round(avg(l_discount)*10,9) AS mean_iou, max(l_discount)*10 AS best_iou,
            round(avg(l_tax),9) AS processing_time_seconds
          FROM (SELECT *, l_orderkey AS image_id, l_linenumber%4 AS m, row_number() OVER (PARTITION BY l_orderkey, l_linenumber%4
              ORDER BY l_extendedprice DESC, l_linenumber, l_partkey, l_suppkey, l_shipdate) AS rn FROM lineitem) GROUP BY image_id, m) g
        JOIN orders ON image_id=o_orderkey))""",
    "plans": "plans AS (SELECT DISTINCT 'plan-'||(l_orderkey%5) AS plan_id, 'd1' AS dataset_id, 'v1' AS dataset_version, 'test' AS split FROM lineitem)",
    "result_images": """result_images AS (SELECT o_orderkey AS image_id, o_orderpriority AS anomaly_type,
      CASE WHEN o_orderstatus='O' THEN 'no_anomaly' ELSE 'anomaly_present' END AS image_outcome FROM orders)""",
    "scope": """scope AS (SELECT r.*, p.dataset_id, p.dataset_version, p.split AS dataset_split, i.anomaly_type, i.image_outcome,
      CASE WHEN i.image_outcome='no_anomaly' THEN i.anomaly_type ELSE '' END AS clean_artefact_type
      FROM results r LEFT JOIN plans p USING (plan_id) LEFT JOIN result_images i USING (image_id))""",
    "images": """images AS (SELECT doc_id AS image_id, 'd'||(doc_id%2) AS dataset_id, 'v1' AS dataset_version,
      'doc_'||doc_id||'.png' AS original_filename, sha256(text) AS sha256_hash, CASE WHEN n_chars>0 THEN perceptual_hash END AS perceptual_hash,
      CASE WHEN doc_id%10<7 THEN 'train' WHEN doc_id%10=7 THEN 'validation' ELSE 'test' END AS split, lang AS anomaly_type,
      CASE WHEN toxic=1 THEN 'anomaly_present' WHEN toxic=0 THEN 'no_anomaly' ELSE '' END AS image_outcome, source AS source_group_id,
      CASE WHEN doc_id%3=0 THEN 't:'||substr(sha256(text),1,8) ELSE '' END AS template_group_id,
      CASE WHEN doc_id%5=0 THEN 'g:'||(doc_id//20) ELSE '' END AS group_id,
      CASE WHEN doc_id%3=0 THEN 'unique' ELSE '' END AS duplicate_status, 1+n_chars%97 AS width, 1+n_chars%89 AS height,
      n_chars AS file_size, CASE WHEN n_chars=0 THEN 'zero-byte' ELSE 'valid' END AS corruption_status
      FROM documents LEFT JOIN (SELECT doc_id, toxic FROM labels) USING (doc_id) JOIN hashes USING (doc_id))""",
    "hashes": """cells AS (SELECT doc_id, c.c, length(s)-length(replace(replace(s,' ',''),'e','')) AS v
        FROM (SELECT doc_id, unnest(range(72)) AS c, text, CAST(length(text) AS BIGINT) AS n FROM documents) c,
        LATERAL (SELECT substr(text, CAST(c.c*n//72+1 AS INTEGER), CAST((c.c+1)*n//72-c.c*n//72 AS INTEGER)) AS s)),
      hashes AS (SELECT a.doc_id, CAST(sum(CASE WHEN b.v>a.v THEN (CASE WHEN bit=63 THEN -9223372036854775808 ELSE CAST(1 AS HUGEINT)<<bit END) ELSE 0 END) AS BIGINT) AS perceptual_hash
        FROM (SELECT *, CAST((c//9)*8+c%9 AS INTEGER) AS bit FROM cells WHERE c%9<8) a JOIN cells b ON a.doc_id=b.doc_id AND b.c=a.c+1 GROUP BY a.doc_id)""",
    "event_rows": """event_rows AS (SELECT event_id, ts, user_id AS image_id, event_type, value, props, event_id%4 AS m,
      row_number() OVER (PARTITION BY user_id, event_id%4 ORDER BY ts, event_id) AS rn FROM events)""",
    "reviews": f"""reviews AS (SELECT image_id||':'||m AS record_id, 'REV-1' AS experiment_id, CAST(1 AS BIGINT) AS experiment_version,
      'img_'||image_id AS image_filename, {_M.format('m')} AS method, 'rev-'||(image_id%7) AS reviewer_id,
      CASE WHEN m<3 THEN 'not_reviewed' WHEN nr>0 THEN 'partially_reviewed' ELSE 'fully_reviewed' END AS review_status,
      CASE WHEN image_id%5=0 THEN 'no anomaly' WHEN image_id%5=1 THEN 'uncertain' ELSE 'anomaly present' END AS image_outcome,
      CASE WHEN image_id%4=0 THEN 'unknown' WHEN image_id%4=1 THEN 'verified ground truth' ELSE 'reviewer-estimated' END AS ground_truth_status,
      CASE WHEN image_id%3>0 THEN 'Final Research Evaluation' ELSE 'Development / Test' END AS experiment_status, final_proposals,
      CASE WHEN m>=3 THEN a END AS accepted, CASE WHEN m>=3 THEN r END AS rejected, CASE WHEN m>=3 THEN u END AS uncertain,
      nr AS not_reviewed, CASE WHEN image_id%5>1 THEN rk END AS first_accepted_rank, image_id%8=0 AS recall_override,
      CASE WHEN m>=3 THEN round((epoch_us(t1)-epoch_us(t0))/1e6,6) END AS review_duration_seconds, t0 AS review_start_time, t1 AS recorded_timestamp
      FROM (SELECT image_id, m, count(*) FILTER (event_type='purchase') AS a, count(*) FILTER (event_type='error') AS r,
        count(*) FILTER (event_type='view') AS u, count(*) FILTER (event_type='signup') AS nr, min(ts) AS t0, max(ts) AS t1,
        count(*) AS final_proposals, min(CASE WHEN event_type='purchase' THEN rn END) AS rk FROM event_rows GROUP BY image_id, m))""",
    "datasets": """datasets AS (SELECT source AS dataset_id, 'v'||v AS dataset_version, upper(source) AS dataset_name,
      CASE k%3 WHEN 0 THEN 'synthetic' WHEN 1 THEN 'public research dataset' ELSE 'webscrape' END AS source_type, source AS source_name,
      CASE WHEN k%5=0 THEN '' ELSE 'lab' END AS provider_author, CASE k%4 WHEN 0 THEN 'unknown' WHEN 1 THEN '' ELSE 'MIT' END AS licence, k%2=0 AS redistribution_allowed,
      '2024-01-01' AS date_acquired, 'surface' AS domain_category,
      CASE k%4 WHEN 0 THEN 'unknown' WHEN 1 THEN 'no annotation' WHEN 2 THEN 'verified dataset annotation' ELSE 'verified expert annotation' END AS ground_truth_status,
      CASE WHEN k%2=0 THEN 'binary masks' ELSE 'COCO JSON' END AS annotation_format, ts AS registered_timestamp
      FROM (SELECT source, doc_id%3 AS v, min(doc_id) AS k, CAST(sum(n_chars) AS BIGINT) AS ts FROM documents GROUP BY 1,2))""",
    "hp": """hv AS (SELECT DISTINCT perceptual_hash AS h FROM images), hp AS (SELECT a.h AS lh, b.h AS rh, CAST(bit_count(xor(a.h,b.h)) AS BIGINT) AS distance FROM hv a JOIN hv b ON bit_count(xor(a.h,b.h))<=3)""",
    "manifest": """fc AS (SELECT sha256_hash, min(image_id) AS first_copy FROM images GROUP BY 1),
      fh AS (SELECT perceptual_hash AS h, min(image_id) AS m FROM images GROUP BY 1), fn AS (SELECT lh AS perceptual_hash, min(m) AS first_near FROM hp JOIN fh ON rh=fh.h GROUP BY 1),
      manifest AS (SELECT i.*, CASE WHEN first_copy<image_id THEN 'exact image duplicate' WHEN first_near<image_id THEN 'near duplicate' ELSE 'unique' END AS duplicate_type,
      CASE WHEN first_copy<image_id THEN first_copy WHEN first_near<image_id THEN first_near END AS canonical_image_id,
      CASE WHEN first_copy<image_id THEN 'sha256:'||sha256_hash WHEN first_near<image_id THEN 'near:'||first_near ELSE '' END AS duplicate_group_id,
      NOT first_copy<image_id AS split_eligible FROM images i LEFT JOIN fc USING (sha256_hash) LEFT JOIN fn USING (perceptual_hash))""",
    "raster": """raster AS (SELECT vec_id AS image_id, CAST(label AS BIGINT) AS label, CAST(i//8 AS BIGINT) AS y, CAST(i%8 AS BIGINT) AS x,
      CAST(embedding[i+1] AS DOUBLE) AS v FROM (SELECT vec_id, label, embedding, unnest(range(64)) AS i FROM embeddings))""",
    "raster_truth": """raster_truth AS (SELECT image_id, y, x FROM raster WHERE label>=5 AND y BETWEEN label-5 AND label-2
      AND x BETWEEN image_id%4 AND image_id%4+3)""",
}
NEEDS = {"truths": ["boxes"], "proposals": ["boxes"], "scope": ["results", "plans", "result_images"], "images": ["hashes"],
         "reviews": ["event_rows"], "hp": ["images"], "manifest": ["images", "hp"], "raster_truth": ["raster"]}


def with_shapes(*names: str) -> str:
    """The WITH prefix that defines the named shapes (and what they need) for an oracle."""
    order: list[str] = []

    def add(n: str) -> None:
        for d in NEEDS.get(n, []):
            add(d)
        if n not in order:
            order.append(n)
    for n in names:
        add(n)
    return "WITH RECURSIVE " + ",\n".join(SQL[n] for n in order)
