"""Exact, perceptual and declared-group overlap between image sets, without listing a group's pairs.

Images collapse to distinct keys with counts before anything is joined; a pair count is a product
of two counts, and membership stays in the image table under the key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core import any_row, conf_int
from ..functions.exprs import hamming

BUCKET_KEY = "spark.rastrum.bandBucketPairs"
MAX_DISTANCE = 3
GROUP_FIELDS = {"source_group": "source_group_id", "template_group": "template_group_id", "acquisition_group": "group_id"}
EXACT_NOTE = "historical engineering comparison — not confirmatory"
CLEAR_NOTE = "no exact overlap detected; confirmatory status still requires protocol review"


def _mask(bits: int) -> Column:
    return F.lit((1 << bits) - 1).cast("bigint")


def _band(value: Column, index: int, bits: int) -> Column:
    return F.shiftrightunsigned(value, index * bits).bitwiseAND(_mask(bits))


def _rest(value: Column, index: int, bits: int) -> Column:
    """The value with one band cut out."""
    low = value.bitwiseAND(_mask(index * bits)) if index else F.lit(0).cast("bigint")
    if index == 3:
        return low
    return F.shiftleft(F.shiftrightunsigned(value, (index + 1) * bits), index * bits).bitwiseOR(low)


def _split(df: DataFrame, bits: int) -> DataFrame:
    """Four keys per row from the remaining bits; one of them must agree within distance three."""
    parts = F.array(*[F.struct(F.concat_ws(".", F.col("key"), F.lit(str(i)), F.hex(_band(F.col("left"), i, bits))).alias("key"),
                               _rest(F.col("left"), i, bits).alias("left")) for i in range(4)])
    return df.select("side", "h", F.explode(parts).alias("p")).select("side", "h", "p.key", "p.left")


def hash_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct 64-bit values of two sets within Hamming distance three: (lh, rh, distance).

    Four 16-bit bands: values within distance three agree on at least one, so equal bands meet in an
    equi-join and nothing is missed. A band bucket that would produce too many candidates is cut
    again by the same argument over its other 48 bits, and once more over 36.
    """
    both = (left.select(F.lit("l").alias("side"), F.col("h")).where("h is not null").distinct()
            .unionByName(right.select(F.lit("r").alias("side"), F.col("h")).where("h is not null").distinct()))
    limit = conf_int(both.sparkSession, BUCKET_KEY, 4_000_000)
    level = _split(both.select("side", "h", F.lit("").alias("key"), F.col("h").alias("left")), 16)
    done = None
    for bits in (12, 9, 0):
        sizes = level.groupBy("key").agg(F.sum((F.col("side") == "l").cast("bigint")).alias("a"), F.sum((F.col("side") == "r").cast("bigint")).alias("b"))
        hot = sizes.where(F.col("a") * F.col("b") > limit).select("key")
        cool = level
        more = bits and any_row(hot)
        if more:
            cool = level.join(hot, "key", "left_anti")
        a = cool.where("side = 'l'").select("key", F.col("h").alias("lh"))
        b = cool.where("side = 'r'").select("key", F.col("h").alias("rh"))
        found = a.join(b, "key").withColumn("distance", hamming(F.col("lh"), F.col("rh"))).where(F.col("distance") <= MAX_DISTANCE).drop("key")
        done = found if done is None else done.unionByName(found)
        if not more:
            break
        level = _split(level.join(hot, "key", "left_semi"), bits)
    return done.distinct()


def _declared_unique() -> Column:
    return F.lower("duplicate_status").contains("unique")


def _side(df: DataFrame, key: str, p: str, extra: tuple[str, ...] = ()) -> DataFrame:
    return (df.where(F.col(key).isNotNull() & (F.col(key).cast("string") != "")).groupBy(F.col(key).alias("k"), *extra)
            .agg(F.count("*").alias(f"{p}_images"), F.sum((~_declared_unique()).cast("bigint")).alias(f"{p}_other")))


def exact_overlaps(left: DataFrame, right: DataFrame) -> DataFrame:
    """Content hashes present on both sides, with image and pair counts."""
    return (_side(left, "sha256_hash", "left").join(_side(right, "sha256_hash", "right"), "k")
            .select(F.col("k").alias("sha256_hash"), "left_images", "right_images", (F.col("left_images") * F.col("right_images")).alias("pairs"),
                    (F.col("left_images") * F.col("right_images") - F.col("left_other") * F.col("right_other")).alias("unsupported_pairs")))


def perceptual_overlaps(left: DataFrame, right: DataFrame) -> DataFrame:
    """Perceptual-hash pairs within distance three, net of pairs that are exact copies."""
    cols = ["left_images", "left_other", "right_images", "right_other"]
    l, r = _side(left, "perceptual_hash", "left"), _side(right, "perceptual_hash", "right")
    pairs = hash_pairs(l.select(F.col("k").alias("h")), r.select(F.col("k").alias("h")))
    j = (pairs.join(l.withColumnRenamed("k", "lh"), "lh").join(r.withColumnRenamed("k", "rh"), "rh"))
    # exact copies share both hashes; their pairs are counted per content hash and taken off
    le = left.where("sha256_hash <> ''").groupBy(F.col("perceptual_hash").alias("lh"), "sha256_hash").agg(F.count("*").alias("a"), F.sum((~_declared_unique()).cast("bigint")).alias("ao"))
    re_ = right.where("sha256_hash <> ''").groupBy(F.col("perceptual_hash").alias("rh"), "sha256_hash").agg(F.count("*").alias("b"), F.sum((~_declared_unique()).cast("bigint")).alias("bo"))
    same = (le.join(re_, "sha256_hash").groupBy("lh", "rh").agg(F.sum(F.col("a") * F.col("b")).alias("ex"), F.sum(F.col("a") * F.col("b") - F.col("ao") * F.col("bo")).alias("exu")))
    j = j.join(same, ["lh", "rh"], "left").select("lh", "rh", "distance", *cols, F.coalesce("ex", F.lit(0)).alias("ex"), F.coalesce("exu", F.lit(0)).alias("exu"))
    n = F.col("left_images") * F.col("right_images")
    return (j.select(F.col("lh").alias("left_hash"), F.col("rh").alias("right_hash"), "distance", "left_images", "right_images", (n - F.col("ex")).alias("pairs"),
                     (n - F.col("left_other") * F.col("right_other") - F.col("exu")).alias("unsupported_pairs")).where("pairs > 0"))


def group_overlaps(left: DataFrame, right: DataFrame) -> DataFrame:
    """Declared groups on both sides; blanks never match."""
    out = None
    for family, field in GROUP_FIELDS.items():
        part = (_side(left, field, "left").join(_side(right, field, "right"), "k")
                .select(F.lit(family).alias("family"), F.col("k").alias("group_value"), "left_images", "right_images", (F.col("left_images") * F.col("right_images")).alias("pairs")))
        out = part if out is None else out.unionByName(part)
    return out


def unsupported_unique(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs that contradict a declared "unique" on either side, per evidence."""
    e = exact_overlaps(left, right).agg(F.coalesce(F.sum("unsupported_pairs"), F.lit(0)).alias("pairs"))
    p = perceptual_overlaps(left, right).agg(F.coalesce(F.sum("unsupported_pairs"), F.lit(0)).alias("pairs"))
    return (e.select(F.lit("declared_unique_despite_cross_dataset_exact_sha256").alias("evidence"), "pairs")
            .unionByName(p.select(F.lit("declared_unique_despite_unresolved_perceptual_candidate").alias("evidence"), "pairs")))


def exact_by(left: DataFrame, right: DataFrame, column: str) -> DataFrame:
    """Exact pairs per right-hand split or category."""
    return (_side(left, "sha256_hash", "left").join(_side(right, "sha256_hash", "right", (column,)), "k")
            .groupBy(column).agg(F.sum(F.col("left_images") * F.col("right_images")).alias("pairs")))


def overlap_counts(left: DataFrame, right: DataFrame) -> DataFrame:
    s, c = exact_by(left, right, "split"), exact_by(left, right, "anomaly_type")
    return (s.select(F.lit("split").alias("dimension"), F.col("split").alias("value"), "pairs")
            .unionByName(c.select(F.lit("category").alias("dimension"), F.col("anomaly_type").alias("value"), "pairs")))


def overlap_audit(left: DataFrame, right: DataFrame) -> DataFrame:
    """One-row report of everything above plus the evidence classification."""
    z = lambda df, c, n: df.agg(F.coalesce(F.sum(c), F.lit(0)).alias(n))
    e, p = exact_overlaps(left, right), perceptual_overlaps(left, right)
    g = group_overlaps(left, right).agg(*[F.coalesce(F.sum(F.when(F.col("family") == f, F.col("pairs"))), F.lit(0)).alias(f"{f}_crossings") for f in GROUP_FIELDS])
    ep = e.agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("exact_duplicates"), F.coalesce(F.sum("unsupported_pairs"), F.lit(0)).alias("u1"))
    pp = p.agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("perceptual_candidates"), F.coalesce(F.sum("unsupported_pairs"), F.lit(0)).alias("u2"))
    counts = left.agg(F.count("*").alias("left_image_count")).crossJoin(right.agg(F.count("*").alias("right_image_count")))
    out = counts
    for part in (ep, pp, g):
        out = out.crossJoin(F.broadcast(part))  # one-row tables
    return out.select("left_image_count", "right_image_count", "exact_duplicates", "perceptual_candidates", *[f"{f}_crossings" for f in GROUP_FIELDS],
                      (F.col("u1") + F.col("u2")).alias("unsupported_unique_statuses"), F.lit(MAX_DISTANCE).alias("perceptual_distance_threshold"),
                      F.lit(False).alias("perceptual_uniqueness_established"), F.lit(False).alias("confirmatory_test_protected"),
                      F.when(F.col("exact_duplicates") > 0, EXACT_NOTE).otherwise(CLEAR_NOTE).alias("evidence_classification"))


def overlap_reasons(candidates: DataFrame, reference: DataFrame, prefix: str) -> DataFrame:
    """(image_id, reason) for every evidence family that links a candidate to the reference set."""
    def semi(field: str, name: str) -> DataFrame:
        keys = reference.where(F.coalesce(F.col(field), F.lit("")) != "").select(field).distinct()
        return candidates.join(keys, field, "left_semi").select("image_id", F.lit(f"{prefix}:{name}").alias("reason"))
    out = semi("sha256_hash", "exact_sha256")
    for family, field in GROUP_FIELDS.items():
        out = out.unionByName(semi(field, f"{family}_crossing"))
    near = hash_pairs(candidates.select(F.col("perceptual_hash").alias("h")), reference.select(F.col("perceptual_hash").alias("h")))
    n_ref = reference.groupBy(F.col("perceptual_hash").alias("rh")).agg(F.count("*").alias("n"))
    around = near.join(n_ref, "rh").groupBy(F.col("lh").alias("perceptual_hash")).agg(F.sum("n").alias("around"))
    copies = reference.groupBy("sha256_hash").agg(F.count("*").alias("copies"))
    flagged = (candidates.join(around, "perceptual_hash").join(copies, "sha256_hash", "left")
               .where(F.col("around") > F.coalesce("copies", F.lit(0))).select("image_id", F.lit(f"{prefix}:flagged_perceptual_candidate").alias("reason")))
    return out.unionByName(flagged)


def exclusion_reasons(reasons: DataFrame) -> DataFrame:
    """Sorted distinct reasons per image; at most one per family and prefix."""
    return reasons.distinct().groupBy("image_id").agg(F.array_sort(F.collect_list("reason")).alias("reasons"))


def role_conflicts(members: DataFrame) -> DataFrame:
    """Hashes, groups and perceptual neighbourhoods that two roles share; empty when disjoint."""
    out = None
    for name, field in (("sha256", "sha256_hash"), *GROUP_FIELDS.items()):
        part = (members.where(F.coalesce(F.col(field), F.lit("")) != "").groupBy(F.col(field).alias("value")).agg(F.count_distinct("role").alias("roles"))
                .where("roles > 1").select(F.lit(name).alias("kind"), "value"))
        out = part if out is None else out.unionByName(part)
    h = members.select(F.col("perceptual_hash").alias("h"))
    roles = members.groupBy("perceptual_hash").agg(F.sort_array(F.collect_set("role")).alias("rs"))  # a handful of roles
    pairs = hash_pairs(h, h).where("lh <= rh")
    j = (pairs.join(roles.select(F.col("perceptual_hash").alias("lh"), F.col("rs").alias("a")), "lh").join(roles.select(F.col("perceptual_hash").alias("rh"), F.col("rs").alias("b")), "rh"))
    cross = j.where(F.size(F.array_union("a", "b")) > 1).select(F.lit("perceptual").alias("kind"), F.concat_ws("~", F.col("lh").cast("string"), F.col("rh").cast("string")).alias("value"))
    return out.unionByName(cross)


def duplicate_lookup(images: DataFrame) -> DataFrame:
    """Exact copies of an earlier image, else near copies of the first earlier image within three bits.

    "First" is the smallest id. The smallest id near a hash is found per distinct hash, so a large
    neighbourhood costs one row per hash.
    """
    first = images.where("sha256_hash <> ''").groupBy("sha256_hash").agg(F.min("image_id").alias("first_copy"))
    by_hash = images.where("perceptual_hash is not null").groupBy(F.col("perceptual_hash").alias("h")).agg(F.min("image_id").alias("m"))
    near = (hash_pairs(by_hash, by_hash).join(by_hash.select(F.col("h").alias("rh"), "m"), "rh")
            .groupBy(F.col("lh").alias("perceptual_hash")).agg(F.min("m").alias("first_near")))
    j = images.join(first, "sha256_hash", "left").join(near, "perceptual_hash", "left")
    exact, close = F.col("first_copy") < F.col("image_id"), F.col("first_near") < F.col("image_id")
    kind = F.when(exact, "exact image duplicate").when(close, "near duplicate").otherwise("unique")
    canon = F.when(exact, F.col("first_copy")).when(close, F.col("first_near"))
    return j.select(*images.columns, kind.alias("duplicate_type"), canon.alias("canonical_image_id"),
                    F.when(exact, F.concat(F.lit("sha256:"), "sha256_hash")).when(close, F.concat(F.lit("near:"), F.col("first_near").cast("string"))).otherwise("").alias("duplicate_group_id"),
                    (~F.coalesce(exact, F.lit(False))).alias("split_eligible"))
