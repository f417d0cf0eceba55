"""Leakage-safe splits, role manifests, plans and specifications."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core import any_row, checkpointed
from ..functions.exprs import SHA256_SHAPE, canonical_hash
from ..scale import ordered_hash, ranked, running_sums
from .graph import connected_components, star_edges
from .overlap import GROUP_FIELDS, exclusion_reasons, hash_pairs
from .registry import listed

# Categories and their fixed splits in the balanced benchmark, and the expanded list.
BALANCED = {"thin_crack": "test", "pitting_cluster": "test", "normal_texture": "test", "specular_highlights": "test",
            "weld_disturbance": "validation", "illumination_gradient": "validation"}
EXPANDED = ("thin_crack", "pitting_cluster", "weld_disturbance", "colour_only_anomaly", "texture_only_anomaly", "normal_texture",
            "specular_highlights", "illumination_gradient", "border_artifact", "blur_noise")
SPLITS = ("train", "validation", "test")
IDENTITY_KEYS = ("sha256_hash", *GROUP_FIELDS.values())


def identity_components(images: DataFrame, keys: Sequence[str] = IDENTITY_KEYS, perceptual: bool = True, extra: DataFrame | None = None) -> DataFrame:
    """Images with the smallest image id they are tied to by content, groups, near-equal hashes or ``extra`` edges."""
    edges = star_edges(images, "image_id", keys)
    if extra is not None:
        edges = edges.unionByName(extra)
    if perceptual:
        edges = edges.unionByName(star_edges(images, "image_id", ["perceptual_hash"]))
        rep = images.where("perceptual_hash is not null").groupBy(F.col("perceptual_hash").alias("h")).agg(F.min("image_id").alias("rep"))
        near = hash_pairs(rep, rep).where("lh < rh")
        edges = edges.unionByName(near.join(rep.select(F.col("h").alias("lh"), F.col("rep").alias("src")), "lh")
                                  .join(rep.select(F.col("h").alias("rh"), F.col("rep").alias("dst")), "rh").select("src", "dst"))
    nodes = images.select(F.col("image_id").alias("node"))
    return connected_components(nodes, edges).select(F.col("node").alias("image_id"), F.col("component").alias("group_key"))


def near_edges(images: DataFrame) -> DataFrame:
    """Edges that keep near duplicates together: to the image each was matched with, and within their shared group."""
    near = images.where(F.col("duplicate_type") == "near duplicate")
    canonical = near.where("canonical_image_id is not null").select(F.col("image_id").alias("src"), F.col("canonical_image_id").alias("dst"))
    both = canonical.join(images.select(F.col("image_id").alias("dst")), "dst", "left_semi")
    return both.select("src", "dst").unionByName(star_edges(near, "image_id", ["duplicate_group_id"]))


def split_groups(images: DataFrame, components: DataFrame) -> DataFrame:
    """One row per identity group: size, and the outcome and category of its smallest image."""
    j = images.join(components, "image_id")
    first = lambda c, d: F.min_by(F.when(F.coalesce(F.col(c), F.lit("")) == "", d).otherwise(F.col(c)), "image_id")
    return j.groupBy("group_key").agg(F.count("*").alias("size"), first("image_outcome", "unknown").alias("outcome"), first("anomaly_type", "unclassified").alias("category"))


def share_split(groups: DataFrame, strata: Sequence[str], ratios: Sequence[float] = (0.7, 0.15, 0.15), seed: int = 42) -> DataFrame:
    """Assign whole groups so that every stratum is cut at the wanted cumulative shares.

    Groups are ordered by a seeded hash; a group goes where its midpoint falls, so each split ends
    within one group of its target and no group is ever divided.
    """
    h = groups.withColumn("__h", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("group_key").cast("string"))))
    h = h.withColumn("__o", F.conv(F.substring("__h", 1, 12), 16, 10).cast("bigint"))
    run = running_sums(h, strata, [("__o", True), ("group_key", True)], {"__c": F.col("size")})
    total = groups.groupBy(*strata).agg(F.sum("size").alias("__t"))
    mid = (F.col("__c") - F.col("size") / 2) / F.col("__t")
    split = F.when(mid < ratios[0], SPLITS[0]).when(mid < ratios[0] + ratios[1], SPLITS[1]).otherwise(SPLITS[2])
    return run.join(total, list(strata)).select(*groups.columns, split.alias("split"))


def balanced_split(groups: DataFrame, override: bool = False, mapping: dict[str, str] = BALANCED) -> DataFrame:
    """Fixed category-to-split map; the rest trains. A missing category fails unless overridden."""
    if not override:
        have = groups.where(F.col("category").isin(list(mapping))).select("category").distinct().count()
        if have < len(mapping):
            raise ValueError("balanced benchmark categories are missing")
    split = F.lit(SPLITS[0])
    for category, s in mapping.items():
        split = F.when(F.col("category") == category, s).otherwise(split)
    return groups.withColumn("split", split)


def eligible(images: DataFrame) -> DataFrame:
    return images.where((F.col("corruption_status") == "valid") & F.col("split_eligible"))


def split_composition(images: DataFrame) -> DataFrame:
    """Per split: counts, distinct declared groups and the categories it lacks."""
    e = eligible(images)
    n = lambda c: F.count(F.when(c, 1))
    base = e.groupBy("split").agg(F.count("*").alias("image_count"), n(F.col("image_outcome") == "anomaly_present").alias("anomaly_present"), n(F.col("image_outcome") == "no_anomaly").alias("no_anomaly"))
    groups = (e.select("split", F.explode(F.array("source_group_id", "template_group_id")).alias("g")).where("g <> ''").groupBy("split").agg(F.count_distinct("g").alias("groups")))
    cats = e.where(F.col("anomaly_type") != "").select("anomaly_type").distinct()
    have = e.select("split", "anomaly_type").distinct()
    lack = (base.select("split").crossJoin(F.broadcast(cats))  # splits x categories, both enumerations
            .join(have, ["split", "anomaly_type"], "left_anti").groupBy("split").agg(F.array_join(F.array_sort(F.collect_list("anomaly_type")), ",").alias("missing_categories")))
    return (base.join(groups, "split", "left").join(lack, "split", "left")
            .select("split", "image_count", "anomaly_present", "no_anomaly", F.coalesce("groups", F.lit(0)).alias("groups"), F.coalesce("missing_categories", F.lit("")).alias("missing_categories")))


def leakage(images: DataFrame) -> DataFrame:
    """Keys whose rows fall into more than one split, per rule; near links to a canonical elsewhere."""
    rows = images.where((F.col("split") != "unassigned") & F.col("split_eligible"))
    out = None
    for rule, field in (("duplicate_hash_across_splits", "sha256_hash"), ("group_across_splits", "group_id"),
                        ("group_across_splits", "source_group_id"), ("group_across_splits", "template_group_id")):
        part = (rows.where(F.coalesce(F.col(field), F.lit("")) != "").groupBy(F.col(field).alias("value")).agg(F.count_distinct("split").alias("s")).where("s > 1").select(F.lit(rule).alias("rule")))
        out = part if out is None else out.unionByName(part)
    near = rows.where(F.col("duplicate_type") == "near duplicate")
    canon = rows.select(F.col("image_id").alias("canonical_image_id"), F.col("split").alias("cs"))
    links = near.join(canon, "canonical_image_id").where("cs <> split").select(F.lit("near_duplicate_across_splits").alias("rule"))
    groups = near.groupBy("duplicate_group_id").agg(F.count_distinct("split").alias("s")).where("s > 1").select(F.lit("near_duplicate_across_splits").alias("rule"))
    rules = ["duplicate_hash_across_splits", "near_duplicate_across_splits", "group_across_splits"]
    counts = out.unionByName(links).unionByName(groups).groupBy().agg(*[F.count(F.when(F.col("rule") == r, 1)).alias(r) for r in rules])
    return counts.unpivot([], [F.col(r) for r in rules], "rule", "conflicts")


def split_blockers(images: DataFrame, mode: str = "Group-aware stratified") -> DataFrame:
    """One row: the reasons that make the test split unusable, joined."""
    e = images.where("split_eligible")
    test = F.col("split") == "test"
    need = {"Balanced Synthetic Benchmark": [c for c, s in BALANCED.items() if s == "test"], "Expanded Synthetic Benchmark": list(EXPANDED)}.get(mode, [])
    # categories collapse before anything is gathered, so the set is as small as the category list
    per = e.groupBy("anomaly_type", "image_outcome").agg(F.max((test).cast("int")).alias("in_test"))
    g = per.agg(F.max((F.coalesce("image_outcome", F.lit("")) != "").cast("int")).alias("labelled"),
                F.max(F.when(F.col("in_test") == 1, (F.col("image_outcome") == "anomaly_present").cast("int"))).alias("pos"),
                F.max(F.when(F.col("in_test") == 1, (F.col("image_outcome") == "no_anomaly").cast("int"))).alias("neg"),
                F.collect_set(F.when((F.col("in_test") == 1) & (F.col("anomaly_type") != ""), F.col("anomaly_type"))).alias("cats"))
    lack = F.array_join(F.array_except(F.array(*[F.lit(c) for c in need]).cast("array<string>"), F.col("cats")), ",")
    text = listed([F.when(F.coalesce("pos", F.lit(0)) == 0, "test has no positive anomaly image"), F.when(F.coalesce("neg", F.lit(0)) == 0, "test has no negative/clean image"),
                   F.when(F.size("cats") < 2, "test contains only one category"), F.when(lack != "", F.concat(F.lit("test omits required categories: "), lack))])
    return g.select(F.when(F.col("labelled") == 1, text).otherwise("").alias("blockers"))


def prepare_split(images: DataFrame, ratios: Sequence[float] = (0.7, 0.15, 0.15), seed: int = 42, mode: str = "Group-aware stratified",
                  override_leakage: bool = False, override_composition: bool = False, check: bool = True) -> DataFrame:
    """Images with their new split: identity groups stay whole; leaks and unsafe tests are refused."""
    ok = eligible(images)
    comp = identity_components(ok, perceptual=False, extra=near_edges(ok))
    groups = split_groups(ok, comp)
    assigned = balanced_split(groups, override_composition) if mode == "Balanced Synthetic Benchmark" else share_split(groups, ["outcome", "category"], ratios, seed)
    new = comp.join(assigned.select("group_key", F.col("split").alias("__s")), "group_key").select("image_id", "__s")
    out = images.join(new, "image_id", "left").withColumn("split", F.coalesce("__s", "split")).drop("__s")
    if check:
        if not override_leakage and any_row(leakage(out).where("conflicts > 0")):
            raise ValueError("split leakage detected")
        if not override_composition and any_row(split_blockers(out, mode).where("blockers <> ''")):
            raise ValueError("unsafe test split")
    return out


# ---- plans --------------------------------------------------------------------------------
def plan_subset(images: DataFrame, split: str = "all", outcome: str = "all", anomaly_types: Sequence[str] = (), clean_types: Sequence[str] = ()) -> DataFrame:
    if split != "all":
        images = images.where(F.col("split") == split)
    o, c = F.col("image_outcome"), F.col("anomaly_type")
    if outcome == "anomaly-present only":
        images = images.where(o == "anomaly_present")
    elif outcome == "no-anomaly only":
        images = images.where(o == "no_anomaly")
    if anomaly_types:
        images = images.where((o != "anomaly_present") | c.isin(list(anomaly_types)))
    if clean_types:
        images = images.where((o != "no_anomaly") | c.isin(list(clean_types)))
    return images


def _draw(df: DataFrame, n: int, seed: int) -> DataFrame:
    """The n rows with the smallest seeded hash: a take-ordered, never a full sort."""
    return df.withColumn("__h", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("image_id").cast("string")))).orderBy("__h", "image_id").limit(n).drop("__h")


def plan_sample(images: DataFrame, size: int, seed: int = 42, balanced: bool = False) -> DataFrame:
    """n images by seed; balanced takes both outcomes equally and tops up from the rest."""
    if not balanced:
        return _draw(images, size, seed)
    pos, neg = images.where("image_outcome = 'anomaly_present'"), images.where("image_outcome = 'no_anomaly'")
    half = max(size // 2, 1)
    each = min(pos.limit(half).count(), neg.limit(half).count())
    both = _draw(pos, each, seed).unionByName(_draw(neg, each, seed + 1))
    rest = images.join(both.select("image_id"), "image_id", "left_anti")
    return both.unionByName(_draw(rest, max(size - 2 * each, 0), seed + 2).select(*both.columns))


def create_plan(images: DataFrame, plan_id: str, experiment: str, size: int, seed: int = 42, balanced: bool = False, **subset) -> tuple[DataFrame, DataFrame]:
    """(plan row with the manifest hash, member rows in order). Members stay rows at any plan size."""
    chosen = plan_sample(plan_subset(images, **subset), size, seed, balanced)
    if not any_row(chosen):
        raise ValueError("no registered images match the experiment subset filters")
    members = ranked(chosen.withColumn("plan_id", F.lit(plan_id)), ["plan_id"], [("image_id", True)], "position")
    row = canonical_hash({"image_id": F.col("image_id"), "sha256_hash": F.col("sha256_hash"), "split": F.col("split")})
    plan = (ordered_hash(members, ["plan_id"], [("image_id", True)], row, "manifest_hash")
            .join(members.groupBy("plan_id").agg(F.count("*").alias("images")), "plan_id").withColumn("experiment_id", F.lit(experiment)).withColumn("seed", F.lit(seed)))
    return plan, members.select("plan_id", "position", "image_id", "sha256_hash")


def missing_categories(members: DataFrame, expected: Sequence[str], by: str = "role") -> DataFrame:
    """Expected categories a role lacks."""
    have = members.select(by, "category").distinct().groupBy(by).agg(F.collect_set("category").alias("have"))  # as small as the category list
    return have.select(by, F.array_join(F.array_sort(F.array_except(F.array(*[F.lit(c) for c in expected]), F.col("have"))), ",").alias("missing"))


# ---- role manifests -----------------------------------------------------------------------
def normal_manifest(candidates: DataFrame, reasons: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, exclusions): clean training images fit, validation calibrates, linked images leave."""
    ex = exclusion_reasons(reasons)
    kept = candidates.join(ex.select("image_id"), "image_id", "left_anti")
    role = (F.when((F.col("split") == "train") & (F.col("image_outcome") == "no_anomaly"), "normal_fit").when(F.col("split") == "validation", "calibration_validation"))
    return kept.withColumn("role", role).where("role is not null"), candidates.select("image_id", "split", F.col("anomaly_type").alias("category")).join(ex, "image_id")


def hybrid_manifest(candidates: DataFrame, reasons: DataFrame, seed: int = 271828, fit_share: float = 0.75) -> tuple[DataFrame, DataFrame]:
    """Role per image by identity component.

    Train images tied to validation leave. Clean train components are ordered by digest inside their
    category: a quarter (half-even, at least one, never all) joins the fusion fit, the rest fits the
    normal model. Components with an anomaly join the fusion fit; validation is the holdout.
    """
    # each stage is read several times below, so its lineage is cut once
    outside = checkpointed(candidates.join(reasons.select("image_id").distinct(), "image_id", "left_anti"))
    comp = identity_components(outside)
    j = checkpointed(outside.join(comp, "image_id"))
    spans = j.groupBy("group_key").agg(F.count_distinct("split").alias("n"))
    crossing = j.join(spans.where("n > 1"), "group_key", "left_semi").where("split = 'train'").select("image_id", F.lit("holdout:identity_or_group_crossing").alias("reason"))
    left = checkpointed(j.join(crossing.select("image_id"), "image_id", "left_anti").drop("group_key"))
    comp2 = identity_components(left)
    k = checkpointed(left.join(comp2, "image_id"))
    g = k.groupBy("group_key").agg(F.max("split").alias("split"), F.max((F.col("image_outcome") == "anomaly_present").cast("int")).alias("pos"),
                                   F.min("anomaly_type").alias("category"), F.max((F.coalesce("image_outcome", F.lit("")) == "").cast("int")).alias("unlabelled"))
    clean = g.where("split = 'train' and pos = 0 and unlabelled = 0").withColumn("digest", F.sha2(F.concat_ws("\x1f", F.lit(str(seed)), F.col("group_key").cast("string")), 256))
    clean = clean.withColumn("o", F.conv(F.substring("digest", 1, 12), 16, 10).cast("bigint"))
    place = ranked(clean, ["category"], [("o", True), ("group_key", True)], "place")
    n = clean.groupBy("category").agg(F.count("*").alias("n"))
    cut = F.least(F.greatest(F.lit(1), F.bround(F.col("n") * (1 - fit_share)).cast("bigint")), F.col("n") - 1)
    clean_roles = place.join(n, "category").select("group_key", F.when(F.col("place") <= cut, "hybrid_fusion_fit").otherwise("hybrid_normal_fit").alias("role"))
    other = g.where("split = 'validation'").select("group_key", F.lit("hybrid_development_holdout").alias("role")).unionByName(
        g.where("split = 'train' and pos = 1").select("group_key", F.lit("hybrid_fusion_fit").alias("role")))
    members = k.join(clean_roles.unionByName(other), "group_key")
    excluded = exclusion_reasons(reasons.unionByName(crossing))
    return members, excluded


def role_view(members: DataFrame, role: str, name: str) -> DataFrame:
    """Register a view that shows one role only; an empty role is an error."""
    view = members.where(F.col("role") == role)
    if not any_row(view):
        raise ValueError(f"role {role} has no members")
    view.createOrReplaceTempView(name)
    return view


def manifest_hash(members: DataFrame, by: Sequence[str] = ("role",)) -> DataFrame:
    row = F.sha2(F.concat_ws(",", F.col("image_id").cast("string"), "sha256_hash"), 256)
    return ordered_hash(members, list(by), [("image_id", True)], row, "manifest_hash")


# ---- specifications -----------------------------------------------------------------------
def specification_faults(spec: DataFrame, hash_columns: Sequence[str]) -> DataFrame:
    """Rule violations of specification rows, joined; empty when a row may be registered."""
    f = [F.when(~F.coalesce(F.col(c).rlike(SHA256_SHAPE), F.lit(False)), F.lit(f"{c} is not a SHA-256")) for c in hash_columns]
    f += [F.when(F.col("images") < 1, "no selected images"), F.when(F.col("methods") < 1, "no methods"), F.when(F.col("image_count") != F.col("images"), "selected images repeat"),
          F.when(F.col("maximum_proposals") <= 0, "maximum proposal count"), F.when(~F.forall("thresholds", lambda v: (v >= 0) & (v <= 1)), "thresholds outside [0, 1]"),
          F.when(F.array_contains("fitting_splits", "test"), "test split used for fitting"),
          F.when((F.col("tree_state") == "clean") & F.col("diff_hash").isNotNull(), "clean tree with a diff hash"),
          F.when((F.col("tree_state") == "dirty") & ~F.coalesce(F.col("diff_hash").rlike(SHA256_SHAPE), F.lit(False)), "dirty tree without a diff hash"),
          F.when(~F.col("tree_state").isin("clean", "dirty"), "tree state")]
    return spec.select("specification_id", listed(f).alias("faults"))


def build_specification(members: DataFrame, methods: DataFrame, sections: dict[str, Column]) -> DataFrame:
    """One immutable row per role: ordered member hash, method hash, pair count and the row's own hash.

    The member list itself stays the member table; the specification pins it by its ordered hash.
    """
    m = manifest_hash(members).join(members.groupBy("role").agg(F.count("*").alias("images")), "role")
    meth = methods.agg(F.count("*").alias("methods"), F.sha2(F.array_join(F.array_sort(F.collect_list("method")), ","), 256).alias("method_hash"))  # the short method list
    row = m.crossJoin(F.broadcast(meth)).withColumn("expected_pairs", F.col("images") * F.col("methods"))
    fields = {c: F.col(c) for c in ("role", "manifest_hash", "images", "methods", "method_hash", "expected_pairs")}
    return row.withColumn("specification_hash", canonical_hash({**fields, **sections}))


