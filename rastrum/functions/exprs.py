"""Scalar rules as Column expressions (all JVM-side, no Python UDFs)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Default weights of the priority score.
EVIDENCE_WEIGHTS = {
    "local_texture_contrast": 0.22, "local_colour_contrast": 0.20, "local_entropy_contrast": 0.13,
    "edge_concentration": 0.14, "gradient_contrast": 0.16, "geometric_irregularity": 0.15,
}
RELIABILITY_WEIGHTS = {
    "perturbation_stability": 0.24, "connectedness": 0.18, "boundary_smoothness": 0.18,
    "scale_agreement": 0.16, "segmentation_coherence": 0.24,
}
PRIORITY_WEIGHTS = {"anomaly_evidence": 0.60, "mask_reliability": 0.20, "area_relevance": 0.10, "novelty": 0.10}
# Categories that count as a true anomaly.
POSITIVE_TYPES = ("thin_crack", "weld_disturbance", "pitting_cluster", "colour_only", "texture_only")
SHA256_SHAPE = "^[0-9a-f]{64}$"


# ---- boxes and masks ----------------------------------------------------------------------
def area(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.greatest(x2 - x1, F.lit(0)) * F.greatest(y2 - y1, F.lit(0))


def box_area(p: str = "") -> Column:
    return area(*[F.col(f"{p}{c}") for c in ("x1", "y1", "x2", "y2")])


def box_intersection(a: str, b: str) -> Column:
    c = lambda p, n: F.col(f"{p}{n}")
    w = F.least(c(a, "x2"), c(b, "x2")) - F.greatest(c(a, "x1"), c(b, "x1"))
    h = F.least(c(a, "y2"), c(b, "y2")) - F.greatest(c(a, "y1"), c(b, "y1"))
    return F.greatest(w, F.lit(0)) * F.greatest(h, F.lit(0))


def iou(inter: Column, left: Column, right: Column, floor: int = 1) -> Column:
    return inter / F.greatest(left + right - inter, F.lit(floor))


def mask_iou(inter: Column, left: Column, right: Column, empty: float = 0.0) -> Column:
    union = left + right - inter
    return F.when(union > 0, inter / union).otherwise(F.lit(empty))


def mask_dice(inter: Column, left: Column, right: Column) -> Column:
    return F.when(left + right > 0, 2.0 * inter / (left + right)).otherwise(F.lit(0.0))


def share(inter: Column, whole: Column) -> Column:
    return F.when(whole > 0, inter / whole).otherwise(F.lit(0.0))


# ---- scores -------------------------------------------------------------------------------
def clamp01(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c.cast("double")))


def weighted_score(parts: Mapping[str, Column], weights: Mapping[str, float]) -> Column:
    """100 x weighted mean of the clamped parts; a missing part is 0, a negative weight is 0."""
    total = sum(max(w, 0.0) for w in weights.values()) or 1.0
    out = F.lit(0.0)
    for name, w in weights.items():
        if name in parts:
            out = out + clamp01(F.coalesce(parts[name].cast("double"), F.lit(0.0))) * max(w, 0.0)
    return out * (100.0 / total)


def contributions(parts: Mapping[str, Column], weights: Mapping[str, float] = EVIDENCE_WEIGHTS) -> dict[str, Column]:
    """Percentage of the evidence each part supplies."""
    each = {n: F.greatest(F.coalesce(parts[n].cast("double"), F.lit(0.0)), F.lit(0.0)) * w if n in parts else F.lit(0.0)
            for n, w in weights.items()}
    total = F.lit(0.0)
    for v in each.values():
        total = total + v
    return {n: F.when(total == 0, F.lit(0.0)).otherwise(100.0 * v / total) for n, v in each.items()}


def region_score(relative_area, edge_density, texture, colour, aspect, nearby) -> Column:
    """Six capped parts, capped at 100, one decimal (half-even)."""
    cap = lambda v, k, top: F.least(v * k, F.lit(top))
    total = (cap(relative_area, 360.0, 24.0) + cap(edge_density, 28.0, 22.0) + cap(texture, 22.0, 22.0)
             + cap(colour, 20.0, 18.0) + cap(F.greatest(aspect - 2.0, F.lit(0.0)), 3.0, 10.0) + cap(nearby, 2.0, 8.0))
    return F.bround(F.least(F.lit(100.0), total), 1)


def priority_label(score: Column) -> Column:
    return (F.when(score >= 72, "Review Required").when(score >= 52, "High").when(score >= 28, "Moderate").otherwise("Low"))


def severity_label(score: Column) -> Column:
    return F.when(score >= 82, "Critical").when(score >= 62, "High").when(score >= 35, "Medium").otherwise("Low")


# ---- hashes, ids, text ----------------------------------------------------------------------
def _let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it many times in ``body`` (a lambda argument is not re-evaluated)."""
    return F.transform(F.array(value), body)[0]


def text_dhash(text: Column) -> Column:
    """64 gradient bits of an 8 x 9 grid of equal slices of the whole text.

    A slice's tone is its count of blanks and of the letter e; bit (row, col) says whether the next slice
    in the row is brighter. Packed into one BIGINT so distance is ``bit_count(a ^ b)``. The text is
    cut into rows first and rows into slices, so it is scanned about 17 times, not 72.
    """
    def tones(n: Column) -> Column:
        at = lambda c: F.floor(c * n / 72)

        def row_tones(r: Column) -> Column:
            first = r * 9
            row = F.substr(text, (at(first) + 1).cast("int"), (at(first + 9) - at(first)).cast("int"))

            def tone(rowtext: Column, c: Column) -> Column:
                part = F.substr(rowtext, (at(c) - at(first) + 1).cast("int"), (at(c + 1) - at(c)).cast("int"))
                return F.length(part) - F.length(F.replace(F.replace(part, F.lit(" "), F.lit("")), F.lit("e"), F.lit("")))
            return _let(row, lambda rowtext: F.transform(F.sequence(first, first + 8), lambda c: tone(rowtext, c)))
        return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(7)), row_tones))
    return grid_dhash(_let(F.length(text).cast("bigint"), tones))


def grid_dhash(tones: Column) -> Column:
    """Horizontal gradient bits of 72 tones laid out as 8 rows of 9."""
    def packed(t: Column) -> Column:
        def bit(b: Column) -> Column:
            i = (F.floor(b / 8) * 9 + b % 8 + 1).cast("int")
            return F.when(F.element_at(t, i + 1) > F.element_at(t, i), F.lit(1).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
        # each step shifts the earlier bits up, so fold from the highest bit down
        return F.aggregate(F.transform(F.sequence(F.lit(63), F.lit(0), F.lit(-1)), bit), F.lit(0).cast("bigint"),
                           lambda acc, v: F.shiftleft(acc, 1).bitwiseOR(v))
    return _let(tones, packed)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b)).cast("bigint")


def string_hamming(a: Column, b: Column) -> Column:
    """Positions that differ plus the difference in length."""
    n = F.least(F.length(a), F.length(b))
    differs = F.aggregate(
        F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.when(x.isNotNull() & y.isNotNull() & (x != y), 1).otherwise(0)),
        F.lit(0), lambda acc, v: acc + v)
    return F.when(n == 0, 0).otherwise(differs) + F.abs(F.length(a) - F.length(b))


def is_sha256(c: Column) -> Column:
    return F.coalesce(c.rlike(SHA256_SHAPE), F.lit(False))


def canonical_hash(fields: Mapping[str, Column]) -> Column:
    """SHA-256 of canonical JSON: sorted keys, no blanks, nulls kept."""
    js = F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})
    return F.sha2(js, 256)


def outcome_of(category: Column) -> Column:
    return (F.when(category.isin(*POSITIVE_TYPES), "anomaly_present").when(F.coalesce(category, F.lit("")) != "", "no_anomaly")
            .otherwise(""))


def na(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("N/A"))


def stem(name: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(name, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")


def suffix(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"[^/.](\.[^./]*)$", 1))


def unsafe_path(p: Column) -> Column:
    """Absolute, empty-part or parent-escaping path."""
    parts = F.split(p, "/")
    return p.startswith("/") | F.array_contains(parts, "..") | F.array_contains(parts, "") | (F.trim(p) == "")


def duration_seconds(start: Column, end: Column) -> Column:
    """Seconds between two ISO texts, never negative, 0 when either does not parse."""
    a, b = F.try_to_timestamp(start), F.try_to_timestamp(end)
    secs = (F.unix_micros(b) - F.unix_micros(a)) / 1e6
    return F.coalesce(F.greatest(secs, F.lit(0.0)), F.lit(0.0))
