"""Mixing sources to target weights along a time-varying curriculum, in DataFrame functions alone.

Every source has a target (words the mix takes from it) and a weight schedule over training time
0..1. The integral of the schedule, scaled to the target, is the source's cumulative word demand;
inverting it turns a document's place in its source into a training position, and the mix is the
documents sorted by position with a range exchange.

Within a source the order is that of md5(doc_id). Running word counts are taken per slice of that
order (slices grow in number with the source) plus the totals of earlier slices, so a source with
a third of all rows is never in one task. Only ids, sizes and sources are exchanged, no texts.

Defined cases: a null text has size 0; a null source is a source of its own, after all others;
documents of size 0 take nothing and have no position; ties in md5(doc_id) can only be repeated ids
and go by doc_id, then size; repeated rows are separate documents; an empty table gives an empty
mix; other columns are ignored by ``mix`` and kept by ``mixed_documents``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scale import ranked, running_sums
from .common import WORD, all_equal, partitions, written

Schedule = Sequence[tuple[float, float]]
#: fading, steady and rising sources, dealt to sources like the weights
SCHEDULES: tuple[Schedule, ...] = (((0.0, 2.0), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 1.0), (1.0, 2.0)))
SLICE_ROWS = 4096


def _segments(schedule: Schedule) -> tuple[list[tuple[float, float, float, float, float]], float]:
    """(mass before, mass up to the end, start, weight at start, slope) of each piece; total mass."""
    if len(schedule) < 2 or schedule[0][0] != 0 or schedule[-1][0] != 1:
        raise ValueError("a schedule runs from time 0 to time 1")
    out, mass = [], 0.0
    for (t0, w0), (t1, w1) in zip(schedule, schedule[1:], strict=False):
        if t1 <= t0 or w0 < 0 or w1 < 0:
            raise ValueError("times must rise and weights must not be negative")
        out.append((mass, mass + (t1 - t0) * (w0 + w1) / 2, t0, w0, (w1 - w0) / (t1 - t0)))
        mass = out[-1][1]
    if mass <= 0:
        raise ValueError("a schedule needs some weight")
    return out, mass


def time_of(share: Column, schedule: Schedule) -> Column:
    """Training time at which the schedule has spent ``share`` (0..1) of its mass."""
    pieces, total = _segments(schedule)
    spent = share * F.lit(total)
    out = None
    for before, after, t0, w0, slope in pieces:
        rest = spent - F.lit(before)
        root = F.sqrt(F.greatest(F.lit(w0 * w0) + F.lit(2 * slope) * rest, F.lit(0.0)))
        t = F.when(rest <= 0, F.lit(t0)).otherwise(F.lit(t0) + F.lit(2.0) * rest / (F.lit(w0) + root))
        here = spent <= F.lit(after)
        out = F.when(here, t) if out is None else out.when(here, t)
    return F.least(out.otherwise(F.lit(1.0)), F.lit(1.0))


def source_targets(sources: DataFrame, weights: Sequence[float], share: float, cap: float, schedules: int) -> DataFrame:
    """Targets of (source, source_size) rows: ``share`` of all sizes dealt by weight, at most ``cap``
    times a source's size, the excess dealt again by weight.

    With sources in the order of cap * size / weight, a level is tried at each: what the full ones
    leave, divided by the weight of the rest. The first source that its level does not fill sets it.
    """
    numbered = ranked(sources.withColumn("no_name", F.col("source").isNull()), [], [("no_name", True), ("source", True)], "rank")
    pick = ((F.col("rank") - 1) % len(weights) + 1).cast("int")
    weighed = (numbered.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), pick))
               .withColumn("kind", ((F.col("rank") - 1) % schedules).cast("int"))
               .withColumn("most", F.lit(float(cap)) * F.col("source_size")).withColumn("ratio", F.col("most") / F.col("w")))
    run = running_sums(weighed, [], [("ratio", True), ("rank", True)], {"full": F.col("most"), "w_sum": F.col("w")})
    total = weighed.agg(F.sum("source_size").alias("all_size"), F.sum("w").alias("all_w"))
    level = (F.col("all_size") * F.lit(float(share)) - (F.col("full") - F.col("most"))) / (F.col("all_w") - (F.col("w_sum") - F.col("w")))
    tried = run.crossJoin(F.broadcast(total)).withColumn("level", level)  # one row
    chosen = tried.agg(F.min_by("level", F.struct("ratio", "rank")).alias("unused"),
                       F.min(F.when(F.col("ratio") > F.col("level"), F.struct("ratio", "rank", "level"))).alias("first"))
    return (weighed.crossJoin(F.broadcast(chosen.select(F.col("first.level").alias("level"))))  # one row
            .select("source", "source_size", "n_docs", "rank", "kind",
                    F.when(F.col("level").isNull(), F.col("most")).otherwise(F.least("most", F.col("w") * F.col("level"))).alias("target")))


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size in words and the order key; written once, since three steps read it."""
    return written(docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"),
                               F.xxhash64("text").alias("text_key"), F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("order")), "sized")


def mix(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, schedules: Sequence[Schedule] = SCHEDULES) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken, text_key and ``copies``,
    an array of (pass, words, position): the passes over the source in which the mix takes the document.

    A source is read in order, again and again, until its target (rounded to words) is met; the last
    document taken may be cut at that point, which keeps every source within a word of its target.
    """
    rows = sized(docs)
    sources = written(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs")), "sources")
    targets = written(source_targets(sources, weights, share, cap, len(schedules)), "targets")
    first_digits = F.conv(F.substring("order", 1, 8), 16, 10).cast("bigint")
    slices = F.ceil(F.col("n_docs") / SLICE_ROWS)
    t = targets.withColumnRenamed("source", "t_source")
    # sources are as few as the table of targets says; Spark broadcasts it only by its size on disk
    placed = rows.join(t, rows["source"].eqNullSafe(t["t_source"])).drop("t_source").withColumn("slice", F.floor(first_digits * slices / F.lit(2.0 ** 32)))
    sums = written(placed.groupBy("source", "slice").agg(F.sum("size").alias("slice_size")), "slices")
    before = running_sums(sums, ["source"], [("slice", True)], {"upto": F.col("slice_size")}).select(
        F.col("source").alias("b_source"), F.col("slice").alias("b_slice"), (F.col("upto") - F.col("slice_size")).alias("slice_start"))
    within = Window.partitionBy("source", "slice").orderBy("order", "doc_id", "size", "text_key").rowsBetween(Window.unboundedPreceding, 0)
    run = placed.withColumn("upto", F.sum("size").over(within))
    run = run.join(before, all_equal([run["source"], run["slice"]], [before["b_source"], before["b_slice"]]))
    start = F.col("slice_start") + F.col("upto") - F.col("size")
    goal = F.round("target").cast("bigint")
    passes = []
    for p in range(math.ceil(cap)):
        offset = F.lit(p) * F.col("source_size") + start
        words = F.greatest(F.lit(0).cast("bigint"), F.least(F.col("size"), goal - offset))
        spent = F.try_divide(offset + words / 2, goal)
        at = None
        for k, s in enumerate(schedules):
            at = F.when(F.col("kind") == k, time_of(spent, s)) if at is None else at.when(F.col("kind") == k, time_of(spent, s))
        passes.append(F.struct(F.lit(p).alias("pass"), words.alias("words"), at.alias("position")))
    copies = F.filter(F.array(*passes), lambda c: c["words"] > 0)
    return run.withColumn("copies", copies).select(
        "doc_id", "source", "size", "source_size", "target",
        F.aggregate("copies", F.lit(0).cast("bigint"), lambda a, c: a + c["words"]).alias("taken"), "copies", "text_key")


def by_position(df: DataFrame, *ties: str) -> DataFrame:
    """Rows in order of ``position``: one range exchange, then each range is sorted."""
    return df.repartitionByRange(partitions(df.sparkSession), "position", *ties).sortWithinPartitions("position", *ties)


def training_order(mixed: DataFrame) -> DataFrame:
    """One row per copy, in training order."""
    copies = mixed.select("doc_id", "source", "size", F.explode("copies").alias("c"))
    return by_position(copies.select("doc_id", "source", "size", "c.*"), "doc_id", "pass")


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The columns of ``docs``, a row for each copy the mix takes, in training order. A copy cut at the
    end of its source's target stays whole if at least half of its words are due, else it goes."""
    chosen = mix(docs, **how).select("doc_id", "text_key", F.filter("copies", lambda c: c["words"] * 2 >= F.col("size")).alias("copies"))
    # repeated rows: the n-th row of an id and text takes the n-th set of copies. Numbering, grouping and join have
    # one set of keys, without nulls, so that the texts are dealt out once for all three
    keys = ["id_key", "no_id", "text_key"]
    keyed = lambda d: d.withColumns({"no_id": F.col("doc_id").isNull(), "id_key": F.coalesce("doc_id", F.lit("0").cast(docs.schema["doc_id"].dataType))})
    left = keyed(docs.select(F.struct("*").alias("row"), "doc_id", F.xxhash64("text").alias("text_key"))).withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy(F.lit(1))))
    right = keyed(chosen.where(F.size("copies") > 0)).groupBy(*keys).agg(F.collect_list("copies").alias("sets"))
    both = left.join(right, keys).select("row", "doc_id", F.get("sets", F.col("nth") - 1).alias("copies"))
    copies = both.select("row", "doc_id", F.explode("copies").alias("c")).select("row", "doc_id", "c.position", "c.pass")
    return by_position(copies, "doc_id", "pass").select("row.*")
