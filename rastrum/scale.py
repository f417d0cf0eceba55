"""Order-dependent building blocks that stay parallel when one group holds most of the rows.

A Spark window sends each group to one task. These helpers measure the groups first; where one
is too large they cut the *order* into ranges, do the work per (group, range) and add the totals
of the earlier ranges, so no task ever sees a whole hot group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .core import HOT_ROWS_KEY, any_row, checkpointed, conf_int

PART_ROWS = 200_000
Order = tuple[str, bool]  # (column, ascending)


def hot_limit(df: DataFrame) -> int:
    return conf_int(df.sparkSession, HOT_ROWS_KEY, 2_000_000)


def has_hot_group(df: DataFrame, by: Sequence[str], limit: int | None = None) -> bool:
    """Does a group exceed the limit? Counted, since estimates know nothing of exploded rows."""
    limit = limit or hot_limit(df)
    if not by:
        return df.limit(limit + 1).count() > limit
    return any_row(df.groupBy(*by).count().where(F.col("count") > limit))


def dealt_out(df: DataFrame, key: str, rows: int) -> DataFrame:
    """Large tables in partitions of about PART_ROWS rows, dealt out by a key without hot values.

    What a task then sorts, ranks and groups by that key, or by more columns, does not grow with the table."""
    if rows <= 8 * PART_ROWS:
        return df
    return df.repartition(max(conf_int(df.sparkSession, "spark.sql.shuffle.partitions", 200), rows // PART_ROWS + 1), key)


def _order(order: Sequence[Order]) -> list[Column]:
    return [F.col(c).asc() if asc else F.col(c).desc() for c, asc in order]


def _order_key(order: Sequence[Order]) -> Column:
    """A struct that sorts ascending in the wanted order (descending keys must be numeric)."""
    parts = []
    for i, (c, asc) in enumerate(order):
        col = F.col(c) if asc else -F.col(c)
        flag = F.col(c).isNotNull() if asc else F.col(c).isNull()  # Spark: nulls first asc, last desc
        parts += [flag.cast("int").alias(f"n{i}"), col.alias(f"k{i}")]
    return F.struct(*parts)


def with_ranges(df: DataFrame, order: Sequence[Order], pieces: int, name: str) -> DataFrame:
    """Add the number of the order range each row falls in; the range ends are literals."""
    keyed = df.withColumn("__key", _order_key(order))
    sample = keyed.select("__key").distinct().orderBy(F.xxhash64("__key")).limit(pieces * 20)
    ends = (sample.withColumn("__t", F.ntile(pieces).over(Window.orderBy("__key")))
            .groupBy("__t").agg(F.max("__key").alias("e")).agg(F.array_sort(F.collect_list("e")).alias("ends")))
    # one row of at most `pieces` keys, so the broadcast is bounded by construction
    ends = checkpointed(ends)
    return (keyed.crossJoin(F.broadcast(ends))
            .withColumn(name, F.size(F.filter("ends", lambda e: e < F.col("__key"))))
            .drop("ends", "__key"))


def running_sums(df: DataFrame, by: Sequence[str], order: Sequence[Order], sums: dict[str, Column],
                 hot: bool | None = None) -> DataFrame:
    """Inclusive running sums per group in a total order."""
    by = list(by)
    limit = hot_limit(df)
    if hot is None:
        hot = has_hot_group(df, by, limit)
    if not hot:
        w = Window.partitionBy(*by).orderBy(*_order(order)).rowsBetween(Window.unboundedPreceding, 0)
        return df.select("*", *[F.sum(e).over(w).alias(n) for n, e in sums.items()])
    pieces = max(8, df.count() // limit + 1)
    cut = with_ranges(df, order, pieces, "__range")
    for n, e in sums.items():
        cut = cut.withColumn(f"__in_{n}", e)
    keys = [*by, "__range"]
    w = Window.partitionBy(*keys).orderBy(*_order(order)).rowsBetween(Window.unboundedPreceding, 0)
    local = cut.select("*", *[F.sum(f"__in_{n}").over(w).alias(f"__run_{n}") for n in sums])
    before = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    totals = (cut.groupBy(*keys).agg(*[F.sum(f"__in_{n}").alias(f"__tot_{n}") for n in sums])
              .select(*[F.col(k).alias(f"__k_{k}") for k in keys],
                      *[F.coalesce(F.sum(f"__tot_{n}").over(before), F.lit(0)).alias(f"__off_{n}") for n in sums]))
    on = None
    for k in keys:
        c = local[k].eqNullSafe(totals[f"__k_{k}"])
        on = c if on is None else on & c
    joined = local.join(totals, on)
    return joined.select(*[local[c] for c in df.columns],
                         *[(F.col(f"__run_{n}") + F.col(f"__off_{n}")).alias(n) for n in sums])


def ranked(df: DataFrame, by: Sequence[str], order: Sequence[Order], name: str, hot: bool | None = None) -> DataFrame:
    """1-based position in a total order, per group."""
    return running_sums(df, by, order, {name: F.lit(1).cast("bigint")}, hot)


def _fused(a: Column, b: Column, c: Column) -> Column:
    """a * b + c of doubles, rounded once: the product's and the sum's rounding errors are added back (Dekker, Knuth).

    Values whose parts overflow take the plain form."""
    def split(x: Column) -> tuple[Column, Column]:
        top = 134217729.0 * x - (134217729.0 * x - x)
        return top, x - top
    (ah, al), (bh, bl), p = split(a), split(b), a * b
    s = p + c
    rest = (p - (s - (s - p))) + (c - (s - p))
    out = s + (rest + (((ah * bh - p) + ah * bl + al * bh) + al * bl))
    return F.when(F.isnan(out), s).otherwise(out)


def exact_quantiles(df: DataFrame, by: Sequence[str], value: str, probs: dict[str, float], hot: bool | None = None) -> DataFrame:
    """Linear-interpolated exact quantiles per group, nulls ignored.

    Equal values are counted before anything is ordered, so a hot value costs one row, and a hot
    group is ordered in ranges.
    """
    by = list(by)
    counts = (df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("__v"))
              .agg(F.count("*").alias("__n")))
    run = running_sums(counts, by, [("__v", True)], {"__hi": F.col("__n")}, hot)
    totals = counts.groupBy(*by).agg(F.sum("__n").alias("__total"))
    if by:
        tot = totals.select(*[F.col(b).alias(f"__b_{b}") for b in by], "__total")
        cond = None
        for b in by:
            c = run[b].eqNullSafe(tot[f"__b_{b}"])
            cond = c if cond is None else cond & c
        run = run.join(tot, cond).drop(*[f"__b_{b}" for b in by])
    else:
        run = run.crossJoin(F.broadcast(totals))  # one row
    aggs, out = [], []
    for name, p in probs.items():
        pos = F.lit(p) * (F.col("__total") - 1)
        lo, hi = F.floor(pos), F.ceil(pos)
        def at(k: Column) -> Column:
            return F.max(F.when((k < F.col("__hi")) & (k >= F.col("__hi") - F.col("__n")), F.col("__v").cast("double")))
        aggs += [at(lo).alias(f"__lo_{name}"), at(hi).alias(f"__hi_{name}"), F.max(pos - lo).alias(f"__part_{name}")]
        low, high, part = (F.col(f"__{x}_{name}") for x in ("lo", "hi", "part"))
        # as SQL's quantile_cont, to the last bit: between equal values it is that value, so they still reach it
        out.append(F.when(low == high, low).otherwise(_fused(low, 1 - part, high * part)).alias(name))
    return run.groupBy(*by).agg(*aggs).select(*by, *out)


def ordered_hash(df: DataFrame, by: Sequence[str], order: Sequence[Order], row_hash: Column, name: str,
                 fan: int = 4096, levels: int = 4) -> DataFrame:
    """SHA-256 over rows in order, as a tree of fixed fan-out so no task reads a whole group.

    The tree has ``levels`` levels, and more where a group has more than fan ** levels rows.
    """
    by = list(by)
    pos = ranked(df.withColumn("__h", row_hash), by, order, "__pos")
    cur = pos.select(*by, (F.col("__pos") - 1).alias("__i"), "__h")
    level = 0
    while level < levels or any_row(cur.where("__i > 0")):
        level += 1
        cur = (cur.groupBy(*by, F.floor(F.col("__i") / fan).alias("__p"))
               .agg(F.sha2(F.array_join(F.transform(
                   F.array_sort(F.collect_list(F.struct("__i", "__h"))), lambda s: s["__h"]), ","), 256).alias("__h"))
               .select(*by, F.col("__p").alias("__i"), "__h"))
    return cur.select(*by, F.col("__h").alias(name))
