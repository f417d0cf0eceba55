"""Memory bank, exact nearest neighbours, greedy k-centre selection and dense map metrics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..core import any_row, checkpointed, conf_int, fits, r6
from ..scale import exact_quantiles, running_sums

MEMORY_KEY = "spark.rastrum.memoryRows"


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, v: s + v))


def fit_memory(vectors: DataFrame, clean: Column) -> DataFrame:
    """Vectors of the clean role; ids must be unique."""
    if any_row(vectors.groupBy("vec_id").count().where("count > 1")):
        raise ValueError("vector ids repeat")
    return vectors.where(clean).select("vec_id", "embedding")


#: most bytes of one matrix of distances
BLOCK_BYTES = 32_000_000


def _nearest(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, bank: np.ndarray, k: int) -> Iterator[pd.DataFrame]:
    """The k nearest rows of ``bank`` (all, if fewer) of each query, ties to smaller ids, in bounded matrices."""
    squares = (bank * bank).sum(axis=1)[None, :]
    step = max(1, BLOCK_BYTES // (8 * len(bank)))
    for lo in range(0, len(queries), step):
        q = queries[lo:lo + step]
        norms = (q * q).sum(axis=1)[:, None] + squares
        near = norms - 2 * (q @ bank.T)  # squared distances up to rounding
        take = min(k, bank.shape[0])
        cut = np.partition(near, take - 1, axis=1)[:, take - 1] + 1e-9 * norms.max(axis=1)
        out_ids, out_d = [], []
        for i in range(len(q)):  # the few that can be among the first are measured exactly
            some = np.flatnonzero(near[i] <= cut[i])
            d = np.sqrt(((q[i] - bank[some]) ** 2).sum(axis=1))
            best = np.lexsort((ids[some], d))[:take]
            out_ids.append(ids[some[best]])
            out_d.append(d[best])
        yield pd.DataFrame({"query_id": np.repeat(query_ids[lo:lo + step], take), "vec_id": np.concatenate(out_ids),
                            "distance": np.concatenate(out_d), "rank": np.tile(np.arange(1, take + 1), len(q))})


def _matrix(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors, the first two columns."""
    return pdf.iloc[:, 0].to_numpy("int64"), np.stack(pdf.iloc[:, 1].to_numpy()).astype("float64")


NEAR = "query_id bigint, vec_id bigint, distance double, rank bigint"
#: rows of a block of queries and of memory that meet in one call
QUERY_ROWS, BANK_ROWS = 4_096, 16_384


def _blocks(rows: DataFrame, own: str, count: int, other: str, others: int) -> DataFrame:
    """Rows with the number of their block, once for each block of the other side."""
    # new names: queries and memory may come from one table, whose columns a cogroup could not tell apart
    return rows.select(F.col("vec_id").alias(f"{own}_id"), F.col("embedding").alias(f"{own}_vector"), F.pmod(F.xxhash64("vec_id"), F.lit(count)).cast("int").alias(own),
                       F.explode(F.sequence(F.lit(0), F.lit(others - 1))).alias(other))


def knn(queries: DataFrame, memory: DataFrame, k: int) -> DataFrame:
    """Exact k nearest memory rows of every query: (query_id, vec_id, distance, rank).

    A bank of a checked small size travels with the tasks. A larger one is cut into blocks, as are the
    queries; every two blocks meet in one call that multiplies matrices and hands on k rows a query, of
    which the first k are kept, so the answer stays exact and no pair of vectors becomes a row.
    """
    limit = conf_int(memory.sparkSession, MEMORY_KEY, 20_000)
    if fits(memory, limit):
        rows = memory.select("vec_id", "embedding").orderBy("vec_id").toPandas()  # at most `limit` rows
        if rows.empty:
            raise ValueError("the memory bank is empty")
        ids, bank = _matrix(rows)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if len(b):
                    yield from _nearest(*_matrix(b), ids, bank, k)
        return queries.select("vec_id", "embedding").mapInPandas(run, NEAR)
    n_queries, n_bank = queries.count() // QUERY_ROWS + 1, memory.count() // BANK_ROWS + 1

    def meet(q: pd.DataFrame, m: pd.DataFrame) -> pd.DataFrame:
        if q.empty or m.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "distance": [], "rank": []})
        return pd.concat(_nearest(*_matrix(q), *_matrix(m), k), ignore_index=True)
    both = ["qb", "mb"]
    left, right = _blocks(queries, "qb", n_queries, "mb", n_bank), _blocks(memory, "mb", n_bank, "qb", n_queries)
    found = left.groupBy(*both).cogroup(right.groupBy(*both)).applyInPandas(meet, NEAR)
    if n_bank == 1:
        return found
    top = Window.partitionBy("query_id").orderBy("distance", "vec_id")
    return found.withColumn("rank", F.row_number().over(top).cast("bigint")).where(F.col("rank") <= k)


def kcentre(vectors: DataFrame, centres: int, every: int = 5) -> DataFrame:
    """Greedy farthest-point subset, starting at the smallest id: (position, vec_id, radius).

    A round costs one pass that lowers each row's distance to its nearest centre and one row back;
    lineage is cut every few rounds.
    """
    spark = vectors.sparkSession
    state = checkpointed(vectors.select("vec_id", "embedding").withColumn("d", F.lit(None).cast("double")))
    picked = state.agg(F.min_by(F.struct("vec_id", "embedding", "d"), "vec_id").alias("p")).first()["p"]
    out = []
    for i in range(1, centres + 1):
        out.append((i, picked["vec_id"], picked["d"]))
        if i == centres:
            break
        centre = F.array(*[F.lit(float(v)) for v in picked["embedding"]])
        state = state.withColumn("d", F.least("d", distance(F.col("embedding"), centre)))
        if i % every == 0:
            state = checkpointed(state)
        picked = state.agg(F.max_by(F.struct("vec_id", "embedding", "d"), F.struct(F.col("d"), -F.col("vec_id"))).alias("p")).first()["p"]
    return spark.createDataFrame(out, "position bigint, vec_id bigint, radius double")


def image_scores(neighbours: DataFrame, image_of: Column) -> DataFrame:
    """Per image the largest nearest-neighbour distance and the mean distance over all k."""
    per = neighbours.groupBy("query_id").agg(F.min("distance").alias("nearest"), F.avg("distance").alias("mean_k"))
    return per.groupBy(image_of.alias("image_id")).agg(r6(F.max("nearest")).alias("score"), r6(F.max("mean_k")).alias("score_k"), F.count("*").alias("vectors"))


# ---- dense maps ---------------------------------------------------------------------------
def thresholds(pixels: DataFrame, count: int = 101) -> DataFrame:
    """One row: distinct pooled quantiles, ascending (a bounded array).

    Distinct values carry their cumulative counts; a value is asked only for the few quantile
    positions that fall into its own interval.
    """
    counts = pixels.where(F.col("v").isNotNull()).groupBy(F.col("v").cast("double").alias("q")).agg(F.count("*").alias("n"))
    run = running_sums(counts, [], [("q", True)], {"hi": F.col("n")}).withColumn("lo", F.col("hi") - F.col("n"))
    total = counts.agg(F.sum("n").alias("total"))
    r = run.crossJoin(F.broadcast(total))  # one row
    last = count - 1
    pos = lambda i: i / F.lit(float(last)) * (F.col("total") - 1)
    scale = F.lit(float(last)) / F.greatest(F.col("total") - 1, F.lit(1))
    first, end = F.greatest(F.floor((F.col("lo") - 1) * scale), F.lit(0)), F.least(F.ceil(F.col("hi") * scale), F.lit(last))
    near = F.when(F.col("total") == 1, F.sequence(F.lit(0).cast("bigint"), F.lit(last).cast("bigint"))).otherwise(F.sequence(first, F.greatest(first, end)))
    holds = lambda p: (p >= F.col("lo")) & (p < F.col("hi"))
    hits = r.select("q", "total", "lo", "hi", F.explode(near).alias("i")).select(
        "i", (pos(F.col("i")) - F.floor(pos(F.col("i")))).alias("f"), F.when(holds(F.floor(pos(F.col("i")))), F.col("q")).alias("a"), F.when(holds(F.ceil(pos(F.col("i")))), F.col("q")).alias("b"))
    q = hits.where("a is not null or b is not null").groupBy("i").agg((F.max("a") + (F.max("b") - F.max("a")) * F.max("f")).alias("t"))
    return q.agg(F.array_sort(F.collect_set("t")).alias("thr"))  # at most `count` values


def threshold_cell(pixels: DataFrame, values: list[float], name: str) -> DataFrame:
    """Number of thresholds at or below each pixel, by the JVM's binary search."""
    splits = [float("-inf"), *values, float("inf")]
    return Bucketizer(splits=splits, inputCol="v", outputCol=name, handleInvalid="error").transform(pixels)


def au_pro(pixels: DataFrame, regions: DataFrame, count: int = 101, limit: float = 0.30) -> DataFrame:
    """Area under mean region overlap against clean-pixel false-positive rate, up to ``limit``.

    ``pixels``: image_id, y, x, v, clean. ``regions``: region_id, image_id, y, x. Each pixel is
    placed once among the thresholds; the curve is a suffix sum over at most 102 cells.
    """
    thr = thresholds(pixels, count).first()["thr"]  # at most `count` numbers
    size = regions.groupBy("region_id").agg(F.count("*").alias("size"))
    weight = regions.join(size, "region_id").select("image_id", "y", "x", (1.0 / F.col("size")).alias("w"))
    n_regions = size.agg(F.count("*").alias("regions"))
    j = threshold_cell(pixels.join(weight, ["image_id", "y", "x"], "left"), thr, "cell")
    g = j.groupBy("cell").agg(F.sum(F.col("clean").cast("bigint")).alias("fp"), F.coalesce(F.sum("w"), F.lit(0.0)).alias("w"))
    n_clean = pixels.agg(F.sum(F.col("clean").cast("bigint")).alias("clean_pixels"))
    up = Window.orderBy(F.desc("cell")).rowsBetween(Window.unboundedPreceding, 0)  # at most 102 rows
    curve = g.select("cell", F.sum("fp").over(up).alias("fp"), F.sum("w").over(up).alias("w")).where("cell > 0")
    c = curve.crossJoin(F.broadcast(n_clean)).crossJoin(F.broadcast(n_regions)).select((F.col("fp") / F.col("clean_pixels")).alias("fpr"), (F.col("w") / F.col("regions")).alias("pro"))
    zero = n_regions.select(F.lit(0.0).alias("fpr"), F.lit(0.0).alias("pro"))  # the threshold above every score
    best = c.unionByName(zero).where(F.col("fpr") <= limit + 1e-12).groupBy("fpr").agg(F.max("pro").alias("pro"))
    end = best.agg(F.max_by("pro", "fpr").alias("pro"), F.max("fpr").alias("f")).where(F.col("f") < limit).select(F.lit(limit).alias("fpr"), "pro")
    pts = best.unionByName(end)
    w = Window.orderBy("fpr")
    step = (F.col("fpr") - F.lag("fpr").over(w)) * (F.col("pro") + F.lag("pro").over(w)) / 2
    return pts.select(step.alias("s")).agg(r6(F.sum("s") / limit).alias("au_pro"))


def map_distributions(pixels: DataFrame) -> DataFrame:
    """Mean, population deviation, quantiles and maximum per outcome and per category."""
    g = pixels.select(F.explode(F.array(F.concat(F.lit("outcome:"), "outcome"), F.concat(F.lit("category:"), "category"))).alias("group_name"), "v")
    base = g.groupBy("group_name").agg(r6(F.avg("v")).alias("mean"), r6(F.stddev_pop("v")).alias("std"), r6(F.max("v")).alias("maximum"))
    q = exact_quantiles(g, ["group_name"], "v", {"p50": 0.5, "p95": 0.95, "p99": 0.99})
    return base.join(q.select("group_name", *[r6(c).alias(c) for c in ("p50", "p95", "p99")]), "group_name")


def clean_map_reference(pixels: DataFrame) -> DataFrame:
    """Median of the clean images' 0.95 quantiles."""
    per = exact_quantiles(pixels.where("clean"), ["image_id"], "v", {"q95": 0.95})
    return exact_quantiles(per, [], "q95", {"reference": 0.5}).select(r6("reference").alias("reference"))
