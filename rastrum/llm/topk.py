"""Exact top-k inner products over integer vectors with vector-approximation files.

Vectors are stored in blocks. A block keeps, besides the exact integers, one byte per component:
the cell of that component between the block's smallest and largest value. Cells bound every score
from above; exact vectors of a block are read in the order of those bounds until no bound left can
reach the k-th result. Each block answers with k rows a query at most, and Spark merges them.

Queries go in blocks of ``QUERY_BLOCK`` at most on average, each sent to the tasks as one matrix of
bounded size, against all blocks. No pair of vectors is ever a row.

Defined cases: vectors that are null, or hold a null or non-finite component, take no part, nor do
empty ones; vectors of different lengths do not meet; a query's own rows are those with its id;
repeated candidate rows count each, repeated query rows once; ties go to the smaller id, null ids
last; an empty table, or one without queries, gives no row. Components are 64-bit integers; scores
are exact where they fit into 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import record, written

BLOCK_ROWS = 2048
QUERY_BLOCK = 1024
BLOCK = "dim int, n int, ids array<long>, cells binary, lows binary, steps binary, vectors binary"


def integer_vectors(df: DataFrame, id_col: str, vector: str, scale: int = 256) -> DataFrame:
    """(id, v): floor(scale * x) of each usable vector."""
    big = 1.7976931348623157e308
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) <= big))
    return df.where(F.col(vector).isNotNull() & (F.size(vector) > 0) & whole).select(
        F.col(id_col).alias("id"), F.transform(vector, lambda x: F.floor(x.cast("double") * scale)).alias("v"))


def approximation_blocks(vectors: DataFrame) -> DataFrame:
    """Blocks of (id, v) rows, written to the shared folder: partitions are cut where they lie."""
    schema = pa.schema([("dim", pa.int32()), ("n", pa.int32()), ("ids", pa.list_(pa.int64())), ("cells", pa.binary()), ("lows", pa.binary()), ("steps", pa.binary()), ("vectors", pa.binary())])

    def block(ids: list, rows: np.ndarray) -> pa.RecordBatch:
        low, high = rows.min(axis=0), rows.max(axis=0)
        step = np.maximum(1, -(-(high - low + 1) // 256))
        cells = ((rows - low) // step).astype(np.uint8)
        return record(schema, dim=[rows.shape[1]], n=[len(rows)], ids=[ids], cells=[cells.tobytes()], lows=[low.astype("<i8").tobytes()], steps=[step.astype("<i8").tobytes()], vectors=[rows.astype("<i8").tobytes()])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, tuple[list, list]] = {}
        for batch in batches:
            column = batch.column("v")
            lengths = np.diff(column.offsets.to_numpy())
            flat, at = column.values.to_numpy(), column.offsets.to_numpy()
            for n in np.unique(lengths):
                rows = np.flatnonzero(lengths == n)
                ids, parts = waiting.setdefault(int(n), ([], []))
                ids += batch.column("id").take(pa.array(rows)).to_pylist()
                parts.append(flat[at[rows][:, None] + np.arange(n)])
                while len(ids) >= BLOCK_ROWS:
                    whole = np.concatenate(parts)
                    yield block(ids[:BLOCK_ROWS], whole[:BLOCK_ROWS])
                    ids[:], parts[:] = ids[BLOCK_ROWS:], [whole[BLOCK_ROWS:]]
        for ids, parts in waiting.values():
            if ids:
                yield block(ids, np.concatenate(parts))

    return written(vectors.mapInArrow(cut, BLOCK), "blocks")


def best_of_block(queries: np.ndarray, query_ids: np.ndarray, ids: np.ndarray, cells: np.ndarray, low: np.ndarray, step: np.ndarray, vectors: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(query row, block row, score) of the k best of one block for each query, by bounds.

    ``ids`` are sortable (null as the largest)."""
    from_, to = low + cells * step, low + cells * step + (step - 1)
    q = queries.astype(np.float64)
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    upper = up @ to.T.astype(np.float64) + down @ from_.T.astype(np.float64)
    upper += (np.abs(q) @ np.maximum(np.abs(from_), np.abs(to)).T.astype(np.float64)) * 1e-12  # covers rounding
    own = query_ids[:, None] == ids[None, :]
    upper[own] = -np.inf
    out = []
    start = min(len(ids), max(4 * k, 16))
    first = np.argpartition(-upper, start - 1, axis=1)[:, :start] if start < len(ids) else np.tile(np.arange(len(ids)), (len(q), 1))
    for i in range(len(q)):
        take = first[i][upper[i, first[i]] > -np.inf]
        scores = vectors[take] @ queries[i]
        if len(take) and start < len(ids):
            kth = np.sort(scores)[-k] if len(scores) >= k else -np.inf
            rest = np.setdiff1d(np.flatnonzero(upper[i] >= kth), first[i], assume_unique=True)  # equal scores may win by id
            rest = rest[np.argsort(-upper[i, rest], kind="stable")]
            while len(rest):  # in bound order, until no bound can reach the k-th score
                part, rest = rest[:64], rest[64:]
                take, scores = np.concatenate([take, part]), np.concatenate([scores, vectors[part] @ queries[i]])
                if len(scores) >= k:
                    kth = np.sort(scores)[-k]
                    keep = scores >= kth
                    take, scores = take[keep], scores[keep]
                rest = rest[upper[i, rest] >= kth]
        best = np.lexsort((ids[take], -scores))[:k]
        out += [(i, int(take[b]), int(scores[b])) for b in best]
    return out


def top_k(vectors: DataFrame, is_query, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of all (id, v) rows for each row with ``is_query``."""
    spark = vectors.sparkSession
    blocks = approximation_blocks(vectors)
    queries = written(vectors.where(is_query).distinct(), "queries")
    n_blocks = -(-queries.count() // QUERY_BLOCK)
    none = np.iinfo(np.int64).max
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
    found = spark.createDataFrame([], "query_id long, vec_id long, score long")
    for b in range(n_blocks):  # each a matrix of bounded size
        rows = queries.where(F.pmod(F.xxhash64("id"), F.lit(n_blocks)) == b).collect()
        by_dim = {}
        for r in rows:
            by_dim.setdefault(len(r["v"]), []).append((r["id"], r["v"]))
        sent = spark.sparkContext.broadcast({d: (np.array([i for i, _ in x], np.int64), np.array([v for _, v in x], np.int64)) for d, x in by_dim.items()})

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    if row["dim"] not in sent.value:
                        continue
                    query_ids, matrix = sent.value[row["dim"]]
                    shape = (row["n"], row["dim"])
                    ids = np.array([none if i is None else i for i in row["ids"]], np.int64)
                    best = best_of_block(matrix, query_ids, ids, np.frombuffer(row["cells"], np.uint8).reshape(shape).astype(np.int64), np.frombuffer(row["lows"], "<i8"),
                                         np.frombuffer(row["steps"], "<i8"), np.frombuffer(row["vectors"], "<i8").reshape(shape), k)
                    yield record(schema, query_id=[int(query_ids[i]) for i, _, _ in best], vec_id=[row["ids"][j] for _, j, _ in best], score=[s for _, _, s in best])

        found = found.unionByName(blocks.mapInArrow(search, "query_id long, vec_id long, score long"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
