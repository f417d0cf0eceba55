"""Near-duplicate vectors within a label by an inverted multi-index.

Vectors are brought to length one and cut into halves; each half has a codebook of its own, and a
cell is a pair of codes. A vector looks for partners cell by cell in the order of the squared distance
that any vector of the cell keeps from it (the distances to the codes' bisecting planes, added over
the halves), and stops at a limit. Everything in a visited cell is compared exactly, by matrix products.

The limit. At ``recall`` 1 it is ``2 - 2 * threshold``: beyond it no partner can lie, so every link is
found. Below 1, a bounded sample of vectors is compared with all rows of their labels; the limit is what the
most demanding of them needs to reach ``recall``, half as much again, and never more than the limit
that loses nothing, which also holds where the sample shows no link. ``measured_recall`` holds the
result against brute force with other vectors than those that set the limit.

What is fitted on samples: the codebooks (``SAMPLE`` vectors at most, chosen by hash) and the limit
(``QUERIES`` at most). All rows are indexed, all are compared.

Skew. Equal vectors are one vector with a weight. A cell column (label, first code) of any size is
cut into pieces of about ``PIECE`` rows, and pieces meet in pairs that are dealt over the executors: no group
is in one task and no pair is a row. A task answers with a number of links and one edge a vector.

Defined cases: vectors that are null, empty, zero, or hold a null or non-finite component, and rows
without a label, link with nothing; vectors of different lengths do not link; null ids never name a
component that has another id; repeated ids are rows of their own; ties do not matter; an empty table gives
no row; other columns are not used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from .common import record, written

SAMPLE = 20_000
QUERIES = 512
PIECE = 4096
#: a visited column's second codes are a bit mask
MOST_CODES = 63
BINS = 256
SLICE = 512


def usable(vector: str, label: str) -> Column:
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) <= 1.7976931348623157e308))
    return F.col(label).isNotNull() & F.col(vector).isNotNull() & (F.size(vector) > 0) & whole & F.exists(vector, lambda x: x != 0)


def _unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one in double precision, also where squares would overflow."""
    v = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) of an array column for each length that occurs."""
    lengths, offsets = np.diff(column.offsets.to_numpy()), column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    for n in np.unique(lengths):
        rows = np.flatnonzero(lengths == n)
        yield rows, flat[offsets[rows][:, None] + np.arange(n)]


def _codebook(points: np.ndarray, codes: int, rounds: int = 12) -> np.ndarray:
    """Centres of Lloyd's algorithm, begun at rows that lie evenly in the sample."""
    centres = points[np.linspace(0, len(points) - 1, codes).astype(int)].copy()
    for _ in range(rounds):
        near = (((centres * centres).sum(axis=1)) - 2 * points @ centres.T).argmin(axis=1)
        for k in np.unique(near):
            centres[k] = points[near == k].mean(axis=0)
    return np.unique(centres, axis=0)


class MultiIndex:
    """Codebooks of both halves for every length of vectors, and the limit of the traversal."""

    def __init__(self, books: dict[int, tuple[np.ndarray, np.ndarray]], limit: float):
        self.books, self.limit = books, limit

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        return self.books.get(n) or (np.zeros((1, n // 2)), np.zeros((1, n - n // 2)))

    def excess(self, unit: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """For both halves: each row's code, and the squared distance it keeps from each code's region."""
        half = unit.shape[1] // 2
        codes, away = [], []
        for points, book in zip((unit[:, :half], unit[:, half:]), self.of(unit.shape[1])):
            square = (book * book).sum(axis=1)
            far = np.maximum((points * points).sum(axis=1)[:, None] + square - 2 * points @ book.T, 0)
            apart = np.sqrt(np.maximum(square[:, None] + square - 2 * book @ book.T, 0))
            code = far.argmin(axis=1)
            plane = np.zeros_like(far)
            for k in range(len(book)):  # the farthest of the planes between the region and any other
                others = apart[k] > 0
                plane[:, others] = np.maximum(plane[:, others], (far[:, others] - far[:, k:k + 1]) / (2 * apart[k][others]))
            codes.append(code)
            away.append(plane * plane)
        return codes, away


def _visited(away: list[np.ndarray], limit: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first code, mask of second codes) of the cells nearest to each row, nearest columns first.

    Both lists of distances are sorted; a column's cells are the second list's beginning as far as the sum is
    within the limit, which is what a traversal by growing sums visits before it stops."""
    first, second = away
    by_first, by_second = first.argsort(axis=1, kind="stable"), second.argsort(axis=1, kind="stable")
    near = np.take_along_axis(second, by_second, axis=1)
    masks = np.concatenate([np.zeros((len(first), 1), np.int64), np.cumsum(np.int64(1) << by_second.astype(np.int64), axis=1)], axis=1)
    row, column, mask = [], [], []
    for j in range(first.shape[1]):
        code = by_first[:, j]
        left = limit - first[np.arange(len(first)), code]
        n = (near <= left[:, None]).sum(axis=1)
        some = np.flatnonzero(n > 0)
        if not len(some):
            break
        row.append(some)
        column.append(code[some])
        mask.append(masks[some, n[some]])
    return np.concatenate(row), np.concatenate(column), np.concatenate(mask)


def distinct_vectors(df: DataFrame, id_col: str, vector: str, label: str) -> DataFrame:
    """(node, label, v, weight, vec_id) of usable rows: equal vectors once, with their number and least id."""
    rows = df.where(usable(vector, label)).select(F.col(label).alias("label"), F.col(vector).alias("v"), F.col(id_col).alias("vec_id"))
    same = rows.groupBy("label", "v").agg(F.count("*").alias("weight"), F.min("vec_id").alias("vec_id"))
    return written(same.withColumn("node", F.monotonically_increasing_id()), "vectors")


def fit(nodes: DataFrame, threshold: float, recall: float) -> MultiIndex:
    sample = nodes.orderBy(F.xxhash64("node")).limit(SAMPLE).select("v").collect()
    by_length: dict[int, list] = {}
    for r in sample:
        by_length.setdefault(len(r["v"]), []).append(r["v"])
    rows = nodes.count()
    books = {}
    for n, vectors in by_length.items():
        unit = _unit(np.array(vectors, np.float64))
        codes = int(min(MOST_CODES, max(1, (rows / 50) ** 0.5), len(unit)))
        books[n] = (_codebook(unit[:, : n // 2], codes), _codebook(unit[:, n // 2:], codes))
    index = MultiIndex(books, 2 - 2 * threshold + 1e-9)
    if recall < 1:
        needed = _needed(nodes, index, threshold, recall, salt=1)
        if needed is not None:
            index.limit = min(index.limit, 1.5 * needed + 1e-6)
    return index


def _histograms(nodes: DataFrame, index: MultiIndex, threshold: float, salt: int) -> dict[int, np.ndarray]:
    """For each of some vectors: in how many steps of the limit its partners are first met, by brute force."""
    spark = nodes.sparkSession
    chosen = nodes.orderBy(F.xxhash64("node", F.lit(salt))).limit(QUERIES).select("node", "label", "v").collect()
    groups: dict[tuple, tuple[list, list]] = {}
    for r in chosen:
        g = groups.setdefault((r["label"], len(r["v"])), ([], []))
        g[0].append(r["node"])
        g[1].append(r["v"])
    sent = spark.sparkContext.broadcast((index, {k: (np.array(i), _unit(np.array(v, np.float64))) for k, (i, v) in groups.items()}))
    schema = pa.schema([("node", pa.int64()), ("bin", pa.int32()), ("n", pa.int64())])
    step = (2 - 2 * threshold + 1e-9) / BINS

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, queries = sent.value
        for batch in batches:
            labels, nodes_, weight = np.array(batch.column("label").to_pylist(), dtype=object), batch.column("node").to_numpy(), batch.column("weight").to_numpy()
            for rows, matrix in _matrices(batch.column("v")):
                unit = _unit(matrix)
                codes, away = index.excess(unit)
                for (label, n), (ids, q) in queries.items():
                    mine = np.flatnonzero(labels[rows] == label) if n == unit.shape[1] else []
                    if not len(mine):
                        continue
                    q_codes, q_away = index.excess(q)
                    i, j = np.nonzero((q @ unit[mine].T >= threshold) & (ids[:, None] != nodes_[rows[mine]]))
                    j = mine[j]
                    guest = q_codes[0][i] > codes[0][j]  # the one with the larger first code visits the other
                    there = q_away[0][i, codes[0][j]] + q_away[1][i, codes[1][j]]
                    here = away[0][j, q_codes[0][i]] + away[1][j, q_codes[1][i]]
                    same = (q_codes[0][i] == codes[0][j]) & (ids[i] > nodes_[rows[j]])
                    need = np.minimum((np.where(guest | same, there, here) / step).astype(np.int64), BINS - 1)
                    key, at = np.unique(i * BINS + need, return_inverse=True)
                    if len(key):
                        yield record(schema, node=ids[key // BINS], bin=(key % BINS).astype(np.int32), n=np.bincount(at, weight[rows[j]]).astype(np.int64))

    out: dict[int, np.ndarray] = {}
    for r in nodes.mapInArrow(met, "node long, bin int, n long").groupBy("node", "bin").agg(F.sum("n").alias("n")).collect():  # QUERIES * BINS rows at most
        out.setdefault(r["node"], np.zeros(BINS, np.int64))[r["bin"]] += r["n"]
    return out


def _needed(nodes: DataFrame, index: MultiIndex, threshold: float, recall: float, salt: int) -> float | None:
    """The limit at which each of the sampled vectors meets that share of its partners."""
    found = _histograms(nodes, index, threshold, salt)
    if not found:
        return None
    last = max(int(np.searchsorted(np.cumsum(h), recall * h.sum())) for h in found.values())
    return (last + 1) * (2 - 2 * threshold + 1e-9) / BINS


def measured_recall(nodes: DataFrame, index: MultiIndex, threshold: float) -> float | None:
    """Share of partners within the limit, of vectors that were not drawn for setting it."""
    found = _histograms(nodes, index, threshold, salt=2)
    inside = int(index.limit / ((2 - 2 * threshold + 1e-9) / BINS))
    total = sum(int(h.sum()) for h in found.values())
    return sum(int(h[:inside].sum() if inside < BINS else h.sum()) for h in found.values()) / total if total else None


def _posted(nodes: DataFrame, index: MultiIndex) -> DataFrame:
    """Every vector once at home, by its first code, and once as a guest in each column it visits: its own, and those of smaller codes."""
    from pyspark.sql.pandas.types import to_arrow_type

    kinds = {f.name: f.dataType for f in nodes.schema}
    own = pa.schema([("code", pa.int32()), ("length", pa.int32()), ("home", pa.bool_()), ("away", pa.bool_()), ("second", pa.int32()), ("mask", pa.int64())])
    schema = pa.schema([*own, *[pa.field(c, to_arrow_type(kinds[c])) for c in ("label", "node", "weight", "v")]])
    sql = "code int, length int, home boolean, away boolean, second int, mask long, " + ", ".join(f"{c} {kinds[c].simpleString()}" for c in ("label", "node", "weight", "v"))
    sent = nodes.sparkSession.sparkContext.broadcast(index)

    def posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, matrix in _matrices(batch.column("v")):
                codes, away = sent.value.excess(_unit(matrix))
                row, column, mask = _visited(away, sent.value.limit)
                smaller = column <= codes[0][row]
                row, column, mask = row[smaller], column[smaller], mask[smaller]
                everyone = np.arange(len(rows))
                for at, code, home, m in ((everyone, codes[0], True, np.zeros(len(rows), np.int64)), (row, column, False, mask)):
                    taken = batch.take(pa.array(rows[at]))
                    made = record(own, code=code.astype(np.int32), length=np.full(len(at), matrix.shape[1], np.int32), home=np.full(len(at), home), away=code != codes[0][at], second=codes[1][at].astype(np.int32), mask=m)
                    yield pa.RecordBatch.from_arrays([*made.columns, *[taken.column(c).cast(schema.field(c).type) for c in ("label", "node", "weight", "v")]], schema=schema)

    return nodes.mapInArrow(posted, sql)


def _joined(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Roots after the links ``a`` - ``b``, the smaller number first."""
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return root
        np.minimum.at(root, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while (root[root] != root).any():
            root = root[root]


MET = pa.schema([("node", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])


def _met(threshold: float):
    """Compares a piece of a column's own vectors with a piece of its guests."""
    def met(table: pa.Table) -> pa.Table:
        home, away = (table.column(c).to_numpy() for c in ("home", "away"))
        nodes, weight, second, mask = (table.column(c).to_numpy() for c in ("node", "weight", "second", "mask"))
        vectors = _unit(next(_matrices(table.column("v").combine_chunks()))[1])
        own, guests = np.flatnonzero(home), np.flatnonzero(~home)
        names, place = np.unique(nodes, return_inverse=True)  # a vector may be here as one of the column and as a guest
        root, links = np.arange(len(names)), np.zeros(len(names), np.int64)
        own = own[np.argsort(second[own], kind="stable")]
        begins = np.flatnonzero(np.diff(second[own], prepend=-1))
        for b, e in zip(begins, np.append(begins[1:], len(own))):
            cell = own[b:e]
            coming = guests[(mask[guests] >> int(second[cell[0]])) & 1 == 1]
            for k in range(0, len(coming), SLICE):
                g = coming[k:k + SLICE]
                near = vectors[g] @ vectors[cell].T >= threshold
                near &= away[g][:, None] | (nodes[g][:, None] > nodes[cell])  # within a column the later one visits
                some, met_ = near.any(axis=1), near.any(axis=0)
                if not some.any():
                    continue
                np.add.at(links, place[g], near @ weight[cell])
                np.add.at(links, place[cell], weight[g] @ near)
                at_g, at_cell = place[g], place[cell]
                root = _joined(root, np.concatenate([at_g[some], at_g[near.argmax(axis=0)][met_]]), np.concatenate([at_cell[near.argmax(axis=1)][some], at_cell[met_]]))
                i, j = np.nonzero(near & (root[at_g][:, None] != root[at_cell]))  # what first links did not join
                root = _joined(root, at_g[i], at_cell[j])
        some = np.flatnonzero(links > 0)
        return pa.table({"node": names[some], "links": links[some], "root": names[root[some]]}, schema=MET)

    return met


def links(nodes: DataFrame, index: MultiIndex, threshold: float) -> DataFrame:
    """(node, links, root): numbers of linked rows, and an edge to the least vector of those met together."""
    posted = written(_posted(nodes, index), "posted")
    key = ["label", "code", "length"]
    pieces = [F.ceil(F.col(n) / PIECE).cast("int").alias(n) for n in ("homes", "guests")]
    sizes = posted.groupBy(*key).agg(F.count_if("home").alias("homes"), F.count_if(~F.col("home")).alias("guests")).where("homes > 0 AND guests > 0").select(*key, *pieces)
    mine = F.pmod(F.xxhash64("node"), F.when(F.col("home"), F.col("homes")).otherwise(F.col("guests"))).cast("int")
    others = F.explode(F.sequence(F.lit(0), F.when(F.col("home"), F.col("guests")).otherwise(F.col("homes")) - 1))
    dealt = posted.join(sizes, key).withColumn("mine", mine).withColumn("other", others)
    ours, theirs = (F.when(F.col("home") == side, F.col("mine")).otherwise(F.col("other")) for side in (True, False))
    return dealt.withColumn("h", ours).withColumn("g", theirs).groupBy(*key, "h", "g").applyInArrow(_met(threshold), "node long, links long, root long")


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = 0.93, recall: float = 1.0) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``df``."""
    nodes = distinct_vectors(df, id_col, vector, label)
    met = written(links(nodes, fit(nodes, threshold, recall), threshold), "links")
    component = connected_components(nodes.select("node"), met.select(F.col("node").alias("src"), F.col("root").alias("dst")).distinct())
    whole = nodes.drop("v").join(met.groupBy("node").agg(F.sum("links").alias("links")), "node", "left").join(component, "node")
    least = whole.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    named = whole.join(least, "component").select("node", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id")
    facts = nodes.select("node", "label", "v").join(named, "node").drop("node")
    ok = usable(vector, label)
    rows = df.select(F.col(id_col).alias("vec_id"), F.col(label).alias("label"), F.col(vector).alias("v"), ok.alias("ok"))
    linked = rows.where("ok").join(facts, ["label", "v"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("NOT coalesce(ok, false)").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
