"""Near-duplicate texts: weighted dart signatures, banded joining and exact checks.

A text is a weighted set of shingles of five words. Darts are thrown, by hash alone, onto the plane
of each shingle (weight across, rank upwards), one on average in every cell of area one, and each
dart belongs to one of k coordinates. A text owns the darts below its shingles' weights; the earliest
of each coordinate is its signature there. Two texts agree in a coordinate with the probability of
their weighted Jaccard similarity. Only darts up to a rank of about k ln k over the total weight are
thrown, more where a coordinate is still open, so the cost is near max(shingles, k ln k).

Signatures are cut into bands; texts that share a band meet in a bucket. They are not paired with each
other: each is compared with the bucket's hub, its most central text, the one that shares most buckets
with most texts. In a group of edited copies that is the text they come from, which is nearer to each of
them than they are to each other. Texts in another class than their hub go on to the most central text
among themselves, ``PASSES`` times and on while a pass settles a tenth of its rows. What is then in
different classes of one bucket is compared exactly, by rare shingles (``_alike_across``), so no link is left
out for being in a late cluster or for leading to a text that a hub has settled. The similarity of a pair is
taken from the full shingle sets; classes are the connected components of the links.

Equal texts are one text with a count from the start. What is exchanged is hashes, ids and the sets
of texts that met another.

Defined cases: null texts count as empty; all empty texts, like other equal texts, are one class;
a text of one to four words is one shingle; white space and the case of A-Z do not matter to
shingles; a class has the least id of its documents, null if it has none; repeated rows are in one
class; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from .common import having_ids, record, written
from .repeats import PrefixHash, U, _buffers, mixed

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 22, 6
PASSES = 3
MOST_TEXTS = 4_096
_CDF = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(20)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs without white space."""
    gap = _SPACE[data]
    edge = np.diff(np.concatenate([[True], gap, [True]]).astype(np.int8))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def shingle_hashes(data: np.ndarray, ends: np.ndarray, words: int = WORDS) -> list[np.ndarray]:
    """Hashes of all shingles, repeats included, of each text laid end to end in ``data``."""
    # a text ends where the next begins: a space between them keeps their words apart
    count = len(ends)
    begin = ends - np.diff(ends, prepend=0)
    spaced = np.full(len(data) + count, 32, np.uint8)
    spaced[np.arange(len(data)) + np.repeat(np.arange(count), ends - begin)] = _LOWER[data]
    a, b = word_spans(spaced)
    hashes = PrefixHash(spaced)
    word = mixed(hashes.of(a, b)) if len(a) else np.empty(0, U)
    first = np.searchsorted(a, begin + np.arange(count))
    n_words = np.append(first[1:], len(a)) - first
    chain = word.copy()
    for i in range(1, words):
        chain[:max(len(word) - i, 0)] = mixed(chain[:max(len(word) - i, 0)] * U(0x94D049BB133111EB) + word[i:])
    out = []
    for f, n in zip(first.tolist(), n_words.tolist(), strict=True):
        if n >= words:
            out.append(chain[f:f + n - words + 1])
        elif n:
            h = word[f]
            with np.errstate(over="ignore"):
                for i in range(1, n):
                    h = mixed(h * U(0x94D049BB133111EB) + word[f + i])
            out.append(np.array([h], U))
        else:
            out.append(np.empty(0, U))
    return out


def weighted(shingles: np.ndarray, by_count: bool) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles in order and their weights: their counts, or one each."""
    items, n = np.unique(shingles, return_counts=True)
    return items, (n if by_count else np.ones(len(items))).astype(float)


def _darts(items: np.ndarray, weights: np.ndarray, low: float, high: float, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(coordinate, rank, name) of the darts of one text with low <= rank < high.

    The weight axis is cut at the powers of two; a strip of width w has cells of height 1 / w.
    """
    coordinate, rank, name = [], [], []
    for strip in range(max(1, int(math.ceil(math.log2(max(weights.max(), 1)))) + 1)):
        floor, width = (0.0, 1.0) if strip == 0 else (2.0 ** (strip - 1), 2.0 ** (strip - 1))
        own = np.flatnonzero(weights > floor)
        if not len(own):
            break
        first, last = int(math.floor(low * width)), int(math.ceil(high * width))
        cells = np.arange(first, last, dtype=np.uint64)
        cell = mixed(mixed(items[own] + U(strip * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF))[:, None] + cells[None, :] * U(0x9E3779B97F4A7C15))
        n = np.searchsorted(_CDF, (cell >> U(11)).astype(float) * 2.0 ** -53, side="right").ravel()
        at = np.repeat(np.arange(n.size), n)
        if not len(at):
            continue
        nth = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
        dart = mixed(mixed(cell.ravel()[at] ^ (nth.astype(U) + U(1)) * U(0xA0761D6478BD642F)))
        where = mixed(dart + U(0xE7037ED1A0B428DB))
        x = floor + (where >> U(40)).astype(float) * (width * 2.0 ** -24)
        r = (cells[at % len(cells)].astype(float) + (where & U((1 << 32) - 1)).astype(float) * 2.0 ** -32) / width
        keep = (x < weights[own][at // len(cells)]) & (r >= low) & (r < high)
        coordinate.append(((dart[keep] >> U(32)) * U(k) >> U(32)).astype(np.int64))
        rank.append(r[keep])
        name.append(dart[keep])
    if not rank:
        return np.empty(0, np.int64), np.empty(0), np.empty(0, U)
    return np.concatenate(coordinate), np.concatenate(rank), np.concatenate(name)


def signature(items: np.ndarray, weights: np.ndarray, k: int) -> np.ndarray:
    """Name of the earliest dart in each of k coordinates."""
    out = np.zeros(k, U)
    missing = np.ones(k, bool)
    low, high = 0.0, k * (math.log(k) + 2) / float(weights.sum())
    while missing.any():
        c, r, name = _darts(items, weights, low, high, k)
        late_first = np.argsort(-r, kind="stable")
        c, name = c[late_first], name[late_first]
        fresh = missing[c]
        out[c[fresh]] = name[fresh]  # of several the last written, the earliest, stays
        missing[c] = False
        low, high = high, 2 * high
    return out


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    grid = sig.reshape(bands, rows)
    key = np.zeros(bands, U)
    for r in range(rows):
        key = mixed(key * U(0x94D049BB133111EB) + grid[:, r])
    return key.view(np.int64)


def distinct_texts(docs: DataFrame) -> DataFrame:
    """(id, key, n, row, text): one row for equal texts; ``row`` has the other columns of the first."""
    others = [c for c in docs.columns if c not in ("text", "doc_id")]
    row = F.struct("doc_id", *others)
    keyed = docs.select(row.alias("row"), F.coalesce("text", F.lit("")).alias("text")).withColumn("key", F.sha2("text", 256))
    first = F.min(F.struct(F.col("row.doc_id").isNull().alias("none"), "row")).alias("first")
    once = keyed.groupBy("key").agg(F.count("*").alias("n"), first, F.any_value("text").alias("text"))
    return written(once.select("key", "n", "first.row", "text").withColumn("id", F.monotonically_increasing_id()), "texts")


def banded(texts: DataFrame, by_count: bool, bands: int, rows: int) -> DataFrame:
    """(id, band, bucket) of every text with a shingle."""
    schema = pa.schema([("id", pa.int64()), ("keys", pa.list_(pa.int64()))])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id").to_pylist()
            for row, data, ends in _buffers(batch):
                names, keys = [], []
                for i, shingles in enumerate(shingle_hashes(data, ends)):
                    if len(shingles):
                        names.append(ids[row + i])
                        keys.append(band_keys(signature(*weighted(shingles, by_count), bands * rows), bands, rows))
                yield record(schema, id=names, keys=keys)

    signed = texts.select("id", "text").mapInArrow(sign, "id long, keys array<long>")
    return signed.select("id", F.posexplode("keys").alias("band", "bucket"))


def shingle_sets(texts: DataFrame, by_count: bool) -> DataFrame:
    """(id, shingles, weights, total) with shingles in ascending order."""
    schema = pa.schema([("id", pa.int64()), ("shingles", pa.list_(pa.int64())), ("weights", pa.list_(pa.int32()))])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id").to_pylist()
            for row, data, ends in _buffers(batch, 1_000_000):
                sets = [weighted(s, by_count) for s in shingle_hashes(data, ends)]
                yield record(schema, id=ids[row:row + len(sets)], shingles=[s.view(np.int64) for s, _ in sets], weights=[w.astype(np.int32) if by_count else None for _, w in sets])

    return texts.select("id", "text").mapInArrow(cut, "id long, shingles array<long>, weights array<int>")


def similarity(by_count: bool):
    """Weighted Jaccard similarity of columns a, b of ``shingle_sets`` rows."""
    common = F.array_intersect("a.shingles", "b.shingles")
    if not by_count:
        n = F.size(common)
        return n / (F.size("a.shingles") + F.size("b.shingles") - n)
    table = lambda s: F.map_from_arrays(f"{s}.shingles", f"{s}.weights")
    least = F.aggregate(common, F.lit(0).cast("long"), lambda t, x: t + F.least(F.element_at(table("a"), x), F.element_at(table("b"), x)))
    total = lambda s: F.aggregate(f"{s}.weights", F.lit(0).cast("long"), lambda t, w: t + w)
    return least / (total("a") + total("b") - least)


def _compared(meeting: DataFrame, sets: DataFrame, by_count: bool) -> DataFrame:
    """(id, hub, similarity) of the distinct pairs in (id, hub) rows."""
    pairs = meeting.where("id <> hub").select("id", "hub").distinct()
    a = sets.select(F.col("id").alias("a_id"), F.struct("shingles", "weights").alias("a"))
    b = sets.select(F.col("id").alias("b_id"), F.struct("shingles", "weights").alias("b"))
    met = pairs.join(a, F.col("id") == F.col("a_id")).join(b, F.col("hub") == F.col("b_id"))
    return written(met.select("id", "hub", similarity(by_count).alias("similarity")), "compared")


def _with_hubs(members: DataFrame) -> DataFrame:
    """Each (id, band, bucket, centrality) with the most central text of its bucket."""
    hubs = members.groupBy("band", "bucket").agg(F.max(F.struct("centrality", "id")).alias("m"), F.count("*").alias("n")).where("n > 1").select(
        F.col("band").alias("b"), F.col("bucket").alias("k"), F.col("m.id").alias("hub"))
    return written(members.join(hubs, (F.col("band") == F.col("b")) & (F.col("bucket") == F.col("k"))).select("id", "band", "bucket", "centrality", "hub"), "meeting")


def _classes(nodes: DataFrame, alike: DataFrame) -> DataFrame:
    return connected_components(nodes, alike.select(F.col("id").alias("src"), F.col("hub").alias("dst")), node="id", name="class")


def _unmet(met: DataFrame, sets: DataFrame, found: DataFrame, least: float, by_count: bool) -> DataFrame:
    """(id, hub, similarity) of all alike pairs of texts that share a bucket and are in different classes so far.

    Texts that a hub has settled stay partners for the others of their buckets. Of two classes in a bucket
    one is not its largest: the texts of that one are open, and are compared with all of mixed buckets.

    Shingles are ordered by how many texts have them. Two texts can only be alike if the first shingle they
    share leaves enough weight from there on in both; only pairs with such a shingle are compared."""
    class_of = _classes(met.select("id").distinct(), found)
    placed = written(met.select("id", "band", "bucket").join(class_of, "id"), "placed")
    mixed_ones = placed.groupBy("band", "bucket", "class").agg(F.count("*").alias("n")).groupBy("band", "bucket").agg(F.max(F.struct("n", "class")).alias("m"), F.count("*").alias("k")).where("k > 1").select(
        F.col("band").alias("b"), F.col("bucket").alias("k"), F.col("m.class").alias("largest"))
    held = placed.join(mixed_ones, (F.col("band") == F.col("b")) & (F.col("bucket") == F.col("k")))
    texts = written(held.groupBy("id", "class").agg(F.max(F.col("class") != F.col("largest")).alias("open")), "mixed")
    return _alike_across(texts, sets, least, by_count)


def _alike_across(texts: DataFrame, sets: DataFrame, least: float, by_count: bool) -> DataFrame:
    """(id, hub, similarity) of all alike pairs of (id, class, open) texts in different classes, one of them open."""
    each = sets.join(texts.withColumnRenamed("id", "t_id"), F.col("id") == F.col("t_id"))
    if by_count:
        total = F.aggregate("weights", F.lit(0).cast("long"), lambda t, w: t + w)
        each = each.select("id", "class", "open", total.alias("total"), F.explode(F.arrays_zip("shingles", "weights")).alias("z")).select("id", "class", "open", "total", F.col("z.shingles").alias("shingle"), F.col("z.weights").cast("long").alias("w"))
    else:
        each = each.select("id", "class", "open", F.size("shingles").cast("long").alias("total"), F.explode("shingles").alias("shingle"), F.lit(1).cast("long").alias("w"))
    # a shingle of one class, or of no open text, is in no pair that is looked for: it comes first in the order and is left out
    known = each.groupBy("shingle").agg(F.count("*").alias("n"), F.min("class").alias("c"), F.max("class").alias("d"), F.max("open").alias("o")).where("c <> d and o").select(F.col("shingle").alias("s"), "n")
    kept = each.join(known, F.col("shingle") == F.col("s"))
    rest = F.sum("w").over(Window.partitionBy("id").orderBy(F.desc("n"), F.desc("shingle")))
    # a shingle of many texts is dealt out in squares of texts, not brought into one task
    cut = (F.col("n") / MOST_TEXTS).cast("int") + 1
    own = F.pmod(F.xxhash64("id"), F.col("cut")).cast("int")
    first = written(kept.withColumn("rest", rest).where(F.col("rest") >= least * F.col("total") - 1e-6).withColumn("cut", cut).select(
        "id", "class", "open", "total", "shingle", "rest", "cut", own.alias("own")), "first-shingles")
    others = F.explode(F.sequence(F.lit(0), F.col("cut") - 1)).alias("other")
    a = first.where("open").select(F.col("id").alias("a_id"), F.col("class").alias("a_class"), F.col("total").alias("a_total"), F.col("rest").alias("a_rest"), F.col("shingle").alias("a_s"), F.col("own").alias("a_x"), others)
    b = first.select(F.col("id").alias("b_id"), F.col("class").alias("b_class"), F.col("open").alias("b_open"), F.col("total").alias("b_total"), F.col("rest").alias("b_rest"), F.col("shingle").alias("b_s"), F.col("own").alias("b_y"), others.alias("b_other"))
    enough = F.least("a_rest", "b_rest") >= least / (1 + least) * (F.col("a_total") + F.col("b_total")) - 1e-6
    once = ~F.col("b_open") | (F.col("a_id") < F.col("b_id"))
    pairs = a.join(b, (F.col("a_s") == F.col("b_s")) & (F.col("a_x") == F.col("b_other")) & (F.col("other") == F.col("b_y")) & (F.col("a_class") != F.col("b_class")) & once & enough)
    return _compared(pairs.select(F.col("a_id").alias("id"), F.col("b_id").alias("hub")), sets, by_count).where(F.col("similarity") >= least)


def links(texts: DataFrame, least: float = SIMILARITY, by_count: bool = False, bands: int = BANDS, rows: int = ROWS, passes: int = PASSES) -> DataFrame:
    """(id, hub, similarity) of distinct texts found alike."""
    rows_of = written(banded(texts, by_count, bands, rows), "bands")
    shared = rows_of.groupBy("band", "bucket").agg(F.count("*").alias("n")).where("n > 1").select(F.col("band").alias("b"), F.col("bucket").alias("k"), "n")
    met = written(rows_of.join(shared, (F.col("band") == F.col("b")) & (F.col("bucket") == F.col("k"))).select("id", "band", "bucket", "n"), "members")
    # the text that edited copies come from shares more buckets with more of them than they do
    central = met.groupBy("id").agg(F.sum("n").alias("centrality")).withColumnRenamed("id", "c_id")
    members = met.join(central, F.col("id") == F.col("c_id")).select("id", "band", "bucket", "centrality")
    sets = written(shingle_sets(having_ids(texts.select("id", "text"), central.select(F.col("c_id").alias("id"))), by_count), "sets")
    found, step, rows_open = None, 0, 0
    while True:
        meeting = _with_hubs(members)
        alike = _compared(meeting, sets, by_count).where(F.col("similarity") >= least)
        found = alike if found is None else found.unionByName(alike)
        if step == 0:  # texts that are in the hub's class by any way need no other hub
            class_of = _classes(meeting.select("id").distinct(), alike)
            mine = class_of.select(F.col("id").alias("x_id"), F.col("class").alias("own"))
            theirs = class_of.select(F.col("id").alias("y_id"), F.col("class").alias("other"))
            members = meeting.join(mine, F.col("id") == F.col("x_id")).join(theirs, F.col("hub") == F.col("y_id")).where("own <> other").select("id", "band", "bucket", "centrality")
        else:
            done = alike.select(F.col("id").alias("x_id"), F.col("hub").alias("y_id"))
            members = meeting.where("id <> hub").join(done, (F.col("id") == F.col("x_id")) & (F.col("hub") == F.col("y_id")), "left_anti").select("id", "band", "bucket", "centrality")
        members = written(members, "open")
        step, before, rows_open = step + 1, rows_open, members.count()
        # more hubs only where they settle much: what is open after them is compared exactly
        if not rows_open or step >= passes and rows_open > 0.9 * before:
            break
    return found.unionByName(_unmet(met, sets, found, least, by_count)) if rows_open or step > 1 else found


def text_classes(texts: DataFrame, **how) -> DataFrame:
    """(id, component): the class of each distinct text, named by the least text id in it."""
    edges = links(texts, **how).select(F.col("id").alias("src"), F.col("hub").alias("dst"))
    return connected_components(texts.select("id"), edges, node="id", name="component")


def near_classes(docs: DataFrame, **how) -> DataFrame:
    """doc_id, class_id (least id of the class) and class_size of each document."""
    narrow = docs.select("doc_id", "text")
    texts = distinct_texts(narrow)
    placed = written(texts.select("id", "key", "n", F.col("row.doc_id").alias("first")).join(text_classes(texts, **how).withColumnRenamed("id", "c_id"), F.col("id") == F.col("c_id")).select("key", "n", "first", "component"), "classes")
    classes = placed.groupBy("component").agg(F.min("first").alias("class_id"), F.sum("n").alias("class_size"))
    named = placed.select(F.col("key").alias("t_key"), F.col("component").alias("c")).join(classes, F.col("c") == F.col("component")).select("t_key", "class_id", "class_size")
    keyed = narrow.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("key"))
    return keyed.join(named, F.col("key") == F.col("t_key")).select("doc_id", "class_id", "class_size")


def one_of_each(docs: DataFrame, **how) -> DataFrame:
    """The columns of ``docs``: of every class the text with the least document id, once."""
    texts = distinct_texts(docs)
    classes = text_classes(texts, **how).withColumnRenamed("id", "c_id")
    order = F.struct(F.col("row.doc_id").isNull().alias("none"), F.col("row.doc_id").alias("doc_id"), "id")
    kept = texts.select("id", "row").join(classes, F.col("id") == F.col("c_id")).groupBy("component").agg(F.min(order).alias("best")).select("best.id")
    return having_ids(texts, kept).select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])
