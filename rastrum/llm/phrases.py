"""Collocations of two to four words, counted by multikey three-way quicksort of suffix pointers.

Texts are lower-cased in A-Z, cut into pieces at punctuation and line ends and into words at spaces and tabs.
Every word position is a suffix pointer, at most ``LONGEST`` words deep within its piece. Words are
counted first. A second pass counts buckets of word pairs; a pointer goes as deep as its words are
frequent and its pairs lie in frequent buckets, so a phrase that can reach the least count keeps all
its pointers. Pointers are routed over all executors by their two leading words, or by three where the
pair is hot, after equal ones of a chunk of text were merged. A task then sorts its pointers by multikey
quicksort: the rows equal to the pivot at a depth are one phrase, their weight is its count, and parts
of less weight than the least count are abandoned.

Words travel as 64-bit hashes; the words' table shows whether a frequent word shares its hash with another, and the
hashes are then drawn anew, so counts are exact. What is sent to the tasks are bitmaps of
``2 ** BITS`` bits, whatever the corpus; on a corpus that fills them they prune less and nothing else changes.

Defined cases: null texts are empty, null languages ``und``; empty texts have no words; repeated rows count
each; very long texts are cut at piece ends as they are read; ties go by the phrase's bytes; empty tables
give no row; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..core import any_row
from .common import partitions, record, written

LONGEST = 4
BITS = 27
CHUNK_BYTES = 4 << 20
BUFFER_ROWS = 250_000
HELD_WORDS = 200_000
HOT_PAIR = 1_000_000
SALTS = 256
#: Spark's xxhash64 begins with this seed
SPARK_SEED = 42
ENDS = b".,;:!?\x0a\x0b\x0c\x0d"
PLAIN = bytes.maketrans(bytes(range(65, 91)) + b"\t" + ENDS, bytes(range(97, 123)) + b" " + b"." * len(ENDS))
WORDS = [f"w{i}" for i in range(1, LONGEST + 1)]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    """(language, plain text of whole pieces) of about ``CHUNK_BYTES``, pieces ended by points."""
    waiting: dict[str, list[bytes]] = {}
    held = 0
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            plain = (text.as_py() or "").encode().translate(PLAIN)
            while len(plain) > CHUNK_BYTES:
                cut = plain.rfind(b".", 0, CHUNK_BYTES) + 1 or plain.find(b".") + 1 or len(plain)
                yield lang, plain[:cut]
                plain = plain[cut:]
            waiting.setdefault(lang, []).append(plain)
            held += len(plain)
            if held >= CHUNK_BYTES:
                yield from ((k, b".".join(v)) for k, v in waiting.items())
                waiting, held = {}, 0
    yield from ((k, b".".join(v)) for k, v in waiting.items())


def _tokens(plain: bytes) -> list[bytes]:
    """Words in order, and points between pieces."""
    return plain.replace(b".", b" . ").split()


def count_words(docs: DataFrame) -> DataFrame:
    """(lang, word, n) of (lang, text) rows."""
    schema = pa.schema([("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for lang, words in held.items():
                yield record(schema, lang=[lang] * len(words), word=[w.decode() for w in words], n=list(words.values()))
            held.clear()

        for lang, plain in _chunks(batches):
            words = Counter(_tokens(plain))
            words.pop(b".", None)
            held.setdefault(lang, Counter()).update(words)
            if sum(map(len, held.values())) > HELD_WORDS:
                yield from out()
        yield from out()

    return docs.mapInArrow(counted, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _hashed(lang: Column, word: Column, draw: int) -> Column:
    h = F.xxhash64(F.concat(F.lit(f"{draw}\0"), lang, F.lit("\0"), word))
    return F.when(h == 0, 1).otherwise(h)


def _bitmap(spark: SparkSession, buckets: DataFrame) -> np.ndarray:
    """Bits of the rows' ``bucket``; at most 2 ** BITS / 8 bytes come to the driver."""
    place = F.col("bucket") + 1
    rows = buckets.groupBy(F.bitmap_bucket_number(place).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")).collect()
    bits = np.zeros(max(1, (1 << BITS) >> 3), np.uint8)
    for r in rows:
        part = np.frombuffer(r["bits"], np.uint8)
        at = (r["part"] - 1) * 4096
        bits[at:at + 4096] = part[: len(bits) - at]
    return bits


def _has(bits: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    return (bits[bucket >> 3] >> (bucket & 7).astype(np.uint8)) & 1 == 1


def _pair_bucket(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    mixed = (a.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (b.view(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (mixed >> np.uint64(64 - BITS)).astype(np.int64)


def _word_hashes(lang: str, plain: bytes, draw: int, frequent: np.ndarray) -> np.ndarray:
    """Hash of every frequent word in order, 0 for ends of pieces and other words."""
    local: dict[bytes, int] = {b".": 0}
    ids = np.fromiter((local.setdefault(w, len(local)) for w in _tokens(plain)), np.int64)
    start = f"{draw}\0{lang}\0".encode()
    hashes = np.array([0] + [xxhash.xxh64_intdigest(start + w, SPARK_SEED) or 1 for w in list(local)[1:]], np.uint64).view(np.int64)
    known = _has(frequent, (hashes.view(np.uint64) >> np.uint64(64 - BITS)).astype(np.int64))
    known[0] = False
    return np.where(known, hashes, 0)[ids]


def _merged(columns: list[np.ndarray], weight: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Equal rows become one with the sum of their weights."""
    order = np.lexsort(columns[::-1])
    columns = [c[order] for c in columns]
    new = np.zeros(len(order), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    begins = np.flatnonzero(new)
    return [c[begins] for c in columns], np.add.reduceat(weight[order], begins) if len(begins) else weight


def sorted_counts(columns: list[np.ndarray], weight: np.ndarray, least: int, partial: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(phrases of 2 words and more, counts): multikey three-way quicksort, infrequent parts abandoned.

    ``columns`` hold the words of each pointer by depth, 0 below its depth. Pointers marked ``partial``
    may lie in other tasks as well as far as their first two words go, so their pairs are always counted."""
    found: list[tuple[int, ...]] = []
    counts: list[int] = []
    parts = [(np.arange(len(weight)), 0, int(weight.sum()))] if len(weight) else []
    while parts:
        pointers, depth, total = parts.pop()
        keys, w = columns[depth][pointers], weight[pointers]
        pivot = keys[len(keys) // 2]
        equal = keys == pivot
        same = int(w[equal].sum())
        if total > same:
            below = keys < pivot
            low = int(w[below].sum())
            for part, size in ((below, low), (~(below | equal), total - same - low)):
                if size >= least or (size and depth < 2 and partial[pointers[part]].any()):
                    parts.append((pointers[part], depth, size))
        if pivot == 0:
            continue
        inside = pointers[equal]
        some = depth < 2 and bool(partial[inside].any())
        if same < least and not some:
            continue
        if depth:
            found.append(tuple(columns[d][inside[0]] if d <= depth else 0 for d in range(LONGEST)))
            counts.append(same)
        if depth + 1 < LONGEST and (same >= least or depth == 0):
            parts.append((inside, depth + 1, same))
    return np.array(found, np.int64).reshape(-1, LONGEST), np.array(counts, np.int64)


COUNTED = "lang string, w1 long, w2 long, w3 long, w4 long, n long"
COUNTED_SCHEMA = pa.schema([("lang", pa.string()), *[(w, pa.int64()) for w in WORDS], ("n", pa.int64())])


def _sort_task(least: int) -> Callable:
    """Pointers of a task, leading words together: whole groups are sorted a buffer at a time."""
    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[str, list[np.ndarray], np.ndarray, np.ndarray] | None = None

        def out(lang: str, columns: list[np.ndarray], weight: np.ndarray, partial: np.ndarray) -> Iterator[pa.RecordBatch]:
            found, counts = sorted_counts(columns, weight, least, partial)
            if len(counts):
                yield record(COUNTED_SCHEMA, lang=[lang] * len(counts), n=counts, **{w: found[:, i] for i, w in enumerate(WORDS)})

        for batch in batches:
            langs = batch.column("lang").to_pylist()
            at = 0
            while at < len(langs):  # languages lie together
                to = at + 1 if langs[-1] != langs[at] else len(langs)
                while to < len(langs) and langs[to] == langs[at]:
                    to += 1
                columns = [batch.column(w).to_numpy()[at:to] for w in WORDS]
                weight, partial = batch.column("n").to_numpy()[at:to], batch.column("hot").to_numpy(zero_copy_only=False)[at:to]
                if held and held[0] == langs[at]:
                    columns = [np.concatenate([a, b]) for a, b in zip(held[1], columns)]
                    weight, partial = np.concatenate([held[2], weight]), np.concatenate([held[3], partial])
                elif held:
                    yield from out(*held)
                held = (langs[at], columns, weight, partial)
                at = to
                if len(weight) >= BUFFER_ROWS:
                    lead = np.stack([columns[0], columns[1], np.where(partial, columns[2], 0)])
                    last = np.flatnonzero((lead[:, 1:] != lead[:, :-1]).any(axis=0))
                    if len(last):
                        cut = last[-1] + 1
                        yield from out(held[0], [c[:cut] for c in columns], weight[:cut], partial[:cut])
                        held = (held[0], [c[cut:] for c in columns], weight[cut:], partial[cut:])
                    else:  # one group: as many rows are left as it has different phrases
                        columns, weight = _merged(columns, weight)
                        held = (held[0], columns, weight, np.full(len(weight), partial[0]))
        if held:
            yield from out(*held)

    return sort


def phrase_counts(docs: DataFrame, least: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Words (lang, word, n, h), all counts (lang, w1..w4, n) of at least ``least``, and words a language."""
    spark = docs.sparkSession
    counted, draw = written(count_words(docs), "words"), 0
    while True:
        words = counted.withColumn("h", _hashed(F.col("lang"), F.col("word"), draw))
        shared = words.groupBy("lang", "h").agg(F.count("*").alias("m"), F.sum("n").alias("n")).where((F.col("m") > 1) & (F.col("n") >= least))
        if not any_row(shared):
            break
        draw += 1
    often = words.where(F.col("n") >= least)
    frequent = spark.sparkContext.broadcast(_bitmap(spark, often.select(F.shiftrightunsigned("h", 64 - BITS).alias("bucket"))))
    bucket_schema = pa.schema([("bucket", pa.int64()), ("n", pa.int64())])

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, plain in _chunks(batches):
            h = _word_hashes(lang, plain, draw, frequent.value)
            both = (h[:-1] != 0) & (h[1:] != 0)
            bucket, n = np.unique(_pair_bucket(h[:-1][both], h[1:][both]), return_counts=True)
            yield record(bucket_schema, bucket=bucket, n=n)

    buckets = written(docs.mapInArrow(pairs, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).where(F.col("n") >= least), "pairs")
    likely = spark.sparkContext.broadcast(_bitmap(spark, buckets))
    hot = spark.sparkContext.broadcast(_bitmap(spark, buckets.where(F.col("n") >= HOT_PAIR)))
    pointer_schema = pa.schema([*[f for f in COUNTED_SCHEMA], ("hot", pa.bool_())])

    def pointers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, plain in _chunks(batches):
            h = np.concatenate([_word_hashes(lang, plain, draw, frequent.value), np.zeros(LONGEST, np.int64)])
            bucket = _pair_bucket(h[:-1], h[1:])
            pair = (h[:-1] != 0) & (h[1:] != 0) & _has(likely.value, bucket)
            at = np.flatnonzero(pair)
            columns, deep = [h[at], h[at + 1]], pair[at]
            for d in range(2, LONGEST):
                deep = deep & pair[at + d - 1]
                columns.append(np.where(deep, h[at + d], 0))
            columns, n = _merged(columns, np.ones(len(at), np.int64))
            is_hot = _has(hot.value, _pair_bucket(columns[0], columns[1])) if len(n) else np.zeros(0, bool)
            yield record(pointer_schema, lang=[lang] * len(n), n=n, hot=is_hot, **dict(zip(WORDS, columns)))

    third = F.when(F.col("hot"), F.col("w3")).otherwise(0)
    routed = docs.mapInArrow(pointers, COUNTED + ", hot boolean").repartition(partitions(spark), "lang", "w1", "w2", third).sortWithinPartitions("lang", "w1", "w2", third)
    longer = routed.mapInArrow(_sort_task(least), COUNTED).groupBy("lang", *WORDS).agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    single = often.select("lang", F.col("h").alias("w1"), *[F.lit(0).cast("long").alias(w) for w in WORDS[1:]], "n")
    return words, written(longer.unionByName(single), "counts"), counted.groupBy("lang").agg(F.sum("n").alias("n"))


def _part(first: int, size: int) -> list[Column]:
    """The words ``first`` to ``first + size`` of a row as a phrase."""
    return [F.col(WORDS[first + i]) if i < size else F.lit(0).cast("long") for i in range(LONGEST)]


def _parts_of(spans: list[tuple[int, int]], names: list[str]) -> Column:
    return F.array(*[F.struct(F.lit(first).alias("first"), *[c.alias(n) for c, n in zip(_part(first, size), names)]) for first, size in spans])


def collocations(docs: DataFrame, most: int, least: int = 30, share: int = 80, scale: int = 2_000_000, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``most`` best phrases.

    A phrase's cut with the least ``scale * a / (l + r)`` counts. Phrases inside a longer one with ``share``
    percent of their count are dropped."""
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    words, counts, totals = phrase_counts(rows, least)
    key = ["lang", *WORDS]
    phrases = counts.where("w2 <> 0").withColumnRenamed("n", "a")
    size = F.when(F.col("w3") == 0, 2).when(F.col("w4") == 0, 3).otherwise(4)
    left, right = [f"l_{w}" for w in WORDS], [f"r_{w}" for w in WORDS]

    def cuts(m: int) -> Column:
        return F.array(*[F.struct(F.lit(k).alias("k"), *[c.alias(x) for c, x in zip(_part(0, k), left)], *[c.alias(x) for c, x in zip(_part(k, m - k), right)]) for k in range(1, m)])

    cut = phrases.select(*key, "a", F.explode(F.when(size == 2, cuts(2)).when(size == 3, cuts(3)).otherwise(cuts(4))).alias("c")).select(*key, "a", "c.*")
    for side, names in (("l", left), ("r", right)):
        found = counts.select(F.col("lang").alias("c_lang"), *[F.col(w).alias(f"c_{w}") for w in WORDS], F.col("n").alias(side))
        on = F.col("lang") == F.col("c_lang")
        for w, x in zip(WORDS, names):
            on = on & (F.col(x) == F.col(f"c_{w}"))
        cut = cut.join(found, on).drop("c_lang", *[f"c_{w}" for w in WORDS], *names)
    score = F.expr(f"(CAST(a AS DECIMAL(20, 0)) * {scale}) DIV (CAST(l AS DECIMAL(20, 0)) + CAST(r AS DECIMAL(20, 0)))")
    scored = cut.groupBy(*key, "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("best")).select(*key, "a", "best.score", "best.l", "best.r")

    def spans(m: int) -> list[tuple[int, int]]:
        return [(first, k) for k in range(2, m) for first in range(m - k + 1)]

    inner = phrases.where("w3 <> 0").select("lang", "a", F.explode(F.when(F.col("w4") == 0, _parts_of(spans(3), WORDS)).otherwise(_parts_of(spans(4), WORDS))).alias("c"))
    covering = inner.select("lang", *[F.col(f"c.{w}").alias(w) for w in WORDS], "a").groupBy(*key).agg(F.max("a").alias("longer"))
    wide = "DECIMAL(38, 0)"
    kept = scored.join(covering, key, "left").where(f"longer IS NULL OR CAST(longer AS {wide}) * 100 < CAST(a AS {wide}) * {share}").drop("longer")
    place = F.array(*[F.struct(F.lit(i).alias("i"), F.col(w).alias("h")) for i, w in enumerate(WORDS)])
    spelled = kept.select("*", F.explode(F.filter(place, lambda p: p["h"] != 0)).alias("p")).select(*key, "a", "score", "l", "r", "p.i", "p.h").join(words.where(F.col("n") >= least).select("lang", "h", "word"), ["lang", "h"])
    named = spelled.groupBy(*key, "a", "score", "l", "r").agg(F.array_sort(F.collect_list(F.struct("i", "word"))).alias("said")).select("lang", F.array_join(F.transform("said", lambda s: s["word"]), " ").alias("phrase"), "a", "l", "r", "score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    few = named.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= most)
    best = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= most)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
