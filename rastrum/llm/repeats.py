"""Repeated byte strings by a sparse, hash-compared suffix sort.

A byte goes when a string of ``length`` bytes that covers it starts anywhere else too. Sorting the
suffixes of all texts would move every byte many times over; equal strings can be found from
far fewer suffixes:

1. Each window of ``length`` bytes picks an anchor in it: its leftmost smallest hash of ``GRAM``
   bytes. Equal windows pick the same anchor at the same place, about one byte in 140 is an anchor.
2. An anchor's context is all that its windows can hold. Anchors with equal grams and equal contexts
   form one class; a class of two makes all its windows repeat and needs no text.
3. Only grams that occur in several contexts are sorted: one context per class is fetched, and the
   suffixes that start at its anchor are merge-sorted. Two suffixes are compared by the longest
   common extension, found by binary search over prefix polynomial hashes. The order of the suffixes
   that start d bytes earlier follows from that of d - 1 by one stable pass over the byte before, as
   in induced sorting. Neighbours whose windows have equal hashes repeat; the outermost ones,
   which decide what goes, are compared byte by byte.

Equal texts are one text with a count, so a group of copies is worked on once. Grams meet in the
task of their hash; a gram with more than ``MOST_CONTEXTS`` different contexts is not brought into one
task but has its windows counted by their digests in a grouped aggregation, which gives the same answer.
Contexts and counted windows are told apart by cryptographic digests of 128 bits, as equal texts are by
theirs of 256; what prefix hashes find in the sort is checked byte by byte.

Defined cases: a null text counts as empty; texts shorter than ``length`` keep all; windows may
overlap themselves within one text; repeated rows are copies of each other; a null id is an id like
any other; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, record, written

GRAM = 128
PRIMES = (2147483629, 2147483587)
BASES = (1000003, 1299721)
MOST_CONTEXTS = 6_000
#: contexts are sorted as soon as so many bytes of them wait
SORT_BYTES = 2_000_000
#: rows of contexts that come to a worker at a time
BATCH_ROWS = 500
#: bytes of texts, and their places or spans, that are turned into Python objects at a time
OBJECT_BYTES, OBJECTS = 2_000_000, 5_000
U = np.uint64


class PrefixHash:
    """Polynomial hashes of every prefix of a buffer, modulo two primes; any part of the buffer gets
    its hash from two prefixes, divided by the power of its start, so equal parts of different
    buffers have equal hashes."""

    powers: dict[tuple[int, int], np.ndarray] = {}

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.sums, self.shift = [], []
        for p, b in zip(PRIMES, BASES, strict=True):
            power = self._powers(p, b, n + 1)
            s = np.zeros(n + 1, U)
            np.cumsum((data.astype(U) + U(1)) * power[:n] % U(p), out=s[1:])
            self.sums.append(s)
            self.shift.append(self._powers(p, pow(b, -1, p), n + 1))

    @classmethod
    def _powers(cls, p: int, b: int, n: int) -> np.ndarray:
        have = cls.powers.get((p, b))
        if have is None or len(have) < n:
            size = max(n, 1 << 20)
            have = np.ones(size, U)
            done = 1
            while done < size:
                step = min(done, size - done)
                have[done:done + step] = have[:step] * U(pow(b, done, p)) % U(p)
                done += step
            cls.powers[p, b] = have
        return have

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """One 62-bit number for each part start..end."""
        a, b = (((s[end] - s[start]) % U(p)) * w[start] % U(p) for s, w, p in zip(self.sums, self.shift, PRIMES, strict=True))
        return (a << U(31)) | b


def mixed(x: np.ndarray) -> np.ndarray:
    x = x * U(0xBF58476D1CE4E5B9)
    return x ^ (x >> U(31))


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes from every position, doubled from single bytes."""
    h, width = data.astype(U) + U(1), 1
    while width < GRAM:
        h = mixed(h[:-width] * U(0x94D049BB133111EB) + h[width:])
        width *= 2
    return h


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of every ``width`` values in a row, from running minima in blocks of that size."""
    n = len(values)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, U)
    padded[:n] = values
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n - width + 1], ahead[width - 1:n])


def anchors(data: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Anchors of the windows of several texts laid end to end (``ends``): text number, position in the
    buffer, gram hash, least and greatest distance d from the start of one of its windows."""
    empty = np.empty(0, np.int64)
    if len(data) < length:
        return empty, empty, empty.astype(U), empty, empty
    grams = gram_hashes(data)
    bits = U(max(1, int(len(data)).bit_length()))
    packed = (grams >> bits << bits) | np.arange(len(grams), dtype=U)  # equal hashes: the leftmost
    least = sliding_least(packed, length - GRAM + 1)
    starts = np.arange(len(least))
    number = np.searchsorted(ends, starts, side="right")
    inside = starts + length <= ends[np.minimum(number, len(ends) - 1)]
    starts, least, number = starts[inside], least[inside], number[inside]
    if not len(starts):
        return empty, empty, empty.astype(U), empty, empty
    first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    last = np.concatenate([first[1:], [len(starts)]]) - 1
    at = (least[first] & ((U(1) << bits) - U(1))).astype(np.int64)
    return number[first], at, grams[at], at - starts[last], at - starts[first]


def _buffers(batch: pa.RecordBatch, most: int = 1_000_000) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, ends) of runs of rows of about ``most`` bytes."""
    column = batch.column("text").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, 8 * column.offset)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.empty(0, np.uint8)
    row = 0
    while row < len(column):
        stop = int(np.searchsorted(offsets, offsets[row] + most, side="left"))
        stop = min(max(stop, row + 1), len(column))
        yield row, data[offsets[row]:offsets[stop]], offsets[row + 1:stop + 1] - offsets[row]
        row = stop


def _small(batch: pa.RecordBatch, text: str, listed: str) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about OBJECT_BYTES of ``text`` and OBJECTS items of ``listed``, a row at least:
    a batch of Spark's holds 10,000 rows, whose lists as Python objects are many times its size."""
    bytes_, items = (np.nan_to_num(f(batch.column(c)).to_numpy(zero_copy_only=False).astype(float)).cumsum() for f, c in ((pc.binary_length, text), (pc.list_value_length, listed)))
    row = 0
    while row < len(batch):
        done = (bytes_[row - 1], items[row - 1]) if row else (0, 0)
        stop = min(int(np.searchsorted(bytes_, done[0] + OBJECT_BYTES, side="right")), int(np.searchsorted(items, done[1] + OBJECTS, side="right")))
        stop = min(max(stop, row + 1), len(batch))
        yield batch.slice(row, stop - row)
        row = stop


ANCHORS = "id long, at long, gram long, context binary, near int, far int"


def digest(data: bytes) -> bytes:
    """128 bits that stand for the bytes where no byte check follows: no two different strings with one are known."""
    return blake2b(data, digest_size=16).digest()


def anchor_rows(texts: DataFrame, length: int) -> DataFrame:
    """Anchors of (id, text) rows; ``context`` is the digest of all that its windows can hold."""
    schema = pa.schema([("id", pa.int64()), ("at", pa.int64()), ("gram", pa.int64()), ("context", pa.binary()), ("near", pa.int32()), ("far", pa.int32())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id")
            for row, data, ends in _buffers(batch, 500_000):
                number, at, gram, near, far = anchors(data, ends, length)
                if not len(at):
                    continue
                begin = ends[number] - np.diff(ends, prepend=0)[number]
                left, right = np.maximum(begin, at - (length - GRAM)), np.minimum(ends[number], at + length)
                raw = data.tobytes()
                context = [digest((p - a).to_bytes(8, "little") + raw[a:b]) for a, p, b in zip(left.tolist(), at.tolist(), right.tolist(), strict=True)]
                yield record(schema, id=ids.take(pa.array(row + number)), at=at - begin, gram=gram.view(np.int64), context=context, near=near, far=far)

    return texts.select("id", "text").mapInArrow(find, ANCHORS)


def suffix_order(hashes: PrefixHash, starts: np.ndarray, ends: np.ndarray, data: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Order of suffixes start..end within groups (numbers that rise along the input).

    Bottom-up merge sort over all groups at once: the place of a suffix in a merged run is its
    place in its own run plus its rank in the other, found by binary search; each comparison finds
    the common extension by binary search over the prefix hashes and then looks at one byte.
    """
    n = len(starts)
    first = np.searchsorted(group, group, side="left")
    size = np.searchsorted(group, group, side="right") - first
    order, span = np.arange(n), int((ends - starts).max(initial=0))
    steps = max(1, int(span).bit_length())

    def before(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Does suffix i come before suffix j (a prefix of another comes first)?"""
        a, b = starts[i], starts[j]
        least = np.minimum(ends[i] - a, ends[j] - b)
        low, high = np.zeros(len(i), np.int64), least
        for _ in range(steps):
            mid = (low + high + 1) // 2
            same = hashes.of(a, a + mid) == hashes.of(b, b + mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        inner = low < least
        x, y = data[np.minimum(a + low, len(data) - 1)], data[np.minimum(b + low, len(data) - 1)]
        return np.where(inner, x < y, (ends[i] - a) < (ends[j] - b))

    width = 1
    while width < (size.max(initial=1)):
        place = np.arange(n) - first
        work = np.flatnonzero(size > width)
        run = place[work] // width
        other = np.where(run % 2 == 0, run + 1, run - 1) * width
        low = np.minimum(other, size[work])
        top = np.minimum(other + width, size[work])
        begin, right = low.copy(), run % 2 == 1
        for _ in range(int(width).bit_length()):
            live = np.flatnonzero(low < top)
            if not len(live):
                break
            mid = (low[live] + top[live]) // 2
            me, it = order[work[live]], order[first[work[live]] + mid]
            # of equals the left run's come first
            less = np.where(right[live], ~before(me, it), before(it, me))
            low[live], top[live] = np.where(less, mid + 1, low[live]), np.where(less, top[live], mid)
        target = first[work] + (run // 2) * 2 * width + (place[work] % width) + (low - begin)
        new = order.copy()
        new[target] = order[work]
        order, width = new, width * 2
    return order


def repeated_range(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, at: np.ndarray, near: np.ndarray, far: np.ndarray, gram: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each context (start..end of the buffer, anchor ``at``), the least and greatest d in near..far
    whose window starts in another context too; -1 where none does. Grams rise along the input."""
    n = len(at)
    hashes = PrefixHash(data)
    order = suffix_order(hashes, at, np.minimum(ends, at + length), data, gram)
    low, high = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
    mates_low, mates_high = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
    for d in range(int(far.max(initial=-1)) + 1):
        if d:
            byte = data[np.maximum(at - d, starts)]
            order = order[np.argsort(byte[order], kind="stable")]
        active = order[(near[order] <= d) & (d <= far[order])]
        if len(active) < 2:
            continue
        begin = at[active] - d
        h = hashes.of(begin, begin + length)
        same = (h[1:] == h[:-1]) & (gram[active[1:]] == gram[active[:-1]])
        for mine, mate in ((active[1:][same], active[:-1][same]), (active[:-1][same], active[1:][same])):
            high[mine], mates_high[mine] = d, mate
            new = low[mine] < 0
            low[mine[new]], mates_low[mine[new]] = d, mate[new]
    for d, mates in ((low, mates_low), (high, mates_high)):  # the hashes must not have deceived us
        rows = np.flatnonzero(d >= 0)
        for part in np.array_split(rows, max(1, len(rows) * length // 1_000_000)):
            reach = np.arange(length)
            if len(part) and not (data[(at[part] - d[part])[:, None] + reach] == data[(at[mates[part]] - d[part])[:, None] + reach]).all():
                raise RuntimeError("two different windows have one hash: change BASES")
    return low, high


CLASS_RANGE = "gram long, context binary, low int, high int"


def _sorted_ranges(contexts: DataFrame, length: int) -> DataFrame:
    """Suffix-sort the contexts of each gram, many grams at a time."""
    schema = pa.schema([("gram", pa.int64()), ("context", pa.binary()), ("low", pa.int32()), ("high", pa.int32())])

    def solve(rows: dict[str, np.ndarray], contexts: list[bytes], blobs: list[bytes]) -> pa.RecordBatch:
        lengths = np.array([len(b) for b in blobs], np.int64)
        ends = np.cumsum(lengths)
        starts = ends - lengths
        low, high = repeated_range(np.frombuffer(b"".join(blobs), np.uint8), starts, ends, starts + rows["inside"], rows["near"], rows["far"], rows["gram"], length)
        return record(schema, gram=rows["gram"], context=contexts, low=low, high=high)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[str, list] = {c: [] for c in ("gram", "inside", "near", "far")}
        keys: list[bytes] = []
        blobs: list[bytes] = []
        held = 0

        def flush(rows: int) -> pa.RecordBatch:
            whole = {c: np.concatenate(v) for c, v in waiting.items()}
            out = solve({c: v[:rows] for c, v in whole.items()}, keys[:rows], blobs[:rows])
            waiting.update({c: [v[rows:]] for c, v in whole.items()})
            del keys[:rows], blobs[:rows]
            return out

        for batch in (b.slice(i, BATCH_ROWS) for b in batches for i in range(0, len(b), BATCH_ROWS)):
            for c in waiting:
                waiting[c].append(batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64))
            keys += batch.column("context").to_pylist()
            blobs += batch.column("bytes").to_pylist()
            held += sum(map(len, blobs[-len(batch):]))
            if held >= SORT_BYTES:
                gram = np.concatenate(waiting["gram"])
                rows = int(np.searchsorted(gram, gram[-1], side="left"))  # the last gram may go on
                if rows:
                    yield flush(rows)
                    held = sum(map(len, blobs))
        if blobs:
            yield flush(len(blobs))

    n = partitions(contexts.sparkSession)
    return contexts.repartition(n, "gram").sortWithinPartitions("gram").mapInArrow(run, CLASS_RANGE)


def _context_bytes(texts: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """Fetch what the windows of ``wanted`` (id, at, gram, context, near, far) hold."""
    schema = pa.schema([("gram", pa.int64()), ("context", pa.binary()), ("inside", pa.int32()), ("near", pa.int32()), ("far", pa.int32()), ("bytes", pa.binary())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (small for b in batches for small in _small(b, "text", "places")):
            # one row per text at a time: the contexts of a text are not more than a few times its size
            for text, places in zip(batch.column("text"), batch.column("places"), strict=True):
                data, places = text.as_py().encode(), places.as_py()
                left = [p["at"] - p["far"] for p in places]
                yield record(schema, **{c: [p[c] for p in places] for c in ("gram", "context", "near", "far")}, inside=[p["at"] - a for p, a in zip(places, left, strict=True)],
                             bytes=[data[a:p["at"] - p["near"] + length] for p, a in zip(places, left, strict=True)])

    places = wanted.groupBy("id").agg(F.collect_list(F.struct("at", "gram", "context", "near", "far")).alias("places")).withColumnRenamed("id", "p_id")
    both = texts.join(places, F.col("id") == F.col("p_id")).select("text", "places")
    return both.mapInArrow(cut, "gram long, context binary, inside int, near int, far int, bytes binary")


def _counted_ranges(contexts: DataFrame, length: int) -> DataFrame:
    """The same ranges by counting the digests of windows, for grams with too many contexts for one task."""
    schema = pa.schema([("gram", pa.int64()), ("context", pa.binary()), ("d", pa.int32()), ("window", pa.binary())])

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, BATCH_ROWS) for b in batches for i in range(0, len(b), BATCH_ROWS)):
            for row in batch.to_pylist():
                data, d = row["bytes"], np.arange(row["near"], row["far"] + 1)
                begin = (row["inside"] - d).tolist()
                yield record(schema, gram=[row["gram"]] * len(d), context=[row["context"]] * len(d), d=d, window=[digest(data[a:a + length]) for a in begin])

    rows = written(contexts.mapInArrow(hashes, "gram long, context binary, d int, window binary"), "windows")
    again = rows.groupBy("gram", "window").agg(F.count("*").alias("n")).where("n > 1").select(F.col("gram").alias("g"), F.col("window").alias("w"))
    found = rows.join(again, (F.col("gram") == F.col("g")) & (F.col("window") == F.col("w")))
    return found.groupBy("gram", "context").agg(F.min("d").alias("low"), F.max("d").alias("high"))


def repeated_spans(texts: DataFrame, length: int, most_contexts: int = MOST_CONTEXTS) -> DataFrame:
    """(id, spans): byte ranges (start, end) of distinct (id, text) rows covered by windows that occur
    again in them or another text, as an array in no order; ids without any are absent."""
    rows = written(anchor_rows(texts, length), "anchors")
    of_gram = Window.partitionBy("gram")
    classes = rows.groupBy("gram", "context").agg(F.count("*").alias("n")).withColumns(
        {"contexts": F.count("*").over(of_gram), "anchors": F.sum("n").over(of_gram)}).where("anchors > 1")
    classes = written(classes.select(F.col("gram").alias("g"), F.col("context").alias("x"), "n", "contexts"), "classes")
    again = written(rows.join(classes, (F.col("gram") == F.col("g")) & (F.col("context") == F.col("x"))).drop("g", "x"), "repeated")
    one = F.min(F.struct("id", "at", "near", "far")).alias("one")
    wanted = again.where("contexts > 1").groupBy("gram", "context", "contexts").agg(one).select("one.*", "gram", "context", "contexts")
    usual, hot = wanted.where(F.col("contexts") <= most_contexts), wanted.where(F.col("contexts") > most_contexts)
    ranges = written(_sorted_ranges(_context_bytes(texts, usual, length), length), "ranges")
    if not hot.isEmpty():
        ranges = ranges.unionByName(written(_counted_ranges(_context_bytes(texts, hot, length), length), "hot-ranges"))
    found = ranges.where("low >= 0").select(F.col("gram").alias("g"), F.col("context").alias("x"), "low", "high")
    # a class of two repeats in all its windows, another where a neighbour was found
    whole = again.where("n > 1").select("id", "at", F.col("near").alias("low"), F.col("far").alias("high"))
    part = again.where("n = 1").join(found, (F.col("gram") == F.col("g")) & (F.col("context") == F.col("x"))).select("id", "at", "low", "high")
    spans = whole.unionByName(part).select("id", F.struct((F.col("at") - F.col("high")).alias("start"), (F.col("at") - F.col("low") + length).alias("end")).alias("span"))
    return spans.groupBy("id").agg(F.collect_list("span").alias("spans"))


def merged_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of bytes under any span."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def without_repeats(docs: DataFrame, length: int, most_contexts: int = MOST_CONTEXTS) -> DataFrame:
    """doc_id, n_bytes, spans (removed runs in order) and kept (the remaining bytes) of each document."""
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("key", F.sha2("text", 256))
    texts = keyed.groupBy("key").agg(F.count("*").alias("n"), F.any_value("text").alias("text"))
    texts = written(texts.withColumn("id", F.monotonically_increasing_id()), "texts")
    long_enough = texts.where(F.octet_length("text") >= length)
    spans = repeated_spans(long_enough.select("id", "text"), length, most_contexts).withColumnRenamed("id", "s_id")
    schema = pa.schema([("key", pa.string()), ("n_bytes", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary())])

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (small for b in batches for small in _small(b, "text", "spans")):
            out: dict[str, list] = {f.name: [] for f in schema}
            for key, n, text, found in zip(*(batch.column(c).to_pylist() for c in ("key", "n", "text", "spans")), strict=True):
                data = text.encode()
                if n > 1 and len(data) >= length:
                    runs = [(0, len(data))]
                else:
                    runs = merged_spans([(s["start"], s["end"]) for s in found or ()])
                edges = [0, *(x for r in runs for x in r), len(data)]
                out["key"].append(key)
                out["n_bytes"].append(len(data))
                out["spans"].append([{"start": a, "end": b} for a, b in runs])
                out["kept"].append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
            yield record(schema, **out)

    done = texts.join(spans, F.col("id") == F.col("s_id"), "left").select("key", "n", "text", "spans").mapInArrow(
        keep, "key string, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")
    done = done.withColumnRenamed("key", "d_key")
    return keyed.select("doc_id", "key").join(done, F.col("key") == F.col("d_key")).select("doc_id", "n_bytes", "spans", "kept")
