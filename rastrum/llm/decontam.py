"""Benchmark passages in documents, by counting shared q-grams in diagonal bands.

Texts are compared as the UTF-8 bytes of their normalised form: A-Z in lower case, each run of white
space one space. A benchmark item is cut into overlapping segments; a document holds a passage of
the item if a part of it is within the segment's budget of edits. Three steps find all of them:

* Seeds: a segment with e edits keeps at least one of e + 1 equal pieces whole, so positions that
  spell a piece are the only candidates. Each gives a diagonal (text position minus segment position).
* Q-gram lemma: a part within e edits shares at least n - q + 1 - q e of the segment's q-grams on
  diagonals at most e away. Candidates whose band, 2 e + 1 wide around their diagonal, has fewer go;
  bands of neighbouring seeds overlap, so none falls between two.
* Alignment: a banded edit distance of the segment against the part verifies the rest.

The benchmark goes to the tasks in blocks of bounded size (``BLOCK_CHARS`` of normalised text); each
block is compared with every document where it is read. Documents are not exchanged.

Defined cases: null texts and items count as empty; items under ``LEAST`` bytes when normalised are
too short to tell and match nothing; equal or repeated items each match; repeated documents are each
reported; null ids are kept; other columns are ignored; without items or documents there are no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import record
from .neardup import _LOWER, _SPACE
from .repeats import U, _buffers, mixed

SEGMENT, STRIDE, LEAST = 80, 40, 32
EDITS = 0.08
Q = 6
BLOCK_CHARS = 2_000_000
_END = np.uint8(255)  # never a byte of UTF-8


def normalised(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Normal form of texts laid end to end, with ``_END`` after each: bytes, where each text ends in
    them (at its mark), and the place of each byte in the input."""
    low = _LOWER[data]
    gap = _SPACE[data]
    low[gap] = 32
    begin = ends - np.diff(ends, prepend=0)
    keep = np.ones(len(data), bool)
    keep[1:] = ~(gap[1:] & gap[:-1])
    keep[begin[begin < len(data)]] = True
    kept = np.flatnonzero(keep)
    marks = np.searchsorted(kept, ends, side="left") + np.arange(len(ends))
    out = np.full(len(kept) + len(ends), _END, np.uint8)
    spot = np.ones(len(out), bool)
    spot[marks] = False
    out[spot] = low[kept]
    place = np.empty(len(out), np.int64)
    place[spot] = kept
    place[marks] = ends
    return out, marks, place


def seed_codes(data: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n bytes from every position (n at most 24)."""
    size = max(len(data) - n + 1, 0)
    h = np.zeros(size, U)
    for a in range(0, n, 8):
        word = np.zeros(size, U)
        for i in range(a, min(a + 8, n)):
            word |= data[i:i + size].astype(U) << U(8 * (i - a))
        h = mixed(h * U(0x94D049BB133111EB) + word) if a else word
    return mixed(h * U(0x9E3779B97F4A7C15) + U(n))


@dataclass
class Segments:
    """Segments of one block of the benchmark and their seeds by length."""
    items: list
    text: list[np.ndarray]
    item: np.ndarray
    budget: np.ndarray
    seeds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]  # codes, segment, offset, table

    @classmethod
    def of(cls, rows: list[tuple], edits: float) -> "Segments":
        items, text, item = [], [], []
        for item_id, content in rows:
            raw = np.frombuffer((content or "").encode(), np.uint8)
            norm, marks, _ = normalised(raw, np.array([len(raw)]))
            norm = np.frombuffer(norm[:marks[0]].tobytes().strip(), np.uint8)
            if len(norm) < LEAST:
                continue
            items.append(item_id)
            starts = [*range(0, max(1, len(norm) - SEGMENT + 1), STRIDE)]
            if len(norm) > SEGMENT and starts[-1] + SEGMENT < len(norm):
                starts.append(len(norm) - SEGMENT)
            for s in starts:
                text.append(norm[s:s + SEGMENT])
                item.append(len(items) - 1)
        budget = np.array([int(edits * len(t)) for t in text], np.int64)
        found: dict[int, tuple[list, list, list]] = {}
        for k, (t, e) in enumerate(zip(text, budget.tolist(), strict=True)):
            piece = len(t) // (e + 1)
            n = min(piece, 24)
            codes, segs, offs = found.setdefault(n, ([], [], []))
            for i in range(e + 1):
                codes.append(int(seed_codes(t[i * piece:i * piece + n], n)[0]))
                segs.append(k)
                offs.append(i * piece)
        seeds = {}
        for n, (codes, segs, offs) in found.items():
            order = np.argsort(np.array(codes, U), kind="stable")
            c = np.array(codes, U)[order]
            table = np.zeros(1 << 20, bool)
            table[(c >> U(44)).astype(np.int64)] = True
            seeds[n] = (c, np.array(segs)[order], np.array(offs)[order], table)
        return cls(items, text, np.array(item, np.int64), budget, seeds)


def banded_distance(a: np.ndarray, b: np.ndarray, e: int) -> int:
    """Least edits between ``a`` and any part of ``b`` near the main diagonal (b starts e before a's
    place); more than e means none within e. Row by row over 4 e + 1 diagonals."""
    width = 4 * e + 1
    far = 2 * e + 1
    row = np.zeros(width, np.int64)  # a part may start anywhere in the band
    j = np.arange(width)
    for i in range(len(a)):
        at = i + j - e
        ok = (at >= 0) & (at < len(b))
        cost = np.where(ok, (b[np.clip(at, 0, len(b) - 1)] != a[i]).astype(np.int64), far)
        new = row + cost
        new[:-1] = np.minimum(new[:-1], row[1:] + 1)
        new = np.minimum.accumulate(new - j) + j  # insertions along the row
        row = np.minimum(new, far)
        if row.min() > e:
            return int(row.min())
    return int(row.min())


def shared_qgrams(parts: np.ndarray, segment: np.ndarray, e: int) -> np.ndarray:
    """How many q-grams of the segment each part (rows of len(segment) + 2 e bytes, starting e before
    its place) has on diagonals at most e away."""
    n = len(segment) - Q + 1
    own = np.lib.stride_tricks.sliding_window_view(segment, Q)
    theirs = np.lib.stride_tricks.sliding_window_view(parts, Q, axis=1)
    pack = lambda w: (w.astype(np.int64) << (8 * np.arange(Q))).sum(axis=-1)
    own, theirs = pack(own), pack(theirs)
    hit = np.zeros((len(parts), n), bool)
    for shift in range(2 * e + 1):
        hit |= theirs[:, shift:shift + n] == own
    return hit.sum(axis=1)


def passages(data: np.ndarray, ends: np.ndarray, known: Segments) -> list[tuple[int, int, int, int, int]]:
    """(text, item, start byte, end byte, edits) of passages in texts laid end to end."""
    norm, marks, place = normalised(data, ends)
    hits: set[tuple[int, int]] = set()
    for n, (codes, segs, offs, table) in known.seeds.items():
        h = seed_codes(norm, n)
        at = np.flatnonzero(table[(h >> U(44)).astype(np.int64)])
        first, last = np.searchsorted(codes, h[at], side="left"), np.searchsorted(codes, h[at], side="right")
        n_hits = last - first
        which = np.repeat(first, n_hits) + np.arange(int(n_hits.sum())) - np.repeat(np.cumsum(n_hits) - n_hits, n_hits)
        hits.update(zip(segs[which].tolist(), (np.repeat(at, n_hits) - offs[which]).tolist(), strict=True))
    by_segment: dict[int, list[int]] = {}
    for k, start in hits:
        by_segment.setdefault(k, []).append(start)
    begin = np.concatenate([[0], marks[:-1] + 1])
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    for k, starts in by_segment.items():
        segment, e = known.text[k], int(known.budget[k])
        size = len(segment) + 2 * e
        reach = np.arange(size)
        order = np.sort(np.array(starts))
        for part in np.array_split(order, max(1, len(order) // 2000)):
            at = part[:, None] - e + reach
            rows = np.where((at >= 0) & (at < len(norm)), norm[np.clip(at, 0, len(norm) - 1)], _END)
            need = len(segment) - Q + 1 - Q * e
            good = part[shared_qgrams(rows, segment, e) >= max(need, 1)]
            for start in good.tolist():
                # the seed may lie in the next text's first bytes when the segment begins before it
                text = int(np.searchsorted(marks, start + len(segment) // 2, side="left"))
                if text >= len(marks):
                    text = len(marks) - 1
                lo, hi = max(start - 2 * e, int(begin[text])), min(start + len(segment) + 2 * e, int(marks[text]))
                if hi <= lo:
                    continue
                # b starts e before a's place: pad where the text has begun later
                padded = np.concatenate([np.full(lo - (start - 2 * e), _END, np.uint8), norm[lo:hi]])[e:]
                edits = banded_distance(segment, padded, e)
                if edits <= e:
                    key = (text, int(known.item[k]))
                    a, b = int(place[lo] - (ends[text - 1] if text else 0)), int(place[hi] - (ends[text - 1] if text else 0))
                    old = best.get(key)
                    best[key] = (a, b, edits) if old is None else (min(a, old[0]), max(b, old[1]), min(edits, old[2]))
    return [(t, i, *v) for (t, i), v in sorted(best.items())]


def benchmark_blocks(benchmark: DataFrame, edits: float = EDITS) -> Iterator[Segments]:
    """The benchmark in blocks of about BLOCK_CHARS bytes, each of which fits a task."""
    size = benchmark.agg(F.coalesce(F.sum(F.octet_length(F.coalesce("text", F.lit("")))), F.lit(0))).head()[0]
    n = max(1, -(-size // BLOCK_CHARS))
    for b in range(n):
        rows = benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b).select("item_id", "text").collect()
        yield Segments.of([(r[0], r[1]) for r in rows], edits)


def matches(docs: DataFrame, benchmark: DataFrame, edits: float = EDITS) -> DataFrame:
    """doc_id, item_id, start_byte, end_byte (around the matching parts) and the fewest edits of a segment."""
    spark = docs.sparkSession
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("start_byte", pa.int64()), ("end_byte", pa.int64()), ("edits", pa.int32())])
    out = spark.createDataFrame([], "doc_id long, item_id long, start_byte long, end_byte long, edits int")
    for known in benchmark_blocks(benchmark, edits):
        sent = spark.sparkContext.broadcast(known)

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column("doc_id").to_pylist()
                for row, data, ends in _buffers(batch):
                    found = passages(data, ends, sent.value)
                    if found:
                        yield record(schema, doc_id=[ids[row + t] for t, *_ in found], item_id=[sent.value.items[i] for _, i, *_ in found],
                                     start_byte=[x[2] for x in found], end_byte=[x[3] for x in found], edits=[x[4] for x in found])

        texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
        out = out.unionByName(texts.mapInArrow(search, "doc_id long, item_id long, start_byte long, end_byte long, edits int"))
    return out


def without_passages(docs: DataFrame, benchmark: DataFrame, edits: float = EDITS) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark passage."""
    spark = docs.sparkSession
    for known in benchmark_blocks(benchmark, edits):
        sent = spark.sparkContext.broadcast(known)

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                text = batch.column("text").fill_null("") if batch.column("text").null_count else batch.column("text")
                for row, data, ends in _buffers(pa.RecordBatch.from_arrays([text], ["text"])):
                    clean[[row + t for t, *_ in passages(data, ends, sent.value)]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(search, docs.schema)
    return docs
