"""Token-id files: fixed-width bit packing with block offsets.

A file row holds one *shard*: a run of whole documents in ascending id order, packed as

    header      magic ``TPK1``, bits per id, ids per block, number of documents, ids, blocks
    documents   int64 document ids, then int64 first id positions (one more than documents)
    blocks      int64 byte offsets of the blocks (one more than blocks)
    payload     every id in ``bits`` bits, least significant bit first, blocks padded to bytes

The rows are kept in Parquet, so Spark writes, commits and recovers them. Because the width is
fixed, any range of ids unpacks with numpy from the blocks that hold it (``ids_between``).

Defined cases: a null text counts as empty and gives the end id alone; a null document id sorts
first; repeated rows are each written, in no particular order among themselves; an empty table
gives no shard; all columns other than the id and the text are ignored, whatever their names.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import partitions, record, shared_folder, texts
from .pieces import Pieces, Ragged, Words

MAGIC = b"TPK1"
HEAD = struct.Struct("<4sHxxIIQI")
BLOCK = 1024
SHARD_IDS = 1_000_000
NONE_ID = -(1 << 63)  # stands for a null document id inside a shard


def width(vocabulary: int) -> int:
    """Fewest bits that hold every id below ``vocabulary``."""
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    if bits in (8, 16, 32):  # the same layout as little-endian integers
        return ids.astype(f"<u{bits // 8}").tobytes()
    planes = (ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & 1
    return np.packbits(planes.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(payload: bytes | memoryview, count: int, bits: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(payload, f"<u{bits // 8}", count).astype(np.uint32)
    planes = np.unpackbits(np.frombuffer(payload, np.uint8), count=count * bits, bitorder="little").reshape(count, bits)
    return (planes.astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)


def shard_bytes(doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray, bits: int) -> bytes:
    blocks = [pack(ids[i:i + BLOCK], bits) for i in range(0, len(ids), BLOCK)] if bits not in (8, 16, 32) else [pack(ids, bits)]
    step = BLOCK * bits // 8
    n_blocks = -(-len(ids) // BLOCK)
    body = b"".join(blocks)
    offsets = np.minimum(np.arange(n_blocks + 1, dtype="<i8") * step, len(body))
    starts = np.concatenate([[0], np.cumsum(lengths)]).astype("<i8")
    return b"".join((HEAD.pack(MAGIC, bits, BLOCK, len(doc_ids), len(ids), n_blocks), doc_ids.astype("<i8").tobytes(), starts.tobytes(), offsets.tobytes(), body))


class Shard:
    """Random access into the bytes of one shard."""

    def __init__(self, data: bytes):
        self.data = memoryview(data)
        magic, self.bits, self.block, n_docs, self.n_ids, n_blocks = HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a token shard")
        at = HEAD.size
        self.doc_ids = np.frombuffer(data, "<i8", n_docs, at)
        self.starts = np.frombuffer(data, "<i8", n_docs + 1, at + 8 * n_docs)
        at += 16 * n_docs + 8
        self.offsets = np.frombuffer(data, "<i8", n_blocks + 1, at)
        self.at = at + 8 * (n_blocks + 1)

    def ids_between(self, start: int, end: int) -> np.ndarray:
        """Ids at positions start..end-1, unpacked from the blocks that hold them alone."""
        if end <= start:
            return np.empty(0, np.uint32)
        first, last = start // self.block, (end - 1) // self.block
        lo, hi = self.at + int(self.offsets[first]), self.at + int(self.offsets[last + 1])
        count = min((last + 1) * self.block, self.n_ids) - first * self.block
        return unpack(self.data[lo:hi], count, self.bits)[start - first * self.block:end - first * self.block]

    def document(self, i: int) -> np.ndarray:
        return self.ids_between(int(self.starts[i]), int(self.starts[i + 1]))


class PieceEncoder:
    """Ids of texts from the tokenizers library, each distinct piece encoded once."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.words = Words(self.tokenizer)
        with open(path, encoding="utf-8") as f:
            self.cut = Words.independent(json.load(f))
        self.known = Ragged(np.uint32)
        self.pieces = Pieces(self._learn, self._forget)

    def _forget(self) -> None:
        self.known = Ragged(np.uint32)

    def _learn(self, new: list[str]) -> None:
        words, model, added = self.words, self.tokenizer.model.tokenize, self.words.added
        flat, lengths = [], []
        for piece in new:
            before = len(flat)
            if any(a in piece for a in added):
                flat += self.tokenizer.encode(piece, add_special_tokens=False).ids
            else:
                for word in words(piece):
                    flat += [t.id for t in model(word)]
            lengths.append(len(flat) - before)
        self.known.add(np.array(flat, np.uint32), np.array(lengths, np.int32))

    def __call__(self, batch: list[str]) -> list[np.ndarray]:
        if not self.cut:  # another kind of tokenizer: whole texts
            return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(batch, add_special_tokens=False)]
        return [self.known.gather(n) for n in self.pieces.number(batch)]


_ENCODERS: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """One encoder per worker process, kept between tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]


def _chunks(batch: list[str], most: int = 4_000_000) -> Iterator[slice]:
    """Runs of texts of about ``most`` characters."""
    start = size = 0
    for i, t in enumerate(batch):
        size += len(t)
        if size >= most:
            yield slice(start, i + 1)
            start, size = i + 1, 0
    if start < len(batch):
        yield slice(start, len(batch))


SHARD_SCHEMA = "part int, seq int, n_docs int, n_ids long, data binary"


def write_token_files(docs: DataFrame, tokenizer_path: str, end_id: int, vocabulary: int, path: str) -> None:
    """Encode ``docs`` (doc_id, text) and write shards in ascending doc_id order to ``path``.

    One range exchange orders the documents; the number of the range and of the shard within
    it is the order of the whole.
    """
    bits = width(max(vocabulary, end_id + 1))
    schema = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("n_docs", pa.int32()), ("n_ids", pa.int64()), ("data", pa.binary())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_texts, part, seq = encoder(tokenizer_path), TaskContext.get().partitionId(), 0
        names, ids, size = [], [], 0

        def shard():
            lengths = np.array([len(x) for x in ids], np.int64)
            data = shard_bytes(np.array(names, np.int64), lengths, np.concatenate(ids), bits)
            return record(schema, part=[part], seq=[seq], n_docs=[len(names)], n_ids=[size], data=[data])

        for batch in batches:
            doc_ids, contents = batch.column("doc_id").to_pylist(), texts(batch.column("text"))
            for run in _chunks(contents):
                for doc_id, found in zip(doc_ids[run], encode_texts(contents[run]), strict=True):
                    names.append(NONE_ID if doc_id is None else doc_id)
                    ids.append(np.append(found, np.uint32(end_id)).astype(np.uint32))
                    size += len(ids[-1])
                    if size >= SHARD_IDS:
                        yield shard()
                        names, ids, size, seq = [], [], 0, seq + 1
        if names:
            yield shard()

    ordered = docs.select("doc_id", "text").repartitionByRange(partitions(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id")
    ordered.mapInArrow(encode, SHARD_SCHEMA).write.parquet(path)


DOC_SCHEMA = "part int, seq int, doc_id long, in_shard long, n_tokens long, ids_crc32 long"


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of the files: place, number of ids and checksum, all from the bytes."""
    schema = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("doc_id", pa.int64()), ("in_shard", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, seq, data in zip(*(batch.column(c) for c in ("part", "seq", "data")), strict=True):
                shard = Shard(data.as_py())
                ids = shard.ids_between(0, shard.n_ids).astype("<u4").tobytes()
                starts = shard.starts.tolist()
                view = memoryview(ids)
                crc = [zlib.crc32(view[4 * a:4 * b]) for a, b in zip(starts, starts[1:], strict=False)]
                n = len(crc)
                doc_ids = [None if d == NONE_ID else d for d in shard.doc_ids.tolist()]
                yield record(schema, part=[part.as_py()] * n, seq=[seq.as_py()] * n, doc_id=doc_ids, in_shard=shard.starts[:-1], n_tokens=np.diff(shard.starts), ids_crc32=crc)

    return spark.read.parquet(path).select("part", "seq", "data").mapInArrow(decode, DOC_SCHEMA)


def shard_starts(spark: SparkSession, path: str) -> DataFrame:
    """Position of every shard in the whole. Ranges are few (one per task), so their running
    sum is over at most as many rows as there were tasks; shards are summed within their range."""
    from pyspark.sql import Window

    shards = spark.read.parquet(path).select("part", "seq", "n_ids")
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col("part").alias("p"), F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("part_start"))
    within = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    inner = shards.select("part", "seq", F.coalesce(F.sum("n_ids").over(within), F.lit(0)).alias("shard_start"))
    return inner.join(parts, F.col("part") == F.col("p")).select("part", "seq", (F.col("part_start") + F.col("shard_start")).alias("at"))


def token_files(docs: DataFrame, tokenizer_path: str, end_id: int, vocabulary: int) -> DataFrame:
    """Write the files of ``docs`` to the shared folder and describe each document from them."""
    spark = docs.sparkSession
    path = shared_folder(spark, "tokens")
    write_token_files(docs, tokenizer_path, end_id, vocabulary, path)
    rows, starts = read_token_files(spark, path), shard_starts(spark, path)
    return rows.join(starts, ["part", "seq"]).select(
        "doc_id", (F.col("at") + F.col("in_shard")).alias("start"), "n_tokens", "ids_crc32", "part", "seq")
