"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..core import checkpointed

WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, what: str) -> str:
    """A new folder below the checkpoint folder, which every executor and the driver can reach."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        checkpointed(spark.range(1))  # sets the folder the way the rest of the library does
    return f"{sc.getCheckpointDir().rstrip('/')}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts lineage and gives real sizes.

    What was shuffled for it is not needed any more; Spark deletes shuffle files when the driver's
    collector finds their owners gone, so it is asked to look, which bounds the disk of long jobs."""
    spark, schema, path = df.sparkSession, df.schema, shared_folder(df.sparkSession, what)
    df.write.option("compression", "zstd").parquet(path)
    del df
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def all_equal(left: Sequence[Column], right: Sequence[Column]) -> Column:
    """Null-safe equality of several columns."""
    out = F.lit(True)
    for a, b in zip(left, right, strict=True):
        out = out & a.eqNullSafe(b)
    return out


def having_ids(df: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``df`` whose ``id`` is in the rows of ``ids``, by bitmaps of 32,768 ids each.

    Numbers given out in order lie close together, so the bitmaps are a small fraction of the ids; Spark
    sends them to the tasks or deals both sides out by their number, as their size allows."""
    maps = ids.groupBy(F.bitmap_bucket_number("id").alias("__block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("id")).alias("__bits"))
    both = df.join(maps, F.bitmap_bucket_number("id") == F.col("__block"))
    place = F.bitmap_bit_position("id")
    byte = F.conv(F.hex(F.substring(F.col("__bits"), (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("bigint")
    return both.where(F.getbit(byte, (place % 8).cast("int")) == 1).drop("__block", "__bits")


def texts(column: pa.Array) -> list[str]:
    """Texts of an Arrow column, null as empty."""
    return [t or "" for t in column.to_pylist()]


def record(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)
