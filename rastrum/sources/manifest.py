"""What is known of a table's files, computed once for each state of a file and kept in the shared folder.

A file's fingerprint is its path, size and time of change. Hashes of texts are stored by fingerprint:
files that were seen before are not read again, changed ones are, and rows of files that are gone are not
returned. A write replaces whole fingerprints, so a retried or repeated job leaves one copy.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..core import any_row, checkpointed, conf_int
from ..core import HOT_ROWS_KEY
from ..scale import has_hot_group

LAYOUT = "doc_id long, lang string, source string, n_chars long, sha256_hash string, perceptual_hash long, fingerprint string"
_KNOWN: dict[tuple, object] = {}


def files(spark: SparkSession, path: str) -> DataFrame:
    """(path, fingerprint) of a table's files; contents are not read."""
    found = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_modification_time").alias("changed"))
    return found.select("path", F.sha2(F.concat_ws("|", "path", "size", F.unix_micros("changed")), 256).alias("fingerprint"))


def state(spark: SparkSession, path: str) -> str:
    """One value for all files of a table."""
    r = files(spark, path).agg(F.count("*").alias("n"), F.sum(F.xxhash64("fingerprint").cast("decimal(38,0)")).alias("s")).first()
    return f"{r['n']}:{r['s']}"


def folder(spark: SparkSession) -> str:
    """Where manifests are kept: the shared folder that the cluster names, else the session's own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named is None and spark.sparkContext.getCheckpointDir() is None:
        checkpointed(spark.range(1))
    return f"{(named or spark.sparkContext.getCheckpointDir()).rstrip('/')}/rastrum-manifest"


def _kept(spark: SparkSession, where: str) -> DataFrame | None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
    there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    return spark.read.schema(LAYOUT).parquet(where) if there else None


def hashed_texts(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, lang, source, n_chars, sha256_hash and perceptual_hash of a documents table.

    An unreadable (empty) text has no perceptual hash. Repeated rows stay; nulls keep null hashes."""
    from ..functions.exprs import text_dhash

    where, key = folder(spark), (spark.sparkContext.applicationId, path, state(spark, path))
    if key not in _KNOWN:
        listed = files(spark, path)
        kept = _kept(spark, where)
        new = checkpointed(listed if kept is None else listed.join(kept.select("fingerprint").distinct(), "fingerprint", "left_anti"))
        if any_row(new):
            rows = spark.read.parquet(path).select("doc_id", "lang", "source", "n_chars", "text", F.col("_metadata.file_path").alias("path"))
            rows = rows.join(new, "path").select(
                "doc_id", "lang", "source", F.col("n_chars").cast("bigint").alias("n_chars"), F.sha2("text", 256).alias("sha256_hash"), F.when(F.col("n_chars") > 0, text_dhash(F.col("text"))).alias("perceptual_hash"), "fingerprint")
            rows.write.partitionBy("fingerprint").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(where)
        _KNOWN[key] = checkpointed(listed.select("fingerprint"))
    return spark.read.schema(LAYOUT).parquet(where).join(_KNOWN[key], "fingerprint", "left_semi").drop("fingerprint")


def hot_key(df: DataFrame, path: str, *keys: str, limit: int | None = None) -> bool:
    """Does a key of the table hold more rows than one task should order, or than ``limit``? Counted once for each state of the files."""
    spark = df.sparkSession
    key = (spark.sparkContext.applicationId, path, state(spark, path), keys, limit or conf_int(spark, HOT_ROWS_KEY, 2_000_000))
    if key not in _KNOWN:
        _KNOWN[key] = has_hot_group(df.select(*keys), keys, limit)
    return _KNOWN[key]
