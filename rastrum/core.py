"""Session set-up and small helpers shared by every module."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HOT_ROWS_KEY = "spark.rastrum.hotGroupRows"
BROADCAST_ROWS_KEY = "spark.rastrum.broadcastRows"


def local_session(cpus: int | str = 8, app: str = "rastrum") -> SparkSession:
    """Session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus) if str(cpus).isdigit() else "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("RASTRUM_DRIVER_MEMORY", "12g"))
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def conf_int(spark: SparkSession, key: str, default: int) -> int:
    return int(spark.conf.get(key, str(default)))


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage through the reliable checkpoint folder of the cluster.

    The folder is the one named by ``spark.checkpoint.dir``; a temporary one is set only where the
    session names none (tests, local runs).
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))
    return df.checkpoint(eager=True)


def r6(col: Column | str) -> Column:
    """Round a floating result to six decimals (sums depend on order beyond that)."""
    return F.round(F.col(col) if isinstance(col, str) else col, 6)


def ratio(num: Column, den: Column) -> Column:
    """num / den, null when the denominator is zero or null."""
    return F.when(den != 0, num.cast("double") / den)


def any_row(df: DataFrame) -> bool:
    return not df.limit(1).isEmpty()


def fits(df: DataFrame, rows: int | None = None) -> bool:
    """True when df has at most ``rows`` rows, found by reading no more than one row beyond it."""
    limit = rows or conf_int(df.sparkSession, BROADCAST_ROWS_KEY, 200_000)
    return df.limit(limit + 1).count() <= limit
