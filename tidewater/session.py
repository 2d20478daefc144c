"""Session settings for a cluster, or local cores in tests."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

#: UTC, adaptive plans with skew splitting, Arrow for Python workers. Sizes are left to the cluster.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
}


def session(master: str | None = None, app: str = "tidewater", **more: str) -> SparkSession:
    builder = SparkSession.builder.appName(app).config(map=SETTINGS | more)
    return (builder.master(master) if master else builder).getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share; a temporary one where it is unset (tests)."""
    if base := spark.sparkContext.getConf().get("spark.checkpoint.dir"):
        return base.rstrip("/")
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isEmpty():
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidewater-"))
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
    return held.get().rstrip("/")


def spread(rows: DataFrame) -> DataFrame:
    """Deals rows out where a scan has fewer tasks than the session has cores, as a Parquet file with one row group has."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows
