"""The audit log as JSON lines: appending, tail, following."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = "timestamp string, tool_name string, action string, params string, caller string, result_status string, _corrupt_record string"


def append(rows: DataFrame, path: str, most_bytes: int = 10 << 20) -> None:
    """Adds records to the log. A log that has reached ``most_bytes`` before becomes the one backup, path.1, and a new one begins."""
    spark = rows.sparkSession
    paths = spark._jvm.org.apache.hadoop.fs.Path
    log, backup = paths(path), paths(f"{path}.1")
    fs = log.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(log) and fs.getContentSummary(log).getLength() >= most_bytes:
        fs.delete(backup, True)
        fs.rename(log, backup)
    stamp = F.date_format(F.coalesce("timestamp", F.current_timestamp()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    rows.withColumn("timestamp", stamp).write.mode("append").json(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Records; a line that can't be parsed stays in _corrupt_record."""
    return spark.read.schema(RECORD).option("mode", "PERMISSIVE").json(path)


def tail(spark: SparkSession, path: str, n: int = 50) -> DataFrame:
    """The last n lines by time, oldest first; lines that can't be parsed come as they are."""
    rows = read(spark, path).withColumn("line", F.coalesce("_corrupt_record", F.concat_ws(" ", "timestamp", "action", "tool_name", "result_status")))
    return rows.orderBy(F.desc_nulls_last("timestamp"), "line").limit(n).orderBy(F.asc_nulls_last("timestamp"), "line").select("timestamp", "line")


def follow(spark: SparkSession, path: str) -> DataFrame:
    """A stream of records, as files arrive."""
    return spark.readStream.schema(RECORD).json(path)
