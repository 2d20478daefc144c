"""What the operators share: tables, scratch space that all executors can read, bytes of Arrow columns."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts: space and U+0009 to U+000D.
SPACE = b" \t\n\v\f\r"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share; a temporary one where it is unset (tests)."""
    conf = spark.sparkContext.getConf()
    if base := conf.get("spark.checkpoint.dir"):
        return base.rstrip("/")
    jvm = spark.sparkContext._jsc.sc().getCheckpointDir()
    if jvm.isEmpty():
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidewater-"))
        jvm = spark.sparkContext._jsc.sc().getCheckpointDir()
    return jvm.get().rstrip("/")


class Scratch:
    """Tables of one run, below the shared folder. They cut lineage: a lost executor costs a re-read, not a recomputation.

    Results read them lazily, so they stay until the driver's program ends.
    """

    def __init__(self, spark: SparkSession, what: str):
        self.spark, self.base, self.n = spark, f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}", 0
        atexit.register(self._delete, self.base)

    def _delete(self, path: str) -> None:
        if self.spark._jsc.sc().isStopped():
            return
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def write(self, df: DataFrame, name: str = "t") -> DataFrame:
        self.n += 1
        path = f"{self.base}/{self.n:03d}-{name}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def clear(self) -> None:
        """Has Spark delete the shuffles of what has been written; it does so when the driver's garbage is collected."""
        gc.collect()
        self.spark._jvm.System.gc()

    def drop(self, df: DataFrame) -> None:
        """Frees a table that nothing reads any more."""
        if path := getattr(df, "_scratch_path", None):
            self._delete(path)


def as_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of a string column, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def column_of(batch: pa.RecordBatch, name: str) -> pa.Array:
    """A column, or as ``row.text`` a field of the struct ``row``, in which rows carry their own columns under any names."""
    first, _, rest = name.partition(".")
    return batch.column(first).field(rest) if rest else batch.column(first)


@lru_cache(maxsize=1)
def _trim():
    """glibc's malloc_trim; nothing where there is none."""
    return getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0)


def release() -> None:
    """Gives free memory back to the system: workers are used again by the tasks that follow."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the bytes of a string column stay below a bound, a longer row alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.asarray(pc.binary_length(column_of(batch, column).cast(pa.binary())).fill_null(0), np.int64)
        cut = np.cumsum(sizes) // most
        starts = np.flatnonzero(np.r_[True, cut[1:] != cut[:-1]])
        for s, e in zip(starts, [*starts[1:], batch.num_rows]):
            yield batch.slice(s, e - s)
    release()


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, ..., lengths[0] of them, then those of starts[1] and so on."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.cumsum(lengths) - lengths
    return np.arange(total) + np.repeat(starts - first, lengths)


def text_gb(df: DataFrame, column: str = "text") -> float:
    """GB of a text column: what partition counts follow."""
    return (df.agg(F.sum(F.octet_length(column))).first()[0] or 0) / 1e9


def batch_of(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(columns, schema)], schema=schema)
