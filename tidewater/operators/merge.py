"""Table maintenance as set algebra: upserts, invalidation, soft deletes, snapshot differences. Whole new versions are written."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def upsert(current: DataFrame, incoming: DataFrame, keys: list[str], keep: list[str] = ()) -> DataFrame:
    """Rows of both tables, incoming values first; the columns ``keep`` of rows that exist stay as they are."""
    c, n = current.alias("c"), incoming.alias("n")
    joined = c.join(n, on=[F.col(f"c.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys], how="full_outer")
    is_new, is_old = F.col(f"n.{keys[0]}").isNotNull(), F.col(f"c.{keys[0]}").isNotNull()
    out = []
    for name in current.columns:
        old = F.col(f"c.{name}")
        if name not in incoming.columns:
            out.append(old.alias(name))
        elif name in keep:
            out.append(F.when(is_old, old).otherwise(F.col(f"n.{name}")).alias(name))
        else:
            out.append(F.when(is_new, F.col(f"n.{name}")).otherwise(old).alias(name))
    return joined.select(*out)


#: Rows that the bounds of number_rows are chosen from, and ranges.
SAMPLE, RANGES = 10_000, 200


def number_rows(rows: DataFrame, by: str, name: str) -> DataFrame:
    """Adds 1, 2, 3 ... in the order of a string column without nulls and repeats, without sorting all rows in one task.

    Ranges of the column hold about equally many rows: their bounds come from a bounded sample by hash. A window numbers
    the rows of each range, and the counts of the ranges before it, a table of at most RANGES rows, are added.
    """
    sample = sorted(r[0] for r in rows.select(by).orderBy(F.xxhash64(by), by).limit(SAMPLE).collect())
    bounds = sorted(set(sample[:: max(1, len(sample) // RANGES)][1:]))
    part = reduce(lambda a, b: a + (F.col(by) >= b).cast("int"), bounds, F.lit(0)) if len(bounds) < 2 else F.size(F.filter(F.lit(bounds), lambda b: b <= F.col(by)))
    ranged = rows.withColumn("_part", part)
    counts = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    numbered = ranged.withColumn("_row", F.row_number().over(Window.partitionBy("_part").orderBy(by)))
    return numbered.join(F.broadcast(before), "_part").withColumn(name, (F.col("_before") + F.col("_row")).cast("long")).drop("_part", "_before", "_row")


def upsert_files(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """By path: the id and parent_dir stay, a soft delete is cleared, new paths get the next ids in path order."""
    merged = upsert(current, incoming, ["path"], keep=["file_id", "parent_dir"]).join(incoming.select("path", F.lit(True).alias("seen")), "path", "left")
    merged = merged.withColumn("deleted_at", F.when(F.col("seen"), F.lit(None).cast("long")).otherwise(F.col("deleted_at"))).drop("seen")
    top = F.broadcast(current.agg(F.coalesce(F.max("file_id"), F.lit(0)).alias("top")))  # one row
    old, new = merged.filter("file_id IS NOT NULL"), incoming.join(current.select("path"), "path", "left_anti")
    named = new.select(*(F.col(c) if c in new.columns else F.lit(None).cast(current.schema[c].dataType).alias(c) for c in current.columns if c != "file_id"))
    numbered = number_rows(named.withColumn("deleted_at", F.lit(None).cast("long")), "path", "n").join(top, F.lit(True)).withColumn("file_id", F.col("top") + F.col("n"))
    return old.select(*current.columns).unionByName(numbered.select(*current.columns))


def soft_delete(files: DataFrame, run_start: int) -> DataFrame:
    """Live files that the run beginning at ``run_start`` has not seen are marked deleted."""
    gone = (F.col("last_seen") < run_start) & F.col("deleted_at").isNull()
    return files.withColumn("deleted_at", F.when(gone, F.lit(run_start).cast("long")).otherwise(F.col("deleted_at")))


def changed_files(old: DataFrame, new: DataFrame) -> DataFrame:
    """file_id of files whose content hash differs."""
    return old.select("file_id", F.col("sha256").alias("before")).join(new.select("file_id", "sha256"), "file_id").filter(F.col("before") != F.col("sha256")).select("file_id")


def invalidate(changed: DataFrame, nodes: DataFrame, chunks: DataFrame, embeddings: DataFrame, ledger: DataFrame) -> dict[str, DataFrame]:
    """Tables without what hangs on changed files: vectors first, as they hang on chunks, then ledger rows, nodes and chunks."""
    gone_nodes = nodes.join(changed, "file_id", "left_semi").select("node_id")
    gone_chunks = chunks.join(gone_nodes, "node_id", "left_semi").select("chunk_id")
    return {
        "embeddings": embeddings.join(gone_chunks, "chunk_id", "left_anti"),
        "pipeline_state": ledger.join(changed, "file_id", "left_anti"),
        "nodes": nodes.join(changed, "file_id", "left_anti"),
        "chunks": chunks.join(gone_nodes, "node_id", "left_anti"),
    }


def pending_files(files: DataFrame, ledger: DataFrame, pass_name: str, limit: int | None = None) -> DataFrame:
    """Live files without a done row of a pass, in id order."""
    done = ledger.filter((F.col("pass_name") == pass_name) & (F.col("status") == "done")).select("file_id")
    out = files.filter("deleted_at IS NULL").join(done, "file_id", "left_anti").orderBy("file_id")
    return out.limit(limit) if limit else out


def snapshot_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, change): created, modified (mtime or size differ) or deleted."""
    b, a = before.select("path", F.col("mtime").alias("m0"), F.col("size").alias("s0")), after.select("path", F.col("mtime").alias("m1"), F.col("size").alias("s1"))
    change = F.when(F.col("m0").isNull(), "created").when(F.col("m1").isNull(), "deleted").when((F.col("m0") != F.col("m1")) | (F.col("s0") != F.col("s1")), "modified")
    return b.join(a, "path", "full_outer").select("path", change.alias("change")).filter("change IS NOT NULL")


def write_vectors(current: DataFrame, incoming: DataFrame, dimension: int) -> DataFrame:
    """Vectors by chunk_id, incoming ones in place of old ones; one of another length is an error."""
    checked = incoming.filter(F.assert_true(F.size("embedding") == dimension, F.lit(f"vectors must have {dimension} components")).isNull())
    return current.join(incoming.select("chunk_id"), "chunk_id", "left_anti").unionByName(checked)


def record_status(ledger: DataFrame, rows: DataFrame) -> DataFrame:
    return upsert(ledger, rows, ["file_id", "pass_name"])
