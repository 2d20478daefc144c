"""Status, health and failures of an index; retrieval quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import SCHEMA_VERSION

VISIBLE = ("structural", "chunker", "embeddings")


def status_counts(files: DataFrame, nodes: DataFrame, ledger: DataFrame) -> DataFrame:
    """(key, n): live files, indexed files, done rows of each pass, and failed or skipped rows where there are any."""
    live = files.filter("deleted_at IS NULL").agg(F.count("*").alias("n")).select(F.lit("files").alias("key"), "n")
    indexed = nodes.filter("deleted_at IS NULL").agg(F.count_distinct("file_id").alias("n")).select(F.lit("indexed").alias("key"), "n")
    by = ledger.filter(F.col("status").isin("done", "failed", "skipped")).groupBy("pass_name", "status").agg(F.count("*").alias("n"))
    return live.unionByName(indexed).unionByName(by.select(F.concat_ws("_", "pass_name", "status").alias("key"), "n"))


def failure_histogram(ledger: DataFrame, top: int = 3, width: int = 80) -> DataFrame:
    """The most frequent beginnings of error messages."""
    p = F.substring("error_message", 1, width)
    return ledger.filter("status = 'failed'").groupBy(p.alias("prefix")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "prefix").limit(top)


def failure_rate(ledger: DataFrame) -> DataFrame:
    """One row: failed over attempted files, and how grave that is."""
    by_file = ledger.groupBy("file_id").agg(F.max((F.col("status") == "failed").cast("int")).alias("failed"))
    row = by_file.agg(F.sum("failed").cast("long").alias("failed"), F.count("*").alias("attempted"))
    rate = F.col("failed") / F.col("attempted")
    return row.select("failed", "attempted", rate.alias("rate"), F.when(rate > 0.1, "ERROR").when(rate > 0.01, "WARN").otherwise("INFO").alias("severity"))


def health(files: DataFrame, nodes: DataFrame, chunks: DataFrame, embeddings: DataFrame) -> DataFrame:
    """(check, broken): rows that refer to nothing."""
    pairs = (("nodes without file", nodes, files, "file_id"), ("chunks without node", chunks, nodes, "node_id"), ("vectors without chunk", embeddings, chunks, "chunk_id"))
    out = None
    for name, child, parent, key in pairs:
        row = child.join(parent.select(key), key, "left_anti").agg(F.count("*").alias("broken")).select(F.lit(name).alias("check"), "broken")
        out = row if out is None else out.unionByName(row)
    return out


def capabilities() -> dict:
    return {"server_version": "0.1", "wire_version": 3, "schema_version": SCHEMA_VERSION, "semantics_version": 1, "features": ["fts", "vector", "filename", "metadata", "browse", "batch"]}


def audit_recent(audit: DataFrame, n: int = 100) -> DataFrame:
    return audit.orderBy(F.desc("id")).limit(n)


def retrieval_quality(hits: DataFrame, judgments: DataFrame, k: int = 10) -> DataFrame:
    """(mode, query_id, recall, ndcg_ref, ndcg) of queries with a relevant judgment.

    hits: mode, query_id, rank (from 0), path. judgments: query_id, path, grade. A hit is relevant by the highest grade of the
    judged paths that its own path contains. ndcg_ref lets each hit of a judged path gain; ndcg counts a path once.
    """
    top = hits.filter(F.col("rank") < k)
    good = judgments.filter("grade > 0")
    matched = top.join(judgments.withColumnRenamed("path", "judged"), (top.query_id == judgments.query_id) & F.contains(top.path, F.col("judged"))).drop(judgments.query_id)
    gain = (F.pow(F.lit(2.0), F.col("grade")) - 1) / F.log2(F.col("rank") + F.lit(2.0))
    best = matched.groupBy("mode", "query_id", "rank").agg(F.max("grade").alias("grade"), F.max_by("judged", "grade").alias("judged"))
    once = best.withColumn("rn", F.row_number().over(Window.partitionBy("mode", "query_id", "judged").orderBy("rank")))
    dcg = once.groupBy("mode", "query_id").agg(F.sum(gain).alias("dcg_ref"), F.sum(F.when(F.col("rn") == 1, gain)).alias("dcg"), F.count_distinct(F.when(F.col("grade") > 0, F.col("judged"))).alias("found"))
    ideal_rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("grade"), "path")) - 1
    ideal = good.withColumn("rank", ideal_rank).filter(F.col("rank") < k).groupBy("query_id").agg(F.sum(gain).alias("ideal"), F.count("*").alias("capped"))
    relevant = good.groupBy("query_id").agg(F.count("*").alias("relevant"))
    asked = hits.select("mode", "query_id").distinct().join(relevant, "query_id").join(ideal, "query_id")
    out = asked.join(dcg, ["mode", "query_id"], "left")
    return out.select("mode", "query_id", (F.coalesce("found", F.lit(0)) / F.col("relevant")).alias("recall"), (F.coalesce("dcg_ref", F.lit(0.0)) / F.col("ideal")).alias("ndcg_ref"), (F.coalesce("dcg", F.lit(0.0)) / F.col("ideal")).alias("ndcg"))


def macro_average(quality: DataFrame) -> DataFrame:
    return quality.groupBy("mode").agg(F.count("*").alias("queries"), F.avg("recall").alias("recall"), F.avg("ndcg_ref").alias("ndcg_ref"), F.avg("ndcg").alias("ndcg"))
