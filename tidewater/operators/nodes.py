"""Hydration and look-up of nodes, chunks and blobs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DETAIL = {"brief": 1, "standard": 3, "full": 20}
MOST_OPERATIONS, MOST_HITS = 32, 1000


def first_chunks(chunks: DataFrame, n: int) -> DataFrame:
    """(node_id, chunks): the texts of each node's first n chunks by chunk_id. The window keeps n rows a node before the sort ends."""
    w = Window.partitionBy("node_id").orderBy("chunk_id")
    top = chunks.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= n)
    pairs = F.sort_array(F.collect_list(F.struct("rn", "text")))
    return top.groupBy("node_id").agg(F.transform(pairs, lambda x: x["text"]).alias("chunks"))


def hydrate(hits: DataFrame, nodes: DataFrame, files: DataFrame, chunks: DataFrame, per_node: int = 2) -> DataFrame:
    """Hits with node, file and first chunks; hits without a node stay.

    Hits are cut before, to a few hundred rows at most: they are evaluated once, and their ids become a filter that the
    scans of nodes and chunks can use.
    """
    rows = hits.limit(MOST_HITS).collect()
    hits = hits.sparkSession.createDataFrame(rows, hits.schema)
    own = F.col("node_id").isin(sorted({r.node_id for r in rows if r.node_id is not None}))
    named = nodes.filter(own).join(files.select("file_id", "path"), "file_id").select("node_id", "name", "node_type", F.coalesce("language", F.lit("")).alias("language"), "path")
    return hits.join(F.broadcast(named), "node_id", "left").join(F.broadcast(first_chunks(chunks.filter(own), per_node or 2)), "node_id", "left")  # a row for each hit


def get_nodes(nodes: DataFrame, files: DataFrame, ids: list[int]) -> DataFrame:
    return nodes.filter(F.col("node_id").isin(*ids)).join(files.select("file_id", "path"), "file_id").select("node_id", "path", "node_type", "name").orderBy("node_id") if ids else nodes.join(files.select("file_id", "path"), "file_id").select("node_id", "path", "node_type", "name").limit(0)


def get_chunks(chunks: DataFrame, ids: list[int]) -> DataFrame:
    return chunks.filter(F.col("chunk_id").isin(*ids)).orderBy("chunk_id") if ids else chunks.limit(0)


def get_blob(blobs: DataFrame, blob_id: int) -> dict:
    """Type and size; no bytes."""
    row = blobs.filter(F.col("blob_id") == blob_id).select("blob_id", "blob_type", "size").first()
    if row is None:
        raise KeyError(f"NOT_FOUND: blob {blob_id}")
    return {"blob_id": row.blob_id, "mime": row.blob_type, "size": row["size"]}


def inspect(nodes: DataFrame, files: DataFrame, chunks: DataFrame, node_id: int, detail: str = "brief") -> DataFrame:
    """A node with its first 1, 3 or 20 chunks."""
    return hydrate(nodes.filter(F.col("node_id") == node_id).select("node_id"), nodes, files, chunks, DETAIL.get(detail, 1))


def batch(operations: list[tuple[str, Callable[[], object]]]) -> list[dict]:
    """Runs operations in order; one that fails gives a warning in its place and doesn't stop the others."""
    if len(operations) > MOST_OPERATIONS:
        raise ValueError(f"CONTRACT_ERROR: at most {MOST_OPERATIONS} operations")
    out = []
    for name, run in operations:
        try:
            out.append({"op": name, "result": run(), "warning": None})
        except Exception as e:  # isolation is the contract
            out.append({"op": name, "result": None, "warning": f"{name}: {e}"})
    return out
