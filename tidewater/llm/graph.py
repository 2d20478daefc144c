"""Groups of linked rows: blocks of large groups, spanning forests inside a task, components across the cluster."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stars (node, smallest node that it can reach) of the links; at most one for each node, none for the smallest."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    star = label != np.arange(len(nodes))
    return nodes[star], nodes[label[star]]


def deal(rows: DataFrame, sizes: DataFrame | None, block: int) -> DataFrame:
    """Adds ``cell``: every home row of a key meets every guest row of the key in exactly one cell.

    rows: key, home (boolean) and more. sizes: key, homes, guests of the keys that may be too large for one task; the
    other keys are a cell each. A large key's rows are cut into blocks of about ``block``, and there is a cell for each
    pair of a home block and a guest block. Rows are repeated as often as the other side has blocks, never paired here.
    """
    if sizes is None:
        return rows.withColumn("cell", F.xxhash64("key"))
    n = F.ceil(F.col("homes") / block).cast("int"), F.ceil(F.col("guests") / block).cast("int")
    dealt = rows.join(sizes.select("key", F.greatest(n[0], F.lit(1)).alias("nh"), F.greatest(n[1], F.lit(1)).alias("ng")), "key", "left")
    nh, ng = F.coalesce("nh", F.lit(1)), F.coalesce("ng", F.lit(1))
    own = F.pmod(F.xxhash64("id"), F.when(F.col("home"), nh).otherwise(ng))
    other = F.explode(F.sequence(F.lit(0), F.when(F.col("home"), ng).otherwise(nh) - 1))
    dealt = dealt.withColumn("own", own).withColumn("other", other)
    h, g = F.when(F.col("home"), F.col("own")).otherwise(F.col("other")), F.when(F.col("home"), F.col("other")).otherwise(F.col("own"))
    return dealt.withColumn("cell", F.when(F.col("nh").isNull(), F.xxhash64("key")).otherwise(F.xxhash64("key", h, g))).drop("nh", "ng", "own", "other")


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) of all nodes of the edges (a, b); a component is named by its smallest node.

    Large-star and small-star steps in turn, each round a table, until every edge leads to the smallest node. Minima are
    combined before each shuffle, and the joins with them can be split where a node has very many edges.
    """
    e = scratch.write(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    seen = None
    while True:
        mark = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            break
        seen = mark
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = scratch.write(both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        new = scratch.write(small.distinct(), "edges")
        scratch.drop(large)
        scratch.drop(e)
        e = new
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
