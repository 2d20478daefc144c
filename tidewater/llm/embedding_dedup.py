"""Embedding near-dedup: spherical k-means cells, blocked cosine products within cells, one vector kept of each group.

Only vectors of the same label are compared. Equal vectors of a label are one node with a weight. A node is at home in the
cell of its nearest centroid, and a guest in its own cell and in near ones. With cos(x, y) >= t, |x - y| is at most
r = sqrt(2 - 2 t). If x is at home with centroid o and y with centroid c, then (o - c) x >= 0 >= (o - c) y, and the two
differ by at most r |o - c|: one of them lies within half of that of the plane between the cells, and is a guest in the
other's cell. Homes times guests thus finds every link; one between cells that is found in both counts in the first.

Centroids are fitted on at most ``sample`` rows, the ones with the smallest hashes; every row is placed. Cells with very
many homes or guests are cut into blocks (graph.deal). Tasks give each node's number of links and a spanning forest.

Vectors that are null, empty, zero or hold null or non-finite components, and those with null label, link with nothing. A
row with null vec_id links with nothing and is kept, its component is null. Rows that repeat a vec_id with the same
vector are one vector; each comes out. Rows that repeat a vec_id with other vectors (or labels) have one component, so
that their groups are one; n_links counts for each row the other vectors, by vec_id and components, that its own links to.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, batch_of, read
from .graph import components, deal, spanning

#: Rows that k-means is fitted on; nodes for each cell aimed at, and cells at most; rows of a large cell's block, rows of a bin.
#: Fewer and larger cells make fewer guests (3.6 a node with 10 cells of the check's vectors, 10.6 with 200), products are cheap.
SAMPLE, PER_CELL, CELLS, BLOCK, BIN = 65_536, 2000, 16_384, 16_384, 20_000
#: Rows of a product, and rows that are placed at a time.
TILE, AT_ONCE = 2048, 256
ROUNDS = 8


def unit(vectors: list | np.ndarray) -> np.ndarray:
    x = np.asarray(vectors, np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # else squares of tiny or huge components are lost
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def prepare(vectors: DataFrame) -> DataFrame:
    """vec_id, vkey (label and components, hashed to 128 bits; null for what links with nothing), label, embedding."""
    schema = pa.schema([("vec_id", pa.int64()), ("vkey", pa.binary()), ("label", pa.string()), ("embedding", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, rows = [], []
            for i, label, v in zip(batch.column("vec_id").to_pylist(), batch.column("label").to_pylist(), batch.column("embedding").to_pylist()):
                good = i is not None and label is not None and v and None not in v
                a = np.asarray(v, np.float64) + 0.0 if good else None  # -0.0 becomes 0.0
                if good and np.isfinite(a).all() and a.any():
                    keys.append(xxhash.xxh3_128_digest(label.encode() + b"\0" + a.tobytes()))
                    rows.append(a)
                else:
                    keys.append(None)
                    rows.append(None)
            yield batch_of(schema, batch.column("vec_id"), keys, batch.column("label"), rows)

    cols = vectors["vec_id"].cast("long").alias("vec_id"), vectors["label"].cast("string").alias("label"), vectors["embedding"].cast("array<double>").alias("embedding")
    return vectors.select(*cols).mapInArrow(run, "vec_id long, vkey binary, label string, embedding array<double>")


def fit(nodes: DataFrame, k: int, sample: int) -> dict[int, np.ndarray]:
    """Centroids for each dimension that occurs in the sample, by spherical k-means."""
    rows = nodes.select("embedding").orderBy(F.xxhash64("vkey"), "vkey").limit(sample).collect()
    by: dict[int, list] = {}
    for r in rows:
        by.setdefault(len(r.embedding), []).append(r.embedding)
    out = {}
    for d, own in by.items():
        x = unit(own)
        c = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)]
        for _ in range(ROUNDS):
            near = np.concatenate([np.argmax(x[a : a + TILE] @ c.T, axis=1) for a in range(0, len(x), TILE)])
            new = np.zeros_like(c)
            np.add.at(new, near, x)
            length = np.sqrt((new * new).sum(axis=1))
            c = np.where(length[:, None] > 1e-12, new / np.maximum(length, 1e-12)[:, None], c)
        out[d] = np.unique(c, axis=0)
    return out


def place(nodes: DataFrame, centroids: dict[int, np.ndarray], threshold: float) -> DataFrame:
    """key (label, dimension and cell), home, id, weight, embedding (of length one), at (the home cell): once at home, with ``also``, the
    other cells it is a guest in, and for each cell a guest is in."""
    cast = nodes.sparkSession.sparkContext.broadcast(centroids)  # at most CELLS for each dimension
    reach = np.sqrt(2 - 2 * threshold) + 1e-9
    schema = pa.schema([("key", pa.int64()), ("home", pa.bool_()), ("id", pa.int64()), ("weight", pa.int64()), ("embedding", pa.list_(pa.float64())), ("at", pa.int32()), ("also", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(s, AT_ONCE) for s in range(0, whole.num_rows, AT_ONCE)):
                label, node, weight, vectors = (batch.column(c).to_pylist() for c in ("label", "node", "weight", "embedding"))
                size = np.array([len(v) for v in vectors])
                for d in np.unique(size).tolist():
                    own = np.flatnonzero(size == d)
                    x = unit([vectors[i] for i in own])
                    c = cast.value.get(d, np.zeros((1, d)))
                    score = x @ c.T
                    home = np.argmax(score, axis=1)
                    gap = score[np.arange(len(own)), home][:, None] - score
                    apart = np.sqrt(np.maximum(0, 2 - 2 * c[home] @ c.T))
                    apart[np.arange(len(own)), home] = 0
                    guest = gap <= reach / 2 * apart + 1e-12
                    row, cell = np.nonzero(guest)
                    key = lambda i, c: xxhash.xxh64_intdigest(f"{d} {c} {label[own[i]]}".encode()) - (1 << 63)  # noqa: B023, E731
                    also = [[c for c in part if c != o] for part, o in zip(map(np.ndarray.tolist, np.split(cell, np.flatnonzero(np.diff(row)) + 1)), home.tolist())]
                    for is_home, rows, cells in ((True, np.arange(len(own)), home), (False, row, cell)):
                        yield batch_of(schema, [key(i, c) for i, c in zip(rows.tolist(), cells.tolist())], [is_home] * len(rows), [node[own[i]] for i in rows], [weight[own[i]] for i in rows], list(x[rows]), home[rows], also if is_home else [None] * len(rows))

    return nodes.select("label", "node", "weight", "embedding").mapInArrow(run, "key long, home boolean, id long, weight long, embedding array<double>, at int, also array<int>")


def products(table: pa.Table, threshold: float) -> tuple[list, list, list]:
    """Of a bin's cells: (node, null, weight of its links) rows and (node, smaller node, null) rows."""
    get = lambda c: table.column(c).combine_chunks().to_numpy(zero_copy_only=False)
    cell, home, node, weight = get("cell"), get("home").astype(bool), get("id"), get("weight")
    flat = table.column("embedding").combine_chunks()
    start, values = flat.offsets.to_numpy(), flat.values.to_numpy(zero_copy_only=False)
    near, at_cell = table.column("also").combine_chunks(), get("at").astype(np.int64)
    others = pc.list_value_length(near).fill_null(0).to_numpy(zero_copy_only=False)
    pairs = np.repeat(np.arange(len(near)), others) * (1 << 20) + near.flatten().to_numpy(zero_copy_only=False)  # a row and a cell it is a guest in
    vectors = lambda i: np.stack([values[start[j] : start[j + 1]] for j in i])
    a, b, n = [], [], []
    order = np.argsort(cell, kind="stable")
    for own in np.split(order, np.flatnonzero(np.diff(cell[order])) + 1):
        h, g = own[home[own]], own[~home[own]]
        if not len(h) or not len(g):
            continue
        y = vectors(g)
        for at in range(0, len(h), TILE):
            part = h[at : at + TILE]
            x = vectors(part)
            sums, p, q = np.zeros(len(part), np.int64), [], []
            for to in range(0, len(g), TILE):
                i, j = np.nonzero(x @ y[to : to + TILE].T >= threshold)
                j += to
                other = node[part[i]] != node[g[j]]
                i, j = i[other], j[other]
                here, there = at_cell[part[i]], at_cell[g[j]]
                apart = here != there
                counts = ~apart | (here < there) | ~np.isin(part[i] * (1 << 20) + there, pairs)
                np.add.at(sums, i[counts], weight[g[j[counts]]])
                both = counts & apart
                who, which = np.unique(node[g[j[both]]], return_inverse=True)
                a += who.tolist()
                b += [None] * len(who)
                n += np.bincount(which, weight[part[i[both]]], len(who)).astype(np.int64).tolist() if len(who) else []
                s, t = spanning(node[part[i]], node[g[j]]) if len(i) else ([], [])
                p += list(s)
                q += list(t)
            hit = sums > 0
            a += [*node[part[hit]].tolist(), *p]
            b += [None] * int(hit.sum()) + q
            n += [*sums[hit].tolist(), *[None] * len(p)]
    return a, b, n


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, sample: int = SAMPLE) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row."""
    scratch = Scratch(vectors.sparkSession, "embeddings")
    rows = scratch.write(prepare(vectors), "rows")
    nodes = rows.filter("vkey IS NOT NULL").groupBy("vkey").agg(F.min("vec_id").alias("node"), F.count_distinct("vec_id").alias("weight"), F.first("label").alias("label"), F.first("embedding").alias("embedding"))
    nodes = scratch.write(nodes, "nodes")
    n = nodes.count()
    placed = scratch.write(place(nodes, fit(nodes, min(CELLS, max(1, n // PER_CELL)), sample), threshold), "placed")
    sizes = placed.groupBy("key").agg(F.sum(F.col("home").cast("long")).alias("homes"), F.sum((~F.col("home")).cast("long")).alias("guests")).filter((F.col("homes") > BLOCK) | (F.col("guests") > BLOCK))
    bins = max(1, placed.count() // BIN)

    def run(table):
        a, b, n = products(table, threshold)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "n": pa.array(n, pa.int64())})

    dealt = deal(placed, scratch.write(sizes, "sizes"), BLOCK).withColumn("bin", F.pmod("cell", F.lit(bins)).cast("int"))
    found = scratch.write(dealt.select("bin", "cell", "home", "id", "weight", "embedding", "at", "also").groupBy("bin").applyInArrow(run, "a long, b long, n long"), "found")
    links = found.filter("n IS NOT NULL").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    ids = rows.filter("vkey IS NOT NULL").select("vec_id", "vkey").distinct()
    several = ids.groupBy("vec_id").agg(F.count("*").alias("n")).filter("n > 1").select("vec_id")  # ids of more than one vector tie their nodes together
    ties = ids.join(several, "vec_id").join(nodes.select("vkey", "node"), "vkey").select(F.col("node").alias("a"), F.col("vec_id").alias("b"))
    groups = components(found.filter("n IS NULL").select("a", "b").unionByName(ties), scratch)
    named = nodes.join(links, "node", "left").join(groups, "node", "left").select("vkey", (F.col("weight") - 1 + F.coalesce("n", F.lit(0))).cast("long").alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    good = rows.filter("vkey IS NOT NULL").select("vec_id", "vkey").join(named, "vkey").select("vec_id", "n_links", "component_id")
    bad = rows.filter("vkey IS NULL").select("vec_id")
    known = good.join(bad.distinct(), "vec_id", "left_semi").groupBy("vec_id").agg(F.min("component_id").alias("c"))
    lone = bad.join(known, "vec_id", "left").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.coalesce("c", "vec_id").alias("component_id"))
    return good.unionByName(lone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "embeddings"))


OP1_SQL = """
WITH RECURSIVE valid AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
pairs AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM valid a JOIN valid b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.98
),
reach(a, b) AS (SELECT a, b FROM pairs UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON r.b = p.a),
low AS (SELECT a, min(b) AS c FROM reach GROUP BY a),
n AS (SELECT a, count(DISTINCT b) AS n FROM pairs GROUP BY a)
SELECT e.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, least(e.vec_id, coalesce(low.c, e.vec_id)) AS component_id,
       coalesce(e.vec_id = least(e.vec_id, coalesce(low.c, e.vec_id)), true) AS kept
FROM embeddings e LEFT JOIN low ON e.vec_id = low.a LEFT JOIN n ON e.vec_id = n.a
"""
