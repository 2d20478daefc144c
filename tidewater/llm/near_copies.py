"""Near copies by the Jaccard similarity of word shingles: SimHash and multi-index hashing choose candidates, whole shingle
sets decide.

A node is a distinct text. Its fingerprint is SimHash over its distinct shingles, the one of op3 with more bits
(simhash.wide): two texts of similarity 0.8 differ in some 15 % of the bits, where 4 of 64 bits are 6 %. It is cut into
segments, and a node stands in one table for each segment. Nodes that stand under the same value are compared over KEPT x 64
bits; those within a radius (``radius``) make groups, and those of a group within the radius of all bits make smaller ones.

Segments get longer with the number of texts, so that about a hundred stand under a value, and more in number (``tables``), so
that a pair at exactly 0.8 shares none, or lies beyond a radius, with a computed probability of 3 in a million, less above.
That holds for FLIP, the largest share of differing bits of two sets of any sizes but one: where a set of 4 shingles lies in
one of 5, ties make it more. So a text of 5 shingles also stands under its subsets of 4.

Candidates only make groups. Within a group, every pair of texts is compared by all its shingles, in integers; so no pair
below the similarity links, and none is left out because another one has linked its texts. Values and groups that very
many texts share are cut into blocks (graph.deal). Components of the links are the near copies.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log, log1p, sqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, as_bytes, batch_of, ranges, release, slices
from .graph import components, deal, spanning
from .simhash import segments, shingle_hashes, wide

#: Words of a shingle; least similarity as a fraction.
WORDS, LEAST = 5, (4, 5)
#: Share of the bits in which two sets of that similarity differ, at most; probability that such a pair shares no segment.
FLIP, MISS = 0.1612, 2e-6
#: Words of a fingerprint that tables hold; segments whose tables are made at a time.
KEPT, TABLES = 4, 32
#: Texts of a value that a task compares, rows of a bin; texts of a group, bytes of shingles of a bin.
BLOCK, BIN = 8192, 100_000
GROUP_BLOCK, GROUP_BIN = 512, 8 << 20
#: Pairs compared and columns multiplied at a time.
PAIRS, WIDTH = 1 << 17, 2048


def node_of(text: str) -> Column:
    """The number of a text; null as empty."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def shingle_set(text: bytes) -> np.ndarray:
    """Sorted distinct shingles."""
    return np.unique(np.array(shingle_hashes(text, WORDS), np.uint64))


def tables(texts: int) -> tuple[int, int]:
    """Bits of a segment and number of segments for so many texts."""
    bits = max(8, texts.bit_length() - 7)
    return bits, ceil(log(MISS) / log1p(-((1 - FLIP) ** bits)))


def radius(words: int) -> int:
    """Differing bits of candidates: 5.25 standard deviations above the mean of a pair of that similarity (of 4 words: 4 in ten million are beyond)."""
    bits = 64 * words
    return int(FLIP * bits + 5.25 * sqrt(bits * FLIP * (1 - FLIP)))


def fingerprints(docs: DataFrame, words: int) -> DataFrame:
    """node and fp (``words`` x 8 bytes) of every row with node and text that has shingles, and of each four where it has five."""
    schema = pa.schema([("node", pa.int64()), ("fp", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            nodes, sets = [], []
            for node, text in zip(batch.column("node").to_pylist(), as_bytes(batch.column("text"))):
                own = shingle_set(text)
                own = [own] * bool(len(own)) + [np.delete(own, k) for k in range(5) if len(own) == 5]
                nodes += [node] * len(own)
                sets += own
            yield batch_of(schema, nodes, [x.tobytes() for x in wide(sets, words)])

    return docs.select("node", "text").mapInArrow(run, "node long, fp binary")


def words_of(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Fingerprints of equal length as rows of words."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(len(column), -1)


def lookups(nodes: DataFrame, bits: int, first: int, end: int) -> DataFrame:
    """key (segment and value), id and fp (KEPT words) of every node in the tables from ``first`` to ``end``."""
    schema = pa.schema([("key", pa.int64()), ("id", pa.int64()), ("fp", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                values, kept = segments(words_of(batch.column("fp")), bits, end), pc.binary_slice(batch.column("fp"), 0, 8 * KEPT)
                for t in range(first, end):
                    yield batch_of(schema, values[:, t] | t << 40, batch.column("node"), kept)

    return nodes.select("node", "fp").mapInArrow(run, "key long, id long, fp binary")


def stars(a: list[np.ndarray], b: list[np.ndarray]) -> pa.Table:
    none = [np.zeros(0, np.int64)]
    x, y = np.concatenate(none + a), np.concatenate(none + b)
    x, y = spanning(x, y) if len(x) else (x, y)
    return pa.table({"a": pa.array(x, pa.int64()), "b": pa.array(y, pa.int64())})


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Differing bits of each of x and each of y."""
    out = np.zeros((len(x), len(y)), np.uint16)
    for p, q in zip(x.T, y.T):
        out += np.bitwise_count(p[:, None] ^ q[None, :])
    return out


def candidates(table: pa.Table) -> pa.Table:
    """A forest that connects all pairs of a cell whose fingerprints are within the radius."""
    release()
    cell, node = (table.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in ("cell", "id"))
    order = np.argsort(cell, kind="stable")
    cell, node, fps = cell[order], node[order], words_of(table.column("fp"))[order]
    most = radius(fps.shape[1])
    a: list[np.ndarray] = []
    b: list[np.ndarray] = []
    edges = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1], True]).tolist()
    for s, e in zip(edges, edges[1:]):
        if e - s < 2:
            continue
        own, fp = node[s:e], fps[s:e]
        # those like the first one are connected; each of the others is compared with all
        like = distances(fp[:1], fp)[0] <= most
        if (own[like] != own[0]).any():
            a.append(own[like])
            b.append(np.full(len(a[-1]), own[0]))
        rest = np.flatnonzero(~like)
        step = max(1, PAIRS // (e - s))
        for part in (rest[k : k + step] for k in range(0, len(rest), step)):
            x, y = np.nonzero(distances(fp[part], fp) <= most)
            x, y = own[part[x]], own[y]
            x, y = x[x != y], y[x != y]
            if len(x):
                x, y = spanning(x, y)
                a.append(x)
                b.append(y)
    return stars(a, b)


def common(sets: list[np.ndarray]) -> np.ndarray:
    """How many shingles each two of the sets share."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, at, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    column, twice = np.cumsum(count > 1) - 1, count[at] > 1
    at, owner = column[at[twice]], owner[twice]
    order = np.argsort(at, kind="stable")
    at, owner = at[order], owner[order]
    out = np.zeros((len(sets), len(sets)), np.int64)
    for s in range(0, int((count > 1).sum()), WIDTH):
        p, q = np.searchsorted(at, [s, s + WIDTH])
        m = np.zeros((len(sets), WIDTH), np.float32)
        m[owner[p:q], at[p:q] - s] = 1
        out += (m @ m.T).astype(np.int64)
    np.fill_diagonal(out, [len(s) for s in sets])
    return out


def links(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of sets of at least the similarity."""
    size = np.array([len(s) for s in sets])
    both = common(sets)
    union = size[:, None] + size[None, :] - both
    return np.nonzero(np.triu((both * LEAST[1] >= union * LEAST[0]) & (union > 0), 1))


def decide(table: pa.Table) -> pa.Table:
    """A forest of the links within each cell, by whole sets."""
    release()
    cell, node = (table.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in ("cell", "id"))
    sets = [np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()]
    order = np.argsort(cell, kind="stable")
    a, b = [], []
    for part in np.split(order, np.flatnonzero(np.diff(cell[order])) + 1):
        _, once = np.unique(node[part], return_index=True)  # in a block's cell with itself a text is home and guest
        part = part[once]
        if len(part) > 1:
            p, q = links([sets[i] for i in part.tolist()])
            a.append(node[part[p]])
            b.append(node[part[q]])
    return stars(a, b)


def cells(rows: DataFrame, sizes: DataFrame, block: int, bins: int, scratch: Scratch) -> DataFrame:
    """rows (key, id and more) with ``bin`` and ``cell``: any two rows of a key meet in a cell. sizes: key and n."""
    hot = scratch.write(sizes.filter(F.col("n") > block).select("key", F.col("n").alias("homes"), F.col("n").alias("guests")), "hot")
    homes = rows.withColumn("home", F.lit(True))
    if hot.isEmpty():
        dealt = deal(homes, None, block)
    else:
        dealt = deal(homes.unionByName(rows.join(hot.select("key"), "key", "left_semi").withColumn("home", F.lit(False))), hot, block)
    return dealt.withColumn("bin", F.pmod("cell", F.lit(bins)).cast("int"))


def groups(docs: DataFrame) -> DataFrame:
    """node and component of the texts that have near copies; docs has node (node_of) and text."""
    scratch = Scratch(docs.sparkSession, "near-copies")
    bits, n = tables(docs.count())
    words = max(KEPT, -(-n * bits // 64))
    nodes = scratch.write(fingerprints(docs, words).distinct(), "fingerprints")
    count, near = nodes.count(), None

    def within(rows: DataFrame, size: int) -> DataFrame:
        held = cells(rows, rows.groupBy("key").agg(F.count("*").alias("n")), BLOCK, max(1, -(-size // BIN)), scratch)
        return scratch.write(held.select("bin", "cell", "id", "fp").groupBy("bin").applyInArrow(candidates, "a long, b long"), "near")

    for first in range(0, n, TABLES):
        end = min(n, first + TABLES)
        found = within(lookups(nodes, bits, first, end), count * (end - first))
        near = near.unionByName(found) if near else found
        scratch.clear()  # of each round's shuffle
    maybe = scratch.write(components(near, scratch), "groups")
    rows = scratch.write(nodes.join(maybe, "node").select(F.col("component").alias("key"), F.col("node").alias("id"), "fp"), "grouped")
    maybe = scratch.write(components(within(rows, rows.count() * words // KEPT), scratch), "candidates")
    scratch.clear()

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([shingle_set(x).tobytes() for x in as_bytes(batch.column("text"))], pa.binary())], names=["node", "shingles"])

    texts = docs.select("node", "text").join(maybe.select("node"), "node", "left_semi")
    sets = texts.mapInArrow(whole, "node long, shingles binary").groupBy("node").agg(F.first("shingles").alias("shingles"))
    sets = scratch.write(sets.join(maybe, "node").select(F.col("component").alias("key"), F.col("node").alias("id"), "shingles"), "sets")
    size = sets.agg(F.sum(F.octet_length("shingles"))).first()[0] or 0
    sizes = sets.groupBy("key").agg(F.count("*").alias("n"))
    rows = cells(sets, sizes, GROUP_BLOCK, max(1, -(-size // GROUP_BIN)), scratch)
    found = rows.select("bin", "cell", "id", "shingles").groupBy("bin").applyInArrow(decide, "a long, b long")
    return components(found, scratch)
