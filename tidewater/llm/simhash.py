"""SimHash near-dedup by multi-index hashing.

A fingerprint is the bitwise majority of the XXH64 hashes (seed 42) of a text's word shingles. Equal fingerprints are
one node. A node stands in one table for each segment of its fingerprint. With three segments, two fingerprints within 4 bits
agree within 1 bit in the first or the second, or in the third exactly (else they would differ in 2 + 2 + 1 bits); with
two, within 2 bits in the first or 1 in the second. So each node looks up the Hamming balls around its segments, and every match is verified over all 64
bits. Segment values that very many nodes share are cut into blocks (graph.deal); a task gives a spanning forest of the
links that it finds, not the pairs.

Where similarities far below those of 4 bits count, ``wide`` gives fingerprints of many more bits, whose first 64 are those
above, and ``segments`` the values under which they stand (near_copies).

Null and empty texts have fingerprint zero and link like any other. A row with null doc_id gets a fingerprint and a
null component; rows that repeat a doc_id are one document, whose texts all link.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations, zip_longest

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import Scratch, as_bytes, batch_of, ranges, read, slices
from .graph import components, deal, spanning
from .sharing import mix

WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
SEED = 42
BITS = 4
Segments = tuple[tuple[int, int, int], ...]
#: (first bit, bits, radius) of each segment; the balls together cover all pairs within BITS. Three short segments make 45
#: look-ups and few matches while values are sparse; for more nodes than SPARSE, two long ones make 562 and fewer matches.
THREE: Segments = ((0, 21, 1), (21, 21, 1), (42, 22, 0))
TWO: Segments = ((0, 32, 2), (32, 32, 1))
SPARSE = 1 << 24
#: Nodes of one segment value that a task holds; rows of a bin.
BLOCK, BIN = 4096, 250_000
#: Hashes whose bits are counted at a time.
AT_ONCE = 1 << 17
#: Hashes of a text, and words of several texts, that ``wide`` adds at a time.
PIECE, WORDS_AT_ONCE = 1 << 12, 1 << 17


def shingle_hashes(text: bytes, n: int) -> list[int]:
    w = WORDS.findall(text.lower())
    if len(w) <= n:
        return [xxh64_intdigest(b" ".join(w), SEED)] if w else []
    joined = b" ".join(w)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    starts = np.concatenate([[0], ends[: len(w) - n] + 1]).tolist()
    return [xxh64_intdigest(joined[s:e], SEED) for s, e in zip(starts, ends[n - 1 :].tolist())]


def majority(hashes: list[list[int]]) -> np.ndarray:
    """Fingerprints of several texts, the most significant bit first in each hash."""
    n = np.array([len(x) for x in hashes], np.int64)
    ones = np.zeros((len(hashes), 64), np.int64)
    flat = np.array([h for x in hashes for h in x], ">u8")
    owner = np.repeat(np.arange(len(hashes)), n)
    for at in range(0, len(flat), AT_ONCE):
        part, own = flat[at : at + AT_ONCE], owner[at : at + AT_ONCE]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1)
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        ones[own[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int32)
    return np.packbits(2 * ones > n[:, None], axis=1).view(">u8").ravel().astype(np.uint64)


def add(p: list[np.ndarray], q: list[np.ndarray]) -> list[np.ndarray]:
    """Sums of numbers that lie in bit planes, the least bit first: a number for each bit of the planes' words."""
    out, carry = [], None
    for a, b in zip_longest(p, q, fillvalue=np.uint64(0)):
        x, both = a ^ b, a & b
        out.append(x if carry is None else x ^ carry)
        carry = both if carry is None else both | (x & carry)
    return [*out, carry]


def wide(hashes: list[np.ndarray], words: int) -> np.ndarray:
    """Fingerprints of several texts of ``words`` x 64 bits: the majority of the hashes, then those of words - 1 mixes of them."""
    out = np.zeros((len(hashes), words), np.uint64)
    size = np.array([len(x) for x in hashes], np.int64)
    level = np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64)
    salts = mix(np.arange(words, dtype=np.uint64))
    for l in np.unique(level[size > 0]).tolist():
        alike = np.flatnonzero((level == l) & (size > 0))
        step, rows = max(1, (WORDS_AT_ONCE >> l) // words), min(1 << l, PIECE)
        for own in (alike[s : s + step] for s in range(0, len(alike), step)):
            total: list[np.ndarray] = []
            for at in range(0, 1 << l, rows):
                h = np.zeros((rows, len(own)), np.uint64)
                for j, i in enumerate(own.tolist()):
                    part = hashes[i][at : at + rows]
                    h[: len(part), j] = part
                x = mix(h[:, :, None] ^ salts)
                x[:, :, 0] = h
                x[np.arange(rows)[:, None] >= size[own] - at] = 0
                planes = [x]
                for half in (rows >> k for k in range(1, l + 1) if rows >> k):
                    planes = add([p[:half] for p in planes], [p[half:] for p in planes])
                planes = [p[0] for p in planes]
                total = add(total, planes)[: l + 1] if total else planes
            more, same = np.zeros_like(total[0]), ~np.zeros_like(total[0])
            for k in range(len(total) - 1, -1, -1):  # above half of the hashes
                bit = -((size[own] // 2 >> k & 1).astype(np.uint64))[:, None]
                more |= same & total[k] & ~bit
                same &= ~(total[k] ^ bit)
            out[own] = more
    return out


def segments(fps: np.ndarray, bits: int, most: int) -> np.ndarray:
    """Values of the segments of ``bits`` bits each, at most ``most``, of wide fingerprints."""
    flat = np.unpackbits(fps.astype(">u8").view(np.uint8).reshape(len(fps), -1), axis=1)
    n = min(most, flat.shape[1] // bits)
    return flat[:, : n * bits].reshape(len(fps), n, bits) @ (1 << np.arange(bits, dtype=np.int64))


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """doc_id and fp (the fingerprint's 64 bits as a long) of every row."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            fps = majority([shingle_hashes(x, shingle) for x in as_bytes(batch.column("text"))])
            yield batch_of(schema, batch.column("doc_id"), fps.view(np.int64))

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


@lru_cache(maxsize=8)
def flips(bits: int, radius: int) -> list[np.uint64]:
    """What turns a value into those of its ball, itself first."""
    return [np.uint64(sum(1 << j for j in own)) for r in range(radius + 1) for own in combinations(range(bits), r)]


def balls(fps: np.ndarray, segments: Segments) -> Iterator[tuple[bool, np.ndarray]]:
    """Keys (segment and value) under which fingerprints stand (True) and which they look up (False)."""
    for k, (first, bits, radius) in enumerate(segments):
        value = (fps >> np.uint64(first)) & np.uint64((1 << bits) - 1) | np.uint64(k << 40)
        yield True, value
        for flip in flips(bits, radius):
            yield False, value ^ flip


def lookups(nodes: DataFrame, segments: Segments, homes_only: bool = False) -> DataFrame:
    """key, home, id, fp: where the nodes stand and what they look up."""
    schema = pa.schema([("key", pa.int64()), ("home", pa.bool_()), ("id", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            for home, keys in balls(fps, segments):
                if home or not homes_only:
                    yield batch_of(schema, keys.view(np.int64), np.full(len(keys), home), batch.column("node"), batch.column("fp"))

    return nodes.select("node", "fp").mapInArrow(run, "key long, home boolean, id long, fp long")


def hot_keys(nodes: DataFrame, segments: Segments, scratch: Scratch) -> DataFrame | None:
    """key, homes, guests of the segment values that many nodes stand under, and of those in their balls; none if there are none."""
    full = scratch.write(lookups(nodes, segments, homes_only=True).groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > BLOCK), "hot")
    if full.isEmpty():
        return None
    schema = pa.schema([("key", pa.int64()), ("n", pa.int64())])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "n"))
            for k, (_, bits, radius) in enumerate(segments):
                own = keys >> 40 == k
                for flip in flips(bits, radius):
                    yield batch_of(schema, (keys[own].view(np.uint64) ^ flip).view(np.int64), n[own])

    guests = full.mapInArrow(spread, "key long, n long").groupBy("key").agg(F.sum("n").alias("guests"))
    rest = BLOCK * max(len(flips(bits, radius)) for _, bits, radius in segments)  # of values that are not hot themselves
    return scratch.write(guests.join(full, "key", "left").select("key", F.coalesce("n", F.lit(BLOCK)).alias("homes"), (F.col("guests") + rest).alias("guests")), "hot")


def compare(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links within the cells of a bin."""
    get = lambda c: table.column(c).combine_chunks().to_numpy(zero_copy_only=False)
    cell, home, node, fp = get("cell"), get("home").astype(bool), get("id"), get("fp").view(np.uint64)
    order = np.lexsort((~home, cell))
    cell, home, node, fp = cell[order], home[order], node[order], fp[order]
    h = np.flatnonzero(home)
    if not len(h) or len(h) == len(home):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    hc, first, count = np.unique(cell[h], return_index=True, return_counts=True)
    g = np.flatnonzero(~home)
    slot = np.searchsorted(hc, cell[g])
    slot[slot == len(hc)] = 0
    g, slot = g[hc[slot] == cell[g]], slot[hc[slot] == cell[g]]
    n = count[slot]
    done, a, b = 0, [], []
    total = np.cumsum(n)
    while done < len(g):
        to = max(done + 1, int(np.searchsorted(total, (total[done - 1] if done else 0) + (1 << 21))))
        x = np.repeat(g[done:to], n[done:to])
        y = h[ranges(first[slot[done:to]], n[done:to])]
        ok = (node[x] != node[y]) & (np.bitwise_count(fp[x] ^ fp[y]) <= BITS)
        if ok.any():
            p, q = spanning(node[x[ok]], node[y[ok]])
            a.append(p)
            b.append(q)
        done = to
    if not a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return spanning(np.concatenate(a), np.concatenate(b))


def link(docs: DataFrame, shingle: int = 4, segments: Segments | None = None) -> DataFrame:
    """doc_id, fp and component_id of every row."""
    scratch = Scratch(docs.sparkSession, "simhash")
    fps = scratch.write(fingerprints(docs, shingle), "fingerprints")
    nodes = scratch.write(fps.filter("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("node")), "nodes")
    n = nodes.count()
    segments = segments or (THREE if n <= SPARSE else TWO)
    rows = deal(lookups(nodes, segments), hot_keys(nodes, segments, scratch), BLOCK)
    bins = max(1, -(-n * sum(1 + len(flips(bits, radius)) for _, bits, radius in segments) // BIN))

    def run(table):
        a, b = compare(table)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    edges = rows.withColumn("bin", F.pmod("cell", F.lit(bins)).cast("int")).select("bin", "cell", "home", "id", "fp").groupBy("bin").applyInArrow(run, "a long, b long")
    found = components(edges, scratch)
    named = nodes.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return fps.join(named, "fp", "left").select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(read(spark, sf_dir, "documents")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
