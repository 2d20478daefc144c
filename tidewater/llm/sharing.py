"""Chunks of documents that ask each other which of their hashes others hold too.

Documents are dealt by the hash of their doc_id and text into chunks of about CHUNK bytes. A chunk states each of its distinct
hashes once, packed into one blob for each bucket of the hash space; a bucket's task finds out which hashes several chunks
state, and answers each chunk with a byte for each of its hashes. However often a hash occurs, a bucket sees it once
per chunk at most. All rows of a chunk, texts and answers, meet in one group.

Exact copies are found before by the SHA-256 of whole texts, so that one text of each group of copies is compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, as_bytes, batch_of, release, slices, text_gb

#: Bytes of text in a chunk; in a slab, which is worked on at once; hashes in a bucket.
CHUNK, SLAB, BUCKET = 6 << 20, 1 << 20, 1 << 20
TEXT, COPIES, FIRST, SECOND = range(4)
ROW = pa.schema([("chunk", pa.int32()), ("kind", pa.int32()), ("bucket", pa.int32()), ("x", pa.binary()), ("y", pa.binary()), ("z", pa.binary())])
ROW_SQL = "chunk int, kind int, bucket int, x binary, y binary, z binary"

U = np.uint64
_rng = np.random.default_rng(20240229)
#: Random 64-bit names of bytes, for two independent hashes, and an odd base for each.
BYTES = _rng.integers(1, 1 << 63, (2, 256), dtype=np.uint64) * U(2) + U(1)
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit numbers without visible structure."""
    x = x ^ U((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_powers: dict[tuple[int, bool], np.ndarray] = {}


def powers(which: int, n: int, inverse: bool = False) -> np.ndarray:
    """Powers of a base, or of its inverse modulo 2^64, from 0 to n."""
    have = _powers.get((which, inverse))
    if have is None or len(have) <= n:
        base = pow(BASES[which], -1, 2**64) if inverse else BASES[which]
        have = np.ones(max(n + 1, SLAB + 1024), U)
        have[1:] = U(base)
        np.multiply.accumulate(have, out=have)
        _powers[which, inverse] = have
    return have[: n + 1]


def prefix(values: np.ndarray, which: int = 0) -> np.ndarray:
    """Prefix sums of value i times base to the power i, with a zero in front."""
    out = np.zeros(len(values) + 1, U)
    np.cumsum(values * powers(which, len(values))[:-1], out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    """Polynomial hashes of spans, the same wherever a span stands."""
    return (sums[end] - sums[start]) * powers(which, len(sums), True)[start]


def squeeze(a: np.ndarray | bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(a if isinstance(a, bytes) else a.tobytes())


def expand(b: bytes, dtype=None) -> np.ndarray | bytes:
    out = zstandard.ZstdDecompressor().decompress(b)
    return out if dtype is None else np.frombuffer(out, dtype)


def chunk_of(ids: np.ndarray, digests: list[bytes], chunks: int) -> np.ndarray:
    """By doc_id and text, so that a doc_id that very many texts have is dealt out."""
    text = np.frombuffer(b"".join(d[:8] for d in digests), U)
    return (mix(ids.view(U) ^ mix(text, 2), 1) % U(chunks)).astype(np.int32)


class Layout:
    """Numbers of chunks and buckets, in proportion to the text."""

    def __init__(self, docs: DataFrame, density: float):
        """density: hashes that a byte of text gives."""
        size = text_gb(docs) * 1e9
        self.chunks = max(1, round(size / CHUNK))
        self.buckets = max(1, round(size * density / BUCKET))


def text_rows(docs: DataFrame, chunks: int) -> DataFrame:
    """TEXT rows: ids, sizes with counts, and compressed texts of the documents that a batch has of each chunk; equal rows of a batch are one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 16 << 20):
            ids = np.array(batch.column("doc_id").to_pylist(), np.int64)
            texts = as_bytes(batch.column("text"))
            digests = [sha256(x).digest() for x in texts]
            held: dict[tuple[int, bytes], int] = {}
            for key in zip(ids.tolist(), digests):
                held[key] = held.get(key, 0) + 1
            if len(held) < len(texts):
                where = {key: i for i, key in reversed(list(enumerate(zip(ids.tolist(), digests))))}
                first = [where[key] for key in held]
                ids, texts, digests = ids[first], [texts[i] for i in first], [digests[i] for i in first]
            times = np.fromiter(held.values(), np.int64, len(held))
            own = chunk_of(ids, digests, chunks)
            order = np.argsort(own, kind="stable")
            rows: list[list] = [[] for _ in range(6)]
            for part in np.split(order, np.flatnonzero(np.diff(own[order])) + 1):
                some = [texts[i] for i in part.tolist()]
                for c, v in zip(rows, (own[part[0]], TEXT, 0, ids[part].tobytes(), np.array([[len(t) for t in some], times[part]], np.int64).tobytes(), squeeze(b"".join(some)))):
                    c.append(v)
            yield batch_of(ROW, *rows)

    return docs.filter("doc_id IS NOT NULL").select("doc_id", "text").mapInArrow(run, ROW_SQL)


def copy_rows(docs: DataFrame, chunks: int, scratch: Scratch) -> DataFrame:
    """COPIES rows: documents whose text others have too, each with the smallest doc_id that has it and the text's SHA-256."""
    hashed = scratch.write(docs.filter("doc_id IS NOT NULL").select("doc_id", F.unhex(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)).alias("h")), "hashed")
    # as a table, so that the join reads it through a shuffle and can split a text that very many documents have
    classes = scratch.write(hashed.groupBy("h").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).filter("low < high"), "classes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, low = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "low"))
            digests = batch.column("h").to_pylist()
            own = chunk_of(ids, digests, chunks)
            order = np.argsort(own, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(own[order])) + 1) if len(ids) else ():
                yield batch_of(ROW, [own[part[0]]], [COPIES], [0], [ids[part].tobytes()], [low[part].tobytes()], [b"".join(digests[i] for i in part.tolist())])

    return hashed.join(classes, "h").select("doc_id", "low", "h").mapInArrow(run, ROW_SQL)


class Chunk:
    """A chunk's documents, distinct and sorted by doc_id and text; ``times``: how many rows each is; ``low``: by doc_id and SHA-256 of copied texts, the smallest doc_id with the text."""

    def __init__(self, table: pa.Table):
        release()  # what the chunk before has left
        rows = table.to_pylist()
        self.number = rows[0]["chunk"]
        docs: dict[tuple[int, bytes], int] = {}
        self.low: dict[int, dict[bytes, int]] = {}
        self.answers: dict[int, dict[int, list[bytes]]] = {}
        for r in rows:
            if r["kind"] == TEXT:
                sizes, times = np.frombuffer(r["y"], np.int64).reshape(2, -1)
                body = expand(r["z"])
                for i, n, e, t in zip(np.frombuffer(r["x"], np.int64).tolist(), sizes.tolist(), np.cumsum(sizes).tolist(), times.tolist()):
                    key = i, body[e - n : e]
                    docs[key] = docs.get(key, 0) + t
            elif r["kind"] == COPIES:
                for k, (i, low) in enumerate(zip(np.frombuffer(r["x"], np.int64).tolist(), np.frombuffer(r["y"], np.int64).tolist())):
                    self.low.setdefault(i, {})[r["z"][32 * k : 32 * k + 32]] = low
            else:
                self.answers.setdefault(r["kind"], {}).setdefault(r["bucket"], []).append(r["y"])
        self.docs = sorted(docs)
        self.times = [docs[k] for k in self.docs]

    def lowest(self, doc_id: int, text: bytes) -> int | None:
        """The smallest doc_id with the text, if documents with other doc_ids have it too."""
        own = self.low.get(doc_id)
        return own.get(sha256(text).digest()) if own else None

    def is_copy(self, doc_id: int, text: bytes) -> bool:
        """Whether a document with a smaller doc_id has the same text."""
        return self.lowest(doc_id, text) not in (None, doc_id)

    def compared(self) -> list[int]:
        """Numbers of the documents that are compared: copies are left out."""
        return [k for k, (i, text) in enumerate(self.docs) if not self.is_copy(i, text)]

    def slabs(self) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
        """Numbers of the compared documents, their bytes and where each begins, with the end."""
        own: list[int] = []
        size = 0
        for k in self.compared():
            text = self.docs[k][1]
            if own and size + len(text) > SLAB:
                yield self._slab(own)
                own, size = [], 0
            own.append(k)
            size += len(text)
        if own:
            yield self._slab(own)

    def _slab(self, own: list[int]) -> tuple[list[int], np.ndarray, np.ndarray]:
        texts = [self.docs[k][1] for k in own]
        return own, np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])


def state(chunk: int, kind: int, hashes: np.ndarray, more: np.ndarray, level: np.ndarray, buckets: int) -> list[list]:
    """Rows that state sorted distinct hashes: 5 bytes of each beside the bucket, 7 more if there are any, and a level."""
    bucket = (hashes % U(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    rows: list[list] = [[] for _ in range(6)]
    for part in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if len(order) else ():
        body = (hashes[part] >> U(24)).view(np.uint8).reshape(-1, 8)[:, :5]
        if len(more):
            body = np.concatenate([body, more[part].view(np.uint8).reshape(-1, 8)[:, :7]], axis=1)
        for c, v in zip(rows, (chunk, kind, bucket[part[0]], np.ascontiguousarray(body).tobytes(), squeeze(level[part].astype(np.uint8)), b"")):
            c.append(v)
    return rows


def each_row(done: DataFrame) -> DataFrame:
    """A row for each row that a document is: ``times`` of them."""
    return done.withColumn("row", F.explode(F.sequence(F.lit(1).cast("long"), "times"))).drop("row", "times")


def rows_table(rows: list[list]) -> pa.Table:
    return pa.Table.from_batches([batch_of(ROW, *rows)], ROW)


def answer(stated: DataFrame, width: int, hot: int = 1 << 30) -> DataFrame:
    """For each stated hash 0 if nothing else has it, 1 if something has, 2 if more than ``hot`` chunks or one with level 2 have.

    Levels: 0, the chunk has the hash once; 1, several times; 2, very often.
    """

    def run(table):
        chunk, kind, bucket, x, y = (table.column(c).to_pylist() for c in ("chunk", "kind", "bucket", "x", "y"))
        n = [len(b) // width for b in x]
        raw = np.frombuffer(b"".join(x), np.uint8).reshape(-1, width)
        wide = np.zeros((len(raw), 16), np.uint8)
        wide[:, :width] = raw
        a, b = wide.view(U).T
        level = np.concatenate([expand(v, np.uint8) for v in y])
        order = np.argsort(a, kind="stable") if width <= 8 else np.lexsort((b, a))
        same = (a[order][1:] == a[order][:-1]) & (b[order][1:] == b[order][:-1])
        first = np.flatnonzero(np.concatenate([[True], ~same]))
        count = np.diff(np.append(first, len(order)))
        top = np.maximum.reduceat(level[order], first)
        said = np.where((top >= 2) | (count > hot), 2, np.where((top >= 1) | (count > 1), 1, 0)).astype(np.uint8)
        out = np.empty(len(order), np.uint8)
        out[order] = np.repeat(said, count)
        parts = np.split(out, np.cumsum(n)[:-1])
        return rows_table([chunk, kind, bucket, [b""] * len(chunk), [squeeze(p) for p in parts], [b""] * len(chunk)])

    return stated.groupBy("bucket").applyInArrow(run, ROW_SQL)


def answers(chunk: Chunk, kind: int, hashes: np.ndarray, buckets: int) -> np.ndarray:
    """What came back for the hashes that the chunk has stated, in their order."""
    bucket = (hashes % U(buckets)).astype(np.int64)
    out = np.zeros(len(hashes), np.uint8)
    order = np.argsort(bucket, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if len(order) else ():
        (said,) = chunk.answers[kind][int(bucket[part[0]])]
        out[part] = expand(said, np.uint8)
    return out


def distinct(hashes: list[np.ndarray], more: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct hashes of a chunk (with the second half of each), and how often each occurs."""
    a = np.concatenate(hashes) if hashes else np.zeros(0, U)
    if more is None:
        u, n = np.unique(a, return_counts=True)
        return u, np.zeros(0, U), n
    b = np.concatenate(more) if more else np.zeros(0, U)
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(a) else np.zeros(0, np.int64)
    return a[first], b[first], np.diff(np.append(first, len(a)))
