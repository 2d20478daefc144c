"""Line dedup: sharded cuckoo filters in front of exact reference-count tables.

A line's key is the line stripped of white space at both ends with A-Z lower-cased. Keys of at least ``min_chars``
code points that at least ``min_docs`` documents hold lose all their lines except in the largest doc_id that holds them.

LineIndex is the state. Exact: ``refs`` (key, doc_id), one row for each document that holds a long key, and counts
(key, n_docs, max_doc), of which every change writes the rows that it changes. In front stand cuckoo filters, one per
shard of the keys' hash space, with the keys that are counted in ``min_docs`` documents; a change touches a filter only where
a key crosses that number, up or down, and a filter that is full is built anew, twice as large, from the exact counts. A
key that the filter of its shard denies is kept at once; the others are decided by the exact counts. Documents can be
deleted again: what is left is what inserting the others alone would have given.

dedup_lines() inserts documents into an empty index and asks it about them. Filters and distinct keys meet by shard, in
one shuffle, whatever their size; a key that very many documents hold is one key there.

Keys are 128-bit hashes of the stripped lines. Nulls: a null text is one empty line; a row with null doc_id belongs to
no document: it counts for nothing and loses nothing. Rows that repeat a doc_id are one document; each comes out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from .common import SPACE, Scratch, as_bytes, batch_of, column_of, read, slices

KEYS = "key binary, doc_id long"
#: Frequent keys of a shard when an index begins; keys that a task asks a filter about; tables of changes before they are merged.
SHARD_KEYS, ASKED, PARTS = 1 << 13, 1 << 18, 16


def key_of(line: bytes, min_chars: int) -> bytes | None:
    """The hash of a line's key; none if the key is too short."""
    line = line.strip(SPACE)
    if len(line) < min_chars or not line.isascii() and len(line.decode("utf-8", "replace")) < min_chars:
        return None
    return xxhash.xxh3_128_digest(line.lower())


class CuckooFilter:
    """16-bit fingerprints in buckets of four; every key has two buckets, so a fingerprint can be moved and deleted."""

    SLOTS = 4

    def __init__(self, capacity: int, table: np.ndarray | None = None):
        n = 1 << max(2, int(np.ceil(np.log2(max(1, capacity) / self.SLOTS / 0.85))))
        self.table = np.zeros((n, self.SLOTS), np.uint16) if table is None else table

    @classmethod
    def load(cls, blob: bytes) -> CuckooFilter:
        return cls(0, np.frombuffer(blob, np.uint16).reshape(-1, cls.SLOTS).copy())

    def dump(self) -> bytes:
        return self.table.tobytes()

    def places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fingerprints and both buckets of 64-bit hashes."""
        prints = (hashes >> np.uint64(48)).astype(np.uint16)
        prints[prints == 0] = 1
        first = (hashes & np.uint64(len(self.table) - 1)).astype(np.int64)
        return prints, first, self.other(first, prints)

    def other(self, bucket: np.ndarray, prints: np.ndarray) -> np.ndarray:
        mixed = (prints.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)
        return (bucket ^ (mixed & np.uint64(len(self.table) - 1)).astype(np.int64)).astype(np.int64)

    def contains(self, hashes: np.ndarray) -> np.ndarray:
        prints, a, b = self.places(hashes)
        return ((self.table[a] == prints[:, None]) | (self.table[b] == prints[:, None])).any(axis=1)

    def insert(self, hashes: np.ndarray) -> bool:
        """False if some key found no place: the caller builds a larger filter from the exact table."""
        rng = np.random.default_rng(7)
        prints, a, b = self.places(hashes)
        for f, x, y in zip(prints, a.tolist(), b.tolist()):
            for bucket in (x, y):
                free = np.flatnonzero(self.table[bucket] == 0)
                if len(free):
                    self.table[bucket, free[0]] = f
                    break
            else:
                bucket = (x, y)[int(rng.integers(2))]
                for _ in range(500):
                    slot = int(rng.integers(self.SLOTS))
                    f, self.table[bucket, slot] = self.table[bucket, slot], f
                    bucket = int(self.other(np.array([bucket]), np.array([f], np.uint16))[0])
                    free = np.flatnonzero(self.table[bucket] == 0)
                    if len(free):
                        self.table[bucket, free[0]] = f
                        break
                else:
                    return False
        return True

    def delete(self, hashes: np.ndarray) -> None:
        """Takes out keys that were inserted before; others must not be given."""
        prints, a, b = self.places(hashes)
        for f, x, y in zip(prints, a.tolist(), b.tolist()):
            for bucket in (x, y):
                held = np.flatnonzero(self.table[bucket] == f)
                if len(held):
                    self.table[bucket, held[0]] = 0
                    break

    @classmethod
    def build(cls, hashes: np.ndarray) -> CuckooFilter:
        capacity = len(hashes)
        while not (out := cls(capacity)).insert(hashes):
            capacity *= 2
        return out


def hash64(keys: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(keys), np.uint64)[::2] if keys else np.zeros(0, np.uint64)


def shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    """The shard comes from middle bits; the filters use those at both ends."""
    return ((hashes >> np.uint64(24)) % np.uint64(shards)).astype(np.int32)


def references(docs: DataFrame, min_chars: int) -> DataFrame:
    """(key, doc_id) of every long key, once for each row of the documents."""
    schema = pa.schema([("key", pa.binary()), ("doc_id", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            keys, ids = [], []
            for i, text in zip(batch.column("doc_id").to_pylist(), as_bytes(batch.column("text"))):
                if i is not None:
                    own = {k for line in text.split(b"\n") if len(line) >= min_chars and (k := key_of(line, min_chars))}
                    keys += own
                    ids += [i] * len(own)
            yield batch_of(schema, keys, ids)

    return docs.select("doc_id", "text").mapInArrow(run, KEYS)


def finish(docs: DataFrame) -> DataFrame:
    """Rows (``row``, a struct) with ``drop``, the keys to be dropped: row, n_lines, n_dropped and the text that is left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "row.text"):
            n_lines, n_dropped, texts = [], [], []
            for text, drop in zip(as_bytes(column_of(batch, "row.text")), batch.column("drop").to_pylist()):
                lines = text.split(b"\n")
                gone = set(drop or ())
                kept = [x for x in lines if key_of(x, 1) not in gone] if gone else lines
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(kept))
                texts.append(b"\n".join(kept))
            columns = [batch.column("row"), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "n_lines", "n_dropped", "text"])

    rows = docs.select("row", "drop")
    out = StructType([rows.schema["row"], StructField("n_lines", LongType()), StructField("n_dropped", LongType()), StructField("text", StringType())])
    return rows.mapInArrow(run, out)


def shard_column(keys: DataFrame, shards: int, parts: int = 1) -> DataFrame:
    """key and more, with ``shard`` by the filters' own hash and ``part``."""
    names = [c for c in keys.columns if c != "key"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = hash64(batch.column("key").to_pylist())
            part = ((hashes >> np.uint64(8)) % np.uint64(parts)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("key"), *(batch.column(c) for c in names), pa.array(shard_of(hashes, shards)), pa.array(part)], names=["key", *names, "shard", "part"])

    rows = keys.select("key", *names)
    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("shard", IntegerType()), StructField("part", IntegerType())]))


class LineIndex:
    """Reversible state for incremental dedup, in tables below the shared folder.

    After insert(a), insert(b), delete(a) counts() and the keys in the filters are those of insert(b) alone. Inserting a
    document again changes nothing; deleting one that isn't there changes nothing.
    """

    def __init__(self, spark: SparkSession, min_chars: int = 40, min_docs: int = 5, shards: int | None = None):
        """shards: by default as many as the first insertion's frequent keys ask for."""
        self.spark, self.min_chars, self.min_docs, self.shards = spark, min_chars, min_docs, shards
        self.scratch = Scratch(spark, "line-index")
        self.refs = spark.createDataFrame([], KEYS)
        self.filters: DataFrame | None = None
        self._counts: list[DataFrame] = []
        self._refs: list[DataFrame] = []

    def counts(self) -> DataFrame:
        """The exact table: key, n_docs, max_doc."""
        if not self._counts:
            return self.spark.createDataFrame([], "key binary, n_docs long, max_doc long")
        return self._latest(None).filter("n_docs > 0")

    def _latest(self, keys: DataFrame | None) -> DataFrame:
        """The newest rows of all keys, or of some."""
        rows = self._counts[0]
        for part in self._counts[1:]:
            rows = rows.unionByName(part)
        if keys is not None:
            rows = rows.join(keys, "key", "left_semi")
        if len(self._counts) > 1:
            rows = rows.groupBy("key").agg(F.max_by(F.struct("n_docs", "max_doc"), "version").alias("c")).select("key", "c.*")
        return rows.select("key", "n_docs", "max_doc")

    def insert(self, docs: DataFrame) -> LineIndex:
        new = references(docs, self.min_chars).distinct()  # the distinct rows deal a hot key out by document
        if self._refs:
            new = new.join(self.refs, ["key", "doc_id"], "left_anti")
        new = self.scratch.write(new, "refs")
        self._hold([*self._refs, new])
        more = new.groupBy("key").agg(F.count("*").alias("more"), F.max("doc_id").alias("top"))
        if not self._counts:
            return self._change(more.select("key", F.lit(0).cast("long").alias("before"), F.col("more").alias("n_docs"), F.col("top").alias("max_doc")))
        more = self.scratch.write(more, "more")
        both = more.join(self._latest(more.select("key")), "key", "left").withColumn("before", F.coalesce("n_docs", F.lit(0)))
        return self._change(both.select("key", "before", (F.col("before") + F.col("more")).alias("n_docs"), F.greatest("max_doc", "top").alias("max_doc")))

    def delete(self, doc_ids: DataFrame) -> LineIndex:
        if not self._counts:
            return self
        ids = self.scratch.write(doc_ids.select("doc_id").distinct(), "ids")
        gone = self.scratch.write(self.refs.join(ids, "doc_id", "left_semi").groupBy("key").agg(F.count("*").alias("less")), "gone")
        self._hold([self.scratch.write(self.refs.join(ids, "doc_id", "left_anti").select("key", "doc_id"), "refs")])
        top = self.refs.join(gone.select("key"), "key", "left_semi").groupBy("key").agg(F.max("doc_id").alias("top"))
        both = gone.join(self._latest(gone.select("key")), "key").join(top, "key", "left")
        return self._change(both.select("key", F.col("n_docs").alias("before"), (F.col("n_docs") - F.col("less")).alias("n_docs"), F.col("top").alias("max_doc")))

    def _hold(self, refs: list[DataFrame]) -> None:
        self._refs = refs
        self.refs = refs[0]
        for part in refs[1:]:
            self.refs = self.refs.unionByName(part)
        if len(refs) > PARTS:
            self._refs = [self.scratch.write(self.refs, "refs")]
            self.refs = self._refs[0]

    def _change(self, rows: DataFrame) -> LineIndex:
        """Takes up new counts (key, before, n_docs, max_doc) and moves the keys that cross ``min_docs``."""
        rows = self.scratch.write(rows.withColumn("version", F.lit(len(self._counts))), "counts")
        self._counts.append(rows.drop("before"))
        if len(self._counts) > PARTS:
            self._counts = [self.scratch.write(self.counts().withColumn("version", F.lit(0)), "counts")]
        moved = rows.filter((F.col("before") >= self.min_docs) != (F.col("n_docs") >= self.min_docs)).select("key", (F.col("n_docs") >= self.min_docs).alias("put"))
        if self.shards is None:
            self.shards = max(1, -(-moved.count() // SHARD_KEYS))
        schema = "shard int, filter binary"

        def change(key, filters, changes):
            held = filters.column("filter").to_pylist()
            put = np.asarray(changes.column("put").combine_chunks().to_numpy(zero_copy_only=False), bool)
            hashes = hash64(changes.column("key").to_pylist())
            if held:
                table = CuckooFilter.load(held[0])
                table.delete(hashes[~put])
                blob = table.dump() if table.insert(hashes[put]) else None  # full
            else:
                blob = CuckooFilter.build(hashes[put]).dump()
            return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "filter": pa.array([blob], pa.binary())})

        def build(key, keys):
            table = CuckooFilter.build(hash64(keys.column("key").to_pylist()))
            return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "filter": pa.array([table.dump()], pa.binary())})

        old = self.filters if self.filters is not None else self.spark.createDataFrame([], schema)
        changes = shard_column(moved, self.shards).drop("part")
        new = self.scratch.write(old.groupBy("shard").cogroup(changes.groupBy("shard")).applyInArrow(change, schema), "filters")
        full = [r.shard for r in new.filter("filter IS NULL").select("shard").collect()]  # at most the number of shards
        if full:
            frequent = self.counts().filter(F.col("n_docs") >= self.min_docs).select("key")
            larger = shard_column(frequent, self.shards).filter(F.col("shard").isin(full)).groupBy("shard").applyInArrow(build, schema)
            new = self.scratch.write(new.filter("filter IS NOT NULL").unionByName(larger), "filters")
        self.filters = new
        return self

    def not_denied(self, keys: DataFrame) -> DataFrame:
        """Of distinct keys those that a filter holds, and few others."""
        parts = max(1, -(-keys.count() // (ASKED * self.shards)))

        def ask(key, filters, keys):
            table = CuckooFilter.load(filters.column("filter").to_pylist()[0]) if filters.num_rows else CuckooFilter(0)
            own = keys.column("key").to_pylist()
            hit = table.contains(hash64(own)) if own else np.zeros(0, bool)
            return pa.table({"key": pa.array([k for k, h in zip(own, hit.tolist()) if h], pa.binary())})

        filters = self.filters.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        return filters.groupBy("shard", "part").cogroup(shard_column(keys.select("key"), self.shards, parts).groupBy("shard", "part")).applyInArrow(ask, "key binary")

    def dedup(self, docs: DataFrame, refs: DataFrame | None = None) -> DataFrame:
        """row (a struct of all columns), n_lines, n_dropped and the text that is left, for every row of the documents.

        refs: (key, doc_id) of the documents, where they are known.
        """
        rows = docs.select(F.struct("*").alias("row"))
        if self.filters is None:
            return finish(rows.withColumn("drop", F.lit(None).cast("array<binary>")))
        refs = self.scratch.write(references(docs, self.min_chars).distinct(), "asked") if refs is None else refs
        maybe = self.scratch.write(self.not_denied(refs.select("key").distinct()), "maybe")
        frequent = self.scratch.write(self._latest(maybe).filter(F.col("n_docs") >= self.min_docs).select("key", "max_doc"), "frequent")
        # merge joins at every size: rows and references are dealt out by key, and a hot key's part can be split
        drops = refs.join(frequent.hint("merge"), "key").filter(F.col("doc_id") < F.col("max_doc")).groupBy("doc_id").agg(F.collect_set("key").alias("drop"))
        drops = self.scratch.write(drops, "drops")
        named = rows.filter("row.doc_id IS NOT NULL").join(drops.hint("merge"), F.col("row.doc_id") == F.col("doc_id"), "left").select("row", "drop")
        return finish(named.unionByName(rows.filter("row.doc_id IS NULL").withColumn("drop", F.lit(None).cast("array<binary>"))))


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """row (a struct of all columns), n_lines, n_dropped and the text that is left, for every row of the documents."""
    index = LineIndex(docs.sparkSession, min_chars, min_docs).insert(docs)
    return index.dedup(docs, index.refs)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("row.doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP4_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
lines AS (
  SELECT rid, doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM docs
),
keyed AS (
  SELECT *, translate(trim(line, E' \t\n\x0b\x0c\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
),
frequent AS (
  SELECT key, max(doc_id) AS max_doc FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
),
marked AS (
  SELECT k.rid, k.doc_id, k.pos, k.line, coalesce(k.doc_id < f.max_doc, false) AS gone FROM keyed k LEFT JOIN frequent f ON k.key = f.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY rid, doc_id
"""
