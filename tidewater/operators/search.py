"""Keyword, vector, filename and metadata search. Each gives (node_id, chunk_id, score) in a total order, as one lazy plan."""

from __future__ import annotations

import re
from collections.abc import Collection, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.porter import fold, folded_stem, stem, stem_start, tokens
from ..functions.scalars import clamp_k, l2_distance, length_score, nearness

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
MOST_TERMS, MOST_BYTES = 64, 4096
_TERM = re.compile(r"[^\W_]+")


def query_terms(raw: str) -> list[str]:
    """Terms of a request: its first 4096 bytes, cut at what is no letter or digit; 64 at most."""
    text = raw.encode()[:MOST_BYTES].decode("utf-8", "ignore")
    return _TERM.findall(text.lower())[:MOST_TERMS]


@dataclass
class Inverted:
    """The inverted index: postings (term, chunk_id, node_id, tf, dl), terms (term, df) and corpus (one row: n, total).

    A posting carries its chunk's node and length, so that a search reads the postings of its terms and joins nothing
    but two tables of at most 64 rows and one row.
    """

    postings: DataFrame
    terms: DataFrame
    corpus: DataFrame


POSTING = "term string, chunk_id long, node_id long, tf long, dl long"


def count_words(chunks: DataFrame, stemmed: bool = True, only: Collection[str] = ()) -> DataFrame:
    """(term, chunk_id, node_id, tf, dl) of every chunk, or of the terms ``only``: one pass over the texts, nothing is shuffled.

    Each row of ``chunks`` is counted by itself, in Arrow batches: a batch's distinct words are stemmed, then pairs of row
    and stem are counted as numbers.
    """
    text = F.concat_ws(" ", "text", "header") if "header" in chunks.columns else F.col("text")
    wanted, near = frozenset(only), tuple({stem_start(t) for t in only}) if stemmed else ()

    def term_of(word: str) -> str:
        """A word's stem; an empty one where the word can't have a wanted stem."""
        return folded_stem(word) if not near or word.startswith(near) or not word.isascii() else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in _pieces(batch):
                lists = rows.column("words")
                sizes = np.asarray(pc.list_value_length(lists).fill_null(0), np.int64)
                coded = pc.dictionary_encode(lists.flatten())
                terms: dict[str, int] = {}
                words = map(term_of, coded.dictionary.to_pylist()) if stemmed else coded.dictionary.to_pylist()
                number = np.array([terms.setdefault(t, len(terms)) if not wanted or t in wanted else -1 for t in words], np.int64)
                term = number[np.asarray(coded.indices, np.int64)] if len(number) else np.zeros(0, np.int64)
                row = np.repeat(np.arange(rows.num_rows), sizes)[term >= 0]
                pairs, tf = np.unique(row * max(1, len(terms)) + term[term >= 0], return_counts=True)
                row, term = np.divmod(pairs, max(1, len(terms)))
                take = lambda name, row=row, rows=rows: rows.column(name).cast(pa.int64()).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([pa.array(list(terms), pa.string()).take(pa.array(term)), take("chunk_id"), take("node_id"), pa.array(tf, pa.int64()), pa.array(sizes[row], pa.int64())], names=["term", "chunk_id", "node_id", "tf", "dl"])

    return chunks.select("chunk_id", "node_id", tokens(text).alias("words")).mapInArrow(run, POSTING)


#: Words of which a worker counts a piece of a batch, a longer row alone.
PIECE = 1 << 20


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    ends = np.cumsum(np.asarray(pc.list_value_length(batch.column("words")).fill_null(0), np.int64)) // PIECE
    starts = np.flatnonzero(np.r_[True, ends[1:] != ends[:-1]]) if len(ends) else []
    for s, e in zip(starts, [*starts[1:], batch.num_rows]):
        yield batch.slice(s, e - s)


def merged(rows: DataFrame) -> DataFrame:
    """One posting for a term and chunk, where rows repeat a chunk."""
    return rows.groupBy("term", "chunk_id", "node_id", "dl").agg(F.sum("tf").alias("tf")).select("term", "chunk_id", "node_id", "tf", "dl")


def postings(chunks: DataFrame, stemmed: bool = True, only: Collection[str] = ()) -> DataFrame:
    """(term, chunk_id, node_id, tf, dl) of every chunk, or of the terms ``only``."""
    return merged(count_words(chunks, stemmed, only))


def term_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("term").agg(F.count("tf").alias("df"))  # tf, so that an unwritten index is counted from the exchange that a search reads


def corpus_of(chunks: DataFrame, written: DataFrame | None = None) -> DataFrame:
    """One row: chunks, and their words, which written postings have counted."""
    if written is not None:
        return chunks.agg(F.count("*").alias("n")).join(written.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("total")), F.lit(True))
    text = F.concat_ws(" ", "text", "header") if "header" in chunks.columns else F.col("text")
    return chunks.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size(tokens(text)).cast("long")), F.lit(0)).alias("total"))


def by_term(rows: DataFrame) -> DataFrame:
    """Counted words as they are written: in ranges of terms, so that statistics of the files lead a search to its terms. The only shuffle of an index."""
    return merged(rows.repartitionByRange("term", "chunk_id")).sortWithinPartitions("term", "chunk_id")


def invert(chunks: DataFrame, stemmed: bool = True, only: Collection[str] = ()) -> Inverted:
    """An index that isn't written, of all terms or of the terms ``only``."""
    rows = postings(chunks, stemmed, only)
    return Inverted(rows, term_counts(rows), corpus_of(chunks))


def wanted_terms(terms: list[str], stemmed: bool = True) -> dict[str, int]:
    """Terms as the index has them, with how often each is asked for."""
    wanted: dict[str, int] = {}
    for t in terms:
        t = stem(fold(t)) if stemmed else t
        wanted[t] = wanted.get(t, 0) + 1
    return wanted


def bm25(index: Inverted, terms: list[str], stemmed: bool = True) -> DataFrame:
    """(node_id, chunk_id, score) of every chunk with any of the terms; a term that is asked for twice counts twice.

    The list of at most 64 terms is pushed into the scans of postings and terms. Scores are rounded to 12 digits, so that chunks
    with equal counts tie in whatever order their terms are added up.
    """
    wanted = wanted_terms(terms, stemmed)
    if not wanted:
        return index.postings.select("node_id", "chunk_id", F.lit(0.0).alias("score")).limit(0)
    mine = F.col("term").isin(*wanted)
    weight = reduce(lambda c, kv: c.when(F.col("term") == kv[0], kv[1]), wanted.items(), F.when(F.lit(False), 0))
    df = F.broadcast(index.terms.filter(mine))  # a row for each of at most 64 terms
    corpus = F.broadcast(index.corpus.select("n", (F.col("total") / F.col("n")).alias("avgdl")))  # one row
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    idf = F.when(idf <= 0, LEAST_IDF).otherwise(idf)
    part = weight * idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return index.postings.filter(mine).join(df, "term").join(corpus, F.lit(True)).groupBy("node_id", "chunk_id").agg(F.round(F.sum(part), 12).alias("score"))


def scan_bm25(chunks: DataFrame, terms: list[str]) -> DataFrame:
    """(node_id, chunk_id, score) without an index: term frequencies are counted in each row's tokens, nothing is exploded or shuffled.

    Two passes over the text: one row of totals, which is broadcast, and the scores.
    """
    wanted = {t: terms.count(t) for t in terms}
    text = F.concat_ws(" ", "text", "header") if "header" in chunks.columns else F.col("text")
    words = chunks.select("node_id", "chunk_id", tokens(text).alias("words"))

    def frequency(term: str) -> Column:
        return F.size(F.filter("words", lambda w: w == term))

    tf = [frequency(t).alias(f"tf{i}") for i, t in enumerate(wanted)]
    counted = words.select("node_id", "chunk_id", F.size("words").alias("dl"), *tf)
    some = [(F.col(f"tf{i}") > 0).cast("long") for i in range(len(wanted))]
    totals = counted.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *(F.sum(s).alias(f"df{i}") for i, s in enumerate(some)))
    score = F.lit(0.0)
    for i, times in enumerate(wanted.values()):
        n, df, f = F.col("n"), F.col(f"df{i}"), F.col(f"tf{i}")
        idf = F.log((n - df + 0.5) / (df + 0.5))
        idf = F.when(idf <= 0, LEAST_IDF).otherwise(idf)
        score = score + times * idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    hit = reduce(lambda a, b: a | b, (F.col(f"tf{i}") > 0 for i in range(len(wanted))))
    return counted.filter(hit).join(F.broadcast(totals), F.lit(True)).select("node_id", "chunk_id", score.alias("score"))


def fts_search(chunks: DataFrame, query: str, k: int = 20, index: Inverted | None = None, stemmed: bool = True) -> DataFrame:
    """Top chunks by BM25 over stems, from an index if there is one. Without stems and index the texts are scanned."""
    terms = query_terms(query)
    if index is None and not stemmed and terms:
        scored = scan_bm25(chunks, terms)
    else:
        scored = bm25(invert(chunks, stemmed, wanted_terms(terms, stemmed)) if index is None else index, terms, stemmed)
    return scored.orderBy(F.desc("score"), "node_id", "chunk_id").limit(clamp_k(k))


def vector_search(embeddings: DataFrame, chunks: DataFrame | None, query: list[int], k: int = 20, dimension: int | None = None, gate: tuple[bool, str] = (True, "")) -> DataFrame:
    """Exact nearest int8 vectors by Euclidean distance; the cut comes before the join with chunks.

    gate: what Store.semantic_compatible says; a closed one is an error, which a broad search reports as a degraded source.
    """
    if not gate[0]:
        raise RuntimeError(f"DEGRADED: embeddings are not compatible: {gate[1]}")
    if dimension is not None and len(query) != dimension:
        raise ValueError(f"CONTRACT_ERROR: a query has {len(query)} components, the index {dimension}")
    d = l2_distance(F.col("embedding"), F.lit(list(query)).cast("array<tinyint>"))
    top = embeddings.select("chunk_id", nearness(d).alias("score")).orderBy(F.desc("score"), "chunk_id").limit(clamp_k(k))
    if chunks is None:
        return top
    return top.join(chunks.select("chunk_id", "node_id"), "chunk_id").select("node_id", "chunk_id", "score").orderBy(F.desc("score"), "node_id", "chunk_id")


def filename_search(files: DataFrame, nodes: DataFrame, query: str, k: int = 20) -> DataFrame:
    """Nodes of live files whose path holds every token; short paths first. '%' and '_' in a token are wildcards."""
    parts = query.lower().split()
    if not parts:
        return nodes.select("node_id", F.lit(None).cast("long").alias("chunk_id"), F.lit(0.0).alias("score")).limit(0)
    like: Column = reduce(lambda a, b: a & b, (F.lower("path").like("%" + t.replace("\\", "\\\\") + "%") for t in parts))
    hits = files.filter(F.col("deleted_at").isNull() & like).select("file_id", length_score(F.col("path")).alias("score"))
    return hits.join(nodes.select("node_id", "file_id"), "file_id").select("node_id", F.lit(None).cast("long").alias("chunk_id"), "score").orderBy(F.desc("score"), "node_id").limit(clamp_k(k))


def metadata_search(files: DataFrame, nodes: DataFrame, content_class: str | None = None, path_prefix: str | None = None, since: int = 0, until: int = 0, k: int = 20) -> DataFrame:
    """Nodes of live files by class, path prefix and time of change (bounds included, 0: none); newest first."""
    rows = files.filter("deleted_at IS NULL")
    if content_class:
        rows = rows.filter(F.col("content_class") == content_class)
    if path_prefix:
        rows = rows.filter(F.col("path").ilike(path_prefix + "%"))
    if since:
        rows = rows.filter(F.col("mtime") >= since)
    if until:
        rows = rows.filter(F.col("mtime") <= until)
    hits = rows.select("file_id", "mtime").join(nodes.select("node_id", "file_id"), "file_id")
    return hits.orderBy(F.desc("mtime"), "node_id").limit(clamp_k(k)).select("node_id", F.lit(None).cast("long").alias("chunk_id"), F.col("mtime").cast("float").alias("score"))


def graph_expand(edges: DataFrame, seeds: list[int], depth: int = 0, most: int = 100) -> DataFrame:
    """(node_id, depth): empty by default, as edges are never written; up to ``depth`` steps along edges as an extension."""
    found = edges.sparkSession.createDataFrame([(s, 0) for s in seeds] if depth else [], "node_id long, depth int")
    frontier = found
    for d in range(1, depth + 1):
        frontier = edges.join(frontier, edges.src_node == frontier.node_id).select(F.col("dst_node").alias("node_id"), F.lit(d).alias("depth")).distinct().join(found.select("node_id"), "node_id", "left_anti")
        found = found.unionByName(frontier)
    return found.orderBy("depth", "node_id").limit(most)
