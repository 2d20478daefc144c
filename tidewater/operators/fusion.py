"""Reciprocal rank fusion of search channels, and the shape of what a broad search returns."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor, wait
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from ..functions.scalars import clamp_k, strip_controls, truncate_bytes
from ..schema import DEGRADED, EMPTY, OK, SCORES
from . import search
from .nodes import hydrate

K = 60
#: Seconds that a request waits for its sources.
DEADLINE = 2.0
SOURCES = ("fts", "filename", "vector")
#: Bytes of a snippet by detail; 0: all of a node's first chunks.
SNIPPET = {"brief": 120, "standard": 400, "full": 0}
PER_NODE = 2
MODES = {"auto": SOURCES, "lexical": ("fts",), "filename": ("filename",), "semantic": ("vector",)}
#: What an error's text becomes, the first word that occurs decides.
SAFE_ERRORS = (
    ("sql", "database query failed"),
    ("embed", "embedding operation failed"),
    ("timeout", "operation timed out"),
    ("deadline", "operation timed out"),
    ("connect", "service connection failed"),
    ("refused", "service connection failed"),
)
OTHER_ERROR = "internal error"
PARTIAL = "completeness=partial; some sources failed. See failed_sources and sources[]."


def fuse(lists: dict[str, DataFrame], most: int = 20) -> DataFrame:
    """(node_id, score, matched_sources): the sum of 1/(60 + rank + 1) over all rows of all lists, repeated nodes included.

    Each list has been cut to at most 100 rows before its ranks are given.
    """
    ranked = None
    for name in (s for s in SOURCES if s in lists):
        w = Window.orderBy(F.desc("score"), "node_id", "chunk_id")
        rows = lists[name].withColumn("rank", F.row_number().over(w) - 1).select("node_id", "rank", F.lit(name).alias("source"))
        ranked = rows if ranked is None else ranked.unionByName(rows)
    out = ranked.groupBy("node_id").agg(F.sum(1 / (K + F.col("rank") + 1)).alias("score"), F.array_join(F.sort_array(F.collect_list("source")), ",").alias("matched_sources"))
    return out.orderBy(F.desc("score"), "node_id").limit(most)


def shape(fused: DataFrame, nodes: DataFrame, files: DataFrame, chunks: DataFrame, detail: str = "standard") -> DataFrame:
    """Hits with path, title and snippet. A hit without a node stays, with empty path and title."""
    size = SNIPPET.get(detail, SNIPPET["standard"])
    rows = hydrate(fused, nodes, files, chunks, PER_NODE)
    first = F.coalesce(F.element_at("chunks", 1), F.lit(""))
    snippet = truncate_bytes(first, size, "…") if size else F.array_join("chunks", "\n---\n")
    return rows.select("node_id", "score", "matched_sources", F.coalesce("path", F.lit("")).alias("path"), F.coalesce("name", F.lit("")).alias("title"), snippet.alias("snippet"))


@dataclass
class Request:
    query: str
    mode: str = "auto"
    detail: str = "standard"
    max_results: int = 20
    vector: list[int] | None = None
    deadline: float | None = DEADLINE


@dataclass
class Source:
    name: str
    status: str
    latency_ms: int = 0
    error_message: str = ""


@dataclass
class Response:
    status: str = "ok"
    completeness: str = "full"
    hits: DataFrame | None = None
    sources: list[Source] = field(default_factory=list)
    failed_sources: list[str] = field(default_factory=list)
    retryable: bool = False
    warnings: list[str] = field(default_factory=list)


def safe_error(text: str) -> str:
    """What a client may see of an error."""
    return next((v for k, v in SAFE_ERRORS if k in text.lower()), OTHER_ERROR) if text else ""


def annotate(response: Response) -> Response:
    """A partial response without warnings gets one."""
    if response.completeness == "partial" and not response.warnings:
        response.warnings = [PARTIAL]
    return response


def run_sources(spark, plans: dict[str, Callable[[], DataFrame]], deadline: float | None) -> tuple[dict[str, list[Row]], list[Source], list[str]]:
    """Runs the channels side by side: at most 100 rows of each, their states, and the names of those that were too late, whose jobs are cancelled."""
    context, tag = spark.sparkContext, f"search-{uuid.uuid4().hex}"

    def run(name: str) -> tuple[str, list[Row], Source]:
        began = time.monotonic()
        try:
            context.addJobTag(tag)
            rows = plans[name]().collect()
            state, error = OK if rows else EMPTY, ""
        except Exception as e:  # a failed source is reported, not raised
            rows, state, error = [], DEGRADED, safe_error(str(e) or type(e).__name__)
        return name, rows, Source(name, state, int(1000 * (time.monotonic() - began)), error)

    pool = ThreadPoolExecutor(max(1, len(plans)))
    futures = {pool.submit(run, name): name for name in plans}
    done, late = wait(futures, timeout=deadline)
    if late:
        context.cancelJobsWithTag(tag)
    pool.shutdown(wait=False, cancel_futures=True)
    found = sorted((f.result() for f in done), key=lambda x: SOURCES.index(x[0]))
    return {name: rows for name, rows, _ in found}, [s for *_, s in found], sorted(futures[f] for f in late)


def search_broadly(
    request: Request,
    files: DataFrame,
    nodes: DataFrame,
    chunks: DataFrame,
    embeddings: DataFrame | None = None,
    index: search.Inverted | None = None,
    embedder: Callable[[str], list[int]] | None = None,
    gate: tuple[bool, str] = (True, ""),
) -> Response:
    """All channels of the mode side by side, fused and shaped.

    A mode of one source fails with its source, an empty one excepted. Without vectors to ask for, auto is silently lexical;
    semantic is an error. Any failed source makes the response degraded, partial and worth another try; so does one
    that the deadline has cut off, with a warning. embedder: from a query to its int8 vector (wordpiece.QueryEmbedder).
    """
    most = clamp_k(request.max_results)
    wanted = MODES.get(request.mode, SOURCES)
    plans: dict[str, Callable[[], DataFrame]] = {}
    if "fts" in wanted:
        plans["fts"] = lambda: search.fts_search(chunks, request.query, most, index)
    if "filename" in wanted:
        plans["filename"] = lambda: search.filename_search(files, nodes, request.query, most // 2)
    if "vector" in wanted and embeddings is not None and (request.vector is not None or embedder is not None):
        plans["vector"] = lambda: search.vector_search(embeddings, chunks, request.vector if request.vector is not None else embedder(request.query), most, gate=gate)
    if not plans:
        return annotate(Response("error", "partial", None, [], list(wanted)))
    spark = chunks.sparkSession
    found, sources, late = run_sources(spark, plans, request.deadline)
    out = Response(sources=sources, failed_sources=[s.name for s in sources if s.status == DEGRADED])
    if late:
        out.status, out.completeness, out.warnings = "degraded", "partial", ["deadline exceeded"] * len(late)
    if len(wanted) == 1 and (out.failed_sources or late):
        out.status = "error"
        return annotate(out)
    lists = {name: spark.createDataFrame([(r.node_id, r.chunk_id, float(r.score)) for r in rows], SCORES) for name, rows in found.items() if rows}
    empty = spark.createDataFrame([], "node_id long, score double, matched_sources string")
    out.hits = shape(fuse(lists, most) if lists else empty, nodes, files, chunks, request.detail).orderBy(F.desc("score"), "node_id")
    if out.failed_sources:
        out.completeness, out.retryable = "partial", True
        out.status = "degraded" if out.status == "ok" else out.status
    return annotate(out)


def render(hits: DataFrame) -> DataFrame:
    """Numbered lines for a terminal: path, sources, snippet; control and bidirectional characters are out."""
    w = Window.orderBy(F.desc("score"), "node_id")
    line = F.concat(F.row_number().over(w).cast("string"), F.lit(". "), F.col("path"), F.lit(" ["), F.col("matched_sources"), F.lit("] "), F.regexp_replace("snippet", r"\s+", " "))
    return hits.select(F.row_number().over(w).alias("rank"), strip_controls(line).alias("line"))
