"""Indexing a folder: files, nodes, chunks, vectors and the ledger as whole new table versions.

A run is set algebra over the walk: changed files lose what hangs on them, unseen ones are marked deleted, pending ones are
parsed in parallel. A file that fails gives a ledger row and nothing else. Ids are monotone in path and position.

A run publishes its tables in one commit; before it, only ledger rows that say what is running. A run that is killed
leaves the files as they were, so that the next one sees the same changes again.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import quantize
from ..operators.admin import failure_rate
from ..operators import merge, search
from ..operators.chunks import POLICY, chunk_code, chunk_prose
from ..operators.fusion import Request, Response, search_broadly
from ..operators.symbols import symbols_of
from ..schema import CHUNKS, NODES, POSTINGS
from ..sources.files import MOST_BYTES, contents, root_path, walk
from ..sources.store import Store

#: Bits of a node's number in its file and of a chunk's number in its file; the rest of an id is the file's.
NODE_BITS, CHUNK_BITS = 20, 26
#: Pending files up to which they are read by their paths; beyond, the whole folder is read.
LISTED = 10_000
LABEL = "int8_fixed_s256"
INDEXABLE = ("code", "document")
PARSED = (
    "nodes array<struct<ordinal int, node_type string, name string, properties string>>, "
    "chunks array<struct<ordinal int, node int, text string, byte_start long, byte_end long, token_count int, chunk_kind string>>, error string"
)
LANGUAGES = {".py": "python", ".go": "go"}


def parse(path: str, text: str | None, content_class: str, failure: str | None) -> dict:
    """Nodes and chunks of a file, or its error; never raises."""
    if failure or text is None:
        return {"nodes": [], "chunks": [], "error": failure or "no content"}
    try:
        symbols = symbols_of(path, text) if content_class == "code" else []
        language = next((v for k, v in LANGUAGES.items() if path.endswith(k)), None)
        if symbols:
            nodes = [{"ordinal": i, "node_type": s["kind"], "name": s["name"], "properties": json.dumps({"language": language, "symbol_name": s["name"], "signature": s["signature"], "line_start": s["line_start"], "line_end": s["line_end"]})} for i, s in enumerate(symbols)]
            pieces = chunk_code(text, symbols)
        else:
            nodes = [{"ordinal": 0, "node_type": "file", "name": path.rsplit("/", 1)[-1], "properties": json.dumps({"language": language} if language else {})}]
            kind = "code_fallback" if content_class == "code" else "prose"
            pieces = [c | {"chunk_kind": kind, "symbol": 0} for c in chunk_prose(text)]
        # a file of 32 MiB has fewer nodes and chunks than the bits hold: either takes a few bytes
        chunks = [{k: c[k] for k in ("text", "byte_start", "byte_end", "token_count", "chunk_kind")} | {"ordinal": i, "node": c["symbol"] or 0} for i, c in enumerate(pieces)]
        return {"nodes": nodes, "chunks": chunks, "error": None}
    except Exception as e:  # the file's error is its result
        return {"nodes": [], "chunks": [], "error": f"{type(e).__name__}: {e}"}


def parse_files(files: DataFrame, texts: DataFrame) -> DataFrame:
    """files (file_id, path, content_class) with ``parsed``."""

    @F.pandas_udf(PARSED)
    def run(path: pd.Series, text: pd.Series, content_class: pd.Series, failure: pd.Series) -> pd.DataFrame:
        rows = [parse(p, t, c, f) for p, t, c, f in zip(path, text, content_class, failure)]
        return pd.DataFrame(rows, columns=["nodes", "chunks", "error"])

    return files.join(texts, "path").select("file_id", "path", run("path", "text", "content_class", "failure").alias("parsed"))


def node_rows(parsed: DataFrame, now: int) -> DataFrame:
    """Language and symbol name are taken out of the properties' JSON."""
    n = parsed.select("file_id", F.explode("parsed.nodes").alias("n"))
    lit = F.lit(now).cast("long")
    of = lambda key: F.get_json_object("n.properties", f"$.{key}").alias(key)
    return n.select(
        (F.shiftleft("file_id", NODE_BITS) + F.col("n.ordinal")).alias("node_id"), "file_id", "n.node_type", "n.name", "n.properties", F.lit("extracted").alias("provenance"), F.lit(1.0).alias("confidence"),
        lit.alias("created_at"), lit.alias("updated_at"), F.lit(None).cast("long").alias("deleted_at"), of("language"), of("symbol_name"),
    ).select(*NODES.names)


def chunk_rows(parsed: DataFrame) -> DataFrame:
    c = parsed.select("file_id", F.explode("parsed.chunks").alias("c"))
    node = F.shiftleft("file_id", NODE_BITS) + F.col("c.node")
    return c.select(
        (F.shiftleft("file_id", CHUNK_BITS) + F.col("c.ordinal")).alias("chunk_id"), node.alias("node_id"), "c.text", "c.byte_start", "c.byte_end", "c.token_count", "c.chunk_kind", F.lit(None).cast("string").alias("header"), F.lit(None).cast("long").alias("deleted_at")
    ).select(*CHUNKS.names)


Embedder = Callable[[list[str]], "list[list[float]]"]


def embed(chunks: DataFrame, embedder: Embedder, scale: int = 256, batch: int = 32) -> DataFrame:
    """(chunk_id, embedding): int8 vectors; the embedder is called with so many texts at a time."""

    @F.pandas_udf("array<double>")
    def run(text: pd.Series) -> pd.Series:
        out: list[list[float]] = []
        for at in range(0, len(text), batch):
            out += embedder(text.iloc[at : at + batch].tolist())
        return pd.Series(out)

    return chunks.select("chunk_id", quantize(run("text"), scale).alias("embedding"))


def index_folder(spark: SparkSession, store: Store, root: str, now: int, embedder: Embedder | None = None, dimension: int = 384) -> dict:
    """One run. Returns counts and the failure rate's severity."""
    parts = {"model": "stub", "model_version": "1", "dimension": dimension, "chunk_policy": POLICY, "quantization": LABEL}
    store.check_fingerprint(**parts)
    if store.manifest["fingerprint"] is None:
        store.write_fingerprint(**parts)
    before, ledger = store.table("files"), store.table("pipeline_state")
    seen = walk(spark, root, now)
    files = store.stage("files", merge.soft_delete(merge.upsert_files(before, seen), now))
    changed = merge.changed_files(before, files)
    left = merge.invalidate(changed, store.table("nodes"), store.table("chunks"), store.table("embeddings"), ledger)
    finished = left["pipeline_state"].filter(F.col("status") == "done").select("file_id").distinct()
    todo = files.filter("deleted_at IS NULL").join(finished, "file_id", "left_anti").select("file_id", "path", "content_class")
    todo = store.stage("todo", todo)
    stamp = F.lit(now).cast("long").alias("checkpoint_at")
    running = todo.select("file_id", F.lit("structural").alias("pass_name"), F.lit("running").alias("status"), stamp, F.lit(None).cast("string").alias("error_message"))
    store.commit(pipeline_state=ledger.filter("status <> 'running'").join(todo.select("file_id"), "file_id", "left_anti").unionByName(running))

    indexable = todo.filter(F.col("content_class").isin(*INDEXABLE))
    paths = [r.path for r in indexable.select("path").limit(LISTED + 1).collect()]
    scheme = root.rstrip("/").removesuffix(root_path(root).rstrip("/"))
    where = [scheme + p for p in paths] if len(paths) <= LISTED and not any(set(p) & set("*?[]{}\\") for p in paths) else root
    parsed = store.stage("parsed", parse_files(indexable, contents(spark, where)) if paths else spark.createDataFrame([], f"file_id long, path string, parsed struct<{PARSED}>"))
    nodes, chunks = node_rows(parsed, now), chunk_rows(parsed)
    row = lambda df, status, error: df.select("file_id", status.alias("status"), error.alias("error_message"))
    fail = F.col("parsed.error")
    status = F.when(fail == "binary_content_detected", "skipped").when(fail.isNotNull(), "failed").otherwise("done")
    skipped = todo.filter(~F.col("content_class").isin(*INDEXABLE))
    outcome = row(parsed, status, fail).unionByName(row(skipped, F.lit("skipped"), F.concat(F.lit("class "), F.col("content_class"))))
    passes = ["structural", "chunker"] + (["embeddings"] if embedder else [])
    rows = outcome.withColumn("pass_name", F.explode(F.when(F.col("status") == "failed", F.array(F.lit("structural"))).otherwise(F.array(*map(F.lit, passes)))))
    rows = rows.select("file_id", "pass_name", "status", stamp, "error_message")
    vectors = left["embeddings"].unionByName(embed(chunks, embedder)) if embedder else left["embeddings"]
    all_chunks = store.stage("chunks", left["chunks"].unionByName(chunks))
    inverted = store.stage("postings", search.by_term(store.table("postings").join(all_chunks.select("chunk_id"), "chunk_id", "left_semi").select(*POSTINGS.names).unionByName(search.count_words(chunks))))
    store.commit(
        files=files, nodes=left["nodes"].unionByName(nodes), chunks=all_chunks, embeddings=vectors, postings=inverted, terms=search.term_counts(inverted), corpus=search.corpus_of(all_chunks, inverted),
        pipeline_state=left["pipeline_state"].filter("status <> 'running'").join(todo.select("file_id"), "file_id", "left_anti").unionByName(rows),
    )
    rate = failure_rate(store.table("pipeline_state")).first()
    return {"files": store.table("files").filter("deleted_at IS NULL").count(), "failed": rate.failed or 0, "severity": rate.severity, "most_bytes": MOST_BYTES}


def index_of(store: Store) -> search.Inverted:
    """The inverted index of a store's current version."""
    return search.Inverted(store.table("postings"), store.table("terms"), store.table("corpus"))


def search_store(store: Store, request: Request, embedder: Callable[[str], list[int]] | None = None) -> Response:
    """A broad search over a store's current version. Vectors of another quantisation than this engine's close the vector channel."""
    files, nodes, chunks, embeddings = (store.table(t) for t in ("files", "nodes", "chunks", "embeddings"))
    return search_broadly(request, files, nodes, chunks, embeddings, index_of(store), embedder, store.semantic_compatible(LABEL))
