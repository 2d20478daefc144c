"""The rest of the engine's queries: sources, symbols, tools, streams, stores and rules, over rows made from the driver's tables.

Where an operator reads files, the query writes them below the shared folder first, from a small table. Where its result is a
rule's verdict, the SQL states the verdicts.
"""

from __future__ import annotations

import json
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import scalars as X
from .functions.wordpiece import QueryEmbedder, WordPiece
from .operators import admin, browse, catalog, chunks, fusion, merge, nodes, search, symbols
from .operators import tools as tool_sources
from .plans import index as indexing
from .queries import _BM25, _BROWSE, _HYDRATE, LATER, QUERY, TOKENS, asked_vector, files, index_of, knn, later, ledger, line_chunks, node_view, query, resources, table, texts, tools, vectors
from .schema import CHUNKS, FILES, NODES
from .session import shared_folder, spread
from .sources import audit, config
from .sources import files as folders
from .sources.store import Store
from .streaming import watch


def constants(rows: list[tuple], columns: str) -> str:
    """SQL of fixed rows."""

    def literal(v) -> str:
        return "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, (int, float)) else "'" + str(v).replace("'", "''") + "'"

    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in rows)}) AS t({columns})"


def place(spark: SparkSession, what: str) -> str:
    return f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"


def write_file(spark: SparkSession, path: str, body: bytes) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    out.write(bytearray(body))
    out.close()


def delete_file(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def fails(what) -> str:
    """The beginning of the error that a call raises; empty if there is none."""
    try:
        what()
    except (ValueError, KeyError, RuntimeError) as e:
        return str(e.args[0]).split(":")[0]
    return ""


# ---- requests ---------------------------------------------------------------------------------------------------


@query("clamp_k", constants([(-3, 20), (0, 20), (1, 1), (7, 7), (100, 100), (101, 100), (9999, 100)], "k, clamped"))
def _(spark, d):
    return spark.createDataFrame([(k, X.clamp_k(k)) for k in (-3, 0, 1, 7, 100, 101, 9999)], "k int, clamped int")


_RAW = ["config: value", 're-index "now"', "(retry) OR NOT logic", "c++ AND go", "?! @#", "term " * 70 + "alpha", "a" * 5000]


@query("fts_sanitise", constants([("config,value", 2), ("re,index,now", 3), ("retry,or,not,logic", 4), ("c,and,go", 3), ("", 0), (",".join(["term"] * 64), 64), ("a" * 4096, 1)], "terms, n"))
def _(spark, d):
    return spark.createDataFrame([(",".join(t), len(t)) for t in map(search.query_terms, _RAW)], "terms string, n int")


@query("fts_no_terms", constants([(0, "ok", "full", "EMPTY_BUT_EXECUTED")], "n, status, completeness, source"))
def _(spark, d):
    out = fusion.search_broadly(fusion.Request("?! @#", "lexical", deadline=None), files(spark, d), node_view(spark, d), line_chunks(spark, d), index=index_of(spark, d))
    return spark.createDataFrame([(out.hits.count(), out.status, out.completeness, out.sources[0].status)], "n int, status string, completeness string, source string")


@query("vector_join", _BM25 + "SELECT k.node_id * 10 AS node_id, k.chunk_id, round(k.score, 9) AS score FROM knn k JOIN texts t ON t.chunk_id = k.chunk_id")
def _(spark, d):
    """Nearest vectors, cut before the join with their chunks."""
    held = texts(spark, d).withColumn("node_id", F.col("node_id") * 10)
    return search.vector_search(vectors(spark, d), held, asked_vector(spark, d), dimension=64).select("node_id", "chunk_id", F.round("score", 9).alias("score"))


@query("vector_gate", constants([("CONTRACT_ERROR", "DEGRADED", True, False, "index has other")], "wrong_size, closed, same, other, reason"))
def _(spark, d):
    v = vectors(spark, d)
    store = Store(spark, place(spark, "gate"))
    store.write_fingerprint(model="m", model_version="1", dimension=64, chunk_policy="p", quantization="other")
    closed = store.semantic_compatible(indexing.LABEL)
    row = (
        fails(lambda: search.vector_search(v, None, [1, 2, 3], dimension=64)),
        fails(lambda: search.vector_search(v, None, [0] * 64, gate=closed)),
        store.semantic_compatible("other")[0],
        *closed,
    )
    return spark.createDataFrame([row], "wrong_size string, closed string, same boolean, other boolean, reason string")


def broad(spark: SparkSession, d: str, request: fusion.Request, **more) -> fusion.Response:
    return fusion.search_broadly(request, files(spark, d), node_view(spark, d), line_chunks(spark, d), index=index_of(spark, d), **more)


_HITS = "SELECT f.node_id, round(score, 12) AS score, coalesce(path, '') AS path, coalesce(name, '') AS title, {} AS snippet FROM {} f LEFT JOIN nodes n ON f.node_id = n.node_id LEFT JOIN files USING (file_id) LEFT JOIN firsts x ON f.node_id = x.node_id"
_LEXICAL = _HYDRATE + ", lex AS (SELECT node_id, sum(1 / (60 + r)) AS score FROM (SELECT node_id, row_number() OVER (ORDER BY score DESC, node_id, chunk_id) AS r FROM fts) GROUP BY node_id) "


def cut(n: int) -> str:
    return f"CASE WHEN strlen(one) > {n} THEN array_to_string(list_filter([left(one, n) for n in range({n // 2}, {n + 1}) if strlen(left(one, n)) <= {n}], lambda x: true)[-1:], '') || '…' ELSE coalesce(one, '') END"


@query("broad_lexical", _LEXICAL + _HITS.format(cut(120), "lex"))
def _(spark, d):
    hits = broad(spark, d, fusion.Request(QUERY, "lexical", "brief", deadline=None)).hits
    return hits.select("node_id", F.round("score", 12).alias("score"), "path", "title", "snippet")


_AUTO = _HYDRATE + """, two AS (SELECT node_id, sum(1 / (60 + r)) AS score FROM (
  SELECT node_id, row_number() OVER (ORDER BY score DESC, node_id, chunk_id) AS r FROM fts
  UNION ALL SELECT k.node_id, row_number() OVER (ORDER BY score DESC, k.node_id, k.chunk_id) FROM knn k JOIN texts t ON t.chunk_id = k.chunk_id
) GROUP BY node_id ORDER BY score DESC, node_id LIMIT 20) """


@query("broad_auto", _AUTO + _HITS.format(cut(400).replace("one", "t.text"), "two").replace(" LEFT JOIN firsts x ON f.node_id = x.node_id", " LEFT JOIN texts t ON f.node_id = t.node_id"))
def _(spark, d):
    """All three channels side by side; no path holds the request's words."""
    request = fusion.Request(QUERY, vector=asked_vector(spark, d), deadline=None)
    hits = fusion.search_broadly(request, files(spark, d), node_view(spark, d), texts(spark, d), vectors(spark, d), index_of(spark, d)).hits
    return hits.select("node_id", F.round("score", 12).alias("score"), "path", "title", "snippet")


@query(
    "broad_states",
    constants(
        [
            ("fts failed, auto", "degraded", "partial", "fts", True, "database query failed", fusion.PARTIAL),
            ("fts failed, lexical", "error", "full", "fts", False, "database query failed", ""),
            ("no embedder, auto", "ok", "full", "", False, "", ""),
            ("no embedder, semantic", "error", "partial", "vector", False, "", fusion.PARTIAL),
            ("late", "degraded", "partial", "", False, "", "deadline exceeded"),
            ("gate closed, semantic", "error", "full", "vector", False, "embedding operation failed", ""),
        ],
        '"case", status, completeness, failed, retryable, error, warnings',
    ),
)
def _(spark, d):
    class Broken:
        def __getattr__(self, name):
            raise RuntimeError("SQL logic error in fts")

    def slow(_):
        import time

        time.sleep(10)
        return [0] * 64

    f, n, c = spark.createDataFrame([], FILES), spark.createDataFrame([], NODES), spark.createDataFrame([], CHUNKS)
    e = vectors(spark, d)
    ask = lambda mode="auto", deadline=None, **more: fusion.search_broadly(fusion.Request("fox", mode, deadline=deadline), f, n, c, **more)
    ok = search.invert(c.select("chunk_id", "node_id", "text"))
    got = {
        "fts failed, auto": ask(index=Broken()),
        "fts failed, lexical": ask("lexical", index=Broken()),
        "no embedder, auto": ask(index=ok),
        "no embedder, semantic": ask("semantic"),
        "late": ask("auto", 8.0, embeddings=e, embedder=slow, index=search.Inverted(*(spark.createDataFrame([], s) for s in ("term string, chunk_id long, node_id long, tf long, dl long", "term string, df long", "n long, total long")))),
        "gate closed, semantic": ask("semantic", embeddings=e, embedder=lambda q: [0] * 64, gate=(False, "x")),
    }
    rows = [(k, r.status, r.completeness, ",".join(r.failed_sources), r.retryable, "".join(s.error_message for s in r.sources), " ".join(r.warnings)) for k, r in got.items()]
    return spark.createDataFrame(rows, "`case` string, status string, completeness string, failed string, retryable boolean, error string, warnings string")


_ERRORS = [
    ("SQL logic error", "database query failed"), ("sqlite: timeout", "database query failed"), ("embedder is closed", "embedding operation failed"), ("context deadline exceeded", "operation timed out"),
    ("i/o timeout", "operation timed out"), ("connection reset", "service connection failed"), ("refused", "service connection failed"), ("disk on fire", "internal error"), ("", ""),
]


@query("safe_errors", constants(_ERRORS, "raw, safe"))
def _(spark, d):
    return spark.createDataFrame([(raw, fusion.safe_error(raw)) for raw, _ in _ERRORS], "raw string, safe string")


@query("render_hits", _HYDRATE + "SELECT row_number() OVER (ORDER BY score DESC, f.node_id) AS rank, row_number() OVER (ORDER BY score DESC, f.node_id) || '. ' || coalesce(path, '') || ' [' || matched_sources || '] ' || coalesce(name, '') AS line FROM fused f LEFT JOIN nodes n ON f.node_id = n.node_id LEFT JOIN files USING (file_id)")
def _(spark, d):
    own = fusion.fuse({"fts": search.fts_search(texts(spark, d), QUERY, index=index_of(spark, d)), "vector": knn(spark, d), "filename": search.filename_search(files(spark, d), node_view(spark, d), TOKENS)})
    shaped = fusion.shape(own, node_view(spark, d), files(spark, d), line_chunks(spark, d), "brief")
    return fusion.render(shaped.withColumn("snippet", F.concat(F.lit("\u202e\x07"), "title", F.lit("\u200f"))))


@query("batch_isolation", constants([("a", "1", None), ("b", None, "b: no such node"), ("c", "3", None), ("33", None, "CONTRACT_ERROR")], "op, result, warning"))
def _(spark, d):
    def broken():
        raise KeyError("no such node")

    out = [(r["op"], None if r["result"] is None else str(r["result"]), r["warning"] and r["warning"].replace("'", "")) for r in nodes.batch([("a", lambda: 1), ("b", broken), ("c", lambda: 3)])]
    return spark.createDataFrame([*out, ("33", None, fails(lambda: nodes.batch([("x", lambda: 1)] * 33)))], "op string, result string, warning string")


@query("get_empty", constants([(0, 0, "NOT_FOUND", "text/plain", 12)], "nodes, chunks, missing, mime, size"))
def _(spark, d):
    blobs = spark.createDataFrame([(5, b"", "text/plain", 12, 1)], "blob_id long, sha256 binary, blob_type string, size long, refcount long")
    got = nodes.get_blob(blobs, 5)
    row = (nodes.get_nodes(node_view(spark, d), files(spark, d), []).count(), nodes.get_chunks(line_chunks(spark, d), []).count(), fails(lambda: nodes.get_blob(blobs, 6)), got["mime"], got["size"])
    return spark.createDataFrame([row], "nodes int, chunks int, missing string, mime string, size int")


@query("graph_expand", "SELECT 0 AS node_id, 0 AS depth UNION ALL SELECT DISTINCT 100 + n_nationkey, 1 FROM nation WHERE n_regionkey = 0 UNION ALL SELECT DISTINCT 1000 + s_suppkey, 2 FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 0")
def _(spark, d):
    """Regions lead to nations, nations to suppliers; without a depth there is nothing."""
    a = table(spark, d, "nation").select(F.col("n_regionkey").cast("long").alias("src_node"), (F.lit(100) + F.col("n_nationkey")).cast("long").alias("dst_node"))
    b = table(spark, d, "supplier").select((F.lit(100) + F.col("s_nationkey")).cast("long").alias("src_node"), (F.lit(1000) + F.col("s_suppkey")).cast("long").alias("dst_node"))
    edges = a.unionByName(b)
    return search.graph_expand(edges, [0], 2, 1 << 30).unionByName(search.graph_expand(edges, [1]))


@query("capabilities", constants([("features", "fts,vector,filename,metadata,browse,batch"), ("schema_version", "3"), ("semantics_version", "1"), ("server_version", "0.1"), ("wire_version", "3")], "name, value"))
def _(spark, d):
    return spark.createDataFrame([(k, ",".join(v) if isinstance(v, list) else str(v)) for k, v in admin.capabilities().items()], "name string, value string")


@query("browse_page2", _BROWSE.format(f="/src2/de", p="/src2/de/", n=9, k=2, o=2))
def _(spark, d):
    first = browse.browse(files(spark, d), "/src2/de", size=2)
    return browse.browse_rows(files(spark, d), "/src2/de", first.next_cursor or X.encode_cursor(2), 2)


@query("browse_states", constants([("/none", "NOT_FOUND", ""), ("/", "OK", ""), ("/src1", "OK", ""), ("bad cursor", "OK", "Mg==")], "folder, status, next_cursor"))
def _(spark, d):
    f = files(spark, d)
    got = [("/none", browse.browse(f, "/none")), ("/", browse.browse(f, "")), ("/src1", browse.browse(f, "\\src1\\")), ("bad cursor", browse.browse(f, "/src1/en", "??", 2))]
    return spark.createDataFrame([(n, p.status, p.next_cursor) for n, p in got], "folder string, status string, next_cursor string")


@query("query_embed", constants([("0,0,127,127", "0,0,0,0", "60,80,0,0")], "two, none, scaled"))
def _(spark, d):
    """Two tokens whose hidden states are unit vectors, clipped; a request without known tokens; another scale."""
    import numpy as np

    words = WordPiece({t: i for i, t in enumerate(["[PAD]", "[UNK]", "[CLS]", "[SEP]", "red", "ring"])}, length=8)
    embed = QueryEmbedder(words, lambda ids, mask, types: np.array([[[0, 0, float(i == 4), float(i == 5)] for i in row] for row in ids]))
    small = QueryEmbedder(words, lambda ids, mask, types: np.array([[[3.0, 4.0, 0.0, 0.0]] * 8]), scale=100)
    join = lambda v: ",".join(map(str, v))
    return spark.createDataFrame([(join(embed("red ring")), join(embed("zzz")), join(small("red")))], "two string, none string, scaled string")


# ---- files and content ----------------------------------------------------------------------------------------------

_MAGIC = [
    ("89504E470D0A1A0A00", "image/png", "image"), ("FFD8FFE0", "image/jpeg", "image"), ("4749463839", "image/gif", "image"), ("255044462D31", "application/pdf", "unknown"), ("504B0304", "application/zip", "unknown"),
    ("3C68746D6C3E", "text/html; charset=utf-8", "document"), ("68656C6C6F", "text/plain; charset=utf-8", "document"), ("610062", "application/octet-stream", "unknown"),
]


@query("mime_sniff", "SELECT p_partkey, CASE p_size % 8 " + " ".join(f"WHEN {i} THEN '{m}'" for i, (_, m, _) in enumerate(_MAGIC)) + " END AS mime, CASE p_size % 8 " + " ".join(f"WHEN {i} THEN '{c}'" for i, (_, _, c) in enumerate(_MAGIC)) + " END AS content_class, p_size % 8 IN (0, 7) AS is_binary FROM part")
def _(spark, d):
    sample = F.unhex(F.element_at(F.array(*(F.lit(h) for h, _, _ in _MAGIC)), 1 + F.col("p_size") % 8))
    rows = table(spark, d, "part").withColumn("sample", sample)
    mime = X.mime_of(F.col("sample"))
    return rows.select("p_partkey", mime.alias("mime"), X.content_class(F.concat(F.lit("/x/f"), F.col("p_partkey").cast("string")), mime, F.col("sample")).alias("content_class"), X.is_binary(F.col("sample")).alias("is_binary"))


@query("class_gate", """SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN 'code' WHEN 2 THEN 'document' WHEN 3 THEN 'image' WHEN 5 THEN 'document' ELSE 'unknown' END AS content_class, p_size % 6 IN (0, 2, 5) AS indexed FROM part""")
def _(spark, d):
    """Code and documents with NUL bytes are unknown, binary documents excepted; only code and documents are indexed."""
    n = F.col("p_size") % 6
    path = F.concat(F.lit("/f"), F.element_at(F.array(*map(F.lit, (".py", ".py", ".PDF", ".png", ".md", ".md"))), 1 + n))
    body = F.when(n.isin(1, 2, 4), F.unhex(F.lit("610062"))).otherwise(F.unhex(F.lit("6162")))
    cls = X.content_class(path, F.lit("application/octet-stream"), body)
    return table(spark, d, "part").select("p_partkey", cls.alias("content_class"), cls.isin(*indexing.INDEXABLE).alias("indexed"))


@query("binary_body", "SELECT doc_id, doc_id % 3 = 0 AS is_binary, CASE WHEN doc_id % 3 = 0 THEN 'binary_content_detected' END AS failure FROM documents")
def _(spark, d):
    """A NUL byte anywhere in the body counts."""
    text = F.encode("text", "UTF-8")
    body = F.when(F.col("doc_id") % 3 == 0, F.concat(text, F.unhex(F.lit("00")), text)).otherwise(text)
    found = X.is_binary(body)
    return table(spark, d, "documents").select("doc_id", found.alias("is_binary"), F.when(found, "binary_content_detected").alias("failure"))


def nation_folder(spark: SparkSession, d: str, where: str) -> list:
    """A folder of 25 small files, a few of them of other kinds, and what a walk has to leave out."""
    rows = table(spark, d, "nation").orderBy("n_nationkey").collect()
    for r in rows:
        write_file(spark, f"{where}/r{r.n_regionkey}/{r.n_name}.md", f"{r.n_name} lies in region {r.n_regionkey}\n\nThe end of {r.n_name}".encode())
    write_file(spark, f"{where}/code/a.py", _SOURCE.encode())
    write_file(spark, f"{where}/code/broken.py", b"def f(:\n")
    write_file(spark, f"{where}/data/x.csv", b"a,b\n1,2\n")
    write_file(spark, f"{where}/data/bin.md", b"a\0b")
    write_file(spark, f"{where}/_posts/_draft.md", b"draft")
    write_file(spark, f"{where}/.github/ci.md", b"checks")
    write_file(spark, f"{where}/code/__init__.py", b"x = 1")
    write_file(spark, f"{where}/.hidden.md", b"hidden")
    write_file(spark, f"{where}/.git/config.md", b"hidden")
    write_file(spark, f"{where}/node_modules/x/y.md", b"hidden")
    write_file(spark, f"{where}/.env", b"A=1")
    return rows


_SOURCE = "class A:\n    def m(self):\n        return 1\n\ndef f():\n    return 2\n"
_OTHERS = f"('code/a.py', {len(_SOURCE)}, 'code'), ('code/broken.py', 8, 'code'), ('data/x.csv', 8, 'data'), ('data/bin.md', 3, 'unknown'), ('_posts/_draft.md', 5, 'document'), ('.github/ci.md', 6, 'document'), ('code/__init__.py', 5, 'code')"
_NATIONS = """SELECT 'r' || n_regionkey || '/' || n_name || '.md' AS path, CAST(length(n_name || ' lies in region ' || n_regionkey) + 2 + length('The end of ' || n_name) AS BIGINT) AS size, 'document' AS content_class FROM nation"""


def below(path: str, where: str) -> Column:
    return F.substring(F.col(path), len(folders.root_path(where)) + 1, 1 << 20)


@query("folder_walk", f"{_NATIONS} UNION ALL SELECT * FROM (VALUES {_OTHERS}) AS t(path, size, content_class)")
def _(spark, d):
    where = place(spark, "walk")
    nation_folder(spark, d, where)
    return folders.walk(spark, where, 1000).select(below("path", where).alias("path"), "size", "content_class")


@query("index_run", "SELECT n_name || '.md' AS name, 'file' AS node_type, 'prose' AS chunk_kind, n_name || ' lies in region ' || n_regionkey || chr(10) || chr(10) || 'The end of ' || n_name AS text, 'done' AS status FROM nation UNION ALL SELECT * FROM (VALUES ('A', 'class', 'code_ast', 'class A:' || chr(10) || '    def m(self):' || chr(10) || '        return 1', 'done'), ('m', 'method', 'code_ast', 'def m(self):' || chr(10) || '        return 1', 'done'), ('f', 'function', 'code_ast', 'def f():' || chr(10) || '    return 2', 'done'), ('broken.py', 'file', 'code_fallback', 'def f(:' || chr(10), 'done'), ('_draft.md', 'file', 'prose', 'draft', 'done'), ('ci.md', 'file', 'prose', 'checks', 'done'), ('__init__.py', 'file', 'code_fallback', 'x = 1', 'done')) AS t(name, node_type, chunk_kind, text, status)")
def _(spark, d):
    """A whole run: walk, parse, chunks, ledger."""
    where, root = place(spark, "work"), place(spark, "store")
    nation_folder(spark, d, where)
    store = Store(spark, root)
    indexing.index_folder(spark, store, where, 1000)
    done = store.table("pipeline_state").filter("pass_name = 'chunker'").select("file_id", "status")
    return store.table("nodes").join(store.table("chunks"), "node_id").join(done, "file_id").select("name", "node_type", "chunk_kind", "text", "status")


@query("index_rerun", "SELECT n_name || '.md' AS name, n_nationkey = 3 AS deleted, CASE n_nationkey WHEN 5 THEN 'changed' WHEN 3 THEN 'old' ELSE 'old' END AS body FROM nation UNION ALL SELECT 'new.md', false, 'added'")
def _(spark, d):
    """A second run after one file has gone, one has changed and one has come; ids of files that stay are kept."""
    where, root = place(spark, "work"), place(spark, "store")
    rows = nation_folder(spark, d, where)
    for other in ("code", "data", "_posts", ".github"):
        delete_file(spark, f"{where}/{other}")
    store = Store(spark, root)
    indexing.index_folder(spark, store, where, 1000)
    before = store.table("files").select("path", F.col("file_id").alias("old_id"))
    delete_file(spark, f"{where}/r{rows[3].n_regionkey}/{rows[3].n_name}.md")
    write_file(spark, f"{where}/r{rows[5].n_regionkey}/{rows[5].n_name}.md", b"changed")
    write_file(spark, f"{where}/new.md", b"added")
    indexing.index_folder(spark, store, where, 2000)
    f, n, c = (store.table(t) for t in ("files", "nodes", "chunks"))
    kept = f.join(before, "path", "left").filter(F.coalesce(F.col("old_id") == F.col("file_id"), F.lit(True)))
    body = F.when(F.col("text").isin("changed", "added"), F.col("text")).otherwise("old")
    return kept.join(n.select("file_id", "node_id"), "file_id", "left").join(c.select("node_id", "text"), "node_id", "left").select(X.base_name(F.col("path")).alias("name"), F.col("deleted_at").isNotNull().alias("deleted"), body.alias("body"))


@query("index_search", "SELECT n_name || '.md' AS title FROM nation WHERE n_nationkey IN (7, 11) ")
def _(spark, d):
    """Search over what a run has written: its postings, not the texts."""
    where, root = place(spark, "work"), place(spark, "store")
    nation_folder(spark, d, where)
    for i, word in ((7, b"kangaroos"), (11, b"KANGAROO")):
        write_file(spark, f"{where}/r{spark_region(spark, d, i)}/NATION_{i}.md", b"a tale of " + word)
    store = Store(spark, root)
    indexing.index_folder(spark, store, where, 1000)
    return indexing.search_store(store, fusion.Request("kangaroo", "lexical", deadline=None)).hits.select("title")


def spark_region(spark: SparkSession, d: str, nation: int) -> int:
    return table(spark, d, "nation").filter(F.col("n_nationkey") == nation).first().n_regionkey


@query("scan_tools", constants([("greet", "src/a.py", "read_only"), ("delete_all", "src/a.py", "destructive"), ("deploy", "src/deploy.sh", "side_effects"), ("add", "src/m.ts", "read_only")], "name, source_file, risk"))
def _(spark, d):
    where = place(spark, "tools")
    for name, body in (("src/a.py", "def greet(n: str):\n    pass\n\ndef delete_all():\n    pass\n"), ("src/deploy.sh", "# Deploys\n"), ("src/m.ts", "export function add(x: number) {}\n"), ("test/b.py", "def no():\n    pass\n"), ("src/gen/c.py", "def no():\n    pass\n")):
        write_file(spark, f"{where}/{name}", body.encode())
    return folders.scan_tools(spark, where, ["src/**"], ["src/gen/**"]).select("name", below("source_file", where).alias("source_file"), "risk")


@query("scan_resources", constants([("a.csv", "text/csv", "data", 4), ("b.md", "text/markdown", "document", 1), ("c.yaml", "text/yaml", "config", 5)], "name, mime_type, resource_type, size_bytes"))
def _(spark, d):
    where = place(spark, "resources")
    for name, body in (("docs/a.csv", b"a,b\n"), ("docs/b.md", b"x"), ("docs/c.yaml", b"a: 1\n"), ("docs/code.py", b"x"), ("other/d.csv", b"x"), ("docs/e.unknown", b"x")):
        write_file(spark, f"{where}/{name}", body)
    return folders.scan_resources(spark, where, ["docs/*"]).select("name", "mime_type", "resource_type", "size_bytes")


@query("read_resource", "SELECT 'r' || p_partkey AS name, CASE WHEN p_size % 2 = 0 THEN p_name ELSE to_base64(encode(p_name)) END AS body FROM part")
def _(spark, d):
    """Text as it is, anything else in base64."""
    rows = table(spark, d, "part").select(F.concat(F.lit("r"), F.col("p_partkey").cast("string")).alias("name"), F.when(F.col("p_size") % 2 == 0, "text/csv").otherwise("image/png").alias("mime_type"), F.encode("p_name", "UTF-8").alias("content"))
    return folders.read_resource(rows)


@query("json_extract", "SELECT name, json_extract_string(input_schema, '$.type') AS language, CAST(json_extract(input_schema, '$.size') AS BIGINT) AS size FROM tools")
def _(spark, d):
    return tools(spark, d).select("name", F.get_json_object("input_schema", "$.type").alias("language"), F.get_json_object("input_schema", "$.size").cast("long").alias("size"))


@query("redact_truncate", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'key [REDACTED] of number ' || doc_id ELSE left('AKIA is none, nor is a short sk-abc, in number ' || doc_id, 40) || '... [output truncated at 40 bytes]' END AS text FROM documents")
def _(spark, d):
    i = F.col("doc_id").cast("string")
    text = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("key sk-"), F.repeat(F.lit("a1"), F.lit(15)), F.lit(" of number "), i)).otherwise(F.concat(F.lit("AKIA is none, nor is a short sk-abc, in number "), i))
    return table(spark, d, "documents").select("doc_id", X.redact(text, 40).alias("text"))


# ---- symbols, chunks, tools --------------------------------------------------------------------------------------------


def _n() -> Column:
    return F.col("p_partkey").cast("string")


def parts(spark: SparkSession, d: str) -> DataFrame:
    """Parts for Python functions, which take far longer than the scan: even millions of parts are a few MB, which is one task."""
    return spread(table(spark, d, "part"))


@query("code_symbols", "SELECT p_partkey, unnest([{'kind': 'class', 'name': 'C' || p_partkey, 'a': 1, 'b': 3}, {'kind': 'method', 'name': 'm' || p_partkey, 'a': 2, 'b': 3}, {'kind': 'function', 'name': 'f' || p_partkey, 'a': 6, 'b': 7}], recursive := true) FROM part")
def _(spark, d):
    @F.pandas_udf(symbols.SYMBOLS)
    def run(s: pd.Series) -> pd.Series:
        return s.map(symbols.python_symbols)

    source = F.concat(F.lit("class C"), _n(), F.lit(":\n    def m"), _n(), F.lit("(self):\n        pass\n\n@deco\nasync def f"), _n(), F.lit("(x):\n    return 'é'\n"))
    return parts(spark, d).select("p_partkey", F.explode(run(source)).alias("s")).select("p_partkey", "s.kind", "s.name", F.col("s.line_start").alias("a"), F.col("s.line_end").alias("b"))


@query("go_symbols", "SELECT p_partkey, unnest([{'kind': 'struct', 'name': 'S' || p_partkey, 'a': 3, 'b': 5}, {'kind': 'interface', 'name': 'I' || p_partkey, 'a': 7, 'b': 7}, {'kind': 'type', 'name': 'T', 'a': 8, 'b': 8}, {'kind': 'method', 'name': 'M' || p_partkey, 'a': 10, 'b': 12}, {'kind': 'function', 'name': 'F', 'a': 13, 'b': 13}], recursive := true) FROM part")
def _(spark, d):
    @F.pandas_udf(symbols.SYMBOLS)
    def run(s: pd.Series) -> pd.Series:
        return s.map(symbols.go_symbols)

    source = F.concat(
        F.lit("package p\n// func no() {}\ntype S"), _n(), F.lit(" struct {\n\tx int\n}\ntype (\n\tI"), _n(), F.lit(" interface{ M() }\n\tT = int\n)\nfunc (a *S) M"), _n(), F.lit('() string {\n\treturn "func x() {"\n}\nfunc F[T any](x T) {}\n')
    )
    return parts(spark, d).select("p_partkey", F.explode(run(source)).alias("s")).select("p_partkey", "s.kind", "s.name", F.col("s.line_start").alias("a"), F.col("s.line_end").alias("b"))


@query("code_chunks", "SELECT p_partkey, 'code_ast' AS chunk_kind, 'def f' || p_partkey || '():' || chr(10) || '    return 1' AS text, CAST(3 AS BIGINT) AS byte_start FROM part UNION ALL SELECT p_partkey, 'code_fallback', 'x' || p_partkey || ' = 1', 0 FROM part WHERE p_partkey % 2 = 1 UNION ALL SELECT p_partkey, 'code_fallback', 'long', CAST(n AS BIGINT) FROM part, (SELECT unnest([1, 2]) AS n) WHERE p_partkey % 100 = 0")
def _(spark, d):
    """A symbol is a chunk; a source without symbols is a fallback; an oversize symbol is cut."""

    @F.pandas_udf("array<struct<text string, byte_start long, chunk_kind string>>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: [{k: c[k] for k in ("text", "byte_start", "chunk_kind")} for c in chunks.chunk_code(t, symbols.python_symbols(t))])

    part = parts(spark, d)
    one = part.select("p_partkey", F.explode(run(F.concat(F.lit("#\n\ndef f"), _n(), F.lit("():\n    return 1\n")))).alias("c"))
    none = part.filter("p_partkey % 2 = 1").select("p_partkey", F.explode(run(F.concat(F.lit("x"), _n(), F.lit(" = 1")))).alias("c"))
    long_ = part.filter("p_partkey % 100 = 0").select("p_partkey", F.posexplode(run(F.concat(F.lit("def g():\n"), F.repeat(F.lit("    x = 1 + 2\n"), F.lit(75))))).alias("n", "c"))
    cut_ = long_.select("p_partkey", "c.chunk_kind", F.lit("long").alias("text"), (F.col("n") + 1).cast("long").alias("byte_start"))
    return one.unionByName(none).select("p_partkey", "c.chunk_kind", "c.text", "c.byte_start").unionByName(cut_)


@query("token_counter", "SELECT p_partkey, CAST(3 AS BIGINT) AS by_words, CAST(2 AS BIGINT) AS by_library FROM part")
def _(spark, d):
    """Tokens are words, or what a tokenizer file makes of a text."""
    import public_tokenizers

    count = chunks.library_count(public_tokenizers.path("word_bpe_49k.json"))

    @F.pandas_udf("by_words long, by_library long")
    def run(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"by_words": s.map(chunks.word_count), "by_library": s.map(lambda t: count(t.rsplit(" ", 1)[0]))})

    return parts(spark, d).select("p_partkey", run(F.concat(F.lit("the of "), _n())).alias("r")).select("p_partkey", "r.*")


_VOCABULARY = ["[PAD]", "[UNK]", "[CLS]", "[SEP]", "[MASK]", "red", "ring", "small", "wid", "##get", "!", "brand"]


@query("wordpiece", "SELECT p_partkey, '2,11,1,10,' || array_to_string(list_transform(string_split(p_name, ' '), lambda w: CASE w WHEN 'red' THEN '5' WHEN 'ring' THEN '6' WHEN 'small' THEN '7' WHEN 'widget' THEN '8,9' ELSE '1' END), ',') || ',3' AS ids, CAST(5 + list_sum(list_transform(string_split(p_name, ' '), lambda w: CASE WHEN w = 'widget' THEN 2 ELSE 1 END)) AS BIGINT) AS n FROM part")
def _(spark, d):
    """Brand is lowered and loses its accent, the number is unknown, the mark is a word of its own; then the part's name."""
    words = WordPiece({t: i for i, t in enumerate(_VOCABULARY)}, 32)
    text = F.concat(F.lit("BRÁND 77! "), "p_name")
    e = parts(spark, d).select("p_partkey", words.column(text).alias("e"))
    n = F.aggregate("e.mask", F.lit(0).cast("long"), lambda s, x: s + x)
    return e.select("p_partkey", F.array_join(F.slice("e.ids", F.lit(1), n.cast("int")), ",").alias("ids"), n.alias("n"))


def extracted(spark: SparkSession, d: str, path: str, source: Column) -> DataFrame:
    @F.pandas_udf(tool_sources.TOOL)
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: tool_sources.tools_of(path, t))

    return parts(spark, d).select("p_partkey", F.explode(run(source)).alias("t")).select("p_partkey", "t.*")


@query("python_tools", """SELECT p_partkey, unnest([
  {'name': 'get_' || p_partkey, 'description': 'Doc ' || p_partkey || '. Returns: str.', 'input_schema': '{"type": "object", "properties": {"a": {"type": "integer"}, "b": {"type": "array"}}, "required": ["a"]}', 'risk': 'read_only', 'language': 'python'},
  {'name': 'given' || p_partkey, 'description': 'said', 'input_schema': '{"type": "object", "properties": {}}', 'risk': 'network', 'language': 'python'},
  {'name': 'delete_it', 'description': '(async) Tool: delete_it', 'input_schema': '{"type": "object", "properties": {}}', 'risk': 'destructive', 'language': 'python'},
  {'name': 'peek', 'description': '(async) Tool: peek', 'input_schema': '{"type": "object", "properties": {}}', 'risk': 'side_effects', 'language': 'python'}], recursive := true) FROM part""")
def _(spark, d):
    source = F.concat(
        F.lit("def get_"), _n(), F.lit('(a: int, b: list[str] = []) -> str:\n    "Doc '), _n(), F.lit('."\n\n@tool(name="given'), _n(), F.lit('", risk="network", description="said")\ndef f():\n    pass\n\ndef _no():\n    pass\n\nasync def delete_it():\n    pass\n\nasync def peek():\n    pass\n')
    )
    return extracted(spark, d, "x.py", source)


@query("script_tools", """SELECT p_partkey, unnest([
  {'name': 'add' || p_partkey, 'description': 'Adds. Twice.', 'input_schema': '{"type": "object", "properties": {"x": {"type": "number"}, "y": {"type": "array"}}, "required": ["x"]}', 'risk': 'read_only', 'language': 'typescript'},
  {'name': 'g', 'description': 'Tool: g', 'input_schema': '{"type": "object", "properties": {"s": {"type": "string"}}, "required": ["s"]}', 'risk': 'read_only', 'language': 'typescript'},
  {'name': 'h', 'description': 'Tool: h', 'input_schema': '{"type": "object", "properties": {"o": {"type": "object"}, "n": {"type": "string"}}, "required": ["o"]}', 'risk': 'read_only', 'language': 'typescript'},
  {'name': 'main', 'description': 'Tool: main', 'input_schema': '{"type": "object", "properties": {}}', 'risk': 'read_only', 'language': 'typescript'},
  {'name': 'k' || p_partkey, 'description': 'Tool: k' || p_partkey, 'input_schema': '{"type": "object", "properties": {"m": {"type": "boolean"}}, "required": ["m"]}', 'risk': 'read_only', 'language': 'typescript'}], recursive := true) FROM part""")
def _(spark, d):
    source = F.concat(
        F.lit("/**\n * Adds.\n * Twice.\n * @param x\n */\nexport async function add"), _n(),
        F.lit("(x: number, y?: string[]) {}\nexport const g = (s: string) => s\nexport const h = function (o: object, n = 1) {}\nexport default function main() {}\nexport function _p() {}\n// export function no() {}\nmodule.exports.k"), _n(), F.lit(" = async function(m: boolean) {}\n"),
    )
    return extracted(spark, d, "x.ts", source)


@query("shell_tools", "SELECT p_partkey, 'deploy' AS name, CASE WHEN p_size % 2 = 0 THEN 'Deploys ' || p_partkey ELSE 'Runs deploy.sh' END AS description, 'side_effects' AS risk FROM part")
def _(spark, d):
    source = F.concat(F.lit("#!/bin/sh\n\n"), F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("# Deploys "), _n())).otherwise("echo"), F.lit("\n# later\n"))
    return extracted(spark, d, "/x/deploy.sh", source).select("p_partkey", "name", "description", "risk")


@query("openapi_tools", """SELECT p_partkey, unnest([
  {'name': 'delete_pets__id_', 'description': 'Gone', 'input_schema': '{"type": "object", "properties": {"id": {"type": "string"}}, "required": ["id"]}', 'risk': 'destructive', 'language': 'openapi'},
  {'name': 'find' || p_partkey, 'description': 'GET /pets/{id}', 'input_schema': '{"type": "object", "properties": {"q": {"type": "integer", "description": "how many"}}}', 'risk': 'read_only', 'language': 'openapi'},
  {'name': 'post_pets', 'description': 'Long text', 'input_schema': '{"type": "object", "properties": {"name": {"type": "string"}}, "required": ["name"]}', 'risk': 'side_effects', 'language': 'openapi'}], recursive := true) FROM part""")
def _(spark, d):
    ok = {"200": {"description": "ok"}}
    spec = {
        "openapi": "3.0.0", "info": {"title": "t", "version": "1"},
        "paths": {
            "/pets/{id}": {"delete": {"summary": "Gone", "parameters": [{"name": "id", "in": "path", "required": True, "schema": {"type": "string"}}], "responses": ok}, "get": {"operationId": "find@", "parameters": [{"name": "q", "in": "query", "schema": {"$ref": "#/components/schemas/Q"}}], "responses": ok}, "parameters": [{"name": "id", "in": "path", "required": True, "schema": {}}]},
            "/pets": {"post": {"description": "Long text", "requestBody": {"content": {"application/json": {"schema": {"type": "object", "properties": {"name": {"type": "string"}}, "required": ["name"]}}}}, "responses": ok}},
        },
        "components": {"schemas": {"Q": {"type": "integer", "description": "how many"}}},
    }
    return extracted(spark, d, "x.json", F.replace(F.lit(json.dumps(spec)), F.lit("@"), _n()))


@query("operation_names", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'op' || p_partkey ELSE 'post_a__id__b' END AS name, CASE p_size % 3 WHEN 0 THEN 'short' WHEN 1 THEN 'long' ELSE 'POST /a/{id}/b' END AS description FROM part")
def _(spark, d):
    n, size = F.lit("post"), F.col("p_size")
    path, nothing = F.lit("/a/{id}/b"), F.lit("")
    return parts(spark, d).select(
        "p_partkey", X.operation_name(F.when(size % 2 == 0, F.concat(F.lit("op"), _n())).otherwise(nothing), n, path).alias("name"),
        X.operation_description(F.when(size % 3 == 0, "short").otherwise(nothing), F.when(size % 3 != 2, "long").otherwise(nothing), n, path).alias("description"),
    )


@query("imports", "SELECT p_partkey, 'numpy,p' || p_partkey || ',pandas' AS python, '@s/p,lodash,q' || p_partkey AS script FROM part")
def _(spark, d):
    """Third-party packages by their first names, scoped ones by two parts."""

    @F.pandas_udf("python string, script string")
    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"python": a.map(lambda t: ",".join(tool_sources.imports_of("x.py", t))), "script": b.map(lambda t: ",".join(tool_sources.imports_of("x.ts", t)))})

    py = F.concat(F.lit("import os, numpy.linalg\nfrom pandas.io import x\nfrom . import y\nimport p"), _n(), F.lit("\n"))
    ts = F.concat(F.lit("import a from '@s/p/q'\nimport './local'\nconst b = require('fs'), c = require('node:path')\nimport { d } from \"lodash/fp\"\nrequire('q"), _n(), F.lit("')\n"))
    return parts(spark, d).select("p_partkey", run(py, ts).alias("r")).select("p_partkey", "r.python", "r.script")


# ---- catalogue rules -----------------------------------------------------------------------------------------------


@query("gauges", "SELECT 'tools_total' AS gauge, count(*) AS value FROM tools UNION ALL SELECT 'tools_enabled', count(*) FROM tools WHERE state = 'enabled'")
def _(spark, d):
    return catalog.gauges(tools(spark, d))


@query("catalog_risk_enabled", "SELECT 'tool' AS kind, name, state, risk, source_file AS source FROM tools WHERE risk = 'side_effects' AND state = 'enabled'")
def _(spark, d):
    return catalog.catalog(tools(spark, d), resources(spark, d), state="enabled", risk="side_effects")


@query("catalog_resources", "SELECT 'resource' AS kind, name, state, CAST(NULL AS VARCHAR) AS risk, file_path AS source FROM resources WHERE state = 'pending'")
def _(spark, d):
    return catalog.catalog(tools(spark, d), resources(spark, d), kind="resource", state="pending")


@query("resource_upsert", "SELECT name, CASE WHEN name LIKE '%5' THEN '/moved' ELSE file_path END AS file_path, state FROM resources UNION ALL SELECT 'resource_new', '/new', 'pending'")
def _(spark, d):
    r = resources(spark, d)
    found = r.filter("name LIKE '%5'").select("name", F.lit("/moved").alias("file_path"), F.lit("pending").alias("state")).unionByName(spark.createDataFrame([("resource_new", "/new", "pending")], "name string, file_path string, state string"))
    return catalog.upsert_resources(r, found)


@query("review", "SELECT name, CASE name WHEN 'tool_1' THEN 'enabled' WHEN 'tool_2' THEN 'disabled' WHEN 'tool_3' THEN 'requires_confirmation' ELSE state END AS state, CASE WHEN name IN ('tool_1', 'tool_2', 'tool_3') AND state = CASE name WHEN 'tool_1' THEN 'enabled' WHEN 'tool_2' THEN 'disabled' ELSE 'requires_confirmation' END THEN 'already ' || state END AS error FROM tools")
def _(spark, d):
    return catalog.review(tools(spark, d), ["tool_1"], ["tool_2"], ["tool_3"]).select("name", "state", "error")


@query("review_conflicts", constants([("conflict", "resource r can't require confirmation", "unknown profile none")], "twice, resource, profile"))
def _(spark, d):
    t = tools(spark, d)
    row = (fails(lambda: catalog.review(t, ["a"], ["a"])), fails(lambda: catalog.review(t, confirm=["r"], resources=["r"])), fails(lambda: catalog.profile_names({}, "none")))
    return spark.createDataFrame([row], "twice string, resource string, profile string")


@query("transitions", "SELECT a AS old, b AS new, CASE WHEN b = 'odd' THEN 'unknown state odd' WHEN a = b THEN 'already ' || b WHEN a = 'odd' THEN 'unknown state odd' END AS error FROM (SELECT unnest(['pending', 'enabled', 'disabled', 'requires_confirmation', 'odd']) AS a), (SELECT unnest(['pending', 'enabled', 'disabled', 'requires_confirmation', 'odd']) AS b)")
def _(spark, d):
    names = ["pending", "enabled", "disabled", "requires_confirmation", "odd"]
    rows = spark.createDataFrame([(a, b) for a in names for b in names], "old string, new string")
    return rows.withColumn("error", catalog.transition_error(F.col("old"), F.col("new")))


@query("initialise", "SELECT name, CASE WHEN name LIKE '%7' THEN 'enabled' ELSE state END AS state, CASE WHEN name LIKE '%8' THEN 'network' ELSE risk END AS risk, CASE WHEN name LIKE '%9' THEN '{}' ELSE input_schema END AS input_schema FROM tools")
def _(spark, d):
    """States and risks of the configuration; a schema that is no JSON becomes {}."""
    t = tools(spark, d)
    t = t.withColumn("input_schema", F.when(F.col("name").endswith("9"), "no json {").otherwise(F.col("input_schema")))
    over = t.filter("name LIKE '%7'").select("name", F.lit("enabled").alias("state"), F.lit(None).cast("string").alias("risk")).unionByName(t.filter("name LIKE '%8'").select("name", F.lit(None).cast("string").alias("state"), F.lit("network").alias("risk")))
    return catalog.initialise(t, over).select("name", "state", "risk", "input_schema")


@query("agent_card", "SELECT 'card' AS card, '2' AS version, name, description FROM tools WHERE state IN ('enabled', 'requires_confirmation') AND name LIKE '%1'")
def _(spark, d):
    t = tools(spark, d)
    card = catalog.agent_card(t.filter("name LIKE '%1'"), "card", "2")
    parsed = card.select(F.from_json("card", "name string, version string, tools array<struct<name string, description string, input_schema string>>").alias("c"))
    return parsed.select(F.col("c.name").alias("card"), "c.version", F.explode("c.tools").alias("t")).select("card", "version", "t.name", "t.description")


@query("invocation_hash", "SELECT name, CASE WHEN state = 'disabled' THEN 'deny: disabled' WHEN state = 'pending' THEN 'deny: pending' WHEN dep_state IN ('resolving', 'failed') THEN 'error: dependencies ' || dep_state ELSE 'deny: content changed' END AS decision FROM tools")
def _(spark, d):
    return catalog.invocation(tools(spark, d), F.lit("another hash"))


# ---- state, streams, configuration ------------------------------------------------------------------------------------


@query("ledger_upsert", "SELECT file_id, pass_name, CASE WHEN file_id % 10 = 0 THEN 'running' ELSE status END AS status FROM ledger UNION ALL SELECT -1, 'structural', 'done'")
def _(spark, d):
    held = ledger(spark, d)
    new = held.filter("file_id % 10 = 0").withColumn("status", F.lit("running")).unionByName(spark.createDataFrame([(-1, "structural", "done", None)], held.schema))
    return merge.record_status(held, new).select("file_id", "pass_name", "status")


@query("invalidated_rows", LATER + ", gone AS (SELECT a.file_id FROM files a JOIN later b ON a.path = b.path WHERE a.sha256 <> b.sha256) SELECT chunk_id, node_id FROM chunks WHERE node_id NOT IN (FROM gone)")
def _(spark, d):
    changed = merge.changed_files(files(spark, d), later(spark, d).filter("path NOT LIKE '/new%'"))
    return merge.invalidate(changed, node_view(spark, d), line_chunks(spark, d), vectors(spark, d), ledger(spark, d))["chunks"].select("chunk_id", "node_id")


@query("vector_upsert_rows", "SELECT chunk_id, array_to_string(CASE WHEN chunk_id % 2 = 0 THEN list_transform(embedding, lambda x: -x) ELSE embedding END, ',') AS v FROM vectors")
def _(spark, d):
    v = vectors(spark, d)
    new = v.filter("chunk_id % 2 = 0").withColumn("embedding", F.transform("embedding", lambda x: (-x).cast("tinyint")))
    return merge.write_vectors(v, new, 64).select("chunk_id", F.array_join(F.col("embedding").cast("array<string>"), ",").alias("v"))


@query("mean_pool", """SELECT vec_id, round(x[1] / l, 9) AS first, round(list_sum(list_transform(x, lambda v: v / l)), 6) AS total FROM (
  SELECT vec_id, x, sqrt(list_sum(list_transform(x, lambda v: v * v))) AS l FROM (
    SELECT vec_id, list_transform(list_zip(embedding, list_reverse(embedding)), lambda p: CAST(p[1] AS DOUBLE) + (CASE WHEN vec_id % 2 = 1 THEN CAST(p[2] AS DOUBLE) ELSE 0 END)) AS x FROM embeddings))""")
def _(spark, d):
    """Three token vectors: one that counts, one that counts in every second row, one that doesn't."""
    e = F.col("embedding").cast("array<double>")
    pooled = X.mean_pool(F.array(e, F.reverse(e), e), F.array(F.lit(1), (F.col("vec_id") % 2).cast("int"), F.lit(0)))
    rows = table(spark, d, "embeddings").select("vec_id", pooled.alias("x"))
    return rows.select("vec_id", F.round(F.col("x")[0], 9).alias("first"), F.round(F.aggregate("x", F.lit(0.0), lambda s, v: s + v), 6).alias("total"))


@query("int8_cosine_agreement", ", asked AS (SELECT embedding AS q FROM embeddings ORDER BY vec_id LIMIT 1), s AS (SELECT list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(q AS DOUBLE[])) AS c FROM (SELECT * FROM embeddings ORDER BY vec_id LIMIT 64), asked) SELECT count(*) AS pairs, true AS agrees FROM s a JOIN s b ON a.c - b.c >= 0.1")
def _(spark, d):
    """Of the pairs among 64 vectors that cosine tells apart by a tenth, the int8 order turns next to none around."""
    q = table(spark, d, "embeddings").orderBy("vec_id").first().embedding
    e = F.col("embedding").cast("array<double>")
    dot = F.aggregate(F.zip_with(e, F.lit([float(x) for x in q]), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    length = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    cos = dot / (length(e) * length(F.lit([float(x) for x in q])))
    asked = X.quantize(F.lit([float(x) for x in q]))
    rows = table(spark, d, "embeddings").orderBy("vec_id").limit(64).select("vec_id", cos.alias("c"), X.l2_distance(X.quantize(F.col("embedding")), asked).alias("l"))
    a, b = rows.select(F.col("c").alias("c1"), F.col("l").alias("l1")), rows.select(F.col("c").alias("c2"), F.col("l").alias("l2"))
    pairs = a.join(b, F.col("c1") - F.col("c2") >= 0.1).agg(F.count("*").alias("pairs"), F.count_if(F.col("l1") >= F.col("l2")).alias("wrong"))
    return pairs.select("pairs", (F.col("wrong") < 0.005 * F.col("pairs")).alias("agrees"))


def written_log(spark: SparkSession, d: str) -> str:
    where = place(spark, "audit")
    rows = table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("timestamp"), F.concat(F.lit("t"), F.col("event_id").cast("string")).alias("tool_name"), F.col("event_type").alias("action"), F.col("props").alias("params"), F.lit(None).cast("string").alias("caller"), F.lit("ok").alias("result_status"))
    audit.append(rows, where)
    return where


@query("audit_tail", "SELECT strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS timestamp, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') || ' ' || event_type || ' t' || event_id || ' ok' AS line FROM events ORDER BY date_trunc('second', ts) DESC, line LIMIT 50")
def _(spark, d):
    """A line that can't be parsed has no time and comes after all others."""
    where = written_log(spark, d)
    write_file(spark, f"{where}/odd.json", b"not json\n")
    return audit.tail(spark, where)


@query("audit_rotation", constants([(10, 10, 5)], "log, backup, before"))
def _(spark, d):
    """A log that has reached its size becomes the one backup."""
    where = place(spark, "rotated")
    row = table(spark, d, "events").limit(5).select(F.lit(None).cast("timestamp").alias("timestamp"), F.lit("t").alias("tool_name"), F.lit("a").alias("action"), F.lit("p").alias("params"), F.lit("c").alias("caller"), F.lit("ok").alias("result_status"))
    audit.append(row, where)
    before = audit.read(spark, where).count()
    audit.append(row, where)
    audit.append(row, where, most_bytes=1)
    audit.append(row, where)
    return spark.createDataFrame([(audit.read(spark, where).count(), audit.read(spark, f"{where}.1").count(), before)], "log int, backup int, before int")


def drained(spark: SparkSession, stream: DataFrame) -> DataFrame:
    """All that a stream gives for what is there now."""
    out, mark = place(spark, "stream"), place(spark, "mark")
    stream.writeStream.format("parquet").option("checkpointLocation", mark).option("path", out).outputMode("append").trigger(availableNow=True).start().awaitTermination(600)
    return spark.read.schema(stream.schema).parquet(out)


@query("audit_follow", "SELECT event_type AS action, count(*) AS n FROM events GROUP BY event_type")
def _(spark, d):
    return drained(spark, audit.follow(spark, written_log(spark, d))).groupBy("action").agg(F.count("*").alias("n"))


@query("watch_stream", LATER + "SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'created' WHEN b.path IS NULL THEN 'deleted' ELSE 'modified' END AS change, CAST(1 AS BIGINT) AS snapshot FROM files a FULL JOIN later b ON a.path = b.path WHERE a.path IS NULL OR b.path IS NULL OR a.mtime <> b.mtime OR a.size <> b.size")
def _(spark, d):
    """Two snapshots of a folder as a stream; the first one is silent."""
    where = place(spark, "snapshots")
    old, new = files(spark, d).select("path", "mtime", "size"), later(spark, d).select("path", "mtime", "size")
    rows = [
        old.select(F.lit(0).cast("long").alias("snapshot"), "path", "mtime", "size", F.lit(False).alias("deleted")),
        new.select(F.lit(1).cast("long").alias("snapshot"), "path", "mtime", "size", F.lit(False).alias("deleted")),
        old.join(new, "path", "left_anti").select(F.lit(1).cast("long").alias("snapshot"), "path", "mtime", "size", F.lit(True).alias("deleted")),
    ]
    rows[0].unionByName(rows[1]).unionByName(rows[2]).write.json(where)
    return drained(spark, watch.changes(watch.snapshots(spark, where)))


@query("watch_poll", constants([("a.md", "modified"), ("b.md", "deleted"), ("c.md", "created"), ("failed scans", "2 then a warning"), ("scans", "1")], "path, change"))
def _(spark, d):
    import threading
    import time

    where = place(spark, "polled")
    for name in ("a.md", "b.md"):
        write_file(spark, f"{where}/{name}", b"x")
    w = watch.Watcher(spark, where, state=place(spark, "watch"))
    w.poll()
    write_file(spark, f"{where}/a.md", b"longer")
    delete_file(spark, f"{where}/b.md")
    write_file(spark, f"{where}/c.md", b"x")
    buffer, stop, scans = watch.EventBuffer(), threading.Event(), []
    w.run(lambda: (scans.append(time.time()), stop.set()), buffer, stop, every=0.1)
    broken = watch.Watcher(spark, place(spark, "nothing"), state=place(spark, "watch"))
    said = [broken.poll()[1] is not None for _ in range(3)]
    rows = [(p.rsplit("/", 1)[1], c) for p, c in buffer.drain()]
    return spark.createDataFrame([*rows, ("failed scans", f"{said.index(True)} then a warning"), ("scans", str(len(scans)))], "path string, change string")


@query("event_buffer", constants([(64, 6, 0, "2 seconds", "5 seconds")], "held, dropped, after, local, network"))
def _(spark, d):
    b = watch.EventBuffer()
    for i in range(70):
        b.put(i)
    return spark.createDataFrame([(len(b.drain()), b.dropped, len(b.drain()), watch.interval(False), watch.interval(True))], "held int, dropped int, after int, local string, network string")


@query("store_versions", constants([(1, 0, 1, 5, "fingerprint mismatch", "has tables (communities) and no manifest", indexing.LABEL)], "old_reader, new_reader, snapshot, schema_version, drift, lost, label"))
def _(spark, d):
    """Readers keep their version; a snapshot is a store; steps above the schema version run in order; another fingerprint is an error; a store that has lost its manifests isn't taken for an empty one."""
    root, copy = place(spark, "store"), place(spark, "copy")
    schema = "community_id long, label string, size long"
    store = Store(spark, root)
    parts = {"model": "m", "model_version": "1", "dimension": 4, "chunk_policy": "p", "quantization": indexing.LABEL}
    store.write_fingerprint(**parts)
    store.commit(communities=spark.createDataFrame([(1, "a", 2)], schema))
    store.snapshot(copy)
    reader = Store(spark, root)
    store.commit(communities=spark.createDataFrame([], schema))
    version = store.migrate({5: lambda s: None, 4: lambda s: None, 2: None})
    drift = fails(lambda: Store(spark, root).check_fingerprint(**(parts | {"dimension": 5})))
    row = [reader.table("communities").count(), Store(spark, root).table("communities").count(), Store(spark, copy).table("communities").count(), version, drift]
    for name in store._manifests():
        delete_file(spark, f"{root}/{name}")
    try:
        lost = str(Store(spark, root).manifest)
    except ValueError as e:
        lost = str(e).removeprefix(f"{root} ")
    return spark.createDataFrame([(*row, lost, store.manifest["fingerprint"]["quantization"])], "old_reader int, new_reader int, snapshot int, schema_version int, drift string, lost string, label string")


@query("configuration", constants([("missing", "1"), ("version 2", "unsupported version 2"), ("version 0", "1"), ("include", "src/**"), ("approved", "enabled"), ("A", "x y"), ("B", "1"), ("C", "=z")], "name, value"))
def _(spark, d):
    import tempfile
    from pathlib import Path

    with tempfile.TemporaryDirectory() as t:  # small files of the driver
        p = Path(t) / "c.yaml"
        rows = [("missing", str(config.load(str(p))["version"]))]
        p.write_text("version: 2\n")
        rows.append(("version 2", fails(lambda: config.load(str(p)))))
        p.write_text("tools: {}\n")
        rows.append(("version 0", str(config.load(str(p))["version"])))
        config.save(str(p), {"version": 1, "scan": {"include": ["src/**"]}})
        rows.append(("include", config.load(str(p))["scan"]["include"][0]))
        config.save_approvals(str(p), {"tools": {"f": {"state": "enabled"}}})
        rows.append(("approved", config.load_approvals(str(p))["tools"]["f"]["state"]))
        (Path(t) / ".env").write_text("# c\nA = 'x y'\nB=1\n\nC=\"=z\"\nno\n")
        rows += sorted(config.load_dotenv(t).items())
    return spark.createDataFrame(rows, "name string, value string")
