"""The engine's operators over the driver's tables, and the SQL that says the same.

Views of the engine's shape come from the driver's tables: a file for each document, a chunk for each line (for
keyword search, each document), vectors from ``embeddings``, the audit log from ``events``, tools from ``part``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import scalars as X
from .functions.porter import fold, stem, tokens
from .operators import admin, browse, catalog, chunks, fusion, merge, nodes, search
from .session import shared_folder, spread

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
QUERY, TOKENS = "Thes re thtied", "src7 en"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = VIEWS + sql
        return f

    return add


#: The same views for DuckDB.
VIEWS = r"""
WITH files AS (
  SELECT doc_id AS file_id, '/' || source || '/' || lang || '/doc_' || lpad(CAST(doc_id AS VARCHAR), 6, '0') || '.txt' AS path, '/' || source || '/' || lang AS parent_dir,
         CAST(strlen(text) AS BIGINT) AS size, sha256(text) AS sha256, 1704067200 + doc_id * 60 AS mtime,
         CASE lang WHEN 'en' THEN 'document' WHEN 'de' THEN 'code' ELSE 'data' END AS content_class, CASE WHEN source = 'src3' THEN 1704067200 END AS deleted_at
  FROM documents
),
nodes AS (SELECT doc_id AS node_id, doc_id AS file_id, 'file' AS node_type, 'doc_' || doc_id AS name, lang AS language, CAST(NULL AS BIGINT) AS deleted_at FROM documents),
texts AS (SELECT doc_id AS chunk_id, doc_id AS node_id, text FROM documents),
lines AS (
  SELECT doc_id * 100000 + generate_subscripts(string_split(text, chr(10)), 1) - 1 AS chunk_id, doc_id AS node_id, unnest(string_split(text, chr(10))) AS text FROM documents
),
chunks AS (SELECT * FROM lines WHERE text <> ''),
vectors AS (SELECT vec_id AS chunk_id, list_transform(embedding, lambda x: CAST(greatest(-127, least(127, round(CAST(x AS DOUBLE) * 256))) AS INTEGER)) AS embedding FROM embeddings),
ledger AS (
  SELECT event_id AS file_id, CASE WHEN event_type IN ('click', 'view') THEN 'structural' WHEN event_type = 'purchase' THEN 'chunker' ELSE 'embeddings' END AS pass_name,
         CASE WHEN value < 10 THEN 'failed' WHEN value < 20 THEN 'skipped' ELSE 'done' END AS status, CASE WHEN value < 10 THEN event_type || ': ' || CAST(floor(value) AS BIGINT) END AS error_message
  FROM events
),
tools AS (
  SELECT 'tool_' || p_partkey AS name, p_brand AS source_file, p_name AS description, '{"size": ' || p_size || ', "type": "' || p_type || '"}' AS input_schema,
         CASE WHEN p_size < 15 THEN 'read_only' WHEN p_size < 35 THEN 'side_effects' ELSE 'destructive' END AS risk,
         CASE WHEN p_size < 10 THEN 'pending' WHEN p_size < 25 THEN 'enabled' WHEN p_size < 40 THEN 'disabled' ELSE 'requires_confirmation' END AS state,
         CASE WHEN p_retailprice < 1000 THEN 'resolving' WHEN p_retailprice < 1400 THEN 'ready' ELSE 'failed' END AS dep_state, sha256(p_name) AS content_hash
  FROM part
),
resources AS (SELECT 'resource_' || s_suppkey AS name, '/' || s_name AS file_path, CASE WHEN s_acctbal < 0 THEN 'pending' ELSE 'enabled' END AS state FROM supplier)
"""


# ---- views ------------------------------------------------------------------------------------------------------


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def files(spark: SparkSession, d: str) -> DataFrame:
    folder = F.concat(F.lit("/"), "source", F.lit("/"), "lang")
    return table(spark, d, "documents").select(
        F.col("doc_id").alias("file_id"), F.concat(folder, F.lit("/doc_"), F.lpad(F.col("doc_id").cast("string"), 6, "0"), F.lit(".txt")).alias("path"), folder.alias("parent_dir"),
        F.octet_length("text").cast("long").alias("size"), X.content_hash(F.col("text")).alias("sha256"), (F.lit(1704067200) + F.col("doc_id") * 60).alias("mtime"),
        F.when(F.col("lang") == "en", "document").when(F.col("lang") == "de", "code").otherwise("data").alias("content_class"), F.when(F.col("source") == "src3", F.lit(1704067200).cast("long")).alias("deleted_at"),
    )


def node_view(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(
        F.col("doc_id").alias("node_id"), F.col("doc_id").alias("file_id"), F.lit("file").alias("node_type"), F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("name"), F.col("lang").alias("language"), F.lit(None).cast("long").alias("deleted_at")
    )


def texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("node_id"), "text")


def line_chunks(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    return rows.select((F.col("doc_id") * 100000 + F.col("pos")).alias("chunk_id"), F.col("doc_id").alias("node_id"), "text").filter("text <> ''")


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), X.quantize(F.col("embedding")).alias("embedding"))


def asked_vector(spark: SparkSession, d: str) -> list[int]:
    """The vector of the smallest id, as a request would bring it."""
    return vectors(spark, d).orderBy("chunk_id").first().embedding


def ledger(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_type")
    return table(spark, d, "events").select(
        F.col("event_id").alias("file_id"), F.when(e.isin("click", "view"), "structural").when(e == "purchase", "chunker").otherwise("embeddings").alias("pass_name"),
        F.when(F.col("value") < 10, "failed").when(F.col("value") < 20, "skipped").otherwise("done").alias("status"), F.when(F.col("value") < 10, F.concat(e, F.lit(": "), F.floor("value").cast("string"))).alias("error_message"),
    )


def tools(spark: SparkSession, d: str) -> DataFrame:
    size, price = F.col("p_size"), F.col("p_retailprice")
    return table(spark, d, "part").select(
        F.concat(F.lit("tool_"), F.col("p_partkey").cast("string")).alias("name"), F.col("p_brand").alias("source_file"), F.col("p_name").alias("description"),
        F.concat(F.lit('{"size": '), size.cast("string"), F.lit(', "type": "'), "p_type", F.lit('"}')).alias("input_schema"),
        F.when(size < 15, "read_only").when(size < 35, "side_effects").otherwise("destructive").alias("risk"),
        F.when(size < 10, "pending").when(size < 25, "enabled").when(size < 40, "disabled").otherwise("requires_confirmation").alias("state"),
        F.when(price < 1000, "resolving").when(price < 1400, "ready").otherwise("failed").alias("dep_state"), F.sha2("p_name", 256).alias("content_hash"),
    )


def resources(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").select(F.concat(F.lit("resource_"), F.col("s_suppkey").cast("string")).alias("name"), F.concat(F.lit("/"), "s_name").alias("file_path"), F.when(F.col("s_acctbal") < 0, "pending").otherwise("enabled").alias("state"))


def rescanned(spark: SparkSession, d: str) -> DataFrame:
    """Another scan of the tools: some gone, some new, some with another description or schema."""
    t = tools(spark, d)
    old = t.filter("source_file <> 'Brand#11'").withColumn("description", F.when(F.col("risk") == "destructive", F.upper("description")).otherwise(F.col("description")))
    new = t.filter("source_file = 'Brand#22'").withColumn("name", F.concat("name", F.lit("_v2")))
    return old.unionByName(new)


RESCANNED = """, rescanned AS (
  SELECT * REPLACE (CASE WHEN risk = 'destructive' THEN upper(description) ELSE description END AS description) FROM tools WHERE source_file <> 'Brand#11'
  UNION ALL SELECT * REPLACE (name || '_v2' AS name) FROM tools WHERE source_file = 'Brand#22'
)
"""

# ---- retrieval --------------------------------------------------------------------------------------------------

def surface_forms(query: str) -> dict[str, list[str]]:
    """For SQL, which has no stemmer: the forms without accents that the stems of a query have, built with common endings."""
    endings = ["", "s", "e", "es", "ed", "ing", "y", "ies", "ied", "er", "ers", "ation", "ness", "ful", "ly", "al", "able", "ment", "ou", "eed"]
    out = {}
    for t in search.query_terms(query):
        base = stem(fold(t))
        out[base] = sorted({w for a, b in product(endings, endings) if stem(w := base + a + b) == base} | {w for a in endings if stem(w := base[:-1] + "y" + a) == base})
    return out


FORMS = surface_forms(QUERY)
_STEM = "CASE " + " ".join(f"WHEN strip_accents(raw) IN ({', '.join(repr(w) for w in forms)}) THEN '{base}'" for base, forms in FORMS.items()) + " ELSE raw END"
_BM25 = r""", words AS (SELECT chunk_id, node_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS raw FROM texts),
tf AS (SELECT """ + _STEM + r""" AS term, chunk_id, count(*) AS tf FROM words GROUP BY ALL),
dl AS (SELECT chunk_id, node_id, len(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS dl FROM texts),
st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
fts AS (
  SELECT node_id, chunk_id, round(sum(CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 12) AS score
  FROM tf JOIN df USING (term) JOIN dl USING (chunk_id), st WHERE term IN (""" + ", ".join(map(repr, FORMS)) + r""") GROUP BY ALL ORDER BY score DESC, node_id, chunk_id LIMIT 20
),
asked AS (SELECT embedding AS q FROM vectors ORDER BY chunk_id LIMIT 1),
knn AS (
  SELECT chunk_id AS node_id, chunk_id, 1 / (1 + sqrt(CAST(list_sum(list_transform(list_zip(embedding, q), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS DOUBLE))) AS score
  FROM vectors, asked ORDER BY score DESC, chunk_id LIMIT 20
),
fname AS (
  SELECT node_id, CAST(NULL AS BIGINT) AS chunk_id, 1 / (1 + length(path) / 64) AS score FROM files JOIN nodes USING (file_id)
  WHERE files.deleted_at IS NULL AND lower(path) LIKE '%src7%' AND lower(path) LIKE '%en%' ORDER BY score DESC, node_id LIMIT 20
),
fused AS (
  SELECT node_id, sum(1 / (60 + r)) AS score, string_agg(source, ',' ORDER BY source) AS matched_sources FROM (
    SELECT node_id, 'fts' AS source, row_number() OVER (ORDER BY score DESC, node_id, chunk_id) AS r FROM fts
    UNION ALL SELECT node_id, 'vector', row_number() OVER (ORDER BY score DESC, node_id, chunk_id) FROM knn
    UNION ALL SELECT node_id, 'filename', row_number() OVER (ORDER BY score DESC, node_id, chunk_id) FROM fname
  ) GROUP BY node_id ORDER BY score DESC, node_id LIMIT 20
)
"""


def as_nodes(hits: DataFrame) -> DataFrame:
    return hits.select(F.col("chunk_id").alias("node_id"), "chunk_id", "score")


_INDEXES: dict[tuple[str, str], search.Inverted] = {}


def index_of(spark: SparkSession, d: str) -> search.Inverted:
    """The inverted index of a folder's texts. It is written once for a session, as index_folder leaves one in its store."""
    key = spark.sparkContext.applicationId, d
    if key not in _INDEXES:
        base = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"

        def write(rows: DataFrame, name: str) -> DataFrame:
            rows.write.parquet(f"{base}/{name}")
            return spark.read.schema(rows.schema).parquet(f"{base}/{name}")

        own = spread(texts(spark, d))
        rows = write(search.by_term(search.count_words(own)), "postings")
        _INDEXES[key] = search.Inverted(rows, write(search.term_counts(rows), "terms"), write(search.corpus_of(own, rows), "corpus"))
    return _INDEXES[key]


def fts(spark: SparkSession, d: str) -> DataFrame:
    return search.fts_search(texts(spark, d), QUERY, index=index_of(spark, d))


def knn(spark: SparkSession, d: str) -> DataFrame:
    return as_nodes(search.vector_search(vectors(spark, d), None, asked_vector(spark, d)))


def fname(spark: SparkSession, d: str) -> DataFrame:
    return search.filename_search(files(spark, d), node_view(spark, d), TOKENS)


def fused(spark: SparkSession, d: str) -> DataFrame:
    return fusion.fuse({"fts": fts(spark, d), "vector": knn(spark, d), "filename": fname(spark, d)})


def rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("score", F.round("score", 9))


@query("fts_bm25_topk", _BM25 + "SELECT node_id, chunk_id, round(score, 9) AS score FROM fts")
def _(spark, d):
    return rounded(fts(spark, d))


@query("vector_knn_l2", _BM25 + "SELECT node_id, chunk_id, round(score, 9) AS score FROM knn")
def _(spark, d):
    return rounded(knn(spark, d))


@query("filename_search", _BM25 + "SELECT node_id, round(score, 9) AS score FROM fname")
def _(spark, d):
    return rounded(fname(spark, d)).drop("chunk_id")


@query("metadata_search", "SELECT node_id, CAST(mtime AS FLOAT) AS score FROM files JOIN nodes USING (file_id) WHERE files.deleted_at IS NULL AND content_class = 'code' AND path ILIKE '/SRC1%' AND mtime >= 1704067300 ORDER BY mtime DESC, node_id LIMIT 20")
def _(spark, d):
    return search.metadata_search(files(spark, d), node_view(spark, d), "code", "/SRC1", since=1704067300).drop("chunk_id")


@query("rrf_hybrid", _BM25 + "SELECT node_id, round(score, 12) AS score, matched_sources FROM fused")
def hybrid(spark, d):
    return fused(spark, d).withColumn("score", F.round("score", 12))


_HYDRATE = _BM25 + """, ranked AS (SELECT node_id, text, row_number() OVER (PARTITION BY node_id ORDER BY chunk_id) AS rn FROM chunks),
firsts AS (SELECT node_id, string_agg(text, chr(10) || '---' || chr(10) ORDER BY rn) FILTER (WHERE rn <= 2) AS two, max(text) FILTER (WHERE rn = 1) AS one FROM ranked GROUP BY node_id)
"""


@query("hydrate_nodes", _HYDRATE + "SELECT f.node_id, round(score, 12) AS score, coalesce(path, '') AS path, coalesce(name, '') AS name, coalesce(two, '') AS body FROM fused f LEFT JOIN nodes n ON f.node_id = n.node_id LEFT JOIN files USING (file_id) LEFT JOIN firsts x ON f.node_id = x.node_id")
def _(spark, d):
    rows = nodes.hydrate(fused(spark, d), node_view(spark, d), files(spark, d), line_chunks(spark, d), 2)
    return rows.select("node_id", F.round("score", 12).alias("score"), F.coalesce("path", F.lit("")).alias("path"), F.coalesce("name", F.lit("")).alias("name"), F.coalesce(F.array_join("chunks", "\n---\n"), F.lit("")).alias("body"))


@query("search_full", _HYDRATE + "SELECT f.node_id, round(score, 12) AS score, matched_sources, coalesce(path, '') AS path, coalesce(name, '') AS title, two AS snippet FROM fused f LEFT JOIN nodes n ON f.node_id = n.node_id LEFT JOIN files USING (file_id) LEFT JOIN firsts x ON f.node_id = x.node_id")
def _(spark, d):
    return fusion.shape(fused(spark, d), node_view(spark, d), files(spark, d), line_chunks(spark, d), "full").withColumn("score", F.round("score", 12))


@query("snippet_shape", "SELECT doc_id, CASE WHEN strlen(text) > 120 THEN array_to_string(list_filter([left(text, n) for n in range(60, 121) if strlen(left(text, n)) <= 120], lambda x: true)[-1:], '') || '…' ELSE text END AS snippet FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", X.truncate_bytes(F.col("text"), 120, "…").alias("snippet"))


@query("get_nodes", "SELECT node_id, path, node_type, name FROM nodes JOIN files USING (file_id) WHERE node_id IN (1, 5, 17, 101) ORDER BY node_id")
def _(spark, d):
    return nodes.get_nodes(node_view(spark, d), files(spark, d), [1, 5, 17, 101])


@query("get_chunks", "SELECT chunk_id, node_id, text FROM chunks WHERE chunk_id IN (100000, 500001, 1700000) ORDER BY chunk_id")
def _(spark, d):
    return nodes.get_chunks(line_chunks(spark, d), [100000, 500001, 1700000])


@query("inspect_detail", "SELECT n.node_id, path, name, (SELECT string_agg(text, '|' ORDER BY chunk_id) FROM (SELECT chunk_id, text FROM chunks WHERE node_id = 17 ORDER BY chunk_id LIMIT 3)) AS body FROM nodes n JOIN files USING (file_id) WHERE n.node_id = 17")
def _(spark, d):
    return nodes.inspect(node_view(spark, d), files(spark, d), line_chunks(spark, d), 17, "standard").select("node_id", "path", "name", F.array_join("chunks", "|").alias("body"))


_BROWSE = """, listing AS (
  SELECT 'file' AS kind, path, regexp_extract(path, '[^/]*$') AS name FROM files WHERE deleted_at IS NULL AND parent_dir = '{f}'
  UNION ALL SELECT DISTINCT 'dir', '{p}' || string_split(substr(parent_dir, {n} + 1), '/')[1], string_split(substr(parent_dir, {n} + 1), '/')[1] FROM files WHERE deleted_at IS NULL AND starts_with(parent_dir, '{p}') AND substr(parent_dir, {n} + 1) <> ''
) SELECT * FROM listing ORDER BY path, kind LIMIT {k} OFFSET {o}"""


@query("browse_root", _BROWSE.format(f="/", p="/", n=1, k=50, o=0))
def _(spark, d):
    return browse.browse_rows(files(spark, d), "/")


@query("browse_folder", _BROWSE.format(f="/src1/en", p="/src1/en/", n=9, k=7, o=7))
def _(spark, d):
    return browse.browse_rows(files(spark, d), "src1//en/", X.encode_cursor(7), 7)


# ---- maintenance ------------------------------------------------------------------------------------------------


def later(spark: SparkSession, d: str) -> DataFrame:
    """A later walk: one folder gone, one changed, one new."""
    f = files(spark, d).filter("parent_dir <> '/src5/fr'")
    changed = F.col("parent_dir") == "/src6/de"
    f = f.withColumns({"sha256": F.when(changed, F.sha2("sha256", 256)).otherwise(F.col("sha256")), "mtime": F.when(changed, F.col("mtime") + 1).otherwise(F.col("mtime"))})
    new = files(spark, d).filter("parent_dir = '/src7/en'").withColumn("path", F.concat(F.lit("/new"), "path"))
    return f.unionByName(new)


LATER = """, later AS (
  SELECT * REPLACE (CASE WHEN parent_dir = '/src6/de' THEN sha256(sha256) ELSE sha256 END AS sha256, CASE WHEN parent_dir = '/src6/de' THEN mtime + 1 ELSE mtime END AS mtime) FROM files WHERE parent_dir <> '/src5/fr'
  UNION ALL SELECT * REPLACE ('/new' || path AS path) FROM files WHERE parent_dir = '/src7/en'
)
"""


@query("pending_files", "SELECT file_id, path FROM files WHERE deleted_at IS NULL AND NOT EXISTS (SELECT 1 FROM ledger l WHERE l.file_id = files.file_id AND pass_name = 'structural' AND status = 'done')")
def _(spark, d):
    return merge.pending_files(files(spark, d), ledger(spark, d), "structural").select("file_id", "path")


@query("sha_invalidate", LATER + ", gone AS (SELECT a.file_id FROM files a JOIN later b ON a.path = b.path WHERE a.sha256 <> b.sha256) SELECT 'nodes' AS t, count(*) AS n FROM nodes WHERE file_id NOT IN (FROM gone) UNION ALL SELECT 'chunks', count(*) FROM chunks WHERE node_id NOT IN (FROM gone) UNION ALL SELECT 'embeddings', count(*) FROM vectors WHERE chunk_id NOT IN (SELECT chunk_id FROM chunks WHERE node_id IN (FROM gone)) UNION ALL SELECT 'pipeline_state', count(*) FROM ledger WHERE file_id NOT IN (FROM gone)")
def _(spark, d):
    changed = merge.changed_files(files(spark, d), later(spark, d).filter("path NOT LIKE '/new%'"))
    left = merge.invalidate(changed, node_view(spark, d), line_chunks(spark, d), vectors(spark, d), ledger(spark, d))
    out = None
    for t, df in left.items():
        row = df.agg(F.count("*").alias("n")).select(F.lit(t).alias("t"), "n")
        out = row if out is None else out.unionByName(row)
    return out


@query("soft_delete_reconcile", "SELECT file_id, CASE WHEN deleted_at IS NULL AND mtime < 1704070000 THEN 1704070000 ELSE coalesce(deleted_at, -1) END AS deleted_at FROM files")
def _(spark, d):
    return merge.soft_delete(files(spark, d).withColumn("last_seen", F.col("mtime")), 1704070000).select("file_id", F.coalesce("deleted_at", F.lit(-1)).alias("deleted_at"))


@query("file_upsert", LATER + ", top AS (SELECT max(file_id) AS top FROM files) SELECT coalesce(a.file_id, top + row_number() OVER (PARTITION BY a.file_id IS NULL ORDER BY b.path)) AS file_id, coalesce(b.path, a.path) AS path, coalesce(b.sha256, a.sha256) AS sha256, coalesce(CASE WHEN b.path IS NULL THEN a.deleted_at END, -1) AS deleted_at FROM files a FULL JOIN later b ON a.path = b.path, top")
def _(spark, d):
    current = files(spark, d)
    return merge.upsert_files(current, later(spark, d).drop("file_id")).select("file_id", "path", "sha256", F.coalesce("deleted_at", F.lit(-1)).alias("deleted_at"))


@query("snapshot_diff", LATER + "SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'created' WHEN b.path IS NULL THEN 'deleted' ELSE 'modified' END AS change FROM files a FULL JOIN later b ON a.path = b.path WHERE a.path IS NULL OR b.path IS NULL OR a.mtime <> b.mtime OR a.size <> b.size")
def _(spark, d):
    return merge.snapshot_diff(files(spark, d), later(spark, d))


@query("vector_upsert", "SELECT chunk_id, CAST(list_sum(embedding) AS BIGINT) AS total FROM vectors")
def _(spark, d):
    v = vectors(spark, d)
    out = merge.write_vectors(v.withColumn("embedding", F.transform("embedding", lambda x: (-x).cast("tinyint"))), v, 64)
    return out.select("chunk_id", F.aggregate("embedding", F.lit(0).cast("long"), lambda s, x: s + x).alias("total"))


# ---- catalogue --------------------------------------------------------------------------------------------------


@query("catalog_union", "SELECT 'tool' AS kind, name, state, risk, source_file AS source FROM tools UNION ALL SELECT 'resource', name, state, NULL, file_path FROM resources")
def _(spark, d):
    return catalog.catalog(tools(spark, d), resources(spark, d))


@query("catalog_risk", "SELECT 'tool' AS kind, name, state, risk, source_file AS source FROM tools WHERE risk = 'destructive' AND state = 'disabled'")
def _(spark, d):
    return catalog.catalog(tools(spark, d), resources(spark, d), state="disabled", risk="destructive")


@query("catalog_diff", RESCANNED + "SELECT coalesce(a.name, b.name) AS name, CASE WHEN a.name IS NULL THEN '+' WHEN b.name IS NULL THEN '-' ELSE '~' END AS mark, CASE WHEN a.name IS NULL OR b.name IS NULL THEN '' ELSE 'description' END AS reasons FROM tools a FULL JOIN rescanned b ON a.name = b.name WHERE a.name IS NULL OR b.name IS NULL OR a.description <> b.description")
def _(spark, d):
    return catalog.catalog_diff(tools(spark, d), rescanned(spark, d))


@query("catalog_upsert", RESCANNED + "SELECT coalesce(b.name, a.name) AS name, coalesce(b.description, a.description) AS description, coalesce(a.state, b.state) AS state FROM tools a FULL JOIN rescanned b ON a.name = b.name")
def _(spark, d):
    return catalog.upsert_tools(tools(spark, d), rescanned(spark, d)).select("name", "description", "state")


@query("tool_name_dedup", ", named AS (SELECT source_file AS base, name AS id, row_number() OVER (PARTITION BY source_file ORDER BY name) AS n FROM tools) SELECT id, CASE WHEN n > 1 THEN base || '_' || n ELSE base END AS name FROM named")
def _(spark, d):
    t = tools(spark, d).select(F.col("source_file").alias("name"), F.col("name").alias("id"))
    return catalog.unique_names(t, ["id"]).select("id", "name")


@query("lifecycle_update", "SELECT name, CASE WHEN risk = 'destructive' AND state <> 'disabled' THEN 'disabled' ELSE state END AS state, CASE WHEN risk = 'destructive' AND state = 'disabled' THEN 'already disabled' END AS error FROM tools")
def _(spark, d):
    t = tools(spark, d)
    return catalog.update_states(t, t.filter("risk = 'destructive'").select("name", F.lit("disabled").alias("new_state"))).select("name", "state", "error")


@query("state_counts", "SELECT state, dep_state, count(*) AS n FROM tools GROUP BY GROUPING SETS ((state), (dep_state))")
def _(spark, d):
    return catalog.state_counts(tools(spark, d))


@query("exposure_profile", "SELECT name, state FROM tools WHERE state IN ('enabled', 'requires_confirmation') AND name IN (SELECT name FROM tools WHERE source_file = 'Brand#13')")
def _(spark, d):
    t = tools(spark, d)
    return catalog.exposed(t, t.filter("source_file = 'Brand#13'").select("name")).select("name", "state")


@query("invocation_gate", "SELECT name, CASE WHEN state = 'disabled' THEN 'deny: disabled' WHEN state = 'pending' THEN 'deny: pending' WHEN dep_state IN ('resolving', 'failed') THEN 'error: dependencies ' || dep_state WHEN state = 'requires_confirmation' THEN 'confirm' ELSE 'run' END AS decision FROM tools")
def _(spark, d):
    return catalog.invocation(tools(spark, d), F.sha2("description", 256))


@query("json_schema_equal", "SELECT name, p_size % 2 = 0 AS same FROM tools JOIN part ON name = 'tool_' || p_partkey")
def _(spark, d):
    """The same keys in another order, with another value in every second row."""
    t = tools(spark, d).join(table(spark, d, "part").select(F.concat(F.lit("tool_"), F.col("p_partkey").cast("string")).alias("name"), "p_type", "p_size"), "name")
    other = F.concat(F.lit('{"type":"'), "p_type", F.lit('",  "size":'), (F.col("p_size") + F.col("p_size") % 2).cast("string"), F.lit("}"))
    return t.select("name", X.json_equal(F.col("input_schema"), other).alias("same"))


# ---- administration ---------------------------------------------------------------------------------------------


@query("status_counts", "SELECT 'files' AS key, count(*) AS n FROM files WHERE deleted_at IS NULL UNION ALL SELECT 'indexed', count(DISTINCT file_id) FROM nodes UNION ALL SELECT pass_name || '_' || status, count(*) FROM ledger GROUP BY ALL")
def _(spark, d):
    return admin.status_counts(files(spark, d), node_view(spark, d), ledger(spark, d))


@query("failure_histogram", "SELECT substr(error_message, 1, 80) AS prefix, count(*) AS n FROM ledger WHERE status = 'failed' GROUP BY 1 ORDER BY n DESC, prefix LIMIT 3")
def _(spark, d):
    return admin.failure_histogram(ledger(spark, d))


@query("failure_rate", ", x AS (SELECT count(*) FILTER (WHERE status = 'failed') AS failed, count(*) AS attempted FROM ledger) SELECT failed, attempted, round(failed / attempted, 9) AS rate, CASE WHEN failed / attempted > 0.1 THEN 'ERROR' WHEN failed / attempted > 0.01 THEN 'WARN' ELSE 'INFO' END AS severity FROM x")
def _(spark, d):
    return admin.failure_rate(ledger(spark, d)).withColumn("rate", F.round("rate", 9))


@query("health", "SELECT 'nodes without file' AS \"check\", (SELECT count(*) FROM nodes WHERE file_id NOT IN (SELECT file_id FROM files)) AS broken UNION ALL SELECT 'chunks without node', (SELECT count(*) FROM texts WHERE node_id NOT IN (SELECT node_id FROM nodes)) UNION ALL SELECT 'vectors without chunk', (SELECT count(*) FROM vectors WHERE chunk_id NOT IN (SELECT chunk_id FROM texts))")
def _(spark, d):
    return admin.health(files(spark, d), node_view(spark, d), texts(spark, d), vectors(spark, d))


@query("audit_recent", "SELECT event_id AS id, event_type AS action, props AS params FROM events ORDER BY id DESC LIMIT 100")
def _(spark, d):
    return admin.audit_recent(table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("action"), F.col("props").alias("params")))


@query("audit_redact", "SELECT doc_id, " + "regexp_replace(" * len(X.SECRETS) + "text" + "".join(f", '{p}', '[REDACTED]', 'g')" for p in X.SECRETS) + " AS text FROM documents")
def _(spark, d):
    return spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", X.redact(F.col("text")).alias("text"))


# ---- scalars, quality -------------------------------------------------------------------------------------------


_EXTENSIONS = ("py", "MD", "pdf", "png", "mkv", "csv", "bin", "d/noext")


@query("classify_files", ", p AS (SELECT p_partkey, ['" + "', '".join(_EXTENSIONS) + "'][1 + p_size % 8] AS ext FROM part) SELECT p_partkey, CASE ext WHEN 'py' THEN 'code' WHEN 'MD' THEN 'document' WHEN 'pdf' THEN 'document' WHEN 'png' THEN 'image' WHEN 'mkv' THEN 'media' WHEN 'csv' THEN 'data' ELSE 'unknown' END AS content_class FROM p")
def _(spark, d):
    ext = F.element_at(F.array(*map(F.lit, _EXTENSIONS)), 1 + F.col("p_size") % 8)
    return table(spark, d, "part").select("p_partkey", X.content_class(F.concat(F.lit("/x/y."), ext)).alias("content_class"))


_RISK = "CASE " + " ".join(f"WHEN regexp_matches(lower(p_name), '{'|'.join(words)}') THEN '{risk}'" for risk, words in X.RISK_WORDS) + " ELSE 'read_only' END"


@query("risk_by_name", f"SELECT p_partkey, {_RISK} AS risk FROM part")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", X.risk_by_name(F.col("p_name")).alias("risk"))


@query("risk_by_method", "SELECT o_orderkey, CASE WHEN left(o_orderpriority, 1) = '1' THEN 'read_only' WHEN left(o_orderpriority, 1) = '2' THEN 'destructive' ELSE 'side_effects' END AS risk FROM orders")
def _(spark, d):
    p = F.left("o_orderpriority", F.lit(1))
    return table(spark, d, "orders").select("o_orderkey", X.risk_by_method(F.when(p == "1", "get").when(p == "2", "DELETE").otherwise("post")).alias("risk"))


@query("content_hash", "SELECT doc_id, 'sha256:' || sha256(text) AS hash, true AS verified FROM documents")
def _(spark, d):
    h = X.content_hash(F.col("text"), True)
    return table(spark, d, "documents").select("doc_id", h.alias("hash"), X.verify_hash(F.col("text"), F.upper(h)).alias("verified"))


@query("quantize_int8", "SELECT chunk_id, array_to_string(embedding, ',') AS v FROM vectors")
def _(spark, d):
    return vectors(spark, d).select("chunk_id", F.array_join(F.col("embedding").cast("array<string>"), ",").alias("v"))


@query("path_parts", "SELECT file_id, regexp_extract(path, '[^/]*$') || '.' || content_class AS base, parent_dir AS parent, '.' || content_class AS ext, CASE WHEN size >= 1048576 THEN printf('%.1f MB', size / 1048576) WHEN size >= 1024 THEN printf('%.1f KB', size / 1024) ELSE size || ' B' END AS size FROM files")
def _(spark, d):
    p = F.concat("path", F.lit("."), "content_class")
    return files(spark, d).select("file_id", X.base_name(p).alias("base"), X.parent_dir(p).alias("parent"), X.extension(p).alias("ext"), X.format_size(F.col("size")).alias("size"))


@query("glob_filter", "SELECT file_id FROM files WHERE (path LIKE '/src1/%' OR path LIKE '/src2/%') AND path NOT LIKE '%/fr/%'")
def _(spark, d):
    rel = F.substring("path", 2, 1 << 20)
    return files(spark, d).filter(X.matches_globs(rel, ["src1/**", "src2/*/*.txt"], ["**/fr/*"])).select("file_id")


@query("mask_and_truncate", "SELECT c_custkey, CASE WHEN length(c_name) > 11 THEN left(c_name, 7) || repeat('*', length(c_name) - 11) || right(c_name, 4) ELSE repeat('*', length(c_name)) END AS masked, CASE WHEN length(c_name) > 10 THEN left(c_name, 7) || '...' ELSE c_name END AS short, left(sha256(c_name), 12) AS hash FROM customer")
def _(spark, d):
    c = F.col("c_name")
    return table(spark, d, "customer").select("c_custkey", X.mask_key(c).alias("masked"), X.truncate_chars(c, 10).alias("short"), X.workspace_hash(c).alias("hash"))


_IR = """, hits AS (SELECT 'fts' AS mode, lang AS query_id, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) - 1 AS rank, 'doc_' || lpad(CAST(doc_id AS VARCHAR), 8, '0') AS path FROM documents),
judged AS (SELECT lang AS query_id, 'doc_' || lpad(CAST(doc_id AS VARCHAR), 8, '0') AS path, quality + toxic AS grade FROM labels JOIN documents USING (doc_id)),
top AS (SELECT h.query_id, h.rank, j.grade FROM hits h JOIN judged j USING (query_id, path) WHERE h.rank < 10),
found AS (SELECT query_id, sum((pow(2, grade) - 1) / log2(rank + 2)) AS dcg, count(*) FILTER (WHERE grade > 0) AS n FROM top GROUP BY query_id),
ideal AS (SELECT query_id, sum((pow(2, grade) - 1) / log2(r + 1)) FILTER (WHERE r <= 10) AS best, count(*) AS relevant FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, path) AS r FROM judged WHERE grade > 0) GROUP BY query_id)
SELECT 'fts' AS mode, query_id, round(coalesce(n, 0) / relevant, 9) AS recall, round(coalesce(dcg, 0) / best, 9) AS ndcg FROM ideal LEFT JOIN found USING (query_id)"""


@query("ir_recall_ndcg", _IR)
def _(spark, d):
    from pyspark.sql import Window

    docs = table(spark, d, "documents")
    path = F.concat(F.lit("doc_"), F.lpad(F.col("doc_id").cast("string"), 8, "0"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n_chars"), "doc_id")) - 1
    hits = docs.select(F.lit("fts").alias("mode"), F.col("lang").alias("query_id"), rank.alias("rank"), path.alias("path"))
    judged = table(spark, d, "labels").join(docs, "doc_id").select(F.col("lang").alias("query_id"), path.alias("path"), (F.col("quality") + F.col("toxic")).alias("grade"))
    return admin.retrieval_quality(hits, judged).select("mode", "query_id", F.round("recall", 9).alias("recall"), F.round("ndcg", 9).alias("ndcg"))


# ---- text -------------------------------------------------------------------------------------------------------


@query("token_counts", r"SELECT doc_id, len(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS n FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(tokens(F.col("text"))).cast("long").alias("n"))


@query("fts_porter", _BM25 + "SELECT node_id, chunk_id, round(score, 9) AS score FROM fts")
def _(spark, d):
    """Without a written index."""
    return rounded(search.fts_search(spread(texts(spark, d)), QUERY))


@query("fts_scan", r""", dl AS (SELECT chunk_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM texts),
tf AS (SELECT chunk_id, t, len(list_filter(w, lambda x: x = t)) AS tf, len(w) AS dl FROM dl, (SELECT unnest(['the', 'of']) AS t)),
st AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM dl), df AS (SELECT t, count(*) FILTER (WHERE tf > 0) AS df FROM tf GROUP BY t)
SELECT chunk_id, round(sum(CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 12) AS score
FROM tf JOIN df USING (t), st WHERE tf > 0 GROUP BY chunk_id""")
def _(spark, d):
    """Without stems and index: all scores, as ties of the least weights would make a cut arbitrary."""
    return search.scan_bm25(texts(spark, d), ["the", "of"]).select("chunk_id", F.round("score", 12).alias("score"))


_LETTERS = r"[^\p{L}\p{N}]"


@query("prose_chunks", rf"SELECT doc_id, true AS exact, true AS small, length(regexp_replace(text, '{_LETTERS}', '', 'g')) AS letters FROM documents WHERE regexp_matches(text, '[\p{{L}}\p{{N}}]')")
def _(spark, d):
    """Every chunk is what the source has at its offsets, has at most 260 words, and no letter is lost or repeated."""
    docs = spread(table(spark, d, "documents").select("doc_id", "text"))
    rows = chunks.prose_chunks(docs).join(docs.withColumnRenamed("text", "source"), "doc_id")
    exact = F.expr("substring(encode(source, 'UTF-8'), CAST(byte_start AS INT) + 1, CAST(byte_end - byte_start AS INT))") == F.encode("text", "UTF-8")
    letters = F.sum(F.char_length(F.regexp_replace("text", _LETTERS, "")))
    return rows.withColumn("exact", exact).groupBy("doc_id").agg(F.bool_and("exact").alias("exact"), F.bool_and(F.col("token_count") <= 260).alias("small"), letters.alias("letters")).filter("letters > 0")


from . import sample_queries  # noqa: E402, F401  (adds the rest)
