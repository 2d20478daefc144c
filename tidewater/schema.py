"""Table layouts and closed vocabularies."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, BinaryType, ByteType, DoubleType, IntegerType, LongType, StringType, StructField, StructType, TimestampType

SCHEMA_VERSION = 3
PASSES = ("structural", "chunker", "embeddings", "graph", "communities", "enrichment", "pagerank", "summary")
FILE_STATUSES = ("pending", "running", "done", "failed", "skipped")
CLASSES = ("code", "document", "image", "media", "data", "unknown")
CHUNK_KINDS = ("prose", "code_ast", "pdf_text", "code_fallback")
STATES = ("pending", "enabled", "disabled", "requires_confirmation")
OK, EMPTY, DEGRADED, CONTRACT_ERROR, NOT_FOUND = "OK", "EMPTY_BUT_EXECUTED", "DEGRADED", "CONTRACT_ERROR", "NOT_FOUND"

_TYPES = {"long": LongType, "int": IntegerType, "string": StringType, "binary": BinaryType, "double": DoubleType, "timestamp": TimestampType}


def ddl(text: str) -> StructType:
    """A schema from "name type, ..." that needs no session."""
    return StructType([StructField(n, _TYPES[t]()) for n, t in (x.split() for x in text.split(","))])


FILES = ddl("file_id long, path string, sha256 binary, size long, mtime long, mime string, content_class string, parent_dir string, last_seen long, deleted_at long")
NODES = ddl(
    "node_id long, file_id long, node_type string, name string, properties string, provenance string, confidence double, created_at long, updated_at long, deleted_at long, language string, symbol_name string"
)
EDGES = ddl("edge_id long, src_node long, dst_node long, edge_type string, properties string, provenance string, confidence double, created_at long")
CHUNKS = ddl("chunk_id long, node_id long, text string, byte_start long, byte_end long, token_count int, chunk_kind string, header string, deleted_at long")
EMBEDDINGS = StructType([StructField("chunk_id", LongType()), StructField("embedding", ArrayType(ByteType()))])
LEDGER = ddl("file_id long, pass_name string, status string, checkpoint_at long, error_message string")
POSTINGS = ddl("term string, chunk_id long, node_id long, tf long, dl long")
TERMS = ddl("term string, df long")
CORPUS = ddl("n long, total long")
COMMUNITIES = ddl("community_id long, label string, size long")
BLOBS = ddl("blob_id long, sha256 binary, blob_type string, size long, refcount long")
BLOB_REFS = ddl("blob_id long, node_id long")
ENRICHMENTS = ddl("enrichment_id long, node_id long, kind string, body string, created_at long")
TOOLS = StructType([*(StructField(n, StringType()) for n in ("name", "source_file", "description", "input_schema", "risk", "state", "dep_state", "content_hash")), StructField("updated_at", TimestampType())])
RESOURCES = ddl("name string, file_path string, mime_type string, size_bytes long, resource_type string, state string, updated_at timestamp")
AUDIT = ddl("id long, tool_name string, action string, params string, caller string, result_status string, timestamp timestamp")
TABLES = {
    "files": FILES, "nodes": NODES, "edges": EDGES, "chunks": CHUNKS, "embeddings": EMBEDDINGS, "pipeline_state": LEDGER, "communities": COMMUNITIES, "postings": POSTINGS, "terms": TERMS, "corpus": CORPUS,
    "blobs": BLOBS, "blob_refs": BLOB_REFS, "llm_enrichments": ENRICHMENTS, "tools": TOOLS, "resources": RESOURCES, "audit_log": AUDIT,
}
SCORES = StructType([StructField("node_id", LongType()), StructField("chunk_id", LongType()), StructField("score", DoubleType())])
