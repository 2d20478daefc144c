"""A corpus pipeline of five operators: quality, lines, near copies, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir) and works on all documents that the one before has kept. run() writes every
stage's result to the shared folder and reads it again, so that a lost executor never repeats an earlier stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import Scratch, read
from tidewater.llm.decontaminate import decontaminate
from tidewater.llm.line_dedup import dedup_lines
from tidewater.llm.near_copies import groups, node_of
from tidewater.llm.packing import pack_documents
from tidewater.llm.quality import fit, score_documents

#: A score below this rejects a document.
LEAST_QUALITY = 0.3
#: Columns of documents.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def with_text(rows: DataFrame, text) -> DataFrame:
    """The columns of documents from ``row``, with a new text."""
    text = F.when(F.col("row.text").isNotNull(), text)
    return rows.select("row.doc_id", text.alias("text"), "row.lang", "row.source", F.char_length(text).cast("long").alias("n_chars"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with a score below LEAST_QUALITY go. Each row is scored by its own text: null as empty, repeated rows alike, those without doc_id too."""
    docs = docs.select(*COLUMNS)
    return score_documents(docs, fit(docs, read(spark, sf_dir, "labels"))).filter(F.col("score") >= LEAST_QUALITY).select("row.*")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row stays, with what is left of its text; a null text stays null. Rows of one doc_id are one document, those without keep all lines."""
    return with_text(dedup_lines(docs.select(*COLUMNS)), F.col("text"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group one row stays; rows without doc_id are in no group.

    Texts link from a Jaccard similarity of 0.8 of their five-word shingles on; SimHash and multi-index hashing, as in op3
    with more bits, choose the pairs that are compared (near_copies.groups). The row with the
    smallest doc_id stays, among rows of one doc_id the one with the smallest SHA-256 of its columns. So all texts of a
    repeated doc_id stay that are near to no other.
    """
    docs = docs.select(*COLUMNS)
    mark = F.sha2(F.to_json(F.struct(F.sha2("text", 256).alias("text"), "lang", "source", "n_chars")), 256)
    named = docs.filter("doc_id IS NOT NULL").withColumn("node", node_of("text")).withColumn("mark", mark)
    group = F.coalesce("component", "node")
    kept = named.select("node", "doc_id", "mark").join(groups(named), "node", "left").groupBy(group).agg(F.min(F.struct("doc_id", "mark")).alias("least")).select("least.*")
    rows = named.join(kept, ["doc_id", "mark"], "left_semi").dropDuplicates(["doc_id", "mark"])  # equal rows
    return rows.select(*COLUMNS).unionByName(docs.filter("doc_id IS NULL"))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated rows go, the others lose their hit runs. Null texts stay null, repeated rows and those without doc_id are like any other."""
    out = decontaminate(docs.select(*COLUMNS), read(spark, sf_dir, "benchmark"))
    return out.withColumn("n_chars", F.char_length("text").cast("long"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every row. A null text is the end id alone; repeated rows and those without doc_id are packed like any other."""
    return pack_documents(docs)


STAGES = [("quality", quality), ("line dedup", lines), ("near copies", near_copies), ("decontamination", benchmark), ("packing", packing)]
#: The classifier and the tokenizer can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per piece of a document in a training sequence."""
    scratch = Scratch(spark, "pipeline")
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        done = scratch.write(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        scratch.drop(docs)
        docs = done
    return STAGES[-1][1](spark, docs, sf_dir)
