"""The subpackage's queries and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, embedding_dedup, html_extract, line_dedup, packing, quality, simhash, substring_dedup, suffix_dedup, token_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_embedding_dedup": embedding_dedup.op1_embedding_dedup,
    "op2_suffix_dedup": suffix_dedup.op2_suffix_dedup,
    "op3_simhash": simhash.op3_simhash,
    "op4_line_dedup": line_dedup.op4_line_dedup,
    "op5_decontamination": decontaminate.op5_decontamination,
    "op6_quality": quality.op6_quality,
    "op7_html_extraction": html_extract.op7_html_extraction,
    "op8_packing": packing.op8_packing,
    "op9_token_counts": token_counts.op9_token_counts,
    "op10_substring_dedup": substring_dedup.op10_substring_dedup,
}
ORACLE_SQL: dict[str, str] = {"op1_embedding_dedup": embedding_dedup.OP1_SQL, "op2_suffix_dedup": suffix_dedup.OP2_SQL, "op4_line_dedup": line_dedup.OP4_SQL, "op5_decontamination": decontaminate.OP5_SQL, "op10_substring_dedup": substring_dedup.OP10_SQL}
