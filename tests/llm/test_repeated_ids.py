"""A doc_id that occurs with two texts, one of them another document's copy."""

import duckdb
import pytest

import brute
from tidewater.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", ["op2_suffix_dedup", "op10_substring_dedup"])
def test_a_copy_is_one_text_of_a_doc_id(spark, tmp_path, name):
    a, b, c = (" ".join(f"{x}{i}" for i in range(80)) for x in "abc")
    rows = [(1, a), (5, a), (5, b), (7, c + " " + b[:250]), (7, a), (8, b), (9, c), (5, a), (3, c), (None, a), (12, b + b), (12, b + b), *[(13, "repeated " + b[::-1])] * 40]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in QUERIES[name](spark, str(tmp_path)).collect()), key=repr)
    assert got == {"op2_suffix_dedup": brute.op2, "op10_substring_dedup": brute.op10}[name](rows)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    names = QUERIES[name](spark, str(tmp_path)).columns
    assert sorted(con.sql(ORACLE_SQL[name]).select(*names).fetchall(), key=repr) == got


def test_a_repeated_vec_id_is_in_one_component(spark, tmp_path):
    x, y, z = [1.0, 0.0], [0.0, 1.0], [1.0, 1.0]
    rows = [(1, x, 0), (7, x, 0), (7, y, 0), (9, y, 0), (7, None, 0), (7, x, 0), (8, z, 0), (8, x, 1), (9, None, 0), (11, None, 0), (None, x, 0)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted((tuple(r) for r in QUERIES["op1_embedding_dedup"](spark, str(tmp_path)).collect()), key=repr)
    assert got == brute.op1(rows)
    assert {(r[0], r[2]) for r in got} == {(1, 1), (7, 1), (9, 1), (8, 8), (11, 11), (None, None)}
