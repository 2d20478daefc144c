"""Benchmarks beyond one automaton."""

import random

import pytest
from pyspark.sql import functions as F

import brute
from tidewater.llm import decontaminate


@pytest.mark.parametrize("bound", [2500, 5000])
def test_a_large_benchmark_is_scanned_in_groups(spark, bound):
    rng = random.Random(4)
    text = lambda n: " ".join(f"w{rng.randrange(400)}" for _ in range(n))
    items = [(i, text(rng.randrange(5, 40))) for i in range(30)] + [(None, text(20)), (31, None), (3, text(15))]
    docs = [(i, " ".join([text(rng.randrange(60)), items[rng.randrange(30)][1], items[rng.randrange(33)][1] or "", text(9)])) for i in range(40)] + [(7, None), (None, items[2][1]), (8, "")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    assert sum(1 for _ in decontaminate.window_groups(((i, (t or "").encode()) for i, t in items), 13, bound)) > 2
    found = decontaminate.find_contamination(spark.createDataFrame(docs, "doc_id long, text string"), benchmark, 13, bound)
    got = found.select("row.doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256), "contaminated").collect()
    assert sorted(map(tuple, got), key=repr) == brute.op5(docs, items)


def test_a_short_item_is_cut_too(spark):
    long = " ".join(f"x{i}" for i in range(200))
    docs = spark.createDataFrame([(1, f"{long} the answer is Seven {long}"), (2, "answer is seven"), (3, long)], "doc_id long, text string")
    got = decontaminate.decontaminate(docs, spark.createDataFrame([(1, "Answer is seven")], "item_id long, text string"))
    assert sorted(map(tuple, got.collect())) == [(1, f"{long} the  {long}"), (3, long)]
