from tidewater.functions.porter import stem, stem_start
from tidewater.operators import search


def test_scan_and_index_agree(spark):
    rows = [(i, i, t) for i, t in enumerate(["a b c", "b b d", "", "c a a é", "zz"])]
    chunks = spark.createDataFrame(rows, "chunk_id long, node_id long, text string")
    for q in ("b", "a A é", "b zz none"):
        scan, index = (search.fts_search(chunks, q, index=x, stemmed=False).collect() for x in (None, search.invert(chunks, False)))
        assert [(r.chunk_id, round(r.score, 9)) for r in scan] == [(r.chunk_id, round(r.score, 9)) for r in index]


def test_search_finds_other_forms(spark):
    more = spark.createDataFrame([(1, 1, "He runs"), (2, 2, "Running late"), (3, 3, "none"), (4, 4, "RÚN")], "chunk_id long, node_id long, text string")
    assert sorted(r.chunk_id for r in search.fts_search(more, "run").collect()) == [1, 2, 4]
    assert [r.chunk_id for r in search.fts_search(more, "runs", stemmed=False).collect()] == [1]


def test_one_posting_of_a_chunk_for_all_forms_of_a_stem(spark):
    chunks = spark.createDataFrame([(1, 5, "run runs RUNNING ran")], "chunk_id long, node_id long, text string")
    assert sorted(map(tuple, search.postings(chunks).collect())) == [("ran", 1, 5, 1, 4), ("run", 1, 5, 3, 4)]


def test_a_chunk_with_a_header_is_indexed_with_it(spark):
    chunks = spark.createDataFrame([(1, 5, "text", "title")], "chunk_id long, node_id long, text string, header string")
    assert {r.term for r in search.postings(chunks).collect()} == {"text", "titl"}
    assert tuple(search.corpus_of(chunks).first()) == (1, 2)


def test_words_are_counted_without_a_shuffle_and_only_wanted_ones(spark):
    chunks = spark.createDataFrame([(1, 5, "run runs RÚN ran"), (2, 6, None), (3, 7, ""), (4, 8, "late")], "chunk_id long, node_id long, text string")
    assert sorted(map(tuple, search.count_words(chunks, only=["run"]).collect())) == [("run", 1, 5, 3, 4)]
    assert sorted(map(tuple, search.count_words(chunks).collect())) == [("late", 4, 8, 1, 1), ("ran", 1, 5, 1, 4), ("run", 1, 5, 3, 4)]
    plan = search.postings(chunks)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan


def test_rows_that_repeat_a_chunk_are_one_posting(spark):
    chunks = spark.createDataFrame([(1, 5, "run far"), (1, 5, "far off")], "chunk_id long, node_id long, text string")
    want = [("far", 1, 5, 2, 2), ("off", 1, 5, 1, 2), ("run", 1, 5, 1, 2)]
    assert sorted(map(tuple, search.postings(chunks).collect())) == sorted(map(tuple, search.by_term(search.count_words(chunks)).collect())) == want


def test_long_rows_are_counted_in_pieces(spark, monkeypatch):
    chunks = spark.createDataFrame([(i, i, "a b " * i) for i in range(6)], "chunk_id long, node_id long, text string")
    want = sorted((t, i, i, i, 2 * i) for i in range(1, 6) for t in "ab")
    monkeypatch.setattr(search, "PIECE", 3)
    assert sorted(map(tuple, search.count_words(chunks).collect())) == want


def test_a_stem_tells_how_its_words_begin():
    ends = ["", "s", "ies", "ed", "ing", "eed", "y", "e", "bility", "bilities", "logy", "ational", "izer", "ization", "ator", "ication", "fulness", "ement"]
    for word in {a + b + c for a in ("cat", "rel", "cry", "bl", "a", "y", "e") for b in ends for c in ends}:
        assert word.startswith(stem_start(stem(word)))
