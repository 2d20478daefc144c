"""The near-copy stage against all pairs."""

import random

import numpy as np
import pyarrow as pa
import pytest

import brute
from tidewater.llm import near_copies, simhash
from tidewater.llm.sharing import mix


def edited(rng, w, n):
    """A text with ``n`` of its words replaced, in one place each."""
    w = list(w)
    for i in rng.sample(range(len(w)), n):
        w[i] = f"new{rng.randrange(10**6)}"
    return " ".join(w)


def texts():
    rng = random.Random(8)
    out = [None, "", "one two", "One  two", "one two three"]
    for size in (40, 120, 300, 900):
        for _ in range(12):
            w = [f"w{rng.randrange(3000)}" for _ in range(size)]
            out += [" ".join(w), edited(rng, w, max(1, size // 60)), edited(rng, w, max(1, size // 45)), edited(rng, w, size // 12)]
    base = [f"b{i}" for i in range(60)]
    return out + [edited(rng, base, 1) for _ in range(70)]


def similarity(a, b):
    a, b = (set(near_copies.shingle_set((t or "").encode()).tolist()) for t in (a, b))
    return len(a & b) / len(a | b) if a | b else float(a == b)


@pytest.mark.parametrize("block", [8192, 8])
def test_near_copy_stage_links_from_a_similarity_of_four_fifths(spark, monkeypatch, block):
    import corpus_pipeline

    monkeypatch.setattr(near_copies, "BLOCK", block)
    monkeypatch.setattr(near_copies, "GROUP_BLOCK", block)
    own = texts()
    pairs = [(i, j, similarity(own[i], own[j])) for i in range(len(own)) for j in range(i)]
    assert sum(0.8 <= s < 0.95 for *_, s in pairs) > 50 and sum(0.6 < s < 0.8 for *_, s in pairs) > 50
    want = brute.groups(range(len(own)), [(i, j) for i, j, s in pairs if s >= 0.8])
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(own)], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.near_copies(spark, docs, "")
    assert sorted(r.doc_id for r in got.collect()) == sorted(set(want.values()))


def test_all_texts_of_a_repeated_doc_id_that_are_near_to_nothing_stay(spark):
    import corpus_pipeline

    a, b, c, d = (" ".join(f"{x}{i}" for i in range(50)) for x in "abcd")
    rows = [(1, a, "en", "s", 1), (5, a, "en", "s", 1), (5, b, "en", "s", 1), (5, b, "de", None, 1), (5, b, "de", None, 1), (5, b + " end", "en", "s", 1), (6, c, "en", "s", 1), (6, c, "en", "s", 1), (None, a, "en", "s", 1), (5, d, "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = sorted(map(tuple, corpus_pipeline.near_copies(spark, docs, "").collect()), key=repr)
    five = [r for r in got if r[0] == 5]
    assert [r for r in got if r[0] != 5] == sorted([rows[0], rows[6], rows[8]], key=repr)
    assert rows[9] in five
    assert [r for r in five if r != rows[9]] in ([rows[2]], [rows[3]], [rows[5]])


def pairs_at_four_fifths(rng):
    """Two sets of hashes each, at a similarity of exactly 0.8: those that differ in the most bits, one within the other, large ones."""
    for i, a, b in [(4, 0, 1), (12, 1, 2), (12, 0, 3), (20, 2, 3), (8, 1, 1), (400, 50, 50), (400, 0, 100), (4000, 500, 500)]:
        for _ in range(60 if i < 1000 else 5):
            h = rng.integers(0, 2**64, i + a + b, dtype=np.uint64)
            yield np.unique(h[: i + a]), np.unique(np.concatenate([h[:i], h[i + a :]]))


def test_wide_fingerprints_are_majorities_of_hashes_and_of_their_mixes():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 2**64, n, dtype=np.uint64)) for n in (0, 1, 2, 3, 4, 5, 8, 9, 100, 4096, 4097, 9000)]
    got, salts = simhash.wide(sets, 3), mix(np.arange(3, dtype=np.uint64))
    assert (got[:, 0] == simhash.majority([s.tolist() for s in sets])).all()
    for k in (1, 2):
        assert (got[:, k] == simhash.majority([mix(s ^ salts[k]).tolist() for s in sets])).all()


def test_pairs_at_four_fifths_share_a_segment_and_are_within_both_radii():
    bits, n = near_copies.tables(220_000)
    for a, b in pairs_at_four_fifths(np.random.default_rng(4)):
        near = [a, b] + [np.delete(b, k) for k in range(5) if len(b) == 5]
        fps = simhash.wide(near, -(-n * bits // 64))
        values = simhash.segments(fps, bits, n)
        kept = near_copies.distances(fps[:1, : near_copies.KEPT], fps[1:, : near_copies.KEPT])[0]
        apart = np.maximum(kept.astype(int) - near_copies.radius(near_copies.KEPT), near_copies.distances(fps[:1], fps[1:])[0].astype(int) - near_copies.radius(fps.shape[1]))
        assert ((values[0] == values[1:]).any(axis=1) & (apart <= 0)).any()


def test_candidates_are_the_fingerprints_of_a_value_within_the_radius():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**64, (12, near_copies.KEPT), dtype=np.uint64)
    fps = base[rng.integers(0, 12, 300)] ^ (np.uint64(1) << rng.integers(0, 64, (300, near_copies.KEPT), dtype=np.uint64))
    cell = rng.integers(0, 9, 300)
    near = [(i, j) for i in range(300) for j in range(i) if cell[i] == cell[j] and sum((int(x) ^ int(y)).bit_count() for x, y in zip(fps[i], fps[j])) <= near_copies.radius(near_copies.KEPT)]
    table = pa.table({"cell": cell, "id": np.arange(300), "fp": [x.tobytes() for x in fps]})
    found = near_copies.candidates(table)
    got = list(zip(*(found.column(c).to_pylist() for c in "ab")))
    assert len(near) > 100 and brute.groups(range(300), got) == brute.groups(range(300), near)


@pytest.mark.parametrize("at_a_time", [96, 7])
def test_a_text_of_five_shingles_meets_one_of_four(spark, monkeypatch, at_a_time):
    monkeypatch.setattr(near_copies, "TABLES", at_a_time)
    own = [" ".join(f"v{i}x{j}" for j in range(n)) for i in range(150) for n in (8, 9)]
    docs = spark.createDataFrame([(t,) for t in own], "text string").select("text", near_copies.node_of("text").alias("node"))
    node = {r.text: r.node for r in docs.collect()}
    got = {r.node: r.component for r in near_copies.groups(docs).collect()}
    assert near_copies.groups(docs.limit(0)).count() == 0
    assert got == {node[t]: min(node[own[k - k % 2]], node[own[k - k % 2 + 1]]) for k, t in enumerate(own)}
