"""Filters, suffix sort, recompression, HTML rules and the pipeline."""

import random

import numpy as np
import pytest

import brute
from tidewater.llm import decontaminate, graph, html_extract, line_dedup, sharing, substring_dedup, suffix_dedup
from tidewater.llm.common import Scratch


def test_cuckoo_filter_holds_and_forgets():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 1 << 63, 5000, dtype=np.uint64)
    f = line_dedup.CuckooFilter.build(keys)
    assert f.contains(keys).all()
    f.delete(keys[:2500])
    g = line_dedup.CuckooFilter.load(f.dump())
    assert g.contains(keys[2500:]).all() and g.contains(keys[:2500]).mean() < 0.01
    assert g.contains(rng.integers(0, 1 << 63, 5000, dtype=np.uint64)).mean() < 0.01


def filter_of(index):
    """Fingerprints held, and the number of frequent keys that the filters deny."""
    tables = {r.shard: line_dedup.CuckooFilter.load(bytes(r.filter)) for r in index.filters.collect()}
    held = sum(int((t.table > 0).sum()) for t in tables.values())
    keys = line_dedup.hash64([bytes(r.key) for r in index.counts().collect() if r.n_docs >= index.min_docs])
    shards = line_dedup.shard_of(keys, index.shards)
    return held, len(keys), sum(not tables[s].contains(keys[i : i + 1])[0] for i, s in enumerate(shards.tolist()))


@pytest.mark.parametrize("parts", [16, 2])
def test_line_index_is_reversible(spark, monkeypatch, parts):
    monkeypatch.setattr(line_dedup, "PARTS", parts)
    rng = random.Random(6)
    lines = [f"line number {i} of many, long enough to be counted as one" for i in range(60)]
    docs = [(i, "\n".join(rng.sample(lines, 9))) for i in range(60)]
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    index = line_dedup.LineIndex(spark, shards=2)
    index.insert(frame(docs[:30])).insert(frame(docs[20:])).delete(frame(docs[10:35] + [(999, None)]).select("doc_id")).insert(frame(docs[12:14]))
    left = docs[:10] + docs[12:14] + docs[35:]
    alone = line_dedup.LineIndex(spark, shards=2).insert(frame(left))
    assert sorted(map(tuple, index.counts().collect())) == sorted(map(tuple, alone.counts().collect()))
    assert sorted(map(tuple, index.refs.collect())) == sorted(map(tuple, alone.refs.collect()))
    held, frequent, denied = filter_of(index)
    assert held == frequent > 10 and denied == 0
    got = index.dedup(frame(left)).select("row.doc_id", "n_lines", "n_dropped").collect()
    assert sorted(map(tuple, got)) == [r[:3] for r in sorted(brute.op4(left))]
    assert sorted(map(tuple, index.delete(frame(docs).select("doc_id")).counts().collect())) == [] and filter_of(index)[:2] == (0, 0)


def test_a_full_shard_grows(spark, monkeypatch):
    frame = lambda n, to: spark.createDataFrame([(i, "\n".join(f"line number {k} of many, long enough to be counted" for k in range(n, to))) for i in range(5)], "doc_id long, text string")
    index = line_dedup.LineIndex(spark, shards=1).insert(frame(0, 20)).insert(frame(20, 400))
    assert filter_of(index) == (400, 400, 0)
    assert filter_of(index.delete(frame(0, 1).select("doc_id")))[:2] == (0, 0)


def test_suffix_sort_is_the_byte_order():
    rng = random.Random(2)
    strings = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(0, 12))) for _ in range(400)]
    group = np.sort(np.array([rng.randrange(9) for _ in strings]))
    flat = np.frombuffer(b"".join(strings), np.uint8)
    size = np.array([len(s) for s in strings])
    s = suffix_dedup.Strings(flat, np.cumsum(size) - size, size)
    order, shared = s.ordered(group, 12)
    want = sorted(range(len(strings)), key=lambda i: (group[i], strings[i]))
    assert [strings[i] for i in order] == [strings[i] for i in want]
    for a, b, n in zip(order, order[1:], shared[1:]):
        common = next((k for k, (x, y) in enumerate(zip(strings[a], strings[b])) if x != y), min(size[a], size[b]))
        assert n == (common if group[a] == group[b] else -1)


def test_a_hash_collision_is_found(monkeypatch):
    monkeypatch.setattr(sharing, "BYTES", np.ones_like(sharing.BYTES))
    monkeypatch.setattr(suffix_dedup, "BYTES", np.ones((2, 256), np.uint64))  # all strings of a length look equal
    strings = [b"bb", b"ab", b"ba", b"aa"]
    s = suffix_dedup.Strings(np.frombuffer(b"".join(strings), np.uint8), np.arange(4) * 2, np.full(4, 2))
    order, _ = s.ordered(np.zeros(4), 2)
    assert [strings[i] for i in order] == sorted(strings)


def local_rounds(docs, n):
    """The naming rounds in one process, a chunk for each document, every window kept by the sieve."""
    own = [substring_dedup.begin([d], np.arange(max(0, len(d) - n + 1)), n) for d in docs]
    for r in range(substring_dedup.ROUNDS + 1):
        tables = [substring_dedup.stated(i, *x, 3).to_pylist() for i, x in enumerate(own)]
        schema = substring_dedup.rows_table([[]] * 6).schema
        table = lambda rows: substring_dedup.pa.Table.from_pylist(rows, schema)  # noqa: B023, E731
        named = [x for b in range(3) if (rows := [x for t in tables for x in t if x["bucket"] == b]) for x in substring_dedup.give_names(r)(table(rows)).to_pylist()]
        thawed = [substring_dedup.thawed(table([x for x in named if x["chunk"] == i] + t[:1])) for i, t in enumerate(tables)]
        states = [substring_dedup.take_names(*x[1:], n) for x in thawed]
        own = [substring_dedup.advance(s, r) for s in states] if r < substring_dedup.ROUNDS else own
    return [substring_dedup.entries(s, n) for s in states]


def test_interior_symbols_agree_in_equal_windows():
    rng = np.random.default_rng(4)
    shared = rng.integers(0, 50, 60).astype(np.uint64)
    found = []
    for _ in range(40):
        before, after = (rng.integers(0, 50, rng.integers(0, 30)).astype(np.uint64) for _ in range(2))
        name = sharing.mix(np.concatenate([before, shared, after]))
        left = len(before) + np.arange(60 - 34)
        names, a, b = substring_dedup.zones(name, np.zeros(len(name), np.int64), left, left + 35)
        found.append([names[p:q].tolist() for p, q in zip(a, b)])
    assert all(f == found[0] for f in found) and sum(map(len, found[0])) > 26


@pytest.mark.parametrize("letters, n", [(3, 6), (40, 9), (500, 35), (2, 35)])
def test_rounds_keep_every_window_that_repeats(letters, n):
    rng = random.Random(letters)
    shared = [rng.randrange(letters) for _ in range(3 * n)]
    docs = []
    for _ in range(12):
        own = [rng.randrange(letters) for _ in range(rng.randrange(2 * n))] + [0] * rng.randrange(2 * n)
        cut = rng.randrange(2 * n)
        docs.append([str(w).encode() for w in own + shared[cut : cut + rng.randrange(n, 2 * n)] + own[:5]])
    held = {}
    for d, own in enumerate(docs):
        for s in range(len(own) - n + 1):
            held.setdefault(tuple(own[s : s + n]), []).append((d, s))
    want = {p for places in held.values() if len(places) > 1 for p in places}
    rows = [(d, i, *e, t) for d, (_, found, times) in enumerate(local_rounds(docs, n)) for i, (e, t) in enumerate(zip(found, times.tolist()))]
    kept = {(d, s + w) for d, (where, _, _) in enumerate(local_rounds(docs, n)) for s, c in zip(where["start"].tolist(), where["count"].tolist()) for w in range(c)}
    assert want <= kept
    columns = list(zip(*rows))
    hits = substring_dedup.repeated(*(np.array(columns[k]) for k in (2, 3, 4)), list(columns[5]), np.array(columns[6]), n)
    hit = {(d, i): set(h) for (d, i, *_), h in zip(rows, hits)}
    got = {(d, s + w) for d, (where, _, _) in enumerate(local_rounds(docs, n)) for s, e, c in zip(where["start"].tolist(), where["entry"].tolist(), where["count"].tolist()) for w in range(c) if w in hit[d, e]}
    assert got == want


def test_spanning_and_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)]
    up = {n: n for e in edges for n in e}
    for _ in range(500):
        for a, b in edges:
            up[a] = up[b] = min(up[a], up[b])
    a, b = graph.spanning(*np.array(edges).T)
    assert {x: y for x, y in zip(a.tolist(), b.tolist())} == {x: y for x, y in up.items() if x != y}
    got = graph.components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()
    touched = {n for x, y in edges if x != y for n in (x, y)}
    assert {(r.node, r.component) for r in got} == {(n, up[n]) for n in touched}


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var x="</p>";</script></head><body>
<header>Site of the year</header><nav><ul><li><a href=/>Home</a></ul></nav><div class="cookie-notice">We use cookies and that is the way it is.</div>
<main><article><h1>A short head</h1><p><b>The first of the paragraphs</b> is about what it was and that it is in the world&nbsp;&amp; more<br>than that.
<p>Short.</p><div class="ad">Buy the best of the best in the world and be with us for ever.</div><p>And <a href=x>a link</a> of the kind that is in the text of this and that.</p>
<form><input>Name of the reader</form><section id="comments"><p>I was the first of the readers to say that it is not so.</p></section></article></main>
<aside>More of the same and so on and on</aside><footer>&copy; the makers of this and that</footer>"""


def test_main_text():
    assert html_extract.extract(PAGE) == "A short head The first of the paragraphs is about what it was and that it is in the world & more than that. Short. And a link of the kind that is in the text of this and that."


@pytest.mark.parametrize("html, text", [("", ""), ("<", "<"), ("<p", ""), ("plain of the text", "plain of the text"), ("<!-- x", ""), ("<article><p>a<i>b</i> &lt;c&gt; &amp x", "ab <c> & x"), ("<nav>x", ""), ("<article>" + "<div>" * 3000 + "deep", "deep")])
def test_broken_pages(html, text):
    assert html_extract.extract(html) == text


def test_spans_are_cut_in_the_original():
    patterns = decontaminate.windows([(1, b"aa bb cc")], 3)
    n, runs, items = decontaminate.scan(decontaminate.automaton(patterns), "É AA, bb-CC! aa bb".encode())
    assert (n, runs, items) == (6, [(1, 4)], {"1"})
    assert decontaminate.cut_spans("É AA, bb-CC! aa".encode(), [[3, 12, 1, 4]]).decode() == "É ! aa"


def test_pipeline(spark, tmp_path):
    import corpus_pipeline
    from tidewater.llm.common import read

    d = "/root/testdata/sf0.001"
    docs = read(spark, d, "documents")
    n = docs.count()
    held = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, d)
        if name != "packing":
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        held.append(docs.select("doc_id").distinct().count())
    assert n >= held[0] >= held[1] >= held[2] >= held[3] == held[4] > n // 2
    assert corpus_pipeline.run(spark, d).count() > 0
