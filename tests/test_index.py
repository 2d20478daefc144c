import json

import pytest
from pyspark.sql import functions as F

from tidewater.operators import admin, browse, catalog, fusion, merge, nodes, search
from tidewater.plans.index import index_folder, search_store
from tidewater.sources import audit, config, files
from tidewater.sources.store import Store
from tidewater.streaming import watch


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "work"
    (root / "sub").mkdir(parents=True)
    (root / ".git").mkdir()
    (root / ".git" / "x.md").write_text("hidden")
    (root / "a.py").write_text('def greet(name: str):\n    """Say hello to foxes."""\n    return name\n')
    (root / "b.go").write_text("package b\n\nfunc Run() {\n}\n")
    (root / "notes.md").write_text("the quick brown fox\n\nhello world")
    (root / "sub" / "data.csv").write_text("a,b\n")
    (root / "sub" / "bin.md").write_bytes(b"x\0y")
    (root / "deploy.sh").write_text("# Deploys\n")
    return root


def test_index_search_and_reindex(spark, folder, tmp_path):
    stub = lambda texts: [[len(t) % 7 / 10.0, 0.5, -0.5, 0.1] for t in texts]
    store = Store(spark, str(tmp_path / "store"))
    got = index_folder(spark, store, f"file://{folder}", 1000, stub, 4)
    assert got["files"] == 6 and got["failed"] == 0
    f, n, c, e = (store.table(t) for t in ("files", "nodes", "chunks", "embeddings"))
    assert {r.name for r in n.collect()} == {"greet", "Run", "notes.md", "deploy.sh"}
    ids = {r.name: r.node_id for r in n.collect()}
    r = search_store(store, fusion.Request("fox", detail="brief", deadline=None))
    assert r.status == "ok" and {x.title for x in r.hits.collect()} == {"greet", "notes.md"}  # the docstring says foxes
    r = fusion.search_broadly(fusion.Request("fox", "semantic", deadline=None), f, n, c)
    assert r.status == "error" and r.failed_sources == ["vector"] and r.warnings == [fusion.PARTIAL]
    v = e.orderBy("chunk_id").first().embedding
    hits = fusion.search_broadly(fusion.Request("fox", vector=list(v), deadline=None), f, n, c, e).hits.collect()
    assert any("vector" in x.matched_sources for x in hits)
    assert fusion.render(fusion.search_broadly(fusion.Request("fox", deadline=None), f, n, c).hits).first().line.startswith("1. ")
    assert search.fts_search(c, "?! @#").count() == 0
    assert nodes.get_nodes(n, f, []).count() == 0 and nodes.get_nodes(n, f, [ids["Run"]]).first().name == "Run"
    page = browse.browse(f, str(folder))
    assert [r.name for r in page.rows.collect() if r.kind == "dir"] == ["sub"] and browse.browse(f, "/none").status == "NOT_FOUND"
    assert all(x.broken == 0 for x in admin.health(f, n, c, e).collect())
    (folder / "notes.md").write_text("other words now")
    (folder / "b.go").unlink()
    index_folder(spark, store, f"file://{folder}", 2000, stub, 4)
    texts = {x.text for x in store.table("chunks").collect()}
    assert "other words now" in texts and not any("quick" in t for t in texts)
    gone = store.table("files").filter("deleted_at IS NOT NULL").collect()
    assert [x.path.rsplit("/", 1)[1] for x in gone] == ["b.go"]
    old = {r.path: r.file_id for r in f.collect()}
    assert all(old.get(r.path, r.file_id) == r.file_id for r in store.table("files").collect())
    status = {r.key: r.n for r in admin.status_counts(store.table("files"), store.table("nodes"), store.table("pipeline_state")).collect()}
    assert status["files"] == 5 and status["structural_skipped"] == 2


def indexed(spark, store):
    """What a store holds, by paths, as ids may differ."""
    f, n, c, p, t = (store.table(x) for x in ("files", "nodes", "chunks", "postings", "pipeline_state"))
    live = f.filter("deleted_at IS NULL").select("file_id", "path")
    chunks = c.join(n.select("node_id", "file_id"), "node_id").join(live, "file_id").select("path", "text", "byte_start")
    posted = p.join(c.select("chunk_id", "node_id"), ["chunk_id", "node_id"]).join(n.select("node_id", "file_id"), "node_id").join(live, "file_id").select("path", "term", "tf", "dl")
    states = t.join(live, "file_id").select("path", "pass_name", "status")
    return [sorted(map(tuple, x.collect()), key=repr) for x in (chunks, posted, states, store.table("terms"), store.table("corpus"))]


def test_a_killed_run_loses_nothing(spark, tmp_path, monkeypatch):
    """A run is stopped at each of its writes in turn; the next run sees the same changes."""
    root = tmp_path / "work"
    root.mkdir()
    want = None
    for step in range(20):
        (root / "a.md").write_text("first text")
        (root / "b.md").write_text("stays as it is")
        (root / "c.md").write_text("goes")
        store = Store(spark, str(tmp_path / f"store{step}"))
        index_folder(spark, store, str(root), 1000)
        (root / "a.md").write_text("second text")
        (root / "c.md").unlink()
        (root / "d.md").write_text("comes")
        calls = []

        def killed(real, calls=calls, step=step):
            def run(self, *args, **kwargs):
                calls.append(1)
                if len(calls) == step + 1:
                    raise KeyboardInterrupt
                return real(self, *args, **kwargs)

            return run

        with monkeypatch.context() as m:
            for name in ("stage", "commit", "_publish"):
                m.setattr(Store, name, killed(getattr(Store, name)))
            try:
                index_folder(spark, Store(spark, store.root), str(root), 2000)
                ended = True
            except KeyboardInterrupt:
                ended = False
        again = Store(spark, store.root)
        index_folder(spark, again, str(root), 3000)
        got = indexed(spark, again)
        texts = {(p.rsplit("/", 1)[1], t) for p, t, _ in got[0]}
        assert texts == {("a.md", "second text"), ("b.md", "stays as it is"), ("d.md", "comes")}
        assert {r[2] for r in got[2]} == {"done"}
        want = want or got
        assert got == want
        (root / "d.md").unlink()
        if ended:
            break
    assert ended and step >= 7


def test_a_file_with_very_many_chunks(spark, tmp_path):
    root = tmp_path / "work"
    root.mkdir()
    (root / "big.md").write_text("\n\n".join(" ".join(f"w{i}_{j}" for j in range(150)) for i in range(4500)))
    store = Store(spark, str(tmp_path / "store"))
    assert index_folder(spark, store, str(root), 1)["failed"] == 0
    c = store.table("chunks")
    assert c.count() == c.select("chunk_id").distinct().count() > 4096


def test_names_that_spark_passes_over(spark, tmp_path):
    for name in ("a.md", "_b.md", "_d/c.md", ".github/d.md", ".env", ".x.md", "__pycache__/e.md", "p/__init__.py"):
        (tmp_path / "w" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "w" / name).write_text(name)
    root = str(tmp_path / "w")
    names = lambda rows: sorted(r.path.removeprefix(root + "/") for r in rows.collect())
    own = [".github/d.md", "_b.md", "_d/c.md", "a.md", "p/__init__.py"]
    assert names(files.walk(spark, f"file://{root}", 1)) == own
    assert names(files.raw_files(spark, root, include_dotenv=True)) == sorted([*own, ".env"])
    got = {r.path.removeprefix(root + "/"): r.text for r in files.contents(spark, [f"file:{root}/{n}" for n in own]).collect()}
    assert got == {n: n for n in own}
    (tmp_path / "only").mkdir()
    (tmp_path / "only" / "_x.md").write_text("x")
    assert names(files.walk(spark, str(tmp_path / "only"), 1)) == [f"{tmp_path}/only/_x.md"]


def test_scans_take_a_root_with_a_scheme(spark, folder):
    assert {r.name for r in files.scan_tools(spark, f"file://{folder}", ["*.py"]).collect()} == {"greet"}
    assert {r.name for r in files.scan_resources(spark, f"file://{folder}/", ["sub/**"]).collect()} == {"data.csv", "bin.md"}


def test_new_files_are_numbered_in_path_order(spark, monkeypatch):
    import random

    monkeypatch.setattr(merge, "SAMPLE", 40)
    monkeypatch.setattr(merge, "RANGES", 7)
    paths = [f"/{'abc'[i % 3]}/{random.Random(i).random()}" for i in range(300)]
    rows = spark.createDataFrame([(p,) for p in paths], "path string").repartition(5)
    assert [r.path for r in merge.number_rows(rows, "path", "n").orderBy("n").collect()] == sorted(paths)
    assert [r.n for r in merge.number_rows(rows.limit(1), "path", "n").collect()] == [1] and merge.number_rows(rows.limit(0), "path", "n").count() == 0


def test_store(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    s.write_fingerprint(model="m", model_version="1", dimension=4, chunk_policy="p", quantization="q")
    with pytest.raises(ValueError):
        s.check_fingerprint(model="x", model_version="1", dimension=4, chunk_policy="p", quantization="q")
    assert s.semantic_compatible("q")[0] and not s.semantic_compatible("r")[0]
    s.commit(communities=spark.createDataFrame([(1, "a", 2)], "community_id long, label string, size long"))
    reader = Store(spark, str(tmp_path / "s"))
    s.commit(communities=spark.createDataFrame([], "community_id long, label string, size long"))
    assert reader.table("communities").count() == 1 and Store(spark, str(tmp_path / "s")).table("communities").count() == 0
    s.snapshot(str(tmp_path / "snap"))
    assert s.migrate({4: lambda st: None, 2: None}) == 4


def test_vectors_must_fit(spark):
    schema = "chunk_id long, embedding array<tinyint>"
    with pytest.raises(ValueError):
        search.vector_search(spark.createDataFrame([], schema), None, [1, 2, 3], dimension=4)
    with pytest.raises(Exception, match="components"):
        merge.write_vectors(spark.createDataFrame([], schema), spark.createDataFrame([(1, [1])], schema), 2).collect()


def test_fusion_counts_every_row(spark):
    schema = "node_id long, chunk_id long, score double"
    a = spark.createDataFrame([(10, 1, 3.0), (10, 2, 2.0), (20, 3, 1.0)], schema)
    b = spark.createDataFrame([(20, None, 2.0), (10, None, 1.0)], schema)
    first, second = fusion.fuse({"fts": a, "filename": b}).collect()
    assert first.node_id == 10 and first.matched_sources == "filename,fts,fts" and abs(first.score - (1 / 61 + 1 / 62 + 1 / 62)) < 1e-12
    assert abs(second.score - (1 / 63 + 1 / 61)) < 1e-12


def test_catalogue_rules(spark):
    t = spark.createDataFrame([("a", "f", "d", "{}", "network", "enabled", "ready", "h"), ("b", "f", "d", "bad", "network", "pending", "ready", None)], "name string, source_file string, description string, input_schema string, risk string, state string, dep_state string, content_hash string")
    with pytest.raises(ValueError):
        catalog.review(t, approve=["a"], disable=["a"])
    with pytest.raises(ValueError):
        catalog.review(t, confirm=["r"], resources=["r"])
    got = {r.name: (r.state, r.error) for r in catalog.review(t, approve=["a", "b"]).collect()}
    assert got == {"a": ("enabled", "already enabled"), "b": ("enabled", None)}
    card = json.loads(catalog.agent_card(t, "x", "1").first().card)
    assert [x["name"] for x in card["tools"]] == ["a"]
    assert json.loads(catalog.agent_card(t.limit(0), "x", "1").first().card)["tools"] == []
    assert {r.name: r.decision for r in catalog.invocation(t, F.lit("other")).collect()} == {"a": "deny: content changed", "b": "deny: pending"}
    over = spark.createDataFrame([("b", "enabled", None)], "name string, state string, risk string")
    assert {r.name: (r.state, r.input_schema) for r in catalog.initialise(t, over).collect()}["b"] == ("enabled", "{}")
    with pytest.raises(KeyError):
        catalog.profile_names({}, "none")


def test_quality_metrics(spark):
    hits = spark.createDataFrame([("m", "q", 0, "/x/a.md"), ("m", "q", 1, "/x/a.md"), ("m", "q", 2, "/b.md")], "mode string, query_id string, rank int, path string")
    j = spark.createDataFrame([("q", "a.md", 2), ("q", "b.md", 1), ("q", "c.md", 1)], "query_id string, path string, grade int")
    r = admin.retrieval_quality(hits, j).first()
    assert abs(r.recall - 2 / 3) < 1e-9 and r.ndcg_ref > 1 > r.ndcg > 0
    assert admin.macro_average(admin.retrieval_quality(hits, j)).first().queries == 1


def test_batch_isolates_errors():
    got = nodes.batch([("a", lambda: 1), ("b", lambda: 1 / 0), ("c", lambda: 3)])
    assert [g["result"] for g in got] == [1, None, 3] and "division" in got[1]["warning"]
    with pytest.raises(ValueError):
        nodes.batch([("a", lambda: 1)] * 33)


def test_scans(spark, folder):
    tools = {r.name: r.risk for r in files.scan_tools(spark, str(folder)).collect()}
    assert tools == {"greet": "read_only", "deploy": "side_effects"}
    assert {r.name for r in files.scan_resources(spark, str(folder)).collect()} == {"notes.md", "data.csv", "bin.md"}


def test_audit(spark, tmp_path):
    path = str(tmp_path / "audit")
    rows = spark.createDataFrame([(f"2024-01-01 00:00:{i:02d}", "t", "call", None, None, "ok") for i in range(9)], "timestamp string, tool_name string, action string, params string, caller string, result_status string").withColumn("timestamp", F.to_timestamp("timestamp"))
    audit.append(rows, path)
    (tmp_path / "audit" / "x.json").write_text("not json\n")
    got = audit.tail(spark, path, 10).collect()
    assert len(got) == 10 and got[-1].line == "not json" and got[8].line.startswith("2024-01-01T00:00:08Z")
    q = audit.follow(spark, path).writeStream.format("memory").queryName("followed").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("followed").count() == 10


def test_watching(spark, folder, tmp_path):
    w = watch.Watcher(spark, str(folder))
    assert w.poll() == (None, None)
    (folder / "new.md").write_text("x")
    (folder / "a.py").unlink()
    got = {r.path.rsplit("/", 1)[1]: r.change for r in w.poll()[0].collect()}
    assert got == {"new.md": "created", "a.py": "deleted"}
    source = tmp_path / "snaps"
    source.mkdir()
    lines = [(0, "a", 1, 1, False), (0, "b", 1, 1, False), (1, "a", 2, 1, False), (1, "b", 0, 0, True), (1, "c", 1, 1, False)]
    (source / "s.json").write_text("\n".join(json.dumps(dict(zip(("snapshot", "path", "mtime", "size", "deleted"), x))) for x in lines))
    q = watch.changes(watch.snapshots(spark, str(source))).writeStream.format("memory").queryName("changed").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(90)
    assert {(r.path, r.change) for r in spark.table("changed").collect()} == {("a", "modified"), ("b", "deleted"), ("c", "created")}


def test_config(tmp_path):
    p = tmp_path / "c.yaml"
    assert config.load(str(p))["version"] == 1
    p.write_text("version: 2\n")
    with pytest.raises(ValueError):
        config.load(str(p))
    (tmp_path / ".env").write_text("# c\nA = 'x y'\nB=1\n")
    assert config.load_dotenv(str(tmp_path)) == {"A": "x y", "B": "1"}
