"""Null, repeated and empty rows through the pipeline's stages, each row's result stated."""

import random

from tidewater.llm import quality

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_nulls_pass_all_stages(spark, tmp_path, monkeypatch):
    import corpus_pipeline

    rng = random.Random(3)
    text = lambda n: " ".join(f"word{rng.randrange(10**6)}" for _ in range(n))
    a, b = text(60), text(70)
    rows = [(1, a, "en", "s", 1), (1, b, None, None, None), (2, None, None, None, None), (2, None, None, None, None), (None, None, None, None, None), (None, a, "en", "s", 1), (3, "", "en", "s", 0), (4, a, "en", "s", 1), (5, text(5000), "de", "s", 1)]
    benchmark = [(1, " ".join(b.split()[20:26])), (None, None), (2, "")]
    spark.createDataFrame(benchmark, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(None, 1, 0), (1, None, None), (3, 7, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    held = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        held[name] = sorted(((r.doc_id, r.text) for r in docs.collect()), key=repr) if name != "packing" else docs.collect()
    whole = sorted(((r[0], r[1]) for r in rows), key=repr)
    assert held["quality"] == whole and held["line dedup"] == whole  # no labels: the smoothed share keeps all
    # near copies: 4 copies 1's text; 2 and 3 have the empty text, of which the smallest id stays
    assert held["near copies"] == sorted([(1, a), (1, b), (2, None), (None, None), (None, a), (5, rows[8][1])], key=repr)
    cut = " ".join(b.split()[:20]) + "  " + " ".join(b.split()[26:])
    gone = 20 * 6 >= 70  # the item's words are over a twentieth of b
    assert held["decontamination"] == sorted([x for x in held["near copies"] if x != (1, b)] + ([] if gone else [(1, cut)]), key=repr)
    assert {r.doc_id for r in held["packing"]} == {1, 2, 5, None}


def test_pooling_is_what_plain_loops_give():
    rng = random.Random(1)
    texts = [b"", b" \n", " ".join(f"w{rng.randrange(30)}!" for _ in range(80)).encode(), "Straße é a-b ".encode() * 9, b"x" * 5000]
    table = quality.np.random.default_rng(2).normal(size=(quality.WORDS, quality.DIMS)).astype("float32")
    got = quality.pool(texts, table)
    for text, row in zip(texts, got):
        own = quality.tokens([text])[0].tolist()
        if not own:
            assert not row.any()
            continue
        for d in range(quality.DIMS):
            values = [float(table[w, d]) for w in own]
            mean = sum(values) / len(values)
            assert abs(row[d] - mean) < 1e-6
            assert abs(row[quality.DIMS + d] - (max(0, sum(v * v for v in values) / len(values) - mean * mean)) ** 0.5) < 1e-3
        assert abs(row[2 * quality.DIMS] - max(map(own.count, own)) / len(own)) < 1e-9
        assert abs(row[2 * quality.DIMS + 1] - len(set(own)) / len(own)) < 1e-9


def test_scores_are_what_plain_loops_give():
    import math

    rng = quality.np.random.default_rng(4)
    x = rng.normal(size=(300, 5))
    y = (x[:, 0] + x[:, 1] * x[:, 2] > 0).astype(int)
    net = quality.Network(x, y, rng.random(300) < 0.2)
    for row, score in zip(x[:20], net.score(x[:20])):
        z = [min(8, max(-8, (v - m) / s)) for v, m, s in zip(row, net.mean, net.scale)]
        hidden = [math.tanh(sum(z[i] * net.p[0][i, j] for i in range(5)) + net.p[1][j]) for j in range(len(net.p[1]))]
        logit = sum(h * w for h, w in zip(hidden, net.p[2])) + float(net.p[3])
        assert abs(score - 1 / (1 + math.exp(-logit / net.temperature))) < 1e-9
    assert ((net.score(x) >= 0.5) == y).mean() > 0.9
