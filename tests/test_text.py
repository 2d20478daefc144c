import json
import sqlite3

from pyspark.sql import functions as F

from tidewater.functions import scalars as X
from tidewater.functions.porter import fold, stem
from tidewater.functions.wordpiece import WordPiece, split_words
from tidewater.operators.chunks import chunk_code, chunk_prose
from tidewater.operators.symbols import go_symbols, python_symbols
from tidewater.operators.tools import imports_of, openapi_tools, python_tools, script_tools, shell_tools


def test_stems_agree_with_sqlite():
    words = "connections retries agreed relational feed running hopping hoping falling filing happy sky sized plastered caresses ponies ties cats probate rate cease controlling roll generalizations oscillators triplicate electricity adjustable national analogously possibly apologies".split()
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(x, tokenize='porter unicode61')")
    con.execute("CREATE VIRTUAL TABLE v USING fts5vocab(t, 'instance')")
    con.executemany("INSERT INTO t(rowid, x) VALUES (?, ?)", enumerate(words))
    held = dict(con.execute("SELECT doc, term FROM v"))
    assert {w: stem(w) for w in words} == {w: held[i] for i, w in enumerate(words)}
    assert fold("Étude") == "etude"


def test_prose_chunks_have_right_offsets():
    text = "\n\nOne two. " + "wörd " * 300 + "\n\n" + "Sentence here. " * 200 + "x" * 50 + "\n" * 5 + "end"
    raw = text.encode()
    got = chunk_prose(text, 20, 26)
    assert got and all(raw[c["byte_start"] : c["byte_end"]].decode() == c["text"] for c in got)
    assert all(c["token_count"] <= 26 for c in got)
    assert "".join("".join(c["text"].split()) for c in got).count("wörd") == 300


def test_one_long_token_is_cut_at_characters():
    got = chunk_prose("é" * 400, 5, 10, count=lambda s: len(s) // 4)
    assert "".join(c["text"] for c in got) == "é" * 400


def test_python_symbols():
    src = "class A:\n    def m(self):\n        def inner(): pass\n\n@deco\nasync def f(x):\n    return 'é'\n"
    got = [(s["kind"], s["name"], s["line_start"]) for s in python_symbols(src)]
    assert got == [("class", "A", 1), ("method", "m", 2), ("method", "inner", 3), ("function", "f", 6)]


def test_go_symbols():
    src = 'package p\n// func no() {}\ntype (\n\tA struct {\n\t\tx int\n\t}\n\tB = int\n)\ntype I interface{ M() }\nfunc (a *A) M() string {\n\treturn "func x() {"\n}\nfunc F[T any](x T) {}\n'
    assert [(s["kind"], s["name"]) for s in go_symbols(src)] == [("struct", "A"), ("type", "B"), ("interface", "I"), ("method", "M"), ("function", "F")]


def test_code_chunks():
    src = "def f():\n    return 1\n"
    assert chunk_code(src, python_symbols(src))[0]["chunk_kind"] == "code_ast"
    assert chunk_code("x = 1\n", [])[0]["chunk_kind"] == "code_fallback"
    big = "def g():\n" + "    x = 1 + 2\n" * 200
    assert {c["chunk_kind"] for c in chunk_code(big, python_symbols(big))} == {"code_fallback"}


def test_wordpiece():
    v = {t: i for i, t in enumerate(["[PAD]", "[UNK]", "[CLS]", "[SEP]", "un", "##aff", "##able", "etude", "!", "中"])}
    w = WordPiece(v, length=8)
    assert w.tokenize("Unaffable Étude!中 zzz") == ["un", "##aff", "##able", "etude", "!", "中", "[UNK]"]
    e = w.encode("étude")
    assert e["ids"] == [2, 7, 3, 0, 0, 0, 0, 0] and sum(e["mask"]) == 3
    assert split_words("a-b") == ["a", "-", "b"]


def test_tools():
    src = 'import numpy, os\nfrom pandas.io import x\n@tool(name="n", risk="network")\ndef f(a: int, b: list[str] = []) -> str:\n    "Doc."\ndef _p(): pass\nasync def delete_x(): pass\nasync def peek(): pass\n'
    a, b, c = python_tools(src)
    assert (a["name"], a["risk"], a["description"]) == ("n", "network", "Doc. Returns: str.")
    assert a["input_schema"] == '{"type": "object", "properties": {"a": {"type": "integer"}, "b": {"type": "array"}}, "required": ["a"]}'
    assert (b["risk"], b["description"], c["risk"]) == ("destructive", "(async) Tool: delete_x", "side_effects")
    assert imports_of("x.py", src) == ["numpy", "pandas"]
    ts = "/**\n * Adds.\n * @param x\n */\nexport async function add(x: number, y?: string[]) {}\nexport const g = (s: string) => s\nimport a from '@s/p/q'\nconst b = require('fs')\n"
    add, g = script_tools(ts, "a.ts")
    odd = "export const f = function (a, b = 1) {}\nexport const h: (a: string) => void = async (q: Array<number>) => {}\nexport function gen(a /* c, d */) { export const no = (a) => 1 }\nexport const n = 5\nconst s = 'export function no(a) {}'\nclass X { export() {} }\nexport default function main<T>(t: T) {}\n"
    assert [(t["name"], sorted(json.loads(t["input_schema"])["properties"])) for t in script_tools(odd, "a.ts")] == [("f", ["a", "b"]), ("h", ["q"]), ("gen", ["a"]), ("main", ["t"])]
    assert add["description"] == "Adds." and '"required": ["x"]' in add["input_schema"] and g["name"] == "g"
    assert imports_of("a.ts", ts) == ["@s/p"]
    assert shell_tools("#!/bin/sh\n\n# Deploys it\n", "/x/deploy.sh")[0]["description"] == "Deploys it"
    spec = "openapi: 3.0.0\ninfo: {title: t, version: '1'}\npaths:\n  /pets/{id}:\n    delete: {summary: Gone, parameters: [{name: id, in: path, required: true, schema: {type: string}}], responses: {'204': {description: gone}}}\n"
    (o,) = openapi_tools(spec)
    assert (o["name"], o["risk"]) == ("delete_pets__id_", "destructive") and openapi_tools("a: 1") == []
    for broken in (spec.replace("responses", "answers"), spec.replace("name: id,", "name: x,"), spec.replace("title: t, ", ""), spec.replace("/pets", "pets"), spec.replace("required: true, ", "")):
        assert openapi_tools(broken) == []
    ref = spec.replace("schema: {type: string}", "schema: {$ref: '#/components/schemas/Id'}") + "components:\n  schemas:\n    Id: {type: integer, description: a number}\n"
    assert '"id": {"type": "integer", "description": "a number"}' in openapi_tools(ref)[0]["input_schema"]


def test_scalars(spark):
    assert X.normalize_path("a\\b/../c/") == "/a/c" and X.normalize_path("") == "/"
    assert X.prefix_upper_bound("a/") == "a0" and X.prefix_upper_bound("\U0010ffff") is None
    assert X.decode_cursor(X.encode_cursor(7)) == 7 and X.decode_cursor("??") == 0
    assert [X.clamp_k(k) for k in (0, 7, 1000)] == [20, 7, 100]
    df = spark.createDataFrame([("aé" * 40, '{"a":1,"b":2}', '{ "b":2, "a":1 }', "sk-aaaaaaaaaaaaaaaaaaaaaaaa")], "t string, j string, k string, s string")
    for n in range(1, 12):
        want = df.first().t.encode()[:n].decode("utf-8", "ignore") + "…"
        assert df.select(X.truncate_bytes(F.col("t"), n, "…")).first()[0] == want
    r = df.select(X.json_equal(F.col("j"), F.col("k")), X.redact(F.col("s")), X.format_size(F.lit(1536)), X.mask_key(F.lit("abcdefghijklmn"))).first()
    assert tuple(r) == (True, "[REDACTED]", "1.5 KB", "abcdefg***klmn")
    sizes = [1023, 1024, 1280, 1792, 1331, 1048575, 1048576, 1310720, 123456789]
    got = spark.createDataFrame([(n,) for n in sizes], "n long").select(X.format_size(F.col("n"))).collect()
    assert [x[0] for x in got] == [f"{n} B" if n < 1024 else f"{n / 1024:.1f} KB" if n < 1 << 20 else f"{n / (1 << 20):.1f} MB" for n in sizes]
    cut = df.select(X.redact(F.lit("é" * 30), 7)).first()[0]
    assert cut == "ééé... [output truncated at 7 bytes]"
    assert df.select(X.is_binary(F.lit(b"a\x00b")), X.mime_of(F.lit(b"%PDF-1.4")), X.content_class(F.lit("/x.PY"), F.lit("x"), F.lit(b"\x00"))).first()[0:3] == (True, "application/pdf", "unknown")


def test_globs(spark):
    df = spark.createDataFrame([(p,) for p in ("a.py", "x/a.py", "x/y/a.py", "x/b.txt")], "p string")
    got = lambda i, e: sorted(r.p for r in df.filter(X.matches_globs(F.col("p"), i, e)).collect())
    assert got(["**/*.py"], ["x/y/**"]) == ["a.py", "x/a.py"] and got(["*.py"], []) == ["a.py"] and len(got([], [])) == 4
