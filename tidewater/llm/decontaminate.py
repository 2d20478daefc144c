"""Benchmark decontamination: one Aho-Corasick automaton over the normalised benchmark, texts scanned once.

Normalised text is its words, A-Z lower-cased, joined by one space, a space at both ends. A window is 13 consecutive
words of an item (all words of a shorter item); the automaton holds every distinct window between spaces, so that a hit
begins and ends at words. A hit's offset leads to a word and from there to the bytes of the original text.

The automaton's size is bounded by ``pattern_bytes``: it goes to every worker once, and a larger benchmark is handled in
groups of windows, one scan for each; hit words and items of a row are united. All scans but the last write the rows to a
scratch table. Benchmarks are curated by hand and don't grow with the corpus.

Nulls: a null text has no words; a null item_id takes part in hits but has no name in items_sha256 and is not counted.
Items with equal ids count once. Rows with null or repeated doc_id are treated like any other.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from .common import Scratch, as_bytes, column_of, read, slices

#: Words are runs of letters, digits and all bytes beyond ASCII: code points over U+007F are in the class as a whole.
WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")
PATTERN_BYTES = 24 << 20
FOUND = pa.schema([("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items", pa.list_(pa.string())), ("contaminated", pa.bool_()), ("spans", pa.list_(pa.list_(pa.int64())))])
FOUND_SQL = "n_words long, n_hit long, n_items long, items array<string>, contaminated boolean, spans array<array<long>>"


def words(text: bytes) -> list[bytes]:
    """Of a lower-cased text."""
    return WORDS.findall(text)


def window_groups(items: Iterator[tuple[int | None, bytes]], n: int, most: float) -> Iterator[dict[bytes, tuple[int, set[str]]]]:
    """Window to its number of words and the items that hold it, in groups of about ``most`` bytes of windows and items."""
    out: dict[bytes, tuple[int, set[str]]] = {}
    size = 0
    for i, text in items:
        w = words(text.lower())
        for s in range(max(1, len(w) - n + 1) if w else 0):
            key = b" ".join(w[s : s + n])
            name = "" if i is None else str(i)
            if out and size + len(key) + len(name) > most:
                yield out
                out, size = {}, 0
            size += len(name) + (0 if key in out else len(key))
            _, own = out.setdefault(key, (min(n, len(w)), set()))
            if i is not None:
                own.add(name)
    if out:
        yield out


def windows(items: Iterator[tuple[int | None, bytes]], n: int) -> dict[bytes, tuple[int, set[str]]]:
    """All windows in one group."""
    return next(window_groups(items, n, float("inf")), {})


def automaton(patterns: dict[bytes, tuple[int, set[str]]]):
    """Latin-1 maps bytes to characters one to one, which is what the library takes."""
    import ahocorasick

    a = ahocorasick.Automaton()
    for key, (n, items) in patterns.items():
        a.add_word(f" {key.decode('latin-1')} ", (n, len(key), tuple(items)))
    a.make_automaton()
    return a


def scan(machine, text: bytes) -> tuple[int, list[tuple[int, int]], set[str]]:
    """Number of words, runs of hit words (first, last + 1), items."""
    w = words(text.lower())
    runs: list[list[int]] = []
    items: set[str] = set()
    if w and machine is not None:
        joined = " " + b" ".join(w).decode("latin-1") + " "
        for end, (n, _, own) in machine.iter(joined):
            last = joined.count(" ", 0, end) if not runs else runs[-1][2] + joined.count(" ", runs[-1][3], end)  # words before the closing space
            items.update(own)
            if runs and last - n <= runs[-1][1]:
                runs[-1][0] = min(runs[-1][0], last - n)
                runs[-1][1:] = [last, last, end]
            else:
                runs.append([last - n, last, last, end])
    return len(w), united([(s, e) for s, e, *_ in runs]), items


def united(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The runs in order; those that touch or overlap are one."""
    merged: list[tuple[int, int]] = []
    for s, e in sorted(runs):
        if merged and s <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(e, merged[-1][1]))
        else:
            merged.append((s, e))
    return merged


def find_contamination(docs: DataFrame, benchmark: DataFrame, n: int = 13, pattern_bytes: int = PATTERN_BYTES, cut: bool = False) -> DataFrame:
    """Per row: row (a struct of all columns), n_words, n_hit, n_items, items (sorted), contaminated and spans (bytes and words: begin and end of each).

    With ``cut`` also left, the text without its hit runs; null for a null text.
    """
    rows = docs.select(F.struct("*").alias("row"))
    items = ((r.item_id, (r.text or "").encode()) for r in benchmark.select("item_id", "text").toLocalIterator())
    groups = window_groups(items, n, pattern_bytes)
    scratch, group = None, next(groups, {})
    for following in groups:
        scratch = scratch or Scratch(docs.sparkSession, "decontamination")
        found = docs.sparkSession.sparkContext.broadcast(group)
        done = scratch.write(scanned(rows, found), "scanned")
        found.destroy()
        scratch.drop(rows)
        rows, group = done, following
    return scanned(rows, docs.sparkSession.sparkContext.broadcast(group), cut)


def scanned(rows: DataFrame, found, cut: bool = False) -> DataFrame:
    """row and what the windows of ``found`` (a broadcast) and those of earlier scans, if there were any, hit in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(found.value) if found.value else None
        for batch in slices(batches, "row.text"):
            before = zip(batch.column("spans").to_pylist(), batch.column("items").to_pylist()) if "spans" in batch.schema.names else repeat(((), ()))
            cols: list[list] = [[] for _ in range(6)]
            left: list[bytes | None] = []
            is_null = column_of(batch, "row.text").is_null().to_pylist()
            for text, gone, (old_spans, old_items) in zip(as_bytes(column_of(batch, "row.text")), is_null, before):
                n_words, runs, items = scan(machine, text)
                runs = united(runs + [(s, e) for *_, s, e in old_spans])
                items.update(old_items)
                hit = sum(e - s for s, e in runs)
                spans = []
                if runs:
                    at = [m.span() for m in WORDS.finditer(text.lower())]
                    spans = [[at[s][0], at[e - 1][1], s, e] for s, e in runs]
                for c, v in zip(cols, (n_words, hit, len(items), sorted(items), hit > 0 and 20 * hit >= n_words, spans)):
                    c.append(v)
                if cut:
                    left.append(None if gone else cut_spans(text, spans))
            more = [pa.array(left, pa.binary()).cast(pa.string())] if cut else []
            yield pa.RecordBatch.from_arrays([batch.column("row"), *(pa.array(c, f.type) for c, f in zip(cols, FOUND)), *more], names=["row", *FOUND.names, *["left"][: len(more)]])

    return rows.mapInArrow(run, StructType([rows.schema["row"], *_parse_datatype_string(FOUND_SQL + (", left string" if cut else "")).fields]))


def cut_spans(text: bytes, spans: list[list[int]]) -> bytes:
    """A text without its hit runs. Runs begin and end at words, which hold whole characters."""
    at, out = 0, []
    for s, e, *_ in spans:
        out.append(text[at:s])
        at = e
    return b"".join([*out, text[at:]])


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 13) -> DataFrame:
    """The documents without contaminated ones; the others lose every hit run, which is a whole window at least. Columns stay as they are.

    A null text stays null. Rows with null or repeated doc_id are treated like any other.
    """
    found = find_contamination(docs, benchmark, n, cut=True).filter(~F.col("contaminated"))
    return found.select(*(F.col("left").alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_contamination(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"))
    return out.select("row.doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP5_SQL = f"""
WITH item AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
win AS (
  SELECT item_id, least(len(w), 13) AS n, array_to_string(w[s:s + 12], ' ') AS k
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS s FROM item WHERE len(w) > 0)
),
lengths AS (SELECT DISTINCT n FROM win),
docs AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
starts AS (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM docs, lengths WHERE len(w) >= n),
hits AS (SELECT rid, s, n, item_id FROM (SELECT rid, s, n, array_to_string(w[s:s + n - 1], ' ') AS k FROM starts) JOIN win USING (n, k)),
hit AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(s, s + n)) AS p FROM hits) GROUP BY rid),
own AS (SELECT rid, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS i FROM hits WHERE item_id IS NOT NULL) GROUP BY rid)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated
FROM docs LEFT JOIN hit USING (rid) LEFT JOIN own USING (rid)
"""
