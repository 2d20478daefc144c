"""Suffix-array dedup: a hash-compared suffix sort decides which 50-byte strings earlier documents hold.

Every window of ``n`` bytes has an anchor: the leftmost smallest hash of its k-byte strings. Equal windows have equal
anchors at equal places, so that only windows whose anchor other documents hold too can repeat (sharing.answer, one
round over all documents). Neighbouring windows with one anchor are an entry: the bytes that they span.

Entries go to bins by their anchor's hash. There the suffixes from the anchors on, and the prefixes before them read
backwards, are put in order by a merge sort. Two suffixes are compared by their longest common extension, found by binary
search over prefix polynomial hashes: a logarithmic number of steps. Extensions between neighbours in the final order are
then verified byte by byte, and a bin with a collision is sorted again by its bytes. The windows with a bytes before the
anchor are equal where the prefixes share a bytes and the suffixes n - a; the smallest doc_id of each class goes back,
as runs of windows, to the chunks whose documents come later.

A chunk states an entry once. Anchors that very many chunks hold, or one chunk in very many entries, are split: each of
their windows is an entry of its own, placed by the window's hash. So no bin holds an unbounded group.

Nulls: a null text is empty. A row with null doc_id takes no part and keeps its bytes. Rows that repeat a doc_id don't
remove each other's bytes. ``kept`` is binary, as cuts may fall within a character.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, as_bytes, batch_of, ranges, read, slices
from .sharing import BYTES, FIRST, ROW_SQL, SECOND, Chunk, Layout, U, answer, answers, copy_rows, distinct, each_row, expand, mix, powers, prefix, rows_table, span_hash, squeeze, state, text_rows

#: Bytes of the strings whose hashes are anchors.
K = 16
#: Chunks that hold an anchor, and entries of one anchor in one chunk, beyond which it is split; entries of a bin.
HOT, LOTS, BIN = 256, 64, 40_000
DENSITY, ENTRIES = 0.06, 0.015
OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])
OUT_SQL = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"
TIMES = OUT.append(pa.field("times", pa.int64()))


class Slab:
    """Some documents' bytes, with the entries of their windows: windows [low, low + count) have the anchor at ``place``."""

    def __init__(self, own: list[int], a: np.ndarray, at: np.ndarray, n: int):
        self.own, self.a, self.at, self.n = own, a, at, n
        self.sums = prefix(BYTES[0][a])
        if len(a) < n:
            self.low = self.count = self.place = np.zeros(0, np.int64)
            self.anchor = np.zeros(0, U)
            return
        grams = np.arange(len(a) - K + 1)
        h = mix(span_hash(self.sums, grams, grams + K), 3)
        bits = max(1, int(len(a)).bit_length())
        low = (h >> U(bits) << U(bits)) | grams.astype(U)  # ties go to the leftmost
        w, size = n - K + 1, 1
        while size * 2 <= w:
            low = np.minimum(low[:-size], low[size:])
            size *= 2
        if w > size:
            low = np.minimum(low[: len(low) - (w - size)], low[w - size :])
        place = (low & U((1 << bits) - 1)).astype(np.int64)
        ok = np.ones(len(place), bool)
        for end in at[1:-1].tolist():  # windows over the end of a document
            ok[max(0, end - n + 1) : end] = False
        ok[max(0, int(at[-1]) - n + 1) :] = False
        starts = np.flatnonzero(ok)
        place = place[starts]
        new = np.concatenate([[True], (np.diff(starts) != 1) | (np.diff(place) != 0)]) if len(starts) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        self.low, self.place = starts[first], place[first]
        self.count = np.diff(np.append(first, len(starts)))
        self.anchor = h[self.place]

    def doc(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.at, position, side="right") - 1


class Entries:
    """Distinct entries of a chunk in a fixed order, and all their occurrences."""

    def __init__(self, chunk: Chunk, n: int, buckets: int, bins: int):
        u, said = anchors(chunk, n)[0], None
        said = answers(chunk, FIRST, u, buckets)
        parts: list[tuple] = []
        self.slabs: list[Slab] = []
        for s in slabs(chunk, n):
            level = said[np.searchsorted(u, s.anchor)] if len(u) else np.zeros(0, np.uint8)
            cold, hot = np.flatnonzero(level == 1), np.flatnonzero(level == 2)
            single = ranges(s.low[hot], s.count[hot])
            low = np.concatenate([s.low[cold], single])
            count = np.concatenate([s.count[cold], np.ones(len(single), np.int64)])
            place = np.concatenate([s.place[cold], single])
            whole = [span_hash(prefix(BYTES[w][s.a], w), low, low + count + n - 1, w) for w in (0, 1)]
            key = np.concatenate([s.anchor[cold], mix(whole[0][len(cold) :], 9)])
            ids = np.array([chunk.docs[k][0] for k in s.own], np.int64)
            parts.append((key, place - low, count, mix(whole[0] + (place - low).astype(U), 4), mix(whole[1], 5), ids[s.doc(low)], np.full(len(low), len(self.slabs)), low))
            self.slabs.append(s)
        self.key, before, count, h1, h2, doc, slab, low = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, t) for t in (U, int, int, U, U, int, int, int))
        order = np.lexsort((doc, h2, h1, self.key, self.key % U(bins)))
        self.key, self.before, self.count, h1, h2, self.doc, self.slab, self.low = (x[order] for x in (self.key, before, count, h1, h2, doc, slab, low))
        new = (self.key[1:] != self.key[:-1]) | (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        self.first = np.flatnonzero(np.concatenate([[True], new])) if len(order) else np.zeros(0, np.int64)
        self.entry = np.cumsum(np.concatenate([[0], new])) if len(order) else np.zeros(0, np.int64)  # of each occurrence
        self.last = np.append(self.first[1:], len(order)) - 1
        self.bin = (self.key[self.first] % U(bins)).astype(np.int64)

    def rows(self, number: int, n: int) -> list[list]:
        """SECOND rows: for each bin, the entries' keys, smallest and largest doc_id, bytes before the anchor and windows; their bytes."""
        rows: list[list] = [[] for _ in range(6)]
        cuts = np.flatnonzero(np.diff(self.bin)) + 1
        for part in np.split(np.arange(len(self.first)), cuts) if len(self.first) else ():
            f, e = self.first[part], self.last[part]
            head = np.stack([self.key[f], self.doc[f].view(U), self.doc[e].view(U), self.before[f].astype(U), self.count[f].astype(U)], 1)
            body = b"".join(self.slabs[s].a[p : p + c + n - 1].tobytes() for s, p, c in zip(self.slab[f].tolist(), self.low[f].tolist(), self.count[f].tolist()))
            for c, v in zip(rows, (number, SECOND, self.bin[part[0]], squeeze(head), squeeze(body), b"")):
                c.append(v)
        return rows


def slabs(chunk: Chunk, n: int) -> Iterator[Slab]:
    for own, a, at in chunk.slabs():
        yield Slab(own, a, at, n)


def anchors(chunk: Chunk, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct anchors, and 0, 1 or 2: held by one document, by several, or by very many entries."""
    found, docs = [], []
    for s in slabs(chunk, n):
        found.append(s.anchor)
        docs.append(np.array([chunk.docs[k][0] for k in s.own], np.int64)[s.doc(s.low)])
    if not found:
        return np.zeros(0, U), np.zeros(0, np.uint8)
    a, d = np.concatenate(found), np.concatenate(docs)
    order = np.argsort(a, kind="stable")
    a, d = a[order], d[order]
    if not len(a):
        return a, np.zeros(0, np.uint8)
    first = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
    many = np.minimum.reduceat(d, first) != np.maximum.reduceat(d, first)
    return a[first], many.astype(np.uint8) + (many & (np.diff(np.append(first, len(a))) > LOTS))


class Strings:
    """Strings in one buffer, compared by their longest common extension."""

    def __init__(self, flat: np.ndarray, start: np.ndarray, length: np.ndarray):
        self.flat, self.start, self.length = np.append(flat, 0).astype(np.uint8), start, length
        self.sums = prefix(BYTES[1][flat], 1)
        self.inverse = powers(1, len(flat) + 1, True)

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Longest common prefixes by binary search over prefix hashes."""
        p, q = self.start[i], self.start[j]
        low, high = np.zeros(len(i), np.int64), np.minimum(self.length[i], self.length[j])
        ip, iq, sp, sq = self.inverse[p], self.inverse[q], self.sums[p], self.sums[q]
        while (open_ := low < high).any():
            mid = (low + high + 1) >> 1
            same = (self.sums[p + mid] - sp) * ip == (self.sums[q + mid] - sq) * iq
            low = np.where(open_ & same, mid, low)
            high = np.where(open_ & ~same, mid - 1, high)
        return low

    def below(self, i: np.ndarray, j: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        """Whether string i comes before string j."""
        n = self.common(i, j)
        li, lj = self.length[i], self.length[j]
        a = np.where(n < li, self.flat[self.start[i] + np.minimum(n, np.maximum(li - 1, 0))].astype(np.int16), -1)
        b = np.where(n < lj, self.flat[self.start[j] + np.minimum(n, np.maximum(lj - 1, 0))].astype(np.int16), -1)
        return (a < b) | (or_equal & (a == b))

    def sort(self, group: np.ndarray) -> np.ndarray:
        """A stable merge sort within groups; ``group`` is sorted. All merges of a level run at once."""
        order = np.arange(len(group))
        first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.zeros(0, np.int64)
        size = np.diff(np.append(first, len(group)))
        begin, size = np.repeat(first, size), np.repeat(size, size)
        offset = np.arange(len(group)) - begin
        width = 1
        while (active := np.flatnonzero(size > width)).size:
            o = offset[active]
            pair = o - o % (2 * width)
            is_left = o % (2 * width) < width
            s0 = begin[active] + pair + np.where(is_left, width, 0)  # the other run
            end = begin[active] + np.minimum(pair + np.where(is_left, 2 * width, width), size[active])
            low, high = np.minimum(s0, end), end
            s0 = low.copy()
            me = order[active]
            while (todo := np.flatnonzero(low < high)).size:
                mid = (low[todo] + high[todo]) >> 1
                # an element of the left run goes before equal ones of the right run
                goes = self.below(order[mid], me[todo], ~is_left[todo])
                low[todo] = np.where(goes, mid + 1, low[todo])
                high[todo] = np.where(goes, high[todo], mid)
            to = begin[active] + pair + o % width + (low - s0)
            new = order.copy()
            new[to] = me
            order = new
            width *= 2
        return order

    def neighbours(self, order: np.ndarray, group: np.ndarray, most: int) -> tuple[np.ndarray, bool]:
        """Verified common prefixes of each string and the one before it in order (-1 across groups); whether hashes agree."""
        out = np.full(len(order), -1, np.int64)
        at = np.flatnonzero(np.concatenate([[False], group[1:] == group[:-1]])) if len(order) else np.zeros(0, np.int64)
        i, j = order[at - 1], order[at]
        n = np.minimum(self.length[i], self.length[j])
        alike = np.ones(len(at), bool)
        real = np.zeros(len(at), np.int64)
        for k in range(most):
            alike = alike & (k < n)
            alike = alike & (self.flat[np.minimum(self.start[i] + k, len(self.flat) - 1)] == self.flat[np.minimum(self.start[j] + k, len(self.flat) - 1)])
            if not alike.any():
                break
            real += alike
        out[at] = real
        return out, bool((real == self.common(i, j)).all())

    def ordered(self, group: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        order = self.sort(group)
        shared, right = self.neighbours(order, group, most)
        if not right:  # a collision of hashes: sort by the bytes themselves
            keys = [self.flat[self.start[i] : self.start[i] + self.length[i]].tobytes() for i in range(len(group))]
            order = np.array(sorted(range(len(group)), key=lambda i: (group[i], keys[i])), np.int64)
            shared, _ = self.neighbours(order, group, most)
        return order, shared


def smallest(key: np.ndarray, doc: np.ndarray, before: np.ndarray, count: np.ndarray, flat: np.ndarray, n: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Entries sorted by key: for each number of bytes before the anchor, the entries with such a window, its number and its smallest doc_id."""
    size = count + n - 1
    start = np.cumsum(size) - size
    suffix = Strings(flat, start + before, np.minimum(size - before, n))
    back = len(flat) - (start + before)
    prefixes = Strings(flat[::-1].copy(), back, np.minimum(before, n))
    rank = []
    for s in (suffix, prefixes):
        order, shared = s.ordered(key, n)
        rank.append((order, shared, np.empty(len(key), np.int64)))
    for a in range(int(before.max(initial=-1)) + 1):
        for (order, shared, out), length in zip(rank, (n - a, a)):
            out[order] = np.cumsum(shared < length) if length else np.cumsum(shared < 0)
        window = before - a
        has = np.flatnonzero((window >= 0) & (window < count))
        cls = rank[0][2][has] * (len(key) + 1) + rank[1][2][has]
        order = np.argsort(cls, kind="stable")
        cls = cls[order]
        first = np.flatnonzero(np.concatenate([[True], cls[1:] != cls[:-1]])) if len(cls) else np.zeros(0, np.int64)
        low = np.empty(len(has), np.int64)
        low[order] = np.repeat(np.minimum.reduceat(doc[has][order], first), np.diff(np.append(first, len(cls)))) if len(cls) else low
        yield has, window[has], low


def settle(table: pa.Table, n: int) -> pa.Table:
    """Answers to a bin's entries: runs of windows whose smallest doc_id lies below a document that has the entry."""
    chunk, bucket, x, y = (table.column(c).to_pylist() for c in ("chunk", "bucket", "x", "y"))
    heads = [expand(v, U).reshape(-1, 5) for v in x]
    owner = np.repeat(np.arange(len(heads)), [len(h) for h in heads])
    local = np.concatenate([np.arange(len(h)) for h in heads])
    head = np.concatenate(heads)
    flat = np.frombuffer(b"".join(expand(v) for v in y), np.uint8)
    count = head[:, 4].astype(np.int64)
    size = count + n - 1
    begin = np.cumsum(size) - size
    order = np.argsort(head[:, 0], kind="stable")
    key = head[order, 0]
    several = np.concatenate([[False], key[1:] == key[:-1]])
    several[:-1] |= several[1:].copy()
    low_doc, high_doc = head[:, 1].view(np.int64), head[:, 2].view(np.int64)
    several |= (low_doc != high_doc)[order]
    order = order[several]
    head, key, low_doc, high_doc, count, owner, local = head[order], head[order, 0], low_doc[order], high_doc[order], count[order], owner[order], local[order]
    flat = flat[ranges(begin[order], size[order])]
    found: list[tuple] = [(e, w, m) for e, w, m in smallest(key, low_doc, head[:, 3].astype(np.int64), count, flat, n)]
    e, w, m = (np.concatenate(v) for v in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
    good = m < high_doc[e]
    e, w, m = e[good], w[good], m[good]
    order = np.lexsort((w, e))
    e, w, m = e[order], w[order], m[order]
    new = np.concatenate([[True], (e[1:] != e[:-1]) | (m[1:] != m[:-1]) | (w[1:] != w[:-1] + 1)]) if len(e) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(e)) - 1
    runs = np.stack([local[e[first]], w[first], w[last] + 1, m[first]], 1) if len(first) else np.zeros((0, 4), np.int64)
    who = owner[e[first]]
    return rows_table([chunk, [SECOND] * len(chunk), bucket, [b""] * len(chunk), [squeeze(runs[who == k]) for k in range(len(chunk))], [b""] * len(chunk)])


def dedup_suffixes(docs: DataFrame, n: int = 50) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (the bytes that are left) of every row."""
    scratch = Scratch(docs.sparkSession, "suffixes")
    plan = Layout(docs, DENSITY)
    chunks, buckets = plan.chunks, plan.buckets
    bins = max(1, round(plan.chunks * (6 << 20) * ENTRIES / BIN))
    base = text_rows(docs, chunks).unionByName(scratch.write(copy_rows(docs, chunks, scratch), "copies"))

    def say_anchors(table):
        chunk = Chunk(table)
        u, level = anchors(chunk, n)
        return rows_table(state(chunk.number, FIRST, u, u[:0], level, buckets))

    def say_entries(table):
        chunk = Chunk(table)
        return rows_table(Entries(chunk, n, buckets, bins).rows(chunk.number, n))

    def remove(table):
        chunk = Chunk(table)
        entries = Entries(chunk, n, buckets, bins)
        covered = [np.zeros(len(s.a) + 1, np.int64) for s in entries.slabs]
        for b, said in chunk.answers.get(SECOND, {}).items():
            at = int(np.searchsorted(entries.bin, b))
            for part in said:
                e, f, t, m = expand(part, np.int64).reshape(-1, 4).T
                e = e + at
                times = entries.last[e] - entries.first[e] + 1
                occ = ranges(entries.first[e], times)
                f, t, m = (np.repeat(v, times) for v in (f, t, m))
                hit = m < entries.doc[occ]
                occ, f, t = occ[hit], f[hit], t[hit]
                for k in np.unique(entries.slab[occ]).tolist():
                    own = entries.slab[occ] == k
                    np.add.at(covered[k], entries.low[occ[own]] + f[own], 1)
                    np.add.at(covered[k], entries.low[occ[own]] + t[own] - 1 + n, -1)
        kept: dict[int, np.ndarray] = {}
        for s, c in zip(entries.slabs, covered):
            gone = np.cumsum(c)[:-1] > 0
            for k, p, q in zip(s.own, s.at[:-1].tolist(), s.at[1:].tolist()):
                if gone[p:q].any():
                    kept[k] = ~gone[p:q]
        out: list[list] = [[] for _ in range(6)]
        for k, (i, text) in enumerate(chunk.docs):
            left, removed, spans = text, 0, 0
            if chunk.is_copy(i, text):
                if len(text) >= n:
                    left, removed, spans = b"", len(text), 1
            elif (mask := kept.get(k)) is not None:
                left = np.frombuffer(text, np.uint8)[mask].tobytes()
                removed = len(text) - len(left)
                spans = int((~mask & np.concatenate([[True], mask[:-1]])).sum())
            for c, v in zip(out, (i, len(text), removed, spans, left, chunk.times[k])):
                c.append(v)
        return pa.Table.from_batches([batch_of(TIMES, *out)], TIMES)

    first = scratch.write(answer(base.groupBy("chunk").applyInArrow(say_anchors, ROW_SQL), 5, HOT), "anchors")
    scratch.clear()
    entries = base.unionByName(first).groupBy("chunk").applyInArrow(say_entries, ROW_SQL)
    second = scratch.write(entries.groupBy("bucket").applyInArrow(lambda table: settle(table, n), ROW_SQL), "windows")
    scratch.clear()
    done = base.unionByName(first).unionByName(second).groupBy("chunk").applyInArrow(remove, OUT_SQL + ", times long")
    return each_row(done).unionByName(whole(docs.filter("doc_id IS NULL")))


def whole(docs: DataFrame) -> DataFrame:
    """Rows that keep all their bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts = as_bytes(batch.column("text"))
            yield batch_of(OUT, batch.column("doc_id"), [len(x) for x in texts], [0] * len(texts), [0] * len(texts), texts)

    return docs.select("doc_id", "text").mapInArrow(run, OUT_SQL)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_suffixes(read(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


OP2_SQL = """
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
parts AS (SELECT rid, doc_id, x, length(x) // 2 - 49 AS n, unnest(range(0, greatest(length(x) // 2 - 49, 0), 1000)) AS p FROM docs),
starts AS (SELECT rid, doc_id, p, y, unnest(range(0, m)) AS s FROM (SELECT rid, doc_id, p, substr(x, 2 * p + 1, 2098) AS y, least(1000, n - p) AS m FROM parts)),
windows AS (SELECT rid, doc_id, p + s AS s, md5_number(substr(y, 2 * s + 1, 100)) AS k FROM starts),
low AS (SELECT k, min(doc_id) AS low FROM windows GROUP BY k HAVING min(doc_id) < max(doc_id)),
hit AS (SELECT rid, s FROM windows JOIN low USING (k) WHERE low.low < doc_id),
spans AS (
  SELECT rid, min(s) AS a, max(s) + 50 AS b FROM (
    SELECT rid, s, sum(CASE WHEN s > p + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY rid ORDER BY s) AS g
    FROM (SELECT rid, s, coalesce(lag(s) OVER (PARTITION BY rid ORDER BY s), s) AS p FROM hit)
  ) GROUP BY rid, g
),
gaps AS (
  SELECT rid, coalesce(lag(b) OVER (PARTITION BY rid ORDER BY a), 0) AS a, a AS b, b - a AS n FROM spans
),
tail AS (SELECT rid, max(b) AS b, count(*) AS n_spans, sum(b - a) AS n_removed FROM spans GROUP BY rid),
kept AS (
  SELECT g.rid, string_agg(substr(x, 2 * g.a + 1, 2 * (g.b - g.a)), '' ORDER BY g.a) AS k FROM gaps g JOIN docs USING (rid) GROUP BY g.rid
)
SELECT doc_id, length(x) // 2 AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(CASE WHEN tail.b IS NULL THEN x ELSE k || substr(x, 2 * tail.b + 1) END)) AS kept_sha256
FROM docs LEFT JOIN tail USING (rid) LEFT JOIN kept USING (rid)
"""
