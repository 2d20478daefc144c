"""Substring dedup by recompression: Spark rounds name runs and pairs, shared names reveal and verify long repeats.

A text is a row of words. In the first round every distinct word gets a name, a number; in each further round first every
run of one symbol is a block, then every left-class symbol followed by a right-class one is a pair, and every distinct
block and pair gets a name. Names are given by Spark: the chunks of documents state their distinct words, blocks or pairs
by content, a bucket of the contents' hash space counts and numbers those that occur more than once in the corpus, and the
names go back. So a name means one sequence of words wherever it stands: contents are compared, not their hashes (a
word of more than 15 bytes is its BLAKE2b digest).

Classes depend on names alone. Within equal runs of words, all symbols agree but a few at either end: the first symbol
may have joined what stands before it, the last what stands after. For each window of ``n`` words ``advance`` keeps
the zone of symbols that only the window decides. A window that repeats has only repeating symbols in its zone. One with
a symbol that has got no name is dropped, and only words and symbols under the windows that are left go into the next round.

Most windows of a corpus repeat nothing. To spare them the rounds, a sieve goes before: the same recompression with 64-bit
hashes for names, which needs no tables (``zones``), and one exchange that tells which of its last symbols occur more
than once (sharing.answer). It drops only windows that can't repeat; what is left is decided by the rounds.

After the rounds, each window has an anchor, the rarest symbol of its last zone. Neighbouring windows with one anchor
are an entry, the row of word names that they span. Entries with the same anchor are put side by side and compared word by
word, outwards from the anchor, so that windows are equal where their words are. Equal entries are counted before. An
anchor of more than LOTS different entries is split: each of its windows is then counted by its own row of names.

Exact copies of whole texts are found before by SHA-256, and one of them is compared (sharing.copy_rows); entries are
told apart by SHA-256 on their way back to the chunks. Words under a window that occurs again go.

Nulls: a null text has no words. A row with null doc_id takes no part and keeps its words. Rows that repeat doc_id and
text are one document; each comes out. Rows that repeat a doc_id with other texts are documents of their own.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, as_bytes, batch_of, ranges, read, slices
from .sharing import BYTES, FIRST, ROW_SQL, SECOND, Chunk, Layout, U, answer, answers, copy_rows, distinct, each_row, expand, mix, prefix, rows_table, span_hash, squeeze, state, text_rows

WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
IS_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
#: Rounds of the sieve, and of blocks and pairs; different entries of an anchor beyond which it is split; entries of a bin.
SIEVE, ROUNDS, LOTS, BIN = 6, 4, 2_000, 20_000
OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("text", pa.string())])
OUT_SQL = "doc_id long, n_words long, n_removed long, text string"
TIMES = OUT.append(pa.field("times", pa.int64()))
ENTRY = pa.schema([("chunk", pa.int32()), ("no", pa.int32()), ("anchor", pa.int64()), ("before", pa.int32()), ("count", pa.int32()), ("words", pa.binary()), ("n", pa.int64()), ("state", pa.binary())])
ENTRY_SQL = "chunk int, no int, anchor long, before int, count int, words binary, n long, state binary"
#: Symbols and contents that a byte of text gives, about, for the number of buckets.
DENSITY = 0.1
#: The kind of rows that hold a chunk's state between the rounds; of those with contents and names it is SECOND.
STATE = 9

Arrays = dict[str, np.ndarray]
#: Arrays whose differences are small.
RISING = ("at", "first", "start", "left", "right", "s_start", "s_place")


def freeze(state: Arrays) -> bytes:
    return squeeze(pickle.dumps({k: np.diff(v, prepend=v.dtype.type(0)) if k in RISING else v for k, v in state.items()}))


def thaw(blob: bytes) -> Arrays:
    return {k: np.cumsum(v, dtype=v.dtype) if k in RISING else v for k, v in pickle.loads(expand(blob)).items()}


def hash_words(a: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A hash of each word, its document, and where each document's words begin."""
    space = IS_SPACE[a]
    first = np.zeros(len(a) + 1, bool)
    first[at] = True
    word = ~space
    before = np.concatenate([[True], space[:-1]]) | first[:-1]
    start = np.flatnonzero(word & before)
    after = np.concatenate([space[1:], [True]]) | first[1:]
    end = np.flatnonzero(word & after) + 1
    h = mix(span_hash(prefix(BYTES[0][a]), start, end) + U(0x51ED) * (end - start).astype(U))
    doc = np.searchsorted(at, start, side="right") - 1
    return h, doc, np.searchsorted(start, at)


def zones(name: np.ndarray, doc: np.ndarray, left: np.ndarray, right: np.ndarray, rounds: int = SIEVE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names after the last round, and for each window of words [left, right) its interior symbols [left, right)."""
    if not len(name):
        return name, left, right
    # runs: the first and the last run of a window may go on outside
    new = np.concatenate([[True], (name[1:] != name[:-1]) | (doc[1:] != doc[:-1])])
    index = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    length = np.diff(np.append(first, len(name)))
    left, right = index[left] + 1, index[right - 1]
    name, doc = mix(name[first] + length.astype(U) * U(0xD6E8FEB86659FD93), 11), doc[first]
    for r in range(rounds):
        is_right = (mix(name, 100 + r) & U(1)).astype(bool)
        joins = np.concatenate([~is_right[:-1] & is_right[1:] & (doc[1:] == doc[:-1]), [False]])  # with the next
        joined = np.concatenate([[False], joins[:-1]])
        index = np.cumsum(~joined) - 1
        open_ = left < right
        # a right-class symbol at the beginning may belong to what stands before, a left-class one at the end to what comes after
        left = left + (open_ & is_right[np.minimum(left, len(name) - 1)])
        open_ = left < right
        right = right - (open_ & ~is_right[np.maximum(right - 1, 0)])
        open_ = left < right
        left, right = np.where(open_, index[np.minimum(left, len(name) - 1)], 0), np.where(open_, index[np.maximum(right - 1, 0)] + 1, 0)
        first = np.flatnonzero(~joined)
        second = np.minimum(first + 1, len(name) - 1)
        name, doc = np.where(joins[first], mix(name[first] * U(0xA24BAED4963EE407) + mix(name[second], 7), 200 + r), name[first]), doc[first]
    return name, left, right


class Slab:
    """Windows and hashed symbols of some documents."""

    def __init__(self, a: np.ndarray, at: np.ndarray, n: int):
        h, doc, self.begin = hash_words(a, at)
        starts = np.arange(max(0, len(doc) - n + 1))
        self.windows = starts[doc[starts] == doc[starts + n - 1]]
        self.names, self.left, self.right = zones(h, doc, self.windows, self.windows + n)

    def candidates(self, shared: np.ndarray) -> np.ndarray:
        """The windows all of whose interior symbols are shared."""
        alone = np.concatenate([[0], np.cumsum(~shared)])
        return self.windows[alone[np.maximum(self.left, self.right)] == alone[self.left]] if len(self.windows) else self.windows


def slabs(chunk: Chunk, n: int) -> Iterator[Slab]:
    for _, a, at in chunk.slabs():
        yield Slab(a, at, n)


def code_of(word: bytes) -> bytes:
    """16 bytes that stand for a word: itself with its length, or a digest of a longer one."""
    return word.ljust(15, b"\0") + bytes([len(word)]) if len(word) < 16 else blake2b(word, digest_size=15).digest() + b"\xff"


def begin(docs: list[list[bytes]], start: np.ndarray, n: int) -> tuple[Arrays, np.ndarray, np.ndarray]:
    """The state before the first round, from the windows that the sieve has left: the words under them, without names.

    ``at``, ``word``: places and names of the words under windows. Symbols: ``name`` (0: none yet), ``wants`` (the number of
    the content that it wants a name for, or -1), ``rare`` (2 to this power is about how often it occurs), ``first`` (place
    of its first word), ``new`` (nothing stands before it). Windows: ``start`` (place), their zone of symbols [``left``,
    ``right``). Windows that have got their anchor: ``s_start``, ``s_place`` (of the anchor), ``s_name``.
    """
    begins = np.cumsum([0, *map(len, docs)])
    at = np.flatnonzero(cover(start, n, int(begins[-1])))
    words = [w for own in docs for w in own]
    numbers: dict[bytes, int] = {}
    wants = np.array([numbers.setdefault(words[i], len(numbers)) for i in at.tolist()], np.int32)
    codes = np.frombuffer(b"".join(map(code_of, numbers)), U).reshape(-1, 2)
    contents = np.concatenate([codes, np.zeros((len(codes), 1), U)], axis=1)
    new = np.concatenate([[True], np.diff(at) > 1])[: len(at)] | np.isin(at, begins)
    left = np.searchsorted(at, start)
    none = np.zeros(0, np.int64)
    s = {"at": at, "word": np.zeros(len(at), U), "name": np.zeros(len(at), U), "rare": np.zeros(len(at), np.uint8), "first": at, "new": new, "wants": wants, "start": start, "left": left, "right": left + n}
    return s | {"s_start": none, "s_place": none, "s_name": np.zeros(0, U)}, contents, np.bincount(wants, minlength=len(contents))


def cover(start: np.ndarray, n: int | np.ndarray, size: int) -> np.ndarray:
    """What the ranges of ``n`` from each start cover."""
    edge = np.zeros(size + 1, np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, np.minimum(start + n, size), -1)
    return np.cumsum(edge)[:-1] > 0


def anchors(s: Arrays, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The rarest symbol of each zone, the leftmost of equal ones."""
    if not len(left):
        return np.zeros(0, np.int64)
    bits = max(1, int(len(s["name"])).bit_length())
    h = (s["rare"].astype(U) << U(58)) | (mix(s["name"], 3) >> U(6))
    low = [(h >> U(bits) << U(bits)) | np.arange(len(h), dtype=U)]
    most = int((right - left).max())
    while 1 << len(low) <= most:
        half = 1 << (len(low) - 1)
        low.append(np.minimum(low[-1][:-half], low[-1][half:]))
    level = np.frexp((right - left).astype(float))[1] - 1
    out = np.zeros(len(left), U)
    for k, own in enumerate(low):
        i = np.flatnonzero(level == k)
        out[i] = np.minimum(own[left[i]], own[right[i] - (1 << k)])
    return (out & U((1 << bits) - 1)).astype(np.int64)


def settle(s: Arrays, done: np.ndarray) -> Arrays:
    """Gives windows their anchors in the zones as they are, and takes them out of the rounds."""
    a = anchors(s, s["left"][done], s["right"][done])
    out = dict(s)
    for k, v in (("s_start", s["start"][done]), ("s_place", s["first"][a]), ("s_name", s["name"][a])):
        out[k] = np.concatenate([s[k], v])
    for k in ("start", "left", "right"):
        out[k] = s[k][~done]
    return out


def advance(s: Arrays, r: int) -> tuple[Arrays, np.ndarray, np.ndarray]:
    """One round: the state with new symbols, those without a name yet as ``wants`` (else -1); their distinct contents and how often each occurs.

    A content is two names and, in one number, two lengths: a pair of blocks, or one block.
    """
    name, rare, first, new = (s[k] for k in ("name", "rare", "first", "new"))
    if not len(name):
        return s | {"wants": np.zeros(0, np.int32)}, np.zeros((0, 3), U), np.zeros(0, np.int64)
    # blocks; the first and the last block of a window may go on outside
    head = new | np.concatenate([[True], name[1:] != name[:-1]])
    block = np.cumsum(head) - 1
    b = np.flatnonzero(head)
    length = np.diff(np.append(b, len(name)))
    left, right = block[s["left"]] + 1, block[s["right"] - 1]
    # pairs; a right-class block at the beginning may belong to what stands before, a left-class one at the end to what comes after
    b_name, b_new = name[b], new[b]
    is_right = (mix(b_name + length.astype(U) * U(0xD6E8FEB86659FD93), 100 + r) & U(1)).astype(bool)
    joins = np.concatenate([~is_right[:-1] & is_right[1:] & ~b_new[1:], [False]])  # with the next
    joined = np.concatenate([[False], joins[:-1]])
    last = len(b) - 1
    left = left + ((left < right) & is_right[np.minimum(left, last)])
    right = right - ((left < right) & ~is_right[np.maximum(right - 1, 0)])
    index = np.cumsum(~joined) - 1
    open_ = left < right
    s = settle(s, ~open_)
    left, right = index[left[open_]], index[right[open_] - 1] + 1
    p = np.flatnonzero(~joined)
    q = np.minimum(p + 1, last)
    pair = joins[p]
    content = np.stack([b_name[p], np.where(pair, b_name[q], U(0)), (length[p] << 32 | np.where(pair, length[q], 0)).astype(U)], 1)
    wants = pair | (length[p] > 1)
    rows = content[wants]
    number, which, times = distinct_rows(rows)
    out = s | {"name": np.where(wants, U(0), b_name[p]), "rare": rare[b[p]], "first": first[b[p]], "new": b_new[p], "left": left, "right": right}
    out["wants"] = np.full(len(p), -1, np.int32)
    out["wants"][wants] = number
    return out, rows[which], times


def distinct_rows(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The number of each row among the distinct ones, where each of those stands, and how often it occurs."""
    if not len(rows):
        return np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = np.zeros(len(rows), U)
    for c in rows.T:
        h = mix(h * U(0x9E3779B97F4A7C15) + c)
    order = np.argsort(h, kind="stable")
    same = (rows[order][1:] == rows[order][:-1]).all(axis=1)
    if ((h[order][1:] == h[order][:-1]) & ~same).any():  # a collision: sort by the contents themselves
        order = np.lexsort(rows.T)
        same = (rows[order][1:] == rows[order][:-1]).all(axis=1)
    head = np.concatenate([[True], ~same])
    number = np.empty(len(rows), np.int32)
    number[order] = np.cumsum(head) - 1
    at = np.flatnonzero(head)
    return number, order[at], np.diff(np.append(at, len(rows)))


def take_names(s: Arrays, name: np.ndarray, rare: np.ndarray, n: int) -> Arrays:
    """The state with the names that came back (0: the content occurs once), without windows that hold a symbol without a name."""
    s = dict(s)
    wants = s.pop("wants")
    asked = wants >= 0
    s["name"], s["rare"] = s["name"].copy(), s["rare"].copy()
    s["name"][asked], s["rare"][asked] = name[wants[asked]], rare[wants[asked]]
    if len(s["word"]) == len(s["name"]) and not s["word"].any():  # the first round names words
        s["word"] = s["name"].copy()
    missing = np.concatenate([[0], np.cumsum(s["name"] == 0)])
    live = missing[s["right"]] == missing[s["left"]]
    for k in ("start", "left", "right"):
        s[k] = s[k][live]
    # symbols in zones, words under windows
    used = cover(s["left"], s["right"] - s["left"], len(s["name"]))
    index = np.cumsum(used) - 1
    gap = np.concatenate([[True], np.diff(np.flatnonzero(used)) > 1])[: int(used.sum())]
    for k in ("name", "rare", "first", "new"):
        s[k] = s[k][used]
    s["new"] = s["new"] | gap
    s["left"], s["right"] = index[s["left"]], index[s["right"] - 1] + 1
    start = np.concatenate([s["start"], s["s_start"]])
    size = int(s["at"][-1]) + 1 if len(s["at"]) else 0
    held = cover(start, n, size)[s["at"]]
    s["at"], s["word"] = s["at"][held], s["word"][held]
    return s


def entries(s: Arrays, n: int) -> tuple[Arrays, list[tuple[int, int, int, bytes]], np.ndarray]:
    """Distinct entries (anchor, windows' words before it, windows, word names), how often each occurs, and where (``low``, ``entry``, ``count``)."""
    s = settle(s, np.ones(len(s["start"]), bool))
    order = np.argsort(s["s_start"], kind="stable")
    start, place, name = (s[k][order] for k in ("s_start", "s_place", "s_name"))
    head = np.concatenate([[True], (np.diff(start) != 1) | (np.diff(place) != 0) | (name[1:] != name[:-1])])[: len(start)]
    f = np.flatnonzero(head)
    count = np.diff(np.append(f, len(start)))
    low = start[f]
    row = np.searchsorted(s["at"], low)
    found: dict[tuple[int, int, int, bytes], int] = {}
    own = [
        found.setdefault((a, p - x, c, s["word"][i : i + c + n - 1].tobytes()), len(found))
        for a, p, x, c, i in zip(name[f].view(np.int64).tolist(), place[f].tolist(), low.tolist(), count.tolist(), row.tolist())
    ]
    entry = np.array(own, np.int32)
    return {"start": low, "entry": entry, "count": count.astype(np.int32)}, list(found), np.bincount(entry, minlength=len(found))


def repeated(anchor: np.ndarray, before: np.ndarray, count: np.ndarray, words: list[bytes], times: np.ndarray, n: int) -> list[list[int]]:
    """Of different entries: the numbers of the windows that occur in several or in one that occurs several times."""
    m = len(words)
    size = count + n - 1
    flat = np.unique(np.frombuffer(b"".join(words), np.int64), return_inverse=True)[1].astype(np.int32) + 1
    begin_ = np.cumsum(size) - size
    place = begin_ + before
    step = np.arange(n)
    ahead = np.where(step < (size - before)[:, None], flat[np.minimum(place[:, None] + step, len(flat) - 1)], 0)
    back = np.where(step < before[:, None], flat[np.maximum(place[:, None] - 1 - step, 0)], 0)
    classes = []
    for strings in (ahead, back):
        order = np.lexsort((*strings.T[::-1], anchor))
        same = (strings[order][1:] == strings[order][:-1]) & (strings[order][1:] > 0)
        shared = np.concatenate([[-1], np.where(anchor[order][1:] == anchor[order][:-1], np.cumprod(same, axis=1).sum(axis=1), -1)])
        classes.append((order, shared))
    out: list[list[int]] = [[] for _ in range(m)]
    for a in range(int(before.max(initial=-1)) + 1):
        window = before - a
        has = np.flatnonzero((window >= 0) & (window < count))
        key = np.zeros(m, np.int64)
        for (order, shared), length in zip(classes, (n - a, a)):
            cls = np.empty(m, np.int64)
            cls[order] = np.cumsum(shared < max(length, 0))
            key = key * (m + 1) + cls
        _, at = np.unique(key[has], return_inverse=True)
        hit = has[np.bincount(at, times[has])[at] > 1]
        for e, w in zip(hit.tolist(), window[hit].tolist()):
            out[e].append(w)
    return out


def words_of(chunk: Chunk) -> list[list[bytes]]:
    """The words of the documents that are compared, in order."""
    return [WORDS.findall(chunk.docs[k][1]) for k in chunk.compared()]


def stated(number: int, s: Arrays, contents: np.ndarray, times: np.ndarray, buckets: int) -> pa.Table:
    """Rows of a chunk after a step: its state, and its distinct contents dealt into buckets, with how often each occurs."""
    h = np.zeros(len(contents), U)
    for c in contents.T:
        h = mix(h * U(0x9E3779B97F4A7C15) + c)
    bucket = (h % U(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    place = np.empty(len(order), np.int32)
    place[order] = np.arange(len(order))
    asked = s["wants"] >= 0
    s["wants"][asked] = place[s["wants"][asked]]
    rows: list[list] = [[number], [STATE], [-1], [freeze(s)], [b""], [b""]]
    for part in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if len(order) else ():
        for c, v in zip(rows, (number, SECOND, bucket[part[0]], squeeze(np.ascontiguousarray(contents[part].T)), squeeze(times[part].astype(np.uint32)), b"")):
            c.append(v)
    return rows_table(rows)


def give_names(r: int):
    """Of a bucket's contents, those that occur more than once get names: round, bucket and number. x: names or 0; y: how frequent."""

    def run(table):
        chunk, kind, bucket, x, y = (table.column(c).to_pylist() for c in ("chunk", "kind", "bucket", "x", "y"))
        parts = [expand(v, U).reshape(3, -1) for v in x]
        contents = np.concatenate(parts, axis=1).T
        times = np.concatenate([expand(v, np.uint32) for v in y])
        number, which, _ = distinct_rows(contents)
        total = np.bincount(number, times, len(which))
        several = total > 1
        names = np.where(several, np.cumsum(several).astype(U) | U(bucket[0] << 32) | U((r + 1) << 58), U(0))[number]
        rare = np.log2(np.maximum(total, 1)).astype(np.uint8)[number]
        cuts = np.cumsum([p.shape[1] for p in parts])[:-1]
        return rows_table([chunk, kind, bucket, [squeeze(v) for v in np.split(names, cuts)], [squeeze(v) for v in np.split(rare, cuts)], [b""] * len(chunk)])

    return run


def thawed(table: pa.Table) -> tuple[int, Arrays, np.ndarray, np.ndarray]:
    """A chunk's number and state, and the names and frequencies for what it wants."""
    rows = sorted(table.to_pylist(), key=lambda row: row["bucket"])
    names = [np.zeros(0, U), *(expand(row["x"], U) for row in rows[1:])]
    rare = [np.zeros(0, np.uint8), *(expand(row["y"], np.uint8) for row in rows[1:])]
    return rows[0]["chunk"], thaw(rows[0]["x"]), np.concatenate(names), np.concatenate(rare)


def dedup_substrings(docs: DataFrame, n: int = 35) -> DataFrame:
    """doc_id, n_words, n_removed and the words that are left, joined by spaces, for every row."""
    scratch = Scratch(docs.sparkSession, "recompression")
    plan = Layout(docs, DENSITY)
    chunks, buckets = plan.chunks, plan.buckets
    base = text_rows(docs, chunks).unionByName(scratch.write(copy_rows(docs, chunks, scratch), "copies"))

    def symbols(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
        u, _, times = distinct([s.names for s in slabs(chunk, n)])
        return u, times

    def say_symbols(table):
        chunk = Chunk(table)
        u, times = symbols(chunk)
        return rows_table(state(chunk.number, FIRST, u, u[:0], times > 1, buckets))

    def sieved(table):
        chunk = Chunk(table)
        own = list(slabs(chunk, n))
        u, _, _ = distinct([s.names for s in own])
        shared = answers(chunk, FIRST, u, buckets) > 0
        start, offset = [np.zeros(0, np.int64)], 0
        for s in own:
            start.append(offset + s.candidates(shared[np.searchsorted(u, s.names)]))
            offset += int(s.begin[-1])
        return stated(chunk.number, *begin(words_of(chunk), np.concatenate(start), n), buckets)

    def go_on(r: int):
        def run(table):
            number, s, name, rare = thawed(table)
            return stated(number, *advance(take_names(s, name, rare, n), r), buckets)

        return run

    def last(table):
        number, s, name, rare = thawed(table)
        where, found, times = entries(take_names(s, name, rare, n), n)
        k = len(found)
        anchor, before, count, words = zip(*found) if found else ((),) * 4
        columns = [[number] * (k + 1), [-1, *range(k)], [0, *anchor], [0, *before], [0, *count], [None, *words], [0, *times.tolist()], [freeze(where), *[None] * k]]
        return pa.Table.from_batches([batch_of(ENTRY, *columns)], ENTRY)

    first = scratch.write(answer(base.groupBy("chunk").applyInArrow(say_symbols, ROW_SQL), 5), "sieve")
    step = scratch.write(base.unionByName(first).groupBy("chunk").applyInArrow(sieved, ROW_SQL), "words")
    scratch.drop(first)
    scratch.clear()
    for r in range(ROUNDS + 1):
        names = step.filter(F.col("kind") == SECOND).groupBy("bucket").applyInArrow(give_names(r), ROW_SQL)
        both = names.unionByName(step.filter(F.col("kind") == STATE)).groupBy("chunk")
        if r < ROUNDS:
            new = scratch.write(both.applyInArrow(go_on(r), ROW_SQL), "round")
        else:
            held = scratch.write(both.applyInArrow(last, ENTRY_SQL), "entries")
        scratch.drop(step)
        step = new
        scratch.clear()
    hits = hit_windows(held.filter("no >= 0").drop("state"), n, scratch)

    def remove(left, right):
        chunk = Chunk(left)
        where = thaw(chunk.answers[FIRST][0][0])
        found = right.column("hits").to_pylist() if right.num_rows else []
        own = np.repeat(right.column("no").to_numpy(), [len(x) for x in found]) if found else np.zeros(0, np.int64)
        window = np.array([w for x in found for w in x], np.int64)
        order = np.argsort(own, kind="stable")
        own, window = own[order], window[order]
        a, b = np.searchsorted(own, where["entry"]), np.searchsorted(own, where["entry"], side="right")
        docs_ = words_of(chunk)
        begins = np.cumsum([0, *map(len, docs_)])
        gone = cover(np.repeat(where["start"], b - a) + window[ranges(a, b - a)], n, int(begins[-1]))
        place = {k: i for i, k in enumerate(chunk.compared())}
        out: list[list] = [[] for _ in range(5)]
        for k, (i, text) in enumerate(chunk.docs):
            w = docs_[place[k]] if k in place else WORDS.findall(text)
            if len(w) >= n and chunk.lowest(i, text) is not None:
                removed, kept = len(w), []
            else:
                mask = gone[begins[place[k]] : begins[place[k] + 1]] if k in place else np.zeros(len(w), bool)
                kept = [x for x, g in zip(w, mask.tolist()) if not g] if mask.any() else w
                removed = len(w) - len(kept)
            for c, v in zip(out, (i, len(w), removed, b" ".join(kept), chunk.times[k])):
                c.append(v)
        return pa.Table.from_batches([batch_of(TIMES, *out[:3], pa.array(out[3], pa.binary()).cast(pa.string()), out[4])], TIMES)

    zero = F.lit(None).cast("binary")
    last_state = held.filter("no < 0").select("chunk", F.lit(FIRST).alias("kind"), F.lit(0).alias("bucket"), zero.alias("x"), F.col("state").alias("y"), zero.alias("z"))
    done = base.unionByName(last_state).groupBy("chunk").cogroup(hits.groupBy("chunk")).applyInArrow(remove, OUT_SQL + ", times long")
    return each_row(done).unionByName(whole(docs.filter("doc_id IS NULL")))


def hit_windows(held: DataFrame, n: int, scratch: Scratch) -> DataFrame:
    """chunk, no and hits: of the chunks' entries, the numbers of the windows that occur again."""
    head = F.concat_ws(",", *(F.col(c).cast("string") for c in ("anchor", "before", "count")), F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.encode(head, "UTF-8"), "words"), 256))
    keyed = held.withColumn("digest", digest)
    parts = [F.first(c).alias(c) for c in ("anchor", "before", "count", "words")]
    different = scratch.write(keyed.groupBy("digest").agg(*parts, F.sum("n").alias("n")), "different")
    per = scratch.write(different.groupBy("anchor").agg(F.count("*").alias("entries")), "anchors")
    hot = per.filter(F.col("entries") > LOTS).select("anchor")
    cold = different.join(per.filter((F.col("entries") > 1) & (F.col("entries") <= LOTS)).select("anchor").hint("merge"), "anchor", "left_semi")
    bins = max(1, -(-different.count() // BIN))
    schema = "digest binary, hits array<int>"

    def compare(table):
        get = lambda c: table.column(c).combine_chunks().to_numpy(zero_copy_only=False)
        hits = repeated(get("anchor"), get("before").astype(np.int64), get("count").astype(np.int64), table.column("words").to_pylist(), get("n"), n)
        return pa.table({"digest": table.column("digest").combine_chunks().cast(pa.binary()), "hits": pa.array(hits, pa.list_(pa.int32()))})

    dealt = cold.withColumn("bin", F.pmod(F.xxhash64("anchor"), F.lit(bins)).cast("int"))
    found = dealt.select("bin", "digest", "anchor", "before", "count", "words", "n").groupBy("bin").applyInArrow(compare, schema)
    # an entry alone with its anchor repeats where it occurs again
    alone = different.filter("n > 1").join(per.filter("entries = 1").select("anchor").hint("merge"), "anchor", "left_semi").select("digest", F.sequence(F.lit(0), F.col("count") - 1).alias("hits"))
    windows = different.join(hot.hint("merge"), "anchor", "left_semi").select("digest", "n", "words", F.explode(F.sequence(F.lit(0), F.col("count") - 1)).alias("w"))
    windows = windows.select("digest", "n", "w", F.expr(f"substring(words, 8 * w + 1, {8 * n})").alias("key"))
    again = windows.groupBy("key").agg(F.sum("n").alias("total")).filter("total > 1").select("key")
    split = windows.join(again.hint("merge"), "key", "left_semi").groupBy("digest").agg(F.collect_set("w").alias("hits"))
    hits = scratch.write(found.unionByName(alone).unionByName(split).filter(F.size("hits") > 0), "hits")
    return keyed.select("chunk", "no", "digest").join(hits.hint("merge"), "digest").select("chunk", "no", "hits")


def whole(docs: DataFrame) -> DataFrame:
    """Rows that keep all their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = [WORDS.findall(x) for x in as_bytes(batch.column("text"))]
            yield batch_of(OUT, batch.column("doc_id"), [len(w) for w in found], [0] * len(found), pa.array([b" ".join(w) for w in found], pa.binary()).cast(pa.string()))

    return docs.select("doc_id", "text").mapInArrow(run, OUT_SQL)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_substrings(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP10_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id, text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
),
once AS (SELECT min(rid) AS rid FROM docs GROUP BY doc_id, text),
starts AS (SELECT rid, w, unnest(range(1, len(w) - 33)) AS s FROM docs WHERE doc_id IS NOT NULL AND len(w) >= 35),
windows AS (SELECT rid, s, array_to_string(w[s:s + 34], ' ') AS k FROM starts),
again AS (SELECT k FROM windows SEMI JOIN once USING (rid) GROUP BY k HAVING count(*) > 1),
gone AS (SELECT DISTINCT rid, unnest(range(s, s + 35)) AS p FROM windows JOIN again USING (k)),
kept AS (
  SELECT rid, count(gone.p) AS n_removed, string_agg(word, ' ' ORDER BY p) FILTER (WHERE gone.p IS NULL) AS kept
  FROM (SELECT rid, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM docs) LEFT JOIN gone USING (rid, p) GROUP BY rid
)
SELECT doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (rid)
"""
