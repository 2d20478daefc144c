"""Packing: vector bin packing of documents into training sequences.

A document is its token ids and an end id. Pieces of a whole sequence's length stand alone; what is left of each document
is an example with a demand of tokens, segments (one) and loss-bearing tokens. Bins are filled one after the other: of
the examples that fit all three remaining capacities, the one with the largest dot product of demand and remaining
capacity goes in. Last, the emptiest bins are cut up to fill the gaps of the others, as far as the limits allow.

Each task packs its own rows, a bounded number of examples at a time, and carries unfinished bins on; nothing is
shuffled. sequence_id is unique: the partition in the high bits, a counter in the low ones.

A null or empty text is the end id alone. Rows with a null or repeated doc_id are packed like any other.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .common import as_bytes, batch_of, read, slices
from .tokens import BYTE_BPE, is_safe, merger, path, tokenizer

MODEL = "byte_bpe_50k"
END_ID = b"\0\0\0\0"
#: Pre-tokens whose ids a worker remembers, twice at most; characters of one that is remembered; examples packed at a time.
REMEMBER, SHORT, EXAMPLES = 150_000, 64, 4096
#: Pieces of a sequence at most: so many documents an attention mask is built for.
SEGMENTS = 8
OUT = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss_tokens")])
OUT_SQL = ", ".join(f"`{n}` long" for n in OUT.names)


class Known(dict):
    """From a pre-token to its ids, merged when it is met first; ``old`` holds those of before, longer ones are not remembered."""

    def __init__(self, merge, old: dict[str, bytes]):
        self.merge, self.old = merge, old

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            ids = array("I", self.merge(word.encode())).tobytes()
        if len(word) <= SHORT:
            self[word] = ids
        return ids


class Encoder:
    """Token ids as little-endian unsigned 32-bit bytes.

    Pre-tokens are merged over the vocabulary's ranks, which is the same merging several times faster; whole texts that
    can't be cut here go to the tokenizer.
    """

    def __init__(self, where: str):
        self.tok, self.merge = tokenizer(f"{where}.json"), merger(f"{where}.tiktoken")
        self.known = Known(self.merge, {})

    def encode(self, texts: list[str]) -> list[bytes]:
        out = []
        for x in texts:
            if is_safe(x) and "<|" not in x:
                if len(self.known) > REMEMBER:  # what is met again is taken over
                    self.known.old = {}
                    self.known = Known(self.merge, self.known)
                out.append(b"".join(map(self.known.__getitem__, BYTE_BPE.findall(x))))
            else:
                out.append(np.array(self.tok.encode(x, add_special_tokens=False).ids, "<u4").tobytes())
        return out


class Piece:
    """A run of a document's ids; ``ids`` are its bytes."""

    __slots__ = ("doc_id", "ids", "loss", "start", "total")

    def __init__(self, doc_id: int | None, start: int, ids: bytes, total: int, loss: bool):
        self.doc_id, self.start, self.ids, self.total, self.loss = doc_id, start, ids, total, loss

    def __len__(self) -> int:
        return len(self.ids) // 4

    def cut(self, n: int) -> tuple[Piece, Piece]:
        return Piece(self.doc_id, self.start, self.ids[: 4 * n], self.total, self.loss), Piece(self.doc_id, self.start + n, self.ids[4 * n :], self.total, self.loss)


def parts(piece: Piece, most: int) -> list[Piece]:
    out = []
    while len(piece) > most:
        head, piece = piece.cut(most)
        out.append(head)
    return [*out, piece]


def pack(pieces: list[Piece], tokens: int, segments: int, loss_tokens: int) -> list[list[Piece]]:
    """Bins of pieces that keep to all three limits; a piece too large for any bin is cut first."""
    if min(tokens, segments, loss_tokens) < 1:
        raise ValueError("limits must be positive")
    pieces = [q for p in pieces for q in parts(p, min(tokens, loss_tokens) if p.loss else tokens)]
    if not pieces:
        return []
    size = np.array([len(p) for p in pieces], float)
    order = np.argsort(-size, kind="stable")
    loss = (size * [p.loss for p in pieces])[order]
    size = size[order]
    alive = np.ones(len(pieces), bool)
    bins: list[list[Piece]] = []
    left = len(pieces)
    while left:
        if 4 * left < 3 * len(alive):  # those that are packed need no more looks
            order, size, loss = order[alive], size[alive], loss[alive]
            alive = np.ones(left, bool)
        room, seats, bearing, own = float(tokens), segments, float(loss_tokens), []
        while True:
            fits = np.flatnonzero(alive & (size <= room) & (loss <= bearing)) if seats else ()
            if not len(fits):
                break
            # the dot product of demands and what is left, as shares of the limits; the segments' share is the same for all
            j = fits[np.argmax(size[fits] * (room / tokens**2) + loss[fits] * (bearing / loss_tokens**2))]
            alive[j] = False
            left -= 1
            room, seats, bearing = room - size[j], seats - 1, bearing - loss[j]
            own.append(pieces[order[j]])
            if room < 1 or not left:
                break
        bins.append(own)
    return fill_gaps(bins, tokens, segments, loss_tokens)


def fill_gaps(bins: list[list[Piece]], tokens: int, segments: int, loss_tokens: int) -> list[list[Piece]]:
    """Cuts up the emptiest bins to fill the gaps of the fullest."""
    bins = sorted(bins, key=lambda b: -sum(map(len, b)))
    i, stock = 0, []
    while i < len(bins):
        room, seats = tokens - sum(map(len, bins[i])), segments - len(bins[i])
        loss = loss_tokens - sum(len(p) for p in bins[i] if p.loss)
        while room and seats:
            if not stock:
                if i + 1 >= len(bins):
                    break
                stock = bins.pop()
            p = stock.pop()
            n = min(len(p), room, loss if p.loss else room)
            if not n:
                stock.append(p)
                break
            if n < len(p):
                p, rest = p.cut(n)
                stock.append(rest)
            bins[i].append(p)
            room, seats, loss = room - n, seats - 1, loss - n * p.loss
        i += 1
        if stock and i >= len(bins):
            bins.append(stock)
            stock = []
    return bins


def pack_documents(docs: DataFrame, tokens: int = 1024, segments: int = SEGMENTS, loss_tokens: int | None = None, loss_column: str | None = None, folder: str | None = None) -> DataFrame:
    """One row per piece. ``loss_column``: a boolean column, whether the ids of a row bear loss; else all do."""
    where = path(f"{MODEL}.json", folder).removesuffix(".json")
    most = loss_tokens or tokens

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = Encoder(where), TaskContext.get().partitionId()
        waiting: list[Piece] = []
        number = 0

        def rows(bins: list[list[Piece]]) -> pa.RecordBatch:
            nonlocal number
            out: list[tuple] = []
            for own in bins:
                at = 0
                for p in own:
                    out.append((p.doc_id, p.start, len(p), zlib.crc32(p.ids), p.total, part << 40 | number, at, len(p) * p.loss))
                    at += len(p)
                number += 1
            return batch_of(OUT, *(list(zip(*out)) or [[]] * len(OUT)))

        for batch in slices(batches, "text", 1 << 20):
            ids = batch.column("doc_id").to_pylist()
            bears = [x is not False for x in batch.column("loss").to_pylist()] if loss_column else [True] * len(ids)
            whole = []
            for i, b, loss in zip(ids, encoder.encode([x.decode("utf-8", "replace") for x in as_bytes(batch.column("text"))]), bears):
                b += END_ID
                n = len(b) // 4
                step = min(tokens, most) if loss else tokens
                for s in range(0, n, step):
                    p = Piece(i, s, b[4 * s : 4 * (s + step)], n, loss)
                    (whole if len(p) == tokens else waiting).append(p)
            if whole:
                yield rows([[p] for p in whole])
            while len(waiting) >= EXAMPLES:
                bins = pack(waiting[:EXAMPLES], tokens, segments, most)
                open_ = [b for b in bins if sum(map(len, b)) < tokens]
                waiting = waiting[EXAMPLES:]
                if len(open_) < len(bins) // 2:  # unfinished bins get another chance
                    waiting += [p for b in open_ for p in b]
                    bins = [b for b in bins if sum(map(len, b)) == tokens]
                yield rows(bins)
        if waiting:
            yield rows(pack(waiting, tokens, segments, most))

    cols = [docs["doc_id"], docs["text"]] + ([docs[loss_column].alias("loss")] if loss_column else [])
    return docs.select(*cols).mapInArrow(run, OUT_SQL)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read(spark, sf_dir, "documents"))
