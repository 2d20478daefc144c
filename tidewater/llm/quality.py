"""Quality classifier: random-indexing word vectors pooled per document, a two-layer network, calibrated probabilities.

Words and runs of other signs are tokens, hashed to WORDS rows. A token has a fixed sparse index vector of +1 and -1; its
word vector is the sum of the index vectors of its neighbours over the whole corpus, brought to length one. The table
has WORDS x DIMS numbers whatever the corpus, so that it can be summed on the executors, one partial table for each
task, and sent to all of them. A document is pooled into the mean and the spread of its word vectors, the share of
its most frequent row and its length.

The network (numpy) is fitted on at most ``sample`` labelled rows, those with the smallest hashes, without the held-out
ones (crc32(doc_id as text) mod 5 = 0). A part of the fitted rows (remainder 1) is set aside to choose the temperature that
calibrates its probabilities.

Null and empty texts are pooled into zeros and get the score of those. A row with null doc_id is scored, and held_out is
null. Labels that are null or neither 0 nor 1 are left out; repeated labels count again. Without labels of both kinds
every score is the smoothed share of label 1.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import as_bytes, batch_of, column_of, read, slices
from .sharing import BYTES, U, mix, prefix, span_hash

WORDS, DIMS, NONZERO, REACH = 1 << 13, 32, 4, 2
HIDDEN, EPOCHS, STEPS, RATE, DECAY, BATCH = 32, 60, 1500, 0.01, 1e-4, 256
SAMPLE, FEATURES = 20_000, 2 * DIMS + 3
#: Class of each byte: white space 0, letters, digits and what lies beyond ASCII 1, other signs 2; A-Z are hashed as a-z.
_code = np.arange(256)
CLASS = np.where(np.isin(_code, [9, 10, 11, 12, 13, 32]), 0, np.where((_code >= 128) | np.isin(_code, list(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")), 1, 2)).astype(np.int8)
NAMES = BYTES[0][np.where((_code >= 65) & (_code <= 90), _code + 32, _code)]


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the nonzero components of each row's index vector."""
    h = mix(np.arange(WORDS * NONZERO, dtype=np.uint64), 77).reshape(WORDS, NONZERO)
    return (h % U(DIMS)).astype(np.int64), np.where(h >> U(40) & U(1), 1, -1).astype(np.int64)


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The row of each token of some texts, and its text."""
    a = np.frombuffer(b"".join(texts), np.uint8)
    at = np.cumsum([0, *map(len, texts)])
    if not len(a):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = CLASS[a]
    new = np.zeros(len(a) + 1, bool)
    new[at] = True
    new[1:-1] |= kind[1:] != kind[:-1]
    cut = np.flatnonzero(new)
    start, end = cut[:-1], cut[1:]
    real = kind[start] > 0
    start, end = start[real], end[real]
    h = mix(span_hash(prefix(NAMES[a]), start, end), 5)
    return (h % U(WORDS)).astype(np.int64), np.searchsorted(at, start, side="right") - 1


def word_table(docs: DataFrame) -> np.ndarray:
    """Word vectors of unit length from the whole corpus; rows that no token has are zero."""
    schema = pa.schema([("word", pa.int32()), *((f"v{d}", pa.int64()) for d in range(DIMS))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, sign = index_vectors()
        total = np.zeros(WORDS * DIMS, np.int64)
        for batch in slices(batches, "text", 1 << 20):
            row, doc = tokens(as_bytes(batch.column("text")))
            if not len(row):
                continue
            sums = np.zeros(WORDS * DIMS)
            for step in range(1, REACH + 1):
                same = np.flatnonzero(doc[step:] == doc[:-step])
                a, b = row[same], row[same + step]
                for x, y in ((a, b), (b, a)):
                    for k in range(NONZERO):
                        sums += np.bincount(x * DIMS + place[y, k], weights=sign[y, k], minlength=WORDS * DIMS)
            total += sums.astype(np.int64)
        table = total.reshape(WORDS, DIMS)
        used = np.flatnonzero(table.any(axis=1))
        yield batch_of(schema, used.astype(np.int32), *(np.ascontiguousarray(table[used, d]) for d in range(DIMS)))

    sums = docs.select("text").mapInArrow(run, "word int, " + ", ".join(f"v{d} long" for d in range(DIMS))).groupBy("word").agg(*(F.sum(f"v{d}").alias(f"v{d}") for d in range(DIMS)))
    out = np.zeros((WORDS, DIMS))
    for r in sums.collect():  # at most WORDS rows
        out[r[0]] = r[1:]
    length = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return (out / np.maximum(length, 1e-12)).astype(np.float32)


def pool(texts: list[bytes], table: np.ndarray) -> np.ndarray:
    """A row of FEATURES numbers for each text."""
    out = np.zeros((len(texts), FEATURES))
    row, doc = tokens(texts)
    if not len(row):
        return out
    first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    own, n = doc[first], np.diff(np.append(first, len(doc)))[:, None]
    v = table[row]
    mean = np.add.reduceat(v, first, axis=0, dtype=np.float64) / n
    square = np.add.reduceat(v * v, first, axis=0, dtype=np.float64) / n
    out[own, :DIMS] = mean
    out[own, DIMS : 2 * DIMS] = np.sqrt(np.maximum(0, square - mean * mean))
    pairs, times = np.unique(doc * WORDS + row, return_counts=True)
    d = pairs // WORDS
    f = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]]))
    out[own, 2 * DIMS] = np.maximum.reduceat(times, f) / n[:, 0]
    out[own, 2 * DIMS + 1] = np.diff(np.append(f, len(d))) / n[:, 0]
    out[own, 2 * DIMS + 2] = np.log1p(n[:, 0]) / 8
    return out


class Network:
    """One hidden layer of tanh units, a logistic unit, and a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, aside: np.ndarray, seed: int = 1):
        self.constant = (y.sum() + 1) / (len(y) + 2) if len(y) else 0.5
        self.fitted = len(np.unique(y[~aside])) == 2
        if not self.fitted:
            return
        rng = np.random.default_rng(seed)
        self.mean, self.scale = x[~aside].mean(axis=0), x[~aside].std(axis=0) + 1e-6
        z, t = self.standard(x[~aside]), y[~aside].astype(float)
        p = [rng.normal(0, 1 / np.sqrt(z.shape[1]), (z.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.array(np.log(t.mean() / (1 - t.mean())))]
        m, s, step = [np.zeros_like(v) for v in p], [np.zeros_like(v) for v in p], 0
        for _ in range(max(EPOCHS, STEPS * BATCH // len(z))):
            for own in np.array_split(rng.permutation(len(z)), max(1, len(z) // BATCH)):
                h = np.tanh(z[own] @ p[0] + p[1])
                e = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -30, 30))) - t[own]) / len(own)
                back = np.outer(e, p[2]) * (1 - h * h)
                grad = [z[own].T @ back + DECAY * p[0], back.sum(axis=0), h.T @ e + DECAY * p[2], e.sum()]
                step += 1
                for k, g in enumerate(grad):
                    m[k] = 0.9 * m[k] + 0.1 * g
                    s[k] = 0.999 * s[k] + 0.001 * g * g
                    p[k] = p[k] - RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)
        self.p, self.temperature = p, 1.0
        if aside.any():
            logit, t = self.logit(x[aside]), y[aside]
            loss = lambda c: np.mean(np.logaddexp(0, np.where(t == 1, -logit, logit) / c))
            self.temperature = float(min(np.exp(np.linspace(-1.5, 1.5, 61)), key=loss))

    def standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(self.standard(x) @ self.p[0] + self.p[1]) @ self.p[2] + self.p[3]

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.fitted:
            return np.full(len(x), float(self.constant))
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -30, 30)))


def remainder(doc_id: str = "doc_id"):
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, Network]:
    """Word vectors of the documents, and the network fitted on labelled ones."""
    table = word_table(docs)
    cast = docs.sparkSession.sparkContext.broadcast(table)
    own = labels.filter("doc_id IS NOT NULL AND quality IN (0, 1)").filter(remainder() != 0).select("doc_id", F.col("quality").cast("int").alias("quality"))
    chosen = F.broadcast(own.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample))  # bounded by ``sample``
    schema = pa.schema([("aside", pa.bool_()), ("quality", pa.int32()), ("order", pa.int64()), ("features", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            x = pool(as_bytes(batch.column("text")), cast.value)
            yield batch_of(schema, batch.column("aside"), batch.column("quality"), batch.column("doc_id"), list(x))

    rows = docs.select("doc_id", "text").join(chosen, "doc_id").select("doc_id", (remainder() == 1).alias("aside"), "quality", "text")
    got = sorted(rows.mapInArrow(run, "aside boolean, quality int, order long, features array<double>").collect(), key=lambda r: (r["order"], r.quality, r.features))
    x = np.array([r.features for r in got]).reshape(-1, FEATURES)
    return table, Network(x, np.array([r.quality for r in got], int), np.array([r.aside for r in got], bool))


def score_documents(docs: DataFrame, model: tuple[np.ndarray, Network]) -> DataFrame:
    """row (a struct of all columns) and score of every row."""
    cast = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, net = cast.value
        for batch in slices(batches, "row.text", 1 << 20):
            score = net.score(pool(as_bytes(column_of(batch, "row.text")), table))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(score, pa.float64())], names=["row", "score"])

    rows = docs.select(F.struct("*").alias("row"))
    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("score", DoubleType())]))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    scored = score_documents(docs.select("doc_id", "text"), fit(docs, labels, sample)).select("row.doc_id", "score")
    return scored.select("doc_id", (remainder() == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
