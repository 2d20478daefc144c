"""Token counts by the whole-token shortcut.

Offline, every string of the vocabulary that stands for a whole word is encoded alone; those that give one token are
proven, and a pre-token that is one of them counts 1 without any merging. The other pre-tokens of a batch are merged by
the library, each distinct one once, with a bounded table of those met before: at most twice REMEMBER pre-tokens of at
most SHORT characters. Longer ones are merged for their batch and forgotten.

Texts with characters outside ``tokens.SAFE``, before or after lower-casing, or with the start of a special token in them
are counted by the library as a whole. A null or empty text has no tokens.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import as_bytes, batch_of, read, slices
from .tokens import WORD_BPE, is_safe, path, tokenizer

MODEL = "word_bpe_49k.json"
#: Pre-tokens whose counts a worker remembers, twice at most, and characters of one that is remembered.
REMEMBER, SHORT = 150_000, 64
#: Marks the end of a word in the vocabulary.
END = "</w>"


def proven(where: str) -> list[str]:
    """Pre-tokens, as they stand after normalisation, that encode alone as one token."""
    tok = tokenizer(where)
    words = sorted(v[: -len(END)] for v in tok.get_vocab() if v.endswith(END) and v[: -len(END)].isascii() and v != END)
    words = [w for w in words if WORD_BPE.fullmatch(w) and w == w.lower()]
    return [w for w, e in zip(words, tok.encode_batch(words, add_special_tokens=False)) if len(e.ids) == 1]


def count_tokens(docs: DataFrame, limit: int = 2048, folder: str | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row."""
    where = path(MODEL, folder)
    whole = docs.sparkSession.sparkContext.broadcast(proven(where))  # at most the vocabulary
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, one = tokenizer(where), dict.fromkeys(whole.value, 1)
        known: dict[str, int] = dict(one)
        old: dict[str, int] = {}
        for batch in slices(batches, "text"):
            texts = [x.decode("utf-8", "replace") for x in as_bytes(batch.column("text"))]
            sizes = [len(x.encode()) for x in texts]
            cut, other, missing = [], [], set()
            for i, text in enumerate(texts):
                low = text.lower()
                if is_safe(text) and is_safe(low) and "<|" not in text:
                    words = WORD_BPE.findall(low)
                    cut.append((i, words))
                    missing.update(words)
                else:
                    other.append(i)
            missing.difference_update(known)
            if len(known) + len(missing) > len(one) + REMEMBER:  # what is met again is taken over
                old, known = known, dict(one)
                missing = {w for _, words in cut for w in words}.difference(known)
            again = missing.intersection(old)
            known.update((w, old[w]) for w in again)
            todo = sorted(missing - again)
            for at in range(0, len(todo), 4096):
                part = todo[at : at + 4096]
                known.update(zip(part, (len(e) for e in tok.encode_batch_fast(part, add_special_tokens=False))))
            n = [0] * len(texts)
            for i, words in cut:
                n[i] = sum(map(known.__getitem__, words))
            for w in todo:
                if len(w) > SHORT:
                    del known[w]
            for i in other:
                n[i] = len(tok.encode(texts[i], add_special_tokens=False).ids)
            yield batch_of(schema, batch.column("doc_id"), sizes, n, [x > limit for x in n])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(read(spark, sf_dir, "documents"))
