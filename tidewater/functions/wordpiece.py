"""WordPiece: cleaning, punctuation and CJK splits, greedy longest match, padding."""

from __future__ import annotations

import threading
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

CJK = ((0x4E00, 0x9FFF), (0x3400, 0x4DBF), (0x20000, 0x2A6DF), (0x2A700, 0x2B73F), (0x2B740, 0x2B81F), (0x2B820, 0x2CEAF), (0xF900, 0xFAFF), (0x2F800, 0x2FA1F))


def is_punctuation(c: str) -> bool:
    n = ord(c)
    return 33 <= n <= 47 or 58 <= n <= 64 or 91 <= n <= 96 or 123 <= n <= 126 or unicodedata.category(c).startswith("P")


def split_words(text: str) -> list[str]:
    text = unicodedata.normalize("NFD", text.lower())
    out, word = [], ""
    for c in text:
        kind = unicodedata.category(c)
        if c.isspace() or c in "\t\n\r" or kind == "Zs":
            out, word = (out + [word] if word else out), ""
        elif kind == "Mn" or c in "\0�" or kind.startswith("C"):
            continue
        elif is_punctuation(c) or any(a <= ord(c) <= b for a, b in CJK):
            out, word = [*out, *([word] if word else []), c], ""
        else:
            word += c
    return out + [word] if word else out


class WordPiece:
    """Ids by a vocabulary (token to id). ``special`` tokens are found in the text before anything else."""

    def __init__(self, vocabulary: dict[str, int], length: int = 128, special: tuple[str, ...] = ("[CLS]", "[SEP]", "[PAD]", "[UNK]", "[MASK]"), longest: int = 100):
        self.vocabulary, self.length, self.special, self.longest = vocabulary, length, [s for s in special if s in vocabulary], longest

    def pieces(self, word: str) -> list[str]:
        if len(word) > self.longest:
            return ["[UNK]"]
        out, at = [], 0
        while at < len(word):
            for end in range(len(word), at, -1):
                piece = ("##" if at else "") + word[at:end]
                if piece in self.vocabulary:
                    break
            else:
                return ["[UNK]"]
            out.append(piece)
            at = end
        return out

    def tokenize(self, text: str) -> list[str]:
        for s in self.special:
            if s in text:
                before, after = text.split(s, 1)
                return [*self.tokenize(before), s, *self.tokenize(after)]
        return [p for w in split_words(text) for p in self.pieces(w)]

    def encode(self, text: str) -> dict[str, list[int]]:
        """ids, mask and types, cut and padded to the length."""
        body = self.tokenize(text)[: self.length - 2]
        ids = [self.vocabulary[t] for t in ["[CLS]", *body, "[SEP]"]]
        pad = self.length - len(ids)
        return {"ids": ids + [self.vocabulary["[PAD]"]] * pad, "mask": [1] * len(ids) + [0] * pad, "types": [0] * self.length}

    def column(self, text: Column) -> Column:
        @F.pandas_udf("ids array<int>, mask array<int>, types array<int>")
        def run(s: pd.Series) -> pd.DataFrame:
            return pd.DataFrame([self.encode(t or "") for t in s], columns=["ids", "mask", "types"])

        return run(text)


def pool(hidden, mask):
    """Mean of token vectors under a mask, of length one (numpy arrays: batch x tokens x dims, batch x tokens)."""
    import numpy as np

    m = mask[..., None].astype(float)
    mean = (hidden * m).sum(axis=1) / np.maximum(m.sum(axis=1), 1e-9)
    return mean / np.maximum(np.sqrt((mean * mean).sum(axis=1, keepdims=True)), 1e-12)


class QueryEmbedder:
    """From a request to its int8 vector: tokens, model, pooling, length one, quantisation. One request at a time.

    model: from ids, masks and types (lists of one row) to hidden states, a numpy array of batch x tokens x dims.
    """

    def __init__(self, wordpiece: WordPiece, model: Callable, scale: int = 256):
        self.wordpiece, self.model, self.scale, self._lock = wordpiece, model, scale, threading.Lock()

    def __call__(self, query: str) -> list[int]:
        import numpy as np

        e = self.wordpiece.encode(query)
        with self._lock:
            hidden = np.asarray(self.model([e["ids"]], [e["mask"]], [e["types"]]), float)
        x = pool(hidden, np.array([e["mask"]]))[0] * self.scale
        return np.clip(np.sign(x) * np.floor(np.abs(x) + 0.5), -127, 127).astype(int).tolist()
