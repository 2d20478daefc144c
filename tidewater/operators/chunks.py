"""Recursive prose chunks and symbol-wise code chunks, with byte offsets into the source."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TARGET, MOST = 200, 260
SEPARATORS = ("\n\n", "\n", ". ", " ")
POLICY = "recursive_80_200_260_v1"
Counter = Callable[[str], int]


def word_count(text: str) -> int:
    """The default token counter."""
    return len(text.split())


def library_count(path: str) -> Counter:
    """A counter by a tokenizer file, loaded once in each worker."""

    def count(text: str) -> int:
        return len(_library(path).encode(text, add_special_tokens=False).ids)

    return count


@lru_cache(maxsize=2)
def _library(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _split(text: str, at: int, separators: tuple[str, ...], target: int, most: int, count: Counter) -> Iterator[tuple[str, int, int]]:
    """(text, first byte, tokens); ``at`` is the byte where the text begins, so that source[first:first+len] is the text."""
    if not text.strip():
        return
    n = count(text)
    if n <= most:
        yield text, at, n
        return
    if not separators:
        raw = text.encode()
        cut = max(1, len(raw) * target // n)
        while cut < len(raw) and raw[cut] & 0xC0 == 0x80:
            cut += 1
        yield raw[:cut].decode(), at, count(raw[:cut].decode())
        yield from _split(raw[cut:].decode(), at + cut, (), target, most, count)
        return
    sep, rest = separators[0], separators[1:]
    begin = end = None  # of the pieces gathered so far
    pos = 0
    for piece in text.split(sep):
        stop = pos + len(piece)
        if begin is not None and end > begin and count(text[begin:stop]) > target:
            yield from _split(text[begin:end], at + len(text[:begin].encode()), rest, target, most, count)
            begin = pos
        elif begin is None or end == begin:  # empty pieces begin nothing
            begin = pos
        end = stop
        pos = stop + len(sep)
    if begin is not None and end > begin:
        yield from _split(text[begin:end], at + len(text[:begin].encode()), rest, target, most, count)


def chunk_prose(text: str, target: int = TARGET, most: int = MOST, count: Counter = word_count) -> list[dict]:
    return [{"text": t, "byte_start": s, "byte_end": s + len(t.encode()), "token_count": n} for t, s, n in _split(text, 0, SEPARATORS, target, most, count)]


def chunk_code(source: str, symbols: list[dict], most: int = MOST, count: Counter = word_count) -> list[dict]:
    """One chunk for each symbol; an oversize symbol is cut as prose, its chunks are fallbacks. Without symbols: prose fallback."""
    raw = source.encode()
    if not symbols:
        return [c | {"chunk_kind": "code_fallback", "symbol": None} for c in chunk_prose(source, most=most, count=count)]
    out = []
    for i, s in enumerate(symbols):
        body = raw[s["byte_start"] : s["byte_end"]].decode("utf-8", "replace")
        n = count(body)
        if n <= most:
            out.append({"text": body, "byte_start": s["byte_start"], "byte_end": s["byte_end"], "token_count": n, "chunk_kind": "code_ast", "symbol": i})
        else:
            out += [c | {"byte_start": c["byte_start"] + s["byte_start"], "byte_end": c["byte_end"] + s["byte_start"], "chunk_kind": "code_fallback", "symbol": i} for c in chunk_prose(body, most=most, count=count)]
    return out


CHUNK = "array<struct<text string, byte_start long, byte_end long, token_count int>>"


def prose_chunks(docs: DataFrame, key: str = "doc_id", text: str = "text", target: int = TARGET, most: int = MOST, count: Counter = word_count) -> DataFrame:
    """(key, ordinal, text, byte_start, byte_end, token_count)."""

    @F.pandas_udf(CHUNK)
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: chunk_prose(t or "", target, most, count))

    return docs.select(key, F.posexplode(run(text)).alias("ordinal", "c")).select(key, "ordinal", "c.*")
