"""Pre-tokens of the two BPE tokenizers, with tables of pre-tokens whose ids are known.

The libraries encode a pre-token independently of its neighbours, so that a text's ids are those of its pre-tokens in
turn. Texts made of characters in ``SAFE`` are cut here by a regular expression; the classes of those characters are the
same in every Unicode version in use. Any other text goes to the library as a whole.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

#: Characters below U+0250 without the controls that count as white space in some libraries only, and without U+0130,
#: whose lower case is two characters.
SAFE = "\t\n\v\f\r -~\xa0-įı-ɏ"
_UNSAFE = re.compile(f"[^{SAFE}]")


def _ranges(category: str) -> str:
    """The characters of a Unicode category within SAFE, as the inside of a character class."""
    out, run = [], []
    for c in [*range(0x250), 0x10FFFF]:
        if unicodedata.category(chr(c))[0] == category and not _UNSAFE.match(chr(c)):
            run.append(c)
        elif run:
            out.append(f"\\u{run[0]:04x}-\\u{run[-1]:04x}")
            run = []
    return "".join(out)


L, N, S = _ranges("L"), _ranges("N"), r"\t\n\v\f\r \xa0"
#: Both patterns are fixed by the vocabularies.
BYTE_BPE = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{L}]+| ?[{N}]+| ?[^{S}{L}{N}]+|[{S}]+(?![^{S}])|[{S}]+")
WORD_BPE = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{L}]+|[{N}]|[^{S}{L}{N}]+")


#: The byte-level vocabulary's own pattern, for text that is not safe.
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def is_safe(text: str) -> bool:
    return not _UNSAFE.search(text)


@lru_cache(maxsize=4)
def tokenizer(path: str):
    """One for each worker process."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=2)
def merger(path: str):
    """From the bytes of a pre-token to its ids, by a vocabulary given as ranks."""
    import base64

    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=BYTE_PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece


def path(name: str, folder: str | None = None) -> str:
    """Where a vocabulary file lies: in a folder, or in the installed package."""
    if folder:
        return f"{folder}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)
