"""Token counts and packed pieces against the tokenizers themselves."""

import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from tidewater.llm import packing, token_counts, tokens


def strings(n, seed):
    rng = random.Random(seed)
    pool = [chr(c) for c in range(0x20, 0x250)]
    return ["béƐ", "Ɓ Ɔ Ɗ Ə Ɠ Ʋ Ʉ Ʌ", "ƐƐ eƐe"] + ["".join(rng.choice(pool) if rng.random() < 0.6 else rng.choice("aeiounst ") for _ in range(rng.randrange(1, 30))) for _ in range(n)]


def test_latin_strings_count_as_the_library_counts(spark):
    own = strings(6000, 9)
    tok = Tokenizer.from_file(packing.path("word_bpe_49k.json"))
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(spark.createDataFrame(list(enumerate(own)), "doc_id long, text string")).collect()}
    assert [own[i] for i, e in enumerate(tok.encode_batch(own, add_special_tokens=False)) if got[i] != len(e.ids)] == []


def test_latin_strings_encode_as_the_library_encodes():
    own = strings(3000, 10)
    tok = Tokenizer.from_file(packing.path("byte_bpe_50k.json"))
    encoder = packing.Encoder(packing.path("byte_bpe_50k.json").removesuffix(".json"))
    assert encoder.encode(own) == [np.array(e.ids, "<u4").tobytes() for e in tok.encode_batch(own, add_special_tokens=False)]


@pytest.mark.parametrize("remember", [200_000, 3])
def test_long_words_are_not_remembered(monkeypatch, remember):
    monkeypatch.setattr(packing, "REMEMBER", remember)
    encoder = packing.Encoder(packing.path("byte_bpe_50k.json").removesuffix(".json"))
    tok = Tokenizer.from_file(packing.path("byte_bpe_50k.json"))
    for text in ("a short text", "x" * 100_000, "xy" * 40_000 + " end of it", "a short text"):
        assert encoder.encode([text]) == [np.array(tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()]
    assert all(len(w) <= packing.SHORT for w in encoder.known)


def test_every_piece_is_its_part_of_a_document(spark):
    rng = random.Random(7)
    docs = [(i, " ".join(rng.choice(tokens_) for _ in range(rng.choice([1, 3, 40, 900, 2600])))) for i in range(220)] + [(500, None), (501, "")]
    rows = packing.pack_documents(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()
    tok = Tokenizer.from_file(packing.path("byte_bpe_50k.json"))
    ids = {i: np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for i, t in docs}
    at = {i: 0 for i in ids}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        assert r.start == at[r.doc_id] and r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
        at[r.doc_id] += r.length
    assert at == {i: len(x) for i, x in ids.items()}
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append(r.length)
    assert max(map(len, sequences.values())) <= packing.SEGMENTS and max(map(sum, sequences.values())) <= 1024
    assert sum(map(sum, sequences.values())) >= 0.97 * 1024 * (len(sequences) - 3)


tokens_ = ["the", "Word", "naïve", "1234", "end.", "tokenization", "zq" * 9, "\n"]


def test_safe_texts_hold_no_other_letters():
    assert tokens.is_safe("É ß ž") and not tokens.is_safe("Ɛ".lower())
