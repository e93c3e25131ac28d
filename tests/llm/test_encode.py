"""Exact encodings, however a text is cut."""

from __future__ import annotations

import os
import random

import pytest

from leesmaat.llm import encode

tokenizers = pytest.importorskip("tokenizers")
PATH = os.path.join(encode.TOKENIZER_DIR, "byte_bpe_50k.json")
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no tokenizer files here")


@pytest.fixture(scope="module")
def reference():
    t = tokenizers.Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return lambda s: t.encode(s, add_special_tokens=False).ids


def sample(rng):
    alphabet = rng.choice(["ab", "abc é", "ab  \n\t", "नमस्ते ", "。、漢字ab", "😀a b", "0123 .,!?'s 't", "aaaaaaaab"])
    return "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 300)))


def test_any_cut_gives_the_encoding_of_the_whole(reference):
    enc = encode.encoder(os.path.join(encode.TOKENIZER_DIR, encode.VOCABULARY))
    rng = random.Random(2)
    for _ in range(400):
        text = sample(rng)
        parts = [(safe, enc.encode_ordinary(text[a:b])) for a, b, safe in encode.cuts(text, rng.choice([7, 20, 64]))]
        assert encode.tree(parts, enc) == reference(text)


def test_halves_of_unsplit_text(reference):
    enc = encode.encoder(os.path.join(encode.TOKENIZER_DIR, encode.VOCABULARY))
    rng = random.Random(3)
    for _ in range(100):
        text = "".join(rng.choice("thequickbrownfx") for _ in range(rng.randint(2, 400)))
        k = rng.randrange(len(text) + 1)
        assert encode.join(enc.encode_ordinary(text[:k]), enc.encode_ordinary(text[k:]), enc) == reference(text)


def test_rows(spark, reference):
    long = "woord " * 900 + "x" * 4000
    rows = [(1, None, "a"), (2, "", "b"), (3, "  \n", "c"), (4, "Hallo wereld <|endoftext|>", "d"), (5, long, "e"), (6, long, "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = {r["key"]: r["ids"] for r in encode.encode(df, "doc_id", "text", long=500).collect()}
    assert got == {i: (reference(t) if t else []) for i, t, _ in rows}
    assert encode.encode(df.filter("false"), "doc_id", "text").count() == 0
