import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from marginalia.llm.bpe import VOCABULARY, encode, encode_texts, merge_long, merge_short, read_ranks


@pytest.fixture(scope="module")
def raw():
    with open(VOCABULARY, "rb") as f:
        return f.read()


@pytest.fixture(scope="module")
def public():
    import public_tokenizers as p
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(p.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


CASES = ["", " ", "Hello, world! it's 42", "<|endoftext|>", "a" * 5000, "語" * 3000, "\n\n  \t x", "é ﻿ 🎉👩‍💻", "\x00\x07", "don't  WE'LL", "x" * 191, "x" * 193]


def test_same_as_the_public_library(raw, public):
    for text in CASES:
        assert encode(text, raw) == public(text)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=200))
def test_any_text(raw, public, text):
    assert encode(text, raw) == public(text)


def test_both_merges_agree(raw):
    ranks, rng = read_ranks(raw), random.Random(2)
    for _ in range(300):
        word = bytes(rng.choice(b" thequickab\xe8\xaa\x9e") for _ in range(rng.randrange(1, 90)))
        assert merge_short(word, ranks) == merge_long(word, ranks)


def test_table(spark, raw):
    rows = [(1, None, "x"), (2, "", "x"), (3, "Hello world", "x"), (3, "Hello world", "y"), (4, "long " * 40_000, "z")]
    got = encode_texts(spark.createDataFrame(rows, "doc_id long, text string, ids string")).collect()
    assert sorted((r.doc_id, len(r.ids)) for r in got) == sorted((i, len(encode(t or "", raw))) for i, t, _ in rows)
    assert [r.ids for r in got if r.doc_id in (1, 2)] == [[], []]
    assert encode_texts(spark.createDataFrame([], "doc_id long, text string")).count() == 0
