"""Encoding and decoding against the tokenizers library."""

import random

import pytest
from hypothesis import given, settings, strategies as st

from footgrid.llm import bpe
from footgrid.llm.queries import vocabulary_path

SOURCE = bpe.read_vocabulary(vocabulary_path())
VOCABULARY = bpe.Vocabulary(SOURCE)


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer
    t = Tokenizer.from_str(SOURCE)
    t.no_truncation()
    t.no_padding()
    return t


def check(reference, texts):
    for text, ids in zip(texts, VOCABULARY.encode(texts)):
        assert ids.tolist() == reference.encode(text, add_special_tokens=False).ids, text
        assert VOCABULARY.decode(ids) == reference.decode(ids.tolist(), skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=5))
def test_any_text(reference, texts):
    check(reference, texts)


def test_all_letters_and_special_strings(reference):
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    check(reference, ["a1 .".join(every[k:k + 500]) for k in range(0, len(every), 5000)])
    rng = random.Random(1)
    parts = ["<|endoftext|>", "<|endof", "text|>", " ", "a", "aaaa", "'s", "\n\n", " ", "12", "é", "ሴ"]
    check(reference, ["".join(rng.choice(parts) for _ in range(30)) for _ in range(300)] + ["x" * 50000, "ab" * 20000, " " * 5000])


def test_cache_is_bounded_and_harmless(reference, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 50)
    rng = random.Random(2)
    for _ in range(5):
        check(reference, [" ".join("".join(rng.choice("abcdefg") for _ in range(6)) for _ in range(40))])


def test_decoding_bytes_that_are_no_text(reference):
    ids = [i for t in ("é", "😀") for i in reference.encode(t, add_special_tokens=False).ids]
    for k in range(len(ids)):
        import numpy as np
        assert VOCABULARY.decode(np.array(ids[k:])) == reference.decode(ids[k:], skip_special_tokens=False)


def test_rows(spark, reference):
    rows = [(1, None, "x", 1), (1, None, "x", 1), (None, "Hello there", "y", 2), (2, "", "z", 3), (3, "word " * 30000, "z", 4)]
    got = bpe.encode_decode(spark.createDataFrame(rows, "doc_id long, text string, ids string, decoded int"), SOURCE)
    assert got.columns == ["doc_id", "ids", "decoded"]
    assert sorted(((r.doc_id, r.ids, r.decoded) for r in got.collect()), key=str) == \
        sorted(((i, reference.encode(t or "", add_special_tokens=False).ids, t or "") for i, t, _, _ in rows), key=str)
    assert bpe.encode_decode(spark.createDataFrame([], "doc_id long, text string"), SOURCE).count() == 0


def test_sweeps_are_bounded(reference, monkeypatch):
    monkeypatch.setattr(bpe, "SWEEP_CHARS", 100)
    monkeypatch.setattr(VOCABULARY, "cache", {})
    sizes, merge = [], VOCABULARY.merge
    monkeypatch.setattr(VOCABULARY, "merge", lambda new: sizes.append(sum(map(len, new))) or merge(new), raising=False)
    rng = random.Random(3)
    text = " ".join("".join(rng.choice("abcdefg") for _ in range(6)) for _ in range(400))
    check(reference, [text, "", "x" * 300 + " " + text])
    assert len(sizes) > 20 and sorted(sizes)[-2] <= 100 and max(sizes) == 300
