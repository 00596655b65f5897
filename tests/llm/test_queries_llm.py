"""Registered queries whose results SQL can't give, against plain Python over the given tables: columns, rows and digests."""

import hashlib
import re
from zlib import crc32

import pytest

from footgrid.llm import pii, queries
from test_decontaminate import brute as leaked
from test_licenses import brute as licensed
from test_near import brute as near_groups
from test_pii import brute as private


@pytest.fixture(scope="module")
def texts(spark, sf):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def run(spark, sf, name):
    frame = queries.QUERIES[name](spark, sf)
    return frame.columns, {r[0]: r for r in frame.collect()}


def test_op1(spark, sf, texts):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(queries.vocabulary_path())
    columns, got = run(spark, sf, "op1_bpe")
    assert columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and set(got) == set(texts)
    for i, text in texts.items():
        ids = t.encode(text, add_special_tokens=False).ids
        assert tuple(got[i]) == (i, len(ids), sha(",".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False)))


def test_op2(spark, sf, texts):
    columns, got = run(spark, sf, "op2_pii")
    assert columns == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"] and set(got) == set(texts)
    for i, text in texts.items():
        base = private(text)
        listed = [f"{k}:{a}:{b}" for k, found in zip(pii.KINDS, base) for a, b in found]
        assert tuple(got[i])[:6] == (i, *map(len, base), sha(",".join(listed))) and got[i].spans.startswith(",".join(listed))


def test_op3(spark, sf, texts):
    columns, got = run(spark, sf, "op3_ngram_join")
    assert columns == ["doc_id", "class_id", "n_links", "copies"]
    assert sorted((tuple(r) for r in got.values()), key=str) == near_groups(list(texts.items()))


def test_op4(spark, sf, texts):
    columns, got = run(spark, sf, "op4_licenses")
    assert columns == ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"] and set(got) == set(texts)
    for i, text in texts.items():
        *rest, base, labels, score = licensed(text)
        assert tuple(got[i]) == (i, *rest, ",".join(base), ",".join(labels), score)


def test_op6(spark, sf, texts):
    columns, got = run(spark, sf, "op6_toxicity")
    assert columns == ["doc_id", "held_out", "score", "predicted"] and set(got) == set(texts)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and r.held_out == (crc32(str(i).encode()) % 5 == 0) for i, r in got.items())


def test_op8(spark, sf, texts):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    frame = queries.op8_decontaminate(spark, sf)
    assert frame.columns == ["doc_id", "item_id", "containment"]
    rows = frame.collect()
    assert len(rows) == len({(r.doc_id, r.item_id) for r in rows}) and {(r.doc_id, r.item_id) for r in rows} == leaked(list(texts.items()), items)


def test_op9(spark, sf):
    columns, got = run(spark, sf, "op9_html")
    assert columns == ["page_id", "url", "text", "n_chars"] and all(len(r.text) == r.n_chars for r in got.values())


def test_op10(spark, sf, texts):
    columns, got = run(spark, sf, "op10_hmm")
    assert columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"] and set(got) == set(texts)
    for i, r in got.items():
        assert r.n_tokens == len(re.findall(r"[^\x20\x09-\x0D]+", texts[i])) + 1 and r.held_out == (crc32(str(i).encode()) % 5 == 1)
    unseen = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in unseen) > sum(r.base_score for r in unseen)
