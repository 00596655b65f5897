"""The additive model: exact features, tables, learning with and without interactions, held-out accuracy, odd tables."""

import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest

from footgrid.llm import quality, queries

KINDS = "doc_id long, text string"


def brute(text):
    """Some of the features, from plain strings."""
    words = re.findall(r"[^ \t-\r]+", text)
    low = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in words]
    pairs, fives = ([tuple(low[i: i + n]) for i in range(len(low) - n + 1)] for n in (2, 5))
    lines = [x for x in text.split("\n") if x]
    size = len(text.encode())
    share = lambda many: 1 - len(set(many)) / len(many) if many else 0
    return {"words": np.log1p(len(words)), "word_length": sum(len(w.encode()) for w in words) / max(len(words), 1), "bars": text.count("|") / max(len(words), 1),
            "digits": sum(c in "0123456789" for c in text) / max(size, 1), "top_word": max(Counter(low).values(), default=0) / max(len(words), 1),
            "repeated_pairs": share(pairs), "repeated_fives": share(fives), "repeated_lines": share([re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in lines]),
            "line_length": np.log1p(size / max(len(lines), 1)), "longest_word": np.log1p(max((len(w.encode()) for w in words), default=0)),
            "commas": text.count(",") / max(len(words), 1), "distinct_words": len(set(low)) / max(len(words), 1) ** 0.9}


def test_features_like_plain_python():
    texts = ["One two, three three 4", "", None, "a a a a a a a b b", "LINE one\nline One\n\nother | x |", "wörter ähnlich\t\tzu", "$$$ %%% x$ y|z", " "]
    got = quality.features(pa.array(texts, pa.string()))
    assert np.isfinite(got).all() and got.shape == (len(texts), len(quality.FEATURES))
    for row, text in zip(got, texts):
        for name, value in brute(text or "").items():
            assert row[quality.FEATURES.index(name)] == pytest.approx(value), (text, name)
    alone = np.concatenate([quality.features(pa.array([t], pa.string())) for t in texts])
    assert np.allclose(alone, got)                      # a text's features don't depend on its neighbours


def test_tables_add_up_and_pairs_catch_what_single_features_miss():
    rng = np.random.default_rng(3)
    x = rng.uniform(-1, 1, (3000, len(quality.FEATURES)))
    y = ((x[:, 2] > 0) ^ (x[:, 5] > 0)).astype(float)             # neither feature tells anything alone
    model = quality.boost(x[:2000], y[:2000])
    assert {2, 5} in [{i, j} for i, j, _ in model.pairs]
    assert ((model.score(x[2000:]) >= 0.5) == y[2000:]).mean() > 0.95
    bins = model.bins(x[:50])
    for row, whole in zip(bins, model.margin(bins)):
        parts = sum(t[b] for t, b in zip(model.tables, row)) + sum(t[model.coarse[i][row[i]], model.coarse[j][row[j]]] for i, j, t in model.pairs)
        assert whole == pytest.approx(model.intercept + parts)


def test_tree_is_the_best_single_cut_first():
    g, h = np.array([1.0, 1, 1, -1, -1, -1]), np.ones(6)
    values = quality.tree(g, h)
    assert (values[:3] > 0).all() and (values[3:] < 0).all()


def made(n, seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8)))
    rows = []
    for k in range(n):
        words = [word() for _ in range(rng.randint(20, 80))]
        bad = k % 3 == 0
        text = " | ".join(words) if bad and k % 2 else " ".join(words[:4] * 12) if bad else " ".join(words) + "."
        rows.append((k, text, 0 if bad else 1))
    return rows


def test_learns_and_leaves_out_held_labels(spark):
    rows = made(300)
    docs = spark.createDataFrame([r[:2] for r in rows], KINDS)
    # labels that must not be used are all wrong
    labels = spark.createDataFrame([(k, (1 - q if crc32(str(k).encode()) % 3 == 1 else q), 0) for k, _, q in rows], "doc_id long, quality int, toxic int")
    from pyspark.sql import functions as F
    model = quality.fit(docs, labels, use=F.crc32(F.col("id").cast("string").cast("binary")) % 3 != 1)
    got = {r.id: r.score for r in quality.scores(docs, model).collect()}
    assert all((got[k] >= 0.5) == bool(q) for k, _, q in rows)


def test_odd_tables(spark):
    docs = spark.createDataFrame([(1, "some text"), (2, None), (2, ""), (None, "no id"), (3, "long " * 300_000)], KINDS)
    kinds = "doc_id long, quality int, toxic int, text string, score double"
    none = quality.fit(docs, spark.createDataFrame([], kinds))
    assert {r.score for r in quality.scores(docs, none).collect()} == {0.5}
    clash = spark.createDataFrame([(1, 1, 0, "x", 0.0), (1, 0, 0, "x", 0.0), (2, None, 0, "x", 0.0), (None, 0, 0, "x", 0.0), (3, 7, 0, "x", 0.0)], kinds)
    one = quality.fit(docs, clash)
    assert {round(r.score, 6) for r in quality.scores(docs, one).collect()} == {0.75}       # (1 + 0.5) / (1 + 1)
    assert quality.scores(spark.createDataFrame([], KINDS), one).count() == 0
    two = quality.fit(docs, spark.createDataFrame([(1, 1, 0, "x", 0.0), (2, 0, 0, "x", 0.0)], kinds))
    assert quality.scores(docs, two).count() == 5


def test_no_more_than_the_sample_comes_to_the_driver(spark):
    docs = spark.createDataFrame([(1, f"text {k}") for k in range(500)] + [(2, "a | b | c")], KINDS)
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    seen = []
    real = quality.boost
    quality.boost = lambda x, y: seen.append(len(x)) or real(x, y)
    try:
        quality.fit(docs, labels, sample=100)
    finally:
        quality.boost = real
    assert seen == [100]


def test_query_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    frame = queries.QUERIES["op11_quality"](spark, sf)
    assert frame.columns == ["doc_id", "held_out", "score", "predicted"]
    got = {r.doc_id: r for r in frame.collect()}
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    labels = [(r.doc_id, r.quality) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()]
    held = [(got[i].predicted, q) for i, q in labels if got[i].held_out]
    assert all(got[i].held_out == (crc32(str(i).encode()) % 3 == 1) for i, _ in labels)
    assert sum(p == q for p, q in held) / len(held) > 0.97
