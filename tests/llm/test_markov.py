"""Counts and base score against brute force, the forward recursion against plain sums over state paths, learning on held-out text."""

import itertools
import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from footgrid.llm import markov
from footgrid.llm.toxicity import held_out


def words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lower) + [None]


def fixture():
    rng = np.random.default_rng(2)
    kinds = [[f"k{k}w{i}" for i in range(30)] for k in range(3)]
    rows = []
    for d in range(120):
        own = kinds[d % 3]
        rows.append((d, " ".join(own[int(x)] for x in rng.geometric(0.15, rng.integers(1, 150)) % 30)))
    return rows + [(500, None), (501, ""), (502, " \t\n"), (503, "ÄB ab AB\x0bab "), (504, "k " * 5000), (None, "k0w1"), (3, rows[3][1])]


@pytest.mark.parametrize("head", [5, 1000])
def test_scores(spark, head):
    rows = fixture()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = markov.score(docs, held_out("doc_id", 1), head=head, states=3, rounds=6).collect()
    flags = {r.doc_id: r.h for r in docs.select("doc_id", held_out("doc_id", 1).alias("h")).collect()}
    count = Counter(w for i, t in rows if not flags[i] for w in words(t))
    total, types = sum(count.values()), len(count)
    base = lambda t: sum(math.log10((count[w] + 0.5) / (total + 0.5 * (types + 1))) for w in words(t))
    want = sorted(((i, flags[i], len(words(t)), sum(w in count for w in words(t)), total, round(base(t), 6)) for i, t in rows), key=str)
    assert sorted(((r.id, r.held, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got), key=str) == want
    unseen = [r for r in got if r.held and r.id is not None and r.id < 120]
    assert unseen and sum(r.score for r in unseen) > sum(r.base_score for r in unseen)
    assert all(r.score < 0 for r in got)


def test_forward_is_exact():
    rng = np.random.default_rng(1)
    chain = markov.Chain(*(x / x.sum(-1, keepdims=True) for x in (rng.random(3), rng.random((3, 3)), rng.random((3, 4)))))
    texts = [rng.integers(0, 4, n) for n in (1, 4, 2, 6, 6)]
    got = chain.log10(np.concatenate(texts), np.concatenate([[0], np.cumsum([len(t) for t in texts])]))
    for text, value in zip(texts, got):
        paths = sum(chain.start[p[0]] * math.prod(chain.move[a, b] for a, b in zip(p, p[1:])) * math.prod(chain.emit[s, x] for s, x in zip(p, text))
                    for p in itertools.product(range(3), repeat=len(text)))
        assert math.isclose(value, math.log10(paths), rel_tol=1e-9)


def test_expected_counts_are_exact():
    rng = np.random.default_rng(4)
    chain = markov.Chain(*(x / x.sum(-1, keepdims=True) for x in (rng.random(2), rng.random((2, 2)), rng.random((2, 3)))))
    start, moves, emission, likelihood = chain.expected(np.array([0, 2, 1, 2, 1, 1]), np.array([0, 4, 6]))
    want = [np.zeros(2), np.zeros((2, 2)), np.zeros((2, 3))]
    for text in ([0, 2, 1, 2], [1, 1]):
        weight = {p: chain.start[p[0]] * math.prod(chain.move[a, b] for a, b in zip(p, p[1:])) * math.prod(chain.emit[s, x] for s, x in zip(p, text))
                  for p in itertools.product(range(2), repeat=len(text))}
        for p, w in weight.items():
            w /= sum(weight.values())
            want[0][p[0]] += w
            for a, b in zip(p, p[1:]):
                want[1][a, b] += w
            for s, x in zip(p, text):
                want[2][s, x] += w
    for a, b in zip((start, moves, emission), want):
        assert np.allclose(a, b, atol=1e-4)


def test_cut_texts_count_like_whole_ones(monkeypatch):
    """Long texts in pieces, with what comes in at their ends, give the counts of the uncut texts."""
    rng = np.random.default_rng(6)
    frequency = rng.random(40) + 0.01
    chain = markov.Chain.first(frequency / frequency.sum(), 5)
    sizes = [1, 700, 30, 64, 65, 257, 1000, 2, 0, 128]
    texts = [rng.integers(0, 40, n) for n in sizes]
    symbols, first = np.concatenate(texts), np.concatenate([[0], np.cumsum(sizes)])
    monkeypatch.setattr(markov, "LONG", 10_000)
    whole = chain.expected(symbols, first)
    monkeypatch.setattr(markov, "LONG", 60)
    monkeypatch.setattr(markov, "PIECE", 32)
    cut = chain.expected(symbols, first)
    for a, b in zip(whole, cut):
        assert np.allclose(a, b, rtol=2e-3, atol=1e-3)
    assert np.isclose(whole[0].sum(), 9) and np.isclose(whole[1].sum(), sum(sizes) - 9) and np.isclose(whole[2].sum(), sum(sizes))
    tens = chain.log10(symbols, first[[*range(9), 10]])           # the empty one left out
    assert np.isclose(whole[3] / np.log(10), tens.sum(), rtol=1e-4) and np.isclose(cut[3] / np.log(10), tens.sum(), rtol=1e-4)


def test_head_must_fit(spark):
    with pytest.raises(ValueError):
        markov.symbol_table(spark.createDataFrame([], "token long, class int, n long"), 70_000)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert markov.score(docs, held_out("doc_id", 1)).count() == 0
    alone = spark.createDataFrame([(2, "a b")], "doc_id long, text string")
    row = markov.score(alone, F.lit(True)).first()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score) == (3, 0, 0, 0.0)
