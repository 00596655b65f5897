"""Kernel against brute force, held-out accuracy, gapped insults, edge cases."""

import itertools
import random
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from footgrid.llm import toxicity as T


def brute_kernel(s, t):
    def features(w):
        out = {}
        for a, b, c in itertools.combinations(range(len(w) + 1), 3):
            if c - a < T.SPAN:
                x = "^" + w
                key = x[a], x[b], x[c]
                out[key] = out.get(key, 0) + T.DECAY ** (c - a + 1)
        return out
    f, g = features(s), features(t)
    norm = lambda x: sum(v * v for v in x.values()) ** 0.5
    return sum(v * g.get(k, 0) for k, v in f.items()) / max(norm(f) * norm(g), 1e-12)


def test_kernel_is_exact():
    words = ["idiot", "idiiot", "ixdiot", "moron", "aaaa", "ab", "banana", "bandana", "a"]
    got = T.kernel(words, words)
    assert np.allclose(got, [[brute_kernel(a, b) for b in words] for a in words], atol=1e-5)


def corpus(n=900, part=0.2):
    rng = random.Random(6)
    plain = ["".join(rng.choice(["ta", "ren", "lo", "is", "mu", "on", "ve"]) for _ in range(rng.randint(1, 4))) for _ in range(400)]
    bad = ["idiot", "moron", "worthless", "scum"]
    rows, labels = [], []
    for i in range(n):
        ws = [rng.choice(plain) for _ in range(rng.randint(5, 80))]
        toxic = rng.random() < part
        for _ in range(2 if toxic else 0):
            ws.insert(rng.randrange(len(ws)), rng.choice(bad))
        rows.append((i, " ".join(ws)))
        labels.append((i, int(toxic)))
    return rows, labels


@pytest.fixture(scope="module")
def fitted(spark):
    rows, labels = corpus()
    docs, told = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    return docs, dict(labels), T.fit(docs, told, use=~T.held_out("id"))


def test_held_out_accuracy(fitted):
    docs, labels, machine = fitted
    unseen = T.scores(docs.where(T.held_out("doc_id")), machine).collect()
    assert len(unseen) > 100 and np.mean([(r.score >= 0.5) == labels[r.id] for r in unseen]) > 0.97


def test_gaps_and_inserted_characters(fitted):
    machine = fitted[2]
    score = lambda w: float(machine.share(machine.worst(pa.array([f"ta loren {w} veon {w}"]))[0])[0])
    for word in ("idiot", "i-d-i-o-t", "i d i o t", "idi*ot", "idiiot", "IDIOT!", "mor.on", "wor-thless", "idiots"):
        assert score(word) >= 0.5, word
    for word in ("taren", "isloon", "mumuve"):
        assert score(word) < 0.5, word


def test_rows(spark, fitted):
    docs = spark.createDataFrame([(1, None, 0.5), (1, None, 0.5), (None, "you idiot moron", 0.1), (2, "", 0.2), (3, "ta " * 50000 + "idiot scum", 0.3), (4, "x" * 100000, 1.0)],
                                 "doc_id long, text string, score double")
    got = sorted(((r.id, round(r.score, 6) >= 0.5) for r in T.scores(docs, fitted[2]).collect()), key=str)
    assert got == sorted([(1, False), (1, False), (None, True), (2, False), (3, True), (4, False)], key=str)
    assert T.scores(docs.limit(0), fitted[2]).count() == 0
    labels = spark.createDataFrame([(1, None), (None, 1), (2, 0)], "doc_id long, toxic int")
    assert T.fit(docs, labels) is None and [r.score for r in T.scores(docs, None).collect()] == [0.0] * 6
    assert T.clean(docs, labels).count() == 6


def test_clean_keeps_columns(spark, fitted):
    docs, _, machine = fitted
    odd = docs.withColumn("id", F.lit("x")).withColumn("all", F.col("doc_id")).withColumn("label", F.lit(3))
    labels = spark.createDataFrame(corpus()[1], "doc_id long, toxic int")
    got = T.clean(odd, labels)
    assert got.columns == odd.columns
    assert {r.doc_id for r in got.collect()} == {r.id for r in T.scores(docs, machine).collect() if r.score < 0.5}


def test_held_out_is_crc32(spark):
    got = spark.range(2000).select("id", T.held_out("id").alias("h"), T.held_out("id", 1).alias("g")).collect()
    assert all(r.h == (crc32(str(r.id).encode()) % 5 == 0) and r.g == (crc32(str(r.id).encode()) % 5 == 1) for r in got)


@pytest.mark.parametrize("part", [0.3, 0.5, 0.9])
def test_any_share_of_toxic_labels(spark, part):
    rows, labels = corpus(1500, part)
    # every fortieth clean text names an insult once
    plain = [i for i, toxic in labels if not toxic][::40]
    rows = [(i, f"{text} moron" if i in plain else text) for i, text in rows]
    docs, told, truth = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"), dict(labels)
    machine = T.fit(docs, told, use=~T.held_out("id"))
    unseen = [r for r in T.scores(docs.where(T.held_out("doc_id")), machine).collect() if r.id not in plain]
    assert np.mean([r.score >= 0.5 for r in unseen if truth[r.id]]) > 0.95
    assert np.mean([r.score < 0.5 for r in unseen if not truth[r.id]]) > 0.95
    left = {r.doc_id for r in T.clean(docs, told).collect()}
    assert len(left & {i for i in truth if truth[i]}) < 0.05 * sum(truth.values())


def test_no_telling_word_gives_no_verdict(spark):
    docs = spark.createDataFrame([(i, f"same {i} words") for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 20)) for i in range(60)], "doc_id long, toxic int")
    got = {r.id: r.score for r in T.scores(docs, T.fit(docs, labels)).collect()}
    assert len(got) == 60 and max(got[i] for i in range(20, 60)) < 0.5           # what all texts share speaks against none


def test_very_small_label_tables_and_one_id_with_many_rows(spark):
    """Two toxic texts among forty; one labelled id a thousand times."""
    clean = [(k, f"plain words number {k} about house{k % 7} and river{k % 5}", 0) for k in range(38)]
    rows = clean + [(100, "you total zorfblat of a person", 1), (101, "what zorfblats they all are zorfblat", 1)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(k, t) for k, _, t in rows], "doc_id long, toxic int")
    machine = T.fit(docs, labels)
    got = {r.id: r.score for r in T.scores(docs, machine).collect()}
    assert min(got[100], got[101]) > max(got[k] for k in range(38))
    again = docs.unionByName(docs.where("doc_id = 3").crossJoin(spark.range(1000)).drop("id"))
    many = T.fit(again, labels, sample=50)
    assert min(r.score for r in T.scores(docs, many).collect() if r.id >= 100) > 0
    alone = T.fit(docs.where("doc_id in (1, 2, 100)"), labels)
    assert T.scores(docs, alone).count() == 40
    with pytest.raises(ValueError):
        T.fit(spark.createDataFrame([(1, "words"), (2, "..."), (3, None)], "doc_id long, text string"), spark.createDataFrame([(1, 0), (2, 1), (3, 1)], "doc_id long, toxic int"))
