"""Collocations against plain Python: counts, cuts, replaced phrases, ranks, tiles, and odd tables."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from footgrid.llm import phrases, queries

KINDS = "text string, lang string"
COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def brute(rows, least=10, longest=3, top=2000, inside=50):
    f, total = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            words = [w for w in re.split("[ \t]+", piece) if w]
            total[lang] += len(words)
            f.update((lang, *words[i: i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1))
    out = []
    for (lang, *words), a in f.items():
        if a < least or len(words) < 2:
            continue
        cuts = [(1_000_000 * a * a // (f[lang, *words[:k]] * f[lang, *words[k:]]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        out.append((lang, words, a, f[lang, *words[:k]], f[lang, *words[k:]], total[lang], score))
    longer = Counter()
    for lang, words, a, *_ in out:
        for n in range(2, len(words)):
            for i in range(len(words) - n + 1):
                key = lang, *words[i: i + n]
                longer[key] = max(longer[key], a)
    kept = [x for x in out if 100 * longer[x[0], *x[1]] < inside * x[2] or (x[0], *x[1]) not in longer]
    listed = []
    for lang in {x[0] for x in kept}:
        own = sorted((x for x in kept if x[0] == lang), key=lambda x: (-x[6], -x[2], " ".join(x[1]).encode()))
        listed += [(lang, k, " ".join(x[1]), *x[2:6], x[6]) for k, x in enumerate(own[:top], 1)]
    return sorted(listed)


def found(frame, **more):
    got = phrases.collocations(frame, **more)
    assert got.columns == COLUMNS
    return sorted(tuple(r) for r in got.collect())


def corpus(n, seed=5):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(40)] + ["Ärger", "é", "x\x01y", "x"]
    weights = [1 / (k + 1) for k in range(len(words))]
    rows = []
    for _ in range(n):
        text = ""
        for w in rng.choices(words, weights, k=rng.randint(0, 60)):
            text += (w.upper() if rng.random() < 0.2 else w) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", "!"])
        rows.append((text, rng.choice(["en", "de", None, ""])))
    return rows


@pytest.mark.parametrize("longest", [2, 3, 4])
def test_like_plain_python(spark, longest):
    rows = corpus(400) + [("new york city is big " * 30, "en"), ("a a a a a a a a a a a a a a", "en"), (None, "en"), ("", None), ("many words", None)] * 2
    frame = spark.createDataFrame(rows, KINDS).repartition(5)
    assert found(frame, longest=longest) == brute(rows, longest=longest)


def test_small_blocks_and_short_reports(spark, monkeypatch):
    rows = corpus(300, 9)
    frame = spark.createDataFrame(rows, KINDS).repartition(3)
    assert found(frame, top=7, least=3, inside=80) == brute(rows, 3, 3, 7, 80)


def test_ties_at_the_cut_go_by_phrase(spark):
    rows = [("b c. a b. c d. x\x01 y. x y", "en")] * 12
    assert [r[2] for r in found(spark.createDataFrame(rows, KINDS), top=2)] == [r[2] for r in brute(rows, top=2)]


def test_tiles_count_what_plain_counting_does():
    rng = np.random.default_rng(2)
    left = np.concatenate([rng.integers(0, 300, 200_000), rng.integers(0, 9000, 50_000)])       # one full tile, many thin ones
    right = np.concatenate([rng.integers(0, 300, 200_000), rng.integers(0, 2_000_000_000, 50_000)])
    key, n = phrases.counted(left, right)
    assert dict(zip(key.tolist(), n.tolist())) == Counter(((left << 32) | right).tolist()) and len(set(key.tolist())) == len(key)


def test_bitmap_holds_all_frequent_pairs(spark):
    rng = np.random.default_rng(4)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 2**31 - 1, (5000, 2))] + [(0, 0), (0, 1), (2**31 - 1, 2**31 - 1)]
    bits = phrases.filter_of(spark.createDataFrame(pairs, "left int, right int"))
    spot = phrases.spots(np.array([(a << 32) | b for a, b in pairs]))
    assert ((bits[spot >> 3] >> (spot & 7).astype(np.uint8)) & 1 == 1).all() and np.unpackbits(bits).sum() == len(set(spot.tolist()))


def test_scores_beyond_64_bits_are_exact(spark):
    from pyspark.sql import functions as F
    cases = [(3 * 10**12, 3 * 10**12 + 1, 3 * 10**12), (10, 10, 10), (10**14 + 7, 10**14 + 9, 10**14 + 8)]
    got = spark.createDataFrame(cases, "a long, l long, r long").select(F.expr(phrases.CUT_SCORE)).collect()
    assert [r[0] for r in got] == [1_000_000 * a * a // (l * r) for a, l, r in cases]


def test_ranks_go_on_over_partitions(spark):
    from pyspark.sql import functions as F
    frame = spark.range(5000).withColumn("f", F.col("id") % 97).drop("id").withColumn("w", F.monotonically_increasing_id()).repartition(7)
    got = phrases.ranked(frame, F.desc("f"), F.asc("w")).orderBy("id").collect()
    assert [r.id for r in got] == list(range(5000)) and [(-r.f, r.w) for r in got] == sorted((-r.f, r.w) for r in got)


def test_empty_table_rare_words_extra_columns_long_text(spark):
    assert found(spark.createDataFrame([], KINDS)) == []
    assert found(spark.createDataFrame([("all words once", "en")], KINDS)) == []
    rows = [("one very long text goes on. " * 50_000, "en", 1, "x", 3)]
    frame = spark.createDataFrame(rows, "text string, lang string, n int, word string, block int")
    assert found(frame) == brute([rows[0][:2]])


def test_query(spark, sf):
    rows = [(r.text, r.lang) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = queries.QUERIES["op13_phrases"](spark, sf)
    assert got.columns == COLUMNS and [t for _, t in got.dtypes] == ["string", "bigint", "string", *["bigint"] * 5]
    assert sorted(tuple(r) for r in got.collect()) == brute(rows)
