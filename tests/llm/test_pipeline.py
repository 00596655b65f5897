"""Pipeline stages against plain Python over the same rows."""

import re

import corpus_pipeline as P
from test_decontaminate import brute as leaked
from test_near import brute as near_groups

from footgrid.llm import toxicity


def plain(docs):
    return sorted((tuple(r) for r in docs.collect()), key=str)


def test_stages_keep_what_brute_force_keeps(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    rows = plain(docs)
    left = P.toxic(spark, docs, sf)
    scores = {r.id: r.score for r in toxicity.scores(docs, toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"), use=~toxicity.held_out("id"))).collect()}
    rows = [r for r in rows if scores[r[0]] < 0.5]
    assert left.columns == columns and plain(left) == rows
    left = P.duplicates(spark, left, sf)
    best = {}
    for r in rows:
        key = re.sub(r"[\x20\x09-\x0D]", "", r[1] or "")
        best[key] = min(best.get(key, (1, 0, None)), (-len(r[1] or ""), r[0], r), key=lambda x: x[:2])
    rows = sorted((b[2] for b in best.values()), key=str)
    assert left.columns == columns and plain(left) == rows
    left = P.near_copies(spark, left, sf)
    of = {i: c for i, c, _, _ in near_groups([(r[0], r[1]) for r in rows])}
    rows = [r for r in rows if of[r[0]] == r[0]]
    assert left.columns == columns and plain(left) == rows
    left = P.leaks(spark, left, sf)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    hit = {k for k, _ in leaked([(r[0], r[1]) for r in rows], items)}
    rows = [r for r in rows if r[0] not in hit]
    assert left.columns == columns and plain(left) == rows
    assert sorted(r.doc_id for r in P.tokens(spark, left, sf).collect()) == sorted(r[0] for r in rows)


def test_stages_take_nulls_repeats_and_empty_tables(spark, sf):
    odd = [(None, None, None, None, None), (1, "", "en", None, 0), (2, None, None, "s", None), (3, "a b c d e f g", "en", "s", 13), (3, "a b c d e f g", "en", "s", 13)]
    for rows, want in ((odd, 2), ([], 0)):
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
        for _, stage in P.STAGES[:-1]:
            docs = stage(spark, docs, sf)
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert P.tokens(spark, docs, sf).count() == want
