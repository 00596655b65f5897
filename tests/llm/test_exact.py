"""Tree-merged exact duplicates against plain grouping."""

import random
import re

import pytest
from pyspark.sql import functions as F

from footgrid.llm import exact


def brute(rows):
    groups = {}
    for n, (i, t) in enumerate(rows):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i is None, i or 0, n))
    return {n: (rows[min(g)[3]][0], len(g), n == min(g)[3]) for g in groups.values() for *_, n in g}


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_groups(spark, parts):
    rng = random.Random(parts)
    texts = ["a b", "ab", " ab\n", "", None, "\t", "é ", "é", "x y", "xy", "long " * 5000] + ["".join(rng.choice("ab \n") for _ in range(5)) for _ in range(60)]
    rows = [(rng.choice([None, *range(80)]), rng.choice(texts)) for _ in range(400)]
    docs = spark.createDataFrame([(n, i, t, "q") for n, (i, t) in enumerate(rows)], "row long, doc_id long, text string, sha string").repartition(parts)
    # with a row number of our own, runs are its upper bits; here every row is in run 0 unless spread
    spread = docs.withColumn("row", (F.col("row") % parts) * F.lit(1 << 33) + F.col("row"))
    got = {r.row & ((1 << 33) - 1): (r.keep_id, r.group_size, r.kept) for r in exact.groups(spread, row="row").collect()}
    want = brute([(i, t) for i, t in rows])
    assert {n: v[1:2] for n, v in got.items()} == {n: v[1:2] for n, v in want.items()}
    assert {n: v[0] for n, v in got.items()} == {n: v[0] for n, v in want.items()}
    assert sum(v[2] for v in got.values()) == sum(v[2] for v in want.values())


def test_keep_first(spark):
    rows = [(5, "a b", 1), (4, "ab", 2), (4, "ab", 3), (None, None, 4), (9, " ", 5), (7, "", 6)]
    got = exact.keep_first(spark.createDataFrame(rows, "doc_id long, text string, row int").coalesce(1))
    assert got.columns == ["doc_id", "text", "row"]
    assert sorted(r["row"] for r in got.collect()) == [1, 5]
    assert exact.keep_first(spark.createDataFrame([], "doc_id long, text string")).count() == 0
