"""Near-copy groups and link counts against brute force, also where components are split into blocks."""

import random

import pytest

from footgrid.llm import near
from footgrid.llm.decontaminate import gram_set


def brute(rows, similarity=0.8):
    sets = [frozenset(gram_set(t)) for _, t in rows]
    kinds = sorted(set(sets) - {frozenset()}, key=sorted)
    linked = {a: {b for b in kinds if b != a and len(a & b) / len(a | b) >= similarity} for a in kinds}
    root = {}
    for a in kinds:
        if a not in root:
            todo, seen = [a], {a}
            while todo:
                for b in linked[todo.pop()] - seen:
                    seen.add(b)
                    todo.append(b)
            ids = [i for (i, _), s in zip(rows, sets) if s in seen and i is not None]
            root.update(dict.fromkeys(seen, min(ids, default=None)))
    out = []
    for (i, _), s in zip(rows, sets):
        out.append((i, root[s] if s else i, len(linked[s]) if s else 0, sets.count(s) if s else 1))
    return sorted(out, key=str)


def fixture(groups=12, size=10, words=120):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 5)))
    rows = []
    for _ in range(groups):
        base = [word() for _ in range(words)]
        for _ in range(size):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 2])):
                own[rng.randrange(len(own))] = word()
            rows.append((len(rows), (", " if rng.random() < 0.3 else " ").join(own)))
    rows += [(1000, None), (1001, ""), (1002, "?!"), (1003, "one two"), (1004, "One, two"), (1005, "x " * 3000), (None, rows[0][1]), (7, rows[7][1])]
    return rows


@pytest.mark.parametrize("block", [256, 4])
def test_groups_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(near, "BLOCK", block)
    rows = fixture()
    got = near.groups(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)


def test_keep_one_keeps_columns(spark):
    rows = [(i, t, n, "x", i) for n, (i, t) in enumerate(fixture(4))]
    table = spark.createDataFrame(rows, "doc_id long, text string, row int, class_id string, id long")
    got = near.keep_one(table)
    assert got.columns == table.columns
    want = {}
    for i, c, _, _ in brute([(r[0], r[1]) for r in rows]):
        want.setdefault(c, []).append(i)
    assert sorted(r.doc_id for r in got.collect()) == sorted(min(x for x in v if x is not None) for v in want.values())


def test_empty_table(spark):
    assert near.groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0
