"""Containment search against brute force, and its edge cases."""

import random

from footgrid.llm import decontaminate as D


def brute(docs, items, threshold=0.8):
    out = set()
    for key, text in docs:
        have = D.gram_set(text)
        for item, said in items:
            grams = D.gram_set(said)
            if grams and len(grams & have) / len(grams) >= threshold:
                out.add((key, item))
    return out


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def fixture():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgäé") for _ in range(rng.randint(2, 6)))
    items = [(i, " ".join(word() for _ in range(rng.choice([1, 3, 5, 6, 9, 20, 33, 70, 150])))) for i in range(60)]
    docs = []
    for d in range(160):
        body = [word() for _ in range(rng.choice([0, 3, 40, 400, 3000]))]
        for _ in range(rng.randint(0, 3)):
            item = rng.choice(items)[1].split()
            if rng.random() < 0.4 and len(item) > 30:
                item[rng.randrange(len(item))] = "changed"
            at = rng.randint(0, len(body))
            body[at:at] = [w.upper() if rng.random() < 0.2 else w for w in item]
        docs.append((d, ", ".join(body)))
    docs += [(200 + i, items[i][1]) for i in range(60)] + [(400, None), (401, ""), (402, "!!"), (None, items[7][1])]
    items += [(900, None), (901, " . "), (902, "")]
    return docs, items


def test_matches_equal_brute_force(spark):
    docs, items = fixture()
    got = D.matches(frame(spark, docs, "doc_id long, text string"), frame(spark, items, "item_id long, text string"))
    assert {(r.row, r.item) for r in got.collect()} == brute(docs, items)


def test_shuffled_search_gives_the_same(spark, monkeypatch):
    docs, items = fixture()
    monkeypatch.setattr(D, "BROADCAST_ROWS", 0)
    got = D.matches(frame(spark, docs, "doc_id long, text string"), frame(spark, items, "item_id long, text string"))
    assert {(r.row, r.item) for r in got.collect()} == brute(docs, items)


def test_clean_keeps_columns_and_repeated_rows(spark):
    docs, items = fixture()
    hit = {k for k, _ in brute(docs, items)}
    rows = [(k, t, f"x{n}", n) for n, (k, t) in enumerate(docs)] * 2
    table = frame(spark, rows, "doc_id long, text string, row string, key int")
    got = D.clean(table, frame(spark, items, "item_id long, text string"))
    assert got.columns == table.columns
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, (r for r in rows if r[0] not in hit)))


def test_empty_tables(spark):
    docs, items = frame(spark, [], "doc_id long, text string"), frame(spark, [], "item_id long, text string")
    some = frame(spark, [(1, "a b c d e f g")], "doc_id long, text string")
    assert D.matches(docs, items).count() == 0
    assert D.matches(some, items).count() == 0
    assert D.clean(some, items).count() == 1
