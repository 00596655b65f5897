"""Base spans against Python's regular expressions, discovery of identifiers by context, edge cases."""

import random
import re

from pyspark.sql import functions as F

from footgrid.llm import pii

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def good(kind, m):
    d = re.sub("[^0-9]", "", m)
    return {"email": True, "ip": all(int(p) <= 255 for p in m.split(".")) if kind == "ip" else None,
            "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]


def brute(text):
    return [[(m.start(), m.end()) for m in re.finditer(p, text or "") if good(k, m[0])] for k, p in PATTERNS.items()]


def spans(row):
    return [[(s["start"], s["end"]) for s in row[k]] for k in pii.KINDS]


def test_base_spans_equal_brute_force(spark):
    rng = random.Random(9)
    bits = ["a@b.c", "x_y@d-e.f.g", "1.2.3.4", "256.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1111", "+1 (456) 555-2186", "+49", "@", ".", "-", " ", "é", "😀", "7", "00012.0.0.1",
            "_", "%", "+", "(", ")", "\n", "5500005555555559", "q"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 25))) for _ in range(600)]
    texts += [None, "", "1" * 30000, "a" * 30000, "a.a" * 10000 + "@", "x@" + "y." * 9000 + "z", "1 " * 9000, "1." * 9000, "+1" + " 2" * 9000, "@" * 9000, "a@b.c_x@d.e"]
    rows = [(i, t, "x", [1]) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string, value array<int>")
    for r in pii.find(docs).collect():
        assert spans(r) == brute(texts[r["id"]]), texts[r["id"]][:200]


def test_given_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in pii.find(docs).collect():
        assert spans(r) == brute(text[r["id"]])


def test_contexts_discover_identifiers(spark):
    texts = [f"the talk went on, mailbox: user{i}@host{i}.org was told of the word {i}" for i in range(20)]
    texts += [f"then mailbox: member#{i}77 was told so" for i in range(4)] + ["the number 12 of the day", "word 99 was the last"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["id"]: [texts[r["id"]][s["start"]:s["end"]] for s in r["context"]] for r in pii.find(docs).collect()}
    assert all(found[20 + i] == [f"member#{i}77"] for i in range(4))
    assert all(found[i] == [] for i in (*range(20), 24, 25))


def test_repeated_rows_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a@b.de"), (1, "a@b.de"), (None, "a@b.de")], "doc_id long, text string")
    assert [spans(r)[0] for r in pii.find(docs).collect()] == [[(0, 6)]] * 3
    assert pii.find(docs.where(F.lit(False))).count() == 0


def contexts(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [[texts[r["id"]][s["start"]:s["end"]] for s in r["context"]] for r in sorted(pii.find(docs).collect(), key=lambda r: r["id"])]


def test_copies_do_not_lower_trust(spark):
    texts = [f"the talk went on, mailbox: user{i}@host{i}.org was told of the word {i}" for i in range(20)]
    texts += [f"then mailbox: member#{i}77 was told so" for i in range(4)]
    found = contexts(spark, texts + texts[:1] * 3000)
    assert found[20:24] == [[f"member#{i}77"] for i in range(4)] and not any(found[:20] + found[24:])


def test_one_sure_pattern_at_the_end(spark):
    texts = [f"the talk went on, mailbox: user{i}@host{i}.org" for i in range(60)] + ["and then mailbox: member#177", "room 12", "mailing 12"]
    assert contexts(spark, texts) == [[]] * 60 + [["member#177"], [], []]


def beside(text, start, end):
    bare = lambda w: "".join(c for c in w.lower() if c.isalnum())
    left, right = text[:start].split(), text[end:].split()
    return bare(left[-1]) if left else "", bare(right[0]) if right else ""


def test_words_beside_spans_are_whole_and_blocks_don_t_show(spark, monkeypatch):
    monkeypatch.setattr(pii, "BLOCK", 64)
    rng = random.Random(2)
    bits = ["a@b.c", "id77", "word", "w" * 45, "ü1", "1.2.3.4", "x-y", "(note)", "4111 1111 1111 1111", "😀", "9" * 30]
    texts = ["".join(rng.choice(bits) + rng.choice([" ", " ", "\n", "  "]) for _ in range(rng.randint(1, 60))) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    told = pii.base(docs, "doc_id", "text")
    rows = {r["row"]: r["id"] for r in told.select("row", "id").collect()}
    seen = 0
    for r in pii.occurrences(told).collect():
        text = texts[rows[r["row"]]]
        assert r["value"] == text[r["start"]: r["end"]] and (r["before"], r["after"]) == beside(text, r["start"], r["end"]), (text, r)
        seen += 1
    assert seen > 500


def test_very_long_text_in_linear_time(spark):
    import time
    text = " ".join(f"label user{i}@host.org and id{i}x" for i in range(50_000)) + " " + " ".join(f"tok{i}" for i in range(100_000))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    begin = time.time()
    row = pii.find(docs).collect()[0]
    assert len(row["email"]) == 50_000 and time.time() - begin < 240
