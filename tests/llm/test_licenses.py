"""License scan against brute force."""

import math
import random
import re

from footgrid.llm import licenses as L

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def brute(text, threshold=L.THRESHOLD):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(WORD, lower)
    places, base = [], set()
    for phrase, label in L.PHRASES.items():
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i:i + len(p)] == p:
                places.append(i)
                base.add(label)
    best, labels = 0.0, set(base)
    for label, many in L.TEMPLATES.items():             # every run of words as long as a template's words over the threshold, lines or not
        for t in many:
            tokens, window = set(t.split()), math.ceil(len(t.split()) / threshold - 1e-9)
            n = max(len(tokens & set(words[i:i + window])) for i in range(len(words) or 1))
            if n >= math.ceil(threshold * len(tokens) - 1e-9):
                labels.add(label)
                best = max(best, n / len(tokens))
    return (len(words), len(places), min(places, default=None), max(places, default=None), sorted(base), sorted(labels), 1.0 if base else best)


def test_scan_equals_brute_force(spark):
    texts = [None, "", "...", "MIT License", "x mit-license, MIT LICENSE\nmit  license", "a cc\nby b", "Licensed under CC BY-NC 4.0.", "permit license", "émit license",
             "mit licenseé", "Licensed under the Apache License, Version 2.0.", "cc by cc by gnu general public license gnu General Public license mit license",
             "This work is licensed under the GNU General Public License, version 3.", "released under license of mit the", "the of and under",
             "Redistribution and use in source and binary forms, with modification, are permitted provided that the following conditions are met:",
             "word " * 20000 + "Apache License " + "word " * 10, "This is free and unencumbered software\nreleased into the public domain",
             "free unencumbered software released into the public domain is this", "apachelicense apache_license apache license2", "lİcense mit lİcense Kcc by"]
    rows = [(i if i != 4 else None, t, "x", 1) for i, t in enumerate(texts)] * 2
    got = L.scan(spark.createDataFrame(rows, "doc_id long, text string, row string, words int")).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted((tuple(r) for r in got), key=key) == sorted(((i, *brute(t)) for i, t, _, _ in rows), key=key)


def test_given_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r["id"]: tuple(r)[1:] for r in L.scan(docs).collect()}
    assert got == {r.doc_id: brute(r.text) for r in docs.collect()}


def test_empty_table(spark):
    assert L.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


MIT = ["Permission is hereby granted, free of charge, to any person obtaining a copy", "of this software and associated documentation files (the \"Software\"), to deal"]
BSD = ["Redistribution and use in source and binary forms, with or without", "modification, are permitted provided that the following conditions are met:"]
MPL = ["This Source Code Form is subject to the terms of the Mozilla Public", "License, v. 2.0. If a copy of the MPL was not distributed with this"]
LGPL = ["modify it under the terms of the GNU Lesser General Public", "License as published by the Free Software Foundation; either"]


def test_wrapped_notices(spark):
    rng = random.Random(4)
    texts, labels = [], []
    for label, lines in (("mit", MIT), ("bsd", BSD), ("mpl", MPL), ("lgpl", LGPL)):
        for mark in ("", " * ", "# ", "// "):
            texts.append("int x;\n" * rng.randint(0, 60) + "\n".join(mark + line for line in lines) + "\r\n" + "return y;\n" * 30)
            labels.append(label)
    words = [w for _, many in L.TEMPLATES.items() for t in many for w in t.split()]
    for _ in range(60):             # pieces of notices, broken anywhere, with words in between
        text = ""
        for _ in range(rng.randint(1, 12)):
            t = rng.choice([t for many in L.TEMPLATES.values() for t in many]).split()
            t = [w for w in t if rng.random() < 0.93] + rng.choices(words, k=rng.randint(0, 20))
            text += "".join(w + (" " if rng.random() < 0.85 else rng.choice(["\n", "\n\n * ", ".\n# "])) + ("filler " if rng.random() < 0.1 else "") for w in t)
        texts.append(text)
    docs = spark.createDataFrame(list(enumerate([*texts, None, "", "\n"])), "doc_id long, text string")
    got = {r["id"]: tuple(r)[1:] for r in L.scan(docs).collect()}
    assert all(label in got[i][5] and got[i][6] == 1.0 for i, label in enumerate(labels))
    assert got == {i: brute(t) for i, t in enumerate([*texts, None, "", "\n"])}


def test_line_breaks_don_t_matter(spark):
    """Scattered tokens of one template are no notice, on one line or on many; a notice is one, on one line or on many."""
    scattered = " ".join(w + " filler" * 300 for w in "licensed under cc 4 by 0".split())
    whole = "x " * 400 + " ".join(BSD) + " y" * 400
    texts = [scattered, scattered.replace(" ", "\n"), whole, whole.replace(" ", "\n"), whole.replace(" ", " \n * ")]
    got = {r["id"]: tuple(r)[1:] for r in L.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}
    assert [got[i][5:] for i in range(5)] == [([], 0.0)] * 2 + [(["bsd"], 1.0)] * 3


def test_very_long_text_and_other_templates(spark):
    text = "under the filler words of this text " * 30_000 + " ".join(MPL) + " the" * 20_000
    got = L.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()[0]
    assert got["labels"] == ["mpl"] and got["n_words"] == 7 * 30_000 + 28 + 20_000
    own = L.scan(spark.createDataFrame([(1, "own rare words, apache license")], "doc_id long, text string"), templates={"own": ["my own rare words"]}, threshold=0.75).collect()[0]
    assert (own["labels"], own["base_labels"], own["n_base"], own["first_word"]) == (["apache", "own"], ["apache"], 1, 3)
