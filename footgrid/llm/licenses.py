"""License scans: phrases and an exact set-similarity join of text blocks with license templates, with DataFrame functions only.

Template tokens are put in one global order, the rarest in the corpus first (document counts over all texts). A text holds a template of k
tokens where a block of it, any run of words as long as the template's own words over the threshold (so that inserted words don't hide a notice),
has at least m = ceil(t k) of these tokens; lines play no part. One of the first k - m + 1 tokens must then stand in the block (prefix
filter, the join key), the text must have m template tokens at all (length filter), and at the first common token enough tokens must be left on
both sides (positional filter). The templates are a constant of some sixty prefix tokens, so this join is a look-up in every row and
nothing is shuffled. What is left is verified on the whole sets, then block by block around the places of the prefix tokens.

Results: null texts are empty; repeated rows give repeated rows; a text without words has no places and no labels; ties between templates
all count; an empty table gives an empty table; other columns are not read. Work grows with a text's words and its places of prefix tokens.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What stands between words, before and after lower-casing A-Z.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
# Phrases with the labels they stand for, and wordings of well-known licenses.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
TEMPLATES = {
    "gpl": ["this work is licensed under the gnu general public license version",
            "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"],
    "lgpl": ["under the terms of the gnu lesser general public license as published by the free software foundation"],
    "apache": ["licensed under the apache license version 2 0"],
    "mit": ["released under the mit license",
            "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"],
    "bsd": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "mpl": ["this source code form is subject to the terms of the mozilla public license v 2 0"],
    "cc-by": ["licensed under cc by 4 0", "this work is licensed under a creative commons attribution 4 0 international license"],
    "cc-by-nc": ["licensed under cc by nc 4 0"],
    "cc-by-sa": ["licensed under cc by sa 4 0"],
    "unlicense": ["this is free and unencumbered software released into the public domain"],
}
THRESHOLD = 0.8


def split_words(text: Column) -> Column:
    return F.array_remove(F.split(text, BETWEEN), "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def places(words: Column) -> Column:
    """Array of (n, first, last, label) of the phrases that stand in a text's lower-cased words."""
    count = lambda s: F.char_length(s) - F.char_length(F.replace(s, F.lit(" "), F.lit("")))

    def place(line: Column, phrase: str, label: str) -> Column:
        last = lambda cut: F.size(words) - (count(F.element_at(cut, -1)) - 1) - len(phrase.split())
        return let(F.split(line, f" {phrase}(?= )"), lambda cut: F.struct(
            (F.size(cut) - 1).alias("n"), count(F.element_at(cut, 1)).alias("first"), last(cut).alias("last"), F.lit(label).alias("label")))

    listed = let(F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" ")), lambda line: F.array(*(place(line, *p) for p in PHRASES.items())))
    return F.filter(listed, lambda x: x["n"] > 0)


def contained(words: Column, held: Column, prefixes: Column, templates: Column) -> Column:
    """Array of (label, share) of the templates that a block of a text holds; `held` are its template tokens in the global order."""

    def met(f: Column) -> Column:
        at = F.array_position(held, f["token"])
        return (at > 0) & (F.size(held) >= f["least"]) & (F.least(f["size"] - f["place"], F.size(held) - at + 1) >= f["least"])

    candidates = F.array_distinct(F.transform(F.filter(prefixes, met), lambda f: f["template"]))
    whole = F.filter(F.transform(candidates, lambda k: F.element_at(templates, k + 1)), lambda c: F.size(F.array_intersect(held, c["tokens"])) >= c["least"])

    def densest(c: Column) -> Column:
        window = c["window"]
        begin = lambda p: F.greatest(p - window + 1, F.lit(1))
        tokens_in = lambda a, n: F.size(F.array_intersect(F.slice(words, a, n), c["tokens"]))
        anchors = F.filter(F.sequence(F.lit(1), F.size(words)), lambda p: F.array_contains(c["first"], F.element_at(words, p)))
        near = F.filter(anchors, lambda p: tokens_in(begin(p), 2 * window - 1) >= c["least"])
        return F.array_max(F.transform(near, lambda p: F.array_max(F.transform(F.sequence(begin(p), p), lambda a: tokens_in(a, window)))))

    found = F.transform(whole, lambda c: F.struct(c["label"].alias("label"), c["least"].alias("least"), c["size"].alias("size"), densest(c).alias("n")))
    return F.transform(F.filter(found, lambda x: x["n"] >= x["least"]), lambda x: F.struct(x["label"].alias("label"), (x["n"] / x["size"]).alias("share")))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, list[str]] = TEMPLATES,
         threshold: float = THRESHOLD) -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every row; labels are sorted arrays."""
    wanted = [(label, sorted(set(t.split())), math.ceil(len(t.split()) / threshold - 1e-9)) for label, many in templates.items() for t in many]
    vocabulary = sorted({w for _, ts, _ in wanted for w in ts})
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    # document count of each template token over all texts: one row per template token comes back
    seen = rows.select(F.explode(F.array_intersect(F.array(*map(F.lit, vocabulary)), F.split(F.lower("text"), BETWEEN))).alias("token"))
    common = {r["token"]: r["n"] for r in seen.groupBy("token").agg(F.count(F.lit(1)).alias("n")).collect()}
    rank = {w: (common.get(w, 0), w) for w in vocabulary}
    prefixes, listed = [], []
    for t, (label, ts, window) in enumerate(wanted):
        ts = sorted(ts, key=rank.get)
        least = math.ceil(threshold * len(ts) - 1e-9)
        first = ts[: len(ts) - least + 1]
        fixed = {"label": label, "tokens": ts, "first": first, "size": len(ts), "least": least, "window": window}
        listed.append(F.struct(*(F.lit(v).alias(k) for k, v in fixed.items())))
        prefixes += [F.struct(*(F.lit(v).alias(k) for k, v in {"token": w, "template": t, "place": k, "size": len(ts), "least": least}.items())) for k, w in enumerate(first)]
    parts = [p.split() for p in PHRASES]
    # words of phrases only come last in the order and make no filter sharper than it may be
    order = [*sorted(vocabulary, key=rank.get), *sorted({w for p in parts for w in p} - set(vocabulary))]

    def told(words: Column) -> Column:
        def of(held: Column) -> Column:
            possible = reduce(or_, (F.size(F.array_intersect(held, F.lit(p))) == len(set(p)) for p in parts))
            none = F.filter(places(F.array().cast("array<string>")), lambda x: F.lit(False))
            return F.struct(F.size(words).cast("long").alias("n_words"), F.when(possible, places(words)).otherwise(none).alias("base"),
                            contained(words, held, F.array(*prefixes), F.array(*listed)).alias("more"))

        return let(F.array_intersect(F.lit(order), words), of)

    lower = F.translate("text", UPPER, LOWER)
    out = rows.select("id", let(split_words(lower), told).alias("one")).select("id", "one.*")
    base = F.array_sort(F.array_distinct(F.transform("base", lambda x: x["label"])))
    return out.select("id", "n_words", F.aggregate("base", F.lit(0), lambda a, x: a + x["n"]).cast("long").alias("n_base"),
                      F.array_min(F.transform("base", lambda x: x["first"])).cast("long").alias("first_word"),
                      F.array_max(F.transform("base", lambda x: x["last"])).cast("long").alias("last_word"), base.alias("base_labels"),
                      F.array_sort(F.array_union(base, F.transform("more", lambda x: x["label"]))).alias("labels"),
                      F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce(F.array_max(F.transform("more", lambda x: x["share"])), F.lit(0.0))).alias("score"))
