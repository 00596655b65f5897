"""Quality by a generalised additive model with pairwise interactions, boosted in cycles.

Every text gets FEATURES of its characters, words, lines and repetitions, none of which knows the corpus. A feature's values fall into BINS bins
by quantiles of the fitting rows. Fitting goes over the features in turn, many times; each turn fits one tree of depth two to the feature's
histogram of gradients and adds a small step of it to that feature's table, so no feature takes what another explains as well. Then pairs
of features are ranked by what a cut through both would gain on what is left, and the best PAIRS get tables of their own over coarser bins, boosted in
cycles likewise. A text's score is the logistic function of the intercept plus one look-up per feature and per pair.

At most `sample` labelled rows are used for fitting (their features come to the driver as numbers), the first by a hash of the id and then of the
text; all texts are scored whole.

Results: a null text is an empty one, and empty texts are scored by their features, all 0; repeated rows are scored alike; of several labels of
one id the highest counts; labels that are null, neither 0 nor 1, held out or without a text are not used. Without any usable label all scores are 0.5,
with one class only they are the smoothed share of that class. An empty table gives an empty table; other columns are not read. A very long
text is a run of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut_lineage, spent
from . import shingles as S

SAMPLE = 20_000
BINS = 48
CUTS = 12                       # bins of each feature of a pair
PAIRS = 12
CYCLES, PAIR_CYCLES = 250, 120
STEP = 0.08
SMOOTH = 4.0                    # added to the sum of weights of every leaf

FEATURES = ["bytes", "words", "word_length", "word_spread", "upper", "digits", "punctuation", "symbols", "spaces", "beyond_ascii", "breaks",
            "symbol_ends", "bare_symbols", "bars", "distinct_words", "top_word", "repeated_pairs", "repeated_fives", "repeated_lines", "line_length",
            "longest_word", "sentences", "commas", "capitalised", "shouted", "runs", "entropy", "inner_symbols"]

_KIND = np.zeros(256, np.uint8)           # 0 other, 1 lower, 2 upper, 3 digit, 4 sentence mark or comma, 5 symbol, 6 white space, 7 beyond ASCII
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[128:] = 1, 2, 3, 7
_KIND[[ord(c) for c in ".,;:!?'\"()-"]] = 4
_KIND[[ord(c) for c in "#$%&*+/<=>@[\\]^_`{|}~"]] = 5
_KIND[[32, *range(9, 14)]] = 6


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return part / np.maximum(whole, 1)


def _per_text(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return total[at[1:]] - total[at[:-1]]


def _repeats(hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per text: distinct values, and how often the most frequent one comes."""
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    begin = np.flatnonzero(new)
    times = np.diff(np.append(begin, len(hashes)))
    most = np.zeros(len(at) - 1, np.int64)
    np.maximum.at(most, owner[begin], times)
    return np.bincount(owner[begin], minlength=len(at) - 1), most


def _ngrams(hashes: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n words within a text, and the offset of each text's first one."""
    counts = np.maximum(np.diff(at) - n + 1, 0)
    if len(hashes) < n:
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    with np.errstate(over="ignore"):
        total = np.zeros(len(hashes) - n + 1, np.uint64)
        for k in range(n):
            total = S.mix(total * np.uint64(3) + hashes[k: len(hashes) - n + 1 + k])
    offsets = np.concatenate([[0], np.cumsum(counts)])
    begin = np.repeat(at[:-1] - offsets[:-1], counts) + np.arange(int(offsets[-1]))
    return total[begin], offsets


def features(texts: pa.Array) -> np.ndarray:
    """One row of FEATURES per text."""
    body, at = S.flat(texts)
    n = len(at) - 1
    size = np.diff(at).astype(float)
    kind = _KIND[body]
    of = [_per_text(kind == k, at) for k in range(8)]
    letters = of[1] + of[2] + of[7]
    starts, ends, first = S.runs(kind != 6, at)
    width = (ends - starts).astype(float)
    words = np.diff(first).astype(float)
    lowered = body + np.where(kind == 2, 32, 0).astype(np.uint8)
    hashes = S.run_hashes(lowered, starts, ends)
    mean = _share(_per_text(width, first), words)
    spread = np.sqrt(np.maximum(_share(_per_text(width ** 2, first), words) - mean ** 2, 0))
    some = np.concatenate([[0], np.cumsum(kind == 5)])
    marks = some[ends] - some[starts]
    upper = np.concatenate([[0], np.cumsum(kind == 2)])
    lower = np.concatenate([[0], np.cumsum((kind == 1) | (kind == 7))])
    capital = upper[ends] - upper[starts]
    begins = kind[starts] if len(starts) else np.zeros(0, np.uint8)
    finish = kind[ends - 1] if len(ends) else np.zeros(0, np.uint8)
    longest = np.zeros(n)
    np.maximum.at(longest, np.repeat(np.arange(n), np.diff(first)), width)
    distinct, top = _repeats(hashes, first)
    pairs, pair_at = _ngrams(hashes, first, 2)
    fives, five_at = _ngrams(hashes, first, 5)
    line_starts, line_ends, line_at = S.runs(body != 10, at)
    lines = np.diff(line_at).astype(float)
    same = np.concatenate([[False], (body[1:] == body[:-1]) & (kind[1:] != 6)])[: len(body)]
    owner = np.repeat(np.arange(n), np.diff(at))
    spectrum = np.bincount(owner * 32 + (lowered & 31), minlength=32 * n).reshape(n, 32) / np.maximum(size, 1)[:, None]
    repeated = lambda h, a: 1 - _share(_repeats(h, a)[0], np.diff(a)) * 1.0
    one = lambda values, k: values * (k > 0)
    columns = [np.log1p(size), np.log1p(words), mean, spread, _share(of[2], letters), _share(of[3], size), _share(of[4], size), _share(of[5], size),
               _share(of[6], size), _share(of[7], size), _share(_per_text(body == 10, at), words), _share(_per_text(finish == 5, first), words),
               _share(_per_text(marks == width, first), words), _share(_per_text(body == 124, at), words), distinct / np.maximum(words, 1) ** 0.9,
               _share(top, words), one(repeated(pairs, pair_at), np.diff(pair_at)), one(repeated(fives, five_at), np.diff(five_at)),
               one(repeated(S.run_hashes(lowered, line_starts, line_ends), line_at), lines), np.log1p(_share(size, lines)), np.log1p(longest),
               _share(_per_text(np.isin(body, [33, 46, 63]), at), words), _share(_per_text(body == 44, at), words),
               _share(_per_text((begins == 2) & (capital == 1), first), words), _share(_per_text((capital > 1) & (lower[ends] == lower[starts]), first), words),
               _share(_per_text(same, at), size), -(spectrum * np.log2(np.maximum(spectrum, 1e-12))).sum(1), _share(_per_text((marks > 0) & (marks < width), first), words)]
    return np.column_stack([np.where(size > 0, c, 0.0) for c in columns])


class Additive:
    """Bin edges per feature, one table per feature, and one per chosen pair over coarser bins."""

    def __init__(self, edges: list[np.ndarray], intercept: float):
        self.edges, self.intercept = edges, intercept
        self.tables = [np.zeros(len(e) + 1) for e in edges]
        self.pairs: list[tuple[int, int, np.ndarray]] = []
        self.coarse = [np.minimum(np.arange(len(e) + 1) * CUTS // (len(e) + 1), CUTS - 1) for e in edges]

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(self.edges)]).reshape(len(x), len(self.edges))

    def margin(self, bins: np.ndarray) -> np.ndarray:
        out = np.full(len(bins), self.intercept)
        for k, table in enumerate(self.tables):
            out += table[bins[:, k]]
        for i, j, table in self.pairs:
            out += table[self.coarse[i][bins[:, i]], self.coarse[j][bins[:, j]]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(self.bins(x)), -30, 30)))


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g ** 2 / (h + SMOOTH)


def _cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """Best gain and place of one cut through a histogram of gradients; place 0 is no cut."""
    if len(g) < 2:
        return 0.0, 0
    left, weight = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gain = _gain(left, weight) + _gain(g.sum() - left, h.sum() - weight) - _gain(g.sum(), h.sum())
    k = int(np.argmax(gain))
    return (float(gain[k]), k + 1) if gain[k] > 1e-9 else (0.0, 0)


def tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Value per bin of a tree of depth two over one feature's histogram."""
    out = np.empty(len(g))
    _, middle = _cut(g, h)
    for a, b in ((0, middle), (middle, len(g))):
        if a == b:
            continue
        _, k = _cut(g[a:b], h[a:b])
        for lo, hi in ((a, a + k), (a + k, b)):
            if lo < hi:
                out[lo:hi] = g[lo:hi].sum() / (h[lo:hi].sum() + SMOOTH)
    return out


def pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """Value per cell of a tree that cuts one feature of a pair and then each half by the other one; and what it gains."""
    best = (np.zeros_like(g), 0.0)
    for turned in (False, True):
        gt, ht = (g.T, h.T) if turned else (g, h)
        left, weight = np.cumsum(gt, 0)[:-1], np.cumsum(ht, 0)[:-1]                     # rows up to each first cut, by the other feature
        def halves(a, b):                                                              # gain of the best second cut of each half
            cum, cw = np.cumsum(a, 1)[:, :-1], np.cumsum(b, 1)[:, :-1]
            return (_gain(cum, cw) + _gain(a.sum(1, keepdims=True) - cum, b.sum(1, keepdims=True) - cw)).max(1)
        gain = halves(left, weight) + halves(gt.sum(0) - left, ht.sum(0) - weight) - _gain(g.sum(), h.sum())
        k = int(np.argmax(gain))
        if gain[k] > best[1]:
            out = np.zeros_like(gt)
            for rows in (slice(0, k + 1), slice(k + 1, None)):
                gs, hs = gt[rows].sum(0), ht[rows].sum(0)
                _, c = _cut(gs, hs)
                for cols in (slice(0, c), slice(c, None)):
                    if gs[cols].size:
                        out[rows, cols] = gs[cols].sum() / (hs[cols].sum() + SMOOTH)
            best = (out.T if turned else out, float(gain[k]))
    return best


def boost(x: np.ndarray, y: np.ndarray) -> Additive:
    """The model of rows x with labels y (0 or 1); both classes share the weight as they come."""
    share = (y.sum() + 0.5) / (len(y) + 1)
    edges = [np.unique(np.quantile(x[:, k], np.arange(1, BINS) / BINS)) for k in range(x.shape[1])] if len(x) else [np.zeros(0)] * len(FEATURES)
    model = Additive(edges, float(np.log(share / (1 - share))))
    if not len(y) or y.min() == y.max():
        return model
    bins = model.bins(x)
    margin = np.full(len(y), model.intercept)

    def slope():
        p = 1 / (1 + np.exp(-margin))
        return y - p, p * (1 - p)

    for _ in range(CYCLES):
        for k, table in enumerate(model.tables):
            if len(table) < 2:
                continue
            g, h = slope()
            add = STEP * tree(np.bincount(bins[:, k], g, len(table)), np.bincount(bins[:, k], h, len(table)))
            table += add
            margin += add[bins[:, k]]
    coarse = np.column_stack([model.coarse[k][bins[:, k]] for k in range(x.shape[1])])
    sizes = [c[-1] + 1 for c in model.coarse]
    g, h = slope()
    cell = lambda i, j: coarse[:, i] * sizes[j] + coarse[:, j]
    grid = lambda v, i, j: np.bincount(cell(i, j), v, sizes[i] * sizes[j]).reshape(sizes[i], sizes[j])
    usable = [k for k, s in enumerate(sizes) if s > 1]
    ranked = sorted(((-pair_tree(grid(g, i, j), grid(h, i, j))[1], i, j) for i, j in combinations(usable, 2)))[:PAIRS]
    model.pairs = [(i, j, np.zeros((sizes[i], sizes[j]))) for gain, i, j in ranked if gain < 0]
    for _ in range(PAIR_CYCLES):
        for i, j, table in model.pairs:
            g, h = slope()
            add = STEP * pair_tree(grid(g, i, j), grid(h, i, j))[0]
            table += add
            margin += add.ravel()[cell(i, j)]
    for k, table in enumerate(model.tables):                    # tables are told with a mean of 0, their means go to the intercept
        mean = table[bins[:, k]].mean()
        table -= mean
        model.intercept += mean
    return model


def _described(rows: DataFrame) -> DataFrame:
    """(key, x): the features of column `text` beside column `key`."""
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, part in S.chunks(batch.column(1)):
                x = features(part)
                lists = pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, len(part)), lists], ["key", "x"])

    return rows.select("key", "text").mapInArrow(run, f"key {kind}, x array<double>")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
        sample: int = SAMPLE, use: Column | None = None) -> Additive:
    """A model from at most `sample` labelled rows. `use` says which labels, by `id`, may be used."""
    told = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("id is not null and label in (0, 1)")
    told = (told if use is None else told.where(use)).groupBy("id").agg(F.max("label").alias("label"))
    told = F.broadcast(told.orderBy(F.xxhash64("id"), "id").limit(sample))             # `sample` pairs of numbers
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    rows = texts.join(told, "id").select(F.struct(F.xxhash64("id").alias("order"), F.xxhash64("text").alias("then"), "label").alias("key"), "text")
    # an id may have many rows: features of all are made where they lie, and no more than `sample` of them come here
    made = cut_lineage(_described(rows).select("key.*", "x"))
    got = made.orderBy("order", "then", "label").limit(sample).select("label", "x").toArrow()
    spent(made)
    x = got.column("x").combine_chunks()
    x = np.asarray(x.flatten() if isinstance(x, pa.Array) else x.chunk(0).flatten()) if got.num_rows else np.zeros(0)
    return boost(x.reshape(-1, len(FEATURES)), got.column("label").to_numpy().astype(float))


def scores(docs: DataFrame, model: Additive, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score double from 0 to 1) of every row."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)              # FEATURES x BINS and PAIRS x CUTS^2 numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, part in S.chunks(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, len(part)), pa.array(shared.value.score(features(part)))], ["id", "score"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, score double")
