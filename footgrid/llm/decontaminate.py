"""Benchmark decontamination: size-partitioned minhash containment search, verified on exact shingles.

A short item inside a long text has a Jaccard similarity near zero, so texts are not sketched whole. Items are partitioned by size
class (up to 2, 4, 8, ... shingles), and for each class that occurs texts are cut into windows of that class's size, one every half
window. An item of s shingles, c/2 < s <= c, that stands in a text shares (s + c/2) / 2 of them at least with one of these windows, which
bounds the similarity of the two from below (0.36 at a threshold of 0.8), and the number of bands follows from that bound and the wanted
recall; a band is a single minimum, as window and item are of like size. Windows of a class are made of the minima of the class
below, so a text is hashed once. Texts with a window minimum that is some item's minimum in that class and band are candidates for it,
and each candidate is verified on the full sets of word shingles, as strings.

Results: an item is found in a text if at least `threshold` of its distinct shingles stand in it. Words are runs of ASCII letters and
digits and non-ASCII characters of the lower-cased text; a text or item of fewer than `n` words has one shingle, all its
words. Null or wordless texts and items match nothing; equal rows have equal answers; empty tables give no matches; `clean`
returns all other columns as they are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage
from . import minhash, shingles as S

N = 5
THRESHOLD = 0.8
RECALL = 0.9999
#: Up to this many minima of items (8 bytes each) go to every task and sort out texts there; beyond it all sketches are shuffled.
BROADCAST_ROWS = 1_000_000
WORDS = re.compile(r"[a-z0-9\u0080-\U0010ffff]+")


def gram_set(text: str | None, n: int = N) -> set[tuple[str, ...]]:
    found = WORDS.findall((text or "").lower())
    if len(found) < n:
        return {tuple(found)} if found else set()
    return {tuple(found[k: k + n]) for k in range(len(found) - n + 1)}


def bands_needed(threshold: float, recall: float) -> int:
    """Bands of one minimum each for the least similarity of an item and its best window, reached at either end of a size class."""
    least = min((0.5 * (s + 1) - (1 - threshold) * s) / (s + 2 - 0.5 * (s + 1) + (1 - threshold) * s) for s in (1.0, 2.0))
    return minhash.bands_for(max(least, 0.01), 1, recall)


def size_class(count: np.ndarray) -> np.ndarray:
    """Level k of the items with up to 2^k shingles, 1 at least."""
    return np.maximum(1, np.ceil(np.log2(np.maximum(count, 1)))).astype(np.int32)


def item_minima(items: DataFrame, id_col: str, text_col: str, n: int, bands: int) -> DataFrame:
    """(class, band, minimum) -> item, of every item with words."""
    rows = items.select(id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, part in S.chunks(batch.column(1)):
                values, at = S.distinct(*S.shingles(part, n))
                has = np.flatnonzero(np.diff(at))
                if not len(has):
                    continue
                least = minhash.minima(values, at[:-1][has], bands)
                level = np.repeat(size_class(np.diff(at)[has]), bands)
                ids = batch.column(0).take(pa.array(np.repeat(first + has, bands)))
                yield pa.RecordBatch.from_arrays([ids, pa.array(level), pa.array(np.tile(np.arange(bands, dtype=np.int32), len(has))),
                                                  pa.array(least.ravel().view(np.int64))], ["item", "level", "band", "minimum"])

    return rows.mapInArrow(run, f"item {rows.schema[id_col].dataType.simpleString()}, level int, band int, minimum long")


def windows(values: np.ndarray, at: np.ndarray, levels: list[int], bands: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per level: the text and the minima of each of its windows; a window is two half windows that follow each other."""
    half = 1 << (min(levels) - 1)
    counts = np.diff(at)
    cells = -(-counts // half)
    owner = np.repeat(np.arange(len(counts)), cells)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(cells) - cells, cells)
    least = minhash.minima(values, at[:-1][owner] + place * half, bands)
    last = len(owner)
    for level in range(min(levels), max(levels) + 1):
        if level > min(levels):                           # two half windows are one of the next level
            even = np.flatnonzero(place % 2 == 0)
            odd = np.minimum(even + 1, last - 1)
            least = np.where((owner[odd] == owner[even])[:, None], np.minimum(least[even], least[odd]), least[even])
            owner, place = owner[even], place[even] // 2
            last = len(owner)
        if level in levels:
            following = np.minimum(np.arange(last) + 1, last - 1)
            yield level, owner, np.where((owner[following] == owner)[:, None], np.minimum(least, least[following]), least)


class Wanted:
    """Fast membership in a sorted array of 64-bit values: a bitmap of their upper bits first."""

    def __init__(self, values: np.ndarray, bits: int = 22):
        self.values, self.shift = values, np.uint64(64 - bits)
        self.seen = np.zeros(1 << bits, bool)
        self.seen[values >> self.shift] = True

    def where(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        row, col = np.nonzero(self.seen[x >> self.shift])
        got = x[row, col]
        at = np.minimum(np.searchsorted(self.values, got), max(len(self.values) - 1, 0))
        hit = self.values[at] == got if len(self.values) else np.zeros(len(got), bool)
        return row[hit], col[hit]


def sketches(docs: DataFrame, row: str, text_col: str, n: int, bands: int, levels: list[int], wanted: np.ndarray | None) -> DataFrame:
    """(row, text, hits array<struct<level, band, minimum>>). With `wanted`, the minima of all items, only texts and minima that can
    match, with the text beside them; else all minima of every text, without it."""
    rows = docs.select(F.col(row).alias("row"), F.col(text_col).alias("text"))
    shared = None if wanted is None else docs.sparkSession.sparkContext.broadcast(wanted)
    hit_type = pa.struct([("level", pa.int32()), ("band", pa.int32()), ("minimum", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        member = None if shared is None else Wanted(shared.value)
        for batch in batches:
            for first, part in S.chunks(batch.column(1)):
                values, at = S.shingles(part, n)
                if not len(values):
                    continue
                owners, found = [], []
                for level, owner, least in windows(values, at, levels, bands):
                    where, band = member.where(least) if member else np.divmod(np.arange(least.size), bands)
                    owners.append(owner[where])
                    found.append((np.full(len(where), level, np.int32), band.astype(np.int32), least[where, band]))
                owner = np.concatenate(owners)
                if not len(owner):
                    continue
                level, band, minimum = (np.concatenate([f[k] for f in found]) for k in range(3))
                order = np.lexsort((minimum, band, level, owner))
                owner, level, band, minimum = owner[order], level[order], band[order], minimum[order]
                new = np.ones(len(owner), bool)
                new[1:] = (owner[1:] != owner[:-1]) | (level[1:] != level[:-1]) | (minimum[1:] != minimum[:-1]) | (band[1:] != band[:-1])
                owner, level, band, minimum = owner[new], level[new], band[new], minimum[new]
                texts, start = np.unique(owner, return_index=True)
                hits = pa.StructArray.from_arrays([pa.array(level), pa.array(band), pa.array(minimum.view(np.int64))], fields=list(hit_type))
                lists = pa.ListArray.from_arrays(pa.array(np.append(start, len(owner)).astype(np.int32)), hits)
                take = pa.array(first + texts)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take) if member else pa.nulls(len(texts), pa.string()),
                                                  lists], ["row", "text", "hits"])

    return rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, text string, hits array<struct<level:int,band:int,minimum:long>>")


def matches(docs: DataFrame, items: DataFrame, row: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
            item_text_col: str = "text", threshold: float = THRESHOLD, n: int = N, recall: float = RECALL) -> DataFrame:
    """(row, item, share) of every item found in a text; rows that share a value of `row` are each verified on their own."""
    bands = bands_needed(threshold, recall)
    minima = cut_lineage(item_minima(items, item_col, item_text_col, n, bands).distinct())
    # one level per power of two of the longest item, so at most some tens
    levels = sorted(r[0] for r in minima.select("level").distinct().collect()) or [1]
    wanted = None
    if minima.count() <= BROADCAST_ROWS:
        wanted = np.unique(minima.select("minimum").toArrow().column(0).to_numpy()).view(np.uint64)
        wanted.sort()
    made = sketches(docs, row, text_col, n, bands, levels, wanted)
    if wanted is not None:
        made = cut_lineage(made)
    hits = made.select("row", F.explode("hits").alias("hit")).select("row", "hit.*")
    texts = items.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("item_text"))
    candidates = hits.join(minima, ["level", "band", "minimum"]).select("row", "item").distinct()
    pairs = candidates.join(texts, candidates["item"].eqNullSafe(texts["item"])).select(candidates["row"], texts["item"], "item_text")
    # the candidate items of one text are at most the items that share words with it
    listed = pairs.groupBy(F.col("row").alias("key")).agg(F.collect_set(F.struct("item", "item_text")).alias("listed"))
    whole = made.select("row", "text") if wanted is not None else docs.select(F.col(row).alias("row"), F.col(text_col).alias("text"))
    held = whole.join(listed, F.col("row").eqNullSafe(F.col("key"))).select("row", "text", "listed")
    kind, item_kind = made.schema["row"].dataType.simpleString(), texts.schema["item"].dataType.simpleString()

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, ids, shares = [], [], []
            for k, (text, found) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                have = gram_set(text, n)
                for x in found:
                    grams = gram_set(x["item_text"], n)
                    share = len(grams & have) / len(grams) if grams else 0.0
                    if share >= threshold:
                        at.append(k)
                        ids.append(x["item"])
                        shares.append(share)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(ids, batch.schema.field(2).type.value_type.field(0).type),
                                              pa.array(shares, pa.float64())], ["row", "item", "share"])

    return held.mapInArrow(verify, f"row {kind}, item {item_kind}, share double")


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` in which no item was found, with all their columns."""
    key = F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text"))
    found = matches(docs.select(key.alias("key"), F.col(text_col).alias("text")), items, "key").select(F.col("row.id").alias("found_id"),
                                                                                          F.col("row.text").alias("found_text")).distinct()
    same = docs[id_col].eqNullSafe(found["found_id"]) & (F.xxhash64(docs[text_col]) == found["found_text"])
    return docs.join(found, same, "left_anti")
