"""N-gram Jaccard join by minhash banding, verified on the full n-gram sets.

1. Every text gets its distinct word n-grams, a fingerprint of that set and BANDS keys of ROWS minima each. Texts of equal sets are
   one class from here on, so copies never meet each other.
2. Band keys are shuffled. A bucket does not emit its pairs: each class in it links to the smallest one, so a bucket of any size makes
   as many links as it has classes, and connected components of these links hold all pairs that share a band.
3. The n-gram sets of a component's classes meet in blocks: a component of up to BLOCK classes is compared in one task, a larger one is
   split by hash and each pair of blocks is a task of its own, which counts common n-grams of all its pairs at once. Every pair of a
   component is compared, also those that share no band themselves. What leaves a task is one row per class (number of links,
   smallest class it hangs together with), never pairs.

The number of links of a class needs all pairs of different texts of its component, so a group of near copies costs the square of its
number of *different* texts in arithmetic (blocks of matrix products), though not in rows: BLOCK classes share one copy of a set.

Results: one row per row of the input, repeated rows too, with `class_id`, the smallest id it is linked to directly or through
others; `n_links`, the number of other n-gram sets at least `similarity` alike; `copies`, the number of rows with equal set.
Null and wordless texts have no n-grams: they are alone, with 0 links. A text of fewer than n words is one n-gram. Rows
without id count, but only give their class an id if no other row does. An empty table gives an empty table; other columns are not
read by `groups` and are returned untouched by `keep_one`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..operators.components import connected
from ..session import cut_lineage
from ..skew import attach
from . import minhash, shingles as S

N = 5
SIMILARITY = 0.8
RECALL = 0.997
ROWS = 7
BLOCK = 256
SHARD = 1024


def signatures(docs: DataFrame, id_col: str, text_col: str, n: int, count: int) -> DataFrame:
    """(id, text_hash, k1, k2, bands) per row; k1 and k2 are null for a text without n-grams."""
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, part in S.chunks(batch.column(2)):
                values, at = S.distinct(*S.shingles(part, n))
                sizes = np.diff(at)
                has = np.flatnonzero(sizes)
                keys = np.zeros((2, len(has)), np.uint64)
                least = np.zeros((0, count * ROWS), np.uint64)
                if len(has):
                    starts = at[:-1][has]
                    with np.errstate(over="ignore"):
                        keys[0] = np.add.reduceat(values, starts)
                        keys[1] = np.add.reduceat(S.mix(values), starts) + S.mix(sizes[has].astype(np.uint64))
                    least = minhash.minima(values, starts, count * ROWS)
                made = minhash.bands(least, count, ROWS)
                back = np.full(len(sizes), -1)
                back[has] = np.arange(len(has))
                pick = pa.array(back, mask=back < 0)
                lists = pa.FixedSizeListArray.from_arrays(pa.array(made.ravel().view(np.int64)), count).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(part)), batch.column(1).slice(first, len(part)),
                     *(pa.array(k.view(np.int64)).take(pick) for k in keys), lists.take(pick)], ["id", "text_hash", "k1", "k2", "bands"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, text_hash long, k1 long, k2 long, bands array<long>")


def common(sets: list[np.ndarray], slab: int = 4096) -> np.ndarray:
    """Number of common values of each pair of sets (each without repeats), by products of slabs of the incidence matrix."""
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.concatenate([[True], flat[1:] != flat[:-1]])
    column = np.cumsum(new) - 1
    shared = np.bincount(column)[column] > 1
    column, owner = column[shared], owner[shared]
    out = np.zeros((len(sets), len(sets)), np.float32)
    if not len(column):
        return out
    column = np.cumsum(np.concatenate([[0], column[1:] != column[:-1]]))
    for at in range(0, int(column[-1]) + 1, slab):
        lo, hi = np.searchsorted(column, [at, at + slab])
        x = np.zeros((len(sets), min(slab, int(column[-1]) + 1 - at)), np.float32)
        x[owner[lo:hi], column[lo:hi] - at] = 1
        out += x @ x.T
    return out


def compare(nodes: np.ndarray, sets: list[np.ndarray], side: np.ndarray | None, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Links of each class within a block (or, with `side`, across two), and the smallest class it hangs together with."""
    both, sizes = common(sets), np.array([len(s) for s in sets], np.float32)
    linked = both >= np.float32(similarity) * (sizes[:, None] + sizes[None, :] - both) - 1e-4
    np.fill_diagonal(linked, False)
    if side is not None:
        linked &= side[:, None] != side[None, :]
    low = nodes.copy()
    while True:
        near = np.where(linked, low[None, :], np.iinfo(np.int64).max).min(axis=1)
        lower = np.minimum(low, near)
        if (lower == low).all():
            return linked.sum(axis=1), low
        low = lower


def linked_classes(members: DataFrame, docs: DataFrame, id_col: str, text_col: str, n: int, similarity: float) -> DataFrame:
    """(node, low, n_links, split) of the classes of all components; one row per class and block pair."""
    sizes = members.groupBy("root").agg(F.count(F.lit(1)).alias("size"))
    total = members.count()
    shards = max(1, -(-total // SHARD))
    placed = members.join(sizes, "root").withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
    texts = docs.select(F.col(id_col).alias("own_id"), F.xxhash64(text_col).alias("own_hash"), F.col(text_col).alias("text"))
    # the members are a fixed share of all texts, so this is a shuffle of both sides at every size
    found = placed.hint("merge").join(texts, placed["id"].eqNullSafe(texts["own_id"]) & (placed["text_hash"] == texts["own_hash"])) \
        .select("node", "root", "blocks", "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, part in S.chunks(batch.column(3)):
                values, at = S.distinct(*S.shingles(part, n))
                raw = pa.array([values[a:b].tobytes() for a, b in zip(at[:-1], at[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(first, len(part)) for k in range(3)), raw], ["node", "root", "blocks", "grams"])

    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    spread = found.mapInArrow(sets, "node long, root long, blocks int, grams binary").withColumn("own", own) \
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    spread = spread.select(
        "node", "root", "blocks", "grams", "own", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"),
        F.when(F.col("blocks") > 1, F.col("root")).otherwise(F.pmod(F.xxhash64("root"), F.lit(shards))).alias("place"))

    def block(group: pa.Table) -> pa.Table:
        node, root, own, a, b = (group.column(c).to_numpy() for c in ("node", "root", "own", "a", "b"))
        split = group.column("blocks").to_numpy() > 1
        grams = [np.frombuffer(g, np.uint64) for g in group.column("grams").to_pylist()]
        order = np.lexsort((node, root))
        cuts = np.flatnonzero(np.diff(root[order])) + 1
        out: list[list[np.ndarray]] = [[], [], [], []]
        for part in np.split(order, cuts):
            part = part[np.concatenate([[True], np.diff(node[part]) != 0])]          # repeated rows of a class count once
            side = own[part] if a[part[0]] != b[part[0]] else None
            links, low = compare(node[part], [grams[i] for i in part], side, similarity)
            for to, values in zip(out, (node[part], low, links.astype(np.int64), split[part])):
                to.append(values)
        return pa.table({k: np.concatenate(v) for k, v in zip(("node", "low", "n_links", "split"), out)})

    return spread.groupBy("place", "blocks", "a", "b").applyInArrow(block, "node long, low long, n_links long, split boolean")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, n: int = N,
           recall: float = RECALL) -> DataFrame:
    """(id, class_id, n_links, copies) for every row of `docs`; rows of equal id should not have different texts of equal hash."""
    count = minhash.bands_for(similarity, ROWS, recall)
    rows = cut_lineage(signatures(docs, id_col, text_col, n, count))
    kept = F.struct(F.col("id").isNull().alias("no_id"), "id", "text_hash")
    classes = rows.where("k1 is not null").groupBy("k1", "k2").agg(F.min(kept).alias("kept"), F.count(F.lit(1)).alias("copies"),
                                                                   F.any_value("bands").alias("bands"))
    classes = cut_lineage(classes.select(F.monotonically_increasing_id().alias("node"), "k1", "k2", "kept.id", "kept.text_hash", "copies", "bands"))
    keyed = classes.select("node", F.explode("bands").alias("key"))
    first = keyed.groupBy("key").agg(F.min("node").alias("u"), F.count(F.lit(1)).alias("size")).where("size > 1").select("key", "u")
    links = attach(keyed, first, ["key"], ["node"]).where("node != u").select("u", F.col("node").alias("v"))
    members = cut_lineage(classes.join(connected(links, []), "node").select("node", "root", "id", "text_hash"))
    compared = cut_lineage(linked_classes(members, docs, id_col, text_col, n, similarity))
    # components that were split over block pairs still have to be put together
    across = compared.where("split and node != low")
    roots = compared.where("not split").select("node", F.col("low").alias("root"))
    if not across.isEmpty():
        joined = connected(across.select(F.col("low").alias("u"), F.col("node").alias("v")), [])
        alone = compared.where("split").select("node").distinct().join(joined, "node", "left_anti")
        roots = roots.union(joined.select("node", "root")).union(alone.select("node", F.col("node").alias("root")))
    found = roots.join(compared.groupBy("node").agg(F.sum("n_links").alias("n_links")), "node").where("n_links > 0")
    least = found.join(classes.select("node", "id"), "node").groupBy("root").agg(F.min("id").alias("class_id"))
    grouped = attach(found, least, ["root"], ["node"]).select("node", "class_id", "n_links")
    # only classes with links or copies say more about a row than its own id does
    told = classes.select("node", "k1", "k2", "id", "copies").join(grouped, "node", "left").where("copies > 1 or n_links > 0") \
        .select("k1", "k2", F.coalesce("class_id", "id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "copies")
    return attach(rows.select("id", "text_hash", "k1", "k2"), told, ["k1", "k2"], ["id", "text_hash"], "left").select(
        "id", F.coalesce("class_id", "id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("copies", F.lit(1)).cast("long").alias("copies"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The row with the smallest id of each group of near copies, with all its columns."""
    from .exact import numbered
    rows, row = numbered(docs, ["class_id", "n_links", "copies", "id"])
    grouped = groups(rows, row, text_col).join(rows.select(F.col(row).alias("id"), F.col(id_col).alias("own")), "id")
    best = F.min(F.struct(F.col("own").isNull().alias("no_id"), "own", "id"))
    kept = grouped.groupBy("class_id").agg(best.alias("best")).select(F.col("best.id").alias(row))
    return rows.join(kept, row, "left_semi").drop(row)
