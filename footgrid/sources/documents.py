"""JSON documents larger than a task's memory, read in pieces.

A text file is read by ranges and cut after every ``}``. Whether a cut lies inside a string, and how deep, follows from what stands before
it: counts run along each range, the ranges' totals (one row each) along the document. What lies between two cuts at one depth is put
together again; nothing holds a document whole."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..session import cut_lineage, spent
from ..skew import attach

PIECES_PER_RANGE = 1 << 15


def pieces(spark: SparkSession, path: str, doc: Column) -> DataFrame:
    """``(doc, file, block, size, place, piece)``: text of the files between one ``}`` and the next, without it. Files of one ``doc``
    follow each other by name, ``block`` is where the part of its file begins that a task reads in one go."""
    return spark.read.option("lineSep", "}").text(path).select(
        doc.alias("doc"), F.input_file_name().alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.col("_metadata.file_size").alias("size"), F.monotonically_increasing_id().alias("place"), F.col("value").alias("piece"))


def _brackets(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per text its quotes (escaped ones not counted), the brackets opened less those closed outside strings if it begins outside one, the
    same if it begins inside one, and its bytes. The ``}`` behind it counts in."""
    _, ends, data = text.buffers()
    at = np.frombuffer(ends, np.int64 if pa.types.is_large_string(text.type) else np.int32)[text.offset:text.offset + len(text) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0]:at[-1]] if data else np.zeros(0, np.uint8)
    at = (at - at[0]).astype(np.int64)
    quote = raw == 34
    back = np.flatnonzero(raw == 92)
    if len(back):   # the character after an odd run of backslashes is escaped; a run ends with its text
        begins = np.zeros(len(raw) + 1, bool)
        begins[at] = True
        first = np.ones(len(back), bool)
        first[1:] = (back[1:] != back[:-1] + 1) | begins[back[1:]]
        start = np.flatnonzero(first)
        length = np.diff(np.append(start, len(back)))
        after = back[start] + length
        quote[after[(length % 2 == 1) & ~begins[after]]] = False
    sums = lambda x: np.concatenate(([0], np.cumsum(x, dtype=np.int32)))
    seen = sums(quote)
    odd = ((seen[:-1] - np.repeat(seen[at[:-1]], np.diff(at))) & 1).astype(bool)
    step = ((raw == 91) | (raw == 123)).astype(np.int8) - ((raw == 93) | (raw == 125))
    n = np.diff(seen[at]).astype(np.int64)
    out, inside = (np.diff(sums(step * side)[at]).astype(np.int64) for side in (~odd, odd))
    return n, out - (1 - n % 2), inside - n % 2, np.diff(at)


def _mark(batches: Iterator[pa.RecordBatch], run: int) -> Iterator[pa.RecordBatch]:
    """See ``_marked``; rows of a range come one after the other, in one task."""
    last, carry = None, (0, 0, 0, 0, 0)
    for batch in batches:
        if not batch.num_rows:
            continue
        file, block, place = batch.column("file"), batch.column("block").to_numpy(), batch.column("place").to_numpy()
        n, out, inside, size = _brackets(batch.column("piece"))
        group = place // run
        new = np.ones(len(block), bool)
        new[1:] = (block[1:] != block[:-1]) | (group[1:] != group[:-1]) | pa.compute.not_equal(file[1:], file[:-1]).to_numpy(zero_copy_only=False)
        new[0] = (file[0].as_py(), block[0], group[0]) != last
        begin = np.maximum.accumulate(np.where(new, np.arange(len(block)), 0))
        old = ~np.logical_or.accumulate(new)   # rows that go on with the range of the batch before
        total = lambda x, c: (lambda s: s - (s - x)[begin] + np.where(old, c, 0))(np.cumsum(x))
        quoted = total(n, carry[0]) % 2
        was = (quoted + n) % 2
        a, b = total(np.where(was, inside, out), carry[1]), total(np.where(was, out, inside), carry[2])
        size = total(size + 1, carry[3])
        of = np.where(old, carry[4], place[begin])
        last, carry = (file[-1].as_py(), block[-1], group[-1]), (quoted[-1], a[-1], b[-1], size[-1], of[-1])
        yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, (of, quoted, a, b, size))],
                                         names=[*batch.schema.names, "range", "quoted", "out", "in", "bytes"])


def _marked(parts: DataFrame, run: int) -> DataFrame:
    """Per piece the number of its ``range`` (of ``run`` pieces at most) and, supposed that this begins outside a string: is the piece's end inside one (``quoted``),
    and the depth up to there (``out``; ``in`` if the range begins inside a string)."""
    return parts.mapInArrow(partial(_mark, run=run), f"{', '.join(f'{n} {t}' for n, t in parts.dtypes)}, range long, quoted long, out long, in long, bytes long")


def _ranges(marked: DataFrame) -> DataFrame:
    """Ranges with the number of their document and their own in it (``id``, ``nth``), and the state they begin with: inside a string or not,
    depth. ``open``: no ``}`` stands behind the last piece (``final``), as the file ends there (3 bytes may be a mark in front; of a
    compressed file, whose size says nothing, the last piece counts as open)."""
    b = marked.groupBy("range").agg(*[F.first(c).alias(c) for c in ("doc", "file", "block", "size")], F.max("place").alias("final"),
                                    F.max_by(F.struct("quoted", "out", "in", "bytes"), "place").alias("t")).select("*", "t.*")
    file, doc = Window.partitionBy("file"), Window.partitionBy("doc")
    whole = F.sum("bytes").over(file)
    b = b.withColumn("open", (F.struct("block", "range") == F.max(F.struct("block", "range")).over(file)) & ~((whole == F.col("size")) | (whole == F.col("size") - 3)))
    add = lambda side: (F.col("open") & (F.col("quoted") == side)).cast("int")
    order = doc.orderBy("file", "block", "range")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    b = b.withColumn("inside", F.coalesce(F.sum("quoted").over(before), F.lit(0)) % 2)
    depth = F.sum(F.when(F.col("inside") == 0, F.col("out") + add(0)).otherwise(F.col("in") + add(1))).over(before)
    return b.select("range", "doc", F.min("range").over(doc).alias("id"), F.row_number().over(order).alias("nth"), "final", "open", "inside",
                    F.coalesce(depth, F.lit(0)).alias("depth"))


def segments(parts: DataFrame, level: int, read: Callable[[DataFrame], DataFrame], below: bool = False,
             run: int = PIECES_PER_RANGE) -> DataFrame:
    """``read`` of ``(doc, seg, text, first, last)``, as a table: documents cut behind each object that ends at depth ``level`` (1: an
    element of the outermost array), with ``below`` behind those of less depth too. The texts of a document, by ``seg``, put together are
    the document; the last one is there even if it is empty. Where a document is no valid JSON cuts may be anywhere."""
    marked = cut_lineage(_marked(parts, run))
    begun = cut_lineage(_ranges(marked))
    closed = (F.col("place") < F.col("final")) | ~F.col("open")
    depth = F.col("depth") + F.when(F.col("inside") == 0, F.col("out")).otherwise(F.col("in"))
    cut = closed & (F.col("quoted") == F.col("inside")) & (depth <= level if below else depth == level)
    state = ["range", "id", "nth", "final", "open", "inside", "depth"]
    counted = attach(marked.select("range", "place", "quoted", "out", "in"), begun.select(state), ["range"], ["place"]).groupBy("id", "nth", "range").agg(
        F.sum(cut.cast("int")).alias("n"))
    doc = Window.partitionBy("id")
    before = doc.orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    bases = cut_lineage(counted.select("id", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"), F.sum("n").over(doc).alias("cuts")))
    here = Window.partitionBy("range").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    placed = attach(marked.select("range", "place", "piece", "quoted", "out", "in"), begun.select(state).join(bases.select("range", "base"), "range"),
                    ["range"], ["place"])
    cuts = placed.select("range", "id", "nth", "place", "base", cut.cast("int").alias("cut"), F.concat("piece", F.when(closed, "}").otherwise("")).alias("t"))
    rows = cuts.select("id", (F.col("base") + F.coalesce(F.sum("cut").over(here), F.lit(0))).alias("seg"), "nth", "place", "t")
    ends = bases.groupBy("id").agg(F.max("cuts").alias("seg")).select("id", "seg", F.lit((1 << 31) - 1).alias("nth"), F.lit(0).cast("long").alias("place"), F.lit("").alias("t"))
    ordered = F.array_sort(F.collect_list(F.struct("nth", "place", "t")))
    whole = rows.unionByName(ends).groupBy("id", "seg").agg(F.array_join(F.transform(ordered, lambda x: x["t"]), "").alias("text"))
    docs = begun.where("range = id").select("id", "doc").join(bases.where("range = id").select("id", "cuts"), "id")
    out = cut_lineage(read(attach(whole, docs, ["id"], ["seg"]).select(
        "doc", "seg", "text", (F.col("seg") == 0).alias("first"), (F.col("seg") == F.col("cuts")).alias("last"))))
    spent(marked, begun, bases)
    return out
