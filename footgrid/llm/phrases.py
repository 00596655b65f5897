"""Collocations by direct-address tiling of pair counts, phrase by phrase of one more word.

Texts are written once as blocks of word numbers; a block has its own dictionary, so what is shuffled by word is one row per block and
distinct word. Words that come LEAST times or more in their language are ranked by frequency, and blocks get these ranks back. A block's pairs of
neighbours are split into square tiles of TILE ranks: tiles among the HEAD most frequent words are counted in dense arrays, addressed directly by
both ranks, wherever they are full enough; all other tiles hold next to nothing and are counted as one sorted list of coordinates. Spark adds
up the blocks' counts. Pairs that are frequent enough are ranked again and become the left sides of the next size's tiles, whose right sides are
words: a phrase of three words is counted where both of its pairs are frequent, as any frequent one must be.

To learn the new ranks, a block asks for those of its pairs only that pass a bitmap of FILTER_BITS built from the frequent ones; the bitmap
has this size at any corpus and lets some others through, which the join drops.

Counts are of whole corpora and exact; words are told apart by their bytes. A word or pair, however hot, has one row per block in any shuffle,
and sums are combined before it. Ranks come from a range partitioning with offsets, never from one task.

Results: null texts are empty, a null language is `und`; repeated rows count as often as they come; texts without a candidate add to n only;
ties at the cut of the report go by phrase; languages without candidates have no rows; an empty table gives an empty table; columns other than
text and language are not read. A very long text is a run of its own: memory follows the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut_lineage, spent
from . import shingles as S
from .bpe import ascending

LEAST = 10
LONGEST = 3
TOP = 2000
INSIDE = 50                     # percent of a phrase's places that a longer one must hold to replace it
BLOCK_BYTES = 8 << 20
TILE, HEAD = 512, 4096
FULL = 8                        # a tile with at least one pair per FULL cells is counted in a dense array
FILTER_BITS = 1 << 26
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BREAK = np.zeros(256, bool)
_BREAK[[ord(c) for c in ".,;:!?"]] = _BREAK[10:14] = True
_WORD = ~_BREAK
_WORD[[9, 32]] = False


def numbered(texts: pa.Array, langs: list[str]) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """A run of texts as word numbers, -1 between pieces: (numbers, language place of each distinct word, its string, its count).

    `langs` holds one language per text; a word is a string in a language, and places are those of the sorted distinct languages."""
    body, at = S.flat(texts)
    body = _LOWER[body]
    marked = _WORD[body]
    starts, ends, first = S.runs(marked, at)
    offsets = np.concatenate([[0], np.cumsum(ends - starts)])
    every = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(body[marked].tobytes())])
    coded = every.dictionary_encode()
    own = np.searchsorted(np.array(sorted(set(langs)), object), np.array(langs, object)) if langs else np.zeros(0, np.int64)
    lang = np.repeat(own, np.diff(first))
    text = np.repeat(np.arange(len(langs)), np.diff(first))
    size = max(len(coded.dictionary), 1)
    key, number, n = np.unique(lang * size + coded.indices.to_numpy(), return_inverse=True, return_counts=True)
    broken = np.concatenate([[0], np.cumsum(_BREAK[body])])
    # the word goes on with the next one if no break stands between them and both are of one text
    apart = np.flatnonzero((broken[starts[1:]] != broken[ends[:-1]]) | (text[1:] != text[:-1])) + 1
    return np.insert(number.astype(np.int32), np.append(apart, len(number)), -1), key // size, coded.dictionary.take(pa.array(key % size)), n


class Block:
    """Runs of texts under one dictionary, whose numbers go from the most frequent word on."""

    def __init__(self):
        self.bytes, self.runs = 0, []

    def add(self, texts: pa.Array, langs: list[str]) -> None:
        numbers, lang, words, n = numbered(texts, langs)
        names = np.array(sorted(set(langs)), object)
        self.runs.append((numbers, names[lang], words, n))
        self.bytes += texts.nbytes

    def closed(self) -> tuple[np.ndarray, list[str], pa.Array, np.ndarray]:
        """(numbers, language, word and count of each number)."""
        coded = pa.concat_arrays([r[2] for r in self.runs]).dictionary_encode()
        tongue = np.concatenate([r[1] for r in self.runs])
        names, lang = np.unique(tongue.astype(str), return_inverse=True) if len(tongue) else (np.zeros(0, object), np.zeros(0, np.int64))
        size = max(len(coded.dictionary), 1)
        key, number = np.unique(lang * size + coded.indices.to_numpy(), return_inverse=True)
        n = np.bincount(number, np.concatenate([r[3] for r in self.runs]), len(key)).astype(np.int64)
        order = np.argsort(-n, kind="stable")
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order))
        number, key = place[number], key[order]
        parts, begin = [], 0
        for numbers, _, words, _ in self.runs:
            own = np.append(number[begin: begin + len(words)], -1).astype(np.int32)          # place -1 stands for -1
            parts.append(own[numbers])
            begin += len(words)
        return np.concatenate(parts), names[key // size].tolist(), coded.dictionary.take(pa.array(key % size)), n[order]


def blocks(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One written table of blocks (block, numbers) and of their words (block, number, lang, word, n). Numbers are packed 32-bit values."""
    rows = docs.select(F.coalesce(lang_col, F.lit("und")).cast("string").alias("lang"), F.coalesce(text_col, F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, block = TaskContext.get().partitionId() << 32, Block()

        def out():
            nonlocal name, block
            numbers, lang, words, n = block.closed()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([pa.compress(numbers.tobytes(), "zstd", asbytes=True)], pa.binary()), pa.array([len(numbers)], pa.int32()),
                                              pa.nulls(1, pa.string()), pa.nulls(1, pa.string()), pa.nulls(1, pa.int64())], names)
            words = words.cast(pa.string())
            for k in range(0, len(n), 50_000):
                part = slice(k, k + 50_000)
                m = len(n[part])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(m, name)), pa.nulls(m, pa.binary()), pa.array(np.arange(k, k + m, dtype=np.int32)),
                                                  pa.array(lang[part], pa.string()), words.slice(k, m), pa.array(n[part])], names)
            name, block = name + 1, Block()

        names = ["block", "numbers", "number", "lang", "word", "n"]
        for batch in batches:
            for first, part in S.chunks(batch.column(1)):
                if block.runs and block.bytes + part.nbytes > BLOCK_BYTES:
                    yield from out()
                block.add(part, batch.column(0).slice(first, len(part)).to_pylist())
        if block.runs:
            yield from out()

    return cut_lineage(rows.mapInArrow(run, "block long, numbers binary, number int, lang string, word string, n long"))


def ranked(rows: DataFrame, *order: Column) -> DataFrame:
    """`rows`, written, with `id`: 0, 1, 2 ... in this order. Ranges of the order are sorted each on its own; their sizes make the offsets."""
    bits = 33                       # of the row number within a partition, in monotonically_increasing_id
    placed = cut_lineage(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", bits).cast("int")
    sizes = sorted((r["part"], r["n"]) for r in placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())   # one row per partition
    begin, listed = 0, []
    for p, n in sizes:
        listed.append((p, begin))
        begin += n
    if begin >= 1 << 31:
        raise ValueError(f"{begin} ranks do not fit in 32 bits; raise `least`.")
    offsets = rows.sparkSession.createDataFrame(listed, "_part int, _begin long")
    own = (F.col("_begin") + F.col("_at").bitwiseAND(F.lit((1 << bits) - 1))).cast("int")
    out = placed.withColumn("_part", part).join(offsets, "_part").withColumn("id", own).drop("_at", "_part", "_begin")
    out._step = placed._step
    return out


def counted(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs (left rank << 32 | right rank) and their counts, tile by tile."""
    head = (left < HEAD) & (right < HEAD)
    keys, counts = [], []
    side = HEAD // TILE
    l, r = left[head], right[head]
    tile = (l // TILE * side + r // TILE).astype(np.uint8)
    order = np.argsort(tile, kind="stable")
    l, r = l[order], r[order]
    cuts = np.concatenate([[0], np.cumsum(np.bincount(tile, minlength=side * side))])
    sparse = [(left[~head] << 32) | right[~head]]
    for t in range(side * side):
        a, b = int(cuts[t]), int(cuts[t + 1])
        if (b - a) * FULL < TILE * TILE:
            sparse.append((l[a:b] << 32) | r[a:b])
            continue
        cells = np.bincount(l[a:b] % TILE * TILE + r[a:b] % TILE, minlength=TILE * TILE)
        some = np.flatnonzero(cells)
        keys.append(((some // TILE + t // side * TILE) << 32) | (some % TILE + t % side * TILE))
        counts.append(cells[some])
    key, n = np.unique(np.concatenate(sparse), return_counts=True)
    return np.concatenate([*keys, key]), np.concatenate([*counts, n])


def spots(key: np.ndarray) -> np.ndarray:
    """Place of each pair in the bitmap of frequent pairs; the same sum as in `filter_of`."""
    return ((key >> 32) * 1_000_003 + (key & 0xFFFFFFFF) * 7919) & (FILTER_BITS - 1)


def filter_of(frequent: DataFrame) -> np.ndarray:
    """The bitmap of frequent pairs (left, right): FILTER_BITS / 8 bytes come to the driver at most."""
    spot = (F.col("left").cast("long") * 1_000_003 + F.col("right").cast("long") * 7919).bitwiseAND(F.lit(FILTER_BITS - 1)) + 1
    rows = frequent.select(spot.alias("spot")).groupBy(F.bitmap_bucket_number("spot").alias("k")) \
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("spot")).alias("bits")).collect()
    out = np.zeros((FILTER_BITS // 32768, 4096), np.uint8)
    for r in rows:
        out[r["k"] - 1] = np.frombuffer(r["bits"], np.uint8)
    return out.ravel()


class Ranks:
    """A block's sequence of ranks of each size: at every place the rank of the phrase that begins there, or -1."""

    def __init__(self, block: pa.Table, asked: pa.Table):
        self.name = block.column("block")[0].as_py()
        size = block.column("number")[0].as_py()
        numbers = np.frombuffer(pa.decompress(block.column("numbers")[0].as_py(), 4 * size, "zstd", asbytes=True), np.int32) if size else np.zeros(0, np.int32)
        level, what, rank = (asked.column(c).to_numpy() for c in ("size", "what", "id"))
        of = np.full(int(numbers.max(initial=-1)) + 2, -1, np.int64)
        of[what[level == 1]] = rank[level == 1]
        of[-1] = -1
        self.words = of[numbers]
        self.last, self.length = self.words, 1
        for k in range(2, int(level.max(initial=1)) + 1):
            order = np.argsort(what[level == k])
            keys, ids = what[level == k][order], rank[level == k][order]
            at, key = self.pairs()
            place = np.minimum(np.searchsorted(keys, key), max(len(keys) - 1, 0))
            found = keys[place] == key if len(keys) else np.zeros(len(key), bool)
            here = np.full(len(self.words), -1, np.int64)
            here[at[found]] = ids[place[found]]
            self.last, self.length = here, k

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Places of phrases one word longer, both of whose longest parts have a rank; and (rank of the first part << 32 | last word)."""
        n, k = len(self.words), self.length
        at = np.flatnonzero((self.last[: n - k] >= 0) & (self.last[1: n - k + 1] >= 0)) if n > k else np.zeros(0, np.int64)
        return at, (self.last[at] << 32) | self.words[at + k]


def mine(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, longest: int = LONGEST) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(words: id, lang, word, f; phrases: words array<int>, f, of one word up; totals: lang, n), all counted `least` times or more."""
    spark = docs.sparkSession
    table = blocks(docs, text_col, lang_col)
    texts = table.where("numbers is not null").select("block", "numbers", "number")
    said = table.where("numbers is null").select("block", "number", "lang", "word", "n")
    sums = cut_lineage(said.groupBy("lang", "word").agg(F.sum("n").alias("f")))
    totals = sums.groupBy("lang").agg(F.sum("f").alias("n"))
    vocabulary = ranked(sums.where(F.col("f") >= least), F.desc("f"), F.asc("lang"), F.asc("word"))
    # a word has one row per block here, so the join's hottest key is as large as the number of blocks
    known = cut_lineage(said.select("block", "number", "lang", "word").join(vocabulary.select("lang", "word", "id"), ["lang", "word"])
                        .select("block", F.lit(1).alias("size"), F.col("number").cast("long").alias("what"), "id"))
    levels = [vocabulary.select(F.array("id").alias("words"), "f", "id")]
    for size in range(2, longest + 1):
        asked = known
        texts_of = lambda: texts.groupBy("block").cogroup(asked.groupBy("block"))

        def count(block: pa.Table, given: pa.Table) -> pa.Table:
            at, key = Ranks(block, given).pairs()
            key, n = counted(key >> 32, key & 0xFFFFFFFF)
            return pa.table({"left": pa.array((key >> 32).astype(np.int32)), "right": pa.array((key & 0xFFFFFFFF).astype(np.int32)), "n": pa.array(n.astype(np.int64))})

        summed = texts_of().applyInArrow(count, "left int, right int, n long").groupBy("left", "right").agg(F.sum("n").alias("f"))
        found = ranked(summed.where(F.col("f") >= least), F.desc("f"), F.asc("left"), F.asc("right"))
        before = levels[-1].select(F.col("id").alias("left"), F.col("words").alias("begun"))
        levels.append(found.join(before, "left").select(F.concat("begun", F.array("right")).alias("words"), "f", "id"))
        if size == longest:
            break
        bitmap = spark.sparkContext.broadcast(filter_of(found))

        def asks(block: pa.Table, given: pa.Table) -> pa.Table:
            ranks = Ranks(block, given)
            key = ascending(ranks.pairs()[1])
            spot = spots(key)
            key = key[(bitmap.value[spot >> 3] >> (spot & 7).astype(np.uint8)) & 1 == 1]
            return pa.table({"block": pa.array(np.full(len(key), ranks.name)), "left": pa.array((key >> 32).astype(np.int32)),
                             "right": pa.array((key & 0xFFFFFFFF).astype(np.int32))})

        answered = texts_of().applyInArrow(asks, "block long, left int, right int").join(found.select("left", "right", "id"), ["left", "right"]) \
            .select("block", F.lit(size).alias("size"), F.shiftleft(F.col("left").cast("long"), 32).bitwiseOR(F.col("right").cast("long")).alias("what"), "id")
        known = known.unionByName(cut_lineage(answered))
    phrases = cut_lineage(levels[0].select("words", "f"))
    for level in levels[1:]:
        phrases = phrases.unionByName(cut_lineage(level.select("words", "f")))
    spent(table)
    return vocabulary.select("id", "lang", "word", "f"), phrases, totals


#: floor(1,000,000 a^2 / (l r)) in whole numbers of up to 38 digits; counts have up to 15.
CUT_SCORE = "1000000BD * cast(a as decimal(15,0)) * cast(a as decimal(15,0)) div (cast(l as decimal(15,0)) * cast(r as decimal(15,0)))"


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, longest: int = LONGEST, top: int = TOP,
                 inside: int = INSIDE) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first `top` phrases of 2 to `longest` words by score, count and phrase."""
    vocabulary, phrases, totals = mine(docs, text_col, lang_col, least, longest)
    size = F.size("words")
    cuts = phrases.where(size > 1).select("words", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    part = lambda name, f: phrases.select(F.col("words").alias(name), F.col("f").alias(f))
    scored = cuts.withColumn("begin", F.slice("words", F.lit(1), F.col("k"))).withColumn("rest", F.slice("words", F.col("k") + 1, size - F.col("k"))) \
        .join(part("begin", "l"), "begin").join(part("rest", "r"), "rest").withColumn("score", F.expr(CUT_SCORE))
    lowest = scored.groupBy("words").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("low")).select("words", "low.*")
    # every shorter phrase inside a longer one, with the count of the most frequent longer one
    at = F.sequence(F.lit(1), size)
    pieces = F.flatten(F.transform(at, lambda i: F.transform(F.filter(at, lambda m: (m > 1) & (m < size) & (i + m - 1 <= size)), lambda m: F.slice("words", i, m))))
    within = phrases.where(size > 2).select(F.explode(pieces).alias("words"), F.col("f").alias("longer")).groupBy("words").agg(F.max("longer").alias("longer"))
    kept = lowest.join(within, "words", "left").where(F.col("longer").isNull() | (100 * F.col("longer") < inside * F.col("a")))
    told = kept.join(vocabulary.select(F.col("id").alias("first"), "lang"), F.element_at("words", 1) == F.col("first"))
    own = Window.partitionBy("lang")
    best = F.desc("score"), F.desc("a")
    # Spark keeps the first `top` of every partition before it shuffles by language; what ties with the last one stays until phrases are spelt out
    near = told.withColumn("place", F.rank().over(own.orderBy(*best))).where(F.col("place") <= top).drop("place", "first")
    spelt = near.select("words", F.posexplode("words").alias("i", "id")).join(vocabulary.select("id", "word"), "id").groupBy("words") \
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    listed = near.join(spelt, "words").withColumn("rank", F.row_number().over(own.orderBy(*best, "phrase")).cast("long")).where(F.col("rank") <= top)
    return listed.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
