"""Alignment of two tokenizers through inverted pair bitmaps.

A byte-level BPE tokenizer (A) and a piece tokenizer with byte fallback (B) cut the same bytes, a space and the text. Token occurrences
whose byte ranges overlap are linked; offsets where both cut close a group. Every stretch between neighbouring cuts of either side is
exactly one link, so the links of a text are read off the merged cuts.

Texts are numbered within blocks of BLOCK_ROWS. The index has, per pair of ids and block, a compressed bitmap of the block's texts that hold
the pair, and multiplicity planes: plane k holds the texts in whose further links of the pair bit k is set. The bitmaps of the runs of a
block are OR-merged; blocks are disjoint ranges of texts, so a pair's popcounts add up over them: of the text bitmaps to its document count,
and with the planes weighted by their powers of two to its link count. Each B id's highest link count is found per pair, and the postings carry
count and mark back to the texts of their block, which add them up.

A container is a sorted list of 16-bit numbers, or beyond DENSE of them a plain bitmap. Shuffles carry containers, never a row per text and
pair; look-ups by pair are salted, since a frequent pair has a posting in every block.

Results: texts that are null, empty, or whose tokens' bytes on either side differ from space and text have no tokens: counts 0 and an empty
digest. Repeated rows and rows with equal or null ids are texts of their own, told apart by their numbers; ties for a B id's highest count all count;
an empty table gives an empty table; other columns are not read. A very long text is a run of its own: memory follows the longest text.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut_lineage
from ..skew import attach
from .bpe import WORDS, ascending, byte_letters
from .shingles import chunks

BLOCK_ROWS = 16_384
BLOCK_POSTINGS = 3_000_000
BITMAP_BYTES = BLOCK_ROWS // 8
DENSE = BITMAP_BYTES // 2                       # from here on a bitmap is no longer than the list
LONG = 400                      # characters of a run without or of white space, from which on the quick encoder would take quadratic time


class Spelling:
    """The bytes of every token id, laid out one after the other, and each id's decimal digits with room for a separator."""

    def __init__(self, tokens: list[bytes]):
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.body = np.frombuffer(b"".join(tokens) or b"\0", np.uint8)
        width = len(str(len(tokens))) + 1
        self.digits = np.frombuffer(b"".join(str(i).encode().ljust(width, b"\0") for i in range(len(tokens))), np.uint8).reshape(-1, width)
        self.written = np.array([len(str(i)) for i in range(len(tokens))])

    def ends(self, ids: np.ndarray) -> np.ndarray:
        return np.cumsum(self.size[ids])

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        size = self.size[ids]
        stop = np.cumsum(size)
        return self.body[np.repeat(self.start[ids] - (stop - size), size) + np.arange(int(stop[-1]) if len(stop) else 0)]


class Tokenizers:
    """Both tokenizers; special tokens' strings inside texts are plain text."""

    def __init__(self, byte_json: str, piece_model: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"        # the task's core does the work
        import sentencepiece
        from tokenizers import Tokenizer
        self.a = Tokenizer.from_str(byte_json)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_proto=piece_model)
        spec = json.loads(byte_json)
        letter = {c: i for i, c in enumerate(byte_letters())}
        spelt = {i: bytes(letter[c] for c in token) for token, i in spec["model"]["vocab"].items()}
        spelt.update((t["id"], t["content"].encode()) for t in spec["added_tokens"])
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.of_a = Spelling([spelt.get(i, b"") for i in range(1 + max(spelt))])
        self.of_b = Spelling([bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)])

        self.quick = self._rank_encoder(spec, spelt)
        self.odd = re.compile(f"[{_changed()}]")
        self.blank = re.compile(rf"\s{{{LONG}}}")

    @staticmethod
    def _rank_encoder(spec: dict, spelt: dict[int, bytes]):
        """The same vocabulary by ranks, where the merges make their tokens in the order of their ids; else None."""
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        made = [vocab[m.replace(" ", "") if isinstance(m, str) else m[0] + m[1]] for m in merges]
        special = {t["id"] for t in spec["added_tokens"]}
        if any(x >= y for x, y in zip(made, made[1:])) or made and min(made) < 256:
            return None
        import tiktoken
        return tiktoken.Encoding("ranks", pat_str=WORDS, mergeable_ranks={t: i for i, t in spelt.items() if i not in special}, special_tokens={})

    def plain(self, text: str) -> bool:
        """Whether the quick encoder gives the same ids as the tokenizer's library, and soon: no character on whose kind they may disagree, no very long run."""
        if self.quick is None or not text.isascii() and self.odd.search(text):
            return False
        words = text.split()
        spare = len(text) - sum(map(len, words)) - len(words)
        return max(map(len, words), default=0) < LONG and (spare < LONG or not self.blank.search(text))

    def ids(self, texts: list[str]) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
        """(ids of all texts one after the other, number of each text) by A and by B."""
        by_a = [self.quick.encode_ordinary(" " + t) if self.plain(t) else None for t in texts]
        rest = [k for k, x in enumerate(by_a) if x is None]
        for k, e in zip(rest, self.a.encode_batch([" " + texts[k] for k in rest], add_special_tokens=False)):
            by_a[k] = e.ids
        return _flat(by_a), _flat(self.b.encode(texts, num_threads=1))


def _changed() -> str:
    """Ranges of characters whose kind (letter, number, white space or other) is not the same in an old and a recent edition of Unicode."""
    old, kind = unicodedata.ucd_3_2_0.category, lambda c: c[0] if c[0] in "LNZ" else "" if c != "Cn" else "new"
    wrong = np.array([kind(old(c)) != kind(unicodedata.category(c)) or old(c) == "Cn" for c in map(chr, range(0x110000))])
    wrong[[*range(0x1C, 0x20), 0x85]] = True                 # white space to some
    edge = np.flatnonzero(np.diff(np.concatenate([[0], wrong.astype(np.int8), [0]])))
    return "".join(f"\\U{a:08x}-\\U{b - 1:08x}" for a, b in zip(edge[0::2].tolist(), edge[1::2].tolist()))


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    parts = [np.array(x, np.int64) for x in lists]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64), np.array([len(x) for x in lists], np.int64)


@lru_cache(maxsize=2)
def tokenizers(byte_json: str, piece_model: bytes) -> Tokenizers:
    """Kept by each Python worker for its later tasks."""
    return Tokenizers(byte_json, piece_model)


class Aligned:
    """Links of a run of texts. `link_text`, `link_a`, `link_b`: text number and ids of each link; other arrays hold one value per text."""

    def __init__(self, t: Tokenizers, texts: list[str | None]):
        n = len(texts)
        used = np.array([i for i, x in enumerate(texts) if x], np.int64)
        (a, count_a), (b, count_b) = t.ids([texts[i] for i in used])
        said = [b" " + texts[i].encode() for i in used]
        length = np.array([len(x) for x in said], np.int64)
        wrong = ~((_sums(t.of_a.size[a], count_a) == length) & (_sums(t.of_b.size[b], count_b) == length))
        while True:
            if wrong.any():                             # such texts have no tokens
                a, b = a[np.repeat(~wrong, count_a)], b[np.repeat(~wrong, count_b)]
                used, length, count_a, count_b = used[~wrong], length[~wrong], count_a[~wrong], count_b[~wrong]
                said = [x for x, w in zip(said, wrong) if not w]
            real = np.frombuffer(b"".join(said), np.uint8)
            differs = np.flatnonzero((t.of_a.bytes_of(a) != real) | (t.of_b.bytes_of(b) != real))
            stops = np.cumsum(length)
            wrong = np.zeros(len(used), bool)
            if not len(differs):
                break
            wrong[np.searchsorted(stops, differs, side="right")] = True
        end_a, end_b = t.of_a.ends(a), t.of_b.ends(b)
        cuts = ascending(np.concatenate([end_a, end_b]))
        at_a, at_b = np.searchsorted(end_a, cuts), np.searchsorted(end_b, cuts)
        owner = np.searchsorted(stops, cuts)
        both = (end_a[at_a] == cuts) & (end_b[at_b] == cuts) if len(cuts) else np.zeros(0, bool)
        self.link_text, self.link_a, self.link_b = used[owner], a[at_a], b[at_b]

        def per_text(x):
            out = np.zeros(n, np.int64)
            out[used] = x
            return out

        self.n_a, self.n_b = per_text(count_a), per_text(count_b)
        self.n_links = per_text(np.bincount(owner, minlength=len(used)))
        self.n_groups = per_text(np.bincount(owner[both], minlength=len(used)))
        self.groups = [""] * n
        for i, text in zip(used.tolist(), self._written(t, a, b, end_a, end_b, cuts[both], np.cumsum(count_b))):
            self.groups[i] = text

    @staticmethod
    def _written(t: Tokenizers, a, b, end_a, end_b, closed, last_b) -> Iterator[memoryview]:
        """`a1,a2|b1;a3|b2,b3` of each text, all groups laid out at once: A's ids of a group, then B's, each followed by its separator."""
        group_a, group_b = np.searchsorted(closed, end_a), np.searchsorted(closed, end_b)
        place_a = np.arange(len(a)) + np.searchsorted(group_b, group_a)                       # B's ids of earlier groups come before
        place_b = np.arange(len(b)) + np.searchsorted(group_a, group_b, side="right")
        width = max(t.of_a.digits.shape[1], t.of_b.digits.shape[1])
        chars = np.zeros((len(a) + len(b), width), np.uint8)
        written = np.zeros(len(chars), np.int64)
        for ids, place, group, of, final in ((a, place_a, group_a, t.of_a, "|"), (b, place_b, group_b, t.of_b, ";")):
            chars[place, : of.digits.shape[1]] = of.digits[ids]
            written[place] = of.written[ids] + 1
            ends = np.append(group[1:] != group[:-1], True) if len(group) else np.zeros(0, bool)
            chars[place, of.written[ids]] = np.where(ends, ord(final), ord(","))
        flat = memoryview(chars[chars > 0].tobytes())
        stops = np.cumsum(written)[place_b[last_b - 1]] if len(last_b) else last_b
        begin = 0
        for stop in stops.tolist():
            yield flat[begin: stop - 1]
            begin = stop


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values)])
    stops = np.cumsum(counts)
    return total[stops] - total[stops - counts]


def containers(slots: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """A binary column: the container of each run slots[cuts[i]:cuts[i + 1]], ascending numbers below BLOCK_ROWS."""
    slots = slots.astype("<u2")
    sizes = np.diff(cuts)
    if not (sizes >= DENSE).any():
        return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer((2 * cuts).astype(np.int32)), pa.py_buffer(slots.tobytes())])
    out = []
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        if b - a < DENSE:
            out.append(slots[a:b].tobytes())
        else:
            marks = np.zeros(BLOCK_ROWS, np.uint8)
            marks[slots[a:b]] = 1
            out.append(np.packbits(marks, bitorder="little").tobytes())
    return pa.array(out, pa.binary())


def slots_of(bits: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all containers of a binary column one after the other, and how many each one has."""
    parts, sizes = [], []
    for c in bits.to_pylist():
        if len(c) == BITMAP_BYTES:
            parts.append(np.flatnonzero(np.unpackbits(np.frombuffer(c, np.uint8), bitorder="little")))
        else:
            parts.append(np.frombuffer(c, "<u2"))
        sizes.append(len(parts[-1]))
    return np.concatenate(parts).astype(np.int64) if parts else np.zeros(0, np.int64), np.array(sizes, np.int64)


class Block:
    """Postings of up to BLOCK_ROWS texts: sorted (pair, slot) keys of each run with the number of links."""

    def __init__(self):
        self.rows, self.held = 0, 0
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, pair: np.ndarray, slot: np.ndarray, rows: int) -> None:
        key, n = np.unique((pair << 16) | slot, return_counts=True)
        self.parts.append((key, n))
        self.rows += rows
        self.held += len(key)

    def postings(self) -> Iterator[tuple[np.ndarray, int, np.ndarray, pa.Array]]:
        """(pairs, plane, popcounts, containers): plane -1 is the texts' bitmap, plane k bit k of the number of further links."""
        if not self.held:
            return
        key, n = (np.concatenate([p[k] for p in self.parts]) for k in range(2))
        order = np.argsort(key)
        key, more = key[order], n[order] - 1
        yield self._plane(key, -1)
        for plane in range(int(more.max()).bit_length()):
            some = (more >> plane) & 1 == 1
            if some.any():
                yield self._plane(key[some], plane)

    @staticmethod
    def _plane(key: np.ndarray, plane: int) -> tuple[np.ndarray, int, np.ndarray, pa.Array]:
        pair = key >> 16
        cuts = np.concatenate([[0], np.flatnonzero(pair[1:] != pair[:-1]) + 1, [len(pair)]])
        return pair[cuts[:-1]], plane, np.diff(cuts), containers(key & 0xFFFF, cuts)


COUNTS = ["n_a", "n_b", "n_groups", "n_links"]


def index(docs: DataFrame, byte_json: str, piece_model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One table of two kinds of rows: texts (block, slot, id, counts, groups_sha256), and postings (block, pair, plane, n, bits).

    A pair is A's id times the size of B's vocabulary plus B's id. Written in the shared folder: numbers of texts stay what they are."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast((byte_json, piece_model))           # a few MB, fixed by the files
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"block long, slot int, id {kind}, {', '.join(f'{c} long' for c in COUNTS)}, groups_sha256 string, pair long, plane int, n int, bits binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizers(*shared.value)
        number, block, id_type = TaskContext.get().partitionId() << 32, Block(), None

        def filled(k: int, columns: dict[str, pa.Array]) -> pa.RecordBatch:
            types = {"block": pa.int64(), "slot": pa.int32(), "id": id_type, **dict.fromkeys(COUNTS, pa.int64()), "groups_sha256": pa.string(),
                     "pair": pa.int64(), "plane": pa.int32(), "n": pa.int32(), "bits": pa.binary()}
            columns["block"] = pa.array(np.full(k, number))
            return pa.RecordBatch.from_arrays([columns[c] if c in columns else pa.nulls(k, own) for c, own in types.items()], list(types))

        def closed():
            nonlocal number, block
            for pair, plane, n, bits in block.postings():
                for i in range(0, len(pair), 100_000):
                    part = slice(i, i + 100_000)
                    yield filled(len(pair[part]), {"pair": pa.array(pair[part]), "plane": pa.array(np.full(len(pair[part]), plane, np.int32)),
                                                   "n": pa.array(n[part].astype(np.int32)), "bits": bits.slice(i, 100_000)})
            number, block = number + 1, Block()

        for batch in batches:
            id_type = batch.column(0).type
            for first, part in chunks(batch.column(1), rows=BLOCK_ROWS):
                if block.rows + len(part) > BLOCK_ROWS or block.held > BLOCK_POSTINGS:
                    yield from closed()
                found = Aligned(t, part.to_pylist())
                yield filled(len(part), {
                    "slot": pa.array(np.arange(block.rows, block.rows + len(part), dtype=np.int32)), "id": batch.column(0).slice(first, len(part)),
                    **{c: pa.array(getattr(found, c)) for c in COUNTS},
                    "groups_sha256": pa.array([hashlib.sha256(g).hexdigest() if len(g) else "" for g in found.groups], pa.string())})
                block.add(found.link_a * len(t.of_b.size) + found.link_b, block.rows + found.link_text, len(part))
        yield from closed()

    return cut_lineage(rows.mapInArrow(run, schema))


def weight(plane: Column) -> Column:
    """Links that a set bit of a plane stands for."""
    return F.when(plane < 0, F.lit(1).cast("long")).otherwise(F.pow(F.lit(2.0), plane).cast("long"))


def pair_counts(postings: DataFrame, b_size: int) -> DataFrame:
    """(pair, a, b, n_docs, n_links, best): popcounts of every pair over all blocks; best marks the highest n_links of its B id."""
    summed = postings.groupBy("pair").agg(F.sum(F.when(F.col("plane") < 0, F.col("n"))).alias("n_docs"),
                                          F.sum(F.col("n") * weight(F.col("plane"))).alias("n_links"))
    own = summed.withColumn("a", F.floor(F.col("pair") / b_size).cast("int")).withColumn("b", F.pmod("pair", F.lit(b_size)).cast("int"))
    # a B id has at most as many pairs as A has ids
    return own.withColumn("best", F.col("n_links") == F.max("n_links").over(Window.partitionBy("b")))


def align(docs: DataFrame, byte_json: str, piece_model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row."""
    both = index(docs, byte_json, piece_model, id_col, text_col)
    texts = both.where("pair is null").select("block", "slot", "id", *COUNTS, "groups_sha256")
    postings = both.where("pair is not null").select("block", "pair", "plane", "n", "bits")
    counts = pair_counts(postings, tokenizers(byte_json, piece_model).b.get_piece_size()).select("pair", "n_links", "best")
    carried = attach(postings, counts, ["pair"], ["block", "plane"]).select(
        "block", "bits", (F.col("n_links") * weight(F.col("plane"))).alias("links"), F.when(F.col("best"), weight(F.col("plane"))).otherwise(0).alias("best"))

    def returned(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        slots, sizes = slots_of(group.column("bits"))
        sums = np.zeros((2, BLOCK_ROWS), np.int64)
        for k, name in enumerate(("links", "best")):
            np.add.at(sums[k], slots, np.repeat(group.column(name).to_numpy(), sizes))
        some = np.flatnonzero(sums[0])
        return pa.table({"block": pa.array(np.full(len(some), group.column("block")[0].as_py())), "slot": pa.array(some.astype(np.int32)),
                         "count_sum": pa.array(sums[0, some]), "n_best": pa.array(sums[1, some])})

    # one block's postings: at most BLOCK_POSTINGS numbers beyond the last run's
    scores = carried.groupBy("block").applyInArrow(returned, "block long, slot int, count_sum long, n_best long")
    none = F.lit(0).cast("long")
    return texts.join(scores, ["block", "slot"], "left").select(
        "id", *COUNTS, F.coalesce("n_best", none).alias("n_best"), F.coalesce("count_sum", none).alias("count_sum"), "groups_sha256")
