"""Byte-level BPE encoding and decoding through a pair occurrence index.

The words that a run of texts shows for the first time are laid out in symbol arrays of about 256 K characters each. An index maps every mergeable pair, by
its rank, to all positions where it stands in such an array; the active ranks are taken in ascending order, each one is applied
to all its positions at once, and the lists of the pairs that appear beside the merged symbols are extended. In such a
vocabulary a merged symbol only takes part in merges of higher ranks (checked when it is read), so one ascending sweep is the whole
encoding, also of a single very long word, in time near to its length.

Results: null texts count as empty and give no ids; repeated rows give repeated rows; an empty table gives an empty table; other
columns are not read, so their names can't clash.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .shingles import chunks

#: The split of text into words that this family of vocabularies was made with.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHE_WORDS = 250_000
RUN_BYTES = 2 << 20
RUN_ROWS = 5_000
#: Characters of new words in one sweep: its index takes up to a hundred bytes for each of them.
SWEEP_CHARS = 1 << 18


def ascending(x: np.ndarray) -> np.ndarray:
    """Distinct values in order."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def byte_letters() -> list[str]:
    """The letter that stands for each byte in vocabulary files: itself if printable, else the next free one from U+0100."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, free = [], 0x100
    for b in range(256):
        out.append(chr(b if b in plain else free))
        free += b not in plain
    return out


class Vocabulary:
    """Merges and byte strings of a tokenizer file (its JSON text)."""

    def __init__(self, source: str):
        spec = json.loads(source)
        model, vocab = spec["model"], spec["model"]["vocab"]
        letters = byte_letters()
        of_letter = {c: b for b, c in enumerate(letters)}
        self.byte_id = np.array([vocab[c] for c in letters], np.int64)
        self.size = 1 + max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])])
        self.bytes_of = [b""] * self.size
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(of_letter[c] for c in token)
        self.special = {}
        for t in spec["added_tokens"]:
            if any(t[k] for k in ("single_word", "lstrip", "rstrip", "normalized")):
                raise ValueError(f"Added token {t['content']!r}: only plain, unnormalised added tokens are handled.")
            self.special[t["content"]] = t["id"]
            self.bytes_of[t["id"]] = t["content"].encode()
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        left, right = (np.array([vocab[p[k]] for p in pairs], np.int64) for k in (0, 1))
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        born = np.full(self.size, -1, np.int64)
        born[made] = np.arange(len(made))
        if len(np.unique(made)) != len(made) or (born[left] >= np.arange(len(made))).any() or (born[right] >= np.arange(len(made))).any():
            raise ValueError("Merges must make each symbol once and before its first use.")
        self.left, self.right, self.made = left, right, made
        key = left * self.size + right
        self.rank_order = np.argsort(key)
        self.keys = key[self.rank_order]
        self.pattern = regex.compile(WORDS)
        marks = sorted(self.special, key=len, reverse=True)
        self.split = regex.compile("(" + "|".join(map(regex.escape, marks)) + ")") if marks else None
        # letters and digits newer than the tokenizer's tables count as other characters there
        every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
        young = [c for c in regex.findall(r"[\p{L}\p{N}]", every) if unicodedata.category(c) == "Cn"]
        self.young = dict.fromkeys(map(ord, young), "͸")
        self.later = regex.compile(f"[{min(young)}-\U0010FFFF]" if young else r"(?!)")
        self.cache: dict[str | int, bytes] = {}

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The merge rank of each pair of symbols, -1 where there is none."""
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (a >= 0) & (b >= 0), self.rank_order[at], -1)

    def words(self, text: str) -> list[str | int]:
        """Words of a text; an added token is its id."""
        if self.split is None:
            return self._words(text)
        out: list[str | int] = []
        for k, part in enumerate(self.split.split(text)):
            out += [self.special[part]] if k % 2 else self._words(part)
        return out

    def _words(self, text: str) -> list[str]:
        if text.isascii() or not self.later.search(text):
            return self.pattern.findall(text)
        plain = text.translate(self.young)
        return [text[m.start():m.end()] for m in self.pattern.finditer(plain)]

    def merge(self, new: list[str]) -> list[bytes]:
        """Ids of each word (int32 values one after the other), by one sweep over the pair occurrence index of all of them."""
        if not new:
            return []
        raw = [w.encode() for w in new]
        body = np.frombuffer(b"\0".join(raw) + b"\0", np.uint8)
        ends = np.cumsum([len(r) + 1 for r in raw]) - 1
        symbol = self.byte_id[body]
        symbol[ends] = -1
        n = len(symbol)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[-1] = n - 1
        before[0] = 0
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def note(positions: np.ndarray) -> None:
            rank = self.ranks(symbol[positions], symbol[after[positions]])
            positions, rank = positions[rank >= 0], rank[rank >= 0]
            order = np.argsort(rank, kind="stable")
            positions, rank = positions[order], rank[order]
            if not len(rank):
                return
            cuts = [0, *(np.flatnonzero(rank[1:] != rank[:-1]) + 1).tolist(), len(rank)]
            for k, r in enumerate(rank[cuts[:-1]].tolist()):
                if r not in index:
                    index[r] = []
                    heapq.heappush(active, r)
                index[r].append(positions[cuts[k]: cuts[k + 1]])

        note(np.arange(n))
        while active:
            r = heapq.heappop(active)
            at = index.pop(r)
            at = ascending(np.concatenate(at)) if len(at) > 1 else at[0]
            a, b = self.left[r], self.right[r]
            at = at[(symbol[at] == a) & (symbol[after[at]] == b)]
            if a == b and len(at) > 1:              # in a run of equal symbols every second pair is merged, from the left
                fresh = np.concatenate([[True], after[at[:-1]] != at[1:]])
                place = np.arange(len(at))
                at = at[(place - np.maximum.accumulate(np.where(fresh, place, 0))) % 2 == 0]
            if not len(at):
                continue
            gone = after[at]
            symbol[at] = self.made[r]
            symbol[gone] = -2
            after[at] = after[gone]
            before[after[at]] = at
            note(ascending(np.concatenate([at, before[at]])))
        kept = symbol >= 0
        stops = (4 * np.cumsum(kept)[ends]).tolist()
        flat = symbol[kept].astype(np.int32).tobytes()
        return [flat[a:b] for a, b in zip([0, *stops], stops)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        number: defaultdict[str | int, int] = defaultdict()         # of each word in the order in which they come
        number.default_factory = number.__len__
        split = []                                  # 4 bytes a word: the words themselves are dropped text by text
        for t in texts:
            split.append(np.fromiter(map(number.__getitem__, self.words(t)), np.int32))
        known = self.cache
        if len(known) > CACHE_WORDS:
            known = self.cache = {w: known[w] for w in number if w in known}
        known.update((i, np.array([i], np.int32).tobytes()) for i in self.special.values())
        new = [w for w in number if w not in known]
        for part in self._sweeps(new):
            known.update(zip(part, self.merge(part)))
        ids = [known[w] for w in number]
        return [np.frombuffer(b"".join(map(ids.__getitem__, ws.tolist())), np.int32) for ws in split]

    @staticmethod
    def _sweeps(words: list[str]) -> Iterator[list[str]]:
        """The words in runs of about `SWEEP_CHARS`; a longer word is a run of its own."""
        first, size = 0, 0
        for k, w in enumerate(words):
            if k > first and size + len(w) > SWEEP_CHARS:
                yield words[first:k]
                first, size = k, 0
            size += len(w)
        if words:
            yield words[first:]

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids; bytes that are no UTF-8 become U+FFFD."""
        return b"".join([self.bytes_of[i] for i in ids.tolist()]).decode("utf-8", "replace")


def read_vocabulary(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode_decode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>, decoded string) per row; `vocabulary` is the JSON text of a byte-level BPE tokenizer file.

    The vocabulary (a few MB, fixed by the file) goes to the executors once, as a broadcast value."""
    rows = docs.select(id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    kind = rows.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = None
        for batch in batches:
            v = v or Vocabulary(shared.value)
            for first, part in chunks(batch.column(1), RUN_BYTES, RUN_ROWS):
                ids = v.encode([t or "" for t in part.to_pylist()])
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(part)), pa.ListArray.from_arrays(offsets, pa.array(flat)),
                     pa.array([v.decode(x) for x in ids], pa.string())], ["id", "ids", "decoded"])

    return rows.mapInArrow(run, f"id {kind}, ids array<int>, decoded string").withColumnRenamed("id", id_col)
