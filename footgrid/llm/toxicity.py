"""Toxicity by a support vector machine over a subsequence string kernel with Nyström landmarks.

The kernel of two words sums over all common subsequences of three letters, each weighted by DECAY to the power of the letters it
spans on both sides (spans up to SPAN), so letters put in between or left out cost similarity but do not end it; it is normalised
to 1 for equal words. Words are runs of letters and digits, single other characters within them included, and letters set apart by
spaces count as one word. A text's score is a logistic function of the scores of its WORST highest-scoring words, fitted last.

Training is multiple-instance: a label says that a sentence's words hold an insult but not which, so of a labelled text only the
word that scores highest stands for the label, and which one that is follows from the model of the round before. The first round takes words that stand in toxic texts far more often than chance
has it; these are also the candidates for landmarks, chosen greedily by what the others do not yet explain, and the highest-scoring words
of clean texts join them as landmarks. The machine (squared hinge loss, L2) is solved on the landmark features, where its normal
vector folds into one weight per subsequence; so scoring is a table look-up per letter triple and needs no kernel evaluation. A word's
norm is only computed where a bound on it says the word can score above the floor, which all harmless words share.

At most `sample` labelled rows are used for fitting, the first by a hash of the id; all texts are scored whole.

Results: null and wordless texts get the floor's score; repeated rows are scored alike; labels that are null, held out or without a
text are not used, and of several rows with one labelled id one counts; where the labels of one class are missing, every score is 0; on few
labels the first round gets less choosy step by step (STEPS), and only where no toxic text has a word, fitting raises ValueError. An empty table gives an empty table. Other columns are returned untouched by `clean`
and not read elsewhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut_lineage
from . import shingles as S

SPAN = 6
DECAY = 0.7
#: What a word has to score above one without any likeness before it counts; all below are alike.
MARGIN = 0.4
LANDMARKS = 96
SAMPLE = 20_000
ROUNDS = 4
WORST = 3
#: First-round words stand after at least three different words in toxic texts (so copies of one text don't count), in a share of the toxic
#: texts LIFT times their share of the clean ones, mostly in toxic texts, and SURPRISE standard deviations more often than if labels were
#: dealt at random; looked for among the CANDIDATES most frequent words of toxic texts.
LIFT, SURPRISE, CANDIDATES = 3.0, 3.0, 50_000
#: (least different words before, LIFT, SURPRISE, fewest letters), looser step by step where a small label table leaves no first-round word; in
#: the last step every word of the toxic texts may be one.
STEPS = [(3, LIFT, SURPRISE, 3), (2, 2.0, 1.0, 3), (1, 1.0, 0.0, 2), (1, 0.0, -1e9, 1)]
GAPS = [(a, b) for a in range(1, SPAN - 1) for b in range(1, SPAN - a)]

# letters to 64 classes: a-z, one for digits, one for the start of a word, 32 for the last byte of other characters; what is put between
# letters (and the lead bytes of characters) is left out
_START, _NONE = 27, 99
_CLASS = np.full(256, _NONE, np.uint32)
_CLASS[97:123] = np.arange(26)
_CLASS[48:58] = 26
_CLASS[128:192] = 32 + np.arange(64) % 32
_LETTER = np.zeros(256, bool)
_LETTER[48:58] = _LETTER[97:123] = _LETTER[128:] = True
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[33:48] = _PUNCTUATION[58:65] = _PUNCTUATION[91:97] = _PUNCTUATION[123:127] = True


def held_out(id_col: str | Column, remainder: int = 0) -> Column:
    """Whether crc32 of the id as text has this remainder modulo 5; the id null counts as the empty text."""
    name = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(F.coalesce(name.cast("string"), F.lit("")).cast("binary")) % 5 == remainder


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of the lower-cased texts, starts and ends of words in them, offsets of each text's first word."""
    body, at = S.flat(pc.utf8_lower(texts.cast(pa.large_string())))
    letter = _LETTER[body]
    pad = np.concatenate([[False, False], letter, [False, False]])
    left, right, left2, right2 = pad[1:-3], pad[3:-1], pad[:-4], pad[4:]
    inner = _PUNCTUATION[body] & left & right
    spaced = (body == 32) & left & right & ~left2 & ~right2
    return body, *S.runs(letter | inner | spaced, at)


def triples(body: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word, subsequence code, weight) of all letter triples of the words, and the number of letters of each word."""
    sizes = ends - starts + 1                              # a mark for the word's start comes first
    word = np.repeat(np.arange(len(starts)), sizes)
    if not len(word):
        return np.zeros(0, np.int64), np.zeros(0, np.uint32), np.zeros(0, np.float32), np.zeros(0, np.int64)
    place = np.arange(len(word)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    code = _CLASS[body[np.repeat(starts - 1, sizes) + place]]
    code[place == 0] = _START
    kept = code != _NONE
    word, code = word[kept], code[kept]
    letters = np.bincount(word, minlength=len(starts))
    parts = []
    for a, b in GAPS:
        n = len(word) - a - b
        if n > 0:
            same = np.flatnonzero(word[:n] == word[a + b:])
            parts.append((word[same], (code[same] << 12) | (code[same + a] << 6) | code[same + a + b], np.full(len(same), DECAY ** (a + b + 1), np.float32)))
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.uint32), np.zeros(0, np.float32), letters
    return *(np.concatenate([p[k] for p in parts]) for k in range(3)), letters


#: Least squared norm of a word of so many letters: what its triples weigh if no two are alike.
_LEAST = np.cumsum([0.0] + [sum(DECAY ** (2 * (a + b + 1)) for a, b in GAPS if a + b < n) for n in range(1, 257)])


def exact_norms(word: np.ndarray, code: np.ndarray, weight: np.ndarray, count: int) -> np.ndarray:
    key = word.astype(np.uint64) << np.uint64(18) | code
    unique, inverse = np.unique(key, return_inverse=True)
    value = np.bincount(inverse, weight, len(unique))
    return np.sqrt(np.bincount((unique >> np.uint64(18)).astype(np.int64), value ** 2, count))


class Machine:
    """A weight per letter triple and an offset; or, in the first round, a score per word."""

    def __init__(self, weights: np.ndarray | None, offset: float, known: dict[int, float] | None = None):
        self.weights, self.offset, self.floor = weights, offset, offset + MARGIN
        self.mixture = np.array([2.0] + [0.0] * WORST)
        self.known = None if known is None else (np.array(sorted(known), np.uint64), np.array([known[k] for k in sorted(known)]))

    def score(self, body: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Score of each word, the floor at least."""
        if not len(starts):
            return np.zeros(0)
        if self.known is not None:
            hashes = S.run_hashes(body, starts, ends)
            at = np.minimum(np.searchsorted(self.known[0], hashes), len(self.known[0]) - 1)
            return np.where(self.known[0][at] == hashes, self.known[1][at], self.floor) if len(self.known[0]) else np.full(len(starts), self.floor)
        word, code, weight, letters = triples(body, starts, ends)
        total = np.bincount(word, self.weights[code] * weight, len(starts))
        least = np.sqrt(_LEAST[np.minimum(letters, 256)])
        out = np.full(len(starts), self.floor)
        can = np.flatnonzero(total > MARGIN * least)
        if len(can):
            word, code, weight, _ = triples(body, starts[can], ends[can])
            norm = exact_norms(word, code, weight, len(can))
            out[can] = np.maximum(self.floor, total[can] / np.maximum(norm, 1e-12) + self.offset)
        return out

    def worst(self, texts: pa.Array) -> tuple[np.ndarray, list[str]]:
        """The WORST highest word scores of each text, highest first, and the word of the highest."""
        body, starts, ends, first = words(texts)
        top, names = np.full((len(texts), WORST), self.floor), [""] * len(texts)
        if not len(starts):
            return top, names
        _, index, inverse = np.unique(S.run_hashes(body, starts, ends), return_index=True, return_inverse=True)
        score = self.score(body, starts[index], ends[index])[inverse]
        told = np.flatnonzero(score > self.floor)
        owner = np.searchsorted(first, told, side="right") - 1
        order = np.lexsort((-score[told], owner))
        told, owner = told[order], owner[order]
        rank = np.arange(len(told)) - np.searchsorted(owner, owner)
        few = rank < WORST
        top[owner[few], rank[few]] = score[told[few]]
        for k, i in zip(told[rank == 0], owner[rank == 0]):
            names[i] = body[starts[k]:ends[k]].tobytes().decode("utf-8", "replace")
        return top, names

    def share(self, top: np.ndarray) -> np.ndarray:
        """Score from 0 to 1 of texts with these worst words."""
        return 1 / (1 + np.exp(-(top @ self.mixture[:-1] + self.mixture[-1])))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Weights, the offset last, of a logistic regression by Newton steps; both classes weigh the same."""
    x1, w = np.column_stack([x, np.ones(len(x))]), np.zeros(x.shape[1] + 1)
    weight = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y <= 0).sum(), 1))
    penalty = np.diag([ridge] * x.shape[1] + [1e-9])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        slope = x1.T @ (weight * (p - (y > 0))) + penalty @ w
        step = np.linalg.solve((x1 * (weight * p * (1 - p))[:, None]).T @ x1 + penalty + 1e-9 * np.eye(len(w)), slope)
        w = w - step
        if np.abs(step).max() < 1e-7:
            break
    return w


def _laid_out(names: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = [n.encode() for n in names]
    ends = np.cumsum([len(r) for r in raw])
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], ends[:-1]]).astype(np.int64), ends.astype(np.int64)


def kernel(left: list[str], right: list[str]) -> np.ndarray:
    """Normalised kernel of every word on the left with every word on the right."""
    word, code, weight, _ = triples(*_laid_out(right))
    norm = exact_norms(word, code, weight, len(right))
    codes = np.unique(code)
    table = np.zeros((len(codes) + 1, len(right)), np.float32)
    np.add.at(table, (np.searchsorted(codes, code), word), weight)
    table /= np.maximum(norm, 1e-12)
    word, code, weight, _ = triples(*_laid_out(left))
    norm = exact_norms(word, code, weight, len(left))
    at = np.searchsorted(codes, code)
    hit = (at < len(codes)) & (codes[np.minimum(at, len(codes) - 1)] == code)
    out = np.zeros((len(left), len(right)), np.float32)
    for lo in range(0, int(hit.sum()), 50_000):
        some = np.flatnonzero(hit)[lo: lo + 50_000]
        np.add.at(out, word[some], table[at[some]] * weight[some, None])
    return out / np.maximum(norm, 1e-12)[:, None]


def choose(names: list[str], worth: np.ndarray, count: int) -> list[str]:
    """Landmarks by pivoted Cholesky: each time the word with the most worth that those before it leave unexplained."""
    k = kernel(names, names)
    left, picked, basis = np.ones(len(names)), [], np.zeros((len(names), 0))
    while len(picked) < min(count, len(names)):
        i = int(np.argmax(worth * left))
        if left[i] < 0.05:
            break
        column = (k[:, i] - basis @ basis[i]) / np.sqrt(left[i])
        basis, left = np.column_stack([basis, column]), np.maximum(0, left - column ** 2)
        left[i] = 0
        picked.append(names[i])
    return picked


def solve(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 2e-4) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss by Newton steps; the offset is not regularised."""
    x1 = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x1.shape[1])
    penalty = np.diag([ridge] * x.shape[1] + [1e-9]) * weight.sum()
    for _ in range(50):
        active = y * (x1 @ w) < 1
        xa = x1[active] * weight[active, None]
        new = np.linalg.solve(xa.T @ x1[active] + penalty, xa.T @ y[active])
        if np.abs(new - w).max() < 1e-7:
            break
        w = new
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        sample: int = SAMPLE, use: Column | None = None) -> Machine | None:
    """A machine from at most `sample` labelled rows, or None if a class has no rows. `use` says which labels may be used.
    ValueError if both classes have rows but no toxic text has a word."""
    told = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("id is not null and label in (0, 1)")
    told = (told if use is None else told.where(use)).groupBy("id").agg(F.max("label").alias("label"))
    told = F.broadcast(told.orderBy(F.xxhash64("id"), "id").limit(sample))      # `sample` pairs of numbers
    # an id counts once, by the first of its texts in the order of a hash, so these are `sample` rows at most
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(told, "id").groupBy("id", "label") \
        .agg(F.min(F.struct(F.xxhash64("text").alias("order"), "text")).alias("one"))
    rows = cut_lineage(rows.select("label", "one.text"))
    sizes = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if len(sizes) < 2:
        return None
    toxic, clean = sizes[1], sizes[0]

    def spotted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, part in S.chunks(batch.column(1)):
                body, starts, ends, at = words(part)
                hashes = S.run_hashes(body, starts, ends)
                before = np.concatenate([[np.uint64(0)], hashes[:-1]])[: len(hashes)]
                before[at[:-1][np.diff(at) > 0]] = 0
                _, some = np.unique(np.stack([hashes, before], 1), axis=0, return_index=True)
                names = [body[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(starts[some], ends[some])]
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(before[some].view(np.int64))], ["word", "before"])

    spoken = cut_lineage(rows.where("label = 1").mapInArrow(spotted, "word string, before long").distinct().groupBy("word").agg(F.count(F.lit(1)).alias("n")))

    def first_round(least: int, lift: float, surprise: float, letters: int) -> tuple[dict, dict]:
        """Words that tell the toxic texts from the clean ones, with their number of different words before, and how surely."""
        often = spoken.where(F.char_length("word").between(letters, 40) & (F.col("n") >= least)).orderBy(F.desc("n"), "word").limit(CANDIDATES).collect()
        if not often:
            return {}, {}
        hashes = S.run_hashes(*_laid_out([r["word"] for r in often]))
        listed = rows.sparkSession.sparkContext.broadcast(np.sort(hashes))

        def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            wanted, count = listed.value, np.zeros((2, len(listed.value)), np.int64)
            for batch in batches:
                label = batch.column(0).to_numpy()
                for first, part in S.chunks(batch.column(1)):
                    body, starts, ends, at = words(part)
                    own = S.run_hashes(body, starts, ends)
                    place = np.minimum(np.searchsorted(wanted, own), len(wanted) - 1)
                    hit = np.flatnonzero(wanted[place] == own)
                    owner = np.searchsorted(at, hit, side="right") - 1
                    text, place = np.divmod(np.unique(owner * len(wanted) + place[hit]), len(wanted))
                    np.add.at(count, (label[first + text], place), 1)
            some = np.flatnonzero(count.any(axis=0))
            yield pa.RecordBatch.from_arrays([pa.array(wanted[some].view(np.int64)), pa.array(count[0, some]), pa.array(count[1, some])], ["hash", "clean", "toxic"])

        texts = {r["hash"]: (r["toxic"], r["clean"]) for r in rows.mapInArrow(met, "hash long, clean long, toxic long").groupBy("hash")
                 .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).collect()}
        seen, worth_of, share = {}, {}, toxic / (toxic + clean)
        for r, h in zip(often, hashes.view(np.int64).tolist()):
            held, there = texts.get(h, (0, 0))
            z = (r["n"] - (r["n"] + there) * share) / np.sqrt((r["n"] + there) * share * (1 - share) + 1)
            # rates are compared over texts of both classes, as a common word stands after many words of one text
            if lift == 0 or r["n"] > (2 if least > 1 else 0) * there and min(held, r["n"]) * clean > lift * there * toxic and z > surprise:
                seen[r["word"], 1], worth_of[r["word"]] = r["n"], z
        return seen, worth_of

    for step in STEPS:
        seen, worth_of = first_round(*step)
        if seen:
            break
    else:
        raise ValueError(f"the {toxic} toxic texts have no word of up to 40 characters")
    names = sorted(worth_of, key=lambda w: (-worth_of[w], w))[:600]
    worth = np.maximum([worth_of[w] for w in names], 1e-3)
    seen = {(w, 1): seen[w, 1] for w in names}
    body, starts, ends = _laid_out(names)
    machine = Machine(None, 0.0, dict(zip(S.run_hashes(body, starts, ends).tolist(), worth.tolist())))
    marks = choose(names, worth, LANDMARKS)
    for turn in range(ROUNDS):
        shared = rows.sparkSession.sparkContext.broadcast(machine)

        def witnesses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for first, part in S.chunks(batch.column(1)):
                    score, best = shared.value.worst(part)
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(part)), pa.array(best, pa.string()), pa.array(score[:, 0].copy())],
                                                     ["label", "word", "score"])

        found = rows.mapInArrow(witnesses, "label int, word string, score double").where("word <> ''") \
            .groupBy("label", "word").agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("score")).collect()      # at most `sample` rows
        for r in found:
            if r["label"] == 0 or r["score"] > 0:
                seen[r["word"], r["label"]] = max(r["n"], seen.get((r["word"], r["label"]), 0))
        hard = sorted((-r["score"], r["word"]) for r in found if r["label"] == 0 and r["word"] not in marks)[:LANDMARKS // 2]
        marks += [w for _, w in hard]
        # a word counts for one class: few clean texts that name a first-round word don't speak against it
        cases = sorted((w, k) for w, k in seen if not (k == 1 and seen.get((w, 0), 0) * toxic > seen[w, 1] * clean)
                       and not (k == 0 and w in worth_of and seen[w, 0] * LIFT * toxic < seen.get((w, 1), 0) * clean))
        y = np.array([1.0 if k else -1.0 for _, k in cases])
        n = np.sqrt(np.array([float(seen[c]) for c in cases]))
        share = np.where(y > 0, 0.5 / max(n[y > 0].sum(), 1), 0.25 / max(n[y < 0].sum(), 1)) * n
        km = kernel(marks, marks).astype(float)
        value, vector = np.linalg.eigh(km)
        root = vector @ np.diag(1 / np.sqrt(np.maximum(value, 1e-3))) @ vector.T           # Nyström: landmark kernel to the power -1/2
        # the zero vector stands for the many clean words that resemble no landmark
        x = np.vstack([kernel([w for w, _ in cases], marks) @ root, np.zeros((1, len(marks)))])
        y, share = np.append(y, -1.0), np.append(share, 0.25)
        w, offset = solve(x, y, share)
        alpha = root @ w
        word, code, weight, _ = triples(*_laid_out(marks))
        norm = exact_norms(word, code, weight, len(marks))
        weights = np.bincount(code, weight * (alpha / np.maximum(norm, 1e-12))[word], 1 << 18).astype(np.float32)
        machine = Machine(weights, offset)
    shared = rows.sparkSession.sparkContext.broadcast(machine)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, part in S.chunks(batch.column(1)):
                top, _ = shared.value.worst(part)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(part)), *(pa.array(top[:, k].copy()) for k in range(WORST))],
                                                 ["label", *(f"w{k}" for k in range(WORST))])

    seen_tops = rows.mapInArrow(placed, "label int, " + ", ".join(f"w{k} double" for k in range(WORST))).toArrow()      # `sample` rows of numbers
    tops = np.column_stack([seen_tops.column(f"w{k}").to_numpy() for k in range(WORST)])
    machine.mixture = logistic(tops, seen_tops.column("label").to_numpy())
    return machine


def scores(docs: DataFrame, machine: Machine | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score double from 0 to 1, witness string) of every row; `id_col` may name any column, also a struct."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, part in S.chunks(batch.column(1)):
                if shared.value is None:
                    value, best = np.zeros(len(part)), [""] * len(part)
                else:
                    value, best = shared.value.worst(part)
                    value = shared.value.share(value)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(part)), pa.array(value), pa.array(best, pa.string())], ["id", "score", "witness"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, score double, witness string")


def clean(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that the machine does not reject, with all their columns."""
    machine = fit(docs, labels, id_col, text_col, use=~held_out("id"))
    if machine is None:
        return docs
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("all"), F.col(text_col).alias("text"))
    return scores_of(whole, machine).where("score < 0.5").select("all.*")


def scores_of(whole: DataFrame, machine: Machine) -> DataFrame:
    """(all, score): rows of any columns, packed in `all`, go through the scorer beside their `text`."""
    return scores(whole, machine, "all", "text").select(F.col("id").alias("all"), "score")
