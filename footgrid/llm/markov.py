"""Hidden Markov language model: Baum-Welch counts from all training texts, exact sequence likelihood by the scaled forward recursion.

The model speaks in symbols: each of the HEAD most frequent training tokens is one, every other token belongs to one of TAILS classes by
its last two bytes, and within its class has the probability (c + 0.5) / (N + 0.5 (V + 1)), where c is its count in all training texts,
N and V the class's token and type counts; unseen tokens of a class share the one spare type. A text's likelihood is that of its symbols
under the Markov chain of hidden states times those of its tail tokens within their classes.

Work on the corpus is done by Spark: token counts are summed up within partitions and then by token; each Baum-Welch round adds up the
expected counts per symbol and per transition over all partitions; tail counts are joined to texts by token, once per distinct
(text, token). Every text is one sequence in training and in scoring. Texts of a run go through the recursions side by side; in training a text
of more than LONG tokens goes as pieces of PIECE tokens: the products of the pieces' transition and emission matrices, multiplied up along the text
in both directions, give what comes in at each piece's two ends, so its counts are those of the uncut text.

Tokens travel as 64-bit hashes, so two tokens in 10^10 may be taken for one at a corpus of 10^10 distinct ones.

Results: null and empty texts have the one token that ends each text. Without any training text all counts are 0, the base score is
log10(1) per token and so is the model's. Repeated rows are scored alike and counted as often as they come; an empty table gives an
empty table; columns other than id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut_lineage
from . import shingles as S

HEAD = 20_000
TAILS = 256
STATES = 6
ROUNDS = 4
RUN = 2_000_000                 # tokens that go through the recursions at once
LONG = 1024
PIECE = 256
FLUSH = 1_000_000
END = 0x5EEDED0FDEADBEE5                       # stands for the end of a text
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.ones(256, bool)
_WORD[32] = False
_WORD[9:14] = False


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and tail classes of all tokens, each text's end included, and the offset of each text's first token."""
    body, at = S.flat(texts)
    body = _LOWER[body]
    starts, ends, first = S.runs(_WORD[body], at)
    hashes = S.run_hashes(body, starts, ends)
    last = body[np.maximum(ends - 1, 0)].astype(np.int32) if len(ends) else np.zeros(0, np.int32)
    second = np.where(ends - starts > 1, body[np.maximum(ends - 2, 0)], 0).astype(np.int32) if len(ends) else last
    places = first[1:]
    return (np.insert(hashes, places, np.uint64(END)), np.insert((last * 31 + second * 7) % TAILS, places, 0),
            first + np.arange(len(first)))


def counted(docs: DataFrame, text_col: str) -> DataFrame:
    """(token, class, n) of all tokens of `docs`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def merged():
            token, kind, n = (np.concatenate([h[k] for h in held]) for k in range(3))
            unique, index, inverse = np.unique(token, return_index=True, return_inverse=True)
            held[:] = [(unique, kind[index], np.bincount(inverse, n, len(unique)).astype(np.int64))]

        def out():
            token, kind, n = held.pop()
            return pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(kind.astype(np.int32)), pa.array(n)], ["token", "class", "n"])

        for batch in batches:
            for _, part in S.chunks(batch.column(0)):
                token, kind, _ = tokens(part)
                unique, index, n = np.unique(token, return_index=True, return_counts=True)
                held.append((unique, kind[index], n))
                if sum(len(h[0]) for h in held) > FLUSH:
                    merged()
                    if len(held[0][0]) > FLUSH // 2:
                        yield out()
        if held:
            merged()
            yield out()

    return docs.select(F.col(text_col).alias("text")).mapInArrow(run, "token long, class int, n long") \
        .groupBy("token").agg(F.min("class").alias("class"), F.sum("n").alias("n"))


class Symbols:
    """Head tokens, most frequent first (smaller hash first among equals), and the counts that scoring needs."""

    def __init__(self, head: np.ndarray, counts: np.ndarray, tail_n: np.ndarray, tail_v: np.ndarray):
        self.order = np.argsort(head)
        self.head, self.counts = head[self.order], counts
        self.total, self.types = int(counts.sum() + tail_n.sum()), int(len(counts) + tail_v.sum())
        self.tail_n, self.tail_v = tail_n, tail_v

    @property
    def size(self) -> int:
        return len(self.head) + TAILS

    def of(self, token: np.ndarray, kind: np.ndarray) -> np.ndarray:
        out = len(self.head) + kind.astype(np.int64)
        if len(self.head):
            at = np.minimum(np.searchsorted(self.head, token), len(self.head) - 1)
            out = np.where(self.head[at] == token, self.order[at], out)
        return out

    def frequency(self) -> np.ndarray:
        """Share of each symbol, none of them 0."""
        n = np.concatenate([self.counts, self.tail_n]) + 0.5
        return n / n.sum()


class Chain:
    """Initial, transition (states x states) and emission (states x symbols) probabilities."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit

    @classmethod
    def first(cls, frequency: np.ndarray, states: int, seed: int = 7) -> Chain:
        noise = np.random.default_rng(seed).gamma(1.0, size=(states, len(frequency))) + 0.05
        emit = frequency * noise
        move = np.full((states, states), 0.3 / states) + 0.7 * np.eye(states)
        return cls(np.full(states, 1 / states), move / move.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True))

    @classmethod
    def from_counts(cls, start: np.ndarray, move: np.ndarray, emit: np.ndarray, frequency: np.ndarray) -> Chain:
        """The next round's probabilities; a little of the symbols' shares keeps every symbol possible in every state."""
        start, move, emit = start + 0.1, move + 0.1, emit + 0.5 * len(frequency) * frequency / 10
        return cls(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True))

    def expected(self, symbols: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """Baum-Welch counts (start, transitions, emissions) and log likelihood of sequences laid out one after the other."""
        begin, sizes, text = _pieces(first)
        states = len(self.start)
        emit, move = np.ascontiguousarray(self.emit.T, np.float32), self.move.astype(np.float32)
        opens = np.append(True, text[1:] != text[:-1]) if len(text) else np.zeros(0, bool)
        inward, outward = self._borders(symbols, begin, sizes, text, opens, emit, move)
        order = np.argsort(-sizes, kind="stable")
        begin, sizes, opens, inward, beta = begin[order], sizes[order], opens[order], inward[order], outward[order]
        length = int(sizes[0]) if len(sizes) else 0
        active = np.searchsorted(-sizes, -np.arange(length + 1), side="left")            # pieces of more than t tokens
        at = np.concatenate([[0], np.cumsum(active)])
        said = np.empty(int(at[-1]), np.int32)
        alpha = np.empty((len(said), states), np.float32)
        scale = np.empty(len(said), np.float32)
        now = np.where(opens[:, None], self.start.astype(np.float32), inward @ move)
        for t in range(length):
            m, here = active[t], slice(at[t], at[t + 1])
            said[here] = symbols[begin[:m] + t]
            now = (now[:m] @ move if t else now) * emit[said[here]]
            scale[here] = now.sum(1)
            now /= scale[here, None]
            alpha[here] = now
        moves = np.zeros((states, states))
        for t in range(length - 1, -1, -1):
            m, here = active[t], slice(at[t], at[t + 1])
            gamma = alpha[here] * beta[:m]
            whole = gamma.sum(1, keepdims=True)
            gamma /= whole
            back = emit[said[here]] * (beta[:m] / (whole * scale[here, None]))
            if t:
                moves += alpha[at[t - 1]: at[t - 1] + m].T @ back
                beta[:m] = back @ move.T
            else:
                moves += inward[~opens].T @ back[~opens]
            alpha[here] = gamma
        emission = np.stack([np.bincount(said, alpha[:, k], self.emit.shape[1]) for k in range(states)])
        begun = alpha[: active[0]][opens] if length else alpha
        return begun.sum(0, dtype=float), moves * self.move, emission, float(np.log(scale).sum(dtype=float))

    def _borders(self, symbols, begin, sizes, text, opens, emit, move) -> tuple[np.ndarray, np.ndarray]:
        """Per piece: the states' shares at the end of the piece before it, and the weight of all that follows it, each up to a factor."""
        n, states = len(begin), len(self.start)
        inward, outward = np.zeros((n, states), np.float32), np.ones((n, states), np.float32)
        many = np.flatnonzero(np.bincount(text)[text] > 1) if n else np.zeros(0, np.int64)
        if not len(many):
            return inward, outward
        many = many[np.argsort(-sizes[many], kind="stable")]
        product = np.where(opens[many, None, None], np.eye(states, dtype=np.float32), move)
        for t in range(PIECE):
            m = int(np.searchsorted(-sizes[many], -t, side="left"))
            said = emit[symbols[begin[many[:m]] + t]]
            said /= said.max(1, keepdims=True)
            product[:m] = (product[:m].reshape(-1, states) @ move).reshape(-1, states, states) * said[:, None] if t else product[:m] * said[:, None]
            if t % 4 == 3:
                product[:m] /= product[:m].max((1, 2), keepdims=True)
        of = np.empty((n, states, states), np.float32)
        of[many] = product
        number = np.arange(n) - np.maximum.accumulate(np.where(opens, np.arange(n), 0))
        for k in range(1, int(number.max()) + 1):                                        # along the texts, all of them at once
            here = np.flatnonzero(number == k)
            came = np.where((number[here - 1] == 0)[:, None], self.start.astype(np.float32), inward[here - 1])
            came = (came[:, None] @ of[here - 1])[:, 0]
            inward[here] = came / came.sum(1, keepdims=True)
        for k in range(int(number.max()), 0, -1):
            here = np.flatnonzero(number == k)
            after = (of[here] @ outward[here][:, :, None])[:, :, 0]
            outward[here - 1] = after / after.max(1, keepdims=True)
        return inward, outward

    def log10(self, symbols: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Exact log10 likelihood of each sequence by the scaled forward recursion, side by side from the longest to the shortest."""
        sizes = np.diff(first)
        order = np.argsort(-sizes, kind="stable")
        begin, sizes = first[:-1][order], sizes[order]
        emit = np.ascontiguousarray(self.emit.T)
        total = np.zeros(len(order))
        active = np.searchsorted(-sizes, -np.arange(int(sizes[0]) if len(sizes) else 0), side="left")     # texts longer than t
        now = np.broadcast_to(self.start, (len(order), len(self.start)))
        for t, m in enumerate(active):
            now = (now[:m] @ self.move if t else now[:m]) * emit[symbols[begin[:m] + t]]
            scale = now.sum(1)
            total[:m] += np.log10(scale)
            now = now / scale[:, None]
        out = np.empty(len(order))
        out[order] = total
        return out


def _pieces(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, size and text of each piece: texts of up to LONG tokens whole, others cut every PIECE tokens; empty ones have none."""
    sizes = np.diff(first)
    count = np.where(sizes > LONG, -(-sizes // PIECE), np.minimum(sizes, 1))
    text = np.repeat(np.arange(len(sizes)), count)
    number = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    begin = first[:-1][text] + PIECE * number
    return begin, np.where(sizes[text] > LONG, np.minimum(sizes[text] - PIECE * number, PIECE), sizes[text]), text


def symbol_table(counts: DataFrame, head: int = HEAD) -> Symbols:
    """The `head` most frequent tokens and the totals of TAILS classes come to the driver, whatever the corpus."""
    if head + TAILS > 1 << 16:
        raise ValueError(f"{head} head tokens and {TAILS} classes do not fit in 16 bits.")
    top = counts.orderBy(F.desc("n"), "token").limit(head).toArrow()
    token, n = top.column("token").to_numpy(), top.column("n").to_numpy()
    every = {r["class"]: (r["n"], r["v"]) for r in counts.groupBy("class").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect()}
    kinds = top.column("class").to_numpy()
    sums = np.array([every.get(k, (0, 0)) for k in range(TAILS)], np.int64).reshape(TAILS, 2)
    return Symbols(token.view(np.uint64), n, sums[:, 0] - np.bincount(kinds, n, TAILS).astype(np.int64), sums[:, 1] - np.bincount(kinds, minlength=TAILS))


def written(docs: DataFrame, id_col: str, text_col: str, held: Column, table: Symbols) -> DataFrame:
    """(row, id, held, n_tokens, symbols, tail) per text: its symbols as 16-bit values and its distinct tail tokens with their number."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), held.alias("held"), F.col(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, part in S.chunks(batch.column(3)):
                token, kind, first = tokens(part)
                symbol = shared.value.of(token, kind)
                packed = symbol.astype(np.uint16)
                rare = np.flatnonzero(symbol >= len(shared.value.head))
                owner = np.searchsorted(first, rare, side="right") - 1
                order = np.lexsort((token[rare], owner))
                owner, own = owner[order], token[rare][order]
                new = np.ones(len(own), bool)
                new[1:] = (own[1:] != own[:-1]) | (owner[1:] != owner[:-1])
                at = np.flatnonzero(new)
                times = np.diff(np.append(at, len(own))).astype(np.int32)
                cut = np.searchsorted(owner[at], np.arange(len(part) + 1)).astype(np.int32)
                struct = pa.StructArray.from_arrays([pa.array(own[at].view(np.int64)), pa.array(times)], ["token", "times"])
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k).slice(begin, len(part)) for k in range(3)), pa.array(np.diff(first).astype(np.int64)),
                     pa.array([packed[a:b].tobytes() for a, b in zip(first[:-1], first[1:])], pa.binary()), pa.ListArray.from_arrays(pa.array(cut), struct)],
                    ["row", "id", "held", "n_tokens", "symbols", "tail"])

    kind = rows.schema["id"].dataType.simpleString()
    return cut_lineage(rows.mapInArrow(run, f"row long, id {kind}, held boolean, n_tokens long, symbols binary, tail array<struct<token:long,times:int>>"))


def trained(texts: DataFrame, table: Symbols, states: int = STATES, rounds: int = ROUNDS) -> Chain:
    """Baum-Welch over the training texts of `written`; what comes to the driver per round is one row per symbol and state pair."""
    frequency = table.frequency()
    chain = Chain.first(frequency, states)
    rows = texts.where("not held").select("symbols")
    for _ in range(rounds):
        shared = texts.sparkSession.sparkContext.broadcast(chain)

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums, model, waiting, held = None, shared.value, [], 0

            def add():
                nonlocal sums, held
                first = np.concatenate([[0], np.cumsum([len(w) for w in waiting])])
                found = model.expected(np.concatenate(waiting), first)[:3]
                sums = found if sums is None else [a + b for a, b in zip(sums, found)]
                waiting.clear()
                held = 0

            for batch in batches:
                for packed in batch.column(0).to_pylist():
                    waiting.append(np.frombuffer(packed, np.uint16))
                    held += len(waiting[-1])
                    if held >= RUN:
                        add()
            if waiting:
                add()
            if sums is not None:
                start, moves, emission = sums
                values = np.concatenate([emission.T, moves.T, start[None]])             # one row per symbol, then per target state, then the start
                some = np.flatnonzero(values.any(1))
                yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), *(pa.array(values[some, k].copy()) for k in range(states))],
                                                 ["at", *(f"s{k}" for k in range(states))])

        names = [f"s{k}" for k in range(states)]
        summed = rows.mapInArrow(count, "at int, " + ", ".join(f"{c} double" for c in names)).groupBy("at").agg(*(F.sum(c).alias(c) for c in names)).toArrow()
        values = np.zeros((table.size + states + 1, states))
        if summed.num_rows:
            values[summed.column("at").to_numpy()] = np.column_stack([summed.column(c).to_numpy() for c in names])
        chain = Chain.from_counts(values[-1], values[table.size:-1].T, values[: table.size].T, frequency)
    return chain


def score(docs: DataFrame, held: Column, id_col: str = "doc_id", text_col: str = "text", head: int = HEAD, states: int = STATES,
          rounds: int = ROUNDS) -> DataFrame:
    """(id, held, n_tokens, n_known, train_tokens, base_score, score) of every row; texts with `held` are not learnt from."""
    counts = cut_lineage(counted(docs.where(~held), text_col))
    table = symbol_table(counts, head)
    texts = written(docs, id_col, text_col, held, table)
    chain = trained(texts, table, states, rounds)
    shared = docs.sparkSession.sparkContext.broadcast((table, chain))
    # tail tokens of all texts meet their counts; a token that a third of all texts share is in the head
    rare = texts.select("row", F.explode("tail").alias("one")).select("row", "one.*")
    found = rare.join(counts.select("token", "n"), "token", "left").groupBy("row").agg(
        F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + F.lit(0.5))).alias("tail_log"),
        F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("tail_known"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, chain = shared.value
        head_log = np.log10(np.concatenate([table.counts + 0.5, np.ones(TAILS)]))
        within = np.concatenate([np.zeros(len(table.head)), np.log10(table.tail_n + 0.5 * (table.tail_v + 1))])
        for batch in batches:
            raw = batch.column(4)
            for begin, part in S.chunks(raw, 2 << 20):
                packed = [np.frombuffer(p, np.uint16) for p in part.to_pylist()]
                first = np.concatenate([[0], np.cumsum([len(p) for p in packed])])
                symbols = np.concatenate(packed).astype(np.int64)
                add = lambda x: np.add.reduceat(x[symbols], first[:-1])
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k).slice(begin, len(part)) for k in range(4)), pa.array(add(np.arange(table.size) < len(table.head)).astype(np.int64)),
                     pa.array(add(head_log)), pa.array(chain.log10(symbols, first) - add(within))],
                    ["row", "id", "held", "n_tokens", "head_known", "head_log", "chain_log"])

    kind = texts.schema["id"].dataType.simpleString()
    known = texts.select("row", "id", "held", "n_tokens", "symbols").mapInArrow(
        run, f"row long, id {kind}, held boolean, n_tokens long, head_known long, head_log double, chain_log double")
    spare = np.log10(table.total + 0.5 * (table.types + 1)) if table.total else np.log10(0.5)
    tail = F.coalesce("tail_log", F.lit(0.0))
    return known.join(found, "row", "left").select(
        "id", "held", "n_tokens", (F.col("head_known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"),
        F.lit(table.total).cast("long").alias("train_tokens"), (F.col("head_log") + tail - F.col("n_tokens") * F.lit(float(spare))).alias("base_score"),
        (F.col("chain_log") + tail).alias("score"))
