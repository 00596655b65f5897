"""Alignment of two tokenizers against plain Python, and the containers of the pair index."""

import hashlib
from collections import Counter

import numpy as np
import pytest

from footgrid.llm import align, bpe, queries

KINDS = "doc_id long, text string"
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def files():
    with open(queries.vocabulary_path("piece_bpe_32k.model"), "rb") as f:
        return bpe.read_vocabulary(queries.vocabulary_path()), f.read()


def brute(texts, files):
    """[(n_a, n_b, n_groups, n_links, n_best, count_sum, digest)] of all texts, token by token."""
    import sentencepiece
    from tokenizers import Tokenizer
    a = Tokenizer.from_str(files[0])
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_proto=files[1])
    letter = {c: i for i, c in enumerate(bpe.byte_letters())}
    done, links = [], []
    for text in texts:
        ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        said_a = [bytes(letter[c] for c in a.id_to_token(i)) for i in ids_a]
        said_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        if not text or not b"".join(said_a) == b"".join(said_b) == b" " + text.encode():
            ids_a = ids_b = said_a = said_b = []
        spans_a, spans_b = ([(sum(map(len, s[:k])), sum(map(len, s[: k + 1]))) for k in range(len(s))] for s in (said_a, said_b))
        shared = sorted({e for _, e in spans_a} & {e for _, e in spans_b})
        group = [",".join(str(i) for i, (_, e) in zip(ids_a, spans_a) if lo < e <= hi) + "|" + ",".join(str(i) for i, (_, e) in zip(ids_b, spans_b) if lo < e <= hi)
                 for lo, hi in zip([0, *shared], shared)]
        links.append([(i, j) for i, (s, e) in zip(ids_a, spans_a) for j, (u, v) in zip(ids_b, spans_b) if s < v and u < e])
        done.append((len(ids_a), len(ids_b), len(shared), hashlib.sha256(";".join(group).encode()).hexdigest() if group else ""))
    count = Counter(x for many in links for x in many)
    top = {}
    for (_, j), n in count.items():
        top[j] = max(n, top.get(j, 0))
    return [(na, nb, ng, len(many), sum(count[x] == top[x[1]] for x in many), sum(count[x] for x in many), digest)
            for (na, nb, ng, digest), many in zip(done, links)]


TEXTS = ["plain words, and more words", "", None, "<|endoftext|> and <s> </s> <unk> stay text", "two  spaces\n\nlines\ttabs \x00", " leading", "▁ is lost",
         "ümläute — 漢字 🙂 ͸", "a" * 300, "plain words, and more words", "1234567890 12.5%", "　wide", "é combining", "tail "]


def rows(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


def test_like_plain_python(spark, files):
    frame = spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)], KINDS)
    got = align.align(frame, *files).withColumnRenamed("id", "doc_id").select(COLUMNS)
    assert rows(got) == sorted([(k, *r) for k, r in enumerate(brute(TEXTS, files))], key=str)


def test_small_blocks_and_dense_containers(spark, files, monkeypatch):
    """Many copies: bitmaps instead of lists; blocks of few texts: counts still add up over all of them."""
    texts = [["one and the same", "another text", "one one one one one"][k % 3] for k in range(4000)]
    frame = spark.createDataFrame(list(enumerate(texts)), KINDS).repartition(3)
    expected = dict(zip(texts, brute(texts, files)))
    got = align.align(frame, *files).collect()
    assert len(got) == 4000 and all(tuple(r)[1:] == expected[texts[r.id]] for r in got)


def test_quick_encoder_agrees_on_every_character_it_is_used_for(files):
    t = align.tokenizers(*files)
    for begin in range(0, 0x110000, 64):
        block = [chr(c) for c in range(begin, begin + 64) if not 0xD800 <= c < 0xE000]
        text = "".join(f"a{c}1{c} {c}" for c in block if t.plain(c))
        assert t.quick.encode_ordinary(text) == t.a.encode(text, add_special_tokens=False).ids
    assert not t.plain("x" * align.LONG) and not t.plain("x" + " \n" * align.LONG) and t.plain("plain words " * 500) and t.plain("a  b " * 500)


def test_containers_round_trip():
    rng = np.random.default_rng(1)
    for sizes in ([3, 1, 5], [align.DENSE - 1, align.DENSE, align.BLOCK_ROWS, 1]):
        parts = [np.sort(rng.choice(align.BLOCK_ROWS, n, replace=False)) for n in sizes]
        bits = align.containers(np.concatenate(parts), np.concatenate([[0], np.cumsum(sizes)]))
        slots, counts = align.slots_of(bits)
        assert counts.tolist() == sizes and (slots == np.concatenate(parts)).all()


def test_planes_hold_the_number_of_links():
    block = align.Block()
    pair, slot = np.repeat([7, 7, 9], [5, 1, 2]), np.repeat([0, 3, 3], [5, 1, 2])
    block.add(pair, slot, 4)
    found = {(p, plane): s for pairs, plane, n, bits in block.postings() for p, s in zip(pairs.tolist(), [align.slots_of(bits.slice(i, 1))[0].tolist() for i in range(len(pairs))])}
    assert found == {(7, -1): [0, 3], (9, -1): [3], (7, 2): [0], (9, 0): [3]}


def test_empty_table_repeated_ids_extra_columns_long_text(spark, files):
    assert align.align(spark.createDataFrame([], KINDS), *files).count() == 0
    long_text = "many words make a very long text " * 60_000
    frame = spark.createDataFrame([(1, "same id", 1, 2, 3), (1, "same id", 1, 2, 3), (None, "no id", 1, 2, 3), (2, long_text, 1, 2, 3)],
                                  "doc_id long, text string, block long, pair long, slot int")
    got = align.align(frame, *files).collect()
    assert len(got) == 4 and sum(r.n_a for r in got if r.id == 1) == 2 * brute(["same id"], files)[0][0]
    long_row = next(r for r in got if r.id == 2)
    assert long_row.n_links == long_row.n_a + long_row.n_b - long_row.n_groups > 400_000


def test_query(spark, sf, files):
    frame = queries.QUERIES["op12_align"](spark, sf)
    assert frame.columns == COLUMNS
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    few = [i for i, t in docs.items() if len(t or "") < 3000]
    got = {r.doc_id: r for r in frame.collect()}
    assert set(got) == set(docs)
    for i, r in zip(few, brute([docs[i] for i in few], files)):
        assert (got[i].n_a, got[i].n_b, got[i].n_groups, got[i].n_links, got[i].groups_sha256) == (*r[:4], r[6])
