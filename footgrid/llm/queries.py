"""Registered queries of the training-data operators, each over its whole table, and their comparison SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import align, bpe, chat, decontaminate, exact, html, licenses, markov, near, phrases, pii, quality, toxicity

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(fn):
    """Register `fn(spark, sf_dir)` by its name; its comparison SQL, if any, goes into ORACLES beside it."""
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def token_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Token count and digests of the ids and of the decoded text of every row."""
    rows = bpe.encode_decode(docs, bpe.read_vocabulary(path or vocabulary_path()))
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                       F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(table(spark, sf_dir, "documents"))


@query
def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.groups(table(spark, sf_dir, "documents")) \
        .select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


ORACLES["op5_exact_dedup"] = r"""
with d as (select doc_id, length(coalesce(text, '')) as n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) as sha from documents),
g as (select doc_id, sha, first_value(doc_id) over w as keep_id, count(*) over (partition by sha) as group_size
      from d window w as (partition by sha order by n desc, doc_id))
select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha as text_sha256 from g"""


@query
def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.sql("select * from values (-1L, 0L, 'user', '</s>[INST] ok [/INST]'), (-1L, 1L, 'assistant', '</s>[INST] ok [/INST]') "
                      "as t(conv_id, turn, role, text)")
    back = chat.read_back(chat.examples(given.unionByName(probe)))
    said = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.array_join(said, ""), 256).alias("turns_sha256"),
                       F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


ORACLES["op7_chat_format"] = r"""
with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
           union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
p as (select *, sum(20 + length(regexp_replace(role, '([<\[])(\\*/?(?:s>|INST\]))', '\1\\\2', 'g'))
                  + length(regexp_replace(text, '([<\[])(\\*/?(?:s>|INST\]))', '\1\\\2', 'g'))) over (partition by conv_id order by turn, role, text
                  rows unbounded preceding) as stop from c)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
       coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
       (coalesce(sum(stop) filter (role = 'assistant'), 0) + case when coalesce(max(stop) filter (role = 'assistant'), 0) < max(stop)
        then max(stop) else 0 end)::bigint as formatted_chars
from p group by conv_id"""


@query
def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


@query
def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("row").alias("doc_id"), F.col("item").alias("item_id"), F.col("share").alias("containment"))


@query
def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.groups(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


@query
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    machine = toxicity.fit(docs, table(spark, sf_dir, "labels"), use=~toxicity.held_out("id"))
    return toxicity.scores(docs, machine).select(F.col("id").alias("doc_id"), toxicity.held_out("id").alias("held_out"), "score",
                                                 (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op10_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = markov.score(table(spark, sf_dir, "documents"), toxicity.held_out("doc_id", 1))
    return found.withColumnsRenamed({"id": "doc_id", "held": "held_out"})


@query
def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"), "score")


@query
def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    named = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    listed = lambda kinds: F.array_join(F.transform(F.concat(*(pii.tagged(k, k) for k in kinds)), named), ",")
    return found.select(F.col("id").alias("doc_id"), *(F.size(k).cast("long").alias(f"n_{k}") for k in pii.KINDS),
                        F.sha2(listed(pii.KINDS), 256).alias("base_sha256"), listed([*pii.KINDS, "context"]).alias("spans"))


@query
def op12_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(vocabulary_path("piece_bpe_32k.model"), "rb") as f:
        pieces = f.read()
    return align.align(table(spark, sf_dir, "documents"), bpe.read_vocabulary(vocabulary_path()), pieces).withColumnRenamed("id", "doc_id")


@query
def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = lambda c: F.crc32(F.col(c).cast("string").cast("binary")) % 3 == 1
    model = quality.fit(docs, table(spark, sf_dir, "labels"), use=~out("id"))
    return quality.scores(docs, model).select(F.col("id").alias("doc_id"), F.coalesce(out("id"), F.lit(False)).alias("held_out"), "score",
                                              (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


ORACLES["op13_phrases"] = r"""
with t as (select coalesce(lang, 'und') as lang,
                  string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') as pieces from documents),
p as (select lang, unnest(pieces) as piece from t),
w as (select lang, list_filter(string_split_regex(piece, '[ \x09]+'), lambda x: x <> '') as ws from p),
o as (select lang, unnest(ws) as phrase, 1 as k from w
      union all select lang, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])), 2 from w
      union all select lang, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])), 3 from w),
f as (select lang, phrase, k, count(*) as a from o group by all),
n as (select lang, sum(a) as n from f where k = 1 group by lang),
c as (select *, string_split(phrase, ' ') as ws from f where k > 1 and a >= 10),
cuts as (select lang, phrase, k, a, 1 as cut, ws[1] as head, array_to_string(ws[2:], ' ') as rest, ws from c
         union all select lang, phrase, k, a, 2, ws[1] || ' ' || ws[2], ws[3], ws from c where k = 3),
s as (select cuts.*, l.a as l, r.a as r, (1000000::hugeint * cuts.a * cuts.a) // (l.a::hugeint * r.a) as score
      from cuts join f l on l.lang = cuts.lang and l.phrase = head join f r on r.lang = cuts.lang and r.phrase = rest),
low as (select * from s qualify row_number() over (partition by lang, phrase order by score, cut) = 1),
longer as (select lang, part, max(a) as longer from (select lang, a, unnest([ws[1] || ' ' || ws[2], ws[2] || ' ' || ws[3]]) as part from c where k = 3) group by all),
kept as (select low.* from low left join longer on longer.lang = low.lang and part = phrase where longer is null or 100 * longer < 50 * a)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n::bigint as n, score::bigint as score
from kept join n using (lang) qualify rank <= 2000"""
