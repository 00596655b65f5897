"""Personal data: base patterns, and bootstrapped contextual extraction of identifiers no pattern knows, with DataFrame operations only.

Base spans (email, ip, card, phone) seed a bipartite graph. Its instances are identifier-like tokens (with a digit or an at sign) and
the seeds themselves; its patterns are lexical contexts, the word before and the word after (whole words of up to BLOCK characters). Rounds of sums over the graph score both sides:
a pattern by the scores of its distinct instances over all that it extracts, which counts each different text where its word stands
at all (copies once, as the values they hold), so that words that are everywhere score near zero however many seeds they meet; an
instance by the chance that one of its patterns is right (noisy or), if MIN_PATTERNS of them are trusted at all or seeds alone make
one SURE, as at the start or end of a text there is no second one. Patterns that MIN_SEEDS distinct seeds induced and that score high enough discover
instances, whose places become spans of the kind `context`.

Base patterns are written so that each one is tried once per run of its characters: no backtracking or rescanning, and equal to leftmost
non-overlapping search. Offsets are code points, end exclusive.

Results: null and empty texts have no spans; rows are told apart by number, so repeated rows give repeated rows, while the graph counts
distinct values; a context span never overlaps a base span; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut_lineage
from ..skew import attach
from .licenses import let

# What the base kinds look like. Lookbehind and \G let a match begin only where a run of its characters, or the rest
# of one after the match before, begins; possessive quantifiers never give back.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
TOKEN = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"
KINDS = ["email", "ip", "card", "phone"]
SPAN = "array<struct<start:int,end:int>>"

ROUNDS = 3
MIN_SEEDS = 5
MIN_PATTERN = 0.5
MIN_INSTANCE = 0.85
SURE = 0.9                                     # trust by seeds alone from which one pattern is enough
MIN_PATTERNS = 2                               # patterns that have to speak for an instance, so that one common word can't drift
BLOCK = 4096                                   # code points; the word next to a span is looked for in its blocks and one more on either side
CHUNK = 64                                     # matches whose lengths are added up at once


def digits_of(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    size = F.char_length(digits)
    value = lambda i: F.substring(digits, size - i, F.lit(1)).cast("int")  # noqa: E731  (i from 0, from the right)
    double = lambda v: F.when(v > 4, v * 2 - 9).otherwise(v * 2)
    total = F.aggregate(F.sequence(F.lit(0), size - 1), F.lit(0), lambda a, i: a + F.when(i % 2 == 1, double(value(i))).otherwise(value(i)))
    return total % 10 == 0


def good_card(match: Column) -> Column:
    digits = digits_of(match)
    return F.when(F.char_length(digits).between(16, 19), luhn(digits)).otherwise(F.lit(False))


def good_ip(match: Column) -> Column:
    small = lambda p: F.when(F.char_length(F.ltrim(p, F.lit("0"))) <= 3, F.concat(F.lit("0"), F.ltrim(p, F.lit("0"))).cast("int") <= 255).otherwise(F.lit(False))
    return F.forall(F.split(match, r"\."), small)


def good_phone(match: Column) -> Column:
    return F.char_length(digits_of(match)).between(8, 15)


def spans(text: Column, pattern: str, good=None) -> Column:
    """Start and end of each match that is `good`: gaps and matches alternate, so their lengths add up to the places."""
    gap_match = F.zip_with(F.split(text, pattern), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
                           lambda g, m: F.struct(F.char_length(g).alias("gap"), F.coalesce(F.char_length(m), F.lit(0)).alias("size"), m.alias("match")))
    nothing = F.array().cast(SPAN)

    def step(a, x):
        start = a["at"] + x["gap"]
        one = F.array(F.struct(start.alias("start"), (start + x["size"]).alias("end")))
        keep = x["match"].isNotNull() & (good(x["match"]) if good else F.lit(True))
        return F.struct((start + x["size"]).alias("at"), F.when(keep, F.concat(a["found"], one)).otherwise(a["found"]).alias("found"))

    def placed(all_: Column) -> Column:
        """Chunk by chunk, each from where the chunks before it end, so that no long array is copied match by match."""
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / CHUNK).cast("int")), lambda k: F.slice(all_, k * CHUNK + 1, F.lit(CHUNK)))

        def from_ends(cs: Column) -> Column:
            sums = F.transform(cs, lambda c: F.aggregate(c, F.lit(0), lambda a, x: a + x["gap"] + x["size"]))
            begin = F.aggregate(sums, F.array(F.lit(0)), lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n)))
            return F.flatten(F.zip_with(cs, F.slice(begin, F.lit(1), F.size(cs)), lambda c, at: F.aggregate(
                c, F.struct(at.alias("at"), nothing.alias("found")), step, lambda a: a["found"])))

        return let(chunks, from_ends)

    return let(gap_match, placed)


def base(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, id, text, email, ip, card, phone), written; text is null and all spans empty where nothing can be."""
    text = F.coalesce(text_col, F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.when(text.rlike("[0-9@]"), text).alias("text"))
    none = F.array().cast(SPAN)
    found = {"email": ("@", EMAIL, None), "ip": (r"[0-9]\.[0-9]", IP, good_ip), "card": ("[0-9][ -]?[0-9]", CARD, good_card), "phone": (r"\+[0-9]", PHONE, good_phone)}
    return cut_lineage(rows.select("row", "id", "text", *(
        F.coalesce(F.when(F.col("text").rlike(hint), spans(F.col("text"), pattern, good)), none).alias(kind) for kind, (hint, pattern, good) in found.items())))


def tagged(spans_col: str, kind: str) -> Column:
    return F.transform(spans_col, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def _beside(blocks: Column, s: Column) -> Column:
    """A span with its text and the words before and after it, bare of all but letters and digits; only the blocks around it are put together."""
    first, last = F.floor(s["start"] / BLOCK).cast("int"), F.floor((s["end"] - 1) / BLOCK).cast("int")
    begin = F.greatest(first - 1, F.lit(0))
    bare = lambda w: F.lower(F.regexp_replace(w, r"[^\p{L}\p{N}]", ""))

    def read(here: Column) -> Column:
        start, end = s["start"] - begin * BLOCK, s["end"] - begin * BLOCK
        left, right = F.substring(here, F.lit(1), start), F.substring(here, end + 1, F.char_length(here))
        close = F.regexp_extract(F.substring(here, F.greatest(start - 63, F.lit(1)), F.least(start, F.lit(64))), r"\s(\S+)\s*$", 1)
        before = F.when(close != "", close).otherwise(F.regexp_extract(left, r"(?:^|\s)(\S+)\s*$", 1))
        return F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.substring(here, start + 1, s["end"] - s["start"]).alias("value"),
                        bare(before).alias("before"), bare(F.regexp_extract(right, r"^\s*(\S+)", 1)).alias("after"))

    return let(F.array_join(F.slice(blocks, begin + 1, last - begin + 2), ""), read)


def _apart(tokens: Column, seeds: Column, blocks: Column) -> Column:
    """Tokens that overlap no seed; each one looks at the seeds of its own blocks."""
    meets = lambda s, a, b: (s["start"] < b) & (a < s["end"])
    by_block = F.transform(F.sequence(F.lit(0), F.size(blocks) - 1), lambda k: F.filter(seeds, lambda s: meets(s, k * BLOCK, (k + 1) * BLOCK)))

    def free(groups: Column) -> Column:
        def near(t):
            first, last = F.floor(t["start"] / BLOCK).cast("int"), F.floor((t["end"] - 1) / BLOCK).cast("int")
            return F.slice(groups, first + 1, last - first + 1)
        return F.filter(tokens, lambda t: ~F.exists(near(t), lambda g: F.exists(g, lambda s: meets(s, t["start"], t["end"]))))

    return F.when(F.size(seeds) == 0, tokens).otherwise(let(by_block, free))


def occurrences(told: DataFrame) -> DataFrame:
    """(row, kind, start, end, value, before, after) of all base spans and of identifier-like tokens apart from them."""
    rows = told.where("text is not null and text <> ''").select("row", F.concat(*(tagged(k, k) for k in KINDS)).alias("seeds"), spans(F.col("text"), TOKEN).alias("tokens"),
                                                                F.regexp_extract_all("text", F.lit(rf"(?s).{{1,{BLOCK}}}"), F.lit(0)).alias("blocks"))
    told_apart = F.concat("seeds", _apart(tagged("tokens", "context"), F.col("seeds"), F.col("blocks")))
    found = let(F.col("blocks"), lambda bs: F.transform(told_apart, lambda s: _beside(bs, s)))
    return rows.select("row", F.explode(found).alias("one")).select("row", "one.*")


def scored(found: DataFrame, docs: DataFrame, text_col: str, rounds: int = ROUNDS) -> DataFrame:
    """(value, score) of the identifier-like tokens that patterns speak for."""
    sides = [found.select("row", "value", (F.col("kind") != "context").alias("seed"), F.concat(F.lit(tag), F.col(side)).alias("pattern"))
             .where(F.char_length(side) >= 2) for tag, side in (("<", "before"), (">", "after"))]
    links = cut_lineage(reduce(DataFrame.unionByName, sides).groupBy("pattern", "value").agg(F.max("seed").alias("seed")))
    induced = links.groupBy("pattern").agg(F.count_if("seed").alias("seeds"), F.count(F.lit(1)).alias("instances")).where(F.col("seeds") >= MIN_SEEDS)
    induced = cut_lineage(induced.withColumn("word", F.substring("pattern", 2, 1 << 20)))
    if induced.isEmpty():
        return links.select("value", F.lit(0.0).alias("score")).limit(0)
    # in how many different texts each word stands: what a pattern extracts besides identifiers counts against it
    plain = F.split(F.lower(F.regexp_replace(F.coalesce(text_col, F.lit("")), r"[^\p{L}\p{N}\s]", "")), r"\s+")
    met = docs.select(F.xxhash64(text_col).alias("digest"), F.explode(F.array_distinct(plain)).alias("word"))
    texts = met.join(induced.select("word").distinct(), "word").distinct().groupBy("word").agg(F.count(F.lit(1)).alias("texts"))
    patterns = induced.join(texts, "word").select("pattern", "seeds", F.greatest("instances", "texts").alias("extracts"))
    patterns = cut_lineage(patterns.select("pattern", "extracts", (F.col("seeds") / (F.col("extracts") + 1) >= SURE).alias("sure")))
    graph = cut_lineage(attach(links, patterns, ["pattern"], ["value"]))
    known = graph.withColumn("score", F.col("seed").cast("double"))
    for _ in range(rounds):
        trust = known.groupBy("pattern").agg((F.sum("score") / (F.first("extracts") + 1)).alias("trust"), F.first("sure").alias("sure"))
        values = attach(graph.select("pattern", "value", "seed"), trust, ["pattern"], ["value"]).groupBy("value").agg(
            F.when(F.max("seed"), 1.0).when((F.count_if(F.col("trust") >= MIN_PATTERN) < MIN_PATTERNS) & ~F.max("sure"), 0.0).otherwise(1 - F.exp(F.sum(F.log(1 - F.when(F.col("trust") >= MIN_PATTERN, F.col("trust")).otherwise(0.0))))).alias("score"),
            F.max("seed").alias("seed"))
        values = cut_lineage(values)
        known = graph.join(values.select("value", "score"), "value")
    return values.where(~F.col("seed") & (F.col("score") >= MIN_INSTANCE)).select("value", "score")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, email, ip, card, phone, context) of every row, each an array of spans."""
    told = base(docs, id_col, text_col)
    found = cut_lineage(occurrences(told))
    best = scored(found, docs, text_col)
    more = attach(found.where("kind = 'context'"), best, ["value"], ["row", "start"]) \
        .groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("context"))
    return told.drop("text").join(more, "row", "left").select("id", *KINDS, F.coalesce("context", F.array().cast(SPAN)).alias("context"))
