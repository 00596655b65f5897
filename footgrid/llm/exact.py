"""Exact duplicates by a tree merge of sorted digest runs, with DataFrame operations only.

Every input partition yields one run: per digest the best row and a count. Runs then meet in rounds: in each one `2**FAN_BITS`
neighbouring runs are merged into one, so that after ceil(log_fan(runs)) rounds one run, itself spread over all tasks by digest,
is left. Each level keeps the row that stays and adds the counts, and rows only count as equal if digest, length and a second,
unrelated hash of the normalised text all agree. Decisions go back down the same way, by (run, digest): a text that makes
up a third of all rows is one row per run there, and no task sees more of its rows than one partition holds.

Results: a null text is empty; texts that are equal without white space form a group, and of it the row with the longest original
text, then the smallest id (null last), then the first row stays, so exactly one row stays of repeated rows too; an empty
table gives an empty table; other columns are not read by `groups` and are returned untouched by `keep_first`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage

WHITE = r"[\x20\x09-\x0D]+"
FAN_BITS = 3
KEY = ["sha", "n_plain", "check"]


def numbered(docs: DataFrame, taken: list[str] | None = None) -> tuple[DataFrame, str]:
    """The table, written with a row number whose upper bits are the partition; and the name of that column."""
    name = "row"
    while name in [*docs.columns, *(taken or [])]:
        name += "_"
    return cut_lineage(docs.withColumn(name, F.monotonically_increasing_id())), name


def digests(docs: DataFrame, id_col: str, text_col: str, row: str | None = None) -> DataFrame:
    """Narrow table of one row per document: row number, id, length and the normalised text's digests."""
    text = F.coalesce(text_col, F.lit(""))
    rows = docs.select((F.col(row) if row else F.monotonically_increasing_id()).alias("row"), F.col(id_col).alias("id"),
                       F.char_length(text).alias("n_chars"), F.regexp_replace(text, WHITE, "").alias("plain"))
    return cut_lineage(rows.select("row", "id", "n_chars", F.unhex(F.sha2("plain", 256)).alias("sha"),
                                   F.char_length("plain").alias("n_plain"), F.xxhash64("plain").alias("check")))


def merged(runs: DataFrame) -> DataFrame:
    """One sorted run per value of `run`: the best row and the number of rows of each digest."""
    return runs.groupBy("run", *KEY).agg(F.min("best").alias("best"), F.sum("n").alias("n"))


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row: str | None = None) -> DataFrame:
    """(row, id, keep_id, group_size, kept, sha) for every row of `docs`."""
    rows = digests(docs, id_col, text_col, row).withColumn("run", F.shiftright("row", 33))
    best = F.struct((-F.col("n_chars")).alias("longest"), F.col("id").isNull().alias("no_id"), "id", "row")
    leaves = cut_lineage(merged(rows.select("run", *KEY, best.alias("best"), F.lit(1).cast("long").alias("n"))))
    last = leaves.agg(F.max("run")).first()[0] or 0
    tree = leaves
    for _ in range(-(-int(last).bit_length() // FAN_BITS)):
        tree = merged(tree.withColumn("run", F.shiftright("run", FAN_BITS)))
    root = tree.select(*KEY, F.col("best").alias("keep"), F.col("n").alias("group_size"))
    down = leaves.select("run", *KEY).join(root, KEY)
    return rows.join(down, ["run", *KEY]).select("row", "id", F.col("keep.id").alias("keep_id"), "group_size",
                                                 (F.col("row") == F.col("keep.row")).alias("kept"), "sha")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that stay, with all their columns."""
    docs, row = numbered(docs)
    kept = groups(docs, id_col, text_col, row).where("kept").select(F.col("row").alias(row))
    return docs.join(kept, row, "left_semi").drop(row)
