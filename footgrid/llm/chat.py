"""Chat formatting by prefix-target expansion, with DataFrame operations only.

A conversation becomes one transcript of marked turns; every assistant turn is an example of its own whose text is the transcript up
to its end and whose loss span is that reply alone. Turns after the last reply make one more example without a loss span, so the
last example of a conversation always holds all of it. A turn reads `<s>[INST]role[/INST]text</s>`; control strings within a role or
text get a backslash after their first character (and one more if some are there already), which `unescape` takes off again.

Results: null role or text is empty; turns go by number (null first), then role, then text, so ties and repeated rows have a
fixed order and all stay; rows without conversation id form one conversation; an empty table has no examples; other columns are
not read. The text of one conversation is one value, as its digest needs it whole; conversations are spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

OPEN, MIDDLE, CLOSE = "<s>[INST]", "[/INST]", "</s>"
REPLY = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*/?(?:s>|INST\]))", r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*/?(?:s>|INST\]))", r"$1$2")


def examples(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
             text_col: str = "text") -> DataFrame:
    """(conv_id, example, text, loss_start, loss_end, last): loss offsets in code points, end exclusive; equal if there is no loss."""
    empty = F.lit("")
    rows = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(role_col, empty).alias("role"),
                        F.coalesce(text_col, empty).alias("said"))
    rows = rows.withColumn("body", escape(F.col("said"))) \
        .withColumn("line", F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(MIDDLE), "body", F.lit(CLOSE)))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "said")
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.select("conv_id", "role", "line", F.row_number().over(order).alias("example"), F.char_length("body").alias("n_body"),
                         F.sum(F.char_length("line").cast("long")).over(running).alias("stop"))
    whole = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("example", "line"))).alias("lines"),
                                          F.max("stop").alias("total"), F.max(F.when(F.col("role") == REPLY, F.col("stop"))).alias("newest")) \
        .select(F.col("conv_id").alias("conv"), F.array_join("lines.line", "").alias("transcript"), "total", "newest")
    targets = placed.where(F.col("role") == REPLY).select("conv_id", "example", "stop", "n_body")
    joined = whole.join(targets, F.col("conv").eqNullSafe(F.col("conv_id")), "left")
    closing = F.col("stop") - F.lit(len(CLOSE))
    own = F.struct("example", F.col("stop").alias("size"), (closing - F.col("n_body")).alias("loss_start"), closing.alias("loss_end"))
    tail = F.struct(F.lit(None).cast("int").alias("example"), F.col("total").alias("size"), F.col("total").alias("loss_start"),
                    F.col("total").alias("loss_end"))
    # the row of the last reply (or the only row of a conversation without one) also makes the example of what follows it
    made = joined.withColumn("one", F.explode(F.when(F.col("stop").isNull(), F.array(tail))
                                               .when((F.col("stop") == F.col("newest")) & (F.col("stop") < F.col("total")), F.array(own, tail))
                                               .otherwise(F.array(own))))
    return made.select(F.col("conv").alias("conv_id"), "one.example",
                       F.substring("transcript", F.lit(1), F.col("one.size").cast("int")).alias("text"),
                       F.col("one.loss_start").alias("loss_start"), F.col("one.loss_end").alias("loss_end"),
                       (F.col("one.size") == F.col("total")).alias("last"))


def parsed(text: Column) -> Column:
    """array<struct<role, text>> of the turns of an example, unescaped."""
    pieces = F.filter(F.split(text, CLOSE), lambda p: p != "")
    head = lambda p: F.substring_index(p, MIDDLE, 1)
    return F.transform(pieces, lambda p: F.struct(
        unescape(F.substring(head(p), F.lit(len(OPEN) + 1), F.char_length(head(p)))).alias("role"),
        unescape(F.substring(p, F.char_length(head(p)) + len(MIDDLE) + 1, F.char_length(p))).alias("text")))


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation: its turns and the text under the loss mask, taken from the examples alone."""
    loss = unescape(F.substring("text", (F.col("loss_start") + 1).cast("int"), (F.col("loss_end") - F.col("loss_start")).cast("int")))
    gathered = formatted.select("conv_id", F.when(F.col("last"), F.col("text")).alias("full"), F.col("loss_start").alias("at"), loss.alias("loss"),
                                F.char_length("text").cast("long").alias("n")) \
        .groupBy("conv_id").agg(F.max("full").alias("full"), F.array_sort(F.collect_list(F.struct("at", "loss"))).alias("losses"),
                                F.sum("n").alias("formatted_chars"))
    return gathered.select("conv_id", parsed(F.col("full")).alias("turns"), F.array_join("losses.loss", "").alias("loss"),
                           "formatted_chars")
