"""Joins that survive hot keys.

An image, a settlement or a grid cell may hold a third of all rows. Both helpers
keep every row: a hot key is spread over several tasks, never cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

SALTS = 16
HOT_ROWS = 500_000


def attach(df: DataFrame, table: DataFrame, on: list[str], spread_by: list[str | Column],
           how: str = "inner", salts: int = SALTS, shuffle: bool = False) -> DataFrame:
    """Look up one row of ``table`` per key for the many rows of ``df``.

    ``table`` holds few rows per key (per-image statistics, transforms, roots), so
    it is repeated once per salt, and the rows of one key in ``df`` spread over
    ``salts`` tasks. No broadcast is forced: adaptive execution picks one when the
    measured size of ``table`` allows it. ``shuffle`` rules one out, for rows of ``df`` that are exploded: Spark takes them
    for the few bytes that they come from, and might broadcast them instead."""
    left = df.withColumn("_salt", F.pmod(F.xxhash64(*spread_by), F.lit(salts)).cast("int"))
    right = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right.hint("merge") if shuffle else right, [*on, "_salt"], how).drop("_salt")


def hot_key_join(left: DataFrame, right: DataFrame, on: list[str], spread_by: list[str | Column],
                 hot_rows: int = HOT_ROWS) -> DataFrame:
    """Inner many-to-many equi-join whose hot keys are split by measured size, on both sides.

    A key with more than ``hot_rows`` rows on a side is cut into ceil(rows / hot_rows) shares there; each pair of a left and a
    right share is a key of its own, so left rows are repeated once per right share and the other way round. Keys of one side
    only can't join and are not measured."""
    count = lambda df, name: df.groupBy(*on).agg(F.count(F.lit(1)).alias(name))
    share = lambda n: F.ceil(F.col(n) / hot_rows).cast("int")
    hot = (count(left, "_nl").join(count(right, "_nr"), on).where((F.col("_nl") > hot_rows) | (F.col("_nr") > hot_rows))
           .select(*on, share("_nl").alias("_a"), share("_nr").alias("_b")))

    def dealt(df: DataFrame, key: Column, own: str, shares: str, other: str, others: str) -> DataFrame:
        return df.withColumn(own, F.pmod(key, F.coalesce(shares, F.lit(1))).cast("int")) \
            .withColumn(other, F.explode(F.sequence(F.lit(0), F.coalesce(others, F.lit(1)) - 1))).drop(shares, others)

    l = dealt(attach(left, hot, on, spread_by, "left"), F.xxhash64(*spread_by), "_i", "_a", "_j", "_b")
    r = dealt(attach(right, hot, on, right.columns, "left"), F.xxhash64(*right.columns), "_j", "_b", "_i", "_a")
    return l.join(r.hint("merge"), [*on, "_i", "_j"]).drop("_i", "_j")   # both sides are exploded: their estimates say nothing
