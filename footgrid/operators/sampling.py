"""Seeded samples and splits of exact size without a global sort.

Rows are ordered by a hash of their (unique) key. A histogram over the first 16
hash bits (at most 65,536 rows whatever the input) finds the bucket that holds the
k-th row, one look into that bucket finds the row, and the final pass is a plain
comparison with it: no shuffle of the data, and the same answer on any partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.names import seeded_order


def _first_k(df: DataFrame, key: str, seed: int, k_of_n) -> Column:
    """Condition true for the first k rows in seeded order, ``k = k_of_n(n)``."""
    keyed = df.select(F.col(key).alias("_k"), seeded_order(F.col(key), seed).alias("_h"))
    bucketed = keyed.withColumn("_b", F.conv(F.substring("_h", 1, 4), 16, 10).cast("int"))
    counts = bucketed.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy("_b")                       # at most 65,536 rows
    cum = counts.select("_b", "_n", F.sum("_n").over(w).alias("_cum"),
                        F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_all"))
    at = cum.withColumn("_want", F.least(k_of_n(F.col("_all")), F.col("_all"))) \
        .where((F.col("_cum") >= F.col("_want")) & (F.col("_cum") - F.col("_n") < F.col("_want"))) \
        .select("_b", (F.col("_want") - F.col("_cum") + F.col("_n")).alias("_pos"))
    inside = bucketed.join(F.broadcast(at), "_b")  # one row
    rank = F.row_number().over(Window.partitionBy("_b").orderBy("_h", "_k"))
    last = inside.withColumn("_rn", rank).where(F.col("_rn") == F.col("_pos")).agg(
        F.max(F.struct("_h", "_k")).alias("s")).select("s").scalar()
    here = F.struct(seeded_order(F.col(key), seed).alias("_h"), F.col(key).alias("_k"))
    return F.coalesce(here <= last, F.lit(False))


def sample(df: DataFrame, key: str, k: int, seed: int = 2022) -> DataFrame:
    """Exactly k rows (all rows when there are fewer)."""
    return df.where(_first_k(df, key, seed, lambda n: F.lit(k)))


def split(df: DataFrame, key: str, test_size: float = 0.2, seed: int = 2022, keys: DataFrame | None = None) -> DataFrame:
    """Adds ``is_test``: exactly ceil(test_size * n) rows are test. ``keys``, a table of the same keys, is looked at in place of
    the rows where these are costly to make."""
    return df.withColumn("is_test", _first_k(df if keys is None else keys, key, seed, lambda n: F.ceil(n * F.lit(float(test_size))).cast("long")))


def split_by_threshold(df: DataFrame, key: str, test_size: float = 0.2, seed: int = 2022) -> DataFrame:
    """One-pass split by hash threshold: the size is right in expectation only."""
    u = F.conv(F.substring(seeded_order(F.col(key), seed), 1, 12), 16, 10).cast("double") / float(16 ** 12)
    return df.withColumn("is_test", u < test_size)


def train_valid_test(df: DataFrame, key: str, test_size: float, valid_size: float, seed: int = 2022) -> DataFrame:
    """``part`` in train / valid / test; validation is a share of the training rows."""
    parted = split(df, key, test_size, seed)
    train = parted.where(~F.col("is_test"))
    is_valid = _first_k(train, key, seed + 1, lambda n: F.ceil(n * F.lit(float(valid_size))).cast("long"))
    return parted.withColumn("part", F.when(F.col("is_test"), "test").when(is_valid, "valid").otherwise("train")) \
        .drop("is_test")


def first_n(df: DataFrame, order: list, n: int) -> DataFrame:
    """First n rows of a deterministic order."""
    return df.orderBy(*order).limit(n)
