"""Segmentation losses as row expressions and aggregates over ``(z ARRAY, label)``.

``z`` are raw class scores. ``LOSSES`` maps a name to a function that takes the
table and returns a one-row DataFrame with the column ``loss``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.pixel import softmax

IGNORE = 255


def with_probs(df: DataFrame) -> DataFrame:
    return df.withColumn("p", softmax(F.col("z")))


def label_prob() -> Column:
    return F.col("p")[F.col("label")]


def cross_entropy_row() -> Column:
    return -F.log(label_prob())


def focal_row(gamma: float = 2.0) -> Column:
    return F.pow(1 - label_prob(), F.lit(gamma)) * cross_entropy_row()


def cross_entropy(df: DataFrame, class_weights: list[float] | None = None) -> DataFrame:
    """Mean cross-entropy; with class weights the weighted mean."""
    d = with_probs(df)
    if class_weights is None:
        return d.agg(F.avg(cross_entropy_row()).alias("loss"))
    w = F.array(*[F.lit(float(x)) for x in class_weights])[F.col("label")]
    return d.agg((F.sum(cross_entropy_row() * w) / F.sum(w)).alias("loss"))


def focal(df: DataFrame, gamma: float = 2.0) -> DataFrame:
    return with_probs(df).agg(F.avg(focal_row(gamma)).alias("loss"))


def dice_terms(df: DataFrame, n_classes: int, smooth: float = 1.0, tile: str = "tile") -> DataFrame:
    """``(tile, cls, loss)``: soft Dice loss per tile and class."""
    d = with_probs(df)
    sums = d.groupBy(tile).agg(*[x for k in range(n_classes) for x in (
        F.sum(F.when(F.col("label") == k, F.col("p")[k]).otherwise(0.0)).alias(f"i{k}"),
        F.sum(F.col("p")[k] + (F.col("label") == k).cast("double")).alias(f"u{k}"))])
    terms = F.array(*[F.struct(F.lit(k).alias("cls"),
                               (1 - (2 * F.col(f"i{k}") + smooth) / (F.col(f"u{k}") + smooth)).alias("loss"))
                      for k in range(n_classes)])
    return sums.select(tile, F.explode(terms).alias("s")).select(tile, "s.*")


def dice(df: DataFrame, n_classes: int = 3, smooth: float = 1.0, reduction: str = "sum") -> DataFrame:
    agg = {"sum": F.sum, "mean": F.avg}[reduction]
    return dice_terms(df, n_classes, smooth).agg(agg("loss").alias("loss"))


def _plus_dice(row_loss: DataFrame, df: DataFrame, alpha: float, **kw) -> DataFrame:
    parts = row_loss.select("loss").union(dice(df, **kw).select((F.col("loss") * alpha).alias("loss")))
    return parts.agg(F.sum("loss").alias("loss"))


def focal_dice(df: DataFrame, alpha: float = 1.0, **kw) -> DataFrame:
    return _plus_dice(focal(df), df, alpha, **kw)


def cross_entropy_dice(df: DataFrame, alpha: float = 1.0, class_weights=None, **kw) -> DataFrame:
    return _plus_dice(cross_entropy(df, class_weights), df, alpha, **kw)


def weighted_cross_entropy(df: DataFrame, weight: str = "w") -> DataFrame:
    """Cross-entropy times a per-pixel weight, averaged over pixels."""
    return with_probs(df).agg(F.avg(cross_entropy_row() * F.col(weight)).alias("loss"))


def weighted_cross_entropy_dice(df: DataFrame, alpha: float = 1.0, weight: str = "w", **kw) -> DataFrame:
    return _plus_dice(weighted_cross_entropy(df, weight), df, alpha, **kw)


def dual_focal_row(eps: float = 1e-5) -> Column:
    gaps = F.transform("p", lambda p, k: p - F.when(k == F.col("label"), 1.0).otherwise(0.0))
    return -F.aggregate(gaps, F.lit(0.0), lambda a, g: a + F.log(eps + 1.0 - g * g))


def dual_focal(df: DataFrame, eps: float = 1e-5, reduction: str = "mean", ignore: int = IGNORE) -> DataFrame:
    """Penalises every class by its distance to the one-hot target; ``ignore`` labels drop out."""
    agg = {"sum": F.sum, "mean": F.avg}[reduction]
    return with_probs(df.where(F.col("label") != ignore)).agg(agg(dual_focal_row(eps)).alias("loss"))


LOSSES = {
    "cross_entropy": cross_entropy, "focal": focal, "dice": dice, "focal_dice": focal_dice,
    "cross_entropy_dice": cross_entropy_dice, "weighted_cross_entropy": weighted_cross_entropy,
    "weighted_cross_entropy_dice": weighted_cross_entropy_dice, "dual_focal": dual_focal,
}
