"""Quality measures and dataset statistics as aggregates over pixel tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import pixel as P


def _sum(c) -> Column:
    return F.coalesce(F.sum(c), F.lit(0)).cast("long")


def ratio(num, den, digits: int) -> Column:
    """Rounded ratio; NULL for a zero denominator."""
    return F.round(F.try_divide(num.cast("double"), den), digits)


def scores(df: DataFrame, digits: int = 3) -> DataFrame:
    """Ratios from the four sums ``n_intersect, n_pred, n_truth, n_equal`` and the union."""
    i, p, t, eq = (F.col(c) for c in ("n_intersect", "n_pred", "n_truth", "n_equal"))
    u = p + t - i
    return df.select("*", ratio(i, p, digits).alias("precision"), ratio(i, t, digits).alias("recall"),
                     ratio(eq, u + eq - i, digits).alias("accuracy"), ratio(2 * i, p + t, digits).alias("dice"),
                     ratio(i, u, digits).alias("iou"))


def pixel_metrics(df: DataFrame, by: tuple = (), digits: int = 3) -> DataFrame:
    """Precision, recall, accuracy, Dice and IoU of 0/1 columns ``p`` and ``g``,
    micro-averaged over all rows of a group."""
    sums = df.groupBy(*by).agg(
        _sum(F.col("p") * F.col("g")).alias("n_intersect"), _sum("p").alias("n_pred"), _sum("g").alias("n_truth"),
        _sum((F.col("p") == F.col("g")).cast("int")).alias("n_equal"))
    return scores(sums, digits)


def match_masks(truth: DataFrame, pred: DataFrame, keys: list[str], threshold: float = 0.5) -> DataFrame:
    """Truth pixels with their prediction; truth whose tile has no prediction is left out
    of the metrics (see ``pairing.missing``)."""
    return truth.join(pred, keys).withColumn("g", P.is_building(F.col("truth"))) \
        .withColumn("p", P.is_predicted(F.col("pred"), threshold))


def building_share(df: DataFrame, value: str, by: list) -> DataFrame:
    """Share of non-zero pixels per group."""
    return df.groupBy(*by).agg(F.avg((F.col(value) != 0).cast("double")).alias("share"))


def value_share(df: DataFrame, value: str, target: int, by: list) -> DataFrame:
    """Share of pixels equal to one value per group."""
    return df.groupBy(*by).agg(F.avg((F.col(value) == target).cast("double")).alias("share"))


def share_histogram(shares: DataFrame, bins: int = 20) -> DataFrame:
    """Equal-width histogram over the observed range; the top edge belongs to the last bin."""
    span = shares.agg(F.struct(F.min("share").alias("lo"), F.max("share").alias("hi"))).scalar()
    lo, hi = span["lo"], span["hi"]
    width = (hi - lo) / bins
    bin_ = F.when(width == 0, 0).otherwise(F.least(F.floor((F.col("share") - lo) / width), F.lit(bins - 1)))
    return shares.groupBy(bin_.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def class_index(df: DataFrame, value: str) -> DataFrame:
    """``(idx, value)`` of the distinct class codes in ascending order; a code that is no byte (at most 256 are) is an error,
    as it would merge with another one."""
    byte = P.to_byte(F.col(value))
    code = F.when(F.col(value).isNull() | (F.col(value) == byte), byte).otherwise(F.raise_error(F.concat(
        F.lit(f"Class codes in {value} have to be whole numbers from 0 to 255; found "), F.col(value).cast("string"))).cast(df.select(byte.alias("b")).schema["b"].dataType))
    classes = df.agg(F.array_sort(F.collect_set(code)).alias("vs"))
    return classes.select(F.posexplode("vs").alias("idx", "value"))


def confusion(df: DataFrame, truth: str = "label", pred: str = "pred") -> DataFrame:
    return df.groupBy(F.col(truth).alias("label"), F.col(pred).alias("pred")).agg(F.count(F.lit(1)).alias("n"))


def class_scores(conf: DataFrame, digits: int = 6) -> DataFrame:
    """Per-class Dice and Jaccard from confusion counts."""
    flat = conf.select(F.explode(F.array(
        F.struct(F.col("label").alias("cls"), F.col("n").alias("t"), F.lit(0).cast("long").alias("p"),
                 F.when(F.col("label") == F.col("pred"), F.col("n")).otherwise(0).alias("i")),
        F.struct(F.col("pred").alias("cls"), F.lit(0).cast("long").alias("t"), F.col("n").alias("p"),
                 F.lit(0).cast("long").alias("i")))).alias("s")).select("s.*")
    g = flat.groupBy("cls").agg(_sum("t").alias("t"), _sum("p").alias("p"), _sum("i").alias("i"))
    t, p, i = F.col("t"), F.col("p"), F.col("i")
    return g.select("cls", ratio(2 * i, t + p, digits).alias("dice"), ratio(i, t + p - i, digits).alias("jaccard"))


def empty_masks(masks: DataFrame, value: str = "v", by: tuple[str, ...] = ("image",)) -> DataFrame:
    """``(*by, top)`` of the images whose mask has no pixel on; one number per image combines before the shuffle."""
    return masks.groupBy(*by).agg(F.max(value).alias("top")).where("top = 0")


def value_range(df: DataFrame, value: str, by: list) -> DataFrame:
    """Minimum and maximum per image, and whether clipping to bytes would change it."""
    return df.groupBy(*by).agg(F.min(value).alias("vmin"), F.max(value).alias("vmax")) \
        .withColumn("clipped", (F.col("vmin") < 0) | (F.col("vmax") > 255))


def raster_bounds(images: DataFrame) -> DataFrame:
    """World bounding box of each image from its size and affine ``t``."""
    corners = [P.to_world(c, r, F.col("t")) for c, r in
               ((F.lit(0), F.lit(0)), (F.col("width"), F.lit(0)), (F.lit(0), F.col("height")), (F.col("width"), F.col("height")))]
    xs, ys = [c[0] for c in corners], [c[1] for c in corners]
    return images.select("*", F.least(*xs).alias("xmin"), F.least(*ys).alias("ymin"),
                         F.greatest(*xs).alias("xmax"), F.greatest(*ys).alias("ymax"))
