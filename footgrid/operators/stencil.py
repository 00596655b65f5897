"""Neighbourhood operators on pixel tables.

A raster is cut into square blocks. ``halo_blocks`` sends each pixel to its block
and, near a border, to the blocks whose halo it lies in, and partitions by block.
Every pass after that is a window inside a block: Spark sees that the data is
already partitioned by a subset of the window keys, so a whole chain of operators
costs one shuffle however many passes it has, and a huge image is many blocks.

A value within ``radius`` of a block's outer rim may be wrong after the chain;
``core`` keeps the block interiors, which are right, when the radius is at least
the sum of the radii of the passes.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..skew import attach

BLOCK = 128
B_KEYS = ("_br", "_bc")


def halo_blocks(df: DataFrame, radius: int, keys: tuple[str, ...] = ("image",), block: int = BLOCK, tasks: int | None = None) -> DataFrame:
    """Pixels by block. ``tasks`` is the number of partitions; without it adaptive execution chooses by bytes, which dense pixels
    have few of, so that it sends very many to one task."""
    def reach(axis: str) -> Column:
        v = F.col(axis)
        return F.explode(F.sequence(F.greatest(F.floor((v - radius) / block), F.lit(0)),
                                    F.floor((v + radius) / block)))
    out = df.withColumn("_br", reach("r")).withColumn("_bc", reach("c"))
    return out.repartition(*([tasks] if tasks else []), *keys, *B_KEYS)


def core(df: DataFrame, block: int = BLOCK) -> DataFrame:
    """Drop halo copies, leaving each pixel once."""
    inside = (F.floor(F.col("r") / block) == F.col("_br")) & (F.floor(F.col("c") / block) == F.col("_bc"))
    return df.where(inside).drop(*B_KEYS)


def _across(keys) -> Window:
    return Window.partitionBy(*keys, *B_KEYS, "r").orderBy("c")


def _down(keys) -> Window:
    return Window.partitionBy(*keys, *B_KEYS, "c").orderBy("r")


# --- structuring elements -----------------------------------------------------

def square(k: int) -> dict[int, int]:
    """Row offset -> half width of a k x k square."""
    return {dy: k // 2 for dy in range(-(k // 2), k // 2 + 1)}


def ellipse(k: int) -> dict[int, int]:
    """Row offset -> half width of the k x k elliptical element (k = 3 is a plus)."""
    h = k // 2
    if h == 0:
        return {0: 0}
    return {dy: int(round(h * math.sqrt((h * h - dy * dy) / (h * h)))) for dy in range(-h, h + 1)}


def radius_of(element: dict[int, int]) -> int:
    return max(max(abs(d) for d in element), max(element.values()))


# --- passes inside blocks -------------------------------------------------------

def morph_pass(df: DataFrame, value: str, element: dict[int, int], op: str,
               keys: tuple[str, ...] = ("image",)) -> DataFrame:
    """One erosion (``min``) or dilation (``max``). Neighbours outside the image are
    ignored. Each distinct row width is one horizontal range, each row offset one
    vertical look-up, so any symmetric element costs two in-block sorts."""
    agg, fold = (F.min, F.least) if op == "min" else (F.max, F.greatest)
    widths = sorted(set(element.values()))
    for w in widths:
        src = F.col(value)
        df = df.withColumn(f"_h{w}", agg(src).over(_across(keys).rangeBetween(-w, w)) if w else src)
    down = _down(keys)
    if set(element.values()) == {widths[0]}:
        h = max(element)
        result = agg(F.col(f"_h{widths[0]}")).over(down.rangeBetween(-h, h))
    else:
        terms = [agg(F.col(f"_h{w}")).over(down.rangeBetween(dy, dy)) for dy, w in element.items()]
        result = fold(*terms)
    return df.withColumn(value, result).drop(*[f"_h{w}" for w in widths])


def _beside(value: Column, w: Window, k: int) -> Column:
    """The value exactly ``k`` pixels along the line, null where that pixel is absent."""
    return F.first(value).over(w.rangeBetween(k, k))


def _median3(a: Column, b: Column, c: Column) -> Column:
    return F.greatest(F.least(a, b), F.least(F.greatest(a, b), c))


def median_pass(df: DataFrame, value: str, keys: tuple[str, ...] = ("image",)) -> DataFrame:
    """3 x 3 median; an absent neighbour (border or gap) is stood in for by the pixel next to it on this side. Sorting each row of three
    first leaves the median as median(max of lows, median of mids, min of highs)."""
    a, d = _across(keys), _down(keys)
    v = F.col(value)
    df = df.withColumn("_l", F.coalesce(_beside(v, a, -1), v)).withColumn("_r", F.coalesce(_beside(v, a, 1), v))
    df = df.select(*[c for c in df.columns if c not in ("_l", "_r")],
                   F.least("_l", v, "_r").alias("_lo"), _median3(F.col("_l"), v, F.col("_r")).alias("_mid"),
                   F.greatest("_l", v, "_r").alias("_hi"))

    def three(name: str) -> tuple[Column, Column, Column]:
        x = F.col(name)
        return F.coalesce(_beside(x, d, -1), x), x, F.coalesce(_beside(x, d, 1), x)

    return df.withColumn(value, _median3(F.greatest(*three("_lo")), _median3(*three("_mid")),
                                         F.least(*three("_hi")))).drop("_lo", "_mid", "_hi")


def vote_pass(df: DataFrame, value: str, keys: tuple[str, ...] = ("image",)) -> DataFrame:
    """Per-label 3 x 3 median: the label with at least five of nine votes, else 0."""
    a, d = _across(keys), _down(keys)
    v = F.col(value)
    df = df.withColumn("_row", F.array(F.coalesce(_beside(v, a, -1), v), v, F.coalesce(_beside(v, a, 1), v)))
    row = F.col("_row")
    df = df.withColumn("_nine", F.array_sort(F.concat(
        F.coalesce(_beside(row, d, -1), row), row, F.coalesce(_beside(row, d, 1), row))))
    mid = F.col("_nine")[4]
    won = F.size(F.filter("_nine", lambda x: x == mid)) >= 5
    return df.withColumn(value, F.when(won, mid).otherwise(F.lit(0))).drop("_row", "_nine")


def gauss_kernel(sigma: float, truncate: float = 4.0) -> list[float]:
    """Weights for offsets 0..radius of the normalised kernel."""
    radius = int(truncate * sigma + 0.5)
    raw = [math.exp(-x * x / (2 * sigma * sigma)) for x in range(radius + 1)]
    total = raw[0] + 2 * sum(raw[1:])
    return [w / total for w in raw]


def _reflected(value: str, w: Window, k: int) -> Column:
    """Neighbour at offset ``k``, mirrored about the pixel edge where it is absent (the line ends or has a gap):
    the farthest present one of the nearer neighbours tells how far away that edge is."""
    v, sign, k = F.col(value), (1 if k > 0 else -1), abs(k)

    def at(off: int) -> Column:
        return v if off == 0 else _beside(v, w, off * sign)

    mirrored = [F.when(at(d).isNotNull(), at(2 * d - k + 1)) for d in range(k - 1, -1, -1)]
    return F.coalesce(at(k), *mirrored)


def gauss_pass(df: DataFrame, value: str, sigma: float = 0.5, keys: tuple[str, ...] = ("image",)) -> DataFrame:
    """Separable Gaussian blur, reflected at borders and gaps."""
    kernel = gauss_kernel(sigma)
    for w in (_across(keys), _down(keys)):
        total = F.col(value) * kernel[0]
        for k, weight in enumerate(kernel[1:], start=1):
            total = total + (_reflected(value, w, k) + _reflected(value, w, -k)) * weight
        df = df.withColumn("_g", total).withColumn(value, F.col("_g")).drop("_g")
    return df


def gauss_array(a: np.ndarray, sigma: float = 0.5) -> np.ndarray:
    """``gauss_pass`` on an array in which absent pixels are NaN; right from the kernel's radius on inside its rim."""
    kernel = gauss_kernel(sigma)
    for axis in (1, 0):
        def at(k: int) -> np.ndarray:
            out = np.full_like(a, np.nan)
            if abs(k) < a.shape[axis]:
                to, src = (slice(max(-k, 0), a.shape[axis] - max(k, 0)), slice(max(k, 0), a.shape[axis] + min(k, 0)))
                out[(slice(None),) * axis + (to,)] = a[(slice(None),) * axis + (src,)]
            return out

        near = {k: at(k) for k in range(1 - len(kernel), len(kernel))}

        def reflected(k: int) -> np.ndarray:
            sign, n = (1 if k > 0 else -1), abs(k)
            out = near[k]
            for d in range(n - 1, -1, -1):
                out = np.where(np.isnan(out) & ~np.isnan(near[d * sign]), near[(2 * d - n + 1) * sign], out)
            return out

        total = a * kernel[0]
        for k, weight in enumerate(kernel[1:], start=1):
            total = total + (reflected(k) + reflected(-k)) * weight
        a = total
    return a


# --- array form of a chain ------------------------------------------------------
#
# A long chain in window form sorts a block twice per step. The array form hands each
# halo block (a bounded square) to numpy once and runs the whole chain on it: measured
# on ten million pixels it is several times faster from two steps on. Steps are
# ("min" | "max", element), ("median",), ("vote",) and ("above", threshold).

def _neighbours(a: np.ndarray, offsets, fill) -> list[np.ndarray]:
    h = max(max(abs(dy), abs(dx)) for dy, dx in offsets)
    p = np.pad(a, h, constant_values=fill)
    rows, cols = a.shape
    return [p[h + dy:h + dy + rows, h + dx:h + dx + cols] for dy, dx in offsets]


def _nine(a: np.ndarray, there: np.ndarray) -> np.ndarray:
    """The 3 x 3 neighbours with the stand-ins of the window form: within each row first, then whole rows of three."""
    beside = [np.where(p, n, a) for n, p in zip(_neighbours(a, [(0, -1), (0, 1)], 0), _neighbours(there, [(0, -1), (0, 1)], False))]
    row = [beside[0], a, beside[1]]
    out = list(row)
    for dy in (-1, 1):
        here = _neighbours(there, [(dy, 0)], False)[0]
        out += [np.where(here, _neighbours(x, [(dy, 0)], 0)[0], x) for x in row]
    return np.sort(np.stack(out), axis=0)


def _apply_step(a: np.ndarray, step: tuple, there: np.ndarray) -> np.ndarray:
    """One step on a block; ``there`` marks the pixels that exist, all others are ignored as in the window form."""
    kind = step[0]
    if kind in ("min", "max"):
        offsets = [(dy, dx) for dy, w in step[1].items() for dx in range(-w, w + 1)]
        fold, fill = (np.minimum, np.inf) if kind == "min" else (np.maximum, -np.inf)
        return reduce(fold, _neighbours(np.where(there, a, fill), offsets, fill))
    if kind == "above":
        return (a > step[1]).astype(float)
    nine = _nine(a, there)
    return nine[4] if kind == "median" else np.where((nine == nine[4]).sum(axis=0) >= 5, nine[4], 0.0)


def _step_radius(step: tuple) -> int:
    return {"min": lambda: radius_of(step[1]), "max": lambda: radius_of(step[1]), "above": lambda: 0}.get(step[0], lambda: 1)()


def array_chain(df: DataFrame, value: str, steps: list[tuple], keys: tuple[str, ...] = ("image",), block: int = BLOCK,
                out_type: str | None = None, nonzero_only: bool = False, tasks: int | None = None) -> DataFrame:
    """Run a chain of steps on pixels ``(*keys, r, c, value)`` block by block; absent pixels stay absent."""
    types = dict(df.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in (*keys, "r", "c")) + f", {value} {out_type or types[value]}"
    columns = [*keys, "r", "c", value]
    radius = max(sum(map(_step_radius, steps)), 0)
    nk = len(keys)

    def run(key, pdf):
        r, c = pdf["r"].to_numpy(), pdf["c"].to_numpy()
        r0, c0 = r.min(), c.min()
        a = np.zeros((r.max() - r0 + 1, c.max() - c0 + 1))
        there = np.zeros(a.shape, bool)
        a[r - r0, c - c0] = pdf[value].to_numpy()
        there[r - r0, c - c0] = True
        a = reduce(lambda x, step: _apply_step(x, step, there), steps, a)
        keep = (r // block == key[nk]) & (c // block == key[nk + 1])
        v = a[r - r0, c - c0]
        if nonzero_only:
            keep &= v != 0
        out = pd.DataFrame({"r": r[keep], "c": c[keep], value: v[keep]})
        for i, k in enumerate(keys):
            out[k] = key[i]
        return out[columns]

    return halo_blocks(df.select(*columns), radius, keys, block, tasks).groupBy(*keys, *B_KEYS).applyInPandas(run, schema)


# --- whole operators ------------------------------------------------------------

def _run(df, steps, radius, keys, block, tasks=None):
    b = halo_blocks(df, radius, keys, block, tasks)
    for step in steps:
        b = step(b)
    return core(b, block)


def morphology(df: DataFrame, value: str, chain: list[tuple[str, dict[int, int]]],
               keys: tuple[str, ...] = ("image",), block: int = BLOCK, method: str | None = None, tasks: int | None = None) -> DataFrame:
    """A chain of ``("min"|"max", element)`` steps in one shuffle; absent pixels are ignored wherever they are. ``method`` is
    "scatter" (default for one step, no Python), "array" (default for more), both with the same rows, or "window" for
    rasters without gaps: across a row, a window starts from a pixel that is there, so next to a gap it would miss
    the neighbours beyond it. ``tasks``: see ``halo_blocks``; scattered rows have no use for it."""
    method = method or ("scatter" if len(chain) == 1 else "array")
    if method == "scatter":
        return reduce(lambda d, step: scatter(d, value, step[1], step[0], keys), chain, df)
    if method == "array":
        return array_chain(df, value, chain, keys, block, tasks=tasks)
    radius = sum(radius_of(e) for _, e in chain)
    return _run(df, [lambda b, op=op, e=e: morph_pass(b, value, e, op, keys) for op, e in chain], radius, keys, block, tasks)


def erode(df, value="v", element=None, **kw):
    return morphology(df, value, [("min", element or square(3))], **kw)


def dilate(df, value="v", element=None, **kw):
    return morphology(df, value, [("max", element or square(3))], **kw)


def opening(df, value="v", element=None, **kw):
    e = element or ellipse(3)
    return morphology(df, value, [("min", e), ("max", e)], **kw)


def closing(df, value="v", element=None, **kw):
    e = element or ellipse(3)
    return morphology(df, value, [("max", e), ("min", e)], **kw)


def median3(df, value="v", keys=("image",), block=BLOCK, tasks=None):
    return _run(df, [lambda b: median_pass(b, value, keys)], 1, keys, block, tasks)


def majority3(df, value="v", keys=("image",), block=BLOCK, tasks=None):
    return _run(df, [lambda b: vote_pass(b, value, keys)], 1, keys, block, tasks)


def gauss(df, value="v", sigma=0.5, keys=("image",), block=BLOCK, tasks=None):
    radius = 2 * (len(gauss_kernel(sigma)) - 1)
    return _run(df, [lambda b: gauss_pass(b, value, sigma, keys)], radius, keys, block, tasks)


def scatter(df: DataFrame, value: str, element: dict[int, int], op: str,
            keys: tuple[str, ...] = ("image",)) -> DataFrame:
    """Second form of one erosion or dilation: send each value to its targets and
    aggregate there. Suits sparse pixel tables; ``min``/``max`` combine before the
    shuffle."""
    offsets = F.array(*[F.struct(F.lit(dy).alias("dr"), F.lit(dx).alias("dc"))
                        for dy, w in element.items() for dx in range(-w, w + 1)])
    agg = F.min if op == "min" else F.max
    sent = df.select(*keys, "r", "c", value, F.explode(offsets).alias("o"))
    here = F.max((F.col("o.dr") == 0) & (F.col("o.dc") == 0))
    return (sent.groupBy(*keys, (F.col("r") + F.col("o.dr")).alias("r"), (F.col("c") + F.col("o.dc")).alias("c"))
            .agg(agg(value).alias(value), here.alias("_here")).where("_here").drop("_here"))


# --- sparse masks ---------------------------------------------------------------
#
# Foreground travels as words, ``(image, r, w, bits)``: one row for 64 columns of a pixel row, bit i for column 64 w + i.

WORD = 64


def _shift(bits: Column, n: int) -> Column:
    """Bits moved up by ``n`` places, down if it is negative."""
    if n == 0:
        return bits
    return F.call_function("shiftleft", bits, F.lit(n)) if n > 0 else F.call_function("shiftrightunsigned", bits, F.lit(-n))


def _ones(n: Column) -> Column:
    """The lowest ``n`` bits set, none for less than one, all from 64 on."""
    some = F.call_function("shiftrightunsigned", F.lit(-1).cast("long"), (F.lit(WORD) - F.least(F.greatest(n, F.lit(1)), F.lit(WORD))).cast("int"))
    return F.when(n > 0, some).otherwise(F.lit(0).cast("long"))


def merged(words: DataFrame, *names: str) -> DataFrame:
    """Words of one place as one."""
    return words.groupBy("image", "r", "w").agg(*[F.bit_or(n).alias(n) for n in names or ("bits",)])


def to_words(mask: DataFrame) -> DataFrame:
    """Words of pixels ``(image, r, c)``; repeated pixels count once."""
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("c", F.lit(WORD)).cast("int"))
    return merged(mask.select("image", "r", F.floor(F.col("c") / WORD).cast("int").alias("w"), one.alias("bits")))


def from_words(words: DataFrame) -> DataFrame:
    """Pixels ``(image, r, c)`` of words, one word per place."""
    each = words.select("image", "r", "w", "bits", F.explode(F.sequence(F.lit(0), F.lit(WORD - 1))).alias("_i"))
    return each.where(F.call_function("getbit", "bits", F.col("_i")) == 1).select("image", "r", (F.col("w") * WORD + F.col("_i")).alias("c"))


def word_runs(runs: DataFrame) -> DataFrame:
    """Words of pixel runs ``(image, r, a, b)``, columns ``a`` up to but not ``b``."""
    first, last = F.floor(F.col("a") / WORD).cast("int"), F.floor((F.col("b") - 1) / WORD).cast("int")
    run = runs.select("image", "r", "a", "b", F.explode(F.sequence(first, last)).alias("w"))
    below = lambda end: _ones(F.col(end) - F.col("w") * WORD)
    return merged(run.select("image", "r", "w", below("b").bitwiseAND(F.bitwise_not(below("a"))).alias("bits")))


def _sized(words: DataFrame, sizes: DataFrame) -> DataFrame:
    """The part of the words that lies in its image, with ``width`` and ``height``."""
    out = attach(words, sizes.select("image", "width", "height"), ["image"], ["r", "w"], shuffle=True)
    inside = F.col("bits").bitwiseAND(_ones(F.col("width") - F.col("w") * WORD))
    return out.where((F.col("r") >= 0) & (F.col("w") >= 0) & (F.col("r") < F.col("height"))).withColumn("bits", inside).where("bits <> 0")


def spread_words(words: DataFrame, element: dict[int, int], sizes: DataFrame) -> DataFrame:
    """Dilation of words: each sends what reaches the words around it."""
    sent = []
    for dy, half in element.items():
        parts: dict[int, Column] = {}
        for s in range(-half, half + 1):
            q, m = divmod(s, WORD)
            for d, n in [(q, m)] + ([(q + 1, m - WORD)] if m else []):
                x = _shift(F.col("bits"), n)
                parts[d] = parts[d].bitwiseOR(x) if d in parts else x
        sent += [F.struct((F.col("r") + dy).alias("r"), (F.col("w") + d).alias("w"), x.alias("bits")) for d, x in parts.items()]
    out = words.select("image", F.explode(F.array(*sent)).alias("s")).select("image", "s.*").where("bits <> 0")
    return _sized(merged(out), sizes).select("image", "r", "w", "bits")


def shrink_words(words: DataFrame, element: dict[int, int], sizes: DataFrame) -> DataFrame:
    """Erosion of words, one per place: a pixel stays when every neighbour inside the image is foreground. The element holds its own
    pixel, so none stays where no word is."""
    out = _sized(words, sizes)
    across, down = Window.partitionBy("image", "r").orderBy("w"), Window.partitionBy("image", "w").orderBy("r")
    none, every = F.lit(0).cast("long"), F.lit(-1).cast("long")
    reach = max(element.values())
    near = range(-(reach // WORD) - 1, reach // WORD + 2) if reach else [0]
    for d in near:                                  # pixels beside the image count as foreground
        there = F.when(F.col("w") + d >= 0, _ones(F.col("width") - (F.col("w") + d) * WORD)).otherwise(none)
        bits = _beside(F.col("bits"), across, d) if d else F.col("bits")
        out = out.withColumn(f"_b{d}", F.coalesce(bits, none).bitwiseOR(F.bitwise_not(there)))
    for half in sorted(set(element.values())):
        terms = []
        for s in range(-half, half + 1):
            q, m = divmod(s, WORD)
            x = _shift(F.col(f"_b{q}"), -m)
            terms.append(x.bitwiseOR(_shift(F.col(f"_b{q + 1}"), WORD - m)) if m else x)
        out = out.withColumn(f"_h{half}", reduce(Column.bitwiseAND, terms))
    rows = [F.when((F.col("r") + dy < 0) | (F.col("r") + dy >= F.col("height")), every).otherwise(
        F.coalesce(_beside(F.col(f"_h{half}"), down, dy) if dy else F.col(f"_h{half}"), none)) for dy, half in element.items()]
    kept = reduce(Column.bitwiseAND, rows, F.col("bits"))
    return out.select("image", "r", "w", kept.alias("bits")).where("bits <> 0")


def spread(mask: DataFrame, element: dict[int, int], sizes: DataFrame) -> DataFrame:
    """Dilation of foreground pixels ``(image, r, c)`` alone; work grows with the
    foreground, not the image. ``sizes`` holds ``(image, width, height)``."""
    return from_words(spread_words(to_words(mask), element, sizes))


def shrink(mask: DataFrame, element: dict[int, int], sizes: DataFrame) -> DataFrame:
    """Erosion of foreground pixels alone: a pixel stays when every neighbour inside the
    image is foreground."""
    return from_words(shrink_words(to_words(mask), element, sizes))
