"""Connected components: pixel masks and general graphs.

Masks are labelled in two levels. Inside a block (a bounded square of pixels) a
small array helper labels at once; only components that touch a neighbouring block
become nodes of a graph, which DataFrame rounds then join up. The rounds therefore
shuffle block borders, not pixels.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..session import cut_lineage, spent
from ..skew import attach

BLOCK = 256
ROW = 1 << 32  # pixel code: r * ROW + c


def pixel_code(r, c):
    return r * F.lit(ROW) + c


# --- graphs -----------------------------------------------------------------

def connected(edges: DataFrame, keys: list[str], salts: int = 16, max_rounds: int = 100) -> DataFrame:
    """Smallest reachable node per node: ``edges(*keys, u, v)`` to ``(*keys, node, root)``.

    Each round hooks both the node and its present root to the smallest root seen
    across an edge, then follows root pointers once more; distances shrink by half,
    so the rounds grow with the logarithm of the component diameter. Minima combine
    before the shuffle and pointer look-ups are salted, so a root that owns a third
    of all nodes is no single task. ``salts`` is for the edge look-ups: 1 will do where
    the degree of a node is bounded."""
    e = cut_lineage(edges.select(*keys, "u", "v").where(F.col("u") != F.col("v")).distinct())
    nodes = e.select(*keys, F.col("u").alias("node")).union(e.select(*keys, F.col("v").alias("node"))).distinct()
    state = cut_lineage(nodes.withColumn("root", F.col("node")))
    for _ in range(max_rounds):
        look = lambda end: state.withColumnsRenamed({"node": end, "root": f"r{end}"})
        on_edge = attach(attach(e, look("u"), [*keys, "u"], ["v"], salts=salts),
                         look("v"), [*keys, "v"], ["u"], salts=salts).where(F.col("ru") != F.col("rv"))
        low, high = F.least("ru", "rv"), F.greatest("ru", "rv")
        targets = F.array(F.col("u"), F.col("v"), high)
        hooks = on_edge.select(*keys, F.explode(targets).alias("node"), low.alias("low")) \
            .groupBy(*keys, "node").agg(F.min("low").alias("low"))
        hooked = cut_lineage(state.join(hooks, [*keys, "node"], "left")
                             .select(*keys, "node", F.least("root", "low").alias("root"),
                                     F.col("low").isNotNull().alias("moved")))
        spent(state)
        if hooked.where("moved").isEmpty():
            spent(e)
            return hooked.select(*keys, "node", "root")
        used = hooked.select(*keys, F.col("root").alias("node")).distinct()
        up = hooked.join(used, [*keys, "node"], "left_semi").select(
            *keys, F.col("node").alias("root"), F.col("root").alias("up"))
        # a root may own a third of the nodes whatever the degree of the edges, so this is always salted
        state = cut_lineage(attach(hooked.drop("moved"), up, [*keys, "root"], ["node"])
                            .select(*keys, "node", F.col("up").alias("root")))
        spent(hooked)
    raise RuntimeError(f"Components did not settle in {max_rounds} rounds.")


# --- masks ------------------------------------------------------------------

def _label_grid(mask: np.ndarray) -> np.ndarray:
    """4-connected labels of a small mask: flat index of each component's first pixel."""
    idx = np.arange(mask.size).reshape(mask.shape)
    a = np.concatenate([idx[:, :-1][mask[:, :-1] & mask[:, 1:]], idx[:-1][mask[:-1] & mask[1:]]])
    b = np.concatenate([idx[:, 1:][mask[:, :-1] & mask[:, 1:]], idx[1:][mask[:-1] & mask[1:]]])
    root = idx.ravel().copy()
    while True:
        ra, rb = root[a], root[b]
        if (ra == rb).all():
            return root.reshape(mask.shape)
        low = np.minimum(ra, rb)
        np.minimum.at(root, ra, low)
        np.minimum.at(root, rb, low)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up


PART_SCHEMA = ("image {kind}, node long, n long, rmin long, cmin long, rmax long, cmax long, "
               "border array<long>, px array<long>")


def _label_block(pdf: pd.DataFrame, br: int, bc: int, block: int, limit: int | None) -> pd.DataFrame:
    """One row per component of a block: size, box, the pixel codes on the block's rim,
    and all pixel codes when there are fewer than ``limit``."""
    r, c = pdf["r"].to_numpy(np.int64), pdf["c"].to_numpy(np.int64)
    r0, c0 = r.min(), c.min()
    mask = np.zeros((r.max() - r0 + 1, c.max() - c0 + 1), dtype=bool)
    mask[r - r0, c - c0] = True
    flat = _label_grid(mask)[r - r0, c - c0]
    order = np.argsort(flat, kind="stable")
    r, c, flat = r[order], c[order], flat[order]
    start = np.nonzero(np.diff(flat, prepend=-1))[0]
    n = np.diff(np.append(start, len(flat)))
    code = r * ROW + c
    rim = (r == br * block) | (r == (br + 1) * block - 1) | (c == bc * block) | (c == (bc + 1) * block - 1)
    first = flat[start]
    listed = np.ones(len(n), bool) if limit is None else n < limit
    ends = start + n
    return pd.DataFrame({
        "node": (first // mask.shape[1] + r0) * ROW + first % mask.shape[1] + c0, "n": n,
        "rmin": np.minimum.reduceat(r, start), "cmin": np.minimum.reduceat(c, start),
        "rmax": np.maximum.reduceat(r, start), "cmax": np.maximum.reduceat(c, start),
        "border": [code[a:b][rim[a:b]] for a, b in zip(start, ends)],
        "px": [code[a:b] if keep else None for a, b, keep in zip(start, ends, listed)]})


def label_parts(mask: DataFrame, block: int = BLOCK, limit: int | None = None) -> DataFrame:
    """In-block components of foreground pixels ``(image, r, c)``, named by their first
    pixel. A part of ``limit`` pixels or more travels without its pixel list: callers
    that only want small components never ship the large ones."""
    px = mask.select("image", F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"))
    schema = PART_SCHEMA.format(kind=dict(px.dtypes)["image"])
    columns = [f.split()[0] for f in schema.split(", ")]

    def label(key, pdf):
        out = _label_block(pdf, int(key[1]), int(key[2]), block, limit)
        out["image"] = key[0]
        return out[columns]

    return (px.groupBy("image", F.floor(F.col("r") / block).alias("_br"), F.floor(F.col("c") / block).alias("_bc"))
            .applyInPandas(label, schema))


def border_links(parts: DataFrame, block: int = BLOCK) -> DataFrame:
    """Pairs of in-block components that touch across a block border."""
    rim = parts.select("image", "node", F.explode("border").alias("code"))
    rim = rim.select("image", "node", F.floor(F.col("code") / ROW).alias("r"), (F.col("code") % ROW).alias("c"))

    def side(axis, where, other, shift, name):
        return (rim.where(F.col(axis) % block == where)
                .select("image", (F.col(axis) + shift).alias("_line"), F.col(other).alias("_at"),
                        F.lit(axis).alias("_axis"), F.col("node").alias(name)))

    before = side("r", block - 1, "c", 1, "u").union(side("c", block - 1, "r", 1, "u"))
    after = side("r", 0, "c", 0, "v").union(side("c", 0, "r", 0, "v"))
    return before.join(after, ["image", "_line", "_at", "_axis"]).select("image", "u", "v").distinct()


def label_mask(mask: DataFrame, block: int = BLOCK, limit: int | None = None) -> DataFrame:
    """In-block components with ``root``, the first pixel of the whole component. The
    parts are cut once: the border graph and the result both read them."""
    parts = cut_lineage(label_parts(mask, block, limit))
    roots = connected(border_links(parts, block), ["image"], salts=1)
    return parts.join(roots, ["image", "node"], "left").withColumn("root", F.coalesce("root", "node"))


def part_pixels(parts: DataFrame, *carry) -> DataFrame:
    """Pixels ``(image, r, c, …)`` of the parts that list them."""
    px = parts.where(F.col("px").isNotNull()).select("image", *carry, F.explode("px").alias("_code"))
    return px.withColumn("r", F.floor(F.col("_code") / ROW)).withColumn("c", F.col("_code") % ROW).drop("_code")


def component_sizes(parts: DataFrame) -> DataFrame:
    """Area and bounding box per whole component. A component that covers a huge
    image is many parts: they combine before the shuffle."""
    return parts.groupBy("image", "root").agg(
        F.sum("n").alias("n"), F.min("rmin").alias("rmin"), F.min("cmin").alias("cmin"),
        F.max("rmax").alias("rmax"), F.max("cmax").alias("cmax"))


def components(mask: DataFrame, block: int = BLOCK) -> DataFrame:
    """``(image, r, c, label)``: every foreground pixel with its component's first pixel
    code. Parts meet their root before they unfold to pixels."""
    return part_pixels(label_mask(mask, block), F.col("root").alias("label"))


def small_components(mask: DataFrame, size: int, block: int = BLOCK) -> DataFrame:
    """Pixels ``(image, r, c)`` of the components with fewer than ``size`` pixels."""
    parts = label_mask(mask, block, size)
    sizes = component_sizes(parts).select("image", "root", F.col("n").alias("_n")).where(F.col("_n") < size)
    return part_pixels(attach(parts.where(F.col("n") < size), sizes, ["image", "root"], ["node"]))


def remove_small(mask: DataFrame, min_size: int, block: int = BLOCK) -> DataFrame:
    """Drop components with fewer than ``min_size`` pixels from a foreground pixel table."""
    return mask.join(small_components(mask, min_size, block), ["image", "r", "c"], "left_anti")


def flip(dense: DataFrame, pixels: DataFrame, value: str, to: int) -> DataFrame:
    """Dense raster with the listed pixels set to ``to``; the list is the small side."""
    hit = pixels.select("image", "r", "c", F.lit(True).alias("_flip"))
    return dense.join(hit, ["image", "r", "c"], "left").withColumn(
        value, F.when(F.col("_flip"), to).otherwise(F.col(value))).select(*dense.columns)


def fill_holes(dense: DataFrame, value: str, max_size: int, block: int = BLOCK) -> DataFrame:
    """Dense 0/1 raster whose background components below ``max_size`` pixels become 1."""
    return flip(dense, small_components(dense.where(F.col(value) == 0), max_size, block), value, 1)


# --- run-length form --------------------------------------------------------

def runs(mask: DataFrame) -> DataFrame:
    """Horizontal runs ``(image, r, c0, c1)`` of a foreground pixel table."""
    w = Window.partitionBy("image", "r").orderBy("c")
    return (mask.select("image", "r", "c", (F.col("c") - F.row_number().over(w)).alias("_g"))
            .groupBy("image", "r", "_g").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).drop("_g"))
