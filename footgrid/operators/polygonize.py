"""Pixel components to polygon rings.

A boundary edge is one side of a foreground pixel whose other side is background,
directed so that the pixel lies on its right hand (y points down): outer rings
then have positive area and holes negative. Each edge has one successor; at a
corner shared by two pixels the ring stays with its own pixel, which matches
4-connected components.

Rings are traced in two levels as well. Inside a block the edges are strung into
chains and closed rings by a small array helper; only chains that leave their block
are linked by DataFrame pointer doubling.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions import geometry as G
from ..session import cut_lineage, spent
from .components import BLOCK, label_mask, part_pixels
from .stencil import halo_blocks

# start corner and direction of the four sides of pixel (r, c): east, south, west, north
_DX = np.array([1, 0, -1, 0])
_DY = np.array([0, 1, 0, -1])

CHAIN_SCHEMA = ("image {kind}, node long, head long, next long, least long, closed boolean, n_edges long, "
                "area2 long, xs array<long>, ys array<long>")


def _codes(y, x, d):
    """Number of the edge that starts at corner (x, y) in direction d."""
    return (y * (1 << 30) + x) * 4 + d


def _block_edges(r, c, node, br, bc, block):
    """Edges of a block's own pixels with their successor's code."""
    r0, c0 = r.min() - 2, c.min() - 2
    m = np.zeros((r.max() - r0 + 3, c.max() - c0 + 3), dtype=bool)
    m[r - r0, c - c0] = True
    own = (r // block == br) & (c // block == bc)
    return edges_of(m, (r - r0)[own], (c - c0)[own], node[own], int(r0), int(c0))


def edges_of(m, pr, pc, pn, r0: int, c0: int):
    """Edges (y, x, direction, node, successor's code) of the listed pixels of a mask with at least one empty pixel around them;
    ``r0, c0`` is where the mask begins."""
    out = []
    for d in range(4):
        oy, ox = -_DX[d], _DY[d]                 # the pixel across this side
        side = ~m[pr + oy, pc + ox]
        y, x, n = pr[side], pc[side], pn[side]
        sy, sx = y + (d in (2, 3)), x + (d in (1, 2))      # start corner
        fy, fx = y + _DY[d], x + _DX[d]          # next pixel along the side
        ahead = m[fy, fx]
        left = m[fy + oy, fx + ox]               # diagonal pixel beyond it
        turn = np.where(~ahead, 1, np.where(left, 3, 0))
        nd = (d + turn) % 4
        ny, nx = sy + _DY[d], sx + _DX[d]
        out.append(np.stack([sy + r0, sx + c0, np.full(len(y), d), n, _codes(ny + r0, nx + c0, nd)], axis=1))
    e = np.concatenate(out)
    return e[:, 0], e[:, 1], e[:, 2], e[:, 3], e[:, 4]


def _trace_block(pdf: pd.DataFrame, br: int, bc: int, block: int) -> pd.DataFrame:
    return string_edges(*_block_edges(*(pdf[k].to_numpy(np.int64) for k in ("r", "c", "node")), br, bc, block))


def string_edges(y, x, d, node, nxt) -> pd.DataFrame:
    """Edges strung into closed rings and into chains that lead from one missing edge to another."""
    n = len(y)
    if n == 0:
        return pd.DataFrame(columns=["image", "node", "head", "next", "least", "closed", "n_edges", "area2", "xs", "ys"])
    code = _codes(y, x, d)
    order = np.argsort(code)
    pos = np.searchsorted(code, nxt, sorter=order)
    found = order[np.minimum(pos, n - 1)]
    succ = np.where(code[found] == nxt, found, -1)
    pred = np.full(n, -1)
    pred[succ[succ >= 0]] = np.nonzero(succ >= 0)[0]
    # smallest edge around each closed ring: doubling along successors
    ptr, low = np.where(succ >= 0, succ, np.arange(n)), code.copy()
    for _ in range(int(n).bit_length()):
        low = np.minimum(low, low[ptr])
        ptr = ptr[ptr]
    # heads: entries into the block, and the smallest edge of each closed ring
    back = pred.copy()
    ends_open = succ[ptr] < 0
    closed_edge = ~ends_open
    is_head = (pred < 0) | (closed_edge & (low == code))
    back[is_head] = np.nonzero(is_head)[0]
    rank, head = (~is_head).astype(np.int64), back
    for _ in range(int(n).bit_length()):
        rank = rank + rank[head]
        head = head[head]
    seq = np.lexsort((rank, head))
    y, x, d, node, nxt, code = y[seq], x[seq], d[seq], node[seq], nxt[seq], code[seq]
    start = np.nonzero(rank[seq] == 0)[0]
    stop = np.append(start[1:], n)
    corner = np.ones(n, dtype=bool)
    corner[1:] = d[1:] != d[:-1]
    corner[start] = True
    area2 = x * (y + _DY[d]) - (x + _DX[d]) * y
    cum = np.concatenate([[0], np.cumsum(area2)])
    at = [np.nonzero(corner[a:b])[0] + a for a, b in zip(start, stop)]
    return pd.DataFrame({
        "node": node[start], "head": code[start], "next": nxt[stop - 1], "least": np.minimum.reduceat(code, start),
        "closed": closed_edge[seq][start], "n_edges": stop - start, "area2": cum[stop] - cum[start],
        "xs": [x[i].tolist() for i in at], "ys": [y[i].tolist() for i in at]})


def chains(labelled: DataFrame, block: int = BLOCK) -> DataFrame:
    """Edge chains per block of labelled foreground pixels ``(image, r, c, node)``."""
    kind = dict(labelled.dtypes)["image"]
    columns = [f.split()[0] for f in CHAIN_SCHEMA.format(kind=kind).split(", ")]

    def trace(key, pdf):
        out = _trace_block(pdf, int(key[1]), int(key[2]), block)
        out["image"] = key[0]
        return out[columns]

    return (halo_blocks(labelled, 1, block=block).groupBy("image", "_br", "_bc")
            .applyInPandas(trace, CHAIN_SCHEMA.format(kind=kind)))


def _points(xs: str, ys: str):
    return F.zip_with(xs, ys, lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")))


def _link(open_chains: DataFrame, max_rounds: int = 64) -> DataFrame:
    """Ring and order of chains that cross blocks: ``(image, head, ring, back)``.

    Pointer doubling finds the smallest edge of each ring; the ring is then cut
    before the chain holding it and a second doubling counts the chains from each
    chain to the cut (``back``), so a larger ``back`` comes earlier."""
    s = cut_lineage(open_chains.select("image", "head", F.col("next").alias("ptr"), F.col("least").alias("low")))
    for _ in range(max_rounds):
        far = s.select("image", F.col("head").alias("ptr"), F.col("ptr").alias("p2"), F.col("low").alias("l2"))
        step = cut_lineage(s.join(far, ["image", "ptr"]).select(
            "image", "head", F.col("p2").alias("ptr"), F.least("low", "l2").alias("low"),
            (F.col("l2") < F.col("low")).alias("moved")))      # the next round leaves `moved` behind
        spent(s)
        s = step
        if step.where("moved").isEmpty():
            break
    rings = s.select("image", "head", F.col("low").alias("ring"))
    c = open_chains.select("image", "head", "next", "least").join(rings, ["image", "head"])
    first = F.col("least") == F.col("ring")
    firsts = c.where(first).select("image", F.col("head").alias("next"), F.lit(True).alias("_cut"))
    d = cut_lineage(c.join(firsts, ["image", "next"], "left").select(
        "image", "head", "ring", F.when(F.col("_cut"), F.lit(None)).otherwise(F.col("next")).alias("ptr"),
        F.when(F.col("_cut"), 0).otherwise(1).cast("long").alias("back")))
    for _ in range(max_rounds):
        if d.where(F.col("ptr").isNotNull()).isEmpty():
            return d.select("image", "head", "ring", "back")
        far = d.select("image", F.col("head").alias("ptr"), F.col("ptr").alias("p2"), F.col("back").alias("b2"))
        # chains that have reached the cut only pass on; joined by their null pointer they would be one task per image
        on = d.where(F.col("ptr").isNotNull()).join(far, ["image", "ptr"], "left").select(
            "image", "head", "ring", F.col("p2").alias("ptr"),
            (F.col("back") + F.coalesce("b2", F.lit(0))).alias("back"))
        last, d = d, cut_lineage(on.unionByName(d.where(F.col("ptr").isNull())))
        spent(last)
    raise RuntimeError("Ring linking did not settle.")


def polygonize(mask: DataFrame, block: int = BLOCK) -> DataFrame:
    """Rings of the 4-connected components of foreground pixels ``(image, r, c)``.

    Returns ``(image, label, ring_id, ring, area, perimeter, is_hole)``: corner points
    in pixel coordinates (x = column, y = row), starting at the first edge; ``label``
    is the component's first pixel code and ``area`` is signed (negative for holes)."""
    return rings_of(cut_lineage(label_mask(mask, block)), block)


def rings_of(parts: DataFrame, block: int = BLOCK) -> DataFrame:
    """Rings of labelled parts."""
    ch = cut_lineage(chains(part_pixels(parts, "node"), block))
    inside = ch.where("closed").select(
        "image", "node", F.col("head").alias("ring_id"), "n_edges", "area2",
        G.close(_points("xs", "ys")).alias("ring"))
    crossing = ch.where(~F.col("closed"))
    if crossing.isEmpty():
        rings = inside
    else:
        linked = crossing.join(_link(crossing), ["image", "head"])
        ordered = F.array_sort(F.collect_list(F.struct((-F.col("back")).alias("k"), _points("xs", "ys").alias("p"))))
        joined = linked.groupBy("image", F.col("ring").alias("ring_id")).agg(
            F.min("node").alias("node"), F.sum("n_edges").alias("n_edges"), F.sum("area2").alias("area2"),
            ordered.alias("parts"))
        corner = F.floor(F.col("ring_id") / 4).cast("long")
        joined = G.materialize(joined, "ring", G.close(F.flatten(F.transform("parts", lambda s: s.p)))).drop("parts")
        joined = G.materialize(joined, "ring", G.drop_collinear(F.col("ring")))
        joined = G.materialize(joined, "ring", G.start_at(F.col("ring"), corner % (1 << 30), F.floor(corner / (1 << 30))))
        rings = inside.unionByName(joined)
    out = rings.select("image", "node", "ring_id", "n_edges", "area2", "ring")
    named = out.join(parts.select("image", "node", F.col("root").alias("label")), ["image", "node"])
    return named.select(
        "image", "label", "ring_id", "ring", (F.col("area2") / 2).alias("area"),
        F.col("n_edges").cast("double").alias("perimeter"), (F.col("area2") < 0).alias("is_hole"))


def shape_stats(mask: DataFrame, block: int = BLOCK) -> DataFrame:
    """Per component: net area, boundary length and number of rings, without vertices.
    Order-free sums over chains, so no linking rounds are needed."""
    parts = cut_lineage(label_mask(mask, block))
    ch = chains(part_pixels(parts, "node"), block).groupBy("image", "node").agg(
        F.sum("area2").alias("area2"), F.sum("n_edges").alias("n_edges"))
    return (ch.join(parts.select("image", "node", F.col("root").alias("label")), ["image", "node"])
            .groupBy("image", "label")
            .agg((F.sum("area2") / 2).alias("area"), F.sum("n_edges").cast("double").alias("perimeter")))
