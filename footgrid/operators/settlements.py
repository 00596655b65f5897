"""Settlement groups, shared directions and building-to-settlement assignment."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions import geometry as G, offset
from ..session import cut_lineage
from ..skew import attach
from .components import connected
from .spatial_join import box_pairs


def tile_links(membership: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Edges between settlements that share a tile, one per settlement and tile: each
    links to the smallest settlement of the tile. The links connect the same groups
    as all pairs would, and grow with the memberships instead of their square."""
    low = membership.groupBy(*keys, "tile").agg(F.min("aoi").alias("first"))
    return (attach(membership, low, [*keys, "tile"], ["aoi"]).where(F.col("aoi") != F.col("first"))
            .select(*keys, F.col("aoi").alias("u"), F.col("first").alias("v")).distinct())


def groups(membership: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """``(aoi, group)``: settlements joined through shared tiles; a group carries its
    smallest settlement key."""
    roots = connected(tile_links(membership, keys), list(keys))
    everyone = membership.select(*keys, F.col("aoi").alias("node")).distinct()
    return everyone.join(roots, [*keys, "node"], "left").select(
        *keys, F.col("node").alias("aoi"), F.coalesce("root", "node").alias("group"))


def group_names(grouped: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Report of each group: joined key text and size."""
    return grouped.groupBy(*keys, "group").agg(
        F.array_join(F.transform(F.array_sort(F.collect_set("aoi")), lambda k: k.cast("string")), "_").alias("aoi_group"),
        F.count_distinct("aoi").alias("n_aois"))


def group_tiles(grouped: DataFrame, membership: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """``(group, tile)`` pairs: the tiles a settlement group covers."""
    return (attach(membership, grouped, [*keys, "aoi"], ["tile"]).select(*keys, "group", "tile").distinct())


def _clipped(p: np.ndarray, box: tuple[float, float, float, float]) -> np.ndarray:
    """Part of an open ring within a box; bridges along the box's border enclose nothing."""
    for axis, at, sign in ((0, box[0], 1), (0, box[2], -1), (1, box[1], 1), (1, box[3], -1)):
        if not len(p):
            break
        q = np.roll(p, -1, 0)
        d, e = sign * (p[:, axis] - at), sign * (q[:, axis] - at)
        t = np.where((d >= 0) != (e >= 0), d / np.where(d == e, 1, d - e), 0)[:, None]
        cross = p + t * (q - p)
        cross[:, axis] = at
        both = np.stack([cross, q], 1).reshape(-1, 2)
        p = both[np.stack([(d >= 0) != (e >= 0), e >= 0], 1).ravel()]
    return p


_PART = "area double, length double, sides array<struct<axis:int,line:long,at:long,side:int,lo:double,hi:double>>"


def dissolve(polys: DataFrame, keys: tuple[str, ...], cell: float) -> DataFrame:
    """``(*keys, area, perimeter)`` of the union of each key's rings ``(*keys, ring)``, of any simple shape, overlapping parts counted once.

    Rings meet in the cells of a grid, where they are clipped and united exactly (`offset.positive`), so a group's work is spread
    over its cells; what of a cell's outline lies on the cell's border counts where the neighbour does not cover it too. Equal rings
    collapse first."""
    from .spatial_join import with_bounds
    kinds = dict(polys.dtypes)
    once = polys.groupBy(*keys, G.ring_key(F.col("ring")).alias("_k")).agg(F.first("ring").alias("ring")).drop("_k")
    span = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / cell), F.floor(F.col(hi) / cell)))
    spread = with_bounds(once).withColumn("_cx", span("xmin", "xmax")).withColumn("_cy", span("ymin", "ymax")).select(*keys, "_cx", "_cy", "ring")
    n = len(keys)

    def unite(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        cx, cy = key[n].as_py(), key[n + 1].as_py()
        box = (cx * cell, cy * cell, (cx + 1) * cell, (cy + 1) * cell)
        curves = []
        for ring in group.column("ring").to_pylist():
            p = offset._open(np.array([(q["x"], q["y"]) for q in ring], float))
            p = p[::-1] if len(p) > 2 and offset.signed_area(p) < 0 else p
            p = _clipped(p, box)
            if len(p) > 2 and abs(offset.signed_area(p)) > 1e-12 * cell * cell:
                curves.append(p)
        rings = offset.positive(curves) if curves else []
        length, sides = 0.0, []
        for r in rings:
            q = np.roll(r, -1, 0)
            for (x1, y1), (x2, y2) in zip(r.tolist(), q.tolist()):
                near = lambda v, w, at: abs(v - at) < 1e-7 * cell and abs(w - at) < 1e-7 * cell
                if near(x1, x2, box[0]) or near(x1, x2, box[2]):
                    right = int(near(x1, x2, box[2]))
                    sides.append({"axis": 0, "line": cx + right, "at": cy, "side": right, "lo": min(y1, y2), "hi": max(y1, y2)})
                elif near(y1, y2, box[1]) or near(y1, y2, box[3]):
                    top = int(near(y1, y2, box[3]))
                    sides.append({"axis": 1, "line": cy + top, "at": cx, "side": top, "lo": min(x1, x2), "hi": max(x1, x2)})
                else:
                    length += float(np.hypot(x2 - x1, y2 - y1))
        kind = pa.list_(pa.struct([("axis", pa.int32()), ("line", pa.int64()), ("at", pa.int64()), ("side", pa.int32()), ("lo", pa.float64()), ("hi", pa.float64())]))
        return pa.table({**{k: pa.array([key[i].as_py()], group.schema.field(k).type) for i, k in enumerate(keys)}, "area": pa.array([sum(map(offset.signed_area, rings), 0.0)]),
                         "length": pa.array([length]), "sides": pa.array([sides], kind)})

    parts = cut_lineage(spread.groupBy(*keys, "_cx", "_cy").applyInArrow(unite, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", " + _PART))
    sides = parts.select(*keys, F.explode("sides").alias("s")).select(*keys, "s.*").groupBy(*keys, "axis", "line", "at")
    lists = sides.agg(*(F.collect_list(F.when(F.col("side") == k, F.struct("lo", "hi"))).alias(f"s{k}") for k in (0, 1)))       # of two cells' border
    size = lambda c: F.aggregate(c, F.lit(0.0), lambda a, i: a + i["hi"] - i["lo"])
    both = F.aggregate("s0", F.lit(0.0), lambda a, i: a + F.aggregate("s1", F.lit(0.0), lambda b, j: b + F.greatest(F.least(i["hi"], j["hi"]) - F.greatest(i["lo"], j["lo"]), F.lit(0.0))))
    border = lists.select(*keys, F.lit(0.0).alias("area"), (size("s0") + size("s1") - 2 * both).alias("length"))
    return parts.select(*keys, "area", "length").unionByName(border).groupBy(*keys).agg(F.sum("area").alias("area"), F.sum("length").alias("perimeter"))


def edge_directions(polys: DataFrame, bins: int = 18, by: tuple[str, ...] = ("image",)) -> DataFrame:
    """``(*by, bin, n)``: histogram of edge directions over many polygons."""
    e = polys.select(*by, F.explode(G.edges(F.col("ring"))).alias("e"))
    b = G.direction_bin(F.atan2(F.col("e.y2") - F.col("e.y1"), F.col("e.x2") - F.col("e.x1")), bins)
    return e.groupBy(*by, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def settlement_angle(angles: DataFrame, by: tuple[str, ...] = ("group",), bins: int = 36, min_buildings: int = 3) -> DataFrame:
    """Most frequent building angle per settlement, in degrees, when it has more than
    ``min_buildings`` buildings; the lowest bin wins ties."""
    counts = angles.select(*by, G.direction_bin(F.radians("angle"), bins).alias("bin")) \
        .groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy(*by).agg(F.max(F.struct("n", (-F.col("bin")).alias("nb"))).alias("m"), F.sum("n").alias("n_buildings"))
    return best.where(F.col("n_buildings") > min_buildings).select(
        *by, "n_buildings", (-F.col("m.nb")).alias("bin"), G.bin_angle(-F.col("m.nb"), bins).alias("angle"))


def assign(buildings: DataFrame, aois: DataFrame, cell: float, predicate=None, keys: tuple[str, ...] = ()) -> DataFrame:
    """Each building with its lowest settlement key."""
    from .spatial_join import ring_pairs
    pairs = (box_pairs(buildings, aois, "bid", "aoi", cell, keys) if predicate is None
             else ring_pairs(buildings, aois, "bid", "aoi", cell, predicate, keys))
    return pairs.groupBy(*keys, "bid").agg(F.min("aoi").alias("aoi"))
