"""Class scores to clean building masks, and masks to building polygons."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..config import SegmentationParams
from ..functions import geometry as G, offset, shapes
from ..functions import pixel as P
from ..session import cut_lineage
from . import components as C
from . import polygonize as PG
from . import stencil as S


def threshold(probs: DataFrame, params: SegmentationParams, has_edge: bool = True, block: int = S.BLOCK) -> DataFrame:
    """Edge suppression, 3 x 3 median and threshold: ``(image, r, c, v)`` in 0/1 from
    ``(image, r, c, building_prob[, edge_prob])``."""
    p = P.suppress_edges(F.col("building_prob"), F.col("edge_prob") if has_edge else None, params.edge_threshold)
    return S.array_chain(probs.select("image", "r", "c", p.alias("v")), "v",
                         [("median",), ("above", params.building_threshold)], block=block, out_type="int")


def clean(binary: DataFrame, params: SegmentationParams, block: int = S.BLOCK, vote: bool = False) -> DataFrame:
    """Remove small objects, fill small holes, open, close, and dilate once. The five
    morphology steps share one shuffle; ``vote`` adds the median vote that polygons are
    made from to the same pass and then keeps foreground pixels only."""
    binary = cut_lineage(binary)  # read by the labelling and by the flip below
    small = C.small_components(binary.where("v = 1"), params.min_building_size)
    dense = cut_lineage(C.flip(binary, small, "v", 0))
    filled = C.fill_holes(dense, "v", params.max_hole_size)
    k, dot = S.ellipse(params.morph_kernel_size), S.ellipse(3)
    steps = [("min", k), ("max", k), ("max", k), ("min", k), ("max", dot)] + ([("vote",)] if vote else [])
    return S.array_chain(filled, "v", steps, block=block, nonzero_only=vote)


def edge_guided(probs: DataFrame, params: SegmentationParams, has_edge: bool = True, vote: bool = False) -> DataFrame:
    return clean(threshold(probs, params, has_edge), params, vote=vote)


def _points(rings: pa.ListArray) -> list[np.ndarray | None]:
    """Vertices of each ring as an array, absent coordinates as NaN."""
    flat, begin = rings.values, rings.offsets.to_numpy()
    p = np.column_stack([flat.field(k).to_numpy(zero_copy_only=False) for k in range(2)])
    return [p[a:b] if there else None for a, b, there in zip(begin[:-1].tolist(), begin[1:].tolist(), rings.is_valid().to_pylist())]


def _ring_array(rings: list[np.ndarray | None]) -> pa.ListArray:
    body = np.concatenate([p for p in rings if p is not None and len(p)] or [np.zeros((0, 2))])
    struct = pa.StructArray.from_arrays([pa.array(body[:, k].copy()) for k in range(2)], ["x", "y"])
    ends = np.cumsum([0, *(0 if p is None else len(p) for p in rings)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), struct, mask=pa.array([p is None for p in rings]))


def smooth(df: DataFrame, distance: float, ring: str = "ring", unless: str | None = None) -> DataFrame:
    """Rings shrunk and grown again by ``distance`` (`offset.opened`), the largest part kept; null where nothing is left. Rows whose column
    ``unless`` holds stay as they are. Rings of a batch are worked on together."""
    at, skip = df.columns.index(ring), df.columns.index(unless) if unless else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = _points(batch.column(at))
            leave = batch.column(skip).to_pylist() if unless else [False] * len(new)
            todo = [k for k, (p, stay) in enumerate(zip(new, leave)) if p is not None and not stay]
            if todo:
                for k, p in zip(todo, offset.opened_all(np.concatenate([new[k] for k in todo]), np.array([len(new[k]) for k in todo]), distance)):
                    new[k] = p
            yield pa.RecordBatch.from_arrays([_ring_array(new) if k == at else c for k, c in enumerate(batch.columns)], batch.schema.names)

    return df.mapInArrow(run, df.schema) if distance > 0 else df


def simplify(df: DataFrame, tolerance: float, ring: str = "ring") -> DataFrame:
    """Thin ring vertices inside the ring array: no shuffle."""
    return G.materialize(df, ring, G.simplify(F.col(ring), tolerance))


def regularize(df: DataFrame, params: SegmentationParams, ring: str = "ring") -> DataFrame:
    """A ring that fills more than ``mbr_threshold`` of its smallest rotated rectangle becomes that; any other one is simplified and
    smoothed by ``buffer_distance``. Empty and flat rings stay as they are, and so does one whose new form is not valid or empty.

    Rings are worked on together, a batch at a time (`shapes.regularized`); those with absent or boundless coordinates go by column
    expressions, which say what an absent value gives."""
    was = F.col(ring).cast(G.RING_TYPE)
    plain = F.coalesce(F.forall(was, lambda p: (F.abs(p.x) < 1e100) & (F.abs(p.y) < 1e100)), F.lit(False))
    square = G.squared_up(F.col("_was"), params.mbr_threshold) if params.use_mbr else F.lit(None).cast(G.RING_TYPE)
    out = G.materialize(df.withColumn("_was", was), "_plain", plain)
    out = G.materialize(out, "_square", F.when(~F.col("_plain"), square))
    out = G.materialize(out, ring, F.when(F.col("_plain"), F.col("_was")).otherwise(F.coalesce("_square", G.simplify(F.col("_was"), params.simplify_tolerance))).cast(G.RING_TYPE))
    out = _regularized(out.withColumn("_square", F.col("_square").isNotNull()), params, ring)
    right = F.col("_plain") | F.col("_square") | G.is_valid(F.col(ring))
    return G.materialize(out, ring, F.when(right, F.col(ring)).otherwise(F.col("_was"))).drop("_was", "_square", "_plain")


def _regularized(df: DataFrame, params: SegmentationParams, ring: str) -> DataFrame:
    """Rings marked ``_plain`` in their new form; of the others those that are not ``_square`` smoothed."""
    at, plain, square = (df.columns.index(c) for c in (ring, "_plain", "_square"))
    fill, d = params.mbr_threshold if params.use_mbr else None, params.buffer_distance

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rings, odd = _points(batch.column(at)), ~batch.column(plain).to_numpy(zero_copy_only=False).astype(bool)
            here = [r for r, o in zip(rings, odd) if not o]
            made = iter(shapes.regularized(np.concatenate(here), np.array([len(r) for r in here]), params.simplify_tolerance, d, fill) if here else ())
            leave = batch.column(square).to_pylist()
            new = [next(made) if not o else r if r is None or leave[i] or d <= 0 else offset.opened(r, d) for i, (r, o) in enumerate(zip(rings, odd))]
            yield pa.RecordBatch.from_arrays([_ring_array(new) if k == at else c for k, c in enumerate(batch.columns)], batch.schema.names)

    return df.mapInArrow(run, df.schema)


def largest_part(parts: DataFrame, keys: list[str], ring: str = "ring") -> DataFrame:
    """Of each shape's parts ``(*keys, ring)`` the one with the largest area, the first by its coordinates among equals: ``(*keys, ring, area)``."""
    sized = parts.withColumn("_a", G.area(F.col(ring)))
    best = sized.groupBy(*keys).agg(F.max(F.struct(F.col("_a").alias("area"), G.ring_key(F.col(ring)).alias("k"), F.col(ring).alias("ring"))).alias("_m"))
    return best.select(*keys, F.col("_m.ring").alias(ring), F.col("_m.area").alias("area"))


def area_filter(df: DataFrame, lo: float, hi: float, area: str = "area") -> DataFrame:
    """Strictly between the bounds."""
    return df.where((F.col(area) > lo) & (F.col(area) < hi))


def drop_largest(df: DataFrame, keys: list[str], area: str = "area", id_: str = "ring_id") -> DataFrame:
    """Drop the largest polygon of each image that has more than one. One aggregate row
    per image is looked up; nothing is ranked inside an image."""
    from ..skew import attach
    top = df.groupBy(*keys).agg(F.max(F.struct(F.col(area).alias("a"), (-F.col(id_)).alias("i"))).alias("_top"),
                                F.count(F.lit(1)).alias("_n"))
    out = attach(df, top, keys, [id_])
    is_top = (F.col("_n") > 1) & (F.col(area) == F.col("_top.a")) & (-F.col(id_) == F.col("_top.i"))
    return out.where(~is_top).drop("_top", "_n")


def vectorize(mask: DataFrame, params: SegmentationParams, images: DataFrame | None = None,
              smooth: bool = True, block: int = C.BLOCK) -> DataFrame:
    """Dense mask ``(image, r, c, v)`` to building polygons: median vote (unless the mask already had it), outer rings, ``vectorize_rings``."""
    voted = S.array_chain(mask, "v", [("vote",)], nonzero_only=True) if smooth else mask.where("v <> 0")
    rings = PG.polygonize(voted.select("image", "r", "c"), block)
    return vectorize_rings(rings.where(~F.col("is_hole")).drop("is_hole", "perimeter", "area"), params, images)


def vectorize_rings(rings: DataFrame, params: SegmentationParams, images: DataFrame | None = None) -> DataFrame:
    """Outer rings ``(image, label, ring_id, ring)`` to building polygons: regularisation, area bounds. With ``images (image, t, crs)``
    rings and areas are in world units; longitude/latitude rings are regularised and measured on an equal-area plane in metres."""
    from ..functions.crs import transform_xy
    from ..skew import attach

    def moved(a: str, b: str):
        return G.map_points(F.col("ring"), lambda x, y: transform_xy(x, y, a, b)[0], lambda x, y: transform_xy(x, y, a, b)[1])

    degrees = F.col("crs") == "EPSG:4326"
    # few bytes and much work a ring: the number is given, so that partitions are not merged for their size
    rings = rings.repartition(int(rings.sparkSession.conf.get("spark.sql.shuffle.partitions")), "image", "ring_id")
    if images is not None:
        rings = attach(rings, images.select("image", "t", "crs"), ["image"], ["ring_id"])
        rings = rings.withColumn("ring", G.map_points(
            F.col("ring"), lambda x, y: P.to_world(x, y, F.col("t"))[0], lambda x, y: P.to_world(x, y, F.col("t"))[1]))
        rings = G.materialize(rings, "ring", F.when(degrees, moved("EPSG:4326", "CEA")).otherwise(F.col("ring")))
    rings = rings.withColumn("angle", G.dominant_angle(F.col("ring")))
    out = regularize(rings, params).withColumn("area", G.area(F.col("ring")))
    if images is not None:
        out = G.materialize(out, "ring", F.when(degrees, moved("CEA", "EPSG:4326")).otherwise(F.col("ring"))).drop("t", "crs")
    if params.drop_largest:
        out = drop_largest(out, ["image"])
    return area_filter(out, params.min_building_area, params.max_building_area)
