"""Row-level pixel expressions: clipping, class codes, affine maps, class scores."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# --- values -----------------------------------------------------------------

def to_byte(v: Column) -> Column:
    """Clip to 0..255 and truncate."""
    return F.least(F.greatest(v, F.lit(0)), F.lit(255)).cast("int")


def is_building(v: Column) -> Column:
    """Ground truth: the stored building value is 255."""
    return (v == 255).cast("int")


def is_predicted(p: Column, threshold: float = 0.5) -> Column:
    return (p > threshold).cast("int")


def class_code(building: Column, edge: Column | None = None) -> Column:
    """0 background, 1 building, 2 edge; an edge pixel wins over a building pixel."""
    inside = F.when(building > 0, 1).otherwise(0)
    return inside if edge is None else F.when(edge > 0, 2).otherwise(inside)


def mapped(value: Column, codes: dict) -> Column:
    """Class of a mask value by a table of any codes; a value that is not in it is an error that names it."""
    out = F.when(value.isNull(), F.lit(None).cast("int"))
    for code, cls in codes.items():
        out = out.when(value == code, F.lit(cls).cast("int"))
    return out.otherwise(F.raise_error(F.concat(F.lit("mask value without a class: "), value.cast("string"))).cast("int"))


def carve_edges(building: Column, edge: Column) -> Column:
    """A pixel burnt as edge is no building pixel."""
    return F.when(edge == 255, 0).otherwise(building)


def suppress_edges(building_prob: Column, edge_prob: Column | None, edge_threshold: float) -> Column:
    """Building probability, zero where the edge probability passes its threshold.
    A NULL edge probability leaves the building probability as it is."""
    if edge_prob is None:
        return building_prob
    return F.when(edge_prob > edge_threshold, F.lit(0.0)).otherwise(building_prob)


def unit_range(v: Column, lo: Column, hi: Column) -> Column:
    """Min-max normalisation; NULL on a constant image."""
    return F.try_divide(v - lo, hi - lo)


# --- affine -----------------------------------------------------------------

def to_world(col: Column, row: Column, t: Column) -> tuple[Column, Column]:
    """World coordinates of a pixel corner under ``t = struct(a, b, c, d, e, f)``."""
    return t.a * col + t.b * row + t.c, t.d * col + t.e * row + t.f


def to_pixel(x: Column, y: Column, t: Column) -> tuple[Column, Column]:
    """Fractional (column, row) of a world point: the inverse affine map."""
    det = t.a * t.e - t.b * t.d
    dx, dy = x - t.c, y - t.f
    return (t.e * dx - t.b * dy) / det, (t.a * dy - t.d * dx) / det


def affine(a, b, c, d, e, f) -> Column:
    names = ("a", "b", "c", "d", "e", "f")
    values = (a, b, c, d, e, f)
    return F.struct(*[(v if isinstance(v, Column) else F.lit(float(v))).cast("double").alias(n)
                      for n, v in zip(names, values)])


def shift_affine(t: Column, col: Column, row: Column) -> Column:
    """Affine of a tile whose top-left pixel is (col, row)."""
    x, y = to_world(col, row, t)
    return affine(t.a, t.b, x, t.d, t.e, y)


# --- class scores -----------------------------------------------------------

def softmax(z: Column) -> Column:
    """Softmax of a score array, shifted by its maximum."""
    top = F.array_max(z)
    e = F.transform(z, lambda v: F.exp(v - top))
    return F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def argmax(p: Column) -> Column:
    """Zero-based position of the largest entry (the first one wins ties)."""
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")
