"""Geometry as Column expressions over ``ARRAY<STRUCT<x: DOUBLE, y: DOUBLE>>``.

A ring is closed (first point repeated at the end). Every function here takes
and returns Columns, so geometry stays inside the SQL engine: no Python runs
per row and column pruning still works through it.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

RING_TYPE = "array<struct<x:double,y:double>>"


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once: the body sees a lambda variable, so
    an expensive expression is not repeated however often it is used."""
    return F.transform(F.array(value), body)[0]


def materialize(df, name: str, value: Column):
    """Column computed in a generator node. Filters on it are not pushed below, which
    would copy the expression into them."""
    return df.withColumn(name, F.explode(F.array(value)))


# --- construction -----------------------------------------------------------

def point(x, y) -> Column:
    return F.struct(F.col(x).cast("double").alias("x") if isinstance(x, str) else x.cast("double").alias("x"),
                    F.col(y).cast("double").alias("y") if isinstance(y, str) else y.cast("double").alias("y"))


def box_ring(x0, y0, x1, y1) -> Column:
    """Closed rectangle ring from its bounds."""
    return F.array(point(x0, y0), point(x1, y0), point(x1, y1), point(x0, y1), point(x0, y0))


def wkt_type(wkt: Column) -> Column:
    """Geometry type name at the head of a WKT text, upper case."""
    return F.upper(F.regexp_extract(wkt, r"^\s*([A-Za-z]+)", 1))


def _ring_of_text(text: Column) -> Column:
    pairs = F.split(F.trim(text), r"\s*,\s*")
    return F.transform(pairs, lambda p: F.struct(
        F.split(F.trim(p), r"\s+")[0].cast("double").alias("x"),
        F.split(F.trim(p), r"\s+")[1].cast("double").alias("y")))


def wkt_rings(wkt: Column) -> Column:
    """Exterior rings of a POLYGON or MULTIPOLYGON text (one per part)."""
    body = F.regexp_replace(wkt, r"^\s*[A-Za-z]+\s*\(\s*\(?\s*\(?|\)\s*\)?\s*\)?\s*$", "")
    parts = F.split(body, r"\)\s*\)\s*,\s*\(\s*\(")
    multi = wkt_type(wkt) == "MULTIPOLYGON"
    one = F.array(F.regexp_extract(body, r"^([^)]*)", 1))
    many = F.transform(parts, lambda p: F.regexp_extract(p, r"^\(*([^)]*)", 1))
    empty = F.upper(wkt).contains("EMPTY")
    return F.when(empty, F.array().cast(f"array<{RING_TYPE}>")).otherwise(
        F.transform(F.when(multi, many).otherwise(one), _ring_of_text))


def ring_wkt(ring: Column) -> Column:
    """POLYGON text of a ring."""
    return F.concat(F.lit("POLYGON (("), F.array_join(F.transform(
        ring, lambda p: F.concat_ws(" ", p.x.cast("string"), p.y.cast("string"))), ", "), F.lit("))"))


def ring_key(ring: Column) -> Column:
    """Hash of a ring's exact coordinates, for geometry equality."""
    return F.sha2(F.to_json(ring), 256)


# --- measures ---------------------------------------------------------------

def edges(ring: Column) -> Column:
    """Directed edges ``struct(x1, y1, x2, y2)`` of a closed ring."""
    n = F.size(ring)
    return F.zip_with(
        F.slice(ring, F.lit(1), F.greatest(n - 1, F.lit(0))),
        F.slice(ring, F.lit(2), F.greatest(n - 1, F.lit(0))),
        lambda a, b: F.struct(a.x.alias("x1"), a.y.alias("y1"), b.x.alias("x2"), b.y.alias("y2")))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def signed_area(ring: Column) -> Column:
    return _total(F.transform(edges(ring), lambda e: e.x1 * e.y2 - e.x2 * e.y1)) / 2.0


def area(ring: Column) -> Column:
    return F.abs(signed_area(ring))


def perimeter(ring: Column) -> Column:
    return _total(F.transform(edges(ring), lambda e: F.hypot(e.x2 - e.x1, e.y2 - e.y1)))


def bounds(ring: Column) -> Column:
    """``struct(xmin, ymin, xmax, ymax)``."""
    xs = F.transform(ring, lambda p: p.x)
    ys = F.transform(ring, lambda p: p.y)
    return F.struct(F.array_min(xs).alias("xmin"), F.array_min(ys).alias("ymin"),
                    F.array_max(xs).alias("xmax"), F.array_max(ys).alias("ymax"))


def centroid(ring: Column) -> Column:
    """Area centroid. Coordinates are taken relative to the first vertex so that
    large world coordinates keep their precision; a flat ring gives its mean vertex."""
    ox, oy = ring[0].x, ring[0].y
    parts = F.transform(edges(ring), lambda e: F.struct(
        ((e.x1 - ox) * (e.y2 - oy) - (e.x2 - ox) * (e.y1 - oy)).alias("k"),
        (e.x1 + e.x2 - 2 * ox).alias("sx"), (e.y1 + e.y2 - 2 * oy).alias("sy")))
    sums = F.aggregate(
        parts,
        F.struct(F.lit(0.0).alias("k"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y")),
        lambda a, p: F.struct((a.k + p.k).alias("k"), (a.x + p.k * p.sx).alias("x"),
                              (a.y + p.k * p.sy).alias("y")),
        lambda a: F.struct(F.try_divide(a.x, 3 * a.k).alias("x"), F.try_divide(a.y, 3 * a.k).alias("y")))
    n = F.size(ring)
    return let(sums, lambda s: F.struct(
        F.coalesce(ox + s.x, _total(F.transform(ring, lambda p: p.x)) / n).alias("x"),
        F.coalesce(oy + s.y, _total(F.transform(ring, lambda p: p.y)) / n).alias("y")))


# --- affine moves -----------------------------------------------------------

def _about(ring: Column, origin: Column | None) -> Column:
    """The centroid where no origin is given; an empty ring has none and needs none."""
    return F.when(F.size(ring) > 0, centroid(ring)) if origin is None else origin


def scale(ring: Column, factor, origin: Column | None = None) -> Column:
    """Scale about ``origin`` (the centroid by default)."""
    k = F.lit(factor) if not isinstance(factor, Column) else factor
    return let(ring, lambda g: let(_about(g, origin), lambda o: F.transform(g, lambda p: F.struct(
        (o.x + (p.x - o.x) * k).alias("x"), (o.y + (p.y - o.y) * k).alias("y")))))


def rotate(ring: Column, degrees, origin: Column | None = None) -> Column:
    """Rotate counter-clockwise by ``degrees`` about ``origin`` (centroid by default)."""
    a = F.radians(F.lit(degrees) if not isinstance(degrees, Column) else degrees)
    turn = F.struct(F.cos(a).alias("cos"), F.sin(a).alias("sin"))
    return let(ring, lambda g: let(_about(g, origin), lambda o: let(turn, lambda t: F.transform(g, lambda p: F.struct(
        (o.x + (p.x - o.x) * t.cos - (p.y - o.y) * t.sin).alias("x"),
        (o.y + (p.x - o.x) * t.sin + (p.y - o.y) * t.cos).alias("y"))))))


def map_points(ring: Column, fx, fy) -> Column:
    """Apply coordinate functions ``fx(x, y)`` and ``fy(x, y)`` to every vertex."""
    return F.transform(ring, lambda p: F.struct(fx(p.x, p.y).alias("x"), fy(p.x, p.y).alias("y")))


# --- predicates -------------------------------------------------------------

def _cross(ax, ay, bx, by, px, py) -> Column:
    return (bx - ax) * (py - ay) - (by - ay) * (px - ax)


def _segments_meet(e: Column, f: Column) -> Column:
    """True when two closed segments share a point."""
    d1 = _cross(f.x1, f.y1, f.x2, f.y2, e.x1, e.y1)
    d2 = _cross(f.x1, f.y1, f.x2, f.y2, e.x2, e.y2)
    d3 = _cross(e.x1, e.y1, e.x2, e.y2, f.x1, f.y1)
    d4 = _cross(e.x1, e.y1, e.x2, e.y2, f.x2, f.y2)
    boxes = ((F.greatest(e.x1, e.x2) >= F.least(f.x1, f.x2)) & (F.greatest(f.x1, f.x2) >= F.least(e.x1, e.x2))
             & (F.greatest(e.y1, e.y2) >= F.least(f.y1, f.y2)) & (F.greatest(f.y1, f.y2) >= F.least(e.y1, e.y2)))
    return boxes & (d1 * d2 <= 0) & (d3 * d4 <= 0)


def contains_point(ring: Column, x, y) -> Column:
    """Even-odd test for a point strictly inside the ring."""
    hits = F.filter(edges(ring), lambda e: ((e.y1 > y) != (e.y2 > y)) & (
        x < (e.x2 - e.x1) * (y - e.y1) / (e.y2 - e.y1) + e.x1))
    return F.size(hits) % 2 == 1


def boxes_meet(a: Column, b: Column) -> Column:
    """Closed bounding boxes share a point (touching counts)."""
    return (a.xmin <= b.xmax) & (b.xmin <= a.xmax) & (a.ymin <= b.ymax) & (b.ymin <= a.ymax)


def intersects(a: Column, b: Column) -> Column:
    """Two polygons share a point: boxes first, then edges, then containment."""
    crossing = F.exists(edges(a), lambda e: F.exists(edges(b), lambda f: _segments_meet(e, f)))
    return boxes_meet(bounds(a), bounds(b)) & (
        crossing | contains_point(a, b[0].x, b[0].y) | contains_point(b, a[0].x, a[0].y))


def is_closed(ring: Column) -> Column:
    return F.size(ring).cast("int").__gt__(0) & (F.element_at(ring, 1) == F.element_at(ring, -1))


def is_simple(ring: Column) -> Column:
    """No two non-adjacent edges meet."""
    n = F.size(ring) - 1
    numbered = F.transform(edges(ring), lambda e, i: F.struct(
        i.alias("i"), e.x1.alias("x1"), e.y1.alias("y1"), e.x2.alias("x2"), e.y2.alias("y2")))
    return ~F.exists(numbered, lambda e: F.exists(numbered, lambda f: (
        (f.i > e.i + 1) & ~((e.i == 0) & (f.i == n - 1)) & _segments_meet(e, f))))


def is_valid(ring: Column) -> Column:
    """Closed, at least four points, non-zero area and no self-crossing."""
    return F.coalesce(is_closed(ring) & (F.size(ring) > 3) & (area(ring) > 0) & is_simple(ring), F.lit(False))


# --- overlay ----------------------------------------------------------------

def clip_convex(subject: Column, clip: Column) -> Column:
    """Part of ``subject`` inside the convex ring ``clip`` (half-plane clipping,
    one clip edge after the other). Returns an open point list."""
    none = F.array().cast(RING_TYPE)

    def against(sign: Column, poly: Column, e: Column) -> Column:
        def side(p):
            return sign * _cross(e.x1, e.y1, e.x2, e.y2, p.x, p.y)

        # every vertex with its signed distance, computed once
        pts = F.transform(poly, lambda p: F.struct(p.x.alias("x"), p.y.alias("y"), side(p).alias("d")))

        def step(a: Column, b: Column) -> Column:
            def at(p, q):
                return p + (q - p) * (a.d / (a.d - b.d))
            crossing = F.when((a.d >= 0) != (b.d >= 0), F.array(F.struct(
                at(a.x, b.x).alias("x"), at(a.y, b.y).alias("y")))).otherwise(none)
            kept = F.when(b.d >= 0, F.array(F.struct(b.x.alias("x"), b.y.alias("y")))).otherwise(none)
            return F.concat(crossing, kept)

        def cut(q):
            before = F.concat(F.slice(q, F.size(q), 1), F.slice(q, F.lit(1), F.size(q) - 1))
            return F.flatten(F.zip_with(before, q, step))

        return F.when(F.size(poly) == 0, poly).otherwise(let(pts, cut))

    start = F.slice(subject, F.lit(1), F.greatest(F.size(subject) - 1, F.lit(0))).cast(RING_TYPE)
    return let(clip, lambda k: let(F.signum(signed_area(k)), lambda sign: F.aggregate(
        edges(k), start, lambda poly, e: against(sign, poly, e))))


def close(points: Column) -> Column:
    """Repeat the first point at the end."""
    return F.concat(points, F.slice(points, 1, 1))


def intersection_area_convex(a: Column, b: Column) -> Column:
    """Overlap area where ``b`` is convex."""
    return let(clip_convex(a, b), lambda p: area(close(p)))


def iou_convex(a: Column, b: Column) -> Column:
    return let(intersection_area_convex(a, b), lambda i: i / (area(a) + area(b) - i))


def _walls(rings: Column, base: Column) -> Column:
    """Upright trapezoids between every edge of the rings and the line y = base: extent, heights at both ends, and +1 or -1 by the edge's direction."""
    def wall(e):
        on = e.x1 < e.x2
        return F.struct(F.least(e.x1, e.x2).alias("l"), F.greatest(e.x1, e.x2).alias("r"), (F.when(on, e.y1).otherwise(e.y2) - base).alias("hl"),
                        (F.when(on, e.y2).otherwise(e.y1) - base).alias("hr"), F.when(on, 1.0).otherwise(-1.0).alias("s"))
    return F.transform(F.filter(F.flatten(F.transform(rings, edges)), lambda e: e.x1 != e.x2), wall)


def _common(e, f) -> Column:
    """Area that two trapezoids share: under the lower of two lines, which cross once at most, over the common extent."""
    def under(h):
        d0, d1 = h.e0 - h.f0, h.e1 - h.f1
        low0, low1 = F.least(h.e0, h.f0), F.least(h.e1, h.f1)
        t = d0 / (d0 - d1)
        return F.when(d0 * d1 < 0, h.w * (t * low0 + h.e0 + (h.e1 - h.e0) * t + (1 - t) * low1) / 2).otherwise(h.w * (low0 + low1) / 2)

    lo, hi = F.greatest(e.l, f.l), F.least(e.r, f.r)
    at = lambda k, x: k.hl + (k.hr - k.hl) * ((x - k.l) / (k.r - k.l))
    ends = F.struct(at(e, lo).alias("e0"), at(e, hi).alias("e1"), at(f, lo).alias("f0"), at(f, hi).alias("f1"), (hi - lo).alias("w"))
    return F.when(lo < hi, e.s * f.s * let(ends, under)).otherwise(0.0)


def intersection_area_of(a: Column, b: Column) -> Column:
    """Overlap area of two shapes given as arrays of rings: outer rings in one direction, holes in the other; concave rings are fine.

    Each shape is the signed sum of the trapezoids under its edges, so the overlap is the signed sum of what pairs of trapezoids share."""
    low = lambda rings: F.array_min(F.flatten(F.transform(rings, lambda r: F.transform(r, lambda p: p.y))))

    def total(base):
        return let(_walls(b, base), lambda fs: F.aggregate(_walls(a, base), F.lit(0.0), lambda acc, e: acc + F.aggregate(fs, F.lit(0.0), lambda x, f: x + _common(e, f))))

    return F.abs(let(F.least(low(a), low(b)), total))


def net_area(rings: Column) -> Column:
    """Area of an array of rings, holes running against the outer ones."""
    return F.abs(_total(F.transform(rings, signed_area)))


def intersection_area(a: Column, b: Column) -> Column:
    """Overlap area of two simple rings, convex or not."""
    return intersection_area_of(F.array(a), F.array(b))


def iou(a: Column, b: Column) -> Column:
    """IoU of two simple rings, convex or not."""
    return let(intersection_area(a, b), lambda i: F.try_divide(i, area(a) + area(b) - i))


def box_iou(a: Column, b: Column) -> Column:
    """IoU of two axis-parallel boxes given as bounds structs."""
    w = F.greatest(F.lit(0.0), F.least(a.xmax, b.xmax) - F.greatest(a.xmin, b.xmin))
    h = F.greatest(F.lit(0.0), F.least(a.ymax, b.ymax) - F.greatest(a.ymin, b.ymin))
    i = w * h
    union = (a.xmax - a.xmin) * (a.ymax - a.ymin) + (b.xmax - b.xmin) * (b.ymax - b.ymin) - i
    return F.try_divide(i, union)


# --- shape ------------------------------------------------------------------

def direction_bin(angle: Column, bins: int) -> Column:
    """Histogram bin of an angle in [-pi, pi]; the upper end falls in the last bin."""
    width = F.lit(2.0) * F.pi() / bins
    return F.least(F.floor((angle + F.pi()) / width), F.lit(bins - 1)).cast("int")


def bin_angle(bin_: Column, bins: int) -> Column:
    """Lower edge of a direction bin in degrees."""
    return bin_ * (360.0 / bins) - 180.0


def dominant_bin(ring: Column, bins: int = 18) -> Column:
    """Most frequent edge direction bin of one ring; the lowest bin wins ties."""
    hits = F.transform(edges(ring), lambda e: direction_bin(F.atan2(e.y2 - e.y1, e.x2 - e.x1), bins))
    counts = let(hits, lambda hit: F.transform(F.sequence(F.lit(0), F.lit(bins - 1)),
                                               lambda b: F.size(F.filter(hit, lambda h: h == b))))
    return let(counts, lambda n: F.array_position(n, F.array_max(n)) - 1).cast("int")


def dominant_angle(ring: Column, bins: int = 18) -> Column:
    return bin_angle(dominant_bin(ring, bins), bins)


def with_neighbours(ring: Column) -> Column:
    """Vertices of a closed ring as ``struct(prev, cur, next)``, each once."""
    pts = F.slice(ring, F.lit(1), F.greatest(F.size(ring) - 1, F.lit(1)))
    last = F.slice(ring, F.greatest(F.size(ring) - 1, F.lit(1)), F.lit(1))
    return F.arrays_zip(F.concat(last, ring).alias("prev"), pts.alias("cur"),
                        F.slice(ring, F.lit(2), F.size(ring)).alias("next"))


def _cur(zipped: Column) -> Column:
    return F.transform(F.filter(zipped, lambda z: z.cur.isNotNull()), lambda z: z.cur)


def drop_collinear(ring: Column) -> Column:
    """Remove vertices lying on the straight line through their neighbours."""
    return close(_cur(F.filter(with_neighbours(ring), lambda z: _cross(
        z.prev.x, z.prev.y, z.next.x, z.next.y, z.cur.x, z.cur.y) != 0)))


def simplify(ring: Column, tolerance: float) -> Column:
    """Vertices thinned in one walk along the ring: from each kept vertex on, vertices are passed over as long as all of
    them lie closer than ``tolerance`` to the chord from it to the next one. Every dropped vertex was tested against
    the very edge that replaces it, so no part moves by more. The start stays; a ring keeps at least four points."""
    none = F.array().cast(RING_TYPE)

    def near(a, b, p):
        base = F.hypot(b.x - a.x, b.y - a.y)
        return F.when(base > 0, F.abs(_cross(a.x, a.y, b.x, b.y, p.x, p.y)) < tolerance * base) \
            .otherwise(F.hypot(p.x - a.x, p.y - a.y) < tolerance)

    def walk(state, v):
        spans = F.forall(state.passed, lambda p: near(state.last, v, p))
        on = F.struct(state.kept.alias("kept"), state.last.alias("last"), F.concat(state.passed, F.array(v)).alias("passed"))
        turn = F.element_at(state.passed, -1)
        return F.when(spans, on).otherwise(F.struct(F.concat(state.kept, F.array(turn)).alias("kept"), turn.alias("last"), F.array(v).alias("passed")))

    def whole(r):
        first = F.struct(r[0].x.alias("x"), r[0].y.alias("y"))
        start = F.struct(F.array(first).cast(RING_TYPE).alias("kept"), first.cast("struct<x:double,y:double>").alias("last"), none.alias("passed"))
        walked = F.aggregate(F.slice(r, F.lit(2), F.size(r)), start, walk, lambda s: F.concat(s.kept, F.slice(s.passed, F.size(s.passed), F.lit(1))))
        return let(walked, lambda t: F.when(F.size(t) >= 5, t).otherwise(r))

    return let(ring, lambda r: F.when(F.size(r) > 5, whole(r)).otherwise(r))


def start_at(ring: Column, x: Column, y: Column) -> Column:
    """Closed ring turned so that it starts at the given vertex."""
    pts = F.slice(ring, F.lit(1), F.greatest(F.size(ring) - 1, F.lit(1)))
    at = F.greatest(F.array_position(pts, F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))).cast("int"), F.lit(1))
    return close(F.concat(F.slice(pts, at, F.size(pts)), F.slice(pts, F.lit(1), at - 1)))


def convex_hull(ring: Column) -> Column:
    """Convex hull by wrapping: from the lowest vertex, repeatedly take the vertex
    that leaves all others on its left. Work per polygon is vertices x hull size."""
    def turn(o, a, b):
        return (a.x - o.x) * (b.y - o.y) - (a.y - o.y) * (b.x - o.x)

    def dist(o, a):
        return (a.x - o.x) * (a.x - o.x) + (a.y - o.y) * (a.y - o.y)

    def next_point(pts, cur):
        def better(best, q):
            t = turn(cur, best, q)
            take = (best == cur) | ((q != cur) & ((t < 0) | ((t == 0) & (dist(cur, q) > dist(cur, best)))))
            return F.when(take, q).otherwise(best)
        return F.aggregate(pts, cur, better)

    def wrap_from(pts, first):
        def wrap(hull, _):
            done = (F.size(hull) > 1) & (F.element_at(hull, -1) == first)
            step = lambda: let(F.element_at(hull, -1), lambda cur: F.concat(hull, F.array(next_point(pts, cur))))
            return F.when(done, hull).otherwise(step())
        return F.aggregate(F.sequence(F.lit(1), F.size(pts)), F.array(first), wrap)

    points = F.array_distinct(F.transform(ring, lambda p: F.struct((p.y + 0.0).alias("y"), (p.x + 0.0).alias("x"))))
    hull = let(points, lambda pts: let(F.array_min(pts), lambda first: wrap_from(pts, first)))
    return F.transform(hull, lambda p: F.struct(p.x.alias("x"), p.y.alias("y")))


def min_rotated_rect(hull: Column) -> Column:
    """Smallest-area enclosing rectangle of a convex ring: one side of it lies on a
    hull edge, so the hull edge directions are the only candidates."""
    def rect(h, e):
        u = F.hypot(e.x2 - e.x1, e.y2 - e.y1)
        along = F.transform(h, lambda p: (p.x * (e.x2 - e.x1) + p.y * (e.y2 - e.y1)) / u)
        across = F.transform(h, lambda p: (p.y * (e.x2 - e.x1) - p.x * (e.y2 - e.y1)) / u)
        return let(F.struct(along.alias("a"), across.alias("b")), lambda s: let(F.struct(
            F.array_min(s.a).alias("a0"), F.array_max(s.a).alias("a1"),
            F.array_min(s.b).alias("b0"), F.array_max(s.b).alias("b1")), lambda m: F.struct(
            ((m.a1 - m.a0) * (m.b1 - m.b0)).alias("area"),
            ((e.x2 - e.x1) / u).alias("ux"), ((e.y2 - e.y1) / u).alias("uy"),
            m.a0.alias("a0"), m.a1.alias("a1"), m.b0.alias("b0"), m.b1.alias("b1"))))

    def corner(r, a, b):
        return F.struct((a * r.ux - b * r.uy).alias("x"), (a * r.uy + b * r.ux).alias("y"))

    def build(h):
        real = F.filter(edges(h), lambda e: (e.x1 != e.x2) | (e.y1 != e.y2))
        best = F.array_min(F.transform(real, lambda e: rect(h, e)))
        return let(best, lambda r: F.array(corner(r, r.a0, r.b0), corner(r, r.a1, r.b0), corner(r, r.a1, r.b1),
                                           corner(r, r.a0, r.b1), corner(r, r.a0, r.b0)))
    return let(hull, build)


def squared_up(ring: Column, min_fill: float = 0.85) -> Column:
    """The smallest rotated rectangle around a ring that fills more than ``min_fill`` of it, else null. The rectangle is that of the
    outline as traced: thinned to the full tolerance, a square with clipped corners would come out turned and smaller."""
    def square_up(r):
        def choose(m):
            return F.when(F.coalesce(F.try_divide(area(r), area(m)) > min_fill, F.lit(False)), m)
        return let(convex_hull(r), lambda h: F.when(F.size(h) > 3, let(min_rotated_rect(h), choose)))
    return let(ring, square_up)
