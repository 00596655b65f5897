"""Packed block rasters: from scored tiles to building rings with one shuffle and no pixel rows.

A mask travels as pieces, rectangles of bits. Each tile is cut into the pieces that the windows of nearby blocks see of it: a window
is a block with a halo as wide as the whole chain of steps reaches. Per block, the pieces are put together, the chain runs on the
window, and the block's own pixels are right, for every step: neighbourhoods reach their radius; and whether a component has fewer than n
pixels is decided within n - 1 pixels, because a component that is smaller lies there whole, and of one that is not, n connected
pixels do. Pixels outside the image or of missing tiles are absent and take no part.

Rings are traced from the block's own pixels in the same task. Those that leave the block go on as open chains through a tree
of merges: at each level the chains of 8 x 8 squares meet, the closed ones are done, and only those that still leave the square are sent on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..config import SegmentationParams
from ..functions import geometry as G
from ..session import cut_lineage
from ..skew import attach
from .polygonize import edges_of, string_edges
from .stencil import ellipse, radius_of

BLOCK = 512
LEVEL = 3                       # squares double this often per level of the merge tree
PIECE = "image {kind}, br int, bc int, rank {rank}, r0 int, c0 int, h int, w int, bits binary"
CHAIN = ("image {kind}, br int, bc int, head long, next long, least long, closed boolean, n_edges long, area2 long, "
         "xs array<long>, ys array<long>")


# --- steps --------------------------------------------------------------------

def clean_steps(params: SegmentationParams, vote: bool = True) -> list[tuple]:
    """Median, small objects, small holes, opening, closing, one dilation, and the vote that polygons are made from."""
    k, dot = ellipse(params.morph_kernel_size), ellipse(3)
    steps = [("vote",), ("small", params.min_building_size), ("holes", params.max_hole_size), ("min", k), ("max", k), ("max", k), ("min", k), ("max", dot)]
    return steps + [("vote",)] * vote


def reach(steps: list[tuple]) -> int:
    """Pixels on each side that a chain of steps looks at."""
    own = {"vote": lambda s: 1, "small": lambda s: max(s[1] - 1, 0), "holes": lambda s: max(s[1] - 1, 0), "min": lambda s: radius_of(s[1]), "max": lambda s: radius_of(s[1])}
    return sum(own[s[0]](s) for s in steps)


def block_for(radius: int) -> int:
    """Blocks are at least as wide as the halo, so a window is nine blocks at most."""
    block = BLOCK
    while block < radius:
        block *= 2
    return block


def _moved(a: np.ndarray, dy: int, dx: int, fill: bool) -> np.ndarray:
    """The value ``dy`` rows below and ``dx`` columns to the right of each pixel."""
    out = np.full(a.shape, fill, a.dtype)
    h, w = a.shape
    if abs(dy) < h and abs(dx) < w:
        out[max(-dy, 0): h - max(dy, 0), max(-dx, 0): w - max(dx, 0)] = a[max(dy, 0): h + min(dy, 0), max(dx, 0): w + min(dx, 0)]
    return out


def _morph(a: np.ndarray, there: np.ndarray, element: dict[int, int], grow: bool) -> np.ndarray:
    """Dilation, or erosion as dilation of what is off; absent pixels are neither."""
    on = a if grow else there & ~a
    wide = {0: on}
    for k in range(1, max(element.values()) + 1):
        wide[k] = wide[k - 1] | _moved(on, 0, k, False) | _moved(on, 0, -k, False)
    out = np.zeros_like(on)
    for dy, w in element.items():
        out |= _moved(wide[w], dy, 0, False)
    return there & out if grow else a & ~out


def _vote(a: np.ndarray, there: np.ndarray) -> np.ndarray:
    """At least five of the 3 x 3 neighbours; an absent one is stood in for by the pixel next to it on this side."""
    v = a.astype(np.uint8)
    row = v + np.where(_moved(there, 0, -1, False), _moved(v, 0, -1, 0), v) + np.where(_moved(there, 0, 1, False), _moved(v, 0, 1, 0), v)
    total = row + np.where(_moved(there, -1, 0, False), _moved(row, -1, 0, 0), row) + np.where(_moved(there, 1, 0, False), _moved(row, 1, 0, 0), row)
    return there & (total >= 5)


def small_parts(a: np.ndarray, size: int) -> np.ndarray:
    """Pixels of 4-connected components with fewer than ``size`` pixels: runs of a row are linked to the runs they touch in the next one."""
    h, w = a.shape
    wide = w + 1                                         # one empty column, so no run goes on in the next row
    flat = np.zeros(h * wide + 1, np.int8)
    flat[:-1].reshape(h, wide)[:, :w] = a
    edge = np.flatnonzero(np.diff(flat, prepend=0))
    starts, ends = edge[0::2], edge[1::2]
    low, high = np.searchsorted(ends, starts + wide, side="right"), np.searchsorted(starts, ends + wide, side="left")
    n = np.maximum(high - low, 0)
    u = np.repeat(np.arange(len(starts)), n)
    v = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(len(u))
    root = np.arange(len(starts))
    while True:
        ru, rv = root[u], root[v]
        if (ru == rv).all():
            break
        least = np.minimum(ru, rv)
        np.minimum.at(root, ru, least)
        np.minimum.at(root, rv, least)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    few = np.bincount(root, ends - starts, len(starts))[root] < size
    marks = np.zeros(h * wide + 1, np.int8)
    marks[starts[few]] += 1
    marks[ends[few]] -= 1
    return np.cumsum(marks[:-1], dtype=np.int8).reshape(h, wide)[:, :w] == 1


def run_steps(a: np.ndarray, there: np.ndarray, steps: list[tuple]) -> np.ndarray:
    for step in steps:
        if step[0] == "vote":
            a = _vote(a, there)
        elif step[0] == "small":
            a = a & ~small_parts(a, step[1])
        elif step[0] == "holes":
            a = a | small_parts(there & ~a, step[1])
        else:
            a = _morph(a, there, step[1], step[0] == "max")
    return a


# --- tiles to pieces ------------------------------------------------------------

COLUMNS = ["image", "br", "bc", "rank", "r0", "c0", "h", "w", "bits"]


def _pieces(out: dict[str, list], image, r: int, c: int, rank, mask: np.ndarray, block: int, radius: int) -> None:
    """Append what each window sees of a tile whose first pixel is (r, c)."""
    h, w = mask.shape
    for br in range(max(r - radius, 0) // block, (r + h - 1 + radius) // block + 1):
        lo, hi = max(r, br * block - radius), min(r + h, (br + 1) * block + radius)
        for bc in range(max(c - radius, 0) // block, (c + w - 1 + radius) // block + 1):
            le, ri = max(c, bc * block - radius), min(c + w, (bc + 1) * block + radius)
            bits = np.packbits(mask[lo - r: hi - r, le - c: ri - c]).tobytes()
            for name, value in zip(COLUMNS, (image, br, bc, rank, lo, le, hi - lo, ri - le, bits)):
                out[name].append(value)


def _from_tiles(tiles: DataFrame, value: str, tile: int, block: int, radius: int, to_mask) -> DataFrame:
    """``to_mask()`` makes, once per task, a function from a tile's ``value`` to its mask, or None for a tile to leave out.

    Tiles lie at their place in the tile grid, or where ``place(image, r, c, rank)`` says: then they may overlap, and of tiles over one pixel
    the one of the lowest rank counts."""
    if "place" in tiles.columns:
        rows = tiles.select("place.*", value)
    else:
        rows = tiles.select("image", (F.col("tile_r") * tile).alias("r"), (F.col("tile_c") * tile).alias("c"), F.lit(0).alias("rank"), value)
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask_of = to_mask()
        for batch in batches:
            types = [batch.schema.field("image").type, pa.int32(), pa.int32(), batch.schema.field("rank").type, *[pa.int32()] * 4, pa.binary()]
            image, r, c, rank = (batch.column(k).to_pylist() for k in range(4))
            for first in range(0, batch.num_rows, 256):
                out: dict[str, list] = {n: [] for n in COLUMNS}
                for i in range(first, min(first + 256, batch.num_rows)):
                    mask = mask_of(batch.column(4)[i])
                    if mask is not None:
                        _pieces(out, image[i], r[i], c[i], rank[i], mask, block, radius)
                yield pa.RecordBatch.from_arrays([pa.array(out[n], t) for n, t in zip(COLUMNS, types)], COLUMNS)

    return rows.mapInArrow(run, PIECE.format(kind=kinds["image"], rank=kinds["rank"]))


def _above(scores: np.ndarray, params: SegmentationParams, has_edge: bool) -> np.ndarray:
    """Building pixels over the threshold, edges suppressed; the median of a threshold is the vote of what exceeds it."""
    p = scores[1]
    if has_edge and len(scores) > 2:
        p = np.where(scores[2] > params.edge_threshold, 0, p)
    return p > params.building_threshold


def scored_pieces(tiles: DataFrame, load_model, tile: int, params: SegmentationParams, has_edge: bool, block: int, radius: int) -> DataFrame:
    """Packed tiles ``(image, tile_r, tile_c, data)`` through the model, in one pass over them; tiles that the model fails on are left out."""

    def to_mask():
        model = load_model()

        def one(data):
            try:
                values = data.values.to_numpy(zero_copy_only=False).astype(float)
                return _above(np.asarray(model(values.reshape(tile, tile)), float), params, has_edge)
            except Exception:  # noqa: BLE001 - a bad tile must not fail the job; `score.failures` lists them
                return None

        return one

    return _from_tiles(tiles, "data", tile, block, radius, to_mask)


def stored_pieces(stored: DataFrame, tile: int, params: SegmentationParams, has_edge: bool, block: int, radius: int) -> DataFrame:
    """Stored predictions ``(image, tile_r, tile_c, scores, error)``; failed tiles are left out."""

    def to_mask():
        def one(scores):
            planes = [scores.values[k].values.to_numpy(zero_copy_only=False).reshape(tile, tile) for k in range(len(scores.values))]
            return _above(np.stack(planes), params, has_edge)

        return one

    ok = stored.where(F.col("error").isNull() & F.col("scores").isNotNull())
    return _from_tiles(ok, "scores", tile, block, radius, to_mask)


def mask_pieces(tiles: DataFrame, tile: int, block: int, radius: int) -> DataFrame:
    """Packed masks ``(image, tile_r, tile_c, data)``, any value but 0 is on."""
    return _from_tiles(tiles, "data", tile, block, radius,
                       lambda: lambda data: data.values.to_numpy(zero_copy_only=False).reshape(tile, tile) != 0)


def burn_tiles(runs: DataFrame, images: DataFrame, tile: int, on: int = 255) -> DataFrame:
    """Packed tiles ``(image, tile_r, tile_c, data array<int>)`` of whole images ``(image, width, height)`` from pixel runs ``(image, r, a, b)``;
    right and bottom remainders are dropped, tiles without a run are all 0."""
    cut = runs.withColumn("tile_r", F.floor(F.col("r") / tile).cast("int")).withColumn(
        "tile_c", F.explode(F.sequence(F.floor(F.col("a") / tile).cast("int"), F.floor((F.col("b") - 1) / tile).cast("int"))))
    kind = dict(runs.dtypes)["image"]

    def burn(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        r, a, b = (group.column(c).drop_null().to_numpy().astype(np.int64) for c in ("r", "a", "b"))
        c0 = key[2].as_py() * tile
        marks = np.zeros((tile, tile + 1), np.int32)
        row = r - key[1].as_py() * tile
        np.add.at(marks, (row, np.maximum(a - c0, 0)), 1)
        np.add.at(marks, (row, np.minimum(b - c0, tile)), -1)
        data = np.where(np.cumsum(marks, 1)[:, :tile] > 0, on, 0).astype(np.int32)
        return pa.table({"image": pa.array([key[0].as_py()], group.schema.field("image").type), "tile_r": pa.array([key[1].as_py()], pa.int32()),
                         "tile_c": pa.array([key[2].as_py()], pa.int32()), "data": pa.array([data.ravel()], pa.list_(pa.int32()))})

    every = lambda n: F.explode(F.sequence(F.lit(0), F.floor(F.col(n) / tile).cast("int") - 1))
    grid = images.where((F.col("height") >= tile) & (F.col("width") >= tile)).select("image", "width", every("height").alias("tile_r")) \
        .select("image", "tile_r", every("width").alias("tile_c"))
    # a tile's place is a row without a run, so tiles need no join and empty ones are made where the others are
    both = cut.select("image", "tile_r", "tile_c", "r", "a", "b").transform(lambda d: attach(d, _tiles_of(images, tile), ["image"], ["r", "a"], shuffle=True)).where("tile_r < tiles_y and tile_c < tiles_x") \
        .drop("tiles_y", "tiles_x").unionByName(grid, allowMissingColumns=True)
    return _dealt(both, "image", "tile_r", "tile_c").groupBy("image", "tile_r", "tile_c").applyInArrow(burn, f"image {kind}, tile_r int, tile_c int, data array<int>")


def _tiles_of(images: DataFrame, tile: int) -> DataFrame:
    return images.select("image", F.floor(F.col("height") / tile).alias("tiles_y"), F.floor(F.col("width") / tile).alias("tiles_x"))


def _dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Rows by key over all shuffle partitions: packed rows are few bytes and much work, so partitions are not to be merged for their size."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


# --- windows ------------------------------------------------------------------

def _window(group: pa.Table, block: int, radius: int) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Mask and presence of a block's window, cut down to what is there, and where it begins."""
    r0, c0, h, w = (group.column(n).to_numpy() for n in ("r0", "c0", "h", "w"))
    top, left = int(r0.min()), int(c0.min())
    a = np.zeros((int((r0 + h).max()) - top, int((c0 + w).max()) - left), bool)
    there = np.zeros(a.shape, bool)
    rank = [tuple(x.values()) if isinstance(x, dict) else (x,) for x in group.column("rank").to_pylist()]
    boxes = list(zip((r0 - top).tolist(), (c0 - left).tolist(), h.tolist(), w.tolist(), group.column("bits").to_pylist()))
    for k in sorted(range(len(boxes)), key=rank.__getitem__, reverse=True):              # the lowest rank is laid on top
        y, x, n, m, bits = boxes[k]
        a[y: y + n, x: x + m] = np.unpackbits(np.frombuffer(bits, np.uint8), count=n * m).reshape(n, m)
        there[y: y + n, x: x + m] = True
    return a, there, top, left


def _core(shape: tuple[int, int], top: int, left: int, br: int, bc: int, block: int) -> tuple[slice, slice]:
    at = lambda b, begin, size: slice(min(max(b * block - begin, 0), size), min(max((b + 1) * block - begin, 0), size))
    return at(br, top, shape[0]), at(bc, left, shape[1])


def chain(pieces: DataFrame, steps: list[tuple], block: int, radius: int | None = None) -> DataFrame:
    """Blocks ``(image, br, bc, r0, c0, h, w, bits, there, n_on, n)`` after the steps; `there` is the presence bitmap."""
    kind = dict(pieces.dtypes)["image"]
    radius = reach(steps) if radius is None else radius

    def run(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        br, bc = key[1].as_py(), key[2].as_py()
        a, there, top, left = _window(group, block, radius)
        rows, cols = _core(a.shape, top, left, br, bc, block)
        here = there[rows, cols]
        keep = [0] if here.any() else []
        done = run_steps(a, there, steps)[rows, cols] if keep else here
        values = {"image": key[0].as_py(), "br": br, "bc": bc, "r0": top + rows.start, "c0": left + cols.start, "h": here.shape[0], "w": here.shape[1],
                  "bits": np.packbits(done).tobytes(), "there": np.packbits(here).tobytes(), "n_on": int(done.sum()), "n": int(here.sum())}
        types = {"image": group.schema.field("image").type, **dict.fromkeys(("br", "bc", "r0", "c0", "h", "w"), pa.int32()), "bits": pa.binary(),
                 "there": pa.binary(), "n_on": pa.int64(), "n": pa.int64()}
        return pa.table({k: pa.array([v for _ in keep], types[k]) for k, v in values.items()})

    schema = f"image {kind}, br int, bc int, r0 int, c0 int, h int, w int, bits binary, there binary, n_on long, n long"
    return _dealt(pieces, "image", "br", "bc").groupBy("image", "br", "bc").applyInArrow(run, schema)


def pixels(blocks: DataFrame, value: str = "v") -> DataFrame:
    """Blocks to pixel rows ``(image, r, c, value)``, for whoever needs rows."""
    kind = dict(blocks.dtypes)["image"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                n = row["h"] * row["w"]
                at = np.flatnonzero(np.unpackbits(np.frombuffer(row["there"], np.uint8), count=n))
                on = np.unpackbits(np.frombuffer(row["bits"], np.uint8), count=n)[at]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["image"]] * len(at), batch.schema.field(0).type), pa.array((row["r0"] + at // row["w"]).astype(np.int32)),
                     pa.array((row["c0"] + at % row["w"]).astype(np.int32)), pa.array(on.astype(np.int32))], ["image", "r", "c", value])

    return blocks.select("image", "r0", "c0", "h", "w", "bits", "there").mapInArrow(run, f"image {kind}, r int, c int, {value} int")


# --- rings --------------------------------------------------------------------

def _listed(parts: list) -> pa.Array:
    return pa.array(parts, pa.list_(pa.int64()))


def chains(pieces: DataFrame, steps: list[tuple], block: int, radius: int | None = None) -> DataFrame:
    """The steps, and the boundary of each block's own pixels in the result: closed rings, and chains that leave the block."""
    kind = dict(pieces.dtypes)["image"]
    radius = max(reach(steps) if radius is None else radius, 1)

    def run(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        br, bc = key[1].as_py(), key[2].as_py()
        a, there, top, left = _window(group, block, radius)
        rows, cols = _core(a.shape, top, left, br, bc, block)
        if there[rows, cols].any():
            a = np.pad(run_steps(a, there, steps), 2)
            pr, pc = np.nonzero(a[rows.start + 2: rows.stop + 2, cols.start + 2: cols.stop + 2])
        else:
            pr = pc = np.zeros(0, np.int64)
        found = string_edges(*edges_of(a, pr + rows.start + 2, pc + cols.start + 2, np.zeros(len(pr), np.int64), top - 2, left - 2))
        n = len(found)
        return pa.table({"image": pa.array([key[0].as_py()] * n, group.schema.field("image").type), "br": pa.array([br] * n, pa.int32()), "bc": pa.array([bc] * n, pa.int32()),
                         **{c: pa.array(found[c].to_numpy(np.int64)) for c in ("head", "next", "least")}, "closed": pa.array(found["closed"].to_numpy(bool)),
                         **{c: pa.array(found[c].to_numpy(np.int64)) for c in ("n_edges", "area2")}, "xs": _listed(found["xs"].tolist()), "ys": _listed(found["ys"].tolist())})

    return _dealt(pieces, "image", "br", "bc").groupBy("image", "br", "bc").applyInArrow(run, CHAIN.format(kind=kind))


def _joined(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
    """Chains of a square strung together where one begins at the edge that another one leads to."""
    head, follow = (group.column(c).to_numpy() for c in ("head", "next"))
    order = np.argsort(head)
    at = order[np.minimum(np.searchsorted(head[order], follow), len(head) - 1)]
    after = np.where(head[at] == follow, at, -1)
    led = np.zeros(len(head), bool)
    led[after[after >= 0]] = True
    least, n_edges, area2 = (group.column(c).to_numpy() for c in ("least", "n_edges", "area2"))
    step, seen, paths = after.tolist(), np.zeros(len(head), bool), []
    # open paths from their first chain, then what is left: rings, from the chain with their smallest edge
    for first in [*np.flatnonzero(~led).tolist(), *np.argsort(least).tolist()]:
        path, k = [], first
        while k >= 0 and not seen[k]:
            seen[k] = True
            path.append(k)
            k = step[k]
        if path:
            paths.append((path, k >= 0))
    xs, ys = group.column("xs").to_pylist(), group.column("ys").to_pylist()
    one = lambda values: pa.array(values, pa.int64())
    n = len(paths)
    return pa.table({"image": pa.array([key[0].as_py()] * n, group.schema.field("image").type), "br": pa.array([key[1].as_py()] * n, pa.int32()),
                     "bc": pa.array([key[2].as_py()] * n, pa.int32()), "head": one([int(head[p[0]]) for p, _ in paths]), "next": one([int(follow[p[-1]]) for p, _ in paths]),
                     "least": one([int(least[p].min()) for p, _ in paths]), "closed": pa.array([c for _, c in paths], pa.bool_()),
                     "n_edges": one([int(n_edges[p].sum()) for p, _ in paths]), "area2": one([int(area2[p].sum()) for p, _ in paths]),
                     "xs": _listed([[x for k in p for x in xs[k]] for p, _ in paths]), "ys": _listed([[y for k in p for y in ys[k]] for p, _ in paths])})


def merged(found: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Closed rings within blocks, and those of open chains merged level by level."""
    schema = CHAIN.format(kind=dict(found.dtypes)["image"])
    inside, going, done = found.where("closed"), found.where("not closed"), None
    for _ in range(11):                                # squares of 2^33 blocks: more than pixel codes can tell apart
        if going.isEmpty():
            return inside, done
        level = going.withColumn("br", F.shiftright("br", LEVEL)).withColumn("bc", F.shiftright("bc", LEVEL))
        step = cut_lineage(level.groupBy("image", "br", "bc").applyInArrow(_joined, schema))
        done = step.where("closed") if done is None else done.unionByName(step.where("closed"))
        going = step.where("not closed")
    raise RuntimeError("Boundary chains did not close: a block's pieces are not what its neighbours saw.")


def rings(pieces: DataFrame, steps: list[tuple], block: int, radius: int | None = None, outer_only: bool = True) -> DataFrame:
    """``(image, label, ring_id, ring)`` of the 4-connected components after the steps, as `polygonize` gives them for outer rings:
    corner points from the first edge on; ``label`` is the component's first pixel. Holes, if asked for, have null labels."""
    inside, across = merged(cut_lineage(chains(pieces, steps, block, radius)))
    points = F.zip_with("xs", "ys", lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")))
    corner = F.floor(F.col("least") / 4).cast("long")
    y, x = F.floor(corner / (1 << 30)).cast("long"), corner % (1 << 30)
    label = F.when(F.col("area2") > 0, y * (1 << 32) + x)
    wanted = F.col("area2") > 0 if outer_only else F.lit(True)
    out = inside.where(wanted).select("image", label.alias("label"), F.col("least").alias("ring_id"), G.close(points).alias("ring"))
    if across is None:
        return out
    whole = across.where(wanted).select("image", label.alias("label"), F.col("least").alias("ring_id"), x.alias("x"), y.alias("y"), G.close(points).alias("ring"))
    whole = G.materialize(whole, "ring", G.drop_collinear(F.col("ring")))
    whole = G.materialize(whole, "ring", G.start_at(F.col("ring"), F.col("x"), F.col("y")))
    return out.unionByName(whole.drop("x", "y"))
