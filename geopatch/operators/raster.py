"""Rasters as chunks: holes filled from anywhere, and one grid brought to another chunk by chunk."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Pixels beyond a resampled place that can count: one for the weights, one for the fill of a hole.
HALO = 2


def nearest_valid(valid: np.ndarray) -> np.ndarray:
    """For each pixel the flat place of the nearest valid one, by distance, then row, then column; -1 if there is none.

    Two passes, each linear in the pixels: the nearest valid pixel of each
    column, then for each row the lower envelope of the columns' parabolas.
    All rows move along their envelopes together.  Distances are scaled so that
    row and column break ties in the same number.
    """
    h, w = valid.shape
    rows = np.arange(h)[:, None]
    far = 1 << 29
    above = np.maximum.accumulate(np.where(valid, rows, -far), 0)
    below = np.minimum.accumulate(np.where(valid, rows, far)[::-1], 0)[::-1]
    up = rows - above <= below - rows
    near = np.where(up, above, below)
    known = valid.any(0)
    if not known.any():
        return np.full((h, w), -1)
    columns = np.flatnonzero(known)
    scale = h * w
    # the value at its own column of each column's parabola, with the tie-breaker
    base = (near - rows) ** 2 * scale + near * w + np.arange(w)
    every = np.arange(h)
    stack = np.zeros((h, len(columns)), np.int64)
    starts = np.zeros((h, len(columns)), np.int64)
    top = np.full(h, -1)

    def first_better(old: np.ndarray, new: int, at: np.ndarray) -> np.ndarray:
        """The first place of the row from which the new column's parabola is below the old one's."""
        rise = base[at, new] + scale * new * new - base[at, old] - scale * old * old
        return rise // (2 * scale * (new - old)) + 1

    for q in columns:
        left = every
        place = np.zeros(h, np.int64)
        while len(left):
            held = left[top[left] >= 0]
            begin = np.maximum(first_better(stack[held, top[held]], q, held), 0)
            place[held] = begin
            beaten = begin <= starts[held, top[held]]
            top[held[beaten]] -= 1
            left = held[beaten]
            place[left[top[left] < 0]] = 0
        push = every[place < w]
        top[push] += 1
        stack[push, top[push]] = q
        starts[push, top[push]] = place[push]
    out = np.zeros((h, w), np.int64)
    for r in range(h):
        n = top[r] + 1
        begins = starts[r, :n]
        which = np.repeat(stack[r, :n], np.diff(np.r_[begins, w]))
        out[r] = near[r, which] * w + which
    return out


def nearest_fill(rows: DataFrame, column: str, width: int, nodata: float) -> DataFrame:
    """Rows whose array of a raster has each no-data pixel replaced by the nearest valid one, by distance, then row, then column; nulls are no-data; all no-data stays, and so do null arrays."""
    at = rows.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                one = batch.slice(k, 1)
                values = one.column(at).flatten().fill_null(nodata).to_numpy(zero_copy_only=False)
                plane = values.reshape(-1, width)
                valid = plane != nodata
                if not valid.all() and valid.any():
                    full = pa.array(values[nearest_valid(valid).ravel()], one.column(at).type.value_type)
                    one = one.set_column(at, batch.schema.field(at), pa.ListArray.from_arrays(pa.array([0, len(full)], pa.int32()), full).cast(one.column(at).type))
                yield one

    return rows.mapInArrow(run, rows.schema)


class Grid(NamedTuple):
    """A north-up raster: left and top edge, and the side of a pixel."""

    left: float | Column
    top: float | Column
    step: float

    def row(self, y: Column | float) -> Column:
        return F.floor((F.lit(self.top) - y) / self.step).cast("int")

    def col(self, x: Column | float) -> Column:
        return F.floor((x - F.lit(self.left)) / self.step).cast("int")


def source_rectangle(source: Grid, to: Grid, height: int, width: int) -> dict[str, Column]:
    """The source's pixels that hold the centres of the corner pixels of a scene: first row, rows, first column, columns."""
    x, y = F.lit(to.left), F.lit(to.top)
    top, left = source.row(y - to.step / 2), source.col(x + to.step / 2)
    return {"_top": top, "_rows": source.row(y - to.step * (height - 0.5)) - top + 1, "_left": left, "_cols": source.col(x + to.step * (width - 0.5)) - left + 1}


def place(k: Column, n_in: Column, n_out: int) -> Column:
    """Where the centre of an output pixel of an axis lies, in input pixels."""
    return (k + 0.5) * (n_in / n_out) - 0.5


def axis(first: int, count: int, n_in: int, n_out: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For output pixels of an axis the input pixels before and after their centres, the weight of the latter, and the one that holds the centre; edges are repeated."""
    at = (np.arange(first, first + count) + 0.5) * (n_in / n_out) - 0.5
    inside = lambda k: np.clip(np.floor(k), 0, n_in - 1).astype(np.int64)
    return inside(at), inside(at + 1), at - np.floor(at), inside(at + 0.5)


def neighbours_filled(values: np.ndarray, nodata: float, edge: tuple[int, int, int, int]) -> np.ndarray:
    """Holes with the nearest valid pixel among their eight neighbours within ``edge`` (first and last row and column), by distance, then row, then column."""
    out, todo = values.copy(), values == nodata
    low_r, high_r, low_c, high_c = edge
    inside = np.full((values.shape[0] + 2, values.shape[1] + 2), nodata, values.dtype)
    inside[1 + low_r : 2 + high_r, 1 + low_c : 2 + high_c] = values[low_r : high_r + 1, low_c : high_c + 1]
    for dy, dx in sorted(((y, x) for y in (-1, 0, 1) for x in (-1, 0, 1) if y or x), key=lambda o: (o[0] ** 2 + o[1] ** 2, o)):
        near = inside[1 + dy : 1 + dy + values.shape[0], 1 + dx : 1 + dx + values.shape[1]]
        take = todo & (near != nodata)
        out[take] = near[take]
        todo &= ~take
    return out


def align(chunks: DataFrame, side: int, tiles: DataFrame, source: Grid, to: Grid, height: int, width: int, to_side: int, nodata: float, order: int = 0) -> DataFrame:
    """``layer, band, tile, crow, ccol, data``: chunks of one grid brought to the chunks of a scene's grid.

    ``tiles(tile, ..)`` have the columns that the grids' corners are made of.
    The source's rectangle under the scene is stretched to the scene's size, by
    nearest or bilinear (``order`` 1) resampling; outside the source there is
    no-data, and holes stay holes but do not blur their neighbours.  Each
    target chunk is joined with the source chunks that its places and a halo of
    HALO pixels touch.  Of these only the rows it needs are shuffled, and it is
    computed from that cut-out alone, so no row is larger than a chunk with its
    halo and no task sees a whole raster.  Bands and tiles without any chunk
    are left out.
    """
    bands = chunks.select("layer", "band", "tile").distinct()
    box = tiles.select("tile", *[c.alias(n) for n, c in source_rectangle(source, to, height, width).items()])
    targets = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit((n - 1) // to_side))).alias(name)
    wanted = box.select("*", targets(height, "crow")).select("*", targets(width, "ccol"))

    def ends(k: str, size: int, n_in: str, first: str) -> tuple[Column, Column]:
        low, high = F.col(k) * to_side, F.least(F.col(k) * to_side + to_side, F.lit(size)) - 1
        clip = lambda c: F.least(F.greatest(c, F.lit(0)), F.col(n_in) - 1)
        return F.col(first) + clip(F.floor(place(low, F.col(n_in), size)) - HALO), F.col(first) + clip(F.floor(place(high, F.col(n_in), size)) + 1 + HALO)

    (r0, r1), (c0, c1) = ends("crow", height, "_rows", "_top"), ends("ccol", width, "_cols", "_left")
    wanted = wanted.withColumns({"_r0": r0.cast("int"), "_r1": r1.cast("int"), "_c0": c0.cast("int"), "_c1": c1.cast("int")})
    span = lambda low, high: F.explode(F.sequence(F.floor(F.col(low) / side).cast("int"), F.floor(F.col(high) / side).cast("int")))
    asked = wanted.withColumn("_sr", span("_r0", "_r1")).withColumn("_sc", span("_c0", "_c1"))
    own = chunks.select("layer", "band", "tile", F.col("crow").alias("_sr"), F.col("ccol").alias("_sc"), "data")
    first, last = F.greatest(F.col("_r0"), F.col("_sr") * side), F.least(F.col("_r1"), F.col("_sr") * side + side - 1)
    left, right = F.greatest(F.col("_c0"), F.col("_sc") * side), F.least(F.col("_c1"), F.col("_sc") * side + side - 1)
    rows = F.transform(F.sequence(first, last), lambda r: F.slice("data", ((r - F.col("_sr") * side) * side + left - F.col("_sc") * side + 1).cast("int"), (right - left + 1).cast("int")))
    keys = ["layer", "band", "tile", "crow", "ccol"]
    fixed = ["_top", "_rows", "_left", "_cols", "_r0", "_r1", "_c0", "_c1"]
    pieces = asked.join(own, ["tile", "_sr", "_sc"]).select(*keys, *fixed, first.alias("first"), left.alias("left"), rows.alias("rows"))
    empty = wanted.join(bands, "tile").select(*keys, *fixed, F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("left"), F.lit(None).cast(pieces.schema["rows"].dataType).alias("rows"))
    kind = chunks.schema["data"].dataType.elementType.simpleString() if not order else "double"

    def run(group: pa.Table) -> pa.Table:
        return resampled(group, height, width, to_side, nodata, order)

    return pieces.unionByName(empty).groupBy(*keys).applyInArrow(run, f"layer string, band string, tile string, crow int, ccol int, data array<{kind}>")


def resampled(group: pa.Table, height: int, width: int, to_side: int, nodata: float, order: int) -> pa.Table:
    """One target chunk from the pieces of source chunks around it; beyond the scene's edge it has nulls."""
    top, rows, left, cols, r0, r1, c0, c1 = (group[c][0].as_py() for c in ("_top", "_rows", "_left", "_cols", "_r0", "_r1", "_c0", "_c1"))
    crow, ccol = group["crow"][0].as_py(), group["ccol"][0].as_py()
    kind = group.schema.field("rows").type.value_type.value_type
    cut = np.full((r1 - r0 + 1, c1 - c0 + 1), nodata, np.float64 if order or pa.types.is_floating(kind) else kind.to_pandas_dtype())
    for first, at, piece in zip(group["first"].to_pylist(), group["left"].to_pylist(), group["rows"], strict=True):
        if first is not None:
            values = piece.values.flatten().fill_null(nodata).to_numpy(zero_copy_only=False).reshape(len(piece), -1)
            cut[first - r0 : first - r0 + values.shape[0], at - c0 : at - c0 + values.shape[1]] = values
    h, w = min(to_side, height - crow * to_side), min(to_side, width - ccol * to_side)
    yi, yj, yf, yk = axis(crow * to_side, h, rows, height)
    xi, xj, xf, xk = axis(ccol * to_side, w, cols, width)
    (yi, yj, yk), (xi, xj, xk) = ((k + top - r0 for k in (yi, yj, yk)), (k + left - c0 for k in (xi, xj, xk)))
    holes = cut[np.ix_(yk, xk)]
    out = holes
    if order:
        full = neighbours_filled(cut, nodata, (max(0, top - r0), min(len(cut) - 1, top + rows - 1 - r0), max(0, left - c0), min(cut.shape[1] - 1, left + cols - 1 - c0)))
        over = lambda y, x: full[np.ix_(y, x)]
        fy, fx = yf[:, None], xf[None, :]
        mixed = (1 - fy) * ((1 - fx) * over(yi, xi) + fx * over(yi, xj)) + fy * ((1 - fx) * over(yj, xi) + fx * over(yj, xj))
        out = np.where(holes == nodata, nodata, mixed)
    plane = np.ma.masked_all((to_side, to_side), out.dtype)
    plane[:h, :w] = out
    data = pa.array(plane.ravel().data, mask=np.ma.getmaskarray(plane).ravel(), type=pa.float64() if order else kind)
    keys = [group[c].slice(0, 1).combine_chunks() for c in ("layer", "band", "tile", "crow", "ccol")]
    return pa.Table.from_arrays([*keys, pa.ListArray.from_arrays(pa.array([0, to_side * to_side], pa.int32()), data)], names=["layer", "band", "tile", "crow", "ccol", "data"])
