"""Two-dimensional windows on flattened arrays, row by row.

Everything is a higher-order function of the array column, so a patch stays in
one row and no Python runs.  Positions outside the array are null.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from geopatch.functions.geo import unit
from geopatch.schema import VEGETATION


def once(value: Column, of: Callable[[Column], Column]) -> Column:
    """of(value), where the value is computed once, however often and in whatever loops ``of`` reads it."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def cells(height: int | Column, width: int | Column, of: Callable[[Column, Column], Column]) -> Column:
    """A flattened array of of(row, column) over a grid."""
    height, width = (x if isinstance(x, Column) else F.lit(x) for x in (height, width))
    return F.transform(F.sequence(F.lit(0), height * width - 1), lambda k: of(F.floor(k / width).cast("int"), (k % width).cast("int")))


def at(a: Column, row: Column, col: Column, width: int | Column) -> Column:
    return F.get(a, (row * width + col).cast("int"))


def window(a: Column, row: Column, col: Column, width: int | Column, size: int) -> Column:
    """The square window of an odd size around a pixel; it must fit."""
    half = size // 2
    rows = F.transform(F.sequence(row - half, row + half), lambda r: F.slice(a, (r * width + col - half + 1).cast("int"), F.lit(size)))
    return F.flatten(rows)


def fits(row: Column, col: Column, height: int | Column, width: int | Column, size: int) -> Column:
    """Whether the window around a pixel lies in the raster."""
    half = size // 2
    return (row - half >= 0) & (row + half + 1 <= height) & (col - half >= 0) & (col + half + 1 <= width)


def centre(a: Column, size: int) -> Column:
    return F.get(a, F.lit((size * size) // 2))


def transposed(a: Column, height: int, width: int) -> Column:
    return cells(width, height, lambda r, c: at(a, c, r, width))


def plane(value: Column, size: int) -> Column:
    """A scalar on every pixel."""
    return F.array_repeat(value, size * size)


def crop_pad(a: Column, height: Column | int, width: Column | int, top: Column, bottom: Column, left: Column, right: Column, fill: Column) -> Column:
    """The rectangle top..bottom, left..right (inclusive), with ``fill`` outside the array."""

    def of(r: Column, c: Column) -> Column:
        y, x = r + top, c + left
        inside = (y >= 0) & (y < height) & (x >= 0) & (x < width)
        return F.when(inside, at(a, y, x, width)).otherwise(fill)

    return cells(bottom - top + 1, right - left + 1, of)


def score(a: Column, size: int, good: Callable[[Column], Column]) -> Column:
    """Percent of pixels that are good, truncated; 0 if the centre is not."""
    share = F.floor(F.lit(100) * F.size(F.filter(a, good)) / (size * size)).cast("int")
    return F.when(good(centre(a, size)), share).otherwise(0)


def vegetation_score(scl: Column, size: int) -> Column:
    return score(scl, size, lambda x: x == VEGETATION)


def validity_score(a: Column, size: int, nodata: int) -> Column:
    return score(a, size, lambda x: x != nodata)


def one_hot(value: Column, classes: list[int]) -> Column:
    """1 for the value's class; a value of no class counts as the first."""
    known = value.isin(classes)
    return F.transform(F.array(*map(F.lit, classes)), lambda c, i: F.when(known, c == value).otherwise(i == 0).cast("int"))


def filled(a: Column, height: int | Column, width: int | Column, nodata: Column, reach: int = 1) -> Column:
    """No-data pixels with the nearest valid value within ``reach`` pixels, by distance, then row, then column.

    Pixels without a valid neighbour stay.  Resampling needs a reach of one only:
    a pixel that survives it is the nearest one of a cell whose other corners
    are at most a diagonal away.
    """
    offsets = sorted(((dy * dy + dx * dx, dy, dx) for dy in range(-reach, reach + 1) for dx in range(-reach, reach + 1)))

    def of(r: Column, c: Column) -> Column:
        values = []
        for _, dy, dx in offsets:
            y, x = r + dy, c + dx
            inside = (y >= 0) & (y < height) & (x >= 0) & (x < width)
            v = at(a, y, x, width)
            values.append(F.when(inside & (v != nodata), v))
        return F.coalesce(*values, nodata)

    return cells(height, width, of)


def _axis(n_in: int | Column, n_out: int) -> Column:
    """For each output pixel of an axis, the input pixels before and after its centre, the weight of the latter, and the one that holds the centre; edges are repeated."""
    last = n_in - 1
    if isinstance(n_in, int):
        places = [(k + 0.5) * (n_in / n_out) - 0.5 for k in range(n_out)]
        clamp = lambda k: min(max(k, 0), last)
        rows = [(clamp(math.floor(s)), clamp(math.floor(s) + 1), s - math.floor(s), clamp(math.floor(s + 0.5))) for s in places]
        return F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(f).alias("f"), F.lit(k).alias("k")) for i, j, f, k in rows])
    place = lambda k: (k + 0.5) * (n_in / n_out) - 0.5
    inside = lambda k: F.least(F.greatest(F.floor(k), F.lit(0)), last).cast("int")
    return F.transform(F.sequence(F.lit(0), F.lit(n_out - 1)), lambda k: F.struct(inside(place(k)).alias("i"), inside(place(k) + 1).alias("j"), (place(k) - F.floor(place(k))).alias("f"), inside(place(k) + 0.5).alias("k")))


def _over(h: int | Column, w: int | Column, to_h: int, to_w: int, of: Callable[[Column, Column], Column]) -> Column:
    """of(row axis, column axis) of each output pixel; the axes' places and weights are computed once, not for each pixel."""
    return F.flatten(F.transform(_axis(h, to_h), lambda y: F.transform(_axis(w, to_w), lambda x: of(y, x))))


def nearest(a: Column, h: int | Column, w: int | Column, to_h: int, to_w: int) -> Column:
    """Each output pixel takes the input pixel that holds its centre."""
    return _over(h, w, to_h, to_w, lambda y, x: at(a, y["k"], x["k"], w))


def bilinear(a: Column, h: int | Column, w: int | Column, to_h: int, to_w: int) -> Column:
    """Each output pixel is weighted from the four input pixels around its centre."""

    def of(y: Column, x: Column) -> Column:
        v = lambda r, c: at(a, r, c, w).cast("double")
        return (1 - y["f"]) * ((1 - x["f"]) * v(y["i"], x["i"]) + x["f"] * v(y["i"], x["j"])) + y["f"] * ((1 - x["f"]) * v(y["j"], x["i"]) + x["f"] * v(y["j"], x["j"]))

    return _over(h, w, to_h, to_w, of)


def resampled(full: Column, a: Column, h: int, w: int, to_h: int, to_w: int, nodata: Column, order: int) -> Column:
    """``full`` (the array after ``filled``) resampled, with the no-data pixels of ``a`` put back by nearest resampling; infinite values are an error."""
    infinite = F.exists(full, lambda x: F.abs(x.cast("double")) == math.inf)
    checked = F.when(~infinite, full).otherwise(F.raise_error(F.lit("a raster to resample has infinite values")))
    values = once(checked, lambda x: (bilinear if order else nearest)(x, h, w, to_h, to_w))
    holes = nearest(a, h, w, to_h, to_w)
    return F.zip_with(values, holes, lambda v, hole: F.when(hole == nodata, nodata).otherwise(v))


def aligned(a: Column, height: int, width: int, grid: tuple[Column, Column, float], to: tuple[float, float, float, int, int], nodata: Column, order: int = 0) -> Column:
    """An array on a grid ``(left, top, resolution)`` brought to the scene's grid ``(left, top, resolution, height, width)``.

    The pixels of the array that hold the centres of the scene's corner pixels
    bound a rectangle, which is cut out, with no-data beyond the array, and
    resampled to the scene's size.
    """
    (left, top, step), (to_left, to_top, to_step, to_h, to_w) = grid, to
    row = lambda y: F.floor((top - y) / step).cast("int")
    col = lambda x: F.floor((x - left) / step).cast("int")
    t, b = row(to_top - to_step / 2), row(to_top - to_step * (to_h - 0.5))
    lo, hi = col(to_left + to_step / 2), col(to_left + to_step * (to_w - 0.5))
    h, w = b - t + 1, hi - lo + 1

    def scaled(cut: Column) -> Column:
        holes = nearest(cut, h, w, to_h, to_w)
        if not order:
            return holes
        values = once(filled(cut, h, w, nodata), lambda x: bilinear(x, h, w, to_h, to_w))
        return F.zip_with(values, holes, lambda v, hole: F.when(hole == nodata, nodata).otherwise(v))

    return once(crop_pad(a, height, width, t, b, lo, hi, nodata), scaled)


def _gradient(a: Column, r: Column, c: Column, size: int, by_row: bool, step: float) -> Column:
    """Central differences inside, one-sided ones at the edges."""
    k = r if by_row else c
    before, after = F.greatest(k - 1, F.lit(0)), F.least(k + 1, F.lit(size - 1))
    value = (lambda k: at(a, k, c, size)) if by_row else (lambda k: at(a, r, k, size))
    return (value(after) - value(before)) / ((after - before) * step)


def slope_aspect(dem: Column, size: int, step: float = 10.0) -> Column:
    """An array of slope, aspect_cos, aspect_sin of each pixel of a square of at least two by two; no-data is not masked."""

    def of(r: Column, c: Column) -> Column:
        px, py = _gradient(dem, r, c, size, True, step), _gradient(dem, r, c, size, False, step)
        turn = math.pi / 2 - F.atan2(py, px)
        aspect = F.when(turn < 0, turn + 2 * math.pi).otherwise(turn)
        return F.struct(F.sqrt(px * px + py * py).alias("slope"), unit(F.cos(aspect)).alias("aspect_cos"), unit(F.sin(aspect)).alias("aspect_sin"))

    return cells(size, size, of)


def any_in_blocks(mask: Column, size: int, block: int) -> Column:
    """A boolean mask on coarser pixels: set if any pixel of the block is."""
    to = size // block
    within = lambda r, c: F.exists(F.sequence(F.lit(0), F.lit(block * block - 1)), lambda k: at(mask, r * block + F.floor(k / block), c * block + k % block, size))
    return cells(to, to, within)
