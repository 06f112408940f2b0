"""Coordinates: encodings, map projection and affine grids, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from geopatch.schema import EARTH_RADIUS


def unit(x: Column) -> Column:
    """From [-1, 1] to [0, 1]."""
    return (x + 1.0) / 2.0


def cyclic(x: Column, period: float) -> Column:
    """cos and sin of an angle with the given period, in [0, 1]."""
    angle = x * (2 * math.pi / period)
    return F.struct(unit(F.cos(angle)).alias("cos"), unit(F.sin(angle)).alias("sin"))


def encode_lat_lon(lat: Column, lon: Column) -> Column:
    """lat_cos, lat_sin (period 180 degrees), lon_cos, lon_sin (period 360 degrees)."""
    a, b = lat * math.pi / 90.0, lon * math.pi / 180.0
    return F.struct(unit(F.cos(a)).alias("lat_cos"), unit(F.sin(a)).alias("lat_sin"), unit(F.cos(b)).alias("lon_cos"), unit(F.sin(b)).alias("lon_sin"))


def day_of_year(date: Column) -> Column:
    """cos and sin of the day of the year, counted from 0, over 365 days."""
    return cyclic((F.dayofyear(date) - 1).cast("double"), 365.0)


def split_coordinate(x: Column) -> Column:
    """The signed fraction and the magnitude of the whole part."""
    whole = x.cast("long")
    return F.struct((x - whole).alias("fraction"), F.abs(whole).cast("int").alias("whole"))


def join_coordinate(fraction: Column, whole: Column) -> Column:
    """The inverse of split_coordinate, except that a zero fraction gives 0, since the sign is there."""
    return F.signum(fraction) * (F.abs(fraction) + whole)


def pixel_coordinate(lat: Column, lon: Column, i: Column, j: Column, size: int, legacy: bool = False, resolution: float = 10.0) -> Column:
    """lat, lon of pixel (i, j) of a window whose centre is given.

    Rows run from north to south; with ``legacy`` latitude grows with the row.
    """
    half, degrees = size // 2, 180.0 / math.pi
    north = (i - half) * (resolution if legacy else -resolution)
    here = lat + north / EARTH_RADIUS * degrees
    return F.struct(here.alias("lat"), (lon + (j - half) * resolution / EARTH_RADIUS * degrees / F.cos(F.radians(here))).alias("lon"))


def utm(lon: Column, lat: Column, zone: Column, south: Column | bool = False) -> Column:
    """easting, northing of WGS84 degrees in a UTM zone, by the Krueger series to the third power of n.

    The zone is the tile's, so points beyond its borders are projected too;
    ``south`` adds the false northing of southern zones.
    """
    f = 1 / 298.257223563
    n = f / (2 - f)
    radius = 6378137.0 / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    series = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240]
    root = 2 * math.sqrt(n) / (1 + n)
    sine = F.sin(F.radians(lat))
    t = F.sinh(F.atanh(sine) - root * F.atanh(root * sine))
    turn = F.radians(lon - (zone * 6 - 183))
    xi = F.atan2(t, F.cos(turn))
    eta = F.atanh(F.sin(turn) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for k, a in enumerate(series, 1):
        east = east + a * F.cos(2 * k * xi) * F.sinh(2 * k * eta)
        north = north + a * F.sin(2 * k * xi) * F.cosh(2 * k * eta)
    false_north = F.when(south if isinstance(south, Column) else F.lit(south), 10_000_000.0).otherwise(0.0)
    return F.struct((0.9996 * radius * east + 500_000.0).alias("easting"), (0.9996 * radius * north + false_north).alias("northing"))


def row_col(x: Column, y: Column, x0: Column, y0: Column, px: Column, py: Column) -> Column:
    """The pixel of a north-up grid that holds a point."""
    return F.struct(F.floor((y0 - y) / F.abs(py)).cast("int").alias("row"), F.floor((x - x0) / px).cast("int").alias("col"))


def pixel_centre(row: Column, col: Column, x0: Column, y0: Column, px: Column, py: Column) -> Column:
    return F.struct((x0 + (col + 0.5) * px).alias("x"), (y0 - (row + 0.5) * F.abs(py)).alias("y"))


def interpolated(first: Column, last: Column, k: Column, count: Column) -> Column:
    """The k-th of ``count`` values spread evenly from first to last."""
    return first + (last - first) * k / (count - 1)
