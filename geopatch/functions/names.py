"""Names and dates: product names, packed footprint keys, tile names and mission days."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from geopatch.schema import BAND_OF_ID, MISSION_START, OFFSET_START


def _part(name: Column, k: int) -> Column:
    return F.split_part(name, F.lit("_"), F.lit(k))


def _number(text: Column, mark: str, kind: str = "int") -> Column:
    """The number after leading marks; null if there is none."""
    return F.regexp_replace(text, f"^{mark}+", "").try_cast(kind)


def pattern_parts(pattern: Column) -> Column:
    """granule_num, track_num, ppds, version_num of a packed footprint key with six parts."""
    return F.struct(
        _part(pattern, 3).try_cast("short").alias("granule_num"),
        _number(_part(pattern, 4), "T", "long").alias("track_num"),
        _part(pattern, 5).try_cast("short").alias("ppds"),
        _number(_part(pattern, 6), "V").alias("version_num"),
    )


def scene_parts(scene: Column) -> Column:
    """acq_ts, pbn, ron, tile of a product name with seven parts; parts that do not parse are null."""
    return F.struct(
        F.try_to_timestamp(_part(scene, 3), F.lit("yyyyMMdd'T'HHmmss")).alias("acq_ts"),
        _number(_part(scene, 4), "N").alias("pbn"),
        _number(_part(scene, 5), "R").alias("ron"),
        F.regexp_replace(_part(scene, 6), "^T+", "").alias("tile"),
    )


def tile_name(line: Column) -> Column:
    """A tile or product name from a line of a list file: trimmed, without the archive's suffix."""
    return F.regexp_replace(F.trim(line), r"\.zip$", "")


def tile_epsg(tile: Column) -> Column:
    """The EPSG code of a tile's UTM zone: 327zz for bands C to M, 326zz for N to X; another band is an error."""
    band, zone = F.substring(tile, 3, 1), F.substring(tile, 1, 2)
    code = F.when(band.between("C", "M"), F.concat(F.lit("327"), zone)).when(band.between("N", "X"), F.concat(F.lit("326"), zone))
    return F.when(tile.isNotNull(), F.coalesce(code, F.raise_error(F.concat(F.lit("no UTM band in tile "), tile)).cast("string"))).cast("int")


def mission_days(ts: Column) -> Column:
    """Whole days since the mission's start, negative before it."""
    return F.datediff(F.to_date(ts), F.lit(MISSION_START).cast("date"))


def mission_date(days: Column) -> Column:
    return F.date_add(F.lit(MISSION_START).cast("date"), days.cast("int"))


def offset_flag(ts: Column) -> Column:
    """1 from the day on which products carry a radiometric offset, else 0."""
    return (F.to_date(ts) >= F.lit(OFFSET_START).cast("date")).cast("int")


def two_digit_year(ts: Column) -> Column:
    return F.date_format(ts, "yy")


def in_year(days: Column, year: int) -> Column:
    """Whether a mission day lies in a calendar year, and not before the mission."""
    start = F.lit(MISSION_START).cast("date")
    first = F.greatest(F.datediff(F.make_date(F.lit(year), F.lit(1), F.lit(1)), start), F.lit(0))
    last = F.datediff(F.make_date(F.lit(year), F.lit(12), F.lit(31)), start)
    return days.between(first, last)


def band_of(number: Column) -> Column:
    """The name of a band by its number in a product's metadata, null for another number."""
    return F.get(F.array(*map(F.lit, BAND_OF_ID)), number.cast("int"))
