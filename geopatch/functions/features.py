"""Pixel features: calibration, normalisation, land-cover encodings and feature lists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geopatch.functions.geo import cyclic
from geopatch.schema import DERIVED, FEATURE_GROUPS, GAMMA0_NODATA, NODATA, PREDICTION_NODATA, PRESETS


def reflectance(dn: Column, offset: Column) -> Column:
    """Reflectance of a digital number, with the radiometric offset if flagged; 0 stays 0, negatives become 0."""
    return F.when(dn == 0, 0.0).otherwise(F.greatest((dn - 1000 * offset) / 10000.0, F.lit(0.0)))


def gamma0(dn: Column) -> Column:
    """Radar backscatter in decibels; 0 is no-data."""
    value = dn.cast("double")
    return F.when(dn == 0, GAMMA0_NODATA).otherwise(10.0 * F.log10(F.when(dn != 0, value * value)) - 83.0)


def mean_std(x: Column, stats: dict[str, Column], nodata: Column) -> Column:
    return F.when(x == nodata, 0.0).otherwise((x - stats["mean"]) / stats["std"])


def min_max(x: Column, stats: dict[str, Column], nodata: Column) -> Column:
    return F.when(x == nodata, 0.0).otherwise((x - stats["min"]) / (stats["max"] - stats["min"]))


def pct(x: Column, stats: dict[str, Column], nodata: Column) -> Column:
    scaled = F.when(x == nodata, 0.0).otherwise((x - stats["p1"]) / (stats["p99"] - stats["p1"]))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), scaled))


STRATEGIES: dict[str, Callable[[Column, dict[str, Column], Column], Column]] = {"mean_std": mean_std, "pct": pct, "min_max": min_max}


def normalize(x: Column, stats: dict[str, Column], strategy: str, nodata: Column, date: bool = False) -> Column:
    """A value normalised by a named strategy; no-data becomes 0.  Dates use min_max where the strategy is pct."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy}")
    return STRATEGIES["min_max" if date and strategy == "pct" else strategy](x, stats, nodata)


def land_cover_cyclic(lc: Column) -> Column:
    """cos and sin of a class over 100; no-data gives 0."""
    turn = cyclic(lc.cast("double"), 100.0)
    hole = lc == NODATA["LC"]
    return F.struct(F.when(hole, 0.0).otherwise(turn["cos"]).alias("lc_cos"), F.when(hole, 0.0).otherwise(turn["sin"]).alias("lc_sin"))


def land_cover_probability(p: Column) -> Column:
    return F.when(p == NODATA["LC"], 0.0).otherwise(p / 100.0)


def embedded(lc: Column, table: dict[int, list[float]]) -> Column:
    """The class's vector, that of class 0 if it has none; the table is a small parameter."""
    vectors = F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return F.coalesce(F.try_element_at(vectors, lc.cast("int")), F.array(*map(F.lit, table[0])))


def encode_prediction(x: Column) -> Column:
    """A prediction as an unsigned 16-bit number: negatives 0, too large or undefined ones no-data, else truncated."""
    undefined = x.isNull() | F.isnan(x) | (x > PREDICTION_NODATA)
    return F.when(x < 0, 0).when(undefined, PREDICTION_NODATA).otherwise(F.when(~undefined & (x >= 0), x).cast("int"))


def feature_names(bands: list[str], **groups: bool) -> list[str]:
    """Feature columns in canonical order: the bands, latitude, and the groups that are switched on."""
    if unknown := set(groups) - set(FEATURE_GROUPS):
        raise ValueError(f"unknown groups {sorted(unknown)}")
    return [*bands, *(name for group, names in FEATURE_GROUPS.items() if group == "lat" or groups.get(group) for name in names)]


def preset(name: str) -> list[str]:
    """The feature columns of a named preset."""
    return feature_names(**PRESETS[name])


def record(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The stored columns of a footprint's record; those that are derived again when needed, and the scene, are refused."""
    if wrong := set(columns) & {*DERIVED, "scene"}:
        raise ValueError(f"not stored: {sorted(wrong)}")
    return rows.select(*columns)
