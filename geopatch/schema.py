"""Fixed values of the data model: bands, layers, sentinels, classes and presets."""

from __future__ import annotations

from pyspark.sql import types as T

#: Fixed values.
MISSION_START = "2019-04-17"
OFFSET_START = "2022-01-25"
BANDS = ["B01", "B02", "B03", "B04", "B05", "B06", "B07", "B08", "B8A", "B09", "B11", "B12"]
#: The names of the bands by their number in a product's metadata.
BAND_OF_ID = ["B01", "B02", "B03", "B04", "B05", "B06", "B07", "B08", "B8A", "B09", "B10", "B11", "B12"]
RGBN = ["B02", "B03", "B04", "B08"]
NODATA = {"S2": 0, "ALOS": 0, "CH": 255, "LC": 255, "DEM": -9999}
GAMMA0_NODATA = -9999.0
PREDICTION_NODATA = 65535
QUANTIFICATION, BOA_OFFSET = 10000, 1000
EARTH_RADIUS = 6371000.0
VEGETATION, WATER, SNOW = 4, 6, 11
MIN_SCORE = 20
BIOMES = [20, 30, 40, 90, 111, 112, 114, 115, 116, 121, 122, 124, 125, 126]
LAND_COVER = [0, 20, 30, 40, 50, 60, 70, 80, 90, 111, 112, 113, 114, 115, 116, 121, 122, 124, 125, 126]
#: Groups of feature columns in canonical order; the bands stand before all.
FEATURE_GROUPS = {
    "s2_dates": ["s2_num_days", "s2_doy_cos", "s2_doy_sin"],
    "s1": ["s1_vv", "s1_vh", "s1_num_days", "s1_doy_cos", "s1_doy_sin"],
    "lat": ["lat_cos", "lat_sin"],
    "latlon": ["lon_cos", "lon_sin"],
    "gedi_dates": ["gedi_num_days", "gedi_doy_cos", "gedi_doy_sin"],
    "alos": ["alos_hh", "alos_hv"],
    "ch": ["ch", "ch_std"],
    "lc": ["lc_cos", "lc_sin", "lc_prob"],
    "dem": ["dem"],
}
PRESETS = {
    "all": {"bands": BANDS, "latlon": True, "ch": True, "alos": True, "lc": True, "dem": True},
    "ch": {"bands": [], "latlon": True, "ch": True},
    "RGBN": {"bands": RGBN, "latlon": True},
    "S2": {"bands": BANDS, "latlon": True},
    "S2ALOS": {"bands": BANDS, "latlon": True, "alos": True},
    "S2DEM": {"bands": BANDS, "latlon": True, "dem": True},
    "S2LC": {"bands": BANDS, "latlon": True, "lc": True},
    "S2LCDEMALOS": {"bands": BANDS, "latlon": True, "alos": True, "lc": True, "dem": True},
}

#: Storage types of footprints, by column.
FOOTPRINT = T.StructType(
    [
        T.StructField("shot_number", T.LongType()),
        T.StructField("lon", T.DoubleType()),
        T.StructField("lat", T.DoubleType()),
        T.StructField("agbd", T.FloatType()),
        T.StructField("gedi_days", T.IntegerType()),
        T.StructField("granule_num", T.ShortType()),
        T.StructField("track_num", T.LongType()),
        T.StructField("ppds", T.ShortType()),
        T.StructField("version_num", T.IntegerType()),
    ]
)
#: Columns that are derived again when needed, and so are not stored.
DERIVED = ["doy_cos", "doy_sin", "lat_cos", "lat_sin", "lon_cos", "lon_sin", "beam", "pattern"]
