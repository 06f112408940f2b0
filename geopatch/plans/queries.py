"""The registered queries: each operator over whole tables, with its SQL counterpart."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geopatch.functions import arrays, features, geo, names
from geopatch.operators import boosting, losses, matching, mosaic, prediction, raster, statistics, windows
from geopatch.plans import sql
from geopatch.plans.sql import using
from geopatch.schema import BAND_OF_ID, BIOMES, PRESETS
from geopatch.sources import adapters, catalog, chunks, scratch
from geopatch.streaming import ingest, waiting

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
PATCH = 5
STATS = {"mean": 900.0, "std": 700.0, "p1": 12.0, "p99": 3200.0, "min": 0.0, "max": 5000.0}
TO = {"nearest": 160, "block": 64}


def query(text: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if text:
            SQL[f.__name__] = text
        return f

    return add


def r6(x) -> F.col:
    return F.round(x, 6)


def joined(array) -> F.col:
    """An array of whole numbers as text."""
    return F.array_join(F.transform(array, lambda x: x.cast("string")), ",")


# --- names, dates, scans -------------------------------------------------


@query(using(sql.SCENES) + """select scene, strptime(split_part(scene, '_', 3), '%Y%m%dT%H%M%S') acq_ts, cast(ltrim(split_part(scene, '_', 4), 'N') as int) pbn,
  cast(ltrim(split_part(scene, '_', 5), 'R') as int) ron, ltrim(split_part(scene, '_', 6), 'T') tile, cast(date_diff('day', date '2019-04-17', acq_date) as int) s2_days,
  case when acq_date >= date '2022-01-25' then 1 else 0 end boa_offset, strftime(acq_date, '%y') yy from scenes""")
def scene_parse(spark, sf_dir):
    rows = adapters.scenes(spark, sf_dir).select("scene", names.scene_parts(F.col("scene")).alias("p")).select("scene", "p.*")
    return rows.withColumns({"s2_days": names.mission_days(F.col("acq_ts")), "boa_offset": names.offset_flag(F.col("acq_ts")), "yy": names.two_digit_year(F.col("acq_ts"))})


@query(using(sql.FOOTPRINTS) + """select shot_number, cast(split_part(pattern, '_', 3) as smallint) granule_num, cast(ltrim(split_part(pattern, '_', 4), 'T') as bigint) track_num,
  cast(split_part(pattern, '_', 5) as smallint) ppds, cast(ltrim(split_part(pattern, '_', 6), 'V') as int) version_num from footprints""")
def pattern_parse(spark, sf_dir):
    return adapters.footprints(spark, sf_dir).select("shot_number", names.pattern_parts(F.col("pattern")).alias("p")).select("shot_number", "p.*")


@query(using(sql.GRID) + "select tile, cast(case when substr(tile, 3, 1) between 'C' and 'M' then '327' else '326' end || substr(tile, 1, 2) as int) epsg from grid")
def tile_epsg(spark, sf_dir):
    return adapters.grid_tiles(spark, sf_dir).select("tile", names.tile_epsg(F.col("tile")).alias("epsg"))


@query(using(sql.FOOTPRINTS) + """select shot_number, cast(date_diff('day', date '2019-04-17', gedi_date) as int) gedi_days, gedi_date same_date from footprints
  where gedi_date >= date '2019-04-17' and year(gedi_date) = 2020""")
def year_filter(spark, sf_dir):
    rows = adapters.footprints(spark, sf_dir).withColumn("gedi_days", names.mission_days(F.col("gedi_date")))
    return rows.where(names.in_year(F.col("gedi_days"), 2020)).select("shot_number", "gedi_days", names.mission_date(F.col("gedi_days")).alias("same_date"))


@query(using(sql.TILES, sql.FOOTPRINTS) + """select shot_number, round(lon, 6) lon, round(lat, 6) lat, f.tile, round(agbd, 8) agbd from footprints f
  where lon between -10 and 40 and lat between -20 and 20 and tile in (select tile from tiles where ti < 12)""")
def footprint_scan(spark, sf_dir):
    wanted = adapters.tiles(spark, sf_dir).where("ti < 12").select(names.tile_name(F.concat(F.lit(" "), "tile", F.lit(".zip "))).alias("tile"))
    rows = adapters.footprints(spark, sf_dir).where("lon between -10 and 40 and lat between -20 and 20").join(wanted, "tile", "left_semi")
    return rows.select("shot_number", r6("lon").alias("lon"), r6("lat").alias("lat"), "tile", F.round("agbd", 8).alias("agbd"))


@query(using(sql.FOOTPRINTS) + """select shot_number, cast(agbd as float) agbd, cast(trunc(agbd) as smallint) agbd_whole, cast(null as smallint) beyond from footprints""")
def cast_project(spark, sf_dir):
    rows = adapters.footprints(spark, sf_dir).withColumn("beam", F.lit("x")).drop("beam", "pattern")
    return rows.select("shot_number", F.col("agbd").cast("float").alias("agbd"), F.col("agbd").try_cast("short").alias("agbd_whole"), (F.col("agbd") + 1e9).try_cast("short").alias("beyond"))


# --- matching ------------------------------------------------------------

ASOF = """matched as (
  select f.*, case when s.acq_date >= cast(date_trunc('month', f.gedi_date) - interval 5 month as date) then s.scene end scene
  from footprints f asof left join (select tile, acq_date, max(scene) scene from scenes group by 1, 2) s on f.tile = s.tile and f.gedi_date >= s.acq_date)"""


def _matched(spark, sf_dir):
    return matching.asof_join(adapters.footprints(spark, sf_dir), adapters.scenes(spark, sf_dir).select("tile", "acq_date", "scene"))


@query(using(sql.FOOTPRINTS, sql.SCENES, ASOF) + "select shot_number, tile, gedi_date, scene from matched where gedi_date >= date '2019-04-17'")
def asof_scene(spark, sf_dir):
    return _matched(spark, sf_dir).where("gedi_date >= date'2019-04-17'").select("shot_number", "tile", "gedi_date", "scene")


@query(using(sql.FOOTPRINTS, sql.SCENES, ASOF) + """select tile, count(*) n, cast(count(*) filter (scene is null) as bigint) dropped, round(cast(count(*) filter (scene is null) as double) / count(*), 6) ratio
  from matched group by tile""")
def asof_unmatched_ratio(spark, sf_dir):
    return matching.match_loss(_matched(spark, sf_dir)).withColumn("ratio", r6("ratio"))


@query(using(sql.FOOTPRINTS, sql.SCENES, ASOF) + "select scene, count(*) n_footprints, cast(year(min(gedi_date)) as int) first_year from matched where scene is not null group by scene")
def scene_groups(spark, sf_dir):
    return _matched(spark, sf_dir).where("scene is not null").groupBy("scene").agg(F.count("*").alias("n_footprints"), F.year(F.min("gedi_date")).alias("first_year"))


@query(using(sql.FOOTPRINTS, sql.TILES) + """select f.shot_number, t.tile from (select shot_number, lon, lat from footprints) f join tiles t
  on f.lon between t.min_lon and t.max_lon and f.lat between t.min_lat and t.max_lat""")
def spatial_tiles(spark, sf_dir):
    points = adapters.footprints(spark, sf_dir).select("shot_number", "lon", "lat")
    return matching.spatial_join(points, adapters.tiles(spark, sf_dir)).select("shot_number", "tile")


def _sql_utm() -> str:
    f = 1 / 298.257223563
    n = f / (2 - f)
    radius = 6378137.0 / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    series = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240]
    root = 2 * math.sqrt(n) / (1 + n)
    sinh, cosh = "((exp({0}) - exp(-({0}))) / 2)", "((exp({0}) + exp(-({0}))) / 2)"
    east = "eta" + "".join(f" + cast({a!r} as double) * cos({2 * k} * xi) * {sinh.format(f'{2 * k} * eta')}" for k, a in enumerate(series, 1))
    north = "xi" + "".join(f" + cast({a!r} as double) * sin({2 * k} * xi) * {cosh.format(f'{2 * k} * eta')}" for k, a in enumerate(series, 1))
    return f"""a as (select *, cast(floor((lon + 180) / 6) as int) + 1 as zone, lat < 0 south, sin(radians(lat)) s from footprints),
b as (select *, {sinh.format(f'(atanh(s) - cast({root!r} as double) * atanh(cast({root!r} as double) * s))')} t, radians(lon - (zone * 6 - 183)) turn from a),
c as (select *, atan2(t, cos(turn)) xi, atanh(sin(turn) / sqrt(1 + t * t)) eta from b),
projected as (select shot_number, cast({0.9996 * radius!r} as double) * ({east}) + 500000 easting, cast({0.9996 * radius!r} as double) * ({north}) + case when south then 10000000 else 0 end northing from c)"""


def _projected(spark, sf_dir):
    """Footprints in the UTM zone they lie in."""
    zone = (F.floor((F.col("lon") + 180) / 6) + 1).cast("int")
    rows = adapters.footprints(spark, sf_dir)
    return rows.select("shot_number", geo.utm(F.col("lon"), F.col("lat"), zone, F.col("lat") < 0).alias("p")).select("shot_number", "p.*")


@query(using(sql.FOOTPRINTS, _sql_utm()) + "select shot_number, round(easting, 3) easting, round(northing, 3) northing from projected")
def utm_project(spark, sf_dir):
    return _projected(spark, sf_dir).select("shot_number", F.round("easting", 3).alias("easting"), F.round("northing", 3).alias("northing"))


@query(using(sql.FOOTPRINTS, _sql_utm()) + "select shot_number from projected where easting between 300000 and 700000 and northing between 1000000 and 9000000")
def scene_bounds(spark, sf_dir):
    return matching.bounds_filter(_projected(spark, sf_dir), tuple(map(F.lit, (300000.0, 700000.0, 1000000.0, 9000000.0)))).select("shot_number")


@query(using(sql.SCENES) + "select year, tile, arg_min(scene, (cloud, scene)) scene from (select *, cast(year(acq_date) as int) as year from scenes) group by year, tile")
def scene_of_year(spark, sf_dir):
    return matching.scene_of_year(adapters.scenes(spark, sf_dir))


@query(using(sql.SCENES) + "select scene, tile from scenes where (dayofyear(acq_date) + ti) % 10 = 0")
def scene_quarantine(spark, sf_dir):
    scenes = adapters.scenes(spark, sf_dir)
    readable = scenes.where((F.dayofyear("acq_date") + F.col("ti")) % 10 != 0)
    return matching.quarantined(scenes, readable).select("scene", "tile")


@query(using(sql.SCENES) + "select distinct tile, strftime(acq_date, '%y') yy from scenes")
def scene_years(spark, sf_dir):
    return adapters.scenes(spark, sf_dir).select("tile", names.two_digit_year(F.col("acq_date")).alias("yy")).distinct()


@query(using(sql.FOOTPRINTS, sql.SCENES) + """select f.shot_number, s.scene from (select shot_number, tile, cast(year(gedi_date) as int) y from footprints) f
  left join (select y, tile, arg_min(scene, (cloud, scene)) scene from (select *, cast(year(acq_date) as int) y from scenes) group by 1, 2) s on f.tile = s.tile and f.y = s.y""")
def scene_lookup(spark, sf_dir):
    rows = adapters.footprints(spark, sf_dir).select("shot_number", "tile", F.year("gedi_date").alias("year"))
    return rows.join(matching.scene_of_year(adapters.scenes(spark, sf_dir)), ["tile", "year"], "left").select("shot_number", "scene")


@query(using(sql.SCENES) + """select scene, band, reason from (
  select scene, band, case when ti = 3 then 'quantification' when acq_date >= date '2022-01-25' and band = 'B02' and ti = 5 then 'offset' end reason
  from scenes, (values ('B01'), ('B02'), ('B03'), ('B04'), ('B05'), ('B06'), ('B07'), ('B08'), ('B8A'), ('B09'), ('B10'), ('B11'), ('B12')) b(band)) where reason is not null""")
def metadata_violations(spark, sf_dir):
    meta = adapters.scenes(spark, sf_dir).select(
        "scene",
        "ti",
        F.when(F.col("ti") == 3, 1000).otherwise(10000).alias("quantification"),
        names.offset_flag(F.col("acq_date")).alias("boa_offset"),
        F.explode(F.sequence(F.lit(0), F.lit(len(BAND_OF_ID) - 1))).alias("band_id"),
    )
    meta = meta.withColumn("band", names.band_of(F.col("band_id")))
    meta = meta.withColumn("offset", F.when((F.col("ti") == 5) & (F.col("band") == "B02"), -1000).otherwise(1000))
    return matching.metadata_violations(meta, 10000, 1000)


@query(SQL["metadata_violations"])
def metadata_from_xml(spark, sf_dir):
    """The same rules over metadata read from XML files."""
    path, scenes = scratch.folder(spark), adapters.scenes(spark, sf_dir)
    flagged = names.offset_flag(F.col("acq_date")) == 1
    ids = F.sequence(F.lit(0), F.lit(len(BAND_OF_ID) - 1))
    physical = F.array(*[F.lit(b.replace("B0", "B")) for b in BAND_OF_ID])
    wrong = lambda k: (F.col("ti") == 5) & (F.get(physical, k) == "B2")
    bands = F.transform(ids, lambda k: F.struct(k.alias("id"), F.get(physical, k).alias("band"), F.when(flagged, F.when(wrong(k), -1000).otherwise(1000)).cast("long").alias("offset")))
    catalog.write_metadata(scenes.select("scene", F.when(F.col("ti") == 3, 1000).otherwise(10000).alias("quantification"), bands.alias("bands")), path)
    rows = catalog.read_metadata(spark, path)
    return matching.metadata_violations(rows.withColumn("boa_offset", F.col("offset").isNotNull().cast("int")), 10000, 1000)


@query(using(sql.SCENES) + """select strftime(acq_date, '%Y-%m') as month, tile, scene from (select *, row_number() over (partition by tile, year(acq_date) order by cloud, scene) k from scenes)
  where k = 1 and strftime(acq_date, '%m') in ('01', '02', '03', '04', '05', '06') and ti < 12""")
def scene_catalog(spark, sf_dir):
    """The best product of each tile and year as files below month and tile; those of half the months and tiles are listed, and the tile list is a file."""
    path, scenes = scratch.folder(spark), adapters.scenes(spark, sf_dir)
    best = matching.scene_of_year(scenes).select("scene").join(scenes, "scene")
    catalog.write_products(best.select("scene", F.date_format("acq_date", "yyyy-MM").alias("month"), "tile"), f"{path}/products")
    adapters.tiles(spark, sf_dir).where("ti < 12").select(F.concat("tile", F.lit(".zip"))).write.text(f"{path}/tiles")
    tiles = [r["tile"] for r in chunks.read_tile_list(spark, f"{path}/tiles").collect()]
    return catalog.list_products(spark, f"{path}/products", ["*-01", "*-02", "*-03", "*-04", "*-05", "*-06"], tiles)


@query(SQL["footprint_scan"])
def footprint_scan_ordered(spark, sf_dir):
    """The same box from files in spatial order, of which only the row groups in the box are read."""
    path = scratch.folder(spark)
    catalog.write_footprints(adapters.footprints(spark, sf_dir).select("shot_number", "lon", "lat", "tile", "agbd"), path, 8, 1 << 16)
    wanted = adapters.tiles(spark, sf_dir).where("ti < 12").select("tile")
    rows = catalog.read_box(spark, path, -10.0, 40.0, -20.0, 20.0).join(wanted, "tile", "left_semi")
    return rows.select("shot_number", r6("lon").alias("lon"), r6("lat").alias("lat"), "tile", F.round("agbd", 8).alias("agbd"))


# --- coordinates ---------------------------------------------------------


@query(using(sql.FOOTPRINTS) + """select shot_number, cast(floor((60 - lat) / cast(0.25 as double)) as int) grid_row, cast(floor((lon + 180) / cast(0.25 as double)) as int) grid_col,
  round(-180 + (cast(floor((lon + 180) / cast(0.25 as double)) as int) + cast(0.5 as double)) * cast(0.25 as double), 6) x, round(60 - (cast(floor((60 - lat) / cast(0.25 as double)) as int) + cast(0.5 as double)) * cast(0.25 as double), 6) y from footprints""")
def affine_rowcol(spark, sf_dir):
    grid = tuple(map(F.lit, (-180.0, 60.0, 0.25, -0.25)))
    rows = adapters.footprints(spark, sf_dir).select("shot_number", geo.row_col(F.col("lon"), F.col("lat"), *grid).alias("p"))
    rows = rows.select("shot_number", F.col("p.row").alias("grid_row"), F.col("p.col").alias("grid_col"))
    xy = geo.pixel_centre(F.col("grid_row"), F.col("grid_col"), *grid)
    return rows.select("*", r6(xy["x"]).alias("x"), r6(xy["y"]).alias("y"))


@query(using(sql.FOOTPRINTS) + """select shot_number, round(lat - trunc(lat), 6) fraction, cast(abs(trunc(lat)) as int) whole,
  round(case when lat = trunc(lat) then 0 else lat end, 6) lat from footprints""")
def coord_split(spark, sf_dir):
    rows = adapters.footprints(spark, sf_dir).select("shot_number", geo.split_coordinate(F.col("lat")).alias("p")).select("shot_number", "p.*")
    return rows.select("shot_number", r6("fraction").alias("fraction"), "whole", r6(geo.join_coordinate(F.col("fraction"), F.col("whole"))).alias("lat"))


@query(using(sql.FOOTPRINTS) + """select shot_number, round((cos(pi() * lat / 90) + 1) / 2, 6) lat_cos, round((sin(pi() * lat / 90) + 1) / 2, 6) lat_sin,
  round((cos(pi() * lon / 180) + 1) / 2, 6) lon_cos, round((sin(pi() * lon / 180) + 1) / 2, 6) lon_sin from footprints""")
def coord_encode(spark, sf_dir):
    rows = adapters.footprints(spark, sf_dir).select("shot_number", geo.encode_lat_lon(F.col("lat"), F.col("lon")).alias("p")).select("shot_number", "p.*")
    return rows.select("shot_number", *[r6(c).alias(c) for c in ("lat_cos", "lat_sin", "lon_cos", "lon_sin")])


@query(using(sql.FOOTPRINTS) + """select shot_number, round((cos(2 * pi() * (dayofyear(gedi_date) - 1) / 365) + 1) / 2, 6) doy_cos, round((sin(2 * pi() * (dayofyear(gedi_date) - 1) / 365) + 1) / 2, 6) doy_sin from footprints""")
def doy_encode(spark, sf_dir):
    turn = geo.day_of_year(F.col("gedi_date"))
    return adapters.footprints(spark, sf_dir).select("shot_number", r6(turn["cos"]).alias("doy_cos"), r6(turn["sin"]).alias("doy_sin"))


@query(using(sql.FOOTPRINTS) + """select shot_number, cast(k as int) k, round(y, 6) lat, round(lon + (k % 3 - 1) * 10 / cast(6371000 as double) * (180 / pi()) / cos(radians(y)), 6) lon
  from (select shot_number, lon, k, lat - (k // 3 - 1) * 10 / cast(6371000 as double) * (180 / pi()) y from footprints, range(9) r(k))""")
def patch_coords(spark, sf_dir):
    rows = adapters.footprints(spark, sf_dir)
    grid = arrays.cells(3, 3, lambda i, j: geo.pixel_coordinate(F.col("lat"), F.col("lon"), i, j, 3))
    return rows.select("shot_number", F.posexplode(grid).alias("k", "p")).select("shot_number", "k", r6("p.lat").alias("lat"), r6("p.lon").alias("lon"))


@query(using(sql.GRID, "g as (select ti, tile, min_lon, max_lon, min_lat, max_lat, i, j from grid, range(16) a(i), range(16) b(j))") + """select tile, cast(i as int) as "row", cast(j as int) col,
  round((cos(pi() * (max_lat + (min_lat - max_lat) * i / 15) / 90) + 1) / 2, 6) lat_cos, round((sin(pi() * (min_lon + (max_lon - min_lon) * j / 15) / 180) + 1) / 2, 6) lon_sin from g""")
def tile_coords(spark, sf_dir):
    rows = adapters.grid_tiles(spark, sf_dir).withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(15)))).withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(15))))
    lat = geo.interpolated(F.col("max_lat"), F.col("min_lat"), F.col("row"), F.lit(16))
    lon = geo.interpolated(F.col("min_lon"), F.col("max_lon"), F.col("col"), F.lit(16))
    code = geo.encode_lat_lon(lat, lon)
    return rows.select("tile", "row", "col", r6(code["lat_cos"]).alias("lat_cos"), r6(code["lon_sin"]).alias("lon_sin"))


# --- pixel features ------------------------------------------------------


def _long_patches(spark, sf_dir):
    return adapters.patches(spark, sf_dir).select("vec_id", "boa", F.posexplode("dn").alias("k", "dn"))


@query(using(sql.PATCHES) + "select vec_id, k, round(case when dn = 0 then 0 else greatest((dn - 1000 * boa) / cast(10000 as double), 0) end, 6) reflectance from patches")
def reflectance(spark, sf_dir):
    return _long_patches(spark, sf_dir).select("vec_id", "k", r6(features.reflectance(F.col("dn"), F.col("boa"))).alias("reflectance"))


@query(using(sql.PATCHES) + "select vec_id, k, round(case when dn = 0 then -9999 else 10 * log10(cast(dn as double) * dn) - 83 end, 6) gamma0 from patches")
def gamma0(spark, sf_dir):
    return _long_patches(spark, sf_dir).select("vec_id", "k", r6(features.gamma0(F.col("dn"))).alias("gamma0"))


@query(using(sql.PATCHES) + """select k band, round(avg(dn), 4) mean, round(stddev_pop(dn), 4) std, round(quantile_cont(dn, 0.01), 4) p1, round(quantile_cont(dn, 0.99), 4) p99,
  cast(min(dn) as double) min, cast(max(dn) as double) max from patches where dn <> 0 group by k""")
def band_stats(spark, sf_dir):
    stats = statistics.band_stats(_long_patches(spark, sf_dir).withColumnRenamed("k", "band"), ["band"], "dn", F.lit(0))
    return stats.select("band", *[F.round(c, 4).alias(c) for c in ("mean", "std", "p1", "p99")], "min", "max")


def _normalized(strategy: str, text: str) -> None:
    def run(spark, sf_dir):
        stats = statistics.band_stats(_long_patches(spark, sf_dir), ["k"], "dn", F.lit(0)).select("k", *STATS)
        rows = _long_patches(spark, sf_dir).join(F.broadcast(stats), "k")
        value = features.normalize(F.col("dn"), {c: F.col(c) for c in STATS}, strategy, F.lit(0))
        return rows.select("vec_id", "k", r6(value).alias("value"))

    run.__name__ = f"normalize_{strategy}"
    stats = "s as (select k, avg(dn) mean, stddev_pop(dn) std, quantile_cont(dn, 0.01) p1, quantile_cont(dn, 0.99) p99, cast(min(dn) as double) mn, cast(max(dn) as double) mx from patches where dn <> 0 group by k)"
    query(using(sql.PATCHES, stats) + f"select vec_id, k, round({text}, 6) as value from patches join s using (k)")(run)


_normalized("mean_std", "case when dn = 0 then 0 else (dn - mean) / std end")
_normalized("pct", "greatest(0, least(1, case when dn = 0 then 0 else (dn - p1) / (p99 - p1) end))")
_normalized("min_max", "case when dn = 0 then 0 else (dn - mn) / (mx - mn) end")


@query(using(sql.LAND) + """select shot_number, round(case when lc = 255 then 0 else (cos(2 * pi() * lc / 100) + 1) / 2 end, 6) lc_cos, round(case when lc = 255 then 0 else (sin(2 * pi() * lc / 100) + 1) / 2 end, 6) lc_sin,
  round(case when prob = 255 then 0 else prob / cast(100 as double) end, 6) lc_prob from land""")
def lc_cyclic(spark, sf_dir):
    turn = features.land_cover_cyclic(F.col("lc"))
    rows = adapters.land_cover_points(spark, sf_dir)
    return rows.select("shot_number", r6(turn["lc_cos"]).alias("lc_cos"), r6(turn["lc_sin"]).alias("lc_sin"), r6(features.land_cover_probability(F.col("prob"))).alias("lc_prob"))


@query(using(sql.LAND) + f"""select shot_number, array_to_string(list_transform([{', '.join(map(str, BIOMES))}], lambda c: case when list_contains([{', '.join(map(str, BIOMES))}], lc) then cast(c = lc as int) else cast(c = {BIOMES[0]} as int) end), ',') onehot from land""")
def lc_onehot(spark, sf_dir):
    return adapters.land_cover_points(spark, sf_dir).select("shot_number", joined(arrays.one_hot(F.col("lc"), BIOMES)).alias("onehot"))


@query(using(sql.LAND) + """select shot_number, cast(d as int) dim, round(case when lc in (50, 60) then 0 else lc end * cast(0.001 as double) + d * cast(0.1 as double), 6) as value from land, range(5) r(d)""")
def lc_embed(spark, sf_dir):
    path, classes = scratch.folder(spark), adapters.land_cover_points(spark, sf_dir).where("lc not in (50, 60)").select("lc").union(spark.range(1).select(F.lit(0).alias("lc"))).distinct()
    classes.select(*[(F.col("lc") * 0.001 + d * 0.1).alias(f"dim{d}") for d in range(5)], F.col("lc").alias("mapping")).write.csv(path, header=True)
    table = chunks.read_embeddings(spark, path)
    return adapters.land_cover_points(spark, sf_dir).select("shot_number", F.posexplode(features.embedded(F.col("lc"), table)).alias("dim", "value")).withColumn("value", r6("value"))


@query(using(sql.LAND, "t as (select ti, count(*) n from land group by ti)") + f"""select t.ti, b.biome, round(cast(count(land.lc) as double) / max(t.n), 6) share
  from t cross join (select unnest([{', '.join(map(str, BIOMES))}]) biome) b left join land on land.ti = t.ti and land.lc = b.biome group by 1, 2""")
def biome_distribution(spark, sf_dir):
    return statistics.shares(adapters.land_cover_points(spark, sf_dir), "ti", "lc", BIOMES).withColumn("share", r6("share"))


@query(using(sql.FOOTPRINTS, "d as (select shot_number, cast(date_diff('day', date '2019-04-17', gedi_date) as int) gedi_days from footprints)") + "select shot_number, round((gedi_days - mn) / cast(mx - mn as double), 6) as value from d, (select min(gedi_days) mn, max(gedi_days) mx from d)")
def normalize_dates(spark, sf_dir):
    rows = adapters.footprints(spark, sf_dir).select("shot_number", names.mission_days(F.col("gedi_date")).alias("gedi_days"), F.lit(1).alias("one"))
    stats = rows.groupBy("one").agg(F.min("gedi_days").alias("min"), F.max("gedi_days").alias("max"))
    value = features.normalize(F.col("gedi_days"), {c: F.col(c) for c in ("min", "max")}, "pct", F.lit(None), date=True)
    return rows.join(F.broadcast(stats), "one").select("shot_number", r6(value).alias("value"))


@query(using(sql.FOOTPRINTS) + "select shot_number, cast(agbd as float) agbd, round(lon, 6) lon, gedi_date from footprints")
def record_project(spark, sf_dir):
    rows = features.record(adapters.footprints(spark, sf_dir).withColumn("scene", F.lit("s")), ["shot_number", "agbd", "lon", "gedi_date"])
    return rows.withColumns({"agbd": F.col("agbd").cast("float"), "lon": r6("lon")})


@query(using(sql.LAND) + "select shot_number, cast(k as int) k, lc as value from land, range(9) r(k)")
def scalar_plane(spark, sf_dir):
    return adapters.land_cover_points(spark, sf_dir).select("shot_number", F.posexplode(arrays.plane(F.col("lc"), 3)).alias("k", "value"))


# --- windows -------------------------------------------------------------

CHUNK = 16
WINDOW_SQL = f"""wins as (
  select f.tile, f.row r0, f.col c0, r.layer, r.band, string_agg(cast(r.value as varchar), ',' order by r.row, r.col) patch, count(*) filter (r.value = 4) veg, count(*) filter (r.value <> 255) known,
         max(r.value) filter (r.row = f.row and r.col = f.col) centre
  from (select distinct tile, "row", col from footprints where "row" between {PATCH // 2} and {63 - PATCH // 2} and col between {PATCH // 2} and {63 - PATCH // 2}) f
  join raster r on r.tile = f.tile and r.row between f.row - {PATCH // 2} and f.row + {PATCH // 2} and r.col between f.col - {PATCH // 2} and f.col + {PATCH // 2}
  group by all)"""


def _patches(spark, sf_dir, band: str):
    points = adapters.footprints(spark, sf_dir)
    return windows.extract_patches(points, chunks.to_chunks(adapters.raster(spark, sf_dir, bands=[band]), CHUNK), CHUNK, PATCH, 64, 64)


@query(using(sql.FOOTPRINTS, sql.RASTER, WINDOW_SQL) + "select shot_number, patch from footprints f join wins w on f.tile = w.tile and f.row = r0 and f.col = c0 and band = 'B02'")
def extract_patches(spark, sf_dir):
    rows = adapters.footprints(spark, sf_dir).join(_patches(spark, sf_dir, "B02"), ["tile", "row", "col"])
    return rows.select("shot_number", joined("patch").alias("patch"))


@query(using(sql.FOOTPRINTS, sql.RASTER, WINDOW_SQL) + f"""select shot_number, coalesce(patch, rtrim(repeat('0,', {PATCH * PATCH}), ',')) patch
  from (select * from footprints where "row" between {PATCH // 2} and {63 - PATCH // 2} and col between {PATCH // 2} and {63 - PATCH // 2}) f
  left join wins w on f.tile = w.tile and f.row = r0 and f.col = c0 and band = 'HH'""")
def extract_patches_missing_layer(spark, sf_dir):
    points = adapters.footprints(spark, sf_dir).where(arrays.fits(F.col("row"), F.col("col"), 64, 64, PATCH))
    return windows.with_layer(points, _patches(spark, sf_dir, "HH"), "ALOS", "HH", "hh", PATCH, 0).select("shot_number", joined("hh").alias("patch"))


@query(using(sql.FOOTPRINTS, sql.RASTER, WINDOW_SQL) + f"""select shot_number, cast(100 * veg // {PATCH * PATCH} as int) vegetation_score from footprints f join wins w on f.tile = w.tile and f.row = r0 and f.col = c0 and band = 'SCL'
  where centre = 4 and 100 * veg // {PATCH * PATCH} >= 20""")
def vegetation_filter(spark, sf_dir):
    rows = adapters.footprints(spark, sf_dir).join(_patches(spark, sf_dir, "SCL"), ["tile", "row", "col"])
    return windows.vegetated(rows, "patch", PATCH).select("shot_number", "vegetation_score")


@query(using(sql.FOOTPRINTS, sql.RASTER, WINDOW_SQL) + f"""select shot_number, cast(100 * known // {PATCH * PATCH} as int) ch_score from footprints f join wins w on f.tile = w.tile and f.row = r0 and f.col = c0 and band = 'ch'
  where centre <> 255 and 100 * known // {PATCH * PATCH} >= 20""")
def validity_filter(spark, sf_dir):
    rows = adapters.footprints(spark, sf_dir).join(_patches(spark, sf_dir, "ch"), ["tile", "row", "col"])
    return windows.valid_height(rows, "patch", PATCH).select("shot_number", "ch_score")


@query(using(sql.FOOTPRINTS, sql.SCENES, sql.RADAR, ASOF, """m as (select shot_number, tile, "row", col, substr(scene, 14, 2) yy from matched where scene is not null)""")
    + """select m.shot_number, m.yy, coalesce(hh, 0) hh, coalesce(hv, 0) hv from m left join radar r on m.tile = r.tile and m.yy = r.yy and m."row" = r."row" and m.col = r.col""")
def layer_year_match(spark, sf_dir):
    rows = _matched(spark, sf_dir).where("scene is not null")
    found = matching.with_year_layer(rows, adapters.radar(spark, sf_dir), names.scene_parts(F.col("scene"))["acq_ts"], ["hh", "hv"])
    return found.select("shot_number", "yy", "hh", "hv")


@query(using(sql.FOOTPRINTS, sql.CANOPY) + """select shot_number, strftime(gedi_date, '%y') yy, coalesce(ch, 255) ch, coalesce(std, 255) std from footprints f
  left join canopy c on c.tile = f.tile and c.yy = strftime(gedi_date, '%y') and c."row" = f."row" and c.col = f.col""")
def canopy_year_match(spark, sf_dir):
    found = matching.with_year_layer(adapters.footprints(spark, sf_dir), adapters.yearly_canopy(spark, sf_dir), F.col("gedi_date"), ["ch", "std"], 255)
    return found.select("shot_number", "yy", "ch", "std")


_STACK = {"b02": "B02", "b03": "B03", "b04": "B04", "b08": "B08", "scl": "SCL", "ch": "ch", "ch_std": "std", "hh": "HH", "hv": "HV", "lc": "lc", "lc_prob": "prob", "dem": "dem"}


@query(using(sql.MOSAIC_RASTER) + "select tile, \"row\", col, " + ", ".join(f"coalesce(max(value) filter (band = '{band}'), 0) {name}" for name, band in _STACK.items()) + " from raster group by 1, 2, 3")
def layer_stack(spark, sf_dir):
    picked = [F.coalesce(F.max(F.when(F.col("band") == band, F.col("value"))), F.lit(0)).alias(name) for name, band in _STACK.items()]
    return adapters.raster(spark, sf_dir, adapters.mosaic_pixels(spark, sf_dir)).groupBy("tile", "row", "col").agg(*picked)


# --- resampling ----------------------------------------------------------

#: A coarse band of eight by eight from each patch, with holes where the number is divisible by 7.
COARSE = "c as (select vec_id, k // 8 y, k % 8 x, case when dn % 7 = 0 then 0 else dn end v from patches)"
FILLED = """f as (select vec_id, y, x, v as hole, case when v <> 0 then v else coalesce(near, 0) end v from (
  select a.vec_id, a.y, a.x, a.v, arg_min(b.v, ((a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x), b.y, b.x)) filter (b.v <> 0) near
  from c a join c b on a.vec_id = b.vec_id and abs(a.y - b.y) <= 1 and abs(a.x - b.x) <= 1 group by 1, 2, 3, 4))"""


def _coarse(spark, sf_dir):
    rows = adapters.patches(spark, sf_dir).select("vec_id", F.transform("dn", lambda x: F.when(x % 7 == 0, 0).otherwise(x)).alias("v"))
    return rows.withColumn("full", arrays.filled(F.col("v"), 8, 8, F.lit(0)))


@query(using(sql.PATCHES, COARSE, FILLED) + "select vec_id, cast(y * 8 + x as int) k, v as value from f")
def nodata_fill(spark, sf_dir):
    return _coarse(spark, sf_dir).select("vec_id", F.posexplode("full").alias("k", "value"))


def _resample(to: int, order: int):
    def rows(spark, sf_dir):
        value = arrays.resampled(F.col("full"), F.col("v"), 8, 8, to, to, F.lit(0), order)
        return _coarse(spark, sf_dir).select("vec_id", F.posexplode(value).alias("k", "value"))

    return rows


_NEAR = "cast(least(greatest(floor(({0} + cast(0.5 as double)) * cast({1} as double) - 0.5 + 0.5), 0), 7) as bigint)"


@query(using(sql.PATCHES, COARSE, FILLED) + f"""select f.vec_id, cast(o.k as int) k, case when f.hole = 0 then 0 else f.v end as value from range(400) o(k) join f on f.y = {_NEAR.format('o.k // 20', 8 / 20)} and f.x = {_NEAR.format('o.k % 20', 8 / 20)}""")
def resample_nearest(spark, sf_dir):
    return _resample(20, 0)(spark, sf_dir)


def _bilinear_sql(to: int) -> str:
    ratio = f"cast({8 / to!r} as double)"
    return f"""o as (select k, (k // {to} + cast(0.5 as double)) * {ratio} - 0.5 sy, (k % {to} + cast(0.5 as double)) * {ratio} - 0.5 sx from range({to * to}) r(k)),
p as (select k, floor(sy) y0, floor(sx) x0, sy - floor(sy) fy, sx - floor(sx) fx, cast(least(greatest(floor(sy + 0.5), 0), 7) as bigint) ny, cast(least(greatest(floor(sx + 0.5), 0), 7) as bigint) nx from o),
g as (select vec_id, list(v order by y, x) v, list(hole order by y, x) hole from f group by vec_id),
b as (select g.vec_id, p.k, g.hole[ny * 8 + nx + 1] hole,
  (1 - fy) * ((1 - fx) * g.v[cast(least(greatest(y0, 0), 7) * 8 + least(greatest(x0, 0), 7) + 1 as bigint)] + fx * g.v[cast(least(greatest(y0, 0), 7) * 8 + least(greatest(x0 + 1, 0), 7) + 1 as bigint)])
  + fy * ((1 - fx) * g.v[cast(least(greatest(y0 + 1, 0), 7) * 8 + least(greatest(x0, 0), 7) + 1 as bigint)] + fx * g.v[cast(least(greatest(y0 + 1, 0), 7) * 8 + least(greatest(x0 + 1, 0), 7) + 1 as bigint)]) v
  from g, p)"""


@query(using(sql.PATCHES, COARSE, FILLED, _bilinear_sql(20)) + "select vec_id, cast(k as int) k, round(case when hole = 0 then 0 else v end, 4) as value from b")
def resample_bilinear(spark, sf_dir):
    return _resample(20, 1)(spark, sf_dir).withColumn("value", F.round("value", 4))


@query(using(sql.PATCHES, "h as (select vec_id, list(case when dn % 4 = 0 then dn else 0 end order by k) v from patches group by vec_id)",
    "n as (select vec_id, v, list_filter(range(64), lambda k: v[k + 1] <> 0) known from h)")
    + """select vec_id, cast(k as int) k, case when v[k + 1] <> 0 or len(known) = 0 then v[k + 1] else v[list_min(list_transform(known, lambda j: ((j // 8 - k // 8) * (j // 8 - k // 8) + (j % 8 - k % 8) * (j % 8 - k % 8)) * 64 + j)) % 64 + 1] end as value
  from n, range(64) r(k)""")
def nearest_fill(spark, sf_dir):
    rows = adapters.patches(spark, sf_dir).select("vec_id", F.transform("dn", lambda x: F.when(x % 4 == 0, x).otherwise(0)).alias("v"))
    return raster.nearest_fill(rows, "v", 8, 0).select("vec_id", F.posexplode("v").alias("k", "value"))


#: Wide holes of a mosaic: most pixels of most tiles are unknown.
_WIDE = "cast(case when (dn + ti) % 41 = 0 then dn + 1 else 0 end as int)"


@query(using(sql.MOSAIC_PIXELS, f"t as (select tile, list({_WIDE} order by \"row\", col) v, list(\"row\" * 32 + col order by \"row\", col) place from pixels group by tile)",
    "n as (select tile, v, place, list_filter(range(len(v)), lambda i: v[i + 1] <> 0) known from t)")
    + """select tile, cast(place[i + 1] // 32 as int) "row", cast(place[i + 1] % 32 as int) col, case when v[i + 1] <> 0 or len(known) = 0 then v[i + 1] else v[1 + cast(list_min(list_transform(known, lambda j:
  ((place[j + 1] // 32 - place[i + 1] // 32) * (place[j + 1] // 32 - place[i + 1] // 32) + (place[j + 1] % 32 - place[i + 1] % 32) * (place[j + 1] % 32 - place[i + 1] % 32)) * 1024 + j)) % 1024 as int)] end as value
  from (select *, unnest(range(len(v))) i from n)""")
def wide_fill(spark, sf_dir):
    """Holes of whole tiles, filled from anywhere in the tile; pixels that the tile has not are left out."""
    pixels = adapters.mosaic_pixels(spark, sf_dir)
    value = F.when((F.col("dn") + F.col("ti")) % 41 == 0, F.col("dn") + 1).otherwise(0).cast("int")
    holes = pixels.select(F.lit("S2").alias("layer"), F.lit("B02").alias("band"), "tile", "row", "col", value.alias("value"))
    whole = chunks.to_chunks(holes, EDGE).withColumn("there", F.col("data")).withColumn("data", F.transform("data", lambda x: F.coalesce(x, F.lit(0))))
    full = raster.nearest_fill(whole, "data", EDGE, 0).select("tile", F.posexplode(F.arrays_zip("data", "there")).alias("k", "p")).where("p.there is not null")
    return full.select("tile", F.floor(F.col("k") / EDGE).cast("int").alias("row"), (F.col("k") % EDGE).cast("int").alias("col"), F.col("p.data").alias("value"))


#: Patches of 20 m pixels at various places, on a scene of twelve by twelve pixels of 10 m.
_ALIGNED = """g as (select distinct vec_id, (vec_id % 5 - 2) * 10 oy, (vec_id % 3 - 1) * 10 ox from patches),
c as (select *, cast(floor((oy + 5) / cast(20 as double)) as int) t, cast(floor((oy + 115) / cast(20 as double)) as int) b, cast(floor((5 - ox) / cast(20 as double)) as int) l, cast(floor((115 - ox) / cast(20 as double)) as int) r from g),
o as (select vec_id, k, t + least(greatest(cast(floor((k // 12 + cast(0.5 as double)) * ((b - t + 1) / cast(12 as double))) as int), 0), b - t) y, l + least(greatest(cast(floor((k % 12 + cast(0.5 as double)) * ((r - l + 1) / cast(12 as double))) as int), 0), r - l) x from c, range(144) q(k))"""


@query(using(sql.PATCHES, _ALIGNED) + "select o.vec_id, cast(o.k as int) k, coalesce(p.dn, 0) as value from o left join patches p on p.vec_id = o.vec_id and y between 0 and 7 and x between 0 and 7 and p.k = y * 8 + x")
def raster_align(spark, sf_dir):
    top, left = ((F.col("vec_id") % 5 - 2) * 10.0), ((F.col("vec_id") % 3 - 1) * 10.0)
    value = arrays.aligned(F.col("dn"), 8, 8, (left, top, 20.0), (0.0, 0.0, 10.0, 12, 12), F.lit(0))
    return adapters.patches(spark, sf_dir).select("vec_id", F.posexplode(value).alias("k", "value"))


#: Mosaics of 32 pixels of 20 m at various places, brought to scenes of 48 by 48 pixels of 10 m.
SCENE, TO_CHUNK = 48, 20
_STRETCHED = f"""t as (select tile, any_value(ti) ti from pixels group by tile),
g as (select *, (ti % 5 - 2) * 10 oy, (ti % 3 - 1) * 10 ox from t),
c as (select tile, cast(floor((oy + 5) / cast(20 as double)) as int) t, cast(floor((oy + 475) / cast(20 as double)) as int) b, cast(floor((5 - ox) / cast(20 as double)) as int) l, cast(floor((475 - ox) / cast(20 as double)) as int) r from g),
cut as (select c.tile, y, x, coalesce(case when dn % 7 = 0 then 0 else dn end, 0) v from c, range(60) a(y), range(60) z(x) left join pixels p on p.tile = c.tile and p."row" = y + t and p.col = x + l where y <= b - t and x <= r - l),
near as (select a.tile, a.y, a.x, arg_min(n.v, (a.y - n.y) * (a.y - n.y) * 100 + (a.x - n.x) * (a.x - n.x) * 100 + (n.y - a.y + 1) * 3 + n.x - a.x + 1) v from cut a join cut n on a.tile = n.tile and a.v = 0 and n.v <> 0 and abs(a.y - n.y) <= 1 and abs(a.x - n.x) <= 1 group by 1, 2, 3),
f as (select tile, y, x, cut.v as hole, case when cut.v <> 0 then cut.v else coalesce(near.v, 0) end v from cut left join near using (tile, y, x)),
p as (select tile, i, j, (i + cast(0.5 as double)) * ((b - t + 1) / cast({SCENE} as double)) - 0.5 sy, (j + cast(0.5 as double)) * ((r - l + 1) / cast({SCENE} as double)) - 0.5 sx, b - t ly, r - l lx from c, range({SCENE}) a(i), range({SCENE}) z(j)),
q as (select *, sy - floor(sy) fy, sx - floor(sx) fx, cast(least(greatest(floor(sy), 0), ly) as int) y0, cast(least(greatest(floor(sy + 1), 0), ly) as int) y1, cast(least(greatest(floor(sx), 0), lx) as int) x0, cast(least(greatest(floor(sx + 1), 0), lx) as int) x1,
  cast(least(greatest(floor(sy + 0.5), 0), ly) as int) yk, cast(least(greatest(floor(sx + 0.5), 0), lx) as int) xk from p)"""


def _stretched(spark, sf_dir, order: int) -> DataFrame:
    pixels = adapters.mosaic_pixels(spark, sf_dir)
    value = F.when(F.col("dn") % 7 == 0, 0).otherwise(F.col("dn"))
    own = chunks.to_chunks(pixels.select(F.lit("ALOS").alias("layer"), F.lit("HH").alias("band"), "tile", "row", "col", value.alias("value")), 12)
    tiles = pixels.select("tile", "ti").distinct()
    source = raster.Grid((F.col("ti") % 3 - 1) * 10.0, (F.col("ti") % 5 - 2) * 10.0, 20.0)
    made = raster.align(own, 12, tiles, source, raster.Grid(0.0, 0.0, 10.0), SCENE, SCENE, TO_CHUNK, 0, order)
    return chunks.to_pixels(made, TO_CHUNK).select("tile", "row", "col", "value")


@query(using(sql.MOSAIC_PIXELS, _STRETCHED) + """select q.tile, cast(i as int) "row", cast(j as int) col, round(case when k.hole = 0 then 0 else (1 - fy) * ((1 - fx) * a.v + fx * b.v) + fy * ((1 - fx) * c.v + fx * d.v) end, 4) as value
  from q join f a on a.tile = q.tile and a.y = y0 and a.x = x0 join f b on b.tile = q.tile and b.y = y0 and b.x = x1 join f c on c.tile = q.tile and c.y = y1 and c.x = x0 join f d on d.tile = q.tile and d.y = y1 and d.x = x1
  join f k on k.tile = q.tile and k.y = yk and k.x = xk""")
def align_chunks_bilinear(spark, sf_dir):
    """Rasters in chunks brought to other chunks of another grid; holes stay, and are filled before their neighbours are weighted."""
    return _stretched(spark, sf_dir, 1).withColumn("value", F.round("value", 4))


@query(using(sql.MOSAIC_PIXELS, _STRETCHED) + 'select q.tile, cast(i as int) "row", cast(j as int) col, k.hole as value from q join f k on k.tile = q.tile and k.y = yk and k.x = xk')
def align_chunks_nearest(spark, sf_dir):
    return _stretched(spark, sf_dir, 0)


#: Pixels a side of a tile of 600 m by resolution, and a band of each.
GRIDS = {10: (60, "B02"), 20: (30, "B05"), 60: (10, "B09")}


@query(using(sql.MOSAIC_PIXELS, "s as (select *, unnest([20, 60]) step from (select distinct tile from pixels))",
    "g as (select tile, step, case step when 20 then 'B05' else 'B09' end band, cast(i as int) i, cast(j as int) j from s, range(60) a(i), range(60) b(j))")
    + """select g.tile, band, i as "row", j as col, coalesce(dn + step, 0) as value from g left join pixels p on p.tile = g.tile and p."row" = i // (step // 10) and p.col = j // (step // 10)""")
def optical_grids(spark, sf_dir):
    """Bands of 20 m and 60 m on the scene's grid of 10 m, chunk by chunk."""
    pixels, out = adapters.mosaic_pixels(spark, sf_dir), None
    tiles = pixels.select("tile").distinct()
    for step in (20, 60):
        n, band = GRIDS[step]
        own = pixels.where((F.col("row") < n) & (F.col("col") < n)).select(F.lit("S2").alias("layer"), F.lit(band).alias("band"), "tile", "row", "col", (F.col("dn") + step).alias("value"))
        made = chunks.to_pixels(raster.align(chunks.to_chunks(own, 12), 12, tiles, raster.Grid(0.0, 0.0, float(step)), raster.Grid(0.0, 0.0, 10.0), 60, 60, 25, 0), 25)
        out = made if out is None else out.unionByName(made)
    return out.select("tile", "band", "row", "col", "value")


@query(using(sql.PATCHES) + """select v.vec_id, cast(o.k as int) k, coalesce(p.dn, -1) as value from (select distinct vec_id from patches) v cross join range(100) o(k)
  left join patches p on p.vec_id = v.vec_id and o.k // 10 - 2 between 0 and 7 and o.k % 10 + 3 between 0 and 7 and p.k = (o.k // 10 - 2) * 8 + o.k % 10 + 3""")
def crop_pad(spark, sf_dir):
    value = arrays.crop_pad(F.col("dn"), 8, 8, F.lit(-2), F.lit(7), F.lit(3), F.lit(12), F.lit(-1))
    return adapters.patches(spark, sf_dir).select("vec_id", F.posexplode(value).alias("k", "value"))


@query(using(sql.PATCHES, "l as (select vec_id, list(dem order by k) d from patches group by vec_id)",
    """g as (select vec_id, cast(k as int) k, (d[least(k // 8 + 1, 7) * 8 + k % 8 + 1] - d[greatest(k // 8 - 1, 0) * 8 + k % 8 + 1]) / ((least(k // 8 + 1, 7) - greatest(k // 8 - 1, 0)) * cast(10 as double)) px,
  (d[k // 8 * 8 + least(k % 8 + 1, 7) + 1] - d[k // 8 * 8 + greatest(k % 8 - 1, 0) + 1]) / ((least(k % 8 + 1, 7) - greatest(k % 8 - 1, 0)) * cast(10 as double)) py from l, range(64) r(k))""",
    "h as (select *, pi() / 2 - atan2(py, px) turn from g)") + "select vec_id, k, round(sqrt(px * px + py * py), 6) slope, round((cos(turn) + 1) / 2, 6) aspect_cos, round((sin(turn) + 1) / 2, 6) aspect_sin from h")
def slope_aspect(spark, sf_dir):
    rows = adapters.patches(spark, sf_dir).select("vec_id", F.posexplode(arrays.slope_aspect(F.col("dem"), 8)).alias("k", "p"))
    return rows.select("vec_id", "k", *[r6(f"p.{c}").alias(c) for c in ("slope", "aspect_cos", "aspect_sin")])


@query(using(sql.PATCHES) + """select vec_id, string_agg(cast(dn as varchar), ',' order by k % 8, k // 8) transposed, string_agg(cast(dn as varchar), ',' order by k) filter (k // 8 between 1 and 5 and k % 8 between 1 and 5) crop,
  max(dn) filter (k = 27) centre from patches group by vec_id""")
def crop_transpose(spark, sf_dir):
    rows = adapters.patches(spark, sf_dir)
    crop = arrays.window(F.col("dn"), F.lit(3), F.lit(3), 8, 5)
    return rows.select("vec_id", joined(arrays.transposed(F.col("dn"), 8, 8)).alias("transposed"), joined(crop).alias("crop"), arrays.centre(crop, 5).alias("centre"))


@query(using(sql.PATCHES) + "select vec_id, cast(k // 32 * 2 + k % 8 // 4 as int) block, bool_or(dn > 1500) masked from patches group by 1, 2")
def mask_rescale(spark, sf_dir):
    mask = arrays.any_in_blocks(F.transform("dn", lambda x: x > 1500), 8, 4)
    return adapters.patches(spark, sf_dir).select("vec_id", F.posexplode(mask).alias("block", "masked"))


# --- splits, samples, features -------------------------------------------


@query(using(sql.FOOTPRINTS, sql.SPLITS) + "select shot_number, tile from footprints where tile in (select tile from splits where mode = 'val')")
def split_patches(spark, sf_dir):
    return statistics.of_split(adapters.footprints(spark, sf_dir), adapters.splits(spark, sf_dir), "val").select("shot_number", "tile")


@query(using(sql.FOOTPRINTS) + "select tile, cast(count(*) // 7 as bigint) n from footprints group by tile")
def tile_counts(spark, sf_dir):
    return statistics.tile_counts(adapters.footprints(spark, sf_dir), 7)


@query(using(sql.FOOTPRINTS, "n as (select tile, count(*) n from footprints group by tile)", "a as (select *, coalesce(sum(n) over (order by tile rows between unbounded preceding and 1 preceding), 0) lo from n)")
    + "select f.shot_number as ordinal, a.tile, cast(f.shot_number - lo as bigint) as \"row\" from footprints f join a on f.shot_number >= lo and f.shot_number < lo + n")
def ordinal_address(spark, sf_dir):
    rows = adapters.footprints(spark, sf_dir)
    return statistics.locate(rows.select(F.col("shot_number").alias("ordinal")), statistics.tile_counts(rows))


@query(using(sql.GRID) + "select tile, cast(ntile(7) over (order by tile) as int) shard from grid")
def shard_tiles(spark, sf_dir):
    return statistics.shards(adapters.grid_tiles(spark, sf_dir), 7)


@query(using(sql.LAND, "n as (select tile, lc biome, count(*) n from land group by 1, 2)", "q as (select tile, floor(sum(n) * cast(0.2 as double) + 0.5) quota from n group by tile)",
    "e as (select n.*, quota, floor(n * cast(0.2 as double)) base, n * cast(0.2 as double) - floor(n * cast(0.2 as double)) rest from n join q using (tile))",
    "t as (select tile, biome, base + case when row_number() over (partition by tile order by rest desc, biome) <= quota - sum(base) over (partition by tile) then 1 else 0 end take from e)",
    "r as (select shot_number, tile, lc biome, row_number() over (partition by tile, lc order by shot_number * 7919 % 10007, shot_number) k from land)")
    + "select shot_number, r.tile, r.biome from r join t using (tile, biome) where k <= take")
def representative_subset(spark, sf_dir):
    rows = adapters.land_cover_points(spark, sf_dir).select("shot_number", adapters.tile_of(F.col("ti")).alias("tile"), F.col("lc").alias("biome"))
    return statistics.representative_subset(rows, 0.2, order=F.col("shot_number") * 7919 % 10007, span=10007)


@query(using(sql.LAND, "n as (select tile, lc biome, count(*) n from land group by 1, 2)", "q as (select tile, floor(sum(n) * cast(0.2 as double) + 0.5) quota from n group by tile)",
    "e as (select n.*, quota, floor(n * cast(0.2 as double)) base, n * cast(0.2 as double) - floor(n * cast(0.2 as double)) rest from n join q using (tile))",
    "t as (select tile, biome, n, base + case when row_number() over (partition by tile order by rest desc, biome) <= quota - sum(base) over (partition by tile) then 1 else 0 end take from e)",
    "c as (select tile, abs(sum(n) over w / sum(n) over (partition by tile) - sum(take) over w / sum(take) over (partition by tile)) gap from t window w as (partition by tile order by biome rows between unbounded preceding and current row))")
    + "select tile, round(sum(gap), 6) distance from c group by tile")
def subset_distance(spark, sf_dir):
    """How far the subset's distribution of classes is from that of all rows, by tile."""
    rows = adapters.land_cover_points(spark, sf_dir).select("shot_number", adapters.tile_of(F.col("ti")).alias("tile"), F.col("lc").alias("biome"))
    return statistics.subset_distance(rows, representative_subset(spark, sf_dir)).withColumn("distance", r6("distance"))


@query(using(sql.FOOTPRINTS, sql.SPLITS) + """select mode, count(*) n, round(avg(agbd), 6) mean, round(stddev_pop(agbd), 6) std, round(min(agbd), 6) min, round(max(agbd), 6) max, round(quantile_disc(agbd, 0.01), 6) p1, round(quantile_disc(agbd, 0.99), 6) p99
  from footprints join splits using (tile) where year(gedi_date) in (2020, 2021, 2022) group by mode""")
def merged_stats(spark, sf_dir):
    """Statistics of three years of each split, merged from a table of sketches by year and tile that is written once."""
    path = scratch.folder(spark)
    rows = adapters.footprints(spark, sf_dir).withColumn("year", F.year("gedi_date"))
    statistics.sketches(rows, ["year", "tile"], "agbd", 32768).write.partitionBy("year").parquet(path)
    parts = spark.read.parquet(path).where(F.col("year").isin(2020, 2021, 2022)).join(adapters.splits(spark, sf_dir).drop("ti"), "tile")
    return _rounded(statistics.merged_stats(parts, ["mode"], {"p1": 0.01, "p99": 0.99}, 32768), "mean", "std", "min", "max", "p1", "p99")


@query(using(sql.FOOTPRINTS) + "select shot_number, agbd2 from (select shot_number, round(agbd, 8) agbd2, row_number() over (order by shot_number * 7919 % 1000003, shot_number) k from footprints) where k <= 500")
def ordered_sample(spark, sf_dir):
    rows = adapters.footprints(spark, sf_dir).select("shot_number")
    labels = adapters.footprints(spark, sf_dir).select("shot_number", F.round("agbd", 8).alias("agbd2"))
    return rows.orderBy(F.col("shot_number") * 7919 % 1000003, "shot_number").limit(500).join(labels, "shot_number")


def _features(spark, sf_dir):
    """A feature table from patches: the first pixels as bands, with land cover and coordinates by key."""
    bands = [r6(features.reflectance(F.get("dn", F.lit(k)), F.col("boa"))).alias(name) for k, name in enumerate(PRESETS["all"]["bands"])]
    rows = adapters.patches(spark, sf_dir).select(F.col("vec_id").alias("shot_number"), *bands, r6(F.get("dem", F.lit(27))).alias("dem"))
    points = adapters.footprints(spark, sf_dir)
    code = geo.encode_lat_lon(F.col("lat"), F.col("lon"))
    coords = points.select("shot_number", "tile", *[r6(code[c]).alias(c) for c in ("lat_cos", "lat_sin", "lon_cos", "lon_sin")], F.round("agbd", 8).alias("agbd"), "gedi_date")
    orders = adapters.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("shot_number"), r6(features.gamma0(F.col("o_orderkey") % 5000)).alias("alos_hh"), r6(features.gamma0(F.col("o_custkey") % 3000)).alias("alos_hv"), (F.col("o_custkey") % 60).cast("double").alias("ch"), (F.col("o_custkey") % 7).cast("double").alias("ch_std"))
    turn = features.land_cover_cyclic(F.col("lc"))
    land = adapters.land_cover_points(spark, sf_dir).select("shot_number", r6(turn["lc_cos"]).alias("lc_cos"), r6(turn["lc_sin"]).alias("lc_sin"), r6(features.land_cover_probability(F.col("prob"))).alias("lc_prob"))
    return rows.join(coords, "shot_number").join(land, "shot_number").join(orders, "shot_number")


def _features_sql() -> str:
    bands = ", ".join(f"round(max(case when dn = 0 then 0 else greatest((dn - 1000 * boa) / cast(10000 as double), 0) end) filter (k = {k}), 6) \"{b}\"" for k, b in enumerate(PRESETS["all"]["bands"]))
    return f"""w as (select vec_id shot_number, {bands}, round(max(dem) filter (k = 27), 6) dem from patches group by vec_id),
ft as (select w.*, f.tile, round((cos(pi() * lat / 90) + 1) / 2, 6) lat_cos, round((sin(pi() * lat / 90) + 1) / 2, 6) lat_sin, round((cos(pi() * lon / 180) + 1) / 2, 6) lon_cos, round((sin(pi() * lon / 180) + 1) / 2, 6) lon_sin,
  round(agbd, 8) agbd, gedi_date, a.alos_hh, a.alos_hv, a.ch, a.ch_std, round((cos(2 * pi() * lc / 100) + 1) / 2, 6) lc_cos, round((sin(2 * pi() * lc / 100) + 1) / 2, 6) lc_sin, round(case when prob = 255 then 0 else prob / cast(100 as double) end, 6) lc_prob
  from w join footprints f using (shot_number) join land using (shot_number)
  join (select o_orderkey shot_number, round(case when o_orderkey % 5000 = 0 then -9999 else 10 * log10(cast(o_orderkey % 5000 as double) * (o_orderkey % 5000)) - 83 end, 6) alos_hh,
    round(case when o_custkey % 3000 = 0 then -9999 else 10 * log10(cast(o_custkey % 3000 as double) * (o_custkey % 3000)) - 83 end, 6) alos_hv, cast(o_custkey % 60 as double) ch, cast(o_custkey % 7 as double) ch_std from orders) a using (shot_number))"""


@query(using(sql.PATCHES, sql.FOOTPRINTS, sql.LAND, _features_sql()) + "select shot_number, agbd, " + ", ".join(f'"{c}"' for c in features.preset("all")) + " from ft")
def feature_table(spark, sf_dir):
    return _features(spark, sf_dir).select("shot_number", "agbd", *features.preset("all"))


@query(using(sql.PATCHES, sql.FOOTPRINTS, sql.LAND, _features_sql()) + " union all ".join(
    f"select shot_number, '{p}' preset, {len(features.preset(p))} n_features, round(" + " + ".join(f'"{c}"' for c in features.preset(p)) + ", 6) total from ft" for p in PRESETS))
def feature_presets(spark, sf_dir):
    """Each feature list's size and sum, all lists in one pass."""
    lists = {name: features.preset(name) for name in PRESETS}
    parts = [F.struct(F.lit(name).alias("preset"), F.lit(len(c)).alias("n_features"), F.round(sum(map(F.col, c)), 6).alias("total")) for name, c in lists.items()]
    return _features(spark, sf_dir).select("shot_number", F.inline(F.array(*parts)))


@query(using(sql.PATCHES, sql.FOOTPRINTS, sql.LAND, sql.SPLITS, _features_sql()) + "select shot_number, mode, cast(year(gedi_date) as int) as year, agbd, " + ", ".join(f'"{c}"' for c in features.preset("S2LC")) + " from ft join splits using (tile)")
def feature_files(spark, sf_dir):
    """The feature table to files by split and year, and one preset's columns back."""
    path, label = scratch.folder(spark), ["shot_number", "agbd"]
    rows = _features(spark, sf_dir).join(adapters.splits(spark, sf_dir).drop("ti"), "tile").withColumn("year", F.year("gedi_date"))
    rows = rows.select(*label, *features.preset("all"), "mode", "year")
    chunks.write_features(rows, path, ["mode", "year"])
    return chunks.read_features(spark, path, rows.schema, [*label, *features.preset("S2LC"), "mode", "year"])


# --- metrics -------------------------------------------------------------

_ERRORS = "count(*) n, round(sqrt(avg((prediction - target) * (prediction - target))), 6) rmse, round(avg(abs(prediction - target)), 6) mae, round(avg(prediction - target), 6) me, round(avg((prediction - target) * (prediction - target)), 6) mse"


def _rounded(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.withColumns({c: r6(c) for c in columns})


@query(using(sql.PREDICTIONS, f"o as (select model, cast(null as int) bin_lo, true overall, {_ERRORS} from predictions group by model)",
    f"b as (select model, cast(floor(target / 50) * 50 as int) bin_lo, {_ERRORS} from predictions where target >= 0 and target < 500 group by 1, 2)")
    + "select model, bin_lo, overall, n, rmse, mae, me, mse from o union all select g.model, cast(g.bin_lo as int), false, coalesce(n, 0), rmse, mae, me, mse from (select model, unnest(range(0, 500, 50)) bin_lo from o) g left join b on b.model = g.model and b.bin_lo = g.bin_lo")
def metrics_overall_binned(spark, sf_dir):
    return _rounded(statistics.binned_errors(adapters.predictions(spark, sf_dir), ["model"]), "rmse", "mae", "me", "mse")


@query(using(sql.PREDICTIONS) + "select count(*) n_seeds, round(avg(rmse), 6) mean, round(stddev_pop(rmse), 6) std from (select model, sqrt(avg((prediction - target) * (prediction - target))) rmse from predictions group by model)")
def seed_summary(spark, sf_dir):
    errors = adapters.predictions(spark, sf_dir).groupBy("model").agg(*statistics.error_aggregates(F.col("prediction"), F.col("target")))
    return _rounded(statistics.seed_summary(errors, [], "rmse"), "mean", "std")


@query(using(sql.PREDICTIONS) + """select model, round(avg((prediction - target) * (prediction - target)), 6) loss, round(sqrt(avg((prediction - target) * (prediction - target))), 6) RMSE, round(avg(abs(prediction - target)), 6) MAE, round(avg(prediction - target), 6) ME from predictions group by model""")
def validation_losses(spark, sf_dir):
    return _rounded(losses.validation_losses(adapters.predictions(spark, sf_dir), ["model"]), "loss", "RMSE", "MAE", "ME")


@query(using(sql.PREDICTIONS, "e as (select model, cast(shot_number % 10 as int) epoch, round(sqrt(avg((prediction - target) * (prediction - target)) filter (ti % 2 = 0)), 6) val_rmse, round(sqrt(avg((prediction - target) * (prediction - target)) filter (ti % 2 = 1)), 6) test_rmse from predictions group by 1, 2)")
    + "select model, min(val_rmse) val_rmse, arg_min(epoch, (val_rmse, epoch)) epoch, arg_min(test_rmse, (val_rmse, epoch)) test_rmse from e group by model")
def best_model(spark, sf_dir):
    rows = adapters.predictions(spark, sf_dir).withColumns({"epoch": (F.col("shot_number") % 10).cast("int"), "square": (F.col("prediction") - F.col("target")) ** 2})
    part = lambda k: r6(F.sqrt(F.avg(F.when(F.col("ti") % 2 == k, F.col("square")))))
    return statistics.best_model(rows.groupBy("model", "epoch").agg(part(0).alias("val_rmse"), part(1).alias("test_rmse")), ["model"])


# --- windows over tiles --------------------------------------------------

EDGE, SIZE, OVERLAP = 32, 12, 4
_STARTS = ", ".join(map(str, mosaic.axis_starts(EDGE, SIZE, OVERLAP)))
WINDOWS_SQL = f"""starts as (select k - 1 k, s from (select unnest(range(1, {len(mosaic.axis_starts(EDGE, SIZE, OVERLAP)) + 1})) k, unnest([{_STARTS}]) s)),
win as (select tile, ti, a.k wr, a.s top, b.k wc, b.s "left" from (select distinct tile, ti from pixels), starts a, starts b)"""
PREDICTED_SQL = f"""pred as (select p.tile, p.ti, m.model, w.wr, w.wc, p."row", p.col, p.dn / cast(10 as double) + w.wr * 3 + w.wc + m.model as value
  from pixels p join win w on p.tile = w.tile and p."row" between w.top and w.top + {SIZE - 1} and p.col between w."left" and w."left" + {SIZE - 1}, range(1, 4) m(model)
  where (w.wr = 0 or p."row" >= w.top + {OVERLAP // 2}) and (w.wc = 0 or p.col >= w."left" + {OVERLAP // 2})),
mos as (select tile, ti, model, "row", col, value from (select *, row_number() over (partition by tile, model, "row", col order by wr desc, wc desc) k from pred) where k = 1)"""


def _windows(spark, sf_dir):
    return mosaic.windows_of(adapters.mosaic_pixels(spark, sf_dir), EDGE, EDGE, SIZE, OVERLAP)


def _predicted(spark, sf_dir):
    rows = _windows(spark, sf_dir).withColumn("model", F.explode(F.sequence(F.lit(1), F.lit(3))))
    return rows.select("tile", "model", "wr", "wc", "row", "col", (F.col("dn") / 10.0 + F.col("wr") * 3 + F.col("wc") + F.col("model")).alias("value"))


def _mosaic(spark, sf_dir):
    return mosaic.mosaic(_predicted(spark, sf_dir), EDGE, EDGE, SIZE, OVERLAP)


@query(using(sql.MOSAIC_PIXELS, WINDOWS_SQL) + 'select tile, cast(wr as int) wr, cast(wc as int) wc, top, "left" from win')
def sliding_windows(spark, sf_dir):
    return mosaic.sliding_windows(adapters.mosaic_pixels(spark, sf_dir).select("tile").distinct(), EDGE, EDGE, SIZE, OVERLAP)


@query(using(sql.MOSAIC_PIXELS, WINDOWS_SQL, PREDICTED_SQL) + 'select tile, cast(model as int) model, "row", col, round(value, 4) as value from mos')
def mosaic_last_writer(spark, sf_dir):
    return _mosaic(spark, sf_dir).withColumn("value", F.round("value", 4))


@query(using(sql.MOSAIC_PIXELS, WINDOWS_SQL, PREDICTED_SQL) + 'select tile, "row", col, round(avg(value), 4) agb, round(stddev_pop(value), 4) std from mos group by 1, 2, 3')
def ensemble_pixels(spark, sf_dir):
    return mosaic.ensemble(_mosaic(spark, sf_dir)).withColumns({c: F.round(c, 4) for c in ("agb", "std")})


@query(using(sql.MOSAIC_PIXELS, WINDOWS_SQL, PREDICTED_SQL) + """select tile, "row", col, cast(case when (7 * "row" + 13 * col + ti) % 10 >= 7 then 65535 when agb < 0 then 0 else trunc(agb) end as int) agb
  from (select tile, ti, "row", col, round(avg(value), 4) - 20 agb from mos group by all)""")
def mask_encode(spark, sf_dir):
    scl = adapters.mosaic_pixels(spark, sf_dir).select("tile", "row", "col", adapters.scene_class(F.col("row"), F.col("col"), F.col("ti")).alias("scl"))
    rows = mosaic.ensemble(_mosaic(spark, sf_dir)).withColumn("agb", F.round("agb", 4) - 20).join(scl, ["tile", "row", "col"])
    return mosaic.masked(rows.drop("std")).select("tile", "row", "col", "agb")


#: Kernels of two models over bands dn and dem, each with nothing beyond the window's edge.
_SMOOTH = np.array([[1, 2, 1], [2, 4, 2], [1, 2, 1]]) / 16
_EDGES = np.array([[0, 1, 0], [1, -4, 1], [0, 1, 0]])
_STACK_OF_TWO = [("S2", "B02"), ("DEM", "dem")]


def _convolved(plane: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    around = np.pad(plane, 1)
    h, w = plane.shape
    return sum(kernel[i, j] * around[i : i + h, j : j + w] for i in range(3) for j in range(3))


def smooth_model(x: np.ndarray) -> np.ndarray:
    return _convolved(x[0], _SMOOTH) + x[1] / 2


def edge_model(x: np.ndarray) -> np.ndarray:
    return _convolved(x[1], _EDGES) + x[0] / 10


def block_model(x: np.ndarray) -> np.ndarray:
    """A plane five times coarser: the mean of dn and half the greatest dem of each block."""
    blocks = x.reshape(2, x.shape[1] // 5, 5, x.shape[2] // 5, 5)
    return blocks[0].mean((1, 3)) + blocks[1].max((1, 3)) / 2


def _two_bands(spark, sf_dir) -> DataFrame:
    pair = F.inline(F.array(*[F.struct(F.lit(layer).alias("layer"), F.lit(band).alias("band"), F.col(c).cast("double").alias("value")) for (layer, band), c in zip(_STACK_OF_TWO, ("dn", "dem"), strict=True)]))
    return chunks.to_chunks(adapters.mosaic_pixels(spark, sf_dir).select("tile", "row", "col", pair), CHUNK)


_WHOLE = f"""cells as (select tile, cast(i as int) "row", cast(j as int) col from (select distinct tile from pixels), range({EDGE}) a(i), range({EDGE}) b(j))"""
_LAST = f"""lastw as (select * from (select c.*, w.top, w."left", row_number() over (partition by c.tile, c."row", c.col order by wr desc, wc desc) k from cells c join win w on c.tile = w.tile
  and c."row" between w.top and w.top + {SIZE - 1} and c.col between w."left" and w."left" + {SIZE - 1} where (w.wr = 0 or c."row" >= w.top + {OVERLAP // 2}) and (w.wc = 0 or c.col >= w."left" + {OVERLAP // 2})) where k = 1),
conv as (select l.tile, l."row", l.col, coalesce(sum(dn * (2 - abs(p."row" - l."row")) * (2 - abs(p.col - l.col))), 0) / cast(16 as double) smooth, coalesce(sum(dem * case abs(p."row" - l."row") + abs(p.col - l.col) when 0 then -4 when 1 then 1 else 0 end), 0) edges,
  coalesce(max(dn) filter (p."row" = l."row" and p.col = l.col), 0) dn, coalesce(max(dem) filter (p."row" = l."row" and p.col = l.col), 0) dem
  from lastw l left join pixels p on p.tile = l.tile and p."row" between greatest(l."row" - 1, l.top) and least(l."row" + 1, l.top + {SIZE - 1}) and p.col between greatest(l.col - 1, l."left") and least(l.col + 1, l."left" + {SIZE - 1}) group by 1, 2, 3)"""


@query(using(sql.MOSAIC_PIXELS, WINDOWS_SQL, _WHOLE, _LAST) + """select tile, "row", col, agb, std, cast(case when agb < 0 then 0 else trunc(agb) end as int) code from (
  select tile, "row", col, round((smooth + dem / 2 + edges + dn / cast(10 as double)) / 2, 4) agb, round(abs(smooth + dem / 2 - edges - dn / cast(10 as double)) / 2, 4) std from conv)""")
def predict_planes(spark, sf_dir):
    """Two convolutions over the windows of a stack of two bands; planes mosaicked, put together and encoded."""
    planes = prediction.predict_planes(_two_bands(spark, sf_dir), _STACK_OF_TWO, [smooth_model, edge_model], CHUNK, EDGE, EDGE, SIZE, OVERLAP)
    made = prediction.ensemble_pixels(planes).withColumns({c: F.round(c, 4) for c in ("agb", "std")})
    return made.withColumn("code", features.encode_prediction(F.col("agb")))


@query(using(sql.MOSAIC_PIXELS, "g as (select tile, cast(i as int) \"row\", cast(j as int) col, case when i < 3 then i * 5 else 12 + (i - 2) * 5 end y, case when j < 3 then j * 5 else 12 + (j - 2) * 5 end x from (select distinct tile from pixels), range(6) a(i), range(6) b(j))")
    + """select g.tile, g."row", g.col, round(coalesce(sum(dn), 0) / cast(25 as double) + case when count(*) filter (p.tile is not null) < 25 then greatest(coalesce(max(dem), 0), 0) else max(dem) end / 2, 4) as value
  from g left join pixels p on p.tile = g.tile and p."row" between y and y + 4 and p.col between x and x + 4 group by 1, 2, 3""")
def predict_planes_shrunk(spark, sf_dir):
    """A model whose planes are five times coarser than its windows, on both axes."""
    planes = prediction.predict_planes(_two_bands(spark, sf_dir), _STACK_OF_TWO, [block_model], CHUNK, EDGE, EDGE, 20, 10, shrink=5)
    return prediction.pixels_of(planes).select("tile", "row", "col", F.round("value", 4).alias("value"))


@query(using(sql.GRID, "w as (select k, case when k < 4 then k * 6 else 20 end place, case when k = 0 then 0 else 2 end margin from range(5) r(k))")
    + """select tile, cast(p.pixel as int) pixel, cast(max(k) as int) wr from grid, range(30) p(pixel) join w on p.pixel between place + margin and place + 9 group by 1, 2""")
def mosaic_shrunk(spark, sf_dir):
    """The last writer of each pixel of an axis where predictions are five times coarser than the input of 150 pixels."""
    rows = adapters.grid_tiles(spark, sf_dir).select("tile", F.explode(F.sequence(F.lit(0), F.lit(29))).alias("pixel"))
    return rows.withColumn("wr", mosaic.winner(F.col("pixel"), 150, 50, 20, 5)).where("wr is not null")


@query(using(sql.PATCHES) + "select vec_id, round(avg(dn) * 2 + 1, 6) as value from patches group by vec_id")
def predict_windows(spark, sf_dir):
    rows = mosaic.predict_windows(adapters.patches(spark, sf_dir).select("vec_id", "dn"), lambda a: a.mean(axis=1) * 2 + 1, "dn")
    return rows.select("vec_id", r6("value").alias("value"))


# --- files, models, streams ----------------------------------------------


@query(using(sql.MOSAIC_RASTER) + 'select layer, band, tile, "row", col, value from raster')
def patch_roundtrip(spark, sf_dir):
    """All layers to files of chunks and back, layer by layer."""
    path, out = scratch.folder(spark), None
    chunks.write_chunks(chunks.to_chunks(adapters.raster(spark, sf_dir, adapters.mosaic_pixels(spark, sf_dir)), CHUNK), path)
    for layer in ("S2", "CH", "ALOS", "LC", "DEM"):
        own = chunks.to_pixels(chunks.read_chunks(spark, path, layer), CHUNK)
        out = own if out is None else out.unionByName(own)
    return out.select("layer", "band", "tile", "row", "col", "value")


@query(using(sql.PREDICTIONS) + "select model, count(*) n, round(sqrt(avg((prediction - target) * (prediction - target))), 6) rmse from predictions group by model")
def metrics_sink(spark, sf_dir):
    path = scratch.folder(spark)
    rows = adapters.predictions(spark, sf_dir).groupBy("model").agg(*statistics.error_aggregates(F.col("prediction"), F.col("target")))
    rows.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path).select("model", "n", r6("rmse").alias("rmse"))


@query(using(sql.PREDICTIONS, "e as (select tile, shot_number, gedi_year, avg(prediction) agb, stddev_pop(prediction) std from (select p.*, cast(year(gedi_date) as int) gedi_year from predictions p join (select shot_number, gedi_date from footprints) using (shot_number)) group by 1, 2, 3)")
    + "select tile, gedi_year as year, shot_number, cast(case when agb < 0 then 0 else trunc(round(agb, 6)) end as int) agb, cast(trunc(round(std, 6)) as int) std from e")
def prediction_sink(spark, sf_dir):
    """Mean and spread of five predictions, encoded, by tile and year."""
    path = scratch.folder(spark)
    years = adapters.footprints(spark, sf_dir).select("shot_number", F.year("gedi_date").alias("year"))
    rows = adapters.predictions(spark, sf_dir).groupBy("tile", "shot_number").agg(F.avg("prediction").alias("agb"), F.stddev_pop("prediction").alias("std")).join(years, "shot_number")
    coded = rows.select("tile", "year", "shot_number", *[features.encode_prediction(F.round(c, 6)).alias(c) for c in ("agb", "std")])
    chunks.write_patches(coded, path, ["tile", "year"])
    return chunks.read_patches(spark, path).select("tile", "year", "shot_number", "agb", "std")


@query(using(sql.FOOTPRINTS) + """select shot_number, cast(year(gedi_date) as int) as year, ti % 20 shard, case when year(gedi_date) >= 2022 then 1 else 0 end boa_offset from footprints
  where year(gedi_date) in (2021, 2022) and ti % 20 < 2""")
def patch_shards(spark, sf_dir):
    """Two shards of two years of a patch dataset whose earlier files lack the offset flag."""
    path = scratch.folder(spark)
    rows = adapters.footprints(spark, sf_dir).select("shot_number", F.year("gedi_date").alias("year"), (F.col("ti") % 20).alias("shard"))
    chunks.write_patches(rows.where("year < 2022"), path, ["year", "shard"])
    chunks.write_patches(rows.where("year >= 2022").withColumn("boa_offset", F.lit(1)), path, ["year", "shard"])
    return chunks.read_patches(spark, path, F.col("year").isin(2021, 2022) & (F.col("shard") < 2)).select("shot_number", "year", "shard", "boa_offset")


def _training(spark, sf_dir):
    """Footprints as a regression table: coordinates, season and the nearest synthetic pixel, with a biomass that depends on them."""
    code, turn = geo.encode_lat_lon(F.col("lat"), F.col("lon")), geo.day_of_year(F.col("gedi_date"))
    rows = adapters.footprints(spark, sf_dir).join(F.broadcast(adapters.splits(spark, sf_dir).drop("ti")), "tile")
    rows = rows.select("shot_number", "mode", "agbd", code["lat_cos"].alias("lat_cos"), code["lon_sin"].alias("lon_sin"), turn["cos"].alias("doy_cos"), adapters.optical(F.col("row"), F.col("col"), F.col("ti"), 2).cast("double").alias("B02"))
    return rows.withColumn("biomass", 60 * F.col("lat_cos") + F.col("B02") / 40 + F.col("agbd") / 50)


TRAINING_FEATURES = ["lat_cos", "lon_sin", "doy_cos", "B02"]
SEEDS = [4, 5, 6, 7, 8]


def _edges(step: float, count: int, first: float = 0.0) -> list[float]:
    return [first + step * k for k in range(1, count + 1)]


TRAINING_EDGES = [_edges(1 / 17, 16), _edges(1 / 17, 16), _edges(1 / 17, 16), _edges(250.5, 15)]
STUMP = boosting.Options(leaves=2, rounds=1)


def _half(key: np.ndarray, seed: int, number: int) -> np.ndarray:
    """About half of the rows, by a rule that SQL can state."""
    return key * (37 + seed) % 101 < 51


def _stump_sql(rows: str, columns: list[str], edges: list[list[float]], seeds: list[int], label: str = "y") -> str:
    """The first split of each seed over ``rows(key, y, *columns)`` that are learned from: base, ``split`` and its leaves."""
    listed = ", ".join(f"({f}, '{c}', {b}, cast({e!r} as double))" for f, (c, own) in enumerate(zip(columns, edges, strict=True)) for b, e in enumerate(own))
    picked = " ".join(f"when {f} then \"{c}\"" for f, c in enumerate(columns))
    values = ", ".join(f'({s})' for s in seeds)
    return f"""base as (select cast(round(avg({label})) as bigint) base from {rows}),
edges(f, feature, b, edge) as (values {listed}),
own as (select seed, {rows}.*, base - {label} g from {rows}, base, (values {values}) s(seed) where key * (37 + seed) % 101 < 51),
long as (select seed, f, case f {picked} end x, sum(g) g, count(*) n from own, (select distinct f from edges) group by all),
whole as (select seed, sum(g) g, count(*) n from own group by seed),
cuts as (select seed, f, feature, b, edge, sum(long.g) filter (x <= edge) gl, sum(long.n) filter (x <= edge) nl from long join edges using (f) group by all),
gains as (select c.*, w.g, w.n, (gl / cast(1048576 as double)) * (gl / cast(1048576 as double)) / (nl + 5) + ((w.g - gl) / cast(1048576 as double)) * ((w.g - gl) / cast(1048576 as double)) / (w.n - nl + 5) - (w.g / cast(1048576 as double)) * (w.g / cast(1048576 as double)) / (w.n + 5) gain
  from cuts c join whole w using (seed) where nl >= 20 and w.n - nl >= 20),
split as (select *, round(-gl / cast(nl + 5 as double) * cast(0.1 as double)) left_value, round(-(g - gl) / cast(n - nl + 5 as double) * cast(0.1 as double)) right_value from (select *, row_number() over (partition by seed order by gain desc, f, b) k from gains) where k = 1 and gain > 0)"""


_TRAINING_SQL = f"""training as (select shot_number as key, mode, lat_cos, lon_sin, doy_cos, "B02", cast(round((60 * lat_cos + "B02" / cast(40 as double) + agbd / 50) * 1048576) as bigint) y from (
  select shot_number, mode, agbd, (cos(pi() * lat / 90) + 1) / 2 lat_cos, (sin(pi() * lon / 180) + 1) / 2 lon_sin, (cos(2 * pi() * (dayofyear(gedi_date) - 1) / 365) + 1) / 2 doy_cos, cast((131 * "row" + 71 * col + 17 * f.ti + 58) % 4096 as double) "B02"
  from footprints f join splits using (tile))),
learn as (select * from training where mode = 'train'),
{_stump_sql('learn', TRAINING_FEATURES, TRAINING_EDGES, SEEDS)}"""
_PICKED = "case f " + " ".join(f'when {k} then "{c}"' for k, c in enumerate(TRAINING_FEATURES)) + " end"


def _stumps(spark, sf_dir) -> list[boosting.Model]:
    rows = _training(spark, sf_dir).where("mode in ('train', 'val')").withColumn("held", F.col("mode") == "val")
    return boosting.fit(rows.where("not held"), TRAINING_FEATURES, "biomass", "shot_number", SEEDS, STUMP, None, TRAINING_EDGES, _half)


@query(using(sql.FOOTPRINTS, sql.SPLITS, _TRAINING_SQL) + """select cast(seed as int) seed, feature, round(edge, 6) edge, round(gain, 3) gain, cast(nl as bigint) n_left, cast(n - nl as bigint) n_right, round(left_value / 1048576, 6) value_left, round(right_value / 1048576, 6) value_right from split""")
def gbt_first_split(spark, sf_dir):
    """The first split of five seeds, each on its own half of the training rows."""
    nodes = boosting.nodes_of(spark, _stumps(spark, sf_dir))
    leaf = nodes.where("feature is null").select("seed", "round", "node", "n", F.round("value", 6).alias("value"))
    side = lambda k: leaf.select("seed", "round", F.col("node").alias(k), F.col("n").alias(f"n_{k}"), F.col("value").alias(f"value_{k}"))
    roots = nodes.where("feature is not null").drop("value", "n").join(side("left"), ["seed", "round", "left"]).join(side("right"), ["seed", "round", "right"])
    return roots.select("seed", "feature", r6("edge").alias("edge"), F.round("gain", 3).alias("gain"), "n_left", "n_right", "value_left", "value_right")


@query(using(sql.FOOTPRINTS, sql.SPLITS, _TRAINING_SQL) + f"""select mode, count(*) n_seeds, round(avg(rmse), 6) mean, round(stddev_pop(rmse), 6) std from (
  select seed, mode, sqrt(avg(pow((base + case when {_PICKED} <= edge then left_value else right_value end - y) / 1048576, 2))) rmse from training, base, split group by seed, mode) group by mode""")
def gbt_fit(spark, sf_dir):
    """Mean and spread over the seeds of each split's errors."""
    models = _stumps(spark, sf_dir)
    names = [f"p{m.seed}" for m in models]
    made = boosting.predict(models, _training(spark, sf_dir), names)
    each = made.select("mode", F.col("biomass").alias("target"), F.inline(F.array(*[F.struct(F.lit(m.seed).alias("seed"), F.col(c).alias("prediction")) for m, c in zip(models, names, strict=True)])))
    errors = each.groupBy("mode", "seed").agg(*statistics.error_aggregates(F.col("prediction"), F.col("target")))
    return _rounded(statistics.seed_summary(errors, ["mode"], "rmse"), "mean", "std")


@query()
def gbt_leafwise(spark, sf_dir):
    """Trees of up to 15 leaves of two seeds, stopped on the validation split: rounds, leaves and errors, from the model table written to files."""
    rows = _training(spark, sf_dir).where("mode in ('train', 'val')").withColumn("held", F.col("mode") == "val")
    models = boosting.fit(rows, TRAINING_FEATURES, "biomass", "shot_number", SEEDS[:2], boosting.Options(leaves=15, rounds=6, patience=3), "held", TRAINING_EDGES)
    nodes = scratch.stored(boosting.nodes_of(spark, models))
    sizes = nodes.groupBy("seed").agg(F.max("round").alias("rounds"), F.count_if(F.col("feature").isNull()).alias("leaves"))
    errors = spark.createDataFrame([(m.seed, min(m.errors), m.errors[0]) for m in models if m.errors], "seed int, val_rmse double, first_rmse double")
    return sizes.join(errors, "seed").select("seed", "rounds", "leaves", r6("val_rmse").alias("val_rmse"), r6("first_rmse").alias("first_rmse"))


@query(using(sql.FOOTPRINTS, sql.SPLITS, _TRAINING_SQL) + f"""select cast(s.seed as int) seed, f.feature, round(coalesce(gain, 0), 3) gain from (values {', '.join(f'({s})' for s in SEEDS)}) s(seed) cross join (select distinct feature from edges) f left join split on split.seed = s.seed and split.feature = f.feature""")
def feature_importance(spark, sf_dir):
    """What the splits on each feature gain, by seed, from the table written to files."""
    gains = boosting.importance(scratch.stored(boosting.nodes_of(spark, _stumps(spark, sf_dir))), TRAINING_FEATURES)
    return gains.withColumn("gain", F.round("gain", 3))


#: Edges that suit all columns of a feature table.
PRESET_EDGES = [-60.5, -40.5, -20.5, -5.5, 0.0205, 0.0505, 0.1005, 0.2005, 0.3005, 0.5005, 0.7005, 0.9005, 1.5005, 3.5, 10.5, 20.5, 40.5]


def _preset_sql(name: str) -> str:
    """One preset's first split, as a query of its own."""
    columns = features.preset(name)
    return f"""select '{name}' preset, feature, edge, gain, n_left from (with rows_{name} as (select shot_number as key, cast(round(agbd * 1048576) as bigint) y, {', '.join(f'"{c}"' for c in columns)} from ft),
{_stump_sql(f'rows_{name}', columns, [PRESET_EDGES] * len(columns), [4])} select feature, round(edge, 6) edge, round(gain, 3) gain, cast(nl as bigint) n_left from split)"""


@query(using(sql.PATCHES, sql.FOOTPRINTS, sql.LAND, _features_sql()) + " union all ".join(map(_preset_sql, PRESETS)))
def gbt_presets(spark, sf_dir):
    """The first split of a model fitted to each preset's columns of the feature table."""
    rows, out = scratch.stored(_features(spark, sf_dir)), None
    for name in PRESETS:
        columns = features.preset(name)
        fitted = boosting.fit(rows, columns, "agbd", "shot_number", [4], STUMP, None, [PRESET_EDGES] * len(columns), _half)
        nodes = boosting.nodes_of(spark, fitted)
        left = nodes.select(F.col("node").alias("left"), F.col("n").alias("n_left"))
        part = nodes.where("feature is not null").join(left, "left").select(F.lit(name).alias("preset"), "feature", r6("edge").alias("edge"), F.round("gain", 3).alias("gain"), "n_left")
        out = part if out is None else out.unionByName(part)
    return out


_PIXEL_EDGES = [_edges(250.5, 15), _edges(3.703, 16, -31.1)]


@query(using(sql.MOSAIC_PIXELS, "labelled as (select ti * 1024 + \"row\" * 32 + col as key, ti, tile, \"row\", col, cast(dn as double) x, dem, cast(round((dn / cast(40 as double) + dem / 10) * 1048576) as bigint) y from pixels)",
    "learn as (select * from labelled where ti % 5 < 4)", _stump_sql("learn", ["x", "dem"], _PIXEL_EDGES, [4, 5]))
    + """select tile, "row", col, round(avg(value), 4) agb, round(stddev_pop(value), 4) std from (
  select tile, "row", col, (base + coalesce(case when case f when 0 then x when 1 then dem end <= edge then left_value when f is not null then right_value end, 0)) / 1048576 as value from labelled, base, (values (4), (5)) s(seed) left join split on split.seed = s.seed) group by 1, 2, 3""")
def predict_tiles(spark, sf_dir):
    """Models of two seeds, fitted to the pixels of four tiles in five, applied to every pixel of every window; mosaicked and put together."""
    pixels = adapters.mosaic_pixels(spark, sf_dir).withColumns({"x": F.col("dn").cast("double"), "biomass": F.col("dn") / 40 + F.col("dem") / 10, "key": F.col("ti") * 1024 + F.col("row") * 32 + F.col("col")})
    fitted = boosting.fit(pixels.where("ti % 5 < 4"), ["x", "dem"], "biomass", "key", [4, 5], STUMP, None, _PIXEL_EDGES, _half)
    rows = mosaic.windows_of(pixels, EDGE, EDGE, SIZE, OVERLAP)
    made = mosaic.ensemble(mosaic.mosaic(mosaic.predict_pixels(fitted, rows), EDGE, EDGE, SIZE, OVERLAP))
    return made.select("tile", "row", "col", *[F.round(c, 4).alias(c) for c in ("agb", "std")])


@query("""with e as (select event_id, cast(user_id % 25 as int) ti, cast(ts as date) - 1200 gedi_date from events), """ + sql.SCENES + f""",
  s as (select tile, acq_date, max(scene) scene from scenes group by 1, 2)
  select event_id shot_number, f.tile, s.scene from (select *, {sql.tile('ti')} tile from e) f asof join s on f.tile = s.tile and f.gedi_date >= s.acq_date
  where s.acq_date >= cast(date_trunc('month', gedi_date) - interval 5 month as date)""")
def stream_patch_append(spark, sf_dir):
    return ingest.run_once(spark, ingest.footprint_stream(spark, sf_dir), scratch.stored(adapters.scenes(spark, sf_dir)), scratch.folder(spark))


#: Days that a footprint of the stream waits for scenes, and days that both streams may be late.
WAIT, LATE = 5, 7


@query("with " + sql.SCENES + f""", e as (select event_id shot_number, cast(user_id % 25 as int) ti, cast(ts as date) - 1200 gedi_date, cast(event_id * 31 % 64 as int) r, cast(event_id * 17 % 64 as int) c from events),
  w as (select least((select max(gedi_date) from e), (select max(acq_date) from scenes)) - {LATE} wm),
  s as (select tile, acq_date, max(scene) scene from scenes group by 1, 2),
  m as (select f.*, s.scene, s.acq_date from (select *, {sql.tile('ti')} tile from e, w where gedi_date + {WAIT} < wm) f asof join s on f.tile = s.tile and f.gedi_date >= s.acq_date where s.acq_date >= cast(date_trunc('month', gedi_date) - interval 5 month as date)),
  v as (select shot_number, tile, scene, acq_date, (7 * r + 13 * c + ti) % 10 < 7 as centre, count(*) filter ((7 * (r + i) + 13 * (c + j) + ti) % 10 < 7) veg from m, range(-2, 3) a(i), range(-2, 3) b(j) where r between 2 and 61 and c between 2 and 61 group by all)
  select shot_number, tile, scene, acq_date, cast(100 * veg // 25 as int) vegetation_score from v where centre and 100 * veg // 25 >= 20""")
def stream_chain(spark, sf_dir):
    """Footprints and scenes as streams: footprints wait for late scenes in keyed state, then windows are cut, judged and written batch by batch."""
    path = scratch.folder(spark)
    adapters.scenes(spark, sf_dir).select("tile", "acq_date", "scene").write.parquet(f"{path}/scenes")
    layers = scratch.stored(chunks.to_chunks(adapters.raster(spark, sf_dir).where("band = 'SCL'"), CHUNK))
    shot = F.col("shot_number")
    footprints = ingest.footprint_stream(spark, sf_dir).select("shot_number", "tile", "gedi_date", (shot * 31 % 64).cast("int").alias("row"), (shot * 17 % 64).cast("int").alias("col"))
    scenes = spark.readStream.schema("tile string, acq_date date, scene string").parquet(f"{path}/scenes")
    parts = waiting.parts_of(adapters.table(spark, sf_dir, "events").count(), 25, 4)
    matched = waiting.matched_stream(footprints, scenes, f"{LATE} days", WAIT, parts=parts)
    waiting.run(matched, waiting.batch_writer(layers, f"{path}/table", CHUNK, PATCH, 64, 64), f"{path}/state")
    return spark.read.parquet(f"{path}/table").select("shot_number", "tile", "scene", "acq_date", "vegetation_score")
