"""Inputs of the engine derived from the star-schema tables: tiles, footprints, scenes, rasters, patches.

Each adapter is a plain projection or aggregation of one given table, so its
size follows that table.  Rasters are long pixel tables of a synthetic scene
per tile.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geopatch.schema import LAND_COVER

#: Rows and columns of a synthetic raster.
SIDE = 64
#: Days that move the tables' dates into the mission's years.
SHIFT = 8766
BAND_LETTERS = "CDEFGHJKLMNPQRSTUVWX"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tile_of(ti: Column) -> Column:
    zone = F.floor(F.lit(14.4) * ti / 6.0) + 1
    return F.concat(F.lpad(zone.cast("string"), 2, "0"), F.substring(F.lit(BAND_LETTERS), (ti % 20 + 1).cast("int"), F.lit(1)), F.lit("AA"))


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``ti, tile, zone, min_lon, max_lon, min_lat, max_lat, ring``: rectangles that overlap their neighbours."""
    ti = F.col("n_nationkey")
    west = F.round(F.lit(-180.0) + F.lit(14.4) * ti, 6)
    rows = table(spark, sf_dir, "nation").select(ti.alias("ti"), tile_of(ti).alias("tile"), (F.floor(F.lit(14.4) * ti / 6.0) + 1).cast("int").alias("zone"), west.alias("min_lon"), F.round(west + 16.0, 6).alias("max_lon"), F.lit(-60.0).alias("min_lat"), F.lit(60.0).alias("max_lat"))
    corner = lambda x, y: F.struct(F.col(x).alias("lon"), F.col(y).alias("lat"))
    return rows.withColumn("ring", F.array(corner("min_lon", "min_lat"), corner("max_lon", "min_lat"), corner("max_lon", "max_lat"), corner("min_lon", "max_lat")))


def footprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``shot_number, ti, tile, gedi_date, lon, lat, agbd, row, col, pattern`` from orders."""
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    date = F.date_add(F.to_date("o_orderdate"), SHIFT)
    pattern = F.concat(F.lit("D"), F.date_format(date, "yyyyDDD"), F.lit("_O"), key, F.lit("_"), 1 + key % 4, F.lit("_T"), cust, F.lit("_2_V"), 2 + key % 3)
    return table(spark, sf_dir, "orders").select(
        key.alias("shot_number"),
        (cust % 25).cast("int").alias("ti"),
        tile_of(cust % 25).alias("tile"),
        date.alias("gedi_date"),
        ((key * 104729 % 360000) / 1000.0 - 180.0).alias("lon"),
        ((key * 7919 % 120000) / 1000.0 - 60.0).alias("lat"),
        (F.col("o_totalprice") / F.lit(800.0)).alias("agbd"),
        (31 * key % SIDE).cast("int").alias("row"),
        ((17 * key + cust) % SIDE).cast("int").alias("col"),
        pattern.alias("pattern"),
    )


def scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``ti, tile, acq_date, cloud, scene`` from lineitem: one product for each tile and day."""
    ti = (F.col("l_suppkey") % 25).cast("int").alias("ti")
    day = F.date_add(F.to_date("l_shipdate"), SHIFT).alias("acq_date")
    rows = table(spark, sf_dir, "lineitem").select(ti, day, "l_discount")
    rows = rows.groupBy("ti", "acq_date").agg(F.min("l_discount").alias("cloud")).withColumn("tile", tile_of(F.col("ti")))
    ymd = F.date_format("acq_date", "yyyyMMdd")
    name = F.concat(F.lit("S2A_MSIL2A_"), ymd, F.lit("T100000_N0"), 200 + F.col("ti"), F.lit("_R"), 100 + F.col("ti"), F.lit("_T"), F.col("tile"), F.lit("_"), ymd, F.lit("T120000"))
    return rows.select("ti", "tile", "acq_date", "cloud", name.alias("scene"))


def optical(row: Column, col: Column, ti: Column, band: int) -> Column:
    return ((131 * row + 71 * col + 17 * ti + 29 * band) % 4096).cast("int")


def scene_class(row: Column, col: Column, ti: Column) -> Column:
    return F.when((7 * row + 13 * col + ti) % 10 < 7, 4).when((row + col) % 2 == 0, 6).otherwise(11)


def canopy(row: Column, col: Column) -> Column:
    return F.when((row + col) % 9 == 0, 255).otherwise(row * col % 60)


def land_cover(row: Column, col: Column, ti: Column) -> Column:
    return F.get(F.array(*map(F.lit, LAND_COVER)), ((row * col + ti) % 20).cast("int"))


def pixels(spark: SparkSession, sf_dir: str, side: int = SIDE) -> DataFrame:
    """``ti, tile, row, col, dn`` of every pixel of every tile."""
    grid = F.explode(F.sequence(F.lit(0), F.lit(side * side - 1))).alias("k")
    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("ti"), tile_of(F.col("n_nationkey")).alias("tile"), grid)
    rows = rows.select("ti", "tile", F.floor(F.col("k") / side).cast("int").alias("row"), (F.col("k") % side).cast("int").alias("col"))
    return rows.withColumn("dn", optical(F.col("row"), F.col("col"), F.col("ti"), 2))


def mosaic_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``ti, tile, row, col, dn, dem``: squares of four by four patches beside each other, so tiles grow with embeddings."""
    k, at = F.col("k"), (F.col("vec_id") % 16).cast("int")
    rows = patches(spark, sf_dir).select("vec_id", "dem", F.posexplode("dn").alias("k", "dn"))
    ti = F.floor(F.col("vec_id") / 16)
    row, col = (F.floor(at / 4) * 8 + F.floor(k / 8)).cast("int"), ((at % 4) * 8 + k % 8).cast("int")
    return rows.select(ti.alias("ti"), F.concat(F.lit("V"), ti.cast("string")).alias("tile"), row.alias("row"), col.alias("col"), "dn", F.get("dem", k).alias("dem"))


def grid_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``ti, tile, min_lon, max_lon, min_lat, max_lat``: one tile a supplier."""
    ti = F.col("s_suppkey")
    west, south = (ti * 37 % 356 - 180).cast("double"), (ti * 23 % 116 - 60).cast("double")
    rows = table(spark, sf_dir, "supplier").select(ti.alias("ti"), F.concat(tile_of(F.col("s_nationkey")), F.lit("_"), ti.cast("string")).alias("tile"), west.alias("min_lon"), south.alias("min_lat"))
    return rows.withColumns({"max_lon": F.col("min_lon") + 4.0, "max_lat": F.col("min_lat") + 4.0})


def raster(spark: SparkSession, sf_dir: str, at: DataFrame | None = None, bands: list[str] | None = None) -> DataFrame:
    """``layer, band, tile, ti, row, col, value`` of all layers, or of some bands, over pixels ``at``; radar is missing for every seventh tile."""
    at = pixels(spark, sf_dir) if at is None else at
    r, c, ti = F.col("row"), F.col("col"), F.col("ti")
    layers = F.array(
        *[F.struct(F.lit(layer).alias("layer"), F.lit(band).alias("band"), value.cast("int").alias("value")) for layer, band, value in (
            ("S2", "B02", F.col("dn")),
            *[("S2", band, optical(r, c, ti, k)) for k, band in ((3, "B03"), (4, "B04"), (8, "B08"))],
            ("S2", "SCL", scene_class(r, c, ti)),
            ("CH", "ch", canopy(r, c)),
            ("CH", "std", F.when((r + c) % 9 == 0, 255).otherwise((r + 2 * c) % 12)),
            ("ALOS", "HH", F.when(ti % 7 != 0, (37 * r + 11 * c + ti) % 5000)),
            ("ALOS", "HV", F.when(ti % 7 != 0, (13 * r + 29 * c + ti) % 3000)),
            ("LC", "lc", land_cover(r, c, ti)),
            ("LC", "prob", F.when((r * c + ti) % 20 == 0, 255).otherwise((r + c) % 101)),
            ("DEM", "dem", (r * 3 + c * 5 + ti) % 900 - 50),
        ) if bands is None or band in bands]
    )
    return at.select("tile", "ti", "row", "col", F.inline(layers)).where("value is not null")


def radar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``tile, yy, row, col, hh, hv``: yearly radar mosaics from lineitem, none for every seventh tile and for 2021."""
    ti = (F.col("l_suppkey") % 25).cast("int")
    yy = F.date_format(F.date_add(F.to_date("l_shipdate"), SHIFT), "yy").alias("yy")
    rows = table(spark, sf_dir, "lineitem").where("l_suppkey % 25 % 7 <> 0")
    keys = [tile_of(ti).alias("tile"), yy, (F.col("l_orderkey") % SIDE).cast("int").alias("row"), (F.col("l_partkey") % SIDE).cast("int").alias("col")]
    hh, hv = F.max(F.floor(F.col("l_quantity") * 90)).cast("int"), F.max(F.floor("l_extendedprice") % 5000).cast("int")
    return rows.groupBy(*keys).agg(hh.alias("hh"), hv.alias("hv")).where("yy <> '21'")


def yearly_canopy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``tile, yy, row, col, ch, std``: yearly canopy heights from lineitem, none for 2022."""
    yy = F.date_format(F.date_add(F.to_date("l_shipdate"), SHIFT), "yy").alias("yy")
    keys = [tile_of((F.col("l_suppkey") % 25).cast("int")).alias("tile"), yy, (F.col("l_partkey") % SIDE).cast("int").alias("row"), (F.col("l_orderkey") % SIDE).cast("int").alias("col")]
    ch, std = F.max(F.floor("l_quantity")).cast("int"), F.min(F.floor(F.col("l_discount") * 100)).cast("int")
    return table(spark, sf_dir, "lineitem").groupBy(*keys).agg(ch.alias("ch"), std.alias("std")).where("yy <> '22'")


def patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``vec_id, boa, dn array<int>, dem array<double>``: squares of eight by eight from embeddings."""
    values = F.transform("embedding", lambda x: x.cast("double"))
    return table(spark, sf_dir, "embeddings").select(
        "vec_id",
        (F.col("vec_id") % 2).cast("int").alias("boa"),
        F.transform(values, lambda e: F.floor(F.abs(e) * 10000.0).cast("int")).alias("dn"),
        F.transform(values, lambda e: e * 100.0).alias("dem"),
    )


def land_cover_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``shot_number, ti, lc, prob`` from part."""
    classes = F.array(*map(F.lit, LAND_COVER))
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("shot_number"),
        (F.col("p_partkey") % 25).cast("int").alias("ti"),
        F.get(classes, (F.col("p_size") % 20).cast("int")).alias("lc"),
        F.when(F.col("p_size") == 50, 255).otherwise(F.col("p_size") * 2).cast("int").alias("prob"),
    )


def splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``tile, mode``."""
    ti = F.col("n_nationkey")
    mode = F.when(ti % 10 < 8, "train").when(ti % 10 == 8, "val").otherwise("test")
    return table(spark, sf_dir, "nation").select(ti.alias("ti"), tile_of(ti).alias("tile"), mode.alias("mode"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``shot_number, tile, model, epoch, target, prediction`` of five models, from footprints."""
    rows = footprints(spark, sf_dir).select("shot_number", "ti", "tile", F.col("agbd").alias("target"), F.explode(F.sequence(F.lit(1), F.lit(5))).alias("model"))
    error = ((F.col("shot_number") * (37 + F.col("model"))) % 101 - 50).cast("double")
    return rows.withColumn("prediction", F.col("target") + error)
