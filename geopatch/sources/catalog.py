"""Footprints in spatial order, product metadata as XML, and listings of product files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of each axis in the spatial order.
BITS = 16
#: Ranges of the order that a box is read by, at most; a box with more pieces is covered by larger ones.
RANGES = 64
#: Names of the product's elements.
METADATA = (
    "scene string, QUANTIFICATION_VALUES_LIST struct<BOA_QUANTIFICATION_VALUE: double>, "
    "Spectral_Information_List struct<Spectral_Information: array<struct<_bandId: int, _physicalBand: string>>>, "
    "BOA_ADD_OFFSET_VALUES_LIST struct<BOA_ADD_OFFSET: array<struct<_band_id: int, _VALUE: bigint>>>"
)
ROW_TAG = "Product"


def axis_place(x: Column, low: float, high: float) -> Column:
    """The place of a value among 2 to the power of BITS equal parts of an axis."""
    return F.least(F.lit((1 << BITS) - 1), F.greatest(F.lit(0), F.floor((x - low) / (high - low) * (1 << BITS)))).cast("long")


def spaced(x: Column) -> Column:
    """The bits of a number, each followed by a zero."""
    for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask))
    return x


def spatial_order(lon: Column, lat: Column) -> Column:
    """Longitude and latitude as one number, bit by bit in turn (Z-order)."""
    return spaced(axis_place(lon, -180.0, 180.0)).bitwiseOR(F.shiftleft(spaced(axis_place(lat, -90.0, 90.0)), 1))


def box_ranges(west: float, east: float, south: float, north: float, most: int = RANGES) -> list[tuple[int, int]]:
    """At most ``most`` ranges of the order that hold the whole box: its squares, level by level, until there would be more."""
    place = lambda x, low, high: min((1 << BITS) - 1, max(0, int((x - low) / (high - low) * (1 << BITS))))
    x0, x1, y0, y1 = place(west, -180, 180), place(east, -180, 180), place(south, -90, 90), place(north, -90, 90)
    done, todo = [], [(0, 0, BITS, 0)]
    while todo:
        following = []
        for x, y, level, z in todo:
            if x0 <= x << level and (x + 1 << level) - 1 <= x1 and y0 <= y << level and (y + 1 << level) - 1 <= y1 or level == 0:
                done.append((z << 2 * level, (z + 1 << 2 * level) - 1))
                continue
            for k in range(4):
                a, b = 2 * x + (k & 1), 2 * y + (k >> 1)
                if a << level - 1 <= x1 and (a + 1 << level - 1) - 1 >= x0 and b << level - 1 <= y1 and (b + 1 << level - 1) - 1 >= y0:
                    following.append((a, b, level - 1, 4 * z + k))
        if len(done) + len(following) > most:
            done += [(z << 2 * level, (z + 1 << 2 * level) - 1) for _, _, level, z in todo if not any(low <= z << 2 * level <= high for low, high in done)]
            break
        todo = following
    out: list[tuple[int, int]] = []
    for low, high in sorted(done):
        if out and low == out[-1][1] + 1:
            out[-1] = (out[-1][0], high)
        else:
            out.append((low, high))
    return out


def write_footprints(rows: DataFrame, path: str, files: int, group_bytes: int = 16 << 20) -> None:
    """Files by ranges of the spatial order, each in that order, so that files and row groups hold small boxes."""
    placed = rows.withColumn("z", spatial_order(F.col("lon"), F.col("lat")))
    placed.repartitionByRange(files, "z").sortWithinPartitions("z").write.option("parquet.block.size", group_bytes).mode("overwrite").parquet(path)


def read_box(spark: SparkSession, path: str, west: float, east: float, south: float, north: float) -> DataFrame:
    """The footprints of a box: the ranges of the order and both coordinates go down to the Parquet reader, which leaves out row groups by their statistics."""
    ranges = box_ranges(west, east, south, north)
    within = F.lit(False)
    for low, high in ranges:
        within = within | F.col("z").between(low, high)
    rows = spark.read.parquet(path).where(F.col("z").between(ranges[0][0], ranges[-1][1]))
    return rows.where(within & F.col("lon").between(west, east) & F.col("lat").between(south, north)).drop("z")


def write_metadata(rows: DataFrame, path: str) -> None:
    """Product metadata ``scene, quantification, bands array<struct<id, band, offset>>`` as XML files; a null offset has no element."""
    spectral = F.transform("bands", lambda b: F.struct(b["id"].alias("_bandId"), b["band"].alias("_physicalBand")))
    offsets = F.transform(F.filter("bands", lambda b: b["offset"].isNotNull()), lambda b: F.struct(b["id"].alias("_band_id"), b["offset"].alias("_VALUE")))
    shaped = rows.select(
        "scene",
        F.struct(F.col("quantification").cast("double").alias("BOA_QUANTIFICATION_VALUE")).alias("QUANTIFICATION_VALUES_LIST"),
        F.struct(spectral.alias("Spectral_Information")).alias("Spectral_Information_List"),
        F.struct(offsets.alias("BOA_ADD_OFFSET")).alias("BOA_ADD_OFFSET_VALUES_LIST"),
    )
    shaped.write.mode("overwrite").option("rootTag", "Products").option("rowTag", ROW_TAG).format("xml").save(path)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """``scene, quantification, band, offset``: a row for each band of each product, named as the image files are; offset is null where the product has none for the band."""
    rows = spark.read.format("xml").option("rowTag", ROW_TAG).schema(METADATA).load(path)
    offsets = F.map_from_entries(F.transform(F.coalesce(F.col("BOA_ADD_OFFSET_VALUES_LIST.BOA_ADD_OFFSET"), F.array().cast("array<struct<_band_id:int,_VALUE:bigint>>")), lambda o: F.struct(o["_band_id"], o["_VALUE"])))
    bands = rows.select("scene", F.col("QUANTIFICATION_VALUES_LIST.BOA_QUANTIFICATION_VALUE").alias("quantification"), offsets.alias("offsets"), F.explode("Spectral_Information_List.Spectral_Information").alias("b"))
    # physical bands of one digit are named without the leading zero
    band = F.when(F.col("b._physicalBand").rlike("^B[0-9]$"), F.concat(F.lit("B0"), F.substring("b._physicalBand", 2, 1))).otherwise(F.col("b._physicalBand"))
    return bands.select("scene", "quantification", band.alias("band"), F.try_element_at("offsets", F.col("b._bandId")).alias("offset"))


def write_products(scenes: DataFrame, path: str) -> None:
    """A placeholder file for each of ``scenes(scene, month, tile)`` below folders of its month and tile."""
    scenes.select("scene", "month", "tile", F.lit("x").alias("value")).write.mode("overwrite").partitionBy("month", "tile", "scene").text(path)


def list_products(spark: SparkSession, path: str, months: list[str], tiles: list[str]) -> DataFrame:
    """``month, tile, scene`` of the product files of some months and tiles: other folders are not listed, and no content is read."""
    choice = lambda values: "{" + ",".join(values) + "}"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{path}/month={choice(months)}/tile={choice(tiles)}").select("path")
    part = lambda name: F.regexp_extract("path", f"{name}=([^/]+)", 1).alias(name)
    return files.select(part("month"), part("tile"), part("scene")).distinct()
