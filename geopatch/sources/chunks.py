"""Raster chunk tables, patch datasets and feature tables as files.

A raster is stored as square chunks of one band, so that a window reads only
the chunks it touches.  The grid a chunk belongs to is in its own columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Land-cover classes that a table of vectors may have; more are refused.
MOST_CLASSES = 1000


def to_chunks(pixels: DataFrame, side: int) -> DataFrame:
    """``layer, band, tile, crow, ccol, data`` of a long pixel table: one row-major array a chunk, null where a pixel is missing.

    A chunk's pixels are put in order once, and nulls go into the gaps between
    neighbours, so the work is linear in the pixels.  Of several values of a
    pixel the greatest counts.
    """
    inner = (F.col("row") % side) * side + F.col("col") % side
    keys = ["layer", "band", "tile", F.floor(F.col("row") / side).cast("int").alias("crow"), F.floor(F.col("col") / side).cast("int").alias("ccol")]
    rows = pixels.select(*keys, inner.cast("int").alias("k"), "value")
    lists = rows.groupBy("layer", "band", "tile", "crow", "ccol").agg(F.array_sort(F.collect_list(F.struct("k", "value"))).alias("own"))
    place = lambda i: F.get("own", i)["k"]
    lists = lists.withColumn("own", F.filter("own", lambda x, i: F.coalesce(place(i + 1) != x["k"], F.lit(True))))
    null = F.lit(None).cast(pixels.schema["value"].dataType)
    gap = lambda low, high: F.array_repeat(null, high - low - 1)
    runs = F.transform("own", lambda x, i: F.concat(gap(F.when(i > 0, place(i - 1)).otherwise(-1), x["k"]), F.array(x["value"])))
    full = F.transform("own", lambda x: x["value"])
    data = F.when(F.size("own") == side * side, full).otherwise(F.concat(F.flatten(runs), gap(place(F.size("own") - 1), F.lit(side * side))))
    return lists.select("layer", "band", "tile", "crow", "ccol", data.alias("data"))


def to_pixels(chunks: DataFrame, side: int) -> DataFrame:
    """The long pixel table of chunks; missing pixels are left out."""
    rows = chunks.select("layer", "band", "tile", "crow", "ccol", F.posexplode("data").alias("k", "value")).where("value is not null")
    row = (F.col("crow") * side + F.floor(F.col("k") / side)).cast("int")
    return rows.select("layer", "band", "tile", row.alias("row"), (F.col("ccol") * side + F.col("k") % side).cast("int").alias("col"), "value")


def write_chunks(chunks: DataFrame, path: str) -> None:
    """Partitioned by layer and sorted by tile, so that a read of a layer prunes the files and one of a tile their pages.

    Files are as many as tasks and layers, however many tiles there are.
    """
    chunks.sortWithinPartitions("layer", "tile").write.mode("overwrite").partitionBy("layer").parquet(path)


def read_chunks(spark: SparkSession, path: str, layer: str, bands: list[str] | None = None) -> DataFrame:
    rows = spark.read.parquet(path).where(F.col("layer") == layer)
    return rows if bands is None else rows.where(F.col("band").isin(bands))


def write_patches(patches: DataFrame, path: str, by: list[str]) -> None:
    """The patch dataset: one wide row a footprint, partitioned, gzip-compressed; present partitions are replaced."""
    patches.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "gzip").partitionBy(*by).parquet(path)


def read_patches(spark: SparkSession, path: str, predicate: Column | None = None) -> DataFrame:
    """A patch dataset; files that lack the optional offset flag read as 0."""
    rows = spark.read.option("mergeSchema", "true").parquet(path)
    if predicate is not None:
        rows = rows.where(predicate)
    flag = F.coalesce("boa_offset", F.lit(0)) if "boa_offset" in rows.columns else F.lit(0)
    return rows.withColumn("boa_offset", flag)


def read_embeddings(spark: SparkSession, path: str) -> dict[int, list[float]]:
    """The land-cover vectors of a CSV file of at most a few dozen classes, by class."""
    schema = T.StructType([*(T.StructField(f"dim{k}", T.DoubleType()) for k in range(5)), T.StructField("mapping", T.IntegerType())])
    rows = spark.read.schema(schema).csv(path, header=True).limit(MOST_CLASSES + 1).collect()
    if len(rows) > MOST_CLASSES:
        raise ValueError(f"{path} has more than {MOST_CLASSES} classes")
    return {r["mapping"]: [r[f"dim{k}"] for k in range(5)] for r in rows}


def write_features(rows: DataFrame, path: str, by: list[str]) -> None:
    rows.write.mode("overwrite").partitionBy(*by).csv(path, header=True)


def read_features(spark: SparkSession, path: str, schema: T.StructType, columns: list[str]) -> DataFrame:
    """Chosen columns of a feature table; the file's other columns are not parsed."""
    return spark.read.schema(schema).csv(path, header=True).select(*columns)


def read_tile_list(spark: SparkSession, path: str) -> DataFrame:
    """``tile`` of a text file with one name a line."""
    from geopatch.functions.names import tile_name

    return spark.read.text(path).select(tile_name(F.col("value")).alias("tile")).where("tile <> ''")
