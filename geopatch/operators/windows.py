"""Windows of raster pixels around footprints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geopatch.functions.arrays import fits, validity_score, vegetation_score
from geopatch.schema import MIN_SCORE, NODATA


def extract_patches(points: DataFrame, chunks: DataFrame, side: int, size: int, height: int, width: int) -> DataFrame:
    """``tile, row, col, layer, band, patch`` of every footprint whose window fits into the raster.

    ``points(tile, row, col, ..)``, ``chunks(layer, band, tile, crow, ccol,
    data)`` of ``side`` by ``side`` pixels.  A window touches up to four chunks
    (more if it is larger than a chunk): each place is spread over those it
    touches and joined on the chunk.  From each only the rows of the window it
    holds are cut out, and these runs, never whole chunks, are shuffled to put
    the patch together.  Places are made distinct first, so that many
    footprints of one pixel cost one window.
    """
    half = size // 2
    places = points.select("tile", "row", "col").where(fits(F.col("row"), F.col("col"), height, width, size)).distinct()
    span = lambda c: F.sequence(F.floor((F.col(c) - half) / side).cast("int"), F.floor((F.col(c) + half) / side).cast("int"))
    spread = places.withColumn("crow", F.explode(span("row"))).withColumn("ccol", F.explode(span("col")))
    met = spread.join(chunks, ["tile", "crow", "ccol"])
    top, bottom = F.greatest(F.col("row") - half, F.col("crow") * side), F.least(F.col("row") + half, F.col("crow") * side + side - 1)
    left, right = F.greatest(F.col("col") - half, F.col("ccol") * side), F.least(F.col("col") + half, F.col("ccol") * side + side - 1)
    parts = F.transform(
        F.sequence(top, bottom),
        lambda r: F.struct(r.alias("r"), left.alias("c"), F.slice("data", ((r - F.col("crow") * side) * side + left - F.col("ccol") * side + 1).cast("int"), (right - left + 1).cast("int")).alias("values")),
    )
    keys = ["tile", "row", "col", "layer", "band"]
    pieces = met.select(*keys, parts.alias("parts")).groupBy(*keys).agg(F.array_sort(F.flatten(F.collect_list("parts"))).alias("parts"))
    return pieces.select(*keys, F.flatten(F.transform("parts", lambda p: p["values"])).alias("patch"))


def with_layer(points: DataFrame, patches: DataFrame, layer: str, band: str, name: str, size: int, nodata: int) -> DataFrame:
    """Points with one band's window as column ``name``; a missing layer is a plane of no-data."""
    own = patches.where((F.col("layer") == layer) & (F.col("band") == band)).select("tile", "row", "col", F.col("patch").alias(name))
    return points.join(own, ["tile", "row", "col"], "left").withColumn(name, F.coalesce(name, F.array_repeat(F.lit(nodata), size * size)))


def vegetated(rows: DataFrame, scl: str, size: int, least: int = MIN_SCORE) -> DataFrame:
    """Rows whose window around the footprint is vegetation to at least so many percent."""
    return rows.withColumn("vegetation_score", vegetation_score(F.col(scl), size)).where(F.col("vegetation_score") >= least)


def valid_height(rows: DataFrame, ch: str, size: int, least: int = MIN_SCORE) -> DataFrame:
    """Rows whose canopy height is known on at least so many percent of the window."""
    return rows.withColumn("ch_score", validity_score(F.col(ch), size, NODATA["CH"])).where(F.col("ch_score") >= least)
