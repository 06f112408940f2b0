"""Footprints that arrive as a stream: de-duplicated, matched with scenes, appended to a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geopatch.operators.matching import asof_join
from geopatch.sources.adapters import tile_of

#: Days that move the events' dates into the scenes' years.
SHIFT = 1200


def footprint_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``shot_number, shot_ts, tile, gedi_date`` from the events table, as a stream of files."""
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    is_file = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(spark._jvm.org.apache.hadoop.fs.Path(path)).isFile()
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", 8)
    events = reader.option("pathGlobFilter", "events.parquet").parquet(sf_dir) if is_file else reader.parquet(path)
    tile = tile_of(F.col("user_id") % 25)
    return events.select(F.col("event_id").alias("shot_number"), F.col("ts").cast("timestamp").alias("shot_ts"), tile.alias("tile"), F.date_sub(F.to_date("ts"), SHIFT).alias("gedi_date"))


def once(stream: DataFrame, delay: str = "30 days") -> DataFrame:
    """The stream without shots delivered again within the delay."""
    return stream.withWatermark("shot_ts", delay).dropDuplicatesWithinWatermark(["shot_number"])


def append_matched(stream: DataFrame, scenes: DataFrame, path: str, checkpoint: str):
    """Starts a query that matches each batch with the static scenes and appends it to a table, one folder a batch.

    A batch that is tried again replaces its own folder, so each shot is
    written once.
    """

    def write(batch: DataFrame, number: int) -> None:
        matched = asof_join(batch, scenes.select("tile", "acq_date", "scene")).where("scene is not null")
        matched.select("shot_number", "tile", "scene").write.mode("overwrite").parquet(f"{path}/batch={number}")

    return once(stream).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_once(spark: SparkSession, stream: DataFrame, scenes: DataFrame, path: str) -> DataFrame:
    """Runs the stream over all that is there, and reads the table."""
    append_matched(stream, scenes, f"{path}/table", f"{path}/state").awaitTermination()
    return spark.read.parquet(f"{path}/table").select("shot_number", "tile", "scene")
