"""Footprints and scenes as one stream: a footprint waits for scenes that are delivered late, and then its window is cut and judged."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from geopatch.operators.matching import LOOK_BACK
from geopatch.operators.windows import extract_patches, vegetated

#: Parts into which a tile's footprints are dealt; its scenes go to all of them.
PARTS = 8
#: Footprints of a tile and part, about; what a task holds of them at a time does not grow with the input.
HELD = 50_000
MATCHED = "shot_number long, tile string, row int, col int, gedi_date date, scene string, acq_date date"
DAY = np.timedelta64(1, "D")


def joint_stream(footprints: DataFrame, scenes: DataFrame, delay: str, parts: int = PARTS) -> DataFrame:
    """Both streams under one schema, with event times and watermarks by their own dates; the slower one holds the watermark."""
    own = footprints.select("tile", F.pmod(F.xxhash64("shot_number"), F.lit(parts)).cast("int").alias("part"), F.col("gedi_date").cast("timestamp").alias("ts"), "shot_number", "row", "col", F.lit(None).cast("string").alias("scene"))
    every = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")
    # no nulls, which would make the numbers floats
    none = [F.lit(-1).cast(t).alias(c) for c, t in (("shot_number", "long"), ("row", "int"), ("col", "int"))]
    theirs = scenes.select("tile", every, F.col("acq_date").cast("timestamp").alias("ts"), *none, "scene")
    rows = [x.where("tile is not null and ts is not null").withWatermark("ts", delay) for x in (own, theirs)]
    return rows[0].unionByName(rows[1])


def parts_of(footprints: int, tiles: int, least: int) -> int:
    """Parts to a tile, so that one holds about HELD of so many footprints."""
    return max(least, -(-footprints // (tiles * HELD)))


def month_floor(days: np.ndarray, back: int) -> np.ndarray:
    """The first day of the month so many months before that of each day."""
    return (days.astype("datetime64[M]") - back).astype("datetime64[D]")


def matcher(wait: int, look_back: int = LOOK_BACK) -> Callable[[tuple, Iterator[pd.DataFrame], GroupState], Iterator[pd.DataFrame]]:
    """The state of a tile's part: its scenes by day, and the footprints that wait ``wait`` days for later deliveries.

    When the watermark has passed a footprint's day by more than that, it is
    given the latest scene that is not after it, and leaves.  A footprint that
    is delivered again while it waits counts once; afterwards it is late and
    dropped by the watermark.  Scenes go when no footprint can need them any
    more.  Footprints without a scene are dropped.
    """

    nobody = (np.zeros(0, np.int64), np.zeros(0, "datetime64[D]"), np.zeros(0, np.int32), np.zeros(0, np.int32))

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        scenes, waiting = pickle.loads(state.get[0]) if state.exists else ({}, nobody)
        parts = [waiting]
        for batch in [] if state.hasTimedOut else batches:
            days, names = batch["ts"].to_numpy().astype("datetime64[D]"), batch["scene"]
            shot = names.isna().to_numpy()
            for day, scene in zip(days[~shot], names[~shot], strict=True):
                scenes[day] = max(scene, scenes.get(day, ""))
            parts.append((batch["shot_number"].to_numpy()[shot].astype(np.int64), days[shot], batch["row"].to_numpy()[shot].astype(np.int32), batch["col"].to_numpy()[shot].astype(np.int32)))
        waiting = tuple(map(np.concatenate, zip(*parts, strict=True)))
        # of a footprint delivered again, the last
        last = len(waiting[0]) - 1 - np.unique(waiting[0][::-1], return_index=True)[1]
        waiting = tuple(x[last] for x in waiting)
        now = np.datetime64(state.getCurrentWatermarkMs(), "ms")
        due = waiting[1] + wait * DAY < now
        if due.any():
            days = np.array(sorted(scenes), "datetime64[D]")
            shots, given, rows, cols = (x[due] for x in waiting)
            at = np.searchsorted(days, given, "right") - 1
            good = (at >= 0) & (days[at] >= month_floor(given, look_back)) if len(days) else np.zeros(len(shots), bool)
            found = at[good]
            dates = lambda x: pd.Series(x.astype("datetime64[s]")).dt.date
            yield pd.DataFrame({"shot_number": shots[good], "tile": key[0], "row": rows[good], "col": cols[good], "gedi_date": dates(given[good]), "scene": np.array([scenes[d] for d in days], object)[found], "acq_date": dates(days[found])})
        waiting = tuple(x[~due] for x in waiting)
        oldest = month_floor(now.astype("datetime64[D]") - wait * DAY, look_back)
        scenes = {d: s for d, s in scenes.items() if d >= oldest}
        if not len(waiting[0]) and not scenes:
            state.remove()
            return
        state.update((pickle.dumps((scenes, waiting)),))
        if len(waiting[0]):
            # a timeout must lie after the watermark, and fires once the watermark has passed it
            first = (waiting[1].min() + wait * DAY).astype("datetime64[ms]").astype(np.int64)
            state.setTimeoutTimestamp(int(max(first, state.getCurrentWatermarkMs() + 1)))

    return step


def matched_stream(footprints: DataFrame, scenes: DataFrame, delay: str = "30 days", wait: int = 0, look_back: int = LOOK_BACK, parts: int = PARTS) -> DataFrame:
    """Footprints ``(shot_number, tile, gedi_date, row, col)`` with the latest of the scenes ``(tile, acq_date, scene)`` that are there when they have waited.

    ``delay`` is how late, behind the newest dates of its stream, a footprint or
    scene may be delivered; later ones are dropped.  ``wait`` days are waited
    beyond that.
    """
    rows = joint_stream(footprints, scenes, delay, parts)
    return rows.groupBy("tile", "part").applyInPandasWithState(matcher(wait, look_back), MATCHED, "held binary", "append", GroupStateTimeout.EventTimeTimeout)


def batch_writer(chunks: DataFrame, path: str, side: int, size: int, height: int, width: int, band: str = "SCL") -> Callable[[DataFrame, int], None]:
    """Cuts the windows of a batch out of chunks that were written once, keeps the vegetated ones, and replaces the folder of the batch's number."""

    def write(batch: DataFrame, number: int) -> None:
        held = batch.persist()
        try:
            patches = extract_patches(held, chunks.where(F.col("band") == band), side, size, height, width)
            rows = held.join(patches.select("tile", "row", "col", "patch"), ["tile", "row", "col"])
            vegetated(rows, "patch", size).select("shot_number", "tile", "scene", "acq_date", "vegetation_score").write.mode("overwrite").parquet(f"{path}/batch={number}")
        finally:
            held.unpersist()

    return write


def run(matched: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Runs the stream over all that is there.  A batch that is tried again replaces its own folder."""
    matched.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
