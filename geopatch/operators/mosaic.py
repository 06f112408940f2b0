"""Overlapping windows over a tile, and what their predictions make together."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geopatch.functions.features import encode_prediction
from geopatch.operators.boosting import Model, predict
from geopatch.schema import SNOW, WATER


def axis_starts(length: int, size: int, overlap: int) -> list[int]:
    """Starts of the windows on one axis: equal steps, then one flush with the edge if they do not fill it."""
    step = size - overlap
    starts = list(range(0, length - size + 1, step))
    return starts if (length - overlap) % step == 0 else [*starts, length - size]


def sliding_windows(tiles: DataFrame, height: int, width: int, size: int, overlap: int) -> DataFrame:
    """``tile, wr, wc, top, left`` of every window of every tile."""

    def axis(length: int, k: str, start: str) -> Column:
        return F.posexplode(F.array(*map(F.lit, axis_starts(length, size, overlap)))).alias(k, start)

    return tiles.select("tile", axis(height, "wr", "top")).select("tile", "wr", "top", axis(width, "wc", "left"))


def windows_of(pixels: DataFrame, height: int, width: int, size: int, overlap: int) -> DataFrame:
    """Pixels ``(tile, row, col, ..)`` with ``wr, wc`` of every window that holds them, a row each."""

    def holding(c: str, length: int) -> Column:
        starts = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(s).alias("s")) for k, s in enumerate(axis_starts(length, size, overlap))])
        return F.transform(F.filter(starts, lambda w: (F.col(c) >= w["s"]) & (F.col(c) < w["s"] + size)), lambda w: w["k"])

    return pixels.withColumn("wr", F.explode(holding("row", height))).withColumn("wc", F.explode(holding("col", width)))


def writes(length: int, size: int, overlap: int, shrink: int = 1) -> list[tuple[int, int, int, int]]:
    """``window, place, first, end`` of what each window of an axis writes, in the order of writing.

    Each window writes all but a margin of half the overlap, except that the
    first one has none.  ``shrink`` is the factor by which predictions are
    coarser than the input; place is where the window's own prediction begins.
    """
    to, small = -(-size // shrink), -(-overlap // shrink)
    starts = axis_starts(length, size, overlap)
    flush = (length - overlap) % (size - overlap) != 0
    places = [i * (to - small) for i in range(len(starts))]
    if flush:
        places[-1] = length // shrink - to
    margin = overlap // (2 * shrink)
    offsets = [0 if i == 0 else margin for i in range(len(places))]
    if flush and len(places) > 1:
        offsets[-1] = margin if len(places) > 2 else 0
    return [(i, p, p + o, p + to) for i, (p, o) in enumerate(zip(places, offsets, strict=True))]


def winner(pixel: Column, length: int, size: int, overlap: int, shrink: int = 1) -> Column:
    """The number of the window that last writes a pixel of an axis, null if none does.  Windows later in the list win."""
    return F.coalesce(*[F.when((pixel >= low) & (pixel < high), F.lit(i)) for i, _, low, high in reversed(writes(length, size, overlap, shrink))])


def last_writers(length: int, size: int, overlap: int, shrink: int = 1) -> list[tuple[int, list[tuple[int, int]]]]:
    """For each window of an axis its place, and the runs ``first, end`` of pixels that it writes last (one, or two around a later window)."""
    windows = writes(length, size, overlap, shrink)
    out = []
    for i, place, low, high in windows:
        own = [k for k in range(max(low, 0), high) if not any(a <= k < b for j, _, a, b in windows if j > i)]
        edges = [k for k in own if k - 1 not in own]
        out.append((place, [(k, next(e for e in range(k, high + 1) if e not in own)) for k in edges]))
    return out


def mosaic(predicted: DataFrame, height: int, width: int, size: int, overlap: int) -> DataFrame:
    """``tile, model, row, col, value`` of window predictions ``(tile, model, wr, wc, row, col, value)``: the last writer of each pixel.

    The two axes are independent, so a prediction is kept if and only if its
    window is the winner on both: a filter, without a shuffle.
    """
    own = (F.col("wr") == winner(F.col("row"), height, size, overlap)) & (F.col("wc") == winner(F.col("col"), width, size, overlap))
    return predicted.where(own).select("tile", "model", "row", "col", "value")


def ensemble(rows: DataFrame) -> DataFrame:
    """``tile, row, col, agb, std``: mean and population deviation over the models, undefined values aside; std only for more than one model."""
    value = F.when(~F.isnan("value"), F.col("value"))
    return rows.groupBy("tile", "row", "col").agg(F.avg(value).alias("agb"), F.when(F.min("model") < F.max("model"), F.stddev_pop(value)).alias("std"))


def masked(rows: DataFrame, scl: str = "scl") -> DataFrame:
    """Predictions with water and snow pixels as null, encoded."""
    clear = ~F.col(scl).isin(WATER, SNOW)
    return rows.withColumns({c: encode_prediction(F.when(clear, F.col(c))) for c in ("agb", "std") if c in rows.columns})


def predict_pixels(models: list[Model], pixels: DataFrame) -> DataFrame:
    """``tile, model, wr, wc, row, col, value``: every pixel of every window by every fitted model (models from 1)."""
    names = [f"_p{k}" for k in range(1, len(models) + 1)]
    made = predict(models, pixels, names)
    each = F.inline(F.array(*[F.struct(F.lit(k).alias("model"), F.col(c).alias("value")) for k, c in enumerate(names, 1)]))
    return made.select("tile", "wr", "wc", "row", "col", each)


def predict_windows(windows: DataFrame, fn: Callable[[np.ndarray], np.ndarray], column: str, name: str = "value") -> DataFrame:
    """Windows with a supplied model's prediction, which maps stacked arrays, one a row, to a vector, in Arrow batches."""
    fields = ", ".join(f"`{c}` {t}" for c, t in windows.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield batch.assign(**{name: np.asarray(fn(np.stack(batch[column].to_numpy())), np.float64)})

    return windows.mapInPandas(run, f"{fields}, `{name}` double")
