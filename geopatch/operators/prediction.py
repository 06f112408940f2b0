"""Supplied models over the windows of chunked rasters: tensors in, planes out."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geopatch.operators.mosaic import axis_starts, last_writers, sliding_windows

#: A model maps an array (channels, rows, columns) to a plane (rows, columns), which may be coarser by a fixed factor.
Model = Callable[[np.ndarray], np.ndarray]


def window_pieces(chunks: DataFrame, bands: list[tuple[str, str]], side: int, height: int, width: int, size: int, overlap: int) -> DataFrame:
    """``tile, wr, wc, channel, first, left, rows`` of every window: what each chunk that it touches holds of it, one row a chunk and band.

    Chunks are spread over the windows that touch them, whose numbers follow
    from the chunk's place, so there is no join; only the rows and columns that
    a window needs go on.  Every window has one more row without a channel, so
    that those without any pixel are there too.
    """
    number = F.coalesce(*[F.when((F.col("layer") == layer) & (F.col("band") == band), F.lit(k)) for k, (layer, band) in enumerate(bands)])
    own = chunks.withColumn("channel", number).where("channel is not null")

    def touching(c: str, length: int) -> F.Column:
        starts = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(s).alias("s")) for k, s in enumerate(axis_starts(length, size, overlap))])
        return F.filter(starts, lambda w: (w["s"] < (F.col(c) + 1) * side) & (w["s"] + size > F.col(c) * side))

    met = own.withColumn("_r", F.explode(touching("crow", height))).withColumn("_c", F.explode(touching("ccol", width)))
    first, last = F.greatest(F.col("_r.s"), F.col("crow") * side), F.least(F.col("_r.s") + size, (F.col("crow") + 1) * side) - 1
    left, right = F.greatest(F.col("_c.s"), F.col("ccol") * side), F.least(F.col("_c.s") + size, (F.col("ccol") + 1) * side) - 1
    rows = F.transform(F.sequence(first, last), lambda r: F.slice("data", ((r - F.col("crow") * side) * side + left - F.col("ccol") * side + 1).cast("int"), (right - left + 1).cast("int")))
    pieces = met.select("tile", F.col("_r.k").alias("wr"), F.col("_c.k").alias("wc"), "channel", (first - F.col("_r.s")).alias("first"), (left - F.col("_c.s")).alias("left"), rows.alias("rows"))
    every = sliding_windows(own.select("tile").distinct(), height, width, size, overlap).select("tile", "wr", "wc")
    return pieces.unionByName(every, allowMissingColumns=True)


def tensor(group: pa.Table, channels: int, size: int, fill: float) -> np.ndarray:
    """The window (channels, size, size) of its pieces; missing pixels and bands are ``fill``."""
    out = np.full((channels, size, size), fill, np.float64)
    for channel, first, left, rows in zip(group["channel"].to_pylist(), group["first"].to_pylist(), group["left"].to_pylist(), group["rows"], strict=True):
        if channel is None:
            continue
        values = rows.values.flatten().cast(pa.float64()).fill_null(fill).to_numpy(zero_copy_only=False).reshape(len(rows), -1)
        out[channel, first : first + values.shape[0], left : left + values.shape[1]] = values
    return out


def predict_planes(chunks: DataFrame, bands: list[tuple[str, str]], models: list[Model], side: int, height: int, width: int, size: int, overlap: int, shrink: int = 1, fill: float = 0.0) -> DataFrame:
    """``tile, model, row, left, values``: runs of a tile's mosaicked predictions, model by model (from 1).

    Every window is put together once, as a tensor of its ``bands``, and goes
    through all models.  Of each plane only the pixels that its window writes
    last are kept, before anything is exploded: on each axis they are one run of
    pixels, so runs of rows tile the mosaic without overlap and need no further
    shuffle.  ``shrink`` is the factor by which planes are coarser.  Tiles with
    no chunk of the bands have no rows.
    """
    pieces = window_pieces(chunks, bands, side, height, width, size, overlap)
    down, across = last_writers(height, size, overlap, shrink), last_writers(width, size, overlap, shrink)
    small = -(-size // shrink)
    count = len(bands)

    def run(group: pa.Table) -> pa.Table:
        wr, wc = group["wr"][0].as_py(), group["wc"][0].as_py()
        (place_r, runs_r), (place_c, runs_c) = down[wr], across[wc]
        rows: list[tuple] = []
        if runs_r and runs_c:
            data = tensor(group, count, size, fill)
            for k, model in enumerate(models, 1):
                plane = np.asarray(model(data), np.float64)
                if plane.shape != (small, small):
                    raise ValueError(f"a model gave a plane of {plane.shape}, not {(small, small)}")
                rows += [(k, r, low, plane[r - place_r, low - place_c : high - place_c]) for a, b in runs_r for r in range(a, b) for low, high in runs_c]
        values = pa.array([x[3] for x in rows], pa.list_(pa.float64()))
        tile = pa.array([group["tile"][0].as_py()] * len(rows), group.schema.field("tile").type)
        return pa.Table.from_arrays([tile, *[pa.array([x[i] for x in rows], pa.int32()) for i in range(3)], values], names=["tile", "model", "row", "left", "values"])

    return pieces.groupBy("tile", "wr", "wc").applyInArrow(run, "tile string, model int, row int, left int, values array<double>")


def pixels_of(planes: DataFrame) -> DataFrame:
    """``tile, model, row, col, value`` of runs of predictions."""
    return planes.select("tile", "model", "row", "left", F.posexplode("values").alias("k", "value")).select("tile", "model", "row", (F.col("left") + F.col("k")).alias("col"), "value")


def ensemble_planes(planes: DataFrame) -> DataFrame:
    """``tile, row, left, agb, std``: mean and population deviation over the models of each pixel of a run, undefined values aside.

    All models cut a tile into the same runs, so runs are shuffled and not
    pixels; ``std`` is null for a single model.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            agb, std = [], []
            for runs in batch.column(3):
                stack = np.stack([x.values.to_numpy() for x in runs])
                known = ~np.isnan(stack)
                n = np.maximum(known.sum(0), 1)
                mean = np.where(known, stack, 0).sum(0) / n
                spread = np.sqrt((np.where(known, stack - mean, 0) ** 2).sum(0) / n)
                none = ~known.any(0)
                agb.append(pa.array(mean, mask=none))
                std.append(pa.array(spread, mask=none) if len(stack) > 1 else pa.nulls(len(mean), pa.float64()))
            lists = lambda parts: pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(p) for p in parts])], pa.int32()), pa.concat_arrays(parts) if parts else pa.array([], pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), lists(agb), lists(std)], names=["tile", "row", "left", "agb", "std"])

    runs = planes.groupBy("tile", "row", "left").agg(F.transform(F.array_sort(F.collect_list(F.struct("model", "values"))), lambda x: x["values"]).alias("runs"))
    return runs.mapInArrow(run, "tile string, row int, left int, agb array<double>, std array<double>")


def ensemble_pixels(planes: DataFrame) -> DataFrame:
    """``tile, row, col, agb, std`` of every pixel of the mosaicked runs."""
    runs = ensemble_planes(planes).select("tile", "row", "left", F.posexplode(F.arrays_zip("agb", "std")).alias("k", "p"))
    return runs.select("tile", "row", (F.col("left") + F.col("k")).alias("col"), "p.agb", "p.std")
