"""Chunked rasters, holes, alignment, windows to planes, and polygons of very different sizes, against plain versions."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from geopatch.functions import arrays
from geopatch.operators import matching, mosaic, prediction, raster
from geopatch.sources import chunks

PIXELS = "layer string, band string, tile string, row int, col int, value int"


def pixels_of(spark, grid, layer="S2", band="B", tile="t"):
    return spark.createDataFrame([(layer, band, tile, r, c, int(grid[r, c])) for r in range(grid.shape[0]) for c in range(grid.shape[1])], PIXELS)


def test_chunks_with_gaps_and_repeated_pixels(spark):
    rows = [("S2", "B", "t", r, c, 10 * r + c) for r, c in ((0, 1), (1, 0), (1, 2), (2, 2), (3, 3), (5, 4))] + [("S2", "B", "t", 1, 0, 7), ("S2", "B", "t", 1, 0, 12)]
    got = {(r.crow, r.ccol): r.data for r in chunks.to_chunks(spark.createDataFrame(rows, PIXELS), 3).collect()}
    assert got == {(0, 0): [None, 1, None, 12, None, 12, None, None, 22], (1, 1): [33, None, None, None, None, None, None, 54, None]}


def test_a_usual_chunk_is_quick(spark):
    df = spark.range(256 * 256, numPartitions=2).select(F.lit("S2").alias("layer"), F.lit("B").alias("band"), F.lit("t").alias("tile"), (F.col("id") / 256).cast("int").alias("row"), (F.col("id") % 256).cast("int").alias("col"), F.col("id").cast("int").alias("value"))
    began = time.time()
    for kept, size in (("true", 65536), ("id % 7 > 0", 65536)):
        data = chunks.to_chunks(df.where(kept.replace("id", "value")), 256).first().data
        assert len(data) == size and data[257] == 257 and data[-1] in (65535, None)
    assert time.time() - began < 20


def test_nearest_valid_with_ties():
    rng = np.random.default_rng(4)
    for h, w, share in ((1, 1, 0.5), (5, 7, 0.2), (9, 4, 0.1), (16, 16, 0.03), (12, 20, 0.5)):
        for _ in range(10):
            valid = rng.random((h, w)) < share
            spots = np.argwhere(valid).tolist()
            want = [[min(((a - r) ** 2 + (b - c) ** 2, a, b) for a, b in spots)[1:] if spots else None for c in range(w)] for r in range(h)]
            assert raster.nearest_valid(valid).tolist() == [[p[0] * w + p[1] if p else -1 for p in row] for row in want]
    began = time.time()
    for valid in (rng.random((512, 512)) < 0.001, np.pad(np.ones((512, 1), bool), ((0, 0), (0, 511)))):
        raster.nearest_valid(valid)
    assert time.time() - began < 5


def test_fill_keeps_other_columns_and_null_arrays(spark):
    rows = spark.createDataFrame([(1, [0, 5, 0, 0], "a"), (2, None, "b"), (3, [0, 0, 0, 0], "c"), (4, [0, None, 9, 1], None)], "k int, a array<int>, name string")
    assert sorted(map(tuple, raster.nearest_fill(rows, "a", 2, 0).collect())) == [(1, [5, 5, 5, 5], "a"), (2, None, "b"), (3, [0, 0, 0, 0], "c"), (4, [9, 1, 9, 1], None)]


@pytest.mark.parametrize("order", [0, 1])
@pytest.mark.parametrize(("side", "to_side"), [(4, 5), (7, 16), (32, 9)])
def test_alignment_by_chunks_equals_the_whole_raster(spark, side, to_side, order):
    rng = np.random.default_rng(5)
    grid = rng.integers(1, 50, (17, 19)) * (rng.random((17, 19)) < 0.8)
    places = [("t", -30.0, 20.0), ("u", 15.0, -40.0)]
    rows = pixels_of(spark, grid).unionByName(pixels_of(spark, grid, tile="u"))
    tiles = spark.createDataFrame(places, "tile string, left double, top double")
    made = raster.align(chunks.to_chunks(rows, side), side, tiles, raster.Grid(F.col("left"), F.col("top"), 25.0), raster.Grid(0.0, 0.0, 10.0), 41, 37, to_side, 0, order)
    assert made.select(F.max(F.size("data"))).first()[0] == to_side**2
    whole = spark.createDataFrame([(t, x, y, grid.ravel().tolist()) for t, x, y in places], "tile string, left double, top double, data array<int>")
    value = arrays.aligned(F.col("data"), 17, 19, (F.col("left"), F.col("top"), 25.0), (0.0, 0.0, 10.0, 41, 37), F.lit(0), order)
    want = {(r.tile, r.k // 37, r.k % 37): r.value for r in whole.select("tile", F.posexplode(value).alias("k", "value")).collect()}
    got = {(r.tile, r.row, r.col): r.value for r in chunks.to_pixels(made, to_side).collect()}
    assert got.keys() == want.keys()
    assert np.allclose([got[k] for k in want], [float(want[k]) for k in want])


def mosaicked_plainly(img, models, size, overlap, shrink):
    """Window by window into one plane, in the order of the loops."""
    height, width = img.shape[1:]
    out = np.full((len(models), height // shrink, width // shrink), np.nan)
    down, across = (mosaic.writes(n, size, overlap, shrink) for n in (height, width))
    for i, p, low, high in down:
        for j, q, left, right in across:
            y, x = mosaic.axis_starts(height, size, overlap)[i], mosaic.axis_starts(width, size, overlap)[j]
            for k, model in enumerate(models):
                out[k, low:high, left:right] = model(img[:, y : y + size, x : x + size])[low - p :, left - q :]
    return out


@pytest.mark.parametrize(("side", "height", "width", "size", "overlap", "shrink"), [(8, 30, 44, 20, 8, 1), (50, 50, 50, 20, 10, 5), (16, 64, 40, 40, 20, 5)])
def test_planes_equal_a_loop_over_windows(spark, side, height, width, size, overlap, shrink):
    rng = np.random.default_rng(6)
    img = rng.integers(0, 100, (2, height, width)).astype(float)

    def first(x):
        return x[0, ::shrink, ::shrink] + x[1].sum()

    def second(x):
        plane = x.sum(0)[::shrink, ::shrink] + x[0, 0, 0]
        return np.where(plane > 150, np.nan, plane)

    rows = pixels_of(spark, img[0], band="a").unionByName(pixels_of(spark, img[1], "CH", "b"))
    planes = prediction.predict_planes(chunks.to_chunks(rows, side), [("S2", "a"), ("CH", "b")], [first, second], side, height, width, size, overlap, shrink)
    want = mosaicked_plainly(img, [first, second], size, overlap, shrink)
    got = np.full_like(want, np.inf)
    for r in prediction.pixels_of(planes).collect():
        assert got[r.model - 1, r.row, r.col] == np.inf
        got[r.model - 1, r.row, r.col] = r.value
    assert np.array_equal(np.where(np.isinf(got), np.nan, got), want, equal_nan=True)
    together = {(r.row, r.col): (r.agb, r["std"]) for r in prediction.ensemble_pixels(planes).collect()}
    for r, c in np.argwhere(~np.isnan(want[0])):
        known = want[:, r, c][~np.isnan(want[:, r, c])]
        assert together[r, c] == pytest.approx((known.mean(), known.std()))


def test_a_model_with_a_wrong_plane_is_refused(spark):
    rows = chunks.to_chunks(pixels_of(spark, np.ones((8, 8))), 8)
    with pytest.raises(Exception, match="a model gave a plane of"):
        prediction.predict_planes(rows, [("S2", "B")], [lambda x: x[0, 1:]], 8, 8, 8, 8, 2).collect()


def test_polygons_of_very_different_sizes(spark, monkeypatch):
    star = [(0.0, 0.0), (40.0, 0.0), (40.0, 40.0), (20.0, 10.0), (0.0, 40.0)]
    slit = [(-60.0, -60.0), (60.0, -60.0), (60.0, 60.0), (-60.0, 60.0), (-60.0, 0.1), (50.0, 0.1), (50.0, -0.1), (-60.0, -0.1)]
    small = [[(x, y), (x + 0.4, y), (x + 0.4, y + 0.3), (x, y + 0.3)] for x in (1.0, 7.3, -33.0) for y in (2.0, 11.9, -5.5)]
    rings = {"star": star, "slit": slit} | {f"small{k}": [(float(a), float(b)) for a, b in r] for k, r in enumerate(small)}
    tiles = spark.createDataFrame([(n, [{"lon": a, "lat": b} for a, b in r], min(p[0] for p in r), max(p[0] for p in r), min(p[1] for p in r), max(p[1] for p in r)) for n, r in rings.items()], "tile string, ring array<struct<lon:double,lat:double>>, min_lon double, max_lon double, min_lat double, max_lat double")
    rng = random.Random(8)
    spots = [(rng.uniform(-70, 70), rng.uniform(-70, 70)) for _ in range(1500)] + [(1.2, 2.1), (20.0, 10.0), (0.0, 0.0), (0.0, 0.05), (40.0, 20.0), (1.4, 2.3), (60.0, 60.0)]
    points = spark.createDataFrame([(k, x, y, "own") for k, (x, y) in enumerate(spots)], "id int, lon double, lat double, level string").drop("level")
    every = points.crossJoin(F.broadcast(tiles)).where(matching.in_ring(F.col("lon"), F.col("lat"), F.col("ring")))
    want = sorted((r.id, r.tile) for r in every.select("id", "tile").collect())
    assert max(r[1] for r in matching.covered(tiles, 0.3).groupBy("tile").count().collect()) <= (matching.CELLS_ACROSS + 1) ** 2
    assert matching.covered(tiles, 0.3).where("inner").count() > 0
    for size in (8 << 20, 0):
        monkeypatch.setattr(matching, "BROADCAST_BYTES", size)
        assert sorted((r.id, r.tile) for r in matching.spatial_join(points, tiles).select("id", "tile").collect()) == want
    assert matching.spatial_join(points, tiles.limit(0)).count() == 0
