"""Operators against hand-computed values and plain Python versions."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from geopatch.functions import arrays, features, geo, names
from geopatch.operators import matching, mosaic, raster, statistics, windows
from geopatch.sources import chunks
from geopatch.streaming import ingest


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


def test_names(spark):
    scene = names.scene_parts(F.lit("S2A_MSIL2A_20220125T100001_N0400_R022_T30NXM_20220125T120000"))
    r = one(spark, scene, names.tile_epsg(F.lit("30NXM")), names.tile_epsg(F.lit("21LAA")), names.offset_flag(F.lit("2022-01-25 00:00:01").cast("timestamp")), names.mission_days(F.lit("2019-04-16").cast("date")), names.tile_name(F.lit(" 30NXM.zip ")))
    assert (r.c0.acq_ts, r.c0.pbn, r.c0.ron, r.c0.tile) == (dt.datetime(2022, 1, 25, 10, 0, 1), 400, 22, "30NXM")
    assert tuple(r)[1:] == (32630, 32721, 1, -1, "30NXM")
    with pytest.raises(Exception, match="no UTM band"):
        one(spark, names.tile_epsg(F.lit("30ZXM")))
    assert one(spark, names.pattern_parts(F.lit("D_O_03_T00123_02_V002"))).c0.asDict() == {"granule_num": 3, "track_num": 123, "ppds": 2, "version_num": 2}
    bad = one(spark, names.scene_parts(F.lit("nonsense"))).c0
    assert bad.acq_ts is None and bad.pbn is None


def test_year_bounds_are_inclusive(spark):
    days = [(d,) for d in (-1, 0, 258, 259, 624, 625)]
    got = lambda y: [r[0] for r in spark.createDataFrame(days, "d int").where(names.in_year(F.col("d"), y)).collect()]
    assert got(2019) == [0, 258]
    assert got(2020) == [259, 624]


def test_projection(spark):
    east = one(spark, geo.utm(F.lit(2.2945), F.lit(48.8582), F.lit(31))).c0
    assert east.easting == pytest.approx(448251.795, abs=0.01) and east.northing == pytest.approx(5411932.678, abs=0.01)
    south = one(spark, geo.utm(F.lit(-60.0), F.lit(-0.001), F.lit(20), True)).c0
    assert 9_999_800 < south.northing < 10_000_000


def test_coordinates_come_back(spark):
    rows = spark.createDataFrame([(x,) for x in (-12.25, 3.5, 0.125, -0.5, 7.0)], "x double").withColumn("p", geo.split_coordinate(F.col("x")))
    for r in rows.withColumn("y", geo.join_coordinate(F.col("p.fraction"), F.col("p.whole"))).collect():
        assert r.y == (0.0 if r.x == 7.0 else r.x)


def test_pixel_rows_run_south(spark):
    at = lambda legacy: one(spark, geo.pixel_coordinate(F.lit(10.0), F.lit(20.0), F.lit(0), F.lit(1), 3, legacy)).c0.lat
    assert at(False) > 10 > at(True)


def test_polygon_boundary_counts(spark):
    ring = F.array(*[F.struct(F.lit(float(x)).alias("lon"), F.lit(float(y)).alias("lat")) for x, y in ((0, 0), (4, 0), (4, 4), (2, 1), (0, 4))])
    points = {(1, 0.5): True, (2, 1): True, (2, 2): False, (0, 2): True, (4, 4): True, (5, 1): False, (3, 2.5): True, (3.5, 1): True, (2, -0.1): False, (0, 5): False}
    df = spark.createDataFrame([(float(x), float(y)) for x, y in points], "lon double, lat double").select("lon", "lat", matching.in_ring(F.col("lon"), F.col("lat"), ring).alias("inside"))
    assert {(r.lon, r.lat): r.inside for r in df.collect()} == {(float(x), float(y)): v for (x, y), v in points.items()}


def test_asof_against_a_loop(spark):
    rng = random.Random(1)
    day = lambda: dt.date(2020, 1, 1) + dt.timedelta(rng.randrange(500))
    scenes = [(rng.choice("AB"), day(), f"s{k}") for k in range(40)] + [("A", dt.date(2020, 5, 5), "x1"), ("A", dt.date(2020, 5, 5), "x2")]
    points = [(k, rng.choice("ABC"), day()) for k in range(120)] + [(900, None, dt.date(2020, 5, 5)), (901, "A", None)]
    df = matching.asof_join(spark.createDataFrame(points, "k int, tile string, gedi_date date"), spark.createDataFrame(scenes, "tile string, acq_date date, scene string"))
    got = {r.k: r.scene for r in df.collect()}
    for k, tile, d in points:
        near = [(a, s) for t, a, s in scenes if d and t == tile and a <= d and (d.year - a.year) * 12 + d.month - a.month <= 5]
        assert got[k] == (max(near)[1] if near else None)


@pytest.mark.parametrize("side", [4, 7, 16])
def test_windows_across_chunks(spark, side):
    grid = np.arange(20 * 20).reshape(20, 20)
    pixels = spark.createDataFrame([("S2", "B", "t", r, c, int(grid[r, c])) for r in range(20) for c in range(20)], "layer string, band string, tile string, row int, col int, value int")
    points = spark.createDataFrame([("t", r, c) for r, c in ((2, 2), (1, 5), (17, 17), (10, 11), (18, 3), (10, 11))], "tile string, row int, col int")
    got = {(r.row, r.col): r.patch for r in windows.extract_patches(points, chunks.to_chunks(pixels, side), side, 5, 20, 20).collect()}
    assert got == {(r, c): grid[r - 2 : r + 3, c - 2 : c + 3].ravel().tolist() for r, c in ((2, 2), (17, 17), (10, 11))}


def test_scores(spark):
    r = one(spark, *[arrays.vegetation_score(F.array(*map(F.lit, a)), 3) for a in ([4] * 9, [4, 4, 4, 4, 6, 4, 4, 4, 4], [6, 6, 6, 6, 4, 4, 6, 6, 6])], arrays.validity_score(F.array(*map(F.lit, [255] * 4 + [1] + [255] * 4)), 3, 255))
    assert tuple(r) == (100, 0, 22, 11)


def test_gradients(spark):
    rng = np.random.default_rng(2)
    dem = rng.normal(size=(6, 6)) * 100
    got = one(spark, arrays.slope_aspect(F.array(*map(F.lit, map(float, dem.ravel()))), 6)).c0
    px, py = np.gradient(dem, 10)
    turn = np.pi / 2 - np.arctan2(py, px)
    assert np.allclose([x.slope for x in got], np.hypot(px, py).ravel())
    assert np.allclose([x.aspect_cos for x in got], ((np.cos(turn) + 1) / 2).ravel())


def test_encoding_of_predictions(spark):
    values = [-3.0, 2.9, 65535.0, 65536.0, math.inf, -math.inf, math.nan, None]
    rows = spark.createDataFrame([(v,) for v in values], "x double").select(features.encode_prediction(F.col("x")).alias("y"))
    assert [r.y for r in rows.collect()] == [0, 2, 65535, 65535, 65535, 0, 65535, 65535]


def test_presets_have_as_many_features_as_the_formula():
    assert {n: len(features.preset(n)) for n in ("all", "ch", "RGBN", "S2", "S2ALOS", "S2DEM", "S2LC", "S2LCDEMALOS")} == {"all": 24, "ch": 6, "RGBN": 8, "S2": 16, "S2ALOS": 18, "S2DEM": 17, "S2LC": 19, "S2LCDEMALOS": 22}
    with pytest.raises(ValueError):
        features.normalize(F.lit(1.0), {}, "unheard of", F.lit(0))


@pytest.mark.parametrize(("length", "size", "overlap", "shrink"), [(64, 20, 8, 1), (64, 20, 6, 1), (100, 20, 10, 1), (50, 50, 10, 1), (60, 40, 10, 1), (150, 50, 20, 5)])
def test_winner_is_the_last_writer(spark, length, size, overlap, shrink):
    to, small, step = -(-size // shrink), -(-overlap // shrink), size - overlap
    count, margin = length // shrink, overlap // (2 * shrink)
    want, regular = [None] * count, list(range(0, length - size + 1, step))
    off = 0
    for k, p in zip(range(len(regular)), range(0, count - to + 1, to - small), strict=False):
        off = 0 if k == 0 else margin
        want[p + off : p + to] = [k] * (to - off)
    if (length - overlap) % step:
        want[count - to + off :] = [len(regular)] * (to - off)
    got = spark.range(count).select("id", mosaic.winner(F.col("id"), length, size, overlap, shrink).alias("w")).orderBy("id").collect()
    assert [r.w for r in got] == want


def test_weights_divide_by_rows_unless_asked(spark):
    df = spark.createDataFrame([(1.0, 0.0, 2.0), (3.0, 0.0, 1.0)], "p double, t double, w double")
    plain, shared = (df.agg(*statistics.error_aggregates(F.col("p"), F.col("t"), F.col("w"), n)).first() for n in (False, True))
    assert plain.me == 2.5 and shared.me == pytest.approx(5 / 3)


def test_subset_keeps_the_distribution(spark):
    rows = spark.range(4000).select(F.col("id").alias("shot_number"), (F.col("id") % 3).cast("string").alias("tile"), F.when(F.col("id") % 7 < 4, 20).otherwise(F.col("id") % 5).alias("biome"))
    subset = statistics.representative_subset(rows, 0.05)
    counts = {r.tile: r["count"] for r in subset.groupBy("tile").count().collect()}
    assert all(abs(n - 4000 / 3 * 0.05) <= 1 for n in counts.values())
    assert all(r.distance < 0.05 for r in statistics.subset_distance(rows, subset).collect())


def test_patch_dataset_without_the_optional_flag(spark, tmp_path):
    rows = spark.createDataFrame([(1, 2020, "t"), (2, 2021, "u")], "shot_number long, year int, tile string")
    chunks.write_patches(rows, str(tmp_path / "p"), ["year", "tile"])
    back = chunks.read_patches(spark, str(tmp_path / "p"), F.col("year") == 2021).collect()
    assert [(r.shot_number, r.boa_offset) for r in back] == [(2, 0)]


def test_list_files(spark, tmp_path):
    (tmp_path / "tiles.txt").write_text("30NXM\n 31UDQ.zip \n\n")
    assert sorted(r.tile for r in chunks.read_tile_list(spark, str(tmp_path / "tiles.txt")).collect()) == ["30NXM", "31UDQ"]


def test_shots_delivered_twice_are_appended_once(spark, tmp_path):
    rows = [(1, dt.datetime(2020, 3, 1), "A", dt.date(2020, 3, 1)), (1, dt.datetime(2020, 3, 2), "A", dt.date(2020, 3, 1)), (2, dt.datetime(2020, 3, 3), "A", dt.date(2020, 3, 3)), (3, dt.datetime(2020, 3, 3), "B", dt.date(2020, 3, 3))]
    schema = "shot_number long, shot_ts timestamp, tile string, gedi_date date"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    scenes = spark.createDataFrame([("A", dt.date(2020, 2, 20), "s")], "tile string, acq_date date, scene string")
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    got = ingest.run_once(spark, stream, scenes, str(tmp_path / "out")).collect()
    assert sorted((r.shot_number, r.scene) for r in got) == [(1, "s"), (2, "s")]


def test_quantiles_are_numpys(spark):
    rng = np.random.default_rng(4)
    values = {g: rng.integers(0, 30, n) for g, n in (("a", 1), ("b", 7), ("c", 400))}
    df = spark.createDataFrame([(g, int(x)) for g, own in values.items() for x in own], "g string, x int")
    got = {r.g: r for r in statistics.band_stats(df, ["g"], "x").collect()}
    for g, own in values.items():
        assert (got[g].p1, got[g].p99) == pytest.approx(tuple(np.percentile(own, [1, 99])))
        assert (got[g].mean, got[g].std, got[g].min, got[g].max) == pytest.approx((own.mean(), own.std(), own.min(), own.max()))
    assert statistics.band_stats(df.where("x < 0"), ["g"], "x").count() == 0


@pytest.mark.parametrize("span", [1 << 40, 17])
def test_subset_takes_the_first_of_each_biome(spark, span):
    order = F.pmod(F.xxhash64("shot_number"), F.lit(span))
    rows = spark.range(3000).select(F.col("id").alias("shot_number"), F.lit("t").alias("tile"), (F.col("id") % 3).alias("biome"), order.alias("o"))
    ranked = sorted((r.biome, r.o, r.shot_number) for r in rows.collect())
    got = {(r.biome, r.o, r.shot_number) for r in statistics.representative_subset(rows, 0.1, order=order, span=span).collect()}
    assert got == {x for b in range(3) for x in [y for y in ranked if y[0] == b][:100]}


def test_far_holes_take_the_nearest_value(spark):
    rng = random.Random(9)
    for _ in range(4):
        a = [rng.choice([0, 0, 0, 0, rng.randint(1, 99)]) for _ in range(30)]
        want = [v or min([((k // 6 - j // 6) ** 2 + (k % 6 - j % 6) ** 2, j // 6, j % 6, w) for j, w in enumerate(a) if w], default=(0, 0, 0, 0))[3] for k, v in enumerate(a)]
        assert raster.nearest_fill(spark.createDataFrame([(a,)], "a array<int>"), "a", 6, 0).first().a == want


@pytest.mark.parametrize("order", [0, 1])
def test_rasters_are_aligned_by_their_corners(spark, order):
    grid = np.arange(1, 65).reshape(8, 8)
    for left, top, step in ((0, 0, 20), (-20, 10, 20), (15, -5, 30)):
        got = one(spark, arrays.aligned(F.array(*map(F.lit, grid.ravel().tolist())), 8, 8, (F.lit(float(left)), F.lit(float(top)), float(step)), (0.0, 0.0, 10.0, 12, 12), F.lit(0), order)).c0
        rows, cols = [math.floor((top - y) / step) for y in (-5, -115)], [math.floor((x - left) / step) for x in (5, 115)]
        cut = np.array([[grid[r, c] if 0 <= r < 8 and 0 <= c < 8 else 0 for c in range(cols[0], cols[1] + 1)] for r in range(rows[0], rows[1] + 1)])
        at = lambda n: np.clip(np.floor((np.arange(12) + 0.5) * n / 12).astype(int), 0, n - 1)
        holes = cut[np.ix_(at(cut.shape[0]), at(cut.shape[1]))]
        if not order:
            assert got == holes.ravel().tolist()
        else:
            assert all((g == 0) == (h == 0) for g, h in zip(got, holes.ravel(), strict=True)) and max(got) <= cut.max()


def test_infinite_values_are_not_resampled(spark):
    a = F.array(F.lit(1.0), F.lit(math.inf), F.lit(2.0), F.lit(3.0))
    with pytest.raises(Exception, match="infinite"):
        one(spark, arrays.resampled(a, a, 2, 2, 4, 4, F.lit(0.0), 1))


def test_windows_of_pixels(spark):
    pixels = spark.createDataFrame([("t", r, c) for r in range(20) for c in (0, 9, 19)], "tile string, row int, col int")
    got = sorted((r.row, r.col, r.wr, r.wc) for r in mosaic.windows_of(pixels, 20, 20, 8, 2).collect())
    starts = mosaic.axis_starts(20, 8, 2)
    assert got == sorted((r, c, i, j) for r in range(20) for c in (0, 9, 19) for i, s in enumerate(starts) if s <= r < s + 8 for j, z in enumerate(starts) if z <= c < z + 8)


def test_too_many_classes_are_refused(spark, tmp_path, monkeypatch):
    spark.range(5).selectExpr("0.5 dim0", "0.5 dim1", "0.5 dim2", "0.5 dim3", "0.5 dim4", "cast(id as int) mapping").write.csv(str(tmp_path / "e"), header=True)
    assert len(chunks.read_embeddings(spark, str(tmp_path / "e"))) == 5
    monkeypatch.setattr(chunks, "MOST_CLASSES", 4)
    with pytest.raises(ValueError):
        chunks.read_embeddings(spark, str(tmp_path / "e"))


def test_radar_of_the_year(spark):
    points = spark.createDataFrame([(1, "t", 0, 0, dt.date(2020, 5, 1)), (2, "t", 0, 0, dt.date(2021, 5, 1)), (3, "u", 0, 0, dt.date(2020, 5, 1))], "id int, tile string, row int, col int, day date")
    layer = spark.createDataFrame([("t", "20", 0, 0, 7), ("t", "19", 0, 0, 8), ("u", "19", 0, 0, 9)], "tile string, yy string, row int, col int, hh int")
    got = {r.id: r.hh for r in matching.with_year_layer(points, layer, F.col("day"), ["hh"]).collect()}
    assert got == {1: 7, 2: 0, 3: 0}
