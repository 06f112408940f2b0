"""Files in spatial order, XML metadata, listings, sketches, losses and the waiting stream."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.ml.tuning import ParamGridBuilder, TrainValidationSplit
from pyspark.sql import functions as F

from geopatch.operators import losses, matching, statistics
from geopatch.sources import catalog, chunks
from geopatch.streaming import waiting


def test_ranges_hold_their_box_and_little_else(spark):
    rng = random.Random(3)
    for most in (4, 64):
        for _ in range(30):
            west, south = rng.uniform(-180, 170), rng.uniform(-90, 80)
            box = (west, west + rng.uniform(0.001, 10), south, south + rng.uniform(0.001, 10))
            ranges = catalog.box_ranges(*box, most)
            assert len(ranges) <= most + 4 and all(a[1] < b[0] for a, b in zip(ranges, ranges[1:]))
            points = [(rng.uniform(box[0], box[1]), rng.uniform(box[2], box[3])) for _ in range(20)] + [(x, y) for x in box[:2] for y in box[2:]]
            z = [r[0] for r in spark.createDataFrame(points, "lon double, lat double").select(catalog.spatial_order(F.col("lon"), F.col("lat"))).collect()]
            assert all(any(a <= p <= b for a, b in ranges) for p in z)
            assert sum(b - a + 1 for a, b in ranges) <= 0.1 * 2**32
    assert catalog.box_ranges(-180, 180, -90, 90) == [(0, 2**32 - 1)]


def test_a_small_box_reads_few_rows(spark, tmp_path):
    rows = spark.range(60_000).select(F.col("id"), (F.rand(1) * 360 - 180).alias("lon"), (F.rand(2) * 180 - 90).alias("lat"), F.sha2(F.col("id").cast("string"), 256).alias("name"))
    rows.write.parquet(str(tmp_path / "plain"))
    plain = spark.read.parquet(str(tmp_path / "plain"))
    catalog.write_footprints(plain, str(tmp_path / "z"), 6, 1 << 18)
    box = (10.0, 25.0, -30.0, -10.0)
    got = catalog.read_box(spark, str(tmp_path / "z"), *box)
    want = plain.where(F.col("lon").between(*box[:2]) & F.col("lat").between(*box[2:]))
    assert got.columns == plain.columns
    assert sorted(r.id for r in got.collect()) == sorted(r.id for r in want.collect())
    leaf = got._jdf.queryExecution().executedPlan().collectLeaves().head()
    assert leaf.metrics().get("numOutputRows").get().value() < 60_000 / 6
    assert "GreaterThanOrEqual(z," in leaf.toString()


def test_metadata_of_products_with_and_without_offsets(spark, tmp_path):
    bands = lambda *offsets: [{"id": k, "band": b, "offset": o} for k, (b, o) in enumerate(zip(("B1", "B8A", "B12"), offsets))]
    rows = spark.createDataFrame([("old", 10000.0, bands(None, None, None)), ("new", 10000.0, bands(1000, 1000, -7)), ("one", 1.0, bands(None, 5, None)), ("none", 1.0, [])], "scene string, quantification double, bands array<struct<id:int,band:string,offset:bigint>>")
    catalog.write_metadata(rows, str(tmp_path / "xml"))
    got = {(r.scene, r.band): (r.quantification, r.offset) for r in catalog.read_metadata(spark, str(tmp_path / "xml")).collect()}
    assert got == {("old", b): (10000.0, None) for b in ("B01", "B8A", "B12")} | {("new", "B01"): (10000.0, 1000), ("new", "B8A"): (10000.0, 1000), ("new", "B12"): (10000.0, -7), ("one", "B01"): (1.0, None), ("one", "B8A"): (1.0, 5), ("one", "B12"): (1.0, None)}


def test_only_folders_of_the_months_and_tiles_are_listed(spark, tmp_path):
    scenes = [(f"s{k}", f"202{k % 2}-0{1 + k % 3}", f"T{k % 4}") for k in range(24)]
    catalog.write_products(spark.createDataFrame(scenes, "scene string, month string, tile string"), str(tmp_path / "p"))
    found = catalog.list_products(spark, str(tmp_path / "p"), ["2020-01", "2021-02"], ["T1", "T2"])
    assert sorted((r.scene, r.month, r.tile) for r in found.collect()) == sorted(x for x in scenes if x[1] in ("2020-01", "2021-02") and x[2] in ("T1", "T2"))
    files = found.inputFiles()
    assert files and all(("month=2020-01" in f or "month=2021-02" in f) and ("tile=T1" in f or "tile=T2" in f) for f in files)
    assert "content" not in found._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[-1]


def test_sketches_merge_within_their_error(spark, tmp_path):
    rng = np.random.default_rng(1)
    values = {(y, t): rng.gamma(2 + t, 50, 3000 + 500 * t) for y in (2019, 2020, 2021) for t in range(3)}
    rows = spark.createDataFrame([(y, f"t{t}", float(v)) for (y, t), own in values.items() for v in own] + [(2019, "t0", None), (2019, "t0", float("nan"))], "year int, tile string, x double")
    path = str(tmp_path / "s")
    statistics.sketches(rows, ["year", "tile"], "x", 400).write.partitionBy("year").parquet(path)
    shares = {"p1": 0.01, "p50": 0.5, "p99": 0.99}
    for years in ([2019, 2020, 2021], [2020]):
        parts = spark.read.parquet(path).where(F.col("year").isin(years))
        got = statistics.merged_stats(parts, [], shares, 400).first()
        own = np.concatenate([v for (y, _), v in values.items() if y in years])
        assert (got.n, got.mean, got["std"], got["min"], got["max"]) == pytest.approx((len(own), own.mean(), own.std(), own.min(), own.max()))
        for name, p in shares.items():
            assert abs((own <= got[name]).mean() - p) < 0.02
    before = statistics.merged_stats(spark.read.parquet(path), [], shares, 400).first().n
    added = rows.where("year = 2021").withColumn("year", F.lit(2022))
    statistics.sketches(added, ["year", "tile"], "x", 400).write.mode("append").partitionBy("year").parquet(path)
    assert statistics.merged_stats(spark.read.parquet(path), [], shares, 400).first().n == before + added.count()


def test_losses_choose_models(spark):
    rng = np.random.default_rng(2)
    x = rng.random(600)
    y = 100 * x + rng.normal(size=600)
    rows = [(float(a), float(b), 1.0) for a, b in zip(x, y)]
    df = VectorAssembler(inputCols=["x"], outputCol="features").transform(spark.createDataFrame(rows, "x double, y double, w double"))
    line = LinearRegression(labelCol="y")
    grid = ParamGridBuilder().addGrid(line.regParam, [0.0, 500.0]).build()
    for kwargs in ({"loss": "rmse"}, {"loss": "me"}, {"loss": "mae", "weightCol": "w"}, {"loss": "mse", "binWidth": 10.0}):
        evaluator = losses.LossEvaluator(labelCol="y", **kwargs)
        assert isinstance(evaluator, Evaluator) and not evaluator.isLargerBetter()
        model = TrainValidationSplit(estimator=line, estimatorParamMaps=grid, evaluator=evaluator, seed=1).fit(df)
        assert len(model.validationMetrics) == 2
        if kwargs["loss"] != "me":
            assert model.bestModel.getRegParam() == 0.0
    made = spark.createDataFrame([(1.0, 0.0, 2.0), (3.0, 0.0, 1.0), (30.0, 20.0, 0.0)], "prediction double, label double, w double")
    value = lambda **k: losses.LossEvaluator(**k).evaluate(made)
    assert value(loss="me", weightCol="w") == pytest.approx(5 / 3) and value(loss="mse") == pytest.approx(110 / 3)
    assert value(loss="mae", binWidth=10.0) == pytest.approx((2 + 10) / 2)
    with pytest.raises(ValueError, match="unknown loss"):
        losses.loss("hinge", F.col("a"), F.col("b"))


D = dt.date(2020, 3, 1)
FOOT, SCENE = "shot_number long, tile string, gedi_date date, row int, col int", "tile string, acq_date date, scene string"


def streams(spark, path):
    return [spark.readStream.schema(s).parquet(str(path / name)) for s, name in ((FOOT, "foot"), (SCENE, "scene"))]


def add(spark, path, foot, scenes):
    spark.createDataFrame(foot, FOOT).coalesce(1).write.mode("append").parquet(str(path / "foot"))
    spark.createDataFrame(scenes, SCENE).coalesce(1).write.mode("append").parquet(str(path / "scene"))


def day(k):
    return D + dt.timedelta(k)


def test_a_late_scene_is_matched_and_replays_change_nothing(spark, tmp_path):
    def advance():
        matched = waiting.matched_stream(*streams(spark, tmp_path), "6 days", 1, parts=2)
        write = lambda batch, n: batch.write.mode("overwrite").parquet(str(tmp_path / f"out/batch={n}"))
        waiting.run(matched, write, str(tmp_path / "state"))
        return sorted((r.shot_number, r.scene, r.acq_date) for r in spark.read.option("basePath", str(tmp_path / "out")).parquet(str(tmp_path / "out/*")).collect())

    add(spark, tmp_path, [(1, "A", day(0), 1, 1), (2, "A", day(3), 2, 2), (2, "A", day(3), 2, 2), (3, "B", day(3), 3, 3), (9, None, day(3), 3, 3)], [("A", day(-20), "old"), ("A", day(3), "x"), ("A", day(3), "y")])
    assert advance() == []
    add(spark, tmp_path, [(4, "C", day(8), 4, 4)], [("A", day(0), "late"), ("B", day(9), "after")])
    first = advance()
    assert first == [] or first == [(1, "late", day(0))]
    add(spark, tmp_path, [(5, "C", day(60), 5, 5)], [("C", day(60), "new"), ("C", day(-400), "ancient")])
    want = [(1, "late", day(0)), (2, "y", day(3))]
    assert advance() == want
    add(spark, tmp_path, [(1, "A", day(0), 1, 1)], [])
    assert advance() == want


def test_matches_equal_the_batch_join(spark, tmp_path):
    rng = random.Random(5)
    scenes = [(rng.choice("ABC"), day(rng.randrange(0, 400)), f"s{k}") for k in range(150)]
    foot = [(k, rng.choice("ABCD"), day(rng.randrange(0, 380)), 0, 0) for k in range(400)]
    end = [("A", day(500), "end")], [(999, "A", day(500), 0, 0)]
    add(spark, tmp_path, foot + end[1], scenes + end[0])
    waiting.run(waiting.matched_stream(*streams(spark, tmp_path), "0 days", 5, parts=3), lambda b, n: b.write.mode("overwrite").parquet(str(tmp_path / f"out/batch={n}")), str(tmp_path / "state"))
    got = {r.shot_number: r.scene for r in spark.read.option("basePath", str(tmp_path / "out")).parquet(str(tmp_path / "out/*")).collect()}
    joined = matching.asof_join(spark.createDataFrame(foot, FOOT), spark.createDataFrame(scenes, SCENE)).where("scene is not null")
    assert got == {r.shot_number: r.scene for r in joined.collect()}


def test_a_batch_written_again_replaces_itself(spark, tmp_path):
    grid = spark.range(64 * 64).select(F.lit("S2").alias("layer"), F.lit("SCL").alias("band"), F.lit("t").alias("tile"), (F.col("id") / 64).cast("int").alias("row"), (F.col("id") % 64).cast("int").alias("col"), F.when(F.col("id") / 64 < 30, 4).otherwise(6).alias("value"))
    layers = chunks.to_chunks(grid, 16)
    batch = spark.createDataFrame([(1, "t", 10, 10, D, "s", D), (2, "t", 50, 10, D, "s", D), (3, "t", 0, 0, D, "s", D), (4, "t", 28, 20, D, "s", D)], waiting.MATCHED)
    write = waiting.batch_writer(layers, str(tmp_path / "table"), 16, 5, 64, 64)
    for _ in range(2):
        write(batch, 7)
    rows = spark.read.parquet(str(tmp_path / "table")).collect()
    assert sorted((r.shot_number, r.vegetation_score, r.batch) for r in rows) == [(1, 100, 7), (4, 80, 7)]


def test_chunk_files_do_not_grow_with_tiles(spark, tmp_path):
    pixels = spark.range(200).select(F.explode(F.array(F.lit("S2"), F.lit("CH"))).alias("layer"), F.lit("b").alias("band"), F.concat(F.lit("V"), "id").alias("tile"), F.lit(0).alias("row"), (F.col("id") % 4).cast("int").alias("col"), F.col("id").cast("int").alias("value"))
    chunks.write_chunks(chunks.to_chunks(pixels, 4), str(tmp_path / "chunks"))
    assert len(list((tmp_path / "chunks").rglob("*.parquet"))) <= 2 * 4
    own = chunks.read_chunks(spark, str(tmp_path / "chunks"), "CH")
    assert own.where("tile = 'V7'").count() == 1
    back = chunks.to_pixels(own, 4)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, pixels.where("layer = 'CH'").select(*back.columns).collect()))


def test_waiting_footprints_are_held_in_few_bytes_and_parts_grow(spark):
    import pandas as pd

    class State:
        exists, hasTimedOut, held = False, False, None

        def getCurrentWatermarkMs(self):
            return 0

        def update(self, value):
            self.held = value[0]

        def setTimeoutTimestamp(self, at):
            pass

    n = 20000
    shots = pd.DataFrame({"ts": pd.Timestamp("2021-05-01"), "shot_number": np.arange(n) + 2**60, "row": np.arange(n, dtype="int32") % 64, "col": 3, "scene": None})
    state = State()
    assert not list(waiting.matcher(5)(("31AAA", 0), iter([shots, shots]), state))
    assert len(state.held) < 32 * n
    assert waiting.parts_of(100_000, 25, 4) == 4 and waiting.parts_of(36_000_000, 25, 4) == 29
