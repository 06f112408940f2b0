"""Band statistics, error metrics, splits and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def exact_quantiles(rows: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """``by`` and interpolated quantiles by name.

    Distinct values are counted with a map-side combine and only the counts
    are put in order, a sort that spills: at most 65,536 rows a group for
    16-bit bands.  For measured values, see ``band_stats(exact=False)``.
    """
    counts = rows.groupBy(*by, F.col(value).cast("double").alias("x")).agg(F.count("*").alias("c"))
    group = Window.partitionBy(*by)
    upto = counts.withColumns({"upto": F.sum("c").over(group.orderBy("x").rowsBetween(Window.unboundedPreceding, 0)), "n": F.sum("c").over(group)})

    def at(rank: Column) -> Column:
        return F.min(F.when(F.col("upto") > rank, F.col("x")))

    def quantile(p: float) -> Column:
        place = (F.col("n") - 1) * p
        low, high = at(F.floor(place)), at(F.ceil(place))
        return low + (high - low) * F.max(place - F.floor(place))

    return upto.groupBy(*by).agg(*[quantile(p).alias(name) for name, p in shares.items()])


def band_stats(rows: DataFrame, by: list[str], value: str, nodata: Column | None = None, exact: bool = True) -> DataFrame:
    """``mean, std, p1, p99, min, max`` of a value by group, without no-data.

    ``exact=False`` takes approximate percentiles, whose state is bounded (a
    rank is off by at most one in 10,000); the exact ones order the counts of
    all distinct values of a group.
    """
    rows = rows if nodata is None else rows.where(F.col(value) != nodata)
    x = F.col(value).cast("double")
    plain = [F.avg(x).alias("mean"), F.stddev_pop(x).alias("std")]
    ends = [F.min(x).alias("min"), F.max(x).alias("max")]
    if not exact:
        return rows.groupBy(*by).agg(*plain, *[F.percentile_approx(value, p, 10000).cast("double").alias(name) for name, p in (("p1", 0.01), ("p99", 0.99))], *ends)
    quantiles = exact_quantiles(rows, by, value, {"p1": 0.01, "p99": 0.99})
    return rows.groupBy(*by).agg(*plain, *ends).join(quantiles, by).select(*by, "mean", "std", "p1", "p99", "min", "max")


#: Items that a quantile sketch keeps a level; sketches of up to so many values are exact.
SKETCH = 4096


def sketches(rows: DataFrame, by: list[str], value: str, k: int = SKETCH) -> DataFrame:
    """``by, n, total, squares, low, high, sketch``: what the statistics of any union of groups can be merged from; null and undefined values are left out."""
    x = F.col(value).cast("double")
    known = rows.where(x.isNotNull() & ~F.isnan(x))
    return known.groupBy(*by).agg(F.count("*").alias("n"), F.sum(x).alias("total"), F.sum(x * x).alias("squares"), F.min(x).alias("low"), F.max(x).alias("high"), F.kll_sketch_agg_double(x, k).alias("sketch"))


def merged_stats(parts: DataFrame, by: list[str], shares: dict[str, float], k: int = SKETCH) -> DataFrame:
    """``by, n, mean, std, min, max`` and quantiles by name from the rows of ``sketches``; no value is read again."""
    sums = [F.sum(c).alias(c) for c in ("n", "total", "squares")]
    whole = parts.groupBy(*by).agg(*sums, F.min("low").alias("min"), F.max("high").alias("max"), F.kll_merge_agg_double("sketch", k).alias("sketch"))
    mean = F.col("total") / F.col("n")
    spread = F.sqrt(F.greatest(F.col("squares") / F.col("n") - mean * mean, F.lit(0.0)))
    return whole.select(*by, "n", mean.alias("mean"), spread.alias("std"), "min", "max", *[F.kll_sketch_get_quantile_double("sketch", F.lit(p)).alias(name) for name, p in shares.items()])


def error_aggregates(prediction: Column, target: Column, weight: Column | None = None, normalize_weights: bool = False) -> list[Column]:
    """n, rmse, mae, me, mse.  Weighted means divide by the number of rows, or by the weights' sum if asked."""
    error = prediction - target
    w = F.lit(1.0) if weight is None else weight
    mean = (lambda x: F.sum(w * x) / F.sum(w)) if normalize_weights else (lambda x: F.avg(w * x))
    return [F.count("*").alias("n"), F.sqrt(mean(error * error)).alias("rmse"), mean(F.abs(error)).alias("mae"), mean(error).alias("me"), mean(error * error).alias("mse")]


def binned_errors(rows: DataFrame, by: list[str], width: int = 50, upper: int = 500) -> DataFrame:
    """Errors by group, overall (``bin_lo`` null, ``overall`` true) and for each bin of the target, in one pass.

    Targets outside the bins count overall only; empty bins have n 0 and null
    errors.
    """
    target = F.col("target")
    binned = rows.withColumn("bin_lo", F.when((target >= 0) & (target < upper), (F.floor(target / width) * width).cast("int")))
    measures = error_aggregates(F.col("prediction"), target)
    sets = [[*map(F.col, by)], [*map(F.col, by), F.col("bin_lo")]]
    found = binned.groupingSets(sets, *by, "bin_lo").agg(F.grouping("bin_lo").alias("whole"), *measures)
    overall = found.where("whole = 1").withColumn("overall", F.lit(True)).drop("whole")
    bins = found.where("whole = 0 and bin_lo is not null").drop("whole")
    every = overall.select(*by, F.explode(F.sequence(F.lit(0), F.lit(upper - width), F.lit(width))).alias("bin_lo"))
    full = every.join(bins, [*by, "bin_lo"], "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("overall", F.lit(False))
    return overall.unionByName(full)


def best_model(rows: DataFrame, by: list[str]) -> DataFrame:
    """``val_rmse, test_rmse, epoch`` of the epoch with the least validation error, the first of equal ones."""
    best = F.min(F.struct("val_rmse", "epoch", "test_rmse")).alias("best")
    return rows.groupBy(*by).agg(best).select(*by, "best.val_rmse", "best.epoch", "best.test_rmse")


def seed_summary(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean and population deviation of a measure over the seeds."""
    return rows.groupBy(*by).agg(F.count("*").alias("n_seeds"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))


def of_split(rows: DataFrame, splits: DataFrame, mode: str) -> DataFrame:
    """Rows of the tiles of one split; the split's tiles are a semi-join, so Spark can prune partitions by tile."""
    return rows.join(splits.where(F.col("mode") == mode).select("tile"), "tile", "left_semi")


def tile_counts(rows: DataFrame, chunk: int = 1) -> DataFrame:
    """``tile, n``: rows of each tile in whole chunks."""
    return rows.groupBy("tile").agg(F.floor(F.count("*") / chunk).alias("n"))


def addresses(counts: DataFrame) -> DataFrame:
    """``tile, n, lo``: the ordinal of each tile's first row, over a table of at most some thousands of tiles."""
    before = F.sum("n").over(Window.orderBy("tile").rowsBetween(Window.unboundedPreceding, -1))
    return counts.withColumn("lo", F.coalesce(before, F.lit(0)))


def locate(ordinals: DataFrame, counts: DataFrame, steps: int = 10_000) -> DataFrame:
    """``ordinal, tile, row`` of global ordinals: a range join with the tiles, by way of equal steps of ordinals.

    The steps are as long as it takes to have about ``steps`` of them, so the
    tiles' side stays at that many rows and one a tile.
    """
    placed = addresses(counts).where("n > 0")
    step = max(1024, (placed.agg(F.max(F.col("lo") + F.col("n"))).first()[0] or 0) // steps)
    spans = placed.select("tile", "lo", "n", F.explode(F.sequence(F.floor(F.col("lo") / step), F.floor((F.col("lo") + F.col("n") - 1) / step))).alias("step"))
    asked = ordinals.select("ordinal", F.floor(F.col("ordinal") / step).alias("step"))
    met = asked.join(spans, "step").where("ordinal >= lo and ordinal < lo + n")
    return met.select("ordinal", "tile", (F.col("ordinal") - F.col("lo")).alias("row"))


def shards(tiles: DataFrame, n: int) -> DataFrame:
    """``tile, shard`` (from 1): contiguous parts of the tile list, the first ones one longer."""
    return tiles.select("tile", F.ntile(n).over(Window.orderBy("tile")).alias("shard"))


#: Equal parts of the order's range in which rows are counted; only one part a tile and biome is ranked.
PARTS = 4096


def representative_subset(rows: DataFrame, share: float, seed: int = 0, order: Column | None = None, span: int = 1 << 40) -> DataFrame:
    """About ``share`` of each tile's rows, with the tile's distribution of ``biome``.

    Quotas are shared out among the biomes of a tile by largest remainder, and
    each takes its rows by ``order``, a whole number below ``span`` (else a
    hash of ``shot_number``), so that the choice does not depend on the order
    of the rows.  Rows are counted by parts of the range; all of the parts that
    fit the quota are taken, none of those beyond, and only the rows of the
    part on the border are ranked.
    """
    order = F.pmod(F.xxhash64("shot_number", F.lit(seed)), F.lit(span)) if order is None else order
    sizes = rows.groupBy("tile", "biome").agg(F.count("*").alias("n"))
    totals = sizes.groupBy("tile").agg(F.floor(F.sum("n") * share + 0.5).alias("quota"))
    exact = sizes.join(totals, "tile").withColumns({"base": F.floor(F.col("n") * share), "rest": F.col("n") * share - F.floor(F.col("n") * share)})
    by_rest = Window.partitionBy("tile").orderBy(F.desc("rest"), "biome")
    spare = F.col("quota") - F.sum("base").over(Window.partitionBy("tile"))
    quotas = exact.withColumn("take", F.col("base") + (F.row_number().over(by_rest) <= spare).cast("int")).select("tile", "biome", "take")
    placed = rows.withColumns({"_order": order, "_part": F.floor(order * PARTS / F.lit(span)).cast("int")})
    parts = placed.groupBy("tile", "biome", "_part").agg(F.count("*").alias("c"))
    before = F.coalesce(F.sum("c").over(Window.partitionBy("tile", "biome").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    wanted = parts.withColumn("before", before).join(quotas, ["tile", "biome"]).where("before < take")
    wanted = wanted.select("tile", "biome", "_part", (F.col("take") - F.col("before")).alias("left"), (F.col("c") <= F.col("take") - F.col("before")).alias("whole"))
    met = placed.join(wanted, ["tile", "biome", "_part"])
    border = met.where("not whole").withColumn("rank", F.row_number().over(Window.partitionBy("tile", "biome").orderBy("_order", "shot_number"))).where("rank <= left")
    return met.where("whole").select(*rows.columns).unionByName(border.select(*rows.columns))


def shares(rows: DataFrame, by: str, value: str, classes: list[int]) -> DataFrame:
    """``by, biome, share`` of every class: its fraction of the group's rows; other values count in the denominator only."""
    counts = rows.groupBy(by, value).agg(F.count("*").alias("n"))
    totals = counts.groupBy(by).agg(F.sum("n").alias("n"), *[F.sum(F.when(F.col(value) == c, F.col("n")).otherwise(0)).alias(str(c)) for c in classes])
    pairs = F.array(*[F.struct(F.lit(c).alias("biome"), (F.col(str(c)) / F.col("n")).alias("share")) for c in classes])
    return totals.select(by, F.inline(pairs))


def subset_distance(rows: DataFrame, subset: DataFrame) -> DataFrame:
    """``tile, distance``: the Wasserstein-1 distance of the biome distributions, with classes in the order of their codes."""
    count = lambda df, name: df.groupBy("tile", "biome").agg(F.count("*").alias(name))
    both = count(rows, "a").join(count(subset, "b"), ["tile", "biome"], "left")
    whole = Window.partitionBy("tile")
    running = whole.orderBy("biome").rowsBetween(Window.unboundedPreceding, 0)
    b = F.coalesce("b", F.lit(0))
    gap = F.abs(F.sum("a").over(running) / F.sum("a").over(whole) - F.sum(b).over(running) / F.sum(b).over(whole))
    return both.withColumn("gap", gap).groupBy("tile").agg(F.sum("gap").alias("distance"))
