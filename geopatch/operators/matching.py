"""Joins of footprints with tiles and scenes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Calendar months before the current one in which a scene may lie.
LOOK_BACK = 5
#: Bytes of tiles spread over their cells up to which they are broadcast; beyond, both sides are shuffled by cell.
BROADCAST_BYTES = 8 << 20
#: Cells that a tile's box is wide or high at most, on its level.
CELLS_ACROSS = 8


def in_ring(lon: Column, lat: Column, ring: Column) -> Column:
    """Whether a point is in a polygon given as an array of ``lon, lat`` corners; the boundary counts."""
    n = F.size(ring)

    def edge(k: Column) -> Column:
        a, b = F.get(ring, k), F.get(ring, (k + 1) % n)
        crosses = (a["lat"] > lat) != (b["lat"] > lat)
        cut = a["lon"] + (lat - a["lat"]) / F.nullif(b["lat"] - a["lat"], F.lit(0.0)) * (b["lon"] - a["lon"])
        on = ((b["lon"] - a["lon"]) * (lat - a["lat"]) == (b["lat"] - a["lat"]) * (lon - a["lon"])) & lon.between(F.least(a["lon"], b["lon"]), F.greatest(a["lon"], b["lon"])) & lat.between(F.least(a["lat"], b["lat"]), F.greatest(a["lat"], b["lat"]))
        return F.struct((crosses & (lon < cut)).alias("crosses"), on.alias("on"))

    edges = F.transform(F.sequence(F.lit(0), n - 1), edge)
    odd = F.size(F.filter(edges, lambda e: e["crosses"])) % 2 == 1
    return F.exists(edges, lambda e: e["on"]) | odd


def covered(tiles: DataFrame, base: float) -> DataFrame:
    """``tile, ring, box, level, cell_x, cell_y, inner``: the cells of each tile, on the level that suits its size.

    A level's cells are twice as wide as those of the one below.  A tile is put
    on the first level where its box is at most CELLS_ACROSS cells wide and
    high, so a huge tile has no more cells than a small one.  ``inner`` cells
    are those that no edge's box touches and whose centre is in the polygon;
    cells that no edge's box touches with their centre outside are left out.
    """
    extent = F.greatest(F.col("max_lon") - F.col("min_lon"), F.col("max_lat") - F.col("min_lat"))
    level = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(extent, F.lit(base)) / (base * CELLS_ACROSS)))).cast("int")
    sized = tiles.select("tile", "ring", "min_lon", "max_lon", "min_lat", "max_lat", level.alias("level")).withColumn("wide", F.pow(F.lit(2.0), "level") * base)
    cells = lambda low, high: F.explode(F.sequence(F.floor(F.col(low) / F.col("wide")), F.floor(F.col(high) / F.col("wide"))))
    spread = sized.withColumn("cell_x", cells("min_lon", "max_lon")).withColumn("cell_y", cells("min_lat", "max_lat"))
    west, south = F.col("cell_x") * F.col("wide"), F.col("cell_y") * F.col("wide")
    n = F.size("ring")

    def touches(k: Column) -> Column:
        a, b = F.get("ring", k), F.get("ring", (k + 1) % n)
        over = lambda c, low: (F.least(a[c], b[c]) <= low + F.col("wide")) & (F.greatest(a[c], b[c]) >= low)
        return over("lon", west) & over("lat", south)

    border = F.exists(F.sequence(F.lit(0), n - 1), touches)
    centre = in_ring(west + F.col("wide") / 2, south + F.col("wide") / 2, F.col("ring"))
    return spread.withColumn("border", border).where(F.col("border") | centre).select("tile", "ring", "min_lon", "max_lon", "min_lat", "max_lat", "level", "cell_x", "cell_y", (~F.col("border")).alias("inner"))


def spatial_join(points: DataFrame, tiles: DataFrame, cell: float | None = None) -> DataFrame:
    """Points with every tile whose polygon holds them.

    Tiles are put on cells of the level that suits their size (``covered``),
    points on one cell of each level in use, and both are joined on the cell.
    In cells inside a polygon that is all; in those on its border points are
    tested against box and polygon.  ``points(lon, lat, ..)``; ``tiles(tile,
    ring, min_lon, max_lon, min_lat, max_lat)``; other columns of the points are
    kept.  The lowest level's cells are as wide as the smallest tiles are on
    average, unless given.  What is broadcast is measured after it is spread
    over cells; beyond BROADCAST_BYTES both sides are shuffled.
    """
    narrow = F.least(F.col("max_lon") - F.col("min_lon"), F.col("max_lat") - F.col("min_lat"))
    base = cell or tiles.agg(F.percentile_approx(narrow, 0.1)).first()[0] or 1.0
    spread = covered(tiles, base).withColumnRenamed("tile", "_tile")
    sizes = spread.groupBy("level").agg(F.sum(F.lit(96) + 24 * F.size("ring")).alias("bytes")).collect()
    if sum(r["bytes"] for r in sizes) <= BROADCAST_BYTES:
        spread = F.broadcast(spread)
    levels = sorted(r["level"] for r in sizes) or [0]
    on = lambda c, k: F.floor(F.col(c) / (2.0**k * base))
    placed = points.withColumn("_cell", F.explode(F.array(*[F.struct(F.lit(k).alias("level"), on("lon", k).alias("cell_x"), on("lat", k).alias("cell_y")) for k in levels])))
    placed = placed.withColumns({c: F.col(f"_cell.{c}") for c in ("level", "cell_x", "cell_y")}).drop("_cell") if len(levels) > 1 else points.withColumns({"level": F.lit(levels[0]), "cell_x": on("lon", levels[0]), "cell_y": on("lat", levels[0])})
    near = placed.join(spread, ["level", "cell_x", "cell_y"]).where("inner or (lon between min_lon and max_lon and lat between min_lat and max_lat)")
    return near.where(F.col("inner") | in_ring(F.col("lon"), F.col("lat"), F.col("ring"))).select(*points.columns, F.col("_tile").alias("tile"))


def asof_join(points: DataFrame, scenes: DataFrame, look_back: int = LOOK_BACK) -> DataFrame:
    """Points with the latest scene of their tile that is not after them, null if there is none.

    Scenes count from the first day of the month ``look_back`` months earlier;
    of scenes on one day the greatest name wins.  ``points(tile, gedi_date,
    ..)``, ``scenes(tile, acq_date, scene)``.  Each tile and month has one row
    with the month's own days, at most 31, and the last scene of the months
    before it, so a point meets one row; null tiles and dates meet none.
    """
    months = scene_months(scenes, look_back)
    own = F.array_max(F.filter("_days", lambda d: d["acq_date"] <= F.col("gedi_date")))
    met = points.withColumn("_month", F.trunc("gedi_date", "MM")).join(months.withColumnsRenamed({"month": "_month", "days": "_days", "before": "_before"}), ["tile", "_month"], "left")
    match = met.withColumn("_match", F.coalesce(own, "_before"))
    kept = [F.col(c) for c in points.columns if c not in ("tile", "gedi_date")]
    return match.select("tile", "gedi_date", *kept, F.col("_match.scene").alias("scene"), F.col("_match.acq_date").alias("acq_date"))


def scene_months(scenes: DataFrame, look_back: int = LOOK_BACK) -> DataFrame:
    """``tile, month, days, before``: the scenes of each day of a month, and the last one of the ``look_back`` months before it."""
    daily = scenes.where("scene is not null").groupBy("tile", "acq_date").agg(F.max("scene").alias("scene"))
    ahead = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(look_back)), lambda k: F.add_months(F.trunc("acq_date", "MM"), k))).alias("ahead", "month")
    rows = daily.select("tile", F.struct("acq_date", "scene").alias("day"), "acq_date", ahead)
    return rows.groupBy("tile", "month").agg(F.collect_list(F.when(F.col("ahead") == 0, F.col("day"))).alias("days"), F.max(F.when(F.col("ahead") > 0, F.col("day"))).alias("before"))


def match_loss(matched: DataFrame) -> DataFrame:
    """``tile, n, dropped, ratio``: the footprints of each tile without a scene."""
    return matched.groupBy("tile").agg(F.count("*").alias("n"), F.count_if(F.col("scene").isNull()).alias("dropped")).withColumn("ratio", F.col("dropped") / F.col("n"))


def scene_of_year(scenes: DataFrame) -> DataFrame:
    """``year, tile, scene``: the least cloudy product of each year, the first by name of equal ones."""
    best = F.min(F.struct("cloud", "scene")).alias("best")
    return scenes.groupBy(F.year("acq_date").alias("year"), "tile").agg(best).select("year", "tile", F.col("best.scene").alias("scene"))


def quarantined(scenes: DataFrame, readable: DataFrame) -> DataFrame:
    """Scenes without any readable chunk."""
    return scenes.join(readable.select("scene").distinct(), "scene", "left_anti")


def metadata_violations(meta: DataFrame, quantification: int, offset: int) -> DataFrame:
    """``scene, reason`` of metadata ``(scene, quantification, boa_offset, band, offset)`` that breaks the product rules."""
    wrong = F.when(F.col("quantification") != quantification, "quantification").when((F.col("boa_offset") == 1) & (F.col("offset") != offset), "offset")
    return meta.select("scene", "band", wrong.alias("reason")).where("reason is not null")


def bounds_filter(points: DataFrame, box: tuple[Column, Column, Column, Column]) -> DataFrame:
    """Points with easting and northing within left, right, bottom, top."""
    left, right, bottom, top = box
    return points.where(F.col("easting").between(left, right) & F.col("northing").between(bottom, top))


def with_year_layer(points: DataFrame, layer: DataFrame, when: Column, values: list[str], nodata: int = 0) -> DataFrame:
    """Points with a yearly layer's pixel values, of the mosaic of the two-digit year of ``when``; no-data where there is none.

    ``points(tile, row, col, ..)``, ``layer(tile, yy, row, col, *values)``.
    """
    own = points.withColumn("yy", F.date_format(when, "yy"))
    found = own.join(layer.select("tile", "yy", "row", "col", *values), ["tile", "yy", "row", "col"], "left")
    return found.withColumns({v: F.coalesce(v, F.lit(nodata)) for v in values})
