"""DuckDB text of the derived inputs, shared by the SQL counterparts of the queries."""

from __future__ import annotations

from geopatch.schema import LAND_COVER


def tile(ti: str) -> str:
    return f"(lpad(cast(cast(floor(cast(14.4 as double) * ({ti}) / cast(6 as double)) as int) + 1 as varchar), 2, '0') || substr('CDEFGHJKLMNPQRSTUVWX', cast(({ti}) % 20 as int) + 1, 1) || 'AA')"


CLASSES = "[" + ", ".join(map(str, LAND_COVER)) + "]"

TILES = f"""tiles as (
  select n_nationkey ti, {tile('n_nationkey')} tile, cast(floor(cast(14.4 as double) * n_nationkey / cast(6 as double)) as int) + 1 as zone,
         round(cast(-180 as double) + cast(14.4 as double) * n_nationkey, 6) min_lon, round(round(cast(-180 as double) + cast(14.4 as double) * n_nationkey, 6) + 16, 6) max_lon,
         cast(-60 as double) min_lat, cast(60 as double) max_lat
  from nation)"""
FOOTPRINTS = f"""footprints as (
  select o_orderkey shot_number, cast(o_custkey % 25 as int) ti, {tile('o_custkey % 25')} tile, cast(o_orderdate as date) + 8766 gedi_date,
         (o_orderkey * 104729 % 360000) / cast(1000 as double) - 180 lon, (o_orderkey * 7919 % 120000) / cast(1000 as double) - 60 lat,
         o_totalprice / cast(800 as double) agbd, cast(31 * o_orderkey % 64 as int) "row", cast((17 * o_orderkey + o_custkey) % 64 as int) col,
         'D' || strftime(cast(o_orderdate as date) + 8766, '%Y%j') || '_O' || o_orderkey || '_' || (1 + o_orderkey % 4) || '_T' || o_custkey || '_2_V' || (2 + o_orderkey % 3) pattern
  from orders)"""
SCENES = f"""scenes as (
  select ti, {tile('ti')} tile, acq_date, cloud,
         'S2A_MSIL2A_' || strftime(acq_date, '%Y%m%d') || 'T100000_N0' || (200 + ti) || '_R' || (100 + ti) || '_T' || {tile('ti')} || '_' || strftime(acq_date, '%Y%m%d') || 'T120000' scene
  from (select cast(l_suppkey % 25 as int) ti, cast(l_shipdate as date) + 8766 acq_date, min(l_discount) cloud
        from lineitem group by 1, 2))"""
PIXELS = f"""pixels as (
  select ti, tile, "row", col, cast((131 * "row" + 71 * col + 17 * ti + 58) % 4096 as int) dn
  from (select n_nationkey ti, {tile('n_nationkey')} tile, cast(k // 64 as int) "row", cast(k % 64 as int) col from nation, range(4096) r(k)))"""
GRID = f"""grid as (
  select s_suppkey ti, {tile('s_nationkey')} || '_' || s_suppkey tile, cast(s_suppkey * 37 % 356 - 180 as double) min_lon, cast(s_suppkey * 23 % 116 - 60 as double) min_lat,
         cast(s_suppkey * 37 % 356 - 176 as double) max_lon, cast(s_suppkey * 23 % 116 - 56 as double) max_lat from supplier)"""
CLASS_OF = CLASSES + '[("row" * col + ti) % 20 + 1]'
LAYERS = f"""raster as (
  select 'S2' layer, 'B02' band, ti, tile, "row", col, dn as value from pixels
  union all select 'S2', 'B03', ti, tile, "row", col, cast((131 * "row" + 71 * col + 17 * ti + 87) % 4096 as int) from pixels
  union all select 'S2', 'B04', ti, tile, "row", col, cast((131 * "row" + 71 * col + 17 * ti + 116) % 4096 as int) from pixels
  union all select 'S2', 'B08', ti, tile, "row", col, cast((131 * "row" + 71 * col + 17 * ti + 232) % 4096 as int) from pixels
  union all select 'S2', 'SCL', ti, tile, "row", col, case when (7 * "row" + 13 * col + ti) % 10 < 7 then 4 when ("row" + col) % 2 = 0 then 6 else 11 end from pixels
  union all select 'CH', 'ch', ti, tile, "row", col, case when ("row" + col) % 9 = 0 then 255 else "row" * col % 60 end from pixels
  union all select 'CH', 'std', ti, tile, "row", col, case when ("row" + col) % 9 = 0 then 255 else ("row" + 2 * col) % 12 end from pixels
  union all select 'ALOS', 'HH', ti, tile, "row", col, cast((37 * "row" + 11 * col + ti) % 5000 as int) from pixels where ti % 7 <> 0
  union all select 'ALOS', 'HV', ti, tile, "row", col, cast((13 * "row" + 29 * col + ti) % 3000 as int) from pixels where ti % 7 <> 0
  union all select 'LC', 'lc', ti, tile, "row", col, {CLASS_OF} from pixels
  union all select 'LC', 'prob', ti, tile, "row", col, case when ("row" * col + ti) % 20 = 0 then 255 else ("row" + col) % 101 end from pixels
  union all select 'DEM', 'dem', ti, tile, "row", col, cast(("row" * 3 + col * 5 + ti) % 900 - 50 as int) from pixels)"""
RASTER = f"""{PIXELS},
{LAYERS}"""
RADAR = f"""radar as (
  select * from (select {tile('l_suppkey % 25')} tile, strftime(cast(l_shipdate as date) + 8766, '%y') yy, cast(l_orderkey % 64 as int) "row", cast(l_partkey % 64 as int) col,
    cast(max(floor(l_quantity * 90)) as int) hh, cast(max(floor(l_extendedprice) % 5000) as int) hv from lineitem where l_suppkey % 25 % 7 <> 0 group by 1, 2, 3, 4) where yy <> '21')"""
CANOPY = f"""canopy as (
  select * from (select {tile('l_suppkey % 25')} tile, strftime(cast(l_shipdate as date) + 8766, '%y') yy, cast(l_partkey % 64 as int) "row", cast(l_orderkey % 64 as int) col,
    cast(max(floor(l_quantity)) as int) ch, cast(min(floor(l_discount * 100)) as int) std from lineitem group by 1, 2, 3, 4) where yy <> '22')"""
PATCHES = """patches as (
  select vec_id, cast(vec_id % 2 as int) boa, cast(k as int) k, cast(floor(abs(cast(embedding[k + 1] as double)) * 10000) as int) dn, cast(embedding[k + 1] as double) * 100 dem
  from embeddings, range(64) r(k))"""
MOSAIC_PIXELS = f"""{PATCHES},
pixels as (select vec_id // 16 ti, 'V' || (vec_id // 16) tile, cast(vec_id % 16 // 4 * 8 + k // 8 as int) "row", cast(vec_id % 16 % 4 * 8 + k % 8 as int) col, dn, dem from patches)"""
MOSAIC_RASTER = f"""{MOSAIC_PIXELS},
{LAYERS}"""
LAND = f"""land as (
  select p_partkey shot_number, cast(p_partkey % 25 as int) ti, {tile('p_partkey % 25')} tile, {CLASSES}[p_size % 20 + 1] lc, case when p_size = 50 then 255 else p_size * 2 end prob from part)"""
SPLITS = f"""splits as (
  select n_nationkey ti, {tile('n_nationkey')} tile, case when n_nationkey % 10 < 8 then 'train' when n_nationkey % 10 = 8 then 'val' else 'test' end as mode from nation)"""
PREDICTIONS = f"""{FOOTPRINTS},
predictions as (
  select shot_number, ti, tile, agbd target, cast(k as int) model, agbd + cast((shot_number * (37 + k)) % 101 - 50 as double) prediction from footprints, range(1, 6) r(k))"""


def using(*inputs: str) -> str:
    return "with " + ",\n".join(inputs) + "\n"
