"""Deterministic observations and grids made from the benchmark tables; the same SQL runs in Spark and DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

SIDE = 25
LAYERS = 3

CELLS = """
select cast(a.n_nationkey as int) as iy, cast(b.n_nationkey as int) as ix,
  cast(500050 as double) + 100 * b.n_nationkey as x, cast(6100050 as double) + 100 * a.n_nationkey as y,
  cast((b.n_nationkey * 7 + a.n_nationkey * 3) % 5 as int) as cls,
  cast(60 + (b.n_nationkey * 5 + a.n_nationkey * 11) % 17 as double) as terrain
from nation a cross join nation b"""
POINTS = """
select o_orderkey as pid,
  cast(500000 + 50 * ((o_orderkey * 7919) % 52) as double) as x,
  cast(6100000 + 50 * ((o_custkey * 104729 + o_orderkey * 31) % 52) as double) as y,
  cast((o_custkey % 120) + 1 as double) as depth, cast((o_custkey % 55) + 1 as double) / 2 as thick,
  case when o_orderkey % 7 = 0 then null else cast((o_orderkey % 90) + 10 as double) end as doi,
  case when o_orderpriority like '1%' then cast(1 as double) else cast(0 as double) end as mep_type,
  cast(year(o_orderdate) as int) as yr
from orders"""
ATTRIBUTES = f"""
select pid, cast(l.r_regionkey as int) as layer, depth + 10 * l.r_regionkey as depth, thick + l.r_regionkey as thick, doi, mep_type
from ({POINTS}) p cross join region l where l.r_regionkey < {LAYERS}"""
WELLS = """
select p_partkey as wid, cast(p_partkey % 3 as int) as layer, case when p_partkey % 2 = 0 then 'snapped' else 'database' end as source,
  cast(500000 + (p_partkey * 6151) % 2600 as double) as x, cast(6100000 + (p_partkey * 3571) % 2600 as double) as y,
  cast(p_size as double) as depth, cast((p_partkey % 4) + 1 as int) as quality,
  case when p_partkey % 11 = 0 then null else cast(p_partkey % 5 as int) end as cls, p_partkey % 3 = 0 as zero_thickness
from part"""
#: quality, k, gradient of either source
TABLES = """
select s.source, cast(q.quality as int) as quality, cast(q.k as double) as k, cast(q.gradient as double) as gradient
from (select 'snapped' as source union all select 'database') s
cross join (select 1 as quality, 0.15 as k, 0.01 as gradient union all select 2, 1.0, 0.015 union all select 3, 2.0, 0.035 union all select 4, 2.5, 0.05) q"""
BOTTOMS = f"""
select iy, ix, cast(r_regionkey as int) as layer,
  case when (ix + iy + r_regionkey) % 23 = 0 then null else terrain - 8 * (r_regionkey + 1) - (ix * r_regionkey + iy) % 6 end as bottom
from ({CELLS}) c cross join region"""
REALS = f"""
select b.iy, b.ix, b.layer, cast(r.r_regionkey as int) as real,
  b.bottom + ((b.ix * 13 + b.iy * 7 + r.r_regionkey * 5 + b.layer * 3) % 21) - 10 as elevation
from ({BOTTOMS}) b cross join region r where r.r_regionkey < 4"""
SURFACE = f"""
select iy, ix, cast(terrain + (ix * iy) % 7 - (ix * ix + 3 * iy) % 5 as double) as value from ({CELLS}) c"""
ESTIMATES = """
select cast(l_suppkey % 9 as int) as label, case when l_orderkey % 13 = 0 or l_suppkey % 9 = 8 then null else cast(50 + l_orderkey % 900 as double) end as range,
  case when l_partkey % 17 = 0 then null else cast(1 + l_partkey % 40 as double) end as sill
from lineitem"""
CLASSES = f"""
select iy, ix, case when (ix * 5 + iy * 3) % 11 = 0 then null else cast(1 + ((ix div 6) + (iy div 9) * 2 + case when (ix * iy) % 13 = 0 then 1 else 0 end) % 4 as int) end as cls from ({CELLS}) c"""
MARKED = f"select iy, ix from ({CELLS}) c where (ix * 7 + iy * 5 + (ix * iy) % 3) % 4 <> 0 and ix % 9 <> 8"


def duck(sql: str) -> str:
    """DuckDB's spelling of integer division."""
    return re.sub(r"\bdiv\b", "//", sql)


def frame(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    names = [t for t in ("nation", "region", "orders", "part", "lineitem", "customer", "embeddings", "events") if re.search(rf"\b{t}\b", sql)]
    for t in names:
        sql = re.sub(rf"(?<![\w{{]){t}(?=\s|$|\))", f"{{{t}}}", sql)
    return spark.sql(sql, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in names})


def axes() -> tuple[list[float], list[float]]:
    return [500050.0 + 100 * k for k in range(SIDE)], [6100050.0 + 100 * k for k in range(SIDE)]
