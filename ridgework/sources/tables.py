"""Reading tables, and the domain inputs that queries derive from the star schema.

The derivations are SQL expressions, so that an oracle can apply the same ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VEG = "(CASE WHEN l_returnflag = 'A' THEN 'grassland' WHEN l_returnflag = 'R' THEN 'lightshrub' WHEN l_linestatus = 'F' THEN 'mediumscrub' ELSE 'heavyforest' END)"
SEGMENT = {
    "plan": "l_orderkey", "line": "l_linenumber", "len": "l_quantity * 20.0", "slope": "l_discount * 500.0", "side": "l_tax * 400.0", "veg": VEG, "water": "l_partkey % 17 = 0",
    "conf": "0.5e0 + (l_partkey % 50) / 100.0e0", "part": "l_partkey", "supp": "l_suppkey", "price": "l_extendedprice",
}
CELL = {
    "q": "CAST(p_partkey % 50 AS INTEGER)", "r": "CAST(floor(p_partkey / 50.0) AS INTEGER)", "elev": "p_retailprice / 10.0e0",
    "veg": "(CASE p_size % 4 WHEN 0 THEN 'grassland' WHEN 1 THEN 'lightshrub' WHEN 2 THEN 'mediumscrub' ELSE 'heavyforest' END)", "trail": "p_size % 5 = 0", "water_body": "p_partkey % 23 = 0",
    "frequency": "CASE WHEN p_partkey % 3 <> 0 THEN (p_partkey % 20) / 20.0e0 END", "waterway": "(CASE p_partkey % 19 WHEN 0 THEN 'river' WHEN 1 THEN 'stream' WHEN 2 THEN 'canal' END)", "side": "(p_partkey % 13) * 2.0e0",
    "highway": "(CASE WHEN p_size % 5 = 0 AND p_partkey % 4 <> 0 THEN CASE p_partkey % 7 WHEN 0 THEN 'primary' WHEN 1 THEN 'residential' WHEN 2 THEN 'service' WHEN 3 THEN 'path' ELSE 'track' END END)",
    "surface": "(CASE p_partkey % 6 WHEN 0 THEN 'gravel' WHEN 1 THEN 'mud' WHEN 2 THEN 'asphalt' END)", "tracktype": "(CASE WHEN p_partkey % 5 = 0 THEN 'grade4' END)", "smoothness": "(CASE WHEN p_partkey % 8 = 0 THEN 'very_bad' WHEN p_partkey % 8 = 1 THEN 'impassable' END)",
}
#: Vertices of drawn lines, a line an order.
POINT = {c: SEGMENT[c] for c in ("plan", "line", "part", "supp", "price", "len", "slope")} | {"lat": "-35.0e0 + (l_partkey % 97) * 0.0001e0", "lng": "149.0e0 + (l_suppkey % 89) * 0.0001e0"}
RESOURCE_COLUMNS = (
    "resource string, kind string, rate double, cost_hour double, cut double, max_slope double, max_side double, terrain string, veg_allowed string, "
    "drop_m double, turnaround double, cost_drop double"
)
_LIGHT, _SCRUB, _ALL = "grassland,lightshrub", "grassland,lightshrub,mediumscrub", "grassland,lightshrub,mediumscrub,heavyforest"
#: A row a resource: metres an hour, cost an hour, cut width, own limits of slope and side slope, terrain levels and fuels it may work in; of aircraft the
#: drop length, minutes of a turn and cost of a drop.
RESOURCES = (
    ("dozer-small", "Machinery", 800.0, 220.0, 2.5, None, None, "flat,medium", _SCRUB, None, None, None),
    ("dozer-large", "Machinery", 1400.0, 420.0, 4.0, 35.0, None, "flat,medium,steep", _ALL, None, None, None),
    ("grader", "Machinery", 2000.0, None, 3.6, None, 18.0, "flat", _LIGHT, None, None, None),
    ("crew", "HandCrew", 120.0, 260.0, None, None, None, "flat,medium,steep,very_steep", _ALL, None, None, None),
    ("heli-medium", "Aircraft", None, 3200.0, None, None, None, "flat,medium,steep,very_steep", _SCRUB, 40.0, 10.0, None),
    ("airtanker", "Aircraft", None, 9000.0, None, None, None, "flat,medium,steep,very_steep", _ALL, 120.0, 30.0, 4500.0),
)
BREAK_WIDTH_M = 6.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derived(spark: SparkSession, sf_dir: str, name: str, columns: dict[str, str]) -> DataFrame:
    return table(spark, sf_dir, name).select(*(F.expr(e).alias(c) for c, e in columns.items()))


def derived_sql(name: str, columns: dict[str, str]) -> str:
    return f"(SELECT {', '.join(f'{e} AS {c}' for c, e in columns.items())} FROM {name})"


def resources(spark: SparkSession) -> DataFrame:
    """The fixed catalogue: a few rows, so it may be broadcast."""
    return spark.createDataFrame(list(RESOURCES), RESOURCE_COLUMNS)


def resources_sql() -> str:
    cell = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else f"CAST({v} AS DOUBLE)"
    names = ", ".join(c.split()[0] for c in RESOURCE_COLUMNS.split(", "))
    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in RESOURCES)}) AS v({names}))"
