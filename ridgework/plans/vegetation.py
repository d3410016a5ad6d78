"""Vegetation from labels, codes, hierarchies and colours."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..functions import vegetation as v
from ..operators import vegetation as op
from ..sources import tables as t
from .registry import query

#: Labels that reach every rule of the cascades.
LABELS = (
    "Alpine Herbfield", "alpine   shrubland", "Dry Sclerophyll Forests", "Grassy Woodlands", "Semi-arid Woodlands", "Riverine Plain Grasslands", "Coastal Swamp", "Freshwater Lagoon", "Arid Shrublands", "Mallee", "Montane bog", "Ironwood", "herb layer", "Not Classified",
    "", "Mosaic", "Eucalypt Woodlands", "Vine Thicket", "Tussock Grass", "Chenopod plain", "Sparse cover", "Cleared land", "Salt Lake", "Scrub", "Saltbush", "No data", "Heathland", "wood pasture", "shrub mosaic", "grass verge", "5 - something", "Sea and Estuaries",
)
_LIST = "(" + "['" + "', '".join(LABELS) + "'])"
LAB = t.derived_sql("part", {"id": "p_partkey", "label": f"{_LIST}[1 + (p_partkey * 7 + p_size) % {len(LABELS)}]"})
_has = lambda label, r: f"regexp_matches({label}, '{r}')"
_rlike = lambda label, r: f"{label} RLIKE r'{r}'"


def labels(spark, sf):
    return t.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.element_at(F.array(*map(F.lit, LABELS)), (1 + (F.col("p_partkey") * 7 + F.col("p_size")) % len(LABELS)).cast("int")).alias("label"))


@query(f"SELECT id, CASE WHEN label <> '' THEN {v.cascade(_has, 'lower(label)', v.FORMATION_RULES, v.FORMATION_ELSE, 0)} END AS veg, CASE WHEN label <> '' THEN {v.cascade(_has, 'lower(label)', v.FORMATION_RULES, v.FORMATION_ELSE, 1)} END AS confidence FROM {LAB}")
def veg_regex_formation(spark, sf):
    """Class of a formation's name by ordered patterns; nothing for no name."""
    x = labels(spark, sf).withColumn("l", F.lower("label"))
    pick = lambda k: F.when(F.col("l") != "", F.expr(v.cascade(_rlike, "l", v.FORMATION_RULES, v.FORMATION_ELSE, k)))
    return x.select("id", pick(0).alias("veg"), pick(1).alias("confidence"))


@query(f"SELECT id, CASE WHEN label = '' THEN '{v.GROUP_EMPTY[0]}' ELSE {v.cascade(_has, 'lower(label)', v.GROUP_RULES, v.GROUP_ELSE, 0)} END AS veg, CASE WHEN label = '' THEN 0.3e0 ELSE {v.cascade(_has, 'lower(label)', v.GROUP_RULES, v.GROUP_ELSE, 1)} END AS confidence FROM {LAB}")
def veg_regex_group(spark, sf):
    """Class of a major group's name by ordered patterns."""
    x = labels(spark, sf).withColumn("l", F.lower("label"))
    pick = lambda k: F.when(F.col("l") == "", v.GROUP_EMPTY[k]).otherwise(F.expr(v.cascade(_rlike, "l", v.GROUP_RULES, v.GROUP_ELSE, k)))
    return x.select("id", pick(0).alias("veg"), pick(1).alias("confidence"))


_WORDS = "(['" + "', '".join(w for words, _, _ in v.LANDCOVER for w in words) + "', 'FOREST', 'Unheard of'])"
_N = sum(len(w) for w, _, _ in v.LANDCOVER) + 2


@query(f"SELECT id, {v.landcover_sql('lower(word)', 0)} AS veg, {v.landcover_sql('lower(word)', 1)} AS confidence FROM (SELECT p_partkey AS id, {_WORDS}[1 + p_partkey % {_N}] AS word FROM part)")
def landcover_class(spark, sf):
    """Class of a land cover word."""
    words = [w for ws, _, _ in v.LANDCOVER for w in ws] + ["FOREST", "Unheard of"]
    table = F.create_map(*(x for ws, c, n in v.LANDCOVER for w in ws for x in (F.lit(w), F.struct(F.lit(c).alias("veg"), F.lit(n).alias("confidence")))))
    x = t.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.lower(F.element_at(F.array(*map(F.lit, words)), (1 + F.col("p_partkey") % _N).cast("int"))).alias("word"))
    hit = F.coalesce(F.try_element_at(table, F.col("word")), F.struct(F.lit(v.LANDCOVER_ELSE[0]).alias("veg"), F.lit(v.LANDCOVER_ELSE[1]).alias("confidence")))
    return x.select("id", hit["veg"].alias("veg"), hit["confidence"].alias("confidence"))


_MOCK = "(SELECT c_custkey AS id, CAST(floor(abs((-35.0e0 + (c_custkey % 211) * 0.0137e0) * 10000)) AS BIGINT) % 1000 AS a, CAST(floor(abs((149.0e0 + (c_custkey % 307) * 0.0113e0) * 10000)) AS BIGINT) % 1000 AS b FROM customer)"
_BUCKET = "CASE WHEN x < 20 THEN 'grass' WHEN x < 35 THEN 'forest' WHEN x < 50 THEN 'scrub' WHEN x < 65 THEN 'crop' WHEN x < 75 THEN 'bare' WHEN x < 85 THEN 'urban' WHEN x < 95 THEN 'water' ELSE 'rock' END"


@query(f"SELECT id, {_BUCKET} AS cover FROM (SELECT id, (((a + b * 37) % 1000) * 23 + a * 7 + b * 13) % 100 AS x FROM {_MOCK})")
def landcover_mock(spark, sf):
    """The stand-in land cover of a position, by buckets of a mix of its digits."""
    x = t.derived(spark, sf, "customer", {"id": "c_custkey", "a": "CAST(floor(abs((-35.0e0 + (c_custkey % 211) * 0.0137e0) * 10000)) AS BIGINT) % 1000", "b": "CAST(floor(abs((149.0e0 + (c_custkey % 307) * 0.0113e0) * 10000)) AS BIGINT) % 1000"})
    return x.withColumn("x", F.expr("(((a + b * 37) % 1000) * 23 + a * 7 + b * 13) % 100")).select("id", F.expr(_BUCKET).alias("cover"))


_GROUPS = "(SELECT * FROM (VALUES " + ", ".join(f"({c}, '{n}', '{k}', {x}e0)" for c, n, k, x in v.GROUPS) + ") AS g(code, name, veg, confidence))"


@query(f"SELECT p_partkey AS id, g.veg, g.confidence, g.name, p_partkey % 101 IN (24, 25, 26, 27, 28, 99) AS low_fidelity FROM part LEFT JOIN {_GROUPS} AS g ON g.code = p_partkey % 101")
def group_lookup(spark, sf):
    """Class, name and fidelity of a major group's code; nulls for codes that are none."""
    g = spark.createDataFrame(list(v.GROUPS), "code long, name string, veg string, confidence double")
    x = t.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 101).alias("code"))
    return x.join(F.broadcast(g), "code", "left").select("id", "veg", "confidence", "name", F.col("code").isin(*v.LOW_FIDELITY).alias("low_fidelity"))


#: Legend labels: a leading code, the name itself, the name within more text, and none of these.
_LEG = f"(SELECT p_partkey AS id, CASE p_size % 5 WHEN 0 THEN concat(CAST(code AS VARCHAR), ' Something') WHEN 1 THEN upper(name) WHEN 2 THEN concat('Class: ', name, ' (mapped)') WHEN 3 THEN concat(' ', replace(name, ' ', '--')) ELSE concat('zz', p_name) END AS label FROM part JOIN (SELECT code, name, row_number() OVER (ORDER BY code) - 1 AS i FROM {_GROUPS}) ON i = p_partkey % 33)"
_NORM = "trim(regexp_replace(lower({}), '[^a-z]+', ' ', 'g'))"


@query(f"""
SELECT id, CAST(coalesce(lead, exact, inside) AS INTEGER) AS code FROM (
  SELECT id, any_value(CASE WHEN regexp_matches(l, '^\\d{{1,2}}\\b') THEN (SELECT code FROM {_GROUPS} WHERE code = TRY_CAST(regexp_extract(l, '^(\\d{{1,2}})\\b', 1) AS INTEGER)) END) AS lead,
         arg_max(code, length(name)) FILTER (n = {_NORM.format('name')}) AS exact, arg_max(code, length({_NORM.format('name')})) FILTER (contains(n, {_NORM.format('name')})) AS inside
  FROM (SELECT id, trim(label) AS l, {_NORM.format('label')} AS n FROM {_LEG}) CROSS JOIN {_GROUPS} GROUP BY id)""")
def legend_label(spark, sf):
    """The code of a legend's label: its leading number, else its name, else the longest name in it."""
    x = t.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), "p_size", "p_name", F.element_at(F.array(*(F.struct(F.lit(c).alias("code"), F.lit(n).alias("name")) for c, n, _, _ in v.GROUPS)), (F.col("p_partkey") % 33 + 1).cast("int")).alias("g"))
    label = F.expr("CASE p_size % 5 WHEN 0 THEN concat(g.code, ' Something') WHEN 1 THEN upper(g.name) WHEN 2 THEN concat('Class: ', g.name, ' (mapped)') WHEN 3 THEN concat(' ', replace(g.name, ' ', '--')) ELSE concat('zz', p_name) END")
    norm = lambda c: F.trim(F.regexp_replace(F.lower(c), "[^a-z]+", " "))
    x = x.select("id", F.trim(label).alias("l")).withColumn("n", norm(F.col("l")))
    names = sorted(((" ".join("".join(ch if "a" <= ch <= "z" else " " for ch in n.lower()).split()), c) for c, n, _, _ in v.GROUPS), key=lambda e: -len(e[0]))
    table = F.array(*(F.struct(F.lit(n).alias("n"), F.lit(c).alias("c")) for n, c in names))  # the longest first
    first = lambda f: F.get(F.filter(table, f), F.lit(0))["c"]
    lead = F.regexp_extract("l", r"^(\d{1,2})\b", 1)
    known = F.when((lead != "") & lead.cast("string").isin(*(str(c) for c, *_ in v.GROUPS)), F.expr(r"try_cast(regexp_extract(l, r'^(\d{1,2})\b', 1) AS INT)"))
    return x.select("id", F.when(F.col("l") != "", F.coalesce(known, first(lambda e: e["n"] == F.col("n")), first(lambda e: F.contains(F.col("n"), e["n"])))).alias("code"))


_RGB = "(SELECT vec_id AS id, CAST(floor(least(255.0, abs(embedding[1]::DOUBLE) * 900)) AS INTEGER) AS cr, CAST(floor(least(255.0, abs(embedding[2]::DOUBLE) * 900)) AS INTEGER) AS cg, CAST(floor(least(255.0, abs(embedding[3]::DOUBLE) * 900)) AS INTEGER) AS cb FROM embeddings)"
LEGEND = tuple((c, (c * 53) % 256, (c * 97) % 256, (c * 29 + 80) % 256) for c, *_ in v.GROUPS)


def colours(spark, sf):
    c = lambda i: F.floor(F.least(F.lit(255.0), F.abs(F.get("embedding", F.lit(i)).cast("double")) * 900)).cast("int")
    return t.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), c(0).alias("cr"), c(1).alias("cg"), c(2).alias("cb"))


def _ramp(rows, names: str) -> str:
    return f"(SELECT * FROM (VALUES {', '.join(str((i, *r)) for i, r in enumerate(rows))}) AS l({names}))"


_D = "pow(cr - r, 2) + pow(cg - g, 2) + pow(cb - b, 2)"


@query(f"SELECT id, CASE WHEN min(d) <= 300 THEN CAST(arg_min(code, (d, i)) AS INTEGER) END AS code FROM (SELECT *, {_D} AS d FROM {_RGB} CROSS JOIN {_ramp(LEGEND, 'i, code, r, g, b')}) GROUP BY id")
def legend_nearest(spark, sf):
    """The code of the nearest legend colour."""
    return op.nearest_code(colours(spark, sf), LEGEND).select("id", "code")


@query(f"""
WITH d AS (SELECT *, {_D} AS d FROM {_RGB} CROSS JOIN {_ramp(v.WET_RAMP, 'i, f, r, g, b')}), b AS (SELECT id, min(d) AS bd, arg_min(i, (d, i)) AS bi FROM d GROUP BY id),
n AS (SELECT b.*, x.f AS bf, y.f AS nf, y.d AS nd, row_number() OVER (PARTITION BY b.id ORDER BY y.d, y.i DESC) AS rn FROM b JOIN d AS x ON x.id = b.id AND x.i = bi JOIN d AS y ON y.id = b.id AND abs(y.i - bi) = 1)
SELECT id, CASE WHEN bd <= 576 THEN round(greatest(0, least(1, bf + CASE WHEN sqrt(bd) + sqrt(nd) > 0 THEN sqrt(bd) / (sqrt(bd) + sqrt(nd)) ELSE 0 END * (nf - bf))), 6) END AS frequency FROM n WHERE rn = 1""")
def wet_share(spark, sf):
    """The share of wet observations of a colour."""
    return op.wet_share(colours(spark, sf)).select("id", F.round("frequency", 6).alias("frequency"))


@query(f"""
WITH d AS (SELECT *, {_D} AS d FROM {_RGB} CROSS JOIN {_ramp(v.FIRE_YEARS, 'i, years, r, g, b')}), m AS (SELECT id, min(d) AS m FROM d GROUP BY id)
SELECT d.id, CASE WHEN any_value(m) <= 300 THEN CAST(max(years) AS INTEGER) END AS years, CASE WHEN any_value(m) <= 300 THEN count(*) > 1 END AS coarse FROM d JOIN m ON m.id = d.id AND d.d <= m + 1e-6 GROUP BY d.id""")
def fire_years(spark, sf):
    """Years since fire of a colour; of equally near ones the most, and coarse."""
    return op.fire_years(colours(spark, sf)).select("id", "years", "coarse")


#: Mapping rows: some of each level, overrides, inactive ones, and repeated keys.
_MAPS = """(SELECT s_suppkey AS ord, upper(r_name) AS formation, CASE WHEN s_suppkey % 4 <> 0 THEN n_name END AS class, CASE WHEN s_suppkey % 4 IN (1, 2) THEN concat('T', CAST(s_suppkey % 9 AS {s})) END AS type,
  CASE s_suppkey % 4 WHEN 0 THEN 'grassland' WHEN 1 THEN 'lightshrub' WHEN 2 THEN 'mediumscrub' ELSE 'heavyforest' END AS vegetation, s_suppkey % 5 = 0 AS is_override, s_suppkey % 7 <> 0 AND NOT (s_suppkey % 4 = 0 AND n_nationkey < 8) AS active
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
_SITES = """(SELECT c_custkey AS id, r_name AS formation, CASE WHEN c_custkey % 6 <> 0 THEN lower(n_name) END AS class, CASE WHEN c_custkey % 3 <> 0 THEN concat('t', CAST(c_custkey % 9 AS {s})) END AS type
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


@query(f"""
SELECT id, vegetation, matched, confidence FROM (
  SELECT s.id, m.vegetation, CASE k WHEN 1 THEN 'type' WHEN 2 THEN 'class' ELSE 'formation' END AS matched, CASE k WHEN 1 THEN CASE WHEN is_override THEN 0.99e0 ELSE 0.95e0 END WHEN 2 THEN CASE WHEN is_override THEN 0.94e0 ELSE 0.9e0 END WHEN 3 THEN 0.8e0 END AS confidence,
         row_number() OVER (PARTITION BY s.id ORDER BY k, m.ord) AS rn FROM {_SITES.format(s='VARCHAR')} AS s JOIN (SELECT *, CASE WHEN type <> '' AND class <> '' THEN 1 WHEN class <> '' AND coalesce(type, '') = '' THEN 2 WHEN coalesce(type, '') = '' THEN 3 END AS k FROM {_MAPS.format(s='VARCHAR')} WHERE active) AS m
  ON lower(m.formation) = lower(s.formation) AND (k = 3 OR lower(m.class) = lower(s.class)) AND (k <> 1 OR lower(m.type) = lower(s.type))) WHERE rn = 1
UNION ALL SELECT id, NULL, NULL, NULL FROM {_SITES.format(s='VARCHAR')} AS s WHERE NOT EXISTS (SELECT 1 FROM {_MAPS.format(s='VARCHAR')} AS m WHERE active AND lower(m.formation) = lower(s.formation) AND (coalesce(m.class, '') = '' OR lower(m.class) = lower(s.class)) AND (coalesce(m.type, '') = '' OR lower(m.type) = lower(s.type)))""")
def veg_mapping_hier(spark, sf):
    """Vegetation of each site by the mapping rows of its type, else class, else formation."""
    of = {name: t.table(spark, sf, name) for name in ("supplier", "customer", "nation", "region")}
    named = lambda sql: spark.sql("SELECT * FROM " + re.sub(r"\b(FROM|JOIN) (supplier|customer|nation|region)\b", r"\1 {\2}", sql.format(s="STRING")), **of)
    return op.hierarchical(named(_SITES), named(_MAPS)).select("id", "vegetation", "matched", "confidence")
