"""Texts: grounding, retrieval, encoded plans, markup."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import text as op
from ..sources import tables as t
from .lines import _VERT, vertices
from .registry import query


def _claims_sql(of: str) -> str:
    """of: id, text."""
    n = op.NUMBER.replace("'", "''")
    return f"""(
  SELECT id, row_number() OVER (PARTITION BY id ORDER BY pos) - 1 AS place, raw, value, unit FROM (
    SELECT id, value, unit, min(pos) AS pos, arg_min(raw, pos) AS raw FROM (
      SELECT id, pos, CAST(replace(num, ',', '') AS DOUBLE) AS value, CASE WHEN dollar <> '' THEN '$' WHEN word <> '' THEN lower(word) END AS unit, num, trim(concat(dollar, num, CASE WHEN word <> '' THEN concat(' ', word) ELSE '' END)) AS raw FROM (
        SELECT id, unnest(range(len(a))) AS pos, unnest(a) AS dollar, unnest(b) AS num, unnest(c) AS word FROM (
          SELECT id, regexp_extract_all(text, '{n}', 1) AS a, regexp_extract_all(text, '{n}', 2) AS b, regexp_extract_all(text, '{n}', 3) AS c FROM {of})))
    WHERE unit IS NOT NULL OR contains(num, '.') OR abs(value) >= 10 GROUP BY id, value, unit))"""


@query(f"SELECT id, CAST(place AS INTEGER) AS place, raw, value, unit FROM {_claims_sql('(SELECT doc_id AS id, text FROM documents)')}")
def numeric_claims(spark, sf):
    """The numbers that documents state."""
    return op.claims(t.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"))


CITED = {"id": "item_id", "text": "concat('See [[doc:D', CAST(item_id % 7 AS {s}), ']] and [[DOC:x-', CAST(item_id % 3 AS {s}), ']], [[doc:bad id]] or [[doc:d', CAST(item_id % 5 AS {s}), ']].')"}


@query(f"SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY min(pos)) - 1 AS INTEGER) AS place, c AS citation FROM (SELECT item_id AS id, unnest(range(3)) AS pos, lower(unnest(regexp_extract_all({CITED['text'].format(s='VARCHAR')}, '(?i)\\[\\[doc:([a-z0-9-]+)\\]\\]', 1))) AS c FROM benchmark) GROUP BY id, c")
def citation_ids(spark, sf):
    """The ids that texts cite."""
    return op.citations(t.derived(spark, sf, "benchmark", {k: e.format(s="STRING") for k, e in CITED.items()}))


_STATED = "concat('It takes ', CAST(round(o_totalprice / 1000, 1) AS {s}), ' hours and $', CAST(CAST(floor(o_totalprice) AS BIGINT) AS {s}), ', 42% done, 7 items, ', CAST(o_custkey % 50 AS {s}), ' km of 12 km in ', CAST(o_orderkey % 13 AS {s}), '.5 h')"
_PAYLOAD = "concat('{{\"a\": ', CAST(o_totalprice / 1000 AS {s}), ', \"label 99\": \"77 km\", \"b\": [', CAST(o_totalprice AS {s}), ', 12.04, {{\"c\": ', CAST(o_custkey % 40 AS {s}), '}}], \"d\": 42.3}}')"
_NUMS = "(SELECT id, list_transform(regexp_extract_all(regexp_replace(payload, '\"(?:[^\"\\\\]|\\\\.)*\"', '', 'g'), '-?\\d+(?:\\.\\d+)?(?:[eE][+-]?\\d+)?'), lambda x: CAST(x AS DOUBLE)) AS numbers FROM (SELECT o_orderkey AS id, " + _PAYLOAD.format(s="VARCHAR") + " AS payload FROM orders))"


@query(f"""
SELECT o_orderkey AS id, u IS NULL AS ok, coalesce(u, '') AS unmatched FROM orders LEFT JOIN (
  SELECT id, string_agg(raw, '; ' ORDER BY place) AS u FROM (
    SELECT c.id, c.place, c.raw FROM {_claims_sql(f"(SELECT o_orderkey AS id, {_STATED.format(s='VARCHAR')} AS text FROM orders)")} AS c JOIN (SELECT id, unnest(numbers) AS p FROM {_NUMS}) AS n ON n.id = c.id GROUP BY c.id, c.place, c.raw, c.value
    HAVING NOT bool_or(abs(p - value) < 1e-9 OR abs(floor(p + 0.5) - value) < 1e-9 OR abs(floor(p * 10 + 0.5) / 10 - value) < 1e-9 OR CASE WHEN p <> 0 THEN abs(p - value) / abs(p) ELSE abs(value) END < 0.01)) GROUP BY id) ON id = o_orderkey""")
def grounding_check(spark, sf):
    """Whether each text's numbers are those of its payload, and which are not."""
    o = t.derived(spark, sf, "orders", {"id": "o_orderkey", "text": _STATED.format(s="STRING"), "payload": _PAYLOAD.format(s="STRING")})
    bad = op.unmatched(op.claims(o.select("id", "text")), o.select("id", op.payload_numbers(F.col("payload")).alias("numbers")))
    bad = bad.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "raw"))), lambda x: x["raw"]), "; ").alias("unmatched"))
    return o.select("id").join(bad, "id", "left").select("id", F.col("unmatched").isNull().alias("ok"), F.coalesce("unmatched", F.lit("")).alias("unmatched"))


_STOP = ", ".join(f"'{w}'" for w in op.STOP_WORDS)
_TOK = "list_filter(regexp_split_to_array(lower({}), '[^a-z0-9]+'), lambda t: length(t) > 2 AND t NOT IN (" + _STOP + "))"
_ASKED = "(SELECT conv_id * 1000 + turn AS id, text FROM conversations WHERE role = 'user')"


@query(f"""
SELECT id, CAST(rank AS INTEGER) AS rank, chunk, CAST(score AS BIGINT) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, chunk) AS rank FROM (
    SELECT q.id, c.ord AS chunk, sum(w) AS score FROM (SELECT DISTINCT id, unnest({_TOK.format('text')}) AS t FROM {_ASKED}) AS q
    JOIN (SELECT item_id AS ord, unnest({_TOK.format('text')}) AS t, 1 AS w FROM benchmark UNION ALL SELECT item_id, unnest({_TOK.format('text')}[1:2]), 3 FROM benchmark) AS c ON c.t = q.t GROUP BY q.id, c.ord)) WHERE rank <= 3""")
def retrieve_topk(spark, sf):
    """The three passages that score most for each user turn; their first tokens are their tags."""
    q = t.table(spark, sf, "conversations").filter("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    chunks = t.table(spark, sf, "benchmark").select(F.col("item_id").alias("ord"), "text", F.slice(op.tokens(F.col("text")), 1, 2).alias("tags"))
    return op.retrieve(q, chunks)


_NUM = "regexp_replace(CAST({} AS VARCHAR), '\\.0$', '')"
_JSON = f"""(SELECT plan, count(*) AS n, concat('{{"v":1,"c":[', string_agg(concat('[', {_NUM.format('floor(lat * 1e5 + 0.5) / 1e5')}, ',', {_NUM.format('floor(lng * 1e5 + 0.5) / 1e5')}, ']'), ',' ORDER BY seq), ']', CASE WHEN plan % 4 > 0 THEN concat(',"w":', {_NUM.format('(plan % 4) * 400.0e0')}) ELSE '' END, '}}') AS j FROM {_VERT} GROUP BY plan)"""


@query(f"SELECT plan, rtrim(translate(to_base64(encode(j)), '+/', '-_'), '=') AS encoded, CASE WHEN n >= 2 THEN CAST(n AS INTEGER) END AS points, CASE WHEN plan % 4 IN (1, 2) THEN (plan % 4) * 400.0e0 END AS width FROM {_JSON}")
def plan_b64_roundtrip(spark, sf):
    """Plans as shared texts, and what is read back from them: widths beyond 1000 m and plans of one vertex are refused."""
    encoded = op.encode_plans(vertices(spark, sf), (F.col("plan") % 4) * 400.0)
    return encoded.join(op.decode_plans(encoded), "plan").select("plan", "encoded", F.when(F.col("coords").isNotNull(), F.size("coords")).alias("points"), "width")


@query(f"SELECT plan, CAST(seq AS INTEGER) AS place, round(lat, 6) AS lat, round(lng, 6) AS lng FROM {_VERT} WHERE n > 0")
def gpx_roundtrip(spark, sf):
    """Track points of plans, written as GPX and read back."""
    return op.gpx_points(op.gpx(vertices(spark, sf))).select("plan", "place", F.round("lat", 6).alias("lat"), F.round("lng", 6).alias("lng"))


@query("SELECT page_id, lower(t) AS tag, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '<([A-Za-z][A-Za-z0-9]*)', 1)) AS t FROM pages) GROUP BY 1, 2")
def xml_tags(spark, sf):
    """How often each element opens on each page."""
    p = t.table(spark, sf, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit("<([A-Za-z][A-Za-z0-9]*)"), F.lit(1))).alias("t"))
    return p.groupBy("page_id", F.lower("t").alias("tag")).agg(F.count(F.lit(1)).alias("n"))
