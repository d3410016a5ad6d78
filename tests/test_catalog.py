import re

import duckdb
import pytest

from ridgework.plans import catalog

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def plain(rows):
    """Rows in one order: by what isn't a float, then by floats; decimals are floats."""
    number = lambda x: isinstance(x, float) or type(x).__name__ == "Decimal"
    rows = [tuple(float(x) + 0.0 if number(x) else x for x in r) for r in rows]
    return sorted(rows, key=lambda r: (str([x for x in r if not isinstance(x, float)]), [x for x in r if isinstance(x, float)]))


def same(got, want):
    """All equal; floats to a ten-millionth of their size, as both engines round exact halves of a last digit each in its own way."""
    close = lambda a, b: abs(a - b) <= 1e-7 * max(1.0, abs(a)) or a == b or a != a and b != b
    return len(got) == len(want) and all(len(r) == len(s) and all(close(x, y) if isinstance(x, float) and isinstance(y, float) else x == y for x, y in zip(r, s)) for r, s in zip(got, want))


@pytest.mark.parametrize("name", list(catalog.SQL))
def test_query_equals_sql(spark, db, name):
    got = catalog.QUERIES[name](spark, SF)
    names = sorted(got.columns)
    want = db.execute(f"SELECT {', '.join(names)} FROM ({catalog.SQL[name]})").fetchall()
    assert want
    got, want = plain(map(tuple, got.select(*names).collect())), plain(want)
    assert same(got, want), next(((a, b) for a, b in zip(got, want) if not same([a], [b])), (len(got), len(want)))


def test_every_query_has_sql():
    assert catalog.QUERIES.keys() == catalog.SQL.keys()


def test_results_reach_the_branches(spark):
    """Equal rows prove little of a branch that no row takes."""
    seen = lambda name, col: {r[0] for r in catalog.QUERIES[name](spark, SF).select(col).distinct().collect()}
    assert seen("equip_line_eval", "level") == {"full", "partial", "incompatible"}
    assert seen("equip_aircraft_eval", "level") == {"full", "partial", "incompatible"}
    notes = seen("equip_line_eval", "note")
    for part in ("exceeds this resource's", "over limits", "rollover", "passes for", "effort scaled"):
        assert any(part in (n or "") for n in notes), part
    assert any(re.search("longer than fastest", n) for n in seen("equip_recommend", "note")) and any(n.endswith("Cost-optimised selection") for n in seen("equip_recommend", "note"))
    assert seen("edge_cost_movers", "blocked") >= {None, "side-slope", "ford", "vegetation"}
    assert seen("edge_cost_gates", "blocked") == {None, "climb", "side-slope", "ford", "vegetation"}
    assert seen("corridor_effects", "status") >= {"collapsed", "degraded", "displaced-into"} and seen("corridor_summary", "frontage") >= {"two-abreast", "single-file"}
    assert seen("water_rings", "closed") == {True, False} and seen("painted_members", "member") == {True, False} and seen("incident_standoff", "converged") == {True, False}
    assert seen("trafficability", "mobility") == {"unrestricted", "restricted", "severely-restricted"}
    assert seen("fording", "ford_m") >= {None, 2.5, 1.2, 0.4, 1.0}
    assert seen("veg_mapping_hier", "matched") == {"type", "class", "formation", None}
    assert seen("veg_area", "source") == {"polygon", "raster", "nodata", None}
    assert seen("plane_fit", "place") == {"ridge", "midslope", "valley"}
    assert seen("incident_sectors", "sector") == {"head", "rear", "leftFlank", "rightFlank"}
    assert seen("upsert_versions", "status") == {200, 404, 409} and seen("insert_new", "status") == {201, 409}
    assert seen("rate_limit", "allowed") == {True, False} and seen("road_times", "basis") == {"published", "estimated", "vehicle-capability-only"}
    assert seen("isochrones", "band") >= {None, 15} and seen("viewshed", "screened") == {True, False} and seen("hex_boundary", "boundary") == {True, False}
    assert seen("grounding_check", "ok") == {True, False} and seen("state_first_match", "state") >= {"NSW", "VIC", "QLD", "WA", "SA", "TAS", "NT"}
