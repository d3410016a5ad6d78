"""Speeds, gates and road classes of movers, as SQL expressions over columns that both engines read."""

from __future__ import annotations

# Speeds and caps in km/h by tag.
HIGHWAY = {
    "motorway": 90, "motorway_link": 45, "trunk": 85, "trunk_link": 40, "primary": 65, "primary_link": 30, "secondary": 55, "secondary_link": 25, "tertiary": 40, "tertiary_link": 20,
    "unclassified": 25, "residential": 25, "living_street": 10, "service": 15,
}
SURFACE = {
    "cement": 80, "compacted": 80, "fine_gravel": 80, "paving_stones": 60, "metal": 60, "bricks": 60, "grass": 40, "wood": 40, "sett": 40, "gravel": 40, "unpaved": 40, "ground": 40, "dirt": 40,
    "pebblestone": 40, "tartan": 40, "cobblestone": 30, "clay": 30, "earth": 20, "stone": 20, "rocky": 20, "sand": 20, "laterite": 15, "mud": 10, "ice": 20, "snow": 30,
}
TRACKTYPE = {"grade1": 60, "grade2": 40, "grade3": 30, "grade4": 25, "grade5": 20}
SMOOTHNESS = {"intermediate": 80, "bad": 40, "very_bad": 20, "horrible": 10, "very_horrible": 5, "impassable": 0}
UNTAGGED_TRACK = 30
# Stem diameter (mm), gap width (m) and screening height (m) by vegetation.
STRUCTURE = {"grassland": (20, 50, 0.5), "lightshrub": (60, 8, 1.0), "mediumscrub": (150, 4, 3.0), "heavyforest": (610, 2, 20.0)}
# Depths to ford (m), speed in a ford, share of a limit that counts as near it.
BODY_M, RIVER_M, STREAM_M, WET_M, DAMP_M, FORD_FACTOR, NEAR = 2.5, 1.2, 0.4, 1.0, 0.4, 0.4, 0.85
CONCEALING_M = 2.0

MOVER_COLUMNS = "mover string, class string, model string, max_climb double, max_side double, ford double, width double, stem double, road_kmh double, cross_factor double, load double, night double"
#: name, class, speed model, limits of climb and side slope, depth it fords, width, stem it pushes over, road speed, cross-country factor, load and night factors.
MOVERS = (
    ("walker", "foot", "offpath", 45.0, 40.0, 0.5, 0.6, None, 5.0, 0.8, None, 0.7),
    ("column", "foot", "march", 35.0, 35.0, None, 1.0, None, 4.0, 0.6, 0.85, 0.6),
    ("truck", "wheeled", "vehicle", 22.0, 15.0, 0.7, 2.5, None, 80.0, 0.3, None, 0.6),
    ("carrier", "tracked", "vehicle", 30.0, 20.0, 1.3, 3.2, 160.0, 55.0, 0.5, None, 0.5),
)


def case(x: str, values: dict, default: str = "NULL") -> str:
    return f"(CASE {x} {' '.join(f"WHEN '{k}' THEN {float(v)!r}e0" for k, v in values.items())} ELSE {default} END)"


def ford_sql(body: str = "water_body", way: str = "waterway", frequency: str = "frequency") -> str:
    """Assumed depth to ford; null where there is no sign of water."""
    return f"(CASE WHEN {body} THEN {BODY_M}e0 WHEN {way} IN ('river', 'canal') THEN {RIVER_M}e0 WHEN {way} = 'stream' THEN {STREAM_M}e0 WHEN {frequency} >= 0.5e0 THEN {WET_M}e0 WHEN {frequency} >= 0.15e0 THEN {DAMP_M}e0 END)"


def ceiling_sql(highway: str, surface: str, tracktype: str, smoothness: str) -> str:
    """The least of the caps of a way's tags; a way of a kind without speed and without other tags has the fallback, no way null."""
    caps = [case(x, t) for x, t in ((highway, HIGHWAY), (surface, SURFACE), (tracktype, TRACKTYPE), (smoothness, SMOOTHNESS))]
    return f"coalesce(least({', '.join(caps)}), CASE WHEN {highway} <> '' THEN {UNTAGGED_TRACK}e0 END)"


def gap_sql(veg: str) -> str:
    return case(veg, {k: v[1] for k, v in STRUCTURE.items()}, "4.0e0")


def stem_sql(veg: str) -> str:
    return case(veg, {k: v[0] for k, v in STRUCTURE.items()}, "150.0e0")


def screening_sql(veg: str) -> str:
    return case(veg, {k: v[2] for k, v in STRUCTURE.items()}, "3.0e0")


def too_dense_sql(veg: str) -> str:
    """Whether a mover can't pass this vegetation: wheels need the gap, tracks the gap or stems that they push over."""
    return f"((class = 'wheeled' AND {gap_sql(veg)} < width) OR (class = 'tracked' AND {gap_sql(veg)} < width AND NOT coalesce({stem_sql(veg)} <= stem, false)))"


def foot_sql(on: str, grade: str) -> str:
    """Off paths and on them."""
    return f"(CASE WHEN {on} THEN 6 * exp(-3.5e0 * abs({grade} + 0.05e0)) ELSE 3.6e0 * (0.11e0 + exp(-pow(100 * {grade} + 2, 2) / 1800)) END)"


def grade_factor_sql(slope: str, limit: str) -> str:
    return f"(CASE WHEN {limit} <= 0 THEN 0e0 ELSE 1 - pow(least(1e0, {slope} / {limit}), 2) END)"
