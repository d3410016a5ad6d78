"""Production rates of fire-break resources: fuel, slope and width factors as SQL expressions over columns."""

from __future__ import annotations

KINDS = ("Machinery", "HandCrew", "Aircraft")
VEGETATION = ("grassland", "lightshrub", "mediumscrub", "heavyforest")
# Fuel factors by kind in the order of VEGETATION.
FUEL = {"Machinery": (1, 0.8, 0.55, 0.35), "HandCrew": (1, 0.62, 0.38, 0.22), "Aircraft": (1, 0.85, 0.65, 0.5)}
# Fixed values: (slope degrees, factor).
SLOPE = {
    "Machinery": ((0, 1), (10, 0.95), (15, 0.85), (20, 0.72), (25, 0.58), (30, 0.48), (35, 0.4), (45, 0.3)),
    "HandCrew": ((0, 1), (15, 0.85), (25, 0.7), (35, 0.55), (45, 0.45), (60, 0.35)),
    "Aircraft": ((0, 1),),
}
# Default limits by kind.
MAX_SLOPE, MAX_SIDE = {"Machinery": 25.0, "HandCrew": 45.0, "Aircraft": 90.0}, {"Machinery": 24.0, "HandCrew": 40.0, "Aircraft": 90.0}
TERRAIN_CEILING = {"flat": 10.0, "medium": 25.0, "steep": 45.0, "very_steep": 90.0}
CUT_WIDTH_M, EXTRA_PASS, CREW_WIDTH_M = 3.4, 0.85, 3.0
PARTIAL_SHARE, PARTIAL_PENALTY, NOTIONAL_RATE = 0.15, 2.0, 0.1


def interpolate_sql(x: str, anchors) -> str:
    """Piecewise-linear between anchors, constant beyond the ends."""
    parts = [f"WHEN {x} <= {anchors[0][0]} THEN {float(anchors[0][1])}"]
    for (a, fa), (b, fb) in zip(anchors, anchors[1:]):
        parts.append(f"WHEN {x} <= {b} THEN {float(fa)} + ({x} - {a}) * {(fb - fa) / (b - a)!r}")
    return f"(CASE {' '.join(parts)} ELSE {float(anchors[-1][1])} END)"


def by_kind_sql(kind: str, values: dict[str, str]) -> str:
    return f"(CASE {' '.join(f"WHEN {kind} = '{k}' THEN {v}" for k, v in values.items())} END)"


def fuel_sql(kind: str, veg: str) -> str:
    return by_kind_sql(kind, {k: "(CASE " + " ".join(f"WHEN {veg} = '{v}' THEN {float(f)}" for v, f in zip(VEGETATION, fs)) + " END)" for k, fs in FUEL.items()})


def slope_factor_sql(kind: str, slope: str) -> str:
    return by_kind_sql(kind, {k: interpolate_sql(slope, a) for k, a in SLOPE.items()})


def width_sql(kind: str, width: str, cut: str) -> str:
    passes = f"greatest(1.0, ceil({width} / coalesce({cut}, {CUT_WIDTH_M})))"
    crew = f"(CASE WHEN {width} <= {CREW_WIDTH_M} THEN 1.0 ELSE {width} / {CREW_WIDTH_M} END)"
    return by_kind_sql(kind, {"Machinery": f"1 + ({passes} - 1) * {EXTRA_PASS}", "HandCrew": crew, "Aircraft": "1.0"})


def slope_class_sql(slope: str) -> str:
    """Half-open classes; what no class holds, a negative slope, falls through to the last."""
    return f"(CASE WHEN {slope} >= 0 AND {slope} < 10 THEN 'flat' WHEN {slope} >= 10 AND {slope} < 25 THEN 'medium' WHEN {slope} >= 25 AND {slope} < 45 THEN 'steep' ELSE 'very_steep' END)"


def terrain_level_sql(slope: str) -> str:
    """Level of a slope; unlike the class, a negative one is flat."""
    return f"(CASE WHEN {slope} < 10 THEN 'flat' WHEN {slope} < 25 THEN 'medium' WHEN {slope} < 45 THEN 'steep' ELSE 'very_steep' END)"


def max_slope_sql(kind: str, explicit: str, terrain: str) -> str:
    """An explicit limit above 0; else the ceiling of the steepest terrain level in a comma list, at most 1.8 times the kind's default (an empty list: the default)."""
    ceiling = f"(CASE {' '.join(f"WHEN concat(',', {terrain}, ',') LIKE '%,{t},%' THEN {c}e0" for t, c in sorted(TERRAIN_CEILING.items(), key=lambda x: -x[1]))} WHEN {terrain} = '' THEN {by_kind_sql(kind, {k: f'{v}e0' for k, v in MAX_SLOPE.items()})} ELSE 0e0 END)"
    return f"(CASE WHEN {explicit} > 0 THEN {explicit} ELSE least({ceiling}, {by_kind_sql(kind, {k: f'{v * 1.8}e0' for k, v in MAX_SLOPE.items()})}) END)"


def max_side_sql(kind: str, explicit: str) -> str:
    return f"(CASE WHEN {explicit} > 0 THEN {explicit} ELSE {by_kind_sql(kind, {k: f'{v}e0' for k, v in MAX_SIDE.items()})} END)"


def max_slope(kind: str, explicit: float | None, terrain: str) -> float:
    if explicit and explicit > 0:
        return explicit
    ceiling = max(TERRAIN_CEILING.get(t, 0.0) for t in terrain.split(",")) if terrain else MAX_SLOPE[kind]
    return min(ceiling, MAX_SLOPE[kind] * 1.8)


def width(kind: str, width_m: float, cut: float | None) -> tuple[int | None, float]:
    """(passes of a machine, times the work) for a break of this width."""
    if kind == "Machinery":
        passes = max(1, -int(-width_m // (cut or CUT_WIDTH_M)))
        return passes, 1 + (passes - 1) * EXTRA_PASS
    return None, 1.0 if kind == "Aircraft" or width_m <= CREW_WIDTH_M else width_m / CREW_WIDTH_M


def rounded_sql(x: str) -> str:
    """To the next integer, halves up, as text."""
    return f"cast(cast(floor({x} + 0.5e0) AS BIGINT) AS STRING)"
