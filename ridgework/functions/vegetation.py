"""Vegetation classes from labels, codes and colours."""

from __future__ import annotations

# Ordered patterns over a lower-case label, the first that matches decides (class, confidence).
FORMATION_RULES = (
    (r"(alpine\s+(heath|grassland|herbfield|shrubland)|montane\s+(grass|herbfield))", "grassland", 0.8),
    (r"(rainforest|wet\s+sclerophyll|dry\s+sclerophyll|sclerophyll\s+forest|forest|forested|montane\s+wet\s+sclerophyll)", "heavyforest", 0.95),
    (r"(grassy\s+woodland|woodland|semi-arid\s+woodlands|woodlands)", "heavyforest", 0.9),
    (r"(grassland|grassy|meadow|temperate\s+montane\s+grass|maritime|riverine\s+plain\s+grasslands|floodplain)", "grassland", 0.9),
    (r"(saltmarsh|wetland|fen|swamp|sedgeland|rushland|freshwater|saline|mangrove|coastal\s+swamp|lagoon)", "lightshrub", 0.75),
    (r"(heath|heathland|shrubland|shrub|scrub|mallee|chenopod|acacia|arid\s+shrub|semi-arid)", "mediumscrub", 0.85),
    (r"(alpine|montane)", "grassland", 0.7),
    (r"forest|wood", "heavyforest", 0.7),
    (r"heath|shrub|scrub", "mediumscrub", 0.6),
    (r"grass|herb|montane", "grassland", 0.7),
    (r"(not\s+classif|not\s+classified|unclass|unknown|unclassified)", "grassland", 0.6),
)
FORMATION_ELSE = ("lightshrub", 0.5)
GROUP_RULES = (
    (r"rainforest|vine thicket|closed forest|tall open forest|open forest|low open forest|melaleuca|callitris", "heavyforest", 0.9),
    (r"tussock grass|hummock grass|grassland|herbland|sedgeland|rushland|aquatic", "grassland", 0.85),
    (r"mallee|heath|acacia (forest|woodland|shrub)|casuarina|eucalypt woodland|other shrubland|low closed forest|other forests and woodlands", "mediumscrub", 0.8),
    (r"chenopod|samphire|saltbush|mangrove|open woodland|sparse", "lightshrub", 0.7),
    (r"cleared|non-native|regrowth|naturally bare|salt lake|lake|sea|estuar|water|unknown|no data", "grassland", 0.5),
    (r"forest|wood", "heavyforest", 0.65),
    (r"shrub|scrub", "mediumscrub", 0.6),
    (r"grass|herb", "grassland", 0.65),
)
GROUP_ELSE, GROUP_EMPTY = ("mediumscrub", 0.4), ("lightshrub", 0.3)
# Code, name, class, confidence of the major vegetation groups.
GROUPS = (
    (1, "Rainforests and Vine Thickets", "heavyforest", 0.9), (2, "Eucalypt Tall Open Forests", "heavyforest", 0.95), (3, "Eucalypt Open Forests", "heavyforest", 0.9), (4, "Eucalypt Low Open Forests", "heavyforest", 0.8),
    (5, "Eucalypt Woodlands", "mediumscrub", 0.8), (6, "Acacia Forests and Woodlands", "mediumscrub", 0.7), (7, "Callitris Forests and Woodlands", "heavyforest", 0.8), (8, "Casuarina Forests and Woodlands", "mediumscrub", 0.7),
    (9, "Melaleuca Forests and Woodlands", "heavyforest", 0.75), (10, "Other Forests and Woodlands", "heavyforest", 0.7), (11, "Eucalypt Open Woodlands", "lightshrub", 0.65), (12, "Tropical Eucalypt Woodlands/Grasslands", "grassland", 0.7),
    (13, "Acacia Open Woodlands", "lightshrub", 0.65), (14, "Mallee Woodlands and Shrublands", "mediumscrub", 0.85), (15, "Low Closed Forests and Tall Closed Shrublands", "mediumscrub", 0.7), (16, "Acacia Shrublands", "mediumscrub", 0.8),
    (17, "Other Shrublands", "mediumscrub", 0.8), (18, "Heathlands", "mediumscrub", 0.85), (19, "Tussock Grasslands", "grassland", 0.95), (20, "Hummock Grasslands", "grassland", 0.9),
    (21, "Other Grasslands, Herblands, Sedgelands and Rushlands", "grassland", 0.9), (22, "Chenopod Shrublands, Samphire Shrublands and Forblands", "lightshrub", 0.8), (23, "Mangroves", "lightshrub", 0.5),
    (24, "Inland Aquatic - freshwater, salt lakes, lagoons", "grassland", 0.4), (25, "Cleared, non-native vegetation, buildings", "grassland", 0.5), (26, "Unclassified native vegetation", "mediumscrub", 0.4),
    (27, "Naturally bare - sand, rock, claypan, mudflat", "grassland", 0.4), (28, "Sea and estuaries", "grassland", 0.3), (29, "Regrowth, modified native vegetation", "mediumscrub", 0.6), (30, "Unclassified forest", "heavyforest", 0.6),
    (31, "Other Open Woodlands", "lightshrub", 0.6), (32, "Mallee Open Woodlands and Sparse Mallee Shrublands", "mediumscrub", 0.7), (99, "Unknown / no data", "lightshrub", 0.3),
)
LOW_FIDELITY = (24, 25, 26, 27, 28, 99)
# Class and confidence of land cover words.
LANDCOVER = (
    (("wood", "forest", "tree", "trees", "woodland", "mixed forest", "dense forest"), "heavyforest", 0.9), (("scrub", "shrub", "shrubland", "bush", "bushland", "heath", "heathland", "savanna", "mallee"), "mediumscrub", 0.85),
    (("grass", "grassland", "meadow", "pasture", "field", "dry grass", "wet grass", "prairie", "steppe"), "grassland", 0.9), (("crop", "farmland", "agriculture", "cultivated", "farm", "sparse vegetation", "sparse"), "lightshrub", 0.7),
    (("dense vegetation", "dense scrub", "thick vegetation"), "heavyforest", 0.8), (("snow", "ice", "glacier"), "grassland", 0.3), (("urban", "built", "developed", "building", "residential", "commercial", "industrial"), "lightshrub", 0.5),
    (("bare", "rock", "rocky", "barren", "sand", "sandy", "gravel", "stone"), "grassland", 0.6), (("water", "river", "lake", "pond", "wetland", "marsh", "swamp"), "grassland", 0.2), (("road", "highway", "path", "track"), "lightshrub", 0.4),
)
LANDCOVER_ELSE = ("lightshrub", 0.4)
# Share of wet observations by colour, from dry to always wet.
WET_RAMP = (
    (0.000, 200, 251, 250), (0.045, 178, 245, 251), (0.091, 154, 238, 253), (0.136, 130, 232, 254), (0.182, 109, 226, 255), (0.227, 84, 221, 255), (0.273, 60, 216, 255), (0.318, 38, 212, 255), (0.364, 14, 207, 255),
    (0.409, 1, 196, 255), (0.455, 1, 179, 255), (0.500, 1, 161, 255), (0.545, 1, 143, 255), (0.591, 1, 127, 255), (0.636, 6, 104, 255), (0.682, 14, 78, 255), (0.727, 22, 55, 255), (0.773, 30, 29, 255), (0.818, 38, 3, 255),
    (0.864, 47, 1, 250), (0.909, 58, 1, 244), (0.955, 68, 0, 238), (1.000, 78, 0, 232),
)
# Years since fire by colour, the long window.
FIRE_YEARS = (
    (1, 121, 35, 33), (2, 200, 40, 23), (3, 238, 88, 88), (4, 240, 130, 56), (5, 253, 164, 8), (6, 255, 210, 0), (7, 250, 245, 119), (8, 208, 242, 17), (9, 151, 231, 25), (10, 51, 247, 74), (11, 10, 220, 35),
    (12, 107, 213, 124), (13, 75, 220, 180), (14, 60, 240, 240), (15, 155, 235, 235), (16, 210, 245, 245), (17, 205, 225, 225), (18, 160, 200, 200), (19, 132, 170, 182), (20, 91, 137, 151), (21, 78, 118, 130),
    (22, 53, 80, 89), (23, 53, 80, 89), (24, 53, 80, 89), (25, 53, 80, 89), (26, 53, 80, 89),
)
WET_TOLERANCE, COLOUR_TOLERANCE = 24**2, 300


def cascade(matches, label: str, rules, otherwise: tuple[str, float], k: int) -> str:
    """SQL for the class (k = 0) or confidence (k = 1) of the first rule whose pattern is in the label; matches(label, pattern) is the engine's test."""
    value = lambda x: f"'{x[k]}'" if k == 0 else f"{x[k]!r}e0"
    return f"(CASE {' '.join(f'WHEN {matches(label, r)} THEN {value((c, n))}' for r, c, n in rules)} ELSE {value(otherwise)} END)"


def landcover_sql(label: str, k: int) -> str:
    value = lambda c, n: f"'{c}'" if k == 0 else f"{n!r}e0"
    return f"(CASE {' '.join(f"WHEN {label} IN ({', '.join(f"'{w}'" for w in words)}) THEN {value(c, n)}" for words, c, n in LANDCOVER)} ELSE {value(*LANDCOVER_ELSE)} END)"
