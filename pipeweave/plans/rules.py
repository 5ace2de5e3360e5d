"""Constant tables of the planning rules, as rows, DataFrames and SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Fixed values.
#: Nominal diameter, capacity in tenths of t/h, longest continuous run in m, price a metre, width of the pair in mm, height in mm.
DU_ROWS = [
    (50, 35, 181, 74023, 400, 125),
    (65, 83, 245, 78631, 430, 140),
    (80, 132, 327, 83530, 470, 160),
    (100, 223, 419, 89748, 510, 180),
    (125, 402, 554, 97275, 600, 225),
    (150, 651, 696, 105507, 650, 250),
    (200, 1523, 1042, 120275, 880, 315),
    (250, 2749, 1379, 135323, 1050, 400),
    (300, 4374, 1718, 150022, 1150, 450),
    (400, 9431, 2477, 190299, 1370, 560),
    (500, 16634, 3245, 224137, 1670, 710),
    (600, 26277, 4037, 264790, 1850, 800),
    (700, 37351, 4775, 324298, 2050, 900),
    (800, 52968, 5644, 325996, 2250, 1000),
    (900, 71650, 6518, 327693, 2450, 1100),
    (1000, 93918, 7419, 418777, 2650, 1200),
    (1200, 150128, 9288, 428074, 3100, 1425),
    (1400, 225019, 11276, 683417, 3450, 1600),
]
DU_COLUMNS = "du int, cap_dt bigint, max_length_m bigint, cost_m bigint, pair_mm bigint, height_mm bigint"

#: Restriction type, kind, clearance in mm (oks: by diameter), least angle, extent in m, Kspec in hundredths, own width in mm.
RULE_ROWS = [
    ("oks", "FORBIDDEN", 5000, 0, 0, 100, 0),
    ("park", "FORBIDDEN", 1000, 0, 0, 100, 0),
    ("social_area", "FORBIDDEN", 1000, 0, 0, 100, 0),
    ("prohibited_site", "FORBIDDEN", 1000, 0, 0, 100, 0),
    ("water", "FORBIDDEN", 1000, 0, 0, 100, 0),
    ("railway", "FORBIDDEN", 1000, 0, 0, 100, 0),
    ("road", "SPECIAL", 1500, 45, 3, 160, 0),
    ("tram_tracks", "SPECIAL", 1500, 45, 3, 175, 0),
    ("gas_pipeline", "SPECIAL", 2000, 0, 2, 125, 400),
    ("power_cable", "SPECIAL", 2000, 0, 2, 115, 200),
    ("heat_network", "SPECIAL", 1000, 0, 2, 105, 0),
]
RULE_COLUMNS = "restriction_type string, kind string, clearance_mm bigint, min_angle int, extent_m int, kspec_pct bigint, width_mm bigint"

#: Crossed type, method, least cover in mm, top of the utility in mm, its height in mm, vertical gap in mm.
VERTICAL_ROWS = [
    ("road", "COVER", 1000, None, None, None),
    ("tram_tracks", "COVER", 1200, None, None, None),
    ("gas_pipeline", "GAP", None, 2800, 400, 200),
    ("power_cable", "GAP", None, 2700, 200, 500),
    ("heat_network", "GAP", None, 3000, None, 500),
]
VERTICAL_COLUMNS = "restriction_type string, method string, min_cover_mm bigint, top_mm bigint, height_mm bigint, gap_mm bigint"

#: Largest adjacent diameter and price of a new chamber; tie-in to an existing one.
CHAMBER_ROWS = [(200, 3_000_000), (500, 5_000_000), (1000, 8_000_000), (None, 12_000_000)]
TIE_IN_COST = 5_000_000
MAX_TURN, MAX_DEGREE, SNAP_M, MAX_VARIANTS = 90, 4, 10, 3
PENALTY_FIXED, PENALTY_PER_DT = 100_000_000, 50_000
NORMAL_DEPTH_MM, MIN_DEPTH_MM, MAX_SLOPE = 3000, 700, 0.10
#: Strategy name, order, junctions allowed, tie-in policy, improvement pass.
STRATEGY_ROWS = [
    ("nearest_first", "NEAREST", True, "ANY", True),
    ("farthest_first", "FARTHEST", True, "ANY", True),
    ("largest_flow_first", "LARGEST_FLOW", True, "ANY", True),
    ("existing_chambers", "NEAREST", True, "EXISTING_ONLY", True),
    ("separate_lines", "NEAREST", False, "ANY", False),
]
STRATEGY_COLUMNS = "name string, consumer_order string, junctions boolean, policy string, improve boolean"

_TABLES = {
    "du_table": (DU_ROWS, DU_COLUMNS),
    "rules": (RULE_ROWS, RULE_COLUMNS),
    "vertical_rules": (VERTICAL_ROWS, VERTICAL_COLUMNS),
    "chamber_cost": (CHAMBER_ROWS, "max_du int, cost bigint"),
    "strategies": (STRATEGY_ROWS, STRATEGY_COLUMNS),
}


def table(spark: SparkSession, name: str) -> DataFrame:
    """A rule table; at most 18 rows, so it may be broadcast."""
    rows, columns = _TABLES[name]
    return spark.createDataFrame(rows, columns)


def as_sql(name: str) -> str:
    """The table as a SELECT that Spark SQL and DuckDB both read."""
    rows, columns = _TABLES[name]

    def literal(v):
        return "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v).upper() if isinstance(v, bool) else str(v)

    names, kinds = zip(*(c.split() for c in columns.split(", ")), strict=True)
    values = ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows)
    sql_kind = {"string": "VARCHAR(64)", "bigint": "BIGINT", "int": "INT", "boolean": "BOOLEAN"}
    casts = ", ".join(f"CAST({n} AS {sql_kind[k]}) AS {n}" for n, k in zip(names, kinds, strict=True))
    return f"SELECT {casts} FROM (VALUES {values}) AS v({', '.join(names)})"


def with_custom(rules: DataFrame, custom: DataFrame) -> DataFrame:
    """Rules with further types from configuration; a standard type can't be replaced."""
    return rules.unionByName(custom.join(rules.select("restriction_type"), "restriction_type", "left_anti").select(rules.columns))
