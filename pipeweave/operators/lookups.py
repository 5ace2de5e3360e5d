"""Equi, ceiling, successor and nearest lookups in rule tables.

Rule tables have 18 rows at most and are broadcast: a proven bound.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans import rules


def with_rule(restrictions: DataFrame, rule_table: DataFrame, unknown: str = "IGNORE") -> DataFrame:
    """Left join to the rule of the type; ``unknown``: IGNORE (null rule) or FORBIDDEN (1 m clearance)."""
    out = restrictions.join(F.broadcast(rule_table), "restriction_type", "left")
    if unknown == "FORBIDDEN":
        out = out.fillna({"kind": "FORBIDDEN", "clearance_mm": 1000, "min_angle": 0, "extent_m": 0, "kspec_pct": 100, "width_mm": 0})
    return out


def with_du(rows: DataFrame, du_table: DataFrame, du: str = "du") -> DataFrame:
    return rows.join(F.broadcast(du_table), rows[du] == du_table["du"]).drop(du_table["du"]) if du == "du" else rows.join(F.broadcast(du_table), rows[du] == du_table["du"])


def _first(condition) -> Column:
    """Smallest diameter whose row meets the condition; null if none does."""
    out = F.lit(None).cast("int")
    for row in reversed(rules.DU_ROWS):
        out = F.when(condition(*row), row[0]).otherwise(out)
    return out


def du_by_flow(flow_dt: Column) -> Column:
    return _first(lambda du, cap, *_: flow_dt <= cap)


def du_by_flow_and_length(flow_dt: Column, run_mm: Column, least_du: Column) -> Column:
    return _first(lambda du, cap, run, *_: (least_du <= du) & (flow_dt <= cap) & (run_mm <= run * 1000))


def next_du(du: Column) -> Column:
    out = F.lit(None).cast("int")
    for (a, *_), (b, *_) in zip(rules.DU_ROWS, rules.DU_ROWS[1:]):
        out = F.when(du == a, b).otherwise(out)
    return out


def nearest_du(diameter: Column) -> Column:
    """Nearest diameter of the table; the smaller one on a tie."""
    pairs = [F.struct(F.abs(diameter - du).alias("d"), F.lit(du).alias("du")) for du, *_ in rules.DU_ROWS]
    return F.array_min(F.array(*pairs))["du"].cast("int")
