"""Engineering formulae as Column expressions; money in whole rubles, lengths in mm, flows in tenths of t/h."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans import rules


def half_up(value: Column) -> Column:
    """The whole number nearest to a value, halves upwards."""
    return F.floor(value + F.lit(0.5)).cast("bigint")


def clearance_class(du: Column) -> Column:
    """400, 800 or 1400: the diameter that stands for a clearance class."""
    return F.when(du < 500, 400).when(du <= 800, 800).otherwise(1400)


def oks_clearance_mm(du: Column) -> Column:
    return F.when(du < 500, 5000).when(du <= 800, 7000).otherwise(9000).cast("bigint")


def clearance_mm(restriction_type: Column, rule_clearance: Column, du: Column) -> Column:
    return F.when(restriction_type == "oks", oks_clearance_mm(du)).otherwise(rule_clearance)


def axis_distance_mm(clearance: Column, pair_mm: Column, half_mm: Column) -> Column:
    return clearance + pair_mm / 2 + half_mm


def tie_in_radius_mm(axis: Column) -> Column:
    return 2 * axis


def k_depth(h0_m: Column, h1_m: Column) -> Column:
    """Mean of the depth factors at both ends."""
    k = lambda h: F.greatest(F.lit(0.0), h - 3) * F.lit(0.1) + 1
    return (k(h0_m) + k(h1_m)) / 2


def chamber_cost(du: Column) -> Column:
    out = None
    for limit, cost in rules.CHAMBER_ROWS:
        value = F.lit(cost).cast("bigint")
        if limit is None:
            return out.otherwise(value)
        out = F.when(du <= limit, value) if out is None else out.when(du <= limit, value)
    return out


def penalty(flow_dt: Column) -> Column:
    return (F.lit(rules.PENALTY_FIXED).cast("bigint") + flow_dt * rules.PENALTY_PER_DT).cast("bigint")


def score(cost: Column, length_m: Column) -> Column:
    """0.7 of the cost against 25 million and 0.3 of the length against 100 m."""
    return 0.7 * (cost / 25e6) + 0.3 * (length_m / 100)


def piece_cost(length_mm: Column, cost_m: Column, kdepth: Column, kspec: Column) -> Column:
    return half_up(length_mm / 1000 * cost_m * kdepth * kspec)


def round_length(metres: Column) -> Column:
    return F.floor(metres * 1000 + 0.5) / 1000


def round_depth(metres: Column) -> Column:
    return F.floor(metres * 10000 + 0.5) / 10000


def round_exact(value: Column, decimals: int) -> Column:
    """Half up on the exact binary value of a double, away from zero.

    The decimal cast of a double goes through its shortest text, so the scaled
    remainder decides instead: at a tie of that text the binary value lies
    above, below or on it.
    """
    scaled = F.abs(value) * float(10**decimals)
    whole = F.floor(scaled)
    rest = F.abs(value) - whole / float(10**decimals)
    up = rest * float(10**decimals) > 0.5
    return F.signum(value) * (whole + F.when(up | ((rest * float(10**decimals) == 0.5) & (scaled - whole == 0.5)), 1).otherwise(0)) / float(10**decimals)


def output_flow(flow: Column) -> Column:
    """Three decimals, only where the flow is within four ulp of them."""
    near = F.floor(flow * 1000 + 0.5) / 1000
    return F.when(F.abs(near - flow) <= F.abs(flow) * 4 * 2.0**-52, near).otherwise(flow)


def interval(lo: Column, hi: Column) -> Column:
    return F.struct(lo.cast("double").alias("lo"), hi.cast("double").alias("hi"))


def intersect(a: Column, b: Column) -> Column:
    """Common part of two closed intervals; null if empty."""
    lo, hi = F.greatest(a["lo"], b["lo"]), F.least(a["hi"], b["hi"])
    return F.when(lo <= hi, interval(lo, hi))


def closest(a: Column, value: Column) -> Column:
    return F.least(F.greatest(value, a["lo"]), a["hi"])


def vertical_options(new_height_mm: Column, top_mm: Column, height_mm: Column, gap_mm: Column) -> Column:
    """Deepest top of the new pair above a utility and the shallowest below it, in mm."""
    return F.struct((top_mm - gap_mm - new_height_mm).alias("above_hi_mm"), F.greatest(F.lit(rules.MIN_DEPTH_MM).cast("bigint"), top_mm + height_mm + gap_mm).alias("below_lo_mm"))


def pass_under_mm(min_cover_mm: Column) -> Column:
    return F.greatest(F.lit(rules.MIN_DEPTH_MM).cast("bigint"), min_cover_mm)


def wanted_direction(consumer_order: Column, distance: Column, flow: Column) -> Column:
    """Sorting key of a consumer for a strategy's order; null distances (unreachable) come last."""
    far = F.lit(float("inf"))
    return F.when(consumer_order == "NEAREST", F.coalesce(distance, far)).when(consumer_order == "FARTHEST", F.coalesce(-distance, far)).otherwise(-flow.cast("double"))
