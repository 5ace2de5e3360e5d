"""Piece prices, cost summaries and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import engineering as E
from ..plans import rules
from . import lookups


def priced(pieces: DataFrame, du_table: DataFrame) -> DataFrame:
    """Diameter by flow and price in whole rubles; pieces beyond every diameter are infeasible and go."""
    sized = pieces.withColumn("du", lookups.du_by_flow(F.col("flow_dt"))).where("du IS NOT NULL")
    kspec = F.when(F.col("laying") == "O", 1.6).otherwise(1.0)
    return sized.join(F.broadcast(du_table.select("du", "cost_m")), "du").withColumn("cost", E.piece_cost(F.col("length_mm"), F.col("cost_m"), F.lit(1.0), kspec))


def by_diameter(rows: DataFrame) -> DataFrame:
    return rows.groupBy("variant", "du").agg(F.count(F.lit(1)).alias("n"), F.sum("length_mm").alias("length_mm"), F.sum("cost").alias("cost"))


def by_crossed_type(rows: DataFrame) -> DataFrame:
    """``crossed``: labels type#number; the type is what stands before the mark."""
    each = rows.select("variant", "length_mm", "cost", F.explode("crossed").alias("label")).withColumn("crossed_type", F.split_part("label", F.lit("#"), F.lit(1)))
    return each.groupBy("variant", "crossed_type").agg(F.count(F.lit(1)).alias("n"), F.sum("length_mm").alias("length_mm"), F.sum("cost").alias("cost"))


def summary(rows: DataFrame) -> DataFrame:
    tie_ins = F.count_if(F.col("laying") == "F") * rules.TIE_IN_COST
    penalty = F.coalesce(F.sum(F.when(F.col("laying") == "P", E.penalty(F.col("flow_dt")))), F.lit(0))
    out = rows.groupBy("variant").agg(F.sum("cost").alias("lines_cost"), F.sum("length_mm").alias("length_mm"), tie_ins.cast("bigint").alias("tie_in_cost"), penalty.cast("bigint").alias("penalty"))
    return out.withColumn("total", F.col("lines_cost") + F.col("tie_in_cost") + F.col("penalty"))


def scored(rows: DataFrame) -> DataFrame:
    out = rows.groupBy("variant").agg(F.sum("cost").alias("cost"), F.sum("length_mm").alias("length_mm"))
    return out.withColumn("score", E.score(F.col("cost"), F.col("length_mm") / 1000))


def depth_metrics(pieces: DataFrame) -> DataFrame:
    both = F.col("depth0_mm") + F.col("depth1_mm")
    limit = 2 * rules.NORMAL_DEPTH_MM
    return pieces.groupBy("variant").agg(
        F.max(F.greatest("depth0_mm", "depth1_mm")).alias("max_mm"), F.min(F.least("depth0_mm", "depth1_mm")).alias("min_mm"),
        F.expr("sum((depth0_mm + depth1_mm) * (length_mm div 1000)) div (2 * sum(length_mm div 1000))").alias("mean_mm"),
        F.sum(F.when(both > limit, F.col("length_mm")).otherwise(0)).alias("deep_mm"), F.sum(F.when(both < limit, F.col("length_mm")).otherwise(0)).alias("shallow_mm"),
        F.count_if(F.col("depth0_mm") != F.col("depth1_mm")).alias("transitions"))
