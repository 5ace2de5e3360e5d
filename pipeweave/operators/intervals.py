"""Interval operators: unions, gaps, sweeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merge(rows: DataFrame, key: str, lo: str, hi: str, gap: float = 1e-6) -> DataFrame:
    """key, lo, hi, n: intervals that overlap or lie within ``gap`` become one."""
    w = Window.partitionBy(key).orderBy(lo, hi)
    reach = F.max(hi).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = rows.withColumn("_new", F.coalesce((F.col(lo) > reach + gap).cast("int"), F.lit(1)))
    marked = marked.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(key, "_island").agg(F.min(lo).alias("lo"), F.max(hi).alias("hi"), F.count(F.lit(1)).alias("n")).drop("_island")


def covering_max(rows: DataFrame, key: str, lo: str, hi: str, value: str) -> DataFrame:
    """key, lo, hi, top: elementary intervals and the largest value that covers each.

    One group per key, without a join: the bounds and intervals of a key are
    one array each, bounded by the sections of one line.
    """
    got = rows.groupBy(key).agg(F.collect_list(F.struct(F.col(lo).alias("lo"), F.col(hi).alias("hi"), F.col(value).alias("v"))).alias("ivs"))
    got = got.withColumn("bounds", F.array_sort(F.array_distinct(F.flatten(F.transform("ivs", lambda i: F.array(i["lo"], i["hi"]))))))
    cells = F.zip_with(F.slice("bounds", 1, F.size("bounds") - 1), F.slice("bounds", 2, F.size("bounds") - 1), lambda a, b: F.struct(a.alias("lo"), b.alias("hi")))
    got = got.select(key, "ivs", F.explode(cells).alias("c"))
    top = F.array_max(F.transform(F.filter("ivs", lambda i: (i["lo"] <= F.col("c.lo")) & (F.col("c.hi") <= i["hi"])), lambda i: i["v"]))
    return got.select(key, F.col("c.lo").alias("lo"), F.col("c.hi").alias("hi"), top.alias("top")).where("top IS NOT NULL")


def subtract(lo: Column, hi: Column, covers: Column) -> Column:
    """Parts of [lo, hi] that no cover (lo, hi) holds; covers in any order."""
    start = F.struct(lo.alias("at"), F.array().cast("array<struct<lo:double,hi:double>>").alias("out"))

    def step(acc, c):
        free = (c["lo"] > acc["at"]) & (acc["at"] < hi)
        part = F.struct(acc["at"].alias("lo"), F.least(c["lo"], hi).alias("hi"))
        return F.struct(F.greatest(acc["at"], F.least(c["hi"], hi)).alias("at"), F.when(free & (c["hi"] >= lo), F.concat(acc["out"], F.array(part))).otherwise(acc["out"]).alias("out"))

    done = F.aggregate(F.array_sort(F.filter(covers, lambda c: (c["hi"] >= lo) & (c["lo"] <= hi))), start, step)
    return F.when(done["at"] < hi, F.concat(done["out"], F.array(F.struct(done["at"].alias("lo"), hi.alias("hi"))))).otherwise(done["out"])


def covered(lo: Column, hi: Column, covers: Column, tolerance: float = 0.02) -> Column:
    """Whether all that is left open is at most ``tolerance`` long."""
    return F.forall(subtract(lo, hi, covers), lambda p: p["hi"] - p["lo"] <= tolerance)
