"""Ranks, row numbers and bounded lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def numbered(rows: DataFrame, order: list, name: str) -> DataFrame:
    """Row numbers 1, 2, ... over the whole table without one task for all rows.

    Rows are range-partitioned and sorted; each row's number is its place in
    the partition plus the rows of the partitions before, whose counts (one a
    partition) are all that is gathered.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).withColumn("_m", F.monotonically_increasing_id())
    placed = placed.withColumn("_i", F.col("_m").bitwiseAND((1 << 33) - 1) + 1)
    counts = placed.groupBy("_p").agg(F.count(F.lit(1)).alias("_c"))
    before = counts.withColumn("_b", F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))).select("_p", F.coalesce("_b", F.lit(0)).alias("_b"))
    return placed.join(F.broadcast(before), "_p").withColumn(name, (F.col("_i") + F.col("_b")).cast("int")).drop("_p", "_m", "_i", "_b")


def ranked(scored: DataFrame) -> DataFrame:
    """Contiguous ranks by score; variants are few (one row each)."""
    return scored.withColumn("rank", F.row_number().over(Window.orderBy("score", "variant")))


def rank_issues(given: DataFrame) -> DataFrame:
    wanted = given.withColumn("wanted", F.row_number().over(Window.orderBy("score", "variant"))).withColumn("same", F.count(F.lit(1)).over(Window.partitionBy("rank")))
    return wanted.where("rank <> wanted").withColumn("code", F.lit("RANK_ORDER")).unionByName(wanted.where("same > 1").withColumn("code", F.lit("DUPLICATE_RANK")))


def first_rows(rows: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_r") <= n).drop("_r")
