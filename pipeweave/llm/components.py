"""Connected components of a link table, without leaving the executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from . import common

#: Links that one task may contract; more are contracted in rounds of joins first.
ONE_TASK = 100_000


def _contracted(batches):
    """Stars (node, smallest node linked to it here) of the links of a partition."""
    import pyarrow as pa

    up: dict = {}

    def top(c):
        while (p := up.get(c, c)) != c:
            up[c] = up.get(p, p)
            c = p
        return c

    kind = None
    for batch in batches:
        kind = batch.schema.field(0).type
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = top(a), top(b)
            if x != y:
                up[max(x, y)] = min(x, y)
    if up:
        nodes = list(up)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, kind), pa.array([top(n) for n in nodes], kind)], ["a", "b"])


def _written(edges: DataFrame, moved: Column) -> tuple[DataFrame, str, int, int]:
    """The edges as a table, their number and how many of them ``moved`` says the round has changed."""
    seen = Observation()
    out, path = common.write_table(edges.observe(seen, F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(moved.cast("int")), F.lit(0)).alias("moved")).select("a", "b"), "edges")
    return out, path, seen.get["n"], seen.get["moved"]


def components(links: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """node, component (smallest node reachable) of every node of ``links`` (a, b).

    Each partition contracts its own links to stars. At most ``one_task`` links
    that are left are contracted by one task; more of them go through rounds
    of the large-star and small-star steps, whose number grows with the
    logarithm of the longest path, until a round moves no edge. Each round is
    written to the shared folder.
    """
    spark = links.sparkSession
    kind = links.schema["a"].dataType.simpleString()
    edges = links.where("a <> b").select("a", "b").mapInArrow(_contracted, f"a {kind}, b {kind}")
    edges, path, n, moved = _written(edges, F.lit(True))
    while moved:
        if n <= one_task:
            # A proven bound on what the task reads.
            edges = common.table(edges.coalesce(1).mapInArrow(_contracted, f"a {kind}, b {kind}"), "edges")
            common.remove(spark, path)
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"), (F.col("m") < F.col("a")).alias("moved"))
        stars = large.groupBy("a").agg(F.min("b").alias("m"), F.max("moved").alias("was")).select(F.col("a").alias("u"), "m", "was")
        small = large.join(stars, F.col("a") == F.col("u"))
        small = (small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"), F.lit(True).alias("moved"))
                 .unionByName(stars.select(F.col("u").alias("a"), F.col("m").alias("b"), F.col("was").alias("moved"))).groupBy("a", "b").agg(F.max("moved").alias("moved")))
        old = path
        edges, path, n, moved = _written(small, F.col("moved"))
        common.remove(spark, old)
    leaves = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return leaves.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
