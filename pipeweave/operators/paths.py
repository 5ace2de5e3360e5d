"""Shortest paths as relations: many scenes and sources at once, no graph in one place.

What is known is one table (scene, source, node, cost, open). A round sends the
open rows of the nearest bucket over the edges and keeps the least cost of each
(scene, source, node); rows that improved are open again. Rounds are written, so
lineage stays short and a lost executor costs its tasks. Buckets keep far nodes
from being sent before near ones have settled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import table

#: What a vertex on the way costs, in metres. Fixed value.
VERTEX_PENALTY = 0.3
#: Width of a bucket of distance, in mean edge weights.
BUCKET = 4.0
KEYS = ["scene", "source"]


def shortest(edges: DataFrame, sources: DataFrame, terminals: DataFrame | None = None, banned: DataFrame | None = None, penalty: float = VERTEX_PENALTY, farthest: float | None = None) -> DataFrame:
    """scene, source, node, cost, prev: least costs from every source (scene, source) over edges (scene, src, dst, weight).

    Every vertex entered costs ``penalty`` more. Nodes of ``terminals`` (scene,
    node) end a path and are passed through by none, unless it begins there;
    edges of ``banned`` (scene, src, dst) aren't taken; nothing beyond
    ``farthest`` is looked for. Of predecessors that tie, the smallest is
    ``prev``; a source has none. Weights must not be negative.
    """
    if banned is not None:
        edges = edges.join(banned.select("scene", "src", "dst").distinct(), ["scene", "src", "dst"], "left_anti")
    ways = table(edges.groupBy("scene", "src", "dst").agg((F.min("weight") + F.lit(0.0)).alias("weight")), "ways")
    closed = terminals.select("scene", F.col("node").alias("src")).distinct().withColumn("_end", F.lit(True)) if terminals is not None else None
    if closed is not None:
        ways = table(ways.join(closed, ["scene", "src"], "left").select("scene", "src", "dst", "weight", F.coalesce("_end", F.lit(False)).alias("ends")), "ways")
    else:
        ways = ways.withColumn("ends", F.lit(False))
    width = BUCKET * ((ways.agg(F.avg("weight")).first()[0] or 1.0) + penalty)
    known = table(sources.select("scene", "source", F.col("source").alias("node"), F.lit(0.0).alias("cost"), F.lit(True).alias("open")).distinct(), "reached")
    limit = width
    while True:
        least = known.where("open").agg(F.min("cost")).first()[0]
        if least is None:
            break
        # The nearest bucket that holds something: empty ones are stepped over.
        limit = max(limit, least + width)
        active = F.col("open") & (F.col("cost") < limit)
        sent = known.where(active).join(ways.withColumnRenamed("src", "node"), ["scene", "node"]).where(~F.col("ends") | (F.col("node") == F.col("source")))
        sent = sent.select("scene", "source", F.col("dst").alias("node"), (F.col("cost") + F.col("weight") + penalty).alias("cost"), F.lit(True).alias("open"))
        if farthest is not None:
            sent = sent.where(F.col("cost") <= farthest)
        after = known.withColumn("open", F.col("open") & ~active).unionByName(sent)
        # At equal cost the row that was there stays, so nothing is sent twice.
        known = table(after.groupBy("scene", "source", "node").agg(F.min(F.struct("cost", "open")).alias("_b")).select("scene", "source", "node", "_b.cost", "_b.open"), "reached")
    at = known.select("scene", "source", F.col("node").alias("src"), F.col("cost").alias("_c"))
    before = at.join(ways, ["scene", "src"]).where(~F.col("ends") | (F.col("src") == F.col("source"))).select("scene", "source", F.col("dst").alias("node"), (F.col("_c") + F.col("weight") + penalty).alias("cost"), "src")
    prev = before.join(known.select("scene", "source", "node", "cost"), ["scene", "source", "node", "cost"]).groupBy("scene", "source", "node").agg(F.min("src").alias("prev"))
    return known.join(prev, ["scene", "source", "node"], "left").select("scene", "source", "node", "cost", F.when(F.col("node") != F.col("source"), F.col("prev")).alias("prev"))


def routes(found: DataFrame, targets: DataFrame) -> DataFrame:
    """scene, source, target, place, node: the nodes from each source to its targets (scene, source, target), the source at place 0.

    ``found`` is of ``shortest``. One round for each step, all routes at once.
    """
    back = table(found.where("prev IS NOT NULL").select("scene", "source", "node", "prev"), "prev")
    front = table(targets.join(found.select("scene", "source", F.col("node").alias("target")), ["scene", "source", "target"]).select("scene", "source", "target", F.col("target").alias("node"), F.lit(0).alias("back")), "route")
    parts = []
    while not front.isEmpty():
        parts.append(front)
        front = table(front.join(back, ["scene", "source", "node"]).select("scene", "source", "target", F.col("prev").alias("node"), (F.col("back") + 1).alias("back")), "route")
    if not parts:
        return front.select("scene", "source", "target", F.col("back").alias("place"), "node")
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    steps = every.groupBy("scene", "source", "target").agg(F.max("back").alias("_n"))
    return every.join(steps, ["scene", "source", "target"]).select("scene", "source", "target", (F.col("_n") - F.col("back")).alias("place"), "node")


def nearest_targets(found: DataFrame, targets: DataFrame) -> DataFrame:
    """scene, source, target, cost: the target (scene, node) of least cost for each source; ties to the smaller one."""
    met = found.join(targets.select("scene", "node").distinct(), ["scene", "node"]).where("node <> source")
    return met.groupBy("scene", "source").agg(F.min(F.struct("cost", F.col("node").alias("target"))).alias("b")).select("scene", "source", "b.target", "b.cost")
