"""Search kernels over many small scenes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...operators import depth, routing
from ..catalog import query


def scenes(s):
    """Blocks of six consumers, two roots and up to four boxes, side by side."""
    place = lambda v, m: F.pmod(v, F.lit(m)).cast("double")
    c = s.consumers.select((F.expr("id div 6")).alias("scene"), F.lit("consumer").alias("kind"), "id", place(F.col("id") * 37, 97).alias("x"), place(F.col("id") * 61, 89).alias("y"), F.lit(0.0).alias("x1"), F.lit(0.0).alias("y1"), (F.col("flow_dt") % 300 + 1).alias("flow_dt"), F.lit(0).alias("degree"))
    owners = s.consumers.where("id % 6 < 2").select((F.expr("id div 6")).alias("scene"), "id")
    r = owners.select("scene", F.lit("root").alias("kind"), "id", (F.lit(0.0) + (F.col("id") % 6) * 100).alias("x"), F.lit(50.0).alias("y"), F.lit(0.0).alias("x1"), F.lit(0.0).alias("y1"), F.lit(0).cast("bigint").alias("flow_dt"), F.lit(2).alias("degree"))
    b = s.consumers.where("id % 6 < 4").select((F.expr("id div 6")).alias("scene"), F.lit("box").alias("kind"), "id", (place(F.col("id") * 53, 80) + 0.5).alias("x"), (place(F.col("id") * 71, 80) + 0.5).alias("y"), (place(F.col("id") * 53, 80) + 8.5).alias("x1"), (place(F.col("id") * 71, 80) + 6.5).alias("y1"), F.lit(0).cast("bigint").alias("flow_dt"), F.lit(0).alias("degree"))
    return c.unionByName(r).unionByName(b)


@query("o01_greedy_forests")
def forests(s):
    return routing.plan_scenes(scenes(s))


@query("o11_ranked_variants")
def variants(s):
    out = routing.ranked_variants(routing.plan_scenes(scenes(s)))
    return out.select("scene", "strategy", "cost", "length_mm", "rank")


@query("o13_depth_profiles")
def profiles(s):
    """One chain for each order of the line table, its crossings from all its sections."""
    kinds = F.array(*(F.lit(k) for k in ("road", "tram_tracks", "gas_pipeline", "power_cable")))
    at = s.sections.withColumn("restriction_type", F.element_at(kinds, (F.col("link") % 4 + 1).cast("int")))
    v = s.vertical_rules
    rows = at.join(F.broadcast(v), "restriction_type").select(
        F.col("link").alias("chain"), F.lit(500.0).alias("length_m"), F.lit(83530.0).alias("price"), (F.col("s0") + 20).alias("lo"), (F.col("s0") + 24).alias("hi"), F.when(F.col("method") == "COVER", "COVER").otherwise("GAP").alias("kind"), F.lit(0.16).alias("new_height"),
        (F.col("top_mm") / 1000).alias("top"), (F.col("height_mm") / 1000).alias("height"), (F.col("gap_mm") / 1000).alias("gap"), (F.col("min_cover_mm") / 1000).alias("cover"))
    return depth.plan_chains(rows)


@query("o15_network_depths")
def network_depths(s):
    """Depths of all links, chains planned from the roots outwards; a link's first child goes straight on, its crossings are the sections of the order of its number."""
    links = s.links.select("child", "parent", (F.col("child") % 2 == 1).alias("continues"), (F.col("length_mm") / 1000).alias("length_m"), F.lit(83530.0).alias("price"))
    kinds = F.array(*(F.lit(k) for k in ("road", "tram_tracks", "gas_pipeline", "power_cable")))
    at = s.sections.withColumn("restriction_type", F.element_at(kinds, (F.col("obstacle") % 4 + 1).cast("int"))).join(F.broadcast(s.vertical_rules), "restriction_type")
    met = at.join(links.select(F.col("child").alias("link"), "length_m"), "link").where("length_m > 20 AND s0 < length_m - 10")
    crossings = met.select(F.col("link").alias("child"), F.col("s0").alias("lo"), (F.col("s0") + 4).alias("hi"), F.when(F.col("method") == "COVER", "COVER").otherwise("GAP").alias("kind"), F.lit(0.16).alias("new_height"),
                           (F.col("top_mm") / 1000).alias("top"), (F.col("height_mm") / 1000).alias("height"), (F.col("gap_mm") / 1000).alias("gap"), (F.col("min_cover_mm") / 1000).alias("cover"))
    return depth.plan_network(depth.chained(links), crossings)
