"""A whole planning job: read scenes, plan every strategy, rank, write the results.

One input file is one scene; files are planned side by side.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import engineering as E
from ..functions import geometry as G
from ..plans import rules
from ..sources import geojson, split
from . import routing, tie_ins
from .shared import table


@dataclass
class Job:
    """Tables of a finished job."""

    features: DataFrame
    diagnostics: DataFrame
    links: DataFrame
    variants: DataFrame
    #: What was planned with: parents below 0 are roots and tie-ins here, by -1 - id.
    planned: DataFrame | None = None


def scene_features(rows: DataFrame) -> DataFrame:
    """Rows of ``geojson.typed`` as the planner's features: consumers, roots (chambers), tie-ins on lines, boxes and buildings (forbidden objects with their clearance)."""
    scene = F.xxhash64("file").alias("scene")
    first = F.element_at("points", 1)
    place = [first["x"].alias("x"), first["y"].alias("y"), F.lit(0.0).alias("x1"), F.lit(0.0).alias("y1")]
    held = rows.where("size(points) > 0")
    consumers = held.where("object_type = 'consumer' AND flow_tph > 0").select(scene, F.lit("consumer").alias("kind"), F.col("index").cast("bigint").alias("id"), *place, F.floor(F.col("flow_tph") * 10 + 0.5).cast("bigint").alias("flow_dt"), F.lit(0).alias("degree"))
    roots = held.where("object_type = 'heat_chamber'").select(scene, F.lit("root").alias("kind"), F.col("index").cast("bigint").alias("id"), *place, F.lit(0).cast("bigint").alias("flow_dt"), F.lit(2).alias("degree"))
    rule = table_of_rules(rows.sparkSession)
    boxed = held.where("object_type = 'restriction'").join(F.broadcast(rule), "restriction_type").where("kind = 'FORBIDDEN'").drop("kind")
    grow = E.clearance_mm(F.col("restriction_type"), F.col("clearance_mm"), F.lit(400)) / 1000 + 0.685
    x, y = F.transform("points", lambda p: p["x"]), F.transform("points", lambda p: p["y"])
    boxes = boxed.select(scene, F.when(F.col("restriction_type") == "oks", "building").otherwise("box").alias("kind"), F.col("index").cast("bigint").alias("id"), (F.array_min(x) - grow).alias("x"), (F.array_min(y) - grow).alias("y"), (F.array_max(x) + grow).alias("x1"), (F.array_max(y) + grow).alias("y1"), F.lit(0).cast("bigint").alias("flow_dt"), F.lit(0).alias("degree"))
    return tie_ins.with_tie_ins(consumers.unionByName(roots).unionByName(boxes), network_segments(rows))


def network_segments(rows: DataFrame) -> DataFrame:
    """scene, line, k, last, ax, ay, bx, by_ of the heat network; each part of a MultiLineString is a line of its own."""
    lines = rows.where("object_type = 'heat_network' AND gtype IN ('LineString', 'MultiLineString')")
    parts = F.when(F.col("gtype") == "LineString", F.array("lonlat")).otherwise(F.from_json(F.get_json_object("feature", "$.geometry.coordinates"), "array<array<array<double>>>"))
    each = lines.select(F.xxhash64("file").alias("scene"), "index", F.posexplode(parts).alias("part", "line"))
    each = each.select("scene", F.struct("index", "part").alias("line"), F.transform("line", lambda p: G.to_metric(p[0], p[1])).alias("at")).where("size(at) > 1")
    pieces = each.select("scene", "line", "at", F.explode(F.sequence(F.lit(1), F.size("at") - 1)).alias("k"))
    a, b = F.element_at("at", F.col("k")), F.element_at("at", F.col("k") + 1)
    return pieces.select("scene", F.col("line.index").cast("bigint").alias("line"), F.col("line.part").alias("part"), "k", (F.size("at") - 1).alias("last"), a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by_"))


def table_of_rules(spark: SparkSession) -> DataFrame:
    return rules.table(spark, "rules").select("restriction_type", "kind", "clearance_mm")


def run(spark: SparkSession, path: str) -> Job:
    """Plan all scenes under ``path``; nothing is written but intermediate tables."""
    rows = table(geojson.typed(split.read(spark, path)), "features")
    planned = table(scene_features(rows), "planned")
    links = table(routing.plan_scenes(planned), "links")
    return Job(rows, geojson.diagnostics(rows), links, routing.ranked_variants(links), planned)


def write_report(job: Job, path: str) -> None:
    """CSV of the links of the ranked variants."""
    kept = job.links.join(job.variants.select("scene", "strategy", "rank"), ["scene", "strategy"])
    columns = ["scene", "rank", "child", "parent", "flow_dt", "du", "length_mm", "cost"]
    geojson.write_csv(kept.select(*columns), path, tuple(columns), order=("scene", "rank", "child"))
