"""GeoJSON functions over features rendered from the scene."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ...functions import geometry as G
from ...operators import shared
from ...sources import geojson, split
from ..catalog import query


def rendered(s):
    """Features of the scene as JSON text, some of them broken."""
    lon, lat = 37 + F.col("x") / 1000, 55 + F.col("y") / 10000
    props = F.struct(F.col("id").alias("id"), F.when(F.col("id") % 17 == 0, "Lamp").otherwise(" Consumer ").alias("object_type"), F.when(F.col("id") % 11 != 0, F.col("flow_dt") / 10).alias("flow_tph"))
    geometry = F.when(F.col("id") % 13 != 0, geojson.point_geometry(F.when(F.col("id") % 19 == 0, F.lit(500.0)).otherwise(lon), lat))
    text = geojson.feature(geometry, props)
    return s.consumers.select(F.lit("scene").alias("file"), F.col("id").cast("int").alias("index"), F.when(F.col("id") % 23 != 0, text).alias("feature"))


CASES = """SELECT severity, code, id::INT AS index FROM (
  SELECT 'ERROR' AS severity, 'BAD_FEATURE' AS code, id FROM consumers WHERE id % 23 = 0
  UNION ALL SELECT 'WARN', 'UNKNOWN_OBJECT_TYPE', id FROM consumers WHERE id % 23 <> 0 AND id % 17 = 0
  UNION ALL SELECT 'ERROR', 'MISSING_GEOMETRY', id FROM consumers WHERE id % 23 <> 0 AND id % 17 <> 0 AND id % 13 = 0
  UNION ALL SELECT 'ERROR', 'COORDINATE_OUT_OF_RANGE', id FROM consumers WHERE id % 23 <> 0 AND id % 17 <> 0 AND id % 13 <> 0 AND id % 19 = 0
  UNION ALL SELECT 'ERROR', 'MISSING_FLOW', id FROM consumers WHERE id % 23 <> 0 AND id % 17 <> 0 AND id % 11 = 0) x"""


@query("d01_feature_diagnostics", "consumers", oracle=CASES)
def diagnostics(s):
    return geojson.diagnostics(geojson.typed(rendered(s))).select("severity", "code", "index")


@query("s02_typed_features", "consumers", oracle="""SELECT id::INT AS index, CAST(id AS VARCHAR) AS id_text, CASE WHEN id % 17 = 0 THEN 'lamp' ELSE 'consumer' END AS object_type, CASE WHEN id % 11 <> 0 THEN flow_dt END AS flow_dt FROM consumers WHERE id % 23 <> 0""")
def typed(s):
    return geojson.typed(rendered(s)).where("feature IS NOT NULL").select("index", "id_text", "object_type", F.floor(F.col("flow_tph") * 10 + 0.5).cast("bigint").alias("flow_dt"))


@query("s07_retained_bytes", "consumers", oracle="SELECT id::INT AS index, sum(CASE WHEN id % 23 = 0 OR id % 13 = 0 THEN 256 ELSE 256 + 24 + 128 END) OVER (ORDER BY id)::BIGINT AS running FROM consumers")
def retained(s):
    return geojson.retained_bytes(geojson.typed(rendered(s))).select("index", "running")


@query("s08_retained_polygons", "consumers", oracle="""SELECT id::INT AS index, (256 + CASE CAST(id % 3 AS INT) WHEN 0 THEN 24 * 10 + 128 + 128 WHEN 1 THEN 24 * 15 + 128 * 2 + 128 ELSE 24 * 2 + 128 END)::BIGINT AS own FROM consumers""")
def retained_polygons(s):
    """Polygons with a hole, pairs of polygons of which one has a hole, and lines."""
    x, y = 37 + F.col("x") / 1000, 55 + F.col("y") / 10000
    ring = lambda d: F.array(*(F.array(x + dx * d, y + dy * d) for dx, dy in ((0, 0), (1, 0), (1, 1), (0, 1), (0, 0))))
    shape = lambda kind, c: F.struct(F.lit(kind).alias("type"), c.alias("coordinates"))
    texts = [geojson.feature(shape(k, c), F.struct("id")) for k, c in (("Polygon", F.array(ring(0.1), ring(0.01))), ("MultiPolygon", F.array(F.array(ring(0.1), ring(0.01)), F.array(ring(0.2)))), ("LineString", F.array(F.array(x, y), F.array(y, x))))]
    rows = s.consumers.select(F.lit("scene").alias("file"), F.col("id").cast("int").alias("index"), F.when(F.col("id") % 3 == 0, texts[0]).when(F.col("id") % 3 == 1, texts[1]).otherwise(texts[2]).alias("feature"))
    return geojson.retained_bytes(geojson.typed(rows)).select("index", "own")


@query("s01_split_scan", "consumers", oracle="SELECT (row_number() OVER (ORDER BY id) - 1)::INT AS index, CASE WHEN id % 23 <> 0 THEN id END AS id, CASE WHEN id % 23 <> 0 THEN CASE WHEN id % 17 = 0 THEN 'lamp' ELSE 'consumer' END END AS object_type FROM consumers")
def split_scan(s):
    """All consumers written as one collection, then read by as many tasks as the file has splits."""
    path = f"{shared.folder(s.spark).rstrip('/')}/collection-{uuid.uuid4().hex}"
    geojson.write(rendered(s), path, "scene", ["index"])
    return geojson.typed(split.read(s.spark, path)).select("index", F.col("id_text").cast("bigint").alias("id"), "object_type")


@query("d02_document_summary", "consumers", oracle="SELECT count(*) FILTER (id % 23 <> 0 AND id % 17 <> 0)::BIGINT AS consumers, count(*)::BIGINT AS features, 'NO_HEAT_NETWORK,NO_SOURCE' AS lacking FROM consumers")
def summary(s):
    return geojson.summary(geojson.typed(rendered(s))).select(F.col("consumer").alias("consumers"), "features", F.array_join("lacking", ",").alias("lacking"))


@query("s04_encoded_lines", "vertices", oracle="SELECT id, count(*)::BIGINT AS points FROM vertices GROUP BY id")
def encoded(s):
    """Lines to GeoJSON and back keep their points."""
    from .formulas import lines

    moved = lines(s).select("id", F.transform("line", lambda p: F.struct((p["x"] + 412000).alias("x"), (p["y"] + 6179000).alias("y"))).alias("line"))
    text = geojson.feature(geojson.line_geometry(F.col("line")), F.struct(F.col("id"), F.lit("heat_network").alias("object_type")))
    back = geojson.typed(moved.select("id", "line", F.lit("f").alias("file"), F.col("id").cast("int").alias("index"), text.alias("feature")).drop("id"))
    same = F.size(F.filter(F.zip_with("points", "line", lambda a, b: G.distance(a, b)), lambda d: d < 0.01))
    return back.select(F.col("id_text").cast("bigint").alias("id"), same.cast("bigint").alias("points"))
