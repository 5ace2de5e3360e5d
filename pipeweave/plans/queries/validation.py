"""Validation rules over a tampered output."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...operators import validate as V
from ..catalog import query


def issue(code, condition, source="out_lines", severity="ERROR"):
    return f"SELECT '{severity}' AS severity, '{code}' AS code, id FROM {source} WHERE {condition}"


SCHEMA = " UNION ALL ".join(issue(c, w) for c, w in {
    "BAD_OBJECT_TYPE": "object_type NOT IN ('heat_network', 'heat_chamber', 'technical_node', 'variant_summary')", "MISSING_VARIANT_ID": "variant IS NULL", "MISSING_ATTRIBUTE": "depth0_mm IS NULL OR depth1_mm IS NULL",
    "BAD_LAYING_METHOD": "laying NOT IN ('base', 'special')", "BAD_FLOW": "flow_dt <= 0", "BAD_DIAMETER": "du NOT IN (SELECT du FROM du_table)", "BAD_LENGTH": "abs(length_mm - true_mm) > 20", "DEGENERATE_LINE": "start_node = end_node"}.items())


@query("v01_line_schema", "out_lines", "du_table", oracle=SCHEMA)
def line_schema(s):
    return V.line_schema(s.out_lines)


@query("v02_duplicate_ids", "out_lines", oracle="SELECT 'ERROR' AS severity, 'DUPLICATE_ID' AS code, id FROM (SELECT id, row_number() OVER (PARTITION BY out_id ORDER BY id) AS k FROM out_lines) x WHERE k > 1")
def duplicate_ids(s):
    return V.duplicate_ids(s.out_lines)


@query("v09_references", "out_lines", "out_nodes", oracle=issue("UNRESOLVED_NODE", "end_node NOT IN (SELECT id FROM out_nodes)"))
def references(s):
    return V.references(s.out_lines, s.out_nodes)


MET = "WITH met AS (SELECT n.id, n.kind, count(e.id) AS n FROM out_nodes n LEFT JOIN (SELECT start_node AS id FROM out_lines UNION ALL SELECT end_node FROM out_lines) e ON e.id = n.id GROUP BY n.id, n.kind) "


@query("v10_degrees", "out_lines", "out_nodes", oracle=MET + " UNION ALL ".join([
    issue("OKS_DEGREE", "kind = 'consumer' AND n <> 1", "met"), issue("TECHNICAL_NODE_DEGREE", "kind = 'technical_node' AND n <> 2", "met"),
    issue("CHAMBER_DEGREE", "kind IN ('heat_chamber', 'existing_chamber') AND n > 4", "met"), issue("ORPHAN_CHAMBER", "kind = 'heat_chamber' AND n = 0", "met")]))
def degrees(s):
    return V.degrees(s.out_lines, s.out_nodes)


@query("v15_unconnected_list", "consumers", "links", oracle="""WITH listed AS (SELECT id FROM consumers WHERE id % 7 = 0 UNION ALL SELECT id FROM consumers WHERE id % 49 = 0 UNION ALL SELECT -5), once AS (SELECT DISTINCT id FROM listed), connected AS (SELECT child AS id FROM links WHERE child % 7 <> 0 OR child % 21 = 0)
  SELECT 'ERROR' AS severity, 'BAD_UNCONNECTED' AS code, id FROM once WHERE id NOT IN (SELECT id FROM consumers) UNION ALL SELECT 'ERROR', 'DUPLICATE_UNCONNECTED', id FROM listed GROUP BY id HAVING count(*) > 1
  UNION ALL SELECT 'ERROR', 'UNCONNECTED_MISMATCH', id FROM once WHERE id IN (SELECT id FROM connected) UNION ALL SELECT 'ERROR', 'UNCONNECTED_MISMATCH', id FROM consumers WHERE id NOT IN (SELECT id FROM connected) AND id NOT IN (SELECT id FROM once)""")
def unconnected_list(s):
    ids = s.consumers.select("id")
    listed = ids.where("id % 7 = 0").unionByName(ids.where("id % 49 = 0")).unionByName(s.spark.range(1).select(F.lit(-5).cast("bigint").alias("id")))
    return V.unconnected_list(listed, s.links.where("child % 7 <> 0 OR child % 21 = 0").select(F.col("child").alias("id")), ids)


@query("v16_unnecessary_nodes", "out_lines", "out_nodes", oracle="""WITH e AS (SELECT start_node AS id, laying, du, flow_dt, crossed_type FROM out_lines UNION ALL SELECT end_node, laying, du, flow_dt, crossed_type FROM out_lines)
  SELECT 'WARN' AS severity, 'UNNECESSARY_TECHNICAL_NODE' AS code, n.id FROM out_nodes n JOIN (SELECT id FROM e GROUP BY id HAVING count(*) = 2 AND count(DISTINCT concat(laying, '|', du, '|', flow_dt, '|', coalesce(crossed_type, ''))) = 1) x ON x.id = n.id WHERE n.kind = 'technical_node'""")
def unnecessary(s):
    return V.unnecessary_nodes(s.out_lines, s.out_nodes)


@query("v17_hydraulics", "out_lines", "du_table", oracle="WITH sized AS (SELECT * FROM out_lines JOIN du_table USING (du)) " + issue("CAPACITY", "flow_dt > cap_dt", "sized") + " UNION ALL " + issue("MAX_LENGTH", "length_mm > max_length_m * 1000", "sized") +
       " UNION ALL SELECT 'ERROR', 'DU_DECREASES', a.id FROM out_lines a JOIN out_lines b ON b.start_node = a.end_node WHERE b.du < a.du")
def hydraulics(s):
    return V.hydraulics(s.out_lines, s.du_table)


@query("v20_line_cost", "out_lines", "du_table", oracle="SELECT 'ERROR' AS severity, 'LINE_COST' AS code, id FROM (SELECT id, length_mm / 1000.0::DOUBLE * cost_m * kspec_pct / 100 AS wanted, true_mm / 1000.0::DOUBLE * cost_m * kspec_pct / 100 AS given FROM out_lines JOIN du_table USING (du)) x WHERE abs(wanted - given) > 1 + 1e-6 * wanted")
def line_cost(s):
    given = F.col("true_mm") / 1000 * F.col("cost_m") * F.col("kspec_pct") / 100
    return V.line_cost(s.out_lines, s.du_table, given)


@query("v21_chamber_cost", "out_nodes", oracle=issue("CHAMBER_COST", "kind = 'heat_chamber' AND cost <> CASE WHEN du <= 200 THEN 3000000 WHEN du <= 500 THEN 5000000 WHEN du <= 1000 THEN 8000000 ELSE 12000000 END", "out_nodes"))
def chamber_cost(s):
    return V.chamber_rules(s.out_nodes)


@query("v24_planar_depths", "out_lines", oracle=issue("DEPTH_NOT_NULL", "depth0_mm IS NOT NULL OR depth1_mm IS NOT NULL"))
def planar(s):
    return V.depth_rules(s.out_lines, "PLANAR")


@query("v29_crossing_angles", "out_lines", "rules", oracle="SELECT 'ERROR' AS severity, 'CROSSING_ANGLE' AS code, id FROM out_lines JOIN rules ON restriction_type = crossed_type WHERE min_angle > 0 AND least(angle, 180 - angle) < min_angle")
def angles(s):
    return V.crossing_angles(s.out_lines, s.rules)


@query("v30_depth_rules", "out_lines", oracle=" UNION ALL ".join([issue("DEPTH_REQUIRED", "depth0_mm IS NULL OR depth1_mm IS NULL"), issue("DEPTH_MIN", "least(depth0_mm, depth1_mm) < 700"), issue("DEPTH_SANITY", "greatest(depth0_mm, depth1_mm) > 100000"),
    issue("DEPTH_SLOPE", "abs(depth1_mm - depth0_mm) * 10 > length_mm + 2"), issue("DEPTH_3M_SPLIT", "depth0_mm < 3000 AND depth1_mm > 3000 OR depth0_mm > 3000 AND depth1_mm < 3000")]))
def depth_rules(s):
    return V.depth_rules(s.out_lines)


@query("v31_crossing_depths", "out_lines", "vertical_rules", "du_table", oracle="""WITH met AS (SELECT l.id, l.crossed_type, v.method, v.min_cover_mm, least(depth0_mm, depth1_mm) AS lo, greatest(depth0_mm, depth1_mm) AS hi, depth0_mm <> depth1_mm AS sloped, top_mm - gap_mm - d.height_mm AS above, greatest(700, top_mm + coalesce(v.height_mm, d.height_mm) + gap_mm) AS below
  FROM out_lines l JOIN vertical_rules v ON v.restriction_type = l.crossed_type JOIN du_table d USING (du)) """ + " UNION ALL ".join([issue("ROAD_DEPTH", "crossed_type = 'road' AND lo < min_cover_mm", "met"), issue("TRAM_DEPTH", "crossed_type = 'tram_tracks' AND lo < min_cover_mm", "met"),
    issue("VERTICAL_CLEARANCE", "method = 'GAP' AND NOT (hi <= above OR lo >= below)", "met"), issue("CONSTANT_CROSSING_DEPTH", "sloped", "met")]))
def crossing_depths(s):
    return V.crossing_depths(s.out_lines, s.vertical_rules, s.du_table)


@query("v32_depth_continuity", "out_lines", oracle="SELECT 'ERROR' AS severity, 'DEPTH_CONTINUITY' AS code, id FROM (SELECT start_node AS id, depth0_mm AS d FROM out_lines UNION ALL SELECT end_node, depth1_mm FROM out_lines) e GROUP BY id HAVING max(d) - min(d) > 1")
def continuity(s):
    return V.depth_continuity(s.out_lines)


@query("a13_validation_verdict", "out_lines", "du_table", oracle=f"""SELECT CASE WHEN code IN ('BAD_OBJECT_TYPE', 'MISSING_VARIANT_ID', 'MISSING_ATTRIBUTE') THEN 'SCHEMA' WHEN code = 'DEGENERATE_LINE' THEN 'TOPOLOGY' ELSE 'LINE' END AS family, code, count(*)::BIGINT AS n, count(*) FILTER (severity = 'ERROR')::BIGINT AS errors FROM ({SCHEMA}) i GROUP BY 1, 2""")
def verdict(s):
    return V.verdict(V.line_schema(s.out_lines))


@query("p23_crossing_status", "out_lines", "vertical_rules", oracle="SELECT crossed_type, count(*) FILTER (least(depth0_mm, depth1_mm) >= min_cover_mm)::BIGINT AS ok, count(*) FILTER (least(depth0_mm, depth1_mm) < min_cover_mm)::BIGINT AS bad FROM out_lines JOIN vertical_rules ON restriction_type = crossed_type WHERE method = 'COVER' GROUP BY 1")
def status(s):
    cover = s.vertical_rules.where("method = 'COVER'").select(F.col("restriction_type").alias("crossed_type"), "min_cover_mm")
    ok = F.least("depth0_mm", "depth1_mm") >= F.col("min_cover_mm")
    return s.out_lines.join(F.broadcast(cover), "crossed_type").groupBy("crossed_type").agg(F.count_if(ok).alias("ok"), F.count_if(~ok).alias("bad"))


@query("g18_collinear_continuation", "vertices", oracle="""SELECT id, k FROM (SELECT id, k, row_number() OVER (PARTITION BY id ORDER BY t, k) AS r FROM (SELECT id, k, degrees(abs(CASE WHEN d > pi() THEN d - 2*pi() WHEN d <= -pi() THEN d + 2*pi() ELSE d END)) AS t
  FROM (SELECT id, k, atan2(ny - y, nx - x) - atan2(y - py, x - px) AS d FROM (SELECT id, k, x, y, lag(x) OVER w AS px, lag(y) OVER w AS py, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM vertices WINDOW w AS (PARTITION BY id ORDER BY k)) a WHERE k BETWEEN 1 AND 4) b) c WHERE t < 20) e WHERE r = 1""")
def continuation(s):
    """The straightest vertex of a path, if its turn is small."""
    from ...functions import geometry as G
    from .formulas import lines

    at = lambda i: F.element_at("line", i)
    turns = F.transform(F.sequence(F.lit(2), F.size("line") - 1), lambda i: F.struct(G.turn_angle(at(i - 1), at(i), at(i + 1)).alias("t"), (i - 1).alias("k")))
    best = F.array_min(F.filter(turns, lambda z: z["t"] < 20))
    return lines(s).select("id", best.alias("b")).where("b IS NOT NULL").select("id", "b.k")
