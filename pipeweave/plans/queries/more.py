"""Further joins, aggregates, lists and rules over the scene."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ...functions import engineering as E
from ...functions import geometry as G
from ...functions import text as T
from ...operators import costs, graph, intervals, lookups, spatial
from ...operators import validate as V
from ..catalog import query
from .formulas import MICRO, STEPS, TURN, lines, micro
from .lookups import PRICED, TYPES
from .trees import PATHS

D2 = "(c.x-h.x)*(c.x-h.x)+(c.y-h.y)*(c.y-h.y)"


def others(s):
    return s.chambers.select(F.col("id").alias("chamber"), F.col("x").alias("rx"), F.col("y").alias("ry"))


@query("j14_line_projections", "consumers", "net_lines", oracle=f"SELECT c.id, l.id AS line, {MICRO.format('least(greatest(c.x, 0), 2000)')} AS measure_micro FROM consumers c JOIN net_lines l ON abs(c.y - l.ay) <= 60 WHERE c.x <= 2000")
def projections(s):
    near = spatial.points_near_segments(s.consumers, s.net_lines.withColumnRenamed("id", "line"), 60.0).where("x <= 2000")
    line = F.array(F.struct(F.col("ax").alias("x"), F.col("ay").alias("y")), F.struct(F.col("bx").alias("x"), F.col("by_").alias("y")))
    return near.select("id", "line", micro(G.project(line, F.struct("x", "y"))).alias("measure_micro"))


@query("j15_resolved_references", "out_lines", "out_nodes", "chambers", oracle="SELECT l.id, coalesce(n.kind, CASE WHEN h.id IS NOT NULL THEN 'chamber' END, 'UNRESOLVED') AS target FROM out_lines l LEFT JOIN out_nodes n ON n.id = l.end_node AND n.kind <> 'consumer' LEFT JOIN chambers h ON h.id = l.end_node")
def resolved(s):
    """A node of the variant first, else a chamber of the input."""
    nodes = s.out_nodes.where("kind <> 'consumer'").select(F.col("id").alias("end_node"), "kind")
    out = s.out_lines.join(nodes, "end_node", "left").join(s.chambers.select(F.col("id").alias("end_node"), F.lit("chamber").alias("other")), "end_node", "left")
    return out.select("id", F.coalesce("kind", "other", F.lit("UNRESOLVED")).alias("target"))


@query("j19_parent_lines", "out_lines", oracle="SELECT a.id, b.id AS parent_line FROM out_lines a JOIN out_lines b ON b.start_node = a.end_node")
def parent_lines(s):
    return s.out_lines.join(s.out_lines.select(F.col("start_node").alias("end_node"), F.col("id").alias("parent_line")), "end_node").select("id", "parent_line")


@query("j22_piece_passages", "pieces", "sections", oracle="SELECT p.id, count(*)::BIGINT AS passages, max(x.kspec_pct)::BIGINT AS kspec_pct FROM pieces p JOIN sections x ON x.link = p.id AND x.s0 <= p.length_mm / 2000.0::DOUBLE AND p.length_mm / 2000.0::DOUBLE <= x.s1 GROUP BY p.id")
def passages(s):
    """Sections that hold the middle of a piece."""
    middle = F.col("length_mm") / 2000
    met = s.pieces.join(s.sections.withColumnRenamed("link", "id"), "id").where((F.col("s0") <= middle) & (middle <= F.col("s1")))
    return met.groupBy("id").agg(F.count(F.lit(1)).alias("passages"), F.max("kspec_pct").alias("kspec_pct"))


@query("j23_section_overlaps", "sections", oracle="SELECT a.link, a.obstacle AS a, b.obstacle AS b, CAST(least(a.s1, b.s1) - greatest(a.s0, b.s0) AS BIGINT) AS overlap FROM sections a JOIN sections b ON a.link = b.link AND a.obstacle < b.obstacle AND least(a.s1, b.s1) - greatest(a.s0, b.s0) > 0.01")
def overlaps(s):
    b = s.sections.select("link", F.col("obstacle").alias("b"), F.col("s0").alias("t0"), F.col("s1").alias("t1"))
    both = s.sections.withColumnRenamed("obstacle", "a").join(b, "link").where("a < b").withColumn("overlap", F.least("s1", "t1") - F.greatest("s0", "t0"))
    return both.where("overlap > 0.01").select("link", "a", "b", F.col("overlap").cast("bigint").alias("overlap"))


@query("a03_link_cost", "pieces", "du_table", oracle=PRICED + "SELECT link, sum(cost)::BIGINT AS cost FROM (SELECT q.link, r.cost FROM priced r JOIN pieces q USING (id)) z GROUP BY link")
def link_cost(s):
    return costs.priced(s.pieces, s.du_table).groupBy("link").agg(F.sum("cost").alias("cost"))


@query("a09_attachments", "pieces", oracle="SELECT variant, count(DISTINCT link)::BIGINT AS roots, string_agg(DISTINCT laying, ',' ORDER BY laying) AS layings FROM pieces GROUP BY variant")
def attachments(s):
    return s.pieces.groupBy("variant").agg(F.count_distinct("link").alias("roots"), F.array_join(F.array_sort(F.collect_set("laying")), ",").alias("layings"))


@query("a12_diagnostic_counts", "out_lines", oracle="SELECT count(*) FILTER (du = 110)::BIGINT AS errors, count(*) FILTER (flow_dt <= 0)::BIGINT AS warnings, bool_or(du = 110) AS has_errors FROM out_lines")
def diagnostic_counts(s):
    return s.out_lines.agg(F.count_if(F.col("du") == 110).alias("errors"), F.count_if(F.col("flow_dt") <= 0).alias("warnings"), F.bool_or(F.col("du") == 110).alias("has_errors"))


@query("a14_operation_metrics", "pieces", oracle="SELECT laying, sum(flow_dt)::BIGINT AS total, max(length_mm)::BIGINT AS largest FROM pieces GROUP BY laying")
def metrics(s):
    return s.pieces.groupBy("laying").agg(F.sum("flow_dt").alias("total"), F.max("length_mm").alias("largest"))


@query("a15_graph_statistics", "links", oracle="SELECT count(*)::BIGINT AS edges, count(DISTINCT parent)::BIGINT AS inner_nodes, sum(length_mm)::BIGINT AS length_mm, max(length_mm)::BIGINT AS longest_mm FROM links")
def statistics(s):
    return s.links.agg(F.count(F.lit(1)).alias("edges"), F.count_distinct("parent").alias("inner_nodes"), F.sum("length_mm").alias("length_mm"), F.max("length_mm").alias("longest_mm"))


@query("a19_rejections", "out_lines", oracle="SELECT laying AS code, count(*)::BIGINT AS n FROM out_lines WHERE laying <> 'base' GROUP BY laying")
def rejections(s):
    return s.out_lines.where("laying <> 'base'").groupBy(F.col("laying").alias("code")).agg(F.count(F.lit(1)).alias("n"))


@query("a21_crossings_by_mode", "out_lines", oracle="SELECT crossed_type, count(*) FILTER (id % 2 = 0)::BIGINT AS planar, count(*) FILTER (id % 2 = 1)::BIGINT AS depth FROM out_lines WHERE crossed_type IS NOT NULL GROUP BY crossed_type")
def by_mode(s):
    mode = F.when(F.col("id") % 2 == 0, "planar").otherwise("depth")
    return s.out_lines.where("crossed_type IS NOT NULL").withColumn("mode", mode).groupBy("crossed_type").pivot("mode", ["planar", "depth"]).agg(F.count(F.lit(1))).fillna(0)


@query("a24_reason_classes", "out_lines", oracle="SELECT count(*) FILTER (laying = 'special')::BIGINT AS special, count(*) FILTER (laying = 'base')::BIGINT AS base, count(*) FILTER (laying NOT IN ('special', 'base'))::BIGINT AS other FROM out_lines")
def reasons(s):
    reason = F.concat(F.lit("laid as "), "laying")
    return s.out_lines.agg(F.count_if(reason.rlike("special$")).alias("special"), F.count_if(reason.rlike("base$")).alias("base"), F.count_if(~reason.rlike("(special|base)$")).alias("other"))


SPLIT = """WITH cut AS (SELECT link, greatest(s0, 0) AS s0, least(s1, 450) AS s1, kspec_pct FROM sections), bounds AS (SELECT link, s0 AS s FROM cut UNION SELECT link, s1 FROM cut UNION SELECT link, CAST(0 AS DOUBLE) FROM cut UNION SELECT link, CAST(450 AS DOUBLE) FROM cut),
  cells AS (SELECT link, s AS lo, lead(s) OVER (PARTITION BY link ORDER BY s) AS hi FROM bounds)
  SELECT c.link, c.lo, c.hi, coalesce(max(x.kspec_pct), 100)::BIGINT AS kspec_pct FROM cells c LEFT JOIN cut x ON x.link = c.link AND x.s0 <= c.lo AND c.hi <= x.s1 WHERE c.hi IS NOT NULL GROUP BY c.link, c.lo, c.hi"""


@query("w07_piece_split", "sections", oracle=SPLIT)
def piece_split(s):
    """Every line cut at section bounds; the largest factor holds, 100 outside."""
    cut = s.sections.select("link", F.greatest("s0", F.lit(0.0)).alias("s0"), F.least("s1", F.lit(450.0)).alias("s1"), "kspec_pct")
    whole = cut.select("link").distinct().select("link", F.lit(0.0).alias("s0"), F.lit(450.0).alias("s1"), F.lit(100).cast("bigint").alias("kspec_pct"))
    return intervals.covering_max(cut.unionByName(whole), "link", "s0", "s1", "kspec_pct").withColumnRenamed("top", "kspec_pct")


@query("f19_coverage_test", "sections", oracle="""SELECT link FROM (SELECT link, s0, s1, max(s1) OVER (PARTITION BY link ORDER BY s0, s1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM sections WHERE s1 >= 100 AND s0 <= 110) x GROUP BY link HAVING min(s0) <= 100.02 AND max(s1) >= 109.98 AND max(CASE WHEN s0 - reach > 0.02 THEN 1 ELSE 0 END) = 0""")
def coverage(s):
    covers = s.sections.groupBy("link").agg(F.collect_list(F.struct(F.col("s0").alias("lo"), F.col("s1").alias("hi"))).alias("covers"))
    return covers.where(intervals.covered(F.lit(100.0), F.lit(110.0), F.col("covers"))).select("link")


@query("w11_longitudinal_profile", "links", recursive=True, oracle=PATHS + "SELECT node, link, (sum(l.length_mm) OVER (PARTITION BY node ORDER BY step) - l.length_mm)::BIGINT AS s_mm FROM paths p JOIN links l ON l.child = p.link")
def longitudinal(s):
    walk = graph.closure(s.links).join(s.links.select(F.col("child").alias("link"), "length_mm"), "link")
    run = F.sum("length_mm").over(Window.partitionBy("node").orderBy("step"))
    return walk.select("node", "link", (run - F.col("length_mm")).alias("s_mm"))


@query("w12_overlap_with_others", "sections", oracle="""WITH m AS (SELECT *, CASE WHEN s0 > max(s1) OVER (PARTITION BY link ORDER BY s0, s1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1e-6 THEN 1 ELSE 0 END AS fresh FROM sections), i AS (SELECT *, sum(fresh) OVER (PARTITION BY link ORDER BY s0, s1 ROWS UNBOUNDED PRECEDING) AS island FROM m),
  u AS (SELECT link, min(s0) AS lo, max(s1) AS hi FROM i GROUP BY link, island) SELECT link, CAST(sum(hi - lo) AS BIGINT) AS shared FROM u GROUP BY link""")
def overlap(s):
    return intervals.merge(s.sections, "link", "s0", "s1").groupBy("link").agg(F.sum(F.col("hi") - F.col("lo")).cast("bigint").alias("shared"))


@query("t02_top_targets", "consumers", "chambers", oracle=f"SELECT id, chamber FROM (SELECT c.id, h.id AS chamber, row_number() OVER (PARTITION BY c.id ORDER BY {D2}, h.id) AS k FROM consumers c JOIN chambers h ON {D2} <= 600*600) x WHERE k <= 12")
def top_targets(s):
    """Twelve targets for each consumer: the bound is the feature."""
    return spatial.nearest_points(s.consumers, others(s), "chamber", 600.0, 12).select("id", "chamber")


@query("t03_best_attempt", "pieces", oracle="SELECT link, id FROM (SELECT link, id, row_number() OVER (PARTITION BY link ORDER BY length_mm, id) AS k FROM pieces) x WHERE k = 1")
def best_attempt(s):
    return s.pieces.groupBy("link").agg(F.min_by("id", F.struct("length_mm", "id")).alias("id"))


@query("t08_kept_alternatives", "pieces", oracle="SELECT link, string_agg(CAST(id AS VARCHAR), ',' ORDER BY length_mm, id) AS alternatives FROM (SELECT link, id, length_mm, row_number() OVER (PARTITION BY link ORDER BY length_mm, id) AS k FROM pieces) x WHERE k BETWEEN 2 AND 4 GROUP BY link")
def alternatives(s):
    """Three alternatives besides the best: the bound is the feature."""
    ranked = s.pieces.withColumn("k", F.row_number().over(Window.partitionBy("link").orderBy("length_mm", "id"))).where("k BETWEEN 2 AND 4")
    return ranked.groupBy("link").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "id"))), lambda z: z["id"].cast("string")), ",").alias("alternatives"))


@query("t10_lexicographic_choice", "pieces", oracle="SELECT variant, id FROM (SELECT variant, id, row_number() OVER (PARTITION BY variant ORDER BY flow_dt // 1000, depth0_mm, depth1_mm, id) AS k FROM pieces) x WHERE k = 1")
def lexicographic(s):
    return s.pieces.groupBy("variant").agg(F.min_by("id", F.struct(F.expr("flow_dt div 1000"), "depth0_mm", "depth1_mm", "id")).alias("id"))


@query("u03_reserved_ids", "consumers", "chambers", "net_lines", oracle="SELECT id FROM consumers UNION SELECT id FROM chambers UNION SELECT id FROM net_lines")
def reserved(s):
    return s.consumers.select("id").union(s.chambers.select("id")).union(s.net_lines.select("id")).distinct()


@query("u04_output_rows", "out_lines", "out_nodes", oracle="SELECT 1 AS place, id, length_mm, NULL::VARCHAR AS kind FROM out_lines UNION ALL SELECT CASE kind WHEN 'heat_chamber' THEN 2 ELSE 3 END, id, NULL, kind FROM out_nodes")
def output_rows(s):
    lines_ = s.out_lines.select(F.lit(1).alias("place"), "id", "length_mm")
    nodes = s.out_nodes.select(F.when(F.col("kind") == "heat_chamber", 2).otherwise(3).alias("place"), "id", "kind")
    return lines_.unionByName(nodes, allowMissingColumns=True)


@query("u07_junction_positions", "net_lines", oracle="SELECT id, CAST(m AS DOUBLE) AS measure FROM net_lines, LATERAL (SELECT unnest(range(20, 2000, 20)) AS m) u WHERE NOT (m BETWEEN 500 AND 540)")
def junctions(s):
    grid = F.filter(G.sample_measures(F.col("bx") - F.col("ax"), 20.0), lambda m: (m > 0) & (m < F.col("bx") - F.col("ax")) & ~m.between(500, 540))
    return s.net_lines.select("id", F.explode(grid).alias("measure"))


@query("f42_output_flow", "pieces", oracle="SELECT id, CAST(flow_dt AS BIGINT) AS flow_dt FROM pieces")
def output_flow(s):
    return s.pieces.select("id", F.floor(E.output_flow(F.col("flow_dt") / 10) * 10 + 0.5).cast("bigint").alias("flow_dt"))


@query("f45_depth_at_measure", "pieces", oracle=f"SELECT id, {MICRO.format('depth0_mm + (depth1_mm - depth0_mm) * 0.25::DOUBLE')} AS depth_micro FROM pieces")
def depth_at(s):
    profile = F.array(F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y")), F.struct(F.col("length_mm").cast("double").alias("x"), F.lit(0.0).alias("y")))
    share = G.project(profile, F.struct((F.col("length_mm") * 0.25).alias("x"), F.lit(1.0).alias("y"))) / F.col("length_mm")
    return s.pieces.select("id", micro(F.col("depth0_mm") + (F.col("depth1_mm") - F.col("depth0_mm")) * share).alias("depth_micro"))


@query("f46_normal_depth_splits", "pieces", oracle="SELECT id, CAST(floor(length_mm * ((3000 - depth0_mm)::DOUBLE / (depth1_mm - depth0_mm)) + 0.5) AS BIGINT) AS s_mm FROM pieces WHERE (depth0_mm - 3000) * (depth1_mm - 3000) < 0")
def splits(s):
    at = F.col("length_mm") * ((3000 - F.col("depth0_mm")).cast("double") / (F.col("depth1_mm") - F.col("depth0_mm")))
    return s.pieces.where("(depth0_mm - 3000) * (depth1_mm - 3000) < 0").select("id", E.half_up(at).alias("s_mm"))


@query("f48_profile_statistics", "pieces", oracle="SELECT variant, max(abs(depth1_mm - depth0_mm) * 1000000 // length_mm)::BIGINT AS steepest_ppm, count(*) FILTER (depth0_mm <> depth1_mm)::BIGINT AS transitions, max(greatest(depth0_mm, depth1_mm))::BIGINT AS deepest FROM pieces GROUP BY variant")
def profile_statistics(s):
    return s.pieces.groupBy("variant").agg(F.max(F.expr("abs(depth1_mm - depth0_mm) * 1000000 div length_mm")).alias("steepest_ppm"), F.count_if(F.col("depth0_mm") != F.col("depth1_mm")).alias("transitions"), F.max(F.greatest("depth0_mm", "depth1_mm")).alias("deepest"))


@query("f51_max_adjacent_du", "out_lines", "out_nodes", oracle="SELECT n.id, greatest(max(e.du), 0)::INT AS du, count(*)::BIGINT AS degree, (4 - count(*))::BIGINT AS spare FROM out_nodes n JOIN (SELECT start_node AS id, du FROM out_lines UNION ALL SELECT end_node, du FROM out_lines) e ON e.id = n.id GROUP BY n.id")
def adjacent(s):
    ends = s.out_lines.select(F.explode(F.array("start_node", "end_node")).alias("id"), "du")
    return s.out_nodes.select("id").join(ends, "id").groupBy("id").agg(F.max("du").alias("du"), F.count(F.lit(1)).alias("degree")).withColumn("spare", 4 - F.col("degree"))


@query("f55_unique_ids", "consumers", "chambers", oracle="SELECT c.id, CASE WHEN h.id IS NULL THEN CAST(c.id AS VARCHAR) ELSE concat(c.id, '_1') END AS out_id FROM consumers c LEFT JOIN chambers h ON h.id = c.id")
def unique_ids(s):
    taken = s.chambers.select("id", F.lit(True).alias("taken"))
    return s.consumers.select("id").join(taken, "id", "left").select("id", F.when(F.col("taken"), F.concat("id", F.lit("_1"))).otherwise(F.col("id").cast("string")).alias("out_id"))


@query("f64_crossing_details", "out_lines", "vertical_rules", oracle="SELECT crossed_type, count(*)::BIGINT AS n, min(top_mm)::BIGINT AS utility_top, max(gap_mm)::BIGINT AS required, min(least(depth0_mm, depth1_mm))::BIGINT AS shallowest FROM out_lines JOIN vertical_rules ON restriction_type = crossed_type GROUP BY crossed_type")
def crossing_details(s):
    v = s.vertical_rules.withColumnRenamed("restriction_type", "crossed_type")
    return s.out_lines.join(F.broadcast(v), "crossed_type").groupBy("crossed_type").agg(F.count(F.lit(1)).alias("n"), F.min("top_mm").alias("utility_top"), F.max("gap_mm").alias("required"), F.min(F.least("depth0_mm", "depth1_mm")).alias("shallowest"))


@query("f68_file_fingerprint", "uploads", oracle="""SELECT event_id, sha256(concat('["f', upload, '",', part, ',', event_id, ',"', sha256('a'), '","', sha256('b'), '"]')) AS fingerprint FROM uploads""")
def fingerprint(s):
    samples = F.array(F.sha2(F.lit("a"), 256), F.sha2(F.lit("b"), 256))
    return s.uploads.select("event_id", T.fingerprint(F.concat(F.lit("f"), "upload"), F.col("part"), F.col("event_id"), samples).alias("fingerprint"))


@query("r05_expired_sessions", "uploads", oracle="SELECT upload FROM uploads GROUP BY upload HAVING max(ts) + INTERVAL 24 HOURS < (SELECT max(ts) FROM uploads)")
def expired(s):
    """Sessions with no event in the last 24 hours of the table's time."""
    now = s.uploads.agg(F.max("ts").alias("now"))
    last = s.uploads.groupBy("upload").agg(F.max("ts").alias("last"))
    return last.join(F.broadcast(now), F.expr("last + INTERVAL 24 HOURS < now")).select("upload")


@query("s19_whole_verification", "uploads", oracle="SELECT upload, sha256(string_agg(sha256(CAST(event_id AS VARCHAR)), '' ORDER BY event_id)) AS whole FROM uploads GROUP BY upload")
def whole(s):
    """The parts' hashes in their order, hashed."""
    parts = F.array_sort(F.collect_list(F.struct("event_id", F.sha2(F.col("event_id").cast("string"), 256).alias("h"))))
    return s.uploads.groupBy("upload").agg(F.sha2(F.array_join(F.transform(parts, lambda p: p["h"]), ""), 256).alias("whole"))


@query("v06_line_geometry", "vertices", oracle=STEPS + "SELECT id, count(*)::BIGINT AS repeated FROM edges WHERE len < 1e-6 GROUP BY id")
def line_geometry(s):
    again = F.size(F.filter(F.transform(F.sequence(F.lit(2), F.size("line")), lambda i: G.distance(F.element_at("line", i - 1), F.element_at("line", i))), lambda d: d < 1e-6))
    return lines(s).select("id", again.cast("bigint").alias("repeated")).where("repeated > 0")


@query("v25_sharp_turns", "vertices", oracle=STEPS + f", turns AS (SELECT id, k, atan2(ny - y, nx - x) - atan2(y - py, x - px) AS d FROM steps WHERE k BETWEEN 1 AND 4) SELECT id, k FROM turns WHERE {TURN.format('d')} > 90.0001")
def sharp_turns(s):
    out = lines(s).select("id", "line", F.explode(F.sequence(F.lit(2), F.size("line") - 1)).alias("i"))
    at = lambda d: F.element_at("line", F.col("i") + d)
    return out.where(G.turn_angle(at(-1), at(0), at(1)) > 90.0001).select("id", (F.col("i") - 1).cast("int").alias("k"))


@query("v22_summary_rules", "pieces", "du_table", oracle=PRICED + ", s AS (SELECT variant, sum(cost)::BIGINT AS cost, sum(length_mm)::BIGINT AS length_mm FROM priced GROUP BY variant), g AS (SELECT *, cost + CASE WHEN variant = 2 THEN 5 ELSE 1 END AS told_cost, length_mm + CASE WHEN variant = 3 THEN 80 ELSE 20 END AS told_mm FROM s) SELECT variant, CASE WHEN abs(told_cost - cost) > 2 THEN 'SUMMARY_CONSTRUCTION' ELSE 'SUMMARY_LENGTH' END AS code FROM g WHERE abs(told_cost - cost) > 2 OR abs(told_mm - length_mm) > 50")
def summary_rules(s):
    own = costs.priced(s.pieces, s.du_table).groupBy("variant").agg(F.sum("cost").alias("cost"), F.sum("length_mm").alias("length_mm"))
    told = own.withColumn("told_cost", F.col("cost") + F.expr("CASE WHEN variant = 2 THEN 5 ELSE 1 END")).withColumn("told_mm", F.col("length_mm") + F.expr("CASE WHEN variant = 3 THEN 80 ELSE 20 END"))
    return V.emitted(told, {"SUMMARY_CONSTRUCTION": F.abs(F.col("told_cost") - F.col("cost")) > 2, "SUMMARY_LENGTH": F.abs(F.col("told_mm") - F.col("length_mm")) > 50}, ["variant"]).select("variant", "code")


@query("v33_depth_summary", "pieces", oracle="SELECT variant, max(greatest(depth0_mm, depth1_mm))::BIGINT AS max_mm, sum(CASE WHEN crossed_bits % 2 = 1 THEN 1 ELSE 0 END)::BIGINT AS crossings FROM pieces GROUP BY variant")
def depth_summary(s):
    return s.pieces.groupBy("variant").agg(F.max(F.greatest("depth0_mm", "depth1_mm")).alias("max_mm"), F.count_if(F.col("crossed_bits") % 2 == 1).alias("crossings"))


@query("p13_inside_special", "sections", oracle="SELECT link, count(*)::BIGINT AS n FROM sections WHERE 120 BETWEEN s0 - 1 AND s1 + 1 GROUP BY link")
def inside_special(s):
    held = s.sections.groupBy("link").agg(F.collect_list(F.struct("s0", "s1")).alias("iv"))
    n = F.size(F.filter("iv", lambda i: (i["s0"] - 1 <= 120) & (F.lit(120) <= i["s1"] + 1)))
    return held.select("link", n.cast("bigint").alias("n")).where("n > 0")


@query("p14_target_policies", "chambers", oracle="SELECT policy, count(*)::BIGINT AS n FROM (SELECT unnest(['ANY', 'NEW_ONLY', 'EXISTING_ONLY']) AS policy) p, chambers WHERE policy = 'ANY' OR policy = 'NEW_ONLY' AND id % 2 = 0 OR policy = 'EXISTING_ONLY' AND id % 2 = 1 GROUP BY policy")
def policies(s):
    each = s.chambers.withColumn("policy", F.explode(F.array(*(F.lit(p) for p in ("ANY", "NEW_ONLY", "EXISTING_ONLY")))))
    new = F.col("id") % 2 == 0
    return each.where(F.when(F.col("policy") == "ANY", True).when(F.col("policy") == "NEW_ONLY", new).otherwise(~new)).groupBy("policy").agg(F.count(F.lit(1)).alias("n"))


@query("p17_blocked_consumers", "consumers", "restrictions", oracle="SELECT DISTINCT c.id FROM consumers c JOIN restrictions r ON r.restriction_type IN ('road', 'tram_tracks') AND c.x > r.xmin AND c.x < r.xmax AND c.y > r.ymin AND c.y < r.ymax")
def blocked_consumers(s):
    roads = s.restrictions.where("restriction_type IN ('road', 'tram_tracks')").withColumnRenamed("id", "restriction")
    return spatial.points_in_boxes(s.consumers, roads).where("x > xmin AND x < xmax AND y > ymin AND y < ymax").select("id").distinct()


@query("p19_attribute_types", "out_lines", oracle="SELECT count(*) FILTER (id % 3 = 0)::BIGINT AS bad_number, count(*) FILTER (id % 3 <> 0)::BIGINT AS good FROM out_lines")
def attribute_types(s):
    text = F.expr("CASE WHEN id % 3 = 0 THEN 'x12' ELSE cast(length_mm as string) END")
    return s.out_lines.agg(F.count_if(text.try_cast("double").isNull()).alias("bad_number"), F.count_if(text.try_cast("double").isNotNull()).alias("good"))


@query("g16_rebuilt_network", "out_lines", oracle="SELECT end_node AS parent, count(*)::BIGINT AS children, sum(flow_dt)::BIGINT AS flow_dt FROM out_lines GROUP BY end_node")
def rebuilt(s):
    return s.out_lines.groupBy(F.col("end_node").alias("parent")).agg(F.count(F.lit(1)).alias("children"), F.sum("flow_dt").alias("flow_dt"))


@query("a18_crossed_type_totals", "pieces", oracle=f"SELECT crossed_type, count(*)::BIGINT AS n FROM pieces JOIN (SELECT * FROM (VALUES {', '.join(f'({i}, {chr(39)}{t}{chr(39)})' for i, t in enumerate(TYPES))}) AS v(b, crossed_type)) bits ON (crossed_bits >> b) & 1 = 1 GROUP BY crossed_type")
def crossed_totals(s):
    hit = F.filter(F.array(*(F.when(F.expr(f"(crossed_bits >> {i}) & 1 = 1"), F.lit(t)) for i, t in enumerate(TYPES))), lambda x: x.isNotNull())
    return s.pieces.select(F.explode(hit).alias("crossed_type")).groupBy("crossed_type").agg(F.count(F.lit(1)).alias("n"))


@query("j18_chain_objects", "links", "restrictions", oracle="""SELECT l.child, count(*)::BIGINT AS objects FROM links l JOIN restrictions r ON r.restriction_type = 'gas_pipeline' AND least(l.ax, l.bx) - 15 <= r.xmax AND greatest(l.ax, l.bx) + 15 >= r.xmin AND least(l.ay, l.by_) - 15 <= r.ymax AND greatest(l.ay, l.by_) + 15 >= r.ymin GROUP BY l.child""")
def chain_objects(s):
    """Objects whose box lies within 15 m of a link's box."""
    # Links of one box meet the same objects; objects of one shape are counted together.
    link = {"x0": F.least("ax", "bx") - 15, "y0": F.least("ay", "by_") - 15, "x1": F.greatest("ax", "bx") + 15, "y1": F.greatest("ay", "by_") + 15}
    lines = s.links.select("child", *(c.alias(n) for n, c in link.items()))
    boxed = spatial.dealt(lines.select(*link).distinct(), "x0", "y0", "x1", "y1", 100.0)
    gas = s.restrictions.where("restriction_type = 'gas_pipeline'").groupBy("xmin", "ymin", "xmax", "ymax").agg(F.count(F.lit(1)).alias("n"))
    once = (F.floor(F.greatest("x0", "xmin") / 100) == F.col("cx")) & (F.floor(F.greatest("y0", "ymin") / 100) == F.col("cy"))
    meet = (F.col("x0") <= F.col("xmax")) & (F.col("x1") >= F.col("xmin")) & (F.col("y0") <= F.col("ymax")) & (F.col("y1") >= F.col("ymin"))
    met = boxed.join(spatial.dealt(gas, "xmin", "ymin", "xmax", "ymax", 100.0).hint("merge"), ["cx", "cy"]).where(once & meet)
    return lines.join(met.groupBy(*link).agg(F.sum("n").alias("objects")), list(link)).select("child", "objects")


@query("f50_target_estimate", "consumers", "chambers", "du_table", oracle=f"SELECT c.id, h.id AS chamber, CAST(floor(0.7::DOUBLE * ((sqrt({D2}) * (SELECT min(cost_m) FROM du_table d WHERE d.cap_dt >= c.flow_dt) + 5000000) / 25e6::DOUBLE) * 1e6 + 0.5) AS BIGINT) AS estimate FROM consumers c JOIN chambers h ON {D2} <= 150*150")
def estimate(s):
    # Places meet once; chambers and consumers are joined to what met.
    met = spatial.points_near_points(s.consumers.select("x", "y").distinct(), others(s).select("rx", "ry").distinct(), 150.0)
    near = s.consumers.join(met.join(others(s), ["rx", "ry"]), ["x", "y"]).withColumn("du", lookups.du_by_flow(F.col("flow_dt"))).join(F.broadcast(s.du_table.select("du", "cost_m")), "du", "left")
    return near.select("id", "chamber", micro(0.7 * ((F.sqrt("d2") * F.col("cost_m") + 5000000) / 25e6)).alias("estimate"))
