"""Rules of whole outputs, zones, separation and turns over the scene."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions import engineering as E
from ...functions import geometry as G
from ...operators import admissible, copies, graph, lookups, spatial
from ...operators import validate as V
from ..catalog import query
from .formulas import MICRO, STEPS, TURN, lines, micro
from .trees import PATHS
from .validation import issue

NEED = "CASE WHEN r.restriction_type = 'oks' THEN 5 ELSE u.clearance_mm / 1000.0::DOUBLE END + 0.255::DOUBLE + u.width_mm / 2000.0::DOUBLE"
OFF = "sqrt(greatest(r.xmin - {0}.x, {0}.x - r.xmax, 0) * greatest(r.xmin - {0}.x, {0}.x - r.xmax, 0) + greatest(r.ymin - {0}.y, {0}.y - r.ymax, 0) * greatest(r.ymin - {0}.y, {0}.y - r.ymax, 0))"


@query("f10_offset_points", "links", oracle=f"SELECT child, {MICRO.format('ax + (bx - ax) / n * 25')} AS x_micro, {MICRO.format('ay + (by_ - ay) / n * 25')} AS y_micro FROM (SELECT *, sqrt((bx-ax)*(bx-ax)+(by_-ay)*(by_-ay)) AS n FROM links) l")
def offsets(s):
    """The point 25 m from a link's start towards its end."""
    p = G.offset(G.point(F.col("ax"), F.col("ay")), G.point(F.col("bx"), F.col("by_")), F.lit(25.0))
    return s.links.select("child", micro(p["x"]).alias("x_micro"), micro(p["y"]).alias("y_micro"))


@query("f12_nearest_points", "vertices", oracle=STEPS + f""", near AS (SELECT *, ax + (bx-ax)*t AS x, ay + (by_-ay)*t AS y, (ax + (bx-ax)*t - 100) * (ax + (bx-ax)*t - 100) + (ay + (by_-ay)*t - 300) * (ay + (by_-ay)*t - 300) AS d2
   FROM (SELECT *, greatest(CAST(0 AS DOUBLE), least(CAST(1 AS DOUBLE), ((100-ax)*(bx-ax) + (300-ay)*(by_-ay)) / ((bx-ax)*(bx-ax)+(by_-ay)*(by_-ay)))) AS t FROM runs) r)
  SELECT id, {MICRO.format('x')} AS x_micro, {MICRO.format('y')} AS y_micro FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d2, s0 + t * len) AS place FROM near) n WHERE place = 1""")
def nearest_points(s):
    """The point of every line nearest to (100, 300)."""
    out = lines(s).withColumn("p", G.nearest_point(F.col("line"), G.point(F.lit(100.0), F.lit(300.0))))
    return out.select("id", micro(F.col("p.x")).alias("x_micro"), micro(F.col("p.y")).alias("y_micro"))


@query("f49_depth_cost", "pieces", oracle="""WITH p AS (SELECT id, length_mm AS n, depth0_mm - 3000 AS a, depth1_mm - 3000 AS b FROM pieces),
  split AS (SELECT id, CASE WHEN a * b < 0 THEN n * greatest(a, b) * greatest(a, b) ELSE n * greatest(a + b, 0) END AS low, CASE WHEN a * b < 0 THEN n * (a * a + b * b) ELSE n * abs(a + b) END AS off, CASE WHEN a * b < 0 THEN 2 * (abs(a) + abs(b)) ELSE 2 END AS by_ FROM p)
  SELECT id, ((2 * low + 10000 * by_) // (20000 * by_))::BIGINT AS extra_micro, ((2 * off + 1000 * by_) // (2000 * by_))::BIGINT AS deviation_micro FROM split""")
def depth_cost(s):
    """For a ruble a kilometre: what depth adds, and the distance from the normal depth along the piece, in millionths; whole numbers throughout, divided once."""
    low, off, by = G.profile_cost_mm(F.col("length_mm"), F.col("depth0_mm"), F.col("depth1_mm"), 3000)
    out = s.pieces.select("id", low.alias("low"), off.alias("off"), by.alias("by"))
    return out.select("id", F.expr("(2 * low + 10000 * by) div (20000 * by)").alias("extra_micro"), F.expr("(2 * off + 1000 * by) div (2000 * by)").alias("deviation_micro"))


@query("p04_inside_any_zone", "consumers", "restrictions", "rules", oracle=f"""SELECT c.id, r.id AS restriction FROM consumers c JOIN restrictions r ON r.xmin - 12 <= c.x AND r.xmax + 12 >= c.x AND r.ymin - 12 <= c.y AND r.ymax + 12 >= c.y JOIN rules u ON u.restriction_type = r.restriction_type
  WHERE {OFF.format('c')} < {NEED} - 0.001 AND NOT (r.restriction_type = 'oks' AND c.x BETWEEN r.xmin AND r.xmax AND c.y BETWEEN r.ymin AND r.ymax)""")
def inside_any_zone(s):
    """Consumers in the zone of an object that is not the building they stand in."""
    ruled = lookups.with_rule(s.restrictions, s.rules).where("kind IS NOT NULL").withColumnRenamed("id", "restriction")
    # Consumers of one place and objects that are alike are judged once.
    places, consumers = copies.folded(s.consumers, "id", ["x", "y"])
    box = ["restriction_type", "xmin", "ymin", "xmax", "ymax"]
    kinds, objects = copies.folded(ruled, "restriction", box)
    kinds = kinds.drop("n").join(ruled, ["restriction", *box])
    own = spatial.points_in_boxes(places.drop("n"), kinds.where("restriction_type = 'oks'")).select("id", "restriction")
    found = admissible.zones_of(places.drop("n"), kinds, own, 0.255).select("id", "restriction")
    return copies.expanded(copies.expanded(found, "restriction", objects), "id", consumers)


@query("p10_terminals_in_roads", "chambers", "restrictions", oracle=f"SELECT c.id FROM chambers c WHERE EXISTS (SELECT 1 FROM restrictions r WHERE r.restriction_type IN ('road', 'tram_tracks') AND {OFF.format('c')} <= 0.05)")
def terminals_in_roads(s):
    """Chambers inside a road or track, or within 5 cm of it."""
    ways = s.restrictions.where("restriction_type IN ('road', 'tram_tracks')").withColumnRenamed("id", "restriction")
    near = spatial.points_in_boxes(s.chambers, ways, pad=0.05)
    return near.where(spatial.box_distance(F.col("x"), F.col("y")) <= 0.05).select("id").distinct()


@query("p11_line_ends", "chambers", "net_lines", oracle="SELECT c.id, l.id AS line FROM chambers c JOIN net_lines l ON least((c.x-l.ax)*(c.x-l.ax)+(c.y-l.ay)*(c.y-l.ay), (c.x-l.bx)*(c.x-l.bx)+(c.y-l.by_)*(c.y-l.by_)) <= 5 * 5")
def line_ends(s):
    """Chambers within 5 m of an end of a line."""
    ends = s.net_lines.select(F.col("id").alias("line"), F.explode(F.array(G.point(F.col("ax"), F.col("ay")), G.point(F.col("bx"), F.col("by_")))).alias("p")).select("line", F.col("p.x").alias("rx"), F.col("p.y").alias("ry"))
    return spatial.points_near_points(s.chambers, ends, 5.0).select("id", "line").distinct()


GAP = "greatest(least(l.ay, l.by_) - n.ay, n.ay - greatest(l.ay, l.by_), 0)"


@query("p12_separation", "links", "net_lines", oracle=f"""SELECT child, count(*) FILTER (d < 0.05)::BIGINT AS too_close, CAST(floor(sum(len * (1 - d / 10)) * 1000 + 0.5) AS BIGINT) AS penalty_milli
  FROM (SELECT l.child, {GAP} AS d, sqrt((l.bx-l.ax)*(l.bx-l.ax)+(l.by_-l.ay)*(l.by_-l.ay)) AS len FROM links l JOIN net_lines n ON {GAP} <= 10) x GROUP BY child""")
def separation(s):
    """Links against the built lines: nearer than 5 cm, and what nearness within 10 m costs."""
    built = s.net_lines.select(F.col("ax").alias("cx0"), F.col("ay").alias("cy0"), F.col("bx").alias("cx1"), F.col("by_").alias("cy1"))
    out = admissible.separation(s.links, built, "child", 0.05, 10.0)
    return out.select("child", "too_close", F.floor(F.col("penalty") * 1000 + 0.5).cast("bigint").alias("penalty_milli"))


@query("f25_crosses_banned", "links", "net_lines", oracle="SELECT DISTINCT l.child FROM links l JOIN net_lines n ON (l.ay - n.ay) * (l.by_ - n.ay) < 0")
def crosses_banned(s):
    """Links that properly cross any built line."""
    built = s.net_lines.select(F.col("ax").alias("cx0"), F.col("ay").alias("cy0"), F.col("bx").alias("cx1"), F.col("by_").alias("cy1"))
    met = spatial.near_segments(s.links, built, 0.001, 250.0)
    return met.where(G.segments_cross([F.col(c) for c in ("ax", "ay", "bx", "by_")], [F.col(c) for c in ("cx0", "cy0", "cx1", "cy1")])).select("child").distinct()


@query("p15_first_bad_turn", "vertices", oracle=STEPS + f""", legs AS (SELECT id, k, atan2(ny - y, nx - x) - CASE WHEN k = 0 THEN 0 ELSE atan2(y - py, x - px) END AS d FROM steps WHERE nx IS NOT NULL)
  SELECT id, min(k)::INT AS k FROM legs WHERE {TURN.format('d')} > 90 GROUP BY id""")
def first_bad_turn(s):
    """The first vertex at which a line, arriving along the x axis, turns by more than 90 degrees."""
    led = F.concat(F.array(G.point(F.element_at("line", 1)["x"] - 1.0, F.element_at("line", 1)["y"])), F.col("line"))
    bad = F.filter(F.sequence(F.lit(2), F.size("led") - 1), lambda i: G.turn_angle(F.element_at("led", i - 1), F.element_at("led", i), F.element_at("led", i + 1)) > 90)
    return lines(s).withColumn("led", led).select("id", (F.array_min(bad) - 2).alias("k")).where("k IS NOT NULL")


@query("j26_incident_lines", "chambers", "net_lines", oracle="SELECT c.id, l.id AS line FROM chambers c JOIN net_lines l ON abs(c.y - l.ay) <= 0.05 AND c.x BETWEEN l.ax AND l.bx")
def incident_lines(s):
    """The lines that pass a chamber's place: the only ones a tie-in there may touch."""
    return spatial.points_near_segments(s.chambers, s.net_lines.withColumnRenamed("id", "line"), 0.05).select("id", "line")


@query("j16_endpoint_mismatch", "links", "consumers", oracle=issue("ENDPOINT_MISMATCH", "sqrt((bx-x)*(bx-x)+(by_-y)*(by_-y)) > 0.002", "(SELECT l.child AS id, l.bx + CASE WHEN l.child % 31 = 0 THEN 0.003::DOUBLE WHEN l.child % 29 = 0 THEN 0.001::DOUBLE ELSE 0 END AS bx, l.by_, c.x, c.y FROM links l JOIN consumers c ON c.id = l.parent) m"))
def endpoint_mismatch(s):
    """Links with ends moved by 3 mm and by 1 mm."""
    moved = F.when(F.col("child") % 31 == 0, 0.003).when(F.col("child") % 29 == 0, 0.001).otherwise(0.0)
    return V.endpoint_mismatch(s.links.select(F.col("child").alias("id"), F.col("parent").alias("end_node"), (F.col("bx") + moved).alias("bx"), "by_"), s.consumers)


@query("v08_duplicate_nodes", "out_nodes", oracle="SELECT 'ERROR' AS severity, 'DUPLICATE_NODE_ID' AS code, id FROM out_nodes WHERE id % 41 = 0")
def duplicate_nodes(s):
    """Every 41st node twice."""
    return V.duplicate_nodes(s.out_nodes.unionByName(s.out_nodes.where("id % 41 = 0")))


@query("v04_summaries", "out_lines", oracle="""WITH found AS (SELECT concat('v', CAST(n_nationkey % 3 * 2 AS VARCHAR(3))) AS variant, n_nationkey % 5 = 0 AS drawn FROM nation WHERE n_nationkey < 4), held AS (SELECT variant, count(*) AS n, bool_or(drawn) AS drawn FROM found GROUP BY variant)
  SELECT 'ERROR' AS severity, 'DUPLICATE_SUMMARY' AS code, variant FROM held WHERE n > 1 UNION ALL SELECT 'ERROR', 'SUMMARY_GEOMETRY', variant FROM held WHERE drawn
  UNION ALL SELECT 'ERROR', 'MISSING_SUMMARY', variant FROM (SELECT DISTINCT variant FROM out_lines WHERE variant IS NOT NULL) o WHERE variant NOT IN (SELECT variant FROM held)""")
def summaries(s):
    """Summaries for v0 (twice, one drawn), v2 and v4; the lines are of v1, v2 and v3."""
    found = s.nation.where("n_nationkey < 4").select(F.concat(F.lit("v"), (F.col("n_nationkey") % 3 * 2).cast("string")).alias("variant"), (F.col("n_nationkey") % 5 == 0).alias("has_geometry"))
    return V.summaries(s.out_lines, found)


@query("v17_flow_mismatch", "links", recursive=True, oracle=PATHS + ", sums AS (SELECT p.link, sum(l.flow_dt) AS total FROM paths p JOIN links l ON l.child = p.node GROUP BY p.link) SELECT 'ERROR' AS severity, 'FLOW_MISMATCH' AS code, link AS id FROM sums WHERE link % 43 = 0")
def flow_mismatch(s):
    """Flows as gathered from the consumers, one too many on every 43rd link."""
    sums = graph.gathered(s.links, s.links.select(F.col("child").alias("id"), "flow_dt"), "flow_dt")
    told = sums.select(F.col("link").alias("id"), (F.col("total") + F.when(F.col("link") % 43 == 0, 1).otherwise(0)).alias("flow_dt"))
    return V.flow_mismatch(told, sums)


FOREST = """WITH e AS (SELECT id AS child, id - 1 AS parent FROM consumers WHERE id > 0 AND id % 8 <> 0 AND id - 1 IN (SELECT id FROM consumers) UNION ALL SELECT id, id - 3 FROM consumers WHERE id % 24 = 6 AND id - 3 IN (SELECT id FROM consumers)),
  beside AS (SELECT child AS u, parent AS v FROM e UNION SELECT parent, child FROM e), reach AS (SELECT DISTINCT u AS id, u AS r FROM beside UNION SELECT b.v, x.r FROM reach x JOIN beside b ON b.u = x.id),
  member AS (SELECT id, min(r) AS component FROM reach GROUP BY id), n AS (SELECT component, count(*) AS nodes, count(*) FILTER (id % 8 = 0 AND id % 40 <> 0 OR id % 56 = 3) AS roots FROM member GROUP BY component),
  m AS (SELECT component, count(*) AS edges FROM e JOIN member ON member.id = e.child GROUP BY component)
  SELECT 'ERROR' AS severity, 'CYCLE' AS code, component FROM n JOIN m USING (component) WHERE edges > nodes - 1 UNION ALL SELECT 'ERROR', 'NO_ROOT', component FROM n JOIN m USING (component) WHERE roots = 0 UNION ALL SELECT 'ERROR', 'MULTIPLE_ROOTS', component FROM n JOIN m USING (component) WHERE roots > 1"""


@query("v14_forest_issues", "consumers", recursive=True, oracle=FOREST)
def forest_issues(s):
    """Rows of eight consumers, some with a ring, some without a root or with two."""
    ids = s.consumers.select("id")
    e = ids.where("id > 0 AND id % 8 <> 0").select(F.col("id").alias("child"), (F.col("id") - 1).alias("parent")).unionByName(ids.where("id % 24 = 6").select(F.col("id").alias("child"), (F.col("id") - 3).alias("parent")))
    e = e.join(ids.withColumnRenamed("id", "parent"), "parent", "left_semi").select("child", "parent")
    return V.forest(e, ids.where("id % 8 = 0 AND id % 40 <> 0 OR id % 56 = 3"))


@query("v12_existing_chamber_near", "consumers", "chambers", oracle="SELECT DISTINCT 'ERROR' AS severity, 'EXISTING_CHAMBER_WITHIN_10M' AS code, c.id FROM consumers c JOIN chambers h ON (c.x-h.x)*(c.x-h.x)+(c.y-h.y)*(c.y-h.y) <= 100 WHERE h.id % 5 + 2 + c.id % 2 <= 4")
def existing_chamber_near(s):
    """New chambers at the consumers' places with two or three lines."""
    return V.near_existing_chamber(s.consumers.select("id", "x", "y", (F.col("id") % 2 + 2).alias("n")), s.chambers.withColumn("degree", F.col("id") % 5))


@query("v26_lines_intersect", "links", oracle="""WITH pairs AS (SELECT a.child AS a, b.child AS b FROM links a JOIN links b ON a.child < b.child WHERE ((a.bx-a.ax)*(b.ay-a.ay)-(a.by_-a.ay)*(b.ax-a.ax)) * ((a.bx-a.ax)*(b.by_-a.ay)-(a.by_-a.ay)*(b.bx-a.ax)) < 0
   AND ((b.bx-b.ax)*(a.ay-b.ay)-(b.by_-b.ay)*(a.ax-b.ax)) * ((b.bx-b.ax)*(a.by_-b.ay)-(b.by_-b.ay)*(a.bx-b.ax)) < 0)
  SELECT 'ERROR' AS severity, 'LINES_INTERSECT' AS code, id, count(*)::BIGINT AS crossed FROM (SELECT a AS id FROM pairs UNION ALL SELECT b FROM pairs) p GROUP BY id""")
def lines_intersect(s):
    """All links against each other."""
    return V.crossing_lines(s.links, "child", 100.0)
