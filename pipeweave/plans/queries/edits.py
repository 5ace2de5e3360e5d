"""Edits of the scene's forest and moves of its leaves."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions import geometry as G
from ...operators import edits, reattach
from ...operators.shared import table
from ..catalog import query

MARGIN_MM = 2000


def network(s):
    """The forest with its special sections, clipped to their links, as passages."""
    own = s.links.select("child", "length_mm").join(s.sections.withColumnRenamed("link", "child"), "child")
    lo, hi = (F.least(F.col(c) * 1000, F.col("length_mm")).cast("bigint") for c in ("s0", "s1"))
    held = own.select("child", lo.alias("lo_mm"), hi.alias("hi_mm")).where("lo_mm < hi_mm").groupBy("child").agg(F.collect_list(F.struct("lo_mm", "hi_mm")).alias("passages"))
    line = F.array(G.point("ax", "ay"), G.point("bx", "by_"))
    return (s.links.withColumn("line", line).join(held, "child", "left")
            .select(F.col("child").cast("string").alias("child"), F.col("parent").cast("string").alias("parent"), "length_mm", "line", F.coalesce("passages", F.array().cast("array<struct<lo_mm:bigint,hi_mm:bigint>>")).alias("passages"), (F.col("child") % 9 * 5000).cast("bigint").alias("reserved_mm"), F.lit(False).alias("junction")))


def places(s):
    """Two cuts in every link that isn't divisible by four."""
    return s.links.where("child % 4 <> 0").select(F.col("child").cast("string").alias("child"), F.explode(F.expr("array(length_mm div 3, 2 * length_mm div 3)")).alias("at_mm"))


CUTS = f"""passes AS (SELECT l.child, least(s.s0 * 1000, l.length_mm)::BIGINT AS lo, least(s.s1 * 1000, l.length_mm)::BIGINT AS hi FROM links l JOIN sections s ON s.link = l.child),
  places AS (SELECT DISTINCT child, parent, length_mm, unnest([length_mm // 3, 2 * length_mm // 3]) AS m FROM links WHERE child % 4 <> 0),
  judged AS (SELECT p.*, CASE WHEN m <= p.child % 9 * 5000 OR m >= length_mm THEN 'junction position' WHEN EXISTS (SELECT 1 FROM passes q WHERE q.child = p.child AND q.lo < q.hi AND m > q.lo - {MARGIN_MM} AND m < q.hi + {MARGIN_MM}) THEN 'junction inside a special section' END AS reason FROM places p)"""


def pieces(condition: str) -> str:
    """The links cut at the good places that meet the condition."""
    return f"""marks AS (SELECT child, parent, length_mm, 0 AS lo FROM links UNION ALL SELECT child, parent, length_mm, m FROM judged WHERE reason IS NULL AND {condition}),
  spans AS (SELECT *, coalesce(lead(lo) OVER (PARTITION BY child ORDER BY lo), length_mm) AS hi FROM marks),
  cut AS (SELECT CASE WHEN lo = 0 THEN child::VARCHAR ELSE child || '@' || lo END AS child, CASE WHEN hi = length_mm THEN parent::VARCHAR ELSE child || '@' || hi END AS parent, (hi - lo)::BIGINT AS length_mm,
    (SELECT count(*) FROM passes q WHERE q.child = s.child AND q.lo < q.hi AND q.lo >= s.lo AND q.hi <= s.hi)::BIGINT AS passages FROM spans s)"""


@query("g12_refused_cuts", "links", "sections", oracle=f"WITH {CUTS} SELECT child::VARCHAR AS child, m::BIGINT AS at_mm, reason FROM judged WHERE reason IS NOT NULL")
def refused(s):
    return edits.refused_cuts(network(s), places(s), MARGIN_MM).distinct()


@query("g12_cut_links", "links", "sections", oracle=f"WITH {CUTS}, {pieces('true')} SELECT * FROM cut")
def cut(s):
    return edits.cut(network(s), places(s), margin_mm=MARGIN_MM).select("child", "parent", "length_mm", F.size("passages").cast("bigint").alias("passages"))


def grown(s):
    """The cut forest with a new leaf at every junction, named by it."""
    after = table(edits.cut(network(s), places(s), margin_mm=MARGIN_MM), "cut")
    new = after.where("junction").select(F.concat(F.lit("n"), "child").alias("child"), F.col("child").alias("parent"), F.lit(1000).cast("bigint").alias("length_mm"), F.slice("line", 1, 1).alias("line"), F.slice("passages", 1, 0).alias("passages"), F.lit(0).cast("bigint").alias("reserved_mm"), F.lit(False).alias("junction"))
    return edits.attach(after, new)


@query("g12_dropped_leaves", "links", "sections", oracle=f"""WITH {CUTS}, {pieces('m % 3 = 0')} SELECT * FROM cut
  UNION ALL SELECT 'n' || child || '@' || m, child || '@' || m, 1000, 0 FROM judged WHERE reason IS NULL AND m % 3 = 0""")
def dropped(s):
    """Two thirds of the new leaves go again, and their junctions with them."""
    full = table(grown(s), "grown")
    leaves = full.where("child LIKE 'n%' AND CAST(substring_index(child, '@', -1) AS BIGINT) % 3 <> 0").select("child")
    return edits.drop(full, leaves).select("child", "parent", "length_mm", F.size("passages").cast("bigint").alias("passages"))


def hung(s):
    """The forest as one net, with flows small enough for sums that some diameter carries."""
    return s.links.select(F.lit(0).alias("net"), "child", "parent", F.expr("flow_dt % 50 + 1").alias("flow_dt"), "length_mm")


OFFERS = "offers AS (SELECT child, CAST(floor(child / CAST(3 AS DOUBLE)) AS BIGINT) AS parent, (child * 7919) % 90000 + 1000 AS length_mm FROM links WHERE child > 3 UNION ALL SELECT child, child - 2, (child * 31) % 90000 + 1000 FROM links WHERE child > 3)"


def offers(s):
    held = s.links.where("child > 3")
    return held.selectExpr("child", "CAST(floor(child / CAST(3 AS DOUBLE)) AS BIGINT) AS parent", "(child * 7919) % 90000 + 1000 AS length_mm").unionByName(held.selectExpr("child", "child - 2 AS parent", "(child * 31) % 90000 + 1000 AS length_mm"))


@query("o03_tentative_moves", "links", "du_table", recursive=True, oracle=f"""WITH walk AS (SELECT child AS node, child AS link, parent AS top, 0 AS step FROM links UNION ALL SELECT w.node, l.child, l.parent, w.step + 1 FROM walk w JOIN links l ON l.child = w.top), {OFFERS},
  flows AS (SELECT w.link, sum(l.flow_dt % 50 + 1)::BIGINT AS f, any_value(x.length_mm) AS mm FROM walk w JOIN links l ON l.child = w.node JOIN links x ON x.child = w.link GROUP BY w.link),
  good AS (SELECT DISTINCT o.child, o.parent, o.length_mm, l.parent AS old, l.flow_dt % 50 + 1 AS q, l.length_mm AS was FROM offers o JOIN links l ON l.child = o.child WHERE o.parent <> l.parent AND o.child NOT IN (SELECT parent FROM links)
    AND (o.parent IN (SELECT child FROM links))::INT + (SELECT count(*) FROM links h WHERE h.parent = o.parent) < 4),
  ways AS (SELECT g.child, g.parent, g.length_mm, w.link, -g.q AS d FROM good g JOIN walk w ON w.node = g.old UNION ALL SELECT g.child, g.parent, g.length_mm, w.link, g.q FROM good g JOIN walk w ON w.node = g.parent),
  changed AS (SELECT child, parent, length_mm, link, sum(d)::BIGINT AS d FROM ways GROUP BY ALL HAVING sum(d) <> 0),
  needed AS (SELECT c.child, c.parent, c.length_mm, f.mm, f.f + c.d AS flow, 1 AS sign FROM changed c JOIN flows f USING (link) UNION ALL SELECT c.child, c.parent, c.length_mm, f.mm, f.f, -1 FROM changed c JOIN flows f USING (link)
    UNION ALL SELECT child, parent, length_mm, length_mm, q, 1 FROM good UNION ALL SELECT child, parent, length_mm, was, q, -1 FROM good),
  asked AS (SELECT flow, min(d.cost_m) AS cost_m FROM (SELECT DISTINCT flow FROM needed) n LEFT JOIN du_table d ON d.cap_dt >= n.flow GROUP BY flow),
  told AS (SELECT n.child, n.parent, n.length_mm, CASE WHEN count(*) FILTER (n.flow > 0 AND a.cost_m IS NULL) = 0 THEN sum(CASE WHEN n.flow <= 0 THEN 0 ELSE n.sign * floor(n.mm / CAST(1000 AS DOUBLE) * a.cost_m + CAST(0.5 AS DOUBLE)) END)::BIGINT END AS delta_cost FROM needed n JOIN asked a USING (flow) GROUP BY ALL)
  SELECT t.child, t.parent, t.length_mm::BIGINT AS length_mm, t.delta_cost, (t.length_mm - g.was)::BIGINT AS delta_mm FROM told t JOIN good g ON g.child = t.child AND g.parent = t.parent AND g.length_mm = t.length_mm""")
def tentative(s):
    """Every leaf hung on two other nodes."""
    return reattach.tentative(reattach.carried(hung(s)), offers(s)).select("child", "parent", "length_mm", "delta_cost", "delta_mm")


@query("o08_moved_leaves")
def moved(s):
    """Nets of sixteen consumers; two rounds of moves to the other nodes of each. Brute force is in ``tests/test_edits.py``."""
    net = F.expr("CAST(child div 16 AS INT)")
    links = s.links.select(net.alias("net"), "child", F.expr("CASE WHEN child % 16 = 0 THEN -1 - child div 16 WHEN child % 3 = 0 THEN child - 1 - (child - 1) % 16 ELSE child - 1 END").alias("parent"), F.expr("flow_dt % 50 + 1").alias("flow_dt"), "ax", "ay")
    at = s.consumers.select(F.col("id").alias("parent"), "x", "y")
    far = lambda dx, dy: F.floor(F.sqrt(dx * dx + dy * dy) * 1000 + 0.5).cast("bigint")
    sized = links.join(at, "parent", "left").withColumn("length_mm", F.coalesce(far(F.col("ax") - F.col("x"), F.col("ay") - F.col("y")), F.lit(100000).cast("bigint")))
    own = links.select("net", "child", F.col("ax").alias("cx"), F.col("ay").alias("cy"))
    pairs = own.join(links.select("net", F.col("child").alias("parent"), "ax", "ay"), "net").where("child <> parent")
    _, moves = reattach.improved(sized, pairs.select("child", "parent", far(F.col("ax") - F.col("cx"), F.col("ay") - F.col("cy")).alias("length_mm")), 2)
    return moves.select("net", "round", "child", "parent", "delta_cost", "delta_mm")


STEP_MM, END_MM, APART_MM = 20000, 2, 8000


def bent(s):
    """A link along the points of every consumer, with its special sections as passages."""
    at = s.vertices.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x", "y"))), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("line"))
    held = s.sections.groupBy(F.col("link").alias("id")).agg(F.collect_list(F.struct((F.col("s0") * 1000).cast("bigint").alias("lo_mm"), (F.col("s1") * 1000).cast("bigint").alias("hi_mm"))).alias("passages"))
    return at.join(held, "id", "left").select(
        F.col("id").cast("string").alias("child"), F.lit("r").alias("parent"), F.floor(G.length(F.col("line")) * 1000 + 0.5).cast("bigint").alias("length_mm"), "line",
        F.coalesce("passages", F.array().cast("array<struct<lo_mm:bigint,hi_mm:bigint>>")).alias("passages"), (F.col("id") % 9 * 5000).cast("bigint").alias("reserved_mm"), F.lit(False).alias("junction"))


@query("u07_link_points", "vertices", "sections", oracle=f"""WITH steps AS (SELECT a.id, a.k + 1 AS k, sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)) AS d FROM vertices a JOIN vertices b ON b.id = a.id AND b.k = a.k + 1),
  marks AS (SELECT id, k, floor(sum(d) OVER (PARTITION BY id ORDER BY k) * 1000 + CAST(0.5 AS DOUBLE))::BIGINT AS m FROM steps),
  spans AS (SELECT id, greatest(id % 9 * 5000, {END_MM}) AS lo, max(m) - {END_MM} AS hi FROM marks GROUP BY id), own AS (SELECT a.id, a.m FROM marks a JOIN spans s USING (id) WHERE a.k < 5 AND a.m BETWEEN s.lo AND s.hi),
  grid AS (SELECT id, unnest(range(CAST(ceil(lo / CAST({STEP_MM} AS DOUBLE)) AS BIGINT) * {STEP_MM}, hi + 1, {STEP_MM})) AS m FROM spans),
  places AS (SELECT id, m FROM own UNION SELECT id, m FROM grid g WHERE NOT EXISTS (SELECT 1 FROM own o WHERE o.id = g.id AND abs(o.m - g.m) * 10 < 3 * {STEP_MM}))
  SELECT id, m::BIGINT AS at_mm FROM places p WHERE NOT EXISTS (SELECT 1 FROM sections s WHERE s.link = p.id AND p.m > s.s0 * 1000 - {APART_MM} AND p.m < s.s1 * 1000 + {APART_MM})""")
def link_points(s):
    """Inner vertices and steps of every link, away from its ends and special sections."""
    return edits.link_points(bent(s), STEP_MM, END_MM, APART_MM).select(F.col("child").cast("bigint").alias("id"), "at_mm")


@query("u05_free_junctions", "links", "sections", oracle=f"""WITH {CUTS}, {pieces('true')}, met AS (SELECT parent, count(*) AS n FROM cut GROUP BY parent)
  SELECT c.child AS id, m.n::BIGINT AS hung FROM cut c JOIN met m ON m.parent = c.child WHERE c.child LIKE '%@%' AND m.n + 1 < {edits.DEGREE}""")
def free_junctions(s):
    after = edits.cut(network(s), places(s), margin_mm=MARGIN_MM)
    return edits.free_nodes(after).join(after.groupBy(F.col("parent").alias("id")).agg(F.count(F.lit(1)).alias("hung")), "id").select("id", "hung")
