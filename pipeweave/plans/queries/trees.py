"""Tree analytics over the scene's forest."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...operators import graph, hydraulics, lookups
from ..catalog import query

PATHS = "WITH paths AS (SELECT child AS node, child AS link, parent AS top, 0 AS step FROM links UNION ALL SELECT p.node, l.child, l.parent, p.step + 1 FROM paths p JOIN links l ON l.child = p.top) "


@query("j20_paths_to_root", "links", recursive=True, oracle=PATHS + "SELECT node, link, step::INT AS step FROM paths")
def paths(s):
    return graph.closure(s.links)


@query("a01_downstream_flow", "links", recursive=True, oracle=PATHS + "SELECT p.link, sum(l.flow_dt)::BIGINT AS flow_dt, count(*)::BIGINT AS consumers FROM paths p JOIN links l ON l.child = p.node GROUP BY p.link")
def downstream(s):
    held = s.links.select(F.col("child").alias("id"), "flow_dt")
    return graph.gathered(s.links, held, "flow_dt").select("link", F.col("total").alias("flow_dt"), F.col("n").alias("consumers"))


@query("a08_shared_length", "links", recursive=True, oracle=PATHS + "SELECT count(*)::BIGINT AS shared_links, sum(length_mm)::BIGINT AS shared_mm FROM (SELECT p.link FROM paths p GROUP BY p.link HAVING count(*) >= 2) x JOIN links l ON l.child = x.link")
def shared(s):
    many = graph.gathered(s.links, s.links.select(F.col("child").alias("id"), "flow_dt"), "flow_dt").where("n >= 2").select(F.col("link").alias("child"))
    return s.links.join(many, "child").agg(F.count(F.lit(1)).alias("shared_links"), F.sum("length_mm").alias("shared_mm"))


@query("g08_depth_from_root", "links", recursive=True, oracle="WITH d AS (SELECT DISTINCT parent AS id, 0 AS depth FROM links WHERE parent NOT IN (SELECT child FROM links) UNION ALL SELECT l.child, d.depth + 1 FROM d JOIN links l ON l.parent = d.id) SELECT id, depth::INT AS depth FROM d")
def depth(s):
    roots = s.links.select(F.col("parent").alias("id")).distinct().join(s.links.select(F.col("child").alias("id")), "id", "left_anti")
    return graph.depths(s.links, roots)


CUT = "cut AS (SELECT * FROM links WHERE child % 10 <> 3)"


@query("g07_components", "links", recursive=True, oracle=f"WITH {CUT}, roots AS (SELECT DISTINCT parent AS id FROM cut WHERE parent NOT IN (SELECT child FROM cut)), d AS (SELECT id, id AS component FROM roots UNION ALL SELECT c.child, d.component FROM d JOIN cut c ON c.parent = d.id) SELECT id, component FROM d")
def components(s):
    """A parent's id is below its children's, so the root is the smallest node."""
    return graph.components(s.links.where("child % 10 <> 3"))


@query("g10_forest_test", "links", recursive=True, oracle=f"WITH {CUT}, roots AS (SELECT DISTINCT parent AS id FROM cut WHERE parent NOT IN (SELECT child FROM cut)), d AS (SELECT id, id AS component FROM roots UNION ALL SELECT c.child, d.component FROM d JOIN cut c ON c.parent = d.id) SELECT component, count(*)::BIGINT AS nodes, (count(*) - 1)::BIGINT AS edges, true AS tree FROM d GROUP BY component")
def forest_test(s):
    links = s.links.where("child % 10 <> 3")
    found = graph.components(links)
    nodes = found.groupBy("component").agg(F.count(F.lit(1)).alias("nodes"))
    edges = links.join(found.withColumnRenamed("id", "child"), "child").groupBy("component").agg(F.count(F.lit(1)).alias("edges"))
    return nodes.join(edges, "component").withColumn("tree", F.col("edges") == F.col("nodes") - 1)


ROWS = "kept AS (SELECT id AS child, CASE WHEN id % 7 = 0 THEN CAST(floor(id / 14) AS BIGINT) ELSE id - 1 END AS parent FROM consumers WHERE id > 0)"


@query("g09_chains", "consumers", recursive=True, oracle=f"""WITH {ROWS}, degree AS (SELECT parent, count(*) AS n FROM kept GROUP BY parent), up AS (SELECT k.child, k.parent FROM kept k JOIN degree d USING (parent) WHERE d.n = 1 AND k.parent IN (SELECT child FROM kept)),
  walk AS (SELECT child, child AS here FROM kept UNION ALL SELECT w.child, u.parent FROM walk w JOIN up u ON u.child = w.here) SELECT child, min(here)::BIGINT AS chain FROM walk GROUP BY child""")
def chains(s):
    """All consumers in rows of seven, each row hung on another."""
    links = s.consumers.where("id > 0").select(F.col("id").alias("child"), F.expr("CASE WHEN id % 7 = 0 THEN CAST(floor(id / 14) AS BIGINT) ELSE id - 1 END").alias("parent"))
    return graph.chains(links, links.where("false").select(F.col("child").alias("id")))


SIZED = "sized AS (SELECT l.child, l.parent, l.length_mm, min(d.du) AS du FROM links l JOIN du_table d ON d.cap_dt >= l.flow_dt GROUP BY ALL), "


@query("g13_monotone_diameter", "links", "du_table", recursive=True, oracle=PATHS.replace("WITH ", "WITH " + SIZED) + "SELECT p.link, max(s.du)::INT AS du FROM paths p JOIN sized s ON s.child = p.node GROUP BY p.link")
def monotone(s):
    sized = s.links.withColumn("du", lookups.du_by_flow(F.col("flow_dt")))
    return graph.monotone(sized)


@query("w03_run_length", "links", "du_table", recursive=True, oracle=PATHS.replace("WITH ", "WITH " + SIZED) + """, walk AS (SELECT p.node, p.link, p.step, s.du, s.length_mm, CASE WHEN lag(s.du) OVER (PARTITION BY p.node ORDER BY p.step) = s.du THEN 0 ELSE 1 END AS fresh FROM paths p JOIN sized s ON s.child = p.link),
  islands AS (SELECT *, sum(fresh) OVER (PARTITION BY node ORDER BY step) AS island FROM walk) SELECT node, link, du, sum(length_mm) OVER (PARTITION BY node, island ORDER BY step)::BIGINT AS run_mm FROM islands""")
def run_length(s):
    sized = s.links.withColumn("du", lookups.du_by_flow(F.col("flow_dt")))
    return graph.runs(graph.closure(s.links), sized).select("node", "link", "du", "run_mm")


@query("w04_run_violations", "links", "du_table", recursive=True, oracle=PATHS.replace("WITH ", "WITH " + SIZED) + """, walk AS (SELECT p.node, p.link, p.step, s.du, s.length_mm, CASE WHEN lag(s.du) OVER (PARTITION BY p.node ORDER BY p.step) = s.du THEN 0 ELSE 1 END AS fresh FROM paths p JOIN sized s ON s.child = p.link),
  islands AS (SELECT *, sum(fresh) OVER (PARTITION BY node ORDER BY step) AS island FROM walk), runs AS (SELECT node, link, du, sum(length_mm) OVER (PARTITION BY node, island ORDER BY step) AS run_mm FROM islands) SELECT node, count(*)::BIGINT AS violations FROM runs JOIN du_table USING (du) WHERE run_mm > max_length_m * 1000 GROUP BY node""")
def run_violations(s):
    sized = s.links.withColumn("du", lookups.du_by_flow(F.col("flow_dt")))
    runs = graph.runs(graph.closure(s.links), sized)
    return runs.join(F.broadcast(s.du_table), "du").where("run_mm > max_length_m * 1000").groupBy("node").agg(F.count(F.lit(1)).alias("violations"))


@query("g15_hydraulic_fixed_point")
def hydraulic(s):
    """Many small variants: the first eight links of each block of eight consumers."""
    links = s.links.select((F.expr("child div 8")).cast("int").alias("variant"), "child", F.expr("CASE WHEN child % 8 = 0 THEN -1 - child div 8 ELSE child - 1 END").alias("parent"), F.expr("flow_dt % 300 + 1").alias("flow_dt"), "length_mm")
    return hydraulics.fixed_point(links)
