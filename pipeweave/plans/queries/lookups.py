"""Rule and diameter lookups, costs, reports, ranks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ...functions import engineering as E
from ...operators import costs, intervals, lookups, ranking
from ..catalog import query

MIN_DU = "(SELECT min(du) FROM du_table d WHERE d.cap_dt >= {flow})"


@query("j01_rule_lookup", "restrictions", "rules", oracle="SELECT id, restriction_type, kind, clearance_mm FROM restrictions LEFT JOIN rules USING (restriction_type)")
def rule_lookup(s):
    return lookups.with_rule(s.restrictions, s.rules).select("id", "restriction_type", "kind", "clearance_mm")


@query("p01_unknown_policy", "restrictions", "rules", oracle="SELECT coalesce(kind, 'FORBIDDEN') AS kind, CAST(coalesce(clearance_mm, 1000) AS BIGINT) AS clearance_mm, count(*)::BIGINT AS n FROM restrictions LEFT JOIN rules USING (restriction_type) GROUP BY 1, 2")
def unknown_policy(s):
    return lookups.with_rule(s.restrictions, s.rules, "FORBIDDEN").groupBy("kind", "clearance_mm").agg(F.count(F.lit(1)).alias("n"))


@query("j02_du_lookup", "net_lines", "du_table", oracle="SELECT l.id, d.du, d.cost_m, d.pair_mm FROM net_lines l JOIN du_table d ON d.du = l.diameter - l.diameter % 50")
def du_lookup(s):
    return s.net_lines.withColumn("du", F.expr("diameter - diameter % 50")).join(F.broadcast(s.du_table), "du").select("id", "du", "cost_m", "pair_mm")


@query("j03_min_du_by_flow", "consumers", "du_table", oracle="SELECT c.id, min(d.du)::INT AS du FROM consumers c LEFT JOIN du_table d ON d.cap_dt >= c.flow_dt GROUP BY c.id")
def min_du(s):
    return s.consumers.select("id", lookups.du_by_flow(F.col("flow_dt")).alias("du"))


@query("j04_min_du_flow_length", "links", "du_table", oracle="SELECT l.child, min(d.du)::INT AS du FROM links l LEFT JOIN du_table d ON d.cap_dt >= l.flow_dt AND d.max_length_m * 1000 >= l.length_mm AND d.du >= 65 GROUP BY l.child")
def min_du_length(s):
    return s.links.select("child", lookups.du_by_flow_and_length(F.col("flow_dt"), F.col("length_mm"), F.lit(65)).alias("du"))


@query("j05_next_du", "du_table", oracle="SELECT du, lead(du) OVER (ORDER BY du)::INT AS next_du FROM du_table")
def successor(s):
    return s.du_table.select("du", lookups.next_du(F.col("du")).alias("next_du"))


@query("j06_nearest_du", "net_lines", "du_table", oracle="SELECT id, diameter, du FROM (SELECT l.id, l.diameter, d.du, row_number() OVER (PARTITION BY l.id ORDER BY abs(d.du - l.diameter), d.du) AS r FROM net_lines l CROSS JOIN du_table d) x WHERE r = 1")
def nearest(s):
    return s.net_lines.select("id", "diameter", lookups.nearest_du(F.col("diameter")).alias("du"))


PRICED = """WITH sized AS (SELECT p.id, p.variant, p.length_mm, p.flow_dt, p.crossed_bits, p.depth0_mm, p.depth1_mm, p.laying, min(d.du) AS du FROM pieces p LEFT JOIN du_table d ON d.cap_dt >= p.flow_dt GROUP BY ALL),
  priced AS (SELECT s.*, d.cost_m, CAST(floor(s.length_mm / 1000.0::DOUBLE * d.cost_m * (CASE WHEN laying = 'O' THEN 1.6::DOUBLE ELSE 1.0::DOUBLE END) + 0.5) AS BIGINT) AS cost FROM sized s JOIN du_table d USING (du)) """


@query("a04_report_by_diameter", "pieces", "du_table", oracle=PRICED + "SELECT variant, du, count(*)::BIGINT AS n, sum(length_mm)::BIGINT AS length_mm, sum(cost)::BIGINT AS cost FROM priced GROUP BY variant, du")
def by_diameter(s):
    return costs.by_diameter(costs.priced(s.pieces, s.du_table))


@query("f39_piece_cost", "pieces", "du_table", oracle=PRICED + "SELECT id, du, cost FROM priced")
def piece_cost(s):
    return costs.priced(s.pieces, s.du_table).select("id", "du", "cost")


TYPES = ["oks", "park", "social_area", "prohibited_site", "water", "railway", "road", "tram_tracks", "gas_pipeline", "power_cable", "heat_network"]


@query("a05_crossings_by_type", "pieces", "du_table", oracle=PRICED + f", bits AS (SELECT * FROM (VALUES {', '.join(f'({i}, {chr(39)}{t}{chr(39)})' for i, t in enumerate(TYPES))}) AS v(b, crossed_type)) " +
       "SELECT variant, crossed_type, count(*)::BIGINT AS n, sum(length_mm)::BIGINT AS length_mm, sum(cost)::BIGINT AS cost FROM priced JOIN bits ON (crossed_bits >> b) & 1 = 1 GROUP BY variant, crossed_type")
def crossings(s):
    labels = F.filter(F.array(*(F.when(F.expr(f"(crossed_bits >> {i}) & 1 = 1"), F.lit(f"{t}#{i}")) for i, t in enumerate(TYPES))), lambda x: x.isNotNull())
    return costs.by_crossed_type(costs.priced(s.pieces, s.du_table).withColumn("crossed", labels))


@query("a02_cost_summary", "pieces", "du_table", oracle=PRICED + """SELECT variant, sum(cost)::BIGINT AS lines_cost, sum(length_mm)::BIGINT AS length_mm, (count(*) FILTER (laying = 'F') * 5000000)::BIGINT AS tie_in_cost,
  coalesce(sum(CASE WHEN laying = 'P' THEN 100000000 + flow_dt * 50000 END), 0)::BIGINT AS penalty, (sum(cost) + count(*) FILTER (laying = 'F') * 5000000 + coalesce(sum(CASE WHEN laying = 'P' THEN 100000000 + flow_dt * 50000 END), 0))::BIGINT AS total FROM priced GROUP BY variant""")
def summary(s):
    return costs.summary(costs.priced(s.pieces, s.du_table))


SUMMED = PRICED + ", summed AS (SELECT variant, sum(cost)::BIGINT AS cost, sum(length_mm)::BIGINT AS length_mm FROM priced GROUP BY variant), scored AS (SELECT variant, 0.7::DOUBLE * (cost / 25e6::DOUBLE) + 0.3::DOUBLE * (length_mm / 1000.0::DOUBLE / 100) AS score FROM summed) "


@query("w01_variant_rank", "pieces", "du_table", oracle=SUMMED + "SELECT variant, row_number() OVER (ORDER BY score, variant)::INT AS rank, CAST(floor(score * 1e4 + 0.5) AS BIGINT) AS score_e4 FROM scored")
def variant_rank(s):
    return ranking.ranked(costs.scored(costs.priced(s.pieces, s.du_table))).select("variant", "rank", F.floor(F.col("score") * 1e4 + 0.5).cast("bigint").alias("score_e4"))


@query("w02_rank_check", "pieces", "du_table", oracle=SUMMED + ", given AS (SELECT variant, score, (variant * 2) % 4 + 1 AS rank FROM scored), ordered AS (SELECT *, row_number() OVER (ORDER BY score, variant) AS wanted, count(*) OVER (PARTITION BY rank) AS same FROM given) SELECT 'RANK_ORDER' AS code, variant FROM ordered WHERE rank <> wanted UNION ALL SELECT 'DUPLICATE_RANK', variant FROM ordered WHERE same > 1")
def rank_check(s):
    given = costs.scored(costs.priced(s.pieces, s.du_table)).withColumn("rank", F.expr("(variant * 2) % 4 + 1"))
    return ranking.rank_issues(given).select("code", "variant")


@query("t04_best_variants", "pieces", "du_table", oracle=SUMMED + ", near AS (SELECT a.variant FROM scored a WHERE NOT EXISTS (SELECT 1 FROM scored b WHERE b.score < a.score AND abs(b.score - a.score) < 1e-9)) SELECT variant, CAST(floor(score*1e4+0.5) AS BIGINT) AS score_e4 FROM scored JOIN near USING (variant) ORDER BY score, variant LIMIT 3")
def best(s):
    """At most three variants: the limit is the feature."""
    scored = costs.scored(costs.priced(s.pieces, s.du_table))
    return ranking.ranked(scored).where("rank <= 3").select("variant", F.floor(F.col("score") * 1e4 + 0.5).cast("bigint").alias("score_e4"))


@query("a06_variant_report", "pieces", "du_table", oracle=PRICED + "SELECT variant, count(*) FILTER (laying = 'F')::BIGINT AS chambers, count(*) FILTER (laying = 'O')::BIGINT AS special, max(flow_dt)::BIGINT AS max_flow_dt, sum(CASE WHEN laying = 'O' THEN cost ELSE 0 END)::BIGINT AS special_cost FROM priced GROUP BY variant")
def variant_report(s):
    return costs.priced(s.pieces, s.du_table).groupBy("variant").agg(
        F.count_if(F.col("laying") == "F").alias("chambers"), F.count_if(F.col("laying") == "O").alias("special"), F.max("flow_dt").alias("max_flow_dt"),
        F.sum(F.when(F.col("laying") == "O", F.col("cost")).otherwise(0)).alias("special_cost"))


@query("a07_depth_metrics", "pieces", oracle="""SELECT variant, max(greatest(depth0_mm, depth1_mm))::BIGINT AS max_mm, min(least(depth0_mm, depth1_mm))::BIGINT AS min_mm, (sum((depth0_mm + depth1_mm) * (length_mm // 1000)) // (2 * sum(length_mm // 1000)))::BIGINT AS mean_mm,
  sum(CASE WHEN depth0_mm + depth1_mm > 6000 THEN length_mm ELSE 0 END)::BIGINT AS deep_mm, sum(CASE WHEN depth0_mm + depth1_mm < 6000 THEN length_mm ELSE 0 END)::BIGINT AS shallow_mm, count(*) FILTER (depth0_mm <> depth1_mm)::BIGINT AS transitions FROM pieces GROUP BY variant""")
def depth_metrics(s):
    return costs.depth_metrics(s.pieces)


@query("a10_input_statistics", "restrictions", "rules", oracle="SELECT coalesce(kind, 'UNKNOWN') AS kind, restriction_type, count(*)::BIGINT AS n FROM restrictions LEFT JOIN rules USING (restriction_type) GROUP BY GROUPING SETS ((1, 2), (1), ()) ")
def input_statistics(s):
    typed = lookups.with_rule(s.restrictions, s.rules).select(F.coalesce("kind", F.lit("UNKNOWN")).alias("kind"), "restriction_type")
    return typed.rollup("kind", "restriction_type").agg(F.count(F.lit(1)).alias("n"))


@query("a16_max_kspec", "sections", oracle="""WITH bounds AS (SELECT link, s0 AS s FROM sections UNION SELECT link, s1 FROM sections), cells AS (SELECT link, s AS lo, lead(s) OVER (PARTITION BY link ORDER BY s) AS hi FROM bounds)
  SELECT c.link, c.lo, c.hi, max(x.kspec_pct)::BIGINT AS kspec_pct FROM cells c JOIN sections x ON x.link = c.link AND x.s0 <= c.lo AND c.hi <= x.s1 WHERE hi IS NOT NULL GROUP BY c.link, c.lo, c.hi""")
def max_kspec(s):
    return intervals.covering_max(s.sections, "link", "s0", "s1", "kspec_pct").withColumnRenamed("top", "kspec_pct")


@query("w06_plateaus", "sections", oracle="""WITH m AS (SELECT *, CASE WHEN s0 > max(s1) OVER (PARTITION BY link ORDER BY s0, s1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1e-6 THEN 1 ELSE 0 END AS fresh FROM sections),
  i AS (SELECT *, sum(fresh) OVER (PARTITION BY link ORDER BY s0, s1 ROWS UNBOUNDED PRECEDING) AS island FROM m) SELECT link, min(s0) AS lo, max(s1) AS hi, count(*)::BIGINT AS n FROM i GROUP BY link, island""")
def plateaus(s):
    return intervals.merge(s.sections, "link", "s0", "s1")


@query("f18_interval_subtraction", "sections", oracle="""WITH m AS (SELECT link, greatest(s0, 0) AS a, least(s1, 300) AS b FROM sections WHERE s1 >= 0 AND s0 <= 300), k AS (SELECT link, a, b, max(b) OVER (PARTITION BY link ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM m),
  gaps AS (SELECT link, coalesce(reach, 0) AS lo, a AS hi FROM k WHERE a > coalesce(reach, 0) UNION ALL SELECT link, max(b), 300 FROM m GROUP BY link HAVING max(b) < 300), bare AS (SELECT DISTINCT link FROM sections WHERE link NOT IN (SELECT link FROM m))
  SELECT link, CAST(lo AS DOUBLE) AS lo, CAST(hi AS DOUBLE) AS hi FROM gaps UNION ALL SELECT link, CAST(0 AS DOUBLE), CAST(300 AS DOUBLE) FROM bare""")
def subtraction(s):
    covers = s.sections.groupBy("link").agg(F.collect_list(F.struct(F.col("s0").alias("lo"), F.col("s1").alias("hi"))).alias("covers"))
    return covers.select("link", F.explode(intervals.subtract(F.lit(0.0), F.lit(300.0), F.col("covers"))).alias("p")).select("link", "p.lo", "p.hi")


@query("w08_chain_measures", "pieces", oracle="SELECT id, (sum(length_mm) OVER (PARTITION BY link ORDER BY id) - length_mm)::BIGINT AS s0_mm, sum(length_mm) OVER (PARTITION BY link ORDER BY id)::BIGINT AS s1_mm FROM pieces")
def chain_measures(s):
    w = Window.partitionBy("link").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    return s.pieces.withColumn("s1_mm", F.sum("length_mm").over(w)).select("id", (F.col("s1_mm") - F.col("length_mm")).alias("s0_mm"), "s1_mm")


@query("w10_bounded_journal", "uploads", oracle="SELECT event_type, event_id FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS r FROM uploads) x WHERE r <= 600")
def journal(s):
    """The first 600 decisions of each kind: the bound is the feature."""
    return ranking.first_rows(s.uploads, ["event_type"], ["ts", "event_id"], 600).select("event_type", "event_id")


@query("a23_decisions_by_type", "uploads", oracle="SELECT event_type, count(*)::BIGINT AS n, min(event_id)::BIGINT AS first_id, max(event_id)::BIGINT AS last_id FROM uploads GROUP BY event_type")
def decisions(s):
    return s.uploads.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))


@query("w13_last_decision", "uploads", oracle="SELECT upload, event_id, event_type FROM (SELECT upload, event_id, event_type, row_number() OVER (PARTITION BY upload ORDER BY ts DESC, event_id DESC) AS r FROM uploads) x WHERE r = 1")
def last_decision(s):
    best = F.max_by(F.struct("event_id", "event_type"), F.struct("ts", "event_id"))
    return s.uploads.groupBy("upload").agg(best.alias("b")).select("upload", "b.event_id", "b.event_type")


@query("t01_consumer_order", "consumers", oracle="SELECT id, row_number() OVER (ORDER BY flow_dt DESC, id)::INT AS at FROM consumers")
def consumer_order(s):
    return ranking.numbered(s.consumers, [F.desc("flow_dt"), F.asc("id")], "at").select("id", "at")


@query("x01_custom_rules", "rules", oracle="SELECT restriction_type, kind FROM rules UNION ALL SELECT 'cemetery', 'FORBIDDEN'")
def custom_rules(s):
    from .. import rules

    custom = s.spark.createDataFrame([("cemetery", "FORBIDDEN", 3000, 0, 0, 100, 0), ("road", "FORBIDDEN", 1, 0, 0, 100, 0)], rules.RULE_COLUMNS)
    return rules.with_custom(s.rules, custom).select("restriction_type", "kind")


@query("s15_reference_json", "du_table", oracle="SELECT du, concat('{\"du\":', du, ',\"cap_dt\":', cap_dt, ',\"max_length_m\":', max_length_m, ',\"cost_m\":', cost_m, '}') AS row FROM du_table")
def reference(s):
    return s.du_table.select("du", F.to_json(F.struct("du", "cap_dt", "max_length_m", "cost_m")).alias("row"))


@query("d02_type_counts", "restrictions", "rules", oracle="SELECT restriction_type, count(*)::BIGINT AS n FROM restrictions WHERE restriction_type NOT IN (SELECT restriction_type FROM rules) GROUP BY 1")
def unknown_types(s):
    return s.restrictions.join(F.broadcast(s.rules.select("restriction_type")), "restriction_type", "left_anti").groupBy("restriction_type").agg(F.count(F.lit(1)).alias("n"))
