"""Scalar functions over the scene."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions import engineering as E
from ...functions import geometry as G
from ..catalog import query


def micro(c):
    """Millionths as a whole number, so that results compare exactly."""
    return F.floor(c * 1e6 + 0.5).cast("bigint")


MICRO = "CAST(floor(({}) * 1e6 + 0.5) AS BIGINT)"


def lines(s):
    """id, line: the scene's vertices as polylines."""
    points = F.array_sort(F.collect_list(F.struct("k", "x", "y")))
    return s.vertices.groupBy("id").agg(F.transform(points, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("line"))


STEPS = """WITH steps AS (SELECT id, k, x, y, lag(x) OVER w AS px, lag(y) OVER w AS py, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM vertices WINDOW w AS (PARTITION BY id ORDER BY k)),
  edges AS (SELECT id, k, px AS ax, py AS ay, x AS bx, y AS by_, sqrt((px-x)*(px-x)+(py-y)*(py-y)) AS len FROM steps WHERE k > 0),
  runs AS (SELECT *, coalesce(sum(len) OVER (PARTITION BY id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s0, sum(len) OVER (PARTITION BY id ORDER BY k) AS s1 FROM edges)
"""
TURN = "degrees(abs(CASE WHEN {0} > pi() THEN {0} - 2*pi() WHEN {0} <= -pi() THEN {0} + 2*pi() ELSE {0} END))"


@query("f01_turn_angles", "vertices", oracle=STEPS + f""", turns AS (SELECT id, k, atan2(ny - y, nx - x) - atan2(y - py, x - px) AS d FROM steps WHERE k BETWEEN 1 AND 4)
  SELECT id, k, {MICRO.format(TURN.format('d'))} AS turn_micro FROM turns""")
def turns(s):
    out = lines(s).select("id", "line", F.explode(F.sequence(F.lit(2), F.size("line") - 1)).alias("i"))
    at = lambda d: F.element_at("line", F.col("i") + d)
    return out.select("id", (F.col("i") - 1).cast("int").alias("k"), micro(G.turn_angle(at(-1), at(0), at(1))).alias("turn_micro"))


@query("f02_acute_angles", "links", oracle=f"""SELECT child, {MICRO.format("degrees(CASE WHEN d > pi()/2 THEN pi() - d ELSE d END)")} AS acute_micro FROM (SELECT child, abs(CASE WHEN r > pi() THEN r - 2*pi() WHEN r <= -pi() THEN r + 2*pi() ELSE r END) AS d
  FROM (SELECT child, atan2(CAST(1 AS DOUBLE), CAST(2 AS DOUBLE)) - atan2(by_ - ay, bx - ax) AS r FROM links) x) y""")
def acute(s):
    dx, dy = F.col("bx") - F.col("ax"), F.col("by_") - F.col("ay")
    return s.links.select("child", micro(G.acute_angle(dx, dy, F.lit(2.0), F.lit(1.0))).alias("acute_micro"))


@query("f03_polyline_length", "vertices", oracle=STEPS + f"SELECT id, {MICRO.format('sum(len)')} AS length_micro FROM edges GROUP BY id")
def polyline_length(s):
    return lines(s).select("id", micro(G.length(F.col("line"))).alias("length_micro"))


@query("f07_sub_line", "vertices", oracle=STEPS + f"""SELECT id, {MICRO.format('sum(greatest(0, least(s1, total * 0.75) - greatest(s0, total * 0.25)))')} AS length_micro
  FROM (SELECT *, sum(len) OVER (PARTITION BY id) AS total FROM runs) r GROUP BY id""")
def sub_line(s):
    out = lines(s).withColumn("n", G.length(F.col("line"))).select("id", G.sub_line(F.col("line"), F.col("n") * 0.25, F.col("n") * 0.75).alias("part"))
    return out.select("id", micro(G.length(F.col("part"))).alias("length_micro"))


@query("f08_project_point", "vertices", oracle=STEPS + f""", near AS (SELECT id, s0, s1, greatest(CAST(0 AS DOUBLE), least(CAST(1 AS DOUBLE), ((100-ax)*(bx-ax) + (300-ay)*(by_-ay)) / ((bx-ax)*(bx-ax)+(by_-ay)*(by_-ay)))) AS t, ax, ay, bx, by_ FROM runs),
  best AS (SELECT id, s0 + t*(s1-s0) AS m, row_number() OVER (PARTITION BY id ORDER BY (ax+(bx-ax)*t-100)*(ax+(bx-ax)*t-100)+(ay+(by_-ay)*t-300)*(ay+(by_-ay)*t-300), s0 + t*(s1-s0)) AS r FROM near)
  SELECT id, {MICRO.format('m')} AS measure_micro FROM best WHERE r = 1""")
def project(s):
    p = F.struct(F.lit(100.0).alias("x"), F.lit(300.0).alias("y"))
    return lines(s).select("id", micro(G.project(F.col("line"), p)).alias("measure_micro"))


@query("f09_point_at_measure", "vertices", oracle=STEPS + f""", half AS (SELECT *, sum(len) OVER (PARTITION BY id) / 2 AS m FROM runs), hit AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY k) AS r FROM half WHERE s1 >= m)
  SELECT id, {MICRO.format('ax + (bx - ax) * ((m - s0) / (s1 - s0))')} AS x_micro, {MICRO.format('ay + (by_ - ay) * ((m - s0) / (s1 - s0))')} AS y_micro FROM hit WHERE r = 1""")
def point_at(s):
    p = G.point_at(F.col("line"), G.length(F.col("line")) / 2)
    return lines(s).select("id", p.alias("p")).select("id", micro(F.col("p.x")).alias("x_micro"), micro(F.col("p.y")).alias("y_micro"))


@query("f15_disc_interval", "links", oracle=f"""WITH g AS (SELECT child, sqrt((bx-ax)*(bx-ax)+(by_-ay)*(by_-ay)) AS n, ax, ay, bx, by_ FROM links WHERE ax <> bx OR ay <> by_),
  u AS (SELECT child, n, (1000-ax)*((bx-ax)/n) + (3000-ay)*((by_-ay)/n) AS pos, (1000-ax)*((by_-ay)/n) - (3000-ay)*((bx-ax)/n) AS off FROM g),
  h AS (SELECT child, n, pos, 250000 - off*off AS h2, sqrt(greatest(250000 - off*off, 0)) AS half FROM u)
  SELECT child, {MICRO.format('greatest(0, pos - half)')} AS lo_micro, {MICRO.format('least(n, pos + half)')} AS hi_micro FROM h WHERE h2 >= 0 AND greatest(0, pos - half) <= least(n, pos + half)""")
def disc(s):
    pt = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    c = F.struct(F.lit(1000.0).alias("x"), F.lit(3000.0).alias("y"))
    out = s.links.where("ax <> bx OR ay <> by_").select("child", G.disc_interval(pt("ax", "ay"), pt("bx", "by_"), c, F.lit(500.0)).alias("i")).where("i IS NOT NULL")
    return out.select("child", micro(F.col("i.lo")).alias("lo_micro"), micro(F.col("i.hi")).alias("hi_micro"))


@query("f20_line_samples", "net_lines", oracle="""SELECT id, CAST(m AS DOUBLE) AS measure FROM net_lines, LATERAL (SELECT unnest(range(0, 2000, 30)) AS m) u WHERE m < 2000 - 9
  UNION ALL SELECT id, CAST(2000 AS DOUBLE) FROM net_lines""")
def samples(s):
    return s.net_lines.select("id", F.explode(G.sample_measures(F.col("bx") - F.col("ax"), 30.0)).alias("measure"))


@query("f21_convex_corners", "vertices", oracle="""WITH ring AS (SELECT id, k, x, y, coalesce(lag(x) OVER w, last_value(x) OVER f) AS px, coalesce(lag(y) OVER w, last_value(y) OVER f) AS py,
   coalesce(lead(x) OVER w, first_value(x) OVER f) AS nx, coalesce(lead(y) OVER w, first_value(y) OVER f) AS ny FROM vertices
   WINDOW w AS (PARTITION BY id ORDER BY k), f AS (PARTITION BY id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
  area AS (SELECT id, sum(x*ny - nx*y) / 2 AS a FROM ring GROUP BY id)
  SELECT ring.id, k FROM ring JOIN area USING (id) WHERE ((x-px)*(ny-y) - (y-py)*(nx-x)) * a > 0""")
def convex(s):
    n = F.size("line")
    out = lines(s).withColumn("area", G.signed_area(F.concat("line", F.slice("line", 1, 1)))).withColumn("i", F.explode(F.sequence(F.lit(1), n)))
    a, b, c = F.element_at("line", F.when(F.col("i") == 1, n).otherwise(F.col("i") - 1)), F.element_at("line", F.col("i")), F.element_at("line", F.col("i") % n + 1)
    return out.where(G.convex_corner(a, b, c, F.col("area"))).select("id", (F.col("i") - 1).cast("int").alias("k"))


@query("f26_grid_key", "consumers", oracle="SELECT id, concat(CAST(CAST(floor(x*1000+0.5) AS BIGINT) AS VARCHAR), ':', CAST(CAST(floor(y*1000+0.5) AS BIGINT) AS VARCHAR)) AS grid_key FROM consumers")
def grid_key(s):
    mm = lambda c: E.half_up(F.col(c) * 1000).cast("string")
    return s.consumers.select("id", F.concat(mm("x"), F.lit(":"), mm("y")).alias("grid_key"))


@query("f30_required_distances", "restrictions", "rules", "du_table", oracle="""SELECT restriction_type, du, CAST(CASE WHEN restriction_type = 'oks' THEN CASE WHEN du < 500 THEN 5000 WHEN du <= 800 THEN 7000 ELSE 9000 END ELSE clearance_mm END AS BIGINT) AS clearance_mm,
  CAST(CASE WHEN du < 500 THEN 400 WHEN du <= 800 THEN 800 ELSE 1400 END AS INT) AS class_du,
  CAST(2 * ((CASE WHEN restriction_type = 'oks' THEN CASE WHEN du < 500 THEN 5000 WHEN du <= 800 THEN 7000 ELSE 9000 END ELSE clearance_mm END) + pair_mm / 2 + width_mm / 2) AS BIGINT) AS exempt_mm FROM rules CROSS JOIN du_table""")
def distances(s):
    clear = E.clearance_mm(F.col("restriction_type"), F.col("clearance_mm"), F.col("du"))
    return s.rules.crossJoin(s.du_table).select(  # 11 x 18 constant rows
        "restriction_type", "du", clear.alias("clearance_mm"), E.clearance_class(F.col("du")).cast("int").alias("class_du"),
        E.tie_in_radius_mm(E.axis_distance_mm(clear, F.col("pair_mm"), F.col("width_mm") / 2)).cast("bigint").alias("exempt_mm"))


@query("f34_effective_length", "sections", oracle=f"""WITH bounds AS (SELECT link, s0 AS s FROM sections UNION SELECT link, s1 FROM sections),
  cells AS (SELECT link, s AS a, lead(s) OVER (PARTITION BY link ORDER BY s) AS b FROM bounds),
  top AS (SELECT c.link, c.a, c.b, max(x.kspec_pct) AS k FROM cells c JOIN sections x ON x.link = c.link AND x.s0 <= c.a AND c.b <= x.s1 WHERE c.b IS NOT NULL GROUP BY c.link, c.a, c.b)
  SELECT link, CAST(sum((b - a) * (k - 100)) AS BIGINT) AS extra_pct_m FROM top GROUP BY link""")
def effective(s):
    """Extra length of special sections; where they overlap the largest factor counts."""
    from ...operators.intervals import covering_max

    return covering_max(s.sections, "link", "s0", "s1", "kspec_pct").groupBy("link").agg(F.sum((F.col("hi") - F.col("lo")) * (F.col("top") - 100)).cast("bigint").alias("extra_pct_m"))


@query("f35_depth_factor", "pieces", oracle=f"SELECT id, {MICRO.format('((greatest(0, depth0_mm / 1000.0::DOUBLE - 3) * 0.1::DOUBLE + 1) + (greatest(0, depth1_mm / 1000.0::DOUBLE - 3) * 0.1::DOUBLE + 1)) / 2')} AS k_micro FROM pieces")
def depth_factor(s):
    return s.pieces.select("id", micro(E.k_depth(F.col("depth0_mm") / 1000, F.col("depth1_mm") / 1000)).alias("k_micro"))


@query("f36_chamber_cost", "net_lines", oracle="SELECT id, diameter, CAST(CASE WHEN diameter <= 200 THEN 3000000 WHEN diameter <= 500 THEN 5000000 WHEN diameter <= 1000 THEN 8000000 ELSE 12000000 END AS BIGINT) AS cost FROM net_lines")
def chamber(s):
    return s.net_lines.select("id", "diameter", E.chamber_cost(F.col("diameter")).alias("cost"))


@query("f37_penalty", "consumers", oracle="SELECT id, CAST(100000000 + flow_dt * 50000 AS BIGINT) AS penalty FROM consumers")
def penalty(s):
    return s.consumers.select("id", E.penalty(F.col("flow_dt")).alias("penalty"))


@query("f38_score", "pieces", oracle=f"SELECT id, {MICRO.format('0.7::DOUBLE * (flow_dt * 10000 / 25e6::DOUBLE) + 0.3::DOUBLE * (length_mm / 1000.0::DOUBLE / 100)')} AS score_micro FROM pieces")
def score(s):
    return s.pieces.select("id", micro(E.score(F.col("flow_dt") * 10000, F.col("length_mm") / 1000)).alias("score_micro"))


@query("f40_rounders", "pieces", oracle="""SELECT id, CAST(floor(length_mm / 7.0::DOUBLE / 1000 * 1000 + 0.5) AS BIGINT) AS length_mm, CAST(floor(depth0_mm / 7.0::DOUBLE / 1000 * 10000 + 0.5) AS BIGINT) AS depth_tenth_mm FROM pieces""")
def rounders(s):
    return s.pieces.select("id", F.floor(F.col("length_mm") / 7.0 / 1000 * 1000 + 0.5).cast("bigint").alias("length_mm"), F.floor(F.col("depth0_mm") / 7.0 / 1000 * 10000 + 0.5).cast("bigint").alias("depth_tenth_mm"))


@query("f43_depth_intervals", "pieces", oracle="""SELECT id, greatest(least(depth0_mm, depth1_mm), 1500) AS lo, least(greatest(depth0_mm, depth1_mm), 4000) AS hi, least(greatest(3000, greatest(least(depth0_mm, depth1_mm), 1500)), least(greatest(depth0_mm, depth1_mm), 4000)) AS nearest
  FROM pieces WHERE greatest(least(depth0_mm, depth1_mm), 1500) <= least(greatest(depth0_mm, depth1_mm), 4000)""")
def intervals(s):
    own = E.interval(F.least("depth0_mm", "depth1_mm"), F.greatest("depth0_mm", "depth1_mm"))
    out = s.pieces.select("id", E.intersect(own, E.interval(F.lit(1500), F.lit(4000))).alias("i")).where("i IS NOT NULL")
    return out.select("id", F.col("i.lo").cast("bigint").alias("lo"), F.col("i.hi").cast("bigint").alias("hi"), E.closest(F.col("i"), F.lit(3000.0)).cast("bigint").alias("nearest"))


@query("f44_vertical_options", "vertical_rules", "du_table", oracle="""SELECT restriction_type, du, CAST(top_mm - gap_mm - d.height_mm AS BIGINT) AS above_hi_mm, CAST(greatest(700, top_mm + coalesce(v.height_mm, d.height_mm) + gap_mm) AS BIGINT) AS below_lo_mm, CAST(NULL AS BIGINT) AS under_mm
  FROM vertical_rules v CROSS JOIN du_table d WHERE method = 'GAP' UNION ALL SELECT restriction_type, du, NULL, NULL, greatest(700, min_cover_mm) FROM vertical_rules CROSS JOIN du_table WHERE method = 'COVER'""")
def vertical(s):
    both = s.vertical_rules.withColumnRenamed("height_mm", "own_mm").crossJoin(s.du_table)  # 5 x 18 constant rows
    o = E.vertical_options(F.col("height_mm"), F.col("top_mm"), F.coalesce("own_mm", "height_mm"), F.col("gap_mm"))
    gap = F.col("method") == "GAP"
    return both.select("restriction_type", "du", F.when(gap, o["above_hi_mm"]).alias("above_hi_mm"), F.when(gap, o["below_lo_mm"]).alias("below_lo_mm"), F.when(~gap, E.pass_under_mm(F.col("min_cover_mm"))).alias("under_mm"))


@query("s05_project_metric", "consumers", oracle=f"""WITH p AS (SELECT id, radians((37 + x / 1000) - 39) AS l, radians(55 + y / 10000) AS f0, 1/298.257223563::DOUBLE AS f FROM consumers), q AS (SELECT id, l, f0, f/(2-f) AS n, sqrt(f*(2-f)) AS e FROM p),
  r AS (SELECT id, l, n, sinh(atanh(sin(f0)) - e*atanh(e*sin(f0))) AS t FROM q), u AS (SELECT id, n, atan2(t, cos(l)) AS xi, atanh(sin(l)/sqrt(1+t*t)) AS et FROM r),
  v AS (SELECT id, xi, et, 6378137/(1+n)*(1+n*n/4+n*n*n*n/64) AS a, n/2-2*n*n/3+5*n*n*n/16 AS a1, 13*n*n/48-3*n*n*n/5 AS a2, 61*n*n*n/240 AS a3 FROM u)
  SELECT id, CAST(floor((500000 + 0.9996::DOUBLE*a*(et + a1*cos(2*xi)*sinh(2*et) + a2*cos(4*xi)*sinh(4*et) + a3*cos(6*xi)*sinh(6*et))) * 1000 + 0.5) AS BIGINT) AS x_mm,
   CAST(floor((0.9996::DOUBLE*a*(xi + a1*sin(2*xi)*cosh(2*et) + a2*sin(4*xi)*cosh(4*et) + a3*sin(6*xi)*cosh(6*et))) * 1000 + 0.5) AS BIGINT) AS y_mm FROM v""")
def metric(s):
    p = G.to_metric(37 + F.col("x") / 1000, 55 + F.col("y") / 10000)
    return s.consumers.select("id", p.alias("p")).select("id", E.half_up(F.col("p.x") * 1000).alias("x_mm"), E.half_up(F.col("p.y") * 1000).alias("y_mm"))


@query("s06_project_back", "consumers", oracle="SELECT id, CAST(floor((37 + x / 1000) * 1e7 + 0.5) AS BIGINT) AS lon_e7, CAST(floor((55 + y / 10000) * 1e7 + 0.5) AS BIGINT) AS lat_e7 FROM consumers")
def back(s):
    """The inverse undoes the projection to a centimetre."""
    p = G.to_metric(37 + F.col("x") / 1000, 55 + F.col("y") / 10000)
    out = s.consumers.select("id", p.alias("p")).select("id", G.to_wgs84(F.col("p.x"), F.col("p.y")).alias("w"))
    return out.select("id", E.half_up(F.col("w.lon") * 1e7).alias("lon_e7"), E.half_up(F.col("w.lat") * 1e7).alias("lat_e7"))
