"""True polygons over the scene: star-shaped rings with holes, routes as chains of legs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ...operators import copies, paths, spatial
from ...operators import polygons as P
from ...operators.shared import table
from ..catalog import query
from .formulas import MICRO, micro


def orient(ax, ay, bx, by, cx, cy):
    return f"(({bx}-{ax})*({cy}-{ay})-({by}-{ay})*({cx}-{ax}))"


def to_segment(px, py, ax, ay, bx, by):
    """SQL: square of the distance from a point to a segment that has a length."""
    t = f"greatest(0::DOUBLE, least(1::DOUBLE, (({px}-{ax})*({bx}-{ax})+({py}-{ay})*({by}-{ay})) / (({bx}-{ax})*({bx}-{ax})+({by}-{ay})*({by}-{ay}))))"
    dx, dy = f"({ax}+({bx}-{ax})*{t}-{px})", f"({ay}+({by}-{ay})*{t}-{py})"
    return f"({dx}*{dx}+{dy}*{dy})"


LEG, EDGE = ("ax", "ay", "bx", "by_"), ("ex", "ey", "fx", "fy")
O1, O2, O3, O4 = orient(*LEG, "ex", "ey"), orient(*LEG, "fx", "fy"), orient(*EDGE, "ax", "ay"), orient(*EDGE, "bx", "by_")
ANGLE = "abs(CASE WHEN {0} > pi() THEN {0} - 2*pi() WHEN {0} <= -pi() THEN {0} + 2*pi() ELSE {0} END)".format("(atan2(fy-ey, fx-ex) - atan2(by_-ay, bx-ax))")
PARITY = "count(*) FILTER ((r.ay > {1}) <> (r.by_ > {1}) AND {0} < r.ax + ({1} - r.ay) / (r.by_ - r.ay) * (r.bx - r.ax)) % 2 = 1"
OVERLAP = "least(m.ax, m.bx) - {1} <= {0}.xmax AND greatest(m.ax, m.bx) + {1} >= {0}.xmin AND least(m.ay, m.by_) - {1} <= {0}.ymax AND greatest(m.ay, m.by_) + {1} >= {0}.ymin"

#: Measured legs, edges near them, cuts, and the parts inside polygons.
MEASURED = """m0 AS (SELECT *, sqrt((bx-ax)*(bx-ax)+(by_-ay)*(by_-ay)) AS len, lag(bx-ax) OVER w AS px, lag(by_-ay) OVER w AS py FROM legs WINDOW w AS (PARTITION BY chain ORDER BY k)),
  m1 AS (SELECT *, coalesce(sum(len) OVER (PARTITION BY chain ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s0, sum(len) OVER (PARTITION BY chain) AS total,
    coalesce(degrees(abs(atan2(px*(by_-ay)-py*(bx-ax), px*(bx-ax)+py*(by_-ay)))), 0) AS turn FROM m0),
  m AS (SELECT *, s0 + len AS s1, sum((turn > 0.01)::INT) OVER (PARTITION BY chain ORDER BY k) AS run FROM m1)"""
NEAR = f"""{MEASURED}, boxed AS (SELECT poly, ring, k AS edge, ax AS ex, ay AS ey, bx AS fx, by_ AS fy, least(ax, bx) AS xmin, least(ay, by_) AS ymin, greatest(ax, bx) AS xmax, greatest(ay, by_) AS ymax FROM rings),
  near AS (SELECT m.*, e.poly, ring, edge, ex, ey, fx, fy FROM m JOIN boxed e ON {OVERLAP.format('e', 15)})"""
PARTS = f"""{NEAR}, c AS (SELECT chain, k, poly, ring, edge, run, {O3} / ({O3} - {O4}) AS t, degrees(CASE WHEN {ANGLE} > pi() / 2 THEN pi() - {ANGLE} ELSE {ANGLE} END) AS angle FROM near WHERE {O1} * {O2} <= 0 AND {O3} * {O4} <= 0 AND {O3} <> {O4}),
  wholes AS (SELECT poly, min(xmin) AS xmin, min(ymin) AS ymin, max(xmax) AS xmax, max(ymax) AS ymax FROM boxed GROUP BY poly),
  pairs AS (SELECT m.chain, m.k, w.poly FROM m JOIN wholes w ON {OVERLAP.format('w', 1)}),
  bounds AS (SELECT chain, k, poly, t, min(angle) AS angle FROM (SELECT chain, k, poly, t, angle FROM c UNION ALL SELECT chain, k, poly, u.t, NULL FROM pairs, (VALUES (0::DOUBLE), (1::DOUBLE)) u(t)) x GROUP BY ALL),
  steps AS (SELECT chain, k, poly, t AS t0, lead(t) OVER w AS t1, angle AS entry, lead(angle) OVER w AS exit_ FROM bounds WINDOW w AS (PARTITION BY chain, k, poly ORDER BY t)),
  middles AS (SELECT s.*, m.s0, m.len, m.ax + (m.bx - m.ax) * ((t0 + t1) / 2) AS x, m.ay + (m.by_ - m.ay) * ((t0 + t1) / 2) AS y FROM steps s JOIN m USING (chain, k) WHERE t1 > t0),
  held0 AS (SELECT chain, k, i.poly, entry, exit_, s0 + t0 * len AS lo, s0 + t1 * len AS hi FROM middles i JOIN rings r ON r.poly = i.poly GROUP BY chain, i.k, i.poly, entry, exit_, s0, t0, t1, len, x, y HAVING {PARITY.format('x', 'y')}),
  marked AS (SELECT *, coalesce((lo > lag(hi) OVER w + 1e-6)::INT, 1) AS b FROM held0 WINDOW w AS (PARTITION BY chain, poly ORDER BY lo, hi)),
  islands AS (SELECT *, sum(b) OVER (PARTITION BY chain, poly ORDER BY lo, hi) AS island FROM marked),
  held AS (SELECT chain, poly, min(lo) AS lo, max(hi) AS hi, arg_min(entry, lo) AS entry, arg_max(exit_, hi) AS exit_ FROM islands GROUP BY chain, poly, island)""".replace("SELECT chain, k, i.poly", "SELECT chain, i.k, i.poly")
DISTANCE = f"sqrt(CASE WHEN {O1} * {O2} < 0 AND {O3} * {O4} < 0 THEN 0 ELSE least({to_segment('ax', 'ay', *EDGE)}, {to_segment('bx', 'by_', *EDGE)}, {to_segment('ex', 'ey', *LEG)}, {to_segment('fx', 'fy', *LEG)}) END)"
_APART = f"""lone AS (SELECT chain, k, poly, min({DISTANCE}) AS d FROM near GROUP BY chain, k, poly HAVING min({DISTANCE}) <= 15),
  within_ AS (SELECT DISTINCT h.chain, m.k, h.poly FROM held h JOIN m ON m.chain = h.chain WHERE least(hi, s1) - greatest(lo, s0) > 1e-9),
  d AS (SELECT chain, k, poly, CASE WHEN w.chain IS NOT NULL THEN 0 ELSE d END AS d FROM lone FULL JOIN within_ w USING (chain, k, poly))""".replace("CASE WHEN w.chain IS NOT NULL", "CASE WHEN w.inside_").replace("SELECT DISTINCT h.chain, m.k, h.poly FROM", "SELECT DISTINCT h.chain, m.k, h.poly, true AS inside_ FROM")
APART = f"{PARTS}, {_APART}"


class Found:
    """The scene's measured legs and what they meet, each written once; chains and polygons that are alike are one, and ``of_all`` gives what was found to all."""

    def __init__(self, s, kind: str | None = None, first: bool = False):
        """``kind``: which zones a rule asks for, others aren't looked at; ``first``: only legs that go straight on from their chain's beginning."""
        # Chains of even number are rooted.
        legs, self.chains = P.folded_chains(s.legs.withColumn("rooted", F.col("chain") % 2 == 0))
        zones = s.zones if kind is None else s.zones.where(kind)
        self.edges, self.zones, self.polygons = P.folded_polygons(s.rings if kind is None else s.rings.join(zones.select("poly"), "poly", "left_semi"), zones)
        self.legs = table(P.measured(legs).where("run = 0" if first else "true"), "legs")
        self.met = table(P.cuts(self.legs, self.edges), "cuts")
        self.held = table(P.intervals(self.legs, self.edges, self.met), "held")

    @property
    def near(self):
        if "_near" not in self.__dict__:
            self._near = table(P.near_edges(self.legs, self.edges, P.reach(self.zones)), "near")
        return self._near

    def of_all(self, rows):
        """``rows`` of (chain, poly) classes for all chains and polygons."""
        return copies.expanded_both(rows, ("poly", self.polygons), ("chain", self.chains))

    def of_chains(self, rows):
        return copies.expanded(rows, "chain", self.chains)


@query("f11_ring_edges", "rings", oracle=f"SELECT poly, ring, count(*)::BIGINT AS edges, {MICRO.format('sum(ax * by_ - bx * ay) / 2')} AS area_micro FROM rings GROUP BY poly, ring")
def ring_edges(s):
    """Polygons of nested arrays as edges again; the signed area of each ring."""
    points = F.transform(F.array_sort(F.collect_list(F.struct("k", "ax", "ay"))), lambda p: F.struct(p["ax"].alias("x"), p["ay"].alias("y")))
    nested = s.rings.groupBy("poly", "ring").agg(points.alias("points")).groupBy("poly").agg(F.transform(F.array_sort(F.collect_list(F.struct("ring", "points"))), lambda r: r["points"]).alias("rings"))
    area = F.sum(F.col("ax") * F.col("by_") - F.col("bx") * F.col("ay")) / 2
    return P.edges(nested).groupBy("poly", "ring").agg(F.count(F.lit(1)).alias("edges"), micro(area).alias("area_micro"))


@query("p04_points_in_polygons", "consumers", "rings", oracle=f"""SELECT c.id, r.poly FROM consumers c JOIN (SELECT poly, min(ax) AS x0, min(ay) AS y0, max(ax) AS x1, max(ay) AS y1 FROM rings GROUP BY poly) b ON c.x BETWEEN x0 AND x1 AND c.y BETWEEN y0 AND y1 JOIN rings r ON r.poly = b.poly GROUP BY c.id, r.poly, c.x, c.y HAVING {PARITY.format('c.x', 'c.y')}""")
def points_in_polygons(s):
    """Consumers inside polygons, holes excepted."""
    # Consumers of one place and polygons that are alike are judged once.
    places, lists = copies.folded(s.consumers, "id", ["x", "y"])
    edges, _, polygons = P.folded_polygons(s.rings)
    return copies.expanded_both(P.points_inside(places, edges), ("poly", polygons), ("id", lists)).select("id", "poly")


@query("f17_polygon_intervals", "legs", "rings", oracle=f"WITH {PARTS} SELECT chain, poly, {MICRO.format('lo')} AS lo_micro, {MICRO.format('hi')} AS hi_micro, {MICRO.format('entry')} AS entry_micro FROM held")
def polygon_intervals(s):
    """Where chains run inside polygons, and the angle at which they enter."""
    f = Found(s)
    return f.of_all(f.held.select("chain", "poly", micro(F.col("lo")).alias("lo_micro"), micro(F.col("hi")).alias("hi_micro"), micro(F.col("entry")).alias("entry_micro")))


@query("j18_polygon_distances", "legs", "rings", oracle=f"WITH {APART} SELECT chain, k, poly, {MICRO.format('d')} AS d_micro FROM d")
def polygon_distances(s):
    """How far each leg is from the polygons within 15 m; 0 inside."""
    f = Found(s)
    return f.of_all(P.distances(P.near_edges(f.legs, f.edges), f.held, f.legs).select("chain", "k", "poly", micro(F.col("d")).alias("d_micro")))


OWN = f"""{APART}, oks AS (SELECT poly, need FROM zones WHERE restriction_type = 'oks'), starts AS (SELECT chain, ax AS x, ay AS y FROM m WHERE k = 0),
  covered AS (SELECT s.chain, r.poly, -1::DOUBLE AS d FROM starts s JOIN wholes b ON s.x BETWEEN xmin AND xmax AND s.y BETWEEN ymin AND ymax JOIN oks o ON o.poly = b.poly JOIN rings r ON r.poly = b.poly GROUP BY s.chain, r.poly, s.x, s.y HAVING {PARITY.format('s.x', 's.y')}),
  close AS (SELECT s.chain, r.poly, min(sqrt({to_segment('s.x', 's.y', 'r.ax', 'r.ay', 'r.bx', 'r.by_')})) AS d FROM starts s JOIN rings r ON s.x BETWEEN r.ax - 80 AND r.ax + 80 AND s.y BETWEEN r.ay - 80 AND r.ay + 80
    JOIN oks o ON o.poly = r.poly GROUP BY s.chain, r.poly, o.need HAVING min(sqrt({to_segment('s.x', 's.y', 'r.ax', 'r.ay', 'r.bx', 'r.by_')})) < o.need),
  own AS (SELECT chain, arg_min(poly, {{'d': d, 'p': poly}}) AS own, any_value(final_) AS final_ FROM (SELECT * FROM covered UNION ALL SELECT * FROM close) x JOIN (SELECT chain, max(s1) AS final_ FROM m WHERE run = 0 GROUP BY chain) f USING (chain) GROUP BY chain)"""


@query("v28_forbidden_issues", "legs", "rings", "zones", oracle=f"""WITH {OWN},
  each AS (SELECT d.chain, d.poly, z.need, coalesce(o.own = d.poly, false) AS mine, min(d) AS d, min(d) FILTER (m.s0 >= final_ - 1e-6) AS rest FROM d JOIN zones z ON z.poly = d.poly AND z.kind = 'FORBIDDEN' JOIN m ON m.chain = d.chain AND m.k = d.k LEFT JOIN own o ON o.chain = d.chain GROUP BY ALL),
  way AS (SELECT h.chain, h.poly, lo, least(hi, final_) AS hi FROM held h JOIN own o ON o.chain = h.chain AND o.own = h.poly WHERE lo < final_ - 1e-9 AND least(hi, final_) - lo > 0.001),
  back AS (SELECT chain, poly, lo, coalesce(max(hi) OVER (PARTITION BY chain, poly ORDER BY lo ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM way)
  SELECT chain, poly, 'FORBIDDEN_CROSSED' AS code FROM each WHERE NOT mine AND d = 0 UNION SELECT chain, poly, 'CLEARANCE' FROM each WHERE NOT mine AND d > 0 AND d + 0.001::DOUBLE < need
  UNION SELECT chain, poly, 'OWN_OKS_CROSSED' FROM each WHERE mine AND rest = 0 UNION SELECT chain, poly, 'OWN_OKS_CLEARANCE' FROM each WHERE mine AND rest + 0.001::DOUBLE < need UNION SELECT chain, poly, 'OWN_OKS_CROSSED' FROM back WHERE lo > b + 0.001::DOUBLE""")
def forbidden_issues(s):
    """Forbidden polygons crossed or too near; a chain's own building only past the straight way out."""
    f = Found(s)
    d, own = table(P.distances(f.near, f.held, f.legs), "distances"), table(P.own_buildings(f.legs, f.edges, f.zones), "own")
    pairs = own.select("chain", F.col("own").alias("poly"))
    # A class of buildings that holds a chain's own one is named by it: its other members count like any building.
    of_own = P.forbidden_issues(d, f.held, f.legs, f.zones, own).join(pairs, ["chain", "poly"], "left_semi")
    others = copies.expanded(P.forbidden_issues(d, f.held, f.legs, f.zones, own.where("false")), "poly", f.polygons).join(pairs, ["chain", "poly"], "left_anti")
    return f.of_chains(others.unionByName(of_own))


SECTIONS = f"""{PARTS}, roots AS (SELECT DISTINCT chain FROM m WHERE chain % 2 = 0),
  raw AS (SELECT h.*, z.restriction_type, z.min_angle, z.extent_m, w.total, coalesce(r.chain IS NOT NULL AND z.restriction_type IN ('road', 'tram_tracks') AND hi >= w.total - 0.05, false) AS ends_ FROM held h JOIN zones z ON z.poly = h.poly AND z.kind = 'SPECIAL'
    JOIN (SELECT chain, any_value(total) AS total FROM m GROUP BY chain) w ON w.chain = h.chain LEFT JOIN roots r ON r.chain = h.chain WHERE hi - lo >= 1e-6),
  found AS (SELECT *, greatest(0, lo - extent_m) AS a, least(total, CASE WHEN ends_ THEN total ELSE hi + extent_m END) AS b, lo - extent_m < -0.05 OR CASE WHEN ends_ THEN total ELSE hi + extent_m END > total + 0.05 AS out_ FROM raw)"""


@query("p06_special_sections", "legs", "rings", "zones", oracle=f"WITH {SECTIONS} SELECT chain, poly, {MICRO.format('a')} AS from_micro, {MICRO.format('b')} AS to_micro, ends_ AS ends_inside, out_ AS sticks_out FROM found")
def special_sections(s):
    """The special section of every crossing of a road, track, pipe or cable; chains of even number end at a chamber."""
    f = Found(s, "kind = 'SPECIAL'")
    out = P.sections(f.held, f.legs, f.zones, f.legs.where("rooted"))
    return f.of_all(out.select("chain", "poly", micro(F.col("from")).alias("from_micro"), micro(F.col("to")).alias("to_micro"), "ends_inside", "sticks_out"))


@query("v29_section_issues", "legs", "rings", "zones", oracle=f"""WITH {SECTIONS}, lines AS (SELECT chain, line, any_value(special) AS special, min(s0) AS s0, max(s1) AS s1 FROM m GROUP BY chain, line),
  over_ AS (SELECT f.chain, f.poly, l.line, l.special, (s0 < a - 0.05 AND s1 > a + 0.05) OR (s0 < b - 0.05 AND s1 > b + 0.05) AS split FROM found f JOIN lines l ON l.chain = f.chain WHERE least(s1, b) - greatest(s0, a) > 0.01)
  SELECT chain, poly, NULL::INT AS line, 'CROSSING_ANGLE' AS code, 'ERROR' AS severity FROM found WHERE min_angle > 0 AND entry + 1e-4 < min_angle
  UNION SELECT chain, poly, NULL, 'CROSSING_EXIT_ANGLE', 'INFO' FROM found WHERE min_angle > 0 AND exit_ + 1e-4 < min_angle AND NOT ends_
  UNION SELECT chain, poly, NULL, 'SECTION_OUTSIDE', 'ERROR' FROM found WHERE out_
  UNION SELECT f.chain, f.poly, NULL, 'SECTION_NOT_STRAIGHT', 'ERROR' FROM found f JOIN m ON m.chain = f.chain AND m.turn > 0.01 AND m.s0 > a + 1e-6 AND m.s0 < b - 1e-6
  UNION SELECT chain, poly, line, 'CROSSING_NOT_SPECIAL', 'ERROR' FROM over_ WHERE NOT special UNION SELECT chain, poly, line, 'SECTION_BOUNDARY_NOT_SPLIT', 'ERROR' FROM over_ WHERE split
  UNION SELECT chain, NULL, line, 'SPECIAL_NOT_STRAIGHT', 'ERROR' FROM m WHERE special AND turn > 0.01 AND k % 2 = 1
  UNION SELECT chain, NULL, line, 'SPECIAL_WITHOUT_CROSSING', 'ERROR' FROM lines l WHERE special AND NOT EXISTS (SELECT 1 FROM over_ o WHERE o.chain = l.chain AND o.line = l.line)""")
def section_issues(s):
    """Codes of special sections and of lines laid as special."""
    f = Found(s, "kind = 'SPECIAL'")
    out = table(P.section_issues(P.sections(f.held, f.legs, f.zones, f.legs.where("rooted")), f.legs), "issues")
    return f.of_all(out.where("poly IS NOT NULL")).unionByName(f.of_chains(out.where("poly IS NULL")))


def disc(cx, cy):
    """SQL: (lo, hi) of the leg in a disc of radius ``r``, as lengths."""
    ux, uy = "((bx-ax)/len)", "((by_-ay)/len)"
    at, off = f"(({cx}-ax)*{ux}+({cy}-ay)*{uy})", f"(({cx}-ax)*{uy}-({cy}-ay)*{ux})"
    half2 = f"(r*r-{off}*{off})"
    half = f"sqrt(greatest({half2}, 0::DOUBLE))"
    ok = f"{half2} >= 0 AND greatest(0::DOUBLE, {at}-{half}) <= least(len, {at}+{half})"
    return f"CASE WHEN {ok} THEN greatest(0::DOUBLE, {at}-{half}) END", f"CASE WHEN {ok} THEN least(len, {at}+{half}) END"


(LO_E, HI_E), (LO_F, HI_F) = disc("ex", "ey"), disc("fx", "fy")
_U = ("((fx-ex)/en)", "((fy-ey)/en)")
_AXES = [(f"((ax-ex)*{_U[0]}+(ay-ey)*{_U[1]})", f"((bx-ex)*{_U[0]}+(by_-ey)*{_U[1]})", "0::DOUBLE", "en"), (f"((ay-ey)*{_U[0]}-(ax-ex)*{_U[1]})", f"((by_-ey)*{_U[0]}-(bx-ex)*{_U[1]})", "(-r)", "r")]
_LOW = "greatest(0::DOUBLE, " + ", ".join(f"CASE WHEN {e}-{s} <> 0 THEN least(({a}-{s})/({e}-{s}), ({b}-{s})/({e}-{s})) ELSE 0 END" for s, e, a, b in _AXES) + ")"
_HIGH = "least(1::DOUBLE, " + ", ".join(f"CASE WHEN {e}-{s} <> 0 THEN greatest(({a}-{s})/({e}-{s}), ({b}-{s})/({e}-{s})) ELSE 1 END" for s, e, a, b in _AXES) + ")"
_MISS = " OR ".join(f"({e}-{s} = 0 AND ({s} < {a} OR {s} > {b}))" for s, e, a, b in _AXES)
CAPSULES = f"""{SECTIONS}, ringed AS (SELECT n.*, z.need - 0.001::DOUBLE AS r, sqrt((fx-ex)*(fx-ex)+(fy-ey)*(fy-ey)) AS en FROM near n JOIN zones z ON z.poly = n.poly AND z.kind = 'SPECIAL'),
  bands AS (SELECT *, {_LOW} AS low, {_HIGH} AS high, {_MISS} AS misses FROM ringed),
  caps0 AS (SELECT chain, k, run, poly, ring, edge, s0, least({LO_E}, {LO_F}, CASE WHEN NOT misses AND low <= high THEN low * len END) AS lo, greatest({HI_E}, {HI_F}, CASE WHEN NOT misses AND low <= high THEN high * len END) AS hi FROM bands),
  caps AS (SELECT chain, k, run, poly, ring, edge, s0 + lo AS lo, s0 + hi AS hi FROM caps0 WHERE lo IS NOT NULL)"""


@query("f14_capsule_intervals", "legs", "rings", "zones", oracle=f"WITH {CAPSULES} SELECT chain, k, poly, ring::INT AS ring, edge::INT AS edge, {MICRO.format('lo')} AS lo_micro, {MICRO.format('hi')} AS hi_micro FROM caps")
def capsule_intervals(s):
    """Where each leg is nearer to an edge of a crossable polygon than its zone requires."""
    f = Found(s, "kind = 'SPECIAL'")
    return f.of_all(P.capsules(f.near, f.legs, f.zones.where("kind = 'SPECIAL'")).select("chain", "k", "poly", "ring", "edge", micro(F.col("lo")).alias("lo_micro"), micro(F.col("hi")).alias("hi_micro")))


def outside(discs: bool) -> str:
    """SQL: too_near(chain, poly, lo, hi) outside sections, the crossed edges' own zones and (``discs``) the first 10 m."""
    exempt = " UNION ALL SELECT p.chain, p.poly, d.lo, d.hi FROM (SELECT DISTINCT chain, poly FROM parts) p JOIN discs d ON d.chain = p.chain" if discs else ""
    return f"""parts AS (SELECT chain, poly, lo, hi FROM caps UNION ALL SELECT h.chain, h.poly, lo, hi FROM held h JOIN zones z ON z.poly = h.poly AND z.kind = 'SPECIAL'),
  discs AS (SELECT chain, s0 + lo AS lo, s0 + hi AS hi FROM (SELECT chain, s0, {disc('ax', 'ay')[0]} AS lo, {disc('ax', 'ay')[1]} AS hi FROM (SELECT *, 10::DOUBLE AS r FROM m WHERE k = 0) x) y),
  covers0 AS (SELECT chain, poly, a AS lo, b AS hi FROM found UNION ALL SELECT p.chain, p.poly, p.lo, p.hi FROM caps p WHERE EXISTS (SELECT 1 FROM c WHERE c.chain = p.chain AND c.run = p.run AND c.poly = p.poly AND c.ring = p.ring AND c.edge = p.edge)
    AND EXISTS (SELECT 1 FROM found f WHERE f.chain = p.chain AND f.poly = p.poly){exempt}),
  joined AS (SELECT *, coalesce((lo - max(hi) OVER (PARTITION BY chain, poly ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= 0.02)::INT, 1) AS nb FROM covers0),
  numbered AS (SELECT *, sum(nb) OVER (PARTITION BY chain, poly ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g FROM joined),
  covers AS (SELECT chain, poly, min(lo) AS lo, max(hi) AS hi FROM numbered GROUP BY chain, poly, g),
  marks AS (SELECT DISTINCT chain, poly, pos FROM (SELECT chain, poly, unnest([lo, hi]) AS pos FROM parts UNION ALL SELECT chain, poly, unnest([lo, hi]) FROM covers) x),
  gaps AS (SELECT chain, poly, pos AS lo, lead(pos) OVER (PARTITION BY chain, poly ORDER BY pos) AS hi FROM marks),
  too_near AS (SELECT g.chain, g.poly, g.lo, g.hi FROM gaps g WHERE hi - lo > 1e-9 AND EXISTS (SELECT 1 FROM parts p WHERE p.chain = g.chain AND p.poly = g.poly AND p.lo <= g.lo AND p.hi >= g.hi)
    AND NOT EXISTS (SELECT 1 FROM covers p WHERE p.chain = g.chain AND p.poly = g.poly AND p.lo <= g.lo AND p.hi >= g.hi))"""


@query("p07_clearance_outside", "legs", "rings", "zones", oracle=f"WITH {CAPSULES}, {outside(True)} SELECT chain, poly, {MICRO.format('lo')} AS lo_micro, {MICRO.format('hi')} AS hi_micro FROM too_near")
def clearance_outside(s):
    """Where chains are too near to crossable polygons outside their sections; the first 10 m of a chain are exempt."""
    f = Found(s, "kind = 'SPECIAL'")
    found = P.sections(f.held, f.legs, f.zones, f.legs.where("rooted"))
    centres = f.legs.where("k = 0").select("chain", F.col("ax").alias("x"), F.col("ay").alias("y"), F.lit(10.0).alias("radius"), F.lit(None).cast("bigint").alias("poly"))
    exempt = P.discs(f.legs.where("k = 0"), centres)
    out = P.alongside(f.near, f.held, f.met, found, f.legs, f.zones, exempt)
    return f.of_all(out.select("chain", "poly", micro(F.col("lo")).alias("lo_micro"), micro(F.col("hi")).alias("hi_micro")))


#: Pairs of chambers within 300 m as legs of their own, judged by all rules.
VISIBLE = f"""legs AS (SELECT {{'a': c.id, 'b': h.id}} AS chain, 0 AS k, 0 AS line, true AS special, c.x AS ax, c.y AS ay, h.x AS bx, h.y AS by_ FROM chambers c JOIN chambers h ON c.id < h.id AND (c.x-h.x)*(c.x-h.x)+(c.y-h.y)*(c.y-h.y) <= 300*300 AND (c.x <> h.x OR c.y <> h.y)),
  {CAPSULES.replace("chain % 2 = 0", "false")}, {outside(False)}, {_APART},
  shut AS (SELECT d.chain FROM d JOIN zones z ON z.poly = d.poly AND z.kind = 'FORBIDDEN' WHERE d < need - 0.001::DOUBLE UNION SELECT chain FROM too_near UNION SELECT chain FROM found WHERE out_),
  angles AS (SELECT chain, bool_or(coalesce(min_angle > 0 AND entry + 1e-4 < min_angle, false)) AS in_, bool_or(coalesce(min_angle > 0 AND exit_ + 1e-4 < min_angle, false)) AS out_ FROM found GROUP BY chain),
  bounds2 AS (SELECT DISTINCT chain, unnest([a, b]) AS pos FROM found), cells AS (SELECT chain, pos AS lo, lead(pos) OVER (PARTITION BY chain ORDER BY pos) AS hi FROM bounds2),
  tops AS (SELECT c.chain, c.lo, c.hi, max(z.kspec_pct) AS top FROM cells c JOIN found f ON f.chain = c.chain AND f.a <= c.lo AND c.hi <= f.b JOIN zones z ON z.poly = f.poly GROUP BY c.chain, c.lo, c.hi),
  extras AS (SELECT chain, sum((hi - lo) * (top - 100) / 100) AS extra FROM tops GROUP BY chain),
  seen AS (SELECT m.chain.a AS a, m.chain.b AS b, m.len AS length, s.chain IS NULL AND NOT coalesce(in_, false) AS forward, s.chain IS NULL AND NOT coalesce(g.out_, false) AS backward, g.chain IS NOT NULL AS special, m.len + coalesce(extra, 0) AS weight
    FROM m LEFT JOIN shut s ON s.chain = m.chain LEFT JOIN angles g ON g.chain = m.chain LEFT JOIN extras e ON e.chain = m.chain)"""


@query("j12_visible_pairs", "chambers", "rings", "zones", oracle=f"WITH {VISIBLE} SELECT a, b, forward, backward, special, {MICRO.format('weight')} AS weight_micro FROM seen WHERE forward OR backward")
def visible_pairs(s):
    """Chambers within 300 m that see each other past all polygons, by direction."""
    return P.visible(s.chambers, s.rings, s.zones, 300.0).select("a", "b", "forward", "backward", "special", micro(F.col("weight")).alias("weight_micro"))


def chamber_paths(s, terminals=None):
    """Least costs between all chambers over visible segments; none passes one of ``terminals``."""
    pairs = table(P.visible(s.chambers, s.rings, s.zones, 300.0), "visible")
    scene = F.lit(0).alias("scene")
    return paths.shortest(P.directed(pairs).select(scene, "src", "dst", "weight"), s.chambers.select(scene, F.col("id").alias("source")), terminals)


BEST = f"""ways AS MATERIALIZED (WITH {VISIBLE} SELECT a AS src, b AS dst, weight FROM seen WHERE forward UNION ALL SELECT b, a, weight FROM seen WHERE backward),
  best(source, node, cost) USING KEY (source, node) AS (SELECT id, id, 0::DOUBLE FROM chambers UNION
    SELECT x.source, x.node, x.cost FROM (SELECT b.source, w.dst AS node, min(b.cost + w.weight + 0.3::DOUBLE) AS cost FROM best b JOIN ways w ON w.src = b.node GROUP BY b.source, w.dst) x
    LEFT JOIN recurring.best r ON r.source = x.source AND r.node = x.node WHERE r.cost IS NULL OR x.cost < r.cost)"""


@query("g03_shortest_paths", "chambers", "rings", "zones", recursive=True, oracle=f"WITH {BEST} SELECT source, node, {MICRO.format('cost')} AS cost_micro FROM best")
def shortest_paths(s):
    """Least cost of a way between any two chambers, 0.3 m for each vertex."""
    return chamber_paths(s).select("source", "node", micro(F.col("cost")).alias("cost_micro"))


@query("g04_path_nodes", "chambers", "rings", "zones", recursive=True, oracle=f"""WITH {BEST}, prevs AS (SELECT b.source, b.node, min(w.src) AS prev FROM best b JOIN ways w ON w.dst = b.node JOIN best p ON p.source = b.source AND p.node = w.src AND p.cost + w.weight + 0.3::DOUBLE = b.cost WHERE b.node <> b.source GROUP BY b.source, b.node),
  walks AS (SELECT source, node AS target, node, 0 AS back FROM best UNION ALL SELECT w.source, w.target, p.prev, w.back + 1 FROM walks w JOIN prevs p ON p.source = w.source AND p.node = w.node)
  SELECT source, target, count(*)::BIGINT AS nodes, sum((node + 1) * (back + 1))::BIGINT AS digest FROM walks GROUP BY source, target""")
def path_nodes(s):
    """The nodes of every shortest way: how many there are, and a sum that tells their order."""
    found = table(chamber_paths(s), "paths")
    way = paths.routes(found, found.select("scene", "source", F.col("node").alias("target")))
    last = F.max("place").over(Window.partitionBy("source", "target"))
    return way.withColumn("back", last - F.col("place")).groupBy("source", "target").agg(F.count(F.lit(1)).alias("nodes"), F.sum((F.col("node") + 1) * (F.col("back") + 1)).alias("digest"))


@query("g19_separate_distances", "chambers", "rings", "zones", recursive=True, oracle=f"""WITH {BEST}, met AS (SELECT source, node, cost, row_number() OVER (PARTITION BY source ORDER BY cost, node) AS k FROM best WHERE node <> source)
  SELECT source, node AS target, {MICRO.format('cost')} AS cost_micro FROM met WHERE k = 1""")
def separate_distances(s):
    """The nearest other chamber by way, for each chamber."""
    # Every vertex costs something, so the way to the nearest chamber passes no other: ways end at the first.
    targets = s.chambers.select(F.lit(0).alias("scene"), F.col("id").alias("node"))
    found = table(chamber_paths(s, targets), "paths")
    return paths.nearest_targets(found, targets).select("source", "target", micro(F.col("cost")).alias("cost_micro"))


@query("f24_repaired_polygons", oracle=f"""SELECT p_partkey::BIGINT AS poly, {MICRO.format('(3 + p_size) * (2 + p_partkey % 9) / 2.0::DOUBLE + CASE WHEN p_partkey % 2 = 0 THEN 84 ELSE 0 END')} AS area_micro, 6 + CASE WHEN p_partkey % 2 = 0 THEN 8 ELSE 0 END AS edges, p_partkey % 5 <> 0 OR true AS was_invalid FROM part""".replace("p_partkey % 5 <> 0 OR true", "true"))
def repaired_polygons(s):
    """A bow-tie for each part, every second with a square in a square of the same turn and an edge drawn there and back: the area by parity and the edges left."""
    x, y, w, h = (F.col("p_partkey") * 37 % 1000).cast("double"), (F.col("p_partkey") * 91 % 1000).cast("double"), (3 + F.col("p_size")).cast("double"), (2 + F.col("p_partkey") % 9).cast("double")
    at = lambda *ps: F.array(*(F.struct(px.alias("x"), py.alias("y")) for px, py in ps))
    square = lambda a, n: at((x + a, y + a), (x + a + n, y + a), (x + a + n, y + a + n), (x + a, y + a + n))
    tie = at((x, y), (x + w, y + h), (x + w, y), (x, y + h))
    rings = F.when(F.col("p_partkey") % 2 == 0, F.array(tie, square(100, 10), square(103, 4), at((x + 200, y), (x + 210, y)))).otherwise(F.array(tie))
    edges = table(P.edges(s.part.select(F.col("p_partkey").cast("bigint").alias("poly"), rings.alias("rings"))), "edges")
    edges, _, lists = P.folded_polygons(edges)
    area = F.sum(F.col("ax") * F.col("by_") - F.col("bx") * F.col("ay")) / 2
    sums = P.repaired(edges).groupBy("poly").agg(F.floor(area * 1e6 + 0.5).cast("bigint").alias("area_micro"), F.count(F.lit(1)).cast("int").alias("edges"))
    bad = P.invalid(edges).withColumn("was_invalid", F.lit(True))
    judged = sums.join(bad, "poly", "left").select("poly", "area_micro", "edges", F.coalesce("was_invalid", F.lit(False)).alias("was_invalid"))
    return copies.expanded(judged, "poly", lists)


@query("p16_larger_class", "chambers", "rings", "restrictions", "rules", oracle=f"""WITH zones AS (SELECT r.id AS poly, r.restriction_type, u.kind, u.min_angle, u.extent_m, u.kspec_pct, (CASE WHEN r.restriction_type = 'oks' THEN 7000 ELSE u.clearance_mm END + 2250 / 2.0::DOUBLE + u.width_mm / 2.0::DOUBLE) / 1000 AS need FROM restrictions r JOIN rules u ON u.restriction_type = r.restriction_type),
  {VISIBLE} SELECT a, b, bool_and(forward) AS valid FROM seen GROUP BY a, b""")
def larger_class(s):
    """Segments between chambers within 300 m that hold under the clearance of DU800."""
    zones = P.zones_for(s.restrictions.select(F.col("id").alias("poly"), "restriction_type"), s.rules, 800)
    c = s.chambers.select("id", "x", "y")
    pairs = spatial.points_near_points(c, c.select(F.col("id").alias("b"), F.col("x").alias("rx"), F.col("y").alias("ry")), 300.0).where("id < b AND d2 > 0")
    legs = pairs.select(F.struct(F.col("id").alias("a"), "b").alias("chain"), F.lit(0).alias("k"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("rx").alias("bx"), F.col("ry").alias("by_"))
    return P.still_valid(legs, s.rings, zones).select("chain.a", "chain.b", "valid")


@query("j13_added_vertices", "consumers", "chambers", "rings", "zones", oracle=f"""WITH legs AS (SELECT {{'a': -1 - c.id, 'b': h.id, 'ahead': c.id % 2 = 1 OR (h.x - c.x) * 1 + (h.y - c.y) * -1 >= 0}} AS chain, 0 AS k, 0 AS line, true AS special, c.x AS ax, c.y AS ay, h.x AS bx, h.y AS by_ FROM consumers c JOIN chambers h ON (c.x-h.x)*(c.x-h.x)+(c.y-h.y)*(c.y-h.y) <= 120*120 AND (c.x <> h.x OR c.y <> h.y)),
  {VISIBLE.split('),', 1)[1].replace('m.chain.a AS a, m.chain.b AS b,', 'm.chain AS chain,')} SELECT chain.a AS src, chain.b AS dst, {MICRO.format('weight')} AS weight_micro FROM seen WHERE forward AND chain.ahead UNION ALL SELECT chain.b, chain.a, {MICRO.format('weight')} FROM seen WHERE backward""")
def added_vertices(s):
    """Consumers joined to the chambers within 120 m; every second is left to the lower right only."""
    heading = lambda v: F.when(F.col("id") % 2 == 0, F.lit(v))
    new = s.consumers.select((-1 - F.col("id")).alias("id"), "x", "y", heading(1.0).alias("hx"), heading(-1.0).alias("hy"))
    return P.joined(new, s.chambers, s.rings, s.zones, 120.0).select("src", "dst", micro(F.col("weight")).alias("weight_micro"))


@query("f13_boundary_angles", "legs", "rings", oracle=f"""SELECT chain, k, poly, {MICRO.format('arg_min(angle, [d2, ring, edge])')} AS angle_micro FROM (SELECT m.chain, m.k, r.poly, r.ring, r.k AS edge, {to_segment('m.ax', 'm.ay', 'r.ax', 'r.ay', 'r.bx', 'r.by_')} AS d2, degrees(CASE WHEN d > pi() / 2 THEN pi() - d ELSE d END) AS angle
  FROM legs m JOIN rings r ON least(r.ax, r.bx) - 15 <= m.ax AND greatest(r.ax, r.bx) + 15 >= m.ax AND least(r.ay, r.by_) - 15 <= m.ay AND greatest(r.ay, r.by_) + 15 >= m.ay,
  LATERAL (SELECT {ANGLE.replace('fy-ey', 'r.by_-r.ay').replace('fx-ex', 'r.bx-r.ax').replace('by_-ay, bx-ax', 'm.by_-m.ay, m.bx-m.ax')} AS d) g) x WHERE d2 <= 225 GROUP BY chain, k, poly""")
def boundary_angles(s):
    """The angle of each leg to the boundary nearest to where it begins."""
    legs, chains = P.folded_chains(s.legs.drop("line", "special"))
    edges, _, polygons = P.folded_polygons(s.rings)
    found = P.boundary_angles(legs, edges).select("chain", "k", "poly", micro(F.col("angle")).alias("angle_micro"))
    return copies.expanded_both(found, ("poly", polygons), ("chain", chains))


@query("p18_single_exits", "legs", "rings", "zones", oracle=f"""WITH {OWN}, way AS (SELECT o.chain, CASE WHEN least(h.hi, final_) - h.lo > 0.001 THEN h.lo END AS lo FROM own o LEFT JOIN held h ON h.chain = o.chain AND h.poly = o.own WHERE h.lo IS NULL OR h.lo < final_ - 1e-9) SELECT chain, coalesce(max(lo), 0) <= 0.001 AS once FROM way GROUP BY chain""")
def single_exits(s):
    """Whether the straight way out of the own building leaves it once."""
    f = Found(s, "restriction_type = 'oks'", first=True)
    return f.of_chains(P.single_exits(f.held, P.own_buildings(f.legs, f.edges, f.zones)))


@query("v25_turns_at_chambers", "legs", oracle="""WITH ends AS (SELECT chain, arg_max({'x': bx - ax, 'y': by_ - ay}, k) AS p, arg_min({'x': bx - ax, 'y': by_ - ay}, k) AS q FROM legs GROUP BY chain)
  SELECT 'ERROR' AS severity, 'TURN_AT_CHAMBER' AS code, a.chain AS id FROM ends a JOIN ends b ON b.chain = CAST(floor((a.chain - 1) / 2) AS BIGINT) WHERE a.chain > 0 AND degrees(abs(atan2(a.p.x * b.q.y - a.p.y * b.q.x, a.p.x * b.q.x + a.p.y * b.q.y))) > 90.0001""")
def turns_at_chambers(s):
    """Chains that turn by more than 90 degrees where they join the chain of half their number."""
    joints = s.legs.select("chain").distinct().where("chain > 0").select("chain", F.expr("(chain - 1) div 2").alias("onto"))
    return P.turns_at_joints(s.legs, joints).where("turn > 90.0001").select(F.lit("ERROR").alias("severity"), F.lit("TURN_AT_CHAMBER").alias("code"), F.col("chain").alias("id"))


#: Lines along others of the net: 4 mm apart over 20 m, 4 mm over half a metre, and 2 cm apart.
TWINS = """SELECT -1 - id AS chain, 0 AS k, ax + 100 AS ax, ay + CASE WHEN id % 3 = 2 THEN 0.02::DOUBLE ELSE 0.004::DOUBLE END AS ay, ax + CASE WHEN id % 3 = 1 THEN 100.5::DOUBLE ELSE 120::DOUBLE END AS bx, by_ + CASE WHEN id % 3 = 2 THEN 0.02::DOUBLE ELSE 0.004::DOUBLE END AS by_ FROM net_lines"""


@query("v26_lines_too_close", "net_lines", oracle=f"WITH twins AS ({TWINS}) SELECT 'ERROR' AS severity, 'LINES_TOO_CLOSE' AS code, t.chain AS id, n.id AS other, CAST(round((t.bx - t.ax) + 2 * sqrt(0.01::DOUBLE * 0.01 - 0.004::DOUBLE * 0.004), 3) * 1000 AS BIGINT) - CAST(round(2 * sqrt(0.01::DOUBLE * 0.01 - 0.004::DOUBLE * 0.004), 3) * 1000 AS BIGINT) AS length_mm FROM twins t JOIN net_lines n ON abs(t.ay - n.ay) <= 0.01 WHERE t.bx - t.ax > 1")
def lines_too_close(s):
    """New lines within 1 cm of a line of the net over more than 1 m."""
    off = F.expr("CASE WHEN id % 3 = 2 THEN 0.02D ELSE 0.004D END")
    twins = s.net_lines.select((-1 - F.col("id")).alias("chain"), F.lit(0).alias("k"), (F.col("ax") + 100).alias("ax"), (F.col("ay") + off).alias("ay"), (F.col("ax") + F.expr("CASE WHEN id % 3 = 1 THEN 100.5D ELSE 120D END")).alias("bx"), (F.col("by_") + off).alias("by_"))
    net = s.net_lines.select(F.col("id").alias("chain"), F.lit(0).alias("k"), "ax", "ay", "bx", "by_")
    out = P.runs_together(table(P.measured(twins.unionByName(net)), "legs")).where("length > 1")
    return out.select(F.lit("ERROR").alias("severity"), F.lit("LINES_TOO_CLOSE").alias("code"), F.col("chain").alias("id"), "other", F.floor(F.col("length") * 1000 + 0.5).cast("bigint").alias("length_mm"))
