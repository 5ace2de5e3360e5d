"""True polygons as a table of ring edges: containment, intervals, clearance, crossing and section rules.

A polygon is its edges (poly, ring, k, ax, ay, bx, by_); outer rings and holes
are alike, since what is inside is told by parity. Routes are legs (chain, k,
ax, ay, bx, by_), straight pieces in order; ``measured`` adds where each
begins and ends along its chain and which straight run it belongs to.

Everything is a join of legs or points with edges on grid cells or strips,
followed by sums by (chain, polygon): no polygon is one row, so a coast of a
million edges is spread like any other data, and none is replaced by its box.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from . import copies, spatial
from .shared import table

# Fixed values.
TOLERANCE = 0.001
SNAP = 0.05
STRAIGHT_DEG, ANGLE_DEG = 0.01, 1e-4
OVERLAP, REST = 0.01, 0.02
#: How far from a route an object may matter, beyond what it requires.
REACH = 15.0
ENDS = ["ax", "ay", "bx", "by_"]
#: Types whose polygon may hold the chamber at the end of a chain.
ROADS = ("road", "tram_tracks")


def edges(polygons: DataFrame, poly: str = "poly", rings: str = "rings") -> DataFrame:
    """The edges of polygons whose ``rings`` are arrays of points (x, y); open rings are closed, repeated points make no edge."""
    out = polygons.select(F.col(poly).alias("poly"), F.posexplode(rings).alias("ring", "_points"))
    last = F.size("_points")
    closed = F.concat("_points", F.slice("_points", 1, 1))
    pair = F.zip_with("_points", F.slice(closed, 2, last), lambda a, b: F.struct(a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by_")))
    return out.select("poly", "ring", F.posexplode(pair).alias("k", "_e")).select("poly", "ring", "k", "_e.*").where("ax <> bx OR ay <> by_")


def folded_polygons(ring_edges: DataFrame, zones: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None, DataFrame]:
    """Edges and zones of one polygon for each class of like ones, the smallest, and the lists of ``copies`` that name its members."""
    classes, lists = copies.same_parts(ring_edges.select("poly", "ring", "k", *ENDS), "poly", ["ring", "k"], zones)
    of = lambda df: df.join(classes.select("poly"), "poly", "left_semi")
    return table(of(ring_edges), "edges"), None if zones is None else table(of(zones), "zones"), lists


def folded_chains(legs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Legs of one chain for each class of chains that agree in all columns of their legs, the smallest, and the lists of its members."""
    classes, lists = copies.same_parts(legs, "chain", ["k"])
    return legs.join(classes.select("chain"), "chain", "left_semi"), lists


def boxes(ring_edges: DataFrame) -> DataFrame:
    """poly and its box."""
    return ring_edges.groupBy("poly").agg(F.min(F.least("ax", "bx")).alias("xmin"), F.min(F.least("ay", "by_")).alias("ymin"), F.max(F.greatest("ax", "bx")).alias("xmax"), F.max(F.greatest("ay", "by_")).alias("ymax"))


def measured(legs: DataFrame) -> DataFrame:
    """Adds len, s0, s1 (measures along the chain), total, and run: legs that go straight on share one."""
    w = Window.partitionBy("chain").orderBy("k")
    dx, dy = F.col("bx") - F.col("ax"), F.col("by_") - F.col("ay")
    out = legs.withColumn("len", F.sqrt(dx * dx + dy * dy)).withColumns({"s0": F.coalesce(F.sum("len").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)), "total": F.sum("len").over(Window.partitionBy("chain"))})
    px, py = F.lag(dx).over(w), F.lag(dy).over(w)
    turn = F.degrees(F.abs(F.atan2(px * dy - py * dx, px * dx + py * dy)))
    out = out.withColumns({"s1": F.col("s0") + F.col("len"), "turn": F.coalesce(turn, F.lit(0.0))})
    return out.withColumn("run", F.sum((F.col("turn") > STRAIGHT_DEG).cast("int")).over(w))


def inside(points: DataFrame, ring_edges: DataFrame, keys: list[str], cell: float = spatial.CELL) -> DataFrame:
    """Rows of ``points`` (keys, poly, x, y) inside their polygon, by the parity of edges to the right.

    Edges are dealt to horizontal strips, so a point meets only those of its
    polygon that lie in its strip.
    """
    strips = ring_edges.where("ay <> by_").withColumn("strip", F.explode(F.sequence(F.floor(F.least("ay", "by_") / cell), F.floor(F.greatest("ay", "by_") / cell))))
    p = points.withColumn("strip", F.floor(F.col("y") / cell))
    x, y, ax, ay, bx, by = (F.col(c) for c in ("x", "y", *ENDS))
    right = ((ay > y) != (by > y)) & (x < ax + (y - ay) / (by - ay) * (bx - ax))
    met = p.join(strips.select("poly", "strip", *ENDS), ["poly", "strip"]).where(right)
    return met.groupBy(*keys, "poly").agg(F.count(F.lit(1)).alias("_n")).where("_n % 2 = 1").drop("_n")


def points_inside(points: DataFrame, ring_edges: DataFrame, key: str = "id") -> DataFrame:
    """(key, poly) of all points (key, x, y) inside a polygon."""
    return inside(spatial.points_in_boxes(points, boxes(ring_edges)).select(key, "x", "y", "poly"), ring_edges, [key])


def cuts(legs: DataFrame, ring_edges: DataFrame, cell: float = spatial.CELL) -> DataFrame:
    """chain, k, poly, ring, edge, t, angle: where legs meet edges, as a share of the leg, ends included; both ends of an edge along the leg."""
    a = spatial.walked(legs.select("chain", "k", *ENDS), cell, 1e-6)
    b = spatial.walked(ring_edges.select("poly", "ring", F.col("k").alias("edge"), *ENDS), cell, 1e-6).select("poly", "ring", "edge", "cx", "cy", *(F.col(c).alias(f"e{c}") for c in ENDS))
    ax, ay, bx, by = (F.col(c) for c in ENDS)
    ex, ey, fx, fy = (F.col(f"e{c}") for c in ENDS)
    o1, o2, o3, o4 = G.orientation(ax, ay, bx, by, ex, ey), G.orientation(ax, ay, bx, by, fx, fy), G.orientation(ex, ey, fx, fy, ax, ay), G.orientation(ex, ey, fx, fy, bx, by)
    sq = (bx - ax) * (bx - ax) + (by - ay) * (by - ay)
    along = lambda x, y: ((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / sq
    t = F.when((o3 == 0) & (o4 == 0), F.array(along(ex, ey), along(fx, fy))).otherwise(F.array(o3 / (o3 - o4)))
    meet = (o1 * o2 <= 0) & (o3 * o4 <= 0) & (sq > 0)
    out = a.join(b.hint("merge"), ["cx", "cy"]).where(meet).withColumn("t", F.explode(t)).where("t BETWEEN 0 AND 1")
    # A pair may meet in several cells; what it gives is the same.
    return out.select("chain", "k", "poly", "ring", "edge", *ENDS, "t", G.acute_angle(bx - ax, by - ay, fx - ex, fy - ey).alias("angle")).distinct()


def intervals(legs: DataFrame, ring_edges: DataFrame, met: DataFrame | None = None, cell: float = spatial.CELL) -> DataFrame:
    """chain, poly, lo, hi, entry, exit: the parts of measured chains inside polygons, with the angles to the boundary where they begin and end (null where the chain itself does).

    Each leg is cut at its meetings with a polygon's edges, ordered along it;
    a part is inside if its middle is, and parts that touch are one.
    """
    keys = ["chain", "k", "poly", *ENDS]
    met = cuts(legs, ring_edges, cell) if met is None else met
    pairs = spatial.segments_in_boxes(legs.select("chain", "k", *ENDS), boxes(ring_edges), cell).select(*keys)
    none = F.lit(None).cast("double")
    bounds = (pairs.select(*keys, F.explode(F.array(F.lit(0.0), F.lit(1.0))).alias("t"), none.alias("angle"))
              .unionByName(met.select(*keys, F.explode(F.array(F.lit(0.0), F.lit(1.0))).alias("t"), none.alias("angle"))).unionByName(met.select(*keys, "t", "angle")))
    bounds = bounds.groupBy(*keys, "t").agg(F.min("angle").alias("angle"))
    w = Window.partitionBy(*keys).orderBy("t")
    parts = bounds.select(*keys, F.col("t").alias("t0"), F.lead("t").over(w).alias("t1"), F.col("angle").alias("entry"), F.lead("angle").over(w).alias("exit")).where("t1 > t0")
    middle = (F.col("t0") + F.col("t1")) / 2
    ax, ay, bx, by = (F.col(c) for c in ENDS)
    parts = parts.select("chain", "k", "poly", "t0", "t1", "entry", "exit", (ax + (bx - ax) * middle).alias("x"), (ay + (by - ay) * middle).alias("y"))
    held = inside(parts, ring_edges, ["chain", "k", "t0", "t1", "entry", "exit"], cell)
    place = held.join(legs.select("chain", "k", "s0", "len"), ["chain", "k"]).select("chain", "poly", (F.col("s0") + F.col("t0") * F.col("len")).alias("lo"), (F.col("s0") + F.col("t1") * F.col("len")).alias("hi"), "entry", "exit")
    order = Window.partitionBy("chain", "poly").orderBy("lo", "hi")
    # Angles that are null are passed over: a chain that begins on the boundary has a part of no length before the one that has the angle.
    known = lambda angle, at: F.when(F.col(angle).isNotNull(), F.col(at))
    return (place.withColumn("_b", F.coalesce((F.col("lo") > F.lag("hi").over(order) + 1e-6).cast("int"), F.lit(1))).withColumn("_island", F.sum("_b").over(order))
            .groupBy("chain", "poly", "_island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min_by("entry", known("entry", "lo")).alias("entry"), F.max_by("exit", known("exit", "hi")).alias("exit")).drop("_island"))


def near_edges(legs: DataFrame, ring_edges: DataFrame, radius: float = REACH, cell: float = 40.0) -> DataFrame:
    """chain, k, poly, ring, edge, both ends of leg and edge, d2: edges at most ``radius`` from a leg, once for each cell they share."""
    a = spatial.walked(legs.select("chain", "k", *ENDS), cell, radius)
    b = spatial.walked(ring_edges.select("poly", "ring", F.col("k").alias("edge"), *ENDS), cell, 1e-6).select("poly", "ring", "edge", "cx", "cy", *(F.col(c).alias(f"e{c}") for c in ENDS))
    d2 = G.segments_distance2([F.col(c) for c in ENDS], [F.col(f"e{c}") for c in ENDS])
    apart = lambda p, q, e, f: (F.least(p, q) - radius > F.greatest(e, f)) | (F.greatest(p, q) + radius < F.least(e, f))
    # Nor may both ends of an edge lie beyond the radius on one side of the leg's line.
    o1, o2 = (G.orientation(*(F.col(c) for c in ENDS), F.col(x), F.col(y)) for x, y in (("eax", "eay"), ("ebx", "eby_")))
    dx, dy = F.col("bx") - F.col("ax"), F.col("by_") - F.col("ay")
    wide = (radius + 1e-6) * F.sqrt(dx * dx + dy * dy) + 1e-6
    close = ~(apart("ax", "bx", "eax", "ebx") | apart("ay", "by_", "eay", "eby_")) & (F.least(o1, o2) <= wide) & (F.greatest(o1, o2) >= -wide)
    # The distance is a generated column, so that it is no part of the join's condition, which stays short and sees most pairs.
    return a.join(b.hint("merge"), ["cx", "cy"]).drop("cx", "cy").where(close).select("*", F.explode(F.array(d2)).alias("d2")).where(F.col("d2") <= radius * radius)


def reach(zones: DataFrame) -> float:
    """The largest distance that any zone requires: what is farther away matters to no rule."""
    return float(zones.agg(F.max("need")).first()[0] or 0.0) + OVERLAP


def distances(near: DataFrame, held: DataFrame, legs: DataFrame) -> DataFrame:
    """chain, k, poly, d: how far each leg is from the polygons near it; 0 where a part of it is inside."""
    d = near.groupBy("chain", "k", "poly").agg(F.sqrt(F.min("d2")).alias("d"))
    within = held.join(legs.select("chain", "k", "s0", "s1"), "chain").where("least(hi, s1) - greatest(lo, s0) > 1e-9").select("chain", "k", "poly").distinct().withColumn("_in", F.lit(True))
    return d.join(within, ["chain", "k", "poly"], "full").select("chain", "k", "poly", F.when(F.col("_in"), 0.0).otherwise(F.col("d")).alias("d"))


def capsules(near: DataFrame, legs: DataFrame, zones: DataFrame) -> DataFrame:
    """chain, k, run, poly, ring, edge, lo, hi: along the chain, where it is nearer to an edge than its zone (poly, need) requires.

    What is within a radius of an edge is a capsule, two discs and a strip; it
    is convex, so a leg has one interval in it.
    """
    a, b = F.struct(F.col("ax").alias("x"), F.col("ay").alias("y")), F.struct(F.col("bx").alias("x"), F.col("by_").alias("y"))
    e, f = F.struct(F.col("eax").alias("x"), F.col("eay").alias("y")), F.struct(F.col("ebx").alias("x"), F.col("eby_").alias("y"))

    # Steps are bound by lambdas: filters pushed below would else repeat each step's expression in the next.
    def capsule(v):
        along = lambda p: (p["x"] - e["x"]) * v["ux"] + (p["y"] - e["y"]) * v["uy"]
        off = lambda p: (p["y"] - e["y"]) * v["ux"] - (p["x"] - e["x"]) * v["uy"]
        return G.let(F.struct(along(a).alias("s1"), along(b).alias("e1"), off(a).alias("s2"), off(b).alias("e2")), lambda w: strip(v, w))

    def strip(v, w):
        low, high, misses = F.lit(0.0), F.lit(1.0), F.lit(False)
        for start, end, least, most in ((w["s1"], w["e1"], F.lit(0.0), v["m"]), (w["s2"], w["e2"], -v["r"], v["r"])):
            d = end - start
            misses = misses | ((d == 0) & ((start < least) | (start > most)))
            low = F.greatest(low, F.when(d != 0, F.least((least - start) / d, (most - start) / d)).otherwise(F.lit(0.0)))
            high = F.least(high, F.when(d != 0, F.greatest((least - start) / d, (most - start) / d)).otherwise(F.lit(1.0)))
        return G.let(F.struct(low.alias("low"), high.alias("high"), misses.alias("miss"), G.disc_interval(a, b, e, v["r"]).alias("d1"), G.disc_interval(a, b, f, v["r"]).alias("d2")), lambda x: F.struct(
            F.least(x["d1"]["lo"], x["d2"]["lo"], F.when(~x["miss"] & (x["low"] <= x["high"]), x["low"] * v["n"])).alias("lo"),
            F.greatest(x["d1"]["hi"], x["d2"]["hi"], F.when(~x["miss"] & (x["low"] <= x["high"]), x["high"] * v["n"])).alias("hi")))

    r, n, m = F.col("need") - TOLERANCE, G.distance(a, b), G.distance(e, f)
    of = G.let(F.struct(r.alias("r"), n.alias("n"), m.alias("m"), ((f["x"] - e["x"]) / m).alias("ux"), ((f["y"] - e["y"]) / m).alias("uy")), capsule)
    # What is farther than required, less the tolerance, has no interval.
    out = near.join(zones.select("poly", "need"), "poly").where("d2 <= need * need").withColumn("_c", of).select("chain", "k", "poly", "ring", "edge", "_c.lo", "_c.hi").where("lo IS NOT NULL").distinct()
    return out.join(legs.select("chain", "k", "s0", "run"), ["chain", "k"]).select("chain", "k", "run", "poly", "ring", "edge", (F.col("s0") + F.col("lo")).alias("lo"), (F.col("s0") + F.col("hi")).alias("hi"))


def discs(legs: DataFrame, centres: DataFrame) -> DataFrame:
    """chain, poly, lo, hi: along the chain, inside exempt discs (chain, x, y, radius, poly: null exempts from all polygons)."""
    a, b = F.struct(F.col("ax").alias("x"), F.col("ay").alias("y")), F.struct(F.col("bx").alias("x"), F.col("by_").alias("y"))
    met = legs.join(centres, "chain").withColumn("_c", G.disc_interval(a, b, F.struct("x", "y"), F.col("radius"))).where("_c IS NOT NULL")
    return met.select("chain", "poly", (F.col("s0") + F.col("_c.lo")).alias("lo"), (F.col("s0") + F.col("_c.hi")).alias("hi"))


def outside_covers(near: DataFrame, covers: DataFrame) -> DataFrame:
    """chain, poly, lo, hi: what is left of ``near`` where no cover of the same chain and polygon lies, in gaps of ``REST`` at least.

    Both are intervals along chains. Ends of covers and near parts are swept in
    order: a part counts where some near part is open and no cover is.
    """
    keys = ["chain", "poly"]
    # Covers that leave less than REST between them have no gap.
    order = Window.partitionBy(*keys).orderBy("lo", "hi")
    reach = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    joined = covers.select(*keys, "lo", "hi").withColumn("_b", F.coalesce((F.col("lo") - reach >= REST).cast("int"), F.lit(1))).withColumn("_i", F.sum("_b").over(order))
    solid = joined.groupBy(*keys, "_i").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    step = lambda df, kind: df.select(*keys, F.explode(F.array(F.struct(F.col("lo").alias("at"), F.lit(1).alias("d")), F.struct(F.col("hi").alias("at"), F.lit(-1).alias("d")))).alias("e"), F.lit(kind).alias("kind"))
    events = step(near, "near").unionByName(step(solid, "cover")).groupBy(*keys, F.col("e.at").alias("at")).agg(
        F.sum(F.when(F.col("kind") == "near", F.col("e.d")).otherwise(0)).alias("_n"), F.sum(F.when(F.col("kind") == "cover", F.col("e.d")).otherwise(0)).alias("_c"))
    w = Window.partitionBy(*keys).orderBy("at")
    opened = w.rowsBetween(Window.unboundedPreceding, 0)
    swept = events.select(*keys, F.col("at").alias("lo"), F.lead("at").over(w).alias("hi"), F.sum("_n").over(opened).alias("_n"), F.sum("_c").over(opened).alias("_c"))
    return swept.where("_n > 0 AND _c = 0 AND hi - lo > 1e-9").select(*keys, "lo", "hi")


def own_buildings(legs: DataFrame, ring_edges: DataFrame, zones: DataFrame) -> DataFrame:
    """chain, own, final: the building (``oks``) that holds the chain's start or else is nearest within what it requires, and how far the chain goes straight on from there."""
    starts = legs.where("k = 0").select("chain", F.col("ax").alias("x"), F.col("ay").alias("y"))
    oks = zones.where("restriction_type = 'oks'").select("poly", "need")
    own_edges = ring_edges.join(oks, "poly")
    held = points_inside(starts, own_edges, "chain").withColumn("d", F.lit(-1.0))
    radius = REACH
    close = spatial.points_near_segments(starts, own_edges, radius, 2 * radius).where(F.sqrt("d2") < F.col("need")).groupBy("chain", "poly").agg(F.sqrt(F.min("d2")).alias("d"))
    own = held.select("chain", "poly", "d").unionByName(close).groupBy("chain").agg(F.min_by("poly", F.struct("d", "poly")).alias("own"))
    straight = legs.where("run = 0").groupBy("chain").agg(F.max("s1").alias("final"))
    return own.join(straight, "chain")


def forbidden_issues(d: DataFrame, held: DataFrame, legs: DataFrame, zones: DataFrame, own: DataFrame) -> DataFrame:
    """chain, poly, code of forbidden objects: FORBIDDEN_CROSSED, CLEARANCE, OWN_OKS_CROSSED, OWN_OKS_CLEARANCE.

    The building a chain starts from may be left once, on the straight way out;
    past that it counts like another. ``d`` is of ``distances``.
    """
    rows = d.join(zones.where("kind = 'FORBIDDEN'").select("poly", "need"), "poly").join(legs.select("chain", "k", "s0"), ["chain", "k"]).join(own, "chain", "left")
    mine = F.coalesce(F.col("own") == F.col("poly"), F.lit(False))
    rest = F.col("s0") >= F.col("final") - 1e-6
    each = rows.groupBy("chain", "poly", "need", mine.alias("mine")).agg(F.min("d").alias("d"), F.min(F.when(rest, F.col("d"))).alias("d_rest"))
    near = lambda x: F.col(x) + TOLERANCE < F.col("need")
    codes = F.when(F.col("mine"), F.array(F.when(F.col("d_rest") == 0, "OWN_OKS_CROSSED"), F.when(near("d_rest"), "OWN_OKS_CLEARANCE"))).otherwise(
        F.array(F.when(F.col("d") == 0, "FORBIDDEN_CROSSED").when(near("d"), "CLEARANCE")))
    out = each.select("chain", "poly", F.explode(F.array_compact(codes)).alias("code"))
    # Parts inside the own building on the way out, in order: a second one, or one that begins later, is a return.
    way = held.join(own, "chain").where("poly = own AND lo < final - 1e-9").select("chain", "poly", "lo", F.least("hi", "final").alias("hi")).where(F.col("hi") - F.col("lo") > TOLERANCE)
    before = F.coalesce(F.max("hi").over(Window.partitionBy("chain", "poly").orderBy("lo").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    back = way.where("hi > lo").withColumn("_b", before).where(F.col("lo") > F.col("_b") + TOLERANCE).select("chain", "poly", F.lit("OWN_OKS_CROSSED").alias("code"))
    return out.unionByName(back).distinct()


def sections(held: DataFrame, legs: DataFrame, zones: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """chain, poly, from, to, lo, hi, entry, exit, total, ends_inside: the special section of every crossing of a crossable polygon.

    A chain of ``roots`` (chain) whose last point lies inside a road or tram
    polygon ends there: its section reaches to the end and has no exit.
    """
    special = zones.where("kind = 'SPECIAL'").select("poly", "restriction_type", "min_angle", "extent_m", "kspec_pct")
    whole = legs.select("chain", "total").distinct()
    out = held.where("hi - lo >= 1e-6").join(special, "poly").join(whole, "chain")
    rooted = F.lit(False)
    if roots is not None:
        out = out.join(roots.select("chain").distinct().withColumn("_root", F.lit(True)), "chain", "left")
        rooted = F.coalesce("_root", F.lit(False))
    ends = rooted & F.col("restriction_type").isin(*ROADS) & (F.col("hi") >= F.col("total") - SNAP)
    out = out.withColumns({"ends_inside": ends, "_from": F.col("lo") - F.col("extent_m"), "_to": F.when(ends, F.col("total")).otherwise(F.col("hi") + F.col("extent_m"))})
    return out.select("chain", "poly", F.greatest(F.lit(0.0), "_from").alias("from"), F.least("total", "_to").alias("to"), "lo", "hi", "entry", "exit", "total", "min_angle", "kspec_pct", "ends_inside",
                      ((F.col("_from") < -SNAP) | (F.col("_to") > F.col("total") + SNAP)).alias("sticks_out"))


def section_issues(found: DataFrame, legs: DataFrame) -> DataFrame:
    """chain, poly, line, severity, code of special sections and special lines; poly or line is null where the issue has none.

    CROSSING_ANGLE, CROSSING_EXIT_ANGLE (information), SECTION_OUTSIDE,
    SECTION_NOT_STRAIGHT, CROSSING_NOT_SPECIAL, SECTION_BOUNDARY_NOT_SPLIT,
    SPECIAL_NOT_STRAIGHT, SPECIAL_WITHOUT_CROSSING. Legs have ``line`` and ``special``.
    """
    low = lambda c: (F.col("min_angle") > 0) & (F.col(c) + ANGLE_DEG < F.col("min_angle"))
    no_line, no_poly = F.lit(None).cast("int"), F.lit(None).cast("bigint")
    angles = found.select("chain", "poly", no_line.alias("line"), F.explode(F.array_compact(F.array(
        F.when(low("entry"), "CROSSING_ANGLE"), F.when(low("exit") & ~F.col("ends_inside"), "CROSSING_EXIT_ANGLE"), F.when(F.col("sticks_out"), "SECTION_OUTSIDE")))).alias("code"))
    turns = legs.where(F.col("turn") > STRAIGHT_DEG).select("chain", F.col("s0").alias("at"))
    bent = found.join(turns, "chain").where("at > from + 1e-6 AND at < to - 1e-6").select("chain", "poly", no_line.alias("line"), F.lit("SECTION_NOT_STRAIGHT").alias("code"))
    lines = legs.groupBy("chain", "line").agg(F.first("special").alias("special"), F.min("s0").alias("a"), F.max("s1").alias("b"))
    over = found.join(lines, "chain").where(F.least("b", "to") - F.greatest("a", "from") > OVERLAP)
    split = lambda at: (F.col("a") < F.col(at) - SNAP) & (F.col("b") > F.col(at) + SNAP)
    laid = over.select("chain", "poly", "line", F.explode(F.array_compact(F.array(F.when(~F.col("special"), "CROSSING_NOT_SPECIAL"), F.when(split("from") | split("to"), "SECTION_BOUNDARY_NOT_SPLIT")))).alias("code"))
    w = Window.partitionBy("chain", "line").orderBy("k")
    crooked = legs.where("special").withColumn("_first", F.row_number().over(w) == 1).where((F.col("turn") > STRAIGHT_DEG) & ~F.col("_first")).select("chain", no_poly.alias("poly"), "line", F.lit("SPECIAL_NOT_STRAIGHT").alias("code"))
    alone = lines.where("special").join(over.select("chain", "line").distinct(), ["chain", "line"], "left_anti").select("chain", no_poly.alias("poly"), "line", F.lit("SPECIAL_WITHOUT_CROSSING").alias("code"))
    out = angles.unionByName(bent).unionByName(laid).unionByName(crooked).unionByName(alone).distinct()
    return out.withColumn("severity", F.when(F.col("code") == "CROSSING_EXIT_ANGLE", "INFO").otherwise("ERROR"))


def alongside(near: DataFrame, held: DataFrame, met: DataFrame, found: DataFrame, legs: DataFrame, zones: DataFrame, exempt: DataFrame | None = None) -> DataFrame:
    """chain, poly, lo, hi: where a chain is nearer to a crossable polygon than required, outside its sections.

    The zone of the very edges that are crossed counts as crossing as far as
    the chain goes straight on; ``exempt`` are intervals of ``discs``.
    """
    special = zones.where("kind = 'SPECIAL'")
    close = table(capsules(near, legs, special), "capsules")
    parts = close.select("chain", "poly", "lo", "hi").unionByName(held.join(special.select("poly"), "poly").select("chain", "poly", "lo", "hi"))
    crossed = met.join(legs.select("chain", "k", "run"), ["chain", "k"]).select("chain", "run", "poly", "ring", "edge").distinct()
    crossed = crossed.join(found.select("chain", "poly").distinct(), ["chain", "poly"])
    covers = found.select("chain", "poly", F.col("from").alias("lo"), F.col("to").alias("hi")).unionByName(close.join(crossed, ["chain", "run", "poly", "ring", "edge"]).select("chain", "poly", "lo", "hi"))
    if exempt is not None:
        of_all = parts.select("chain", "poly").distinct().join(exempt.where("poly IS NULL").drop("poly"), "chain").select("chain", "poly", "lo", "hi")
        covers = covers.unionByName(of_all).unionByName(exempt.where("poly IS NOT NULL").select("chain", "poly", "lo", "hi"))
    return outside_covers(parts, covers)


def verdicts(segments: DataFrame, ring_edges: DataFrame, zones: DataFrame) -> DataFrame:
    """chain, length, forward, backward, special, weight of straight segments (chain, ax, ay, bx, by_) among polygons.

    A segment is admissible if no forbidden polygon is nearer than required and
    every crossing of another has its section inside the segment and nothing too
    near beside it. The angle counts where a polygon is entered, so one direction
    may hold and the other not. The weight is the length, its parts in sections
    times the largest factor there. Segments that meet nothing are admissible.
    Of a segment too near to a forbidden polygon no more is asked: it is special
    or not, and weighs, only where it is told so (else null).
    """
    from . import intervals as I

    # Each is read several times below.
    ring_edges, zones, _ = folded_polygons(ring_edges, zones)
    # Segments that lie alike are judged once, under their ends as a name.
    every = table(segments.select(*ENDS).distinct(), "alike")
    alike = open_segments(every, ring_edges, zones).select(F.struct(*ENDS).alias("chain"), *ENDS)
    legs = table(measured(alike.select("chain", F.lit(0).alias("k"), F.lit(0).alias("line"), F.lit(True).alias("special"), *ENDS)), "legs")
    met = table(cuts(legs, ring_edges), "cuts")
    held = table(intervals(legs, ring_edges, met), "held")
    near = table(near_edges(legs, ring_edges, reach(zones)), "near")
    # Forbidden polygons first: what they shut is asked no more.
    banned, special = (zones.where(F.col("kind") == k).select("poly", "need") for k in ("FORBIDDEN", "SPECIAL"))
    of = lambda df, some: df.join(some.select("poly"), "poly", "left_semi")
    crossed = table(distances(of(near, banned), of(held, banned), legs).join(banned, "poly").where(F.col("d") < F.col("need") - TOLERANCE).select("chain").distinct(), "shut")
    left = lambda df: df.join(crossed, "chain", "left_anti")
    legs = table(left(legs), "legs")
    held, met = table(left(of(held, special)), "held"), left(of(met, special))
    found = table(sections(held, legs, zones), "sections")
    low = lambda c: (F.col("min_angle") > 0) & (F.col(c) + ANGLE_DEG < F.col("min_angle"))
    shut = alongside(left(of(near, special)), held, met, found, legs, zones).select("chain").unionByName(found.where("sticks_out").select("chain")).distinct().withColumn("_shut", F.lit(True))
    angles = found.groupBy("chain").agg(F.max(F.coalesce(low("entry"), F.lit(False))).alias("_in"), F.max(F.coalesce(low("exit"), F.lit(False))).alias("_out"))
    over = I.covering_max(found.withColumnRenamed("from", "lo_").withColumnRenamed("to", "hi_"), "chain", "lo_", "hi_", "kspec_pct")
    extra = over.groupBy("chain").agg(F.sum((F.col("hi") - F.col("lo")) * (F.col("top") - 100) / 100).alias("_extra"))
    out = legs.select("chain", *ENDS, F.col("len").alias("length")).join(shut, "chain", "left").join(angles, "chain", "left").join(extra, "chain", "left")
    free = F.col("_shut").isNull()
    judged = out.select(*ENDS, "length", (free & ~F.coalesce("_in", F.lit(False))).alias("forward"), (free & ~F.coalesce("_out", F.lit(False))).alias("backward"), F.col("_in").isNotNull().alias("special"),
                        (F.col("length") + F.coalesce("_extra", F.lit(0.0))).alias("weight"))
    of_all = every.join(judged, ENDS, "left").withColumns({"length": F.coalesce("length", G.distance(F.struct(F.col("ax").alias("x"), F.col("ay").alias("y")), F.struct(F.col("bx").alias("x"), F.col("by_").alias("y")))),
                                                           "forward": F.coalesce("forward", F.lit(False)), "backward": F.coalesce("backward", F.lit(False))})
    return segments.select("chain", *ENDS).join(of_all, ENDS).drop(*ENDS)


def open_segments(segments: DataFrame, ring_edges: DataFrame, zones: DataFrame, parts: tuple = (4, 16, 64), most: int = 12) -> DataFrame:
    """Segments (ax, ay, bx, by_), without those of which an end, or a place that cuts them into ``parts``, is surely too near to an edge of a forbidden polygon.

    Ends are shared by many segments and judged once. The places in between are
    anti-joins by the cell a place lies in, so no place is a row and a segment
    goes with the first place that is shut; where the edges' cells are small,
    Spark sends them to the segments. Each round, four times as fine, looks only
    at what the one before has left, ``most`` places in one job. What is left at
    last is judged in whole.
    """
    banned = table(ring_edges.select("poly", *ENDS).join(zones.where("kind = 'FORBIDDEN'").select("poly", "need"), "poly"), "banned")
    radius = float(banned.agg(F.max("need")).first()[0] or 0.0)
    if radius <= 0:
        return segments
    cell = 2 * radius
    # A hair less than required: a place rounded off its segment shuts nothing that is free.
    hair = TOLERANCE + 1e-6
    bad = spatial.points_near_segments(segments.select(F.col("ax").alias("x"), F.col("ay").alias("y")).unionByName(segments.select(F.col("bx").alias("x"), F.col("by_").alias("y"))).distinct(), banned, radius, cell)
    bad = table(bad.where(F.sqrt("d2") < F.col("need") - hair).select("x", "y").distinct(), "shut")
    left = segments
    for x, y in (("ax", "ay"), ("bx", "by_")):
        left = left.join(bad.select(F.col("x").alias(x), F.col("y").alias(y)), [x, y], "left_anti")
    left = table(left.select(*ENDS), "left")
    edges_of = banned.select(*(F.col(c).alias(f"e{c}") for c in ENDS), "need")
    near = table(spatial.dealt(edges_of, F.least("eax", "ebx"), F.least("eay", "eby_"), F.greatest("eax", "ebx"), F.greatest("eay", "eby_"), cell, radius), "cells")

    def free(rows, t):
        x, y = F.col("ax") + (F.col("bx") - F.col("ax")) * t, F.col("ay") + (F.col("by_") - F.col("ay")) * t
        here = (F.col("cx") == F.floor(x / cell)) & (F.col("cy") == F.floor(y / cell))
        return rows.join(near, here & (F.sqrt(G.point_segment_distance2(x, y, *(F.col(f"e{c}") for c in ENDS))) < F.col("need") - hair), "left_anti")

    for n in parts:
        # Places of the rounds before are known to be free.
        places = [k / n for k in range(1, n) if n == parts[0] or k % 4]
        for i in range(0, len(places), most):
            for t in places[i:i + most]:
                left = free(left, t)
            left = table(left, "left")
    return left


def visible(vertices: DataFrame, ring_edges: DataFrame, zones: DataFrame, radius: float) -> DataFrame:
    """a, b, length, forward, backward, special, weight: pairs of vertices (id, x, y) within ``radius`` that see each other, a < b; forward is from a to b.

    Vertices meet on grid cells of the radius; the pairs are then segments like
    any others, so what blocks them is found by the cells they walk.
    """
    # Vertices of one place see the same; from p to q is judged if some vertex at p is smaller than some at q.
    places, lists = copies.folded(vertices, "id", ["x", "y"])
    last = table(vertices.groupBy("x", "y").agg(F.max("id").alias("most")), "last")
    other = places.join(last, ["x", "y"]).select(F.col("id").alias("b"), F.col("x").alias("rx"), F.col("y").alias("ry"), "most")
    pairs = spatial.points_near_points(places.select("id", "x", "y"), other, radius).where("id < most AND d2 > 0")
    segments = pairs.select(F.struct(F.col("id").alias("a"), "b").alias("chain"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("rx").alias("bx"), F.col("ry").alias("by_"))
    seen = verdicts(segments, ring_edges, zones).where("forward OR backward").select("chain.a", "chain.b", "length", "forward", "backward", "special", "weight")
    return copies.expanded_both(seen, ("a", lists), ("b", lists)).where("a < b")


def directed(pairs: DataFrame) -> DataFrame:
    """src, dst, weight: the directions in which pairs of ``visible`` may be taken."""
    return pairs.where("forward").select(F.col("a").alias("src"), F.col("b").alias("dst"), "weight").unionByName(pairs.where("backward").select(F.col("b").alias("src"), F.col("a").alias("dst"), "weight"))


def noded(ring_edges: DataFrame, cell: float = 20.0) -> DataFrame:
    """poly, ax, ay, bx, by_, n: the edges of each polygon cut where they meet, each once with how often it occurs; ends in order of x, then y.

    Edges of one polygon meet on grid cells. A meeting point is computed once,
    from the edge of smaller number, so that both edges are cut at the very same
    point; edges that run along each other are cut at each other's ends.
    """
    numbered = ring_edges.select("poly", F.struct("ring", "k").alias("e"), *ENDS)
    cells = spatial.walked(numbered, cell, 1e-6)
    p, q = [F.col(f"p.{c}") for c in ENDS], [F.col(f"q.{c}") for c in ENDS]
    o1, o2, o3, o4 = G.orientation(*p, q[0], q[1]), G.orientation(*p, q[2], q[3]), G.orientation(*q, p[0], p[1]), G.orientation(*q, p[2], p[3])
    apart = (F.greatest(p[0], p[2]) < F.least(q[0], q[2])) | (F.least(p[0], p[2]) > F.greatest(q[0], q[2])) | (F.greatest(p[1], p[3]) < F.least(q[1], q[3])) | (F.least(p[1], p[3]) > F.greatest(q[1], q[3]))
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    t = o3 / (o3 - o4)
    # An end that lies on the other edge is the point itself.
    at = (F.when(o1 == 0, F.array(point(q[0], q[1]))).otherwise(F.array()), F.when(o2 == 0, F.array(point(q[2], q[3]))).otherwise(F.array()), F.when(o3 == 0, F.array(point(p[0], p[1]))).otherwise(F.array()), F.when(o4 == 0, F.array(point(p[2], p[3]))).otherwise(F.array()),
          F.when((o1 * o2 < 0) & (o3 * o4 < 0), F.array(point(p[0] + (p[2] - p[0]) * t, p[1] + (p[3] - p[1]) * t))).otherwise(F.array()))
    met = cells.alias("p").join(cells.alias("q"), (F.col("p.poly") == F.col("q.poly")) & (F.col("p.cx") == F.col("q.cx")) & (F.col("p.cy") == F.col("q.cy")) & (F.col("p.e") < F.col("q.e"))).where((o1 * o2 <= 0) & (o3 * o4 <= 0) & ~apart)
    met = table(met.select(F.col("p.poly").alias("poly"), F.col("p.e").alias("e1"), F.col("q.e").alias("e2"), F.concat(*at).alias("at")), "meetings")
    points = met.select("poly", F.col("e1").alias("e"), F.explode("at").alias("c")).unionByName(met.select("poly", F.col("e2").alias("e"), F.explode("at").alias("c"))).distinct()
    ends = numbered.select("poly", "e", F.explode(F.array(point(F.col("ax"), F.col("ay")), point(F.col("bx"), F.col("by_")))).alias("c"))
    along = ((F.col("c.x") - F.col("ax")) * (F.col("bx") - F.col("ax")) + (F.col("c.y") - F.col("ay")) * (F.col("by_") - F.col("ay")))
    length = (F.col("bx") - F.col("ax")) * (F.col("bx") - F.col("ax")) + (F.col("by_") - F.col("ay")) * (F.col("by_") - F.col("ay"))
    every = points.unionByName(ends).distinct().join(numbered, ["poly", "e"]).withColumn("_t", along).where((F.col("_t") >= 0) & (F.col("_t") <= length))
    w = Window.partitionBy("poly", "e").orderBy("_t")
    parts = every.select("poly", F.col("c").alias("a"), F.lead("c").over(w).alias("b")).where("b IS NOT NULL AND a <> b")
    low, high = F.least("a", "b"), F.greatest("a", "b")
    return parts.select("poly", low["x"].alias("ax"), low["y"].alias("ay"), high["x"].alias("bx"), high["y"].alias("by_")).groupBy("poly", *ENDS).agg(F.count(F.lit(1)).alias("n"))


def repaired(ring_edges: DataFrame) -> DataFrame:
    """Edges (poly, ring, k, ax, ay, bx, by_) of valid polygons with the same inside by parity: a bow-tie becomes two parts that touch, a ring inside a ring a hole, what is drawn twice goes.

    Every edge that occurs an odd number of times parts inside from outside, so
    those are the boundary; the inside lies to the left of each. Edges of a
    part that hangs together have one ``ring``.
    """
    from . import graph

    odd = table(noded(ring_edges).where("n % 2 = 1").drop("n"), "noded")
    dx, dy = F.col("bx") - F.col("ax"), F.col("by_") - F.col("ay")
    n = F.sqrt(dx * dx + dy * dy)
    # A little to the left of the middle: less than any edge is long.
    step = F.least(F.lit(1e-4), n * 1e-3) / n
    sided = odd.select("poly", F.struct(*ENDS).alias("e"), ((F.col("ax") + F.col("bx")) / 2 - dy * step).alias("x"), ((F.col("ay") + F.col("by_")) / 2 + dx * step).alias("y"))
    left = inside(sided, odd, ["e"]).select("poly", *(F.col(f"e.{c}").alias(c) for c in ENDS), F.lit(True).alias("_left"))
    turned = odd.join(left, ["poly", *ENDS], "left")
    way = lambda a, b: F.when(F.col("_left"), F.col(a)).otherwise(F.col(b)).alias(a)
    out = table(turned.select("poly", way("ax", "bx"), way("ay", "by_"), F.when(F.col("_left"), F.col("bx")).otherwise(F.col("ax")).alias("bx"), F.when(F.col("_left"), F.col("by_")).otherwise(F.col("ay")).alias("by_")), "turned")
    vertex = lambda x, y: F.xxhash64("poly", x, y)
    part = graph.components(out.select(vertex("ax", "ay").alias("child"), vertex("bx", "by_").alias("parent")))
    named = out.join(part.withColumnRenamed("id", "_v"), vertex("ax", "ay") == F.col("_v")).drop("_v")
    by_poly = Window.partitionBy("poly").orderBy("component")
    return named.select("poly", (F.dense_rank().over(by_poly) - 1).alias("ring"), (F.row_number().over(Window.partitionBy("poly", "component").orderBy(*ENDS)) - 1).alias("k"), *ENDS)


def invalid(ring_edges: DataFrame) -> DataFrame:
    """poly of polygons that must be repaired: edges that cross, overlap or occur twice."""
    own = ring_edges.groupBy("poly").agg(F.count(F.lit(1)).alias("_own"))
    cut = noded(ring_edges).groupBy("poly").agg(F.count(F.lit(1)).alias("_cut"), F.max("n").alias("_most"))
    return own.join(cut, "poly").where("_cut <> _own OR _most > 1").select("poly")


def zones_for(objects: DataFrame, rule_table: DataFrame, du: int) -> DataFrame:
    """Zones of objects (poly, restriction_type) for the clearance class of a diameter: poly, restriction_type, kind, min_angle, extent_m, kspec_pct, need."""
    from ..functions import engineering as E
    from ..plans import rules

    pair = next(r[4] for r in rules.DU_ROWS if r[0] == du)
    need = (E.clearance_mm(F.col("restriction_type"), F.col("clearance_mm"), F.lit(du)) + pair / 2 + F.col("width_mm") / 2) / 1000
    return objects.join(F.broadcast(rule_table), "restriction_type").select("poly", "restriction_type", "kind", "min_angle", "extent_m", "kspec_pct", need.alias("need"))


def still_valid(legs: DataFrame, ring_edges: DataFrame, zones: DataFrame) -> DataFrame:
    """chain, valid: whether all legs of a chain, as they run, are admissible under other zones, as for a larger diameter."""
    each = legs.select(F.struct("chain", "k").alias("chain"), *ENDS)
    return verdicts(each, ring_edges, zones).groupBy(F.col("chain.chain").alias("chain")).agg(F.min("forward").alias("valid"))


def joined(new: DataFrame, vertices: DataFrame, ring_edges: DataFrame, zones: DataFrame, radius: float) -> DataFrame:
    """src, dst, weight: edges between new vertices (id, x, y, hx, hy) and those of a graph (id, x, y) within ``radius``, both ways where admissible.

    A new vertex with a heading (hx, hy; null: none) is left only within 90
    degrees of it. Only pairs with a new vertex are judged: a graph grows by
    what is added.
    """
    # New vertices of one place and heading are alike, and so are vertices of one place.
    headed = new.select("id", "x", "y", F.struct("hx", "hy").alias("h"))
    fresh, fresh_lists = copies.folded(headed, "id", ["x", "y", "h"])
    places, lists = copies.folded(vertices, "id", ["x", "y"])
    pairs = spatial.points_near_points(fresh.select("id", "x", "y", "h.hx", "h.hy"), places.select(F.col("id").alias("b"), F.col("x").alias("rx"), F.col("y").alias("ry")), radius).where("d2 > 0")
    ahead = F.coalesce((F.col("rx") - F.col("x")) * F.col("hx") + (F.col("ry") - F.col("y")) * F.col("hy") >= 0, F.lit(True))
    segments = pairs.select(F.struct(F.col("id").alias("a"), "b", ahead.alias("ahead")).alias("chain"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("rx").alias("bx"), F.col("ry").alias("by_"))
    seen = verdicts(segments, ring_edges, zones).where("(forward AND chain.ahead) OR backward").select("chain.*", "forward", "backward", "weight")
    seen = table(copies.expanded(copies.expanded(seen, "a", fresh_lists), "b", lists).where("a <> b"), "seen")
    return seen.where("forward AND ahead").select(F.col("a").alias("src"), F.col("b").alias("dst"), "weight").unionByName(seen.where("backward").select(F.col("b").alias("src"), F.col("a").alias("dst"), "weight"))


def boundary_angles(legs: DataFrame, ring_edges: DataFrame, radius: float = REACH) -> DataFrame:
    """chain, k, poly, angle: of the legs that begin within ``radius`` of a polygon, the acute angle to the boundary edge nearest to their beginning; of edges that tie, the first."""
    starts = legs.select("chain", "k", F.col("ax").alias("x"), F.col("ay").alias("y"), F.col("bx").alias("tx"), F.col("by_").alias("ty"))
    near = spatial.points_near_segments(starts, ring_edges.withColumnRenamed("k", "edge"), radius, 2 * radius)
    angle = G.acute_angle(F.col("tx") - F.col("x"), F.col("ty") - F.col("y"), F.col("bx") - F.col("ax"), F.col("by_") - F.col("ay"))
    return near.groupBy("chain", "k", "poly").agg(F.min_by(angle, F.struct("d2", "ring", "edge")).alias("angle"))


def single_exits(held: DataFrame, own: DataFrame) -> DataFrame:
    """chain, once: whether the straight way out of a chain's own building (``own_buildings``) leaves it once: one part inside from its beginning, or none."""
    way = own.join(held.withColumnRenamed("poly", "own"), ["chain", "own"], "left").where("lo IS NULL OR lo < final - 1e-9")
    long_ = F.least("hi", "final") - F.col("lo") > TOLERANCE
    return way.groupBy("chain").agg((F.coalesce(F.max(F.when(long_, F.col("lo"))), F.lit(0.0)) <= TOLERANCE).alias("once"))


def runs_together(legs: DataFrame, within: float = 0.01) -> DataFrame:
    """chain, other, length: how long a chain runs within ``within`` of another of greater number."""
    from . import intervals as I

    others = legs.select(F.col("chain").alias("poly"), F.lit(0).alias("ring"), "k", *ENDS)
    near = near_edges(legs, others, 2 * within).where("chain < poly")
    zone = legs.select(F.col("chain").alias("poly")).distinct().withColumn("need", F.lit(within + TOLERANCE))
    close = capsules(near, legs, zone).select(F.struct("chain", "poly").alias("pair"), "lo", "hi")
    return I.merge(close, "pair", "lo", "hi").groupBy("pair").agg(F.sum(F.col("hi") - F.col("lo")).alias("length")).select("pair.chain", F.col("pair.poly").alias("other"), "length")


def turns_at_joints(legs: DataFrame, joints: DataFrame) -> DataFrame:
    """chain, turn: the change of direction, in degrees, from the last leg of a chain to the first of the chain it joins (chain, onto)."""
    last = legs.groupBy("chain").agg(F.max_by(F.struct(*ENDS), "k").alias("p"))
    first = legs.groupBy(F.col("chain").alias("onto")).agg(F.min_by(F.struct(*ENDS), "k").alias("q"))
    d = lambda e: (F.col(f"{e}.bx") - F.col(f"{e}.ax"), F.col(f"{e}.by_") - F.col(f"{e}.ay"))
    (px, py), (qx, qy) = d("p"), d("q")
    met = joints.join(last, "chain").join(first, "onto")
    return met.select("chain", F.degrees(F.abs(F.atan2(px * qy - py * qx, px * qx + py * qy))).alias("turn"))
