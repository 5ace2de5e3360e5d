"""Edits of a forest of links, from table to table: cut links, attach consumers, drop leaves and join what they leave.

A link is (child, parent, length_mm, line from the child, passages [(lo_mm,
hi_mm, ...)] measured from the child, reserved_mm). A link is named by its
child, which must be unique over all forests; ids are texts. Every edit takes
all its cuts or leaves at once, whatever forest they lie in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from . import graph
from .shared import table

#: Links that may meet in a node, its own way to the root included.
DEGREE = 4


def junction(child: Column, at_mm: Column, edit: str) -> Column:
    """The id of a junction: the link cut, the place from its child, and the edit, so that ids of later edits differ."""
    return F.concat(child, F.lit(f"@{edit}"), at_mm.cast("string"))


def refused_cuts(links: DataFrame, cuts: DataFrame, margin_mm: int) -> DataFrame:
    """child, at_mm, reason of cuts that can't be made: no such link, at an end or in the reserved part, or in a special passage or nearer to it than the margin."""
    held = cuts.join(links.select("child", "length_mm", "reserved_mm", "passages", F.lit(True).alias("_known")), "child", "left")
    at = F.col("at_mm")
    special = F.exists("passages", lambda p: (at > p["lo_mm"] - margin_mm) & (at < p["hi_mm"] + margin_mm))
    inside = (at > F.coalesce("reserved_mm", F.lit(0))) & (at < F.col("length_mm"))
    reason = (F.when(F.col("_known").isNull(), "no link").when(~F.coalesce(inside, F.lit(False)), "junction position")
              .when(special, "junction inside a special section"))
    return held.select("child", "at_mm", reason.alias("reason")).where("reason IS NOT NULL")


def cut(links: DataFrame, cuts: DataFrame, edit: str = "", margin_mm: int = 0) -> DataFrame:
    """Links after all cuts (child, at_mm) that ``refused_cuts`` allows; the junctions are the new children, with ``junction`` true.

    Cuts at one place are one. The lowest piece keeps the name of the link and its reserved part.
    """
    # Written once: what is asked for below would else be made anew for each use.
    links, cuts = table(links, "links"), table(cuts.distinct(), "cuts")
    good = cuts.join(refused_cuts(links, cuts, margin_mm).select("child", "at_mm"), ["child", "at_mm"], "left_anti")
    places = good.groupBy("child").agg(F.array_sort(F.collect_set("at_mm")).alias("_at"))
    held = links.join(places, "child", "left").withColumn("_at", F.coalesce("_at", F.array().cast("array<bigint>")))
    n = F.size("_at")
    pieces = held.select("*", F.posexplode(F.concat(F.array(F.lit(0).cast("bigint")), F.col("_at"))).alias("_k", "_lo"))
    pieces = pieces.withColumn("_hi", F.when(F.col("_k") < n, F.try_element_at("_at", F.col("_k") + 1)).otherwise(F.col("length_mm")))
    # Measures along the line itself, whose length may differ from the told one.
    metre = G.length(F.col("line")) / F.greatest(F.col("length_mm"), F.lit(1))
    pieces = pieces.withColumn("_metre", metre).withColumns({"_from": F.col("_lo") * F.col("_metre"), "_to": F.col("_hi") * F.col("_metre")})
    own = F.filter("passages", lambda p: (p["lo_mm"] >= F.col("_lo")) & (p["lo_mm"] < F.col("_hi")) | (p["hi_mm"] > F.col("_lo")) & (p["hi_mm"] <= F.col("_hi")))
    shifted = F.transform(own, lambda p: p.withField("lo_mm", p["lo_mm"] - F.col("_lo")).withField("hi_mm", p["hi_mm"] - F.col("_lo")))
    return pieces.select(
        F.when(F.col("_k") == 0, F.col("child")).otherwise(junction(F.col("child"), F.col("_lo"), edit)).alias("child"),
        F.when(F.col("_k") == n, F.col("parent")).otherwise(junction(F.col("child"), F.col("_hi"), edit)).alias("parent"),
        (F.col("_hi") - F.col("_lo")).alias("length_mm"),
        F.when((n == 0), F.col("line")).otherwise(G.sub_line(F.col("line"), F.col("_from"), F.col("_to"))).alias("line"),
        F.when(n == 0, F.col("passages")).otherwise(shifted).alias("passages"), F.when(F.col("_k") == 0, F.col("reserved_mm")).otherwise(0).cast("bigint").alias("reserved_mm"),
        (F.col("junction") if "junction" in links.columns else F.lit(False)).__and__(F.col("_k") == 0).__or__(F.col("_k") > 0).alias("junction"))


def refused(links: DataFrame, new: DataFrame) -> DataFrame:
    """child, parent, reason of new links that can't be attached: their child is there already or given twice, there is no such node, or no slot of it is free.

    ``DEGREE`` less the links that meet in a node are free, taken in the order of the children.
    """
    met = links.select(F.col("child").alias("node"), F.lit(1).alias("n")).unionByName(links.select(F.col("parent").alias("node"), F.lit(1).alias("n"))).groupBy("node").agg(F.sum("n").alias("_met"))
    known = links.select("child", F.lit(True).alias("_known"))
    again = F.row_number().over(Window.partitionBy("child").orderBy("parent")) > 1
    held = new.select("child", "parent").withColumn("_again", again).join(known, "child", "left").join(met.withColumnRenamed("node", "parent"), "parent", "left")
    held = held.withColumn("_good", (~F.col("_again") & F.col("_known").isNull() & F.col("_met").isNotNull()).cast("int"))
    place = F.sum("_good").over(Window.partitionBy("parent").orderBy("child"))
    reason = (F.when(F.col("_again") | F.col("_known").isNotNull(), "node exists").when(F.col("_met").isNull(), "no node")
              .when(F.col("_met") + F.col("_place") > DEGREE, "chamber degree"))
    return held.withColumn("_place", place).select("child", "parent", reason.alias("reason")).where("reason IS NOT NULL")


def attach(links: DataFrame, new: DataFrame) -> DataFrame:
    """Links with all new ones that ``refused`` allows; a child given twice hangs on its least parent."""
    links, new = table(links, "links"), table(new, "new")
    bad = refused(links, new).select("child", "parent")
    return links.unionByName(new.join(bad, ["child", "parent"], "left_anti").dropDuplicates(["child", "parent"]), allowMissingColumns=True)


def drop(links: DataFrame, leaves: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """Links without the leaves (child) and without what served only them; junctions met by two links are joined again.

    A leaf that other links hang on isn't dropped. The result is that of dropping leaf after leaf, in any order. ``roots``: ids of junctions that
    stay whatever meets in them.
    """
    held = links = table(links.withColumn("junction", F.coalesce("junction", F.lit(False))), "links")
    gone = leaves.select("child").distinct().join(links.select(F.col("parent").alias("child")), "child", "left_anti").withColumn("_gone", F.lit(True))
    ends = held.join(gone, "child", "left").where("_gone IS NULL AND NOT junction").select(F.col("child").alias("id"), F.lit(1).alias("one"))
    served = graph.gathered(links, ends, "one").select(F.col("link").alias("child"))
    return joined(held.join(served, "child", "left_semi"), roots)


def joined(links: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """Links with every way through junctions met by two links made one link, named by its lowest child."""
    stops = links.where("NOT junction").select(F.col("child").alias("id"))
    stops = stops if roots is None else stops.unionByName(roots.select("id"))
    at = graph.ranked_chains(links, stops)
    pieces = links.join(at, "child").select("chain", F.struct(-F.col("steps"), "child", "parent", "length_mm", "line", "passages", "reserved_mm", "junction").alias("p"))
    ways = pieces.groupBy("chain").agg(F.array_sort(F.collect_list("p")).alias("p"))
    first, last = F.element_at("p", 1), F.element_at("p", -1)
    sums = F.aggregate("p", F.array(F.lit(0).cast("bigint")), lambda s, p: F.concat(s, F.array(F.element_at(s, -1) + p["length_mm"])))
    line = G.dedupe(F.flatten(F.transform("p", lambda p: p["line"])), 1e-9)
    ways = ways.withColumn("_from", sums)
    passages = F.flatten(F.transform(F.sequence(F.lit(1), F.size("p")), lambda k: F.transform(F.element_at(F.col("p"), k)["passages"], lambda q: q.withField("lo_mm", q["lo_mm"] + F.element_at(F.col("_from"), k)).withField("hi_mm", q["hi_mm"] + F.element_at(F.col("_from"), k)))))
    one = F.size("p") == 1
    return ways.select(first["child"].alias("child"), last["parent"].alias("parent"), F.element_at("_from", -1).alias("length_mm"), F.when(one, first["line"]).otherwise(line).alias("line"),
                       F.when(one, first["passages"]).otherwise(passages).alias("passages"), first["reserved_mm"].alias("reserved_mm"), first["junction"].alias("junction"))


def without_crossed(edges: DataFrame, blocked: DataFrame) -> DataFrame:
    """Edges (u, v) of a graph less those that are blocked, in either direction; the rest of the graph is as it was."""
    ends = [F.least("u", "v").alias("_a"), F.greatest("u", "v").alias("_b")]
    return edges.select("*", *ends).join(blocked.select(*ends).distinct(), ["_a", "_b"], "left_anti").select(*edges.columns)


def link_points(links: DataFrame, step_mm: int, end_mm: int, margin_mm: int) -> DataFrame:
    """child, at_mm, x, y of the places where a link may be cut: its inner vertices, and each step that isn't within three tenths of a step of one of them.

    Places lie above the reserved part, at least ``end_mm`` from both ends, and further than the margin from special passages. A link of n steps gives n places.
    """
    lo, hi = F.greatest("reserved_mm", F.lit(end_mm).cast("bigint")), F.col("length_mm") - end_mm
    held = links.where(hi > lo).select("child", "line", "passages", "length_mm", lo.alias("_lo"), hi.alias("_hi"), G.measured(F.col("line")).alias("_parts"))
    inner = F.transform(F.slice("_parts", 1, F.greatest(F.size("_parts") - 1, F.lit(0))), lambda e: F.floor(e["s1"] * 1000 + 0.5).cast("bigint"))
    held = held.withColumn("_own", F.filter(inner, lambda m: (m >= F.col("_lo")) & (m <= F.col("_hi"))))
    first = F.ceil(F.col("_lo") / step_mm).cast("bigint") * step_mm
    grid = F.when(first <= F.col("_hi"), F.sequence(first, F.col("_hi"), F.lit(step_mm).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))
    held = held.withColumn("_grid", F.filter(grid, lambda m: ~F.exists("_own", lambda q: F.abs(q - m) * 10 < 3 * step_mm)))
    each = held.select("child", "line", "passages", F.explode(F.array_distinct(F.concat("_own", "_grid"))).alias("at_mm"))
    free = each.where(~F.exists("passages", lambda p: (F.col("at_mm") > p["lo_mm"] - margin_mm) & (F.col("at_mm") < p["hi_mm"] + margin_mm)))
    return free.withColumn("_p", G.point_at(F.col("line"), F.col("at_mm") / 1000)).select("child", "at_mm", "_p.x", "_p.y")


def free_nodes(links: DataFrame) -> DataFrame:
    """id, x, y of the junctions of a forest that have a slot free; a junction lies where its link begins."""
    hung = links.groupBy(F.col("parent").alias("child")).agg(F.count(F.lit(1)).alias("_n"))
    nodes = links.where("junction").join(hung, "child", "left").where(F.coalesce("_n", F.lit(0)) + 1 < DEGREE)
    return nodes.withColumn("_p", F.element_at("line", 1)).select(F.col("child").alias("id"), "_p.x", "_p.y")


def targets(tie_ins: DataFrame, links: DataFrame, points: DataFrame) -> DataFrame:
    """kind, id, at_mm, x, y of all that the next consumer may be hung on: tie-ins (id, x, y) as they are, free junctions, and the ``points`` of links.

    ``points``: of ``link_points``, less those in zones. Of targets within one millimetre cell the first kind stays, then the least link and place.
    """
    none = F.lit(None).cast("bigint")
    rows = (tie_ins.select(F.lit(0).alias("_k"), F.lit("tie_in").alias("kind"), "id", none.alias("at_mm"), "x", "y")
            .unionByName(free_nodes(links).select(F.lit(1).alias("_k"), F.lit("node").alias("kind"), "id", none.alias("at_mm"), "x", "y"))
            .unionByName(points.select(F.lit(2).alias("_k"), F.lit("link").alias("kind"), F.col("child").alias("id"), "at_mm", "x", "y")))
    cell = [F.floor(F.col(c) * 1000 + 0.5).cast("bigint") for c in ("x", "y")]
    place = Window.partitionBy(*cell).orderBy("_k", "id", "at_mm")
    # Tie-ins are never folded: two of them at one place stay two.
    return rows.withColumn("_n", F.row_number().over(place)).where("_k = 0 OR _n = 1").select("kind", "id", "at_mm", "x", "y")
