"""Trees and components by repeated joins; every round is written, so lineage stays short.

A tree is links (child, parent): a child has one link, towards its root. The
number of rounds is the depth of the tree (or its logarithm for components).
Joins are sort-merge joins: a side that was broadcast would pass through the
driver, in every round anew, and compressed files are judged too small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import table

#: Steps after which a way is looked at for a cycle.
CHECKED = 64


def closure(links: DataFrame) -> DataFrame:
    """node, link, step: every link on the way from each node to its root (link: by its child).

    Its rows are nodes x depth, so it serves only where the ways themselves are
    asked for; see ``gathered``. A way of more than ``CHECKED`` steps is looked at for a cycle, which is refused.
    """
    # Written once: a round must not make the links anew.
    links = table(links.select("child", "parent"), "links")
    up = links.select(F.col("child").alias("_c"), F.col("parent").alias("_p"))
    front = table(up.select(F.col("_c").alias("node"), F.col("_c").alias("link"), F.col("_p").alias("top"), F.lit(0).alias("step")), "front")
    parts = [front]
    while not front.isEmpty():
        if len(parts) == CHECKED:
            refuse_cycles(links)
        front = table(front.join(up.hint("merge"), front["top"] == up["_c"]).select("node", F.col("_c").alias("link"), F.col("_p").alias("top"), (F.col("step") + 1).alias("step")), "front")
        parts.append(front)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("node", "link", "step")


def refuse_cycles(links: DataFrame) -> None:
    """Raise if some way never ends: pointers that double each round and are still on a way after as many steps as there are links."""
    at = table(links.select("child", F.col("parent").alias("top")), "tops")
    n, steps = at.count(), 1
    while steps <= n:
        far = at.select(F.col("child").alias("top"), F.col("top").alias("far"))
        at = table(at.join(far.hint("merge"), "top").select("child", F.col("far").alias("top")), "tops")
        if at.isEmpty():
            return
        steps *= 2
    raise ValueError(f"links form a cycle, for one above {at.first()['child']}")


def gathered(links: DataFrame, nodes: DataFrame, value: str) -> DataFrame:
    """link, total, n, most: sum, number and maximum over all nodes whose way to the root passes the link (nodes: id, value).

    Pointers double each round: what a link has gathered over fewer than 2^k
    steps goes to the link 2^k steps nearer the root, so there are as many
    rounds as the logarithm of the depth, each of one row for a link.
    """
    held = nodes.select(F.col("id").alias("child"), F.col(value).alias("_v"))
    at = links.select("child", F.col("parent").alias("top")).join(held.hint("merge"), "child", "left").select("child", "top", F.coalesce("_v", F.lit(0)).alias("total"), F.col("_v").isNotNull().cast("bigint").alias("n"), F.col("_v").alias("most"))
    at = table(at, "gathered")
    rows, steps = at.count(), 1
    while True:
        sent = at.groupBy(F.col("top").alias("child")).agg(F.sum("total").alias("_t"), F.sum("n").alias("_n"), F.max("most").alias("_m"))
        far = at.select(F.col("child").alias("top"), F.col("top").alias("far"))
        after = (at.join(sent.hint("merge"), "child", "left").join(far.hint("merge"), "top", "left")
                 .select("child", F.col("far").alias("top"), (F.col("total") + F.coalesce("_t", F.lit(0))).alias("total"), (F.col("n") + F.coalesce("_n", F.lit(0))).alias("n"), F.greatest("most", "_m").alias("most")))
        at = table(after, "gathered")
        steps *= 2
        if at.where("top IS NOT NULL").isEmpty():
            return at.where("n > 0").select(F.col("child").alias("link"), "total", "n", "most")
        if steps > 2 * rows:
            raise ValueError("links form a cycle")


def depths(links: DataFrame, roots: DataFrame) -> DataFrame:
    """id, depth: breadth first from the roots."""
    links = table(links.select("child", "parent"), "links")
    down = links.select(F.col("child").alias("_c"), F.col("parent").alias("_p"))
    front = table(roots.select("id", F.lit(0).alias("depth")), "level")
    parts = [front]
    while not front.isEmpty():
        if len(parts) == CHECKED:
            refuse_cycles(links)
        front = table(front.join(down.hint("merge"), front["id"] == down["_p"]).select(F.col("_c").alias("id"), (F.col("depth") + 1).alias("depth")), "level")
        parts.append(front)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def components(links: DataFrame) -> DataFrame:
    """id, component: smallest node reachable, by hooking every node to its least neighbour and shortening."""
    both = links.select(F.col("child").alias("u"), F.col("parent").alias("v"))
    both = table(both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "both")
    label = table(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("label")).withColumnRenamed("u", "id"), "label")
    while True:
        near = both.join(label.withColumnRenamed("id", "v").withColumnRenamed("label", "other").hint("merge"), "v").groupBy(F.col("u").alias("id")).agg(F.min("other").alias("other"))
        hooked = label.join(near.hint("merge"), "id").select("id", F.least("label", "other").alias("label"), F.col("label").alias("old"))
        jump = hooked.select(F.col("id").alias("label"), F.col("label").alias("far"))
        after = table(hooked.join(jump.hint("merge"), "label", "left").select("id", F.least("label", "far").alias("label"), "old"), "label")
        done = after.where("label <> old").isEmpty()
        label = after.select("id", "label")
        if done:
            return label.select("id", F.col("label").alias("component"))


def runs(paths: DataFrame, links: DataFrame) -> DataFrame:
    """node, link, step, run_mm: length of the run of one diameter up to here, from the leaf to the root."""
    walk = paths.join(links.select(F.col("child").alias("link"), "du", "length_mm").hint("merge"), "link")
    w = Window.partitionBy("node").orderBy("step")
    walk = walk.withColumn("_new", F.coalesce((F.lag("du").over(w) != F.col("du")).cast("int"), F.lit(1))).withColumn("_run", F.sum("_new").over(w))
    return walk.withColumn("run_mm", F.sum("length_mm").over(Window.partitionBy("node", "_run").orderBy("step"))).drop("_new", "_run")


def monotone(links: DataFrame) -> DataFrame:
    """link, du: a link is at least as wide as every link that flows into it."""
    return gathered(links, links.select(F.col("child").alias("id"), "du"), "du").select("link", F.col("most").alias("du"))


def chains(links: DataFrame, breaks: DataFrame) -> DataFrame:
    """child, chain: links joined through nodes of degree two, named by the link nearest the root.

    ``breaks``: ids of nodes that end a chain whatever their degree. A link
    continues into its parent link if the node between is met by these two only.
    """
    return ranked_chains(links, breaks).select("child", "chain")


def ranked_chains(links: DataFrame, breaks: DataFrame) -> DataFrame:
    """child, chain, steps: ``chains`` and the links between each link and the one that names its chain; pointers double each round."""
    met = links.groupBy("parent").agg(F.count(F.lit(1)).alias("n"))
    through = met.where("n = 1").join(breaks.select(F.col("id").alias("parent")).hint("merge"), "parent", "left_anti")
    # The parent link is the one whose child is this node.
    top = links.join(through.hint("merge"), "parent", "left_semi").join(links.select(F.col("child").alias("parent")).hint("merge"), "parent", "left_semi").select("child", F.col("parent").alias("up"))
    at = table(links.select("child").join(top.hint("merge"), "child", "left").select("child", F.coalesce("up", "child").alias("chain"), F.col("up").isNotNull().cast("bigint").alias("steps")), "chains")
    while True:
        far = at.select(F.col("child").alias("chain"), F.col("chain").alias("far"), F.col("steps").alias("_more"))
        after = table(at.join(far.hint("merge"), "chain").select("child", F.col("far").alias("chain"), (F.col("steps") + F.col("_more")).alias("steps"), (F.col("far") != F.col("chain")).alias("moved")), "chains")
        done = after.where("moved").isEmpty()
        at = after.drop("moved")
        if done:
            return at
