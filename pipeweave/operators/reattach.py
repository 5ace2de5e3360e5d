"""Tentative attachment: what the network would cost with a leaf hung elsewhere, for all candidates at once.

Hanging a leaf of flow q elsewhere takes q off the links of its old way to the
root and puts it on those of the new one; links on both keep their flow. So a
candidate is one row with two walkers that climb from the old and the new
parent, the deeper one first, until they meet or both are at roots. A round is a
sort-merge join with the links; no way is ever held as rows, no forest is in one place.

Diameters follow the flow; the limit of the length of one diameter is a matter of ``hydraulics``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import engineering as E
from ..plans import rules
from . import graph
from .edits import DEGREE
from .shared import table

#: A score counts as lower if it is so by more than this.
EPSILON = 1e-9


def link_price(flow_dt: Column, length_mm: Column) -> Column:
    """Whole rubles of a link of the least diameter that carries its flow; 0 without flow, null beyond every diameter."""
    cost_m = F.lit(None).cast("bigint")
    for _, cap, _, price, *_ in reversed(rules.DU_ROWS):
        cost_m = F.when(flow_dt <= cap, price).otherwise(cost_m)
    return F.when(flow_dt <= 0, F.lit(0).cast("bigint")).otherwise(E.piece_cost(length_mm, cost_m, F.lit(1.0), F.lit(1.0)))


def carried(links: DataFrame) -> DataFrame:
    """links (net, child, parent, flow_dt of the consumer at the child or 0, length_mm) with ``carried``, the flow of the whole link, and ``depth``, its steps to the root."""
    links = table(links, "links")
    flow = graph.gathered(links, links.select(F.col("child").alias("id"), "flow_dt"), "flow_dt").select(F.col("link").alias("child"), F.col("total").alias("carried"))
    roots = links.select(F.col("parent").alias("id")).distinct().join(links.select(F.col("child").alias("id")).hint("merge"), "id", "left_anti")
    depth = graph.depths(links, roots).withColumnRenamed("id", "child")
    return table(links.join(flow.hint("merge"), "child").join(depth.hint("merge"), "child"), "carried")


def score(links: DataFrame) -> DataFrame:
    """net, cost, length_mm, score of whole networks, every link priced anew; null where a flow is beyond every diameter."""
    flow = graph.gathered(links, links.select(F.col("child").alias("id"), "flow_dt"), "flow_dt").select(F.col("link").alias("child"), F.col("total").alias("_flow"))
    price = link_price(F.col("_flow"), F.col("length_mm"))
    sums = links.join(flow.hint("merge"), "child").groupBy("net").agg(F.when(F.count_if(price.isNull()) == 0, F.sum(price)).alias("cost"), F.sum("length_mm").alias("length_mm"))
    return sums.withColumn("score", E.score(F.col("cost"), F.col("length_mm") / 1000))


def tentative(links: DataFrame, candidates: DataFrame) -> DataFrame:
    """net, child, parent, length_mm, delta_cost, delta_mm, delta_score of hanging each leaf on another parent; delta_cost is null if some flow would be beyond every diameter.

    links: as ``carried`` makes them; candidates: child, parent, length_mm (of the new link). Left out are candidates whose child isn't a leaf or has no flow,
    whose parent is the one it has, isn't in the same net, or has no slot free.
    """
    inner = links.select(F.col("parent").alias("child")).distinct()
    leaves = links.join(inner.hint("merge"), "child", "left_anti").where("flow_dt > 0").select("net", "child", F.col("parent").alias("old"), F.col("flow_dt").alias("q"), F.col("length_mm").alias("old_mm"))
    # Slots by node: links that hang on it, and its own.
    own = links.select("net", F.col("child").alias("parent"), F.lit(1).alias("n"), F.col("depth"))
    hung = links.select("net", "parent", F.lit(1).alias("n"), (F.col("depth") - 1).alias("depth"))
    nodes = own.unionByName(hung).groupBy("net", "parent").agg(F.sum("n").alias("_met"), F.max("depth").alias("_db")).where(F.col("_met") < DEGREE)
    start = candidates.select("child", "parent", "length_mm").distinct().join(leaves.hint("merge"), "child").where("parent <> old AND parent <> child").join(nodes.hint("merge"), ["net", "parent"])
    olds = hung.groupBy("net", F.col("parent").alias("old")).agg(F.max("depth").alias("_da"))
    own_price = link_price(F.col("q"), F.col("length_mm")) - link_price(F.col("q"), F.col("old_mm"))
    at = start.join(olds.hint("merge"), ["net", "old"]).select("net", "child", "parent", "length_mm", "q", (F.col("length_mm") - F.col("old_mm")).alias("delta_mm"), F.col("old").alias("a"), F.col("_da").alias("da"), F.col("parent").alias("b"), F.col("_db").alias("db"), own_price.alias("delta_cost"))
    at = table(at, "walkers")
    up = links.select(F.col("child").alias("_c"), F.col("parent").alias("_p"), F.col("carried").alias("_flow"), F.col("length_mm").alias("_mm"))
    done = []
    arrived = (F.col("a") == F.col("b")) | (F.col("da") <= 0) & (F.col("db") <= 0)
    while True:
        done.append(at.where(arrived))
        going = at.where(~arrived)
        if going.isEmpty():
            break
        ua, ub = (up.select(*(F.col(c).alias(c + side) for c in up.columns)) for side in ("a", "b"))
        # Depths tell who climbs; two at one depth that haven't met both do.
        climb_a, climb_b = F.col("da") >= F.col("db"), F.col("db") >= F.col("da")
        moved = going.join(ua.hint("merge"), (F.col("a") == F.col("_ca")) & climb_a, "left").join(ub.hint("merge"), (F.col("b") == F.col("_cb")) & climb_b, "left")
        less = link_price(F.col("_flowa") - F.col("q"), F.col("_mma")) - link_price(F.col("_flowa"), F.col("_mma"))
        more = link_price(F.col("_flowb") + F.col("q"), F.col("_mmb")) - link_price(F.col("_flowb"), F.col("_mmb"))
        zero = F.lit(0).cast("bigint")
        at = table(moved.select("net", "child", "parent", "length_mm", "q", "delta_mm", F.coalesce("_pa", "a").alias("a"), (F.col("da") - climb_a.cast("int")).alias("da"), F.coalesce("_pb", "b").alias("b"), (F.col("db") - climb_b.cast("int")).alias("db"),
                                (F.col("delta_cost") + F.when(F.col("_ca").isNull(), zero).otherwise(less) + F.when(F.col("_cb").isNull(), zero).otherwise(more)).alias("delta_cost")), "walkers")
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.select("net", "child", "parent", "length_mm", "delta_cost", "delta_mm").withColumn("delta_score", E.score(F.col("delta_cost"), F.col("delta_mm") / 1000))


def improved(links: DataFrame, candidates: DataFrame, rounds: int) -> tuple[DataFrame, DataFrame]:
    """The links after at most ``rounds`` moves in each net, and the moves (round, and the columns of ``tentative``).

    Each round weighs all candidates against the network as it is and makes the one of each net that lowers its score most (ties: least
    child, then parent); it ends when no net has one. So the score of no net ever rises.
    """
    links = links.select("net", "child", "parent", "flow_dt", "length_mm")
    moves = None
    for k in range(1, rounds + 1):
        weighed = tentative(carried(links), candidates).where(F.col("delta_score") < -EPSILON)
        best = Window.partitionBy("net").orderBy("delta_score", "child", "parent", "length_mm")
        chosen = table(weighed.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n").withColumn("round", F.lit(k)), "moves")
        moves = chosen if moves is None else moves.unionByName(chosen)
        if chosen.isEmpty():
            break
        new = chosen.select("child", F.col("parent").alias("_p"), F.col("length_mm").alias("_mm"))
        links = table(links.join(new.hint("merge"), "child", "left").select("net", "child", F.coalesce("_p", "parent").alias("parent"), "flow_dt", F.coalesce("_mm", "length_mm").alias("length_mm")), "links")
    return links, moves
