"""Visibility graph, shortest paths and greedy forest building.

The search depends on the order of its steps, so it is a kernel: one scene and
strategy is one group, and scenes and strategies run side by side.
"""

from __future__ import annotations

from heapq import heappop, heappush

from pyspark.sql import DataFrame

from ..plans import rules
from .hydraulics import solve

VERTEX_PENALTY = 0.3
#: What a target that is no root costs besides.
JUNCTION_PENALTY = 20.0
#: Pairs of segments and boxes tested by one call.
AT_ONCE = 200_000
SCHEMA = "scene bigint, strategy string, child bigint, parent bigint, length_mm bigint, flow_dt bigint, du int, cost bigint, vertices int, connected boolean"


def blocked(ax, ay, bx, by, boxes):
    """Whether segments (arrays) pass through the inside of any box: Liang-Barsky, all at once."""
    import numpy as np

    ax, ay, bx, by = (np.asarray(v, dtype=float)[:, None] for v in (ax, ay, bx, by))
    if not len(boxes):
        return np.zeros(len(ax), dtype=bool)
    dx, dy = bx - ax, by - ay
    lo, hi = np.zeros((len(ax), len(boxes))), np.ones((len(ax), len(boxes)))
    out = np.zeros_like(lo, dtype=bool)
    with np.errstate(divide="ignore", invalid="ignore"):
        for d, low, high in ((dx, boxes[:, 0] - ax, boxes[:, 2] - ax), (dy, boxes[:, 1] - ay, boxes[:, 3] - ay)):
            flat = np.broadcast_to(d == 0, lo.shape)
            out |= flat & ((low >= 0) | (high <= 0))
            lo = np.where(flat, lo, np.maximum(lo, np.minimum(low / d, high / d)))
            hi = np.where(flat, hi, np.minimum(hi, np.maximum(low / d, high / d)))
    return (~out & (lo < hi - 1e-12)).any(axis=1)


class Graph:
    """Vertices and the edges between those that see each other."""

    def __init__(self, boxes, points):
        import numpy as np

        self.boxes = np.asarray(boxes, dtype=float).reshape(-1, 4)
        corners = [(x, y) for x0, y0, x1, y1 in self.boxes for x, y in ((x0, y0), (x0, y1), (x1, y0), (x1, y1)) if not self.inside(x, y)]
        self.at = np.array([*points, *corners], dtype=float).reshape(-1, 2)
        self.edges: dict[int, list] = {}

    def inside(self, x: float, y: float) -> bool:
        b = self.boxes
        return bool(((b[:, 0] < x) & (x < b[:, 2]) & (b[:, 1] < y) & (y < b[:, 3])).any())

    def seen(self, v: int) -> list:
        """(vertex, length) of all that v sees; found once, for as many vertices together as stay within ``AT_ONCE``."""
        import numpy as np

        if v not in self.edges:
            n = len(self.at)
            block = max(1, AT_ONCE // (n * max(1, len(self.boxes))))
            some = np.arange(v // block * block, min(n, v // block * block + block))
            a, b = np.repeat(self.at[some], n, axis=0), np.tile(self.at, (len(some), 1))
            free = ~blocked(a[:, 0], a[:, 1], b[:, 0], b[:, 1], self.boxes).reshape(len(some), n)
            d = np.hypot(b[:, 0] - a[:, 0], b[:, 1] - a[:, 1]).reshape(len(some), n)
            free[np.arange(len(some)), some] = False
            for i, u in enumerate(some.tolist()):
                to = np.flatnonzero(free[i])
                self.edges[u] = list(zip(to.tolist(), d[i][to].tolist(), strict=True))
        return self.edges[v]


def shortest(graph: Graph, source: int, targets: set, passable, extra=None) -> dict:
    """target -> (cost, length, path). Terminals end a path: only ``passable`` vertices are passed through.

    With ``extra``, what a target costs besides, the search ends where no target still to come can be the cheapest.
    """
    best, queue, found = {source: 0.0}, [(0.0, source, 0.0, (source,))], {}
    least = float("inf")
    while queue and len(found) < len(targets):
        cost, v, length, path = heappop(queue)
        if cost > least:
            break
        if cost > best.get(v, float("inf")):
            continue
        if v in targets and v not in found:
            found[v] = (cost, length, path)
            if extra is not None:
                least = min(least, cost + extra(v))
        if v != source and not passable(v):
            continue
        for w, d in graph.seen(v):
            c = cost + d + VERTEX_PENALTY
            # What is neither a target nor passed through leads nowhere.
            if c < best.get(w, float("inf")) and c <= least and (w in targets or passable(w)):
                best[w] = c
                heappush(queue, (c, w, length + d, (*path, w)))
    return found


def order_consumers(order: str, consumers: list, roots: list) -> list:
    near = lambda c: min((((c[1] - r[1]) ** 2 + (c[2] - r[2]) ** 2) ** 0.5 for r in roots), default=float("inf"))
    key = {"NEAREST": near, "FARTHEST": lambda c: -near(c), "LARGEST_FLOW": lambda c: -c[3]}[order]
    return sorted(consumers, key=lambda c: (key(c), c[0]))


def leave(x: float, y: float, boxes: list, strict: int) -> tuple | None:
    """Where a consumer's lines begin and the way there: outside all boxes it is its place, inside one building the nearest free point of the edge.

    The first ``strict`` boxes are left by no line, nor are two buildings at once.
    """
    holding = [i for i, b in enumerate(boxes) if b[0] < x < b[2] and b[1] < y < b[3]]
    if not holding:
        return x, y, 0.0
    if len(holding) > 1 or holding[0] < strict:
        return None
    own = boxes[holding[0]]
    others = [b for i, b in enumerate(boxes) if i != holding[0]]
    graph = Graph(others, [])
    for way, ex, ey in sorted(((x - own[0], own[0], y), (own[2] - x, own[2], y), (y - own[1], x, own[1]), (own[3] - y, x, own[3]))):
        if not graph.inside(ex, ey) and not blocked([x], [y], [ex], [ey], graph.boxes)[0]:
            return ex, ey, way
    return None


def build(consumers: list, roots: list, boxes: list, strategy: tuple, buildings: list = ()) -> tuple[dict, dict, set]:
    """Greedy forest: parent and (length, vertices) by child; consumers left over. Roots: id, x, y, degree, whether their chamber is new."""
    roots = [r if len(r) > 4 else (*r, False) for r in roots]
    _, order, junctions, policy, _ = strategy
    roots = [r for r in roots if policy == "ANY" or (policy == "NEW_ONLY") == r[4]]
    everything = [*boxes, *buildings]
    exits = {c[0]: leave(c[1], c[2], everything, len(boxes)) for c in consumers}
    lost = {c for c, e in exits.items() if e is None}
    consumers = [(c[0], *exits[c[0]][:2], c[3]) for c in consumers if c[0] not in lost]
    points = [(x, y) for _, x, y, *_ in [*consumers, *roots]]
    graph = Graph(everything, points)
    index = {("c", c[0]): i for i, c in enumerate(consumers)} | {("r", r[0]): len(consumers) + i for i, r in enumerate(roots)}
    owner = {i: k for k, i in index.items()}
    slots = {("r", r[0]): rules.MAX_DEGREE - r[3] for r in roots}
    joined: set = set()
    parent, route = {}, {}
    for c in order_consumers(order, consumers, roots):
        targets = {index[k] for k, free in slots.items() if free > 0} | ({index[k] for k in joined if slots.get(k, 1) > 0} if junctions else set())
        extra = lambda v: 0 if owner[v][0] == "r" else JUNCTION_PENALTY
        found = shortest(graph, index["c", c[0]], targets, lambda v: v not in owner, extra)
        if not found:
            lost.add(c[0])
            continue
        target = min(found, key=lambda v: (found[v][0] + extra(v), v))
        k = owner[target]
        parent[c[0]] = -1 - k[1] if k[0] == "r" else k[1]
        way = exits[c[0]][2]
        route[c[0]] = (found[target][1] + way, len(found[target][2]) + (way > 0))
        slots[k] = slots.get(k, rules.MAX_DEGREE - 1) - 1
        joined.add(("c", c[0]))
    return parent, route, lost


def plan_scenes(features: DataFrame, strategies: list[tuple] | None = None) -> DataFrame:
    """features: scene, kind (consumer, root: existing chamber, tie_in: new chamber on a line, box, building), id, x, y, x1, y1, flow_dt, degree. Links of every strategy."""
    from pyspark.sql import functions as F

    chosen = strategies or rules.STRATEGY_ROWS
    price = {row[0]: row[3] for row in rules.DU_ROWS}

    def planned(scene: int, name: str, group: list) -> list[tuple]:
        strategy = next(s for s in chosen if s[0] == name)
        pick = lambda k: [f for f in group if f["kind"] == k]
        consumers = [(f["id"], f["x"], f["y"], f["flow_dt"]) for f in pick("consumer")]
        roots = [(f["id"], f["x"], f["y"], f["degree"], kind == "tie_in") for kind in ("root", "tie_in") for f in pick(kind)]
        boxes, buildings = ([(f["x"], f["y"], f["x1"], f["y1"]) for f in pick(kind)] for kind in ("box", "building"))
        parent, route, lost = build(consumers, roots, boxes, strategy, buildings)
        length = {c: int(v[0] * 1000 + 0.5) for c, v in route.items()}
        own = {c[0]: c[3] for c in consumers if c[0] in parent}
        flow, du, _ = solve(parent, own, length)
        rows = [(scene, name, c, parent[c], length[c], flow[c], du.get(c), int(length[c] / 1000 * price[du[c]] + 0.5) if c in du else None, route[c][1], True) for c in sorted(parent)]
        return rows + [(scene, name, c, None, None, next(x[3] for x in consumers if x[0] == c), None, None, None, False) for c in sorted(lost)]

    def kernel(batches):
        import pyarrow as pa

        kinds = [pa.int64(), pa.string(), *(pa.int64(),) * 4, pa.int32(), pa.int64(), pa.int32(), pa.bool_()]
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for b in batches:
            rows = [r for scene, group, name in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True) for r in planned(scene, name, group)]
            cols = list(zip(*rows, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    feature = F.struct("kind", "id", "x", "y", "x1", "y1", F.col("flow_dt").cast("bigint").alias("flow_dt"), "degree")
    each = features.groupBy(F.col("scene").cast("bigint").alias("scene")).agg(F.array_sort(F.collect_list(feature)).alias("group"))
    # Strategies of one scene may go to different tasks.
    every = each.withColumn("strategy", F.explode(F.array(*(F.lit(s[0]) for s in chosen)))).repartition("scene", "strategy")
    return every.mapInArrow(kernel, SCHEMA)


def ranked_variants(links: DataFrame) -> DataFrame:
    """scene, strategy, cost, length_mm, score, rank: equal designs of a scene count once; at most three stay."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from ..functions import engineering as E

    penalty = F.coalesce(F.sum(F.when(~F.col("connected"), E.penalty(F.col("flow_dt")))), F.lit(0))
    signature = F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "child", "parent", F.expr("length_mm div 5000")))), "|"), 256)
    each = links.groupBy("scene", "strategy").agg((F.coalesce(F.sum("cost"), F.lit(0)) + penalty).alias("cost"), F.coalesce(F.sum("length_mm"), F.lit(0)).alias("length_mm"), signature.alias("signature"))
    each = each.withColumn("score", E.score(F.col("cost"), F.col("length_mm") / 1000))
    once = each.withColumn("_n", F.row_number().over(Window.partitionBy("scene", "signature").orderBy("score", "strategy"))).where("_n = 1").drop("_n", "signature")
    return once.withColumn("rank", F.row_number().over(Window.partitionBy("scene").orderBy("score", "strategy"))).where(F.col("rank") <= rules.MAX_VARIANTS)
