"""Known answers of formulas, hydraulics and profiles."""

import random

import pytest
from pyspark.sql import functions as F

from pipeweave.functions import engineering as E
from pipeweave.functions import geometry as G
from pipeweave.operators import depth, graph, hydraulics, lookups, ranking, routing
from pipeweave.plans import rules


@pytest.mark.parametrize(("lon", "lat", "x", "y"), [(37.6, 55.75, 412125.4591875144, 6179143.32361831), (37.6262685, 55.690915329577294, 413643.866390186, 6172535.3570095375), (39.0, 56.0, 500000.0, 6206079.587252156)])
def test_projection(spark, lon, lat, x, y):
    p = G.to_metric(F.lit(lon), F.lit(lat))
    r = spark.range(1).select(p.alias("p")).select("p", G.to_wgs84(F.col("p.x"), F.col("p.y")).alias("w")).first()
    assert abs(r.p.x - x) < 2e-3 and abs(r.p.y - y) < 2e-3
    assert abs(r.w.lon - lon) < 1e-8 and abs(r.w.lat - lat) < 1e-8


def test_formulas(spark):
    r = spark.range(1).select(E.score(F.lit(13_974_800), F.lit(100)).alias("s"), E.penalty(F.lit(249)).alias("p"), E.chamber_cost(F.lit(400)).alias("c"), E.half_up(F.lit(-2.5)).alias("h"),
                              lookups.du_by_flow(F.lit(436)).alias("d"), lookups.du_by_flow(F.lit(300_000)).alias("none"), lookups.nearest_du(F.lit(450)).alias("n")).first()
    assert round(r.s, 4) == 0.6913
    assert (r.p, r.c, r.h, r.d, r.none, r.n) == (112_450_000, 5_000_000, -2, 150, None, 400)


def test_exact_rounding(spark):
    r = spark.range(1).select(E.round_exact(F.lit(1.0005), 3).alias("a"), E.round_exact(F.lit(2.675), 2).alias("b"), E.round_exact(F.lit(2.5), 0).alias("c")).first()
    assert (r.a, r.b, r.c) == (1.0, 2.67, 3.0)


def solve(links, own):
    return hydraulics.solve({c: p for c, p, _ in links}, own, {c: n for c, _, n in links})


def test_hydraulics():
    assert solve([(1, 0, 100_000)], {1: 40})[1] == {1: 65}
    assert solve([(1, 0, 400_000)], {1: 40})[1] == {1: 100}
    # A diameter raised by length at the leaf widens the trunk.
    flow, du, ok = solve([(2, 1, 400_000), (1, 0, 10_000), (3, 1, 10_000)], {2: 40, 3: 30})
    assert ok and flow[1] == 70 and du[1] >= du[2] == 100
    assert solve([(1, 0, 12_000_000)], {1: 40})[2] is False


def by_links(links, own):
    """The rule link by link: raise what it says until nothing is said."""
    table = rules.DU_ROWS
    parent, length = {c: p for c, p, _ in links}, {c: n for c, _, n in links}
    below = {c: [d for d in parent if parent[d] == c] for c in parent}

    def way(c):
        return [c, *(way(parent[c]) if parent[c] in parent else [])]

    flow = {c: sum(q for leaf, q in own.items() if c in way(leaf)) for c in parent}
    level = {c: next(i for i, row in enumerate(table) if flow[c] <= row[1]) for c in parent}

    def part(c):
        found, todo = set(), [c]
        while todo:
            x = todo.pop()
            if x in found:
                continue
            found.add(x)
            if len(below[x]) == 1 and flow[below[x][0]] == flow[x]:
                todo.append(below[x][0])
            if parent[x] in parent and len(below[parent[x]]) == 1 and flow[parent[x]] == flow[x]:
                todo.append(parent[x])
        return found

    def lift(c, to):
        for x in part(c):
            level[x] = max(level[x], to)

    while True:
        before = dict(level)
        for c in sorted(parent, key=lambda c: -len(way(c))):
            lift(c, max([level[c], *(level[d] for d in below[c])]))
        for leaf in sorted(own):
            run, last = 0, None
            for c in way(leaf):
                run, last = (run if level[c] == last else 0) + length[c], level[c]
                if run > table[last][2] * 1000:
                    if last + 1 == len(table):
                        return None
                    lift(c, last + 1)
                    break
        if level == before:
            return {c: table[i][0] for c, i in level.items()}


def test_hydraulics_of_random_forests_by_links():
    r = random.Random(9)
    outcomes = set()
    for _ in range(300):
        n = r.randrange(1, 14)
        links = [(c, r.choice([r.randrange(0, c), c - 1]), r.randrange(1, 400) * 1000) for c in range(1, n + 1)]
        own = {c: r.randrange(1, 300) for c in range(1, n + 1) if r.random() < 0.5 or c not in {p for _, p, _ in links}}
        flow, du, ok = solve(links, own)
        want = by_links(links, own)
        assert ok == (want is not None) and (not ok or du == want)
        outcomes.add((ok, len(set(du.values()))))
    assert len(outcomes) > 3


def test_gathered_over_all_below_and_cycles(spark):
    r = random.Random(4)
    up = {c: r.randrange(max(0, c - 3), c) for c in range(1, 60)}
    links = spark.createDataFrame(list(up.items()), "child bigint, parent bigint")
    nodes = spark.createDataFrame([(c, c * c) for c in up if c % 3], "id bigint, v bigint")
    got = {x.link: (x.total, x.n, x.most) for x in graph.gathered(links, nodes, "v").collect()}
    below = {}
    for c in up:
        if c % 3:
            at = c
            while at in up:
                below.setdefault(at, []).append(c * c)
                at = up[at]
    assert got == {k: (sum(v), len(v), max(v)) for k, v in below.items()}
    ring = links.unionByName(spark.createDataFrame([(100, 101), (101, 102), (102, 100)], "child bigint, parent bigint"))
    with pytest.raises(ValueError, match="cycle"):
        graph.gathered(ring, nodes, "v")
    with pytest.raises(ValueError, match="cycle"):
        graph.refuse_cycles(ring)
    graph.refuse_cycles(links)


def test_depth_over_gas():
    assert depth.options("GAP", 0.14, 2.8, 0.4, 0.2, None) == [(0.7, pytest.approx(2.46)), (pytest.approx(3.4), 100.0)]
    points, cost = depth.optimise(100.0, [{"lo": 48.0, "hi": 52.0, "options": depth.options("GAP", 0.16, 2.8, 0.4, 0.2, None)}], 83530)
    assert min(h for _, h in points) == pytest.approx(2.44) and cost == pytest.approx(0)
    assert points[0] == (0.0, 3.0) and points[-1] == (100.0, 3.0)
    for (a, h), (b, g) in zip(points, points[1:]):
        assert abs(g - h) <= 0.1 * (b - a) + 1e-9


def test_depth_without_room():
    below = [{"lo": 1.0, "hi": 99.0, "options": [(5.0, 100.0)]}]
    assert depth.optimise(100.0, below, 1.0) is None
    assert depth.optimise(10.0, [], 1.0) == ([(0.0, 3.0), (10.0, 3.0)], 0.0)


def test_routing_goes_round_a_box():
    g = routing.Graph([(4, -5, 6, 5)], [(0.0, 0.0), (10.0, 0.0)])
    cost, length, path = routing.shortest(g, 0, {1}, lambda v: v > 1)[1]
    assert length == pytest.approx(2 * (16 + 25) ** 0.5 + 2) and len(path) == 4


def test_forest_leaves_out_the_walled_in():
    walls = [(-2, -2, -1, 2), (1, -2, 2, 2), (-2, 1, 2, 2), (-2, -2, 2, -1)]
    parent, _, lost = routing.build([(1, 0.0, 0.0, 10), (2, 9.0, 9.0, 10)], [(0, 20.0, 20.0, 2)], walls, ("s", "NEAREST", True, "ANY", True))
    assert lost == {1} and parent == {2: -1}


def test_numbers_are_contiguous(spark):
    df = ranking.numbered(spark.range(1000).withColumn("k", F.expr("(id * 37) % 1000")), [F.asc("k")], "at")
    assert [r["at"] for r in df.orderBy("k").collect()] == list(range(1, 1001))


def test_components_of_rings_and_paths(spark):
    links = spark.createDataFrame([(2, 1), (3, 2), (1, 3), (9, 8), (8, 7), (20, 30)], "child bigint, parent bigint")
    got = {r.id: r.component for r in graph.components(links).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 7, 20: 20, 30: 20}


def test_line_functions(spark):
    line = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((0.0, 0.0), (0.0, 0.0), (5.0, 0.0), (10.0, 0.0), (10.0, 10.0))))
    r = spark.range(1).select(G.clean(line).alias("c"), G.length(G.sub_line(line, F.lit(2.0), F.lit(12.0))).alias("n"), G.point_at(line, F.lit(99.0)).alias("e")).first()
    assert [(p.x, p.y) for p in r.c] == [(0, 0), (10, 0), (10, 10)] and r.n == 10 and (r.e.x, r.e.y) == (10, 10)


def test_a_small_scene_is_seen_at_once(monkeypatch):
    """All vertices of a small scene are tested by one call, and a search ends at the cheapest target."""
    calls = []
    real = routing.blocked
    monkeypatch.setattr(routing, "blocked", lambda *a: calls.append(1) or real(*a))
    consumers = [(i, float(i * 37 % 97), float(i * 61 % 89), i + 1) for i in range(6)]
    boxes = [(i * 53 % 80 + 0.5, i * 71 % 80 + 0.5, i * 53 % 80 + 8.5, i * 71 % 80 + 6.5) for i in range(4)]
    parent, route, lost = routing.build(consumers, [(0, 0.0, 50.0, 2), (1, 100.0, 50.0, 2)], boxes, ("s", "NEAREST", True, "ANY", True))
    assert len(calls) <= 1 + len(consumers) and not lost
    # In blocks of one vertex the answer is the same.
    monkeypatch.setattr(routing, "AT_ONCE", 1)
    assert routing.build(consumers, [(0, 0.0, 50.0, 2), (1, 100.0, 50.0, 2)], boxes, ("s", "NEAREST", True, "ANY", True)) == (parent, route, lost)
