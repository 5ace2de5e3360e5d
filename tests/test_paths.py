"""Paths as relations against the search of one scene in one place, and visibility against the rules for each pair."""

import random

from pyspark.sql import functions as F

from pipeweave.operators import paths, routing
from pipeweave.operators import polygons as P


def scenes():
    """Boxes and points of four scenes, and the graph of each."""
    out = {}
    for scene in range(4):
        r = random.Random(scene)
        boxes = [(x, y, x + r.randrange(5, 30), y + r.randrange(5, 30)) for x, y in ((r.randrange(200), r.randrange(200)) for _ in range(10 + scene))]
        graph = routing.Graph(boxes, [])
        free = [(x, y) for x, y in ((r.uniform(0, 200), r.uniform(0, 200)) for _ in range(12)) if not graph.inside(x, y)]
        out[scene] = (routing.Graph(boxes, free), len(free))
    return out


def relation(spark, graphs):
    rows = [(s, v, w, d) for s, (g, _) in graphs.items() for v in range(len(g.at)) for w, d in g.seen(v)]
    return spark.createDataFrame(rows, "scene bigint, src bigint, dst bigint, weight double")


def test_all_scenes_at_once(spark):
    graphs = scenes()
    edges = relation(spark, graphs)
    terminals = spark.createDataFrame([(s, v) for s, (_, n) in graphs.items() for v in range(n)], "scene bigint, node bigint")
    found = paths.shortest(edges, terminals.withColumnRenamed("node", "source"), terminals).cache()
    got = {(r.scene, r.source, r.node): r.cost for r in found.collect()}
    targets = terminals.withColumnRenamed("node", "target").join(terminals.withColumnRenamed("node", "source"), "scene")
    way = {}
    for r in paths.routes(found, targets).orderBy("place").collect():
        way.setdefault((r.scene, r.source, r.target), []).append(r.node)
    for s, (g, n) in graphs.items():
        for v in range(n):
            want = routing.shortest(g, v, set(range(n)), lambda w, n=n: w >= n)
            mine = {t: c for (ss, v0, t), c in got.items() if (ss, v0) == (s, v) and t < n}
            assert mine.keys() == want.keys() and all(abs(c - want[t][0]) < 1e-9 for t, c in mine.items())
            for t in want:
                nodes = way[s, v, t]
                assert nodes[0] == v and nodes[-1] == t and all(x >= n for x in nodes[1:-1])
                length = sum(((g.at[a] - g.at[b]) ** 2).sum() ** 0.5 for a, b in zip(nodes, nodes[1:]))
                assert abs(length + 0.3 * (len(nodes) - 1) - got[s, v, t]) < 1e-9
    nearest = {(r.scene, r.source): (r.target, r.cost) for r in paths.nearest_targets(found, terminals).collect()}
    assert nearest == {k: min(((t, c) for (s, v, t), c in got.items() if (s, v) == k and t < graphs[s][1] and t != v), key=lambda x: (x[1], x[0])) for k in nearest}


def test_bans_limits_and_ties(spark):
    edges = spark.createDataFrame([(0, 1, 2, 1.0), (0, 2, 4, 1.0), (0, 1, 3, 1.0), (0, 3, 4, 1.0), (0, 4, 5, 10.0), (0, 1, 2, 9.0), (1, 1, 2, 5.0), (0, 7, 8, 0.0)], "scene bigint, src bigint, dst bigint, weight double")
    sources = spark.createDataFrame([(0, 1), (1, 1), (2, 1), (0, 1)], "scene bigint, source bigint")
    rows = lambda **how: {(r.scene, r.node): (round(r.cost, 6), r.prev) for r in paths.shortest(edges, sources, **how).collect()}
    assert rows() == {(0, 1): (0, None), (0, 2): (1.3, 1), (0, 3): (1.3, 1), (0, 4): (2.6, 2), (0, 5): (12.9, 4), (1, 1): (0, None), (1, 2): (5.3, 1), (2, 1): (0, None)}
    assert (0, 5) not in rows(farthest=5.0) and rows(penalty=0.0)[0, 5] == (12, 4)
    banned = spark.createDataFrame([(0, 1, 2)], "scene bigint, src bigint, dst bigint")
    assert rows(banned=banned)[0, 4] == (2.6, 3) and (0, 2) not in rows(banned=banned)
    assert paths.shortest(edges.where("false"), sources.where("false")).count() == 0


def test_visible_pairs_follow_direction(spark):
    """A road that is entered steeply and left at a low angle is taken one way only; a wall shuts both."""
    nested = spark.createDataFrame([(1, [[(40.0, -50.0), (60.0, -50.0), (90.0, 50.0), (40.0, 50.0)]]), (2, [[(-50.0, 200.0), (150.0, 200.0), (150.0, 210.0), (-50.0, 210.0)]])], "poly bigint, rings array<array<struct<x:double,y:double>>>")
    zones = spark.createDataFrame([(1, "road", "SPECIAL", 80, 3, 160, 2.0), (2, "park", "FORBIDDEN", 0, 0, 100, 1.5)], "poly bigint, restriction_type string, kind string, min_angle int, extent_m int, kspec_pct bigint, need double")
    vertices = spark.createDataFrame([(1, 0.0, 0.0), (2, 120.0, 0.0), (3, 0.0, 150.0), (4, 0.0, 230.0), (5, 0.0, 0.0), (6, 42.0, 0.0)], "id bigint, x double, y double")
    got = {(r.a, r.b): (r.forward, r.backward, r.special, round(r.weight, 6), round(r.length, 6)) for r in P.visible(vertices, P.edges(nested), zones, 160.0).collect()}
    # 40 to 75 is road, with 3 m on both sides a section of 41 m at a factor of 1.6.
    assert got[1, 2] == got[2, 5][1:2] + got[2, 5][:1] + (True, 120 + 41 * 0.6, 120.0) == (True, False, True, 144.6, 120.0)
    assert got[1, 3] == (True, True, False, 150.0, 150.0) and (3, 4) not in got and (1, 5) not in got and (1, 6) not in got
    assert P.directed(P.visible(vertices, P.edges(nested), zones, 160.0)).where("src = 2 AND dst IN (1, 5)").count() == 0


def test_nearest_targets_need_no_way_past_another_target(spark):
    """Where ways end at the first target, the nearest one is the same and far pairs aren't looked for."""
    r = random.Random(2)
    edges = [(0, a, b, float(r.randrange(0, 9))) for a in range(12) for b in range(12) if a != b and r.random() < 0.3]
    ways = spark.createDataFrame(edges, "scene int, src bigint, dst bigint, weight double")
    nodes = spark.range(12).select(F.lit(0).alias("scene"), F.col("id").alias("node"))
    sources = nodes.select("scene", F.col("node").alias("source"))
    every, first = paths.shortest(ways, sources), paths.shortest(ways, sources, nodes)
    assert sorted(paths.nearest_targets(every, nodes).collect()) == sorted(paths.nearest_targets(first, nodes).collect())
    assert first.count() == 12 + len(edges) < every.count()
