"""Planning jobs over copies of the reference's fixture scenes."""

import os

import numpy as np
import pytest

from pipeweave.operators import jobs, routing, tie_ins
from pipeweave.plans import rules

SCENES = os.path.join(os.path.dirname(__file__), "scenes")
#: Consumers of each scene and those no line can reach.
CONSUMERS = {"synthetic-basic": ({"cp-1", "2", "3"}, set()), "synthetic-shared-trunk": ({"A", "B"}, set()), "synthetic-unreachable": ({"far", "near"}, {"far"}), "depth-demo": ({"A", "B", "C"}, set())}


@pytest.fixture(scope="module")
def planned(spark):
    job = jobs.run(spark, f"{SCENES}/*.geojson")
    from pyspark.sql import functions as F

    names = {r.scene: (os.path.basename(r.file).split(".")[0]) for r in job.features.select("file", F.xxhash64("file").alias("scene")).distinct().collect()}
    ids = {(os.path.basename(r.file).split(".")[0], r["index"]): r.id_text for r in job.features.where("object_type = 'consumer'").collect()}
    links = [(names[r.scene], r.strategy, ids[names[r.scene], r.child], r) for r in job.links.collect()]
    places = {(names[r.scene], r.kind, r.id): r for r in job.planned.collect()}
    codes = {r.code for r in job.diagnostics.collect()}
    return links, places, codes


def test_consumers_of_the_reference_are_planned(planned):
    links, places, codes = planned
    assert "UNKNOWN_OBJECT_TYPE" not in codes
    for name, (consumers, lost) in CONSUMERS.items():
        for strategy in [r[0] for r in rules.STRATEGY_ROWS]:
            mine = {c: r for n, s, c, r in links if (n, s) == (name, strategy)}
            assert set(mine) == consumers, (name, strategy)
            if strategy != "existing_chambers":
                assert {c for c, r in mine.items() if not r.connected} == lost, (name, strategy)


def test_policy(planned):
    """Roots of existing_chambers are chambers; scenes without one connect nobody under it and tie in on lines else."""
    links, places, _ = planned
    for name, strategy, _, r in links:
        if r.connected and r.parent < 0:
            kind = "root" if (name, "root", -1 - r.parent) in places else "tie_in"
            assert (name, kind, -1 - r.parent) in places
            assert strategy != "existing_chambers" or kind == "root"
    shared = [(s, r.connected) for n, s, _, r in links if n == "synthetic-shared-trunk"]
    assert all(connected == (s != "existing_chambers") for s, connected in shared)
    assert any(s == "existing_chambers" and r.connected for n, s, _, r in links if n in ("synthetic-basic", "depth-demo"))


def test_policy_of_new_chambers_only():
    roots = [(1, 0.0, 10.0, 1, False), (2, 0.0, 30.0, 2, True)]
    parent = lambda policy: routing.build([(7, 0.0, 0.0, 5)], roots, [], ("x", "NEAREST", True, policy, False))[0]
    assert parent("ANY") == parent("EXISTING_ONLY") == {7: -2} and parent("NEW_ONLY") == {7: -3}


def test_candidates_on_a_line():
    lines = [np.array([[0.0, 0.0], [100.0, 0.0]]), np.array([[100.0, 0.0], [100.0, 50.0]])]
    degrees, found = tie_ins.candidates([(50.3, 20.0), (150.0, 300.0)], [(1, 0.0, 0.0), (2, 500.0, 500.0)], [(20.0, -5.0, 30.0, 5.0)], lines)
    assert degrees == [1, 2]
    at = {(round(x, 3), round(y, 3)): n for x, y, n in found}
    assert at[50.3, 0.0] == 2 and at[100.0, 0.0] == 2 and at[100.0, 50.0] == 1 and (20.0, 0.0) in at and (30.0, 0.0) in at
    assert all(not (20 < x < 30 and y == 0) and x * x + y * y > 100 for x, y in at)
    # No corner near: the points just outside the box come from the box itself.
    far = {round(x, 3) for x, y, _ in tie_ins.candidates([], [], [(20.5, -80.0, 30.5, 80.0)], lines[:1])[1]}
    assert {20.2, 30.8} <= far
    assert all((a - c) ** 2 + (b - d) ** 2 >= 1 for i, (a, b, _) in enumerate(found) for c, d, _ in found[:i])


def test_consumer_leaves_its_building_but_no_other_object():
    assert routing.leave(5, 2, [(0, 0, 10, 10)], 0) == (5, 0, 2)
    assert routing.leave(5, 2, [(0, -9, 10, 1), (0, 0, 10, 10)], 1) == (0, 2, 5)
    assert routing.leave(5, 2, [(0, 0, 10, 10)], 1) is None and routing.leave(15, 2, [(0, 0, 10, 10)], 1) == (15, 2, 0.0)
