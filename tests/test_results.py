"""A result file against its input: a right one passes, each planted fault is found where it stands."""

import copy
import json
from math import hypot

import pytest
from pyspark.sql import functions as F

from pipeweave.functions import geometry as G
from pipeweave.operators import results

X0, Y0 = 400_000.0, 6_170_000.0
PLACES = {"west": (0, 0), "east": (200, 0), "chamber": (100, 0), "far": (100, -300), "A": (50, 80), "B": (150, 60), "C": (20, 90), "tie": (50, 0), "mid": (125, 30), "loop": (90, 70)}


@pytest.fixture(scope="module")
def at(spark):
    rows = spark.createDataFrame([(n, X0 + x, Y0 + y) for n, (x, y) in PLACES.items()], "n string, x double, y double")
    return {r.n: [r.p[0], r.p[1]] for r in rows.select("n", G.to_wgs84(F.col("x"), F.col("y")).alias("p")).collect()}


def feature(geometry, **properties):
    return {"type": "Feature", "properties": properties, "geometry": geometry}


def line(at, *names, **properties):
    return feature({"type": "LineString", "coordinates": [at[n] for n in names]}, **{"object_type": "heat_network", **properties})


def point(at, name, kind, **properties):
    return feature({"type": "Point", "coordinates": at[name]}, object_type=kind, **properties)


def source(at):
    return [line(at, "west", "chamber", id=100, diameter=300), line(at, "chamber", "east", id=101, diameter=300), point(at, "chamber", "heat_chamber", id=200), point(at, "far", "heat_chamber", id=201),
            point(at, "A", "oks_connection_point", id="A", flow_tph=5.0), point(at, "B", "oks_connection_point", id=7, flow_tph=3.0), point(at, "C", "oks_connection_point", id="C", flow_tph=2.0)]


def variant(at, name, rank):
    """A to a new chamber on the line, B over a technical node to the existing chamber, C left over."""
    n = round(hypot(25, 30), 3)
    a = dict(start_node_id="A", end_node_id=f"{name}_ch", flow_tph=5.0, diameter=65, length=80.0, laying_method="base", cost=80 * 78631, depth_start=None, depth_end=None)
    b = [dict(start_node_id=s, end_node_id=e, flow_tph=3.0, diameter=50, length=n, laying_method="base", cost=round(n * 74023), depth_start=None, depth_end=None) for s, e in ((7, f"{name}_t"), (f"{name}_t", 200))]
    lines = [line(at, "A", "tie", id=f"{name}_1", variant_id=name, **a), line(at, "B", "mid", id=f"{name}_2", variant_id=name, **b[0]), line(at, "mid", "chamber", id=f"{name}_3", variant_id=name, **b[1])]
    build, length = sum(f["properties"]["cost"] for f in lines) + 5_000_000 + 5_000_000, 80 + 2 * n
    total = build + 100_000_000 + 500_000 * 2
    summary = feature(None, object_type="variant_summary", id=f"{name}_s", variant_id=name, rank=rank, construction_cost=build, chamber_construction_cost=5_000_000, existing_chamber_tie_in_count=1, existing_chamber_tie_in_cost=5_000_000,
                      unconnected_penalty=total - build, calculated_cost=total, new_network_length=length, score=0.7 * total / 25e6 + 0.3 * length / 100, unconnected_oks_ids=["C"], mode="planar")
    return [*lines, point(at, "tie", "heat_chamber", id=f"{name}_ch", variant_id=name, diameter=300, cost=5_000_000), point(at, "mid", "technical_node", id=f"{name}_t", variant_id=name), summary]


def faults(at):
    """Name of a fault: what it does to a variant's features, and the codes that it must give."""
    def put(i, **properties):
        return lambda v: v[i]["properties"].update(properties)

    def drop(i, name):
        return lambda v: v[i]["properties"].pop(name)

    def both(*fs):
        return lambda v: [f(v) for f in fs]

    def shape(i, **geometry):
        return lambda v: v[i]["geometry"].update(geometry)

    summary = [(f"SUMMARY_{n.upper()}", put(5, **{n: 12345})) for n in ("construction_cost", "chamber_construction_cost", "existing_chamber_tie_in_cost", "unconnected_penalty", "calculated_cost", "new_network_length", "score")]
    return [
        ("BAD_OBJECT_TYPE", put(4, object_type="pipe")), ("MISSING_ID", put(4, id=None)), ("MISSING_VARIANT_ID", put(4, variant_id=None)), ("DUPLICATE_ID", put(4, id="A")), ("BAD_ID_TYPE", put(0, start_node_id=True)), ("BAD_NUMBER", put(0, cost="much")),
        ("BAD_INTEGER", put(5, attachment_point_count=1.5)), *(("MISSING_ATTRIBUTE", drop(0, n)) for n in ("start_node_id", "end_node_id", "flow_tph", "diameter", "length", "laying_method", "cost", "depth_start")), ("MISSING_ATTRIBUTE", drop(3, "diameter")),
        ("MISSING_ATTRIBUTE", drop(5, "score")), ("BAD_GEOMETRY", lambda v: v[3].update(geometry=None)), ("BAD_COORDINATE", shape(4, coordinates=[200.0, 10.0])), ("REPEATED_POINT", shape(0, coordinates=[at["A"], at["A"], at["tie"]])),
        ("SELF_INTERSECTION", shape(0, coordinates=[at["A"], at["chamber"], at["loop"], at["west"], at["tie"]])), ("BAD_LAYING_METHOD", put(0, laying_method="air")), ("BAD_FLOW", put(0, flow_tph=0)), ("BAD_DIAMETER", put(0, diameter=66)), ("BAD_LENGTH", put(0, length=80.1)),
        ("BAD_COST", put(0, cost=-1)), ("LINE_COST", put(0, cost=80 * 78631 + 20)), ("UNRESOLVED_NODE", put(0, end_node_id="nowhere")), ("UNRESOLVED_NODE", put(1, start_node_id="7")), ("DEGENERATE_LINE", put(2, start_node_id=200)), ("ENDPOINT_MISMATCH", shape(0, coordinates=[at["A"], at["mid"]])),
        ("OKS_DEGREE", lambda v: v.append(line(at, "A", "C", **v[0]["properties"] | {"id": "more", "end_node_id": "C"}))), ("TECHNICAL_NODE_DEGREE", lambda v: v.pop(2)), ("ISOLATED_CHAMBER", both(put(0, end_node_id=201), shape(0, coordinates=[at["A"], at["far"]]))),
        ("ORPHAN_CHAMBER", lambda v: v.pop(0)), ("CHAMBER_WITHOUT_BRANCH", both(shape(3, coordinates=at["loop"]), shape(0, coordinates=[at["A"], at["loop"]]))), ("NO_ROOT", both(shape(3, coordinates=at["loop"]), shape(0, coordinates=[at["A"], at["loop"]]))),
        ("CHAMBER_DEGREE", lambda v: v.extend(line(at, "C", "chamber", **v[0]["properties"] | {"id": f"x{i}", "start_node_id": "C", "end_node_id": 200}) for i in range(2))),
        ("CYCLE", lambda v: v.append(line(at, "B", "chamber", **v[1]["properties"] | {"id": "more", "end_node_id": 200}))), ("MULTIPLE_ROOTS", lambda v: v.append(line(at, "tie", "chamber", **v[0]["properties"] | {"id": "more", "start_node_id": v[3]["properties"]["id"], "end_node_id": 200}))),
        ("BAD_UNCONNECTED", put(5, unconnected_oks_ids="C")), ("BAD_UNCONNECTED", put(5, unconnected_oks_ids=["C", "7"])), ("DUPLICATE_UNCONNECTED", put(5, unconnected_oks_ids=["C", "C"])), ("UNCONNECTED_MISMATCH", put(5, unconnected_oks_ids=[])), ("UNCONNECTED_MISMATCH", put(5, unconnected_oks_ids=["C", "A"])),
        ("CAPACITY", put(0, flow_tph=9.0)), ("FLOW_MISMATCH", put(2, flow_tph=3.2)), ("DU_DECREASES", put(1, diameter=65)), ("DU_CHANGE_IN_SECTION", put(2, diameter=65)), ("CHAMBER_DIAMETER", put(3, diameter=65)), ("CHAMBER_COST", put(3, cost=3_000_000)), *summary,
        ("SUMMARY_EXISTING_CHAMBER_TIE_IN_COUNT", put(5, existing_chamber_tie_in_count=2)), ("BAD_RANK", put(5, rank=0)), ("BAD_MODE", put(5, mode="flat")), ("SUMMARY_GEOMETRY", lambda v: v[5].update(geometry={"type": "Point", "coordinates": at["A"]})), ("MISSING_SUMMARY", lambda v: v.pop(5)),
        ("DUPLICATE_SUMMARY", lambda v: v.append(feature(None, **v[5]["properties"] | {"id": "again"}))), ("DEPTH_NOT_NULL", put(0, depth_start=3.0)), *((c, both(put(5, mode="depth"), *(put(i, depth_start=3.0, depth_end=3.0) for i in range(3)), put(0, depth_start=a, depth_end=b))) for c, a, b in (
            ("DEPTH_REQUIRED", None, 3.0), ("DEPTH_MIN", 0.5, 3.0), ("DEPTH_SANITY", 120.0, 3.0), ("DEPTH_SLOPE", 12.0, 3.0), ("DEPTH_3M_SPLIT", 2.0, 4.0)))]


def write(path, features):
    path.write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    return str(path)


@pytest.fixture(scope="module")
def issues(spark, at, tmp_path_factory):
    folder = tmp_path_factory.mktemp("results")
    planted = []
    for i, (_, plant) in enumerate(faults(at)):
        v = copy.deepcopy(variant(at, f"f{i}", i + 2))
        plant(v)
        planted += v
    found = results.validate(spark, write(folder / "input.geojson", source(at)), write(folder / "result.geojson", [*variant(at, "right", 1), *planted]))
    out = {}
    for r in found.collect():
        out.setdefault(r.variant, []).append((r.code, r.id, r.severity))
    return out


def test_a_right_variant_has_no_issue(issues):
    # Scores of the others rank anywhere among it.
    assert {c for c, *_ in issues.get("right", [])} <= {"RANK_ORDER"}


def test_each_fault_is_found_in_its_variant(at, issues):
    for i, (code, _) in enumerate(faults(at)):
        where = [None] if code == "MISSING_VARIANT_ID" else [f"f{i}"]
        assert any(code == c for v in where for c, *_ in issues.get(v, [])), (i, code, issues.get(f"f{i}"))
    assert {s for v in issues.values() for c, _, s in v if c == "CHAMBER_WITHOUT_BRANCH"} == {"WARN"}


def test_single_faults_give_their_code_alone(at, issues):
    alone = {"BAD_INTEGER", "BAD_LAYING_METHOD", "CHAMBER_COST", "SUMMARY_SCORE", "BAD_MODE", "SUMMARY_GEOMETRY", "SUMMARY_UNCONNECTED_PENALTY", "DEPTH_NOT_NULL", "DEPTH_3M_SPLIT"}
    for i, (code, _) in enumerate(faults(at)):
        if code in alone - {"CHAMBER_COST", "DEPTH_3M_SPLIT", "BAD_MODE"}:
            assert {c for c, *_ in issues[f"f{i}"]} - {"RANK_ORDER"} == {code}, (code, issues[f"f{i}"])


def test_ranks_and_strict_reading(spark, at, tmp_path):
    a, b = variant(at, "v1", 2), variant(at, "v2", 2)
    where = write(tmp_path / "in.geojson", source(at))
    codes = {(r.variant, r.code) for r in results.validate(spark, where, write(tmp_path / "ranks.geojson", [*a, *b])).collect()}
    assert codes == {("v1", "RANK_ORDER"), ("v2", "DUPLICATE_RANK")}
    assert [r.code for r in results.validate(spark, where, write(tmp_path / "none.geojson", [])).collect()] == ["EMPTY_OUTPUT"]
    texts = {"MALFORMED_JSON": '{"features": [', "NOT_AN_OBJECT": "[]", "FEATURES_NOT_ONE_ARRAY": '{"features": {}}', "FEATURE_NOT_AN_OBJECT": '{"features": [1]}', "PROPERTIES_NOT_AN_OBJECT": '{"features": [{"geometry": null}]}'}
    texts |= {k: json.dumps({"features": [{"properties": {}, "geometry": g}]}) for k, g in {"GEOMETRY_TYPE": {"type": "Polygon", "coordinates": []}, "LINE_TOO_SHORT": {"type": "LineString", "coordinates": [[1, 2]]}, "COORDINATE": {"type": "Point", "coordinates": [1, 2, 3]}}.items()}
    texts["COORDINATE-2"] = json.dumps({"features": [{"properties": {}, "geometry": {"type": "LineString", "coordinates": [[1, 2], [1, "2"]]}}]})
    texts["MALFORMED_JSON-2"] = '{"features": [], "features": []}'
    for k, t in texts.items():
        (tmp_path / f"bad-{k}.json").write_text(t)
    good, problems = results.read(spark, f"{tmp_path}/bad-*.json")
    assert {r.file.split("bad-")[1].split(".")[0]: r.problem for r in problems.collect()} == {k: k.split("-")[0] for k in texts} and good.count() == 0


def test_documents_are_parsed_and_kinds_found_once(spark):
    """No later step parses a document again, and a number's kind isn't looked up beside its kind column."""
    one = '{"features": [{"geometry": null, "properties": {"id": 1, "cost": 2.5, "score": "x"}}]}'
    found, problems = results.strict(spark.createDataFrame([(1, one), (2, '{"features": []}'), (3, "{"), (4, '{"features": [7]}')], "file bigint, value string"))
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "parse_json" not in plan(found).lower() and "parse_json" not in plan(problems).lower()
    assert {(r.file, r["index"], r.problem) for r in problems.collect()} == {(3, None, "MALFORMED_JSON"), (4, 0, "FEATURE_NOT_AN_OBJECT")}
    typed = results.typed(found)
    row = typed.collect()[0]
    assert (row.file, row.k_cost, row.k_score, row.cost, row.score, row.k_rank) == (1, "NUMBER", "STRING", 2.5, None, None)
    assert plan(typed).count("properties.cost") == 1
