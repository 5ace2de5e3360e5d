"""A result file against its input: strict reading and the rules over its features, lines, nodes and summaries.

``validate`` is the one entry: (input, result) -> issue rows (severity, code,
variant, id). Features are rows from the start; a variant is never gathered in
one place. Ids keep their type: the number 1 and the text "1" are two ids.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import engineering as E
from ..functions import geometry as G
from ..plans import rules
from ..sources import geojson, split
from . import graph, jobs, spatial
from .shared import table
from .validate import OUTPUT_TYPES, emitted

# Attributes by kind and the tolerances of the summary.
IDS = ("id", "variant_id", "start_node_id", "end_node_id")
NUMBERS = ("flow_tph", "length", "cost", "depth_start", "depth_end", "construction_cost", "chamber_construction_cost", "existing_chamber_tie_in_cost", "unconnected_penalty", "calculated_cost", "new_network_length", "score")
INTEGERS = ("diameter", "rank", "existing_chamber_tie_in_count", "connected_oks_count", "attachment_point_count", "depth_transition_count", "vertical_crossing_count", "above_crossing_count", "below_crossing_count", "pass_under_count")
OF_LINES = ("start_node_id", "end_node_id", "flow_tph", "diameter", "length", "laying_method", "cost")
OF_SUMMARY = ("rank", "construction_cost", "chamber_construction_cost", "existing_chamber_tie_in_count", "existing_chamber_tie_in_cost", "unconnected_penalty", "calculated_cost", "new_network_length", "score", "unconnected_oks_ids")
TOLERANCES = {"construction_cost": 2.0, "chamber_construction_cost": 1.0, "existing_chamber_tie_in_count": 0.0, "existing_chamber_tie_in_cost": 1.0, "unconnected_penalty": 1.0, "calculated_cost": 3.0, "new_network_length": 0.05, "score": 5e-5}
NODE_MATCH, ON_LINE, NODE_NEAR = 0.002, 0.05, 0.5
NUMERIC = ("BIGINT", "DOUBLE", "FLOAT", "INT", "SMALLINT", "TINYINT")


def _kind(v: Column) -> Column:
    """The JSON kind of a variant: VOID for null, NUMBER, STRING, BOOLEAN, ARRAY, OBJECT; null where there is none."""
    # Bound by a lambda: each branch would else parse and look again.
    return G.let(F.schema_of_variant(v), _of_schema)


def _of_schema(s: Column) -> Column:
    return F.when(s.isin(*NUMERIC) | s.startswith("DECIMAL"), "NUMBER").when(s.startswith("ARRAY"), "ARRAY").when(s.startswith("OBJECT"), "OBJECT").otherwise(s)


def _got(path: str, of: str = "f") -> Column:
    return F.try_variant_get(F.col(of), F.lit(path), "variant")


def _position(c: Column) -> Column:
    """Whether a variant is an array of exactly two finite numbers."""
    both = F.try_variant_get(c, F.lit("$"), "array<variant>")
    finite = lambda x: (_kind(x) == "NUMBER") & (F.abs(F.try_variant_get(x, F.lit("$"), "double")) < float("inf"))
    return F.coalesce((_kind(c) == "ARRAY") & (F.size(both) == 2) & F.forall(both, finite), F.lit(False))


def read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``strict`` of the files under a path."""
    return strict(spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value"))


def strict(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Features (file, index, f) of result documents (file, value) and what is wrong with them (file, index, problem); a document with a problem is refused as a whole.

    The features must be one array of one complete object; each must be an
    object with an object of properties and a geometry that is null, a Point or
    a LineString of two positions at least, every position two finite numbers.
    """
    # Written once, with what is wrong: filters on it would else parse the documents and judge the features in every branch anew.
    rows = table(_judged(documents), "features")
    wrong = rows.where("bad IS NOT NULL").select("file", "index", F.col("bad").alias("problem"))
    problems = rows.where("problem IS NOT NULL").select("file", F.lit(None).cast("int").alias("index"), "problem").unionByName(wrong)
    return rows.where("index IS NOT NULL").select("file", "index", "f").join(problems.select("file").distinct(), "file", "left_anti"), problems


def _judged(documents: DataFrame) -> DataFrame:
    """file, problem, index, f, bad: every feature with what is wrong with it; a document without features, or with a problem of its own, is one row without index."""

    def whole(doc: Column) -> Column:
        features = F.try_variant_get(doc, F.lit("$.features"), "variant")
        problem = F.when(doc.isNull(), "MALFORMED_JSON").when(_kind(doc) != "OBJECT", "NOT_AN_OBJECT").when(F.coalesce(_kind(features), F.lit("VOID")) != "ARRAY", "FEATURES_NOT_ONE_ARRAY")
        return F.struct(problem.alias("problem"), F.try_variant_get(doc, F.lit("$.features"), "array<variant>").alias("features"))

    def bad(f: Column, geometry: Column) -> Column:
        drawn = F.coalesce(_kind(geometry), F.lit("VOID")) != "VOID"
        gtype, coordinates = F.try_variant_get(geometry, F.lit("$.type"), "string"), F.try_variant_get(geometry, F.lit("$.coordinates"), "variant")
        listed = F.try_variant_get(geometry, F.lit("$.coordinates"), "array<variant>")
        return (F.when(_kind(f) != "OBJECT", "FEATURE_NOT_AN_OBJECT").when(drawn & ~F.coalesce(gtype.isin("Point", "LineString"), F.lit(False)), "GEOMETRY_TYPE")
                .when(drawn & (gtype == "Point") & ~_position(coordinates), "COORDINATE")
                .when(drawn & (gtype == "LineString") & ~F.coalesce((_kind(coordinates) == "ARRAY") & (F.size(listed) >= 2), F.lit(False)), "LINE_TOO_SHORT")
                .when(drawn & (gtype == "LineString") & ~F.forall(listed, _position), "COORDINATE").when(F.coalesce(_kind(F.try_variant_get(f, F.lit("$.properties"), "variant")), F.lit("VOID")) != "OBJECT", "PROPERTIES_NOT_AN_OBJECT"))

    docs = documents.select("file", G.let(F.try_parse_json("value"), whole).alias("d"))
    each = docs.select("file", "d.problem", F.posexplode_outer(F.when(F.col("d.problem").isNull(), F.col("d.features"))).alias("index", "f"))
    return each.select("file", "problem", "index", "f", F.when(F.col("index").isNotNull(), bad(F.col("f"), _got("$.geometry"))).alias("bad"))


def _key(v: Column) -> Column:
    """An id with its type: n and the number, or s and the text."""
    return F.when(_kind(v) == "NUMBER", F.concat(F.lit("n"), F.try_variant_get(v, F.lit("$"), "double").cast("string"))).when(_kind(v) != "VOID", F.concat(F.lit("s"), F.try_variant_get(v, F.lit("$"), "string")))


def typed(features: DataFrame) -> DataFrame:
    """Columns of every result feature: its type, ids with their type, numbers, points in metres, and the kind of each attribute as k_<name>."""
    prop = lambda n: F.col(f"v_{n}")
    names = list(dict.fromkeys([*IDS, *NUMBERS, *INTEGERS, *OF_LINES, *OF_SUMMARY, "mode"]))
    held = features.select("*", *(_got(f"$.properties.{n}").alias(f"v_{n}") for n in dict.fromkeys([*names, "object_type"])))
    # Each kind is found in a step of its own, once for all that asks for it.
    held = held.select("*", *(F.schema_of_variant(prop(n)).alias(f"s_{n}") for n in names))
    held = held.select("*", *(_of_schema(F.col(f"s_{n}")).alias(f"k_{n}") for n in names))
    number = lambda n: F.when(F.col(f"k_{n}") == "NUMBER", F.try_variant_get(prop(n), F.lit("$"), "double")).alias(n)
    lonlat = F.when(F.try_variant_get("f", F.lit("$.geometry.type"), "string") == "Point", F.array(F.try_variant_get("f", F.lit("$.geometry.coordinates"), "array<double>"))).otherwise(F.try_variant_get("f", F.lit("$.geometry.coordinates"), "array<array<double>>"))
    text = lambda n: F.try_variant_get("f", F.lit(f"$.properties.{n}"), "string")
    out = held.select(
        "file", "index", F.when(_kind(prop("object_type")) == "STRING", text("object_type")).alias("object_type"), text("id").alias("id"), text("variant_id").alias("variant"), _key(prop("id")).alias("key"), _key(prop("start_node_id")).alias("start"), _key(prop("end_node_id")).alias("end"),
        text("laying_method").alias("laying"), text("mode").alias("mode"), F.transform(F.try_variant_get("f", F.lit("$.properties.unconnected_oks_ids"), "array<variant>"), _key).alias("unconnected"), *(f"k_{n}" for n in names), *(number(n) for n in (*NUMBERS, *INTEGERS)),
        F.try_variant_get("f", F.lit("$.geometry.type"), "string").alias("gtype"), lonlat.alias("lonlat"), (F.col("k_depth_start").isNotNull() & F.col("k_depth_end").isNotNull()).alias("has_depths"))
    return out.withColumn("points", F.transform("lonlat", lambda p: G.to_metric(p[0], p[1])))


def _issues(rows: DataFrame, checks: dict[str, Column], severity: str = "ERROR") -> DataFrame:
    return emitted(rows, checks, ["variant", "id"], severity)


def schema_issues(rows: DataFrame, input_ids: DataFrame) -> DataFrame:
    """Rules of one feature: type, ids, attributes, geometry. ``input_ids``: key."""
    absent = lambda n: F.coalesce(F.col(f"k_{n}"), F.lit("VOID")) == "VOID"
    named = F.col("object_type").isin(*OUTPUT_TYPES) & ~absent("id") & ~absent("variant_id")
    first = _issues(rows, {"BAD_OBJECT_TYPE": ~F.coalesce(F.col("object_type").isin(*OUTPUT_TYPES), F.lit(False)), "MISSING_ID": F.col("object_type").isin(*OUTPUT_TYPES) & absent("id"), "MISSING_VARIANT_ID": F.col("object_type").isin(*OUTPUT_TYPES) & ~absent("id") & absent("variant_id")})
    held = rows.where(named)
    line, chamber, node, summary = (F.col("object_type") == t for t in ("heat_network", "heat_chamber", "technical_node", "variant_summary"))
    wrong = lambda n, good: ~absent(n) & ~good
    any_of = lambda cs: reduce(Column.__or__, cs)
    is_number = lambda n: F.col(f"k_{n}") == "NUMBER"
    outside = F.exists("lonlat", lambda p: (F.abs(p[0]) > 180) | (F.abs(p[1]) > 90))
    gap = F.zip_with(F.slice("points", 1, F.size("points") - 1), F.slice("points", 2, F.size("points") - 1), G.distance)
    bad_shape = F.coalesce((line & (F.col("gtype") != "LineString")) | ((chamber | node) & (F.col("gtype") != "Point")), line | chamber | node)
    drawn = line & ~bad_shape & ~F.coalesce(outside, F.lit(False))
    numbered = F.row_number().over(Window.partitionBy("file", "key").orderBy("index"))
    held = held.withColumn("_again", numbered > 1).join(input_ids.select("key").distinct().withColumn("_taken", F.lit(True)), "key", "left")
    return first.unionByName(_issues(held, {
        "DUPLICATE_ID": F.col("_again") | F.coalesce("_taken", F.lit(False)),
        "BAD_ID_TYPE": any_of([wrong(n, F.col(f"k_{n}").isin("NUMBER", "STRING")) for n in IDS]),
        "BAD_NUMBER": any_of([wrong(n, is_number(n) & (F.abs(F.col(n)) < float("inf"))) for n in NUMBERS]),
        "BAD_INTEGER": any_of([wrong(n, F.coalesce(is_number(n) & (F.col(n) == F.rint(F.col(n))) & (F.col(n) >= 0), F.lit(False))) for n in INTEGERS]),
        "MISSING_ATTRIBUTE": (line & (any_of([absent(n) for n in OF_LINES]) | ~F.col("has_depths"))) | (chamber & (absent("diameter") | absent("cost"))) | (summary & any_of([absent(n) for n in OF_SUMMARY])),
        "BAD_GEOMETRY": bad_shape, "BAD_COORDINATE": F.coalesce((line | chamber | node) & ~bad_shape & outside, F.lit(False)), "SUMMARY_GEOMETRY": summary & F.col("gtype").isNotNull(),
        "REPEATED_POINT": drawn & F.exists(gap, lambda d: d < 1e-6),
        "BAD_LAYING_METHOD": drawn & ~F.coalesce(F.col("laying").isin("base", "special"), F.lit(False)), "BAD_FLOW": drawn & ~F.coalesce(F.col("flow_tph") > 0, F.lit(False)),
        "BAD_DIAMETER": drawn & ~F.coalesce(F.col("diameter").isin(*[r[0] for r in rules.DU_ROWS]), F.lit(False)), "BAD_LENGTH": drawn & ~F.coalesce(F.abs(F.col("length") - G.length(F.col("points"))) <= 0.02, F.lit(False)),
        "BAD_COST": drawn & ~F.coalesce(F.col("cost") >= 0, F.lit(False)), "BAD_RANK": summary & ~F.coalesce(F.col("rank") >= 1, F.lit(False)), "BAD_MODE": summary & ~absent("mode") & ~F.col("mode").isin("depth", "planar"),
        "BAD_UNCONNECTED": summary & (F.coalesce(F.col("k_unconnected_oks_ids"), F.lit("VOID")) != "ARRAY")}))


def self_intersections(lines: DataFrame) -> DataFrame:
    """SELF_INTERSECTION: lines (variant, id, points) two of whose segments cross, or touch without being neighbours."""
    seg = lines.select(F.struct("variant", "id").alias("of"), F.posexplode(F.zip_with(F.slice("points", 1, F.size("points") - 1), F.slice("points", 2, F.size("points") - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))).alias("k", "s"))
    seg = seg.select("of", "k", F.col("s.a.x").alias("ax"), F.col("s.a.y").alias("ay"), F.col("s.b.x").alias("bx"), F.col("s.b.y").alias("by_"))
    cells = spatial.walked(seg, 20.0, 1e-6)
    a, b = cells.alias("a"), cells.alias("b")
    ends = lambda n: [F.col(f"{n}.{c}") for c in ("ax", "ay", "bx", "by_")]
    p, q = ends("a"), ends("b")
    o = [G.orientation(*p, q[0], q[1]), G.orientation(*p, q[2], q[3]), G.orientation(*q, p[0], p[1]), G.orientation(*q, p[2], p[3])]
    # A closed line may meet itself where it ends.
    closing = (F.col("a.ax") == F.col("b.bx")) & (F.col("a.ay") == F.col("b.by_"))
    met = a.join(b, (F.col("a.of") == F.col("b.of")) & (F.col("a.cx") == F.col("b.cx")) & (F.col("a.cy") == F.col("b.cy")) & (F.col("a.k") + 1 < F.col("b.k"))).where((o[0] * o[1] <= 0) & (o[2] * o[3] <= 0) & ~closing)
    apart = (F.greatest(p[0], p[2]) < F.least(q[0], q[2])) | (F.least(p[0], p[2]) > F.greatest(q[0], q[2])) | (F.greatest(p[1], p[3]) < F.least(q[1], q[3])) | (F.least(p[1], p[3]) > F.greatest(q[1], q[3]))
    return met.where(~apart).select(F.lit("ERROR").alias("severity"), F.lit("SELF_INTERSECTION").alias("code"), "a.of.variant", "a.of.id").distinct()


def _adjacency(places: DataFrame, segments: DataFrame) -> DataFrame:
    """Of places (key, x, y): the sections of existing lines that meet there: a line that ends counts one, one that passes two."""
    near = spatial.points_near_segments(places, segments, NODE_NEAR)
    far = lambda x, y: (F.col("x") - F.col(x)) * (F.col("x") - F.col(x)) + (F.col("y") - F.col(y)) * (F.col("y") - F.col(y)) > NODE_NEAR * NODE_NEAR
    ends = ((F.col("k") == 1) & ~far("ax", "ay")) | ((F.col("k") == F.col("last")) & ~far("bx", "by_"))
    return near.groupBy("key", "line", "part").agg(F.max(ends).alias("ends")).groupBy("key").agg(F.sum(F.when(F.col("ends"), 1).otherwise(2)).alias("existing"))


def validate(spark: SparkSession, input_path: str, result_path: str) -> DataFrame:
    """severity, code, variant, id: everything the rules find in a result against its input; a result that can't be read gives only that."""
    found, problems = read(spark, result_path)
    source = table(geojson.typed(split.read(spark, input_path)), "input")
    rows = table(typed(found), "result")
    refused = problems.select(F.lit("ERROR").alias("severity"), F.lit("UNREADABLE_RESULT").alias("code"), F.lit(None).cast("string").alias("variant"), F.col("problem").alias("id"))
    return refused.unionByName(result_issues(rows, source))


def result_issues(rows: DataFrame, source: DataFrame) -> DataFrame:
    """The rules over ``typed`` features of a result and ``geojson.typed`` features of its input."""
    own = F.when(F.col("numeric_id"), F.concat(F.lit("n"), F.col("id_text").cast("double").cast("string"))).when(F.col("id_text").isNotNull(), F.concat(F.lit("s"), F.col("id_text")))
    at = lambda c: F.element_at("points", 1)[c].alias(c)
    source = source.withColumn("key", own)
    consumers = source.where("object_type = 'consumer' AND flow_tph > 0 AND size(points) > 0").select("key", at("x"), at("y"), "flow_tph")
    existing = source.where("object_type = 'heat_chamber' AND size(points) > 0").select("key", at("x"), at("y"))
    segments = table(jobs.network_segments(source), "segments")
    widths = source.where("object_type = 'heat_network'").select(F.xxhash64("file").alias("scene"), F.col("index").cast("bigint").alias("line"), F.col("diameter").alias("width"))
    good = rows.where(F.col("object_type").isin(*OUTPUT_TYPES) & F.col("id").isNotNull() & F.col("variant").isNotNull())
    lines = good.where("object_type = 'heat_network' AND gtype = 'LineString'")
    new = good.where("object_type IN ('heat_chamber', 'technical_node') AND gtype = 'Point'").select("variant", "key", "id", F.col("object_type").alias("kind"), at("x"), at("y"), F.col("diameter").alias("told_du"), F.col("cost").alias("told_cost"))
    variants = good.select("variant").distinct()
    issue = lambda df, code, severity="ERROR": df.select(F.lit(severity).alias("severity"), F.lit(code).alias("code"), "variant", "id")
    parts = [schema_issues(rows, source.where("key IS NOT NULL").select("key")), self_intersections(lines)]
    if rows.isEmpty():
        none = rows.sparkSession.range(1).select(F.lit(None).cast("string").alias("variant"), F.lit(None).cast("string").alias("id"))
        return issue(none, "EMPTY_OUTPUT")

    # Nodes of each variant: its own, else consumers and existing chambers that its lines name.
    named = lines.select("variant", F.explode(F.array("start", "end")).alias("key")).where("key IS NOT NULL").distinct()
    base = consumers.select("key", "x", "y", F.lit("consumer").alias("kind")).unionByName(existing.select("key", "x", "y", F.lit("existing_chamber").alias("kind")))
    others = named.join(new.select("variant", "key"), ["variant", "key"], "left_anti").join(base, "key").select("variant", "key", F.substring("key", 2, 1000).alias("id"), "kind", "x", "y")
    # An id of both a consumer and a chamber is the consumer's.
    others = others.groupBy("variant", "key", "id").agg(F.max_by(F.struct("kind", "x", "y"), F.col("kind") == "consumer").alias("n")).select("variant", "key", "id", "n.*")
    nodes = table(new.select("variant", "key", "id", "kind", "x", "y").unionByName(others), "nodes")
    end = lambda side: nodes.select("variant", F.col("key").alias(side), F.struct("x", "y").alias(f"{side}_at"))
    ended = table(lines.join(end("start").dropDuplicates(["variant", "start"]), ["variant", "start"], "left").join(end("end").dropDuplicates(["variant", "end"]), ["variant", "end"], "left"), "ended")
    off = lambda p, i: G.distance(F.col(p), F.element_at("points", i)) > NODE_MATCH
    parts.append(_issues(ended, {"UNRESOLVED_NODE": F.col("start_at").isNull() | F.col("end_at").isNull(), "DEGENERATE_LINE": F.col("start") == F.col("end"), "ENDPOINT_MISMATCH": off("start_at", 1) | off("end_at", -1)}))
    parts.append(issue(nodes.groupBy("variant", "id", "key").count().where("count > 1"), "DUPLICATE_NODE_ID"))

    # Degrees, roots, and the largest diameter at each node.
    tied = ended.where("start_at IS NOT NULL AND end_at IS NOT NULL")
    degree = tied.select("variant", "diameter", F.explode(F.array("start", "end")).alias("key")).groupBy("variant", "key").agg(F.count(F.lit(1)).alias("degree"), F.max("diameter").alias("widest"))
    places = nodes.where("kind IN ('existing_chamber', 'heat_chamber')").select(F.struct("variant", "key").alias("key"), "x", "y")
    adjacent = _adjacency(places, segments).select("key.variant", "key.key", "existing")
    touching = spatial.points_near_segments(places, segments.join(widths, ["scene", "line"], "left"), ON_LINE).groupBy("key").agg(F.max(F.coalesce("width", F.lit(0))).alias("on_width")).select("key.variant", "key.key", "on_width")
    full = nodes.join(degree, ["variant", "key"], "left").join(adjacent, ["variant", "key"], "left").join(touching, ["variant", "key"], "left").fillna(0, ["degree", "existing"])
    kind, chamber = F.col("kind"), F.col("kind") == "heat_chamber"
    full = table(full.withColumn("root", ((kind == "existing_chamber") & (F.col("existing") > 0)) | (chamber & F.col("on_width").isNotNull())), "degrees")
    counted = F.when(chamber & F.col("on_width").isNull(), 0).otherwise(F.col("existing"))
    parts.append(_issues(full, {"OKS_DEGREE": (kind == "consumer") & (F.col("degree") != 1), "TECHNICAL_NODE_DEGREE": (kind == "technical_node") & (F.col("degree") != 2), "ISOLATED_CHAMBER": (kind == "existing_chamber") & (F.col("existing") == 0),
                                "CHAMBER_DEGREE": (chamber | (kind == "existing_chamber")) & (counted + F.col("degree") > rules.MAX_DEGREE), "ORPHAN_CHAMBER": chamber & (F.col("degree") == 0)}))
    parts.append(_issues(full, {"CHAMBER_WITHOUT_BRANCH": chamber & F.col("on_width").isNull() & (F.col("degree") < 3)}, "WARN"))

    # Components by node numbers.
    number = lambda k: F.xxhash64("variant", k)
    links = tied.where(F.col("start") != F.col("end")).select(number("start").alias("child"), number("end").alias("parent"))
    member = graph.components(links)
    known = full.select(F.xxhash64("variant", "key").alias("id"), "variant", F.col("id").alias("name"), "root")
    held = member.join(known, "id").groupBy("component").agg(F.first("variant").alias("variant"), F.min("name").alias("id"), F.count(F.lit(1)).alias("nodes"), F.sum(F.col("root").cast("int")).alias("roots"))
    edges = links.join(member.withColumnRenamed("id", "child"), "child").groupBy("component").agg(F.count(F.lit(1)).alias("edges"))
    parts.append(_issues(held.join(edges, "component"), {"CYCLE": F.col("edges") != F.col("nodes") - 1, "NO_ROOT": F.col("roots") == 0, "MULTIPLE_ROOTS": F.col("roots") > 1}))

    # Consumers left over.
    summary = good.where("object_type = 'variant_summary'")
    listed = summary.select("variant", F.explode("unconnected").alias("key")).select("variant", "key", F.substring("key", 2, 1000).alias("id"))
    joined = full.where("kind = 'consumer' AND degree > 0").select("variant", "key")
    wanted = variants.join(consumers.select("key")).select("variant", "key", F.substring("key", 2, 1000).alias("id"))
    once = listed.distinct()
    parts += [issue(listed.join(consumers.select("key"), "key", "left_anti"), "BAD_UNCONNECTED"), issue(listed.groupBy("variant", "key", "id").count().where("count > 1"), "DUPLICATE_UNCONNECTED"),
              issue(once.join(joined, ["variant", "key"], "left_semi").unionByName(wanted.join(joined, ["variant", "key"], "left_anti").join(once, ["variant", "key"], "left_anti").select(*once.columns)), "UNCONNECTED_MISMATCH")]

    # Diameters, costs and summaries. (What a special line costs needs the objects it crosses; it is left to the spatial rules.)
    du = rules.table(rows.sparkSession, "du_table").select(F.col("du").alias("diameter"), "cap_dt", "cost_m")
    priced = lines.join(F.broadcast(du), "diameter")
    depths = F.col("depth_start").isNotNull() & F.col("depth_end").isNotNull()
    wants = F.col("length") * F.col("cost_m") * F.when(depths, E.k_depth(F.col("depth_start"), F.col("depth_end"))).otherwise(1.0)
    parts.append(_issues(priced, {"CAPACITY": F.col("flow_tph") * 10 > F.col("cap_dt") + 1e-8, "LINE_COST": (F.col("laying") == "base") & (F.abs(wants - F.col("cost")) > 1 + 1e-6 * wants)}))
    upper = tied.select("variant", F.col("start").alias("end"), F.col("diameter").alias("up"), F.col("id").alias("up_id"), F.col("flow_tph").alias("up_flow"))
    way = tied.select("variant", "end", "diameter", "flow_tph").join(upper, ["variant", "end"])
    parts.append(issue(way.where("up < diameter").select("variant", F.col("up_id").alias("id")).distinct(), "DU_DECREASES"))
    passing = full.where("degree = 2 AND kind <> 'consumer'").select("variant", F.col("key").alias("end"))
    parts.append(issue(way.join(passing, ["variant", "end"], "left_semi").where("up <> diameter AND abs(up_flow - flow_tph) < 1e-9").select("variant", F.col("up_id").alias("id")).distinct(), "DU_CHANGE_IN_SECTION"))
    carried = graph.gathered(links.distinct(), joined.join(consumers.select("key", "flow_tph"), "key").select(F.xxhash64("variant", "key").alias("id"), "flow_tph"), "flow_tph")
    parts.append(issue(tied.withColumn("link", number("start")).join(carried, "link").where(F.abs(F.col("flow_tph") - F.col("total")) > 1e-3), "FLOW_MISMATCH"))
    sized = full.where(chamber).join(new.select("variant", "key", "told_du", "told_cost"), ["variant", "key"]).withColumn("du", F.greatest(F.coalesce("widest", F.lit(0)), F.coalesce("on_width", F.lit(0))))
    parts.append(_issues(sized, {"CHAMBER_DIAMETER": ~F.coalesce(F.col("told_du") == F.col("du"), F.lit(False)), "CHAMBER_COST": ~F.coalesce(F.abs(F.col("told_cost") - E.chamber_cost(F.col("du"))) <= 1, F.lit(False))}))

    total = lambda df, value, name: df.groupBy("variant").agg(F.sum(value).alias(name))
    ties = total(full.where("kind = 'existing_chamber'"), "degree", "ties")
    left = once.join(consumers, "key").groupBy("variant").agg(F.sum(E.penalty(F.floor(F.col("flow_tph") * 10 + 0.5).cast("bigint"))).alias("penalty"))
    sums = (variants.join(total(priced, "cost", "line_cost"), "variant", "left").join(total(priced, "length", "network"), "variant", "left").join(total(sized, "told_cost", "chambers"), "variant", "left").join(ties, "variant", "left").join(left, "variant", "left")
            .fillna(0, ["line_cost", "network", "chambers", "ties", "penalty"]))
    build = F.col("line_cost") + F.col("chambers") + F.col("ties") * rules.TIE_IN_COST
    want = {"construction_cost": build, "chamber_construction_cost": F.col("chambers"), "existing_chamber_tie_in_count": F.col("ties"), "existing_chamber_tie_in_cost": F.col("ties") * rules.TIE_IN_COST, "unconnected_penalty": F.col("penalty"),
            "calculated_cost": build + F.col("penalty"), "new_network_length": F.col("network"), "score": E.score(F.coalesce("calculated_cost", build + F.col("penalty")), F.coalesce("new_network_length", "network"))}
    told = summary.join(sums, "variant")
    parts.append(_issues(told, {f"SUMMARY_{n.upper()}": ~F.coalesce(F.abs(F.col(n) - want[n]) <= t, F.lit(False)) for n, t in TOLERANCES.items()}))
    parts.append(issue(variants.join(summary.select("variant"), "variant", "left_anti").withColumn("id", F.lit(None).cast("string")), "MISSING_SUMMARY"))
    numbered = F.row_number().over(Window.partitionBy("variant").orderBy("index"))
    parts.append(issue(summary.withColumn("_n", numbered).where("_n > 1"), "DUPLICATE_SUMMARY"))
    # Variants are few: at most one row for each reaches this order.
    ranked = summary.withColumn("_n", numbered).where("_n = 1 AND rank IS NOT NULL AND score IS NOT NULL")
    place = F.row_number().over(Window.partitionBy("file").orderBy("score", "index"))
    again = F.row_number().over(Window.partitionBy("file", "rank").orderBy("score", "index"))
    parts.append(_issues(ranked.withColumns({"_p": place, "_a": again}), {"DUPLICATE_RANK": F.col("_a") > 1, "RANK_ORDER": F.col("rank") != F.col("_p")}))
    planar = summary.where("mode = 'planar'").select("variant").unionByName(variants.join(lines.where("depth_start IS NOT NULL OR depth_end IS NOT NULL").select("variant"), "variant", "left_anti").join(summary.where("mode = 'depth'").select("variant"), "variant", "left_anti")).distinct()
    deep = lines.join(planar, "variant", "left_anti")
    low, high = F.least("depth_start", "depth_end"), F.greatest("depth_start", "depth_end")
    parts.append(_issues(lines.join(planar, "variant", "left_semi"), {"DEPTH_NOT_NULL": F.col("depth_start").isNotNull() | F.col("depth_end").isNotNull()}))
    parts.append(_issues(deep, {"DEPTH_REQUIRED": F.col("depth_start").isNull() | F.col("depth_end").isNull(), "DEPTH_MIN": low < 0.7, "DEPTH_SANITY": high > 100, "DEPTH_SLOPE": (high - low) > F.col("length") * 0.1 + 2e-4, "DEPTH_3M_SPLIT": (low < 3) & (high > 3)}))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
