"""Result documents made of the orders: one feature each, with faults by the order's number."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...operators import results
from ...operators.shared import table
from ..catalog import query

#: Fault of the document of an order, and the problem that strict reading names.
BROKEN = [("cut", "MALFORMED_JSON"), ("list", "NOT_AN_OBJECT"), ("none", "FEATURES_NOT_ONE_ARRAY"), ("number", "FEATURE_NOT_AN_OBJECT"), ("polygon", "GEOMETRY_TYPE"), ("three", "COORDINATE"), ("text", "COORDINATE"), ("short", "LINE_TOO_SHORT"), ("bare", "PROPERTIES_NOT_AN_OBJECT")]
#: Every 40th order each; the rest are right.
PROBLEM = "CASE " + " ".join(f"WHEN o_orderkey % 40 = {i} THEN '{problem}'" for i, (_, problem) in enumerate(BROKEN)) + " END"


@query("s10_strict_results", oracle=f"SELECT file, CASE WHEN problem IN ('MALFORMED_JSON', 'NOT_AN_OBJECT', 'FEATURES_NOT_ONE_ARRAY') THEN NULL ELSE 0 END::INT AS index, problem FROM (SELECT o_orderkey::BIGINT AS file, {PROBLEM} AS problem FROM orders) x WHERE problem IS NOT NULL")
def strict_results(s):
    """What is wrong with the document of each order."""
    kind = F.expr("CASE " + " ".join(f"WHEN o_orderkey % 40 = {i} THEN '{k}'" for i, (k, _) in enumerate(BROKEN)) + " ELSE 'right' END")
    place = F.format_string("[%s, %s]", (F.col("o_orderkey") % 90 + 0.5).cast("string"), (F.col("o_custkey") % 80 + 0.25).cast("string"))
    geometry = (F.when(F.col("kind") == "polygon", F.lit('{"type": "Polygon", "coordinates": []}')).when(F.col("kind") == "three", F.lit('{"type": "Point", "coordinates": [1, 2, 3]}')).when(F.col("kind") == "text", F.lit('{"type": "LineString", "coordinates": [[1, 2], ["1", 2]]}'))
                .when(F.col("kind") == "short", F.format_string('{"type": "LineString", "coordinates": [%s]}', place)).when(F.col("o_orderkey") % 2 == 0, F.format_string('{"type": "LineString", "coordinates": [%s, [1, 2]]}', place)).otherwise(F.lit("null")))
    feature = F.when(F.col("kind") == "number", F.lit("7")).otherwise(F.format_string('{"type": "Feature", "geometry": %s, "properties": %s}', geometry, F.when(F.col("kind") == "bare", F.lit("null")).otherwise(F.format_string('{"id": %d}', F.col("o_orderkey")))))
    value = (F.when(F.col("kind") == "list", F.format_string("[%s]", feature)).when(F.col("kind") == "none", F.lit('{"type": "FeatureCollection"}')).when(F.col("kind") == "cut", F.format_string('{"features": [%s', feature))
             .otherwise(F.format_string('{"type": "FeatureCollection", "features": [%s]}', feature)))
    docs = table(s.orders.withColumn("kind", kind).select(F.col("o_orderkey").cast("bigint").alias("file"), value.alias("value")), "documents")
    return results.strict(docs)[1]


REQUIRED = ["start_node_id", "end_node_id", "flow_tph", "diameter", "length", "laying_method", "cost"]
#: Fault of an order's line and the codes it gives.
WRONG = {0: ("id", "BAD_ID_TYPE"), 1: ("number", "BAD_NUMBER"), 2: ("integer", "BAD_INTEGER"), 3: ("type", "BAD_OBJECT_TYPE"), 4: ("nameless", "MISSING_ID"), 5: ("variantless", "MISSING_VARIANT_ID"), 6: ("laying", "BAD_LAYING_METHOD"), 7: ("flow", "BAD_FLOW"), 8: ("du", "BAD_DIAMETER"), 9: ("cheap", "BAD_COST"),
         10: ("twice", "DUPLICATE_ID"), 11: ("depthless", "MISSING_ATTRIBUTE"), 12: ("point", "BAD_GEOMETRY"), 13: ("far", "BAD_COORDINATE")} | {14 + i: (n, "MISSING_ATTRIBUTE") for i, n in enumerate(REQUIRED)}
#: A missing number is wrong besides, and so is a length that no geometry has.
BESIDES = {"flow_tph": "BAD_FLOW", "diameter": "BAD_DIAMETER", "laying_method": "BAD_LAYING_METHOD", "cost": "BAD_COST"}
CODES = " UNION ALL ".join([f"SELECT o_orderkey, '{code}' AS code FROM orders WHERE o_orderkey % 50 = {i}" for i, (_, code) in WRONG.items()] + [f"SELECT o_orderkey, '{BESIDES[n]}' FROM orders WHERE o_orderkey % 50 = {i}" for i, (n, _) in WRONG.items() if n in BESIDES]
                           + ["SELECT o_orderkey, 'BAD_LENGTH' FROM orders WHERE o_orderkey % 50 NOT IN (3, 4, 5, 12, 13)", "SELECT o_orderkey, 'BAD_DIAMETER' FROM orders WHERE o_orderkey % 50 = 2", "SELECT o_orderkey, 'BAD_COST' FROM orders WHERE o_orderkey % 50 = 1"])


@query("v03_result_schema", oracle=f"SELECT 'ERROR' AS severity, code, CASE WHEN code = 'MISSING_VARIANT_ID' THEN NULL ELSE 'v' || (o_orderkey % 3) END AS variant, CASE WHEN code = 'MISSING_ID' THEN NULL WHEN code = 'BAD_ID_TYPE' OR o_orderkey % 50 = 0 THEN 'true' WHEN o_orderkey % 50 = 10 THEN '-1' ELSE o_orderkey::VARCHAR END AS id FROM ({CODES}) x")
def result_schema(s):
    """Rules of the attributes and geometry of a line for each order; each fault is planted in every 50th. (Only the lines of wrong ids share an id.)"""
    fault = F.expr("CASE " + " ".join(f"WHEN o_orderkey % 50 = {i} THEN '{k}'" for i, (k, _) in WRONG.items()) + " ELSE '' END")
    rows = s.orders.withColumn("fault", fault)
    when = lambda name, value, other: F.when(F.col("fault") == name, F.lit(value)).otherwise(other if not isinstance(other, str) else F.lit(other))
    key = F.col("o_orderkey").cast("string")
    of = {
        "id": when("id", "true", when("twice", "-1", when("nameless", "null", key))), "object_type": when("type", '"pipe"', '"heat_network"'), "variant_id": when("variantless", "null", F.format_string('"v%d"', F.col("o_orderkey") % 3)), "start_node_id": when("start_node_id", "null", key),
        "end_node_id": when("end_node_id", "null", '"end"'), "flow_tph": when("flow_tph", "null", when("flow", "-2", "5.5")), "diameter": when("diameter", "null", when("du", "66", when("integer", "65.5", "65"))), "length": when("length", "null", "123456789"),
        "laying_method": when("laying_method", "null", when("laying", '"air"', '"base"')), "cost": when("cost", "null", when("cheap", "-1", when("number", '"much"', "100"))), "depth_end": F.lit("null")}
    members = F.concat_ws(", ", *(F.concat(F.lit(f'"{n}": '), v) for n, v in of.items()), F.when(F.col("fault") != "depthless", F.lit('"depth_start": null')))
    geometry = F.when(F.col("fault") == "point", F.lit('{"type": "Point", "coordinates": [37.5, 55.5]}')).when(F.col("fault") == "far", F.lit('{"type": "LineString", "coordinates": [[37.5, 55.5], [200, 10]]}')).otherwise(F.lit('{"type": "LineString", "coordinates": [[37.5, 55.5], [37.51, 55.5]]}'))
    document = F.format_string('{"features": [{"geometry": %s, "properties": {%s}}]}', geometry, members)
    # Written between the steps, as a job does that reads files: each is large enough for one plan.
    documents = table(rows.select(F.col("o_orderkey").cast("bigint").alias("file"), document.alias("value")), "documents")
    typed = table(results.typed(results.strict(documents)[0]), "result")
    return results.schema_issues(typed, s.spark.sql("SELECT 'n-1.0' AS key"))
