"""GeoJSON feature collections: reading with row diagnostics, and writing.

``read`` takes a file whole in one task (``wholetext``) and splits it by JSON
functions in the JVM: for many small files. ``split.read`` gives the same rows from files of any
size, cut into many tasks. One row stands for one feature from there on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as T
from ..plans import rules

OBJECT_TYPES = ("heat_network", "heat_chamber", "source", "consumer", "restriction")
POINT_TYPES = ("heat_chamber", "source", "consumer")
#: The name of a consumer in input files; rows hold ``consumer`` for either.
CONSUMER = "oks_connection_point"
#: Byte estimate of a retained feature: fixed, for each position, part and hole.
ESTIMATE = (256, 24, 128, 128)
#: Features whose estimates are summed up in one window.
BLOCK = 65536
DEPTH_OF = {"Point": 1, "LineString": 2, "MultiPoint": 2, "Polygon": 3, "MultiLineString": 3, "MultiPolygon": 4}


def read(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """file, index, feature (JSON text; null if the feature is no object)."""
    docs = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("doc"))
    each = docs.select("file", F.posexplode(F.from_json(F.get_json_object("doc", "$.features"), "array<string>")).alias("index", "feature"))
    each = each.select("file", "index", F.when(F.get_json_object("feature", "$.type").isNotNull(), F.col("feature")).alias("feature"))
    return each.repartition(partitions, "file", "index") if partitions else each


def document_issues(spark: SparkSession, path: str) -> DataFrame:
    """NOT_FEATURE_COLLECTION for files of another kind."""
    docs = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("doc"))
    return docs.where(F.coalesce(F.get_json_object("doc", "$.type") != "FeatureCollection", F.lit(True))).select("file", F.lit("ERROR").alias("severity"), F.lit("NOT_FEATURE_COLLECTION").alias("code"))


def within_bytes(spark: SparkSession, path: str, most: int) -> DataFrame:
    """Files and whether they respect the limit, from the listing alone."""
    return spark.read.format("binaryFile").load(path).select("path", "length", (F.col("length") <= most).alias("within"))


def positions(coordinates: Column, depth: Column) -> Column:
    """All positions of a geometry as [x, y] arrays, whatever its depth."""
    one = F.from_json(coordinates, "array<double>")
    two = F.from_json(coordinates, "array<array<double>>")
    three = F.flatten(F.from_json(coordinates, "array<array<array<double>>>"))
    four = F.flatten(F.flatten(F.from_json(coordinates, "array<array<array<array<double>>>>")))
    return F.when(depth == 1, F.array(one)).when(depth == 2, two).when(depth == 3, three).when(depth == 4, four)


def typed(features: DataFrame) -> DataFrame:
    """Columns of every feature: id, object_type, gtype, points (metric), attributes."""
    get = lambda p: F.get_json_object("feature", p)
    depth = F.lit(None).cast("int")
    for name, d in DEPTH_OF.items():
        depth = F.when(F.col("gtype") == name, d).otherwise(depth)
    raw = features.select("*", F.to_json(F.struct(F.expr("try_variant_get(try_parse_json(feature), '$.properties.id', 'string')").alias("v"))).alias("_id"), F.expr("schema_of_variant(try_variant_get(try_parse_json(feature), '$.properties.id'))").alias("id_kind"),
                          get("$.properties.id").alias("id_text"), T.type_code(get("$.properties.object_type")).alias("object_type"), get("$.geometry.type").alias("gtype"), get("$.geometry.coordinates").alias("_coordinates"),
                          get("$.properties.flow_tph").try_cast("double").alias("flow_tph"), get("$.properties.diameter").try_cast("int").alias("diameter"), T.type_code(get("$.properties.restriction_type")).alias("restriction_type"))
    raw = raw.withColumn("object_type", F.when(F.col("object_type") == CONSUMER, "consumer").otherwise(F.col("object_type")))
    out = raw.withColumn("lonlat", positions(F.col("_coordinates"), depth)).drop("_id", "_coordinates")
    out = out.withColumn("numeric_id", F.col("id_kind") != "STRING")
    return out.withColumn("points", F.transform("lonlat", lambda p: G.to_metric(p[0], p[1])))


def diagnostics(rows: DataFrame) -> DataFrame:
    """severity, code, index of every row rule; consumers and restrictions are errors, others warnings."""
    strict = F.col("object_type").isin("consumer", "restriction")
    severity = F.when(strict, "ERROR").otherwise("WARN")
    again = F.row_number().over(Window.partitionBy("file", "numeric_id", "id_text").orderBy("index")) > 1
    known = F.col("object_type").isin(*OBJECT_TYPES)
    outside = F.exists("lonlat", lambda p: (F.size(p) < 2) | (F.abs(p[0]) > 180) | (F.abs(p[1]) > 90))
    dus = [r[0] for r in rules.DU_ROWS]
    checks = [
        ("ERROR", "BAD_FEATURE", F.col("feature").isNull()),
        ("WARN", "UNKNOWN_OBJECT_TYPE", F.col("feature").isNotNull() & ~F.coalesce(known, F.lit(False))),
        (None, "MISSING_ID", known & F.col("id_text").isNull()),
        ("ERROR", "DUPLICATE_ID", known & F.col("id_text").isNotNull() & F.col("_again")),
        (None, "MISSING_GEOMETRY", known & F.col("gtype").isNull()),
        (None, "EMPTY_GEOMETRY", known & F.col("gtype").isNotNull() & (F.coalesce(F.size("lonlat"), F.lit(0)) <= 0)),
        (None, "COORDINATE_OUT_OF_RANGE", known & outside),
        ("ERROR", "BAD_GEOMETRY_TYPE", F.col("object_type").isin(*POINT_TYPES) & ~F.col("gtype").isin("Point", "MultiPoint") | (F.col("object_type") == "heat_network") & ~F.col("gtype").isin("LineString", "MultiLineString")),
        ("ERROR", "MISSING_FLOW", (F.col("object_type") == "consumer") & ~F.coalesce((F.col("flow_tph") > 0) & ~F.isnan("flow_tph") & (F.col("flow_tph") < float("inf")), F.lit(False))),
        ("WARN", "MISSING_DIAMETER", (F.col("object_type") == "heat_network") & F.col("diameter").isNull()),
        ("WARN", "NON_STANDARD_DIAMETER", (F.col("object_type") == "heat_network") & ~F.col("diameter").isin(*dus)),
        ("WARN", "MULTILINE_NETWORK", (F.col("object_type") == "heat_network") & (F.col("gtype") == "MultiLineString")),
        ("WARN", "UNKNOWN_RESTRICTION_TYPE", (F.col("object_type") == "restriction") & ~F.coalesce(F.col("restriction_type").isin(*[r[0] for r in rules.RULE_ROWS]), F.lit(False))),
        ("WARN", "POINT_RESTRICTION", (F.col("object_type") == "restriction") & F.col("gtype").isin("Point", "MultiPoint")),
    ]
    found = F.filter(F.array(*(F.when(c, F.struct((F.lit(s) if s else severity).alias("severity"), F.lit(code).alias("code"))) for s, code, c in checks)), lambda x: x.isNotNull())
    marked = rows.withColumn("_again", again)
    return marked.select("file", "index", F.explode(found).alias("d")).select("file", "index", "d.severity", "d.code")


def polygon_edges(rows: DataFrame) -> DataFrame:
    """poly (file and index), ring, k and ends in metres of the edges of all polygons, holes and further parts as rings of their own."""
    from ..operators import polygons

    coordinates = F.get_json_object("feature", "$.geometry.coordinates")
    rings = F.when(F.col("gtype") == "Polygon", F.from_json(coordinates, "array<array<array<double>>>")).when(F.col("gtype") == "MultiPolygon", F.flatten(F.from_json(coordinates, "array<array<array<array<double>>>>")))
    held = rows.where("gtype IN ('Polygon', 'MultiPolygon')").select(F.struct("file", "index").alias("poly"), rings.alias("rings"))
    return polygons.edges(held.withColumn("rings", F.transform("rings", lambda r: F.transform(r, lambda p: G.to_metric(p[0], p[1])))))


def repaired_geometries(rows: DataFrame) -> DataFrame:
    """INVALID_GEOMETRY_REPAIRED for every polygon whose rings cross, overlap or are drawn twice; ``polygons.repaired`` of its edges is what is planned with."""
    from ..operators import polygons

    return polygons.invalid(polygon_edges(rows)).select("poly.file", "poly.index", F.lit("WARN").alias("severity"), F.lit("INVALID_GEOMETRY_REPAIRED").alias("code"))


def summary(rows: DataFrame) -> DataFrame:
    """Rows per object type, and what a document lacks."""
    counts = rows.groupBy("file").agg(*(F.count_if(F.col("object_type") == t).alias(t) for t in OBJECT_TYPES), F.count(F.lit(1)).alias("features"))
    lacking = F.filter(F.array(F.when(F.col("heat_network") == 0, F.lit("NO_HEAT_NETWORK")), F.when(F.col("consumer") == 0, F.lit("NO_CONNECTION_POINTS")), F.when(F.col("source") == 0, F.lit("NO_SOURCE"))), lambda x: x.isNotNull())
    return counts.withColumn("lacking", lacking)


def retained_bytes(rows: DataFrame) -> DataFrame:
    """file, index, own, running: byte estimate of each feature and of all up to it; parts and holes count beside positions.

    Sums inside blocks of features and over the blocks of a file, so no window holds a whole file.
    """
    base, point, part, hole = ESTIMATE
    coordinates = F.get_json_object("feature", "$.geometry.coordinates")
    two, three = (F.from_json(coordinates, kind) for kind in ("array<string>", "array<array<string>>"))
    multi = F.col("gtype").isin("MultiPoint", "MultiLineString", "MultiPolygon")
    parts = F.when(multi, F.size(two)).when(F.col("gtype").isin("Point", "LineString", "Polygon") & (F.size("lonlat") > 0), 1)
    holes = F.when(F.col("gtype") == "Polygon", F.size(two) - 1).when(F.col("gtype") == "MultiPolygon", F.aggregate(three, F.lit(0), lambda n, p: n + F.greatest(F.size(p) - 1, F.lit(0))))
    count = lambda c: F.greatest(F.coalesce(c, F.lit(0)), F.lit(0))
    own = base + point * count(F.size("lonlat")) + part * count(parts) + hole * count(holes)
    held = rows.select("file", "index", F.expr(f"index div {BLOCK}").alias("_block"), own.cast("bigint").alias("own"))
    blocks = held.groupBy("file", "_block").agg(F.sum("own").alias("_of"))
    blocks = blocks.select("file", "_block", (F.sum("_of").over(Window.partitionBy("file").orderBy("_block")) - F.col("_of")).alias("_before"))
    inside = F.sum("own").over(Window.partitionBy("file", "_block").orderBy("index").rowsBetween(Window.unboundedPreceding, 0))
    return held.join(blocks, ["file", "_block"]).select("file", "index", "own", (inside + F.col("_before")).alias("running"))


def over_budget(rows: DataFrame, most: int) -> DataFrame:
    """file, index of the first feature with which a document would retain more than ``most`` bytes; none for a document within it."""
    return retained_bytes(rows).where(F.col("running") > most).groupBy("file").agg(F.min("index").alias("index"))


def point_geometry(lon: Column, lat: Column, decimals: int = 12) -> Column:
    return F.struct(F.lit("Point").alias("type"), F.array(F.round(lon, decimals), F.round(lat, decimals)).alias("coordinates"))


def line_geometry(line: Column, decimals: int = 12) -> Column:
    """GeoJSON of a metric line, in WGS84."""
    def position(p):
        return G.let(G.to_wgs84(p["x"], p["y"]), lambda w: F.array(F.round(w["lon"], decimals), F.round(w["lat"], decimals)))

    return F.struct(F.lit("LineString").alias("type"), F.transform(line, position).alias("coordinates"))


def feature(geometry: Column, properties: Column) -> Column:
    """One feature as JSON text, properties in their order."""
    return F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), properties.alias("properties")))


def write(features: DataFrame, path: str, name: str, order: list[str]) -> None:
    """One feature collection in one file, features by ``order``; a null feature is written as null.

    One task streams the sorted rows out, a line each; nothing is gathered. For many scenes write each, or partition by scene first.
    """
    head = f'{{"type":"FeatureCollection","name":"{name}","crs":{{"type":"name","properties":{{"name":"urn:ogc:def:crs:OGC:1.3:CRS84"}}}},"features":['
    rows = features.select(F.lit(1).alias("_k"), F.struct(*order).alias("_keys"), F.coalesce("feature", F.lit("null")).alias("value"))
    ends = features.sparkSession.createDataFrame([(0, head), (2, "]}")], "_k int, value string").select("_k", F.lit(None).cast(rows.schema["_keys"].dataType).alias("_keys"), "value")
    # In one partition the ids are the places of the lines: the head is 0 and the first feature 1.
    lines = rows.unionByName(ends).repartition(1).sortWithinPartitions("_k", "_keys").withColumn("_at", F.monotonically_increasing_id())
    lines.select(F.when((F.col("_k") == 1) & (F.col("_at") > 1), F.concat(F.lit(","), F.col("value"))).otherwise(F.col("value")).alias("value")).write.text(path)


def write_csv(rows: DataFrame, path: str, numeric: tuple[str, ...] = (), order: tuple[str, ...] = ()) -> None:
    """A ;-separated report in one file, its rows by ``order``; cells are defused and quoted by ``csv_cell``."""
    cells = F.concat_ws(";", *(T.csv_cell(F.col(c).cast("string"), F.lit(c in numeric)) for c in rows.columns))
    keys = F.struct(*order) if order else F.lit(None)
    header = rows.sparkSession.range(1).select(F.lit(";".join(rows.columns)).alias("value"))
    lines = rows.select(keys.alias("_keys"), cells.alias("value"))
    # One file holds one order: the header has no keys, and rows with null keys come after it.
    top = header.select(F.lit(None).cast(lines.schema["_keys"].dataType).alias("_keys"), "value", F.lit(0).alias("_k"))
    top.unionByName(lines.withColumn("_k", F.lit(1))).repartition(1).sortWithinPartitions("_k", "_keys").select("value").write.text(path)
