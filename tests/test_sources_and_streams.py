import json

from pyspark.sql import functions as F

from pipeweave.sources import geojson
from pipeweave.streaming import lifecycle


def test_feature_collection(spark, tmp_path):
    doc = {"type": "FeatureCollection", "features": [
        {"type": "Feature", "geometry": {"type": "Point", "coordinates": [37.6, 55.75, 1]}, "properties": {"id": 7, "object_type": " Consumer", "flow_tph": 2.5}},
        {"type": "Feature", "geometry": {"type": "LineString", "coordinates": [[37.6, 55.75], [37.7, 55.75]]}, "properties": {"id": "7", "object_type": "heat_network", "diameter": 110}},
        {"type": "Feature", "geometry": None, "properties": {"object_type": "consumer"}},
        {"type": "Feature", "geometry": {"type": "Polygon", "coordinates": [[[37, 55], [38, 55], [38, 56], [37, 55]]]}, "properties": {"id": 7, "object_type": "restriction", "restriction_type": "road"}},
        17]}
    (tmp_path / "a.geojson").write_text(json.dumps(doc))
    rows = geojson.typed(geojson.read(spark, str(tmp_path / "a.geojson")))
    got = {(r["index"], r["code"]) for r in geojson.diagnostics(rows).collect()}
    assert got == {(1, "NON_STANDARD_DIAMETER"), (2, "MISSING_ID"), (2, "MISSING_GEOMETRY"), (2, "MISSING_FLOW"), (3, "DUPLICATE_ID"), (4, "BAD_FEATURE")}
    assert [len(r.points or []) for r in rows.orderBy("index").collect()][:4] == [1, 2, 0, 4]
    assert geojson.document_issues(spark, str(tmp_path)).count() == 0


def test_writers(spark, tmp_path):
    rows = spark.createDataFrame([(1, "=x", 2.5), (2, 'a;"b"', -1.0)], "id int, name string, v double")
    geojson.write_csv(rows.orderBy("id"), str(tmp_path / "csv"), ("id", "v"))
    text = next((tmp_path / "csv").glob("part-*")).read_text()
    assert text.splitlines()[0] == "id;name;v" and "1;'=x;2.5" in text and '2;"a;""b""";-1.0' in text
    features = rows.select("id", geojson.feature(geojson.point_geometry(F.lit(37.5), F.lit(55.5)), F.struct("id", "name")).alias("feature"))
    geojson.write(features, str(tmp_path / "json"), "scene", ["id"])
    doc = json.loads(next(p for p in (tmp_path / "json").glob("part-*") if p.stat().st_size).read_text())
    assert [f["properties"]["id"] for f in doc["features"]] == [1, 2] and doc["features"][0]["geometry"]["coordinates"] == [37.5, 55.5]


def test_job_stream(spark, tmp_path):
    events = [(1, "QUEUED", 1), (1, "RUNNING", 2), (1, "RUNNING", 3), (1, "DONE", 4), (2, "DONE", 5), (2, "QUEUED", 6), (2, "FAILED", 7)]
    rows = spark.createDataFrame(events, "job bigint, status string, event_id bigint").withColumn("at", F.timestamp_seconds("event_id"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = lifecycle.job_states(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("jobs").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    got = sorted(((r.job, r.status, r.accepted) for r in spark.table("jobs").collect()), key=repr)
    assert got.count((1, "RUNNING", False)) == 1 and (1, "DONE", True) in got and (2, "FAILED", True) in got


def test_session_stream_equals_batch(spark, tmp_path):
    from pipeweave.operators import uploads

    hours = [0, 5, 40, 41, 100]
    rows = spark.createDataFrame([(1, h * 3600) for h in hours] + [(2, 500 * 3600)], "upload bigint, t bigint").select("upload", F.timestamp_seconds("t").alias("at"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = lifecycle.upload_sessions(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("sessions").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    got = sorted((r.upload, r.n) for r in spark.table("sessions").collect())
    batch = sorted((r.upload, r.n) for r in uploads.sessions(rows.withColumnRenamed("at", "ts")).collect())
    assert batch == [(1, 1), (1, 2), (1, 2), (2, 1)] and got == [b for b in batch if b[0] == 1]  # the last session is still open


def test_budget_names_the_first_feature_beyond_it(spark):
    texts = ['{"type":"Feature","properties":{},"geometry":{"type":"Point","coordinates":[37,55]}}', None, '{"type":"Feature","properties":{},"geometry":{"type":"MultiLineString","coordinates":[[[37,55],[37,56]],[[1,2],[3,4]]]}}', '{"type":"Feature","properties":{}}']
    rows = geojson.typed(spark.createDataFrame([("a", k, t) for k, t in enumerate(texts)] + [("b", 70000, texts[0]), ("b", 1, texts[0])], "file string, index int, feature string"))
    got = {(r["file"], r["index"]): (r["own"], r["running"]) for r in geojson.retained_bytes(rows).collect()}
    assert got == {("a", 0): (408, 408), ("a", 1): (256, 664), ("a", 2): (608, 1272), ("a", 3): (256, 1528), ("b", 1): (408, 408), ("b", 70000): (408, 816)}
    assert [tuple(r) for r in geojson.over_budget(rows, 1000).collect()] == [("a", 2)]
