import json

from pipeweave.operators import jobs


def test_job_from_file_to_report(spark, tmp_path):
    point = lambda i, kind, lon, lat, **p: {"type": "Feature", "geometry": {"type": "Point", "coordinates": [lon, lat]}, "properties": {"id": i, "object_type": kind, **p}}
    ring = [[37.6005, 55.7495], [37.6008, 55.7495], [37.6008, 55.7505], [37.6005, 55.7505], [37.6005, 55.7495]]
    doc = {"type": "FeatureCollection", "features": [
        point(1, "consumer", 37.601, 55.75, flow_tph=2.4), point(2, "consumer", 37.6012, 55.7502, flow_tph=3.1), point(3, "heat_chamber", 37.6, 55.75),
        {"type": "Feature", "geometry": {"type": "Polygon", "coordinates": [ring]}, "properties": {"id": 4, "object_type": "restriction", "restriction_type": "park"}}]}
    (tmp_path / "scene.geojson").write_text(json.dumps(doc))
    job = jobs.run(spark, str(tmp_path / "scene.geojson"))
    links = job.links.collect()
    assert len(links) == 10 and all(r.connected for r in links)
    # The park lies between the chamber and both consumers: no way is straight.
    straight = [r for r in links if r.strategy == "separate_lines"]
    assert all(r.vertices > 2 for r in straight) and all(r.du == 50 for r in straight)
    ranks = sorted(r["rank"] for r in job.variants.collect())
    assert ranks == list(range(1, len(ranks) + 1)) and len(ranks) <= 3
    jobs.write_report(job, str(tmp_path / "report"))
    assert next((tmp_path / "report").glob("part-*")).read_text().startswith("scene;rank;child")
