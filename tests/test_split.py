"""Files cut into many tasks give the features of the file read whole."""

import json
import random

import pytest

from pipeweave.sources import geojson, split


@pytest.fixture
def small_splits(spark):
    names = {"spark.sql.files.maxPartitionBytes": "4000", "spark.sql.files.openCostInBytes": "0"}
    old = {n: spark.conf.get(n) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    yield
    for n, v in old.items():
        spark.conf.set(n, v)


def got(df):
    return sorted((r["file"].rsplit("/", 1)[1], r["index"], r["feature"]) for r in df.select("file", "index", "feature").collect() if r)


def key(rows):
    return sorted(rows, key=repr)


def feature(rng, k):
    text = rng.choice(["plain", 'quo"te', "brace } { ] [", "back\\", '\\"}', "ünï ❄ }", "", "line\nend", '"}]},{"type":"Feature"'])
    kinds = [{"type": "Point", "coordinates": [37 + k / 1000, 55]}, {"type": "Polygon", "coordinates": [[[1, 2], [3, 4], [5, 6], [1, 2]]]}, None]
    return {"type": "Feature", "properties": {"id": k, "name": text, "features": [{"a": text}, {}], "deep": {"x": [{"y": [{}]}]}}, "geometry": rng.choice(kinds)}


DOCS = {
    "tail.json": lambda f: {"type": "FeatureCollection", "features": f, "name": "x", "crs": {"type": "name", "properties": {"name": "}"}}},
    "head.json": lambda f: {"name": 'a"}]', "bbox": [1, 2], "crs": {"properties": {"features": [{}]}}, "features": f},
    "others.json": lambda f: {"before": [{"type": "no"}, {"type": "no"}], "features": f, "after": [{"type": "no"}, 5], "last": {"features": [{"type": "no"}]}},
    "junk.json": lambda f: {"features": [7, *f[:20], "s}", None, [1, {"a": 2}], *f[20:40], 5, []]},
}


def test_same_rows_as_the_whole_text(spark, small_splits, tmp_path):
    rng = random.Random(5)
    for name, made in DOCS.items():
        features = [feature(rng, k) for k in range(120)]
        style = {"tail.json": {"indent": 2}, "head.json": {"separators": (",", ":")}}.get(name, {})
        (tmp_path / name).write_text(json.dumps(made(features), ensure_ascii=name != "others.json", **style) + ("\n\n" if name == "tail.json" else ""), encoding="utf-8")
    assert split.pieces(spark, str(tmp_path)).rdd.getNumPartitions() > 15
    cut, whole = got(split.read(spark, str(tmp_path))), got(geojson.read(spark, str(tmp_path)))
    assert key(cut) == key(whole) and len({n for n, _, _ in cut}) == 4
    assert len([1 for n, _, f in cut if n == "junk.json" and f is None]) == 6


def test_files_without_features(spark, small_splits, tmp_path):
    for name, text in {"empty": "", "blank": " \n", "array": "[1, 2]", "object": '{"a": {"b": [1]}}', "none": '{"features": []}', "null": '{"features": null}', "word": "no json"}.items():
        (tmp_path / f"{name}.json").write_text(text)
    assert got(split.read(spark, str(tmp_path))) == []
    assert split.document_issues(spark, str(tmp_path)).count() == 6


def test_a_file_that_breaks_off_gives_what_it_holds(spark, small_splits, tmp_path):
    (tmp_path / "cut.json").write_text('{"features":[{"type":"Feature","k":1},{"type":"Feature","k":{"x":2}},{"type":"Fea')
    (tmp_path / "good.json").write_text('{"features":[{"k":1}], "type":"FeatureCollection"}')
    (tmp_path / "short.json").write_text('{"type":"FeatureCollection", "features":[{"k":1}')
    assert sorted(r["file"].rsplit("/", 1)[1] for r in split.document_issues(spark, str(tmp_path)).collect()) == ["cut.json", "short.json"]
    (tmp_path / "good.json").unlink(), (tmp_path / "short.json").unlink()
    assert [(i, json.loads(f)["k"]) for _, i, f in got(split.read(spark, str(tmp_path)))] == [(0, 1), (1, {"x": 2})]
