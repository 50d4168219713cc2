"""Readers and sinks: what is written is read back."""

import json

import pytest
from pyspark.sql import functions as F

from geoloom.functions import geometry as geo
from geoloom.operators import export, registry, rules
from geoloom.sources import readers, writers


def test_geojson_round_trip(spark, tmp_path):
    square = {"type": "Polygon", "coordinates": [[[0, 0], [4, 0], [4, 4], [0, 4], [0, 0]]]}
    features = [{"type": "Feature", "id": "1", "properties": {"tags": {"name": "Moda"}}, "geometry": square}, {"type": "Feature", "properties": {"name": ""}, "geometry": {"type": "MultiPolygon", "coordinates": [square["coordinates"]]}}, {"type": "Feature", "properties": {"name": "p"}, "geometry": {"type": "Point", "coordinates": [1, 2]}}]
    (tmp_path / "d.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    rows = readers.read_neighbourhoods(spark, str(tmp_path / "d.geojson"), "Kadıköy")
    got = {r.neighbourhood_name: r.a for r in rows.select("neighbourhood_name", geo.area("rings").alias("a")).collect()}
    assert got == {"Moda": 16.0, "Kadıköy Mah. 1": 16.0}
    out = writers.write_geojson(rows.withColumn("x", F.lit(None).cast("double")).withColumn("y", F.lit(None).cast("double")), str(tmp_path / "out"))
    back = [json.loads(r[0]) for r in spark.read.text(out).collect()]
    assert {b["properties"]["neighbourhood_name"] for b in back} == set(got) and back[0]["geometry"]["coordinates"][0][0] == [0.0, 0.0]
    assert writers.write_geojson(rows.limit(0), str(tmp_path / "none")) == ""
    listed = readers.list_files(spark, str(tmp_path))
    assert [r.place for r in listed.collect()] == ["d"]
    assert [r.missing for r in readers.file_status(spark.createDataFrame([("d",), ("e",)], "district string"), listed).orderBy("district").collect()] == [False, True]


@pytest.mark.parametrize("head", ["", "Title,,\n"])
def test_loose_header(spark, tmp_path, head):
    (tmp_path / "t.csv").write_text(head + "Name,Latitude,Longitude\nA,41,29\nB,42,28\n")
    rows = readers.standard_columns(readers.read_loose_csv(spark, str(tmp_path / "t.csv")), ["name", "latitude", "longitude", "levels"])
    assert sorted(tuple(r) for r in rows.collect()) == [("A", "41", "29", None), ("B", "42", "28", None)]


def test_graph_versions(spark, tmp_path):
    nodes, edges = spark.createDataFrame([(1, 0.0, 0.0)], "id long, x double, y double"), spark.createDataFrame([(1, 1, 2.0, False)], "src long, dst long, length_m double, oneway boolean")
    for v in (1, 2):
        writers.write_graph(nodes, edges, str(tmp_path), "walk", v)
    assert writers.prune_graphs(spark, str(tmp_path), "walk", 2) == 1
    assert readers.read_graph(spark, str(tmp_path), "walk", 2)[0].count() == 1


def test_population_columns(spark):
    assert readers.population_columns(spark.createDataFrame([("a", "1"), ("b", "2")], "Mahalle string, total string")) == ("Mahalle", "total")


def test_export_view(spark):
    rows = spark.createDataFrame([("node", 1, {"building": "Apartments", "height": "12.5 m", "name": "x"})], "element string, id long, tags map<string,string>")
    got = export.export_view(rules.classify(rows, [registry.BY_CODE["building_apartments"]], registry.RULES), "building").first()
    assert (got.building, got.height, got.confidence, got.element) == ("Apartman", 12.5, "Yüksek", "Nokta")
    assert export.to_english(rows, {"element": "Kind", "id": "Kind"}, {}).columns == ["Kind", "Kind (2)", "tags"]
