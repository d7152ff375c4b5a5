"""GeoJSON and CSV of records, datasets and analyses."""

import json

import pytest
from pyspark.sql import functions as F

from parcelforge.sources import features, ingest, vector
from parcelforge.store import Store


def test_geometries(spark):
    shapes = ["POINT (1.5 -2)", "LINESTRING (0 0, 1 1)", "POLYGON ((0 0, 1 0, 1 1.0E-7, 0 0), (0.1 0.1, 0.2 0.1, 0.2 0.2, 0.1 0.1))", "MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)), ((5 5, 6 5, 6 6, 5 5)))", "POLYGON EMPTY", None, "POINT (1 2 3)"]
    got = [r.g and json.loads(r.g) for r in spark.createDataFrame([(s,) for s in shapes], "w string").select(features.geometry("w").alias("g")).collect()]
    assert got[0] == {"type": "Point", "coordinates": [1.5, -2]} and got[1] == {"type": "LineString", "coordinates": [[0, 0], [1, 1]]}
    assert got[2]["coordinates"][0][2] == [1, 1e-7] and len(got[2]["coordinates"]) == 2
    assert got[3]["coordinates"][1][0][0] == [5, 5]
    assert got[4] is None and got[5] is None and got[6]["coordinates"] == [1, 2]


def inputs(spark):
    rows = spark.createDataFrame([("r1", "ACTIVE", 10.0, "CADASTRAL", "farm", "POINT (1 2)", "UNIFIED"), ("r\"2", None, None, None, None, None, "UNIFIED"), ("r3", "CONFLICT", None, None, None, None, "REJECTED")], "record_id string, status string, area double, geometry_source string, land_use string, wkt string, resolution_status string")
    sources = spark.createDataFrame([("r1", "DRONE", "Survey", "S1", 2), ("r1", "CADASTRAL", "Wards", "P1", 1), ("r1", "DRONE", None, "S2", 3)], "record_id string, role string, dataset string, identifier string, at int")
    conflicts = spark.createDataFrame([("r1", "UNRESOLVED"), ("r1", "RESOLVED"), ('r"2', "DISMISSED")], "record_id string, status string")
    return rows, sources, conflicts


def test_records(spark):
    got = {r.record_id: json.loads(r.feature) for r in features.records(*inputs(spark)).collect()}
    assert got["r1"]["id"] == "r1" and got["r1"]["geometry"] == {"type": "Point", "coordinates": [1, 2]}
    p = got["r1"]["properties"]
    assert (p["source_count"], p["source_roles"], p["source_datasets"], p["source_feature_identifiers"]) == (3, ["CADASTRAL", "DRONE"], ["Wards", "Survey"], ["P1", "S1", "S2"])
    assert (p["conflict_count"], p["unresolved_conflict_count"], p["resolved_conflict_count"], p["conflict_status"]) == (2, 1, 1, "UNRESOLVED_CONFLICTS")
    q = got['r"2']
    assert q["geometry"] is None and q["properties"]["conflict_status"] == "RESOLVED" and q["properties"]["source_count"] == 0 and q["properties"]["land_use"] is None
    assert got["r3"]["properties"]["conflict_status"] == "NO_CONFLICTS"
    assert [r.record_id for r in features.records(*inputs(spark), record_id="r1").collect()] == ["r1"]


def test_dataset_features_round_trip(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    shapes = [{"type": "Point", "coordinates": [111319.4907932736, 0.0]}, None]
    doc = {"type": "FeatureCollection", "crs": {"type": "name", "properties": {"name": "EPSG:3857"}}, "features": [{"type": "Feature", "geometry": g, "properties": {"id": f"P{k}", "_dataset_id": "x"}} for k, g in enumerate(shapes)]}
    (tmp_path / "a.geojson").write_text(json.dumps(doc))
    made = ingest.ingest(store, str(tmp_path / "a.geojson"), project="p", name="A")
    rows = ingest.layer(store, made["dataset_id"])
    got = {f["properties"]["id"]: f for f in (json.loads(r.feature) for r in features.of_dataset(rows, made["dataset_id"], "A").collect())}
    assert got["P0"]["geometry"] == {"type": "Point", "coordinates": [1.0, 0.0]} and got["P1"]["geometry"] is None
    assert got["P0"]["properties"] == {"id": "P0", "_source_feature_id": "P0", "_geometry_type": "POINT", "_source_crs": "EPSG:3857", "_target_crs": "EPSG:4326", "_dataset_name": "A", "_dataset_id": made["dataset_id"]}
    source = json.loads(features.of_dataset(store.read("source_features"), "d", "A", "source", 1).first().feature)
    assert source["geometry"]["coordinates"] == [111319.4907932736, 0.0] and "_target_crs" not in source["properties"]
    with pytest.raises(ValueError):
        features.of_dataset(rows, "d", "A", "other")
    # Written as several documents and read again, by the split reader.
    layers = features.combined({"a": features.of_dataset(rows, "d", "A"), "b": features.of_dataset(rows, "d", "B")})
    documents = features.collections(layers.withColumn("k", F.monotonically_increasing_id()), "k", {"n": 1}, "EPSG:4326", size=1)
    features.write_documents(documents, str(tmp_path / "out.geojson"))
    again = vector.read(spark, str(tmp_path / "out.geojson")).collect()
    assert sorted(str((r.feature_id, r.wkt)) for r in again) == ["('P0', 'POINT (1.0 0.0)')"] * 2 + ["('P1', None)"] * 2


def test_analysis_csv(spark):
    found = spark.createDataFrame([({"feature_id": "7", "title": "Pole", "_role": "target", "distance_meters": "12.5", "kind": "x"}, "POINT (73.1 18.2)"), ({"id": "8"}, "POLYGON ((0 0, 1 0, 1 1, 0 0))"), ({}, None)], "properties map<string,string>, wkt string")
    a, b, c = features.analysis_rows(found).collect()
    assert tuple(a)[:10] == ("7", "Pole", "", "target", "12.5", "", "", "Point", "18.2", "73.1") and json.loads(a.properties) == {"feature_id": "7", "title": "Pole", "distance_meters": "12.5", "kind": "x"}
    assert (b.feature_id, b.geometry_type, b.latitude) == ("8", "Polygon", "") and c.geometry_type == "Unknown"


def test_final_stage(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    rows, sources, conflicts = inputs(spark)
    one = spark.range(1)
    for unified, provenance in ((rows.where("record_id = 'r3'"), one), (rows, one.limit(0))):
        with pytest.raises(ValueError), store.run() as run:
            features.final_stage(run, "e0", "p", unified, provenance, sources, conflicts)
    assert store.tables() == []
    for e in ("e1", "e2"):
        with store.run() as run:
            made = features.final_stage(run, e, "p", rows, one, sources, conflicts, str(tmp_path / f"{e}.geojson"))
    docs = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "e1.geojson")).collect()]
    assert len(docs) == 1 and {f["id"] for f in docs[0]["features"]} == {"r1", 'r"2'} and docs[0]["metadata"]["export_id"] == "e1"
    assert made["features"] == 2
    stage = store.read("stage_runs").collect()
    assert len(stage) == 1 and json.loads(stage[0].results)["export_id"] == "e2" and json.loads(stage[0].results)["quarantined_records_count"] == 1
    assert [r.export_id for r in features.jobs(store.read("export_jobs"), "p").collect()] == ["e2", "e1"]
    assert features.jobs(store.read("export_jobs"), "p", "e1").first().bytes == len(spark.read.text(str(tmp_path / "e1.geojson")).first().value)


def test_colors_go_round(spark):
    df = spark.createDataFrame([("p", f"d{k}", f"n{k}") for k in range(7)], "project_id string, dataset_id string, name string")
    got = [r.color for r in features.layer_colors(df, ("a", "b", "c")).orderBy("name").collect()]
    assert got == ["a", "b", "c", "a", "b", "c", "a"]
