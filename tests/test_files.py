"""Readers and deliverables on written files."""

import io
import json
import sqlite3
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from parcelforge.sources import export, vector
from parcelforge.streaming.conflicts import merge_stream

SQUARE = [[[73.0, 18.0], [73.001, 18.0], [73.001, 18.001], [73.0, 18.001], [73.0, 18.0]]]


def test_detection():
    assert [vector.detect(n) for n in ("a.GeoJSON", "b.csv", "c.zip", "d.gpkg")] == ["geojson", "csv", "shapefile", "geopackage"]
    for bad in ("x.shp", "x.exe"):
        with pytest.raises(ValueError):
            vector.detect(bad)
    assert vector.coordinate_columns(["Name", "Longitude", "LAT"]) == ("Longitude", "LAT")
    assert vector.coordinate_columns(["site_lng", "site_latitude"]) == ("site_lng", "site_latitude")
    with pytest.raises(ValueError):
        vector.coordinate_columns(["a", "b"])
    assert vector.safe_name("../../etc/pass wd") == "pass_wd"
    assert vector.sanitize({"a": float("nan"), "b": [1, (2.5,)], "c": {1}}) == {"a": None, "b": [1, [2.5]], "c": "{1}"}


def test_geojson(spark, tmp_path):
    features = [{"type": "Feature", "geometry": {"type": "Polygon", "coordinates": SQUARE}, "properties": {"parcel_id": "P1", "area": 1.5, "tags": ["x"]}}, {"type": "Feature", "geometry": None, "properties": None}]
    (tmp_path / "a.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    got = vector.read(spark, str(tmp_path / "a.geojson")).collect()
    assert [(r.feature_id, r.kind, r.crs) for r in got] == [("P1", "POLYGON", "EPSG:4326"), ("feat_1", None, "EPSG:4326")]
    assert got[0].properties == {"parcel_id": "P1", "area": "1.5", "tags": '["x"]'} and got[0].wkt.startswith("POLYGON ((73.0 18.0")


def test_csv_points(spark, tmp_path):
    (tmp_path / "a.csv").write_text("asset_id,latitude,longitude,kind\nA1,18.5,73.8,pole\nA2,bad,73.8,\n,18.6,73.9,x\n")
    got = sorted(vector.require(vector.read(spark, str(tmp_path / "a.csv"))).collect(), key=lambda r: r.feature_id)
    assert [(r.feature_id, r.wkt) for r in got[:2]] == [("A1", "POINT (73.8 18.5)"), ("A2", None)]
    assert got[0].properties == {"asset_id": "A1", "kind": "pole"} and got[2].feature_id.startswith("feat_")
    (tmp_path / "b.csv").write_text("lat,lon\nx,y\n")
    with pytest.raises(ValueError):
        vector.require(vector.read(spark, str(tmp_path / "b.csv")))


def test_projected_points_become_geographic(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,x,y\n1,379313.0,2048166.0\n")
    got = vector.canonical(vector.read(spark, str(tmp_path / "a.csv"), "EPSG:32643")).first()
    x, y = map(float, got.wkt[7:-1].split())
    assert x == pytest.approx(73.857, abs=0.002) and y == pytest.approx(18.52, abs=0.003) and got.source_crs == "EPSG:32643"


def shapefile(names=("a.shp", "a.shx", "a.dbf")):
    ring = [(0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (1.0, 0.0), (0.0, 0.0)]
    body = struct.pack("<i4d2i1i", 5, 0, 0, 1, 1, 1, 5, 0) + b"".join(struct.pack("<2d", *p) for p in ring)
    shp = b"\0" * 100 + struct.pack(">2i", 1, len(body) // 2) + body
    field = b"id".ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([5, 0]) + b"\0" * 14
    dbf = struct.pack("<4BIHH20x", 3, 0, 0, 0, 1, 32 + 32 + 1, 6) + field + b"\r" + b" P7   "
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in zip(names, (shp, b"", dbf)):
            z.writestr(name, data)
    return out.getvalue()


def test_shapefile(spark, tmp_path):
    (tmp_path / "a.zip").write_bytes(shapefile())
    r = vector.read(spark, str(tmp_path / "a.zip")).first()
    assert (r.feature_id, r.kind, r.properties) == ("P7", "POLYGON", {"id": "P7"})
    for names in (("../a.shp", "a.shx", "a.dbf"), ("a.shp", "a.txt", "a.dbf")):
        with pytest.raises(ValueError):
            vector.parse_shapefile(shapefile(names))


def boxes(spark):
    return spark.createDataFrame([(1, "a", 0.0, 0.0, 1.0, 1.0, ["x", "y"]), (2, None, 1.0, 1.0, 2.0, 2.0, None)], "id int, land string, x1 double, y1 double, x2 double, y2 double, roles array<string>")


def test_geojson_deliverable(spark, tmp_path):
    df = boxes(spark).withColumn("geometry", export.box_geometry())
    made = export.single(df, str(tmp_path / "out.geojson"), ["id", "land", "roles"], {"project": "p"})
    doc = json.loads((tmp_path / "out.geojson").read_text())
    assert made["features"] == 2 == len(doc["features"]) and doc["metadata"] == {"project": "p"}
    assert doc["features"][1]["properties"] == {"id": 2, "land": None, "roles": None}
    assert made["sha256"] == export.file_sha256(str(tmp_path / "out.geojson")) == json.loads((tmp_path / "out.geojson.manifest.json").read_text())["sha256"]
    export.write_geojson(df, str(tmp_path / "parts"), ["id"])
    assert sorted(json.loads(r.value)["properties"]["id"] for r in spark.read.text(str(tmp_path / "parts")).collect()) == [1, 2]
    assert json.loads(export.collection(['{"a":1}'], {}))["features"] == [{"a": 1}]


def test_csv_deliverable(spark, tmp_path):
    export.write_csv(boxes(spark), str(tmp_path / "csv"))
    got = {r.id: r for r in spark.read.option("header", True).csv(str(tmp_path / "csv")).collect()}
    assert got["1"].roles == "x;y" and got["2"].roles is None


def test_geopackage_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("P1", "POLYGON ((0 0, 1 0, 1 1, 0 0))"), ("P2", None)], "parcel_id string, wkt string")
    assert export.write_geopackage(df, str(tmp_path / "a.gpkg"), "parcels", ["parcel_id"]) == 2
    assert sqlite3.connect(tmp_path / "a.gpkg").execute("select count(*) from parcels").fetchone() == (2,)
    got = {r.properties["parcel_id"]: r for r in vector.read(spark, str(tmp_path / "a.gpkg")).collect()}
    assert got["P1"].wkt == "POLYGON ((0.0 0.0, 1.0 0.0, 1.0 1.0, 0.0 0.0))" and got["P2"].wkt is None
    with pytest.raises(ValueError):
        vector.parse_geopackage(b"no")


def test_upload_store(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"abc")
    r = vector.stored(spark, str(tmp_path / "a.bin")).first()
    assert r.bytes == 3 and r.sha256 == export.file_sha256(str(tmp_path / "a.bin"))


def test_streamed_conflicts(spark, tmp_path):
    schema = "idempotency_key string, severity string, status string"
    for n, rows in enumerate(([("a", "LOW", "OPEN"), ("b", "LOW", "OPEN")], [("a", "HIGH", "OPEN")])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        found = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        merge_stream(found, str(tmp_path / "store"), str(tmp_path / "check")).awaitTermination()
        assert n in (0, 1)
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "store/1")).select(F.col("idempotency_key"), "severity").collect()}
    assert got == {("a", "HIGH"), ("b", "LOW")}
