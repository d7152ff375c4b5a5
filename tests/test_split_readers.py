"""Files read by many tasks give what one task gives."""

import io
import json
import random
import sqlite3
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from parcelforge.functions import crs, poly
from parcelforge.sources import binary, export, geojson, vector

NASTY = ['a"b', "x}y{", '["\\]', "\\", "é{{", '{"type":"Feature"}', '"crs": {', "plain", ""]


def feature(draw, k):
    t = draw.choice(NASTY)
    shapes = [None, {"type": "Point", "coordinates": [73 + k / 8, 18]}, {"type": "Polygon", "coordinates": [[[73.0, 18.0], [73.5, 18.0], [73.5, 18.5, 5], [73.0, 18.0]]]}]
    return {"type": "Feature", "id": k if k % 3 else None, "geometry": draw.choice(shapes), "properties": {"t": t, "n": k, "nan": float("nan") if k % 5 == 0 else 1.5, "o": {"a": [{"b": t}]}, "z": None, "yes": True}}


@pytest.fixture
def splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield lambda size: spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("indent", [None, 1])
def test_geojson_by_splits(spark, tmp_path, splits, indent):
    draw = random.Random(3)
    features = [feature(draw, k) for k in range(120)]
    doc = {"note": {"x": "}"}, "m": {"k": {"z": []}}, "type": "FeatureCollection", "crs": {"type": "name", "properties": {"name": "urn:ogc:def:crs:EPSG::3857"}}, "features": features, "after": [{"k": 1}]}
    (tmp_path / "a.geojson").write_text(json.dumps(doc, indent=indent))
    (tmp_path / "b.geojson").write_text(json.dumps(features[2]))
    (tmp_path / "c.geojson").write_text('{"type": "FeatureCollection", "features": []}\n')
    for size in ("300", "2000", "100m"):
        splits(size)
        rows = geojson.read(spark, str(tmp_path)).collect()
        a = sorted((r for r in rows if r.file.endswith("a.geojson")), key=lambda r: r.number)
        assert [r.number for r in a] == list(range(120))
        assert {r.crs for r in a} == {"urn:ogc:def:crs:EPSG::3857"}
        for r, f in zip(a, features):
            assert r.id == (None if f["id"] is None else str(f["id"]))
            p = f["properties"]
            assert {k: v for k, v in r.properties.items() if k != "o"} == {"t": p["t"], "n": str(p["n"]), "nan": None if p["n"] % 5 == 0 else "1.5", "z": None, "yes": "true"}
            assert json.loads(r.properties["o"]) == p["o"]
            assert (r.wkt is None) == (f["geometry"] is None)
            if r.wkt:
                assert poly.from_wkt(r.wkt)[1] == [[x[:2] for x in ring] for ring in f["geometry"]["coordinates"]] if r.kind == "POLYGON" else poly.from_wkt(r.wkt)[1] == f["geometry"]["coordinates"]
        assert [(r.number, r.crs) for r in rows if r.file.endswith("b.geojson")] == [(0, None)]
        assert len(rows) == 121
    assert geojson.records(spark, str(tmp_path / "a.geojson")).count() > 100


def test_geojson_of_one_task_is_split(spark, tmp_path, splits):
    features = [{"type": "Feature", "geometry": None, "properties": {"k": k, "pad": "x" * 200}} for k in range(500)]
    (tmp_path / "a.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    splits("10000")
    df = vector.read(spark, str(tmp_path / "a.geojson"))
    assert geojson.records(spark, str(tmp_path / "a.geojson")).select(F.spark_partition_id()).distinct().count() > 8
    assert sorted(int(r.properties["k"]) for r in df.collect()) == list(range(500))
    assert {r.feature_id for r in df.collect()} == {f"feat_{k}" for k in range(500)}


def test_geojson_is_cut_twice_only_where_features_cross_splits(spark, tmp_path):
    features = [{"type": "Feature", "geometry": None, "properties": {"k": k, "pad": "x" * 200}} for k in range(60)]
    for name in "abc":
        (tmp_path / f"{name}.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    crossing = lambda: [r.crosses for r in geojson.states(geojson.summaries(geojson.records(spark, str(tmp_path)))).collect()]
    assert crossing() == [False] * 3
    # A feature that no split ends is still met, and refused.
    (tmp_path / "d.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": features})[:-20])
    assert sorted(crossing()) == [False] * 3 + [True]
    with pytest.raises(Exception, match="MALFORMED|parse"):
        geojson.read(spark, str(tmp_path)).collect()


def test_geojson_texts_are_parsed_once(spark, tmp_path):
    (tmp_path / "a.geojson").write_text(json.dumps(feature(random.Random(1), 1)))
    plan = geojson.read(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "from_json" in plan and not any("Filter" in row and "from_json" in row for row in plan.split("\n"))
    # Nor are coordinates' brackets made in several places of one row.
    assert max(row.count("regexp_replace") for row in plan.split("\n")) == 2


def test_white_space_of_coordinates_means_nothing(spark, tmp_path):
    texts = ["[ [\n[ 0 ,0], [1 , 0.5,7 ],\t[1,1], [0,0]\n] ]", "[[[0,0],[1,0.5],[1,1],[0,0]]]", "[ ]"]
    got = '{"type": "FeatureCollection", "features": [%s]}' % ", ".join('{"type": "Feature", "properties": {}, "geometry": {"type": "Polygon", "coordinates": %s}}' % t for t in texts)
    (tmp_path / "a.geojson").write_text(got)
    assert [r.wkt for r in geojson.read(spark, str(tmp_path)).orderBy("number").collect()] == ["POLYGON ((0 0, 1 0.5, 1 1, 0 0))"] * 2 + ["POLYGON EMPTY"]


def test_last_place_before_a_run():
    import numpy as np

    draw = np.random.default_rng(1)
    for n, share in ((0, 0.5), (50, 0.5), (500, 0.97), (3000, 0.999)):
        mask = draw.random(n) < share
        at = np.flatnonzero(draw.random(n) < 0.5)
        assert geojson.last_other(mask, at).tolist() == [max((k for k in range(a) if not mask[k]), default=-1) for a in at.tolist()]


def test_malformed_geojson_fails(spark, tmp_path):
    (tmp_path / "a.geojson").write_text('{"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"a": tru}}]}')
    with pytest.raises(Exception, match="MALFORMED|parse"):
        vector.read(spark, str(tmp_path / "a.geojson")).collect()


def archive(n, compress, index=True):
    shp, shx = io.BytesIO(), io.BytesIO()
    shp.write(b"\0" * 100)
    shx.write(b"\0" * 100)
    for k in range(n):
        if k % 4 == 0:
            body = struct.pack("<i2d", 1, float(k), 1.5)
        elif k % 4 == 3:
            body = struct.pack("<i", 0)
        else:
            shell = [(0, 0), (0, 9), (9, 9), (9, 0), (0, 0)]
            hole = [(1, 1), (2, 1), (2, 2), (1, 1)]
            points = [(x + k, y) for x, y in shell + hole]
            body = struct.pack("<i4d2i2i", 5, 0, 0, 1, 1, 2, 9, 0, 5) + b"".join(struct.pack("<2d", *p) for p in points)
        shx.write(struct.pack(">2i", shp.tell() // 2, len(body) // 2))
        shp.write(struct.pack(">2i", k + 1, len(body) // 2) + body)
    fields = b"".join(name.ljust(11, b"\0") + kind + b"\0" * 4 + bytes([size, 0]) + b"\0" * 14 for name, kind, size in ((b"code", b"C", 8), (b"area", b"N", 6)))
    dbf = struct.pack("<4BIHH20x", 3, 0, 0, 0, n, 32 + 64 + 1, 15) + fields + b"\r" + b"".join(b" " + (b"" if k % 5 == 0 else f"C{k}".encode()).ljust(8) + str(k).encode().rjust(6) for k in range(n))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", compress) as z:
        for name, data in (("p.shp", shp.getvalue()), ("p.shx", shx.getvalue() if index else b""), ("p.dbf", dbf), ("p.prj", b'PROJCS["WGS 84 / UTM zone 43N"]'.replace(b"zone", b"Zone"))):
            z.writestr(name, data)
    return out.getvalue()


@pytest.mark.parametrize(("compress", "index"), [(zipfile.ZIP_STORED, True), (zipfile.ZIP_DEFLATED, True), (zipfile.ZIP_DEFLATED, False)])
def test_shapefile_by_records(spark, tmp_path, compress, index):
    data = archive(203, compress, index)
    (tmp_path / "a.zip").write_bytes(data)
    df = vector.read(spark, str(tmp_path / "a.zip"), rows_per_task=50)
    assert df.select(F.spark_partition_id()).distinct().count() == 5
    rows = {r.properties["area"]: r for r in df.collect()}
    assert len(rows) == 203
    assert sorted(str(r | {"properties": sorted(r["properties"])}) for r in vector.parse_shapefile(data)) == sorted(str(r.asDict() | {"properties": sorted(r.properties.items())}) for r in rows.values())
    for k in range(203):
        r = rows[str(k)]
        assert r.feature_id == (f"feat_{k}" if k % 5 == 0 else f"C{k}") and r.crs == "EPSG:32643"
        assert r.kind == {0: "POINT", 3: None}.get(k % 4, "POLYGON")
        if r.kind == "POINT":
            assert r.wkt == f"POINT ({float(k)} 1.5)"
        elif r.kind:
            assert len(poly.from_wkt(r.wkt)[1]) == 2 and poly.from_wkt(r.wkt)[1][0][0] == [float(k), 0.0]
    few = vector.read(spark, str(tmp_path / "a.zip"), columns=["area"], rows_per_task=50).collect()
    assert all(list(r.properties) == ["area"] for r in few) and {r.feature_id for r in few} == {r.feature_id for r in rows.values()}


def test_geopackage_by_row_ids(spark, tmp_path):
    df = spark.createDataFrame([(f"P{k}", k, f"POINT ({k} 1)") for k in range(100)], "parcel_id string, n int, wkt string")
    path = str(tmp_path / "a.gpkg")
    export.write_geopackage(df, path, "parcels", ["parcel_id", "n"])
    db = sqlite3.connect(path)
    db.execute("delete from parcels where n % 7 = 0")
    db.execute("update parcels set fid = fid * 1000, parcel_id = null where n > 50")
    db.execute("create table more (fid integer primary key, geom blob, n int)")
    db.execute("insert into gpkg_geometry_columns values ('more', 'geom', 'GEOMETRY', 3857, 0, 0)")
    db.execute("insert into more values (5, null, 1000)")
    db.commit()
    db.close()
    got = vector.read(spark, path, rows_per_task=10)
    assert got.select(F.spark_partition_id()).distinct().count() > 8
    rows = got.collect()
    with open(path, "rb") as f:
        assert sorted(str(r | {"properties": sorted(r["properties"])}) for r in vector.parse_geopackage(f.read())) == sorted(str(r.asDict() | {"properties": sorted(r.properties.items())}) for r in rows)
    assert sorted(int(r.properties["n"]) for r in rows) == sorted([*(k for k in range(100) if k % 7), 1000])
    assert {r.crs for r in rows} == {"EPSG:4326", "EPSG:3857"}
    assert all("parcel_id" not in r.properties for r in vector.read(spark, path, columns=["n"]).collect())


def test_stores_without_a_file_system_are_read_whole(spark, tmp_path):
    (tmp_path / "a.zip").write_bytes(archive(9, zipfile.ZIP_DEFLATED))
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.own.link./in", f"file://{tmp_path}")
    assert vector.read(spark, "viewfs://own/in/a.zip").count() == 9
    assert binary.scheme("viewfs://own/in/a.zip") not in binary.STORES


def test_names_of_systems(spark):
    names = [None, "", " wgs 84", "EPSG:4326", "epsg::32643", "urn:ogc:def:crs:EPSG::3857", "urn:ogc:def:crs:OGC:1.3:CRS84", "EPSG:1", "x", "99999999999", "32760", "32761"]
    df = spark.createDataFrame([(n,) for n in names], "n string").select("n", crs.normalized(F.col("n")).alias("got"))
    assert all(r.got == crs.normalize(r.n) for r in df.collect())


def test_texts_are_moved_at_once(spark):
    rows = [("POLYGON ((0 0, 1000 0, 1000 1000, 0 0), (1 1, 2 1, 2 2, 1 1))", "EPSG:3857"), ("POINT (500000 0 7)", "EPSG:32643"), ("LINESTRING EMPTY", "EPSG:3857"), (None, "EPSG:3857"), ("POINT (1 2)", "EPSG:4326")]
    got = vector.canonical(spark.createDataFrame(rows, "wkt string, crs string")).collect()
    assert got[0].wkt.startswith("POLYGON ((0.0 0.0, 0.008983153 0.0, ") and got[0].wkt.count(",") == 7
    assert got[1].wkt == "POINT (75.0 0.0)"
    assert [r.wkt for r in got[2:]] == ["LINESTRING EMPTY", None, "POINT (1 2)"]
