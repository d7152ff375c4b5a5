"""Deliverables: GeoJSON, CSV and GeoPackage with checksum and manifest.

GeoJSON and CSV are written by Spark; :func:`single` joins their parts to the one file that a user takes away.
"""

from __future__ import annotations

import hashlib
import json
import sqlite3
import struct
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelforge.functions import poly


def feature(properties: list[str], geometry: str = "geometry") -> Column:
    """A GeoJSON feature as text; ``geometry`` holds GeoJSON."""
    props = F.to_json(F.struct(*properties), {"ignoreNullFields": "false"})
    return F.concat(F.lit('{"type":"Feature","geometry":'), F.coalesce(F.col(geometry), F.lit("null")), F.lit(',"properties":'), props, F.lit("}"))


def box_geometry(x1: str = "x1", y1: str = "y1", x2: str = "x2", y2: str = "y2") -> Column:
    at = lambda x, y: F.concat(F.lit("["), F.col(x).cast("string"), F.lit(","), F.col(y).cast("string"), F.lit("]"))
    ring = F.concat_ws(",", at(x1, y1), at(x2, y1), at(x2, y2), at(x1, y2), at(x1, y1))
    return F.concat(F.lit('{"type":"Polygon","coordinates":[['), ring, F.lit("]]}"))


def write_geojson(df: DataFrame, path: str, properties: list[str], geometry: str = "geometry") -> None:
    """A feature per line; each part is a GeoJSON text sequence."""
    df.select(feature(properties, geometry).alias("value")).write.mode("overwrite").text(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Lists joined by semicolons, nulls empty."""
    flat = [F.coalesce(F.concat_ws(";", f.name) if f.dataType.typeName() == "array" else F.col(f.name).cast("string"), F.lit("")).alias(f.name) for f in df.schema.fields]
    df.select(*flat).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def collection(lines: Iterable[str], metadata: dict) -> str:
    """One FeatureCollection of features as text."""
    return '{"type":"FeatureCollection","metadata":' + json.dumps(metadata) + ',"features":[' + ",".join(lines) + "]}"


def single(df: DataFrame, target: str, properties: list[str], metadata: dict, geometry: str = "geometry") -> dict:
    """Writes one GeoJSON file on the driver, a row at a time, and its manifest; for deliverables of a user's size."""
    digest, n = hashlib.sha256(), 0
    with open(target, "wb") as out:

        def put(text: str) -> None:
            out.write(text.encode())
            digest.update(text.encode())

        put('{"type":"FeatureCollection","metadata":' + json.dumps(metadata) + ',"features":[')
        for row in df.select(feature(properties, geometry).alias("f")).toLocalIterator():
            put(("," if n else "") + row.f)
            n += 1
        put("]}")
    manifest = {"file": target.rpartition("/")[2], "format": "GEOJSON", "features": n, "sha256": digest.hexdigest()} | metadata
    with open(f"{target}.manifest.json", "w") as out:
        json.dump(manifest, out)
    return manifest


def write_geopackage(df: DataFrame, target: str, layer: str, properties: list[str], wkt: str = "wkt") -> int:
    """Writes one layer on the driver, a row at a time."""
    db = sqlite3.connect(target)
    db.executescript(
        """
        pragma application_id = 0x47504B47;
        create table gpkg_spatial_ref_sys (srs_name text, srs_id integer primary key, organization text, organization_coordsys_id integer, definition text, description text);
        insert into gpkg_spatial_ref_sys values ('WGS 84', 4326, 'EPSG', 4326, 'GEOGCS["WGS 84"]', null);
        create table gpkg_contents (table_name text primary key, data_type text, identifier text, srs_id integer);
        create table gpkg_geometry_columns (table_name text, column_name text, geometry_type_name text, srs_id integer, z integer, m integer);
        """
    )
    db.execute("insert into gpkg_contents values (?, 'features', ?, 4326)", (layer, layer))
    db.execute("insert into gpkg_geometry_columns values (?, 'geom', 'GEOMETRY', 4326, 0, 0)", (layer,))
    db.execute(f'create table "{layer}" (fid integer primary key, geom blob, ' + ", ".join(f'"{p}"' for p in properties) + ")")
    n = 0
    for row in df.select(wkt, *properties).toLocalIterator():
        blob = None if row[0] is None else b"GP" + struct.pack("<BBi", 0, 1, 4326) + poly.to_wkb(*poly.from_wkt(row[0]))
        db.execute(f'insert into "{layer}" values (null, ?' + ", ?" * len(properties) + ")", (blob, *row[1:]))
        n += 1
    db.commit()
    db.close()
    return n


def file_sha256(path: str) -> str:
    digest = hashlib.sha256()
    with open(path, "rb") as f:
        for chunk in iter(lambda: f.read(1 << 20), b""):
            digest.update(chunk)
    return digest.hexdigest()
