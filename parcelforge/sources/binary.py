"""Zipped shapefiles and GeoPackages as Spark data sources, a file read by many tasks.

A shapefile's index (.shx) has the place of each record, so a task reads a range of records and no more; of a
compressed archive it has to unpack what comes before, but parses only its own.  A GeoPackage is cut by row ids; a
task opens its local copy where the store is remote, one for each file and process.  Of the properties only those
asked for are read.  Files are opened by pyarrow's file systems (local, hdfs, s3, gs); of other stores Spark reads a
file whole, as one row, and one task parses it.
"""

from __future__ import annotations

import hashlib
import io
import json
import os
import re
import sqlite3
import struct
import tempfile
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from parcelforge.functions import poly
from parcelforge.functions.crs import normalize

SCHEMA = "feature_id string, kind string, wkt string, properties map<string,string>, crs string"
#: Properties that name a feature, in the order they are tried.
IDS = ("id", "fid", "parcel_id", "structure_id", "asset_id", "facility_id", "code")
STORES = ("", "file", "hdfs", "s3", "s3a", "gs")
_ARROW = pa.schema([("feature_id", pa.string()), ("kind", pa.string()), ("wkt", pa.string()), ("properties", pa.map_(pa.string(), pa.string())), ("crs", pa.string())])
BATCH = 4096


@dataclass
class Range(InputPartition):
    """Rows ``first`` to ``last`` of a layer: record numbers, or row ids of which ``ahead`` come before."""

    path: str
    layer: str
    first: int
    last: int
    ahead: int

    def __init__(self, path: str, layer: str, first: int, last: int, ahead: int) -> None:
        self.path, self.layer, self.first, self.last, self.ahead = path, layer, first, last, ahead


def scheme(path: str) -> str:
    m = re.match(r"([A-Za-z][A-Za-z0-9+.-]*):", path)
    return m[1].lower() if m else ""


def store(path: str) -> tuple[pafs.FileSystem, str]:
    kind = scheme(path)
    if kind in ("", "file"):
        return pafs.LocalFileSystem(), re.sub(r"^file:/*", "/", path)
    return pafs.FileSystem.from_uri(re.sub(r"^s3a:", "s3:", path))


def files(path: str, end: str) -> list[str]:
    """The file, or those of a folder that end so."""
    fs, at = store(path)
    if fs.get_file_info(at).type != pafs.FileType.Directory:
        return [path]
    head = path[: len(path) - len(at)] if path.endswith(at) else ""
    return sorted(head + x.path for x in fs.get_file_info(pafs.FileSelector(at)) if x.path.lower().endswith(end))


def as_text(v) -> str | None:
    if v is None or isinstance(v, str) or isinstance(v, float) and (v != v or abs(v) == float("inf")):
        return v if isinstance(v, str) else None
    return json.dumps(v) if isinstance(v, (bool, int, float)) else v.hex() if isinstance(v, bytes) else str(v)


def batches(rows: Iterator[tuple[int, tuple | None, dict, dict, str]]) -> Iterator[pa.RecordBatch]:
    """rows: number, (kind, coordinates), properties for the id, properties to give, crs."""
    held: list[tuple] = []
    for n, shape, named, props, crs in rows:
        own = next((named[k] for k in IDS if named.get(k) not in (None, "")), None)
        held.append((str(own) if own is not None else f"feat_{n}", shape and shape[0], shape and poly.to_wkt(*shape), [(k, as_text(v)) for k, v in props.items()], crs))
        if len(held) == BATCH:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held), _ARROW)], schema=_ARROW)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held), _ARROW)], schema=_ARROW)


# ------------------------------------------------------------------ shapefiles


def members(z: zipfile.ZipFile) -> dict[str, zipfile.ZipInfo]:
    names = z.namelist()
    if any(n.startswith("/") or ".." in n.split("/") for n in names):
        raise ValueError("a path in the archive leaves it")
    by = {n.lower().rpartition(".")[2]: z.getinfo(n) for n in names}
    if not {"shp", "shx", "dbf"} <= set(by):
        raise ValueError("the archive lacks .shp, .shx or .dbf")
    return by


def part_of(z: zipfile.ZipFile, info: zipfile.ZipInfo, first: int, size: int) -> bytes:
    with z.open(info) as f:
        f.seek(first)
        return f.read(size)


def system_of(prj: str) -> str:
    zone = re.search(r"UTM[ _]Zone[ _](\d+)([NS])", prj, re.I)
    return f"EPSG:{(32600 if zone[2].upper() == 'N' else 32700) + int(zone[1])}" if zone else "EPSG:3857" if "Pseudo" in prj else "EPSG:4326"


def shape_of(body: bytes) -> tuple[str, list] | None:
    """A record's geometry without its M and Z values; shells run clockwise, holes the other way and follow theirs."""
    kind = struct.unpack_from("<i", body)[0] % 10 if len(body) >= 4 else 0
    if kind == 1:
        return "POINT", list(struct.unpack_from("<2d", body, 4))
    if kind not in (3, 5):
        return None
    n_parts, n = struct.unpack_from("<2i", body, 36)
    starts = np.r_[np.frombuffer(body, "<i4", n_parts, 44), n]
    points = np.frombuffer(body, "<f8", 2 * n, 44 + 4 * n_parts).reshape(-1, 2)
    parts = [points[a:b] for a, b in zip(starts, starts[1:])]
    if kind == 3:
        return "LINESTRING", parts[0].tolist()
    polygons: list[list] = []
    for p in parts:
        if polygons and poly.signed_area(p) > 0:
            polygons[-1].append(p.tolist())
        else:
            polygons.append([p.tolist()])
    return ("POLYGON", polygons[0]) if len(polygons) == 1 else ("MULTIPOLYGON", polygons)


def walked(z: zipfile.ZipFile, by: dict[str, zipfile.ZipInfo], first: int, last: int) -> np.ndarray:
    """(place, length) of records first to last by the heads of all records before; for archives without a full index."""
    out, at = [], 100
    with z.open(by["shp"]) as shp:
        for n in range(last):
            shp.seek(at)
            if len(head := shp.read(8)) < 8:
                break
            size = 2 * struct.unpack_from(">i", head, 4)[0]
            if n >= first:
                out.append((at, size))
            at += 8 + size
    return np.array(out, np.int64).reshape(-1, 2)


def shapefile_rows(z: zipfile.ZipFile, first: int, last: int, columns: list[str] | None) -> Iterator[tuple]:
    by = members(z)
    crs = system_of(z.read(by["prj"]).decode("utf-8", "replace")) if "prj" in by else "EPSG:4326"
    if by["shx"].file_size >= 100 + 8 * last:
        index = np.frombuffer(part_of(z, by["shx"], 100 + 8 * first, 8 * (last - first)), ">i4").reshape(-1, 2).astype(np.int64) * 2
    else:
        index = walked(z, by, first, last)
    head = part_of(z, by["dbf"], 0, 32)
    count, head_size, width = struct.unpack_from("<IHH", head, 4)
    described = part_of(z, by["dbf"], 32, head_size - 33)
    fields, at = [], 1
    for k in range(0, len(described) - 31, 32):
        fields.append((described[k : k + 11].split(b"\0")[0].decode(), chr(described[k + 11]), at, described[k + 16]))
        at += described[k + 16]
    wanted = [f for f in fields if columns is None or f[0] in columns or f[0] in IDS]
    table = part_of(z, by["dbf"], head_size + first * width, width * max(0, min(last, count) - first))
    with z.open(by["shp"]) as shp:
        for n in range(first, min(last, count)):
            props = {}
            for name, kind, start, size in wanted:
                a = (n - first) * width + start
                raw = table[a : a + size].decode("utf-8", "replace").strip()
                props[name] = None if raw == "" else (float(raw) if "." in raw else int(raw)) if kind in "NF" else raw
            shape = None
            if n - first < len(index):
                where, size = index[n - first].tolist()
                if shp.tell() != where:
                    shp.seek(where)
                shape = shape_of(shp.read(8 + size)[8:])
            yield n, shape, props, props if columns is None else {k: v for k, v in props.items() if k in columns}, crs


# ------------------------------------------------------------------ GeoPackages


def local_copy(path: str) -> str:
    """The file itself, or its copy in this process' temporary folder."""
    fs, at = store(path)
    if isinstance(fs, pafs.LocalFileSystem):
        return at
    info = fs.get_file_info(at)
    target = os.path.join(tempfile.gettempdir(), f"gpkg-{os.getpid()}-{hashlib.sha256(f'{path} {info.size} {info.mtime_ns}'.encode()).hexdigest()[:24]}")
    if not os.path.exists(target):
        with fs.open_input_stream(at) as source, open(f"{target}.part", "wb") as out:
            while block := source.read(1 << 22):
                out.write(block)
        os.replace(f"{target}.part", target)
    return target


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def layers(db: sqlite3.Connection) -> list[tuple[str, str, int]]:
    return db.execute("select table_name, column_name, srs_id from gpkg_geometry_columns order by table_name").fetchall()


def geopackage_rows(db: sqlite3.Connection, layer: str, first: int, last: int, ahead: int, columns: list[str] | None) -> Iterator[tuple]:
    column, srs = next((c, s) for t, c, s in layers(db) if t == layer)
    names = [r[1] for r in db.execute(f"pragma table_info({quoted(layer)})") if r[1] != column]
    wanted = [n for n in names if columns is None or n in columns or n in IDS]
    chosen = ", ".join(quoted(n) for n in (column, *wanted))
    crs = normalize(str(srs))
    for k, (blob, *values) in enumerate(db.execute(f"select {chosen} from {quoted(layer)} where rowid between ? and ? order by rowid", (first, last))):
        props = dict(zip(wanted, values))
        shape = poly.from_wkb(blob[8 + (0, 32, 48, 48, 64)[blob[3] >> 1 & 7] :]) if blob else None
        yield ahead + k, shape, props, props if columns is None else {n: v for n, v in props.items() if n in columns}, crs


def geopackage_ranges(db: sqlite3.Connection, path: str, rows: int) -> list[Range]:
    out, ahead = [], 0
    for layer, _, _ in layers(db):
        starts = [r[0] for r in db.execute(f"select rowid from (select rowid, row_number() over (order by rowid) - 1 as k from {quoted(layer)}) where k % ? = 0 order by rowid", (rows,))]
        for a, b in zip(starts, [*(s - 1 for s in starts[1:]), (1 << 63) - 1]):
            out.append(Range(path, layer, a, b, ahead))
            ahead += rows
        if starts:
            ahead = ahead - rows + db.execute(f"select count(*) from {quoted(layer)} where rowid >= ?", (starts[-1],)).fetchone()[0]
    return out


def checked(path: str) -> sqlite3.Connection:
    with open(path, "rb") as f:
        if f.read(16) != b"SQLite format 3\0":
            raise ValueError("not a GeoPackage")
    return sqlite3.connect(f"file:{path}?mode=ro&immutable=1", uri=True)


# ------------------------------------------------------------------ sources


class Ranged(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.rows = options["path"], int(options.get("rows_per_task", "50000"))
        self.columns = json.loads(options["properties"]) if "properties" in options else None


class ShapefileReader(Ranged):
    def partitions(self) -> list[Range]:
        out = []
        for path in files(self.path, ".zip"):
            fs, at = store(path)
            with fs.open_input_file(at) as f, zipfile.ZipFile(f) as z:
                by = members(z)
                count = struct.unpack_from("<I", part_of(z, by["dbf"], 0, 32), 4)[0]
            out += [Range(path, "", a, min(a + self.rows, count), a) for a in range(0, count, self.rows)]
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        fs, at = store(partition.path)
        with fs.open_input_file(at) as f, zipfile.ZipFile(f) as z:
            yield from batches(shapefile_rows(z, partition.first, partition.last, self.columns))


class GeoPackageReader(Ranged):
    def partitions(self) -> list[Range]:
        out = []
        for path in files(self.path, ".gpkg"):
            db = checked(local_copy(path))
            out += geopackage_ranges(db, path, self.rows)
            db.close()
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        db = checked(local_copy(partition.path))
        yield from batches(geopackage_rows(db, partition.layer, partition.first, partition.last, partition.ahead, self.columns))
        db.close()


class Shapefiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "parcelforge_shapefile"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return ShapefileReader(self.options)


class GeoPackages(Shapefiles):
    @classmethod
    def name(cls) -> str:
        return "parcelforge_geopackage"

    def reader(self, schema) -> DataSourceReader:
        return GeoPackageReader(self.options)


SOURCES = {"shapefile": Shapefiles, "geopackage": GeoPackages}


def whole(data: bytes, kind: str, columns: list[str] | None) -> Iterator[pa.RecordBatch]:
    """All features of a file's bytes."""
    if kind == "shapefile":
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            count = struct.unpack_from("<I", part_of(z, members(z)["dbf"], 0, 32), 4)[0]
            yield from batches(shapefile_rows(z, 0, count, columns))
        return
    if not data.startswith(b"SQLite format 3\0"):
        raise ValueError("not a GeoPackage")
    db = sqlite3.connect(":memory:")
    db.deserialize(data)
    for r in geopackage_ranges(db, "", 1 << 62):
        yield from batches(geopackage_rows(db, r.layer, r.first, r.last, r.ahead, columns))
    db.close()


def read(spark: SparkSession, path: str, kind: str, columns: list[str] | None = None, rows_per_task: int = 50_000) -> DataFrame:
    if scheme(path) in STORES:
        spark.dataSource.register(SOURCES[kind])
        source = spark.read.format(SOURCES[kind].name()).option("rows_per_task", str(rows_per_task))
        return (source if columns is None else source.option("properties", json.dumps(columns))).load(path)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in frames:
            for content in x.column(0):
                yield from whole(content.as_py(), kind, columns)

    return spark.read.format("binaryFile").load(path).select(F.col("content")).mapInArrow(run, SCHEMA)
