"""Vector files as frames: GeoJSON, CSV with coordinates, zipped shapefiles and GeoPackages.

Every reader returns (feature_id, kind, wkt, properties map, crs), and reads a large file by many tasks.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelforge.functions.crs import normalized, transform
from parcelforge.sources import binary, geojson

#: Names of coordinate columns, in the order they are tried, and of ids.
LATITUDE, LONGITUDE = ("latitude", "lat", "y", "y_coord"), ("longitude", "lon", "lng", "long", "x", "x_coord")
IDS = ("id", "fid", "parcel_id", "structure_id", "asset_id", "facility_id", "code")
MAX_BYTES = 50 << 20


def detect(name: str) -> str:
    """geojson, csv, shapefile or geopackage by a file's name."""
    end = name.lower().rpartition(".")[2]
    kinds = {"geojson": "geojson", "json": "geojson", "csv": "csv", "zip": "shapefile", "gpkg": "geopackage"}
    if end == "shp":
        raise ValueError("a shapefile is read as a zip of its .shp, .shx and .dbf")
    if end not in kinds:
        raise ValueError(f"unknown format: {name}")
    return kinds[end]


def coordinate_columns(columns: list[str]) -> tuple[str, str]:
    """(longitude, latitude) columns: a known name, otherwise a part of one."""
    low = {c.lower().strip(): c for c in columns}

    def find(names: tuple[str, ...], parts: tuple[str, ...]) -> str:
        for n in names:
            if n in low:
                return low[n]
        for c in low:
            if any(p in c for p in parts):
                return low[c]
        raise ValueError("no coordinate columns")

    return find(LONGITUDE, ("lon", "lng")), find(LATITUDE, ("lat",))


def safe_name(name: str) -> str:
    """A file name without folders and odd characters."""
    return re.sub(r"[^A-Za-z0-9._-]+", "_", name.replace("\\", "/").rpartition("/")[2]).lstrip(".") or "upload"


def sanitize(value):
    """A JSON value without NaN and infinities; other things as text."""
    if isinstance(value, bool) or value is None or isinstance(value, (int, str)):
        return value
    if isinstance(value, float):
        return value if value == value and abs(value) != float("inf") else None
    if isinstance(value, dict):
        return {str(k): sanitize(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [sanitize(v) for v in value]
    return value.isoformat() if hasattr(value, "isoformat") else str(value)


def read_csv(spark: SparkSession, path: str, crs: str = "EPSG:4326") -> DataFrame:
    """Rows whose coordinates are no numbers have no geometry; a file without any is refused by :func:`require`."""
    df = spark.read.option("header", True).csv(path)
    lon, lat = coordinate_columns(df.columns)
    x, y = F.col(f"`{lon}`").try_cast("double"), F.col(f"`{lat}`").try_cast("double")
    ok = x.isNotNull() & y.isNotNull()
    rest = [c for c in df.columns if c not in (lon, lat)]
    ids = [F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")) for k in IDS for c in df.columns if c.lower() == k]
    own = F.coalesce(*ids, F.concat(F.lit("feat_"), F.monotonically_increasing_id().cast("string")))
    props = F.map_from_arrays(F.array(*map(F.lit, rest)), F.array(*(F.col(f"`{c}`") for c in rest))) if rest else F.create_map().cast("map<string,string>")
    return df.select(own.alias("feature_id"), F.when(ok, "POINT").alias("kind"), F.when(ok, F.format_string("POINT (%s %s)", x.cast("string"), y.cast("string"))).alias("wkt"), props.alias("properties"), F.lit(crs).alias("crs"))


def require(features: DataFrame) -> DataFrame:
    if features.where("wkt is not null").isEmpty():
        raise ValueError("no row has valid coordinates")
    return features


def parse_shapefile(data: bytes) -> list[dict]:
    """All features of an archive's bytes."""
    return [r for b in binary.whole(data, "shapefile", None) for r in b.to_pylist()]


def parse_geopackage(data: bytes) -> list[dict]:
    return [r for b in binary.whole(data, "geopackage", None) for r in b.to_pylist()]


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """A feature's id is its first known property, its own id, or its place in the file."""
    df = geojson.read(spark, path)
    ids = [F.nullif(F.col("properties")[k], F.lit("")) for k in IDS]
    own = F.coalesce(*ids, "id", F.concat(F.lit("feat_"), F.col("number").cast("string")))
    crs = F.when(F.col("crs").isNull(), "EPSG:4326").otherwise(normalized(F.col("crs")))
    return df.select(own.alias("feature_id"), "kind", "wkt", "properties", crs.alias("crs"))


def read(spark: SparkSession, path: str, crs: str = "EPSG:4326", columns: list[str] | None = None, rows_per_task: int = 50_000) -> DataFrame:
    """``columns``: the properties that are wanted, where not all are; binary files are read for these only."""
    kind = detect(path)
    if kind in ("shapefile", "geopackage"):
        return binary.read(spark, path, kind, columns, rows_per_task)
    df = read_csv(spark, path, crs) if kind == "csv" else read_geojson(spark, path)
    return df if columns is None else df.withColumn("properties", F.map_filter("properties", lambda k, _: k.isin(*columns)))


_PAIR = re.compile(r"([-+.\deE]+)\s+([-+.\deE]+)(?:\s+[-+.\deE]+)*")


def moved(texts: list[str], crs: str, target: str = "EPSG:4326") -> list[str]:
    """Well-known texts in another system, to nine places; all coordinates are transformed at once."""
    found = [_PAIR.findall(t) for t in texts]
    pairs = np.array([(float(x), float(y)) for ps in found for x, y in ps], float).reshape(-1, 2)
    x, y = transform(pairs[:, 0], pairs[:, 1], crs, target)
    shown = iter([f"{a!r} {b!r}" for a, b in zip(np.round(x, 9).tolist(), np.round(y, 9).tolist())])
    return [_PAIR.sub(lambda _: next(shown), t) for t in texts]


def canonical(features: DataFrame, target: str = "EPSG:4326") -> DataFrame:
    """Geometries in the target's system."""

    @F.pandas_udf("string")
    def known(wkt: pd.Series, crs: pd.Series) -> pd.Series:
        out = wkt.astype(object).copy()
        for c in crs[wkt.notna() & (crs != target)].unique():
            at = np.flatnonzero((crs == c) & wkt.notna())
            out.iloc[at] = moved(wkt.iloc[at].tolist(), c, target)
        return out

    return features.withColumn("wkt", known("wkt", "crs")).withColumn("source_crs", F.col("crs")).withColumn("crs", F.lit(target))


def stored(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of uploaded files; larger ones than the limit are refused."""
    files = spark.read.format("binaryFile").load(path)
    checked = F.when(F.col("length") <= MAX_BYTES, F.sha2("content", 256)).otherwise(F.raise_error(F.lit("a file is over 50 MB")))
    return files.select("path", F.col("length").alias("bytes"), checked.alias("sha256"))
