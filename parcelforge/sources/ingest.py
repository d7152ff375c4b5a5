"""From a file to a dataset: stored, profiled, in its own and in the project's coordinate system, as one version.

The rows of all four tables (``datasets``, ``dataset_versions``, ``source_features``, ``canonical_features``) are
published together or not at all.  A run that fails is a row of ``ingest_runs``, and is raised again.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelforge.functions.crs import normalize
from parcelforge.sources import vector
from parcelforge.store import Store

RUN = "run_id string, dataset_id string, path string, status string, features bigint, message string"
DATASET = "dataset_id string, project_id string, name string, source_filename string, source_format string, status string, feature_count bigint, geometry_type string, detected_crs string, bounding_box array<double>, file_size bigint, profile string"
VERSION = "version_id string, dataset_id string, version_number int, storage_path string, file_size bigint, checksum string, feature_count bigint, geometry_type string, crs string, validity_percentage double"


def corners(wkt: str = "wkt") -> list:
    """The least and greatest coordinates of well-known texts, as columns x1, y1, x2, y2."""
    body = F.regexp_extract(wkt, r"\((.*)\)", 1)
    of = lambda k: F.transform(F.regexp_extract_all(body, F.lit(r"([-+.\deE]+)\s+([-+.\deE]+)"), F.lit(k)), lambda v: v.cast("double"))
    return [F.array_min(of(1)).alias("x1"), F.array_min(of(2)).alias("y1"), F.array_max(of(1)).alias("x2"), F.array_max(of(2)).alias("y2")]


def profiled(features: DataFrame) -> dict:
    """Counts, kinds, the dominant kind (80 per cent, otherwise Mixed), extent, systems and attributes, in two passes."""
    held = features.select("kind", "wkt", "crs", "properties", *corners())
    filled = F.col("x1").isNotNull()
    one = held.agg(F.count("*").alias("n"), F.count_if(filled).alias("valid"), F.count_if(F.col("wkt").isNotNull() & ~filled).alias("empty"), *(f(c).alias(c) for f, c in ((F.min, "x1"), (F.min, "y1"), (F.max, "x2"), (F.max, "y2"))), F.collect_set("crs").alias("crs")).first()
    kinds = {r.kind or "Unknown": r["count"] for r in held.groupBy("kind").count().collect()}
    # A row for each attribute, not for each feature.
    filled_in = held.select(F.explode("properties").alias("attribute", "value")).groupBy("attribute").agg(F.count("value").alias("filled"), F.approx_count_distinct("value").alias("values"))
    attributes = {r.attribute: {"filled": r.filled, "nulls": one.n - r.filled, "distinct_about": r["values"]} for r in filled_in.orderBy("attribute").collect()}
    top = max(kinds, key=lambda k: (kinds[k], k), default="Unknown")
    dominant = top if one.n and kinds[top] >= 0.8 * one.n else "Mixed"
    return {
        "feature_count": one.n, "valid": one.valid, "empty": one.empty, "without_geometry": one.n - one.valid - one.empty, "kinds": kinds, "geometry_type": dominant, "systems": sorted(one.crs),
        "bounds": [one.x1, one.y1, one.x2, one.y2] if one.valid else None, "validity_percentage": round(100.0 * one.valid / one.n, 1) if one.n else 0.0, "attributes": attributes,
    }


def ingest(store: Store, path: str, *, project: str, dataset: str | None = None, name: str | None = None, crs: str | None = None, target: str = "EPSG:4326", rows_per_task: int = 50_000) -> dict:
    """Reads a file as the next version of a dataset (a new one without ``dataset``); returns what was published.

    crs: the file's system where it says none, or a wrong one.
    """
    run_id, dataset, spark = uuid.uuid4().hex, dataset or uuid.uuid4().hex, store.spark
    try:
        with store.run() as run:
            out = _ingest(run, path, project, dataset, name, crs, target, rows_per_task)
            run.append("ingest_runs", spark.createDataFrame([(run_id, dataset, path, "completed", out["feature_count"], None)], RUN))
        return out
    except Exception as e:
        with store.run() as run:
            run.append("ingest_runs", spark.createDataFrame([(run_id, dataset, path, "failed", None, str(e).split("\n")[0][:500])], RUN))
        raise


def _ingest(run, path: str, project: str, dataset: str, name: str | None, crs: str | None, target: str, rows_per_task: int) -> dict:
    spark = run.store.spark
    kind, to = vector.detect(path), normalize(target)
    for known, what in ((to, target), (normalize(crs) if crs else to, crs)):
        if not known.startswith("EPSG:"):
            raise ValueError(f"no known coordinate system: {what}")
    file = spark.read.format("binaryFile").load(path)
    size = file.agg(F.sum("length")).first()[0]
    # Of a file within the upload limit the bytes are hashed; a larger one is known by its size.
    checksum = vector.stored(spark, path).first().sha256 if size <= vector.MAX_BYTES else None
    version = uuid.uuid4().hex
    features = vector.read(spark, path, crs=crs or "EPSG:4326", rows_per_task=rows_per_task)
    if crs:
        features = features.withColumn("crs", F.lit(normalize(crs)))
    empty = F.col("wkt").isNull() | F.col("wkt").endswith(" EMPTY")
    keyed = features.select(
        F.lit(dataset).alias("dataset_id"), F.lit(version).alias("version_id"), F.concat(F.lit(f"{version}-"), F.monotonically_increasing_id().cast("string")).alias("feature_key"),
        F.trim("feature_id").alias("source_feature_id"), F.when(~empty, F.col("wkt")).alias("wkt"), F.when(empty, "Unknown").otherwise(F.col("kind")).alias("kind"), "properties", F.col("crs").alias("source_crs"),
    )
    # The canonical rows are made of the staged ones, so that both have the same keys.
    staged = run.append("source_features", keyed)
    profile = profiled(staged.withColumnRenamed("source_crs", "crs"))
    if not profile["valid"]:
        raise ValueError("the file has no feature with a geometry")
    unknown = [c for c in profile["systems"] if not c.startswith("EPSG:")]
    if unknown:
        raise ValueError(f"the coordinate system is {unknown[0]}: name one")
    moved = vector.canonical(staged.withColumnRenamed("source_crs", "crs"), to)
    run.append("canonical_features", moved.select("dataset_id", "version_id", "feature_key", "source_feature_id", "wkt", "kind", F.col("properties").alias("canonical_properties"), "source_crs", F.col("crs").alias("target_crs")))
    key = spark.createDataFrame([(dataset,)], "dataset_id string")
    if "datasets" in run.tables:
        owner = run.near("datasets", key).select("project_id").first()
        if owner is not None and owner[0] != project:
            raise ValueError("a dataset of another project")
    before = run.read("dataset_versions").where(F.col("dataset_id") == dataset).agg(F.max("version_number")).first()[0] if "dataset_versions" in run.tables else None
    filename = vector.safe_name(path)
    system = profile["systems"][0] if len(profile["systems"]) == 1 else "mixed"
    n, shape = profile["feature_count"], profile["geometry_type"]
    row = (dataset, project, (name or "").strip() or filename.rpartition(".")[0], filename, kind, "ready", n, shape, system, profile["bounds"], size, json.dumps(profile))
    run.merge("datasets", spark.createDataFrame([row], DATASET), ["dataset_id"])
    number = (before or 0) + 1
    run.append("dataset_versions", spark.createDataFrame([(version, dataset, number, path, size, checksum, n, shape, system, profile["validity_percentage"])], VERSION))
    return {"dataset_id": dataset, "version_id": version, "version_number": number, "checksum": checksum} | profile


def layer(store: Store, dataset: str, version: str | None = None) -> DataFrame:
    """The canonical features of a version, the last one without ``version``."""
    versions = store.read("dataset_versions").where(F.col("dataset_id") == dataset)
    chosen = version or versions.orderBy(F.desc("version_number")).select("version_id").first()[0]
    return store.read("canonical_features").where(F.col("version_id") == chosen)
