"""Records, datasets and results of analyses as GeoJSON features and as rows of a CSV, made by column functions.

A feature is a text; :func:`collections` joins them to documents of a bounded number of features, so that no task and
no driver holds all of them.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelforge.session import shared_path
from parcelforge.store import Run

#: Names of the kinds of geometry in GeoJSON.
KINDS = {"POINT": "Point", "LINESTRING": "LineString", "POLYGON": "Polygon", "MULTIPOINT": "MultiPoint", "MULTILINESTRING": "MultiLineString", "MULTIPOLYGON": "MultiPolygon"}
#: Columns of an analysis' CSV.
ANALYSIS_COLUMNS = ("feature_id", "identifier", "dataset_name", "role", "distance_meters", "overlap_area_sqm", "overlap_pct", "geometry_type", "latitude", "longitude", "properties")
#: Fixed value: features of a dataset that are given at once.
LIMIT = 5000
KEEP = {"ignoreNullFields": "false"}


def geometry(wkt: str | Column) -> Column:
    """GeoJSON of a well-known text; null for none and for an empty one."""
    w = F.col(wkt) if isinstance(wkt, str) else wkt
    kind, body = F.upper(F.regexp_extract(w, r"^\s*([A-Za-z]+)", 1)), F.regexp_extract(w, r"(\(.*\))", 1)
    number = r"([-+.\deE]+)"
    pairs = F.regexp_replace(body, number + r"\s+" + number + r"(?:\s+[-+.\deE]+)*", "[$1,$2]")
    lists = F.regexp_replace(F.translate(pairs, "()", "[]"), r"\s+", "")
    held = F.when(kind == "POINT", F.regexp_extract(lists, r"^\[(.*)\]$", 1)).otherwise(lists)
    name = None
    for k, v in KINDS.items():
        name = F.when(kind == k, v) if name is None else name.when(kind == k, v)
    return F.when((body != "") & name.isNotNull(), F.concat(F.lit('{"type":"'), name, F.lit('","coordinates":'), held, F.lit("}")))


def feature(id_: Column, shape: Column, properties: Column) -> Column:
    """A feature of an id, a geometry and properties that are JSON texts."""
    return F.concat(F.lit('{"type":"Feature","id":'), F.to_json(F.array(id_.cast("string"))).substr(F.lit(2), F.length(F.to_json(F.array(id_.cast("string")))) - 2), F.lit(',"geometry":'), F.coalesce(shape, F.lit("null")), F.lit(',"properties":'), properties, F.lit("}"))


def records(rows: DataFrame, sources: DataFrame, conflicts: DataFrame, record_id: str | None = None) -> DataFrame:
    """(record_id, feature) of unified records, or of one: its values, contributing sources and conflicts.

    rows: record_id, status, area, geometry_source, land_use, wkt; sources: record_id, role, dataset, identifier, in the
    order of ``at``; conflicts: record_id, status.
    """
    if record_id is not None:
        rows, sources, conflicts = (df.where(F.col("record_id") == record_id) for df in (rows, sources, conflicts))
    first = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("at", F.col(c).alias("v")))), lambda x: x.v)
    by = sources.groupBy("record_id").agg(F.count("*").alias("n"), F.array_distinct(first("role")).alias("roles"), F.array_distinct(F.array_compact(first("dataset"))).alias("datasets"), first("identifier").alias("identifiers"))
    n = lambda s: F.count_if(F.col("status") == s)
    states = conflicts.groupBy("record_id").agg(F.count("*").alias("conflicts"), n("UNRESOLVED").alias("unresolved"), n("RESOLVED").alias("resolved"), n("DISMISSED").alias("dismissed"))
    none, zero = F.array().cast("array<string>"), F.lit(0).cast("bigint")
    out = rows.join(by.hint("merge"), "record_id", "left").join(states.hint("merge"), "record_id", "left")
    count = lambda c: F.coalesce(c, zero)
    state = F.when(count("unresolved") > 0, "UNRESOLVED_CONFLICTS").when((count("resolved") > 0) | (count("dismissed") > 0), "RESOLVED").otherwise("NO_CONFLICTS")
    properties = F.struct(
        F.col("record_id").alias("record_identifier"), F.col("status"), F.col("area").alias("area_sqm"), F.col("geometry_source").alias("geometry_source_role"), count("n").alias("source_count"),
        F.coalesce("roles", none).alias("source_roles"), F.coalesce("datasets", none).alias("source_datasets"), F.coalesce("identifiers", none).alias("source_feature_identifiers"), F.col("land_use"),
        count("conflicts").alias("conflict_count"), count("unresolved").alias("unresolved_conflict_count"), count("resolved").alias("resolved_conflict_count"), state.alias("conflict_status"),
    )
    return out.select("record_id", feature(F.col("record_id"), geometry("wkt"), F.to_json(properties, KEEP)).alias("feature"))


def of_dataset(rows: DataFrame, dataset_id: str, name: str, representation: str = "canonical", limit: int | None = LIMIT) -> DataFrame:
    """(feature_key, feature) of a version's features (of the tables of an ingest), with what they are of as ``_``
    properties; the first ``limit`` by key."""
    if representation not in ("source", "canonical"):
        raise ValueError("a source or canonical representation")
    own = "properties" if representation == "source" else "canonical_properties"
    more = {"_source_feature_id": F.col("source_feature_id"), "_geometry_type": F.col("kind"), "_source_crs": F.col("source_crs")} | ({} if representation == "source" else {"_target_crs": F.col("target_crs")}) | {"_dataset_name": F.lit(name), "_dataset_id": F.lit(dataset_id)}
    pairs = F.create_map(*(x for k, v in more.items() for x in (F.lit(k), v)))
    kept = F.map_filter(F.coalesce(own, F.create_map().cast("map<string,string>")), lambda k, _: ~k.isin(*more))
    out = rows.select("feature_key", feature(F.col("feature_key"), geometry("wkt"), F.to_json(F.map_concat(kept, pairs), KEEP)).alias("feature"))
    return out if limit is None else out.orderBy("feature_key").limit(limit)


def combined(layers: dict[str, DataFrame]) -> DataFrame:
    """(layer, feature) of several layers."""
    out = None
    for name, df in layers.items():
        one = df.select(F.lit(name).alias("layer"), "feature")
        out = one if out is None else out.unionByName(one)
    return out


def collections(features: DataFrame, order: str, metadata: dict | None = None, crs: str | None = None, size: int = 10_000) -> DataFrame:
    """(part, document): collections of at most ``size`` features each, in an order within each."""
    # Hashed parts, as many as are needed: a row is never sought by more than its own part's task.
    parts = max(1, -(-features.count() // size))
    head = {"type": "FeatureCollection"} | ({"metadata": metadata} if metadata else {}) | ({"crs": {"type": "name", "properties": {"name": crs}}} if crs else {})
    begun = json.dumps(head)[:-1] + ', "features": ['
    dealt = features.withColumn("part", F.pmod(F.xxhash64(F.col(order).cast("string")), F.lit(parts)).cast("int"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), "feature"))), lambda x: x.feature), ",")
    return dealt.groupBy("part").agg(F.concat(F.lit(begun), joined, F.lit("]}")).alias("document"))


def analysis_rows(found: DataFrame) -> DataFrame:
    """An analysis' features (properties: a map; wkt) as the columns of its CSV, empty where there is nothing."""
    p = lambda *names: F.coalesce(*(F.nullif(F.col("properties")[n], F.lit("")) for n in names), F.lit(""))
    kind = F.upper(F.regexp_extract("wkt", r"^\s*([A-Za-z]+)", 1))
    name = F.lit("Unknown")
    for k, v in KINDS.items():
        name = F.when(kind == k, v).otherwise(name)
    at = lambda k: F.when(kind == "POINT", F.regexp_extract("wkt", r"\(\s*(\S+)\s+(\S+)\s*\)", k)).otherwise("")
    shown = F.to_json(F.map_filter("properties", lambda k, _: ~k.startswith("_")), KEEP)
    values = (p("id", "feature_id"), p("identifier", "title"), p("dataset_name"), p("_role"), p("distance_meters"), p("overlap_area_sqm"), p("overlap_pct"), F.coalesce(name, F.lit("Unknown")), F.coalesce(at(2), F.lit("")), F.coalesce(at(1), F.lit("")), shown)
    return found.select(*(v.alias(c) for c, v in zip(ANALYSIS_COLUMNS, values)))


def write_documents(documents: DataFrame, path: str) -> None:
    """A file for each collection."""
    documents.select("document").write.option("maxRecordsPerFile", 1).text(path)


JOB = "export_id string, project_id string, format string, path string, features bigint, bytes bigint, sha256 string, status string, message string, created_at timestamp"


def export(run: Run, export_id: str, project: str, features: DataFrame, order: str, path: str | None = None) -> dict:
    """Writes a project's collection and its row of ``export_jobs``; the checksum is that of the documents' checksums in
    order of their parts."""
    spark = run.store.spark
    at = path or shared_path(spark, "export")
    documents = collections(features, order, {"project_id": project, "export_id": export_id})
    documents.write.parquet(f"{at}-parts")
    made = spark.read.parquet(f"{at}-parts")
    write_documents(made, at)
    sums = made.select("part", F.length(F.encode("document", "UTF-8")).alias("bytes"), F.sha2("document", 256).alias("sha"))
    total = sums.agg(F.sum("bytes").alias("bytes"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "sha"))), lambda x: x.sha), ","), 256).alias("sha")).first()
    row = (export_id, project, "geojson", at, features.count(), total.bytes, total.sha, "completed", None)
    run.append("export_jobs", spark.createDataFrame([row], JOB.rpartition(",")[0]).withColumn("created_at", F.current_timestamp()))
    return dict(zip(("export_id", "project_id", "format", "path", "features", "bytes", "sha256", "status", "message"), row))


def final_stage(run: Run, export_id: str, project: str, unified: DataFrame, provenance: DataFrame, sources: DataFrame, conflicts: DataFrame, path: str | None = None) -> dict:
    """The last stage: an export of the authoritative records and the stage's row; fails before records and provenance
    are there."""
    n = unified.agg(F.count_if(F.col("resolution_status") == "UNIFIED").alias("unified"), F.count_if(F.col("resolution_status") == "REJECTED").alias("rejected")).first()
    if not n.unified:
        raise ValueError("there are no unified records to export")
    if provenance.isEmpty():
        raise ValueError("the provenance stage has to run before the export")
    made = export(run, export_id, project, records(unified.where("resolution_status = 'UNIFIED'"), sources, conflicts), "record_id", path)
    results = {"authoritative_records_count": n.unified, "quarantined_records_count": n.rejected, "total_records_count": n.unified + n.rejected} | {k: made[k] for k in ("export_id", "format", "bytes", "sha256")}
    spark = run.store.spark
    stage = spark.createDataFrame([(project, 14, "completed", json.dumps(results))], "project_id string, stage int, status string, results string")
    run.merge("stage_runs", stage, ["project_id", "stage"])
    return made


def jobs(exports: DataFrame, project: str, export_id: str | None = None) -> DataFrame:
    """A project's exports, the last first, or one of them."""
    out = exports.where(F.col("project_id") == project)
    return out.orderBy(F.desc("created_at"), "export_id") if export_id is None else out.where(F.col("export_id") == export_id)


def layer_colors(datasets: DataFrame, colors: tuple[str, ...]) -> DataFrame:
    """Layers in order of their names, with the next of a circle of colours each; a project has few layers."""
    place = F.row_number().over(Window.partitionBy("project_id").orderBy("name", "dataset_id")) - 1
    return datasets.withColumn("color", F.element_at(F.array(*map(F.lit, colors)), (F.pmod(place, F.lit(len(colors))) + 1).cast("int")))
