"""Queries of lists, projects, lookups, documents and further signals; importing this module registers them."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelforge.functions import scoring, text
from parcelforge.functions.scoring import MatchConfig
from parcelforge.operators import analysis, assistant, attributes, graph, grid, harmonize, language, listing, matching, profile, projects, review
from parcelforge.plans import catalog_more
from parcelforge.plans import fixtures as fx
from parcelforge.plans.catalog import Held, Inputs, query
from parcelforge.session import shared_path, stored
from parcelforge.sources import export, vector

QUERIES = catalog_more.QUERIES


def _named(matches: DataFrame) -> DataFrame:
    """Matches with identifiers, and a second candidate dataset: that of the odd structures."""
    candidate = F.when(F.col("b_id") % 2 == 0, "drone north").otherwise("drone south")
    return matches.withColumns({"source_dataset": F.lit("cadastral"), "candidate_dataset": candidate, "source_identifier": F.col("a_parcel"), "candidate_identifier": F.col("b_structure")})


# ------------------------------------------------------------------ lists
# Pages of a stage are filters of what it has stored: a filter on a column of many steps would be spelt out in full
# before the stage's projections.


@query
def match_filtered_page(spark, d):
    m = listing.matches(_named(Inputs(spark, d).ranked), status=" Conflict ", role="conflict", least=0.4, most=0.75, source="cadastral", candidate="drone north")
    return listing.page(m, F.col("score").desc(), F.col("rank").asc_nulls_last(), "a_id", "b_id", skip=5, limit=40).select("a_id", "b_id", "score", "rank")


@query
def match_table_page(spark, d):
    m = listing.match_table(_named(Inputs(spark, d).ranked), search="cp-1", sort="score_gap", page_number=2, page_size=25, least_pct=20, status="all")
    return m.select("a_id", "b_id", "score_gap")


@query
def match_best_page(spark, d):
    m = listing.match_table(_named(Inputs(spark, d).ranked), best_only=True, sort="candidate_identifier", descending=False, page_size=50)
    return m.select("a_id", "b_id", "score")


@query
def conflict_filtered_page(spark, d):
    i = Inputs(spark, d)
    c = stored(i.conflicts, "conflicts").withColumns({"source_a": F.lit("cadastral registry"), "source_b": F.lit("drone ortho"), "created_at": F.col("a_id")})
    found = listing.conflicts(c, severity="high", conflict_type="ALL", status="open", source="ORTHO", search="1_2", searched=("record_id", "field_name"))
    return listing.conflict_page(found, limit=60).select("record_id", "conflict_type", "severity")


@query
def attribute_conflict_page(spark, d):
    i = Inputs(spark, d)
    severity = F.when(F.col("conflict_type") == "VALUE_MISMATCH", "HIGH").otherwise("MEDIUM")
    c = attributes.multi_source(i.fixture(fx.VALUES)).withColumns({"severity": severity, "status": F.lit("UNRESOLVED")})
    records = i.table("orders").select(F.col("o_orderkey").alias("record_id"), F.concat(F.lit("R-"), F.col("o_orderkey").cast("string")).alias("identifier"))
    found = listing.attribute_conflicts(c, records, status="unresolved", attribute=" owner_name ", severity="high")
    return listing.page(found, F.col("record_id").desc(), limit=80).select("identifier", "attribute", "conflict_type", "severity")


@query
def validation_filtered_page(spark, d):
    return listing.validation_page(listing.validations(stored(Inputs(spark, d).checked.select("record_id", "overall", *listing.CHECKS.values()), "checked"), status="ALL", category="topology", search="7")).select("record_id", "overall", "topology")


@query
def confidence_filtered_page(spark, d):
    found = listing.confidences(stored(Inputs(spark, d).confident.select("record_id", "confidence", "bucket", "review_status"), "confident"), bucket="all", review_status="flagged", search="4_")
    return listing.page(found, F.col("confidence").desc(), "record_id").select("record_id", "confidence")


@query
def unified_filtered_page(spark, d):
    u = stored(Inputs(spark, d).unified, "unified").withColumns({"identifier": F.col("record_id"), "source_a_reference": F.concat(F.lit("CP-"), F.col("a_id").cast("string")), "source_b_reference": F.concat(F.lit("DS-"), F.col("b_id").cast("string"))})
    return listing.page(listing.unified(u, status="active", resolution="unified", search="p-1%3"), "record_id").select("record_id", "land_use")


@query
def provenance_filtered_page(spark, d):
    return listing.page(listing.provenance(stored(Inputs(spark, d).lineage, "lineage"), state="partial", search="3"), "record_id").select("record_id", "completeness_pct")


@query
def provenance_rejected_page(spark, d):
    return listing.page(listing.provenance(stored(Inputs(spark, d).lineage, "lineage"), state="REJECTED"), "record_id").select("record_id", "lineage_status")


@query
def record_lookup(spark, d):
    i = Inputs(spark, d)
    return listing.lookup(i.parcels, "CP-17", "a_id", "a_parcel").unionByName(listing.lookup(i.parcels, "18", "a_id", "a_parcel")).select("a_id", "a_parcel")


# ------------------------------------------------------------------ projects


@query
def project_isolation(spark, d):
    """Pairs within one of three projects."""
    i = Inputs(spark, d)
    side = lambda df, k, name: listing.of_project(df.withColumn(name, F.concat(F.lit("p"), (F.col(k) % 3).cast("string"))), "p1", name)
    pairs = matching.candidates(side(i.parcels, "a_id", "a_project"), side(i.structures, "b_k", "b_project"))
    return pairs.select("a_id", "b_id", "relationship")


@query
def project_deleted(spark, d):
    i = Inputs(spark, d)
    project = lambda df, k: df.withColumn("project_id", F.concat(F.lit("p"), (F.col(k) % 3).cast("string")))
    left = projects.without_project({"parcels": project(i.parcels, "a_id"), "assets": project(i.fixture(fx.ASSETS), "id")}, "p2")
    return projects.overview(**{k: (v, "project_id") for k, v in left.items()})


@query
def project_overview(spark, d):
    i = Inputs(spark, d)
    return projects.overview(records=(i.unified, "status"), conflicts=(i.conflicts, "severity"), runs=(i.fixture(fx.RUNS), "status"), decisions=(i.fixture(fx.DECISIONS), "action"))


@query
def latest_dataset_features(spark, d):
    """Events stand for features, users for datasets and event types for versions."""
    e = Inputs(spark, d).table("events").select("event_id", F.col("user_id").alias("dataset_id"), F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("version_id"), "event_type")
    versions = e.select("dataset_id", "version_id", F.col("event_type").alias("version_number")).distinct()
    return projects.latest_features(e.drop("dataset_id"), versions).select("event_id", "dataset_id", "version_id")


# ------------------------------------------------------------------ signals and stages


@query
def asset_match_scored(spark, d):
    """Boxes against points: no overlap and no area, so that the other signals' weights count."""
    i = Inputs(spark, d)
    pairs = grid.join(i.parcels.select("a_id", *(f"a_{c}" for c in ("x1", "y1", "x2", "y2"))), i.assets, 50.0)
    return matching.scored(matching.signals(pairs, F.lit(0.5))).select("a_id", "b_id", "spatial", "area", F.round("geometry", 4).alias("geometry"), "score", "status")


@query
def match_scored_stage(spark, d):
    return matching.scored(Inputs(spark, d).scored.drop("score", "status"), MatchConfig.stage()).groupBy("status").agg(F.count("*").alias("n"))


@query
def match_scored_attributes(spark, d):
    """The attribute signal from the attributes themselves."""
    i = Inputs(spark, d)
    a = F.create_map(F.lit("parcel_id"), F.col("a_parcel"), F.lit("owner_name"), F.col("a_owner"), F.lit("land_use"), F.col("a_land_use"), F.lit("area_sqm"), F.col("a_area").cast("string"), F.lit("_source"), F.lit("x"))
    b = F.create_map(F.lit("structure_id"), F.col("b_structure"), F.lit("land_use"), F.col("b_land_use"), F.lit("Area_SqM"), F.col("b_area").cast("string"))
    alike = scoring.attribute_similarity(i.pairs.withColumns({"a": a, "b": b}), "a", "b", "alike")
    return matching.scored(matching.signals(alike, F.round("alike", 4))).select("a_id", "b_id", "attribute", "score", "status")


class Flawed(Inputs):
    """Some parcels have no sound geometry."""

    @functools.cached_property
    def parcels(self) -> DataFrame:
        state = F.when(F.col("a_id") % 41 == 0, "self-intersection").when(F.col("a_id") % 43 == 0, "NULL").when(F.col("a_id") % 47 == 0, "EMPTY").otherwise("VALID")
        return super().parcels.withColumn("a_geometry_state", state)


@query
def validation_geometry(spark, d):
    return Flawed(spark, d).checked.select("record_id", "geometry_check", "geometry_failure", "overall")


@query
def unified_geometry_status(spark, d):
    return Flawed(spark, d).unified.select("record_id", "geometry_valid", "status")


@query
def confidence_cascade(spark, d):
    """Where geometry and attribute signals are missing, others stand for them."""
    gone = lambda c, test: F.when(test, F.lit(None).cast("double")).otherwise(F.col(c))
    c = Inputs(spark, d).checked.withColumns({"geometry": gone("geometry", F.col("a_id") % 3 == 0), "attribute": gone("attribute", F.col("a_id") % 5 < 2)})
    return harmonize.confidence(c).select("record_id", "s_geometry", "s_attribute")


@query
def pair_lookup(spark, d):
    """Records find their match by the two parts of their key."""
    i = Inputs(spark, d)
    keys = i.confident.select("record_id", F.split_part("record_id", F.lit("_"), F.lit(1)).cast("bigint").alias("a_id"), F.split_part("record_id", F.lit("_"), F.lit(2)).cast("bigint").alias("b_id"), "confidence")
    return keys.join(i.ranked.select("a_id", "b_id", "score", "role"), ["a_id", "b_id"]).select("record_id", "score", "role", "confidence")


@query
def geometry_kinds(spark, d):
    p = Inputs(spark, d).table("part")
    return profile.kinds(p.select(F.when(F.col("p_partkey") % 10 == 0, "Point").otherwise("Polygon").alias("kind")))


@query
def conflict_clusters_joined(spark, d):
    i = Inputs(spark, d)
    return analysis.clusters(i.conflicts, i.boxes).select("cluster_id", "conflicts", "records")


@query
def conflict_source_pairs(spark, d):
    i = Inputs(spark, d)
    c = i.conflicts.withColumns({"source_a": F.lit("cadastral"), "source_b": F.when(F.col("b_id") % 2 == 0, "drone north").otherwise("drone south")})
    return analysis.source_pairs(c, i.boxes)


@query
def assets_in_box(spark, d):
    return analysis.in_box(Inputs(spark, d).fixture(fx.ASSETS), 73.855, 18.52, 73.87, 18.53).select("id")


# ------------------------------------------------------------------ unified records


def _sources(i: Inputs) -> DataFrame:
    return i.fixture(fx.VALUES).withColumn("role", F.when(F.col("source") == "municipal assets", "MUNICIPAL").otherwise(text.source_role("source")))


@query
def unified_role_statistics(spark, d):
    return review.role_statistics(_sources(Inputs(spark, d)).select("record_id", "role"))


@query
def attribute_by_role(spark, d):
    m = attributes.by_role(_sources(Inputs(spark, d)))
    return m.select("record_id", "attribute", F.array_join(F.transform(F.map_entries("by_role"), lambda e: F.concat_ws("=", e["key"], e["value"])), ";").alias("values"))


@query
def sources_in_order(spark, d):
    e = Inputs(spark, d).table("events")
    o = attributes.in_order(e, "event_type", "event_id", key="user_id", name="kinds")
    return o.select("user_id", F.array_join("kinds", ",").alias("kinds"))


@query
def record_trail(spark, d):
    t = review.trail(Inputs(spark, d).queue)
    at = lambda p: F.get_json_object("trail", f"$.pipeline_lineage.{p}")
    return t.select("record_id", at("human_review.decision").alias("decision"), at("human_review.adjudicated").alias("adjudicated"), at("conflicts.conflict_count").alias("conflicts"), at("validation.overall_status").alias("validation"), at("matching.role").alias("role"))


@query
def components_assigned(spark, d):
    i = Inputs(spark, d)
    edges = i.ranked.where("status in ('matched', 'possible_match')").select((F.col("a_id") * 2).alias("u"), (F.col("b_id") * 2 + 1).alias("v"))
    found = graph.components(edges)
    earlier = found.where("node % 10 = 0").select("node", F.concat(F.lit("R"), F.floor(F.col("node") / 20).cast("string")).alias("record"))
    return graph.assign(found, earlier)


@query
def evidence_bundles(spark, d):
    i = Held(spark, d)
    b = assistant.bundle(i.unified.select("record_id", "status"), i.conflicts, i.unified.select("record_id", F.col("decision").alias("action"), "decided_at"))
    said = F.array_join(F.transform("evidence", lambda x: F.concat_ws(":", x["conflict_type"], x["severity"])), ",")
    return b.select("record_id", "status", "action", said.alias("evidence"))


# ------------------------------------------------------------------ values, documents, questions


@query
def date_slugs(spark, d):
    return Inputs(spark, d).table("events").select("event_id", text.iso("ts").alias("iso"), text.date_slug("ts").alias("slug"))


@query
def version_map_diff(spark, d):
    i = Inputs(spark, d)
    as_map = lambda: F.create_map(F.lit("owner"), F.col("owner"), F.lit("kind"), F.col("kind"))
    old, new = (i.fixture(x).select("id", as_map().alias(n)) for x, n in ((fx.VERSION_1, "old"), (fx.VERSION_2, "new")))
    changed = F.map_entries(text.map_diff("old", "new"))
    return old.join(new, "id").select("id", F.array_join(F.transform(changed, lambda e: F.concat(e["key"], F.lit(":"), e["value"]["old"], F.lit(">"), e["value"]["new"])), ",").alias("changed"))


@query
def export_features(spark, d):
    u = review.authoritative(Inputs(spark, d).unified).withColumn("geometry", F.lit(None).cast("string"))
    return u.select("record_id", export.feature(["record_id", "land_use", "status", "decision"]).alias("feature"))


@query
def short_ids(spark, d):
    c = Inputs(spark, d).table("customer")
    return c.select("c_custkey", F.substring(F.coalesce("c_name", F.col("c_custkey").cast("string")), 1, 8).alias("short"))


@query
def kb_all_documents(spark, d):
    i = Inputs(spark, d)
    p = spark.createDataFrame([("p1", "Wards", ["parcels", "structures"], 2, 0)], "project_id string, name string, datasets array<string>, records int, conflicts int")
    ds = i.table("nation").select(F.col("n_nationkey").alias("dataset_id"), F.col("n_name").alias("name"), F.lit("csv").alias("format"), F.lit(None).cast("string").alias("geometry"), F.col("n_regionkey").alias("features"))
    events = i.table("events").select(F.col("user_id").alias("record_id"), "ts", "event_id", "event_type")
    out = assistant.project_documents(p)
    for more in (assistant.dataset_documents(ds), assistant.conflict_documents(i.conflicts), assistant.provenance_documents(events)):
        out = out.unionByName(more)
    return out


@query
def csv_points_parse(spark, d):
    """A written CSV of points, some without coordinates, read back."""
    a = Inputs(spark, d).fixture(fx.ASSETS)
    path = shared_path(spark, "csv")
    a.select(F.col("id").alias("asset_id"), "name", F.when(F.col("id") % 7 == 0, "n/a").otherwise(F.col("y").cast("string")).alias("LATITUDE"), F.col("x").cast("string").alias("lng")).write.option("header", True).csv(path)
    return vector.read_csv(spark, path).select("feature_id", F.col("properties")["name"].alias("name"), F.col("wkt").isNull().alias("missing"))


@query
def kb_search(spark, d):
    """An index by category; the test vectors are the documents'."""
    v = Inputs(spark, d).table("embeddings").select("vec_id", "embedding", F.when(F.col("vec_id") % 3 == 1, "record").otherwise("conflict").alias("category"))
    q = [float(x) for x in v.where("vec_id = 0").select("embedding").first()[0]]  # one row
    return assistant.top(v.where("category = 'record'"), q, 10, "vec_id", "embedding")


@query
def nlq_spatial_plan(spark, d):
    c = Inputs(spark, d).table("conversations").select(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("question_id"), F.lit("p").alias("project_id"), F.col("text").alias("question"))
    asked = c.withColumn("question", F.concat(F.lit("show parcels "), F.when(F.length("question") % 3 == 0, "within 2 km of municipal assets ").when(F.length("question") % 3 == 1, "that overlap structures ").otherwise(""), "question"))
    data = spark.createDataFrame([("p", "Cadastral Parcels", "Polygon", ["parcel_id"]), ("p", "Municipal Assets", "Point", ["asset_id"]), ("p", "Drone Structures", "Polygon", ["structure_id"])], "project_id string, name string, geometry string, attributes array<string>")
    plans = language.spatial_plans(asked, data)
    return plans.groupBy("target", "analysis").agg(F.count("*").alias("n"))
