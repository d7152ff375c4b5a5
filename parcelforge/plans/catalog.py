"""The queries of the library, by name: (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelforge.functions import geo, scoring, text
from parcelforge.operators import analysis, assistant, attributes, graph, harmonize, matching, merge, profile, review
from parcelforge.plans import fixtures as fx
from parcelforge.session import stored

QUERIES: dict = {}
r4 = lambda c: F.round(c, 4)


def query(f):
    QUERIES[f.__name__] = f
    return f


class Inputs:
    """Frames over one set of tables; each later stage is a function of the earlier ones, none is stored."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def fixture(self, text_: str) -> DataFrame:
        return fx.frame(self.spark, self.dir, text_)

    @functools.cached_property
    def parcels(self) -> DataFrame:
        return self.fixture(fx.PARCELS)

    @functools.cached_property
    def structures(self) -> DataFrame:
        return self.fixture(fx.STRUCTURES)

    @functools.cached_property
    def pairs(self) -> DataFrame:
        return matching.candidates(self.parcels, self.structures)

    @functools.cached_property
    def scored(self) -> DataFrame:
        attribute = F.when(F.col("a_id") == F.col("b_k"), F.col("b_att")).otherwise(0.1)
        return matching.scored(matching.signals(self.pairs, attribute))

    @functools.cached_property
    def ranked(self) -> DataFrame:
        return matching.ranked(self.scored)

    @functools.cached_property
    def records(self) -> DataFrame:
        return harmonize.harmonized(matching.detailed(matching.best(self.ranked), self.parcels, self.structures))

    @functools.cached_property
    def conflicts(self) -> DataFrame:
        return harmonize.conflicts(self.records)

    @functools.cached_property
    def checked(self) -> DataFrame:
        return harmonize.validated(harmonize.counted(self.records))

    @functools.cached_property
    def confident(self) -> DataFrame:
        return harmonize.confidence(self.checked)

    @functools.cached_property
    def decisions(self) -> DataFrame:
        """By parcel, which has one record: no record is looked up to find its decision."""
        return self.fixture(fx.DECISIONS).withColumnRenamed("parcel", "a_id")

    @functools.cached_property
    def queue(self) -> DataFrame:
        return review.queue(self.confident, self.decisions, on="a_id")

    @functools.cached_property
    def unified(self) -> DataFrame:
        return review.unified(self.confident, self.decisions, on="a_id")

    @functools.cached_property
    def lineage(self) -> DataFrame:
        return review.lineage(self.unified)

    @functools.cached_property
    def boxes(self) -> DataFrame:
        return self.parcels.select("a_id", *(F.col(f"a_{c}").alias(c) for c in ("x1", "y1", "x2", "y2")))

    @functools.cached_property
    def assets(self) -> DataFrame:
        """Points as boxes without extent."""
        a = self.fixture(fx.ASSETS)
        return a.select(F.col("id").alias("b_id"), F.col("x").alias("b_x1"), F.col("y").alias("b_y1"), F.col("x").alias("b_x2"), F.col("y").alias("b_y2"))


class Held(Inputs):
    """Records are stored: for queries in which several stages follow from them, which would each make them again."""

    @functools.cached_property
    def records(self) -> DataFrame:
        return stored(super().records, "records")


# ------------------------------------------------------------------ matching


@query
def candidate_pairs_within(spark, d):
    return Inputs(spark, d).pairs.select("a_id", "b_id", r4("distance").alias("distance"), "overlap_pct", "is_intersecting", "is_containing", "relationship")


@query
def candidate_counters(spark, d):
    return matching.counters(Inputs(spark, d).pairs)


@query
def centroid_candidates(spark, d):
    i = Inputs(spark, d)
    return matching.centroid_candidates(i.parcels, i.structures).select("a_id", "b_id", F.round("centroid_m", 3).alias("centroid_m"))


@query
def match_signals(spark, d):
    return Inputs(spark, d).scored.select("a_id", "b_id", *(r4(c).alias(c) for c in ("spatial", "area", "centroid", "geometry", "attribute")))


@query
def match_scored(spark, d):
    return Inputs(spark, d).scored.select("a_id", "b_id", "score", "status")


@query
def match_ranked(spark, d):
    return Inputs(spark, d).ranked.select("a_id", "b_id", "score", "status", "rank", "candidate_count", "score_gap", "role", "is_best")


@query
def match_quality(spark, d):
    i = Inputs(spark, d)
    return matching.quality(i.ranked, i.parcels)


@query
def attribute_similarity(spark, d):
    i = Inputs(spark, d)
    a = F.create_map(F.lit("parcel_id"), F.col("a_parcel"), F.lit("owner_name"), F.col("a_owner"), F.lit("land_use"), F.col("a_land_use"), F.lit("area_sqm"), F.col("a_area").cast("string"), F.lit("_source"), F.lit("x"))
    b = F.create_map(F.lit("structure_id"), F.col("b_structure"), F.lit("land_use"), F.col("b_land_use"), F.lit("Area_SqM"), F.col("b_area").cast("string"))
    pairs = scoring.attribute_similarity(i.pairs.select("a_id", "b_id", a.alias("a"), b.alias("b")), "a", "b")
    return pairs.select("a_id", "b_id", F.round("attribute", 4).alias("similarity"))


@query
def review_queue_top(spark, d):
    return matching.review_queue(Inputs(spark, d).ranked, "needs_review").select("a_id", "b_id", "score", "status", "role").limit(100)


@query
def review_category_counts(spark, d):
    return matching.category_counts(Inputs(spark, d).ranked)


@query
def match_list_page(spark, d):
    m = Inputs(spark, d).ranked.where((F.col("status") == "matched") & F.col("score").between(0.5, 1.0))
    return m.orderBy(F.col("score").desc(), F.col("rank").asc_nulls_last(), "a_id", "b_id").offset(20).limit(50).select("a_id", "b_id", "score", "rank")


# ------------------------------------------------------------------ harmonisation, conflicts, validation, confidence


@query
def best_match_harmonized(spark, d):
    cols = ("record_id", "geometry_source", "geometry_status", "source_area", "candidate_area", "harmonized_area", "area_pct", "land_use", "mutation", "risk", "conflict_count", "has_conflicts")
    return Inputs(spark, d).records.select(*cols)


@query
def conflict_rules(spark, d):
    return Inputs(spark, d).conflicts.select("record_id", "conflict_type", "category", "field_name", "severity", "idempotency_key")


@query
def conflict_counts(spark, d):
    return harmonize.conflict_counts(Inputs(spark, d).conflicts)


@query
def conflict_list_page(spark, d):
    c = Inputs(spark, d).conflicts.where((F.col("category") == "REGISTRY") & F.col("record_id").ilike("%1%"))
    return c.orderBy(harmonize.severity_rank(), "record_id", "conflict_type").limit(50).select("record_id", "conflict_type", "severity")


@query
def land_use_normalize(spark, d):
    i = Inputs(spark, d)
    p = i.table("part").select("p_partkey", F.col("p_type").alias("raw"), F.concat(F.lit(" "), F.lower("p_name"), F.lit(" ")).alias("name"))
    return p.select("p_partkey", text.land_use("raw").alias("land_use"), text.mutation("raw").alias("mutation"), text.risk("name").alias("risk"), text.text_value("name").alias("name"))


@query
def validation_results(spark, d):
    return Inputs(spark, d).checked.select("record_id", "overall", "topology", "area_check", "semantic", "conflict_check", F.size("warnings").alias("n_warnings"))


@query
def validation_summary(spark, d):
    return harmonize.validation_summary(Inputs(spark, d).checked)


@query
def validation_list_page(spark, d):
    c = Inputs(spark, d).checked.where(F.col("area_check").isin("WARNING", "FAIL"))
    return c.orderBy(harmonize.status_rank(), "record_id").limit(50).select("record_id", "overall", "area_check")


@query
def confidence_scores(spark, d):
    return Inputs(spark, d).confident.select("record_id", "s_spatial", "s_geometry", "s_attribute", "s_temporal", "confidence", "bucket", "review_status")


@query
def confidence_summary(spark, d):
    return harmonize.confidence_summary(Inputs(spark, d).confident)


@query
def confidence_list_page(spark, d):
    c = Inputs(spark, d).confident.where((F.col("bucket") == "MEDIUM") & F.contains(F.lower("record_id"), F.lit("2")))
    return c.orderBy(F.col("confidence").desc(), "record_id").limit(50).select("record_id", "confidence", "review_status")


# ------------------------------------------------------------------ review, unified records, lineage, export


@query
def adjudication_queue(spark, d):
    return Inputs(spark, d).queue.select("record_id", "severity", "resolved", "mandatory", "confidence")


@query
def adjudication_list_page(spark, d):
    q = review.queue_filter(Inputs(spark, d).queue, severity="CRITICAL", conflict_type="RISK_CONFLICT")
    return q.orderBy("resolved", "confidence", "record_id").limit(50).select("record_id", "severity", "confidence")


@query
def review_summary(spark, d):
    return review.review_summary(Inputs(spark, d).queue)


UNIFIED = ("record_id", "decision", "resolution_status", "geometry_source", "land_use", "mutation", "risk", "area", "status")


@query
def unified_records(spark, d):
    return Inputs(spark, d).unified.select(*UNIFIED)


@query
def unified_stats(spark, d):
    return review.unified_summary(Inputs(spark, d).unified)


@query
def unified_list_page(spark, d):
    u = Inputs(spark, d).unified.where((F.col("status") == "ACTIVE") & (F.col("land_use").ilike("%res%") | F.col("record_id").ilike("%res%")))
    return u.orderBy("record_id").limit(50).select("record_id", "land_use", "area")


@query
def unified_identifiers(spark, d):
    return review.numbered(Inputs(spark, d).unified.select("a_id", "record_id"), ("a_id",)).select("record_id", "identifier")


@query
def lineage_completeness(spark, d):
    return Inputs(spark, d).lineage.select("record_id", "completeness_pct", "lineage_status", F.array_join("missing_stages", ",").alias("missing"))


@query
def lineage_edges(spark, d):
    return review.lineage_edges(_with_sources(Inputs(spark, d).unified))


def _with_sources(records: DataFrame) -> DataFrame:
    """Parcels are of one dataset, structures of another."""
    source = lambda c, name, role: F.struct(F.concat(F.lit(f"{name}-"), F.col(c).cast("string")).alias("feature_id"), F.lit(name).alias("dataset_id"), F.lit(role).alias("role"))
    return records.withColumn("sources", F.array(source("a_id", "parcels", "CADASTRAL"), source("b_id", "structures", "DRONE")))


@query
def lineage_nodes(spark, d):
    return review.lineage_nodes(_with_sources(Inputs(spark, d).lineage))


@query
def provenance_list_page(spark, d):
    return review.lineage_summary(Inputs(spark, d).lineage)


@query
def export_authoritative(spark, d):
    i = Inputs(spark, d)
    return review.deliverable(review.authoritative(i.unified).select("record_id", "a_id", "land_use", "mutation", "risk", "area", "confidence"), i.boxes)


@query
def export_readiness(spark, d):
    return review.readiness(Inputs(spark, d).lineage)


@query
def row_sha256(spark, d):
    return review.row_hash(Inputs(spark, d).table("customer"), ("c_custkey", "c_name", "c_nationkey", "c_mktsegment")).select("c_custkey", "sha256")


@query
def audit_timeline(spark, d):
    return review.timeline(Inputs(spark, d).table("events")).select("user_id", "event_id", "item")


@query
def latest_stage_run(spark, d):
    runs = Inputs(spark, d).fixture(fx.RUNS)
    return review.latest(runs, "stage", ("completed_at", "run_id")).select("stage", "run_id", "status")


@query
def latest_version(spark, d):
    e = Inputs(spark, d).table("events")
    return e.groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("latest"), F.count("*").alias("versions"))


@query
def stage_gate(spark, d):
    return review.gates(Inputs(spark, d).fixture(fx.RUNS))


# ------------------------------------------------------------------ graph and merges


def _edges(i: Inputs) -> DataFrame:
    """Accepted pairs; parcels are even, structures odd node numbers."""
    return i.ranked.where("status in ('matched', 'possible_match')").select((F.col("a_id") * 2).alias("u"), (F.col("b_id") * 2 + 1).alias("v"))


@query
def components(spark, d):
    return graph.components(_edges(Inputs(spark, d)))


@query
def component_members(spark, d):
    m = graph.members(graph.components(_edges(Inputs(spark, d))))
    return m.select("component", "size", F.array_join(F.transform("nodes", lambda x: x.cast("string")), ",").alias("nodes"))


def _stored(i: Inputs) -> DataFrame:
    """An earlier state of the conflicts: two thirds of them, some settled, and one that is gone."""
    c = i.conflicts.select("idempotency_key", "severity", F.length("idempotency_key").alias("n"))
    state = F.when(F.col("n") % 5 == 0, "RESOLVED").when(F.col("n") % 5 == 1, "IN_REVIEW").otherwise("OPEN")
    old = c.where("n % 3 <> 0").select("idempotency_key", F.lit("LOW").alias("severity"), state.alias("status"))
    return old.unionByName(i.spark.createDataFrame([("gone", "HIGH", "OPEN")], "idempotency_key string, severity string, status string"))


@query
def merge_idempotent(spark, d):
    i = Held(spark, d)
    return merge.merge(_stored(i), i.conflicts.select("idempotency_key", "severity", "status"), "idempotency_key")


@query
def merge_changes(spark, d):
    i = Held(spark, d)
    return merge.changes(merge.merge(_stored(i), i.conflicts.select("idempotency_key", "severity", "status"), "idempotency_key"))


@query
def merge_events(spark, d):
    e = Inputs(spark, d).table("events").select("user_id", "event_type")
    return merge.append_absent(e.where("user_id % 2 = 0").distinct(), e, ("user_id", "event_type"))


# ------------------------------------------------------------------ analyses


@query
def proximity_nearest_ref(spark, d):
    i = Inputs(spark, d)
    return analysis.nearest_reference(i.parcels.select("a_id", *(f"a_{c}" for c in ("x1", "y1", "x2", "y2"))), i.assets, 200.0)


@query
def knn_assets(spark, d):
    i = Inputs(spark, d)
    q = i.assets.select(F.col("b_id").alias("a_id"), *(F.col(f"b_{c}").alias(f"a_{c}") for c in ("x1", "y1", "x2", "y2")))
    return analysis.nearest(i.assets, q, 5, (150.0, 600.0, 50_000.0))


@query
def intersection_pairs(spark, d):
    i = Inputs(spark, d)
    return analysis.intersections(i.parcels, i.structures, 5.0).select("a_id", "b_id", "overlap_m2", "overlap_pct")


@query
def containment_pairs(spark, d):
    i = Inputs(spark, d)
    return analysis.containments(i.parcels, i.structures, strict=True).select("a_id", "b_id")


@query
def buffer_hits(spark, d):
    i = Inputs(spark, d)
    return analysis.buffer_hits(i.parcels, i.assets, 60.0).select("a_id", "b_id")


@query
def dataset_compare(spark, d):
    i = Inputs(spark, d)
    return analysis.compare(i.parcels, i.structures)


@query
def version_diff(spark, d):
    i = Inputs(spark, d)
    return analysis.version_diff(i.fixture(fx.VERSION_1), i.fixture(fx.VERSION_2), "id", ("owner", "kind"))


@query
def spatial_statistics(spark, d):
    return analysis.statistics(Inputs(spark, d).boxes)


@query
def conflict_clusters(spark, d):
    i = Inputs(spark, d)
    return analysis.clusters(i.conflicts, i.boxes).drop("cluster_id")


@query
def near_coordinates(spark, d):
    return analysis.near(Inputs(spark, d).fixture(fx.ASSETS), 73.86, 18.522, 1500.0).select("id", "metres")


@query
def proximity_stats(spark, d):
    i = Inputs(spark, d)
    n = analysis.nearest_reference(i.parcels.select("a_id", *(f"a_{c}" for c in ("x1", "y1", "x2", "y2"))), i.assets, 200.0)
    return n.agg(F.count("*").alias("n"), F.min("metres").alias("least"), F.max("metres").alias("most"), F.round(F.avg(F.col("metres").cast("decimal(20,2)")).cast("double"), 3).alias("mean"))


@query
def pair_metrics(spark, d):
    a, b = geo.Box("a_"), geo.Box("b_")
    p = Inputs(spark, d).pairs
    return p.select("a_id", "b_id", F.round(geo.metric_area(a.area, a.cy), 1).alias("area_a"), F.round(geo.metric_area_series(b.area, b.cy), 1).alias("area_b"), F.round(geo.haversine(a.cx, a.cy, b.cx, b.cy), 3).alias("offset_m"))


@query
def crs_web_mercator(spark, d):
    x, y = geo.web_mercator("x1", "y1")
    return Inputs(spark, d).boxes.select("a_id", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


@query
def dataset_layers(spark, d):
    i = Inputs(spark, d)
    a = profile.extent(i.boxes).withColumns({"layer": F.lit("parcels"), "features": F.lit(1)})
    b = profile.extent(i.fixture(fx.ASSETS).select(*(F.col(c[0]).alias(c) for c in ("x1", "y1", "x2", "y2")))).withColumns({"layer": F.lit("assets"), "features": F.lit(2)})
    colours = F.array(*(F.lit(c) for c in ("#2563eb", "#16a34a", "#d97706", "#dc2626", "#7c3aed", "#0891b2")))
    return a.unionByName(b).withColumn("colour", F.element_at(colours, F.pmod(F.col("features") - 1, F.lit(6)) + 1)).drop("features")


# ------------------------------------------------------------------ profiles, attributes, search


@query
def profile_attributes(spark, d):
    return profile.attributes(Inputs(spark, d).table("customer"))


@query
def profile_extent(spark, d):
    return profile.extent(Inputs(spark, d).boxes)


@query
def profile_geometry(spark, d):
    p = Inputs(spark, d).table("part")
    kind = F.when(F.col("p_partkey") % 10 == 0, "Point").otherwise("Polygon")
    return profile.geometry(p.select(kind.alias("kind"), (F.col("p_partkey") % 33 != 0).alias("valid"), (F.col("p_partkey") % 50 == 0).alias("empty")))


@query
def attribute_conflicts_multi(spark, d):
    return attributes.multi_source(Inputs(spark, d).fixture(fx.VALUES))


@query
def conflict_advice(spark, d):
    return attributes.advice(Inputs(spark, d).fixture(fx.VALUES).where("value is not null"))


@query
def record_sources(spark, d):
    v = Inputs(spark, d).fixture(fx.VALUES)
    return attributes.sources_of(v.select("record_id", "source", F.col("attribute").alias("feature_id")))


@query
def record_conflict_counts(spark, d):
    i = Inputs(spark, d)
    state = F.when(F.length("record_id") % 3 == 0, "RESOLVED").when(F.length("record_id") % 3 == 1, "OPEN").otherwise("DISMISSED")
    return attributes.conflict_states(i.conflicts.withColumn("status", state))


@query
def record_status_legacy(spark, d):
    i = Inputs(spark, d)
    areas = i.fixture(fx.VALUES).where("attribute = 'area_sqm' and record_id % 3 <> 0").select("record_id", "source", text.number("value").alias("area"))
    return attributes.record_status(areas, i.fixture(fx.DECISIONS).where("action = 'REJECT_UNRESOLVED'").select(F.col("parcel").alias("record_id")))


@query
def attribute_search(spark, d):
    return assistant.first_match(Inputs(spark, d).table("customer"), ("c_name", "c_mktsegment"), "build").select("c_custkey", "matched_field")


@query
def document_search(spark, d):
    return Inputs(spark, d).table("documents").where(F.col("text").ilike("%license%")).select("doc_id", "source")


@query
def vector_topk(spark, d):
    v = Inputs(spark, d).table("embeddings")
    # The query vector is one row.
    q = [float(x) for x in v.where("vec_id = 0").select("embedding").first()[0]]
    return assistant.top(v, q, 10, "vec_id", "embedding")


@query
def hashed_embedding_search(spark, d):
    return assistant.search(Inputs(spark, d).table("documents").select("doc_id", "text"), "license of the work", 10)


@query
def intent_route(spark, d):
    return Inputs(spark, d).table("conversations").select("conv_id", "turn", assistant.intent("text").alias("intent"))


@query
def grounding_score(spark, d):
    i = Inputs(spark, d)
    answers = i.table("orders").select(F.col("o_orderkey").alias("answer_id"), F.concat(F.lit("Order of "), F.lower("o_orderpriority"), F.lit(" status "), F.col("o_orderstatus")).alias("answer"))
    some = ("urgent", "high", "status f", "medium", "LOW")
    evidence = i.table("orders").where("o_orderkey % 7 <> 0").select(F.col("o_orderkey").alias("answer_id"), F.explode(F.array(*map(F.lit, some))).alias("identifier"))
    return assistant.grounding(answers, evidence)


@query
def kb_documents(spark, d):
    return assistant.record_documents(Inputs(spark, d).unified.where("resolution_status = 'UNIFIED'"))


@query
def project_summary(spark, d):
    i = Inputs(spark, d)
    return i.unified.groupBy("status", "resolution_status").agg(F.count("*").alias("records"), F.sum("conflict_count").alias("conflicts"))
