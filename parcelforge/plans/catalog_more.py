"""Further queries of the library, in the same form; importing this module registers them."""

from __future__ import annotations

from pyspark.sql import functions as F

from parcelforge.functions import geo, poly, scoring, text
from parcelforge.operators import assistant, analysis, attributes, cascade, matching, merge
from parcelforge.plans import fixtures as fx
from parcelforge.plans.catalog import QUERIES, Held, Inputs, query
from parcelforge.session import stored

__all__ = ["QUERIES"]


def _wkt(p: str):
    """A box as a polygon's text."""
    at = lambda x, y: F.concat_ws(" ", F.col(f"{p}{x}").cast("string"), F.col(f"{p}{y}").cast("string"))
    return F.concat(F.lit("POLYGON (("), F.concat_ws(", ", at("x1", "y1"), at("x2", "y1"), at("x2", "y2"), at("x1", "y2"), at("x1", "y1")), F.lit("))"))


@query
def polygon_overlap(spark, d):
    """The polygon kernel on boxes, behind a box test."""
    p = Inputs(spark, d).pairs.where(geo.intersects(geo.Box("a_"), geo.Box("b_")))
    return p.select("a_id", "b_id", F.round(poly.st_iou(_wkt("a_"), _wkt("b_")), 4).alias("iou"))


@query
def latest_review(spark, d):
    e = Inputs(spark, d).table("events")
    return e.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("decision"), F.count("*").alias("reviews"))


@query
def match_resolution_cascade(spark, d):
    i = Inputs(spark, d)
    k = F.col("p_partkey")
    records = i.table("part").select(k.alias("record_id"), F.when(k % 3 == 0, k).alias("trail_match"), F.when(k % 5 == 0, k + 7).alias("decision_match"), k.alias("x"), (k + 1).alias("y"))
    matches = i.table("part").select((k * 2).alias("match_id"), (k * 2).alias("u"), (k * 2 + 1).alias("v"))
    return cascade.resolve_match(records, matches)


@query
def record_geometry_winner(spark, d):
    v = Inputs(spark, d).fixture(fx.VALUES)
    return cascade.geometry_winner(v.select("record_id", text.source_role("source").alias("role"), F.col("attribute").alias("feature_id")))


@query
def record_status_transition(spark, d):
    i = Inputs(spark, d)
    state = F.when(F.length("record_id") % 3 == 0, "RESOLVED").when(F.length("record_id") % 3 == 1, "OPEN").otherwise("DISMISSED")
    return cascade.transition(i.conflicts.withColumn("status", state))


@query
def decision_cascade(spark, d):
    i = Inputs(spark, d)
    return cascade.decide(i.conflicts.select("record_id", "a_id", "conflict_type", "severity", "status"), i.decisions, on="a_id").groupBy("status", "conflict_type").agg(F.count("*").alias("n"))


@query
def demo_review_seed(spark, d):
    i = Inputs(spark, d)
    reviewed = i.parcels.where("a_id % 4 = 0").select("a_id")
    return cascade.seed_reviews(i.ranked, reviewed).select("a_id", "b_id", "decision")


@query
def merge_attribute_conflicts(spark, d):
    i = Inputs(spark, d)
    # Stored, as both sides of the merge follow from it.
    found = stored(attributes.multi_source(i.fixture(fx.VALUES)).select(F.concat_ws(":", F.col("record_id").cast("string"), "attribute").alias("key"), "conflict_type", F.lit("UNRESOLVED").alias("status")), "attribute-conflicts")
    old = found.where("length(key) % 2 = 0").withColumn("status", F.when(F.length("key") % 4 == 0, "RESOLVED").otherwise("UNRESOLVED")).withColumn("conflict_type", F.lit("OLD"))
    return merge.merge(old, found, "key", reset="UNRESOLVED", kept=("RESOLVED", "DISMISSED"))


@query
def merge_validation(spark, d):
    i = Held(spark, d)
    new = i.checked.select(F.concat(F.lit("p1:"), F.col("record_id")).alias("key"), F.col("overall").alias("status"))
    old = i.records.where("a_id % 3 = 0").select(F.concat(F.lit("p1:"), F.col("record_id")).alias("key"), F.lit("OLD").alias("status"))
    return merge.upsert(old, new, "key")


@query
def suggested_questions(spark, d):
    i = Inputs(spark, d)
    return cascade.suggestions(i.unified.select("status", "decision", F.col("conflict_count").alias("unresolved")))


@query
def record_questions(spark, d):
    return cascade.record_suggestions(Inputs(spark, d).unified.select("record_id", "status", F.col("conflict_count").alias("unresolved")))


@query
def answer_grounding(spark, d):
    """Answers about orders, and evidence that some of them name by identifier, part of it, attribute or dataset."""
    o = Inputs(spark, d).table("orders")
    answers = o.select(F.col("o_orderkey").alias("answer_id"), F.concat(F.lit("Order "), F.col("o_orderkey").cast("string"), F.lit(" has priority "), "o_orderpriority", F.lit(" in Sales.")).alias("answer"))
    place = lambda k, i, ds, at: F.struct(F.lit(k).alias("place"), i.alias("identifier"), F.lit(ds).cast("string").alias("dataset_name"), F.lit(at).cast("string").alias("attribute_name"))
    pool = F.array(place(1, F.col("o_orderkey").cast("string"), None, None), place(2, F.concat(F.lit("X"), F.col("o_custkey").cast("string"), F.lit(":URGENT")), None, None), place(3, F.concat(F.lit("status-"), F.col("o_orderstatus")), "sales", None), place(4, F.lit("none"), None, "Priority"), place(5, F.lit("nothing"), "Survey", "area"))
    evidence = o.where("o_orderkey % 7 <> 0").select(F.col("o_orderkey").alias("answer_id"), F.explode(pool).alias("e")).select("answer_id", "e.*")
    return assistant.grounded(answers, evidence).select("answer_id", "score", F.size("cited").alias("n"), F.array_join("cited", ";").alias("cited"))


@query
def property_normalize(spark, d):
    e = Inputs(spark, d).table("events").select("event_id", F.from_json("props", "map<string,string>").alias("props"))
    low = text.lower_view("props")
    keys = F.array_join(F.array_sort(F.map_keys(low)), ",")
    return e.select("event_id", keys.alias("keys"), text.first_of("props", ("missing", "k", "a", "id", "page", "ref")).alias("first_value"), F.size("props").alias("n"))


@query
def explanation_text(spark, d):
    s = Inputs(spark, d).scored
    part = lambda label, c: F.when(F.col(c) >= 0.7, F.concat(F.lit(f"strong {label} "), F.round(F.col(c) * 100, 0).cast("int").cast("string"), F.lit("%"))).when(F.col(c) < 0.25, F.lit(f"weak {label}"))
    reasons = F.array_compact(F.array(part("overlap", "spatial"), part("area", "area"), part("position", "centroid"), part("attributes", "attribute")))
    return s.select("a_id", "b_id", F.array_join(reasons, "; ").alias("reasons"), scoring.category(F.col("status")).alias("category"))


@query
def combined_layers(spark, d):
    i = Inputs(spark, d)
    a = i.boxes.select(F.lit("parcels").alias("layer"), F.col("a_id").alias("id"), F.round("x1", 6).alias("x"), F.round("y1", 6).alias("y"))
    b = i.fixture(fx.ASSETS).select(F.lit("assets").alias("layer"), "id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))
    return a.unionByName(b)


@query
def attribute_key_diff(spark, d):
    e = Inputs(spark, d).table("events").select("event_id", F.map_keys(F.from_json("props", "map<string,string>")).alias("keys"))
    base = F.array(F.lit("page"), F.lit("ref"), F.lit("k"))
    show = lambda a: F.array_join(F.array_sort(a), ",")
    return e.select("event_id", show(F.array_except("keys", base)).alias("added"), show(F.array_except(base, F.col("keys"))).alias("removed"), F.size(F.array_union("keys", base)).alias("all_keys"))


@query
def candidate_pairs_left_all(spark, d):
    i = Inputs(spark, d)
    return matching.left_candidates(i.parcels, i.structures).select("a_id", "b_id", F.round("distance", 4).alias("distance"), "relationship")


@query
def unmatched_parcels_all(spark, d):
    i = Inputs(spark, d)
    return analysis.only(i.parcels, i.structures).select("a_id")


@query
def merge_unified_all(spark, d):
    """All unified records over an earlier state."""
    i = Held(spark, d)
    old = i.records.where("a_id % 2 = 0").select("record_id", F.lit("OLD").alias("status"))
    return merge.upsert(old, i.unified.select("record_id", "status"), "record_id")
