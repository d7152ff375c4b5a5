"""Decisions on records and what they bring about: conflicts, matches, review log and events, in one run.

Decisions are a frame (record_id, action, notes, reviewer, geometry_source, attributes, decided_at), as many as there
are; those that lack something are given back with the reason, the others are applied together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelforge.operators.decisions import GEOMETRIES, MERGE_FIELDS
from parcelforge.operators.review import ACTIONS
from parcelforge.session import stored
from parcelforge.store import Run

#: What a decision makes of a match, and the reviews that a match may get.
REVIEWS = ("ACCEPTED", "REJECTED", "FLAGGED")
REVIEWER = "Lead GIS Adjudicator"


def refusal() -> Column:
    """Why a decision joined with its record can't be taken, or null."""
    note = F.trim(F.coalesce("notes", F.lit(""))) != ""
    serious = F.col("critical") | (F.col("validation_status") == "FAIL")
    needs = F.col("action").isin("REJECT_UNRESOLVED", "MERGE_RECONCILE") | serious
    return (
        F.when(F.col("critical").isNull(), "no such record")
        .when(~F.coalesce(F.col("action").isin(*ACTIONS), F.lit(False)), "unknown action")
        .when(needs & ~note, "a note is needed")
        .when((F.col("action") == "MERGE_RECONCILE") & ~F.coalesce(F.col("geometry_source").isin(*GEOMETRIES), F.lit(False)), "a merge names its geometry")
    )


def checked(decisions: DataFrame, items: DataFrame) -> DataFrame:
    """Decisions with their record's state, ``refused`` and what they result in; of several on a record the last counts.

    items: (record_id, a_id, b_id, match_id, critical, validation_status, confidence, conflict_count).
    """
    last = decisions.groupBy("record_id").agg(F.max_by(F.struct(*(c for c in decisions.columns if c != "record_id")), F.struct("decided_at", "action")).alias("d")).select("record_id", "d.*")
    out = last.join(items.select("record_id", "a_id", "b_id", "match_id", F.coalesce("critical", F.lit(False)).alias("critical"), F.coalesce("validation_status", F.lit("PASS")).alias("validation_status"), "confidence", "conflict_count").hint("merge"), "record_id", "left")
    rejected = F.col("action") == "REJECT_UNRESOLVED"
    attributes = F.when(F.col("action") == "MERGE_RECONCILE", F.map_filter("attributes", lambda k, _: k.isin(*MERGE_FIELDS)))
    return out.withColumns(
        {
            "refused": refusal(),
            "notes": F.trim(F.coalesce("notes", F.lit(""))),
            "reviewer": F.coalesce(F.nullif(F.trim("reviewer"), F.lit("")), F.lit(REVIEWER)),
            "attributes": F.coalesce(attributes, F.create_map().cast("map<string,string>")),
            "status": F.when(rejected, "REJECTED").otherwise("RESOLVED"),
            "review": F.when(rejected, "REJECTED").otherwise("ACCEPTED"),
            "override": (F.col("critical") | (F.col("validation_status") == "FAIL")) & ~rejected,
        }
    )


DECISION = ("record_id", "a_id", "b_id", "match_id", "action", "status", "reviewer", "notes", "geometry_source", "attributes", "previous_action", "confidence", "validation_status", "conflict_count", "override", "decided_at")


def adjudicate(run: Run, decisions: DataFrame, items: DataFrame) -> DataFrame:
    """Applies decisions to ``decisions`` (by record_id), ``conflicts`` (by conflict_id), ``matches`` (by match_id), and
    appends to ``match_reviews`` and ``events``; returns (record_id, refused) of those not taken.

    Machine scores, ranks and roles of matches are left as they are.
    """
    every = stored(checked(decisions, items), "decisions")
    taken = every.where("refused is null")
    previous = run.near("decisions", taken).select("record_id", F.col("action").alias("previous_action")) if "decisions" in run.tables else None
    known = taken.join(previous, "record_id", "left") if previous is not None else taken.withColumn("previous_action", F.lit(None).cast("string"))
    known = stored(known, "decisions-taken")
    run.merge("decisions", known.select(*DECISION), ["record_id"])
    if "conflicts" in run.tables:
        state = F.when(F.col("review") == "ACCEPTED", "RESOLVED").otherwise("UNRESOLVED")
        names = run.read("conflicts").columns
        settled = run.read("conflicts").drop("status").join(known.select("record_id", state.alias("status")).hint("merge"), "record_id").select(*names)
        run.merge("conflicts", stored(settled, "decisions-conflicts"), ["conflict_id"])
    comment = F.concat(F.lit("Stage 11 ["), "action", F.lit("]"), F.when(F.col("notes") != "", F.concat(F.lit(": "), "notes")).otherwise(""))
    asked = known.where("match_id is not null").select("match_id", F.col("review").alias("decision"), comment.alias("comment"), F.lit(None).cast("string").alias("reviewer_id"), F.col("decided_at").alias("created_at"))
    reviewed(run, asked)
    state = F.to_json(F.struct("action", "status", "reviewer", "notes", "geometry_source", "attributes", "override", "previous_action", "confidence", "validation_status", "conflict_count"), {"ignoreNullFields": "false"})
    run.append("events", known.select("record_id", F.when(F.col("override"), "HUMAN_REVIEW_OVERRIDE").otherwise("HUMAN_REVIEW_DECISION").alias("event_type"), F.lit("PIPELINE_STAGE_11").alias("source_type"), state.alias("metadata"), F.col("decided_at").alias("created_at")))
    return every.where("refused is not null").select("record_id", "refused")


def reviewed(run: Run, reviews: DataFrame) -> None:
    """Reviews (match_id, decision, comment, reviewer_id, created_at) of matches: each is appended to the log, the last
    one of a match is its review status.  Reviews of matches that are not there are left out; an unknown decision fails."""
    if "matches" not in run.tables:
        return
    ok = F.upper(F.trim("decision"))
    sure = F.when(ok.isin(*REVIEWS), ok).otherwise(F.raise_error(F.concat(F.lit("no such decision: "), F.coalesce("decision", F.lit("null")))).cast("string"))
    there = stored(reviews.withColumns({"decision": sure, "comment": F.nullif(F.trim("comment"), F.lit(""))}).join(run.near("matches", reviews).select("match_id"), "match_id", "left_semi"), "reviews")
    run.append("match_reviews", there.select("match_id", "decision", "comment", "reviewer_id", "created_at"))
    last = there.groupBy("match_id").agg(F.max_by("decision", F.struct("created_at", "decision")).alias("review_status"))
    names = run.read("matches").columns
    rows = run.near("matches", last).drop("review_status").join(last, "match_id").select(*names)
    run.merge("matches", stored(rows, "reviews-matches"), ["match_id"])
