"""Human decisions, unified records, lineage and export readiness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelforge.functions import geo
from parcelforge.operators.harmonize import severity_rank
from parcelforge.operators.rank import global_rank

ACTIONS = ("ACCEPT_SOURCE_A", "ACCEPT_SOURCE_B", "MERGE_RECONCILE", "REJECT_UNRESOLVED")


def latest(log: DataFrame, key: str, order: tuple[str, ...]) -> DataFrame:
    """The last row of each key of an append-only log."""
    w = Window.partitionBy(key).orderBy(*(F.col(c).desc() for c in order))
    return log.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def mandatory() -> Column:
    """A record that a human must decide."""
    return (F.col("bucket") != "HIGH") | (F.col("critical") > 0) | (F.col("overall") == "FAIL")


def queue(scored: DataFrame, decisions: DataFrame, found: DataFrame | None = None, on: str = "record_id") -> DataFrame:
    """Records with their decision and most severe open conflict; undecided first, then severe, then doubtful.

    found: conflicts with their states; without, the records carry ``worst`` and ``conflict_types`` themselves.
    """
    out = scored.join(decisions.select(on, "action", "decided_at").hint("merge"), on, "left")
    if found is not None:
        worst = found.groupBy("record_id").agg(F.min(severity_rank()).alias("worst"), F.sort_array(F.collect_set("conflict_type")).alias("conflict_types"))
        out = out.drop("worst", "conflict_types").join(worst, "record_id", "left")
    severity = F.coalesce(F.get(F.array(*(F.lit(s) for s in ("CRITICAL", "HIGH", "MEDIUM", "LOW"))), F.col("worst") - 1), F.lit("NONE"))
    out = out.withColumns({"severity": severity, "resolved": F.col("action").isNotNull(), "mandatory": mandatory()})
    return out.orderBy("resolved", severity_rank("severity"), "confidence", "record_id")


def queue_filter(items: DataFrame, severity: str = "ALL", conflict_type: str = "ALL", bucket: str = "ALL", validation: str = "ALL", search: str = "") -> DataFrame:
    out = items
    for c, v in (("severity", severity), ("bucket", bucket), ("overall", validation)):
        out = out if v == "ALL" else out.where(F.col(c) == v)
    if conflict_type != "ALL":
        out = out.where(F.exists(F.coalesce("conflict_types", F.array().cast("array<string>")), lambda t: t == conflict_type))
    return out.where(F.contains(F.lower("record_id"), F.lit(search.lower()))) if search else out


def review_summary(items: DataFrame) -> DataFrame:
    n = lambda c: F.count_if(c)
    done = F.col("resolved")
    out = items.agg(
        F.count("*").alias("total"),
        n(F.col("mandatory")).alias("mandatory"),
        n(done).alias("resolved"),
        n(F.col("mandatory") & ~done).alias("pending"),
        *(n(F.col("action") == a).alias(a.lower()) for a in ACTIONS),
        n(F.col("bucket") == "AMBIGUOUS").alias("ambiguous"),
        n(F.col("severity") == "CRITICAL").alias("critical"),
        F.max("decided_at").alias("last_decision"),
    )
    progress = F.when(F.col("mandatory") > 0, F.round((F.col("mandatory") - F.col("pending")) * 100 / F.col("mandatory"), 1)).otherwise(100.0)
    return out.withColumn("progress_pct", progress).withColumn("stage_status", F.when(F.col("pending") == 0, "completed").when(F.col("resolved") > 0, "in_progress").otherwise("pending"))


def unified(scored: DataFrame, decisions: DataFrame, on: str = "record_id") -> DataFrame:
    """Records by precedence: the human decision, otherwise the harmonised values."""
    r = scored.join(decisions.select(on, "action", "chosen_area", "decided_at").hint("merge"), on, "left")
    act = F.col("action")
    a, b, merged, reject = (F.coalesce(act == x, F.lit(False)) for x in ACTIONS)

    def pick(source: str, candidate: str, joint: str, rejected: Column) -> Column:
        return F.when(reject, rejected).when(a, F.coalesce(source, joint)).when(b, F.coalesce(candidate, joint)).otherwise(F.col(joint))

    none = F.lit(None).cast("string")
    area = F.when(reject, F.lit(None).cast("double")).when(a, F.coalesce("source_area", "harmonized_area")).when(b, F.coalesce("candidate_area", "harmonized_area")).when(merged, F.coalesce("chosen_area", "harmonized_area")).otherwise(F.col("harmonized_area"))
    resolution = F.when(reject, "REJECTED").otherwise("UNIFIED")
    out = r.select(
        "record_id", "a_id", "b_id",
        F.coalesce(act, F.lit("AUTO_CONFIRMED")).alias("decision"),
        resolution.alias("resolution_status"),
        F.when(reject, "REJECTED").when(a, "SOURCE_A").when(b, "SOURCE_B").otherwise(F.col("geometry_source")).alias("geometry_source"),
        pick("source_land_use", "candidate_land_use", "land_use", none).alias("land_use"),
        pick("source_mutation", "candidate_mutation", "mutation", none).alias("mutation"),
        pick("source_risk", "candidate_risk", "risk", F.lit("CRITICAL")).alias("risk"),
        area.alias("area"), "confidence", "bucket", F.col("overall").alias("validation"), "decided_at", "conflict_count", (F.col("geometry_check") != "FAIL").alias("geometry_valid"),
    )
    state = F.when(F.col("resolution_status") == "REJECTED", "CONFLICT").when(F.col("geometry_valid") & F.col("area").isNotNull(), "ACTIVE").otherwise("INCOMPLETE")
    return out.withColumn("status", state)


def numbered(records: DataFrame, order: tuple[str, ...], base: int = 0, prefix: str = "ULR", name: str = "identifier") -> DataFrame:
    """Sequential identifiers in a fixed order, without a task that sees all rows."""
    ranked = global_rank(records, order, "_n")
    return ranked.withColumn(name, F.format_string(f"{prefix}-%06d", F.col("_n") + base)).drop("_n")


def unified_summary(records: DataFrame) -> DataFrame:
    done = F.col("resolution_status") == "UNIFIED"
    mean = F.round(F.avg(F.when(done, F.col("confidence").cast("decimal(20,6)"))).cast("double"), 4)
    return records.agg(F.count("*").alias("considered"), F.count_if(done).alias("unified"), F.count_if(~done).alias("rejected"), F.count_if(F.col("status") == "ACTIVE").alias("active"), F.count_if(F.col("decision") == "AUTO_CONFIRMED").alias("auto_confirmed"), mean.alias("average_confidence"))


def trail(items: DataFrame) -> DataFrame:
    """(record_id, trail): how each record of the queue came about, as one JSON object of nested blocks."""
    pick = lambda *cs: F.struct(*cs)
    blocks = F.struct(
        pick("a_id", "b_id", "score", "role").alias("matching"),
        pick("geometry_source", "geometry_status", "harmonized_area", "area_pct", "land_use", "mutation", "risk").alias("harmonization"),
        F.struct(F.col("conflicts").alias("conflict_count"), F.coalesce("conflict_types", F.array().cast("array<string>")).alias("conflict_types"), "severity").alias("conflicts"),
        F.struct(F.col("overall").alias("overall_status"), "warnings").alias("validation"),
        F.struct("confidence", "bucket", "s_spatial", "s_geometry", "s_attribute", "s_temporal").alias("confidence"),
        F.struct(F.coalesce("action", F.lit("AUTO_CONFIRMED")).alias("decision"), F.col("resolved").alias("adjudicated"), "decided_at").alias("human_review"),
    )
    whole = F.struct("record_id", blocks.alias("pipeline_lineage"))
    return items.select("record_id", F.to_json(whole, {"ignoreNullFields": "false"}).alias("trail"))


def role_statistics(sources: DataFrame) -> DataFrame:
    """Of (record_id, role), a row per contributing feature: distinct records of each role, and sources per record."""
    n = lambda role: F.count_distinct(F.when(F.col("role") == role, F.col("record_id")))
    return sources.agg(
        F.count_distinct("record_id").alias("records"),
        F.round(F.count("*") / F.count_distinct("record_id"), 2).alias("average_sources"),
        n("CADASTRAL").alias("with_cadastral"), n("DRONE").alias("with_drone"), n("MUNICIPAL").alias("with_municipal"),
    )


# ------------------------------------------------------------------ lineage


def lineage(records: DataFrame) -> DataFrame:
    """Completeness over nine stages, what is missing, and the lineage status."""
    checks = {
        "DATASET_INGESTION": F.col("a_id").isNotNull(),
        "FEATURE_NORMALIZATION": F.col("a_id").isNotNull(),
        "FEATURE_MATCHING": F.col("b_id").isNotNull(),
        "HARMONIZATION": F.col("record_id").isNotNull(),
        "CONFLICT_DETECTION": F.lit(True),
        "VALIDATION": F.col("validation").isNotNull(),
        "CONFIDENCE_SCORING": F.col("confidence").isNotNull(),
        "HUMAN_REVIEW": F.col("decided_at").isNotNull(),
        "UNIFIED_RECORD": F.col("resolution_status").isNotNull(),
    }
    missing = F.array_compact(F.array(*(F.when(~ok, F.lit(name)) for name, ok in checks.items())))
    out = records.withColumn("missing_stages", missing)
    out = out.withColumn("completeness_pct", F.round((9 - F.size("missing_stages")) / 9.0 * 100, 1))
    state = F.when(F.col("resolution_status") == "REJECTED", "QUARANTINED").when(F.size("missing_stages") == 0, "COMPLETE").otherwise("PARTIAL")
    return out.withColumn("lineage_status", state)


#: The kinds of nodes of a record's lineage graph, and the stage each stands for.
NODES = {"DATASET": 1, "FEATURE": 4, "MATCH": 6, "HARMONIZATION": 7, "CONFLICT": 8, "VALIDATION": 9, "CONFIDENCE": 10, "HUMAN_REVIEW": 11, "UNIFIED_RECORD": 12, "PROVENANCE": 13}
#: What leads from one node of a record to the next.
CHAIN = (
    ("match", "harmonization", "HARMONIZED_INTO"), ("harmonization", "conflict", "EVALUATED_FOR_CONFLICTS"), ("conflict", "validation", "VALIDATED_BY"), ("validation", "confidence", "SCORED_BY"),
    ("confidence", "review", "ADJUDICATED_IN"), ("review", "unified", "SYNTHESIZED_AS"), ("unified", "provenance", "ANCHORS_LINEAGE"),
)


def _node(kind: str, value: Column) -> Column:
    return F.concat(F.lit(f"{kind}_"), value.cast("string"))


def lineage_edges(records: DataFrame) -> DataFrame:
    """The edges of each record's lineage graph: its features' datasets, the pair, and the stages from match to provenance.

    sources: an array of structs (feature_id, dataset_id, role) of each record; an edge from a dataset is only there
    where that is known.
    """
    edge = lambda a, b, kind: F.struct(a.alias("source"), b.alias("target"), F.lit(kind).alias("kind"))
    own = F.col("record_id")
    from_sets = F.transform(F.filter("sources", lambda x: x.dataset_id.isNotNull()), lambda x: edge(_node("dataset", x.dataset_id), _node("feature", x.feature_id), "NORMALIZED_FROM"))
    paired = F.transform("sources", lambda x: edge(_node("feature", x.feature_id), _node("match", own), "PAIRED_IN"))
    chain = F.array(*(edge(_node(a, own), _node(b, own), kind) for a, b, kind in CHAIN))
    return records.select("record_id", F.explode(F.concat(from_sets, paired, chain)).alias("e")).select("record_id", "e.*")


def lineage_nodes(records: DataFrame) -> DataFrame:
    """The nodes of each record's lineage graph: id, type, stage and status. A dataset is a node of each record it is in."""
    own = F.col("record_id")
    node = lambda i, kind, status: F.struct(i.alias("id"), F.lit(kind).alias("type"), F.lit(NODES[kind]).alias("stage"), status.alias("status"))
    done = F.lit("COMPLETED")
    known = F.array_distinct(F.transform(F.filter("sources", lambda x: x.dataset_id.isNotNull()), lambda x: x.dataset_id.cast("string")))
    sets = F.transform(known, lambda d: node(_node("dataset", d), "DATASET", done))
    features = F.transform("sources", lambda x: node(_node("feature", x.feature_id), "FEATURE", done))
    conflicts = F.when(F.col("decided_at").isNotNull(), "RESOLVED").when(F.col("conflict_count") > 0, "OPEN").otherwise("NONE")
    rest = F.array(
        node(_node("match", own), "MATCH", done),
        node(_node("harmonization", own), "HARMONIZATION", done),
        node(_node("conflict", own), "CONFLICT", conflicts),
        node(_node("validation", own), "VALIDATION", F.coalesce("validation", F.lit("PASS"))),
        node(_node("confidence", own), "CONFIDENCE", F.col("bucket")),
        node(_node("review", own), "HUMAN_REVIEW", F.lit("ADJUDICATED")),
        node(_node("unified", own), "UNIFIED_RECORD", F.col("resolution_status")),
        node(_node("provenance", own), "PROVENANCE", F.col("lineage_status")),
    )
    return records.select("record_id", F.explode(F.concat(sets, features, rest)).alias("n")).select("record_id", "n.*")


def lineage_summary(records: DataFrame) -> DataFrame:
    s = F.col("lineage_status")
    mean = F.round(F.avg(F.col("completeness_pct").cast("decimal(10,2)")).cast("double"), 2)
    return records.agg(F.count("*").alias("total"), F.count_if(s == "COMPLETE").alias("complete"), F.count_if(s == "PARTIAL").alias("partial"), F.count_if(s == "QUARANTINED").alias("quarantined"), mean.alias("average_completeness"))


def timeline(events: DataFrame, key: str = "user_id") -> DataFrame:
    """Events of each key in time order, numbered."""
    w = Window.partitionBy(key).orderBy("ts", "event_id")
    return events.withColumn("item", F.row_number().over(w))


# ------------------------------------------------------------------ export


def authoritative(records: DataFrame, include_quarantined: bool = False) -> DataFrame:
    return records if include_quarantined else records.where("resolution_status = 'UNIFIED'")


def deliverable(records: DataFrame, boxes: DataFrame) -> DataFrame:
    """The CSV deliverable: a row for each record with its centroid to seven places."""
    box = geo.Box()
    at = records.join(boxes.hint("merge"), "a_id")
    return at.select("record_id", "land_use", "mutation", "risk", "area", F.round("confidence", 4).alias("confidence"), F.round(box.cy, 7).alias("lat"), F.round(box.cx, 7).alias("lon"))


def readiness(records: DataFrame) -> DataFrame:
    n = lambda c: F.count_if(c)
    traced = F.round(n(F.col("lineage_status").isin("COMPLETE", "PARTIAL")) * 100.0 / F.count("*"), 1)
    return records.agg(F.count("*").alias("total"), n(F.col("resolution_status") == "UNIFIED").alias("authoritative"), n(F.col("resolution_status") == "REJECTED").alias("quarantined"), n(F.col("status") == "INCOMPLETE").alias("incomplete"), traced.alias("provenance_pct"))


def row_hash(df: DataFrame, columns: tuple[str, ...], name: str = "sha256") -> DataFrame:
    return df.withColumn(name, F.sha2(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)), 256))


# ------------------------------------------------------------------ gating

#: The stages in their order.
STAGES = ("ingestion", "profiling", "crs_normalization", "schema_normalization", "candidate_generation", "feature_matching", "harmonization", "conflict_detection", "validation", "confidence_scoring", "human_review", "unified_record", "provenance", "export")


def gates(runs: DataFrame) -> DataFrame:
    """Of each of the stages 1 to 14: its last status, and whether it may run (its predecessor is completed)."""
    spark = runs.sparkSession
    names = spark.createDataFrame([(k + 1, s) for k, s in enumerate(STAGES)], "stage int, name string")
    last = runs.groupBy("stage").agg(F.max_by("status", F.struct("completed_at", "run_id")).alias("status"))
    state = names.join(F.broadcast(last), "stage", "left").withColumn("status", F.coalesce("status", F.lit("pending")))  # fourteen rows
    before = state.select((F.col("stage") + 1).alias("stage"), F.col("status").alias("before"))
    out = state.join(F.broadcast(before), "stage", "left")
    return out.select("stage", "name", "status", (F.col("before").isNull() | (F.col("before") == "completed")).alias("may_run"))
