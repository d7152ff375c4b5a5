"""Reconciled records, conflict rules, validation and confidence; each is a function from frame to frame."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelforge.functions import geo, text

#: Whose geometry wins.
GEOMETRY_PRECEDENCE = ("CADASTRAL", "DRONE", "MUNICIPAL", "OTHER")


def _filled(c: str) -> Column:
    return F.nullif(F.trim(F.col(c)), F.lit(""))


def differs(a: Column, b: Column) -> Column:
    return F.coalesce(F.lower(F.trim(a)) != F.lower(F.trim(b)), F.lit(False))


def box_state(box: geo.Box) -> Column:
    """VALID, NULL, EMPTY or why a box is no geometry."""
    corners = (box.x1, box.y1, box.x2, box.y2)
    null = F.lit(False)
    for c in corners:
        null = null | c.isNull()
    return F.when(null, "NULL").when((box.x2 < box.x1) | (box.y2 < box.y1), "corners in the wrong order").when(box.area == 0, "EMPTY").otherwise("VALID")


def _sound() -> Column:
    return (F.col("source_geometry_state") == "VALID") & (F.col("candidate_geometry_state") == "VALID")


def harmonized(best: DataFrame, source_role: str = "CADASTRAL", candidate_role: str = "DRONE", area_tolerance: float = 5.0) -> DataFrame:
    """A record for each best match: winning geometry, areas, attributes, and how many of them conflict."""
    order = {r: k for k, r in enumerate(GEOMETRY_PRECEDENCE)}
    source_wins = order.get(source_role, 99) <= order.get(candidate_role, 99)
    a, b = geo.Box("a_"), geo.Box("b_")
    explicit = lambda c: F.when(F.col(c) > 0, F.round(c, 2))
    src = F.coalesce(explicit("a_area"), geo.metric_area(a.area, a.cy))
    cand = F.coalesce(explicit("b_area"), geo.metric_area(b.area, b.cy))
    pct = F.round(F.abs(src - cand) / F.greatest(src, cand) * 100, 2)
    lu_a, lu_b, mu_a, mu_b, ri_a, ri_b = (_filled(c) for c in ("a_land_use", "b_land_use", "a_mutation", "b_mutation", "a_risk", "b_risk"))
    # How sound each geometry is: given, or for boxes by their corners.
    state = lambda p, box: F.coalesce(F.col(f"{p}_geometry_state"), F.lit("VALID")) if f"{p}_geometry_state" in best.columns else box_state(box)
    out = best.select(
        state("a", a).alias("source_geometry_state"), state("b", b).alias("candidate_geometry_state"),
        F.concat_ws("_", F.col("a_id").cast("string"), F.col("b_id").cast("string")).alias("record_id"),
        "a_id", "b_id", "score", "status", "role", "rank", "score_gap", "candidate_count", "spatial", "geometry", "attribute", "centroid_m",
        F.lit("SOURCE_A" if source_wins else "SOURCE_B").alias("geometry_source"),
        F.when(F.col("spatial") >= 0.85, "CONGRUENT").when(F.col("spatial") >= 0.5, "BOUNDARY_VARIANCE_RECONCILED").otherwise("AUTHORITATIVE_SELECTED").alias("geometry_status"),
        src.alias("source_area"), cand.alias("candidate_area"),
        (src if source_wins else F.coalesce(cand, src, F.lit(0.0))).alias("harmonized_area"),
        F.coalesce(pct, F.lit(0.0)).alias("area_pct"),
        lu_a.alias("source_land_use"), lu_b.alias("candidate_land_use"),
        (F.coalesce(lu_b, lu_a) if candidate_role == "MUNICIPAL" else F.coalesce(lu_a, lu_b)).alias("land_use"),
        mu_a.alias("source_mutation"), mu_b.alias("candidate_mutation"), F.coalesce(mu_a, mu_b).alias("mutation"),
        ri_a.alias("source_risk"), ri_b.alias("candidate_risk"), F.coalesce(ri_b, ri_a).alias("risk"),
        _filled("a_survey").alias("source_survey"), _filled("b_survey").alias("candidate_survey"),
    )
    n = lambda test: test.cast("int")
    count = n(differs(F.col("source_land_use"), F.col("candidate_land_use"))) + n(F.col("area_pct") > area_tolerance) + n(differs(F.col("source_mutation"), F.col("candidate_mutation"))) + n(differs(F.col("source_risk"), F.col("candidate_risk"))) + n(F.col("spatial") < 0.8)
    return out.withColumn("conflict_count", count).withColumn("has_conflicts", F.col("conflict_count") > 0)


# ------------------------------------------------------------------ conflict rules


@dataclass(frozen=True)
class ConflictConfig:
    # Per cent.
    area_low: float = 2.0
    area_medium: float = 5.0
    area_high: float = 15.0


#: Land uses that exclude each other.
INCOMPATIBLE = (
    ("AGRICULTURAL", "INDUSTRIAL"),
    ("AGRICULTURAL", "COMMERCIAL"),
    ("RESIDENTIAL", "INDUSTRIAL"),
    ("FOREST_GREEN", "INDUSTRIAL"),
    ("FOREST_GREEN", "COMMERCIAL"),
)


def _either(a: Column, b: Column, *values: str) -> Column:
    return a.isin(*values) | b.isin(*values)


#: Columns of the classes of a record's values.
_CLASSES = {f"_{k}_{p}": (f, f"{side}_{name}") for k, f, name in (("lu", text.land_use, "land_use"), ("mu", text.mutation, "mutation"), ("ri", text.risk, "risk")) for p, side in (("a", "source"), ("b", "candidate"))}


def settled(df: DataFrame, name: str, **values: Column) -> DataFrame:
    """Adds a struct of values that are made once for a row.

    An array of one is exploded: Spark moves no filter through that, which would spell the values out in full, and
    once more for each value that they are made of.
    """
    return df.select("*", F.explode_outer(F.array(F.struct(*(v.alias(k) for k, v in values.items())))).alias(name))


def with_broken_rules(records: DataFrame, config: ConflictConfig = ConflictConfig()) -> DataFrame:
    """Adds ``_broken``, the rules that a record breaks, as an array of structs.

    Classes and rules are projections of their own, so that each is made once for a row.
    """
    pct, iou, offset = F.col("area_pct"), F.col("spatial"), F.col("centroid_m")
    lu, mu, ri = ((F.col(f"_{k}_a"), F.col(f"_{k}_b")) for k in ("lu", "mu", "ri"))
    area = F.when(pct > config.area_high, "CRITICAL").when(pct >= config.area_medium, "HIGH").otherwise("MEDIUM")
    exclude = F.lit(False)
    for x, y in INCOMPATIBLE:
        exclude = exclude | ((lu[0] == x) & (lu[1] == y)) | ((lu[0] == y) & (lu[1] == x))
    land = F.when(exclude, "CRITICAL").when(_either(*lu, "RESIDENTIAL") & _either(*lu, "COMMERCIAL"), "HIGH").otherwise("MEDIUM")
    registry = F.when(_either(*mu, "DISPUTED", "REJECTED"), "CRITICAL").when(_either(*mu, "APPROVED") & _either(*mu, "PENDING"), "HIGH").otherwise("MEDIUM")
    hazard = F.when(_either(*ri, "CRITICAL", "HIGH") & _either(*ri, "LOW"), "CRITICAL").when(_either(*ri, "HIGH") & _either(*ri, "MEDIUM"), "HIGH").otherwise("MEDIUM")
    bounds = F.when(~_sound() | (iou < 0.5) | (offset > 25), "CRITICAL").when((iou < 0.7) | (offset > 10), "HIGH").when((iou < 0.85) | (offset > 5), "MEDIUM").otherwise("LOW")
    shown = lambda c: F.format_string("%.2f", c)
    rules = (
        ("AREA_DISCREPANCY", "GEOMETRY", "area", pct >= config.area_low, area, shown(F.col("source_area")), shown(F.col("candidate_area"))),
        ("LAND_USE_CONFLICT", "SEMANTIC", "land_use", lu[0] != lu[1], land, *lu),
        ("MUTATION_CONFLICT", "REGISTRY", "mutation_status", mu[0] != mu[1], registry, *mu),
        ("RISK_CONFLICT", "RISK", "risk_level", ri[0] != ri[1], hazard, *ri),
        ("GEOMETRY_MISMATCH", "GEOMETRY", "geometry", ~_sound() | (iou < 0.85) | (offset > 5) | (F.col("geometry_status") != "CONGRUENT"), bounds, F.lit("a"), F.lit("b")),
        ("ATTRIBUTE_MISMATCH", "REGISTRY", "survey_number", differs(F.col("source_survey"), F.col("candidate_survey")), F.lit("MEDIUM"), F.upper("source_survey"), F.upper("candidate_survey")),
    )
    rows = F.array(
        *(
            F.when(test, F.struct(F.lit(kind).alias("conflict_type"), F.lit(cat).alias("category"), F.lit(field).alias("field_name"), severity.alias("severity"), x.alias("value_a"), y.alias("value_b")))
            for kind, cat, field, test, severity, x, y in rules
        )
    )
    classed = records.withColumns({k: f(c) for k, (f, c) in _CLASSES.items()})
    return classed.withColumn("_broken", F.array_compact(rows)).drop(*_CLASSES)


def conflicts(records: DataFrame, config: ConflictConfig = ConflictConfig(), project: str = "p1") -> DataFrame:
    """A row for each rule that a record breaks: a fan-out without a shuffle.

    The outer form, as the plain one makes Spark ask for the array's size before all projections, with the rules spelt out.
    """
    out = with_broken_rules(records, config).select("record_id", "a_id", "b_id", F.explode_outer("_broken").alias("c")).select("record_id", "a_id", "b_id", "c.*").where("conflict_type is not null")
    return out.withColumn("idempotency_key", F.concat_ws(":", F.lit(project), "record_id", "conflict_type", "field_name")).withColumn("status", F.lit("OPEN"))


def severity_rank(c: str = "severity") -> Column:
    return F.when(F.col(c) == "CRITICAL", 1).when(F.col(c) == "HIGH", 2).when(F.col(c) == "MEDIUM", 3).when(F.col(c) == "LOW", 4).otherwise(5)


def conflict_counts(found: DataFrame) -> DataFrame:
    """Counts by severity, by type and over all, in one pass."""
    out = found.groupingSets([[F.col("severity")], [F.col("conflict_type")], []], F.col("severity"), F.col("conflict_type")).agg(F.count("*").alias("n"), F.count_distinct("record_id").alias("records"))
    return out.select(F.coalesce("severity", F.lit("-")).alias("severity"), F.coalesce("conflict_type", F.lit("-")).alias("conflict_type"), "n", "records")


def per_record(found: DataFrame) -> DataFrame:
    """Open conflicts of each record."""
    open_ = ~F.col("status").isin("RESOLVED", "DISMISSED")
    return found.groupBy("record_id").agg(
        F.count("*").alias("conflicts"),
        F.count_if(open_ & (F.col("severity") == "CRITICAL")).alias("critical"),
        F.count_if(open_ & (F.col("severity") == "HIGH")).alias("high"),
        F.count_if(open_).alias("unresolved"),
        F.sort_array(F.collect_set("conflict_type")).alias("types"),
    )


def counted(records: DataFrame, config: ConflictConfig = ConflictConfig()) -> DataFrame:
    """Records with the counts of :func:`per_record` while all their conflicts are open: from the row, without a join."""
    n = lambda level: F.size(F.filter("_c.levels", lambda c: c == level)).cast("bigint")
    levels = F.transform("_broken", lambda c: F.when(c["severity"] == "CRITICAL", 1).when(c["severity"] == "HIGH", 2).when(c["severity"] == "MEDIUM", 3).otherwise(4))
    types = F.sort_array(F.array_distinct(F.transform("_broken", lambda c: c["conflict_type"])))
    out = settled(with_broken_rules(records, config), "_c", levels=levels, types=types).drop("_broken")
    every = F.size("_c.levels").cast("bigint")
    return out.withColumns({"conflict_types": F.col("_c.types"), "conflicts": every, "unresolved": every, "critical": n(1), "high": n(2), "worst": F.array_min("_c.levels")}).drop("_c")


# ------------------------------------------------------------------ validation


def validated(records: DataFrame, found: DataFrame | None = None, tolerance: float = 5.0, limit: float = 15.0) -> DataFrame:
    """Sub-statuses and the overall status of each record, with the reasons that failed or warn.

    found: conflicts with their states; without, the records are those of :func:`counted`.
    """
    r = records if found is None else records.join(per_record(found), "record_id", "left")
    iou, offset, touching = F.col("spatial") * 100, F.col("centroid_m"), F.col("spatial") > 0
    lu = text.land_use("source_land_use"), text.land_use("candidate_land_use")
    broken = ~touching & (offset > 50) | (iou < 10)
    topology = F.when(broken, "FAIL").when((iou < 50) | (offset > 15), "WARNING").otherwise("PASS")
    no_area = F.col("source_area").isNull() | F.col("candidate_area").isNull()
    area = F.when(no_area | (F.col("area_pct") > limit), "FAIL").when(F.col("area_pct") > tolerance, "WARNING").otherwise("PASS")
    disputed = F.coalesce(text.mutation("mutation").isin("DISPUTED", "REJECTED"), F.lit(False))
    hazard = F.coalesce(text.risk("risk") == "CRITICAL", F.lit(False))
    farmland = F.coalesce(_either(*lu, "AGRICULTURAL") & _either(*lu, "INDUSTRIAL", "COMMERCIAL"), F.lit(False))
    semantic = F.when(disputed | hazard | farmland, "WARNING").otherwise("PASS")
    critical, high, unresolved = (F.coalesce(F.col(c), F.lit(0)) for c in ("critical", "high", "unresolved"))
    conflict = F.when(critical > 0, "FAIL").when(unresolved > 0, "WARNING").otherwise("PASS")
    side = F.when(F.col("source_geometry_state") != "VALID", "source").otherwise("candidate")
    worse = F.when(F.col("source_geometry_state") != "VALID", F.col("source_geometry_state")).otherwise(F.col("candidate_geometry_state"))
    failure = F.when(~_sound(), F.concat(side, F.lit(" geometry: "), worse))
    out = r.withColumns({"geometry_check": F.when(_sound(), "PASS").otherwise("FAIL"), "geometry_failure": failure, "topology": topology, "area_check": area, "semantic": semantic, "conflict_check": conflict, "critical": critical, "high": high, "unresolved": unresolved})
    every = F.array("geometry_check", "topology", "area_check", "semantic", "conflict_check")
    overall = F.when(F.array_contains(every, "FAIL"), "FAIL").when(F.array_contains(every, "WARNING"), "WARNING").otherwise("PASS")
    warnings = F.array_compact(F.array(F.when(disputed, "mutation needs clearance"), F.when(hazard, "critical hazard"), F.when(farmland, "incompatible land use"), F.when(F.col("topology") == "WARNING", "boundary variance"), F.when(F.col("area_check") == "WARNING", "area tolerance"), F.when(F.col("conflict_check") == "WARNING", "open conflicts")))
    return out.withColumn("overall", overall).withColumn("warnings", warnings)


def status_rank(c: str = "overall") -> Column:
    return F.when(F.col(c) == "FAIL", 1).when(F.col(c) == "WARNING", 2).when(F.col(c) == "PASS", 3).otherwise(4)


def validation_summary(checked: DataFrame) -> DataFrame:
    fails = lambda c: F.count_if(F.col(c) == "FAIL")
    return checked.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("overall") == "PASS").alias("passed"),
        F.count_if(F.col("overall") == "WARNING").alias("warned"),
        fails("overall").alias("failed"),
        fails("geometry_check").alias("geometry_failed"),
        fails("topology").alias("topology_failed"),
        fails("area_check").alias("area_failed"),
        fails("semantic").alias("semantic_failed"),
        fails("conflict_check").alias("conflict_failed"),
    )


# ------------------------------------------------------------------ confidence


@dataclass(frozen=True)
class ConfidenceConfig:
    # Weights, thresholds, cap and penalty.
    spatial: float = 0.30
    geometry: float = 0.30
    attribute: float = 0.30
    temporal: float = 0.10
    high: float = 0.90
    medium: float = 0.70
    cap: float = 0.78
    penalty: float = 0.05
    penalty_over: float = 0.85

    def weights(self) -> dict[str, float]:
        own = {k: getattr(self, k) for k in ("spatial", "geometry", "attribute", "temporal")}
        total = sum(own.values())
        return {k: v / total for k, v in own.items()}


def bucket(score: Column, ambiguous: Column, blocked: Column, config: ConfidenceConfig = ConfidenceConfig()) -> Column:
    return F.when(ambiguous, "AMBIGUOUS").when((score >= config.high) & ~blocked, "HIGH").when(score >= config.medium, "MEDIUM").otherwise("LOW")


def geometry_fallback() -> Column:
    """Without a geometry signal: what the areas leave of it, less where they fail or warn."""
    left = 1 - F.least(F.lit(1.0), F.coalesce(F.col("area_pct"), F.lit(0.0)) / 100) * 0.75
    return F.when(F.col("area_check") == "FAIL", F.least(left, F.lit(0.40))).when(F.col("area_check") == "WARNING", F.least(left, F.lit(0.75))).otherwise(left)


def attribute_fallback() -> Column:
    """Without an attribute signal: by the land uses, equal, with a word of one within the other, or neither."""
    a, b = (F.lower(F.trim(c)) for c in ("source_land_use", "candidate_land_use"))
    within = lambda x, y: F.exists(F.split(x, r"\s+"), lambda w: F.contains(y, w))
    both = a.isNotNull() & b.isNotNull() & (a != "") & (b != "")
    by_use = F.when(~F.coalesce(both, F.lit(False)), 0.85).when(a == b, 1.0).when(within(a, b) | within(b, a), 0.80).otherwise(0.45)
    return F.when(F.col("semantic") == "FAIL", F.least(by_use, F.lit(0.30))).otherwise(by_use)


def confidence(checked: DataFrame, config: ConfidenceConfig = ConfidenceConfig()) -> DataFrame:
    w = config.weights()
    unit = lambda c: F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), c)), 4)
    out = checked.withColumns(
        {
            "s_spatial": unit(F.coalesce(F.col("spatial"), F.lit(0.85))),
            "s_geometry": unit(F.when(F.col("geometry_check") == "FAIL", 0.0).otherwise(F.coalesce(F.col("geometry"), geometry_fallback()))),
            "s_attribute": unit(F.coalesce(F.col("attribute"), attribute_fallback())),
            "s_temporal": F.when(F.col("overall") == "PASS", 1.0).when(F.col("overall") == "WARNING", 0.9).otherwise(0.8),
        }
    )
    raw = F.round(sum((F.round(w[k] * F.col(f"s_{k}"), 4) for k in w), F.lit(0.0)), 4)
    blocked = (F.col("critical") > 0) | (F.col("overall") == "FAIL")
    tied = (F.col("role") == "AMBIGUOUS") | F.coalesce((F.col("score_gap") < 0.015) & (F.col("candidate_count") > 1), F.lit(False))
    out = out.withColumns({"blocked": blocked, "ambiguous": tied, "_raw": raw})
    capped = F.when(F.col("blocked"), F.least(F.col("_raw"), F.lit(config.cap))).otherwise(F.col("_raw"))
    out = out.withColumn("_capped", capped)
    final = F.when((F.col("high") > 0) & (F.col("_capped") > config.penalty_over), F.round(F.col("_capped") - config.penalty, 4)).otherwise(F.col("_capped"))
    out = settled(out, "_f", confidence=final, blocked=F.col("blocked"), ambiguous=F.col("ambiguous")).drop("_raw", "_capped", "blocked", "ambiguous")
    out = out.withColumns({k: F.col(f"_f.{k}") for k in ("confidence", "blocked", "ambiguous")}).drop("_f")
    out = out.withColumn("bucket", bucket(F.col("confidence"), F.col("ambiguous"), F.col("blocked"), config))
    review = F.when(F.col("bucket").isin("AMBIGUOUS", "LOW"), "FLAGGED").when(F.col("bucket") == "HIGH", "ACCEPTED").otherwise(F.when(F.col("blocked"), "FLAGGED").otherwise("PENDING"))
    return out.withColumn("review_status", review)


def confidence_summary(scored: DataFrame) -> DataFrame:
    n = lambda b: F.count_if(F.col("bucket") == b)
    average = F.round(F.avg(F.col("confidence").cast("decimal(20,6)")).cast("double"), 4)
    return scored.agg(F.count("*").alias("total"), n("HIGH").alias("high"), n("MEDIUM").alias("medium"), n("LOW").alias("low"), n("AMBIGUOUS").alias("ambiguous"), average.alias("average"))
