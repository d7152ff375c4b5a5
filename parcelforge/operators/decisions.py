"""Human decisions as appended rows: what may be asked for is checked here, in what state it results is derived.

A log of decisions is only appended to; :func:`parcelforge.operators.review.latest` is its current view, so that a
machine score is never written over.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelforge.operators.review import ACTIONS

#: What a merge may set, and whose geometry it may take.
MERGE_FIELDS = ("land_use", "mutation_status", "risk_level", "area", "survey_number", "owner_name", "address")
GEOMETRIES = ("SOURCE_A", "SOURCE_B", "CUSTOM")
LOG = "record_id string, action string, geometry_source string, attributes map<string,string>, notes string, reviewer string, override boolean, status string, decided_at timestamp"


@dataclass(frozen=True)
class Decision:
    record_id: str
    action: str
    reviewer: str
    notes: str = ""
    geometry_source: str | None = None
    attributes: dict[str, str] = field(default_factory=dict)

    def checked(self, critical: bool) -> Decision:
        """The decision with the fields it may set; :class:`ValueError` where it lacks something.

        Rejecting, merging, and accepting in spite of a critical conflict need a note.
        """
        if self.action not in ACTIONS:
            raise ValueError(f"unknown action: {self.action}")
        if (critical or self.action in ("MERGE_RECONCILE", "REJECT_UNRESOLVED")) and not self.notes.strip():
            raise ValueError("a note is needed")
        if self.action == "MERGE_RECONCILE" and self.geometry_source not in GEOMETRIES:
            raise ValueError("a merge names its geometry")
        kept = {k: v for k, v in self.attributes.items() if k in MERGE_FIELDS} if self.action == "MERGE_RECONCILE" else {}
        return Decision(self.record_id, self.action, self.reviewer, self.notes.strip(), self.geometry_source, kept)


def decide(log: DataFrame, items: DataFrame, decisions: list[Decision]) -> DataFrame:
    """The log with checked decisions appended; ``items`` has record_id and severity.  The list is one user's input."""
    spark = log.sparkSession
    ids = [d.record_id for d in decisions]
    found = {r.record_id: r.severity for r in items.where(F.col("record_id").isin(ids)).select("record_id", "severity").collect()}
    rows = []
    for d in decisions:
        if d.record_id not in found:
            raise ValueError(f"no such record: {d.record_id}")
        critical = found[d.record_id] == "CRITICAL"
        c = d.checked(critical)
        state = "REJECTED" if c.action == "REJECT_UNRESOLVED" else "RESOLVED"
        rows.append((c.record_id, c.action, c.geometry_source, c.attributes, c.notes, c.reviewer, critical and c.action != "REJECT_UNRESOLVED", state))
    new = spark.createDataFrame(rows, LOG.rpartition(",")[0]).withColumn("decided_at", F.current_timestamp())
    return log.unionByName(new)


def finalize(summary: DataFrame) -> None:
    """Raises while mandatory records are undecided; ``summary`` is one row of the review summary."""
    pending = summary.select("pending").first()[0]
    if pending:
        raise ValueError(f"{pending} mandatory records are undecided")


def resolve(conflicts: DataFrame, key: str, kind: str, comment: str, *, feature_id: str | None = None, value: str | None = None) -> DataFrame:
    """Conflicts (conflict_id, status, values: array of structs feature_id, value) with one of them settled.

    SOURCE_SELECTION takes the value of a feature that contributes to the conflict, MANUAL_VALUE a given one.
    """
    if kind not in ("SOURCE_SELECTION", "MANUAL_VALUE"):
        raise ValueError("a source's value or a manual one")
    if not comment.strip():
        raise ValueError("a comment is needed")
    if kind == "MANUAL_VALUE" and value is None:
        raise ValueError("a manual value is needed")
    one = conflicts.where(F.col("conflict_id") == key).limit(1).collect()
    if not one:
        raise ValueError(f"no such conflict: {key}")
    if kind == "SOURCE_SELECTION":
        values = {v.feature_id: v.value for v in one[0]["values"]}
        if feature_id not in values:
            raise ValueError("the feature does not contribute to the record")
        value = values[feature_id]
    hit = F.col("conflict_id") == key
    return conflicts.withColumns({"status": F.when(hit, "RESOLVED").otherwise(F.col("status")), "resolved_value": F.when(hit, F.lit(value)), "comment": F.when(hit, F.lit(comment.strip()))})


def dismiss(conflicts: DataFrame, key: str, comment: str) -> DataFrame:
    """Conflicts (conflict_id, status) with one of them dismissed, which needs a comment; a settled one stays."""
    if not comment.strip():
        raise ValueError("a comment is needed")
    one = conflicts.where(F.col("conflict_id") == key).select("status").limit(1).collect()
    if not one:
        raise ValueError(f"no such conflict: {key}")
    if one[0].status == "RESOLVED":
        raise ValueError("the conflict is resolved")
    hit = F.col("conflict_id") == key
    said = F.col("comment") if "comment" in conflicts.columns else F.lit(None).cast("string")
    return conflicts.withColumns({"status": F.when(hit, "DISMISSED").otherwise(F.col("status")), "comment": F.when(hit, F.lit(comment.strip())).otherwise(said)})
