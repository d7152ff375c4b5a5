"""Filtered and ordered pages of what the stages result in, with all the parameters that a user may give.

A filter that is None, empty or ALL is off.  A search term is used as a pattern of LIKE, so that its wildcards count,
except where a substring is asked for.  Frames stay lazy: a page is an order with an offset and a limit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelforge.operators.harmonize import severity_rank, status_rank


def _off(value: str | None) -> bool:
    return value is None or value.strip().upper() in ("", "ALL")


def equal(df: DataFrame, column: str, value: str | None) -> DataFrame:
    return df if _off(value) else df.where(F.upper(column) == value.strip().upper())


def like(df: DataFrame, term: str | None, *columns: str) -> DataFrame:
    if term is None or not term.strip():
        return df
    tests = [F.coalesce(F.col(c).cast("string").ilike(f"%{term.strip()}%"), F.lit(False)) for c in columns]
    return df.where(F.array_contains(F.array(*tests), True))


def holds(df: DataFrame, term: str | None, *columns: str) -> DataFrame:
    if term is None or not term.strip():
        return df
    tests = [F.contains(F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit(term.strip().lower())) for c in columns]
    return df.where(F.array_contains(F.array(*tests), True))


def page(df: DataFrame, *order: Column | str, skip: int = 0, limit: int = 50) -> DataFrame:
    return df.orderBy(*order).offset(skip).limit(limit)


def of_project(df: DataFrame, project: str, column: str = "project_id") -> DataFrame:
    return df.where(F.col(column) == project)


def lookup(df: DataFrame, value: str, id_: str, identifier: str) -> DataFrame:
    """The rows of an id or of an identifier."""
    return df.where((F.col(id_).cast("string") == value) | (F.col(identifier) == value))


def matches(df: DataFrame, *, status: str | None = None, role: str | None = None, best_only: bool = False, least: float | None = None, most: float | None = None, source: str | None = None, candidate: str | None = None) -> DataFrame:
    out = equal(equal(df, "status", status), "role", role)
    out = out.where("is_best") if best_only else out
    out = out if least is None else out.where(F.col("score") >= least)
    out = out if most is None else out.where(F.col("score") <= most)
    out = out if source is None else out.where(F.col("source_dataset") == source)
    return out if candidate is None else out.where(F.col("candidate_dataset") == candidate)


#: How a table of matches is sorted by each of its fields; nulls count as these values.
SORTS = {"score": 0.0, "status": "", "rank": 999, "role": "", "score_gap": 0.0, "source_identifier": "", "candidate_identifier": ""}


def match_table(df: DataFrame, *, search: str | None = None, sort: str = "score", descending: bool = True, page_number: int = 1, page_size: int = 25, least_pct: float = 0.0, **filters) -> DataFrame:
    out = matches(df, least=least_pct / 100, **filters)
    out = holds(out, search, "source_identifier", "candidate_identifier", "source_dataset", "candidate_dataset")
    by = F.coalesce(F.col(sort), F.lit(SORTS[sort]))
    return page(out, by.desc() if descending else by.asc(), "a_id", "b_id", skip=(page_number - 1) * page_size, limit=page_size)


def conflicts(df: DataFrame, *, severity: str | None = None, conflict_type: str | None = None, category: str | None = None, status: str | None = None, source: str | None = None, search: str | None = None, searched: tuple[str, ...] = ("record_id", "field_name", "value_a", "value_b")) -> DataFrame:
    out = df
    for c, v in (("severity", severity), ("conflict_type", conflict_type), ("category", category), ("status", status)):
        out = equal(out, c, v)
    return like(like(out, source, "source_a", "source_b"), search, *searched)


def conflict_page(df: DataFrame, skip: int = 0, limit: int = 50, created: str = "created_at") -> DataFrame:
    """The most severe first, then the newest."""
    return page(df, severity_rank(), F.col(created).desc(), "record_id", "conflict_type", skip=skip, limit=limit)


def attribute_conflicts(df: DataFrame, records: DataFrame, *, status: str | None = None, attribute: str | None = None, severity: str | None = None) -> DataFrame:
    """Conflicts with the identifier of their record."""
    out = equal(equal(df, "status", status), "severity", severity)
    out = out if not attribute else out.where(F.col("attribute") == attribute.strip())
    return out.join(records.select("record_id", "identifier"), "record_id")


#: The sub-status of each category of validations.
CHECKS = {"GEOMETRY": "geometry_check", "TOPOLOGY": "topology", "AREA": "area_check", "SEMANTIC": "semantic", "CONFLICT": "conflict_check"}


def validations(df: DataFrame, *, status: str | None = None, category: str | None = None, search: str | None = None, searched: tuple[str, ...] = ("record_id",)) -> DataFrame:
    out = equal(df, "overall", status)
    check = None if _off(category) else CHECKS.get(category.strip().upper())
    return like(out if check is None else out.where(F.col(check).isin("WARNING", "FAIL")), search, *searched)


def validation_page(df: DataFrame, skip: int = 0, limit: int = 50) -> DataFrame:
    return page(df, status_rank(), "record_id", skip=skip, limit=limit)


def confidences(df: DataFrame, *, bucket: str | None = None, review_status: str | None = None, search: str | None = None, searched: tuple[str, ...] = ("record_id",)) -> DataFrame:
    return holds(equal(equal(df, "bucket", bucket), "review_status", review_status), search, *searched)


def unified(df: DataFrame, *, status: str | None = None, resolution: str | None = None, search: str | None = None, searched: tuple[str, ...] = ("identifier", "record_id", "source_a_reference", "source_b_reference", "land_use")) -> DataFrame:
    return like(equal(equal(df, "status", status), "resolution_status", resolution), search, *searched)


def provenance(df: DataFrame, *, state: str | None = None, search: str | None = None, searched: tuple[str, ...] = ("record_id",)) -> DataFrame:
    """A state is one of the lineage (COMPLETE, PARTIAL, QUARANTINED) or of the resolution (UNIFIED, REJECTED)."""
    s = "" if _off(state) else state.strip().upper()
    column = "lineage_status" if s in ("COMPLETE", "PARTIAL", "QUARANTINED") else "resolution_status" if s in ("UNIFIED", "REJECTED") else None
    return like(df if column is None else df.where(F.col(column) == s), search, *searched)
