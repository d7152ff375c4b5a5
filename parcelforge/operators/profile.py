"""Profiles: geometry kinds and validity, attributes, extent."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def geometry(features: DataFrame, kind: str = "kind", valid: str = "valid", empty: str = "empty") -> DataFrame:
    """Counts, and the dominant kind where it makes up 80 per cent (otherwise Mixed); validity is a share of all rows."""
    by = features.groupBy(kind).agg(F.count("*").alias("n"), F.count_if(F.col(valid) & ~F.col(empty)).alias("v"), F.count_if(F.col(empty)).alias("e"))
    out = by.agg(F.sum("n").alias("total"), F.sum("v").alias("valid"), F.sum("e").alias("empty"), F.max(F.struct("n", F.col(kind).alias("kind"))).alias("top"))
    dominant = F.when(F.col("top.n") >= 0.8 * F.col("total"), F.col("top.kind")).otherwise("Mixed")
    return out.select("total", "valid", "empty", (F.col("total") - F.col("valid") - F.col("empty")).alias("invalid"), dominant.alias("dominant"), F.round(F.col("valid") * 100.0 / F.col("total"), 1).alias("valid_pct"))


def kinds(features: DataFrame, kind: str = "kind") -> DataFrame:
    """How many features each kind of geometry has."""
    return features.groupBy(kind).agg(F.count("*").alias("features"))


_KINDS = {"bigint": "Integer", "int": "Integer", "smallint": "Integer", "tinyint": "Integer", "double": "Float", "float": "Float", "boolean": "Boolean", "date": "DateTime", "timestamp": "DateTime", "timestamp_ntz": "DateTime"}


def attributes(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Kind, nulls and distinct values of each column, from one pass."""
    columns = columns or df.columns
    one = df.agg(*(F.count_if(F.col(c).isNull()).alias(f"{c}_nulls") for c in columns), *(F.count_distinct(c).alias(f"{c}_distinct") for c in columns))
    kinds = {c: _KINDS.get(df.schema[c].dataType.simpleString(), "String") for c in columns}
    rows = F.array(*(F.struct(F.lit(c).alias("attribute"), F.lit(kinds[c]).alias("kind"), F.col(f"{c}_nulls").alias("nulls"), F.col(f"{c}_distinct").alias("distinct_values")) for c in columns))
    return one.select(F.explode(rows).alias("r")).select("r.*")


def extent(boxes: DataFrame) -> DataFrame:
    r = lambda c: F.round(c, 6)
    return boxes.agg(r(F.min("x1")).alias("min_x"), r(F.min("y1")).alias("min_y"), r(F.max("x2")).alias("max_x"), r(F.max("y2")).alias("max_y"))
