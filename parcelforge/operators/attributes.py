"""Attribute conflicts over any number of sources, and what advice follows from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelforge.functions.text import text_value

#: How far a source is trusted for an attribute; 0.5 otherwise.
AUTHORITY = {
    "zoning": {"cadastral": 0.95, "drone": 0.30, "infrastructure": 0.50},
    "owner_name": {"cadastral": 0.98, "drone": 0.10, "infrastructure": 0.40},
    "parcel_id": {"cadastral": 0.99, "drone": 0.10, "infrastructure": 0.30},
    "area_sqm": {"cadastral": 0.80, "drone": 0.85, "infrastructure": 0.50},
    "structure_height": {"drone": 0.95, "cadastral": 0.20, "infrastructure": 0.40},
}


def multi_source(values: DataFrame, relative: float = 0.05, absolute: float = 1.0) -> DataFrame:
    """Conflicts of (record_id, attribute, source, value): NUMERIC_DIFFERENCE, VALUE_MISMATCH or NULL_VALUE_CONFLICT.

    Numbers conflict when they differ by more than ``absolute`` and by more than ``relative`` of the larger one.
    Addresses that are all part of the longest one are the same, more or less detailed, and no conflict.
    """
    clean = values.withColumn("v", text_value("value")).withColumn("x", F.col("v").try_cast("double"))
    # Dealt once: the counts of different values and those over them need no shuffle of their own then.
    held = clean.select("record_id", "attribute", F.lower("v").alias("l"), F.length("v").alias("length"), "x").repartition("record_id", "attribute")
    once = held.groupBy("record_id", "attribute", "l").agg(F.count("*").alias("n"), F.count("x").alias("xs"), F.min("x").alias("low"), F.max("x").alias("high"), F.max("length").alias("length"))
    counts = lambda df, *more: df.groupBy("record_id", "attribute").agg(F.sum("n").alias("sources"), F.sum(F.when(F.col("l").isNotNull(), F.col("n")).otherwise(0)).alias("filled"), F.sum("xs").alias("numbers"), F.count("l").alias("different"), F.min("low").alias("low"), F.max("high").alias("high"), *more)
    address = F.col("attribute").eqNullSafe("address")
    # Texts are only gathered for addresses, as many as a record has sources.
    texts = counts(once.where(address), F.collect_list("l").alias("addresses"), F.max_by("l", "length").alias("longest"))
    by = counts(once.where(~address)).withColumns({"addresses": F.lit(None).cast("array<string>"), "longest": F.lit(None).cast("string")}).unionByName(texts)
    gap = F.col("high") - F.col("low")
    top = F.greatest(F.abs("high"), F.abs("low"))
    numeric = (F.col("numbers") >= 2) & (F.col("numbers") == F.col("filled"))
    apart = numeric & (gap > absolute) & (gap / top > relative)
    detailed = ~numeric & (F.col("different") > 1) & (F.col("attribute") == "address") & F.forall("addresses", lambda a: F.contains(F.col("longest"), a))
    kind = F.when(apart, "NUMERIC_DIFFERENCE").when(detailed, F.lit(None).cast("string")).when(~numeric & (F.col("different") > 1), "VALUE_MISMATCH").when((F.col("filled") > 0) & (F.col("filled") < F.col("sources")), "NULL_VALUE_CONFLICT")
    out = by.withColumn("conflict_type", kind).where(F.col("conflict_type").isNotNull())
    return out.select("record_id", "attribute", "conflict_type", "sources", "different", F.when(numeric, F.round(gap, 2)).alias("gap"))


def advice(values: DataFrame) -> DataFrame:
    """For each record and attribute the value of the most trusted source, with that trust."""
    n = F.lower("source")
    has = lambda *ws: F.coalesce(sum((F.contains(n, F.lit(w)).cast("int") for w in ws), F.lit(0)) > 0, F.lit(False))
    kind = F.when(has("cadastral", "registry"), "cadastral").when(has("drone", "uav", "ortho"), "drone").when(has("municipal", "asset"), "infrastructure").otherwise("other")
    weight = None
    for attribute, by in AUTHORITY.items():
        for source, w in by.items():
            test = (F.col("attribute") == attribute) & (F.col("category") == source)
            weight = F.when(test, w) if weight is None else weight.when(test, w)
    rated = values.withColumn("category", kind).withColumn("weight", weight.otherwise(0.5))
    best = rated.groupBy("record_id", "attribute").agg(F.max(F.struct("weight", "source", "value")).alias("m"))
    return best.select("record_id", "attribute", F.col("m.source").alias("source"), F.col("m.value").alias("value"), F.col("m.weight").alias("weight"))


def record_status(per_source: DataFrame, open_conflicts: DataFrame, area_gap: float = 0.30) -> DataFrame:
    """Legacy status of (record_id, source, area): CONFLICT with open conflicts or far areas, INCOMPLETE below two
    sources or without an area, else ACTIVE."""
    by = per_source.groupBy("record_id").agg(F.count_distinct("source").alias("sources"), F.min("area").alias("low"), F.max("area").alias("high"))
    out = by.join(open_conflicts.select("record_id").distinct().withColumn("open", F.lit(True)), "record_id", "left")
    far = F.coalesce((F.col("high") - F.col("low")) / F.col("high") > area_gap, F.lit(False))
    state = F.when(F.col("open").isNotNull() | far, "CONFLICT").when((F.col("sources") < 2) | F.col("high").isNull(), "INCOMPLETE").otherwise("ACTIVE")
    return out.select("record_id", "sources", state.alias("status"))


def sources_of(rows: DataFrame) -> DataFrame:
    """Distinct sources and features of each record, as text lists."""
    joined = lambda c: F.array_join(F.sort_array(F.collect_set(F.col(c).cast("string"))), ";")
    return rows.groupBy("record_id").agg(joined("source").alias("sources"), joined("feature_id").alias("features"), F.count("*").alias("n"))


def by_role(values: DataFrame) -> DataFrame:
    """(record_id, attribute, by_role): the value of each source role, of several the largest, as a map."""
    one = values.where("value is not null").groupBy("record_id", "attribute", "role").agg(F.max("value").alias("value"))
    return one.groupBy("record_id", "attribute").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("role", "value")))).alias("by_role"))


def in_order(rows: DataFrame, value: str, order: str, key: str = "record_id", name: str = "items") -> DataFrame:
    """Different values of each key in the order in which they come first."""
    first = rows.groupBy(key, value).agg(F.min(order).alias("o"))
    return first.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("o", F.col(value).alias("v")))), lambda x: x["v"]).alias(name))


def conflict_states(rows: DataFrame) -> DataFrame:
    n = lambda s: F.count_if(F.col("status") == s)
    out = rows.groupBy("record_id").agg(n("OPEN").alias("unresolved"), n("RESOLVED").alias("resolved"), n("DISMISSED").alias("dismissed"))
    return out.withColumn("state", F.when(F.col("unresolved") > 0, "CONFLICT").otherwise("ACTIVE"))
