"""Synthetic surveys of any size, from row numbers alone: the same rows wherever they are made."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelforge.functions import geo

LAND_USES = ("Residential", "Commercial", "Agricultural", "Industrial", "Public")


def parcels(spark: SparkSession, n: int = 80, columns: int = 10) -> DataFrame:
    """A grid of boxes of 80 by 60 metres or so, with an owner, a land use and an area."""
    k = F.col("id")
    box = geo.Box()
    rows = spark.range(n).select(k.alias("k"), (73.85 + (k % columns) * 0.00095).alias("x1"), (18.52 + F.floor(k / columns) * 0.00075).alias("y1"))
    boxed = rows.withColumns({"x2": F.col("x1") + 0.0008, "y2": F.col("y1") + 0.0006})
    return boxed.select(
        F.format_string("CP-%04d", F.col("k") + 1).alias("parcel_id"), F.format_string("Owner %d", F.col("k") * 7 % 23).alias("owner_name"),
        F.element_at(F.array(*map(F.lit, LAND_USES)), (F.col("k") % len(LAND_USES) + 1).cast("int")).alias("land_use"),
        F.round(geo.metric_area(box.area, box.cy), 2).alias("area_sqm"), "x1", "y1", "x2", "y2",
    )


def structures(of: DataFrame, every: int = 13) -> DataFrame:
    """A box within each parcel but every thirteenth, some shifted, some of another land use."""
    k = F.substring("parcel_id", 4, 9).cast("bigint") - 1
    dx, scale = (k * 7 % 11 - 5) * 0.00002, 0.6 + 0.04 * (k % 10)
    cx, cy = (F.col("x1") + F.col("x2")) / 2 + dx, (F.col("y1") + F.col("y2")) / 2
    made = of.where(k % every != 0).select(F.format_string("DS-%04d", k + 1).alias("structure_id"), F.when(k % 17 == 0, "Vacant").otherwise(F.col("land_use")).alias("structure_type"), cx.alias("cx"), cy.alias("cy"), scale.alias("s"))
    return made.select("structure_id", "structure_type", (F.col("cx") - 0.0004 * F.col("s")).alias("x1"), (F.col("cy") - 0.0003 * F.col("s")).alias("y1"), (F.col("cx") + 0.0004 * F.col("s")).alias("x2"), (F.col("cy") + 0.0003 * F.col("s")).alias("y2"))
