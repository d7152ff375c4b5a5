"""Distance joins of boxes as equi-joins on grid cells of several sizes.

A distance predicate alone would be planned as a nested loop.  Here each box lives at a level: cells of a level are four
times as wide as those of the one below, and a box is of the lowest level at which it spans ``SPAN`` cells at most in
either direction.  So a box of any size touches a handful of cells.  A pair meets at the higher of its two levels: there
each side brings boxes of its own level and smaller ones, as long as the other side has boxes of that level at all.
It is kept only in its reference cell, the one of the larger of both minimal cells; so each pair occurs once without a
distinct.  Any cell size gives the same pairs: small ones make many rows of a box, large ones many pairs to be tested.
A box makes no rows at levels that no pair can meet at.  Dense cells are skewed join keys, which adaptive execution splits.
Neither side is broadcast: Spark guesses the size of a side from its files, not from the rows that its cells make.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelforge.functions import geo

#: Metres of a degree, generously few: pairs must not be lost.
_DEGREE = 110_000.0
#: Cells that a box spans at most, and how many times wider the cells of the next level are.
SPAN, STEP = 2, 4
LEVELS = 20


def _level(prefix: str, size: float, by_lon: Column, by_lat: Column) -> Column:
    c = lambda n: F.col(f"{prefix}{n}")
    extent = F.greatest(c("x2") - c("x1") + 2 * by_lon, c("y2") - c("y1") + 2 * by_lat)
    up = F.ceil(F.ln(extent / (SPAN * size)) / math.log(STEP))
    return F.when(extent <= SPAN * size, 0).otherwise(F.least(up, F.lit(LEVELS))).cast("int")


def _corners(prefix: str) -> list[str]:
    return [f"{prefix}{c}" for c in ("x1", "y1", "x2", "y2")]


def _levels(df: DataFrame, prefix: str, level: Column) -> Column:
    """The levels that a side has, as a value of the whole query: a few numbers."""
    return df.dropna(subset=_corners(prefix)).select(level.alias("level")).agg(F.collect_set("level").alias("levels")).scalar()


def _cells(df: DataFrame, prefix: str, size: float, by_lon: Column, by_lat: Column, level: Column, others: Column) -> DataFrame:
    # A source with a null corner has no cell and no pair.
    held = df.dropna(subset=_corners(prefix)).withColumns({f"{prefix}own": level, f"{prefix}others": others})
    up = F.filter(f"{prefix}others", lambda k: k > F.col(f"{prefix}own"))
    here = F.filter(F.array(f"{prefix}own"), lambda own: F.array_min(f"{prefix}others") <= own)
    spread = held.withColumn("_level", F.explode(F.array_union(here, up))).drop(f"{prefix}others")
    wide = F.pow(F.lit(float(STEP)), F.col("_level")) * size
    at = lambda c, d: F.floor((F.col(f"{prefix}{c}") + d) / wide)
    spread = spread.withColumns({f"{prefix}cx": at("x1", -by_lon), f"{prefix}cy": at("y1", -by_lat)})
    return spread.withColumn("_cell_x", F.explode(F.sequence(f"{prefix}cx", at("x2", by_lon)))).withColumn("_cell_y", F.explode(F.sequence(f"{prefix}cy", at("y2", by_lat))))


def join(left: DataFrame, right: DataFrame, metres: float, a: str = "a_", b: str = "b_", cell: float | None = None) -> DataFrame:
    """All pairs of boxes whose gap is at most ``metres``, with the gap as ``distance``.

    The sides have columns ``{a}x1`` ... and ``{b}x1`` ..., and no other name in common.
    """
    size = cell or max(metres / _DEGREE, 0.0005)
    lat = F.greatest(F.abs(F.col(f"{a}y1")), F.abs(F.col(f"{a}y2"))) + metres / _DEGREE
    by_lon, by_lat, none = metres / (_DEGREE * F.greatest(F.lit(0.01), F.cos(F.radians(lat)))), F.lit(metres / _DEGREE), F.lit(0.0)
    l_level, r_level = _level(a, size, by_lon, by_lat), _level(b, size, none, none)
    l_ = _cells(left, a, size, by_lon, by_lat, l_level, _levels(right, b, r_level))
    r_ = _cells(right, b, size, none, none, r_level, _levels(left, a, l_level))
    own = (F.col(f"{a}own") == F.col("_level")) | (F.col(f"{b}own") == F.col("_level"))
    pairs = l_.join(r_.hint("merge"), ["_level", "_cell_x", "_cell_y"]).where(own)
    first = (F.col("_cell_x") == F.greatest(f"{a}cx", f"{b}cx")) & (F.col("_cell_y") == F.greatest(f"{a}cy", f"{b}cy"))
    near = pairs.where(first).withColumn("distance", geo.gap(geo.Box(a), geo.Box(b)))
    return near.where(F.col("distance") <= metres).drop("_level", "_cell_x", "_cell_y", *(f"{p}{c}" for p in (a, b) for c in ("own", "cx", "cy")))
