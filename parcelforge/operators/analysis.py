"""Ad-hoc spatial analyses over boxes and points."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parcelforge.functions import geo
from parcelforge.operators import grid
from parcelforge.session import stored

A, B = geo.Box("a_"), geo.Box("b_")


def nearest_reference(targets: DataFrame, references: DataFrame, metres: float, tag: str = "a_id") -> DataFrame:
    """For each target its nearest reference within ``metres``: centroid distance, 0 where boxes intersect."""
    pairs = grid.join(targets, references, metres * 1.01, cell=max(metres / 110_000.0, 0.002))
    d = F.when(geo.intersects(A, B), 0.0).otherwise(geo.haversine(A.cx, A.cy, B.cx, B.cy))
    near = pairs.withColumn("metres", d).where(F.col("metres") <= metres)
    best = near.groupBy(tag).agg(F.min(F.struct(F.round("metres", 2).alias("metres"), "b_id")).alias("m"))
    return best.select(tag, F.col("m.b_id").alias("b_id"), F.col("m.metres").alias("metres"))


def nearest(points: DataFrame, queries: DataFrame, k: int, radii: tuple[float, ...] = (500.0, 5_000.0, 50_000.0)) -> DataFrame:
    """The k nearest points of each query within the last radius, by widening rings: only queries that have found
    fewer than k within a radius go on to the next, so that most cells stay small."""
    left, parts = queries, []
    for n, radius in enumerate(radii):
        pairs = grid.join(left, points, radius * 1.01, cell=radius / 110_000.0)
        d = geo.haversine(A.cx, A.cy, B.cx, B.cy)
        near = pairs.withColumn("metres", F.round(d, 2)).where(d <= radius).select("a_id", "b_id", "metres")
        ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("a_id").orderBy("metres", "b_id"))).where(F.col("rank") <= k)
        if n == len(radii) - 1:
            parts.append(ranked)
            break
        ranked = stored(ranked, "knn")
        full = ranked.groupBy("a_id").agg(F.count("*").alias("n")).where(F.col("n") >= k).select("a_id")
        parts.append(ranked.join(full, "a_id", "left_semi"))
        # Stored, so that a ring does not make all earlier ones again.
        left = stored(left.join(full, "a_id", "left_anti"), "knn")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def intersections(a: DataFrame, b: DataFrame, least_pct: float = 0.0) -> DataFrame:
    """Intersecting pairs with the shared area in square metres and its share of the first."""
    pairs = grid.join(a, b, 0.0, cell=0.001).where(geo.intersects(A, B))
    lat = (F.greatest(A.y1, B.y1) + F.least(A.y2, B.y2)) / 2
    inter = geo.overlap(A, B)
    out = pairs.withColumns({"overlap_m2": F.round(geo.metric_area_series(inter, lat), 2), "overlap_pct": F.round(inter / F.nullif(A.area, F.lit(0.0)) * 100, 2)})
    return out.where(F.col("overlap_pct") >= least_pct)


def containments(a: DataFrame, b: DataFrame, strict: bool = False) -> DataFrame:
    """Pairs where the first holds the second; unless strict, touching is enough."""
    return grid.join(a, b, 0.0, cell=0.001).where(geo.contains(A, B) if strict else geo.intersects(A, B))


def buffer_hits(a: DataFrame, b: DataFrame, metres: float) -> DataFrame:
    """Points of ``b`` in the square-degree buffer around the centroids of ``a``."""
    pairs = grid.join(a, b, metres * 2)
    r = geo.buffer_degrees(F.lit(metres), A.cy)
    d = F.sqrt(F.pow(A.cx - B.cx, 2) + F.pow(A.cy - B.cy, 2))
    return pairs.where(d <= r)


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: intersecting pairs, and what of each side meets nothing."""
    pairs = grid.join(a, b, 0.0, cell=0.001).where(geo.intersects(A, B)).select("a_id", "b_id")
    met = pairs.agg(F.count("*").alias("pairs"), F.count_distinct("a_id").alias("a_met"), F.count_distinct("b_id").alias("b_met"))
    total = a.agg(F.count("*").alias("a_total")).crossJoin(b.agg(F.count("*").alias("b_total")))  # one row each
    return met.crossJoin(total).select("pairs", (F.col("a_total") - F.col("a_met")).alias("a_only"), (F.col("b_total") - F.col("b_met")).alias("b_only"))


def only(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of ``a`` that meet nothing in ``b``."""
    met = grid.join(a, b, 0.0, cell=0.001).where(geo.intersects(A, B)).select("a_id")
    return a.join(met, "a_id", "left_anti")


def version_diff(old: DataFrame, new: DataFrame, key: str, fields: tuple[str, ...]) -> DataFrame:
    """ADDED, REMOVED, CHANGED or UNCHANGED for each key, with the area change, the shift and the fields that differ.

    Both have ``key``, box corners and ``fields``; of rows of one key the last by the fields counts.
    """
    corners = ("x1", "y1", "x2", "y2")

    def side(df: DataFrame, p: str) -> DataFrame:
        last = df.groupBy(key).agg(F.max(F.struct(*corners, *fields)).alias("r"))
        return last.select(key, F.lit(True).alias(f"{p}there"), *(F.col(f"r.{c}").alias(f"{p}{c}") for c in (*corners, *fields)))

    both = side(old, "a_").join(side(new, "b_"), key, "full_outer")
    area = F.round(geo.metric_area_series(B.area, B.cy) - geo.metric_area_series(A.area, A.cy), 2)
    shift = F.round(geo.haversine(A.cx, A.cy, B.cx, B.cy), 2)
    changed = F.array_compact(F.array(*(F.when(~F.col(f"a_{f}").eqNullSafe(F.col(f"b_{f}")), F.lit(f)) for f in fields)))
    out = both.withColumns({"area_delta": area, "shift_m": shift, "changed_fields": changed})
    moved = (F.abs("area_delta") > 0.5) | (F.col("shift_m") > 0.5)
    kind = F.when(F.col("a_there").isNull(), "ADDED").when(F.col("b_there").isNull(), "REMOVED").when(moved | (F.size("changed_fields") > 0), "CHANGED").otherwise("UNCHANGED")
    two = F.col("a_there").isNotNull() & F.col("b_there").isNotNull()
    return out.select(key, kind.alias("change"), F.when(two, F.col("area_delta")).alias("area_delta"), F.when(two, F.col("shift_m")).alias("shift_m"), F.when(two, F.array_join("changed_fields", ",")).alias("changed_fields"))


def statistics(boxes: DataFrame) -> DataFrame:
    box = geo.Box()
    m2 = F.sum(F.round(geo.metric_area_series(box.area, box.cy), 2).cast("decimal(20,2)")).cast("double")
    valid = F.count_if((box.x2 > box.x1) & (box.y2 > box.y1))
    r = lambda c: F.round(c, 6)
    return boxes.agg(F.count("*").alias("features"), m2.alias("area_m2"), F.round(m2 / 10_000, 4).alias("hectares"), F.round(valid * 100.0 / F.count("*"), 2).alias("valid_pct"), r(F.min("x1")).alias("min_x"), r(F.min("y1")).alias("min_y"), r(F.max("x2")).alias("max_x"), r(F.max("y2")).alias("max_y"))


def clusters(found: DataFrame, boxes: DataFrame) -> DataFrame:
    """Conflicts by cell of a hundredth of a degree: counts, records, fields, mean centroid and padded extent."""
    box = geo.Box()
    at = found.join(boxes.select("a_id", F.round(box.cy, 8).alias("lat"), F.round(box.cx, 8).alias("lon")).hint("merge"), "a_id")
    mean = lambda c: F.round(F.avg(F.col(c).cast("decimal(20,8)")).cast("double"), 6)
    out = at.groupBy(F.round("lat", 2).alias("cell_lat"), F.round("lon", 2).alias("cell_lon")).agg(
        F.count("*").alias("conflicts"), F.count_distinct("record_id").alias("records"), F.array_join(F.sort_array(F.collect_set("field_name")), ",").alias("fields"),
        mean("lat").alias("lat"), mean("lon").alias("lon"), F.round(F.min("lon") - 0.001, 6).alias("min_lon"), F.round(F.max("lat") + 0.001, 6).alias("max_lat"),
    )
    return out.withColumn("cluster_id", F.format_string("CLUST_%.2f_%.2f", "cell_lat", "cell_lon"))


def in_box(points: DataFrame, x1: float, y1: float, x2: float, y2: float) -> DataFrame:
    return points.where(F.col("x").between(x1, x2) & F.col("y").between(y1, y2))


def source_pairs(found: DataFrame, boxes: DataFrame) -> DataFrame:
    """Conflicts by cell and by the two datasets that disagree."""
    at = found.join(boxes.select("a_id", F.round(geo.Box().cy, 8).alias("lat"), F.round(geo.Box().cx, 8).alias("lon")), "a_id")
    return at.groupBy(F.round("lat", 2).alias("cell_lat"), F.round("lon", 2).alias("cell_lon"), "source_a", "source_b").agg(F.count("*").alias("conflicts"))


def near(points: DataFrame, lon: float, lat: float, metres: float, limit: int | None = None) -> DataFrame:
    d = F.round(geo.haversine(F.col("x"), F.col("y"), F.lit(lon), F.lit(lat)), 2)
    out = points.withColumn("metres", d).where(F.col("metres") <= metres).orderBy("metres", "id")
    return out.limit(limit) if limit else out
