"""The grid join against all pairs, with boxes of all sizes."""

import random

import pytest
from pyspark.sql import functions as F

from parcelforge.functions import geo
from parcelforge.operators import grid


def boxes(spark, prefix, n, seed, sizes):
    draw = random.Random(seed)
    rows = []
    for k in range(n):
        w, h = draw.choice(sizes) * draw.random(), draw.choice(sizes) * draw.random()
        x, y = 73 + draw.random() * 0.05, draw.choice([18, -18]) + draw.random() * 0.05
        rows.append((k, x, y, x + w, y + h))
    rows.append((n, None, 18.0, 73.0, 18.1))
    return spark.createDataFrame(rows, ", ".join([f"{prefix}id int", *(f"{prefix}{c} double" for c in ("x1", "y1", "x2", "y2"))])), len(rows)


@pytest.mark.parametrize(("sizes_a", "sizes_b"), [([0.0002, 0.001, 0.05, 3.0], [0.0, 0.0005, 0.02, 1.0]), ([0.0003], [0.0003]), ([5.0], [0.0001]), ([0.0001], [40.0])])
def test_same_pairs_as_all_pairs(spark, sizes_a, sizes_b):
    a, _ = boxes(spark, "a_", 120, 1, sizes_a)
    b, _ = boxes(spark, "b_", 150, 2, sizes_b)
    every = a.dropna().crossJoin(b.dropna()).withColumn("distance", geo.gap(geo.Box("a_"), geo.Box("b_"))).where("distance <= 50").select("a_id", "b_id")
    want = sorted(map(tuple, every.collect()))
    for cell in (None, 0.0003, 0.01):
        assert sorted(map(tuple, grid.join(a, b, 50.0, cell=cell).select("a_id", "b_id").collect())) == want
    assert want


def test_a_province_makes_a_handful_of_rows(spark):
    few = spark.createDataFrame([(1, 70.0, 15.0, 80.0, 22.0), (2, 73.0, 18.0, 73.0003, 18.0003)], "a_id int, a_x1 double, a_y1 double, a_x2 double, a_y2 double")
    none = F.lit(0.0)
    level = grid._level("a_", 0.0005, none, none)
    rows = grid._cells(few, "a_", 0.0005, none, none, level, F.array(F.lit(0)))
    assert {r.a_id: r["count"] for r in rows.groupBy("a_id").count().collect()}[1] <= (grid.SPAN + 1) ** 2
    assert grid.join(few, few.toDF("b_id", "b_x1", "b_y1", "b_x2", "b_y2"), 10.0).count() == 4


def test_cells_are_not_broadcast(spark):
    """However small the files are, a side is as large as the rows its cells make, which the driver would hold."""
    a, _ = boxes(spark, "a_", 20, 1, [0.0003])
    b, _ = boxes(spark, "b_", 20, 2, [0.0003])
    plan = grid.join(a, b, 50.0)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_a_box_makes_few_rows_and_none_where_nothing_can_meet_it(spark):
    """Parcels are three to four smallest cells wide with the radius; structures are of a lower level than all parcels."""
    at = [(k, 73 + k * 0.00095, 18.0, 73.0008 + k * 0.00095, 18.0006) for k in range(50)]
    a = spark.createDataFrame(at, "a_id int, a_x1 double, a_y1 double, a_x2 double, a_y2 double")
    b = spark.createDataFrame([(k, x, y, x + 0.0005, y + 0.0004) for k, x, y, *_ in at], "b_id int, b_x1 double, b_y1 double, b_x2 double, b_y2 double")
    wide, none = F.lit(50 / 110_000.0), F.lit(0.0)
    l_level, r_level = grid._level("a_", 0.0005, wide, wide), grid._level("b_", 0.0005, none, none)
    left = grid._cells(a, "a_", 0.0005, wide, wide, l_level, grid._levels(b, "b_", r_level))
    right = grid._cells(b, "b_", 0.0005, none, none, r_level, grid._levels(a, "a_", l_level))
    assert left.count() <= 50 * 5 and right.count() <= 50 * 3
    # A box without a corner is of no level.
    lost = a.unionByName(a.limit(1).withColumn("a_x1", F.lit(None).cast("double")))
    assert spark.range(1).select(grid._levels(lost, "a_", l_level).alias("l")).first().l == [1]
