"""Lists, projects, runs and stages on small frames."""

import pytest
from pyspark.sql import functions as F

from parcelforge.functions import text
from parcelforge.operators import attributes, graph, harmonize, listing, matching, projects, review
from parcelforge.functions.scoring import MatchConfig
from parcelforge.sources import synthetic


def test_search_terms_are_patterns_and_all_is_no_filter(spark):
    df = spark.createDataFrame([("r1", "OPEN", "a_b"), ("r2", "open", "axb"), ("r3", None, None)], "record_id string, status string, field_name string")
    ids = lambda x: sorted(r.record_id for r in x.collect())
    assert ids(listing.equal(df, "status", " open ")) == ["r1", "r2"]
    assert ids(listing.equal(df, "status", "all")) == ids(listing.equal(df, "status", None)) == ["r1", "r2", "r3"]
    assert ids(listing.like(df, "A_B", "field_name")) == ["r1", "r2"]  # the wildcard counts
    assert ids(listing.holds(df, "A_B", "field_name")) == ["r1"]
    assert ids(listing.like(df, " ", "field_name")) == ["r1", "r2", "r3"]


def test_table_sorts_nulls_by_their_stand_in(spark):
    rows = [(1, 1, "x", 0.9, 2), (2, 1, "y", 0.8, None), (3, 1, "z", 0.1, 1)]
    df = spark.createDataFrame(rows, "a_id int, b_id int, source_identifier string, score double, rank int")
    df = df.withColumns({c: F.lit("d") for c in ("candidate_identifier", "source_dataset", "candidate_dataset")})
    page = lambda **o: [r.a_id for r in listing.match_table(df, **o).collect()]
    assert page(sort="rank", descending=False) == [3, 1, 2]
    assert page(least_pct=50, sort="score") == [1, 2]
    assert page(sort="score", page_number=2, page_size=2) == [3]


def test_runs_need_datasets_of_their_project(spark):
    sets = spark.createDataFrame([("a", "p"), ("b", "p"), ("c", "q")], "dataset_id string, project_id string")
    projects.checked_run(sets, "p", "a", ["b"])
    for source, candidates in (("a", []), ("a", ["a", "b"]), ("a", ["c"]), ("a", ["none"])):
        with pytest.raises(ValueError):
            projects.checked_run(sets, "p", source, candidates)


def test_failed_runs_are_rows(spark, tmp_path):
    runs = spark.createDataFrame([], "run_id string, status string, rows bigint, message string")
    runs = projects.recorded(runs, "one", lambda: spark.range(5), str(tmp_path / "one"))
    runs = projects.recorded(runs, "two", lambda: spark.range(5).select(F.raise_error(F.lit("no luck"))), str(tmp_path / "two"))
    got = {r.run_id: r for r in runs.collect()}
    assert (got["one"].status, got["one"].rows) == ("completed", 5)
    assert got["two"].status == "failed" and got["two"].rows is None and got["two"].message


def test_deleting_a_dataset_takes_versions_and_features(spark):
    sets = spark.createDataFrame([("a", "p"), ("b", "p")], "dataset_id string, project_id string")
    versions = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3)], "dataset_id string, version_id int")
    features = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "version_id int, name string")
    left = projects.without_dataset(sets, versions, features, "a")
    assert [df.count() for df in left] == [1, 1, 1]
    assert projects.without_project({"s": sets}, "p")["s"].count() == 0


def test_points_have_their_own_signals(spark):
    box = (0.0, 0.0, 0.001, 0.001)
    rows = [(*box, 0.0005, 0.0005, 0.0005, 0.0005), (*box, 0.0011, 0.0005, 0.0011, 0.0005), (*box, *box)]
    df = spark.createDataFrame(rows, ", ".join(f"{p}_{c} double" for p in "ab" for c in ("x1", "y1", "x2", "y2")))
    got = matching.signals(df, F.lit(0.5)).select("spatial", "area", "geometry", "centroid").collect()
    assert [r.geometry for r in got][::2] == [1.0, 1.0] and got[1].geometry == got[1].centroid
    assert [r.spatial for r in got] == [None, None, 1.0] and [r.area for r in got] == [None, None, 1.0]
    assert (MatchConfig.stage().matched, MatchConfig.stage().possible, MatchConfig.stage(radius=9).radius) == (0.75, 0.55, 9)


def test_unsound_geometries_fail_and_weigh_nothing(spark):
    rows = [("VALID", "VALID"), ("self-intersection", "VALID"), ("VALID", "EMPTY"), ("NULL", "VALID")]
    df = spark.createDataFrame([(f"{k}_1", k, 1, *r) for k, r in enumerate(rows)], "record_id string, a_id int, b_id int, source_geometry_state string, candidate_geometry_state string")
    text_ = ("land_use", "mutation", "risk", "survey")
    df = df.withColumns({f"{s}_{c}": F.lit("x") for s in ("source", "candidate") for c in text_} | {c: F.lit("x") for c in ("land_use", "mutation", "risk", "role")})
    df = df.withColumns({"spatial": F.lit(0.95), "geometry": F.lit(0.9), "attribute": F.lit(0.9), "centroid_m": F.lit(1.0), "area_pct": F.lit(0.0), "source_area": F.lit(10.0), "candidate_area": F.lit(10.0), "geometry_status": F.lit("CONGRUENT"), "score_gap": F.lit(0.5), "candidate_count": F.lit(1)})
    got = harmonize.confidence(harmonize.validated(harmonize.counted(df))).orderBy("a_id").collect()
    assert [r.geometry_check for r in got] == ["PASS", "FAIL", "FAIL", "FAIL"]
    assert [r.geometry_failure for r in got] == [None, "source geometry: self-intersection", "candidate geometry: EMPTY", "source geometry: NULL"]
    assert [r.s_geometry for r in got] == [0.9, 0.0, 0.0, 0.0] and [r.critical for r in got] == [0, 1, 1, 1]
    by_join = harmonize.validated(df, harmonize.conflicts(df)).orderBy("a_id").collect()
    assert [(r.overall, r.critical, r.unresolved) for r in by_join] == [(r.overall, r.critical, r.unresolved) for r in got]


def test_roles_maps_and_orders(spark):
    v = spark.createDataFrame([(1, "area", "CADASTRAL", "5"), (1, "area", "DRONE", "6"), (1, "area", "DRONE", None), (2, "area", "DRONE", None)], "record_id int, attribute string, role string, value string")
    assert [(r.record_id, r.by_role) for r in attributes.by_role(v).collect()] == [(1, {"CADASTRAL": "5", "DRONE": "6"})]
    s = review.role_statistics(v).first()
    assert (s.records, s.average_sources, s.with_cadastral, s.with_drone, s.with_municipal) == (2, 2.0, 1, 2, 0)
    o = spark.createDataFrame([(1, "b", 1), (1, "a", 2), (1, "b", 3)], "record_id int, x string, n int")
    assert attributes.in_order(o, "x", "n").first()["items"] == ["b", "a"]
    d = spark.sql("select map('a', 1, 'b', 2) as o, map('b', 3, 'c', null) as n").select(text.map_diff("o", "n").alias("d")).first().d
    assert {k: (x.old, x.new) for k, x in d.items()} == {"a": (1, None), "b": (2, 3)}


def test_components_go_on_as_their_smallest_record(spark):
    found = spark.createDataFrame([(1, 1), (2, 1), (3, 3), (4, 4)], "node int, component int")
    old = spark.createDataFrame([(1, "R2"), (2, "R1"), (4, "R9"), (8, "R0")], "node int, record string")
    assert {r.component: (r.record, r.merged) for r in graph.assign(found, old).collect()} == {1: ("R1", 1), 3: (None, 0), 4: ("R9", 0)}


def test_synthetic_surveys_match_themselves(spark):
    p = synthetic.parcels(spark, 80)
    s = synthetic.structures(p)
    assert (p.count(), s.count()) == (80, 80 - 7)
    assert p.select("parcel_id").distinct().count() == 80 and p.where("area_sqm <= 0").isEmpty()
