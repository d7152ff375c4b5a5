"""Published figures of single functions, and properties."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from parcelforge.functions import crs, geo, poly, scoring, text
from parcelforge.operators import analysis, assistant, graph, harmonize, language, matching, merge, rank


def one(spark, column, **values):
    df = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())) if values else spark.range(1)
    return df.select(column.alias("x")).first().x


def boxes(a, b):
    return {f"{p}_{c}": float(v) for p, box in (("a", a), ("b", b)) for c, v in zip(("x1", "y1", "x2", "y2"), box)}


def test_haversine(spark):
    assert one(spark, geo.haversine(F.lit(73.8567), F.lit(18.5204), F.lit(73.8577), F.lit(18.5204))) == pytest.approx(105.436, abs=0.01)


def test_box_iou(spark):
    a, b = geo.Box("a_"), geo.Box("b_")
    assert one(spark, geo.iou(a, b), **boxes((0, 0, 2, 2), (0, 0, 2, 2))) == 1.0
    assert one(spark, geo.iou(a, b), **boxes((0, 0, 2, 2), (1, 0, 3, 2))) == pytest.approx(1 / 3)
    assert one(spark, geo.iou(a, b), **boxes((0, 0, 1, 1), (5, 5, 6, 6))) == 0.0


def test_scores(spark):
    config = scoring.MatchConfig()

    def status(spatial, centroid, area, geometry, attribute):
        own = {k: F.lit(v).cast("double") for k, v in dict(spatial=spatial, centroid=centroid, area=area, geometry=geometry, attribute=attribute).items()}
        score = scoring.overall(own, config)
        row = spark.range(1).select(score.alias("s"), scoring.status(score, own, config).alias("t")).first()
        return row.s, row.t

    s, t = status(None, 0.95, None, 0.95, 0.90)
    assert s > 0.9 and t == "matched"
    assert status(0.95, 0.95, 0.90, 0.95, 0.05)[1] == "conflict"
    assert status(0.0, 0.0, 0.2, 0.0, 0.1)[1] == "unmatched"
    with pytest.raises(ValueError):
        scoring.MatchConfig(radius=0)


@pytest.mark.parametrize("scores, roles, gap", [((0.91, 0.72, 0.55), ["BEST", "SECONDARY", "SECONDARY"], 0.19), ((0.850, 0.842), ["AMBIGUOUS", "AMBIGUOUS"], 0.008)])
def test_ranks(spark, scores, roles, gap):
    rows = [(1, k, s, "matched") for k, s in enumerate(scores)]
    got = matching.ranked(spark.createDataFrame(rows, "a_id int, b_id int, score double, status string")).orderBy("rank").collect()
    assert [r.role for r in got] == roles and [r.rank for r in got] == list(range(1, len(scores) + 1))
    assert all(r.score_gap == pytest.approx(gap) for r in got) and got[0].is_best == (roles[0] == "BEST")


def test_attribute_similarity(spark):
    def score(a, b):
        df = spark.createDataFrame([(a, b)], "a map<string,string>, b map<string,string>")
        return scoring.attribute_similarity(df, "a", "b").first().attribute

    assert score({"parcel_id": "P1", "owner": "Ann Lee", "area": "100"}, {"parcel_no": "P1", "owner_name": "ann lee", "area": "99"}) > 0.9
    assert score({"parcel_id": "P1", "owner": "x"}, {"id": "Q", "name": "y"}) < 0.1
    assert score({}, {"a": "b"}) == 0.5 and score({"a": "1"}, {"b": "1"}) == 0.5
    assert score({"x": "one two three"}, {"X": "two three four"}) == 0.5
    assert score({"x": "0"}, {"x": "0.0"}) == 1.0


def test_classes(spark):
    c = lambda f, v: one(spark, f("v"), v=v)
    assert [c(text.land_use, v) for v in ("Forest", "Paddy field", "institutional", "Retail", "—", "odd")] == ["RESIDENTIAL", "AGRICULTURAL", "VACANT", "COMMERCIAL", None, "ODD"]
    assert [c(text.mutation, v) for v in ("disapproved", "in court", "awaiting")] == ["APPROVED", "DISPUTED", "PENDING"]
    assert [c(text.risk, v) for v in ("Severe", "amber", "safe")] == ["CRITICAL", "MEDIUM", "LOW"]
    assert one(spark, text.key("v"), v="Parcel-ID 7") == "parcelid7"
    assert one(spark, text.slug("v"), v="  a/b c.csv") == "a_b_c.csv"
    assert [one(spark, text.source_role("v"), v=v) for v in ("Cadastral 2020", "Drone survey", "Muni tax", "x")] == ["CADASTRAL", "DRONE", "MUNICIPAL", "OTHER"]


def test_buckets(spark):
    got = [one(spark, harmonize.bucket(F.lit(s), F.lit(False), F.lit(False))) for s in (0.92, 0.90, 0.85, 0.70, 0.69)]
    assert got == ["HIGH", "HIGH", "MEDIUM", "MEDIUM", "LOW"]
    assert one(spark, harmonize.bucket(F.lit(0.99), F.lit(True), F.lit(False))) == "AMBIGUOUS"
    equal = harmonize.ConfidenceConfig(spatial=1, geometry=1, attribute=1, temporal=1).weights()
    assert sum(equal.values()) == 1 and sum(w * s for w, s in zip(equal.values(), (1, 0.8, 0.8, 0.6))) == pytest.approx(0.8)


def test_crs():
    assert [crs.normalize(x) for x in ("4326", "epsg:4326", "WGS 84", "", None, "EPSG:999999999", "EPSG:32643")] == ["EPSG:4326"] * 3 + ["missing"] * 2 + ["invalid", "EPSG:32643"]
    x, y = crs.to_zone([73.8567], [18.5204], 32643)
    assert x[0] == pytest.approx(379_313, abs=60) and y[0] == pytest.approx(2_048_166, abs=200)
    for code in (32643, 32743, 3857):
        u, v = crs.transform(*crs.transform([73.8567, 77.2], [18.5204, -28.6], "4326", f"EPSG:{code}"), f"EPSG:{code}")
        assert np.allclose(u, [73.8567, 77.2], atol=1e-7) and np.allclose(v, [18.5204, -28.6], atol=1e-7)
    with pytest.raises(ValueError):
        crs.transform(1, 1, "EPSG:1")


coordinate = st.floats(0, 10).map(lambda v: round(v, 2))


@settings(max_examples=150, deadline=None)
@given(*[coordinate] * 8)
def test_polygon_kernels_equal_boxes(a, b, c, d, e, f, g, h):
    def ring(x1, y1, x2, y2):
        (x1, x2), (y1, y2) = sorted((x1, x2)), sorted((y1, y2))
        return [np.array([[x1, y1], [x2, y1], [x2, y2], [x1, y2], [x1, y1]])], (x1, y1, x2, y2)

    (p, s), (q, t) = ring(a, b, c, d), ring(e, f, g, h)
    inter = max(0, min(s[2], t[2]) - max(s[0], t[0])) * max(0, min(s[3], t[3]) - max(s[1], t[1]))
    assert poly.intersection_area(p, q) == pytest.approx(inter, abs=1e-6) == pytest.approx(poly.intersection_area(q, p), abs=1e-6)
    assert 0 <= poly.iou(p, q) <= 1


def test_polygons_with_holes_and_faults():
    shell = [[0, 0], [4, 0], [4, 4], [0, 4], [0, 0]]
    hole = [[1, 1], [1, 3], [3, 3], [3, 1], [1, 1]]
    donut = poly.rings([shell, hole])
    assert poly.area(donut) == 12 and poly.centroid(donut) == pytest.approx((2, 2))
    assert not poly.inside(2, 2, donut) and poly.inside(0.5, 0.5, donut)
    assert poly.intersection_area(donut, poly.rings([[[1, 1], [3, 1], [3, 3], [1, 3], [1, 1]]])) == pytest.approx(0)
    bow = poly.rings([[[0, 0], [2, 2], [2, 0], [0, 2], [0, 0]]])
    assert poly.reason(bow) == "Self-intersection" and poly.reason(poly.mended(bow)) == "Valid Geometry"
    assert [poly.reason(x) for x in (None, [], poly.rings([[[0, 0], [1, 1], [0, 0]]]), donut)] == ["Null geometry", "Empty geometry", "Too few points", "Valid Geometry"]
    lshape = poly.rings([[[0, 0], [4, 0], [4, 1], [1, 1], [1, 4], [0, 4], [0, 0]]])
    assert poly.intersection_area(lshape, poly.rings([shell])) == pytest.approx(7)
    assert poly.contains(poly.rings([shell]), lshape) and poly.intersects(donut, lshape)
    assert poly.area(poly.buffer_point(0, 0, 1)) == pytest.approx(np.pi, rel=0.01)


def test_geometry_texts():
    for kind, c in (("POINT", [1.5, -2.25]), ("LINESTRING", [[0.0, 1.0], [2.0, 3.0]]), ("POLYGON", [[[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 0.0]]]), ("MULTIPOLYGON", [[[[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 0.0]]]])):
        assert poly.from_wkt(poly.to_wkt(kind, c)) == (kind, c)
        assert poly.from_wkb(poly.to_wkb(kind, c)) == (kind, c)
        assert poly.from_geojson(poly.geojson(kind, c)) == (kind, c)


def test_st_functions(spark):
    df = spark.createDataFrame([("POLYGON ((0 0, 2 0, 2 2, 0 2, 0 0))", "POLYGON ((1 0, 3 0, 3 2, 1 2, 1 0))"), (None, None)], "a string, b string")
    got = df.select(poly.st_iou("a", "b").alias("i"), poly.st_area("a").alias("m"), poly.st_reason("a").alias("r")).collect()
    assert got[0].i == pytest.approx(1 / 3) and got[0].m == 4 and [r.r for r in got] == ["Valid Geometry", "Null geometry"]


# ------------------------------------------------------------------ state


def test_merge_is_idempotent(spark):
    schema = "k string, v int, status string"
    store = spark.createDataFrame([("a", 1, "OPEN"), ("b", 1, "RESOLVED"), ("c", 1, "IN_REVIEW")], schema)
    found = spark.createDataFrame([("a", 2, "OPEN"), ("b", 2, "OPEN"), ("d", 2, "OPEN")], schema)
    once = merge.merge(store, found, "k")
    assert {tuple(r) for r in once.collect()} == {("a", 2, "OPEN", "updated"), ("b", 2, "RESOLVED", "updated"), ("c", 1, "IN_REVIEW", "stale"), ("d", 2, "OPEN", "created")}
    twice = merge.merge(once.drop("change"), found, "k")
    assert twice.where("change = 'created'").isEmpty()
    assert twice.drop("change").exceptAll(once.drop("change")).isEmpty()


def test_history(spark):
    df = spark.createDataFrame([(1, "OPEN", [("OPEN", "t0", "x")])], "id int, status string, history array<struct<status:string,at:string,by:string>>")
    r = merge.with_history(df, "RESOLVED", "t1", "y").first()
    assert r.status == "RESOLVED" and [h.status for h in r.history] == ["OPEN", "RESOLVED"]


def test_components_of_a_chain(spark):
    edges = [(k, k + 1) for k in range(50)] + [(100, 101), (7, 7)]
    random.Random(2).shuffle(edges)
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**dict.fromkeys(range(51), 0), 100: 100, 101: 100}


def test_global_rank(spark):
    df = spark.createDataFrame([(random.Random(k).randint(0, 50), k) for k in range(200)], "a int, b int").repartition(7)
    got = {(r.a, r.b): r.rn for r in rank.global_rank(df, ("a", "b")).collect()}
    assert [got[k] for k in sorted(got)] == list(range(1, 201))


def test_version_diff_counts(spark):
    schema = "id int, x1 double, y1 double, x2 double, y2 double, land string"
    old = spark.createDataFrame([(1, 0.0, 0.0, 0.001, 0.001, "a"), (2, 1.0, 0.0, 1.001, 0.001, "b")], schema)
    new = spark.createDataFrame([(1, 0.0, 0.0, 0.001, 0.001, "a"), (2, 1.0, 0.0, 1.001, 0.001, "c"), (3, 2.0, 0.0, 2.001, 0.001, "d")], schema)
    got = {r.id: r.change for r in analysis.version_diff(old, new, "id", ("land",)).collect()}
    assert got == {1: "UNCHANGED", 2: "CHANGED", 3: "ADDED"}


# ------------------------------------------------------------------ words


def test_intents(spark):
    asked = {
        "Which conflicts are within 200m of the river?": "COMPLEX_SPATIAL_INVESTIGATION",
        "Show conflict hotspots": "SPATIAL_CONFLICT_ANALYSIS",
        "compare the dataset of 2020": "DATASET_COMPARISON",
        "Why was it resolved?": "CONFLICT_EXPLANATION",
        "18.5204, 73.8567": "SPATIAL_PROXIMITY",
        "who accepted it": "PROVENANCE_TRACE",
        "ULR-000001": "RECORD_INVESTIGATION",
        "residential": "ATTRIBUTE_SEARCH",
        "how many": "PROJECT_OVERVIEW",
        "hello": "GENERAL_GIS_QUERY",
    }
    got = spark.createDataFrame([(q,) for q in asked], "q string").select("q", assistant.intent("q").alias("i")).collect()
    assert {r.q: r.i for r in got} == asked
    assert assistant.plan("SEMANTIC_SEARCH") == ("rag", "db")


def test_plans(spark):
    data = spark.createDataFrame([("p", "Cadastral Parcels", "Polygon", ["parcel_id"]), ("p", "Municipal Assets", "Point", ["asset_id"]), ("q", "Parcels of another", "Polygon", ["parcel_id"])], "project_id string, name string, geometry string, attributes array<string>")
    asked = spark.createDataFrame([(1, "p", "find parcels within 2 km of municipal assets"), (2, "p", "weather"), (3, "r", "parcels"), (4, "p", "do assets overlap parcels")], "question_id int, project_id string, question string")
    got = {r.question_id: (r.target, r.reference, r.metres, r.analysis) for r in language.spatial_plans(asked, data).collect()}
    assert got[1] == ("Cadastral Parcels", "Municipal Assets", 2000.0, "proximity")
    assert got[2] == got[3] == (None, None, 100.0, "proximity")
    # Without "which", "find" or "show" a question about parcels and assets is about parcels.
    assert got[4] == ("Cadastral Parcels", "Municipal Assets", 100.0, "intersection")
    rated = {r.name: r.confidence for r in language.scores(spark.createDataFrame([("p", "parcels")], "project_id string, phrase string"), data).collect()}
    assert rated == {"Cadastral Parcels": 1.0, "Municipal Assets": 0.0}
    assert assistant.distance_of("300 ft") == pytest.approx(91.44)
    assert assistant.coordinates_of("at 18.52, 73.85") == (18.52, 73.85)


def test_plans_take_all_forms(spark):
    data = spark.createDataFrame([("p", "Cadastral Parcels", "Polygon", ["parcel_id"]), ("p", "Municipal Assets", "Point", ["asset_id"]), ("p", "Drone Structures", "Polygon", []), ("one", "Wards", "Polygon", [])], "project_id string, name string, geometry string, attributes array<string>")
    asked = {
        "which structures overlap parcels": ("Drone Structures", "Cadastral Parcels", 100.0, "intersection", 1.0, False),
        "show assets near 250 m of parcels": ("Municipal Assets", "Cadastral Parcels", 250.0, "proximity", 1.0, False),
        "parcels along a corridor of 75": ("Cadastral Parcels", None, 75.0, "buffer", 1.0, False),
        "compare the drone survey, 5 km": (None, "Drone Structures", 5000.0, "comparison", 0.5, True),
        "closest structures to a municipal pole": ("Drone Structures", "Municipal Assets", 100.0, "nearest", 1.0, False),
        "parcel conflicts concentrated": ("Cadastral Parcels", None, 100.0, "conflicts", 1.0, False),
        "find parcels within 40 m of land parcels": ("Cadastral Parcels", None, 40.0, "proximity", 1.0, False),
        "how is the weather": (None, None, 100.0, "proximity", 0.5, True),
    }
    rows = [(q, "p", q) for q in asked] + [("sole", "one", "how is the weather"), ("nobody", "none", "parcels")]
    got = {r.question_id: r for r in language.spatial_plans(spark.createDataFrame(rows, "question_id string, project_id string, question string"), data).collect()}
    for question, want in asked.items():
        r = got[question]
        assert (r.target, r.reference, r.metres, r.analysis, r.confidence, r.ambiguous) == want, question
    assert (got["sole"].target, got["sole"].confidence, got["sole"].ambiguous) == ("Wards", 0.85, False)
    assert (got["nobody"].target, got["nobody"].confidence, got["nobody"].ambiguous) == (None, 0.5, False)
    assert got["how is the weather"].clarification == "Please specify which dataset you want to inspect: Cadastral Parcels, Drone Structures, Municipal Assets."


def test_intents_know_what_is_at_hand(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("hello", True, False), ("hello", False, True), ("find it", False, True), ("version diff", None, None), ("who accepted it", None, True)], "q string, c boolean, r boolean")
    got = [r.i for r in df.select(assistant.intent("q", F.col("c"), F.col("r")).alias("i")).collect()]
    assert got == ["CONFLICT_EXPLANATION", "RECORD_INVESTIGATION", "ATTRIBUTE_SEARCH", "GENERAL_GIS_QUERY", "PROVENANCE_TRACE"]


def test_embeddings(spark):
    v = assistant.embed("cadastral parcel boundary")
    assert len(v) == 384 and np.linalg.norm(v) == pytest.approx(1, abs=1e-4)
    assert assistant.embed("")[0] == 1.0
    docs = spark.createDataFrame([(1, "parcel boundary dispute"), (2, "weather report"), (3, None)], "doc_id int, text string")
    got = assistant.search(docs, "boundary of the parcel", 2).collect()
    assert got[0].doc_id == 1 and got[0].similarity > got[1].similarity
