import pytest

from parcelforge.operators import decisions
from parcelforge.operators.decisions import Decision


def test_decisions(spark):
    items = spark.createDataFrame([("a", "CRITICAL"), ("b", "LOW"), ("c", "NONE")], "record_id string, severity string")
    log = spark.createDataFrame([], decisions.LOG)
    for bad in (Decision("b", "X", "r"), Decision("a", "ACCEPT_SOURCE_A", "r"), Decision("b", "REJECT_UNRESOLVED", "r", " "), Decision("b", "MERGE_RECONCILE", "r", "n"), Decision("z", "ACCEPT_SOURCE_A", "r")):
        with pytest.raises(ValueError):
            decisions.decide(log, items, [bad])
    out = decisions.decide(log, items, [Decision("a", "ACCEPT_SOURCE_A", "r", "seen"), Decision("b", "MERGE_RECONCILE", "r", "n", "SOURCE_B", {"land_use": "farm", "id": "7"}), Decision("c", "REJECT_UNRESOLVED", "r", "no")])
    got = {r.record_id: r for r in out.collect()}
    assert got["a"].override and got["b"].attributes == {"land_use": "farm"}
    assert [got[k].status for k in "abc"] == ["RESOLVED", "RESOLVED", "REJECTED"]


def test_finalize(spark):
    decisions.finalize(spark.createDataFrame([(0,)], "pending int"))
    with pytest.raises(ValueError):
        decisions.finalize(spark.createDataFrame([(2,)], "pending int"))


def test_resolve(spark):
    df = spark.createDataFrame([("k", "OPEN", [("f1", "10"), ("f2", "12")]), ("m", "OPEN", [])], "conflict_id string, status string, values array<struct<feature_id:string,value:string>>")
    got = {r.conflict_id: r for r in decisions.resolve(df, "k", "SOURCE_SELECTION", "by deed", feature_id="f2").collect()}
    assert (got["k"].status, got["k"].resolved_value, got["m"].status) == ("RESOLVED", "12", "OPEN")
    for args in (("k", "OTHER", "c"), ("k", "MANUAL_VALUE", "c"), ("k", "SOURCE_SELECTION", " "), ("z", "MANUAL_VALUE", "c")):
        with pytest.raises(ValueError):
            decisions.resolve(df, *args)
    with pytest.raises(ValueError):
        decisions.resolve(df, "k", "SOURCE_SELECTION", "c", feature_id="f9")


def test_dismissals_need_a_comment_and_an_open_conflict(spark):
    df = spark.createDataFrame([("a", "OPEN"), ("b", "RESOLVED"), ("c", "OPEN")], "conflict_id string, status string")
    got = {r.conflict_id: (r.status, r.comment) for r in decisions.dismiss(df, "a", " small ").collect()}
    assert got == {"a": ("DISMISSED", "small"), "b": ("RESOLVED", None), "c": ("OPEN", None)}
    twice = decisions.dismiss(decisions.dismiss(df, "a", "x"), "c", "y")
    assert {r.conflict_id: r.comment for r in twice.collect()} == {"a": "x", "b": None, "c": "y"}
    for key, comment in (("a", " "), ("b", "x"), ("d", "x")):
        with pytest.raises(ValueError):
            decisions.dismiss(df, key, comment)
