"""What plans carry and how often they make it, where tables are large."""

import re

import pytest
from conftest import DATA

from parcelforge.operators import attributes, graph, matching
from parcelforge.plans import catalog, catalog_files, catalog_wide
from parcelforge.session import stored


def exchanges(spark, df):
    """What each exchange of the plan carries and by what it deals: [(columns, keys)]."""
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    spark.conf.set("spark.sql.debug.maxToStringFields", "1000")
    text = df._jdf.queryExecution().explainString(mode)
    spark.conf.unset("spark.sql.debug.maxToStringFields")
    return re.findall(r"\(\d+\) Exchange\nInput \[\d+\]: \[(.*)\]\nArguments: (.*)", text)


def test_pairs_of_records_carry_no_attributes(spark):
    """The values of both sides join the best matches, behind the windows over all pairs."""
    held = [columns for columns, keys in exchanges(spark, catalog.Inputs(spark, DATA).records) if "_cell_x" in keys]
    assert len(held) == 2 and not any(c in columns for columns in held for c in ("a_land_use", "b_land_use", "b_mutation", "a_risk", "a_survey"))


def test_detailed_gives_each_match_the_columns_of_its_sources(spark):
    a = spark.createDataFrame([(1, "x"), (2, None)], "a_id int, a_use string")
    b = spark.createDataFrame([(7, "y"), (8, "z")], "b_id int, b_use string")
    m = spark.createDataFrame([(1, 8, "x", 0.5), (2, 7, None, 0.4)], "a_id int, b_id int, a_use string, score double")
    got = matching.detailed(m, a, b).select("a_id", "b_id", "a_use", "b_use", "score")
    assert sorted(map(tuple, got.collect())) == [(1, 8, "x", "z", 0.5), (2, 7, None, "y", 0.4)]


def test_several_values_of_a_record_are_shuffled_once(spark):
    rows = spark.createDataFrame([(1, "owner", "s", "Ann"), (1, "owner", "t", "ann"), (1, "owner", "u", None), (2, None, "s", "x"), (2, None, "t", "y"), (3, "address", "s", "1 Long Street"), (3, "address", "t", "long street"), (4, "address", "s", "a"), (4, "address", "t", "b")], "record_id int, attribute string, source string, value string")
    found = attributes.multi_source(rows.where("attribute <> 'address' or attribute is null"))
    # Once for addresses and once for the others, which are told apart by a filter.
    dealt = [keys for _, keys in exchanges(spark, found)]
    assert len(dealt) <= 2 and all("REPARTITION_BY_COL" in keys for keys in dealt)
    assert sorted(map(tuple, attributes.multi_source(rows).collect())) == [(1, "owner", "NULL_VALUE_CONFLICT", 3, 1, None), (2, None, "VALUE_MISMATCH", 2, 2, None), (4, "address", "VALUE_MISMATCH", 2, 2, None)]


@pytest.mark.parametrize("name", ["merge_idempotent", "merge_validation", "merge_unified_all", "evidence_bundles"])
def test_records_are_made_once(spark, name):
    """Stages of one query that follow from the records read them as stored: its plan holds no distance join."""
    assert not any("_cell_x" in keys for _, keys in exchanges(spark, catalog_wide.QUERIES[name](spark, DATA)))


@pytest.mark.parametrize("name", ["merge_validation", "merge_unified_all", "evidence_bundles", "export_records"])
def test_stored_records_are_not_broadcast(spark, name):
    """A stored table's files tell little of how many rows a few of its columns are."""
    # Decisions, by a_id, are a table of their own.
    query = catalog_files.QUERIES[name] if name in catalog_files.QUERIES else catalog_wide.QUERIES[name]
    assert "BroadcastHashJoin" not in query(spark, DATA)._jdf.queryExecution().executedPlan().toString().replace("BroadcastHashJoin [a_id", "")


#: Queries over pairs of boxes, whose sides are as large as the rows that their cells make.
OVER_PAIRS = [
    "candidate_pairs_within",
    "centroid_candidates",
    "component_members",
    "components",
    "components_assigned",
    "demo_review_seed",
    "explanation_text",
    "match_best_page",
    "match_filtered_page",
    "match_list_page",
    "match_ranked",
    "match_scored",
    "match_scored_stage",
    "match_signals",
    "match_table_page",
    "pair_lookup",
    "pair_metrics",
    "polygon_overlap",
]


@pytest.mark.parametrize("name", OVER_PAIRS)
def test_nothing_is_broadcast_where_pairs_are_made(spark, monkeypatch, name):
    """The driver would hold what is broadcast; files tell little of its size."""
    made = []
    monkeypatch.setattr(graph, "stored", lambda df, label: made.append(df) or stored(df, label))
    made.append(catalog_wide.QUERIES[name](spark, DATA))
    plans = [df._jdf.queryExecution().executedPlan().toString() for df in made]
    over_pairs = [p for p in plans if "_cell_x" in p]
    assert over_pairs and not any("Broadcast" in p for p in over_pairs)


def test_components_and_records_are_not_broadcast_to_each_other(spark):
    found = spark.createDataFrame([(1, 1), (2, 1), (3, 3), (4, 3), (5, 5)], "node bigint, component bigint")
    earlier = spark.createDataFrame([(2, "R2"), (1, "R1"), (4, "R4")], "node bigint, record string")
    out = graph.assign(found, earlier)
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, out.collect())) == [(1, "R1", 1), (3, "R4", 0), (5, None, 0)]


@pytest.mark.parametrize("name", ["unified_list_page", "unified_geometry_status", "adjudication_queue"])
def test_decisions_are_not_broadcast(spark, name):
    """A tenth of a large table's files looked small enough, and its rows were ten times as large."""
    assert "Broadcast" not in catalog_wide.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
