"""Every query against its DuckDB text on the smallest tables."""

import duckdb
import pytest

from parcelforge.plans import catalog, catalog_wide, oracle, oracle_more, oracle_wide

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


QUERIES, SQL = catalog_wide.QUERIES, oracle.SQL | oracle_more.SQL | oracle_wide.SQL


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    yield c
    c.close()


def rows(df):
    columns = sorted(df.columns)
    clean = df[columns].astype(object).where(df[columns].notna(), None)
    show = lambda v: "-" if v is None else f"{float(v):.6f}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return columns, sorted(tuple(map(show, r)) for r in clean.values.tolist())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = rows(QUERIES[name](spark, DATA).toPandas())
    assert got[1]
    if name in SQL:
        assert got == rows(duck.sql(SQL[name]).df())


def test_only_vectors_lack_a_text():
    assert set(QUERIES) - set(SQL) == {"hashed_embedding_search", "nlq_spatial_plan"}


def test_grid_size_does_not_matter(spark):
    from parcelforge.operators import grid

    i = catalog.Inputs(spark, DATA)
    one, two = (grid.join(i.parcels, i.structures, 50.0, cell=c).select("a_id", "b_id") for c in (0.0003, 0.01))
    assert one.exceptAll(two).isEmpty() and two.exceptAll(one).isEmpty() and one.count() == one.distinct().count()
