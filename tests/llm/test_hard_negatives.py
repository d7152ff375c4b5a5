"""Hard negatives against plain inner products of all pairs."""

import math
import random

import numpy as np
import pytest

from parcelforge.llm import hard_negatives as m

KINDS = "vec_id long, embedding array<float>, label int"


def plain(rows):
    kept = {}
    for i, v, lab in rows:
        if i is None or lab is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        q = tuple(math.floor(256 * float(np.float32(x))) for x in v)
        kept[i, (lab + 1) % 10 if i % 7 == 0 else lab, q] = 1
    kept = list(kept)
    out = []
    for a in kept:
        if a[0] % 100:
            continue
        score = lambda r: sum(x * y for x, y in zip(a[2], r[2]))  # noqa: B023, E731
        order = lambda r: (-score(r), r[0])  # noqa: B023, E731
        for p in sorted((r for r in kept if r is not a and r[1] == a[1]), key=order)[:5]:
            fit = [r for r in kept if r[1] != a[1] and 80 * score(p) <= 100 * score(r) <= 100 * score(p)]
            out += [(a[0], p[0], k + 1, r[0], score(p), score(r)) for k, r in enumerate(sorted(fit, key=order)[:5])]
    return sorted(out)


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def some(seed, n, dims, wide=1.0):
    draw = random.Random(seed)
    rows = [(i, [draw.gauss(0.2, 0.3) * wide for _ in range(dims)], draw.randrange(4)) for i in range(n)]
    rows += [(n + i, rows[5][1], draw.randrange(4)) for i in range(30)]  # ties
    rows += [(None, rows[0][1], 1), (9001, None, 1), (9002, rows[1][1], None), (9003, [float("nan")] * dims, 1), (9004, [None] * dims, 1), (9005, [math.inf] * dims, 1), rows[0], rows[100], rows[3]]
    return rows


@pytest.mark.parametrize(("dims", "wide"), [(64, 1.0), (13, 1.0), (8, 30000.0)])
def test_against_plain_products(spark, dims, wide):
    rows = some(dims, 320, dims, wide)
    got = rows_of(m.mine(spark.createDataFrame(rows, KINDS), anchors_at_once=2, rows_at_once=60, least_rows=40))
    assert got == plain(rows)
    assert got


def test_many_steps(spark, monkeypatch):
    monkeypatch.setattr(m, "A_STEP", 1)
    monkeypatch.setattr(m, "R_STEP", 7)
    rows = some(1, 205, 16)
    assert rows_of(m.mine(spark.createDataFrame(rows, KINDS))) == plain(rows)


def test_lengths_labels_and_nothing(spark):
    assert m.mine(spark.createDataFrame([], KINDS)).collect() == []
    assert m.mine(spark.createDataFrame([(100, [1.0], 1)], KINDS)).collect() == []
    rows = [(100, [1.0, 1.0], 2147483647), (1, [1.0], 2147483647), (2, [1.0], 3), (3, [], 3), (7, [1.0, 2.0], 2147483646), (0, [], 5), (4, [2.0], 5), (8, [1.0], 1), (14, [0.5, 0.5], -3)]
    odd = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], KINDS + ", th int, q int, planes int")
    got = rows_of(m.mine(odd))
    assert (100, 1, 1, 2, 65536, 65536) in got
    assert all(r[4] == 0 == r[5] for r in got if r[0] == 0)


def test_scores_of_planes():
    draw = np.random.default_rng(3)
    for high in (1, 200, 1 << 33):
        q, a = draw.integers(-high, high, (50, 24)), draw.integers(-high, high, (9, 24))
        packed = m.planes(q, high.bit_length() + 1)
        assert (m.numbers(packed) == q).all()
        with np.errstate(over="ignore"):
            assert (m.scores(m.tables(a), packed) == q @ a.T).all()


def test_against_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute("create view embeddings as select * from read_parquet('/root/testdata/sf0.01/embeddings.parquet')")
    got = con.execute(f"select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from ({m.SQL})").fetchall()
    assert got
    assert sorted(got) == rows_of(m.query(spark, "/root/testdata/sf0.01"))
