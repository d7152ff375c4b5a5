"""Near-duplicates by shingles, against all pairs."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from parcelforge.llm import components, shingle_join, simhash
from parcelforge.llm.common import among, materialize


def words_of(text):
    return tuple((text or "").lower().split())


def plain_set(text):
    w = words_of(text)
    return {w[k : k + 5] for k in range(max(1, len(w) - 4))} if w else set()


def plain_components(texts):
    """Smallest id reachable by links of all pairs."""
    root = {i: i for i in texts}
    sets = {i: plain_set(t) for i, t in texts.items()}
    pairs = [(a, b) for a in texts for b in texts if a < b and (sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]))]
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            m = min(root[a], root[b])
            changed |= root[a] != m or root[b] != m
            root[a] = root[b] = m
    return root


def copies(rng, per_base=14):
    texts = []
    for size in (5, 6, 9, 12, 17, 30, 60, 146, 400):
        base = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(size)]
        for _ in range(per_base):
            w = list(base)
            for _ in range(rng.randint(0, max(1, size // 25))):
                w[rng.randrange(len(w))] = f"edit{rng.randrange(9999)}"
            texts.append(" ".join(w[rng.randint(0, size // 20) :]))
    return texts


def test_linked_sets_have_a_key_in_common():
    rng = np.random.default_rng(5)
    for n in [*range(1, 60), 100, 333, 1000, 5000]:
        for _ in range(30):
            h = rng.integers(0, 1 << 64, n, np.uint64)
            gone = int(rng.integers(0, n // 9 + 1))
            new = max(0, (5 * (n - gone)) // 4 - n)  # as many as a similarity of 0.8 allows
            x, y = np.unique(h), np.unique(np.r_[h[gone:], rng.integers(0, 1 << 64, new, np.uint64)])
            common, either = len(np.intersect1d(x, y)), len(np.union1d(x, y))
            if 5 * common >= 4 * either:
                assert len(np.intersect1d(shingle_join.part_keys(x), shingle_join.part_keys(y)))
                parity = np.bitwise_count(np.frombuffer(shingle_join.parities(x), np.uint64) ^ np.frombuffer(shingle_join.parities(y), np.uint64)).sum()
                assert shingle_join.alike(len(x), len(y), int(parity))


@pytest.mark.parametrize("block", [512, 4])
def test_components_equal_those_of_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(shingle_join, "BLOCK", block)
    rng = random.Random(block)
    texts = [*copies(rng), None, "", " \n", "ONE two", "one Two", "x"]
    rows = [(1000 - k, t, k) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows + [rows[0], (None, "x", 1)], "doc_id long, text string, mark int").repartition(3)
    expected = plain_components({i: t for i, t, _ in rows})
    assert len(set(expected.values())) < len(rows) - 30
    got = shingle_join.near_duplicates(df).collect()
    assert len(got) == len(rows) + 2
    assert all(r.component_id == (None if r.doc_id is None else expected[r.doc_id]) for r in got)
    assert {(r.u, r.v) for r in shingle_join.links(df).collect()} == {(i, c) for i, c in expected.items() if i != c}
    assert shingle_join.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("rows", [1, 7, 1000])
def test_groups_that_go_on_in_the_next_batch(spark, rows):
    rng = np.random.default_rng(rows)
    base = rng.integers(0, 1 << 62, (6, 16)).view(np.uint64)
    held = []
    for mark in range(200):
        bits = base[mark % 6].copy()
        bits[mark % 16] ^= np.uint64(mark % 7)
        held.append((mark // (1 + mark // 40), mark, 40, bytearray(bits.tobytes())))
    held.sort()
    expected = set()
    for key in {h[0] for h in held}:
        group = [h for h in held if h[0] == key]
        for a in group:
            for b in group:
                if a < b and shingle_join.alike(40, 40, sum(int(x ^ y).bit_count() for x, y in zip(np.frombuffer(a[3], np.uint64), np.frombuffer(b[3], np.uint64)))):
                    expected.add((a[1], b[1]))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    try:
        dealt = spark.createDataFrame(held, "key long, mark long, n long, bits binary").coalesce(1).sortWithinPartitions("key", "mark")
        got = [(r.u, r.v) for r in shingle_join.connected(dealt).collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    from test_corpus_operators import union

    assert union(range(200), got) == union(range(200), expected)


def test_pipeline_stage_drops_copies_with_edited_words(spark):
    import corpus_pipeline

    rng = random.Random(3)
    base = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(120)]
    texts = [" ".join(base)]
    for k in range(20):
        w = list(base)
        for at in (7 + k, 70 + k):
            w[at] = f"edit{k}"
        texts.append(" ".join(w))  # 10 of 116 shingles differ: a similarity of 106 / 126
    texts.append(" ".join(base[60:]))
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    stay = corpus_pipeline.near_duplicates(spark, df, "")
    assert stay.columns == df.columns
    assert {r.doc_id for r in stay.collect()} == {0, 21}


def test_stage_broadcasts_nothing_that_grows(spark, monkeypatch):
    """Labels, marks and ids are small in their files; the driver would hold what is broadcast of them."""
    import corpus_pipeline

    made = []
    for module in (simhash, components, shingle_join):
        monkeypatch.setattr(module, "materialize", lambda df, *more: made.append(df) or materialize(df, *more))
    monkeypatch.setattr(shingle_join, "FEW", 0)
    texts = copies(random.Random(8), per_base=5)
    df = materialize(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string"), "texts")
    stay = corpus_pipeline.near_duplicates(spark, df, "")
    nodes = [x for d in [*made, stay] for x in re.findall(r"Broadcast(?!Exchange|QueryStage)\w*Join.*", d._jdf.queryExecution().executedPlan().toString())]
    # A bitmap of bounded size, and the groups of several blocks.
    assert len(made) > 12 and all("[pf_bucket#" in x or "[group#" in x for x in nodes)
    roots = plain_components(dict(enumerate(texts)))
    assert {r.doc_id for r in stay.collect()} <= {k for k, r in roots.items() if k == r}


def test_rows_among_ids_and_beside_them(spark):
    rows = spark.createDataFrame([(k if k % 7 else None, k, "x") for k in range(3000)], "k int, pf_bucket long, pf_map string").repartition(3)
    ids = materialize(spark.range(0, 9000, 5).selectExpr("id as pf_id"), "ids", True)
    expected = {k for k in range(3000) if k % 7 and k % 5 == 0}
    for there, wanted in ((True, expected), (False, set(range(3000)) - expected)):
        got = among(rows, "k", ids, there)
        assert got.columns == rows.columns and sorted(r.pf_bucket for r in got.collect()) == sorted(wanted)
        assert among(rows, "k", materialize(ids.limit(0), "none", True), there).count() == (0 if there else 3000)


def test_links_that_differ_each_time_they_are_made(spark):
    """The links of a group are a star around whichever of its rows is read first."""
    def star(table):
        ids = table.column("id").to_pylist()
        first = random.SystemRandom().choice(ids)
        return pa.table({"u": [x for x in ids if x != first], "v": [first] * (len(ids) - 1)})

    links = spark.range(200).groupBy((F.col("id") % 5).alias("g")).applyInArrow(star, "u bigint, v bigint")
    assert {(r.node, r.root) for r in components.components(links).collect()} == {(k, k % 5) for k in range(200)}
