"""The prefix trie against a plain walk over all rebuilt conversations."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from parcelforge.llm import prefix_trie

KINDS = "conv_id long, turn long, role string, text string"
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def plain(rows):
    of = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            of[c].append((turn is not None, turn or 0, role or "", text or ""))
    of = {c: [x[2:] for x in sorted(v)] for c, v in of.items()}
    nodes = defaultdict(list)
    whole = {}
    for c, own in of.items():
        h = zlib.crc32(str(c).encode()) % 6
        whole[c] = tuple(of.get(c - (c % 100 if c >= 0 else -(-c % 100)), [])[:h] + own[h:])
        for d in range(len(whole[c]) + 1):
            nodes[whole[c][:d]].append(c)
    out = []
    for node, members in nodes.items():
        below = [k for k in nodes if k[: len(node)] == node]
        leaf = {k for k in below if not any(len(x) == len(k) + 1 and x[: len(k)] == k for x in nodes)}
        ends = ",".join(map(str, sorted(c for c in members if len(whole[c]) == len(node))))
        out.append((
            min(members), len(node), min(nodes[node[:-1]]) if node else None, len(members), sum(len(k) == len(node) + 1 for k in below), len(leaf),
            sum((len(nodes[k]) - 1) * len(k[-1][1]) for k in below if k), hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def rows_of(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


def some(seed, ids, most):
    draw = random.Random(seed)
    rows = []
    for c in ids:
        for t in range(draw.randrange(1, most)):
            rows.append((c, draw.choice([t, t, t, None, 3]), draw.choice(["user", "assistant", None]), draw.choice(["a", "bé", "", None, "long text \U0001f600"])))
    rows += draw.sample(rows, len(rows) // 8)  # repeated rows
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_against_a_plain_walk(spark, seed, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK", 3)
    monkeypatch.setattr(prefix_trie, "IDS", 7)
    ids = [0, 1, 2, 3, 5, 8, 99, 100, 101, 150, 205, 206, -1, -100, -150, *range(300, 340)]
    rows = [*some(seed, ids, 9), (None, 1, "user", "lost")]
    assert rows_of(prefix_trie.trie(spark.createDataFrame(rows, KINDS))) == plain(rows)


def test_one_long_conversation_and_many_equal_ones(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK", 16)
    monkeypatch.setattr(prefix_trie, "IDS", 10)
    rows = [(7, t, "user", f"turn {t}" * 3) for t in range(150)]
    rows += [(c, t, "user", f"turn {t}" * 3) for c in range(1000, 1060) for t in range(3)]
    rows += [(0, 0, "system", "x" * 100_000)]
    assert rows_of(prefix_trie.trie(spark.createDataFrame(rows, KINDS))) == plain(rows)


def test_empty_and_further_columns(spark):
    assert prefix_trie.trie(spark.createDataFrame([], KINDS)).collect() == []
    rows = [(1, 0, "user", "a"), (1, 1, None, None), (2, 0, "user", "a")]
    odd = spark.createDataFrame([(*r, 1, 2, 3, 4, 5) for r in rows], KINDS + ", depth int, k1 int, at int, w int, `x.y` int")
    assert rows_of(prefix_trie.trie(odd)) == plain(rows)


def test_against_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute("create view conversations as select * from read_parquet('/root/testdata/sf0.001/conversations.parquet')")
    got = con.execute(f"select {', '.join(COLUMNS)} from ({prefix_trie.SQL})").fetchall()
    assert sorted(got, key=str) == rows_of(prefix_trie.query(spark, "/root/testdata/sf0.001"))
