"""The quality classifier: features by definition, the fit's optimum, held-out accuracy, odd input."""

import random
import zlib

import numpy as np
import pytest

from parcelforge.llm import common
from parcelforge.llm import nb_svm as m


def plain_features(text):
    """The same n-grams by slices, as sets of what they are."""
    x = text.encode()
    words = x.split()
    kind = lambda b: "\n" if b == 10 else " " if b in b" \t\v\f\r" else "0" if chr(b).isdigit() and b < 128 else "A" if 65 <= b < 91 else "a" if 97 <= b < 123 or b > 127 else chr(b)
    kinds = [kind(b) for k, b in enumerate(x) if not k or kind(b) != kind(x[k - 1])]
    back = [1 if k and w == words[k - 1] else 2 if w in words[max(0, k - 8) : max(0, k - 1)] else 0 for k, w in enumerate(words)]
    grams = lambda name, s, n: {(name, n, tuple(s[k : k + n])) for k in range(len(s) - n + 1)}
    out = set()
    for n in (1, 2, 3):
        out |= grams("bytes", x, n)
    for n in (1, 2, 3, 4, 5):
        out |= grams("kinds", kinds, n)
    for n in (1, 2):
        out |= grams("words", words, n)
    for n in range(1, 7):
        out |= grams("back", back, n)
    return out


def random_text(draw, n):
    return "".join(draw.choice(["ab ", "Cd, ", "é", "x1 ", "\n", "  ", "ab ab ", "!! ", "|"]) for _ in range(n))


def test_features_are_those_of_the_definition():
    draw = random.Random(1)
    of = {}
    for n in (0, 1, 2, 5, 20, 60, 200):
        for _ in range(8):
            t = random_text(draw, n)
            of[t] = (plain_features(t), set(m.features(t.encode()).tolist()))
    for want, got in of.values():
        assert len(got) <= len(want)
        assert len(got) >= 0.97 * len(want) - 1  # a few meet in one place
    # Texts of equal n-grams have equal features; one more n-gram shows but where places meet.
    for a, (want_a, got_a) in of.items():
        for b, (want_b, got_b) in of.items():
            if want_a <= want_b:
                assert got_a <= got_b, (a, b)


def test_pieces_do_not_matter(monkeypatch):
    draw = random.Random(2)
    texts = [random_text(draw, 400).encode() for _ in range(20)]
    whole = [m.features(t) for t in texts]
    for size in (1, 7, 64):
        monkeypatch.setattr(common, "PIECE_BYTES", size)
        for t, f in zip(texts, whole):
            assert (m.features(t) == f).all()


def test_packing():
    draw = np.random.default_rng(1)
    for n in (0, 1, 4095, 4096, 5000, m.FEATURES):
        f = np.sort(draw.choice(m.FEATURES, n, replace=False))
        assert len(m.packed(f)) <= m.FEATURES // 8
        assert (m.unpacked(m.packed(f)) == f).all()


def test_fit_is_the_optimum(monkeypatch):
    """Against plain subgradient descent on the same objective."""
    monkeypatch.setattr(m, "FEATURES", 64)
    draw = np.random.default_rng(4)
    good = draw.random(60) < 0.7
    rows = [np.flatnonzero(draw.random(64) < np.where(np.arange(64) < 32, 0.5 if g else 0.3, 0.4)) for g in good]
    monkeypatch.setattr(m, "packed", lambda f: f)
    monkeypatch.setattr(m, "unpacked", lambda f: f)
    model = m.train(rows, good, rounds=2000, mix=0.0)
    p, q = (np.array([(sum(k in f for f, g in zip(rows, good) if g == side) + 1) / ((good == side).sum() + 2) for k in range(64)]) for side in (True, False))
    ratio = np.log(p) - np.log(q)
    x = np.zeros((60, 65))
    for i, f in enumerate(rows):
        x[i, f] = ratio[f] / np.linalg.norm(ratio[f])
    x[:, 64] = 1
    y, c = np.where(good, 1, -1), np.where(good, 60 / (2 * good.sum()), 60 / (2 * (~good).sum()))
    objective = lambda w: 0.5 * w @ w + (c * np.maximum(0, 1 - y * (x @ w))).sum()
    w, best = np.zeros(65), np.inf
    for t in range(1, 40000):
        active = y * (x @ w) < 1
        w -= (w - ((c * y)[active, None] * x[active]).sum(0)) / t
        best = min(best, objective(w))
    got = np.r_[np.where(ratio != 0, model.weights / np.where(ratio == 0, 1, ratio), 0), model.bias]
    assert objective(got) <= best * 1.001


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in m.query(spark, "/root/testdata/sf0.01").collect()}
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for i, r in got.items())
    held = [(got[r.doc_id].predicted, r.quality) for r in labels.collect() if r.doc_id in got and got[r.doc_id].held_out]
    assert len(held) > 100
    assert sum(a == b for a, b in held) >= 0.95 * len(held)


def test_held_out_labels_do_not_matter(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    from pyspark.sql import functions as F

    turned = labels.withColumn("quality", F.when(m.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = m.fit(docs, labels), m.fit(docs, turned)
    assert (a.weights == b.weights).all()
    assert a.bias == b.bias


@pytest.mark.parametrize("kinds", [(), (1,), (0,), (0, 1)])
def test_odd_rows(spark, kinds):
    rows = [(i, f"text number {i} " * (i % 5), "x", 1.0) for i in range(40)] + [(None, "no id", "x", 1.0), (50, None, "x", 1.0), (51, "", "x", 1.0), (51, "", "x", 1.0), (52, "w " * 1_500_000, "x", 1.0), (53, "w" * 3_000_000, "x", 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, held_out string, score double")
    labels = spark.createDataFrame([(i, kinds[i % len(kinds)], 0) for i in range(45)] + [(None, 1, 0), (3, None, 1)] if kinds else [], "doc_id long, quality int, toxic int")
    got = m.scored(docs, m.fit(docs, labels)).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in rows)
    assert all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (50, 51)}) == 1
    if len(kinds) < 2:
        assert {r.score for r in got} == {float(kinds[0]) if kinds else 0.5}
    assert m.scored(docs.limit(0), m.fit(docs, labels)).collect() == []
