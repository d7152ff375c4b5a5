"""Clashing and odd names in op3 and op10, weights in op8, and decision lists against a plain sequential covering."""

import math

import numpy as np
import pytest

from parcelforge.llm import license_scan, mixing, quality_rules, sentencepiece_codec


def test_licences_of_odd_columns(spark):
    df = spark.createDataFrame([(1, "MIT License", 5), (2, None, 6), (2, None, 6)], "`my.id` long, `a``text` string, data int")
    got = license_scan.scan(df, key="my.id", text="a`text").collect()
    assert sorted((r.doc_id, r.base_labels) for r in got)[0][0] == 1 and len(got) == 3


def test_pieces_of_odd_columns(spark):
    df = spark.createDataFrame([(1, "ab cd", [7], "x", 1.5), (None, None, None, None, None)], "`my.id` long, `a.text` string, ids array<int>, `b``c` string, round_trip double")
    got = {r.doc_id: r for r in sentencepiece_codec.with_ids(df, sentencepiece_codec._model(), key="my.id", text="a.text", also=("ids", "b`c", "round_trip")).collect()}
    assert got[1]["_ids"] == [7] and got[1]["b`c"] == "x" and got[1]["_round_trip"] == 1.5 and len(got[1]["ids"]) == got[1]["n_tokens"] > 0
    assert got[None]["n_tokens"] == 0 and got[None]["_ids"] is None


def test_the_query_returns_ids(spark):
    import sentencepiece

    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    library = sentencepiece.SentencePieceProcessor(model_proto=sentencepiece_codec._model())
    got = sentencepiece_codec.query(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == len(docs)
    assert all(list(r.ids) == library.encode(docs[r.doc_id]) for r in got[:50])
    again = {r.doc_id: r.text for r in sentencepiece_codec.decoded(spark.createDataFrame([(r.doc_id, r.ids) for r in got[:50]], "doc_id long, ids array<int>"), sentencepiece_codec._model()).collect()}
    assert all(again[r.doc_id] == docs[r.doc_id] for r in got[:50] if r.round_trip)


def test_weights_are_given_for_every_source(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "doc_id long, source string")
    assert mixing.mix(df, {"a": 1, "b": 2.5, None: 3, "unknown": 1}).count() == 3
    for weights, name in (({"a": 1, None: 1}, "'b'"), ({"a": 1, "b": 1}, "None"), ({"a": math.nan, "b": 1, None: 1}, "'a'"), ({"a": 1, "b": -1, None: 1}, "'b'"), ({"a": 1, "b": math.inf, None: 1}, "'b'")):
        with pytest.raises(ValueError, match=name):
            mixing.mix(df, weights)


def plain_list(rows, bad, max_rules, max_conditions, min_precision, min_covered):
    """Sequential covering over all conditions by loops: rows are dicts."""
    names = list(quality_rules.FEATURES)
    fits = lambda c, r: r[c[0]] > c[2] if c[1] else r[c[0]] <= c[2]
    left, rules = list(range(len(rows))), []
    while len(rules) < max_rules and sum(bad[i] for i in left) >= min_covered and any(not bad[i] for i in left):
        grow, prune = [i for k, i in enumerate(left) if k % 3 != 2], [i for k, i in enumerate(left) if k % 3 == 2]
        conditions, at = [], grow
        while len(conditions) < max_conditions and any(bad[i] for i in at) and any(not bad[i] for i in at):
            p0, n0 = sum(bad[i] for i in at), sum(not bad[i] for i in at)
            best = None
            for name in names:
                values = sorted({rows[i][name] for i in at})
                options = []
                for above in (False, True):
                    for a, b in zip(values, values[1:]):
                        c = (name, above, (a + b) / 2)
                        p, n = sum(bad[i] and fits(c, rows[i]) for i in at), sum(not bad[i] and fits(c, rows[i]) for i in at)
                        gain = p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else -1.0
                        options.append((gain, c))
                    if options and (top := max(o[0] for o in options[-(len(values) - 1) :])) is not None and (best is None or top > best[0] + 1e-9):
                        best = next(o for o in options[-(len(values) - 1) :] if o[0] >= top - 1e-12)
            if best is None or best[0] <= 1e-9:
                break
            conditions.append(best[1])
            at = [i for i in at if fits(best[1], rows[i])]
        if not conditions:
            break

        def worth(cs):
            hit = [i for i in prune if all(fits(c, rows[i]) for c in cs)]  # noqa: B023
            p = sum(bad[i] for i in hit)
            return (2 * p - len(hit)) / len(hit) if hit else -1.0

        while len(conditions) > 1 and worth(conditions[:-1]) >= worth(conditions):
            conditions.pop()
        hit = [i for i in left if all(fits(c, rows[i]) for c in conditions)]
        p = sum(bad[i] for i in hit)
        if p < min_covered or p < min_precision * len(hit):
            break
        rules.append(tuple(conditions))
        left = [i for i in left if i not in set(hit)]
    return rules


@pytest.mark.parametrize("seed", range(6))
def test_lists_equal_a_plain_covering(seed):
    draw = np.random.default_rng(seed)
    n = 150
    x = {f: np.round(draw.random(n), 2) for f in quality_rules.FEATURES}
    bad = (x["symbol_share"] > 0.8) | ((x["upper_share"] > 0.6) & (x["digit_share"] <= 0.4)) | (draw.random(n) < 0.02)
    for options in ({"max_rules": 4, "max_conditions": 3, "min_precision": 0.8, "min_covered": 3}, {"max_rules": 12, "max_conditions": 4, "min_precision": 0.9, "min_covered": 5}):
        got = [tuple((c.feature, c.above, c.threshold) for c in r.conditions) for r in quality_rules.learn(x, bad, **options)]
        want = plain_list([{f: float(x[f][k]) for f in x} for k in range(n)], bad.tolist(), **options)
        assert got == want
        assert got or seed == 2


def test_pieces_of_common_words_outlive_a_full_memory(monkeypatch):
    import sentencepiece

    monkeypatch.setattr(sentencepiece_codec, "MAX_KNOWN", 3)
    data = sentencepiece_codec._model()
    codec, library = sentencepiece_codec.Codec(data), sentencepiece.SentencePieceProcessor(model_proto=data)
    learnt, held = [], codec.learn
    codec.learn = lambda words: (learnt.append(sorted(words)), held(words))
    texts = ["the cat the dog", "a new \U0001f9ff͸ word  of the cat", "one more of the cat", " ", "", "x▁y é‍\U00010348 a"]
    for t in texts:
        ids = codec.encode([t])[0]
        assert ids.tolist() == library.encode(t) and codec.decode(ids) == library.decode(ids.tolist())
    assert learnt[2] == ["▁more", "▁of", "▁one"]
