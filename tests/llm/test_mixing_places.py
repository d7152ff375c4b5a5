"""The pipeline's last stage returns the schedule that the mixing stage made."""

from collections import Counter

import corpus_pipeline
import pytest
from parcelforge.llm import mixing


def plain_schedule(share, blocks, slots):
    """The slot of each block, slot by slot: of the released blocks the one of the earliest deadline."""
    taken = dict.fromkeys(share, 0)
    out = {}
    t = 0
    while any(taken[s] < blocks[s] for s in share):
        ready = []
        for k, s in enumerate(sorted(share)):
            i = taken[s]
            if i * slots // share[s] <= t:
                ready.append((-(-(i + 1) * slots // share[s]), (i + 1) * slots % share[s] == 0, k, s))
        if ready:
            s = min(ready)[3]
            out[s, taken[s]] = t
            taken[s] += 1
        t += 1
    return out


def test_last_stage_returns_slots_that_hold_the_weights(spark):
    rows = [(k, f"text {k}", "en", "hot" if k % 3 else f"s{k % 5}", 6) for k in range(9000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    mixed = corpus_pipeline.mixed(spark, df, "")
    assert mixed.columns == df.columns
    # However the rows are dealt in between, the result has the schedule.
    got = corpus_pipeline.pieces(spark, mixed.repartition(5), "").collect()
    assert sorted(r.doc_id for r in got) == list(range(9000))
    counts = Counter(s for _, _, _, s, _ in rows)
    assert {r.doc_id: r.source for r in got} == {i: s for i, _, _, s, _ in rows}
    share, period = mixing.shares(counts)
    slots = plain_schedule(share, {s: -(-n // 100) for s, n in counts.items()}, period)
    for s, n in counts.items():
        assert sorted(r.rank_in_source for r in got if r.source == s) == list(range(n))
    assert all(r.block == r.rank_in_source // 100 and r.slot == slots[r.source, r.block] for r in got)
    # Before the first gap each source has its share but for a block, which the raw shares do not.
    end = max(r.slot for r in got if r.in_target) + 1
    assert all(r.in_target == (r.slot < end) for r in got)
    blocks = Counter(s for s, _ in {(r.source, r.block) for r in got if r.in_target})
    assert all(abs(blocks[s] - end * share[s] / period) < 1 for s in share)
    assert abs(blocks["hot"] - end * counts["hot"] / 9000) > 1


def test_last_stage_follows_what_the_mixing_stage_decided(spark, tmp_path):
    """Weights and blocks of the mixing stage hold in the last stage's result, also of files that are read again."""
    rows = [(k, f"text {k}", "en", ["a", "b", None][k % 3], 6) for k in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    weights = {"a": 7, "b": 2, None: 1}
    mixing.stage(df, weights, block=10).write.parquet(str(tmp_path / "mixed"))
    docs = spark.read.parquet(str(tmp_path / "mixed"))
    assert docs.columns == df.columns
    got = corpus_pipeline.pieces(spark, docs.repartition(3), "").select("doc_id", *mixing.PLACES)
    want = mixing.mix(df, weights, block=10).select("doc_id", *mixing.PLACES)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    with pytest.raises(ValueError, match="no schedule"):
        corpus_pipeline.pieces(spark, df, "")
    other = docs.unionByName(spark.createDataFrame([(600, "t", "en", "new", 1)], df.schema))
    with pytest.raises(Exception, match="not in the schedule: the source new"):
        mixing.places(other).collect()
