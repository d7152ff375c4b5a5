"""What all operators have in common: odd columns, nulls, repeated rows and empty tables."""

import corpus_pipeline
import pytest

from parcelforge.llm import license_scan, line_dedup, mixing, piecewise_hash, quality_rules, shingle_join, simhash, token_binary, url_filter

DATA = "/root/testdata/sf0.001"
#: Names that operators use, or once used, for their own columns; one with a dot, one with a backtick.
ODD = ("_pf_gone", "pf_gone", "_pf_doc", "pf_doc", "pf_which", "_pf_host", "pf_host", "pf_found", "_pf_h", "pf_h", "pf_slot", "_pf_stats", "pf_stats", "doc", "th", "fp", "mark", "data", "gone", "x.y", "a`b")


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int")


KEEPING = {
    "quality keep": lambda df: quality_rules.keep(df, labels(df.sparkSession, [(1, 1), (2, 0)])),
    "lines stage": line_dedup.stage,
    "lines dedup": lambda df: line_dedup.dedup(df, gone="lost", gone_words="lost_words"),
    "simhash": simhash.one_of_each,
    "simhash and shingles": lambda df: simhash.one_of_each(df, also=shingle_join.links),
    "mixing stage": mixing.stage,
    "mixing": mixing.mix,
    "urls": lambda df: url_filter.judge(df),
}


@pytest.mark.parametrize("name", KEEPING)
def test_columns_pass_through(spark, name):
    text = " ".join(f"word{k}" for k in range(60))
    rows = [(1, text, "http://a.com/en/1", "s"), (2, text, None, None), (2, text, None, None), (None, None, "", "s"), (3, "", "x", "t")]
    kinds = "doc_id long, text string, url string, source string, " + ", ".join(f"`{c.replace('`', '``')}` string" for c in ODD)
    df = spark.createDataFrame([(*r, *(f"{c} {r[0]}" for c in ODD)) for r in rows], kinds)
    out = KEEPING[name](df)
    assert out.columns[: len(df.columns)] == df.columns
    for r in out.collect():
        assert all(r[4 + k] == f"{c} {r[0]}" for k, c in enumerate(ODD))
    assert KEEPING[name](df.limit(0)).count() == 0


def per_row(spark):
    return {
        "simhash": lambda df: simhash.near_duplicates(df),
        "shingles": lambda df: shingle_join.near_duplicates(df),
        "piecewise": lambda df: piecewise_hash.against_next(df),
        "licences": lambda df: license_scan.scan(df),
        "quality": lambda df: quality_rules.judged(df, labels(spark, [])),
    }


@pytest.mark.parametrize("name", ["simhash", "shingles", "piecewise", "licences", "quality"])
def test_null_and_repeated_rows_are_answered_one_by_one(spark, name):
    rows = [(1, "MIT License " * 3000), (1, "MIT License " * 3000), (2, None), (2, None), (None, "a"), (None, None), (3, ""), (1, "another text of that id")]
    df = spark.createDataFrame([(i, t, 5, 6, 7) for i, t in rows], "doc_id long, text string, n_words int, fingerprint int, labels int")
    got = [r.doc_id for r in per_row(spark)[name](df).collect()]
    assert sorted(map(str, got)) == sorted(str(i) for i, _ in rows)


def test_urls_are_judged_one_by_one(spark):
    df = spark.createDataFrame([(1, "http://a.com/en/")] * 3 + [(None, None)] * 2, "page_id long, url string")
    assert sorted(r.verdict for r in url_filter.judge(df).collect()) == ["allow"] * 2 + ["block"] * 3


def test_labelled_rows_are_bounded_where_an_id_repeats(spark):
    docs = spark.createDataFrame([(k % 2, f"text number {k} " * 30) for k in range(200)], "doc_id long, text string")
    seen = []
    held = quality_rules.learn
    quality_rules.learn = lambda x, bad, **options: seen.append(len(bad)) or []
    try:
        quality_rules.fit(docs, labels(spark, [(0, 0), (1, 1), (2, 1)]), max_labelled=2, **{})
        quality_rules.fit(docs, labels(spark, [(0, 0), (1, 1), (2, 1)]), max_labelled=50)
    finally:
        quality_rules.learn = held
    assert all(n <= m for n, m in zip(seen, (2, 50)))


def test_token_files_of_null_texts(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (1, None), (None, None)], "doc_id long, text string")
    with open(__import__("public_tokenizers").path("byte_bpe_50k.json"), encoding="utf-8") as f:
        token_binary.write(df, str(tmp_path / "t"), f.read())
    assert sorted((r.start, r.n_tokens) for r in token_binary.read(spark, str(tmp_path / "t")).collect()) == [(0, 1), (1, 1), (2, 1)]


DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None)], [(1, None, "en", None, 0), (1, "w " * 300, "en", "a", 600), (None, " ".join(f"x{k}" for k in range(40)), "en", "a", 90)] * 2])
def test_pipeline_stages_of_odd_tables(spark, rows):
    docs = spark.createDataFrame([(*r, "extra") for r in rows], DOCUMENTS + ", slot string")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns, name
        docs = spark.createDataFrame(out.collect(), out.schema)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert sorted(map(str, (r.doc_id for r in last.collect()))) == sorted(map(str, (r.doc_id for r in docs.collect())))
