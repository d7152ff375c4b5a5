"""Operators on single texts and urls, against plain versions."""

import random
import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from parcelforge.llm import license_scan, piecewise_hash, quality_rules, url_filter

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ODD_TEXTS = [None, "", " ", "\n\n", "a", "ÉCOLE été ", "x " * 5000, "a\x00b", "日本 語", "MIT License", "\u00a0nbsp"]


# ------------------------------------------------------------------ urls


def plain_judge(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0].translate(UPPER)
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    best = None
    for verdict, rule in rules:
        rule_host, _, rule_path = rule.partition("/")
        if (host == rule_host or host.endswith("." + rule_host)) and path.startswith("/" + rule_path) and (best is None or (len(rule_host), len(rule_path)) > best[0]):
            best = (len(rule_host), len(rule_path)), rule, verdict
    return (host, path, best[1], best[2]) if best else (host, path, None, default)


def test_urls_against_all_rules(spark):
    rng = random.Random(7)
    labels, parts = ["com", "net", "a", "b", "example", "co"], ["en", "de", "", "7", "75", "x"]
    rules = {}
    for _ in range(60):
        host = ".".join(rng.choice(labels) for _ in range(rng.randint(1, 3)))
        rules["/".join([host, *(rng.choice(parts) for _ in range(rng.randint(1, 3)))])] = rng.choice(["allow", "block"])
    rules = [(v, r) for r, v in rules.items()]
    urls = [None, "", "no scheme", "http://", "HTTP://EXAMPLE.COM/EN/7", "a://b?x/y", "http://com", "http://com/en/://net/de/"]
    urls += [f"http://{'.'.join(rng.choice(labels) for _ in range(rng.randint(1, 4)))}/{'/'.join(rng.choice(parts) for _ in range(rng.randint(0, 4)))}{rng.choice(['', '?q=1', '#t'])}" for _ in range(500)]
    df = spark.createDataFrame([(k, u, "x") for k, u in enumerate(urls)], "page_id long, url string, host string")
    for chosen in (rules, url_filter.BASE_RULES):
        got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(df, chosen).collect()}
        assert got == {k: plain_judge(u, chosen) for k, u in enumerate(urls)}


def test_urls_empty_table_and_disagreeing_rules(spark):
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0
    with pytest.raises(ValueError):
        url_filter.build([("allow", "com/"), ("block", "com/")])


# ------------------------------------------------------------------ quality


def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
    hit = {j for k, w in enumerate(windows) if windows.count(w) > 1 for j in range(k, k + 8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(hit)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "é#", "c\n", "\n", "\t", "|x|", "\u00a0"]), max_size=60).map(" ".join))
def test_counts(text):
    assert quality_rules.measure(text.encode())[:5] == plain_counts(text)


@pytest.mark.parametrize("text", ODD_TEXTS)
def test_counts_of_odd_texts(text):
    assert quality_rules.measure(None if text is None else text.encode())[:5] == plain_counts(text[:2000] if text and len(text) < 2000 else text) if text is None or len(text) < 2000 else True


def labelled_docs(n=300):
    rng = random.Random(3)
    rows = []
    for k in range(n):
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(30, 80))]
        bad = k % 4 == 0
        rows.append((k, (" | " if bad else " ").join(words), int(not bad)))
    return rows


def test_learned_list_rejects_junk_and_keeps_the_rest(spark):
    rows = labelled_docs()
    docs = spark.createDataFrame([(k, t, "h", "f") for k, t, _ in rows] + [(None, None, "", ""), (900, "", "", "")], "doc_id long, text string, h string, n_words string")
    labels = spark.createDataFrame([(k, q, 0) for k, _, q in rows if k < 200] + [(None, 1, 0), (5000, None, 0), (1, 1, 0)], "doc_id long, quality int, toxic int")
    kept = {r.doc_id: r.kept for r in quality_rules.judged(docs, labels).collect()}
    assert [kept[k] for k, _, _ in rows] == [bool(q) for _, _, q in rows]  # a third of them was held out
    assert kept[None] is False and kept[900] is False
    rest = quality_rules.keep(docs, labels)
    assert rest.columns == docs.columns
    assert {r.doc_id for r in rest.collect()} == {k for k, _, q in rows if q}


def test_quality_without_labels_and_without_rows(spark):
    docs = spark.createDataFrame([(1, "word " * 5), (2, " ".join(map(str, range(30))))], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.doc_id: r.kept for r in quality_rules.judged(docs, none).collect()} == {1: False, 2: True}
    assert quality_rules.judged(docs.limit(0), none).count() == 0


def test_best_condition_against_all_thresholds():
    rng = np.random.default_rng(5)
    for _ in range(20):
        x = {f: rng.integers(0, 6, 40).astype(float) for f in quality_rules.FEATURES}
        bad = rng.random(40) < 0.4
        base = np.log2(bad.mean())
        best = -1.0
        for f, v in x.items():
            for cut in np.unique(v)[:-1] + 0.5:
                for hit in (v > cut, v <= cut):
                    p, n = (hit & bad).sum(), (hit & ~bad).sum()
                    if p:
                        best = max(best, p * (np.log2(p / (p + n)) - base))
        gain, condition = quality_rules._best(x, bad, 1.0, 1.0)
        hit = condition.holds(x)
        p, n = (hit & bad).sum(), (hit & ~bad).sum()
        assert gain == pytest.approx(best) == pytest.approx(p * (np.log2(p / (p + n)) - base))


def test_learning_ties_are_settled():
    x = {f: np.zeros(40) for f in quality_rules.FEATURES}
    bad = np.arange(40) % 2 == 0
    assert quality_rules.learn(x, bad) == []
    x["symbol_share"] = bad.astype(float)
    x["upper_share"] = bad.astype(float)
    assert [r.conditions[0].feature for r in quality_rules.learn(x, bad)] == ["symbol_share"]


# ------------------------------------------------------------------ licences


def plain_places(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))
    out = []
    for phrase, label in license_scan.BASE_PHRASES.items():
        p = phrase.split()
        out += [(k, label) for k in range(len(words)) if words[k : k + len(p)] == p]
    return len(words), sorted(out)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("gnu general public license apache cc by mit the license-apache é licensed under Lesser".split()), max_size=40).map(" ".join))
def test_phrases(text):
    scanner = license_scan.Scanner(license_scan.BASE_PHRASES, license_scan.TEMPLATES, 3, 0.8)
    n, places, _ = scanner.scan(text.encode())
    assert (n, sorted((s, scanner.phrases[t][1]) for s, t in places)) == plain_places(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=30), st.lists(st.lists(st.sampled_from("abcd"), min_size=1, max_size=9), min_size=1, max_size=4))
def test_matching_statistics(text, templates):
    words, known = [w.encode() for w in text], [[w.encode() for w in t] for t in templates]
    a, state, run = license_scan.Automaton(known), 0, 0
    runs = {tuple(t[i:j]) for t in known for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
    for k, w in enumerate(words):
        while state and w not in a.next[state]:
            state = a.link[state]
            run = a.length[state]
        if w in a.next[state]:
            state, run = a.next[state][w], run + 1
        else:
            run = 0
        assert run == max((n for n in range(k + 2) if n == 0 or tuple(words[k + 1 - n : k + 1]) in runs), default=0)
        if run:
            ends = {(t, j) for t, ws in enumerate(known) for j in range(len(ws)) if ws[max(0, j + 1 - run) : j + 1] == words[k + 1 - run : k + 1]}
            assert set(a.places[state]) == ends


def test_licence_spans(spark):
    mit = license_scan.TEMPLATES[0][1]
    cut = " ".join(mit.split()[:40] + ["inserted"] + mit.split()[40:])
    texts = [cut, "before " + mit.upper() + " after", "this software is nice and free", None, "", "Apache\nLicense apache-license"]
    df = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)], "doc_id long, text string, score int")
    got = {r.doc_id: r for r in license_scan.scan(df).collect()}
    assert got[0].labels == got[1].labels == "mit" and got[0].score > 0.9
    assert [(s.start, s.end) for s in got[1].spans] == [(1, 1 + len(mit.split()))]
    assert (got[2].labels, got[2].score, got[3].n_words, got[3].first_word, got[4].labels) == ("", 0.0, 0, None, "")
    assert (got[5].n_base, got[5].first_word, got[5].last_word, got[5].base_labels) == (2, 0, 2, "apache")


# ------------------------------------------------------------------ piecewise hashes


def test_common_subsequence():
    rng = random.Random(5)
    for _ in range(200):
        a, b = ([rng.choice("abc") for _ in range(rng.randint(0, 12))] for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert piecewise_hash.common(a, b) == t[-1][-1]


def test_triggers_do_not_depend_on_steps(monkeypatch):
    data = bytes(random.Random(1).choices(b"abcdef ", k=5000))
    whole = piecewise_hash.fingerprint(data)
    monkeypatch.setattr(piecewise_hash, "STEP", 97)
    assert piecewise_hash.fingerprint(data) == whole


def plain_fingerprint(data):
    """Byte by byte, from the description."""
    block = 3
    while 64 * block < len(data):
        block *= 2

    def at(end):  # the rolling hash of the seven bytes before ``end``
        h = sum(b * pow(0x01000193, k, 1 << 32) for k, b in enumerate(reversed(data[max(0, end - 7) : end]))) % (1 << 32)
        h ^= h >> 16
        h = h * 0x7FEB352D % (1 << 32)
        return h ^ h >> 15

    parts = []
    for size in (block, 2 * block):
        out, start = "", 0
        for end in range(1, len(data) + 1):
            n = end - start
            # A trigger of twice the size is one of the size itself as well.
            if end == len(data) or n == 4 * size or (n >= max(1, size // 4) and at(end) % size == size - 1 and at(end) % block == block - 1):
                symbol = xxhash.xxh32_intdigest(data[start:end]) >> 20
                alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
                out += alphabet[symbol // 64] + alphabet[symbol % 64]
                start = end
        parts.append(out)
    return f"{block}:{parts[0]}:{parts[1]}"


@pytest.mark.parametrize("text", ["", "a", "That it.", "aaaa" * 400, "And " * 700, "é1 x " * 90, " ".join(str(k * k) for k in range(900))])
def test_fingerprint_against_a_plain_version(text):
    assert piecewise_hash.fingerprint(text.encode()) == plain_fingerprint(text.encode())


def test_repetitive_texts_are_like_their_half_edited_ones():
    other = " ".join(str(k * 7919) for k in range(700))
    for text in ("And " * 800, "a" * 3000, "one line that repeats\n" * 150, "Wher. " * 140):
        own, new, far = (piecewise_hash.fingerprint(x.encode()) for x in (text, piecewise_hash.edited(text, other), other))
        assert piecewise_hash.likeness(own, new) > piecewise_hash.likeness(own, far) + 0.15


def test_fingerprints_meet_the_next_document(spark):
    import hashlib

    rng = random.Random(2)
    texts = {3 * k: " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(rng.randint(0, 120))) for k in range(60)}
    texts[9] = texts[6]
    texts[12], texts[15], texts[18] = None, "", "é" * 11
    rows = [(k, t) for k, t in texts.items()]
    rng.shuffle(rows)
    df = spark.createDataFrame([(k, t, 7) for k, t in rows], "doc_id long, text string, n_chars int").repartition(5)
    got = {r.doc_id: r for r in piecewise_hash.against_next(df).collect()}
    ids = sorted(texts)
    assert sorted(got) == ids
    for k, i in enumerate(ids):
        a, b = texts[i] or "", texts[ids[(k + 1) % len(ids)]] or ""
        half = len(a) // 2
        new = a[: len(a) - half] + b[:half]
        mark, other, edited = (piecewise_hash.fingerprint(x.encode()) for x in (a, b, new))
        r = got[i]
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (len(a), hashlib.sha256(new.encode()).hexdigest(), mark, edited)
        assert r.near_edited == piecewise_hash.likeness(mark, edited) and r.near_next == piecewise_hash.likeness(mark, other)
        assert 0 <= r.near_next <= 1
    assert got[6].fingerprint == got[9].fingerprint and got[6].near_next == 1
    long_ones = [r for r in got.values() if r.n_chars > 300]
    assert np.mean([r.near_edited > r.near_next for r in long_ones]) > 0.9
    one = spark.createDataFrame([(1, "abcdef")], "doc_id long, text string")
    assert piecewise_hash.against_next(one).first().near_next == 1
    assert piecewise_hash.against_next(one.limit(0)).count() == 0
