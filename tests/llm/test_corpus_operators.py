"""Operators over whole tables, against brute force."""

import hashlib
import random
import re
import zlib
from fractions import Fraction
from math import ceil, floor

import numpy as np
import pytest
import xxhash

from parcelforge.llm import line_dedup, mixing, sentencepiece_codec, simhash, token_binary, warc
from parcelforge.llm.components import components

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def union(ids, linked):
    root = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            m = min(root[a], root[b])
            changed |= root[a] != m or root[b] != m
            root[a] = root[b] = m
    return root


# ------------------------------------------------------------------ SimHash


def plain_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
    h = [xxhash.xxh64_intdigest(" ".join(w[k : k + 4]).encode(), 42) for k in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def test_components_of_chains_and_stars(spark):
    chain = [(k, k + 1) for k in range(100, 160)]
    star = [(0, k) for k in range(1, 40)]
    edges = chain + star + [(7, 7), (1, 0)]
    random.Random(1).shuffle(edges)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    ids = {x for e in edges for x in e}
    assert got == union(ids, edges)
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_anchors_cover_all_pairs():
    rng = random.Random(4)
    masks = simhash.anchor_masks(2)
    for _ in range(300):
        x = rng.getrandbits(31)
        y = x
        for b in rng.sample(range(31), rng.randint(0, 2)):
            y ^= 1 << b
        a, b = (set(simhash.anchors(np.array([v], np.uint32), masks)[1].tolist()) for v in (x, y))
        assert a & b


def clustered(rng, n, bits):
    out = set()
    centres = [rng.getrandbits(64) for _ in range(5)]
    while len(out) < n:
        x = rng.choice(centres)
        for b in rng.sample(range(64), rng.randint(0, bits)):
            x ^= 1 << b
        out.add(x)
    return sorted(out)


@pytest.mark.parametrize("split", [2048, 8])
def test_links_keep_components(spark, monkeypatch, split):
    rng = random.Random(split)
    monkeypatch.setattr(simhash, "SPLIT", split)
    fps = np.array(clustered(rng, 300, 9), np.uint64).view(np.int64)
    df = spark.createDataFrame([(int(x),) for x in fps], "fp long")
    links = [(r.u, r.v) for r in simhash.link(simhash.replicate(df, 4), 4).collect()]
    near = np.bitwise_count(fps.view(np.uint64)[:, None] ^ fps.view(np.uint64)) <= 4
    pairs = [(int(fps[i]), int(fps[j])) for i, j in zip(*np.nonzero(near)) if i < j]
    assert union(map(int, fps), links) == union(map(int, fps), pairs)


def test_near_duplicates(spark):
    rng = random.Random(9)
    base = [" ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(200)) for _ in range(12)]
    texts = []
    for k in range(60):
        words = base[k % 12].split()
        if k >= 24:
            words[rng.randrange(200)] = "edit"
        texts.append(" ".join(words))
    texts += [None, "", " \n", "ONE two", "one Two", "x", texts[0]]
    rows = [(1000 - k, t, "fp") for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows + [rows[0], (None, "x", "fp")], "doc_id long, text string, fp string")
    got = simhash.near_duplicates(df).collect()
    assert len(got) == len(rows) + 2
    marks = {i: plain_fingerprint(t) for i, t, _ in rows}
    linked = [(a, b) for a in marks for b in marks if a < b and bin(marks[a] ^ marks[b]).count("1") <= 4]
    root = union(marks, linked)
    for r in got:
        assert r.fingerprint == f"{plain_fingerprint('x') if r.doc_id is None else marks[r.doc_id]:016x}"
        assert r.component_id == (None if r.doc_id is None else root[r.doc_id])
    kept = simhash.one_of_each(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None and r.doc_id != 1000) == sorted({v for v in root.values()} - {1000})
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_long_texts_are_read_in_pieces(monkeypatch):
    from parcelforge.llm import common

    text = "lorem  Ipsum dolor\nsit amet " * 50
    whole = simhash.fingerprint(text.encode())
    monkeypatch.setattr(common, "PIECE_BYTES", 17)
    assert simhash.fingerprint(text.encode()) == whole == plain_fingerprint(text)


# ------------------------------------------------------------------ lines


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def plain_dedup(rows, min_words=50):
    """From the definition: a line goes where it lies in a run of so many words that stood together before."""
    docs = {(i, signed(xxhash.xxh64_intdigest(t.encode(), 42)), t): [(k, x, len(x.split())) for k, x in enumerate(t.split("\n")) if x.split()] for i, t in rows if i is not None and t is not None}
    order = sorted(docs, key=lambda d: d[:2])
    gone = {}
    for n, d in enumerate(order):
        ls = docs[d]
        lines, hit = [x for _, x, _ in ls], set()
        for a in range(len(ls)):
            for b in range(a, len(ls)):
                run, m = lines[a : b + 1], b - a + 1
                if sum(w for _, _, w in ls[a : b + 1]) < min_words:
                    continue
                others = ([x for _, x, _ in docs[o]] for o in order[:n])
                if not (any(o[k : k + m] == run for o in others for k in range(len(o) - m + 1)) or any(lines[k : k + m] == run for k in range(a - m + 1))):
                    break
                hit.update(range(a, b + 1))
        gone[d[0], d[2]] = {ls[k][0] for k in hit}
    return gone


@pytest.mark.parametrize("seed", [2, 4])
def test_lines_against_brute_force(spark, seed):
    rng = random.Random(seed)
    pool = [" ".join(rng.choices(["alpha", "beta", "gamma", "delta"], k=rng.choice([1, 5, 12, 30, 60]))) + f" {k}" for k in range(14)]
    rows = [(i, "\n".join(rng.choice([*pool, "", "  ", f"own {i} {j}"]) for j in range(rng.randint(0, 14)))) for i in range(70)]
    passage = "\n".join(f"{x} of the passage that is shared" for x in pool[:6])
    rows += [(100 + k, f"head {k}\n{passage}\ntail {k}") for k in range(4)] + [(200, None), (201, ""), (None, passage), rows[0], (202, "\n".join(["a b c d e f g"] * 33))]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n int")
    gone = plain_dedup(rows)
    got = line_dedup.dedup(df).collect()
    assert len(got) == len(rows) and any(gone.values())
    expected = []
    for i, t in rows:
        lost = gone.get((i, t), set())
        expected.append((i, "\n".join(x for k, x in enumerate(t.split("\n")) if k not in lost) if lost else t))
    assert sorted(map(str, ((r.doc_id, r.text) for r in got))) == sorted(map(str, expected))
    assert all(f"head {k}" in r.text for r in got for k in range(4) if r.doc_id == 100 + k)
    assert sum("of the passage" in r.text for r in got if r.doc_id and 100 <= r.doc_id < 104) == 1


def test_lines_that_stood_apart_stay(spark):
    lines = [" ".join(f"w{j}x{k}" for k in range(30)) for j in range(40)]
    rows = [*enumerate(lines), (99, "\n".join(lines)), (100, "\n".join(lines[10:12]))]
    got = {r.doc_id: r.gone for r in line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[99] is None and got[100] == [0, 1]


def test_line_stage_drops_copies_and_counts_characters(spark):
    text = "\n".join(" ".join(f"w{j}{k}" for k in range(30)) for j in range(3))
    df = spark.createDataFrame([(1, text, "en", "s", len(text)), (2, text, "en", "s", len(text)), (3, text + "\nown end", "en", "s", len(text) + 8)], "doc_id long, text string, lang string, source string, n_chars long")
    out = line_dedup.stage(df)
    assert out.columns == df.columns
    assert {(r.doc_id, r.text == text or r.text, r.n_chars) for r in out.collect()} == {(1, True, len(text)), (3, "own end", 7)}
    assert line_dedup.stage(df.limit(0)).count() == 0


# ------------------------------------------------------------------ WARC


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def plain_warc(rows):
    out = set()
    for i, _, h in rows:
        data = (h or "").encode()
        last = max(j for j, _, g in rows if (g or "").encode() == data)
        again = len(data) >= 1000 and i != last
        out.add((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", last if again else None))
    return out


@pytest.mark.parametrize("split", [1 << 27, 3000])
def test_warc_round_trip_with_magic_inside(spark, tmp_path, split):
    rng = random.Random(split)
    fake = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:999>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    rows = [(k, f"http://a/{k}", "é" + "".join(rng.choices("abc\r\n ", k=rng.randint(0, 2500)))) for k in range(40)]
    rows += [(50, "u\r\nv", fake), (51, None, "x" * 300 + fake + fake + "WARC/1.1\r\n"), (52, "", None), (53, "", ""), (54, "", "WARC/1.1\r\n")]
    rows += [(60 + k, "", "same" * 300) for k in range(7)] + [(70 + k, "", "small") for k in range(3)]
    path = str(tmp_path / "archive")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        warc.write(pages(spark, rows).coalesce(1), path)
        got = warc.read(spark, path).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    number = lambda x: int(re.match(r"<urn:page:(\d+)>", x)[1]) if x else None
    records = {number(r.record_id): r for r in got}
    assert len(got) == len(rows) == len(records)
    for i, size, digest, kind, refers in plain_warc(rows):
        r = records[i]
        assert (r.type, number(r.refers_to), r.digest) == (kind, refers, f"sha1:{digest}")
        if kind == "response":
            assert (r.payload_bytes, r.sha1) == (size, digest)


LONG_A, LONG_B = "a" * 1500, "b" * 1500


@pytest.mark.parametrize(
    "rows, expected",
    [
        ([(1, LONG_A), (1, LONG_B), (5, LONG_A)], [("response", 1, None), ("response", 5, None), ("revisit", 1, 5)]),
        ([(5, LONG_A), (5, LONG_A), (1, LONG_A)], [("response", 5, None), ("revisit", 1, 5), ("revisit", 5, 5)]),
        ([(5, "s"), (5, "s"), (None, LONG_A), (None, LONG_A), (2, None)], [("response", 2, None), ("response", 5, None), ("response", 5, None), ("response", None, None), ("response", None, None)]),
    ],
)
def test_warc_repeated_ids(spark, tmp_path, rows, expected):
    df = spark.createDataFrame([(i, f"http://a/{k}", h, "x", 1) for k, (i, h) in enumerate(rows)], "page_id long, url string, html string, digest string, `a.b` int")
    warc.write(df, str(tmp_path / "a"))
    number = lambda x: int(m[1]) if x and (m := re.match(r"<urn:page:(\d+)>", x)) else None
    got = warc.read(spark, str(tmp_path / "a")).collect()
    assert sorted(map(str, ((r.type, number(r.record_id), number(r.refers_to)) for r in got))) == sorted(map(str, expected))
    kept = {(number(r.record_id), r.sha1) for r in got if r.type == "response"}
    assert {(i, hashlib.sha1((h or "").encode()).hexdigest()) for i, h in rows} - kept <= {(number(r.record_id), r.digest[5:]) for r in got if r.type == "revisit"}


def test_warc_query_of_repeated_ids(spark, tmp_path):
    rows = [(5, "", LONG_A), (5, "", LONG_A), (1, "", LONG_A), (1, "", LONG_B), (2, "", "small")]
    pages(spark, rows).write.parquet(str(tmp_path / "pages.parquet"))
    a, b = (hashlib.sha1(x.encode()).hexdigest() for x in (LONG_A, LONG_B))
    got = sorted(tuple(r)[:4] + (r.refers_to,) for r in warc.query(spark, str(tmp_path)).collect())
    assert got == [(1, 1500, a, "revisit", 5), (1, 1500, b, "response", None), (2, 5, hashlib.sha1(b"small").hexdigest(), "response", None), (5, 1500, a, "response", None), (5, 1500, a, "revisit", 5)]


def test_warc_bitmap_of_a_few_bits_only_costs_shuffles(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "_maybe_shared", lambda rows, shared: rows.selectExpr("*", "true AS maybe"))
    rows = [(k, "", f"{k % 7}" * (990 + k % 25)) for k in range(200)]
    warc.write(pages(spark, rows), str(tmp_path / "a"))
    got = warc.read(spark, str(tmp_path / "a")).collect()
    number = lambda x: int(re.match(r"<urn:page:(\d+)>", x)[1]) if x else None
    assert {(number(r.record_id), r.digest[5:], r.type, number(r.refers_to)) for r in got} == {(i, d, kind, ref) for i, _, d, kind, ref in plain_warc(rows)}


def record(version, length, body, *more):
    return "\r\n".join([f"WARC/{version}", "WARC-Type: resource", *more, f"Content-Length: {length}", "", body]).encode()


def test_warc_versions_and_folded_headers(spark, tmp_path):
    end = b"\r\n\r\n"
    whole = record("1.0", 3, "abc") + end + record("1.1", 2, "de", "WARC-Target-URI: http://a/", " b") + end + record("0.18", 0, "") + end
    (tmp_path / "a.warc").write_bytes(whole)
    got = warc.read(spark, str(tmp_path / "a.warc")).collect()
    assert sorted((r.payload_bytes, r.uri) for r in got) == [(0, None), (2, "http://a/ b"), (3, None)]
    (tmp_path / "b.warc").write_bytes(whole[:-4])
    assert warc.read(spark, str(tmp_path / "b.warc")).count() == 3


@pytest.mark.parametrize("tail", [record("1.1", 9, "cut"), b"text", record("1.1", "x", "abc") + b"\r\n\r\n" + record("1.1", 3, "abc")])
def test_warc_broken_chains(spark, tmp_path, tail):
    (tmp_path / "a.warc").write_bytes(record("1.1", 3, "abc") + b"\r\n\r\n" + tail)
    with pytest.raises(ValueError, match="a.warc"):
        warc.read(spark, str(tmp_path / "a.warc"))
    assert [r.payload_bytes for r in warc.read(spark, str(tmp_path / "a.warc"), strict=False).collect()] == [3]


def test_warc_of_nothing(spark, tmp_path):
    warc.write(pages(spark, []), str(tmp_path / "none"))
    assert warc.read(spark, str(tmp_path / "none")).count() == 0


# ------------------------------------------------------------------ mixing


@pytest.mark.parametrize("counts", [{"a": 1}, {"a": 900, "b": 50, "c": 50}, {str(k): k + 1 for k in range(37)}])
def test_schedule_stays_within_a_block(counts):
    share, slots = mixing.shares(counts)
    assert sum(share.values()) == slots and min(share.values()) >= 1
    places = mixing.schedule(share, slots)
    owner = {t: s for s, ts in places.items() for t in ts}
    assert sorted(owner) == list(range(slots))
    done = dict.fromkeys(share, 0)
    for t in range(slots):
        done[owner[t]] += 1
        assert all(abs(done[s] - (t + 1) * share[s] / slots) < 1 for s in share)


def test_weights_are_exact():
    some = {f"s{k}": 0.005 for k in range(100)} | {"hot": 0.5}
    share, slots = mixing.shares(dict.fromkeys(some, 7), some)
    assert (slots, share["hot"], share["s3"]) == (200, 100, 1)
    many = {str(k): 1 + k % 3 for k in range(5000)}
    share, slots = mixing.shares(dict.fromkeys(many, 1), many, 1000)
    assert sum(share.values()) == slots == sum(many.values())  # 16 slots a source, at least, are allowed
    odd = {"a": 1 / 3, "b": 0.1234567, "c": 1e-9}
    share, slots = mixing.shares(dict.fromkeys(odd, 1), odd, 1000)
    assert slots == 1000 and sum(share.values()) == 1000 and share["c"] == 1
    with pytest.raises(ValueError):
        mixing.shares({"a": 1}, {"a": 0.0})


def plain_mix(counts, weights, block):
    """Slot of each (source, block) and the first empty slot: slot by slot, of the released blocks the earliest deadline."""
    names, total = sorted(counts), sum(map(Fraction, map(str, weights.values())))
    w = {s: Fraction(str(weights[s])) / total for s in names}
    taken, out, t, gap = dict.fromkeys(names, 0), {}, 0, None
    while any(taken[s] * block < counts[s] for s in names):
        ready = [(ceil((taken[s] + 1) / w[s]), ((taken[s] + 1) / w[s]).denominator == 1, k, s) for k, s in enumerate(names) if floor(taken[s] / w[s]) <= t]
        if ready:
            s = min(ready)[3]
            if taken[s] * block < counts[s]:
                out[s, taken[s]] = t
            elif gap is None:
                gap = t
            taken[s] += 1
        t += 1
    return out, gap


def test_mixing_against_brute_force(spark):
    rows = [(k, "hot" if k % 3 else f"s{k % 5}", "t", k) for k in range(3000)] + [(None, None, "t", 1), (7000, None, "t", 2), (1, "hot", "other", 3), (1, "hot", "t", 1)]
    df = spark.createDataFrame(rows, "doc_id long, source string, block string, `x.y` int")
    weights = {"hot": 5.0, None: 0.1, **{f"s{k}": 1.0 for k in range(5)}}
    out = mixing.mix(df, weights, block=10).toPandas()
    assert len(out) == len(rows) and list(out.columns) == ["doc_id", "source", "x.y", *mixing.PLACES]
    name = lambda s: s if isinstance(s, str) else ""
    counts = {}
    for _, s, _, _ in rows:
        counts[name(s)] = counts.get(name(s), 0) + 1
    slots, gap = plain_mix(counts, {name(s): w for s, w in weights.items()}, 10)
    ranks = {}
    for r in out.itertuples():
        assert (r.block, r.slot) == (r.rank_in_source // 10, slots[name(r.source), r.block])
        assert gap is None or r.in_target == (r.slot < gap)
        ranks.setdefault(name(r.source), []).append(r.rank_in_source)
    assert all(sorted(k) == list(range(counts[s])) for s, k in ranks.items())
    again = mixing.mix(df.repartition(7), weights, block=10).toPandas()
    key = ["doc_id", "source", "x.y", *mixing.PLACES]
    assert sorted(map(str, out[key].values.tolist())) == sorted(map(str, again[key].values.tolist()))
    assert mixing.stage(df).columns == df.columns
    assert mixing.mix(df.limit(0)).count() == 0
    wide = spark.createDataFrame([(k, f"source {k}") for k in range(1001)], "doc_id long, source string")
    assert mixing.mix(wide).select("slot").distinct().count() == 1001


# ------------------------------------------------------------------ token ids

TEXTS = ["", None, "Hello world", "a  b   c", " lead and trail ", "x\n y\n\nz \n w", "don't we'll 's", "日本語 テスト", "naïve café über", "tab\tend", "\u00a0nbsp\u2003em", "a<|endoftext|>b", "1234 567 !!??", "e\u0301 combining", "zero\x00byte \x01", "👍🏽 ok", "word " * 300]


def byte_bpe():
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        return f.read()


def test_encoder_equals_the_library():
    import pyarrow as pa
    from tokenizers import Tokenizer

    rng = random.Random(6)
    texts = [t or "" for t in TEXTS] + ["".join(rng.choices(" \n\tab,.'1é!’", k=rng.randint(0, 40))) for _ in range(400)]
    plain = Tokenizer.from_str(byte_bpe())
    ids, sizes = token_binary.Encoder(byte_bpe()).encode(pa.array(texts))
    parts = np.split(ids, np.cumsum(sizes)[:-1])
    assert [p.tolist() for p in parts] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_packing_round_trip():
    rng = np.random.default_rng(3)
    counts = np.array([1, 0, 7, 4, 100, 3])
    ranks = rng.choice([0, 1, 255, 256, 65535, 65536, 1 << 24, (1 << 32) - 1], counts.sum()).astype(np.uint32)
    control, data = token_binary.pack(ranks, counts)
    assert [len(c) for c in control] == [-(-n // 4) for n in counts]
    assert (token_binary.unpack(b"".join(control), b"".join(data), counts) == ranks).all()


def test_token_files(spark, tmp_path):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_str(byte_bpe())
    rows = [(7 * k - 20, t) for k, t in enumerate(TEXTS * 3)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, n int").repartition(3)
    path = str(tmp_path / "tokens")
    token_binary.write(df, path, byte_bpe())
    got = sorted(token_binary.read(spark, path).collect(), key=lambda r: r.doc_id)
    start = 0
    for r, (i, t) in zip(got, sorted(rows, key=lambda x: x[0])):
        ids = plain.encode(t or "", add_special_tokens=False).ids + [0]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    token_binary.write(df.limit(0), str(tmp_path / "none"), byte_bpe())
    assert token_binary.read(spark, str(tmp_path / "none")).count() == 0


def check_tokens(spark, rows, path, parts=1):
    """Starts and sums of the rows in the order of id (none first) and text hash."""
    from tokenizers import Tokenizer

    plain = Tokenizer.from_str(byte_bpe())
    df = spark.createDataFrame([(i, t, 0, "x") for i, t in rows], "doc_id long, text string, start int, `a.b` string").repartition(parts)
    token_binary.write(df, path, byte_bpe())
    got = sorted(token_binary.read(spark, path).collect(), key=lambda r: r.start)
    tie = lambda t: xxhash.xxh64_intdigest((t or "").encode(), 42) >> 11
    start = 0
    assert len(got) == len(rows)
    for r, (i, t) in zip(got, sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, tie(x[1])))):
        ids = plain.encode(t or "", add_special_tokens=False).ids + [0]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_more_than_a_thousand_blocks_of_a_partition(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_binary, "BLOCK_BYTES", 1)
    monkeypatch.setattr(token_binary, "ranges", lambda texts, parts: [])
    rows = [(k, f"text {k}" * (k % 3)) for k in range(1100)]
    check_tokens(spark, rows, str(tmp_path / "tokens"))


def test_ids_that_are_null_or_repeated_are_cut(spark, tmp_path):
    rows = [(None, f"none {k}") for k in range(150)] + [(7, f"seven {k % 50}") for k in range(150)] + [(9, "same")] * 120 + [(k, None if k % 2 else "") for k in range(20)]
    texts = token_binary._texts(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text")
    cuts = token_binary.ranges(texts, 12)
    assert sum(i == 7 for i, _ in cuts) > 2 and cuts.count(max(c for c in cuts if c[0] == 9)) > 1
    check_tokens(spark, rows, str(tmp_path / "tokens"), 3)


# ------------------------------------------------------------------ SentencePiece


def test_sentencepiece_equals_the_library(spark):
    import sentencepiece

    model = sentencepiece_codec._model()
    lib = sentencepiece.SentencePieceProcessor(model_proto=model)
    rng = random.Random(8)
    texts = [t or "" for t in TEXTS] + ["x" * 700, " " * 300 + "z", "ab" * 400] + ["".join(rng.choices(" \nabcdeé.,日", k=rng.randint(0, 60))) for _ in range(300)]
    codec = sentencepiece_codec.Codec(model)
    ids = codec.encode(texts)
    assert [x.tolist() for x in ids] == lib.encode(texts)
    assert [codec.decode(x) for x in ids] == [lib.decode(x.tolist()) for x in ids] == texts
    df = spark.createDataFrame([*((k, t, 1) for k, t in enumerate(TEXTS)), (None, "x", 2), (0, "repeated", 3)], "doc_id long, text string, ids int")
    coded = sentencepiece_codec.with_ids(df, model)
    assert all(r.round_trip for r in coded.collect())
    back = sorted((-1 if r.doc_id is None else r.doc_id, r.text) for r in sentencepiece_codec.decoded(coded, model).collect())
    assert back == sorted([*((k, t or "") for k, t in enumerate(TEXTS)), (-1, "x"), (0, "repeated")])
    assert sentencepiece_codec.with_ids(df.limit(0), model).count() == 0


def test_viterbi_finds_the_best_sum():
    model = sentencepiece_codec.Model(sentencepiece_codec._model())
    words = ["▁the", "▁ing", "▁hes", "tion", "ab", "x", "▁日本"]

    def best(w):
        top = {0: 0.0}
        for e in range(1, len(w) + 1):
            top[e] = max(top[s] + (model.exact[w[s:e]][1] if w[s:e] in model.exact else model.worst - 10 if e == s + 1 else -np.inf) for s in range(e))
        return top[len(w)]

    for w in words:
        for spans in (sentencepiece_codec.viterbi(model, [w])[0], sentencepiece_codec.viterbi_long(model, w)):
            assert "".join(w[s:e] for s, e in spans) == w
            assert sum(model.exact[w[s:e]][1] if w[s:e] in model.exact else model.worst - 10 for s, e in spans) == pytest.approx(best(w))


def unigram(data):
    """The model with its type switched to unigram: the trainer's field 3 set to 1."""

    def number(n):
        out = b""
        while n > 0x7F:
            out, n = out + bytes([n & 0x7F | 0x80]), n >> 7
        return out + bytes([n])

    def message(parts):
        return b"".join(number(k << 3) + number(v) if isinstance(v, int) else number(k << 3 | 2) + number(len(v)) + v for k, v in parts)

    fields = list(sentencepiece_codec.fields(data))
    trainer = [(k, v) for k, v in sentencepiece_codec.fields(dict(fields)[2]) if k != 3 and not (isinstance(v, bytes) and len(v) == 4)]
    return message([(k, message([*trainer, (3, 1)]) if k == 2 else v) for k, v in fields])


def test_viterbi_equals_the_best_of_the_library_lattice():
    import sentencepiece

    model = unigram(sentencepiece_codec._model())
    lib, codec = sentencepiece.SentencePieceProcessor(model_proto=model), sentencepiece_codec.Codec(model)
    assert codec.algorithm == "viterbi"
    rng = random.Random(11)
    words = ["the", "hested", "international"] + ["".join(rng.choices("etaoinshr", k=rng.randint(1, 12))) for _ in range(200)]
    score = lambda ids: sum(lib.get_score(i) for i in ids)
    for w, ids in zip(words, codec.encode(words)):
        assert score(ids.tolist()) == max(map(score, lib.nbest_encode_as_ids(w, 4)))  # of one path it takes the quick way


def test_long_words_equal_short_ones(monkeypatch):
    codec = sentencepiece_codec.Codec(sentencepiece_codec._model())
    words = ["▁international", "▁aaaaaaaaaaaa", "▁hetherthe", "bbbb", "▁", "▁▁▁▁▁"]
    for w in words:
        assert sentencepiece_codec.merge(codec.model, [w])[0] == sentencepiece_codec.merge_long(codec.model, w)


# ------------------------------------------------------------------ pipeline


def plain_pipeline(spark, d):
    """(kept ids, text of each) stage by stage: the list as learned, lines and near-duplicates from their definitions."""
    from test_shingle_join import plain_set

    from parcelforge.llm import quality_rules

    docs = {r.doc_id: r for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    table = spark.read.parquet(f"{d}/documents.parquet")
    rules = quality_rules.fit(table, spark.read.parquet(f"{d}/labels.parquet"))
    kept = {}
    for i, r in docs.items():
        counts = dict(zip(quality_rules.COUNTS, quality_rules.measure((r.text or "").encode())))
        x = {f: np.array([counts[a] / max(1, counts[b])]) for f, (a, b) in quality_rules.FEATURES.items()}
        if counts["n_words"] >= 20 and 100 * counts["n_repeat_words"] <= 30 * counts["n_words"] and not any(all(c.holds(x)[0] for c in rule.conditions) for rule in rules):
            kept[i] = r.text
    gone = plain_dedup(list(kept.items()))
    texts = {}
    for i, t in kept.items():
        lost = gone.get((i, t), set())
        text = "\n".join(x for k, x in enumerate(t.split("\n")) if k not in lost) if lost else t
        if not lost or text.split():
            texts[i] = text
    sets = {i: plain_set(t) for i, t in texts.items()}
    marks = {i: simhash.fingerprint(t.encode(), 5) for i, t in texts.items()}
    pairs = [(a, b) for a in texts for b in texts if a < b and ((marks[a] ^ marks[b]).bit_count() <= 4 or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]))]
    root = union(texts, pairs)
    return {i: t for i, t in texts.items() if root[i] == i}, {i: docs[i].source for i in texts}


def test_pipeline_against_brute_force(spark):
    import corpus_pipeline
    import sentencepiece

    d = "/root/testdata/sf0.001"
    texts, sources = plain_pipeline(spark, d)
    final = {r.doc_id: r for r in corpus_pipeline.run(spark, d).collect()}
    assert set(final) == set(texts)
    library = sentencepiece.SentencePieceProcessor(model_proto=sentencepiece_codec._model())
    assert all(list(r.ids) == library.encode(texts[i]) and r.n_tokens == len(r.ids) and r.round_trip and r.source == sources[i] for i, r in final.items())
    counts = {}
    for i in texts:
        counts[sources[i]] = counts.get(sources[i], 0) + 1
    slots, gap = plain_mix(counts, {s: max(1, int(n**0.5)) for s, n in counts.items()}, 100)
    for r in final.values():
        assert (r.block, r.slot) == (r.rank_in_source // 100, slots[r.source, r.block]) and r.in_target == (gap is None or r.slot < gap)


def test_queries_are_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert {f"op{n}" for n in range(1, 11)} <= {n.split("_")[0] for n in names} and "pipeline" in names


def test_a_long_list_of_words_loses_its_repeats(spark):
    """64,000 lines of a word: what a fingerprint stands for is a slice, not a search of all."""
    n = 64_000
    text = "\n".join(f"w{k * 7919 % 100_003}" for k in range(n))
    got = {r.doc_id: r.gone_words for r in line_dedup.dedup(spark.createDataFrame([(1, text), (2, text), (3, text[:-3])], "doc_id long, text string")).collect()}
    assert got[1] is None and got[2] == n and n - 60 < got[3] <= n
