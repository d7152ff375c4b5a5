"""Quality classifier: naive Bayes support vectors.

A text's features are indicators of n-grams, hashed to ``FEATURES`` places: of bytes (1 to 3), of words (1 and 2), of
character kinds with runs as one symbol (1 to 5), and of what a word repeats (1 to 6; the word before, one of the eight
before, or none).  Each indicator is scaled by its class log-count ratio; a linear model of hinge loss is fitted to the
rows, scaled to unit length, by dual coordinate descent; its weights are drawn towards their mean size, which mixes it
with naive Bayes itself.  The two classes weigh the same.  The score is a logistic of the margin, so that 0.5 is the
model's own decision.

Labelled rows are a bounded sample, ``max_labelled`` ids of the smallest hash (a parameter; the model's size and the
time to fit it don't grow with the corpus).  Every text is scored whole, in pieces of 1 MB that overlap by what n-grams
need.  Labels, languages, sources and ids are no features.

Defined results: a null text is empty; a text without features gets the model's bias, and so a score as well; a null
doc_id is not held out and has no label; several labels of an id count as the lowest; repeated rows are scored one by
one; with labels of one kind only (or none) the score is that kind's share, or 0.5; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelforge.llm.common import pieces, quoted
from parcelforge.llm.quality_rules import labelled

BITS = 16
FEATURES = 1 << BITS
#: Labelled ids the model is fitted on, at most: those of the smallest xxhash64(doc_id), of whom all are fitted.
MAX_LABELLED = 20_000
FOLDS, HELD_OUT = 3, 1
SMOOTHING, COST, MIX, ROUNDS = 1.0, 1.0, 0.25, 30
#: Margins are this many times as far apart on the logistic's scale.
SLOPE = 3.0

#: Kinds of bytes: line end, other space, digit, capital, letter (all above ASCII too); each mark is a kind of its own.
_KIND = np.arange(256, dtype=np.uint64)
_KIND[[9, 11, 12, 13, 32]] = 32
_KIND[48:58] = 48
_KIND[65:91] = 65
_KIND[97:123] = 97
_KIND[128:] = 97
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_ODD = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.array([pow(0x100000001B3, k, 1 << 64) for k in range(64)], np.uint64)
#: How far back a word is looked for.
BACK = 8


def mixed(h: np.ndarray, family: int) -> np.ndarray:
    """The places of hashes, by families of their own."""
    h = (h ^ np.uint64(family * 0xD6E8FEB86659FD93 % (1 << 64))) * _ODD
    h ^= h >> np.uint64(29)
    return (h * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - BITS)).astype(np.int64)


def runs_of(x: np.ndarray, n: int, base: int) -> np.ndarray:
    """Hashes of the n-grams of a sequence."""
    m = len(x) - n + 1
    if m < 1:
        return np.zeros(0, np.uint64)
    h = x[:m].copy()
    for k in range(1, n):
        h *= np.uint64(base)
        h += x[k : k + m]
    return h


def features(data: bytes | None) -> np.ndarray:
    """The features of a UTF-8 text, sorted, each once."""
    seen = np.zeros(FEATURES, bool)
    if not data:
        return np.zeros(0, np.int64)
    tail, kinds_before, words_before = b"", np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    repeats_before = np.zeros(0, np.uint64)
    for piece in pieces(data):
        x = np.frombuffer(tail + piece, np.uint8)
        wide = x.astype(np.uint64)
        for n in (1, 2, 3):
            seen[mixed(runs_of(wide, n, 257), n)] = True
        tail = (tail + piece)[-2:]
        x = np.frombuffer(piece, np.uint8)
        kinds = np.concatenate([kinds_before, _KIND[x]])
        kinds = kinds[np.r_[True, kinds[1:] != kinds[:-1]]]
        for n in (1, 2, 3, 4, 5):
            seen[mixed(runs_of(kinds, n, 257), 10 + n)] = True
        kinds_before = kinds[-4:]
        inner = ~_SPACE[x]
        edge = np.flatnonzero(np.diff(np.r_[False, inner, False]))
        starts, ends = edge[::2], edge[1::2]
        if not len(starts):
            continue
        # A word's hash: its bytes by powers of their place in it.
        sizes = ends - starts
        letters = x[inner].astype(np.uint64) + np.uint64(1)
        firsts = np.cumsum(sizes) - sizes
        place = np.arange(len(letters)) - np.repeat(firsts, sizes)
        words = np.add.reduceat(letters * _POWERS[place & 63], firsts) + sizes.astype(np.uint64) * _ODD
        seen[mixed(words, 21)] = True
        before = np.concatenate([words_before, words])
        seen[mixed(runs_of(before, 2, 0x2545F491), 22)] = True
        # 1: the word before; 2: one of those before it; 0: neither.
        repeats = np.zeros(len(words), np.uint64)
        at = np.arange(len(before) - len(words), len(before))
        for back in range(BACK, 0, -1):
            ok = at >= back
            hit = np.zeros(len(words), bool)
            hit[ok] = before[at[ok]] == before[at[ok] - back]
            repeats[hit] = 1 if back == 1 else 2
        every = np.concatenate([repeats_before, repeats])
        for n in (1, 2, 3, 4, 5, 6):
            seen[mixed(runs_of(every, n, 5), 30 + n)] = True
        words_before, repeats_before = before[-BACK:], every[-5:]
    return np.flatnonzero(seen)


def packed(f: np.ndarray) -> bytes:
    """Features as 16-bit numbers, or as bits where that is shorter."""
    if 2 * len(f) < FEATURES // 8:
        return f.astype("<u2").tobytes()
    bits = np.zeros(FEATURES, np.uint8)
    bits[f] = 1
    return np.packbits(bits).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    if len(data) < FEATURES // 8:
        return np.frombuffer(data, "<u2").astype(np.int64)
    return np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8)))


@dataclass(frozen=True)
class Model:
    """margin = bias + (sum of weights of a text's features) / (root of the sum of their squared ratios)."""

    weights: np.ndarray
    squares: np.ndarray
    bias: float
    #: The score where nothing could be learned.
    share: float | None = None

    def score(self, f: np.ndarray) -> float:
        if self.share is not None:
            return self.share
        size = float(self.squares[f].sum()) ** 0.5
        margin = self.bias + float(self.weights[f].sum()) / max(size, 1e-9)
        return float(1 / (1 + np.exp(-np.clip(SLOPE * margin, -500, 500))))


def train(rows: list[bytes], good: np.ndarray, *, rounds: int = ROUNDS, cost: float = COST, mix: float = MIX) -> Model:
    """Fits packed features: ratios from all rows, then hinge loss with squared weights by dual coordinate descent, in an order drawn anew
    each round from a fixed seed."""
    zero = np.zeros(FEATURES, np.float32)
    if not good.any() or good.all():
        return Model(zero, zero, 0.0, 0.5 if not len(good) else float(good[0]))
    p, q = np.full(FEATURES, SMOOTHING), np.full(FEATURES, SMOOTHING)
    for f, y in zip(rows, good):
        (p if y else q)[unpacked(f)] += 1
    # Counts out of the rows of a class: how likely a text of it is to have the feature.
    ratio = np.log(p / (good.sum() + 2 * SMOOTHING)) - np.log(q / ((~good).sum() + 2 * SMOOTHING))
    squares = ratio * ratio
    y = np.where(good, 1.0, -1.0)
    bound = cost * np.where(good, len(good) / (2 * good.sum()), len(good) / (2 * (~good).sum()))
    size = np.array([max(float(squares[unpacked(f)].sum()) ** 0.5, 1e-9) for f in rows])
    # A row has length 1, and the bias is a feature of its own, of value 1.
    curve = 2.0
    w, b, alpha = np.zeros(FEATURES), 0.0, np.zeros(len(rows))
    draw = np.random.default_rng(11)
    for _ in range(rounds):
        moved = 0.0
        for i in draw.permutation(len(rows)):
            f = unpacked(rows[i])
            x = ratio[f] / size[i]
            slope = y[i] * (float(w[f] @ x) + b) - 1.0
            new = min(max(alpha[i] - slope / curve, 0.0), bound[i])
            step = (new - alpha[i]) * y[i]
            if step:
                w[f] += step * x
                b += step
                moved = max(moved, abs(step))
                alpha[i] = new
        if moved < 1e-3:
            break
    # Towards the mean size of the weights, with the sign of naive Bayes.
    mean = np.abs(w).mean()
    w = (1 - mix) * w + mix * mean * np.sign(ratio)
    return Model((w * ratio).astype(np.float32), squares.astype(np.float32), b)


def held_out(key: str = "doc_id") -> Column:
    """Whether a document's labels are left out: crc32 of its id as text, modulo ``FOLDS``."""
    return F.coalesce(F.crc32(quoted(key).cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, **options) -> Model:
    """Learns from at most ``max_labelled`` rows of ``docs`` that are not held out and have labels (doc_id, quality).

    One task fits them; of a row it holds 8 KB at most.
    """
    data = F.col("text").cast("string").cast("binary")
    some = labelled(docs.where(~held_out()), labels, max_labelled).select("doc_id", "quality", F.xxhash64(data).alias("th"), data.alias("data"))

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [packed(features(x.as_py())) for x in batch.column(3)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), pa.array(held, pa.binary())], names=["doc_id", "quality", "th", "features"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in some.schema.fields[:3])
    first = some.mapInArrow(seen, f"{kinds}, features binary").orderBy(F.xxhash64("doc_id"), "doc_id", "th").limit(max_labelled)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, good = [], []
        for batch in batches:
            rows += batch.column(3).to_pylist()
            good += [x != 0 for x in batch.column(1).to_pylist()]
        m = train(rows, np.array(good, bool), **options)
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (m.weights.tobytes(), m.squares.tobytes(), m.bias)] + [pa.array([m.share], pa.float64())], names=["weights", "squares", "bias", "share"])

    got = first.select("doc_id", "quality", "th", "features").coalesce(1).mapInArrow(learn, "weights binary, squares binary, bias double, share double").first()
    if got is None:
        return train([], np.zeros(0, bool))
    return Model(*(np.frombuffer(got[c], np.float32) for c in ("weights", "squares")), got.bias, got.share)


def scored(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = pa.array([model.score(features(x.as_py())) for x in batch.column(2)], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), s], names=["doc_id", "held_out", "score"])

    narrow = docs.select(quoted(key).alias("doc_id"), held_out(key).alias("held_out"), quoted(text).cast("string").cast("binary").alias("data"))
    kind = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def query(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.select("doc_id", "text")
    return scored(docs, fit(docs, labels))
