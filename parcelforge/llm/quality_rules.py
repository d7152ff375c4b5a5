"""Quality rules: text statistics, and a decision list learned from labelled documents.

:func:`statistics` counts over whole texts.  :func:`learn` grows and prunes threshold conjunctions by sequential
covering; :func:`verdict` turns the list into one ordered Spark conditional expression.

Defined results: a null text has no words and fails the base rule, as an empty one does; documents without labels
take no part in learning; several labels of one id count as the lowest, for all documents of that id; without labels of both kinds the
learned list is empty and the base rule alone decides; ties between conditions go to the first feature and the
lowest threshold; extra columns pass through :func:`keep` whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parcelforge.llm.common import quoted, unused

SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"
CONTINUATION = bytes(range(0x80, 0xC0))
UPPER = bytes(range(0x41, 0x5B))
DIGITS = bytes(range(0x30, 0x3A))
WINDOW = 8

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_bangs", "n_distinct")
#: What the learner sees: shares, so that thresholds don't depend on a text's length.
FEATURES = {
    "word_len": ("word_chars", "n_words"),
    "symbol_share": ("n_symbols", "word_chars"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "repeat_share": ("n_repeat_words", "n_words"),
    "upper_share": ("n_upper", "word_chars"),
    "digit_share": ("n_digits", "word_chars"),
    "bang_share": ("n_bangs", "n_words"),
    "distinct_share": ("n_distinct", "n_words"),
    "line_words": ("n_words", "n_lines"),
}
#: Labelled rows the list is fitted on, at most: those of the smallest xxhash64(doc_id), then doc_id and text hash.
MAX_LABELLED = 20_000

_rng = np.random.default_rng(20)
_MULTIPLIERS = _rng.integers(1, 1 << 63, WINDOW, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def repeated_words(ids: np.ndarray) -> int:
    """Words that lie in windows of eight found twice or more."""
    n = len(ids) - WINDOW + 1
    if n < 2:
        return 0
    wide, h = ids.astype(np.uint64), np.zeros(n, np.uint64)
    for k in range(WINDOW):
        h += wide[k : k + n] * _MULTIPLIERS[k]
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    if not same.any():
        return 0
    a, b = order[:-1][same], order[1:][same]
    spans = np.arange(WINDOW)
    if not (ids[a[:, None] + spans] == ids[b[:, None] + spans]).all():  # two windows of one hash: count exactly
        at: dict[tuple, list[int]] = {}
        for k in range(n):
            at.setdefault(tuple(ids[k : k + WINDOW].tolist()), []).append(k)
        starts = np.array([k for ks in at.values() if len(ks) > 1 for k in ks], np.int64)
    else:
        starts = np.union1d(a, b)
    if not len(starts):
        return 0
    edge = np.zeros(len(ids) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + WINDOW, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def measure(data: bytes | None) -> tuple[int, ...]:
    """The COUNTS of one UTF-8 text."""
    data = data or b""
    words, known = data.split(), {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    lines, seen, repeats, filled = data.split(b"\n"), set(), 0, 0
    for line in lines:
        if line.strip():
            filled += 1
            repeats += line in seen
            seen.add(line)
    size = len(data)
    return (
        len(words),
        len(data.translate(None, CONTINUATION + SPACES)),
        size - len(data.translate(None, SYMBOLS)),
        repeats,
        repeated_words(ids),
        filled,
        size - len(data.translate(None, UPPER)),
        size - len(data.translate(None, DIGITS)),
        data.count(b"!"),
        len(known),
    )


STATS = T.StructType([T.StructField(c, T.LongType()) for c in COUNTS])


@F.pandas_udf(STATS)
def _measured(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([measure(x) for x in texts], columns=COUNTS, dtype="int64")


def statistics(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` and the COUNTS of every row."""
    return docs.select(quoted(key).alias("doc_id"), _measured(quoted(text).cast("string").cast("binary")).alias("_pf_stats")).select("doc_id", "_pf_stats.*")


def base_failed(at: dict[str, str] | None = None) -> Column:
    """``at``: the columns' names where they differ from those of the counts."""
    n, repeated = (F.col((at or {}).get(c, c)) for c in ("n_words", "n_repeat_words"))
    return (n < 20) | (100 * repeated > 30 * n)


def share(name: str, at: dict[str, str] | None = None) -> Column:
    over, under = ((at or {}).get(c, c) for c in FEATURES[name])
    return F.col(over).cast("double") / F.greatest(F.col(under), F.lit(1)).cast("double")


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] > self.threshold if self.above else x[self.feature] <= self.threshold

    def column(self, at: dict[str, str] | None = None) -> Column:
        x = share(self.feature, at)
        return x > self.threshold if self.above else x <= self.threshold


@dataclass(frozen=True)
class Rule:
    """A text that meets all conditions is rejected."""

    conditions: tuple[Condition, ...]
    precision: float
    covered: int


def _holds(conditions, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, bool)
    for c in conditions:
        out &= c.holds(x)
    return out


def _best(x: dict[str, np.ndarray], bad: np.ndarray, weight_bad: float, weight_good: float) -> tuple[float, Condition] | None:
    """The condition of the greatest FOIL gain over the rows that are still covered, among all thresholds."""
    p0, n0 = bad.sum(), (~bad).sum()
    base = np.log2(p0 * weight_bad / (p0 * weight_bad + n0 * weight_good))
    best = None
    for name in FEATURES:
        order = np.argsort(x[name], kind="stable")
        v, is_bad = x[name][order], bad[order]
        cut = np.flatnonzero(v[1:] > v[:-1])
        if not len(cut):
            continue
        low_p = np.cumsum(is_bad)[cut]
        low_n = cut + 1 - low_p
        mid = (v[cut] + v[cut + 1]) / 2
        for above, p, n in ((False, low_p, low_n), (True, p0 - low_p, n0 - low_n)):
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(p > 0, p * (np.log2(p * weight_bad / (p * weight_bad + n * weight_good)) - base), -1.0)
            k = int(np.argmax(gain))
            if best is None or gain[k] > best[0] + 1e-9:
                best = (float(gain[k]), Condition(name, above, float(mid[k])))
    return best


def learn(x: dict[str, np.ndarray], bad: np.ndarray, *, max_rules: int = 12, max_conditions: int = 4, min_precision: float = 0.9, min_covered: int = 5) -> list[Rule]:
    """Sequential covering: each rule is grown on two thirds of the rows left, pruned on the others, and kept where
    its precision on all rows left is at least ``min_precision`` over at least ``min_covered`` rejected rows."""
    rules: list[Rule] = []
    left = np.arange(len(bad))
    while len(rules) < max_rules and bad[left].sum() >= min_covered and (~bad[left]).sum():
        grow, prune = left[np.arange(len(left)) % 3 != 2], left[np.arange(len(left)) % 3 == 2]
        conditions: list[Condition] = []
        at = grow
        while len(conditions) < max_conditions and bad[at].any() and (~bad[at]).any():
            found = _best({k: v[at] for k, v in x.items()}, bad[at], 1.0, 1.0)
            if found is None or found[0] <= 1e-9:
                break
            conditions.append(found[1])
            at = at[found[1].holds({k: v[at] for k, v in x.items()})]
        if not conditions:
            break

        def worth(cs) -> float:
            hit = _holds(cs, {k: v[prune] for k, v in x.items()}, len(prune))
            p, n = bad[prune][hit].sum(), (~bad[prune])[hit].sum()
            return (p - n) / (p + n) if p + n else -1.0

        while len(conditions) > 1 and worth(conditions[:-1]) >= worth(conditions):
            conditions.pop()
        hit = _holds(conditions, {k: v[left] for k, v in x.items()}, len(left))
        p, n = int(bad[left][hit].sum()), int((~bad[left])[hit].sum())
        if p < min_covered or p < min_precision * (p + n):
            break
        rules.append(Rule(tuple(conditions), p / (p + n), p + n))
        left = left[~hit]
    return rules


def verdict(rules: list[Rule], at: dict[str, str] | None = None) -> Column:
    """The ordered list as a conditional: the first rule that fits rejects, otherwise the text is kept."""
    if not rules:
        return F.lit(True)
    out = None
    for r in rules:
        test = r.conditions[0].column(at)
        for c in r.conditions[1:]:
            test = test & c.column(at)
        out = F.when(test, False) if out is None else out.when(test, False)
    return out.otherwise(True)


def labelled(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """doc_id, quality and text of the documents of at most ``max_labelled`` labelled ids: those of the smallest hash.

    The ids are so few that they can be broadcast; texts are not shuffled.  An id may have several documents.
    """
    ids = docs.select("doc_id").where(F.col("doc_id").isNotNull())
    marks = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    some = marks.join(ids, "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    return docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, **options) -> list[Rule]:
    """Learns from at most ``max_labelled`` rows of ``docs`` that have labels (doc_id, quality 0 or 1)."""
    data = F.col("text").cast("string").cast("binary")
    some = labelled(docs, labels, max_labelled).select("doc_id", "quality", F.xxhash64(data).alias("th"), data.alias("data"))

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            yield pd.concat([x[["doc_id", "quality", "th"]], pd.DataFrame([measure(d) for d in x["data"]], columns=COUNTS, dtype="int64", index=x.index)], axis=1)

    # Not a column function: Spark would move it below the join and count over every text.
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in some.schema.fields[:3])
    got = some.mapInPandas(count, f"{kinds}, " + ", ".join(f"{c} bigint" for c in COUNTS))
    # Numbers only, no texts: so many rows at most reach the driver, also where an id has many documents.
    first = got.where(~base_failed()).orderBy(F.xxhash64("doc_id"), "doc_id", "th").limit(max_labelled)
    got = first.select("doc_id", "th", "quality", *(share(f).alias(f) for f in FEATURES)).toPandas()
    got = got.sort_values(["doc_id", "th"], kind="stable")
    return learn({f: got[f].to_numpy(float) for f in FEATURES}, got["quality"].to_numpy() == 0, **options) if len(got) else []


def judged(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, the COUNTS, ``base_failed`` and ``kept`` of every row."""
    rules = fit(docs, labels, **options)
    return statistics(docs).withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & verdict(rules))


def keep(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns; no text is shuffled."""
    rules = fit(docs, labels, **options)
    stats = unused(docs, "pf_stats")[0]
    named = docs.withColumn(stats, _measured(F.col("text").cast("string").cast("binary")))
    at = {c: f"{stats}.{c}" for c in COUNTS}
    return named.where(~base_failed(at) & verdict(rules, at)).drop(stats)


def query(spark, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return judged(docs, labels).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
