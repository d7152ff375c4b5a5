"""Document fingerprints by context-triggered piecewise hashing.

A rolling hash over the last seven bytes cuts a text where it meets a trigger; each chunk gives a 12-bit symbol.  A
fingerprint is ``block size : symbols at that size : symbols at twice the size``; fingerprints of equal or adjacent
block sizes are compared by the edit distance (insertions and deletions) of their symbols.

The block size is 3 * 2^k, the smallest that expects at most 64 chunks; it follows from the length alone, so that a text
and its edited form are compatible whatever they hold.  A chunk has a quarter of the block size at least and four times
as much at most: triggers closer than that are passed over, and a stretch without any is cut by length, counted from
the cut before.  So texts that repeat themselves, whose few windows are all triggers or none, have as many symbols as
others (8 to 256 at the block size), and a cut depends on the text since the last trigger only.

Defined results: a null text counts as empty; an empty text has the fingerprint ``3::``, like itself (1) and
unlike any other (0); rows without id come first in the order; documents of one id follow each other by a hash of
their texts; a single document is its own successor; an empty table gives an empty result; the result's columns are
named here, so extra columns cannot clash.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelforge.llm.common import materialize, quoted

WINDOW, LEAST_BLOCK, CHUNKS = 7, 3, 64
#: Bytes that are hashed at once; bounds what a long text needs.
STEP = 1 << 20
_BASE64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
_SYMBOLS = [a + b for a in _BASE64 for b in _BASE64]
_POWERS = [np.uint32(pow(0x01000193, k, 1 << 32)) for k in range(WINDOW)]


def triggers(data: bytes, block: int) -> tuple[np.ndarray, np.ndarray]:
    """Places behind a trigger at ``block``, and of those the ones that are triggers at twice the size as well."""
    found = []
    for at in range(0, len(data), STEP):
        b = np.frombuffer(data[max(0, at - WINDOW + 1) : at + STEP], np.uint8).astype(np.uint32)
        h = b.copy()
        for k in range(1, min(WINDOW, len(b))):
            h[k:] += b[: len(b) - k] * _POWERS[k]
        h = h[min(at, WINDOW - 1) :]
        h ^= h >> np.uint32(16)
        h *= np.uint32(0x7FEB352D)
        h ^= h >> np.uint32(15)
        ends = np.flatnonzero(h % np.uint32(block) == block - 1)
        found.append(np.stack([ends + at + 1, h[ends] % np.uint32(2 * block) == 2 * block - 1]))
    both = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
    return both[0], both[0][both[1] > 0]


def cuts(ends: list[int], size: int, block: int) -> list[int]:
    """Ends of the chunks of a text of so many bytes, which has triggers at ``ends``."""
    least, most, at, out = max(1, block // 4), 4 * block, 0, []
    while at < size:
        k = bisect_left(ends, at + least)
        at = min(ends[k] if k < len(ends) else size, at + most, size)
        out.append(at)
    return out


def symbols(data: bytes, ends: np.ndarray, block: int) -> str:
    start, out = 0, []
    for end in cuts(ends.tolist(), len(data), block):
        out.append(_SYMBOLS[xxhash.xxh32_intdigest(data[start:end]) >> 20])
        start = end
    return "".join(out)


def fingerprint(data: bytes) -> str:
    """The fingerprint of a UTF-8 text."""
    block = LEAST_BLOCK
    if not data:
        return f"{block}::"
    while block * CHUNKS < len(data):
        block *= 2
    once, twice = triggers(data, block)
    return f"{block}:{symbols(data, once, block)}:{symbols(data, twice, 2 * block)}"


def common(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, a machine word of ``a`` at a time."""
    where: dict[str, int] = {}
    for k, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << k
    full = (1 << len(a)) - 1
    v = full
    for x in b:
        u = v & where.get(x, 0)
        v = (v + u | v - u) & full
    return len(a) - v.bit_count()


def nearness(a: str, b: str) -> float:
    """1 less the edit distance of two symbol strings by their joint length."""
    if a == b:
        return 1.0
    xs, ys = ([s[k : k + 2] for k in range(0, len(s), 2)] for s in (a, b))
    return 2 * common(xs, ys) / (len(xs) + len(ys)) if xs and ys else 0.0


def likeness(a: str, b: str) -> float:
    """Of two fingerprints, 0 to 1; 0 where block sizes are more than a factor of two apart."""
    if a == b:
        return 1.0
    (m, a1, a2), (n, b1, b2) = ((int(x[0]), x[1], x[2]) for x in (a.split(":"), b.split(":")))
    if m == n:
        return max(nearness(a1, b1), nearness(a2, b2)) if a1 and b1 else 0.0
    if n == 2 * m:
        return nearness(a2, b1)
    return nearness(a1, b2) if m == 2 * n else 0.0


def edited(text: str, following: str) -> str:
    """The last floor(n / 2) code points replaced by the first as many (or all) of the next text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _compare(text: str, mark: str, following: str, next_mark: str) -> tuple:
    new = edited(text, following).encode()
    new_mark = fingerprint(new)
    return len(text), hashlib.sha256(new).hexdigest(), mark, new_mark, likeness(mark, new_mark), likeness(mark, next_mark)


_NAMES = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
_TYPES = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
_DDL = "n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def against_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of every row.

    Texts are dealt out once by ranges of ids; within a range each document meets the next.  The first and the last
    text of a range are kept, and the last meets the first of the next range (after the last range: the first).
    """
    spark = docs.sparkSession
    # The hash spreads documents of one id over ranges as well.
    named = docs.select(quoted(key).cast("bigint").alias("doc_id"), F.coalesce(quoted(text).cast("string"), F.lit("")).alias("data"))
    ranged = named.withColumn("tie", F.xxhash64("data")).repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").drop("tie")
    schema = "place int, side string, doc_id bigint, data string, " + _DDL

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, before = TaskContext.get().partitionId(), None

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows)) if rows else [[] for _ in range(10)]
            types = [pa.int32(), pa.string(), pa.int64(), pa.string(), *_TYPES]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["place", "side", "doc_id", "data", *_NAMES])

        none = (None,) * len(_NAMES)
        for batch in batches:
            rows = []
            for doc, data in zip(batch.column(0), batch.column(1)):
                doc, data = doc.as_py(), data.as_py()
                mark = fingerprint(data.encode())
                if before is None:
                    rows.append((place, "first", doc, data, *none))
                else:
                    rows.append((place, None, before[0], None, *_compare(before[1], before[2], data, mark)))
                before = doc, data, mark
            yield batch_of(rows)
        if before is not None:
            yield batch_of([(place, "last", before[0], before[1], *none)])

    done = materialize(ranged.mapInArrow(walk, schema), "piecewise")
    # As many rows as there are ranges: only their numbers go to the driver.
    places = sorted(r.place for r in done.where("side = 'first'").select("place").collect())
    after = spark.createDataFrame(list(zip(places, places[1:] + places[:1])), "place int, next int")
    firsts = done.where("side = 'first'").select(F.col("place").alias("next"), F.col("data").alias("following"))
    edges = done.where("side = 'last'").select("place", "doc_id", "data").join(after, "place").join(firsts.hint("merge"), "next").select("doc_id", "data", "following")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(d, *_compare(a, fingerprint(a.encode()), b, fingerprint(b.encode()))) for d, a, b in zip(*(c.to_pylist() for c in batch.columns))]
            columns = list(zip(*rows)) if rows else [[] for _ in range(7)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64(), *_TYPES])], names=["doc_id", *_NAMES])

    return done.where("side is null").select("doc_id", *_NAMES).unionByName(edges.mapInArrow(meet, "doc_id bigint, " + _DDL))


def query(spark, sf_dir: str) -> DataFrame:
    return against_next(spark.read.parquet(f"{sf_dir}/documents.parquet"))
