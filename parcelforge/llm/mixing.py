"""Mixing sources to target weights by Pfair scheduling.

Each source's documents form blocks.  With weight w (its share of slots), block i of a source may run from
floor(i / w) and must have run by ceil((i + 1) / w).  Earliest deadline first over one hyperperiod gives each slot a
source.  Weights are exact fractions; the hyperperiod is their common denominator, after which the schedule repeats.
At any slot each source's blocks differ from its share by less than one block, as long as no source has run out.

Where the common denominator is above ``MOST_SLOTS`` (or above 16 times the number of sources, if that is more), the
weights are rounded to multiples of one in so many, largest remainders first, none to nothing.

All documents are kept.  When a source has run out its slots stay empty and the others go on; ``in_target`` says
which documents come before that.  Only the sources' counts and one hyperperiod go to the driver.  Places within a
source come from counts of hash buckets, so that no source, however large, has to be sorted by one task.

Defined results: a null source is a source of its own; documents of a source are ordered by a hash of id and content,
so that ties are settled and only rows that are the same in all columns are interchangeable; a source without a weight,
or with one that is not above 0 and finite, is refused by name, a weight without a source has no effect; documents without id
have a place as well; an empty table gives an empty result; extra columns pass through whatever their names.

:func:`stage` decides on the schedule and leaves it with its result, as metadata of the source column, which files and
shuffles keep; :func:`places` gives the rows their places by it.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Mapping
from fractions import Fraction
from math import isqrt, lcm

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parcelforge.llm.common import materialize, quoted, row_hash, unused

#: Slots of a hyperperiod, at most, unless there are very many sources: the schedule of one goes to the driver.
MOST_SLOTS = 1 << 18
#: Documents of a source that a task ranks at once, about.
BUCKET = 2048
#: The columns that :func:`mix` adds.
PLACES = ("block", "slot", "rank_in_source", "in_target")
#: The metadata's name of the schedule.
SCHEDULE = "mixing"


def shares(counts: Mapping[str, int], weights: Mapping[str, float] | None = None, most_slots: int = MOST_SLOTS) -> tuple[dict[str, int], int]:
    """Slots of each source in a hyperperiod, and the hyperperiod's slots: weights exact where these are few enough.

    Without ``weights`` they are the whole square roots of the counts, which evens out large and small sources.
    """
    names = sorted(counts)
    if weights is not None:
        lacking = [s.removeprefix("=") if s else None for s in names if s not in weights]
        if lacking:
            raise ValueError(f"no weight is given for the source {lacking[0]!r}")
        odd = [s for s in names if not 0 < float(weights[s]) < float("inf")]
        if odd:
            raise ValueError(f"the weight of {odd[0].removeprefix('=')!r} must be above 0 and finite")
    raw = {s: Fraction(isqrt(counts[s])) if weights is None else Fraction(str(weights[s])) for s in names}
    if any(w <= 0 for w in raw.values()):
        raise ValueError("weights must be above 0")
    total = sum(raw.values())
    exact = {s: w / total for s, w in raw.items()}
    slots = lcm(*(w.denominator for w in exact.values()))
    most = max(most_slots, 16 * len(names))
    if slots > most:
        slots = most
    out = {s: max(1, int(exact[s] * slots)) for s in names}
    # What is left goes to the largest remainders; what is too much comes from the largest sources.
    for s in sorted(names, key=lambda s: int(exact[s] * slots) - exact[s] * slots)[: max(0, slots - sum(out.values()))]:
        out[s] += 1
    while (over := sum(out.values()) - slots) > 0:
        s = max(names, key=lambda s: out[s])
        out[s] -= min(over, max(1, out[s] // 2))
    return out, slots


def schedule(share: dict[str, int], slots: int) -> dict[str, list[int]]:
    """The slots of each source in one hyperperiod: earliest deadline first among released blocks."""
    names = sorted(share)
    waiting = []  # (release, deadline, source, block)
    window = lambda k, i: (i * slots // share[names[k]], -(-(i + 1) * slots // share[names[k]]))
    for k in range(len(names)):
        release, deadline = window(k, 0)
        waiting.append((release, deadline, k, 0))
    heapq.heapify(waiting)
    ready: list[tuple[int, int, int, int]] = []
    out: dict[str, list[int]] = {s: [] for s in names}
    for t in range(slots):
        while waiting and waiting[0][0] <= t:
            release, deadline, k, i = heapq.heappop(waiting)
            # Equal deadlines: of those whose windows overlap the next one of the same source first (the b-bit).
            tight = Fraction((i + 1) * slots, share[names[k]]).denominator == 1
            heapq.heappush(ready, (deadline, tight, k, i))
        if ready:
            deadline, _, k, i = heapq.heappop(ready)
            if deadline <= t:
                raise AssertionError("a deadline has passed")
            out[names[k]].append(t)
            if i + 1 < share[names[k]]:
                release, after = window(k, i + 1)
                heapq.heappush(waiting, (max(release, t + 1), after, k, i + 1))
    return out


def _code(source: str):
    """A source as text that is never null, so that a join needs no other partitioning than a window over it."""
    return F.coalesce(F.concat(F.lit("="), quoted(source).cast("string")), F.lit(""))


def decide(docs: DataFrame, weights: Mapping[str | None, float] | None = None, *, block: int = 100, most_slots: int = MOST_SLOTS, source: str = "source") -> dict:
    """The schedule: documents and slots of each source, the hyperperiod's slots, and the size of a block."""
    # One row for each source.
    counts = {r[0]: r[1] for r in docs.groupBy(_code(source).alias("code")).agg(F.count("*")).collect()}
    share, slots = shares(counts, weights and {"" if s is None else f"={s}": w for s, w in weights.items()}, most_slots) if counts else ({}, 0)
    return {"counts": counts, "share": share, "slots": slots, "block": block}


def mix(docs: DataFrame, weights: Mapping[str | None, float] | None = None, *, block: int = 100, most_slots: int = MOST_SLOTS, seed: int = 8, key: str = "doc_id", source: str = "source", names: tuple[str, ...] = PLACES, made: dict | None = None) -> DataFrame:
    """``docs`` with the number of their block in its source, the block's slot, their rank within the source, and whether
    that is before the first empty slot; under ``names``, in place of columns of those names.

    made: a schedule of :func:`decide`, which is then not decided here.
    """
    spark = docs.sparkSession
    made = made or decide(docs, weights, block=block, most_slots=most_slots, source=source)
    counts, share, slots, block = (made[k] for k in ("counts", "share", "slots", "block"))
    kept = [c for c in docs.columns if c.lower() not in {n.lower() for n in names}]
    code, h, own_rank, bucket, number = unused(docs, "pf_source", "pf_h", "pf_own", "pf_bucket", "pf_number")
    blocks_of, share_of, ahead_of, at_slot = unused(docs, "pf_buckets", "pf_share", "pf_ahead", "pf_slot")
    named = docs.withColumns({code: _code(source), h: F.xxhash64(quoted(key).cast("string"), F.lit(seed), row_hash(docs))})
    if not counts:
        kinds = zip(names, ("bigint", "bigint", "bigint", "boolean"))
        return docs.select(*map(quoted, kept), *(F.lit(None).cast(t).alias(c) for c, t in kinds))
    places = schedule(share, slots)
    # The first slot that a source leaves empty.
    slot_of = lambda s, i: i // share[s] * slots + places[s][i % share[s]]
    first_gap = min(slot_of(s, -(-n // block)) for s, n in counts.items())
    # A source's buckets are ranges of the hash, as many as its size asks for; a bucket starts where those before it end.
    order = {s: k for k, s in enumerate(sorted(counts))}
    sizes = spark.createDataFrame([(s, order[s], -(-n // BUCKET), share[s]) for s, n in counts.items()], f"{code} string, {number} bigint, {blocks_of} bigint, {share_of} bigint")
    dealt = named.join(F.broadcast(sizes), code, "left")
    # A source that the schedule doesn't know is not left out.
    dealt = dealt.withColumn(blocks_of, F.coalesce(blocks_of, F.raise_error(F.concat(F.lit("not in the schedule: the source "), F.coalesce(quoted(source).cast("string"), F.lit("null")))).cast("bigint")))
    at = F.floor((F.shiftrightunsigned(h, 1).cast("double") / float(1 << 63)) * F.col(blocks_of))
    bucketed = dealt.withColumn(bucket, F.least(at, F.col(blocks_of) - 1)).drop(blocks_of)
    held = materialize(bucketed.groupBy(code, bucket).agg(F.count("*").alias("n")), "mix-buckets", True)
    ahead = held.select(code, bucket, F.coalesce(F.sum("n").over(Window.partitionBy(code).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(ahead_of))
    own = F.row_number().over(Window.partitionBy(code, bucket).orderBy(h, quoted(key).cast("string"))) - 1
    rank = (F.col(ahead_of) + F.col(own_rank)).cast("bigint")
    ranked = bucketed.withColumn(own_rank, own).join(ahead.hint("merge"), [code, bucket]).withColumn(own_rank, rank)
    # A row for each slot of a hyperperiod, found by the source's number and the block's place in its share.
    table = spark.createDataFrame([(order[s] << 32 | i, t) for s, ts in places.items() for i, t in enumerate(ts)], f"{number} bigint, {at_slot} bigint")
    in_source = F.floor(F.col(own_rank) / block)
    placed = ranked.withColumn(number, F.shiftleft(number, 32) + in_source % F.col(share_of)).join(F.broadcast(table), number)
    slot = F.floor(in_source / F.col(share_of)) * slots + F.col(at_slot)
    values = in_source.cast("bigint"), slot.cast("bigint"), F.col(own_rank), slot < first_gap
    return placed.select(*map(quoted, kept), *(v.alias(n) for v, n in zip(values, names)))


def stage(docs: DataFrame, weights: Mapping[str | None, float] | None = None, *, block: int = 100, most_slots: int = MOST_SLOTS, source: str = "source", **options) -> DataFrame:
    """The rows of ``docs`` in the order of the schedule, over all partitions and within each, and with the schedule."""
    made = decide(docs, weights, block=block, most_slots=most_slots, source=source)
    names = tuple(unused(docs, *(f"pf_{n}" for n in PLACES)))
    out = mix(docs, source=source, names=names, made=made, **options)
    ordered = out.repartitionByRange(names[1], names[2]).sortWithinPartitions(names[1], names[2])
    kept = {f.name: f.metadata for f in docs.schema if f.name.lower() == source.lower()}
    held = lambda c: quoted(c).alias(c, metadata=kept[c] | {SCHEDULE: json.dumps(made)}) if c in kept else quoted(c)
    return ordered.select(*map(held, docs.columns))


def places(docs: DataFrame, *, source: str = "source", **options) -> DataFrame:
    """What :func:`mix` returns, by the schedule that :func:`stage` has left with the documents."""
    made = next((f.metadata[SCHEDULE] for f in docs.schema if f.name.lower() == source.lower() and SCHEDULE in f.metadata), None)
    if made is None:
        raise ValueError("the documents have no schedule: the mixing stage comes first")
    return mix(docs, source=source, made=json.loads(made), **options)


def query(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source"))
