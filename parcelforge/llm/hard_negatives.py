"""Hard negatives by Four-Russians scoring.

Vectors become whole numbers and are kept as bit planes: for each bit of the two's complement a string of bytes, each
with the bits of eight dimensions.  An anchor has a table for each group of eight dimensions, of the sums over all 256
subsets; a candidate's byte picks from it.  Summed over the groups of a plane and shifted by the plane's place
(the uppermost counts negatively) these give the full inner product, exactly.

Every anchor meets every row: ``anchors`` blocks and ``rows`` chunks of bounded size are dealt to tasks in all
combinations, and only each task's few best are given on.  Rows of the anchor's label are scored first, for the
positives; those of other labels next, against the bounds that the positives set; so each pair is scored once.

Defined results: rows without vec_id, label or vector, or with a component that is null, not finite or, times 256, of
2^62 or more take no part; repeated rows (same id, label and vector) count once; rows of one id that differ are rows of
their own, as anchors too; of vectors of unequal lengths the shorter one is filled with zeros, and an empty one scores 0;
scores are exact wherever they are a 64-bit number; equal scores are ordered by vec_id, then by a hash of the row;
further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parcelforge.llm.common import discard, materialize

SCALE = 256
EVERY, RELABEL, LABELS = 100, 7, 10
POSITIVES, NEGATIVES = 5, 5
#: Anchors of a block and rows of a chunk, at most about; a chunk of a small table is smaller, so that all cores have one.
ANCHORS, ROWS, LEAST_ROWS = 16_384, 65_536, 2048
#: Scored at once: so many anchors (whose tables are made then) times so many rows.
A_STEP, R_STEP = 128, 4096
GROUP = 8
_BITS = (np.arange(256)[:, None] >> np.arange(GROUP)) & 1


def valid(embeddings: DataFrame) -> DataFrame:
    """(vec_id, label, q, th): rows that take part, relabelled, each once; th settles ties and tells rows apart."""
    x = F.transform("embedding", lambda v: v.cast("double") * SCALE)
    fine = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float(1 << 62)))
    rows = embeddings.where("vec_id is not null and label is not null and embedding is not null").select("vec_id", F.col("label").cast("bigint").alias("label"), x.alias("x")).where(fine)
    named = rows.withColumn("label", F.when(F.col("vec_id") % RELABEL == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label")))
    whole = named.select(F.col("vec_id").cast("bigint").alias("vec_id"), "label", F.transform("x", lambda v: F.floor(v)).alias("q"))
    return whole.withColumn("th", F.xxhash64("vec_id", "label", "q")).dropDuplicates(["vec_id", "label", "th"])


def planes(q: np.ndarray, bits: int) -> np.ndarray:
    """Bytes [row, bit, group] of whole numbers [row, dimension]; the last bit is the sign's."""
    spread = (q[:, None, :] >> np.arange(bits, dtype=np.int64)[:, None]) & 1
    return np.packbits(spread.astype(np.uint8), axis=2, bitorder="little")


def numbers(packed: np.ndarray) -> np.ndarray:
    """The inverse of :func:`planes`."""
    bits = packed.shape[1]
    spread = np.unpackbits(packed, axis=2, bitorder="little").astype(np.int64)
    weight = np.int64(1) << np.arange(bits, dtype=np.int64)
    weight[-1] = -weight[-1]
    return np.einsum("rbd,b->rd", spread, weight)


def tables(q: np.ndarray) -> np.ndarray:
    """Sums [group, byte, anchor] of each anchor's subsets of eight dimensions."""
    grouped = q.reshape(len(q), -1, GROUP)
    out = np.einsum("agd,bd->gba", grouped, _BITS)
    # Narrow where the sums over a plane are.
    return out.astype(np.int32) if q.size == 0 or np.abs(q).max() < (1 << 30) // q.shape[1] else out


def scores(table: np.ndarray, packed: np.ndarray) -> np.ndarray:
    """Inner products [row, anchor]: lookups are summed over a plane's groups, planes shifted and added from the sign on."""
    rows, bits, groups = packed.shape
    out = np.zeros((rows, table.shape[2]), np.int64)
    for k in range(bits - 1, -1, -1):
        plane = table[0][packed[:, k, 0]]
        for g in range(1, groups):
            plane += table[g][packed[:, k, g]]
        if k == bits - 1:
            np.negative(plane, out=plane)
            out += plane
        else:
            out <<= 1
            out += plane
    return out


def best(a: np.ndarray, s: np.ndarray, ids: np.ndarray, th: np.ndarray, top: np.ndarray, least: np.ndarray, owner: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, place) of the first ``most`` for each query: those of its owner's hits (a, s, ids, th), by falling score,
    then id, that score from ``least`` to ``top``."""
    order = np.lexsort((th, ids, ~s, a))  # ~s falls as s rises, for all numbers
    a, s = a[order], s[order]
    first = np.searchsorted(a, np.arange(owner.max(initial=-1) + 2))
    q_out, p_out = [], []
    for q, o in enumerate(owner.tolist()):
        low, high = first[o], first[o + 1]
        start = low + np.searchsorted(~s[low:high], ~top[q])
        end = min(start + most, low + np.searchsorted(~s[low:high], ~least[q], "right"))
        if end > start:
            q_out.append(np.full(end - start, q))
            p_out.append(order[start:end])
    return (np.concatenate(q_out), np.concatenate(p_out)) if q_out else (np.zeros(0, np.int64),) * 2


class Held:
    """The ``most`` best hits of each query so far."""

    def __init__(self, queries: int, most: int):
        self.most = most
        self.at = [np.zeros(0, np.int64)] * 4  # query, score, id, row hash

    def add(self, query: np.ndarray, s: np.ndarray, ids: np.ndarray, th: np.ndarray) -> None:
        merged = [np.concatenate(x) for x in zip(self.at, (query, s, ids, th))]
        order = np.lexsort((merged[3], merged[2], ~merged[1], merged[0]))
        q = merged[0][order]
        starts = np.r_[0, np.flatnonzero(np.diff(q)) + 1] if len(q) else np.zeros(0, np.int64)
        rank = np.arange(len(q)) - np.repeat(starts, np.diff(np.r_[starts, len(q)]))
        self.at = [x[order[rank < self.most]] for x in merged]


def unpacked(frame: pd.DataFrame, groups: int) -> np.ndarray:
    """Bytes [row, bit, group] of a frame's planes."""
    return np.frombuffer(b"".join(frame["planes"]), np.uint8).reshape(len(frame), -1, groups) if len(frame) else np.zeros((0, 1, groups), np.uint8)


def meet(anchors: pd.DataFrame, rows: pd.DataFrame, groups: int, same: bool, queries: pd.DataFrame, most: int) -> pd.DataFrame:
    """The best rows of a chunk for each query: (query, negative or positive id, its row hash, score).

    same: rows of the anchor's label, but for itself, else those of other labels.  queries: owner (place in anchors),
    top and least, the scores wanted.
    """
    held = Held(len(queries), most)
    packed, ids, th, label = unpacked(rows, groups), rows["vec_id"].to_numpy(), rows["th"].to_numpy(), rows["label"].to_numpy()
    own, own_id, own_th, own_label = numbers(unpacked(anchors, groups)), anchors["vec_id"].to_numpy(), anchors["th"].to_numpy(), anchors["label"].to_numpy()
    owner, top, least = (queries[c].to_numpy() for c in ("owner", "top", "least"))
    high, low = np.full(len(anchors), np.iinfo(np.int64).min), np.full(len(anchors), np.iinfo(np.int64).max)
    np.maximum.at(high, owner, top)
    np.minimum.at(low, owner, least)
    for lab in np.unique(own_label):
        cand = np.flatnonzero((label == lab) == same)
        of_label = np.flatnonzero((own_label == lab) & (low <= high))
        for x in range(0, len(of_label), A_STEP):
            at = of_label[x : x + A_STEP]
            table = tables(own[at])
            asked = np.flatnonzero(np.isin(owner, at))
            place = np.searchsorted(at, owner[asked])
            for y in range(0, len(cand), R_STEP):
                some = cand[y : y + R_STEP]
                s = scores(table, packed[some])
                wanted = (s <= high[at]) & (s >= low[at])
                if same:
                    wanted &= (ids[some][:, None] != own_id[at]) | (th[some][:, None] != own_th[at])
                r, a = np.nonzero(wanted)
                if not len(r):
                    continue
                found, hit = s[r, a], some[r]
                q, p = best(a, found, ids[hit], th[hit], top[asked], least[asked], place, most)
                held.add(asked[q], found[p], ids[hit[p]], th[hit[p]])
    q, s, i, h = held.at
    return pd.DataFrame({"query": q, "id": i, "th": h, "score": s})


def paired(anchors: DataFrame, rows: DataFrame, blocks: int, chunks: int):
    """Blocks of anchors and chunks of rows, both dealt to each combination of them."""
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = anchors.withColumn("block", F.pmod(F.xxhash64("th"), F.lit(blocks)).cast("int")).withColumn("chunk", every(chunks))
    right = rows.withColumn("chunk", F.pmod(F.xxhash64("th"), F.lit(chunks)).cast("int")).withColumn("block", every(blocks))
    return left.groupBy("block", "chunk").cogroup(right.groupBy("block", "chunk"))


def mine(embeddings: DataFrame, *, positives: int = POSITIVES, negatives: int = NEGATIVES, anchors_at_once: int = ANCHORS, rows_at_once: int = ROWS, least_rows: int = LEAST_ROWS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    spark = embeddings.sparkSession
    rows = materialize(valid(embeddings), "negatives-rows")
    shape = rows.agg(F.count("*").alias("n"), F.count(F.when(F.col("vec_id") % EVERY == 0, 1)).alias("anchors"), F.max(F.size("q")).alias("dims"), F.max(F.array_max("q")).alias("high"), F.min(F.array_min("q")).alias("low")).first()
    dims = max(1, shape.dims or 1)
    groups = -(-dims // GROUP)
    bits = 1 + max(int(shape.high or 0).bit_length(), (~int(shape.low or 0)).bit_length() if (shape.low or 0) < 0 else 0)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 4096):
                some = batch.slice(at, 4096)
                q = np.zeros((len(some), groups * GROUP), np.int64)
                lists = some.column(2)
                n = lists.value_lengths().to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(len(some)), n)
                q[row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)] = lists.flatten().to_numpy(zero_copy_only=False)
                held = [x.tobytes() for x in planes(q, bits)]
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), some.column(3), pa.array(held, pa.binary())], names=["vec_id", "label", "th", "planes"])

    packed = materialize(rows.mapInArrow(pack, "vec_id bigint, label bigint, th bigint, planes binary"), "negatives-planes")
    discard(rows)
    n, cores = shape.n, spark.sparkContext.defaultParallelism
    chunks = max(1, -(-n // rows_at_once), min(2 * cores, -(-n // least_rows)))
    blocks = max(1, -(-shape.anchors // anchors_at_once))
    anchors = packed.where(F.col("vec_id") % EVERY == 0)

    def find_positives(mine: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        wide = np.iinfo(np.int64)
        out = meet(mine, others, groups, True, pd.DataFrame({"owner": np.arange(len(mine)), "top": wide.max, "least": wide.min}), positives)
        q = out["query"].to_numpy()
        return pd.DataFrame({"anchor_id": mine["vec_id"].to_numpy()[q], "anchor_th": mine["th"].to_numpy()[q], "positive_id": out["id"], "positive_th": out["th"], "positive_score": out["score"]})

    some = paired(anchors, packed, blocks, chunks).applyInPandas(find_positives, "anchor_id bigint, anchor_th bigint, positive_id bigint, positive_th bigint, positive_score bigint")
    order = Window.partitionBy("anchor_id", "anchor_th").orderBy(F.desc("positive_score"), "positive_id", "positive_th")
    first = some.withColumn("place", F.row_number().over(order)).where(F.col("place") <= positives)
    # At most ``positives`` of each anchor.
    of = first.groupBy(F.col("anchor_id").alias("vec_id"), F.col("anchor_th").alias("th")).agg(F.array_sort(F.collect_list(F.struct("place", "positive_id", "positive_score"))).alias("positives"))
    asking = materialize(anchors.join(of, ["vec_id", "th"]).select("vec_id", "label", "th", "planes", F.col("positives.positive_id").alias("positive_id"), F.col("positives.positive_score").alias("positive_score")), "negatives-anchors")

    def find_negatives(mine: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        count = mine["positive_id"].map(len).to_numpy(np.int64) if len(mine) else np.zeros(0, np.int64)
        owner = np.repeat(np.arange(len(mine)), count)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        ids, s = (np.concatenate([np.zeros(0, np.int64), *mine[c]]).astype(np.int64) for c in ("positive_id", "positive_score"))
        # 80 s <= 100 x <= 100 s, for whole numbers: no such x where s is below 0.
        queries = pd.DataFrame({"owner": owner, "top": s, "least": np.where(s >= 0, s - s // 5, np.iinfo(np.int64).max)})
        out = meet(mine, others, groups, False, queries, negatives)
        q = out["query"].to_numpy()
        return pd.DataFrame({"anchor_id": mine["vec_id"].to_numpy()[owner[q]], "anchor_th": mine["th"].to_numpy()[owner[q]], "place": place[q], "positive_id": ids[q], "positive_score": s[q], "negative_id": out["id"], "negative_th": out["th"], "negative_score": out["score"]})

    met = paired(asking, packed, blocks, chunks).applyInPandas(find_negatives, "anchor_id bigint, anchor_th bigint, place int, positive_id bigint, positive_score bigint, negative_id bigint, negative_th bigint, negative_score bigint")
    order = Window.partitionBy("anchor_id", "anchor_th", "place").orderBy(F.desc("negative_score"), "negative_id", "negative_th")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def query(spark, sf_dir: str) -> DataFrame:
    return mine(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label"))


SQL = """
with q as (
  select distinct vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
         list_transform(embedding, lambda x: floor(256 * x::double)) as q
  from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
  select a.vec_id as anchor_id, r.vec_id, a.label = r.label as same,
         list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * r.q[i]))::bigint as score
  from q a join q r on a.vec_id <> r.vec_id where a.vec_id % 100 = 0),
positives as (
  select anchor_id, vec_id as positive_id, score as positive_score from scored where same
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
select p.anchor_id, p.positive_id, row_number() over (partition by p.anchor_id, p.positive_id order by s.score desc, s.vec_id)::int as rank,
       s.vec_id as negative_id, p.positive_score, s.score as negative_score
from positives p join scored s on s.anchor_id = p.anchor_id and not s.same
  and 80 * p.positive_score <= 100 * s.score and 100 * s.score <= 100 * p.positive_score
qualify rank <= 5
"""
