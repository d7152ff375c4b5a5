"""SimHash near-duplicates by anchor points of a covering code.

Fingerprints of 64 bits link where at most ``max_distance`` bits differ.  One of the two halves then differs in at
most half as many bits, so each half is searched by itself.  In a half, 31 bits carry the perfect Hamming code
[31, 26] (covering radius 1; the 32nd bit is left out, which never makes a distance larger).  A fingerprint is
replicated to every code word within the covering radius plus the threshold, and fingerprints are compared per code
word.  The threshold is counted from the midpoint of a pair, ceil(t / 2): the code word that covers the midpoint is
within 1 + ceil(t / 2) of both ends.  For 4 bits that is at most 16 anchors in each half.

Equal fingerprints are merged before anything is replicated.  Within an anchor, components are found by a search
that compares each fingerprint with those not yet reached, so that a dense group costs little more than its size and
no pairs are emitted: one link to the smallest member stands for all.  Anchors of more than ``SPLIT`` fingerprints
are first split by equal parts of the other half (of ``max_distance`` + 1 parts one is equal in every linked pair).

Defined results: a null or empty text has the fingerprint zero, which links like any other; a document without id
gets its fingerprint, no component, and links nothing; repeated rows are returned one by one; the columns of the
result are named here, so that no extra column of the input can clash.  No join broadcasts a side that grows with the
input.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelforge.llm.common import among, materialize, pieces, quoted
from parcelforge.llm.components import components

SEED = 42
SPLIT = 2048
#: For a byte, eight lanes of eight bits that hold its bits.
_LANES = np.array([sum(((b >> k) & 1) << (8 * k) for k in range(8)) for b in range(256)], np.uint64)
#: XOR of the positions (1 to 31) of the bits set in a byte at offset 0, 8, 16, 24: the syndrome of a 31-bit word.
_SYNDROME = np.array([[np.bitwise_xor.reduce([0] + [8 * o + k + 1 for k in range(8) if b >> k & 1]) for b in range(256)] for o in range(4)], np.uint8)


def shingle_hashes(data: bytes, size: int) -> Iterator[np.ndarray]:
    """XXH64 of the word shingles of a UTF-8 text, a piece of the text at a time."""
    carried: list[bytes] = []
    total = 0
    for piece in pieces(data):
        words = carried + piece.lower().split()  # bytes.lower() changes A-Z only
        count = len(words) - size + 1
        if count > 0:
            total += count
            runs = map(b" ".join, zip(*(words[k:] for k in range(size))))
            yield np.fromiter((xxhash.xxh64_intdigest(r, SEED) for r in runs), np.uint64, count)
            carried = words[count:]
        else:
            carried = words
    if not total and carried:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(carried), SEED)], np.uint64)


def bit_counts(h: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of the 64 bits set."""
    spread = _LANES[h.view(np.uint8).reshape(-1, 8)]
    sums = np.add.reduceat(spread, np.arange(0, len(h), 255), axis=0)  # no lane passes 255
    return sums.view(np.uint8).reshape(len(sums), 64).sum(axis=0, dtype=np.int64)


_WEIGHTS = np.uint64(1) << np.arange(64, dtype=np.uint64)


def fingerprint(data: bytes | None, size: int = 4) -> int:
    counts, n = np.zeros(64, np.int64), 0
    for h in shingle_hashes(data or b"", size):
        counts += bit_counts(h)
        n += len(h)
    return int(_WEIGHTS[2 * counts > n].sum()) if n else 0


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 4) -> DataFrame:
    """(doc_id, fp) of every row; fp: the fingerprint's 64 bits as a bigint."""
    narrow = docs.select(quoted(key).cast("bigint").alias("doc_id"), quoted(text).cast("string").cast("binary").alias("data"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(x.as_py(), size) for x in batch.column(1)), np.uint64, len(batch))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return narrow.mapInArrow(run, "doc_id bigint, fp bigint")


def anchor_masks(radius: int) -> list[np.ndarray]:
    """By syndrome: all 31-bit error words of at most ``radius`` bits, that is, the ways to the code words near."""
    masks: list[list[int]] = [[] for _ in range(32)]
    for k in range(radius + 1):
        for positions in combinations(range(1, 32), k):
            masks[int(np.bitwise_xor.reduce([0, *positions]))].append(sum(1 << (p - 1) for p in positions))
    return [np.array(m, np.int64) for m in masks]


def anchors(words: np.ndarray, masks: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(row, code word) for each 31-bit word and each code word within reach."""
    parts = words.astype("<u4").view(np.uint8).reshape(-1, 4)
    syndrome = np.bitwise_xor.reduce([_SYNDROME[o][parts[:, o]] for o in range(4)])
    rows, codes = [], []
    for s in range(32):
        at = np.flatnonzero(syndrome == s)
        rows.append(np.repeat(at, len(masks[s])))
        codes.append((words[at].astype(np.int64)[:, None] ^ masks[s]).ravel())
    return np.concatenate(rows), np.concatenate(codes)


def replicate(fps: DataFrame, max_distance: int) -> DataFrame:
    """(anchor, fp): each fingerprint at every anchor of its two halves."""
    masks = anchor_masks(1 + -(-(max_distance // 2) // 2))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = batch.column(0).to_numpy(zero_copy_only=False)
            for k in range(0, len(every), 4096):
                fp = every[k : k + 4096]
                bits = fp.view(np.uint64)
                for half, word in enumerate((bits & np.uint64(0x7FFFFFFF), bits >> np.uint64(32) & np.uint64(0x7FFFFFFF))):
                    rows, codes = anchors(word, masks)
                    yield pa.RecordBatch.from_arrays([pa.array(codes | half << 32), pa.array(fp[rows])], names=["anchor", "fp"])

    return fps.select("fp").mapInArrow(run, "anchor bigint, fp bigint")


def reach(fp: np.ndarray, max_distance: int) -> list[tuple[int, int]]:
    """Links (member, smallest member) of the components of some fingerprints, all different."""
    links, rest = [], np.sort(fp)
    while len(rest) > 1:
        group, queue, rest = rest[0], [rest[0]], rest[1:]
        while queue and len(rest):
            near = np.bitwise_count((rest ^ queue.pop()).view(np.uint64)) <= max_distance
            if near.any():
                found = rest[near]
                links += [(int(x), int(group)) for x in found]
                queue += list(found)
                rest = rest[~near]
    return links


def links_of(fp: np.ndarray, half: int, max_distance: int) -> list[tuple[int, int]]:
    """Links of one anchor; a large one is split by equal parts of the other half, which loses no link."""
    if len(fp) <= SPLIT:
        return reach(fp, max_distance)
    other = fp.view(np.uint64) >> np.uint64(0 if half else 32) & np.uint64(0xFFFFFFFF)
    cuts = np.linspace(0, 32, max_distance + 2).astype(int)
    links = []
    for low, high in zip(cuts, cuts[1:]):
        part = other >> np.uint64(low) & np.uint64((1 << int(high - low)) - 1)
        order = np.argsort(part, kind="stable")
        for group in np.split(fp[order], np.flatnonzero(np.diff(part[order])) + 1):
            links += reach(group, max_distance)
    return list(dict.fromkeys(links))


def link(replicas: DataFrame, max_distance: int) -> DataFrame:
    """(u, v): fingerprints and the smallest of their component, for each anchor."""
    dealt = replicas.repartition("anchor").sortWithinPartitions("anchor", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # of the anchor that the last batch ended with
        at = None

        def done() -> list[tuple[int, int]]:
            group = np.concatenate(held) if held else np.zeros(0, np.int64)
            return links_of(group, int(at) >> 32 & 1, max_distance) if len(group) > 1 else []

        for batch in batches:
            anchor, fp = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(2))
            if not len(fp):
                continue
            edges = np.flatnonzero(np.diff(anchor)) + 1
            starts, ends = np.r_[0, edges], np.r_[edges, len(fp)]
            out: list[tuple[int, int]] = []
            last = len(starts) - 1
            for k in np.flatnonzero((ends - starts > 1) | (np.arange(len(starts)) == 0) | (np.arange(len(starts)) == last)):
                part = fp[starts[k] : ends[k]]
                if anchor[starts[k]] == at:
                    held.append(part)
                    if k < last:
                        out += done()
                        held, at = [], None
                    continue
                out += done()
                held, at = [], None
                if k == last:
                    held, at = [part], anchor[starts[k]]
                elif len(part) > 1:
                    out += links_of(part, int(anchor[starts[k]]) >> 32 & 1, max_distance)
            pairs = np.array(out, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["u", "v"])
        pairs = np.array(done(), np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["u", "v"])

    return dealt.mapInArrow(run, "u bigint, v bigint")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 4, max_distance: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row; component_id: the smallest doc_id that can be reached."""
    marked = materialize(fingerprints(docs, key, text, size), "simhash-docs")
    # One row for each fingerprint, with its smallest document.
    fps = materialize(marked.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-fps", True)
    roots = components(link(replicate(fps, max_distance), max_distance).distinct())
    rooted = materialize(fps.join(roots.withColumnRenamed("node", "fp").hint("merge"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root")), "simhash-roots", True)
    least = materialize(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "simhash-least", True)
    of = materialize(rooted.join(least.hint("merge"), "root").select("fp", "component_id"), "simhash-of", True)
    return marked.join(of.hint("merge"), "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def one_of_each(docs: DataFrame, key: str = "doc_id", also: Callable[[DataFrame], DataFrame] | None = None, **options) -> DataFrame:
    """The rows of ``docs`` whose document is the smallest of its component, or has no id.

    also: gives further links (u, v) of documents, which join components of the fingerprints' ones.
    """
    links = near_duplicates(docs, key, **options).where("doc_id <> component_id").select(F.col("doc_id").alias("u"), F.col("component_id").alias("v"))
    drop = materialize(links.select("u").distinct(), "simhash-gone", True) if also is None else components(links.unionByName(also(docs))).where("node <> root").select("node")
    return among(docs, key, drop, False)


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
