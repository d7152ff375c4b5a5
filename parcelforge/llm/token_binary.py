"""Token ids in a byte-aligned binary format, written in document order and read back.

Ids are ranked by their frequency over the whole corpus (rank 0: the most frequent, ties by the smaller id), so that
frequent ids take one byte.  Four ranks share a control byte that stands apart from the data bytes: two bits each
give the length, 1 to 4.  Decoding looks lengths up by control byte and gathers the data bytes with numpy.

A file is a sequence of blocks, each ended by a line feed::

    magic "PFTOK1" | vocabulary size u32 | documents u32 | ids u64 | control bytes u64 | data bytes u64
    rank table: id of each rank, u32 x vocabulary size
    doc_id i64 x documents | ids of each document u64 x documents | control bytes | data bytes | 0x0A

All numbers are little-endian.  Files are written by Spark's own writer, so they go to whatever store the shared
folder is in, appear only when their task has been committed, and survive lost executors.  Texts are encoded once;
their ids are kept, compressed, until they have been counted and written by rank.

Defined results: a null or empty text has the end id alone; documents without id come first; documents of one id
follow each other by a hash of their texts; an empty table gives no files' rows; the result's columns are named here,
so extra columns cannot clash.
"""

from __future__ import annotations

import os
import struct
import zlib
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from parcelforge.llm.common import discard, materialize, new_path, quoted

MAGIC = b"PFTOK1"
_HEAD = struct.Struct("<6sIIQQQ")
#: A file holds about this many bytes of documents at most (or one document).
BLOCK_BYTES = 16 << 20
#: Texts are encoded in groups of about this many bytes.
GROUP_BYTES = 6 << 20
#: The known pieces that a worker keeps; it starts anew beyond that.
MAX_KNOWN = 300_000
#: Fixed value: how byte-level vocabularies spell a space.
SPACE = "\u0120"
#: A table of a whole vocabulary goes to the driver and to each executor; this bounds it.
MAX_VOCABULARY = 1 << 22

#: Lengths of the four ranks of each control byte.
LENGTHS = np.array([[(c >> 2 * k & 3) + 1 for k in range(4)] for c in range(256)], np.uint8)

# ------------------------------------------------------------------ encoding


class Encoder:
    """Texts to ids with the tokenizers library, as little-endian u32 bytes; parts met before are not encoded anew.

    The byte-level pre-tokeniser never joins what stands before a space with what stands after it, as long as the
    space is not next to other white space; so the parts between such spaces are encoded by themselves and kept.
    A part is cut by the pre-tokeniser's pattern, and each piece goes to the library's model.  Texts of other
    characters than those the pattern's classes are sure about, those that hold an added token, and all texts of
    other kinds of tokenizers go to the library whole.
    """

    #: What the fast way can't treat: white space next to a space, and other characters than these.
    _ODD = r"  |\n | \n|[^\x01-\x08\x0e-\x1b\x21-\x7e \n\x{a1}-\x{24f}]"
    #: Fixed value: the byte-level pattern.
    _PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, tokenizer_json: str) -> None:
        # A worker has one core; the library's threads would only wait for each other.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.model = self.tokenizer.model
        self.parts: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}  # what was known before the last time that ``parts`` was full
        self.cut = regex.compile(self._PATTERN).findall
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        said = repr(self.tokenizer.pre_tokenizer)
        self.by_space = type(self.tokenizer.pre_tokenizer).__name__ == "ByteLevel" and "add_prefix_space=False" in said and "use_regex=True" in said and self.tokenizer.normalizer is None and self.tokenizer.post_processor is None
        # A byte's character: itself where it is printable Latin-1, otherwise the next one from U+0100 on.
        plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
        others = [b for b in range(256) if b not in plain]
        byte = {b: chr(b) for b in plain} | {b: chr(0x100 + k) for k, b in enumerate(others)}
        # Of each character that the fast way takes, its bytes as the model's vocabulary spells them.
        self.shown = {chr(c): "".join(byte[b] for b in chr(c).encode()) for c in range(0x250)}.__getitem__
        self.packed = [struct.pack("<I", k) for k in range(self.tokenizer.get_vocab_size(with_added_tokens=True))]

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _piece(self, piece: str) -> bytes:
        """The ids of what the pattern doesn't cut."""
        packed = self.packed
        if piece.isascii() and piece[1:].isalpha() and (piece[0] == " " or piece[0].isalpha()):
            return b"".join([packed[t.id] for t in self.model.tokenize(piece.replace(" ", SPACE))])
        return b"".join([packed[t.id] for t in self.model.tokenize("".join(map(self.shown, piece)))])

    def _part(self, part: str) -> bytes:
        # One word, perhaps with a mark behind it, needs no pattern: it has nothing to cut but that mark.
        if part[1:].isalpha() and part[0] == " ":
            return self._piece(part)
        pieces = [part[:-1], part[-1]] if part[1:-1].isalpha() and part[0] == " " and part[-1] in ",.;:!?" else self.cut(part)
        if len(pieces) == 1:
            return self._piece(part)
        known, older, out = self.parts, self.older, []
        for p in pieces:
            ids = known.get(p)
            if ids is None:
                ids = older.get(p)
                known[p] = ids = self._piece(p) if ids is None else ids
            out.append(ids)
        return b"".join(out)

    def _known(self, parts: list[str]) -> list[bytes]:
        if len(self.parts) > MAX_KNOWN:
            self.older, self.parts = self.parts, {}
        known, older = self.parts, self.older
        ids = list(map(known.get, parts))
        part, was, packed, tokens = self._part, older.get, self.packed, self.model.tokenize
        for j in [j for j, got in enumerate(ids) if got is None]:
            p = parts[j]
            got = was(p)
            if got is None:
                # A word of ASCII letters is spelt by itself, with the model's sign for the space before it.
                got = b"".join([packed[t.id] for t in tokens(SPACE + p[1:])]) if p[:1] == " " and p[1:].isalpha() and p.isascii() else part(p)
            known[p] = ids[j] = got
        return ids

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one text after the other, and how many each has.

        Equal parts of these texts are looked up once; what is left is gathered by numpy.
        """
        odd = pc.match_substring_regex(texts, self._ODD) if self.by_space else pa.array([True] * len(texts))
        for t in self.added:
            odd = pc.or_(odd, pc.match_substring(texts, t))
        odd = odd.to_numpy(zero_copy_only=False)
        whole = self._library(texts.filter(pa.array(odd)).to_pylist())
        # Each part with the space before it; an empty first part has no ids.  Odd texts are one part, put in below.
        split = pc.split_pattern(pc.replace_substring(pc.if_else(pa.array(odd), "", texts), " ", "\0 "), "\0")
        coded = split.flatten().dictionary_encode()
        parts = self._known(coded.dictionary.to_pylist())
        first = len(parts)
        index = coded.indices.to_numpy(zero_copy_only=False).copy()
        ends = np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False))
        index[ends[odd] - 1] = first + np.arange(len(whole))
        every = pa.array(parts + whole, pa.large_binary()).take(pa.array(index))
        _, offsets, data = every.buffers()
        upto = np.frombuffer(offsets, "<i8", len(every) + 1, 8 * every.offset) // 4
        ids = np.frombuffer(data, "<u4", upto[-1] - upto[0], 4 * upto[0]) if upto[-1] > upto[0] else np.zeros(0, "<u4")
        return ids, np.diff(upto[ends] - upto[0], prepend=0)


_encoders: dict[int, Encoder] = {}


def encoder(tokenizer_json: str) -> Encoder:
    """One for each worker process and tokenizer."""
    key = zlib.crc32(tokenizer_json.encode())
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(tokenizer_json)
    return _encoders[key]


def _texts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(doc_id, tie, text); tie: a hash of the text that a double holds exactly."""
    own = F.coalesce(quoted(text).cast("string"), F.lit(""))
    return docs.select(F.coalesce(quoted(key).cast("bigint"), F.lit(NO_ID)).alias("doc_id"), F.shiftrightunsigned(F.xxhash64(own), 11).alias("tie"), own.alias("text"))


def encoded(texts: DataFrame, tokenizer_json, size: int, end_id: int) -> DataFrame:
    """(docs, ties, sizes, ids, met, times): a row for some documents: their ids with the end id, compressed, and the
    different ids with how often each occurs."""
    kind = "<u2" if size <= 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        code, press = encoder(tokenizer_json.value), zstandard.ZstdCompressor(level=1)
        for batch in batches:
            lengths = pc.binary_length(batch.column(2)).to_numpy(zero_copy_only=False)
            group = (np.cumsum(lengths) - lengths) // GROUP_BYTES
            cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(batch)]
            for low, high in zip(cuts, cuts[1:]):
                if low == high:
                    continue
                some = batch.slice(low, high - low)
                docs, ties = (some.column(k).to_numpy(zero_copy_only=False).astype("<i8") for k in range(2))
                ids, sizes = code.encode(some.column(2))
                ids = np.insert(ids, np.cumsum(sizes), end_id).astype(kind)
                times = np.bincount(ids, minlength=size)
                met = np.flatnonzero(times)
                blobs = docs.tobytes(), ties.tobytes(), (sizes + 1).astype("<i8").tobytes(), press.compress(ids.tobytes()), met.astype("<i4").tobytes(), times[met].astype("<i8").tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in blobs], names=["docs", "ties", "sizes", "ids", "met", "times"])

    return texts.mapInArrow(run, "docs binary, ties binary, sizes binary, ids binary, met binary, times binary")


def _ids(x: bytes, size: int) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.decompress(x), "<u2" if size <= 1 << 16 else "<u4")


def count_ids(coded: DataFrame, size: int) -> np.ndarray:
    """How often each id occurs over all documents, end ids included: at most ``size`` numbers reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size, np.int64)
        for batch in batches:
            for met, times in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts[np.frombuffer(met, "<i4")] += np.frombuffer(times, "<i8")
        met = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(counts[met])], names=["id", "n"])

    rows = coded.select("met", "times").mapInArrow(run, "id int, n bigint").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(size, np.int64)
    counts[rows["id"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return counts


def padded(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each id stands when every document's ids are filled up to a multiple of four, and where documents end."""
    wide = -(-counts // 4) * 4
    ends = np.cumsum(wide)
    shift = ends - wide - (np.cumsum(counts) - counts)
    return np.arange(int(counts.sum())) + np.repeat(shift, counts), ends


def pack(ranks: np.ndarray, counts: np.ndarray) -> tuple[list[bytes], list[bytes]]:
    """Control bytes and data bytes of each document; its last control byte is filled up with zero bits."""
    ranks = np.ascontiguousarray(ranks, "<u4")
    extra = (ranks > 0xFF).astype(np.uint8)
    extra += ranks > 0xFFFF
    extra += ranks > 0xFFFFFF
    at, ends = padded(counts)
    codes = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    codes[at] = extra
    control = (codes.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8).tobytes()
    width = int(extra.max(initial=0)) + 1
    data = ranks.view(np.uint8).reshape(-1, 4)[:, :width][np.arange(width) <= extra[:, None]].tobytes()
    upto = np.cumsum(extra, dtype=np.int64)[np.cumsum(counts) - 1] + np.cumsum(counts)
    return _cut(control, ends // 4), _cut(data, upto)


def _cut(data: bytes, ends: np.ndarray) -> list[bytes]:
    ends = ends.tolist()
    return [data[a:b] for a, b in zip([0, *ends], ends)]


def unpack(control: bytes, data: bytes, counts: np.ndarray) -> np.ndarray:
    """The ranks of documents of :func:`pack`: lengths by table lookup, values by gathering bytes."""
    size = LENGTHS[np.frombuffer(control, np.uint8)].ravel()[padded(counts)[0]]
    starts = np.cumsum(size, dtype=np.int64) - size
    raw = np.frombuffer(data, np.uint8)
    out = raw[starts].astype(np.uint32)
    for k in range(1, 4):
        more = np.flatnonzero(size > k)
        if len(more):
            out[more] |= raw[starts[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


# ------------------------------------------------------------------ files


def block(ids_of_rank: np.ndarray, docs: list[int], counts: list[int], control: list[bytes], data: list[bytes]) -> bytes:
    """A block of documents; each one's control bytes start anew."""
    head = _HEAD.pack(MAGIC, len(ids_of_rank), len(docs), sum(counts), sum(map(len, control)), sum(map(len, data)))
    return b"".join([head, ids_of_rank.astype("<u4").tobytes(), np.array(docs, "<i8").tobytes(), np.array(counts, "<u8").tobytes(), *control, *data, b"\n"])


def blocks(content: bytes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(doc_ids, ids of each document, all ids) of the blocks of a file."""
    at = 0
    while at < len(content):
        magic, size, n_docs, n_ids, n_control, n_data = _HEAD.unpack_from(content, at)
        if magic != MAGIC:
            raise ValueError("not a token file")
        at += _HEAD.size
        table = np.frombuffer(content, "<u4", size, at)
        docs = np.frombuffer(content, "<i8", n_docs, at := at + 4 * size)
        counts = np.frombuffer(content, "<u8", n_docs, at := at + 8 * n_docs).astype(np.int64)
        control = content[(at := at + 8 * n_docs) : at + n_control]
        data = content[(at := at + n_control) : at + n_data]
        at += n_data + 1
        yield docs, counts, table[unpack(control, data, counts)]


#: Stands for a null doc_id in files.
NO_ID = -(1 << 63)


def ranges(texts: DataFrame, parts: int) -> list[tuple[int, int]]:
    """Where to cut (doc_id, tie) into about equal numbers of documents, from ids and hashes alone.

    An id that is met by several cuts is cut by its texts' hashes; a text that is met by several has as many equal cuts.
    """
    if parts < 2:
        return []
    share = lambda k: [i / k for i in range(1, k)]
    ids = texts.select(F.percentile_approx("doc_id", share(parts), 100 * parts)).first()[0] or []
    met = Counter(ids)
    cuts = [(i, -1) for i in met]
    hot = {i: n + 1 for i, n in met.items() if n > 1}
    if hot:
        # At most as many rows as there are cuts.
        of = texts.where(F.col("doc_id").isin(list(hot))).groupBy("doc_id").agg(F.percentile_approx("tie", share(parts), 100 * parts).alias("ties"))
        for r in of.collect():
            n = hot[r.doc_id]
            cuts += [(r.doc_id, r.ties[i * (parts - 1) // n]) for i in range(1, n)]
    return sorted(cuts)


def write(docs: DataFrame, path: str, tokenizer_json: str, key: str = "doc_id", text: str = "text", end_id: int = 0) -> None:
    """Writes the ids of all documents, each followed by ``end_id``, to files in ascending order of ``key``."""
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    size = Tokenizer.from_str(tokenizer_json).get_vocab_size(with_added_tokens=True)
    if size > MAX_VOCABULARY:
        raise ValueError(f"more than {MAX_VOCABULARY} ids")
    shipped = spark.sparkContext.broadcast(tokenizer_json)
    texts = _texts(docs, key, text)
    made = materialize(encoded(texts, shipped, size, end_id), "token-ids")
    counts = count_ids(made, size)
    order = np.argsort(-counts, kind="stable").astype(np.uint32)
    rank = np.empty(size, np.uint32)
    rank[order] = np.arange(size, dtype=np.uint32)
    tables = spark.sparkContext.broadcast((order, rank))

    cuts = ranges(texts, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cut_ids = np.array([c[0] for c in cuts], np.int64)

    def rank_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, turn = tables.value[1], 0
        for batch in batches:
            for docs, ties, sizes, ids in zip(*(c.to_pylist() for c in batch.columns)):
                doc_ids, tie, counts = (np.frombuffer(x, "<i8") for x in (docs, ties, sizes))
                control, data = pack(ranks[_ids(ids, size)], counts)
                low, parts = (np.searchsorted(cut_ids, doc_ids, side) for side in ("left", "right"))
                for k in np.flatnonzero(parts - low > 1).tolist():  # of an id that is met by several cuts
                    at = int(doc_ids[k]), int(tie[k])
                    first, last = bisect_left(cuts, at), bisect_right(cuts, at)
                    # Equal cuts: documents of one id and text, which take turns.
                    parts[k] = last if last - first < 2 else first + 1 + turn % (last - first)
                    turn += 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(parts.astype(np.int32)), pa.array(doc_ids), pa.array(tie), pa.array(counts), pa.array(control, pa.binary()), pa.array(data, pa.binary())],
                    names=["part", "doc_id", "tie", "n", "control", "data"],
                )

    coded = made.select("docs", "ties", "sizes", "ids").mapInArrow(rank_all, "part int, doc_id bigint, tie bigint, n bigint, control binary, data binary")
    dealt = coded.repartitionById(len(cuts) + 1, F.col("part")).sortWithinPartitions("doc_id", "tie", "n", "control", "data")

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[], [], [], []]
        weight, (order, _) = 0, tables.value

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([block(order, *held)], pa.binary())], names=["block"])

        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in (1, 3, 4, 5))):
                for to, x in zip(held, row):
                    to.append(x)
                weight += len(row[2]) + len(row[3]) + 16
                if weight >= BLOCK_BYTES:
                    yield out()
                    held, weight = [[], [], [], []], 0
        if held[0]:
            yield out()

    # The text writer ends each row with the line feed that ends a block; a file holds one block.
    rows = dealt.mapInArrow(assemble, "block binary").select(F.expr("substring(block, 1, length(block) - 1)").cast("string").alias("value"))
    rows.write.option("maxRecordsPerFile", 1).option("compression", "none").text(path)
    discard(made)


def read(spark, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 of every document of the files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                begun = 0
                for docs, counts, ids in blocks(content.as_py()):
                    ends = np.cumsum(counts)
                    starts = ends - counts
                    raw = memoryview(ids.astype("<u4").tobytes())
                    crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist())]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * len(docs)), pa.array(docs, mask=docs == NO_ID), pa.array(starts + begun), pa.array(counts), pa.array(crc, pa.int64())],
                        names=["path", "doc_id", "at", "n_tokens", "ids_crc32"],
                    )
                    begun += int(counts.sum())

    found = materialize(files.mapInArrow(decode, "path string, doc_id bigint, at bigint, n_tokens bigint, ids_crc32 bigint"), "token-index")
    # Files are named by partition, then by their place in it, both numbers: two running sums, one within a partition and
    # one over the partitions, of which there are as many as the session has shuffle partitions.
    number = lambda pattern: F.regexp_extract("path", pattern, 1).cast("bigint")
    sums = found.groupBy("path").agg(F.sum("n_tokens").alias("n")).withColumns({"part": number(r"part-(\d+)[^/]*$"), "file": number(r"-c(\d+)\.[^/]*$")})
    earlier = Window.rowsBetween(Window.unboundedPreceding, -1)
    inner = sums.select("path", "part", F.coalesce(F.sum("n").over(_over(earlier, "file", "part")), F.lit(0)).alias("inner"))
    outer = sums.groupBy("part").agg(F.sum("n").alias("n")).select("part", F.coalesce(F.sum("n").over(_over(earlier, "part")), F.lit(0)).alias("outer"))
    ahead = inner.join(outer, "part").select("path", (F.col("inner") + F.col("outer")).alias("before"))
    return found.join(ahead, "path").select("doc_id", (F.col("at") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def _over(rows: WindowSpec, order: str, *by: str) -> WindowSpec:
    return rows.partitionBy(*by).orderBy(order)


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        tokenizer = f.read()
    path = new_path(spark, "tokens")
    write(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, tokenizer)
    return read(spark, path)
