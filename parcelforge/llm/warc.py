"""WARC archives: writing records, and reading them by boundary-chain verification.

Writing: a record per page; pages of equal, large enough payloads are written as revisits of the one of the largest
id.  Files are written by Spark's text writer, so they go to whatever store the shared folder is in.  Digests of all
large payloads are grouped first.  A bitmap of those that occur more than once (a bit each, at most ``MAX_BITS``) is
broadcast; a payload outside it stands alone and its record is written as it is read.  Payloads within it are merged
before they are shuffled, so that each task sends a payload once, and revisits are written without payload.

Reading: files are cut at every occurrence of the record magic, whoever wrote it and of whatever version.  Each piece
whose header parses is a candidate record with the offset of its successor.  A candidate is a record only where the
chain of successors that starts at the file's start reaches it; magic inside a payload is never reached.  Within a
split the chain is followed locally; between splits, pointer jumping over the splits' exits finds each split's entry
in about log2 of their number of rounds.  A payload that holds the magic itself is put together again from its pieces.

Defined results: a null payload counts as empty; a page without id is written as a response and never revisited; of
rows with equal large payloads one of the largest id (and then url) is the response, all others are revisits of it,
also where the id is the same; rows of one id with other payloads are records of their own; an empty table gives
empty files.  A file whose chain does not end at its end (a broken header, a truncated record, other text) raises
:class:`ValueError`, unless ``strict`` is off: then its records up to there are returned, without the truncated one.
Missing line feeds behind a file's last record are forgiven.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelforge.llm.common import discard, materialize, new_path, quoted

MAGIC = "WARC/"
_MAGIC = MAGIC.encode()
_VERSION = re.compile(rb"\d+\.\d+\r\n")
#: Records of one file, at most.
RECORDS_PER_FILE = 20_000
TARGET = "urn:page:"
#: The bitmap of repeated payloads has 16 bits for each, and at most so many (32 MB); a fuller one costs shuffles only.
MAX_BITS = 1 << 28

# ------------------------------------------------------------------ writing


def _rows(pages: DataFrame, key: str, url: str, payload: str) -> DataFrame:
    """(page_id, url, body, bytes, digest) of every row; no line break in the url."""
    address = F.coalesce(F.regexp_replace(quoted(url).cast("string"), r"[\r\n]", " "), F.lit(""))
    named = pages.select(quoted(key).cast("bigint").alias("page_id"), address.alias("url"), F.coalesce(quoted(payload).cast("string"), F.lit("")).alias("body"))
    return named.select("*", F.octet_length("body").cast("bigint").alias("bytes"), F.sha1(F.col("body").cast("binary")).alias("digest"))


def _is_large(least: int) -> Column:
    return (F.col("bytes") >= least) & F.col("page_id").isNotNull()


def _shared(large: DataFrame) -> DataFrame:
    """(digest, bytes, last, last_row) of payloads that occur more than once: the id and the row of their response."""
    grouped = large.groupBy("digest", "bytes").agg(F.max(F.struct("page_id", "url", "row")).alias("r"), F.count("*").alias("n"))
    return grouped.where("n > 1").select("digest", "bytes", F.col("r.page_id").alias("last"), F.col("r.row").alias("last_row"))


def _maybe_shared(rows: DataFrame, shared: DataFrame) -> DataFrame:
    """``rows`` with ``maybe``: true for all payloads of ``shared``, and by chance for some others."""
    bits = 1 << 20
    while bits < min(16 * shared.count(), MAX_BITS):
        bits *= 2
    spot = F.pmod(F.xxhash64("digest", "bytes"), F.lit(bits)) + 1
    bitmap = shared.select(F.bitmap_bucket_number(spot).alias("bucket"), F.bitmap_bit_position(spot).alias("bit")).groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("map"))
    at = F.bitmap_bit_position(spot)
    byte = F.conv(F.hex(F.substring("map", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    marked = rows.withColumn("bucket", F.bitmap_bucket_number(spot)).join(F.broadcast(bitmap), "bucket", "left")
    return marked.withColumn("maybe", F.coalesce(byte.bitwiseAND(F.pow(F.lit(2), at % 8).cast("int")) != 0, F.lit(False))).drop("bucket", "map")


def _record(refers_to: Column | None) -> Column:
    """The record of a row as text; the writer adds the last line feed."""
    again, body = refers_to is not None, F.col("body") if refers_to is None else F.lit("")
    revisit = [F.lit(f"\r\nWARC-Refers-To: <{TARGET}"), refers_to.cast("string"), F.lit(">\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")] if again else []
    return F.concat(
        F.lit(f"WARC/1.1\r\nWARC-Type: {'revisit' if again else 'response'}\r\nWARC-Record-ID: <{TARGET}"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">\r\nWARC-Target-URI: "), F.col("url"),
        *revisit, F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("digest"),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r"),
    ).alias("value")


def write(pages: DataFrame, path: str, least: int = 1000, key: str = "page_id", url: str = "url", payload: str = "html") -> None:
    """Writes a record per row.  Header fields and payload are UTF-8; lengths are in bytes."""
    rows = _rows(pages, key, url, payload)
    # Stored, so that a row keeps its number.
    large = materialize(rows.where(_is_large(least)).select("page_id", "url", "digest", "bytes", F.monotonically_increasing_id().alias("row")), "warc-large", True)
    shared = materialize(_shared(large), "warc-shared", True)
    marked = _maybe_shared(rows, shared)
    merge = _is_large(least) & F.col("maybe")
    alone = marked.where(~merge).select(_record(None))
    merged = marked.where(merge).groupBy("digest", "bytes").agg(F.max(F.struct("page_id", "url")).alias("r"), F.first("body").alias("body"))
    first = merged.select("digest", "body", "r.*").select(_record(None))
    # Both sides are stored tables: a payload that a third of the pages share is split by Spark.
    again = large.join(shared.hint("merge"), ["digest", "bytes"]).where("row <> last_row").select(_record(F.col("last")))
    alone.unionByName(first).unionByName(again).write.option("maxRecordsPerFile", RECORDS_PER_FILE).option("compression", "none").text(path)
    discard(large)
    discard(shared)


# ------------------------------------------------------------------ reading


def header(piece: bytes) -> tuple[dict[str, str], int] | None:
    """Fields (lower-case names) and the header's length, of a record from behind its magic."""
    version, end = _VERSION.match(piece), piece.find(b"\r\n\r\n")
    if not version or end < 0:
        return None
    lines: list[bytes] = []
    for line in piece[version.end() : end].split(b"\r\n") if end > version.end() else []:
        if line[:1] in (b" ", b"\t") and lines:  # goes on with the field before
            lines[-1] += b" " + line.strip()
        else:
            lines.append(line)
    fields = {}
    for line in lines:
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        fields[name.strip().lower().decode("utf-8", "replace")] = value.strip().decode("utf-8", "replace")
    return (fields, end + 4) if re.fullmatch("[0-9]{1,18}", fields.get("content-length", "")) else None


_FIELDS = ("warc-type", "warc-record-id", "warc-refers-to", "warc-target-uri", "warc-payload-digest")
_CANDIDATE = "file string, split bigint, file_size bigint, seq bigint, at bigint, size bigint, head bigint, length bigint, type string, record_id string, refers_to string, uri string, digest string, sha1 string"


def _pieces(spark, path: str) -> DataFrame:
    """(file, split, file_size, piece): what stands between occurrences of the magic, in the order of each split."""
    text = spark.read.option("lineSep", MAGIC).text(path).select("*", "_metadata.file_path", "_metadata.file_block_start", "_metadata.file_size")
    return text.select(F.col("file_path").alias("file"), F.col("file_block_start").alias("split"), "file_size", F.col("value").cast("binary").alias("piece"))


def candidates(spark, path: str) -> DataFrame:
    """A row per piece: its place in its split (``at``: bytes of the split's pieces before it), and its header.

    The piece behind the last magic of a split goes on into the next split, as Spark reads it.  sha1 is that of the
    payload where the piece holds all of it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, at, seq = None, 0, 0
        for batch in batches:
            rows = []
            for file, split, total, piece in zip(*(batch.column(k).to_pylist() for k in range(3)), batch.column(3)):
                piece = piece.as_py()
                if (file, split) != now:
                    now, at, seq = (file, split), 0, 0
                found = header(piece)
                if found:
                    fields, size = found
                    length = int(fields["content-length"])
                    whole = size + length <= len(piece)
                    rows.append((file, split, total, seq, at, len(piece), size, length, *(fields.get(f) for f in _FIELDS), hashlib.sha1(piece[size : size + length]).hexdigest() if whole else None))
                else:
                    rows.append((file, split, total, seq, at, len(piece), *(None,) * 8))
                at, seq = at + len(piece) + len(_MAGIC), seq + 1
            columns = list(zip(*rows)) if rows else [[] for _ in range(14)]
            types = [pa.string()] + [pa.int64()] * 7 + [pa.string()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=[f.split(" ")[0] for f in _CANDIDATE.split(", ")])

    return _pieces(spark, path).mapInArrow(run, _CANDIDATE)


def placed(found: DataFrame) -> DataFrame:
    """Adds ``offset``, the byte where each piece's magic begins, and ``successor``, where its record's end is.

    Splits of a file follow each other, so that a split begins where the bytes of those before it end; the first
    piece of a file stands before its first magic and is empty in an archive.
    """
    # As many rows as there are splits; a window holds those of one file.
    sums = found.groupBy("file", "split").agg(F.sum(F.col("size") + len(_MAGIC)).alias("bytes"))
    begin = sums.select("file", "split", F.coalesce(F.sum("bytes").over(Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("begin"))
    out = found.join(begin.hint("merge"), ["file", "split"]).withColumn("offset", F.col("begin") + F.col("at") - len(_MAGIC))
    return out.withColumn("successor", F.col("offset") + len(_MAGIC) + F.col("head") + F.col("length") + 4).drop("begin")


def reachable(cands: DataFrame) -> DataFrame:
    """(file, split, seq) of the candidates that the chain from the file's start reaches.

    ``cands``: stored, with file, split, seq, offset, successor.
    """
    links = cands.where("successor is not null and offset >= 0").select("file", "split", "seq", "offset", "successor")

    def exits(x: pd.DataFrame) -> pd.DataFrame:
        """Of each candidate of a split, the first offset on its chain that no candidate of the split has."""
        x = x.sort_values("offset", ascending=False)
        leave: dict[int, int] = {}
        for offset, successor in zip(x["offset"], x["successor"]):
            leave[offset] = leave.get(successor, successor)
        return pd.DataFrame({"file": x["file"], "split": x["split"], "offset": x["offset"], "leave": [leave[o] for o in x["offset"]]})

    # A group is what one task has read from one split.
    jump = materialize(links.groupBy("file", "split").applyInPandas(exits, "file string, split bigint, offset bigint, leave bigint").drop("split"), "warc-jump", True)
    entries = materialize(jump.where("offset = 0").select("file", "offset"), "warc-entry", True)
    many = entries.count()
    while True:
        # Offsets that are entered, and those that a jump from them enters; then jumps twice as far.
        more = entries.join(jump.hint("merge"), ["file", "offset"]).select("file", F.col("leave").alias("offset"))
        grown = materialize(entries.unionByName(more.join(jump.hint("merge"), ["file", "offset"], "left_semi")).distinct(), "warc-entry", True)
        now = grown.count()
        discard(entries)
        entries = grown
        if now == many:
            discard(jump)
            break
        many = now
        far = jump.select("file", F.col("offset").alias("leave"), F.col("leave").alias("further"))
        further = materialize(jump.join(far.hint("merge"), ["file", "leave"], "left").select("file", "offset", F.coalesce("further", "leave").alias("leave")), "warc-jump", True)
        discard(jump)
        jump = further

    def walk(x: pd.DataFrame) -> pd.DataFrame:
        following = dict(zip(x["offset"], x["successor"]))
        met, todo = set(), x["offset"][x["entered"]].tolist()
        while todo:
            at = todo.pop()
            if at in following and at not in met:
                met.add(at)
                todo.append(following[at])
        return x[x["offset"].isin(met)][["file", "split", "seq"]]

    marked = links.join(entries.withColumn("entered", F.lit(True)).hint("merge"), ["file", "offset"], "left").withColumn("entered", F.coalesce("entered", F.lit(False)))
    return marked.groupBy("file", "split").applyInPandas(walk, "file string, split bigint, seq bigint")


def broken_files(found: DataFrame, records: DataFrame) -> DataFrame:
    """(file, file_size, reached): files whose chain of records does not end where the file does."""
    ends = records.groupBy("file").agg(F.max("successor").alias("reached"))
    sizes = found.groupBy("file").agg(F.max("file_size").alias("file_size"))
    return sizes.join(ends, "file", "left").select("file", "file_size", F.coalesce("reached", F.lit(0)).alias("reached")).where("reached < file_size or reached > file_size + 4")


def read(spark, path: str, strict: bool = True) -> DataFrame:
    """The records of the archives: type, record_id, refers_to, uri, digest (of the header), payload_bytes, sha1; a stored table."""
    found = materialize(placed(candidates(spark, path)), "warc-candidates")
    met = materialize(reachable(found), "warc-reached", True)
    # A stored table is small in its files, as they repeat names, and large in memory: it must not be broadcast.
    records = found.join(met.hint("merge"), ["file", "split", "seq"])
    if strict:
        torn = broken_files(found, records).take(1)
        if torn:
            raise ValueError(f"{torn[0].file}: its chain of records ends at byte {torn[0].reached} of {torn[0].file_size}")
    records = records.where("successor - 4 <= file_size")
    split = materialize(records.where("sha1 is null").select("file", "offset", "head", "length", "successor"), "warc-split", True)
    if not split.isEmpty():
        records = records.join(_mended(spark, path, found, split), ["file", "offset"], "left").withColumn("sha1", F.coalesce("sha1", "mended")).drop("mended")
    out = materialize(records.select("type", "record_id", "refers_to", "uri", "digest", F.col("length").alias("payload_bytes"), "sha1"), "warc-records")
    for x in (found, met, split):
        discard(x)
    return out


def _mended(spark, path: str, found: DataFrame, broken: DataFrame) -> DataFrame:
    """(file, offset, sha1) of records whose payload holds the magic: their pieces are read again and joined."""
    # The last broken record at or before a piece owns it, if it reaches that far.
    marks = found.select("file", "split", "seq", "offset").join(broken.select("file", "offset", "head", "length", "successor"), ["file", "offset"], "left")
    w = Window.partitionBy("file").orderBy("offset")
    last = lambda c: F.last(F.when(F.col("successor").isNotNull(), F.col(c)), ignorenulls=True).over(w)
    owned = marks.select("file", "split", "seq", "offset", last("offset").alias("owner"), last("head").alias("head"), last("length").alias("length"), last("successor").alias("end")).where("offset < end")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, seq = None, 0
        for batch in batches:
            seqs = []
            for key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                now, seq = (key, 0) if key != now else (now, seq + 1)
                seqs.append(seq)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(seqs, pa.int64()), batch.column(3)], names=["file", "split", "seq", "piece"])

    again = _pieces(spark, path).mapInArrow(number, "file string, split bigint, seq bigint, piece binary").join(owned, ["file", "split", "seq"])
    whole = again.groupBy("file", F.col("owner"), "head", "length").agg(F.sort_array(F.collect_list(F.struct("offset", "piece"))).alias("parts"))
    # A record's own pieces, as long as the record; with the magic between them.
    joined = F.reduce("parts", F.lit("").cast("binary"), lambda a, p: F.concat(a, F.when(F.length(a) > 0, F.lit(_MAGIC)).otherwise(F.lit(b"")), p["piece"]))
    payload = F.substring(joined, F.col("head").cast("int") + 1, F.col("length").cast("int"))
    return whole.select("file", F.col("owner").alias("offset"), F.sha1(payload).alias("mended"))


def query(spark, sf_dir: str) -> DataFrame:
    path = new_path(spark, "archives")
    write(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    number = lambda c: F.nullif(F.regexp_extract(c, "^<" + TARGET + "(.*)>$", 1), F.lit("")).cast("bigint")
    records = read(spark, path).select(number("record_id").alias("page_id"), number("refers_to").alias("refers_to"), "type", "digest", "payload_bytes", "sha1")
    done = records.where("type = 'response'").select("page_id", "payload_bytes", F.col("sha1").alias("payload_digest"), F.col("type").alias("record_type"), "refers_to")
    # A revisit has no payload of its own: it is looked up in the response of that id and digest, of which there is one.
    far = records.where("type = 'response'").select(F.col("page_id").alias("refers_to"), "digest", F.col("payload_bytes").alias("far_bytes"), F.col("sha1").alias("far_sha1")).where(F.col("far_bytes") >= 1000)
    again = records.where("type = 'revisit'").drop("payload_bytes", "sha1").join(far.hint("merge"), ["refers_to", "digest"])
    return done.unionByName(again.select("page_id", F.col("far_bytes").alias("payload_bytes"), F.col("far_sha1").alias("payload_digest"), F.col("type").alias("record_type"), "refers_to"))


SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN last END AS refers_to
FROM m
"""
