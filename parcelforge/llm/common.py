"""Shared helpers: tables in the cluster's shared folder, word streams over bytes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that separate words: space and 0x09-0x0D (what ``bytes.split()`` takes as well).
SPACE_BYTES = b" \t\n\x0b\x0c\r"
#: A long text is cut into pieces of about this many bytes, at a space, while it is read.
PIECE_BYTES = 1 << 20
#: The bitmap of ids has 16 bits for each, and at most so many (8 MB); a fuller one costs shuffles only.
MAX_BITS = 1 << 26


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only where it is unset on a local master (tests) a temporary folder is chosen and set.
    """
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not at:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="parcelforge-shared-"))
        at = sc.getCheckpointDir()
    return at.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str, narrow: bool = False) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: a cut of the lineage that survives lost executors.

    narrow: the rows are a few numbers each and cheap to make; one file for each core is written at most, rather than
    one for each shuffle partition.
    """
    spark, path = df.sparkSession, new_path(df.sparkSession, label)
    if narrow:
        df = df.coalesce(spark.sparkContext.defaultParallelism)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._shared_path = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes what :func:`materialize` wrote; nothing may read ``df`` any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._shared_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def quoted(name: str) -> Column:
    """The column of this very name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def among(rows: DataFrame, key: str, ids: DataFrame, there: bool = True) -> DataFrame:
    """The rows whose key (a bigint) is in ``ids``, or those whose key is not; null is in none.

    ids: a stored table of one column.  Neither it nor the rows, which may hold texts, are sent anywhere as a whole: a
    bitmap of bounded size is broadcast, and only the rows within it meet the ids.
    """
    bits = 1 << 20
    while bits < min(16 * ids.count(), MAX_BITS):
        bits *= 2
    bucket, held, given = unused(rows, "pf_bucket", "pf_map", "pf_id")
    named, value = ids.toDF(given), quoted(key).cast("bigint")
    spot = lambda c: F.pmod(F.xxhash64(c), F.lit(bits)) + 1
    bitmap = named.select(F.bitmap_bucket_number(spot(F.col(given))).alias(bucket), F.bitmap_bit_position(spot(F.col(given))).alias(given)).groupBy(bucket).agg(F.bitmap_construct_agg(given).alias(held))
    at = F.bitmap_bit_position(spot(value))
    byte = F.conv(F.hex(F.substring(held, F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    maybe = F.coalesce(value.isNotNull() & (byte.bitwiseAND(F.pow(F.lit(2), at % 8).cast("int")) != 0), F.lit(False))
    marked = rows.withColumn(bucket, F.bitmap_bucket_number(spot(value))).join(F.broadcast(bitmap), bucket, "left").withColumn(held, maybe)
    within, beside = (marked.where(c).select(*map(quoted, rows.columns)) for c in (F.col(held), ~F.col(held)))
    met = within.join(named.hint("merge"), value == F.col(given), "left_semi" if there else "left_anti")
    return met if there else beside.unionByName(met)


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns, made longer until ``df`` has none of them."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def row_hash(df: DataFrame) -> Column:
    """A hash of all columns but maps, which settles ties between rows that are not the same."""
    return F.xxhash64(F.lit(0), *(quoted(f.name) for f in df.schema.fields if "map<" not in f.dataType.simpleString()))


def pieces(data: bytes) -> Iterator[bytes]:
    """``data`` in pieces that end at a space byte, so that no word is cut.

    A word longer than a piece makes its piece longer.
    """
    n, at = len(data), 0
    while n - at > PIECE_BYTES:
        end = at + PIECE_BYTES
        while end < n and data[end] not in SPACE_BYTES:
            end += 1
        yield data[at:end]
        at = end
    yield data[at:]
