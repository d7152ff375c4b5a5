"""Merging streamed batches into a conflict store (beyond what the batch engine asks for)."""

from __future__ import annotations

from pyspark.sql import DataFrame

from parcelforge.operators.merge import merge


def merge_stream(found: DataFrame, store: str, checkpoint: str, key: str = "idempotency_key"):
    """Starts a query that merges each micro-batch of ``found`` into numbered snapshots under ``store``.

    A batch writes the snapshot of its own number, so that a repeated batch writes the same again.
    """
    spark = found.sparkSession
    columns = found.columns

    def batch(rows: DataFrame, n: int) -> None:
        new = rows.dropDuplicates([key])
        before = spark.read.schema(found.schema).parquet(f"{store}/{n - 1}") if n else new.limit(0)
        merge(before, new, key).select(*columns).write.mode("overwrite").parquet(f"{store}/{n}")

    return found.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
