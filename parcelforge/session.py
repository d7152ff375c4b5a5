"""Session defaults: UTC, adaptive execution, last-wins map keys."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # The JVM does not compile methods above this size of code: such a stage is better run operator by operator.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # Column expressions are many here; the place of each need not be looked up while it is made.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in the folder that all executors share: ``spark.checkpoint.dir`` of the session.

    Only where it is unset on a local master (tests) a temporary folder is chosen and set.
    """
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not at:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="parcelforge-shared-"))
        at = sc.getCheckpointDir()
    return f"{at.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read again: a cut of the lineage that survives lost executors."""
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def session(app: str = "parcelforge", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    for k, v in (CONF | conf).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
