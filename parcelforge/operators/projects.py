"""Projects: what a run asks for, their tables with and without one of them, runs that fail, overviews."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def checked_run(datasets: DataFrame, project: str, source: str, candidates: list[str]) -> None:
    """Raises where a run can't be made: a dataset that is missing or of another project, too few, or one against itself.

    ``datasets``: (dataset_id, project_id).  Only the datasets named are looked up.
    """
    named = [source, *candidates]
    if len(set(named)) < 2:
        raise ValueError("a run needs two datasets at least")
    if source in candidates:
        raise ValueError("the source is no candidate of its own")
    found = {r.dataset_id: r.project_id for r in datasets.where(F.col("dataset_id").isin(named)).select("dataset_id", "project_id").collect()}
    for d in named:
        if d not in found:
            raise ValueError(f"no such dataset: {d}")
        if found[d] != project:
            raise ValueError(f"a dataset of another project: {d}")


def without_project(tables: dict[str, DataFrame], project: str, column: str = "project_id") -> dict[str, DataFrame]:
    """All tables without the rows of a project: what a deletion leaves to be written."""
    return {name: df.where(~F.col(column).eqNullSafe(F.lit(project))) for name, df in tables.items()}


def without_dataset(datasets: DataFrame, versions: DataFrame, features: DataFrame, dataset: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Datasets, versions and features without those of a dataset."""
    gone = versions.where(F.col("dataset_id") == dataset).select("version_id")
    return datasets.where(F.col("dataset_id") != dataset), versions.where(F.col("dataset_id") != dataset), features.join(gone, "version_id", "left_anti")


def recorded(runs: DataFrame, run_id: str, work: Callable[[], DataFrame], path: str) -> DataFrame:
    """Runs (run_id, status, rows, message) with one more: its rows are written to ``path`` as a whole, or not at all.

    A failure is a row as well, and is not raised.
    """
    spark = runs.sparkSession
    try:
        work().write.mode("errorifexists").parquet(path)  # committed when all its tasks are
        row = (run_id, "completed", spark.read.parquet(path).count(), None)
    except Exception as e:  # whatever the run fails with is what its row says
        row = (run_id, "failed", None, str(e).split("\n")[0][:500])
    return runs.unionByName(spark.createDataFrame([row], "run_id string, status string, rows bigint, message string"))


def overview(**counted: tuple[DataFrame, str]) -> DataFrame:
    """(kind, state, n): for each frame given, how many rows it has in each state of a column."""
    out = None
    for kind, (df, column) in counted.items():
        one = df.groupBy(F.col(column).cast("string").alias("state")).agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "state", "n")
        out = one if out is None else out.unionByName(one)
    return out


def latest_features(features: DataFrame, versions: DataFrame) -> DataFrame:
    """Features (version_id) of the last version of each dataset (dataset_id, version_id, version_number)."""
    last = versions.groupBy("dataset_id").agg(F.max_by("version_id", F.struct("version_number", "version_id")).alias("version_id"))
    return features.join(last, "version_id")
