"""Parquet tables by name, and the rules that pick their current rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """Scan ``<directory>/<name>.parquet`` (a file or a folder of files)."""
    return spark.read.parquet(f"{directory}/{name}.parquet")


def latest(df: DataFrame, keys: list[str], at: str, columns: list[str]) -> DataFrame:
    """The row with the greatest ``at`` for each combination of ``keys``.

    One partial and one final aggregation, so a key with many versions is reduced before the
    shuffle. A null ``at`` counts as the earliest; rows with the same ``at`` are told apart by
    the remaining ``columns`` in order, so the result does not depend on the order of the input.
    """
    picked = F.max(F.struct(at, *[c for c in columns if c != at])).alias("_latest")
    return df.groupBy(*keys).agg(picked).select(*keys, *[F.col("_latest")[c].alias(c) for c in columns])


def file_tasks(files: DataFrame) -> DataFrame:
    """``file_id, task_id``: each file once, from the repeated rows of a files table."""
    return files.where("id IS NOT NULL").groupBy(F.col("id").alias("file_id")).agg(F.max("task_id").alias("task_id"))
