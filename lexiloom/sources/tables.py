"""Parquet tables of one folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Bytes of input for each partition of an explicit exchange, and the most partitions.
TASK_BYTES, MAX_TASKS = 128 << 20, 200_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table ``name`` of ``folder``; Catalyst prunes its columns and pushes its filters."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tasks(df: DataFrame) -> int:
    """Partitions for an explicit exchange of ``df``, which adaptive execution can't add to: one for each ``TASK_BYTES``
    of what the planner expects, at least the session's setting and one for each core. Meant for scans with filters and
    projections: of a join the planner expects too much."""
    spark = df.sparkSession
    least = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    expected = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    # a table without known size, as a checkpoint, counts as endless
    return least if expected >= 1 << 62 else max(least, min(MAX_TASKS, -(-expected // TASK_BYTES)))
