"""Cutting lineage and checking sizes before a broadcast."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Copies of the smaller side of a join that is too large to be sent to every task.
SALTS = 32


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder that spark.checkpoint.dir names. Only a local session may have none: it gets a
    temporary one. On a cluster that is an error, as its executors don't see each other's folders."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        place = spark.conf.get("spark.checkpoint.dir", None)
        if place is None and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(place or tempfile.mkdtemp(prefix="lexiloom-"))
        _drop_at_exit(spark, sc.getCheckpointDir())
    return sc.getCheckpointDir()


def _drop_at_exit(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)


def scratch(spark: SparkSession) -> str:
    """A new path of this session below the checkpoint folder; what is written there goes when the session ends."""
    path = f"{checkpoint_dir(spark)}/lexiloom-{uuid.uuid4().hex}"
    _drop_at_exit(spark, path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the reliable checkpoint folder, with no lineage behind it; survives lost executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, *by: str) -> DataFrame:
    """As :func:`cut`, as a Parquet table, in folders by the columns ``by``: for tables of any size that are read more than
    once. Readers load only the columns they need, and the planner knows the size."""
    path = scratch(df.sparkSession)
    df.write.partitionBy(*by).option("compression", "zstd").option("parquet.writer.version", "PARQUET_2_0").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded_rows(df: DataFrame, max_rows: int) -> list | None:
    """All rows of ``df`` if there are at most ``max_rows``, else None: the caller then takes its shuffled path."""
    rows = df.limit(max_rows + 1).collect()
    return rows if len(rows) <= max_rows else None


def spread_join(rows: DataFrame, side: DataFrame, on: list[str], max_rows: int, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``side``, a table that is already made.

    If it has at most ``max_rows`` rows (counted) it goes to every task. Else both are shuffled, the rows of one key to
    ``SALTS`` different places and each row of ``side`` to all of them, so no key's rows meet in one task.
    """
    if side.limit(max_rows + 1).count() <= max_rows:
        return rows.join(F.broadcast(side), on, how)
    salt = "lexiloom salt"
    left = rows.withColumn(salt, F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]), F.lit(SALTS)).cast("int"))
    right = side.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.join(right, [*on, salt], how).drop(salt)


def one_row(spark: SparkSession, parts: dict[str, DataFrame | Column]) -> DataFrame:
    """One row of columns and of one-row tables, each table as a struct by a scalar subquery: nothing is joined."""
    columns = [(p if isinstance(p, Column) else p.select(F.struct("*")).scalar()).alias(name) for name, p in parts.items()]
    return spark.range(1).select(*columns)
