"""Cutting lineage: tables written to the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: list[str] = []


def folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a temporary folder where it is unset and all runs on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="lattica-scratch-"))
    return _LOCAL[0]


def cut(df: DataFrame, name: str = "step") -> DataFrame:
    """``df`` written as a table and read again. Loops use this to keep plans short and to survive lost executors."""
    path = f"{folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def drop(*frames: DataFrame) -> None:
    """Remove tables made by :func:`cut` that nothing reads any more."""
    for df in frames:
        if path := getattr(df, "scratch_path", None):
            where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def small(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """``df`` for broadcast if it was counted to have few rows; otherwise as it is, so that the join is shuffled."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


PER_TASK = 8 << 20
UNKNOWN = 1 << 60


def task_count(df: DataFrame) -> int:
    """Tasks for the rows of ``df``: one for each PER_TASK bytes of the tables it reads, so that a task's share is as large at any size."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    size = sum(x for x in sizes if x < UNKNOWN)
    few = min(df.sparkSession.sparkContext.defaultParallelism, -(-size // (PER_TASK // 16)))
    return max(1, few, min(20_000, -(-size // PER_TASK)))


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` over as many tasks as its rows take: what a task holds does not grow with the input.

    Adaptive execution merges partitions up to a size in compressed bytes, which sorts and hash tables unfold to ten times as much; it leaves these."""
    return df.repartition(task_count(df), *keys)
