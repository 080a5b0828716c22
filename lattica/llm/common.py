"""Helpers shared by the training-data operators: reading tables, cutting lineage, packing Arrow columns."""

from __future__ import annotations

import gc
import itertools
import tempfile
import time
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: list[str] = []
_COUNT = itertools.count()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` below ``sf_dir`` (any path Spark can read)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or a temporary one where that is unset (local tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="lattica-"))
    return _LOCAL[0]


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: cuts lineage, and survives the loss of any executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{next(_COUNT)}-{uuid.uuid4().hex[:8]}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.shared_path = path
    return out


def broadcast_if_small(df: DataFrame, rows: int = 500_000) -> DataFrame:
    """``df`` marked for broadcast if it was counted to have at most ``rows`` (narrow) rows; else as it is, to be shuffled."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def forget(*frames: DataFrame) -> None:
    """Delete tables made by :func:`written` once nothing reads them any more; frees disk between iterations."""
    for df in frames:
        path = getattr(df, "shared_path", None)
        if path:
            jvm = df.sparkSession._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def release(spark: SparkSession) -> None:
    """Let the shuffle files of finished steps go now: Spark deletes them once the driver has collected what refers to them.

    The first round drops Python's references, the second what they kept alive in the JVM."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.4)


def fold(column, modulus: int):
    """crc32 of the id as text, modulo ``modulus``."""
    return F.crc32(column.cast("string").cast("binary")) % F.lit(modulus)


def list_array(values: np.ndarray, lengths, kind: pa.DataType) -> pa.ListArray:
    """An Arrow list column from the values of all rows and each row's length."""
    offsets = np.zeros(len(lengths) + 1, dtype=np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))
