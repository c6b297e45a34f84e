"""Tables kept in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeworks.session import ensure_checkpoint_dir


def folder(spark: SparkSession, name: str) -> str:
    """A new path under ``spark.checkpoint.dir``."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once and read again: later steps neither repeat its work nor depend on the executors that did it."""
    path = folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, *texts: str, max_bytes: int = 32 << 20) -> DataFrame:
    """A stored side of a join, marked for broadcast if it is at most ``max_bytes``; a larger one takes a shuffle join."""
    width = 40 + 8 * len(df.columns) + sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in texts), F.lit(0))
    size = df.agg(F.sum(width.cast("long"))).first()[0] or 0
    return F.broadcast(df) if size <= max_bytes else df
