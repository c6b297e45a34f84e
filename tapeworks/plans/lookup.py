"""Joins to dimension tables whose size is measured before they are broadcast."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeworks.session import ensure_checkpoint_dir

BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 32 << 20
ROW_BYTES = 40  # what a hashed row takes besides its fields


def lookup(df: DataFrame, dim: DataFrame, on: Sequence[str], how: str = "left",
           max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Join ``dim`` to ``df``.  The dimension is computed once and measured.

    Up to ``max_rows`` and ``BROADCAST_BYTES`` it is broadcast, so the fact table is not moved;
    a larger one takes a plain shuffle join, where AQE splits hot keys.
    """
    ensure_checkpoint_dir(df.sparkSession)
    frozen = dim.checkpoint(eager=True)
    small = measured(frozen, max_rows)
    return df.join(F.broadcast(frozen) if small else frozen, list(on), how)


def measured(frozen: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """Whether a table fits a broadcast, by its rows and the bytes of its fields."""
    width = F.lit(ROW_BYTES)
    for f in frozen.schema.fields:
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            width = width + 16 + F.coalesce(F.octet_length(f.name), F.lit(0))
        elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            width = width + 16 + F.coalesce(F.octet_length(F.to_json(F.struct(f.name))), F.lit(0))
        else:
            width = width + 8
    size = frozen.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(width.cast("long")), F.lit(0)).alias("bytes")).first()
    return size["rows"] <= max_rows and size["bytes"] <= BROADCAST_BYTES
