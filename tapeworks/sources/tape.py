"""Canonical market views over the event, order and conversation tables.

The views give every operator real input: ``events`` carries unique, ascending
times and serves as the trade tape, one market per ``user_id % 8``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MARKETS = 8
BUY_TYPES = ("purchase", "click", "view")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def micros(c):
    """Microseconds since the epoch of a timestamp with or without zone."""
    return F.unix_micros((F.col(c) if isinstance(c, str) else c).cast("timestamp"))


def shape_ticks(events: DataFrame) -> DataFrame:
    """Event rows as ticks; works on tables and streams."""
    price = F.round(F.col("value") * 100).cast("long")
    size = F.get_json_object("props", "$.k").cast("long")
    return events.select(
        F.concat(F.lit("S"), (F.col("user_id") % MARKETS).cast("string")).alias("symbol"),
        F.col("event_id").cast("long").alias("trade_id"), micros("ts").alias("ts_us"),
        price.alias("price"), size.alias("size"),
        F.when(F.col("event_type").isin(*BUY_TYPES), "Buy").otherwise("Sell").alias("side"),
        (price * size).alias("notional"))


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ticks, including those with size 0."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return shape_ticks(table(spark, sf_dir, "events"))


def tape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks that traded something."""
    return ticks(spark, sf_dir).where("notional > 0")


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best bid and ask around every tick: one cent wide, plus trade_id % 3; prices up to 5 count as 5, so that bids are positive."""
    half, mid = 1 + F.col("trade_id") % 3, F.greatest(F.col("price"), F.lit(5))
    return ticks(spark, sf_dir).select("symbol", F.col("trade_id").alias("quote_id"), "ts_us", (mid - half).alias("bid"), (mid + half).alias("ask"))


def turnover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turnover per market; one row per market, so it is small by construction."""
    return tape(spark, sf_dir).groupBy("symbol").agg(F.sum("notional").alias("turnover"))


TICKS_SQL = """ticks AS (
  SELECT 'S' || (user_id % 8) AS symbol, CAST(event_id AS BIGINT) AS trade_id, epoch_us(ts) AS ts_us,
         CAST(round(value * 100) AS BIGINT) AS price, CAST(json_extract_string(props, '$.k') AS BIGINT) AS size,
         CASE WHEN event_type IN ('purchase', 'click', 'view') THEN 'Buy' ELSE 'Sell' END AS side,
         CAST(round(value * 100) AS BIGINT) * CAST(json_extract_string(props, '$.k') AS BIGINT) AS notional
  FROM events)"""
TAPE_SQL = TICKS_SQL + """,
tape AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts_us, trade_id) AS rn
         FROM ticks WHERE notional > 0)"""
QUOTES_SQL = """quotes AS (SELECT symbol, trade_id AS quote_id, ts_us, greatest(price, 5) - (1 + trade_id % 3) AS bid,
                   greatest(price, 5) + (1 + trade_id % 3) AS ask FROM ticks)"""
