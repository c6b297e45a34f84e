"""Which markets to watch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Majors that are always watched.
MAJORS = ("BTCUSDT", "ETHUSDT", "SOLUSDT")


def hot_universe(tickers: DataFrame, *, min_turnover: float = 50_000_000.0, max_symbols: int = 8, majors: tuple[str, ...] = MAJORS,
                 quote: str = "USDT") -> DataFrame:
    """The most traded symbols, leaving room for the majors, plus the majors."""
    hot = tickers.where(F.col("symbol").endswith(quote) & (F.col("turnover") >= min_turnover)) \
        .orderBy(F.col("turnover").desc(), "symbol").limit(max(0, max_symbols - len(majors))).select("symbol")
    fixed = tickers.sparkSession.createDataFrame([(m,) for m in majors], "symbol string")
    return hot.unionByName(fixed).distinct()


def tradable_universe(instruments: DataFrame, *, min_turnover: float = 50_000_000.0) -> DataFrame:
    """Trading instruments with real turnover and usable lot and price steps, by symbol
    (``symbol, status, turnover, price_filter<tick_size>, lot_filter<step, min_qty>``)."""
    ok = (F.col("status") == "Trading") & (F.col("turnover") > min_turnover) & (F.col("price_filter.tick_size") > 0) \
        & (F.col("lot_filter.step") > 0) & (F.col("lot_filter.min_qty") > 0)
    return instruments.where(ok).select(F.upper("symbol").alias("symbol"), "turnover", "price_filter.tick_size", "lot_filter.step", "lot_filter.min_qty") \
        .orderBy("symbol")


def universe_diff(target: DataFrame, active: DataFrame) -> DataFrame:
    """Symbols to add and to remove."""
    t, a = target.select("symbol").distinct(), active.select("symbol").distinct()
    return t.join(a, "symbol", "left_anti").withColumn("action", F.lit("add")) \
        .unionByName(a.join(t, "symbol", "left_anti").withColumn("action", F.lit("remove")))
