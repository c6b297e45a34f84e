"""Market universes from customers, parts and suppliers."""

from pyspark.sql import functions as F

from tapeworks.catalog import query
from tapeworks.catalog.wire import TICKER_SQL, ticker_messages
from tapeworks.operators import universe as uni
from tapeworks.sources import tape as src
from tapeworks.sources import wire

HOT_SQL = TICKER_SQL + """, hot AS (SELECT symbol FROM tickers WHERE symbol LIKE '%USDT' AND turnover >= 5000 ORDER BY turnover DESC, symbol LIMIT 20),
target AS (SELECT symbol FROM hot UNION SELECT unnest(['BTCUSDT', 'ETHUSDT', 'SOLUSDT']))"""


def hot(spark, sf):
    return uni.hot_universe(wire.parse_tickers(ticker_messages(spark, sf)), min_turnover=5000.0, max_symbols=23)


@query("hot_universe", f"WITH {HOT_SQL} SELECT symbol FROM target")
def _(spark, sf):
    return hot(spark, sf)


@query("universe_diff", f"""WITH {HOT_SQL}, active AS (SELECT symbol FROM tickers WHERE turnover > 9900)
SELECT symbol, 'add' AS action FROM target WHERE symbol NOT IN (SELECT symbol FROM active) UNION ALL SELECT symbol, 'remove' FROM (SELECT DISTINCT symbol FROM active) WHERE symbol NOT IN (SELECT symbol FROM target)""")
def _(spark, sf):
    active = wire.parse_tickers(ticker_messages(spark, sf)).where("turnover > 9900")
    return uni.universe_diff(hot(spark, sf), active)


@query("tradable_universe", """SELECT upper('p' || p_partkey || 'usdt') AS symbol, p_retailprice * 1e5 AS turnover, (p_size % 5) / 100.0::DOUBLE AS tick_size, (p_size % 3) / 10.0::DOUBLE AS step, (p_partkey % 4)::DOUBLE AS min_qty
FROM part WHERE p_type <> 'ECONOMY' AND p_retailprice * 1e5 > 9.5e7 AND p_size % 5 > 0 AND p_size % 3 > 0 AND p_partkey % 4 > 0""")
def _(spark, sf):
    p = src.table(spark, sf, "part").select(
        F.concat(F.lit("p"), F.col("p_partkey").cast("string"), F.lit("usdt")).alias("symbol"), F.when(F.col("p_type") == "ECONOMY", "Settling").otherwise("Trading").alias("status"),
        (F.col("p_retailprice") * 1e5).alias("turnover"), F.struct(((F.col("p_size") % 5) / 100.0).alias("tick_size")).alias("price_filter"),
        F.struct(((F.col("p_size") % 3) / 10.0).alias("step"), (F.col("p_partkey") % 4).cast("double").alias("min_qty")).alias("lot_filter"))
    return uni.tradable_universe(p, min_turnover=9.5e7)
