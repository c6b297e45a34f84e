"""Toxicity over bars."""

from pyspark.sql import functions as F

from tapeworks.catalog import query
from tapeworks.catalog.bars import RESET_SQL, SPLIT_SQL, THRESHOLD, reset
from tapeworks.operators import vpin
from tapeworks.sources import tape as src

N, Z, ZT = 10, 30, 1.5


def signal_sql(bars: str, n=N, z=Z, zt=ZT, total=f"{THRESHOLD}.0 * {N}") -> str:
    return f""", v0 AS (
  SELECT *, buy_notional - sell_notional AS imb, CAST(sum(abs(buy_notional - sell_notional)) OVER (w ROWS {n - 1} PRECEDING) AS DOUBLE) AS flow,
         CAST(sum(notional) OVER (w ROWS {n - 1} PRECEDING) AS DOUBLE) AS traded, close - lag(close, {n - 1}) OVER w AS move
  FROM {bars} WINDOW w AS (PARTITION BY symbol ORDER BY bar_idx)),
v1 AS (SELECT *, greatest(least(flow / ({total}), 1.0), 0.0) AS v FROM v0 WHERE bar_idx >= {n - 1}),
v2 AS (SELECT *, avg(v) OVER w AS m, avg(v * v) OVER w AS s FROM v1
       WINDOW w AS (PARTITION BY symbol ORDER BY bar_idx ROWS {z - 1} PRECEDING)),
v3 AS (SELECT *, (v - m) / sqrt(greatest(s - m * m, 1e-12)) AS zs FROM v2),
signals AS (
  SELECT symbol, bar_idx, end_us, open, close, v AS vpin, zs AS z_score, zs > {zt} AS is_anomaly,
         zs > {zt} AND ((imb > 0 AND move <= 0) OR (imb < 0 AND move >= 0)) AS absorption,
         CASE WHEN zs > {zt} AND imb > 0 THEN 'long' WHEN zs > {zt} AND imb < 0 THEN 'short' ELSE 'neutral' END AS direction
  FROM v3)
"""


SIGNAL_SQL = RESET_SQL + signal_sql("bars")


def signals(spark, sf, **kw):
    return vpin.vpin_signals(reset(spark, sf), window=N, base_threshold=THRESHOLD, z_threshold=ZT, z_history=Z, **kw)


def r6(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


@query("vpin", SIGNAL_SQL + "SELECT symbol, bar_idx, round(vpin, 6) AS vpin FROM signals")
def _(spark, sf):
    return r6(signals(spark, sf).select("symbol", "bar_idx", "vpin"), "vpin")


@query("vpin_bar_denominator", RESET_SQL + signal_sql("bars", total="traded") + "SELECT symbol, bar_idx, round(vpin, 6) AS vpin FROM signals")
def _(spark, sf):
    return r6(signals(spark, sf, denominator="bar").select("symbol", "bar_idx", "vpin"), "vpin")


@query("vpin_zscore", SIGNAL_SQL + "SELECT symbol, bar_idx, round(z_score, 5) AS z_score, is_anomaly FROM signals")
def _(spark, sf):
    return signals(spark, sf).select("symbol", "bar_idx", F.round("z_score", 5).alias("z_score"), "is_anomaly")


@query("absorption", SIGNAL_SQL + "SELECT symbol, bar_idx, end_us, direction, absorption FROM signals WHERE is_anomaly")
def _(spark, sf):
    return signals(spark, sf).where("is_anomaly").select("symbol", "bar_idx", "end_us", "direction", "absorption")


GAP, TAU = 14_400_000_000, 24.0

# Decay stated as pairs: every earlier bar weighted by the silence between the two.
@query("vpin_time_decay", RESET_SQL + f""", g0 AS (
  SELECT *, CASE WHEN end_us - lag(end_us) OVER w > {GAP} THEN (end_us - lag(end_us) OVER w) / (3600e6 * {TAU}) ELSE 0 END AS lost
  FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY bar_idx)),
g AS (SELECT symbol, bar_idx, abs(buy_notional - sell_notional) AS imb, sum(lost) OVER (PARTITION BY symbol ORDER BY bar_idx) AS g FROM g0),
v AS (SELECT a.symbol, a.bar_idx, a.g, least(sum(b.imb * exp(b.g - a.g)) / ({THRESHOLD}.0 * {N}), 1.0) AS v
      FROM g a JOIN g b ON a.symbol = b.symbol AND b.bar_idx BETWEEN a.bar_idx - {N - 1} AND a.bar_idx
      WHERE a.bar_idx >= {N - 1} GROUP BY a.symbol, a.bar_idx, a.g),
h AS (SELECT a.symbol, a.bar_idx, a.v, avg(b.v * exp(b.g - a.g)) AS m, avg((b.v * exp(b.g - a.g)) * (b.v * exp(b.g - a.g))) AS s
      FROM v a JOIN v b ON a.symbol = b.symbol AND b.bar_idx BETWEEN a.bar_idx - {Z - 1} AND a.bar_idx GROUP BY a.symbol, a.bar_idx, a.v)
SELECT symbol, bar_idx, round(v, 6) AS vpin, round((v - m) / sqrt(greatest(s - m * m, 1e-12)), 5) AS z_score FROM h""")
def _(spark, sf):
    return signals(spark, sf, decay_gap_us=GAP, tau_hours=TAU).select(
        "symbol", "bar_idx", F.round("vpin", 6).alias("vpin"), F.round("z_score", 5).alias("z_score"))


@query("tick_batch_signals", SPLIT_SQL + signal_sql("split") + """SELECT symbol, bar_idx, end_us, close, round(vpin, 6) AS vpin,
  round(z_score, 5) AS z_score, is_anomaly, absorption FROM signals""")
def _(spark, sf):
    out = vpin.tick_batch_signals(src.tape(spark, sf), THRESHOLD, window=N, z_threshold=ZT, z_history=Z)
    return out.select("symbol", "bar_idx", "end_us", "close", F.round("vpin", 6).alias("vpin"),
                      F.round("z_score", 5).alias("z_score"), "is_anomaly", "absorption")
