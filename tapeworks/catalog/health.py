"""Feed health, clocks and heat."""

from pyspark.sql import functions as F

from tapeworks.catalog import query
from tapeworks.catalog.bars import RESET_SQL, reset
from tapeworks.operators import health
from tapeworks.sources import tape as src

H = 3_600_000_000


@query("clock_offset", f"""WITH {src.TICKS_SQL} SELECT symbol, round(avg(ts_us / 1000.0 + trade_id % 100 / 2.0 + price % 41 - 20 - (ts_us / 1000.0 + trade_id % 100 / 2.0)), 6) AS offset_ms, count(*) AS samples,
  abs(avg(price % 41 - 20.0)) > 1 AS unacceptable FROM ticks WHERE trade_id % 100 <= 80 GROUP BY symbol""")
def _(spark, sf):
    rtt, t0 = F.col("trade_id") % 100, F.col("ts_us") / 1000
    p = src.ticks(spark, sf).select("symbol", t0.alias("t0_ms"), rtt.alias("rtt_ms"), (t0 + rtt / 2 + F.col("price") % 41 - 20).alias("server_ms"))
    return health.clock_offset(p, max_rtt_ms=80, max_offset_ms=1, keys=["symbol"]).withColumn("offset_ms", F.round("offset_ms", 6))


@query("ema_fold", f"""WITH RECURSIVE {src.TAPE_SQL}, w AS (SELECT symbol, rn, trade_id, price::DOUBLE AS ema FROM tape WHERE rn = 1
  UNION ALL SELECT t.symbol, t.rn, t.trade_id, t.price * 0.15 + w.ema * 0.85 FROM w JOIN tape t ON t.symbol = w.symbol AND t.rn = w.rn + 1)
SELECT symbol, trade_id, round(ema / 7, 5) AS ema FROM w""")
def _(spark, sf):
    return health.ema_fold(src.tape(spark, sf), ["symbol"], ["ts_us", "trade_id"], "price", 0.15).select("symbol", "trade_id", F.round(F.col("ema") / 7, 5).alias("ema"))


@query("lag_filter", f"""WITH RECURSIVE {src.TAPE_SQL}, w AS (SELECT symbol, rn, trade_id, price::DOUBLE AS base, true AS accepted FROM tape WHERE rn = 1
  UNION ALL SELECT t.symbol, t.rn, t.trade_id, CASE WHEN t.price - w.base <= 3000 THEN 0.05 * t.price + 0.95 * w.base ELSE w.base END, t.price - w.base <= 3000 FROM w JOIN tape t ON t.symbol = w.symbol AND t.rn = w.rn + 1)
SELECT symbol AS feed, trade_id AS event_id, accepted, round(base / 7, 5) AS baseline_ms FROM w""")
def _(spark, sf):
    p = src.tape(spark, sf).select(F.col("symbol").alias("feed"), "ts_us", F.col("trade_id").alias("event_id"), F.col("price").alias("lag_ms"))
    return health.lag_filter(p, max_dev_ms=3000.0).select("feed", "event_id", "accepted", F.round(F.col("baseline_ms") / 7, 5).alias("baseline_ms"))


P99 = "floor(quantile_cont(rtt, 0.99))"


@query("rtt_p99", f"""WITH {src.TICKS_SQL}, s AS (SELECT symbol AS feed, row_number() OVER (PARTITION BY symbol ORDER BY ts_us, trade_id) - 1 AS idx, price % 190 + CASE WHEN price % 97 = 0 THEN 400 ELSE 0 END AS rtt, size AS tps FROM ticks),
p AS (SELECT a.feed, a.idx, any_value(a.tps) AS tps, CAST({P99} AS BIGINT) AS wide_p99, CAST(floor(quantile_cont(rtt_s, 0.99)) AS BIGINT) AS short_p99
  FROM s a JOIN (SELECT feed, idx AS i, rtt FROM s) b ON a.feed = b.feed AND b.i BETWEEN a.idx - 399 AND a.idx,
       LATERAL (SELECT CASE WHEN b.i > a.idx - 100 THEN b.rtt END AS rtt_s) WHERE a.idx % 10 = 9 AND a.idx >= 99 GROUP BY a.feed, a.idx),
e AS (SELECT *, CASE WHEN short_p99 < wide_p99 * 0.4 AND tps >= 10 THEN floor(short_p99 * 0.7 + wide_p99 * 0.3) ELSE wide_p99 END AS eff FROM p)
SELECT feed, idx, wide_p99, short_p99, wide_p99 <= 150 OR short_p99 < 100 AS healthy, CAST(2 + floor(greatest(0, eff - 20) / 25) AS BIGINT) AS penalty FROM e""".replace("quantile_cont(rtt, 0.99)", "quantile_cont(b.rtt, 0.99)").replace("CASE WHEN b.i > a.idx - 100 THEN b.rtt END AS rtt_s", "CASE WHEN b.i > a.idx - 100 THEN b.rtt END AS rtt_s"))
def _(spark, sf):
    rtt = F.col("price") % 190 + F.when(F.col("price") % 97 == 0, 400).otherwise(0)
    s = src.ticks(spark, sf).select(F.col("symbol").alias("feed"), "ts_us", F.col("trade_id").alias("event_id"), rtt.alias("rtt_ms"), F.col("size").alias("tps"))
    return health.rtt_p99(s, wide=400, short=100)


@query("failure_bursts", f"""WITH {src.TICKS_SQL}, f AS (SELECT *, count(*) OVER (PARTITION BY symbol ORDER BY ts_us RANGE BETWEEN {4 * H} PRECEDING AND CURRENT ROW) AS recent FROM ticks WHERE price % 2 = 0)
SELECT symbol AS component, ts_us, trade_id AS event_id, recent FROM f WHERE recent >= 5""")
def _(spark, sf):
    f = src.ticks(spark, sf).where("price % 2 = 0").select(F.col("symbol").alias("component"), "ts_us", F.col("trade_id").alias("event_id"))
    return health.failure_bursts(f, window_us=4 * H)


def mean_heat(spark, sf):
    t = src.ticks(spark, sf)
    return t.groupBy((F.col("ts_us") - F.col("ts_us") % H).alias("ts_us")).agg((F.avg("size") / 60).alias("heat")).withColumn("sample_id", F.col("ts_us"))


HEAT_SQL = f"""{src.TICKS_SQL}, h AS (SELECT ts_us - ts_us % {H} AS ts_us, avg(size) / 60 AS heat FROM ticks GROUP BY 1),
x AS (SELECT *, coalesce(last_value(CASE WHEN heat > 0.85 THEN true WHEN heat < 0.7 THEN false END IGNORE NULLS) OVER (ORDER BY ts_us), false) AS tunnel_vision FROM h)"""


@query("pressure_hysteresis", f"WITH {HEAT_SQL} SELECT ts_us, round(heat, 6) AS heat, tunnel_vision FROM x")
def _(spark, sf):
    return health.pressure_hysteresis(mean_heat(spark, sf), off=0.7).select("ts_us", F.round("heat", 6).alias("heat"), "tunnel_vision")


@query("shed_ticks", f"WITH {HEAT_SQL} SELECT trade_id, symbol FROM ticks t ASOF LEFT JOIN (SELECT ts_us AS at, tunnel_vision FROM x) x ON t.ts_us >= x.at WHERE NOT coalesce(tunnel_vision, false) OR symbol IN ('S0', 'S1')")
def _(spark, sf):
    p = health.pressure_hysteresis(mean_heat(spark, sf), off=0.7)
    return health.shed_ticks(src.ticks(spark, sf).select("trade_id", "symbol", "ts_us"), p, ("S0", "S1")).select("trade_id", "symbol")


@query("backlog_stagnation", f"""WITH {src.TICKS_SQL}, s AS (SELECT ts_us, trade_id AS sample_id, trade_id // 40 % 50 AS pending, row_number() OVER (ORDER BY ts_us, trade_id) - 1 AS idx FROM ticks),
f AS (SELECT *, pending > 0 AND pending >= coalesce(lag(pending) OVER (ORDER BY idx), 0) AS stuck FROM s),
g AS (SELECT *, (idx - coalesce(max(CASE WHEN NOT stuck THEN idx END) OVER (ORDER BY idx), -1)) * 10 AS sec FROM f),
k AS (SELECT *, lag(sec) OVER (ORDER BY idx) AS before FROM g)
SELECT ts_us, sample_id, pending, sec AS stagnation_sec, CASE WHEN sec >= 300 THEN 'STAGNANT' ELSE 'RECOVERED' END AS event FROM k WHERE sec >= 300 OR (sec = 0 AND coalesce(before, 0) >= 300)""")
def _(spark, sf):
    s = src.ticks(spark, sf).select("ts_us", F.col("trade_id").alias("sample_id"), (F.floor(F.col("trade_id") / 40) % 50).alias("pending"))
    return health.backlog_stagnation(s)


@query("cusum", RESET_SQL + """, w AS (
  SELECT symbol, bar_idx, close::DOUBLE AS m, 1e-8::DOUBLE AS v, 0::DOUBLE AS up, 0::DOUBLE AS dn, CAST(0 AS BIGINT) AS signal FROM bars WHERE bar_idx = 0
  UNION ALL SELECT symbol, bar_idx, m, v, CASE WHEN u > 2.0 OR d < -2.0 THEN 0 ELSE u END, CASE WHEN u > 2.0 OR d < -2.0 THEN 0 ELSE d END, CASE WHEN u > 2.0 THEN 1 WHEN d < -2.0 THEN -1 ELSE 0 END FROM (
    SELECT symbol, bar_idx, m, v, greatest(0, up + delta / (sqrt(v) + 1e-8) - 0.3) AS u, least(0, dn + delta / (sqrt(v) + 1e-8) + 0.3) AS d FROM (
      SELECT b.symbol, b.bar_idx, w.m + 0.05 * (b.close - w.m) AS m, 0.95 * (w.v + 0.05 * (b.close - w.m) * (b.close - w.m)) AS v, b.close - w.m AS delta, w.up, w.dn
      FROM w JOIN bars b ON b.symbol = w.symbol AND b.bar_idx = w.bar_idx + 1)))
SELECT symbol, bar_idx AS seq, signal FROM w""")
def _(spark, sf):
    p = reset(spark, sf).select("symbol", F.col("bar_idx").alias("seq"), F.col("close").alias("price"))
    return health.cusum(p, threshold=2.0, drift=0.3)


@query("sector_heat", f"""WITH RECURSIVE {src.TICKS_SQL}, e AS (SELECT symbol AS sector, ts_us, trade_id, CASE trade_id % 9 WHEN 0 THEN 'awakening' WHEN 4 THEN 'failed' WHEN 7 THEN 'intent' ELSE 'tick' END AS kind, row_number() OVER (PARTITION BY symbol ORDER BY ts_us, trade_id) AS rn FROM ticks),
z AS (SELECT DISTINCT sector, CAST(0 AS BIGINT) AS rn, 0::DOUBLE AS heat, 0::DOUBLE AS fatigue, CAST(NULL AS BIGINT) AS trade_id FROM e),
w AS (SELECT * FROM z UNION ALL SELECT e.sector, e.rn, CASE e.kind WHEN 'awakening' THEN least(2.0, heat + 0.4) WHEN 'tick' THEN heat * (0.995 / (1.0 + fatigue * 0.1)) ELSE heat END,
  CASE e.kind WHEN 'failed' THEN least(50.0, fatigue + 1) WHEN 'intent' THEN greatest(0.0, fatigue - 2) ELSE fatigue END, e.trade_id FROM w JOIN e ON e.sector = w.sector AND e.rn = w.rn + 1)
SELECT sector, trade_id AS event_id, round(heat, 6) AS heat, fatigue, round(greatest(0.2, least(1.0, 1.0 - heat * 0.8)) * exp(greatest(0.0, fatigue - 10) * 0.3), 6) AS threshold,
  round(greatest(0.0, least(1.5, heat / (1.0 + fatigue * 0.5))), 6) AS confidence FROM w WHERE rn > 0""")
def _(spark, sf):
    k = F.col("trade_id") % 9
    e = src.ticks(spark, sf).select(F.col("symbol").alias("sector"), "ts_us", F.col("trade_id").alias("event_id"),
                                    F.when(k == 0, "awakening").when(k == 4, "failed").when(k == 7, "intent").otherwise("tick").alias("kind"))
    return health.sector_heat(e).select("sector", "event_id", F.round("heat", 6).alias("heat"), "fatigue", F.round("threshold", 6).alias("threshold"), F.round("confidence", 6).alias("confidence"))


@query("quarantine_stash", f"""WITH {src.TICKS_SQL}, c AS (SELECT symbol, ts_us, trade_id, CASE WHEN price % 2 = 0 THEN 'corrupted' ELSE 'recovered' END AS kind FROM ticks WHERE trade_id % 23 = 0),
d AS (SELECT *, lag(kind) OVER (PARTITION BY symbol ORDER BY ts_us, trade_id) AS was FROM c), s AS (SELECT symbol, ts_us AS since_us, kind FROM d WHERE coalesce(kind <> was, kind = 'corrupted')),
h AS (SELECT t.symbol, t.trade_id, s.since_us, row_number() OVER (PARTITION BY t.symbol, s.since_us ORDER BY t.ts_us, t.trade_id) AS nth, count(*) OVER (PARTITION BY t.symbol, s.since_us) AS n
  FROM ticks t ASOF JOIN s ON t.symbol = s.symbol AND t.ts_us >= s.since_us WHERE s.kind = 'corrupted')
SELECT symbol, trade_id, since_us, CASE WHEN symbol IN ('S0', 'S1') THEN CASE WHEN nth > n - 30 THEN 'STASHED' ELSE 'TRUNCATED' END WHEN nth <= 20 THEN 'STASHED' WHEN nth = 21 THEN 'BURIAL' ELSE 'DROPPED' END AS status FROM h""")
def _(spark, sf):
    t = src.ticks(spark, sf)
    c = t.where("trade_id % 23 = 0").select("symbol", "ts_us", F.col("trade_id").alias("control_id"), F.when(F.col("price") % 2 == 0, "corrupted").otherwise("recovered").alias("kind"))
    return health.quarantine_stash(t.select("symbol", "ts_us", "trade_id"), c, core=("S0", "S1"), size=20, core_size=30).select("symbol", "trade_id", "since_us", "status")
