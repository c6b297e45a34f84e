"""Leader regime, shocks, blackouts and gates."""

from pyspark.sql import functions as F

from tapeworks.catalog import query
from tapeworks.catalog.vpin import SIGNAL_SQL, signals
from tapeworks.operators import regime
from tapeworks.plans.slices import dense_index
from tapeworks.sources import tape as src

H = 3_600_000_000
WIN, COOL = 24 * H, 6 * H
REGIME_SQL = SIGNAL_SQL + f""", leader AS (SELECT bar_idx, end_us AS ts_us, vpin, close AS price, row_number() OVER (ORDER BY end_us, bar_idx) - 1 AS idx FROM signals WHERE symbol = 'S0'),
ref AS (SELECT a.*, (SELECT min(b.idx) FROM leader b WHERE b.ts_us >= a.ts_us - {WIN}) AS ref_idx FROM leader a),
roc AS (SELECT r.*, (r.price - b.price) / b.price AS roc FROM ref r JOIN leader b ON b.idx = r.ref_idx WHERE r.ref_idx < r.idx),
trig AS (SELECT *, CASE WHEN vpin > 0.3 THEN 'TOXIC_FLOW' WHEN roc < -0.9 THEN 'FLASH_CRASH' END AS trigger FROM roc),
lastp AS (SELECT *, max(CASE WHEN trigger IS NOT NULL THEN ts_us END) OVER (ORDER BY ts_us, idx) AS lp FROM trig),
regime AS (SELECT ts_us, idx AS state_id, round(vpin, 6) AS vpin, price, round(roc, 6) AS roc,
  trigger IS NOT NULL OR coalesce(ts_us - lp < {COOL}, false) AS is_panic,
  coalesce(trigger, CASE WHEN ts_us - lp < {COOL} THEN 'COOLDOWN' END) AS reason FROM lastp)
"""


def leader_regime(spark, sf):
    lead = signals(spark, sf).where("symbol = 'S0'").select(F.col("end_us").alias("ts_us"), F.col("bar_idx").alias("seq"), "vpin", F.col("close").alias("price"))
    return regime.macro_regime(lead, window_us=WIN, panic_vpin=0.3, panic_roc=-0.9, cooldown_us=COOL)


@query("macro_regime", REGIME_SQL + "SELECT * FROM regime")
def _(spark, sf):
    return leader_regime(spark, sf).withColumn("vpin", F.round("vpin", 6)).withColumn("roc", F.round("roc", 6))


@query("macro_mute", REGIME_SQL + """SELECT s.symbol, s.bar_idx, s.end_us FROM (SELECT * FROM signals WHERE is_anomaly) s
ASOF LEFT JOIN regime r ON s.end_us >= r.ts_us WHERE s.symbol = 'S0' OR NOT coalesce(r.is_panic, false)""")
def _(spark, sf):
    hot = signals(spark, sf).where("is_anomaly").select("symbol", "bar_idx", "end_us")
    return regime.macro_mute(hot, leader_regime(spark, sf), "S0")


@query("trend_reset_filter", SIGNAL_SQL + "SELECT symbol, bar_idx FROM signals WHERE symbol = 'S0' OR vpin < 0.25")
def _(spark, sf):
    return regime.trend_reset_filter(signals(spark, sf), "S0", 0.25).select("symbol", "bar_idx")


SHOCK_SQL = f"""idx AS (SELECT symbol, ts_us, trade_id, price, row_number() OVER (PARTITION BY symbol ORDER BY ts_us, trade_id) - 1 AS i FROM ticks WHERE symbol IN ('S0', 'S1')),
old AS (SELECT a.symbol, a.ts_us, a.trade_id, a.price, a.i, greatest(min(b.i), a.i - 4) AS oi FROM idx a JOIN idx b
        ON a.symbol = b.symbol AND b.ts_us BETWEEN a.ts_us - {2 * H} AND a.ts_us AND b.i <= a.i GROUP BY a.symbol, a.ts_us, a.trade_id, a.price, a.i),
drift AS (SELECT o.symbol, o.ts_us, o.trade_id, o.price, abs(o.price - b.price) * 10000 // b.price AS drift_bps
          FROM old o JOIN idx b ON b.symbol = o.symbol AND b.i = o.oi WHERE o.oi < o.i AND b.price > 0),
shocks AS (SELECT * FROM drift WHERE drift_bps >= 9000)"""


def shocks(spark, sf):
    lead = src.ticks(spark, sf).where("symbol IN ('S0', 'S1')")
    return regime.leader_shock(lead, window_us=2 * H, max_ticks=5, shock_bps=9000)


@query("leader_shock", f"WITH {src.TICKS_SQL}, {SHOCK_SQL} SELECT * FROM shocks")
def _(spark, sf):
    return shocks(spark, sf)


@query("spread_shock", f"""WITH {src.TICKS_SQL}, {src.QUOTES_SQL} SELECT *, (ask - bid) * 10000 // bid AS spread_bps FROM quotes
WHERE bid > 0 AND (ask - bid) * 10000 // bid >= 100""")
def _(spark, sf):
    return regime.spread_shock(src.quotes(spark, sf))


EPISODE_SQL = f"""ep AS (SELECT *, sum(fresh) OVER (ORDER BY ts_us, trade_id) AS episode FROM (
  SELECT *, CASE WHEN ts_us - lag(ts_us) OVER (ORDER BY ts_us, trade_id) <= {H} THEN 0 ELSE 1 END AS fresh FROM shocks))"""


@query("blackouts", f"""WITH {src.TICKS_SQL}, {SHOCK_SQL}, {EPISODE_SQL}
SELECT CAST(episode AS BIGINT) AS episode, min(ts_us) AS start_us, max(ts_us) + {H} AS until_us, count(*) AS shocks,
  arg_max(symbol, ts_us) AS last_leader, arg_max(drift_bps, ts_us) AS last_drift_bps FROM ep GROUP BY episode""")
def _(spark, sf):
    return regime.blackouts(shocks(spark, sf).withColumnRenamed("trade_id", "shock_id"), duration_us=H, new_after_us=H)


@query("blackout_gate", f"""WITH {src.TICKS_SQL}, {SHOCK_SQL}
SELECT t.trade_id, t.symbol FROM ticks t ASOF LEFT JOIN shocks s ON t.ts_us >= s.ts_us WHERE s.ts_us IS NULL OR t.ts_us - s.ts_us >= {H}""")
def _(spark, sf):
    marks = shocks(spark, sf).withColumnRenamed("trade_id", "shock_id")
    return regime.blackout_gate(src.ticks(spark, sf).select("symbol", "trade_id", "ts_us"), marks, duration_us=H).select("trade_id", "symbol")


@query("tombstone_filter", f"""WITH {src.TICKS_SQL}, b AS (SELECT symbol, ts_us FROM ticks WHERE price > 22000)
SELECT t.trade_id, t.symbol FROM ticks t ASOF LEFT JOIN b ON t.symbol = b.symbol AND t.ts_us >= b.ts_us WHERE b.ts_us IS NULL OR t.ts_us - b.ts_us > {12 * H}""")
def _(spark, sf):
    t = src.ticks(spark, sf)
    burials = t.where("price > 22000").select("symbol", "ts_us", F.col("trade_id").alias("burial_id"))
    return regime.tombstone_filter(t, burials, cooldown_us=12 * H).select("trade_id", "symbol")


@query("liquidity_pull", f"""WITH {src.TICKS_SQL}, l AS (SELECT *, lag(price) OVER (PARTITION BY symbol ORDER BY ts_us, trade_id) AS base FROM ticks)
SELECT symbol, ts_us, trade_id AS seq, price AS bid_liq, size * 40 AS traded, round((base - price) / base, 6) AS drop_ratio
FROM l WHERE (base - price) / base > 0.4 AND size * 40 < 1000""")
def _(spark, sf):
    book = src.ticks(spark, sf).select("symbol", "ts_us", F.col("trade_id").alias("seq"), F.col("price").alias("bid_liq"), (F.col("size") * 40).alias("traded"))
    return regime.liquidity_pull(book).withColumn("drop_ratio", F.round("drop_ratio", 6))


@query("pulse_verified", f"""WITH {src.TICKS_SQL} SELECT trade_id AS pulse_id, symbol,
  abs(trade_id % 21 / 10.0 - 1) >= 0.8 AND trade_id % 20 <= 10 AND size * 100000000 // 31 > 150000000 AS is_real FROM ticks""")
def _(spark, sf):
    t = src.ticks(spark, sf)
    pulses = t.select("symbol", (F.col("ts_us") + F.col("trade_id") % 20 * 1000).alias("ts_us"), F.col("trade_id").alias("pulse_id"),
                      (F.col("trade_id") % 21 / 10.0 - 1).alias("imbalance"), F.lit(30).cast("long").alias("avg_vol"))
    return regime.pulse_verified(pulses, t).select("pulse_id", "symbol", "is_real")


@query("heat_divergence", f"""WITH {src.TICKS_SQL}, h AS (SELECT ts_us - ts_us % {H} AS bucket_us, avg(CASE WHEN symbol IN ('S0', 'S1', 'S2', 'S3') THEN size END) / 50 AS p,
  avg(CASE WHEN symbol NOT IN ('S0', 'S1', 'S2', 'S3') THEN size END) / 50 AS r FROM ticks GROUP BY 1)
SELECT bucket_us, round(p - r, 6) AS divergence, p - r > 0.5 AS is_lagging FROM h WHERE p IS NOT NULL AND r IS NOT NULL""")
def _(spark, sf):
    t = src.ticks(spark, sf).withColumn("bucket_us", F.col("ts_us") - F.col("ts_us") % H)
    side = F.col("symbol").isin("S0", "S1", "S2", "S3")
    heat = lambda d: d.groupBy("bucket_us").agg((F.avg("size") / 50).alias("heat"))
    return regime.heat_divergence(heat(t.where(side)), heat(t.where(~side))).select("bucket_us", F.round("divergence", 6).alias("divergence"), "is_lagging")


@query("rolling_win_rate", f"""WITH {src.TICKS_SQL}, o AS (SELECT symbol AS key, row_number() OVER (PARTITION BY symbol ORDER BY ts_us, trade_id) - 1 AS idx,
  CASE WHEN price % 10 < 4 THEN 1 ELSE 0 END AS win FROM ticks)
SELECT * FROM (SELECT key, idx, round(avg(win) OVER (PARTITION BY key ORDER BY idx ROWS 9 PRECEDING), 6) AS win_rate,
  sum(win) OVER (PARTITION BY key ORDER BY idx ROWS 9 PRECEDING) < 3 AS compromised FROM o) WHERE idx >= 9""")
def _(spark, sf):
    o = dense_index(src.ticks(spark, sf), ["symbol"], ["ts_us", "trade_id"], "idx")
    o = o.select(F.col("symbol").alias("key"), "idx", F.when(F.col("price") % 10 < 4, 1).otherwise(0).alias("win"))
    return regime.rolling_win_rate(o).select("key", "idx", F.round("win_rate", 6).alias("win_rate"), "compromised")


Q = 4 * H


@query("consecutive_failures", f"""WITH RECURSIVE {src.TICKS_SQL}, t AS (SELECT symbol, ts_us, trade_id, price % 10 < 4 AS ok, row_number() OVER (PARTITION BY symbol ORDER BY ts_us, trade_id) AS rn FROM ticks),
w AS (SELECT symbol, rn, ts_us, trade_id, CASE WHEN ok THEN 0 ELSE 1 END AS run, 'JUDGED' AS status, CAST(NULL AS BIGINT) AS until_us FROM t WHERE rn = 1
  UNION ALL SELECT t.symbol, t.rn, t.ts_us, t.trade_id,
    CASE WHEN w.until_us > t.ts_us THEN w.run WHEN w.until_us IS NOT NULL OR t.ok THEN 0 ELSE w.run + 1 END,
    CASE WHEN w.until_us > t.ts_us THEN 'QUARANTINED' WHEN w.until_us IS NOT NULL THEN 'LIFTED' WHEN NOT t.ok AND w.run + 1 >= 3 THEN 'TRIGGERED' ELSE 'JUDGED' END,
    CASE WHEN w.until_us > t.ts_us THEN w.until_us WHEN w.until_us IS NOT NULL THEN NULL WHEN NOT t.ok AND w.run + 1 >= 3 THEN t.ts_us + {Q} END
  FROM w JOIN t ON t.symbol = w.symbol AND t.rn = w.rn + 1)
SELECT symbol, ts_us, trade_id AS event_id, CAST(run AS BIGINT) AS failures, status, until_us FROM w""")
def _(spark, sf):
    o = src.ticks(spark, sf).select("symbol", "ts_us", F.col("trade_id").alias("event_id"), (F.col("price") % 10 < 4).alias("success"))
    return regime.consecutive_failures(o, quarantine_us=Q)
