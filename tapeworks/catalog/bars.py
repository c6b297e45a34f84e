"""Bars and clocks."""

from pyspark.sql import functions as F

from tapeworks.catalog import query
from tapeworks.operators import bars
from tapeworks.sources import tape as src

THRESHOLD = 5_000_000

# Reset bars stated as a recursion: bar number and what the bar holds after each tick.
RESET_SQL = f"""WITH RECURSIVE {src.TAPE_SQL},
walk AS (
  SELECT symbol, rn, notional AS held, CAST(0 AS BIGINT) AS bar_idx FROM tape WHERE rn = 1
  UNION ALL
  SELECT t.symbol, t.rn, CASE WHEN w.held >= {THRESHOLD} THEN t.notional ELSE w.held + t.notional END,
         CASE WHEN w.held >= {THRESHOLD} THEN w.bar_idx + 1 ELSE w.bar_idx END
  FROM walk w JOIN tape t ON t.symbol = w.symbol AND t.rn = w.rn + 1),
placed AS (SELECT t.*, w.bar_idx, t.ts_us - lag(t.ts_us) OVER (PARTITION BY t.symbol ORDER BY t.rn) AS gap
           FROM tape t JOIN walk w USING (symbol, rn)),
all_bars AS (
  SELECT symbol, bar_idx, arg_min(price, rn) AS open, max(price) AS high, min(price) AS low, arg_max(price, rn) AS close,
         CAST(sum(size) AS BIGINT) AS volume, CAST(sum(notional) AS BIGINT) AS notional,
         CAST(sum(CASE WHEN side = 'Buy' THEN notional ELSE 0 END) AS BIGINT) AS buy_notional,
         CAST(sum(CASE WHEN side = 'Buy' THEN 0 ELSE notional END) AS BIGINT) AS sell_notional,
         count(*) AS tick_count, min(ts_us) AS start_us, max(ts_us) AS end_us, coalesce(max(gap), 0) AS max_gap_us
  FROM placed GROUP BY symbol, bar_idx),
bars AS (SELECT * EXCLUDE (max_gap_us) FROM all_bars WHERE notional >= {THRESHOLD})
"""

SPLIT_SQL = f"""WITH {src.TAPE_SQL},
placed AS (SELECT *, CAST(sum(notional) OVER (PARTITION BY symbol ORDER BY rn) AS BIGINT) AS hi FROM tape),
chunks AS (
  SELECT p.*, b.bar_idx, least(hi, (b.bar_idx + 1) * {THRESHOLD}) - greatest(hi - notional, b.bar_idx * {THRESHOLD}) AS chunk
  FROM placed p, LATERAL (SELECT unnest(range((hi - notional) // {THRESHOLD}, (hi - 1) // {THRESHOLD} + 1)) AS bar_idx) b),
split AS (
  SELECT symbol, bar_idx, arg_min(price, rn) AS open, max(price) AS high, min(price) AS low, arg_max(price, rn) AS close,
         CAST(sum(chunk) AS BIGINT) AS notional,
         CAST(sum(CASE WHEN side = 'Buy' THEN chunk ELSE 0 END) AS BIGINT) AS buy_notional,
         CAST(sum(CASE WHEN side = 'Buy' THEN 0 ELSE chunk END) AS BIGINT) AS sell_notional,
         count(*) AS tick_count, min(ts_us) AS start_us, max(ts_us) AS end_us,
         round(sum(chunk / price), 4) AS volume,
         round(sum((CASE WHEN side = 'Buy' THEN size ELSE -size END) * chunk / notional), 4) AS ofi
  FROM chunks GROUP BY symbol, bar_idx HAVING sum(chunk) >= {THRESHOLD})
"""


def signed_size():
    return F.when(F.col("side") == "Buy", F.col("size")).otherwise(-F.col("size"))


def reset(spark, sf):
    return bars.dollar_bars(src.tape(spark, sf), THRESHOLD)


def split(spark, sf):
    t = src.tape(spark, sf).withColumn("flow", signed_size())
    return bars.split_bars(t, THRESHOLD, ofi="flow")


@query("dollar_bars", RESET_SQL + "SELECT * FROM bars")
def _(spark, sf):
    return reset(spark, sf)


@query("gap_poisoned_bars", RESET_SQL + f"SELECT * FROM all_bars WHERE notional >= {THRESHOLD} AND max_gap_us <= 9000000000")
def _(spark, sf):
    return bars.gap_poisoned_bars(src.tape(spark, sf), THRESHOLD, max_gap_us=9_000_000_000)


CONTROL_SQL = "controls AS (SELECT epoch_us(ts) AS ts_us FROM events WHERE value >= 250)"


@query("resync", f"""WITH RECURSIVE {src.TAPE_SQL}, {CONTROL_SQL},
epochs AS (SELECT t.*, (SELECT count(*) FROM controls c WHERE c.ts_us < t.ts_us) AS epoch FROM tape t),
walk AS (
  SELECT symbol, rn, epoch, notional AS held, CAST(0 AS BIGINT) AS run FROM epochs WHERE rn = 1
  UNION ALL
  SELECT t.symbol, t.rn, t.epoch,
         CASE WHEN w.held >= {THRESHOLD} OR w.epoch <> t.epoch THEN t.notional ELSE w.held + t.notional END,
         CASE WHEN w.held >= {THRESHOLD} OR w.epoch <> t.epoch THEN w.run + 1 ELSE w.run END
  FROM walk w JOIN epochs t ON t.symbol = w.symbol AND t.rn = w.rn + 1),
b AS (SELECT t.symbol, run, min(t.ts_us) AS start_us, max(t.ts_us) AS end_us, CAST(sum(notional) AS BIGINT) AS notional,
             count(*) AS tick_count FROM epochs t JOIN walk w USING (symbol, rn) GROUP BY t.symbol, run
      HAVING sum(notional) >= {THRESHOLD})
SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY start_us) - 1 AS bar_idx, start_us, end_us, notional, tick_count FROM b""")
def _(spark, sf):
    t = src.tape(spark, sf)
    controls = src.table(spark, sf, "events").where("value >= 250").select(src.micros("ts").alias("ts_us"))
    return bars.resync_bars(t, controls, THRESHOLD).select("symbol", "bar_idx", "start_us", "end_us", "notional", "tick_count")


@query("split_bars", SPLIT_SQL + "SELECT * FROM split")
def _(spark, sf):
    b = split(spark, sf)
    return b.withColumn("volume", F.round("volume", 4)).withColumn("ofi", F.round("ofi", 4))


SCALE = 100
SCALED_T = 200_000


@query("split_bars_scaled", f"""WITH RECURSIVE {src.TICKS_SQL},
live AS (SELECT *, price * size // {SCALE} AS usd FROM ticks WHERE price > 0 AND size > 0 AND price * size // {SCALE} > 0),
placed AS (SELECT *, row_number() OVER w AS rn, CAST(sum(usd) OVER w AS BIGINT) AS hi FROM live
           WINDOW w AS (PARTITION BY symbol ORDER BY ts_us, trade_id)),
pieces AS (
  SELECT symbol, rn, trade_id, ts_us, price, hi, CAST(0 AS BIGINT) AS nth, (hi - usd) // {SCALED_T} AS bar_idx,
         least(usd, ((hi - usd) // {SCALED_T} + 1) * {SCALED_T} - (hi - usd)) AS part,
         usd AS left_usd, size AS left_qty FROM placed
  UNION ALL
  SELECT symbol, rn, trade_id, ts_us, price, hi, nth + 1, bar_idx + 1, least(left_usd - part, {SCALED_T}),
         left_usd - part, left_qty - left_qty * part // left_usd FROM pieces WHERE left_usd > part),
b AS (SELECT symbol, CAST(bar_idx AS BIGINT) AS bar_idx, min(ts_us) AS ts_open, max(ts_us) AS ts_close, arg_min(price, rn) AS open,
             max(price) AS high, min(price) AS low, arg_max(price, rn) AS close,
             CAST(sum(left_qty * part // left_usd) AS BIGINT) AS volume, CAST(sum(part) AS BIGINT) AS dollar_vol,
             arg_min(nth, rn) > 0 AS is_synthetic
      FROM pieces GROUP BY symbol, bar_idx HAVING sum(part) >= {SCALED_T}),
stats AS (
  SELECT symbol, bar_idx, CAST(close AS BIGINT) AS ema, CAST(1 AS HUGEINT) AS n, CAST(close AS HUGEINT) AS mean, CAST(0 AS HUGEINT) AS m2 FROM b WHERE bar_idx = 0
  UNION ALL
  SELECT b.symbol, b.bar_idx, (b.close * 2 + s.ema * 13) // 15, s.n + 1,
         s.mean + CAST(floor((b.close - s.mean) / (s.n + 1)) AS HUGEINT),
         s.m2 + (b.close - s.mean) * (b.close - (s.mean + CAST(floor((b.close - s.mean) / (s.n + 1)) AS HUGEINT)))
  FROM stats s JOIN b ON b.symbol = s.symbol AND b.bar_idx = s.bar_idx + 1)
SELECT b.*, s.ema, CAST(CASE WHEN s.n < 2 THEN 0 ELSE floor(s.m2 / (s.n - 1)) END AS BIGINT) AS variance
FROM b JOIN stats s USING (symbol, bar_idx)""")
def _(spark, sf):
    return bars.split_bars_scaled(src.ticks(spark, sf), SCALED_T, scale=SCALE)


TTL = 3_600_000_000 * 6


@query("hybrid_clock_buckets", f"""WITH RECURSIVE {src.TAPE_SQL},
flow AS (SELECT *, CASE WHEN side = 'Buy' THEN size ELSE -size END AS ofi FROM tape),
walk AS (
  SELECT symbol, rn, ts_us, notional AS volume, ofi, CAST(1 AS BIGINT) AS ticks, ts_us AS since FROM flow WHERE rn = 1
  UNION ALL
  SELECT t.symbol, t.rn, t.ts_us,
         CASE WHEN w.volume >= {THRESHOLD} OR w.ts_us - w.since >= {TTL} THEN 0 ELSE w.volume END + t.notional,
         CASE WHEN w.volume >= {THRESHOLD} OR w.ts_us - w.since >= {TTL} THEN 0 ELSE w.ofi END + t.ofi,
         CASE WHEN w.volume >= {THRESHOLD} OR w.ts_us - w.since >= {TTL} THEN 0 ELSE w.ticks END + 1,
         CASE WHEN w.volume >= {THRESHOLD} OR w.ts_us - w.since >= {TTL} THEN w.ts_us ELSE w.since END
  FROM walk w JOIN flow t ON t.symbol = w.symbol AND t.rn = w.rn + 1)
SELECT symbol, ts_us, volume, ofi, ticks, CASE WHEN volume >= {THRESHOLD} THEN 'VOLUME_TARGET' ELSE 'TTL_EXPIRY' END AS trigger,
       round(ofi / volume, 9) AS vnofi
FROM walk WHERE volume >= {THRESHOLD} OR (ts_us - since >= {TTL} AND volume * 10 >= {THRESHOLD} * 8)""")
def _(spark, sf):
    return bars.hybrid_clock_buckets(src.tape(spark, sf), THRESHOLD, TTL, ofi=signed_size()) \
        .drop("trade_id").withColumn("vnofi", F.round("vnofi", 9))


@query("ofi_divergence", RESET_SQL + """, d AS (
  SELECT symbol, bar_idx, end_us, CAST(sum(buy_notional - sell_notional) OVER (w ROWS 9 PRECEDING) AS BIGINT)
         - (close - lag(close, 9) OVER w) AS divergence
  FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY bar_idx))
SELECT *, divergence > 5e6 AS is_signal FROM d WHERE bar_idx >= 19""")
def _(spark, sf):
    return bars.ofi_divergence(reset(spark, sf), warmup=20, window=10)


MINUTE = 60_000_000


@query("conflate_ticks", f"""WITH {src.TICKS_SQL},
w AS (SELECT symbol, ts_us - ts_us % {60 * MINUTE} AS window_us, arg_max(price, ts_us) AS price, max(ts_us) AS ts_us,
             sum(CASE WHEN lower(side) = 'buy' THEN size ELSE 0 END) AS buy,
             sum(CASE WHEN lower(side) = 'buy' THEN 0 ELSE size END) AS sell FROM ticks GROUP BY ALL)
SELECT symbol, window_us, price, ts_us, 'Buy' AS side, CAST(buy AS BIGINT) AS volume FROM w WHERE buy > 0
UNION ALL SELECT symbol, window_us, price, ts_us, 'Sell', CAST(sell AS BIGINT) FROM w WHERE sell > 0""")
def _(spark, sf):
    return bars.conflate_ticks(src.ticks(spark, sf), 60 * MINUTE)


@query("conflated_events", f"""WITH {src.TICKS_SQL}
SELECT symbol, side, ts_us - ts_us % {60 * MINUTE} AS window_us, CAST(sum(size) AS BIGINT) AS total_volume, count(*) AS tick_count,
       min(ts_us) AS start_us, max(ts_us) AS end_us, (max(ts_us) - min(ts_us)) / 1000 AS duration_ms, round(avg(price), 6) AS avg_price
FROM ticks GROUP BY symbol, side, window_us""")
def _(spark, sf):
    return bars.conflated_events(src.ticks(spark, sf), 60 * MINUTE).withColumn("avg_price", F.round("avg_price", 6))


@query("throughput", f"""WITH {src.TICKS_SQL}
SELECT ts_us - ts_us % {60 * MINUTE} AS window_us, count(*) AS ticks, count(*) < 10 AS starving FROM ticks GROUP BY window_us""")
def _(spark, sf):
    return bars.throughput(src.ticks(spark, sf), window_us=60 * MINUTE)
