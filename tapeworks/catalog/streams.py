"""Streams over the event table, drained with the available-now trigger."""

from dataclasses import replace

from pyspark.sql import functions as F

from tapeworks.catalog import query
from tapeworks.catalog.alerts import ALERT_SQL, COOL
from tapeworks.catalog.bars import MINUTE, THRESHOLD
from tapeworks.catalog.detectors import BANK_SQL, LARGE, OFI, SWEEP, greedy_sql
from tapeworks.catalog.operators import silence_sql
from tapeworks.catalog.vpin import GAP, N, TAU, Z, ZT
from tapeworks.sources import tape as src
from tapeworks.streaming import batches
from tapeworks.streaming import queries as st
from tapeworks.streaming.steps import RadarParams

H = 3_600_000_000
LIMIT = 12 * H
PARAMS = RadarParams(threshold=THRESHOLD, window=N, z_threshold=ZT, z_history=Z, cooldown_us=COOL, sweep=SWEEP, large=LARGE, ofi=OFI,
                     liquidity_cooldown_us=LIMIT)


def live_ticks(spark, sf):
    """The event table as a stream, shaped by the same expressions as the batch tape."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    schema = src.table(spark, sf, "events").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").option("maxBytesPerTrigger", 1 << 30).parquet(sf)
    return src.shape_ticks(raw)


RADAR_SQL = (BANK_SQL.rstrip() + ALERT_SQL[ALERT_SQL.index(",\nwalk AS ("):].replace("walk", "barwalk") + f""",
{greedy_sql('thin', 'bank', LIMIT, key='kind, symbol')}
SELECT 'VPIN' AS kind, symbol, end_us AS ts_us, bar_idx AS ref_id, direction, close AS price, round(vpin, 6) AS vpin, round(z_score, 5) AS z_score, absorption FROM radar
UNION ALL SELECT kind, symbol, ts_us, trade_id, direction, price, 0, CASE WHEN kind = 'OFI_PULSE' THEN ratio_to_median ELSE 0 END, false FROM thin""")


@query("stream_radar", RADAR_SQL)
def _(spark, sf):
    t = live_ticks(spark, sf).where("notional > 0").join(src.turnover(spark, sf), "symbol", "left")
    out = st.drain(st.stream_radar(t, PARAMS), name="radar")
    z = F.when(F.col("kind") == "VPIN", F.round("z_score", 5)).otherwise(F.round("z_score", 6))
    return out.select("kind", "symbol", "ts_us", "ref_id", "direction", "price", F.round("vpin", 6).alias("vpin"), z.alias("z_score"), "absorption")


LARGER = 2 * THRESHOLD  # bar size of the last tick in ten

# Bars whose size changes with the tick, and toxicity that fades in silences, stated over pairs of bars.
BATCHES_SQL = BANK_SQL + f""",
sized AS (SELECT *, CASE WHEN trade_id % 10 = 9 THEN {LARGER} ELSE {THRESHOLD} END AS threshold FROM tape),
barwalk AS (
  SELECT symbol, rn, notional AS held, notional >= threshold AS closed, CAST(0 AS BIGINT) AS bar_idx FROM sized WHERE rn = 1
  UNION ALL
  SELECT t.symbol, t.rn, CASE WHEN w.closed THEN 0 ELSE w.held END + t.notional, CASE WHEN w.closed THEN 0 ELSE w.held END + t.notional >= t.threshold,
         CASE WHEN w.closed THEN w.bar_idx + 1 ELSE w.bar_idx END
  FROM barwalk w JOIN sized t ON t.symbol = w.symbol AND t.rn = w.rn + 1),
bars AS (
  SELECT t.symbol, bar_idx, arg_min(price, rn) AS open, arg_max(price, rn) AS close, max(ts_us) AS end_us,
         sum(CASE WHEN side = 'Buy' THEN notional ELSE -notional END) AS lean FROM sized t JOIN barwalk w USING (symbol, rn) GROUP BY t.symbol, bar_idx HAVING bool_or(closed)),
lost AS (SELECT *, close - lag(close, {N - 1}) OVER w AS move, CASE WHEN end_us - lag(end_us) OVER w > {GAP} THEN (end_us - lag(end_us) OVER w) / (3600e6 * {TAU}) ELSE 0 END AS lost
  FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY bar_idx)),
faded AS (SELECT *, sum(lost) OVER (PARTITION BY symbol ORDER BY bar_idx) AS g FROM lost),
toxic AS (SELECT a.symbol, a.bar_idx, any_value(a.g) AS g, least(sum(abs(b.lean) * exp(b.g - a.g)) / ({THRESHOLD}.0 * {N}), 1.0) AS v
  FROM faded a JOIN faded b ON a.symbol = b.symbol AND b.bar_idx BETWEEN a.bar_idx - {N - 1} AND a.bar_idx WHERE a.bar_idx >= {N - 1} GROUP BY a.symbol, a.bar_idx),
spread AS (SELECT a.symbol, a.bar_idx, any_value(a.v) AS v, avg(b.v * exp(b.g - a.g)) AS m, avg((b.v * exp(b.g - a.g)) * (b.v * exp(b.g - a.g))) AS s
  FROM toxic a JOIN toxic b ON a.symbol = b.symbol AND b.bar_idx BETWEEN a.bar_idx - {Z - 1} AND a.bar_idx GROUP BY a.symbol, a.bar_idx),
hot AS (SELECT symbol, bar_idx, end_us, close, v AS vpin, (v - m) / sqrt(greatest(s - m * m, 1e-12)) AS z_score, (lean > 0 AND move <= 0) OR (lean < 0 AND move >= 0) AS absorption,
         CASE WHEN lean > 0 THEN 'long' WHEN lean < 0 THEN 'short' ELSE 'neutral' END AS direction
  FROM spread JOIN faded USING (symbol, bar_idx) WHERE (v - m) / sqrt(greatest(s - m * m, 1e-12)) > {ZT}),
{greedy_sql('radar', 'hot', COOL, ts='end_us', tie='bar_idx')},
{greedy_sql('thin', 'bank', LIMIT, key='kind, symbol')}
SELECT 'VPIN' AS kind, symbol, end_us AS ts_us, bar_idx AS ref_id, direction, close AS price, round(vpin, 6) AS vpin, round(z_score, 5) AS z_score, absorption FROM radar
UNION ALL SELECT kind, symbol, ts_us, trade_id, direction, price, 0, CASE WHEN kind = 'OFI_PULSE' THEN ratio_to_median ELSE 0 END, false FROM thin"""


@query("stream_radar_batches", BATCHES_SQL)
def _(spark, sf):
    """The radar over micro-batches, with a bar size of the tick's own and histories that fade."""
    size = F.when(F.col("trade_id") % 10 == 9, LARGER).otherwise(THRESHOLD)
    t = live_ticks(spark, sf).where("notional > 0").join(src.turnover(spark, sf), "symbol", "left").withColumn("threshold", size)
    out = batches.run_batches(t, replace(PARAMS, decay_gap_us=GAP, tau_hours=TAU))
    z = F.when(F.col("kind") == "VPIN", F.round("z_score", 5)).otherwise(F.round("z_score", 6))
    return out.select("kind", "symbol", "ts_us", "ref_id", "direction", "price", F.round("vpin", 6).alias("vpin"), z.alias("z_score"), "absorption")


@query("stream_conflate", f"""WITH {src.TICKS_SQL},
w AS (SELECT symbol, ts_us - ts_us % {60 * MINUTE} AS window_us, arg_max(price, ts_us) AS price, max(ts_us) AS ts_us,
             sum(CASE WHEN lower(side) = 'buy' THEN size ELSE 0 END) AS buy, sum(CASE WHEN lower(side) = 'buy' THEN 0 ELSE size END) AS sell
      FROM ticks GROUP BY symbol, ts_us - ts_us % {60 * MINUTE}),
done AS (SELECT * FROM w WHERE window_us + {60 * MINUTE} <= (SELECT max(ts_us) FROM ticks))
SELECT symbol, window_us, price, ts_us, 'Buy' AS side, CAST(buy AS BIGINT) AS volume FROM done WHERE buy > 0
UNION ALL SELECT symbol, window_us, price, ts_us, 'Sell', CAST(sell AS BIGINT) FROM done WHERE sell > 0""")
def _(spark, sf):
    return st.drain(st.stream_conflate(live_ticks(spark, sf), "1 hour"), name="conflate")


@query("stream_ofi_buckets", f"""WITH {src.TAPE_SQL} SELECT symbol, ts_us - ts_us % {2 * H} AS bucket_us, CAST(sum(CASE WHEN side = 'Sell' THEN -notional ELSE notional END) AS BIGINT) AS ofi, count(*) AS ticks
FROM tape GROUP BY 1, 2 HAVING ts_us - ts_us % {2 * H} + {2 * H} <= (SELECT max(ts_us) FROM tape)""".replace("GROUP BY 1, 2 HAVING ts_us - ts_us %", "GROUP BY symbol, ts_us - ts_us %").replace(f"{2 * H} + {2 * H} <= (SELECT", f"{2 * H} HAVING ts_us - ts_us % {2 * H} + {2 * H} <= (SELECT"))
def _(spark, sf):
    return st.drain(st.stream_ofi_buckets(live_ticks(spark, sf).where("notional > 0"), "2 hours"), name="ofi")


def episodes(limit: int, key: str) -> str:
    """Blindness and recovery events with the data ending in silence left out."""
    inner = silence_sql(key, limit)
    col = key or "'feed'"
    return f"""s AS (SELECT * FROM {inner}) SELECT {col} AS key, 'PARTIAL_BLINDNESS' AS event, ts_us + {limit} AS ts_us FROM s WHERE cleared_us IS NOT NULL
UNION ALL SELECT {col}, 'PARTIAL_BLINDNESS_CLEARED', cleared_us FROM s WHERE cleared_us IS NOT NULL"""


@query("stream_silence", f"""WITH b AS (SELECT epoch_us(ts) AS ts_us, event_id FROM events WHERE epoch_us(ts) // 1000000 < (SELECT max(epoch_us(ts)) // 1000000 - 1 FROM events)), {episodes(900_000_000, '')}
UNION ALL SELECT 'feed', 'PARTIAL_BLINDNESS', ts_us + 900000000 FROM s WHERE cleared_us IS NULL AND ts_us + 900000000 < (SELECT max(epoch_us(ts)) - 2000000 FROM events)""")
def _(spark, sf):
    return st.drain(st.stream_silence(live_ticks(spark, sf), 900_000_000), name="silence")


@query("stream_flatline", f"""WITH {src.TICKS_SQL}, b AS (SELECT symbol, ts_us, trade_id AS event_id FROM ticks WHERE symbol <> 'S7' AND ts_us // 1000000 < (SELECT max(ts_us) // 1000000 - 1 FROM ticks WHERE symbol <> 'S7')),
{episodes(2 * H, 'symbol')} UNION ALL SELECT symbol, 'PARTIAL_BLINDNESS', ts_us + {2 * H} FROM s WHERE cleared_us IS NULL AND ts_us + {2 * H} < (SELECT max(ts_us) - 2000000 FROM ticks WHERE symbol <> 'S7')""")
def _(spark, sf):
    active = live_ticks(spark, sf).where("symbol <> 'S7'")
    return st.drain(st.stream_silence(active, 2 * H, key="symbol"), name="flatline")


HALF = 1_705_276_800_000_000


@query("state_seed", f"SELECT kind, symbol, ts_us, ref_id, direction, price FROM ({RADAR_SQL}) WHERE ts_us >= {HALF}")
def _(spark, sf):
    t = live_ticks(spark, sf).where("notional > 0").join(src.turnover(spark, sf), "symbol", "left").where(F.col("ts_us") >= HALF)
    past = src.tape(spark, sf).where(F.col("ts_us") < HALF).join(src.turnover(spark, sf), "symbol", "left")
    out = st.drain(st.stream_radar(t, PARAMS, past.select(*t.columns)), name="seeded")
    return out.select("kind", "symbol", "ts_us", "ref_id", "direction", "price")
