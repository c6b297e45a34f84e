"""Alert rows and the outbox."""

import uuid

from pyspark.sql import functions as F

from tapeworks.catalog import query
from tapeworks.catalog.bars import THRESHOLD
from tapeworks.catalog.detectors import BANK_SQL, HOUR, LARGE, OFI, SWEEP, bank_of, greedy_sql
from tapeworks.catalog.vpin import SIGNAL_SQL, ZT, N, Z, signals
from tapeworks.operators import alerts, bars, vpin
from tapeworks.operators import detectors as det
from tapeworks.session import ensure_checkpoint_dir
from tapeworks.sources import tape as src

COOL = 12 * HOUR
ALERT_SQL = SIGNAL_SQL + f""", hot AS (SELECT symbol, bar_idx, end_us, open, close, vpin, z_score, direction, absorption FROM signals WHERE is_anomaly),
{greedy_sql('radar', 'hot', COOL, ts='end_us', tie='bar_idx')}
"""


def radar(spark, sf):
    return alerts.radar_alerts(signals(spark, sf), COOL)


@query("radar_alerts", ALERT_SQL + "SELECT * REPLACE (round(vpin, 6) AS vpin, round(z_score, 5) AS z_score) FROM radar")
def _(spark, sf):
    return radar(spark, sf).withColumn("vpin", F.round("vpin", 6)).withColumn("z_score", F.round("z_score", 5))


@query("alert_payload", ALERT_SQL + """SELECT symbol, end_us, 'RADAR_ALERT' AS event_type, CAST(1 AS BIGINT) AS version, direction, round(vpin, 6) AS vpin,
  absorption, close AS bar_close, open AS bar_open, round(end_us / 1e6, 3) AS timestamp,
  printf('%s %s vpin=%.4f z=%.2f bar %d -> %d %s', symbol, upper(direction), vpin, z_score, open, close,
         CASE WHEN absorption THEN 'absorbed' ELSE 'clean' END) AS text FROM radar""")
def _(spark, sf):
    body = F.from_json("payload", "event_type STRING, version BIGINT, direction STRING, vpin DOUBLE, absorption BOOLEAN, "
                                  "bar_close BIGINT, bar_open BIGINT, timestamp DOUBLE")
    return alerts.alert_payload(radar(spark, sf)).withColumn("_b", body).select("symbol", "end_us", "text", "_b.*") \
        .withColumn("vpin", F.round("vpin", 6)).withColumn("timestamp", F.round("timestamp", 3))


@query("alert_sink", ALERT_SQL + """SELECT 'RADAR_ALERT:' || symbol || ':' || end_us AS idempotency_key, 'PENDING' AS status,
  end_us AS created_us, end_us AS execute_after_us, CAST(0 AS INTEGER) AS retry_count, CAST(1 AS INTEGER) AS priority FROM radar""")
def _(spark, sf):
    """Rows as the sink stored them, from two batches that overlap and one of them run again."""
    rows = alerts.outbox_rows(radar(spark, sf)).checkpoint()
    path = f"{ensure_checkpoint_dir(spark)}/outbox-{uuid.uuid4().hex}"
    write = alerts.alert_sink(path)
    for part, epoch in ((rows.where("created_us % 3 < 2"), 0), (rows.where("created_us % 3 > 0"), 1), (rows.where("created_us % 3 < 2"), 0)):
        write(part, epoch)
    return alerts.outbox(spark, path, rows.schema).drop("payload")


METRICS_SQL = (BANK_SQL.replace("bank AS (", "bank AS (").rstrip() + SIGNAL_SQL[SIGNAL_SQL.index(",\nwalk AS ("):].replace("walk", "barwalk") +
       f""", hot AS (SELECT symbol, bar_idx, end_us FROM signals WHERE is_anomaly), {greedy_sql('radar', 'hot', COOL, ts='end_us', tie='bar_idx')}
SELECT (SELECT count(*) FROM tape) AS tick_count, (SELECT max(ts_us) FROM tape) AS last_tick_us, (SELECT count(*) FROM bars) AS bar_count,
  (SELECT count(DISTINCT symbol) FROM bars) AS symbols_tracked, (SELECT count(*) FROM signals) AS signal_count,
  (SELECT count(*) FROM radar) AS alert_count, (SELECT count(*) FROM bank) AS liquidity_alert_count""")


@query("radar_metrics", METRICS_SQL)
def _(spark, sf):
    """Ticks, bars and signals are read by several counters and steps, so each is stored once."""
    ensure_checkpoint_dir(spark)
    ticks = src.tape(spark, sf).checkpoint(eager=True)
    made = bars.dollar_bars(ticks, THRESHOLD).checkpoint(eager=True)
    found = vpin.vpin_signals(made, window=N, base_threshold=THRESHOLD, z_threshold=ZT, z_history=Z).checkpoint(eager=True)
    return alerts.radar_metrics(ticks, made, found, alerts.radar_alerts(found, COOL), bank_of(ticks))


@query("pipeline_metrics", METRICS_SQL)
def _(spark, sf):
    return alerts.pipeline_metrics(
        src.tape(spark, sf), lambda t: bars.dollar_bars(t, THRESHOLD),
        lambda b: vpin.vpin_signals(b, window=N, base_threshold=THRESHOLD, z_threshold=ZT, z_history=Z), lambda s: alerts.radar_alerts(s, COOL),
        lambda t: det.liquidity_bank(det.sweep(t, **SWEEP), det.large_print(t, t.groupBy("symbol").agg(F.sum("notional").alias("turnover")), **LARGE), det.ofi_pulse(t, **OFI)))


# Orders stand in for outbox rows: status P is pending, the priority text starts with its rank.
OUTBOX_SQL = """outbox AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'P' THEN 'PENDING' WHEN 'O' THEN 'PROCESSING' ELSE 'SENT' END AS status,
  epoch_us(o_orderdate) AS created_us, epoch_us(o_orderdate) + (o_custkey % 10) * 86400000000 AS execute_after_us,
  CAST(o_custkey % 3 AS INTEGER) AS retry_count, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS priority,
  epoch_us(o_orderdate) + 30 * CAST(86400000000 AS BIGINT) AS expires_us FROM orders)"""


def outbox(spark, sf):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    created = src.micros("o_orderdate")
    return src.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.when(F.col("o_orderstatus") == "P", "PENDING").when(F.col("o_orderstatus") == "O", "PROCESSING").otherwise("SENT").alias("status"),
        created.alias("created_us"), (created + (F.col("o_custkey") % 10) * 86_400_000_000).alias("execute_after_us"),
        (F.col("o_custkey") % 3).cast("int").alias("retry_count"), F.substring("o_orderpriority", 1, 1).cast("int").alias("priority"),
        (created + 30 * 86_400_000_000).alias("expires_us"))


NOW = 901_929_600_000_000  # 1998-08-01


@query("pending_alerts", f"""WITH {OUTBOX_SQL} SELECT * FROM outbox WHERE status = 'PENDING' AND execute_after_us <= {NOW}
ORDER BY priority, created_us, id LIMIT 100""")
def _(spark, sf):
    return alerts.pending_alerts(outbox(spark, sf), NOW, 100)


@query("retry_schedule", f"""WITH {OUTBOX_SQL},
tries AS (SELECT l_orderkey AS id, bool_or(l_returnflag = 'A') AS delivered, count(*) FILTER (l_returnflag <> 'A') AS failures,
                 max(epoch_us(l_shipdate)) AS last_us FROM lineitem GROUP BY l_orderkey)
SELECT id, status, created_us, coalesce(last_us + 10000000, execute_after_us) AS execute_after_us,
       CAST(retry_count + coalesce(failures, 0) AS INTEGER) AS retry_count, priority, expires_us
FROM outbox LEFT JOIN tries USING (id) WHERE NOT coalesce(delivered, false)""")
def _(spark, sf):
    box = outbox(spark, sf)
    tries = src.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("id"), src.micros("l_shipdate").alias("attempt_us"), (F.col("l_returnflag") == "A").alias("ok"))
    return alerts.retry_schedule(box, tries, 10_000_000)


@query("expire_alerts", f"""WITH {OUTBOX_SQL} SELECT CASE WHEN status = 'PENDING' AND expires_us < {NOW} THEN 'EXPIRED_DROPPED' ELSE status END AS status,
  count(*) AS rows FROM outbox GROUP BY 1""")
def _(spark, sf):
    return alerts.expire_alerts(outbox(spark, sf), NOW).groupBy("status").agg(F.count("*").alias("rows"))


@query("dedupe_signals", f"""WITH {src.TICKS_SQL}, s AS (SELECT symbol || ':' || side || ':' || (ts_us // {HOUR}) AS idempotency_key, trade_id AS signal_id, symbol, ts_us AS created_us FROM ticks)
SELECT idempotency_key, signal_id, symbol, created_us, created_us + 60000000 AS expires_us
FROM (SELECT *, row_number() OVER (PARTITION BY idempotency_key ORDER BY created_us, signal_id) AS n FROM s) WHERE n = 1""")
def _(spark, sf):
    key = F.concat_ws(":", "symbol", "side", F.floor(F.col("ts_us") / HOUR).cast("string"))
    s = src.ticks(spark, sf).select(key.alias("idempotency_key"), F.col("trade_id").alias("signal_id"), "symbol", F.col("ts_us").alias("created_us"))
    return alerts.dedupe_signals(s, ttl_us=60_000_000)
