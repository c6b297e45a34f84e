"""Alerts: cooldown, payloads, and the outbox table they are written to."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeworks.operators.detectors import greedy_cooldown
from tapeworks.session import ensure_checkpoint_dir


def radar_alerts(signals: DataFrame, cooldown_us: int, *, n: int | None = None) -> DataFrame:
    """Anomalous bars, at most one per symbol within the cooldown."""
    hot = signals.where("is_anomaly").select("symbol", "bar_idx", "end_us", "open", "close", "vpin", "z_score", "direction", "absorption")
    return greedy_cooldown(hot, ["symbol"], cooldown_us, ts="end_us", tie="bar_idx", n=n)


def alert_payload(alerts: DataFrame) -> DataFrame:
    """Versioned JSON and a one-line text form of radar alerts."""
    body = F.to_json(F.struct(
        F.lit("RADAR_ALERT").alias("event_type"), F.lit(1).alias("version"), "symbol", "direction", "vpin", "z_score",
        "absorption", F.col("close").alias("bar_close"), F.col("open").alias("bar_open"),
        (F.col("end_us") / 1e6).alias("timestamp")))
    line = F.format_string("%s %s vpin=%.4f z=%.2f bar %d -> %d %s", F.col("symbol"), F.upper("direction"), F.col("vpin"),
                           F.col("z_score"), F.col("open"), F.col("close"),
                           F.when(F.col("absorption"), "absorbed").otherwise("clean"))
    return alerts.select("symbol", "end_us", body.alias("payload"), line.alias("text"))


def outbox_rows(alerts: DataFrame) -> DataFrame:
    """Pending outbox rows of alert payloads; the key makes repeated writes harmless."""
    return alert_payload(alerts).select(
        F.concat_ws(":", F.lit("RADAR_ALERT"), "symbol", F.col("end_us").cast("string")).alias("idempotency_key"),
        "payload", F.lit("PENDING").alias("status"), F.col("end_us").alias("created_us"),
        F.col("end_us").alias("execute_after_us"), F.lit(0).alias("retry_count"), F.lit(1).alias("priority"))


DAY_US = 86_400_000_000


def alert_sink(path: str):
    """``foreachBatch`` writer of outbox rows, each key once, however often a batch is run.

    Rows lie in folders by day and batch.  A batch overwrites its own folders and no others, so
    running it again changes nothing.  A key holds its alert's time: rows of an earlier batch
    with the same key can only lie in the days of this batch, and only these are read.
    """
    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        rows = batch.dropDuplicates(["idempotency_key"]).withColumn("day", F.floor(F.col("created_us") / DAY_US).cast("long"))
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        files = place.getFileSystem(spark._jsc.hadoopConfiguration())
        if files.exists(place):
            days = [r.day for r in rows.select("day").distinct().collect()]  # the days of one batch of alerts
            kept = [f"{path}/day={d}" for d in days if files.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/day={d}"))]
            if kept:
                schema = T.StructType([*batch.schema.fields, T.StructField("batch", T.LongType())])
                stored = spark.read.schema(schema).option("basePath", path).parquet(*kept).where(F.col("batch") != epoch).select("idempotency_key")
                rows = rows.join(stored, "idempotency_key", "left_anti")
        rows.withColumn("batch", F.lit(epoch).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(path)
    return write


def outbox(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """What the sink has stored."""
    return spark.read.schema(T.StructType([*schema.fields, T.StructField("day", T.LongType()), T.StructField("batch", T.LongType())])).parquet(path).drop("day", "batch")


def dedupe_signals(signals: DataFrame, *, key: str = "idempotency_key", order: tuple[str, ...] = ("created_us", "signal_id"),
                   ttl_us: int = 0) -> DataFrame:
    """First signal per key; later duplicates are dropped.  A partial aggregate, so a hot key shrinks before the shuffle."""
    rest = [c for c in signals.columns if c != key]
    first = F.min_by(F.struct(*rest), F.struct(*order))
    out = signals.groupBy(key).agg(first.alias("_f")).select(key, "_f.*")
    return out.withColumn("expires_us", F.col(order[0]) + ttl_us)


def pending_alerts(outbox: DataFrame, now_us: int, limit: int) -> DataFrame:
    """Next rows to deliver: due, by priority, then age."""
    due = outbox.where((F.col("status") == "PENDING") & (F.col("execute_after_us") <= now_us))
    return due.orderBy("priority", "created_us", "id").limit(limit)


def retry_schedule(outbox: DataFrame, attempts: DataFrame, delay_us: int) -> DataFrame:
    """Outbox after delivery attempts (``id, attempt_us, ok``).

    A delivered row leaves; a failed one waits ``delay_us`` after its last attempt.
    """
    tries = attempts.groupBy("id").agg(F.bool_or("ok").alias("delivered"), F.count(F.when(~F.col("ok"), 1)).alias("failures"),
                                       F.max("attempt_us").alias("last_us"))
    return (outbox.join(tries, "id", "left").where(~F.coalesce("delivered", F.lit(False)))
            .withColumn("retry_count", (F.col("retry_count") + F.coalesce("failures", F.lit(0))).cast("int"))
            .withColumn("execute_after_us", F.coalesce(F.col("last_us") + delay_us, F.col("execute_after_us")))
            .drop("delivered", "failures", "last_us"))


def expire_alerts(outbox: DataFrame, now_us: int) -> DataFrame:
    """Pending rows past their time become EXPIRED_DROPPED."""
    late = (F.col("status") == "PENDING") & (F.col("expires_us") < now_us)
    return outbox.withColumn("status", F.when(late, "EXPIRED_DROPPED").otherwise(F.col("status")))


def radar_metrics(tape: DataFrame, bars: DataFrame, signals: DataFrame, alerts: DataFrame, liquidity: DataFrame) -> DataFrame:
    """Counters of a radar run in one row."""
    parts = [tape.agg(F.count("*").alias("tick_count"), F.max("ts_us").alias("last_tick_us")),
             bars.agg(F.count("*").alias("bar_count"), F.count_distinct("symbol").alias("symbols_tracked")),
             signals.agg(F.count("*").alias("signal_count")), alerts.agg(F.count("*").alias("alert_count")),
             liquidity.agg(F.count("*").alias("liquidity_alert_count"))]
    names = [c for p in parts for c in p.columns]
    rows = None
    for p in parts:
        r = p.select(*[(F.col(c) if c in p.columns else F.lit(None)).cast("long").alias(c) for c in names])
        rows = r if rows is None else rows.unionByName(r)
    return rows.agg(*[F.max(c).alias(c) for c in names])


def counted(df: DataFrame, name: str, **metrics) -> tuple[DataFrame, dict]:
    """``df`` written once and read again, with metrics observed on the pass that writes it."""
    spark = df.sparkSession
    seen, path = Observation(name), f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.observe(seen, F.count(F.lit(1)).alias("rows"), *[c.alias(k) for k, c in metrics.items()]).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), seen.get


def pipeline_metrics(tape: DataFrame, make_bars, make_signals, make_alerts, make_liquidity) -> DataFrame:
    """Counters of a radar run in one row, each observed where the run writes a table anyway.

    The functions make one table from another: bars from ticks, signals from bars, alerts from
    signals, liquidity alerts from ticks.  Every table is planned and run once.
    """
    ticks, tick = counted(tape, "ticks", last=F.max("ts_us"))
    bars, bar = counted(make_bars(ticks), "bars", symbols=F.size(F.collect_set("symbol")))  # the markets, not their bars
    signals, signal = counted(make_signals(bars), "signals")
    _, alert = counted(make_alerts(signals), "alerts")
    _, liquid = counted(make_liquidity(ticks), "liquidity")
    row = (tick["rows"], tick["last"], bar["rows"], bar["symbols"], signal["rows"], alert["rows"], liquid["rows"])
    return tape.sparkSession.createDataFrame([row], "tick_count bigint, last_tick_us bigint, bar_count bigint, symbols_tracked bigint, signal_count bigint, alert_count bigint, liquidity_alert_count bigint")
