"""The operator's clicks, permits, attention and chat."""

from pyspark.sql import functions as F

from tapeworks.catalog import query
from tapeworks.operators import operators as ops
from tapeworks.sources import tape as src

H = 3_600_000_000
TTL = 4 * H
CLICK_SQL = f"""{src.TICKS_SQL}, e AS (SELECT symbol AS desk, ts_us, trade_id AS event_id, CASE trade_id % 7 WHEN 0 THEN 'emit' WHEN 3 THEN 'revoke' ELSE 'click' END AS kind,
  CASE WHEN trade_id % 7 = 0 THEN trade_id END AS own, trade_id, row_number() OVER (PARTITION BY symbol ORDER BY ts_us, trade_id) AS rn FROM ticks),
c AS (SELECT desk, ts_us, event_id, kind, rn, CASE kind WHEN 'emit' THEN trade_id WHEN 'click' THEN coalesce(last_value(own IGNORE NULLS) OVER (PARTITION BY desk ORDER BY rn), 0) - CASE WHEN trade_id % 5 = 0 THEN 7 ELSE 0 END END AS intent_id FROM e)"""


def desk_events(spark, sf):
    from tapeworks.plans.slices import running
    t = src.ticks(spark, sf)
    k = F.col("trade_id")
    e = t.select(F.col("symbol").alias("desk"), "ts_us", k.alias("event_id"), F.when(k % 7 == 0, "emit").when(k % 7 == 3, "revoke").otherwise("click").alias("kind"),
                 F.when(k % 7 == 0, k).alias("own"))
    last = running(e, ["desk"], ["ts_us", "event_id"], {"shown": ("last", F.col("own"))}).drop("_slice")
    ref = F.when(F.col("kind") == "emit", F.col("event_id")).when(F.col("kind") == "click", F.coalesce("shown", F.lit(0)) - F.when(F.col("event_id") % 5 == 0, 7).otherwise(0))
    return last.select("desk", "ts_us", "event_id", "kind", F.coalesce(ref, F.lit(-1)).cast("long").alias("intent_id"))


@query("click_audit", f"""WITH RECURSIVE {CLICK_SQL},
w AS (SELECT desk, rn, ts_us, event_id, kind, intent_id, CASE WHEN kind = 'emit' THEN intent_id END AS cur, CASE WHEN kind = 'emit' THEN ts_us END AS since, false AS revoked,
    CASE WHEN kind = 'emit' THEN 1 ELSE 0 END AS version, CASE WHEN kind = 'click' THEN 'NO_ACTIVE' END AS verdict FROM c WHERE rn = 1
  UNION ALL SELECT desk, rn, ts_us, event_id, kind, intent_id, CASE WHEN kind = 'emit' THEN intent_id ELSE cur END, CASE WHEN kind = 'emit' THEN ts_us ELSE since END,
    CASE WHEN kind = 'emit' THEN false WHEN kind = 'revoke' THEN cur IS NOT NULL ELSE revoked OR coalesce(v = 'TTL_EXPIRED', false) END,
    version + CASE WHEN kind = 'emit' OR (kind = 'revoke' AND cur IS NOT NULL AND NOT revoked) OR coalesce(v = 'TTL_EXPIRED', false) THEN 1 ELSE 0 END, v
  FROM (SELECT t.desk, t.rn, t.ts_us, t.event_id, t.kind, t.intent_id, w.cur, w.since, w.revoked, w.version,
    CASE WHEN t.kind <> 'click' THEN NULL WHEN w.cur IS NULL THEN 'NO_ACTIVE' WHEN t.intent_id <> w.cur THEN 'STALE' WHEN w.revoked THEN 'REVOKED' WHEN t.ts_us - w.since > {TTL} THEN 'TTL_EXPIRED' ELSE 'OK' END AS v
    FROM w JOIN c t ON t.desk = w.desk AND t.rn = w.rn + 1))
SELECT desk, ts_us, event_id, intent_id, verdict, CAST(version AS BIGINT) AS version FROM w WHERE kind = 'click'""")
def _(spark, sf):
    return ops.click_audit(desk_events(spark, sf), ttl_us=TTL)


@query("capsule_audit", f"""WITH {src.TICKS_SQL}, s AS (SELECT trade_id AS submission_id, trade_id // 3 * 3 AS nonce, ts_us, trade_id % 4 AS cur, trade_id % 19 = 0 AS locked FROM ticks),
i AS (SELECT trade_id AS nonce, ts_us + (trade_id % 8 - 2) * 60000000 AS issued, trade_id % 4 AS gen FROM ticks WHERE trade_id % 3 = 0 AND trade_id % 10 <> 0),
j AS (SELECT s.*, CASE WHEN issued IS NULL THEN 'UNKNOWN_NONCE' WHEN ts_us - issued > 600000000 THEN 'TTL_EXPIRED' WHEN ts_us - issued < -100000000 THEN 'CLOCK_MANIPULATION' WHEN gen <> cur AND submission_id % 2 = 0 THEN 'TILT_GEN_MISMATCH'
  WHEN locked THEN 'TILT_LOCKED' ELSE 'OK' END AS r FROM s LEFT JOIN i USING (nonce)),
f AS (SELECT nonce, min(ts_us) AS first_us FROM j WHERE r = 'OK' GROUP BY nonce)
SELECT submission_id, CASE WHEN ts_us > first_us THEN 'NONCE_REPLAY' ELSE r END AS verdict FROM j LEFT JOIN f USING (nonce)""")
def _(spark, sf):
    return capsules(spark, sf).select("submission_id", "verdict")


def capsules(spark, sf):
    t, k = src.ticks(spark, sf), F.col("trade_id")
    iss = t.where((k % 3 == 0) & (k % 10 != 0)).select(k.alias("nonce"), (F.col("ts_us") + (k % 8 - 2) * 60_000_000).alias("issued_us"), (k % 4).alias("tilt_generation"))
    nonce = F.floor(k / 3) * 3
    gen = F.when(k % 2 == 0, k % 4).otherwise(nonce % 4)
    sub = t.select(k.alias("submission_id"), nonce.alias("nonce"), "ts_us", gen.alias("current_generation"), (k % 19 == 0).alias("locked"))
    return ops.capsule_audit(sub, iss, ttl_us=600_000_000, skew_us=100_000_000)


BEATS_COLS = ("operator_id", "ts_us", "beat_id", "reaction_ms", "click_count", "error_delta", "success_delta")


def beats(spark, sf):
    """Heartbeats per user; hours become seconds so that the time constants matter."""
    e = src.table(spark, sf, "events")
    k = F.col("event_id")
    return e.select(F.col("user_id").alias("operator_id"), F.floor(src.micros("ts") / 3600).alias("ts_us"), k.alias("beat_id"), (F.col("value") * 20).alias("reaction_ms"),
                    F.when(F.col("event_type") == "click", k % 9).otherwise(0).cast("int").alias("click_count"),
                    F.when(F.col("event_type") == "error", 2).otherwise(0).alias("error_delta"), F.when(F.col("event_type") == "purchase", 1).otherwise(0).alias("success_delta"))


HEART_SQL = """WITH RECURSIVE b AS (SELECT user_id AS op, epoch_us(ts) // 3600 AS ts, event_id AS id, value * 20 AS ms, CASE WHEN event_type = 'click' THEN event_id % 9 ELSE 0 END AS c,
  CASE WHEN event_type = 'error' THEN 2 ELSE 0 END AS err, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS win, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
w AS (
  SELECT DISTINCT op, CAST(0 AS BIGINT) AS rn, CAST(0 AS BIGINT) AS ts, CAST(0 AS BIGINT) AS id, CAST(0 AS BIGINT) AS n, 0::DOUBLE AS last, 0::DOUBLE AS ewma, 5::DOUBLE AS tokens, CAST(NULL AS BIGINT) AS refill,
         CAST([] AS BIGINT[]) AS burst, CAST(0 AS BIGINT) AS rapid, CAST(NULL AS BIGINT) AS since, CAST(0 AS BIGINT) AS streak, 'CLEAR' AS mode, CAST(0 AS BIGINT) AS until, 0::DOUBLE AS drift, 0::DOUBLE AS spam, 0::DOUBLE AS score FROM b
  UNION ALL
  SELECT op, rn, ts, id, n, last, ewma, tokens, refill, burst, rapid, since, streak,
    CASE WHEN mode NOT IN ('CLEAR', 'ELEVATED') THEN mode WHEN score >= 0.7 THEN 'LOCKED' WHEN score >= 0.4 THEN 'ELEVATED' WHEN score < 0.35 THEN 'CLEAR' ELSE mode END,
    CASE WHEN mode IN ('CLEAR', 'ELEVATED') AND score >= 0.7 THEN ts + 60000000 ELSE until END, drift, spam, score
  FROM (SELECT *, least(1.0, greatest(0.0, 0.4 * least(drift / 2.0, 1.0) + 0.35 * least(streak / 4.0, 1.0) + 0.25 * least(spam / 5.0, 1.0))) AS score
    FROM (SELECT *, CASE WHEN n >= 5 AND ewma > 0 THEN abs(last - ewma) / ewma ELSE 0 END AS drift,
        (1.0 - tokens / 5.0) * 2.0 + greatest(0.0, len(list_filter(burst, lambda m: ts - m <= 500000)) - 2) / 3.0 * 3.0 + greatest(0.0, rapid / greatest(0.1, (ts - coalesce(since, 0)) / 1e6) - 0.5) AS spam
      FROM (SELECT op, rn, ts, id, CASE WHEN fresh THEN 0 ELSE n END AS n, CASE WHEN fresh THEN 0 ELSE last END AS last, CASE WHEN fresh THEN 0 ELSE ewma END AS ewma, CASE WHEN fresh THEN 5 ELSE tokens END AS tokens,
          CASE WHEN NOT fresh THEN refill END AS refill, CASE WHEN fresh THEN CAST([] AS BIGINT[]) ELSE burst END AS burst, CASE WHEN fresh THEN 0 ELSE rapid END AS rapid, CASE WHEN NOT fresh THEN since END AS since,
          CASE WHEN fresh THEN 0 ELSE streak END AS streak, CASE WHEN fresh THEN 'CLEAR' ELSE mode END AS mode, CASE WHEN fresh THEN 0 ELSE until END AS until
        FROM (SELECT *, mode = 'COOLDOWN' AND ts >= until AS fresh
          FROM (SELECT t.op, t.rn, t.ts, t.id, CASE WHEN t.ms > 0 AND t.ms < 30000 THEN least(w.n + 1, 20) ELSE w.n END AS n, CASE WHEN t.ms > 0 AND t.ms < 30000 THEN t.ms ELSE w.last END AS last,
              CASE WHEN t.ms > 0 AND t.ms < 30000 THEN CASE WHEN w.ewma = 0 THEN t.ms ELSE 0.15::DOUBLE * t.ms + 0.85::DOUBLE * w.ewma END ELSE w.ewma END AS ewma,
              CASE WHEN t.c > 0 THEN greatest(0.0, least(5.0, w.tokens + greatest(0, t.ts - coalesce(w.refill, t.ts)) / 1e6) - t.c) ELSE w.tokens END AS tokens, CASE WHEN t.c > 0 THEN t.ts ELSE w.refill END AS refill,
              CASE WHEN t.c > 0 THEN list_concat(w.burst, list_transform(range(0, t.c), lambda k: t.ts))[-10:] ELSE w.burst END AS burst,
              CASE WHEN t.c > 0 THEN CASE WHEN t.ts - coalesce(w.since, t.ts) > 10000000 THEN 0 ELSE w.rapid END + t.c ELSE w.rapid END AS rapid,
              CASE WHEN t.c > 0 THEN CASE WHEN t.ts - coalesce(w.since, t.ts) > 10000000 THEN t.ts ELSE coalesce(w.since, t.ts) END ELSE w.since END AS since,
              CASE WHEN t.win > 0 THEN greatest(0, w.streak + t.err - 2 * t.win) ELSE w.streak + t.err END AS streak, CASE WHEN w.mode = 'LOCKED' THEN 'COOLDOWN' ELSE w.mode END AS mode, w.until
            FROM w JOIN b t ON t.op = w.op AND t.rn = w.rn + 1))))))
SELECT op AS operator_id, ts AS ts_us, id AS beat_id, round(drift, 4) AS reaction_drift, streak AS error_streak, round(spam, 4) AS spam_intensity, round(score, 4) AS composite, mode AS state, until AS locked_until_us FROM w WHERE rn > 0"""


@query("heartbeat_score", HEART_SQL)
def _(spark, sf):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return ops.heartbeat_score(beats(spark, sf))


def silence_sql(key: str, limit: int, ts: str = "ts_us") -> str:
    sel = f"{key} AS k, " if key else ""
    part = f"PARTITION BY {key} " if key else ""
    return f"""(SELECT *, lead({ts}) OVER ({part}ORDER BY {ts}, event_id) AS cleared_us FROM b)
WHERE cleared_us IS NULL OR cleared_us - {ts} > {limit}"""


@query("heartbeat_blind", f"""WITH b AS (SELECT user_id AS operator_id, epoch_us(ts) // 3600 AS ts_us, event_id FROM events)
SELECT operator_id, ts_us AS last_us, ts_us + 50000000 AS noticed_us, cleared_us FROM {silence_sql('operator_id', 50_000_000)}""")
def _(spark, sf):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return ops.heartbeat_blind(beats(spark, sf), 50_000_000)


@query("stream_silence_gaps", f"""WITH b AS (SELECT epoch_us(ts) AS ts_us, event_id FROM events)
SELECT ts_us AS last_us, ts_us + 900000000 AS noticed_us, cleared_us FROM {silence_sql('', 900_000_000)}""")
def _(spark, sf):
    return ops.silences(src.ticks(spark, sf).withColumnRenamed("trade_id", "event_id"), [], 900_000_000)


@query("stream_flatline_gaps", f"""WITH {src.TICKS_SQL}, b AS (SELECT symbol, ts_us, trade_id AS event_id FROM ticks WHERE symbol <> 'S7')
SELECT symbol, ts_us AS last_us, ts_us + {2 * H} AS noticed_us, cleared_us FROM {silence_sql('symbol', 2 * H)}""")
def _(spark, sf):
    active = src.ticks(spark, sf).where("symbol <> 'S7'").withColumnRenamed("trade_id", "event_id")
    return ops.silences(active, ["symbol"], 2 * H)


@query("chat_history", """SELECT conv_id AS session_id, turn AS msg_id, role, text AS content, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS position
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations) WHERE back <= 5""")
def _(spark, sf):
    m = src.table(spark, sf, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("msg_id"), "role", F.col("text").alias("content"))
    return ops.chat_history(m, 5)
