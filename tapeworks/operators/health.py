"""Feed and infrastructure health, clocks, and market heat."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeworks.operators.regime import first_in_range
from tapeworks.plans.folds import fold
from tapeworks.plans.scans import Step, affine_scan, scan
from tapeworks.plans.slices import SLICE, asof, blocks, dense_index, previous, running, slice_rows


def clock_offset(pings: DataFrame, *, max_rtt_ms: float = 1000.0, max_offset_ms: float = 500.0, keys: list[str] | None = None) -> DataFrame:
    """Mean clock offset per group over pings (``t0_ms, server_ms, rtt_ms``) that were fast enough."""
    ok = pings.where(F.col("rtt_ms") <= max_rtt_ms)
    offset = F.col("server_ms") - (F.col("t0_ms") + F.col("rtt_ms") / 2)
    return ok.groupBy(*(keys or [])).agg(F.avg(offset).alias("offset_ms"), F.count("*").alias("samples")) \
        .withColumn("unacceptable", F.abs("offset_ms") > max_offset_ms)


def ema_fold(df: DataFrame, keys: list[str], order: list[str], value: str, alpha: float, out: str = "ema", *, n: int | None = None) -> DataFrame:
    """Exponential average seeded by the first value of each key."""
    first = previous(slice_rows(df, keys, order, n), keys, order, {"_had": F.lit(1)})  # both scans go over the same slices
    seed = F.col("_had").isNull()
    lin = first.withColumn("_f", F.when(seed, 0.0).otherwise(1.0 - alpha)) \
        .withColumn("_o", F.when(seed, F.col(value).cast("double")).otherwise(F.col(value) * alpha)).drop("_had")
    return affine_scan(lin, keys, order, "_f", "_o", out).drop("_f", "_o", SLICE)


def lag_step(alpha: float, max_dev: float):
    """Accept lags near the baseline, which only accepted lags move; state is the baseline."""
    def step(base, rows: pd.DataFrame, done: int):
        out = []
        for lag in rows["lag_ms"].tolist():
            ok = base is None or lag - base <= max_dev
            base = float(lag) if base is None else (alpha * lag + (1.0 - alpha) * base if ok else base)
            out.append((ok, base))
        return base, 0, rows[["ts_us", "event_id"]].assign(accepted=[a for a, _ in out], baseline_ms=[b for _, b in out])
    return step


def lag_filter(packets: DataFrame, *, alpha: float = 0.05, max_dev_ms: float = 300.0, n: int | None = None) -> DataFrame:
    """Packets whose lag exceeds the running baseline too far are rejected (``feed, ts_us, event_id, lag_ms``)."""
    return fold(packets, ["feed"], ["ts_us", "event_id"], lag_step(alpha, max_dev_ms), None,
                "ts_us BIGINT, event_id BIGINT, accepted BOOLEAN, baseline_ms DOUBLE", n=n)


def _p99(values: Column) -> Column:
    """99th percentile with linear interpolation, cut to an integer."""
    s = F.array_sort(values)
    at = (F.size(s) - 1) * F.lit(0.99)
    lo = F.floor(at).cast("int")
    a, b = F.element_at(s, lo + 1), F.element_at(s, F.least(lo + 2, F.size(s)))
    return F.floor(a + (b - a) * (at - lo)).cast("long")


def rtt_p99(samples: DataFrame, *, wide: int = 1000, short: int = 200, every: int = 10, breaker_ms: int = 150, rearm_ms: int = 100) -> DataFrame:
    """Wide and short p99 of round trips, refreshed every ``every`` samples (``feed, ts_us, event_id, rtt_ms, tps``).

    Samples are packed by refresh first, so the frame runs over one row per refresh.
    """
    idx = dense_index(samples, ["feed"], ["ts_us", "event_id"], "idx").drop(SLICE)
    packs = idx.groupBy("feed", F.floor(F.col("idx") / every).cast("long").alias("pack")).agg(
        F.collect_list(F.col("rtt_ms").cast("long")).alias("v"), F.max("idx").alias("idx"), F.max_by("tps", "idx").alias("tps"))
    packs = packs.where(F.size("v") == every)
    w = Window.partitionBy("feed", "_block").orderBy("pack")
    last = lambda k: F.flatten(F.collect_list("v").over(w.rowsBetween(-(k // every - 1), 0)))
    seen = blocks(packs, "pack", wide // every - 1).withColumn("_wide", last(wide)).withColumn("_short", last(short)) \
        .where(F.col("_home") & (F.col("idx") >= short - 1))
    p = seen.select("feed", "idx", "tps", _p99(F.col("_wide")).alias("wide_p99"), _p99(F.col("_short")).alias("short_p99"))
    calm = (F.col("short_p99") < F.col("wide_p99") * 0.4) & (F.col("tps") >= 10)
    effective = F.when(calm, F.floor(F.col("short_p99") * 0.7 + F.col("wide_p99") * 0.3)).otherwise(F.col("wide_p99"))
    return p.withColumn("healthy", (F.col("wide_p99") <= breaker_ms) | (F.col("short_p99") < rearm_ms)) \
        .withColumn("penalty", 2 + F.floor(F.greatest(F.lit(0), effective - 20) / 25)).drop("tps")


def failure_bursts(failures: DataFrame, *, limit: int = 5, window_us: int = 10_000_000) -> DataFrame:
    """Failures that complete ``limit`` within the window (``component, ts_us, event_id``)."""
    idx = dense_index(failures, ["component"], ["ts_us", "event_id"], "idx").drop(SLICE)
    hit = first_in_range(idx, ["component"], "ts_us", "idx", window_us, {"first_idx": "idx"})
    return hit.withColumn("recent", F.col("idx") - F.col("first_idx") + 1).where(F.col("recent") >= limit) \
        .select("component", "ts_us", "event_id", "recent")


def pressure_hysteresis(heat: DataFrame, *, on: float = 0.85, off: float = 0.4) -> DataFrame:
    """Tunnel vision from the mean heat series (``ts_us, sample_id, heat``): the last crossing decides."""
    crossing = F.when(F.col("heat") > on, True).when(F.col("heat") < off, False)
    out = running(heat, [], ["ts_us", "sample_id"], {"_last": ("last", crossing)})
    return out.withColumn("tunnel_vision", F.coalesce("_last", F.lit(False))).drop("_last", SLICE)


def shed_ticks(ticks: DataFrame, pressure: DataFrame, core: tuple[str, ...]) -> DataFrame:
    """Public ticks left after shedding non-core symbols while tunnel vision is on."""
    at = asof(ticks, pressure.withColumnRenamed("ts_us", "at_us"), [], left_ts="ts_us", right_ts="at_us", left_id="trade_id",
              right_id="sample_id", right_cols=["tunnel_vision"])
    return at.where(~F.coalesce("tunnel_vision", F.lit(False)) | F.col("symbol").isin(*core)).drop("tunnel_vision")


def backlog_stagnation(samples: DataFrame, *, every_sec: int = 10, timeout_sec: int = 300) -> DataFrame:
    """Alarms and recoveries of a queue that does not shrink (``ts_us, sample_id, pending``)."""
    order = ["ts_us", "sample_id"]
    s = previous(dense_index(samples, [], order, "idx").drop(SLICE), [], order, {"_prev": "pending"})
    stuck = (F.col("pending") > 0) & (F.col("pending") >= F.coalesce("_prev", F.lit(0)))
    s = running(s.withColumn("_stuck", stuck), [], order, {"_free": ("last", F.when(~F.col("_stuck"), F.col("idx")))})
    s = s.withColumn("stagnation_sec", (F.col("idx") - F.coalesce("_free", F.lit(-1))) * every_sec).drop(SLICE)
    s = previous(s, [], order, {"_before": "stagnation_sec"})
    event = F.when(F.col("stagnation_sec") >= timeout_sec, "STAGNANT") \
        .when((F.col("stagnation_sec") == 0) & (F.coalesce("_before", F.lit(0)) >= timeout_sec), "RECOVERED")
    return s.withColumn("event", event).where("event IS NOT NULL").select("ts_us", "sample_id", "pending", "stagnation_sec", "event")


def cusum_step(decay: float, threshold: float, drift: float):
    """Structural breaks of a price; state [mean or None, variance, s+, s-]."""
    def step(state, rows: pd.DataFrame, done: int):
        mean, var, up, down = state
        out = []
        for x in rows["price"].tolist():
            flag = 0
            if mean is None:
                mean = float(x)
            else:
                delta = x - mean
                mean += decay * delta
                var = (1.0 - decay) * (var + decay * delta * delta)
                z = delta / (math.sqrt(var) + 1e-8)
                up, down = max(0.0, up + z - drift), min(0.0, down + z + drift)
                flag = 1 if up > threshold else (-1 if down < -threshold else 0)
                if flag:
                    up = down = 0.0
            out.append(flag)
        return [mean, var, up, down], 0, rows[["seq"]].assign(signal=out)
    return step


def cusum(prices: DataFrame, *, decay: float = 0.05, threshold: float = 3.0, drift: float = 0.5, n: int | None = None) -> DataFrame:
    """+1 / -1 at structural breaks, 0 otherwise (``symbol, seq, price``)."""
    return fold(prices, ["symbol"], ["seq"], cusum_step(decay, threshold, drift), [None, 1e-8, 0.0, 0.0], "seq BIGINT, signal BIGINT", n=n)


def sector_heat(events: DataFrame, *, base_threshold: float = 1.0, n: int | None = None) -> DataFrame:
    """Heat, fatigue, adjusted threshold and confidence of sectors
    (``sector, ts_us, event_id, kind`` = awakening / failed / intent / tick).

    Fatigue counts between two bounds, so its steps compose; once it is known, a tick cools the
    sector by a known factor, and heat is a linear recurrence under a cap.
    """
    kind = F.col("kind")
    moves = events.select("sector", "ts_us", "event_id", "kind",
                          F.lit(1.0).alias("_one"), F.when(kind == "failed", 1.0).when(kind == "intent", -2.0).otherwise(0.0).alias("_tired"), F.lit(0.0).alias("_rested"), F.lit(50.0).alias("_spent"),
                          F.when(kind == "awakening", 0.4).otherwise(0.0).alias("_warms"), F.lit(2.0).alias("_cap"))
    sliced = slice_rows(moves, ["sector"], ["ts_us", "event_id"], n)
    s = scan(sliced, ["sector"], ["ts_us", "event_id"], {"fatigue": Step("_one", "_tired", "_rested", "_spent")})
    cools = F.when(kind.isin("awakening", "failed", "intent"), 1.0).otherwise(0.995 / (1.0 + F.col("fatigue") * 0.1))
    s = scan(s.withColumn("_cools", cools), ["sector"], ["ts_us", "event_id"], {"heat": Step("_cools", "_warms", None, "_cap")}).select("sector", "ts_us", "event_id", "heat", "fatigue")
    relief = F.greatest(F.lit(0.2), F.least(F.lit(1.0), 1.0 - F.col("heat") * 0.8))
    wall = F.exp(F.greatest(F.lit(0.0), F.col("fatigue") - 10.0) * 0.3)
    trust = F.greatest(F.lit(0.0), F.least(F.lit(1.5), F.col("heat") / (1.0 + F.col("fatigue") * 0.5)))
    return s.withColumn("threshold", base_threshold * relief * wall).withColumn("confidence", trust)


def quarantine_stash(ticks: DataFrame, controls: DataFrame, *, core: tuple[str, ...] = (), size: int = 2000, core_size: int = 10_000) -> DataFrame:
    """Ticks held back while their symbol is corrupted, and what a full stash does with them.

    ``controls``: symbol, ts_us, control_id, kind (corrupted / recovered).  A core
    symbol keeps its latest ticks, another one its first and is then buried.
    """
    c = controls.withColumnRenamed("ts_us", "control_us")
    was = previous(c, ["symbol"], ["control_us", "control_id"], {"_kind": "kind"}).drop(SLICE)
    starts = was.where(F.coalesce(F.col("kind") != F.col("_kind"), F.col("kind") == "corrupted")).drop("_kind")
    held = asof(ticks, starts, ["symbol"], left_ts="ts_us", right_ts="control_us", left_id="trade_id", right_id="control_id",
                right_cols=["kind", "control_us"]).where("kind = 'corrupted'").withColumnRenamed("control_us", "since_us").drop("kind")
    n = running(held, ["symbol", "since_us"], ["ts_us", "trade_id"], {"_nth": ("sum", F.lit(1).cast("long"))}).drop(SLICE)
    total = n.groupBy("symbol", "since_us").agg(F.max("_nth").alias("_all"))
    is_core = F.col("symbol").isin(*core) if core else F.lit(False)
    status = (F.when(is_core, F.when(F.col("_nth") > F.col("_all") - core_size, "STASHED").otherwise("TRUNCATED"))
              .otherwise(F.when(F.col("_nth") <= size, "STASHED").when(F.col("_nth") == size + 1, "BURIAL").otherwise("DROPPED")))
    return n.join(total, ["symbol", "since_us"]).withColumn("status", status).drop("_nth", "_all")
