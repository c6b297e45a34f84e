"""Tick-level liquidity detectors and the cooldowns that thin them out."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeworks.plans.chains import ENDLESS, cooldown_map, reset_fold
from tapeworks.plans.folds import fold
from tapeworks.plans.lookup import lookup
from tapeworks.plans.slices import blocks, dense_index, running, slice_rows


def cooldown_step(ts: str, cooldown: int):
    """Keep the first event, then the first one at least ``cooldown`` after the last kept; state [time last kept, None]."""
    def step(state, rows: pd.DataFrame, done: int):
        last, times = state[0], rows[ts].to_numpy(np.int64)
        at, kept = int(np.searchsorted(times, last + cooldown)), []
        while at < len(times):
            kept.append(at)
            last = int(times[at])
            at = max(at + 1, int(np.searchsorted(times, last + cooldown)))
        return [last, None], len(kept), rows.iloc[kept] if kept else None
    return step


def greedy_cooldown(events: DataFrame, keys: list[str], cooldown_us: int, *, ts: str = "ts_us", tie: str = "trade_id",
                    n: int | None = None) -> DataFrame:
    """Drop events that follow the last *kept* event of their key too closely.

    What a slice does to the time last kept is a step function, so slices of one hot key compose
    in a tree; a key that never pauses costs no more passes than one that does.
    """
    sliced = slice_rows(events, keys, [ts, tie], n, freeze=True)
    kept = reset_fold(sliced, keys, [ts, tie], cooldown_step(ts, cooldown_us), events.schema, amount=ts, threshold=ts,
                      exits=lambda times, _: cooldown_map(times, cooldown_us), empty=-ENDLESS)
    return kept.select(*events.columns)


def sweep_step(min_trades: int, window_us: int, min_notional: int, cooldown_us: int):
    """Same-side run detector; state [last alert, side, notional, count, first ts]."""
    def step(state, rows: pd.DataFrame, done: int):
        last, side, total, count, first = state
        out = []
        for ts, tid, price, usd, s in zip(*(rows[c].tolist() for c in ("ts_us", "trade_id", "price", "notional", "side"))):
            if last is not None and ts - last < cooldown_us:
                side = None
            elif s != side or ts - first > window_us:
                side, total, count, first = s, usd, 1, ts
            else:
                total, count = total + usd, count + 1
                if count >= min_trades and total >= min_notional:
                    out.append((ts, tid, s, price, total, count, ts - first))
                    last, side = ts, None
        if side is None:
            total = count = first = 0
        frame = pd.DataFrame(out, columns=["ts_us", "trade_id", "side", "price", "notional", "trade_count", "duration_us"]) if out else None
        return [last, side, total, count, first], len(out), frame
    return step


def _direction() -> Column:
    return F.when(F.col("side") == "Sell", "sell").otherwise("buy").alias("direction")


def sweep(tape: DataFrame, *, min_trades: int = 5, window_us: int = 30_000_000, min_notional: int = 100_000,
          cooldown_us: int = 60_000_000, n: int | None = None) -> DataFrame:
    """Runs of aggressive trades on one side, inside a window, worth at least a floor."""
    return sweeps_from(tape.withColumn("_start", F.lit(None).cast("string")), "_start", min_trades=min_trades, window_us=window_us,
                       min_notional=min_notional, cooldown_us=cooldown_us, n=n)


def sweeps_from(tape: DataFrame, start: str, *, min_trades: int, window_us: int, min_notional: int, cooldown_us: int, n: int | None = None,
                states: bool = False) -> DataFrame | tuple[DataFrame, DataFrame]:
    """``sweep`` that goes on from the state in column ``start``; with ``states`` also what every symbol is left in."""
    if min_trades < 2:
        raise ValueError("min_trades must be >= 2")
    made = fold(tape.select("symbol", "ts_us", "trade_id", "price", "notional", "side", start), ["symbol"], ["ts_us", "trade_id"],
                sweep_step(min_trades, window_us, min_notional, cooldown_us), [None, None, 0, 0, 0],
                "ts_us BIGINT, trade_id BIGINT, side STRING, price BIGINT, notional BIGINT, trade_count BIGINT, duration_us BIGINT", n=n, start=start, states=states)
    hits, left = made if states else (made, None)
    hits = hits.select("symbol", "ts_us", "trade_id", F.lit("SWEEP").alias("kind"), _direction(), "price", "notional", "trade_count", "duration_us")
    return (hits, left) if states else hits


def turnover_lookup(tape: DataFrame, turnover: DataFrame) -> DataFrame:
    """24 h turnover of every tick's symbol; 0 when unknown."""
    return lookup(tape, turnover.select("symbol", "turnover"), ["symbol"]).withColumn("turnover", F.coalesce("turnover", F.lit(0)))


def large_print(tape: DataFrame, turnover: DataFrame, *, pct_threshold: float = 0.005, min_notional: int = 25_000,
                cooldown_us: int = 60_000_000, n: int | None = None) -> DataFrame:
    """Single trades that are large against the day's turnover.

    The floor test runs before anything else; only candidates reach the fold.
    """
    return greedy_cooldown(large_candidates(tape, turnover, pct_threshold, min_notional), ["symbol"], cooldown_us, n=n)


def large_candidates(tape: DataFrame, turnover: DataFrame, pct_threshold: float, min_notional: int) -> DataFrame:
    """Large prints before their cooldown."""
    usd = F.col("notional")
    known = F.col("turnover") > 0
    pct = F.when(known, usd / F.col("turnover")).otherwise(F.lit(float("nan")))
    return turnover_lookup(tape.where(usd >= min_notional), turnover) \
        .where(F.when(known, usd / F.col("turnover") >= pct_threshold).otherwise(usd >= 10 * min_notional)) \
        .select("symbol", "ts_us", "trade_id", F.lit("LARGE_PRINT").alias("kind"), _direction(), "price", "notional",
                pct.alias("pct_of_turnover"))


def ofi_buckets(tape: DataFrame, bucket_us: int) -> DataFrame:
    """Signed order flow per symbol and time bucket, for buckets that traded."""
    signed = F.when(F.col("side") == "Sell", -F.col("notional")).otherwise(F.col("notional"))
    return tape.groupBy("symbol", (F.col("ts_us") - F.pmod("ts_us", F.lit(bucket_us))).alias("bucket_us")) \
        .agg(F.sum(signed).alias("ofi"), F.count("*").alias("ticks"))


def prior_medians(buckets: DataFrame, history: int, n: int | None = None) -> DataFrame:
    """Median |ofi| over the earlier non-empty buckets that a history of ``history`` still holds."""
    idx = dense_index(buckets, ["symbol"], ["bucket_us"], "bucket_idx")
    w = Window.partitionBy("symbol", "_block").orderBy("bucket_idx").rowsBetween(-(history - 1), -1)
    sized = blocks(idx, "bucket_idx", history - 1) \
        .withColumn("_p", F.array_sort(F.collect_list(F.abs("ofi")).over(w))).where("_home")
    half, size = F.floor(F.size("_p") / 2).cast("int"), F.size("_p")
    upper = F.try_element_at("_p", half + 1).cast("double")
    lower = F.try_element_at("_p", F.greatest(half, F.lit(1))).cast("double")
    return sized.select("symbol", "bucket_us", "bucket_idx", size.alias("prior_buckets"),
                        F.when(size % 2 == 1, upper).otherwise(0.5 * (lower + upper)).alias("median_abs"))


def ofi_pulse(tape: DataFrame, *, bucket_us: int = 60_000_000, history: int = 60, k: float = 3.0, min_notional: int = 50_000,
              min_history: int = 5, cooldown_us: int = 120_000_000, n: int | None = None) -> DataFrame:
    """Order flow of the current bucket far above the median of earlier buckets.

    The prior median is fixed for the whole bucket, so it is computed once per
    bucket.  A bucket's running flow never exceeds its gross value, so only
    ticks of buckets whose gross value could reach the bound are ever scanned.
    """
    return greedy_cooldown(pulse_candidates(tape, bucket_us, history, k, min_notional, min_history, n), ["symbol"], cooldown_us, n=n)


def pulse_candidates(tape: DataFrame, bucket_us: int, history: int, k: float, min_notional: int, min_history: int, n: int | None = None) -> DataFrame:
    """Pulses before their cooldown."""
    signed = F.when(F.col("side") == "Sell", -F.col("notional")).otherwise(F.col("notional"))
    keyed = tape.withColumn("bucket_us", F.col("ts_us") - F.pmod("ts_us", F.lit(bucket_us)))
    medians = prior_medians(ofi_buckets(tape, bucket_us), history).where(F.col("bucket_idx") >= min_history)
    need = F.greatest(F.lit(min_notional), F.when(F.col("median_abs") > 0, F.col("median_abs") * k).otherwise(F.lit(5 * min_notional)))
    gross = keyed.groupBy("symbol", "bucket_us").agg(F.sum("notional").alias("gross")).where(F.col("gross") >= min_notional)
    live = gross.join(medians, ["symbol", "bucket_us"]).where(F.col("gross") >= need).select("symbol", "bucket_us", "median_abs")
    ticks = lookup(keyed.select("symbol", "bucket_us", "ts_us", "trade_id", "price", signed.alias("signed")), live, ["symbol", "bucket_us"], "inner")
    hit = running(ticks, ["symbol", "bucket_us"], ["ts_us", "trade_id"], {"ofi": ("sum", F.col("signed"))}, n=n).where(F.abs("ofi") >= min_notional)
    size = F.abs("ofi")
    ratio = F.when(F.col("median_abs") > 0, size / F.col("median_abs")).otherwise(F.lit(float("inf")))
    return hit.where(F.when(F.col("median_abs") > 0, size / F.col("median_abs") >= k).otherwise(size >= 5 * min_notional)) \
        .select("symbol", "ts_us", "trade_id", F.lit("OFI_PULSE").alias("kind"),
                F.when(F.col("ofi") > 0, "buy").otherwise("sell").alias("direction"), "price", size.alias("notional"),
                ratio.alias("ratio_to_median"), "median_abs")


def liquidity_bank(*alerts: DataFrame, cooldown_us: int | None = None) -> DataFrame:
    """Alerts of several detectors in one table, optionally thinned per kind and symbol."""
    out = alerts[0]
    for a in alerts[1:]:
        out = out.unionByName(a, allowMissingColumns=True)
    return out if cooldown_us is None else greedy_cooldown(out, ["kind", "symbol"], cooldown_us)


def liquidity_as_radar(alerts: DataFrame) -> DataFrame:
    """Liquidity alerts in the shape of radar alerts."""
    z = F.when(F.col("kind") == "OFI_PULSE", F.col("ratio_to_median")).otherwise(0.0)
    return alerts.select("symbol", F.col("ts_us").alias("end_us"), F.col("price").alias("open"), F.col("price").alias("close"),
                         F.lit(0.0).alias("vpin"), z.alias("z_score"),
                         F.when(F.col("direction") == "buy", "long").otherwise("short").alias("direction"),
                         F.lit(False).alias("absorption"))
