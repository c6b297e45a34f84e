"""Information-driven bars.

Two families.  *Reset* bars drop the overshoot and start again from zero; they
depend on the order of ticks and use a fold.  *Split* bars conserve volume: a
tick is cut at every multiple of the threshold, so a prefix sum places it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeworks import schemas
from tapeworks.functions.numeric import floor_div
from tapeworks.plans.chains import reset_fold
from tapeworks.plans.clocks import clock_fold
from tapeworks.plans.folds import fold
from tapeworks.plans.slices import blocks, dense_index, running


def bar_ends(notional: np.ndarray, threshold: np.ndarray, filled: int) -> tuple[np.ndarray, int]:
    """Positions that close a reset bar, and what the open bar holds afterwards."""
    total = np.cumsum(notional)
    cuts = np.flatnonzero(np.diff(threshold)) + 1
    ends: list[int] = []
    base = -int(filled)
    for lo, hi in zip([0, *cuts], [*cuts, len(total)]):
        at, step = lo, int(threshold[lo])
        while at < hi:
            # a lowered threshold may already be met by the first tick of the run
            hit = max(at, int(np.searchsorted(total[:hi], base + step, side="left")))
            if hit >= hi:
                break
            ends.append(hit)
            base, at = int(total[hit]), hit + 1
    return np.asarray(ends, dtype=np.int64), int(total[-1]) - base


def partial_bars(rows: pd.DataFrame, ends: np.ndarray, first_idx: int, last_ts: int | None) -> pd.DataFrame:
    """Aggregate each bar's share of this batch with segment reductions."""
    n = len(rows)
    starts = np.unique(np.concatenate([[0], ends + 1]))
    starts = starts[starts < n]
    stops = np.append(starts[1:], n) - 1
    price, notional, ts = (rows[c].to_numpy() for c in ("price", "notional", "ts_us"))
    ids, buy = rows["trade_id"].to_numpy(), np.where(rows["side"].to_numpy() == "Buy", notional, 0)
    gap = np.diff(ts, prepend=ts[0] if last_ts is None else last_ts)
    total, bought = np.add.reduceat(notional, starts), np.add.reduceat(buy, starts)
    return pd.DataFrame({
        "bar_idx": first_idx + np.arange(len(starts)),
        "open": price[starts], "high": np.maximum.reduceat(price, starts), "low": np.minimum.reduceat(price, starts),
        "close": price[stops], "volume": np.add.reduceat(rows["size"].to_numpy(), starts), "notional": total,
        "buy_notional": bought, "sell_notional": total - bought, "tick_count": stops - starts + 1,
        "start_us": ts[starts], "end_us": ts[stops], "start_id": ids[starts], "end_id": ids[stops],
        "max_gap_us": np.maximum.reduceat(gap, starts), "closed": np.isin(stops, ends)})


def reset_bar_step(track_gap: bool):
    """Step of the reset-bar fold; the state is [filled, last ts or None]."""
    def step(state, rows: pd.DataFrame, done: int):
        filled, last_ts = state
        ends, filled = bar_ends(rows["notional"].to_numpy(), rows["threshold"].to_numpy(), filled)
        out = partial_bars(rows, ends, done, last_ts)
        return [filled, int(rows["ts_us"].iloc[-1]) if track_gap else None], len(ends), out
    return step


def merge_partials(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Join the shares of bars that span batches or slices."""
    head, tail = F.struct("start_us", "start_id"), F.struct("end_us", "end_id")
    return parts.groupBy(*keys, "bar_idx").agg(
        F.min_by("open", head).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max_by("close", tail).alias("close"),
        *[F.sum(c).alias(c) for c in ("volume", "notional", "buy_notional", "sell_notional", "tick_count")],
        F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"),
        F.max("max_gap_us").alias("max_gap_us"), F.bool_or("closed").alias("closed"))


def dollar_bars(tape: DataFrame, threshold: int | str | Column, *, keys: tuple[str, ...] = ("symbol",),
                include_open: bool = False, track_gap: bool = False, n: int | None = None) -> DataFrame:
    """Reset bars: the tick that reaches the threshold closes the bar, overshoot included.

    ``threshold`` is a number or a column, so it may differ per symbol and over time.
    """
    limit = F.lit(threshold) if isinstance(threshold, int) else (F.col(threshold) if isinstance(threshold, str) else threshold)
    cols = ("trade_id", "ts_us", "price", "size", "side", "notional")
    src = tape.select(*keys, *cols, limit.cast("long").alias("threshold"))
    parts = reset_fold(src, keys, ["ts_us", "trade_id"], reset_bar_step(track_gap), schemas.PARTIAL_BAR, amount="notional", threshold="threshold", track_clock=track_gap, n=n)
    bars = merge_partials(parts, list(keys))
    if not track_gap:
        bars = bars.drop("max_gap_us")
    return bars if include_open else bars.where("closed").drop("closed")


def gap_poisoned_bars(tape: DataFrame, threshold: int, *, max_gap_us: int = 1_500_000, n: int | None = None) -> DataFrame:
    """Reset bars without those that saw a silence longer than ``max_gap_us``."""
    bars = dollar_bars(tape, threshold, track_gap=True, n=n)
    return bars.where(F.col("max_gap_us") <= max_gap_us)


def resync_bars(tape: DataFrame, controls: DataFrame, threshold: int, *, n: int | None = None) -> DataFrame:
    """Reset bars where every control event (``ts_us``) drops the bars still open.

    Controls concern the whole feed, so epochs are numbered along the feed's own
    time order; a bar never spans two epochs.  Bars are renumbered per symbol.
    """
    cols = ("symbol", "trade_id", "ts_us", "price", "size", "side", "notional")
    both = tape.select(*cols).unionByName(controls.select("ts_us"), allowMissingColumns=True) \
        .withColumn("order_id", F.coalesce("trade_id", F.lit(1 << 62)))
    numbered = running(both, [], ["ts_us", "order_id"],
                       {"epoch": ("sum", F.when(F.col("trade_id").isNull(), 1).otherwise(0).cast("long"))}, n=n)
    bars = dollar_bars(numbered.where("trade_id IS NOT NULL"), threshold, keys=("symbol", "epoch"), n=n)
    return dense_index(bars.drop("bar_idx"), ["symbol"], ["start_us", "end_us"], "bar_idx")


def place(tape: DataFrame, threshold: int, *, n: int | None = None) -> DataFrame:
    """Every tick's first bar, its offset in that bar and its last bar.

    The prefix sum is DECIMAL: a busy market's cumulative value at 1e8 scale
    does not fit BIGINT.  Everything derived from it does.
    """
    placed = running(tape, ["symbol"], ["ts_us", "trade_id"], {"_hi": ("sum", F.col("notional").cast("decimal(28,0)"))}, n=n)
    lo = F.col("_hi") - F.col("notional")
    step = F.lit(threshold).cast("decimal(20,0)")
    return placed.withColumn("_first", floor_div(lo, step)).withColumn("_off", F.pmod(lo, step).cast("long")) \
        .withColumn("_last", F.col("_first") + floor_div(F.col("_off") + F.col("notional") - 1, threshold)).drop("_hi")


def split_chunks(tape: DataFrame, threshold: int, *, n: int | None = None) -> DataFrame:
    """Ticks cut at every multiple of the threshold of cumulative notional."""
    cut = place(tape.where("notional > 0"), threshold, n=n).withColumn("bar_idx", F.explode(F.sequence("_first", "_last")))
    passed = (F.col("bar_idx") - F.col("_first")) * threshold
    begin = F.greatest(F.col("_off"), passed)
    return cut.withColumn("chunk", F.least(F.col("_off") + F.col("notional"), passed + threshold) - begin).drop("_first", "_last", "_off")


def split_bars(tape: DataFrame, threshold: int, *, ofi: str | None = None, include_open: bool = False,
               n: int | None = None) -> DataFrame:
    """Volume-conserving bars, each worth exactly ``threshold``; OFI shared by chunk size."""
    chunks = split_chunks(tape, threshold, n=n)
    at = F.struct("ts_us", "trade_id")
    share = F.col("chunk") / F.col("notional")
    buy = F.col("side") == "Buy"
    bars = chunks.groupBy("symbol", "bar_idx").agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", at).alias("close"), F.sum("chunk").alias("notional"),
        F.sum(F.col("chunk") / F.col("price")).alias("volume"),
        F.sum(F.when(buy, F.col("chunk")).otherwise(0)).alias("buy_notional"),
        F.sum(F.when(buy, 0).otherwise(F.col("chunk"))).alias("sell_notional"),
        F.count("*").alias("tick_count"), F.min("ts_us").alias("start_us"), F.max("ts_us").alias("end_us"),
        F.sum(F.col(ofi) * share if ofi else F.lit(0.0)).alias("ofi"))
    return bars if include_open else bars.where(F.col("notional") >= threshold)


def split_bars_scaled(tape: DataFrame, threshold: int, *, scale: int = 100_000_000, ema_period: int = 14,
                      n: int | None = None) -> DataFrame:
    """Split bars on scaled integers with integer quantities, EMA and variance.

    A tick's dollar value is ``price * qty // scale``; its quantity is given to
    the chunks in order, each taking the floor of its share of what is left.
    The recursion touches one tick only, so it is an array aggregate per tick.
    """
    dollars = floor_div(F.col("price").cast("decimal(38,0)") * F.col("size"), scale)
    src = tape.where("price > 0 AND size > 0").select(
        "symbol", "trade_id", "ts_us", "price", "size", "side", dollars.alias("notional")).where("notional > 0")
    placed = place(src, threshold, n=n)
    start = F.struct(F.col("size").alias("left_qty"), F.col("notional").alias("left_usd"),
                     F.array().cast("array<struct<bar_idx:bigint,usd:bigint,qty:bigint,nth:int>>").alias("chunks"))

    def take(acc: Column, bar: Column) -> Column:
        room = threshold - F.when(bar == F.col("_first"), F.col("_off")).otherwise(0)
        want = F.least(room, acc["left_usd"])
        qty = F.when(want < acc["left_usd"],
                     floor_div(acc["left_qty"].cast("decimal(38,0)") * want, acc["left_usd"])).otherwise(acc["left_qty"])
        piece = F.struct(bar.alias("bar_idx"), want.alias("usd"), qty.alias("qty"), F.size(acc["chunks"]).alias("nth"))
        return F.struct((acc["left_qty"] - qty).alias("left_qty"), (acc["left_usd"] - want).alias("left_usd"),
                        F.concat(acc["chunks"], F.array(piece)).alias("chunks"))

    cut = placed.withColumn("_c", F.explode(F.aggregate(F.sequence("_first", "_last"), start, take)["chunks"]))
    at = F.struct("ts_us", "trade_id")
    bars = cut.groupBy("symbol", F.col("_c.bar_idx").alias("bar_idx")).agg(
        F.min("ts_us").alias("ts_open"), F.max("ts_us").alias("ts_close"),
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", at).alias("close"), F.sum("_c.qty").alias("volume"), F.sum("_c.usd").alias("dollar_vol"),
        (F.min_by("_c.nth", at) > 0).alias("is_synthetic")).where(F.col("dollar_vol") >= threshold)
    num, den = 2, ema_period + 1
    stats = fold(bars.select("symbol", "bar_idx", "close"), ["symbol"], ["bar_idx"], bar_stats_step(num, den),
                 [0, 0, 0, 0], "bar_idx BIGINT, ema BIGINT, variance BIGINT", n=n)
    return bars.join(stats, ["symbol", "bar_idx"])


def bar_stats_step(num: int, den: int):
    """Integer EMA and running variance over bar closes; state [ema, count, mean, m2]."""
    def step(state, rows: pd.DataFrame, done: int):
        ema, count, mean, m2 = state
        out = []
        for close in rows["close"].tolist():
            ema = close if ema == 0 else (close * num + ema * (den - num)) // den
            count += 1
            delta = close - mean
            mean += delta // count
            m2 += delta * (close - mean)
            out.append((ema, m2 // (count - 1) if count > 1 else 0))
        return [ema, count, mean, m2], 0, pd.DataFrame(
            {"bar_idx": rows["bar_idx"].to_numpy(), "ema": [e for e, _ in out], "variance": [v for _, v in out]})
    return step


def hybrid_clock_step(target: int, ttl_us: int):
    """Volume/time clock; state [volume, ofi, ticks, start of the bucket].  The next close is looked up, so work is done once a bucket."""
    def step(state, rows: pd.DataFrame, done: int):
        volume, ofi, count, since = state
        ts, spent, flown = rows["ts_us"].to_numpy(np.int64), np.cumsum(rows["notional"].to_numpy(np.int64)), np.cumsum(rows["ofi"].to_numpy(np.int64))
        since = int(ts[0]) if since is None else since
        closes, at, base, flow_base, first = [], 0, -volume, -ofi, -count
        while at < len(ts):
            at = max(at, min(int(np.searchsorted(spent, base + target)), int(np.searchsorted(ts, since + ttl_us))))
            if at >= len(ts):
                break
            filled = int(spent[at]) - base
            if filled >= target or filled * 10 >= target * 8:
                closes.append((at, filled, int(flown[at]) - flow_base, at + 1 - first, "VOLUME_TARGET" if filled >= target else "TTL_EXPIRY"))
            base, flow_base, since, at = int(spent[at]), int(flown[at]), int(ts[at]), at + 1
            first = at
        left = [int(spent[-1]) - base, int(flown[-1]) - flow_base, len(ts) - first, since]
        if not closes:
            return left, 0, None
        where, filled, flow, ticks, trigger = zip(*closes)
        return left, 0, rows.iloc[list(where)][["ts_us", "trade_id"]].assign(volume=filled, ofi=flow, ticks=ticks, trigger=trigger)
    return step


def hybrid_clock_buckets(tape: DataFrame, target: int, ttl_us: int, *, ofi: str | Column = "ofi",
                         n: int | None = None) -> DataFrame:
    """Buckets that close on volume, or on the first tick past their time to live.

    A bucket closed by age is kept only with at least 80 % of the target.  Slices of
    one market compose, whatever closes their buckets.
    """
    src = tape.select("symbol", "ts_us", "trade_id", "notional", (F.col(ofi) if isinstance(ofi, str) else ofi).alias("ofi"))
    out = clock_fold(src, ["symbol"], ["ts_us", "trade_id"], hybrid_clock_step(target, ttl_us),
                     "ts_us BIGINT, trade_id BIGINT, volume BIGINT, ofi BIGINT, ticks BIGINT, trigger STRING", volume="notional", flow="ofi", target=target, ttl_us=ttl_us, n=n)
    return out.withColumn("vnofi", F.col("ofi") / F.col("volume"))


def ofi_divergence(bars: DataFrame, *, warmup: int = 1000, window: int = 100, threshold: float = 5_000_000.0) -> DataFrame:
    """Summed order flow over the last ``window`` bars minus the price move over them."""
    w = Window.partitionBy("symbol", "_block").orderBy("bar_idx")
    return (blocks(bars, "bar_idx", window - 1)
            .withColumn("divergence", F.sum(F.col("buy_notional") - F.col("sell_notional")).over(w.rowsBetween(-(window - 1), 0))
                        - (F.col("close") - F.lag("close", window - 1).over(w)))
            .where(F.col("_home") & (F.col("bar_idx") >= warmup - 1))
            .select("symbol", "bar_idx", "end_us", "divergence", (F.col("divergence") > threshold).alias("is_signal")))


def conflate_ticks(ticks: DataFrame, window_us: int) -> DataFrame:
    """Per flush window and symbol, up to two mega-ticks: all buys and all others."""
    side = F.when(F.lower("side") == "buy", "Buy").otherwise("Sell")
    ok = ticks.where("price IS NOT NULL AND size IS NOT NULL AND symbol IS NOT NULL")
    last = F.struct("ts_us", "trade_id")
    both = ok.groupBy("symbol", (F.col("ts_us") - F.pmod("ts_us", F.lit(window_us))).alias("window_us")).agg(
        F.max_by("price", last).alias("price"), F.max("ts_us").alias("ts_us"),
        F.sum(F.when(side == "Buy", F.col("size")).otherwise(0)).alias("buy"),
        F.sum(F.when(side == "Buy", 0).otherwise(F.col("size"))).alias("sell"))
    legs = F.explode(F.array(F.struct(F.lit("Buy").alias("side"), F.col("buy").alias("volume")),
                             F.struct(F.lit("Sell").alias("side"), F.col("sell").alias("volume"))))
    return both.select("symbol", "window_us", "price", "ts_us", legs.alias("_l")) \
        .select("symbol", "window_us", "price", "ts_us", "_l.side", "_l.volume").where("volume > 0")


def conflated_events(ticks: DataFrame, window_us: int) -> DataFrame:
    """Per flush window, symbol and side: volume, ticks, duration and mean price."""
    return ticks.groupBy("symbol", "side", (F.col("ts_us") - F.pmod("ts_us", F.lit(window_us))).alias("window_us")).agg(
        F.sum("size").alias("total_volume"), F.count("*").alias("tick_count"),
        F.min("ts_us").alias("start_us"), F.max("ts_us").alias("end_us"),
        ((F.max("ts_us") - F.min("ts_us")) / 1000).alias("duration_ms"), F.avg("price").alias("avg_price"))


def throughput(ticks: DataFrame, *, window_us: int = 1_000_000, starving_below: int = 10) -> DataFrame:
    """Ticks per window and whether the feed was starving."""
    return ticks.groupBy((F.col("ts_us") - F.pmod("ts_us", F.lit(window_us))).alias("window_us")).agg(
        F.count("*").alias("ticks")).withColumn("starving", F.col("ticks") < starving_below)
