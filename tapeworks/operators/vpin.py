"""Order-flow toxicity over dollar bars: VPIN, z-score, time decay, absorption.

All frames are bounded (N bars, Z emitted values), so they are computed in
blocks of the dense bar index with a halo of N-1 + Z-1 earlier bars.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeworks.functions.numeric import clamp
from tapeworks.plans.slices import blocks

HOUR_US = 3_600_000_000


STRETCH = 150.0


def _faded(df: DataFrame, value: Column, rows: int, out: str, power: int = 1) -> DataFrame:
    """Adds the sum of (x * exp(g - g_now))^power over the last ``rows`` rows, ``_g`` being the silence so far.

    Powers of e leave the range of doubles, so they are taken from the start of a stretch of
    ``STRETCH`` of g.  A frame's rows of the current stretch are a frame of that stretch, those of
    the one before are the end of its rows, and older ones weigh less than exp(-STRETCH): two
    terms, without gathering the frame.
    """
    def base(stretch: Column) -> Column:
        return stretch * STRETCH
    all_rows = Window.partitionBy("symbol", "_block").orderBy("bar_idx")
    stretch = Window.partitionBy("symbol", "_block", "_stretch").orderBy("bar_idx")
    df = df.withColumn("_stretch", F.floor(F.col("_g") / STRETCH))
    df = df.withColumn("_x", F.coalesce(F.pow(value * F.exp(F.col("_g") - base(F.col("_stretch"))), F.lit(float(power))), F.lit(0.0)))
    df = df.withColumn("_now", F.sum("_x").over(stretch.rowsBetween(-(rows - 1), 0))).withColumn("_rest", F.sum("_x").over(stretch.rowsBetween(0, Window.unboundedFollowing)))
    df = df.withColumn("_here", F.struct("_stretch", F.sum("_x").over(stretch.rowsBetween(Window.unboundedPreceding, 0)).alias("all")))
    df = df.withColumn("_lag", F.lag("_here").over(all_rows)).withColumn("_left", F.first("_lag").over(stretch)).withColumn("_from", F.lag(F.struct("_stretch", "_rest"), rows - 1).over(all_rows))
    before = F.col("_stretch") - 1
    old = (F.when(F.col("_from._stretch") == F.col("_stretch"), 0.0).when(F.col("_from._stretch") == before, F.col("_from._rest"))
           .when(F.col("_left._stretch") == before, F.col("_left.all")).otherwise(0.0))

    def weight(start: Column) -> Column:
        return F.exp(power * (base(start) - F.col("_g")))
    return df.withColumn(out, F.col("_now") * weight(F.col("_stretch")) + old * weight(before)).drop("_stretch", "_x", "_now", "_rest", "_here", "_lag", "_left", "_from")


def vpin_signals(bars: DataFrame, *, window: int, base_threshold: float, z_threshold: float = 2.5, z_history: int = 500,
                 denominator: str = "base", decay_gap_us: int | None = None, tau_hours: float = 4.0,
                 block: int | None = None) -> DataFrame:
    """One row per bar from the ``window``-th on.

    vpin = sum of |buy - sell| over the last ``window`` bars / total volume,
    clamped to [0, 1].  The total is ``window * base_threshold``, or the bars'
    own notional with ``denominator='bar'``.  z compares vpin with the last
    ``z_history`` emitted values including itself.  With ``decay_gap_us`` a
    longer silence before a bar scales both histories by
    exp(-silence / max(tau, 1 h)).
    """
    if z_history < window:
        raise ValueError("z_history must be >= window")
    w = Window.partitionBy("symbol", "_block").orderBy("bar_idx")
    recent, emitted = w.rowsBetween(-(window - 1), 0), w.rowsBetween(-(z_history - 1), 0)
    imbalance = F.col("buy_notional") - F.col("sell_notional")
    df = blocks(bars, "bar_idx", window - 1 + z_history - 1, block) \
        .withColumn("_imb", imbalance).withColumn("_abs", F.abs(imbalance).cast("double"))
    if decay_gap_us is not None:
        silence = F.col("end_us") - F.lag("end_us").over(w)
        lost = F.when(silence > decay_gap_us, silence / (HOUR_US * max(tau_hours, 1.0))).otherwise(0.0)
        df = df.withColumn("_step", lost).withColumn("_g", F.sum("_step").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        df = _faded(df, F.col("_abs"), window, "_flow")
        flow = F.col("_flow")
    else:
        flow = F.sum("_abs").over(recent)
    total = F.lit(float(base_threshold) * window) if denominator == "base" else F.sum("notional").over(recent)
    df = df.withColumn("vpin", F.when(F.col("bar_idx") >= window - 1, clamp(flow / total, 0.0, 1.0)))
    n = F.count("vpin").over(emitted)
    if decay_gap_us is not None:
        some = F.nullif(n, F.lit(0))
        df = _faded(_faded(df, F.col("vpin"), z_history, "_sum"), F.col("vpin"), z_history, "_squares", 2)
        mean, square = F.col("_sum") / some, F.col("_squares") / some
    else:
        mean, square = F.avg("vpin").over(emitted), F.avg(F.col("vpin") * F.col("vpin")).over(emitted)
    df = df.withColumn("_mean", mean).withColumn("_sq", square).withColumn("_ref", F.lag("close", window - 1).over(w))
    z = (F.col("vpin") - F.col("_mean")) / F.sqrt(F.greatest(F.col("_sq") - F.col("_mean") * F.col("_mean"), F.lit(1e-12)))
    move = F.col("close") - F.col("_ref")
    df = df.where(F.col("_home") & F.col("vpin").isNotNull()).withColumn("z_score", z)
    hot, up, down = F.col("z_score") > z_threshold, F.col("_imb") > 0, F.col("_imb") < 0
    return df.select(
        "symbol", "bar_idx", "end_us", "open", "close", "vpin", "z_score", hot.alias("is_anomaly"),
        (hot & ((up & (move <= 0)) | (down & (move >= 0)))).alias("absorption"),
        F.when(hot & up, "long").when(hot & down, "short").otherwise("neutral").alias("direction"))


def tick_batch_signals(tape: DataFrame, threshold: int, *, window: int, z_threshold: float, z_history: int | None = None) -> DataFrame:
    """Split bars and their signals from raw ticks; an unknown side counts as a buy."""
    from tapeworks.operators.bars import split_bars
    side = F.when(F.upper("side") == "SELL", "Sell").otherwise("Buy")
    bars = split_bars(tape.withColumn("side", side), threshold)
    return vpin_signals(bars, window=window, base_threshold=threshold, z_threshold=z_threshold,
                        z_history=z_history or max(window, 500))
