"""Leader market: panic regime, price and spread shocks, blackouts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeworks.functions.numeric import floor_div
from tapeworks.plans.folds import fold
from tapeworks.plans.slices import asof, blocks, dense_index, previous, running
from tapeworks.session import ensure_checkpoint_dir


def first_in_range(df: DataFrame, keys: list[str], ts: str, tie: str, width_us: int, cols: dict[str, str]) -> DataFrame:
    """Values of the oldest row of the same key not older than ``width_us``.

    A time frame may hold any number of rows, so it is looked up as the first
    row at or after ``ts - width``: one pass, no frame buffer.  The rows stand on
    both sides of that lookup, so they are stored once instead of computed twice.
    """
    ensure_checkpoint_dir(df.sparkSession)
    df = df.checkpoint(eager=True)
    probe = df.withColumn("_from", F.col(ts) - width_us)
    source = df.select(*keys, F.col(ts).alias("_ts"), F.col(tie).alias("_tie"), *[F.col(c).alias(name) for name, c in cols.items()])
    return asof(probe, source, keys, left_ts="_from", right_ts="_ts", left_id=tie, right_id="_tie",
                right_cols=list(cols), forward=True).drop("_from")


def macro_regime(leader: DataFrame, *, window_us: int = 60_000_000, panic_vpin: float = 0.85, panic_roc: float = -0.005,
                 cooldown_us: int = 180_000_000) -> DataFrame:
    """Panic state of the leader at each of its updates (``ts_us, seq, vpin, price``).

    The first update of a window has nothing to compare with and emits no state.
    """
    idx = dense_index(leader, [], ["ts_us", "seq"], "idx")
    ref = first_in_range(idx, [], "ts_us", "idx", window_us, {"ref_price": "price", "ref_idx": "idx"}).where("ref_idx < idx")
    roc = (F.col("price") - F.col("ref_price")) / F.col("ref_price")
    ref = ref.withColumn("roc", roc).withColumn("trigger", F.when(F.col("vpin") > panic_vpin, "TOXIC_FLOW").when(F.col("roc") < panic_roc, "FLASH_CRASH"))
    last = running(ref, [], ["ts_us", "idx"], {"last_panic_us": ("max", F.when(F.col("trigger").isNotNull(), F.col("ts_us")))})
    muted = F.coalesce(F.col("ts_us") - F.col("last_panic_us") < cooldown_us, F.lit(False))
    return last.select("ts_us", F.col("idx").alias("state_id"), "vpin", "price", "roc", (F.col("trigger").isNotNull() | muted).alias("is_panic"),
                       F.coalesce("trigger", F.when(muted, "COOLDOWN")).alias("reason"))


def macro_mute(alerts: DataFrame, regime: DataFrame, leader: str, *, ts: str = "end_us", tie: str = "bar_idx") -> DataFrame:
    """Drop alerts of other markets while the leader is in panic."""
    at = asof(alerts, regime, [], left_ts=ts, right_ts="ts_us", left_id=tie, right_id="state_id", right_cols=["is_panic"])
    return at.where((F.col("symbol") == leader) | ~F.coalesce("is_panic", F.lit(False))).drop("is_panic")


def trend_reset_filter(signals: DataFrame, leader: str, exhaustion: float) -> DataFrame:
    return signals.where((F.col("symbol") == leader) | (F.col("vpin") < exhaustion))


def leader_shock(ticks: DataFrame, *, window_us: int = 1_500_000, max_ticks: int = 500, shock_bps: int = 35) -> DataFrame:
    """Leader ticks whose price moved at least ``shock_bps`` within the window (at most ``max_ticks`` ticks back)."""
    idx = dense_index(ticks.select("symbol", "ts_us", "trade_id", "price"), ["symbol"], ["ts_us", "trade_id"], "idx")
    ref = first_in_range(idx, ["symbol"], "ts_us", "idx", window_us, {"oldest": "price", "oldest_idx": "idx"})
    w = Window.partitionBy("symbol", "_block").orderBy("idx")
    capped = blocks(ref, "idx", max_ticks - 1).withColumn("_cap", F.lag("price", max_ticks - 1).over(w)).where("_home")
    start = F.when(F.col("idx") - F.col("oldest_idx") > max_ticks - 1, F.col("_cap")).otherwise(F.col("oldest"))
    return capped.withColumn("oldest", start).where((F.col("oldest_idx") < F.col("idx")) & (F.col("oldest") > 0)) \
        .withColumn("drift_bps", floor_div(F.abs(F.col("price") - F.col("oldest")) * 10_000, F.col("oldest"))) \
        .where(F.col("drift_bps") >= shock_bps).select("symbol", "ts_us", "trade_id", "price", "drift_bps")


def spread_shock(quotes: DataFrame, threshold_bps: int = 100) -> DataFrame:
    bps = floor_div((F.col("ask") - F.col("bid")) * 10_000, F.col("bid"))
    return quotes.where("bid > 0").withColumn("spread_bps", bps).where(F.col("spread_bps") >= threshold_bps)


def blackouts(shocks: DataFrame, *, duration_us: int = 5_000_000, new_after_us: int = 500_000) -> DataFrame:
    """Episodes of shocks (``symbol, ts_us, shock_id, drift_bps``): a pause over ``new_after_us`` starts the next one."""
    prev = previous(shocks, [], ["ts_us", "shock_id"], {"prev_us": "ts_us"})
    fresh = F.when(F.col("prev_us").isNull() | (F.col("ts_us") - F.col("prev_us") > new_after_us), 1).otherwise(0).cast("long")
    numbered = running(prev.withColumn("_new", fresh), [], ["ts_us", "shock_id"], {"episode": ("sum", F.col("_new"))})
    at = F.struct("ts_us", "shock_id")
    return numbered.groupBy("episode").agg(
        F.min("ts_us").alias("start_us"), (F.max("ts_us") + duration_us).alias("until_us"), F.count("*").alias("shocks"),
        F.max_by("symbol", at).alias("last_leader"), F.max_by("drift_bps", at).alias("last_drift_bps"))


def _outside(events: DataFrame, marks: DataFrame, keys: list[str], width_us: int, ts: str, tie: str, mark_id: str) -> DataFrame:
    hit = asof(events, marks.withColumnRenamed("ts_us", "mark_us"), keys, left_ts=ts, right_ts="mark_us", left_id=tie,
               right_id=mark_id, right_cols=["mark_us"])
    return hit.where(F.col("mark_us").isNull() | (F.col(ts) - F.col("mark_us") >= width_us)).drop("mark_us")


def blackout_gate(signals: DataFrame, shocks: DataFrame, *, duration_us: int = 5_000_000, ts: str = "ts_us", tie: str = "trade_id") -> DataFrame:
    """Drop signals inside a blackout of any leader.  Blackouts have one length, so only the last shock matters."""
    return _outside(signals, shocks, [], duration_us, ts, tie, "shock_id")


def tombstone_filter(ticks: DataFrame, burials: DataFrame, *, cooldown_us: int = 900_000_000) -> DataFrame:
    """Drop ticks of a symbol up to ``cooldown_us`` after its burial (``symbol, ts_us, burial_id``)."""
    return _outside(ticks, burials, ["symbol"], cooldown_us + 1, "ts_us", "trade_id", "burial_id")


def liquidity_pull(book: DataFrame, *, drop: float = 0.40, max_traded: float = 1000.0) -> DataFrame:
    """Bid liquidity that vanished between two updates without trades (``symbol, ts_us, seq, bid_liq, traded``)."""
    prev = previous(book, ["symbol"], ["ts_us", "seq"], {"base_liq": "bid_liq"})
    base = F.coalesce("base_liq", "bid_liq")
    ratio = (base - F.col("bid_liq")) / F.when(base != 0, base).otherwise(1)
    return prev.withColumn("drop_ratio", ratio).where((F.col("drop_ratio") > drop) & (F.col("traded") < max_traded)).drop("base_liq")


def pulse_verified(pulses: DataFrame, tape: DataFrame, *, min_imbalance: float = 0.8, coherence_us: int = 10_000,
                   intensity: float = 1.5) -> DataFrame:
    """Book pulses confirmed by a trade just before them (``symbol, ts_us, pulse_id, imbalance, avg_vol``)."""
    hit = asof(pulses, tape.select("symbol", F.col("ts_us").alias("l1_us"), F.col("trade_id").alias("l1_id"), F.col("size").alias("l1_vol")),
               ["symbol"], left_ts="ts_us", right_ts="l1_us", left_id="pulse_id", right_id="l1_id", right_cols=["l1_us", "l1_vol"])
    strong = floor_div(F.col("l1_vol") * 100_000_000, F.col("avg_vol") + 1) > int(intensity * 100_000_000)
    ok = (F.abs("imbalance") >= min_imbalance) & (F.col("ts_us") - F.col("l1_us") <= coherence_us) & strong
    return hit.withColumn("is_real", F.coalesce(ok, F.lit(False)))


def heat_divergence(primary: DataFrame, reference: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Buckets where the primary feed runs hotter than the reference by more than ``threshold``."""
    both = primary.withColumnRenamed("heat", "primary_heat").join(reference.withColumnRenamed("heat", "reference_heat"), "bucket_us")
    delta = F.col("primary_heat") - F.col("reference_heat")
    return both.withColumn("divergence", delta).withColumn("is_lagging", delta > threshold)


def rolling_win_rate(outcomes: DataFrame, *, window: int = 10, floor: float = 0.3) -> DataFrame:
    """Win rate over the last ``window`` outcomes (``key, idx, win``); below ``floor`` the operator is compromised."""
    w = Window.partitionBy("key", "_block").orderBy("idx").rowsBetween(-(window - 1), 0)
    return blocks(outcomes, "idx", window - 1).withColumn("win_rate", F.sum("win").over(w) / float(window)) \
        .where(F.col("_home") & (F.col("idx") >= window - 1)).drop("_block", "_home") \
        .withColumn("compromised", F.col("win_rate") < floor)


def failures_step(limit: int, quarantine_us: int):
    """Run of failures with quarantine; state [failures, quarantined until or None]."""
    def step(state, rows: pd.DataFrame, done: int):
        run, until = state
        out = []
        for ts, ok in zip(rows["ts_us"].tolist(), rows["success"].tolist()):
            if until is not None and ts < until:
                out.append((run, "QUARANTINED", until))
                continue
            if until is not None:  # the event that finds the quarantine over lifts it and is not judged
                run, until = 0, None
                out.append((run, "LIFTED", until))
                continue
            run = 0 if ok else run + 1
            until = ts + quarantine_us if run >= limit else None
            out.append((run, "TRIGGERED" if until is not None else "JUDGED", until))
        frame = rows[["ts_us", "event_id"]].assign(failures=[o[0] for o in out], status=[o[1] for o in out],
                                                   until_us=pd.array([o[2] for o in out], dtype="Int64"))
        return [run, until], 0, frame
    return step


def consecutive_failures(outcomes: DataFrame, *, limit: int = 3, quarantine_us: int = 14_400_000_000) -> DataFrame:
    """Three failures in a row quarantine a symbol for four hours of exchange time (``symbol, ts_us, event_id, success``)."""
    return fold(outcomes, ["symbol"], ["ts_us", "event_id"], failures_step(limit, quarantine_us), [0, None],
                "ts_us BIGINT, event_id BIGINT, failures BIGINT, status STRING, until_us BIGINT")
