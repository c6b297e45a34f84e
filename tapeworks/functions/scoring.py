"""Scores, limits and gates that depend on one row only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeworks.functions.numeric import clamp, floor_div

# Sensitivity tiers.
TIERS = {
    "conservative": {"z_threshold": 2.5, "vpin_window": 50, "cooldown_sec": 600.0},
    "active": {"z_threshold": 2.0, "vpin_window": 50, "cooldown_sec": 300.0},
    "scanner": {"z_threshold": 1.7, "vpin_window": 30, "cooldown_sec": 120.0},
}


def notional_polarity(ticks: DataFrame, scale: int = 1) -> DataFrame:
    """Traded value, and whether the passive side was the buyer (an aggressive sell).

    With price and size both scaled (1e8 on the wire) pass that ``scale``.
    """
    value = F.col("price") * F.col("size") if scale == 1 else floor_div(F.col("price").cast("decimal(20,0)") * F.col("size").cast("decimal(18,0)"), F.lit(scale))
    return ticks.withColumn("notional", value).withColumn("is_buyer_maker", F.col("side") == "Sell")


def adaptive_threshold(turnover: Column, *, target_bars: float = 200.0, low: float = 20_000.0, high: float = 5_000_000.0,
                       default: float = 1_000_000.0) -> Column:
    """Bar threshold from daily turnover; unknown or zero turnover gives the default."""
    return F.when(turnover > 0, F.bround(clamp(turnover / target_bars, low, high), 2)).otherwise(F.lit(default))


def sensitivity_params(tier: Column) -> Column:
    """Radar parameters of a tier name; unknown names mean ``active``."""
    key = F.lower(F.trim(F.coalesce(tier, F.lit(""))))

    def row(name: str) -> Column:
        return F.struct(*[F.lit(v).alias(k) for k, v in TIERS[name].items()])
    return F.when(key == "conservative", row("conservative")).when(key == "scanner", row("scanner")).otherwise(row("active"))


def signal_score(vpin: Column, bullish_prob: Column, *, micro_weight: float = 0.85, sentiment_weight: float = 0.15) -> Column:
    micro = F.least(F.lit(1.0), vpin / 0.8) * 100
    sentiment = F.coalesce(bullish_prob, F.lit(0.5)) * 100
    return F.struct(F.bround(micro, 1).alias("micro_base"), F.bround(sentiment, 1).alias("sent_contrib"),
                    (micro * micro_weight + sentiment * sentiment_weight).cast("int").alias("final_score"))


def alpha_decay_score(initial: Column, held_ms: Column, imbalance: Column) -> Column:
    return initial * F.exp(-(F.lit(0.001) * F.exp(imbalance * -5)) * held_ms)


def amputation_price(entry: Column, side: Column, best: Column, max_loss_bps: str = "15.0") -> Column:
    """Worst acceptable exit on DECIMAL prices: never further from entry than the loss limit."""
    give = entry * (F.lit(max_loss_bps).cast("decimal(12,4)") / F.lit(10_000).cast("decimal(12,0)"))
    return F.when(F.lower(side) == "buy", F.greatest(best, entry - give)).otherwise(F.least(best, entry + give))


def microprice(bid: Column, bid_qty: Column, ask: Column, ask_qty: Column, bid_weight: Column | float = 1.0,
               ask_weight: Column | float = 1.0) -> Column:
    """Struct of microprice, imbalance and spread."""
    bv, av = bid_qty * bid_weight, ask_qty * ask_weight
    total = bv + av
    thin = total < 1e-9
    safe = F.when(~thin, total)
    return F.struct(F.coalesce((bid * av + ask * bv) / safe, (bid + ask) / 2.0).alias("microprice"),
                    F.coalesce((bv - av) / safe, F.lit(0.0)).alias("imbalance"), (ask - bid).alias("spread"))


def imbalance_state(bid: Column, ask: Column, imbalance: Column, threshold: float = 0.55) -> Column:
    idle = bid.isNull() | ask.isNull() | (bid >= ask)
    return F.when(idle, "IDLE").when(imbalance > threshold, "BUY_IMPULSE").when(imbalance < -threshold, "SELL_IMPULSE").otherwise("IDLE")


def transit_lag(raw: Column, arrival_ms: Column, offset_ms: Column | float = 0.0) -> Column:
    """Latency against the time stamp in the raw text; null when there is none."""
    def after(marker: str) -> Column:
        return F.regexp_extract(raw, marker + r"\s*(-?\d+)\s*[,}]", 1)
    text = F.when(raw.contains('"ts":'), after('"ts":')).when(raw.contains('"E":'), after('"E":'))
    return (arrival_ms - offset_ms) - text.try_cast("long")


def alpha_intent(signals: DataFrame, *, vpin_threshold: float, min_roc_bps: int = 10, levels: int = 2, max_qty: float = 5.0,
                 ttl_ms: int = 5000) -> DataFrame:
    """Orders from toxic signals in the leader's direction, sized by the first book levels.

    ``bids``/``asks`` are arrays of (price, qty), best level first.
    """
    side = F.when(F.col("leader_roc_bps") < 0, "SELL").otherwise("BUY")
    book = F.when(F.col("leader_roc_bps") < 0, F.col("bids")).otherwise(F.col("asks"))
    hot = signals.where((F.col("vpin") >= vpin_threshold) & (F.abs("leader_roc_bps") > min_roc_bps)) \
        .withColumn("_side", side).withColumn("_book", F.slice(book, 1, levels))
    qty = F.least(F.aggregate("_book", F.lit(0.0), lambda a, l: a + l["qty"].cast("double")), F.lit(max_qty))
    return hot.withColumn("qty", qty).where("qty > 0").select(
        *[c for c in signals.columns if c not in ("bids", "asks", "vpin", "leader_roc_bps")], F.col("_side").alias("side"),
        F.try_element_at("_book", F.lit(1))["price"].alias("price"), "qty", F.lit(ttl_ms).alias("ttl_ms"))
