"""Meta-labelling: triple barriers, label statistics, feature stitching, purged folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeworks.functions.numeric import floor_div
from tapeworks.plans.lookup import lookup
from tapeworks.plans.slices import dense_index


def triple_barrier(intents: DataFrame, bars: DataFrame, *, block_bars: int = 256) -> DataFrame:
    """Label intents (``intent_id, symbol, side, entry_px, entry_bar, tp_bps, sl_bps, max_bars``).

    Bars are packed into arrays of ``block_bars``; an intent meets the array of
    every block that its holding time touches, one for most.  That is an
    equi-join whose hot keys AQE can split, and no intent-bar pair is ever
    shuffled.  Each meeting gives the block's first hit and its extremes, and an
    intent's blocks are joined up in order, so any ``max_bars`` is labelled.
    Equal intents are one and get their labels back in the end, so every row is labelled.
    Barriers are checked stop first, then target, then the time limit; the stop
    fills at the worse of stop and bar extreme, the target at its price.
    """
    block = F.floor(F.col("bar_idx") / block_bars).cast("long")
    packed = bars.withColumn("_block", block).groupBy("symbol", "_block").agg(
        F.array_sort(F.collect_list(F.struct("bar_idx", "high", "low", "close"))).alias("_bars"))
    long = F.col("side") > 0
    bps = 10_000

    def level(up: Column, down: Column) -> Column:
        return floor_div(F.col("entry_px") * F.when(long, bps + up).otherwise(bps - down), bps)
    first, last = (F.floor(c / block_bars).cast("long") for c in (F.col("entry_bar"), F.col("entry_bar") + F.col("max_bars")))
    given = ["intent_id", "symbol", "side", "entry_px", "entry_bar", "tp_bps", "sl_bps", "max_bars"]
    df = intents.groupBy(*given).agg(F.count("*").alias("_times")).withColumn("tp_px", level(F.col("tp_bps"), F.col("tp_bps"))).withColumn("sl_px", level(-F.col("sl_bps"), -F.col("sl_bps")))
    met = df.withColumn("_block", F.explode(F.sequence(first, F.greatest(first, last)))).join(packed, ["symbol", "_block"])

    def sl(b):
        return F.when(long, b["low"] <= F.col("sl_px")).otherwise(b["high"] >= F.col("sl_px"))

    def tp(b):
        return F.when(long, b["high"] >= F.col("tp_px")).otherwise(b["low"] <= F.col("tp_px"))

    def late(b):
        return b["bar_idx"] - F.col("entry_bar") >= F.col("max_bars")
    path = F.filter("_bars", lambda b: (b["bar_idx"] >= F.col("entry_bar")) & (b["bar_idx"] <= F.col("entry_bar") + F.col("max_bars")))
    met = met.withColumn("_path", path).drop("_bars")
    met = met.withColumn("_hit", F.try_element_at(F.filter("_path", lambda b: sl(b) | tp(b) | late(b)), F.lit(1)))
    met = met.withColumn("_seen", F.filter("_path", lambda b: F.col("_hit").isNull() | (b["bar_idx"] <= F.col("_hit.bar_idx"))))
    part = F.struct("_block", F.array_max(F.transform("_seen", lambda b: b["high"])).alias("top"), F.array_min(F.transform("_seen", lambda b: b["low"])).alias("low"))
    df = met.groupBy(*given, "_times", "tp_px", "sl_px").agg(F.collect_list(part).alias("_parts"), F.min(F.when(F.col("_hit").isNotNull(), F.struct("_block", "_hit"))).alias("_end")).where("_end IS NOT NULL")
    df = df.withColumn("_hit", F.col("_end._hit")).withColumn("_parts", F.filter("_parts", lambda p: p["_block"] <= F.col("_end._block")))
    hit = F.col("_hit")
    df = df.withColumn("_top", F.greatest("entry_px", F.array_max(F.transform("_parts", lambda p: p["top"])))) \
        .withColumn("_low", F.least("entry_px", F.array_min(F.transform("_parts", lambda p: p["low"])))) \
        .withColumn("label", F.when(sl(hit), -1).when(tp(hit), 1).otherwise(0)) \
        .withColumn("exit_px", F.when(sl(hit), F.when(long, F.least("sl_px", hit["low"])).otherwise(F.greatest("sl_px", hit["high"])))
                    .when(tp(hit), F.col("tp_px")).otherwise(hit["close"]))
    gain = F.when(long, F.col("exit_px") - F.col("entry_px")).otherwise(F.col("entry_px") - F.col("exit_px"))
    up, down = F.col("_top") - F.col("entry_px"), F.col("entry_px") - F.col("_low")
    df = df.withColumn("_nth", F.explode(F.sequence(F.lit(1), F.col("_times"))))
    return df.select("intent_id", "symbol", "side", "label", "entry_px", "exit_px", "entry_bar", hit["bar_idx"].alias("exit_bar"),
                     (hit["bar_idx"] - F.col("entry_bar")).alias("bars_held"), F.when(long, up).otherwise(down).alias("mfe"),
                     F.when(long, down).otherwise(up).alias("mae"), floor_div(gain * bps, F.col("entry_px")).alias("pnl_bps"))


def label_stats(labels: DataFrame, last_n: int, order: tuple[str, ...] = ("exit_us", "intent_id")) -> DataFrame:
    """Wins, losses and timeouts among the last resolved intents (a top-k report)."""
    recent = labels.orderBy(*[F.col(c).desc() for c in order]).limit(last_n)
    return recent.agg(F.count(F.when(F.col("label") == 1, 1)).alias("wins"), F.count(F.when(F.col("label") == -1, 1)).alias("losses"),
                      F.count(F.when(F.col("label") == 0, 1)).alias("timeouts"))


def latest_labels(labels: DataFrame) -> DataFrame:
    """The label written last wins (``intent_id, label_us, label_id, label, exit_px, pnl_bps``)."""
    newest = F.max_by(F.struct("label", "exit_px", "pnl_bps"), F.struct("label_us", "label_id"))
    return labels.groupBy("intent_id").agg(newest.alias("_l")).select("intent_id", "_l.*")


def stitch_labels(features: DataFrame, labels: DataFrame) -> DataFrame:
    """Feature rows with their label, whichever arrived first; unlabelled rows keep nulls."""
    return features.join(latest_labels(labels), "intent_id", "left").withColumn("is_labeled", F.col("label").isNotNull())


def unlabeled_features(features: DataFrame, labels: DataFrame) -> DataFrame:
    """Compaction: the records that still wait for a label."""
    return features.join(labels.select("intent_id").distinct(), "intent_id", "left_anti")


def training_export(features: DataFrame, labels: DataFrame, *, only_labeled: bool = True, path: str | None = None) -> DataFrame:
    """(x, y) rows; also written as parquet when a path is given."""
    out = stitch_labels(features, labels)
    out = out.where("is_labeled") if only_labeled else out
    out = out.select("intent_id", "x", F.coalesce("label", F.lit(0)).alias("y"))
    if path:
        out.write.mode("overwrite").parquet(path)
    return out


def purged_kfold(events: DataFrame, *, n_splits: int = 5, embargo_pct: float = 0.01, strict: bool = False) -> DataFrame:
    """Train and test members of contiguous folds without leakage (``event_id, t0, t1``).

    A training row may not overlap the fold's label span nor start in the
    embargo after it.  The span ends with the last row's exit; ``strict`` uses
    the latest exit of the fold.  Fold bounds are one row per fold.
    """
    idx = dense_index(events, [], ["t0", "event_id"], "idx").drop("_slice")
    n = events.count()
    small, extra = divmod(n, n_splits)
    wide = extra * (small + 1)
    fold = F.when(F.col("idx") < wide, F.floor(F.col("idx") / (small + 1))) \
        .otherwise(extra + F.floor((F.col("idx") - wide) / max(small, 1))).cast("int")
    rows = idx.withColumn("_own", fold)
    bounds = rows.groupBy(F.col("_own").alias("fold")).agg(
        F.min("t0").alias("_b0"), (F.max("t1") if strict else F.max_by("t1", "idx")).alias("_b1"),
        F.least(F.max("idx") + 1 + int(n * embargo_pct), F.lit(n - 1).cast("long")).alias("_at"))
    bounds = lookup(rows.select(F.col("idx").alias("_at"), F.col("t0").alias("_embargo")), bounds, ["_at"], "inner").drop("_at")
    spread = rows.withColumn("fold", F.explode(F.array(*[F.lit(i) for i in range(n_splits)])))
    both = lookup(spread, bounds, ["fold"], "inner")
    test = F.col("fold") == F.col("_own")
    overlap = (F.col("t0") <= F.col("_b1")) & (F.col("t1") >= F.col("_b0"))
    embargoed = (F.col("t0") > F.col("_b1")) & (F.col("t0") <= F.col("_embargo"))
    return both.where(test | (~overlap & ~embargoed)).select("fold", "event_id", F.when(test, "test").otherwise("train").alias("role"))
