"""The radar over micro-batches, for tapes whose busiest market is more than one task.

``stream_radar`` keeps a market in one state group, which is right while a batch of its ticks
is small.  Here every micro-batch is a table: its ticks are cut into slices, a hot market into
as many as its share asks for, slices report exit maps that are composed, and detectors run as
in the batch operators.  What one batch hands to the next is a few rows a market: the open bar,
the last bars, the open sweep, the last order-flow buckets and the last alert of every kind.

Ticks may arrive out of order.  Those newer than the watermark (the latest time seen less
``delay_us``) are *held back* and released in (time, id) order once it has passed them; only a
tick at or behind a watermark that was already released is given out as a row of kind ``LATE``.

A batch reads what the batch before it left and overwrites its own output and state, so a
batch that is run again changes nothing.  State alternates between two folders.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeworks import schemas
from tapeworks.operators.bars import merge_partials, reset_bar_step
from tapeworks.operators.detectors import greedy_cooldown, large_candidates, liquidity_bank, ofi_buckets, pulse_candidates, sweeps_from
from tapeworks.operators.vpin import vpin_signals
from tapeworks.plans.chains import reset_fold
from tapeworks.plans.lookup import lookup
from tapeworks.plans.slices import dense_index
from tapeworks.session import ensure_checkpoint_dir
from tapeworks.streaming.steps import OUT, RadarParams

TICKS = schemas.TAPE + ", turnover BIGINT, threshold BIGINT"
STATE: Mapping[str, str] = {
    "held": TICKS,
    "open": "symbol STRING, " + schemas.PARTIAL_BAR,
    "bars": "symbol STRING, bar_idx BIGINT, end_us BIGINT, open BIGINT, close BIGINT, notional BIGINT, buy_notional BIGINT, sell_notional BIGINT",
    "sweeps": "symbol STRING, state STRING",
    "buckets": "symbol STRING, bucket_us BIGINT, ofi BIGINT",
    "last": "memory STRING, kind STRING, symbol STRING, ts_us BIGINT",
    "mark": "batch BIGINT, upto_us BIGINT",
}


def _names(schema: str) -> list[str]:
    return T._parse_datatype_string(schema).fieldNames()


class RadarBatches:
    """``foreachBatch`` writer; ``alerts`` reads what all batches gave out."""

    def __init__(self, spark: SparkSession, params: RadarParams, path: str | None = None, *, delay_us: int = 0, slices: int | None = None):
        self.params, self.delay_us, self.slices = params, delay_us, slices
        self.path = path or f"{ensure_checkpoint_dir(spark)}/radar-{uuid.uuid4().hex}"

    def __call__(self, batch: DataFrame, number: int) -> None:
        self.advance(batch, number)

    def alerts(self, spark: SparkSession) -> DataFrame:
        schema = f"symbol STRING, {OUT}"
        if not any(self.mark(spark, k) for k in (0, 1)):
            return spark.createDataFrame([], schema)
        return spark.read.schema(f"{schema}, batch BIGINT").parquet(f"{self.path}/out").drop("batch")

    def warm(self, seed: DataFrame) -> None:
        """Take in past ticks without alerts, before the first batch."""
        self.advance(seed, -1, silent=True)

    def finish(self, spark: SparkSession) -> None:
        """Release what is still held, at the end of a tape."""
        number = max([m.batch for m in (self.mark(spark, k) for k in (0, 1)) if m], default=-1) + 1
        if not self.before(spark, number)[0]["held"].isEmpty():
            self.advance(spark.createDataFrame([], TICKS), number, final=True)

    def mark(self, spark: SparkSession, slot: int):
        """Number and watermark of the batch that left the state in a folder, written last; none before the first."""
        found = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/state/{slot}/mark/_SUCCESS")
        if found.getFileSystem(spark._jsc.hadoopConfiguration()).exists(found):
            return spark.read.schema(STATE["mark"]).parquet(f"{self.path}/state/{slot}/mark").first()

    def before(self, spark: SparkSession, number: int) -> tuple[dict[str, DataFrame], int | None]:
        """State that batch ``number - 1`` left; empty before the first one."""
        slot = (number - 1) % 2
        mark = self.mark(spark, slot)
        if mark and mark.batch == number - 1:
            return {k: spark.read.schema(v).parquet(f"{self.path}/state/{slot}/{k}") for k, v in STATE.items()}, mark.upto_us
        if number > 0:
            raise ValueError(f"batch {number} has no state to go on from in {self.path}")
        return {k: spark.createDataFrame([], v) for k, v in STATE.items()}, None

    def advance(self, batch: DataFrame, number: int, *, silent: bool = False, final: bool = False) -> None:
        spark, p = batch.sparkSession, self.params
        prev, upto = self.before(spark, number)
        slot = f"{self.path}/state/{number % 2}"

        def keep(name: str, df: DataFrame) -> DataFrame:
            """A table of the new state, written and read again."""
            df.select(*[F.col(f.name).cast(f.dataType) for f in T._parse_datatype_string(STATE[name]).fields]).write.mode("overwrite").parquet(f"{slot}/{name}")
            return spark.read.schema(STATE[name]).parquet(f"{slot}/{name}")

        limit = F.col("threshold") if "threshold" in batch.columns else F.lit(p.threshold)
        turnover = F.col("turnover") if "turnover" in batch.columns else F.lit(0)
        given = batch.withColumns({"threshold": limit.cast("long"), "turnover": turnover.cast("long")}).select(*_names(TICKS))
        given.write.mode("overwrite").parquet(f"{slot}/given")
        given = spark.read.schema(TICKS).parquet(f"{slot}/given")
        newest = given.agg(F.max("ts_us")).first()[0]
        mark = 1 << 62 if final else max([t for t in (upto, newest - self.delay_us if newest is not None else None) if t is not None], default=None)
        behind = F.lit(False) if upto is None else F.col("ts_us") <= upto
        ahead = F.lit(False) if mark is None else F.col("ts_us") > mark
        waiting = prev["held"].unionByName(given.where(~behind))
        keep("held", waiting.where(ahead))
        ticks = waiting.where(~ahead)

        side = F.when(F.col("side") == "Sell", "sell").otherwise("buy")
        late = _rows(given.where(behind), "LATE", F.col("trade_id"), side)
        last: list[DataFrame] = []
        with ThreadPoolExecutor(4) as pool:  # bars and detectors do not wait for one another
            bar_rows = pool.submit(self.bar_alerts, ticks, prev, upto, keep, last)
            found = [f.result() for f in [pool.submit(d, ticks, prev, keep, last) for d in (self.sweeps, self.large_prints, self.pulses)]]
            liquidity = self.thinned([f for f in found if f is not None], prev, last)
            out = late.unionByName(bar_rows.result())
        if liquidity is not None:
            ratio = F.coalesce("ratio_to_median", F.lit(0.0)) if "ratio_to_median" in liquidity.columns else F.lit(0.0)
            out = out.unionByName(_rows(liquidity, F.col("kind"), F.col("trade_id"), F.col("direction"), ratio))
        out = out.where(F.lit(not silent))
        out.write.mode("overwrite").parquet(f"{self.path}/out/batch={number}")
        everything = prev["last"]
        for df in last:
            everything = everything.unionByName(df)
        keep("last", everything.groupBy("memory", "kind", "symbol").agg(F.max("ts_us").alias("ts_us")))
        keep("mark", spark.createDataFrame([(number, mark)], STATE["mark"]))

    def cooled(self, events: DataFrame, memory: str, keys: list[str], cooldown_us: int, prev: dict, last: list[DataFrame], *, ts: str = "ts_us", tie: str = "trade_id") -> DataFrame:
        """Events that keep their distance from the last kept one, earlier batches included."""
        past = prev["last"].where(F.col("memory") == memory)
        blank = [F.lit(False) if f.dataType == T.BooleanType() else F.lit("") if f.dataType == T.StringType() else F.lit(0) for f in events.schema.fields]
        known = {ts: F.col("ts_us"), tie: F.lit(-1), "symbol": F.col("symbol"), "kind": F.col("kind")}
        mine = past.select(*[known.get(f.name, b).cast(f.dataType).alias(f.name) for f, b in zip(events.schema.fields, blank, strict=True)])
        kept = greedy_cooldown(events.unionByName(mine), keys, cooldown_us, ts=ts, tie=tie, n=self.slices).where(F.col(tie) >= 0)
        path = f"{self.path}/kept/{memory}-{uuid.uuid4().hex}"
        kept.write.parquet(path)
        kept = events.sparkSession.read.schema(events.schema).parquet(path)
        kind = F.col("kind") if "kind" in events.columns else F.lit(memory)
        last.append(kept.select(F.lit(memory).alias("memory"), kind.alias("kind"), "symbol", F.col(ts).alias("ts_us")))
        return kept

    def bar_alerts(self, ticks: DataFrame, prev: dict, upto: int | None, keep, last: list[DataFrame]) -> DataFrame:
        """Alerts of the bars that close; open bars go on from the batch before."""
        p = self.params
        carried = prev["open"].select("symbol", F.format_string("[%d, null]", "notional").alias("_start"))
        src = lookup(ticks.select("symbol", "trade_id", "ts_us", "price", "size", "side", "notional", "threshold"), carried, ["symbol"])
        parts = reset_fold(src, ["symbol"], ["ts_us", "trade_id"], reset_bar_step(False), schemas.PARTIAL_BAR, amount="notional", threshold="threshold", n=self.slices, start="_start")
        # the carried part of a bar stands before all new ticks
        first = prev["open"].withColumns({"bar_idx": F.lit(0).cast("long"), "start_id": F.lit(-1).cast("long"), "end_id": F.lit(-1).cast("long")})
        merged = merge_partials(parts.unionByName(first), ["symbol"])
        base = prev["bars"].groupBy("symbol").agg((F.max("bar_idx") + 1).alias("_base"))
        bars = lookup(merged, base, ["symbol"]).withColumn("bar_idx", F.col("bar_idx") + F.coalesce("_base", F.lit(0))).drop("_base")
        path = f"{self.path}/kept/bars-{uuid.uuid4().hex}"
        bars.write.parquet(path)
        bars = ticks.sparkSession.read.schema(bars.schema).parquet(path)
        keep("open", bars.where("NOT closed").withColumns({"start_id": F.lit(-1), "end_id": F.lit(-1)}))
        recent = prev["bars"].unionByName(bars.where("closed").select(*_names(STATE["bars"])))
        signals = vpin_signals(recent, window=p.window, base_threshold=p.threshold, z_threshold=p.z_threshold, z_history=p.z_history,
                               decay_gap_us=p.decay_gap_us, tau_hours=p.tau_hours)
        fresh = signals.where("is_anomaly").where(F.lit(True) if upto is None else F.col("end_us") > upto)
        hot = fresh.select("symbol", "bar_idx", "end_us", "open", "close", "vpin", "z_score", "direction", "absorption")
        kept = self.cooled(hot, "VPIN", ["symbol"], p.cooldown_us, prev, last, ts="end_us", tie="bar_idx")
        newest = recent.groupBy("symbol").agg(F.max("bar_idx").alias("_newest"))
        keep("bars", lookup(recent, newest, ["symbol"]).where(F.col("bar_idx") > F.col("_newest") - p.window - p.z_history))
        worth = bars.select("symbol", "bar_idx", "notional")
        return kept.join(worth, ["symbol", "bar_idx"]).select(
            "symbol", F.lit("VPIN").alias("kind"), F.col("end_us").alias("ts_us"), F.col("bar_idx").alias("ref_id"), "direction", "open", F.col("close").alias("price"), "notional",
            "vpin", "z_score", "absorption")

    def sweeps(self, ticks: DataFrame, prev: dict, keep, last: list[DataFrame]) -> DataFrame | None:
        """Sweeps; a run of trades goes on from the batch before."""
        if not self.params.sweep:
            keep("sweeps", prev["sweeps"])
            return None
        src = lookup(ticks, prev["sweeps"].withColumnRenamed("state", "_start"), ["symbol"])
        hits, left = sweeps_from(src, "_start", **self.params.sweep, n=self.slices, states=True)
        rest = prev["sweeps"].join(left.select("symbol"), "symbol", "left_anti")
        keep("sweeps", left.unionByName(rest))
        return hits

    def large_prints(self, ticks: DataFrame, prev: dict, keep, last: list[DataFrame]) -> DataFrame | None:
        if not self.params.large:
            return None
        rule = {k: v for k, v in self.params.large.items() if k != "cooldown_us"}
        turnover = ticks.groupBy("symbol").agg(F.max("turnover").alias("turnover"))
        return self.cooled(large_candidates(ticks.drop("turnover"), turnover, **rule), "LARGE_PRINT", ["symbol"], self.params.large["cooldown_us"], prev, last)

    def pulses(self, ticks: DataFrame, prev: dict, keep, last: list[DataFrame]) -> DataFrame | None:
        """Order-flow pulses; a carried bucket stands as one trade of its flow at its start."""
        if not self.params.ofi:
            keep("buckets", prev["buckets"])
            return None
        rule = {k: v for k, v in self.params.ofi.items() if k != "cooldown_us"}
        flow = F.col("ofi")
        carried = prev["buckets"].select("symbol", F.lit(-1).cast("long").alias("trade_id"), F.col("bucket_us").alias("ts_us"), F.lit(0).cast("long").alias("price"),
                                         F.when(flow < 0, "Sell").otherwise("Buy").alias("side"), F.abs(flow).alias("notional"))
        both = ticks.select("symbol", "trade_id", "ts_us", "price", "side", "notional").unionByName(carried)
        found = pulse_candidates(both, **rule, n=self.slices).where("trade_id >= 0")
        placed = dense_index(ofi_buckets(both, self.params.ofi["bucket_us"]), ["symbol"], ["bucket_us"], "_idx")
        newest = placed.groupBy("symbol").agg(F.max("_idx").alias("_newest"))
        keep("buckets", lookup(placed, newest, ["symbol"]).where(F.col("_idx") > F.col("_newest") - self.params.ofi["history"]))
        return self.cooled(found, "OFI_PULSE", ["symbol"], self.params.ofi["cooldown_us"], prev, last)

    def thinned(self, found: list[DataFrame], prev: dict, last: list[DataFrame]) -> DataFrame | None:
        """All tick alerts, at the distance that the second cooldown asks for."""
        if not found:
            return None
        bank = liquidity_bank(*found)
        limit = self.params.liquidity_cooldown_us
        return bank if limit is None else self.cooled(bank, "limit", ["kind", "symbol"], limit, prev, last)


def _rows(df: DataFrame, kind: str | Column, ref: Column, direction: Column, z: Column | None = None) -> DataFrame:
    """Tick events in the radar's columns."""
    zero = F.lit(0.0)
    return df.select("symbol", (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), "ts_us", ref.alias("ref_id"), direction.alias("direction"), F.col("price").alias("open"),
                     "price", "notional", zero.alias("vpin"), (zero if z is None else z).alias("z_score"), F.lit(False).alias("absorption"))


def run_batches(ticks: DataFrame, params: RadarParams, *, path: str | None = None, delay_us: int = 0, seed: DataFrame | None = None, slices: int | None = None) -> DataFrame:
    """Alerts of all that a stream of ticks holds now, in the micro-batches its source cuts."""
    spark = ticks.sparkSession
    radar = RadarBatches(spark, params, path, delay_us=delay_us, slices=slices)
    if seed is not None:
        radar.warm(seed)
    q = ticks.writeStream.foreachBatch(radar).option("checkpointLocation", f"{radar.path}/log").trigger(availableNow=True).start()
    q.awaitTermination()
    radar.finish(spark)
    return radar.alerts(spark)


__all__ = ["RadarBatches", "run_batches"]
