"""Seeded random properties of bars, toxicity and streams."""

import random

import pytest
from pyspark.sql import functions as F

from tapeworks.operators import bars, vpin
from tapeworks.streaming.queries import drain, stream_radar
from tapeworks.streaming.steps import RadarParams, silence_step

S = 1_000_000


@pytest.fixture(scope="module")
def tape(spark):
    rnd = random.Random(11)
    rows, t = [], 0
    for i in range(1500):
        t += rnd.choice([1, 1, 2, 5, 4000]) * 1000
        rows.append((rnd.choice("AAAB"), t, i, rnd.randint(50, 200), rnd.randint(1, 9), rnd.choice(["Buy", "Sell"])))
    return spark.createDataFrame(rows, "symbol string, ts_us long, trade_id long, price long, size long, side string") \
        .withColumn("notional", F.col("price") * F.col("size")).cache()


def test_volume_is_conserved(tape):
    total = {r.symbol: r.n for r in tape.groupBy("symbol").agg(F.sum("notional").alias("n")).collect()}
    for made in (bars.split_bars(tape, 7000, include_open=True, n=9), bars.dollar_bars(tape, 7000, include_open=True, n=9)):
        got = {r.symbol: (r.n, r.d) for r in made.groupBy("symbol").agg(F.sum("notional").alias("n"), F.sum(F.col("buy_notional") + F.col("sell_notional") - F.col("notional")).alias("d")).collect()}
        assert got == {k: (v, 0) for k, v in total.items()}
    assert bars.split_bars(tape, 7000).where("notional <> 7000").count() == 0
    assert bars.dollar_bars(tape, 7000).where("notional < 7000").count() == 0


def test_vpin_range_and_finite_z(tape):
    s = vpin.vpin_signals(bars.dollar_bars(tape, 7000), window=5, base_threshold=7000, z_history=20)
    assert s.count() > 50
    assert s.where("vpin < 0 OR vpin > 1 OR isnan(z_score) OR abs(z_score) > 1e6").count() == 0


def test_integer_split_matches_sequence(tape):
    from tapeworks.operators.bars import split_bars_scaled
    got = {(r.symbol, r.bar_idx): (r.volume, r.open, r.close, r.ema, r.variance, r.is_synthetic) for r in split_bars_scaled(tape, 600, scale=10, n=7).collect()}
    want = {}
    for sym in "AB":
        acc = vol = ema = n = mean = m2 = 0
        opened = None
        for r in tape.where(F.col("symbol") == sym).orderBy("ts_us", "trade_id").collect():
            left, qty, made = r.price * r.size // 10, r.size, 0
            while left > 0:
                if opened is None:
                    opened, synthetic = r.price, made > 0
                need = 600 - acc
                if left < need:
                    acc, vol, left = acc + left, vol + qty, 0
                    continue
                part = qty * need // left
                vol, left, qty, made = vol + part, left - need, qty - part, made + 1
                ema = r.price if ema == 0 else (r.price * 2 + ema * 13) // 15
                n += 1
                d = r.price - mean
                mean += d // n
                m2 += d * (r.price - mean)
                want[(sym, n - 1)] = (vol, opened, r.price, ema, m2 // (n - 1) if n > 1 else 0, synthetic)
                acc = vol = 0
                opened = None
    assert got == want


def test_stream_equals_batch_in_many_files(spark, tape, tmp_path):
    params = RadarParams(threshold=7000, window=5, z_threshold=1.0, z_history=20, cooldown_us=20 * S)
    src = str(tmp_path / "in")
    shape = tape.withColumn("turnover", F.lit(0).cast("long"))
    for k in range(4):
        shape.where((F.col("trade_id") >= k * 375) & (F.col("trade_id") < (k + 1) * 375)).coalesce(1).write.mode("append").parquet(src)
    live = spark.readStream.schema(shape.schema).option("maxFilesPerTrigger", 1).parquet(src)
    got = sorted((r.symbol, r.ts_us, round(r.z_score, 6)) for r in drain(stream_radar(live, params)).collect())
    from tapeworks.operators.alerts import radar_alerts
    sig = vpin.vpin_signals(bars.dollar_bars(tape, 7000), window=5, base_threshold=7000, z_threshold=1.0, z_history=20)
    want = sorted((r.symbol, r.end_us, round(r.z_score, 6)) for r in radar_alerts(sig, 20 * S).collect())
    assert got == want and len(got) > 3


def test_silence_step():
    assert silence_step(None, False, [0, 10, 200, 210], 60)[2] == [("PARTIAL_BLINDNESS", 70), ("PARTIAL_BLINDNESS_CLEARED", 200)]
    assert silence_step(0, True, [100], 60) == (100, False, [("PARTIAL_BLINDNESS_CLEARED", 100)])
    assert silence_step(0, False, [10, 20], 60)[2] == []
