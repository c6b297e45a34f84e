"""The radar over micro-batches against the batch operators."""

import random

import pytest
from pyspark.sql import functions as F

from tapeworks.operators import alerts, bars, detectors, vpin
from tapeworks.streaming.batches import RadarBatches, run_batches
from tapeworks.streaming.steps import RadarParams

S = 1_000_000
SWEEP = dict(min_trades=3, window_us=20 * S, min_notional=800, cooldown_us=30 * S)
LARGE = dict(pct_threshold=0.004, min_notional=900, cooldown_us=25 * S)
OFI = dict(bucket_us=15 * S, history=12, k=1.5, min_notional=900, min_history=3, cooldown_us=20 * S)
PARAMS = RadarParams(threshold=7000, window=5, z_threshold=0.8, z_history=20, cooldown_us=20 * S, sweep=SWEEP, large=LARGE, ofi=OFI, liquidity_cooldown_us=40 * S,
                     decay_gap_us=9 * S, tau_hours=1.0)
TURNOVER = {"A": 150_000, "B": 200_000}


@pytest.fixture(scope="module")
def tape(spark):
    """Market A has nine ticks in ten; the bar size changes along the tape."""
    rnd = random.Random(3)
    rows, ts = [], 0
    for i in range(1600):
        ts += rnd.choice([0, 1, 1, 2, 3]) * S // 2 + (12 * S if i % 97 == 0 else 0)
        sym = "B" if i % 10 == 0 else "A"
        size, price = rnd.randint(1, 40), 20 + rnd.randint(0, 20)
        rows.append((sym, i, ts, price, size, rnd.choice(["Buy", "Buy", "Sell"]) if (i // 40) % 2 else "Sell", price * size, TURNOVER[sym], 7000 if i % 800 < 500 else 5000))
    return spark.createDataFrame(rows, "symbol string, trade_id long, ts_us long, price long, size long, side string, notional long, turnover long, threshold long")


def whole(tape):
    """What the batch operators say about the whole tape."""
    made = bars.dollar_bars(tape, "threshold")
    signals = vpin.vpin_signals(made, window=5, base_threshold=7000, z_threshold=0.8, z_history=20, decay_gap_us=9 * S, tau_hours=1.0)
    out = {("VPIN", r.symbol, r.end_us, r.bar_idx, r.direction, round(r.vpin, 9), round(r.z_score, 6)) for r in alerts.radar_alerts(signals, 20 * S).collect()}
    turnover = tape.groupBy("symbol").agg(F.max("turnover").alias("turnover"))
    plain = tape.drop("turnover")
    bank = detectors.liquidity_bank(detectors.sweep(plain, **SWEEP), detectors.large_print(plain, turnover, **LARGE), detectors.ofi_pulse(plain, **OFI), cooldown_us=40 * S)
    return out | {(r.kind, r.symbol, r.ts_us, r.trade_id, r.direction, 0.0, round(r.ratio_to_median, 6) if r.kind == "OFI_PULSE" else 0.0) for r in bank.collect()}


def seen(df):
    rows = [(r.kind, r.symbol, r.ts_us, r.ref_id, r.direction, round(r.vpin, 9), round(r.z_score, 6)) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.fixture(scope="module")
def wanted(tape):
    want = whole(tape)
    assert {w[0] for w in want} == {"VPIN", "SWEEP", "LARGE_PRINT", "OFI_PULSE"} and len(want) > 30
    return want


def live(spark, tape, path, files, pick):
    for k in range(files):
        tape.where(pick(k)).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(tape.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_hot_market_in_sixteen_slices(spark, tape, wanted, tmp_path):
    """Batches whose hot market is cut into sixteen slices give what the whole tape gives."""
    stream = live(spark, tape, str(tmp_path / "in"), 2, lambda k: F.floor(F.col("trade_id") / 900) == k)
    assert seen(run_batches(stream, PARAMS, slices=16)) == wanted


def test_shuffled_files_are_held_back(spark, tape, wanted, tmp_path):
    """Ticks spread over files at random are released in order; nothing is late."""
    mixed = F.pmod(F.hash("trade_id"), F.lit(2))
    stream = live(spark, tape, str(tmp_path / "in"), 2, lambda k: mixed == k)
    span = tape.agg(F.max("ts_us") - F.min("ts_us")).first()[0]
    assert seen(run_batches(stream, PARAMS, delay_us=span, slices=3)) == wanted


def test_late_seeded_and_repeated(spark, tape, wanted, tmp_path):
    """A seed warms without alerts, a repeated batch changes nothing, and ticks behind the watermark are given out."""
    radar = RadarBatches(spark, PARAMS, str(tmp_path / "radar"), slices=3)
    cut = tape.where("trade_id = 800").first().ts_us
    radar.warm(tape.where(F.col("ts_us") <= cut))
    rest = tape.where(F.col("ts_us") > cut)
    parts = [rest.where("trade_id < 1200"), rest.where("trade_id >= 1200").unionByName(tape.where("trade_id in (3, 4)"))]
    for number, part in [(0, parts[0]), (0, parts[0]), (1, parts[1]), (1, parts[1])]:
        radar(part, number)
    radar.finish(spark)
    got = seen(radar.alerts(spark))
    assert {(g[0], g[3]) for g in got if g[0] == "LATE"} == {("LATE", 3), ("LATE", 4)}
    assert {g for g in got if g[0] != "LATE"} == {w for w in wanted if w[2] > cut}
