"""Composable recurrences, cooldown chains, faded sums and repeated intents against plain loops."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeworks.operators import book, health, labels, vpin
from tapeworks.operators.detectors import greedy_cooldown
from tapeworks.plans import chains, scans


@pytest.mark.parametrize("block", [1, 7, 128])
def test_maps_compose(monkeypatch, block):
    monkeypatch.setattr(scans, "BLOCK", block)
    rnd = np.random.default_rng(1)
    maps = np.stack([rnd.choice([0.0, 0.5, 1.0, 1.2], 400), rnd.normal(size=400), rnd.choice([-np.inf, -1.0, 0.0], 400), rnd.choice([np.inf, 0.5, 2.0], 400)])
    place = np.concatenate([np.arange(150), np.arange(1), np.arange(249)])
    got = scans.values_of(maps.copy(), place, np.full(400, 0.7))
    x = 0.7
    for k in range(400):
        x = 0.7 if place[k] == 0 else x
        x = min(maps[3, k], max(maps[2, k], maps[0, k] * x + maps[1, k]))
        assert math.isclose(x, got[k], rel_tol=1e-9, abs_tol=1e-9)


@pytest.mark.parametrize("slices", [1, 5, 23])
def test_hot_sector(spark, slices):
    """One sector has nine events in ten; its slices compose."""
    rnd = random.Random(2)
    rows = [("hot" if i % 10 else f"s{i % 30}", i, i, rnd.choice(["awakening", "failed", "failed", "intent", "tick", "tick"])) for i in range(900)]
    got = {r.event_id: (r.heat, r.fatigue) for r in health.sector_heat(spark.createDataFrame(rows, "sector string, ts_us long, event_id long, kind string"), n=slices).collect()}
    state = {}
    for sector, _, i, kind in rows:
        heat, tired = state.get(sector, (0.0, 0.0))
        if kind == "awakening":
            heat = min(2.0, heat + 0.4)
        elif kind == "failed":
            tired = min(50.0, tired + 1)
        elif kind == "intent":
            tired = max(0.0, tired - 2)
        else:
            heat *= 0.995 / (1 + tired * 0.1)
        state[sector] = heat, tired
        assert got[i][1] == tired and math.isclose(got[i][0], heat, rel_tol=1e-9)


def test_trust(spark):
    rnd = random.Random(3)
    rows = [("A", rnd.choice([1, 1, 1, 2, None]), i, i, rnd.choice(["trade", "cancel", "read"]), float(rnd.randint(1, 9))) for i in range(400)]
    got = {r.event_id: r.weight for r in book.spoof_trust(spark.createDataFrame(rows, "symbol string, price long, ts_us long, event_id long, kind string, qty double")).collect()}
    state = {}
    for _, price, _, i, kind, qty in rows:
        t, c = state.get(price, (0.0, 0.0))
        if kind == "read":
            active = max(t, c)
            assert math.isclose(got[i], min(1.0, 5 * t / active) if active >= 1e-9 else 1.0, rel_tol=1e-9)
            t, c = t * 0.95, c * 0.95
        else:
            t, c = (t + qty, c) if kind == "trade" else (t, c + qty)
        state[price] = t, c
    assert len(got) == sum(r[4] == "read" for r in rows)


@pytest.mark.parametrize("slices", [1, 4, 40])
def test_cooldown_of_a_key_without_pause(spark, slices):
    rnd, rows, ts = random.Random(4), [], 0
    for i in range(1200):
        ts += rnd.choice([0, 0, 1, 2, 3])
        rows.append(("hot" if i % 9 else "other", ts, i))
    got = {r.trade_id for r in greedy_cooldown(spark.createDataFrame(rows, "symbol string, ts_us long, trade_id long"), ["symbol"], 7, n=slices).collect()}
    last, want = {}, set()
    for sym, t, i in rows:
        if sym not in last or t - last[sym] >= 7:
            last[sym] = t
            want.add(i)
    assert got == want


def test_cooldown_map_of_all_times():
    rnd = np.random.default_rng(5)
    for cooldown in (0, 1, 4, 50):
        ts = np.cumsum(rnd.integers(0, 4, 60)) + 10
        pieces = chains.cooldown_map(ts, cooldown)
        assert (pieces["lo"].to_numpy()[1:] == pieces["hi"].to_numpy()[:-1]).all()
        for last in [-chains.ENDLESS, *range(0, int(ts[-1]) + 60)]:
            want = last
            for t in ts.tolist():
                want = t if t - want >= cooldown else want
            assert chains.look_up(pieces, np.array([last]))[0][0] == want


def test_every_intent_is_labelled(spark):
    bars = spark.createDataFrame([("A", i, 100 + i % 3, 98, 100) for i in range(80)], "symbol string, bar_idx long, high long, low long, close long")
    one = (1, "A", 1, 100, 5, 9000, 9000)
    intents = spark.createDataFrame([(*one, 5), (*one, 50), (*one, 5), (*one, 5)], "intent_id long, symbol string, side int, entry_px long, entry_bar long, tp_bps long, sl_bps long, max_bars long")
    assert sorted(r.exit_bar for r in labels.triple_barrier(intents, bars, block_bars=7).collect()) == [10, 10, 10, 55]


@pytest.mark.parametrize("block", [40, 4096])
def test_fading_over_long_silences(spark, block):
    """Silences of any length, among them some far outside the range of e's powers."""
    hour, rnd, rows, ts = 3_600_000_000, random.Random(6), [], 0
    for i in range(160):
        ts += rnd.choice([hour // 20, hour // 20, 3 * hour, 200 * hour, 90_000 * hour if i % 40 == 7 else hour])
        buy = rnd.randint(0, 100)
        rows.append(("A", i, buy, 100 - buy, 100, 10, 10 + i % 3, ts))
    bars = spark.createDataFrame(rows, "symbol string, bar_idx long, buy_notional long, sell_notional long, notional long, open long, close long, end_us long")
    got = {r.bar_idx: r for r in vpin.vpin_signals(bars, window=6, base_threshold=100, z_history=15, decay_gap_us=hour, tau_hours=2.0, block=block).collect()}
    imb, vs, before = [], [], None
    for _, i, buy, sell, _, _, _, ts in rows:
        gap = ts - before if before is not None else 0
        left, before = math.exp(-gap / (2 * hour)) if gap > hour else 1.0, ts
        imb, vs = ([x * left for x in imb] + [abs(buy - sell)])[-6:], [x * left for x in vs]
        if i >= 5:
            v = min(1.0, sum(imb) / 600)
            vs = (vs + [v])[-15:]
            mean = sum(vs) / len(vs)
            z = (v - mean) / math.sqrt(max(sum(x * x for x in vs) / len(vs) - mean * mean, 1e-12))
            assert math.isclose(got[i].vpin, v, rel_tol=1e-12, abs_tol=1e-12) and math.isclose(got[i].z_score, z, rel_tol=1e-7, abs_tol=1e-7)


@pytest.mark.parametrize("block", [1, 4, 64])
def test_exits_of_signals(spark, block):
    """Every signal against every snapshot of its holding time."""
    from tapeworks.operators import execution
    rnd = random.Random(block)
    books = []
    for i in range(240):
        p = 100 + rnd.randint(-2, 2)
        side = lambda up: [(p + up * k, rnd.randint(1, 40)) for k in range(1, rnd.randint(1, 4))]  # noqa: B023, E731
        books.append((rnd.choice("AAB"), i + i // 7, i, side(-1), side(1)))
    signals = [(k, rnd.choice("AAB"), rnd.randint(0, 280), rnd.choice([1, -1]), rnd.choice([99, 100, 101, 0]), rnd.choice([10, 30, 60, 400, 0])) for k in range(150)]
    level = "array<struct<price:bigint,qty:bigint>>"
    got = {r.signal_id: (r.exit_us, r.reason) for r in execution.exit_rules(
        spark.createDataFrame(signals, "signal_id long, symbol string, ts_us long, direction int, anchor_price long, anchor_volume long"),
        spark.createDataFrame(books, f"symbol string, ts_us long, book_id long, bids {level}, asks {level}"), max_holding_us=40, block=block).collect()}
    want = {}
    for k, sym, ts, d, price, volume in signals:
        for bsym, at, _, bids, asks in books:
            if bsym != sym or at <= ts:
                continue
            own, other = (bids, asks) if d > 0 else (asks, bids)
            left = next((q for p, q in own if p == price), 0)
            reason = ("TIME_DECAY" if at - ts > 40 else "WALL_COLLAPSE" if price > 0 and volume > 0 and left < volume * 0.25
                      else "DYNAMIC_TARGET" if other and other[0][1] > volume * 1.5 else None)
            if reason:
                want[k] = (at, reason)
                break
    assert got == want and len({r for _, r in want.values()}) == 3


@pytest.mark.parametrize(("slices", "target", "ttl"), [(1, 300, 50), (5, 300, 50), (40, 300, 50), (40, 90, 400), (40, 5000, 30)])
def test_clock_of_one_hot_market(spark, slices, target, ttl):
    from tapeworks.operators.bars import hybrid_clock_buckets
    rnd, rows, ts = random.Random(slices + ttl), [], 0
    for i in range(900):
        ts += rnd.choice([0, 1, 1, 2, 5, 60 if i % 50 == 0 else 1])
        rows.append(("B" if i % 11 == 0 else "A", ts, i, rnd.randint(1, 40), rnd.randint(-9, 9)))
    tape = spark.createDataFrame(rows, "symbol string, ts_us long, trade_id long, notional long, ofi long")
    got = {tuple(r) for r in hybrid_clock_buckets(tape, target, ttl, n=slices).select("symbol", "ts_us", "trade_id", "volume", "ofi", "ticks", "trigger").collect()}
    state, want = {}, set()
    for sym, t, i, usd, flow in rows:
        volume, total, count, since = state.get(sym, (0, 0, 0, t))
        volume, total, count = volume + usd, total + flow, count + 1
        full, late = volume >= target, t - since >= ttl
        if full or late and volume * 10 >= target * 8:
            want.add((sym, t, i, volume, total, count, "VOLUME_TARGET" if full else "TTL_EXPIRY"))
        state[sym] = (0, 0, 0, t) if full or late else (volume, total, count, since)
    assert got == want and (want or target == 5000)
