"""No limit changes a result."""

import pandas as pd
import pytest

from tapeworks.operators import book, labels, vpin
from tapeworks.streaming.steps import RadarParams, fresh_state, radar_step, score

UPDATE = ("symbol string, ts_us long, msg_id long, type string, u long, first_u long, seq long, "
          "bids array<struct<price: bigint, qty: bigint>>, asks array<struct<price: bigint, qty: bigint>>")


def by_hand(side, entry, first, tp, sl, limit, bars):
    """Label, exit price, exit bar, best and worst move of one intent."""
    top = low = entry
    up, down = entry * (10_000 + side * tp) // 10_000, entry * (10_000 - side * sl) // 10_000
    for idx, high, lowest, close in bars[first:]:
        top, low = max(top, high), min(low, lowest)
        stop, target = (lowest <= down, high >= up) if side > 0 else (high >= down, lowest <= up)
        if stop or target or idx - first >= limit:
            px = (min(down, lowest) if side > 0 else max(down, high)) if stop else up if target else close
            return (-1 if stop else 1 if target else 0), px, idx, *((top - entry, entry - low) if side > 0 else (entry - low, top - entry))
    return None


@pytest.mark.parametrize("block_bars", [1, 3, 8, 1000])
def test_labels_of_long_intents(spark, block_bars):
    bars = [(i, 1000 + (i * 37) % 50 + 5, 1000 + (i * 37) % 50 - 5, 1000 + (i * 37) % 50) for i in range(60)]
    intents = [(k, "A", 1 if k % 2 else -1, 1000 + k % 7, k, 100 + k % 5 * 150, 80 + k % 3 * 300, 1 + k % 40) for k in range(60)]
    got = labels.triple_barrier(spark.createDataFrame(intents, "intent_id long, symbol string, side int, entry_px long, entry_bar long, tp_bps long, sl_bps long, max_bars long"),
                                spark.createDataFrame([("A", *b) for b in bars], "symbol string, bar_idx long, high long, low long, close long"), block_bars=block_bars)
    want = {i: by_hand(side, px, bar, tp, sl, n, bars) for i, _, side, px, bar, tp, sl, n in intents}
    assert {r.intent_id: (r.label, r.exit_px, r.exit_bar, r.mfe, r.mae) for r in got.collect()} == {i: w for i, w in want.items() if w}
    assert sum(w is not None for w in want.values()) > 50


def test_deep_books(spark):
    side = lambda step: [(10_000 + step * k, 10 + k) for k in range(1, 201)]
    feed = spark.createDataFrame([("A", 1, 1, "snapshot", 10, None, None, side(-1), side(1))], UPDATE)
    whole = book.book_at(feed, 5).first()
    assert len(whole.bids) == len(whole.asks) == 200 and [x.price for x in whole.asks] == [p for p, _ in side(1)]
    best = book.book_at(feed, 5, depth=50).first()
    assert best.bids == whole.bids[:50] and best.asks == whole.asks[:50]
    budget = 3 * 10**9
    deep = book.cross_book_snapshot(feed, 5, budget, scale=1, max_age_us=10).first()
    cut = book.cross_book_snapshot(feed, 5, budget, scale=1, max_age_us=10, depth=50).first()
    assert deep.msq_qty > cut.msq_qty


def tick(ts, tid, side="Buy", notional=10, **more):
    return {"ts_us": ts, "trade_id": tid, "price": 5, "size": 2, "side": side, "notional": notional, **more}


def test_late_ticks_are_given_out():
    params = RadarParams(threshold=1000, window=2)
    state, out = radar_step(params, fresh_state(), pd.DataFrame([tick(10, 1), tick(20, 2)]))
    assert out.empty
    state, out = radar_step(params, state, pd.DataFrame([tick(15, 7, "Sell"), tick(20, 2), tick(30, 3)]))
    assert out[["kind", "ts_us", "ref_id", "direction"]].values.tolist() == [["LATE", 15, 7, "sell"]]
    assert state["filled"] == 30 and state["last"] == [30, 3]


def test_threshold_of_the_tick():
    params = RadarParams(threshold=10**9, window=2)
    state, _ = radar_step(params, fresh_state(), pd.DataFrame([tick(k, k, threshold=25) for k in range(1, 10)]))
    assert state["bars"] == 3 and state["filled"] == 0


def test_live_decay_equals_batch(spark):
    """The same bars, some after long silences, scored one by one and as a table."""
    hour = 3_600_000_000
    bars, ts = [], 0
    for i in range(40):
        ts += hour // 10 if i % 9 else 3 * hour
        buy = (i * 37) % 100
        bars.append({"symbol": "A", "bar_idx": i, "buy_notional": buy, "sell_notional": 100 - buy, "notional": 100, "open": 10, "close": 10 + i % 3, "end_us": ts})
    params = RadarParams(threshold=100, window=5, z_history=12, decay_gap_us=hour, tau_hours=2.0)
    state = fresh_state()
    live = [score(state, b, params) for b in bars]
    batch = vpin.vpin_signals(spark.createDataFrame(bars), window=5, base_threshold=100, z_history=12, decay_gap_us=hour, tau_hours=2.0).orderBy("bar_idx").collect()
    assert live[:4] == [None] * 4 and len(batch) == 36
    for (v, z), row in zip(live[4:], batch, strict=True):
        assert abs(v - row.vpin) < 1e-9 and abs(z - row.z_score) < 1e-6
