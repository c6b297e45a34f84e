"""Hand-made cases with known results."""

import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapeworks.functions import scoring
from tapeworks.functions.numeric import floor_div
from tapeworks.operators import alerts, bars, book, detectors, execution, health, ledger, operators, regime, universe, vpin
from tapeworks.sources import wire

S = 1_000_000
BAR = "symbol string, bar_idx long, buy_notional long, sell_notional long, open long, close long, end_us long, notional long"
TICK = "symbol string, ts_us long, trade_id long, price long, size long, side string"


def ticks(spark, rows):
    return spark.createDataFrame([(r[0], r[1], i, *r[2:]) for i, r in enumerate(rows)], TICK).withColumn("notional", F.col("price") * F.col("size"))


def mk_bars(spark, rows):
    return spark.createDataFrame([("A", i, b, s, c, c, i * S, b + s) for i, (b, s, c) in enumerate(rows)], BAR)


def signals(spark, rows, **kw):
    return vpin.vpin_signals(mk_bars(spark, rows), **kw).orderBy("bar_idx").collect()


def test_vpin_values(spark):
    out = signals(spark, [(800, 200, 1), (100, 900, 1), (500, 500, 1)], window=2, base_threshold=1000)
    assert [round(r.vpin, 6) for r in out] == [0.7, 0.4]
    assert out[0].z_score == 0 and not out[0].is_anomaly


def test_vpin_one_sided_and_balanced(spark):
    assert all(r.vpin == 1.0 for r in signals(spark, [(1000, 0, 1)] * 20, window=10, base_threshold=1000))
    assert not any(r.is_anomaly for r in signals(spark, [(500, 500, 1)] * 60, window=10, base_threshold=1000))


@pytest.mark.parametrize("closes,absorbed", [((100, 101, 102, 103), False), ((110, 109, 108, 105), True)])
def test_absorption(spark, closes, absorbed):
    rows = [(500, 500, c) for c in closes[:3]] + [(900, 100, closes[3])]
    last = signals(spark, rows, window=3, base_threshold=1000, z_threshold=0.0, z_history=3)[-1]
    assert last.is_anomaly and last.direction == "long" and last.absorption is absorbed


def test_vpin_blocks_do_not_matter(spark):
    rows = [((i * 37) % 1000, (i * 91) % 700, 100 + i % 13) for i in range(400)]
    kw = dict(window=5, base_threshold=1000, z_history=20)
    for extra in ({}, {"decay_gap_us": S // 2, "tau_hours": 1.0}):
        a, b = (signals(spark, rows, **kw, **extra, block=n) for n in (24, 4096))
        assert [(r.bar_idx, round(r.vpin, 9), round(r.z_score, 6)) for r in a] == [(r.bar_idx, round(r.vpin, 9), round(r.z_score, 6)) for r in b]


def test_split_bar_with_flow(spark):
    t = ticks(spark, [("A", 1, 100, 5, "Buy"), ("A", 2, 200, 5, "Sell")]).withColumn("flow", F.when(F.col("side") == "Buy", 10).otherwise(-20))
    out = bars.split_bars(t, 1000, ofi="flow", include_open=True).orderBy("bar_idx").collect()
    assert (out[0].open, out[0].close, out[0].notional, round(out[0].ofi, 9)) == (100, 200, 1000, 0.0)
    assert out[1].notional == 500


def test_reset_bar_overshoot(spark):
    out = bars.dollar_bars(ticks(spark, [("A", 1, 100, 12, "Sell")]), 1000).collect()
    assert [(r.notional, r.sell_notional, r.buy_notional) for r in out] == [(1200, 1200, 0)]


def test_adaptive_thresholds_over_time(spark):
    t = ticks(spark, [("A", i, 10, 10, "Buy") for i in range(12)]).withColumn("limit", F.when(F.col("ts_us") < 6, 300).otherwise(100))
    out = bars.dollar_bars(t, "limit").orderBy("bar_idx").collect()
    assert [r.tick_count for r in out] == [3, 3, 1, 1, 1, 1, 1, 1]


def test_hybrid_clock(spark):
    ofi = F.when(F.col("notional") == 600, 12).otherwise(8)
    full = bars.hybrid_clock_buckets(ticks(spark, [("A", 0, 600, 1, "Buy"), ("A", S, 400, 1, "Buy")]), 1000, 300 * S, ofi=ofi).collect()
    assert [(r.trigger, r.ticks, round(r.vnofi, 6)) for r in full] == [("VOLUME_TARGET", 2, 0.02)]
    for first, n in ((900, 1), (500, 0)):
        out = bars.hybrid_clock_buckets(ticks(spark, [("A", 0, first, 1, "Buy"), ("A", 301 * S, 1, 1, "Buy")]), 1000, 300 * S, ofi=F.lit(0)).collect()
        assert [r.trigger for r in out] == ["TTL_EXPIRY"] * n


def test_sweep(spark):
    five = [("A", i * S, 25_000, 1, "Buy") for i in range(5)]
    kw = dict(min_trades=5, window_us=10 * S, min_notional=100_000, cooldown_us=60 * S)
    assert [(r.direction, r.trade_count) for r in detectors.sweep(ticks(spark, five), **kw).collect()] == [("buy", 5)]
    again = five + [("A", (10 + i) * S, 25_000, 1, "Buy") for i in range(5)]
    assert detectors.sweep(ticks(spark, again), **kw).count() == 1
    late = [("A", t * S, 50_000, 1, "Buy") for t in (0, 1, 30)]
    assert detectors.sweep(ticks(spark, late), min_trades=3, window_us=10 * S, min_notional=1, cooldown_us=0).count() == 0


def test_large_print(spark):
    turn = spark.createDataFrame([("A", 10_000_000)], "symbol string, turnover long")
    t = ticks(spark, [("A", 0, 100_000, 1, "Buy"), ("B", 0, 100_000, 1, "Buy"), ("B", 1, 300_000, 1, "Sell")])
    out = {r.symbol: r for r in detectors.large_print(t, turn, pct_threshold=0.005, min_notional=25_000).collect()}
    assert out["A"].pct_of_turnover == 0.01 and out["A"].direction == "buy" and out["B"].direction == "sell"


def test_ofi_pulse(spark):
    t = ticks(spark, [("A", i * 10 * S, 1000, 1, "Buy") for i in range(5)] + [("A", 50 * S, 50_000, 1, "Buy")])
    out = detectors.ofi_pulse(t, bucket_us=10 * S, k=2.0, min_notional=1, min_history=3).collect()
    assert [(r.direction, r.ratio_to_median) for r in out] == [("buy", 50.0)]


def test_cooldown_slices(spark):
    ev = spark.createDataFrame([("A", (i * i) % 997, i) for i in range(300)], "symbol string, ts_us long, trade_id long")
    want, last = [], None
    for r in sorted(ev.collect(), key=lambda r: (r.ts_us, r.trade_id)):
        if last is None or r.ts_us - last >= 25:
            want.append(r.trade_id)
            last = r.ts_us
    for n in (1, 16):
        assert sorted(r.trade_id for r in detectors.greedy_cooldown(ev, ["symbol"], 25, n=n).collect()) == sorted(want)


def test_thresholds_and_tiers(spark):
    df = spark.createDataFrame([(5e10,), (2e7,), (1e6,), (0.0,), (None,)], "t double")
    assert [r[0] for r in df.select(scoring.adaptive_threshold(F.col("t"))).collect()] == [5e6, 1e5, 2e4, 1e6, 1e6]
    tiers = spark.createDataFrame([(" ACTIVE ",), ("Scanner",), ("",), ("what",)], "t string")
    assert [r[0] for r in tiers.select(scoring.sensitivity_params(F.col("t"))["z_threshold"]).collect()] == [2.0, 1.7, 2.0, 2.0]


def test_floor_div(spark):
    df = spark.createDataFrame([(-7, 2), (7, 2), (-8, 2), (-1, 3)], "a long, b long")
    assert [r[0] for r in df.select(floor_div(F.col("a"), F.col("b"))).collect()] == [-4, 3, -4, -1]


def test_wire(spark):
    good = json.dumps({"topic": "publicTrade.BTCUSDT", "data": [{"T": 1700000000000, "s": "BTCUSDT", "S": "Sell", "v": "0.5", "p": "100.123456789"},
                                                                  {"T": 1700000000100, "s": "BTCUSDT", "S": "Buy", "v": "1e-3", "p": "7"}]})
    msgs = spark.createDataFrame([(good,), ('{"topic": "tickers.X", "data": []}',), ("{broken publicTrade",)], "value string")
    out = wire.parse_trades(msgs).orderBy("ts_us").collect()
    assert [(r.symbol, r.side, r.price, r.size, r.is_buyer_maker) for r in out] == [
        ("BTCUSDT", "Sell", 10012345678, 50000000, True), ("BTCUSDT", "Buy", 700000000, 100000, False)]


def test_conflation(spark):
    rows = [("A", i, 10, 1, "Buy") for i in range(50)] + [("A", 50 + i, 11, 2, "?") for i in range(50)]
    out = bars.conflate_ticks(ticks(spark, rows), S).collect()
    assert {(r.side, r.volume, r.price) for r in out} == {("Buy", 50, 11), ("Sell", 100, 11)}


def headers(spark, rows):
    return spark.createDataFrame([("A", i, i, *r) for i, r in enumerate(rows)], "symbol string, ts_us long, msg_id long, type string, u long, first_u long, seq long")


@pytest.mark.parametrize("rows,want", [
    ([("snapshot", 10, None, None), ("delta", 11, None, None), ("delta", 9, None, None), ("delta", 11, None, None)], ["snapshot", "ok", "stale_or_duplicate_u", "stale_or_duplicate_u"]),
    ([("snapshot", 10, None, None), ("delta", 15, 13, None), ("delta", 16, 16, None)], ["snapshot", "sequence_gap", "no_snapshot_anchor"]),
    ([("snapshot", 10, None, None), ("delta", 11, 12, None)], ["snapshot", "invalid_u_range"]),
    ([("snapshot", 10, None, None), ("delta", 11, 11, 5), ("delta", 12, 12, 5)], ["snapshot", "ok", "stale_or_duplicate_seq"])])
def test_book_validity(spark, rows, want):
    got = book.book_validity(headers(spark, rows)).where("step = 0").orderBy("msg_id").collect()
    assert [r.verdict for r in got] == want


def test_book_replay(spark):
    got = book.book_validity(headers(spark, [("delta", 11, 11, None), ("delta", 12, 12, None), ("snapshot", 11, None, None), ("delta", 13, 13, None)])).orderBy("ts_us", "step").collect()
    assert [(r.msg_id, r.verdict) for r in got] == [(0, "no_snapshot_anchor"), (1, "no_snapshot_anchor"), (2, "snapshot"), (1, "replayed"), (3, "ok")]


def test_max_safe_qty_against_search(spark):
    asks = [(1000, 500), (1003, 700), (1010, 900)]
    b = spark.createDataFrame([("A", True, [(990, 400)], asks)], "symbol string, consistent boolean, bids array<struct<price:long,qty:long>>, asks array<struct<price:long,qty:long>>")
    cut = book.liquidity_haircut(b).first().ask_cut
    for budget in (1, 900, 4_000, 9_999, 1_000_000):
        left, qty, usd = budget, 0, 0
        for lv in cut:
            best = max(q for q in range(lv.sure_qty + 1) if (n := lv.price * q // 100) + n * 45 // 100_000 <= left)
            n = lv.price * best // 100
            qty, usd, left = qty + best, usd + n, left - n - n * 45 // 100_000
            if best < lv.sure_qty:
                break
        got = book.max_safe_qty(b, budget, scale=100).first()
        assert (got.msq_qty, got.msq_px) == ((qty, usd * 100 // qty) if qty else (None, None))


def test_shadow_position(spark):
    none = spark.createDataFrame([], "symbol string, confirmed_qty double, confirmed_avg_px double")
    open_ = spark.createDataFrame([("BTC", 0.1, 65000.0)], "symbol string, qty double, worst_price double")
    r = ledger.shadow_position(none, open_).first()
    assert (r.shadow_qty, r.exposure) == (0.1, 6500.0)
    held = spark.createDataFrame([("ETH", 1.0, 10.0)], "symbol string, confirmed_qty double, confirmed_avg_px double")
    assert {x.symbol: x.allowed for x in ledger.strike_gate(held, open_, 1e9).collect()} == {"BTC": False, "ETH": True}


def test_arbitration_consumes(spark):
    o = spark.createDataFrame([(i, "A", 2.0, i) for i in range(3)], "cl_ord_id long, symbol string, qty double, dispatched_us long")
    p = spark.createDataFrame([("A", 5.0, 2.0)], "symbol string, exchange_qty double, confirmed_qty double")
    assert [r.fill_qty for r in ledger.position_arbitration(o, p).orderBy("cl_ord_id").collect()] == [2.0, 1.0, 0.0]
    assert [r.fill_qty for r in ledger.position_arbitration(o, p, consume=False).orderBy("cl_ord_id").collect()] == [2.0, 2.0, 2.0]


def test_heartbeat_slices_and_rules(spark):
    import random
    rnd = random.Random(3)
    data = [("op", i * S // 2, i, rnd.choice([0.0, -100.0, 50_000.0, 300.0, 900.0, 4000.0]), rnd.choice([0, 0, 1, 3, 12]), rnd.choice([0, 0, 1, 2]), rnd.choice([0, 0, 1])) for i in range(400)]
    b = spark.createDataFrame(data, "operator_id string, ts_us long, beat_id long, reaction_ms double, click_count int, error_delta int, success_delta int")
    one, many = (operators.heartbeat_score(b, n=n).orderBy("beat_id").collect() for n in (1, 9))
    assert one == many and {r.state for r in one} >= {"CLEAR", "LOCKED", "COOLDOWN"}
    streak = operators.heartbeat_score(spark.createDataFrame([("o", 0, 0, 0.0, 0, 5, 0), ("o", S, 1, 0.0, 0, 0, 1)], b.schema)).orderBy("beat_id").collect()
    assert [r.error_streak for r in streak] == [5, 3]


def test_cusum_break(spark):
    px = [100, 99, 101, 99.5, 100.5] + [100 + 2 * i for i in range(10)]
    out = health.cusum(spark.createDataFrame([("A", i, float(p)) for i, p in enumerate(px)], "symbol string, seq long, price double"), decay=0.1, threshold=2.0, drift=0.1).orderBy("seq").collect()
    assert out[0].signal == 0 and 1 in [r.signal for r in out[5:15]]


def test_outbox(spark, tmp_path):
    rows = [(1, "PENDING", 5, 0, 2), (2, "PENDING", 1, 0, 1), (3, "PENDING", 1, 99, 1), (4, "SENT", 1, 0, 1)]
    box = spark.createDataFrame(rows, "id long, status string, created_us long, execute_after_us long, priority int")
    assert [r.id for r in alerts.pending_alerts(box, 10, 5).collect()] == [2, 1]
    a = spark.createDataFrame([("A", 0, 5, 1, 2, 0.5, 2.5, "long", False)], "symbol string, bar_idx long, end_us long, open long, close long, vpin double, z_score double, direction string, absorption boolean")
    write = alerts.alert_sink(str(tmp_path / "outbox"))
    for epoch in (0, 0, 1):
        write(alerts.outbox_rows(a), epoch)
    stored = spark.read.parquet(str(tmp_path / "outbox")).collect()
    assert len(stored) == 1 and json.loads(stored[0].payload)["event_type"] == "RADAR_ALERT"


def test_training_universe_and_fill(spark):
    t = spark.createDataFrame([("AUSDT", 9e7), ("BUSDT", 5e7), ("CUSDC", 9e9), ("DUSDT", 1.0)], "symbol string, turnover double")
    assert {r.symbol for r in universe.hot_universe(t, max_symbols=4).collect()} == {"AUSDT", "BTCUSDT", "ETHUSDT", "SOLUSDT"}
    o = spark.createDataFrame([(1, "A", 0, 100, 5, "BUY", 10)], "order_id long, symbol string, ts_us long, price long, qty long, side string, queue_qty long")
    e = spark.createDataFrame([("A", 1, 1, 100, 12, 20, 8), ("A", 2, 2, 99, 1, 8, 8)], "symbol string, ts_us long, event_id long, trade_price long, trade_qty long, prev_qty long, cur_qty long")
    r = execution.maker_fill_audit(o, e, horizon_us=S).first()
    assert (r.filled, r.is_filled, r.filled_us) == (5, True, 2)


def test_quarantine_of_failures(spark):
    ev = [("A", i * S, i, i in (0, 9)) for i in range(10)]
    df = spark.createDataFrame(ev, "symbol string, ts_us long, event_id long, success boolean")
    out = regime.consecutive_failures(df, limit=3, quarantine_us=4 * S).orderBy("event_id").collect()
    assert [r.status for r in out] == ["JUDGED", "JUDGED", "JUDGED", "TRIGGERED", "QUARANTINED", "QUARANTINED", "QUARANTINED", "LIFTED", "JUDGED", "JUDGED"]
    assert isinstance(pd.DataFrame([r.asDict() for r in out]), pd.DataFrame)


def test_wire_scale_notional_and_large_sums(spark):
    t = spark.createDataFrame([("A", i, i, 60_000 * 10**8, 3 * 10**8, "Sell") for i in range(4)], "symbol string, ts_us long, trade_id long, price long, size long, side string")
    n = scoring.notional_polarity(t, 10**8)
    assert {(r.notional, r.is_buyer_maker) for r in n.collect()} == {(180_000 * 10**8, True)}
    big = n.withColumn("notional", F.lit(4 * 10**18))  # the cumulative value leaves BIGINT
    out = bars.split_bars(big, 10**18, include_open=True).orderBy("bar_idx").collect()
    assert [r.bar_idx for r in out] == list(range(16)) and {r.notional for r in out} == {10**18}
