"""How much work queries do, on rows made here."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapeworks import catalog
from tapeworks.operators import execution
from tapeworks.streaming import queries as st
from tapeworks.streaming.steps import RadarParams, fresh_state, radar_step

S = 1_000_000


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    """A folder with an event table of 3,000 rows."""
    at = tmp_path_factory.mktemp("events")
    rnd = random.Random(5)
    rows = [(i, 1_704_067_200 + 300 * i + rnd.randint(0, 200), rnd.randint(0, 99), rnd.choice(["purchase", "error", "view", "signup"]), round(rnd.expovariate(1 / 50), 2),
             '{"k": %d}' % rnd.randint(0, 99)) for i in range(3000)]
    df = spark.createDataFrame(rows, "event_id long, ts long, user_id long, event_type string, value double, props string")
    df.withColumn("ts", F.timestamp_seconds("ts")).coalesce(1).write.parquet(f"{at}/events.parquet")
    return str(at)


def test_radar_metrics_reads_the_events_once(spark, events):
    catalog.load()
    out = catalog.QUERIES["radar_metrics"](spark, events)
    leaves = out._jdf.queryExecution().optimizedPlan().collectLeaves()
    assert "LogicalRelation" not in {leaves.apply(i).getClass().getSimpleName() for i in range(leaves.size())}
    want = catalog.QUERIES["pipeline_metrics"](spark, events).first()
    assert out.first().asDict() == want.asDict() and want.tick_count > 2500


def test_radar_takes_a_group_in_steps():
    """Shuffled parts come in order, some rows at a time, as narrow integers until then; the alerts are those of one step."""
    rnd = random.Random(2)
    rows = [("A", 10 * k // 2 * S, k, rnd.randint(20, 40), rnd.randint(1, 120), rnd.choice(["Buy", "Sell"])) for k in range(4000)]
    df = pd.DataFrame([rows[k] for k in (*range(0, 4000, 2), *range(1, 4000, 2), 999, 1000)], columns=["symbol", "ts_us", "trade_id", "price", "size", "side"])
    df = df.assign(notional=df["price"] * df["size"], turnover=1 << 40)
    params = RadarParams(threshold=20_000, window=5, z_threshold=0.5, z_history=20, cooldown_us=S, sweep=dict(min_trades=2, window_us=60 * S, min_notional=4000, cooldown_us=60 * S),
                         ofi=dict(bucket_us=200 * S, history=9, k=1.5, min_notional=900, min_history=3, cooldown_us=90 * S), liquidity_cooldown_us=300 * S)
    want, whole = radar_step(params, fresh_state(), df)
    state, found, sizes = fresh_state(), [], []
    for some in st.in_order(iter([df[:1500], df[1500:]]), 1000):
        assert some["size"].dtype == np.int64
        sizes.append(len(some))
        state, out = radar_step(params, state, some)
        found += list(out.itertuples(index=False, name=None))
    assert sizes == [1001, 1000, 1000, 1000, 1] and state == want and len(found) > 50
    assert sorted(found) == sorted(whole.itertuples(index=False, name=None))
    assert st._packed(df)["size"].itemsize == 1 and len({id(x) for x in st._packed(df)["side"]}) == 2


def test_orders_meet_no_events_after_they_are_traded_through(spark, monkeypatch):
    """Every trade goes through the orders, so few steps reach the scan; fills are those of a walk over all events."""
    rnd = random.Random(4)
    events = [("A", 10 * k, k, rnd.choice([100, 101, 102, 103, 110 if k % 50 == 0 else 104]), rnd.randint(1, 9), 40, rnd.randint(0, 40)) for k in range(900)]
    orders = [(k, "A" if k % 7 else "B", 100 * k, rnd.choice([99, 102, 106]), rnd.randint(1, 5), rnd.choice(["BUY", "SELL"]), rnd.randint(0, 30)) for k in range(80)]
    orders.append(orders[11])
    o = spark.createDataFrame(orders, "order_id long, symbol string, ts_us long, price long, qty long, side string, queue_qty long")
    e = spark.createDataFrame(events, "symbol string, ts_us long, event_id long, trade_price long, trade_qty long, prev_qty long, cur_qty long")
    rows, scan = [], execution.scan
    monkeypatch.setattr(execution, "scan", lambda df, *a, **k: (rows.append(df.count()), scan(df, *a, **k))[1])
    monkeypatch.setattr(execution, "BLOCK_EVENTS", 8, raising=False)
    got = {r.order_id: (r.filled, r.is_filled, r.filled_us) for r in execution.maker_fill_audit(o, e, horizon_us=4000, touch=1).collect()}
    want = {}
    for oid, sym, placed, price, qty, side, queue in dict.fromkeys(orders):
        copies, before, least, at = orders.count((oid, sym, placed, price, qty, side, queue)), queue + qty, queue + qty, None
        for s, ts, _, tp, tq, prev, cur in events:
            if s != sym or not placed < ts <= placed + 4000 or at is not None:
                continue
            through = abs(tp - price) > 1 and (tp < price if side == "BUY" else tp > price)
            for _ in range(copies):
                burned = max(0, tq - max(0, tq + cur - prev)) if abs(tp - price) <= 1 else 0
                before = min(max(0, before - burned), 0 if through else max(qty, cur) if cur > 0 else before)
            least, at = min(least, before), ts if before <= 0 else None
        want[oid] = (qty - min(least, qty), at is not None, at)
    assert got == want
    assert rows[0] < 3000  # 19,379 with every trade through that follows


def test_exit_rules_number_signals_with_the_snapshots(spark, events, monkeypatch):
    """Signals are placed in the one pass that numbers the snapshots, not by joins that move both sides again."""
    def moved(*_, **__):
        raise AssertionError("as-of join")
    catalog.load()
    monkeypatch.setattr(execution, "asof", moved)
    got = catalog.QUERIES["exit_rules"](spark, events).collect()
    assert len(got) > 100 and {r.reason for r in got} >= {"WALL_COLLAPSE", "TIME_DECAY"}
