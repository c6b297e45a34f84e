"""Online form of the radar: one step over a symbol's new ticks and its carried state.

Bars, sweeps and cooldowns use the same functions as the batch folds.  The
state is plain JSON: what the open bar holds, the last N bars, the last Z vpins,
the order-flow buckets and the last alert times.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd

from tapeworks.operators.bars import bar_ends, partial_bars
from tapeworks.operators.detectors import sweep_step
from tapeworks.operators.vpin import HOUR_US

OUT = ("kind STRING, ts_us BIGINT, ref_id BIGINT, direction STRING, open BIGINT, price BIGINT, notional BIGINT, "
       "vpin DOUBLE, z_score DOUBLE, absorption BOOLEAN")
OUT_NAMES = [c.strip().split(" ")[0] for c in OUT.split(",")]


@dataclass(frozen=True)
class RadarParams:
    threshold: int
    window: int = 50
    z_threshold: float = 2.5
    z_history: int = 500
    cooldown_us: int = 300_000_000
    sweep: dict = field(default_factory=dict)
    large: dict = field(default_factory=dict)
    ofi: dict = field(default_factory=dict)
    liquidity_cooldown_us: int | None = None
    decay_gap_us: int | None = None
    tau_hours: float = 4.0


def fresh_state() -> dict:
    return {"last": None, "filled": 0, "open": None, "bars": 0, "imb": [], "closes": [], "vpins": [], "alert": None,
            "sweep": [None, None, 0, 0, 0], "large": None, "buckets": [], "pulse": None, "limits": {}}


def merge_open(a: dict | None, b: dict) -> dict:
    """Join the carried part of a bar with its continuation."""
    if a is None:
        return b
    total = {k: a[k] + b[k] for k in ("notional", "buy_notional", "sell_notional", "tick_count", "volume")}
    return {**b, **total, "open": a["open"], "start_us": a["start_us"], "high": max(a["high"], b["high"]), "low": min(a["low"], b["low"])}


def closed_bars(state: dict, rows: pd.DataFrame, threshold: int) -> list[dict]:
    limits = rows["threshold"].to_numpy(np.int64) if "threshold" in rows else np.full(len(rows), threshold, dtype=np.int64)
    ends, state["filled"] = bar_ends(rows["notional"].to_numpy(), limits, state["filled"])
    parts = partial_bars(rows, ends, 0, None).drop(columns=["bar_idx", "max_gap_us", "start_id", "end_id"]).to_dict("records")
    out = []
    for part in parts:
        bar = merge_open(state["open"], {k: bool(v) if k == "closed" else int(v) for k, v in part.items()})
        state["open"] = None if bar["closed"] else bar
        if bar["closed"]:
            out.append(bar)
    return out


def score(state: dict, bar: dict, p: RadarParams) -> tuple[float, float] | None:
    """vpin and z of a closed bar; None during warm-up.  A silence over ``decay_gap_us`` before the bar fades both histories."""
    silence = bar["end_us"] - state["closed_us"] if state.get("closed_us") is not None else 0
    state["closed_us"] = bar["end_us"]
    if p.decay_gap_us is not None and silence > p.decay_gap_us:
        left = math.exp(-silence / (HOUR_US * max(p.tau_hours, 1.0)))
        state["imb"], state["vpins"] = [x * left for x in state["imb"]], [x * left for x in state["vpins"]]
    state["imb"] = (state["imb"] + [abs(bar["buy_notional"] - bar["sell_notional"])])[-p.window:]
    state["closes"] = (state["closes"] + [bar["close"]])[-p.window:]
    if len(state["imb"]) < p.window:
        return None
    vpin = min(1.0, max(0.0, sum(state["imb"]) / (float(p.threshold) * p.window)))
    state["vpins"] = (state["vpins"] + [vpin])[-p.z_history:]
    v = np.asarray(state["vpins"])
    mean = float(v.mean())
    return vpin, (vpin - mean) / math.sqrt(max(float((v * v).mean()) - mean * mean, 1e-12))


def bar_alerts(state: dict, rows: pd.DataFrame, p: RadarParams) -> list[tuple]:
    out = []
    for bar in closed_bars(state, rows, p.threshold):
        number, state["bars"] = state["bars"], state["bars"] + 1
        got = score(state, bar, p)
        if got is None or not got[1] > p.z_threshold:
            continue
        if state["alert"] is not None and bar["end_us"] - state["alert"] < p.cooldown_us:
            continue
        state["alert"] = bar["end_us"]
        lean, move = bar["buy_notional"] - bar["sell_notional"], bar["close"] - state["closes"][0]
        side = "long" if lean > 0 else ("short" if lean < 0 else "neutral")
        out.append(("VPIN", bar["end_us"], number, side, bar["open"], bar["close"], bar["notional"], got[0], got[1],
                    (lean > 0 and move <= 0) or (lean < 0 and move >= 0)))
    return out


def pulse_alerts(state: dict, rows: pd.DataFrame, *, bucket_us: int, history: int, k: float, min_notional: int, min_history: int,
                 cooldown_us: int) -> list[tuple]:
    """Order-flow pulses; the carried buckets are [start, signed flow]."""
    out, buckets, prior = [], state["buckets"], None
    for ts, tid, price, usd, side in zip(*(rows[c].tolist() for c in ("ts_us", "trade_id", "price", "notional", "side"))):
        start = ts - ts % bucket_us
        if not buckets or buckets[-1][0] != start:
            buckets.append([start, 0])
            del buckets[:-history]
            prior = None
        buckets[-1][1] += -usd if side == "Sell" else usd
        flow = abs(buckets[-1][1])
        if len(buckets) <= min_history or flow < min_notional:
            continue
        if prior is None:
            prior = float(np.median([abs(b[1]) for b in buckets[:-1]]))
        if (flow < 5 * min_notional) if prior <= 0 else (flow / prior < k):
            continue
        if state["pulse"] is not None and ts - state["pulse"] < cooldown_us:
            continue
        state["pulse"] = ts
        out.append(("OFI_PULSE", ts, tid, "buy" if buckets[-1][1] > 0 else "sell", price, price, flow, 0.0,
                    flow / prior if prior > 0 else math.inf, False))
    return out


def print_alerts(state: dict, rows: pd.DataFrame, *, pct_threshold: float, min_notional: int, cooldown_us: int) -> list[tuple]:
    out = []
    big = rows[rows["notional"] >= min_notional]
    for ts, tid, price, usd, side, turnover in zip(*(big[c].tolist() for c in ("ts_us", "trade_id", "price", "notional", "side", "turnover"))):
        if (usd / turnover < pct_threshold) if turnover > 0 else (usd < 10 * min_notional):
            continue
        if state["large"] is not None and ts - state["large"] < cooldown_us:
            continue
        state["large"] = ts
        out.append(("LARGE_PRINT", ts, tid, "sell" if side == "Sell" else "buy", price, price, usd, 0.0, 0.0, False))
    return out


def sweep_alerts(state: dict, rows: pd.DataFrame, params: dict) -> list[tuple]:
    state["sweep"], _, hits = sweep_step(**params)(state["sweep"], rows, 0)
    if hits is None:
        return []
    return [("SWEEP", ts, tid, "sell" if s == "Sell" else "buy", price, price, usd, 0.0, 0.0, False)
            for ts, tid, s, price, usd in zip(*(hits[c].tolist() for c in ("ts_us", "trade_id", "side", "price", "notional")))]


def limited(state: dict, alerts: list[tuple], cooldown_us: int | None) -> list[tuple]:
    """Second cooldown, per kind."""
    if cooldown_us is None:
        return alerts
    kept = []
    for a in sorted(alerts, key=lambda x: (x[1], x[2])):
        last = state["limits"].get(a[0])
        if last is None or a[1] - last >= cooldown_us:
            state["limits"][a[0]] = a[1]
            kept.append(a)
    return kept


def radar_step(p: RadarParams, state: dict, rows: pd.DataFrame) -> tuple[dict, pd.DataFrame]:
    """Advance one symbol by its new ticks, in (ts, id) order.

    Rows before the last processed tick come too late for the state: each is
    given out as a row of kind ``LATE``; the last tick itself, seen again, is a
    repeat.  A row of kind ``resync`` drops the open bar and keeps everything
    else.  A column ``threshold`` sets the bar size tick by tick.
    """
    rows = rows.sort_values(["ts_us", "trade_id"], kind="stable")
    out: list[tuple] = []
    if state["last"] is not None:
        ts, tid = state["last"]
        fresh = (rows["ts_us"] > ts) | ((rows["ts_us"] == ts) & (rows["trade_id"] > tid))
        late = rows[~fresh & ~((rows["ts_us"] == ts) & (rows["trade_id"] == tid))]
        if "kind" in late:
            late = late[late["kind"] != "resync"]
        out += [("LATE", t, i, "sell" if s == "Sell" else "buy", p_, p_, usd, 0.0, 0.0, False)
                for t, i, s, p_, usd in zip(*(late[c].tolist() for c in ("ts_us", "trade_id", "side", "price", "notional")))]
        rows = rows[fresh]
    control = rows["kind"].to_numpy() == "resync" if "kind" in rows else np.zeros(len(rows), dtype=bool)
    live = rows[~control]
    if len(live):
        liquidity = sweep_alerts(state, live, p.sweep) if p.sweep else []
        liquidity += print_alerts(state, live, **p.large) if p.large else []
        liquidity += pulse_alerts(state, live, **p.ofi) if p.ofi else []
        out += limited(state, liquidity, p.liquidity_cooldown_us)
    cuts = [0, *(np.flatnonzero(control)), len(rows)]
    for lo, hi in zip(cuts, cuts[1:]):
        if control[lo:lo + 1].any():
            state["filled"], state["open"] = 0, None
            lo += 1
        if hi > lo:
            out += bar_alerts(state, rows.iloc[lo:hi], p)
    if len(rows):
        state["last"] = [int(rows["ts_us"].iloc[-1]), int(rows["trade_id"].iloc[-1])]
    return state, pd.DataFrame(out, columns=OUT_NAMES)


def silence_step(last: int | None, alerted: bool, times: list[int], limit: int) -> tuple[int | None, bool, list[tuple]]:
    """Silences inside a run of event times, and recoveries."""
    out = []
    for t in sorted(times):
        if last is not None and t < last:
            continue
        if last is not None and not alerted and t - last > limit:
            out.append(("PARTIAL_BLINDNESS", last + limit))
            alerted = True
        if alerted:
            out.append(("PARTIAL_BLINDNESS_CLEARED", t))
            alerted = False
        last = t
    return last, alerted, out


__all__ = ["OUT", "OUT_NAMES", "RadarParams", "fresh_state", "radar_step", "silence_step"]
