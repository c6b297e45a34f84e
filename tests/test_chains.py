"""Exit maps of reset chains against running the rows."""

import numpy as np
import pandas as pd
import pytest

from tapeworks.operators.bars import bar_ends, dollar_bars
from tapeworks.plans import chains


def run(amount, threshold, filled):
    ends, left = bar_ends(amount, threshold, filled)
    return left, len(ends)


@pytest.mark.parametrize("changes", [0, 1, 5])
def test_map_and_composition(changes):
    rnd = np.random.default_rng(changes)
    for _ in range(60):
        sizes = rnd.integers(1, 40, 3)
        amounts = [rnd.integers(0, 30, n) for n in sizes]
        limits = []
        for n in sizes:
            t = np.full(n, rnd.integers(20, 120))
            for at in rnd.integers(0, n, changes):
                t[at:] = rnd.integers(20, 120)
            limits.append(t)
        maps = [chains.exit_map(a, t) for a, t in zip(amounts, limits, strict=True)]
        whole = chains.compose(chains.compose(maps[0], maps[1]), maps[2])
        for v in [0, 1, 7, 19, 40, 80, 119, 500]:
            at, closed = v, 0
            for a, t, m in zip(amounts, limits, maps, strict=True):
                out, n = chains.look_up(m, np.array([at]))
                assert (out[0], n[0]) == run(a, t, at)
                at, closed = int(out[0]), closed + int(n[0])
            out, n = chains.look_up(whole, np.array([v]))
            assert (out[0], n[0]) == (at, closed)


@pytest.mark.parametrize("lowest", [0, 20])
def test_threshold_of_every_row(monkeypatch, lowest):
    """A threshold that changes with every row costs no more searches over the slice than one that stays."""
    rnd = np.random.default_rng(lowest)
    amount, changing = rnd.integers(0, 30, 4000), rnd.integers(lowest, 120, 4000)
    asked = []
    search = np.searchsorted
    with monkeypatch.context() as m:
        m.setattr(chains.np, "searchsorted", lambda *a, **kw: asked.append(1) or search(*a, **kw))
        made = chains.exit_map(amount, changing)
    assert len(asked) <= 2
    for v in range(0, 200, 7):
        out, n = chains.look_up(made, np.array([v]))
        assert (out[0], n[0]) == run(amount, changing, v)


@pytest.mark.parametrize("slices", [5, 40])
def test_hot_symbol(spark, monkeypatch, slices):
    """2,000 ticks a bar on one symbol: the jobs do not grow with the slices beyond a level of the tree."""
    rnd = np.random.default_rng(1)
    n = 20_000
    pdf = pd.DataFrame({"symbol": np.where(np.arange(n) < n * 9 // 10, "HOT", "COLD"), "trade_id": np.arange(n), "ts_us": np.arange(n) * 1000, "price": 100, "size": 1, "side": "Buy", "notional": rnd.integers(1, 100, n)})
    jobs = []
    resolve = chains._resolve
    monkeypatch.setattr(chains, "_resolve", lambda *a: jobs.append(1) or resolve(*a))
    got = dollar_bars(spark.createDataFrame(pdf), 100_000, n=slices).toPandas().sort_values(["symbol", "bar_idx"])
    assert len(jobs) <= (1 if slices < chains.DEGREE else 2)
    for symbol, rows in pdf.groupby("symbol"):
        ends, _ = bar_ends(rows["notional"].to_numpy(), np.full(len(rows), 100_000), 0)
        own = got[got["symbol"] == symbol]
        assert own["bar_idx"].tolist() == list(range(len(ends)))
        assert own["end_us"].tolist() == rows["ts_us"].to_numpy()[ends].tolist()
        assert own["notional"].tolist() == np.diff(np.cumsum(rows["notional"].to_numpy())[ends], prepend=0).tolist()
