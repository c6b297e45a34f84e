"""Reset chains whose slices compose, so a hot key never runs slice after slice.

A reset bar holds ``filled`` and closes at the first tick that brings it to the
threshold.  What a slice does to the ``filled`` it is entered with is a step
function: the first close is the first tick that is enough, and from there on
the chain of closes is fixed.  So one pass over the data gives every slice's
exit map, a table with at most as many rows as the first bar has ticks (fewer
where chains meet), and maps compose:

1. every slice reports the state it leaves for its last key; a slice that lies
   wholly inside one key stores its map instead;
2. runs of such slices are resolved in a tree of degree ``DEGREE``: maps of
   neighbours are composed level by level, then the entry states are handed
   down.  That is two jobs a level, whatever the tape, and one in all for a run
   of up to ``DEGREE`` slices;
3. one last pass emits rows with the settled entry states.

The driver holds one small record per slice, never a map.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeworks.plans.folds import Step, _emit, _starter, key_runs
from tapeworks.plans.slices import SLICE, slice_rows

DEGREE = 16
ENDLESS = 1 << 62
_MAP = "lo bigint, hi bigint, exit bigint, shift boolean, closed bigint"


def exit_map(amount: np.ndarray, threshold: np.ndarray) -> pd.DataFrame:
    """Pieces [lo, hi) of the entry value with the exit value and the number of closes.

    Where nothing closes the exit is the entry plus ``exit`` (``shift``).  Thresholds may
    change with every row: the next close after a close at i is the first row whose need has
    fallen to the total's negative at i, and that falls along i, so one sorted search finds all.
    """
    total = np.cumsum(amount)
    n = len(total)
    need = threshold - total
    least = np.minimum.accumulate(need)
    before = np.concatenate([[ENDLESS], least[:-1]])
    first = np.flatnonzero((need < before) & (before > 0))  # the tick that closes first for some entry value
    rows = np.arange(n)
    # a row's need cannot be met by the totals up to it, unless its threshold asks for nothing: such a row always closes
    always = np.flatnonzero(threshold <= 0)
    lowest = np.minimum.accumulate(np.where(threshold > 0, need, ENDLESS)) if len(always) else least
    after = np.maximum(np.searchsorted(-lowest, total, side="left"), rows + 1)
    if len(always):
        after = np.minimum(after, np.append(always, n)[np.searchsorted(always, rows, side="right")])
    after = np.where(after < n, after, rows)
    closes = (after > rows).astype(np.int64)
    while closes[after].any():
        closes, after = closes + closes[after], after[after]
    lo, hi = np.maximum(need[first], 0), before[first]
    out = pd.DataFrame({"lo": lo, "hi": hi, "exit": total[-1] - total[after[first]], "shift": False, "closed": 1 + closes[first]})
    run = (out["exit"].ne(out["exit"].shift()) | out["closed"].ne(out["closed"].shift())).cumsum()
    out = out.groupby(run.to_numpy(), sort=False).agg({"lo": "min", "hi": "max", "exit": "first", "shift": "first", "closed": "first"})
    if least[-1] > 0:
        out = pd.concat([out, pd.DataFrame({"lo": [0], "hi": [least[-1]], "exit": [total[-1]], "shift": [True], "closed": [0]})])
    return out.astype({"lo": "int64", "hi": "int64", "exit": "int64", "shift": bool, "closed": "int64"}).sort_values("lo", ignore_index=True)


def cooldown_map(ts: np.ndarray, cooldown: int) -> pd.DataFrame:
    """Pieces [lo, hi) of the time last kept with the one that is last kept afterwards, for events in order of time.

    The first event at least ``cooldown`` later is kept, and from there on the chain is fixed;
    where none is, the time stays (``shift`` by 0).
    """
    n = len(ts)
    rows = np.arange(n)
    after = np.maximum(np.searchsorted(ts, ts + cooldown, side="left"), rows + 1)
    after = np.where(after < n, after, rows)
    while (after[after] != after).any():
        after = after[after]
    hi = ts - cooldown + 1
    lo = np.concatenate([[-ENDLESS], hi[:-1]])
    out = pd.DataFrame({"lo": lo, "hi": hi, "exit": ts[after], "shift": False, "closed": 0})[lo < hi]
    run = out["exit"].ne(out["exit"].shift()).cumsum()
    out = out.groupby(run.to_numpy(), sort=False).agg({"lo": "min", "hi": "max", "exit": "first", "shift": "first", "closed": "first"})
    stays = pd.DataFrame({"lo": [hi[-1]], "hi": [ENDLESS], "exit": [0], "shift": [True], "closed": [0]})
    return pd.concat([out, stays]).astype({"lo": "int64", "hi": "int64", "exit": "int64", "shift": bool, "closed": "int64"}).sort_values("lo", ignore_index=True)


def look_up(pieces: pd.DataFrame, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exit and closes for entry values."""
    at = np.searchsorted(pieces["lo"].to_numpy(), value, side="right") - 1
    out = pieces["exit"].to_numpy()[at] + np.where(pieces["shift"].to_numpy()[at], value, 0)
    return out, pieces["closed"].to_numpy()[at]


def compose(one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
    """The map of two neighbouring slices: ``two`` after ``one``."""
    moved = one[one["shift"]]
    parts = []
    for lo, hi, add in zip(moved["lo"], moved["hi"], moved["exit"], strict=True):
        inner = two[(two["hi"] > lo + add) & (two["lo"] < hi + add)]
        parts.append(inner.assign(lo=np.maximum(inner["lo"] - add, lo), hi=np.minimum(inner["hi"] - add, hi), exit=inner["exit"] + np.where(inner["shift"], add, 0)))
    fixed = one[~one["shift"]]
    if len(fixed):
        out, closed = look_up(two, fixed["exit"].to_numpy())
        parts.append(fixed.assign(exit=out, closed=fixed["closed"] + closed))
    out = pd.concat(parts).sort_values("lo", ignore_index=True)
    run = (out["exit"].ne(out["exit"].shift()) | out["closed"].ne(out["closed"].shift()) | out["shift"] | out["shift"].shift(fill_value=False)).cumsum()
    return out.groupby(run, sort=False).agg({"lo": "min", "hi": "max", "exit": "first", "shift": "first", "closed": "first"}).reset_index(drop=True)


def _survey(step: Step, begin, keys: list[str], exits, amount: str, threshold: str, clock: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = last = at = clock_at = state = held = None
        emitted, amounts, limits = 0, [], []
        for pdf in batches:
            for key, rows in key_runs(pdf, keys):
                if at is None:
                    at, first, last, state = int(rows[SLICE].iloc[0]), key, key, begin(rows)
                    held = state[0]
                elif key != last:
                    state, emitted, last = begin(rows), 0, key
                if last == first:
                    amounts.append(rows[amount].to_numpy(np.int64))
                    limits.append(rows[threshold].to_numpy(np.int64))
                else:
                    amounts, limits = [], []
                    state, n, _ = step(state, rows, emitted)
                    emitted += n
                clock_at = int(rows[clock].iloc[-1])
        if at is None:
            return
        head = pd.DataFrame({"slice": [at], "first_key": [json.dumps(first)], "last_key": [json.dumps(last)], "start": [held], "filled": [state[0]], "emitted": [emitted], "clock": [clock_at]})
        yield head.reindex(columns=_NAMES).astype(_TYPES)
        if amounts:
            yield exits(np.concatenate(amounts), np.concatenate(limits)).assign(slice=at).reindex(columns=_NAMES).astype(_TYPES)
    return run


_REPORT = "slice int, first_key string, last_key string, start bigint, filled bigint, emitted bigint, clock bigint, " + _MAP
_NAMES = [c.split()[0] for c in _REPORT.split(", ")]
_TYPES = {c: "object" if c.endswith("_key") else "boolean" if c == "shift" else "Int64" for c in _NAMES}


def _pieces(pdf: pd.DataFrame) -> pd.DataFrame:
    return pdf[["lo", "hi", "exit", "shift", "closed"]].astype({"shift": bool}).sort_values("lo", ignore_index=True)


def _resolve(maps: DataFrame, length: dict[int, int], entry: dict[int, int]) -> dict[tuple[int, int], tuple[int, int]]:
    """Entry value and closes so far of every (chain, pos), from the entry value of each chain."""
    def walk(start: dict[tuple[int, int], tuple[int, int]]):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            chain, group = int(pdf["chain"].iloc[0]), int(pdf["pos"].iloc[0]) // DEGREE
            value, done = start[chain, group]
            out = []
            for pos, rows in pdf.groupby("pos", sort=True):
                out.append((chain, int(pos), value, done))
                got, closed = look_up(_pieces(rows), np.array([value]))
                value, done = int(got[0]), done + int(closed[0])
            return pd.DataFrame(out, columns=["chain", "pos", "value", "done"])
        return run

    def join_up(pdf: pd.DataFrame) -> pd.DataFrame:
        whole = None
        for _, rows in pdf.groupby("pos", sort=True):
            whole = _pieces(rows) if whole is None else compose(whole, _pieces(rows))
        return whole.assign(chain=int(pdf["chain"].iloc[0]), pos=int(pdf["pos"].iloc[0]) // DEGREE)

    group = (F.col("pos") / DEGREE).cast("int").alias("group")
    if max(length.values()) <= DEGREE:
        start = {(c, 0): (v, 0) for c, v in entry.items()}
    else:
        upper = maps.groupBy("chain", group).applyInPandas(join_up, f"{_MAP}, chain int, pos int").checkpoint(eager=True)
        start = _resolve(upper, {c: -(-n // DEGREE) for c, n in length.items()}, entry)
    rows = maps.groupBy("chain", group).applyInPandas(walk(start), "chain int, pos int, value bigint, done bigint").collect()  # one record per slice
    return {(r.chain, r.pos): (r.value, r.done) for r in rows}


def reset_fold(df: DataFrame, keys: Sequence[str], order: Sequence[str], step: Step, out_schema: str | T.StructType, *, amount: str, threshold: str,
               track_clock: bool = False, n: int | None = None, start: str | None = None, exits=exit_map, empty: int = 0) -> DataFrame:
    """``fold`` for a step with state [filled, last time or None] that resets at ``threshold``; ``order`` begins with the time.

    ``exits`` makes a slice's map from its amounts and thresholds, ``empty`` is the value that a
    key begins with.  ``start`` names a column with the state (JSON, null for none) that a key begins with, the same in all its rows.
    """
    keys, initial = list(keys), [empty, None]
    sliced = df if SLICE in df.columns else slice_rows(df, keys, order, n)
    schema = T.StructType([sliced.schema[k] for k in keys] + [f for f in (T._parse_datatype_string(out_schema) if isinstance(out_schema, str) else out_schema).fields if f.name not in keys])
    seen = sliced.mapInPandas(_survey(step, _starter(initial, start), keys, exits, amount, threshold, order[0]), _REPORT).checkpoint(eager=True)
    line = sorted(seen.where("first_key IS NOT NULL").select(*_NAMES[:7]).collect(), key=lambda r: r.slice)
    whole = [r.first_key == r.last_key for r in line]
    goes_on = [i > 0 and line[i - 1].last_key == r.first_key for i, r in enumerate(line)]
    # chains: runs of slices inside one key, each entered from the slice before
    chain, pos, length, entry = {}, {}, {}, {}
    for i, r in enumerate(line):
        if whole[i]:
            joined = goes_on[i] and whole[i - 1]
            chain[i], pos[i] = (chain[i - 1], pos[i - 1] + 1) if joined else (i, 0)
            length[chain[i]] = pos[i] + 1
            if not joined:
                entry[i] = line[i - 1].filled if goes_on[i] else r.start
    found = {}
    # a slice's own exit is needed only where another follows
    if any(v > 1 for v in length.values()) or any(goes_on[i] and whole[i - 1] for i in range(1, len(line))):
        place = sliced.sparkSession.createDataFrame([(line[i].slice, chain[i], pos[i]) for i in chain], "slice int, chain int, pos int")
        maps = seen.where("lo IS NOT NULL").select("slice", *[c.split()[0] for c in _MAP.split(", ")]).join(F.broadcast(place), "slice").drop("slice")
        # the slice after a chain is entered with the chain's exit: a closing map at its end hands that out
        ends = sliced.sparkSession.createDataFrame([(-ENDLESS, ENDLESS, 0, True, 0, c, length[c]) for c in length], f"{_MAP}, chain int, pos int")
        found = _resolve(maps.unionByName(ends), {c: v + 1 for c, v in length.items()}, entry)
    settled: dict[int, tuple] = {}
    for i, r in enumerate(line):
        if goes_on[i]:
            if whole[i - 1]:
                c = chain[i - 1]
                filled, done = found[c, pos[i - 1] + 1]
                base = line[c - 1].emitted if goes_on[c] else 0
            else:
                filled, done, base = line[i - 1].filled, line[i - 1].emitted, 0
            settled[r.slice] = ([filled, line[i - 1].clock if track_clock else None], base + done)
    return sliced.mapInPandas(_emit(step, initial, keys, settled, schema.fieldNames(), start), schema)
