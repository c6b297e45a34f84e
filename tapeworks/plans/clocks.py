"""Chains that close on volume or on age, whichever comes first, composed over slices.

What a slice does to an open bucket depends on its volume and its start alone: the first close
is the earlier of two pointers, the first tick that brings the volume and the first that comes
too late, and from there on the chain of closes is fixed.  So a slice inside one key reports, for
every tick that can be the first to close, the bucket it leaves open; ticks with the same outcome
are one row, and none comes after the first tick that closes a bucket opened at the slice's start.
Two neighbouring maps compose by looking the exits of one up in the other, in a tree of degree
``DEGREE``: passes do not depend on the number of slices.

A state is [volume, flow, ticks, start]; the driver holds one a slice, never a map.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeworks.plans.chains import DEGREE
from tapeworks.plans.folds import Step, _emit, key_runs
from tapeworks.plans.slices import SLICE, slice_rows

#: A map's first row holds the slice's sums and first time; the others, in order, a first close and the state it leads to.
_MAP = "nth bigint, volume bigint, ts_us bigint, x_volume bigint, x_flow bigint, x_ticks bigint, x_since bigint"
_NAMES = [c.split()[0] for c in _MAP.split(", ")]
_REPORT = "slice int, first_key string, last_key string, state string, " + _MAP
INITIAL = [0, 0, 0, None]


def _short(rows: np.ndarray, first: int, target: int, ttl_us: int) -> np.ndarray:
    """Rows up to the first close of any bucket, the last of those with equal outcomes."""
    sure = np.flatnonzero((rows[:, 0] >= target) | (rows[:, 1] >= first + ttl_us))
    rows = rows[:sure[0] + 1] if len(sure) else rows
    same = (rows[1:, 2:] == rows[:-1, 2:]).all(axis=1)
    return rows[np.concatenate([~same, [True]])] if len(rows) else rows


def clock_map(ts: np.ndarray, volume: np.ndarray, flow: np.ndarray, target: int, ttl_us: int) -> tuple[list[int], np.ndarray]:
    """[sum of volume, first time, sum of flow, ticks] and the rows (volume so far, time, exit state) of a slice."""
    n, spent, flown = len(ts), np.cumsum(volume), np.cumsum(flow)
    at = np.arange(n)
    after = np.minimum(np.searchsorted(spent, spent + target), np.searchsorted(ts, ts + ttl_us))
    after = np.where(after < n, np.maximum(after, at), at)
    while (after[after] != after).any():
        after = after[after]
    rows = np.stack([spent, ts, spent[-1] - spent[after], flown[-1] - flown[after], n - 1 - after, ts[after]], axis=1)
    return [int(spent[-1]), int(ts[0]), int(flown[-1]), n], _short(rows, int(ts[0]), target, ttl_us)


def passed(head: list[int], rows: np.ndarray, state: list, target: int, ttl_us: int) -> list:
    """The state after a slice that is entered with ``state``."""
    volume, flow, ticks, since = state
    since = head[1] if since is None else since
    first = min(int(np.searchsorted(rows[:, 0], target - volume)), int(np.searchsorted(rows[:, 1], since + ttl_us)))
    return rows[first, 2:].tolist() if first < len(rows) else [volume + head[0], flow + head[2], ticks + head[3], since]


def composed(one: tuple[list[int], np.ndarray], two: tuple[list[int], np.ndarray], target: int, ttl_us: int) -> tuple[list[int], np.ndarray]:
    (head, rows), (head2, rows2) = one, two
    moved = rows.copy()
    for row in moved:
        row[2:] = passed(head2, rows2, row[2:].tolist(), target, ttl_us)
    later = rows2 + np.array([head[0], 0, 0, 0, 0, 0])
    return [head[0] + head2[0], head[1], head[2] + head2[2], head[3] + head2[3]], _short(np.concatenate([moved, later]), head[1], target, ttl_us)


def _written(head: list[int], rows: np.ndarray) -> pd.DataFrame:
    top = [head[0], head[1], 0, head[2], head[3], 0]
    return pd.DataFrame(np.concatenate([[top], rows]), columns=_NAMES[1:]).assign(nth=np.arange(len(rows) + 1))[_NAMES]


def _read(pdf: pd.DataFrame) -> tuple[list[int], np.ndarray]:
    table = pdf.sort_values("nth")[_NAMES[1:]].to_numpy(np.int64)
    return [int(table[0, k]) for k in (0, 1, 3, 4)], table[1:]


def _resolve(maps: DataFrame, length: dict[int, int], entry: dict[int, list], target: int, ttl_us: int) -> dict[tuple[int, int], list]:
    """Entry state of every (chain, pos) and of the place after a chain's last, from the entry state of each chain."""
    def walk(start: dict[tuple[int, int], list]):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            chain, group = int(pdf["chain"].iloc[0]), int(pdf["pos"].iloc[0]) // DEGREE
            state, out = start[chain, group], []
            for pos, rows in pdf.groupby("pos", sort=True):
                state = passed(*_read(rows), state, target, ttl_us)
                out.append((chain, int(pos) + 1, json.dumps(state)))
            return pd.DataFrame(out, columns=["chain", "pos", "state"])
        return run

    def join_up(pdf: pd.DataFrame) -> pd.DataFrame:
        whole = None
        for _, rows in pdf.groupby("pos", sort=True):
            whole = _read(rows) if whole is None else composed(whole, _read(rows), target, ttl_us)
        return _written(*whole).assign(chain=int(pdf["chain"].iloc[0]), pos=int(pdf["pos"].iloc[0]) // DEGREE)

    group = F.floor(F.col("pos") / DEGREE).cast("int").alias("group")
    if max(length.values()) <= DEGREE:
        start = {(c, 0): v for c, v in entry.items()}
    else:
        upper = maps.groupBy("chain", group).applyInPandas(join_up, f"{_MAP}, chain int, pos int").checkpoint(eager=True)
        start = _resolve(upper, {c: -(-n // DEGREE) for c, n in length.items()}, entry, target, ttl_us)
    found = maps.groupBy("chain", group).applyInPandas(walk(start), "chain int, pos int, state string").collect()  # one record a slice
    return {(c, 0): v for c, v in entry.items()} | {(r.chain, r.pos): json.loads(r.state) for r in found}


def clock_fold(df: DataFrame, keys: Sequence[str], order: Sequence[str], step: Step, out_schema: str, *, volume: str, flow: str, target: int, ttl_us: int, n: int | None = None) -> DataFrame:
    """``fold`` for a step with state [volume, flow, ticks, start] that starts anew at ``target`` volume or ``ttl_us`` of age; ``order`` begins with the time."""
    keys = list(keys)
    sliced = df if SLICE in df.columns else slice_rows(df, keys, order, n)
    schema = T.StructType([sliced.schema[k] for k in keys] + [f for f in T._parse_datatype_string(out_schema).fields if f.name not in keys])

    def survey(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = last = at = state = None
        held: list[pd.DataFrame] = []
        for pdf in batches:
            for key, rows in key_runs(pdf, keys):
                if at is None:
                    at, first = int(rows[SLICE].iloc[0]), key
                elif key != last:
                    state, held = INITIAL, []
                last = key
                if state is None:
                    held.append(rows[[order[0], volume, flow]])
                else:
                    state, _, _ = step(state, rows, 0)
        if at is None:
            return
        names = [c.split()[0] for c in _REPORT.split(", ")]
        kinds = {c: "object" if c.endswith("key") or c == "state" else "Int64" for c in names}
        yield pd.DataFrame({"slice": [at], "first_key": [json.dumps(first)], "last_key": [json.dumps(last)], "state": [json.dumps(state)]}).reindex(columns=names).astype(kinds)
        if held:
            rows = pd.concat(held)
            made = clock_map(*(rows[c].to_numpy(np.int64) for c in (order[0], volume, flow)), target, ttl_us)
            yield _written(*made).assign(slice=at).reindex(columns=names).astype(kinds)

    seen = sliced.mapInPandas(survey, _REPORT).checkpoint(eager=True)
    line = sorted(seen.where("first_key IS NOT NULL").select("slice", "first_key", "last_key", "state").collect(), key=lambda r: r.slice)
    whole = [r.first_key == r.last_key for r in line]
    goes_on = [i > 0 and line[i - 1].last_key == r.first_key for i, r in enumerate(line)]
    # chains: runs of slices inside one key, each entered from the slice before
    chain, pos, length, entry = {}, {}, {}, {}
    for i in (i for i, inside in enumerate(whole) if inside):
        joined = goes_on[i] and whole[i - 1]
        chain[i], pos[i] = (chain[i - 1], pos[i - 1] + 1) if joined else (i, 0)
        length[chain[i]] = pos[i] + 1
        if not joined:
            entry[i] = json.loads(line[i - 1].state) if goes_on[i] else INITIAL
    states = {}
    if any(goes_on[i] and whole[i - 1] for i in range(1, len(line))):
        place = sliced.sparkSession.createDataFrame([(line[i].slice, chain[i], pos[i]) for i in chain], "slice int, chain int, pos int")
        maps = seen.where("nth IS NOT NULL").select("slice", *_NAMES).join(F.broadcast(place), "slice").drop("slice")  # one row a slice
        states = _resolve(maps, length, entry, target, ttl_us)
    settled = {}
    for i, r in enumerate(line):
        if goes_on[i]:
            settled[r.slice] = (states[chain[i - 1], pos[i - 1] + 1] if whole[i - 1] else json.loads(line[i - 1].state), 0)
    return sliced.mapInPandas(_emit(step, INITIAL, keys, settled, schema.fieldNames()), schema)
