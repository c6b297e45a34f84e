"""Recurrences whose steps compose, as prefix scans over sliced keys.

A step ``x -> min(hi, max(lo, factor * x + offset))`` with ``factor >= 0`` takes four numbers, and
two such steps one after the other are again one.  So averages, decays, counters that stop at a
bound and capped scores need no state machine: a slice's rows compose to one map, the maps of all
slices give every slice's entry value, and a second pass gives the values.  That is two passes
whatever the tape, a hot key included.  Inside a batch the rows are cut into blocks whose maps are
composed by doubling, and all blocks then advance together; no row is looped over by itself.

The driver holds one map of four numbers a slice and output.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tapeworks.plans.folds import json_value
from tapeworks.plans.slices import SLICE, slice_rows


BLOCK = 128


@dataclass(frozen=True)
class Step:
    """Columns of a step; without bounds it is linear.  ``start`` is the value before a key's first row; ``exclusive`` gives the value before each row."""

    factor: str
    offset: str
    lo: str | None = None
    hi: str | None = None
    start: float = 0.0
    exclusive: bool = False


def _scaled(factor, x):
    """factor * x, where 0 times a missing bound is 0."""
    with np.errstate(invalid="ignore"):
        return np.where(factor == 0.0, 0.0, factor * x)


def compose(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """The map of ``two`` after ``one``; rows are factor, offset, lo, hi."""
    bound = lambda x: np.minimum(two[3], np.maximum(two[2], x))
    return np.stack([one[0] * two[0], _scaled(two[0], one[1]) + two[1], bound(_scaled(two[0], one[2]) + two[1]), bound(_scaled(two[0], one[3]) + two[1])])


def applied(maps: np.ndarray, x) -> np.ndarray:
    return np.minimum(maps[3], np.maximum(maps[2], _scaled(maps[0], x) + maps[1]))


def prefixes(maps: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Composition of every map with all of its run before it; ``place`` counts from the start of the run."""
    step = 1
    while step <= place.max(initial=0):
        rows = np.flatnonzero(place >= step)
        maps[:, rows] = compose(maps[:, rows - step], maps[:, rows])
        step *= 2
    return maps


def _blocks(maps: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and sizes of the blocks of all runs, and each block's map with those of its run before it."""
    starts = np.flatnonzero(place % BLOCK == 0)
    sizes = np.diff([*starts, len(place)])
    whole = maps[:, starts]
    for k in range(1, sizes.max(initial=0)):
        rows = np.flatnonzero(sizes > k)
        whole[:, rows] = compose(whole[:, rows], maps[:, starts[rows] + k])
    return starts, sizes, prefixes(whole, place[starts] // BLOCK)


def values_of(maps: np.ndarray, place: np.ndarray, enters: np.ndarray) -> np.ndarray:
    """The value after every row, given the one that its run is entered with.

    Blocks of all runs advance together, a row each at a time, in the order in which the
    recurrence is written; only the value that a block is entered with is composed.
    """
    starts, sizes, upto = _blocks(maps, place)
    x = np.where(place[starts] == 0, enters[starts], applied(np.roll(upto, 1, axis=1), enters[starts]))
    out = np.empty(len(place))
    for k in range(sizes.max(initial=0)):
        rows = np.flatnonzero(sizes > k)
        x[rows] = out[starts[rows] + k] = applied(maps[:, starts[rows] + k], x[rows])
    return out


def _maps(pdf: pd.DataFrame, step: Step) -> np.ndarray:
    n = len(pdf)
    side = lambda c, none: np.full(n, none) if c is None else pdf[c].to_numpy(float)
    return np.stack([pdf[step.factor].to_numpy(float), pdf[step.offset].to_numpy(float), side(step.lo, -np.inf), side(step.hi, np.inf)])


def _runs(pdf: pd.DataFrame, keys: Sequence[str]) -> np.ndarray:
    """First rows of the runs of equal keys."""
    change = np.zeros(len(pdf), bool)
    change[0] = True
    for k in keys:
        col = pdf[k]
        change[1:] |= (col.ne(col.shift()) & ~(col.isna() & col.shift().isna())).to_numpy()[1:]
    return np.flatnonzero(change)


def _key(pdf: pd.DataFrame, keys: Sequence[str], at: int) -> str:
    return json.dumps([json_value(pdf[k].iloc[at]) for k in keys])


def scan(df: DataFrame, keys: Sequence[str], order: Sequence[str], steps: Mapping[str, Step], *, n: int | None = None, freeze: bool = False) -> DataFrame:
    """``df`` with a column for each step's running value along every key; a frame that is sliced already stays so."""
    keys, names = list(keys), list(steps)
    sliced = df if SLICE in df.columns else slice_rows(df, keys, order, n, freeze)
    starts = np.array([s.start for s in steps.values()])
    whole = ", ".join(f"{name}_{k} double" for name in range(len(names)) for k in range(4))

    def survey(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = first = last = held = None
        for pdf in batches:
            if not len(pdf):
                continue
            runs = _runs(pdf, keys)
            if at is None:
                at, first = int(pdf[SLICE].iloc[0]), _key(pdf, keys, 0)
            go_on = len(runs) == 1 and last == _key(pdf, keys, 0)
            last = _key(pdf, keys, runs[-1])
            tail = pdf.iloc[runs[-1]:]
            new = [_blocks(_maps(tail, s), np.arange(len(tail)))[2][:, -1:] for s in steps.values()]
            held = [compose(a, b) for a, b in zip(held, new, strict=True)] if go_on else new
        if at is not None:
            yield pd.DataFrame({"slice": [at], "first_key": [first], "last_key": [last], **{f"m{i}_{k}": [float(m[k, 0])] for i, m in enumerate(held) for k in range(4)}})

    read = dict.fromkeys([SLICE, *keys, *(c for s in steps.values() for c in (s.factor, s.offset, s.lo, s.hi) if c)])
    seen = sliced.select(*read).mapInPandas(survey, "slice int, first_key string, last_key string, " + ", ".join(f"m{c}" for c in whole.split(", "))).collect()  # one record a slice
    entry: dict[int, np.ndarray] = {}
    values, before = starts, None
    for r in sorted(seen, key=lambda r: r.slice):
        entry[r.slice] = values if before == r.first_key else starts
        enters = entry[r.slice] if r.first_key == r.last_key else starts
        values = np.array([applied(np.array([r[f"m{i}_{k}"] for k in range(4)]), enters[i]) for i in range(len(names))], float)
        before = r.last_key

    kept = [c for c in sliced.columns if c != SLICE or SLICE in df.columns]

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = values = None
        for pdf in batches:
            if not len(pdf):
                continue
            runs = _runs(pdf, keys)
            if values is None:
                values = entry[int(pdf[SLICE].iloc[0])]
            elif last != _key(pdf, keys, 0):
                values = starts
            place = np.arange(len(pdf)) - np.repeat(runs, np.diff([*runs, len(pdf)]))
            in_first = np.arange(len(pdf)) < (runs[1] if len(runs) > 1 else len(pdf))
            out, ends = {}, []
            for i, (name, s) in enumerate(steps.items()):
                enters = np.where(in_first, values[i], starts[i])
                x = values_of(_maps(pdf, s), place, enters)
                ends.append(x[-1])
                out[name] = np.where(place == 0, enters, np.concatenate([[0.0], x[:-1]])) if s.exclusive else x
            values, last = np.array(ends), _key(pdf, keys, runs[-1])
            yield pdf[kept].assign(**out)

    schema = T.StructType([*(sliced.schema[c] for c in kept), *(T.StructField(name, T.DoubleType()) for name in names)])
    return sliced.mapInPandas(emit, schema)


def affine_scan(df: DataFrame, keys: Sequence[str], order: Sequence[str], factor: str, offset: str, out: str, *, n: int | None = None, freeze: bool = False) -> DataFrame:
    """x = factor * x_before + offset along every key, from x = 0; adds column ``out``."""
    return scan(df, keys, order, {out: Step(factor, offset)}, n=n, freeze=freeze)
