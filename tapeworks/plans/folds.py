"""Order-dependent state machines over sliced keys.

Resets, cooldowns and hysteresis are not associative, so a prefix scan cannot
compute them.  A whole key in one task cannot either, once the key is hot.
``fold`` therefore runs the machine on all slices at once and repairs the seams:

1. every slice runs from a presumed entry state (the initial one) and reports
   the state it leaves for the key that may continue in the next slice;
2. slices that lie wholly inside one key and were entered with another state
   than presumed run again, until every entry state is the exit state before it;
3. one last pass emits rows with the settled entry states.

Such machines forget: a side flip, a closed bar or an expired cooldown makes the
exit state independent of the entry, so step 2 settles after a round or two.  A
machine that never forgets still gets the exact answer: after ``PATIENCE`` rounds
only slices whose entry is final run again, so every slice runs a bounded number
of times, one after the other.  Recurrences whose steps compose do not need that:
see ``scans`` and ``chains``.
Counts that only add up (bar numbers) are carried beside the state as prefix
sums, so they never cause a re-run.

The driver holds one small record per slice, the same order of data as Spark's
own per-task metadata.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeworks.plans.slices import SLICE, slice_rows

PATIENCE = 4

Step = Callable[[object, pd.DataFrame, int], tuple[object, int, "pd.DataFrame | None"]]
"""(state, rows of one key in order, emitted so far) -> (state, emitted now, rows out)."""


def same_state(a: object, b: object, rel: float = 1e-13) -> bool:
    """Equality of states; contracting averages may differ in the last bits."""
    if isinstance(a, float) or isinstance(b, float):
        if not isinstance(a, (int, float)) or not isinstance(b, (int, float)):
            return False
        return a == b or (math.isnan(a) and math.isnan(b)) or math.isclose(a, b, rel_tol=rel, abs_tol=0.0)
    if isinstance(a, (list, tuple)) and isinstance(b, (list, tuple)):
        return len(a) == len(b) and all(same_state(x, y, rel) for x, y in zip(a, b))
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(same_state(v, b[k], rel) for k, v in a.items())
    return a == b


def key_runs(pdf: pd.DataFrame, keys: Sequence[str]) -> Iterator[tuple[tuple, pd.DataFrame]]:
    """Contiguous runs of equal keys in a sorted batch."""
    if not len(pdf):
        return
    change = pd.Series(False, index=pdf.index)
    for k in keys:
        col = pdf[k]
        change |= col.ne(col.shift())
    starts = [i for i, c in enumerate(change.to_numpy()) if c or i == 0]
    for lo, hi in zip(starts, [*starts[1:], len(pdf)]):
        yield tuple(json_value(pdf[k].iloc[lo]) for k in keys), pdf.iloc[lo:hi]


def json_value(v):
    """A plain Python value, so that keys and states survive JSON."""
    return v.item() if hasattr(v, "item") else (str(v) if not isinstance(v, (int, float, str, bool, type(None))) else v)


_SUMMARY = "slice int, first_key string, last_key string, presumed string, state string, emitted long"


def _starter(initial: object, start: str | None):
    """State a key begins with: that of its column ``start`` (JSON) where it has one."""
    def begin(rows: pd.DataFrame) -> object:
        given = rows[start].iloc[0] if start else None
        return json.loads(given) if isinstance(given, str) else initial
    return begin


def _summarise(step: Step, begin, keys: list[str], entry: dict[int, object]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = last = state = at = presumed = None
        emitted = 0
        for pdf in batches:
            for key, rows in key_runs(pdf, keys):
                if at is None:
                    at, first, last, presumed = int(rows[SLICE].iloc[0]), key, key, begin(rows)
                    state = entry.get(at, presumed)
                elif key != last:
                    state, emitted, last = begin(rows), 0, key
                state, n, _ = step(state, rows, emitted)
                emitted += n
        if at is not None:
            yield pd.DataFrame({"slice": [at], "first_key": [json.dumps(first)], "last_key": [json.dumps(last)], "presumed": [json.dumps(presumed)],
                                "state": [json.dumps(state)], "emitted": [emitted]})
    return run


def _leave(step: Step, begin, keys: list[str], entry: dict[int, tuple], going_on: set[int]):
    """The state every key is left in, given out by the slice that holds its last row."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = last = state = None
        done: list[tuple] = []
        for pdf in batches:
            for key, rows in key_runs(pdf, keys):
                if at is None:
                    at, last = int(rows[SLICE].iloc[0]), key
                    state = entry[at][0] if at in entry else begin(rows)
                elif key != last:
                    done.append((*last, json.dumps(state)))
                    state, last = begin(rows), key
                state, _, _ = step(state, rows, 0)
        if at is not None and at not in going_on:
            done.append((*last, json.dumps(state)))
        yield pd.DataFrame(done, columns=[*keys, "state"])
    return run


def _emit(step: Step, initial: object, keys: list[str], entry: dict[int, tuple], out_names: list[str], start: str | None = None):
    begin = _starter(initial, start)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state, emitted, started = None, initial, 0, False
        for pdf in batches:
            frames = []
            for key, rows in key_runs(pdf, keys):
                if not started:
                    started, last = True, key
                    at = int(rows[SLICE].iloc[0])
                    state, emitted = entry[at] if at in entry else (begin(rows), 0)
                elif key != last:
                    state, emitted, last = begin(rows), 0, key
                state, n, out = step(state, rows, emitted)
                emitted += n
                if out is not None and len(out):
                    frames.append(out.assign(**{k: rows[k].iloc[0] for k in keys})[out_names])
            if frames:
                yield pd.concat(frames, ignore_index=True)
    return run


def fold(df: DataFrame, keys: Sequence[str], order: Sequence[str], step: Step, initial: object, out_schema: str | T.StructType,
         *, n: int | None = None, freeze: bool = False, start: str | None = None, states: bool = False) -> DataFrame | tuple[DataFrame, DataFrame]:
    """Run ``step`` over every key of ``df`` in ``order``; keys are prepended to ``out_schema``.

    ``start`` names a column with the state (JSON, null for the initial one) that a key begins
    with, the same in all its rows; with ``states`` the state every key is left in comes as a
    second frame, so that a later batch of rows can go on from it.
    """
    keys = list(keys)
    sliced = df if SLICE in df.columns else slice_rows(df, keys, order, n, freeze)
    columns = T._parse_datatype_string(out_schema) if isinstance(out_schema, str) else out_schema
    schema = T.StructType([sliced.schema[k] for k in keys] + [f for f in columns.fields if f.name not in keys])

    def survey(frame: DataFrame, entry: dict[int, object]) -> list:
        return frame.mapInPandas(_summarise(step, _starter(initial, start), keys, entry), _SUMMARY).collect()

    reports = {r.slice: r for r in survey(sliced, {})}
    line = sorted(reports)
    place = {s: i for i, s in enumerate(line)}
    used: dict[int, object] = {}

    def continues(i: int) -> bool:
        return i > 0 and reports[line[i - 1]].last_key == reports[line[i]].first_key

    rounds = 0
    while True:
        entry = {line[i]: json.loads(reports[line[i - 1]].state) for i in range(len(line)) if continues(i)}
        stale = [s for s, state in entry.items()
                 if reports[s].first_key == reports[s].last_key and not same_state(state, used[s] if s in used else json.loads(reports[s].presumed))]
        if not stale:
            break
        rounds += 1
        if rounds > PATIENCE:
            waiting = set(stale)
            stale = [s for s in stale if line[place[s] - 1] not in waiting]
        used.update({s: entry[s] for s in stale})
        redo = sliced.where(F.col(SLICE).isin(stale))
        reports.update({r.slice: r for r in survey(redo, {s: entry[s] for s in stale})})

    settled: dict[int, tuple] = {}
    count = 0
    for i, s in enumerate(line):
        if continues(i):
            settled[s] = (entry[s], count)
            count = count + reports[s].emitted if reports[s].first_key == reports[s].last_key else reports[s].emitted
        else:
            count = reports[s].emitted
    out = sliced.mapInPandas(_emit(step, initial, keys, settled, schema.fieldNames(), start), schema)
    if not states:
        return out
    going_on = {line[i - 1] for i in range(len(line)) if continues(i)}
    left = T.StructType([sliced.schema[k] for k in keys] + [T.StructField("state", T.StringType())])
    return out, sliced.mapInPandas(_leave(step, _starter(initial, start), keys, settled, going_on), left)
