"""Sliced scans and folds give the same answer for any number of slices, hot keys included."""

import itertools
import sys

import pandas as pd
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from tapeworks.plans import folds
from tapeworks.plans.folds import fold, same_state
from tapeworks.plans.scans import affine_scan
from tapeworks.plans.lookup import lookup
from tapeworks.plans.slices import asof, blocks, dense_index, previous, running, slice_count


cloudpickle.register_pickle_by_value(sys.modules[__name__])


@pytest.fixture(scope="module")
def rows(spark):
    """One key owns most of the rows."""
    data = [("hot" if i % 5 else f"k{i % 3}", i * 7 % 211, i, (i * 37) % 101 - 40) for i in range(600)]
    return spark.createDataFrame(data, "k string, t long, id long, v long").cache()


def brute(rows):
    out = {}
    for r in sorted(rows.collect(), key=lambda r: (r.k, r.t, r.id)):
        out.setdefault(r.k, []).append(r)
    return out


@pytest.mark.parametrize("n", [1, 7, 40])
def test_running(rows, n):
    got = {r.id: r for r in running(rows, ["k"], ["t", "id"], {
        "s": ("sum", F.col("v")), "m": ("min", F.col("v")), "before": ("last", F.when(F.col("v") > 0, F.col("v")), "exclusive")}, n=n).collect()}
    for part in brute(rows).values():
        total, low, seen = 0, None, None
        for r in part:
            total, low = total + r.v, r.v if low is None else min(low, r.v)
            assert (got[r.id].s, got[r.id].m, got[r.id].before) == (total, low, seen)
            seen = r.v if r.v > 0 else seen


def test_reverse_and_previous(rows):
    nxt = {r.id: r.n for r in previous(rows, ["k"], ["t", "id"], {"n": "id"}, reverse=True).collect()}
    for part in brute(rows).values():
        for a, b in zip(part, [*part[1:], None]):
            assert nxt[a.id] == (b.id if b else None)


def test_dense_index_and_blocks(rows):
    idx = dense_index(rows, ["k"], ["t", "id"])
    assert idx.groupBy("k").agg(F.max("idx"), F.count_distinct("idx"), F.count("*")).collect()
    b = blocks(idx, "idx", 3, 10)
    assert b.where("_home").count() == 600
    assert b.groupBy("k", "_block").count().agg(F.max("count")).first()[0] <= 13


@pytest.mark.parametrize("strict,forward", list(itertools.product([False, True], [False, True])))
def test_asof(spark, rows, strict, forward):
    right = spark.createDataFrame([("hot", t, t, t * 10) for t in range(0, 211, 13)], "k string, rt long, rid long, x long")
    got = asof(rows, right, ["k"], left_ts="t", right_ts="rt", left_id="id", right_id="rid", right_cols=["rt", "x"], strict=strict, forward=forward).collect()
    assert len(got) == 600
    marks = list(range(0, 211, 13))
    for r in got:
        ok = [m for m in marks if (m >= r.t if forward and not strict else m > r.t if forward else m < r.t if strict else m <= r.t)]
        want = (min(ok) if forward else max(ok)) if ok and r.k == "hot" else None
        assert r.rt == want


def reset_sum(state, pdf: pd.DataFrame, done: int):
    """Adds up to 100, then starts again; emits (id, state, resets so far)."""
    out, hits = [], 0
    for i, v in zip(pdf["id"].tolist(), pdf["v"].tolist()):
        state += abs(v)
        if state >= 100:
            state, hits = 0, hits + 1
        out.append((i, state, done + hits))
    return state, hits, pd.DataFrame(out, columns=["id", "state", "resets"])


def endless(state, pdf: pd.DataFrame, done: int):
    """A machine that never forgets."""
    out = []
    for i, v in zip(pdf["id"].tolist(), pdf["v"].tolist()):
        state = (state * 31 + v) % 1_000_003
        out.append((i, state, 0))
    return state, 0, pd.DataFrame(out, columns=["id", "state", "resets"])


@pytest.mark.parametrize("step,n", [(reset_sum, 1), (reset_sum, 23), (endless, 1), (endless, 12)])
def test_fold(rows, step, n, monkeypatch):
    monkeypatch.setattr(folds, "PATIENCE", 2)
    got = {r.id: (r.state, r.resets) for r in fold(rows, ["k"], ["t", "id"], step, 0, "id long, state long, resets long", n=n).collect()}
    for part in brute(rows).values():
        _, _, want = step(0, pd.DataFrame([r.asDict() for r in part]), 0)
        assert {i: got[i] for i in want["id"]} == {i: (s, c) for i, s, c in want.itertuples(index=False)}


def test_affine_scan(rows):
    src = rows.withColumn("f", F.when(F.col("v") > 30, 0.0).otherwise(0.9)).withColumn("o", F.col("v") * 0.1)
    got = {r.id: r.x for r in affine_scan(src, ["k"], ["t", "id"], "f", "o", "x", n=17).collect()}
    for part in brute(src).values():
        x = 0.0
        for r in part:
            x = r.f * x + r.o
            assert abs(got[r.id] - x) < 1e-9


def test_lookup_sizes(spark, rows):
    dim = spark.createDataFrame([("hot", 1), ("k0", 2)], "k string, d int")
    for limit in (1, 100):
        assert lookup(rows, dim, ["k"], max_rows=limit).where("d IS NOT NULL").count() == rows.where("k IN ('hot', 'k0')").count()
    small, large = lookup(rows, dim, ["k"]), lookup(rows, dim, ["k"], max_rows=1)
    assert "ResolvedHint (strategy=broadcast)" in small._jdf.queryExecution().analyzed().toString()
    assert "ResolvedHint" not in large._jdf.queryExecution().analyzed().toString()


def test_same_state():
    assert same_state([1, 2.0, {"a": None}], [1, 2.0 + 1e-15, {"a": None}])
    assert not same_state([1, 2.0], [1, 2.1]) and not same_state(None, 0.0) and not same_state([1], [1, 2])


def test_slice_count_ignores_guesses(spark, sf):
    ev = spark.read.parquet(f"{sf}/events.parquet")
    assert slice_count(ev.join(ev.withColumnRenamed("event_id", "e2"), "user_id")) == 4


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_folds_emit_without_a_shuffle(rows):
    text = plan(fold(rows, ["k"], ["t", "id"], reset_sum, 0, "id long, state long, resets long", n=5))
    assert "MapInPandas" in text and "Exchange" not in text


def test_running_shuffles_slices_not_keys(rows):
    text = plan(running(rows, ["k"], ["t", "id"], {"s": ("sum", F.col("v"))}, n=5))
    assert "BroadcastHashJoin" in text
    assert "hashpartitioning(_slice" in text and "Exchange rangepartitioning" not in text


def test_scans_are_pruned(spark, sf):
    from tapeworks.catalog.ledger import unresolved
    text = plan(unresolved(spark, sf))
    assert "PushedFilters: [IsNotNull(o_orderstatus), EqualTo(o_orderstatus,P)]" in text
    assert "o_orderpriority" not in text


def test_split_bars_stay_in_the_jvm(spark, sf):
    from tapeworks.operators.bars import split_bars
    from tapeworks.sources.tape import tape
    assert "Pandas" not in plan(split_bars(tape(spark, sf), 5_000_000))
