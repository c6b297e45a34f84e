import time

import numpy as np
from pyspark.sql import functions as F

from tapeworks.llm import neighbours, quality, toxicity
from tapeworks.llm.queries import QUERIES


def test_accuracies_are_found():
    """EM finds the accuracies of labellers that were drawn at random."""
    rnd = np.random.default_rng(1)
    bad = rnd.random(20_000) < 0.2
    fires = [(0.7, 0.02), (0.5, 0.01), (0.4, 0.05), (0.6, 0.03)]
    seen = np.stack([np.where(rnd.random(len(bad)) < np.where(bad, a, b), quality.BAD, quality.ABSTAIN) for a, b in fires], 1)
    patterns, counts = np.unique(seen, axis=0, return_counts=True)
    given, good, share = quality.accuracies(patterns, counts.astype(float))
    assert abs(share - 0.8) < 0.03
    for k, (a, b) in enumerate(fires):
        assert abs(given[k, 1, quality.BAD] - a) < 0.08 and abs(given[k, 0, quality.BAD] - b) < 0.03


def test_quality(spark, sf, odd, empty):
    got = QUERIES["op4_weak_quality"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").groupBy("quality").agg(F.avg(F.col("accepted").cast("int")).alias("a")).collect()
    rate = {r["quality"]: r["a"] for r in got}
    assert rate[1] >= 0.98 and rate[0] <= 0.15
    out = quality.scored(odd.withColumn("accepted", F.lit("old")), quality.fit(odd)).collect()
    assert len(out) == odd.count() and all(0 <= r.quality_score <= 1 and r.accepted in (True, False) for r in out)
    assert all(r.accepted for r in out if r.doc_id in (3, 4, 5))
    assert quality.scored(empty, quality.fit(empty)).count() == 0


def best(scores):
    sums = np.concatenate([[0], np.cumsum(scores)])
    return max((sums[j] - sums[i] for i in range(len(sums)) for j in range(i + 1, len(sums))), default=0)


def test_segments():
    """Disjoint, each with only gaining beginnings and ends, and the best of all among them; the same as the recursive definition."""
    rnd = np.random.default_rng(2)

    def recursive(scores, lo, hi):
        top, where = 0.0, None
        for i in range(lo, hi):
            total = 0.0
            for j in range(i, hi):
                total += scores[j]
                if total > top + 1e-12:
                    top, where = total, (i, j + 1)
        if where is None:
            return []
        return recursive(scores, lo, where[0]) + [(*where, top)] + recursive(scores, where[1], hi)

    for _ in range(300):
        scores = rnd.normal(-0.3, 1, rnd.integers(0, 25))
        got = toxicity.segments(scores)
        want = recursive(scores, 0, len(scores))
        assert [g[:2] for g in got] == [w[:2] for w in want]
        assert np.allclose([g[2] for g in got], [w[2] for w in want])


def test_segments_in_linear_time():
    """Twice the tokens take about twice the time: clean texts, whose sums fall, and texts of long rises."""
    def seconds(n, gain):
        scores = np.full(n, -0.5)
        scores[::10] = gain
        began = time.process_time()
        toxicity.segments(scores)
        return time.process_time() - began

    for gain in (1.0, 4.9, 5.1):
        assert seconds(1_000_000, gain) < 8 * max(seconds(250_000, gain), 0.1)


def test_toxicity(spark, odd, empty):
    rnd = np.random.default_rng(4)
    plain = [f"p{k}" for k in range(300)]
    rows, marks = [], []
    for i in range(1200):
        words = list(rnd.choice(plain, rnd.integers(30, 200)))
        toxic = i % 5 == 0
        if toxic:
            for at in rnd.integers(0, len(words), 6):
                words.insert(at, f"nasty{rnd.integers(0, 5)}")
        rows.append((i, " ".join(words)))
        marks.append((i, int(toxic)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame(marks + [(None, 1), (1, None)], "doc_id long, toxic int")
    model = toxicity.fit(df, labels)
    got = toxicity.scored(df, model).join(labels.where("toxic is not null"), "doc_id").where(toxicity.held_out("doc_id")).collect()
    assert len(got) > 300
    assert np.mean([(r.toxicity >= 0.7) == bool(r.toxic) for r in got]) > 0.97
    odd_scores = toxicity.scored(odd, model).collect()
    assert len(odd_scores) == odd.count() and all(0 <= r.toxicity <= 1 for r in odd_scores)
    assert toxicity.scored(empty, toxicity.fit(empty, labels)).count() == 0
    assert toxicity.scored(df, toxicity.fit(df, labels.limit(0))).where("toxicity >= 0.7").count() == 0


def nearest(ids, x, q, k):
    scores = x @ x[q]
    order = [j for j in np.lexsort((ids, -scores)) if ids[j] != ids[q]]
    return order[:k], scores


def test_neighbours(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    got = {}
    for r in QUERIES["op2_multi_index"](spark, sf).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == set(ids[ids % 20 == 0].tolist())
    hits = 0
    for q in np.flatnonzero(ids % 20 == 0):
        order, scores = nearest(ids, x, q, 20)
        found = sorted(got[ids[q]])
        assert [f[0] for f in found] == list(range(1, 21)) and [f[2] for f in found] == sorted((f[2] for f in found), reverse=True)
        assert all(abs(scores[list(ids).index(f[1])] - f[2]) < 1e-12 for f in found)
        hits += len({f[1] for f in found} & set(ids[order].tolist()))
    assert hits >= 0.9 * 20 * len(got)


def test_neighbours_recall_and_ties(spark, monkeypatch):
    """Few cells are opened on clustered data; copies, odd vectors and small tables."""
    monkeypatch.setattr(neighbours, "LEAST_SCANNED", 0)
    rnd = np.random.default_rng(5)
    centres = rnd.normal(size=(40, 16))
    x = (centres[rnd.integers(0, 40, 3000)] + 0.2 * rnd.normal(size=(3000, 16))).tolist()
    x[1000:2000] = [x[1000]] * 1000
    bad = [None, [], [0.0] * 16, [float("nan")] * 16, [None] * 16, [1.0] * 5, [float("inf")] + [1.0] * 15]
    rows = [(k, v, 0.0) for k, v in enumerate(x)] + [(9000 + 20 * k, v, 0.0) for k, v in enumerate(bad)] + [(None, x[0], 0.0), (7, x[7], 0.0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score double")
    got = {}
    for r in neighbours.search(df, F.col("id") % 20 == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.id))
    assert set(got) == set(range(0, 3000, 20))
    ids, arr, hits = np.arange(3000), np.array(x), 0
    for q, found in got.items():
        order, _ = nearest(ids, arr, q, 20)
        found = [i for _, i in sorted(found)]
        hits += len(set(found) & set(order))
        if 1000 <= q < 2000:
            assert len(set(found)) == 20
    assert hits >= 0.9 * 20 * len(got)
    few = neighbours.search(df.where("vec_id < 5"), F.col("id") % 20 == 0).collect()
    assert sorted(r.id for r in few) == [1, 2, 3, 4]
    assert neighbours.search(df.limit(0), F.col("id") % 20 == 0).count() == 0
    assert neighbours.search(df.where("vec_id = 9040"), F.col("id") % 20 == 0).count() == 0
