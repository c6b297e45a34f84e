"""The pipeline's stages against brute force."""

from collections import Counter

import corpus_pipeline
from test_dedup import exact, near

from tapeworks.llm import mixing, quality


def test_stages(spark, sf, documents):
    docs, kept = documents, []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        rows = docs.collect()
        kept.append(rows)
        docs = spark.createDataFrame(rows, docs.schema)
        if name != "encoding":
            assert docs.columns == documents.columns
    good, unique, apart, mixed, coded = kept
    scores = {r.doc_id: r.accepted for r in quality.scored(documents, quality.fit(documents)).collect()}
    assert {r.doc_id for r in good} == {i for i, ok in scores.items() if ok}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert not [r for r in good if labels.get(r.doc_id) == 0] and all(scores[i] for i, q in labels.items() if q == 1)
    groups = exact(good)
    assert {r.doc_id for r in unique} == {min(g, key=lambda r: (-len(r.text), r.doc_id)).doc_id for g in groups.values()}
    _, top = near(unique)
    assert sorted(r.doc_id for r in apart) == sorted(i for i, t in top.items() if i == t)
    words = Counter()
    for r in apart:
        words[r.source] += len(r.text.split())
    taken = Counter()
    for r in mixed:
        taken[r.source] += len(r.text.split())
    assert set(Counter(r.doc_id for r in mixed).values()) <= {1, 2}
    longest = {s: max(len(r.text.split()) for r in apart if r.source == s) for s in words}
    aims = {r.source: r.target for r in mixing.plan(mixing.sized(spark.createDataFrame(apart, documents.schema))).collect()}
    assert all(abs(taken[s] - aims[s]) <= longest[s] / 2 + 1 for s in words)
    assert Counter(r.doc_id for r in coded) == Counter(r.doc_id for r in mixed) and all(r.ids for r in coded)


def test_run_and_empty(spark, sf, empty, tmp_path):
    assert corpus_pipeline.run(spark, sf).count() > 0
    spark.read.parquet(f"{sf}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_odd_rows(spark, odd, sf):
    docs = odd
    for name, stage in corpus_pipeline.STAGES:
        done = stage(spark, docs, sf)
        docs = spark.createDataFrame(done.collect(), done.schema)
        if name != "encoding":
            assert docs.columns == odd.columns
    assert docs.count() > 0
