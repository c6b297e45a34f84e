"""Exact and near deduplication against brute force."""

from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeworks.llm import grace, near_dedup
from tapeworks.llm.queries import QUERIES


def exact(rows):
    groups = defaultdict(list)
    for r in rows:
        groups["".join(c for c in r.text or "" if c not in " \t\n\x0b\x0c\r")].append(r)
    return groups


@pytest.mark.parametrize("table_bytes", [1 << 25, 20_000])
def test_exact_classes(documents, odd, table_bytes):
    """A tiny table makes buckets overflow to deeper levels; the result is the same."""
    for df in (documents.select("doc_id", "text"), odd):
        rows = df.collect()
        want = Counter()
        for group in exact(rows).values():
            keep = min(group, key=lambda r: (-len(r.text or ""), r.doc_id is None, r.doc_id or 0)).doc_id
            for r in group:
                want[r.doc_id, keep, len(group)] += 1
        got = grace.classes(df, table_bytes=table_bytes).collect()
        assert Counter((r.id, r.keep_id, r.group_size) for r in got) == want
        assert sum(r.kept for r in got) == len(exact(rows))
        stay = grace.survivors(df, table_bytes=table_bytes)
        assert stay.columns == df.columns and len(exact(stay.collect())) == stay.count() == len(exact(rows))


def test_table_compares_contents():
    table = grace.Table(1 << 20)
    same = {"digest": b"\0" * 32, "chars": 1, "id": 1, "number": 0, "copies": 1}
    assert table.add(dict(same), b"a") and table.add(dict(same), b"b") and table.add(dict(same), b"a")
    assert [r["copies"] for r in table.records] == [2, 1]
    for k in range(3000):
        table.add(dict(same, digest=k.to_bytes(32, "little")), str(k).encode())
    assert len(table.records) == 3002


def test_empty(empty):
    assert grace.classes(empty).count() == 0 and grace.survivors(empty).columns == empty.columns and grace.survivors(empty).count() == 0
    assert near_dedup.classes(empty).count() == 0 and near_dedup.survivors(empty).count() == 0


def near(rows):
    """Components by comparing every pair of distinct sets."""
    sets = {r.doc_id: near_dedup.shingles(r.text) for r in rows}
    up = {i: i for i in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    order = sorted(sets, key=lambda i: -1 if i is None else i)
    for k, a in enumerate(order):
        for b in order[:k]:
            if near_dedup.linked(sets[a], sets[b]):
                x, y = top(a), top(b)
                if x != y:
                    up[max(x, y, key=order.index)] = min(x, y, key=order.index)
    return sets, {i: top(i) for i in sets}


def test_near_groups(spark, sf, documents):
    sets, want = near(documents.collect())
    got = QUERIES["op8_setsketch_dedup"](spark, sf).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == {i: (len(sets[i]), want[i], want[i] == i) for i in sets}


def test_near_hot_group(spark):
    """Near copies of one text, many of them not linked with each other, and stragglers of other groups."""
    rnd = np.random.default_rng(3)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for i in range(300):
        words = list(base)
        for at in rnd.choice(120, rnd.integers(1, 9), replace=False):
            words[at] = f"e{i}x{at}"
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, " ".join(f"q{i}w{k}" for k in range(40))) for i in range(50)] + [(2000 + i, rows[i][1].upper()) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    _, want = near(df.collect())
    assert {r.id: r.component_id for r in near_dedup.classes(df).collect()} == want


def test_near_odd_rows(odd):
    got = sorted(near_dedup.classes(odd).collect(), key=str)
    assert len(got) == odd.count()
    by = {r.id: r for r in got}
    assert {by[k].component_id for k in (1, 2, None)} == {1}
    assert by[3].n_shingles == by[4].n_shingles == by[5].n_shingles == 0 and by[6].n_shingles == 1 and all(by[k].component_id == k for k in (3, 4, 5, 6))
    assert by[8].component_id == 8 or by[8].component_id == 7
    stay = near_dedup.survivors(odd)
    assert stay.columns == odd.columns and stay.where(F.col("doc_id") == 6).count() == 1


def test_estimate():
    rnd = np.random.default_rng(1)
    for share in (0.5, 0.75, 0.9):
        a = rnd.integers(0, 1 << 63, 4000).astype(np.uint64)
        both = int(4000 * 2 * share / (1 + share))
        b = np.concatenate([a[:both], rnd.integers(0, 1 << 63, 4000 - both).astype(np.uint64)])
        ra, rb = near_dedup.sketches([np.unique(a), np.unique(b)])
        more, equal = (ra > rb).sum(), (ra == rb).sum()
        got = near_dedup.likely(*(np.array([float(v)]) for v in (more, near_dedup.REGISTERS - more - equal, equal, len(a), len(b))))[0]
        assert abs(got - share) < 0.12
    assert (near_dedup.sketches([a, b]).max(0) == near_dedup.sketches([np.unique(np.concatenate([a, b]))])[0]).all()  # sketches merge


def test_short_sets_share_bands():
    """Three shingles and the same three plus one have similarity 0.75; nearly all such pairs share a band, as with independent registers."""
    rnd, missed, size = np.random.default_rng(7), 0, near_dedup.BANDS * near_dedup.ROWS
    for _ in range(40):
        e = rnd.integers(0, 1 << 64, (1000, 4), dtype=np.uint64)
        r = near_dedup.sketches([x[:3] for x in e] + list(e))[:, :size].reshape(2, 1000, near_dedup.BANDS, near_dedup.ROWS)
        missed += int((~(r[0] == r[1]).all(2).any(1)).sum())
    assert missed <= 2


def test_near_shared_ids(spark):
    """Rows that share an id are one node: its component is that of all its texts, and a link of any of them counts."""
    text = lambda name, n=40: " ".join(f"{name}{k}" for k in range(n))
    rows = [(1, text("a")), (5, text("a")), (5, text("b")), (7, text("b") + " more"), (5, ""), (8, ""), (9, text("c")), (10, text("d")), (10, text("e")), (11, text("e")), (20, ""), (20, text("c") + " more"), (None, text("d"))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.id, r.n_shingles): r.component_id for r in near_dedup.classes(df).collect()}
    assert got == {(1, 36): 1, (5, 36): 1, (7, 37): 1, (5, 0): 1, (8, 0): 8, (9, 36): 9, (10, 36): 10, (11, 36): 10, (20, 0): 9, (20, 37): 9, (None, 36): 10}
    assert sorted(r.doc_id for r in near_dedup.survivors(df).collect()) == [1, 8, 9, 10, 10]


def test_near_pairs_take_their_own_sets(spark):
    """Where an id has two texts, the pairs of a bucket are counted on the set of the text that is in it."""
    sets = [near_dedup.hashed(t, near_dedup.Hashes()) for t in (" ".join(f"x{k}" for k in range(60)), " ".join(f"y{k}" for k in range(60)))]
    texts = spark.createDataFrame([(3, " ".join(f"{c}{k}" for k in range(60))) for c in "xy"], "id long, text string")
    found = {bytes(r.digest): r.hashes for r in near_dedup.short_sets(texts).collect()}
    assert found == {near_dedup.digest_of(s): np.unique((s >> np.uint64(32)).astype(np.uint32)).tobytes() for s in sets}
