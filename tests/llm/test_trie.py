import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from tapeworks.llm import prefix_trie
from tapeworks.llm.queries import QUERIES


def by_hand(rows):
    """Nodes of the rebuilt conversations, from (conv_id, turn, role, text) rows."""
    def order(r):
        role, text = r[2] or "", r[3] or ""
        return (r[1] is not None, r[1] or 0, hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()[:16])

    own = defaultdict(list)
    for r in sorted((r for r in rows if r[0] is not None), key=order):
        own[r[0]].append((r[2] or "", r[3] or ""))
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        lead = c - int(np.fmod(c, 100))
        built[c] = (own.get(lead, [])[:h] if lead in own else []) + turns[h:]
    members = defaultdict(list)
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            members[tuple(built[c][:d])].append(c)
    kids = defaultdict(int)
    for path in members:
        if path:
            kids[path[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for path, found in members.items():
        for d in range(len(path) + 1):
            saved[path[:d]] += (len(found) - 1) * (len(path[-1][1]) if path else 0)
            leaves[path[:d]] += not kids[path]
    return {(m[0], len(p), members[p[:-1]][0] if p else None, len(m), kids[p], leaves[p], saved[p],
             hashlib.sha256(",".join(str(c) for c in m if len(built[c]) == len(p)).encode()).hexdigest()) for p, m in members.items()}


def made(spark, rows, slices=None):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    nodes, ends = prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.sequences(df)), slices)
    full = nodes.join(prefix_trie.end_digests(ends), ["conv_id", "depth"], "left").fillna(hashlib.sha256().hexdigest(), ["ends_sha256"])
    got = [tuple(r) for r in full.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize("slices", [1, 3, 7, 40])
def test_against_brute_force(spark, slices):
    rnd = random.Random(slices)
    rows = []
    for c in rnd.sample(range(-150, 900), 300):
        turns = [("user", "hot")] * 3 if c % 3 == 0 else [(rnd.choice("ua"), rnd.choice(["", "x", "yy", "é日"])) for _ in range(rnd.randint(1, 7))]
        rows += [(c, k, *t) for k, t in enumerate(turns)]
    assert made(spark, rows, slices) == by_hand(rows)


def test_odd_rows(spark):
    rows = [(None, 0, "user", "lost"), (1, None, None, None), (1, 0, "user", None), (1, 0, None, "x"), (1, 0, None, "x"), (2, 5, "a", "b"), (-7, 1, "a", "b"), (300, 0, "a", "b"), (300, 0, "a", "b")]
    assert made(spark, rows) == by_hand(rows)
    assert made(spark, []) == set()
    long = [(5, k, "user", f"t{k % 3}") for k in range(150)] + [(8, k, "user", f"t{k % 3}") for k in range(90)]
    assert made(spark, long, 4) == by_hand(long)


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, 0, "u", "x", "a", 3)], "conv_id long, turn long, role string, text string, digest string, chars int").withColumnsRenamed({"chars": "turns"})
    assert prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.sequences(df)))[0].count() >= 1


def test_extents_by_scan():
    rnd = np.random.default_rng(1)
    for n in (1, 2, 3, 8, 33, 100):
        lcp = rnd.integers(0, 4, n)
        at, depth = np.repeat(np.arange(n), 5), np.tile(np.arange(5), n)
        left, right = prefix_trie.extents(lcp, at, depth)
        for i, d, lo, hi in zip(at, depth, left, right, strict=True):
            a = b = i
            while a > 0 and lcp[a] >= d:
                a -= 1
            while b + 1 < n and lcp[b + 1] >= d:
                b += 1
            assert (a, b) == (lo, hi)


def test_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = QUERIES["op11_prefix_trie"](spark, sf).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    assert {tuple(r) for r in got.collect()} == by_hand(rows)
