"""Near-duplicate documents by SetSketch registers, bands, likelihood and exact verification.

A document's set is that of its five-word shingles.  Its sketch has M registers; register i holds
the smallest of M-fold exponential hashes of its shingles on an exponential scale, truncated to
16 bits.  Sketches merge by maxima, and two registers agree with about the probability of the
sets' Jaccard similarity.  A shingle's values come in ascending order over a permutation of the
registers, so most shingles stop after the first that cannot lower any register.  The permutation
is a fixed shuffle between two strides of the shingle's own: a single stride would spread the
values of one shingle evenly over the bands, and break all of them in texts of few shingles.

1. Equal sets are one node (its smallest id).  2. Bands of registers give buckets.  3. Every node
is compared with the smallest node of its buckets: first with the one it shares most buckets
with, then with the others that are still in another component.  4. Buckets that still hold
several components are compared in full, block against block, on the sketches: the likelihood of
the register orders (and the set sizes) estimates the similarity, pairs of different components
that could reach the threshold are counted on hashed sets, and the links go on.  5. Every link is confirmed on the full sets.
So a group of thousands of copies costs about a comparison a member, and no link that would join
two components is left out.

Bands: with independent registers a pair at the threshold of 0.75 would share no bucket with a
probability of 2e-6.  Drawn at random, 13 of 3,200,000 pairs of 3 and 4 shingles (4e-6) and 1 of
400,000 pairs of 6 and 8 did not.  Pairs are put aside unseen when their estimate is five standard
errors below the threshold.

Defined cases: texts without words have an empty set and are linked with nothing; texts with
fewer words than a shingle are one shingle; A-Z are lower-cased, words are runs of other
characters than blanks; rows that share an id are one node, linked if any of them is; rows
without an id are nodes named by their texts, after all ids (ids are below 2^62), and a group of
only such rows has no component id; texts of any length are read whole; empty tables give empty results; other columns pass through
``survivors`` and are not read.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeworks.llm.shared import small_side, stored

WORDS = 5
PERCENT = 75
BANDS, ROWS = 48, 5
REGISTERS = 241  # a prime of at least BANDS * ROWS, so that every stride walks over all registers
BASE, RATE, TOP = 1.001, 20.0, 65534
FAR = 5.0
BLOCK, GROUP = 256, 64
BATCH_ROWS = 512
CACHED_WORDS = 200_000
UNNAMED, LEAST = 1 << 62, -(1 << 63)
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text: str | None) -> list[bytes]:
    """bytes.split() splits at exactly the six blanks x20, x09-x0D."""
    return (text or "").translate(LOWER).encode().split()


def shingles(text: str | None) -> set[bytes]:
    words = words_of(text)
    if not words:
        return set()
    return {b" ".join(words[k:k + WORDS]) for k in range(max(1, len(words) - WORDS + 1))}


def linked(a: set, b: set) -> bool:
    both = len(a & b)
    return bool(a and b) and 100 * both >= PERCENT * (len(a) + len(b) - both)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


SHUFFLE = np.argsort(mix(np.arange(1, REGISTERS + 1, dtype=np.uint64)))


class Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


def digest_of(hashes: np.ndarray) -> bytes | None:
    """The name of a set; an empty one has none."""
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest() if len(hashes) else None


def hashed(text: str | None, known: Hashes) -> np.ndarray:
    """Sorted distinct hashes of the shingles."""
    words = words_of(text)
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, n)
    last, out = max(1, n - WORDS + 1), np.zeros(1, np.uint64)
    for k in range(min(n, WORDS)):
        out = mix(out + np.uint64(0x9E3779B97F4A7C15)) ^ h[k:k + last]
    return np.unique(mix(out))


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """Registers (set, REGISTERS) of several sets at once."""
    least = np.full((len(sets), REGISTERS), np.inf)
    if not sets:
        return least.astype(np.uint16)
    e, own = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    draw = lambda k, n: (mix(e ^ np.uint64(k)) % np.uint64(n)).astype(np.int64)
    at, stride, shift, turn = draw(1, REGISTERS), draw(2, REGISTERS - 1) + 1, draw(3, REGISTERS), draw(4, REGISTERS - 1) + 1
    x = np.zeros(len(e))
    for j in range(REGISTERS):
        e = mix(e + np.uint64(0x9E3779B97F4A7C15))
        x = x - np.log(((e >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53) / (RATE * (REGISTERS - j))
        np.minimum.at(least.ravel(), own * REGISTERS + (shift + turn * SHUFFLE[at]) % REGISTERS, x)
        at = (at + stride) % REGISTERS
        if j < 4 or j % 8 == 0:
            on = x < least.max(1)[own]
            if not on.any():
                break
            e, own, at, stride, shift, turn, x = e[on], own[on], at[on], stride[on], shift[on], turn[on], x[on]
    with np.errstate(divide="ignore"):
        return np.clip(np.floor(1 - np.log(least) / np.log(BASE)), 0, TOP + 1).astype(np.uint16)


def likely(above: np.ndarray, below: np.ndarray, equal: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The similarity under which the counts of larger, smaller and equal registers are most likely, given both set sizes."""
    u = n / (n + m)
    grid = np.linspace(0.0, 1.0, 101)[None, :] * np.minimum(u, 1 - u)[:, None] / np.maximum(u, 1 - u)[:, None]
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)
    more, less = p(u[:, None] - (1 - u)[:, None] * grid), p((1 - u)[:, None] - u[:, None] * grid)
    floor = lambda x: np.log(np.maximum(x, 1e-12))
    value = above[:, None] * floor(more) + below[:, None] * floor(less) + equal[:, None] * floor(1 - more - less)
    return grid[np.arange(len(u)), value.argmax(1)]


def node(id: str, text: str) -> Column:
    """A row's id; rows without one are named by their text, after all ids."""
    return F.coalesce(F.col(id).cast("long"), F.lit(UNNAMED) + F.pmod(F.xxhash64(text), F.lit(UNNAMED)))


def sketched(df: DataFrame, id: str, text: str) -> DataFrame:
    """(id, n, digest, registers) of every row; registers only where a task meets the set for the first time."""
    def run(batches):
        known, seen = Hashes(), set()
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH_ROWS):
                batch = whole.slice(at, BATCH_ROWS)
                sets = [hashed(t, known) for t in batch.column("text").to_pylist()]
                digests = [digest_of(s) for s in sets]
                if len(seen) > CACHED_WORDS:
                    seen.clear()
                new = []
                for k, d in enumerate(digests):
                    if d is not None and d not in seen:
                        seen.add(d)
                        new.append(k)
                registers = dict(zip(new, sketches([sets[k] for k in new]), strict=True))
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()),
                                                  pa.array([registers[k].tobytes() if k in registers else None for k in range(len(sets))], pa.binary())], ["id", "n", "digest", "registers"])

    rows = df.select(node(id, text).alias("id"), F.col(text).alias("text"))
    return stored(rows.mapInArrow(run, "id long, n long, digest binary, registers binary"), "sketches")


def banded(nodes: DataFrame) -> DataFrame:
    """(bucket, id): a row for each band of each node."""
    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH_ROWS):
                batch = whole.slice(at, BATCH_ROWS)
                r = np.frombuffer(b"".join(batch.column("registers").to_pylist()), np.uint16).reshape(-1, REGISTERS)[:, :BANDS * ROWS].reshape(-1, BANDS, ROWS).astype(np.uint64)
                key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64) + np.uint64(1), r.shape[:2])
                for k in range(ROWS):
                    key = mix(key * np.uint64(0x9E3779B97F4A7C15) ^ r[:, :, k])
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64).ravel()), pa.array(np.repeat(np.asarray(batch.column("id")), BANDS))], ["bucket", "id"])

    return nodes.select("id", "registers").mapInArrow(run, "bucket long, id long")


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every node with an edge; edges (a, b) in either order.

    Large-star and small-star steps in turn: each node's larger neighbours are tied to its least
    one, then its smaller ones, until the edges are stars: one edge a node, and no centre that
    has one itself.
    """
    pairs = edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("m")).where("v <> m").distinct()
    while True:
        both = pairs.unionByName(pairs.select(F.col("m").alias("v"), F.col("v").alias("m")))
        least = both.groupBy("v").agg(F.min("m").alias("low")).select("v", F.least("v", "low").alias("low"))
        large = both.join(least, "v").where("m > v").select(F.col("m").alias("v"), F.col("low").alias("m")).where("v <> m")
        low = large.groupBy("v").agg(F.min("m").alias("low"))
        small = large.join(low, "v").select(F.explode(F.array(F.struct("v", F.col("low").alias("m")), F.struct(F.col("m").alias("v"), F.col("low").alias("m")))).alias("e")).select("e.v", "e.m").where("v <> m").distinct()
        pairs = stored(small, "edges")
        roles = pairs.select(F.col("v").alias("id"), F.lit(1).alias("own"), F.lit(0).alias("centre")).unionByName(pairs.select(F.col("m").alias("id"), F.lit(0).alias("own"), F.lit(1).alias("centre")))
        if roles.groupBy("id").agg(F.sum("own").alias("own"), F.max("centre").alias("centre")).where("own + centre > 1").isEmpty():
            return pairs.select(F.col("v").alias("id"), F.col("m").alias("component")).unionByName(pairs.select(F.col("m").alias("id"), F.col("m").alias("component")).distinct())


def roots(links: DataFrame, jumps: int = 2) -> DataFrame:
    """(id, component) a few steps up from each b, where links (a, b) lead from b to one smaller a: near enough to skip pairs by."""
    up = links.select(F.col("b").alias("id"), F.col("a").alias("component"))
    for _ in range(jumps):
        higher = up.select(F.col("id").alias("component"), F.col("component").alias("top"))
        up = up.join(higher, "component", "left").select("id", F.coalesce("top", "component").alias("component"))
    return stored(up, "roots")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are linked.  Pairs are dealt to groups by a and parts of its partners, so each text is read once a group."""
    def check(table: pa.Table) -> pa.Table:
        heads, rest = {}, []
        for a, part, b, text in zip(*(table[c].to_pylist() for c in ("a", "part", "b", "text")), strict=True):
            if b is None:
                heads.setdefault((a, part), []).append(shingles(text))
            else:
                rest.append((a, part, b, text))
        good = [(a, b) for a, part, b, text in rest for s in [shingles(text)] if any(linked(s, h) for h in heads.get((a, part), ()))]
        return pa.table({"a": pa.array([a for a, _ in good], pa.int64()), "b": pa.array([b for _, b in good], pa.int64())})

    pairs = pairs.select("a", "b").distinct()
    sizes = pairs.groupBy("a").agg(F.ceil(F.count("*") / GROUP).alias("parts"))
    dealt = pairs.join(sizes, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).alias("part"))
    dealt = stored(dealt, "pairs")
    groups = max(1, dealt.count() // GROUP)
    heads = dealt.select("a", "part").distinct().select("a", "part", F.lit(None).cast("long").alias("b"), F.col("a").alias("of"))
    roles = dealt.select("a", "part", "b", F.col("b").alias("of")).unionByName(heads)
    rows = roles.join(texts, F.col("of") == F.col("id")).select("a", "part", "b", "text", F.pmod(F.xxhash64("a", "part"), F.lit(groups)).alias("batch"))
    return stored(rows.groupBy("batch").applyInArrow(check, "a long, b long"), "links")


def short_sets(texts: DataFrame) -> DataFrame:
    """(digest, hashes) with 32-bit hashes of a text's shingles: small enough to travel with every bucket."""
    def run(batches):
        known = Hashes()
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH_ROWS):
                sets = [hashed(t, known) for t in whole.slice(at, BATCH_ROWS).column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([digest_of(s) for s in sets], pa.binary()), pa.array([np.unique((s >> np.uint64(32)).astype(np.uint32)).tobytes() for s in sets], pa.binary())], ["digest", "hashes"])

    return stored(texts.select("text").mapInArrow(run, "digest binary, hashes binary").groupBy("digest").agg(F.first("hashes").alias("hashes")), "short_sets")


def several(every: DataFrame) -> DataFrame:
    """(id) of the ids whose rows have several sets, an empty one counting too."""
    many = every.groupBy("id").agg(F.min("digest").alias("low"), F.max("digest").alias("high"), F.count("digest").alias("with"), F.count("*").alias("rows"))
    return stored(many.where("low <> high OR `with` > 0 AND `with` < rows").select("id"), "several")


def ties(every: DataFrame, nodes: DataFrame, many: DataFrame) -> DataFrame:
    """(a, b) that tie the nodes of each id b of ``many``; it may be no node itself, its sets being those of smaller ids."""
    of = every.join(small_side(many), "id").where(F.col("digest").isNotNull()).select("id", "digest").distinct()
    return stored(of.join(nodes.select("digest", F.col("id").alias("node")), "digest").where("node <> id").select(F.col("node").alias("a"), F.col("id").alias("b")).distinct(), "ties")


def leftovers(members: DataFrame, nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of different components within one bucket that reach the threshold, up to the collisions of short hashes.

    Members of one bucket and component that are many get blocks of their own, the others share
    blocks, and only blocks that can hold different components meet.  Pairs that the likelihood
    does not rule out are counted on their hashed sets in the same task, so what leaves it is not
    the pairs of a group but its links.
    """
    by_label = members.groupBy("bucket", "label").agg(F.count("*").alias("many"))
    wide = by_label.select("bucket", "label", (F.col("many") >= BLOCK).alias("alone"), "many")
    few = wide.where("not alone").groupBy("bucket").agg(F.sum("many").alias("others"))
    placed = members.join(wide, ["bucket", "label"]).join(few, "bucket", "left")
    home = F.when(F.col("alone"), F.col("label"))
    nth = F.pmod(F.xxhash64("id"), F.ceil(F.when(F.col("alone"), F.col("many")).otherwise(F.col("others")) / BLOCK))
    rows = placed.select("bucket", home.alias("home"), nth.alias("nth"), "id", "label").join(nodes.select("id", "n", "digest", "registers").join(sets, "digest"), "id")
    blocks = stored(rows.groupBy("bucket", "home", "nth").agg(F.collect_list(F.struct("id", "label", "n", "registers", "hashes")).alias("rows")), "blocks")
    other = blocks.select("bucket", F.col("home").alias("home2"), F.col("nth").alias("nth2"), F.col("rows").alias("rows2"))
    rank = lambda a, b: F.struct(F.coalesce(F.col(a), F.lit(LEAST)), F.col(b))
    meet = blocks.join(other, "bucket").where((rank("home", "nth") <= rank("home2", "nth2")) & (F.col("home").isNull() | ~F.col("home").eqNullSafe(F.col("home2"))))
    least = PERCENT / 100 - FAR * np.sqrt(PERCENT / 100 * (1 - PERCENT / 100) / REGISTERS)

    def compare(batches):
        for batch in batches:
            for bucket, one, two in zip(*(batch.column(k) for k in range(3)), strict=True):
                sides = []
                for side in (one.values, two.values):
                    ids, label, n = (np.asarray(side.field(f)) for f in ("id", "label", "n"))
                    sides.append((ids, label, n, np.frombuffer(b"".join(side.field("registers").to_pylist()), np.uint16).reshape(-1, REGISTERS), [np.frombuffer(h, np.uint32) for h in side.field("hashes").to_pylist()]))
                (ida, la, na, ra, ha), (idb, lb, nb, rb, hb) = sides
                i, j = np.nonzero((la[:, None] != lb[None, :]) & (100 * np.minimum(na[:, None], nb[None, :]) >= PERCENT * np.maximum(na[:, None], nb[None, :])))
                good = []
                for at in range(0, len(i), 20_000):
                    p, q = i[at:at + 20_000], j[at:at + 20_000]
                    same = ra[p] == rb[q]
                    # a pair is judged in the first band in which it meets
                    meets = same[:, :BANDS * ROWS].reshape(-1, BANDS, ROWS).all(2)
                    first = meets.argmax(1)
                    equal = same.sum(1)
                    more = (ra[p] > rb[q]).sum(1)
                    fits = meets.any(1) & (key_of(ra[p], first) == bucket.as_py())
                    fits &= likely(more, REGISTERS - equal - more, equal, na[p].astype(float), nb[q].astype(float)) >= least
                    p, q = p[fits], q[fits]
                    both = np.array([len(np.intersect1d(ha[x], hb[y], assume_unique=True)) for x, y in zip(p.tolist(), q.tolist(), strict=True)], np.int64)
                    both += 2 + (na[p] + nb[q]) // 5000  # hashes that fell together
                    fits = 100 * both >= PERCENT * (na[p] + nb[q] - both)
                    good.append(np.stack([ida[p[fits]], idb[q[fits]]]))
                found = np.concatenate(good, 1) if good else np.zeros((2, 0), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(found.min(0)), pa.array(found.max(0))], ["a", "b"])

    def key_of(registers, band):
        key = (band + 1).astype(np.uint64)
        for k in range(ROWS):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) ^ registers[np.arange(len(band)), band * ROWS + k].astype(np.uint64))
        return key.view(np.int64)

    return meet.select("bucket", "rows", "rows2").mapInArrow(compare, "a long, b long")


def grouped(df: DataFrame, id: str, text: str) -> DataFrame:
    """(id, n, component) for every row of ``df``, rows without an id under the name of their node."""
    every = sketched(df, id, text)
    nodes = every.where(F.col("digest").isNotNull()).groupBy("digest").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.max("registers").alias("registers"))
    nodes = stored(nodes, "nodes")
    buckets = banded(nodes)
    tops = buckets.groupBy("bucket").agg(F.min("id").alias("top"), F.count("*").alias("many")).where("many > 1")
    members = stored(buckets.join(tops.select("bucket", "top"), "bucket"), "members")
    asked = members.select("id").distinct()
    texts = stored(df.select(node(id, text).alias("id"), F.col(text).alias("text")).join(small_side(stored(asked, "asked")), "id"), "texts")
    shared = stored(members.where("id <> top").groupBy("id", "top").agg(F.count("*").alias("bands")), "shared")
    best = shared.groupBy("id").agg(F.max_by("top", F.struct("bands", -F.col("top"))).alias("a")).select("a", F.col("id").alias("b"))
    links = verified(best, texts)
    label = roots(links)
    named = lambda rows, key, name: rows.join(label.select(F.col("id").alias(key), F.col("component").alias(name)), key, "left").withColumn(name, F.coalesce(name, key))
    apart = named(named(shared.select(F.col("top").alias("a"), F.col("id").alias("b")), "a", "la"), "b", "lb").where("la <> lb").select("a", "b")
    links = links.unionByName(verified(apart, texts))
    many = several(every)
    tied = ties(every, nodes, many)
    label = components(links.unionByName(tied))
    placed = stored(named(members.select("bucket", "id"), "id", "label"), "labelled")
    split = placed.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("bucket")
    still = stored(placed.join(split, "bucket"), "open")
    held = texts.join(small_side(stored(still.select("id").distinct(), "held")), "id")
    rest = leftovers(still, nodes, short_sets(held))
    label = components(links.unionByName(verified(rest, texts)).unionByName(tied))
    of = nodes.select("digest", F.col("id").alias("node"))
    linked_to = of.join(label.select(F.col("id").alias("node"), "component"), "node", "left").select("digest", F.coalesce("component", "node").alias("component"))
    full = every.select("id", "n", "digest").join(linked_to, "digest", "left")
    # rows without words go with their id where it has other texts
    by_id = label.join(small_side(many), "id").select("id", F.col("component").alias("own"))
    full = full.join(small_side(stored(by_id, "several_of")), "id", "left")
    return full.select("id", "n", F.coalesce("component", "own", "id").alias("component"))


def classes(df: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept) for every row of ``df``."""
    known = lambda c: F.when(F.col(c) < UNNAMED, F.col(c))
    return grouped(df, id, text).select(known("id").alias("id"), F.col("n").alias("n_shingles"), known("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))


def survivors(df: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` with one document of each group: the one with the smallest id."""
    stays = stored(grouped(df, id, text).where("id = component").select(F.col("id").alias("_stays")).distinct(), "stays")
    return df.join(small_side(stays), node(id, text) == F.col("_stays"), "left_semi")
