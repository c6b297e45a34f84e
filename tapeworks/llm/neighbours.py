"""Approximate nearest neighbours by inner product with an inverted multi-index.

Vectors are halved and each half is quantised for itself, so K centroids a half make K^2 cells
for the price of 2 K.  A query adds up two short lists: the inner products of its halves with
the centroids.  A heap yields the pairs of centroids in the order of their summed distance
(the negative inner product), cell after cell, without looking at the rest.

It stops when the cells behind it hold the wanted share of the neighbours.  Each cell tells how
many vectors it has and how far they lie from its centre; under a normal law for the rest, the
score that the k-th neighbour should have follows, and with it the number of neighbours to
expect in every cell.  So clustered data needs few cells and data without structure many.
Entries of the visited cells are reranked by the exact inner product in double precision.

Work is dealt in blocks: entries in blocks of whole cells (a large cell is split over several),
queries in blocks of neighbours, and only blocks that meet in a visited cell are joined.  Equal
vectors are one entry with its smallest ids, equal queries are searched once, so no group of
copies makes work.  Centroids are fitted on at most ``SAMPLE_ROWS`` vectors, every vector is
indexed; the driver holds numbers by cell only.

Defined cases: vectors that are null, zero, or hold null or non-finite components take no part,
nor do those whose length is not the most frequent one (of ties the larger) and rows without an
id; rows equal in id and vector count once; ties go to the smaller id; a query with fewer than
k others gets all of them; empty tables give empty results.  Other columns are not read.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeworks.llm.shared import stored

SAMPLE_ROWS = 20_000
MOST_CENTROIDS = 256
ENTRY_BLOCK, QUERY_BLOCK = 2048, 512
LEAST_SCANNED = 4000
EXPECTED = 0.97


def usable(df: DataFrame, id: str, vector: str) -> DataFrame:
    """(id, vec, ka, kb) of the rows that take part; ka and kb together name the vector."""
    vec = F.transform(vector, lambda x: x.cast("double") + F.lit(0.0))  # -0.0 becomes 0.0
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    rows = df.where(F.col(id).isNotNull() & F.col(vector).isNotNull()).select(F.col(id).cast("long").alias("id"), vec.alias("vec"))
    rows = rows.where(F.forall("vec", fine) & F.exists("vec", lambda x: x != 0))
    sizes = rows.groupBy(F.size("vec").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).limit(1).collect()
    rows = rows.where(F.size("vec") == (sizes[0]["size"] if sizes else 0))
    return rows.select("id", "vec", F.xxhash64("vec").alias("ka"), F.xxhash64(F.lit(7), "vec").alias("kb")).groupBy("id", "ka", "kb").agg(F.first("vec").alias("vec"))


def distinct_vectors(rows: DataFrame, k: int) -> DataFrame:
    """One entry a vector with its k + 1 smallest ids; first within parts of the table, then over all."""
    part = rows.withColumn("part", F.spark_partition_id())
    few = part.withColumn("n", F.row_number().over(Window.partitionBy("ka", "kb", "part").orderBy("id"))).where(F.col("n") <= k + 1)
    few = few.withColumn("n", F.row_number().over(Window.partitionBy("ka", "kb").orderBy("id"))).where(F.col("n") <= k + 1)
    return few.groupBy("ka", "kb").agg(F.array_sort(F.collect_list("id")).alias("ids"), F.first("vec").alias("vec"))


def centroids(points: np.ndarray, count: int, rounds: int = 12, seed: int = 0) -> np.ndarray:
    """Lloyd's algorithm from a seeded start."""
    if not points.shape[1]:
        return np.zeros((1, 0))
    found = points[np.random.default_rng(seed).choice(len(points), min(count, len(points)), replace=False)]
    for _ in range(rounds):
        own = nearest(points, found)
        sums = np.stack([np.bincount(own, points[:, d], len(found)) for d in range(points.shape[1])], 1)
        size = np.bincount(own, minlength=len(found))
        found = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], found)
    return found


def nearest(points: np.ndarray, to: np.ndarray) -> np.ndarray:
    return ((to**2).sum(1) - 2 * points @ to.T).argmin(1)


def above(z: np.ndarray) -> np.ndarray:
    """Share of a normal law above z (a polynomial good to 1e-7)."""
    x = np.abs(z) / np.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    half = 0.5 * t * np.exp(-x * x) * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return np.where(z >= 0, half, 1 - half)


class Index:
    """Centroids, and by cell: entries, spread, first block and number of blocks."""

    def __init__(self, left: np.ndarray, right: np.ndarray):
        self.left, self.right, self.half = left, right, left.shape[1]

    def cells(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cell of each vector and the squared distances of its halves from their centroids."""
        a, b = nearest(x[:, : self.half], self.left), nearest(x[:, self.half :], self.right)
        return a * len(self.right) + b, ((x[:, : self.half] - self.left[a]) ** 2).sum(1), ((x[:, self.half :] - self.right[b]) ** 2).sum(1)

    def count(self, cells: np.ndarray, n: np.ndarray, rest_left: np.ndarray, rest_right: np.ndarray) -> None:
        shape = len(self.left), len(self.right)
        self.n = np.zeros(shape[0] * shape[1], np.int64)
        self.n[cells] = n
        spread = lambda rest, own, k: np.bincount(own, rest, k) / np.maximum(np.bincount(own, n, k), 1) / self.half
        self.spread = spread(rest_left, cells // shape[1], shape[0]), spread(rest_right, cells % shape[1], shape[1])
        self.blocks = np.maximum(-(-self.n // ENTRY_BLOCK), 1)
        self.first, block, room = np.zeros(len(self.n), np.int64), 0, ENTRY_BLOCK
        for c in np.flatnonzero(self.n).tolist():
            if self.n[c] > room and room < ENTRY_BLOCK:
                block, room = block + 1, ENTRY_BLOCK
            self.first[c] = block
            if self.blocks[c] > 1:
                block += int(self.blocks[c])
            else:
                room -= int(self.n[c])

    def visit(self, q: np.ndarray, k: int) -> np.ndarray:
        """Cells with entries, in the order of the heap, until enough neighbours are to be expected in them."""
        near_left, near_right = self.left @ q[: self.half], self.right @ q[self.half :]
        wide = np.sqrt(np.add.outer(self.spread[0] * (q[: self.half] ** 2).sum(), self.spread[1] * (q[self.half :] ** 2).sum()).ravel() + 1e-12)
        centre, used = np.add.outer(near_left, near_right).ravel(), np.flatnonzero(self.n)
        mean, dev, n = centre[used], wide[used], self.n[used]
        low, high = float((mean - 8 * dev).min()), float((mean + 8 * dev).max())
        for _ in range(30):
            mid = (low + high) / 2
            low, high = (mid, high) if n @ above((mid - mean) / dev) > k else (low, mid)
        hope = np.zeros(len(self.n))
        hope[used] = n * above((low - mean) / dev)
        enough, total = EXPECTED * hope.sum(), int(self.n.sum())
        i_order, j_order = np.argsort(-near_left, kind="stable"), np.argsort(-near_right, kind="stable")
        a, b, width = (-near_left[i_order]).tolist(), (-near_right[j_order]).tolist(), len(self.right)
        heap, upto, found, seen, got = [(a[0] + b[0], 0, 0)], [0] * len(a), [], 0, 0.0
        while heap:
            _, i, j = heapq.heappop(heap)
            upto[i] = j + 1  # pairs of row i before j + 1 are done
            if j + 1 < len(b) and (i == 0 or upto[i - 1] > j + 1):
                heapq.heappush(heap, (a[i] + b[j + 1], i, j + 1))
            if i + 1 < len(a) and upto[i + 1] == j:
                heapq.heappush(heap, (a[i + 1] + b[j], i + 1, j))
            cell = int(i_order[i]) * width + int(j_order[j])
            if self.n[cell]:
                found.append(cell)
                seen += int(self.n[cell])
                got += hope[cell]
                if got >= enough and seen >= min(LEAST_SCANNED, total):
                    break
        return np.array(found, np.int64)


def matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), float).reshape(len(column), -1)


def build(entries: DataFrame, sample_rows: int = SAMPLE_ROWS) -> tuple[Index, DataFrame]:
    """The index and the entries with their cell and block; one fit on a bounded sample, then a pass over all."""
    total = entries.count()
    share = min(1.0, sample_rows / max(total, 1))
    drawn = entries.where(F.pmod(F.xxhash64("ka", "kb"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1).limit(2 * sample_rows).select("vec").toArrow()["vec"].combine_chunks()
    points = matrix(drawn)
    k = int(np.clip(round(2.2 * total**0.25), 1, MOST_CENTROIDS))
    half = points.shape[1] // 2
    index = Index(centroids(points[:, :half], k, seed=1), centroids(points[:, half:], k, seed=2))

    def assign(batches):
        for batch in batches:
            cell, left, right = index.cells(matrix(batch.column("vec")))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(left), pa.array(right)], [*batch.schema.names, "cell", "rest_left", "rest_right"])

    fields = ", ".join(f"{n} {t}" for n, t in entries.dtypes)
    placed = stored(entries.mapInArrow(assign, f"{fields}, cell long, rest_left double, rest_right double"), "entries")
    stats = placed.groupBy("cell").agg(F.count("*").alias("n"), F.sum("rest_left").alias("a"), F.sum("rest_right").alias("b")).toPandas()  # at most MOST_CENTROIDS^2 rows
    index.count(*(stats[c].to_numpy() for c in ("cell", "n", "a", "b")))
    return index, placed


def block_of(index: Index):
    """A pass that adds an entry's block; entries of a split cell are dealt by their key."""
    def run(batches):
        for batch in batches:
            cell, key = (np.asarray(batch.column(c)) for c in ("cell", "ka"))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(index.first[cell] + key % index.blocks[cell])], [*batch.schema.names, "block"])
    return run


def search(df: DataFrame, is_query: Column, k: int = 20, id: str = "vec_id", vector: str = "embedding", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(query_id, rank, id, score): the k nearest found for every row that ``is_query`` (over ``id``) marks."""
    rows = stored(usable(df, id, vector), "vectors")
    asked = rows.where(is_query).select("id", "ka", "kb")
    if rows.isEmpty():
        return asked.select(F.col("id").alias("query_id"), F.lit(0).alias("rank"), "id", F.lit(0.0).alias("score"))
    index, entries = build(stored(distinct_vectors(rows, k), "distinct"), sample_rows)
    many = entries.sparkSession.conf.get("spark.sql.shuffle.partitions")

    def pack(table: pa.Table) -> pa.Table:
        body = matrix(table["vec"].combine_chunks()).tobytes()
        return pa.table({"block": table["block"][:1], "ids": pa.array([table["ids"].to_pylist()], pa.list_(pa.list_(pa.int64()))), "cells": pa.array([table["cell"].to_pylist()], pa.list_(pa.int64())), "vectors": pa.array([body], pa.binary())})

    blocked = entries.select("ka", "ids", "vec", "cell").mapInArrow(block_of(index), "ka long, ids array<long>, vec array<double>, cell long, block long")
    packed = stored(blocked.groupBy("block").applyInArrow(pack, "block long, ids array<array<long>>, cells array<long>, vectors binary"), "entry_blocks")

    def route(batches):
        """Blocks of queries that lie together, each sent to the entry blocks that its queries visit, with what they visit there."""
        for whole in batches:
            for at in range(0, whole.num_rows, QUERY_BLOCK):
                batch = whole.slice(at, QUERY_BLOCK)
                x, ka, kb = matrix(batch.column("vec")), np.asarray(batch.column("ka")), np.asarray(batch.column("kb"))
                pairs = [(q, c) for q in range(len(x)) for c in index.visit(x[q], k).tolist()]
                who, cell = (np.array(p, np.int64) for p in zip(*pairs, strict=True))
                times = index.blocks[cell]
                who, cell, block = np.repeat(who, times), np.repeat(cell, times), np.repeat(index.first[cell], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                order = np.argsort(block, kind="stable")
                for part in np.split(order, np.flatnonzero(np.diff(block[order])) + 1):
                    there, nth = np.unique(who[part], return_inverse=True)
                    yield pa.RecordBatch.from_pydict({"to": [int(block[part[0]])], "ka": [ka[there].tolist()], "kb": [kb[there].tolist()], "queries": [x[there].tobytes()], "nth": [nth.tolist()], "visited": [cell[part].tolist()]},
                                                     pa.schema([("to", pa.int64()), ("ka", pa.list_(pa.int64())), ("kb", pa.list_(pa.int64())), ("queries", pa.binary()), ("nth", pa.list_(pa.int64())), ("visited", pa.list_(pa.int64()))]))

    wanted = asked.select("ka", "kb").distinct().join(entries, ["ka", "kb"]).select("ka", "kb", "vec", "cell")
    dealt = wanted.repartitionByRange(int(many), "cell", "ka").sortWithinPartitions("cell", "ka")
    probes = stored(dealt.mapInArrow(route, "to long, ka array<long>, kb array<long>, queries binary, nth array<long>, visited array<long>"), "probes")

    def rerank(batches):
        kind = pa.schema([("ka", pa.int64()), ("kb", pa.int64()), ("found", pa.list_(pa.struct([("less", pa.float64()), ("id", pa.int64())])))])
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1)
                get = lambda c: one.column(c)[0]  # noqa: E731, B023
                ids, cells = get("ids").as_py(), np.asarray(get("cells").values)
                e, q = (np.frombuffer(get(c).as_buffer(), float).reshape(n, -1) for c, n in (("vectors", len(ids)), ("queries", len(get("ka")))))
                names, at = np.unique(cells, return_inverse=True)
                open_ = np.zeros((len(q), len(names)), bool)
                open_[np.asarray(get("nth").values), np.searchsorted(names, np.asarray(get("visited").values))] = True
                scores = np.where(open_[:, at], q @ e.T, -np.inf)
                found = []
                for s, x in zip(scores, q, strict=True):
                    least = np.partition(s, -(k + 1))[-(k + 1)] if len(s) > k + 1 else -np.inf
                    near = np.flatnonzero(s >= max(least - 1e-9 * (1 + abs(least)), -1e300) if np.isfinite(least) else s > -np.inf)
                    exact = (e[near] * x).sum(1)
                    found.append([{"less": less, "id": i} for less, i in sorted((-float(v), i) for v, n in zip(exact, near, strict=True) for i in ids[n])[: k + 1]])
                yield pa.RecordBatch.from_arrays([get("ka").values, get("kb").values, pa.array(found, kind.field("found").type)], schema=kind)

    partial = probes.join(packed, probes["to"] == packed["block"]).drop("to", "block").mapInArrow(rerank, "ka long, kb long, found array<struct<less:double,id:long>>")
    best = partial.groupBy("ka", "kb").agg(F.slice(F.array_sort(F.flatten(F.collect_list("found"))), 1, k + 1).alias("found"))
    own = asked.select(F.col("id").alias("query_id"), "ka", "kb").join(best, ["ka", "kb"])
    others = F.slice(F.filter("found", lambda x: x["id"] != F.col("query_id")), 1, k)
    return own.select("query_id", F.posexplode(others).alias("at", "x")).select("query_id", (F.col("at") + 1).alias("rank"), F.col("x.id").alias("id"), (-F.col("x.less")).alias("score"))
