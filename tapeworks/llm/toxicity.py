"""Toxic passages by maximum-scoring segments over token log-odds, with extreme-value calibration.

Learning.  Tokens and their four-letter beginnings fall into hashed buckets; for each bucket
the documents of either label that hold it are counted, equal texts once.  A Dirichlet prior
in proportion to the overall counts shrinks the log-odds of what is rare, and what is left is
lessened by three standard errors, so a bucket seen once proves nothing.  A token's score is
the sum of its two log-odds, clipped, less a drift that makes
clean text lose score.

Search.  One linear pass finds all maximal segments of a text, that is every passage whose
score cannot be raised by changing its ends: only tokens that gain score open a segment, so
the pass runs over these and takes the losses between them from prefix sums.

Calibration.  The best segment of a random text of n tokens follows an extreme-value law,
P(S > x) = 1 - exp(-K n exp(-lambda x)).  lambda is the root of E[exp(lambda s)] = 1 over the
token scores of clean training texts, K the maximum-likelihood value for their best segments.
A text's evidence is the sum of ``lambda S - ln(K n)`` over its significant segments; a logistic
curve fitted to the evidence of the training texts turns it into a probability.

All counts cover every training row; what comes to the driver is bounded by the number of
buckets and bins.  Labels serve learning only, and only rows of the training folds.

Defined cases: null and empty texts have no segments and the score of no evidence; rows
without a label, or with a null one, teach nothing; several labels of one id count as toxic if
one says so; without toxic training rows every score is 0.0 up to the prior share; texts of any length are
scanned whole, in time proportional to it; an empty table gives no rows; columns
with the results' names are replaced, others pass through.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeworks.llm.shared import small_side, stored

BUCKETS = 1 << 20
PRIOR, DOUBT = 20_000.0, 3.0
CLIP, DRIFT = 6.0, 0.3
BEGINNING = 4
CACHED_WORDS = 200_000
BATCH_ROWS = 512
BINS, BIN = 400, 0.25
STRIP = " \t\n\r\x0b\x0c.,;:!?\"'()[]{}<>|*%$#&-_"
RESULTS = ("toxicity", "passages")


def buckets_of(word: str) -> tuple[int, int]:
    key = word.lower().strip(STRIP)
    return zlib.crc32(key.encode()) % BUCKETS, zlib.crc32(b"^" + key[:BEGINNING].encode()) % BUCKETS


class Buckets(dict):
    """The two buckets of a word, remembered up to a bound."""

    def __missing__(self, word: str) -> tuple[int, int]:
        if len(self) >= CACHED_WORDS:
            self.clear()
        both = self[word] = buckets_of(word)
        return both


class Scores(dict):
    """The score of a word, remembered up to a bound."""

    def __init__(self, odds: np.ndarray):
        super().__init__()
        self.odds = odds

    def __missing__(self, word: str) -> float:
        if len(self) >= CACHED_WORDS:
            self.clear()
        a, b = buckets_of(word)
        score = self[word] = float(np.clip(self.odds[a] + self.odds[b], -CLIP, CLIP)) - DRIFT
        return score


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments as (from, to, score), in order of place.

    Each gaining token opens a candidate with the prefix sums before and after it.  A candidate
    is joined to the nearest earlier one that starts lower, as long as that one also ends lower.
    Every held segment knows the nearest before it that starts lower, so the search follows these
    links; where none starts lower, no later token can reach back, and all held are given out.
    """
    ups = np.flatnonzero(scores > 0)
    if not len(ups):
        return []
    sums = np.cumsum(scores)
    done: list[tuple[int, int, float, float]] = []
    held: list[tuple[int, int, float, float]] = []
    lower: list[int] = []
    for at, left, right in zip(ups.tolist(), (sums[ups] - scores[ups]).tolist(), sums[ups].tolist(), strict=True):
        start, low, k = at, left, len(held) - 1
        while k >= 0 and held[k][2] >= low:
            k = lower[k]
        while k >= 0 and held[k][3] < right:
            start, low, before = held[k][0], held[k][2], lower[k]
            del held[k:], lower[k:]
            k = before
        if k < 0:
            done += held
            held, lower = [], []
        held.append((start, at + 1, low, right))
        lower.append(k)
    return [(a, b, high - low) for a, b, low, high in done + held]


def held_out(id: str) -> Column:
    """The fold that is never learned from."""
    return F.crc32(F.coalesce(F.col(id).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def training_rows(df: DataFrame, labels: DataFrame, id: str, text: str, label: str) -> DataFrame:
    """(text, toxic) of labelled training rows, one for each text and label."""
    said = stored(labels.where(F.col(label).isNotNull() & ~held_out(id)).groupBy(F.col(id).alias("_id")).agg(F.max(label).cast("int").alias("toxic")), "labels")
    mark = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    keys = df.where(~held_out(id)).select(F.col(id).alias("_id"), mark.alias("mark")).join(small_side(said), "_id")
    first = stored(keys.groupBy("mark", "toxic").agg(F.min("_id").alias("_id")).select("_id", "toxic"), "teachers")
    return df.select(F.col(id).alias("_id"), F.col(text).alias("text")).join(small_side(first), "_id").select("text", "toxic")


def log_odds(taught: DataFrame) -> np.ndarray:
    """Log-odds of every bucket under the Dirichlet prior."""
    def count(batches):
        known, seen = Buckets(), np.zeros((2, BUCKETS))
        for batch in batches:
            for words, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                both = [known[w] for w in set((words or "").split())]
                seen[toxic, np.unique(np.array(both, np.int64).ravel())] += 1
        full = np.flatnonzero(seen.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(seen[0, full]), pa.array(seen[1, full])], ["bucket", "clean", "toxic"])

    kind = "bucket long, clean double, toxic double"
    rows = taught.mapInArrow(count, kind).groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).toArrow()  # at most BUCKETS rows
    seen = np.zeros((2, BUCKETS))
    seen[:, np.asarray(rows["bucket"])] = np.stack([np.asarray(rows["clean"]), np.asarray(rows["toxic"])])
    total = seen.sum(1)
    if not total.all():
        return np.zeros(BUCKETS, np.float32)
    prior = PRIOR * seen.sum(0) / total.sum()
    share = lambda k: (seen[k] + prior) / (total[k] + PRIOR - seen[k] - prior)
    with np.errstate(divide="ignore", invalid="ignore"):
        odds = np.log(share(1) / share(0))
        spread = np.sqrt(1 / (seen[0] + prior) + 1 / (seen[1] + prior))
    return np.where(seen.any(0), np.sign(odds) * np.maximum(np.abs(odds) - DOUBT * spread, 0), 0.0).astype(np.float32)


def fit(df: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic") -> dict:
    """The model: bucket ``odds``, extreme-value ``rate`` and ``size``, calibration ``slope`` and ``shift``."""
    spark = df.sparkSession
    taught = training_rows(df, labels, id, text, label)
    odds = spark.sparkContext.broadcast(log_odds(taught))

    def survey(batches):
        known = Scores(odds.value)
        for batch in batches:
            hist, out = np.zeros(BINS, np.int64), []
            for words, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = (words or "").split()
                scores = np.fromiter(map(known.__getitem__, words), float, len(words))
                if not toxic:
                    hist += np.bincount(((scores + CLIP + DRIFT) / (2 * CLIP) * (BINS - 1)).round().astype(int), minlength=BINS)
                out.append((-1, toxic, len(words), [s for _, _, s in segments(scores)]))
            out += [(k, 0, n, []) for k, n in enumerate(hist.tolist()) if n]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.float64())), strict=True)], ["bin", "toxic", "n", "found"])

    seen = stored(taught.mapInArrow(survey, "bin long, toxic int, n long, found array<double>"), "survey")
    bins = seen.where("bin >= 0").groupBy("bin").agg(F.sum("n").alias("n")).toPandas()
    rate = root(bins["bin"].to_numpy() / (BINS - 1) * 2 * CLIP - CLIP - DRIFT, bins["n"].to_numpy(float))
    best = F.coalesce(F.array_max("found"), F.lit(0.0))
    clean = seen.where("bin < 0 and toxic = 0 and n > 0").agg(F.count("*").alias("m"), F.sum(F.col("n") * F.exp(-rate * best)).alias("mass")).first()
    size = (clean["m"] + 1) / ((clean["mass"] or 0.0) + 1)
    edge = F.log(F.lit(size) * F.greatest("n", F.lit(1)))
    proof = F.aggregate(F.transform("found", lambda s: F.greatest(s * rate - edge, F.lit(0.0))), F.lit(0.0), lambda a, b: a + b)
    spread = seen.where("bin < 0").select("toxic", F.least(F.floor(proof / BIN), F.lit(BINS - 1)).alias("at")).groupBy("toxic", "at").count().toPandas()  # at most 2 BINS rows
    slope, shift = curve((spread["at"].to_numpy(float) + 0.5) * BIN * (spread["at"].to_numpy() > 0), spread["toxic"].to_numpy(float), spread["count"].to_numpy(float))
    return {"odds": odds, "rate": rate, "size": size, "slope": slope, "shift": shift}


def root(scores: np.ndarray, counts: np.ndarray) -> float:
    """The positive root of E[exp(x s)] = 1; 1.0 where clean texts never gain score."""
    if not len(scores) or scores.max() <= 0 or scores @ counts >= 0:
        return 1.0
    low, high = 1e-6, 20.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if np.exp(mid * scores) @ counts < counts.sum() else (low, mid)
    return low


def curve(x: np.ndarray, y: np.ndarray, n: np.ndarray, rounds: int = 200) -> tuple[float, float]:
    """Logistic regression on one value by damped Newton steps, lightly held to where it starts."""
    start = np.array([1.0, -4.0])
    if not n.sum():
        return tuple(start)
    hold = np.array([0.5, 0.1])

    def loss(w):
        z = w[0] * x + w[1]
        return n @ (np.logaddexp(0, z) - y * z) + 0.5 * hold @ (w - start) ** 2

    w = start
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(w[0] * x + w[1], -500, 500)))
        gap, bend = n * (p - y), n * p * (1 - p)
        slope = np.array([gap @ x, gap.sum()]) + hold * (w - start)
        step = np.linalg.solve(np.array([[(bend * x) @ x, bend @ x], [bend @ x, bend.sum()]]) + np.diag(hold), slope)
        while loss(w - step) > loss(w) and np.abs(step).max() > 1e-9:
            step = step / 2
        w = w - step
        if np.abs(step).max() <= 1e-9:
            break
    return float(w[0]), float(w[1])


def scored(df: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """``df`` with ``toxicity`` (0 to 1) and its significant ``passages``: first word, word after the last, evidence."""
    kept = [f for f in df.schema.fields if f.name not in RESULTS]
    odds, rate, size, slope, shift = (model[k] for k in ("odds", "rate", "size", "slope", "shift"))

    def run(batches):
        known = Scores(odds.value)
        kind = pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32()), ("evidence", pa.float64())]))
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH_ROWS):
                batch, passages, proof = whole.slice(at, BATCH_ROWS), [], []
                for words in batch.column(text).to_pylist():
                    words = (words or "").split()
                    edge = np.log(size * max(len(words), 1))
                    found = [(a, b, s * rate - edge) for a, b, s in segments(np.fromiter(map(known.__getitem__, words), float, len(words)))]
                    passages.append([{"from": a, "to": b, "evidence": e} for a, b, e in found if e > 0])
                    proof.append(sum(p["evidence"] for p in passages[-1]))
                score = 1 / (1 + np.exp(-np.clip(slope * np.array(proof) + shift, -50, 50)))
                yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), pa.array(score), pa.array(passages, kind)], [*(f.name for f in kept), *RESULTS])

    made = T._parse_datatype_string("array<struct<from:int,to:int,evidence:double>>")
    return df.mapInArrow(run, T.StructType([*kept, T.StructField(RESULTS[0], T.DoubleType()), T.StructField(RESULTS[1], made)]))
