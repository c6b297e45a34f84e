"""Quality filtering by a weak-label model: heuristic labellers, their accuracies by EM, a hashed linear scorer.

Nine overlapping heuristics vote good, bad or abstain on every text.  Nobody says how good
they are: expectation-maximisation over the counts of vote patterns (all rows; at most 3^9
patterns, however many rows) estimates, for each class, how often each heuristic casts each
vote, and with that the posterior of every pattern.  Posteriors are the labels of a logistic
scorer over hashed word shapes, which also judges what no heuristic looked for.

The scorer is fitted on a bounded sample (``SAMPLE_ROWS``, by a hash of id and text); votes,
EM and scoring cover all rows and whole texts.  No given label is ever read.

Defined cases: null and empty texts have no words and score by the bias alone; an empty
table leaves the scorer at its prior, which accepts; texts of any length are read whole; repeated
rows score alike, and a score on the cut is accepted; other columns
pass through unless they have the results' names.
"""

from __future__ import annotations

import operator
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SAMPLE_ROWS = 20_000
BUCKETS = 4096
CACHED_WORDS = 200_000
BATCH_ROWS = 512
RESULTS = ("quality_score", "accepted")
ABSTAIN, GOOD, BAD = 0, 1, 2
SYMBOLS = b"%$#*&|!~^=<>{}[]\\@_+"
LABELLERS = ("repeated words", "capitals", "symbols", "columns", "few distinct words", "non-words", "punctuation", "repeated lines", "prose")


def votes(text: str | None) -> tuple[int, ...]:
    """One vote a labeller.  Most look for one defect and abstain where they do not see it: lacking a defect is no merit."""
    words = (text or "").split()
    n = len(words)
    if not n:
        return (ABSTAIN,) * len(LABELLERS)
    raw, lines = text.encode(), text.split("\n")
    long = n >= 20
    ends = sum(1 for w in words if w[-1] in ".!?,;:") / n
    distinct, alpha = len(set(words)) / n, sum(map(str.isalpha, words)) / n
    bad = (
        sum(map(operator.eq, words, words[1:])) > 0.3 * n and long,
        sum(map(str.isupper, words)) > 0.3 * n and long,
        len(raw) - len(raw.translate(None, SYMBOLS)) > 0.3 * n and long,
        words.count("|") > 0.1 * n and long,
        distinct < 0.45 and long,
        alpha < 0.5 and long,
        ends > 0.6 and long,
        len(set(lines)) < 0.5 * len(lines),
    )
    prose = long and 0.05 < ends < 0.3 and distinct > 0.5 and alpha > 0.65
    return *(BAD if x else ABSTAIN for x in bad), GOOD if prose else ABSTAIN


def accuracies(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, float]:
    """EM over vote patterns: P(vote | class) as [labeller, class, vote], each pattern's P(good), and the share of good rows.

    It starts from the votes taken at their word (any vote for bad makes a row bad), which
    names the classes; weak Dirichlet priors decide where the table has too few rows to tell.
    """
    prior = np.array([[8.0, 2.0, 0.1], [4.0, 0.2, 2.0]])  # rows: good, bad; columns: abstain, good, bad
    said = np.eye(3)[patterns]  # pattern, labeller, vote
    good = np.where((patterns == BAD).any(1), 0.05, 0.98)
    given, share = prior, 0.9
    for _ in range(rounds):
        both = np.stack([good, 1 - good], 1) * counts[:, None]
        given = np.einsum("plv,pc->lcv", said, both) + prior
        given /= given.sum(2, keepdims=True)
        share = (both[:, 0].sum() + 9) / (both.sum() + 10)
        like = np.einsum("plv,lcv->pc", said, np.log(given)) + np.log([share, 1 - share])
        now = 1 / (1 + np.exp(np.clip(like[:, 1] - like[:, 0], -700, 700)))
        moved = np.abs(now - good).max(initial=0)
        good = now
        if moved < 1e-9:
            break
    return given, good, share


def shape(word: str) -> str:
    """A word with its letters and digits folded to kinds and runs collapsed: ``Ab12!!`` is ``Aa0!``."""
    if word.islower() and word.isalpha():
        return "a"
    return re.sub(r"(.)\1+", r"\1", "".join("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in word), flags=re.S)


class Buckets(dict):
    """Bucket of each word's shape, remembered up to a bound."""

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        at = self[word] = zlib.crc32(shape(word).encode()) % (BUCKETS - 2)
        return at


def features(text: str | None, known: Buckets) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and their shares: word shapes, words equal to the one before, words said before."""
    words = (text or "").split()
    n = len(words)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0)
    where, count = np.unique(np.fromiter(map(known.__getitem__, words), np.int64, n), return_counts=True)
    own = np.array([sum(map(operator.eq, words, words[1:])), n - len(set(words))])
    return np.concatenate([where, [BUCKETS - 2, BUCKETS - 1]]), np.concatenate([count, own]) / n


def train(rows: list[tuple[np.ndarray, np.ndarray]], good: np.ndarray, rounds: int = 300, rate: float = 0.3, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by Adam; weights by bucket and the bias."""
    weights, bias = np.zeros(BUCKETS), 2.0
    if not rows:
        return weights, bias
    owner = np.repeat(np.arange(len(rows)), [len(a) for a, _ in rows])
    where, value = np.concatenate([a for a, _ in rows]), np.concatenate([b for _, b in rows])
    state = np.zeros((2, BUCKETS + 1))
    for step in range(1, rounds + 1):
        z = bias + np.bincount(owner, weights[where] * value, len(rows))
        gap = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - good) / len(rows)
        slope = np.append(np.bincount(where, gap[owner] * value, BUCKETS) + decay * weights, gap.sum())
        state = np.array([0.9, 0.999])[:, None] * state + np.array([0.1, 0.001])[:, None] * np.stack([slope, slope**2])
        move = rate * state[0] / (1 - 0.9**step) / (np.sqrt(state[1] / (1 - 0.999**step)) + 1e-12)
        weights, bias = weights - move[:-1], bias - move[-1]
    return weights, bias


def fit(df: DataFrame, id: str = "doc_id", text: str = "text", sample_rows: int = SAMPLE_ROWS) -> dict:
    """The model: ``accuracies`` by labeller, ``share`` of good rows, scorer ``weights`` and ``bias``."""
    powers = 3 ** np.arange(len(LABELLERS))

    def tally(batches):
        for batch in batches:
            seen = Counter(int(np.dot(votes(t), powers)) for t in batch.column(0).to_pylist())
            yield pa.RecordBatch.from_pydict({"pattern": list(seen), "n": list(seen.values())}, pa.schema([("pattern", pa.int64()), ("n", pa.int64())]))

    counted = df.select(text).mapInArrow(tally, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).orderBy("pattern").collect()  # at most 3^9 rows
    total = sum(r["n"] for r in counted)
    patterns = np.array([r["pattern"] for r in counted], np.int64)[:, None] // powers % 3 if counted else np.zeros((0, len(LABELLERS)), np.int64)
    given, good, share = accuracies(patterns, np.array([r["n"] for r in counted], float))
    posterior = {r["pattern"]: float(g) for r, g in zip(counted, good, strict=True)}
    part = min(1.0, sample_rows / max(total, 1))

    def learn(batches):
        known = Buckets()
        for batch in batches:
            rows = [(int(np.dot(votes(t), powers)), *features(t, known)) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.list_(pa.int64())), pa.array([r[2] for r in rows], pa.list_(pa.float64()))], ["pattern", "buckets", "shares"])

    ticket = F.pmod(F.xxhash64(F.lit("quality"), id, text), F.lit(1 << 30))
    drawn = df.where(ticket < int(part * (1 << 30)) + 1).select(text).limit(2 * sample_rows)
    rows = drawn.mapInArrow(learn, "pattern long, buckets array<long>, shares array<double>").toArrow()
    sample = [(np.array(b, np.int64), np.array(s)) for b, s in zip(rows["buckets"].to_pylist(), rows["shares"].to_pylist(), strict=True)]
    weights, bias = train(sample, np.array([posterior[p] for p in rows["pattern"].to_pylist()]))
    return {"accuracies": dict(zip(LABELLERS, given.tolist(), strict=True)), "share": share, "weights": weights, "bias": float(bias)}


def scored(df: DataFrame, model: dict, text: str = "text", least: float = 0.35) -> DataFrame:
    """``df`` with ``quality_score`` (probability of good) and ``accepted``: to reject a text takes more than even odds."""
    kept = [f for f in df.schema.fields if f.name not in RESULTS]
    weights, bias = model["weights"], model["bias"]

    def run(batches):
        known = Buckets()
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH_ROWS):
                batch = whole.slice(at, BATCH_ROWS)
                z = np.array([bias + np.dot(weights[where], share) for where, share in (features(t, known) for t in batch.column(text).to_pylist())])
                score = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
                yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), pa.array(score), pa.array(score >= least)], [*(f.name for f in kept), *RESULTS])

    return df.mapInArrow(run, T.StructType([*kept, T.StructField(RESULTS[0], T.DoubleType()), T.StructField(RESULTS[1], T.BooleanType())]))
