"""Spelling variants grouped by a variable-length gram index.

Words are the runs of letters of all texts, counted in every document's task before anything
moves.  Two words are near if one code point inserted, deleted or replaced turns one into the
other; near words are found through grams of two to ``LONGEST`` code points:

* the *gram dictionary* holds a longer gram only where its beginning is frequent, so frequent
  short grams are told apart by their extensions and no list of the index is long for want of
  context.  A gram must itself occur ``least`` times; that bound is raised with the vocabulary so
  that at most ``MOST_GRAMS`` grams of a length can reach it, and the dictionary may be broadcast;
* a word (between two end marks) is *decomposed* into the longest dictionary grams that no
  other gram covers;
* one edit can change only grams that span it, or that a longer gram might cover after it.  The
  largest number over all edits, the word's *bound*, is found by looking up the beginnings and
  the ends of dictionary grams.  Of two near words each keeps all but ``bound`` of its grams, and
  the rarest gram that both keep is among the ``bound + 1`` rarest of either.  Only the lists of
  these grams are merged, by gram, length and place: from the front if it stands before the
  edit, from the back if behind;
* every pair that meets in a list is *verified* by its edit distance.

A word whose grams may all change, and words that meet in a list of more than ``LONG_LIST``, are
compared by the words they become without one code point; that finds the same pairs without a
product of the list.  Both ways together are exact, whatever the dictionary.

Defined cases: null and empty texts have no words; a null id counts as the empty text in the
hash; words of any length are handled whole; repeated rows count as often as they occur; of near
words with equal counts the first in code-point order gives the form; other columns are not
read; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeworks.llm.shared import small_side, stored

LETTER = "A-Za-zÀ-ÿ"
SHORTEST, LONGEST = 2, 4
FREQUENT, LEAST = 300, 30
MOST_GRAMS = 100_000
LONG_LIST = 1024
CHUNK = 1 << 20
HELD_WORDS = 200_000
OPEN, CLOSE = "\x02", "\x03"


def damaged(word: str, before: int = 0) -> str:
    """The run without one of its code points, if its hash, carried on from ``before``, is divisible by 199."""
    h = zlib.crc32(word.encode(), before)
    if h % 199:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1:]


def _runs(text: str, least: int) -> Iterator[list[str]]:
    """Maximal runs of ``least`` letters or more, ASCII in lower case, from parts of the text that end outside a run."""
    found, gap = re.compile(f"[{LETTER}]{{{least},}}"), re.compile(f"[^{LETTER}]")
    text = text.encode().lower().decode()  # bytes.lower() changes A to Z only
    at = 0
    while at < len(text):
        stop = gap.search(text, at + CHUNK) if at + CHUNK < len(text) else None
        end = stop.start() if stop else len(text)
        yield found.findall(text, at, end)
        at = max(end, at + 1)


def counted(docs: DataFrame, least_size: int = 6, least_n: int = 5, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n) of all texts."""
    def run(batches):
        held: Counter = Counter()
        for batch in batches:
            for doc, body in zip(batch.column(id).to_pylist(), batch.column(text), strict=True):
                before = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                for runs in _runs(body.as_py() or "", least_size):
                    for word, n in Counter(runs).items():
                        word = damaged(word, before)
                        if len(word) >= least_size:
                            held[word] += n
                    if len(held) >= HELD_WORDS:
                        yield _words(held)
                        held.clear()
        yield _words(held)

    return docs.select(id, text).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_n)


def _words(held: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])


@dataclass
class Grams:
    """The gram dictionary: rank by rarity of every gram that a word may be cut into."""

    rank: dict[str, int]

    def __post_init__(self):
        longer = [g for g in self.rank if len(g) > SHORTEST]
        self.longer = set(longer)
        self.begins = {g[:k] for g in longer for k in range(1, len(g))}
        self.finishes = {g[-k:] for g in longer for k in range(1, len(g))}

    def cut(self, word: str) -> tuple[list[int], list[int]]:
        """Starts and ends of the word's grams; both ascend, as no gram covers another."""
        starts, ends, reach, n, longer = [], [], 0, len(word), self.longer
        for at in range(n - SHORTEST + 1):
            end = at + SHORTEST
            while end < n and word[at:end + 1] in longer:
                end += 1
            if end > reach:
                starts.append(at)
                ends.append(end)
                reach = end
        return starts, ends

    def bound(self, word: str, starts: list[int], ends: list[int]) -> int:
        """The most grams that one edit between the end marks can change."""
        n, worst, begins, finishes = len(word), 0, self.begins, self.finishes
        for at in range(1, n):
            far = at  # a gram may begin here and, after the edit, reach over it
            for k in range(at - 1, max(-1, at - LONGEST), -1):
                if word[k:at] in begins:
                    far = k
            # grams from the first that starts at ``far`` or reaches over the edit
            lo = min(bisect_left(starts, far), bisect_right(ends, at))
            for skip in (0, 1) if at < n - 1 else (0,):  # inserted before ``at``, or ``at`` itself deleted or replaced
                to = at + skip
                near = to  # a gram may end here and begin before the edit
                for k in range(to + 1, min(n, to + LONGEST - 1) + 1):
                    if word[to:k] in finishes:
                        near = k
                hi = max(bisect_left(starts, to), bisect_right(ends, near))
                worst = max(worst, hi - lo)
        return worst


def dictionary(words: DataFrame) -> Grams:
    """The grams that words are cut into, ranked from rare to frequent; what comes to the driver is bounded by ``MOST_GRAMS`` a length."""
    def run(batches):
        for batch in batches:
            seen: Counter = Counter()
            for word in batch.column("word").to_pylist():
                word = OPEN + word + CLOSE
                for size in range(SHORTEST, LONGEST + 1):
                    seen.update(word[k:k + size] for k in range(len(word) - size + 1))
            yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], ["gram", "n"])

    size = F.length("gram")
    grams = stored(words.select("word").mapInArrow(run, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n")), "grams")
    places = grams.where(size == SHORTEST).agg(F.sum("n")).first()[0] or 0
    least = max(LEAST, -(-places // MOST_GRAMS))
    count: dict[str, int] = {}
    for row in grams.where((size == SHORTEST) | (F.col("n") >= least)).orderBy(size).collect():  # two letters: at most the square of the alphabet
        gram = row.gram
        if len(gram) == SHORTEST or count.get(gram[:-1], 0) > FREQUENT:
            count[gram] = row.n
    return Grams({g: k for k, g in enumerate(sorted(count, key=lambda g: (count[g], g)))})


POSTING = "key long, role int, word string, n long"


def postings(words: DataFrame, grams: Grams) -> DataFrame:
    """Index entries of every word's rarest grams: role 0 meets 0 (equal length), 1 meets 2 (a code point longer).  Words without a sure gram get role -1 and no list.

    The key is made of the gram's rank, its place from the front or the back, and the shorter length; keys of very long words may coincide, which only adds pairs to verify.
    """
    shared = words.sparkSession.sparkContext.broadcast(grams)

    def run(batches):
        known = shared.value
        rank = known.rank
        for batch in batches:
            rows: list[tuple[int, int, str, int]] = []
            for word, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist(), strict=True):
                marked = OPEN + word + CLOSE
                starts, ends = known.cut(marked)
                bound, size = known.bound(marked, starts, ends), len(word)
                if bound >= len(starts):
                    rows.append((0, -1, word, n))
                rarest = sorted((rank[marked[a:b]], a, b) for a, b in zip(starts, ends, strict=True))[:bound + 1]
                for gram, a, b in rarest:
                    back = size + 2 - b
                    rows += [(_key(gram, a, size, 0), 0, word, n),
                             (_key(gram, a, size, 1), 1, word, n), (_key(gram, back, size, 2), 1, word, n),
                             (_key(gram, a, size - 1, 1), 2, word, n), (_key(gram, back, size - 1, 2), 2, word, n)]
            if rows:
                key, role, word, n = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.array(key, np.int64)), pa.array(role, pa.int32()), pa.array(word, pa.string()), pa.array(n, pa.int64())], ["key", "role", "word", "n"])

    return words.select("word", "n").mapInArrow(run, POSTING)


def _key(gram: int, place: int, size: int, kind: int) -> int:
    return (((gram << 20 | place & 0xFFFFF) << 20 | size & 0xFFFFF) << 2 | kind) & (1 << 63) - 1


def _side(df: DataFrame, tag: str) -> DataFrame:
    return df.select("key", F.col("word").alias(tag), F.col("n").alias(f"n_{tag}"))


def by_deletion(words: DataFrame) -> DataFrame:
    """Near pairs (a, n_a, b, n_b) among ``words`` (word, n): equal when one code point is masked, or when the longer one loses it."""
    at = words.select("word", "n", F.explode(F.sequence(F.lit(1), F.length("word"))).alias("at"))
    rest = F.col("word").substr(F.col("at") + 1, F.length("word"))
    head = F.substring("word", 1, F.col("at") - 1)
    masked = at.select(F.concat(head, F.lit(OPEN), rest).alias("key"), "word", "n")
    same = _side(masked, "a").join(_side(masked, "b"), "key").where("a < b").drop("key")
    without = at.select(F.concat(head, rest).alias("key"), "word", "n")
    shorter = words.select(F.col("word").alias("a"), F.col("n").alias("n_a"))
    longer = without.select(F.col("key").alias("a"), F.col("word").alias("b"), F.col("n").alias("n_b"))
    return same.unionByName(shorter.join(longer, "a"))


def near_pairs(words: DataFrame, grams: Grams | None = None, long_list: int = LONG_LIST) -> DataFrame:
    """Distinct near pairs (a, n_a, b, n_b) of ``words`` (word, n), each once."""
    index = stored(postings(words, grams or dictionary(words)), "gram_index")
    lists = index.where("role >= 0")
    long = small_side(stored(lists.groupBy("key").count().where(F.col("count") > long_list).select("key"), "long_lists"))
    lists = lists.join(long, "key", "left_anti")
    near = F.levenshtein("a", "b", 1) == 1
    same, shorter, longer = (_side(lists.where(F.col("role") == r), "a" if r < 2 else "b") for r in (0, 1, 2))
    pairs = same.join(same.select("key", F.col("a").alias("b"), F.col("n_a").alias("n_b")), "key").where((F.col("a") < F.col("b")) & near)
    pairs = pairs.unionByName(shorter.join(longer, "key").where(near)).drop("key")
    left = index.where("role = -1").select("word", "n").unionByName(index.where("role >= 0").join(long, "key", "left_semi").select("word", "n")).distinct()
    return pairs.unionByName(by_deletion(left)).distinct()


def variants(words: DataFrame, ratio: int = 5, grams: Grams | None = None, long_list: int = LONG_LIST) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of ``words`` (word, n)."""
    pairs = near_pairs(words, grams, long_list)
    both = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("n")), F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("n")))).alias("p")).select("p.*")
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n")).alias("n"), "near")).alias("best"))
    found = words.select("word", "n").join(best, "word", "left")
    is_form = -F.col("best.n") >= ratio * F.col("n")
    formed = stored(found.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("best.near")).alias("form"), F.when(is_form, -F.col("best.n")).alias("form_n")), "word_forms")
    return formed.join(roots(formed), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def roots(formed: DataFrame) -> DataFrame:
    """(word, root) of the words that have a form: pointers are doubled until all have ended; forms grow by the ratio, so chains are short and rounds few."""
    at, moved = stored(formed.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "roots"), True
    while moved:
        further = small_side(at.select(F.col("word").alias("root"), F.col("root").alias("further")), "root", "further")
        step = stored(at.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        at, moved = step.select("word", "root"), step.where("moved").limit(1).count() > 0
    return at
