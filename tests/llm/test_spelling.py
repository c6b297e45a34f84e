import random
import zlib
from collections import Counter

import pytest

from tapeworks.llm import spelling
from tapeworks.llm.queries import QUERIES


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def by_hand(words):
    out = {}
    for w, n in words.items():
        near = sorted((-m, v) for v, m in words.items() if one_edit(w, v))
        form = near[0][1] if near and -near[0][0] >= 5 * n else None
        out[w] = (form, n, len(near), words[form] if form else None)

    def root(w):
        return root(out[w][0]) if out[w][0] else w
    return {(w, f, root(w), n, k, m) for w, (f, n, k, m) in out.items()}


def random_words(rnd, letters, count, size):
    return {"".join(rnd.choice(letters) for _ in range(rnd.randint(1, size))): rnd.choice([5, 7, 30, 200, 1500]) for _ in range(count)}


def made(spark, words, **how):
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    got = [tuple(r) for r in spelling.variants(df, **how).select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize("case", range(6))
def test_against_all_pairs(spark, monkeypatch, case):
    rnd = random.Random(case)
    monkeypatch.setattr(spelling, "FREQUENT", [300, 5, 20, 0, 40, 2][case])
    monkeypatch.setattr(spelling, "LEAST", [30, 2, 5, 1, 3, 2][case])
    words = random_words(rnd, ["ab", "abc", "abcdeé", "ab", "aÿz", "abcdefgh"][case], 500, [12, 9, 8, 9, 7, 5][case])
    assert made(spark, words, long_list=[1024, 1024, 3, 10, 0, 1024][case]) == by_hand(words)


@pytest.mark.parametrize("letters", ["ab", "abc", "abcdefgh"])
def test_bound_holds(letters):
    """No edit changes more grams than the bound says: the rarest grams of both words meet at a place."""
    rnd = random.Random(len(letters))
    seen = Counter()
    words = ["".join(rnd.choice(letters) for _ in range(rnd.randint(2, 14))) for _ in range(400)]
    for w in words:
        m = spelling.OPEN + w + spelling.CLOSE
        seen.update(m[k:k + q] for q in (2, 3, 4) for k in range(len(m) - q + 1))
    for frequent in (0, 10, 60):
        kept = {}
        for g in sorted(seen, key=len):
            if len(g) == 2 or kept.get(g[:-1], 0) > frequent and seen[g] >= 2:
                kept[g] = seen[g]
        grams = spelling.Grams({g: k for k, g in enumerate(sorted(kept, key=lambda g: (kept[g], g)))})

        def cut(word):
            marked = spelling.OPEN + word + spelling.CLOSE
            starts, ends = grams.cut(marked)
            return {(marked[a:b], a, len(marked) - b) for a, b in zip(starts, ends, strict=True)}, grams.bound(marked, starts, ends)

        for w in words:
            k, c = rnd.randrange(len(w)), rnd.choice(letters)
            for v in (w[:k] + w[k + 1:], w[:k] + c + w[k:], w[:k] + c + w[k + 1:]):
                one, bound = cut(w)
                two, _ = cut(v)
                front, back = {(g, a) for g, a, _ in two}, {(g, z) for g, _, z in two}
                assert sum((g, a) not in front and (g, z) not in back for g, a, z in one) <= bound, (w, v)


def test_counts(spark, odd, empty, monkeypatch):
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    rows += [(k, "Straße ÉTÉété naïveté, Weltzeit weltzeit WELTZEIT! x÷yzabc×") for k in range(400)] + [(None, "nobody nobody"), (900, "q" * 5000 + " " + "Z" * 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = Counter()
    import re
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.encode().lower().decode()
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            want[run if h % 199 else run[:h % len(run)] + run[h % len(run) + 1:]] += 1
    monkeypatch.setattr(spelling, "CHUNK", 50)
    monkeypatch.setattr(spelling, "HELD_WORDS", 3)
    got = {r.word: r.n for r in spelling.counted(df, least_n=1).collect()}
    assert got == {w: n for w, n in want.items() if len(w) >= 6}
    assert spelling.variants(spelling.counted(empty)).count() == 0


def test_query(spark, sf, documents):
    import re
    words = Counter()
    for r in documents.collect():
        for run in re.findall("[A-Za-zÀ-ÿ]+", r.text or ""):
            run = run.encode().lower().decode()
            h = zlib.crc32(f"{r.doc_id}:{run}".encode())
            words[run if h % 199 else run[:h % len(run)] + run[h % len(run) + 1:]] += 1
    words = {w: n for w, n in words.items() if len(w) >= 6 and n >= 5}
    got = QUERIES["op13_spelling_variants"](spark, sf).select("word", "form", "root", "n", "n_near", "form_n")
    assert {tuple(r) for r in got.collect()} == by_hand(words)
