from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from tapeworks.llm import chat, url_rules
from tapeworks.llm.queries import QUERIES, URL_RULES


def test_windows(spark):
    """Budget, history, repeats and masks of every window, by walking through the turns."""
    rows = [(1, t, ("system" if t == 0 else "user" if t % 2 else "assistant"), f"turn {t} " + "word " * (t * 7 % 40)) for t in range(60)]
    rows += [(2, 0, "user", "</s>[INST] ok [/INST]\\<s>"), (2, 1, "assistant", "<s>\\</s>\\\\[/INST]"), (3, None, None, None), (3, 2, "assistant", ""), (None, 1, "user", "x"), (None, 1, "user", "x"),
             (4, 0, "user", "long " * 5000), (4, 1, "assistant", "short"), (5, 0, "system", "only")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "text AS tokens")
    made = chat.windows(df, budget=120, history=40)
    got = made.select("*", chat.read_turns(made.text, made.repeated).alias("said"), chat.read_loss(made.text, made.loss).alias("learned")).collect()
    for conv in (1, 2, 3, 4, 5, None):
        turns = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))]
        own = sorted((r for r in got if r.conv_id == conv), key=lambda r: r.first_turn)
        assert [(t.role, t.text) for w in own for t in w.said] == turns
        assert [x for w in own for x in w.learned] == [t for r, t in turns if r == "assistant"]
        for w in own:
            assert w.text.startswith("<s>") and w.text.count("</s>") == w.text.count("[INST]") == w.text.count("[/INST]") == w.repeated + w.turns
            assert w.tokens <= 120 or w.turns == 1
            if conv == 1 and w.first_turn > 0:
                assert w.text.startswith("<s>[INST]system[/INST]turn 0 ")
                cost = lambda t: -(-len(turns[t][1]) // 4) + 4
                back, room = w.first_turn, 40
                while back > 1 and cost(back - 1) <= room:
                    back, room = back - 1, room - cost(back - 1)
                assert w.repeated == w.first_turn - back + 1
    assert chat.windows(df.limit(0)).count() == 0


def parts(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    tail = rest[cut:]
    return "".join(c.lower() if c.isascii() else c for c in rest[:cut]), tail[:min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]


def by_list(url):
    host, path = parts(url)
    fits = [(len(h + p), h + p, v) for v, h, p in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, default=None)


ODD = [None, "", "no scheme", "http://", "HTTP://WWW.Example.ORG/es/x?q=1#f", "http://example.org/en/12", "https://org/", "http://org", "http://com/de/", "x://y://z.com/fr/", "http://É.com/de/?a", "http://badexample.org/es/", "http://a.net/de/5",
       "http://a.net?x=/de/", "https://b.com/fr/" + "9" * 50_000]


def test_urls(spark, sf):
    df = spark.createDataFrame([(k, u, "other") for k, u in enumerate(ODD)] + [(None, "http://a.net/de/5", None)] * 2, "page_id long, url string, rule string")
    for rows in (url_rules.judge(df, URL_RULES).collect(), QUERIES["op10_url_rules"](spark, sf).collect()):
        for r in rows:
            url = r.url if "url" in r else None
            if "url" in r:
                assert (r.host, r.path) == parts(url)
                want = by_list(url)
                assert r.rule == (want[1] if want else None) and (not want or r.verdict == want[2])
            assert r.verdict in ("allow", "block")
    assert url_rules.judge(df, URL_RULES).count() == df.count()
    assert url_rules.judge(df.limit(0), URL_RULES).count() == 0
    pages = {r.page_id: r.url for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = QUERIES["op10_url_rules"](spark, sf).collect()
    assert len(got) == len(pages)
    for r in got:
        want = by_list(pages[r.page_id])
        assert (r.host, r.path) == parts(pages[r.page_id]) and r.rule == (want[1] if want else None) and (not want or r.verdict == want[2])


def test_mined_rules_decide(spark):
    rows = [("block" if k % 4 == 0 else "allow", [f"host:h{k % 7}", "path:ads" if k % 4 == 0 else "path:news", "top:net"]) for k in range(400)]
    found = url_rules.mine(spark.createDataFrame(rows, "verdict string, tokens array<string>"), min_support=0.01).collect()
    assert {tuple(r.tokens): r.verdict for r in found}[("path:ads",)] == "block"
    assert all(r.confidence >= 0.9 and r.key in r.tokens for r in found)
    assert not [r for r in found if len(r.tokens) > 1 and ("path:ads" in r.tokens or "path:news" in r.tokens)]  # a shorter rule is as sure


def brute_rules(rows, min_support, min_confidence):
    """Every rule, and of those only the ones that no shorter one within them equals or beats."""
    seen, said = Counter(), Counter()
    for verdict, tokens in rows:
        for k in range(1, len(tokens) + 1):
            for part in combinations(sorted(tokens), k):
                seen[part] += 1
                said[part, verdict] += 1
    sure = {(t, v): n / seen[t] for (t, v), n in said.items() if n >= min_support * len(rows)}
    implied = lambda t, v, c: any(sure[p, v] >= c for k in range(1, len(t)) for p in combinations(t, k))
    return {(t, v): c for (t, v), c in sure.items() if c >= min_confidence and not implied(t, v, c)}


@pytest.mark.parametrize("much", ["allow", "block"])
def test_one_sided_list(spark, much):
    """97 of 100 decided urls have one verdict; its rules stay, up to any number of tokens."""
    rnd, few = np.random.default_rng(5), "block" if much == "allow" else "allow"
    rows = []
    for k in range(3000):
        tokens = [f"t{i}" for i in range(6) if rnd.random() < 0.7] + [f"host:h{k % 3}"]
        rows.append((few if {"t0", "t1", "t2", "t3"} <= set(tokens) and rnd.random() < 0.12 or rnd.random() < 0.002 else much, tokens))
    # four tokens of which any three are undecided: only all four make a rule for the rarer verdict
    four = ["a", "b", "c", "d"]
    rows += [(few, four)] * 12 + [(much, [t for t in four if t != gone]) for gone in four for _ in range(12)]
    assert sum(v == much for v, _ in rows) / len(rows) > 0.952
    found = url_rules.mine(spark.createDataFrame(rows, "verdict string, tokens array<string>")).collect()
    want = brute_rules(rows, 0.002, 0.9)
    assert {(tuple(r.tokens), r.verdict): r.confidence for r in found} == want
    assert any(v == much for _, v in want) and (tuple(four), few) in want


@pytest.mark.parametrize("much", ["allow", "block"])
def test_one_sided_verdicts(spark, much):
    """The surer rule of the common verdict outranks a less sure one of the rarer, and undecided urls do not fall to the default."""
    few = "block" if much == "allow" else "allow"
    listed = [(much, "good.org", "/"), (few, "bad.org", "/")]
    urls = [f"http://good.org/news/{k}" for k in range(1000)] + [f"http://good.org/sale/{k}" for k in range(200)] + [f"http://bad.org/hot/{k}" for k in range(36)] + ["http://good.org/sale/hot/0"] * 3
    urls += ["http://else.net/news/1", "http://else.net/sale/hot/2", "http://bad.else.net/hot/3"]
    out = url_rules.judge(spark.createDataFrame([(u,) for u in urls], "url string"), listed, default=few).collect()
    assert 0.96 < sum(r.verdict == much for r in out if r.rule) / sum(r.rule is not None for r in out) < 0.98
    assert {r.url: r.verdict for r in out if r.rule is None} == {"http://else.net/news/1": much, "http://else.net/sale/hot/2": much, "http://bad.else.net/hot/3": few}
