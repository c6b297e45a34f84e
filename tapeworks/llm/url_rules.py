"""URL filtering by rules: a given list, and association rules mined from the urls the list decides.

A url becomes a set of tokens (scheme, host labels, path words with digits folded, file
ending, query keys, fragment).  The urls that the list decides are labelled transactions.
Spark's FP-growth mines the token combinations that go with a verdict; support and confidence
decide which are rules, however long or common, and a rule is dropped only if a shorter one of
the same verdict that it contains is at least as sure.  That is found level by level: a set
takes over the surest confidence within the sets that are one token shorter.  The rules are
matched by an inverted index: each is filed under the rarest of its tokens, a url looks up its
own tokens only and checks the rules found there.

Urls repeat the same token sets, so sets are matched once and the verdict is joined back.
The number of rules is bounded by the support (a share of the transactions), not by the data.

Host: after the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; path: from there up
to ``?``, ``#`` or the end.  Defined cases: null urls and urls without ``://`` have an empty
host and path and are judged by default; urls of any length are read whole, and a null
``page_id`` is a row like others; other columns pass through unless their names are
those of the results; an empty table gives an empty result; without decided urls nothing is
mined and the default holds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeworks.llm.shared import small_side, stored

Rule = tuple[str, str, str]  # verdict, host, path prefix
RESULTS = ("host", "path", "rule", "verdict", "mined_rule", "confidence")
VERDICT = "verdict:"


def parts(url: Column) -> tuple[Column, Column, Column]:
    """Host, path and what follows the path."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    tail = F.substring(rest, F.length(host) + 1, F.length(rest))
    path = F.regexp_extract(tail, r"^[^?#]*", 0)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return lower, path, F.substring(tail, F.length(path) + 1, F.length(tail))


def listed(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The longest given rule that fits, as (length, rule, verdict); null if none does.  A rule's host fits its subdomains."""
    fits = [F.when(((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p)), F.struct(F.lit(len(h + p)).alias("size"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")))
            for v, h, p in rules]
    return F.array_max(F.array_compact(F.array(*fits)))


def tokens(url: Column, host: Column, path: Column, more: Column) -> Column:
    """The sorted set of a url's tokens; digits are folded so that numbers do not make every url its own kind."""
    labels = F.split(host, r"\.")
    words = F.filter(F.split(F.regexp_replace(path, r"[0-9]+", "0"), r"[/_.~-]+"), lambda w: w != "")
    keys = F.filter(F.regexp_extract_all(F.substring_index(more, "#", 1), F.lit(r"[?&]([^=&#]+)"), 1), lambda w: w != "")
    named = lambda kind, xs: F.transform(xs, lambda x: F.concat(F.lit(kind + ":"), x))
    scheme = F.array(F.concat(F.lit("scheme:"), F.lower(F.substring_index(url, "://", 1))), F.concat(F.lit("top:"), F.element_at(labels, -1)))
    mark = F.when(F.instr(more, "#") > 0, F.array(F.concat(F.lit("mark:"), F.substring_index(more, "#", -1)))).otherwise(F.array().cast("array<string>"))
    return F.when(host != "", F.array_sort(F.array_distinct(F.concat(scheme, named("host", labels), named("path", words), named("key", keys), mark)))).otherwise(F.array().cast("array<string>"))


def unimplied(found: DataFrame) -> DataFrame:
    """The rows of ``found`` (tokens, verdict, confidence, support) that are surer than every shorter one of their verdict within them.

    All parts of a row must be rows too, as those of a frequent set are: then a part of any size
    is reached over parts that are one token shorter.
    """
    longest = found.agg(F.max(F.size("tokens"))).first()[0] or 0
    kept = level = found.where(F.size("tokens") == 1).withColumn("sure", F.col("confidence"))
    for size in range(2, longest + 1):
        part = found.where(F.size("tokens") == size).select("tokens", "verdict", F.explode(F.transform("tokens", lambda t: F.array_remove("tokens", t))).alias("part"))
        less = level.select(F.col("tokens").alias("part"), "verdict", "sure")
        within = part.join(less, ["part", "verdict"]).groupBy("tokens", "verdict").agg(F.max("sure").alias("within"))
        level = stored(found.join(within, ["tokens", "verdict"]).withColumn("sure", F.greatest("confidence", "within")), "url_rules_level")
        kept = kept.unionByName(level.where(F.col("confidence") > F.col("within")).drop("within"))
    return kept.drop("sure")


def mine(labelled: DataFrame, min_support: float = 0.002, min_confidence: float = 0.9) -> DataFrame:
    """Rules (rule, tokens, verdict, confidence, support, key) from (tokens, verdict); ``key`` is the rarest token."""
    items = labelled.select(F.array_append("tokens", F.concat(F.lit(VERDICT), "verdict")).alias("items"))
    urls = items.count()
    # the rules are read off the sets: those below the confidence are needed too, to find what a rule contains
    sets = stored(FPGrowth(itemsCol="items", minSupport=min_support).fit(items).freqItemsets, "frequent")
    is_verdict = lambda x: F.startswith(x, F.lit(VERDICT))
    split = stored(sets.select(F.array_sort(F.filter("items", lambda x: ~is_verdict(x))).alias("tokens"), F.substring(F.get(F.filter("items", is_verdict), F.lit(0)), len(VERDICT) + 1, 100).alias("verdict"), "freq").where(F.size("tokens") > 0), "split")
    alone = split.where("verdict IS NULL").select("tokens", F.col("freq").alias("all"))
    found = stored(split.where("verdict IS NOT NULL").join(alone, "tokens").select("tokens", "verdict", (F.col("freq") / F.col("all")).alias("confidence"), (F.col("freq") / F.lit(urls)).alias("support")), "mined")
    kept = unimplied(found).where(F.col("confidence") >= min_confidence)
    single = alone.where(F.size("tokens") == 1).select(F.col("tokens")[0].alias("token"), F.col("all").alias("freq"))
    rarest = (kept.select("*", F.explode("tokens").alias("token")).join(single, "token")
              .groupBy("tokens", "verdict", "confidence", "support").agg(F.min_by("token", F.struct("freq", "token")).alias("key")))
    return stored(rarest.withColumn("rule", F.array_join("tokens", " ")), "url_rules")


def judged(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """The surest mined rule of every token set that any rule matches; then the best supported, the longest, the first by name."""
    asked = sets.select("tokens", F.explode("tokens").alias("key"))
    index = rules.select("key", F.col("tokens").alias("needs"), "verdict", "confidence", "support", "rule")
    hits = asked.join(small_side(index, "key", "verdict", "rule"), "key").where(F.size(F.array_except("needs", "tokens")) == 0)
    best = F.max_by(F.struct("verdict", "confidence", "rule"), F.struct("confidence", "support", F.size("needs"), "rule"))
    return hits.groupBy("tokens").agg(best.alias("best")).select("tokens", F.col("best.verdict").alias("mined"), F.col("best.rule").alias("mined_rule"), F.col("best.confidence").alias("confidence"))


def judge(pages: DataFrame, rules: Sequence[Rule], url: str = "url", default: str = "allow", min_support: float = 0.002, min_confidence: float = 0.9) -> DataFrame:
    """``pages`` with host, path, the given rule that fits, the verdict, and the mined rule that decided where none does."""
    host, path, more = parts(F.col(url))
    seen = pages.select(*(F.col(f"`{c}`") for c in pages.columns if c not in RESULTS), host.alias("host"), path.alias("path"), tokens(F.col(url), host, path, more).alias("_tokens"))
    seen = seen.withColumn("_listed", listed(F.col("host"), F.col("path"), rules))
    sets = stored(seen.groupBy(F.col("_tokens").alias("tokens"), F.col("_listed.verdict").alias("verdict")).agg(F.count("*").alias("urls")), "token_sets")
    decided = sets.where(F.col("verdict").isNotNull())
    # FP-growth counts transactions, so a set stands for its urls; sets of one kind are dealt in steps to keep a hot one in many rows
    steps = decided.select("tokens", "verdict", F.explode(F.expr("sequence(0L, (urls - 1) div 1024)")).alias("step"), "urls")
    labelled = steps.select("tokens", "verdict", F.explode(F.expr("array_repeat(0, cast(least(1024L, urls - step * 1024) as int))"))).drop("col")
    if decided.isEmpty():
        verdicts = sets.select("tokens", F.lit(None).cast("string").alias("mined"), F.lit(None).cast("string").alias("mined_rule"), F.lit(None).cast("double").alias("confidence")).where(F.lit(False))
    else:
        verdicts = stored(judged(sets.where(F.col("verdict").isNull()).select("tokens").distinct(), mine(labelled, min_support, min_confidence)), "judged")
    both = seen.join(small_side(verdicts, "mined", "mined_rule", F.array_join("tokens", " ")).withColumnRenamed("tokens", "_of"), F.col("_listed").isNull() & (F.col("_tokens") == F.col("_of")), "left")
    mine_says = F.coalesce("mined", F.lit(default))
    return both.select(*(F.col(f"`{c}`") for c in pages.columns if c not in RESULTS), "host", "path", F.col("_listed.rule").alias("rule"), F.coalesce("_listed.verdict", mine_says).alias("verdict"), "mined_rule", "confidence")
