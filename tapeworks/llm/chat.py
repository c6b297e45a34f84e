"""Chat formatting in windows of a token budget, with a mask of the text to learn.

A conversation is cut at turn borders only.  Prefix sums of the turns' tokens lay its turns on
a line, which is ruled into cells of the length that the budget leaves beside the system turn
and the history.  The turns that lie inside one cell are a window; a turn that crosses into
another cell is a window of its own.  So no window's new turns exceed a cell, unless a single
turn does, and every turn knows its window from its own prefix sum: nothing is walked through
in order.  Each window starts with the system turn (if the conversation opens with one) and the
turns before it that fit the history budget, both as repeats.  The mask covers the texts of
assistant turns where they are new, so each is learned once.

Template: ``<s>`` then, for each turn, ``[INST]role[/INST]text</s>``.  Where a role or text
holds one of these strings, a backslash is put after its first character, and backslashes are
doubled; taking away one backslash and keeping what follows restores the text.

Prefix sums run in two steps (within blocks of turn numbers, then over the blocks), so a
conversation of any length is spread over tasks.  Defined cases: null texts and roles are
empty; null turns come first; equal turn numbers are ordered by role and text, repeated rows
are turns of their own; rows with a null id form one conversation; a system turn longer than
the budget leaves cells of the history's length, and windows then exceed the budget, as does a
single longer turn (``tokens`` tells); only the four named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeworks.llm.shared import stored

OPEN, ROLE, SAID, END = "<s>", "[INST]", "[/INST]", "</s>"
CONTROL = r"(\\|<(?=/?s>)|\[(?=/?INST\]))"
MARK_TOKENS = 4
BLOCK = 256


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, "$1\\\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def text_tokens(text: Column) -> Column:
    """A turn's tokens where no tokenizer's counts are given: four bytes a token, and the template's marks."""
    return F.ceil(F.octet_length(text) / 4) + MARK_TOKENS


def turns(df: DataFrame, tokens: Column | None = None) -> DataFrame:
    """Every row with its place in the conversation, its start on the token line, and the conversation's system turn."""
    rows = df.select(F.struct("conv_id").alias("conv"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("tokens", (text_tokens(F.col("text")) if tokens is None else tokens).cast("long")).withColumn("block", F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(1 << 62))))
    within = Window.partitionBy("conv", "block").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    rows = stored(rows.withColumn("n", F.row_number().over(within) - 1).withColumn("upto", F.sum("tokens").over(within)).drop("turn"), "turns")
    blocks = rows.groupBy("conv", "block").agg(F.count("*").alias("rows"), F.sum("tokens").alias("total"), F.max(F.when(F.col("n") == 0, F.struct("role", "tokens"))).alias("head"))
    over = Window.partitionBy("conv").orderBy("block")
    before = over.rowsBetween(Window.unboundedPreceding, -1)
    head = F.first("head").over(over)
    system = F.when(head["role"] == "system", head["tokens"]).otherwise(F.lit(0).cast("long"))
    blocks = blocks.select("conv", "block", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"), F.coalesce(F.sum("total").over(before), F.lit(0)).alias("before"), system.alias("system"))
    placed = rows.join(blocks, ["conv", "block"])
    at = F.col("rows_before") + F.col("n")
    alone = (at == 0) & (F.col("system") > 0)
    return placed.select("conv", at.alias("at"), "role", "text", alone.alias("is_system"), "system", "tokens",
                         F.when(alone, F.lit(0).cast("long")).otherwise(F.col("before") + F.col("upto") - F.col("tokens") - F.col("system")).alias("start"))


def windows(df: DataFrame, budget: int = 1024, history: int = 256, tokens: Column | None = None) -> DataFrame:
    """(conv_id, first_turn, text, loss, repeated, turns, tokens): ``loss`` are [from, to) offsets in characters, ``repeated`` turns come first."""
    long = lambda c: c.cast("long")
    cell = F.greatest(F.lit(budget - history).cast("long") - F.col("system"), F.lit(max(history, 1)).cast("long"))
    seen = turns(df, tokens).withColumn("cell", cell)
    size = F.when(F.col("is_system"), 0).otherwise(F.col("tokens"))
    seen = (seen.withColumn("own", long(F.floor(F.col("start") / F.col("cell"))))
            .withColumn("crosses", F.floor(F.greatest(F.col("start") + size - 1, F.col("start")) / F.col("cell")) > F.col("own")))
    seen = stored(seen, "placed_turns")
    spans = seen.groupBy("conv", "own", "crosses").agg(F.min("at").alias("first"), F.min("start").alias("from"), F.max("system").alias("with_system"))
    reach = seen.select("*", F.explode(F.sequence(F.col("own"), long(F.floor((F.col("start") + history) / F.col("cell"))))).alias("in_cell"))
    to = spans.select(F.col("conv").alias("of"), F.col("own").alias("to_cell"), F.col("crosses").alias("to_crosses"), "first", "from")
    is_new = (F.col("own") == F.col("to_cell")) & (F.col("crosses") == F.col("to_crosses"))
    is_history = (F.col("at") < F.col("first")) & (F.col("start") >= F.col("from") - history) & ~F.col("is_system")
    pairs = reach.join(to, (F.col("conv") == F.col("of")) & (F.col("in_cell") == F.col("to_cell"))).where(is_new | is_history).select("conv", "first", "at", is_new.alias("new"), "role", "text", "tokens")
    opening = seen.where("is_system").select("conv", "at", "role", "text", "tokens")
    again = opening.join(spans.where((F.col("first") > 0) & (F.col("with_system") > 0)).select("conv", "first"), "conv").select("conv", "first", "at", F.lit(False).alias("new"), "role", "text", "tokens")
    head = F.concat(F.lit(ROLE), escape(F.col("role")), F.lit(SAID))
    entry = F.struct("at", "new", ((F.col("role") == "assistant") & F.col("new")).alias("target"), "tokens", F.length(head).cast("long").alias("skip"), F.concat(head, escape(F.col("text"))).alias("piece"))
    grouped = pairs.unionByName(again).groupBy("conv", "first").agg(F.array_sort(F.collect_list(entry)).alias("entries"))

    def follow(state, e):
        ends = state["at"] + F.length(e["piece"])
        span = F.struct((state["at"] + e["skip"]).alias("from"), ends.alias("to"))
        return F.struct((ends + len(END)).alias("at"), F.when(e["target"], F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"))

    none = F.array().cast("array<struct<from:bigint,to:bigint>>")
    pieces = F.transform("entries", lambda e: F.concat(e["piece"], F.lit(END)))
    return grouped.select(F.col("conv.conv_id").alias("conv_id"), F.col("first").alias("first_turn"), F.concat(F.lit(OPEN), F.array_join(pieces, "")).alias("text"),
                          F.aggregate("entries", F.struct(F.lit(len(OPEN)).cast("long").alias("at"), none.alias("spans")), follow)["spans"].alias("loss"),
                          F.size(F.filter("entries", lambda e: ~e["new"])).alias("repeated"), F.size(F.filter("entries", lambda e: e["new"])).alias("turns"),
                          F.aggregate("entries", F.lit(0).cast("long"), lambda n, e: n + e["tokens"]).alias("tokens"))


def read_turns(window_text: Column, repeated: Column) -> Column:
    """The new turns of a window's text, as structs of role and text."""
    parts = F.split(F.substring(window_text, len(OPEN) + 1, 1 << 30), END)
    new = F.filter(parts, lambda p, k: (k >= repeated) & (p != ""))
    body = F.transform(new, lambda p: F.substring(p, len(ROLE) + 1, 1 << 30))
    role = lambda p: F.substring_index(p, SAID, 1)
    return F.transform(body, lambda p: F.struct(unescape(role(p)).alias("role"), unescape(F.substring(p, F.length(role(p)) + len(SAID) + 1, F.length(p))).alias("text")))


def read_loss(window_text: Column, loss: Column) -> Column:
    """The texts under the mask, as they were written."""
    return F.transform(loss, lambda s: unescape(F.substring(window_text, (s["from"] + 1).cast("int"), (s["to"] - s["from"]).cast("int"))))
