"""Mixing sources to target weights by capped water-filling.

A source's share of the wanted total is its weight; no source may give more than ``cap``
times its own size.  Where a share would be more, the source is clamped there and the excess
is dealt to the others in proportion to their weights, until no share is above its cap.
The sources in the order of cap / weight are clamped one after the other, so the fixed point
of that process is found by one pass of prefix sums over the table of sources.

Every row of a source is then repeated ``whole`` times, and the missing fraction is sampled:
rows in a seeded order (a digest of seed, id and text) up to a cut that brings the source as
near to its target as whole rows allow.  The cut is found in two steps, by sums per digest
prefix and then among the rows of one prefix, so no source is ever sorted as a whole.

Defined cases: a null text has no words; null sources form one source, last in order; rows
equal in id and text share their digest and are taken together; sources without words have
target 0; a text of any length is taken whole or not; an empty table gives an empty plan.  All columns pass through ``mixed``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeworks.llm.shared import small_side, stored

WORD = r"[^\x20\x09-\x0D]+"
SEED = "mix-1"
PREFIX = 3  # hex digits of the digest by which a source is summed first


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def place(seed: str, id: str, text: str) -> Column:
    """Where a row stands in the seeded order."""
    return F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col(id).cast("string"), F.lit("")), F.coalesce(F.col(text), F.lit(""))))


def targets(sizes: DataFrame, weights: Sequence[int], share: float, cap: float) -> DataFrame:
    """(source, source_size) with ``target``; one row a source."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    deal = F.array(*(F.lit(w) for w in weights))
    weighed = sizes.withColumn("weight", F.get(deal, ((F.row_number().over(order) - 1) % len(weights)).cast("int")))
    rise = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    filled = (weighed.withColumn("most", F.col("source_size") * F.lit(cap))
              .withColumn("clamped", F.coalesce(F.sum("most").over(rise.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
              .withColumn("open", F.sum("weight").over(rise.rowsBetween(0, Window.unboundedFollowing)))
              .withColumn("level", (F.sum("source_size").over(Window.partitionBy()) * F.lit(share) - F.col("clamped")) / F.col("open")))
    free = filled.withColumn("level", F.min(F.when(F.col("level") * F.col("weight") <= F.col("most"), F.struct(F.col("most") / F.col("weight"), "level"))).over(Window.partitionBy())["level"])
    return free.select("source", "source_size", F.least(F.coalesce(F.col("level") * F.col("weight"), "most"), "most").alias("target"))


def sized(df: DataFrame, seed: str = SEED, id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(id, source, size, place) of every row: all that planning reads, stored."""
    return stored(df.select(F.col(id).alias("id"), F.col(source).alias("source"), word_count(text).alias("size"), place(seed, id, text).alias("place")), "sized")


def plan(rows: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size, target, whole, cut): one row a source; rows placed up to ``cut`` are taken once more than ``whole``."""
    head = F.substring("place", 1, PREFIX)
    parts = stored(rows.groupBy("source", head.alias("head")).agg(F.sum("size").alias("size")), "heads")
    sizes = parts.groupBy("source").agg(F.sum("size").alias("source_size"))
    aimed = (targets(sizes, weights, share, cap)
             .withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
             .withColumn("need", F.col("target") - F.col("whole") * F.col("source_size")))
    aimed = stored(aimed, "targets")
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    up = Window.partitionBy("source").orderBy("head")
    sums = parts.withColumn("before", F.sum("size").over(up) - F.col("size"))
    edge = (sums.join(aimed, same(sums, aimed)).where((F.col("before") < F.col("need")) & (F.col("need") <= F.col("before") + F.col("size")))
            .select(sums["source"].alias("at_source"), sums["head"].alias("at_head"), "before", "need"))
    near = (rows.join(edge, F.col("source").eqNullSafe(F.col("at_source")) & (head == F.col("at_head")))
            .groupBy("source", "place").agg(F.sum("size").alias("size"), F.first("before").alias("before"), F.first("need").alias("need")))
    along = Window.partitionBy("source").orderBy("place")
    steps = near.withColumn("upto", F.col("before") + F.sum("size").over(along))
    error = F.abs(F.col("upto") - F.col("need"))
    skip = F.min(F.struct(F.lit(None).cast("string").alias("place"), (F.col("need") - F.col("before")).alias("off")))["off"]
    best = steps.groupBy("source").agg(F.min_by("place", F.struct(error, "place")).alias("last"), F.min(error).alias("off"), skip.alias("none"), F.any_value("before").alias("before"))
    # taking none of the rows of that prefix may be nearer still: then the cut lies just before it
    cut = best.select(F.col("source").alias("of"), F.when(F.col("off") < F.col("none"), F.col("last")).otherwise(F.substring("last", 1, PREFIX)).alias("cut"))
    full = aimed.join(cut, aimed["source"].eqNullSafe(cut["of"]), "left")
    return stored(full.select("source", "source_size", "target", "whole", "cut"), "plan")


def repeats(rows: DataFrame, planned: DataFrame) -> DataFrame:
    """``rows`` (with ``source`` and ``place``) and the plan's columns, with how often the mix takes each row as ``times``."""
    each = planned.withColumnRenamed("source", "of")
    both = rows.join(small_side(each, "of", "cut"), rows["source"].eqNullSafe(each["of"]), "left").drop("of")
    return both.withColumn("times", F.coalesce("whole", F.lit(0).cast("long")) + F.when(F.col("place") <= F.col("cut"), 1).otherwise(0))


def mixed(df: DataFrame, planned: DataFrame, seed: str = SEED, id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``df`` with each row as often as the mix takes it; rows taken no time are left out."""
    rows = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), F.col(source).alias("source"), place(seed, id, text).alias("place"))
    taken = repeats(rows, planned).where(F.col("times") > 0)
    return taken.select("row", F.explode(F.array_repeat(F.lit(0), F.col("times").cast("int")))).select("row.*")
