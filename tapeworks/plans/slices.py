"""Ordered scans that never put a whole key into one task.

A window ``PARTITION BY symbol`` sends every row of a symbol to one task.  When
one symbol owns a third of the tape that task is the job.  Everything ordered
in this package is built on *slices* instead:

* ``slice_rows`` range-partitions on (key, order), so a hot key is cut into as
  many slices as its share of the rows asks for, and freezes the cut with a
  checkpoint (range bounds are sampled, so two passes need the same cut).
* ``running`` computes prefix sums / last / first / min / max: a local window
  per (slice, key), one total per (slice, key), a prefix over the totals, and a
  join back.  Only a key that continues from an earlier slice needs a carry,
  and a slice has at most one such key, so the carry table has at most one row
  per slice: that bound is what makes broadcasting it safe.
* ``asof`` is a union of both sides followed by ``running`` "last".
* ``blocks`` is for frames over tables with a dense index: fixed-size blocks
  with a replicated halo, no sampling needed.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeworks.session import ensure_checkpoint_dir

SLICE = "_slice"
TARGET_SLICE_BYTES = 256 << 20
MAX_SLICES = 200_000
FROZEN_SLICE_ROWS = 500_000


def slice_count(df: DataFrame) -> int:
    """One slice per core (at most the shuffle partitions), more when the input is large.

    Only files have a measured size; the statistics of derived tables are
    products of guesses.  A checkpointed input counts by its partitions.
    """
    spark = df.sparkSession
    n = min(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    file_bytes = 0
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        kind = leaf.getClass().getSimpleName()
        if kind == "LogicalRelation":
            file_bytes += int(str(leaf.stats().sizeInBytes()))
        elif kind == "LogicalRDD":
            n = max(n, leaf.rdd().getNumPartitions())
    return min(MAX_SLICES, max(n, -(-file_bytes // TARGET_SLICE_BYTES)))


def slices_of(df: DataFrame) -> int:
    """Number of slices of a frame that ``slice_rows`` made: the partitions of its checkpoint."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    kinds = [leaves.apply(i) for i in range(leaves.size())]
    return max([1, *(x.rdd().getNumPartitions() for x in kinds if x.getClass().getSimpleName() == "LogicalRDD")])  # an empty store has no partitions


def slice_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int | None = None,
               freeze: bool = False) -> DataFrame:
    """Cut ``df`` into ordered slices of similar size; adds the slice number.

    Sampling the range bounds runs the input once more.  ``freeze`` stores it
    first, which pays off when it is small and dear (filtered candidates).

    ``order`` must end in a unique column so that ties never force a slice to
    grow and every re-computation sees the same sequence.
    """
    ensure_checkpoint_dir(df.sparkSession)
    cols = [F.col(c) for c in (*keys, *order)]
    if freeze:
        df = df.checkpoint(eager=True)
        n = n or min(MAX_SLICES, -(-df.count() // FROZEN_SLICE_ROWS) or 1)
    return (df.repartitionByRange(n or slice_count(df), *cols)
            .sortWithinPartitions(*cols)
            .withColumn(SLICE, F.spark_partition_id())
            .checkpoint(eager=True))


def _combine(op: str, carry: Column, local: Column) -> Column:
    if op == "sum":
        return F.coalesce(carry + local, local, carry)
    if op == "last":
        return F.coalesce(local, carry)
    if op == "first":
        return F.coalesce(carry, local)
    return (F.greatest if op == "max" else F.least)(carry, local)


_WINDOW_AGG = {
    "sum": F.sum, "max": F.max, "min": F.min,
    "last": lambda c: F.last(c, ignorenulls=True),
    "first": lambda c: F.first(c, ignorenulls=True),
}


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str],
            specs: Mapping[str, tuple], *, reverse: bool = False, n: int | None = None) -> DataFrame:
    """Prefix aggregates per key in ``order`` (or in the opposite direction).

    ``specs`` maps an output name to ``(op, expr)`` or ``(op, expr, "exclusive")``
    with op one of sum, last, first, min, max.  Nulls are skipped.  A frame that
    is already sliced on the same key and order is reused.
    """
    keys, order = list(keys), list(order)
    sliced = df if SLICE in df.columns else slice_rows(df, keys, order, n)
    inputs = {f"_in_{name}": spec[1] for name, spec in specs.items()}
    sliced = sliced.withColumns(inputs)
    direction = [F.col(c).desc() if reverse else F.col(c).asc() for c in order]
    local = Window.partitionBy(SLICE, *keys).orderBy(*direction)
    upto, before = local.rowsBetween(Window.unboundedPreceding, 0), local.rowsBetween(Window.unboundedPreceding, -1)

    at = F.struct(*order)
    totals = []
    for name, (op, *_) in specs.items():
        c = F.col(f"_in_{name}")
        if op in ("last", "first"):
            latest = (op == "last") != reverse
            pick = F.max_by if latest else F.min_by
            totals.append(pick(c, F.when(c.isNotNull(), at)).alias(f"_c_{name}"))
        else:
            totals.append(_WINDOW_AGG[op](c).alias(f"_c_{name}"))
    along = Window.partitionBy(*keys).orderBy(F.col(SLICE).desc() if reverse else F.col(SLICE).asc())
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)
    carry = (sliced.groupBy(SLICE, *keys).agg(*totals)
             .select(SLICE, *keys, F.row_number().over(along).alias("_nth"),
                     *[_WINDOW_AGG[spec[0]](F.col(f"_c_{name}")).over(earlier).alias(f"_c_{name}")
                       for name, spec in specs.items()])
             .where("_nth > 1").drop("_nth"))

    # one task a slice, however many shuffle partitions the session has; the totals above are summed before they move
    out = sliced.repartitionById(slices_of(sliced), F.col(SLICE)).withColumns({
        f"_l_{name}": _WINDOW_AGG[spec[0]](F.col(f"_in_{name}")).over(before if "exclusive" in spec[2:] else upto)
        for name, spec in specs.items()})
    out = out.join(F.broadcast(carry), [SLICE, *keys], "left")
    out = out.withColumns({name: _combine(spec[0], F.col(f"_c_{name}"), F.col(f"_l_{name}"))
                           for name, spec in specs.items()})
    return out.drop(*inputs, *[f"_l_{n_}" for n_ in specs], *[f"_c_{n_}" for n_ in specs], *([] if SLICE in df.columns else [SLICE]))


def previous(df: DataFrame, keys: Sequence[str], order: Sequence[str], cols: Mapping[str, str | Column],
             *, reverse: bool = False) -> DataFrame:
    """Values of the row before (after, with ``reverse``); nulls are values here."""
    fields = [(F.col(c) if isinstance(c, str) else c).alias(name) for name, c in cols.items()]
    out = running(df, keys, order, {"_row_before": ("last", F.struct(*fields), "exclusive")}, reverse=reverse)
    return out.withColumns({name: F.col(f"_row_before.{name}") for name in cols}).drop("_row_before")


def dense_index(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "idx") -> DataFrame:
    """Position of every row within its key, from 0, without a whole-key window."""
    out = running(df, keys, order, {name: ("sum", F.lit(1).cast("long"))})
    return out.withColumn(name, F.col(name) - 1)


def asof(left: DataFrame, right: DataFrame, keys: Sequence[str], *, left_ts: str, right_ts: str,
         left_id: str, right_id: str, right_cols: Sequence[str], strict: bool = False,
         forward: bool = False) -> DataFrame:
    """Latest right row per key with ``right_ts <= left_ts`` (``<`` when strict).

    With ``forward`` the first right row at or after the left time is taken.
    Ties among right rows go to the largest ``right_id`` (smallest, forward).
    Left rows without a match keep nulls.
    """
    keys = list(keys)
    right_first = strict == forward
    same = left.schema[left_id].dataType == right.schema[right_id].dataType  # ids keep their own type, texts included

    def tie(c: str) -> Column:
        return F.col(c) if same else F.col(c).cast("long")
    lt = left.select(*keys, F.col(left_ts).alias("_t"), F.lit(1 if right_first else 0).alias("_side"),
                     tie(left_id).alias("_id"),
                     F.struct(*[c for c in left.columns if c not in keys]).alias("_left"))
    payload = F.struct(*right_cols)
    rt = right.select(*keys, F.col(right_ts).alias("_t"), F.lit(0 if right_first else 1).alias("_side"),
                      tie(right_id).alias("_id"), payload.alias("_right"))
    both = lt.unionByName(rt, allowMissingColumns=True)
    hit = running(both, keys, ["_t", "_side", "_id"], {"_hit": ("last", F.col("_right"))}, reverse=forward)
    return (hit.where(F.col("_left").isNotNull())
            .select(*keys, *[F.col(f"_left.{c}").alias(c) for c in left.columns if c not in keys],
                    *[F.col(f"_hit.{c}").alias(c) for c in right_cols]))


def blocks(df: DataFrame, index: str, halo: int, size: int | None = None) -> DataFrame:
    """Fixed-size blocks of a dense index, each preceded by ``halo`` earlier rows.

    Adds ``_block`` and ``_home``; windows then partition by (key, _block) and
    the caller keeps the ``_home`` rows.  A frame of up to halo+1 rows ending at
    a home row is complete inside its block.
    """
    size = size or max(4096, 16 * halo)
    if halo > size:
        raise ValueError("halo must not exceed the block size")
    block = F.floor(F.col(index) / size).cast("long")
    near_end = F.pmod(F.col(index), F.lit(size)) >= size - halo
    both = F.array(F.struct(block.alias("_block"), F.lit(True).alias("_home")),
                   F.struct((block + 1).alias("_block"), F.lit(False).alias("_home")))
    home = F.slice(both, 1, 1)
    return df.withColumn("_b", F.explode(F.when(near_end, both).otherwise(home) if halo else home)) \
             .select("*", "_b._block", "_b._home").drop("_b")
