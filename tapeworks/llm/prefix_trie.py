"""Prefix trie of conversations from sorted sequences and their common prefixes.

Conversations are sorted as sequences of turns, so the members of a trie node - all that begin
with the same turns - are an interval of the order, and two neighbours' longest common prefix
(LCP) tells where intervals end.  Every prefix of every conversation is a candidate node: with
a sparse table of LCP minima it finds, by two independent binary searches, how far to the left
and to the right its prefix is shared.  The candidate at the left end of its interval stands
for the node.  Nothing is walked in order and there is no stack.

What a node sums up adds over its members once each conversation knows its LCP with both
neighbours: a conversation opens the nodes deeper than the LCP before it, and closes a childless
node if the conversation after it does not contain all its turns.  So the order is cut into
slices, each slice treats its rows alone, and only nodes that reach over a slice's border (at
most one path at either end) are put together by grouping on their prefix's digest.  A first
turn that a third of all conversations share, or a third that are equal, is cut like any other.

A conversation is one row of 16-byte digests and lengths, without its texts; a slice is held in
one task.  Members that end at a node are given out as ascending runs, one a slice, so no list
grows with a group.

Defined cases: rows without a conv_id belong to no conversation; a null role or text is empty;
null turns come first; rows of one turn number are ordered by the digest of role and text, and
repeated rows are turns of their own; conversations without turns are members of the root
alone; an empty table has no nodes; other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeworks.llm.shared import small_side, stored
from tapeworks.plans.slices import SLICE, slice_rows

DIGEST_BYTES = 16
PARTS = "slice int, depth int, conv_id long, edge binary, parent_conv_id long, parent_edge binary, n_convs long, n_children long, n_leaves long, saved_tokens long, ends array<bigint>"


def turn_digest() -> Column:
    """Role and text of a turn; the role's length keeps the two apart."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    return F.unhex(F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * DIGEST_BYTES))


def sequences(df: DataFrame) -> DataFrame:
    """(conv_id, turns): every conversation's turns in order, as structs of digest and number of code points."""
    rows = df.where("conv_id IS NOT NULL").select("conv_id", "turn", turn_digest().alias("digest"), F.coalesce(F.length("text"), F.lit(0)).alias("chars"))
    entry = F.struct(F.col("turn").isNotNull().alias("known"), "turn", "digest", "chars")
    return rows.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(entry)), lambda e: F.struct(e["digest"].alias("digest"), e["chars"].alias("chars"))).alias("turns"))


def rebuilt(convs: DataFrame, group: int = 100, most: int = 6) -> DataFrame:
    """Conversations that open with the first h turns of their group's first conversation, h = crc32(id) mod ``most``, and go on with their own after h."""
    ids = convs.withColumns({"lead": F.col("conv_id") - F.col("conv_id") % group, "h": (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")})
    heads = convs.select(F.col("conv_id").alias("lead"), F.slice("turns", 1, most).alias("head"))
    both = ids.join(heads, "lead", "left")
    none = F.slice("turns", 1, 0)
    return both.select("conv_id", F.concat(F.coalesce(F.slice("head", F.lit(1), F.col("h")), none), F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1)))).alias("turns"))


def sparse_table(values: np.ndarray) -> list[np.ndarray]:
    """Minima of all stretches of 1, 2, 4, ... values, by their first place."""
    levels, step = [values], 1
    while 2 * step <= len(values):
        levels.append(np.minimum(levels[-1][:-step], levels[-1][step:]))
        step *= 2
    return levels


def extents(lcp: np.ndarray, at: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last row that share ``depth`` turns with row ``at``; ``lcp[i]`` is of rows i - 1 and i, ``lcp[0]`` is not looked at."""
    left, right = at.copy(), at.copy()
    for k, least in reversed(list(enumerate(sparse_table(lcp)))):
        step = 1 << k
        wide = (left >= step) & (least[np.clip(left - step + 1, 0, len(least) - 1)] >= depth)
        left -= step * wide
        wide = (right + step < len(lcp)) & (least[np.clip(right + 1, 0, len(least) - 1)] >= depth)
        right += step * wide
    return left, right


def least_between(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Minimum of ``values[first..last]`` for every pair."""
    out = np.empty(len(first), values.dtype)
    level = np.frexp(last - first + 1)[1] - 1
    for k, least in enumerate(sparse_table(values)):
        at = np.flatnonzero(level == k)
        out[at] = np.minimum(least[first[at]], least[last[at] - (1 << k) + 1])
    return out


def common_prefixes(words: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """LCP of every row with the row before it; 0 for the first."""
    out = np.zeros(len(sizes), np.int64)
    shorter = np.minimum(sizes, np.concatenate([[0], sizes[:-1]]))
    alive, d = np.flatnonzero(shorter > 0), 0
    while len(alive):
        alive = alive[(words[starts[alive] + d] == words[starts[alive - 1] + d]).all(axis=1)]
        d += 1
        out[alive] = d
        alive = alive[shorter[alive] > d]
    return out


def slice_nodes(conv: np.ndarray, sizes: np.ndarray, words: np.ndarray, chars: np.ndarray, lead: int, trail: int, part: int) -> pa.RecordBatch:
    """The nodes of one slice; ``lead`` and ``trail`` are the LCPs with the rows before and after it (-1: none)."""
    n, rows = len(conv), np.arange(len(conv))
    starts = np.cumsum(sizes) - sizes
    lcp = common_prefixes(words, starts, sizes)
    before, after = np.concatenate([[lead], lcp[1:]]), np.concatenate([lcp[1:], [trail]])
    chars_upto = np.concatenate([[0], np.cumsum(chars)])

    def upto(row: np.ndarray, d: np.ndarray) -> np.ndarray:
        """Code points of a row's first d turns."""
        return chars_upto[starts[row] + np.clip(d, 0, sizes[row])] - chars_upto[starts[row]]

    whole = upto(rows, sizes)
    text_sum, opened_sum, closed = (np.concatenate([[0], np.cumsum(x)]) for x in (whole, whole - upto(rows, before), after < sizes))

    # every prefix of every row is a candidate, the empty one included
    row = np.repeat(rows, sizes + 1)
    first = np.cumsum(sizes + 1) - sizes - 1
    depth = np.arange(len(row)) - first[row]
    left, right = extents(lcp, row, depth)
    node = first[left] + depth  # the candidate at the left end stands for the node
    opened = np.flatnonzero((depth > before[row]) & (depth > 0))
    children = np.bincount(node[opened - 1], minlength=len(row))

    keep = np.flatnonzero(left == row)
    row, depth, right = row[keep], depth[keep], right[keep]
    place = np.full(len(node), -1)
    place[keep] = np.arange(len(keep))
    parent = np.where(depth > 0, place[node[keep - 1]], -1)
    members = right - row + 1
    texts = text_sum[right + 1] - text_sum[row] - members * upto(row, depth - 1)
    once = opened_sum[right + 1] - opened_sum[row + 1] + whole[row] - upto(row, np.maximum(before[row], depth - 1))
    least = least_between(conv, row, right)

    edge = ((row == 0) & (lead >= depth)) | ((right == n - 1) & (trail >= depth))
    digest: list[bytes | None] = [None] * len(keep)
    for k in np.flatnonzero(edge).tolist():  # two paths at most; the parent of an edge node is one, and comes before it
        digest[k] = hashlib.sha256(digest[parent[k]] + words[starts[row[k]] + depth[k] - 1].tobytes()).digest() if depth[k] else b"root"
    inner = (parent >= 0) & ~edge[np.maximum(parent, 0)]

    fresh = np.concatenate([[True], (lcp[1:] != sizes[1:]) | (sizes[1:] != sizes[:-1])])  # not equal to the row before
    copies = np.bincount(np.cumsum(fresh) - 1)
    ending = np.where(depth == sizes[row], copies[(np.cumsum(fresh) - 1)[row]], 0)
    columns = [
        pa.array(np.full(len(keep), part, np.int32)), pa.array(depth.astype(np.int32)), pa.array(least), pa.array(digest, pa.binary()),
        pa.array(least[np.maximum(parent, 0)], mask=~inner), pa.array([digest[k] if k >= 0 else None for k in parent.tolist()], pa.binary()),
        pa.array(members), pa.array(children[keep]), pa.array(closed[right + 1] - closed[row]), pa.array(texts - once),
        pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(ending)]).astype(np.int32)), pa.array(conv)),
    ]
    return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in PARTS.split(", ")])


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [b for b in batches if b.num_rows]
    if held:
        whole = pa.Table.from_batches(held).combine_chunks()
        turns = pa.concat_arrays(whole["turns"].chunks)
        sizes = np.diff(np.asarray(turns.offsets, np.int64))
        flat = turns.flatten()
        words = np.frombuffer(b"".join(flat.field("digest").to_pylist()), "<u8").reshape(-1, DIGEST_BYTES // 8)
        at = {c: whole[c][0].as_py() for c in ("lead", "trail", SLICE)}
        yield slice_nodes(np.asarray(whole["conv_id"], np.int64), sizes, words, np.asarray(flat.field("chars"), np.int64), at["lead"], at["trail"], at[SLICE])


def _shared(a: Column, b: Column) -> Column:
    """LCP of two sequences of turns; -1 if one is absent."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x["digest"] == y["digest"], F.lit(False)))
    stop = F.array_position(same, F.lit(False))
    return F.coalesce(F.when(stop == 0, F.size(same)).otherwise(stop - 1), F.lit(-1)).cast("int")


def trie(convs: DataFrame, slices: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes and the members that end at them, of conversations (conv_id, turns).

    Nodes: (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens).
    Ends: (conv_id, depth, run, ids), the ids of a node ascending within a run and over its runs.
    """
    sliced = slice_rows(convs.select("turns", "conv_id"), [], ["turns", "conv_id"], slices)
    key = F.struct("turns", "conv_id")
    along = Window.orderBy(SLICE)
    # one row a slice, so is the broadcast
    borders = sliced.groupBy(SLICE).agg(F.min(key)["turns"].alias("first"), F.max(key)["turns"].alias("last")) \
        .select(SLICE, _shared(F.lag("last").over(along), F.col("first")).alias("lead"), _shared(F.col("last"), F.lead("first").over(along)).alias("trail"))
    parts = stored(sliced.join(F.broadcast(borders), SLICE).select("turns", "conv_id", "lead", "trail", SLICE).mapInArrow(_slices, PARTS), "trie_parts")
    sums = ("n_convs", "n_children", "n_leaves", "saved_tokens")
    edges = stored(parts.where("edge IS NOT NULL").groupBy("edge").agg(F.max("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.max("parent_edge").alias("parent_edge"),
                                                                     *[F.sum(c).alias(c) for c in sums]), "trie_edges")
    inner = parts.where("edge IS NULL").select("depth", "conv_id", "parent_conv_id", "parent_edge", *sums)
    named = small_side(edges.select(F.col("edge").alias("parent_edge"), F.col("conv_id").alias("parent_id")), "parent_edge")
    both = inner.unionByName(edges.withColumn("parent_conv_id", F.lit(None).cast("long")).drop("edge"))
    nodes = both.join(named, "parent_edge", "left").select("conv_id", F.col("depth").cast("long").alias("depth"), F.coalesce("parent_conv_id", "parent_id").alias("parent_conv_id"), *sums)
    merged = small_side(edges.select("edge", F.col("conv_id").alias("merged_id")), "edge")
    ends = parts.where(F.size("ends") > 0).select("edge", "conv_id", "depth", "slice", "ends").join(merged, "edge", "left")
    return nodes, ends.select(F.coalesce("merged_id", "conv_id").alias("conv_id"), F.col("depth").cast("long").alias("depth"), F.col("slice").alias("run"), F.col("ends").alias("ids"))


def end_digests(ends: DataFrame) -> DataFrame:
    """(conv_id, depth, ends_sha256): SHA-256 of the decimal ids in order, joined by commas; the runs of a node are read one after the other."""
    def run(batches):
        at, total, out = None, None, []
        for batch in batches:
            for conv, depth, ids in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "depth", "ids")), strict=True):
                if (conv, depth) != at:
                    if at is not None:
                        out.append((*at, total.hexdigest()))
                    at, total = (conv, depth), hashlib.sha256()
                else:
                    total.update(b",")
                total.update(",".join(map(str, ids)).encode())
            if len(out) >= 10_000:
                yield _digest_rows(out)
                out = []
        if at is not None:
            yield _digest_rows([*out, (*at, total.hexdigest())])

    dealt = ends.repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "run")
    return dealt.mapInArrow(run, "conv_id long, depth long, ends_sha256 string")


def _digest_rows(rows: list[tuple[int, int, str]]) -> pa.RecordBatch:
    conv, depth, digest = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(conv, pa.int64()), pa.array(depth, pa.int64()), pa.array(digest, pa.string())], ["conv_id", "depth", "ends_sha256"])
