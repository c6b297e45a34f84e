"""Exact deduplication by Grace hashing: split to spilled buckets until a table holds each, comparing complete content.

A record is a row with the digest of its content.  Records are partitioned by a hash of the
digest and written to the shared folder (the spill files); the task of a bucket streams its
records through an open-addressing table that compares whole contents, never digests alone.
The table takes new contents until its budget is used.  From then on records of contents it
does not hold leave the task unchanged, and go one level deeper: they are partitioned again
by another hash, into as many buckets as their bytes need.  A content is in the table from
its first record or not at all, so each is settled in one task, and levels end when nothing
is left over.

The same table runs before the first partitioning, in the tasks that read the input, so a
content that a third of all rows share crosses the network once a task, not once a row.

Of equal contents the row with the most code points stays, then the smallest id (nulls
last), then the first in the order of reading.  Defined cases: a null text is the empty
text; rows repeated with id and all are copies like any other, one of them stays; texts of
any length are compared whole; an empty table gives empty results; columns of any name pass
through, as rows travel as one struct.
"""

from __future__ import annotations

import hashlib
from array import array

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tapeworks.llm.shared import folder, stored

BLANKS = bytes([0x20, *range(0x09, 0x0E)])
TABLE_BYTES = 32 << 20
BATCH_BYTES, BATCH_ROWS = 4 << 20, 256


def content_of(text: str | None) -> bytes:
    return (text or "").encode().translate(None, BLANKS)


class Table:
    """Open addressing with linear probing over contents; grows by doubling while the contents fit ``budget`` bytes."""

    def __init__(self, budget: int):
        self.budget, self.used = budget, 0
        self.slots, self.contents, self.records = array("q", [-1]) * 1024, [], []

    def place(self, digest: bytes, content: bytes) -> int:
        """The slot that holds the content, or the empty one where it belongs."""
        mask = len(self.slots) - 1
        at = int.from_bytes(digest[:8], "little") & mask
        while (k := self.slots[at]) >= 0 and self.contents[k] != content:
            at = (at + 1) & mask
        return at

    def add(self, record: dict, content: bytes) -> bool:
        """Whether the record is in the table now, alone or merged with equal ones."""
        at = self.place(record["digest"], content)
        k = self.slots[at]
        if k >= 0:
            held = self.records[k]
            total = held["copies"] + record["copies"]
            if order(record) < order(held):
                self.records[k] = held = record
            held["copies"] = total
            return True
        if self.used + len(content) > self.budget and self.records:
            return False
        self.slots[at] = len(self.records)
        self.records.append(record)
        self.contents.append(content)
        self.used += len(content) + 200
        if 2 * len(self.records) > len(self.slots):
            self.slots = array("q", [-1]) * (2 * len(self.slots))
            for k, (old, content) in enumerate(zip(self.records, self.contents, strict=True)):
                self.slots[self.place(old["digest"], content)] = k
        return True


def order(record: dict):
    return -record["chars"], record["id"] is None, record["id"] or 0, record["number"]


FIELDS = "digest binary, chars long, id long, number long, copies long, bytes long, kind string"
MEMBER, OPEN, WHOLE = "member", "open", "whole"  # a row's key; a record that may have equals elsewhere; a settled one


def _parts(batches):
    """Arrow batches cut to a few hundred rows, so that few become Python objects at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH_ROWS):
            yield batch.slice(at, BATCH_ROWS)


def _batches(records, schema: pa.Schema):
    """Record batches of a few MB each."""
    part, size = [], 0
    for r in records:
        part.append(r)
        size += r["bytes"] + 200
        if size >= BATCH_BYTES:
            yield pa.RecordBatch.from_pylist(part, schema)
            part, size = [], 0
    if part:
        yield pa.RecordBatch.from_pylist(part, schema)


def combined(df: DataFrame, id: str, text: str, table_bytes: int, members: bool) -> DataFrame:
    """All records of ``df`` after its reading tasks merged what they could; with ``members`` also every row's key."""
    row = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), F.col(id).cast("long").alias("id"), F.monotonically_increasing_id().alias("number"))
    schema = T._parse_datatype_string(FIELDS).add("row", row.schema["row"].dataType)
    arrow = to_arrow_schema(schema)

    def read(batches):
        table = Table(table_bytes)
        for batch in _parts(batches):
            out = []
            for x in batch.to_pylist():
                content = content_of(x["row"][text])
                key = {"digest": hashlib.sha256(content).digest(), "chars": len(x["row"][text] or ""), "id": x["id"], "number": x["number"], "copies": 1}
                if members:
                    out.append(key | {"kind": MEMBER, "bytes": 0, "row": None})
                record = key | {"kind": OPEN, "bytes": len(content), "row": x["row"]}
                if not table.add(record, content):
                    out.append(record)
            yield from _batches(out, arrow)
        yield from _batches(table.records, arrow)

    return row.mapInArrow(read, schema)


def settle(spilled: DataFrame, text: str = "text", table_bytes: int = TABLE_BYTES, rows: bool = True, size: int | None = None) -> DataFrame:
    """One record for each content: (digest, chars, id, number, copies[, row]) of the row that stays.

    ``size`` bounds the bytes of ``spilled`` where they are known already.
    """
    spark, schema = spilled.sparkSession, spilled.schema
    arrow = to_arrow_schema(schema)

    def bucket(batches):
        table = Table(table_bytes)
        for batch in _parts(batches):
            over = []
            for record in batch.to_pylist():
                if not table.add(record, content_of(record["row"][text])):
                    over.append(record)
            yield from _batches(over, arrow)
        yield from _batches((r | {"kind": WHOLE, "row": r["row"] if rows else None} for r in table.records), arrow)

    records, done, level = spilled.where(F.col("kind") == OPEN), None, 0
    while total := size if size is not None and not level else records.agg(F.sum(F.col("bytes") + 200)).first()[0]:
        buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-2 * total // table_bytes))
        path = folder(spark, f"grace-level-{level}")
        dealt = records.repartition(buckets, F.xxhash64("digest", F.lit(level)))
        dealt.mapInArrow(bucket, schema).write.option("compression", "zstd").parquet(path)
        held = spark.read.schema(schema).parquet(path)
        settled = held.where(F.col("kind") == WHOLE)
        done = settled if done is None else done.unionByName(settled)
        records, level = held.where(F.col("kind") == OPEN), level + 1
    return (spilled.where(F.lit(False)) if done is None else done).drop("kind", "bytes")


def survivors(df: DataFrame, id: str = "doc_id", text: str = "text", table_bytes: int = TABLE_BYTES) -> DataFrame:
    """``df`` without its copies: one row of each content."""
    size = df.agg(F.sum(F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 200)).first()[0] or 0
    return settle(combined(df, id, text, table_bytes, False), text, table_bytes, size=size).select("row.*")


def classes(df: DataFrame, id: str = "doc_id", text: str = "text", table_bytes: int = TABLE_BYTES) -> DataFrame:
    """(id, digest, keep_id, group_size, kept) for every row of ``df``."""
    spilled = stored(combined(df.select(id, text), id, text, table_bytes, True), "grace")
    winners = settle(spilled, text, table_bytes, rows=False).select("digest", F.col("id").alias("keep_id"), F.col("number").alias("keep_number"), F.col("copies").alias("group_size"))
    members = spilled.where(F.col("kind") == MEMBER).select("digest", "id", "number")
    return members.join(winners, "digest").select("id", "digest", "keep_id", "group_size", (F.col("number") == F.col("keep_number")).alias("kept"))
