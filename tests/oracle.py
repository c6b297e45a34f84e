"""Compare a registered query with its SQL on the same tables."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{os.path.join(sf_dir, t)}.parquet'")
    return con


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
        if isinstance(v, (list, tuple)):
            return repr([cell(x) for x in v])
        return "<null>" if v is None else str(v)
    return [columns[i] for i in order], sorted([tuple(cell(r[i]) for i in order) for r in rows])


def kind(t: str) -> str:
    t = t.lower()
    for names, k in ((("bigint", "long"), "int64"), (("int", "integer"), "int32"), (("double",), "float64"),
                     (("float",), "float32"), (("string", "varchar"), "str"), (("boolean",), "bool")):
        if t in names:
            return k
    return t


def compare(df, con, sql):
    cur = con.execute(sql)
    want_types = {d[0]: kind(str(d[1])) for d in cur.description}
    want = canonical([d[0] for d in cur.description], cur.fetchall())
    rows = df.collect()
    got = canonical(df.columns, [tuple(r) for r in rows])
    got_types = {f.name: kind(f.dataType.simpleString()) for f in df.schema.fields}
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    if got_types != want_types:
        bad = {c: (got_types[c], want_types[c]) for c in got_types if got_types[c] != want_types[c]}
        return f"types {bad}"
    if len(got[1]) != len(want[1]):
        return f"rows {len(got[1])} != {len(want[1])}: only spark {[r for r in got[1] if r not in set(want[1])][:2]} only sql {[r for r in want[1] if r not in set(got[1])][:2]}"
    diff = [(a, b) for a, b in zip(got[1], want[1]) if a != b]
    if diff:
        return f"{len(diff)} rows differ, first {diff[0]} columns {got[0]}"
    return f"ok {len(rows)}"
