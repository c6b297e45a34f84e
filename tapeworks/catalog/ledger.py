"""Positions and orders from the order tables."""

from pyspark.sql import functions as F

from tapeworks.catalog import query
from tapeworks.operators import ledger
from tapeworks.sources import tape as src

ORDER = ["ts_us", "l_orderkey", "l_linenumber", "l_suppkey", "price", "qty", "side"]
FILL_SQL = """fills AS (SELECT 'M' || (l_partkey % 40) AS symbol, epoch_us(l_shipdate) AS ts_us, l_orderkey, l_linenumber, l_suppkey, l_extendedprice AS price, l_quantity AS qty,
  CASE WHEN l_linestatus = 'O' THEN 'BUY' ELSE 'SELL' END AS side FROM lineitem)"""
LEDGER_SQL = FILL_SQL + """,
nf AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts_us, l_orderkey, l_linenumber, l_suppkey, price, qty, side) AS rn FROM fills),
w AS (SELECT symbol, rn, CASE WHEN side = 'BUY' THEN qty ELSE 0 END AS q, CASE WHEN side = 'BUY' THEN price ELSE 0 END AS avg_px FROM nf WHERE rn = 1
  UNION ALL SELECT t.symbol, t.rn, CASE WHEN side = 'BUY' THEN w.q + t.qty ELSE greatest(0, w.q - t.qty) END,
    CASE WHEN side = 'BUY' THEN (w.q * w.avg_px + t.qty * t.price) / (w.q + t.qty) ELSE w.avg_px END
  FROM w JOIN nf t ON t.symbol = w.symbol AND t.rn = w.rn + 1),
confirmed AS (SELECT symbol, arg_max(q, rn) AS confirmed_qty, arg_max(avg_px, rn) AS confirmed_avg_px FROM w GROUP BY symbol)"""
OPEN_SQL = """unresolved AS (SELECT o_orderkey AS cl_ord_id, CASE WHEN o_custkey % 45 IN (3, 4) THEN 'U' ELSE 'M' END || (o_custkey % 45) AS symbol, (o_orderkey % 9 + 1)::DOUBLE AS qty, o_totalprice AS worst_price,
  epoch_us(o_orderdate) AS dispatched_us FROM orders WHERE o_orderstatus = 'P')"""


def fills(spark, sf):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return src.table(spark, sf, "lineitem").select(
        F.concat(F.lit("M"), (F.col("l_partkey") % 40).cast("string")).alias("symbol"), src.micros("l_shipdate").alias("ts_us"), "l_orderkey", "l_linenumber",
        "l_suppkey", F.col("l_extendedprice").alias("price"), F.col("l_quantity").alias("qty"), F.when(F.col("l_linestatus") == "O", "BUY").otherwise("SELL").alias("side"))


def confirmed(spark, sf):
    return ledger.confirmed_positions(fills(spark, sf), ORDER)


def unresolved(spark, sf):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    m = F.col("o_custkey") % 45
    return src.table(spark, sf, "orders").where(F.col("o_orderstatus") == "P").select(
        F.col("o_orderkey").alias("cl_ord_id"), F.concat(F.when(m.isin(3, 4), "U").otherwise("M"), m.cast("string")).alias("symbol"), (F.col("o_orderkey") % 9 + 1).cast("double").alias("qty"),
        F.col("o_totalprice").alias("worst_price"), src.micros("o_orderdate").alias("dispatched_us"))


@query("position_ledger", f"WITH RECURSIVE {LEDGER_SQL} SELECT symbol, ts_us, l_orderkey, l_linenumber, q AS position_qty, round(avg_px / 7, 4) AS avg_px FROM w JOIN nf USING (symbol, rn)")
def _(spark, sf):
    return ledger.position_ledger(fills(spark, sf), ORDER).select("symbol", "ts_us", "l_orderkey", "l_linenumber", "position_qty", F.round(F.col("avg_px") / 7, 4).alias("avg_px"))


@query("shadow_position", f"""WITH RECURSIVE {LEDGER_SQL}, {OPEN_SQL}, o AS (SELECT symbol, sum(qty) AS q, sum(qty * worst_price) AS c, count(*) AS n FROM unresolved GROUP BY symbol)
SELECT symbol, coalesce(confirmed_qty, 0) AS confirmed_qty, round(coalesce(confirmed_avg_px, 0), 4) AS confirmed_avg_px, coalesce(n, 0) AS unresolved_count,
  coalesce(confirmed_qty, 0) + coalesce(q, 0) AS shadow_qty,
  round(CASE WHEN coalesce(confirmed_qty, 0) + coalesce(q, 0) > 0 THEN (coalesce(confirmed_qty * confirmed_avg_px, 0) + coalesce(c, 0)) / (coalesce(confirmed_qty, 0) + coalesce(q, 0)) ELSE coalesce(confirmed_avg_px, 0) END, 4) AS shadow_avg_px,
  round(coalesce(confirmed_qty * confirmed_avg_px, 0) + coalesce(c, 0), 2) AS exposure FROM confirmed FULL JOIN o USING (symbol)""")
def _(spark, sf):
    s = ledger.shadow_position(confirmed(spark, sf), unresolved(spark, sf))
    return s.withColumn("confirmed_avg_px", F.round("confirmed_avg_px", 4)).withColumn("shadow_avg_px", F.round("shadow_avg_px", 4))


@query("strike_gate", f"""WITH RECURSIVE {LEDGER_SQL}, {OPEN_SQL}, t AS (SELECT (SELECT sum(abs(confirmed_qty * confirmed_avg_px)) FROM confirmed) + (SELECT sum(abs(qty * worst_price)) FROM unresolved) AS total),
s AS (SELECT symbol FROM confirmed UNION SELECT symbol FROM unresolved)
SELECT symbol, round(total, 0) AS total_exposure, symbol NOT IN (SELECT symbol FROM unresolved) AND total < 1e15 AS allowed FROM s, t""")
def _(spark, sf):
    return ledger.strike_gate(confirmed(spark, sf), unresolved(spark, sf), 1e15).withColumn("total_exposure", F.round("total_exposure", 0))


@query("order_reconcile", f"""WITH {OPEN_SQL}, h AS (SELECT o_orderkey AS cl_ord_id, (['Filled', 'PartiallyFilled', 'Cancelled', 'Deactivated', 'Rejected', 'New'])[o_orderkey % 6 + 1] AS status,
  (o_orderkey % 9)::DOUBLE AS filled_qty, round(o_totalprice / 101, 2) AS avg_price FROM orders WHERE o_orderkey % 7 <> 0)
SELECT cl_ord_id, CASE WHEN status IS NULL THEN 'NEVER_RECEIVED' WHEN status = 'Filled' THEN 'FILLED' WHEN status = 'PartiallyFilled' THEN 'PARTIALLY_FILLED' WHEN status IN ('Cancelled', 'Deactivated') THEN 'CANCELLED'
  WHEN status = 'Rejected' THEN 'REJECTED' ELSE 'INDETERMINATE' END AS fate, coalesce(h.filled_qty, 0) AS filled_qty, coalesce(h.avg_price, 0) AS avg_price, coalesce(status, '') <> 'New' AS resolved
FROM unresolved LEFT JOIN h USING (cl_ord_id)""")
def _(spark, sf):
    k = F.col("o_orderkey")
    status = F.element_at(F.array(*[F.lit(s) for s in ("Filled", "PartiallyFilled", "Cancelled", "Deactivated", "Rejected", "New")]), (k % 6 + 1).cast("int"))
    h = src.table(spark, sf, "orders").where(k % 7 != 0).select(k.alias("cl_ord_id"), status.alias("status"), (k % 9).cast("double").alias("filled_qty"), F.round(F.col("o_totalprice") / 101, 2).alias("avg_price"))
    return ledger.order_reconcile(unresolved(spark, sf), h).select("cl_ord_id", "fate", "filled_qty", "avg_price", "resolved")


# Some names exist on one side only: U3 and U4 (orders), X7 (exchange), L9 (local books).
POS_SQL = """exch AS (SELECT CASE WHEN o_custkey % 45 = 7 THEN 'X' ELSE 'M' END || (o_custkey % 45) AS symbol, (max(o_orderkey) % 400)::DOUBLE AS size FROM orders GROUP BY 1)"""


def exchange(spark, sf):
    m = F.col("o_custkey") % 45
    return src.table(spark, sf, "orders").groupBy(F.concat(F.when(m == 7, "X").otherwise("M"), m.cast("string")).alias("symbol")).agg((F.max("o_orderkey") % 400).cast("double").alias("size"))


def local(spark, sf):
    p = F.col("l_partkey") % 50
    return src.table(spark, sf, "lineitem").groupBy(F.concat(F.when(p == 9, "L").otherwise("M"), p.cast("string")).alias("symbol")).agg((F.max("l_orderkey") % 400).cast("double").alias("size"))


LOCAL_SQL = "local AS (SELECT CASE WHEN l_partkey % 50 = 9 THEN 'L' ELSE 'M' END || (l_partkey % 50) AS symbol, (max(l_orderkey) % 400)::DOUBLE AS size FROM lineitem GROUP BY 1)"


@query("position_arbitration", f"""WITH {OPEN_SQL}, {POS_SQL}, {LOCAL_SQL}, p AS (SELECT e.symbol, e.size - coalesce(l.size, 0) / 2 AS surplus FROM exch e LEFT JOIN local l USING (symbol)),
b AS (SELECT *, coalesce(sum(qty) OVER (PARTITION BY symbol ORDER BY dispatched_us, cl_ord_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM unresolved),
f AS (SELECT b.*, CASE WHEN coalesce(surplus, 0) > 1e-8 THEN greatest(0, least(qty, surplus - before)) ELSE 0 END AS fill_qty FROM b LEFT JOIN p USING (symbol))
SELECT cl_ord_id, symbol, qty, fill_qty::DOUBLE AS fill_qty, CASE WHEN fill_qty > 1e-8 THEN 'FILLED' ELSE 'NEVER_RECEIVED' END AS fate FROM f""")
def _(spark, sf):
    pos = exchange(spark, sf).withColumnRenamed("size", "exchange_qty").join(local(spark, sf).select("symbol", (F.col("size") / 2).alias("confirmed_qty")), "symbol", "left") \
        .withColumn("confirmed_qty", F.coalesce("confirmed_qty", F.lit(0.0)))
    return ledger.position_arbitration(unresolved(spark, sf), pos)


@query("position_gaps", f"""WITH {POS_SQL}, {LOCAL_SQL}, g AS (SELECT symbol, coalesce(l.size, 0) AS local_size, coalesce(e.size, 0) AS exchange_size FROM local l FULL JOIN exch e USING (symbol) WHERE symbol <> 'M11')
SELECT *, CASE WHEN exchange_size = 0 AND local_size <> 0 THEN 'GHOST' WHEN exchange_size <> 0 AND local_size = 0 THEN 'ALIEN' WHEN abs(exchange_size - local_size) > 1e-8 THEN 'DRIFT' ELSE 'OK' END AS gap FROM g""")
def _(spark, sf):
    quiet = exchange(spark, sf).where("symbol = 'M11'")
    return ledger.position_gaps(local(spark, sf), exchange(spark, sf), quiet)


@query("position_symbols", f"WITH {POS_SQL}, {LOCAL_SQL} SELECT symbol FROM local UNION SELECT symbol FROM exch WHERE size > 0")
def _(spark, sf):
    return ledger.position_symbols(local(spark, sf), exchange(spark, sf), majors=("M0", "M1"), shedding=True)


@query("orphan_orders", """SELECT o_orderkey AS cl_ord_id, 'M' || (o_custkey % 45) AS symbol FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) AND o_custkey % 45 <> 3""")
def _(spark, sf):
    m = F.col("o_custkey") % 45
    ex = src.table(spark, sf, "orders").select(F.col("o_orderkey").alias("cl_ord_id"), F.concat(F.lit("M"), m.cast("string")).alias("symbol"))
    return ledger.orphan_orders(ex, src.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("cl_ord_id")), ex.where("symbol = 'M3'")).select("cl_ord_id", "symbol")


@query("fill_drift", """WITH e AS (SELECT l_orderkey AS id, (epoch_us(l_shipdate), l_linenumber, l_partkey, l_suppkey, l_quantity) AS pos, CASE l_returnflag WHEN 'A' THEN 'FILLED' WHEN 'N' THEN 'DISPATCHED' ELSE 'PENDING' END AS status,
  round(o_totalprice, 2) AS pre, CASE WHEN l_returnflag = 'A' THEN o_totalprice * 1.001 END AS exe FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
SELECT id AS cl_ord_id, arg_max(status, pos) AS status, round(abs(arg_max(exe, pos) FILTER (WHERE exe IS NOT NULL) - arg_max(pre, pos)), 5) AS drift, arg_max(status, pos) IN ('PENDING', 'DISPATCHED') AS unresolved FROM e GROUP BY id""")
def _(spark, sf):
    li = src.table(spark, sf, "lineitem")  # line numbers repeat within an order, so a line is named by its part as well
    o = src.table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_totalprice")
    flag = F.col("l_returnflag")
    ev = li.join(o, "l_orderkey").select(
        F.col("l_orderkey").alias("cl_ord_id"), src.micros("l_shipdate").alias("ts_us"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity").alias("seq"),
        F.when(flag == "A", "FILLED").when(flag == "N", "DISPATCHED").otherwise("PENDING").alias("status"), F.round("o_totalprice", 2).alias("pre_flight_price"),
        F.when(flag == "A", F.col("o_totalprice") * 1.001).alias("execution_price"))
    return ledger.fill_drift(ev).withColumn("drift", F.round("drift", 5))


HWM = 852_076_800_000_000  # 1997-01-01


@query("ledger_projection", f"""WITH e AS (SELECT 'M' || (o_custkey % 45) AS symbol, epoch_us(o_orderdate) AS ts_us, o_orderkey AS id, o_orderkey % 3 = 0 AS is_pos, (o_orderkey % 77)::DOUBLE AS size, round(o_totalprice, 2) AS px, o_orderstatus FROM orders WHERE epoch_us(o_orderdate) >= {HWM}),
p AS (SELECT symbol, arg_max(size, ts_us // 1000000 * 100000000 + id) AS size, arg_max(px, ts_us // 1000000 * 100000000 + id) AS px FROM e WHERE is_pos GROUP BY symbol),
l AS (SELECT symbol, count(*) AS n FROM e WHERE NOT is_pos AND id % 5 <> 0 AND o_orderstatus = 'P' GROUP BY symbol)
SELECT s.symbol, coalesce(size, 0) AS size, coalesce(px, 0) AS entry_price, coalesce(n, 0) AS open_orders FROM (SELECT DISTINCT symbol FROM e) s LEFT JOIN p USING (symbol) LEFT JOIN l USING (symbol)""")
def _(spark, sf):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    k, st = F.col("o_orderkey"), F.col("o_orderstatus")
    o = src.table(spark, sf, "orders")
    ev = o.select(F.when(k % 3 == 0, "position").otherwise("order").alias("kind"), F.concat(F.lit("M"), (F.col("o_custkey") % 45).cast("string")).alias("symbol"),
                  src.micros("o_orderdate").alias("ts_us"), k.alias("seq"), k.alias("order_id"), F.when(st == "P", "New").when(st == "F", "Filled").otherwise("Cancelled").alias("status"),
                  (k % 77).cast("double").alias("size"), F.round("o_totalprice", 2).alias("entry_price"))
    return ledger.ledger_projection(ev, o.where(k % 5 != 0).select(k.alias("order_id")), HWM)
