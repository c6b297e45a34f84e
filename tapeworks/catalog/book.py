"""Order books built from the tape: every tick becomes one book message."""

from pyspark.sql import functions as F

from tapeworks.catalog import query
from tapeworks.operators import book
from tapeworks.plans.slices import dense_index
from tapeworks.sources import tape as src

AT = 1_705_708_800_000_000  # 2024-01-20
LATER = AT + 6 * 3_600_000_000
SCALE = 100
BUDGET = 400_000

# Update ids with gaps, repeats, broken ranges and repeated sequence numbers; a snapshot every 40 messages.
UPDATE_SQL = f"""{src.TICKS_SQL},
rows AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts_us, trade_id) AS rn FROM ticks),
upd AS (SELECT symbol, ts_us, trade_id AS msg_id, rn, price, size, CASE WHEN rn % 40 = 5 THEN 'snapshot' ELSE 'delta' END AS type,
  rn + rn // 171 - CASE WHEN rn % 80 = 5 THEN 3 WHEN rn % 40 <> 5 AND trade_id % 131 = 0 THEN 1 ELSE 0 END AS u,
  CASE WHEN trade_id % 5 <> 0 THEN rn + rn // 171 + CASE WHEN trade_id % 397 = 0 THEN 5 ELSE 0 END END AS first_u,
  CASE WHEN trade_id % 367 = 0 THEN 1 ELSE trade_id * 10 END AS seq FROM rows)"""

WALK_SQL = UPDATE_SQL + """,
walk AS (
  SELECT symbol, rn, ts_us, msg_id, CAST(CASE WHEN type = 'snapshot' THEN u ELSE 0 END AS BIGINT) AS u, CAST(0 AS BIGINT) AS sq,
         CAST(CASE WHEN type = 'snapshot' THEN 1 ELSE 0 END AS BIGINT) AS ep,
         CASE WHEN type = 'snapshot' THEN [] ELSE [{'id': msg_id, 'u': u, 'lo': first_u, 's': seq}] END AS buf,
         CASE WHEN type = 'snapshot' THEN 'snapshot' ELSE 'no_snapshot_anchor' END AS verdict, CAST([] AS BIGINT[]) AS ids FROM upd WHERE rn = 1
  UNION ALL
  SELECT symbol, rn, ts_us, msg_id,
    CASE WHEN v = 'snapshot' THEN r.u WHEN v IN ('invalid_u_range', 'sequence_gap') THEN 0 WHEN v = 'ok' THEN nu ELSE wu END,
    CASE WHEN v = 'snapshot' THEN r.sq WHEN v IN ('invalid_u_range', 'sequence_gap') THEN 0 WHEN v = 'ok' THEN nseq ELSE wsq END,
    CASE WHEN v = 'snapshot' THEN r.ep WHEN v IN ('invalid_u_range', 'sequence_gap') THEN ep + 1 ELSE ep END,
    CASE WHEN v = 'snapshot' THEN [] WHEN v = 'no_snapshot_anchor' THEN list_append(buf, {'id': msg_id, 'u': nu, 'lo': lo, 's': nseq}) ELSE buf END,
    v, CASE WHEN v = 'snapshot' THEN r.ids ELSE [] END
  FROM (SELECT *, CASE WHEN v = 'snapshot' THEN list_reduce(
            list_prepend({'u': nu, 'sq': CAST(0 AS BIGINT), 'ep': ep + 1, 'ids': CAST([] AS BIGINT[]), 'nu': CAST(0 AS BIGINT), 'lo': CAST(0 AS BIGINT), 'id': CAST(0 AS BIGINT), 'ns': CAST(0 AS BIGINT), 'dead': false},
              list_transform(list_sort(list_transform(buf, lambda b: {'u': b.u, 'b': b})), lambda b: {'u': CAST(0 AS BIGINT), 'sq': CAST(0 AS BIGINT), 'ep': CAST(0 AS BIGINT), 'ids': CAST([] AS BIGINT[]),
                 'nu': b.u, 'lo': b.b.lo, 'id': b.b.id, 'ns': b.b.s, 'dead': false})),
            lambda a, x: CASE WHEN a.dead OR x.nu <= a.u THEN a
              WHEN x.lo IS NOT NULL AND x.lo > a.u + 1 THEN {'u': CAST(0 AS BIGINT), 'sq': CAST(0 AS BIGINT), 'ep': a.ep + 1, 'ids': a.ids, 'nu': a.nu, 'lo': a.lo, 'id': a.id, 'ns': a.ns, 'dead': true}
              ELSE {'u': x.nu, 'sq': x.ns, 'ep': a.ep, 'ids': list_append(a.ids, x.id), 'nu': a.nu, 'lo': a.lo, 'id': a.id, 'ns': a.ns, 'dead': false} END) END AS r
        FROM (SELECT t.symbol, t.rn, t.ts_us, t.msg_id, t.u AS nu, t.first_u AS lo, t.seq AS nseq, w.u AS wu, w.sq AS wsq, w.ep, w.buf,
          CASE WHEN t.type = 'snapshot' THEN 'snapshot' WHEN w.u = 0 THEN 'no_snapshot_anchor' WHEN t.first_u > t.u THEN 'invalid_u_range'
               WHEN t.u <= w.u THEN 'stale_or_duplicate_u' WHEN t.first_u > w.u + 1 THEN 'sequence_gap'
               WHEN w.sq > 0 AND t.seq <= w.sq THEN 'stale_or_duplicate_seq' ELSE 'ok' END AS v
          FROM walk w JOIN upd t ON t.symbol = w.symbol AND t.rn = w.rn + 1)))"""


def updates(spark, sf):
    t = dense_index(src.ticks(spark, sf), ["symbol"], ["ts_us", "trade_id"], "idx").withColumn("rn", F.col("idx") + 1)
    rn, tid, p, s = F.col("rn"), F.col("trade_id"), F.col("price"), F.col("size")
    base = rn + F.floor(rn / 171)
    lv = lambda price, qty: F.struct(price.alias("price"), (qty * 1000).alias("qty"))
    high = F.when(tid % 211 == 0, 40).otherwise(0)
    return t.select(
        "symbol", "ts_us", tid.alias("msg_id"), F.when(rn % 40 == 5, "snapshot").otherwise("delta").alias("type"),
        (base - F.when(rn % 80 == 5, 3).when((rn % 40 != 5) & (tid % 131 == 0), 1).otherwise(0)).alias("u"),
        F.when(tid % 5 != 0, base + F.when(tid % 397 == 0, 5).otherwise(0)).alias("first_u"),
        F.when(tid % 367 == 0, 1).otherwise(tid * 10).cast("long").alias("seq"),
        F.array(lv(10000 - p % 20 * 5 + high, s % 10), lv(9998 - p % 13 * 5, s % 7)).alias("bids"),
        F.array(lv(10005 + p % 17 * 5, s % 9), lv(10007 + p % 11 * 5, s % 8)).alias("asks"))


@query("book_validity", f"""WITH RECURSIVE {WALK_SQL}
SELECT symbol, msg_id, verdict, ep AS epoch, u > 0 AS consistent, CAST(len(ids) AS BIGINT) AS replayed FROM walk""")
def _(spark, sf):
    v = book.book_validity(updates(spark, sf))
    order = F.col("step")
    return v.groupBy("symbol", F.col("at_id").alias("msg_id")).agg(
        F.min_by("verdict", order).alias("verdict"), F.max_by("epoch", order).alias("epoch"), F.max_by("consistent", order).alias("consistent"),
        F.count(F.when(F.col("verdict") == "replayed", 1)).alias("replayed"))


@query("sequence_guard", f"""WITH RECURSIVE {UPDATE_SQL},
w AS (SELECT symbol, rn, msg_id, CASE WHEN type = 'snapshot' THEN u ELSE -1 END AS last, type = 'snapshot' AS synced, type = 'snapshot' AS valid FROM upd WHERE rn = 1
 UNION ALL SELECT t.symbol, t.rn, t.msg_id, CASE WHEN t.type = 'snapshot' OR (w.synced AND t.u = w.last + 1) THEN t.u ELSE w.last END,
   t.type = 'snapshot' OR (w.synced AND t.u <= w.last + 1), t.type = 'snapshot' OR (w.synced AND t.u = w.last + 1)
 FROM w JOIN upd t ON t.symbol = w.symbol AND t.rn = w.rn + 1)
SELECT symbol, msg_id, valid, synced FROM w""")
def _(spark, sf):
    return book.sequence_guard(updates(spark, sf)).select("symbol", "msg_id", "valid", "synced")


def at_sql(at: int, p: str = "") -> str:
    """Books at a time from the walk: state per symbol, then levels."""
    return f"""{p}st AS (SELECT symbol, arg_max(ep, rn) AS epoch, arg_max(u, rn) > 0 AS consistent,
    max(CASE WHEN verdict IN ('ok', 'snapshot') THEN ts_us END) AS updated_us FROM walk WHERE ts_us <= {at} GROUP BY symbol),
{p}app AS (SELECT symbol, rn, 0 AS k, msg_id, CASE WHEN verdict = 'snapshot' AND u = 0 THEN ep - 1 ELSE ep END AS ep FROM walk WHERE verdict IN ('ok', 'snapshot') AND ts_us <= {at}
  UNION ALL SELECT symbol, rn, k, msg_id, ep FROM (SELECT symbol, rn, generate_subscripts(ids, 1) AS k, unnest(ids) AS msg_id, CASE WHEN u = 0 THEN ep - 1 ELSE ep END AS ep FROM walk WHERE ts_us <= {at})),
{p}live AS (SELECT a.* FROM {p}app a JOIN {p}st s ON s.symbol = a.symbol AND s.epoch = a.ep AND s.consistent),
{p}lv AS (SELECT l.*, l.rn * 100 + l.k AS ord, x.side, x.price, x.qty * 1000 AS qty FROM {p}live l JOIN upd m ON m.msg_id = l.msg_id, LATERAL (
    VALUES ('bid', 10000 - m.price % 20 * 5 + CASE WHEN m.msg_id % 211 = 0 THEN 40 ELSE 0 END, m.size % 10), ('bid', 9998 - m.price % 13 * 5, m.size % 7),
           ('ask', 10005 + m.price % 17 * 5, m.size % 9), ('ask', 10007 + m.price % 11 * 5, m.size % 8)) x(side, price, qty)),
{p}lq AS (SELECT symbol, side, price, arg_max(qty, ord) AS qty, max(ord) AS ord FROM {p}lv GROUP BY symbol, side, price),
{p}bk AS (SELECT *, row_number() OVER (PARTITION BY symbol, side ORDER BY CASE WHEN side = 'bid' THEN -price ELSE price END) - 1 AS k FROM {p}lq WHERE qty > 0),
{p}bbo AS (SELECT symbol, epoch, consistent, updated_us, (SELECT max(price) FROM {p}bk b WHERE b.symbol = s.symbol AND side = 'bid') AS bid,
  (SELECT min(price) FROM {p}bk b WHERE b.symbol = s.symbol AND side = 'ask') AS ask FROM {p}st s)"""


def shape(b):
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, l: a + l["qty"])
    return b.select("symbol", "epoch", "consistent", "updated_us", book.best(F.col("bids"))["price"].alias("bid"), book.best(F.col("asks"))["price"].alias("ask"),
                    F.size("bids").cast("long").alias("bid_levels"), F.size("asks").cast("long").alias("ask_levels"), total("bids").alias("bid_qty"), total("asks").alias("ask_qty"))


SHAPE_SQL = """SELECT b.*, (SELECT count(*) FROM {bk} k WHERE k.symbol = b.symbol AND side = 'bid') AS bid_levels,
  (SELECT count(*) FROM {bk} k WHERE k.symbol = b.symbol AND side = 'ask') AS ask_levels,
  CAST(coalesce((SELECT sum(qty) FROM {bk} k WHERE k.symbol = b.symbol AND side = 'bid'), 0) AS BIGINT) AS bid_qty,
  CAST(coalesce((SELECT sum(qty) FROM {bk} k WHERE k.symbol = b.symbol AND side = 'ask'), 0) AS BIGINT) AS ask_qty FROM bbo b"""


@query("book_at", f"WITH RECURSIVE {WALK_SQL}, {at_sql(AT)} " + SHAPE_SQL.format(bk="bk"))
def _(spark, sf):
    return shape(book.book_at(updates(spark, sf), AT))


@query("trade_depletes_book", f"""WITH RECURSIVE {WALK_SQL}, {at_sql(AT)},
hits AS (SELECT symbol, CASE WHEN msg_id % 2 = 0 THEN 'ask' ELSE 'bid' END AS side, CASE WHEN msg_id % 2 = 0 THEN 10005 + price % 17 * 5 ELSE 10000 - price % 20 * 5 END AS price,
   rn * 100 + 50 AS ord, size * 20 AS qty FROM upd WHERE ts_us <= {AT}),
gone AS (SELECT l.symbol, l.side, l.price, sum(h.qty) AS qty FROM lq l JOIN hits h ON h.symbol = l.symbol AND h.side = l.side AND h.price = l.price AND h.ord > l.ord - l.ord % 100 + 99 GROUP BY ALL),
left_ AS (SELECT l.symbol, l.side, l.price, l.qty - coalesce(g.qty, 0) AS qty FROM lq l LEFT JOIN gone g USING (symbol, side, price) WHERE l.qty - coalesce(g.qty, 0) > 0)
""" + SHAPE_SQL.format(bk="left_").replace("b.*", """b.symbol, b.epoch, b.consistent, b.updated_us, (SELECT max(price) FROM left_ k WHERE k.symbol = b.symbol AND side = 'bid') AS bid,
  (SELECT min(price) FROM left_ k WHERE k.symbol = b.symbol AND side = 'ask') AS ask"""))
def _(spark, sf):
    even = F.col("trade_id") % 2 == 0
    trades = src.ticks(spark, sf).select("symbol", "ts_us", "trade_id", F.when(even, 10005 + F.col("price") % 17 * 5).otherwise(10000 - F.col("price") % 20 * 5).alias("price"),
                                         (F.col("size") * 20).alias("qty"), F.when(even, "Buy").otherwise("Sell").alias("side"))
    return shape(book.book_at(updates(spark, sf), AT, trades=trades))


@query("book_crossed", f"WITH RECURSIVE {WALK_SQL}, {at_sql(AT)} SELECT symbol, coalesce(bid >= ask, false) AS crossed FROM bbo")
def _(spark, sf):
    return book.book_crossed(book.book_at(updates(spark, sf), AT)).select("symbol", "crossed")


DEPTH = 40


@query("book_depth_usd", f"""WITH RECURSIVE {WALK_SQL}, {at_sql(AT)}, m AS (SELECT *, (bid + ask) // 2 AS mid, (bid + ask) // 2 * {DEPTH} // 10000 AS half FROM bbo)
SELECT symbol, CASE WHEN consistent AND mid IS NOT NULL THEN CAST((SELECT coalesce(sum(price * qty // {SCALE}), 0) FROM bk WHERE bk.symbol = m.symbol AND side = 'bid' AND price >= mid - half) AS BIGINT) END AS bid_usd,
  CASE WHEN consistent AND mid IS NOT NULL THEN CAST((SELECT coalesce(sum(price * qty // {SCALE}), 0) FROM bk WHERE bk.symbol = m.symbol AND side = 'ask' AND price <= mid + half) AS BIGINT) END AS ask_usd FROM m""")
def _(spark, sf):
    return book.book_depth_usd(book.book_at(updates(spark, sf), AT), DEPTH, SCALE).select("symbol", "bid_usd", "ask_usd")


def cut_sql(p: str = "") -> str:
    return f"""{p}top AS (SELECT b.symbol, (b.bid + b.ask) / 2.0::DOUBLE AS mid,
  sign((SELECT qty FROM {p}bk k WHERE k.symbol = b.symbol AND side = 'bid' AND k = 0) - (SELECT qty FROM {p}bk k WHERE k.symbol = b.symbol AND side = 'ask' AND k = 0)) AS lean FROM {p}bbo b),
{p}cut AS (SELECT symbol, side, k, price, qty, ctr, decay, CAST(qty AS HUGEINT) * (1024 - ctr) * decay // 1048576 AS sure FROM (
  SELECT l.*, coalesce(CAST(trunc(0.3 * exp(-k / 10.0) * 1024) AS BIGINT), 0) AS ctr,
    coalesce(CAST(trunc(exp(-(greatest(0, least(1023, trunc(1.0 / (1.0 + 10.0 * abs(price - mid) / mid) * (1.0 + 0.5 * lean * CASE WHEN side = 'bid' THEN -1 ELSE 1 END) * 100.0))) / 100.0) * 1.2) * 1024) AS BIGINT), 1024) AS decay
  FROM {p}bk l JOIN {p}top USING (symbol)))"""


@query("liquidity_haircut", f"""WITH RECURSIVE {WALK_SQL}, {at_sql(AT)}, {cut_sql()} SELECT symbol, side, price, ctr, decay, CAST(sure AS BIGINT) AS sure_qty FROM cut""")
def _(spark, sf):
    b = book.liquidity_haircut(book.book_at(updates(spark, sf), AT))
    sides = F.explode(F.array(F.struct(F.lit("bid").alias("side"), F.col("bid_cut").alias("l")), F.struct(F.lit("ask").alias("side"), F.col("ask_cut").alias("l"))))
    return b.select("symbol", sides.alias("s")).select("symbol", "s.side", F.explode("s.l").alias("l")).select("symbol", "side", "l.price", "l.ctr", "l.decay", "l.sure_qty")


def msq_sql(p: str = "") -> str:
    return f"""{cut_sql(p)},
{p}pay AS (SELECT *, price * sure // {SCALE} AS usd, price * sure // {SCALE} + price * sure // {SCALE} * 45 // 100000 AS pay FROM {p}cut WHERE side = 'ask' AND sure > 0),
{p}cum AS (SELECT *, sum(pay) OVER (PARTITION BY symbol ORDER BY k) AS upto FROM {p}pay),
{p}whole AS (SELECT symbol, sum(sure) AS qty, sum(usd) AS usd, max(upto) AS spent FROM {p}cum WHERE upto <= {BUDGET} GROUP BY symbol),
{p}edge AS (SELECT c.symbol, c.price, c.sure, {BUDGET} - coalesce(f.spent, 0) AS left_usd FROM {p}cum c LEFT JOIN {p}whole f USING (symbol) WHERE c.upto > {BUDGET} AND c.upto - c.pay <= {BUDGET}),
{p}part AS (SELECT symbol, any_value(price) AS price, max(q) AS qty FROM {p}edge, LATERAL (SELECT unnest(range(0, CAST(sure AS BIGINT) + 1)) AS q) WHERE price * q // {SCALE} + price * q // {SCALE} * 45 // 100000 <= left_usd GROUP BY symbol),
{p}msq AS (SELECT s.symbol, coalesce(f.qty, 0) + coalesce(t.qty, 0) AS qty, coalesce(f.usd, 0) + coalesce(t.price * t.qty // {SCALE}, 0) AS usd
  FROM {p}st s LEFT JOIN {p}whole f USING (symbol) LEFT JOIN {p}part t USING (symbol))"""


@query("max_safe_qty", f"""WITH RECURSIVE {WALK_SQL}, {at_sql(AT)}, {msq_sql()} SELECT symbol, CAST(CASE WHEN qty > 0 THEN qty END AS BIGINT) AS msq_qty, CAST(CASE WHEN qty > 0 THEN usd * {SCALE} // qty END AS BIGINT) AS msq_px FROM msq""")
def _(spark, sf):
    return book.max_safe_qty(book.book_at(updates(spark, sf), AT), BUDGET, scale=SCALE).select("symbol", "msq_qty", "msq_px")


AGE = 2 * 3_600_000_000


def ready_sql(at: int, p: str = "") -> str:
    return f"""{p}rd AS (SELECT *, CASE WHEN NOT consistent THEN 'RECOVERING' WHEN {at} - updated_us > {AGE} THEN 'BLIND_STALE' WHEN bid IS NULL OR ask IS NULL THEN 'EMPTY_BUT_VALID' ELSE 'READY' END AS readiness FROM {p}bbo)"""


@query("book_readiness", f"""WITH RECURSIVE {WALK_SQL}, {at_sql(AT)}, {ready_sql(AT)} SELECT symbol, readiness FROM rd""")
def _(spark, sf):
    return book.book_readiness(book.book_at(updates(spark, sf), AT), AT, max_age_us=AGE).select("symbol", "readiness")


def snap_sql(at: int, p: str = "") -> str:
    return f"""{at_sql(at, p)}, {msq_sql(p)}, {ready_sql(at, p)},
{p}snap AS (SELECT r.symbol, readiness, epoch, CAST(CASE WHEN readiness = 'READY' AND qty > 0 THEN qty END AS BIGINT) AS msq_qty,
  CAST(CASE WHEN readiness = 'READY' AND qty > 0 THEN usd * {SCALE} // qty END AS BIGINT) AS msq_px FROM {p}rd r JOIN {p}msq USING (symbol))"""


@query("cross_book_snapshot", f"""WITH RECURSIVE {WALK_SQL}, {snap_sql(AT)}
SELECT *, (SELECT bool_and(readiness = 'READY') FROM snap) AS all_ready,
  (SELECT arg_max(readiness, list_position(['READY', 'EMPTY_BUT_VALID', 'RECOVERING', 'BLIND_NETWORK', 'BLIND_STALE'], readiness)) FROM snap) AS worst_readiness FROM snap""")
def _(spark, sf):
    return book.cross_book_snapshot(updates(spark, sf), AT, BUDGET, max_age_us=AGE, scale=SCALE)


@query("snapshot_stable", f"""WITH RECURSIVE {WALK_SQL}, {snap_sql(AT)}, {snap_sql(LATER, 'z')}
SELECT a.symbol, a.epoch = b.epoch AS same_epoch, a.epoch = b.epoch OR (a.readiness = b.readiness AND (b.readiness <> 'READY'
  OR (a.msq_qty IS NOT DISTINCT FROM b.msq_qty AND a.msq_px IS NOT DISTINCT FROM b.msq_px))) AS stable FROM snap a JOIN zsnap b USING (symbol)""")
def _(spark, sf):
    u = updates(spark, sf)
    one, two = (book.cross_book_snapshot(u, at, BUDGET, max_age_us=AGE, scale=SCALE) for at in (AT, LATER))
    return book.snapshot_stable(one, two)


@query("spoof_trust", f"""WITH RECURSIVE {src.TICKS_SQL}, e AS (SELECT symbol, price % 5 AS price, ts_us, trade_id, (['trade', 'cancel', 'read'])[trade_id % 3 + 1] AS kind, size * (1 + trade_id % 7)::DOUBLE AS qty,
  row_number() OVER (PARTITION BY symbol, price % 5 ORDER BY ts_us, trade_id) AS n FROM ticks),
w AS (SELECT symbol, price, n, ts_us, trade_id, kind, CASE WHEN kind = 'trade' THEN qty ELSE 0 END AS t, CASE WHEN kind = 'cancel' THEN qty ELSE 0 END AS c, NULL::DOUBLE AS weight FROM e WHERE n = 1
  UNION ALL SELECT e.symbol, e.price, e.n, e.ts_us, e.trade_id, e.kind,
    CASE e.kind WHEN 'trade' THEN w.t + e.qty WHEN 'read' THEN w.t * CASE WHEN w.t + greatest(0, w.c - w.t) >= 1e-9 THEN 0.95 ELSE 1 END ELSE w.t END,
    CASE e.kind WHEN 'cancel' THEN w.c + e.qty WHEN 'read' THEN w.c * CASE WHEN w.t + greatest(0, w.c - w.t) >= 1e-9 THEN 0.95 ELSE 1 END ELSE w.c END,
    CASE WHEN e.kind = 'read' THEN CASE WHEN w.t + greatest(0, w.c - w.t) < 1e-9 THEN 1 ELSE least(1.0, 5.0 * w.t / (w.t + greatest(0, w.c - w.t))) END END
  FROM w JOIN e ON e.symbol = w.symbol AND e.price = w.price AND e.n = w.n + 1)
SELECT symbol, price, ts_us, trade_id AS event_id, round(CASE WHEN n = 1 THEN 1 ELSE weight END, 6) AS weight FROM w WHERE kind = 'read'""")
def _(spark, sf):
    t = src.ticks(spark, sf)
    kind = F.element_at(F.array(F.lit("trade"), F.lit("cancel"), F.lit("read")), (F.col("trade_id") % 3 + 1).cast("int"))
    ev = t.select("symbol", (F.col("price") % 5).alias("price"), "ts_us", F.col("trade_id").alias("event_id"), kind.alias("kind"),
                  (F.col("size") * (1 + F.col("trade_id") % 7)).cast("double").alias("qty"))
    return book.spoof_trust(ev).withColumn("weight", F.round("weight", 6))
