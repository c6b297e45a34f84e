"""Wire messages, scalar scores and gates."""

from pyspark.sql import functions as F

from tapeworks.catalog import query
from tapeworks.functions import scoring
from tapeworks.plans.lookup import lookup
from tapeworks.sources import tape as src
from tapeworks.sources import wire


def dec(c):
    """Cents as decimal text with two digits."""
    return F.concat((F.floor(c / 100)).cast("string"), F.lit("."), F.lpad(F.pmod(c, F.lit(100)).cast("string"), 2, "0"))


def trade_messages(spark, sf):
    """Two trades per message; every 50th message is cut, every 7th has another topic."""
    t = src.ticks(spark, sf)
    body = F.to_json(F.struct(
        F.concat(F.when(F.col("trade_id") % 7 == 0, "tickers.").otherwise("publicTrade."), "symbol").alias("topic"),
        F.lit("snapshot").alias("type"), F.floor(F.col("ts_us") / 1000).alias("ts"),
        F.array(*[F.struct(F.floor(F.col("ts_us") / 1000).alias("T"), F.col("symbol").alias("s"), F.col("side").alias("S"),
                           (F.col("size") + i).cast("string").alias("v"), dec(F.col("price") + i).alias("p")) for i in (0, 1)]).alias("data")))
    return t.select(F.col("trade_id").alias("msg_id"), F.when(F.col("trade_id") % 50 == 1, F.substring(body, 1, 60)).otherwise(body).alias("value"))


@query("parse_trades", f"""WITH {src.TICKS_SQL} SELECT trade_id AS msg_id, symbol, CAST(i AS BIGINT) AS seq, ts_us // 1000 * 1000 AS ts_us, side,
  (price + i) * 1000000 AS price, (size + i) * 100000000 AS size, side = 'Sell' AS is_buyer_maker
FROM ticks, (VALUES (0), (1)) v(i) WHERE trade_id % 7 <> 0 AND trade_id % 50 <> 1""")
def _(spark, sf):
    return wire.parse_trades(trade_messages(spark, sf))


def book_messages(spark, sf):
    t = src.ticks(spark, sf).withColumn("price", F.greatest("price", F.lit(5)))
    level = lambda p, q: F.array(dec(p), q.cast("string"))
    p, q = F.col("price"), F.col("size")
    data = F.struct(F.col("symbol").alias("s"), F.array(level(p - 1, q), level(p - 2, q + 1), F.array(dec(p))).alias("b"),
                    F.array(level(p + 1, q + 2)).alias("a"), (F.col("trade_id") + 1).alias("u"),
                    F.when(F.col("trade_id") % 5 != 0, F.col("trade_id") + 1).alias("U"), F.col("trade_id").alias("seq"))
    return t.select(F.col("trade_id").alias("msg_id"), F.to_json(F.struct(
        F.concat(F.lit("orderbook.50."), "symbol").alias("topic"), F.when(F.col("trade_id") % 5 == 0, "snapshot").otherwise("delta").alias("type"),
        F.floor(F.col("ts_us") / 1000).alias("ts"), data.alias("data"))).alias("value"))


@query("parse_book", f"""WITH {src.TICKS_SQL}, l AS (
  SELECT *, 'bid' AS lside, 0 AS level, greatest(price, 5) - 1 AS lp, size AS lq FROM ticks
  UNION ALL SELECT *, 'bid', 1, greatest(price, 5) - 2, size + 1 FROM ticks
  UNION ALL SELECT *, 'ask', 0, greatest(price, 5) + 1, size + 2 FROM ticks)
SELECT trade_id AS msg_id, symbol, CASE WHEN trade_id % 5 = 0 THEN 'snapshot' ELSE 'delta' END AS type, ts_us // 1000 * 1000 AS ts_us,
  trade_id + 1 AS u, CASE WHEN trade_id % 5 <> 0 THEN trade_id + 1 END AS first_u, trade_id AS seq, lside AS side,
  CAST(level AS BIGINT) AS level, lp * 1000000 AS price, lq * 100000000 AS qty FROM l""")
def _(spark, sf):
    return wire.parse_book(book_messages(spark, sf))


def ticker_messages(spark, sf):
    """One ticker list per customer; turnover text is at times empty, junk or negative."""
    raw = F.when(F.col("c_custkey") % 11 == 0, "").when(F.col("c_custkey") % 13 == 0, "n/a").otherwise(F.col("c_acctbal").cast("string"))
    name = F.concat(F.lit("C"), F.col("c_custkey").cast("string"), F.when(F.col("c_custkey") % 3 == 0, "USDC").otherwise("USDT"))
    return src.table(spark, sf, "customer").select(F.to_json(F.array(F.struct(name.alias("symbol"), raw.alias("turnover24h")))).alias("value"))


TICKER_SQL = """tickers AS (SELECT 'C' || c_custkey || CASE WHEN c_custkey % 3 = 0 THEN 'USDC' ELSE 'USDT' END AS symbol,
  CASE WHEN c_custkey % 11 = 0 OR c_custkey % 13 = 0 THEN 0.0 ELSE greatest(c_acctbal, 0.0) END AS turnover FROM customer)"""


@query("parse_tickers", f"WITH {TICKER_SQL} SELECT symbol, turnover FROM tickers")
def _(spark, sf):
    return wire.parse_tickers(ticker_messages(spark, sf))


@query("active_symbols", f"WITH {TICKER_SQL} SELECT DISTINCT symbol FROM tickers WHERE symbol LIKE '%USDT'")
def _(spark, sf):
    return wire.active_symbols(wire.parse_tickers(ticker_messages(spark, sf)))


@query("seed_trades", f"""WITH {src.TAPE_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts_us DESC, trade_id DESC) AS back FROM tape)
SELECT symbol, trade_id, ts_us, price, size, side, notional FROM n WHERE back <= 1000""")
def _(spark, sf):
    back = dense_index_desc(src.tape(spark, sf))
    return back.where("back < 1000").drop("back")


def dense_index_desc(tape):
    from tapeworks.plans.slices import running
    out = running(tape, ["symbol"], ["ts_us", "trade_id"], {"back": ("sum", F.lit(1).cast("long"))}, reverse=True)
    return out.withColumn("back", F.col("back") - 1)


def log_lines(spark, sf):
    """Event rows as JSON lines; lines around 40 % of the ids are torn."""
    t = src.table(spark, sf, "events")
    body = F.to_json(F.struct("event_id", "user_id", "event_type"))
    torn = (F.col("event_id") > 400) & (F.col("event_id") % 97 == 0)
    return t.select(F.col("event_id").alias("line_no"), F.when(torn, F.substring(body, 1, 12)).otherwise(body).alias("value"))


LOG = "event_id BIGINT, user_id BIGINT, event_type STRING"


@query("read_spillover", """SELECT event_id AS line_no, user_id, event_type, 'CLEAN' AS health FROM events WHERE NOT (event_id > 400 AND event_id % 97 = 0)""")
def _(spark, sf):
    return wire.read_spillover(log_lines(spark, sf), LOG, stop_at_torn=False).select("line_no", "event.user_id", "event.event_type", "health")


@query("read_spillover_strict", """SELECT event_id AS line_no, user_id, event_type, 'TAINTED_TORN_WRITE' AS health FROM events
WHERE event_id < (SELECT min(event_id) FROM events WHERE event_id > 400 AND event_id % 97 = 0)""")
def _(spark, sf):
    return wire.read_spillover(log_lines(spark, sf), LOG, stop_at_torn=True).select("line_no", "event.user_id", "event.event_type", "health")


@query("notional_polarity", f"WITH {src.TICKS_SQL} SELECT trade_id, symbol, notional, side = 'Sell' AS is_buyer_maker FROM ticks")
def _(spark, sf):
    return scoring.notional_polarity(src.ticks(spark, sf).drop("notional")).select("trade_id", "symbol", "notional", "is_buyer_maker")


@query("adaptive_threshold", f"""WITH {TICKER_SQL}, src AS (SELECT 'C' || o_custkey || CASE WHEN o_custkey % 3 = 0 THEN 'USDC' ELSE 'USDT' END AS symbol, o_orderkey FROM orders)
SELECT o_orderkey, s.symbol, CASE WHEN t.turnover > 0 AND s.symbol LIKE '%USDT' THEN round(greatest(least(t.turnover * 1e5 / 200, 5e6), 2e4), 2) ELSE 1e6 END AS threshold
FROM src s LEFT JOIN tickers t USING (symbol)""")
def _(spark, sf):
    name = F.concat(F.lit("C"), F.col("o_custkey").cast("string"), F.when(F.col("o_custkey") % 3 == 0, "USDC").otherwise("USDT"))
    orders = src.table(spark, sf, "orders").select("o_orderkey", name.alias("symbol"))
    table = wire.parse_tickers(ticker_messages(spark, sf)).where(F.col("symbol").endswith("USDT"))
    known = table.select("symbol", (F.col("turnover") * 1e5).alias("turnover"))
    return lookup(orders, known, ["symbol"]).select("o_orderkey", "symbol", scoring.adaptive_threshold(F.col("turnover")).alias("threshold"))


@query("sensitivity_params", """WITH t AS (SELECT c_custkey, CASE c_mktsegment WHEN 'HOUSEHOLD' THEN ' Conservative' WHEN 'MACHINERY' THEN 'SCANNER ' WHEN 'FURNITURE' THEN '' ELSE 'active' END AS tier FROM customer)
SELECT c_custkey, CASE lower(trim(tier)) WHEN 'conservative' THEN 2.5::DOUBLE WHEN 'scanner' THEN 1.7::DOUBLE ELSE 2.0::DOUBLE END AS z_threshold,
  CAST(CASE lower(trim(tier)) WHEN 'scanner' THEN 30 ELSE 50 END AS INTEGER) AS vpin_window,
  CASE lower(trim(tier)) WHEN 'conservative' THEN 600::DOUBLE WHEN 'scanner' THEN 120::DOUBLE ELSE 300::DOUBLE END AS cooldown_sec FROM t""")
def _(spark, sf):
    seg = F.col("c_mktsegment")
    tier = F.when(seg == "HOUSEHOLD", " Conservative").when(seg == "MACHINERY", "SCANNER ").when(seg == "FURNITURE", "").otherwise("active")
    return src.table(spark, sf, "customer").select("c_custkey", scoring.sensitivity_params(tier).alias("p")).select("c_custkey", "p.*")


@query("signal_score", """SELECT event_id, round_even(least(1.0, (value / 397) / 0.8) * 100, 1) AS micro_base,
  round_even(CASE WHEN user_id % 4 = 0 THEN 0.5 ELSE (user_id % 4) / 4.0 END * 100, 1)::DOUBLE AS sent_contrib,
  CAST(trunc(least(1.0, (value / 397) / 0.8) * 100 * 0.85 + CASE WHEN user_id % 4 = 0 THEN 0.5::DOUBLE ELSE (user_id % 4) / 4.0::DOUBLE END * 100 * 0.15) AS INTEGER) AS final_score FROM events""")
def _(spark, sf):
    prob = F.when(F.col("user_id") % 4 != 0, (F.col("user_id") % 4) / 4.0)
    return src.table(spark, sf, "events").select("event_id", scoring.signal_score(F.col("value") / 397, prob).alias("s")).select("event_id", "s.*")


@query("alpha_decay_score", """SELECT event_id, round(value * exp(-0.001 * exp(-5 * ((user_id % 21) / 10.0 - 1)) * (event_id % 5000)), 6) AS score FROM events""")
def _(spark, sf):
    return src.table(spark, sf, "events").select("event_id", F.round(scoring.alpha_decay_score(
        F.col("value"), F.col("event_id") % 5000, (F.col("user_id") % 21) / 10.0 - 1), 6).alias("score"))


@query("amputation_price", """SELECT event_id, CAST(CASE WHEN event_type IN ('purchase', 'click', 'view')
  THEN greatest(CAST(value AS DECIMAL(18, 2)) - 0.5, CAST(value AS DECIMAL(18, 2)) * (1 - 0.0015))
  ELSE least(CAST(value AS DECIMAL(18, 2)) + 0.5, CAST(value AS DECIMAL(18, 2)) * (1 + 0.0015)) END AS DOUBLE) AS price FROM events""")
def _(spark, sf):
    entry = F.col("value").cast("decimal(18,2)")
    side = F.when(F.col("event_type").isin(*src.BUY_TYPES), "Buy").otherwise("Sell")
    best = F.when(side == "Buy", entry - F.lit("0.5").cast("decimal(4,1)")).otherwise(entry + F.lit("0.5").cast("decimal(4,1)"))
    return src.table(spark, sf, "events").select("event_id", scoring.amputation_price(entry, side, best).cast("double").alias("price"))


@query("microprice", f"""WITH {src.TICKS_SQL}, q AS (SELECT trade_id, price - 1 AS bp, price + 1 + trade_id % 3 AS ap, size AS bv, (trade_id * 7) % 50 AS av FROM ticks)
SELECT trade_id, CASE WHEN bv + av = 0 THEN (bp + ap) / 2.0::DOUBLE ELSE round((bp * av + ap * bv) / (bv + av), 6) END AS microprice,
  CASE WHEN bv + av = 0 THEN 0.0::DOUBLE ELSE round((bv - av) / (bv + av), 6) END AS imbalance, ap - bp AS spread FROM q""")
def _(spark, sf):
    return l1(spark, sf).select("trade_id", F.round("m.microprice", 6).alias("microprice"), F.round("m.imbalance", 6).alias("imbalance"), "m.spread")


def l1(spark, sf):
    bid, ask = F.col("price") - 1, F.col("price") + 1 + F.col("trade_id") % 3
    return src.ticks(spark, sf).select("symbol", "trade_id", bid.alias("bid"), ask.alias("ask"),
                                       scoring.microprice(bid, F.col("size"), ask, (F.col("trade_id") * 7) % 50).alias("m"))


@query("imbalance_state", f"""WITH {src.TICKS_SQL}, q AS (SELECT trade_id, price - 1 AS bp, price + 1 + trade_id % 3 AS ap, size AS bv, (trade_id * 7) % 50 AS av FROM ticks),
i AS (SELECT *, CASE WHEN bv + av = 0 THEN 0.0 ELSE (bv - av) / (bv + av) END AS imb FROM q)
SELECT trade_id, CASE WHEN trade_id % 9 = 0 THEN 'IDLE' WHEN imb > 0.55 THEN 'BUY_IMPULSE' WHEN imb < -0.55 THEN 'SELL_IMPULSE' ELSE 'IDLE' END AS state FROM i""")
def _(spark, sf):
    crossed = F.when(F.col("trade_id") % 9 == 0, F.col("ask")).otherwise(F.col("bid"))
    return l1(spark, sf).select("trade_id", scoring.imbalance_state(crossed, F.col("ask"), F.col("m.imbalance")).alias("state"))


@query("transit_lag", f"""WITH {src.TICKS_SQL} SELECT symbol, count(*) AS checked, count(*) FILTER (trade_id % 3 < 2 AND trade_id % 300 - 20 > 150) AS dropped,
  round(count(*) FILTER (trade_id % 3 < 2 AND trade_id % 300 - 20 > 150) / count(*), 6) AS drop_ratio FROM ticks GROUP BY symbol""")
def _(spark, sf):
    ms = F.floor(F.col("ts_us") / 1000)
    key = F.element_at(F.array(F.lit('{"ts":'), F.lit('{"a": 1, "E": '), F.lit('{"x": ')), (F.col("trade_id") % 3 + 1).cast("int"))
    raw = F.concat(key, ms.cast("string"), F.lit(', "s": 1}'))
    lag = scoring.transit_lag(raw, ms + F.col("trade_id") % 300, 20)
    dead = F.coalesce(lag > 150, F.lit(False))
    return src.ticks(spark, sf).select("symbol", dead.alias("dead")).groupBy("symbol").agg(
        F.count("*").alias("checked"), F.count(F.when(F.col("dead"), 1)).alias("dropped"),
        F.round(F.avg(F.col("dead").cast("int")), 6).alias("drop_ratio"))


@query("alpha_intent", f"""WITH {src.TICKS_SQL} SELECT trade_id, symbol, CASE WHEN price % 41 - 20 < 0 THEN 'SELL' ELSE 'BUY' END AS side,
  CASE WHEN price % 41 - 20 < 0 THEN price - 1 ELSE price + 1 END AS price,
  least(CASE WHEN price % 41 - 20 < 0 THEN size / 10.0 + size / 20.0 ELSE (size % 5) / 10.0 + 1 END, 5.0)::DOUBLE AS qty, CAST(5000 AS INTEGER) AS ttl_ms
FROM ticks WHERE (size / 100.0) >= 0.4 AND abs(price % 41 - 20) > 10""")
def _(spark, sf):
    lv = lambda p, q: F.struct(p.alias("price"), q.alias("qty"))
    p, s = F.col("price"), F.col("size")
    sig = src.ticks(spark, sf).select(
        "trade_id", "symbol", (s / 100).alias("vpin"), (p % 41 - 20).alias("leader_roc_bps"),
        F.array(lv(p - 1, s / 10), lv(p - 2, s / 20), lv(p - 3, s / 1)).alias("bids"),
        F.array(lv(p + 1, (s % 5) / 10), lv(p + 2, F.lit(1.0)), lv(p + 3, s / 1)).alias("asks"))
    return scoring.alpha_intent(sig, vpin_threshold=0.4)
