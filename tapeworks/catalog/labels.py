"""Meta-labelling."""

from pyspark.sql import functions as F

from tapeworks.catalog import query
from tapeworks.catalog.bars import SPLIT_SQL, split
from tapeworks.operators import labels
from tapeworks.sources import tape as src

INTENT_SQL = SPLIT_SQL + """, intents AS (SELECT bar_idx * 8 + CAST(substr(symbol, 2) AS BIGINT) AS intent_id, symbol,
  CASE WHEN buy_notional >= sell_notional THEN 1 ELSE -1 END AS side, close AS entry_px, bar_idx + 1 AS entry_bar,
  2000 + bar_idx % 7 * 1500 AS tp_bps, 1500 + bar_idx % 5 * 1000 AS sl_bps, 3 + bar_idx % 6 AS max_bars, end_us FROM split),
pairs AS (SELECT i.*, b.bar_idx, b.high, b.low, b.close, b.end_us AS bar_us,
    entry_px * (10000 + side * tp_bps) // 10000 AS tp_px, entry_px * (10000 - side * sl_bps) // 10000 AS sl_px
  FROM intents i JOIN split b ON b.symbol = i.symbol AND b.bar_idx BETWEEN i.entry_bar AND i.entry_bar + i.max_bars),
flags AS (SELECT *, CASE WHEN side > 0 THEN low <= sl_px ELSE high >= sl_px END AS sl, CASE WHEN side > 0 THEN high >= tp_px ELSE low <= tp_px END AS tp FROM pairs),
ends AS (SELECT intent_id, min(bar_idx) AS exit_bar FROM flags WHERE sl OR tp OR bar_idx - entry_bar >= max_bars GROUP BY intent_id),
marks AS (SELECT f.intent_id, greatest(max(f.high), any_value(entry_px)) AS top, least(min(f.low), any_value(entry_px)) AS bottom
          FROM flags f JOIN ends e ON e.intent_id = f.intent_id AND f.bar_idx <= e.exit_bar GROUP BY f.intent_id),
lab0 AS (SELECT f.*, e.exit_bar, m.top, m.bottom, CASE WHEN sl THEN -1 WHEN tp THEN 1 ELSE 0 END AS label,
    CASE WHEN sl AND side > 0 THEN least(sl_px, low) WHEN sl THEN greatest(sl_px, high) WHEN tp THEN tp_px ELSE close END AS exit_px
  FROM ends e JOIN flags f ON f.intent_id = e.intent_id AND f.bar_idx = e.exit_bar JOIN marks m ON m.intent_id = e.intent_id),
labels AS (SELECT intent_id, symbol, CAST(side AS INTEGER) AS side, CAST(label AS INTEGER) AS label, entry_px, exit_px, entry_bar, exit_bar, exit_bar - entry_bar AS bars_held,
  CASE WHEN side > 0 THEN top - entry_px ELSE entry_px - bottom END AS mfe, CASE WHEN side > 0 THEN entry_px - bottom ELSE top - entry_px END AS mae,
  CAST(floor((side * (exit_px - entry_px) * 10000) / entry_px) AS BIGINT) AS pnl_bps FROM lab0)
"""


def intents_and_bars(spark, sf):
    bars = split(spark, sf).select("symbol", "bar_idx", "high", "low", "close", "buy_notional", "sell_notional", "end_us").checkpoint()
    i = F.col("bar_idx")
    intents = bars.select((i * 8 + F.substring("symbol", 2, 9).cast("long")).alias("intent_id"), "symbol",
                          F.when(F.col("buy_notional") >= F.col("sell_notional"), 1).otherwise(-1).alias("side"), F.col("close").alias("entry_px"),
                          (i + 1).alias("entry_bar"), (2000 + i % 7 * 1500).alias("tp_bps"), (1500 + i % 5 * 1000).alias("sl_bps"), (3 + i % 6).alias("max_bars"))
    return intents, bars


def barrier_labels(spark, sf):
    intents, bars = intents_and_bars(spark, sf)
    return labels.triple_barrier(intents, bars, block_bars=4), bars


@query("triple_barrier", INTENT_SQL + "SELECT * FROM labels")
def _(spark, sf):
    return barrier_labels(spark, sf)[0]


@query("label_stats", INTENT_SQL + """, last AS (SELECT l.label FROM labels l JOIN split b ON b.symbol = l.symbol AND b.bar_idx = l.exit_bar
  ORDER BY b.end_us DESC, l.intent_id DESC LIMIT 100)
SELECT count(*) FILTER (label = 1) AS wins, count(*) FILTER (label = -1) AS losses, count(*) FILTER (label = 0) AS timeouts FROM last""")
def _(spark, sf):
    lab, bars = barrier_labels(spark, sf)
    at = bars.select("symbol", F.col("bar_idx").alias("exit_bar"), F.col("end_us").alias("exit_us"))
    return labels.label_stats(lab.join(at, ["symbol", "exit_bar"]), 100)


# Feature vectors are the embeddings; two of three get a label, some twice.
LABEL_SQL = """raw AS (SELECT vec_id AS intent_id, vec_id % 4 AS n, CAST(vec_id % 3 - 1 AS INTEGER) AS label, vec_id * 10 AS exit_px, vec_id % 50 - 25 AS pnl_bps FROM embeddings WHERE vec_id % 3 <> 1
  UNION ALL SELECT vec_id, 9, CAST(1 AS INTEGER), vec_id * 11, CAST(7 AS BIGINT) FROM embeddings WHERE vec_id % 6 = 0),
labels_ AS (SELECT intent_id, arg_max(label, n) AS label, arg_max(exit_px, n) AS exit_px, arg_max(pnl_bps, n) AS pnl_bps FROM raw GROUP BY intent_id)"""


def feature_rows(spark, sf):
    e = src.table(spark, sf, "embeddings")
    v = F.col("vec_id")
    feats = e.select(v.alias("intent_id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * 1e6).cast("long")).alias("x"))
    a = e.where(v % 3 != 1).select(v.alias("intent_id"), (v % 4).alias("label_us"), v.alias("label_id"), (v % 3 - 1).cast("int").alias("label"),
                                   (v * 10).alias("exit_px"), (v % 50 - 25).alias("pnl_bps"))
    b = e.where(v % 6 == 0).select(v.alias("intent_id"), F.lit(9).cast("long").alias("label_us"), v.alias("label_id"), F.lit(1).alias("label"),
                                   (v * 11).alias("exit_px"), F.lit(7).cast("long").alias("pnl_bps"))
    return feats, a.unionByName(b)


@query("stitch_labels", f"WITH {LABEL_SQL} SELECT vec_id AS intent_id, l.label, l.exit_px, l.pnl_bps, l.label IS NOT NULL AS is_labeled FROM embeddings LEFT JOIN labels_ l ON l.intent_id = vec_id")
def _(spark, sf):
    return labels.stitch_labels(*feature_rows(spark, sf)).drop("x")


@query("unlabeled_features", "SELECT vec_id AS intent_id FROM embeddings WHERE vec_id % 3 = 1")
def _(spark, sf):
    return labels.unlabeled_features(*feature_rows(spark, sf)).select("intent_id")


@query("training_export", f"""WITH {LABEL_SQL} SELECT intent_id, CAST(floor(CAST(embedding[1] AS DOUBLE) * 1e6) AS BIGINT) AS x0,
  CAST(list_sum(list_transform(embedding, lambda v: floor(CAST(v AS DOUBLE) * 1e6))) AS BIGINT) AS x_sum, l.label AS y FROM embeddings JOIN labels_ l ON intent_id = vec_id""")
def _(spark, sf):
    out = labels.training_export(*feature_rows(spark, sf))
    return out.select("intent_id", F.col("x")[0].alias("x0"), F.aggregate("x", F.lit(0).cast("long"), lambda a, v: a + v).alias("x_sum"), "y")


FOLD_SQL = f"""WITH {src.TICKS_SQL}, e AS (SELECT trade_id AS event_id, ts_us AS t0, ts_us + size * 60000000 AS t1,
  row_number() OVER (ORDER BY ts_us, trade_id) - 1 AS idx, count(*) OVER () AS n FROM ticks),
own AS (SELECT *, CASE WHEN idx < (n % 5) * (n // 5 + 1) THEN idx // (n // 5 + 1) ELSE n % 5 + (idx - (n % 5) * (n // 5 + 1)) // (n // 5) END AS own FROM e),
b AS (SELECT own AS fold, min(t0) AS b0, arg_max(t1, idx) AS b1, least(max(idx) + 1 + CAST(floor(any_value(n) * 0.01) AS BIGINT), any_value(n) - 1) AS at FROM own GROUP BY own),
bb AS (SELECT b.*, e.t0 AS embargo FROM b JOIN e ON e.idx = b.at)
SELECT CAST(fold AS INTEGER) AS fold, event_id, CASE WHEN fold = own THEN 'test' ELSE 'train' END AS role FROM own, bb
WHERE fold = own OR (NOT (t0 <= b1 AND t1 >= b0) AND NOT (t0 > b1 AND t0 <= embargo))"""


@query("purged_kfold", FOLD_SQL)
def _(spark, sf):
    e = src.ticks(spark, sf).select(F.col("trade_id").alias("event_id"), F.col("ts_us").alias("t0"), (F.col("ts_us") + F.col("size") * 60_000_000).alias("t1"))
    return labels.purged_kfold(e)
