"""Liquidity detectors."""

from pyspark.sql import functions as F

from tapeworks.catalog import query
from tapeworks.operators import detectors as det
from tapeworks.sources import tape as src

HOUR = 3_600_000_000
SWEEP = dict(min_trades=3, window_us=4 * HOUR, min_notional=400_000, cooldown_us=6 * HOUR)
LARGE = dict(pct_threshold=0.003, min_notional=500_000, cooldown_us=8 * HOUR)
OFI = dict(bucket_us=2 * HOUR, history=60, k=3.0, min_notional=300_000, min_history=5, cooldown_us=5 * HOUR)

TURNOVER_SQL = "turnover AS (SELECT symbol, CAST(sum(notional) AS BIGINT) AS turnover FROM tape GROUP BY symbol)"

SWEEP_SQL = f"""walk AS (
  SELECT symbol, rn, ts_us, trade_id, price, side, CAST(NULL AS BIGINT) AS last_us, side AS run, notional AS total,
         CAST(1 AS BIGINT) AS cnt, ts_us AS first_us, false AS fired FROM tape WHERE rn = 1
  UNION ALL
  SELECT symbol, rn, ts_us, trade_id, price, side, CASE WHEN fire THEN ts_us ELSE last_us END,
         CASE WHEN cool THEN NULL ELSE side END, total, cnt, first_us, fire
  FROM (SELECT *, NOT cool AND same AND cnt >= {SWEEP['min_trades']} AND total >= {SWEEP['min_notional']} AS fire
        FROM (SELECT symbol, rn, ts_us, trade_id, price, side, last_us, cool, same,
                     CASE WHEN same THEN w_total ELSE 0 END + notional AS total, CASE WHEN same THEN w_cnt ELSE 0 END + 1 AS cnt,
                     CASE WHEN same THEN w_first ELSE ts_us END AS first_us
              FROM (SELECT t.*, w.last_us, w.total AS w_total, w.cnt AS w_cnt, w.first_us AS w_first,
                           coalesce(t.ts_us - w.last_us < {SWEEP['cooldown_us']}, false) AS cool,
                           coalesce(w.run = t.side AND NOT w.fired AND t.ts_us - w.first_us <= {SWEEP['window_us']}, false) AS same
                    FROM walk w JOIN tape t ON t.symbol = w.symbol AND t.rn = w.rn + 1)))),
sweeps AS (SELECT symbol, ts_us, trade_id, 'SWEEP' AS kind, lower(side) AS direction, price, total AS notional, cnt AS trade_count,
                  ts_us - first_us AS duration_us FROM walk WHERE fired)"""


def greedy_sql(name: str, source: str, cooldown: int, key: str = "symbol", ts: str = "ts_us", tie: str = "trade_id") -> str:
    """Rows of ``source`` that survive the cooldown, as ``name``."""
    return f"""{name}_n AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {ts}, {tie}) AS nth FROM {source}),
{name}_w AS (
  SELECT {key}, nth, {ts} AS last_us, true AS kept FROM {name}_n WHERE nth = 1
  UNION ALL
  SELECT c.*, CASE WHEN x.{ts} - w.last_us >= {cooldown} THEN x.{ts} ELSE w.last_us END, x.{ts} - w.last_us >= {cooldown}
  FROM {name}_w w JOIN {name}_n x ON {' AND '.join(f'x.{k.strip()} = w.{k.strip()}' for k in key.split(','))} AND x.nth = w.nth + 1,
       LATERAL (SELECT {', '.join('x.' + k.strip() for k in key.split(','))}, x.nth) c),
{name} AS (SELECT n.* EXCLUDE (nth) FROM {name}_n n JOIN {name}_w w USING ({key}, nth) WHERE w.kept)"""


LARGE_SQL = f"""{TURNOVER_SQL},
large_c AS (SELECT symbol, ts_us, trade_id, 'LARGE_PRINT' AS kind, lower(side) AS direction, price, notional,
                   notional / turnover AS pct_of_turnover
            FROM tape JOIN turnover USING (symbol)
            WHERE notional >= {LARGE['min_notional']} AND notional / turnover >= {LARGE['pct_threshold']}),
{greedy_sql('larges', 'large_c', LARGE['cooldown_us'])}"""

OFI_SQL = f"""keyed AS (SELECT *, ts_us - ts_us % {OFI['bucket_us']} AS bucket_us, CASE WHEN side = 'Sell' THEN -notional ELSE notional END AS signed FROM tape),
buckets AS (SELECT symbol, bucket_us, sum(signed) AS total, row_number() OVER (PARTITION BY symbol ORDER BY bucket_us) AS bn FROM keyed GROUP BY symbol, bucket_us),
medians AS (SELECT a.symbol, a.bucket_us, a.bn, median(CAST(abs(b.total) AS DOUBLE)) AS median_abs FROM buckets a JOIN buckets b
            ON a.symbol = b.symbol AND b.bn BETWEEN a.bn - {OFI['history'] - 1} AND a.bn - 1 GROUP BY a.symbol, a.bucket_us, a.bn),
flow AS (SELECT *, sum(signed) OVER (PARTITION BY symbol, bucket_us ORDER BY rn) AS ofi FROM keyed),
ofi_c AS (SELECT symbol, ts_us, trade_id, 'OFI_PULSE' AS kind, CASE WHEN ofi > 0 THEN 'buy' ELSE 'sell' END AS direction, price,
                 CAST(abs(ofi) AS BIGINT) AS notional, round(abs(ofi) / median_abs, 6) AS ratio_to_median, median_abs
          FROM flow JOIN medians USING (symbol, bucket_us)
          WHERE bn > {OFI['min_history']} AND abs(ofi) >= {OFI['min_notional']} AND abs(ofi) / median_abs >= {OFI['k']}),
{greedy_sql('pulses', 'ofi_c', OFI['cooldown_us'])}"""

BANK_SQL = f"""WITH RECURSIVE {src.TAPE_SQL}, {SWEEP_SQL}, {LARGE_SQL}, {OFI_SQL},
bank AS (SELECT * FROM sweeps UNION ALL BY NAME SELECT * REPLACE (round(pct_of_turnover, 9) AS pct_of_turnover) FROM larges UNION ALL BY NAME SELECT * FROM pulses)
"""


def bank(spark, sf, **kw):
    return bank_of(src.tape(spark, sf), **kw)


def bank_of(t, **kw):
    ofi = det.ofi_pulse(t, **OFI).withColumn("ratio_to_median", F.round("ratio_to_median", 6))
    large = det.large_print(t, t.groupBy("symbol").agg(F.sum("notional").alias("turnover")), **LARGE).withColumn("pct_of_turnover", F.round("pct_of_turnover", 9))
    return det.liquidity_bank(det.sweep(t, **SWEEP), large, ofi, **kw)


@query("turnover_lookup", f"""WITH {src.TAPE_SQL}, {TURNOVER_SQL}
SELECT trade_id, symbol, CASE WHEN symbol = 'S7' THEN 0 ELSE turnover END AS turnover FROM ticks JOIN turnover USING (symbol)""")
def _(spark, sf):
    known = src.turnover(spark, sf).where("symbol <> 'S7'")
    return det.turnover_lookup(src.ticks(spark, sf), known).select("trade_id", "symbol", "turnover")


@query("sweep", f"WITH RECURSIVE {src.TAPE_SQL}, {SWEEP_SQL} SELECT * FROM sweeps")
def _(spark, sf):
    return det.sweep(src.tape(spark, sf), **SWEEP)


@query("large_print", f"WITH RECURSIVE {src.TAPE_SQL}, {LARGE_SQL} SELECT * REPLACE (round(pct_of_turnover, 9) AS pct_of_turnover) FROM larges")
def _(spark, sf):
    return det.large_print(src.tape(spark, sf), src.turnover(spark, sf), **LARGE).withColumn("pct_of_turnover", F.round("pct_of_turnover", 9))


@query("ofi_pulse", f"WITH RECURSIVE {src.TAPE_SQL}, {OFI_SQL} SELECT * FROM pulses")
def _(spark, sf):
    return det.ofi_pulse(src.tape(spark, sf), **OFI).withColumn("ratio_to_median", F.round("ratio_to_median", 6))


@query("greedy_cooldown", f"""WITH RECURSIVE {src.TAPE_SQL}, big AS (SELECT symbol, ts_us, trade_id, notional FROM tape),
{greedy_sql('kept', 'big', 3 * HOUR)} SELECT * FROM kept""")
def _(spark, sf):
    big = src.tape(spark, sf).select("symbol", "ts_us", "trade_id", "notional")
    return det.greedy_cooldown(big, ["symbol"], 3 * HOUR)


@query("liquidity_bank", BANK_SQL + f", {greedy_sql('thin', 'bank', 12 * HOUR, key='kind, symbol')} SELECT * FROM thin")
def _(spark, sf):
    return bank(spark, sf, cooldown_us=12 * HOUR)


@query("liquidity_as_radar", BANK_SQL + """SELECT symbol, ts_us AS end_us, price AS open, price AS close, CAST(0 AS DOUBLE) AS vpin,
  CASE WHEN kind = 'OFI_PULSE' THEN ratio_to_median ELSE 0 END AS z_score, CASE WHEN direction = 'buy' THEN 'long' ELSE 'short' END AS direction,
  false AS absorption FROM bank""")
def _(spark, sf):
    return det.liquidity_as_radar(bank(spark, sf))
