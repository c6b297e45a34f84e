"""Column layouts shared by sources, operators and streams.

Money, prices and sizes are scaled integers (BIGINT) so that sums are exact;
times are exchange time in microseconds since the epoch (BIGINT ``ts_us``).
"""

TRADE_MESSAGE = ("topic STRING, type STRING, ts BIGINT, "
                 "data ARRAY<STRUCT<T: BIGINT, s: STRING, S: STRING, v: STRING, p: STRING>>")
BOOK_MESSAGE = ("topic STRING, type STRING, ts BIGINT, data STRUCT<s: STRING, b: ARRAY<ARRAY<STRING>>, "
                "a: ARRAY<ARRAY<STRING>>, u: BIGINT, U: BIGINT, seq: BIGINT>")
TICKER = "symbol STRING, turnover24h STRING"

TAPE = "symbol STRING, trade_id BIGINT, ts_us BIGINT, price BIGINT, size BIGINT, side STRING, notional BIGINT"

PARTIAL_BAR = ("bar_idx BIGINT, open BIGINT, high BIGINT, low BIGINT, close BIGINT, volume BIGINT, notional BIGINT, "
               "buy_notional BIGINT, sell_notional BIGINT, tick_count BIGINT, start_us BIGINT, end_us BIGINT, "
               "start_id BIGINT, end_id BIGINT, max_gap_us BIGINT, closed BOOLEAN")

LIQUIDITY_ALERT = ("ts_us BIGINT, trade_id BIGINT, kind STRING, direction STRING, price BIGINT, notional BIGINT, "
                   "trade_count BIGINT, duration_us BIGINT")
