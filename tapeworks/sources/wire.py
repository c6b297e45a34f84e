"""Exchange wire messages (JSON text) as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeworks import schemas

SCALE_DIGITS = 8

# Wire keys differ by case only (s/S, u/U); the parsed structs get plain names.
_TRADE = ("struct<topic: string, type: string, ts: bigint, "
          "data: array<struct<ms: bigint, symbol: string, side: string, size: string, price: string>>>")
_BOOK = ("struct<topic: string, type: string, ts: bigint, data: struct<symbol: string, bids: array<array<string>>, "
         "asks: array<array<string>>, last_u: bigint, first_u: bigint, seq: bigint>>")


def scaled(text: Column) -> Column:
    """Decimal text as an integer scaled by 1e8, extra digits cut off; null when not a number."""
    t = F.trim(text)
    whole, frac = F.regexp_extract(t, r"^([+-]?\d+)(?:\.(\d*))?$", 1), F.regexp_extract(t, r"^([+-]?\d+)(?:\.(\d*))?$", 2)
    plain = F.concat(whole, F.rpad(F.substring(frac, 1, SCALE_DIGITS), SCALE_DIGITS, "0")).try_cast("long")
    other = t.try_cast("decimal(38,18)") * F.lit(10 ** SCALE_DIGITS)  # exponents, bare fractions
    return F.when(whole != "", plain).otherwise(F.when(other < 0, F.ceil(other)).otherwise(F.floor(other)).cast("long"))


def parse_trades(messages: DataFrame, value: str = "value") -> DataFrame:
    """Trade messages -> ticks.  Other topics and malformed text yield nothing.

    The topic test runs on the raw text before any JSON is decoded.
    """
    m = messages.where(F.col(value).contains("publicTrade")) \
        .withColumn("_m", F.from_json(value, schemas.TRADE_MESSAGE).cast(_TRADE)) \
        .where(F.col("_m.topic").startswith("publicTrade"))
    t = m.select("*", F.posexplode("_m.data").alias("seq", "_t"))
    return t.select(*[c for c in messages.columns if c != value],
                    F.element_at(F.split("_m.topic", r"\."), -1).alias("symbol"), F.col("seq").cast("long").alias("seq"),
                    (F.col("_t.ms") * 1000).alias("ts_us"), F.col("_t.side").alias("side"), scaled(F.col("_t.price")).alias("price"),
                    scaled(F.col("_t.size")).alias("size"), (F.col("_t.side") == "Sell").alias("is_buyer_maker")) \
        .where("price IS NOT NULL AND size IS NOT NULL AND ts_us IS NOT NULL AND side IS NOT NULL")


def parse_book(messages: DataFrame, value: str = "value") -> DataFrame:
    """Book messages -> one row per level, prices and quantities as scaled integers.

    Rows that are not [price, qty] pairs are skipped; update ids stay null when absent.
    """
    m = messages.where(F.col(value).contains("orderbook")) \
        .withColumn("_m", F.from_json(value, schemas.BOOK_MESSAGE).cast(_BOOK)).where(F.col("_m.topic").startswith("orderbook"))
    sides = F.explode(F.array(F.struct(F.lit("bid").alias("side"), F.col("_m.data.bids").alias("rows")),
                              F.struct(F.lit("ask").alias("side"), F.col("_m.data.asks").alias("rows"))))
    d = F.col("_m.data")
    rows = m.withColumn("_s", sides).select("*", F.posexplode("_s.rows").alias("level", "_r"))
    return rows.where(F.size("_r") >= 2).select(
        *[c for c in messages.columns if c != value], d["symbol"].alias("symbol"), F.col("_m.type").alias("type"),
        (F.col("_m.ts") * 1000).alias("ts_us"), d["last_u"].alias("u"), d["first_u"].alias("first_u"), d["seq"].alias("seq"),
        F.col("_s.side").alias("side"), F.col("level").cast("long").alias("level"), scaled(F.col("_r")[0]).alias("price"),
        scaled(F.col("_r")[1]).alias("qty")).where("price IS NOT NULL AND qty IS NOT NULL")


def parse_tickers(messages: DataFrame, value: str = "value") -> DataFrame:
    """Ticker list text -> symbol and turnover; missing, junk or negative turnover is 0."""
    rows = messages.select(F.explode(F.from_json(value, f"ARRAY<STRUCT<symbol: STRING, turnover24h: STRING>>")).alias("_t"))
    return rows.where("_t.symbol IS NOT NULL").select(
        F.col("_t.symbol").alias("symbol"),
        F.greatest(F.coalesce(F.col("_t.turnover24h").try_cast("double"), F.lit(0.0)), F.lit(0.0)).alias("turnover"))


def active_symbols(tickers: DataFrame, quote: str = "USDT") -> DataFrame:
    return tickers.where(F.col("symbol").endswith(quote)).select("symbol").distinct()


def read_log_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text lines with their place in the file: (file, block start, row in block)."""
    return spark.read.text(path).where(F.trim("value") != "").select(
        "value", F.struct(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                          F.monotonically_increasing_id().alias("row")).alias("line_no"))


def read_spillover(lines: DataFrame, schema: str, *, stop_at_torn: bool, line: str = "line_no") -> DataFrame:
    """Event log lines.  ``stop_at_torn`` keeps what precedes the first broken line
    and marks the log TAINTED; otherwise broken lines are skipped."""
    parsed = lines.withColumn("event", F.from_json("value", schema + ", _broken STRING", {"columnNameOfCorruptRecord": "_broken"})) \
        .withColumn("_bad", F.col("event").isNull() | F.col("event._broken").isNotNull())
    good = parsed.where("NOT _bad").select(line, "event")
    if not stop_at_torn:
        return good.withColumn("health", F.lit("CLEAN"))
    torn = parsed.where("_bad").agg(F.min(line).alias("_torn")).withColumn("_one", F.lit(1))  # always one row
    return good.withColumn("_one", F.lit(1)).join(F.broadcast(torn), "_one") \
        .where(F.col("_torn").isNull() | (F.col(line) < F.col("_torn"))) \
        .select(line, "event", F.when(F.col("_torn").isNull(), "CLEAN").otherwise("TAINTED_TORN_WRITE").alias("health"))
