"""Orders, fills and positions against what the exchange reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeworks.plans.scans import affine_scan
from tapeworks.plans.slices import SLICE, running, slice_rows


def position_ledger(fills: DataFrame, order: list[str], *, n: int | None = None) -> DataFrame:
    """Quantity and average price after every fill (``symbol, side, qty, price``).

    Quantity never falls below zero: with S the signed prefix sum it is
    S - min(0, least S so far).  A buy then moves the average by its share of
    the new quantity, a sale leaves it: a linear recurrence.
    """
    signed = F.when(F.upper("side") == "BUY", F.col("qty")).otherwise(-F.col("qty")).cast("double")
    run = running(slice_rows(fills, ["symbol"], order, n), ["symbol"], order, {"_s": ("sum", signed)})
    run = running(run, ["symbol"], order, {"_m": ("min", F.col("_s"))})  # all three scans go over the same slices
    held = run.withColumn("position_qty", F.col("_s") - F.least(F.lit(0.0), F.col("_m"))).drop("_s", "_m")
    share = F.when((F.upper("side") == "BUY") & (F.col("position_qty") > 0), F.col("qty") / F.col("position_qty")).otherwise(0.0)
    held = held.withColumn("_w", share).withColumn("_f", 1.0 - F.col("_w")).withColumn("_o", F.col("_w") * F.col("price")).drop("_w").checkpoint(eager=True)
    return affine_scan(held, ["symbol"], order, "_f", "_o", "avg_px").drop("_f", "_o", SLICE)


def confirmed_positions(fills: DataFrame, order: list[str]) -> DataFrame:
    """Position of every symbol after its last fill."""
    last = F.max_by(F.struct("position_qty", "avg_px"), F.struct(*order))
    return position_ledger(fills, order).groupBy("symbol").agg(last.alias("_p")) \
        .select("symbol", F.col("_p.position_qty").alias("confirmed_qty"), F.col("_p.avg_px").alias("confirmed_avg_px"))


def shadow_position(confirmed: DataFrame, unresolved: DataFrame) -> DataFrame:
    """Positions if every unresolved order (``symbol, qty, worst_price``) filled at its worst price."""
    open_ = unresolved.groupBy("symbol").agg(F.sum("qty").alias("_q"), F.sum(F.col("qty") * F.col("worst_price")).alias("_c"), F.count("*").alias("_n"))
    zero = F.lit(0.0)
    both = confirmed.join(open_, "symbol", "full_outer").select(
        "symbol", F.coalesce("confirmed_qty", zero).alias("confirmed_qty"), F.coalesce("confirmed_avg_px", zero).alias("confirmed_avg_px"),
        F.coalesce("_q", zero).alias("_q"), F.coalesce("_c", zero).alias("_c"), F.coalesce("_n", F.lit(0)).alias("unresolved_count"))
    qty = F.col("confirmed_qty") + F.col("_q")
    avg = F.when(qty > 0, (F.col("confirmed_qty") * F.col("confirmed_avg_px") + F.col("_c")) / F.when(qty > 0, qty)).otherwise(F.col("confirmed_avg_px"))
    return both.withColumn("shadow_qty", qty).withColumn("_avg", avg) \
        .withColumn("shadow_avg_px", F.bround("_avg", 8)).withColumn("exposure", F.bround(F.col("shadow_qty") * F.col("_avg"), 2)).drop("_q", "_c", "_avg")


def strike_gate(confirmed: DataFrame, unresolved: DataFrame, limit: float) -> DataFrame:
    """Whether a symbol may trade: nothing unresolved on it, and total exposure under the limit."""
    exposure = confirmed.select(F.abs(F.col("confirmed_qty") * F.col("confirmed_avg_px")).alias("e")) \
        .unionByName(unresolved.select(F.abs(F.col("qty") * F.col("worst_price")).alias("e")))
    total = exposure.agg(F.coalesce(F.sum("e"), F.lit(0.0)).alias("total_exposure"))  # one row
    blocked = unresolved.select("symbol").distinct().withColumn("_blocked", F.lit(True))
    rows = confirmed.select("symbol").unionByName(unresolved.select("symbol")).distinct().join(blocked, "symbol", "left")
    return rows.withColumn("_one", F.lit(1)).join(F.broadcast(total.withColumn("_one", F.lit(1))), "_one") \
        .select("symbol", "total_exposure", (F.col("_blocked").isNull() & (F.col("total_exposure") < limit)).alias("allowed"))


def order_reconcile(unresolved: DataFrame, history: DataFrame) -> DataFrame:
    """Fate of unresolved orders from the exchange's order history (``cl_ord_id, status, filled_qty, avg_price``)."""
    s = F.upper("status")
    fate = (F.when(s.isNull(), "NEVER_RECEIVED").when(s == "FILLED", "FILLED").when(s.isin("PARTIALLYFILLED", "PARTIALLY_FILLED"), "PARTIALLY_FILLED")
            .when(s.isin("CANCELLED", "CANCELED", "DEACTIVATED"), "CANCELLED").when(s == "REJECTED", "REJECTED").otherwise("INDETERMINATE"))
    out = unresolved.join(history, "cl_ord_id", "left").withColumn("fate", fate)
    return out.withColumn("resolved", F.col("fate") != "INDETERMINATE").withColumn("filled_qty", F.coalesce("filled_qty", F.lit(0.0))) \
        .withColumn("avg_price", F.coalesce("avg_price", F.lit(0.0))).drop("status")


def position_arbitration(unresolved: DataFrame, positions: DataFrame, *, tolerance: float = 1e-8, consume: bool = True) -> DataFrame:
    """Attribute the exchange's surplus over the confirmed position to unresolved orders.

    ``unresolved``: cl_ord_id, symbol, qty, dispatched_us; ``positions``: symbol,
    exchange_qty, confirmed_qty.  Orders take from the surplus in dispatch order;
    without ``consume`` each order may claim all of it.
    """
    placed = running(unresolved, ["symbol"], ["dispatched_us", "cl_ord_id"], {"_before": ("sum", F.col("qty"), "exclusive")}).drop(SLICE)
    surplus = F.coalesce(F.col("exchange_qty") - F.col("confirmed_qty"), F.lit(0.0))
    left = surplus - F.coalesce("_before", F.lit(0)) if consume else surplus
    fill = F.when(surplus > tolerance, F.greatest(F.lit(0.0), F.least(F.col("qty").cast("double"), left))).otherwise(0.0)
    return placed.join(positions, "symbol", "left").withColumn("fill_qty", fill) \
        .select("cl_ord_id", "symbol", "qty", "fill_qty", F.when(F.col("fill_qty") > tolerance, "FILLED").otherwise("NEVER_RECEIVED").alias("fate"))


def position_gaps(local: DataFrame, exchange: DataFrame, quiet: DataFrame | None = None) -> DataFrame:
    """Local against exchange size per symbol: GHOST, ALIEN, DRIFT or OK; quiet symbols are skipped."""
    both = local.select("symbol", F.col("size").alias("local_size")).join(exchange.select("symbol", F.col("size").alias("exchange_size")), "symbol", "full_outer") \
        .select("symbol", F.coalesce("local_size", F.lit(0.0)).alias("local_size"), F.coalesce("exchange_size", F.lit(0.0)).alias("exchange_size"))
    if quiet is not None:
        both = both.join(quiet.select("symbol").distinct(), "symbol", "left_anti")
    a, b = F.col("local_size"), F.col("exchange_size")
    gap = F.when((b == 0) & (a != 0), "GHOST").when((b != 0) & (a == 0), "ALIEN").when(F.abs(b - a) > 1e-8, "DRIFT").otherwise("OK")
    return both.withColumn("gap", gap)


def position_symbols(local: DataFrame, exchange: DataFrame, *, majors: tuple[str, ...] = (), shedding: bool = False) -> DataFrame:
    """Symbols to audit; the essential set under load equals them, majors included only if present."""
    every = local.select("symbol").unionByName(exchange.where("size > 0").select("symbol")).distinct()
    if not shedding:
        return every
    essential = every.unionByName(local.sparkSession.createDataFrame([(m,) for m in majors], "symbol string")) if majors else every
    return every.join(essential.distinct(), "symbol", "left_semi")


def orphan_orders(exchange_orders: DataFrame, known: DataFrame, quiet: DataFrame) -> DataFrame:
    """Open exchange orders nobody here sent, outside quiet periods."""
    return exchange_orders.join(known.select("cl_ord_id").distinct(), "cl_ord_id", "left_anti") \
        .join(quiet.select("symbol").distinct(), "symbol", "left_anti")


def fill_drift(events: DataFrame) -> DataFrame:
    """Latest status per order and how far execution was from the pre-flight price
    (``cl_ord_id, ts_us, seq, status, pre_flight_price, execution_price``)."""
    at = F.struct("ts_us", "seq")
    last = events.groupBy("cl_ord_id").agg(F.max_by("status", at).alias("status"), F.max_by("pre_flight_price", at).alias("pre"),
                                           F.max_by("execution_price", F.when(F.col("execution_price").isNotNull(), at)).alias("exe"))
    return last.select("cl_ord_id", "status", F.abs(F.col("exe") - F.col("pre")).alias("drift"),
                       F.col("status").isin("PENDING", "DISPATCHED").alias("unresolved"))


def ledger_projection(events: DataFrame, whitelist: DataFrame, high_water_us: int) -> DataFrame:
    """State per symbol from an event log: last position and number of open orders.

    ``events``: kind (position / order), symbol, ts_us, seq, order_id, status,
    size, entry_price.  Older events and unknown orders are ignored; an order
    closed once stays closed.
    """
    fresh = events.where(F.col("ts_us") >= high_water_us)
    at = F.struct("ts_us", "seq")
    pos = fresh.where("kind = 'position'").groupBy("symbol").agg(F.max_by(F.struct("size", "entry_price"), at).alias("_p")).select("symbol", "_p.*")
    done = F.col("status").isin("Filled", "Cancelled", "Deactivated")
    live = fresh.where("kind = 'order'").join(whitelist.select("order_id").distinct(), "order_id", "left_semi") \
        .groupBy("symbol", "order_id").agg(F.bool_or(done).alias("closed")).where("NOT closed").groupBy("symbol").agg(F.count("*").alias("open_orders"))
    seen = fresh.select("symbol").distinct()
    return seen.join(pos, "symbol", "left").join(live, "symbol", "left").select(
        "symbol", F.coalesce("size", F.lit(0.0)).alias("size"), F.coalesce("entry_price", F.lit(0.0)).alias("entry_price"),
        F.coalesce("open_orders", F.lit(0)).alias("open_orders"))
