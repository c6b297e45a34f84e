"""Order books: message validity, reconstruction, depth, sizing, readiness."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeworks.functions.numeric import floor_div
from tapeworks.plans.folds import fold
from tapeworks.plans.lookup import lookup
from tapeworks.plans.scans import Step, scan

LEVEL = "struct<price: bigint, qty: bigint>"
# Price scale, taker fee, pessimism constants.
SCALE = 100_000_000
FEE_NUM, FEE_DEN = 45, 100_000
CANCEL_SHARE, CANCEL_REACH, SURVIVAL_TIME = 0.3, 10.0, 1.2


def validity_step():
    """Verdict per message header; state [last u, last seq, waiting deltas].

    u = 0 means "no anchor".  Deltas that wait for a snapshot are replayed after
    it when newer.  The running count is the book's epoch: it grows with every
    snapshot and every reset.
    """
    def step(state, rows: pd.DataFrame, epochs: int):
        u, seq, waiting = state[0], state[1], list(state[2])
        out, start = [], epochs
        cols = ("msg_id", "ts_us", "type", "u", "first_u", "seq")
        for mid, ts, kind, new, lo, s in zip(*(rows[c].tolist() for c in cols)):
            lo, s = (None if lo < 0 else lo), (None if s < 0 else s)
            if kind == "snapshot":
                u, seq, epochs = new, 0, epochs + 1
                out.append((mid, ts, mid, 0, "snapshot", epochs, u > 0))
                for k, (w_id, w_u, w_lo, w_s) in enumerate(sorted(waiting, key=lambda w: w[1]), 1):
                    if w_u <= u:
                        continue
                    if w_lo is not None and w_lo > u + 1:
                        u, seq, epochs = 0, 0, epochs + 1
                        out.append((w_id, ts, mid, k, "sequence_gap", epochs, False))
                        break
                    u, seq = w_u, (w_s if w_s is not None else seq)
                    out.append((w_id, ts, mid, k, "replayed", epochs, True))
                waiting = []
                continue
            if u == 0:
                waiting.append([mid, new, lo, s])
                verdict = "no_snapshot_anchor"
            elif lo is not None and new < lo:
                verdict, u, seq, epochs = "invalid_u_range", 0, 0, epochs + 1
            elif new <= u:
                verdict = "stale_or_duplicate_u"
            elif lo is not None and lo > u + 1:
                verdict, u, seq, epochs = "sequence_gap", 0, 0, epochs + 1
            elif s is not None and seq > 0 and s <= seq:
                verdict = "stale_or_duplicate_seq"
            else:
                verdict, u, seq = "ok", new, (s if s is not None else seq)
            out.append((mid, ts, mid, 0, verdict, epochs, u > 0))
        frame = pd.DataFrame(out, columns=["msg_id", "ts_us", "at_id", "step", "verdict", "epoch", "consistent"])
        return [u, seq, waiting], epochs - start, frame
    return step


def book_validity(headers: DataFrame, *, n: int | None = None) -> DataFrame:
    """Verdict, epoch and consistency after every message (``symbol, ts_us, msg_id, type, u, first_u, seq``).

    Only headers are folded; levels never leave the JVM.  Replayed deltas get a
    second row placed at their snapshot (``at_id``, ``step``).
    """
    absent = F.lit(-1).cast("long")  # a null would turn the batch's integers into floats
    return fold(headers.select("symbol", "ts_us", "msg_id", "type", "u", F.coalesce("first_u", absent).alias("first_u"),
                               F.coalesce("seq", absent).alias("seq")), ["symbol"], ["ts_us", "msg_id"],
                validity_step(), [0, 0, []],
                "msg_id BIGINT, ts_us BIGINT, at_id BIGINT, step BIGINT, verdict STRING, epoch BIGINT, consistent BOOLEAN", n=n)


def sequence_step():
    """Strict +1 sequence; state [last u, synced]."""
    def step(state, rows: pd.DataFrame, done: int):
        last, synced = state
        ok = []
        for kind, u in zip(rows["type"].tolist(), rows["u"].tolist()):
            if kind == "snapshot":
                last, synced, good = u, True, True
            elif kind != "delta" or not synced:
                good = False
            elif last > 0 and u != last + 1:
                good, synced = False, synced and u <= last
            else:
                last, good = u, True
            ok.append((good, synced))
        return [last, synced], 0, rows[["msg_id", "ts_us"]].assign(valid=[a for a, _ in ok], synced=[b for _, b in ok])
    return step


def sequence_guard(headers: DataFrame) -> DataFrame:
    """A delta is valid only as the successor of the last one; a gap waits for a snapshot."""
    return fold(headers.select("symbol", "ts_us", "msg_id", "type", "u"), ["symbol"], ["ts_us", "msg_id"], sequence_step(), [-1, False],
                "msg_id BIGINT, ts_us BIGINT, valid BOOLEAN, synced BOOLEAN")


def book_levels(updates: DataFrame, keep: tuple[str, ...] = ("symbol", "msg_id")) -> DataFrame:
    """One row per level of every message."""
    sides = F.array(F.struct(F.lit("bid").alias("side"), F.col("bids").alias("levels")), F.struct(F.lit("ask").alias("side"), F.col("asks").alias("levels")))
    one = updates.select(*keep, F.explode(sides).alias("_s"))
    return one.select(*keep, "_s.side", F.explode("_s.levels").alias("_l")).select(*keep, "side", "_l.price", "_l.qty")


def book_at(updates: DataFrame, at_us: int, *, depth: int | None = None, trades: DataFrame | None = None) -> DataFrame:
    """Books at a time: one row per symbol with state and sorted level arrays (the best ``depth`` levels, all if not given).

    The last quantity per price since the current epoch's snapshot counts; zero
    removes the level.  With ``trades`` (``symbol, ts_us, trade_id, price, qty, side``)
    a trade after a level's last update takes its quantity from the passive side.
    """
    verdicts = book_validity(updates.where(F.col("ts_us") <= at_us))
    order = F.struct("ts_us", "at_id", "step")
    state = verdicts.groupBy("symbol").agg(
        F.max_by(F.struct("epoch", "consistent"), order).alias("_s"),
        F.max(F.when(F.col("verdict").isin("ok", "snapshot", "replayed"), F.col("ts_us"))).alias("updated_us")) \
        .select("symbol", F.col("_s.epoch").alias("epoch"), F.col("_s.consistent").alias("consistent"), "updated_us")
    applied = verdicts.where(F.col("verdict").isin("ok", "snapshot", "replayed")).select("symbol", "msg_id", "epoch", order.alias("_o"))
    live = lookup(applied, state.where("consistent").select("symbol", "epoch"), ["symbol", "epoch"], "inner")
    # messages since the last snapshot are few: they select the updates before any level is unpacked
    current = lookup(updates.where(F.col("ts_us") <= at_us), live.select("symbol", "msg_id", "_o"), ["symbol", "msg_id"], "inner")
    levels = book_levels(current, ("symbol", "_o")) \
        .groupBy("symbol", "side", "price").agg(F.max_by(F.struct("qty", "_o"), "_o").alias("_q")) \
        .select("symbol", "side", "price", F.col("_q.qty").alias("qty"), F.col("_q._o.ts_us").alias("level_us"))
    if trades is not None:
        hit = trades.where(F.col("ts_us") <= at_us).select("symbol", F.when(F.lower("side") == "buy", "ask").otherwise("bid").alias("side"),
                                                           "price", F.col("ts_us").alias("trade_us"), F.col("qty").alias("traded"))
        after = hit.join(levels.select("symbol", "side", "price", "level_us"), ["symbol", "side", "price"]).where("trade_us > level_us") \
            .groupBy("symbol", "side", "price").agg(F.sum("traded").alias("traded"))
        levels = levels.join(after, ["symbol", "side", "price"], "left").withColumn("qty", F.col("qty") - F.coalesce("traded", F.lit(0)))
    near = F.when(F.col("side") == "bid", -F.col("price")).otherwise(F.col("price"))

    def stack(side: str) -> Column:
        sorted_ = F.array_sort(F.collect_list(F.when(F.col("side") == side, F.struct(near.alias("_k"), "price", "qty"))))
        cut = sorted_ if depth is None else F.slice(sorted_, 1, depth)
        return F.transform(cut, lambda l: F.struct(l["price"].alias("price"), l["qty"].alias("qty"))).alias(side + "s")
    stacks = levels.where("qty > 0").groupBy("symbol").agg(stack("bid"), stack("ask"))
    none = F.array().cast(f"array<{LEVEL}>")
    return state.join(stacks, "symbol", "left").withColumn("bids", F.coalesce("bids", none)).withColumn("asks", F.coalesce("asks", none))


def best(levels: Column) -> Column:
    return F.try_element_at(levels, F.lit(1))


def book_crossed(books: DataFrame) -> DataFrame:
    bid, ask = best(F.col("bids"))["price"], best(F.col("asks"))["price"]
    return books.withColumn("crossed", F.coalesce(bid >= ask, F.lit(False)))


def book_depth_usd(books: DataFrame, depth_bps: int = 15, scale: int = SCALE) -> DataFrame:
    """Value of both sides within a band around the integer mid; null without a two-sided, consistent book."""
    mid = floor_div(best(F.col("bids"))["price"] + best(F.col("asks"))["price"], 2)
    df = books.withColumn("_mid", mid).withColumn("_half", floor_div(F.col("_mid") * depth_bps, 10_000))

    def usd(levels: str, keep) -> Column:
        value = F.aggregate(F.filter(levels, keep), F.lit(0).cast("long"), lambda a, l: a + floor_div(l["price"].cast("decimal(38,0)") * l["qty"], scale))
        return F.when(F.col("consistent") & F.col("_mid").isNotNull(), value)
    return df.withColumn("bid_usd", usd("bids", lambda l: l["price"] >= F.col("_mid") - F.col("_half"))) \
        .withColumn("ask_usd", usd("asks", lambda l: l["price"] <= F.col("_mid") + F.col("_half"))).drop("_mid", "_half")


def book_vwap(levels: Column, target: float) -> Column:
    """Average price of trading ``target`` value through the levels; null when they are too thin."""
    start = F.struct(F.lit(float(target)).alias("left"), F.lit(0.0).alias("qty"))

    def take(acc, lv):
        qty = F.least(acc["left"] / lv["price"], lv["qty"].cast("double"))
        qty = F.when(acc["left"] > 0, qty).otherwise(0.0)
        return F.struct((acc["left"] - qty * lv["price"]).alias("left"), (acc["qty"] + qty).alias("qty"))
    done = F.aggregate(levels, start, take)
    return F.when(done["left"] <= 1e-9 * target, F.lit(float(target)) / done["qty"])


def liquidity_haircut(books: DataFrame, *, alpha: float = 1.0, beta: float = 0.5, gamma: float = 10.0) -> DataFrame:
    """Adds, per level, the share of quantity that survives cancels and decay (fixed point, 1024 = 1).

    The result columns ``bid_cut``/``ask_cut`` hold structs (price, qty, ctr, decay, sure_qty).
    """
    bid, ask = best(F.col("bids")), best(F.col("asks"))
    lean = F.signum((bid["qty"] - ask["qty"]).cast("double"))
    df = books.withColumn("_mid", (bid["price"] + ask["price"]) / 2.0).withColumn("_lean", lean)

    def cut(levels: str, toward: int) -> Column:
        def one(l, k):
            ctr = (F.lit(CANCEL_SHARE) * F.exp(-k / F.lit(CANCEL_REACH)) * 1024).cast("long")
            dist = F.abs(l["price"] - F.col("_mid")) / F.col("_mid")
            lam = alpha / (1.0 + gamma * dist) * (1.0 + beta * F.col("_lean") * toward)
            slot = F.greatest(F.lit(0), F.least(F.lit(1023), (lam * 100.0).cast("long")))
            decay = (F.exp(-(slot / 100.0) * SURVIVAL_TIME) * 1024).cast("long")
            ctr, decay = F.coalesce(ctr, F.lit(0)), F.coalesce(decay, F.lit(1024))
            sure = floor_div(l["qty"].cast("decimal(38,0)") * (1024 - ctr) * decay, 1 << 20)
            return F.struct(l["price"].alias("price"), l["qty"].alias("qty"), ctr.alias("ctr"), decay.alias("decay"), sure.alias("sure_qty"))
        return F.transform(levels, one)
    return df.withColumn("bid_cut", cut("bids", -1)).withColumn("ask_cut", cut("asks", 1)).drop("_mid", "_lean")


def max_safe_qty(books: DataFrame, budget: int, *, scale: int = SCALE) -> DataFrame:
    """Largest buy within a value budget, fees included, through the pessimistic asks.

    The level that does not fit is taken partly: value n is affordable when
    n + floor(n * fee) fits, so the largest n has a closed form; the quantity is
    the largest with that value.
    """
    def usd(price: Column, qty: Column) -> Column:
        return floor_div(price.cast("decimal(38,0)") * qty, scale)

    def fee(value: Column) -> Column:
        return floor_div(value * FEE_NUM, FEE_DEN)

    def take(acc, l):
        value = usd(l["price"], l["sure_qty"])
        pay = value + fee(value)
        left = acc["left"]
        guess = floor_div(left * FEE_DEN, FEE_NUM + FEE_DEN)
        top = F.when(guess + 1 + fee(guess + 1) <= left, guess + 1).otherwise(guess)
        part = F.least(l["sure_qty"], floor_div((top.cast("decimal(38,0)") + 1) * scale - 1, l["price"]))
        spent = usd(l["price"], part)
        live = ~acc["stop"] & (l["sure_qty"] > 0)
        whole = live & (pay <= left)
        some = live & (pay > left)
        return F.struct(
            F.when(whole, left - pay).when(some & (part > 0), left - spent - fee(spent)).otherwise(left).alias("left"),
            F.when(whole, acc["qty"] + l["sure_qty"]).when(some, acc["qty"] + part).otherwise(acc["qty"]).alias("qty"),
            F.when(whole, acc["usd"] + value).when(some, acc["usd"] + spent).otherwise(acc["usd"]).alias("usd"),
            (acc["stop"] | some).alias("stop"))
    zero = F.lit(0).cast("long")
    start = F.struct(F.lit(budget).cast("long").alias("left"), zero.alias("qty"), zero.alias("usd"), F.lit(False).alias("stop"))
    out = liquidity_haircut(books).withColumn("_m", F.when(F.col("consistent"), F.aggregate("ask_cut", start, take)))
    ok = F.col("_m.qty") > 0
    avg = floor_div(F.col("_m.usd").cast("decimal(38,0)") * scale, F.when(ok, F.col("_m.qty")))
    return out.withColumn("msq_qty", F.when(ok, F.col("_m.qty"))).withColumn("msq_px", F.when(ok, avg)).drop("_m", "bid_cut", "ask_cut")


# Readiness order, best first.
READINESS = ("READY", "EMPTY_BUT_VALID", "RECOVERING", "BLIND_NETWORK", "BLIND_STALE")


def book_readiness(books: DataFrame, now_us: int, *, max_age_us: int = 2_500_000, link: str | None = None, breaker_open: bool = False) -> DataFrame:
    """Whether a book can be trusted.  ``link`` is a column SYNCED / DESYNCED / RECOVERING."""
    state = F.col(link) if link else F.lit("SYNCED")
    status = (F.when(F.lit(breaker_open) | (state == "DESYNCED"), "BLIND_NETWORK").when(state == "RECOVERING", "RECOVERING")
              .when(~F.coalesce("consistent", F.lit(False)), "RECOVERING").when(now_us - F.col("updated_us") > max_age_us, "BLIND_STALE")
              .when((F.size("bids") == 0) | (F.size("asks") == 0), "EMPTY_BUT_VALID").otherwise("READY"))
    return books.withColumn("readiness", status)


def cross_book_snapshot(updates: DataFrame, at_us: int, budget: int, *, max_age_us: int = 2_500_000, scale: int = SCALE, depth: int | None = None) -> DataFrame:
    """Readiness, epoch and safe quantity of every book at one instant, with the overall verdict."""
    books = max_safe_qty(book_readiness(book_at(updates, at_us, depth=depth), at_us, max_age_us=max_age_us), budget, scale=scale)
    ready = F.col("readiness") == "READY"
    slices = books.select("symbol", "readiness", "epoch", F.when(ready, F.col("msq_qty")).alias("msq_qty"), F.when(ready, F.col("msq_px")).alias("msq_px"))
    rank = F.array_position(F.array(*[F.lit(r) for r in READINESS]), F.col("readiness"))
    overall = slices.agg(F.bool_and(F.col("readiness") == "READY").alias("all_ready"), F.max_by("readiness", rank).alias("worst_readiness")) \
        .withColumn("_one", F.lit(1))
    return slices.withColumn("_one", F.lit(1)).join(F.broadcast(overall), "_one").drop("_one")  # overall is one row


def snapshot_stable(earlier: DataFrame, later: DataFrame) -> DataFrame:
    """Per symbol: same epoch, or same readiness and safe quantity, in both snapshots."""
    a = earlier.select("symbol", *[F.col(c).alias("_" + c) for c in ("readiness", "epoch", "msq_qty", "msq_px")])
    both = a.join(later.select("symbol", "readiness", "epoch", "msq_qty", "msq_px"), "symbol", "left")
    same = F.col("readiness").eqNullSafe(F.col("_readiness")) & (
        (F.col("readiness") != "READY") | (F.col("msq_qty").eqNullSafe(F.col("_msq_qty")) & F.col("msq_px").eqNullSafe(F.col("_msq_px"))))
    epoch = F.col("epoch").eqNullSafe(F.col("_epoch"))
    return both.select("symbol", epoch.alias("same_epoch"), (epoch | (F.col("readiness").isNotNull() & same)).alias("stable"))


def spoof_trust(level_events: DataFrame, *, decay: float = 0.95) -> DataFrame:
    """Trust weight of a price level at each read.

    ``level_events``: symbol, price, ts_us, event_id, kind (trade / cancel / read), qty.  Traded and
    cancelled volume add up and fade at every read: two linear recurrences, looked at before the
    read's own fading.  Remainders under 1e-9 count as no volume, faded or not.
    """
    kind, qty = F.col("kind"), F.col("qty").cast("double")
    moves = level_events.select("symbol", "price", "ts_us", "event_id", "kind", F.when(kind.isin("trade", "cancel"), 1.0).otherwise(decay).alias("_left"),
                                F.when(kind == "trade", qty).otherwise(0.0).alias("_traded"), F.when(kind == "cancel", qty).otherwise(0.0).alias("_gone"))
    s = scan(moves, ["symbol", "price"], ["ts_us", "event_id"], {"traded": Step("_left", "_traded", exclusive=True), "gone": Step("_left", "_gone", exclusive=True)})
    active = F.greatest("traded", "gone")
    weight = F.when(active >= 1e-9, F.least(F.lit(1.0), 5.0 * F.col("traded") / active)).otherwise(1.0)
    return s.where(~kind.isin("trade", "cancel")).select("symbol", "price", "ts_us", "event_id", weight.alias("weight"))
