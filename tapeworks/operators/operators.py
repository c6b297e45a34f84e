"""The human operator: clicks, permits, attention, chat."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeworks.plans.folds import fold
from tapeworks.plans.slices import previous, running


def click_step(ttl_us: int):
    """Verdict of clicks against the active intent; state [intent, emitted at, revoked]."""
    def step(state, rows: pd.DataFrame, versions: int):
        intent, since, revoked = state
        out, bumps = [], 0
        for ts, eid, kind, ref in zip(*(rows[c].tolist() for c in ("ts_us", "event_id", "kind", "intent_id"))):
            verdict = None
            if kind == "emit":
                intent, since, revoked, bumps = ref, ts, False, bumps + 1
            elif kind == "revoke":
                if intent is not None and not revoked:
                    revoked, bumps = True, bumps + 1
            elif intent is None:
                verdict = "NO_ACTIVE"
            elif ref != intent:
                verdict = "STALE"
            elif revoked:
                verdict = "REVOKED"
            elif ts - since > ttl_us:
                verdict, revoked, bumps = "TTL_EXPIRED", True, bumps + 1
            else:
                verdict = "OK"
            if verdict is not None:
                out.append((ts, eid, ref, verdict, versions + bumps))
        frame = pd.DataFrame(out, columns=["ts_us", "event_id", "intent_id", "verdict", "version"]) if out else None
        return [intent, since, revoked], bumps, frame
    return step


def click_audit(events: DataFrame, *, ttl_us: int = 5_000_000) -> DataFrame:
    """Clicks judged against emits and revokes of the same desk.

    ``events``: desk, ts_us, event_id, kind (emit / revoke / click), intent_id.
    Every emit and effective revoke raises the version; a late click revokes its intent.
    """
    events = events.withColumn("intent_id", F.coalesce("intent_id", F.lit(-1).cast("long")))
    return fold(events, ["desk"], ["ts_us", "event_id"], click_step(ttl_us), [None, None, False],
                "ts_us BIGINT, event_id BIGINT, intent_id BIGINT, verdict STRING, version BIGINT")


def capsule_audit(submissions: DataFrame, issuances: DataFrame, *, ttl_us: int = 1_200_000, skew_us: int = 100_000) -> DataFrame:
    """Verdict per submitted permit.

    ``issuances``: nonce, issued_us, tilt_generation; ``submissions``: submission_id,
    nonce, ts_us, current_generation, locked.  Only an accepted permit uses up its nonce.
    """
    age = F.col("ts_us") - F.col("issued_us")
    reason = (F.when(F.col("issued_us").isNull(), "UNKNOWN_NONCE").when(age > ttl_us, "TTL_EXPIRED").when(age < -skew_us, "CLOCK_MANIPULATION")
              .when(F.col("tilt_generation") != F.col("current_generation"), "TILT_GEN_MISMATCH").when(F.col("locked"), "TILT_LOCKED").otherwise("OK"))
    judged = submissions.join(issuances, "nonce", "left").withColumn("_r", reason).withColumn("_at", F.struct("ts_us", "submission_id"))
    used = judged.where("_r = 'OK'").groupBy("nonce").agg(F.min("_at").alias("_first"))
    replay = F.coalesce(F.col("_at") > F.col("_first"), F.lit(False))
    return judged.join(used, "nonce", "left").select("submission_id", "nonce", "ts_us", F.when(replay, "NONCE_REPLAY").otherwise(F.col("_r")).alias("verdict"))


def rejection_stats(verdicts: DataFrame) -> DataFrame:
    return verdicts.groupBy("verdict").agg(F.count("*").alias("n"))


# Score weights, thresholds and detector constants.
WEIGHTS = (0.40, 0.35, 0.25)
ELEVATED, CRITICAL, CLEAR_BELOW = 0.4, 0.7, 0.35
LOCK_US = 60_000_000
SAMPLE_KEEP, SAMPLE_MIN, REACTION_ALPHA = 20, 5, 0.15
MAX_TOKENS, BURST_KEEP, BURST_US, RAPID_US = 5.0, 10, 500_000, 10_000_000

FRESH = {"n": 0, "last": 0.0, "ewma": 0.0, "tokens": MAX_TOKENS, "refill": None, "burst": [], "rapid": 0, "rapid_from": None, "streak": 0}


def _reaction(s: dict, ms: float) -> None:
    if 0.0 < ms < 30_000.0:
        s["ewma"] = ms if s["ewma"] == 0.0 else REACTION_ALPHA * ms + (1.0 - REACTION_ALPHA) * s["ewma"]
        s["n"], s["last"] = min(s["n"] + 1, SAMPLE_KEEP), ms


def _clicks(s: dict, n: int, now: int) -> None:
    """n clicks at one instant: one refill, n tokens, n burst marks."""
    if n <= 0:
        return
    refill, start = (now if s[k] is None else s[k] for k in ("refill", "rapid_from"))
    s["tokens"] = max(0.0, min(MAX_TOKENS, s["tokens"] + max(0, now - refill) / 1e6) - n)
    s["burst"] = (s["burst"] + [now] * min(n, BURST_KEEP))[-BURST_KEEP:]
    if now - start > RAPID_US:
        s["rapid"], start = 0, now
    s["rapid"], s["refill"], s["rapid_from"] = s["rapid"] + n, now, start


def _scores(s: dict, now: int) -> tuple[float, float, float]:
    drift = abs(s["last"] - s["ewma"]) / s["ewma"] if s["n"] >= SAMPLE_MIN and s["ewma"] > 0 else 0.0
    dense = 0
    for mark in reversed(s["burst"]):
        if now - mark > BURST_US:
            break
        dense += 1
    elapsed = max(0.1, (now - (s["rapid_from"] or 0)) / 1e6)
    spam = (1.0 - s["tokens"] / MAX_TOKENS) * 2.0 + max(0.0, dense - 2) / 3.0 * 3.0 + max(0.0, s["rapid"] / elapsed - 0.5)
    parts = (min(drift / 2.0, 1.0), min(s["streak"] / 4.0, 1.0), min(spam / 5.0, 1.0))
    return drift, spam, min(1.0, max(0.0, sum(w * p for w, p in zip(WEIGHTS, parts))))


def heartbeat_step(lock_us: int = LOCK_US):
    """Tilt score of one operator; state [detectors, mode, locked until]."""
    def step(state, rows: pd.DataFrame, done: int):
        s, mode, until = {**state[0]}, state[1], state[2]
        out = []
        for ts, hid, ms, clicks, errors, wins in zip(*(rows[c].tolist() for c in ("ts_us", "beat_id", "reaction_ms", "click_count", "error_delta", "success_delta"))):
            if ms > 0:
                _reaction(s, ms)
            _clicks(s, max(0, min(1000, clicks)), ts)
            s["streak"] = max(0, s["streak"] + errors - 2 * wins) if wins > 0 else s["streak"] + errors
            if mode == "LOCKED":
                mode = "COOLDOWN"
            if mode == "COOLDOWN" and ts >= until:
                mode, until, s = "CLEAR", 0, {**FRESH}
            drift, spam, score = _scores(s, ts)
            if mode in ("CLEAR", "ELEVATED"):
                if score >= CRITICAL:
                    mode, until = "LOCKED", ts + lock_us
                elif score >= ELEVATED:
                    mode = "ELEVATED"
                elif score < CLEAR_BELOW:
                    mode = "CLEAR"
            out.append((ts, hid, round(drift, 4), s["streak"], round(spam, 4), round(score, 4), mode, until))
        frame = pd.DataFrame(out, columns=["ts_us", "beat_id", "reaction_drift", "error_streak", "spam_intensity", "composite", "state", "locked_until_us"])
        return [s, mode, until], 0, frame
    return step


def heartbeat_score(beats: DataFrame, *, lock_us: int = LOCK_US, n: int | None = None) -> DataFrame:
    """Tilt score and state at every heartbeat
    (``operator_id, ts_us, beat_id, reaction_ms, click_count, error_delta, success_delta``)."""
    return fold(beats, ["operator_id"], ["ts_us", "beat_id"], heartbeat_step(lock_us), [FRESH, "CLEAR", 0],
                "ts_us BIGINT, beat_id BIGINT, reaction_drift DOUBLE, error_streak BIGINT, spam_intensity DOUBLE, composite DOUBLE, "
                "state STRING, locked_until_us BIGINT", n=n)


def silences(events: DataFrame, keys: list[str], limit_us: int, *, ts: str = "ts_us", tie: str = "event_id") -> DataFrame:
    """Gaps longer than ``limit_us``: when the silence was noticed and when it ended (null at the end of the data)."""
    nxt = previous(events.select(*keys, ts, tie), keys, [ts, tie], {"cleared_us": ts}, reverse=True)
    return nxt.where(F.col("cleared_us").isNull() | (F.col("cleared_us") - F.col(ts) > limit_us)) \
        .select(*keys, F.col(ts).alias("last_us"), (F.col(ts) + limit_us).alias("noticed_us"), "cleared_us")


def heartbeat_blind(beats: DataFrame, timeout_us: int = 5_000_000) -> DataFrame:
    return silences(beats, ["operator_id"], timeout_us, tie="beat_id")


def chat_history(messages: DataFrame, limit: int = 15) -> DataFrame:
    """Last messages of every session (``session_id, msg_id, role, content``), numbered in reading order."""
    back = running(messages, ["session_id"], ["msg_id"], {"_back": ("sum", F.lit(1).cast("long"))}, reverse=True).where(F.col("_back") <= limit)
    w = Window.partitionBy("session_id").orderBy("msg_id")  # at most ``limit`` rows per session
    return back.select("session_id", "msg_id", "role", "content", F.row_number().over(w).alias("position"))
