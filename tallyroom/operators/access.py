"""Sessions, activity, and order-dependent login rules."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

IDLE_MS = 15 * 60 * 1000
MAX_AGE_MS = 7 * 24 * 3600 * 1000


def active_sessions(sessions: DataFrame, accounts: DataFrame, now_ms: int) -> DataFrame:
    """JN6: sessions of active accounts, not expired and not idle for 15 minutes."""
    rows = sessions.filter((F.col("expires_at") > now_ms) & (F.col("last_active_at") > now_ms - IDLE_MS))
    return rows.join(accounts.filter("active = 1"), "account_id")


def single_session(sessions: DataFrame) -> DataFrame:
    """WIN1: the newest session of each account, by expires_at, then token_hash, both descending."""
    best = sessions.groupBy("account_id").agg(F.max(F.struct("expires_at", "token_hash")).alias("s"))
    return best.select("account_id", "s.token_hash", "s.expires_at")


def recent_activity(activity: DataFrame, n: int = 200) -> DataFrame:
    """TOP1: the newest entries."""
    return activity.orderBy(F.desc("created_at"), F.desc("id")).limit(n)


def _throttle(ms: np.ndarray, limit: int, window: int) -> np.ndarray:
    """Allowed flags of one key's ordered attempts: a window starts at its first attempt and counts all of them."""
    out = np.zeros(len(ms), bool)
    i = 0
    while i < len(ms):
        end = int(np.searchsorted(ms, ms[i] + window, "left"))
        out[i : min(end, i + limit)] = True
        i = end
    return out


def _stretches(attempts: DataFrame, window_ms: int) -> DataFrame:
    """``attempts`` with ``stretch``: a key's attempts between pauses of ``window_ms`` or more.

    A pause of that length resets either login rule, so stretches are folded one by one. Pauses are found among
    (key, slot of window_ms) rows, at most one for each slot of time, so a busy key's attempts are not sorted together.
    """
    rows = attempts.withColumn("slot", F.floor(F.col("ms") / window_ms))
    slots = rows.groupBy("key", "slot").agg(F.min("ms").alias("first"), F.max("ms").alias("last"))
    order = Window.partitionBy("key").orderBy("slot")
    begins = F.coalesce(F.col("first") - F.lag("last").over(order) >= window_ms, F.lit(True))
    slots = slots.withColumn("begins", begins.cast("int")).withColumn("stretch", F.sum("begins").over(order))
    same = F.col("a.key").eqNullSafe(F.col("b.key")) & F.col("a.slot").eqNullSafe(F.col("b.slot"))
    return rows.alias("a").join(slots.alias("b"), same).select("a.*", "b.stretch")


def login_throttle(attempts: DataFrame, limit: int = 10, window_ms: int = 15 * 60 * 1000) -> DataFrame:
    """ST4: attempts (event_id, key, ms) with ``allowed``; a key's window is anchored at its first attempt.

    Attempts without a key are one key; every attempt has a time. A stretch must fit a task.
    """

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ms", "event_id"])
        return pdf.assign(allowed=_throttle(pdf["ms"].to_numpy(), limit, window_ms))[["event_id", "key", "ms", "allowed"]]

    rows = _stretches(attempts.select("event_id", "key", "ms"), window_ms)
    return rows.groupBy("key", "stretch").applyInPandas(fold, "event_id long, key string, ms long, allowed boolean")


def failed_login_burst(attempts: DataFrame, limit: int = 8, window_ms: int = 60_000) -> DataFrame:
    """ST5: attempts (event_id, key, ms, success) with ``refused``: eight recorded in the last minute. Refused ones
    are not recorded, a success clears the record. At most ``limit`` times are held for a key."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ms", "event_id"])
        recent: list[int] = []
        refused = []
        for at, success in zip(pdf["ms"].tolist(), pdf["success"].tolist(), strict=True):
            recent = [t for t in recent if t > at - window_ms]
            refused.append(len(recent) >= limit)
            if not refused[-1]:
                recent = [] if success else [*recent, at]
        return pdf.assign(refused=refused)[["event_id", "key", "ms", "refused"]]

    rows = _stretches(attempts.select("event_id", "key", "ms", "success"), window_ms)
    return rows.groupBy("key", "stretch").applyInPandas(fold, "event_id long, key string, ms long, refused boolean")


def idle_sessions(activity: DataFrame) -> DataFrame:
    """ST6: sessions of activity (key, ms, event_id): (key, session, started, ended, n).

    A gap of 15 minutes or more ends a session; so do seven days after its first activity.
    """
    order = Window.partitionBy("key").orderBy("ms", "event_id")
    gap = F.col("ms") - F.lag("ms").over(order)
    rows = activity.withColumn("_new", F.when(gap.isNull() | (gap >= IDLE_MS), 1).otherwise(0))
    rows = rows.withColumn("_idle", F.sum("_new").over(order))
    start = F.min("ms").over(Window.partitionBy("key", "_idle"))
    rows = rows.withColumn("_age", F.floor((F.col("ms") - start) / MAX_AGE_MS))
    out = rows.groupBy("key", "_idle", "_age").agg(F.min("ms").alias("started"), F.max("ms").alias("ended"), F.count("*").alias("n"))
    number = F.row_number().over(Window.partitionBy("key").orderBy("_idle", "_age"))
    return out.select("key", number.alias("session"), "started", "ended", "n")
