"""Mutable records on immutable files: append-only change logs read back with
latest-wins aggregates.

``max_by`` is a partial (map-side) aggregate, so a key with a huge history
never lands whole in one task, unlike a per-key window.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest_wins(log: DataFrame, keys: Sequence[str], ts: str, cols: Sequence[str],
                tiebreak: str | None = None) -> DataFrame:
    """Per key, the values of the newest log row (ties: the larger ``tiebreak``)."""
    order = F.struct(F.col(ts), F.col(tiebreak)) if tiebreak else F.col(ts)
    rec = F.struct(*[F.col(c) for c in cols], F.col(ts).alias("_ts"))
    g = log.groupBy(*keys).agg(F.max_by(rec, order).alias("_r"))
    return g.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in cols], F.col("_r._ts").alias(f"last_{ts}"))


def latest_non_null(log: DataFrame, keys: Sequence[str], ts: str, fields: Sequence[str]) -> DataFrame:
    """Per key and field, the newest non-null value (field-wise upsert)."""
    return log.groupBy(*keys).agg(
        *[F.max_by(F.col(f), F.when(F.col(f).isNotNull(), F.col(ts))).alias(f) for f in fields])


def upsert(base: DataFrame, updates: DataFrame, keys: Sequence[str], ts: str, fields: Sequence[str]) -> DataFrame:
    """Insert keys that are new, overwrite known fields with their latest
    non-null update; untouched fields keep the base value."""
    latest = latest_non_null(updates, keys, ts, fields)
    u = latest.select(*keys, *[F.col(f).alias(f"_u_{f}") for f in fields])
    j = base.join(u, list(keys), "full_outer")
    return j.select(*keys, *[F.coalesce(F.col(f"_u_{f}"), F.col(f)).alias(f) for f in fields])


def goal_updates(goals: DataFrame, log: DataFrame) -> DataFrame:
    """Current amount = last update (or the stored one); status completed once
    any value reached the target, and it never reverts."""
    last = latest_wins(log, ["goal_id"], "ts", ["amount"])
    reached = log.join(goals.select("goal_id", "target_amount"), "goal_id").groupBy("goal_id").agg(
        F.max((F.col("amount") >= F.col("target_amount")).cast("int")).alias("_hit"))
    j = goals.join(last, "goal_id", "left").join(reached, "goal_id", "left")
    done = (F.col("status") == "completed") | (F.coalesce(F.col("_hit"), F.lit(0)) == 1)
    return j.select(
        "goal_id", "user_id", "name", "target_amount",
        F.coalesce(F.col("amount"), F.col("current_amount")).alias("current_amount"),
        F.when(done, F.lit("completed")).otherwise(F.col("status")).alias("status"),
        F.col("last_ts").alias("updated_at"))


def delay_status(delays: DataFrame, at: Column, keys: Sequence[str] = ("user_id", "transaction_id")) -> DataFrame:
    """Latest delay set per (user, transaction), seen at time ``at``."""
    last = latest_wins(delays, keys, "set_at", ["expires_at", "minutes"])
    rem = F.col("expires_at").cast("timestamp").cast("double") - at.cast("timestamp").cast("double")
    active = at < F.col("expires_at")
    return last.select(
        *keys, "expires_at", active.alias("active"),
        F.when(active, F.floor(rem).cast("long")).alias("remaining_seconds"),
        F.when(active, F.bround((rem / 60).cast("decimal(38,6)"), 1).cast("double")).alias("remaining_minutes"),
        (~active).alias("expired"), (~active).alias("can_proceed"))


def guard_state(log: DataFrame, at: Column | None = None, default_minutes: int = 30,
                keys: Sequence[str] = ("user_id",)) -> DataFrame:
    """(keys, protection_enabled, bypass_until) from an append-only log of guard actions
    (keys, ts, action, minutes), seen at ``at`` (default: the whole log).

    The newest 'enable' or 'disable' sets the protection (none: on; both at one moment:
    on).  The newest 'bypass' runs for its minutes (null: ``default_minutes``); an 'enable'
    at or after it ends it, a 'disable' does not.  Other actions and null times count for
    nothing.  Partial aggregates only, so a long log of one user is no hot group."""
    seen = log.filter(F.col("ts") <= at) if at is not None else log
    on, off, by = (F.col("action") == a for a in ("enable", "disable", "bypass"))
    until = F.col("ts") + F.make_dt_interval(mins=F.coalesce(F.col("minutes"), F.lit(default_minutes)).cast("int"))
    g = seen.groupBy(*keys).agg(
        F.max(F.when(on, F.col("ts"))).alias("_on"), F.max(F.when(off, F.col("ts"))).alias("_off"),
        F.max(F.when(by & F.col("ts").isNotNull(), F.struct(F.col("ts").alias("at"), until.alias("until")))).alias("_by"))
    enabled = F.col("_off").isNull() | F.coalesce(F.col("_on") >= F.col("_off"), F.lit(False))
    ended = F.coalesce(F.col("_on") >= F.col("_by.at"), F.lit(False))
    return g.select(*keys, enabled.alias("protection_enabled"),
                    F.when(~ended, F.col("_by.until")).alias("bypass_until"))
