"""Impulse guard: night rule, frequency, risk score, recommendation, protection.

All of it is column expressions except ``recent_1h_count``, a range window.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


from moneta import params as P
from moneta.functions.common import rnd
from moneta.functions.timecols import hour_risk_multiplier, is_night_guard



def recent_1h_count(tx: DataFrame, keys: Sequence[str] = ("user_id",), ts: str = "timestamp",
                    out: str = "recent_count", bucketed: bool = True) -> DataFrame:
    """Number of *other* rows of the same key in the hour up to and including
    each row's time (rows with the same time count too).

    ``bucketed=True`` (default) keeps every window partition bounded even when
    one key holds a third of all rows: rows are bucketed by event hour and each
    bucket also receives a copy of the previous hour's rows, so the window is
    partitioned by (key, hour) instead of by key alone.  The result equals the
    plain per-key range window (``bucketed=False``).
    """
    keys = list(keys)
    frame = "range between interval 1 hour preceding and current row"
    if not bucketed:
        part = f"partition by {', '.join(keys)} " if keys else ""
        return tx.withColumn(out, F.expr(f"count(1) over ({part}order by {ts} {frame}) - 1"))
    # zone-free hour number of the wall-clock time
    hour_bucket = (F.datediff(F.to_date(F.col(ts)), F.lit("1970-01-01").cast("date")).cast("bigint") * 24
                   + F.hour(F.col(ts)))
    own = tx.withColumn("_hb", hour_bucket).withColumn("_own", F.lit(True))
    prev = tx.select(*keys, ts).withColumn("_hb", hour_bucket + 1).withColumn("_own", F.lit(False))
    both = own.unionByName(prev, allowMissingColumns=True)
    counted = both.withColumn(out, F.expr(
        f"count(1) over (partition by {', '.join(keys + ['_hb'])} order by {ts} {frame}) - 1"))
    return counted.filter(F.col("_own")).drop("_hb", "_own")


def impulse_risk(tx: DataFrame, params: P.GuardParams = P.DEFAULT_GUARD, ts: str = "timestamp",
                 amount: str = "amount", category: str = "category",
                 recent: str | None = "recent_count") -> DataFrame:
    """Adds is_night, hour_multiplier, risk_score (0..100, truncated), is_high_risk
    and the factor list, following the guard's additive rule."""
    thr = float(params.threshold())
    night = is_night_guard(F.col(ts), params.night_start, params.night_end)
    mult = hour_risk_multiplier(F.col(ts))
    amt = F.col(amount)
    cat_hit = F.coalesce(F.lower(F.col(category)).isin(list(params.high_risk_categories)), F.lit(False))
    rc = F.coalesce(F.col(recent), F.lit(0)) if recent else F.lit(0)

    night_s = F.when(F.col("is_night"), F.lit(30.0) * F.col("hour_multiplier"))
    amount_s = F.when(amt >= thr, F.lit(25.0) * F.least(amt / F.lit(thr), F.lit(3.0)))
    cat_s = F.when(cat_hit, F.when(F.col("is_night"), F.lit(30.0)).otherwise(F.lit(20.0)))
    freq_s = F.when(rc >= 3, F.least(rc * 5, F.lit(20)).cast("double"))
    # same addition order as the original: night, amount, category, frequency
    total = (F.coalesce(night_s, F.lit(0.0)) + F.coalesce(amount_s, F.lit(0.0))
             + F.coalesce(cat_s, F.lit(0.0)) + F.coalesce(freq_s, F.lit(0.0)))
    factors = F.filter(F.array(
        F.when(night_s.isNotNull(), F.struct(F.lit("horário_noturno").alias("factor"), night_s.alias("score"))),
        F.when(amount_s.isNotNull(), F.struct(F.lit("valor_alto").alias("factor"), amount_s.alias("score"))),
        F.when(cat_s.isNotNull(), F.struct(F.lit("categoria_risco").alias("factor"), cat_s.alias("score"))),
        F.when(freq_s.isNotNull(), F.struct(F.lit("frequência_alta").alias("factor"), freq_s.alias("score"))),
    ), lambda x: x.isNotNull())
    return (
        tx.withColumn("is_night", night)
        .withColumn("hour_multiplier", mult)
        .withColumn("risk_score", F.least(F.floor(total).cast("int"), F.lit(100)))
        .withColumn("is_high_risk", F.col("risk_score") >= params.high_risk_threshold)
        .withColumn("risk_factors", factors)
    )


def risk_level(score: Column) -> Column:
    """Guard bands: <30 low, <50 medium, <70 high, else critical."""
    return (F.when(score < 30, "low").when(score < 50, "medium").when(score < 70, "high")
            .otherwise("critical"))


def risk_recommendation(df: DataFrame, params: P.GuardParams = P.DEFAULT_GUARD,
                        score: str = "risk_score") -> DataFrame:
    s = F.col(score)
    d = params.delay_minutes
    return (
        df.withColumn("risk_level", risk_level(s))
        .withColumn("action", F.when(s < 30, "proceed").when(s < 50, "confirm").when(s < 70, "delay")
                    .otherwise("block"))
        .withColumn("delay_minutes", F.when(s < 50, F.lit(0)).when(s < 70, F.lit(d)).otherwise(F.lit(2 * d)))
        .withColumn("n_questions", F.when(s < 30, F.lit(0)).when(s < 50, F.lit(2)).otherwise(F.lit(3)))
    )


def apply_protection(scored: DataFrame, settings: DataFrame, keys: Sequence[str] = ("user_id",),
                     as_of: str | Column = "timestamp") -> DataFrame:
    """check_transaction: protection off or bypass active -> allowed with score 0;
    otherwise allowed = not high risk; high-risk rows get alert type night/impulse.

    ``settings`` (user_id, protection_enabled, bypass_until) is joined on the key;
    AQE turns it into a broadcast when its measured size is small.
    """
    at = F.col(as_of) if isinstance(as_of, str) else as_of
    j = scored.join(settings, list(keys), "left")
    enabled = F.coalesce(F.col("protection_enabled"), F.lit(True))
    bypass = F.coalesce(at < F.col("bypass_until"), F.lit(False))
    effective = enabled & ~bypass
    return (
        j.withColumn("protection_enabled", enabled)
        .withColumn("bypass_active", enabled & bypass)
        .withColumn("checked_score", F.when(effective, F.col("risk_score")).otherwise(F.lit(0)))
        .withColumn("allowed", ~effective | ~F.col("is_high_risk"))
        .withColumn("alert_type", F.when(effective & F.col("is_high_risk"),
                                         F.when(F.col("is_night"), "night").otherwise("impulse")))
        .drop("bypass_until")
    )


def protection_status(settings: DataFrame, at: Column, params: P.GuardParams = P.DEFAULT_GUARD) -> DataFrame:
    """Status of each user's guard at a moment ``at`` (a timestamp column/literal)."""
    return settings.select(
        "user_id",
        F.coalesce(F.col("protection_enabled"), F.lit(True)).alias("enabled"),
        is_night_guard(at, params.night_start, params.night_end).alias("is_night_period"),
        hour_risk_multiplier(at).alias("current_hour_risk"),
        F.coalesce(at < F.col("bypass_until"), F.lit(False)).alias("bypass_active"),
        F.col("bypass_until"),
    )


def user_risk_summary(checked: DataFrame, keys: Sequence[str] = ("user_id",)) -> DataFrame:
    """Per key: transactions, high-risk count and value, blocked count, max score."""
    hr = F.col("is_high_risk") & F.col("protection_enabled") & ~F.col("bypass_active")
    return checked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_tx"),
        F.sum(F.when(hr, 1).otherwise(0)).alias("n_high_risk"),
        rnd(F.sum(F.when(hr, F.col("amount")).otherwise(0.0)), 2).alias("high_risk_value"),
        F.sum(F.when(~F.col("allowed"), 1).otherwise(0)).alias("n_blocked"),
        F.max("checked_score").alias("max_score"),
        F.sum(F.when(F.col("alert_type") == "night", 1).otherwise(0)).alias("n_night_alerts"),
    )
