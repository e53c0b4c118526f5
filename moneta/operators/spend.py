"""Spending analysis: summaries, category/weekday/period/week breakdowns, daily
series, trend, KPIs, running balance and the mean-based forecast.

Aggregates are ``groupBy(keys, ...)`` with partial (map-side) aggregation; the
only per-key windows run over *daily* series, whose length is bounded by the
calendar, not by the number of transactions.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moneta import params as P
from moneta.functions.common import attach, exact_quantiles, join_null_safe, lit_array, rnd
from moneta.functions.timecols import week_of_month, weekday_mon0

K = ("user_id",)


def _types(tx: DataFrame, types: Sequence[str] | None) -> DataFrame:
    # The original counts every row as spending (credits included); types narrows it.
    return tx if not types else tx.filter(F.col("transaction_type").isin(list(types)))


def spend_summary(tx: DataFrame, keys: Sequence[str] = K, types: Sequence[str] | None = None) -> DataFrame:
    """Count, sum, mean, median and sample std of the amounts per key.  The median comes from counts per
    range of values (``exact_quantiles``), so no task holds all amounts of a key."""
    rows = _types(tx, types)
    out = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_transactions"),
        rnd(F.sum("amount"), 2).alias("total_spent"),
        rnd(F.avg("amount"), 6).alias("average_transaction"),
        rnd(F.stddev_samp("amount"), 6).alias("std_transaction"),
    )
    out = join_null_safe(out, exact_quantiles(rows, "amount", (0.5,), keys), keys) if keys else attach(out, exact_quantiles(rows, "amount", (0.5,)), ())
    return out.select(*keys, "total_transactions", "total_spent", "average_transaction", rnd("q0", 6).alias("median_transaction"), "std_transaction")


def tx_summary(tx: DataFrame, keys: Sequence[str] = K) -> DataFrame:
    """Credits, debits (other types ignored), balance and count."""
    c = F.col("transaction_type")
    return tx.groupBy(*keys).agg(
        rnd(F.sum(F.when(c == "credito", F.col("amount")).otherwise(0.0)), 2).alias("total_credito"),
        rnd(F.sum(F.when(c == "debito", F.col("amount")).otherwise(0.0)), 2).alias("total_debito"),
        F.count(F.lit(1)).alias("count"),
    ).withColumn("saldo", rnd(F.col("total_credito") - F.col("total_debito"), 2))


def tx_summary_by_category(tx: DataFrame, keys: Sequence[str] = K) -> DataFrame:
    """Sum per category over both types; null or empty category -> outros."""
    cat = F.coalesce(F.nullif(F.col("category"), F.lit("")), F.lit("outros"))
    return tx.groupBy(*keys, cat.alias("category")).agg(rnd(F.sum("amount"), 2).alias("total"))


def by_category(tx: DataFrame, keys: Sequence[str] = K, types: Sequence[str] | None = None) -> DataFrame:
    """sum/mean/count/std per category rounded to 2; percent of the key's grand
    total (all rows, null categories included) from the rounded total, 1 decimal.
    Null categories form no group."""
    per = _types(tx, types).groupBy(*keys, "category").agg(
        F.sum("amount").alias("_s"),
        rnd(F.avg("amount"), 2).alias("media"),
        F.count(F.lit(1)).alias("count"),
        rnd(F.stddev_samp("amount"), 2).alias("desvio"),
    )
    # the grand total from the per-category rows: a key has as many as it has categories
    per = per.withColumn("_grand", F.sum("_s").over(Window.partitionBy(*keys))).filter(F.col("category").isNotNull())
    return (per.select(*keys, "category", rnd("_s", 2).alias("total"), "media", "count", "desvio", "_grand")
            .withColumn("percentual", rnd(F.try_divide(F.col("total"), F.col("_grand")) * 100, 1))
            .drop("_grand"))


def by_weekday(tx: DataFrame, keys: Sequence[str] = K) -> DataFrame:
    dow = weekday_mon0(F.col("date"))
    return (tx.groupBy(*keys, dow.alias("day_of_week")).agg(
        rnd(F.sum("amount"), 2).alias("sum"),
        rnd(F.avg("amount"), 6).alias("mean"),
        F.count(F.lit(1)).alias("count"))
        .withColumn("day_name", F.element_at(lit_array(P.WEEKDAY_LABELS), F.col("day_of_week") + 1)))


def day_period(ts: Column) -> Column:
    h = F.hour(ts)
    return (F.when(h <= 6, "Madrugada").when(h <= 12, "Manhã").when(h <= 18, "Tarde").otherwise("Noite"))


def by_period(tx: DataFrame, keys: Sequence[str] = K, ts: str = "timestamp") -> DataFrame:
    """Sum and count per period of the day; empty periods appear with zeros."""
    period = day_period(F.col(ts))
    per = tx.groupBy(*keys).agg(*[x for i, p in enumerate(P.PERIOD_LABELS) for x in (
        F.sum(F.when(period == p, F.col("amount"))).alias(f"_s{i}"), F.count(F.when(period == p, 1)).alias(f"_c{i}"))])
    rows = F.array(*[F.struct(F.lit(p).alias("period"), F.col(f"_s{i}").alias("s"), F.col(f"_c{i}").alias("c"))
                     for i, p in enumerate(P.PERIOD_LABELS)])
    return per.select(*keys, F.explode(rows).alias("_x")).select(
        *keys, "_x.period", rnd(F.coalesce("_x.s", F.lit(0.0)), 2).alias("sum"), F.col("_x.c").alias("count"))


def by_week_of_month(tx: DataFrame, keys: Sequence[str] = K) -> DataFrame:
    return tx.groupBy(*keys, week_of_month(F.col("date")).alias("week_of_month")).agg(
        rnd(F.sum("amount"), 2).alias("total"))


def daily_spend(tx: DataFrame, keys: Sequence[str] = K) -> DataFrame:
    """Sum per date (unrounded: it feeds trend and forecast)."""
    return tx.groupBy(*keys, "date").agg(F.sum("amount").alias("amount"))


def fill_calendar(daily: DataFrame, keys: Sequence[str] = K) -> DataFrame:
    """All dates between each key's first and last date; missing days = 0.

    The key's active days go into one map (bounded by its active days), and the
    calendar is exploded from it after the aggregation — the filled rows (days x
    keys) are produced after the last shuffle instead of being shuffled into a
    join."""
    per = daily.groupBy(*keys).agg(
        F.min("date").alias("_d0"), F.max("date").alias("_d1"),
        F.map_from_entries(F.collect_list(F.struct("date", "amount"))).alias("_m"))
    cal = per.select(*keys, "_m", F.explode(F.sequence("_d0", "_d1")).alias("date"))
    return cal.select(*keys, "date", F.coalesce(F.element_at("_m", F.col("date")), F.lit(0.0)).alias("amount"))


def rolling_mean_7(daily: DataFrame, keys: Sequence[str] = K) -> DataFrame:
    """Mean of 7 rows of the daily series (dates present), null for the first 6."""
    w = Window.partitionBy(*keys).orderBy("date")
    return (daily.withColumn("_rn", F.row_number().over(w))
            .withColumn("rolling_mean_7", F.when(F.col("_rn") >= 7, F.avg("amount").over(w.rowsBetween(-6, 0))))
            .drop("_rn"))


def trend(daily: DataFrame, keys: Sequence[str] = K, min_days: int = 7) -> DataFrame:
    """Least-squares line through the daily totals (x = 0..n-1)."""
    w = Window.partitionBy(*keys).orderBy("date")
    x = daily.withColumn("_x", (F.row_number().over(w) - 1).cast("double"))
    g = x.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_days"),
        F.covar_pop("_x", "amount").alias("_cxy"),
        F.var_pop("_x").alias("_vx"),
        F.var_pop("amount").alias("_vy"),
        F.avg("amount").alias("_mean"),
    )
    # slope and r from population moments; try_divide: a flat series has no r (treated as 0)
    g = (g.withColumn("_slope", F.coalesce(F.try_divide(F.col("_cxy"), F.col("_vx")), F.lit(0.0)))
         .withColumn("_r", F.try_divide(F.col("_cxy"), F.sqrt(F.col("_vx") * F.col("_vy")))))
    r = F.coalesce(F.nanvl(F.col("_r"), F.lit(0.0)), F.lit(0.0))
    enough = F.col("n_days") >= min_days
    ar = F.abs(r)
    return g.select(
        *keys, "n_days",
        F.when(enough, F.when(F.col("_slope") > 0, "crescente").otherwise("decrescente")).alias("direction"),
        F.when(enough, rnd(F.col("_slope"), 2)).alias("slope"),
        F.when(enough, rnd(r * r, 3)).alias("r_squared"),
        F.when(enough, F.when(ar > 0.7, "forte").when(ar > 0.4, "moderada").otherwise("fraca")).alias("strength"),
        F.when(enough, rnd(F.col("_mean"), 2)).alias("daily_average"),
        F.when(enough, rnd(F.col("_mean") * 30, 2)).alias("projection_30_days"),
        F.when(~enough, F.lit("Dados insuficientes para análise de tendência")).alias("message"),
    )


def kpis(summary: DataFrame, keys: Sequence[str] = K) -> DataFrame:
    """Savings rate and payments share of receipts from a tx_summary frame."""
    rec, pay, net = F.col("total_credito"), F.col("total_debito"), F.col("saldo")
    return summary.select(
        *keys, rec.alias("receipts"), pay.alias("payments"), net.alias("net"),
        F.when(rec > 0, rnd(net / rec * 100, 1)).otherwise(F.lit(0.0)).alias("savings_rate"),
        F.when(rec > 0, rnd(pay / rec * 100, 1)).alias("payments_pct"),
    )


def category_share(tx: DataFrame, keys: Sequence[str] = K) -> DataFrame:
    """Each category's share of the key's payments (debits), 1 decimal."""
    deb = tx.filter(F.col("transaction_type") == "debito")
    cat = F.coalesce(F.nullif(F.col("category"), F.lit("")), F.lit("outros"))
    per = deb.groupBy(*keys, cat.alias("category")).agg(F.sum("amount").alias("_t"))
    return (per.withColumn("_p", F.sum("_t").over(Window.partitionBy(*keys)))
            .select(*keys, "category", rnd(F.col("_t"), 2).alias("total"),
                    rnd(F.try_divide(F.col("_t"), F.col("_p")) * 100, 1).alias("share_pct")))


def running_balance(tx: DataFrame, keys: Sequence[str] = K, opening: float | Column = 0.0) -> DataFrame:
    """Opening balance plus cumulative (credits - debits) per calendar day."""
    c = F.col("transaction_type")
    flow = tx.groupBy(*keys, "date").agg(
        F.sum(F.when(c == "credito", F.col("amount")).when(c == "debito", -F.col("amount"))
              .otherwise(0.0)).alias("amount"))
    full = fill_calendar(flow, keys)
    w = Window.partitionBy(*keys).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    op = opening if isinstance(opening, Column) else F.lit(float(opening))
    return full.select(*keys, "date", rnd(F.col("amount"), 2).alias("net_flow"),
                       rnd(op + F.sum("amount").over(w), 2).alias("balance"))


def forecast_simple(tx: DataFrame, keys: Sequence[str] = K, days: int = 30) -> DataFrame:
    """Mean-based forecast: total / distinct dates per day, +-1.96 sample std of
    transactions times sqrt(days)."""
    g = tx.groupBy(*keys).agg(
        F.sum("amount").alias("_s"),
        F.greatest(F.count_distinct("date"), F.lit(1)).alias("_d"),
        F.stddev_samp("amount").alias("_sd"),
    )
    avg = F.col("_s") / F.col("_d")
    tot = avg * days
    half = F.lit(1.96) * F.col("_sd") * F.lit(float(days) ** 0.5)
    return g.select(
        *keys, F.lit("Média histórica").alias("method"),
        rnd(tot, 2).alias("total_predicted"), rnd(avg, 2).alias("average_daily"),
        rnd(tot - half, 2).alias("lower"), rnd(tot + half, 2).alias("upper"),
    )


def decade_of(d: Column) -> Column:
    day = F.dayofmonth(d)
    return F.when(day <= 10, "1_10").when(day <= 20, "11_20").otherwise("21_31")


def by_decade(tx: DataFrame, keys: Sequence[str] = K) -> DataFrame:
    """Receipts, payments and their difference per month and 10-day slice."""
    c = F.col("transaction_type")
    return (tx.groupBy(*keys, F.date_format("date", "yyyy-MM").alias("year_month"),
                       decade_of(F.col("date")).alias("decade"))
            .agg(rnd(F.sum(F.when(c == "credito", F.col("amount")).otherwise(0.0)), 2).alias("receipts"),
                 rnd(F.sum(F.when(c == "debito", F.col("amount")).otherwise(0.0)), 2).alias("payments"))
            .withColumn("difference", rnd(F.col("receipts") - F.col("payments"), 2)))


def by_decade_wide(tx: DataFrame, keys: Sequence[str] = K) -> DataFrame:
    """Same as by_decade, pivoted to one row per key and month."""
    long = by_decade(tx, keys)
    return (long.groupBy(*keys, "year_month").pivot("decade", ["1_10", "11_20", "21_31"])
            .agg(F.first("receipts").alias("receipts"), F.first("payments").alias("payments")))


def weekly_totals(tx: DataFrame, keys: Sequence[str] = K) -> DataFrame:
    """Debit total per ISO week (Monday start) and the previous week present."""
    deb = tx.filter(F.col("transaction_type") == "debito")
    g = deb.groupBy(*keys, F.to_date(F.date_trunc("week", F.col("date"))).alias("week")).agg(
        F.sum("amount").alias("_t"))
    w = Window.partitionBy(*keys).orderBy("week")
    return g.select(*keys, "week", rnd("_t", 2).alias("total"),
                    rnd(F.lag("_t").over(w), 2).alias("previous_total"))


def budget_usage(tx: DataFrame, limits: DataFrame, keys: Sequence[str] = K) -> DataFrame:
    """Debit spending per month against each key's monthly limit (percent)."""
    deb = tx.filter(F.col("transaction_type") == "debito")
    m = deb.groupBy(*keys, F.date_format("date", "yyyy-MM").alias("year_month")).agg(F.sum("amount").alias("_s"))
    j = m.join(limits.select(*keys, "monthly_limit"), list(keys))
    return j.select(*keys, "year_month", rnd("_s", 2).alias("spent"), rnd("monthly_limit", 2).alias("monthly_limit"),
                    rnd(F.try_divide(F.col("_s"), F.col("monthly_limit")) * 100, 1).alias("percent"))


def zscore_amount(tx: DataFrame, keys: Sequence[str] = K) -> DataFrame:
    """(amount - key mean) / key population std (null when the std is 0)."""
    st = tx.groupBy(*keys).agg(F.avg("amount").alias("_m"), F.stddev_pop("amount").alias("_s"))
    j = attach(tx, st, keys)
    return j.withColumn("z", F.try_divide(F.col("amount") - F.col("_m"), F.nullif(F.col("_s"), F.lit(0.0)))) \
        .drop("_m", "_s")
