"""Spending forecasts over each key's filled daily series.

* ``forecast_hw_fixed``: additive Holt-Winters (season 7) with given alpha,
  beta, gamma — the recursion runs inside Spark as an ``aggregate`` over the
  key's daily array (length bounded by the calendar, not by transactions).
* ``forecast_hw``: the same model with parameters chosen per key by least
  squares over a grid (vectorised numpy in ``groupBy(key).applyInPandas``);
  fewer than 14 days -> the mean-based forecast.

Initial state: l0 = mean(days 1-7), b0 = (mean(days 8-14) - l0) / 7,
s_i = y_i - l0 for the first 7 days; updates from day 8 on.
"""
from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from moneta.functions.common import rnd, spread_by
from moneta.operators.spend import daily_spend, fill_calendar, forecast_simple

K = ("user_id",)
SEASON = 7
MIN_DAYS = 14


def _series(tx: DataFrame, keys: Sequence[str]) -> DataFrame:
    return fill_calendar(daily_spend(tx, keys), keys)


def forecast_hw_fixed(tx: DataFrame, alpha: float = 0.3, beta: float = 0.1, gamma: float = 0.2,
                      days: int = 30, keys: Sequence[str] = K) -> DataFrame:
    """One row per key and forecast day: predicted / lower / upper (clamped at 0,
    2 decimals); bounds +-1.96 population std of the one-step errors."""
    keys = list(keys)
    s = _series(tx, keys)
    g = s.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("date", "amount"))).alias("_a"),
                             F.max("date").alias("last_date"))
    g = g.filter(F.size("_a") >= MIN_DAYS)
    y = F.transform("_a", lambda x: x["amount"])
    g = g.withColumn("_y", y)
    l0 = F.aggregate(F.slice("_y", 1, 7), F.lit(0.0), lambda a, x: a + x) / 7.0
    m2 = F.aggregate(F.slice("_y", 8, 7), F.lit(0.0), lambda a, x: a + x) / 7.0
    g = g.withColumn("_l0", l0).withColumn("_b0", (m2 - F.col("_l0")) / 7.0)
    init = F.struct(
        F.col("_l0").alias("l"), F.col("_b0").alias("b"),
        F.transform(F.slice("_y", 1, 7), lambda x: x - F.col("_l0")).alias("s"),
        F.lit(7).alias("t"), F.lit(0.0).alias("sse"), F.lit(0.0).alias("se"), F.lit(0).alias("n"))

    def step(acc, yt):
        ph = acc["t"] % SEASON + 1                     # 1-based slot of s_{t-7}
        s_old = F.element_at(acc["s"], ph)
        fit = acc["l"] + acc["b"] + s_old
        err = yt - fit
        lv = F.lit(alpha) * (yt - s_old) + F.lit(1 - alpha) * (acc["l"] + acc["b"])
        tr = F.lit(beta) * (lv - acc["l"]) + F.lit(1 - beta) * acc["b"]
        sn = F.lit(gamma) * (yt - acc["l"] - acc["b"]) + F.lit(1 - gamma) * s_old
        new_s = F.transform(acc["s"], lambda v, i: F.when(i + 1 == ph, sn).otherwise(v))
        return F.struct(lv.alias("l"), tr.alias("b"), new_s.alias("s"), (acc["t"] + 1).alias("t"),
                        (acc["sse"] + err * err).alias("sse"), (acc["se"] + err).alias("se"),
                        (acc["n"] + 1).alias("n"))

    st = g.withColumn("_st", F.aggregate(F.slice("_y", 8, F.size("_y")), init, step))
    n_err = F.col("_st.n")
    mean_e = F.col("_st.se") / n_err
    sd = F.sqrt(F.greatest(F.col("_st.sse") / n_err - mean_e * mean_e, F.lit(0.0)))
    st = st.withColumn("_sd", F.when(n_err > 0, sd).otherwise(F.lit(0.0)))
    h = st.select(*keys, "last_date", "_st", "_sd", F.explode(F.sequence(F.lit(1), F.lit(days))).alias("h"))
    t_last = F.col("_st.t") - 1
    slot = (t_last + F.col("h")) % SEASON + 1
    f = F.col("_st.l") + F.col("h") * F.col("_st.b") + F.element_at(F.col("_st.s"), slot)
    half = F.lit(1.96) * F.col("_sd")
    return h.select(*keys, "h", F.date_add("last_date", F.col("h")).alias("date"),
                    F.greatest(rnd(f, 2), F.lit(0.0)).alias("predicted"),
                    F.greatest(rnd(f - half, 2), F.lit(0.0)).alias("lower"),
                    F.greatest(rnd(f + half, 2), F.lit(0.0)).alias("upper"),
                    rnd(f, 6).alias("raw"))


# ----------------------------------------------------------------- fitted

def hw_run(y: np.ndarray, a: np.ndarray, b: np.ndarray, g: np.ndarray):
    """Vectorised over parameter sets: returns (sse, level, trend, seasonals,
    fitted values from day 8)."""
    n = y.size
    l0 = y[:7].mean()
    lv = np.full(a.shape, l0)
    tr = np.full(a.shape, (y[7:14].mean() - l0) / 7.0)
    s = np.tile(y[:7] - l0, (a.size, 1))
    sse = np.zeros(a.shape)
    fitted = np.zeros((a.size, n - 7))
    for t in range(7, n):
        ph = t % SEASON
        s_old = s[:, ph].copy()
        fit = lv + tr + s_old
        fitted[:, t - 7] = fit
        e = y[t] - fit
        sse += e * e
        nl = a * (y[t] - s_old) + (1 - a) * (lv + tr)
        nt = b * (nl - lv) + (1 - b) * tr
        s[:, ph] = g * (y[t] - lv - tr) + (1 - g) * s_old
        lv, tr = nl, nt
    return sse, lv, tr, s, fitted


GRID = np.round(np.arange(0.05, 1.0, 0.1), 2)


def fit_hw(y: np.ndarray) -> dict:
    """Least-squares parameters over a 10 x 10 x 10 grid."""
    A, B, G = np.meshgrid(GRID, GRID, GRID, indexing="ij")
    a, b, g = A.ravel(), B.ravel(), G.ravel()
    sse, lv, tr, s, fitted = hw_run(y, a, b, g)
    k = int(np.argmin(sse))
    return {"alpha": a[k], "beta": b[k], "gamma": g[k], "sse": sse[k], "level": lv[k], "trend": tr[k],
            "season": s[k], "fitted": fitted[k], "n": y.size}


def _hw_group(pdf: pd.DataFrame, keys: list[str], days: int) -> pd.DataFrame:
    pdf = pdf.sort_values("date")
    y = pdf["amount"].to_numpy(dtype=float)
    m = fit_hw(y)
    h = np.arange(1, days + 1)
    slots = (y.size - 1 + h) % SEASON
    f = m["level"] + h * m["trend"] + m["season"][slots]
    resid = y[7:] - m["fitted"]
    sd = float(np.std(resid)) if resid.size else 0.0
    last = pd.Timestamp(pdf["date"].iloc[-1])
    out = pd.DataFrame({
        "h": h.astype(np.int32),
        "date": [(last + pd.Timedelta(days=int(i))).date() for i in h],
        "predicted": np.maximum(0.0, np.round(f, 2)),
        "lower": np.maximum(0.0, np.round(f - 1.96 * sd, 2)),
        "upper": np.maximum(0.0, np.round(f + 1.96 * sd, 2)),
        "raw": f, "alpha": m["alpha"], "beta": m["beta"], "gamma": m["gamma"], "sse": m["sse"]})
    for k in reversed(keys):
        out.insert(0, k, pdf[k].iloc[0])
    return out


def forecast_hw(tx: DataFrame, days: int = 30, keys: Sequence[str] = K) -> tuple[DataFrame, DataFrame]:
    """(daily predictions, per-key summary).  Keys with fewer than 14 calendar
    days use the mean-based forecast: no daily rows, but a range of the total.
    Summary: total_predicted = sum of clamped days, rounded once, average_daily = mean of the
    unclamped forecast; lower / upper are null where the daily rows carry the bounds."""
    keys = list(keys)
    s = _series(tx, keys)
    # calendar length per key straight from the daily aggregate (no second pass over the series)
    n = (daily_spend(tx, keys).groupBy(*keys)
         .agg((F.datediff(F.max("date"), F.min("date")) + 1).alias("_n")))
    long_ = s.join(n.filter(F.col("_n") >= MIN_DAYS), keys).drop("_n")
    kfields = [f for f in s.select(*keys).schema.fields]
    schema = T.StructType(kfields + [
        T.StructField("h", T.IntegerType()), T.StructField("date", T.DateType()),
        T.StructField("predicted", T.DoubleType()), T.StructField("lower", T.DoubleType()),
        T.StructField("upper", T.DoubleType()), T.StructField("raw", T.DoubleType()),
        T.StructField("alpha", T.DoubleType()), T.StructField("beta", T.DoubleType()),
        T.StructField("gamma", T.DoubleType()), T.StructField("sse", T.DoubleType())])
    daily = spread_by(long_, *keys).groupBy(*keys).applyInPandas(lambda pdf: _hw_group(pdf, keys, days), schema)
    hw_sum = daily.groupBy(*keys).agg(
        F.lit("Holt-Winters").alias("method"), rnd(F.sum(F.greatest("raw", F.lit(0.0))), 2).alias("total_predicted"),
        rnd(F.avg("raw"), 2).alias("average_daily"), F.lit(None).cast("double").alias("lower"),
        F.lit(None).cast("double").alias("upper"))
    short_keys = n.filter(F.col("_n") < MIN_DAYS).select(*keys)
    simple = forecast_simple(tx.join(short_keys, keys, "left_semi"), keys, days).select(
        *keys, "method", "total_predicted", "average_daily", "lower", "upper")
    return daily, hw_sum.unionByName(simple).withColumn("confidence_level", F.lit(0.95))
