import datetime as dt

import numpy as np

from moneta.operators import clusters as cl
from moneta.operators import forecast as fc


def _naive_sse(y):
    flat = np.sum((y[7:] - y[:7].mean()) ** 2)
    seasonal = np.sum((y[7:] - y[:-7]) ** 2)
    return flat, seasonal


def test_fitted_hw_beats_flat_and_seasonal_naive():
    rng = np.random.default_rng(5)
    t = np.arange(60)
    y = 100 + 2 * t + 30 * np.sin(2 * np.pi * t / 7) + rng.normal(0, 5, 60)
    m = fc.fit_hw(y)
    flat, seasonal = _naive_sse(y)
    assert m["sse"] <= flat and m["sse"] <= seasonal


def test_forecast_hw_shape_and_bounds(spark):
    rows = [(1, dt.date(2024, 1, 1) + dt.timedelta(days=i), 50.0 + 10 * (i % 7)) for i in range(28)]
    rows += [(2, dt.date(2024, 1, 1), 10.0), (2, dt.date(2024, 1, 3), 20.0)]  # short series -> simple
    tx = spark.createDataFrame(rows, "user_id long, date date, amount double")
    daily, summary = fc.forecast_hw(tx, days=30)
    d = daily.filter("user_id = 1").orderBy("h").collect()
    assert len(d) == 30 and d[0].date == dt.date(2024, 1, 29)
    assert all(r.lower <= r.predicted <= r.upper and r.lower >= 0 for r in d)
    s = {r.user_id: r.method for r in summary.collect()}
    assert s == {1: "Holt-Winters", 2: "Média histórica"}
    fixed = fc.forecast_hw_fixed(tx, days=30).filter("user_id = 1").count()
    assert fixed == 30


def test_clusters_relabelled_by_mean_amount(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(200):
        grp = i % 4
        rows.append((i, 1, dt.datetime(2024, 1, 1 + i % 20, [2, 9, 15, 20][grp]), float(10 + 100 * grp + rng.uniform(0, 5)), "x"))
    tx = spark.createDataFrame(rows, "id long, user_id long, timestamp timestamp_ntz, amount double, category string") \
        .withColumn("date", __import__("pyspark.sql.functions", fromlist=["to_date"]).to_date("timestamp"))
    out, cost = cl.spend_clusters(tx, n_init=3)
    desc = cl.describe_clusters(out).orderBy("cluster").collect()
    assert len(desc) == 4 and sum(r.size for r in desc) == 200
    assert [r.avg_amount for r in desc] == sorted(r.avg_amount for r in desc)   # ids follow the mean amount
    assert abs(sum(r.percentage for r in desc) - 100.0) < 0.2 and cost >= 0
