import datetime as dt

from moneta.operators import profile, savings, spend


def test_trend_golden(spark):
    rows = [(1, dt.date(2024, 1, 1) + dt.timedelta(days=i), 50.0 + 5 * i) for i in range(30)]
    d = spark.createDataFrame(rows, "user_id long, date date, amount double")
    r = spend.trend(d).first()
    assert (r.direction, r.slope, r.r_squared, r.strength) == ("crescente", 5.0, 1.0, "forte")
    assert (r.daily_average, r.projection_30_days) == (122.5, 3675.0)


def test_trend_too_short(spark):
    d = spark.createDataFrame([(1, dt.date(2024, 1, i), 1.0) for i in range(1, 5)], "user_id long, date date, amount double")
    assert spend.trend(d).first().message.startswith("Dados insuficientes")


def test_profile_golden(spark):
    rows = [(1, i, dt.date(2024, 1, 1), dt.datetime(2024, 1, 1, 2 + i % 4), 100.0, "delivery") for i in range(20)]
    tx = spark.createDataFrame(rows, "user_id long, id long, date date, timestamp timestamp_ntz, amount double, category string")
    r = profile.behavior_profile(profile.behavior_indicators(tx)).first()
    assert (r.profile, r.confidence, r.secondary_profiles) == ("notívago", 100.0, "social,controlado")
    assert (r.score_0, r.score_1, r.score_2, r.score_4) == (100.0, 50.0, 100.0, 100.0)


def test_savings_golden(spark):
    noon = dt.datetime(2024, 1, 1, 12)
    rows = [(1, i, noon, 100.0, "delivery", "iFood") for i in range(3)] + [(1, 9, noon, 200.0, "lazer", "Cinema")]
    tx = spark.createDataFrame(rows, "user_id long, id long, timestamp timestamp_ntz, amount double, category string, merchant string")
    s = {(r.type, r.name): r for r in savings.savings_suggestions(tx).collect()}
    assert s[("category_reduction", "delivery")].potential_savings == 90.0
    assert s[("category_reduction", "delivery")].priority == "alta"
    assert s[("category_reduction", "lazer")].potential_savings == 60.0
    assert s[("recurring_expense", "iFood")].potential_savings == 60.0
    assert s[("recurring_expense", "iFood")].priority == "média"
    t = savings.savings_totals(tx).first()
    assert (t.total_potential_savings, t.target_savings, t.achievable) == (210.0, 50.0, True)


def test_simple_forecast_golden(spark):
    rows = [(1, dt.date(2024, 1, d), 100.0) for d in (1, 2, 3)]
    tx = spark.createDataFrame(rows, "user_id long, date date, amount double")
    r = spend.forecast_simple(tx).first()
    assert (r.average_daily, r.total_predicted) == (100.0, 3000.0)


def test_by_period_keeps_empty_periods(spark):
    rows = [(1, dt.datetime(2024, 1, 1, 3), 10.0)]
    tx = spark.createDataFrame(rows, "user_id long, timestamp timestamp_ntz, amount double")
    got = {r["period"]: (r["sum"], r["count"]) for r in spend.by_period(tx).collect()}
    assert got == {"Madrugada": (10.0, 1), "Manhã": (0.0, 0), "Tarde": (0.0, 0), "Noite": (0.0, 0)}


def test_keys_empty_equals_single_user(spark):
    from conftest import SF_SMALL
    from pyspark.sql import functions as F
    from moneta.sources import testdata as td
    tx = td.load_transactions(spark, SF_SMALL)
    uid = tx.select(F.min("user_id")).first()[0]
    one = tx.filter(F.col("user_id") == uid)
    a = spend.by_category(one, keys=()).drop().orderBy("category").collect()
    b = spend.by_category(tx).filter(F.col("user_id") == uid).drop("user_id").orderBy("category").collect()
    assert [tuple(r) for r in a] == [tuple(r) for r in b]
