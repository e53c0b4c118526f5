import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL, ts
from moneta.functions.timecols import hour_risk_multiplier, is_night_guard, is_night_hour
from moneta.operators import risk
from moneta.sources import testdata as td


def _tx(spark, rows):
    return spark.createDataFrame(rows, "id long, user_id long, timestamp timestamp_ntz, amount double, category string")


@pytest.mark.parametrize("t,guard,hour_rule,mult", [
    ("2024-01-01 02:30:00", True, True, 2.0),
    ("2024-01-01 14:30:00", False, False, 1.0),
    ("2024-01-01 00:00:00", True, True, 1.5),
    ("2024-01-01 06:00:00", True, True, 1.0),
    ("2024-01-01 06:00:01", False, True, 1.0),
    ("2024-01-01 06:00:00.000001", False, True, 1.0),
])
def test_night_rules(spark, t, guard, hour_rule, mult):
    df = spark.createDataFrame([(ts(t),)], "t timestamp_ntz")
    r = df.select(is_night_guard("t").alias("g"), is_night_hour("t").alias("h"),
                  hour_risk_multiplier("t").alias("m")).first()
    assert (r.g, r.h, r.m) == (guard, hour_rule, mult)


def test_night_window_wraps_midnight(spark):
    df = spark.createDataFrame([(ts("2024-01-01 23:30:00"),), (ts("2024-01-01 12:00:00"),)], "t timestamp_ntz")
    got = [r[0] for r in df.select(is_night_guard("t", "22:00", "06:00")).collect()]
    assert got == [True, False]


def test_risk_score_goldens(spark):
    rows = [
        (1, 1, ts("2024-01-01 10:00:00"), 50.0, "alimentação", 0),
        (2, 1, ts("2024-01-01 10:00:00"), 500.0, "alimentação", 0),
        (3, 1, ts("2024-01-01 02:00:00"), 150.0, "jogos", 0),
        (4, 1, ts("2024-01-01 03:00:00"), 200.0, "jogos", 0),
        (5, 1, ts("2024-01-01 12:00:00"), 150.0, "lazer", 0),
        (6, 1, ts("2024-01-01 12:00:00"), 50.0, "alimentação", 4),
    ]
    df = spark.createDataFrame(rows, "id long, user_id long, timestamp timestamp_ntz, amount double, "
                                     "category string, recent_count int")
    out = risk.risk_recommendation(risk.impulse_risk(df)).orderBy("id").collect()
    assert [r.risk_score for r in out] == [0, 75, 100, 100, 57, 20]
    assert [r.is_high_risk for r in out] == [False, True, True, True, False, False]
    assert [r.risk_level for r in out] == ["low", "critical", "critical", "critical", "high", "low"]
    assert out[4].delay_minutes == 5 and out[1].delay_minutes == 10


def test_recent_count_bucketed_equals_plain_window(spark):
    # dense fixture: 40 rows of one user within 3 hours, some equal timestamps
    base = dt.datetime(2024, 1, 1, 22, 30)
    rows = [(i, 7, base + dt.timedelta(minutes=(i * 7) % 180), 10.0, "x") for i in range(40)]
    rows += [(100, 7, base + dt.timedelta(minutes=14), 1.0, "x")]
    df = _tx(spark, rows)
    a = {r.id: r.recent_count for r in risk.recent_1h_count(df).collect()}
    b = {r.id: r.recent_count for r in risk.recent_1h_count(df, bucketed=False).collect()}
    assert a == b and max(a.values()) >= 3


def test_recent_count_on_events(spark):
    tx = td.load_transactions(spark, SF_SMALL)
    a = risk.recent_1h_count(tx).select("id", F.col("recent_count").alias("a"))
    b = risk.recent_1h_count(tx, bucketed=False).select("id", F.col("recent_count").alias("b"))
    assert a.join(b, "id").filter("a != b").count() == 0


def test_protection(spark):
    df = spark.createDataFrame([(1, 1, ts("2024-01-10 02:00:00"), 150.0, "jogos"),
                                (2, 2, ts("2024-01-10 02:00:00"), 150.0, "jogos"),
                                (3, 3, ts("2024-01-20 02:00:00"), 150.0, "jogos")],
                               "id long, user_id long, timestamp timestamp_ntz, amount double, category string")
    st = spark.createDataFrame([(1, False, None), (3, True, ts("2024-01-15 00:00:00"))],
                               "user_id long, protection_enabled boolean, bypass_until timestamp_ntz")
    out = {r.id: r for r in risk.apply_protection(risk.impulse_risk(df, recent=None), st).collect()}
    assert out[1].allowed and out[1].checked_score == 0            # protection off
    assert not out[2].allowed and out[2].alert_type == "night"     # default: enabled
    assert not out[3].allowed and not out[3].bypass_active         # bypass over by then
