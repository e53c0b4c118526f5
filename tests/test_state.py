import datetime as dt

from pyspark.sql import functions as F

from conftest import ts
from moneta.operators import notifications as nt
from moneta.operators import risk, state


def test_goal_updates_sticky_completion(spark):
    goals = spark.createDataFrame([(1, 1, "Viagem", 1000.0, 100.0, "active")],
                                  "goal_id long, user_id long, name string, target_amount double, current_amount double, status string")
    log = spark.createDataFrame([(1, 1200.0, ts("2024-01-01 10:00:00")), (1, 300.0, ts("2024-01-02 10:00:00"))],
                                "goal_id long, amount double, ts timestamp_ntz")
    r = state.goal_updates(goals, log).first()
    assert r.current_amount == 300.0 and r.status == "completed"      # never reverts


def test_upsert_field_wise(spark):
    base = spark.createDataFrame([(1, "ana", 100.0, None)], "user_id long, username string, daily_limit double, monthly_limit double")
    up = spark.createDataFrame([(1, ts("2024-01-01 00:00:00"), None, 50.0, 900.0),
                                (1, ts("2024-01-02 00:00:00"), None, None, 800.0),
                                (2, ts("2024-01-03 00:00:00"), "bia", 10.0, None)],
                               "user_id long, ts timestamp_ntz, username string, daily_limit double, monthly_limit double")
    got = {r.user_id: r for r in state.upsert(base, up, ["user_id"], "ts",
                                               ["username", "daily_limit", "monthly_limit"]).collect()}
    assert (got[1].username, got[1].daily_limit, got[1].monthly_limit) == ("ana", 50.0, 800.0)
    assert (got[2].username, got[2].daily_limit, got[2].monthly_limit) == ("bia", 10.0, None)


def test_reads_as_of_mark_all(spark):
    n = spark.createDataFrame([("a", 1, ts("2024-01-01 10:00:00")), ("b", 1, ts("2024-01-01 12:00:00")),
                               ("c", 1, ts("2024-01-01 15:00:00")), ("d", 2, ts("2024-01-01 10:00:00"))],
                              "notification_id string, user_id long, created_at timestamp_ntz")
    reads = spark.createDataFrame([("a", ts("2024-01-01 10:30:00"))], "notification_id string, read_at timestamp_ntz")
    marks = spark.createDataFrame([(1, ts("2024-01-01 11:00:00")), (1, ts("2024-01-01 13:00:00"))],
                                  "user_id long, at timestamp_ntz")
    got = {r.notification_id: r.read_at for r in nt.resolve_reads(n, reads, marks).collect()}
    assert got == {"a": ts("2024-01-01 10:30:00"), "b": ts("2024-01-01 13:00:00"), "c": None, "d": None}
    assert {r.user_id: r.unread for r in nt.unread_count(nt.resolve_reads(n, reads, marks)).collect()} == {1: 1, 2: 1}


def test_delay_status(spark):
    d = spark.createDataFrame([(1, 10, ts("2024-01-01 10:00:00"), ts("2024-01-01 10:05:00"), 5),
                               (1, 10, ts("2024-01-01 10:02:00"), ts("2024-01-01 10:12:00"), 10)],
                              "user_id long, transaction_id long, set_at timestamp_ntz, expires_at timestamp_ntz, minutes int")
    r = state.delay_status(d, F.lit(ts("2024-01-01 10:06:00")).cast("timestamp_ntz")).first()
    assert r.active and r.remaining_seconds == 360 and r.remaining_minutes == 6.0 and not r.can_proceed


def test_templates_skip_missing_fields(spark):
    src = spark.createDataFrame([(1, 1, 129.9, None, 67), (2, 1, 10.0, "lazer", 55)],
                                "id long, user_id long, amount double, category string, score int")
    out = nt.notify_from_template(src, "anomaly_detected", {"amount": F.col("amount"), "category": F.col("category"),
                                                            "score": F.col("score")}, F.col("id"), F.current_timestamp())
    rows = out.collect()
    assert len(rows) == 1 and rows[0].message == "Detectamos um gasto incomum: R$ 10.00 em lazer. Score de anomalia: 55/100"
    assert (rows[0].category, rows[0].type) == ("anomaly", "warning")


def test_hot_user_window_is_split_by_hour(spark):
    # one user with a third of all rows: the last-hour window is partitioned by (user, hour bucket)
    base = dt.datetime(2024, 1, 1)
    rows = [(i, 1 if i % 3 == 0 else i, base + dt.timedelta(minutes=i), 1.0, "x") for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, user_id long, timestamp timestamp_ntz, amount double, category string")
    q = risk.recent_1h_count(df)
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(user_id" in plan and "_hb" in plan
    a = {r.id: r.recent_count for r in q.collect()}
    b = {r.id: r.recent_count for r in risk.recent_1h_count(df, bucketed=False).collect()}
    assert a == b


def test_guard_log_latest_wins(spark):
    t = lambda m: dt.datetime(2024, 1, 1, 10, m)
    rows = [(1, t(0), "disable", None), (1, t(5), "enable", None),
            (2, t(0), "enable", None), (2, t(5), "disable", None),
            (3, t(0), "bypass", None), (4, t(0), "bypass", 10), (4, t(5), "enable", None),
            (5, t(0), "bypass", 10), (5, t(5), "disable", None), (6, t(0), "other", None), (7, t(50), "disable", None)]
    log = spark.createDataFrame(rows, "user_id long, ts timestamp_ntz, action string, minutes int")
    got = {r[0]: r[1:] for r in map(tuple, state.guard_state(log, F.lit("2024-01-01 10:40:00").cast("timestamp_ntz")).collect())}
    assert got == {1: (True, None), 2: (False, None), 3: (True, t(30)), 4: (True, None), 5: (False, t(10)), 6: (True, None)}
    assert {r[0]: r[1] for r in map(tuple, state.guard_state(log).collect())}[7] is False


def test_create_notification_defaults(spark):
    df = spark.createDataFrame([(1, 9, "warning"), (2, 9, "strange"), (3, 9, None)], "id long, user_id long, kind string")
    at = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    r = nt.create_notification(df, F.lit("T"), F.lit("M"), F.col("id"), at, F.col("kind"), data=F.struct("id")).orderBy("data.id").collect()
    assert [(x.type, x.category, x.title, x.template) for x in r] == [
        ("warning", "general", "T", None), ("info", "general", "T", None), ("info", "general", "T", None)]
    assert nt.create_notification(df, F.lit("T"), F.lit("M"), F.col("id"), at).columns == nt.NOTIF_COLS
