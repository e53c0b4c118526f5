"""Read marks as a bucketed as-of join; notifications from one pass."""
import bisect
import datetime as dt
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from moneta.operators import notifications as nt

START = dt.datetime(2024, 1, 1)


def _tables(spark, notifs, marks):
    n = spark.createDataFrame(notifs, "notification_id string, user_id long, created_at timestamp_ntz, _first string")
    return n, spark.createDataFrame(marks, "user_id long, at timestamp_ntz")


def _first_mark(marks):
    by = defaultdict(list)
    for u, t in marks:
        if t is not None:
            by[u].append(t)
    for v in by.values():
        v.sort()

    def first(u, t):
        i = bisect.bisect_left(by[u], t) if t is not None else len(by[u])
        return by[u][i] if i < len(by[u]) else None
    return first


@pytest.mark.parametrize("bucket", ["hour", "day", "month"])
def test_next_marks_against_search(spark, bucket):
    rng = random.Random(3)
    at = lambda: START + dt.timedelta(minutes=rng.randrange(0, 200_000, 30))  # noqa: E731  ties are frequent
    notifs = [(f"n{i}", 1 if i % 3 else rng.randrange(2, 60), at(), "clash") for i in range(6000)]  # one user has two thirds
    notifs += [("x1", 1, None, ""), ("x2", None, at(), ""), ("x3", 7, START + dt.timedelta(days=999), "")]
    marks = [(1 if i % 3 else rng.randrange(2, 60), at()) for i in range(400)] + [(5, None), (99, at())]
    n, m = _tables(spark, notifs, marks)
    got = {r["notification_id"]: r["_next"] for r in nt.next_marks(n, m, bucket).collect()}
    first = _first_mark(marks)
    assert got == {i: first(u, t) if u is not None else None for i, u, t, _ in notifs}


def test_no_window_over_a_whole_user(spark):
    n, m = _tables(spark, [("a", 1, START, "")], [(1, START)])
    plan = nt.next_marks(n, m)._jdf.queryExecution().optimizedPlan().toString()
    windows = re.findall(r"^.*Window \[.*$", plan, re.M)
    assert len(windows) == 2
    rows = [w for w in windows if "_mark" in w]
    assert len(rows) == 1 and re.search(r"\[user_id#\d+L, _b#\d+\]", rows[0])  # rows: by user and bucket
    below = plan[plan.index([w for w in windows if "_first" in w][0]):]
    assert re.match(r".*Window[^\n]*\n[^\n]*Aggregate \[user_id#\d+L, _b#\d+\]", below)  # the other: one row a bucket


def test_resolve_reads(spark):
    day = dt.timedelta(days=1)
    n, m = _tables(spark, [("a", 1, START, ""), ("b", 1, START + 2 * day, ""), ("c", 2, START, "")], [(1, START + day), (1, START + day)])
    reads = spark.createDataFrame([("b", START + 3 * day), ("b", START + 4 * day), ("a", START + 5 * day), ("zz", START)],
                                  "notification_id string, read_at timestamp_ntz")
    got = {r["notification_id"]: (r["read"], r["read_at"]) for r in nt.resolve_reads(n, reads, m).collect()}
    assert got == {"a": (True, START + day), "b": (True, START + 3 * day), "c": (False, None)}
    only = {r["notification_id"]: r["read_at"] for r in nt.resolve_reads(n, reads).collect()}
    assert only == {"a": START + 5 * day, "b": START + 3 * day, "c": None}
    assert nt.resolve_reads(n.limit(0), reads, m).count() == 0


def test_templates_in_one_pass_equal_one_by_one(spark):
    src = spark.createDataFrame([(1, 5.0, 3, True), (2, None, 4, True), (3, 7.0, None, False), (4, 9.0, 1, None)],
                                "id long, amount double, hour int, flag boolean").withColumn("user_id", F.col("id") % 2)
    fields = {"amount": F.col("amount"), "hour": F.col("hour")}
    rules = {"night_alert": (F.col("flag"), fields), "impulse_blocked": (F.col("amount") > 6, {"amount": F.col("amount"), "reason": F.lit("x")})}
    at = F.lit(START)
    both = nt.notify_from_templates(src, rules, F.col("id"), at)
    single = None
    for name, (when, f) in rules.items():
        one = nt.notify_from_template(src.filter(when), name, f, F.col("id"), at)
        single = one if single is None else single.unionByName(one)
    assert sorted(map(tuple, both.select(*nt.NOTIF_COLS).collect())) == sorted(map(tuple, single.select(*nt.NOTIF_COLS).collect()))
    assert both.count() == 3
