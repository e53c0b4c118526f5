"""Snapshot plus change log: what is read, compaction, and what is shuffled."""
import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from moneta.plans import catalog
from moneta.sources.state_table import StateTable

COLS = {"name": "string", "limit": "double", "flag": "boolean", "best": "double"}
LOG = "k long, ts timestamp_ntz, limit double, flag boolean, best double"
T0 = dt.datetime(2024, 1, 1)


def _table(spark, name, buckets=4):
    return StateTable(spark, catalog.scratch(spark, name), "k", "bigint", COLS, latest=["limit", "flag"], highest=["best"], buckets=buckets)


def _log(n, seed=1):
    rng = random.Random(seed)
    return [(1 if i % 3 == 0 else rng.randrange(40) if i % 11 else None, T0 + dt.timedelta(minutes=rng.randrange(300)) if i % 17 else None,
             rng.choice([None, float(rng.randrange(90))]), rng.choice([None, True, False]), rng.choice([None, float(rng.randrange(90))]))
            for i in range(n)]


def _plain(base, log):
    state = {k: [name, limit, None, None] for k, name, limit in base}
    for k, ts, limit, flag, best in log:
        if k is not None:
            state.setdefault(k, [None, None, None, None])
    for k, s in state.items():
        own = [r for r in log if r[0] == k]
        for at, col in ((1, 2), (2, 3)):
            seen = [(r[1], r[col]) for r in own if r[1] is not None and r[col] is not None]
            if seen:
                s[at] = max(seen)[1]
        s[3] = max((r[4] for r in own if r[4] is not None), default=None)
    return sorted((k, *s) for k, s in state.items())


BASE = [(k, f"user {k}", float(k)) for k in range(30)]


def _read(t):
    return sorted(map(tuple, t.read().select("k", "name", "limit", "flag", "best").collect()))


@pytest.fixture(scope="module")
def base(spark):
    return spark.createDataFrame(BASE, "k long, name string, limit double")


def test_same_rows_before_and_after_compaction(spark, base):
    log = _log(600)  # in any order of time, so later appends hold older changes
    t = _table(spark, "state").start(base)
    assert _read(t) == _plain(BASE, [])
    done = 0
    for n, compact in ((200, True), (450, False), (600, True)):
        t.append(spark.createDataFrame(log[done:n], LOG))
        done = n
        want = _plain(BASE, log[:n])
        assert _read(t) == want
        if compact:
            assert _read(t.compact()) == want
    again = StateTable(spark, t.path, "k", "bigint", COLS, latest=["limit", "flag"], highest=["best"], buckets=4)  # another session
    assert again.version == 2 and _read(again) == _plain(BASE, log)


def test_reading_shuffles_the_changes_only(spark, base):
    t = _table(spark, "plan", buckets=8).start(base)
    t.append(spark.createDataFrame(_log(50), LOG))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = t.read()._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    join = plan.index("SortMergeJoin")
    assert "Exchange" not in plan[join:plan.index("Bucketed: true", join)]  # the base is read in its buckets
    assert len(re.findall(r"Exchange hashpartitioning\(_key#\d+L, 8\)", plan)) == 1  # one row a changed key is dealt to them


def test_a_lost_compaction_changes_nothing(spark, base):
    t = _table(spark, "lost").start(base)
    t.append(spark.createDataFrame(_log(80), LOG))
    want = _read(t)
    # files of a compaction that never ended: no _SUCCESS
    t.read(with_times=True).limit(3).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{t.path}/base-1")
    again = StateTable(spark, t.path, "k", "bigint", COLS, latest=["limit", "flag"], highest=["best"], buckets=4)
    assert again.version == 0 and _read(again) == want


def test_empty_tables(spark, base):
    t = _table(spark, "empty").start(base.limit(0))
    assert _read(t) == []
    t.append(spark.createDataFrame([], LOG))
    assert _read(t.compact()) == []
    t.append(spark.createDataFrame([(None, T0, 1.0, True, 1.0)], LOG))
    assert _read(t) == []
    with pytest.raises(ValueError):
        _table(spark, "none").base()
