from pyspark.sql import functions as F

from conftest import SF_SMALL
from moneta.operators import risk
from moneta.plans import catalog
from moneta.sources import testdata as td
from moneta.streaming import risk_stream as rs


def test_stream_risk_equals_batch(spark):
    s = catalog.QUERIES["stream_risk"](spark, SF_SMALL)
    b = risk.impulse_risk(risk.recent_1h_count(td.load_transactions(spark, SF_SMALL)))
    j = s.alias("s").join(b.alias("b"), "id")
    assert j.count() == b.count()
    assert j.filter((F.col("s.recent_count") != F.col("b.recent_count"))
                    | (F.col("s.risk_score") != F.col("b.risk_score"))).count() == 0


def test_rows_late_inside_the_watermark_are_counted(spark):
    import datetime as dt
    schema = "id long, user_id long, timestamp timestamp_ntz, amount double, category string"
    t0 = dt.datetime(2024, 1, 1, 10)
    arrival = [[(1, 0), (2, 20)], [(3, 10), (4, 65)], [(5, 30), (6, 80), (7, 80)], [(8, 200)]]  # id, minute
    frames = [spark.createDataFrame([(i, 1, t0 + dt.timedelta(minutes=m), 10.0, None) for i, m in rows], schema) for rows in arrival]
    tx = frames[0]
    for f in frames[1:]:
        tx = tx.unionByName(f)
    frames[-1] = rs.time_slices(frames[-1], "timestamp", slices=1)[-1]  # with the end marker
    base = catalog.scratch(spark, "late")
    rs.feed(frames, base, rs.stream_recent_counts)
    got = {r.id: r.recent_count for r in spark.read.parquet(f"{base}/out").collect()}
    assert got == {r.id: r.recent_count for r in risk.recent_1h_count(tx).collect()}
    assert got[2] == 2


def test_stream_daily_reaches_the_last_day(spark):
    from moneta.operators.spend import daily_spend
    s = catalog.QUERIES["stream_daily"](spark, SF_SMALL)
    days = daily_spend(td.load_transactions(spark, SF_SMALL))
    assert sorted(map(tuple, s.select("user_id", "date").collect())) == sorted(map(tuple, days.select("user_id", "date").collect()))


def test_stream_delays_releases_every_delay_once(spark):
    from moneta.operators import interventions as iv
    out = catalog.QUERIES["stream_delays"](spark, SF_SMALL)
    sc = risk.impulse_risk(risk.recent_1h_count(td.load_transactions(spark, SF_SMALL)))
    d = iv.delay(iv.with_context(sc)).filter(F.col("delay_minutes").isNotNull())
    got = [r.transaction_id for r in out.collect()]
    assert len(got) == len(set(got)) and set(got) == {r.id for r in d.select("id").collect()}


def test_hot_user_in_shuffled_order_equals_batch(spark):
    """One user has nearly all rows of a slice; rows arrive in any order inside the watermark."""
    import datetime as dt
    import random
    rng = random.Random(6)
    t0 = dt.datetime(2024, 3, 1)
    rows = [(i, 1 if i % 10 else 2 + i % 7, t0 + dt.timedelta(seconds=rng.randrange(0, 6 * 3600, 20)), 10.0, "x" if i % 2 else None) for i in range(6000)]
    rows.sort(key=lambda r: (r[2] - t0).seconds // 1800 + rng.random())  # half an hour out of order at most
    schema = "id long, user_id long, timestamp timestamp_ntz, amount double, category string"
    frames = [spark.createDataFrame(rows[i:i + 1500], schema) for i in range(0, 6000, 1500)]
    tx = spark.createDataFrame(rows, schema)
    last = spark.createDataFrame([(-1, -1, t0 + dt.timedelta(days=3), None, None)], schema)
    base = catalog.scratch(spark, "hot")
    rs.feed([*frames, last], base, rs.stream_recent_counts)
    got = {r.id: (r.user_id, r.timestamp, r.amount, r.category, r.recent_count) for r in spark.read.parquet(f"{base}/out").collect()}
    assert got == {r.id: (r.user_id, r.timestamp, r.amount, r.category, r.recent_count) for r in risk.recent_1h_count(tx).collect()}


def test_delay_set_again_is_released_at_its_latest_expiry(spark):
    import datetime as dt
    m = lambda n: dt.datetime(2024, 3, 1) + dt.timedelta(minutes=n)
    schema = "user_id long, transaction_id long, set_at timestamp_ntz, expires_at timestamp_ntz"
    frames = [spark.createDataFrame(r, schema) for r in (
        [(1, 10, m(0), m(30)), (1, 11, m(5), m(35)), (2, 10, m(6), m(66))], [(1, 10, m(20), m(80))], [(3, 1, m(400), m(430))], [(-1, -1, m(9000), m(20000))])]
    base = catalog.scratch(spark, "again")
    rs.feed(frames, base, rs.stream_delays)
    got = sorted((r.user_id, r.transaction_id, r.expires_at, r.can_proceed) for r in spark.read.parquet(f"{base}/out").collect())
    assert got == [(1, 10, m(80), True), (1, 11, m(35), True), (2, 10, m(66), True), (3, 1, m(430), True)]
