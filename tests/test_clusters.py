"""Multi-start k-means against plain numpy, one pass per iteration."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from moneta.operators import clusters as cl

Z = [f"z_{c}" for c in cl.FEATS]


def _tx(spark, n=600):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(n):
        g = i % 4
        rows.append((i, 1, float(round([20, 90, 300, 800][g] + rng.normal(0, 6), 2)), int([9, 14, 20, 2][g]), int(1 + (i // 4) % 28)))
    df = spark.createDataFrame(rows, "id long, user_id long, amount double, h int, d int")
    return df.select("id", "user_id", "amount", F.make_timestamp_ntz(F.lit(2024), F.lit(1), "d", "h", F.lit(0), F.lit(0)).alias("timestamp")).withColumn(
        "date", F.to_date("timestamp"))


def test_step_equals_numpy(spark):
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=(500, 3)), 2)
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double").repartition(7)
    centres = {0: x[:4], 5: np.round(rng.normal(size=(6, 3)), 2), 7: np.vstack([x[9], x[9], x[9] + 50])}  # equal centres, one without rows
    got = {(r["start"], r["cluster"]): r for r in cl.lloyd_step(df, centres, ["a", "b", "c"]).collect()}
    for s, c in centres.items():
        d = ((x[:, None] - c[None]) ** 2).sum(2)
        best = d.argmin(1)
        for k in range(len(c)):
            own = x[best == k]
            if not len(own):
                assert (s, k) not in got
                continue
            r = got.pop((s, k))
            assert r["n"] == len(own) and r["cost"] == pytest.approx(d[best == k, k].sum())
            assert [r["s0"], r["s1"], r["s2"]] == pytest.approx(own.sum(0).tolist())
    assert not got
    assert cl.lloyd_step(df.limit(0), centres, ["a", "b", "c"]).count() == 0


def test_one_scan_and_no_cached_copy(spark, tmp_path):
    spark.range(50).select(*[F.rand(i).alias(c) for i, c in enumerate(Z)]).write.parquet(str(tmp_path / "x"))
    df = spark.read.parquet(str(tmp_path / "x"))
    plan = cl.lloyd_step(df, {s: np.zeros((4, 3)) for s in range(10)}, Z)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and "InMemory" not in plan.replace("InMemoryFileIndex", "")


def test_spend_clusters(spark):
    tx = _tx(spark)
    out, cost = cl.spend_clusters(tx)
    rows = out.select("id", "amount", "cluster", *Z).toPandas()
    assert len(rows) == 600 and rows["cluster"].nunique() == 4
    mean = rows.groupby("cluster")["amount"].mean()
    assert mean.is_monotonic_increasing  # numbered by mean amount
    x = rows[Z].to_numpy()
    centre = rows.groupby("cluster")[Z].transform("mean").to_numpy()
    assert ((x - centre) ** 2).sum() == pytest.approx(cost, rel=1e-3)
    again, same = cl.spend_clusters(tx)
    assert same == pytest.approx(cost) and again.join(out, ["id", "cluster"]).count() == 600
    with pytest.raises(ValueError):
        cl.spend_clusters(tx.limit(5))
