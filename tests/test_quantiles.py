import numpy as np
import pandas as pd
import pytest

from moneta.functions.common import exact_quantiles


@pytest.mark.parametrize("parts", [4, 64])
def test_exact_quantiles_equal_numpy(spark, parts):
    rng = np.random.default_rng(4)
    v = np.concatenate([rng.normal(size=3000).round(2), np.full(2000, 0.5), [7.0]])
    pdf = pd.DataFrame({"k": rng.integers(0, 3, len(v)), "v": v})
    pdf.loc[len(pdf)] = [9, 1.25]
    df = spark.createDataFrame(pdf).repartition(5)
    qs = (0.0, 0.1, 0.25, 0.75, 0.999, 1.0)
    got = exact_quantiles(df, "v", qs, parts=parts).first()
    assert np.allclose([got[f"q{i}"] for i in range(len(qs))], np.quantile(pdf["v"], qs))
    for r in exact_quantiles(df, "v", qs, ["k"], parts=parts).collect():
        assert np.allclose([r[f"q{i}"] for i in range(len(qs))], np.quantile(pdf[pdf["k"] == r["k"]]["v"], qs))


def test_no_job_runs_while_a_query_is_built(spark):
    from moneta.functions.common import spread
    sc = spark.sparkContext
    sc.setJobGroup("build", "building")
    spread(spark.range(100).repartition(3).groupBy("id").count())
    assert len(sc.statusTracker().getJobIdsForGroup("build")) == 0
    sc.setJobGroup("rest", "rest")


def test_short_keys_keep_their_rows(spark):
    from conftest import SF_SMALL
    from moneta.plans.anomaly_report import detect_anomalies
    from moneta.plans.catalog import _tx
    from pyspark.sql import functions as F
    tx = _tx(spark, SF_SMALL)
    ids = [r["id"] for r in tx.filter("user_id is not null").orderBy("id").limit(5).collect()]
    tx = tx.withColumn("user_id", F.when(F.col("id").isin(ids), F.lit(-1).cast(tx.schema["user_id"].dataType)).otherwise(F.col("user_id")))
    out = detect_anomalies(tx, keys=("user_id",))
    assert out.count() == tx.count() and out.filter("method = 'heuristic'").count() >= 5


def test_documents_without_items_keep_their_header(spark):
    from moneta.sources.extraction import merge_bill_pages
    rows = [(1, 1, '{"banco": "A", "transacoes": []}'), (2, 1, '{"banco": "B", "transacoes": [{"descricao": "x", "valor": 1.0}]}'),
            (2, 2, '{"transacoes": null}')]
    df = spark.createDataFrame(rows, "doc_id long, page int, content string")
    got = sorted((r["doc_id"], r["banco"], r["descricao"]) for r in merge_bill_pages(df).collect())
    assert got == [(1, "A", None), (2, "B", "x")]


def test_retention_holds_over_appends(spark, tmp_path):
    from moneta.operators.notifications import write_notifications
    path = str(tmp_path / "log")
    for n in range(2):
        rows = [(f"{n}-{i}", 1, f"2024-01-0{1 + n} 00:0{i}:00", "c") for i in range(3)]
        df = spark.createDataFrame(rows, "notification_id string, user_id long, created_at string, category string")
        kept = write_notifications(df, path, keep=3)
    assert sorted(r["notification_id"] for r in kept.collect()) == ["1-0", "1-1", "1-2"]


def test_exact_quantiles_of_null_keys_and_odd_values(spark):
    inf, nan = float("inf"), float("nan")
    values = {1: [5e-324, -5e-324, 0.0, -0.0, 1e308, -1e308, 3.0], 2: [inf, -inf, 1.0], 3: [nan, 2.0, 1.0], None: [4.0, 8.0, None], 4: [None]}
    rows = [(k, v) for k, vs in values.items() for v in vs]
    df = spark.createDataFrame(rows, "k long, v double")
    qs = (0.0, 0.5, 1.0)
    got = {r["k"]: [r["q0"], r["q1"], r["q2"]] for r in exact_quantiles(df, "v", qs, ["k"]).collect()}
    assert set(got) == {1, 2, 3, None}
    assert got[1] == [-1e308, 0.0, 1e308] and got[2] == [-inf, 1.0, inf] and got[None] == [4.0, 6.0, 8.0]
    assert got[3][:2] == [1.0, 2.0] and np.isnan(got[3][2])
    assert exact_quantiles(df.filter("v is null"), "v", qs, ["k"]).count() == 0


def test_no_percentile_over_a_hot_key(spark):
    from moneta.operators.anomaly import anomaly_features
    from moneta.operators.spend import spend_summary
    df = spark.createDataFrame([(1, 7, 5.0, "a")], "id long, user_id long, amount double, category string")
    for out in (spend_summary(df), anomaly_features(df)):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "percentile(" not in plan and "median(" not in plan


def test_label_encoder_is_a_dense_rank(spark):
    from pyspark.sql import functions as F
    from moneta.operators.anomaly import label_encode, label_encoder
    words = sorted({f"{i * 7919 % 5000:04x}é{i % 3}" for i in range(5000)} | {"outros"})
    df = spark.createDataFrame([(w,) for w in words * 2] + [(None,)], "category string").repartition(7)
    codes = {r["value"]: r["code"] for r in label_encoder(df).collect()}
    assert codes == {w: i for i, w in enumerate(sorted(words, key=lambda w: w.encode()))}
    seen = label_encode(spark.createDataFrame([("new",), (None,), (words[5],)], "category string"), label_encoder(df))
    assert [r["category_encoded"] for r in seen.orderBy(F.col("category").asc_nulls_first()).collect()][0] == codes["outros"]
    assert sorted(r["category_encoded"] for r in seen.collect()) == sorted([-1, codes["outros"], 5])
    assert label_encoder(df.limit(0)).count() == 0
