import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from moneta.operators import anomaly as an
from moneta.operators import iforest
from moneta.plans import anomaly_report as ar


def test_heuristic_golden(spark):
    rows = [(1, 1, dt.datetime(2024, 1, 1, 12), 100.0, "alimentação"),
            (2, 1, dt.datetime(2024, 1, 1, 2), 1000.0, "jogos")]
    df = spark.createDataFrame(rows, "id long, user_id long, timestamp timestamp_ntz, amount double, category string")
    out = {r.id: r for r in an.anomaly_heuristic(df).collect()}
    assert out[1].anomaly_score == 0 and not out[1].is_anomaly
    assert out[2].anomaly_score == 55 and out[2].is_anomaly
    assert out[2].anomaly_reasons == ["Horário noturno: 2h", "Categoria de risco: jogos"]


def test_normalize_scores_golden(spark):
    df = spark.createDataFrame([(i, 1, s) for i, s in enumerate([-0.8, -0.4, 0.2, 0.7, 1.2])],
                               "id long, user_id long, s double")
    got = [round(r.score_normalized, 9) for r in an.normalize_scores(df, "s").orderBy("id").collect()]
    assert got == [100.0, 80.0, 50.0, 25.0, 0.0]
    same = spark.createDataFrame([(1, 1, 0.3), (2, 1, 0.3)], "id long, user_id long, s double")
    assert {r.score_normalized for r in an.normalize_scores(same, "s").collect()} == {50.0}


def test_grow_forest_isolates_outlier():
    rng = np.random.default_rng(1)
    X = rng.normal(size=(500, 4))
    X[7] = [9, 9, 9, 9]
    samples = np.stack([np.sort(rng.choice(500, 256, replace=False)) for _ in range(100)])
    tr = iforest.grow_forest(X, samples, rng, 8)
    ff = iforest.FlatForest(tr["feature"], tr["threshold"], tr["left"], tr["right"], tr["value"],
                            np.arange(100), 256)
    s = -ff.score_samples(X)
    assert np.all((s > 0) & (s < 1)) and int(np.argmax(s)) == 7


def _batch(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(400):
        amt = float(round(rng.uniform(20, 200), 2))
        rows.append((i, 1 + i % 4, dt.datetime(2024, 1, 1 + i % 28, 10 + i % 8), amt, ["lazer", "delivery"][i % 2]))
    rows.append((999, 1, dt.datetime(2024, 1, 6, 3), 5000.0, "jogos"))
    return spark.createDataFrame(rows, "id long, user_id long, timestamp timestamp_ntz, amount double, category string")


def test_forest_global_properties(spark):
    d = ar.detect_anomalies(_batch(spark), keys=())
    n = d.count()
    flagged = d.filter("is_anomaly").count()
    assert abs(flagged / n - 0.1) < 0.03
    top = d.orderBy(F.col("anomaly_score").desc()).first()
    assert top.id == 999 and top.anomaly_score == 100.0
    assert "Valor muito acima da média" in top.anomaly_reasons[0]


def test_forest_per_key_does_not_depend_on_the_task_size(spark):
    from moneta.plans.anomaly_report import ZCOLS
    feats = an.standardize(an.anomaly_features(_batch(spark)))
    outs = [iforest.fit_score_by_key(feats, ZCOLS, rows_per_task=n) for n in (200_000, 40)]  # one task, eleven tasks
    for out in outs:
        assert out.count() == 401
        top = out.orderBy("score_samples").first()
        assert top.id == 999 and top.is_anomaly
    one, many = [{r.id: (r.is_anomaly, r.score_samples) for r in out.collect()} for out in outs]
    assert one == many


def test_short_users_keep_their_rows(spark):
    few = _batch(spark).limit(5).withColumn("user_id", F.lit(77).cast("long")).withColumn("id", F.col("id") + 10_000)
    both = _batch(spark).unionByName(few)
    d = ar.detect_anomalies(both, keys=("user_id",))
    assert d.count() == both.count()
    assert {r.method for r in d.filter("user_id = 77").select("method").collect()} == {"heuristic"}


def test_model_scores_another_batch(spark):
    from conftest import SF_SMALL
    from moneta.plans import anomaly_report as ar
    from moneta.session import checkpoint_dir
    from moneta.sources import testdata as td
    tx = td.load_transactions(spark, SF_SMALL)
    model, scored = ar.fit_anomaly_model(tx.filter("category <> 'jogos'"))
    path = f"{checkpoint_dir(spark).rstrip('/')}/anomaly-model-test"
    model.persist(path)
    again = ar.AnomalyModel.load(spark, path)
    new = tx.filter("category = 'jogos' AND id % 2 = 0")
    a = sorted((r.id, r.is_anomaly, r.anomaly_score, r.category_encoded, r.method) for r in ar.detect_anomalies(new, model=model).collect())
    b = sorted((r.id, r.is_anomaly, r.anomaly_score, r.category_encoded, r.method) for r in ar.detect_anomalies(new, model=again).collect())
    assert a == b and len(a) == new.count() > 0
    assert all(r[3] == -1 and r[4] == "isolation_forest" and 0 <= r[2] <= 100 for r in a)
    assert ar.detect_anomalies(tx.limit(5), model=model).count() == 5  # a small batch needs no fit
    assert ar.fit_anomaly_model(tx.limit(5)) is None
    assert ar.detect_anomalies(tx.limit(5)).select("method").distinct().collect()[0][0] == "heuristic"


def test_small_keys_share_a_group(spark):
    """A group's fixed cost is paid for many keys, and a key's scores don't depend on who shares its group."""
    g = np.random.default_rng(3)
    rows = [(u, u * 1000 + i, *map(float, g.normal(size=8))) for u in range(40) for i in range(9 + u % 4)]
    feats = spark.createDataFrame(rows, "user_id long, id long, " + ", ".join(f"{z} double" for z in ar.ZCOLS))

    def run(f, **kw):
        return {(r.user_id, r.id): r.score_samples for r in iforest.fit_score_by_key(f, ar.ZCOLS, n_trees=10, **kw).collect()}

    together = run(feats)
    assert len(together) == len(rows) and sum(v is None for v in together.values()) == 90  # ten users of nine rows
    alone = run(feats.filter("user_id = 7"))
    assert all(together[k] == v for k, v in alone.items()) and len(alone) == 12
    assert together == run(feats, rows_per_task=10)  # keys of more rows are dealt to salts
