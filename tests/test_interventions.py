import datetime as dt

from pyspark.sql import functions as F

from moneta.operators import interventions as iv


def test_levels(spark):
    df = spark.createDataFrame([(10,), (40,), (60,), (72,), (85,)], "s int")
    got = [r[0] for r in df.select(iv.intervention_level(F.col("s"))).collect()]
    assert got == ["gentle", "moderate", "strong", "strong", "critical"]


def test_impact_and_components(spark):
    df = spark.createDataFrame([(1, 1, dt.datetime(2024, 1, 1, 3), 200.0, "delivery", 85)],
                               "id long, user_id long, timestamp timestamp_ntz, amount double, category string, risk_score int")
    r = iv.generate_intervention(df).first()
    assert r.daily_food == "Com R$ 200.00, você poderia comer por 6.7 dias"
    assert r.subscriptions == "Equivale a 4.4 meses de streaming"
    assert r.investment == "Investido, em 5 anos seria R$ 322.10"
    assert r.work_hours == "Você trabalha 13.3 horas para ganhar isso"
    assert r.components == "question,visualization,alternative,delay,block"
    night = [q.replace("Xh", "3h") for q in iv.REFLECTIVE_QUESTIONS["noturno"]]
    assert len(r.questions) == 4 and r.questions[2] in night
    assert r.questions[3] in iv.REFLECTIVE_QUESTIONS["alto_valor"]
    assert set(r.questions[:2]) <= set(iv.REFLECTIVE_QUESTIONS["delivery"])
    assert r.block_reason.startswith("Bloqueio ativado devido a: transação em horário de alto risco")
    assert r.delay_minutes == 10 and r.main_message.endswith("[Modo Noturno Ativo]")


def test_choices_are_row_stable(spark):
    df = spark.createDataFrame([(i, 1, dt.datetime(2024, 1, 1, 12), 60.0, "lazer", 40) for i in range(5)],
                               "id long, user_id long, timestamp timestamp_ntz, amount double, category string, risk_score int")
    a = [r.questions for r in iv.generate_intervention(df).orderBy("id").collect()]
    b = [r.questions for r in iv.generate_intervention(df.repartition(3)).orderBy("id").collect()]
    assert a == b


def test_payload_holds_goals_in_order(spark):
    tx = spark.createDataFrame([(1, 1, dt.datetime(2024, 1, 1, 3), 200.0, "delivery", 85),
                                (2, 2, dt.datetime(2024, 1, 1, 12), 10.0, "x", 10)],
                               "id long, user_id long, timestamp timestamp_ntz, amount double, category string, risk_score int")
    goals = spark.createDataFrame([(8, 1, "Carro", 1000.0, 1000.0, "active"), (7, 1, "Viagem", 2000.0, 1000.0, "active"),
                                   (9, 1, "Velha", 10.0, 0.0, "completed")],
                                  "goal_id long, user_id long, name string, target_amount double, current_amount double, status string")
    r = {x.id: x.components for x in iv.intervention_payload(tx, goals).collect()}
    assert [c.type for c in r[1]] == ["question", "visualization", "comparison", "alternative", "delay", "block"]
    assert r[1][1].content[4] == "Este valor é 10.0% da sua meta 'Viagem'"
    assert r[1][2].content == ["Você tem 2 meta(s) ativa(s)"]
    assert [tuple(c) for c in r[1][2].comparisons] == [
        ("Viagem", 1000.0, 20.0, "Este gasto representa 20.0% do que falta para 'Viagem'")]
    assert r[1][4].minutes == 10 and r[1][4].expires_at == dt.datetime(2024, 1, 1, 3, 10)
    assert [c.type for c in r[2]] == ["question"]
    alone = {x.id: x.components for x in iv.intervention_payload(tx).collect()}
    assert [c.type for c in alone[1]] == ["question", "visualization", "alternative", "delay", "block"]
