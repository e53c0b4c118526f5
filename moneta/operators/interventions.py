"""Behavioural interventions built from per-transaction projections.

Random choices of the original become a deterministic order by
``md5(id || '|' || text)`` (row-stable, identical in any SQL engine); time of
day is the transaction's own time, not the clock.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moneta import params as P
from moneta.functions.common import lit_array, rnd

# FIXED VALUES — reflective questions per category
REFLECTIVE_QUESTIONS = {
    "default": [
        "Esta compra estava no seu planejamento?",
        "Como você vai se sentir amanhã com esta decisão?",
        "Você realmente precisa disso agora?",
        "O que aconteceria se você esperasse uma semana?",
        "Esta compra te aproxima ou afasta das suas metas?",
    ],
    "delivery": [
        "Você tem comida em casa que poderia preparar?",
        "Quanto você já gastou com delivery esta semana?",
        "Cozinhar não seria mais saudável e econômico?",
        "Este pedido é por fome real ou por impulso?",
    ],
    "jogos": [
        "Quanto tempo e dinheiro você investiu em jogos este mês?",
        "Este gasto vai te trazer satisfação duradoura?",
        "Você está jogando para se divertir ou para escapar?",
        "O que mais você poderia fazer com esse valor?",
    ],
    "compras": [
        "Você pesquisou preços em outros lugares?",
        "Este item vai ser usado regularmente?",
        "Você tem algo similar que poderia usar?",
        "Por que você quer isso agora e não daqui a uma semana?",
    ],
    "lazer": [
        "Existem alternativas gratuitas para este programa?",
        "Quanto você já gastou com lazer este mês?",
        "Este momento de lazer será memorável?",
        "Você poderia fazer algo igualmente prazeroso gastando menos?",
    ],
    "noturno": [
        "Você está tomando esta decisão descansado?",
        "Compras de madrugada tendem a ser por impulso. É o caso?",
        "O que te levou a querer comprar isso agora, às Xh?",
        "Amanhã de manhã você ainda vai querer isso?",
    ],
    "alto_valor": [
        "Você tem reserva de emergência?",
        "Este valor representa quanto do seu salário?",
        "Você conversou com alguém sobre esta compra?",
        "Este gasto está no seu orçamento mensal?",
    ],
}

# FIXED VALUES — alternatives per category
ALTERNATIVES = {
    "delivery": [
        "Preparar uma refeição simples em casa",
        "Pedir algo mais barato no mesmo lugar",
        "Usar cupom de desconto se disponível",
        "Dividir o pedido com alguém",
    ],
    "compras": [
        "Adicionar à lista de desejos e esperar 48h",
        "Procurar produto similar usado",
        "Esperar uma promoção ou Black Friday",
        "Verificar se já não tem algo parecido",
    ],
    "lazer": [
        "Buscar eventos gratuitos na cidade",
        "Fazer um programa em casa",
        "Usar pontos ou milhas acumulados",
        "Combinar com amigos e dividir custos",
    ],
    "assinaturas": [
        "Cancelar assinaturas não utilizadas primeiro",
        "Buscar plano família ou estudante",
        "Usar período de teste gratuito",
        "Alternar entre serviços mensalmente",
    ],
}

# FIXED VALUES — main messages and actions per level
MAIN_MESSAGES = {
    "gentle": ["Tudo bem prosseguir, mas considere estas reflexões:",
               "Antes de confirmar, uma rápida reflexão:"],
    "moderate": ["⚠️ Atenção! Esta compra merece uma reflexão.",
                 "⚠️ Pause um momento e considere:"],
    "strong": ["🚨 Alerta: Alto risco de compra por impulso!",
               "🚨 Cuidado! Este padrão indica possível impulso."],
    "critical": ["🛑 ATENÇÃO MÁXIMA: Bloqueio de segurança ativado!",
                 "🛑 PARE! Esta compra foi temporariamente bloqueada."],
}
ACTIONS = {
    "gentle": ["proceed", "cancel"],
    "moderate": ["reflect", "proceed", "cancel"],
    "strong": ["wait", "add_to_wishlist", "cancel"],
    "critical": ["cancel", "override"],
}
NIGHT_SUFFIX = " [Modo Noturno Ativo]"
BLOCK_PREFIX = "Bloqueio ativado devido a: "
BLOCK_REASONS = ["transação em horário de alto risco (madrugada)",
                 "padrão de compra por impulso detectado",
                 "valor significativo requer reflexão",
                 "múltiplos fatores de risco identificados"]
INVESTMENT_FACTOR = 1.10 ** 5


def intervention_level(score: Column) -> Column:
    """<30 gentle, <50 moderate, <75 strong, else critical (not the guard's 70)."""
    return (F.when(score < 30, "gentle").when(score < 50, "moderate").when(score < 75, "strong")
            .otherwise("critical"))


def _pick(id_col: Column, options: Column, n: int) -> Column:
    """The first n options ordered by md5(id | option): a row-stable shuffle."""
    keyed = F.transform(options, lambda q: F.struct(F.md5(F.concat(id_col.cast("string"), F.lit("|"), q)).alias("h"),
                                                    q.alias("q")))
    return F.slice(F.transform(F.sort_array(keyed), lambda x: x["q"]), 1, n)


def _map_of_arrays(d: dict[str, list[str]]) -> Column:
    return F.create_map(*[x for k, v in d.items() for x in (F.lit(k), lit_array(v))])


def with_context(scored: DataFrame, id_col: str = "id", ts: str = "timestamp",
                 score: str = "risk_score") -> DataFrame:
    """Level, lower-cased category, night flag (hour 0-6 of the transaction)."""
    return (scored.withColumn("level", intervention_level(F.col(score)))
            .withColumn("_cat", F.lower(F.coalesce(F.col("category"), F.lit("outros"))))
            .withColumn("_night", (F.hour(ts) >= 0) & (F.hour(ts) <= 6))
            .withColumn("_hour", F.hour(ts)))


def questions(df: DataFrame, id_col: str = "id") -> DataFrame:
    """2 of the category's questions, + 1 night question ('Xh' -> hour), + 1
    high-value question when amount >= 200; none -> 2 default; at most 4."""
    i = F.col(id_col)
    qmap = _map_of_arrays(REFLECTIVE_QUESTIONS)
    cat_q = F.coalesce(_pick(i, F.element_at(qmap, F.col("_cat")), 2), F.array().cast("array<string>"))
    night_q = F.when(F.col("_night"), F.transform(_pick(i, lit_array(REFLECTIVE_QUESTIONS["noturno"]), 1),
                                                  lambda q: F.replace(q, F.lit("Xh"),
                                                                      F.concat(F.col("_hour").cast("string"), F.lit("h")))))
    high_q = F.when(F.col("amount") >= 200, _pick(i, lit_array(REFLECTIVE_QUESTIONS["alto_valor"]), 1))
    allq = F.concat(cat_q, F.coalesce(night_q, F.array().cast("array<string>")),
                    F.coalesce(high_q, F.array().cast("array<string>")))
    allq = F.when(F.size(allq) == 0, _pick(i, lit_array(REFLECTIVE_QUESTIONS["default"]), 2)).otherwise(allq)
    return df.withColumn("questions", F.slice(allq, 1, 4))


def impact(df: DataFrame) -> DataFrame:
    """What the amount means in food days, streaming months, 5-year investment
    at 10% and work hours (only for amounts >= 50)."""
    a = F.col("amount")
    big = a >= 50
    return (df.withColumn("daily_food", F.when(big, F.format_string(
                "Com R$ %.2f, você poderia comer por %.1f dias", rnd(a, 2), rnd(a / 30, 1))))
            .withColumn("subscriptions", F.when(big, F.format_string(
                "Equivale a %.1f meses de streaming", rnd(a / 45, 1))))
            .withColumn("investment", F.when(big, F.format_string(
                "Investido, em 5 anos seria R$ %.2f", rnd(a * F.lit(INVESTMENT_FACTOR), 2))))
            .withColumn("work_hours", F.when(big, F.format_string(
                "Você trabalha %.1f horas para ganhar isso", rnd(a / 15, 1)))))


def alternatives(df: DataFrame, id_col: str = "id") -> DataFrame:
    amap = _map_of_arrays(ALTERNATIVES)
    return df.withColumn("alternatives", _pick(F.col(id_col), F.element_at(amap, F.col("_cat")), 2))


def delay(df: DataFrame, ts: str = "timestamp", base_minutes: int = P.DELAY_MINUTES_HIGH_RISK) -> DataFrame:
    m = (F.when(F.col("level") == "strong", F.lit(base_minutes))
         .when(F.col("level") == "critical", F.lit(2 * base_minutes)))
    return (df.withColumn("delay_minutes", m)
            .withColumn("delay_expires_at", F.col(ts) + F.make_dt_interval(mins=m))
            .withColumn("delay_message", F.when(m.isNotNull(), F.format_string(
                "Aguarde %d minutos antes de confirmar", m))))


def block(df: DataFrame, score: str = "risk_score") -> DataFrame:
    """Critical only: reasons night / score >= 80 / amount >= 500, else generic."""
    r = F.concat_ws(", ",
                    F.when(F.col("_night"), F.lit(BLOCK_REASONS[0])),
                    F.when(F.col(score) >= 80, F.lit(BLOCK_REASONS[1])),
                    F.when(F.col("amount") >= 500, F.lit(BLOCK_REASONS[2])))
    r = F.when(r == "", F.lit(BLOCK_REASONS[3])).otherwise(r)
    return df.withColumn("block_reason", F.when(F.col("level") == "critical",
                                                F.concat(F.lit(BLOCK_PREFIX), r)))


def message_and_actions(df: DataFrame, id_col: str = "id") -> DataFrame:
    mmap = _map_of_arrays(MAIN_MESSAGES)
    amap = _map_of_arrays(ACTIONS)
    base = F.element_at(_pick(F.col(id_col), F.element_at(mmap, F.col("level")), 1), 1)
    return (df.withColumn("main_message", F.when(F.col("_night"), F.concat(base, F.lit(NIGHT_SUFFIX)))
                          .otherwise(base))
            .withColumn("actions", F.element_at(amap, F.col("level"))))


def generate_intervention(scored: DataFrame, goals: DataFrame | None = None, keys: Sequence[str] = ("user_id",),
                          id_col: str = "id") -> DataFrame:
    """All components, in the original order: question, visualization (amount >=
    50), comparison (active goals), alternative, delay, block."""
    df = with_context(scored, id_col)
    df = message_and_actions(block(delay(alternatives(impact(questions(df, id_col)), id_col))), id_col)
    if goals is not None:
        active = goals.filter(F.col("status") == "active").groupBy(*keys).agg(F.count(F.lit(1)).alias("_n_active"))
        df = df.join(active, list(keys), "left")
        has_cmp = F.coalesce(F.col("_n_active"), F.lit(0)) > 0
    else:
        has_cmp = F.lit(False)
    comps = F.concat_ws(",", F.lit("question"),
                        F.when(F.col("amount") >= 50, F.lit("visualization")),
                        F.when(has_cmp, F.lit("comparison")),
                        F.when(F.size(F.coalesce(F.col("alternatives"), F.array())) > 0, F.lit("alternative")),
                        F.when(F.col("delay_minutes").isNotNull(), F.lit("delay")),
                        F.when(F.col("level") == "critical", F.lit("block")))
    return df.withColumn("components", comps)


# FIXED VALUES — goal texts
GOAL_IMPACT = "Este valor é %.1f%% da sua meta '%s'"
GOAL_COMPARISON = "Este gasto representa %.1f%% do que falta para '%s'"
GOAL_SUMMARY = "Você tem %d meta(s) ativa(s)"


def intervention_payload(scored: DataFrame, goals: DataFrame | None = None, keys: Sequence[str] = ("user_id",),
                         id_col: str = "id") -> DataFrame:
    """``generate_intervention`` with ``components`` as an ordered array of structs: type,
    content (texts), comparisons (goal_name, remaining, this_purchase_percent, message),
    minutes, expires_at.  Fields a component has no use for are null.  A user's active
    goals travel as one array (in goal_id order; a handful per user)."""
    df = generate_intervention(scored, goals, keys, id_col)
    none = F.array().cast("array<struct<goal_id:bigint,name:string,target:double,remaining:double>>")
    if goals is not None:
        g = goals.filter(F.col("status") == "active").groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(
            F.col("goal_id").cast("bigint").alias("goal_id"), "name", F.col("target_amount").cast("double").alias("target"),
            (F.col("target_amount") - F.col("current_amount")).cast("double").alias("remaining")))).alias("_goals"))
        df = df.join(g, list(keys), "left").withColumn("_goals", F.coalesce("_goals", none))
    else:
        df = df.withColumn("_goals", none)
    a = F.col("amount")
    open_goals = F.filter("_goals", lambda x: x["remaining"] > 0)
    comparisons = F.transform(open_goals, lambda x: F.struct(
        x["name"].alias("goal_name"), x["remaining"].alias("remaining"),
        rnd(a / x["remaining"] * 100, 1).alias("this_purchase_percent"),
        F.format_string(GOAL_COMPARISON, rnd(a / x["remaining"] * 100, 1), x["name"]).alias("message")))
    first = F.get("_goals", F.lit(0))
    goal_impact = F.when(first.isNotNull() & (first["target"] != 0), F.format_string(
        GOAL_IMPACT, rnd(a / F.nullif(first["target"], F.lit(0.0)) * 100, 1), first["name"]))
    texts = lambda *c: F.filter(F.array(*c), lambda x: x.isNotNull())
    no_cmp = F.lit(None).cast("array<struct<goal_name:string,remaining:double,this_purchase_percent:double,message:string>>")

    def part(kind, content, cmp=no_cmp, minutes=None, expires=None):
        return F.struct(F.lit(kind).alias("type"), content.alias("content"), cmp.alias("comparisons"),
                        (F.lit(None).cast("int") if minutes is None else minutes).alias("minutes"),
                        (F.lit(None).cast("timestamp_ntz") if expires is None else expires).alias("expires_at"))

    parts = F.array(
        part("question", F.col("questions")),
        F.when(a >= 50, part("visualization", texts(*[F.col(c) for c in ("daily_food", "subscriptions", "investment", "work_hours")],
                                                    goal_impact))),
        F.when(F.size("_goals") > 0, part("comparison", texts(F.format_string(GOAL_SUMMARY, F.size("_goals"))), comparisons)),
        F.when(F.size(F.coalesce("alternatives", F.array())) > 0, part("alternative", F.col("alternatives"))),
        F.when(F.col("delay_minutes").isNotNull(), part("delay", texts(F.col("delay_message")), no_cmp,
                                                        F.col("delay_minutes"), F.col("delay_expires_at"))),
        F.when(F.col("level") == "critical", part("block", texts(F.col("block_reason")))))
    return df.withColumn("components", F.filter(parts, lambda x: x.isNotNull())).drop("_goals")


def intervention_stats(iv: DataFrame, keys: Sequence[str] = ("user_id",), as_of: Column | None = None) -> DataFrame:
    """Total, count per level and delays still running at ``as_of`` (default:
    the key's latest transaction time)."""
    lv = F.col("level")
    at = as_of if as_of is not None else F.col("_last")
    per = iv.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"),
        *[F.sum(F.when(lv == name, 1).otherwise(0)).alias(f"n_{name}") for name in MAIN_MESSAGES],
        F.max("timestamp").alias("_last"))
    delays = iv.filter(F.col("delay_expires_at").isNotNull()).select(*keys, "delay_expires_at")
    j = delays.join(per.select(*keys, "_last"), list(keys))
    active = j.filter(F.col("delay_expires_at") > at).groupBy(*keys).agg(F.count(F.lit(1)).alias("active_delays"))
    return (per.join(active, list(keys), "left")
            .withColumn("active_delays", F.coalesce(F.col("active_delays"), F.lit(0)).cast("long")).drop("_last"))
