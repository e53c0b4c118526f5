"""Behaviour indicators and the profile chosen from them (one groupBy per key)."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moneta import params as P
from moneta.functions.common import rnd

K = ("user_id",)


def behavior_indicators(tx: DataFrame, keys: Sequence[str] = K) -> DataFrame:
    """night ratio (hour rule), transactions per distinct day, social ratio and
    coefficient of variation (sample std / mean, only with more than 7 rows).
    Indicators whose input column is missing come out null."""
    cols = set(tx.columns)
    aggs = [F.count(F.lit(1)).alias("n")]
    if "timestamp" in cols:
        h = F.hour("timestamp")
        aggs.append(F.avg(F.when((h >= 0) & (h <= 6), 1.0).otherwise(0.0)).alias("night_ratio"))
    else:
        aggs.append(F.lit(None).cast("double").alias("night_ratio"))
    if "date" in cols:
        aggs.append((F.count(F.lit(1)) / F.greatest(F.count_distinct("date"), F.lit(1))).alias("tx_per_day"))
    else:
        aggs.append(F.lit(None).cast("double").alias("tx_per_day"))
    if "category" in cols:
        social = F.coalesce(F.lower("category").isin(P.SOCIAL_CATEGORIES), F.lit(False))
        aggs.append(F.avg(F.when(social, 1.0).otherwise(0.0)).alias("social_ratio"))
    else:
        aggs.append(F.lit(None).cast("double").alias("social_ratio"))
    aggs += [F.stddev_samp("amount").alias("_sd"), F.avg("amount").alias("_mean")]
    g = tx.groupBy(*keys).agg(*aggs)
    return (g.withColumn("cv", F.when(F.col("n") > 7, F.try_divide(F.col("_sd"), F.col("_mean"))))
            .drop("_sd", "_mean"))


def behavior_profile(ind: DataFrame, keys: Sequence[str] = K) -> DataFrame:
    """Scores per profile; winner = highest score, ties to the fixed profile order;
    secondary = ranks 2-3 scoring above 20; no score -> controlado / 50."""
    nr, tpd, sr, cv = F.col("night_ratio"), F.col("tx_per_day"), F.col("social_ratio"), F.col("cv")
    scores = {
        "notívago": F.when(nr > 0.15, nr * 100),
        "impulsivo": F.when(tpd > 3, F.least(tpd * 10, F.lit(50.0))),
        "social": F.when(sr > 0.3, sr * 100),
        "sazonal": F.when(cv > 1.5, cv * 20),
        "controlado": F.when(cv < 0.5, (1 - cv) * 100),
    }
    items = F.array(*[
        F.when(s.isNotNull(), F.struct(s.alias("score"), F.lit(-i).alias("neg_ord"), F.lit(name).alias("name")))
        for i, (name, s) in enumerate(scores.items())
    ])
    ranked = F.sort_array(F.filter(items, lambda x: x.isNotNull()), asc=False)
    out = ind.withColumn("_r", ranked)
    top = F.element_at(F.col("_r"), 1)
    second = F.filter(F.slice(F.col("_r"), 2, 2), lambda x: x["score"] > 20)
    empty = F.size("_r") == 0
    return out.select(
        *keys,
        F.when(empty, F.lit("controlado")).otherwise(top["name"]).alias("profile"),
        F.when(empty, F.lit(50.0)).otherwise(rnd(F.least(top["score"], F.lit(100.0)), 1)).alias("confidence"),
        F.array_join(F.transform(second, lambda x: x["name"]), ",").alias("secondary_profiles"),
        *[rnd(s, 6).alias(f"score_{i}") for i, s in enumerate(scores.values())],
    )


# FIXED VALUES — profile definitions (description, risk level, suggestions)
PROFILE_DEFINITIONS = {
    "notívago": ("Tendência a gastar mais durante a madrugada", "alto",
                 ["Evite ter apps de compras no celular", "Configure bloqueio de cartão à noite",
                  "Deixe dinheiro separado para emergências"]),
    "impulsivo": ("Compras frequentes não planejadas", "alto",
                  ["Use a regra das 48h antes de comprar", "Faça lista antes de ir às compras",
                   "Defina um limite diário de gastos"]),
    "social": ("Gastos concentrados em lazer e alimentação fora", "médio",
               ["Cozinhe mais em casa", "Limite saídas a X vezes por semana",
                "Busque programas gratuitos de lazer"]),
    "controlado": ("Padrão de gastos estável e previsível", "baixo",
                   ["Continue assim!", "Considere aumentar investimentos", "Explore otimizações em gastos fixos"]),
    "sazonal": ("Gastos variam muito ao longo do mês", "médio",
                ["Distribua gastos ao longo do mês", "Antecipe compras de alto valor",
                 "Crie reserva para picos sazonais"]),
}


def profile_dimension(spark) -> DataFrame:
    """The profile definitions as a small fixed dimension (5 rows)."""
    rows = [(k, d, r, s) for k, (d, r, s) in PROFILE_DEFINITIONS.items()]
    return spark.createDataFrame(rows, "profile string, description string, risk_level string, suggestions array<string>")


def profile_details(profiles: DataFrame) -> DataFrame:
    """Dimension lookup: broadcast left join (5 fixed rows) with an empty default."""
    dim = F.broadcast(profile_dimension(profiles.sparkSession))
    return (profiles.join(dim, "profile", "left")
            .withColumn("description", F.coalesce("description", F.lit("")))
            .withColumn("risk_level", F.coalesce("risk_level", F.lit(""))))
