"""Goals: progress, listing, comparison of purchases with goals, months to goal."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moneta.functions.common import rnd

K = ("user_id",)


def goal_progress(goals: DataFrame) -> DataFrame:
    t, c = F.col("target_amount"), F.col("current_amount")
    return goals.withColumn("progress", F.when(t > 0, rnd(c / t * 100, 2)).otherwise(F.lit(0.0)))


def goals_by_status(goals: DataFrame, status: str = "active") -> DataFrame:
    """Goals with a status, deadline ascending with missing deadlines last."""
    return goals.filter(F.col("status") == status).orderBy(F.col("deadline").asc_nulls_last(), "goal_id")


def goal_compare(tx: DataFrame, goals: DataFrame, keys: Sequence[str] = K) -> DataFrame:
    """Each transaction against each active goal of its key that still has money
    missing: share of the remaining amount, 1 decimal.  Equi-join on the key
    (goals per key are few); keys with no active goal give no rows."""
    active = goals.filter(F.col("status") == "active")
    n_active = active.groupBy(*keys).agg(F.count(F.lit(1)).alias("active_goals"))
    open_ = (active.withColumn("remaining", F.col("target_amount") - F.col("current_amount"))
             .filter(F.col("remaining") > 0).select(*keys, "goal_id", F.col("name").alias("goal_name"), "remaining"))
    j = tx.select("id", *keys, "amount").join(open_, list(keys)).join(n_active, list(keys))
    return j.select("id", *keys, "goal_id", "goal_name", rnd("remaining", 2).alias("remaining"),
                    rnd(F.col("amount") / F.col("remaining") * 100, 1).alias("this_purchase_percent"),
                    "active_goals")


def goal_impact(tx: DataFrame, goals: DataFrame, keys: Sequence[str] = K) -> DataFrame:
    """Share of the first active goal's target (lowest goal id) per transaction."""
    first = (goals.filter(F.col("status") == "active").groupBy(*keys)
             .agg(F.min_by(F.struct("name", "target_amount"), F.col("goal_id")).alias("_g")))
    return (tx.select("id", *keys, "amount").join(first, list(keys))
            .select("id", *keys, F.col("_g.name").alias("goal_name"),
                    rnd(F.try_divide(F.col("amount"), F.col("_g.target_amount")) * 100, 1).alias("goal_percent")))


def months_to_goal(goals: DataFrame, totals: DataFrame, keys: Sequence[str] = K) -> DataFrame:
    """Remaining / total potential savings per key; null (never) when there is
    no potential."""
    g = goals.withColumn("remaining", F.col("target_amount") - F.col("current_amount"))
    j = g.join(totals.select(*keys, "total_potential_savings"), list(keys), "left")
    pot = F.col("total_potential_savings")
    return j.select("goal_id", *keys, rnd("remaining", 2).alias("remaining"), pot.alias("monthly_savings"),
                    F.when(pot > 0, rnd(F.col("remaining") / pot, 1)).alias("months_to_goal"))
