"""Readers for the driver's parquet tables and their mapping onto the
finance data model (transactions, goals, user settings).

Only the columns an operator needs are selected, so the parquet scan prunes
columns; filters written downstream are pushed into the scan by Catalyst.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# FIXED VALUES — mapping of event types onto spending categories (our fixture rule)
EVENT_CATEGORY = {
    "click": "delivery",
    "view": "lazer",
    "purchase": "compras",
    "signup": "salário",
}
# FIXED VALUES — mapping of order priorities onto categories (our fixture rule)
PRIORITY_CATEGORY = {
    "1-URGENT": "jogos",
    "2-HIGH": "delivery",
    "3-MEDIUM": "alimentação",
    "4-NOT SPECIFIED": "outros",
    "5-LOW": "transporte",
}


def _case(col: Column, mapping: dict[str, str]) -> Column:
    expr = None
    for k, v in mapping.items():
        expr = (F.when(col == k, F.lit(v)) if expr is None else expr.when(col == k, F.lit(v)))
    return expr


def transactions_from_events(events: DataFrame) -> DataFrame:
    """Canonical transactions (with time of day) from the ``events`` table."""
    k = F.get_json_object("props", "$.k")
    category = (
        F.when((F.col("event_type") == "view") & (F.col("event_id") % 5 == 0), F.lit("jogos"))
        .otherwise(_case(F.col("event_type"), EVENT_CATEGORY))
    )
    merchant = F.concat(F.lit("Loja "), k)
    return events.select(
        F.col("event_id").alias("id"),
        F.col("user_id"),
        F.to_date("ts").alias("date"),
        F.col("ts").alias("timestamp"),
        F.col("value").alias("amount"),
        merchant.alias("merchant"),
        F.concat_ws(" ", F.col("event_type"), merchant).alias("description"),
        category.alias("category"),
        F.when(F.col("event_type") == "signup", F.lit("credito")).otherwise(F.lit("debito"))
        .alias("transaction_type"),
    )


def load_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transactions_from_events(
        table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value", "props"))


def transactions_from_orders(orders: DataFrame) -> DataFrame:
    """Date-only transactions (no time of day) from ``orders``."""
    return orders.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("user_id"),
        F.to_date("o_orderdate").alias("date"),
        F.col("o_totalprice").alias("amount"),
        _case(F.col("o_orderpriority"), PRIORITY_CATEGORY).alias("category"),
        F.lit("debito").alias("transaction_type"),
    )


def load_order_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transactions_from_orders(
        table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate",
                                              "o_totalprice", "o_orderpriority"))


def goals_from_customer(customer: DataFrame) -> DataFrame:
    """One savings goal per customer: target 10000, current = max(balance, 0)."""
    return customer.select(
        F.col("c_custkey").alias("goal_id"),
        F.col("c_custkey").alias("user_id"),
        F.col("c_name").alias("name"),
        F.lit(10000.0).alias("target_amount"),
        F.greatest(F.col("c_acctbal"), F.lit(0.0)).alias("current_amount"),
        F.when(F.col("c_acctbal") < 9000, F.lit("active")).otherwise(F.lit("completed")).alias("status"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("c_custkey") % 365).cast("int")).alias("deadline"),
    )


def load_goals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return goals_from_customer(
        table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal"))


def settings_from_customer(customer: DataFrame) -> DataFrame:
    """Per-user guard settings: protection on unless nation % 5 = 0; a bypass
    until 2024-01-15 for nation % 7 = 0."""
    return customer.select(
        F.col("c_custkey").alias("user_id"),
        (F.col("c_nationkey") % 5 != 0).alias("protection_enabled"),
        F.when(F.col("c_nationkey") % 7 == 0,
               F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")).alias("bypass_until"),
    )


def load_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settings_from_customer(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"))


def supplier_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as purchases: user = ordering customer, merchant = supplier."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice")
    od = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    sp = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    return (
        li.join(od, li.l_orderkey == od.o_orderkey)
        .join(sp, li.l_suppkey == sp.s_suppkey)
        .select(
            (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"),
            F.col("o_custkey").alias("user_id"),
            F.to_date("o_orderdate").alias("date"),
            F.col("s_name").alias("merchant"),
            F.col("l_extendedprice").alias("amount"),
        )
    )


# ---------------------------------------------------------------- change logs
# Fixture rules (ours): the driver's tables carry no logs, so logs are derived
# deterministically from event rows.

def goal_update_log(events: DataFrame) -> DataFrame:
    """Goal progress updates: every signup event sets its user's goal to value * 50."""
    return events.filter(F.col("event_type") == "signup").select(
        F.col("user_id").alias("goal_id"), (F.col("value") * 50).alias("amount"), F.col("ts"))


def profile_update_log(events: DataFrame) -> DataFrame:
    """Profile field updates: purchases set daily_limit, signups monthly_limit,
    even error events toggle night protection."""
    et = F.col("event_type")
    return events.select(
        "user_id", "ts",
        F.when(et == "purchase", F.col("value") * 10).alias("daily_limit"),
        F.when(et == "signup", F.col("value") * 100).alias("monthly_limit"),
        F.when((et == "error") & (F.col("event_id") % 2 == 0), F.col("event_id") % 4 == 0)
        .alias("night_protection_enabled"))


def guard_log(events: DataFrame) -> DataFrame:
    """Guard actions from error events: enable, disable or bypass by id mod 3; every
    other bypass names its minutes (id mod 120)."""
    e = F.col("event_id")
    return events.filter(F.col("event_type") == "error").select(
        "user_id", "ts", F.element_at(F.array(F.lit("enable"), F.lit("disable"), F.lit("bypass")),
                                      (e % 3 + 1).cast("int")).alias("action"),
        F.when(e % 2 == 0, (e % 120).cast("int")).alias("minutes"))


def mark_all_read_log(events: DataFrame) -> DataFrame:
    """'Mark all read' actions: error events whose id is a multiple of 7."""
    return events.filter((F.col("event_type") == "error") & (F.col("event_id") % 7 == 0)).select(
        "user_id", F.col("ts").alias("at"))
