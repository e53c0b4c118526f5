"""Transaction store: append with defaults, scan with pushed-down filters."""
from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moneta import params as P

STORE_COLUMNS = ["id", "user_id", "date", "timestamp", "amount", "merchant", "description", "category",
                 "transaction_type", "is_night", "risk_score", "source", "installment", "notes"]


def with_defaults(tx: DataFrame, source: str = "import", today: _dt.date | None = None) -> DataFrame:
    """date = today, type = debito, is_night = false, risk = 0, source = import
    (batch) / manual (single); a missing amount stops the job."""
    cols = set(tx.columns)

    def get(c, default):
        return F.coalesce(F.col(c), default) if c in cols else default

    today = today or _dt.date.today()
    amount = F.when(F.col("amount").isNull(), F.raise_error(F.lit("amount is required"))).otherwise(F.col("amount"))
    return tx.select(
        get("id", F.lit(None).cast("long")).alias("id"), get("user_id", F.lit(None).cast("long")).alias("user_id"),
        get("date", F.lit(today)).alias("date"), get("timestamp", F.lit(None).cast("timestamp_ntz")).alias("timestamp"),
        amount.cast("double").alias("amount"),
        get("merchant", F.lit(None).cast("string")).alias("merchant"),
        get("description", F.lit(None).cast("string")).alias("description"),
        get("category", F.lit(None).cast("string")).alias("category"),
        get("transaction_type", F.lit("debito")).alias("transaction_type"),
        get("is_night", F.lit(False)).alias("is_night"), get("risk_score", F.lit(0)).cast("int").alias("risk_score"),
        get("source", F.lit(source)).alias("source"),
        get("installment", F.lit(None).cast("string")).alias("installment"),
        get("notes", F.lit(None).cast("string")).alias("notes"),
    ).withColumn("year_month", F.date_format("date", "yyyy-MM"))


def append_transactions(tx: DataFrame, path: str, source: str = "import") -> DataFrame:
    """Append to the Parquet store, partitioned by year_month (for pruning)."""
    rows = with_defaults(tx, source)
    rows.write.mode("append").partitionBy("year_month").parquet(path)
    return rows


def scan_transactions(spark: SparkSession, path: str, start=None, end=None, category=None,
                      transaction_type=None, limit: int = P.DEFAULT_READ_LIMIT) -> DataFrame:
    """Optional inclusive date range and equality filters (a falsy argument
    means no filter); newest first (ties: id); ``limit`` rows.  The date range
    also prunes year_month partitions."""
    df = spark.read.parquet(path)
    if start:
        df = df.filter((F.col("date") >= F.lit(start).cast("date"))
                       & (F.col("year_month") >= F.lit(str(start)[:7])))
    if end:
        df = df.filter((F.col("date") <= F.lit(end).cast("date"))
                       & (F.col("year_month") <= F.lit(str(end)[:7])))
    if category:
        df = df.filter(F.col("category") == category)
    if transaction_type:
        df = df.filter(F.col("transaction_type") == transaction_type)
    return df.orderBy(F.col("date").desc(), F.col("id").desc()).limit(limit)
