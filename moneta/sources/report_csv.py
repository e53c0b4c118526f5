"""The legacy wide report file: a ragged CSV (rows of 6, 31, 33 and 7 fields)
read as text and split into its three tables: 10-day report rows, daily
series and the opening balance."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from moneta.functions.common import attach

DECADES = ["1_10", "11_20", "21_31"]


@dataclass
class Report:
    rows: DataFrame     # categoria, tipo, v_1_10, v_11_20, v_21_31, total
    daily: DataFrame    # grupo, serie, day (1..n), value
    opening: DataFrame  # grupo, saldo_inicial


def read_report(spark: SparkSession, path: str) -> Report:
    lines = spark.read.text(path).select(F.split("value", ",").alias("f"))
    body = lines.filter(F.col("f")[0] != "categoria")
    tipo = F.col("f")[1]
    daily_rows = body.filter(tipo.endswith("_DIA"))
    opening_rows = body.filter(tipo == "SALDO_INICIAL")
    table = body.filter(~tipo.endswith("_DIA") & (tipo != "SALDO_INICIAL"))
    num = lambda i: F.col("f")[i].try_cast("double")
    rows = table.select(F.col("f")[0].alias("categoria"), tipo.alias("tipo"),
                        num(2).alias("v_1_10"), num(3).alias("v_11_20"), num(4).alias("v_21_31"),
                        num(5).alias("total"))
    daily = daily_rows.select(F.col("f")[0].alias("grupo"), tipo.alias("serie"),
                              F.posexplode(F.slice("f", 3, F.size("f"))).alias("pos", "v")).select(
        "grupo", "serie", (F.col("pos") + 1).alias("day"), F.col("v").try_cast("double").alias("value"))
    opening = opening_rows.select(F.col("f")[0].alias("grupo"), num(2).alias("saldo_inicial"))
    return Report(rows, daily, opening)


def report_long(rows: DataFrame) -> DataFrame:
    """The wide 10-day columns as rows (unpivot)."""
    return rows.unpivot(["categoria", "tipo"], ["v_1_10", "v_11_20", "v_21_31"], "decade", "value") \
        .withColumn("decade", F.regexp_replace("decade", "^v_", ""))


def daily_balance(report: Report, in_series: str = "ENTRADAS_DIA", out_series: str = "SAIDAS_DIA") -> DataFrame:
    """Opening balance plus cumulative (ins - outs) per day of the daily series."""
    d = report.daily
    flows = (d.groupBy("day").agg(
        F.sum(F.when(F.col("serie") == in_series, F.col("value")).otherwise(0.0)).alias("ins"),
        F.sum(F.when(F.col("serie") == out_series, F.col("value")).otherwise(0.0)).alias("outs")))
    opening = report.opening.agg(F.first("saldo_inicial").alias("_open"))
    w = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)  # the report's days: at most 31 rows
    j = attach(flows, opening, [])
    return j.select("day", "ins", "outs",
                    F.bround((F.col("_open") + F.sum(F.col("ins") - F.col("outs")).over(w)).cast("decimal(38,6)"), 2)
                    .cast("double").alias("balance"))
