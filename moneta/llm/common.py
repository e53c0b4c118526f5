"""Helpers that several operators of this subpackage share."""
from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from moneta.session import checkpoint_dir

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SPACE = " \t\n\x0b\x0c\r"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts the lineage, survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder that this subpackage wrote with ``scratch``."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z and nothing else (``lower`` alone would change other letters too)."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(
        F.translate(c, UPPER, UPPER.lower()))


def bounded_sample(df: DataFrame, n: int, *by: str) -> DataFrame:
    """At most ``n`` rows to fit a model on, by the hash of the columns ``by``.  Most rows are
    dropped where they are read, so the driver merges about 4 n rows however many there are."""
    at = F.xxhash64(*by).bitwiseAND(F.lit(0x7FFFFFFFFFFFFFFF)) / F.lit(2.0 ** 63)
    total = df.count()
    if total > 4 * n:
        df = df.where(at < 4 * n / total)
    return df.orderBy(at, *by).limit(n)


def label_sample(df: DataFrame, n: int, label: str, key: str) -> tuple[DataFrame, dict]:
    """About ``n`` rows to fit a model on, by the hash of ``key``, and the number of all rows of
    each label.  Labels share n equally; what a label with few rows leaves goes to the others, and
    every label has a row at least, so n is exceeded only where there are more labels than that.
    Most rows are dropped where they are read: at most about 4 rows + 40 are kept to choose one."""
    at = F.xxhash64(key).bitwiseAND(F.lit(0x7FFFFFFFFFFFFFFF)) / F.lit(2.0 ** 63)
    found = df.groupBy(label).agg(F.count("*").alias("n"), F.min(at).alias("low")).orderBy("n", label).collect()
    shares, left = [], n
    for k, r in enumerate(found):
        share = max(1, min(r["n"], left // (len(found) - k)))
        left -= share
        shares.append((r[label], share, max(r["low"], (4.0 * share + 40) / r["n"])))
    quota = df.sparkSession.createDataFrame(shares, f"_label {df.schema[label].dataType.simpleString()}, _share long, _below double")
    near = df.join(F.broadcast(quota), df[label] == F.col("_label")).where(at <= F.col("_below"))
    rank = F.row_number().over(Window.partitionBy("_label").orderBy(at, *[c for c in df.columns if c != label]))
    rows = near.withColumn("_rank", rank).where("_rank <= _share").select(*df.columns)
    return rows, {r[label]: r["n"] for r in found}


def within_bytes(rows: DataFrame, most: int, label: str, key: str, text: str = "text") -> DataFrame:
    """Of a sample that is bounded in rows, those of each label, by the hash of ``key``, before which the
    texts have under ``most`` bytes: at most ``most`` and one text.  Only lengths are sorted and summed."""
    at = F.xxhash64(key)
    order = Window.partitionBy(label).orderBy(at, key).rowsBetween(Window.unboundedPreceding, -1)
    size = rows.groupBy(label, key).agg(F.sum(F.octet_length(text)).alias("_bytes")).withColumn(
        "_before", F.coalesce(F.sum("_bytes").over(order), F.lit(0))).where(F.col("_before") < most).select(
        F.col(label).alias("_label"), F.col(key).alias("_key"))
    return rows.join(F.broadcast(size), F.col(label).eqNullSafe(F.col("_label")) & (F.col(key) == F.col("_key"))).drop("_label", "_key")


def connected(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): the smallest node each node of ``edges`` can reach.

    Alternating large-star and small-star steps; every step is a grouped minimum
    and an equi-join, so a node with very many neighbours is combined before the
    shuffle and AQE can split its rows in the join.  Each round is written to
    the shared folder; the driver sees two numbers per round.
    """
    spark = edges.sparkSession
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    e = written(e, "edges")
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u > v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")),
                                                              F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
        nxt = written(small.select("x.u", "x.v").where("u > v").distinct(), "edges")
        s = nxt.groupBy("u").agg(F.count("*").alias("n")).agg(F.max("n").alias("most")).first()["most"]
        centre = nxt.select(F.col("v").alias("u")).distinct().join(nxt.select("u").distinct(), "u", "left_semi").limit(1).count()
        e = nxt
        if (s or 0) <= 1 and not centre:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
