"""Anomaly scoring: feature preparation, label encoding, standardisation, the
heuristic score, reasons, min-max normalisation and summaries.

Batch-relative statistics (90% quantile, mean, std, min/max) are per key: an
aggregate joined back on the key (AQE plans the join from runtime sizes and
splits a skewed key), or for ``keys=()`` a one-row aggregate broadcast on a
constant key.  No unpartitioned window is used.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moneta import params as P
from moneta.functions.common import attach, exact_quantiles, rnd
from moneta.session import checkpoint_dir

K = ("user_id",)
FEATURES = ["amount", "hour", "day_of_week", "day_of_month", "category_encoded",
            "is_high_amount", "is_night", "is_weekend"]


def label_encoder(train: DataFrame, col: str = "category") -> DataFrame:
    """Dictionary (value, code): sorted distinct values -> 0..n-1, nulls as 'outros'.

    A distributed dense rank: the distinct values are dealt to partitions by range and
    sorted there, which is pinned in the checkpoint folder; a value's code is its
    place in its partition plus the number of values in the partitions before.  Only one
    count per partition meets anywhere."""
    checkpoint_dir(train.sparkSession)
    vals = train.select(F.coalesce(F.col(col), F.lit("outros")).cast("string").alias("value")).distinct()
    placed = vals.repartitionByRange("value").sortWithinPartitions("value").select("value", F.monotonically_increasing_id().alias("_id"))
    placed = placed.checkpoint().select(  # the id holds the partition's number and the place in it
        "value", F.shiftright("_id", 33).alias("_part"), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)).alias("_place"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    parts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select(
        "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return placed.join(F.broadcast(parts), "_part").select("value", (F.col("_before") + F.col("_place")).cast("int").alias("code"))


def label_encode(df: DataFrame, encoder: DataFrame, col: str = "category", out: str = "category_encoded") -> DataFrame:
    """Codes from a fitted dictionary; values never seen get -1."""
    v = F.coalesce(F.col(col), F.lit("outros")).cast("string")
    return (df.withColumn("_v", v).join(encoder.withColumnRenamed("value", "_v"), "_v", "left")
            .withColumn(out, F.coalesce(F.col("code"), F.lit(-1))).drop("_v", "code"))


def anomaly_features(tx: DataFrame, encoder: DataFrame | None = None, keys: Sequence[str] = K,
                     high_quantile: float = 0.9, approx: bool = False) -> DataFrame:
    """The eight model features.  Without a time of day the hour is 12; without
    any date: hour 12, weekday 0, day 15.  ``is_high_amount`` compares with the
    key's own 90% quantile (linear interpolation, by counts per range of values: no
    task holds all amounts of a key; ``approx=True`` uses the mergeable sketch)."""
    cols = set(tx.columns)
    if "timestamp" in cols:
        t = F.col("timestamp")
        hour, dow, dom = F.hour(t), F.weekday(t), F.dayofmonth(t)
    elif "date" in cols:
        d = F.col("date")
        hour, dow, dom = F.lit(12), F.weekday(d), F.dayofmonth(d)
    else:
        hour, dow, dom = F.lit(12), F.lit(0), F.lit(15)
    f = (tx.withColumn("f_amount", F.coalesce(F.col("amount"), F.lit(0.0)))
         .withColumn("hour", hour.cast("int")).withColumn("day_of_week", dow.cast("int"))
         .withColumn("day_of_month", dom.cast("int")))
    if "category" in cols:
        enc = encoder if encoder is not None else label_encoder(tx)
        f = label_encode(f, enc)
    else:
        f = f.withColumn("category_encoded", F.lit(0))
    if approx:
        qs = f.groupBy(*keys).agg(F.percentile_approx("f_amount", high_quantile, 100000).cast("double").alias("_q90"))
    else:
        qs = exact_quantiles(f, "f_amount", (high_quantile,), keys).withColumnRenamed("q0", "_q90")
    f = attach(f, qs, keys)
    return (f.withColumn("is_high_amount", (F.col("f_amount") > F.col("_q90")).cast("int"))
            .withColumn("is_night", ((F.col("hour") >= 0) & (F.col("hour") <= 6)).cast("int"))
            .withColumn("is_weekend", (F.col("day_of_week") >= 5).cast("int"))
            .drop("_q90"))


def all_feature_stats(feats: DataFrame, keys: Sequence[str] = K) -> DataFrame:
    """Per key the rows (``n``) and, from one pass, mean_*, std_* (population, for the scaler)
    and samp_* (sample std, for the fitted reference) of every feature."""
    aggs = [F.count(F.lit(1)).alias("n")]
    for c in FEATURES:
        x = F.col("f_amount" if c == "amount" else c).cast("double")
        aggs += [F.avg(x).alias(f"mean_{c}"), F.stddev_pop(x).alias(f"std_{c}"), F.stddev_samp(x).alias(f"samp_{c}")]
    return feats.groupBy(*keys).agg(*aggs)


def _one_std(stats: DataFrame, keys: Sequence[str], sample: bool) -> DataFrame:
    std = "samp" if sample else "std"
    return stats.select(*keys, *[x for c in FEATURES for x in (F.col(f"mean_{c}"), F.col(f"{std}_{c}").alias(f"std_{c}"))])


def feature_stats(feats: DataFrame, keys: Sequence[str] = K, sample: bool = False) -> DataFrame:
    """Per key mean and std of every feature (population std for the scaler,
    sample std for the fitted reference statistics)."""
    return _one_std(all_feature_stats(feats, keys), keys, sample)


def standardize(feats: DataFrame, keys: Sequence[str] = K, stats: DataFrame | None = None) -> DataFrame:
    """(x - mean) / population std per feature; a constant feature divides by 1."""
    st = stats if stats is not None else feature_stats(feats, keys)
    j = attach(feats, st, keys)
    out = j
    for c in FEATURES:
        src = "f_amount" if c == "amount" else c
        s = F.col(f"std_{c}")
        scale = F.when(s.isNull() | (s == 0), F.lit(1.0)).otherwise(s)
        out = out.withColumn(f"z_{c}", (F.col(src).cast("double") - F.col(f"mean_{c}")) / scale)
    return out.drop(*[f"{p}_{c}" for c in FEATURES for p in ("mean", "std")])


def anomaly_heuristic(tx: DataFrame, keys: Sequence[str] = K) -> DataFrame:
    """Fallback score: |z| > 2 on amount (population std; one row: std = mean/2)
    adds min(20 z, 50); night hour (0-6) adds 25; risky category adds 30.
    Flag = score >= 50 before the cap at 100."""
    amt = F.coalesce(F.col("amount"), F.lit(0.0))
    st = tx.groupBy(*keys).agg(F.avg(amt).alias("_mean"), F.stddev_pop(amt).alias("_sdp"),
                               F.count(F.lit(1)).alias("_n"))
    st = st.withColumn("_sd", F.when(F.col("_n") > 1, F.col("_sdp")).otherwise(F.col("_mean") * 0.5))
    j = attach(tx, st.select(*keys, "_mean", "_sd"), keys)
    z = F.when(F.col("_sd") > 0, F.abs(amt - F.col("_mean")) / F.col("_sd"))
    has_ts = "timestamp" in tx.columns
    hour = F.hour("timestamp") if has_ts else F.lit(None).cast("int")
    cat = F.lower(F.coalesce(F.col("category"), F.lit(""))) if "category" in tx.columns else F.lit("")
    j = (j.withColumn("_z", z).withColumn("_h", hour)
         .withColumn("_zs", F.when(F.col("_z") > 2, F.least(F.col("_z") * 20, F.lit(50.0))))
         .withColumn("_hs", F.when((F.col("_h") >= 0) & (F.col("_h") <= 6), F.lit(25.0)))
         .withColumn("_cs", F.when(cat.isin(P.HEURISTIC_RISK_CATEGORIES), F.lit(30.0))))
    score = (F.lit(0.0) + F.coalesce(F.col("_zs"), F.lit(0.0)) + F.coalesce(F.col("_hs"), F.lit(0.0))
             + F.coalesce(F.col("_cs"), F.lit(0.0)))
    reasons = F.filter(F.array(
        F.when(F.col("_zs").isNotNull(),
               F.format_string("Valor atípico: %.1f desvios da média", rnd("_z", 1))),
        F.when(F.col("_hs").isNotNull(), F.format_string("Horário noturno: %dh", F.col("_h"))),
        F.when(F.col("_cs").isNotNull(), F.concat(F.lit("Categoria de risco: "), cat)),
    ), lambda x: x.isNotNull())
    return (j.withColumn("_score", score)
            .withColumn("is_anomaly", F.col("_score") >= 50)
            .withColumn("anomaly_score", F.least(F.col("_score"), F.lit(100.0)))
            .withColumn("anomaly_reasons", reasons)
            .drop("_mean", "_sd", "_z", "_h", "_zs", "_hs", "_cs", "_score"))


def normalize_scores(df: DataFrame, score: str, keys: Sequence[str] = K, out: str = "score_normalized") -> DataFrame:
    """100 * (1 - (s - min) / (max - min)) per key (low raw score = most
    anomalous = 100); 50 when all scores of the key are equal."""
    mm = df.groupBy(*keys).agg(F.min(score).alias("_lo"), F.max(score).alias("_hi"))
    j = attach(df, mm, keys)
    s, lo, hi = F.col(score), F.col("_lo"), F.col("_hi")
    return (j.withColumn(out, F.when(hi == lo, F.lit(50.0))
                         .otherwise(F.lit(100.0) * (F.lit(1.0) - (s - lo) / (hi - lo))))
            .drop("_lo", "_hi"))


def anomaly_reasons(flagged: DataFrame, ref_stats: DataFrame, keys: Sequence[str] = K,
                    score: str = "anomaly_score") -> DataFrame:
    """Reasons for flagged rows, in order: amount above training mean + 2 sample
    std; hour 0-6 (printed as a float, '2.0h'); weekend; category jogos / apostas /
    cassino (case-sensitive); otherwise the generic pattern line with the score."""
    j = attach(flagged, ref_stats.select(*keys, "mean_amount", "std_amount"), keys)
    amt = F.coalesce(F.col("amount"), F.lit(0.0))
    r = F.array(
        F.when((F.col("std_amount") > 0) & (amt > F.col("mean_amount") + 2 * F.col("std_amount")),
               F.format_string("Valor muito acima da média (R$ %.2f vs média R$ %.2f)",
                               rnd(amt, 2), rnd("mean_amount", 2))),
        F.when((F.col("hour") >= 0) & (F.col("hour") <= 6),
               F.format_string("Transação em horário incomum (%.1fh)", F.col("hour").cast("double"))),
        F.when(F.col("is_weekend") == 1, F.lit("Transação no fim de semana")),
        F.when(F.col("category").isin(P.REASON_RISK_CATEGORIES),
               F.concat(F.lit("Categoria de alto risco: "), F.col("category"))),
    )
    found = F.filter(r, lambda x: x.isNotNull())
    generic = F.array(F.format_string("Padrão incomum detectado (score: %d)",
                                      rnd(score, 0).cast("long")))
    return (j.withColumn("anomaly_reasons", F.when(F.col("is_anomaly"), F.when(F.size(found) > 0, found)
                                                                        .otherwise(generic))
                         .otherwise(F.array().cast("array<string>")))
            .drop("mean_amount", "std_amount"))


def anomaly_summary(res: DataFrame, keys: Sequence[str] = K) -> DataFrame:
    """Flagged count, percent of all rows, flagged value, mean flagged score."""
    a = F.col("is_anomaly")
    g = res.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        F.sum(F.when(a, 1).otherwise(0)).alias("total_anomalies"),
        F.sum(F.when(a, F.coalesce(F.col("amount"), F.lit(0.0))).otherwise(0.0)).alias("_v"),
        F.avg(F.when(a, F.col("anomaly_score"))).alias("_s"),
    )
    return g.select(*keys, "total_anomalies",
                    rnd(F.col("total_anomalies") / F.col("_n") * 100, 6).alias("percentage"),
                    rnd("_v", 2).alias("total_value"), rnd("_s", 6).alias("average_score"))


def anomaly_by_category(res: DataFrame, keys: Sequence[str] = K) -> DataFrame:
    return (res.filter("is_anomaly").groupBy(*keys, "category")
            .agg(F.count(F.lit(1)).alias("count"), rnd(F.sum("amount"), 2).alias("total")))


def anomaly_by_hour(res: DataFrame, keys: Sequence[str] = K) -> DataFrame:
    return (res.filter(F.col("is_anomaly") & F.col("timestamp").isNotNull())
            .groupBy(*keys, F.format_string("%02dh", F.hour("timestamp")).alias("hour"))
            .agg(F.count(F.lit(1)).alias("count")))


def top_anomalies(res: DataFrame, keys: Sequence[str] = K, n: int = 5, score: str = "anomaly_score") -> DataFrame:
    """Highest scores per key (ties: id).  ``row_number() <= n`` is planned as a
    window-group limit, so only n rows per key and map task reach the shuffle."""
    w = Window.partitionBy(*keys).orderBy(F.col(score).desc(), F.col("id"))
    return (res.filter("is_anomaly").withColumn("rank", F.row_number().over(w))
            .filter(F.col("rank") <= n))
