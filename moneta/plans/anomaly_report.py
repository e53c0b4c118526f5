"""Anomaly report: features -> scaler -> isolation forest (or the heuristic when
fewer than 10 rows) -> min-max normalised score -> reasons -> summary."""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moneta import params as P
from moneta.operators import anomaly as an
from moneta.operators import iforest
from moneta.session import checkpoint_dir

ZCOLS = [f"z_{c}" for c in an.FEATURES]


@dataclass
class FeatureModel:
    """How a fit turns rows into features: category codes, scaler statistics and the training
    means named in reasons.  All are small tables."""
    encoder: DataFrame    # value, code
    scaler: DataFrame     # one row: mean_*, std_* (population)
    reference: DataFrame  # one row: mean_*, std_* (sample)

    def persist(self, path: str, mode: str = "overwrite") -> None:
        """The model as Parquet tables (no pickled objects)."""
        for name in ("encoder", "scaler", "reference"):
            getattr(self, name).write.mode(mode).parquet(f"{path}/{name}")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "FeatureModel":
        return FeatureModel(*[spark.read.parquet(f"{path}/{n}") for n in ("encoder", "scaler", "reference")])


@dataclass
class AnomalyModel(FeatureModel):
    """What one fit leaves behind: the features' model, and the forest with its offset."""
    forest: iforest.ForestModel

    def persist(self, path: str, mode: str = "overwrite") -> None:
        super().persist(path, mode)
        nodes = self.encoder.sparkSession.createDataFrame(self.forest.nodes).withColumn("offset", F.lit(self.forest.offset))
        nodes.write.mode(mode).parquet(f"{path}/nodes")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "AnomalyModel":
        of = FeatureModel.load(spark, path)
        nodes = spark.read.parquet(f"{path}/nodes").toPandas()  # bounded: trees * (2 psi - 1) rows
        forest = iforest.ForestModel(iforest.FlatForest.from_nodes(nodes), float(nodes["offset"].iloc[0]), ZCOLS, nodes)
        return AnomalyModel(of.encoder, of.scaler, of.reference, forest)


def fit_features(tx: DataFrame) -> tuple[FeatureModel, DataFrame, int]:
    """The features' model of a frame, the frame's features (written once: statistics, trees
    and scores all start from them) and its number of rows.  Both statistics come from one pass."""
    checkpoint_dir(tx.sparkSession)
    encoder = an.label_encoder(tx)
    feats = an.anomaly_features(tx, encoder, keys=()).checkpoint()
    stats = an.all_feature_stats(feats, keys=()).checkpoint()  # one row
    return FeatureModel(encoder, an._one_std(stats, (), False), an._one_std(stats, (), True)), feats, stats.first()["n"]


def fit_anomaly_model(tx: DataFrame) -> tuple[AnomalyModel, DataFrame] | None:
    """One model over the frame, and its rows scored; None below 10 rows."""
    of, feats, n = fit_features(tx)
    fitted = iforest.fit_global(an.standardize(feats, (), of.scaler), ZCOLS, n=n)
    if fitted is None:
        return None
    return AnomalyModel(of.encoder, of.scaler, of.reference, fitted[0]), fitted[1]


def model_features(tx: DataFrame, model: FeatureModel) -> DataFrame:
    """Features and their scaled forms (z_*) of a batch under a fitted model: its category
    codes (-1 for one it never saw) and its scaler; ``is_high_amount`` is judged within the
    batch, as at fit time."""
    return an.standardize(an.anomaly_features(tx, model.encoder, keys=()), (), model.scaler)


def detect_anomalies(tx: DataFrame, keys: Sequence[str] = (), model: AnomalyModel | None = None) -> DataFrame:
    """One model over the frame (``keys=()``, the original's one-batch model) or
    one per key; a key with too few rows for a model gets the heuristic.  With ``model``
    the frame is scored by that model and none is fitted.  Output:
    the transaction columns plus is_anomaly,
    anomaly_score (0-100, 100 = most anomalous), anomaly_reasons, method."""
    keys = list(keys)
    if model is not None:
        checkpoint_dir(tx.sparkSession)
        scored = iforest.score_global(model_features(tx, model), model.forest).checkpoint(eager=True)
        ref = model.reference
    elif not keys:
        fitted = fit_anomaly_model(tx)
        if fitted is None:
            return an.anomaly_heuristic(tx, keys).withColumn("method", F.lit("heuristic"))
        ref, scored = fitted[0].reference, fitted[1]
    else:
        feats = an.anomaly_features(tx, keys=keys)
        z = an.standardize(feats, keys=keys)
        ref = an.feature_stats(feats, keys=keys, sample=True)
        scored = z.join(iforest.fit_score_by_key(z, ZCOLS, keys).drop(*keys), "id")
    by = [] if model is not None else keys
    norm = an.normalize_scores(scored.filter(F.col("decision").isNotNull()), "decision", by, "anomaly_score")
    res = an.anomaly_reasons(norm, ref, by)
    res = res.withColumn("method", F.lit("isolation_forest"))
    if not by:
        return res
    few = tx.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") < P.ANOMALY_MIN_FIT_ROWS).select(*keys)
    rest = an.anomaly_heuristic(tx.join(few, keys, "left_semi"), keys).withColumn("method", F.lit("heuristic"))
    return res.unionByName(rest, allowMissingColumns=True)


def anomaly_report(tx: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return an.anomaly_summary(detect_anomalies(tx, keys), keys)
