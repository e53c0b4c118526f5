"""Spending clusters: k-means on standardised amount, hour and weekday; best of
several seeded starts by cost; clusters relabelled by mean amount so ids are
stable; per-cluster description with aggregates.

All starts are fitted together: one pass over the features per iteration assigns
every row for every start and adds the rows up by (start, cluster) inside the task;
only these sums, starts * k rows, meet and reach the driver."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from moneta import params as P
from moneta.functions.common import attach, exact_quantiles, rnd, spread
from moneta.session import checkpoint_dir

FEATS = ["amount", "hour", "day_of_week"]


def cluster_features(tx: DataFrame) -> DataFrame:
    cols = set(tx.columns)
    hour = F.hour("timestamp") if "timestamp" in cols else F.lit(12)
    dow = F.weekday("date") if "date" in cols else F.lit(0)
    f = tx.withColumn("hour", hour.cast("double")).withColumn("day_of_week", dow.cast("double"))
    st = f.agg(*[x for c in FEATS for x in (F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}"))])
    j = attach(f, st, [])
    for c in FEATS:
        sd = F.col(f"s_{c}")
        j = j.withColumn(f"z_{c}", (F.col(c) - F.col(f"m_{c}")) /
                         F.when(sd.isNull() | (sd == 0), F.lit(1.0)).otherwise(sd))
    return j.drop(*[f"{p}_{c}" for c in FEATS for p in ("m", "s")])


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of every row (ties: the first) and its squared distance."""
    d = ((x[:, None, :] - centres[None]) ** 2).sum(axis=2)
    best = d.argmin(axis=1)
    return best, d[np.arange(len(x)), best]


def _matrix(batch: pa.RecordBatch, cols: list[str]) -> np.ndarray:
    return np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in cols])


def lloyd_step(feats: DataFrame, centres: dict[int, np.ndarray], cols: list[str]) -> DataFrame:
    """One iteration of every start in ``centres`` (start -> its centres), in one pass over ``feats``:
    (start, cluster, n, cost, s0, s1, ...): rows, squared distances and coordinates added up.
    A cluster without rows has none.  Each task sends one row per start and cluster."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {s: np.zeros((len(c), 2 + len(cols))) for s, c in centres.items()}
        for batch in batches:
            x = _matrix(batch, cols)
            for s, c in centres.items():
                best, d = _nearest(x, c)
                for j, w in enumerate([np.ones(len(x)), d, *x.T]):
                    total[s][:, j] += np.bincount(best, w, len(c))
        rows = [(s, k, int(t[0]), *t[1:].tolist()) for s, table in total.items() for k, t in enumerate(table) if t[0]]
        if rows:
            start, cluster, n, *rest = map(list, zip(*rows))
            yield pa.RecordBatch.from_arrays([pa.array(start, pa.int32()), pa.array(cluster, pa.int32()), pa.array(n, pa.int64()), *map(pa.array, rest)],
                                             names=["start", "cluster", "n", "cost", *(f"s{j}" for j in range(len(cols)))])

    sums = [f"s{j}" for j in range(len(cols))]
    each = feats.select(*cols).mapInArrow(run, "start int, cluster int, n long, cost double" + "".join(f", {c} double" for c in sums))
    return each.groupBy("start", "cluster").agg(F.sum("n").alias("n"), F.sum("cost").alias("cost"), *[F.sum(c).alias(c) for c in sums])


def seed_centres(sample: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k-means++: each centre a row of the sample, likelier the farther it lies from those before."""
    out = [sample[rng.integers(len(sample))]]
    while len(out) < k:
        d = _nearest(sample, np.array(out))[1]
        out.append(sample[rng.choice(len(sample), p=d / d.sum())] if d.sum() else sample[rng.integers(len(sample))])
    return np.array(out)


def spend_clusters(tx: DataFrame, k: int = P.KMEANS_CLUSTERS, n_init: int = P.KMEANS_STARTS, seed: int = P.KMEANS_SEED,
                   max_iter: int = 300, tol: float = 1e-4, sample: int = 4096, id_col: str = "id") -> tuple[DataFrame, float]:
    """Cluster every transaction (one model over the frame, as the original does
    for its batch).  Returns (rows with ``cluster``, inertia).

    The starts are seeded from at most ``sample`` rows, by hash of the id; all else covers all rows.  A
    start ends when its centres move by less than ``tol`` (squared, all together) or after
    ``max_iter`` iterations; the lowest cost wins, ties the first start."""
    z = [f"z_{c}" for c in FEATS]
    checkpoint_dir(tx.sparkSession)
    data = spread(cluster_features(tx)).checkpoint()
    n = data.count()
    if n < 3 * k:
        raise ValueError("Transações insuficientes para clustering")
    data_z = data.select(id_col, *[F.coalesce(c, F.lit(0.0)).alias(c) for c in z])
    u = F.xxhash64(F.lit(seed), id_col)
    near = data_z.where(u.bitwiseAND(F.lit(0x7FFFFFFFFFFFFFFF)) / F.lit(2.0 ** 63) < F.lit(4.0 * sample / n))
    first = np.array([tuple(r) for r in near.orderBy(u, id_col).limit(sample).select(*z).collect()])
    centres = {i: seed_centres(first, k, np.random.default_rng(seed + i)) for i in range(n_init)}
    moving, cost = dict(centres), {}
    for _ in range(max_iter):
        sums = lloyd_step(data_z, moving, z).collect()  # starts * k rows
        for i in list(moving):
            own = [r for r in sums if r["start"] == i]
            new = moving[i].copy()
            for r in own:
                new[r["cluster"]] = [r[f"s{j}"] / r["n"] for j in range(len(z))]
            cost[i] = sum(r["cost"] for r in own)  # of the centres before
            if ((new - moving[i]) ** 2).sum() <= tol:
                del moving[i]
            else:
                moving[i] = new
            centres[i] = new
        if not moving:
            break
    best = centres[min(cost, key=lambda i: (round(cost[i], 6), i))]

    # clusters are numbered by their mean amount; the means come with the same pass as the final cost
    sums = lloyd_step(data_z, {0: best}, z).collect()
    mean = {r["cluster"]: r["s0"] / r["n"] for r in sums}  # the scaled amount is in the order of the amount
    best = best[sorted(mean, key=lambda c: (mean[c], c))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.nan_to_num(_matrix(batch, z), nan=0.0)
            yield batch.append_column("cluster", pa.array(_nearest(x, best)[0].astype(np.int32)))

    out = data.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in data.schema.fields) + ", cluster int")
    return out, float(sum(r["cost"] for r in sums))


def describe_clusters(clustered: DataFrame) -> DataFrame:
    """Size, share, mean and total per cluster and its characteristics: mean
    above the cluster's own q75 / below q25, time band of the mean hour, main
    category (mode, ties to the smallest); nothing -> 'Padrão misto'.

    There are only k groups, so the quantiles come from counts by value range
    (exact, linear interpolation) and no task merges a cluster's whole value map."""
    qs = exact_quantiles(clustered, "amount", (0.75, 0.25), ["cluster"]).select(
        "cluster", F.col("q0").alias("_q75"), F.col("q1").alias("_q25"))
    total = clustered.agg(F.count(F.lit(1)).alias("_all"))
    g = clustered.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("size"), F.avg("amount").alias("_avg"), F.sum("amount").alias("_tot"),
        F.avg("hour").alias("_h"), F.mode("category", True).alias("_mode"))
    g = attach(g.join(qs, "cluster", "left"), total, [])
    h = F.col("_h")
    ch = F.concat_ws("|",
                     F.when(F.col("_avg") > F.col("_q75"), F.lit("Valores altos"))
                     .when(F.col("_avg") < F.col("_q25"), F.lit("Valores baixos")),
                     F.when((h >= 0) & (h <= 6), F.lit("Predominantemente noturno"))
                     .when((h > 6) & (h <= 12), F.lit("Predominantemente matutino"))
                     .when((h > 12) & (h <= 18), F.lit("Predominantemente vespertino")),
                     F.when(F.col("_mode").isNotNull(), F.concat(F.lit("Categoria principal: "), F.col("_mode"))))
    return g.select("cluster", "size", rnd(F.col("size") / F.col("_all") * 100, 1).alias("percentage"),
                    rnd("_avg", 2).alias("avg_amount"), rnd("_tot", 2).alias("total_amount"),
                    F.when(ch == "", F.lit("Padrão misto")).otherwise(ch).alias("characteristics"))
