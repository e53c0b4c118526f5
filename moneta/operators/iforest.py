"""Isolation forest (Liu, Ting & Zhou, 2008) on Spark.

* Sampling: each tree draws at most ``psi`` rows, the ones with the smallest
  ``xxhash64(seed, tree, id)`` — deterministic whatever the partitioning.  A
  Bernoulli pre-filter on the same hash (rate 4 psi / n) keeps the explode small,
  and ``row_number() <= psi`` per tree is planned as a window-group limit.
* Growth: ``groupBy(tree).applyInPandas`` — every group holds <= psi rows.
* Scoring, one model (``keys=()``): the forest has at most trees * (2 psi - 1)
  nodes (51,100 for the defaults), a proven bound, so it is shipped to the
  tasks and ``mapInPandas`` walks all trees at once, vectorised with numpy.
* One model per key: a key's trees draw from a hash sample of its rows; a cogroup
  regrows the key's forest from that sample and scores the group's rows.  A group is one salt of a
  large key or many small keys.

score = 2 ** (-E[h(x)] / c(psi)); ``score_samples = -score`` (low = anomalous);
decision = score_samples - offset, offset = the contamination quantile of the
training scores; anomaly when decision < 0.
"""
from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from moneta import params as P
from moneta.functions.common import attach_one_row, exact_quantiles, spread, spread_by
from moneta.session import checkpoint_dir

EULER = 0.5772156649015329
NODE_FIELDS = [("tree", T.IntegerType()), ("node", T.IntegerType()), ("feature", T.IntegerType()),
               ("threshold", T.DoubleType()), ("left", T.IntegerType()), ("right", T.IntegerType()),
               ("value", T.DoubleType()), ("psi", T.IntegerType())]


def c_factor(n) -> np.ndarray:
    """Average path length of an unsuccessful BST search over n points."""
    n = np.asarray(n, dtype=float)
    out = np.zeros_like(n)
    two = n == 2
    big = n > 2
    out[two] = 1.0
    nb = n[big]
    out[big] = 2.0 * (np.log(nb - 1.0) + EULER) - 2.0 * (nb - 1.0) / nb
    return out


def grow_forest(X: np.ndarray, samples: np.ndarray, rng: np.random.Generator,
                max_depth: int) -> dict[str, np.ndarray]:
    """Grow ``len(samples)`` isolation trees at once, level by level.

    ``samples`` is (trees, psi) row indices into X.  At each node a feature is
    drawn among those not constant on the node's rows and the split is uniform in
    [min, max); a node becomes a leaf at ``max_depth``, at one row, or when every
    feature is constant.  Returns flat node arrays; tree t's root is node t.
    Leaf ``value`` = depth + c(rows in leaf)."""
    n_trees, psi = samples.shape
    size = n_trees * (2 * psi - 1)  # a tree's nodes at most
    feature, left, right = (np.full(size, -1, dtype=np.int64) for _ in range(3))
    threshold, value = np.zeros(size), np.zeros(size)
    n_nodes = n_trees
    vals = X[samples.ravel()].T.copy()                # the rows of all live nodes, node by node
    node = np.repeat(np.arange(n_trees), psi)         # their nodes, ascending
    for depth in range(max_depth + 1):
        if node.size == 0:
            break
        starts = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
        ids = node[starts]
        sizes = np.diff(starts, append=node.size)
        lo = np.minimum.reduceat(vals, starts, axis=1).T
        hi = np.maximum.reduceat(vals, starts, axis=1).T
        valid = hi > lo
        n_valid = valid.sum(axis=1)
        split = (depth < max_depth) & (sizes > 1) & (n_valid > 0)
        value[ids[~split]] = depth + c_factor(sizes[~split])
        sp = np.flatnonzero(split)
        if sp.size == 0:
            break
        r = rng.random(sp.size)
        pick = np.minimum((r * n_valid[sp]).astype(np.int64), n_valid[sp] - 1)
        q = np.argmax(np.cumsum(valid[sp], axis=1) > pick[:, None], axis=1)
        a, b = lo[sp, q], hi[sp, q]
        t = a + rng.random(sp.size) * (b - a)
        sid = ids[sp]
        feature[sid], threshold[sid] = q, t
        left[sid] = n_nodes + 2 * np.arange(sp.size)
        right[sid] = left[sid] + 1
        # rows of split nodes go on, rows that ended in a leaf stop
        on = np.flatnonzero(np.repeat(split, sizes))
        k = np.repeat(np.arange(sp.size), sizes[sp])
        child = 2 * k + ~(vals[q[k], on] <= t[k])
        order = np.argsort(child, kind="stable")
        vals, node = vals[:, on[order]], n_nodes + child[order]
        n_nodes += 2 * sp.size
    return {"feature": feature[:n_nodes], "threshold": threshold[:n_nodes], "left": left[:n_nodes],
            "right": right[:n_nodes], "value": value[:n_nodes]}


def _max_depth(psi: int) -> int:
    return int(math.ceil(math.log2(max(psi, 2))))


@dataclass
class FlatForest:
    """All trees of one model in flat arrays (tree roots in ``roots``)."""
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    psi: int

    @staticmethod
    def from_nodes(nodes: pd.DataFrame) -> "FlatForest":
        nodes = nodes.sort_values(["tree", "node"]).reset_index(drop=True)
        sizes = nodes.groupby("tree", sort=True).size().to_numpy()
        offsets = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
        off = np.repeat(offsets, sizes)
        lft = nodes["left"].to_numpy().astype(np.int64)
        rgt = nodes["right"].to_numpy().astype(np.int64)
        return FlatForest(
            feature=nodes["feature"].to_numpy().astype(np.int64),
            threshold=nodes["threshold"].to_numpy(),
            left=np.where(lft >= 0, lft + off, -1), right=np.where(rgt >= 0, rgt + off, -1),
            value=nodes["value"].to_numpy(), roots=offsets, psi=int(nodes["psi"].iloc[0]))

    def score_samples(self, X: np.ndarray) -> np.ndarray:
        """-(2 ** (-mean path length / c(psi))) for every row of X."""
        m, t = X.shape[0], self.roots.size
        if m == 0:
            return np.zeros(0)
        node = np.broadcast_to(self.roots, (m, t)).copy()
        for _ in range(_max_depth(self.psi) + 1):
            f = self.feature[node]
            inner = f >= 0
            if not inner.any():
                break
            xv = np.take_along_axis(X, np.where(inner, f, 0), axis=1)
            nxt = np.where(xv <= self.threshold[node], self.left[node], self.right[node])
            node = np.where(inner, nxt, node)
        h = self.value[node].mean(axis=1)
        return -np.power(2.0, -h / float(c_factor([self.psi])[0] or 1.0))


def _tree_rng(seed: int, tree: int, key_hash: int = 0) -> np.random.Generator:
    return np.random.default_rng([seed, tree, key_hash & 0xFFFFFFFF])


def _grow_group(pdf: pd.DataFrame, zcols: list[str], seed: int, key_cols: list[str]) -> pd.DataFrame:
    tree = int(pdf["tree"].iloc[0])
    kh = int(pd.util.hash_pandas_object(pdf[key_cols].iloc[:1], index=False).iloc[0]) if key_cols else 0
    X = pdf.sort_values("_u")[zcols].to_numpy(dtype=float)
    psi = X.shape[0]
    tr = grow_forest(X, np.arange(psi)[None, :], _tree_rng(seed, tree, kh), _max_depth(psi))
    n = tr["feature"].size
    out = pd.DataFrame({"tree": np.full(n, tree, dtype=np.int32), "node": np.arange(n, dtype=np.int32),
                        "feature": tr["feature"], "threshold": tr["threshold"], "left": tr["left"],
                        "right": tr["right"], "value": tr["value"], "psi": np.full(n, psi, dtype=np.int32)})
    for k in key_cols:
        out.insert(0, k, pdf[k].iloc[0])
    return out


def fit_nodes(feats: DataFrame, zcols: Sequence[str], keys: Sequence[str] = (), id_col: str = "id",
              n_trees: int = P.ANOMALY_N_ESTIMATORS, psi: int = 256, seed: int = P.ANOMALY_RANDOM_STATE,
              counts: DataFrame | None = None) -> DataFrame:
    """Grow the forest(s): one row per node, keyed by (keys..., tree, node)."""
    keys, zcols = list(keys), list(zcols)
    if counts is None:
        counts = feats.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    base = feats.join(counts, keys) if keys else attach_one_row(feats, counts)
    # one hash a row leaves the rows that all trees together draw from; only these are hashed for each tree
    unit = lambda *c: F.xxhash64(F.lit(seed), *c).bitwiseAND(F.lit(0x7FFFFFFFFFFFFFFF)) / F.lit(2.0 ** 63)
    base = base.filter(unit(F.lit(-1), F.col(id_col)) < F.lit(float(n_trees * psi)) / F.col("_n"))
    rate = F.least(F.lit(1.0), F.lit(4.0 * psi) / F.least(F.col("_n"), F.lit(n_trees * psi)))
    hashu = lambda t: unit(t, F.col(id_col))
    cand = (base.withColumn("tree", F.explode(F.filter(F.sequence(F.lit(0), F.lit(n_trees - 1)),
                                                      lambda t: hashu(t) < rate)))
            .withColumn("_u", hashu(F.col("tree"))))
    w = Window.partitionBy(*keys, "tree").orderBy("_u", id_col)
    sample = cand.withColumn("_rk", F.row_number().over(w)).filter(F.col("_rk") <= psi)
    schema = T.StructType([f for f in feats.select(*keys).schema.fields] +
                          [T.StructField(n, t) for n, t in NODE_FIELDS])
    return (spread_by(sample.select(*keys, "tree", "_u", *zcols), *keys, "tree")
            .groupBy(*keys, "tree")
            .applyInPandas(lambda pdf: _grow_group(pdf, zcols, seed, keys), schema))


@dataclass
class ForestModel:
    """A fitted single model: flat forest plus the training offset."""
    forest: FlatForest
    offset: float
    zcols: list[str]
    nodes: pd.DataFrame | None = None  # the forest as a table, to be stored


def fit_global(feats: DataFrame, zcols: Sequence[str], id_col: str = "id",
               n_trees: int = P.ANOMALY_N_ESTIMATORS, psi: int = 256, seed: int = P.ANOMALY_RANDOM_STATE,
               contamination: float = P.ANOMALY_CONTAMINATION, n: int | None = None) -> tuple[ForestModel, DataFrame] | None:
    """One model over the whole frame; None when there are fewer than 10 rows (``n``: their number, if known).

    Returns the model and the training rows already scored (checkpointed to the
    session's checkpoint folder, so the Python scoring runs once and the lineage
    is cut before the offset, normalisation and reasons read it)."""
    zcols = list(zcols)
    if n is None:
        n = feats.count()
    if n < P.ANOMALY_MIN_FIT_ROWS:
        return None
    counts = feats.sparkSession.range(1).select(F.lit(n).alias("_n"))
    nodes = fit_nodes(feats, zcols, (), id_col, n_trees, min(psi, n), seed, counts=counts)
    table = nodes.toPandas()  # bounded: n_trees * (2 psi - 1) rows
    forest = FlatForest.from_nodes(table)
    checkpoint_dir(feats.sparkSession)
    scored = score_global(feats, ForestModel(forest, 0.0, zcols), id_col).checkpoint(eager=True)
    off = exact_quantiles(scored, "score_samples", (contamination,)).first()["q0"]
    model = ForestModel(forest, float(off), zcols, table)
    d = F.col("score_samples") - F.lit(float(off))
    return model, scored.withColumn("decision", d).withColumn("is_anomaly", d < 0)


def score_global(feats: DataFrame, model: ForestModel, id_col: str = "id") -> DataFrame:
    """Adds score_samples, decision and is_anomaly (decision < 0)."""
    zcols = model.zcols
    forest, offset = model.forest, model.offset
    schema = T.StructType(feats.schema.fields + [T.StructField("score_samples", T.DoubleType()),
                                                 T.StructField("decision", T.DoubleType()),
                                                 T.StructField("is_anomaly", T.BooleanType())])

    def run(batches):
        for pdf in batches:
            for at in range(0, len(pdf), 10_000):  # the node matrix has a column per tree
                part = pdf.iloc[at:at + 10_000]
                s = forest.score_samples(part[zcols].to_numpy(dtype=float))
                d = s - offset
                yield part.assign(score_samples=s, decision=d, is_anomaly=d < 0)

    return spread(feats).mapInPandas(run, schema)


def fit_score_by_key(feats: DataFrame, zcols: Sequence[str], keys: Sequence[str] = ("user_id",),
                     id_col: str = "id", n_trees: int = P.ANOMALY_N_ESTIMATORS, psi: int = 256,
                     seed: int = P.ANOMALY_RANDOM_STATE, contamination: float = P.ANOMALY_CONTAMINATION,
                     rows_per_task: int = 200_000) -> DataFrame:
    """One model per key, the same for keys of every size.  Returns (keys, id,
    score_samples, decision, is_anomaly); keys with fewer than 10 rows get nulls (not fitted).

    A key's trees draw from its ``n_trees * psi`` rows of smallest id hash (as many as all
    trees together can hold).  A key of more than ``rows_per_task`` rows is dealt to groups of about
    that size; each group regrows the key's forest from that sample, which gives the same trees
    everywhere, and scores its rows.  Smaller keys share groups of about ``rows_per_task / 100`` rows, where the
    sample is picked from the key's own rows, so that a group's fixed cost is paid once for many keys.  No task
    holds a whole hot key and no model is shuffled; ``rows_per_task`` changes the work's layout, not the result."""
    keys, zcols = list(keys), list(zcols)
    counts = feats.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    j = feats.select(*keys, id_col, *zcols).join(counts, keys)
    large = F.col("_n") > rows_per_task
    key_fields = feats.select(*keys, id_col).schema.fields
    schema = T.StructType(key_fields + [T.StructField("score_samples", T.DoubleType())])

    pool_rows = n_trees * psi
    u = F.xxhash64(F.lit(seed), F.col(id_col)).bitwiseAND(F.lit(0x7FFFFFFFFFFFFFFF)) / F.lit(2.0 ** 63)
    n_salts = F.ceil(F.col("_n") / F.lit(rows_per_task)).cast("int")
    shared = counts.agg(F.ceil(F.coalesce(F.sum(F.when(~large, F.col("_n"))), F.lit(0)) / (rows_per_task / 100)).alias("_groups"))
    h = F.xxhash64(*keys)
    fitted = (attach_one_row(j.filter(F.col("_n") >= P.ANOMALY_MIN_FIT_ROWS), shared).withColumn("_u", u)
              .withColumn("_group", F.when(large, -1 - F.pmod(h, F.lit(1 << 40))).otherwise(F.pmod(h, F.greatest("_groups", F.lit(1)))))
              .withColumn("_pool", F.col("_u") * F.col("_n") < 2 * pool_rows).withColumn("_large", large))
    w = Window.partitionBy(*keys).orderBy("_u", id_col)
    pool = (fitted.filter("_large and _pool").withColumn("_rk", F.row_number().over(w)).filter(F.col("_rk") <= pool_rows)
            .withColumn("_salt", F.explode(F.sequence(F.lit(0), n_salts - 1)))
            .select(*[F.col(c).alias(f"p_{c}") for c in [*keys, id_col, *zcols, "_u", "_group", "_salt"]]))
    rows = (fitted.withColumn("_salt", F.when(large, F.pmod(F.xxhash64(F.col(id_col)), n_salts)).otherwise(0).cast("int"))
            .select(*keys, id_col, *zcols, "_u", "_pool", "_large", "_group", "_salt"))

    def score(part: pd.DataFrame, sample: pd.DataFrame) -> pd.DataFrame:
        if part.empty:
            return pd.DataFrame(columns=[f.name for f in schema.fields])
        small = part.loc[part["_pool"] & ~part["_large"], [*keys, id_col, *zcols, "_u"]]
        sample = pd.concat([sample.rename(columns=lambda c: c[2:])[small.columns], small]).sort_values(["_u", id_col])
        key = pd.concat([part[keys], sample[keys]]).groupby(keys, sort=False, dropna=False).ngroup().to_numpy()
        of_row, of_sample = key[:len(part)], key[len(part):]
        by_row, by_sample = np.argsort(of_row, kind="stable"), np.argsort(of_sample, kind="stable")
        ends = np.arange(int(key.max()) + 2)
        rows_at, sample_at = np.searchsorted(of_row[by_row], ends), np.searchsorted(of_sample[by_sample], ends)
        Z, X_all = part[zcols].to_numpy(dtype=float), sample[zcols].to_numpy(dtype=float)
        heads = sample[keys].iloc[by_sample[sample_at[:-1]]]
        hashes = pd.util.hash_pandas_object(heads, index=False).to_numpy()
        scores = np.empty(len(part))
        for k, key_hash in enumerate(hashes):
            at = by_row[rows_at[k]:rows_at[k + 1]]
            X = X_all[by_sample[sample_at[k]:sample_at[k + 1]][:pool_rows]]
            p = min(psi, len(X))
            rng = _tree_rng(seed, n_trees, int(key_hash))
            drawn = np.stack([np.sort(rng.choice(len(X), size=p, replace=False)) for _ in range(n_trees)])
            tr = grow_forest(X, drawn, rng, _max_depth(p))
            ff = FlatForest(tr["feature"], tr["threshold"], tr["left"], tr["right"], tr["value"],
                            np.arange(n_trees, dtype=np.int64), p)
            for lo in range(0, len(at), 10_000):
                scores[at[lo:lo + 10_000]] = ff.score_samples(Z[at[lo:lo + 10_000]])
        return part[[*keys, id_col]].assign(score_samples=scores)

    checkpoint_dir(feats.sparkSession)
    scored = (spread_by(rows, "_group", "_salt").groupBy("_group", "_salt")
              .cogroup(spread_by(pool, "p__group", "p__salt").groupBy("p__group", "p__salt"))
              .applyInPandas(score, schema).checkpoint(eager=True))
    offs = exact_quantiles(scored, "score_samples", (contamination,), keys).withColumnRenamed("q0", "_off")
    done = (scored.join(offs, keys).withColumn("decision", F.col("score_samples") - F.col("_off"))
            .withColumn("is_anomaly", F.col("decision") < 0).drop("_off"))
    few = j.filter(F.col("_n") < P.ANOMALY_MIN_FIT_ROWS).select(*keys, id_col)
    return done.unionByName(few, allowMissingColumns=True)
