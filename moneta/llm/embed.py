"""Near-duplicate embeddings with an inverted multi-index.

Unit vectors are cut in two halves.  Each half has a codebook of k centroids,
fitted independently on a bounded sample; the two codebooks span a grid of k x k
cells, and every vector is listed in its nearest cell.  A query visits cells by the
multi-sequence algorithm, in the order of the sum of its two gaps: how much farther than
the nearest centroid a centroid is, for each half.  It stops where the target recall is
reached.  The gap is calibrated on the table itself and is the larger of two: one within
which ``recall`` of the true links of probe vectors lie, found by comparing the probes with
all vectors, counted by links and by probes; and one within which ``recall`` of made partners
lie, at exactly the asked cosine in the directions in which sample vectors differ.  The cells'
vectors are then verified in double precision.  A link that is found from one of its ends
counts at both: where the other end's own visits stop before the cell, it is counted there
from this end's visit.  Gaps are exact numbers, so all blocks agree on who visits whom.

Vectors with equal components form a class that is compared once and counts with
its size.  A cell's members and its queries are dealt out in blocks of bounded
size, so no task holds a cell of any size.  A block sends a count and a component
label for each vector, never its pairs.

Defined results: a vector that is null, empty, zero, or has null or non-finite
components links with nothing; vectors link within their own length, each length with
codebooks, cells and a stop of its own; identical rows are one vector; of rows that share a vec_id but not the
vector, each takes part, and the id has the sum of their links; a null vec_id
takes no part and has a null component; an empty table gives an empty result; only vec_id and embedding are
read, so other columns cannot clash.
"""
from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from moneta.llm.common import bounded_sample, connected, written

#: Vectors that the codebooks are fitted on; vectors whose true links are looked for in the whole table;
#: vectors of a block; members that a cell should have; share of the links whose cell a query must visit.
SAMPLE, PROBES, BLOCK, PER_CELL, RECALL = 4096, 2048, 1024, 512, 0.9995
#: Gaps of true links are counted in steps of 1 / STEPS.
STEPS = 4096


def codebook(x: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """k-means centroids of the rows of x."""
    x = np.unique(x, axis=0)
    rng = np.random.default_rng(seed)
    c = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = nearest(x, c)
        for i in range(len(c)):
            if (own := near == i).any():
                c[i] = x[own].mean(axis=0)
    return np.unique(c, axis=0)


def grid(x: np.ndarray) -> np.ndarray:
    """x in steps of 2 ** -24: products and sums of parts of unit vectors are then exact in
    double, whatever the order of summation, so equal rows give equal distances in any batch."""
    return np.rint(x * 2.0 ** 24) / 2.0 ** 24


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows to centroids, less the rows' own squares."""
    x, c = grid(x), grid(c)
    return (c * c).sum(axis=1)[None, :] - 2 * x @ c.T


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return distances(x, c).argmin(axis=1)


def gaps(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """For each row of x and centroid, how much farther (squared) it is than the nearest one."""
    d = distances(x, c)
    return d - d.min(axis=1, keepdims=True)


def stop_gap(x: np.ndarray, one: np.ndarray, two: np.ndarray, cosine: float, recall: float, seed: int = 9) -> float:
    """The sum of gaps within which a partner's cell lies with probability ``recall``, seen from
    the rows of x: for partners at exactly the asked cosine in the directions of differences
    between rows of x, the farthest that count."""
    rng = np.random.default_rng(seed)
    y = np.concatenate([x[rng.permutation(len(x))] - x[rng.permutation(len(x))] for _ in range(8)])
    x = np.concatenate([x] * 8)
    y -= (y * x).sum(axis=1, keepdims=True) * x
    far = np.linalg.norm(y, axis=1) > 1e-6
    if not far.any():
        return 1e-9
    x, y = x[far], y[far]
    y = cosine * x + np.sqrt(max(0.0, 1 - cosine * cosine)) * y / np.linalg.norm(y, axis=1, keepdims=True)
    h, at = x.shape[1] // 2, np.arange(len(x))
    need = gaps(x[:, :h], one)[at, nearest(y[:, :h], one)] + gaps(x[:, h:], two)[at, nearest(y[:, h:], two)]
    return float(np.quantile(need, recall)) + 1e-9


def _link_steps(own: np.ndarray, x: np.ndarray, one: np.ndarray, two: np.ndarray, cosine: float):
    """(probe, step, n): of the links between probe vectors x of the classes ``own`` and a batch's
    vectors, how many need a gap up to the step."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        h = x.shape[1] // 2
        ga, gb = gaps(x[:, :h], one), gaps(x[:, h:], two)
        for b in batches:
            for at in range(0, len(b), 1024):
                part = b.iloc[at:at + 1024]
                i, j = np.nonzero((x @ _rows(part["unit"]).T >= cosine) & (own[:, None] != part["cls"].to_numpy()[None, :]))
                cell = part["cell"].to_numpy()[j]
                step = np.ceil((ga[i, cell // len(two)] + gb[i, cell % len(two)]) * STEPS).astype(np.int64)
                found, n = np.unique(np.stack((i, step)), axis=1, return_counts=True)
                yield pd.DataFrame({"probe": found[0], "step": found[1], "n": n})
    return run


def link_gap(members: DataFrame, probes: pd.DataFrame, one: np.ndarray, two: np.ndarray, cosine: float, recall: float) -> tuple[float, pd.DataFrame]:
    """The gap within which ``recall`` of the probes' true links lie, by links and with each probe
    counting once, and the links counted by steps.  All members are compared with the probes."""
    found = members.select("cls", "unit", "cell").mapInPandas(
        _link_steps(probes["cls"].to_numpy(), _rows(probes["unit"]), one, two, cosine), "probe long, step long, n long")
    found = found.groupBy("probe", "step").agg(F.sum("n").alias("n"))
    found = found.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("probe")))
    steps = found.groupBy("step").agg(F.sum("n").alias("n"), F.sum("share").alias("share")).orderBy("step").toPandas()  # at most 8 * STEPS
    if not len(steps):
        return 0.0, steps
    last = max(int((steps[c].cumsum() >= recall * steps[c].sum() - 1e-9).argmax()) for c in ("n", "share"))
    return steps["step"].iloc[last] / STEPS + 1e-9, steps


def multi_sequence(a: np.ndarray, b: np.ndarray, limit: float) -> Iterator[tuple[int, int]]:
    """Cells (i, j) in the order of a[i] + b[j], as long as the sum is within ``limit``."""
    ia, ib = a.argsort(kind="stable"), b.argsort(kind="stable")
    heap, seen = [(a[ia[0]] + b[ib[0]], 0, 0)], {(0, 0)}
    while heap:
        total, s, t = heapq.heappop(heap)
        if total > limit:
            return
        yield int(ia[s]), int(ib[t])
        for n in ((s + 1, t), (s, t + 1)):
            if n[0] < len(a) and n[1] < len(b) and n not in seen:
                seen.add(n)
                heapq.heappush(heap, (a[ia[n[0]]] + b[ib[n[1]]], *n))


def _units(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        units = []
        for e in batch["embedding"]:
            x = np.empty(0) if e is None else np.array(e, dtype=np.float64)
            norm = np.sqrt((x / m * (x / m)).sum()) * m if len(x) and np.isfinite(x).all() and (m := np.abs(x).max()) > 0 else 0.0
            units.append((x / norm).tobytes() if norm > 0 and np.isfinite(norm) else None)
        yield pd.DataFrame({"vec_id": batch["vec_id"], "h1": batch["h1"], "h2": batch["h2"], "unit": units})


def _rows(units: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(units), np.float64).reshape(len(units), -1)


def _cells(one: np.ndarray, two: np.ndarray):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                x = _rows(b["unit"])
                h = x.shape[1] // 2
                yield b.assign(cell=nearest(x[:, :h], one) * len(two) + nearest(x[:, h:], two))[["cls", "weight", "unit", "cell"]]
    return run


def _visits(one: np.ndarray, two: np.ndarray, used: frozenset, limit: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 256):
                part = b.iloc[at:at + 256]
                x = _rows(part["unit"])
                h = x.shape[1] // 2
                cells = [[i * len(two) + j for i, j in multi_sequence(p, q, limit) if i * len(two) + j in used]
                         for p, q in zip(gaps(x[:, :h], one), gaps(x[:, h:], two))]
                yield part.assign(home=part["cell"], cell=cells)[["cls", "weight", "unit", "home", "cell"]]
    return run


def similar(a: np.ndarray, b: np.ndarray, cosine: float) -> np.ndarray:
    """Which rows of a and b have the cosine; the same for (b, a), also at the very border."""
    s = a @ b.T
    link = s >= cosine
    for i, j in np.argwhere(np.abs(s - cosine) < 1e-13):
        link[i, j] = math.fsum(a[i] * b[j]) >= cosine
    return link


def _verify(cosine: float, one: np.ndarray, two: np.ndarray, limit: float):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        q, m = group[group["query"]], group[~group["query"]]
        if not len(q) or not len(m):
            return pd.DataFrame({"cls": [], "n": [], "label": []}, dtype="int64")
        qi, mi = q["cls"].to_numpy(), m["cls"].to_numpy()
        x = _rows(m["unit"])
        link = similar(_rows(q["unit"]), x, cosine) & (qi[:, None] != mi[None, :])
        rows, cols = np.flatnonzero(link.any(axis=1)), np.flatnonzero(link.any(axis=0))
        link, qi, mi, x, h = link[np.ix_(rows, cols)], qi[rows], mi[cols], x[cols], x.shape[1] // 2
        n = link @ m["weight"].to_numpy()[cols]
        # a member that doesn't visit the query's cell hears of the link here only
        home = q["home"].to_numpy(np.int64)[rows]
        deaf = gaps(x[:, :h], one)[:, home // len(two)] + gaps(x[:, h:], two)[:, home % len(two)] > limit
        back = (link.T & deaf) @ q["weight"].to_numpy()[rows]
        ql, ml, far = qi.copy(), mi.copy(), np.iinfo(np.int64).max
        while len(rows):  # the smallest label spreads over the links of this block
            nq = np.minimum(ql, np.where(link, ml[None, :], far).min(axis=1))
            nm = np.minimum(ml, np.where(link, nq[:, None], far).min(axis=0))
            if (nq == ql).all() and (nm == ml).all():
                break
            ql, ml = nq, nm
        return pd.DataFrame({"cls": np.concatenate((qi, mi)), "n": np.concatenate((n, back)),
                             "label": np.concatenate((ql, ml))}).astype("int64")
    return run


def _found(classes: DataFrame, size: int, n: int, cosine: float, recall: float, sample: int, block: int, probes: int) -> DataFrame:
    """(cls, n, label): links and block components of n classes of vectors of one length."""
    if size == 8:  # one number has no two halves
        classes = classes.withColumn("unit", F.concat("unit", F.lit(bytearray(8))))
    drawn = bounded_sample(classes.select("cls", "unit"), sample + probes, "unit").toPandas()
    fit, probe = _rows(drawn["unit"][:sample]), drawn[-probes:]  # apart unless the table is small
    k, h = int(min(256, max(2, round((n / PER_CELL) ** 0.5)))), fit.shape[1] // 2
    one, two = codebook(fit[:, :h], k), codebook(fit[:, h:], k)
    members = written(classes.select("cls", "weight", "unit").mapInPandas(
        _cells(one, two), "cls long, weight long, unit binary, cell long"), "cells")
    counts = members.groupBy("cell").count()
    used = frozenset(r["cell"] for r in counts.select("cell").collect())  # at most 256 * 256
    limit = max(stop_gap(_rows(probe["unit"]), one, two, cosine, recall), link_gap(members, probe, one, two, cosine, recall)[0])
    visits = members.mapInPandas(_visits(one, two, used, limit), "cls long, weight long, unit binary, home long, cell array<long>")
    visits = written(visits, "visits").withColumn("cell", F.explode("cell"))
    blocks = counts.select("cell", F.ceil(F.col("count") / block).cast("int").alias("ms")).join(
        visits.groupBy("cell").agg(F.ceil(F.count("*") / block).cast("int").alias("qs")), "cell")

    def dealt(side: DataFrame, own: str, other: str, query: bool) -> DataFrame:
        side = side.join(blocks, "cell").withColumn(own, F.pmod(F.xxhash64("cls"), F.col(own + "s")).cast("int"))
        side = side.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(other + "s") - 1)))
        return side.select("cell", "m", "q", "cls", "weight", "unit", (F.col("home") if query else F.lit(None)).cast("long").alias("home"),
                           F.lit(query).alias("query"))

    pairs = dealt(visits, "q", "m", True).unionByName(dealt(members, "m", "q", False))
    return written(pairs.groupBy("cell", "m", "q").applyInPandas(_verify(cosine, one, two, limit), "cls long, n long, label long"), "found")


def near_embeddings(vectors: DataFrame, cosine: float = 0.95, recall: float = RECALL, sample: int = SAMPLE,
                    block: int = BLOCK, probes: int = PROBES) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per row of ``vectors``."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.select("vec_id", "embedding", F.xxhash64("embedding").alias("h1"), F.xxhash64(F.lit(1), "embedding").alias("h2"))
    rows = written(rows.mapInPandas(_units, "vec_id long, h1 long, h2 long, unit binary"), "units")
    plain = rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    good = rows.where("unit is not null and vec_id is not null")
    classes = written(good.groupBy("h1", "h2").agg(F.min("vec_id").alias("cls"), F.count_distinct("vec_id").alias("weight"),
                                                  F.first("unit").alias("unit")), "classes")
    sizes = classes.groupBy(F.octet_length("unit").alias("size")).count().orderBy("size").collect()  # the lengths that occur
    if not sizes:
        return plain
    parts = [_found(classes.where(F.octet_length("unit") == r["size"]), r["size"], r["count"], cosine, recall, sample, block, probes)
             for r in sizes if r["count"] > 1]
    found = reduce(DataFrame.unionByName, parts) if parts else classes.sparkSession.createDataFrame([], "cls long, n long, label long")
    links = found.groupBy("cls").agg(F.sum("n").alias("n"))
    comps = connected(found.where("cls <> label"), "cls", "label").withColumnRenamed("node", "cls")
    known = classes.select("h1", "h2", "cls", "weight").join(links, "cls", "left").join(comps, "cls", "left")
    per = good.select("vec_id", "h1", "h2").distinct().join(known, ["h1", "h2"]).groupBy(F.col("vec_id").alias("_id")).agg(
        F.sum(F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n"), F.min(F.coalesce("component", "cls")).alias("c"))
    out = rows.join(per, F.col("vec_id") == F.col("_id"), "left")
    comp = F.coalesce("c", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), comp.alias("component_id"),
                      F.coalesce(F.col("vec_id") == comp, F.lit(True)).alias("kept"))
