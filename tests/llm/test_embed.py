"""Links of embeddings whose variance lies in few dimensions, against all pairs."""
from __future__ import annotations

import numpy as np
import pandas as pd


def low_rank(rank, n, pairs, dim=64, seed=3):
    """Unit vectors in a subspace; the first ``pairs`` have a partner in it near cosine 0.95."""
    rng = np.random.default_rng(seed)
    basis = np.linalg.qr(rng.normal(size=(dim, rank)))[0]
    x = rng.normal(size=(n, rank))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    a = x[:pairs]
    d = rng.normal(size=a.shape)
    d -= (d * a).sum(axis=1, keepdims=True) * a
    d /= np.linalg.norm(d, axis=1, keepdims=True)
    return np.concatenate([x, 0.9501 * a + np.sqrt(1 - 0.9501 ** 2) * d]) @ basis.T


def all_pairs(x):
    return np.concatenate([(x[at:at + 2000] @ x.T >= 0.95).sum(axis=1) - 1 for at in range(0, len(x), 2000)])


def linked(spark, x):
    from moneta.llm.embed import near_embeddings
    df = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(len(x)), "embedding": list(x)}), "vec_id long, embedding array<double>")
    return near_embeddings(df).toPandas().set_index("vec_id").loc[range(len(x))]


def test_recall_on_low_rank_vectors(spark):
    x = low_rank(16, 14_000, 6000)
    want, got = all_pairs(x), linked(spark, x)["n_links"].to_numpy()
    assert (got <= want).all() and got.sum() >= 0.999 * want.sum()


def test_found_links_count_at_both_ends(spark):
    """A low recall, so that many links are found from one end only: with weights, and in blocks."""
    from moneta.llm.embed import near_embeddings
    x = low_rank(8, 6000, 3000)
    x = np.concatenate([x, x[:50]])
    df = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(len(x)), "embedding": list(x)}), "vec_id long, embedding array<double>")
    want = all_pairs(x)
    for block in (1024, 100):
        got = near_embeddings(df, recall=0.9, block=block).toPandas()
        n = got.set_index("vec_id").loc[range(len(x)), "n_links"].to_numpy()
        group = got.groupby("component_id")["n_links"].agg(["size", "min"])
        assert (n <= want).all() and n.sum() < want.sum() and n.sum() % 2 == 0
        assert (group["min"][group["size"] > 1] > 0).all()
        pair = group[group["size"] == 2]
        assert len(pair) > 100


def test_gaps_do_not_depend_on_the_batch():
    from moneta.llm.embed import gaps, similar
    x, c = low_rank(16, 500, 0)[:, :32], low_rank(16, 40, 0, seed=4)[:, :32]
    whole = gaps(x, c)
    assert all((gaps(x[i:i + 1], c)[0] == whole[i]).all() for i in range(500))
    u, v = np.array([[0.95, (1 - 0.95 ** 2) ** 0.5]]), np.eye(2)
    assert (similar(u, v, 0.95) == similar(v, u, 0.95).T).all()


def test_vectors_of_every_length_link(spark):
    from moneta.llm.embed import near_embeddings
    rng = np.random.default_rng(6)
    groups = [rng.normal(size=(30, d)) for d in (8, 5, 2)] + [np.array([[1.0], [2.0], [-3.0], [-3.0]]), np.ones((1, 7))]
    groups = [np.concatenate([x, 1.01 * x[:len(x) // 2] + 0.02]) if len(x) > 4 else x for x in groups]
    rows, want = [], {}
    for x in groups:
        u = x / np.linalg.norm(x, axis=1, keepdims=True)
        link, at = u @ u.T >= 0.95, len(rows)
        for i in range(len(x)):
            seen, todo = {i}, [i]
            while todo:
                new = set(map(int, np.flatnonzero(link[todo.pop()]))) - seen
                seen |= new
                todo += new
            want[at + i] = (int(link[i].sum()) - 1, at + min(seen))
            rows.append((at + i, x[i].tolist()))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = near_embeddings(df).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got} == want and len(got) == len(rows)
    lone = near_embeddings(df.where("vec_id in (0, 50, 100, 139)")).collect()  # no two of one length
    assert all(r["n_links"] == 0 and r["kept"] for r in lone)
