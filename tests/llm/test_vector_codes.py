"""Vector codes against all distances, on awkward rows."""
from __future__ import annotations

import hashlib
import math
from collections import defaultdict

import numpy as np
import pytest

from moneta.llm.vector_codes import Slices, compress_vectors, integers


@pytest.mark.parametrize("n,width,spread", [(16, 8, 50), (70, 3, 5), (1, 4, 9), (200, 2, 400), (16, 1, 3)])
def test_search_equals_all_distances(n, width, spread):
    rng = np.random.default_rng(n)
    entries = rng.integers(-spread, spread, (n, width))
    x = rng.integers(-2 * spread, 2 * spread, (500, width))
    best, error = Slices(entries).nearest(x)
    d = ((x[:, None, :] - entries[None]) ** 2).sum(axis=2)
    assert best.tolist() == d.argmin(axis=1).tolist()  # ties: the first
    assert error.tolist() == d.min(axis=1).tolist()
    big = Slices(entries.astype(object)).nearest(x.astype(object))
    assert big[0].tolist() == best.tolist() and big[1].tolist() == error.tolist()


def test_candidates_are_a_slice_of_every_dimension():
    rng = np.random.default_rng(1)
    entries, x = rng.integers(-20, 20, (130, 3)), rng.integers(-20, 20, (50, 3))
    radius = rng.integers(0, 15, 50)
    masks = Slices(entries).candidates(x, radius)
    for row, r, q in zip(masks, radius, x):
        got = {64 * w + b for w in range(3) for b in range(64) if int(row[w]) >> b & 1}
        assert got == {e for e in range(130) if (np.abs(entries[e] - q) <= r).all()}


def test_integers_are_exact():
    x = [0.0, -0.0001, 1.9999999, -5.5, 3e5, -1e30, 1e300, 2.0 ** 60 + 4096.0, 5e-324]
    got = integers(np.array(x), 4096).tolist()
    from fractions import Fraction
    assert got == [max(-10 ** 25, min(10 ** 25, math.floor(Fraction(v) * 4096))) for v in x]


def plain(rows, parts=8, entries=16, rounds=6):
    """rows: (id, vector, label) of one length that ``parts`` divides."""
    kept = [(i, [math.floor(4096 * x) for x in v], y) for i, v, y in rows]
    width = len(kept[0][1]) // parts
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[r[1][p * width:(p + 1) * width] for r in first] for p in range(parts)]

    def assign(v):
        out = []
        for p in range(parts):
            own = v[p * width:(p + 1) * width]
            out.append(min((sum((a - b) ** 2 for a, b in zip(own, e)), k) for k, e in enumerate(books[p])))
        return out
    for _ in range(rounds):
        members = defaultdict(list)
        for _, v, _ in kept:
            for p, (_, k) in enumerate(assign(v)):
                members[p, k].append(v[p * width:(p + 1) * width])
        for (p, k), m in members.items():
            books[p][k] = [sum(c) // len(m) for c in zip(*m)]
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    coded = [(i, "".join(f"{k:02x}" for _, k in assign(v)), sum(d for d, _ in assign(v)), y) for i, v, y in kept]
    total = defaultdict(int)
    for _, _, e, y in coded:
        total[y] += e
    return sorted(((i, c, e, total[y], sha) for i, c, e, y in coded), key=repr)


SCHEMA = "vec_id long, embedding array<double>, label int, code string, n int, error string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1, "clash") for r in rows], SCHEMA)


def run(spark, rows, **kw):
    out, books = compress_vectors(table(spark, rows), **kw)
    return sorted(map(tuple, out.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=repr), books


def test_awkward_rows(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=16).round(2).tolist(), i % 3 if i % 5 else None) for i in range(60)]
    rows += [(7, rows[7][1], 1), (7, rows[7][1], 1), (None, rows[3][1], None), (61, [0.0] * 16, 2)]
    bad = [(100, None, 1), (101, [float("nan")] + [0.0] * 15, 1), (102, [None] + [0.0] * 15, 1), (103, [float("inf")] + [0.0] * 15, None)]
    got, books = run(spark, rows + bad)
    assert got == plain(rows)
    assert len(books.decode(16, got[0][1])) == 16
    few, _ = run(spark, rows[:3])  # fewer vectors than entries
    assert few == plain(rows[:3]) and all(r[2] == 0 for r in few)
    assert run(spark, bad)[0] == [] and run(spark, [])[0] == []


def test_mixed_lengths_and_huge_components(spark):
    short = [(i, [float(i), 1.0, -2.0], 1) for i in range(5)]  # 8 parts don't divide 3
    empty = [(50, [], 1)]
    huge = [(60 + i, [1e200 * (-1) ** i, *[float(i)] * 7], 2) for i in range(4)]
    got, _ = run(spark, short + empty + huge, rounds=2)
    assert [r[0] for r in got] == [0, 1, 2, 3, 4, 50, 60, 61, 62, 63]
    by_id = {r[0]: r for r in got}
    assert by_id[50][1:3] == ("00" * 8, 0)
    assert all(by_id[i][2] == 0 for i in range(5))  # each is an entry of its own
    assert len({r[4] for r in got}) == 3
