"""The filter audit against plain sets."""
from __future__ import annotations

import random
import re
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from moneta.llm import filter_audit as fa


def plain_flags(t: str) -> set[str]:
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    out = set()
    if len(words) < 50:
        out.add("A")
    if 100 * len(set(words)) < 65 * len(words):
        out.add("B")
    if 100 * len(re.findall("[A-Z]", t)) > 5 * len(t):
        out.add("C")
    if re.search(r"[#$%&*|]", t):
        out.add("D")
    return out


def test_text_flags():
    rng = random.Random(3)
    for _ in range(500):
        t = " ".join("".join(rng.choices("abÄéZ#\x85 ", k=rng.randint(0, 3))) for _ in range(rng.choice([0, 3, 49, 50, 51, 90])))
        flags = fa.text_flags(t.encode())
        assert {"ABCD"[i] for i in range(4) if flags >> i & 1} == plain_flags(t)


def test_list_operations():
    rng = np.random.default_rng(2)
    for _ in range(200):
        a, b = (np.unique(rng.integers(0, 40, rng.integers(0, n))) for n in (30, 6))
        for x, y in ((a, b), (b, a)):
            assert fa.minus(x, y).tolist() == sorted(set(x.tolist()) - set(y.tolist()))
            assert fa.merged(x, fa.minus(y, x)).tolist() == sorted(set(x.tolist()) | set(y.tolist()))


def plain(rows, labels):
    parts = {}
    for i, t, s in rows:
        t = t or ""
        fails = plain_flags(t)
        if i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows):
            fails.add("E")
        good = any(d == i and q == 1 for d, q, _ in labels if d is not None)
        bad = any(d == i and x == 1 for d, _, x in labels if d is not None)
        parts.setdefault(s or "", []).append((fails, good, bad))
    out = []
    for part, docs in parts.items():
        found, total = [], dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = list(docs)
            for step, f in enumerate(order, 1):
                lost = [d for d in left if f in d[0]]
                left = [d for d in left if f not in d[0]]
                n = sum(f in d[0] for d in docs)
                total[f] += len(lost)
                found.append((part, "".join(order), step, len(left), len(lost), n - len(lost), sum(d[0] == {f} for d in docs),
                              sum(d[1] for d in lost), sum(d[2] for d in lost), f))
        out += [(*r[:-1], total[r[-1]]) for r in found]
    return sorted(out)


def awkward():
    rng = random.Random(5)
    rows = []
    for i in range(150):
        words = [rng.choice(["alpha", "beta", "GAMMA", "x|y", "Delta"]) if rng.random() < 0.3 else f"w{rng.randint(0, 99)}" for _ in range(rng.choice([5, 60, 80]))]
        rows.append((i, " ".join(words), rng.choice(["a", "b", "", None, "hot", "hot", "hot"])))
    rows += [(200 + i, rows[i][1], "hot") for i in range(0, 60, 2)]
    rows += [(5, rows[5][1], "a"), (None, rows[5][1], "a"), (None, None, None), (300, "", "a"), (301, None, "b"), (302, "word " * 30_000, "b")]
    labels = [(i, i % 2, int(i % 7 == 0)) for i in range(0, 230, 3)] + [(0, 1, 1), (3, None, None), (None, 1, 1), (9999, 1, 1)]
    return rows, labels


@pytest.mark.parametrize("bits,held", [(16, 4096), (2, 1)])
def test_awkward_rows(spark, bits, held, monkeypatch):
    monkeypatch.setattr(fa, "RANGE_BITS", bits)  # short id ranges
    rows, labels = awkward()
    docs = spark.createDataFrame([(*r, 1, "clash") for r in rows], "doc_id long, text string, source string, fails int, part string")
    said = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("row", F.lit("clash"))
    got = fa.audit_filters(docs, said)
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(map(tuple, got.collect())) == plain(rows, labels)


def test_empty_tables(spark):
    rows, labels = awkward()
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    said = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert fa.audit_filters(docs.limit(0), said).count() == 0
    assert {r["good_lost"] + r["toxic_lost"] for r in fa.audit_filters(docs, said.limit(0)).collect()} == {0}
