"""Suffix dedup and its collection transform against sorting and counting."""
from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from moneta.llm import collection_bwt
from moneta.llm import suffix_dedup as sd
from moneta.llm.collection_bwt import build, repeated


def common(a: bytes, b: bytes) -> int:
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


@pytest.mark.parametrize("letters", [b"ab", b"abcdefgh", bytes(range(256)), b"a"])
def test_transform_equals_sorted_suffixes(letters):
    rng = random.Random(len(letters))
    for _ in range(60):
        strings = [bytes(rng.choices(letters, k=rng.randint(0, 14))) for _ in range(rng.randint(1, 9))]
        symbols, shared, owner, size = build(strings)
        want = sorted(((s[len(s) - k:], i) for i, s in enumerate(strings) for k in range(len(s) + 1)))
        assert [(strings[o][len(strings[o]) - n:], o) for o, n in zip(owner.tolist(), size.tolist())] == want
        assert shared.tolist() == [0] + [common(a[0], b[0]) for a, b in zip(want, want[1:])]
        number = {b: k for k, b in enumerate(sorted({b for s in strings for b in s}), 1)}
        before = [number[strings[o][-n - 1]] if n < len(strings[o]) else 0 for o, n in zip(owner.tolist(), size.tolist())]
        assert symbols.tolist() == before


def test_repeated_substrings_with_weights():
    rng = random.Random(7)
    for _ in range(100):
        strings = list({bytes(rng.choices(b"ab", k=rng.randint(0, 20))) for _ in range(5)})
        weights = [rng.randint(1, 3) for _ in strings]
        count: Counter = Counter()
        for s, w in zip(strings, weights):
            for i in range(len(s) - 3):
                count[s[i:i + 4]] += w
        got = repeated(strings, weights, 4)
        assert [g.tolist() for g in got] == [[i for i in range(len(s) - 3) if count[s[i:i + 4]] > 1] for s in strings]


@pytest.mark.parametrize("width", [2, 3, 5, 8])
def test_wide_symbols_equal_sorted_suffixes(width):
    rng = random.Random(width)
    for letters in (b"ab", b"abcdefgh", bytes(range(256)), b"a", b"\0\xff"):
        for _ in range(20):
            strings = [bytes(rng.choices(letters, k=rng.randint(0, 40))) for _ in range(rng.randint(1, 7))]
            parts = [s[o:] for s in strings for o in range(width)]
            parts = [p[:len(p) // width * width] for p in parts]
            symbols, shared, owner, size = build(strings, width)
            want = sorted(((p[len(p) - k * width:], i) for i, p in enumerate(parts) for k in range(len(p) // width + 1)))
            assert [(parts[o][len(parts[o]) - n * width:], o) for o, n in zip(owner.tolist(), size.tolist())] == want
            assert shared.tolist() == [0] + [common(a[0], b[0]) // width for a, b in zip(want, want[1:])]
            number = {g: k for k, g in enumerate(sorted({p[i:i + width] for p in parts for i in range(0, len(p), width)}), 1)}
            front = [len(parts[o]) - (n + 1) * width for o, n in zip(owner.tolist(), size.tolist())]
            assert symbols.tolist() == [number[parts[o][f:f + width]] if f >= 0 else 0 for o, f in zip(owner.tolist(), front)]


def counted(strings, weights, length):
    count: Counter = Counter()
    for s, w in zip(strings, weights):
        for i in range(len(s) - length + 1):
            count[s[i:i + length]] += w
    return [[i for i in range(len(s) - length + 1) if count[s[i:i + length]] > 1] for s in strings]


@pytest.mark.parametrize("length", [1, 2, 3, 5, 6, 7, 8, 9, 16, 20])
def test_repeated_substrings_of_any_length(length):
    rng = random.Random(length)
    for _ in range(40):
        strings = list({bytes(rng.choices(b"ab\0", k=rng.randint(0, length + 9))) for _ in range(4)})
        strings += [s[rng.randint(0, 3):] + b"b" for s in strings]
        weights = [rng.randint(1, 2) for _ in strings]
        assert [g.tolist() for g in repeated(strings, weights, length)] == counted(strings, weights, length)


def test_repeated_substrings_of_very_different_strings():
    rng = random.Random(3)
    strings = [rng.randbytes(300) for _ in range(250)]  # more than 65,535 different grams of eight and of four bytes
    strings += [s[rng.randint(1, 99):] for s in strings[:30]]
    got = [g.tolist() for g in repeated(strings, [1] * len(strings), 200)]
    assert got == counted(strings, [1] * len(strings), 200) and sum(map(len, got)) > 1000


def test_rounds_go_by_eight_bytes(monkeypatch):
    sorts = []
    sort = np.argsort
    monkeypatch.setattr(collection_bwt.np, "argsort", lambda *a, **k: sorts.append(len(a[0])) or sort(*a, **k))
    rng = random.Random(4)
    strings = [bytes(rng.choices(b"abcdefgh ", k=320)) for _ in range(20)]
    strings += [s[5:] for s in strings]
    assert [len(g) for g in repeated(strings, [1] * 40, 200)] == [116] * 40
    assert len(sorts) <= 45  # 320 / 8 rounds, not one for each byte


def plain(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    count = Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for (i, _), t in zip(rows, texts):
        gone = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if count[t[p:p + length]] > 1:
                gone[p:p + length] = b"\1" * length
        kept = bytes(b for b, g in zip(t, gone) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and not (k and gone[k - 1]))
        out.append((i, len(t), len(t) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def awkward(length):
    rng = random.Random(11)

    def noise(n):
        return "".join(rng.choices("abcdefghij klmnopé", k=n))

    hot, other = noise(3 * length), noise(2 * length)
    rows = [(i, noise(rng.randint(0, length)) + hot + noise(rng.randint(0, 3 * length))) for i in range(60)]  # a passage most rows share
    rows += [(100 + i, noise(length) + other[i:i + length + 3] + noise(5)) for i in range(0, length, 7)]
    edge = noise(length)
    rows += [(200, edge), (201, edge[1:] + "x"), (202, "y" + edge), (203, noise(10) + edge[:-1])]  # exactly one length; one byte short
    near = noise(8 * length)
    rows += [(210, near), (211, near[:3 * length] + "#" + near[3 * length + 1:]), (212, near.upper())]
    rows += [(220, "z" * (length + 1)), (221, "q" * length), (222, "ab" * 3 * length), (223, near[:length] + "--" + near[:length])]
    rows += [(230, "same text " * length), (231, "same text " * length), (232, "same text " * length), (232, "same text " * length)]
    rows += [(240, None), (241, ""), (None, noise(4 * length)), (None, hot + noise(30)), (250, noise(5)), (250, noise(3 * length) + other)]
    rows += [(260, noise(40_000) + hot[5:] + noise(9000))]
    return rows


@pytest.mark.parametrize("length,bucket,block", [(50, 2048, 1 << 20), (50, 1, 1 << 20), (20, 3, 997)])
def test_awkward_rows(spark, length, bucket, block, monkeypatch):
    monkeypatch.setattr(sd, "BLOCK", block)  # blocks end inside texts
    monkeypatch.setattr(sd, "CHUNK", 2000)
    rows = awkward(length)
    docs = spark.createDataFrame([(*r, "clash", 5, 6) for r in rows], "doc_id long, text string, spans string, s1 int, bucket int")
    got = sd.dedup_repeats(docs, length=length, bucket=bucket)
    full = got.collect()
    assert sorted([tuple(r[:5]) for r in full], key=repr) == plain(rows, length)
    for r in full:  # the spans are the removed runs
        assert sum(s["end"] - s["start"] for s in r["spans"] or []) == r["n_removed"]
        assert r["kept"] is None or hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"]
    assert sd.dedup_repeats(docs.limit(0), length=length).count() == 0
