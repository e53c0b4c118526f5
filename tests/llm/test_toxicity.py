"""The toxicity grammar and its fit against plain versions."""
from __future__ import annotations

import random
import re

import numpy as np
import pytest

from moneta.llm import toxicity as tox

PLAIN = [f"word{i}" for i in range(400)]


def texts(n: int, toxic: bool, rng: random.Random) -> list[str]:
    out = []
    for _ in range(n):
        t = rng.choices(PLAIN, k=20)
        if toxic:
            for _ in range(rng.randint(1, 4)):
                t.insert(rng.randrange(len(t)), rng.choice(["moron", "scum", "grobnik" + rng.choice("abcdef"), "clown"]))
        elif rng.random() < 0.01:
            t[3:3] = ["not", "a", "clown"]
        out.append(" ".join(t) + ".")
    return out


@pytest.mark.parametrize("share", [0.3, 0.1, 0.01, 0.001])
def test_fit_converges_at_every_share(share):
    rng = random.Random(int(share * 1000))
    t = texts(2000, True, rng) + texts(2000, False, rng)
    y = [1] * 2000 + [0] * 2000
    grammar = tox.learn(t, y, share)
    assert "grobnik" in grammar.starts
    assert abs(grammar.bias) < 100 and (grammar.weights >= 0).all()
    bad = np.mean([grammar.score(x) >= 0.5 for x in texts(500, True, rng)])
    good = np.mean([grammar.score(x) < 0.5 for x in texts(500, False, rng)])
    assert bad >= 0.97 and good >= 0.97


@pytest.mark.parametrize("share", [0.3, 0.1, 0.01, 0.001])
def test_objective_falls_on_separable_rows(share):
    rng = np.random.default_rng(3)
    y = np.repeat([1.0, 0.0], 4000)
    x = np.zeros((8000, 7))
    x[:4000, 2] = rng.integers(1, 6, 4000)  # the patterns separate the labels
    x[:, 6] = 1
    much = np.where(y == 1, share, 1 - share) / min(share, 1 - share)
    ridge, centre = np.append(np.full(6, 2.0), 1.0), np.append(tox.PRIOR, tox.BIAS)
    trace: list[float] = []
    w = tox.fit_weights(x, y, much, centre, ridge, trace)
    assert len(trace) > 1 and all(b <= a for a, b in zip(trace, trace[1:]))
    z = x @ w
    assert (z[:4000] > z[4000:].max()).all()
    # a stationary point: no small move of a free weight lowers the objective

    def objective(v):
        return much @ (np.logaddexp(0, x @ v) - y * (x @ v)) + 0.5 * ridge @ (v - centre) ** 2
    for k in range(7):
        for by in (-1e-3, 1e-3):
            v = w.copy()
            v[k] += by
            assert v[k] < 0 and k < 6 or objective(v) >= objective(w) - 1e-9 * abs(objective(w))


def test_cut_by_trying_all():
    rng = np.random.default_rng(5)
    for _ in range(50):
        y = rng.integers(0, 2, 30).astype(float)
        z = np.round(rng.normal(size=30) + y, 1)
        cut = tox.best_cut(z, y, 3.0)
        if 0 < y.sum() < 30:
            gain = lambda c: (z[y == 1] >= c).mean() - 3.0 * (z[y == 0] >= c).mean()
            assert gain(cut) == pytest.approx(max(gain(c) for c in [*(z - 0.01), z.max() + 1]))


def plain_pattern(words: list[str], insults: set[str]) -> int:
    """A clause read without an automaton: what each insult or threat means, the strongest first."""
    kinds = ["insult" if w in insults else "threat" if w in tox.THREATS else "target" if w in tox.TARGETS else "negation"
             if w in tox.NEGATIONS else "report" if w in tox.REPORTED else "" for w in words]
    best = -1
    for i, k in enumerate(kinds):
        if k in ("insult", "threat"):
            quoted = "report" in kinds[:i]
            negated = "negation" in kinds[max(0, i - tox.REACH):i]
            before, after = i, i
            while before and i - before < tox.NEAR and kinds[before - 1] not in ("insult", "threat", "target"):
                before -= 1
            while after + 1 < len(kinds) and after - i < tox.NEAR and kinds[after + 1] not in ("insult", "threat", "target"):
                after += 1
            left = before and kinds[before - 1] == "target" and i - (before - 1) <= tox.NEAR
            right = after + 1 < len(kinds) and kinds[after + 1] == "target" and after + 1 - i <= tox.NEAR
            if quoted or negated:
                said = "quoted" if quoted else "negated"
                best = max(best, tox.PATTERNS.index(said))
                if right:
                    best = max(best, tox.PATTERNS.index("quoted" if quoted else "aimed_" + k))
            else:
                best = max(best, tox.PATTERNS.index(("aimed_" if left or right else "") + k))
    return best


def test_automaton_reads_like_the_rules():
    """Every clause of up to six symbols, each as one word, that the plain reading settles without a target after."""
    grammar = tox.Grammar(frozenset({"moron"}), frozenset(), tox.PRIOR, tox.BIAS)
    word = {"i": "moron", "t": "kill", "y": "you", "n": "not", "r": "said", "o": "tree"}
    rng = random.Random(1)
    for _ in range(3000):
        code = "".join(rng.choices("ityynnroooo", k=rng.randint(1, 9)))
        if re.search("[it].*y", code):
            continue  # a target after the match is read by the distance to the last one only
        words = [word[c] for c in code]
        assert tox.clause_pattern([grammar.symbol(w) for w in words]) == plain_pattern(words, {"moron"}), words


def test_null_labels_and_long_text(spark):
    rng = random.Random(9)
    rows = [(i, t, y) for i, (t, y) in enumerate([(t, 1) for t in texts(60, True, rng)] + [(t, 0) for t in texts(200, False, rng)])]
    rows += [(1000, None, 1), (1001, "", 0), (1002, "moron you. " * 20_000, None), (None, "a clown", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    out = {r["doc_id"]: r for r in tox.score_toxicity(df.select("doc_id", "text"), df.select("doc_id", "toxic")).collect()}
    assert len(out) == len(rows) and out[1002]["predicted"] == 1 and out[1001]["predicted"] == 0
    assert out[1000]["score"] == out[1001]["score"]


def test_sample_is_bounded_in_bytes(spark):
    from moneta.llm.common import within_bytes
    df = spark.createDataFrame([(i, "x" * 100, i % 2) for i in range(50)], "doc_id long, text string, toxic int")
    got = within_bytes(df, 1000, "toxic", "doc_id").groupBy("toxic").count().collect()
    assert {r["toxic"]: r["count"] for r in got} == {0: 10, 1: 10}
    assert within_bytes(df, 1, "toxic", "doc_id").count() == 2  # one text of each label
