"""Toxicity by a weighted finite-state pattern grammar.

A text's letters and marks become symbols: insult, threat, target, negation,
reported speech, the end of a clause, anything else.  Small transducers read them:

* negation rewrites an insult or threat shortly after it to its negated form;
* reported speech rewrites what follows it in the clause to a quoted form;
* the target transducer marks an insult or threat next to a target;
* the acceptor gives each clause the pattern that its strongest match has.

They are composed once, into one deterministic table of (state, symbol) -> (state,
pattern), which runs over the symbols of a clause in one pass.  A text's features are
the numbers of clauses of each pattern.  An insult or threat that is neither aimed,
negated nor quoted is the plain pattern of its clause, with a weight of its own, so a
clause with one insulting word does score; targets, negations and verbs of speech never
score without one.

Learned from a sample of labelled rows, bounded in rows and bytes: the insult lexicon
(words and word beginnings that few clean texts and many toxic ones have, by greedy
cover of the toxic texts), the weight of each pattern (damped logistic regression with
a prior that orders the patterns, at the labels' shares of all rows) and the cut, on
rows that the weights haven't seen.  The other word classes are fixed lists of a few
languages.

An automaton finds lexicon entries in whole texts; only clauses with one are read
word by word.

Defined results: null and empty text score like a text without matches; without
labelled rows of both kinds the fixed insult list and the prior weights hold;
identical texts score alike; an empty table gives an empty result; input columns
stay, but ``score``, ``predicted`` and ``held_out`` replace columns of that name.
"""
from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Container, Iterable
from dataclasses import dataclass
from itertools import product
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moneta.llm.common import label_sample, within_bytes

# --- FIXED VALUES: word classes ---
INSULTS = "idiot idiots moron morons stupid dumb loser losers scum trash worthless pathetic disgusting clown imbecile".split()
THREATS = "kill hurt destroy beat stab shoot burn strangle umbringen töten tuer frapper matar".split()
TARGETS = ("you your yours yourself he she they him her them these those tu vous toi ton votre du dich dein ihr sie euch tú usted "
           "ustedes vosotros").split()
NEGATIONS = "not never no isn't aren't wasn't don't doesn't didn't cannot without nicht kein keine nie pas jamais ne nunca".split()
REPORTED = ("said says say called calls wrote writes claimed claims quoted quote reported according told sagte schrieb nannte dit "
            "écrit appelé dijo escribió llamó").split()

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
#: Patterns of a clause, weakest first, with the prior weights that the fit starts from.
PATTERNS = ("quoted", "negated", "insult", "threat", "aimed_insult", "aimed_threat")
PRIOR, BIAS = np.array([0.6, 0.6, 4.0, 1.6, 1.0, 4.0]), -3.0
AIMED = PATTERNS.index("aimed_insult")
#: A negation reaches so many words; a target is so near.
REACH, NEAR = 3, 4
#: Labelled rows used and bytes of their texts; toxic texts that a lexicon entry needs and its purity.
SAMPLE, SAMPLE_BYTES, LEAST_TEXTS, PURITY = 8000, 1 << 27, 3, 0.9
#: Lengths of word beginnings that can be lexicon entries; samples of which one may have an entry by chance.
STARTS = range(3, 9)
CHANCE = 20
#: Where the cut is placed, a clean text above it counts as much as so many toxic ones below it (both as shares).
CARE = 3.0

_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
_CLAUSE = re.compile(r"[.!?;:\n|]+")


def negation(state: int, symbol: int) -> tuple[int, str]:
    """State: words that the negation still reaches."""
    if symbol == NEGATION:
        return REACH, ""
    return max(state - 1, 0), "negated" if state and symbol in (INSULT, THREAT) else ""


def reporting(state: int, symbol: int) -> tuple[int, str]:
    """State: 1 after a verb of speech, to the end of the clause."""
    return (1 if symbol == REPORT else state), "quoted" if state and symbol in (INSULT, THREAT) else ""


def aiming(state: int, symbol: int) -> tuple[int, str]:
    """State: 0; 1..NEAR: words since a target; beyond: kind and distance of an open match."""
    if symbol in (INSULT, THREAT):
        aimed = 0 < state <= NEAR
        return NEAR + (1 if symbol == INSULT else 1 + NEAR), ("aimed_" if aimed else "") + ("insult" if symbol == INSULT else "threat")
    if symbol == TARGET:
        return 1, ("aimed_insult" if NEAR < state <= 2 * NEAR else "aimed_threat" if state > 2 * NEAR else "")
    if not state or state in (NEAR, 2 * NEAR, 3 * NEAR):
        return 0, ""
    return state + 1, ""


def compose() -> tuple[np.ndarray, np.ndarray]:
    """The machine of all three: next state and emitted pattern (-1: none) by (state, symbol)."""
    sizes = (REACH + 1, 2, 3 * NEAR + 1)
    number = {s: i for i, s in enumerate(product(*map(range, sizes)))}
    to, out = np.zeros((len(number), 6), int), np.full((len(number), 6), -1)
    for (n, r, a), i in number.items():
        for symbol in range(6):
            (n2, neg), (r2, quo), (a2, aim) = negation(n, symbol), reporting(r, symbol), aiming(a, symbol)
            to[i, symbol] = number[n2, r2, a2]
            said = quo or neg or aim
            if said:
                out[i, symbol] = PATTERNS.index(said)
    return to, out


TO, OUT = compose()
_FIXED = {w: k for k, words in ((TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTED), (THREAT, THREATS)) for w in words}


def clause_pattern(symbols: list[int]) -> int:
    """The strongest pattern of a clause, -1 if none; a negated or quoted match stands for the
    clause unless another match in it isn't one."""
    state, best = 0, -1
    for s in symbols:
        best = max(best, int(OUT[state, s]))
        state = TO[state, s]
    return best


def strength(counts: np.ndarray) -> np.ndarray:
    """0 for none, 1 for one clause, growing with the logarithm of more."""
    return np.where(counts > 0, 1 + np.log(np.maximum(counts, 1)), 0.0)


@dataclass
class Grammar:
    words: frozenset
    starts: frozenset
    weights: np.ndarray
    bias: float

    def __post_init__(self):
        import ahocorasick
        self.finder = ahocorasick.Automaton()
        for w in self.words | set(THREATS):
            self.finder.add_word(w, (len(w), True))
        for w in self.starts - self.words - set(THREATS):
            self.finder.add_word(w, (len(w), False))
        self.finder.make_automaton()
        self.lengths = sorted({len(w) for w in self.starts})

    def symbol(self, word: str) -> int:
        if word in self.words or any(word[:n] in self.starts for n in self.lengths if len(word) >= n):
            return INSULT
        return _FIXED.get(word, OTHER)

    def features(self, text: str | None) -> np.ndarray:
        counts = np.zeros(len(PATTERNS))
        if not text:
            return counts
        low = text.lower()
        done = 0
        for end, (size, whole) in self.finder.iter(low):
            at = end - size + 1
            if at < done or at and low[at - 1].isalpha() or whole and end + 1 < len(low) and low[end + 1].isalpha():
                continue
            edges = [low.rfind(c, done, at) for c in ".!?;:\n|"]
            start = max(done, max(edges) + 1)
            close = _CLAUSE.search(low, end + 1)
            done = close.end() if close else len(low)
            kind = clause_pattern([self.symbol(m[0]) for m in _WORD.finditer(low, start, close.start() if close else len(low))])
            if kind >= 0:
                counts[kind] += 1
                if kind >= AIMED:  # an aimed match is a plain one too; its own weight comes on top
                    counts[kind - 2] += 1
        return counts

    def score(self, text: str | None) -> float:
        z = float(strength(self.features(text)) @ self.weights + self.bias)
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def _evidence_words(text: str | None) -> set[str]:
    """A text's words that aren't in the fixed insult list."""
    return {w for w in _WORD.findall((text or "").lower()) if len(w) <= 40}.difference(INSULTS)


def _print(text: str | None) -> int:
    """The smallest hash of three consecutive words: near copies mostly share it."""
    words = (text or "").lower().split()
    return min((crc32(" ".join(words[i:i + 3]).encode("utf-8", "surrogatepass")) for i in range(max(1, len(words) - 2))), default=0)


def _entries(words: Iterable[str], known: Container[str] | None = None) -> set[str]:
    """What a text's words can be found by: themselves and their beginnings (with a star), if ``known``."""
    out = set()
    for w in words:
        for e in (w, *(w[:n] + "*" for n in STARTS if len(w) >= n)):
            if known is None or e in known:
                out.add(e)
    return out


def _frequent(texts: list[str], least: int) -> Counter:
    """Entries that ``least`` of the texts (words joined by spaces) have, and how many do.  Level by level:
    a longer beginning is only counted if the shorter one is frequent, so memory holds few others."""
    found: Counter = Counter()
    stem = None
    for n in STARTS:
        level: Counter = Counter()
        for t in texts:
            level.update({w[:n] for w in t.split() if len(w) >= n and (stem is None or w[:n - 1] in stem)})
        stem = {e for e, c in level.items() if c >= least}
        found.update({e + "*": level[e] for e in stem})
    whole: Counter = Counter()
    for t in texts:
        whole.update({w for w in t.split() if len(w) < STARTS[0] or w[:STARTS[-1]] + "*" in found})
    found.update({w: c for w, c in whole.items() if c >= least})
    return found


def learn_lexicon(texts: list[str], labels: list[int]) -> tuple[frozenset, frozenset]:
    """Words and word beginnings of toxic texts: a greedy cover by entries of high purity.

    An entry's evidence is the log-likelihood ratio of its two counts against equal rates; it must
    outweigh the number of entries that were tried (one in CHANCE samples has an entry by chance), so
    what suffices doesn't follow the sample's size.
    """
    different = {(_print(t), v): i for i, (t, v) in enumerate(zip(texts, labels))}  # copies are no evidence of their own
    toxic = [" ".join(_evidence_words(texts[i])) for (_, v), i in different.items() if v]
    bad = _frequent(toxic, LEAST_TEXTS)
    good: Counter = Counter()
    for (_, v), i in different.items():
        if not v:
            good.update(_entries(_evidence_words(texts[i]), bad))
    n_bad, n_good = max(1, len(toxic)), max(1, len(different) - len(toxic))
    enough = math.log(CHANCE * max(1, len(bad)))

    def evidence(s: int, g: int) -> float:
        n = s + g
        return s * math.log(s * (n_bad + n_good) / (n * n_bad)) + (g * math.log(g * (n_bad + n_good) / (n * n_good)) if g else 0.0)

    # clean texts count at the rate of toxic ones, so the purity doesn't follow their number
    pure: dict[str, set[int]] = {w: set() for w, s in bad.items() if s / (s + n_bad / n_good * good[w]) >= PURITY and evidence(s, good[w]) >= enough}
    for i, t in enumerate(toxic):
        for w in _entries(t.split(), pure):
            pure[w].add(i)
    chosen: list[str] = []
    covered: Counter = Counter()
    for w in sorted(pure, key=lambda w: (-len(pure[w]), w.endswith("*"), len(w), w)):
        if any(w.rstrip("*").startswith(c[:-1]) for c in chosen if c.endswith("*")):
            continue
        if w.endswith("*"):  # the longest beginning that says as much
            longer = [x for x in pure if x.startswith(w[:-1]) and x.endswith("*") and len(pure[x]) >= PURITY * len(pure[w])]
            w = max(longer, key=lambda x: (len(x), x))
        gain = sum(1 for i in pure[w] if covered[i] < 3)
        if gain >= LEAST_TEXTS and gain >= len(pure[w]) / 4:
            chosen.append(w)
            covered.update(pure[w])
    return frozenset(w for w in chosen if not w.endswith("*")), frozenset(w[:-1] for w in chosen if w.endswith("*"))


def fit_weights(x: np.ndarray, y: np.ndarray, much: np.ndarray, centre: np.ndarray, ridge: np.ndarray,
                trace: list[float] | None = None) -> np.ndarray:
    """Logistic regression with a normal prior: weights of x's columns, none but the last (the bias) negative.

    Newton's method; a step is halved until the objective falls, so rows that the patterns
    separate can't make it diverge.  ``trace`` gets the objective after each step.
    """
    def objective(w):
        z = x @ w
        return float(much @ (np.logaddexp(0.0, z) - y * z) + 0.5 * ridge @ (w - centre) ** 2)

    held = np.zeros(len(centre), bool)  # weights held at 0, as they would be negative
    while True:
        w = np.where(held, 0.0, centre)
        now = objective(w)
        for _ in range(200):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
            slope = x.T @ (much * (p - y)) + ridge * (w - centre)
            bend = (x * (much * p * (1 - p))[:, None]).T @ x + np.diag(ridge)
            step = np.zeros(len(w))
            step[~held] = np.linalg.solve(bend[np.ix_(~held, ~held)], slope[~held])
            fall = float(slope @ step)
            if fall < 1e-9 * (1 + abs(now)):
                break
            size = 1.0
            while size > 1e-12 and (then := objective(w - size * step)) > now - 1e-4 * size * fall:
                size /= 2
            if size <= 1e-12:
                break  # no smaller value can be told apart
            w, now = w - size * step, then
            if trace is not None:
                trace.append(now)
        else:
            raise ArithmeticError("the pattern weights did not converge")
        worse = (w < 0) & ~held
        worse[-1] = False
        if not worse.any():
            return w
        held |= worse


def best_cut(z: np.ndarray, y: np.ndarray, care: float) -> float:
    """The log-odds at which to tell the labels apart: where the share of toxic rows at or above it less
    ``care`` times that of clean ones is largest; of equally good ones the nearest to 0."""
    bad, good = np.sort(z[y == 1]), np.sort(z[y == 0])
    if not len(bad) or not len(good):
        return 0.0
    at = np.unique(z)
    cuts = np.concatenate(([0.0, at[0] - 1.0], (at[:-1] + at[1:]) / 2, [at[-1] + 1.0]))
    gain = (1 - np.searchsorted(bad, cuts) / len(bad)) - care * (1 - np.searchsorted(good, cuts) / len(good))
    near = cuts[gain >= gain.max() - 1e-12]
    return float(near[np.argmin(np.abs(near))])


def learn(texts: list[str], labels: list[int], rate: float | None = None) -> Grammar:
    """``rate``: the share of toxic rows where the texts come from; else that of the texts.
    The lexicon and the weights come from four fifths of the texts; the others place the cut."""
    part = np.array([crc32((t or "").encode("utf-8", "surrogatepass")) % 5 for t in texts], int)
    y = np.array(labels, float)
    own = part != 0
    for fold in (own, ~own):
        if not 0 < y[fold].sum() < fold.sum():
            own = np.ones(len(y), bool)  # too few rows to spare any
    words, starts = learn_lexicon([t for t, k in zip(texts, own) if k], [v for v, k in zip(labels, own) if k])
    grammar = Grammar(words | set(INSULTS), starts, PRIOR, BIAS)
    if 0 < y.sum() < len(y):
        x = strength(np.array([grammar.features(t) for t in texts]))
        x = np.hstack([x, np.ones((len(x), 1))])
        share = y[own].mean()
        much = np.ones(len(y)) if rate is None else np.where(y == 1, rate / share, (1 - rate) / (1 - share))
        much /= much.min() or 1.0  # as if all rows were there, so rare toxic ones keep their weight against the prior
        w = fit_weights(x[own], y[own], much[own], np.append(PRIOR, BIAS), np.append(np.full(len(PRIOR), 2.0), 1.0))
        rest = ~own if not own.all() else own
        grammar.weights, grammar.bias = w[:-1], float(w[-1]) - best_cut(x[rest] @ w, y[rest], CARE)
    return grammar


def in_fold(of: int, remainder: int):
    return F.crc32(F.col("doc_id").cast("string")) % of == remainder


def score_toxicity(docs: DataFrame, labels: DataFrame, fold: int = 5, held: int = 0, sample: int = SAMPLE,
                   sample_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """``docs`` plus held_out, score and predicted.  Labels are learned from at most ``sample``
    labelled rows, by hash of doc_id within each value of toxic, whose crc32(doc_id) % fold isn't
    ``held``, and half of ``sample_bytes`` bytes of text of each value; the weights are fitted at
    the values' shares of all such rows."""
    known = labels.where("toxic is not null and doc_id is not null").where(~in_fold(fold, held)).select(
        "doc_id", F.col("toxic").cast("int").alias("toxic"))
    known, counts = label_sample(known, sample, "toxic", "doc_id")
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("doc_id", "text", "toxic")
    rows = within_bytes(rows.withColumn("toxic", (F.col("toxic") == 1).cast("int")), sample_bytes // 2, "toxic", "doc_id")
    rows = rows.toPandas().sort_values(["doc_id", "toxic"], ignore_index=True)
    grammar = learn(list(rows["text"]), [int(t == 1) for t in rows["toxic"]], counts.get(1, 0) / max(1, sum(counts.values())))
    parts = (grammar.words, grammar.starts, grammar.weights, grammar.bias)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        own = Grammar(*parts)
        return texts.map(own.score, na_action=None).astype("float64")

    out = docs.withColumn("held_out", F.coalesce(in_fold(fold, held), F.lit(False))).withColumn("score", score("text"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
