"""Language identification of code-switched text by a linear-chain conditional random field.

Each word of a line is a position of a chain, its label a language.  Features of a word:
its beginnings and endings (affixes of 1 to 4 bytes), the n-grams of its bytes (2 and 3,
with edges) and the word itself as a lexicon entry, all hashed into tables of fixed size.
Transitions between the labels of neighbouring words are learned too.  Forward-backward
gives each word's posterior; a text's language is the one with the largest mean posterior,
which is the score.

Training maximises the conditional likelihood on a bounded sample of labelled rows, taken by label; a
labelled text gives its language to all its words, and words of a wrong label (quotations,
switches) are outvoted by the other texts.  Chains are lines, cut after 64 words; all
chains of a batch run together, one vector step per position.

Features are computed from byte arrays, so no Python loop runs over words.

Defined results: null text, or text without a letter, is ``und`` with score 0; a label that
is null isn't learned; with no labelled row in the learning folds everything is ``und``;
identical texts get the same answer; an empty table gives an empty result; input columns
stay, but ``held_out``, ``lang_pred`` and ``score`` replace columns of that name.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moneta.llm.common import label_sample
from moneta.llm.wordhash import mix, stream

#: Labelled rows used; words of a chain; bytes scored at once; table entries of a feature family, as a power of 2.
SAMPLE, CHAIN, BLOCK, BITS = 2000, 64, 800_000, 16
FAMILIES = ("two", "three", "begin1", "begin2", "begin3", "begin4", "end1", "end2", "end3", "end4", "word")

_u = np.uint64
_KEY = stream(21, 256)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
# letters of ASCII and every byte of a longer code point; digits, signs and spaces end a word
_IN_WORD = np.zeros(256, bool)
_IN_WORD[list(range(97, 123)) + list(range(128, 256))] = True
_NEWLINE = 10


def _slot(x: np.ndarray) -> np.ndarray:
    return (mix(x) >> _u(64 - BITS)).astype(np.int32)


class Words:
    """The words of some texts with their feature slots."""

    def __init__(self, data: bytes, starts: np.ndarray):
        """data: UTF-8 texts one after another, each ended by a newline; starts: where each begins."""
        a = _LOWER[np.frombuffer(data, np.uint8)]
        inside = _IN_WORD[a]
        edge = np.diff(np.concatenate(([0], inside.view(np.int8), [0])))
        self.first, self.end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.text = np.searchsorted(starts, self.first, side="right") - 1
        self.n = len(self.first)
        lines = np.cumsum(a == _NEWLINE)
        line = lines[self.first] if self.n else np.empty(0, int)
        # chains: a new one at each line, and after CHAIN words
        new = np.concatenate(([True], line[1:] != line[:-1])) if self.n else np.empty(0, bool)
        at = np.arange(self.n) - np.maximum.accumulate(np.where(new, np.arange(self.n), 0)) if self.n else np.empty(0, int)
        self.step = at % CHAIN
        self.chain = np.cumsum(self.step == 0) - 1
        key = np.where(inside, _KEY[a], _u(7))  # any byte outside words is one edge mark
        pad = np.concatenate((key, np.full(4, 7, np.uint64)))
        nxt = pad[1:len(key) + 1]
        before = np.concatenate(([_u(7)], key[:-1])) if len(key) else key
        self.grams = (_slot(key * _u(3) + nxt * _u(5)), _slot(before * _u(11) + key * _u(13) + nxt * _u(17)))
        size = self.end - self.first
        self.affixes = []
        for sign, seed in ((1, 31), (-1, 37)):
            h = np.full(self.n, seed, np.uint64)
            for k in range(4):
                at = self.first + k if sign > 0 else self.end - 1 - k
                h = h * _u(0x100000001B3) + np.where(k < size, pad[np.maximum(at, 0)] if self.n else h, _u(7))
                self.affixes.append(_slot(h + _u(k)))
        self.word = _slot(self._whole(key, inside))

    def _whole(self, key: np.ndarray, inside: np.ndarray) -> np.ndarray:
        if not self.n:
            return np.empty(0, np.uint64)
        offset = np.zeros(len(key), np.int64)
        offset[self.first] = self.first
        offset = np.arange(len(key)) - np.maximum.accumulate(offset)
        return np.add.reduceat(np.where(inside, mix(key + offset.astype(np.uint64) * _u(0x9E3779B97F4A7C15)), _u(0)), self.first)

    def scores(self, tables: dict[str, np.ndarray]) -> np.ndarray:
        """Emission scores (words x labels)."""
        out = tables["word"][self.word]
        for name, slots in zip(FAMILIES[2:10], self.affixes):
            out = out + tables[name][slots]
        if self.n:
            # the n-grams of a word: sums over its bytes, as differences of running sums
            run = np.zeros((len(self.grams[0]) + 1, out.shape[1]))
            np.cumsum(tables["two"][self.grams[0]] + tables["three"][self.grams[1]], axis=0, out=run[1:])
            out = out + (run[self.end] - run[self.first]) / np.sqrt(self.end - self.first)[:, None]
        return out

    def gradient(self, d: np.ndarray) -> dict[str, np.ndarray]:
        """Sums of d (words x labels) by feature slot."""
        size, labels = 1 << BITS, d.shape[1]

        def add(slots, rows):
            return np.stack([np.bincount(slots, rows[:, i], size) for i in range(labels)], axis=1)

        out = {"word": add(self.word, d)} | {name: add(s, d) for name, s in zip(FAMILIES[2:10], self.affixes)}
        sizes = self.end - self.first
        inside = np.repeat(self.first - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(sizes.sum())
        each = np.repeat(d / np.sqrt(sizes)[:, None], sizes, axis=0)
        return out | {"two": add(self.grams[0][inside], each), "three": add(self.grams[1][inside], each)}


def forward_backward(words: Words, emit: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Posterior of each word (words x labels), expected moves, log-likelihood of all label
    sequences (the partition function)."""
    n, labels = emit.shape
    if not n:
        return emit, np.zeros_like(moves), 0.0
    heads = np.flatnonzero(words.step == 0)
    sizes = np.diff(np.append(heads, n))
    order = np.argsort(-sizes, kind="stable")
    heads, sizes = heads[order], sizes[order]
    peak = emit.max(axis=1, keepdims=True)
    e, m = np.exp(emit - peak), np.exp(moves)
    alpha, norm = np.empty_like(e), np.empty(n)
    a = None
    alive = [int(np.searchsorted(-sizes, -t, side="left")) for t in range(int(sizes[0]))]  # chains longer than t
    for t, k in enumerate(alive):
        at = heads[:k] + t
        a = (e[at] if t == 0 else (a[:k] @ m) * e[at])
        norm[at] = a.sum(axis=1)
        a = a / norm[at][:, None]
        alpha[at] = a
    post, moved = np.empty_like(e), np.zeros_like(moves)
    b = np.empty((0, labels))
    for t in range(len(alive) - 1, -1, -1):
        k = alive[t]
        at = heads[:k] + t
        if t + 1 < len(alive):
            nxt = heads[:alive[t + 1]] + t + 1
            right = e[nxt] * b / norm[nxt][:, None]
            moved += m * (alpha[at[:len(nxt)]].T @ right)
            b = np.concatenate((right @ m.T, np.ones((k - len(nxt), labels))))
        else:
            b = np.ones((k, labels))
        post[at] = alpha[at] * b
    return post, moved, float(np.log(norm).sum() + peak.sum())


def blocks(texts: list, size: int = BLOCK):
    """(indices, Words) of texts put together up to ``size`` bytes; a longer text is cut between
    words, and its index comes with each of its parts."""
    data, starts, index, total = [], [], [], 0
    for i, text in enumerate(texts):
        raw = (text or "").encode("utf-8", "replace")
        at = 0
        while at < len(raw) or not at:
            end = len(raw)
            if end - at > size:
                end = max(raw.rfind(b" ", at, at + size), raw.rfind(b"\n", at, at + size))
                end = end if end > at else at + size
            part = raw[at:end] + b"\n"
            at = max(end, 1)
            if total and total + len(part) > size:
                yield index, Words(b"".join(data), np.array(starts))
                data, starts, index, total = [], [], [], 0
            data.append(part)
            starts.append(total)
            index.append(i)
            total += len(part)
    if data:
        yield index, Words(b"".join(data), np.array(starts))


def train(texts: list[str], langs: list[str], names: list[str], rounds: int = 8, rate: float = 0.4) -> tuple[dict, np.ndarray]:
    """Tables and moves by AdaGrad on the likelihood, block by block."""
    y = np.array([names.index(x) for x in langs])
    size = (1 << BITS, len(names))
    tables = {f: np.zeros(size) for f in FAMILIES}
    moves = np.zeros((len(names), len(names)))
    seen = {f: np.full(size, 1e-2) for f in FAMILIES}
    moved_seen = np.full_like(moves, 1.0)
    parts = list(blocks(texts))
    for _ in range(rounds):
        for index, words in parts:
            if not words.n:
                continue
            label = y[np.array(index)][words.text]
            post, moved, _ = forward_backward(words, words.scores(tables), moves)
            truth = np.zeros_like(post)
            truth[np.arange(words.n), label] = 1
            inner = words.step[1:] > 0
            was = np.zeros_like(moves)
            np.add.at(was, (label[:-1][inner], label[1:][inner]), 1)
            for f, g in words.gradient((truth - post) / 100).items():
                g = g - 1e-4 * tables[f]
                seen[f] += g * g
                tables[f] += rate * g / np.sqrt(seen[f])
            g = (was - moved) / 100 - 1e-2 * moves
            moved_seen += g * g
            moves += rate * g / np.sqrt(moved_seen)
    # labelled texts are of one language: without a bound the moves would forbid switches
    return {f: t.astype(np.float32) for f, t in tables.items()}, np.clip(moves, -2.0, 2.0)


def predict(texts: list, tables: dict, moves: np.ndarray, names: list[str]) -> tuple[list[str], list[float]]:
    lang, score = ["und"] * len(texts), [0.0] * len(texts)
    total, mass = np.zeros((len(texts), len(names))), np.zeros(len(texts))
    for index, words in blocks(texts):
        if words.n and names:
            post, _, _ = forward_backward(words, words.scores(tables).astype(np.float64), moves)
            # a word counts with the square root of its length
            weight, own = np.sqrt(words.end - words.first), np.array(index)[words.text]
            for j in range(len(names)):
                total[:, j] += np.bincount(own, post[:, j] * weight, len(texts))
            mass += np.bincount(own, weight, len(texts))
    for i, text in enumerate(texts):
        if mass[i] and any(map(str.isalpha, text)):
            best = int(total[i].argmax())
            lang[i], score[i] = names[best], float(min(1.0, max(0.0, total[i, best] / mass[i])))
    return lang, score


def in_fold(of: int, remainder: int):
    return F.crc32(F.col("doc_id").cast("string")) % of == remainder


def identify(docs: DataFrame, fold: int = 4, held: int = 2, sample: int = SAMPLE) -> DataFrame:
    """``docs`` plus held_out, lang_pred and score.  Learns from at most ``sample`` rows, by hash
    of doc_id within each language, whose lang isn't null and whose crc32(doc_id) % fold isn't
    ``held``; the languages are those of all such rows."""
    known = docs.where("lang is not null and doc_id is not null").where(~in_fold(fold, held))
    rows, counts = label_sample(known.select("doc_id", "text", "lang"), sample, "lang", "doc_id")
    rows, names = rows.toPandas().sort_values(["doc_id", "lang"], ignore_index=True), sorted(counts)
    rows = rows.sample(frac=1, random_state=7)  # languages in turn
    tables, moves = train(list(rows["text"]), list(rows["lang"]), names) if names else ({}, np.zeros((0, 0)))
    model = docs.sparkSession.sparkContext.broadcast((tables, moves, names))  # a fixed number of table entries by label

    @F.pandas_udf("lang_pred string, score double")
    def answer(texts: pd.Series) -> pd.DataFrame:
        lang, score = predict(list(texts), *model.value)
        return pd.DataFrame({"lang_pred": lang, "score": score})

    out = docs.withColumn("held_out", F.coalesce(in_fold(fold, held), F.lit(False))).withColumn("_answer", answer("text"))
    return out.withColumns({"lang_pred": F.col("_answer.lang_pred"), "score": F.col("_answer.score")}).drop("_answer")
