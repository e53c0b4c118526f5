"""Substring dedup by level-wise doubling.

A window is ``length`` consecutive words of one document.  It goes when its word
sequence also starts in a document with a smaller id.  Comparing every window at
once would shuffle one row per word of the corpus; instead windows are compared at
a short length first, and only those that repeat are extended to twice that.

* The lengths double from about 13 words up to ``length`` (13, 25, 50).
* At a length below the last, the sub-window with the smallest hash speaks for every full
  window that contains it: equal full windows have the same speaker, so a full
  window can only repeat if its speaker repeats.  A document sends its distinct speakers;
  those found in two different texts survive, and with them the windows that they speak for.
  Only these are looked at in the next length, until none survive.
* At the last length the full windows of the documents that are left are hashed (128 bits)
  and compared.  Longer windows need no level of their own, as the windows inside them
  cover them.

Texts with the same words are one class: their smallest id stands for all, the
others lose every word (if there is a window at all), and send nothing.

Hot groups: a passage that a third of all documents share is counted map-side
(smallest and largest id of each hash); the counts are written before they are joined, so
the other side stands in no aggregate's stage and AQE splits it; no group of documents
is ever collected.

Defined results: doc_id is cast to a long (other ids are an error); null or empty text has no words; a null doc_id keeps all its
words and takes none from others; identical rows are one document; of rows that
share a doc_id but not the text, each is judged on its own, against smaller ids
only; an empty table gives an empty result; only doc_id and text are read, so other
columns cannot clash.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moneta.llm.common import written
from moneta.llm.wordhash import grams, least, mix, pair, signed, word_hashes


def _data(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass") if text else b""


def _identity(words: np.ndarray) -> tuple[int, int]:
    """128-bit hash of a sequence of words: a sum over (position, word)."""
    at = mix(np.arange(1, len(words) + 1, dtype=np.uint64))
    a, b = mix(words * np.uint64(3) + at), mix(words ^ (at * np.uint64(5)))
    return tuple(int(signed(x.sum(dtype=np.uint64, keepdims=True))[0]) for x in (a, b))


def levels(length: int, first: int = 13) -> list[int]:
    """The window lengths to compare, each at most twice the one before."""
    out = [length]
    while out[-1] > first:
        out.append(-(-out[-1] // 2))
    return out[::-1]


def speakers(words: np.ndarray, length: int, level: int) -> np.ndarray:
    """For each full window the smallest hash of its windows of ``level`` words."""
    return least(grams(words, level), length - level + 1)


def _first(length: int):
    """Per row: identity, digest, and the runs of full windows with the same speakers at every level but the
    last (p0, p1, ...: each run's speaker)."""
    below = levels(length)[:-1]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for i, text in zip(batch["doc_id"], batch["text"]):
                data = _data(text)
                words = word_hashes(data)
                said = [speakers(words, length, n) for n in below]
                new = np.zeros(max(0, len(words) - length + 1), bool)
                for p in said:
                    new[1:] |= p[1:] != p[:-1]
                new[:1] = True
                rows.append((i, len(words), *_identity(words), hashlib.sha256(b" ".join(data.split())).hexdigest(),
                             *[signed(p[new]) for p in said]))
            yield pd.DataFrame(rows, columns=["doc_id", "n_words", "s1", "s2", "sha", *(f"p{k}" for k in range(len(below)))]).astype({"doc_id": "Int64"})
    return run


def _survivors(k: int, last: int):
    """The runs whose speaker at level k is alive, with their speakers at the levels above."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            left = [np.isin(np.asarray(p, np.int64), np.asarray(alive, np.int64)) for p, alive in zip(batch[f"p{k}"], batch["alive"])]
            out = batch[["doc_id", "s1", "s2"]].copy()
            for n in range(k + 1, last):
                out[f"p{n}"] = [np.asarray(p, np.int64)[keep] for p, keep in zip(batch[f"p{n}"], left)]
            yield out
    return run


def _second(length: int):
    half = levels(length)[-2]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i, s1, s2, text, alive in zip(batch["doc_id"], batch["s1"], batch["s2"], batch["text"], batch["alive"]):
                data = _data(text)
                words = word_hashes(data)
                if _identity(words) != (s1, s2):
                    continue  # another text under the same id
                at = np.flatnonzero(np.isin(signed(speakers(words, length, half)), np.asarray(alive, np.int64)))
                hashes = []
                for w in (words, word_hashes(data, 2)):
                    g = grams(w, half)
                    hashes.append(signed(pair(g, grams(w, length - half), half)[at]))
                yield pd.DataFrame({"doc_id": [i], "s1": [s1], "s2": [s2], "text": [text], "at": [at.astype(np.int32)],
                                    "a": [hashes[0]], "b": [hashes[1]]})
    return run


def _kept(length: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for i, s1, s2, text, at in zip(batch["doc_id"], batch["s1"], batch["s2"], batch["text"], batch["at"]):
                words = _data(text).split()
                edge = np.zeros(len(words) + 1, np.int64)
                at = np.asarray(at, np.int64)
                edge[at] += 1
                np.subtract.at(edge, np.minimum(at + length, len(words)), 1)
                gone = edge.cumsum()[:-1] > 0
                kept = b" ".join([w for w, g in zip(words, gone.tolist()) if not g])
                rows.append((i, s1, s2, int(gone.sum()), kept.decode("utf-8", "surrogatepass")))
            yield pd.DataFrame(rows, columns=["doc_id", "s1", "s2", "n_removed", "kept"])
    return run


def dedup_substrings(docs: DataFrame, length: int = 50) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept) per row of ``docs``; ``kept`` is the
    kept words joined by one space where words went, null where nothing went."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    below = len(levels(length)) - 1
    if below < 1:
        raise ValueError("windows of 14 words or more")
    ps = [f"p{k}" for k in range(below)]
    rows = docs.mapInPandas(_first(length), "doc_id long, n_words long, s1 long, s2 long, sha string" + "".join(f", {p} array<long>" for p in ps))
    rows = written(rows, "speakers")
    alone = rows.where("doc_id is not null").groupBy("s1", "s2").agg(F.min("doc_id").alias("head"))
    known = written(rows.select("doc_id", "n_words", "s1", "s2", "sha").join(alone, ["s1", "s2"], "left"), "heads")
    who = ["doc_id", "s1", "s2"]
    state = rows.join(alone, ["s1", "s2"]).where("doc_id = head").select(*who, *ps)
    for k in range(below):
        each = written(state.select(*who, F.explode(F.array_distinct(ps[k])).alias("speaker")), "speakers")
        repeated = written(each.groupBy("speaker").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("speaker"), "repeated")
        alive = each.join(repeated, "speaker").groupBy(*who).agg(F.collect_set("speaker").alias("alive"))
        if k + 1 < below:
            schema = "doc_id long, s1 long, s2 long" + "".join(f", {p} array<long>" for p in ps[k + 1:])
            state = written(state.join(alive, who).mapInPandas(_survivors(k, below), schema), "survivors")
            if not state.limit(1).count():  # nothing to extend
                alive = state.select(*who, F.col(ps[-1]).alias("alive"))
                break

    windows = docs.join(alive.hint("merge"), "doc_id").mapInPandas(
        _second(length), "doc_id long, s1 long, s2 long, text string, at array<int>, a array<long>, b array<long>")
    windows = written(windows, "windows")
    each = windows.select(*who, F.explode(F.arrays_zip("at", "a", "b")).alias("w")).select(*who, "w.at", "w.a", "w.b")
    first = each.groupBy("a", "b").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("a", "b", "lo")
    first = written(first, "first")
    hit = each.join(first, ["a", "b"]).where("doc_id > lo").groupBy(*who).agg(F.collect_set("at").alias("at"))
    texts = windows.select("doc_id", "s1", "s2", "text").dropDuplicates(["doc_id", "s1", "s2"])
    cut = texts.join(hit, ["doc_id", "s1", "s2"]).mapInPandas(
        _kept(length), "doc_id long, s1 long, s2 long, n_removed long, kept string")

    out = known.join(cut.withColumnRenamed("doc_id", "_id"), (F.col("doc_id") == F.col("_id")) & (known["s1"] == cut["s1"]) & (
        known["s2"] == cut["s2"]), "left")
    copy = (F.col("doc_id") > F.col("head")) & (F.col("n_words") >= length)
    out = out.withColumn("kept", F.when(copy, F.lit("")).otherwise(F.col("kept")))
    return out.select(
        "doc_id", "n_words", F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.coalesce(F.sha2("kept", 256), "sha").alias("kept_sha256"), "kept")
