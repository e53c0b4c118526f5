"""Benchmark decontamination by winnowing.

A text becomes a sequence of word hashes.  Every k-gram of words has a hash, and
every window of ``w = length - k + 1`` consecutive k-grams (that is, ``length``
words) keeps its minimum.  Two equal windows have equal minima, so every shared
span of at least ``length`` words shares a fingerprint: the join of the distinct
fingerprints of documents and items misses none.  Documents with a shared
fingerprint are then extended: all their windows are compared with the items'
windows by a 128-bit hash, and the hit windows are merged into covered words.

An item with fewer words than ``length`` is one window of its own size n; for the
few sizes that occur (fewer than ``length``), windows of n words are their own
fingerprints.

Built-in expressions only.  Nothing is broadcast by hint: Spark picks a broadcast
for the items' side from its actual size and a sort-merge join beyond its
threshold.  Fingerprints are made distinct within a document before the join, and
a document's hits before they are grouped.

Defined results: null or empty text has no words and no hits; items with a null
id or without words are ignored; identical rows are judged alike, each on its own
text; items that repeat an id are one item with all their windows; an empty
benchmark hits nothing; only doc_id, text, item_id and text are read, so other
columns cannot clash.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moneta.llm.common import ascii_lower, written

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    return F.coalesce(F.array_remove(F.split(ascii_lower(text), NOT_WORD, -1), ""), F.array().cast("array<string>"))


def shifted(a: Column, by: int) -> Column:
    return F.slice(a, by + 1, F.greatest(F.size(a) - by, F.lit(0)))


def add_grams(df: DataFrame, words: str, seed: int, sizes: list[int], prefix: str) -> tuple[DataFrame, dict[int, str]]:
    """Columns with the hashes of all n-grams for each n of ``sizes``: a gram of n
    words is put together from two grams of half its size.  Entry i belongs to the
    gram that starts at word i; entries past the last full gram are cut off by ``full``."""
    have = {1: f"{prefix}1"}
    df = df.withColumn(have[1], F.transform(words, lambda x: F.xxhash64(F.lit(seed), x)))

    def make(n: int) -> str:
        nonlocal df
        if n not in have:
            half = 1 << ((n - 1).bit_length() - 1)
            a, b = make(half), make(n - half)
            df = df.withColumn(f"{prefix}{n}", F.zip_with(a, shifted(F.col(b), half), lambda x, y: F.xxhash64(x, y)))
            have[n] = f"{prefix}{n}"
        return have[n]

    names = {n: make(n) for n in sizes}
    return df, names


def full(grams: str, words: str, n: int) -> Column:
    return F.slice(grams, 1, F.greatest(F.size(words) - (n - 1), F.lit(0)))


def add_minima(df: DataFrame, grams: str, width: int, out: str) -> DataFrame:
    """Entry i of ``out``: the least of ``width`` entries of ``grams`` from i on."""
    at, done = grams, 1
    while done < width:
        by = min(done, width - done)
        df = df.withColumn(f"{out}_{done}", F.zip_with(at, shifted(F.col(at), by), lambda x, y: F.least(x, y)))
        at, done = f"{out}_{done}", done + by
    return df.withColumn(out, F.col(at))


def fingerprints(df: DataFrame, length: int, k: int, short: list[int], out: str) -> DataFrame:
    """Distinct fingerprints of the array column ``words``."""
    keep = df.columns
    df, gram = add_grams(df, "words", 0, [k, *short], "_g")
    df = add_minima(df, gram[k], length - k + 1, "_min")
    parts = [F.array_distinct(full("_min", "words", length))] + [F.array_distinct(full(gram[n], "words", n)) for n in short]
    return df.select(*keep, F.concat(*parts).alias(out))


def windows(df: DataFrame, sizes: list[int]) -> DataFrame:
    """Every window of each size: the columns but ``words``, then n, pos, a, b."""
    keep = [c for c in df.columns if c != "words"]
    df, a = add_grams(df, "words", 0, sizes, "_a")
    df, b = add_grams(df, "words", 1, sizes, "_b")

    def spans(n: int) -> Column:
        pairs = F.arrays_zip(full(a[n], "words", n).alias("a"), full(b[n], "words", n).alias("b"))
        return F.transform(pairs, lambda x, i: F.struct(F.lit(n).alias("n"), i.alias("pos"), x["a"].alias("a"), x["b"].alias("b")))

    each = [spans(n) for n in sizes]
    return df.select(*keep, F.explode(F.concat(*each)).alias("x")).select(*keep, "x.n", "x.pos", "x.a", "x.b")


def covered(spans: Column) -> Column:
    """Words in the union of array<struct<pos,n>>: one pass in the order of pos."""
    def step(acc, s):
        end = s["pos"] + s["n"]
        return F.struct(F.greatest(acc["upto"], end).alias("upto"),
                        (acc["sum"] + F.greatest(end - F.greatest(acc["upto"], s["pos"]), F.lit(0))).alias("sum"))
    return F.aggregate(F.array_sort(spans), F.struct(F.lit(0).alias("upto"), F.lit(0).alias("sum")), step)["sum"]


def decontaminate(docs: DataFrame, items: DataFrame, length: int = 10, k: int = 5) -> DataFrame:
    """One row per row of ``docs``: doc_id, row (hash of the text), n_words, n_hit, items
    (sorted ids as strings), spans (array of pos, n: the hit windows)."""
    items = items.where("item_id is not null").select(F.col("item_id").cast("string").alias("item"), words_of(F.col("text")).alias("words"))
    items = written(items.where(F.size("words") > 0), "items")
    short = sorted(r["n"] for r in items.where(F.size("words") < length).select(F.size("words").alias("n")).distinct().collect())
    wanted = items.where(F.size("words") >= length).select("item", "words", F.lit(length).alias("only")).unionByName(
        items.where(F.size("words") < length).select("item", "words", F.size("words").alias("only")))
    windowed = windows(wanted, [length, *short]).where("n = only").groupBy("n", "a", "b").agg(F.collect_set("item").alias("items"))
    windowed = written(windowed, "windows")
    # long items are found by their minima alone, short ones by their only window
    prints = fingerprints(wanted.where(F.col("only") >= length), length, k, [], "fp")
    prints = written(prints.select(F.explode("fp").alias("fp")).unionByName(
        windowed.where(F.col("n") < length).select(F.col("a").alias("fp"))).distinct(), "prints")

    base = docs.select("doc_id", F.xxhash64("text").alias("row"), words_of(F.col("text")).alias("words"))
    base = fingerprints(base, length, k, short, "fp").select("doc_id", "row", F.size("words").cast("long").alias("n_words"), "fp")
    base = written(base, "docprints")
    suspects = base.select("doc_id", "row", F.explode("fp").alias("fp")).join(prints, "fp", "left_semi").select(
        F.col("doc_id").alias("_id"), F.col("row").alias("_row")).distinct()
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("row"))
    texts = texts.join(suspects.hint("merge"), texts["doc_id"].eqNullSafe(F.col("_id")) & (F.col("row") == F.col("_row")), "left_semi")
    spans = windows(texts.select("doc_id", "row", words_of(F.col("text")).alias("words")), [length, *short])
    hits = spans.join(windowed, ["n", "a", "b"]).groupBy(F.col("doc_id").alias("_id"), F.col("row").alias("_row")).agg(
        F.collect_set(F.struct("pos", "n")).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    out = base.select("doc_id", "row", "n_words").join(
        hits, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("row") == F.col("_row")), "left")
    return out.select("doc_id", "row", "n_words", F.coalesce(covered(F.col("spans")), F.lit(0)).cast("long").alias("n_hit"),
                      F.coalesce("items", F.array().cast("array<string>")).alias("items"),
                      F.coalesce("spans", F.array().cast("array<struct<pos:int,n:int>>")).alias("spans"))
