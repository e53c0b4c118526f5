"""Near-duplicate documents by SetSketch registers.

Every document is the set of its distinct 5-word shingles.  Its sketch has m
registers; register j holds ``1 - log_b(min of m exponential variables)``, that is
an exponentially spaced, truncated minimum.  Registers of a union are the maxima
of the parts', so sketches merge, and two registers are equal with at least the
probability of the Jaccard similarity.

1. One pass sketches every text.  Documents with equal sets (128-bit hash) form a
   class; only one of a class goes on.
2. Bands of 4 registers are packed into one 8-byte key.  Members of a bucket are
   paired with the bucket's smallest class, not with each other.
3. A pair's similarity is estimated jointly by maximum likelihood from the numbers
   of larger, smaller and equal registers; hopeless pairs go.  The rest is
   confirmed on the full shingle sets, which gives links.
4. Components of the links are found.  A bucket that then still holds several
   components is compared exactly: each member outside the bucket's largest
   component against all members of other components, in blocks.  So every two
   documents that share a bucket end up in one component or have been compared.
5. Components of all links.

With 32 bands a linked pair shares no bucket with probability
(1 - 0.75^4)^32 < 6e-6 at the threshold, and less above it.

Hot groups: buckets are reduced by grouped minima before any join, exact copies
count once, a centre's members are checked in parts of bounded size, and blocks
have a bounded number of members.

Defined results: doc_id is cast to a long (other ids are an error); null text, or text without words, has the empty set and links
with nothing; a null doc_id links with nothing and has a null component; identical
rows are one document; of rows that share a doc_id but not the text, the one with
the largest set stands for the id in links; an empty table gives an empty result;
only doc_id and text are read, so other columns cannot clash.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moneta.llm.common import connected, written
from moneta.llm.wordhash import LOWER, grams, mix, signed, stream, word_hashes

REGISTERS, ROWS = 128, 4
BASE, RATE, TOP = 1.001, 20.0, 2 ** 16 - 1
#: Shingles of a part of a centre's members; members of a block.
PART, BLOCK = 1 << 20, 512
#: A linked pair's estimate is below the threshold by more than this with a probability of less than 1e-6.
MARGIN = 0.2

_MUL, _ADD = stream(11, REGISTERS) | np.uint64(1), stream(12, REGISTERS)


def shingles(text: str | None, size: int = 5) -> np.ndarray:
    """Sorted distinct shingle hashes."""
    words = word_hashes(text.encode("utf-8", "surrogatepass").translate(LOWER)) if text else np.empty(0, np.uint64)
    return np.unique(grams(words, min(size, len(words)))) if len(words) else words


def sketch(items: np.ndarray) -> np.ndarray:
    """uint16 registers of a set of hashes."""
    if not len(items):
        return np.zeros(REGISTERS, np.uint16)
    low = np.full(REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(items), 512):
        low = np.minimum(low, (mix(items[at:at + 512])[:, None] * _MUL + _ADD).min(axis=0))
    smallest = -np.log1p(-(low.astype(np.float64) + 0.5) / 2.0 ** 64) / RATE
    return np.clip(np.floor(1 - np.log(smallest) / np.log(BASE)), 0, TOP).astype(np.uint16)


def likely_similarity(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Joint maximum-likelihood estimate of the Jaccard similarity for rows of registers
    of sets with n_a and n_b elements, on a grid of steps of 1/64."""
    more, less = (a > b).sum(axis=1)[:, None], (a < b).sum(axis=1)[:, None]
    same = REGISTERS - more - less
    u = (n_a / (n_a + n_b))[:, None]
    j = np.linspace(0, 1, 65)[None, :] * np.minimum(u / (1 - u), (1 - u) / u)

    def p(x):
        return -np.log1p(-x * (BASE - 1) / BASE) / np.log(BASE)

    up, down = p(np.maximum(u - (1 - u) * j, 0)), p(np.maximum(1 - u - u * j, 0))
    with np.errstate(divide="ignore", invalid="ignore"):
        chance = sum(np.where(n > 0, n * np.log(np.maximum(q, 1e-300)), 0) for n, q in ((more, up), (less, down), (same, 1 - up - down)))
    return np.take_along_axis(np.broadcast_to(j, chance.shape), chance.argmax(axis=1)[:, None], 1)[:, 0]


def _sketches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for i, text in zip(batch["doc_id"], batch["text"]):
            s = shingles(text)
            rows.append((i, len(s), int(signed(s.sum(dtype=np.uint64, keepdims=True))[0]),
                         int(signed(mix(s ^ np.uint64(0x5BD1E995)).sum(dtype=np.uint64, keepdims=True))[0]), sketch(s).astype(">u2").tobytes()))
        yield pd.DataFrame(rows, columns=["doc_id", "n", "s1", "s2", "regs"]).astype({"doc_id": "Int64"})


def _sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for i, text in zip(batch["cls"], batch["text"]):
            s = shingles(text)
            yield pd.DataFrame({"cls": [i], "n": [len(s)], "items": [s.tobytes()]})


def _registers(col: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(col), ">u2").reshape(-1, REGISTERS)


def _likely(least_similarity: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                ok = likely_similarity(_registers(b["regs_a"]), _registers(b["regs_b"]), b["n_a"].to_numpy(float), b["n_b"].to_numpy(float)) >= least_similarity
                yield b.loc[ok, ["a", "b"]]
    return run


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets reach the similarity."""
    if not len(a) or not len(b):
        return False
    both = int((a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def _confirm(percent: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        centre = group[group["centre"]]
        if not len(centre):
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        a, member = np.frombuffer(centre["items"].iloc[0], np.uint64), group[~group["centre"]]
        found = [i for i, items in zip(member["cls"], member["items"]) if _linked(a, np.frombuffer(items, np.uint64), percent)]
        return pd.DataFrame({"a": centre["cls"].iloc[0], "b": found}).astype("int64")
    return run


def _candidates(stray: pd.DataFrame, member: pd.DataFrame, band: int, percent: int) -> np.ndarray:
    """Mask (strays x members) of pairs of different components that may be links; a pair is
    looked at only in the first band that it shares."""
    a, b = _registers(stray["regs"]), _registers(member["regs"])
    n_a, n_b = stray["n"].to_numpy()[:, None], member["n"].to_numpy()[None, :]
    ok = (stray["comp"].to_numpy()[:, None] != member["comp"].to_numpy()[None, :]) & (
        100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b))
    for i, regs in enumerate(a):
        same = b == regs
        ok[i] &= same.sum(axis=1) >= (percent / 100 - MARGIN) * REGISTERS
        ok[i] &= same.reshape(len(b), -1, ROWS).all(axis=2).argmax(axis=1) == band
    return ok


def _involved(percent: int):
    """The rows of a block that a candidate pair needs."""
    def run(group: pd.DataFrame) -> pd.DataFrame:
        stray, member = group[group["stray"]], group[~group["stray"]]
        if not len(stray) or not len(member):
            return group.iloc[:0]
        ok = _candidates(stray, member, group["band"].iloc[0], percent)
        return pd.concat([stray[ok.any(axis=1)], member[ok.any(axis=0)]])
    return run


def _across(percent: int):
    """Links of a block across components, confirmed on full sets; of those only what joins
    components that earlier links of the block haven't joined."""
    def run(group: pd.DataFrame) -> pd.DataFrame:
        stray, member = group[group["stray"]], group[~group["stray"]]
        found, root = [], {c: c for c in group["comp"]}

        def find(c):
            while root[c] != c:
                root[c] = c = root[root[c]]
            return c

        if len(stray) and len(member):
            ok = _candidates(stray, member, group["band"].iloc[0], percent)
            sets = [np.frombuffer(x, np.uint64) for x in member["items"]]
            comps, ids = member["comp"].tolist(), member["cls"].tolist()
            for i, (comp, cls, items) in enumerate(zip(stray["comp"].tolist(), stray["cls"].tolist(), stray["items"])):
                a = np.frombuffer(items, np.uint64)
                for j in np.flatnonzero(ok[i]):
                    if find(comp) != find(comps[j]) and _linked(a, sets[j], percent):
                        root[find(comp)] = find(comps[j])
                        found.append((cls, ids[j]))
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")
    return run


def _links(pairs: DataFrame, sketches: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are links, confirmed on full sets."""
    side = sketches.select("cls", "n", "regs")
    a = side.select(F.col("cls").alias("a"), F.col("n").alias("n_a"), F.col("regs").alias("regs_a"))
    b = side.select(F.col("cls").alias("b"), F.col("n").alias("n_b"), F.col("regs").alias("regs_b"))
    near = pairs.join(a, "a").join(b, "b").where(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent)
    near = written(near.mapInPandas(_likely(percent / 100 - MARGIN), "a long, b long"), "near")
    parts = near.join(sets.select(F.col("cls").alias("b"), F.col("n")), "b").groupBy("a").agg(
        F.ceil(F.sum("n") / PART).cast("int").alias("parts"))
    parts = written(parts, "parts")
    members = near.join(parts, "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), F.col("b").alias("cls"))
    centres = parts.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("a").alias("cls"))
    rows = members.withColumn("centre", F.lit(False)).unionByName(centres.withColumn("centre", F.lit(True)))
    rows = rows.join(sets.select("cls", "items"), "cls")
    return written(rows.groupBy("a", "part").applyInPandas(_confirm(percent), "a long, b long"), "links")


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per row of ``docs``; documents
    are linked when 100 * intersection >= percent * union."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = written(docs.mapInPandas(_sketches, "doc_id long, n long, s1 long, s2 long, regs binary"), "sketches")
    one = rows.where("n > 0 and doc_id is not null").groupBy("doc_id").agg(F.max(F.struct("n", "s1", "s2", "regs")).alias("x"))
    one = one.select("doc_id", "x.n", "x.s1", "x.s2", "x.regs")
    classes = written(one.groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("cls"), F.max("regs").alias("regs")), "classes")
    bands = classes.select("cls", "n", F.posexplode(F.array(*[
        F.substring("regs", 2 * ROWS * i + 1, 2 * ROWS) for i in range(REGISTERS // ROWS)])).alias("band", "key"))
    bands = bands.select("cls", "n", "band", "key")
    centre = bands.groupBy("band", "key").agg(F.min("cls").alias("a"), F.count("*").alias("size")).where("size > 1")
    bucketed = written(bands.join(centre, ["band", "key"]), "buckets")
    pairs = bucketed.where("cls > a").select("a", F.col("cls").alias("b")).distinct()
    # the sets of all classes that share a bucket: one pass over the texts, by a sort-merge join at every size
    texts = docs.select(F.col("doc_id").alias("cls"), "text").join(
        bucketed.select("cls").distinct().hint("merge"), "cls", "left_semi")
    sets = texts.mapInPandas(_sets, "cls long, n long, items binary").groupBy("cls").agg(
        F.max_by("items", "n").alias("items"), F.max("n").alias("n"))
    sets = written(sets, "sets")
    links = _links(pairs, classes, sets, percent)
    comps = connected(links, "a", "b")

    # buckets that still hold several components
    inside = bucketed.where("size > 2").join(comps.withColumnRenamed("node", "cls"), "cls", "left")
    inside = written(inside.select("cls", "n", "band", "key", F.coalesce("component", "cls").alias("comp")), "inside")
    per = inside.groupBy("band", "key", "comp").agg(F.count("*").alias("c")).groupBy("band", "key").agg(
        F.count("*").alias("comps"), F.sum("c").alias("all"), F.max("c").alias("most"), F.max_by("comp", F.struct("c", "comp")).alias("main"))
    mixed = inside.join(per.where("comps > 1"), ["band", "key"]).join(classes.select("cls", "regs"), "cls")
    mixed = mixed.withColumn("stray", F.col("comp") != F.col("main"))

    def blocks(n: str) -> Column:
        return F.ceil(F.expr(n) / BLOCK).cast("int")

    def own(n: Column) -> Column:
        return F.pmod(F.xxhash64("cls"), n).cast("int")

    def each(n: Column) -> Column:
        return F.explode(F.sequence(F.lit(0), n - 1))

    ms, ss = blocks("all"), blocks("all - most")
    cols = ["band", "key", "cls", "n", "comp", "regs", "m", "s", "stray"]
    strays = mixed.where("stray").withColumn("m", each(ms)).withColumn("s", own(ss)).select(*cols)
    members = mixed.withColumn("m", own(ms)).withColumn("s", each(ss)).withColumn("stray", F.lit(False)).select(*cols)
    block = strays.unionByName(members)
    needed = written(block.groupBy("band", "key", "m", "s").applyInPandas(_involved(percent), block.schema), "involved")
    new = written(needed.join(sets.select("cls", "items"), "cls").groupBy("band", "key", "m", "s").applyInPandas(
        _across(percent), "a long, b long"), "across")
    comps = connected(links.unionByName(new), "a", "b")

    member = one.select("doc_id", "n", "s1", "s2").join(classes.select("n", "s1", "s2", "cls"), ["n", "s1", "s2"])
    member = member.join(comps.withColumnRenamed("node", "cls"), "cls", "left").select(
        F.col("doc_id").alias("_id"), F.coalesce("component", "cls").alias("comp"))
    out = rows.join(member, F.col("doc_id") == F.col("_id"), "left")
    out = out.withColumn("component_id", F.coalesce("comp", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id",
                      F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
