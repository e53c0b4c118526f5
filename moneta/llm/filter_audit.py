"""Filter interaction audit by sorted posting lists.

Which documents would each filter remove, at each place of every order of the filters?
For every part of the corpus, range of ids and filter there is a posting list: the
sorted ids of the documents that fail it.  Two more lists name the documents whose
loss or removal is of interest.  Within a range, the unions of all sets of filters are
built one list at a time by galloping merges: the list's ids that the union doesn't
hold yet (a difference) are found by searching the shorter of the two in the longer
one, and merged in.  Sizes alone leave the range; they are added up by part.

With the sizes of the unions every step of every order is known: after the filters of a
set S a part keeps its documents less the union of S, and filter f removes the
union of S and f less the union of S.

Ids are the place of a row in the scan's output, so a range has at most RANGE rows whatever
the document ids look like, a part with a third of all rows has many ranges, and no task
holds more than one range's lists.  Copies are found by the 128-bit hash of whole texts:
the smallest id of each hash is counted map-side, written, and joined in a join that AQE
splits, so a text that a third of all rows hold meets in no single task.

Defined results: null text is empty; a null part is the empty string, as is a part that
is empty; a null doc_id is no copy of anything, has no copies and no labels; repeated
rows count each, and none is a copy of another under the same doc_id; of repeated labels
one that says 1 is enough; an empty table gives an empty result; only the columns named
are read, so other columns cannot clash.
"""
from __future__ import annotations

import hashlib
import math
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from moneta.llm.common import written

#: Rows of one id range; parts whose sums a task holds before it sends them.
RANGE_BITS, HELD = 16, 4096
FILTERS = "ABCDE"

_CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_INNER = bytes(range(0x80, 0xC0))  # bytes that begin no code point
_MARKS = re.compile(rb"[#$%&*|]")


def text_flags(data: bytes, least_words: int = 50, distinct: int = 65, capitals: int = 5) -> int:
    """Bits of the text filters that a UTF-8 text fails: A few words, B few different words (per cent),
    C many capitals (per cent of the code points), D a mark."""
    words = data.split()
    n = len(data) - len(data.translate(None, _CAPITALS))
    return ((len(words) < least_words) | (100 * len(set(words)) < distinct * len(words)) << 1
            | (100 * n > capitals * len(data.translate(None, _INNER))) << 2 | (_MARKS.search(data) is not None) << 3)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").to_pylist()
        flags = np.fromiter((text_flags(t or b"") for t in texts), np.int32, len(texts))
        prints = np.frombuffer(b"".join(hashlib.blake2b(t or b"", digest_size=16).digest() for t in texts), np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("part"), pa.array(flags), pa.array(prints[:, 0].copy()), pa.array(prints[:, 1].copy())],
            names=["doc_id", "part", "fails", "h1", "h2"])


def text_filters(docs: DataFrame, part: str = "source") -> DataFrame:
    """(row, doc_id, part, fails) of every row of ``docs``: bits of the filters A to E that it fails."""
    rows = docs.select("doc_id", F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.col("text").cast("binary").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    rows = rows.mapInArrow(_scan, f"doc_id {kind}, part string, fails int, h1 long, h2 long")
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "flags")
    first = rows.groupBy("h1", "h2").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi")
    first = written(first.select(F.col("h1").alias("f1"), F.col("h2").alias("f2"), "lo"), "copies")
    rows = rows.join(first, (F.col("h1") == F.col("f1")) & (F.col("h2") == F.col("f2")), "left")
    copy = F.coalesce(F.col("doc_id") > F.col("lo"), F.lit(False))
    return rows.select("row", "doc_id", "part", (F.col("fails") + F.when(copy, 16).otherwise(0)).alias("fails"))


def minus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The entries of sorted ``a`` that sorted ``b`` doesn't hold; the shorter one is searched in the longer."""
    if not len(a) or not len(b):
        return a
    if len(a) <= len(b):
        at = np.searchsorted(b, a)
        return a[b[np.minimum(at, len(b) - 1)] != a]
    at = np.searchsorted(a, b)
    there = np.minimum(at, len(a) - 1)
    keep = np.ones(len(a), bool)
    keep[there[a[there] == b]] = False
    return a[keep]


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The union of two sorted lists that share no entry."""
    if not len(a) or not len(b):
        return a if len(a) else b
    at = np.searchsorted(a, b) + np.arange(len(b))
    out, old = np.empty(len(a) + len(b), a.dtype), np.ones(len(a) + len(b), bool)
    out[at], old[at] = b, False
    out[old] = a
    return out


def union_sizes(lists: list[np.ndarray], watched: list[np.ndarray]) -> np.ndarray:
    """By set of filters (bits): the size of the union of their lists, and how much of it each watched list holds."""
    unions = [np.empty(0, np.int64)]
    for s in range(1, 1 << len(lists)):
        top = s.bit_length() - 1
        rest = unions[s - (1 << top)]
        unions.append(merged(rest, minus(lists[top], rest)))
    return np.array([[len(u), *(len(w) - len(minus(w, u)) for w in watched)] for u in unions], np.int64)


def _sizes(k: int, n_watched: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[int, np.ndarray]] = {}

        def send() -> pa.RecordBatch:
            rows = [(part, s, n, *sizes.tolist()) for part, (n, table) in held.items() for s, sizes in enumerate(table)]
            cols = list(zip(*rows))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[2:])],
                                              names=["part", "filters", "n", "gone", *(f"w{i}" for i in range(n_watched))])

        for batch in batches:
            parts, n = batch.column("part").to_pylist(), batch.column("n").to_pylist()
            lists = [[batch.column(f"l{i}")[r].values.to_numpy(zero_copy_only=False) for i in range(k + n_watched)] for r in range(batch.num_rows)]
            for part, rows, own in zip(parts, n, lists):
                table = union_sizes(own[:k], own[k:])
                before = held.get(part)
                held[part] = (rows, table) if before is None else (before[0] + rows, before[1] + table)
                if len(held) >= HELD:
                    yield send()
        if held:
            yield send()
    return run


def audit(rows: DataFrame, filters: str, watched: dict[str, Column]) -> DataFrame:
    """(part, filters, n, gone, *watched) for every part and set of filters (bits, one for each letter of
    ``filters``): the part's rows, those that fail one of the set, and how many of these each condition in
    ``watched`` holds for.  ``rows``: row (long, any different numbers), part, fails (bits)."""
    k, names = len(filters), list(watched)
    near = F.shiftright("row", RANGE_BITS).alias("range")
    fails = [F.col("fails").bitwiseAND(F.lit(1 << i)) != 0 for i in range(k)]
    lists = [F.sort_array(F.collect_list(F.when(c, F.col("row")))).alias(f"l{i}") for i, c in enumerate([*fails, *watched.values()])]
    posted = rows.groupBy("part", near).agg(F.count("*").alias("n"), *lists)
    sizes = posted.select("part", "n", *[f"l{i}" for i in range(k + len(names))]).mapInArrow(
        _sizes(k, len(names)), "part string, filters int, n long, gone long" + "".join(f", w{i} long" for i in range(len(names))))
    return sizes.groupBy("part", "filters").agg(F.sum("n").alias("n"), F.sum("gone").alias("gone"),
                                                *[F.sum(f"w{i}").alias(name) for i, name in enumerate(names)])


def _steps(spark: SparkSession, filters: str) -> DataFrame:
    """Every step of every order: the filter and the sets of filters before and after it."""
    rows = []
    for order in permutations(range(len(filters))):
        before = 0
        for step, own in enumerate(order, 1):
            rows.append((len(rows), "".join(filters[i] for i in order), step, own, before, before | 1 << own))
            before |= 1 << own
    return spark.createDataFrame(rows, "number int, filter_order string, step int, own int, before int, after int")


def interactions(sizes: DataFrame, filters: str, watched: list[str]) -> DataFrame:
    """``audit`` sizes as one row for each part, order and step: kept, removed, redundant, unique_fails,
    ``<name>_lost`` for each watched condition, and the filter's removals summed over all orders."""
    cols = ["gone", *watched]
    by_set = sizes.groupBy("part").agg(F.max("n").alias("n"), F.map_from_entries(F.collect_list(F.struct(
        "filters", F.struct(*cols)))).alias("sizes"))
    spark, k = sizes.sparkSession, len(filters)
    steps = _steps(spark, filters)  # k! * k rows, whatever the corpus
    x = by_set.withColumn("number", F.explode(F.sequence(F.lit(0), F.lit(math.factorial(k) * k - 1)))).join(F.broadcast(steps), "number")

    def at(c, name: str = "gone"):
        return F.col("sizes")[c][name]

    everything = F.lit((1 << k) - 1)
    bit = F.expr("shiftleft(1, own)")
    x = x.withColumn("removed", at(F.col("after")) - at(F.col("before")))
    times: dict = defaultdict(int)
    for order in permutations(range(k)):
        before = 0
        for own in order:
            times[own, before] += 1
            before |= 1 << own
    shapley = F.lit(0)
    for own in range(k):
        total = sum((F.lit(t) * (at(F.lit(s | 1 << own)) - at(F.lit(s))) for (o, s), t in times.items() if o == own), F.lit(0))
        shapley = F.when(F.col("own") == own, total).otherwise(shapley)
    return x.select(
        "part", "filter_order", "step", (F.col("n") - at(F.col("after"))).alias("kept"), "removed",
        (at(bit) - F.col("removed")).alias("redundant"),
        (at(everything) - at(everything.bitwiseXOR(bit))).alias("unique_fails"),
        *[(at(F.col("after"), w) - at(F.col("before"), w)).alias(f"{w}_lost") for w in watched],
        shapley.cast("long").alias("shapley"))


def audit_filters(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """How the five text filters interact in every part of ``docs``."""
    said = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("_id")).agg(
        F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    rows = text_filters(docs, part)
    rows = rows.join(said, F.col("doc_id") == F.col("_id"), "left").select("row", "part", "fails", "good", "toxic")
    sizes = audit(rows, FILTERS, {"good": F.col("good"), "toxic": F.col("toxic")})
    return interactions(sizes, FILTERS, ["good", "toxic"])
