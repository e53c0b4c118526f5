"""Substring dedup by suffix arrays of buckets of the collection.

A string of ``length`` bytes that starts at more than one place of the corpus, the same
document included, goes from all of them.

One suffix array of the whole corpus would take a round for every byte of its longest
document.  Only what follows a suffix within ``length`` bytes matters here, so the
suffixes are dealt to buckets, and every bucket is sorted on its own by column-wise
construction of its transform (``collection_bwt``), whose common prefixes
say which suffixes share ``length`` bytes:

* The bucket of a suffix is the smallest hash of the grams (of two fifths of ``length``
  bytes) in its first ``length`` bytes.  Suffixes that share these bytes share the bucket.
  Consecutive suffixes mostly have the same bucket and are dealt as one piece of
  text, of ``length`` and some bytes.
* A bucket whose gram is found at one place of the corpus holds nothing to compare.
  The places are counted first, as hashes, and only pieces of other buckets are cut out.
* Equal pieces of a bucket are one string with a weight.  A bucket with one string
  that has several places is settled: all of it repeats.  All others are sorted, many
  buckets at a time in a collection of bounded size.
* A bucket with more than ``bucket`` different strings (what surrounds a
  passage that very many documents share) can't be one task's.  Its suffixes are dealt
  on by the 128-bit hash of their first ``length`` bytes, so that the buckets are
  the groups of equal strings themselves.

Documents with equal texts are one class: it is searched once, and repeats
whole.  Hot groups: places are counted map-side; tables that meet on a key that many
rows may have (bucket, piece, class) are written before they are joined, so that AQE
splits the larger side; no group of documents is collected.

Defined results: null text has no bytes; a null doc_id is a document like any other;
repeated rows are copies of each other; of rows that share a doc_id each is judged on
its own text; texts shorter than ``length`` stay; an empty table gives an empty result;
only doc_id and text are read, so other columns cannot clash.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moneta.llm.collection_bwt import repeated
from moneta.llm.common import written
from moneta.llm.wordhash import least, mix, signed, stream

#: A text's hashes are made in blocks of so many bytes; bytes of the strings that a task sorts at a time.
BLOCK, CHUNK = 1 << 20, 1 << 16
_TABLES = (stream(201, 256), stream(202, 256))
_FACTORS = (stream(203, 1)[0] | np.uint64(1), stream(204, 1)[0] | np.uint64(1))


def gram_hashes(data: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """uint64 hash of every n consecutive bytes: a polynomial by doubling, then mixed."""
    if len(data) < n:
        return np.empty(0, np.uint64)
    power = {1: np.array([_FACTORS[seed]])}
    have = {1: _TABLES[seed][data]}
    k = 1
    while 2 * k <= n:
        have[2 * k] = have[k][:-k] * power[k] + have[k][k:]
        power[2 * k] = power[k] * power[k]
        k *= 2
    done, out = k, have[k]
    while done < n:
        step = max(s for s in have if s <= n - done)
        size = len(data) - done - step + 1
        out = out[:size] * power[step] + have[step][done:done + size]
        done += step
    return mix(out)


def _blocks(data: bytes, length: int) -> Iterator[tuple[int, np.ndarray]]:
    """Parts of a text that hold every start of a string of ``length`` once."""
    whole = np.frombuffer(data, np.uint8)
    for at in range(0, max(0, len(whole) - length + 1), BLOCK):
        yield at, whole[at:at + BLOCK + length - 1]


def bucket_grams(data: bytes, length: int, gram: int) -> np.ndarray:
    """Bucket of every place whose gram is the smallest of a string of ``length``, one entry a place."""
    out = []
    for _, block in _blocks(data, length):
        h = gram_hashes(block, gram)
        width = length - gram + 1
        low = least(h, width)  # the bucket of every start
        pad = np.zeros(width - 1, np.uint64)
        most = ~least(~np.concatenate((pad, low, pad)), width)  # the largest bucket of the starts around a place
        out.append(h[h == most])
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def pieces(data: bytes, length: int, gram: int, alive: np.ndarray) -> list[tuple[int, int, int]]:
    """(bucket, first start, number of starts) of consecutive starts of one bucket in sorted ``alive``."""
    out = []
    for base, block in _blocks(data, length):
        low = signed(least(gram_hashes(block, gram), length - gram + 1))
        at = np.minimum(np.searchsorted(alive, low), len(alive) - 1)
        there = alive[at] == low
        edge = np.flatnonzero(np.concatenate(([True], low[1:] != low[:-1], [True])))
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
            if there[a]:
                out += [(int(low[a]), base + s, min(length - gram + 1, b - s)) for s in range(a, b, length - gram + 1)]
    return out


def _first(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or b"" for t in batch.column("text").to_pylist()]
            grams = [signed(bucket_grams(t, length, gram)) for t in texts]
            ends = np.concatenate(([0], np.cumsum([len(g) for g in grams]))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("s1"), batch.column("s2"), pa.array([len(t) for t in texts], pa.int64()),
                 pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()),
                 pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(grams) if grams else np.empty(0, np.int64)))],
                names=["doc_id", "s1", "s2", "n_bytes", "sha", "grams"])
    return run


def _hash128(data: bytes) -> tuple[int, int]:
    h = hashlib.blake2b(data, digest_size=16).digest()
    return int.from_bytes(h[:8], "little", signed=True), int.from_bytes(h[8:], "little", signed=True)


def _cut_out(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, s1, s2, alive in zip(*(batch.column(c) for c in ("text", "s1", "s2", "alive"))):
                data = text.as_py() or b""
                found = pieces(data, length, gram, np.sort(alive.values.to_numpy()))
                for at in range(0, len(found), 10_000):
                    some = found[at:at + 10_000]
                    strings = [data[s:s + n + length - 1] for _, s, n in some]
                    g1, g2 = zip(*map(_hash128, strings))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([b for b, _, _ in some], pa.int64()), pa.array(g1, pa.int64()), pa.array(g2, pa.int64()),
                         pa.array([s1.as_py()] * len(some), pa.int64()), pa.array([s2.as_py()] * len(some), pa.int64()),
                         pa.array([s for _, s, _ in some], pa.int64()), pa.array([n for _, _, n in some], pa.int32()),
                         pa.array(strings, pa.binary())],
                        names=["bucket", "g1", "g2", "s1", "s2", "start", "n", "string"])
    return run


def _runs(starts: np.ndarray) -> list[tuple[int, int]]:
    """Consecutive numbers as (first, last + 1)."""
    edge = np.flatnonzero(np.diff(starts) > 1)
    return list(zip(starts[np.concatenate(([0], edge + 1))].tolist(), (starts[np.concatenate((edge, [len(starts) - 1]))] + 1).tolist()))


_SPAN = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))


def _sorted_buckets(length: int):
    """Rows in the order of their buckets: whole buckets together, as many as fit a chunk, in one collection."""
    def settle(rows: list[tuple]) -> pa.RecordBatch:
        found = repeated([r[4] for r in rows], [r[3] for r in rows], length)
        cols = [[r[i] for r, f in zip(rows, found) if len(f)] for i in range(3)]
        spans = [[{"a": a, "b": b} for a, b in _runs(f)] for f in found if len(f)]
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols), pa.array(spans, _SPAN)], names=["bucket", "g1", "g2", "spans"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("bucket", "g1", "g2", "weight", "string"))):
                if size >= CHUNK and row[0] != held[-1][0]:
                    yield settle(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[4])
        if held:
            yield settle(held)
    return run


def _dealt_on(length: int):
    """Every suffix of a piece that has ``length`` bytes, by their hash."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("bucket", "g1", "g2", "weight", "string"))):
                data = np.frombuffer(row[4], np.uint8)
                h1, h2 = (signed(gram_hashes(data, length, seed)) for seed in (0, 1))
                n = len(h1)
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array([v] * n, pa.int64()) for v in row[:4]), pa.array(np.arange(n, dtype=np.int32)), pa.array(h1), pa.array(h2)],
                    names=["bucket", "g1", "g2", "weight", "at", "h1", "h2"])
    return run


def _without(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, s1, s2, spans in zip(*(batch.column(c).to_pylist() for c in ("text", "s1", "s2", "spans"))):
                ends: list[list[int]] = []
                for x in sorted(spans, key=lambda x: x["a"]):
                    a, b = x["a"], x["b"] - 1 + length
                    if ends and a <= ends[-1][1]:
                        ends[-1][1] = max(ends[-1][1], b)
                    else:
                        ends.append([a, b])
                edges = [0, *(e for x in ends for e in x), len(text)]
                kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))
                rows.append((s1, s2, len(text) - len(kept), [{"start": a, "end": b} for a, b in ends], hashlib.sha256(kept).hexdigest(), kept))
            cols = list(zip(*rows))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["c1", "c2", "gone", "runs", "cut_sha", "kept"])
    return run


def dedup_repeats(docs: DataFrame, length: int = 200, bucket: int = 2048) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans, kept) per row of ``docs``: ``spans`` are the
    maximal removed runs of bytes, ``kept`` (binary) what is left; both are null where nothing went."""
    if length < 10:
        raise ValueError("buckets are made of grams of two fifths of the length: 10 bytes or more")
    gram = 2 * length // 5
    keys = ["s1", "s2"]
    docs = docs.select("doc_id", F.xxhash64("text").alias("s1"), F.xxhash64(F.lit(1), "text").alias("s2"), F.col("text").cast("binary").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = written(docs.mapInArrow(_first(length, gram), f"doc_id {kind}, s1 long, s2 long, n_bytes long, sha string, grams array<long>"), "grams")

    # one row for each text, its places by bucket, and the buckets with several places
    heads = rows.where(F.col("n_bytes") >= length).groupBy(*keys).agg(
        F.count("*").alias("copies"), F.min("doc_id").alias("head"), F.first("grams").alias("grams"))
    heads = written(heads, "heads")
    places = heads.select(*keys, F.explode("grams").alias("bucket"))
    busy = written(places.groupBy("bucket").agg(F.count("*").alias("places")).where("places > 1").select("bucket"), "busy")
    alive = places.join(busy, "bucket").groupBy(*keys).agg(F.collect_set("bucket").alias("alive"))
    alive = written(alive.join(heads.select(*keys, "head"), keys), "alive")
    texts = docs.join(alive.hint("merge"), keys).where(F.col("doc_id").eqNullSafe(F.col("head"))).select("text", *keys, "alive")
    cut = texts.mapInArrow(_cut_out(length, gram), "bucket long, g1 long, g2 long, s1 long, s2 long, start long, n int, string binary")
    cut = written(cut.withColumn("place", F.monotonically_increasing_id()), "pieces")

    # equal pieces are one string; identical rows of a document gave the same pieces twice
    piece = ["bucket", "g1", "g2"]
    once = cut.groupBy(*piece, *keys, "start", "n").agg(F.min("place").alias("place"))
    strings = written(once.groupBy(*piece).agg(F.count("*").alias("weight"), F.min("place").alias("place"), F.min("n").alias("n")), "strings")
    different = written(strings.groupBy("bucket").agg(F.count("*").alias("different")), "buckets")
    strings = written(strings.join(different, "bucket"), "strings")
    settled = (F.col("different") == 1) & (F.col("weight") > 1)
    whole = strings.where(settled).select(*piece, F.array(F.struct(F.lit(0).alias("a"), F.col("n").alias("b"))).alias("spans"))
    open_ = strings.where(~settled).select("place", "weight", "different")
    open_ = written(cut.select("place", *piece, "string").join(open_, "place"), "open")
    small = open_.where(F.col("different") <= bucket).repartition("bucket").sortWithinPartitions("bucket", "g1", "g2")
    small = small.mapInArrow(_sorted_buckets(length), "bucket long, g1 long, g2 long, spans array<struct<a:int,b:int>>")
    large = written(open_.where(F.col("different") > bucket).mapInArrow(
        _dealt_on(length), "bucket long, g1 long, g2 long, weight long, at int, h1 long, h2 long"), "large")
    equal = large.groupBy("bucket", "h1", "h2").agg(F.sum("weight").alias("total")).where("total > 1").drop("total")
    large = large.join(written(equal, "equal"), ["bucket", "h1", "h2"]).groupBy(*piece).agg(
        F.collect_list(F.struct(F.col("at").alias("a"), (F.col("at") + 1).alias("b"))).alias("spans"))
    found = written(whole.unionByName(small).unionByName(large), "found")

    # back to the places, and to the texts
    spans = once.join(found, piece).select(*keys, F.explode(F.transform("spans", lambda x: F.struct(
        (x["a"] + F.col("start")).alias("a"), (x["b"] + F.col("start")).alias("b")))).alias("x"))
    spans = written(spans.groupBy(*keys).agg(F.collect_list("x").alias("spans")), "spans")
    single = spans.join(heads.where("copies = 1").select(*keys, "head"), keys)
    done = docs.join(single.hint("merge"), keys).where(F.col("doc_id").eqNullSafe(F.col("head"))).select("text", *keys, "spans").mapInArrow(
        _without(length), "c1 long, c2 long, gone long, runs array<struct<start:long,end:long>>, cut_sha string, kept binary")
    copies = heads.where("copies > 1").select(F.col("s1").alias("p1"), F.col("s2").alias("p2"))
    out = rows.drop("grams").join(written(copies, "copies"), (F.col("s1") == F.col("p1")) & (F.col("s2") == F.col("p2")), "left")
    out = out.join(done, (F.col("s1") == F.col("c1")) & (F.col("s2") == F.col("c2")), "left")
    copy, cutted = F.col("p1").isNotNull(), F.col("c1").isNotNull()
    all_of_it = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end")))
    return out.select(
        "doc_id", "n_bytes",
        F.when(copy, F.col("n_bytes")).when(cutted, F.col("gone")).otherwise(F.lit(0).cast("long")).alias("n_removed"),
        F.when(copy, F.lit(1)).when(cutted, F.size("runs")).otherwise(0).cast("long").alias("n_spans"),
        F.when(copy, F.lit(hashlib.sha256(b"").hexdigest())).when(cutted, F.col("cut_sha")).otherwise(F.col("sha")).alias("kept_sha256"),
        F.when(copy, all_of_it).when(cutted, F.col("runs")).alias("spans"),
        F.when(copy, F.lit(b"")).when(cutted, F.col("kept")).alias("kept"))
