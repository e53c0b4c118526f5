"""Vector code compression: product codes by slice-and-intersect bitmasks.

Components become integers floor(scale * x).  A vector is cut into ``parts`` equal
consecutive parts; each part position has a codebook of at most ``entries`` integer
entries, and a part's code is the number of its nearest entry.

The nearest entry is found without computing all distances.  For every dimension of
a part position the entries' coordinates are sorted, and prefix masks say which entries
(one bit each, 64 to a word) have the first 0, 1, 2 ... coordinates.  A query
takes an initial radius from one entry: its distance to the entry next to it in the
dimension in which the entries lie widest apart.  In each dimension the coordinates
within the radius are a slice of the sorted ones, whose entries are one prefix mask
without another; the masks of all dimensions are ANDed.  An entry nearer than the
first one lies within the radius in every dimension, so the bits left are an exact
candidate set, and distances are computed for them alone.

The codebooks are fitted to all vectors: each round every task adds up its rows by
(part, entry), and Spark adds the tasks' sums.  The driver sees the codebooks only,
``entries`` * dimensions integers whatever the number of rows.

Defined results: vectors that are null, or hold a null or non-finite component, are
dropped; those of every length have codebooks of their own (an index over mixed lengths
compares like with like); a length that ``parts`` doesn't divide is filled up with
zeros, which changes no distance and isn't part of the codebooks' digest; vectors of no
components get code 0 in every part and error 0; with fewer vectors than entries the
codebooks are smaller; equal ids are ordered by their vectors, null ids come last;
repeated rows count each; labels may be null (one group) and of any type; components
whose integer is beyond 10^25 are taken as that; an error beyond a long is the largest
long; an empty table gives an empty result; only the id, vector and label columns are
read, so other columns cannot clash.
"""
from __future__ import annotations

import hashlib
import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moneta.llm.common import written

#: Integers up to this size are handled in 64 bits; rows with larger ones in Python integers.
SAFE, MOST, LARGEST = 1 << 24, 10 ** 25, (1 << 63) - 1


def integers(flat: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of doubles, exact: int64 where all fit in SAFE, else Python integers."""
    if not len(flat) or np.abs(flat).max() * scale < SAFE:
        return np.floor(flat * scale).astype(np.int64)
    out = [scale * int(x) if abs(x) >= 2 ** 53 else math.floor(scale * int(x) + scale * (x - int(x))) for x in flat.tolist()]
    return np.array([max(-MOST, min(MOST, v)) for v in out], object)


class Slices:
    """The entries of one part position, ready for the search."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        n, width = entries.shape
        self.sorted, self.masks = [], []
        for d in range(width):
            order = np.argsort(entries[:, d], kind="stable")
            masks = np.zeros((n + 1, -(-n // 64)), np.uint64)
            for k, e in enumerate(order.tolist()):
                masks[k + 1] = masks[k]
                masks[k + 1, e // 64] |= np.uint64(1 << (e % 64))
            self.sorted.append((entries[order, d], order))
            self.masks.append(masks)
        self.widest = int(np.argmax([s[-1] - s[0] for s, _ in self.sorted])) if width else 0

    def squared(self, x: np.ndarray, entry) -> np.ndarray:
        return ((x - self.entries[entry]) ** 2).sum(axis=1)

    def candidates(self, x: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """Masks of the entries within ``radius`` of each row of ``x`` in every dimension."""
        left = np.full((len(x), self.masks[0].shape[1]), np.uint64(0xFFFFFFFFFFFFFFFF))
        for d, ((coordinates, _), masks) in enumerate(zip(self.sorted, self.masks)):
            low = np.searchsorted(coordinates, x[:, d] - radius, "left")
            high = np.searchsorted(coordinates, x[:, d] + radius, "right")
            left &= masks[high] ^ masks[low]
        return left

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry of each row (of equally near ones the first) and the squared distance."""
        n, width = self.entries.shape
        if not width:
            return np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
        coordinates, order = self.sorted[self.widest]
        at = np.minimum(np.searchsorted(coordinates, x[:, self.widest]), n - 1)
        first = order[at]
        best, error = first.astype(np.int64), self.squared(x, first)
        if error.dtype == object:
            radius = np.array([math.isqrt(e) for e in error], object)
        else:
            radius = np.floor(np.sqrt(error.astype(np.float64))).astype(np.int64) + 1  # the root's rounding is covered
        found = self.candidates(x, radius)
        for e in range(n):
            rows = np.flatnonzero((found[:, e // 64] >> np.uint64(e % 64)) & np.uint64(1))
            if len(rows):
                d = self.squared(x[rows], e)
                better = (d < error[rows]) | ((d == error[rows]) & (e < best[rows]))
                best[rows[better]], error[rows[better]] = e, d[better]
        return best, error


@dataclass
class Codebooks:
    """``books``: by vector length, one (entries, width) integer array for each part position."""

    parts: int
    scale: int
    books: dict[int, list[np.ndarray]]

    def digest(self, length: int) -> str:
        """sha256 of all components by part, entry and position, joined by commas."""
        width = -(-length // self.parts)
        said = (str(v) for p, book in enumerate(self.books[length]) for e in book.tolist()
                for v in e[:max(0, min(width, length - p * width))])
        return hashlib.sha256(",".join(said).encode()).hexdigest()

    def decode(self, length: int, code: str) -> list[float]:
        """The vector that a code stands for: its entries, in the middle of their steps."""
        book = self.books[length]
        whole = [v for p in range(self.parts) for v in book[p][int(code[2 * p:2 * p + 2], 16)].tolist()]
        return [(v + 0.5) / self.scale for v in whole[:length]]


def _rows(batch: pa.RecordBatch, name: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, row numbers, matrix) of the rows of each length; int64, or Python integers where they don't fit."""
    col = batch.column(name)
    sizes = np.diff(np.asarray(col.offsets))
    flat, starts = col.flatten(), np.concatenate(([0], np.cumsum(sizes)))
    for n in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == n)
        at = (starts[rows][:, None] + np.arange(n)).reshape(-1)
        yield n, rows, flat.take(pa.array(at)).to_numpy(zero_copy_only=False).reshape(len(rows), n)


def _prepare(scale: int):
    """Valid rows with integer components, as longs or, where one is beyond SAFE, as decimal strings."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.column("v")
            flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # null: NaN
            ends = np.cumsum(np.diff(np.asarray(col.offsets)))
            wrong = np.concatenate(([0], np.cumsum(~np.isfinite(flat))))
            sizes = np.diff(np.asarray(col.offsets))
            good = wrong[ends] == wrong[ends - sizes]
            if not good.any():
                continue
            keep = np.repeat(good, sizes)
            ints = integers(flat[keep], scale)
            offsets = pa.array(np.concatenate(([0], np.cumsum(sizes[good]))).astype(np.int32))
            small = ints.dtype != object
            none = pa.array([None] * int(good.sum()))
            narrow = pa.ListArray.from_arrays(offsets, pa.array(ints)) if small else none.cast(pa.list_(pa.int64()))
            wide = none.cast(pa.list_(pa.string())) if small else pa.ListArray.from_arrays(offsets, pa.array([str(v) for v in ints]))
            rest = batch.filter(pa.array(good))
            yield pa.RecordBatch.from_arrays([rest.column("id"), rest.column("label"), pa.array(sizes[good].astype(np.int32)), narrow, wide],
                                             names=["id", "label", "n", "ints", "wide"])
    return run


def _matrices(batch: pa.RecordBatch, parts: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, row numbers, matrix padded to a multiple of ``parts``)."""
    for name, wide in (("ints", False), ("wide", True)):
        there = np.flatnonzero(batch.column(name).is_valid().to_numpy(zero_copy_only=False))
        if not len(there):
            continue
        for n, rows, x in _rows(batch.take(pa.array(there)), name):
            if wide:
                x = np.array([int(v) for v in x.reshape(-1)], object).reshape(x.shape)
            yield n, there[rows], np.hstack([x, np.zeros((len(x), -n % parts), x.dtype)])


def _assigned(x: np.ndarray, slices: list[Slices]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    width = x.shape[1] // len(slices)
    for p, s in enumerate(slices):
        own = x[:, p * width:(p + 1) * width]
        if own.dtype != s.entries.dtype:  # large integers on either side
            own = own.astype(object)
            s = Slices(s.entries.astype(object)) if s.entries.dtype != object else s
        yield p, own, *s.nearest(own)


def _sums(books: Codebooks):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices = {n: [Slices(b) for b in book] for n, book in books.books.items()}
        total: dict = {}
        count: dict = defaultdict(int)
        for batch in batches:
            for n, _, x in _matrices(batch, books.parts):
                for p, own, best, _ in _assigned(x, slices[n]):
                    for e in np.unique(best).tolist():
                        rows = own[best == e]
                        key = (n, p, e)
                        count[key] += len(rows)
                        s = rows.sum(axis=0)
                        total[key] = total[key] + s if key in total else s
        said = [(n, p, e, d, count[n, p, e], str(int(v))) for (n, p, e), s in total.items() for d, v in enumerate(s.tolist())]
        if said:
            n, p, e, d, c, s = map(list, zip(*said))
            yield pa.RecordBatch.from_arrays([*(pa.array(v, pa.int32()) for v in (n, p, e, d)), pa.array(c, pa.int64()), pa.array(s)],
                                             names=["n", "part", "entry", "d", "rows", "total"])
    return run


def _codes(books: Codebooks):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices = {n: [Slices(b) for b in book] for n, book in books.books.items()}
        digests = {n: books.digest(n) for n in books.books}
        for batch in batches:
            code = np.zeros((batch.num_rows, books.parts), np.int64)
            error, digest = np.zeros(batch.num_rows, object), np.empty(batch.num_rows, object)
            for n, rows, x in _matrices(batch, books.parts):
                digest[rows] = digests[n]
                for p, _, best, e in _assigned(x, slices[n]):
                    code[rows, p] = best
                    error[rows] += e
            text = ["".join(f"{c:02x}" for c in row) for row in code.tolist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("label"), batch.column("n"), pa.array(text, pa.string()),
                 pa.array([min(int(e), LARGEST) for e in error], pa.int64()), pa.array(list(digest), pa.string())],
                names=["id", "label", "n", "code", "error", "digest"])
    return run


def prepared(vectors: DataFrame, vector: str, id: str, label: str, scale: int) -> DataFrame:
    """(id, label, n, ints, wide) of the valid rows, written once and read by every round."""
    rows = vectors.select(F.col(id).alias("id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("v")).where("v is not null")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return written(rows.mapInArrow(_prepare(scale), f"id {kinds['id']}, label {kinds['label']}, n int, ints array<bigint>, wide array<string>"), "vectors")


def fit_codebooks(rows: DataFrame, parts: int, entries: int, rounds: int, scale: int) -> Codebooks:
    """Codebooks of ``prepared`` rows: the parts of the vectors with the smallest ids, then so many rounds."""
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits for each part: 1 to 256 entries")
    start: dict[int, list] = {}
    lengths = [r["n"] for r in rows.groupBy("n").count().collect()]
    for n in lengths:
        first = rows.where(F.col("n") == n).orderBy(F.col("id").asc_nulls_last(), "ints", "wide").limit(entries).collect()
        whole = [[int(v) for v in (r["ints"] if r["ints"] is not None else r["wide"])] + [0] * (-n % parts) for r in first]
        width = -(-n // parts)
        kind = np.int64 if all(abs(v) < SAFE for w in whole for v in w) else object
        start[n] = [np.array([w[p * width:(p + 1) * width] for w in whole], kind).reshape(len(whole), width) for p in range(parts)]
    books = Codebooks(parts, scale, start)
    for _ in range(rounds):
        sums = rows.mapInArrow(_sums(books), "n int, part int, entry int, d int, rows bigint, total string")
        sums = sums.groupBy("n", "part", "entry", "d").agg(
            F.sum("rows").alias("rows"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
        new = {n: [b.astype(object) for b in book] for n, book in books.books.items()}
        for r in sums.collect():  # entries * dimensions rows
            new[r["n"]][r["part"]][r["entry"], r["d"]] = int(r["total"]) // r["rows"]
        books = Codebooks(parts, scale, {n: [b.astype(np.int64) if not b.size or max(map(abs, b.reshape(-1).tolist())) < SAFE else b
                                             for b in book] for n, book in new.items()})
    return books


def compress_vectors(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096,
                     vector: str = "embedding", id: str = "vec_id", label: str = "label") -> tuple[DataFrame, Codebooks]:
    """(id, label, code, error, label_error, codebooks_sha256) of every valid row, and the codebooks.

    ``code``: two hex digits for each part; ``error``: the squared distance to what the code stands
    for, in steps of 1 / scale; ``label_error``: its sum over the rows of the label.
    """
    rows = prepared(vectors, vector, id, label, scale)
    books = fit_codebooks(rows, parts, entries, rounds, scale)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    coded = written(rows.mapInArrow(_codes(books), f"id {kinds['id']}, label {kinds['label']}, n int, code string, error bigint, digest string"), "codes")
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LARGEST).cast("decimal(38,0)")).cast("long")
    by_label = written(coded.groupBy(F.col("label").alias("_label")).agg(total.alias("label_error")), "labels")
    out = coded.join(by_label, F.col("label").eqNullSafe(F.col("_label")))
    return out.select(F.col("id").alias(id), F.col("label").alias(label), "code", "error", "label_error", F.col("digest").alias("codebooks_sha256")), books
