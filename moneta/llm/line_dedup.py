"""Line dedup: levelled sorted runs of line hashes.

The keys of all long lines seen so far live in *runs*: tables of (128-bit key hash,
documents, last document, new), bucketed and sorted by hash, one file a bucket.  All runs
have the same buckets, so runs are joined with each other by merging, without a shuffle
or a sort; a batch is shuffled once, when it is counted, into these buckets.

* A batch is aggregated to one row per key and merge-anti-joined with every run: keys that
  no run holds are new, the others are increments of a key that a run holds.  Both
  become the batch's own run of level 0.
* When a level has ``fanout`` runs they are merged into one run of the next level, by full
  outer merge joins that add the counts, so the number of runs grows with the logarithm of
  the number of batches and each entry is rewritten once a level.
* What is common is read from the one run that is left when all runs are merged.

Only built-in expressions run on this path.  A line that a third of all documents
hold is counted map-side before any shuffle, and joined by a sort-merge join that
AQE splits.  doc_id is compared as a long.

Defined results: null or empty text is one empty line; a row whose doc_id is null
counts as no document and keeps its lines; identical rows count as one document;
rows that share a doc_id but not the text are one document for the counts, and
each keeps its own lines; an empty table gives an empty result; input columns
stay, but ``n_lines`` and ``n_dropped`` replace columns of that name, and names
that begin with ``_ld_`` are reserved.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from moneta.llm.common import SPACE, ascii_lower, drop_folder, scratch, written

KEY = ["h1", "h2"]


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(SPACE)))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def long_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, row, pos, h1, h2) of every line whose key has ``min_chars`` code points."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("row"), F.posexplode(lines_of(F.col("text"))).alias("pos", "line"))
    rows = rows.where(F.char_length("line") >= min_chars).select("doc_id", "row", "pos", line_key(F.col("line")).alias("key"))
    return rows.where(F.char_length("key") >= min_chars).select(
        "doc_id", "row", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


class LineRuns:
    """Levelled runs in a shared folder; ``levels[k]`` lists the runs (table names) of level k."""

    #: A bucket with one file keeps its order when it is read.
    ORDERED = "spark.sql.legacy.bucketedTableScan.outputOrdering"

    def __init__(self, spark: SparkSession, fanout: int = 2, buckets: int | None = None):
        self.spark, self.fanout, self.levels = spark, fanout, [[]]
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.paths: dict[str, str] = {}

    def _write(self, rows: DataFrame) -> str:
        """A run from rows that are already dealt to the buckets."""
        path = scratch(self.spark, "run")
        name = "llm_" + path.rpartition("-")[2]
        self.paths[name] = path
        before = self.spark.conf.get(self.ORDERED)
        self.spark.conf.set(self.ORDERED, "true")
        try:
            rows.write.bucketBy(self.buckets, *KEY).sortBy(*KEY).format("parquet").option("path", path).saveAsTable(name)
        finally:
            self.spark.conf.set(self.ORDERED, before)
        return name

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE {name}")
        drop_folder(self.spark, self.paths.pop(name))

    def marked(self, batch: DataFrame) -> DataFrame:
        """``batch`` (one row per key) plus ``new``: whether no run holds the key."""
        known = F.lit(False)
        for i, name in enumerate(n for level in self.levels for n in level):
            run = self.spark.table(name).select(F.col("h1").alias(f"a{i}"), F.col("h2").alias(f"b{i}")).hint("merge")
            batch = batch.join(run, (F.col("h1") == F.col(f"a{i}")) & (F.col("h2") == F.col(f"b{i}")), "left")
            known = known | F.col(f"a{i}").isNotNull()
        return batch.select(*KEY, "n_docs", "last_doc", (~known).alias("new"))

    def add(self, lines: DataFrame) -> DataFrame:
        """Add a batch of ``long_lines``; its documents must be in no other batch.
        Returns the keys that no earlier batch had."""
        batch = lines.where("doc_id is not null").groupBy(*KEY).agg(
            F.count_distinct("doc_id").alias("n_docs"), F.max("doc_id").cast("long").alias("last_doc"))
        run = self._write(self.marked(batch))  # counted into the buckets: each is whole in one task, and so one file
        self.levels[0].append(run)
        new = self.spark.read.schema("h1 long, h2 long, n_docs long, last_doc long, new boolean").parquet(self.paths[run]).where("new").select(*KEY)
        for level in range(len(self.levels)):
            if len(self.levels[level]) >= self.fanout:
                if level + 1 == len(self.levels):
                    self.levels.append([])
                # the batch's own run stays for ``new`` to be read, also after it was merged
                self.levels[level + 1].append(self._merge(self.levels[level], keep={run}))
                self.levels[level] = []
        return new

    def merge_plan(self, a: str, b: str) -> DataFrame:
        """Two runs as one: a full outer merge join that adds the counts."""
        x = self.spark.table(a)
        y = self.spark.table(b).select(*[F.col(c).alias(f"_{c}") for c in (*KEY, "n_docs", "last_doc", "new")])
        j = x.hint("merge").join(y, (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2")), "full_outer")
        zero = F.lit(0).cast("long")
        return j.select(F.coalesce("h1", "_h1").alias("h1"), F.coalesce("h2", "_h2").alias("h2"),
                        (F.coalesce("n_docs", zero) + F.coalesce("_n_docs", zero)).alias("n_docs"), F.greatest("last_doc", "_last_doc").alias("last_doc"),
                        (F.coalesce("new", F.lit(False)) | F.coalesce("_new", F.lit(False))).alias("new"))

    def _merge(self, names: list[str], keep: set[str] = frozenset()) -> str:
        out = names[0]
        for name in names[1:]:
            both = self._write(self.merge_plan(out, name))
            for old in (out, name):
                if old not in keep:
                    self._drop(old)
                else:
                    self.spark.sql(f"DROP TABLE {old}")
            out = both
        return out

    def totals(self) -> DataFrame:
        """One row per key: all runs merged into one."""
        names = [n for level in self.levels for n in level]
        run = names[0] if len(names) == 1 else self._merge(names)
        self.levels = [[] for _ in self.levels[:-1]] + [[run]]
        return self.spark.table(run)

    def drop(self) -> None:
        """Delete all runs and the files kept for ``add``'s answers."""
        for name in [n for level in self.levels for n in level]:
            self._drop(name)
        for path in self.paths.values():
            drop_folder(self.spark, path)
        self.levels, self.paths = [[]], {}


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, n_batches: int = 4, fanout: int = 2) -> DataFrame:
    """``docs`` with repeated long lines taken out of ``text``, plus n_lines and n_dropped.

    A line whose key is found in ``min_docs`` documents stays only in the document
    with the largest doc_id that holds it.  ``n_batches``: the documents are fed to
    the runs in so many batches, by hash of doc_id.
    """
    spark = docs.sparkSession
    lines = long_lines(docs, min_chars).withColumn("batch", F.pmod(F.xxhash64("doc_id"), F.lit(n_batches)).cast("int"))
    path = scratch(spark, "lines")
    lines.write.partitionBy("batch").parquet(path)
    lines = spark.read.schema(lines.schema).parquet(path)
    runs = LineRuns(spark, fanout)
    for b in range(n_batches):
        runs.add(lines.where(F.col("batch") == b))
    common = written(runs.totals().where(F.col("n_docs") >= min_docs).select(*KEY, "last_doc"), "common")
    runs.drop()
    drops = lines.join(common, KEY).where("doc_id < last_doc").groupBy(
        F.col("doc_id").alias("_ld_id"), F.col("row").alias("_ld_row")).agg(F.collect_set("pos").alias("_ld_drop"))
    rows = docs.withColumn("_ld_lines", lines_of(F.col("text")))
    rows = rows.join(drops, (F.col("doc_id") == F.col("_ld_id")) & (F.xxhash64("text") == F.col("_ld_row")), "left")
    rows = rows.withColumns({
        "n_lines": F.size("_ld_lines").cast("long"),
        "n_dropped": F.coalesce(F.size("_ld_drop"), F.lit(0)).cast("long"),
        "_ld_keep": F.array_except(F.sequence(F.lit(0), F.size("_ld_lines") - 1), "_ld_drop"),
    })
    kept = F.array_join(F.transform("_ld_keep", lambda i: F.get("_ld_lines", i)), "\n")
    return rows.withColumn("text", F.when(F.col("_ld_drop").isNull(), F.coalesce("text", F.lit(""))).otherwise(kept)).drop(
        "_ld_lines", "_ld_keep", "_ld_drop", "_ld_id", "_ld_row")
