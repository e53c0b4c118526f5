"""Mutable records as a bucketed base snapshot and a log of changes, with compaction.

The base has one row per key, hash-bucketed and sorted by the key.  Changes are
appended as they come.  Reading aggregates the changes since the base (partial aggregates,
so a key with very many of them is combined map-side) and joins one row per changed key to
the base: the base is read in its buckets and isn't shuffled again, only the
changes are.  Compaction writes what is read as the next base and starts a new log.

Two kinds of columns change.  A *latest* column takes its newest non-null change; the
base remembers when each was set, so a change that arrives after a compaction but is
older than what the base holds doesn't win.  A *highest* column only grows.  Reading gives
the same rows before and after any compaction, for changes in any order (ties in time: the larger
value).  Keys that only the changes have are inserted; null keys are ignored.
"""
from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class StateTable:
    """``path``: a shared folder.  ``key``: one column.  ``columns``: the schema of the base without the key."""

    def __init__(self, spark: SparkSession, path: str, key: str, key_type: str, columns: dict[str, str],
                 latest: Sequence[str] = (), highest: Sequence[str] = (), buckets: int = 16):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets
        self.columns, self.latest, self.highest = dict(columns), list(latest), list(highest)
        kinds = {key: key_type, **self.columns, **{f"_at_{c}": "timestamp_ntz" for c in self.latest}}
        self.schema = ", ".join(f"`{c}` {t}" for c, t in kinds.items())
        self.version, self._name = self._newest(), None

    # ------------------------------------------------------------- files
    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def _newest(self) -> int:
        """The newest base that was written to its end; -1 without one."""
        fs, at = self._fs(self.path)
        if not fs.exists(at):
            return -1
        names = [s.getPath().getName() for s in fs.listStatus(at)]
        done = [int(n[5:]) for n in names if n.startswith("base-") and self._exists(f"{self.path}/{n}/_SUCCESS")]
        return max(done, default=-1)

    def _exists(self, path: str) -> bool:
        fs, at = self._fs(path)
        return fs.exists(at)

    def _deltas(self) -> list[str]:
        """Complete appends to the current version's log."""
        fs, at = self._fs(f"{self.path}/log-{self.version}")
        if not fs.exists(at):
            return []
        return [d for d in (str(s.getPath()) for s in fs.listStatus(at)) if self._exists(f"{d}/_SUCCESS")]

    def _write_base(self, rows: DataFrame, version: int) -> None:
        name = f"moneta_state_{uuid.uuid4().hex}"
        (rows.repartition(self.buckets, self.key).write.bucketBy(self.buckets, self.key).sortBy(self.key)
         .format("parquet").option("path", f"{self.path}/base-{version}").saveAsTable(name))
        self.version, self._name = version, name

    def base(self) -> DataFrame:
        """The current snapshot with its buckets, also from another session's files."""
        if self.version < 0:
            raise ValueError(f"no snapshot in {self.path}")
        if self._name is None:
            self._name = f"moneta_state_{uuid.uuid4().hex}"
            self.spark.sql(f"CREATE TABLE {self._name} ({self.schema}) USING parquet CLUSTERED BY (`{self.key}`) SORTED BY (`{self.key}`) "
                           f"INTO {self.buckets} BUCKETS LOCATION '{self.path}/base-{self.version}'")
        return self.spark.table(self._name)

    # ------------------------------------------------------------- changes
    def start(self, rows: DataFrame) -> "StateTable":
        """Write the first snapshot: one row per key; columns that ``rows`` lacks are null."""
        have = set(rows.columns)
        cols = [(F.col(c) if c in have else F.lit(None)).cast(t).alias(c) for c, t in self.columns.items()]
        never = [F.lit(None).cast("timestamp_ntz").alias(f"_at_{c}") for c in self.latest]
        self._write_base(rows.where(F.col(self.key).isNotNull()).select(self.key, *cols, *never), 0)
        return self

    def append(self, log: DataFrame, ts: str = "ts") -> "StateTable":
        """Add changes: the key, a time and any of the changing columns (null: no change)."""
        have = [c for c in [*self.latest, *self.highest] if c in log.columns]
        rows = log.where(F.col(self.key).isNotNull()).select(
            self.key, F.col(ts).cast("timestamp_ntz").alias("_ts"), *[F.col(c).cast(self.columns[c]).alias(c) for c in have])
        rows.write.parquet(f"{self.path}/log-{self.version}/{uuid.uuid4().hex}")
        return self

    def changes(self) -> DataFrame | None:
        """One row per changed key: newest values with their times, highest values."""
        deltas = self._deltas()
        if not deltas:
            return None
        key_type = next(f for f in T.StructType.fromDDL(self.schema).fields if f.name == self.key)
        kinds = T.StructType([key_type, T.StructField("_ts", T.TimestampNTZType()), *[
            f for f in T.StructType.fromDDL(self.schema).fields if f.name in self.latest or f.name in self.highest]])
        log = self.spark.read.schema(kinds).parquet(*deltas)
        newest = [F.max(F.when(F.col(c).isNotNull() & F.col("_ts").isNotNull(), F.struct("_ts", c))).alias(f"_new_{c}") for c in self.latest]
        return log.groupBy(F.col(self.key).alias("_key")).agg(*newest, *[F.max(c).alias(f"_new_{c}") for c in self.highest])

    def _merged(self) -> DataFrame:
        base, new = self.base(), self.changes()
        if new is None:
            return base
        j = base.join(new, F.col(self.key) == F.col("_key"), "full_outer")
        out = [F.coalesce(F.col(self.key), F.col("_key")).alias(self.key)]
        times = []
        for c in self.columns:
            n = F.col(f"_new_{c}")
            if c in self.latest:
                at = F.col(f"_at_{c}")
                wins = n["_ts"].isNotNull() & (at.isNull() | (n["_ts"] > at) | ((n["_ts"] == at) & (n[c] > F.col(c))))
                out.append(F.when(wins, n[c]).otherwise(F.col(c)).alias(c))
                times.append(F.when(wins, n["_ts"]).otherwise(at).alias(f"_at_{c}"))
            elif c in self.highest:
                out.append(F.greatest(F.col(c), n).alias(c))
            else:
                out.append(F.col(c))
        return j.select(*out, *times)

    def read(self, with_times: bool = False) -> DataFrame:
        """The current records; with the times at which latest columns were set as ``_at_<column>``."""
        rows = self._merged()
        return rows if with_times else rows.select(self.key, *self.columns)

    def compact(self) -> "StateTable":
        """Write the current records as the next snapshot; its log starts empty.  A compaction that is lost
        on its way leaves the snapshot before it and its log in force."""
        self._write_base(self._merged(), self.version + 1)
        return self
