"""Structured Streaming twins of the batch operators.

* ``stream_recent_counts``: last-hour frequency per user.  Rows are kept in the state of a
  built-in aggregate by (user, hour); every row is also copied to the next hour, as in the
  batch operator.  The watermark closes an hour once nothing that belongs to it or to the
  hour before can still arrive, so rows that are late inside the watermark are counted
  and every emitted count equals the batch ``recent_1h_count``.  No state or task holds
  more than two hours of a user; the watermark drops them.
* ``stream_risk``: the same risk expressions applied downstream (stateless).
* ``stream_daily``: tumbling one-day windows per user behind a watermark; a
  day is emitted once the watermark passes its end (append mode).
* ``stream_delays``: session windows by (user, transaction) whose gap is the row's own
  delay, so a session ends where its delay expires.
* ``alerts_sink``: ``foreachBatch`` writer, idempotent per batch id.
* ``feed`` and ``time_slices``: a table replayed as a stream to the end of its input.
"""
from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from moneta.operators import risk

HOUR_US = 3_600_000_000


def wall_as_utc(ntz_col: str):
    """A TIMESTAMP whose epoch is the zone-free wall time read as UTC, whatever
    the session time zone (the state timeouts use the same epoch)."""
    c = F.col(ntz_col)
    micros = ((F.datediff(F.to_date(c), F.lit("1970-01-01").cast("date")).cast("bigint") * 86400
               + F.hour(c) * 3600 + F.minute(c) * 60) * 1_000_000
              + (F.extract(F.lit("SECOND"), c) * 1_000_000).cast("bigint"))
    return F.timestamp_micros(micros)


def _event_time(tx_stream: DataFrame) -> DataFrame:
    """Watermarks need TIMESTAMP: the wall time read as UTC."""
    return tx_stream.withColumn("event_time", wall_as_utc("timestamp"))


def _counts_of_hours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (user_id, rows) hours as single rows with ``recent_count``; copies are counted only."""
    for batch in batches:
        col = batch.column("rows")
        flat, sizes = col.flatten(), np.diff(np.asarray(col.offsets))
        time = flat.field("at").to_numpy(zero_copy_only=False)
        group = np.repeat(np.arange(len(sizes)), sizes)
        order = np.lexsort((time, group))
        time, group = time[order], group[order]
        n = np.empty(len(time), np.int64)
        edges = np.concatenate(([0], np.cumsum(sizes)))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            t = time[a:b]  # rows in [t - 1h, t] (peers with the same time included), minus the row itself
            n[a:b] = np.searchsorted(t, t, "right") - np.searchsorted(t, t - HOUR_US, "left") - 1
        mine = flat.field("own").to_numpy(zero_copy_only=False)[order].astype(bool)
        rows = flat.take(pa.array(order[mine]))
        yield pa.RecordBatch.from_arrays(
            [rows.field("id"), batch.column("user_id").take(pa.array(group[mine])), rows.field("timestamp"), rows.field("amount"),
             rows.field("category"), pa.array(n[mine].astype(np.int32))],
            names=["id", "user_id", "timestamp", "amount", "category", "recent_count"])


def stream_recent_counts(tx_stream: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """(id, user_id, timestamp, amount, category, recent_count) of every row, once the watermark has closed its hour."""
    at = wall_as_utc("timestamp")
    rows = tx_stream.filter(F.col("timestamp").isNotNull()).withColumn("own", F.explode(F.array(F.lit(True), F.lit(False))))
    # the copy's time is an hour later, and so is the newest time that moves the watermark
    rows = rows.withColumn("hour_time", F.when(F.col("own"), at).otherwise(at + F.expr("INTERVAL 1 HOUR")))
    one = F.struct("own", F.unix_micros(at).alias("at"), *[
        F.when(F.col("own"), F.col(c)).alias(c) for c in ("id", "timestamp", "amount", "category")])
    hours = (rows.withWatermark("hour_time", f"{watermark} 1 hour").groupBy("user_id", F.window("hour_time", "1 hour"))
             .agg(F.collect_list(one).alias("rows")))
    kind = tx_stream.schema
    return hours.select("user_id", "rows").mapInArrow(_counts_of_hours, T.StructType([
        *[T.StructField(c, kind[c].dataType) for c in ("id", "user_id", "timestamp", "amount", "category")],
        T.StructField("recent_count", T.IntegerType())]))


def stream_risk(tx_stream: DataFrame) -> DataFrame:
    return risk.impulse_risk(stream_recent_counts(tx_stream))


def stream_daily(tx_stream: DataFrame, watermark: str = "1 hour") -> DataFrame:
    w = (_event_time(tx_stream).withWatermark("event_time", watermark)
         .groupBy("user_id", F.window("event_time", "1 day"))
         .agg(F.sum("amount").alias("amount"), F.count(F.lit(1)).alias("n")))
    day = F.date_from_unix_date(F.floor(F.unix_seconds(F.col("window.start")) / 86400).cast("int"))
    return w.select("user_id", day.alias("date"), "amount", "n")


def alerts_sink(path: str):
    """foreachBatch writer: each batch id owns one folder, rewritten on retry."""
    def write(batch: DataFrame, batch_id: int) -> None:
        (batch.filter(F.col("is_high_risk"))
         .select("id", "user_id", "timestamp", "amount", "risk_score",
                 F.when(F.col("is_night"), "night").otherwise("impulse").alias("alert_type"))
         .write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}"))
    return write


# ------------------------------------------------------------------ replays

def time_slices(df: DataFrame, ts_col: str, slices: int = 4, rest: dt.timedelta = dt.timedelta(days=2),
                at: str | None = None) -> list[DataFrame]:
    """``df`` in ``slices`` consecutive ranges of ``ts_col``.  The last one also holds a marker
    row that lies ``rest`` after the newest row: it moves the watermark past all rows, so a
    replay reaches the end of its input, and is itself never passed by the watermark.
    With a folder ``at`` the slices are written there in one pass over ``df`` and read from it."""
    lo, hi = df.agg(F.min(ts_col), F.max(ts_col)).first()
    if lo is None:
        return [df]
    cuts = [lo + (hi - lo) * i / slices for i in range(1, slices)]
    number = sum((F.coalesce(F.col(ts_col) >= F.lit(c), F.lit(False)).cast("int") for c in cuts), F.lit(0))
    if at is None:
        parts = [df.filter(number == i) for i in range(slices)]
    else:
        df.withColumn("slice", number).write.partitionBy("slice").parquet(at)
        whole = df.sparkSession.read.schema(T.StructType([*df.schema.fields, T.StructField("slice", T.IntegerType())])).parquet(at)
        parts = [whole.filter(F.col("slice") == i).drop("slice") for i in range(slices)]  # one folder each

    def mark(f: T.StructField):
        if isinstance(f.dataType, (T.TimestampNTZType, T.TimestampType)):
            return F.lit(hi + (rest if f.name == ts_col else 2 * rest))
        return F.lit(-1) if isinstance(f.dataType, T.IntegralType) else F.lit(None)

    marker = df.sparkSession.range(1).select(*[mark(f).cast(f.dataType).alias(f.name) for f in df.schema.fields])
    return [*parts[:-1], parts[-1].unionByName(marker)]


def feed(parts: list[DataFrame], base: str, plan: Callable[[DataFrame], DataFrame],
         sink: Callable[[DataFrame, int], None] | None = None) -> None:
    """Each part arrives as one micro-batch of files, written by as many tasks as it has
    partitions.  The query stops after each part and goes on from its checkpoint with the
    next one, as after a restart.  Rows go to ``{base}/out`` or to the ``foreachBatch`` sink."""
    for part in parts:
        part.write.mode("append").parquet(f"{base}/in")
        out = plan(part.sparkSession.readStream.schema(part.schema).parquet(f"{base}/in")).writeStream
        out = out.foreachBatch(sink) if sink else out.format("parquet").option("path", f"{base}/out")
        out.option("checkpointLocation", f"{base}/ckpt").trigger(availableNow=True).start().awaitTermination()


def stream_delays(delays: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """(user_id, transaction_id, expires_at, can_proceed) of every delay that has run out.

    ``delays``: (user_id, transaction_id, set_at, expires_at) stream.  A delay is a session of its
    transaction that starts where it is set and ends where it expires; one that is set again
    while it runs goes on, and its latest setting says when it expires.  A session is released
    once the watermark has passed its end.  The state has one row for each running delay."""
    at, until = wall_as_utc("set_at"), wall_as_utc("expires_at")
    gap = F.concat(F.greatest(F.unix_micros(until) - F.unix_micros(at), F.lit(1)).cast("string"), F.lit(" microseconds"))
    d = delays.withColumn("event_time", at).withColumn("_gap", gap).withWatermark("event_time", watermark)
    return (d.groupBy("user_id", "transaction_id", F.session_window("event_time", F.col("_gap")))
            .agg(F.max_by("expires_at", "set_at").alias("expires_at"))
            .select("user_id", "transaction_id", "expires_at", F.lit(True).alias("can_proceed")))
