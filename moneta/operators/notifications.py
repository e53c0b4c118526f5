"""Alerts and notifications: rows built from templates, read/acknowledge logs
resolved latest-wins, per-user retention, filters and counts."""
from __future__ import annotations

from collections.abc import Sequence
from string import Formatter

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from moneta import params as P
from moneta.functions.common import rnd

# FIXED VALUES — notification templates (title, type)
TEMPLATES = {
    "night_alert": ("🌙 Alerta Noturno", "alert"),
    "anomaly_detected": ("⚠️ Gasto Atípico", "warning"),
    "budget_warning": ("💰 Alerta de Orçamento", "warning"),
    "goal_progress": ("🎯 Progresso da Meta", "info"),
    "goal_achieved": ("🎉 Meta Alcançada!", "success"),
    "weekly_summary": ("📊 Resumo Semanal", "info"),
    "impulse_blocked": ("🛑 Compra Bloqueada", "critical"),
    "savings_tip": ("💡 Dica de Economia", "info"),
}
NOTIF_COLS = ["notification_id", "user_id", "template", "title", "message", "type", "category", "created_at"]


def _money(c: Column) -> Column:
    return F.when(c.isNotNull(), F.format_string("%.2f", rnd(c, 2)))


def _pct0(c: Column) -> Column:
    return F.when(c.isNotNull(), F.format_string("%.0f", rnd(c, 0)))


# FIXED VALUES — template messages
MESSAGES = {
    "night_alert": "Você está fazendo uma compra de R$ {amount:.2f} às {hour}h. Compras neste horário tendem a ser por impulso.",
    "anomaly_detected": "Detectamos um gasto incomum: R$ {amount:.2f} em {category}. Score de anomalia: {score}/100",
    "budget_warning": "Você já gastou {percent:.0f}% do seu orçamento de {category}.",
    "goal_progress": 'Você atingiu {percent:.0f}% da meta "{goal_name}"! Faltam R$ {remaining:.2f}',
    "goal_achieved": 'Parabéns! Você alcançou a meta "{goal_name}"!',
    "weekly_summary": "Esta semana você gastou R$ {total:.2f}. {comparison}",
    "impulse_blocked": "Uma compra de R$ {amount:.2f} foi bloqueada por medida de proteção. Motivo: {reason}",
    "savings_tip": "{tip}",
}
TYPES = ["info", "warning", "alert", "success", "critical"]
_SPECS = {".2f": _money, ".0f": _pct0, "": lambda c: c.cast("string")}


def template_message(name: str, f: dict[str, Column]) -> Column:
    """The template text with the given fields; null when a field is null."""
    parts = []
    for text, field, spec, _ in Formatter().parse(MESSAGES[name]):
        parts += [F.lit(text)] if text else []
        parts += [_SPECS[spec](f[field])] if field else []
    return F.concat(*parts)


def create_notification(src: DataFrame, title: Column, message: Column, source_id: Column, created_at: Column,
                        type: Column | str = "info", category: Column | str = "general",
                        data: Column | None = None, user: str = "user_id") -> DataFrame:
    """One notification per source row with free texts and no template.  An unknown or
    null type becomes 'info', a null category 'general'; null texts stay null (the row is
    kept).  ``data`` is an optional payload of any type; the id is md5('custom|' + source)."""
    as_col = lambda c: F.lit(c) if isinstance(c, str) else c
    kind = as_col(type)
    cols = [
        F.md5(F.concat(F.lit("custom|"), source_id.cast("string"))).alias("notification_id"),
        F.col(user).alias("user_id"), F.lit(None).cast("string").alias("template"), title.alias("title"),
        message.alias("message"), F.when(kind.isin(TYPES), kind).otherwise(F.lit("info")).alias("type"),
        F.coalesce(as_col(category), F.lit("general")).alias("category"), created_at.alias("created_at")]
    return src.select(*cols, *([data.alias("data")] if data is not None else []))


def notify_from_template(src: DataFrame, name: str, fields: dict[str, Column], source_id: Column,
                         created_at: Column, user: str = "user_id") -> DataFrame:
    """One notification per source row; rows missing a field make none.  The
    category is the template name up to the first '_'; the id is md5(name|source)."""
    title, ntype = TEMPLATES[name]
    msg = template_message(name, fields)
    return (src.select(
        F.md5(F.concat(F.lit(name + "|"), source_id.cast("string"))).alias("notification_id"),
        F.col(user).alias("user_id"), F.lit(name).alias("template"), F.lit(title).alias("title"),
        msg.alias("message"), F.lit(ntype).alias("type"), F.lit(name.split("_")[0]).alias("category"),
        created_at.alias("created_at"))
        .filter(F.col("message").isNotNull()))


def notify_from_templates(src: DataFrame, rules: dict[str, tuple[Column, dict[str, Column]]], source_id: Column,
                          created_at: Column, user: str = "user_id") -> DataFrame:
    """``notify_from_template`` for several templates in one pass over ``src``: a row makes
    a notification for every template whose condition holds and whose fields are all there."""
    made = []
    for name, (when, fields) in rules.items():
        title, ntype = TEMPLATES[name]
        msg = template_message(name, fields)
        made.append(F.when(when & msg.isNotNull(), F.struct(
            F.md5(F.concat(F.lit(name + "|"), source_id.cast("string"))).alias("notification_id"), F.lit(name).alias("template"),
            F.lit(title).alias("title"), msg.alias("message"), F.lit(ntype).alias("type"), F.lit(name.split("_")[0]).alias("category"))))
    each = src.select(F.col(user).alias("user_id"), created_at.alias("created_at"), F.explode(F.array(*made)).alias("_n")).filter("_n is not null")
    return each.select("_n.notification_id", "user_id", "_n.template", "_n.title", "_n.message", "_n.type", "_n.category", "created_at")


def next_marks(notifs: DataFrame, marks: DataFrame, bucket: str = "day") -> DataFrame:
    """``notifs`` plus ``_next``: the user's first mark at or after each row's creation time.

    A bucketed as-of join.  Rows and marks are dealt to (user, ``bucket``).  A table with one row
    for each of these carries the first mark of a later bucket back to the buckets before it: its window
    runs over a user's buckets (the calendar's days), not rows.  Inside a bucket one pass,
    newest first, keeps the nearest mark, beginning with the one carried in.  So no task holds
    more than a bucket of a user, however many rows the user has.
    """
    unit = lambda c: F.date_trunc(bucket, F.col(c)).cast("timestamp_ntz")
    n = notifs.withColumn("_b", unit("created_at"))
    m = marks.filter(F.col("at").isNotNull()).select("user_id", "at", unit("at").alias("_b"))
    buckets = n.filter(F.col("_b").isNotNull()).select("user_id", "_b", F.lit(None).cast("timestamp_ntz").alias("at")).unionByName(m)
    buckets = buckets.groupBy("user_id", "_b").agg(F.min("at").alias("_first"))
    later = Window.partitionBy("user_id").orderBy(F.col("_b").desc()).rowsBetween(Window.unboundedPreceding, -1)
    carried = buckets.withColumn("_in", F.min("_first").over(later)).filter(F.col("_in").isNotNull())
    end = F.lit(None).cast("timestamp_ntz")  # the carried mark comes first
    events = (n.withColumns({"_t": F.col("created_at"), "_k": F.lit(0), "_mark": end})
              .unionByName(m.select("user_id", "_b", F.col("at").alias("_t"), F.lit(1).alias("_k"), F.col("at").alias("_mark")), allowMissingColumns=True)
              .unionByName(carried.select("user_id", "_b", end.alias("_t"), F.lit(2).alias("_k"), F.col("_in").alias("_mark")), allowMissingColumns=True))
    newest = (Window.partitionBy("user_id", "_b").orderBy(F.col("_t").desc_nulls_first(), F.col("_k").desc())
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (events.withColumn("_next", F.when(F.col("created_at").isNotNull(), F.min("_mark").over(newest)))
            .filter(F.col("_k") == 0).drop("_b", "_t", "_k", "_mark"))


def resolve_reads(notifs: DataFrame, reads: DataFrame, mark_all: DataFrame | None = None, bucket: str = "day") -> DataFrame:
    """read / read_at from a per-notification read log (first read wins) and an
    optional per-user 'mark all read' log (effective for notifications created
    up to that moment; see ``next_marks``)."""
    first = reads.groupBy(F.col("notification_id").alias("_id")).agg(F.min("read_at").alias("_r1"))
    j = notifs if mark_all is None else next_marks(notifs, mark_all, bucket)
    j = j.join(first, F.col("notification_id") == F.col("_id"), "left")
    ra = F.col("_r1") if mark_all is None else F.least(F.col("_r1"), F.col("_next"))
    return j.withColumn("read_at", ra).withColumn("read", ra.isNotNull()).drop("_r1", "_id", "_next")


def retain_newest(notifs: DataFrame, keys: Sequence[str] = ("user_id",),
                  keep: int = P.NOTIFICATION_RETENTION) -> DataFrame:
    """Keep the newest ``keep`` per key (window-group limit before the shuffle)."""
    w = Window.partitionBy(*keys).orderBy(F.col("created_at").desc(), F.col("notification_id").desc())
    return notifs.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= keep).drop("_rn")


def filter_notifications(notifs: DataFrame, unread_only: bool = False, category: str | None = None,
                         limit: int = 50, keys: Sequence[str] = ("user_id",)) -> DataFrame:
    """Newest first per key; falsy filters are skipped; at most ``limit`` per key."""
    df = notifs
    if unread_only:
        df = df.filter(~F.col("read"))
    if category:
        df = df.filter(F.col("category") == category)
    w = Window.partitionBy(*keys).orderBy(F.col("created_at").desc(), F.col("notification_id").desc())
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)


def unread_count(notifs: DataFrame, keys: Sequence[str] = ("user_id",)) -> DataFrame:
    return notifs.groupBy(*keys).agg(F.sum(F.when(~F.col("read"), 1).otherwise(0)).alias("unread"))


def write_notifications(notifs: DataFrame, path: str, keep: int = P.NOTIFICATION_RETENTION) -> DataFrame:
    """Sink: rows appended to a Parquet log (partitioned by category).  Returns what the
    log retains, over this and all earlier appends."""
    notifs.write.mode("append").partitionBy("category").parquet(path)
    return read_notifications(notifs.sparkSession, path, keep)


def read_notifications(spark: SparkSession, path: str, keep: int = P.NOTIFICATION_RETENTION) -> DataFrame:
    """The newest ``keep`` rows per user of the log."""
    return retain_newest(spark.read.parquet(path), keep=keep)


# ------------------------------------------------------------------- alerts

def alerts_from_risk(checked: DataFrame) -> DataFrame:
    """High-risk rows of an effective guard become alert rows (type night/impulse)."""
    cat = F.coalesce(F.col("category"), F.lit("categoria desconhecida"))
    return checked.filter(F.col("alert_type").isNotNull()).select(
        F.col("id").alias("alert_id"), F.col("id").alias("transaction_id"), "user_id", "alert_type",
        F.concat(F.lit("Transação de R$"), _money(F.col("amount")), F.lit(" em "), cat).alias("message"),
        F.col("checked_score").alias("risk_score"), F.col("timestamp").alias("created_at"))


def acknowledge(alerts: DataFrame, acks: DataFrame) -> DataFrame:
    """acknowledged / acknowledged_at from an acknowledgement log (latest wins)."""
    last = acks.groupBy("alert_id").agg(F.max("acknowledged_at").alias("acknowledged_at"))
    return (alerts.join(last, "alert_id", "left")
            .withColumn("acknowledged", F.col("acknowledged_at").isNotNull()))


def open_alerts(alerts: DataFrame, limit: int = 10, keys: Sequence[str] = ("user_id",)) -> DataFrame:
    """Unacknowledged alerts, newest first, ``limit`` per key."""
    w = Window.partitionBy(*keys).orderBy(F.col("created_at").desc(), F.col("alert_id").desc())
    return (alerts.filter(~F.col("acknowledged")).withColumn("rank", F.row_number().over(w))
            .filter(F.col("rank") <= limit))


def tx_alerts(alerts: DataFrame, tx: DataFrame) -> DataFrame:
    """Alerts with their transaction (nullable foreign key: left outer)."""
    t = tx.select(F.col("id").alias("transaction_id"), "amount", "category", "merchant")
    return alerts.join(t, "transaction_id", "left")
