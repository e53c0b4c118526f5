"""Savings suggestions by category, recurring merchant and night spending: the top 10
per key, plus per-key totals, both from one base aggregate of the rows."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from moneta import params as P
from moneta.functions.common import rnd

K = ("user_id",)


def recurring_merchants(tx: DataFrame, keys: Sequence[str] = K, min_count: int = 3, top: int = 5) -> DataFrame:
    """Merchants (or descriptions when there is no merchant column) seen at least
    ``min_count`` times; the ``top`` largest totals per key (ties: name).

    The per-key top-k filter is planned as a partial window-group limit before
    the shuffle, so a key with huge row counts ships at most ``top`` rows per map task.
    """
    mcol = "merchant" if "merchant" in tx.columns else "description"
    g = (tx.filter(F.col(mcol).isNotNull()).groupBy(*keys, F.col(mcol).alias("merchant"))
         .agg(F.count(F.lit(1)).alias("frequency"), F.sum("amount").alias("_total"))
         .filter(F.col("frequency") >= min_count))
    w = Window.partitionBy(*keys).orderBy(F.col("_total").desc(), F.col("merchant"))
    return (g.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)
            .select(*keys, "merchant", "frequency", "rank",
                    rnd("_total", 2).alias("total_spent"),
                    rnd(F.col("_total") / F.col("frequency"), 2).alias("avg_transaction"),
                    rnd(F.col("_total") * 0.2, 2).alias("potential_savings")))


#: Bits of grouping_id for the three rollups of the base aggregate (category, merchant, night).
_BY_CATEGORY, _BY_MERCHANT, _BY_NIGHT = 0b011, 0b101, 0b110


def savings_base(tx: DataFrame, keys: Sequence[str] = K, min_count: int = 3, top: int = 5) -> DataFrame:
    """One row per key: ``_all`` (the key's total) and ``_parts``, the sums that suggestions are made of.

    The rows are read once and summed by (key, category, merchant, night), combined map-side.
    Grouping sets roll these sums up by category, by merchant and by night.  Categories that can't be reduced
    are one group and merchants are cut to the ``top`` of each key before they are shuffled, so
    a key's parts are a handful of rows and meet in one array.
    """
    mcol = next((c for c in ("merchant", "description") if c in tx.columns), None)
    none = F.lit(None).cast("string")
    hour = F.hour("timestamp") if "timestamp" in tx.columns else F.lit(None).cast("int")
    cat = F.when(F.col("category").isin(P.REDUCIBLE_CATEGORIES), F.col("category")) if "category" in tx.columns else none
    base = tx.groupBy(*keys, cat.alias("_cat"), (F.col(mcol) if mcol else none).alias("_mer"),
                      ((hour >= 0) & (hour <= 6)).alias("_night")).agg(F.sum("amount").alias("_s"), F.count(F.lit(1)).alias("_c"))
    sets = [[*keys, c] for c in ("_cat", "_mer", "_night")]
    rolled = base.groupingSets(sets, *keys, "_cat", "_mer", "_night").agg(
        F.grouping_id().alias("_g"), F.sum("_s").alias("_s"), F.sum("_c").alias("_c"))
    rolled = rolled.filter((F.col("_g") != _BY_MERCHANT) | (F.col("_mer").isNotNull() & (F.col("_c") >= min_count)))
    w = Window.partitionBy(*keys, "_g").orderBy(F.col("_s").desc(), F.col("_mer"))
    rolled = rolled.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= max(top, len(P.REDUCIBLE_CATEGORIES) + 1))
    rolled = rolled.filter((F.col("_g") != _BY_MERCHANT) | (F.col("_rank") <= top))
    total = F.sum(F.when(F.col("_g") == _BY_NIGHT, F.col("_s")))
    return rolled.groupBy(*keys).agg(total.alias("_all"), F.collect_list(F.struct(
        "_g", "_cat", "_mer", "_night", "_s", "_c", "_rank")).alias("_parts"))


def _suggested(base: DataFrame, target_reduction: float) -> DataFrame:
    """``savings_base`` plus ``_found``: an array of all suggestions of a key."""
    order = F.create_map(*[x for i, c in enumerate(P.REDUCIBLE_CATEGORIES) for x in (F.lit(c), F.lit(i))])
    of = lambda g, more: F.filter("_parts", lambda x: (x["_g"] == g) & more(x))

    def said(kind, name, current, potential, priority, branch, place):
        return F.struct(F.lit(kind).alias("type"), name.alias("name"), rnd(current, 2).alias("current_spending"),
                        rnd(potential, 2).alias("potential_savings"), priority.alias("priority"),
                        F.lit(branch).alias("_b"), place.cast("int").alias("_i"))

    limit = F.col("_all") * target_reduction * 0.2
    cats = F.transform(of(_BY_CATEGORY, lambda x: x["_cat"].isNotNull()), lambda x: said(
        "category_reduction", x["_cat"], x["_s"], x["_s"] * 0.3, F.when(x["_s"] * 0.3 > limit, "alta").otherwise("média"),
        0, F.element_at(order, x["_cat"])))
    merchants = F.transform(of(_BY_MERCHANT, lambda x: F.lit(True)), lambda x: said(
        "recurring_expense", x["_mer"], x["_s"], x["_s"] * 0.2, F.lit("média"), 1, x["_rank"]))
    nights = F.transform(of(_BY_NIGHT, lambda x: F.coalesce(x["_night"], F.lit(False)) & (x["_s"] > F.col("_all") * 0.1)), lambda x: said(
        "behavioral", F.lit("gastos_noturnos"), x["_s"], x["_s"] * 0.5, F.lit("alta"), 2, F.lit(0)))
    return base.withColumn("_found", F.concat(cats, merchants, nights))


def savings_suggestions(tx: DataFrame, keys: Sequence[str] = K, target_reduction: float = 0.1,
                        top: int = 10) -> DataFrame:
    """Top ``top`` suggestions per key by rounded potential (ties keep branch order)."""
    found = _suggested(savings_base(tx, keys), target_reduction)
    ranked = F.array_sort(F.transform("_found", lambda x: F.struct(
        x["potential_savings"].isNull().alias("none"), (-x["potential_savings"]).alias("less"), x["_b"].alias("b"), x["_i"].alias("i"), x.alias("x"))))
    rows = found.select(*keys, F.posexplode(F.slice(ranked, 1, top)).alias("_p", "_x"))
    rows = rows.select(*keys, *[F.col(f"_x.x.{c}").alias(c) for c in ("type", "name", "current_spending", "potential_savings", "priority")],
                       (F.col("_p") + 1).alias("rank"))
    kind = F.col("type")
    return (rows.withColumn("action", F.when(kind == "category_reduction", F.coalesce(
                F.element_at(F.create_map(*[x for k, v in P.CATEGORY_ACTIONS.items()
                                            for x in (F.lit(k), F.lit(v))]), F.col("name")),
                F.lit(P.DEFAULT_CATEGORY_ACTION))))
            .withColumn("suggestion", F.when(kind == "category_reduction",
                                             F.concat(F.lit("Reduza gastos com "), F.col("name"), F.lit(" em 30%")))
                        .when(kind == "recurring_expense",
                              F.concat(F.lit("Você tem gasto recorrente em "), F.col("name")))
                        .otherwise(F.lit("Você gasta significativamente durante a madrugada"))))


def savings_totals(tx: DataFrame, keys: Sequence[str] = K, target_reduction: float = 0.1) -> DataFrame:
    """Total potential over *all* suggestions (not only the top 10), target and
    whether it is achievable."""
    found = _suggested(savings_base(tx, keys), target_reduction)
    p = F.aggregate("_found", F.lit(0.0), lambda a, x: a + F.coalesce(x["potential_savings"], F.lit(0.0)))
    target = F.col("_all") * target_reduction
    return found.select(*keys, rnd(p, 2).alias("total_potential_savings"), rnd(target, 2).alias("target_savings"),
                        (p >= target).alias("achievable"))
