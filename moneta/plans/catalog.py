"""Registered queries: key -> (spark, sf_dir) -> DataFrame.

Every query reads the driver's tables (or data Spark derives from them) in
full; nothing is capped or sampled unless the limit is the feature itself.
"""
from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moneta.functions.common import attach_one_row, rnd

from moneta.functions.timecols import hour_risk_multiplier, is_night_guard, is_night_hour
from moneta.functions.text import KEYWORD_RULES
from moneta.operators import dictionary, risk
from moneta.session import checkpoint_dir
from moneta.sources import testdata as td
from moneta.sources.state_table import StateTable

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def register(name: str):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn
    return deco


# --------------------------------------------------------------------- risk
def _scored(spark, sf):
    tx = td.load_transactions(spark, sf)
    return risk.impulse_risk(risk.recent_1h_count(tx))


def _checked(spark, sf):
    return risk.apply_protection(_scored(spark, sf), td.load_settings(spark, sf))


@register("risk_summary")
def q_risk_summary(spark, sf):
    return risk.user_risk_summary(_checked(spark, sf))


@register("is_night_guard")
def q_is_night_guard(spark, sf):
    tx = td.load_transactions(spark, sf)
    return tx.select("id", is_night_guard("timestamp").alias("is_night_guard"),
                     is_night_hour("timestamp").alias("is_night_hour"),
                     hour_risk_multiplier("timestamp").alias("hour_multiplier"))


@register("recent_1h_count")
def q_recent_1h_count(spark, sf):
    return risk.recent_1h_count(td.load_transactions(spark, sf)).select("id", "user_id", "recent_count")


@register("impulse_risk_score")
def q_impulse_risk_score(spark, sf):
    return _scored(spark, sf).select(
        "id", "user_id", "is_night", "risk_score", "is_high_risk",
        F.array_join(F.transform("risk_factors", lambda x: x["factor"]), ",").alias("factor_names"))


@register("risk_recommendation")
def q_risk_recommendation(spark, sf):
    return risk.risk_recommendation(_scored(spark, sf)).select(
        "id", "risk_score", "risk_level", "action", "delay_minutes", "n_questions")


@register("check_transaction")
def q_check_transaction(spark, sf):
    return _checked(spark, sf).select("id", "user_id", "protection_enabled", "bypass_active",
                                      "checked_score", "allowed", "alert_type")


@register("protection_status")
def q_protection_status(spark, sf):
    at = F.lit("2024-01-10 03:30:00").cast("timestamp_ntz")
    return risk.protection_status(td.load_settings(spark, sf), at).select(
        "user_id", "enabled", "bypass_active", "is_night_period", "current_hour_risk")


# -------------------------------------------------------------------- spend
from moneta.operators import spend  # noqa: E402


def _tx(spark, sf):
    return td.load_transactions(spark, sf)


@register("spend_summary")
def q_spend_summary(spark, sf):
    return spend.spend_summary(_tx(spark, sf))


@register("tx_summary")
def q_tx_summary(spark, sf):
    return spend.tx_summary(_tx(spark, sf))


@register("tx_summary_by_category")
def q_tx_summary_by_category(spark, sf):
    return spend.tx_summary_by_category(_tx(spark, sf))


@register("by_category")
def q_by_category(spark, sf):
    return spend.by_category(_tx(spark, sf))


@register("by_weekday")
def q_by_weekday(spark, sf):
    return spend.by_weekday(_tx(spark, sf))


@register("by_period")
def q_by_period(spark, sf):
    return spend.by_period(_tx(spark, sf))


@register("by_week_of_month")
def q_by_week_of_month(spark, sf):
    return spend.by_week_of_month(_tx(spark, sf))


@register("daily_spend")
def q_daily_spend(spark, sf):
    return spend.daily_spend(_tx(spark, sf)).withColumn("amount", rnd("amount", 2))


@register("fill_calendar")
def q_fill_calendar(spark, sf):
    # date-only transactions (orders): sparse days per customer, many gaps to fill
    d = spend.daily_spend(td.load_order_transactions(spark, sf))
    return spend.fill_calendar(d).withColumn("amount", rnd("amount", 2))


@register("rolling_mean_7")
def q_rolling_mean_7(spark, sf):
    d = spend.rolling_mean_7(spend.daily_spend(_tx(spark, sf)))
    return d.select("user_id", "date", rnd("amount", 2).alias("amount"),
                    rnd("rolling_mean_7", 6).alias("rolling_mean_7"))


@register("trend")
def q_trend(spark, sf):
    return spend.trend(spend.daily_spend(_tx(spark, sf)))


@register("trend_orders")
def q_trend_orders(spark, sf):
    return spend.trend(spend.daily_spend(td.load_order_transactions(spark, sf)))


@register("kpis")
def q_kpis(spark, sf):
    return spend.kpis(spend.tx_summary(_tx(spark, sf)))


@register("category_share")
def q_category_share(spark, sf):
    return spend.category_share(_tx(spark, sf))


@register("running_balance")
def q_running_balance(spark, sf):
    return spend.running_balance(_tx(spark, sf))


@register("forecast_simple")
def q_forecast_simple(spark, sf):
    return spend.forecast_simple(_tx(spark, sf))


@register("by_decade")
def q_by_decade(spark, sf):
    return spend.by_decade(_tx(spark, sf))


@register("by_decade_orders")
def q_by_decade_orders(spark, sf):
    return spend.by_decade(td.load_order_transactions(spark, sf))


# ------------------------------------------------------ profile, savings, goals
from moneta.operators import goals as goalops  # noqa: E402
from moneta.operators import profile, savings  # noqa: E402


@register("behavior_indicators")
def q_behavior_indicators(spark, sf):
    ind = profile.behavior_indicators(_tx(spark, sf))
    return ind.select("user_id", "n", *[rnd(c, 6).alias(c) for c in ("night_ratio", "tx_per_day",
                                                                       "social_ratio", "cv")])


@register("behavior_profile")
def q_behavior_profile(spark, sf):
    return profile.behavior_profile(profile.behavior_indicators(_tx(spark, sf)))


@register("recurring_merchants")
def q_recurring_merchants(spark, sf):
    return savings.recurring_merchants(_tx(spark, sf))


@register("recurring_merchants_suppliers")
def q_recurring_merchants_suppliers(spark, sf):
    return savings.recurring_merchants(td.supplier_transactions(spark, sf))


@register("savings_suggestions")
def q_savings_suggestions(spark, sf):
    return savings.savings_suggestions(_tx(spark, sf)).select(
        "user_id", "type", "name", "current_spending", "potential_savings", "priority", "rank", "action")


@register("savings_totals")
def q_savings_totals(spark, sf):
    return savings.savings_totals(_tx(spark, sf))


@register("goal_progress")
def q_goal_progress(spark, sf):
    return goalops.goal_progress(td.load_goals(spark, sf))


@register("goals_by_status")
def q_goals_by_status(spark, sf):
    return goalops.goals_by_status(td.load_goals(spark, sf), "active")


@register("goal_compare")
def q_goal_compare(spark, sf):
    return goalops.goal_compare(_tx(spark, sf), td.load_goals(spark, sf))


@register("goal_impact")
def q_goal_impact(spark, sf):
    return goalops.goal_impact(_tx(spark, sf), td.load_goals(spark, sf))


@register("months_to_goal")
def q_months_to_goal(spark, sf):
    return goalops.months_to_goal(td.load_goals(spark, sf), savings.savings_totals(_tx(spark, sf)))


# ------------------------------------------------------------ categorisation
from moneta.functions.text import normalize_text  # noqa: E402
from moneta.operators import categorize as cz  # noqa: E402


def _docs(spark, sf):
    return td.table(spark, sf, "documents").select("doc_id", "text", F.col("lang").alias("label"))


@register("normalize_text")
def q_normalize_text(spark, sf):
    n = normalize_text("text")
    return td.table(spark, sf, "documents").select(
        "doc_id", F.md5(n).alias("norm_md5"), F.char_length(n).alias("norm_len"))


@register("categorize_rules")
def q_categorize_rules(spark, sf):
    d = td.table(spark, sf, "documents").select("doc_id", "text")
    return cz.categorize_rules(d, "text").select(
        "doc_id", "rule_category", rnd("rule_confidence", 6).alias("rule_confidence"), "rule_matches")


@register("categorize_rules_tx")
def q_categorize_rules_tx(spark, sf):
    tx = _tx(spark, sf).select("id", "description", "merchant")
    return cz.categorize_rules(tx, "description", "merchant").select(
        "id", "rule_category", rnd("rule_confidence", 6).alias("rule_confidence"), "rule_matches")


@register("suggest_categories")
def q_suggest_categories(spark, sf):
    d = td.table(spark, sf, "documents").select("doc_id", "text")
    return cz.category_suggestions(d, "text").select(
        "doc_id", F.array_join("suggestions", ",").alias("suggestions"))


@register("suggest_categories_merchants")
def q_suggest_categories_merchants(spark, sf):
    # partial texts typed by a user: short merchant names (both containment directions matter)
    s = td.table(spark, sf, "supplier").select("s_suppkey", F.lower(F.split("s_name", "#")[0]).alias("text"))
    return cz.category_suggestions(s, "text").select(
        "s_suppkey", F.array_join("suggestions", ",").alias("suggestions"))


def _dictionary(spark):
    """The keyword rules as a table."""
    rows = [(name, i, kw) for i, (name, kws) in enumerate(KEYWORD_RULES.items()) for kw in kws]
    return spark.createDataFrame(rows, "category string, place int, keyword string")


@register("suggest_categories_dictionary")
def q_suggest_categories_dictionary(spark, sf):
    """``suggest_categories`` with the rules as a table, by the trigram index."""
    d = td.table(spark, sf, "documents").select("doc_id", "text")
    return dictionary.suggest_from_dictionary(d, _dictionary(spark)).select("doc_id", F.array_join("suggestions", ",").alias("suggestions"))


@register("suggest_categories_dictionary_merchants")
def q_suggest_categories_dictionary_merchants(spark, sf):
    s = td.table(spark, sf, "supplier").select("s_suppkey", F.lower(F.split("s_name", "#")[0]).alias("text"))
    return dictionary.suggest_from_dictionary(s, _dictionary(spark)).select("s_suppkey", F.array_join("suggestions", ",").alias("suggestions"))


def _nb_model(spark, sf):
    return cz.nb_train(_docs(spark, sf))


@register("nb_vocabulary")
def q_nb_vocabulary(spark, sf):
    return _nb_model(spark, sf).vocab.select("term", "df", "tf_total", rnd("idf", 6).alias("idf"))


@register("nb_log_probs")
def q_nb_log_probs(spark, sf):
    return _nb_model(spark, sf).log_probs.select("label", "term", rnd("log_prob", 6).alias("log_prob"))


@register("nb_priors")
def q_nb_priors(spark, sf):
    return cz.class_priors(_docs(spark, sf)).select("label", "n_docs", rnd("log_prior", 6).alias("log_prior"))


@register("nb_predict")
def q_nb_predict(spark, sf):
    d = _docs(spark, sf)
    return cz.nb_predict(_nb_model(spark, sf), d).select(
        "doc_id", "predicted", rnd("confidence", 6).alias("confidence"))


@register("nb_train_accuracy")
def q_nb_train_accuracy(spark, sf):
    d = _docs(spark, sf)
    return cz.nb_accuracy(cz.nb_predict(_nb_model(spark, sf), d), d).select(
        rnd("accuracy", 6).alias("accuracy"), "n_docs")


@register("categorize")
def q_categorize(spark, sf):
    d = _docs(spark, sf)
    return cz.categorize(d, _nb_model(spark, sf)).select(
        "doc_id", "category", rnd("confidence", 6).alias("confidence"), "method")


# ------------------------------------------------------------------ anomaly
from moneta.operators import anomaly as an  # noqa: E402


def _feats(spark, sf):
    return an.anomaly_features(_tx(spark, sf))


def _heur(spark, sf):
    return an.anomaly_heuristic(_tx(spark, sf))


@register("anomaly_features")
def q_anomaly_features(spark, sf):
    return _feats(spark, sf).select("id", "user_id", F.col("f_amount").alias("amount"), *an.FEATURES[1:])


@register("label_encode")
def q_label_encode(spark, sf):
    return an.label_encoder(_tx(spark, sf))


@register("standardize")
def q_standardize(spark, sf):
    z = an.standardize(_feats(spark, sf))
    return z.select("id", "user_id", *[rnd(f"z_{c}", 6).alias(f"z_{c}") for c in an.FEATURES])


@register("anomaly_heuristic")
def q_anomaly_heuristic(spark, sf):
    return _heur(spark, sf).select("id", "user_id", rnd("anomaly_score", 6).alias("anomaly_score"), "is_anomaly",
                                   F.array_join("anomaly_reasons", "|").alias("reasons"))


@register("anomaly_reasons")
def q_anomaly_reasons(spark, sf):
    feats = _feats(spark, sf)
    ref = an.feature_stats(feats, sample=True)
    h = _heur(spark, sf).select("id", "anomaly_score", "is_anomaly")
    flagged = feats.select("id", "user_id", "amount", "category", "hour", "is_weekend").join(h, "id")
    r = an.anomaly_reasons(flagged, ref)
    return r.filter("is_anomaly").select("id", "user_id", F.array_join("anomaly_reasons", "|").alias("reasons"))


@register("normalize_scores")
def q_normalize_scores(spark, sf):
    n = an.normalize_scores(_heur(spark, sf), "anomaly_score")
    return n.select("id", "user_id", rnd("score_normalized", 6).alias("score_normalized"))


@register("anomaly_summary")
def q_anomaly_summary(spark, sf):
    return an.anomaly_summary(_heur(spark, sf))


@register("anomaly_by_category")
def q_anomaly_by_category(spark, sf):
    return an.anomaly_by_category(_heur(spark, sf))


@register("anomaly_by_hour")
def q_anomaly_by_hour(spark, sf):
    return an.anomaly_by_hour(_heur(spark, sf))


@register("top_anomalies")
def q_top_anomalies(spark, sf):
    t = an.top_anomalies(_heur(spark, sf))
    return t.select("user_id", "rank", "id", rnd("anomaly_score", 6).alias("anomaly_score"))


# ----------------------------------------------------------- isolation forest
from moneta.operators import iforest  # noqa: E402
from moneta.plans import anomaly_report as ar  # noqa: E402


@register("isolation_forest_score")
def q_isolation_forest_score(spark, sf):
    d = ar.detect_anomalies(_tx(spark, sf), keys=())
    return d.select("id", "user_id", "is_anomaly", rnd("anomaly_score", 6).alias("anomaly_score"),
                    rnd("decision", 9).alias("decision"), F.array_join("anomaly_reasons", "|").alias("reasons"))


@register("isolation_forest_by_user")
def q_isolation_forest_by_user(spark, sf):
    d = ar.detect_anomalies(_tx(spark, sf), keys=("user_id",))
    return d.select("id", "user_id", "is_anomaly", rnd("anomaly_score", 6).alias("anomaly_score"),
                    F.array_join("anomaly_reasons", "|").alias("reasons"))


@register("anomaly_report")
def q_anomaly_report(spark, sf):
    return ar.anomaly_report(_tx(spark, sf), keys=())


# ------------------------------------------------------------- interventions
from moneta.operators import interventions as iv  # noqa: E402


def _iv(spark, sf):
    return iv.generate_intervention(_scored(spark, sf), td.load_goals(spark, sf))


@register("intervention_level")
def q_intervention_level(spark, sf):
    return _scored(spark, sf).select("id", "risk_score", iv.intervention_level(F.col("risk_score")).alias("level"))


@register("intervention_questions")
def q_intervention_questions(spark, sf):
    return _iv(spark, sf).select("id", F.array_join("questions", "|").alias("questions"))


@register("intervention_impact")
def q_intervention_impact(spark, sf):
    return _iv(spark, sf).select("id", "daily_food", "subscriptions", "investment", "work_hours")


@register("intervention_alternatives")
def q_intervention_alternatives(spark, sf):
    return _iv(spark, sf).select("id", F.array_join("alternatives", "|").alias("alternatives"))


@register("intervention_delay")
def q_intervention_delay(spark, sf):
    return _iv(spark, sf).select("id", "delay_minutes", "delay_expires_at", "delay_message")


@register("intervention_block")
def q_intervention_block(spark, sf):
    return _iv(spark, sf).select("id", "block_reason")


@register("intervention_message")
def q_intervention_message(spark, sf):
    return _iv(spark, sf).select("id", "main_message", F.array_join("actions", ",").alias("actions"))


@register("generate_intervention")
def q_generate_intervention(spark, sf):
    return _iv(spark, sf).select("id", "user_id", "level", "components")


@register("intervention_stats")
def q_intervention_stats(spark, sf):
    return iv.intervention_stats(_iv(spark, sf))


# ----------------------------------------------- notifications, alerts, state
from moneta.operators import notifications as nt  # noqa: E402
from moneta.operators import state  # noqa: E402

AS_OF = "2024-01-31 00:00:00"


def _events(spark, sf):
    return td.table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type", "value", "props")


@register("weekly_totals")
def q_weekly_totals(spark, sf):
    return spend.weekly_totals(_tx(spark, sf))


def _notifications(spark, sf):
    """Every template's notifications: transactions are scored once for the three that they make,
    goals are read once for theirs."""
    tx = _tx(spark, sf)
    scored = risk.impulse_risk(risk.recent_1h_count(an.anomaly_heuristic(tx)))
    scored = iv.generate_intervention(risk.apply_protection(scored, td.load_settings(spark, sf)))
    amount = F.col("amount")
    of_tx = nt.notify_from_templates(scored, {
        "night_alert": (F.col("alert_type") == "night", {"amount": amount, "hour": F.hour("timestamp")}),
        "anomaly_detected": (F.col("is_anomaly"), {"amount": amount, "category": F.col("category"), "score": F.col("anomaly_score").cast("int")}),
        "impulse_blocked": (F.col("level") == "critical", {"amount": amount, "reason": F.col("block_reason")}),
    }, F.col("id"), F.col("timestamp"))
    at = F.lit(AS_OF).cast("timestamp_ntz")
    of_goals = nt.notify_from_templates(td.load_goals(spark, sf), {
        "goal_progress": (F.col("status") == "active", {
            "percent": F.col("current_amount") / F.col("target_amount") * 100, "goal_name": F.col("name"),
            "remaining": F.col("target_amount") - F.col("current_amount")}),
        "goal_achieved": (F.col("status") == "completed", {"goal_name": F.col("name")}),
    }, F.col("goal_id"), at)
    tips = savings.savings_suggestions(tx, top=1)
    tips = nt.notify_from_template(tips, "savings_tip", {"tip": F.col("suggestion")}, F.col("user_id"), at)
    wk = spend.weekly_totals(tx)
    comp = (F.when(F.col("previous_total").isNull(), F.lit("Primeira semana registrada."))
            .when(F.col("total") > F.col("previous_total"),
                  F.format_string("Acima da semana anterior (R$ %.2f).", F.col("previous_total")))
            .otherwise(F.format_string("Abaixo ou igual à semana anterior (R$ %.2f).", F.col("previous_total"))))
    weeks = nt.notify_from_template(wk, "weekly_summary", {"total": F.col("total"), "comparison": comp},
                                    F.concat_ws("|", F.col("user_id").cast("string"), F.col("week").cast("string")),
                                    F.col("week").cast("timestamp_ntz") + F.expr("INTERVAL 7 DAYS"))
    return of_tx.unionByName(of_goals).unionByName(tips).unionByName(weeks)


def _read_notifications(spark, sf):
    """The notifications are made once: the read log and both passes of ``resolve_reads`` start from them."""
    checkpoint_dir(spark)
    n = _notifications(spark, sf).select("notification_id", "user_id", "category", "created_at").checkpoint()
    reads = n.filter(F.substring("notification_id", 1, 1).isin("0", "1", "2", "3")).select(
        "notification_id", (F.col("created_at") + F.expr("INTERVAL 1 HOUR")).alias("read_at"))
    return nt.resolve_reads(n, reads, td.mark_all_read_log(_events(spark, sf)))


@register("notify_from_template")
def q_notify_from_template(spark, sf):
    return _notifications(spark, sf).select(*nt.NOTIF_COLS)


@register("mark_read")
def q_mark_read(spark, sf):
    return _read_notifications(spark, sf).select("notification_id", "user_id", "read", "read_at")


@register("unread_count")
def q_unread_count(spark, sf):
    return nt.unread_count(_read_notifications(spark, sf))


@register("filter_notifications")
def q_filter_notifications(spark, sf):
    return nt.filter_notifications(_read_notifications(spark, sf), unread_only=True).select(
        "user_id", "rank", "notification_id", "category", "created_at")


@register("notification_retention")
def q_notification_retention(spark, sf):
    return nt.retain_newest(_notifications(spark, sf)).select("notification_id", "user_id", "created_at")


def _alert_log(spark, sf):
    """Alerts and their acknowledgements."""
    al = nt.alerts_from_risk(_checked(spark, sf))
    acks = (al.filter(F.col("alert_id") % 3 == 0)
            .select("alert_id", (F.col("created_at") + F.expr("INTERVAL 30 MINUTES")).alias("acknowledged_at"))
            .unionByName(al.filter(F.col("alert_id") % 6 == 0).select(
                "alert_id", (F.col("created_at") + F.expr("INTERVAL 2 HOURS")).alias("acknowledged_at"))))
    return al, acks


def _alerts(spark, sf):
    return nt.acknowledge(*_alert_log(spark, sf))


@register("alerts_from_risk")
def q_alerts_from_risk(spark, sf):
    return nt.alerts_from_risk(_checked(spark, sf))


@register("acknowledge_alerts")
def q_acknowledge_alerts(spark, sf):
    return _alerts(spark, sf).select("alert_id", "user_id", "acknowledged", "acknowledged_at")


@register("open_alerts")
def q_open_alerts(spark, sf):
    return nt.open_alerts(_alerts(spark, sf)).select("user_id", "rank", "alert_id", "alert_type", "risk_score")


@register("tx_alerts")
def q_tx_alerts(spark, sf):
    return nt.tx_alerts(_alerts(spark, sf), _tx(spark, sf)).select(
        "alert_id", "transaction_id", "alert_type", "amount", "category", "merchant")


@register("goal_updates")
def q_goal_updates(spark, sf):
    return state.goal_updates(td.load_goals(spark, sf), td.goal_update_log(_events(spark, sf)))


@register("profile_upsert")
def q_profile_upsert(spark, sf):
    base = td.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("user_id"), F.col("c_name").alias("username"),
        F.lit(True).alias("night_protection_enabled"), F.lit(None).cast("double").alias("daily_limit"),
        F.lit(None).cast("double").alias("monthly_limit"))
    up = td.profile_update_log(_events(spark, sf)).withColumn("username", F.lit(None).cast("string"))
    out = state.upsert(base, up, ["user_id"], "ts",
                       ["username", "night_protection_enabled", "daily_limit", "monthly_limit"])
    return out.select("user_id", "username", "night_protection_enabled",
                      rnd("daily_limit", 2).alias("daily_limit"), rnd("monthly_limit", 2).alias("monthly_limit"))


def _halves(log, ts="ts"):
    """A log cut at its middle time, later half first: what arrives second is older."""
    lo, hi = log.agg(F.min(ts), F.max(ts)).first()
    if lo is None:
        return [log]
    late = F.coalesce(F.col(ts) >= F.lit(lo + (hi - lo) / 2), F.lit(True))
    return [log.filter(late), log.filter(~late)]


def _state(spark, name, key, columns, base, log, latest=(), highest=(), ts="ts"):
    """``base`` and ``log`` as a state table: half of the log, a compaction, the other half."""
    t = StateTable(spark, scratch(spark, name), key, "bigint", columns, latest=latest, highest=highest).start(base)
    parts = _halves(log, ts)
    t.append(parts[0], ts).compact()
    for p in parts[1:]:
        t.append(p, ts)
    return t


@register("profile_state")
def q_profile_state(spark, sf):
    """``profile_upsert`` from a snapshot with compacted changes."""
    base = td.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("user_id"), F.col("c_name").alias("username"), F.lit(True).alias("night_protection_enabled"))
    columns = {"username": "string", "night_protection_enabled": "boolean", "daily_limit": "double", "monthly_limit": "double"}
    t = _state(spark, "profiles", "user_id", columns, base, td.profile_update_log(_events(spark, sf)), latest=list(columns)[1:])
    return t.read().select("user_id", "username", "night_protection_enabled",
                           rnd("daily_limit", 2).alias("daily_limit"), rnd("monthly_limit", 2).alias("monthly_limit"))


@register("goal_state")
def q_goal_state(spark, sf):
    """``goal_updates`` from a snapshot with compacted changes; the highest amount says whether a goal was ever reached."""
    columns = {"user_id": "bigint", "name": "string", "target_amount": "double", "current_amount": "double", "status": "string", "best": "double"}
    log = td.goal_update_log(_events(spark, sf)).select("goal_id", "ts", F.col("amount").alias("current_amount"), F.col("amount").alias("best"))
    t = _state(spark, "goals", "goal_id", columns, td.load_goals(spark, sf), log, latest=["current_amount"], highest=["best"])
    rows = t.read(with_times=True).filter(F.col("target_amount").isNotNull())  # updates of unknown goals make none
    done = (F.col("status") == "completed") | F.coalesce(F.col("best") >= F.col("target_amount"), F.lit(False))
    return rows.select("goal_id", "user_id", "name", "target_amount", "current_amount",
                       F.when(done, F.lit("completed")).otherwise(F.col("status")).alias("status"), F.col("_at_current_amount").alias("updated_at"))


@register("ack_state")
def q_ack_state(spark, sf):
    """``acknowledge_alerts`` from a snapshot with compacted acknowledgements."""
    al, acks = _alert_log(spark, sf)
    log = acks.withColumn("ts", F.col("acknowledged_at"))
    t = _state(spark, "alerts", "alert_id", {"user_id": "bigint", "acknowledged_at": "timestamp_ntz"}, al, log, highest=["acknowledged_at"])
    return t.read().select("alert_id", "user_id", F.col("acknowledged_at").isNotNull().alias("acknowledged"), "acknowledged_at")


@register("delay_status")
def q_delay_status(spark, sf):
    d = iv.generate_intervention(_scored(spark, sf)).filter(F.col("delay_minutes").isNotNull()).select(
        "user_id", F.col("id").alias("transaction_id"), F.col("timestamp").alias("set_at"),
        F.col("delay_expires_at").alias("expires_at"), F.col("delay_minutes").alias("minutes"))
    return state.delay_status(d, F.lit("2024-01-15 12:00:00").cast("timestamp_ntz"))


# ------------------------------------------------------------- files, sinks
import uuid  # noqa: E402

from moneta.sources import bank_csv, extraction, files, ofx, sinks  # noqa: E402


def scratch(spark, name: str) -> str:
    """A fresh folder under the shared checkpoint folder for files a query writes."""
    return f"{checkpoint_dir(spark).rstrip('/')}/moneta-files/{name}-{uuid.uuid4().hex}"


def _bank_csv_import(spark, sf, locale=None):
    """Transactions written as statements in three layouts and encodings, read back as one folder."""
    path = scratch(spark, "bank_csv")
    tx = _tx(spark, sf)
    odd = F.col("id") % 97 == 0
    signed = F.when(F.col("transaction_type") == "credito", F.col("amount")).otherwise(-F.col("amount"))
    valor = (F.when(odd, F.concat(F.lit("R$ 1."), F.lpad(F.replace(F.format_string("%.2f", F.abs(signed)),
                                                                  F.lit("."), F.lit(",")), 6, "0")))
             .otherwise(F.concat(F.lit("R$ "), F.replace(F.format_string("%.2f", signed), F.lit("."), F.lit(",")))))
    d = tx.select("id", F.date_format("date", "dd/MM/yyyy").alias("Data"), F.col("description").alias("Descricao"),
                  valor.alias("Valor"), F.lit("açougue").alias("Obs"))
    part = lambda i, *cols: d.filter(F.col("id") % 3 == i).select(*cols).write.option("header", True)
    part(0, "Data", "Descricao", "Valor").option("sep", ";").csv(f"{path}/a")
    part(1, "Obs", F.col("Valor").alias("Amount"), F.col("Descricao").alias("Historico"),
         F.col("Data").alias("Dt")).option("encoding", "ISO-8859-1").csv(f"{path}/b")  # amounts hold a comma: quoted
    part(2, F.col("Valor").alias(" VLR "), F.col("Descricao").alias("DESC"), "Data").option("sep", "\t").csv(f"{path}/c")
    return bank_csv.read_bank_csv(spark, path, locale=locale)


@register("import_bank_csv")
def q_import_bank_csv(spark, sf):
    return _bank_csv_import(spark, sf).rows


@register("import_bank_csv_rejects")
def q_import_bank_csv_rejects(spark, sf):
    return _bank_csv_import(spark, sf).rejects


@register("import_bank_csv_pt_br")
def q_import_bank_csv_pt_br(spark, sf):
    return _bank_csv_import(spark, sf, locale="pt_BR").rows


@register("import_ofx")
def q_import_ofx(spark, sf):
    path = scratch(spark, "ofx")
    ofx.render_ofx_docs(_tx(spark, sf)).write.text(path)
    return ofx.read_ofx(spark, path, whole_files=False).drop("doc_path")


def _orders(spark, sf):
    return td.table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")


@register("flatten_receipt")
def q_flatten_receipt(spark, sf):
    li = td.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice",
                                                "l_quantity")
    rec = extraction.render_receipts(_orders(spark, sf), li)
    return extraction.flatten_receipt(rec).select(
        "doc_id", "raw_text", "data", rnd("valor_total", 2).alias("valor_total"), "estabelecimento",
        "item_pos", "item_descricao", rnd("item_valor", 2).alias("item_valor"), "item_quantidade")


@register("merge_bill_pages")
def q_merge_bill_pages(spark, sf):
    pages = extraction.render_bill_pages(_orders(spark, sf))
    m = extraction.merge_bill_pages(pages)
    return m.select("doc_id", "page", "pos", "banco", "mes_referencia", "vencimento",
                    rnd("valor_total", 2).alias("valor_total"), rnd("valor_minimo", 2).alias("valor_minimo"),
                    "data", "descricao", rnd("valor", 2).alias("valor"))


@register("route_by_format")
def q_route_by_format(spark, sf):
    base = scratch(spark, "uploads")
    tx = _tx(spark, sf)
    lines = bank_csv.render_bank_csv_lines(tx)
    lines.write.csv(f"{base}/csv")                       # .csv: routed to the CSV reader
    ofx.render_ofx_docs(tx).write.text(f"{base}/ofx")    # .txt: not an allowed upload
    tx.select("id", "amount").write.json(f"{base}/json")  # .json: not an allowed upload
    r = files.route_by_format(spark, base)
    return r.groupBy("extension", "allowed", "reader").agg(F.count(F.lit(1)).alias("n_files"))


@register("route_uploads")
def q_route_uploads(spark, sf):
    """One upload per document, named by its id in eight formats, with a kilobyte for each byte of its text."""
    kinds = F.array(*map(F.lit, ["csv", "ofx", "PDF", "png", "jpg", "JPEG", "txt", "json"]))
    up = td.table(spark, sf, "documents").select("doc_id", F.concat(
        F.lit("uploads/user.1/statement-"), F.col("doc_id"), F.lit("."), F.get(kinds, (F.col("doc_id") % 8).cast("int"))).alias("path"),
        (F.octet_length("text") * 1024).cast("long").alias("length"))
    return files.route_files(up).select("doc_id", "extension", "allowed", "reader")


def _store(spark, sf):
    path = scratch(spark, "store")
    sinks.append_transactions(_tx(spark, sf).select("id", "user_id", "date", "timestamp", "amount", "merchant",
                                                    "description", "category"), path)
    return path


@register("append_transactions")
def q_append_transactions(spark, sf):
    return spark.read.parquet(_store(spark, sf)).select(
        "id", "user_id", "date", "amount", "transaction_type", "is_night", "risk_score", "source", "year_month")


@register("scan_transactions")
def q_scan_transactions(spark, sf):
    s = sinks.scan_transactions(spark, _store(spark, sf), start="2024-01-10", end="2024-01-20",
                                category="delivery", limit=100)
    return s.select("id", "user_id", "date", "amount", "category")


# -------------------------------------------------------- forecasts, clusters
from moneta.operators import clusters as cl  # noqa: E402
from moneta.operators import forecast as fc  # noqa: E402


@register("forecast_hw_fixed")
def q_forecast_hw_fixed(spark, sf):
    return fc.forecast_hw_fixed(_tx(spark, sf))


@register("forecast_hw")
def q_forecast_hw(spark, sf):
    daily, _ = fc.forecast_hw(_tx(spark, sf))
    return daily.select("user_id", "h", "date", "predicted", "lower", "upper")


@register("forecast_hw_summary")
def q_forecast_hw_summary(spark, sf):
    return fc.forecast_hw(_tx(spark, sf))[1]


@register("spend_clusters")
def q_spend_clusters(spark, sf):
    out, _ = cl.spend_clusters(_tx(spark, sf))
    return out.select("id", "user_id", "cluster")


@register("describe_clusters")
def q_describe_clusters(spark, sf):
    out, _ = cl.spend_clusters(_tx(spark, sf))
    return cl.describe_clusters(out)


# Given centres for the twin of one iteration: start -> centres of (amount, hour, weekday), standardised
GIVEN_CENTRES = {0: [[-0.5, -1.0, -1.0], [-0.5, 1.0, 0.5], [0.5, -1.0, 1.0], [2.0, 0.25, 0.0]],
                 1: [[0.0, 0.0, -1.5], [0.0, 0.0, 1.5], [1.0, 1.0, 0.0], [-1.0, -1.0, 0.0]]}


@register("kmeans_step")
def q_kmeans_step(spark, sf):
    """One k-means iteration of two given starts over all transactions."""
    z = [f"z_{c}" for c in cl.FEATS]
    step = cl.lloyd_step(cl.cluster_features(_tx(spark, sf)), {s: np.array(c) for s, c in GIVEN_CENTRES.items()}, z)
    return step.select("start", "cluster", "n", rnd("cost", 4).alias("cost"),
                       *[rnd(F.col(f"s{j}") / F.col("n"), 6).alias(f"new_{c}") for j, c in enumerate(cl.FEATS)])


@register("describe_given_clusters")
def q_describe_given_clusters(spark, sf):
    """The description of given clusters: amounts in steps of 40."""
    tx = _tx(spark, sf).withColumn("hour", F.hour("timestamp"))
    return cl.describe_clusters(tx.withColumn("cluster", F.least(F.floor(F.col("amount") / 40), F.lit(3)).cast("int")))


# ---------------------------------------------------------------- streaming
from moneta.streaming import risk_stream as rs  # noqa: E402


def _replay(spark, sf, plan, sink=None):
    """The events table as a stream of transactions through ``plan``; the folder of the replay."""
    base = scratch(spark, "stream")
    ev = td.table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type", "value", "props")
    rs.feed(rs.time_slices(ev, "ts", at=f"{base}/slices"), base, lambda s: plan(td.transactions_from_events(s)), sink and sink(f"{base}/out"))
    return f"{base}/out"


@register("stream_risk")
def q_stream_risk(spark, sf):
    return spark.read.parquet(_replay(spark, sf, lambda tx: rs.stream_risk(tx).select(
        "id", "user_id", "recent_count", "risk_score", "is_high_risk")))


@register("stream_daily")
def q_stream_daily(spark, sf):
    return spark.read.parquet(_replay(spark, sf, rs.stream_daily)).select("user_id", "date", rnd("amount", 2).alias("amount"), "n")


@register("stream_alerts")
def q_stream_alerts(spark, sf):
    return spark.read.parquet(_replay(spark, sf, rs.stream_risk, rs.alerts_sink)).select("id", "user_id", "risk_score", "alert_type")


# ------------------------------------------------------------------ extras
@register("behavior_profile_details")
def q_behavior_profile_details(spark, sf):
    d = profile.profile_details(profile.behavior_profile(profile.behavior_indicators(_tx(spark, sf))))
    return d.select("user_id", "profile", "description", "risk_level",
                    F.array_join(F.coalesce("suggestions", F.array()), "|").alias("suggestions"))


@register("by_decade_wide")
def q_by_decade_wide(spark, sf):
    w = spend.by_decade_wide(_tx(spark, sf))
    return w.select("user_id", "year_month", *[F.col(f"{d}_{m}").alias(f"{m}_{d}") for d in ("1_10", "11_20", "21_31")
                                               for m in ("receipts", "payments")])


@register("zscore_amount")
def q_zscore_amount(spark, sf):
    return spend.zscore_amount(_tx(spark, sf)).select("id", "user_id", rnd("z", 6).alias("z"))


@register("budget_usage")
def q_budget_usage(spark, sf):
    limits = q_profile_upsert(spark, sf).filter(F.col("monthly_limit").isNotNull())
    return spend.budget_usage(_tx(spark, sf), limits)


@register("merge_statement_pages")
def q_merge_statement_pages(spark, sf):
    m = extraction.merge_statement_pages(extraction.render_statement_pages(_tx(spark, sf)))
    return m.select("doc_id", "page", "pos", "banco", "conta", rnd("saldo_final", 2).alias("saldo_final"),
                    "data", "descricao", rnd("valor", 2).alias("valor"), "tipo", "categoria_sugerida")


@register("nb_model_roundtrip")
def q_nb_model_roundtrip(spark, sf):
    path = scratch(spark, "nb_model")
    _nb_model(spark, sf).persist(path)
    m = cz.NBModel.load(spark, path)
    return m.log_probs.select("label", "term", rnd("log_prob", 6).alias("log_prob"))


@register("stream_delays")
def q_stream_delays(spark, sf):
    base = scratch(spark, "delays")
    # only the level and its delay are needed here, not the whole intervention
    d = (iv.delay(iv.with_context(_scored(spark, sf))).filter(F.col("delay_minutes").isNotNull())
         .select("user_id", F.col("id").alias("transaction_id"), F.col("timestamp").alias("set_at"),
                 F.col("delay_expires_at").alias("expires_at"))).checkpoint(eager=True)
    rs.feed(rs.time_slices(d, "set_at", at=f"{base}/slices"), base, rs.stream_delays)
    return spark.read.parquet(f"{base}/out")


# ------------------------------------------------- inventory ids of their own
@register("detect_anomalies")
def q_detect_anomalies(spark, sf):
    d = ar.detect_anomalies(_tx(spark, sf), keys=())
    return d.select("id", "user_id", "is_anomaly", rnd("anomaly_score", 6).alias("anomaly_score"), "method")


@register("isolation_forest_fit")
def q_isolation_forest_fit(spark, sf):
    feats = an.standardize(an.anomaly_features(_tx(spark, sf), keys=()), keys=())
    nodes = iforest.fit_nodes(feats, ar.ZCOLS)
    return nodes.groupBy("tree").agg(F.count(F.lit(1)).alias("n_nodes"),
                                     F.sum((F.col("feature") < 0).cast("int")).alias("n_leaves"),
                                     F.max("psi").alias("psi"))


@register("newest_n")
def q_newest_n(spark, sf):
    return _tx(spark, sf).orderBy(F.col("date").desc(), F.col("id").desc()).limit(100).select(
        "id", "user_id", "date", "amount")


@register("write_notifications")
def q_write_notifications(spark, sf):
    path = scratch(spark, "notifications")
    n = _notifications(spark, sf).select(*nt.NOTIF_COLS)
    half = F.pmod(F.xxhash64("notification_id"), F.lit(2))
    nt.write_notifications(n.filter(half == 0), path)  # retention holds over both appends
    return nt.write_notifications(n.filter(half == 1), path).select("notification_id", "user_id", "created_at")


@register("parse_extraction_json")
def q_parse_extraction_json(spark, sf):
    li = td.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice",
                                                "l_quantity")
    rec = extraction.render_receipts(_orders(spark, sf), li)
    p = extraction.parse_extraction(rec, extraction.RECEIPT)
    return p.select("doc_id", F.col("parsed").isNotNull().alias("parsed_ok"), "raw_text",
                    F.size(F.coalesce("parsed.itens", F.array())).alias("n_items"))


@register("intervention_payload")
def q_intervention_payload(spark, sf):
    p = iv.intervention_payload(_scored(spark, sf), td.load_goals(spark, sf))
    c = p.select("id", "user_id", F.posexplode("components").alias("pos", "c"))
    first = F.get("c.comparisons", F.lit(0))
    return c.select("id", "user_id", "pos", "c.type", F.array_join("c.content", "|").alias("content"),
                    F.size(F.coalesce("c.comparisons", F.array())).alias("n_goals"),
                    first["message"].alias("goal_message"), first["this_purchase_percent"].alias("goal_percent"),
                    "c.minutes", "c.expires_at")


@register("guard_state")
def q_guard_state(spark, sf):
    at = F.lit(AS_OF).cast("timestamp_ntz")
    g = state.guard_state(td.guard_log(_events(spark, sf)), at)
    return risk.protection_status(g, at).select("user_id", "enabled", "bypass_active", "bypass_until")


@register("create_notification")
def q_create_notification(spark, sf):
    tx = _tx(spark, sf)
    return nt.create_notification(
        tx, F.lit("Compra registrada"), F.concat(F.lit("Categoria: "), F.col("category")), F.col("id"), F.col("timestamp"),
        F.when(F.col("amount") >= 100, "warning").otherwise("other"), F.when(F.col("amount") >= 50, "budget"),
        F.struct("amount")).select(*nt.NOTIF_COLS, F.col("data.amount").alias("amount"))


def _early_spending(tx):
    """What a model is fitted on: the debits up to the median date of all rows (no credit category is among them)."""
    days = tx.groupBy(F.unix_date("date").alias("_d")).count()  # a row a day
    middle = days.agg(F.percentile("_d", 0.5, F.col("count")).alias("_m"))
    return attach_one_row(tx, middle).filter((F.unix_date("date") <= F.col("_m")) & (F.col("transaction_type") == "debito")).drop("_m")


@register("anomaly_model_features")
def q_anomaly_model_features(spark, sf):
    """All rows under the stored encoder and scaler of the earlier half's debits, to which the credits'
    category is unknown (-1)."""
    tx = _tx(spark, sf)
    path = scratch(spark, "feature_model")
    ar.fit_features(_early_spending(tx))[0].persist(path)
    z = ar.model_features(tx, ar.FeatureModel.load(spark, path))
    return z.select("id", "category_encoded", "is_high_amount", *[rnd(f"z_{c}", 6).alias(f"z_{c}") for c in an.FEATURES])


@register("stored_model_scores")
def q_stored_model_scores(spark, sf):
    """All rows scored by a stored model that was fitted on the earlier half's debits."""
    tx = _tx(spark, sf)
    path = scratch(spark, "anomaly_model")
    ar.fit_anomaly_model(_early_spending(tx))[0].persist(path)
    d = ar.detect_anomalies(tx, model=ar.AnomalyModel.load(spark, path))
    return d.select("id", "user_id", "is_anomaly", rnd("anomaly_score", 6).alias("anomaly_score"), rnd("decision", 9).alias("decision"),
                    F.array_join("anomaly_reasons", "|").alias("reasons"))


# A small forest for the scoring's SQL twin: (tree, node, feature, threshold, left, right, value); -1: leaf
GIVEN_FEATURES = ["f_amount", "hour", "day_of_week"]
GIVEN_FOREST = [
    (0, 0, 0, 60.0, 1, 2, 0.0), (0, 1, 1, 6.5, 3, 4, 0.0), (0, 2, -1, 0.0, -1, -1, 2.5), (0, 3, -1, 0.0, -1, -1, 3.25), (0, 4, -1, 0.0, -1, -1, 4.5),
    (1, 0, 2, 4.5, 1, 2, 0.0), (1, 1, -1, 0.0, -1, -1, 4.0), (1, 2, 0, 25.0, 3, 4, 0.0), (1, 3, -1, 0.0, -1, -1, 3.0), (1, 4, -1, 0.0, -1, -1, 2.0),
    (2, 0, 1, 22.5, 1, 2, 0.0), (2, 1, 0, 90.0, 3, 4, 0.0), (2, 2, -1, 0.0, -1, -1, 1.0), (2, 3, -1, 0.0, -1, -1, 4.75), (2, 4, -1, 0.0, -1, -1, 2.25),
]
GIVEN_PSI, GIVEN_OFFSET = 8, -0.5


@register("given_forest_score")
def q_given_forest_score(spark, sf):
    """All rows scored by a given small forest on unscaled features."""
    nodes = pd.DataFrame(GIVEN_FOREST, columns=["tree", "node", "feature", "threshold", "left", "right", "value"]).assign(psi=GIVEN_PSI)
    model = iforest.ForestModel(iforest.FlatForest.from_nodes(nodes), GIVEN_OFFSET, GIVEN_FEATURES, nodes)
    rows = _tx(spark, sf).select("id", F.coalesce("amount", F.lit(0.0)).alias("f_amount"), F.hour("timestamp").alias("hour"),
                                 F.weekday("timestamp").alias("day_of_week"))
    return iforest.score_global(rows, model).select("id", rnd("score_samples", 9).alias("score_samples"),
                                                    rnd("decision", 9).alias("decision"), "is_anomaly")


@register("label_encode_unseen")
def q_label_encode_unseen(spark, sf):
    """Merchants' codes under a dictionary of the earlier half's debits' descriptions: -1 where it has none."""
    tx = _tx(spark, sf)
    return an.label_encode(tx.select("id", "description"), an.label_encoder(_early_spending(tx), "description"), "description",
                           "code_of_description").select("id", "code_of_description")
