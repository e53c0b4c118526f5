"""DuckDB SQL twins of the registered queries (the correctness oracle).

Each entry reads the driver's views (events, orders, customer, ...) and must
return the same columns and values as the Spark query of the same key.
"""
from __future__ import annotations

# Transactions derived from events — same rule as sources.testdata.transactions_from_events
TX = """tx AS (
  SELECT event_id AS id, user_id, CAST(ts AS DATE) AS date, ts AS "timestamp", value AS amount,
         'Loja ' || json_extract_string(props, '$.k') AS merchant,
         concat_ws(' ', event_type, 'Loja ' || json_extract_string(props, '$.k')) AS description,
         CASE WHEN event_type = 'view' AND event_id % 5 = 0 THEN 'jogos'
              WHEN event_type = 'click' THEN 'delivery'
              WHEN event_type = 'view' THEN 'lazer'
              WHEN event_type = 'purchase' THEN 'compras'
              WHEN event_type = 'signup' THEN 'salário' END AS category,
         CASE WHEN event_type = 'signup' THEN 'credito' ELSE 'debito' END AS transaction_type
  FROM events)"""

OTX = """otx AS (
  SELECT o_orderkey AS id, o_custkey AS user_id, CAST(o_orderdate AS DATE) AS date,
         o_totalprice AS amount,
         CASE o_orderpriority WHEN '1-URGENT' THEN 'jogos' WHEN '2-HIGH' THEN 'delivery'
              WHEN '3-MEDIUM' THEN 'alimentação' WHEN '4-NOT SPECIFIED' THEN 'outros'
              WHEN '5-LOW' THEN 'transporte' END AS category,
         'debito' AS transaction_type
  FROM orders)"""

SETTINGS = """settings AS (
  SELECT c_custkey AS user_id, (c_nationkey % 5 <> 0) AS protection_enabled,
         CASE WHEN c_nationkey % 7 = 0 THEN TIMESTAMP '2024-01-15 00:00:00' END AS bypass_until
  FROM customer)"""

GOALS = """goals AS (
  SELECT c_custkey AS goal_id, c_custkey AS user_id, c_name AS name, 10000.0::DOUBLE AS target_amount,
         greatest(c_acctbal, 0.0::DOUBLE) AS current_amount,
         CASE WHEN c_acctbal < 9000 THEN 'active' ELSE 'completed' END AS status,
         DATE '2024-01-01' + CAST(c_custkey % 365 AS INTEGER) AS deadline
  FROM customer)"""

# micros since midnight, night window [00:00, 06:00] inclusive
NIGHT = ("((hour(\"timestamp\") * 3600 + minute(\"timestamp\") * 60)::BIGINT * 1000000 "
         "+ extract('microseconds' FROM \"timestamp\")) BETWEEN 0 AND 21600000000")
MULT = ("CASE hour(\"timestamp\") WHEN 0 THEN 1.5 WHEN 1 THEN 1.8 WHEN 2 THEN 2.0 WHEN 3 THEN 2.0 "
        "WHEN 4 THEN 1.8 WHEN 5 THEN 1.5 WHEN 6 THEN 1.0 ELSE 1.0 END::DOUBLE")

RECENT = """rc AS (
  SELECT *, count(*) OVER (PARTITION BY user_id ORDER BY "timestamp"
             RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) - 1 AS recent_count
  FROM tx)"""

SCORED = f"""sc0 AS (
  SELECT *, {NIGHT} AS is_night, {MULT} AS hour_multiplier FROM rc),
sc1 AS (
  SELECT *,
    CASE WHEN is_night THEN 30.0::DOUBLE * hour_multiplier END AS s_night,
    CASE WHEN amount >= 100.0 THEN 25.0::DOUBLE * least(amount / 100.0::DOUBLE, 3.0::DOUBLE) END AS s_amount,
    CASE WHEN coalesce(lower(category) IN ('jogos','delivery','lazer','compras','assinaturas'), false)
         THEN CASE WHEN is_night THEN 30.0::DOUBLE ELSE 20.0::DOUBLE END END AS s_cat,
    CASE WHEN recent_count >= 3 THEN least(recent_count * 5, 20)::DOUBLE END AS s_freq
  FROM sc0),
scored AS (
  SELECT *,
    least(CAST(floor(coalesce(s_night, 0.0::DOUBLE) + coalesce(s_amount, 0.0::DOUBLE)
                     + coalesce(s_cat, 0.0::DOUBLE) + coalesce(s_freq, 0.0::DOUBLE)) AS INTEGER), 100) AS risk_score
  FROM sc1),
scored2 AS (SELECT *, risk_score >= 70 AS is_high_risk FROM scored)"""

CHECKED = f"""checked AS (
  SELECT s.*, coalesce(st.protection_enabled, true) AS protection_enabled,
         coalesce(st.protection_enabled, true) AND coalesce(s."timestamp" < st.bypass_until, false) AS bypass_active
  FROM scored2 s LEFT JOIN settings st USING (user_id)),
checked2 AS (
  SELECT *, protection_enabled AND NOT bypass_active AS effective FROM checked),
checked3 AS (
  SELECT *, CASE WHEN effective THEN risk_score ELSE 0 END AS checked_score,
         (NOT effective) OR (NOT is_high_risk) AS allowed,
         CASE WHEN effective AND is_high_risk THEN CASE WHEN is_night THEN 'night' ELSE 'impulse' END END AS alert_type
  FROM checked2)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


RISK_BASE = with_(TX, RECENT, SCORED, SETTINGS, CHECKED)

SQL: dict[str, str] = {}

SQL["risk_summary"] = RISK_BASE + """
SELECT user_id, count(*) AS n_tx,
       sum(CASE WHEN is_high_risk AND effective THEN 1 ELSE 0 END) AS n_high_risk,
       round_even(sum(CASE WHEN is_high_risk AND effective THEN amount ELSE 0.0 END), 2) AS high_risk_value,
       sum(CASE WHEN NOT allowed THEN 1 ELSE 0 END) AS n_blocked,
       max(checked_score) AS max_score,
       sum(CASE WHEN alert_type = 'night' THEN 1 ELSE 0 END) AS n_night_alerts
FROM checked3 GROUP BY user_id"""

SQL["is_night_guard"] = with_(TX) + f"""
SELECT id, {NIGHT} AS is_night_guard, hour("timestamp") <= 6 AS is_night_hour,
       {MULT} AS hour_multiplier
FROM tx"""

SQL["recent_1h_count"] = with_(TX, RECENT) + "SELECT id, user_id, recent_count FROM rc"

SQL["impulse_risk_score"] = with_(TX, RECENT, SCORED) + """
SELECT id, user_id, is_night, risk_score, is_high_risk,
       concat_ws(',', CASE WHEN s_night IS NOT NULL THEN 'horário_noturno' END,
                      CASE WHEN s_amount IS NOT NULL THEN 'valor_alto' END,
                      CASE WHEN s_cat IS NOT NULL THEN 'categoria_risco' END,
                      CASE WHEN s_freq IS NOT NULL THEN 'frequência_alta' END) AS factor_names
FROM scored2"""

SQL["risk_recommendation"] = with_(TX, RECENT, SCORED) + """
SELECT id, risk_score,
       CASE WHEN risk_score < 30 THEN 'low' WHEN risk_score < 50 THEN 'medium'
            WHEN risk_score < 70 THEN 'high' ELSE 'critical' END AS risk_level,
       CASE WHEN risk_score < 30 THEN 'proceed' WHEN risk_score < 50 THEN 'confirm'
            WHEN risk_score < 70 THEN 'delay' ELSE 'block' END AS action,
       CASE WHEN risk_score < 50 THEN 0 WHEN risk_score < 70 THEN 5 ELSE 10 END AS delay_minutes,
       CASE WHEN risk_score < 30 THEN 0 WHEN risk_score < 50 THEN 2 ELSE 3 END AS n_questions
FROM scored2"""

SQL["check_transaction"] = RISK_BASE + """
SELECT id, user_id, protection_enabled, bypass_active, checked_score, allowed, alert_type
FROM checked3"""

SQL["protection_status"] = with_(SETTINGS) + """
SELECT user_id, coalesce(protection_enabled, true) AS enabled,
       coalesce(TIMESTAMP '2024-01-10 03:30:00' < bypass_until, false) AS bypass_active,
       true AS is_night_period, 2.0::DOUBLE AS current_hour_risk
FROM settings"""

# -------------------------------------------------------------------- spend
SQL["spend_summary"] = with_(TX) + """
SELECT user_id, count(*) AS total_transactions, round_even(sum(amount), 2) AS total_spent,
       round_even(avg(amount), 6) AS average_transaction, round_even(median(amount), 6) AS median_transaction,
       round_even(stddev_samp(amount), 6) AS std_transaction
FROM tx GROUP BY user_id"""

_TXS = """txs AS (
  SELECT user_id,
         round_even(sum(CASE WHEN transaction_type = 'credito' THEN amount ELSE 0.0 END), 2) AS total_credito,
         round_even(sum(CASE WHEN transaction_type = 'debito' THEN amount ELSE 0.0 END), 2) AS total_debito,
         count(*) AS count
  FROM tx GROUP BY user_id)"""

SQL["tx_summary"] = with_(TX, _TXS) + """
SELECT *, round_even(total_credito - total_debito, 2) AS saldo FROM txs"""

SQL["tx_summary_by_category"] = with_(TX) + """
SELECT user_id, coalesce(nullif(category, ''), 'outros') AS category, round_even(sum(amount), 2) AS total
FROM tx GROUP BY ALL"""

SQL["by_category"] = with_(TX) + """, g AS (SELECT user_id, sum(amount) AS grand FROM tx GROUP BY user_id),
p AS (SELECT user_id, category, round_even(sum(amount), 2) AS total, round_even(avg(amount), 2) AS media,
             count(*) AS count, round_even(stddev_samp(amount), 2) AS desvio
      FROM tx WHERE category IS NOT NULL GROUP BY user_id, category)
SELECT p.*, round_even(p.total / g.grand * 100, 1) AS percentual FROM p LEFT JOIN g USING (user_id)"""

SQL["by_weekday"] = with_(TX) + """
SELECT user_id, isodow(date) - 1 AS day_of_week, round_even(sum(amount), 2) AS sum,
       round_even(avg(amount), 6) AS mean, count(*) AS count,
       (['Seg','Ter','Qua','Qui','Sex','Sáb','Dom'])[isodow(date)] AS day_name
FROM tx GROUP BY user_id, isodow(date)"""

SQL["by_period"] = with_(TX) + """, a AS (
  SELECT user_id, CASE WHEN hour("timestamp") <= 6 THEN 'Madrugada' WHEN hour("timestamp") <= 12 THEN 'Manhã'
                       WHEN hour("timestamp") <= 18 THEN 'Tarde' ELSE 'Noite' END AS period,
         sum(amount) AS s, count(*) AS c
  FROM tx GROUP BY ALL),
sk AS (SELECT DISTINCT user_id, unnest(['Madrugada','Manhã','Tarde','Noite']) AS period FROM tx)
SELECT sk.user_id, sk.period, round_even(coalesce(a.s, 0.0), 2) AS sum, coalesce(a.c, 0) AS count
FROM sk LEFT JOIN a USING (user_id, period)"""

SQL["by_week_of_month"] = with_(TX) + """
SELECT user_id, CAST((day(date) - 1) // 7 + 1 AS INTEGER) AS week_of_month, round_even(sum(amount), 2) AS total
FROM tx GROUP BY ALL"""

SQL["daily_spend"] = with_(TX) + """
SELECT user_id, date, round_even(sum(amount), 2) AS amount FROM tx GROUP BY user_id, date"""

SQL["fill_calendar"] = with_(OTX) + """, d AS (SELECT user_id, date, sum(amount) AS amount FROM otx GROUP BY ALL),
sp AS (SELECT user_id, min(date) AS d0, max(date) AS d1 FROM d GROUP BY user_id),
cal AS (SELECT user_id, CAST(unnest(generate_series(d0, d1, INTERVAL 1 DAY)) AS DATE) AS date FROM sp)
SELECT cal.user_id, cal.date, round_even(coalesce(d.amount, 0.0), 2) AS amount
FROM cal LEFT JOIN d USING (user_id, date)"""

SQL["rolling_mean_7"] = with_(TX) + """, d AS (SELECT user_id, date, sum(amount) AS amount FROM tx GROUP BY ALL)
SELECT user_id, date, round_even(amount, 2) AS amount,
       round_even(CASE WHEN row_number() OVER w >= 7
                       THEN avg(amount) OVER (w ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) END, 6) AS rolling_mean_7
FROM d WINDOW w AS (PARTITION BY user_id ORDER BY date)"""


def _trend_sql(src: str, cte: str) -> str:
    return with_(cte) + f""", d AS (SELECT user_id, date, sum(amount) AS amount FROM {src} GROUP BY ALL),
x AS (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY date) - 1 AS DOUBLE) AS x FROM d),
g AS (SELECT user_id, count(*) AS n_days, regr_slope(amount, x) AS slope_, corr(x, amount) AS r0,
             avg(amount) AS mean_ FROM x GROUP BY user_id),
h AS (SELECT *, CASE WHEN r0 IS NULL OR isnan(r0) THEN 0.0 ELSE r0 END AS r FROM g)
SELECT user_id, n_days,
  CASE WHEN n_days >= 7 THEN CASE WHEN slope_ > 0 THEN 'crescente' ELSE 'decrescente' END END AS direction,
  CASE WHEN n_days >= 7 THEN round_even(slope_, 2) END AS slope,
  CASE WHEN n_days >= 7 THEN round_even(r * r, 3) END AS r_squared,
  CASE WHEN n_days >= 7 THEN CASE WHEN abs(r) > 0.7 THEN 'forte' WHEN abs(r) > 0.4 THEN 'moderada' ELSE 'fraca' END END AS strength,
  CASE WHEN n_days >= 7 THEN round_even(mean_, 2) END AS daily_average,
  CASE WHEN n_days >= 7 THEN round_even(mean_ * 30, 2) END AS projection_30_days,
  CASE WHEN n_days < 7 THEN 'Dados insuficientes para análise de tendência' END AS message
FROM h"""


SQL["trend"] = _trend_sql("tx", TX)
SQL["trend_orders"] = _trend_sql("otx", OTX)

SQL["kpis"] = with_(TX, _TXS) + """, s AS (SELECT *, round_even(total_credito - total_debito, 2) AS saldo FROM txs)
SELECT user_id, total_credito AS receipts, total_debito AS payments, saldo AS net,
       CASE WHEN total_credito > 0 THEN round_even(saldo / total_credito * 100, 1) ELSE 0.0 END AS savings_rate,
       CASE WHEN total_credito > 0 THEN round_even(total_debito / total_credito * 100, 1) END AS payments_pct
FROM s"""

SQL["category_share"] = with_(TX) + """, deb AS (SELECT * FROM tx WHERE transaction_type = 'debito'),
per AS (SELECT user_id, coalesce(nullif(category, ''), 'outros') AS category, sum(amount) AS t FROM deb GROUP BY ALL),
tot AS (SELECT user_id, sum(amount) AS p FROM deb GROUP BY user_id)
SELECT per.user_id, category, round_even(t, 2) AS total, round_even(t / p * 100, 1) AS share_pct
FROM per LEFT JOIN tot USING (user_id)"""

SQL["running_balance"] = with_(TX) + """, f AS (
  SELECT user_id, date, sum(CASE WHEN transaction_type = 'credito' THEN amount
                                 WHEN transaction_type = 'debito' THEN -amount ELSE 0.0 END) AS amount
  FROM tx GROUP BY ALL),
sp AS (SELECT user_id, min(date) AS d0, max(date) AS d1 FROM f GROUP BY user_id),
cal AS (SELECT user_id, CAST(unnest(generate_series(d0, d1, INTERVAL 1 DAY)) AS DATE) AS date FROM sp),
full_ AS (SELECT cal.user_id, cal.date, coalesce(f.amount, 0.0) AS amount FROM cal LEFT JOIN f USING (user_id, date))
SELECT user_id, date, round_even(amount, 2) AS net_flow,
       round_even(0.0 + sum(amount) OVER (PARTITION BY user_id ORDER BY date
                                          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS balance
FROM full_"""

SQL["forecast_simple"] = with_(TX) + """, g AS (
  SELECT user_id, sum(amount) AS s, greatest(count(DISTINCT date), 1) AS d, stddev_samp(amount) AS sd
  FROM tx GROUP BY user_id)
SELECT user_id, 'Média histórica' AS method, round_even(s / d * 30, 2) AS total_predicted,
       round_even(s / d, 2) AS average_daily,
       round_even(s / d * 30 - 1.96 * sd * sqrt(30), 2) AS lower,
       round_even(s / d * 30 + 1.96 * sd * sqrt(30), 2) AS upper
FROM g"""


def _decade_sql(src: str, cte: str) -> str:
    return with_(cte) + f""", b AS (
  SELECT user_id, strftime(date, '%Y-%m') AS year_month,
         CASE WHEN day(date) <= 10 THEN '1_10' WHEN day(date) <= 20 THEN '11_20' ELSE '21_31' END AS decade,
         round_even(sum(CASE WHEN transaction_type = 'credito' THEN amount ELSE 0.0 END), 2) AS receipts,
         round_even(sum(CASE WHEN transaction_type = 'debito' THEN amount ELSE 0.0 END), 2) AS payments
  FROM {src} GROUP BY ALL)
SELECT *, round_even(receipts - payments, 2) AS difference FROM b"""


SQL["by_decade"] = _decade_sql("tx", TX)
SQL["by_decade_orders"] = _decade_sql("otx", OTX)


# ------------------------------------------------------ profile, savings, goals
_IND = """ind AS (
  SELECT user_id, count(*) AS n,
         avg(CASE WHEN hour("timestamp") BETWEEN 0 AND 6 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS night_ratio,
         count(*) / greatest(count(DISTINCT date), 1) AS tx_per_day,
         avg(CASE WHEN coalesce(lower(category) IN ('lazer','delivery','restaurante','bar'), false)
                  THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS social_ratio,
         CASE WHEN count(*) > 7 THEN stddev_samp(amount) / avg(amount) END AS cv
  FROM tx GROUP BY user_id)"""

SQL["behavior_indicators"] = with_(TX, _IND) + """
SELECT user_id, n, round_even(night_ratio, 6) AS night_ratio, round_even(tx_per_day, 6) AS tx_per_day,
       round_even(social_ratio, 6) AS social_ratio, round_even(cv, 6) AS cv FROM ind"""

SQL["behavior_profile"] = with_(TX, _IND) + """, sc AS (
  SELECT user_id,
         CASE WHEN night_ratio > 0.15 THEN night_ratio * 100 END AS s0,
         CASE WHEN tx_per_day > 3 THEN least(tx_per_day * 10, 50.0::DOUBLE) END AS s1,
         CASE WHEN social_ratio > 0.3 THEN social_ratio * 100 END AS s2,
         CASE WHEN cv > 1.5 THEN cv * 20 END AS s3,
         CASE WHEN cv < 0.5 THEN (1 - cv) * 100 END AS s4
  FROM ind),
u AS (SELECT user_id, 0 AS o, 'notívago' AS nm, s0 AS s FROM sc UNION ALL
      SELECT user_id, 1, 'impulsivo', s1 FROM sc UNION ALL
      SELECT user_id, 2, 'social', s2 FROM sc UNION ALL
      SELECT user_id, 3, 'sazonal', s3 FROM sc UNION ALL
      SELECT user_id, 4, 'controlado', s4 FROM sc),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY s DESC, o) AS rn FROM u WHERE s IS NOT NULL),
agg AS (SELECT user_id, max(CASE WHEN rn = 1 THEN nm END) AS top_nm, max(CASE WHEN rn = 1 THEN s END) AS top_s,
               string_agg(CASE WHEN rn IN (2, 3) AND s > 20 THEN nm END, ',' ORDER BY rn) AS sec
        FROM r GROUP BY user_id)
SELECT sc.user_id, coalesce(agg.top_nm, 'controlado') AS profile,
       CASE WHEN agg.top_nm IS NULL THEN 50.0::DOUBLE ELSE round_even(least(agg.top_s, 100.0::DOUBLE), 1) END AS confidence,
       coalesce(agg.sec, '') AS secondary_profiles,
       round_even(s0, 6) AS score_0, round_even(s1, 6) AS score_1, round_even(s2, 6) AS score_2,
       round_even(s3, 6) AS score_3, round_even(s4, 6) AS score_4
FROM sc LEFT JOIN agg USING (user_id)"""


def _recurring(src: str) -> str:
    return f"""rg AS (
  SELECT user_id, merchant, count(*) AS frequency, sum(amount) AS total FROM {src}
  WHERE merchant IS NOT NULL GROUP BY ALL HAVING count(*) >= 3),
rec AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY total DESC, merchant) AS rank FROM rg
        QUALIFY rank <= 5),
recx AS (SELECT user_id, merchant, frequency, rank, round_even(total, 2) AS total_spent,
                round_even(total / frequency, 2) AS avg_transaction, round_even(total * 0.2, 2) AS potential_savings
         FROM rec)"""


SUPTX = """suptx AS (
  SELECT l_orderkey * 8 + l_linenumber AS id, o_custkey AS user_id, CAST(o_orderdate AS DATE) AS date,
         s_name AS merchant, l_extendedprice AS amount
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey)"""

SQL["recurring_merchants"] = with_(TX, _recurring("tx")) + "SELECT * FROM recx"
SQL["recurring_merchants_suppliers"] = with_(SUPTX, _recurring("suptx")) + "SELECT * FROM recx"

_BRANCHES = """tot AS (SELECT user_id, sum(amount) AS all_ FROM tx GROUP BY user_id),
cat AS (SELECT user_id, category, sum(amount) AS cur FROM tx
        WHERE category IN ('delivery','lazer','assinaturas','jogos','compras') GROUP BY ALL),
b0 AS (SELECT c.user_id, 'category_reduction' AS type, category AS name, round_even(cur, 2) AS current_spending,
              round_even(cur * 0.3, 2) AS potential_savings,
              CASE WHEN cur * 0.3 > all_ * 0.1::DOUBLE * 0.2::DOUBLE THEN 'alta' ELSE 'média' END AS priority,
              0 AS b, list_position(['delivery','lazer','assinaturas','jogos','compras'], category) - 1 AS i
       FROM cat c JOIN tot USING (user_id)),
b1 AS (SELECT user_id, 'recurring_expense' AS type, merchant AS name, total_spent AS current_spending,
              potential_savings, 'média' AS priority, 1 AS b, rank AS i FROM recx),
ni AS (SELECT user_id, sum(CASE WHEN hour("timestamp") BETWEEN 0 AND 6 THEN amount ELSE 0.0 END) AS n,
              sum(amount) AS t FROM tx GROUP BY user_id),
b2 AS (SELECT user_id, 'behavioral' AS type, 'gastos_noturnos' AS name, round_even(n, 2) AS current_spending,
              round_even(n * 0.5, 2) AS potential_savings, 'alta' AS priority, 2 AS b, 0 AS i
       FROM ni WHERE n > t * 0.1::DOUBLE),
allb AS (SELECT * FROM b0 UNION ALL SELECT * FROM b1 UNION ALL SELECT * FROM b2)"""

SQL["savings_suggestions"] = with_(TX, _recurring("tx"), _BRANCHES) + """, r AS (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY potential_savings DESC, b, i) AS rank2 FROM allb)
SELECT user_id, type, name, current_spending, potential_savings, priority, rank2 AS rank,
       CASE WHEN type = 'category_reduction' THEN CASE name
            WHEN 'delivery' THEN 'Cozinhe mais em casa. Prepare marmitas no fim de semana.'
            WHEN 'lazer' THEN 'Busque alternativas gratuitas: parques, eventos públicos.'
            WHEN 'assinaturas' THEN 'Revise todas as assinaturas. Cancele as não utilizadas.'
            WHEN 'jogos' THEN 'Defina um orçamento mensal fixo para jogos.'
            WHEN 'compras' THEN 'Use a regra das 48h antes de comprar algo não essencial.'
            WHEN 'transporte' THEN 'Considere carona, transporte público ou bicicleta.'
            WHEN 'alimentação' THEN 'Faça lista de compras e evite ir ao mercado com fome.'
            ELSE 'Analise se este gasto é realmente necessário.' END END AS action
FROM r WHERE rank2 <= 10"""

_TOTALS = """pt AS (SELECT user_id, sum(potential_savings) AS p FROM allb GROUP BY user_id),
tg AS (SELECT user_id, sum(amount) * 0.1::DOUBLE AS target FROM tx GROUP BY user_id),
totals AS (SELECT tg.user_id, round_even(coalesce(pt.p, 0.0), 2) AS total_potential_savings,
                  round_even(tg.target, 2) AS target_savings, coalesce(pt.p, 0.0) >= tg.target AS achievable
           FROM tg LEFT JOIN pt USING (user_id))"""

SQL["savings_totals"] = with_(TX, _recurring("tx"), _BRANCHES, _TOTALS) + "SELECT * FROM totals"

SQL["goal_progress"] = with_(GOALS) + """
SELECT *, CASE WHEN target_amount > 0 THEN round_even(current_amount / target_amount * 100, 2) ELSE 0.0 END AS progress
FROM goals"""

SQL["goals_by_status"] = with_(GOALS) + "SELECT * FROM goals WHERE status = 'active'"

SQL["goal_compare"] = with_(TX, GOALS) + """, act AS (SELECT * FROM goals WHERE status = 'active'),
na AS (SELECT user_id, count(*) AS active_goals FROM act GROUP BY user_id),
op AS (SELECT user_id, goal_id, name AS goal_name, target_amount - current_amount AS remaining FROM act
       WHERE target_amount - current_amount > 0)
SELECT tx.id, tx.user_id, op.goal_id, op.goal_name, round_even(op.remaining, 2) AS remaining,
       round_even(tx.amount / op.remaining * 100, 1) AS this_purchase_percent, na.active_goals
FROM tx JOIN op USING (user_id) JOIN na USING (user_id)"""

SQL["goal_impact"] = with_(TX, GOALS) + """, f AS (
  SELECT user_id, arg_min(name, goal_id) AS goal_name, arg_min(target_amount, goal_id) AS target
  FROM goals WHERE status = 'active' GROUP BY user_id)
SELECT tx.id, tx.user_id, f.goal_name, round_even(tx.amount / f.target * 100, 1) AS goal_percent
FROM tx JOIN f USING (user_id)"""

SQL["months_to_goal"] = with_(TX, GOALS, _recurring("tx"), _BRANCHES, _TOTALS) + """
SELECT g.goal_id, g.user_id, round_even(g.target_amount - g.current_amount, 2) AS remaining,
       t.total_potential_savings AS monthly_savings,
       CASE WHEN t.total_potential_savings > 0
            THEN round_even((g.target_amount - g.current_amount) / t.total_potential_savings, 1) END AS months_to_goal
FROM goals g LEFT JOIN totals t USING (user_id)"""


# ------------------------------------------------------------ categorisation
from moneta.functions.text import KEYWORD_RULES  # noqa: E402


def _q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _norm(col: str) -> str:
    return (f"trim(regexp_replace(regexp_replace(regexp_replace(lower({col}), "
            f"'[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\p{{Nd}}+', ' ', 'g'), '\\s+', ' ', 'g'))")


def _rules_sql(src: str, idc: str, text_expr: str) -> str:
    counts = ",\n         ".join(
        "(" + " + ".join(f"CASE WHEN contains(t, {_q(k)}) THEN 1 ELSE 0 END" for k in kws) + f") AS c{i}"
        for i, kws in enumerate(KEYWORD_RULES.values()))
    cols = ", ".join(f"c{i}" for i in range(len(KEYWORD_RULES)))
    pick = " ".join(f"WHEN c{i} = best THEN {_q(n)}" for i, n in enumerate(KEYWORD_RULES))
    return f"""nt AS (SELECT {idc}, {_norm(text_expr)} AS t FROM {src}),
kc AS (SELECT {idc}, {counts} FROM nt),
kb AS (SELECT *, greatest({cols}) AS best FROM kc),
rules AS (SELECT {idc}, CASE WHEN best > 0 THEN CASE {pick} END ELSE 'outros' END AS rule_category,
                 CASE WHEN best > 0 THEN least(best / 3.0, 1.0) ELSE 0.3 END::DOUBLE AS rule_confidence,
                 best AS rule_matches FROM kb)"""


def _suggest_sql(src: str, idc: str, text_expr: str) -> str:
    hits = ", ".join(
        "CASE WHEN " + " OR ".join(f"(contains({_q(k)}, t) OR contains(t, {_q(k)}))" for k in kws)
        + f" THEN {_q(n)} END" for n, kws in KEYWORD_RULES.items())
    return f"""st AS (SELECT {idc}, lower({text_expr}) AS t FROM {src}),
sg AS (SELECT {idc}, list_filter([{hits}], lambda x: x IS NOT NULL) AS found FROM st)"""


SQL["normalize_text"] = f"""
SELECT doc_id, md5({_norm('text')}) AS norm_md5, length({_norm('text')}) AS norm_len FROM documents"""

SQL["categorize_rules"] = with_(_rules_sql("documents", "doc_id", "text")) + "SELECT * FROM rules"
SQL["categorize_rules_tx"] = with_(TX, _rules_sql("tx", "id", "concat_ws(' ', coalesce(description, ''), coalesce(merchant, ''))")) + "SELECT * FROM rules"

SQL["suggest_categories"] = with_(_suggest_sql("documents", "doc_id", "text")) + """
SELECT doc_id, CASE WHEN len(found) > 0 THEN array_to_string(found[1:5], ',') ELSE 'outros' END AS suggestions
FROM sg"""

SQL["suggest_categories_merchants"] = with_(_suggest_sql(
    "(SELECT s_suppkey, lower(split_part(s_name, '#', 1)) AS nm FROM supplier)", "s_suppkey", "nm")) + """
SELECT s_suppkey, CASE WHEN len(found) > 0 THEN array_to_string(found[1:5], ',') ELSE 'outros' END AS suggestions
FROM sg"""

_NB = f"""docs AS (SELECT doc_id, text, lang AS label FROM documents WHERE lang IS NOT NULL),
wd AS (SELECT doc_id, list_filter(string_split({_norm('text')}, ' '), lambda w: length(w) >= 2) AS w FROM docs),
tm AS (SELECT doc_id, unnest(w || CASE WHEN len(w) >= 2
                                  THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])
                                  ELSE []::VARCHAR[] END) AS term FROM wd),
tf AS (SELECT doc_id, term, count(*) AS n FROM tm GROUP BY ALL),
nn AS (SELECT count(*) AS N FROM docs),
stats AS (SELECT term, count(*) AS df, sum(n) AS tf_total FROM tf GROUP BY term),
top_ AS (SELECT * FROM stats WHERE df >= 2 ORDER BY tf_total DESC, term LIMIT 1000),
vocab AS (SELECT term, df, tf_total, ln((1.0 + N) / (1.0 + df)) + 1.0 AS idf FROM top_, nn),
raw AS (SELECT tf.doc_id, tf.term, tf.n * v.idf AS r FROM tf JOIN vocab v USING (term)),
l2 AS (SELECT doc_id, sqrt(sum(r * r)) AS l FROM raw GROUP BY doc_id),
wts AS (SELECT raw.doc_id, term, r / l AS w FROM raw JOIN l2 USING (doc_id)),
cls AS (SELECT label, count(*) AS n_docs FROM docs GROUP BY label),
sct AS (SELECT d.label, w.term, sum(w.w) AS s FROM wts w JOIN docs d USING (doc_id) GROUP BY ALL),
grid AS (SELECT cls.label, vocab.term, coalesce(sct.s, 0.0) AS s_ct
         FROM cls, vocab LEFT JOIN sct ON sct.label = cls.label AND sct.term = vocab.term),
sc AS (SELECT label, sum(s_ct) AS s_c FROM grid GROUP BY label),
vv AS (SELECT count(*) AS V FROM vocab),
lp AS (SELECT g.label, g.term, ln((g.s_ct + 0.1) / (sc.s_c + 0.1 * V)) AS log_prob FROM grid g JOIN sc USING (label), vv),
pri AS (SELECT label, n_docs, ln(n_docs / N) AS log_prior FROM cls, nn),
dot AS (SELECT w.doc_id, lp.label, sum(w.w * lp.log_prob) AS d FROM wts w JOIN lp USING (term) GROUP BY ALL),
jll AS (SELECT a.doc_id, p.label, p.log_prior + coalesce(dot.d, 0.0) AS j
        FROM (SELECT doc_id FROM documents) a CROSS JOIN pri p
        LEFT JOIN dot ON dot.doc_id = a.doc_id AND dot.label = p.label),
mx AS (SELECT doc_id, max(j) AS m, arg_min(label, (-j, label)) AS predicted FROM jll GROUP BY doc_id),
pred AS (SELECT mx.doc_id, mx.predicted, exp(mx.m - (mx.m + ln(sum(exp(jll.j - mx.m))))) AS confidence
         FROM mx JOIN jll USING (doc_id) GROUP BY mx.doc_id, mx.predicted, mx.m)"""

SQL["nb_vocabulary"] = with_(_NB) + "SELECT term, df, tf_total, round_even(idf, 6) AS idf FROM vocab"
SQL["nb_log_probs"] = with_(_NB) + "SELECT label, term, round_even(log_prob, 6) AS log_prob FROM lp"
SQL["nb_priors"] = with_(_NB) + "SELECT label, n_docs, round_even(log_prior, 6) AS log_prior FROM pri"
SQL["nb_predict"] = with_(_NB) + "SELECT doc_id, predicted, round_even(confidence, 6) AS confidence FROM pred"
SQL["nb_train_accuracy"] = with_(_NB) + """
SELECT round_even(avg(CASE WHEN p.predicted = d.label THEN 1.0 ELSE 0.0 END), 6) AS accuracy, count(*) AS n_docs
FROM pred p JOIN docs d USING (doc_id)"""
SQL["categorize"] = with_(_NB, _rules_sql("documents", "doc_id", "text")) + """
SELECT r.doc_id,
       CASE WHEN r.rule_confidence < 0.7 AND p.confidence > r.rule_confidence THEN p.predicted ELSE r.rule_category END AS category,
       round_even(CASE WHEN r.rule_confidence < 0.7 AND p.confidence > r.rule_confidence THEN p.confidence ELSE r.rule_confidence END, 6) AS confidence,
       CASE WHEN r.rule_confidence < 0.7 AND p.confidence > r.rule_confidence THEN 'ml' ELSE 'rules' END AS method
FROM rules r LEFT JOIN pred p USING (doc_id)"""


# ------------------------------------------------------------------ anomaly
_FEATS = """enc AS (SELECT v AS value, dense_rank() OVER (ORDER BY v) - 1 AS code
               FROM (SELECT DISTINCT coalesce(category, 'outros') AS v FROM tx)),
f0 AS (SELECT tx.*, coalesce(amount, 0.0) AS f_amount, hour("timestamp") AS hour,
              isodow("timestamp") - 1 AS day_of_week, day("timestamp") AS day_of_month,
              coalesce(enc.code, -1) AS category_encoded
       FROM tx LEFT JOIN enc ON coalesce(tx.category, 'outros') = enc.value),
q9 AS (SELECT user_id, quantile_cont(f_amount, 0.9) AS q90 FROM f0 GROUP BY user_id),
feats AS (SELECT f0.*, CAST(f_amount > q90 AS INTEGER) AS is_high_amount,
                 CAST(hour BETWEEN 0 AND 6 AS INTEGER) AS is_night, CAST(day_of_week >= 5 AS INTEGER) AS is_weekend
          FROM f0 JOIN q9 USING (user_id))"""

_FCOLS = ["amount", "hour", "day_of_week", "day_of_month", "category_encoded",
          "is_high_amount", "is_night", "is_weekend"]


def _src(c: str) -> str:
    return "f_amount" if c == "amount" else c


SQL["anomaly_features"] = with_(TX, _FEATS) + """
SELECT id, user_id, f_amount AS amount, hour, day_of_week, day_of_month, category_encoded,
       is_high_amount, is_night, is_weekend FROM feats"""

SQL["label_encode"] = with_(TX, _FEATS) + "SELECT value, code FROM enc"

SQL["standardize"] = with_(TX, _FEATS) + ", fs AS (SELECT user_id, " + ", ".join(
    f"avg(CAST({_src(c)} AS DOUBLE)) AS m_{c}, stddev_pop(CAST({_src(c)} AS DOUBLE)) AS s_{c}" for c in _FCOLS
) + " FROM feats GROUP BY user_id)\nSELECT id, user_id, " + ", ".join(
    f"round_even((CAST({_src(c)} AS DOUBLE) - m_{c}) / CASE WHEN s_{c} IS NULL OR s_{c} = 0 THEN 1.0 ELSE s_{c} END, 6) AS z_{c}"
    for c in _FCOLS) + " FROM feats JOIN fs USING (user_id)"

_HEUR = """hst AS (SELECT user_id, avg(coalesce(amount, 0.0)) AS m,
                CASE WHEN count(*) > 1 THEN stddev_pop(coalesce(amount, 0.0))
                     ELSE avg(coalesce(amount, 0.0)) * 0.5 END AS sd
         FROM tx GROUP BY user_id),
h0 AS (SELECT tx.*, CASE WHEN sd > 0 THEN abs(coalesce(amount, 0.0) - m) / sd END AS z,
              hour("timestamp") AS h, lower(coalesce(category, '')) AS lc
       FROM tx JOIN hst USING (user_id)),
h1 AS (SELECT *, CASE WHEN z > 2 THEN least(z * 20, 50.0::DOUBLE) END AS zs,
              CASE WHEN h BETWEEN 0 AND 6 THEN 25.0::DOUBLE END AS hs,
              CASE WHEN lc IN ('jogos','apostas','cassino','bet') THEN 30.0::DOUBLE END AS cs FROM h0),
heur AS (SELECT *, 0.0::DOUBLE + coalesce(zs, 0.0) + coalesce(hs, 0.0) + coalesce(cs, 0.0) AS score0 FROM h1),
res AS (SELECT *, score0 >= 50 AS is_anomaly, least(score0, 100.0::DOUBLE) AS anomaly_score FROM heur)"""

SQL["anomaly_heuristic"] = with_(TX, _HEUR) + """
SELECT id, user_id, round_even(anomaly_score, 6) AS anomaly_score, is_anomaly,
       concat_ws('|', CASE WHEN zs IS NOT NULL THEN printf('Valor atípico: %.1f desvios da média', round_even(z, 1)) END,
                      CASE WHEN hs IS NOT NULL THEN printf('Horário noturno: %dh', h) END,
                      CASE WHEN cs IS NOT NULL THEN 'Categoria de risco: ' || lc END) AS reasons
FROM res"""

SQL["anomaly_reasons"] = with_(TX, _FEATS, _HEUR) + """, ref AS (
  SELECT user_id, avg(f_amount) AS mean_amount, stddev_samp(f_amount) AS std_amount FROM feats GROUP BY user_id),
j AS (SELECT f.id, f.user_id, coalesce(f.amount, 0.0) AS a, f.category, f.hour, f.is_weekend, r.anomaly_score,
             ref.mean_amount, ref.std_amount
      FROM feats f JOIN res r USING (id) JOIN ref ON ref.user_id = f.user_id WHERE r.is_anomaly),
k AS (SELECT *, concat_ws('|',
        CASE WHEN std_amount > 0 AND a > mean_amount + 2 * std_amount
             THEN printf('Valor muito acima da média (R$ %.2f vs média R$ %.2f)', round_even(a, 2), round_even(mean_amount, 2)) END,
        CASE WHEN hour BETWEEN 0 AND 6 THEN printf('Transação em horário incomum (%.1fh)', CAST(hour AS DOUBLE)) END,
        CASE WHEN is_weekend = 1 THEN 'Transação no fim de semana' END,
        CASE WHEN category IN ('jogos','apostas','cassino') THEN 'Categoria de alto risco: ' || category END) AS r0
      FROM j)
SELECT id, user_id, CASE WHEN r0 = '' THEN printf('Padrão incomum detectado (score: %d)', CAST(round_even(anomaly_score, 0) AS BIGINT))
                         ELSE r0 END AS reasons FROM k"""

SQL["normalize_scores"] = with_(TX, _HEUR) + """, mm AS (SELECT user_id, min(anomaly_score) AS lo, max(anomaly_score) AS hi FROM res GROUP BY user_id)
SELECT id, user_id, round_even(CASE WHEN hi = lo THEN 50.0 ELSE 100.0 * (1.0 - (anomaly_score - lo) / (hi - lo)) END, 6) AS score_normalized
FROM res JOIN mm USING (user_id)"""

SQL["anomaly_summary"] = with_(TX, _HEUR) + """
SELECT user_id, sum(CASE WHEN is_anomaly THEN 1 ELSE 0 END) AS total_anomalies,
       round_even(sum(CASE WHEN is_anomaly THEN 1 ELSE 0 END) / count(*) * 100, 6) AS percentage,
       round_even(sum(CASE WHEN is_anomaly THEN coalesce(amount, 0.0) ELSE 0.0 END), 2) AS total_value,
       round_even(avg(CASE WHEN is_anomaly THEN anomaly_score END), 6) AS average_score
FROM res GROUP BY user_id"""

SQL["anomaly_by_category"] = with_(TX, _HEUR) + """
SELECT user_id, category, count(*) AS count, round_even(sum(amount), 2) AS total FROM res WHERE is_anomaly GROUP BY ALL"""

SQL["anomaly_by_hour"] = with_(TX, _HEUR) + """
SELECT user_id, printf('%02dh', hour("timestamp")) AS hour, count(*) AS count
FROM res WHERE is_anomaly AND "timestamp" IS NOT NULL GROUP BY ALL"""

SQL["top_anomalies"] = with_(TX, _HEUR) + """
SELECT user_id, rank, id, round_even(anomaly_score, 6) AS anomaly_score FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY anomaly_score DESC, id) AS rank FROM res WHERE is_anomaly)
WHERE rank <= 5"""


# ------------------------------------------------------------- interventions
from moneta.operators import interventions as _ivd  # noqa: E402


def _arr(v: list[str]) -> str:
    return "[" + ", ".join(_q(x) for x in v) + "]"


def _case_map(expr: str, d: dict) -> str:
    return "CASE " + expr + " " + " ".join(f"WHEN {_q(k)} THEN {_arr(v)}" for k, v in d.items()) + " END"


def _pick_sql(arr: str, n: int) -> str:
    return (f"list_transform(list_sort(list_transform({arr}, lambda q: {{'h': md5(CAST(id AS VARCHAR) || '|' || q), 'q': q}})), "
            f"lambda x: x.q)[1:{n}]")


_IVC = """ivc AS (
  SELECT *, CASE WHEN risk_score < 30 THEN 'gentle' WHEN risk_score < 50 THEN 'moderate'
                 WHEN risk_score < 75 THEN 'strong' ELSE 'critical' END AS level,
         lower(coalesce(category, 'outros')) AS cat_, hour("timestamp") BETWEEN 0 AND 6 AS night_,
         hour("timestamp") AS hour_
  FROM scored2)"""

_Q = f"""ivq AS (
  SELECT *, coalesce({_pick_sql(_case_map('cat_', _ivd.REFLECTIVE_QUESTIONS), 2)}, []::VARCHAR[])
            || CASE WHEN night_ THEN list_transform({_pick_sql(_arr(_ivd.REFLECTIVE_QUESTIONS['noturno']), 1)},
                                                    lambda q: replace(q, 'Xh', CAST(hour_ AS VARCHAR) || 'h'))
                    ELSE []::VARCHAR[] END
            || CASE WHEN amount >= 200 THEN {_pick_sql(_arr(_ivd.REFLECTIVE_QUESTIONS['alto_valor']), 1)}
                    ELSE []::VARCHAR[] END AS q0
  FROM ivc),
ivq2 AS (SELECT *, (CASE WHEN len(q0) = 0 THEN {_pick_sql(_arr(_ivd.REFLECTIVE_QUESTIONS['default']), 2)}
                         ELSE q0 END)[1:4] AS questions FROM ivq)"""

_IV_BASE = with_(TX, RECENT, SCORED, _IVC)

SQL["intervention_level"] = with_(TX, RECENT, SCORED) + """
SELECT id, risk_score, CASE WHEN risk_score < 30 THEN 'gentle' WHEN risk_score < 50 THEN 'moderate'
                            WHEN risk_score < 75 THEN 'strong' ELSE 'critical' END AS level FROM scored2"""

SQL["intervention_questions"] = with_(TX, RECENT, SCORED, _IVC, _Q) + """
SELECT id, array_to_string(questions, '|') AS questions FROM ivq2"""

SQL["intervention_impact"] = _IV_BASE + f"""
SELECT id,
  CASE WHEN amount >= 50 THEN printf('Com R$ %.2f, você poderia comer por %.1f dias', round_even(amount, 2), round_even(amount / 30, 1)) END AS daily_food,
  CASE WHEN amount >= 50 THEN printf('Equivale a %.1f meses de streaming', round_even(amount / 45, 1)) END AS subscriptions,
  CASE WHEN amount >= 50 THEN printf('Investido, em 5 anos seria R$ %.2f', round_even(amount * {_ivd.INVESTMENT_FACTOR!r}::DOUBLE, 2)) END AS investment,
  CASE WHEN amount >= 50 THEN printf('Você trabalha %.1f horas para ganhar isso', round_even(amount / 15, 1)) END AS work_hours
FROM ivc"""

_ALT = f"{_pick_sql(_case_map('cat_', _ivd.ALTERNATIVES), 2)}"

SQL["intervention_alternatives"] = _IV_BASE + f"""
SELECT id, array_to_string({_ALT}, '|') AS alternatives FROM ivc"""

_DELAY = """CASE WHEN level = 'strong' THEN 5 WHEN level = 'critical' THEN 10 END"""

SQL["intervention_delay"] = _IV_BASE + f"""
SELECT id, {_DELAY} AS delay_minutes, "timestamp" + ({_DELAY}) * INTERVAL 1 MINUTE AS delay_expires_at,
       CASE WHEN {_DELAY} IS NOT NULL THEN printf('Aguarde %d minutos antes de confirmar', {_DELAY}) END AS delay_message
FROM ivc"""

_BR = _ivd.BLOCK_REASONS
SQL["intervention_block"] = _IV_BASE + f"""
SELECT id, CASE WHEN level = 'critical' THEN {_q(_ivd.BLOCK_PREFIX)} || CASE WHEN r = '' THEN {_q(_BR[3])} ELSE r END END AS block_reason
FROM (SELECT *, concat_ws(', ', CASE WHEN night_ THEN {_q(_BR[0])} END, CASE WHEN risk_score >= 80 THEN {_q(_BR[1])} END,
                          CASE WHEN amount >= 500 THEN {_q(_BR[2])} END) AS r FROM ivc)"""

SQL["intervention_message"] = _IV_BASE + f"""
SELECT id, {_pick_sql(_case_map('level', _ivd.MAIN_MESSAGES), 1)}[1] || CASE WHEN night_ THEN {_q(_ivd.NIGHT_SUFFIX)} ELSE '' END AS main_message,
       array_to_string({_case_map('level', _ivd.ACTIONS)}, ',') AS actions
FROM ivc"""

SQL["generate_intervention"] = with_(TX, RECENT, SCORED, _IVC, GOALS) + f""", og AS (
  SELECT user_id, count(*) AS n_open FROM goals WHERE status = 'active' GROUP BY user_id)
SELECT id, ivc.user_id, level,
       concat_ws(',', 'question', CASE WHEN amount >= 50 THEN 'visualization' END,
                 CASE WHEN coalesce(og.n_open, 0) > 0 THEN 'comparison' END,
                 CASE WHEN len(coalesce({_ALT}, [])) > 0 THEN 'alternative' END,
                 CASE WHEN level IN ('strong', 'critical') THEN 'delay' END,
                 CASE WHEN level = 'critical' THEN 'block' END) AS components
FROM ivc LEFT JOIN og USING (user_id)"""

SQL["intervention_stats"] = _IV_BASE + f""", per AS (
  SELECT user_id, count(*) AS total, sum(CASE WHEN level = 'gentle' THEN 1 ELSE 0 END) AS n_gentle,
         sum(CASE WHEN level = 'moderate' THEN 1 ELSE 0 END) AS n_moderate,
         sum(CASE WHEN level = 'strong' THEN 1 ELSE 0 END) AS n_strong,
         sum(CASE WHEN level = 'critical' THEN 1 ELSE 0 END) AS n_critical, max("timestamp") AS last_
  FROM ivc GROUP BY user_id),
act AS (SELECT ivc.user_id, count(*) AS active_delays FROM ivc JOIN per USING (user_id)
        WHERE {_DELAY} IS NOT NULL AND "timestamp" + ({_DELAY}) * INTERVAL 1 MINUTE > last_ GROUP BY ivc.user_id)
SELECT per.user_id, total, n_gentle, n_moderate, n_strong, n_critical, coalesce(act.active_delays, 0) AS active_delays
FROM per LEFT JOIN act USING (user_id)"""


# ----------------------------------------------- notifications, alerts, state
SQL["weekly_totals"] = with_(TX) + """, g AS (
  SELECT user_id, CAST(date_trunc('week', date) AS DATE) AS week, sum(amount) AS t
  FROM tx WHERE transaction_type = 'debito' GROUP BY ALL)
SELECT user_id, week, round_even(t, 2) AS total,
       round_even(lag(t) OVER (PARTITION BY user_id ORDER BY week), 2) AS previous_total FROM g"""

_AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"


def _nid(name: str, src: str) -> str:
    return f"md5('{name}|' || CAST({src} AS VARCHAR))"


def _m2(x: str) -> str:
    return f"printf('%.2f', round_even({x}, 2))"


_WK = """wk0 AS (SELECT user_id, CAST(date_trunc('week', date) AS DATE) AS week, sum(amount) AS t
        FROM tx WHERE transaction_type = 'debito' GROUP BY ALL),
wk AS (SELECT user_id, week, round_even(t, 2) AS total,
              round_even(lag(t) OVER (PARTITION BY user_id ORDER BY week), 2) AS previous_total FROM wk0)"""

_SUGG = """sr AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY potential_savings DESC, b, i) AS rank2 FROM allb),
tip AS (SELECT user_id, CASE WHEN type = 'category_reduction' THEN 'Reduza gastos com ' || name || ' em 30%'
                             WHEN type = 'recurring_expense' THEN 'Você tem gasto recorrente em ' || name
                             ELSE 'Você gasta significativamente durante a madrugada' END AS tip
        FROM sr WHERE rank2 = 1)"""

_NOTIF = f"""crit AS (
  SELECT *, concat_ws(', ', CASE WHEN night_ THEN {_q(_BR[0])} END, CASE WHEN risk_score >= 80 THEN {_q(_BR[1])} END,
                      CASE WHEN amount >= 500 THEN {_q(_BR[2])} END) AS r
  FROM ivc WHERE level = 'critical'),
notifs AS (
  SELECT {_nid('night_alert', 'id')} AS notification_id, user_id, 'night_alert' AS template, '🌙 Alerta Noturno' AS title,
         'Você está fazendo uma compra de R$ ' || {_m2('amount')} || ' às ' || CAST(hour("timestamp") AS VARCHAR)
           || 'h. Compras neste horário tendem a ser por impulso.' AS message,
         'alert' AS type, 'night' AS category, "timestamp" AS created_at
  FROM checked3 WHERE alert_type = 'night'
  UNION ALL
  SELECT {_nid('anomaly_detected', 'id')}, user_id, 'anomaly_detected', '⚠️ Gasto Atípico',
         'Detectamos um gasto incomum: R$ ' || {_m2('amount')} || ' em ' || category || '. Score de anomalia: '
           || CAST(CAST(trunc(anomaly_score) AS INTEGER) AS VARCHAR) || '/100', 'warning', 'anomaly', "timestamp"
  FROM res WHERE is_anomaly AND category IS NOT NULL
  UNION ALL
  SELECT {_nid('impulse_blocked', 'id')}, user_id, 'impulse_blocked', '🛑 Compra Bloqueada',
         'Uma compra de R$ ' || {_m2('amount')} || ' foi bloqueada por medida de proteção. Motivo: '
           || {_q(_ivd.BLOCK_PREFIX)} || CASE WHEN r = '' THEN {_q(_BR[3])} ELSE r END, 'critical', 'impulse', "timestamp"
  FROM crit
  UNION ALL
  SELECT {_nid('goal_progress', 'goal_id')}, user_id, 'goal_progress', '🎯 Progresso da Meta',
         'Você atingiu ' || printf('%.0f', round_even(current_amount / target_amount * 100, 0)) || '% da meta "' || name
           || '"! Faltam R$ ' || {_m2('target_amount - current_amount')}, 'info', 'goal', {_AS_OF}
  FROM goals WHERE status = 'active'
  UNION ALL
  SELECT {_nid('goal_achieved', 'goal_id')}, user_id, 'goal_achieved', '🎉 Meta Alcançada!',
         'Parabéns! Você alcançou a meta "' || name || '"!', 'success', 'goal', {_AS_OF}
  FROM goals WHERE status = 'completed'
  UNION ALL
  SELECT {_nid('savings_tip', 'user_id')}, user_id, 'savings_tip', '💡 Dica de Economia', tip, 'info', 'savings', {_AS_OF}
  FROM tip
  UNION ALL
  SELECT md5('weekly_summary|' || CAST(user_id AS VARCHAR) || '|' || CAST(week AS VARCHAR)), user_id, 'weekly_summary',
         '📊 Resumo Semanal',
         'Esta semana você gastou R$ ' || {_m2('total')} || '. ' ||
           CASE WHEN previous_total IS NULL THEN 'Primeira semana registrada.'
                WHEN total > previous_total THEN printf('Acima da semana anterior (R$ %.2f).', previous_total)
                ELSE printf('Abaixo ou igual à semana anterior (R$ %.2f).', previous_total) END,
         'info', 'weekly', CAST(week AS TIMESTAMP) + INTERVAL 7 DAY
  FROM wk)"""

_NOTIF_ALL = with_(TX, RECENT, SCORED, SETTINGS, CHECKED, _HEUR, _IVC, GOALS, _recurring("tx"), _BRANCHES,
                   _SUGG, _WK, _NOTIF)

SQL["notify_from_template"] = _NOTIF_ALL + "SELECT * FROM notifs"

_READS = """r1 AS (SELECT notification_id, min(created_at + INTERVAL 1 HOUR) AS r1 FROM notifs
                 WHERE substr(notification_id, 1, 1) IN ('0','1','2','3') GROUP BY notification_id),
ma AS (SELECT user_id, ts AS at FROM events WHERE event_type = 'error' AND event_id % 7 = 0),
r2 AS (SELECT n.notification_id, min(ma.at) AS r2 FROM notifs n JOIN ma ON ma.user_id = n.user_id AND ma.at >= n.created_at
       GROUP BY n.notification_id),
rd AS (SELECT n.*, CASE WHEN r1.r1 IS NULL THEN r2.r2 WHEN r2.r2 IS NULL THEN r1.r1 ELSE least(r1.r1, r2.r2) END AS read_at
       FROM notifs n LEFT JOIN r1 USING (notification_id) LEFT JOIN r2 USING (notification_id)),
rd2 AS (SELECT *, read_at IS NOT NULL AS read FROM rd)"""

SQL["mark_read"] = _NOTIF_ALL + ", " + _READS + "\nSELECT notification_id, user_id, read, read_at FROM rd2"
SQL["unread_count"] = _NOTIF_ALL + ", " + _READS + """
SELECT user_id, sum(CASE WHEN NOT read THEN 1 ELSE 0 END) AS unread FROM rd2 GROUP BY user_id"""
SQL["filter_notifications"] = _NOTIF_ALL + ", " + _READS + """
SELECT user_id, rank, notification_id, category, created_at FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, notification_id DESC) AS rank
  FROM rd2 WHERE NOT read) WHERE rank <= 50"""
SQL["notification_retention"] = _NOTIF_ALL + """
SELECT notification_id, user_id, created_at FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, notification_id DESC) AS rn FROM notifs)
WHERE rn <= 1000"""

_ALERTS = f"""al AS (
  SELECT id AS alert_id, id AS transaction_id, user_id, alert_type,
         'Transação de R$' || {_m2('amount')} || ' em ' || coalesce(category, 'categoria desconhecida') AS message,
         checked_score AS risk_score, "timestamp" AS created_at
  FROM checked3 WHERE alert_type IS NOT NULL),
acks AS (SELECT alert_id, created_at + INTERVAL 30 MINUTE AS acknowledged_at FROM al WHERE alert_id % 3 = 0
         UNION ALL SELECT alert_id, created_at + INTERVAL 2 HOUR FROM al WHERE alert_id % 6 = 0),
alk AS (SELECT al.*, a.acknowledged_at, a.acknowledged_at IS NOT NULL AS acknowledged
        FROM al LEFT JOIN (SELECT alert_id, max(acknowledged_at) AS acknowledged_at FROM acks GROUP BY alert_id) a
        USING (alert_id))"""

_AL_BASE = with_(TX, RECENT, SCORED, SETTINGS, CHECKED, _ALERTS)
SQL["alerts_from_risk"] = _AL_BASE + "SELECT * FROM al"
SQL["acknowledge_alerts"] = _AL_BASE + "SELECT alert_id, user_id, acknowledged, acknowledged_at FROM alk"
SQL["open_alerts"] = _AL_BASE + """
SELECT user_id, rank, alert_id, alert_type, risk_score FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, alert_id DESC) AS rank
  FROM alk WHERE NOT acknowledged) WHERE rank <= 10"""
SQL["tx_alerts"] = _AL_BASE + """
SELECT alk.alert_id, alk.transaction_id, alk.alert_type, t.amount, t.category, t.merchant
FROM alk LEFT JOIN tx t ON t.id = alk.transaction_id"""

SQL["goal_updates"] = with_(GOALS) + """, lg AS (SELECT user_id AS goal_id, value * 50 AS amount, ts FROM events WHERE event_type = 'signup'),
last AS (SELECT goal_id, arg_max(amount, ts) AS amount, max(ts) AS updated_at FROM lg GROUP BY goal_id),
hit AS (SELECT lg.goal_id, max(CASE WHEN lg.amount >= g.target_amount THEN 1 ELSE 0 END) AS hit
        FROM lg JOIN goals g USING (goal_id) GROUP BY lg.goal_id)
SELECT g.goal_id, g.user_id, g.name, g.target_amount, coalesce(last.amount, g.current_amount) AS current_amount,
       CASE WHEN g.status = 'completed' OR coalesce(hit.hit, 0) = 1 THEN 'completed' ELSE g.status END AS status,
       last.updated_at
FROM goals g LEFT JOIN last USING (goal_id) LEFT JOIN hit USING (goal_id)"""

SQL["profile_upsert"] = """WITH base AS (
  SELECT c_custkey AS user_id, c_name AS username, true AS night_protection_enabled,
         CAST(NULL AS DOUBLE) AS daily_limit, CAST(NULL AS DOUBLE) AS monthly_limit FROM customer),
up AS (SELECT user_id, ts,
              CASE WHEN event_type = 'purchase' THEN value * 10 END AS daily_limit,
              CASE WHEN event_type = 'signup' THEN value * 100 END AS monthly_limit,
              CASE WHEN event_type = 'error' AND event_id % 2 = 0 THEN event_id % 4 = 0 END AS night_protection_enabled
       FROM events),
lu AS (SELECT user_id, arg_max(daily_limit, CASE WHEN daily_limit IS NOT NULL THEN ts END) AS daily_limit,
              arg_max(monthly_limit, CASE WHEN monthly_limit IS NOT NULL THEN ts END) AS monthly_limit,
              arg_max(night_protection_enabled, CASE WHEN night_protection_enabled IS NOT NULL THEN ts END) AS npe
       FROM up GROUP BY user_id)
SELECT coalesce(b.user_id, lu.user_id) AS user_id, b.username,
       coalesce(lu.npe, b.night_protection_enabled) AS night_protection_enabled,
       round_even(coalesce(lu.daily_limit, b.daily_limit), 2) AS daily_limit,
       round_even(coalesce(lu.monthly_limit, b.monthly_limit), 2) AS monthly_limit
FROM base b FULL OUTER JOIN lu ON b.user_id = lu.user_id"""

SQL["delay_status"] = _IV_BASE + f""", dl AS (
  SELECT user_id, id AS transaction_id, "timestamp" AS set_at,
         "timestamp" + ({_DELAY}) * INTERVAL 1 MINUTE AS expires_at FROM ivc WHERE {_DELAY} IS NOT NULL),
last AS (SELECT user_id, transaction_id, arg_max(expires_at, set_at) AS expires_at FROM dl GROUP BY ALL),
st AS (SELECT *, TIMESTAMP '2024-01-15 12:00:00' < expires_at AS active,
              epoch(expires_at) - epoch(TIMESTAMP '2024-01-15 12:00:00') AS rem FROM last)
SELECT user_id, transaction_id, expires_at, active,
       CASE WHEN active THEN CAST(floor(rem) AS BIGINT) END AS remaining_seconds,
       CASE WHEN active THEN round_even(rem / 60, 1) END AS remaining_minutes,
       NOT active AS expired, NOT active AS can_proceed
FROM st"""


# ------------------------------------------------------------- files, sinks
_SIGNED = "CASE WHEN transaction_type = 'credito' THEN amount ELSE -amount END"
_ODDTXT = f"'R$ 1.' || lpad(replace(printf('%.2f', abs({_SIGNED})), '.', ','), 6, '0')"

SQL["import_bank_csv"] = with_(TX) + f"""
SELECT strftime(date, '%d/%m/%Y') AS data, description AS descricao,
       abs(CAST(printf('%.2f', {_SIGNED}) AS DOUBLE)) AS valor,
       CASE WHEN {_SIGNED} > 0 THEN 'credito' ELSE 'debito' END AS tipo, 'outros' AS categoria_sugerida, date
FROM tx WHERE id % 97 <> 0"""

SQL["import_bank_csv_rejects"] = with_(TX) + f"""
SELECT strftime(date, '%d/%m/%Y') AS data, description AS descricao, {_ODDTXT} AS valor_texto
FROM tx WHERE id % 97 = 0"""

SQL["import_bank_csv_pt_br"] = with_(TX) + f"""
SELECT strftime(date, '%d/%m/%Y') AS data, description AS descricao,
       CASE WHEN id % 97 = 0 THEN CAST(replace('1' || lpad(replace(printf('%.2f', abs({_SIGNED})), '.', ','), 6, '0'), ',', '.') AS DOUBLE)
            ELSE abs(CAST(printf('%.2f', {_SIGNED}) AS DOUBLE)) END AS valor,
       CASE WHEN id % 97 = 0 OR {_SIGNED} > 0 THEN 'credito' ELSE 'debito' END AS tipo,
       'outros' AS categoria_sugerida, date
FROM tx"""

SQL["import_ofx"] = with_(TX) + f"""
SELECT 'Banco Teste' AS banco, CAST(user_id AS VARCHAR) AS conta, strftime(date, '%d/%m/%Y') AS periodo_inicio,
       strftime(date, '%d/%m/%Y') AS periodo_fim,
       CAST(printf('%.2f', sum({_SIGNED}) OVER (PARTITION BY user_id, date)) AS DOUBLE) AS saldo_final,
       row_number() OVER (PARTITION BY user_id, date ORDER BY "timestamp", id) - 1 AS pos,
       CAST(id AS VARCHAR) AS fitid, strftime(date, '%d/%m/%Y') AS data,
       CASE WHEN id % 4 <> 0 THEN description WHEN id % 2 = 0 THEN merchant ELSE 'Sem descrição' END AS descricao,
       abs(CAST(printf('%.2f', {_SIGNED}) AS DOUBLE)) AS valor,
       CASE WHEN {_SIGNED} > 0 THEN 'credito' ELSE 'debito' END AS tipo, 'outros' AS categoria_sugerida
FROM tx"""

SQL["flatten_receipt"] = """WITH it AS (
  SELECT l_orderkey, 'Item ' || CAST(l_partkey AS VARCHAR) AS descricao, l_extendedprice AS valor,
         l_quantity AS quantidade,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, descricao, valor, quantidade) - 1 AS pos
  FROM lineitem),
o AS (SELECT *, o_orderkey % 17 = 0 AS bad FROM orders)
SELECT o.o_orderkey AS doc_id, CASE WHEN bad THEN 'Não consegui ler o documento.' END AS raw_text,
       CASE WHEN NOT bad THEN strftime(o_orderdate, '%d/%m/%Y') END AS data,
       CASE WHEN NOT bad THEN round_even(o_totalprice, 2) END AS valor_total,
       CASE WHEN NOT bad THEN 'Loja ' || CAST(o_custkey AS VARCHAR) END AS estabelecimento,
       CASE WHEN NOT bad THEN it.pos END AS item_pos, CASE WHEN NOT bad THEN it.descricao END AS item_descricao,
       CASE WHEN NOT bad THEN round_even(it.valor, 2) END AS item_valor,
       CASE WHEN NOT bad THEN it.quantidade END AS item_quantidade
FROM o LEFT JOIN it ON it.l_orderkey = o.o_orderkey AND NOT o.bad"""

SQL["merge_bill_pages"] = """WITH b AS (
  SELECT o_custkey * 1000000 + CAST(strftime(o_orderdate, '%Y%m') AS BIGINT) AS doc_id, o_orderkey % 3 AS page,
         strftime(o_orderdate, '%d/%m/%Y') AS data, 'Pedido ' || CAST(o_orderkey AS VARCHAR) AS descricao,
         o_totalprice AS valor, o_orderkey AS k, strftime(o_orderdate, '%Y%m') AS ym
  FROM orders),
pg AS (SELECT doc_id, page, ym, sum(valor) AS tot, min(k) AS k FROM b GROUP BY ALL),
ok AS (SELECT * FROM pg WHERE k % 17 <> 0),
hdr AS (SELECT doc_id, arg_min(tot, page) AS tot, arg_min(ym, page) AS ym FROM ok GROUP BY doc_id),
items AS (SELECT b.doc_id, b.page, b.data, b.descricao, b.valor,
                 row_number() OVER (PARTITION BY b.doc_id, b.page ORDER BY b.data, b.descricao) - 1 AS pos
          FROM b JOIN ok USING (doc_id, page))
SELECT doc_id, page, pos, 'Cartão Teste' AS banco, substr(hdr.ym, 5, 2) || '/' || substr(hdr.ym, 1, 4) AS mes_referencia,
       '10/' || substr(hdr.ym, 5, 2) || '/' || substr(hdr.ym, 1, 4) AS vencimento,
       round_even(hdr.tot, 2) AS valor_total, round_even(hdr.tot * 0.15::DOUBLE, 2) AS valor_minimo,
       data, descricao, round_even(valor, 2) AS valor
FROM items JOIN hdr USING (doc_id)"""

SQL["append_transactions"] = with_(TX) + """
SELECT id, user_id, date, amount, 'debito' AS transaction_type, false AS is_night, 0 AS risk_score,
       'import' AS source, strftime(date, '%Y-%m') AS year_month
FROM tx"""

SQL["scan_transactions"] = with_(TX) + """
SELECT id, user_id, date, amount, category FROM tx
WHERE date BETWEEN DATE '2024-01-10' AND DATE '2024-01-20' AND category = 'delivery'
ORDER BY date DESC, id DESC LIMIT 100"""


# ---------------------------------------------------------------- streaming
SQL["stream_risk"] = with_(TX, RECENT, SCORED) + "SELECT id, user_id, recent_count, risk_score, is_high_risk FROM scored2"
SQL["stream_alerts"] = with_(TX, RECENT, SCORED) + """
SELECT id, user_id, risk_score, CASE WHEN is_night THEN 'night' ELSE 'impulse' END AS alert_type
FROM scored2 WHERE is_high_risk"""
SQL["stream_daily"] = with_(TX) + """, d AS (
  SELECT user_id, date, round_even(sum(amount), 2) AS amount, count(*) AS n FROM tx GROUP BY user_id, date)
SELECT * FROM d"""


# ------------------------------------------------------------------ extras
from moneta.operators.profile import PROFILE_DEFINITIONS as _PD  # noqa: E402

_PDIM = "pdim AS (SELECT * FROM (VALUES " + ", ".join(
    f"({_q(k)}, {_q(d)}, {_q(r)}, {_q('|'.join(sg))})" for k, (d, r, sg) in _PD.items()
) + ") t(profile, description, risk_level, suggestions))"

SQL["behavior_profile_details"] = SQL["behavior_profile"].replace(
    "\nSELECT sc.user_id, coalesce(agg.top_nm, 'controlado') AS profile,",
    ", " + _PDIM + ",\nprof AS (SELECT sc.user_id, coalesce(agg.top_nm, 'controlado') AS profile,", 1) + """)
SELECT prof.user_id, prof.profile, coalesce(pdim.description, '') AS description,
       coalesce(pdim.risk_level, '') AS risk_level, coalesce(pdim.suggestions, '') AS suggestions
FROM prof LEFT JOIN pdim USING (profile)"""

SQL["by_decade_wide"] = _decade_sql("tx", TX).replace("SELECT *, round_even(receipts - payments, 2) AS difference FROM b", """
SELECT user_id, year_month,
       max(CASE WHEN decade = '1_10' THEN receipts END) AS receipts_1_10, max(CASE WHEN decade = '1_10' THEN payments END) AS payments_1_10,
       max(CASE WHEN decade = '11_20' THEN receipts END) AS receipts_11_20, max(CASE WHEN decade = '11_20' THEN payments END) AS payments_11_20,
       max(CASE WHEN decade = '21_31' THEN receipts END) AS receipts_21_31, max(CASE WHEN decade = '21_31' THEN payments END) AS payments_21_31
FROM b GROUP BY user_id, year_month""")

SQL["zscore_amount"] = with_(TX) + """, st AS (SELECT user_id, avg(amount) AS m, stddev_pop(amount) AS s FROM tx GROUP BY user_id)
SELECT id, user_id, round_even((amount - m) / nullif(s, 0.0), 6) AS z FROM tx JOIN st USING (user_id)"""

SQL["budget_usage"] = with_(TX) + """, up AS (SELECT user_id, ts, CASE WHEN event_type = 'signup' THEN value * 100 END AS ml FROM events),
lim AS (SELECT user_id, arg_max(ml, CASE WHEN ml IS NOT NULL THEN ts END) AS ml FROM up GROUP BY user_id),
lim2 AS (SELECT c_custkey AS user_id, round_even(lim.ml, 2) AS monthly_limit FROM customer JOIN lim ON lim.user_id = c_custkey
         WHERE lim.ml IS NOT NULL),
m AS (SELECT user_id, strftime(date, '%Y-%m') AS year_month, sum(amount) AS s FROM tx WHERE transaction_type = 'debito' GROUP BY ALL)
SELECT m.user_id, year_month, round_even(s, 2) AS spent, round_even(monthly_limit, 2) AS monthly_limit,
       round_even(s / monthly_limit * 100, 1) AS percent
FROM m JOIN lim2 USING (user_id)"""

SQL["merge_statement_pages"] = with_(TX) + """, b AS (
  SELECT user_id, user_id * 1000000 + CAST(strftime(date, '%Y%m') AS BIGINT) AS doc_id,
         CASE WHEN day(date) <= 10 THEN 0 WHEN day(date) <= 20 THEN 1 ELSE 2 END AS page,
         strftime(date, '%d/%m/%Y') AS data, description AS descricao, amount AS valor, transaction_type AS tipo,
         coalesce(category, 'outros') AS categoria_sugerida, id AS k
  FROM tx),
pg AS (SELECT doc_id, page, any_value(user_id) AS user_id, min(k) AS k,
              sum(CASE WHEN tipo = 'credito' THEN valor ELSE -valor END) AS net FROM b GROUP BY doc_id, page),
ok AS (SELECT * FROM pg WHERE k % 17 <> 0),
hdr AS (SELECT doc_id, arg_min(net, page) AS net, arg_min(user_id, page) AS uid FROM ok GROUP BY doc_id),
items AS (SELECT b.*, row_number() OVER (PARTITION BY b.doc_id, b.page ORDER BY b.data, b.descricao, b.valor, b.tipo, b.categoria_sugerida, b.k) - 1 AS pos
          FROM b JOIN ok USING (doc_id, page))
SELECT doc_id, page, pos, 'Banco Teste' AS banco, CAST(hdr.uid AS VARCHAR) AS conta, round_even(hdr.net, 2) AS saldo_final,
       data, descricao, round_even(valor, 2) AS valor, tipo, categoria_sugerida
FROM items JOIN hdr USING (doc_id)"""

SQL["nb_model_roundtrip"] = SQL["nb_log_probs"]


# every delay is released in the end
SQL["stream_delays"] = _IV_BASE + f""", dl AS (
  SELECT user_id, id AS transaction_id, "timestamp" AS set_at,
         "timestamp" + ({_DELAY}) * INTERVAL 1 MINUTE AS expires_at FROM ivc WHERE {_DELAY} IS NOT NULL)
SELECT user_id, transaction_id, expires_at, true AS can_proceed FROM dl"""


# Holt-Winters with fixed alpha=0.3, beta=0.1, gamma=0.2 as a recursive CTE (seasonal slots as columns)
_S_OLD = "CASE r.t % 7 WHEN 0 THEN r.s0 WHEN 1 THEN r.s1 WHEN 2 THEN r.s2 WHEN 3 THEN r.s3 WHEN 4 THEN r.s4 WHEN 5 THEN r.s5 WHEN 6 THEN r.s6 END"
_S_NEW = ", ".join(
    f"CASE WHEN r.t % 7 = {j} THEN 0.2::DOUBLE * (f.y - r.l - r.b) + 0.8::DOUBLE * ({_S_OLD}) ELSE r.s{j} END AS s{j}"
    for j in range(7))
SQL["forecast_hw_fixed"] = "WITH RECURSIVE " + with_(TX)[len("WITH "):] + f""", d AS (SELECT user_id, date, sum(amount) AS amount FROM tx GROUP BY ALL),
sp AS (SELECT user_id, min(date) AS d0, max(date) AS d1 FROM d GROUP BY user_id),
cal AS (SELECT user_id, CAST(unnest(generate_series(d0, d1, INTERVAL 1 DAY)) AS DATE) AS date FROM sp),
ser AS (SELECT cal.user_id, cal.date, coalesce(d.amount, 0.0) AS y,
               row_number() OVER (PARTITION BY cal.user_id ORDER BY cal.date) - 1 AS t
        FROM cal LEFT JOIN d USING (user_id, date)),
nn AS (SELECT user_id, count(*) AS n, max(date) AS last_date FROM ser GROUP BY user_id HAVING count(*) >= 14),
i0 AS (SELECT s.user_id, sum(CASE WHEN t < 7 THEN y END) / 7.0 AS l0,
              sum(CASE WHEN t BETWEEN 7 AND 13 THEN y END) / 7.0 AS m2,
              """ + ", ".join(f"max(CASE WHEN t = {j} THEN y END) AS y{j}" for j in range(7)) + f"""
       FROM ser s JOIN nn USING (user_id) GROUP BY s.user_id),
rec AS (
  SELECT user_id, 7 AS t, l0 AS l, (m2 - l0) / 7.0 AS b, """ + ", ".join(f"y{j} - l0 AS s{j}" for j in range(7)) + f""",
         0.0::DOUBLE AS sse, 0.0::DOUBLE AS se, 0 AS ne
  FROM i0
  UNION ALL
  SELECT r.user_id, r.t + 1,
         0.3::DOUBLE * (f.y - ({_S_OLD})) + 0.7::DOUBLE * (r.l + r.b),
         0.1::DOUBLE * ((0.3::DOUBLE * (f.y - ({_S_OLD})) + 0.7::DOUBLE * (r.l + r.b)) - r.l) + 0.9::DOUBLE * r.b,
         {_S_NEW},
         r.sse + (f.y - (r.l + r.b + ({_S_OLD}))) * (f.y - (r.l + r.b + ({_S_OLD}))),
         r.se + (f.y - (r.l + r.b + ({_S_OLD}))), r.ne + 1
  FROM rec r JOIN ser f ON f.user_id = r.user_id AND f.t = r.t),
fin AS (SELECT r.*, nn.last_date FROM rec r JOIN nn ON nn.user_id = r.user_id AND r.t = nn.n),
sd AS (SELECT *, CASE WHEN ne > 0 THEN sqrt(greatest(sse / ne - (se / ne) * (se / ne), 0.0)) ELSE 0.0 END AS sdv FROM fin),
hh AS (SELECT sd.*, unnest(range(1, 31)) AS h FROM sd),
fc AS (SELECT user_id, h, last_date, sdv,
              l + h * b + CASE (t - 1 + h) % 7 """ + " ".join(f"WHEN {j} THEN s{j}" for j in range(7)) + """ END AS f
       FROM hh)
SELECT user_id, CAST(h AS INTEGER) AS h, CAST(last_date + CAST(h AS INTEGER) AS DATE) AS date,
       greatest(round_even(f, 2), 0.0) AS predicted, greatest(round_even(f - 1.96 * sdv, 2), 0.0) AS lower,
       greatest(round_even(f + 1.96 * sdv, 2), 0.0) AS upper, round_even(f, 6) AS raw
FROM fc"""


# ------------------------------------------------- inventory ids of their own
SQL["newest_n"] = with_(TX) + "SELECT id, user_id, date, amount FROM tx ORDER BY date DESC, id DESC LIMIT 100"
SQL["write_notifications"] = SQL["notification_retention"]
SQL["parse_extraction_json"] = """
SELECT o_orderkey AS doc_id, o_orderkey % 17 <> 0 AS parsed_ok,
       CASE WHEN o_orderkey % 17 = 0 THEN 'Não consegui ler o documento.' END AS raw_text,
       CASE WHEN o_orderkey % 17 = 0 THEN 0 ELSE (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) END AS n_items
FROM orders"""


# ------------------------------------------- payloads, guard log, free notifications
_ALT_N = f"len(coalesce({_ALT}, []))"
SQL["intervention_payload"] = with_(TX, RECENT, SCORED, _IVC, _Q, GOALS) + f""", ag AS (
  SELECT user_id, count(*) AS n_active, min(name) AS goal_name, min(target_amount) AS target,
         min(target_amount - current_amount) AS remaining FROM goals WHERE status = 'active' GROUP BY user_id),
b AS (SELECT ivq2.*, n_active, goal_name, target, remaining,
             round_even(amount / target * 100, 1) AS p_target, round_even(amount / remaining * 100, 1) AS p_left
      FROM ivq2 LEFT JOIN ag USING (user_id)),
c AS (
  SELECT id, user_id, 1 AS k, 'question' AS type, array_to_string(questions, '|') AS content, 0 AS n_goals,
         NULL::VARCHAR AS goal_message, NULL::DOUBLE AS goal_percent, NULL::INTEGER AS minutes, NULL::TIMESTAMP AS expires_at FROM b
  UNION ALL SELECT id, user_id, 2, 'visualization', concat_ws('|',
         printf('Com R$ %.2f, você poderia comer por %.1f dias', round_even(amount, 2), round_even(amount / 30, 1)),
         printf('Equivale a %.1f meses de streaming', round_even(amount / 45, 1)),
         printf('Investido, em 5 anos seria R$ %.2f', round_even(amount * {_ivd.INVESTMENT_FACTOR!r}::DOUBLE, 2)),
         printf('Você trabalha %.1f horas para ganhar isso', round_even(amount / 15, 1)),
         CASE WHEN n_active > 0 THEN printf({_q(_ivd.GOAL_IMPACT)}, p_target, goal_name) END), 0, NULL, NULL, NULL, NULL
  FROM b WHERE amount >= 50
  UNION ALL SELECT id, user_id, 3, 'comparison', printf({_q(_ivd.GOAL_SUMMARY)}, n_active), CASE WHEN remaining > 0 THEN 1 ELSE 0 END,
         CASE WHEN remaining > 0 THEN printf({_q(_ivd.GOAL_COMPARISON)}, p_left, goal_name) END,
         CASE WHEN remaining > 0 THEN p_left END, NULL, NULL FROM b WHERE n_active > 0
  UNION ALL SELECT id, user_id, 4, 'alternative', array_to_string({_ALT}, '|'), 0, NULL, NULL, NULL, NULL FROM b WHERE {_ALT_N} > 0
  UNION ALL SELECT id, user_id, 5, 'delay', printf('Aguarde %d minutos antes de confirmar', {_DELAY}), 0, NULL, NULL, {_DELAY},
         "timestamp" + ({_DELAY}) * INTERVAL 1 MINUTE FROM b WHERE level IN ('strong', 'critical')
  UNION ALL SELECT id, b.user_id, 6, 'block', block_reason, 0, NULL, NULL, NULL, NULL
  FROM b JOIN ({SQL["intervention_block"]}) USING (id) WHERE level = 'critical')
SELECT id, user_id, CAST(row_number() OVER (PARTITION BY id ORDER BY k) - 1 AS INTEGER) AS pos, type, content, n_goals,
       goal_message, goal_percent, minutes, expires_at FROM c"""

SQL["guard_state"] = """
WITH l AS (SELECT user_id, ts, event_id % 3 AS a, CASE WHEN event_id % 2 = 0 THEN event_id % 120 ELSE 30 END AS m
           FROM events WHERE event_type = 'error' AND ts <= TIMESTAMP '2024-01-31 00:00:00'),
g AS (SELECT user_id, max(CASE WHEN a = 0 THEN ts END) AS on_, max(CASE WHEN a = 1 THEN ts END) AS off_,
             max(CASE WHEN a = 2 THEN ts END) AS by_,
             arg_max(ts + to_minutes(CAST(m AS INTEGER)), ts) FILTER (WHERE a = 2) AS until_ FROM l GROUP BY user_id),
s AS (SELECT user_id, off_ IS NULL OR coalesce(on_ >= off_, false) AS enabled,
             CASE WHEN NOT coalesce(on_ >= by_, false) THEN until_ END AS bypass_until FROM g)
SELECT user_id, enabled, coalesce(TIMESTAMP '2024-01-31 00:00:00' < bypass_until, false) AS bypass_active, bypass_until FROM s"""

SQL["create_notification"] = with_(TX) + """
SELECT md5('custom|' || CAST(id AS VARCHAR)) AS notification_id, user_id, NULL::VARCHAR AS template,
       'Compra registrada' AS title, 'Categoria: ' || category AS message,
       CASE WHEN amount >= 100 THEN 'warning' ELSE 'info' END AS type,
       CASE WHEN amount >= 50 THEN 'budget' ELSE 'general' END AS category, "timestamp" AS created_at, amount
FROM tx"""


_T = """(SELECT * FROM tx WHERE transaction_type = 'debito' AND date - DATE '1970-01-01' <= (SELECT quantile_cont(date - DATE '1970-01-01', 0.5) FROM tx))"""
_MF = lambda name, src: f"""{name}0 AS (
  SELECT id, coalesce(amount, 0.0) AS f_amount, hour("timestamp") AS hour, isodow("timestamp") - 1 AS day_of_week,
         day("timestamp") AS day_of_month, coalesce(menc.code, -1) AS category_encoded
  FROM {src} t LEFT JOIN menc ON coalesce(t.category, 'outros') = menc.value),
{name} AS (SELECT *, CAST(f_amount > (SELECT quantile_cont(f_amount, 0.9) FROM {name}0) AS INTEGER) AS is_high_amount,
                  CAST(hour BETWEEN 0 AND 6 AS INTEGER) AS is_night, CAST(day_of_week >= 5 AS INTEGER) AS is_weekend FROM {name}0)"""
SQL["anomaly_model_features"] = with_(TX) + f""",
menc AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS code
         FROM (SELECT DISTINCT coalesce(category, 'outros') AS value FROM {_T})),
{_MF('fitf', _T)}, {_MF('newf', 'tx')},
ms AS (SELECT """ + ", ".join(
    f"avg(CAST({_src(c)} AS DOUBLE)) AS m_{c}, stddev_pop(CAST({_src(c)} AS DOUBLE)) AS s_{c}" for c in _FCOLS
) + " FROM fitf)\nSELECT id, category_encoded, is_high_amount, " + ", ".join(
    f"round_even((CAST({_src(c)} AS DOUBLE) - m_{c}) / CASE WHEN s_{c} IS NULL OR s_{c} = 0 THEN 1.0 ELSE s_{c} END, 6) AS z_{c}"
    for c in _FCOLS) + " FROM newf, ms"


SQL["label_encode_unseen"] = with_(TX) + f""",
denc AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS code
         FROM (SELECT DISTINCT coalesce(description, 'outros') AS value FROM {_T}))
SELECT id, CAST(coalesce(code, -1) AS INTEGER) AS code_of_description FROM tx LEFT JOIN denc ON coalesce(description, 'outros') = value"""

_GIVEN_NODES = """(VALUES (0, 0, 0, 60.0, 1, 2, 0.0), (0, 1, 1, 6.5, 3, 4, 0.0), (0, 2, -1, 0.0, -1, -1, 2.5), (0, 3, -1, 0.0, -1, -1, 3.25),
  (0, 4, -1, 0.0, -1, -1, 4.5), (1, 0, 2, 4.5, 1, 2, 0.0), (1, 1, -1, 0.0, -1, -1, 4.0), (1, 2, 0, 25.0, 3, 4, 0.0), (1, 3, -1, 0.0, -1, -1, 3.0),
  (1, 4, -1, 0.0, -1, -1, 2.0), (2, 0, 1, 22.5, 1, 2, 0.0), (2, 1, 0, 90.0, 3, 4, 0.0), (2, 2, -1, 0.0, -1, -1, 1.0), (2, 3, -1, 0.0, -1, -1, 4.75),
  (2, 4, -1, 0.0, -1, -1, 2.25)) n(tree, node, feature, threshold, l, r, value)"""
SQL["given_forest_score"] = with_(TX).replace("WITH ", "WITH RECURSIVE ", 1) + f""",
nodes AS (SELECT tree, node, feature, CAST(threshold AS DOUBLE) AS threshold, l, r, CAST(value AS DOUBLE) AS value FROM {_GIVEN_NODES}),
x AS (SELECT id, [coalesce(amount, 0.0), hour("timestamp"), isodow("timestamp") - 1] AS f FROM tx),
walk AS (
  SELECT id, tree, 0 AS node FROM x, (SELECT DISTINCT tree FROM nodes)
  UNION ALL
  SELECT w.id, w.tree, CASE WHEN x.f[n.feature + 1] <= n.threshold THEN n.l ELSE n.r END
  FROM walk w JOIN nodes n ON n.tree = w.tree AND n.node = w.node JOIN x ON x.id = w.id WHERE n.feature >= 0),
ends AS (
  SELECT w.id, avg(n.value) AS h FROM walk w JOIN nodes n ON n.tree = w.tree AND n.node = w.node WHERE n.feature < 0 GROUP BY w.id),
s AS (SELECT id, -pow(2.0, -h / (2 * (ln(7) + 0.5772156649015329) - 2 * 7 / 8.0)) AS s FROM ends)
SELECT id, round_even(s, 9) AS score_samples, round_even(s + 0.5, 9) AS decision, s + 0.5 < 0 AS is_anomaly FROM s"""


_CENTRES = """(VALUES (0, 0, -0.5, -1.0, -1.0), (0, 1, -0.5, 1.0, 0.5), (0, 2, 0.5, -1.0, 1.0), (0, 3, 2.0, 0.25, 0.0),
  (1, 0, 0.0, 0.0, -1.5), (1, 1, 0.0, 0.0, 1.5), (1, 2, 1.0, 1.0, 0.0), (1, 3, -1.0, -1.0, 0.0)) v(start, cluster, a, h, w)"""
SQL["kmeans_step"] = with_(TX) + f""",
f AS (SELECT id, amount AS a, CAST(hour("timestamp") AS DOUBLE) AS h, CAST(isodow(date) - 1 AS DOUBLE) AS w FROM tx),
z AS (SELECT id, (a - avg(a) OVER ()) / stddev_pop(a) OVER () AS a, (h - avg(h) OVER ()) / stddev_pop(h) OVER () AS h,
             (w - avg(w) OVER ()) / stddev_pop(w) OVER () AS w FROM f),
c AS (SELECT start, cluster, CAST(a AS DOUBLE) AS a, CAST(h AS DOUBLE) AS h, CAST(w AS DOUBLE) AS w FROM {_CENTRES}),
d AS (SELECT id, start, cluster, z.a, z.h, z.w, (z.a - c.a) ** 2 + (z.h - c.h) ** 2 + (z.w - c.w) ** 2 AS d FROM z, c),
n AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY id, start ORDER BY d, cluster) = 1)
SELECT start, cluster, count(*) AS n, round_even(sum(d), 4) AS cost, round_even(avg(a), 6) AS new_amount,
       round_even(avg(h), 6) AS new_hour, round_even(avg(w), 6) AS new_day_of_week
FROM n GROUP BY start, cluster"""

SQL["describe_given_clusters"] = with_(TX) + """,
c AS (SELECT *, hour("timestamp") AS hr, CAST(least(floor(amount / 40), 3) AS INTEGER) AS cluster FROM tx),
m AS (SELECT cluster, category FROM (SELECT cluster, category, count(*) AS n FROM c WHERE category IS NOT NULL GROUP BY ALL)
      QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY n DESC, category) = 1),
g AS (SELECT cluster, count(*) AS size, avg(amount) AS a, sum(amount) AS t, avg(hr) AS h, quantile_cont(amount, 0.75) AS q75,
             quantile_cont(amount, 0.25) AS q25, (SELECT count(*) FROM c) AS n FROM c GROUP BY cluster),
s AS (SELECT g.*, concat_ws('|', CASE WHEN a > q75 THEN 'Valores altos' WHEN a < q25 THEN 'Valores baixos' END,
             CASE WHEN h >= 0 AND h <= 6 THEN 'Predominantemente noturno' WHEN h > 6 AND h <= 12 THEN 'Predominantemente matutino'
                  WHEN h > 12 AND h <= 18 THEN 'Predominantemente vespertino' END,
             CASE WHEN category IS NOT NULL THEN 'Categoria principal: ' || category END) AS ch
      FROM g LEFT JOIN m ON g.cluster IS NOT DISTINCT FROM m.cluster)
SELECT cluster, size, round_even(size / n * 100, 1) AS percentage, round_even(a, 2) AS avg_amount, round_even(t, 2) AS total_amount,
       CASE WHEN ch = '' THEN 'Padrão misto' ELSE ch END AS characteristics FROM s"""


SQL["profile_state"], SQL["goal_state"], SQL["ack_state"] = SQL["profile_upsert"], SQL["goal_updates"], SQL["acknowledge_alerts"]


SQL["suggest_categories_dictionary"] = SQL["suggest_categories"]
SQL["suggest_categories_dictionary_merchants"] = SQL["suggest_categories_merchants"]


SQL["route_uploads"] = """
WITH u AS (SELECT doc_id, ['csv', 'ofx', 'pdf', 'png', 'jpg', 'jpeg', 'txt', 'json'][doc_id % 8 + 1] AS extension,
                  octet_length(encode(text)) * 1024 AS length FROM documents),
a AS (SELECT doc_id, extension, extension IN ('csv', 'ofx', 'pdf', 'png', 'jpg', 'jpeg') AND coalesce(length <= 10 * 1024 * 1024, false) AS allowed FROM u)
SELECT doc_id, extension, allowed, CASE WHEN NOT allowed THEN NULL WHEN extension IN ('png', 'jpg', 'jpeg') THEN 'image' ELSE extension END AS reader
FROM a"""


def _fix_round(sql: str) -> str:
    """Rewrite round_even(x, d) as decimal rounding, the twin of functions.common.rnd."""
    out, i, tok = [], 0, "round_even("
    while True:
        j = sql.find(tok, i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        out.append(sql[i:j])
        k, depth, comma = j + len(tok), 1, None
        while depth:
            ch = sql[k]
            if ch == "(":
                depth += 1
            elif ch == ")":
                depth -= 1
            elif ch == "," and depth == 1:
                comma = k
            k += 1
        arg = _fix_round(sql[j + len(tok):comma])
        digits = sql[comma + 1:k - 1].strip()
        out.append(f"CAST(round_even(CAST({arg} AS DECIMAL(38,6)), {digits}) AS DOUBLE)")
        i = k


SQL = {k: _fix_round(v) for k, v in SQL.items()}
