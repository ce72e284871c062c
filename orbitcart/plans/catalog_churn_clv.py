"""Registered queries: churn (I) and customer lifetime value (J).

These queries run on the rule-based scores (I8 probability, J2 closed-form CLV), which SQL can
reproduce; ``catalog_scores`` runs the same pages on the stored scores of the fitted models.
Model fits (I1-I7, J3-J6) are registered without oracle SQL.
"""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from orbitcart.operators import churn as I
from orbitcart.operators import clv as J
from orbitcart.plans.jobs import jobs
from orbitcart.plans.oracle import DAYS, MSUM, R, with_base
from orbitcart.plans.pipeline import retail
from orbitcart.plans.registry import query, rounded

_P = "least(greatest(recency_days / 180.0, 0.05), 0.95)"
_TIER = """CASE WHEN {p} >= 0.8 THEN 'Critical' WHEN {p} >= 0.6 THEN 'High' WHEN {p} >= 0.4 THEN 'Medium'
     WHEN {p} >= 0.2 THEN 'Low' ELSE 'Very Low' END"""
_SCORED = f"""
, sc AS (SELECT fs.*, {_P} AS churn_probability FROM fs),
scr AS (SELECT sc.*, {_TIER.format(p='churn_probability')} AS risk_level FROM sc)"""


def _j(spark, sf):
    return jobs(spark, sf)


# ---------------------------------------------------------------- I: churn

@query("I9_risk_tiers", with_base(f"""{_SCORED}
SELECT customer_unique_id, {R('churn_probability', 6)} AS churn_probability, risk_level,
       risk_level || ' Risk' AS risk_tier FROM scr"""))
def i9(spark, sf):
    return risk_page(_j(spark, sf).scored)


def risk_page(scored):
    return rounded(scored.select("customer_unique_id", "churn_probability", "risk_level",
                                 I.risk_tier(F.col("churn_probability"), " Risk").alias("risk_tier")),
                   {"churn_probability": 6})


def _actions_values() -> str:
    esc = lambda x: x.replace("'", "''")
    return ", ".join(f"('{k}', '{esc(a)}', '{esc(p)}')" for k, (a, p) in I.RETENTION_ACTIONS.items())


@query("I10_retention_actions", with_base(f"""{_SCORED},
dim(risk_level, recommended_retention_actions, retention_action_plan) AS (VALUES {_actions_values()})
SELECT customer_unique_id, risk_level, recommended_retention_actions, retention_action_plan
FROM scr LEFT JOIN dim USING (risk_level)"""))
def i10(spark, sf):
    return actions_page(_j(spark, sf).scored)


def actions_page(scored):
    return scored.select("customer_unique_id", "risk_level", "recommended_retention_actions", "retention_action_plan")


@query("I11_high_risk_roster", with_base(f"""{_SCORED}
SELECT customer_unique_id, {R('churn_probability', 6)} AS churn_probability, risk_level, total_spending
FROM scr WHERE risk_level IN ('High', 'Critical')"""))
def i11(spark, sf):
    return roster_page(_j(spark, sf).scored)


def roster_page(scored):
    return rounded(I.high_risk_roster(scored).select(
        "customer_unique_id", "churn_probability", "risk_level", "total_spending"), {"churn_probability": 6})


@query("I12_risk_distribution", with_base(f"""{_SCORED},
spine(tier_rank, risk_tier) AS (VALUES (0, 'Very Low Risk'), (1, 'Low Risk'), (2, 'Medium Risk'), (3, 'High Risk'),
                                      (4, 'Critical Risk')),
agg AS (SELECT risk_level || ' Risk' AS risk_tier, count(*) AS customer_count, {MSUM('total_spending')} AS total_revenue
        FROM scr GROUP BY 1)
SELECT CAST(tier_rank AS INTEGER) AS tier_rank, risk_tier, coalesce(customer_count, 0) AS customer_count,
       coalesce(total_revenue, 0.0) AS total_revenue FROM spine LEFT JOIN agg USING (risk_tier)"""))
def i12(spark, sf):
    return I.risk_distribution(_j(spark, sf).scored)


def _i13_sql() -> str:
    def scoped(s, flt):
        w = f" FILTER (WHERE {flt})" if flt else ""
        a = f"{flt} AND " if flt else ""
        return (f"count(*){w} AS customers_{s}, count(*) FILTER (WHERE {a}churn_probability >= 0.6 AND "
                f"churn_probability < 0.8) AS high_risk_{s}, count(*) FILTER (WHERE {a}churn_probability >= 0.8) "
                f"AS critical_risk_{s}, coalesce(avg(churn_probability){w} * 100.0, 0.0) AS avg_churn_probability_{s}, "
                f"coalesce(avg(CAST(churn_probability >= 0.5 AS DOUBLE)){w} * 100.0, 0.0) AS predicted_churn_rate_{s}, "
                f"coalesce(avg(historical_clv){w}, 0.0) AS avg_clv_{s}, "
                f"coalesce({R(f'sum(historical_clv) FILTER (WHERE {a}churn_probability >= 0.6)', 2)}, 0.0) AS revenue_at_risk_{s}")
    names = ["customers", "high_risk", "critical_risk", "avg_churn_probability", "predicted_churn_rate", "avg_clv",
             "revenue_at_risk"]
    rows = "\nUNION ALL ".join(
        f"SELECT '{n}' AS kpi, CAST({n}_t AS DOUBLE) AS total, CAST({n}_c AS DOUBLE) AS current, "
        f"CAST({n}_p AS DOUBLE) AS previous FROM w" for n in names)
    return with_base(f"""{_SCORED},
b AS (SELECT epoch_us(min(last_purchase_date)) AS lo, epoch_us(max(last_purchase_date)) AS hi FROM scr),
m AS (SELECT scr.*, last_purchase_date >= make_timestamp(CAST(lo + floor((hi - lo) / 2) AS BIGINT)) AS cur FROM scr, b),
w AS (SELECT {scoped('t', '')}, {scoped('c', 'cur')}, {scoped('p', 'NOT cur')} FROM m),
long AS ({rows})
SELECT kpi, {R('total', 6)} AS total, {R('current', 6)} AS current, {R('previous', 6)} AS previous,
       {R("CASE WHEN previous = 0 OR previous IS NULL THEN 0.0 ELSE abs((current - previous) / abs(previous) * 100.0) END", 4)} AS change_pct,
       CASE WHEN previous = 0 OR previous IS NULL THEN true ELSE current >= previous END AS is_positive
FROM long""")


@query("I13_churn_kpis", _i13_sql())
def i13(spark, sf):
    return churn_kpi_page(_j(spark, sf).scored)


def churn_kpi_page(scored):
    return rounded(I.churn_kpis(scored), {"total": 6, "current": 6, "previous": 6, "change_pct": 4})


def _attr_sql() -> str:
    parts = []
    names = []
    for name, c, centre, w, sign in I.CHURN_ATTRIBUTION:
        diff = f"({c} - {centre})" if sign > 0 else f"({centre} - {c})"
        alias = "attr_" + name.split(" ")[0].lower()
        parts.append(f"{R(f'{diff} * {w}', 3)} AS {alias}")
        names.append((name, alias))
    pos = ", ".join(f"CASE WHEN {a} > 0 THEN '{n}' END" for n, a in names)
    neg = ", ".join(f"CASE WHEN {a} <= 0 THEN '{n}' END" for n, a in names)
    return with_base(f"""
, a AS (SELECT customer_unique_id, {', '.join(parts)} FROM fs)
SELECT a.*, concat_ws(', ', {pos}) AS risk_drivers, concat_ws(', ', {neg}) AS protective_drivers FROM a""")


@query("I14_churn_attributions", _attr_sql())
def i14(spark, sf):
    a = I.churn_attributions(retail(spark, sf).feature_store)
    return a.select(*[c for c in a.columns if c.startswith("attr_") or c == "customer_unique_id"],
                    F.array_join(F.transform("risk_drivers", lambda s: s["driver"]), ", ").alias("risk_drivers"),
                    F.array_join(F.transform("protective_drivers", lambda s: s["driver"]), ", ")
                    .alias("protective_drivers"))


@query("I15_churn_narrative", with_base("""
SELECT customer_unique_id,
       printf('Customer **%s** has a predicted churn probability of **%.1f%%**:', CAST(customer_unique_id AS VARCHAR),
              least(greatest(recency_days / 180.0, 0.05), 0.95) * 100.0) || chr(10)
       || CASE WHEN recency_days > 90 THEN printf('• **Prolonged Inactivity**: No purchases for %.0f consecutive days.', recency_days)
               ELSE printf('• **Active Recency**: Purchased recently within %.0f days.', recency_days) END || chr(10)
       || CASE WHEN total_orders <= 1 THEN '• **Single Order Risk**: Customer has not yet placed a repeat order.'
               ELSE printf('• **Established Frequency**: Placed %.0f lifetime orders.', CAST(total_orders AS DOUBLE)) END || chr(10)
       || CASE WHEN avg_review_score_given <= 3.0
               THEN printf('• **Low CSAT Score**: Rated previous order %.1f out of 5 stars.', avg_review_score_given)
               ELSE printf('• **High Satisfaction**: Rated previous order %.1f out of 5 stars.', avg_review_score_given) END AS narrative
FROM fs"""))
def i15(spark, sf):
    return I.churn_narrative(_j(spark, sf).scored)


@query("I17_purchase_timeline", with_base(f"""
, po AS (SELECT customer_unique_id, order_id, min(order_purchase_timestamp) AS ts, {MSUM('price')} AS order_value,
                count(*) AS items, string_agg(DISTINCT product_category_name_english, ', ' ORDER BY product_category_name_english) AS categories,
                min(preferred_payment_type) AS payment_method FROM master GROUP BY 1, 2)
SELECT customer_unique_id, order_id, ts, order_value, items, categories, payment_method,
       row_number() OVER (PARTITION BY customer_unique_id ORDER BY ts, order_id) AS order_seq,
       {DAYS('ts', 'lag(ts) OVER (PARTITION BY customer_unique_id ORDER BY ts, order_id)')} AS days_since_prev
FROM po"""))
def i17(spark, sf):
    return I.purchase_timeline(retail(spark, sf).master)


@query("I18_batch_summary", with_base(f"""{_SCORED}
SELECT count(*) AS records, count(*) FILTER (WHERE churn_probability >= 0.6) AS high_or_critical,
       {R('avg(CAST(churn_probability >= 0.6 AS DOUBLE)) * 100.0', 6)} AS high_or_critical_pct,
       {R('avg(churn_probability) * 100.0', 6)} AS avg_probability_pct FROM scr"""))
def i18(spark, sf):
    return batch_page(_j(spark, sf).scored)


def batch_page(scored):
    return rounded(I.batch_summary(scored), {"high_or_critical_pct": 6, "avg_probability_pct": 6})


@query("I19_retention_targets", with_base(f"""{_SCORED},
seg AS (SELECT * FROM (VALUES
  (0, 'Critical-Risk Customers (>80% churn prob)'), (1, 'High-Value At-Risk Buyers (CLV > $1,000)'),
  (2, 'High-Risk Repeat Buyers (60-80% churn prob)'), (3, 'Medium-Risk Buyers (40-60% churn prob)'),
  (4, 'Loyal Customers showing early drop-off'), (5, 'Gold Tier Buyers near Platinum threshold'),
  (6, 'Single-Order Buyers at risk'), (7, 'Low-Risk Single-Category Buyers')) v(priority, target_segment)),
flag AS (SELECT total_spending, [churn_probability > 0.8, historical_clv > 1000 AND churn_probability >= 0.6,
           churn_probability >= 0.6 AND churn_probability < 0.8 AND total_orders > 1,
           churn_probability >= 0.4 AND churn_probability < 0.6,
           rfm_segment IN ('Champions', 'Loyal Customers') AND recency_days > 60, spending_tier = 'Tier 3 - Gold',
           total_orders = 1 AND churn_probability >= 0.4,
           churn_probability < 0.4 AND distinct_categories_count = 1] AS f FROM scr)
SELECT CAST(priority AS INTEGER) AS priority, target_segment,
       count(flag.total_spending) AS customer_count, coalesce({MSUM('flag.total_spending')}, 0.0) AS total_revenue
FROM seg LEFT JOIN flag ON flag.f[priority + 1] GROUP BY priority, target_segment"""))
def i19(spark, sf):
    return I.retention_targets(_j(spark, sf).scored)


@query("I20_churn_profile_search", with_base(f"""{_SCORED}
SELECT customer_unique_id, {R('churn_probability', 6)} AS churn_probability, risk_level, total_orders, total_spending
FROM scr WHERE contains(CAST(customer_unique_id AS VARCHAR), '12')"""))
def i20(spark, sf):
    j = _j(spark, sf)
    p = I.search_churn_profile(j.scored, j.r.master, "12")
    return rounded(p.select("customer_unique_id", "churn_probability", "risk_level", "total_orders", "total_spending"),
                   {"churn_probability": 6})


@query("I3_oversampled_training_rows")
def i3_oversampled(spark, sf):
    """Both classes of the training split in equal number, new rows on lines between near neighbours."""
    train, _ = I.split_train_test(I.prepare_labels(retail(spark, sf).feature_store))
    steps = I.churn_pipeline("logistic", weight_col=None).getStages()[:-1]
    return I.balanced_rows(Pipeline(stages=steps).fit(train).transform(train))


@query("I4_churn_model_metrics")
def i4(spark, sf):
    return _j(spark, sf).churn_model[1]


@query("I7_churn_model_scores")
def i7(spark, sf):
    return _j(spark, sf).model_scored.select("customer_unique_id", "churn_probability", "risk_level")


# ---------------------------------------------------------------- J: CLV

_CLVF = f"""
, cf1 AS (SELECT fs.*, total_orders / greatest(customer_age_days / 30.0, 1.0) AS purchase_velocity,
                 avg_order_value * purchase_frequency_monthly AS spending_trend,
                 total_orders * avg_review_score_given AS engagement_score,
                 distinct_categories_count / greatest(total_orders, 1) AS category_diversity,
                 total_spending + purchase_frequency_monthly * avg_order_value * 12.0 AS clv_target FROM fs),
cf2 AS (SELECT cf1.*, greatest(clv_target, 0.0) AS predicted_clv FROM cf1),
qs AS (SELECT quantile_cont(predicted_clv, [0.5, 0.8, 0.95]) AS q FROM cf2),
cv AS (SELECT cf2.*, CASE WHEN predicted_clv >= q[3] THEN 'Platinum (Top 5%)' WHEN predicted_clv >= q[2] THEN 'Gold (Top 20%)'
                          WHEN predicted_clv >= q[1] THEN 'Silver (Top 50%)' WHEN predicted_clv > 0 THEN 'Bronze'
                          ELSE 'Low Value' END AS clv_value_tier FROM cf2, qs)"""


@query("J1_clv_features", with_base(f"""{_CLVF}
SELECT customer_unique_id, {R('purchase_velocity', 6)} AS purchase_velocity, {R('spending_trend', 4)} AS spending_trend,
       {R('engagement_score', 6)} AS engagement_score, {R('category_diversity', 6)} AS category_diversity,
       {R('clv_target', 4)} AS clv_target, {R('predicted_clv', 4)} AS predicted_clv FROM cv"""))
def j1(spark, sf):
    c = _j(spark, sf).clv_frame
    return rounded(c.select("customer_unique_id", "purchase_velocity", "spending_trend", "engagement_score",
                            "category_diversity", "clv_target", "predicted_clv"),
                   {"purchase_velocity": 6, "spending_trend": 4, "engagement_score": 6, "category_diversity": 6,
                    "clv_target": 4, "predicted_clv": 4})


def _opp_case(col: str) -> str:
    conds = ["contains(clv_value_tier, 'Platinum')", "contains(clv_value_tier, 'Gold') AND total_orders >= 2",
             "contains(clv_value_tier, 'Silver') AND total_orders = 1", "total_spending < 100 AND predicted_clv > 300"]
    idx = 0 if col == "type" else 1
    whens = " ".join(f"WHEN {c} THEN '{J.OPPORTUNITIES[i][idx]}'" for i, c in enumerate(conds))
    return f"CASE {whens} ELSE '{J.OPPORTUNITIES[4][idx]}' END"


@query("J8_opportunities", with_base(f"""{_CLVF}
SELECT customer_unique_id, clv_value_tier, {_opp_case('type')} AS revenue_opportunity_type,
       {_opp_case('rec')} AS revenue_recommendation FROM cv"""))
def j8(spark, sf):
    return opportunity_page(_j(spark, sf).clv_frame)


def opportunity_page(frame):
    return frame.select("customer_unique_id", "clv_value_tier", "revenue_opportunity_type", "revenue_recommendation")


@query("J7_value_tiers", with_base(f"""{_CLVF}
SELECT clv_value_tier, count(*) AS customers, {R('sum(predicted_clv)', 4)} AS predicted_clv FROM cv GROUP BY 1"""))
def j7(spark, sf):
    return tier_page(_j(spark, sf).clv_frame)


def tier_page(frame):
    return rounded(frame.groupBy("clv_value_tier").agg(F.count(F.lit(1)).alias("customers"),
                                                       F.sum("predicted_clv").alias("predicted_clv")),
                   {"predicted_clv": 4})


@query("J9_high_value_roster", with_base(f"""{_CLVF}
SELECT customer_unique_id, {R('predicted_clv', 4)} AS predicted_clv, clv_value_tier FROM cv
WHERE regexp_matches(clv_value_tier, 'Platinum|Gold')"""))
def j9(spark, sf):
    return value_roster_page(_j(spark, sf).clv_frame)


def value_roster_page(frame):
    return rounded(J.high_value_roster(frame).select("customer_unique_id", "predicted_clv", "clv_value_tier"),
                   {"predicted_clv": 4})


@query("J10_monthly_projection", with_base(f"""{_CLVF}
, t AS (SELECT sum(predicted_clv) AS t FROM cv)
SELECT 'Month ' || CAST(m AS VARCHAR) AS forecast_month, CAST(m AS INTEGER) AS month,
       {R('t / 12.0 * (1.0 + 0.02 * (m - 1))', 2)} AS projected_revenue
FROM t, range(1, 13) r(m)"""))
def j10(spark, sf):
    return projection_page(_j(spark, sf).clv_frame)


def projection_page(frame):
    return rounded(J.monthly_projection(frame), {"projected_revenue": 2})


_FIXED = """CASE WHEN historical_clv >= 2500 THEN 'Platinum' WHEN historical_clv >= 1200 THEN 'Gold'
  WHEN historical_clv >= 600 THEN 'Silver' WHEN historical_clv >= 250 THEN 'Bronze' ELSE 'Standard' END"""


@query("J11_fixed_tiers", with_base(f"SELECT customer_unique_id, {_FIXED} AS value_tier FROM fs"))
def j11(spark, sf):
    fs = retail(spark, sf).feature_store
    return fs.select("customer_unique_id", J.fixed_tier(F.col("historical_clv")).alias("value_tier"))


@query("J12_tier_matrix", with_base(f"""
, agg AS (SELECT {_FIXED} AS value_tier, count(*) AS customer_count, {MSUM('total_spending')} AS total_revenue,
                 avg(total_spending) AS avg_spending, avg(total_orders) AS avg_orders, avg(churn_label) AS churn_rate
          FROM fs GROUP BY 1),
tot AS (SELECT sum(total_spending) AS t FROM fs),
spine(tier_rank, value_tier) AS (VALUES (0, 'Platinum'), (1, 'Gold'), (2, 'Silver'), (3, 'Bronze'), (4, 'Standard'))
SELECT CAST(tier_rank AS INTEGER) AS tier_rank, value_tier, coalesce(customer_count, 0) AS customer_count,
       coalesce(total_revenue, 0.0) AS total_revenue,
       {R('coalesce(total_revenue, 0.0) / greatest(t, 1.0) * 100.0', 1)} AS revenue_share_pct,
       {R('coalesce(avg_spending, 0.0)', 4)} AS avg_spending, {R('coalesce(avg_orders, 0.0)', 6)} AS avg_orders,
       {R('(1.0 - coalesce(churn_rate, 1.0)) * 100.0', 1)} AS retention_rate_pct
FROM spine LEFT JOIN agg USING (value_tier), tot"""))
def j12(spark, sf):
    return rounded(J.tier_matrix(retail(spark, sf).feature_store), {"avg_spending": 4, "avg_orders": 6})


@query("J13_clv_kpis", with_base(f"""
, w AS (SELECT sum(historical_clv) AS total_clv, avg(historical_clv) AS avg_clv, max(historical_clv) AS max_clv,
               CAST(count(*) FILTER (WHERE historical_clv >= 1000) AS DOUBLE) AS high_value_customers,
               CAST(count(*) FILTER (WHERE historical_clv >= 2500) AS DOUBLE) AS platinum_customers,
               sum(historical_clv) * 0.72 AS expected_12m_revenue, avg(total_spending) AS avg_spending FROM fs)
SELECT kpi, {R('value', 4)} AS value FROM (
  SELECT 'total_clv' AS kpi, total_clv AS value FROM w UNION ALL SELECT 'avg_clv', avg_clv FROM w
  UNION ALL SELECT 'max_clv', max_clv FROM w UNION ALL SELECT 'high_value_customers', high_value_customers FROM w
  UNION ALL SELECT 'platinum_customers', platinum_customers FROM w
  UNION ALL SELECT 'expected_12m_revenue', expected_12m_revenue FROM w UNION ALL SELECT 'avg_spending', avg_spending FROM w)"""))
def j13(spark, sf):
    return rounded(J.clv_kpis(retail(spark, sf).feature_store), {"value": 4})


def _forecast_sql(unit: str, months: int, label: str) -> str:
    return with_base(f"""
, act AS (SELECT date_trunc('{unit}', order_purchase_timestamp) AS period_start, {MSUM('price')} AS actual_revenue
          FROM master WHERE order_purchase_timestamp IS NOT NULL GROUP BY 1),
sp AS (SELECT unnest(generate_series(min(period_start), max(period_start), INTERVAL {months} MONTH)) AS period_start FROM act),
h AS (SELECT sp.period_start, coalesce(actual_revenue, 0.0) AS actual_revenue FROM sp LEFT JOIN act USING (period_start)),
h2 AS (SELECT period_start, actual_revenue, {R('actual_revenue * 1.085', 2)} AS predicted_revenue, false AS is_forecast FROM h),
h3 AS (SELECT *, {R('(predicted_revenue - actual_revenue) / greatest(actual_revenue, 1.0) * 100.0', 1)} AS variance_pct FROM h2),
last AS (SELECT period_start, predicted_revenue FROM h3 ORDER BY period_start DESC LIMIT 1),
fut AS (SELECT period_start + to_months({months} * i) AS period_start, CAST(NULL AS DOUBLE) AS actual_revenue,
               {R('predicted_revenue * (1.0 + 0.03 * i)', 2)} AS predicted_revenue, true AS is_forecast,
               i * 3.0 AS variance_pct FROM last, range(1, 4) r(i)),
u AS (SELECT * FROM h3 UNION ALL SELECT * FROM fut)
SELECT *, {label} AS period FROM u""")


query("J14_revenue_forecast_monthly", _forecast_sql("month", 1, "strftime(period_start, '%b %Y')"))(
    lambda spark, sf: J.revenue_forecast(retail(spark, sf).master, "monthly"))
query("J14_revenue_forecast_quarterly", _forecast_sql(
    "quarter", 3, "'Q' || CAST(quarter(period_start) AS VARCHAR) || ' ' || CAST(year(period_start) AS VARCHAR)"))(
    lambda spark, sf: J.revenue_forecast(retail(spark, sf).master, "quarterly"))
query("J14_revenue_forecast_annual", _forecast_sql("year", 12, "strftime(period_start, '%Y')"))(
    lambda spark, sf: J.revenue_forecast(retail(spark, sf).master, "annual"))


@query("J15_top100_leaderboard", with_base(f"""
SELECT row_number() OVER (ORDER BY historical_clv DESC, customer_unique_id) AS rank, customer_unique_id,
       {R('historical_clv', 4)} AS clv, total_spending, total_orders, {_FIXED} AS value_tier
FROM fs ORDER BY historical_clv DESC, customer_unique_id LIMIT 100"""))
def j15(spark, sf):
    return rounded(J.leaderboard(retail(spark, sf).feature_store, "historical_clv", 100), {"clv": 4})


@query("J16_clv_pareto", with_base(f"""
, r AS (SELECT row_number() OVER (ORDER BY total_spending DESC, customer_unique_id) AS rank,
               sum(total_spending) OVER (ORDER BY total_spending DESC, customer_unique_id ROWS UNBOUNDED PRECEDING) AS cum,
               count(*) OVER () AS n, sum(total_spending) OVER () AS tot FROM fs),
picks AS (SELECT DISTINCT CAST(floor(k * (n - 1) / 19.0) AS BIGINT) AS i FROM range(0, 20) t(k), (SELECT max(n) AS n FROM r))
SELECT rank, {R('CASE WHEN n > 1 THEN 1.0 + (rank - 1) * 99.0 / (n - 1) ELSE 1.0 END', 1)} AS customer_percentile,
       {R('cum / greatest(tot, 1.0) * 100.0', 1)} AS cumulative_revenue_pct
FROM r WHERE rank - 1 IN (SELECT i FROM picks)"""))
def j16(spark, sf):
    return J.clv_pareto(retail(spark, sf).feature_store, 20)


def _clv_attr_sql() -> str:
    parts, names = [], []
    for name, c, centre, w in J.CLV_ATTRIBUTION:
        alias = "attr_" + name.split(" ")[0].lower()
        parts.append(f"{R(f'({c} - {centre}) * {w}', 2)} AS {alias}")
        names.append((name, alias))
    pos = ", ".join(f"CASE WHEN {a} > 0 THEN '{n}' END" for n, a in names)
    neg = ", ".join(f"CASE WHEN {a} <= 0 THEN '{n}' END" for n, a in names)
    return with_base(f"""
, a AS (SELECT customer_unique_id, {', '.join(parts)} FROM fs)
SELECT a.*, concat_ws(', ', {pos}) AS value_drivers, concat_ws(', ', {neg}) AS value_drags FROM a""")


@query("J17_clv_attributions", _clv_attr_sql())
def j17(spark, sf):
    a = J.clv_attributions(retail(spark, sf).feature_store)
    return a.select(*[c for c in a.columns if c.startswith("attr_") or c == "customer_unique_id"],
                    F.array_join(F.transform("value_drivers", lambda s: s["driver"]), ", ").alias("value_drivers"),
                    F.array_join(F.transform("value_drags", lambda s: s["driver"]), ", ").alias("value_drags"))


@query("M17_risk_and_clv_slice", with_base(f"""{_SCORED}
SELECT customer_state, count(*) AS item_rows, count(DISTINCT order_id) AS orders FROM master
WHERE customer_unique_id IN (SELECT customer_unique_id FROM scr WHERE risk_level IN ('High', 'Critical') AND historical_clv BETWEEN 500000.0 AND 2500000.0)
GROUP BY 1"""))
def m17_risk(spark, sf):
    from orbitcart.operators import executive as X
    chosen = X.filter_customers(_j(spark, sf).scored, risk_levels=["High", "Critical"], clv_range=(500000.0, 2500000.0))
    per = X.filter_master(retail(spark, sf).master, customers=chosen).groupBy("customer_state", "order_id").count()
    return per.groupBy("customer_state").agg(F.sum("count").alias("item_rows"), F.count(F.lit(1)).alias("orders"))


@query("M17_value_tier_slice", with_base(f"""{_CLVF}
SELECT customer_state, count(*) AS item_rows FROM master
WHERE customer_unique_id IN (SELECT customer_unique_id FROM cv WHERE clv_value_tier IN ('Gold (Top 20%)', 'Bronze')) GROUP BY 1"""))
def m17_tier(spark, sf):
    from orbitcart.operators import executive as X
    chosen = X.filter_customers(_j(spark, sf).clv_frame, tiers=["Gold (Top 20%)", "Bronze"])
    return X.filter_master(retail(spark, sf).master, customers=chosen).groupBy("customer_state").agg(F.count(F.lit(1)).alias("item_rows"))


@query("J19_clv_profile_by_customer", with_base(f"""
SELECT 'customer' AS match_type, CAST(customer_unique_id AS VARCHAR) AS match_key, 1 AS customers, {R('historical_clv', 4)} AS total_clv,
       {R('historical_clv', 4)} AS avg_clv FROM fs WHERE contains(CAST(customer_unique_id AS VARCHAR), '77')"""))
def j19_customer(spark, sf):
    return rounded(J.search_clv_profile(retail(spark, sf).feature_store, "77"), {"total_clv": 4, "avg_clv": 4})


@query("J19_clv_profile_by_segment", with_base(f"""
, s AS (SELECT unnest([rfm_segment, spending_tier]) AS seg, historical_clv FROM fs)
SELECT 'segment' AS match_type, seg AS match_key, count(*) AS customers, {R('sum(historical_clv)', 4)} AS total_clv,
       {R('avg(historical_clv)', 4)} AS avg_clv FROM s WHERE contains(lower(seg), 'gold') OR false GROUP BY seg"""))
def j19_segment(spark, sf):
    return rounded(J.search_clv_profile(retail(spark, sf).feature_store, "Gold"), {"total_clv": 4, "avg_clv": 4})


@query("J18_growth_candidates", with_base(f"""
, t AS (SELECT fs.*, {_FIXED} AS tier FROM fs),
g(priority, opportunity_group) AS (VALUES (0, 'Premium upsell: Gold with AOV > 200'),
  (1, 'Category expansion: single category, 1-2 orders'), (2, 'Tier upgrade: Gold within 20% of Platinum'),
  (3, 'Win-back: Platinum/Gold idle > 45 days'), (4, 'Second purchase: one order, recent')),
f AS (SELECT historical_clv, [tier = 'Gold' AND avg_order_value > 200,
        distinct_categories_count = 1 AND total_orders BETWEEN 1 AND 2, tier = 'Gold' AND historical_clv >= 2000,
        tier IN ('Platinum', 'Gold') AND recency_days > 45, total_orders = 1 AND recency_days <= 90] AS fl FROM t)
SELECT CAST(priority AS INTEGER) AS priority, opportunity_group, count(f.historical_clv) AS candidate_count,
       {R('coalesce(sum(f.historical_clv), 0.0)', 4)} AS total_clv
FROM g LEFT JOIN f ON f.fl[priority + 1] GROUP BY ALL"""))
def j18(spark, sf):
    return rounded(J.growth_candidates(retail(spark, sf).feature_store), {"total_clv": 4})


@query("J18_spend_movers", with_base(f"""
, e AS (SELECT epoch_us(max(order_purchase_timestamp)) AS e FROM master),
p AS (SELECT customer_unique_id, floor((e - epoch_us(order_purchase_timestamp)) / 15552000000000.0) AS period, price FROM master, e),
sp AS (SELECT customer_unique_id, coalesce({MSUM('CASE WHEN period = 0 THEN price END')}, 0.0) AS l,
              coalesce({MSUM('CASE WHEN period = 1 THEN price END')}, 0.0) AS b FROM p WHERE period IN (0, 1) GROUP BY 1),
t AS (SELECT fs.historical_clv, {_FIXED} AS tier, l, b FROM fs JOIN sp USING (customer_unique_id) WHERE b > 0)
SELECT 'Growing: Silver with spend up 30%' AS opportunity_group, count(*) AS candidate_count,
       {R('coalesce(sum(historical_clv), 0.0)', 4)} AS total_clv FROM t WHERE tier = 'Silver' AND l >= b * 1.30
UNION ALL SELECT 'Declining: spend down 25%', count(*), {R('coalesce(sum(historical_clv), 0.0)', 4)} FROM t WHERE l <= b * 0.75"""))
def j18_movers(spark, sf):
    """Over half-years, as customers of the test tables buy seldom."""
    r = retail(spark, sf)
    return rounded(J.spend_movers(r.feature_store, r.master, 180), {"total_clv": 4})


@query("I8_label_probability", with_base(f"""
SELECT customer_unique_id, {R('coalesce(churn_label * 0.75 + 0.10, 0.25)', 6)} AS churn_probability,
       CASE WHEN coalesce(churn_label, -1) = 1 THEN 'Critical' WHEN churn_label = 0 THEN 'Very Low' ELSE 'Low' END AS risk_level FROM fs"""))
def i8_label(spark, sf):
    s = I.with_risk(I.rule_probability(retail(spark, sf).feature_store, "label"))
    return rounded(s.select("customer_unique_id", "churn_probability", "risk_level"), {"churn_probability": 6})


@query("J19_clv_profile_search", with_base(f"""
SELECT 'segment' AS match_type, seg AS match_key, count(*) AS customers, {R('sum(historical_clv)', 4)} AS total_clv,
       {R('avg(historical_clv)', 6)} AS avg_clv
FROM (SELECT unnest([rfm_segment, spending_tier]) AS seg, historical_clv FROM fs)
WHERE contains(lower(seg), 'risk') GROUP BY seg"""))
def j19(spark, sf):
    return rounded(J.search_clv_profile(retail(spark, sf).feature_store, "Risk"), {"total_clv": 4, "avg_clv": 6})


@query("J4_clv_model_metrics")
def j4(spark, sf):
    return _j(spark, sf).clv_model[1]


@query("J6_clv_model_predictions")
def j6(spark, sf):
    model, _ = _j(spark, sf).clv_model
    return J.predict_clv(model, retail(spark, sf).feature_store).select("customer_unique_id", "predicted_clv")


@query("I16_model_attributions")
def i16(spark, sf):
    fs = retail(spark, sf).feature_store
    data = I.class_weights(I.prepare_labels(fs))
    model = I.churn_pipeline("logistic").fit(data)
    return I.linear_attributions(model, data)


@query("P11_retrain_and_promote")
def p11(spark, sf):
    j = _j(spark, sf)
    incumbent, _ = j.churn_model
    _, decision = I.retrain_and_promote(incumbent, retail(spark, sf).feature_store)
    return decision
