"""Registered queries: customer analytics (N)."""

from __future__ import annotations

from orbitcart.operators import customers as C
from orbitcart.operators import executive as X
from orbitcart.plans.catalog_dash import PRETTY, _coords_values
from orbitcart.plans.oracle import INITCAP, MSUM, R, with_base
from orbitcart.plans.pipeline import retail
from orbitcart.plans.registry import query, rounded

_MID = """
, b AS (SELECT epoch_us(min(order_purchase_timestamp)) AS lo, epoch_us(max(order_purchase_timestamp)) AS hi FROM master),
mid AS (SELECT make_timestamp(CAST(lo + floor((hi - lo) / 2) AS BIGINT)) AS mid FROM b),
m AS (SELECT master.*, order_purchase_timestamp >= mid.mid AS cur FROM master, mid)"""


def _kpi_rows(spec: dict[str, tuple[str, str, str]], src: str) -> str:
    parts = [f"SELECT '{k}' AS kpi, CAST({t} AS DOUBLE) AS total, CAST({c} AS DOUBLE) AS current, "
             f"CAST({p} AS DOUBLE) AS previous FROM {src}" for k, (t, c, p) in spec.items()]
    return "\nUNION ALL ".join(parts)


def _kpi_final(long_cte: str) -> str:
    return f"""
SELECT kpi, {R('total', 6)} AS total, {R('current', 6)} AS current, {R('previous', 6)} AS previous,
       {R("CASE WHEN previous = 0 OR previous IS NULL THEN 0.0 ELSE abs((current - previous) / abs(previous) * 100.0) END", 4)} AS change_pct,
       CASE WHEN previous = 0 OR previous IS NULL THEN true ELSE current >= previous END AS is_positive
FROM {long_cte}"""


def _n1_sql() -> str:
    def scoped(s: str, flt: str) -> str:
        w = f" FILTER (WHERE {flt})" if flt else ""
        return (f"count(*){w} AS cust_{s}, count(*) FILTER (WHERE {flt + ' AND ' if flt else ''}recency_days <= 90)"
                f" AS active_{s}, coalesce(sum(is_repeat_customer){w}, 0) AS ret_{s},"
                f" coalesce(avg(historical_clv){w}, 0.0) AS clv_{s},"
                f" coalesce(least(100.0, greatest(0.0, 100.0 - avg(churn_label){w} * 100.0)), 0.0) AS retention_{s},"
                f" coalesce(avg(total_orders){w}, 0.0) AS freq_{s}")
    spec = {}
    for name, key in [("total_customers", "cust"), ("active_customers", "active"), ("returning_customers", "ret")]:
        spec[name] = tuple(f"{key}_{s}" for s in "tcp")
    spec["new_customers"] = tuple(f"cust_{s} - ret_{s}" for s in "tcp")
    spec["repeat_purchase_rate"] = tuple(f"ret_{s} / greatest(cust_{s}, 1) * 100.0" for s in "tcp")
    spec["avg_clv"] = tuple(f"clv_{s}" for s in "tcp")
    spec["csat"] = tuple(f"coalesce(csat_{s}, 0.0)" for s in "tcp")
    spec["retention_rate"] = tuple(f"retention_{s}" for s in "tcp")
    spec["avg_frequency"] = tuple(f"freq_{s}" for s in "tcp")
    spec["avg_basket_size"] = tuple(f"coalesce(basket_{s}, 0.0)" for s in "tcp")
    return with_base(f"""{_MID},
po AS (SELECT customer_unique_id, order_id, cur, {MSUM('price')} AS rev, sum(avg_review_score) AS rs,
              count(avg_review_score) AS rn FROM m GROUP BY ALL),
mem AS (SELECT customer_unique_id, max(CAST(cur AS INTEGER)) AS in_c, max(CAST(NOT cur AS INTEGER)) AS in_p
        FROM po GROUP BY 1),
f AS (SELECT fs.*, coalesce(in_c, 0) AS in_c, coalesce(in_p, 0) AS in_p FROM fs LEFT JOIN mem USING (customer_unique_id)),
a AS (SELECT {scoped('t', '')}, {scoped('c', 'in_c = 1')}, {scoped('p', 'in_p = 1')} FROM f),
b2 AS (SELECT sum(rs) / sum(rn) AS csat_t, sum(rs) FILTER (WHERE cur) / sum(rn) FILTER (WHERE cur) AS csat_c,
              sum(rs) FILTER (WHERE NOT cur) / sum(rn) FILTER (WHERE NOT cur) AS csat_p,
              avg(rev) AS basket_t, avg(rev) FILTER (WHERE cur) AS basket_c, avg(rev) FILTER (WHERE NOT cur) AS basket_p
       FROM po),
w AS (SELECT * FROM a, b2),
long AS ({_kpi_rows(spec, 'w')})
{_kpi_final('long')}""")


@query("N1_customer_kpis", _n1_sql())
def n1_customer_kpis(spark, sf):
    r = retail(spark, sf)
    return rounded(C.customer_kpis(r.master, r.feature_store, r.order_facts),
                   {"total": 6, "current": 6, "previous": 6, "change_pct": 4})


@query("N2_state_distribution", with_base(f"""
, per AS (SELECT customer_state AS state, customer_unique_id, {MSUM('price')} AS rev FROM master
          WHERE customer_state IS NOT NULL GROUP BY ALL),
agg AS (SELECT state, count(*) AS customer_count, {MSUM('rev')} AS total_revenue FROM per GROUP BY state),
dim(state_code, state_name, lat, lon) AS (VALUES {_coords_values()})
SELECT agg.state, agg.customer_count, agg.total_revenue, coalesce(dim.state_name, upper(agg.state)) AS state_name,
       coalesce(CAST(dim.lat AS DOUBLE), {X.DEFAULT_LAT}) AS lat, coalesce(CAST(dim.lon AS DOUBLE), {X.DEFAULT_LON}) AS lon
FROM agg LEFT JOIN dim ON upper(agg.state) = dim.state_code"""))
def n2_state_distribution(spark, sf):
    r = retail(spark, sf)
    return C.state_distribution(r.master, r.order_facts)


@query("N3_top_cities", with_base(f"""
, per AS (SELECT customer_city, customer_unique_id, {MSUM('price')} AS rev FROM master
          WHERE customer_city IS NOT NULL GROUP BY ALL)
SELECT {INITCAP('customer_city')} AS city, customer_count, total_revenue FROM (
  SELECT customer_city, count(*) AS customer_count, {MSUM('rev')} AS total_revenue FROM per GROUP BY customer_city
  ORDER BY customer_count DESC, customer_city LIMIT 15)"""))
def n3_top_cities(spark, sf):
    return C.city_distribution(retail(spark, sf).master, 15)


@query("N4_geographic_treemap_rollup", with_base(f"""
, per AS (SELECT customer_state, customer_city, customer_unique_id, {MSUM('price')} AS rev FROM master
          WHERE customer_state IS NOT NULL GROUP BY ALL)
SELECT customer_state AS state, {INITCAP('customer_city')} AS city, {MSUM('rev')} AS total_revenue,
       count(DISTINCT customer_unique_id) AS customer_count
FROM per GROUP BY ROLLUP (customer_state, customer_city)"""))
def n4_treemap(spark, sf):
    return C.geographic_treemap(retail(spark, sf).master, with_totals=True)


def _bucket_sql(labels: list[str], name: str, case: str, src: str) -> str:
    vals = ", ".join(f"({i}, '{lab}')" for i, lab in enumerate(labels))
    return with_base(f"""
, spine(bucket_order, {name}) AS (VALUES {vals}),
c AS (SELECT {case} AS {name}, count(*) AS n FROM {src} GROUP BY 1)
SELECT CAST(spine.bucket_order AS INTEGER) AS bucket_order, spine.{name}, CAST(coalesce(c.n, 0) AS BIGINT) AS customer_count
FROM spine LEFT JOIN c USING ({name})""")


query("N5_frequency_distribution", _bucket_sql(C.FREQUENCY_BUCKETS, "frequency_bucket", """CASE
  WHEN total_orders = 1 THEN '1 Order' WHEN total_orders = 2 THEN '2 Orders'
  WHEN total_orders BETWEEN 3 AND 5 THEN '3-5 Orders' WHEN total_orders >= 6 THEN '6+ Orders' END""", "fs"))(
    lambda spark, sf: C.frequency_distribution(retail(spark, sf).feature_store))

query("N6_diversity_distribution", _bucket_sql(C.DIVERSITY_BUCKETS, "diversity_level", """CASE
  WHEN n = 1 THEN '1 Category' WHEN n BETWEEN 2 AND 3 THEN '2-3 Categories' WHEN n >= 4 THEN '4+ Categories' END""",
    "(SELECT customer_unique_id, count(DISTINCT product_category_name_english) AS n FROM master "
    "WHERE product_category_name_english IS NOT NULL GROUP BY 1)"))(
    lambda spark, sf: C.diversity_distribution(retail(spark, sf).master))

query("N8_spend_tiers", _bucket_sql(C.SPEND_BUCKETS, "revenue_tier", """CASE
  WHEN total_spending < 100 THEN 'Low (<$100)' WHEN total_spending < 300 THEN 'Medium ($100-$300)'
  WHEN total_spending < 1000 THEN 'High ($300-$1K)' WHEN total_spending >= 1000 THEN 'VIP ($1K+)' END""", "fs"))(
    lambda spark, sf: C.spend_tiers(retail(spark, sf).feature_store))

query("N9_loyalty_tiers", _bucket_sql(C.LOYALTY_TIERS, "loyalty_tier", """CASE
  WHEN total_spending >= 1000 AND total_orders >= 3 THEN 'VIP Customers'
  WHEN total_spending >= 500 AND total_orders >= 2 THEN 'High-Value Customers'
  WHEN total_orders >= 2 THEN 'Loyal Customers'
  WHEN total_orders = 1 AND recency_days <= 180 THEN 'Occasional Customers'
  WHEN total_orders = 1 AND recency_days > 180 THEN 'One-Time Buyers' END""", "fs"))(
    lambda spark, sf: C.loyalty_tiers(retail(spark, sf).feature_store))

query("N10_loyalty_histogram", _bucket_sql(C.LOYALTY_BANDS, "score_range", """CASE
  WHEN loyalty_score >= 0 AND loyalty_score <= 20 THEN '0-20 (Bronze)'
  WHEN loyalty_score > 20 AND loyalty_score <= 40 THEN '21-40 (Silver)'
  WHEN loyalty_score > 40 AND loyalty_score <= 60 THEN '41-60 (Gold)'
  WHEN loyalty_score > 60 AND loyalty_score <= 80 THEN '61-80 (Platinum)'
  WHEN loyalty_score > 80 AND loyalty_score <= 100 THEN '81-100 (Diamond)' END""", "fs"))(
    lambda spark, sf: C.loyalty_histogram(retail(spark, sf).feature_store))

query("N15_recency_distribution", _bucket_sql(C.RECENCY_BUCKETS, "recency_bucket", """CASE
  WHEN recency_days <= 30 THEN '0-30 Days' WHEN recency_days <= 60 THEN '31-60 Days'
  WHEN recency_days <= 90 THEN '61-90 Days' WHEN recency_days <= 180 THEN '91-180 Days'
  WHEN recency_days > 180 THEN '180+ Days' END""", "fs"))(
    lambda spark, sf: C.recency_distribution(retail(spark, sf).feature_store))


@query("N7_payment_methods", with_base(f"""
SELECT {PRETTY('preferred_payment_type')} AS payment_method, count(price) AS transaction_count,
       {MSUM('price')} AS total_revenue
FROM master WHERE preferred_payment_type IS NOT NULL GROUP BY preferred_payment_type"""))
def n7_payment_methods(spark, sf):
    return X.payment_distribution(retail(spark, sf).master)


@query("N11_loyalty_trend", with_base("""
, per AS (SELECT date_trunc('month', order_purchase_timestamp) AS month_start, customer_unique_id,
                 count(DISTINCT order_id) AS o FROM master WHERE order_purchase_timestamp IS NOT NULL GROUP BY ALL)
SELECT month_start, count(*) AS active_buyers, count(*) FILTER (WHERE o >= 2) AS repeat_buyers,
       strftime(month_start, '%b %Y') AS month
FROM per GROUP BY month_start"""))
def n11_loyalty_trend(spark, sf):
    r = retail(spark, sf)
    return C.loyalty_trend(r.master, r.order_facts)


_SPEND = f"""
, sp AS (SELECT customer_unique_id, {MSUM('price')} AS total_spending, count(DISTINCT order_id) AS total_orders,
                min(customer_state) AS state FROM master GROUP BY 1),
rk AS (SELECT *, row_number() OVER (ORDER BY total_spending DESC, customer_unique_id) AS rank,
              sum(total_spending) OVER (ORDER BY total_spending DESC, customer_unique_id
                                        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_spend,
              count(*) OVER () AS n, sum(total_spending) OVER () AS total FROM sp)"""


@query("N12_top_customers", with_base(f"""{_SPEND}
SELECT customer_unique_id, total_spending, total_orders, state,
       {R('total_spending / greatest(total_orders, 1)', 6)} AS avg_order_value
FROM sp ORDER BY total_spending DESC, customer_unique_id LIMIT 20"""))
def n12_top_customers(spark, sf):
    r = retail(spark, sf)
    return rounded(C.top_customers(r.master, 20, r.order_facts), {"avg_order_value": 6})


@query("N13_pareto_curve", with_base(f"""{_SPEND}
SELECT rank, {R('rank / n * 100.0', 6)} AS customer_percentile, {R('cum_spend / total * 100.0', 6)} AS cumulative_revenue_pct
FROM rk WHERE (rank - 1) % greatest(floor(n / 50), 1) = 0 OR rank = n"""))
def n13_pareto(spark, sf):
    r = retail(spark, sf)
    return rounded(C.pareto_curve(r.master, 50, r.order_facts),
                   {"customer_percentile": 6, "cumulative_revenue_pct": 6})


@query("N13_pareto_top20_share", with_base(f"""{_SPEND}
SELECT {R('sum(total_spending) / max(total) * 100.0', 1)} AS top_share_pct, count(*) AS top_customers
FROM rk WHERE rank <= greatest(floor(n * CAST(0.2 AS DOUBLE)), 1)"""))
def n13_top_share(spark, sf):
    r = retail(spark, sf)
    return C.pareto_top_share(r.master, 0.20, r.order_facts)


def _n14_sql() -> str:
    vals = ", ".join(f"({i}, '{lab}')" for i, lab in enumerate(C.REVENUE_BANDS))
    return with_base(f"""{_SPEND},
p AS (SELECT greatest(1, floor(n * CAST(0.01 AS DOUBLE))) AS p1 FROM (SELECT max(n) AS n FROM rk)),
p2 AS (SELECT p1, greatest(p1 + 1, floor(n * CAST(0.05 AS DOUBLE))) AS p5, n FROM p, (SELECT max(n) AS n FROM rk)),
p3 AS (SELECT p1, p5, greatest(p5 + 1, floor(n * CAST(0.2 AS DOUBLE))) AS p20, n FROM p2),
p4 AS (SELECT p1, p5, p20, greatest(p20 + 1, floor(n * CAST(0.5 AS DOUBLE))) AS p50 FROM p3),
lab AS (SELECT CASE WHEN rank <= p1 THEN 'Top 1% VIPs' WHEN rank <= p5 THEN 'Top 5% High-Value'
                    WHEN rank <= p20 THEN 'Top 20% Core Buyers' WHEN rank <= p50 THEN 'Next 30% Moderate Buyers'
                    ELSE 'Bottom 50% Long Tail' END AS segment, total_spending, total FROM rk, p4),
agg AS (SELECT segment, count(*) AS customer_count, {MSUM('total_spending')} AS total_revenue FROM lab GROUP BY 1),
spine(band_order, segment) AS (VALUES {vals}),
tot AS (SELECT max(total) AS total FROM rk)
SELECT segment, CAST(spine.band_order AS INTEGER) AS band_order, coalesce(customer_count, 0) AS customer_count,
       coalesce(total_revenue, 0.0) AS total_revenue,
       {R('coalesce(total_revenue, 0.0) / greatest(tot.total, 1.0) * 100.0', 6)} AS revenue_share_pct
FROM spine LEFT JOIN agg USING (segment), tot""")


@query("N14_revenue_bands", _n14_sql())
def n14_revenue_bands(spark, sf):
    r = retail(spark, sf)
    return rounded(C.revenue_bands(r.master, r.order_facts), {"revenue_share_pct": 6})


@query("N16_recently_active", with_base(f"""
, mx AS (SELECT max(order_purchase_timestamp) AS mx FROM master),
agg AS (SELECT customer_unique_id, max(order_purchase_timestamp) AS last_purchase, {MSUM('price')} AS total_spending,
               count(DISTINCT order_id) AS total_orders FROM master GROUP BY 1)
SELECT customer_unique_id, strftime(last_purchase, '%Y-%m-%d') AS last_purchase_date,
       CAST(floor((epoch_us(mx.mx) - epoch_us(last_purchase)) / 86400000000) AS BIGINT) AS recency_days,
       total_spending, total_orders, 'Active' AS status
FROM agg, mx ORDER BY recency_days, customer_unique_id LIMIT 50"""))
def n16_recently_active(spark, sf):
    r = retail(spark, sf)
    return C.recently_active(r.master, 50, r.order_facts)


@query("N17_dormant_customers", with_base(f"""
SELECT customer_unique_id, {R('recency_days', 4)} AS recency_days, total_spending, total_orders,
       'Dormant (>90d)' AS status
FROM fs WHERE recency_days > 90 ORDER BY recency_days DESC, customer_unique_id LIMIT 50"""))
def n17_dormant(spark, sf):
    return rounded(C.dormant_customers(retail(spark, sf).feature_store, 50), {"recency_days": 4})


_PROFILE_Q = "nation_1-"


@query("N18_customer_profile_city", with_base(f"""
SELECT 'city' AS profile_type, customer_city AS profile_key, count(*) AS customers,
       {MSUM('total_spending')} AS total_spending, {R('avg(total_orders)', 6)} AS avg_orders,
       {R("avg(historical_clv)", 6)} AS avg_clv, customer_city AS city
FROM fs WHERE contains(lower(customer_city), '{_PROFILE_Q}') GROUP BY customer_city"""))
def n18_profile(spark, sf):
    r = retail(spark, sf)
    return rounded(C.customer_profile(r.feature_store, r.master, _PROFILE_Q), {"avg_orders": 6, "avg_clv": 6})


@query("N19_customer_insights", with_base(f"""{_SPEND},
st AS (SELECT state, count(*) AS customer_count FROM (SELECT DISTINCT customer_state AS state, customer_unique_id
       FROM master WHERE customer_state IS NOT NULL) GROUP BY state),
st2 AS (SELECT state, customer_count, row_number() OVER (ORDER BY customer_count DESC, state) AS k FROM st),
seg AS (SELECT rfm_segment, count(*) AS c FROM fs GROUP BY 1 ORDER BY c DESC, rfm_segment LIMIT 1),
po AS (SELECT order_id, {MSUM('price')} AS rev FROM master GROUP BY 1)
SELECT insight, value, {R('metric', 6)} AS metric FROM (
  SELECT CASE WHEN k = 1 THEN 'Top State' ELSE 'Runner-up State' END AS insight, state AS value,
         CAST(customer_count AS DOUBLE) AS metric FROM st2 WHERE k <= 2
  UNION ALL SELECT 'Largest Segment', {PRETTY('rfm_segment')}, CAST(c AS DOUBLE) FROM seg
  UNION ALL SELECT 'Average Basket', NULL, avg(rev) FROM po
  UNION ALL SELECT 'Top 20% Revenue Share', NULL, {R('sum(total_spending) / max(total) * 100.0', 1)}
            FROM rk WHERE rank <= greatest(floor(n * CAST(0.2 AS DOUBLE)), 1))"""))
def n19_insights(spark, sf):
    r = retail(spark, sf)
    return rounded(C.customer_insights(r.master, r.feature_store, r.order_facts), {"metric": 6})
