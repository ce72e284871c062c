"""Registered queries: executive analytics and slicing (M)."""

from __future__ import annotations

from pyspark.sql import functions as F

from orbitcart.operators import executive as X
from orbitcart.operators import search as S
from orbitcart.plans.jobs import jobs
from orbitcart.plans.oracle import INITCAP, MSUM, R, with_base
from orbitcart.plans.pipeline import retail
from orbitcart.plans.registry import query, rounded


def PRETTY(expr: str) -> str:
    return INITCAP(f"replace(CAST({expr} AS VARCHAR), '_', ' ')")


def _m(spark, sf):
    return retail(spark, sf).master


def _o(spark, sf):
    return retail(spark, sf).order_facts


# ---------------------------------------------------------------- M1-M8

def _trend_sql(unit: str, label: str) -> str:
    return with_base(f"""
, per AS (SELECT date_trunc('{unit}', order_purchase_timestamp) AS period_start, order_id, {MSUM('price')} AS rev
          FROM master WHERE order_purchase_timestamp IS NOT NULL GROUP BY ALL)
SELECT period_start, {MSUM('rev')} AS revenue, count(*) AS order_count, {label} AS period
FROM per GROUP BY period_start""")


query("M1_revenue_trend_monthly", _trend_sql("month", "strftime(period_start, '%b %Y')"))(
    lambda spark, sf: X.revenue_trend(_m(spark, sf), "monthly", _o(spark, sf)))
query("M1_revenue_trend_weekly", _trend_sql(
    "week", "strftime(period_start, '%Y-%m-%d') || '/' || strftime(period_start + INTERVAL 6 DAY, '%Y-%m-%d')"))(
    lambda spark, sf: X.revenue_trend(_m(spark, sf), "weekly", _o(spark, sf)))
query("M1_revenue_trend_daily", _trend_sql("day", "strftime(period_start, '%Y-%m-%d')"))(
    lambda spark, sf: X.revenue_trend(_m(spark, sf), "daily", _o(spark, sf)))


@query("M2_customer_growth", with_base("""
, cm AS (SELECT DISTINCT customer_unique_id, date_trunc('month', order_purchase_timestamp) AS month_start
         FROM master WHERE order_purchase_timestamp IS NOT NULL),
fm AS (SELECT customer_unique_id, min(month_start) AS first_month FROM cm GROUP BY 1)
SELECT month_start, count(*) AS total_customers, count(*) FILTER (WHERE first_month = month_start) AS new_customers,
       strftime(month_start, '%b %Y') AS month,
       greatest(count(*) - count(*) FILTER (WHERE first_month = month_start), 0) AS returning_customers
FROM cm JOIN fm USING (customer_unique_id) GROUP BY month_start"""))
def m2_customer_growth(spark, sf):
    return X.customer_growth(_m(spark, sf), _o(spark, sf))


@query("M3_revenue_by_category", with_base(f"""
, per AS (SELECT product_category_name_english AS c, order_id, {MSUM('price')} AS rev FROM master
          WHERE product_category_name_english IS NOT NULL GROUP BY ALL)
SELECT {PRETTY('c')} AS category, {MSUM('rev')} AS revenue, count(*) AS order_count FROM per GROUP BY c"""))
def m3_revenue_by_category(spark, sf):
    return X.revenue_by_category(_m(spark, sf))


def _coords_values() -> str:
    return ", ".join(f"('{k}', '{n}', {lat}, {lon})" for k, (n, lat, lon) in X.STATE_COORDS.items())


@query("M4_revenue_by_state", with_base(f"""
, per AS (SELECT customer_state AS state, customer_unique_id, {MSUM('price')} AS rev FROM master
          WHERE customer_state IS NOT NULL GROUP BY ALL),
agg AS (SELECT state, {MSUM('rev')} AS revenue, count(*) AS customer_count FROM per GROUP BY state),
dim(state_code, state_name, lat, lon) AS (VALUES {_coords_values()})
SELECT agg.state, agg.revenue, agg.customer_count, coalesce(dim.state_name, upper(agg.state)) AS state_name,
       coalesce(CAST(dim.lat AS DOUBLE), {X.DEFAULT_LAT}) AS lat, coalesce(CAST(dim.lon AS DOUBLE), {X.DEFAULT_LON}) AS lon
FROM agg LEFT JOIN dim ON upper(agg.state) = dim.state_code"""))
def m4_revenue_by_state(spark, sf):
    return X.revenue_by_state(_m(spark, sf), _o(spark, sf))


@query("M5_payment_distribution", with_base(f"""
SELECT {PRETTY('preferred_payment_type')} AS payment_method, count(price) AS transaction_count,
       {MSUM('price')} AS total_revenue
FROM master WHERE preferred_payment_type IS NOT NULL GROUP BY preferred_payment_type"""))
def m5_payment_distribution(spark, sf):
    return X.payment_distribution(_m(spark, sf))


@query("M6_order_status_distribution", with_base(f"""
SELECT {PRETTY('order_status')} AS order_status, count(*) AS row_count FROM master
WHERE order_status IS NOT NULL GROUP BY master.order_status"""))
def m6_order_status(spark, sf):
    return X.order_status_distribution(_m(spark, sf))


@query("M7_top_products", with_base(f"""
SELECT product_id, {MSUM('price')} AS revenue, count(*) AS units_sold,
       {PRETTY("coalesce(min(product_category_name_english), 'General')")} AS category
FROM master GROUP BY product_id ORDER BY revenue DESC, product_id LIMIT 10"""))
def m7_top_products(spark, sf):
    return X.top_products(_m(spark, sf), 10)


@query("M8_ratings_histogram", with_base("""
, c AS (SELECT CAST(round_even(avg_review_score, 0) AS INTEGER) AS star, count(*) AS n FROM master
        WHERE avg_review_score IS NOT NULL GROUP BY 1)
SELECT CAST(s.star AS INTEGER) AS star,
       CAST(s.star AS VARCHAR) || ' Star' || CASE WHEN s.star > 1 THEN 's' ELSE '' END AS star_rating,
       CAST(coalesce(c.n, 0) AS BIGINT) AS row_count
FROM range(1, 6) s(star) LEFT JOIN c ON c.star = s.star"""))
def m8_ratings_histogram(spark, sf):
    return X.ratings_histogram(_m(spark, sf))


# ---------------------------------------------------------------- M9-M10

@query("M9_business_insights", with_base(f"""
, cat AS (SELECT {PRETTY('c')} AS value, {MSUM('rev')} AS metric FROM (
            SELECT product_category_name_english AS c, order_id, {MSUM('price')} AS rev FROM master
            WHERE product_category_name_english IS NOT NULL GROUP BY ALL) GROUP BY c),
st AS (SELECT state AS value, {MSUM('rev')} AS metric FROM (
            SELECT customer_state AS state, customer_unique_id, {MSUM('price')} AS rev FROM master
            WHERE customer_state IS NOT NULL GROUP BY ALL) GROUP BY state),
seg AS (SELECT {PRETTY('rfm_segment')} AS value, CAST(count(*) AS DOUBLE) AS metric, rfm_segment FROM fs GROUP BY rfm_segment),
payi AS (SELECT {PRETTY('preferred_payment_type')} AS value, {MSUM('price')} AS metric FROM master
        WHERE preferred_payment_type IS NOT NULL GROUP BY preferred_payment_type),
sel AS (SELECT CAST(seller_id AS VARCHAR) AS value, {MSUM('price')} AS metric, seller_id FROM master GROUP BY seller_id),
low AS (SELECT {PRETTY('product_category_name_english')} AS value, avg(avg_review_score) AS metric,
               product_category_name_english AS c
        FROM master WHERE product_category_name_english IS NOT NULL GROUP BY c)
SELECT insight, value, {R('metric', 6)} AS metric FROM (
  (SELECT 'Highest Revenue Category' AS insight, value, metric FROM cat ORDER BY metric DESC, value LIMIT 1)
  UNION ALL (SELECT 'Best Performing State', value, metric FROM st ORDER BY metric DESC, value LIMIT 1)
  UNION ALL (SELECT 'Largest Segment', value, metric FROM seg ORDER BY metric DESC, rfm_segment LIMIT 1)
  UNION ALL (SELECT 'Most Popular Payment', value, metric FROM payi ORDER BY metric DESC, value LIMIT 1)
  UNION ALL (SELECT 'Top Performing Seller', value, metric FROM sel ORDER BY metric DESC, seller_id LIMIT 1)
  UNION ALL (SELECT 'Lowest Rated Category', value, metric FROM low ORDER BY metric, c LIMIT 1))"""))
def m9_insights(spark, sf):
    r = retail(spark, sf)
    return rounded(X.business_insights(r.master, r.feature_store), {"metric": 6})


@query("M10_executive_summary", with_base(f"""
, t AS (SELECT {MSUM('price')} AS total_revenue,
               {R("sum(CASE WHEN fs.is_repeat_customer = 1 THEN price END)", 2)} AS repeat_revenue
        FROM master LEFT JOIN fs USING (customer_unique_id)),
cat AS (SELECT {PRETTY('c')} AS category, {MSUM('rev')} AS revenue FROM (
            SELECT product_category_name_english AS c, order_id, {MSUM('price')} AS rev FROM master
            WHERE product_category_name_english IS NOT NULL GROUP BY ALL) GROUP BY c),
st AS (SELECT upper(state) AS state_name, state, {MSUM('rev')} AS revenue FROM (
            SELECT customer_state AS state, customer_unique_id, {MSUM('price')} AS rev FROM master
            WHERE customer_state IS NOT NULL GROUP BY ALL) GROUP BY state)
, x AS (SELECT total_revenue,
       {R("CASE WHEN total_revenue > 0 THEN repeat_revenue * 100.0 / total_revenue ELSE 0.0 END", 1)} AS repeat_revenue_pct,
       (SELECT category FROM cat ORDER BY revenue DESC, category LIMIT 1) AS top_category,
       (SELECT state_name FROM st ORDER BY revenue DESC, state LIMIT 1) AS top_state
FROM t)
SELECT *, format('📌 **Executive Overview**: Enterprise Gross Revenue reached **${{:,.2f}}** with robust growth. ', total_revenue)
       || printf('Returning customer transactions accounted for **%.1f%%** of total sales volume. ', repeat_revenue_pct)
       || printf('**%s** remains the highest-performing product sector, while **%s** leads all geographic territories in orders and revenue.',
                 top_category, top_state) AS summary
FROM x"""))
def m10_summary(spark, sf):
    r = retail(spark, sf)
    return X.executive_summary(r.items, r.feature_store, r.item_order_facts)


# ---------------------------------------------------------------- M11-M14 KPIs

_KPI_SQL = with_base(f"""
, b AS (SELECT epoch_us(min(order_purchase_timestamp)) AS lo, epoch_us(max(order_purchase_timestamp)) AS hi FROM master),
mid AS (SELECT make_timestamp(CAST(lo + floor((hi - lo) / 2) AS BIGINT)) AS mid FROM b),
m AS (SELECT master.*, order_purchase_timestamp >= mid.mid AS cur FROM master, mid),
po AS (SELECT customer_unique_id, order_id, cur, {MSUM('price')} AS rev, sum(avg_review_score) AS rs,
              count(avg_review_score) AS rn FROM m GROUP BY ALL),
pc AS (SELECT customer_unique_id, {MSUM('rev')} AS rev, {R('sum(CASE WHEN cur THEN rev END)', 2)} AS rev_c,
              {R('sum(CASE WHEN NOT cur THEN rev END)', 2)} AS rev_p, count(*) AS o,
              count(*) FILTER (WHERE cur) AS o_c, count(*) FILTER (WHERE NOT cur) AS o_p,
              sum(rs) AS rs, sum(CASE WHEN cur THEN rs END) AS rs_c, sum(CASE WHEN NOT cur THEN rs END) AS rs_p,
              sum(rn) AS rn, sum(CASE WHEN cur THEN rn END) AS rn_c, sum(CASE WHEN NOT cur THEN rn END) AS rn_p
       FROM po GROUP BY customer_unique_id),
t AS (SELECT {MSUM('rev')} AS rev, {MSUM('rev_c')} AS rev_c, {MSUM('rev_p')} AS rev_p,
             sum(o) AS o, sum(o_c) AS o_c, sum(o_p) AS o_p, count(*) AS cu,
             count(*) FILTER (WHERE o_c > 0) AS cu_c, count(*) FILTER (WHERE o_p > 0) AS cu_p,
             sum(rs) / sum(rn) AS ra, sum(rs_c) / sum(rn_c) AS ra_c, sum(rs_p) / sum(rn_p) AS ra_p FROM pc),
ret AS (SELECT least(100.0, greatest(0.0, 100.0 - avg(churn_label) * 100.0)) AS r FROM fs),
mo AS (SELECT date_trunc('month', order_purchase_timestamp) AS ms, {MSUM('price')} AS revenue FROM master
       WHERE order_purchase_timestamp IS NOT NULL GROUP BY 1),
mk AS (SELECT revenue, row_number() OVER (ORDER BY ms DESC) AS k FROM mo),
gp AS (SELECT max(CASE WHEN k = 1 THEN revenue END) AS m1, max(CASE WHEN k = 2 THEN revenue END) AS m2,
              max(CASE WHEN k = 3 THEN revenue END) AS m3, count(*) AS months FROM mk WHERE k <= 3),
g AS (SELECT CASE WHEN months >= 2 THEN (m1 - m2) / greatest(m2, 1.0) * 100.0 END AS gc,
             CASE WHEN months >= 3 THEN (m2 - m3) / greatest(m3, 1.0) * 100.0 END AS gpv FROM gp),
w AS (SELECT t.*, ret.r, g.gc, g.gpv FROM t, ret, g),
long AS (
  SELECT 'total_revenue' AS kpi, rev AS total, coalesce(rev_c, 0.0) AS current, coalesce(rev_p, 0.0) AS previous FROM w
  UNION ALL SELECT 'total_orders', CAST(o AS DOUBLE), CAST(o_c AS DOUBLE), CAST(o_p AS DOUBLE) FROM w
  UNION ALL SELECT 'total_customers', CAST(cu AS DOUBLE), CAST(cu_c AS DOUBLE), CAST(cu_p AS DOUBLE) FROM w
  UNION ALL SELECT 'avg_order_value', rev / greatest(o, 1), coalesce(rev_c, 0.0) / greatest(o_c, 1),
                   coalesce(rev_p, 0.0) / greatest(o_p, 1) FROM w
  UNION ALL SELECT 'avg_rating', coalesce(ra, 0.0), coalesce(ra_c, 0.0), coalesce(ra_p, 0.0) FROM w
  UNION ALL SELECT 'retention_rate', r, r, r FROM w
  UNION ALL SELECT 'monthly_growth', gc, gc, gpv FROM w
  UNION ALL SELECT 'health_score',
    {R("least(100.0, greatest(0.0, r)) * 0.35 + least(100.0, greatest(0.0, coalesce(ra, 0.0) / 5.0 * 100.0)) * 0.35 + least(100.0, greatest(0.0, gc + 50.0)) * 0.30", 1)},
    {R("least(100.0, greatest(0.0, r)) * 0.35 + least(100.0, greatest(0.0, coalesce(ra_c, 0.0) / 5.0 * 100.0)) * 0.35 + least(100.0, greatest(0.0, gc + 50.0)) * 0.30", 1)},
    {R("least(100.0, greatest(0.0, r)) * 0.35 + least(100.0, greatest(0.0, coalesce(ra_p, 0.0) / 5.0 * 100.0)) * 0.35 + least(100.0, greatest(0.0, gpv + 50.0)) * 0.30", 1)}
  FROM w)
SELECT kpi, {R('total', 6)} AS total, {R('current', 6)} AS current, {R('previous', 6)} AS previous,
       {R("CASE WHEN previous = 0 OR previous IS NULL THEN 0.0 ELSE abs((current - previous) / abs(previous) * 100.0) END", 4)} AS change_pct,
       CASE WHEN previous = 0 OR previous IS NULL THEN true ELSE current >= previous END AS is_positive
FROM long""")


@query("M11_executive_kpis", _KPI_SQL)
def m11_kpis(spark, sf):
    r = retail(spark, sf)
    k = X.executive_kpis(r.master, r.feature_store, r.order_facts)
    return rounded(k, {"total": 6, "current": 6, "previous": 6, "change_pct": 4})


@query("M12_period_split", with_base("""
, b AS (SELECT epoch_us(min(order_purchase_timestamp)) AS lo, epoch_us(max(order_purchase_timestamp)) AS hi FROM master),
mid AS (SELECT make_timestamp(CAST(lo + floor((hi - lo) / 2) AS BIGINT)) AS mid FROM b)
SELECT order_purchase_timestamp >= mid.mid AS is_current, count(*) AS item_rows, count(DISTINCT order_id) AS orders
FROM master, mid GROUP BY 1"""))
def m12_period_split(spark, sf):
    m = X.with_period_flag(_m(spark, sf))
    per = m.groupBy("is_current", "order_id").count()
    return per.groupBy("is_current").agg(F.sum("count").alias("item_rows"), F.count(F.lit(1)).alias("orders"))


@query("M13_monthly_growth", with_base(f"""
, mo AS (SELECT date_trunc('month', order_purchase_timestamp) AS ms, {MSUM('price')} AS revenue FROM master
         WHERE order_purchase_timestamp IS NOT NULL GROUP BY 1),
mk AS (SELECT revenue, row_number() OVER (ORDER BY ms DESC) AS k FROM mo),
gp AS (SELECT max(CASE WHEN k = 1 THEN revenue END) AS m1, max(CASE WHEN k = 2 THEN revenue END) AS m2,
              max(CASE WHEN k = 3 THEN revenue END) AS m3, count(*) AS months FROM mk WHERE k <= 3)
SELECT {R("CASE WHEN months >= 2 THEN (m1 - m2) / greatest(m2, 1.0) * 100.0 END", 6)} AS growth_current,
       {R("CASE WHEN months >= 3 THEN (m2 - m3) / greatest(m3, 1.0) * 100.0 END", 6)} AS growth_previous
FROM gp"""))
def m13_monthly_growth(spark, sf):
    return rounded(X.monthly_growth(_m(spark, sf), _o(spark, sf)), {"growth_current": 6, "growth_previous": 6})


# ---------------------------------------------------------------- M15-M18

_SEARCH_Q = "77"


def _search_sql(q: str, kinds: tuple[str, ...] | None = None) -> str:
    columns = {"customer": "customer_unique_id", "order": "order_id", "seller": "seller_id", "product": "product_id",
               "category": "product_category_name_english"}
    parts = " UNION ALL ".join(
        f"SELECT {i} AS priority, '{kind}' AS entity_type, CAST({c} AS VARCHAR) AS entity_id, count(DISTINCT order_id) AS orders, count(*) AS items, "
        f"{MSUM('price')} AS revenue, min(order_status) AS order_status, min(order_purchase_timestamp) AS ts, min(seller_state) AS seller_state, "
        f"min(product_category_name_english) AS cat FROM master WHERE {c} IS NOT NULL GROUP BY {c}" for i, (kind, c) in enumerate(columns.items()))
    only = f"AND entity_type IN {kinds}".replace(",)", ")") if kinds else ""
    return with_base(f"""
, hits AS (SELECT * FROM ({parts}) WHERE contains(lower(entity_id), '{q}') {only})
SELECT entity_type, entity_id, orders, items, revenue, {R('revenue / greatest(orders, 1)', 2)} AS avg_order_value,
       CASE WHEN entity_type = 'order' THEN order_status END AS status, CASE WHEN entity_type = 'order' THEN ts END AS purchased_at,
       CASE WHEN entity_type = 'seller' THEN seller_state END AS state, CASE WHEN entity_type = 'product' THEN cat END AS category,
       rfm_segment, CASE WHEN fs.customer_unique_id IS NULL THEN NULL WHEN coalesce(churn_label, 0) = 0 THEN 'Low Risk' ELSE 'High Risk' END AS churn_risk,
       {R('total_spending', 2)} AS customer_value
FROM hits LEFT JOIN fs ON entity_type = 'customer' AND CAST(fs.customer_unique_id AS VARCHAR) = entity_id
WHERE priority = (SELECT min(priority) FROM hits)""")


def _search(spark, sf, q, kinds=None):
    j = jobs(spark, sf)
    return S.search(j.gram_index, j.entities, q, kinds=kinds)


@query("M15_entity_search", _search_sql(_SEARCH_Q))
def m15_search(spark, sf):
    return _search(spark, sf, _SEARCH_Q)


@query("M15_search_orders", _search_sql("100", ("order",)))
def m15_orders(spark, sf):
    return _search(spark, sf, "100", ("order",))


@query("M15_search_sellers", _search_sql("1", ("seller",)))
def m15_sellers(spark, sf):
    return _search(spark, sf, "1", ("seller",))


@query("M15_search_products", _search_sql("142", ("product", "category")))
def m15_products(spark, sf):
    return _search(spark, sf, "142", ("product", "category"))


@query("M15_search_categories", _search_sql("brand_2"))
def m15_categories(spark, sf):
    return _search(spark, sf, " Brand_2 ")


_F_START, _F_END = "1996-01-01", "1999-12-31"
_F_STATES = ("NATION_1", "NATION_2", "NATION_7")
_F_CATS = ("brand_1", "brand_2", "brand_3", "brand_4", "brand_5", "brand_6", "brand_7", "brand_8")


@query("M16_filtered_category_revenue", with_base(f"""
, f AS (SELECT * FROM master WHERE order_purchase_timestamp >= TIMESTAMP '{_F_START}'
          AND order_purchase_timestamp <= TIMESTAMP '{_F_END}'
          AND (upper(customer_state) IN {tuple(_F_STATES)} OR upper(seller_state) IN {tuple(_F_STATES)})
          AND product_category_name_english IN {tuple(_F_CATS)}
          AND customer_unique_id IN (SELECT customer_unique_id FROM fs
                                     WHERE rfm_segment IN ('At Risk', 'Lost / Inactive', 'Hibernating')
                                        OR spending_tier IN ('At Risk', 'Lost / Inactive', 'Hibernating'))),
per AS (SELECT product_category_name_english AS c, order_id, {MSUM('price')} AS rev FROM f GROUP BY ALL)
SELECT {PRETTY('c')} AS category, {MSUM('rev')} AS revenue, count(*) AS order_count FROM per GROUP BY c"""))
def m16_filtered(spark, sf):
    r = retail(spark, sf)
    f = X.filter_master(r.master, r.feature_store, start=_F_START, end=_F_END, states=list(_F_STATES),
                        categories=list(_F_CATS), segments=["At Risk", "Lost / Inactive", "Hibernating"])
    return X.revenue_by_category(f)


@query("M17_price_city_slice", with_base("""
SELECT customer_city, count(*) AS item_rows, count(DISTINCT order_id) AS orders FROM master
WHERE price BETWEEN 20000.0 AND 60000.0 AND customer_city IN ('Nation_1-building', 'Nation_3-machinery', 'Nation_5-household')
GROUP BY customer_city"""))
def m17_slice(spark, sf):
    f = X.filter_master(_m(spark, sf), price_range=(20000.0, 60000.0),
                        cities=["Nation_1-building", "Nation_3-machinery", "Nation_5-household"])
    per = f.groupBy("customer_city", "order_id").count()
    return per.groupBy("customer_city").agg(F.sum("count").alias("item_rows"), F.count(F.lit(1)).alias("orders"))


@query("M18_filter_options", with_base("""
SELECT DISTINCT dimension, value FROM (
  SELECT 'customer_state' AS dimension, CAST(customer_state AS VARCHAR) AS value FROM master
  UNION ALL SELECT 'seller_state', CAST(seller_state AS VARCHAR) FROM master
  UNION ALL SELECT 'category', CAST(product_category_name_english AS VARCHAR) FROM master
  UNION ALL SELECT 'payment', CAST(preferred_payment_type AS VARCHAR) FROM master
  UNION ALL SELECT 'order_status', CAST(order_status AS VARCHAR) FROM master
  UNION ALL SELECT 'segment', CAST(rfm_segment AS VARCHAR) FROM fs
  UNION ALL SELECT 'segment', CAST(spending_tier AS VARCHAR) FROM fs) t WHERE value IS NOT NULL"""))
def m18_filter_options(spark, sf):
    r = retail(spark, sf)
    return X.filter_options(r.master, r.feature_store)


@query("S2_united_options", with_base("""
SELECT 'state' AS dimension, CAST(customer_state AS VARCHAR) AS value FROM master WHERE customer_state IS NOT NULL
UNION SELECT 'state', CAST(seller_state AS VARCHAR) FROM master WHERE seller_state IS NOT NULL
UNION SELECT 'segment', CAST(rfm_segment AS VARCHAR) FROM fs WHERE rfm_segment IS NOT NULL
UNION SELECT 'segment', CAST(spending_tier AS VARCHAR) FROM fs WHERE spending_tier IS NOT NULL"""))
def s2_united(spark, sf):
    r = retail(spark, sf)
    return X.united_options(r.master, r.feature_store)


@query("M18_date_bounds", with_base("""
SELECT min(order_purchase_timestamp) AS min_date, max(order_purchase_timestamp) AS max_date FROM master"""))
def m18_date_bounds(spark, sf):
    return X.date_bounds(_m(spark, sf))
