"""Registered queries: cleaning, master, features, labels and RFM analytics (C, D, E, F, G)."""

from __future__ import annotations

from pyspark.sql import functions as F

from orbitcart.operators import master as M
from orbitcart.operators import rfm
from orbitcart.plans.oracle import DAYS, MAVG, MSUM, R, with_base
from orbitcart.plans.pipeline import retail
from orbitcart.plans.registry import query, rounded

# ---------------------------------------------------------------- C / D: tables


@query("C1_clean_customers", with_base("SELECT * FROM cust"))
def c1_clean_customers(spark, sf):
    return retail(spark, sf).cleaned["customers"]


@query("C4_clean_orders", with_base("SELECT * FROM orders_c"))
def c4_clean_orders(spark, sf):
    return retail(spark, sf).cleaned["orders"]


@query("C2_clean_order_items", with_base("SELECT * FROM items"))
def c2_clean_order_items(spark, sf):
    return retail(spark, sf).cleaned["order_items"]


@query("C6_clean_products", with_base(
    "SELECT product_id, product_category_name_english, product_name_lenght, product_weight_g FROM prod"))
def c6_clean_products(spark, sf):
    return retail(spark, sf).cleaned["products"].select(
        "product_id", "product_category_name_english", "product_name_lenght", "product_weight_g")


@query("C3_clean_sellers", with_base("SELECT * FROM sell"))
def c3_clean_sellers(spark, sf):
    return retail(spark, sf).cleaned["sellers"]


@query("C5_clean_payments", with_base(f"""
SELECT order_id, payment_sequential, payment_type, payment_installments, {R('payment_value', 2)} AS payment_value
FROM pay_rows"""))
def c5_clean_payments(spark, sf):
    return rounded(retail(spark, sf).cleaned["payments"], {"payment_value": 2})


@query("C8_clean_reviews", with_base("""
SELECT l_orderkey AS order_id,
       coalesce(TRY_CAST(CAST(1 + (l_partkey + l_linenumber) % 5 AS VARCHAR) AS DOUBLE), 3.0) AS review_score
FROM lineitem"""))
def c8_clean_reviews(spark, sf):
    return retail(spark, sf).cleaned["reviews"]


@query("D1_payments_by_order", with_base(f"""
SELECT order_id, {R('total_payment_value', 4)} AS total_payment_value, max_payment_installments,
       preferred_payment_type, payment_sequences_count FROM pay"""))
def d1_payments_by_order(spark, sf):
    return rounded(M.payments_by_order(retail(spark, sf).cleaned["payments"]), {"total_payment_value": 4})


@query("D2_reviews_by_order", with_base(f"""
SELECT order_id, {R('avg_review_score', 6)} AS avg_review_score, total_reviews_count FROM rev"""))
def d2_reviews_by_order(spark, sf):
    return rounded(M.reviews_by_order(retail(spark, sf).cleaned["reviews"]), {"avg_review_score": 6})


_MASTER_SQL = with_base(f"""
SELECT * REPLACE ({R('total_payment_value', 4)} AS total_payment_value, {R('avg_review_score', 6)} AS avg_review_score,
                  {R('freight_value', 6)} AS freight_value)
FROM master""")


@query("D10_master", _MASTER_SQL)
def d10_master(spark, sf):
    return rounded(retail(spark, sf).master,
                   {"total_payment_value": 4, "avg_review_score": 6, "freight_value": 6})


@query("D11_semi_join_filtered_customers", with_base("""
SELECT * FROM cust WHERE customer_id IN (SELECT customer_unique_id FROM master WHERE customer_state = 'NATION_3')"""))
def d11_semi(spark, sf):
    r = retail(spark, sf)
    ids = r.master.where(F.col("customer_state") == "NATION_3").select(
        F.col("customer_unique_id").alias("customer_id"))
    return M.semi_by_ids(r.cleaned["customers"], ids, "customer_id")


@query("D12_anti_join_customers_without_orders", with_base("""
SELECT * FROM cust c WHERE NOT EXISTS (SELECT 1 FROM master m WHERE m.customer_id = c.customer_id)"""))
def d12_anti(spark, sf):
    r = retail(spark, sf)
    return M.anti_by_ids(r.cleaned["customers"], r.master.select("customer_id"), "customer_id")


# ---------------------------------------------------------------- E: features

_E1_SQL = with_base(f"""
SELECT order_id, order_item_id, product_id,
       {R(f"greatest({DAYS('order_delivered_customer_date', 'order_purchase_timestamp')}, 0.0)", 4)}
         AS delivery_time_days,
       {R(DAYS('order_delivered_customer_date', 'order_estimated_delivery_date'), 4)} AS delivery_delay_days,
       coalesce(CAST({DAYS('order_delivered_customer_date', 'order_estimated_delivery_date')} > 0 AS INTEGER), 0)
         AS is_delayed,
       {R("CASE WHEN price + freight_value > 0 THEN freight_value / (price + freight_value) ELSE 0.0 END", 6)}
         AS shipping_cost_ratio,
       CAST(year(order_purchase_timestamp) AS INTEGER) AS purchase_year,
       CAST(month(order_purchase_timestamp) AS INTEGER) AS purchase_month,
       CAST(quarter(order_purchase_timestamp) AS INTEGER) AS purchase_quarter,
       CAST(isodow(order_purchase_timestamp) - 1 AS INTEGER) AS day_of_week,
       CAST(isodow(order_purchase_timestamp) IN (6, 7) AS INTEGER) AS is_weekend,
       CASE WHEN month(order_purchase_timestamp) IN (12, 1, 2) THEN 'Summer'
            WHEN month(order_purchase_timestamp) IN (3, 4, 5) THEN 'Autumn'
            WHEN month(order_purchase_timestamp) IN (6, 7, 8) THEN 'Winter' ELSE 'Spring' END AS season
FROM master""")


@query("E1_order_features", _E1_SQL)
def e1_order_features(spark, sf):
    of = retail(spark, sf).order_features
    return rounded(of.select("order_id", "order_item_id", "product_id", "delivery_time_days", "delivery_delay_days",
                             "is_delayed", "shipping_cost_ratio", "purchase_year", "purchase_month",
                             "purchase_quarter", "day_of_week", "is_weekend", "season"),
                   {"delivery_time_days": 4, "delivery_delay_days": 4, "shipping_cost_ratio": 6})


_CF_ROUND = {"total_spending": 2, "total_freight_paid": 4, "avg_order_value": 6, "avg_review_score_given": 6,
             "recency_days": 4, "customer_age_days": 4, "purchase_lifespan_days": 4,
             "purchase_frequency_monthly": 6, "avg_freight_cost": 6}


def _cf_sql_cols(prefix: str = "") -> str:
    return ", ".join(f"{R(prefix + c, d)} AS {c}" for c, d in _CF_ROUND.items())


@query("E2_customer_features", with_base(f"SELECT * REPLACE ({_cf_sql_cols()}) FROM cf"))
def e2_customer_features(spark, sf):
    return rounded(retail(spark, sf).customer_features, _CF_ROUND)


@query("E4_product_features", with_base(f"""
SELECT product_id, count(order_item_id) AS product_popularity_units, {MSUM('price')} AS total_product_revenue,
       count(DISTINCT customer_unique_id) AS unique_customers_count,
       {R('avg(avg_review_score)', 6)} AS avg_product_rating, {R(MAVG('price'), 6)} AS avg_selling_price,
       min(product_category_name_english) AS category
FROM master GROUP BY product_id"""))
def e4_product_features(spark, sf):
    return rounded(retail(spark, sf).product_features,
                   {"total_product_revenue": 2, "avg_product_rating": 6, "avg_selling_price": 6})


@query("E5_seller_features", with_base(f"""
SELECT seller_id, {MSUM('price')} AS seller_total_revenue, count(DISTINCT order_id) AS seller_total_orders,
       count(order_item_id) AS seller_unique_items_sold, {R('avg(avg_review_score)', 6)} AS seller_avg_rating,
       min(seller_state) AS seller_state, min(seller_city) AS seller_city
FROM master GROUP BY seller_id"""))
def e5_seller_features(spark, sf):
    return rounded(retail(spark, sf).seller_features,
                   {"seller_total_revenue": 2, "seller_avg_rating": 6})


# ---------------------------------------------------------------- F: labels (the feature store)

_FS_ROUND = dict(_CF_ROUND, historical_clv=4, clv_per_order=6)


@query("F_feature_store", with_base(
    f"SELECT * REPLACE ({_cf_sql_cols()}, {R('historical_clv', 4)} AS historical_clv, "
    f"{R('clv_per_order', 6)} AS clv_per_order) FROM fs"))
def f_feature_store(spark, sf):
    return rounded(retail(spark, sf).feature_store, _FS_ROUND)


@query("F5_rfm_segment_counts", with_base("""
SELECT rfm_segment, churn_label, spending_tier, count(*) AS customers FROM fs GROUP BY ALL"""))
def f5_segment_counts(spark, sf):
    fs = retail(spark, sf).feature_store
    return fs.groupBy("rfm_segment", "churn_label", "spending_tier").agg(F.count(F.lit(1)).alias("customers"))


# ---------------------------------------------------------------- G: RFM analytics

def _g5_sql() -> str:
    vals = ",\n".join(
        "(" + ", ".join("'" + x.replace("'", "''") + "'" for x in (k, *v)) + ")"
        for k, v in rfm.SEGMENT_ATTRIBUTES.items())
    cols = ", ".join(rfm.SEGMENT_ATTRIBUTE_NAMES)
    attrs = ", ".join(f"coalesce(a.{c}, '{rfm.DEFAULT_ATTRIBUTE}') AS {c}" for c in rfm.SEGMENT_ATTRIBUTE_NAMES)
    return with_base(f"""
, seg AS (
  SELECT rfm_segment_label, count(customer_unique_id) AS customer_count,
         {R('avg(recency_days)', 6)} AS avg_recency, {R('avg(total_orders)', 6)} AS avg_orders,
         {R('avg(total_spending)', 6)} AS avg_spending, {R('sum(total_spending)')} AS total_revenue
  FROM rfm GROUP BY rfm_segment_label),
attrs(rfm_segment_label, {cols}) AS (VALUES {vals})
SELECT seg.*, {attrs} FROM seg LEFT JOIN attrs a USING (rfm_segment_label)""")


def g5_segment_summary_df(spark, sf):
    r = retail(spark, sf)
    summary = rfm.segment_summary(rfm.rfm_analysis(r.feature_store, with_rank=False))
    return rounded(summary, {"avg_recency": 6, "avg_orders": 6, "avg_spending": 6, "total_revenue": 2})


# the body starts with ", seg AS (...)": more CTEs appended to the base list
query("G5_segment_summary", _g5_sql())(g5_segment_summary_df)


@query("G4_priority_ranking", with_base("""
SELECT customer_unique_id, r_score, f_score, m_score, rfm_combined_score, rfm_segment_label,
       customer_priority_score, CAST(rank() OVER (ORDER BY customer_priority_score DESC) AS INTEGER) AS priority_rank
FROM (SELECT *, CAST(r_score AS VARCHAR) || CAST(f_score AS VARCHAR) || CAST(m_score AS VARCHAR)
                 AS rfm_combined_score FROM rfm) t"""))
def g4_priority_ranking(spark, sf):
    df = rfm.rfm_analysis(retail(spark, sf).feature_store, with_rank=True)
    return df.select("customer_unique_id", "r_score", "f_score", "m_score", "rfm_combined_score",
                     "rfm_segment_label", "customer_priority_score", "priority_rank")


@query("G6_score_distribution", with_base("""
, spine AS (SELECT d AS dimension, CAST(s AS INTEGER) AS quintile_score
            FROM (VALUES ('recency'), ('frequency'), ('monetary')) v(d), range(1, 6) r(s)),
long AS (SELECT 'recency' AS dimension, r_score AS quintile_score FROM rfm
         UNION ALL SELECT 'frequency', f_score FROM rfm UNION ALL SELECT 'monetary', m_score FROM rfm)
SELECT spine.dimension, spine.quintile_score, CAST(count(long.quintile_score) AS BIGINT) AS customer_count
FROM spine LEFT JOIN long USING (dimension, quintile_score) GROUP BY ALL"""))
def g6_score_distribution(spark, sf):
    return rfm.score_distribution(rfm.rfm_scores(retail(spark, sf).feature_store))


@query("G7_rf_heatmap", with_base("""
SELECT CAST(r.s AS INTEGER) AS r_score,
       CAST(count(*) FILTER (WHERE f_score = 1) AS BIGINT) AS f1, CAST(count(*) FILTER (WHERE f_score = 2) AS BIGINT) AS f2,
       CAST(count(*) FILTER (WHERE f_score = 3) AS BIGINT) AS f3, CAST(count(*) FILTER (WHERE f_score = 4) AS BIGINT) AS f4,
       CAST(count(*) FILTER (WHERE f_score = 5) AS BIGINT) AS f5
FROM range(1, 6) r(s) LEFT JOIN rfm ON rfm.r_score = r.s GROUP BY r.s"""))
def g7_rf_heatmap(spark, sf):
    return rfm.rf_heatmap(rfm.rfm_scores(retail(spark, sf).feature_store))


@query("G8_segment_distribution", with_base("""
SELECT rfm_segment_label AS rfm_segment, count(*) AS customer_count FROM rfm GROUP BY 1"""))
def g8_segment_distribution(spark, sf):
    return rfm.segment_distribution(rfm.rfm_analysis(retail(spark, sf).feature_store, with_rank=False))
