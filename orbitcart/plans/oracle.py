"""DuckDB SQL for the same pipeline, used as the correctness oracle.

``BASE`` is a chain of CTEs over the driver's tables that rebuilds the canonical tables,
the master, the customer features and the labels with plain SQL (window ``row_number``
for ranks, ``quantile_cont`` for percentiles). Each oracle query is ``with_base(body)``.

Conventions shared with the Spark side (see ``orbitcart.plans.registry``): doubles that are
sums or means are rounded with ``R(x, n)`` here and ``F.round(x, n)`` there, with ``n`` at or
above the decimal precision of the exact result where there is one (sums of cents at 2, of
price*tax at 4), so engines that add in different orders land on the same side of a
rounding boundary.
"""

from __future__ import annotations


def MSUM(expr: str) -> str:
    return R(f"sum({expr})", 2)


def MAVG(expr: str) -> str:
    return f"({R(f'sum({expr})', 2)} / count({expr}))"


def R(expr: str, digits: int = 2) -> str:
    # Spark rounds the shortest round-trip decimal form of the double half-up; DuckDB prints
    # the same shortest form, so round that text as a DECIMAL.
    return f"CAST(round(CAST(CAST(CAST(({expr}) AS DOUBLE) AS VARCHAR) AS DECIMAL(38,18)), {digits}) AS DOUBLE)"


def DAYS(later: str, earlier: str) -> str:
    return f"(CAST(epoch_us({later}) - epoch_us({earlier}) AS DOUBLE) / 86400000000.0)"


def INITCAP(expr: str) -> str:
    # words are separated by single spaces in all test values
    return (f"array_to_string(list_transform(string_split({expr}, ' '), "
            f"lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), ' ')")


_CTES = [
    ("cust", f"""
SELECT c.c_custkey AS customer_id, c.c_custkey AS customer_unique_id,
       {INITCAP("trim(concat_ws('-', n.n_name, c.c_mktsegment))")} AS customer_city,
       upper(trim(n.n_name)) AS customer_state
FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey"""),
    ("orders_c", """
SELECT o.o_orderkey AS order_id, o.o_custkey AS customer_id, lower(trim(o.o_orderstatus)) AS order_status,
       o.o_orderdate AS order_purchase_timestamp, d.delivered AS order_delivered_customer_date,
       o.o_orderdate + INTERVAL 60 DAY AS order_estimated_delivery_date
FROM orders o LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS delivered FROM lineitem GROUP BY l_orderkey) d
  ON o.o_orderkey = d.l_orderkey"""),
    ("items", f"""
SELECT * FROM (
  SELECT DISTINCT l_orderkey AS order_id, l_linenumber AS order_item_id, l_partkey AS product_id,
         l_suppkey AS seller_id, l_shipdate AS shipping_limit_date, l_extendedprice AS price,
         {R("l_extendedprice * l_tax", 2)} AS freight_value
  FROM lineitem) t
WHERE price >= 0 AND freight_value >= 0"""),
    ("prod", """
SELECT p_partkey AS product_id,
       coalesce('brand_' || split_part(p_brand, '#', 2), p_brand, 'unspecified') AS product_category_name_english,
       CAST(length(p_name) AS INTEGER) AS product_name_lenght, CAST(p_size AS DOUBLE) * 10.0 AS product_weight_g
FROM part"""),
    ("sell", f"""
SELECT s.s_suppkey AS seller_id, {INITCAP("trim(n.n_name || '-SUPPLY')")} AS seller_city,
       upper(trim(n.n_name)) AS seller_state
FROM supplier s LEFT JOIN nation n ON s.s_nationkey = n.n_nationkey"""),
    ("pay_rows", f"""
SELECT l_orderkey AS order_id, l_linenumber AS payment_sequential,
       lower(trim(l_returnflag || l_linestatus)) AS payment_type,
       1 + CAST(trunc(l_quantity) AS INTEGER) % 12 AS payment_installments,
       {R("l_extendedprice * (1.0 + l_tax)", 2)} AS payment_value
FROM lineitem WHERE {R("l_extendedprice * (1.0 + l_tax)", 2)} >= 0"""),
    ("pay_mode", """
SELECT order_id, payment_type AS preferred_payment_type FROM (
  SELECT order_id, payment_type,
         row_number() OVER (PARTITION BY order_id ORDER BY count(*) DESC, payment_type) AS rn
  FROM pay_rows GROUP BY order_id, payment_type) t WHERE rn = 1"""),
    ("pay", f"""
SELECT a.*, m.preferred_payment_type FROM (
  SELECT order_id, {R("sum(payment_value)", 2)} AS total_payment_value, max(payment_installments) AS max_payment_installments,
         count(payment_sequential) AS payment_sequences_count
  FROM pay_rows GROUP BY order_id) a JOIN pay_mode m USING (order_id)"""),
    ("rev", """
SELECT l_orderkey AS order_id,
       avg(coalesce(TRY_CAST(CAST(1 + (l_partkey + l_linenumber) % 5 AS VARCHAR) AS DOUBLE), 3.0)) AS avg_review_score,
       count(*) AS total_reviews_count
FROM lineitem GROUP BY l_orderkey"""),
    ("master", """
SELECT o.order_id, o.customer_id, o.order_status, o.order_purchase_timestamp, o.order_delivered_customer_date,
       o.order_estimated_delivery_date, c.customer_unique_id, c.customer_city, c.customer_state,
       i.order_item_id, i.product_id, i.seller_id, i.shipping_limit_date, i.price, i.freight_value,
       p.product_category_name_english, p.product_name_lenght, p.product_weight_g, s.seller_city, s.seller_state,
       coalesce(pa.total_payment_value, i.price + i.freight_value) AS total_payment_value,
       pa.max_payment_installments, coalesce(pa.preferred_payment_type, 'unspecified') AS preferred_payment_type,
       pa.payment_sequences_count, coalesce(r.avg_review_score, 3.0) AS avg_review_score, r.total_reviews_count
FROM items i JOIN orders_c o ON i.order_id = o.order_id
JOIN cust c ON o.customer_id = c.customer_id
LEFT JOIN prod p ON i.product_id = p.product_id
LEFT JOIN sell s ON i.seller_id = s.seller_id
LEFT JOIN pay pa ON i.order_id = pa.order_id
LEFT JOIN rev r ON i.order_id = r.order_id"""),
    ("snap", "SELECT max(order_purchase_timestamp) + INTERVAL 1 DAY AS snap FROM master"),
    ("cust_pay_mode", """
SELECT customer_unique_id, preferred_payment_type AS preferred_payment_method FROM (
  SELECT customer_unique_id, preferred_payment_type,
         row_number() OVER (PARTITION BY customer_unique_id ORDER BY count(*) DESC, preferred_payment_type) AS rn
  FROM master GROUP BY customer_unique_id, preferred_payment_type) t WHERE rn = 1"""),
    ("cf0", f"""
SELECT customer_unique_id, count(DISTINCT order_id) AS total_orders, count(order_item_id) AS total_items_purchased,
       {R("sum(price)", 2)} AS total_spending, {R("sum(freight_value)", 2)} AS total_freight_paid,
       {R("sum(price)", 2)} / count(price) AS avg_order_value,
       {R("avg(avg_review_score)", 10)} AS avg_review_score_given, min(order_purchase_timestamp) AS first_purchase_date,
       max(order_purchase_timestamp) AS last_purchase_date,
       count(DISTINCT product_category_name_english) AS distinct_categories_count,
       arg_min(customer_state, (order_purchase_timestamp, order_id, order_item_id)) AS customer_state,
       arg_min(customer_city, (order_purchase_timestamp, order_id, order_item_id)) AS customer_city
FROM master GROUP BY customer_unique_id"""),
    ("cf", f"""
SELECT cf0.*, pm.preferred_payment_method,
       {DAYS("snap.snap", "last_purchase_date")} AS recency_days,
       {DAYS("snap.snap", "first_purchase_date")} AS customer_age_days,
       {DAYS("last_purchase_date", "first_purchase_date")} AS purchase_lifespan_days,
       total_orders / greatest({DAYS("snap.snap", "first_purchase_date")} / 30.0, 1.0) AS purchase_frequency_monthly,
       CAST(total_orders > 1 AS INTEGER) AS is_repeat_customer,
       total_freight_paid / greatest(total_orders, 1) AS avg_freight_cost
FROM cf0 JOIN cust_pay_mode pm USING (customer_unique_id), snap"""),
    ("cf_stats", """
SELECT count(*) AS n,
       quantile_cont(recency_days, [0.2, 0.4, 0.6, 0.8]) AS rq,
       quantile_cont(total_spending, [0.5, 0.8, 0.95]) AS sq,
       min(total_orders) AS o_min, max(total_orders) AS o_max,
       min(total_spending) AS s_min, max(total_spending) AS s_max,
       min(recency_days) AS r_min, max(recency_days) AS r_max
FROM cf"""),
    ("cf_ranked", """
SELECT cf.*,
       row_number() OVER (ORDER BY total_orders, customer_unique_id) AS f_rn,
       row_number() OVER (ORDER BY total_spending, customer_unique_id) AS m_rn
FROM cf"""),
    ("fs0", """
SELECT c.*,
       CAST(c.recency_days > 90 AS INTEGER) AS churn_label,
       CAST(CASE WHEN c.recency_days <= st.rq[1] THEN 5 WHEN c.recency_days <= st.rq[2] THEN 4
                 WHEN c.recency_days <= st.rq[3] THEN 3 WHEN c.recency_days <= st.rq[4] THEN 2 ELSE 1 END AS INTEGER)
         AS recency_score,
       CAST(CASE WHEN st.n > 1 THEN greatest(1, ceil(5.0::DOUBLE * (c.f_rn - 1) / (st.n - 1))) ELSE 1 END AS INTEGER)
         AS frequency_score,
       CAST(CASE WHEN st.n > 1 THEN greatest(1, ceil(5.0::DOUBLE * (c.m_rn - 1) / (st.n - 1))) ELSE 1 END AS INTEGER)
         AS monetary_score,
       c.total_spending + c.total_freight_paid AS historical_clv,
       (c.total_spending + c.total_freight_paid) / greatest(c.total_orders, 1) AS clv_per_order,
       CASE WHEN c.total_spending >= st.sq[3] THEN 'Tier 4 - Platinum VIP'
            WHEN c.total_spending >= st.sq[2] THEN 'Tier 3 - Gold'
            WHEN c.total_spending >= st.sq[1] THEN 'Tier 2 - Silver' ELSE 'Tier 1 - Bronze' END AS spending_tier,
       ((CAST(c.total_orders - st.o_min AS DOUBLE) / greatest(CAST(st.o_max - st.o_min AS DOUBLE), 1.0)) * 0.4
        + ((c.total_spending - st.s_min) / greatest(st.s_max - st.s_min, 1.0)) * 0.4
        + c.avg_review_score_given / 5.0 * 0.2) * 100.0 AS loyalty_raw
FROM cf_ranked c, cf_stats st"""),
    ("fs", f"""
SELECT * EXCLUDE (f_rn, m_rn, loyalty_raw),
       CAST(recency_score AS VARCHAR) || CAST(frequency_score AS VARCHAR) || CAST(monetary_score AS VARCHAR)
         AS rfm_combined,
       CASE WHEN recency_score >= 4 AND frequency_score >= 4 AND monetary_score >= 4 THEN 'Champions'
            WHEN recency_score >= 3 AND frequency_score >= 3 THEN 'Loyal Customers'
            WHEN recency_score >= 3 AND frequency_score < 3 AND monetary_score >= 3 THEN 'Potential Loyalists'
            WHEN recency_score = 3 AND frequency_score < 3 THEN 'Promising / Recent'
            WHEN recency_score = 2 AND frequency_score >= 2 THEN 'At Risk'
            WHEN recency_score <= 2 AND frequency_score >= 4 THEN 'Cant Lose Them'
            WHEN recency_score = 2 AND frequency_score <= 2 THEN 'Hibernating'
            ELSE 'Lost / Inactive' END AS rfm_segment,
       {R("loyalty_raw", 2)} AS loyalty_score
FROM fs0"""),
    ("rfm", f"""
SELECT fs.*, recency_score AS r_score, frequency_score AS f_score, monetary_score AS m_score,
       CASE WHEN recency_score >= 4 AND frequency_score >= 4 AND monetary_score >= 4 THEN 'Champions'
            WHEN recency_score >= 3 AND frequency_score >= 3 AND monetary_score >= 3 THEN 'Loyal Customers'
            WHEN recency_score >= 3 AND frequency_score >= 1 AND monetary_score >= 3 THEN 'Potential Loyalists'
            WHEN recency_score >= 4 AND frequency_score = 1 THEN 'New Customers'
            WHEN recency_score = 3 AND frequency_score = 1 THEN 'Promising'
            WHEN recency_score = 3 AND frequency_score >= 2 THEN 'Need Attention'
            WHEN recency_score = 2 AND frequency_score >= 2 THEN 'At Risk'
            WHEN recency_score <= 2 AND frequency_score >= 4 THEN 'Can''t Lose Them'
            WHEN recency_score = 2 AND frequency_score = 1 THEN 'Hibernating'
            ELSE 'Lost Customers' END AS rfm_segment_label,
       {R("""((total_spending - st.s_min) / greatest(st.s_max - st.s_min, 1.0) * 0.5
             + (st.r_max - recency_days) / greatest(st.r_max - st.r_min, 1.0) * 0.3
             + CAST(total_orders - st.o_min AS DOUBLE) / greatest(CAST(st.o_max - st.o_min AS DOUBLE), 1.0) * 0.2)
             * 100.0""", 2)} AS customer_priority_score
FROM fs, cf_stats st"""),
]


def base_ctes() -> str:
    return ",\n".join(f"{name} AS ({body.strip()})" for name, body in _CTES)


def with_base(body: str, recursive: bool = False) -> str:
    """Prefix a query body with the pipeline CTEs (DuckDB drops the unreferenced ones)."""
    return f"WITH {'RECURSIVE ' if recursive else ''}{base_ctes()}\n{body.strip()}"
