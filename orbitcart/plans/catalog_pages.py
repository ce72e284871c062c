"""Registered queries: sales, product, seller, logistics and review pages (O)."""

from __future__ import annotations

from orbitcart.operators import pages as P
from orbitcart.plans.oracle import DAYS, MSUM, R, with_base
from orbitcart.plans.pipeline import retail
from orbitcart.plans.registry import query, rounded


def _m(spark, sf):
    return retail(spark, sf).master


_SEASON = """CASE WHEN month(order_purchase_timestamp) IN (12, 1, 2) THEN 'Summer'
            WHEN month(order_purchase_timestamp) IN (3, 4, 5) THEN 'Autumn'
            WHEN month(order_purchase_timestamp) IN (6, 7, 8) THEN 'Winter' ELSE 'Spring' END"""
_DELIV = f"greatest({DAYS('order_delivered_customer_date', 'order_purchase_timestamp')}, 0.0)"
_DELAYED = f"coalesce(CAST({DAYS('order_delivered_customer_date', 'order_estimated_delivery_date')} > 0 AS INTEGER), 0)"
_RATIO = "CASE WHEN price + freight_value > 0 THEN freight_value / (price + freight_value) ELSE 0.0 END"


@query("O1_revenue_by_payment_type", with_base(f"""
SELECT preferred_payment_type, {MSUM('price')} AS revenue FROM master GROUP BY 1"""))
def o1(spark, sf):
    return P.revenue_by_payment_type(_m(spark, sf))


@query("O2_revenue_by_season", with_base(f"""
SELECT {_SEASON} AS season, {MSUM('price')} AS revenue FROM master GROUP BY 1"""))
def o2(spark, sf):
    return P.revenue_by_season(_m(spark, sf))


_TOPCAT = """
, topc AS (SELECT product_category_name_english FROM master WHERE product_category_name_english IS NOT NULL
           GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 10),
mt AS (SELECT * FROM master WHERE product_category_name_english IN (SELECT * FROM topc))"""


@query("O3_category_state_revenue", with_base(f"""{_TOPCAT}
SELECT product_category_name_english, customer_state, {MSUM('price')} AS revenue FROM mt GROUP BY ALL"""))
def o3(spark, sf):
    return P.category_state_revenue(_m(spark, sf), 10)


@query("O3_category_state_revenue_cube", with_base(f"""{_TOPCAT}
SELECT product_category_name_english, customer_state, {MSUM('price')} AS revenue FROM mt
GROUP BY CUBE (product_category_name_english, customer_state)"""))
def o3_cube(spark, sf):
    return P.category_state_revenue(_m(spark, sf), 10, totals="cube")


@query("O4_category_pareto", with_base(f"""
, c AS (SELECT product_category_name_english, {MSUM('price')} AS revenue FROM master
        WHERE product_category_name_english IS NOT NULL GROUP BY 1)
SELECT product_category_name_english, revenue,
       row_number() OVER (ORDER BY revenue DESC, product_category_name_english) AS rank,
       {R("sum(revenue) OVER (ORDER BY revenue DESC, product_category_name_english ROWS UNBOUNDED PRECEDING)", 2)} AS cum_revenue,
       {R("sum(revenue) OVER (ORDER BY revenue DESC, product_category_name_english ROWS UNBOUNDED PRECEDING) / sum(revenue) OVER () * 100.0", 6)} AS cumulative_pct
FROM c"""))
def o4(spark, sf):
    return rounded(P.category_pareto(_m(spark, sf)), {"cum_revenue": 2, "cumulative_pct": 6})


@query("O5_top_products_units", with_base(f"""
SELECT product_id, count(order_item_id) AS units_sold, {MSUM('price')} AS revenue FROM master
GROUP BY 1 ORDER BY revenue DESC, product_id LIMIT 10"""))
def o5(spark, sf):
    return P.top_products_units(_m(spark, sf), 10)


@query("O6_top_rated_categories", with_base(f"""
SELECT product_category_name_english, {R('avg(avg_review_score)', 6)} AS avg_rating, count(order_item_id) AS total_sales
FROM master WHERE product_category_name_english IS NOT NULL GROUP BY 1
ORDER BY avg(avg_review_score) DESC, product_category_name_english LIMIT 10"""))
def o6(spark, sf):
    return rounded(P.top_rated_categories(_m(spark, sf), 10), {"avg_rating": 6})


_SELLERS = f"""
, st AS (SELECT seller_id, {MSUM('price')} AS total_revenue, count(DISTINCT order_id) AS total_orders,
                avg(avg_review_score) AS avg_seller_rating, min(seller_state) AS seller_state FROM master GROUP BY 1)"""


@query("O7_seller_leaderboard", with_base(f"""{_SELLERS}
SELECT seller_id, total_revenue, total_orders, {R('avg_seller_rating', 6)} AS avg_seller_rating, seller_state
FROM st ORDER BY total_revenue DESC, seller_id LIMIT 10"""))
def o7(spark, sf):
    return rounded(P.seller_leaderboard(_m(spark, sf), 10), {"avg_seller_rating": 6})


@query("O7_seller_kpis", with_base(f"""{_SELLERS}
SELECT count(*) AS active_sellers, {R('avg(total_revenue)', 4)} AS avg_revenue_per_seller,
       {R('avg(avg_seller_rating)', 6)} AS avg_seller_rating FROM st"""))
def o7_kpis(spark, sf):
    return rounded(P.seller_kpis(_m(spark, sf)), {"avg_revenue_per_seller": 4, "avg_seller_rating": 6})


@query("O8_sellers_per_state", with_base(f"""{_SELLERS}
SELECT seller_state, count(*) AS seller_count FROM st GROUP BY 1 ORDER BY seller_count DESC, seller_state LIMIT 8"""))
def o8(spark, sf):
    return P.sellers_per_state(_m(spark, sf), 8)


@query("O9_logistics_kpis", with_base(f"""
SELECT {R(f'avg({_DELIV})', 6)} AS avg_delivery_days, {R(f'avg({_DELAYED}) * 100.0', 6)} AS delayed_pct,
       {R(f'avg({_RATIO}) * 100.0', 6)} AS avg_freight_ratio_pct, {MSUM('freight_value')} AS total_freight
FROM master"""))
def o9(spark, sf):
    return rounded(P.logistics_kpis(_m(spark, sf)),
                   {"avg_delivery_days": 6, "delayed_pct": 6, "avg_freight_ratio_pct": 6})


@query("O10_delivery_box_stats", with_base(f"""
, topst AS (SELECT customer_state FROM master WHERE customer_state IS NOT NULL GROUP BY 1
            ORDER BY count(*) DESC, 1 LIMIT 8),
d AS (SELECT customer_state, {_DELIV} AS dd FROM master WHERE customer_state IN (SELECT * FROM topst))
SELECT customer_state, {R('quantile_cont(dd, 0.0)', 6)} AS min_days, {R('quantile_cont(dd, 0.25)', 6)} AS q1_days,
       {R('quantile_cont(dd, 0.5)', 6)} AS median_days, {R('quantile_cont(dd, 0.75)', 6)} AS q3_days,
       {R('quantile_cont(dd, 1.0)', 6)} AS max_days
FROM d WHERE dd IS NOT NULL GROUP BY 1"""))
def o10(spark, sf):
    return rounded(P.delivery_box_stats(_m(spark, sf), 8),
                   {c: 6 for c in ("min_days", "q1_days", "median_days", "q3_days", "max_days")})


@query("O11_order_status_breakdown", with_base("""
SELECT order_status, count(*) AS count FROM master WHERE order_status IS NOT NULL GROUP BY 1"""))
def o11(spark, sf):
    return _m(spark, sf).where("order_status IS NOT NULL").groupBy("order_status").count()


@query("O12_review_kpis", with_base(f"""
SELECT {R('avg(avg_review_score)', 6)} AS csat,
       {R('avg(CAST(avg_review_score = 5 AS DOUBLE)) * 100.0', 6)} AS five_star_pct,
       {R('avg(CAST(avg_review_score <= 2 AS DOUBLE)) * 100.0', 6)} AS low_score_pct FROM master"""))
def o12(spark, sf):
    return rounded(P.review_kpis(_m(spark, sf)), {"csat": 6, "five_star_pct": 6, "low_score_pct": 6})


@query("O13_rounded_rating_counts", with_base("""
SELECT round_even(avg_review_score, 0) AS review_score, count(*) AS count FROM master
WHERE avg_review_score IS NOT NULL GROUP BY 1"""))
def o13(spark, sf):
    return P.rounded_rating_counts(_m(spark, sf))


@query("O13_category_rating_radar", with_base(f"""
SELECT product_category_name_english, {R('avg(avg_review_score)', 6)} AS avg_rating FROM master
WHERE product_category_name_english IS NOT NULL GROUP BY 1"""))
def o13_radar(spark, sf):
    return rounded(P.category_rating_radar(_m(spark, sf)), {"avg_rating": 6})


@query("O14_bi_measures", with_base(f"""
, pc AS (SELECT customer_unique_id, count(DISTINCT order_id) AS o, {MSUM('price')} AS rev FROM master GROUP BY 1)
SELECT {MSUM("rev")} AS revenue, CAST(sum(o) AS BIGINT) AS orders, {R(f"{MSUM('rev')} / greatest(sum(o), 1)", 6)} AS aov,
       count(*) FILTER (WHERE o > 1) AS repeat_buyers,
       {R('count(*) FILTER (WHERE o > 1) / greatest(count(*), 1) * 100.0', 6)} AS repeat_rate_pct FROM pc"""))
def o14(spark, sf):
    return rounded(P.bi_measures(_m(spark, sf)), {"aov": 6, "repeat_rate_pct": 6})
