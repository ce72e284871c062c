"""Registered queries: recommender (K)."""

from __future__ import annotations

from pyspark.sql import functions as F

from orbitcart.operators import recommend as K
from orbitcart.plans.jobs import jobs
from orbitcart.plans.oracle import MAVG, MSUM, R, with_base
from orbitcart.plans.pipeline import retail
from orbitcart.plans.registry import query, rounded
from orbitcart.session import written_table



def _reco(m: str = "master", n: int = 5) -> str:
    """The recommender in SQL over the item rows ``m``; targets are all products of the catalogue."""
    return f"""
, pop AS (SELECT product_id, product_category_name_english, count(order_item_id) AS total_units,
                 {MSUM('price')} AS total_revenue, {MAVG('price')} AS avg_price,
                 {R('avg(avg_review_score)', 10)} AS avg_rating
          FROM {m} WHERE product_category_name_english IS NOT NULL GROUP BY 1, 2),
it AS (SELECT customer_unique_id, product_id, count(order_item_id) AS n, any_value(pop.product_category_name_english) AS category
       FROM {m} JOIN pop USING (product_id) GROUP BY 1, 2),
nrm AS (SELECT product_id, sqrt(sum(n * n)) AS norm FROM it GROUP BY 1),
dots AS (SELECT x.product_id AS a, y.product_id AS b, sum(x.n * y.n) AS dot FROM it x JOIN it y USING (customer_unique_id)
         WHERE x.product_id < y.product_id GROUP BY 1, 2),
sims AS (SELECT a, b, {R('dot / (x.norm * y.norm)', 10)} AS sim FROM dots JOIN nrm x ON x.product_id = a JOIN nrm y ON y.product_id = b),
near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY sim DESC, neighbour_id) AS rank FROM (
           SELECT a AS product_id, b AS neighbour_id, sim FROM sims UNION ALL SELECT b, a, sim FROM sims)) WHERE rank <= 20),
aff AS (SELECT customer_unique_id, category, count(*) AS affinity FROM it GROUP BY 1, 2),
collab AS (SELECT it.customer_unique_id, neighbour_id AS product_id, sum(sim) AS collab FROM it JOIN near USING (product_id) GROUP BY 1, 2),
content AS (SELECT customer_unique_id, product_id, affinity FROM aff JOIN pop ON pop.product_category_name_english = aff.category),
sc AS (SELECT coalesce(l.customer_unique_id, t.customer_unique_id) AS customer_unique_id, coalesce(l.product_id, t.product_id) AS product_id,
              {R('coalesce(collab, 0.0) * 0.6 + coalesce(affinity, 0) * 0.4', 10)} AS hybrid_score
       FROM collab l FULL JOIN content t ON t.customer_unique_id = l.customer_unique_id AND t.product_id = l.product_id),
fresh AS (SELECT sc.* FROM sc LEFT JOIN it ON it.customer_unique_id = sc.customer_unique_id AND it.product_id = sc.product_id
          WHERE it.product_id IS NULL AND hybrid_score > 0),
rk AS (SELECT * FROM (SELECT fresh.*, row_number() OVER (PARTITION BY customer_unique_id
              ORDER BY hybrid_score DESC, total_units DESC, avg_rating DESC, product_id) AS rec_rank
       FROM fresh JOIN pop USING (product_id)) WHERE rec_rank <= {n}),
hrec AS (SELECT rk.customer_unique_id, product_id, pop.product_category_name_english AS category,
                {R('pop.avg_price', 2)} AS avg_price, rk.hybrid_score, CAST(rk.rec_rank AS INTEGER) AS rec_rank,
                'hybrid' AS recommendation_type FROM rk JOIN pop USING (product_id)),
trend AS (SELECT product_id, product_category_name_english AS category, {R('avg_price', 2)} AS avg_price,
                 CAST(row_number() OVER (ORDER BY total_units DESC, avg_rating DESC, product_id) AS INTEGER) AS rec_rank
          FROM pop ORDER BY total_units DESC, avg_rating DESC, product_id LIMIT 5),
cold AS (SELECT f.customer_unique_id, t.product_id, t.category, t.avg_price, 1.0 AS hybrid_score, t.rec_rank,
                'cold_start' AS recommendation_type
         FROM (SELECT DISTINCT customer_unique_id FROM fs WHERE customer_unique_id NOT IN
               (SELECT customer_unique_id FROM hrec)) f, trend t),
recs AS (SELECT * FROM hrec UNION ALL SELECT * FROM cold)"""


_RECO = _reco()


def _j(spark, sf):
    return jobs(spark, sf)


@query("K1_popularity", with_base(f"""{_RECO}
SELECT product_id, product_category_name_english, total_units, total_revenue, {R('avg_price', 6)} AS avg_price,
       {R('avg_rating', 6)} AS avg_rating FROM pop"""))
def k1(spark, sf):
    return rounded(_j(spark, sf).popularity, {"avg_price": 6, "avg_rating": 6})


@query("K2_interactions", with_base(f"""{_RECO}
SELECT customer_unique_id, product_id, n FROM it"""))
def k2(spark, sf):
    return _j(spark, sf).interactions.select("customer_unique_id", "product_id", "n")


@query("K4_item_similarity", with_base(f"""{_RECO}
SELECT product_id, neighbour_id, {R('sim', 8)} AS similarity, CAST(rank AS INTEGER) AS rank FROM near"""))
def k4(spark, sf):
    s = _j(spark, sf).neighbours.select("product_id", "neighbour_id", F.col("sim").alias("similarity"), F.col("rank").cast("int"))
    return rounded(s, {"similarity": 8})


@query("K5_content_similarity", with_base(f"""{_RECO}
SELECT customer_unique_id, category, CAST(affinity AS DOUBLE) AS affinity, affinity AS bought FROM aff"""))
def k5(spark, sf):
    return _j(spark, sf).affinity.select("customer_unique_id", "category", "affinity", "bought")


@query("K6_hybrid_recommendations", with_base(f"""{_RECO}
SELECT customer_unique_id, product_id, category, avg_price, {R('hybrid_score', 6)} AS hybrid_score, rec_rank,
       recommendation_type FROM recs"""))
def k6(spark, sf):
    r = _j(spark, sf).recommendations
    return rounded(r.select("customer_unique_id", "product_id", "category", "avg_price", "hybrid_score", "rec_rank",
                            "recommendation_type"), {"hybrid_score": 6})


_HOLDOUT = """
, span AS (SELECT epoch_us(min(order_purchase_timestamp)) AS lo, epoch_us(max(order_purchase_timestamp)) AS hi FROM master),
cutoff AS (SELECT make_timestamp(CAST(hi - floor((hi - lo) * 0.2) AS BIGINT)) AS t FROM span),
train AS (SELECT master.* FROM master, cutoff WHERE order_purchase_timestamp < t)"""


@query("K7_cold_start", with_base(f"""{_HOLDOUT}{_RECO}
, late AS (SELECT DISTINCT customer_unique_id FROM fs WHERE customer_unique_id NOT IN (SELECT customer_unique_id FROM train))
SELECT late.customer_unique_id, t.product_id, t.category, t.avg_price, t.rec_rank,
       'Top Trending Recommendation (New Customer Cold-Start Fallback)' AS explanation
FROM late, trend t"""))
def k7(spark, sf):
    """Cold start for the customers whose first purchase lies in the hold-out time."""
    j = _j(spark, sf)
    warm = j.r.items.where(F.col("order_purchase_timestamp").cast("timestamp") < K.holdout_cut(j.r.items))
    return K.cold_start(j.r.feature_store, warm, j.popularity, 5).select(
        "customer_unique_id", "product_id", "category", "avg_price", "rec_rank", "explanation")


@query("K8_similar_products", with_base(f"""{_RECO}
SELECT product_id, neighbour_id AS similar_product_id, {R('sim', 6)} AS similarity_score, rank FROM near WHERE rank <= 5"""))
def k8(spark, sf):
    return K.similar_products(_j(spark, sf).neighbours, 5)


@query("K9_cross_sell_list", with_base(f"""{_RECO}
SELECT product_id, total_units, {R('avg_rating', 6)} AS avg_rating FROM pop
ORDER BY total_units DESC, avg_rating DESC, product_id LIMIT 50"""))
def k9(spark, sf):
    cross, _ = K.cross_and_up_sell(_j(spark, sf).popularity, 50)
    return rounded(cross.select("product_id", "total_units", "avg_rating"), {"avg_rating": 6})


@query("K9_up_sell_list", with_base(f"""{_RECO}
SELECT product_id, {R('avg_price', 6)} AS avg_price FROM pop ORDER BY avg_price DESC, product_id LIMIT 50"""))
def k9_up(spark, sf):
    _, up = K.cross_and_up_sell(_j(spark, sf).popularity, 50)
    return rounded(up.select("product_id", "avg_price"), {"avg_price": 6})


@query("K11_reco_kpis", with_base(f"""{_RECO}
SELECT count(*) AS total_recommendations, count(DISTINCT customer_unique_id) AS customers,
       {R('count(*) / greatest(count(DISTINCT customer_unique_id), 1)', 6)} AS avg_per_customer,
       {R('count(DISTINCT product_id) / (SELECT count(DISTINCT product_id) FROM pop) * 100.0', 6)} AS catalog_coverage_pct,
       count(DISTINCT category) AS category_diversity,
       (SELECT CAST(product_id AS VARCHAR) FROM recs GROUP BY product_id ORDER BY count(*) DESC, product_id LIMIT 1)
         AS most_recommended_product,
       (SELECT category FROM recs GROUP BY category ORDER BY count(*) DESC, category LIMIT 1)
         AS most_recommended_category
FROM recs"""))
def k11(spark, sf):
    j = _j(spark, sf)
    return rounded(K.reco_kpis(j.recommendations, j.popularity), {"avg_per_customer": 6, "catalog_coverage_pct": 6})


@query("K12_customer_context", with_base(f"""
, cc AS (SELECT customer_unique_id, product_category_name_english AS c, count(*) AS n FROM master
         WHERE product_category_name_english IS NOT NULL GROUP BY 1, 2),
fav AS (SELECT customer_unique_id, string_agg(c, ', ' ORDER BY r) AS favourite_categories FROM (
          SELECT *, row_number() OVER (PARTITION BY customer_unique_id ORDER BY n DESC, c) AS r FROM cc) WHERE r <= 3
        GROUP BY 1)
SELECT fs.customer_unique_id, total_orders, total_spending, {R('recency_days', 4)} AS recency_days, rfm_segment,
       favourite_categories FROM fs LEFT JOIN fav USING (customer_unique_id)"""))
def k12(spark, sf):
    r = retail(spark, sf)
    return rounded(K.customer_context(r.feature_store, r.items), {"recency_days": 4})


@query("K13_product_profile", with_base(f"""{_RECO}
, s AS (SELECT product_id, string_agg(CAST(neighbour_id AS VARCHAR), ', ' ORDER BY rank) AS similar_products
        FROM near WHERE rank <= 5 GROUP BY 1)
SELECT pop.product_id, product_category_name_english, total_units, total_revenue, {R('avg_price', 6)} AS avg_price,
       {R('avg_rating', 6)} AS avg_rating, similar_products
FROM pop LEFT JOIN s USING (product_id) WHERE contains(CAST(pop.product_id AS VARCHAR), '42')"""))
def k13(spark, sf):
    j = _j(spark, sf)
    return rounded(K.product_profiles(j.popularity, j.neighbours, "42"), {"avg_price": 6, "avg_rating": 6})


@query("K16_business_modes", with_base(f"""{_RECO}
SELECT (SELECT category FROM recs GROUP BY category ORDER BY count(*) DESC, category LIMIT 1)
         AS most_recommended_category,
       (SELECT product_id FROM recs GROUP BY product_id ORDER BY count(*) DESC, product_id LIMIT 1)
         AS most_recommended_product,
       (SELECT product_category_name_english FROM pop ORDER BY total_units DESC, avg_rating DESC, product_id LIMIT 1)
         AS top_trending_category"""))
def k16(spark, sf):
    j = _j(spark, sf)
    return K.business_modes(j.recommendations, j.popularity)


_CONTEXT = f"""{_RECO}
, churn AS (SELECT customer_unique_id, least(greatest(recency_days / 180.0, 0.05), 0.95) AS p FROM fs),
risk AS (SELECT customer_unique_id, CASE WHEN p >= 0.8 THEN 'Critical' WHEN p >= 0.6 THEN 'High'
                WHEN p >= 0.4 THEN 'Medium'
                WHEN p >= 0.2 THEN 'Low' ELSE 'Very Low' END AS risk_level FROM churn),
value AS (SELECT customer_unique_id, greatest(total_spending + purchase_frequency_monthly * avg_order_value * 12.0, 0.0) AS v FROM fs),
cuts AS (SELECT quantile_cont(v, [0.5, 0.8, 0.95]) AS q FROM value),
tier AS (SELECT customer_unique_id, CASE WHEN v >= q[3] THEN 'Platinum (Top 5%)' WHEN v >= q[2] THEN 'Gold (Top 20%)'
                WHEN v >= q[1] THEN 'Silver (Top 50%)' WHEN v > 0 THEN 'Bronze' ELSE 'Low Value' END AS clv_value_tier FROM value, cuts),
known AS (SELECT recs.*, clv_value_tier, risk_level FROM recs JOIN tier USING (customer_unique_id) JOIN risk USING (customer_unique_id))"""


def _context(j):
    return K.customer_context(j.r.feature_store, j.r.items, j.clv_frame, j.scored)


@query("K14_opportunity_matrix", with_base(f"""{_CONTEXT}
SELECT DISTINCT customer_unique_id, product_id, category, recommendation_type, {R('hybrid_score', 6)} AS hybrid_score,
       clv_value_tier, risk_level,
       CASE WHEN risk_level IN ('Critical', 'High') THEN 'P1 - At-Risk Retention Target'
            WHEN clv_value_tier LIKE 'Platinum%' OR clv_value_tier LIKE 'Gold%' THEN 'P2 - VIP Cross-Sell Expansion'
            WHEN recommendation_type LIKE '%upsell%' THEN 'P3 - High Value Upsell'
            ELSE 'P4 - Standard Personalization' END AS priority
FROM known"""))
def k14(spark, sf):
    j = _j(spark, sf)
    return rounded(K.opportunity_matrix(j.recommendations, _context(j)), {"hybrid_score": 6})


@query("K15_filtered_recommendations", with_base(f"""{_RECO}
SELECT customer_unique_id, product_id, category, {R('hybrid_score', 6)} AS hybrid_score FROM recs
WHERE category IN ('brand_1', 'brand_2', 'brand_3') AND hybrid_score >= 1.0"""))
def k15(spark, sf):
    f = K.filter_recommendations(_j(spark, sf).recommendations, categories=["brand_1", "brand_2", "brand_3"],
                                 min_score=1.0)
    return rounded(f.select("customer_unique_id", "product_id", "category", "hybrid_score"), {"hybrid_score": 6})


@query("K15_recommendations_by_tier_and_risk", with_base(f"""{_CONTEXT}
SELECT customer_unique_id, product_id, clv_value_tier, risk_level, {R('hybrid_score', 6)} AS hybrid_score FROM known
WHERE clv_value_tier IN ('Gold (Top 20%)', 'Platinum (Top 5%)') AND risk_level IN ('High', 'Critical') AND recommendation_type = 'hybrid'"""))
def k15_context(spark, sf):
    j = _j(spark, sf)
    f = K.filter_recommendations(j.recommendations, _context(j), tiers=["Gold (Top 20%)", "Platinum (Top 5%)"],
                                 risks=["High", "Critical"], types=["hybrid"])
    return rounded(f.select("customer_unique_id", "product_id", "clv_value_tier", "risk_level", "hybrid_score"), {"hybrid_score": 6})


@query("K17_ranking_evaluation", with_base(f"""{_HOLDOUT}{_reco("train", 10)}
, truth AS (SELECT DISTINCT customer_unique_id, product_id FROM master, cutoff WHERE order_purchase_timestamp >= t),
relevant AS (SELECT customer_unique_id, count(*) AS relevant FROM truth GROUP BY 1),
hits AS (SELECT hrec.customer_unique_id, rec_rank, CASE WHEN truth.product_id IS NULL THEN 0 ELSE 1 END AS hit
         FROM hrec LEFT JOIN truth ON truth.customer_unique_id = hrec.customer_unique_id AND truth.product_id = hrec.product_id),
ranked AS (SELECT *, sum(hit) OVER (PARTITION BY customer_unique_id ORDER BY rec_rank) AS found FROM hits),
per AS (SELECT customer_unique_id, sum(hit) AS hits, sum(hit * found / rec_rank) AS ap FROM ranked GROUP BY 1)
SELECT count(*) AS customers_evaluated, {R('avg(hits / 10)', 8)} AS precision_at_k, {R('avg(hits / relevant)', 8)} AS recall_at_k,
       {R('avg(ap / least(relevant, 10))', 8)} AS map_at_k,
       {R('(SELECT count(DISTINCT product_id) FROM hrec) / (SELECT count(DISTINCT product_id) FROM pop) * 100.0', 6)} AS catalog_coverage_pct
FROM per JOIN relevant USING (customer_unique_id)"""))
def k17(spark, sf):
    r = retail(spark, sf)
    return rounded(K.ranking_evaluation(r.items, 10, cut=written_table), {"precision_at_k": 8, "recall_at_k": 8, "map_at_k": 8, "catalog_coverage_pct": 6})


@query("M20_dashboard_payload_sizes")
def m20(spark, sf):
    from functools import reduce

    from pyspark.sql import DataFrame

    from orbitcart.operators.executive import dashboard_payload
    r = retail(spark, sf)
    p = dashboard_payload(r.master, r.feature_store, start="1996-01-01", end="2000-12-31")
    parts = [df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(k).alias("table_name"), "row_count")
             for k, df in p.items()]
    return reduce(DataFrame.unionByName, parts)
