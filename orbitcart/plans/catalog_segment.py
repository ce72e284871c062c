"""Registered queries: segmentation (H). Model outputs are rows-only checks; the segment
profile operators are also registered keyed on the RFM segment, where SQL can check them."""

from __future__ import annotations

from orbitcart.operators import segment as H
from orbitcart.plans.jobs import DENSITY_EPS, DENSITY_FEATURES, jobs
from orbitcart.plans.oracle import MSUM, R, with_base
from orbitcart.plans.pipeline import retail
from orbitcart.plans.registry import query, rounded


def _j(spark, sf):
    return jobs(spark, sf)


@query("H3_pca_projection")
def h3(spark, sf):
    return _j(spark, sf).seg_prepared[1].select("customer_unique_id", "pca_x", "pca_y", "pca_z")


@query("H4_k_selection")
def h4(spark, sf):
    k, scores = _j(spark, sf).seg_k
    return spark.createDataFrame([(kk, float(v), kk == k) for kk, v in scores], "k int, silhouette double, chosen boolean")


_Z = ", ".join(f"{R(f'({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER ()', 6)} AS x{i}" for i, c in enumerate(DENSITY_FEATURES))


@query("H8_density_clusters", with_base(f"""
, pts AS (SELECT customer_unique_id AS id, {_Z} FROM fs),
near AS (SELECT p.id AS a, q.id AS b FROM pts p, pts q
         WHERE (p.x0 - q.x0) * (p.x0 - q.x0) + (p.x1 - q.x1) * (p.x1 - q.x1) + (p.x2 - q.x2) * (p.x2 - q.x2) <= {DENSITY_EPS} * {DENSITY_EPS}),
core AS (SELECT a AS id FROM near GROUP BY 1 HAVING count(*) >= 5),
edges AS (SELECT a, b FROM near WHERE a IN (SELECT id FROM core) AND b IN (SELECT id FROM core) AND a <> b),
reach(id, label) USING KEY (id) AS (
    SELECT id, id AS label FROM core
    UNION
    SELECT e.b, min(reach.label) FROM reach JOIN edges e ON e.a = reach.id JOIN recurring.reach r ON r.id = e.b
    WHERE reach.label < r.label GROUP BY e.b),
border AS (SELECT a AS id, min(label) AS label FROM near JOIN reach ON reach.id = near.b WHERE a NOT IN (SELECT id FROM core) GROUP BY 1)
SELECT id AS customer_unique_id, coalesce(reach.label, border.label, -1) AS label, reach.id IS NOT NULL AS is_core
FROM pts LEFT JOIN reach USING (id) LEFT JOIN border USING (id)""", recursive=True))
def h8(spark, sf):
    return _j(spark, sf).dense_features


@query("H8_density_clusters_pca")
def h8_pca(spark, sf):
    return _j(spark, sf).dense_pca


@query("H10_model_benchmark")
def h10(spark, sf):
    return _j(spark, sf).clusters[2]


@query("H11_cluster_personas")
def h11(spark, sf):
    _, df, _ = _j(spark, sf).clusters
    return H.personas(H.cluster_summary(df))


@query("H13_cluster_overview")
def h13(spark, sf):
    return H.segment_overview(_j(spark, sf).clusters[1], "persona_title")


@query("H14_cluster_details")
def h14(spark, sf):
    j = _j(spark, sf)
    return H.segment_details(j.clusters[1], j.r.master, "persona_title")


@query("H15_pca_sample")
def h15(spark, sf):
    return H.pca_sample(_j(spark, sf).clusters[1], 500)


_ROUND6 = {"avg_spending": 6, "avg_orders": 6, "avg_recency": 6, "avg_clv": 6}


@query("H13_segment_overview_rfm", with_base(f"""
SELECT rfm_segment AS segment, count(*) AS customers, {MSUM('total_spending')} AS total_revenue,
       {R('avg(total_spending)', 6)} AS avg_spending, {R('avg(total_orders)', 6)} AS avg_orders,
       {R('avg(recency_days)', 6)} AS avg_recency, {R('avg(historical_clv)', 6)} AS avg_clv FROM fs GROUP BY 1"""))
def h13_rfm(spark, sf):
    return rounded(H.segment_overview(retail(spark, sf).feature_store, "rfm_segment"), _ROUND6)


@query("H14_segment_details_rfm", with_base(f"""
, base AS (SELECT rfm_segment AS segment, count(*) AS customers, {MSUM('total_spending')} AS total_revenue,
                  {R('avg(total_orders)', 6)} AS avg_orders, {R('avg(avg_order_value)', 6)} AS avg_aov,
                  {R('avg(avg_review_score_given)', 6)} AS avg_csat, {R('avg(historical_clv)', 6)} AS avg_clv,
                  {R('avg(churn_label) * 100.0', 6)} AS churn_pct FROM fs GROUP BY 1),
m AS (SELECT master.*, fs.rfm_segment AS segment FROM master JOIN fs USING (customer_unique_id)),
tc AS (SELECT segment, string_agg(c, ', ' ORDER BY r) AS top_categories FROM (
         SELECT segment, product_category_name_english AS c,
                row_number() OVER (PARTITION BY segment ORDER BY count(*) DESC, product_category_name_english) AS r
         FROM m WHERE product_category_name_english IS NOT NULL GROUP BY segment, product_category_name_english)
       WHERE r <= 3 GROUP BY 1),
ts AS (SELECT segment, string_agg(c, ', ' ORDER BY r) AS top_states FROM (
         SELECT segment, customer_state AS c,
                row_number() OVER (PARTITION BY segment ORDER BY count(*) DESC, customer_state) AS r
         FROM m WHERE customer_state IS NOT NULL GROUP BY segment, customer_state) WHERE r <= 3 GROUP BY 1),
tp AS (SELECT segment, preferred_payment_type AS top_payment FROM (
         SELECT segment, preferred_payment_type,
                row_number() OVER (PARTITION BY segment ORDER BY count(*) DESC, preferred_payment_type) AS r
         FROM m GROUP BY segment, preferred_payment_type) WHERE r = 1)
SELECT * FROM base LEFT JOIN tc USING (segment) LEFT JOIN ts USING (segment) LEFT JOIN tp USING (segment)"""))
def h14_rfm(spark, sf):
    r = retail(spark, sf)
    return rounded(H.segment_details(r.feature_store, r.master, "rfm_segment"),
                   {"avg_orders": 6, "avg_aov": 6, "avg_csat": 6, "avg_clv": 6, "churn_pct": 6})


_H16 = ["avg_spending", "avg_orders", "avg_aov", "avg_recency", "avg_clv", "avg_review", "avg_loyalty", "churn_pct"]


@query("H16_comparison_matrix_rfm", with_base(f"""
SELECT rfm_segment AS segment, {R('avg(total_spending)', 6)} AS avg_spending, {R('avg(total_orders)', 6)} AS avg_orders,
       {R('avg(avg_order_value)', 6)} AS avg_aov, {R('avg(recency_days)', 6)} AS avg_recency,
       {R('avg(historical_clv)', 6)} AS avg_clv, {R('avg(avg_review_score_given)', 6)} AS avg_review,
       {R('avg(loyalty_score)', 6)} AS avg_loyalty, {R('avg(churn_label) * 100.0', 6)} AS churn_pct FROM fs GROUP BY 1"""))
def h16(spark, sf):
    return rounded(H.comparison_matrix(retail(spark, sf).feature_store, "rfm_segment"), {c: 6 for c in _H16})


def _h17_sql() -> str:
    vip, loyal, risk = (", ".join("'" + x.replace("'", "''") + "'" for x in lab)
                        for lab in (H.VIP_LABELS, H.LOYAL_LABELS, H.AT_RISK_LABELS))

    def scoped(s, flt):
        w = f" FILTER (WHERE {flt})" if flt else ""
        a = f"{flt} AND " if flt else ""
        return (f"count(DISTINCT rfm_segment){w} AS segments_{s}, count(*){w} AS customers_{s}, "
                f"count(*) FILTER (WHERE {a}rfm_segment IN ({vip})) AS vip_customers_{s}, "
                f"count(*) FILTER (WHERE {a}rfm_segment IN ({loyal})) AS loyal_customers_{s}, "
                f"count(*) FILTER (WHERE {a}rfm_segment IN ({risk})) AS at_risk_customers_{s}, "
                f"coalesce(sum(total_spending){w} / count(DISTINCT rfm_segment){w}, 0.0) AS avg_segment_revenue_{s}, "
                f"coalesce(avg((recency_score + frequency_score + monetary_score) / 3.0){w}, 0.0) AS avg_rfm_score_{s}")
    names = ["segments", "customers", "vip_customers", "loyal_customers", "at_risk_customers", "avg_segment_revenue",
             "avg_rfm_score"]
    rows = "\nUNION ALL ".join(f"SELECT '{n}' AS kpi, CAST({n}_t AS DOUBLE) AS total, CAST({n}_c AS DOUBLE) AS current, "
                               f"CAST({n}_p AS DOUBLE) AS previous FROM w" for n in names)
    return with_base(f"""
, b AS (SELECT epoch_us(min(last_purchase_date)) AS lo, epoch_us(max(last_purchase_date)) AS hi FROM fs),
m AS (SELECT fs.*, last_purchase_date >= make_timestamp(CAST(lo + floor((hi - lo) / 2) AS BIGINT)) AS cur FROM fs, b),
w AS (SELECT {scoped('t', '')}, {scoped('c', 'cur')}, {scoped('p', 'NOT cur')} FROM m),
long AS ({rows})
SELECT kpi, {R('total', 4)} AS total, {R('current', 4)} AS current, {R('previous', 4)} AS previous,
       {R("CASE WHEN previous = 0 OR previous IS NULL THEN 0.0 ELSE abs((current - previous) / abs(previous) * 100.0) END", 3)} AS change_pct,
       CASE WHEN previous = 0 OR previous IS NULL THEN true ELSE current >= previous END AS is_positive
FROM long""")


@query("H17_segmentation_kpis", _h17_sql())
def h17(spark, sf):
    return rounded(H.segmentation_kpis(retail(spark, sf).feature_store, "rfm_segment"),
                   {"total": 4, "current": 4, "previous": 4, "change_pct": 3})


@query("H17_largest_segment", with_base("""
SELECT rfm_segment, count(*) AS count FROM fs GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1"""))
def h17_largest(spark, sf):
    return H.largest_segment(retail(spark, sf).feature_store)


@query("H18_customer_profile_search", with_base(f"""
SELECT 'customer' AS match_type, CAST(customer_unique_id AS VARCHAR) AS match_key, 1 AS customers, total_spending
FROM fs WHERE contains(CAST(customer_unique_id AS VARCHAR), '77')"""))
def h18_customer(spark, sf):
    return H.search_segment_profile(retail(spark, sf).feature_store, "77", "rfm_segment")


@query("H18_segment_profile_search", with_base(f"""
SELECT 'segment' AS match_type, rfm_segment AS match_key, count(*) AS customers, {MSUM('total_spending')} AS total_spending
FROM fs WHERE contains(lower(rfm_segment), 'loyal') GROUP BY rfm_segment"""))
def h18(spark, sf):
    return H.search_segment_profile(retail(spark, sf).feature_store, "Loyal", "rfm_segment")
