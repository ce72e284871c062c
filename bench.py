"""Benchmark: time the ETL and each dashboard page payload on one dataset.

Prints one JSON line: {"metric", "value", "unit", "queries": {name: seconds}, "sf"}.
A "page" is the set of registered queries one reference page computes; the reference

env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8)
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from orbitcart.plans.jobs import jobs  # noqa: E402
from orbitcart.plans.pipeline import retail  # noqa: E402
from orbitcart.plans.registry import all_queries  # noqa: E402
from orbitcart.session import get_session  # noqa: E402

JOBS = {
    "job_churn_scoring": lambda j: j.scored.count(),
    "job_clv_scoring": lambda j: j.clv_frame.count(),
    "job_market_basket": lambda j: j.rules.count(),
    "job_recommender": lambda j: j.recommendations.count(),
    "job_segmentation": lambda j: j.clusters[1].count(),
    "job_train_churn": lambda j: j.churn_model,
    "job_train_clv": lambda j: j.clv_model,
}

PAGES = {
    "executive_page": ["M1_revenue_trend_monthly", "M2_customer_growth", "M3_revenue_by_category",
                       "M4_revenue_by_state", "M5_payment_distribution", "M6_order_status_distribution",
                       "M7_top_products", "M8_ratings_histogram", "M9_business_insights", "M10_executive_summary",
                       "M11_executive_kpis", "M18_filter_options"],
    "customer_page": ["N1_customer_kpis", "N2_state_distribution", "N3_top_cities", "N4_geographic_treemap_rollup",
                      "N5_frequency_distribution", "N6_diversity_distribution", "N8_spend_tiers", "N9_loyalty_tiers",
                      "N10_loyalty_histogram", "N11_loyalty_trend", "N12_top_customers", "N13_pareto_curve",
                      "N14_revenue_bands", "N15_recency_distribution", "N16_recently_active",
                      "N17_dormant_customers", "N19_customer_insights"],
    "segmentation_page": ["G4_priority_ranking", "G5_segment_summary", "G6_score_distribution", "G7_rf_heatmap",
                          "G8_segment_distribution", "H11_cluster_personas", "H13_cluster_overview",
                          "H17_segmentation_kpis"],
    "churn_page": ["I9_risk_tiers", "I12_risk_distribution", "I13_churn_kpis", "I14_churn_attributions",
                   "I19_retention_targets"],
    "clv_page": ["J7_value_tiers", "J12_tier_matrix", "J13_clv_kpis", "J14_revenue_forecast_monthly",
                 "J15_top100_leaderboard", "J16_clv_pareto"],
    "recommendation_page": ["K1_popularity", "K6_hybrid_recommendations", "K8_similar_products", "K11_reco_kpis"],
    "market_basket_page": ["L2_frequent_itemsets", "L5_association_rules", "L6_bundles", "L12_cooccurrence",
                           "L13_seasonal_baskets", "L15_basket_kpis"],
    "sales_product_pages": ["O1_revenue_by_payment_type", "O2_revenue_by_season", "O3_category_state_revenue",
                            "O4_category_pareto", "O5_top_products_units", "O6_top_rated_categories",
                            "O7_seller_leaderboard", "O9_logistics_kpis", "O10_delivery_box_stats",
                            "O12_review_kpis", "O14_bi_measures"],
    "streams": ["T1_windowed_telemetry_stream", "T2_ingest_stream", "T4_activity_sessions"],
}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = get_session("orbitcart-bench", f"local[{cpus}]", shuffle_partitions=cpus,
                        extra={"spark.driver.memory": "16g"})
    qs = all_queries()
    times: dict[str, float] = {}

    t0 = time.perf_counter()
    r = retail(spark, sf_dir)
    r.master.count()          # clean + join + persist
    r.order_facts.count()     # one row per order (persisted), read by order-level page queries
    r.feature_store.count()   # features + labels (checkpointed)
    times["etl_feature_store"] = round(time.perf_counter() - t0, 3)

    # batch jobs whose outputs the pages read (the reference precomputes these in run_* jobs)
    j = jobs(spark, sf_dir)
    for name, build in JOBS.items():
        t = time.perf_counter()
        build(j)
        times[name] = round(time.perf_counter() - t, 3)

    for page, names in PAGES.items():
        present = [n for n in names if n in qs]
        if not present:
            continue
        t = time.perf_counter()
        for n in present:
            qs[n](spark, sf_dir).collect()
        times[page] = round(time.perf_counter() - t, 3)

    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "etl_plus_page_payloads_total", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": float(m.group(1)) if m else sf_dir}))
    spark.stop()


if __name__ == "__main__":
    main()
