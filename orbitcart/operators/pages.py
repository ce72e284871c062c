"""O — sales, product, seller, logistics and review page queries over the master."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbitcart.functions.columns import money_sum
from orbitcart.functions.ordering import with_global_running_sum
from orbitcart.operators.executive import KEY
from orbitcart.operators.features import order_features

CAT = "product_category_name_english"


def revenue_by_payment_type(master: DataFrame) -> DataFrame:
    """O1 revenue per payment type."""
    return master.groupBy("preferred_payment_type").agg(money_sum("price").alias("revenue"))


def revenue_by_season(master: DataFrame) -> DataFrame:
    """O2 revenue per (southern-hemisphere) season of the purchase month."""
    return order_features(master).groupBy("season").agg(money_sum("price").alias("revenue"))


def top_categories_by_rows(master: DataFrame, n: int = 10) -> DataFrame:
    """The n categories with most item rows (ties by name): at most n rows."""
    return (master.where(F.col(CAT).isNotNull()).groupBy(CAT).count()
                  .orderBy(F.desc("count"), CAT).limit(n).select(CAT))


def category_state_revenue(master: DataFrame, n: int = 10, totals: str | None = None) -> DataFrame:
    """O3 revenue per (category, customer state) for the n most frequent categories;
    ``totals='rollup'|'cube'`` adds subtotal rows."""
    top = top_categories_by_rows(master, n)
    m = master.join(F.broadcast(top), CAT, "left_semi")  # n rows: bounded broadcast
    g = {"rollup": m.rollup, "cube": m.cube}.get(totals or "", m.groupBy)(CAT, "customer_state")
    return g.agg(money_sum("price").alias("revenue"))


def category_pareto(master: DataFrame) -> DataFrame:
    """O4 categories by revenue descending with cumulative revenue share (Q17 fixed)."""
    cats = master.where(F.col(CAT).isNotNull()).groupBy(CAT).agg(money_sum("price").alias("revenue"))
    total = cats.agg(F.sum("revenue")).scalar()
    ranked = with_global_running_sum(cats, [F.desc("revenue"), F.asc(CAT)],
                                     {"rank": F.lit(1).cast("long"), "cum_revenue": F.col("revenue")})
    return ranked.withColumn("cumulative_pct", F.col("cum_revenue") / total * 100.0)


def top_products_units(master: DataFrame, n: int = 10) -> DataFrame:
    """O5 top-n products by revenue, with units sold."""
    agg = master.groupBy("product_id").agg(F.count("order_item_id").alias("units_sold"),
                                           money_sum("price").alias("revenue"))
    return agg.orderBy(F.desc("revenue"), "product_id").limit(n)


def top_rated_categories(master: DataFrame, n: int = 10) -> DataFrame:
    """O6 top-n categories by mean rating, with item count."""
    agg = master.where(F.col(CAT).isNotNull()).groupBy(CAT).agg(
        F.avg("avg_review_score").alias("avg_rating"), F.count("order_item_id").alias("total_sales"))
    return agg.orderBy(F.desc("avg_rating"), CAT).limit(n)


def seller_table(master: DataFrame) -> DataFrame:
    return master.groupBy("seller_id").agg(
        money_sum("price").alias("total_revenue"), F.countDistinct("order_id").alias("total_orders"),
        F.avg("avg_review_score").alias("avg_seller_rating"), F.min("seller_state").alias("seller_state"))


def seller_leaderboard(master: DataFrame, n: int = 10) -> DataFrame:
    """O7 top-n sellers by revenue."""
    return seller_table(master).orderBy(F.desc("total_revenue"), "seller_id").limit(n)


def seller_kpis(master: DataFrame) -> DataFrame:
    """O7 active sellers, mean revenue per seller, mean seller rating."""
    return seller_table(master).agg(F.count(F.lit(1)).alias("active_sellers"),
                                    F.avg("total_revenue").alias("avg_revenue_per_seller"),
                                    F.avg("avg_seller_rating").alias("avg_seller_rating"))


def sellers_per_state(master: DataFrame, n: int = 8) -> DataFrame:
    """O8 sellers per state, top n (ties by state)."""
    return (seller_table(master).groupBy("seller_state").agg(F.count(F.lit(1)).alias("seller_count"))
            .orderBy(F.desc("seller_count"), "seller_state").limit(n))


def logistics_kpis(master: DataFrame) -> DataFrame:
    """O9 mean delivery days, delayed %, mean freight ratio %, total freight."""
    of = order_features(master)
    return of.agg(F.avg("delivery_time_days").alias("avg_delivery_days"),
                  (F.avg("is_delayed") * 100.0).alias("delayed_pct"),
                  (F.avg("shipping_cost_ratio") * 100.0).alias("avg_freight_ratio_pct"),
                  money_sum("freight_value").alias("total_freight"))


def delivery_box_stats(master: DataFrame, n_states: int = 8) -> DataFrame:
    """O10 min / quartiles / max of delivery days for the n busiest customer states.

    ``percentile`` keeps a value->count map per group; delivery days have few distinct
    values, and partial aggregation merges the maps map-side, so a hot state stays cheap.
    """
    of = order_features(master)
    top = (of.where(F.col("customer_state").isNotNull()).groupBy("customer_state").count()
             .orderBy(F.desc("count"), "customer_state").limit(n_states).select("customer_state"))
    sub = of.join(F.broadcast(top), "customer_state", "left_semi")  # n_states rows
    q = F.percentile("delivery_time_days", [0.0, 0.25, 0.5, 0.75, 1.0])
    agg = sub.where(F.col("delivery_time_days").isNotNull()).groupBy("customer_state").agg(q.alias("q"))
    return agg.select("customer_state", F.col("q")[0].alias("min_days"), F.col("q")[1].alias("q1_days"),
                      F.col("q")[2].alias("median_days"), F.col("q")[3].alias("q3_days"),
                      F.col("q")[4].alias("max_days"))


def review_kpis(master: DataFrame) -> DataFrame:
    """O12 mean rating, share of 5-star rows %, share of <=2-star rows %."""
    s = F.col("avg_review_score")
    return master.agg(F.avg(s).alias("csat"), (F.avg((s == 5).cast("double")) * 100.0).alias("five_star_pct"),
                      (F.avg((s <= 2).cast("double")) * 100.0).alias("low_score_pct"))


def rounded_rating_counts(master: DataFrame) -> DataFrame:
    """O13 rows per rating rounded half-to-even."""
    return master.where(F.col("avg_review_score").isNotNull()) \
                 .groupBy(F.bround("avg_review_score", 0).alias("review_score")).count()


def category_rating_radar(master: DataFrame, n: int | None = None) -> DataFrame:
    """O13 mean rating of every category; ``n`` gives the first n in name order."""
    agg = master.where(F.col(CAT).isNotNull()).groupBy(CAT).agg(F.avg("avg_review_score").alias("avg_rating"))
    return agg.orderBy(CAT).limit(n) if n is not None else agg


def bi_measures(master: DataFrame) -> DataFrame:
    """O14 revenue, distinct orders, AOV, repeat buyers (>1 order) and repeat rate %."""
    per = master.groupBy(KEY, "order_id").agg(money_sum("price").alias("rev"))
    per_c = per.groupBy(KEY).agg(money_sum("rev").alias("rev"), F.count(F.lit(1)).alias("o"))
    t = per_c.agg(money_sum("rev").alias("revenue"), F.sum("o").alias("orders"),
                  F.count_if(F.col("o") > 1).alias("repeat_buyers"), F.count(F.lit(1)).alias("customers"))
    return t.select("revenue", "orders", (F.col("revenue") / F.greatest(F.col("orders"), F.lit(1))).alias("aov"),
                    "repeat_buyers",
                    (F.col("repeat_buyers") / F.greatest(F.col("customers"), F.lit(1)) * 100.0).alias("repeat_rate_pct"))
