"""E — feature engineering: order/line, customer, product and seller features."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbitcart.functions.columns import days_between, money_avg, money_sum, safe_div, when_chain

CUSTOMER_KEY = "customer_unique_id"


def snapshot_date(master: DataFrame, snapshot: datetime | str | None = None) -> Column:
    """E0 snapshot = latest purchase + 1 day unless given (a lazily evaluated scalar)."""
    if snapshot is not None:
        return F.lit(snapshot).cast("timestamp")
    return master.agg(F.max("order_purchase_timestamp") + F.expr("INTERVAL 1 DAY")).scalar()


def season(month: Column) -> Column:
    """Southern-hemisphere season of a month number."""
    return when_chain([(month.isin(12, 1, 2), "Summer"), (month.isin(3, 4, 5), "Autumn"),
                       (month.isin(6, 7, 8), "Winter")], "Spring")


def order_features(master: DataFrame) -> DataFrame:
    """E1 per-line delivery, delay, freight ratio and calendar features."""
    ts = F.col("order_purchase_timestamp")
    total = F.col("price") + F.col("freight_value")
    cols = {}
    if "order_delivered_customer_date" in master.columns:
        cols["delivery_time_days"] = F.greatest(days_between("order_delivered_customer_date", ts), F.lit(0.0))
        if "order_estimated_delivery_date" in master.columns:
            delay = days_between("order_delivered_customer_date", "order_estimated_delivery_date")
            cols["delivery_delay_days"] = delay
            cols["is_delayed"] = F.coalesce((delay > 0).cast("int"), F.lit(0))
    cols["shipping_cost_ratio"] = F.when(total > 0, F.col("freight_value") / total).otherwise(F.lit(0.0))
    cols["purchase_year"] = F.year(ts)
    cols["purchase_month"] = F.month(ts)
    cols["purchase_quarter"] = F.quarter(ts)
    cols["day_of_week"] = F.weekday(ts)
    out = master.withColumns(cols)
    return out.withColumns({"is_weekend": F.col("day_of_week").isin(5, 6).cast("int"),
                            "season": season(F.col("purchase_month"))})


def customer_features(master: DataFrame, snapshot: Column | None = None) -> DataFrame:
    """E2 + E3 one row per customer_unique_id.

    Built as item -> order -> customer pre-aggregation (no ``count(distinct)`` Expand over the
    item rows): orders per customer are the order-level rows; distinct categories come from a
    (customer, category) aggregation; the preferred payment (mode over item rows, smallest on
    ties) from item counts per (customer, type) — each group there is bounded by the number of
    payment types. "First" state/city are those of the earliest purchase (ties by order, item).
    """
    snap = snapshot if snapshot is not None else snapshot_date(master)
    ts = "order_purchase_timestamp"
    first_of_order = F.struct(ts, "order_item_id")
    per_order = master.groupBy(CUSTOMER_KEY, "order_id").agg(
        F.count("order_item_id").alias("n_items"), money_sum("price").alias("spend"),
        money_sum("freight_value").alias("freight"), F.sum("avg_review_score").alias("rs"),
        F.count("avg_review_score").alias("rc"), F.count("price").alias("pc"),
        F.min(ts).alias("ts_min"), F.max(ts).alias("ts_max"),
        F.min_by(F.struct("customer_state", "customer_city"), first_of_order).alias("loc"),
        F.min(F.struct(ts, "order_item_id")).alias("first_key"))
    agg = per_order.groupBy(CUSTOMER_KEY).agg(
        F.count(F.lit(1)).alias("total_orders"),
        F.sum("n_items").alias("total_items_purchased"),
        money_sum("spend").alias("total_spending"),
        money_sum("freight").alias("total_freight_paid"),
        (money_sum("spend") / F.sum("pc")).alias("avg_order_value"),
        F.round(F.sum("rs") / F.sum("rc"), 10).alias("avg_review_score_given"),  # stable across partitionings
        F.min("ts_min").alias("first_purchase_date"),
        F.max("ts_max").alias("last_purchase_date"),
        F.min_by("loc", F.struct(F.col("first_key"), F.col("order_id"))).alias("loc"))
    cats = (master.where(F.col("product_category_name_english").isNotNull())
                  .groupBy(CUSTOMER_KEY, "product_category_name_english").agg(F.count(F.lit(1)).alias("c"))
                  .groupBy(CUSTOMER_KEY).agg(F.count(F.lit(1)).alias("distinct_categories_count")))
    pay = (master.where(F.col("preferred_payment_type").isNotNull())
                 .groupBy(CUSTOMER_KEY, "preferred_payment_type").agg(F.count(F.lit(1)).alias("c"))
                 .groupBy(CUSTOMER_KEY).agg(
                     F.sort_array(F.collect_list(F.struct((-F.col("c")).alias("neg"), "preferred_payment_type")))
                     [0]["preferred_payment_type"].alias("preferred_payment_method")))
    agg = (agg.join(cats, CUSTOMER_KEY, "left").join(pay, CUSTOMER_KEY, "left")
              .withColumn("distinct_categories_count", F.coalesce("distinct_categories_count", F.lit(0)).cast("long"))
              .select(CUSTOMER_KEY, "total_orders", "total_items_purchased", "total_spending", "total_freight_paid",
                      "avg_order_value", "avg_review_score_given", "first_purchase_date", "last_purchase_date",
                      "distinct_categories_count", F.col("loc.customer_state").alias("customer_state"),
                      F.col("loc.customer_city").alias("customer_city"), "preferred_payment_method"))
    age = days_between(snap, "first_purchase_date")
    return agg.withColumns({
        "recency_days": days_between(snap, "last_purchase_date"),
        "customer_age_days": age,
        "purchase_lifespan_days": days_between("last_purchase_date", "first_purchase_date"),
        "purchase_frequency_monthly": F.col("total_orders") / F.greatest(age / 30.0, F.lit(1.0)),
        "is_repeat_customer": (F.col("total_orders") > 1).cast("int"),
        "avg_freight_cost": F.col("total_freight_paid") / F.greatest(F.col("total_orders"), F.lit(1)),
    })


def product_features(master: DataFrame) -> DataFrame:
    """E4 units, revenue, distinct buyers, mean rating and price, category."""
    return master.groupBy("product_id").agg(
        F.count("order_item_id").alias("product_popularity_units"),
        money_sum("price").alias("total_product_revenue"),
        F.countDistinct(CUSTOMER_KEY).alias("unique_customers_count"),
        F.avg("avg_review_score").alias("avg_product_rating"),
        money_avg("price").alias("avg_selling_price"),
        F.min("product_category_name_english").alias("category"))


def seller_features(master: DataFrame) -> DataFrame:
    """E5 revenue, distinct orders, items, mean rating, state and city."""
    return master.groupBy("seller_id").agg(
        money_sum("price").alias("seller_total_revenue"),
        F.countDistinct("order_id").alias("seller_total_orders"),
        F.count("order_item_id").alias("seller_unique_items_sold"),
        F.avg("avg_review_score").alias("seller_avg_rating"),
        F.min("seller_state").alias("seller_state"),
        F.min("seller_city").alias("seller_city"))


def avg_basket_value(master: DataFrame) -> Column:
    """Revenue / distinct orders (the other AOV definition, see README)."""
    return safe_div(money_sum("price"), F.countDistinct("order_id"))
