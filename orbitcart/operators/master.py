"""D — joins: per-order pre-aggregates and the denormalised master (one row per order item).

Shuffle layout: products and sellers join the items and customers join the orders while the rows are
narrow; the wide rows are exchanged once, on ``order_id``, where payments and reviews are keyed too.
So the master's rows of an order share a task and aggregates by order are combined there. Spark's
size check (``autoBroadcastJoinThreshold`` with AQE's runtime statistics) decides whether each side
is broadcast, so no side is broadcast without its size being known. AQE's skew-join split covers a
hot product, customer or order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbitcart.functions.columns import money_sum

PRODUCT_COLUMNS = ("product_id", "product_category_name_english", "product_name_lenght", "product_weight_g")
SELLER_COLUMNS = ("seller_id", "seller_city", "seller_state")


def payments_by_order(payments: DataFrame) -> DataFrame:
    """D1 sum of value, max installments, mode of type (smallest on ties), payment count."""
    return payments.groupBy("order_id").agg(
        money_sum("payment_value").alias("total_payment_value"),
        F.max("payment_installments").alias("max_payment_installments"),
        F.mode("payment_type", deterministic=True).alias("preferred_payment_type"),
        F.count("payment_sequential").alias("payment_sequences_count"))


def reviews_by_order(reviews: DataFrame) -> DataFrame:
    """D2 mean score and review count per order."""
    return reviews.groupBy("order_id").agg(
        F.avg("review_score").alias("avg_review_score"),
        F.count("review_score").alias("total_reviews_count"))


def build_master(t: dict[str, DataFrame]) -> DataFrame:
    """D3-D10: orders ⋈ customers ⋈ items (inner), ⟕ products, sellers, payments, reviews; D9 fills."""
    orders, customers, items = t["orders"], t["customers"], t["order_items"]
    products, sellers = t["products"], t["sellers"]
    pay = payments_by_order(t["payments"])
    rev = reviews_by_order(t["reviews"])

    cust_cols = [c for c in customers.columns if c != "customer_id"]
    item_cols = [c for c in items.columns if c != "order_id"]
    pcols = [c for c in PRODUCT_COLUMNS if c in products.columns]
    scols = [c for c in SELLER_COLUMNS if c in sellers.columns]

    # rows are widened as late as possible: item side and order side are completed apart, and the
    # join on order_id comes last, so that the master's rows of an order lie together
    lines = (items.join(products.select(*pcols), "product_id", "left")
                  .join(sellers.select(*scols), "seller_id", "left"))
    m = (lines.join(orders.join(customers, "customer_id", "inner"), "order_id", "inner")
              .join(pay, "order_id", "left")
              .join(rev, "order_id", "left"))

    m = m.withColumns({
        "total_payment_value": F.coalesce(F.col("total_payment_value"),
                                          F.col("price") + F.col("freight_value")),
        "avg_review_score": F.coalesce(F.col("avg_review_score"), F.lit(3.0)),
        "preferred_payment_type": F.coalesce(F.col("preferred_payment_type"), F.lit("unspecified")),
    })
    order_cols = list(orders.columns)
    ordered = (order_cols + cust_cols + item_cols +
               [c for c in pcols if c != "product_id"] + [c for c in scols if c != "seller_id"] +
               ["total_payment_value", "max_payment_installments", "preferred_payment_type",
                "payment_sequences_count", "avg_review_score", "total_reviews_count"])
    return m.select(*ordered)


def semi_by_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """D11 keep rows whose key appears in ``ids``."""
    return df.join(ids.select(key), key, "left_semi")


def anti_by_ids(df: DataFrame, ids: DataFrame, keys) -> DataFrame:
    """D12 rows whose key does not appear in ``ids``."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    return df.join(ids.select(*keys), keys, "left_anti")
