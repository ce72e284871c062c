"""C — cleaning: dedupe, trimming/casing, timestamp coercion, filters, imputation.

Every function is lazy; nothing runs until an action on a result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbitcart.functions.columns import coerce_timestamp, dedupe_first, title_case

ORDER_DATE_COLUMNS = ("order_purchase_timestamp", "order_approved_at", "order_delivered_carrier_date",
                      "order_delivered_customer_date", "order_estimated_delivery_date")
PRODUCT_MEASURES = ("product_weight_g", "product_length_cm", "product_height_cm", "product_width_cm")
REVIEW_DATE_COLUMNS = ("review_creation_date", "review_answer_timestamp")


def clean_customers(df: DataFrame) -> DataFrame:
    """C1 dedupe on customer_id (first kept), C3 city title case, state upper case."""
    df = dedupe_first(df, ["customer_id"])
    return (df.withColumn("customer_city", title_case("customer_city"))
              .withColumn("customer_state", F.upper(F.trim("customer_state"))))


def clean_orders(df: DataFrame) -> DataFrame:
    """C1 dedupe on order_id, C4 timestamps coerced (bad text -> null), C3 status lower case."""
    df = dedupe_first(df, ["order_id"])
    for c in ORDER_DATE_COLUMNS:
        df = coerce_timestamp(df, c)
    if "order_status" in df.columns:
        df = df.withColumn("order_status", F.lower(F.trim("order_status")))
    return df


def clean_order_items(df: DataFrame) -> DataFrame:
    """C2 drop fully duplicated rows, C5 keep price >= 0 and freight >= 0 (nulls drop)."""
    df = df.distinct().where((F.col("price") >= 0) & (F.col("freight_value") >= 0))
    return coerce_timestamp(df, "shipping_limit_date")


def translate_categories(products: DataFrame, translation: DataFrame | None) -> DataFrame:
    """C6 translated name, else the source name, else "unspecified"."""
    if translation is None:
        return products.withColumn(
            "product_category_name_english",
            F.coalesce(F.col("product_category_name"), F.lit("unspecified")))
    t = dedupe_first(translation.select("product_category_name", "product_category_name_english"),
                     ["product_category_name"])
    t = t.withColumnRenamed("product_category_name_english", "__en")
    out = products.join(t, "product_category_name", "left")
    out = out.withColumn("product_category_name_english",
                         F.coalesce(F.col("__en"), F.col("product_category_name"), F.lit("unspecified")))
    return out.drop("__en").select(*products.columns, "product_category_name_english")


def impute_median(df: DataFrame, columns) -> DataFrame:
    """C7 fill nulls with the exact (interpolated) median of each column.

    Product measures have few distinct values (grams, centimetres), so the ``percentile``
    aggregate's value->count buffer stays small; customer-level quantiles use
    ``exact_percentiles`` instead.
    """
    for c in columns:
        if c in df.columns:
            med = df.agg(F.percentile(F.col(c).cast("double"), 0.5)).scalar()
            df = df.withColumn(c, F.coalesce(F.col(c).cast("double"), med))
    return df


def clean_products(df: DataFrame, translation: DataFrame | None = None) -> DataFrame:
    df = dedupe_first(df, ["product_id"])
    df = translate_categories(df, translation)
    return impute_median(df, PRODUCT_MEASURES)


def clean_payments(df: DataFrame) -> DataFrame:
    """C5 keep payment_value >= 0, C3 payment type lower case."""
    return (df.where(F.col("payment_value") >= 0)
              .withColumn("payment_type", F.lower(F.trim("payment_type"))))


def clean_reviews(df: DataFrame) -> DataFrame:
    """C8 numeric review score, unparsable or missing -> 3.0; C4 review timestamps."""
    df = df.withColumn("review_score",
                       F.coalesce(F.expr("try_cast(review_score AS DOUBLE)"), F.lit(3.0)))
    for c in REVIEW_DATE_COLUMNS:
        df = coerce_timestamp(df, c)
    return df


def clean_sellers(df: DataFrame) -> DataFrame:
    df = dedupe_first(df, ["seller_id"])
    return (df.withColumn("seller_city", title_case("seller_city"))
              .withColumn("seller_state", F.upper(F.trim("seller_state"))))


def clean_all(raw: dict[str, DataFrame]) -> dict[str, DataFrame]:
    return {
        "customers": clean_customers(raw["customers"]),
        "orders": clean_orders(raw["orders"]),
        "order_items": clean_order_items(raw["order_items"]),
        "products": clean_products(raw["products"], raw.get("category_translation")),
        "payments": clean_payments(raw["payments"]),
        "reviews": clean_reviews(raw["reviews"]),
        "sellers": clean_sellers(raw["sellers"]),
    }
