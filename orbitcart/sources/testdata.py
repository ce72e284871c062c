"""Canonical retail tables over the driver's TPC-H-like test tables.

The analytics operators work on the canonical retail schema (customers, orders,
order_items, products, payments, reviews, sellers, category_translation). This adapter
derives each one from the test tables with projections only (plus one pre-aggregation for
the per-order delivery date), so every query's work grows with the input tables.

Mapping (fixed, shared with the DuckDB oracle text in ``orbitcart.plans.oracle``):

* customer_id = customer_unique_id = c_custkey; state = nation name; city = nation-segment
* order_id = o_orderkey, status = o_orderstatus, purchase timestamp = o_orderdate,
  estimated delivery = o_orderdate + 60 days, delivered = latest l_shipdate of the order
* order item = one lineitem row: price = l_extendedprice, freight = round(price * l_tax, 2)
* product category = p_brand, translated to ``brand_<n>``
* one payment per line: type = l_returnflag||l_linestatus, value = round(price * (1 + l_tax), 2),
  installments = 1 + int(l_quantity) % 12, sequence = l_linenumber
* one review per line: score = 1 + (l_partkey + l_linenumber) % 5, delivered as text
* seller = supplier; seller state = nation name; seller city = nation name + "-SUPPLY"
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

ESTIMATED_DELIVERY_DAYS = 60


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def canonical_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    r = lambda name: read_table(spark, sf_dir, name)
    nation = r("nation").select("n_nationkey", "n_name")
    customer = r("customer")
    customers = (customer.join(nation, customer.c_nationkey == nation.n_nationkey, "left")
                 .select(F.col("c_custkey").alias("customer_id"),
                         F.col("c_custkey").alias("customer_unique_id"),
                         F.concat_ws("-", "n_name", "c_mktsegment").alias("customer_city"),
                         F.col("n_name").alias("customer_state")))

    li = r("lineitem")
    delivered = li.groupBy("l_orderkey").agg(F.max("l_shipdate").alias("order_delivered_customer_date"))
    o = r("orders")
    orders = (o.join(delivered, o.o_orderkey == delivered.l_orderkey, "left")
              .select(F.col("o_orderkey").alias("order_id"),
                      F.col("o_custkey").alias("customer_id"),
                      F.col("o_orderstatus").alias("order_status"),
                      F.col("o_orderdate").alias("order_purchase_timestamp"),
                      F.col("order_delivered_customer_date"),
                      (F.col("o_orderdate") + F.expr(f"INTERVAL {ESTIMATED_DELIVERY_DAYS} DAYS"))
                      .alias("order_estimated_delivery_date")))

    order_items = li.select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("order_item_id"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_suppkey").alias("seller_id"),
        F.col("l_shipdate").alias("shipping_limit_date"),
        F.col("l_extendedprice").alias("price"),
        F.round(F.col("l_extendedprice") * F.col("l_tax"), 2).alias("freight_value"))

    part = r("part")
    products = part.select(
        F.col("p_partkey").alias("product_id"),
        F.col("p_brand").alias("product_category_name"),
        F.length("p_name").alias("product_name_lenght"),
        (F.col("p_size").cast("double") * 10.0).alias("product_weight_g"))
    translation = part.select(
        F.col("p_brand").alias("product_category_name"),
        F.concat(F.lit("brand_"), F.substring_index("p_brand", "#", -1))
        .alias("product_category_name_english")).distinct()

    payments = li.select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("payment_sequential"),
        F.concat("l_returnflag", "l_linestatus").alias("payment_type"),
        (F.lit(1) + F.col("l_quantity").cast("int") % 12).alias("payment_installments"),
        F.round(F.col("l_extendedprice") * (F.lit(1.0) + F.col("l_tax")), 2).alias("payment_value"))

    reviews = li.select(
        F.col("l_orderkey").alias("order_id"),
        (F.lit(1) + (F.col("l_partkey") + F.col("l_linenumber")) % 5).cast("string").alias("review_score"))

    supplier = r("supplier")
    sellers = (supplier.join(nation, supplier.s_nationkey == nation.n_nationkey, "left")
               .select(F.col("s_suppkey").alias("seller_id"),
                       F.concat(F.col("n_name"), F.lit("-SUPPLY")).alias("seller_city"),
                       F.col("n_name").alias("seller_state")))

    return {"customers": customers, "orders": orders, "order_items": order_items,
            "products": products, "payments": payments, "reviews": reviews,
            "sellers": sellers, "category_translation": translation}


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "events")
