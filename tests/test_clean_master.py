"""Cleaning and master joins on a literal fixture with nulls, duplicates, ties and bad input
(the driver tables contain no nulls, so these cases are tested here)."""
from pyspark.sql import functions as F

from orbitcart.operators import clean, master


def _raw(spark):
    customers = spark.createDataFrame(
        [(1, 1, "  sao paulo ", "sp"), (1, 1, "duplicate", "xx"), (2, 2, "rio de janeiro", " rj "), (3, 3, None, None)],
        "customer_id long, customer_unique_id long, customer_city string, customer_state string")
    orders = spark.createDataFrame(
        [(10, 1, " Delivered ", "2020-01-05 10:00:00", "2020-01-09 00:00:00", "2020-01-20 00:00:00"),
         (11, 2, None, "not a date", None, None),
         (12, 1, "shipped", "2020-02-01 00:00:00", "2020-02-20 00:00:00", "2020-02-10 00:00:00"),
         (13, 3, "created", "2020-03-01 00:00:00", None, None)],  # order without items
        "order_id long, customer_id long, order_status string, order_purchase_timestamp string, "
        "order_delivered_customer_date string, order_estimated_delivery_date string")
    items = spark.createDataFrame(
        [(10, 1, 100, 7, 50.0, 5.0), (10, 1, 100, 7, 50.0, 5.0),  # fully duplicated item
         (10, 2, 101, 8, -1.0, 1.0), (11, 1, 102, 9, 20.0, None), (12, 1, 103, 99, 30.0, 3.0)],
        "order_id long, order_item_id int, product_id long, seller_id long, price double, freight_value double")
    products = spark.createDataFrame(
        [(100, "cama", 100.0), (101, None, None), (102, "untranslated", 300.0), (103, "cama", None)],
        "product_id long, product_category_name string, product_weight_g double")
    translation = spark.createDataFrame([("cama", "bed_bath")], "product_category_name string, product_category_name_english string")
    payments = spark.createDataFrame(
        [(10, 1, "credit_card", 1, 30.0), (10, 2, "boleto", 1, 25.0), (10, 3, "boleto", 2, -5.0),
         (12, 1, "voucher", 1, 33.0), (12, 2, "credit_card", 3, 1.0)],
        "order_id long, payment_sequential int, payment_type string, payment_installments int, payment_value double")
    reviews = spark.createDataFrame([(10, "5"), (10, "bad"), (11, None)], "order_id long, review_score string")
    sellers = spark.createDataFrame([(7, "campinas", "sp"), (8, "curitiba", "pr")],
                                    "seller_id long, seller_city string, seller_state string")
    return {"customers": customers, "orders": orders, "order_items": items, "products": products,
            "payments": payments, "reviews": reviews, "sellers": sellers, "category_translation": translation}


def test_cleaning_rules(spark):
    c = clean.clean_all(_raw(spark))
    cust = {r.customer_id: r for r in c["customers"].collect()}
    assert len(cust) == 3
    assert cust[1].customer_city == "Sao Paulo" and cust[1].customer_state == "SP"  # first copy kept
    assert cust[3].customer_city is None  # nulls stay null (no "Nan")
    orders = {r.order_id: r for r in c["orders"].collect()}
    assert orders[10].order_status == "delivered"
    assert orders[11].order_purchase_timestamp is None  # bad text -> null
    items = c["order_items"].collect()
    assert len(items) == 2  # duplicate dropped, negative price and null freight dropped
    prods = {r.product_id: r for r in c["products"].collect()}
    assert prods[100].product_category_name_english == "bed_bath"
    assert prods[102].product_category_name_english == "untranslated"
    assert prods[101].product_category_name_english == "unspecified"
    assert prods[101].product_weight_g == 200.0  # median of 100 and 300
    pays = c["payments"].collect()
    assert all(p.payment_value >= 0 for p in pays)
    revs = sorted(r.review_score for r in c["reviews"].collect())
    assert revs == [3.0, 3.0, 5.0]


def test_master_joins_and_fills(spark):
    c = clean.clean_all(_raw(spark))
    m = master.build_master(c)
    rows = {r.order_id: r for r in m.collect()}
    assert set(rows) == {10, 12}  # order 11's only item dropped in cleaning; 13 has none
    r10 = rows[10]
    assert r10.preferred_payment_type == "boleto"  # 1 credit_card vs 1 boleto: tie -> smallest
    assert r10.total_payment_value == 55.0 and r10.payment_sequences_count == 2
    assert r10.avg_review_score == 4.0 and r10.product_category_name_english == "bed_bath"
    r12 = rows[12]
    assert r12.seller_state is None  # unknown seller keeps the row (left join)
    assert r12.avg_review_score == 3.0  # no review -> 3.0


def test_payments_tie_smallest(spark):
    pay = spark.createDataFrame([(1, 1, "b", 1, 1.0), (1, 2, "a", 1, 1.0)],
                                "order_id long, payment_sequential int, payment_type string, "
                                "payment_installments int, payment_value double")
    assert master.payments_by_order(pay).first().preferred_payment_type == "a"


def test_empty_inputs(spark):
    from orbitcart.operators import customers, executive
    c = clean.clean_all(_raw(spark))
    empty = master.build_master(c).where(F.lit(False))
    assert executive.revenue_by_category(empty).count() == 0
    assert executive.customer_growth(empty).count() == 0
    assert customers.state_distribution(empty).count() == 0
    assert executive.ratings_histogram(empty).count() == 5


def test_master_exchanges_wide_rows_once_by_order(spark):
    """Without broadcasts, too, the wide rows end up dealt by order: products and sellers joined the narrow ones."""
    held = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        m = master.build_master(clean.clean_all(_raw(spark)))
        plan = m._jdf.queryExecution().executedPlan()
        assert "order_id" in plan.outputPartitioning().toString()
        assert {(r.order_id, r.n) for r in m.groupBy("order_id").agg(F.count("*").alias("n")).collect()} == {(10, 1), (12, 1)}
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
