from datetime import datetime

import pytest

from orbitcart.operators.search import entities, gram_index, search
from orbitcart.session import written_table


@pytest.fixture(scope="module")
def tables(spark):
    day = datetime(2020, 1, 1)
    items = [("Ann.77", "o1", "s1", "p1", "toys", 10.0), ("Ann.77", "o1", "s2", "p2", None, 5.5), ("bob", "o2", "s1", "p1", "toys", 10.0),
             ("bob", "o3x", "s77", "p9", "To%ys", 1.0), (None, "o4", "s1", "p1", "toys", 2.0)]
    master = spark.createDataFrame([(*i, "delivered", day, "SP") for i in items],
                                   "customer_unique_id string, order_id string, seller_id string, product_id string, "
                                   "product_category_name_english string, price double, order_status string, "
                                   "order_purchase_timestamp timestamp, seller_state string")
    fs = spark.createDataFrame([("Ann.77", "Champions", 1, 15.5), ("bob", None, None, 11.0)],
                               "customer_unique_id string, rfm_segment string, churn_label int, total_spending double")
    table = written_table(entities(master, fs))
    return written_table(gram_index(table, 3)), table


def ids(tables, q, **options):
    return sorted((r.entity_type, r.entity_id) for r in search(*tables, q, **options).collect())


def test_kinds_in_order_and_literal_text(tables):
    assert ids(tables, "77") == [("customer", "Ann.77")]
    assert ids(tables, "77", kinds=["seller", "product"]) == [("seller", "s77")]
    assert ids(tables, " ANN.7 ") == [("customer", "Ann.77")]
    assert ids(tables, "n.n") == [] and ids(tables, ".") == [("customer", "Ann.77")]
    assert ids(tables, "o3X") == [("order", "o3x")] and ids(tables, "o") == [("customer", "bob")]
    assert ids(tables, "o%y") == [("category", "To%ys")] == ids(tables, "%")
    assert ids(tables, "OYS") == [("category", "toys")]
    assert ids(tables, "s", kinds=["seller"]) == [("seller", "s1"), ("seller", "s2"), ("seller", "s77")]
    assert ids(tables, "s", kinds=["seller"], limit=2) == [("seller", "s1"), ("seller", "s2")]
    for nothing in ("", "   ", "zzz", "ann.777"):
        assert ids(tables, nothing) == []


def test_summaries(tables):
    ann = search(*tables, "ann").first()
    assert (ann.orders, ann["items"], ann.revenue, ann.avg_order_value, ann.rfm_segment, ann.churn_risk, ann.customer_value) == (
        1, 2, 15.5, 15.5, "Champions", "High Risk", 15.5)
    bob = search(*tables, "bob").first()
    assert (bob.orders, bob.revenue, bob.avg_order_value, bob.rfm_segment, bob.churn_risk) == (2, 11.0, 5.5, None, "Low Risk")
    order = search(*tables, "o1").first()
    assert (order["items"], order.revenue, order.status, order.purchased_at, order.state) == (2, 15.5, "delivered", datetime(2020, 1, 1), None)
    seller = search(*tables, "s1", kinds=["seller"]).first()
    assert (seller.orders, seller["items"], seller.revenue, seller.state) == (3, 3, 22.0, "SP")
    product = search(*tables, "p1", kinds=["product"]).first()
    assert (product.category, product.revenue) == ("toys", 22.0)


def test_lookup_reads_the_index_by_its_runs(tables):
    hits = search(*tables, "ann.77")
    plan = hits._jdf.queryExecution().toString()
    assert "In(gram, [.77,ann,n.7,nn.])], ReadSchema" in plan  # among the pushed filters


def _rows_exchanged(df):
    """Rows written by the exchanges of a plan that has run."""
    plan, rows = df._jdf.queryExecution().executedPlan(), []
    df.collect()

    def walk(p):
        if "ShuffleExchange" in p.getClass().getSimpleName():
            rows.append(p.metrics().apply("shuffleRecordsWritten").value())
        children = p.finalPhysicalPlan() if "AdaptiveSparkPlan" in p.getClass().getSimpleName() else p.plan() if "QueryStage" in p.getClass().getSimpleName() else None
        if children is not None:
            return walk(children)
        for i in range(p.children().size()):
            walk(p.children().apply(i))

    walk(plan)
    return rows


def test_index_exchanges_ids_not_runs(tables):
    """Before, every run of every id was sent to the range it belongs to."""
    index, table = tables
    assert _rows_exchanged(gram_index(table, 3)) == [table.count()]
    assert index.count() > 4 * table.count()
    once = sorted(map(str, gram_index(table).collect()))
    assert once == sorted(map(str, index.collect())) and len(set(once)) == len(once)


def test_rows_that_lie_by_order_are_added_up_in_place(spark, tables):
    """Before, the join with the customers' labels sent all entities again."""
    n = 400
    master = spark.range(n).selectExpr("id % 9 AS customer_unique_id", "id DIV 4 AS order_id", "id % 7 AS seller_id", "id % 11 AS product_id",
                                       "'c' AS product_category_name_english", "1.5D AS price", "'done' AS order_status",
                                       "timestamp'2020-01-01' AS order_purchase_timestamp", "'SP' AS seller_state")
    fs = spark.createDataFrame([(k, "x", 0, 1.0) for k in range(9)], "customer_unique_id long, rfm_segment string, churn_label int, total_spending double")
    got = entities(master.repartition(4, "order_id"), fs)
    rows = _rows_exchanged(got)
    # the items by order, what each of four parts holds of each entity, and the customers
    assert len(rows) == 3 and sorted(rows)[0] == 9 and sorted(rows)[-1] == n and sorted(rows)[1] <= n / 4 + 4 * (9 + 7 + 11 + 1)
    kept = got.collect()
    assert len(kept) == n / 4 + 9 + 7 + 11 + 1 and all((r.status is not None) == (r.entity_type == "order") for r in kept)
    assert {(r.orders, r["items"], r.revenue) for r in kept if r.entity_type == "category"} == {(n / 4, n, 1.5 * n)}
