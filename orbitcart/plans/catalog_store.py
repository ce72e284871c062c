"""Registered queries: stored tables — the clustered warehouse (M16, M17, M20), distinct counts
(M4, M11, N1), CSV intake with quarantine (A1) and the outputs that jobs write (A7)."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbitcart.operators import distinct as D
from orbitcart.operators import executive as X
from orbitcart.plans import registry
from orbitcart.plans.catalog_dash import _F_CATS, _F_END, _F_START, _F_STATES, PRETTY
from orbitcart.plans.jobs import jobs
from orbitcart.plans.oracle import MSUM, with_base
from orbitcart.plans.pipeline import retail
from orbitcart.plans.registry import query
from orbitcart.sources import intake, io, warehouse
from orbitcart.sources.testdata import read_table
from orbitcart.streaming.jobs import scratch

_SLICE_SQL = f"""
, f AS (SELECT * FROM master WHERE order_purchase_timestamp BETWEEN TIMESTAMP '{_F_START}' AND TIMESTAMP '{_F_END}'
          AND (upper(customer_state) IN {_F_STATES} OR upper(seller_state) IN {_F_STATES})
          AND product_category_name_english IN {_F_CATS})"""


def _slice(spark, sf) -> DataFrame:
    return warehouse.read_slice(spark, jobs(spark, sf).warehouse, start=_F_START, end=_F_END, states=list(_F_STATES), categories=list(_F_CATS))


@query("M16_warehouse_slice", with_base(f"""{_SLICE_SQL}
SELECT order_id, order_item_id, customer_state, seller_state, product_category_name_english AS category, price FROM f"""))
def m16_warehouse(spark, sf):
    return _slice(spark, sf).select("order_id", "order_item_id", "customer_state", "seller_state",
                                    F.col("product_category_name_english").alias("category"), "price")


@query("M17_warehouse_price_slice", with_base(f"""
SELECT preferred_payment_type, count(*) AS item_rows, count(DISTINCT order_id) AS orders, {MSUM('price')} AS revenue FROM master
WHERE customer_state IN ('NATION_3', 'NATION_9') AND price BETWEEN 20000.0 AND 60000.0 GROUP BY 1"""))
def m17_warehouse(spark, sf):
    f = warehouse.read_slice(spark, jobs(spark, sf).warehouse, customer_states=["NATION_3", "NATION_9"], price_range=(20000.0, 60000.0))
    return f.groupBy("preferred_payment_type").agg(F.count("*").alias("item_rows"), F.countDistinct("order_id").alias("orders"),
                                                   F.round(F.sum("price"), 2).alias("revenue"))


@query("M20_warehouse_page", with_base(f"""{_SLICE_SQL},
per AS (SELECT product_category_name_english AS c, order_id, {MSUM('price')} AS rev FROM f GROUP BY ALL),
st AS (SELECT customer_state AS s, order_id, {MSUM('price')} AS rev FROM f GROUP BY ALL)
SELECT 'category' AS chart, {PRETTY('c')} AS name, {MSUM('rev')} AS revenue, count(*) AS orders FROM per GROUP BY c
UNION ALL SELECT 'state', s, {MSUM('rev')}, count(*) FROM st GROUP BY s"""))
def m20_warehouse(spark, sf):
    """Two charts of the executive page from one pruned read of the files."""
    f = _slice(spark, sf)
    cats = X.revenue_by_category(f).select(F.lit("category").alias("chart"), F.col("category").alias("name"), "revenue", F.col("order_count").alias("orders"))
    per = f.groupBy("customer_state", "order_id").agg(F.sum("price").alias("rev"))
    states = per.groupBy(F.col("customer_state").alias("name")).agg(F.round(F.sum("rev"), 2).alias("revenue"), F.count("*").alias("orders"))
    return cats.unionByName(states.select(F.lit("state").alias("chart"), "name", "revenue", "orders"))


# ---------------------------------------------------------------- distinct counts of slices

_CELLS = """
, cells AS (SELECT CAST(date_trunc('month', order_purchase_timestamp) AS DATE) AS month, customer_state AS state,
                   product_category_name_english AS category, customer_unique_id, order_id FROM master)"""


def _counts_sql(by: str, where: str | None) -> str:
    return with_base(f"""{_CELLS}
SELECT {by}{',' if by else ''} count(DISTINCT customer_unique_id) AS customers, count(DISTINCT order_id) AS orders FROM cells
{f'WHERE {where}' if where else ''} {f'GROUP BY {by}' if by else ''}""")


_COUNTS = {
    "M11_distinct_totals": ((), None),
    "M4_distinct_by_state": (("state",), None),
    "M2_distinct_by_month": (("month",), None),
    "L15_distinct_by_category": (("category",), None),
    "N1_distinct_by_state_and_month": (("state", "month"), None),
    "M16_distinct_in_slice": (("category",), f"state IN {_F_STATES} AND month BETWEEN DATE '1996-01-01' AND DATE '1997-06-01'"),
}


def _counts(spark, sf, by, where):
    return D.distinct_counts(jobs(spark, sf).distinct_state, by, F.expr(where) if where else None)


for _name, (_by, _where) in _COUNTS.items():
    query(_name, _counts_sql(", ".join(_by), _where))(functools.partial(_counts, by=_by, where=_where))


# ---------------------------------------------------------------- A1 intake

_ORDERS_SCHEMA = "order_id bigint, customer_id bigint, status string, total double, purchased timestamp"


def _order_lines(spark, sf) -> str:
    """The orders as CSV; by their keys some lines lack fields, some hold text for numbers or times, some are ISO-8859-1."""
    key = F.col("o_orderkey")
    total = F.when(key % 53 == 0, "n/a").otherwise(F.col("o_totalprice").cast("string"))
    when = F.when(key % 59 == 0, "soon").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
    status = F.when(key % 7 == 0, F.concat("o_orderstatus", F.lit("é"))).otherwise(F.col("o_orderstatus"))
    whole = F.concat_ws(",", "o_orderkey", "o_custkey", status, total, when)
    line = F.when(key % 61 == 0, F.concat_ws(",", "o_orderkey", "o_custkey")).otherwise(whole)
    bytes_ = F.when(key % 2 == 0, F.encode(line, "ISO-8859-1")).otherwise(F.encode(line, "UTF-8"))
    path = scratch(spark, "a1_lines")
    read_table(spark, sf, "orders").select(bytes_.cast("string").alias("value")).write.text(path)
    return path


def _orders_in(spark, sf) -> tuple[DataFrame, DataFrame]:
    schema = spark.createDataFrame([], _ORDERS_SCHEMA).schema
    return intake.take_in(spark, _order_lines(spark, sf), schema, header=schema.names)


@query("A1_csv_quarantine", """
SELECT o_orderkey AS order_id, CASE WHEN o_orderkey % 61 = 0 THEN 'columns' ELSE 'values' END AS reason,
       CASE WHEN o_orderkey % 61 = 0 THEN NULL ELSE concat_ws(',', CASE WHEN o_orderkey % 53 = 0 THEN 'total' END,
                                                               CASE WHEN o_orderkey % 59 = 0 THEN 'purchased' END) END AS bad_columns
FROM orders WHERE o_orderkey % 53 = 0 OR o_orderkey % 59 = 0 OR o_orderkey % 61 = 0""")
def a1_quarantine(spark, sf):
    _, bad = _orders_in(spark, sf)
    return bad.select(F.split("line", ",")[0].cast("bigint").alias("order_id"), "reason", F.array_join("bad_columns", ",").alias("bad_columns"))


@query("A1_csv_good_rows", """
SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_orderstatus || CASE WHEN o_orderkey % 7 = 0 THEN 'é' ELSE '' END AS status,
       o_totalprice AS total, CAST(o_orderdate AS TIMESTAMP) AS purchased
FROM orders WHERE NOT (o_orderkey % 53 = 0 OR o_orderkey % 59 = 0 OR o_orderkey % 61 = 0)""")
def a1_good(spark, sf):
    good, _ = _orders_in(spark, sf)
    return good.withColumn("purchased", F.col("purchased").cast("timestamp_ntz"))


# ---------------------------------------------------------------- A7 outputs of the jobs

#: What each job writes: name -> (query that makes it, format).
JOB_OUTPUTS = {
    "churn_predictions": ("I9_risk_tiers", "csv"), "retention_roster": ("I11_high_risk_roster", "csv"),
    "clv_predictions": ("J8_opportunities", "parquet"), "high_value_roster": ("J9_high_value_roster", "csv"),
    "clv_forecast": ("J10_monthly_projection", "csv"), "association_rules": ("L5_association_rules", "csv"),
    "bundles": ("L6_bundles", "csv"), "cross_sell": ("L7_cross_sell", "csv"),
    "recommendations": ("K6_hybrid_recommendations", "parquet"),
}


def write_outputs(spark, sf: str, out_dir: str, names=None) -> dict[str, str]:
    """A7 write the named outputs (all, if none) below ``out_dir``; name -> path."""
    return {n: io.write_table(registry.all_queries()[JOB_OUTPUTS[n][0]](spark, sf), f"{out_dir}/{n}", JOB_OUTPUTS[n][1])
            for n in names or JOB_OUTPUTS}


def _output(spark, sf, name):
    """An output, written and read back; CSV comes in through the intake and must lose no row to the quarantine."""
    source, fmt = JOB_OUTPUTS[name]
    path = write_outputs(spark, sf, scratch(spark, "a7"), [name])[name]
    if fmt == "parquet":
        return spark.read.parquet(path)
    good, bad = intake.take_in(spark, path, registry.all_queries()[source](spark, sf).schema)
    if not bad.isEmpty():
        raise ValueError(f"{name}: written rows do not read back")
    return good


for _name, (_source, _) in JOB_OUTPUTS.items():
    query(f"A7_{_name}", registry._ORACLE.get(_source))(functools.partial(_output, name=_name))
