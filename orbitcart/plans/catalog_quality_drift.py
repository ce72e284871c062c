"""Registered queries: data quality (B), drift and telemetry (P, T1 batch twin)."""

from __future__ import annotations

from orbitcart.operators import drift as P
from orbitcart.operators import quality as B
from orbitcart.plans.oracle import R, with_base
from orbitcart.plans.pipeline import retail
from orbitcart.plans.registry import query, rounded
from orbitcart.sources.testdata import read_table

# raw canonical tables (before cleaning), as the adapter builds them
_RAW = f"""
, raw_customers AS (SELECT c.c_custkey AS customer_id, c.c_custkey AS customer_unique_id,
                           concat_ws('-', n.n_name, c.c_mktsegment) AS customer_city, n.n_name AS customer_state
                    FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey),
raw_orders AS (SELECT o.o_orderkey AS order_id, o.o_custkey AS customer_id, o.o_orderstatus AS order_status,
                      o.o_orderdate AS order_purchase_timestamp, d.delivered AS order_delivered_customer_date,
                      o.o_orderdate + INTERVAL 60 DAY AS order_estimated_delivery_date
               FROM orders o LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS delivered FROM lineitem GROUP BY 1) d
               ON o.o_orderkey = d.l_orderkey),
raw_items AS (SELECT l_orderkey AS order_id, l_linenumber AS order_item_id, l_partkey AS product_id,
                     l_suppkey AS seller_id, l_shipdate AS shipping_limit_date, l_extendedprice AS price,
                     {R('l_extendedprice * l_tax', 2)} AS freight_value FROM lineitem),
raw_payments AS (SELECT l_orderkey AS order_id, l_linenumber AS payment_sequential,
                        l_returnflag || l_linestatus AS payment_type,
                        1 + CAST(trunc(l_quantity) AS INTEGER) % 12 AS payment_installments,
                        {R('l_extendedprice * (1.0 + l_tax)', 2)} AS payment_value FROM lineitem)"""


def _raw(spark, sf):
    return retail(spark, sf).raw


def _stats_sql(table: str, ncols: int, cols: list[str], extra: str = "") -> str:
    nulls = " + ".join(f"count(*) FILTER (WHERE {c} IS NULL)" for c in cols)
    return with_base(f"""{_RAW}
, dup AS (SELECT coalesce(sum(c - 1), 0) AS d FROM (SELECT count(*) AS c FROM {table} GROUP BY ALL))
SELECT '{table.replace('raw_', '').replace('items', 'order_items')}' AS table_name, count(*) AS total_rows,
       {ncols} AS total_columns, CAST((SELECT d FROM dup) AS BIGINT) AS duplicate_rows, {nulls} AS missing_cells{extra}
FROM {table}""")


_ORDER_COLS = ["order_id", "customer_id", "order_status", "order_purchase_timestamp", "order_delivered_customer_date",
               "order_estimated_delivery_date"]
_ITEM_COLS = ["order_id", "order_item_id", "product_id", "seller_id", "shipping_limit_date", "price", "freight_value"]


def _fix_dup(sql: str, table: str, cols: list[str]) -> str:
    return sql.replace(f"(SELECT count(*) AS c FROM {table} GROUP BY ALL)",
                       f"(SELECT count(*) AS c FROM {table} GROUP BY {', '.join(cols)})")


query("B1_table_stats_orders", _fix_dup(_stats_sql(
    "raw_orders", 6, _ORDER_COLS,
    ", CAST(count(*) - count(DISTINCT order_id) - max(CAST(order_id IS NULL AS INTEGER)) AS BIGINT) AS duplicate_keys"
    ", count(*) FILTER (WHERE order_status IS NULL) AS missing_status"), "raw_orders", _ORDER_COLS))(
    lambda spark, sf: B.table_stats("orders", _raw(spark, sf)["orders"]))

query("B6_table_stats_order_items", _fix_dup(_stats_sql(
    "raw_items", 7, _ITEM_COLS,
    ", count(*) FILTER (WHERE price < 0) + count(*) FILTER (WHERE freight_value < 0) AS negative_values"),
    "raw_items", _ITEM_COLS))(
    lambda spark, sf: B.table_stats("order_items", _raw(spark, sf)["order_items"]))


_RAW_MORE = f"""
, raw_products AS (SELECT p_partkey AS product_id, p_brand AS product_category_name,
                          CAST(length(p_name) AS INTEGER) AS product_name_lenght,
                          CAST(p_size AS DOUBLE) * 10.0 AS product_weight_g FROM part),
raw_reviews AS (SELECT l_orderkey AS order_id, CAST(1 + (l_partkey + l_linenumber) % 5 AS VARCHAR) AS review_score
                FROM lineitem),
raw_sellers AS (SELECT s.s_suppkey AS seller_id, n.n_name || '-SUPPLY' AS seller_city, n.n_name AS seller_state
                FROM supplier s LEFT JOIN nation n ON s.s_nationkey = n.n_nationkey)"""

_TABLE_COLS = {
    "customers": ("raw_customers", ["customer_id", "customer_unique_id", "customer_city", "customer_state"]),
    "orders": ("raw_orders", _ORDER_COLS),
    "order_items": ("raw_items", _ITEM_COLS),
    "products": ("raw_products", ["product_id", "product_category_name", "product_name_lenght", "product_weight_g"]),
    "payments": ("raw_payments", ["order_id", "payment_sequential", "payment_type", "payment_installments",
                                  "payment_value"]),
    "reviews": ("raw_reviews", ["order_id", "review_score"]),
    "sellers": ("raw_sellers", ["seller_id", "seller_city", "seller_state"]),
}


def _summary_cte() -> str:
    parts = []
    for name, (tbl, cols) in _TABLE_COLS.items():
        nulls = " + ".join(f"count(*) FILTER (WHERE {c} IS NULL)" for c in cols)
        parts.append(
            f"SELECT '{name}' AS table_name, (SELECT count(*) FROM {tbl}) AS total_rows, {len(cols)} AS total_columns, "
            f"CAST((SELECT coalesce(sum(c - 1), 0) FROM (SELECT count(*) AS c FROM {tbl} GROUP BY {', '.join(cols)})) "
            f"AS BIGINT) AS duplicate_rows, (SELECT {nulls} FROM {tbl}) AS missing_cells")
    return ",\nsumm AS (" + "\nUNION ALL ".join(parts) + ")"


def _missing_sql() -> str:
    parts = [f"SELECT '{name}' AS table_name, '{c}' AS column_name, count(*) AS null_cells FROM {tbl} WHERE {c} IS NULL"
             for name, (tbl, cols) in _TABLE_COLS.items() for c in cols]
    return with_base(f"{_RAW}{_RAW_MORE}\nSELECT * FROM (" + "\nUNION ALL ".join(parts) + ") WHERE null_cells > 0")


@query("B3_missing_by_column", _missing_sql())
def b3(spark, sf):
    raw = _raw(spark, sf)
    import functools
    from pyspark.sql import DataFrame
    return functools.reduce(DataFrame.unionByName, [B.missing_by_column(n, df) for n, df in raw.items()])


_B7_SQL = with_base(f"""{_RAW}{_RAW_MORE}{_summary_cte()}
SELECT *, {R('CASE WHEN total_rows > 0 THEN duplicate_rows * 100.0 / total_rows ELSE 0.0 END', 2)} AS duplicate_rate_pct,
       {R('CASE WHEN total_rows * total_columns > 0 THEN missing_cells * 100.0 / (total_rows * total_columns) ELSE 0.0 END', 2)}
         AS missing_rate_pct FROM summ""")

_B8_SQL = with_base(f"""{_RAW}{_RAW_MORE}{_summary_cte()},
t AS (SELECT sum(missing_cells) AS m, sum(total_rows * total_columns) AS c, sum(duplicate_rows) AS d,
             sum(total_rows) AS r FROM summ),
x AS (SELECT CASE WHEN c > 0 THEN m * 100.0 / c ELSE 0.0 END AS miss,
             CASE WHEN r > 0 THEN d * 100.0 / r ELSE 0.0 END AS dup FROM t)
SELECT {R('greatest(100.0 - (2.0 * miss + 3.0 * dup), 0.0)', 2)} AS quality_score, {R('miss', 2)} AS missing_pct,
       {R('dup', 2)} AS duplicate_pct FROM x""")


@query("B7_quality_summary", _B7_SQL)
def b7(spark, sf):
    return B.quality_summary({k: v for k, v in _raw(spark, sf).items() if k != "category_translation"})


@query("B8_quality_score", _B8_SQL)
def b8(spark, sf):
    return B.quality_score(B.quality_summary({k: v for k, v in _raw(spark, sf).items()
                                              if k != "category_translation"}))


@query("B9_column_profile_order_items", with_base(f"""{_RAW}
, n AS (SELECT * FROM (VALUES {", ".join(f"({i}, '{c}')" for i, c in enumerate(_ITEM_COLS))}) v(position, column_name)),
d AS ({" UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NULL) AS null_count, count(DISTINCT {c}) AS distinct_count FROM raw_items" for c in _ITEM_COLS)})
SELECT 'order_items' AS table_name, CAST(position AS INTEGER) AS position, column_name, null_count, distinct_count,
       CASE WHEN column_name = 'shipping_limit_date' THEN 'timestamp_ntz' WHEN column_name IN ('price', 'freight_value') THEN 'double'
            WHEN column_name = 'order_item_id' THEN 'int' ELSE 'bigint' END AS data_type
FROM n JOIN d USING (column_name)"""))
def b9(spark, sf):
    return B.column_profile("order_items", _raw(spark, sf)["order_items"])


# ---------------------------------------------------------------- P drift

def _ks_sql(split: str) -> str:
    feats = P.DRIFT_FEATURES
    longs = " UNION ALL ".join(f"SELECT '{f}' AS feature, CAST({f} AS DOUBLE) AS value, cur FROM lab" for f in feats)
    return with_base(f"""
, {split},
long AS ({longs}),
cnt AS (SELECT feature, value, count(*) FILTER (WHERE NOT cur) AS n_ref, count(*) FILTER (WHERE cur) AS n_cur
        FROM long WHERE value IS NOT NULL GROUP BY 1, 2),
cdf AS (SELECT feature, sum(n_ref) OVER (PARTITION BY feature ORDER BY value) AS c_ref,
               sum(n_cur) OVER (PARTITION BY feature ORDER BY value) AS c_cur,
               sum(n_ref) OVER (PARTITION BY feature) AS t_ref, sum(n_cur) OVER (PARTITION BY feature) AS t_cur FROM cnt),
d AS (SELECT feature, max(abs(c_ref / t_ref - c_cur / t_cur)) AS d, CAST(max(t_ref) AS BIGINT) AS n_ref,
             CAST(max(t_cur) AS BIGINT) AS n_cur FROM cdf GROUP BY 1),
lam AS (SELECT *, sqrt(n_ref * n_cur / (n_ref + n_cur)) * d AS lam FROM d),
pv AS (SELECT feature, CASE WHEN max(lam) <= 0 THEN 1.0 ELSE least(1.0, greatest(0.0,
              sum(pow(-1.0, k - 1) * exp(-2.0 * k * k * lam * lam) * 2.0))) END AS p
       FROM lam, range(1, {P.KS_TERMS + 1}) r(k) GROUP BY feature)
SELECT feature, {R('d', 4)} AS ks_statistic, {R('p', 4)} AS p_value, p < {P.P_THRESHOLD} AS drift_detected, n_ref, n_cur
FROM lam JOIN pv USING (feature)""")


_TIME_SPLIT = """b AS (SELECT epoch_us(min(last_purchase_date)) AS lo, epoch_us(max(last_purchase_date)) AS hi FROM fs),
lab AS (SELECT fs.*, last_purchase_date >= make_timestamp(CAST(lo + floor((hi - lo) / 2) AS BIGINT)) AS cur FROM fs, b)"""
_HALF_SPLIT = """lab AS (SELECT fs.*, row_number() OVER (ORDER BY customer_unique_id) > floor(count(*) OVER () / 2) AS cur
        FROM fs)"""


@query("P1_ks_drift_by_time", _ks_sql(_TIME_SPLIT))
def p1(spark, sf):
    ref, cur = P.split_by_time(retail(spark, sf).feature_store)
    return P.ks_test(ref, cur)


@query("P1_ks_drift_halves", _ks_sql(_HALF_SPLIT))
def p1_halves(spark, sf):
    ref, cur = P.split_halves(retail(spark, sf).feature_store)
    return P.ks_test(ref, cur)


def _p2_sql() -> str:
    body = _ks_sql(_TIME_SPLIT)
    head, tail = body.rsplit("SELECT feature,", 1)
    return head + """, ks AS (SELECT feature,""" + tail + """)
SELECT bool_or(drift_detected) AS drift_detected, count(*) FILTER (WHERE drift_detected) AS drifted_count,
       list_sort(list(feature) FILTER (WHERE drift_detected)) AS drifted, count(*) AS features_checked FROM ks"""


@query("P2_drift_report", _p2_sql())
def p2(spark, sf):
    ref, cur = P.split_by_time(retail(spark, sf).feature_store)
    return P.drift_report(P.ks_test(ref, cur))


@query("P7_telemetry", with_base(f"""
SELECT event_type, count(*) AS requests, {R('avg(value)', 6)} AS avg_latency_ms,
       {R('avg(1.0 / greatest(value / 1000.0, 0.001))', 4)} AS avg_throughput,
       count(*) FILTER (WHERE value > 1000.0) AS alerts FROM events GROUP BY 1"""))
def p7(spark, sf):
    return rounded(P.telemetry(read_table(spark, sf, "events")), {"avg_latency_ms": 6, "avg_throughput": 4})


@query("T1_windowed_telemetry_batch", with_base(f"""
SELECT time_bucket(INTERVAL 10 MINUTE, ts) AS window_start, time_bucket(INTERVAL 10 MINUTE, ts) + INTERVAL 10 MINUTE AS window_end,
       event_type, count(*) AS requests, {R('avg(value)', 6)} AS avg_latency_ms,
       {R('avg(1.0 / greatest(value / 1000.0, 0.001))', 4)} AS avg_throughput,
       count(*) FILTER (WHERE value > 1000.0) AS alerts FROM events GROUP BY ALL"""))
def t1_batch(spark, sf):
    return rounded(P.windowed_telemetry(read_table(spark, sf, "events"), "10 minutes"),
                   {"avg_latency_ms": 6, "avg_throughput": 4})
