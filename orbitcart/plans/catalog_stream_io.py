"""Registered queries: Structured Streaming jobs (T) and sources/sinks (A).

Streams read the driver's Parquet tables (or files Spark derives from them under the shared
checkpoint folder), drain with ``availableNow`` and the registered DataFrame reads the sink.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from orbitcart.operators import drift as P
from orbitcart.plans.jobs import jobs
from orbitcart.plans.oracle import MSUM, R, with_base
from orbitcart.plans.pipeline import retail
from orbitcart.plans.registry import query, rounded
from orbitcart.sources import io
from orbitcart.sources.testdata import read_table
from orbitcart.streaming import folded as Z
from orbitcart.streaming import jobs as S


def _stream(spark, sf: str, name: str, files: int = 6):
    """A table as a stream of several files in no order of time, one file a micro-batch."""
    df = read_table(spark, sf, name)
    path = S.scratch(spark, f"{name}_files")
    df.repartition(files, F.xxhash64(*df.columns)).write.parquet(path)
    return S.file_stream(spark, path, df.schema, max_files=1)


@query("T1_windowed_telemetry_stream", with_base(f"""
SELECT time_bucket(INTERVAL 10 MINUTE, ts) AS window_start, time_bucket(INTERVAL 10 MINUTE, ts) + INTERVAL 10 MINUTE AS window_end,
       event_type, count(*) AS requests, {R('avg(value)', 6)} AS avg_latency_ms,
       {R('avg(1.0 / greatest(value / 1000.0, 0.001))', 4)} AS avg_throughput,
       count(*) FILTER (WHERE value > 1000.0) AS alerts FROM events GROUP BY ALL"""))
def t1(spark, sf):
    out = Z.fold_available_now(_stream(spark, sf, "events"), S.scratch(spark, "t1"), S.telemetry_partials, S.fold_telemetry)
    df = S.telemetry_view(Z.read_state(spark, out)).withColumns(
        {"window_start": F.col("window_start").cast("timestamp_ntz"), "window_end": F.col("window_end").cast("timestamp_ntz")})
    return rounded(df, {"avg_latency_ms": 6, "avg_throughput": 4})


@query("T1_sliding_telemetry_stream", with_base(f"""
, w AS (SELECT time_bucket(INTERVAL 5 MINUTE, ts) - k * INTERVAL 5 MINUTE AS window_start, event_type, value
        FROM events, (VALUES (0), (1)) t(k))
SELECT window_start, window_start + INTERVAL 10 MINUTE AS window_end, event_type, count(*) AS requests,
       {R('avg(value)', 6)} AS avg_latency_ms, {R('avg(1.0 / greatest(value / 1000.0, 0.001))', 4)} AS avg_throughput,
       count(*) FILTER (WHERE value > 1000.0) AS alerts FROM w GROUP BY ALL"""))
def t1_sliding(spark, sf):
    out = Z.fold_available_now(_stream(spark, sf, "events"), S.scratch(spark, "t1s"),
                               lambda batch: S.telemetry_partials(batch, "10 minutes", "5 minutes"), S.fold_telemetry)
    df = S.telemetry_view(Z.read_state(spark, out)).withColumns(
        {"window_start": F.col("window_start").cast("timestamp_ntz"), "window_end": F.col("window_end").cast("timestamp_ntz")})
    return rounded(df, {"avg_latency_ms": 6, "avg_throughput": 4})


def _ingest(spark, sf):
    r = retail(spark, sf)
    # dimensions are materialised (checkpointed) before the stream-static joins
    return S.ingest_stream(S.canonical_items_stream(_stream(spark, sf, "lineitem")), r._cut(r.cleaned["products"]), r._cut(r.cleaned["sellers"]))


@query("T2_ingest_stream", with_base("""
SELECT i.order_id, i.order_item_id, i.product_id, i.seller_id, i.price, i.freight_value,
       p.product_category_name_english AS category, s.seller_state
FROM items i LEFT JOIN prod p USING (product_id) LEFT JOIN sell s USING (seller_id)"""))
def t2(spark, sf):
    out = S.run_available_now(_ingest(spark, sf), S.scratch(spark, "t2"))
    return S.read_batches(spark, out).select("order_id", "order_item_id", "product_id", "seller_id", "price", "freight_value",
                                             "category", "seller_state")


@query("T3_running_customer_state", with_base(f"""
SELECT customer_unique_id, count(DISTINCT order_id) AS orders, count(*) AS items, {MSUM('price')} AS total_spending,
       max(order_purchase_timestamp) AS last_purchase_date FROM master GROUP BY 1"""))
def t3(spark, sf):
    r = retail(spark, sf)
    step = S.customer_partials(r._cut(r.cleaned["orders"]), r._cut(r.cleaned["customers"]))
    out = Z.fold_available_now(_ingest(spark, sf), S.scratch(spark, "t3"), step, S.fold_customers)
    state = S.customer_state_view(Z.read_state(spark, out))
    return state.withColumn("last_purchase_date", F.col("last_purchase_date").cast("timestamp_ntz"))


@query("T4_activity_sessions", with_base(f"""
, e AS (SELECT user_id, ts, value,
               CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL
                      OR ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 1 ELSE 0 END
                 AS new_session FROM events),
g AS (SELECT *, sum(new_session) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM e)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS events,
       {R('sum(value)', 4)} AS total_value FROM g GROUP BY user_id, sid"""))
def t4(spark, sf):
    out = Z.fold_available_now(_stream(spark, sf, "events"), S.scratch(spark, "t4"), S.session_partials, S.fold_sessions)
    s = S.session_view(Z.read_state(spark, out))
    return s.withColumns({"session_start": F.col("session_start").cast("timestamp_ntz"),
                          "session_end": F.col("session_end").cast("timestamp_ntz")})


_SCORED = """
, scr AS (SELECT fs.*, CASE WHEN least(greatest(recency_days / 180.0, 0.05), 0.95) >= 0.8 THEN 'Critical'
                            WHEN least(greatest(recency_days / 180.0, 0.05), 0.95) >= 0.6 THEN 'High' ELSE 'Other' END
                         AS risk_level FROM fs)"""


@query("T5_audit_tail_stream", with_base(f"""{_SCORED}
SELECT last_purchase_date AS ts, 'churn_model' AS model, 'v1' AS version,
       CAST(customer_unique_id AS VARCHAR) AS entity, 'risk_flag' AS action, risk_level AS details
FROM scr WHERE risk_level IN ('High', 'Critical')"""))
def t5(spark, sf):
    scored = jobs(spark, sf).scored.where(F.col("risk_level").isin("High", "Critical"))
    line = F.format_string("[%s] [AUDIT] Model='%s' Version='%s' Entity='%s' Action='%s' Details='%s'",
                           F.date_format("last_purchase_date", "yyyy-MM-dd HH:mm:ss"), F.lit("churn_model"),
                           F.lit("v1"), F.col("customer_unique_id").cast("string"), F.lit("risk_flag"),
                           F.col("risk_level"))
    logs = S.scratch(spark, "t5_logs")
    scored.select(line.alias("value")).repartition(5, F.xxhash64("value")).write.mode("overwrite").text(logs)
    stream = S.file_stream(spark, logs, "value string", "text", max_files=1)
    out = S.run_available_now(S.audit_tail(stream), S.scratch(spark, "t5"))
    return S.read_batches(spark, out).drop("batch_id").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("T6_drift_per_batch")
def t6(spark, sf):
    fs = retail(spark, sf).feature_store
    ref, cur = P.split_by_time(fs)
    src = S.scratch(spark, "t6_src")
    cur = cur.select(*P.DRIFT_FEATURES)
    cur.repartition(3, F.xxhash64(*P.DRIFT_FEATURES)).write.mode("overwrite").parquet(src)
    stream = S.file_stream(spark, src, cur.schema, max_files=1)
    out = S.run_available_now(stream, S.scratch(spark, "t6"), S.drift_step(ref))
    return S.read_batches(spark, out).withColumn("batch_id", F.col("batch_id").cast("long"))


# ---------------------------------------------------------------- A: sources and sinks

@query("A1_csv_roundtrip_customers", with_base("""
SELECT c.c_custkey AS customer_id, c.c_custkey AS customer_unique_id,
       concat_ws('-', n.n_name, c.c_mktsegment) AS customer_city, n.n_name AS customer_state
FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey"""))
def a1(spark, sf):
    raw = retail(spark, sf).raw["customers"]
    path = S.scratch(spark, "a1_csv")
    io.write_table(raw, path, fmt="csv")
    return io.read_csv(spark, path, raw.schema)


@query("A4_parse_date_columns", with_base("""
SELECT o_orderkey AS order_id, CAST(o_orderdate AS TIMESTAMP) AS order_date, o_orderstatus AS status FROM orders"""))
def a4(spark, sf):
    o = read_table(spark, sf, "orders").select(F.col("o_orderkey").alias("order_id"),
                                                F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("order_date"),
                                                F.col("o_orderstatus").alias("status"))
    return io.parse_date_columns(o).withColumn("order_date", F.col("order_date").cast("timestamp_ntz"))


@query("A5_raw_fallback_master", with_base(f"""
, fp AS (SELECT order_id, arg_min(payment_type, (payment_sequential, payment_type, payment_value)) AS payment_type,
                arg_min(payment_value, (payment_sequential, payment_type, payment_value)) AS payment_value FROM (
          SELECT l_orderkey AS order_id, l_linenumber AS payment_sequential, l_returnflag || l_linestatus AS payment_type,
                 {R('l_extendedprice * (1.0 + l_tax)', 2)} AS payment_value FROM lineitem) GROUP BY 1),
rv AS (SELECT l_orderkey AS order_id, avg(CAST(1 + (l_partkey + l_linenumber) % 5 AS DOUBLE)) AS review_score
       FROM lineitem GROUP BY 1)
SELECT payment_type, count(*) AS item_rows, {MSUM('l_extendedprice')} AS revenue, {R('avg(review_score)', 6)} AS avg_review
FROM lineitem li JOIN orders o ON o.o_orderkey = li.l_orderkey JOIN customer c ON c.c_custkey = o.o_custkey
LEFT JOIN fp ON fp.order_id = li.l_orderkey LEFT JOIN rv ON rv.order_id = li.l_orderkey GROUP BY 1"""))
def a5(spark, sf):
    m = io.raw_fallback_master(retail(spark, sf).raw)
    out = m.groupBy("payment_type").agg(F.count(F.lit(1)).alias("item_rows"),
                                        F.round(F.sum("price"), 2).alias("revenue"),
                                        F.avg("review_score").alias("avg_review"))
    return rounded(out, {"avg_review": 6})


@query("A6_warehouse_export_roundtrip", with_base(f"""
SELECT strftime(order_purchase_timestamp, '%Y-%m') AS purchase_month, count(*) AS item_rows,
       {MSUM('price')} AS revenue FROM master GROUP BY 1"""))
def a6(spark, sf):
    r = retail(spark, sf)
    paths = io.export_warehouse(r.master, r.feature_store, S.scratch(spark, "a6_warehouse"))
    m = spark.read.parquet(paths["master"])
    return m.groupBy("purchase_month").agg(F.count(F.lit(1)).alias("item_rows"),
                                           F.round(F.sum("price"), 2).alias("revenue"))


def _audit_log(spark, sf) -> str:
    """The risk flags written as audit lines."""
    scored = jobs(spark, sf).scored.where(F.col("risk_level").isin("High", "Critical"))
    line = F.format_string("[%s] [AUDIT] Model='%s' Version='%s' Entity='%s' Action='%s' Details='%s'",
                           F.date_format("last_purchase_date", "yyyy-MM-dd HH:mm:ss"), F.lit("churn_model"),
                           F.lit("v1"), F.col("customer_unique_id").cast("string"), F.lit("risk_flag"),
                           F.col("risk_level"))
    logs = S.scratch(spark, "a13_logs")
    scored.select(line.alias("value")).write.mode("overwrite").text(logs)
    return logs


@query("A13_latest_audit_entries", with_base(f"""{_SCORED}
SELECT last_purchase_date AS ts, 'churn_model' AS model, 'v1' AS version, CAST(customer_unique_id AS VARCHAR) AS entity,
       'risk_flag' AS action, risk_level AS details
FROM scr WHERE risk_level IN ('High', 'Critical') ORDER BY ts DESC, entity LIMIT 50"""))
def a13_latest(spark, sf):
    return io.parse_audit_log(spark, _audit_log(spark, sf), 50).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("A13_audit_log_parse", with_base(f"""{_SCORED}
SELECT count(*) AS entries, min(last_purchase_date) AS oldest, max(last_purchase_date) AS newest
FROM scr WHERE risk_level IN ('High', 'Critical')"""))
def a13(spark, sf):
    parsed = io.audit_lines(spark.read.text(_audit_log(spark, sf)))
    return parsed.agg(F.count(F.lit(1)).alias("entries"), F.min("ts").cast("timestamp_ntz").alias("oldest"),
                      F.max("ts").cast("timestamp_ntz").alias("newest"))


@query("A9_A10_model_roundtrip_scoring")
def a9(spark, sf):
    """A9 save + reload a churn PipelineModel, A10 score an uploaded CSV of the feature store."""
    from orbitcart.functions.ordering import packed
    from orbitcart.operators import churn as I
    fs = retail(spark, sf).feature_store
    data = I.class_weights(I.prepare_labels(packed(fs)))
    model = I.churn_pipeline("logistic").fit(data)
    path = io.save_model(model, S.scratch(spark, "a9_model"))
    upload = S.scratch(spark, "a10_upload")
    io.write_table(data.select("customer_unique_id", *I.CHURN_FEATURES, "churn_label", "class_weight"), upload, "csv")
    scored = io.score_uploaded(spark, io.load_model(path), upload,
                               data.select("customer_unique_id", *I.CHURN_FEATURES, "churn_label", "class_weight").schema)
    return scored.select("customer_unique_id", F.round("churn_probability", 6).alias("churn_probability"))


@query("A11_csv_export_filtered", with_base(f"""
SELECT product_category_name_english AS category, count(*) AS item_rows, {MSUM('price')} AS revenue
FROM master WHERE customer_state = 'NATION_5' GROUP BY 1"""))
def a11(spark, sf):
    m = retail(spark, sf).master.where(F.col("customer_state") == "NATION_5")
    path = io.export_csv(m.select("order_id", "product_category_name_english", "price"), S.scratch(spark, "a11_csv"))
    back = io.read_csv(spark, path, m.select("order_id", "product_category_name_english", "price").schema)
    return back.groupBy(F.col("product_category_name_english").alias("category")).agg(
        F.count(F.lit(1)).alias("item_rows"), F.round(F.sum("price"), 2).alias("revenue"))


@query("A12_audit_sink_append", with_base(f"""{_SCORED}
SELECT CAST(last_purchase_date AS DATE) AS event_day, count(*) AS events FROM scr
WHERE risk_level = 'Critical' GROUP BY 1"""))
def a12(spark, sf):
    """A12 append-only audit records partitioned by date, written as a batch of events."""
    scored = jobs(spark, sf).scored.where(F.col("risk_level") == "Critical")
    path = S.scratch(spark, "a12_audit")
    ev = scored.select(F.col("last_purchase_date").cast("timestamp").alias("ts"), F.lit("churn_model").alias("model"),
                       F.lit("v1").alias("version"), F.col("customer_unique_id").cast("string").alias("entity"),
                       F.lit("risk_flag").alias("action"), F.col("risk_level").alias("details"))
    io.append_audit(ev, path)
    back = spark.read.parquet(path)
    return back.groupBy(F.to_date("event_date").alias("event_day")).agg(F.count(F.lit(1)).alias("events"))
