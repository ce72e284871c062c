"""A — sources and sinks: CSV ingest, date parsing, raw fallback join, warehouse export,
job sinks, model persistence, batch scoring input, CSV export, audit log sink and parser.

All writes go to caller-given paths (on a cluster: shared storage); nothing is collected.
"""

from __future__ import annotations

import functools
from datetime import datetime

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Encodings tried in order, and the name keywords that mark date columns.
ENCODINGS = ("utf-8", "iso-8859-1", "latin1")
DATE_KEYWORDS = ("timestamp", "date", "year", "month", "day")
# The audit line format written by the reference's logger.
AUDIT_PATTERN = (r"^\[(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2})\] \[AUDIT\] Model='([^']*)' Version='([^']*)' "
                 r"Entity='([^']*)' Action='([^']*)' Details='(.*)'$")


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None,
             encodings=ENCODINGS) -> DataFrame:
    """A1 header CSV; the first encoding whose decode has no replacement character wins (one
    small aggregation per attempt). Rows that do not fit the schema land in _corrupt_record."""
    last = None
    for enc in encodings:
        r = spark.read.option("header", True).option("encoding", enc).option("mode", "PERMISSIVE")
        df = r.schema(schema).csv(path) if schema is not None else r.option("inferSchema", True).csv(path)
        strings = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
        if not strings:
            return df
        bad = df.agg(F.max(functools.reduce(lambda a, b: a | b,
                                            [F.coalesce(F.col(c).contains("�"), F.lit(False))
                                             for c in strings]).cast("int")).alias("b")).first()["b"]
        if not bad:
            return df
        last = df
    return last


def parse_date_columns(df: DataFrame) -> DataFrame:
    """A4 string columns whose name contains a date keyword become timestamps (bad -> null)."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.StringType) and any(k in f.name.lower() for k in DATE_KEYWORDS):
            out.append(F.try_to_timestamp(F.col(f.name)).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def raw_fallback_master(t: dict[str, DataFrame]) -> DataFrame:
    """A5 items ⋈ orders ⋈ customers, first payment per order (lowest sequence), mean review,
    translated category; the only master variant that carries ``payment_type``."""
    # "first" = lowest sequence; ties (sequence numbers need not be unique) by type, then value
    first_pay = t["payments"].groupBy("order_id").agg(
        F.min(F.struct("payment_sequential", "payment_type", "payment_value")).alias("p"))
    first_pay = first_pay.select("order_id", "p.payment_type", "p.payment_value")
    rev = t["reviews"].groupBy("order_id").agg(
        F.avg(F.expr("try_cast(review_score AS DOUBLE)")).alias("review_score"))
    prod = t["products"]
    if "category_translation" in t:
        tr = t["category_translation"]
        prod = prod.join(tr, "product_category_name", "left")
    prod = prod.select("product_id", F.coalesce(*[F.col(c) for c in ("product_category_name_english",
                                                                      "product_category_name")
                                                if c in prod.columns]).alias("product_category_name_english"))
    m = t["order_items"].join(t["orders"], "order_id").join(t["customers"], "customer_id")
    return m.join(first_pay, "order_id", "left").join(rev, "order_id", "left").join(prod, "product_id", "left")


def export_warehouse(master: DataFrame, fs: DataFrame, out_dir: str) -> dict[str, str]:
    """A6 write the master (partitioned by purchase month for pruning; range-partitioned by time
    first so each task writes few month folders), the feature store and its three projections."""
    paths = {k: f"{out_dir.rstrip('/')}/{k}" for k in
             ("master", "feature_store", "processed_customers", "rfm_dataset", "customer_metrics")}
    m = master.withColumn("purchase_month", F.date_format("order_purchase_timestamp", "yyyy-MM"))
    (m.repartitionByRange("order_purchase_timestamp").write.mode("overwrite")
      .partitionBy("purchase_month").parquet(paths["master"]))
    fs.write.mode("overwrite").parquet(paths["feature_store"])
    fs.select("customer_unique_id", "total_orders", "total_spending", "recency_days", "customer_state",
              "preferred_payment_method").write.mode("overwrite").parquet(paths["processed_customers"])
    fs.select("customer_unique_id", "recency_days", "total_orders", "total_spending", "recency_score",
              "frequency_score", "monetary_score", "rfm_combined", "rfm_segment").write.mode("overwrite") \
      .parquet(paths["rfm_dataset"])
    fs.select("customer_unique_id", "historical_clv", "clv_per_order", "loyalty_score", "spending_tier",
              "churn_label").write.mode("overwrite").parquet(paths["customer_metrics"])
    return paths


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by=None, mode: str = "overwrite") -> str:
    """A7 job result sink (parquet or csv with header)."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*([partition_by] if isinstance(partition_by, str) else partition_by))
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.format(fmt).save(path)
    return path


def save_model(model: PipelineModel, path: str) -> str:
    """A9 persist a fitted PipelineModel (scaler and features travel inside: Q8 fixed)."""
    model.write().overwrite().save(path)
    return path


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def score_uploaded(spark: SparkSession, model: PipelineModel, path: str, schema: T.StructType | None = None,
                   out: str = "churn_probability") -> DataFrame:
    """A10 batch-score an uploaded CSV with a saved model (probability of class 1)."""
    from pyspark.ml.functions import vector_to_array
    df = read_csv(spark, path, schema)
    scored = model.transform(df)
    return scored.select(*df.columns, vector_to_array("probability")[1].alias(out))


def export_csv(df: DataFrame, path: str) -> str:
    """A11 CSV export of a filtered frame (part files written in parallel, header on each);
    an empty frame writes a single "No data available" row. Excel is not built."""
    if df.isEmpty():
        df.sparkSession.createDataFrame([("No data available",)], "message string") \
          .write.mode("overwrite").option("header", True).csv(path)
    else:
        df.write.mode("overwrite").option("header", True).csv(path)
    return path


def audit_event(spark: SparkSession, path: str, model: str, version: str, entity: str, action: str,
                details: str = "", ts: datetime | None = None) -> None:
    """A12 append one audit record (table partitioned by date)."""
    ts = ts or datetime.now()
    row = [(ts, model, version, entity, action, details, ts.strftime("%Y-%m-%d"))]
    spark.createDataFrame(row, "ts timestamp, model string, version string, entity string, action string, "
                               "details string, event_date string") \
         .write.mode("append").partitionBy("event_date").parquet(path)


def append_audit(events: DataFrame, path: str) -> str:
    """A12 append many audit records (ts, model, version, entity, action, details) at once."""
    events.withColumn("event_date", F.date_format("ts", "yyyy-MM-dd")).write.mode("append") \
          .partitionBy("event_date").parquet(path)
    return path


def audit_lines(df_text: DataFrame) -> DataFrame:
    """Parse audit text lines into columns with the written format (Q12 fixed)."""
    v = F.col("value")
    p = AUDIT_PATTERN
    return df_text.where(v.rlike(p)).select(
        F.to_timestamp(F.regexp_extract(v, p, 1), "yyyy-MM-dd HH:mm:ss").alias("ts"),
        F.regexp_extract(v, p, 2).alias("model"), F.regexp_extract(v, p, 3).alias("version"),
        F.regexp_extract(v, p, 4).alias("entity"), F.regexp_extract(v, p, 5).alias("action"),
        F.regexp_extract(v, p, 6).alias("details"))


def parse_audit_log(spark: SparkSession, path: str, top_n: int | None = None) -> DataFrame:
    """A13 audit log text -> columns, newest first (ties by the other columns); ``top_n`` gives only so many entries."""
    parsed = audit_lines(spark.read.text(path)).orderBy(F.desc("ts"), "entity", "model", "version", "action", "details")
    return parsed.limit(top_n) if top_n is not None else parsed
