"""T — Structured Streaming jobs.

T1 windowed telemetry, T2 line-item ingest -> clean -> dimension enrich without re-delivered
copies, T3 running per-customer state, T4 activity sessions, T5 audit-log tail, T6 drift per
micro-batch against a static baseline.

Every sink writes one folder per micro-batch (``batch_id=n``, overwritten), so a batch that is
replayed after a failure replaces its own rows. Aggregates are kept as additive partials of
each micro-batch and summed by the reading view: no event is ever too late for them. Folded
state (``streaming.folded``) joins the partials of older batches level by level, so that a
view reads few folders however many batches there were. ``run_available_now`` drains the input and stops.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orbitcart.operators import drift
from orbitcart.session import scratch_table_path
from orbitcart.sources.io import audit_lines

KEY = "customer_unique_id"
GAP = "30 minutes"


def scratch(spark: SparkSession, name: str) -> str:
    return scratch_table_path(spark, f"{name}-{uuid.uuid4().hex[:12]}")


def file_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet", max_files: int | None = None) -> DataFrame:
    """A file source; ``max_files`` per trigger only where the caller asks for small batches."""
    reader = spark.readStream.schema(schema).format(fmt)
    return (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).load(path)


def batch_sink(out_path: str, step: Callable[[DataFrame], DataFrame] | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: ``step`` of the batch, in the batch's own folder."""
    def sink(batch: DataFrame, batch_id: int) -> None:
        (step(batch) if step else batch).write.mode("overwrite").parquet(f"{out_path}/batch_id={batch_id}")
    return sink


def run_available_now(sdf: DataFrame, out_path: str, step: Callable[[DataFrame], DataFrame] | None = None) -> str:
    """Drain the stream into ``out_path``, one folder per micro-batch, and wait for the end."""
    q = (sdf.writeStream.trigger(availableNow=True).option("checkpointLocation", out_path + "_ckpt")
            .foreachBatch(batch_sink(out_path, step)).start())
    q.awaitTermination()
    return out_path


def read_batches(spark: SparkSession, out_path: str) -> DataFrame:
    """All rows of a sink, with their ``batch_id``."""
    return spark.read.option("basePath", out_path).parquet(f"{out_path}/batch_id=*")


# ------------------------------------------------------------------ T1

def telemetry_partials(events: DataFrame, window: str = "10 minutes", slide: str | None = None,
                       latency: str = "value") -> DataFrame:
    """T1 additive parts of one batch per (tumbling or sliding event-time window, event type)."""
    ts = F.col("ts").cast("timestamp")
    w = F.window(ts, window, slide) if slide else F.window(ts, window)
    v = F.col(latency)
    return events.groupBy(w.alias("w"), "event_type").agg(
        F.count(F.lit(1)).alias("requests"), F.count(v).alias("measured"), F.sum(v).alias("latency"),
        F.sum(1.0 / F.greatest(v / 1000.0, F.lit(0.001))).alias("throughput"), F.count_if(v > 1000.0).alias("alerts")).select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "event_type", "requests", "measured",
        "latency", "throughput", "alerts")


def fold_telemetry(partials: DataFrame) -> DataFrame:
    """T1 partials of several batches as one row a window and type."""
    sums = ("requests", "measured", "latency", "throughput", "alerts")
    return partials.groupBy("window_start", "window_end", "event_type").agg(*(F.sum(c).alias(c) for c in sums))


def telemetry_view(partials: DataFrame) -> DataFrame:
    """T1 requests, mean latency, mean throughput and alerts per window over all batches."""
    return partials.groupBy("window_start", "window_end", "event_type").agg(
        F.sum("requests").alias("requests"), (F.sum("latency") / F.sum("measured")).alias("avg_latency_ms"),
        (F.sum("throughput") / F.sum("measured")).alias("avg_throughput"), F.sum("alerts").alias("alerts"))


# ------------------------------------------------------------------ T2

def canonical_items_stream(lineitem: DataFrame) -> DataFrame:
    """Line items arriving as a stream, in the canonical order-item shape."""
    return lineitem.select(
        F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("order_item_id"),
        F.col("l_partkey").alias("product_id"), F.col("l_suppkey").alias("seller_id"),
        F.col("l_shipdate").cast("timestamp").alias("shipping_limit_date"), F.col("l_extendedprice").alias("price"),
        F.round(F.col("l_extendedprice") * F.col("l_tax"), 2).alias("freight_value"))


def ingest_stream(items: DataFrame, products: DataFrame, sellers: DataFrame, redelivery: str = "7 days") -> DataFrame:
    """T2 clean (C5 filters) -> drop copies re-delivered within ``redelivery`` of arrival ->
    stream-static joins with the cleaned product and seller dimensions (D5, D6).

    The watermark is on arrival time, which never runs backwards, so no row is too late; the
    state is bounded by what arrives in that time.
    """
    cleaned = items.where((F.col("price") >= 0) & (F.col("freight_value") >= 0)).withColumn("arrived_at", F.current_timestamp())
    dedup = (cleaned.withWatermark("arrived_at", redelivery)
                    .dropDuplicatesWithinWatermark(["order_id", "order_item_id", "product_id", "seller_id", "price",
                                                    "freight_value", "shipping_limit_date"]))
    p = products.select("product_id", F.col("product_category_name_english").alias("category"))
    s = sellers.select("seller_id", "seller_state")
    return dedup.drop("arrived_at").join(p, "product_id", "left").join(s, "seller_id", "left")


# ------------------------------------------------------------------ T3

def customer_partials(orders: DataFrame, customers: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """T3 one batch of enriched items -> items and spend per (customer, order)."""
    c = customers.select("customer_id", KEY)
    o = orders.select("order_id", "customer_id", "order_purchase_timestamp").join(c, "customer_id")

    def step(batch: DataFrame) -> DataFrame:
        own = batch.groupBy("order_id").agg(F.count(F.lit(1)).alias("items"), F.sum("price").alias("spent"))
        return own.join(o, "order_id").select(KEY, "order_id", "order_purchase_timestamp", "items", "spent")
    return step


def fold_customers(partials: DataFrame) -> DataFrame:
    """T3 partials of several batches as one row a (customer, order)."""
    return partials.groupBy(KEY, "order_id").agg(F.max("order_purchase_timestamp").alias("order_purchase_timestamp"),
                                                 F.sum("items").alias("items"), F.sum("spent").alias("spent"))


def customer_state_view(partials: DataFrame) -> DataFrame:
    """T3 per customer: orders, items, spend (cents), last purchase; an order whose items came
    in several batches counts once. Quintile scores are global and recomputed from this view."""
    return fold_customers(partials).groupBy(KEY).agg(
        F.count(F.lit(1)).alias("orders"), F.sum("items").alias("items"), F.round(F.sum("spent"), 2).alias("total_spending"),
        F.max("order_purchase_timestamp").alias("last_purchase_date"))


# ------------------------------------------------------------------ T4

def session_partials(events: DataFrame, gap: str = GAP, block_seconds: int = 3600) -> DataFrame:
    """T4 activity sessions inside time blocks: a user's events are spread over the blocks, so a
    very busy user is not one task's work; each block leaves a few partial sessions."""
    ts = F.col("ts").cast("timestamp")
    block = F.floor(F.unix_seconds(ts) / block_seconds).alias("block")
    # session_window joins an event exactly one gap later; the next session starts there, so the gap is taken less a microsecond
    window = F.session_window("ts", f"{gap} -1 microseconds").alias("s")
    out = events.withColumn("ts", ts).groupBy("user_id", block, window).agg(
        F.count(F.lit(1)).alias("events"), F.sum("value").alias("value"))
    return out.select("user_id", F.col("s.start").alias("session_start"),
                      (F.col("s.end") + F.expr("INTERVAL 1 MICROSECOND")).alias("session_end"), "events", "value")


def merged_sessions(partials: DataFrame, *also: str) -> DataFrame:
    """T4 partial sessions that overlap are one; the columns of ``session_partials``.

    Only rows equal in ``also`` are brought together. Merging overlaps can be done in any order,
    so it may be done for each day first and for the whole history of what is left.
    """
    keys = ["user_id", *also]
    order = Window.partitionBy(*keys).orderBy("session_start", "session_end")
    reached = F.max("session_end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(reached.isNull() | (F.col("session_start") >= reached), 1).otherwise(0)
    numbered = partials.withColumn("new", new).withColumn("session", F.sum("new").over(order))
    return numbered.groupBy(*keys, "session").agg(
        F.min("session_start").alias("session_start"), F.max("session_end").alias("session_end"),
        F.sum("events").alias("events"), F.sum("value").alias("value")).drop("session", *also)


def fold_sessions(partials: DataFrame) -> DataFrame:
    """T4 sessions of any partials. A busy user's partials are merged day by day; what is left of a
    day are disjoint sessions of at least the gap each, so a user's window over all days holds
    rows by the calendar (48 a day), not by the user's events."""
    day = F.floor(F.unix_seconds("session_start") / 86400)
    return merged_sessions(merged_sessions(partials.withColumn("day", day), "day"))


def session_view(partials: DataFrame) -> DataFrame:
    """T4 partial sessions that overlap, from any blocks and batches, are one session."""
    return fold_sessions(partials).select("user_id", "session_start", "session_end", "events",
                                          F.round("value", 4).alias("total_value"))


def sessions(events: DataFrame, gap: str = GAP) -> DataFrame:
    """T4 as one batch."""
    return session_view(session_partials(events, gap))


# ------------------------------------------------------------------ T5

def audit_tail(lines: DataFrame) -> DataFrame:
    """T5 parse appended audit lines (text stream) into columns."""
    return audit_lines(lines)


# ------------------------------------------------------------------ T6

def drift_step(baseline: DataFrame, features=drift.DRIFT_FEATURES) -> Callable[[DataFrame], DataFrame]:
    """T6 a micro-batch tested against a static baseline with the KS operator (P1)."""
    return lambda batch: drift.ks_test(baseline, batch, features)


__all__ = ["file_stream", "batch_sink", "run_available_now", "read_batches", "telemetry_partials", "fold_telemetry", "telemetry_view",
           "canonical_items_stream", "ingest_stream", "customer_partials", "fold_customers", "customer_state_view",
           "session_partials", "merged_sessions", "fold_sessions", "session_view", "sessions", "audit_tail", "drift_step"]
