"""P — drift audit (two-sample Kolmogorov-Smirnov), reference/current splits, telemetry."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orbitcart.functions.ordering import with_global_row_number, with_global_running_sum

KEY = "customer_unique_id"
# The features the reference audits.
DRIFT_FEATURES = ("recency_days", "total_spending", "total_orders", "avg_order_value", "avg_review_score_given")
P_THRESHOLD = 0.05
KS_TERMS = 100


def split_by_time(df: DataFrame, ts: str = "last_purchase_date") -> tuple[DataFrame, DataFrame]:
    """P3 reference = rows before the midpoint of the time range, current = at/after it."""
    b = df.agg(F.unix_micros(F.min(F.col(ts).cast("timestamp"))).alias("lo"),
               F.unix_micros(F.max(F.col(ts).cast("timestamp"))).alias("hi"))
    mid = b.select(F.timestamp_micros(F.col("lo") + F.floor((F.col("hi") - F.col("lo")) / 2))).scalar()
    cur = F.col(ts).cast("timestamp") >= mid
    return df.where(~cur), df.where(cur)


def split_halves(df: DataFrame, key: str = KEY) -> tuple[DataFrame, DataFrame]:
    """P3 option: first / second half of the rows in id order (the reference's split)."""
    n = df.agg(F.count(F.lit(1))).scalar()
    r = with_global_row_number(df, [F.col(key).asc()], "__r")
    half = F.floor(n / 2)
    return r.where(F.col("__r") <= half).drop("__r"), r.where(F.col("__r") > half).drop("__r")


def kolmogorov_p(lam: Column, terms: int = KS_TERMS) -> Column:
    """Asymptotic Kolmogorov survival function 2 sum_{k>=1} (-1)^(k-1) exp(-2 k^2 lam^2), in [0, 1]."""
    ks = F.sequence(F.lit(1), F.lit(terms))
    series = F.aggregate(ks, F.lit(0.0), lambda acc, k: acc + F.pow(F.lit(-1.0), k - 1) *
                         F.exp(F.lit(-2.0) * k * k * lam * lam) * 2.0)
    return F.when(lam <= 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), series)))


def ks_test(reference: DataFrame, current: DataFrame, features: Sequence[str] = DRIFT_FEATURES) -> DataFrame:
    """P1 per feature: KS statistic D = max |F_ref - F_cur| (exact), asymptotic p-value,
    drift flag (p < .05); nulls dropped; statistic and p rounded to 4 decimals.

    Values are aggregated to (feature, value) counts first, the empirical CDFs come from one
    distributed running sum ordered by (feature, value), and each feature's running sum is
    re-based by the totals of the features before it (a table with one row per feature).
    """
    feats = list(features)
    def long(df, side):
        return (df.select(*[F.col(c).cast("double").alias(c) for c in feats])
                  .unpivot([], feats, "feature", "value").where(F.col("value").isNotNull())
                  .select("feature", "value", F.lit(side).alias("side")))
    both = long(reference, 0).unionByName(long(current, 1))
    counts = both.groupBy("feature", "value").agg(F.count_if(F.col("side") == 0).alias("n_ref"),
                                                 F.count_if(F.col("side") == 1).alias("n_cur"))
    run = with_global_running_sum(counts, [F.col("feature").asc(), F.col("value").asc()],
                                  {"c_ref": F.col("n_ref"), "c_cur": F.col("n_cur")})
    tot = counts.groupBy("feature").agg(F.sum("n_ref").alias("t_ref"), F.sum("n_cur").alias("t_cur"))
    wf = Window.orderBy("feature").rowsBetween(Window.unboundedPreceding, -1)  # one row per feature
    tot = tot.withColumns({"o_ref": F.coalesce(F.sum("t_ref").over(wf), F.lit(0)),
                           "o_cur": F.coalesce(F.sum("t_cur").over(wf), F.lit(0))})
    j = run.join(F.broadcast(tot), "feature")  # one row per feature
    diff = F.abs((F.col("c_ref") - F.col("o_ref")) / F.col("t_ref") - (F.col("c_cur") - F.col("o_cur")) / F.col("t_cur"))
    d = j.groupBy("feature").agg(F.max(diff).alias("d"), F.max("t_ref").alias("n_ref"),
                                 F.max("t_cur").alias("n_cur"))
    lam = F.sqrt(F.col("n_ref") * F.col("n_cur") / (F.col("n_ref") + F.col("n_cur"))) * F.col("d")
    p = kolmogorov_p(lam)
    return d.select("feature", F.round("d", 4).alias("ks_statistic"), F.round(p, 4).alias("p_value"),
                    (p < P_THRESHOLD).alias("drift_detected"), "n_ref", "n_cur")


def drift_report(ks: DataFrame) -> DataFrame:
    """P2 one row: overall flag, count and sorted list of drifting features (bounded by the
    feature list)."""
    return ks.agg(F.max(F.col("drift_detected").cast("int")).cast("boolean").alias("drift_detected"),
                  F.count_if("drift_detected").alias("drifted_count"),
                  F.array_sort(F.collect_list(F.when(F.col("drift_detected"), F.col("feature")))).alias("drifted"),
                  F.count(F.lit(1)).alias("features_checked"))


# ------------------------------------------------------------------ P7 telemetry

LATENCY_ALERT_MS = 1000.0


def telemetry(events: DataFrame, latency: str = "value", batch_size: Column | None = None,
              by: Sequence[str | Column] = ("event_type",)) -> DataFrame:
    """P7 per group: request count, mean latency (ms), mean throughput
    batch / max(latency / 1000, .001), alert count (latency > 1000 ms)."""
    b = batch_size if batch_size is not None else F.lit(1.0)
    lat = F.col(latency).cast("double")
    tp = b / F.greatest(lat / 1000.0, F.lit(0.001))
    return events.groupBy(*by).agg(F.count(F.lit(1)).alias("requests"), F.avg(lat).alias("avg_latency_ms"),
                                   F.avg(tp).alias("avg_throughput"), F.count_if(lat > LATENCY_ALERT_MS).alias("alerts"))


def windowed_telemetry(events: DataFrame, window: str = "10 minutes", slide: str | None = None,
                       latency: str = "value") -> DataFrame:
    """T1 batch twin: telemetry per (event-time window, event type)."""
    w = F.window("ts", window, slide) if slide else F.window("ts", window)
    out = telemetry(events, latency, by=[w.alias("w"), "event_type"])
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "event_type",
                      "requests", "avg_latency_ms", "avg_throughput", "alerts")
