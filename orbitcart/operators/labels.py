"""F — labels: churn flag, RFM quintiles and segments, CLV, spending tier, loyalty score.

Quantile edges and rank-based quintiles are global order statistics; they are found by brackets
(``orbitcart.functions.ranks``) and enter the row expressions as constants, so no table is
sorted or collected and no cross join is planned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from orbitcart.functions.columns import when_chain
from orbitcart.functions.ordering import with_global_row_number
from orbitcart.functions.ranks import exact_percentiles, rows_at_ranks

KEY = "customer_unique_id"
DEFAULT_CHURN_DAYS = 90

# Segment names of the 8-label scheme, in rule order.
SEGMENTS_8 = ("Champions", "Loyal Customers", "Potential Loyalists", "Promising / Recent",
              "At Risk", "Cant Lose Them", "Hibernating", "Lost / Inactive")
# Spending tier names, lowest to highest.
SPENDING_TIERS = ("Tier 1 - Bronze", "Tier 2 - Silver", "Tier 3 - Gold", "Tier 4 - Platinum VIP")


def churn_label(df: DataFrame, threshold_days: float = DEFAULT_CHURN_DAYS, out: str = "churn_label") -> DataFrame:
    """F1 churned when recency exceeds the inactivity threshold."""
    return df.withColumn(out, (F.col("recency_days") > F.lit(threshold_days)).cast("int"))


def recency_quintile(df: DataFrame, value: str = "recency_days", out: str = "recency_score",
                     stats: DataFrame | None = None) -> DataFrame:
    """F2 value-quantile bins, right-closed: lowest fifth scores 5, highest 1.

    Equal edges (few distinct values) never raise here: the ``when`` chain simply leaves
    the empty bins unused.
    """
    q = exact_percentiles(stats if stats is not None else df, value, [0.2, 0.4, 0.6, 0.8])
    x = F.col(value)
    score = when_chain([(x <= q[0], 5), (x <= q[1], 4), (x <= q[2], 3), (x <= q[3], 2)], 1)
    return df.withColumn(out, score.cast("int"))


def rank_quintile(df: DataFrame, value: str, out: str, key: str = KEY,
                  stats: DataFrame | None = None) -> DataFrame:
    """F3 quintile of ``rank(method='first')``: pandas ``qcut`` of ranks 1..n into 5 bins.

    Edge k of the ranks is ``1 + k(n-1)/5``; rank r falls in bin ``ceil(5(r-1)/(n-1))`` (bin 1
    includes the lowest rank). So a row's bin is one more than the number of rows at the ranks
    ``1 + floor(k(n-1)/5)`` that it follows: only these four are looked for, no row is
    numbered. Nulls come first, as in an ascending sort. Text ids have no sketch; with them the
    rows are numbered.
    """
    source = stats if stats is not None else df
    if not isinstance(df.schema[key].dataType, NumericType):
        return _numbered_quintile(df, value, out, key, source)
    n = source.count()
    if n < 2:
        return df.withColumn(out, F.lit(1))
    x = F.coalesce(F.col(value).cast("double"), F.lit(float("-inf")))
    edges = rows_at_ranks(source, x, key, [1 + k * (n - 1) // 5 for k in range(1, 5)], n=n)
    after = [(x > F.lit(v)) | ((x == F.lit(v)) & (F.col(key) > F.lit(tie))) for v, tie in edges]
    return df.withColumn(out, sum((c.cast("int") for c in after), F.lit(1)))


def _numbered_quintile(df: DataFrame, value: str, out: str, key: str, source: DataFrame) -> DataFrame:
    n = source.agg(F.count(F.lit(1))).scalar()
    ranked = with_global_row_number(df, [F.col(value).asc(), F.col(key).asc()], "__rnk")
    bin_ = F.ceil(F.lit(5.0) * (F.col("__rnk") - 1) / (n - 1))
    score = F.when(n > 1, F.greatest(F.lit(1), bin_)).otherwise(F.lit(1))
    return ranked.withColumn(out, score.cast("int")).drop("__rnk")


def segment_8(r: Column, f: Column, m: Column) -> Column:
    """F5 first matching rule wins."""
    s = SEGMENTS_8
    return when_chain([
        ((r >= 4) & (f >= 4) & (m >= 4), s[0]),
        ((r >= 3) & (f >= 3), s[1]),
        ((r >= 3) & (f < 3) & (m >= 3), s[2]),
        ((r == 3) & (f < 3), s[3]),
        ((r == 2) & (f >= 2), s[4]),
        ((r <= 2) & (f >= 4), s[5]),
        ((r == 2) & (f <= 2), s[6]),
    ], s[7])


def rfm_labels(df: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    """F2-F5 recency/frequency/monetary scores, combined code, 8-label segment.

    ``stats`` (default ``df``) is the frame the global statistics are taken from; pass the
    persisted unlabelled frame so each scalar subquery reads it instead of re-running the
    labelling steps before it.
    """
    stats = stats if stats is not None else df
    df = recency_quintile(df, "recency_days", "recency_score", stats)
    df = rank_quintile(df, "total_orders", "frequency_score", stats=stats)
    df = rank_quintile(df, "total_spending", "monetary_score", stats=stats)
    r, f, m = F.col("recency_score"), F.col("frequency_score"), F.col("monetary_score")
    return df.withColumns({
        "rfm_combined": F.concat(r.cast("string"), f.cast("string"), m.cast("string")),
        "rfm_segment": segment_8(r, f, m),
    })


def clv_metrics(df: DataFrame) -> DataFrame:
    """F6 historical CLV = spend + freight, and per order."""
    clv = F.col("total_spending") + F.col("total_freight_paid")
    return df.withColumns({"historical_clv": clv}).withColumn(
        "clv_per_order", F.col("historical_clv") / F.greatest(F.col("total_orders"), F.lit(1)))


def spending_tier(df: DataFrame, value: str = "total_spending", out: str = "spending_tier",
                  stats: DataFrame | None = None) -> DataFrame:
    """F7 tiers at the .5/.8/.95 quantiles (inclusive lower bounds)."""
    q = exact_percentiles(stats if stats is not None else df, value, [0.5, 0.8, 0.95])
    x = F.col(value)
    t = SPENDING_TIERS
    return df.withColumn(out, when_chain([(x >= q[2], t[3]), (x >= q[1], t[2]), (x >= q[0], t[1])], t[0]))


def _minmax_norm(df: DataFrame, c: str) -> Column:
    lo = df.agg(F.min(c)).scalar()
    hi = df.agg(F.max(c)).scalar()
    return (F.col(c) - lo) / F.greatest(hi - lo, F.lit(1.0))


def loyalty_score(df: DataFrame, out: str = "loyalty_score", stats: DataFrame | None = None) -> DataFrame:
    """F8 round(100 * (.4 minmax(orders) + .4 minmax(spend) + .2 rating/5), 2)."""
    st = stats if stats is not None else df
    score = (_minmax_norm(st, "total_orders") * 0.4 + _minmax_norm(st, "total_spending") * 0.4 +
             F.col("avg_review_score_given") / 5.0 * 0.2) * 100.0
    return df.withColumn(out, F.round(score, 2))


def label_customers(customer_features: DataFrame, churn_days: float = DEFAULT_CHURN_DAYS) -> DataFrame:
    """F1-F8 in the reference's order: the feature store."""
    base = customer_features
    df = churn_label(base, churn_days)
    df = rfm_labels(df, stats=base)
    df = clv_metrics(df)
    df = spending_tier(df, stats=base)
    return loyalty_score(df, stats=base)
