"""G — RFM analytics: scores, 10-label segments, priority ranking, summaries and charts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orbitcart.functions.columns import first_present, money_avg, when_chain
from orbitcart.functions.ordering import with_rank_min
from orbitcart.operators.labels import rank_quintile, recency_quintile

KEY = "customer_unique_id"

# The 10 segment names in rule order.
SEGMENTS_10 = ("Champions", "Loyal Customers", "Potential Loyalists", "New Customers", "Promising",
               "Need Attention", "At Risk", "Can't Lose Them", "Hibernating", "Lost Customers")

# Marketing attributes per segment
# (objective, campaign, discount_strategy, channel, cross_sell, upsell).
SEGMENT_ATTRIBUTE_NAMES = ("objective", "campaign", "discount_strategy", "channel", "cross_sell", "upsell")
SEGMENT_ATTRIBUTES = {
    "Champions": ("Reward & Retain", "VIP Exclusives & Early Access", "No aggressive discounts required",
                  "Personalized VIP Concierge Email", "New High-End Collections", "Premium Bundles"),
    "Loyal Customers": ("Upsell & Advocacy", "Loyalty Tier Progression & Reviews", "Reward Points / Loyalty Cash",
                        "Targeted Product Recommendation Emails", "Complementary Accessories", "Higher Volume Packs"),
    "Potential Loyalists": ("Increase Order Frequency", "Membership Perks & Free Shipping",
                            "10% off next order within 14 days", "Triggered Post-Purchase Nudge",
                            "Trending Best-Sellers", "Subscription Options"),
    "New Customers": ("Onboarding & Habit Building", "Welcome Series & Product Guides", "15% Welcome Discount Code",
                      "Automated Onboarding Sequence", "Starter Kits", "Popular Bundles"),
    "Promising": ("Brand Engagement", "Limited Time Seasonal Offers", "Free Shipping Voucher",
                  "Category Spotlights", "Related Sub-Categories", "Slightly Higher AOV Items"),
    "Need Attention": ("Re-activate Before Dropoff", "Re-engagement 'We Miss You' Push", "15% Time-Limited Promo",
                       "SMS & Email Dual Push", "New Arrivals", "Multi-Packs"),
    "At Risk": ("Win-Back High Value", "Exclusive Win-Back Special", "20% Win-Back Discount",
                "High-Priority Direct Email", "Top Rated Essentials", "Re-stock Offers"),
    "Can't Lose Them": ("Aggressive Retention", "Direct Outreach & Heavy Incentive", "25% Heavy Discount + Free Gift",
                        "Dedicated Account Manager / VIP Call", "Flagship Products", "Custom Contracts"),
    "Hibernating": ("Re-ignite Interest", "Brand Comeback Story & New Features", "Steep Clearance Discounts",
                    "Batch Re-engagement Newsletter", "Value Packs", "N/A"),
    "Lost Customers": ("Low-Cost Survey / Purge", "Feedback Survey & Last Chance Offer", "Final 30% Flash Coupon",
                       "Automated Low-Frequency Campaign", "N/A", "N/A"),
}
DEFAULT_ATTRIBUTE = "General Promotion"


def rfm_scores(fs: DataFrame) -> DataFrame:
    """G1 r/f/m quintile scores. Reuses the feature store's scores when present (same definitions)."""
    have = {"recency_score", "frequency_score", "monetary_score"} <= set(fs.columns)
    if have:
        df = fs.withColumns({"r_score": F.col("recency_score"), "f_score": F.col("frequency_score"),
                             "m_score": F.col("monetary_score")})
    else:
        df = recency_quintile(fs, "recency_days", "r_score")
        df = rank_quintile(df, "total_orders", "f_score", stats=fs)
        df = rank_quintile(df, "total_spending", "m_score", stats=fs)
    return df.withColumn("rfm_combined_score", F.concat(F.col("r_score").cast("string"),
                                                        F.col("f_score").cast("string"),
                                                        F.col("m_score").cast("string")))


def segment_10(r: Column, f: Column, m: Column) -> Column:
    """G2 ordered rules; r>=4, f>=2, m<3 falls through to the last label (kept as is)."""
    s = SEGMENTS_10
    return when_chain([
        ((r >= 4) & (f >= 4) & (m >= 4), s[0]),
        ((r >= 3) & (f >= 3) & (m >= 3), s[1]),
        ((r >= 3) & (f >= 1) & (m >= 3), s[2]),
        ((r >= 4) & (f == 1), s[3]),
        ((r == 3) & (f == 1), s[4]),
        ((r == 3) & (f >= 2), s[5]),
        ((r == 2) & (f >= 2), s[6]),
        ((r <= 2) & (f >= 4), s[7]),
        ((r == 2) & (f == 1), s[8]),
    ], s[9])


def _norm(stats: DataFrame, c: str, invert: bool = False) -> Column:
    lo = stats.agg(F.min(c)).scalar()
    hi = stats.agg(F.max(c)).scalar()
    num = (hi - F.col(c)) if invert else (F.col(c) - lo)
    return num / F.greatest((hi - lo).cast("double"), F.lit(1.0))


def priority(df: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    """G3 score = round(100(.5 M + .3 R + .2 F), 2), min-max normalised, recency inverted;
    G4 rank descending, ties share the lowest rank."""
    st = stats if stats is not None else df
    score = (_norm(st, "total_spending") * 0.5 + _norm(st, "recency_days", invert=True) * 0.3 +
             _norm(st, "total_orders") * 0.2) * 100.0
    df = df.withColumn("customer_priority_score", F.round(score, 2))
    return with_rank_min(df, "customer_priority_score", "priority_rank", descending=True)


def rfm_analysis(fs: DataFrame, with_rank: bool = True) -> DataFrame:
    """G1-G4: one row per customer with scores, 10-label segment and priority."""
    df = rfm_scores(fs)
    df = df.withColumn("rfm_segment_label", segment_10(F.col("r_score"), F.col("f_score"), F.col("m_score")))
    if with_rank:
        return priority(df, stats=fs)
    return df


def segment_attributes(spark: SparkSession) -> DataFrame:
    """D17 lookup table (10 rows, fixed)."""
    rows = [(k, *v) for k, v in SEGMENT_ATTRIBUTES.items()]
    return spark.createDataFrame(rows, ["rfm_segment_label", *SEGMENT_ATTRIBUTE_NAMES])


def segment_summary(rfm: DataFrame, label: str = "rfm_segment_label") -> DataFrame:
    """G5 per segment: customers, mean recency/orders/spend, revenue, + 6 marketing attributes."""
    summary = rfm.groupBy(F.col(label).alias("rfm_segment_label")).agg(
        F.count(KEY).alias("customer_count"),
        F.avg("recency_days").alias("avg_recency"),
        F.avg("total_orders").alias("avg_orders"),
        money_avg("total_spending").alias("avg_spending"),
        F.sum("total_spending").alias("total_revenue"))
    attrs = segment_attributes(rfm.sparkSession)  # fixed 10-row table
    out = summary.join(F.broadcast(attrs), "rfm_segment_label", "left")
    return out.select(*summary.columns,
                      *[F.coalesce(F.col(a), F.lit(DEFAULT_ATTRIBUTE)).alias(a) for a in SEGMENT_ATTRIBUTE_NAMES])


def _score_cols(df: DataFrame) -> tuple[str, str, str]:
    return (first_present(df, ["r_score", "recency_score"]), first_present(df, ["f_score", "frequency_score"]),
            first_present(df, ["m_score", "monetary_score"]))


def score_distribution(df: DataFrame) -> DataFrame:
    """G6 customers per (dimension, score 1..5), zeros filled."""
    r, f, m = _score_cols(df)
    long = df.select(F.col(r).alias("recency"), F.col(f).alias("frequency"), F.col(m).alias("monetary")) \
             .unpivot([], ["recency", "frequency", "monetary"], "dimension", "quintile_score")
    counts = long.groupBy("dimension", "quintile_score").agg(F.count(F.lit(1)).alias("customer_count"))
    spark = df.sparkSession
    spine = spark.createDataFrame([(d, s) for d in ("recency", "frequency", "monetary") for s in range(1, 6)],
                                  "dimension string, quintile_score int")
    return (spine.join(counts, ["dimension", "quintile_score"], "left")
                 .select("dimension", "quintile_score",
                         F.coalesce(F.col("customer_count"), F.lit(0)).cast("long").alias("customer_count")))


def rf_heatmap(df: DataFrame) -> DataFrame:
    """G7 5x5 recency x frequency counts, rows R5..R1, zeros filled."""
    r, f, _ = _score_cols(df)
    piv = df.groupBy(F.col(r).alias("r_score")).pivot(f, [1, 2, 3, 4, 5]).agg(F.count(F.lit(1)))
    for i in range(1, 6):
        piv = piv.withColumnRenamed(str(i), f"f{i}")
    spine = df.sparkSession.range(1, 6).select(F.col("id").cast("int").alias("r_score"))
    out = spine.join(piv, "r_score", "left")
    return out.select("r_score", *[F.coalesce(F.col(f"f{i}"), F.lit(0)).cast("long").alias(f"f{i}")
                                   for i in range(1, 6)])


def segment_distribution(df: DataFrame) -> DataFrame:
    """G8 customers per segment label, largest first, label prettified."""
    seg = first_present(df, ["rfm_segment_label", "rfm_segment", "rfm_combined"])
    counts = df.groupBy(seg).agg(F.count(F.lit(1)).alias("customer_count"))
    return counts.select(F.initcap(F.regexp_replace(F.col(seg).cast("string"), "_", " ")).alias("rfm_segment"),
                         "customer_count")
