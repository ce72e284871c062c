"""H — segmentation: feature pipeline (median impute, robust scaling, PCA), k selection by
silhouette, K-Means / Gaussian mixture / bisecting K-Means benchmark with silhouette,
Davies-Bouldin and Calinski-Harabasz, personas, and segment profiles.

The profile operators take any segment column (cluster persona or RFM segment).
"""

from __future__ import annotations

import functools

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.clustering import BisectingKMeans, GaussianMixture, KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, Imputer, RobustScaler, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orbitcart.functions.columns import money_avg, money_sum, when_chain
from orbitcart.operators.executive import change_pct, is_positive

KEY = "customer_unique_id"
CAT = "product_category_name_english"
# The 8 clustering features.
SEGMENT_FEATURES = ("total_spending", "total_orders", "avg_order_value", "recency_days", "historical_clv",
                    "avg_review_score_given", "distinct_categories_count", "loyalty_score")
K_RANGE = range(3, 9)
SEED = 42

# Persona texts (title, description, marketing, retention, discount).
PERSONAS = {
    "VIP Power Buyers": ("Top tier high-value customers with frequent high-basket purchases.",
                         "Exclusive VIP previews, dedicated account management, early access to new lines.",
                         "VIP tier loyalty perks and no-friction direct customer support.",
                         "Zero discount reliance; focus on luxury service and exclusivity."),
    "Loyal Frequenters": ("Repeat buyers with consistent order velocity and high brand affinity.",
                          "Gamified loyalty points, subscription replenishment offers, referral incentives.",
                          "Automated re-order reminders and double point rewards.",
                          "10% loyalty cash back on repeat purchases."),
    "At-Risk High Rollers": ("Historically profitable buyers who have shown no activity over the last 90+ days.",
                             "High-priority win-back campaigns, direct phone/email outreach with special incentives.",
                             "Personalized win-back survey and steep limited-time revival voucher.",
                             "20% win-back promo code."),
    "Inactive One-Timers": ("Single-purchase buyers with prolonged inactivity and low overall lifetime spend.",
                            "Automated low-cost re-engagement series, clearance item promotions.",
                            "Category-based recommendations based on initial purchase.",
                            "15% welcome-back coupon."),
    "Bargain Hunters & Essentials Buyers": ("Price-sensitive customers purchasing mostly discounted core commodities.",
                                            "Promote bundle deals, flash sales, and low-freight options.",
                                            "Seasonal promotion newsletters and bundle discount codes.",
                                            "Free shipping thresholds and bundle promos."),
}
# Segment label lists counted by the segmentation KPIs.
VIP_LABELS = ("Champions", "VIP Power Buyers", "Platinum", "VIP Customers")
LOYAL_LABELS = ("Loyal Customers", "Loyal Frequent Buyers", "Gold", "Loyal")
AT_RISK_LABELS = ("At Risk", "At-Risk High Rollers", "Need Attention", "Hibernating", "Can't Lose Them")


# ------------------------------------------------------------------ H1-H3 features

def feature_pipeline(features=SEGMENT_FEATURES, pca_k: int = 3) -> Pipeline:
    """H1 median impute + assemble, H2 robust scaling (median, IQR), H3 PCA(3) on mean-centred
    scaled features (Spark's PCA does not centre)."""
    feats = list(features)
    imp = [f"{c}__imp" for c in feats]
    return Pipeline(stages=[
        Imputer(inputCols=feats, outputCols=imp, strategy="median"),
        VectorAssembler(inputCols=imp, outputCol="raw_features", handleInvalid="keep"),
        RobustScaler(inputCol="raw_features", outputCol="features", withCentering=True, withScaling=True),
        StandardScaler(inputCol="features", outputCol="centred", withMean=True, withStd=False),
        PCA(k=pca_k, inputCol="centred", outputCol="pca")])


def prepared(fs: DataFrame) -> tuple[PipelineModel, DataFrame]:
    model = feature_pipeline().fit(fs)
    out = model.transform(fs)
    arr = vector_to_array("pca")
    return model, out.withColumns({"pca_x": arr[0], "pca_y": arr[1], "pca_z": arr[2]})


def explained_variance(model: PipelineModel) -> list[float]:
    return [float(v) for v in model.stages[-1].explainedVariance]


# ------------------------------------------------------------------ H4-H10 models and metrics

def choose_k(data: DataFrame, ks=K_RANGE, seed: int = SEED) -> tuple[int, list[tuple[int, float]]]:
    """H4 k with the best silhouette among K-Means fits (the evaluator is linear in rows, so no
    sample is needed)."""
    ev = ClusteringEvaluator(featuresCol="features", predictionCol="cluster_id")
    scores = []
    for k in ks:
        pred = KMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster_id").fit(data).transform(data)
        scores.append((k, ev.evaluate(pred)))
    return max(scores, key=lambda t: t[1])[0], scores


def _centroids(pred: DataFrame, features: str = "features", label: str = "cluster_id") -> DataFrame:
    dim = len(pred.select(features).first()[0])
    arr = vector_to_array(features)
    return pred.groupBy(label).agg(F.count(F.lit(1)).alias("n"),
                                   *[F.avg(arr[i]).alias(f"m{i}") for i in range(dim)])


def cluster_metrics(pred: DataFrame, features: str = "features", label: str = "cluster_id") -> dict:
    """H9 silhouette (Spark's squared-Euclidean evaluator), Davies-Bouldin and Calinski-Harabasz
    from centroids (k rows: the centroid table is broadcast, bounded by k)."""
    k = pred.select(label).distinct().count()
    if k < 2:
        return {"clusters": int(k), "silhouette": None, "davies_bouldin": None, "calinski_harabasz": None}
    sil = ClusteringEvaluator(featuresCol=features, predictionCol=label).evaluate(pred)
    cen = _centroids(pred, features, label)
    dim = len([c for c in cen.columns if c.startswith("m")])
    arr = vector_to_array(features)
    j = pred.select(label, arr.alias("x")).join(F.broadcast(cen), label)
    sq = functools.reduce(lambda a, b: a + b, [(F.col("x")[i] - F.col(f"m{i}")) ** 2 for i in range(dim)])
    per = j.groupBy(label).agg(F.avg(F.sqrt(sq)).alias("s"), F.sum(sq).alias("w"))
    total = pred.count()
    gm = pred.select(arr.alias("x")).agg(*[F.avg(F.col("x")[i]).alias(f"g{i}") for i in range(dim)]).first()
    cen_l = cen.join(per, label).collect()  # k rows
    import math
    W = sum(r["w"] for r in cen_l)
    B = sum(r["n"] * sum((r[f"m{i}"] - gm[f"g{i}"]) ** 2 for i in range(dim)) for r in cen_l)
    ch = (B / (k - 1)) / (W / (total - k)) if W > 0 and total > k else None
    db_terms = []
    for a in cen_l:
        worst = 0.0
        for b in cen_l:
            if a[label] == b[label]:
                continue
            d = math.sqrt(sum((a[f"m{i}"] - b[f"m{i}"]) ** 2 for i in range(dim)))
            if d > 0:
                worst = max(worst, (a["s"] + b["s"]) / d)
        db_terms.append(worst)
    return {"clusters": int(k), "silhouette": round(sil, 4), "davies_bouldin": round(sum(db_terms) / k, 4),
            "calinski_harabasz": round(ch, 2) if ch is not None else None}


def benchmark(data: DataFrame, k: int, seed: int = SEED) -> tuple[str, DataFrame, DataFrame]:
    """H5-H7, H10 fit K-Means, Gaussian mixture and bisecting K-Means (the divisive stand-in for
    agglomerative linkage); models with fewer than 2 clusters are skipped; best by silhouette,
    K-Means as fallback. Returns (best name, assignments, benchmark table)."""
    models = {
        "KMeans": KMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster_id"),
        "GaussianMixture": GaussianMixture(k=k, seed=seed, featuresCol="features", predictionCol="cluster_id"),
        "BisectingKMeans": BisectingKMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster_id"),
    }
    rows, preds = [], {}
    for name, est in models.items():
        pred = est.fit(data).transform(data)
        m = cluster_metrics(pred)
        if m["clusters"] < 2:
            continue
        preds[name] = pred
        rows.append({"algorithm": name, **m})
    best = max(rows, key=lambda r: r["silhouette"])["algorithm"] if rows else "KMeans"
    if best not in preds:
        preds[best] = models["KMeans"].fit(data).transform(data)
    table = data.sparkSession.createDataFrame(rows) if rows else None
    return best, preds[best], table


# ------------------------------------------------------------------ H11-H12 personas

def cluster_summary(df: DataFrame, label: str = "cluster_id") -> DataFrame:
    """H11 per cluster: count, 6 means, revenue and revenue share % (share over k rows)."""
    s = df.groupBy(label).agg(
        F.count(F.lit(1)).alias("customer_count"), money_avg("total_spending").alias("avg_spending"),
        F.avg("total_orders").alias("avg_orders"), F.avg("avg_order_value").alias("avg_aov"),
        F.avg("recency_days").alias("avg_recency"), F.avg("loyalty_score").alias("avg_loyalty"),
        F.avg("avg_review_score_given").alias("avg_review"), money_sum("total_spending").alias("total_revenue"))
    tot = s.agg(F.sum("total_revenue")).scalar()
    return s.withColumn("revenue_share_pct", F.col("total_revenue") / F.greatest(tot, F.lit(1.0)) * 100.0)


def personas(summary: DataFrame, label: str = "cluster_id") -> DataFrame:
    """H12 persona rules against the medians across clusters (percentile over the k rows)."""
    med = summary.agg(F.percentile("avg_spending", 0.5).alias("ms"), F.percentile("avg_orders", 0.5).alias("mo"),
                      F.percentile("avg_recency", 0.5).alias("mr")).select(F.struct("ms", "mo", "mr")).scalar()
    s, o, r, lo = F.col("avg_spending"), F.col("avg_orders"), F.col("avg_recency"), F.col("avg_loyalty")
    names = list(PERSONAS)
    title = when_chain([((s > med["ms"]) & (r < med["mr"]), names[0]), ((o > med["mo"]) & (lo > 50), names[1]),
                        ((r > med["mr"]) & (s > med["ms"]), names[2]), ((s < med["ms"]) & (o <= 1.5), names[3])],
                       names[4])
    dim = summary.sparkSession.createDataFrame([(k, *v) for k, v in PERSONAS.items()],
                                               "persona_title string, business_description string, "
                                               "marketing_recommendation string, retention_strategy string, "
                                               "discount_strategy string")
    out = summary.withColumn("persona_title", title).join(F.broadcast(dim), "persona_title", "left")  # 5 rows
    return out.select(label, "persona_title", "customer_count", F.round("revenue_share_pct", 2).alias("revenue_share_pct"),
                      F.round("avg_spending", 2).alias("avg_spending"), F.round("avg_orders", 2).alias("avg_orders"),
                      F.round("avg_recency", 1).alias("avg_recency_days"),
                      F.round("avg_loyalty", 1).alias("avg_loyalty_index"), "business_description",
                      "marketing_recommendation", "retention_strategy", "discount_strategy")


# ------------------------------------------------------------------ H13-H18 profiles

def segment_overview(fs: DataFrame, seg: str) -> DataFrame:
    """H13 per segment: customers, revenue, means; revenue descending."""
    return fs.groupBy(F.col(seg).alias("segment")).agg(
        F.count(F.lit(1)).alias("customers"), money_sum("total_spending").alias("total_revenue"),
        money_avg("total_spending").alias("avg_spending"), F.avg("total_orders").alias("avg_orders"),
        F.avg("recency_days").alias("avg_recency"), money_avg("historical_clv").alias("avg_clv")
    ).orderBy(F.desc("total_revenue"), "segment")


def segment_details(fs: DataFrame, master: DataFrame, seg: str, top: int = 3) -> DataFrame:
    """H14 profile of every segment at once: totals, means, churn %, top-3 categories and states
    (by item rows, ties by name) and mode payment type."""
    base = fs.groupBy(F.col(seg).alias("segment")).agg(
        F.count(F.lit(1)).alias("customers"), money_sum("total_spending").alias("total_revenue"),
        F.avg("total_orders").alias("avg_orders"), F.avg("avg_order_value").alias("avg_aov"),
        F.avg("avg_review_score_given").alias("avg_csat"), money_avg("historical_clv").alias("avg_clv"),
        (F.avg("churn_label") * 100.0).alias("churn_pct"))
    m = master.join(fs.select(KEY, F.col(seg).alias("segment")), KEY)

    def topn(col: str, out: str) -> DataFrame:
        c = m.where(F.col(col).isNotNull()).groupBy("segment", col).count()
        w = Window.partitionBy("segment").orderBy(F.desc("count"), col)  # rows per segment <= distinct values
        t = c.withColumn("r", F.row_number().over(w)).where(F.col("r") <= top)
        return t.groupBy("segment").agg(
            F.array_join(F.array_sort(F.collect_list(F.struct("r", col))).getField(col), ", ").alias(out))
    pay = m.groupBy("segment").agg(F.mode("preferred_payment_type", deterministic=True).alias("top_payment"))
    return base.join(topn(CAT, "top_categories"), "segment", "left").join(
        topn("customer_state", "top_states"), "segment", "left").join(pay, "segment", "left")


def pca_sample(points: DataFrame, n: int = 500, seed: int = SEED) -> DataFrame:
    """H15 repeatable sample of at most n points (hash order, a sampling operator by design)."""
    return points.orderBy(F.xxhash64(F.col(KEY), F.lit(seed)), KEY).limit(n).select(
        KEY, "pca_x", "pca_y", "pca_z", "cluster_id")


def comparison_matrix(fs: DataFrame, seg: str) -> DataFrame:
    """H16 8 measures per segment."""
    return fs.groupBy(F.col(seg).alias("segment")).agg(
        money_avg("total_spending").alias("avg_spending"), F.avg("total_orders").alias("avg_orders"),
        F.avg("avg_order_value").alias("avg_aov"), F.avg("recency_days").alias("avg_recency"),
        money_avg("historical_clv").alias("avg_clv"), F.avg("avg_review_score_given").alias("avg_review"),
        F.avg("loyalty_score").alias("avg_loyalty"), (F.avg("churn_label") * 100.0).alias("churn_pct"))


def segmentation_kpis(fs: DataFrame, seg: str = "rfm_segment") -> DataFrame:
    """H17 8 KPIs x (total, current, previous); periods by last-purchase midpoint (Q7 fixed);
    each customer counted once for the label lists (Q14 fixed, zero allowed)."""
    b = fs.agg(F.unix_micros(F.min(F.col("last_purchase_date").cast("timestamp"))).alias("lo"),
               F.unix_micros(F.max(F.col("last_purchase_date").cast("timestamp"))).alias("hi"))
    mid = b.select(F.timestamp_micros(F.col("lo") + F.floor((F.col("hi") - F.col("lo")) / 2))).scalar()
    df = fs.withColumn("is_current", F.col("last_purchase_date").cast("timestamp") >= mid)
    s = F.col(seg)
    score = (F.col("recency_score") + F.col("frequency_score") + F.col("monetary_score")) / 3.0
    cols = []
    for sfx, flag in (("t", None), ("c", F.col("is_current")), ("p", ~F.col("is_current"))):
        sel = (lambda c: c) if flag is None else (lambda c, f=flag: F.when(f, c))
        cols += [F.count_distinct(sel(s)).alias(f"segments_{sfx}"), F.count(sel(F.lit(1))).alias(f"customers_{sfx}"),
                 F.count(sel(F.when(s.isin(*VIP_LABELS), 1))).alias(f"vip_customers_{sfx}"),
                 F.count(sel(F.when(s.isin(*LOYAL_LABELS), 1))).alias(f"loyal_customers_{sfx}"),
                 F.count(sel(F.when(s.isin(*AT_RISK_LABELS), 1))).alias(f"at_risk_customers_{sfx}"),
                 F.coalesce(F.sum(sel(F.col("total_spending"))) / F.count_distinct(sel(s)), F.lit(0.0))
                 .alias(f"avg_segment_revenue_{sfx}"),
                 F.coalesce(F.avg(sel(score)), F.lit(0.0)).alias(f"avg_rfm_score_{sfx}")]
    wide = df.agg(*cols)
    names = ["segments", "customers", "vip_customers", "loyal_customers", "at_risk_customers", "avg_segment_revenue",
             "avg_rfm_score"]
    stacked = F.explode(F.array(*[
        F.struct(F.lit(n).alias("kpi"), F.col(f"{n}_t").cast("double").alias("total"),
                 F.col(f"{n}_c").cast("double").alias("current"), F.col(f"{n}_p").cast("double").alias("previous"))
        for n in names]))
    long = wide.select(stacked.alias("k")).select("k.*")
    return long.withColumns({"change_pct": change_pct(F.col("current"), F.col("previous")),
                             "is_positive": is_positive(F.col("current"), F.col("previous"))})


def largest_segment(fs: DataFrame, seg: str = "rfm_segment") -> DataFrame:
    """H17 the largest segment (ties by name)."""
    return fs.groupBy(seg).count().orderBy(F.desc("count"), seg).limit(1)


def search_segment_profile(fs: DataFrame, q: str, seg: str = "rfm_segment") -> DataFrame:
    """H18 customers whose id contains q; else segments whose name contains q, aggregated."""
    ids = fs.where(F.col(KEY).cast("string").contains(q)).select(
        F.lit("customer").alias("match_type"), F.col(KEY).cast("string").alias("match_key"),
        F.lit(1).cast("long").alias("customers"), F.col("total_spending").alias("total_spending"))
    segs = fs.where(F.lower(F.col(seg)).contains(q.lower())).groupBy(seg).agg(
        F.count(F.lit(1)).alias("customers"), money_sum("total_spending").alias("total_spending"))
    seg_rows = segs.select(F.lit("segment").alias("match_type"), F.col(seg).alias("match_key"), "customers",
                           "total_spending")
    n = ids.agg(F.count(F.lit(1))).scalar()
    return ids.unionByName(seg_rows.where(n == 0))
