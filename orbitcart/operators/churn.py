"""I — churn: model training/scoring (Spark ML), rule fallback probability, risk tiers,
retention actions, KPIs, attributions, timelines and campaign targets."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbitcart.functions.columns import days_between, money_sum, when_chain
from orbitcart.functions.ordering import packed, packed_small
from orbitcart.operators.executive import change_pct, is_positive
from orbitcart.operators.oversample import oversample
from orbitcart.session import written_table

KEY = "customer_unique_id"
LABEL = "churn_label"

# Model features (11), as in the reference.
CHURN_FEATURES = ("total_orders", "total_items_purchased", "total_spending", "total_freight_paid", "avg_order_value",
                  "avg_review_score_given", "customer_age_days", "purchase_lifespan_days",
                  "purchase_frequency_monthly", "distinct_categories_count", "recency_days")

# Risk tier names, lowest to highest, and their thresholds (lower bounds).
RISK_TIERS = ("Very Low", "Low", "Medium", "High", "Critical")
RISK_BOUNDS = (0.2, 0.4, 0.6, 0.8)

# Retention actions and plan per tier.
RETENTION_ACTIONS = {
    "Critical": ("🎯 Urgent Win-Back Discount Code (25% off) | ☎️ Dedicated Customer Success Support Call | "
                 "🎁 Free Loyalty Gift with Next Order",
                 "High-priority direct retention outreach within 24 hours."),
    "High": ("✉️ Personalized Re-engagement Email Series | 🚚 Free Express Shipping Voucher | "
             "🏷️ 15% Time-Limited Re-order Coupon",
             "Targeted automated re-activation sequence within 3 days."),
    "Medium": ("📦 Category Cross-Sell Recommendation Push | ⭐ Loyalty Double-Points Bonus Offer",
               "Nudge engagement via personalized product recommendations."),
    "Low": ("👑 VIP Tier Progress Notification | 💡 Quarterly Product Catalog Update",
            "Maintain standard automated email marketing flow."),
    "Very Low": ("🌟 Advocate Review Request & Referral Link | 🚀 Early Access to New Collections",
                 "Brand advocacy and upsell focus."),
}


# ------------------------------------------------------------------ I1-I7 models

def split_train_test(df: DataFrame, label: str = LABEL, train_pct: int = 80, seed: int = 42,
                     key: str = KEY) -> tuple[DataFrame, DataFrame]:
    """I1 repeatable stratified split: a hash of the id decides, within each class alike."""
    bucket = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(100))
    return df.where(bucket < train_pct), df.where(bucket >= train_pct)


def class_weights(df: DataFrame, label: str = LABEL, out: str = "class_weight") -> DataFrame:
    """I3 balanced weights n / (2 n_c); ``fit_oversampled`` balances by new rows instead. Class
    counts are one row per class, so broadcasting them is bounded."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("__nc"))
    n = df.agg(F.count(F.lit(1))).scalar()
    return df.join(F.broadcast(counts), label).withColumn(out, n / (2.0 * F.col("__nc"))).drop("__nc")


def churn_pipeline(model: str = "gbt", features=CHURN_FEATURES, weight_col: str | None = "class_weight",
                   seed: int = 42) -> Pipeline:
    """I1/I2/I4 impute (median) -> assemble -> standardise -> classifier, as one PipelineModel
    (the scaler travels with the model: Q8 fixed)."""
    feats = list(features)
    imp = [f"{c}__imp" for c in feats]
    stages = [Imputer(inputCols=feats, outputCols=imp, strategy="median"),
              VectorAssembler(inputCols=imp, outputCol="raw_features", handleInvalid="keep"),
              StandardScaler(inputCol="raw_features", outputCol="features", withMean=True, withStd=True)]
    if model == "logistic":
        clf = LogisticRegression(labelCol=LABEL, featuresCol="features", maxIter=100)
    elif model == "random_forest":
        clf = RandomForestClassifier(labelCol=LABEL, featuresCol="features", numTrees=100, seed=seed)
    else:
        clf = GBTClassifier(labelCol=LABEL, featuresCol="features", maxIter=100, seed=seed)
    if weight_col:
        clf.setWeightCol(weight_col)
    return Pipeline(stages=[*stages, clf])


def prepare_labels(fs: DataFrame) -> DataFrame:
    return fs.withColumn(LABEL, F.col(LABEL).cast("double"))


def evaluate_classifier(pred: DataFrame, name: str) -> dict:
    """I5 accuracy, precision, recall, F1 (class 1), ROC-AUC, PR-AUC, 4 decimals."""
    mc = MulticlassClassificationEvaluator(labelCol=LABEL, predictionCol="prediction")
    out = {"model": name,
           "accuracy": mc.setMetricName("accuracy").evaluate(pred),
           "precision": mc.setMetricName("precisionByLabel").setMetricLabel(1.0).evaluate(pred),
           "recall": mc.setMetricName("recallByLabel").setMetricLabel(1.0).evaluate(pred),
           "f1": mc.setMetricName("fMeasureByLabel").setMetricLabel(1.0).evaluate(pred)}
    bc = BinaryClassificationEvaluator(labelCol=LABEL, rawPredictionCol="rawPrediction")
    out["roc_auc"] = bc.setMetricName("areaUnderROC").evaluate(pred)
    out["pr_auc"] = bc.setMetricName("areaUnderPR").evaluate(pred)
    return {k: (round(v, 4) if isinstance(v, float) else v) for k, v in out.items()}


def fit_churn_models(train: DataFrame, models, seed: int = 42) -> dict[str, PipelineModel]:
    """I1/I2/I4 a PipelineModel of each name. Imputing and scaling are the same for all and fitted once.

    Boosting runs hundreds of stages, so it and the logistic fit take the rows packed; the forest
    draws its samples by partition and keeps them as they are.
    """
    pipelines = {m: churn_pipeline(m, seed=seed).getStages() for m in models}
    steps = Pipeline(stages=next(iter(pipelines.values()))[:-1]).fit(train)
    rows = steps.transform(train).select(LABEL, "class_weight", "features").cache()
    few = packed_small(rows).cache()
    fitted = {m: PipelineModel([*steps.stages, stages[-1].fit(rows if m == "random_forest" else few)]) for m, stages in pipelines.items()}
    few.unpersist()
    rows.unpersist()
    return fitted


def train_churn_models(fs: DataFrame, models=("logistic", "random_forest", "gbt"), seed: int = 42):
    """I1-I6 fit each model on the train split, evaluate on the test split, choose by ROC-AUC.

    Returns (best PipelineModel, metrics DataFrame sorted by ROC-AUC descending). Only the
    small metrics table (one row per model) is built on the driver.
    """
    data = class_weights(prepare_labels(packed(fs))).cache()
    train, test = split_train_test(data, seed=seed)
    fitted, rows = fit_churn_models(train, models, seed), []
    for m, pm in fitted.items():
        pred = pm.transform(test).select(LABEL, "prediction", "rawPrediction").cache()
        rows.append(evaluate_classifier(pred, m))
        pred.unpersist()
    data.unpersist()
    best = max(rows, key=lambda r: r["roc_auc"])["model"]
    metrics = fs.sparkSession.createDataFrame(rows).orderBy(F.desc("roc_auc"))
    return fitted[best], metrics


def fit_oversampled(train: DataFrame, model: str = "logistic", seed: int = 42, features=CHURN_FEATURES) -> PipelineModel:
    """I3 the model fitted on rows balanced by interpolated new ones instead of class weights.

    Imputing and scaling are fitted on the real rows; the new rows are made of scaled features.
    """
    steps = churn_pipeline(model, features, weight_col=None, seed=seed).getStages()
    prepared = Pipeline(stages=steps[:-1]).fit(train)
    balanced = balanced_rows(prepared.transform(train), seed=seed)
    rows = balanced.select(F.col("label").alias(LABEL), array_to_vector("x").alias("features"))
    return PipelineModel([*prepared.stages, steps[-1].fit(rows)])


def balanced_rows(prepared: DataFrame, seed: int = 42) -> DataFrame:
    """I3 rows (id, label, x, near_id, gap) of both classes in equal number; x are the scaled features."""
    rows = prepared.select(KEY, LABEL, vector_to_array("features").alias("x"))
    return oversample(rows, label=LABEL, id_col=KEY, vector="x", written=written_table, seed=seed)


def churn_probability(model: PipelineModel, df: DataFrame, out: str = "churn_probability") -> DataFrame:
    """I7 probability of class 1 from a fitted PipelineModel (batch scoring, A10)."""
    scored = model.transform(df)
    keep = [c for c in df.columns]
    return scored.select(*keep, vector_to_array("probability")[1].alias(out))


# ------------------------------------------------------------------ I8-I12 rules and tiers

def rule_probability(df: DataFrame, method: str = "recency", out: str = "churn_probability") -> DataFrame:
    """I8 fallback probability: clip(recency / 180, .05, .95); ``method='label'`` gives the
    dashboard fallback .75 * label + .10, and .25 without a label (column or value)."""
    if method == "label":
        label = F.col(LABEL) if LABEL in df.columns else F.lit(None)
        p = F.coalesce(label.cast("double") * 0.75 + 0.10, F.lit(0.25))
    else:
        p = F.least(F.greatest(F.col("recency_days") / 180.0, F.lit(0.05)), F.lit(0.95))
    return df.withColumn(out, p)


def risk_tier(p: Column, suffix: str = "") -> Column:
    """I9 five tiers at .8/.6/.4/.2; ``suffix=' Risk'`` gives the second spelling (Q11)."""
    t = RISK_TIERS
    label = when_chain([(p >= RISK_BOUNDS[3], t[4]), (p >= RISK_BOUNDS[2], t[3]), (p >= RISK_BOUNDS[1], t[2]),
                        (p >= RISK_BOUNDS[0], t[1])], t[0])
    return F.concat(label, F.lit(suffix)) if suffix else label


def with_risk(df: DataFrame, prob: str = "churn_probability") -> DataFrame:
    return df.withColumn("risk_level", risk_tier(F.col(prob)))


def retention_dim(spark) -> DataFrame:
    rows = [(k, a, p) for k, (a, p) in RETENTION_ACTIONS.items()]
    return spark.createDataFrame(rows, "risk_level string, recommended_retention_actions string, "
                                       "retention_action_plan string")


def with_retention_actions(df: DataFrame) -> DataFrame:
    """I10 attach actions and plan by tier (5-row fixed table, broadcast)."""
    return df.join(F.broadcast(retention_dim(df.sparkSession)), "risk_level", "left")


def high_risk_roster(df: DataFrame) -> DataFrame:
    """I11 High and Critical customers, probability descending (ties by id)."""
    return df.where(F.col("risk_level").isin("High", "Critical")).orderBy(F.desc("churn_probability"), KEY)


def risk_distribution(df: DataFrame, prob: str = "churn_probability") -> DataFrame:
    """I12 customers and revenue per tier, all five tiers in fixed order."""
    tiers = [f"{t} Risk" for t in RISK_TIERS]
    agg = df.groupBy(risk_tier(F.col(prob), " Risk").alias("risk_tier")).agg(
        F.count(F.lit(1)).alias("customer_count"), money_sum("total_spending").alias("total_revenue"))
    spine = df.sparkSession.createDataFrame(list(enumerate(tiers)), "tier_rank int, risk_tier string")
    return (spine.join(agg, "risk_tier", "left")
                 .select("tier_rank", "risk_tier", F.coalesce("customer_count", F.lit(0)).alias("customer_count"),
                         F.coalesce("total_revenue", F.lit(0.0)).alias("total_revenue")))


# ------------------------------------------------------------------ I13 KPIs

def with_customer_period(df: DataFrame) -> DataFrame:
    """Q7 fixed: a customer is "current" when the last purchase is at or after the midpoint of
    the last-purchase range (the reference split the rows in half by id)."""
    b = df.agg(F.unix_micros(F.min(F.col("last_purchase_date").cast("timestamp"))).alias("lo"),
               F.unix_micros(F.max(F.col("last_purchase_date").cast("timestamp"))).alias("hi"))
    mid = b.select(F.timestamp_micros(F.col("lo") + F.floor((F.col("hi") - F.col("lo")) / 2))).scalar()
    return df.withColumn("is_current", F.col("last_purchase_date").cast("timestamp") >= mid)


def _long_kpis(wide: DataFrame, names: list[str]) -> DataFrame:
    stacked = F.explode(F.array(*[
        F.struct(F.lit(n).alias("kpi"), F.col(f"{n}_t").cast("double").alias("total"),
                 F.col(f"{n}_c").cast("double").alias("current"), F.col(f"{n}_p").cast("double").alias("previous"))
        for n in names]))
    long = wide.select(stacked.alias("k")).select("k.*")
    return long.withColumns({"change_pct": change_pct(F.col("current"), F.col("previous")),
                             "is_positive": is_positive(F.col("current"), F.col("previous"))})


def churn_kpis(scored: DataFrame, prob: str = "churn_probability") -> DataFrame:
    """I13 7 KPIs x (total, current, previous); the constant "retention estimate" is dropped (Q6)."""
    df = with_customer_period(scored)
    p = F.col(prob)
    cols = []
    for s, flag in (("t", None), ("c", F.col("is_current")), ("p", ~F.col("is_current"))):
        sel = (lambda c: c) if flag is None else (lambda c, f=flag: F.when(f, c))
        cols += [F.count(sel(F.lit(1))).alias(f"customers_{s}"),
                 F.count(sel(F.when((p >= 0.6) & (p < 0.8), 1))).alias(f"high_risk_{s}"),
                 F.count(sel(F.when(p >= 0.8, 1))).alias(f"critical_risk_{s}"),
                 F.coalesce(F.avg(sel(p)) * 100.0, F.lit(0.0)).alias(f"avg_churn_probability_{s}"),
                 F.coalesce(F.avg(sel((p >= 0.5).cast("double"))) * 100.0, F.lit(0.0)).alias(f"predicted_churn_rate_{s}"),
                 F.coalesce(F.avg(sel(F.col("historical_clv"))), F.lit(0.0)).alias(f"avg_clv_{s}"),
                 F.coalesce(money_sum(sel(F.when(p >= 0.6, F.col("historical_clv")))), F.lit(0.0))
                 .alias(f"revenue_at_risk_{s}")]
    names = ["customers", "high_risk", "critical_risk", "avg_churn_probability", "predicted_churn_rate", "avg_clv",
             "revenue_at_risk"]
    return _long_kpis(df.agg(*cols), names)


# ------------------------------------------------------------------ I14-I15 explanations

# Rule attribution weights (centre, weight) per driver.
CHURN_ATTRIBUTION = (("Recency Duration", "recency_days", 60.0, 0.005, 1),
                     ("Purchase Frequency", "total_orders", 1.5, 0.12, -1),
                     ("CSAT Satisfaction", "avg_review_score_given", 3.5, 0.08, -1),
                     ("Total Spending ($)", "total_spending", 300.0, 0.0002, -1))


def churn_attributions(df: DataFrame) -> DataFrame:
    """I14 per-customer rule attributions (3 decimals), split into risk-raising and
    risk-lowering driver lists; computed for every customer in one pass."""
    exprs = {}
    for name, c, centre, w, sign in CHURN_ATTRIBUTION:
        diff = (F.col(c) - centre) if sign > 0 else (F.lit(centre) - F.col(c))
        exprs[name] = F.round(diff * w, 3)
    structs = F.array(*[F.struct(F.lit(n).alias("driver"), e.alias("value")) for n, e in exprs.items()])
    out = df.select(KEY, *[e.alias("attr_" + n.split(" ")[0].lower()) for n, e in exprs.items()],
                    structs.alias("_a"))
    return out.select("*", F.filter("_a", lambda s: s["value"] > 0).alias("risk_drivers"),
                      F.filter("_a", lambda s: s["value"] <= 0).alias("protective_drivers")).drop("_a")


def churn_narrative(df: DataFrame, prob: str = "churn_probability") -> DataFrame:
    """I15 plain-text explanation of a score and its three drivers."""
    r, o, s = F.col("recency_days"), F.col("total_orders"), F.col("avg_review_score_given")
    def fixed(x, digits: int):  # half-even on the exact value, as in "%.1f"; no group separators
        return F.translate(F.format_number(x.cast("double"), digits), ",", "")

    # The sentences of the explanation.
    lines = F.concat_ws("\n",
        F.format_string("Customer **%s** has a predicted churn probability of **%s%%**:", F.col(KEY).cast("string"),
                        fixed(F.col(prob) * 100.0, 1)),
        F.when(r > 90, F.format_string("• **Prolonged Inactivity**: No purchases for %s consecutive days.", fixed(r, 0)))
         .otherwise(F.format_string("• **Active Recency**: Purchased recently within %s days.", fixed(r, 0))),
        F.when(o <= 1, F.lit("• **Single Order Risk**: Customer has not yet placed a repeat order."))
         .otherwise(F.format_string("• **Established Frequency**: Placed %s lifetime orders.", fixed(o, 0))),
        F.when(s <= 3.0, F.format_string("• **Low CSAT Score**: Rated previous order %s out of 5 stars.", fixed(s, 1)))
         .otherwise(F.format_string("• **High Satisfaction**: Rated previous order %s out of 5 stars.", fixed(s, 1))))
    return df.select(KEY, lines.alias("narrative"))


# ------------------------------------------------------------------ I17-I20 timelines, batch, campaigns

def purchase_timeline(master: DataFrame) -> DataFrame:
    """I17 one row per (customer, order) in time order with order value, running order count
    and days since the previous order.

    Skew-safe: instead of a window partitioned by customer (one task per customer), rows get a
    global row number over (customer, time, order) from range partitioning; a customer's first
    row number comes from a hash aggregate and the previous order from a 1:1 equi-join on
    row number - 1, so a customer holding a third of all orders is spread over many tasks.
    """
    from orbitcart.functions.ordering import with_global_row_number
    per = master.groupBy(KEY, "order_id").agg(F.min("order_purchase_timestamp").alias("ts"),
                                             money_sum("price").alias("order_value"),
                                             F.count(F.lit(1)).alias("items"),
                                             # an order's lines: a short list
                                             F.array_join(F.array_sort(F.collect_set("product_category_name_english")), ", ").alias("categories"),
                                             F.min("preferred_payment_type").alias("payment_method"))
    ranked = with_global_row_number(per, [F.col(KEY).asc(), F.col("ts").asc_nulls_first(), F.col("order_id").asc()],
                                    "__rn")
    first = ranked.groupBy(KEY).agg(F.min("__rn").alias("__first"))
    prev = ranked.select((F.col("__rn") + 1).alias("__rn"), F.col(KEY).alias("__pk"), F.col("ts").alias("__pts"))
    out = ranked.join(first, KEY).join(prev, "__rn", "left")
    gap = F.when(F.col("__pk") == F.col(KEY), days_between(F.col("ts"), F.col("__pts")))
    return out.select(KEY, "order_id", "ts", "order_value", "items", "categories", "payment_method",
                      (F.col("__rn") - F.col("__first") + 1).cast("long").alias("order_seq"),
                      gap.alias("days_since_prev"))


def batch_summary(scored: DataFrame, prob: str = "churn_probability") -> DataFrame:
    """I18 records, High+Critical count and share %, mean probability %."""
    p = F.col(prob)
    return scored.agg(F.count(F.lit(1)).alias("records"), F.count_if(p >= 0.6).alias("high_or_critical"),
                      (F.avg((p >= 0.6).cast("double")) * 100.0).alias("high_or_critical_pct"),
                      (F.avg(p) * 100.0).alias("avg_probability_pct"))


# Campaign target segments (re-aimed to real predicates, Q6).
def retention_targets(scored: DataFrame, prob: str = "churn_probability") -> DataFrame:
    """I19 real customer counts and revenue per campaign segment, one conditional pass."""
    p, clv, o = F.col(prob), F.col("historical_clv"), F.col("total_orders")
    segs = [
        ("Critical-Risk Customers (>80% churn prob)", p > 0.8),
        ("High-Value At-Risk Buyers (CLV > $1,000)", (clv > 1000) & (p >= 0.6)),
        ("High-Risk Repeat Buyers (60-80% churn prob)", (p >= 0.6) & (p < 0.8) & (o > 1)),
        ("Medium-Risk Buyers (40-60% churn prob)", (p >= 0.4) & (p < 0.6)),
        ("Loyal Customers showing early drop-off",
         F.col("rfm_segment").isin("Champions", "Loyal Customers") & (F.col("recency_days") > 60)),
        ("Gold Tier Buyers near Platinum threshold", F.col("spending_tier") == "Tier 3 - Gold"),
        ("Single-Order Buyers at risk", (o == 1) & (p >= 0.4)),
        ("Low-Risk Single-Category Buyers", (p < 0.4) & (F.col("distinct_categories_count") == 1)),
    ]
    aggs = []
    for i, (_, cond) in enumerate(segs):
        aggs += [F.count_if(cond).alias(f"n{i}"), money_sum(F.when(cond, F.col("total_spending"))).alias(f"r{i}")]
    wide = scored.agg(*aggs)
    stacked = F.explode(F.array(*[F.struct(F.lit(i).alias("priority"), F.lit(name).alias("target_segment"),
                                           F.col(f"n{i}").alias("customer_count"),
                                           F.coalesce(F.col(f"r{i}"), F.lit(0.0)).alias("total_revenue"))
                                  for i, (name, _) in enumerate(segs)]))
    return wide.select(stacked.alias("s")).select("s.*")


def search_churn_profile(scored: DataFrame, master: DataFrame, q: str) -> DataFrame:
    """I20 profile rows of customers whose id contains ``q``: probability, tier, attributions."""
    hit = scored.where(F.col(KEY).cast("string").contains(q))
    attrs = churn_attributions(hit)
    return hit.select(KEY, "churn_probability", "risk_level", "recency_days", "total_orders", "total_spending") \
              .join(attrs, KEY, "left")



# ------------------------------------------------------------------ I16 model attributions

def linear_attributions(model: PipelineModel, df: DataFrame, top: int = 3, features=CHURN_FEATURES) -> DataFrame:
    """I16 exact attributions of a linear (logistic) PipelineModel: coef_j * z_j on the
    standardised features (z_j = scaled x_j - mean_j), for every row; top-3 risk-raising and
    top-3 risk-lowering drivers by sorting the small per-row array."""
    lr = model.stages[-1]
    coefs = [float(c) for c in lr.coefficients]
    z = vector_to_array("features")
    scored = model.transform(df)
    contrib = F.array(*[F.struct(F.lit(f).alias("feature"), (z[i] * coefs[i]).alias("value"))
                        for i, f in enumerate(features)])
    srt = F.array_sort(contrib, lambda a, b: F.when(a["value"] > b["value"], -1)
                       .when(a["value"] < b["value"], 1).otherwise(0))
    return scored.select(KEY, F.slice(F.filter(srt, lambda s: s["value"] > 0), 1, top).alias("top_up"),
                         F.slice(F.reverse(F.filter(srt, lambda s: s["value"] < 0)), 1, top).alias("top_down"))


# ------------------------------------------------------------------ P11 retraining

def retrain_and_promote(incumbent: PipelineModel, fs: DataFrame, model: str = "logistic", seed: int = 7):
    """P11 fit a candidate on fresh data, score incumbent and candidate on one hold-out, and
    promote the candidate only when its ROC-AUC improves (Q18: the reference always promoted).
    Returns (chosen model, one-row decision DataFrame)."""
    data = class_weights(prepare_labels(packed(fs))).cache()
    train, hold = split_train_test(data, seed=seed)
    cand = fit_churn_models(train, [model], seed)[model]
    bc = BinaryClassificationEvaluator(labelCol=LABEL, rawPredictionCol="rawPrediction", metricName="areaUnderROC")
    old_auc, new_auc = bc.evaluate(incumbent.transform(hold)), bc.evaluate(cand.transform(hold))
    data.unpersist()
    promote = new_auc > old_auc
    decision = fs.sparkSession.createDataFrame(
        [(round(old_auc, 4), round(new_auc, 4), bool(promote))], "incumbent_auc double, candidate_auc double, promoted boolean")
    return (cand if promote else incumbent), decision
