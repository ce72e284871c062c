"""J — customer lifetime value: features/target, Spark ML regressors, tiers, opportunities,
forecasts, KPIs, leaderboard, Pareto curve, attributions and growth candidates."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbitcart.functions.columns import money_sum, trunc_like, when_chain
from orbitcart.functions.ordering import packed, with_global_running_sum
from orbitcart.functions.ranks import exact_percentiles

KEY = "customer_unique_id"
TARGET = "clv_target"
HORIZON_MONTHS = 12

# Model features (13).
CLV_FEATURES = ("total_orders", "total_items_purchased", "total_spending", "total_freight_paid", "avg_order_value",
                "avg_review_score_given", "customer_age_days", "recency_days", "purchase_frequency_monthly",
                "distinct_categories_count", "purchase_velocity", "spending_trend", "engagement_score")

# Fixed-threshold tiers (value classifier), highest first.
FIXED_TIERS = (("Platinum", 2500.0), ("Gold", 1200.0), ("Silver", 600.0), ("Bronze", 250.0))
FIXED_TIER_ORDER = ("Platinum", "Gold", "Silver", "Bronze", "Standard")
# Quantile tier labels.
QUANTILE_TIERS = ("Platinum (Top 5%)", "Gold (Top 20%)", "Silver (Top 50%)", "Bronze", "Low Value")
# Opportunity types and recommendations.
OPPORTUNITIES = (
    ("VIP Upgrade & Concierge Retainer",
     "Offer dedicated account manager, free express shipping, and quarterly preview hampers."),
    ("Subscription & High-Margin Upsell", "Pitch annual replenishment subscription and premium product add-ons."),
    ("Second Purchase Conversion Campaign", "Send triggered 15% discount on complementary product category."),
    ("High-Potential Account Nudge", "Cross-sell trending best-sellers to capture latent purchasing capacity."),
    ("Standard Re-engagement", "Include in bi-weekly promotional emails and seasonal sale alerts."),
)


# ------------------------------------------------------------------ J1-J6

def clv_features(fs: DataFrame, horizon: int = HORIZON_MONTHS) -> DataFrame:
    """J1 engineered features and J2 target = spend + frequency * AOV * horizon (kept as in the
    reference, a function of the features: Q5)."""
    o = F.col("total_orders")
    return fs.withColumns({
        "purchase_velocity": o / F.greatest(F.col("customer_age_days") / 30.0, F.lit(1.0)),
        "spending_trend": F.col("avg_order_value") * F.col("purchase_frequency_monthly"),
        "engagement_score": o * F.col("avg_review_score_given"),
        "category_diversity": F.col("distinct_categories_count") / F.greatest(o, F.lit(1)),
    }).withColumn(TARGET, F.col("total_spending") +
                  F.col("purchase_frequency_monthly") * F.col("avg_order_value") * float(horizon))


def rule_predicted_clv(df: DataFrame, out: str = "predicted_clv") -> DataFrame:
    """J6 floored prediction from the closed-form target (what the leaky regressors learn);
    the model path is ``predict_clv``."""
    return df.withColumn(out, F.greatest(F.col(TARGET), F.lit(0.0)))


def clv_pipeline(model: str = "linear", features=CLV_FEATURES, seed: int = 42) -> Pipeline:
    """J3/J4 impute -> assemble -> standardise -> regressor."""
    feats = list(features)
    imp = [f"{c}__imp" for c in feats]
    stages = [Imputer(inputCols=feats, outputCols=imp, strategy="median"),
              VectorAssembler(inputCols=imp, outputCol="raw_features", handleInvalid="keep"),
              StandardScaler(inputCol="raw_features", outputCol="features", withMean=True, withStd=True)]
    if model == "random_forest":
        reg = RandomForestRegressor(labelCol=TARGET, featuresCol="features", numTrees=100, seed=seed)
    elif model == "gbt":
        reg = GBTRegressor(labelCol=TARGET, featuresCol="features", maxIter=100, seed=seed)
    else:
        reg = LinearRegression(labelCol=TARGET, featuresCol="features")
    return Pipeline(stages=[*stages, reg])


def evaluate_regressor(pred: DataFrame, name: str) -> dict:
    """J5 MAE, RMSE, R2 (evaluator); explained variance and MAPE (denominator max(y,1)) by aggregation."""
    ev = RegressionEvaluator(labelCol=TARGET, predictionCol="prediction")
    y, yh = F.col(TARGET), F.col("prediction")
    extra = pred.agg((1.0 - F.var_pop(y - yh) / F.var_pop(y)).alias("ev"),
                     (F.avg(F.abs(y - yh) / F.greatest(y, F.lit(1.0))) * 100.0).alias("mape")).first()
    out = {"model": name, "mae": ev.setMetricName("mae").evaluate(pred), "rmse": ev.setMetricName("rmse").evaluate(pred),
           "r2": ev.setMetricName("r2").evaluate(pred), "explained_variance": extra["ev"], "mape": extra["mape"]}
    return {k: (round(v, 4) if isinstance(v, float) else v) for k, v in out.items()}


def train_clv_models(fs: DataFrame, models=("linear", "random_forest", "gbt"), seed: int = 42):
    """J3-J5 fit each regressor on an 80/20 hash split, best by R2; returns (model, metrics)."""
    data = clv_features(packed(fs))
    bucket = F.pmod(F.xxhash64(F.col(KEY), F.lit(seed)), F.lit(100))
    train, test = data.where(bucket < 80).cache(), data.where(bucket >= 80)
    fitted, rows = {}, []
    for m in models:
        pm = clv_pipeline(m, seed=seed).fit(train)
        fitted[m] = pm
        rows.append(evaluate_regressor(pm.transform(test), m))
    train.unpersist()
    best = max(rows, key=lambda r: r["r2"])["model"]
    return fitted[best], fs.sparkSession.createDataFrame(rows).orderBy(F.desc("r2"))


def predict_clv(model: PipelineModel, df: DataFrame, out: str = "predicted_clv") -> DataFrame:
    """J6 prediction floored at 0."""
    data = clv_features(df)
    return model.transform(data).select(*data.columns, F.greatest(F.col("prediction"), F.lit(0.0)).alias(out))


# ------------------------------------------------------------------ J7-J12 tiers and opportunities

def value_tiers(df: DataFrame, clv: str = "predicted_clv", out: str = "clv_value_tier",
                stats: DataFrame | None = None) -> DataFrame:
    """J7 >= p95 Platinum, >= p80 Gold, >= p50 Silver, > 0 Bronze, else Low Value."""
    q = exact_percentiles(stats if stats is not None else df, clv, [0.5, 0.8, 0.95])
    x, t = F.col(clv), QUANTILE_TIERS
    return df.withColumn(out, when_chain([(x >= q[2], t[0]), (x >= q[1], t[1]), (x >= q[0], t[2]), (x > 0, t[3])],
                                         t[4]))


def opportunities(df: DataFrame, clv: str = "predicted_clv", tier: str = "clv_value_tier") -> DataFrame:
    """J8 first matching rule gives the opportunity type and recommendation."""
    t, o, s, v = F.col(tier), F.col("total_orders"), F.col("total_spending"), F.col(clv)
    conds = [t.contains("Platinum"), t.contains("Gold") & (o >= 2), t.contains("Silver") & (o == 1),
             (s < 100) & (v > 300)]
    typ = when_chain([(c, OPPORTUNITIES[i][0]) for i, c in enumerate(conds)], OPPORTUNITIES[4][0])
    rec = when_chain([(c, OPPORTUNITIES[i][1]) for i, c in enumerate(conds)], OPPORTUNITIES[4][1])
    return df.withColumns({"revenue_opportunity_type": typ, "revenue_recommendation": rec})


def high_value_roster(df: DataFrame, clv: str = "predicted_clv", tier: str = "clv_value_tier") -> DataFrame:
    """J9 Platinum and Gold customers, CLV descending (ties by id)."""
    return df.where(F.col(tier).rlike("Platinum|Gold")).orderBy(F.desc(clv), KEY)


def monthly_projection(df: DataFrame, clv: str = "predicted_clv", months: int = 12, growth: float = 0.02) -> DataFrame:
    """J10 month i (1..12) = total / 12 * (1 + growth * (i - 1))."""
    tot = df.agg(F.sum(clv).alias("t"))
    return tot.select(F.explode(F.sequence(F.lit(1), F.lit(months))).alias("month"), "t").select(
        F.concat(F.lit("Month "), F.col("month").cast("string")).alias("forecast_month"), "month",
        (F.col("t") / float(months) * (1.0 + growth * (F.col("month") - 1))).alias("projected_revenue"))


def fixed_tier(v: Column) -> Column:
    """J11 Platinum >= 2500, Gold >= 1200, Silver >= 600, Bronze >= 250, else Standard."""
    return when_chain([(v >= b, name) for name, b in FIXED_TIERS], "Standard")


def tier_matrix(df: DataFrame, clv: str = "historical_clv") -> DataFrame:
    """J12 per fixed tier: customers, revenue, share %, mean spend, mean orders, retention %."""
    total = df.agg(F.sum("total_spending")).scalar()
    agg = df.groupBy(fixed_tier(F.col(clv)).alias("value_tier")).agg(
        F.count(F.lit(1)).alias("customer_count"), money_sum("total_spending").alias("total_revenue"),
        F.avg("total_spending").alias("avg_spending"), F.avg("total_orders").alias("avg_orders"),
        F.avg("churn_label").alias("churn_rate"))
    spine = df.sparkSession.createDataFrame(list(enumerate(FIXED_TIER_ORDER)), "tier_rank int, value_tier string")
    out = spine.join(agg, "value_tier", "left")
    return out.select("tier_rank", "value_tier", F.coalesce("customer_count", F.lit(0)).alias("customer_count"),
                      F.coalesce("total_revenue", F.lit(0.0)).alias("total_revenue"),
                      F.round(F.coalesce("total_revenue", F.lit(0.0)) / F.greatest(total, F.lit(1.0)) * 100.0, 1)
                      .alias("revenue_share_pct"),
                      F.coalesce("avg_spending", F.lit(0.0)).alias("avg_spending"),
                      F.coalesce("avg_orders", F.lit(0.0)).alias("avg_orders"),
                      F.round((1.0 - F.coalesce("churn_rate", F.lit(1.0))) * 100.0, 1).alias("retention_rate_pct"))


# ------------------------------------------------------------------ J13-J16

def clv_kpis(df: DataFrame, clv: str = "historical_clv") -> DataFrame:
    """J13 sum, mean, max CLV; customers >= 1000 and >= 2500; expected 12-month revenue (.72 x sum);
    mean spend. The constant "growth potential" card is dropped (Q6)."""
    v = F.col(clv)
    wide = df.agg(F.sum(v).alias("total_clv"), F.avg(v).alias("avg_clv"), F.max(v).alias("max_clv"),
                  F.count_if(v >= 1000).cast("double").alias("high_value_customers"),
                  F.count_if(v >= 2500).cast("double").alias("platinum_customers"),
                  (F.sum(v) * 0.72).alias("expected_12m_revenue"), F.avg("total_spending").alias("avg_spending"))
    return wide.select(F.explode(F.array(*[F.struct(F.lit(c).alias("kpi"), F.col(c).alias("value"))
                                          for c in wide.columns])).alias("k")).select("k.*")


def revenue_forecast(master: DataFrame, period: str = "monthly", trend_factor: float = 1.085,
                     future_periods: int = 3, future_step: float = 0.03) -> DataFrame:
    """J14 revenue per month / quarter / year with empty periods as 0 (a generated period spine),
    "predicted" = actual x trend_factor, variance %, and future periods at +3 % steps (Q15:
    formula kept, quarter label fixed to "Qn yyyy")."""
    unit = {"monthly": "month", "quarterly": "quarter", "annual": "year"}[period]
    step = {"month": "INTERVAL 1 MONTH", "quarter": "INTERVAL 3 MONTH", "year": "INTERVAL 1 YEAR"}[unit]
    ts = F.col("order_purchase_timestamp")
    actual = (master.where(ts.isNotNull()).groupBy(trunc_like(unit, master, "order_purchase_timestamp").alias("period_start"))
                    .agg(money_sum("price").alias("actual_revenue")))
    b = actual.agg(F.min("period_start").alias("lo"), F.max("period_start").alias("hi"))
    spine = b.select(F.explode(F.sequence("lo", "hi", F.expr(step))).alias("period_start"))
    full = spine.join(actual, "period_start", "left").fillna(0.0, ["actual_revenue"])
    hist = full.withColumns({
        "predicted_revenue": F.round(F.col("actual_revenue") * trend_factor, 2),
        "is_forecast": F.lit(False)})
    hist = hist.withColumn("variance_pct", F.round((F.col("predicted_revenue") - F.col("actual_revenue")) /
                                                   F.greatest(F.col("actual_revenue"), F.lit(1.0)) * 100.0, 1))
    last = hist.agg(F.max_by(F.struct("period_start", "predicted_revenue"), "period_start").alias("l")).select("l.*")
    fut = last.select(F.explode(F.sequence(F.lit(1), F.lit(future_periods))).alias("i"), "period_start",
                      "predicted_revenue")
    fut = fut.select(
        F.expr(f"period_start + make_interval(0, {3 if unit == 'quarter' else (12 if unit == 'year' else 1)} * i)")
        .alias("period_start"),
        F.lit(None).cast("double").alias("actual_revenue"),
        F.round(F.col("predicted_revenue") * (1.0 + future_step * F.col("i")), 2).alias("predicted_revenue"),
        F.lit(True).alias("is_forecast"), (F.col("i") * F.lit(round(future_step * 100.0, 10))).alias("variance_pct"))
    out = hist.select(*fut.columns).unionByName(fut)  # S1 UNION ALL of actuals and forecasts
    label = {"month": F.date_format("period_start", "MMM yyyy"),
             "quarter": F.concat(F.lit("Q"), F.quarter("period_start").cast("string"), F.lit(" "),
                                 F.year("period_start").cast("string")),
             "year": F.date_format("period_start", "yyyy")}[unit]
    return out.withColumn("period", label)


def leaderboard(df: DataFrame, clv: str = "historical_clv", n: int = 100) -> DataFrame:
    """J15 top-n by CLV (ties by id) with rank and fixed tier; the limit keeps n rows, so the
    rank window afterwards runs over n rows only."""
    from pyspark.sql import Window
    top = df.orderBy(F.desc(clv), KEY).limit(n)
    return top.select(F.row_number().over(Window.orderBy(F.desc(clv), KEY)).cast("long").alias("rank"), KEY,
                      F.col(clv).alias("clv"), "total_spending", "total_orders", fixed_tier(F.col(clv)).alias("value_tier"))


def clv_pareto(df: DataFrame, points: int = 20, value: str = "total_spending") -> DataFrame:
    """J16 cumulative spend share at ``points`` evenly spaced ranks; the percentile axis is
    linspace(1, 100, n) as in the reference, both rounded to 1 decimal."""
    st = df.agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("t")).select(F.struct("n", "t")).scalar()
    n, tot = st["n"], st["t"]
    r = with_global_running_sum(df.select(KEY, value), [F.desc(value), F.asc(KEY)],
                                {"rank": F.lit(1).cast("long"), "cum": F.col(value)})
    idx = F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("k")
    # sample index k -> int(k * (n - 1) / (points - 1)) (numpy linspace with dtype=int)
    picks = df.sparkSession.range(1).select(idx).select(
        F.floor(F.col("k") * (n - 1) / float(points - 1)).alias("i"))
    sel = r.join(picks.distinct(), F.col("rank") - 1 == F.col("i"), "left_semi")  # <= points rows on the right
    pct = F.when(n > 1, 1.0 + (F.col("rank") - 1) * 99.0 / (n - 1)).otherwise(F.lit(1.0))
    return sel.select("rank", F.round(pct, 1).alias("customer_percentile"),
                      F.round(F.col("cum") / F.greatest(tot, F.lit(1.0)) * 100.0, 1).alias("cumulative_revenue_pct"))


# ------------------------------------------------------------------ J17-J19

# CLV rule attribution (name, column, centre, weight).
CLV_ATTRIBUTION = (("Historical Spending ($)", "total_spending", 100.0, 0.45),
                   ("Average Order Value ($)", "avg_order_value", 80.0, 0.35),
                   ("Order Frequency", "total_orders", 1.0, 45.0),
                   ("Loyalty Score Index", "loyalty_score", 40.0, 2.5))


def clv_attributions(df: DataFrame) -> DataFrame:
    """J17 per-customer rule attributions (2 decimals), value-raising and value-lowering lists."""
    exprs = {n: F.round((F.col(c) - centre) * w, 2) for n, c, centre, w in CLV_ATTRIBUTION}
    structs = F.array(*[F.struct(F.lit(n).alias("driver"), e.alias("value")) for n, e in exprs.items()])
    out = df.select(KEY, *[e.alias("attr_" + n.split(" ")[0].lower()) for n, e in exprs.items()], structs.alias("_a"))
    return out.select("*", F.filter("_a", lambda s: s["value"] > 0).alias("value_drivers"),
                      F.filter("_a", lambda s: s["value"] <= 0).alias("value_drags")).drop("_a")


def growth_candidates(df: DataFrame, clv: str = "historical_clv") -> DataFrame:
    """J18 real candidate counts and CLV per growth rule group (re-aimed, Q6)."""
    v, tier = F.col(clv), fixed_tier(F.col(clv))
    groups = [
        ("Premium upsell: Gold with AOV > 200", (tier == "Gold") & (F.col("avg_order_value") > 200)),
        ("Category expansion: single category, 1-2 orders",
         (F.col("distinct_categories_count") == 1) & F.col("total_orders").between(1, 2)),
        ("Tier upgrade: Gold within 20% of Platinum", (tier == "Gold") & (v >= 2000)),
        ("Win-back: Platinum/Gold idle > 45 days", tier.isin("Platinum", "Gold") & (F.col("recency_days") > 45)),
        ("Second purchase: one order, recent", (F.col("total_orders") == 1) & (F.col("recency_days") <= 90)),
    ]
    aggs = []
    for i, (_, c) in enumerate(groups):
        aggs += [F.count_if(c).alias(f"n{i}"), F.sum(F.when(c, v)).alias(f"v{i}")]
    wide = df.agg(*aggs)
    st = F.explode(F.array(*[F.struct(F.lit(i).alias("priority"), F.lit(g).alias("opportunity_group"),
                                      F.col(f"n{i}").alias("candidate_count"),
                                      F.coalesce(F.col(f"v{i}"), F.lit(0.0)).alias("total_clv"))
                             for i, (g, _) in enumerate(groups)]))
    return wide.select(st.alias("s")).select("s.*")


#: J18 the least growth and the least drop of spend from one period to the next that count.
GROWING, DECLINING = 1.30, 0.75


def spend_of_periods(master: DataFrame, days: int = 30) -> DataFrame:
    """Per customer: spend of the last ``days`` days of the data and of those before."""
    ts = F.unix_micros(F.col("order_purchase_timestamp").cast("timestamp"))
    end = master.agg(F.max(ts).alias("e")).scalar()
    back = F.floor((end - ts) / F.lit(days * 86_400_000_000))
    near = master.withColumn("period", back).where(F.col("period").isin(0, 1))
    return near.groupBy(KEY).agg(F.coalesce(money_sum(F.when(F.col("period") == 0, F.col("price"))), F.lit(0.0)).alias("spend_last"),
                                 F.coalesce(money_sum(F.when(F.col("period") == 1, F.col("price"))), F.lit(0.0)).alias("spend_before"))


def spend_movers(df: DataFrame, master: DataFrame, days: int = 30, clv: str = "historical_clv") -> DataFrame:
    """J18 the two groups by movement of spend: Silver accounts that grow, and all that decline (they
    spent before). Customers without a sale in either period are in none."""
    moved = df.select(KEY, clv).join(spend_of_periods(master, days).where("spend_before > 0"), KEY)
    groups = [("Growing: Silver with spend up 30%", (fixed_tier(F.col(clv)) == "Silver") & (F.col("spend_last") >= F.col("spend_before") * GROWING)),
              ("Declining: spend down 25%", F.col("spend_last") <= F.col("spend_before") * DECLINING)]
    wide = moved.agg(*[a for i, (_, c) in enumerate(groups) for a in (F.count_if(c).alias(f"n{i}"), F.sum(F.when(c, F.col(clv))).alias(f"v{i}"))])
    rows = F.explode(F.array(*[F.struct(F.lit(g).alias("opportunity_group"), F.col(f"n{i}").alias("candidate_count"),
                                        F.coalesce(F.col(f"v{i}"), F.lit(0.0)).alias("total_clv")) for i, (g, _) in enumerate(groups)]))
    return wide.select(rows.alias("s")).select("s.*")


def search_clv_profile(df: DataFrame, q: str, clv: str = "historical_clv") -> DataFrame:
    """J19 customers whose id contains ``q``; if none, segments/tiers whose name contains it
    with customer count, total and mean CLV."""
    ids = df.where(F.col(KEY).cast("string").contains(q)).select(
        F.lit("customer").alias("match_type"), F.col(KEY).cast("string").alias("match_key"),
        F.lit(1).cast("long").alias("customers"), F.col(clv).alias("total_clv"), F.col(clv).alias("avg_clv"))
    segs = df.select(F.explode(F.array("rfm_segment", "spending_tier")).alias("seg"), clv) \
             .where(F.lower("seg").contains(q.lower())).groupBy("seg").agg(
                 F.count(F.lit(1)).alias("customers"), F.sum(clv).alias("total_clv"), F.avg(clv).alias("avg_clv"))
    seg_rows = segs.select(F.lit("segment").alias("match_type"), F.col("seg").alias("match_key"), "customers",
                           "total_clv", "avg_clv")
    n_ids = ids.agg(F.count(F.lit(1))).scalar()
    return ids.unionByName(seg_rows.where(n_ids == 0))
