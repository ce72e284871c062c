"""M — executive analytics and interactive slicing over the master.

Scale notes: KPIs are computed in one pass of multi-level pre-aggregation (item -> order ->
customer -> one row) instead of several ``count(distinct)`` aggregates, which Spark would
plan with an Expand that multiplies the input rows once per distinct expression. Small
lookups (state coordinates: 27 fixed rows) are broadcast; everything else is left to AQE.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orbitcart.functions.columns import first_present, money_sum, trunc_like

KEY = "customer_unique_id"
TS = "order_purchase_timestamp"

# State code -> (name, latitude, longitude); unknown states get the default.
STATE_COORDS = {
    "SP": ("São Paulo", -23.55, -46.63), "RJ": ("Rio de Janeiro", -22.90, -43.17),
    "MG": ("Minas Gerais", -19.92, -43.93), "RS": ("Rio Grande do Sul", -30.03, -51.23),
    "PR": ("Paraná", -25.42, -49.27), "SC": ("Santa Catarina", -27.59, -48.54),
    "BA": ("Bahia", -12.97, -38.51), "DF": ("Distrito Federal", -15.78, -47.92),
    "ES": ("Espírito Santo", -20.31, -40.31), "GO": ("Goiás", -16.68, -49.25),
    "PE": ("Pernambuco", -8.05, -34.88), "CE": ("Ceará", -3.71, -38.54),
    "PA": ("Pará", -1.45, -48.50), "MT": ("Mato Grosso", -15.60, -56.09),
    "MA": ("Maranhão", -2.53, -44.30), "MS": ("Mato Grosso do Sul", -20.44, -54.64),
    "PB": ("Paraíba", -7.11, -34.86), "PI": ("Piauí", -5.09, -42.80),
    "RN": ("Rio Grande do Norte", -5.79, -35.20), "AL": ("Alagoas", -9.66, -35.73),
    "SE": ("Sergipe", -10.91, -37.07), "TO": ("Tocantins", -10.18, -48.33),
    "RO": ("Rondônia", -8.76, -63.90), "AM": ("Amazonas", -3.10, -60.02),
    "AC": ("Acre", -9.97, -67.80), "AP": ("Aapá", 0.03, -51.06), "RR": ("Roraima", 2.82, -60.67),
}
DEFAULT_LAT, DEFAULT_LON = -14.23, -51.92

PAYMENT_COLUMNS = ("payment_type", "preferred_payment_type", "preferred_payment_method")
CATEGORY_COLUMNS = ("product_category_name_english", "product_category_name")


def pretty(c: str | Column) -> Column:
    """'bed_bath_table' -> 'Bed Bath Table' (underscores to spaces, then initcap)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.initcap(F.regexp_replace(c.cast("string"), "_", " "))


def state_dim(spark: SparkSession) -> DataFrame:
    rows = [(k, n, lat, lon) for k, (n, lat, lon) in STATE_COORDS.items()]
    return spark.createDataFrame(rows, "state_code string, state_name string, lat double, lon double")


def with_state_coords(df: DataFrame, state_col: str) -> DataFrame:
    """D16 left join of the fixed state table (27 rows: broadcast is bounded)."""
    dim = state_dim(df.sparkSession)
    out = df.join(F.broadcast(dim), F.upper(F.col(state_col)) == dim.state_code, "left")
    return out.withColumns({
        "state_name": F.coalesce(F.col("state_name"), F.upper(F.col(state_col))),
        "lat": F.coalesce(F.col("lat"), F.lit(DEFAULT_LAT)),
        "lon": F.coalesce(F.col("lon"), F.lit(DEFAULT_LON)),
    }).drop("state_code")


# ------------------------------------------------------------------ order facts

def order_facts(master: DataFrame) -> DataFrame:
    """One row per order: customer, purchase time, customer state, revenue (cents), item rows and
    rating sum/count. Order-level queries read this (about a quarter of the item rows) instead of
    re-aggregating the master; every column is exactly what they would compute per order."""
    return master.groupBy(KEY, "order_id").agg(
        F.min(TS).alias(TS), F.min("customer_state").alias("customer_state"),
        money_sum("price").alias("rev"), F.count("order_item_id").alias("items"),
        F.sum("avg_review_score").alias("rs"), F.count("avg_review_score").alias("rn"))


# ------------------------------------------------------------------ M1-M8 chart tables

def revenue_trend(master: DataFrame, granularity: str = "monthly", orders: DataFrame | None = None) -> DataFrame:
    """M1 revenue and distinct orders per day / week (Monday start) / month."""
    g = granularity.lower()
    unit = {"daily": "day", "weekly": "week", "monthly": "month"}[g]
    if orders is not None:
        per_order = orders.where(F.col(TS).isNotNull()).select(
            trunc_like(unit, orders, TS).alias("period_start"), "order_id", "rev")
    else:
        per_order = (master.where(F.col(TS).isNotNull())
                     .groupBy(trunc_like(unit, master, TS).alias("period_start"), "order_id")
                     .agg(money_sum("price").alias("rev")))
    out = per_order.groupBy("period_start").agg(money_sum("rev").alias("revenue"),
                                                F.count(F.lit(1)).alias("order_count"))
    return out.withColumn("period", _label(F.col("period_start"), g)).orderBy("period_start")


def _label(start: Column, g: str) -> Column:
    if g == "daily":
        return F.date_format(start, "yyyy-MM-dd")
    if g == "weekly":
        return F.concat(F.date_format(start, "yyyy-MM-dd"), F.lit("/"),
                        F.date_format(F.date_add(start, 6), "yyyy-MM-dd"))
    return F.date_format(start, "MMM yyyy")


def customer_growth(master: DataFrame, orders: DataFrame | None = None) -> DataFrame:
    """M2 per month: distinct customers, new (first purchase month), returning."""
    src = orders if orders is not None else master
    cm = (src.where(F.col(TS).isNotNull())
          .select(KEY, trunc_like("month", src, TS).alias("month_start")).distinct())
    first = cm.groupBy(KEY).agg(F.min("month_start").alias("first_month"))
    tagged = cm.join(first, KEY)
    out = tagged.groupBy("month_start").agg(
        F.count(F.lit(1)).alias("total_customers"),
        F.count_if(F.col("first_month") == F.col("month_start")).alias("new_customers"))
    return out.withColumns({
        "month": F.date_format("month_start", "MMM yyyy"),
        "returning_customers": F.greatest(F.col("total_customers") - F.col("new_customers"), F.lit(0)),
    }).orderBy("month_start")


def revenue_by_category(master: DataFrame) -> DataFrame:
    """M3 revenue and distinct orders per category, revenue descending."""
    cat = first_present(master, CATEGORY_COLUMNS)
    per = (master.where(F.col(cat).isNotNull())
           .groupBy(cat, "order_id").agg(money_sum("price").alias("rev")))
    out = per.groupBy(cat).agg(money_sum("rev").alias("revenue"), F.count(F.lit(1)).alias("order_count"))
    return out.select(pretty(cat).alias("category"), "revenue", "order_count").orderBy(F.desc("revenue"))


def revenue_by_state(master: DataFrame, orders: DataFrame | None = None) -> DataFrame:
    """M4 revenue, distinct customers and centroid per customer state."""
    if orders is not None:
        state = "customer_state"
        per = orders.where(F.col(state).isNotNull()).groupBy(state, KEY).agg(money_sum("rev").alias("rev"))
    else:
        state = first_present(master, ["customer_state", "seller_state"])
        per = (master.where(F.col(state).isNotNull())
               .groupBy(state, KEY).agg(money_sum("price").alias("rev")))
    agg = per.groupBy(F.col(state).alias("state")).agg(money_sum("rev").alias("revenue"),
                                                       F.count(F.lit(1)).alias("customer_count"))
    return with_state_coords(agg, "state").orderBy(F.desc("revenue"))


def payment_distribution(master: DataFrame) -> DataFrame:
    """M5 rows and revenue per payment method (reads preferred_payment_type too: Q2 fixed)."""
    pm = first_present(master, PAYMENT_COLUMNS)
    agg = master.where(F.col(pm).isNotNull()).groupBy(pm).agg(
        F.count("price").alias("transaction_count"), money_sum("price").alias("total_revenue"))
    return agg.select(pretty(pm).alias("payment_method"), "transaction_count", "total_revenue") \
              .orderBy(F.desc("total_revenue"))


def order_status_distribution(master: DataFrame) -> DataFrame:
    """M6 item rows per order status."""
    agg = master.where(F.col("order_status").isNotNull()).groupBy("order_status").count()
    return agg.select(pretty("order_status").alias("order_status"), F.col("count").alias("row_count"))


def top_products(master: DataFrame, n: int = 10) -> DataFrame:
    """M7 top-n products by revenue (units and category), ties by product id."""
    cat = first_present(master, CATEGORY_COLUMNS)
    agg = master.groupBy("product_id").agg(
        money_sum("price").alias("revenue"), F.count(F.lit(1)).alias("units_sold"),
        F.min(cat).alias("category"))
    agg = agg.withColumn("category", pretty(F.coalesce(F.col("category"), F.lit("General"))))
    return agg.orderBy(F.desc("revenue"), "product_id").limit(n)


def ratings_histogram(master: DataFrame, rating_col: str | None = None) -> DataFrame:
    """M8 item rows per rounded rating (half to even, like pandas), 1..5 with zeros."""
    rc = rating_col or first_present(master, ["avg_review_score", "review_score"])
    stars = F.bround(F.col(rc), 0).cast("int")
    counts = (master.where(F.col(rc).isNotNull()).select(stars.alias("star"))
              .where(F.col("star").between(1, 5)).groupBy("star").count())
    spine = master.sparkSession.range(1, 6).select(F.col("id").cast("int").alias("star"))
    out = spine.join(counts, "star", "left")
    return out.select("star",
                      F.concat(F.col("star").cast("string"), F.lit(" Star"),
                               F.when(F.col("star") > 1, F.lit("s")).otherwise(F.lit(""))).alias("star_rating"),
                      F.coalesce(F.col("count"), F.lit(0)).cast("long").alias("row_count"))


# ------------------------------------------------------------------ M9-M10 insights

def business_insights(master: DataFrame, fs: DataFrame | None = None) -> DataFrame:
    """M9 arg-max / arg-min insight rows: (insight, value, metric)."""
    cat = first_present(master, CATEGORY_COLUMNS)
    cats = revenue_by_category(master)
    rows = [cats.select(F.lit("Highest Revenue Category").alias("insight"), F.col("category").alias("value"),
                        F.col("revenue").alias("metric"))
            .orderBy(F.desc("metric"), "value").limit(1)]
    states = revenue_by_state(master)
    rows.append(states.select(F.lit("Best Performing State"), F.col("state"), F.col("revenue"))
                .orderBy(F.desc("revenue"), "state").limit(1))
    if fs is not None and "rfm_segment" in fs.columns:
        seg = fs.groupBy("rfm_segment").count()
        rows.append(seg.select(F.lit("Largest Segment"), pretty("rfm_segment"), F.col("count").cast("double"))
                    .orderBy(F.desc("count"), "rfm_segment").limit(1))
    pays = payment_distribution(master)
    rows.append(pays.select(F.lit("Most Popular Payment"), F.col("payment_method"), F.col("total_revenue"))
                .orderBy(F.desc("total_revenue"), "payment_method").limit(1))
    sellers = master.groupBy("seller_id").agg(money_sum("price").alias("rev"))
    rows.append(sellers.select(F.lit("Top Performing Seller"), F.col("seller_id").cast("string"), F.col("rev"))
                .orderBy(F.desc("rev"), "seller_id").limit(1))
    rated = master.where(F.col(cat).isNotNull()).groupBy(cat).agg(F.avg("avg_review_score").alias("r"))
    rows.append(rated.select(F.lit("Lowest Rated Category"), pretty(cat), F.col("r"))
                .orderBy("r", cat).limit(1))
    named = [r.toDF("insight", "value", "metric") for r in rows]
    return functools.reduce(DataFrame.unionByName, named)


def executive_summary(master: DataFrame, fs: DataFrame | None = None,
                      orders: DataFrame | None = None) -> DataFrame:
    """M10 one row: revenue, share from repeat customers, top category and state, text."""
    if orders is not None and fs is not None and "is_repeat_customer" in fs.columns:
        m = orders.select(KEY, F.col("rev").alias("price")).join(fs.select(KEY, "is_repeat_customer"), KEY, "left")
    elif fs is not None and "is_repeat_customer" in fs.columns:
        m = master.join(fs.select(KEY, "is_repeat_customer"), KEY, "left")
    else:
        per = master.groupBy(KEY).agg(F.countDistinct("order_id").alias("__o"))
        m = master.join(per.select(KEY, (F.col("__o") > 1).cast("int").alias("is_repeat_customer")), KEY, "left")
    tot = m.agg(money_sum("price").alias("total_revenue"),
                money_sum(F.when(F.col("is_repeat_customer") == 1, F.col("price"))).alias("repeat_revenue"))
    top_cat = revenue_by_category(master).orderBy(F.desc("revenue"), "category").limit(1) \
        .select("category").scalar()
    top_state = revenue_by_state(master, orders).orderBy(F.desc("revenue"), "state").limit(1) \
        .select("state_name").scalar()
    out = tot.select(
        "total_revenue",
        F.round(F.when(F.col("total_revenue") > 0, F.col("repeat_revenue") * 100.0 / F.col("total_revenue"))
                .otherwise(F.lit(0.0)), 1).alias("repeat_revenue_pct"),
        top_cat.alias("top_category"), top_state.alias("top_state"))
    # Fixed value: the summary's wording.
    text = ("📌 **Executive Overview**: Enterprise Gross Revenue reached **$%,.2f** with robust growth. "
            "Returning customer transactions accounted for **%.1f%%** of total sales volume. "
            "**%s** remains the highest-performing product sector, while **%s** leads all geographic territories in orders and revenue.")
    return out.withColumn("summary", F.format_string(
        text, F.col("total_revenue"), F.col("repeat_revenue_pct"), F.col("top_category"), F.col("top_state")))


# ------------------------------------------------------------------ M11-M14 KPIs

def period_midpoint(master: DataFrame) -> Column:
    """M12 midpoint of [min ts, max ts] as a scalar timestamp."""
    ts = F.col(TS).cast("timestamp")
    b = master.agg(F.unix_micros(F.min(ts)).alias("lo"), F.unix_micros(F.max(ts)).alias("hi"))
    return b.select(F.timestamp_micros(F.col("lo") + F.floor((F.col("hi") - F.col("lo")) / 2))).scalar()


def with_period_flag(master: DataFrame, mid: Column | None = None) -> DataFrame:
    """M12 ``is_current`` = purchase at or after the midpoint."""
    mid = mid if mid is not None else period_midpoint(master)
    return master.withColumn("is_current", F.col(TS).cast("timestamp") >= mid)


def monthly_growth(master: DataFrame, orders: DataFrame | None = None) -> DataFrame:
    """M13 growth % of the last month vs the prior one, and prior vs the one before.

    Denominators are floored at 1; months with no sale do not appear; with too few months a
    growth is null.
    """
    if orders is not None:
        monthly = (orders.where(F.col(TS).isNotNull())
                   .groupBy(F.date_trunc("month", F.col(TS)).alias("month_start"))
                   .agg(money_sum("rev").alias("revenue")))
    else:
        monthly = (master.where(F.col(TS).isNotNull())
                   .groupBy(F.date_trunc("month", F.col(TS)).alias("month_start"))
                   .agg(money_sum("price").alias("revenue")))
    last3 = monthly.orderBy(F.desc("month_start")).limit(3)  # top-k, then a window over 3 rows
    ranked = last3.withColumn("k", F.row_number().over(Window.orderBy(F.desc("month_start"))))
    piv = ranked.agg(F.max(F.when(F.col("k") == 1, F.col("revenue"))).alias("m1"),
                     F.max(F.when(F.col("k") == 2, F.col("revenue"))).alias("m2"),
                     F.max(F.when(F.col("k") == 3, F.col("revenue"))).alias("m3"),
                     F.count(F.lit(1)).alias("months"))
    g = lambda a, b: (F.col(a) - F.col(b)) / F.greatest(F.col(b), F.lit(1.0)) * 100.0
    return piv.select(F.when(F.col("months") >= 2, g("m1", "m2")).alias("growth_current"),
                      F.when(F.col("months") >= 3, g("m2", "m3")).alias("growth_previous"))


def health_score(retention: Column, rating: Column, growth: Column) -> Column:
    """M14 .35 clip(retention) + .35 clip(rating*20) + .30 clip(growth+50), one decimal."""
    clip = lambda x: F.least(F.lit(100.0), F.greatest(F.lit(0.0), x))
    return F.round(clip(retention) * 0.35 + clip(rating / 5.0 * 100.0) * 0.35 + clip(growth + 50.0) * 0.30, 1)


def change_pct(cur: Column, prev: Column) -> Column:
    return F.when((prev == 0) | prev.isNull(), F.lit(0.0)).otherwise(F.abs((cur - prev) / F.abs(prev) * 100.0))


def is_positive(cur: Column, prev: Column) -> Column:
    return F.when((prev == 0) | prev.isNull(), F.lit(True)).otherwise(cur >= prev)


def executive_kpis(master: DataFrame, fs: DataFrame | None = None, orders: DataFrame | None = None) -> DataFrame:
    """M11 8 KPIs x (total, current, previous, change %, positive?) in one pass over the master
    (or over its order facts, which hold exactly the per-order sums this pass needs)."""
    cur = F.col("is_current")
    if orders is not None:
        per_order = with_period_flag(orders).select(KEY, "order_id", "is_current", "rev", "rs", "rn")
    else:
        m = with_period_flag(master)
        per_order = m.groupBy(KEY, "order_id", "is_current").agg(
            money_sum("price").alias("rev"), F.sum("avg_review_score").alias("rs"),
            F.count("avg_review_score").alias("rn"))
    per_cust = per_order.groupBy(KEY).agg(
        money_sum("rev").alias("rev"), money_sum(F.when(cur, F.col("rev"))).alias("rev_c"),
        money_sum(F.when(~cur, F.col("rev"))).alias("rev_p"),
        F.count(F.lit(1)).alias("o"), F.count_if(cur).alias("o_c"), F.count_if(~cur).alias("o_p"),
        F.sum("rs").alias("rs"), F.sum(F.when(cur, F.col("rs"))).alias("rs_c"),
        F.sum(F.when(~cur, F.col("rs"))).alias("rs_p"),
        F.sum("rn").alias("rn"), F.sum(F.when(cur, F.col("rn"))).alias("rn_c"),
        F.sum(F.when(~cur, F.col("rn"))).alias("rn_p"))
    t = per_cust.agg(
        money_sum("rev").alias("rev"), money_sum("rev_c").alias("rev_c"), money_sum("rev_p").alias("rev_p"),
        F.sum("o").alias("o"), F.sum("o_c").alias("o_c"), F.sum("o_p").alias("o_p"),
        F.count(F.lit(1)).alias("cu"), F.count_if(F.col("o_c") > 0).alias("cu_c"),
        F.count_if(F.col("o_p") > 0).alias("cu_p"),
        (F.sum("rs") / F.sum("rn")).alias("ra"), (F.sum("rs_c") / F.sum("rn_c")).alias("ra_c"),
        (F.sum("rs_p") / F.sum("rn_p")).alias("ra_p"))
    if fs is not None and "churn_label" in fs.columns:
        retention = fs.agg(F.least(F.lit(100.0), F.greatest(F.lit(0.0), 100.0 - F.avg("churn_label") * 100.0))
                           ).scalar()
        ret_c = ret_p = retention
    else:
        rep = per_cust.agg((F.avg((F.col("o") > 1).cast("double")) * 100.0).alias("x"),
                           (F.avg(F.when(F.col("o_c") > 0, (F.col("o_c") > 1).cast("double"))) * 100.0).alias("y"),
                           (F.avg(F.when(F.col("o_p") > 0, (F.col("o_p") > 1).cast("double"))) * 100.0).alias("z"))
        packed = rep.select(F.struct("x", "y", "z")).scalar()
        retention, ret_c, ret_p = packed["x"], packed["y"], packed["z"]
    growth = monthly_growth(master, orders).select(F.struct("growth_current", "growth_previous")).scalar()
    g_c, g_p = growth["growth_current"], growth["growth_previous"]
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    wide = t.select(
        F.col("rev").alias("total_revenue_t"), zero(F.col("rev_c")).alias("total_revenue_c"),
        zero(F.col("rev_p")).alias("total_revenue_p"),
        F.col("o").cast("double").alias("total_orders_t"), F.col("o_c").cast("double").alias("total_orders_c"),
        F.col("o_p").cast("double").alias("total_orders_p"),
        F.col("cu").cast("double").alias("total_customers_t"), F.col("cu_c").cast("double").alias("total_customers_c"),
        F.col("cu_p").cast("double").alias("total_customers_p"),
        (F.col("rev") / F.greatest(F.col("o"), F.lit(1))).alias("avg_order_value_t"),
        (zero(F.col("rev_c")) / F.greatest(F.col("o_c"), F.lit(1))).alias("avg_order_value_c"),
        (zero(F.col("rev_p")) / F.greatest(F.col("o_p"), F.lit(1))).alias("avg_order_value_p"),
        zero(F.col("ra")).alias("avg_rating_t"), zero(F.col("ra_c")).alias("avg_rating_c"),
        zero(F.col("ra_p")).alias("avg_rating_p"),
        retention.alias("retention_rate_t"), ret_c.alias("retention_rate_c"), ret_p.alias("retention_rate_p"),
        g_c.alias("monthly_growth_t"), g_c.alias("monthly_growth_c"), g_p.alias("monthly_growth_p"))
    wide = wide.select("*",
                       health_score(F.col("retention_rate_t"), F.col("avg_rating_t"), g_c).alias("health_score_t"),
                       health_score(F.col("retention_rate_c"), F.col("avg_rating_c"), g_c).alias("health_score_c"),
                       health_score(F.col("retention_rate_p"), F.col("avg_rating_p"), g_p).alias("health_score_p"))
    names = ["total_revenue", "total_orders", "total_customers", "avg_order_value", "avg_rating",
             "retention_rate", "monthly_growth", "health_score"]
    stacked = F.explode(F.array(*[
        F.struct(F.lit(n).alias("kpi"), F.col(f"{n}_t").alias("total"), F.col(f"{n}_c").alias("current"),
                 F.col(f"{n}_p").alias("previous")) for n in names]))
    long = wide.select(stacked.alias("k")).select("k.*")
    return long.withColumns({"change_pct": change_pct(F.col("current"), F.col("previous")),
                             "is_positive": is_positive(F.col("current"), F.col("previous"))})


# ------------------------------------------------------------------ M16-M18 filters

def filter_customers(customers: DataFrame, *, risk_levels: Sequence[str] | None = None, tiers: Sequence[str] | None = None,
                     clv_range: tuple[float, float] | None = None, tier_col: str = "clv_value_tier",
                     clv_col: str = "historical_clv") -> DataFrame:
    """M17 customers of given risk levels, value tiers and CLV range."""
    out = customers
    if risk_levels:
        out = out.where(F.col("risk_level").isin(list(risk_levels)))
    if tiers:
        out = out.where(F.col(tier_col).isin(list(tiers)))
    if clv_range:
        out = out.where(F.col(clv_col).between(float(clv_range[0]), float(clv_range[1])))
    return out


def filter_master(master: DataFrame, fs: DataFrame | None = None, *, start=None, end=None,
                  states: Sequence[str] | None = None, categories: Sequence[str] | None = None,
                  sellers: Sequence | None = None, payments: Sequence[str] | None = None,
                  segments: Sequence[str] | None = None, cities: Sequence[str] | None = None,
                  price_range: tuple[float, float] | None = None, customers: DataFrame | None = None) -> DataFrame:
    """M16/M17 slice the master; predicates are plain column filters, and ``customers`` (as from
    ``filter_customers``) keeps the items of those customers."""
    preds: list[Column] = []
    if start is not None:
        preds.append(F.col(TS) >= F.lit(start).cast("timestamp"))
    if end is not None:
        preds.append(F.col(TS) <= F.lit(end).cast("timestamp"))
    if states:
        st = [s.upper() for s in states]
        ors = [F.upper(F.col(c)).isin(st) for c in ("customer_state", "seller_state") if c in master.columns]
        preds.append(functools.reduce(lambda a, b: a | b, ors))
    if categories:
        preds.append(F.col(first_present(master, CATEGORY_COLUMNS)).isin(list(categories)))
    if sellers:
        preds.append(F.col("seller_id").isin(list(sellers)))
    if payments:
        preds.append(F.lower(F.col(first_present(master, PAYMENT_COLUMNS))).isin([p.lower() for p in payments]))
    if cities:
        preds.append(F.col("customer_city").isin(list(cities)))
    if price_range:
        preds.append(F.col("price").between(float(price_range[0]), float(price_range[1])))
    out = master.where(functools.reduce(lambda a, b: a & b, preds)) if preds else master
    if segments and fs is not None:
        seg_cols = [c for c in ("rfm_segment", "spending_tier", "clv_value_tier", "cluster_name") if c in fs.columns]
        ids = fs.where(functools.reduce(lambda a, b: a | b, [F.col(c).isin(list(segments)) for c in seg_cols]))
        out = out.join(ids.select(KEY), KEY, "left_semi")
    if customers is not None:
        out = out.join(customers.select(KEY), KEY, "left_semi")
    return out


def filter_options(master: DataFrame, fs: DataFrame | None = None) -> DataFrame:
    """M18 distinct values per filter dimension as a long (dimension, value) table."""
    dims = {"customer_state": "customer_state", "seller_state": "seller_state",
            "category": first_present(master, CATEGORY_COLUMNS),
            "payment": first_present(master, PAYMENT_COLUMNS), "order_status": "order_status"}
    parts = [master.select(F.lit(d).alias("dimension"), F.col(c).cast("string").alias("value"))
             for d, c in dims.items() if c and c in master.columns]
    if fs is not None:
        for c in ("rfm_segment", "spending_tier"):
            if c in fs.columns:
                parts.append(fs.select(F.lit("segment").alias("dimension"), F.col(c).cast("string").alias("value")))
    return functools.reduce(DataFrame.unionByName, parts).where(F.col("value").isNotNull()).distinct()


def united_options(master: DataFrame, fs: DataFrame | None = None) -> DataFrame:
    """S2 distinct (dimension, value): states of customers and sellers as one list, and segments of all schemes as one."""
    lists = {"state": [(master, c) for c in ("customer_state", "seller_state")],
             "segment": [(t, c) for t in (master, fs) if t is not None for c in ("rfm_segment", "spending_tier", "clv_value_tier")]}
    parts = [t.select(F.lit(name).alias("dimension"), F.col(c).cast("string").alias("value")).distinct()
             for name, sources in lists.items() for t, c in sources if c in t.columns]
    return functools.reduce(DataFrame.unionByName, parts).where(F.col("value").isNotNull()).distinct()


def date_bounds(master: DataFrame) -> DataFrame:
    return master.agg(F.min(TS).alias("min_date"), F.max(TS).alias("max_date"))


# ------------------------------------------------------------------ M20 payload

def dashboard_payload(master: DataFrame, fs: DataFrame | None = None, **filters) -> dict[str, DataFrame]:
    """M20 the executive page in one call: one filtered master and its order facts (each
    persisted once, shared by all tables), KPIs, eight chart tables, insights, summary and
    filter options."""
    from pyspark import StorageLevel
    m = filter_master(master, fs, **filters).persist(StorageLevel.MEMORY_AND_DISK)
    o = order_facts(m).persist(StorageLevel.MEMORY_AND_DISK)  # facts of this slice, shared below
    return {"kpis": executive_kpis(m, fs, o), "revenue_trend": revenue_trend(m, "monthly", o),
            "customer_growth": customer_growth(m, o), "category_revenue": revenue_by_category(m),
            "state_revenue": revenue_by_state(m, o), "payment_methods": payment_distribution(m),
            "order_status": order_status_distribution(m), "top_products": top_products(m, 10),
            "ratings": ratings_histogram(m), "insights": business_insights(m, fs),
            "summary": executive_summary(m, fs, o), "filter_options": filter_options(master, fs)}
