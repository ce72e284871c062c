"""N — customer analytics: KPIs, demographics, behaviour, loyalty, revenue concentration, activity."""

from __future__ import annotations

import functools
import weakref

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbitcart.functions.columns import money_sum, trunc_like, when_chain
from orbitcart.functions.ordering import with_global_running_sum
from orbitcart.operators.executive import (KEY, TS, change_pct, is_positive, pretty, with_period_flag,
                                           with_state_coords)


def _buckets(df: DataFrame, label: Column, labels: list[str], name: str) -> DataFrame:
    """Count rows per bucket label with every label present (zeros filled), in label order."""
    counts = df.select(label.alias(name)).where(F.col(name).isNotNull()).groupBy(name) \
               .agg(F.count(F.lit(1)).alias("customer_count"))
    spine = df.sparkSession.createDataFrame([(i, lab) for i, lab in enumerate(labels)], f"bucket_order int, {name} string")
    return (spine.join(counts, name, "left")
                 .select("bucket_order", name, F.coalesce(F.col("customer_count"), F.lit(0)).cast("long")
                         .alias("customer_count")))


# ------------------------------------------------------------------ N1 KPIs

def customer_kpis(master: DataFrame, fs: DataFrame, orders: DataFrame | None = None) -> DataFrame:
    """N1 10 KPIs x (total, current, previous): customer-side figures come from the feature
    store restricted to customers active in each half (membership via one per-customer pass),
    CSAT and basket size from the master rows of each half."""
    cur = F.col("is_current")
    if orders is not None:
        per_order = with_period_flag(orders).select(KEY, "order_id", "is_current", "rev", "rs", "rn")
    else:
        m = with_period_flag(master)
        per_order = m.groupBy(KEY, "order_id", "is_current").agg(
            money_sum("price").alias("rev"), F.sum("avg_review_score").alias("rs"),
            F.count("avg_review_score").alias("rn"))
    member = per_order.groupBy(KEY).agg(F.max(cur.cast("int")).alias("in_c"), F.max((~cur).cast("int")).alias("in_p"))
    f = fs.join(member, KEY, "left").fillna(0, ["in_c", "in_p"])

    def scoped(prefix: str, flag: Column | None) -> list[Column]:
        sel = (lambda c: c) if flag is None else (lambda c: F.when(flag == 1, c))
        n = F.count(sel(F.lit(1)))
        ret = F.sum(sel(F.col("is_repeat_customer")))
        return [n.alias(f"cust_{prefix}"),
                F.count(sel(F.when(F.col("recency_days") <= 90, F.lit(1)))).alias(f"active_{prefix}"),
                ret.alias(f"ret_{prefix}"),
                F.avg(sel(F.col("historical_clv"))).alias(f"clv_{prefix}"),
                F.least(F.lit(100.0), F.greatest(F.lit(0.0), 100.0 - F.avg(sel(F.col("churn_label"))) * 100.0))
                .alias(f"retention_{prefix}"),
                F.avg(sel(F.col("total_orders"))).alias(f"freq_{prefix}")]

    a = f.agg(*scoped("t", None), *scoped("c", F.col("in_c")), *scoped("p", F.col("in_p")))
    b = per_order.agg(
        (F.sum("rs") / F.sum("rn")).alias("csat_t"),
        (F.sum(F.when(cur, F.col("rs"))) / F.sum(F.when(cur, F.col("rn")))).alias("csat_c"),
        (F.sum(F.when(~cur, F.col("rs"))) / F.sum(F.when(~cur, F.col("rn")))).alias("csat_p"),
        F.avg("rev").alias("basket_t"), F.avg(F.when(cur, F.col("rev"))).alias("basket_c"),
        F.avg(F.when(~cur, F.col("rev"))).alias("basket_p"))
    packed = b.select(F.struct(*b.columns)).scalar()  # one subquery for all six values
    scal = {c: packed[c] for c in b.columns}
    z = lambda c: F.coalesce(c, F.lit(0.0))
    cols = []
    for s in ("t", "c", "p"):
        cust, ret = F.col(f"cust_{s}"), F.coalesce(F.col(f"ret_{s}"), F.lit(0))
        cols += [cust.cast("double").alias(f"total_customers_{s}"),
                 F.col(f"active_{s}").cast("double").alias(f"active_customers_{s}"),
                 ret.cast("double").alias(f"returning_customers_{s}"),
                 (cust - ret).cast("double").alias(f"new_customers_{s}"),
                 (ret / F.greatest(cust, F.lit(1)) * 100.0).alias(f"repeat_purchase_rate_{s}"),
                 z(F.col(f"clv_{s}")).alias(f"avg_clv_{s}"),
                 z(scal[f"csat_{s}"]).alias(f"csat_{s}"),
                 z(F.col(f"retention_{s}")).alias(f"retention_rate_{s}"),
                 z(F.col(f"freq_{s}")).alias(f"avg_frequency_{s}"),
                 z(scal[f"basket_{s}"]).alias(f"avg_basket_size_{s}")]
    wide = a.select(*cols)
    names = ["total_customers", "active_customers", "returning_customers", "new_customers", "repeat_purchase_rate",
             "avg_clv", "csat", "retention_rate", "avg_frequency", "avg_basket_size"]
    stacked = F.explode(F.array(*[
        F.struct(F.lit(n).alias("kpi"), F.col(f"{n}_t").alias("total"), F.col(f"{n}_c").alias("current"),
                 F.col(f"{n}_p").alias("previous")) for n in names]))
    long = wide.select(stacked.alias("k")).select("k.*")
    return long.withColumns({"change_pct": change_pct(F.col("current"), F.col("previous")),
                             "is_positive": is_positive(F.col("current"), F.col("previous"))})


# ------------------------------------------------------------------ N2-N4 demographics

def state_distribution(master: DataFrame, orders: DataFrame | None = None) -> DataFrame:
    """N2 distinct customers, revenue and centroid per state, customers descending."""
    src, val = (orders, "rev") if orders is not None else (master, "price")
    per = src.where(F.col("customer_state").isNotNull()).groupBy("customer_state", KEY) \
             .agg(money_sum(val).alias("rev"))
    agg = per.groupBy(F.col("customer_state").alias("state")).agg(
        F.count(F.lit(1)).alias("customer_count"), money_sum("rev").alias("total_revenue"))
    return with_state_coords(agg, "state").orderBy(F.desc("customer_count"), "state")


def city_distribution(master: DataFrame, n: int = 15) -> DataFrame:
    """N3 top-n cities by distinct customers (ties by city)."""
    per = master.where(F.col("customer_city").isNotNull()).groupBy("customer_city", KEY) \
                .agg(money_sum("price").alias("rev"))
    agg = per.groupBy("customer_city").agg(F.count(F.lit(1)).alias("customer_count"),
                                           money_sum("rev").alias("total_revenue"))
    top = agg.orderBy(F.desc("customer_count"), "customer_city").limit(n)
    return top.select(F.initcap(F.col("customer_city")).alias("city"), "customer_count", "total_revenue")


def geographic_treemap(master: DataFrame, with_totals: bool = False) -> DataFrame:
    """N4 state -> city revenue and distinct customers; ``with_totals`` adds rollup rows."""
    per = master.where(F.col("customer_state").isNotNull()).groupBy("customer_state", "customer_city", KEY) \
                .agg(money_sum("price").alias("rev"))
    grouped = per.rollup("customer_state", "customer_city") if with_totals else \
        per.groupBy("customer_state", "customer_city")
    agg = grouped.agg(money_sum("rev").alias("total_revenue"), F.countDistinct(KEY).alias("customer_count"))
    return agg.select(F.col("customer_state").alias("state"), F.initcap("customer_city").alias("city"),
                      "total_revenue", "customer_count")


# ------------------------------------------------------------------ N5-N8 behaviour

FREQUENCY_BUCKETS = ["1 Order", "2 Orders", "3-5 Orders", "6+ Orders"]
DIVERSITY_BUCKETS = ["1 Category", "2-3 Categories", "4+ Categories"]
SPEND_BUCKETS = ["Low (<$100)", "Medium ($100-$300)", "High ($300-$1K)", "VIP ($1K+)"]
LOYALTY_TIERS = ["VIP Customers", "High-Value Customers", "Loyal Customers", "Occasional Customers",
                 "One-Time Buyers"]
LOYALTY_BANDS = ["0-20 (Bronze)", "21-40 (Silver)", "41-60 (Gold)", "61-80 (Platinum)", "81-100 (Diamond)"]
RECENCY_BUCKETS = ["0-30 Days", "31-60 Days", "61-90 Days", "91-180 Days", "180+ Days"]


def frequency_distribution(fs: DataFrame) -> DataFrame:
    """N5 customers with 1 / 2 / 3-5 / 6+ orders."""
    o = F.col("total_orders")
    lab = when_chain([(o == 1, FREQUENCY_BUCKETS[0]), (o == 2, FREQUENCY_BUCKETS[1]),
                      (o.between(3, 5), FREQUENCY_BUCKETS[2]), (o >= 6, FREQUENCY_BUCKETS[3])], None)
    return _buckets(fs, lab, FREQUENCY_BUCKETS, "frequency_bucket")


def diversity_distribution(master: DataFrame) -> DataFrame:
    """N6 customers by distinct categories bought: 1 / 2-3 / 4+."""
    per = master.where(F.col("product_category_name_english").isNotNull()) \
                .groupBy(KEY, "product_category_name_english").count() \
                .groupBy(KEY).agg(F.count(F.lit(1)).alias("n"))
    n = F.col("n")
    lab = when_chain([(n == 1, DIVERSITY_BUCKETS[0]), (n.between(2, 3), DIVERSITY_BUCKETS[1]),
                      (n >= 4, DIVERSITY_BUCKETS[2])], None)
    return _buckets(per, lab, DIVERSITY_BUCKETS, "diversity_level")


def spend_tiers(fs: DataFrame) -> DataFrame:
    """N8 customers by total spend <100 / 100-300 / 300-1000 / 1000+."""
    s = F.col("total_spending")
    lab = when_chain([(s < 100, SPEND_BUCKETS[0]), (s < 300, SPEND_BUCKETS[1]), (s < 1000, SPEND_BUCKETS[2]),
                      (s >= 1000, SPEND_BUCKETS[3])], None)
    return _buckets(fs, lab, SPEND_BUCKETS, "revenue_tier")


# ------------------------------------------------------------------ N9-N11 loyalty

def loyalty_tiers(fs: DataFrame) -> DataFrame:
    """N9 VIP / High-Value / Loyal / Occasional / One-Time."""
    s, o, r = F.col("total_spending"), F.col("total_orders"), F.col("recency_days")
    vip = (s >= 1000) & (o >= 3)
    high = (s >= 500) & (o >= 2)
    lab = when_chain([(vip, LOYALTY_TIERS[0]), (high, LOYALTY_TIERS[1]), (o >= 2, LOYALTY_TIERS[2]),
                      ((o == 1) & (r <= 180), LOYALTY_TIERS[3]), ((o == 1) & (r > 180), LOYALTY_TIERS[4])], None)
    return _buckets(fs, lab, LOYALTY_TIERS, "loyalty_tier")


def loyalty_histogram(fs: DataFrame) -> DataFrame:
    """N10 loyalty score bands [0,20], (20,40], ..., (80,100]."""
    x = F.col("loyalty_score")
    lab = when_chain([((x >= 0) & (x <= 20), LOYALTY_BANDS[0]), ((x > 20) & (x <= 40), LOYALTY_BANDS[1]),
                      ((x > 40) & (x <= 60), LOYALTY_BANDS[2]), ((x > 60) & (x <= 80), LOYALTY_BANDS[3]),
                      ((x > 80) & (x <= 100), LOYALTY_BANDS[4])], None)
    return _buckets(fs, lab, LOYALTY_BANDS, "score_range")


def loyalty_trend(master: DataFrame, orders: DataFrame | None = None) -> DataFrame:
    """N11 per month: active buyers (>= 1 order; the reference's "loyal" count) and buyers
    with >= 2 orders in that month."""
    if orders is not None:
        per = orders.where(F.col(TS).isNotNull()).groupBy(trunc_like("month", orders, TS).alias("month_start"), KEY) \
                    .agg(F.count(F.lit(1)).alias("o"))
    else:
        per = master.where(F.col(TS).isNotNull()).groupBy(trunc_like("month", master, TS).alias("month_start"), KEY) \
                    .agg(F.countDistinct("order_id").alias("o"))
    out = per.groupBy("month_start").agg(F.count(F.lit(1)).alias("active_buyers"),
                                         F.count_if(F.col("o") >= 2).alias("repeat_buyers"))
    return out.withColumn("month", F.date_format("month_start", "MMM yyyy")).orderBy("month_start")


# ------------------------------------------------------------------ N12-N14 revenue concentration

def customer_spend(master: DataFrame, orders: DataFrame | None = None) -> DataFrame:
    if orders is not None:
        return orders.groupBy(KEY).agg(money_sum("rev").alias("total_spending"), F.count(F.lit(1)).alias("total_orders"),
                                       F.min("customer_state").alias("state"))
    return master.groupBy(KEY).agg(money_sum("price").alias("total_spending"),
                                   F.countDistinct("order_id").alias("total_orders"),
                                   F.min("customer_state").alias("state"))


def top_customers(master: DataFrame, n: int = 20, orders: DataFrame | None = None) -> DataFrame:
    """N12 top-n customers by spend with orders, AOV and state."""
    agg = customer_spend(master, orders).withColumn(
        "avg_order_value", F.col("total_spending") / F.greatest(F.col("total_orders"), F.lit(1)))
    return agg.orderBy(F.desc("total_spending"), KEY).limit(n)


def _n_total(spend: DataFrame):
    st = spend.agg(F.count(F.lit(1)).alias("n"), F.sum("total_spending").alias("t")).select(F.struct("n", "t")).scalar()
    return st["n"], st["t"]


_RANKED: "weakref.WeakKeyDictionary[DataFrame, DataFrame]" = weakref.WeakKeyDictionary()


def ranked_customer_spend(master: DataFrame, orders: DataFrame | None = None) -> DataFrame:
    """Customers ranked by spend for one master frame, computed (and materialised) once and
    shared by the Pareto curve, the top-share figure and the revenue bands."""
    src = orders if orders is not None else master
    try:
        hit = _RANKED.get(src)
    except TypeError:
        hit = None
    if hit is None:
        hit = ranked_spend(customer_spend(master, orders).select(KEY, "total_spending"))
        try:
            _RANKED[src] = hit
        except TypeError:
            pass
    return hit


def ranked_spend(spend: DataFrame) -> DataFrame:
    """Customers by spend descending (ties by id) with row number and cumulative spend."""
    order = [F.desc("total_spending"), F.asc(KEY)]
    return with_global_running_sum(spend, order, {"rank": F.lit(1).cast("long"),
                                                  "cum_spend": F.col("total_spending")})


def pareto_curve(master: DataFrame, points: int = 50, orders: DataFrame | None = None) -> DataFrame:
    """N13 cumulative revenue share by customer percentile, sampled every n // points ranks
    plus the last one."""
    spend = customer_spend(master, orders).select(KEY, "total_spending")
    n, total = _n_total(spend)
    r = ranked_customer_spend(master, orders)
    step = F.greatest(F.floor(n / F.lit(points)), F.lit(1))
    keep = ((F.col("rank") - 1) % step == 0) | (F.col("rank") == n)
    return r.where(keep).select(
        "rank", (F.col("rank") / n * 100.0).alias("customer_percentile"),
        (F.col("cum_spend") / total * 100.0).alias("cumulative_revenue_pct"))


def pareto_top_share(master: DataFrame, share: float = 0.20, orders: DataFrame | None = None) -> DataFrame:
    """N13 exact revenue share % (1 decimal) of the top floor(share * n) customers (at least 1)."""
    spend = customer_spend(master, orders).select(KEY, "total_spending")
    n, total = _n_total(spend)
    k = F.greatest(F.floor(n * F.lit(share)), F.lit(1))
    r = ranked_customer_spend(master, orders)
    return r.where(F.col("rank") <= k).agg(
        F.round(F.sum("total_spending") / total * 100.0, 1).alias("top_share_pct"),
        F.count(F.lit(1)).alias("top_customers"))


REVENUE_BANDS = ["Top 1% VIPs", "Top 5% High-Value", "Top 20% Core Buyers", "Next 30% Moderate Buyers",
                 "Bottom 50% Long Tail"]


def revenue_bands(master: DataFrame, orders: DataFrame | None = None) -> DataFrame:
    """N14 revenue by rank band with the cut rule p_k = max(p_{k-1} + 1, floor(n * share_k))."""
    spend = customer_spend(master, orders).select(KEY, "total_spending")
    n, total = _n_total(spend)
    p1 = F.greatest(F.lit(1), F.floor(n * F.lit(0.01)))
    p5 = F.greatest(p1 + 1, F.floor(n * F.lit(0.05)))
    p20 = F.greatest(p5 + 1, F.floor(n * F.lit(0.20)))
    p50 = F.greatest(p20 + 1, F.floor(n * F.lit(0.50)))
    r = ranked_customer_spend(master, orders)
    rk = F.col("rank")
    lab = when_chain([(rk <= p1, REVENUE_BANDS[0]), (rk <= p5, REVENUE_BANDS[1]), (rk <= p20, REVENUE_BANDS[2]),
                      (rk <= p50, REVENUE_BANDS[3])], REVENUE_BANDS[4])
    agg = r.select(lab.alias("segment"), "total_spending").groupBy("segment").agg(
        F.count(F.lit(1)).alias("customer_count"), money_sum("total_spending").alias("total_revenue"))
    spine = master.sparkSession.createDataFrame(list(enumerate(REVENUE_BANDS)), "band_order int, segment string")
    out = spine.join(agg, "segment", "left").fillna(0, ["customer_count"]).fillna(0.0, ["total_revenue"])
    return out.withColumn("revenue_share_pct", F.col("total_revenue") / F.greatest(total, F.lit(1.0)) * 100.0)


# ------------------------------------------------------------------ N15-N17 activity

def recency_distribution(fs: DataFrame) -> DataFrame:
    """N15 customers by recency 0-30 / 31-60 / 61-90 / 91-180 / 180+ days."""
    r = F.col("recency_days")
    lab = when_chain([(r <= 30, RECENCY_BUCKETS[0]), (r <= 60, RECENCY_BUCKETS[1]), (r <= 90, RECENCY_BUCKETS[2]),
                      (r <= 180, RECENCY_BUCKETS[3]), (r > 180, RECENCY_BUCKETS[4])], None)
    return _buckets(fs, lab, RECENCY_BUCKETS, "recency_bucket")


def recently_active(master: DataFrame, n: int = 50, orders: DataFrame | None = None) -> DataFrame:
    """N16 the n customers with the most recent purchase (whole days before the latest one)."""
    src = orders if orders is not None else master
    max_ts = src.agg(F.max(TS)).scalar()
    if orders is not None:
        agg = orders.groupBy(KEY).agg(F.max(TS).alias("last_purchase"), money_sum("rev").alias("total_spending"),
                                      F.count(F.lit(1)).alias("total_orders"))
    else:
        agg = master.groupBy(KEY).agg(F.max(TS).alias("last_purchase"), money_sum("price").alias("total_spending"),
                                      F.countDistinct("order_id").alias("total_orders"))
    days = F.floor((F.unix_micros(max_ts.cast("timestamp")) -
                    F.unix_micros(F.col("last_purchase").cast("timestamp"))) / F.lit(86_400_000_000))
    out = agg.select(KEY, F.date_format("last_purchase", "yyyy-MM-dd").alias("last_purchase_date"),
                     days.cast("long").alias("recency_days"), "total_spending", "total_orders",
                     F.lit("Active").alias("status"))
    return out.orderBy("recency_days", KEY).limit(n)


def dormant_customers(fs: DataFrame, n: int = 50, threshold_days: float = 90) -> DataFrame:
    """N17 customers idle for more than ``threshold_days``, longest idle first."""
    d = fs.where(F.col("recency_days") > threshold_days)
    return d.select(KEY, "recency_days", "total_spending", "total_orders",
                    F.lit("Dormant (>90d)").alias("status")).orderBy(F.desc("recency_days"), KEY).limit(n)


# ------------------------------------------------------------------ N18-N19 profiles and insights

def customer_profile(fs: DataFrame, master: DataFrame, q: str) -> DataFrame:
    """N18 profile of the customer whose id equals ``q``; if none, per-city profile of cities
    containing ``q`` (case-insensitive)."""
    by_id = fs.where(F.col(KEY).cast("string") == F.lit(q)).select(
        F.lit("customer").alias("profile_type"), F.col(KEY).cast("string").alias("profile_key"),
        F.lit(1).cast("long").alias("customers"), F.col("total_spending").alias("total_spending"),
        F.col("total_orders").cast("double").alias("avg_orders"), F.col("historical_clv").alias("avg_clv"),
        F.col("customer_city").alias("city"))
    cities = fs.where(F.lower("customer_city").contains(q.lower())).groupBy("customer_city").agg(
        F.count(F.lit(1)).alias("customers"), money_sum("total_spending").alias("total_spending"),
        F.avg("total_orders").alias("avg_orders"), F.avg("historical_clv").alias("avg_clv"))
    by_city = cities.select(F.lit("city").alias("profile_type"), F.col("customer_city").alias("profile_key"),
                            "customers", "total_spending", "avg_orders", "avg_clv",
                            F.col("customer_city").alias("city"))
    n_id = by_id.agg(F.count(F.lit(1))).scalar()
    return by_id.unionByName(by_city.where(n_id == 0))


def customer_insights(master: DataFrame, fs: DataFrame, orders: DataFrame | None = None) -> DataFrame:
    """N19 insight rows: top state, runner-up state, largest segment, mean basket, Pareto share."""
    states = state_distribution(master, orders).select("state", "customer_count")
    from pyspark.sql import Window
    top2 = states.orderBy(F.desc("customer_count"), "state").limit(2) \
                 .withColumn("k", F.row_number().over(Window.orderBy(F.desc("customer_count"), "state")))  # 2 rows
    rows = [top2.select(F.when(F.col("k") == 1, F.lit("Top State")).otherwise(F.lit("Runner-up State"))
                        .alias("insight"), F.col("state").alias("value"),
                        F.col("customer_count").cast("double").alias("metric"))]
    seg = fs.groupBy("rfm_segment").count().orderBy(F.desc("count"), "rfm_segment").limit(1)
    rows.append(seg.select(F.lit("Largest Segment"), pretty("rfm_segment"), F.col("count").cast("double")))
    per_order = orders.select("order_id", "rev") if orders is not None else \
        master.groupBy("order_id").agg(money_sum("price").alias("rev"))
    rows.append(per_order.agg(F.avg("rev").alias("m")).select(F.lit("Average Basket"), F.lit(None).cast("string"),
                                                             F.col("m")))
    rows.append(pareto_top_share(master, orders=orders).select(F.lit("Top 20% Revenue Share"), F.lit(None).cast("string"),
                                                F.col("top_share_pct")))
    named = [r.toDF("insight", "value", "metric") for r in rows]
    return functools.reduce(DataFrame.unionByName, named)
