"""L — market basket analysis: baskets, FP-Growth itemsets, multi-item rules, bundles, KPIs.

Itemsets come from Spark ML's distributed FP-Growth. Spark's own ``associationRules`` only
emits one-item consequents, so rules are generated here: every proper non-empty subset of
each frequent itemset (bit masks over the sorted item array) becomes an antecedent, and the
antecedent/consequent supports are looked up by equi-joins on the sorted arrays. All
subsets of a frequent itemset are frequent, so every lookup succeeds; no size cap is used.
"""

from __future__ import annotations

import functools

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbitcart.functions.columns import money_sum

CAT = "product_category_name_english"
DEFAULT_MIN_SUPPORT = 0.01      # config value (the code default is .005; both are parameters)
FALLBACK_MIN_SUPPORT = 0.001
TOP_RULES = 30
BUNDLE_PRICE_FACTOR = 1.8


def baskets(master: DataFrame, item_col: str = CAT) -> DataFrame:
    """L1 one row per order: the sorted distinct categories bought (orders without any drop)."""
    return (master.where(F.col(item_col).isNotNull())
                  .groupBy("order_id").agg(F.array_sort(F.collect_set(item_col)).alias("items")))


def frequent_itemsets(bsk: DataFrame, min_support: float = DEFAULT_MIN_SUPPORT,
                      retry_support: float | None = FALLBACK_MIN_SUPPORT, algorithm: str = "fpgrowth") -> DataFrame:
    """L2/L3/L4 FP-Growth itemsets with support = freq / baskets; retried at a lower support
    when nothing is frequent. ``algorithm='apriori'`` is accepted: Apriori and FP-Growth find the
    same frequent itemsets, so both use Spark's distributed FP-Growth."""
    if algorithm not in ("fpgrowth", "apriori"):
        raise ValueError(f"unknown itemset algorithm {algorithm}")
    def mine(s: float) -> DataFrame:
        model = FPGrowth(itemsCol="items", minSupport=s).fit(bsk)
        return model.freqItemsets
    sets = mine(min_support)
    if retry_support is not None and sets.isEmpty():
        sets = mine(retry_support)
    n = bsk.agg(F.count(F.lit(1))).scalar()
    return sets.select(F.array_sort("items").alias("items"), F.col("freq"),
                       (F.col("freq") / n).alias("support"), F.size("items").alias("size"))


def _subsets(items: Column) -> Column:
    """All proper non-empty subsets of a sorted array, as an array of sorted arrays."""
    k = F.size(items)
    masks = F.sequence(F.lit(1), F.pow(F.lit(2), k).cast("int") - 2)
    return F.transform(masks, lambda m: F.filter(items, lambda x, i: F.floor(m / F.pow(F.lit(2), i)) % 2 == 1))


def association_rules(itemsets: DataFrame, min_lift: float = 1.0) -> DataFrame:
    """L5 rules A -> B for every split of every itemset of size >= 2, with support,
    confidence, lift, leverage and conviction (infinite when confidence is 1); lift >= min_lift."""
    multi = itemsets.where(F.col("size") >= 2)
    splits = multi.select(F.col("items"), F.col("support"), F.explode(_subsets(F.col("items"))).alias("ant"))
    splits = splits.withColumn("cons", F.array_except("items", "ant"))
    sup = itemsets.select("items", "support")
    a = sup.select(F.col("items").alias("ant"), F.col("support").alias("ant_support"))
    c = sup.select(F.col("items").alias("cons"), F.col("support").alias("cons_support"))
    r = splits.join(a, "ant").join(c, "cons")
    conf = F.col("support") / F.col("ant_support")
    r = r.withColumn("confidence", conf).withColumn("lift", F.col("confidence") / F.col("cons_support"))
    r = r.withColumns({
        "leverage": F.col("support") - F.col("ant_support") * F.col("cons_support"),
        "conviction": F.when(F.col("confidence") >= 1.0, F.lit(float("inf")))
                       .otherwise((1.0 - F.col("cons_support")) / (1.0 - F.col("confidence"))),
        "antecedents_str": F.array_join("ant", ", "),
        "consequents_str": F.array_join("cons", ", "),
    })
    return r.where(F.col("lift") >= min_lift).select(
        F.col("ant").alias("antecedents"), F.col("cons").alias("consequents"), "antecedents_str", "consequents_str",
        "ant_support", "cons_support", "support", "confidence", "lift", "leverage", "conviction")


def top_rules(rules: DataFrame, n: int = TOP_RULES) -> DataFrame:
    """The n strongest rules: lift descending, ties by the rule text."""
    return rules.orderBy(F.desc("lift"), "antecedents_str", "consequents_str").limit(n)


def bundles(rules: DataFrame, master: DataFrame, n: int = TOP_RULES) -> DataFrame:
    """L6 bundles from the top-n rules: price estimate = 1.8 x mean price of the item rows whose
    category equals either side's text (a multi-item side matches no category); projected
    revenue = price x support x distinct orders."""
    top = top_rules(rules, n)
    per_cat = master.where(F.col(CAT).isNotNull()).groupBy(CAT).agg(
        money_sum("price").alias("s"), F.count("price").alias("c"))
    pa = per_cat.select(F.col(CAT).alias("antecedents_str"), F.col("s").alias("sa"), F.col("c").alias("ca"))
    pc = per_cat.select(F.col(CAT).alias("consequents_str"), F.col("s").alias("sc"), F.col("c").alias("cc"))
    orders = master.agg(F.countDistinct("order_id")).scalar()
    b = top.join(pa, "antecedents_str", "left").join(pc, "consequents_str", "left")
    total_s = F.coalesce(F.col("sa"), F.lit(0.0)) + F.coalesce(F.col("sc"), F.lit(0.0))
    total_c = F.coalesce(F.col("ca"), F.lit(0)) + F.coalesce(F.col("cc"), F.lit(0))
    price = F.when(total_c > 0, total_s / total_c * BUNDLE_PRICE_FACTOR)
    return b.select(
        F.concat_ws(" + ", "antecedents_str", "consequents_str").alias("bundle_name"),
        F.col("antecedents_str").alias("primary_category"), F.col("consequents_str").alias("addon_category"),
        F.round("lift", 2).alias("lift_score"), F.round(F.col("confidence") * 100.0, 1).alias("confidence_pct"),
        F.round(F.col("support") * 100.0, 2).alias("support_pct"),
        F.round(price, 2).alias("estimated_bundle_price"),
        F.round(price * F.col("support") * orders, 2).alias("projected_revenue_potential"),
        F.format_string("Promote joint '%s & %s' bundle with 10%% discount on %s.", F.col("antecedents_str"),
                        F.col("consequents_str"), F.col("consequents_str")).alias("merchandising_strategy"))


def cross_sell(rules: DataFrame, n: int = TOP_RULES) -> DataFrame:
    """L7 cross-sell rows from the top-n rules."""
    return top_rules(rules, n).select(
        F.col("antecedents_str").alias("trigger_category"), F.col("consequents_str").alias("recommended_cross_sell"),
        F.round(F.col("confidence") * 100.0, 1).alias("conversion_probability"),
        F.lit("Checkout Pop-up / Post-Purchase Email").alias("marketing_channel"),
        F.format_string("Add %s to your order and save!", F.col("consequents_str")).alias("promotional_headline"))


def basket_metrics(bsk: DataFrame, itemsets: DataFrame, rules: DataFrame) -> DataFrame:
    """L8 transactions, categories, itemsets, rules, mean lift and confidence (4 decimals)."""
    cats = bsk.select(F.explode("items").alias("c")).agg(F.countDistinct("c")).scalar()
    r = rules.agg(F.count(F.lit(1)).alias("rules"), F.avg("lift").alias("l"), F.avg("confidence").alias("c")) \
             .select(F.struct("rules", "l", "c")).scalar()
    return bsk.agg(F.count(F.lit(1)).alias("total_transactions")).select(
        "total_transactions", cats.alias("unique_categories"),
        itemsets.agg(F.count(F.lit(1))).scalar().alias("frequent_itemsets_count"),
        r["rules"].alias("association_rules_count"),
        F.coalesce(F.round(r["l"], 4), F.lit(0.0)).alias("avg_lift"),
        F.coalesce(F.round(r["c"], 4), F.lit(0.0)).alias("avg_confidence"))


def filter_rules(rules: DataFrame, text: str | None = None, categories=None, min_support: float = 0.0,
                 min_confidence: float = 0.0, min_lift: float = 0.0, sort_by: str = "lift") -> DataFrame:
    """L9 substring on either side (case-insensitive), category membership, thresholds, sort."""
    preds = [F.col("support") >= min_support, F.col("confidence") >= min_confidence, F.col("lift") >= min_lift]
    if text:
        t = text.lower()
        preds.append(F.lower("antecedents_str").contains(t) | F.lower("consequents_str").contains(t))
    if categories:
        cats = F.array(*[F.lit(c) for c in categories])
        preds.append(F.arrays_overlap("antecedents", cats) | F.arrays_overlap("consequents", cats))
    return rules.where(functools.reduce(lambda a, b: a & b, preds)).orderBy(F.desc(sort_by), "antecedents_str",
                                                                              "consequents_str")


def rule_network(rules: DataFrame, n: int = TOP_RULES) -> tuple[DataFrame, DataFrame]:
    """L10 (nodes, edges) of the top-n rules."""
    edges = top_rules(rules, n).select(F.col("antecedents_str").alias("source"),
                                       F.col("consequents_str").alias("target"), "lift", "confidence", "support")
    nodes = edges.select(F.col("source").alias("node")).union(edges.select("target")).distinct()
    return nodes, edges


def segment_baskets(master: DataFrame, fs: DataFrame, segment_col: str = "rfm_segment") -> DataFrame:
    """L11 per segment: orders, mean items per order, mode category, AOV (revenue / orders)."""
    m = master.join(fs.select("customer_unique_id", segment_col), "customer_unique_id", "inner")  # D14
    per_order = m.groupBy(segment_col, "order_id").agg(F.count("order_item_id").alias("items"),
                                                       money_sum("price").alias("rev"))
    seg = per_order.groupBy(segment_col).agg(F.count(F.lit(1)).alias("transactions"),
                                             F.avg("items").alias("avg_basket_size"), F.avg("rev").alias("aov"))
    top_cat = m.where(F.col(CAT).isNotNull()).groupBy(segment_col).agg(
        F.mode(CAT, deterministic=True).alias("most_purchased_category"))
    return seg.join(top_cat, segment_col, "left").withColumnRenamed(segment_col, "segment")


def cooccurrence(master: DataFrame, top_n: int = 10) -> DataFrame:
    """L12 X^T X of per-order category counts for the top-n categories (long form:
    (category_a, category_b, weight)); quantities multiply, the diagonal is sum n^2."""
    top = (master.where(F.col(CAT).isNotNull()).groupBy(CAT).count()
                 .orderBy(F.desc("count"), CAT).limit(top_n).select(CAT))
    per = master.join(F.broadcast(top), CAT, "left_semi").groupBy("order_id", CAT).agg(F.count(F.lit(1)).alias("n"))
    a = per.select("order_id", F.col(CAT).alias("category_a"), F.col("n").alias("na"))
    b = per.select("order_id", F.col(CAT).alias("category_b"), F.col("n").alias("nb"))
    # pairs inside one order: bounded by top_n^2 per order
    return a.join(b, "order_id").groupBy("category_a", "category_b").agg(
        F.sum(F.col("na") * F.col("nb")).alias("weight"))


def cooccurrence_matrix(long: DataFrame, categories) -> DataFrame:
    """L12 pivot of the long form into a square matrix (one column per category)."""
    return long.groupBy("category_a").pivot("category_b", list(categories)).agg(F.first("weight")).na.fill(0)


def seasonal_baskets(master: DataFrame) -> DataFrame:
    """L13 per month: distinct orders, item rows, revenue, items per order (2 decimals)."""
    per = master.where(F.col("order_purchase_timestamp").isNotNull()).groupBy(
        F.date_format("order_purchase_timestamp", "yyyy-MM").alias("year_month"), "order_id").agg(
        F.count("order_item_id").alias("items"), money_sum("price").alias("rev"))
    out = per.groupBy("year_month").agg(F.count(F.lit(1)).alias("total_orders"), F.sum("items").alias("basket_items"),
                                        money_sum("rev").alias("revenue"))
    return out.withColumn("avg_items_per_order", F.round(F.col("basket_items") / F.col("total_orders"), 2))


def product_search(master: DataFrame, rules: DataFrame, q: str) -> DataFrame:
    """L14 categories matching ``q``: units, revenue, and how many rules / cross-sells mention them."""
    t = q.lower()
    cats = master.where(F.lower(CAT).contains(t)).groupBy(CAT).agg(
        F.count(F.lit(1)).alias("units"), money_sum("price").alias("revenue"))
    mentions = rules.select(F.explode(F.array_union("antecedents", "consequents")).alias(CAT)) \
                    .groupBy(CAT).agg(F.count(F.lit(1)).alias("rules_mentioning"))
    return cats.join(mentions, CAT, "left").fillna(0, ["rules_mentioning"])


def basket_kpis(master: DataFrame, bsk: DataFrame, itemsets: DataFrame, rules: DataFrame, *,
                name_chars: int | None = None, cross_sell_rules: int | None = None) -> DataFrame:
    """L15 8 KPIs as (kpi, value) rows; values as text where the reference shows a label.
    ``name_chars`` shortens the top bundle's name, ``cross_sell_rules`` counts only so many rules."""
    r = rules.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("lift") >= 2.0).alias("hi")) \
             .select(F.struct("n", "hi")).scalar()
    items = master.groupBy("order_id").agg(F.count("order_item_id").alias("k")).agg(F.avg("k")).scalar()
    name = F.concat_ws(" + ", "antecedents_str", "consequents_str")
    top_name = top_rules(rules, 1).select(F.substring(name, 1, name_chars) if name_chars is not None else name).scalar()
    n_cross = F.least(r["n"], F.lit(cross_sell_rules))  # a rule each; least skips a null
    row = bsk.agg(F.count(F.lit(1)).alias("tx")).select(
        F.col("tx").cast("string").alias("total_transactions"),
        bsk.select(F.explode("items").alias("c")).agg(F.countDistinct("c")).scalar().cast("string")
        .alias("unique_categories"),
        itemsets.agg(F.count(F.lit(1))).scalar().cast("string").alias("frequent_itemsets"),
        r["n"].cast("string").alias("association_rules"), r["hi"].cast("string").alias("high_lift_rules"),
        F.format_string("%.2f Items", items).alias("avg_basket_size"),
        F.coalesce(top_name, F.lit("N/A")).alias("top_bundle"), n_cross.cast("string").alias("cross_sell_opportunities"))
    names = row.columns
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("kpi"), F.col(c).alias("value"))
                                          for c in names])).alias("k")).select("k.*")
