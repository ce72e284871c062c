"""Registered queries: market basket analysis (L).

The oracle enumerates itemsets of up to three categories with self-joins; at the
registered support (.01) no frequent itemset has more than two items on these tables, so
the enumeration is complete there (the Spark side has no such limit).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from orbitcart.operators import basket as B
from orbitcart.plans.oracle import MSUM, R, with_base
from orbitcart.plans.jobs import jobs
from orbitcart.plans.pipeline import retail
from orbitcart.plans.registry import query, rounded

_S = B.DEFAULT_MIN_SUPPORT

_ITEMSETS = f"""
, bk AS (SELECT DISTINCT order_id, product_category_name_english AS c FROM master
         WHERE product_category_name_english IS NOT NULL),
nb AS (SELECT count(DISTINCT order_id) AS n FROM bk),
s1 AS (SELECT [c] AS items, count(*) AS freq FROM bk GROUP BY c),
s2 AS (SELECT [a.c, b.c] AS items, count(*) AS freq FROM bk a JOIN bk b ON a.order_id = b.order_id AND a.c < b.c
       GROUP BY a.c, b.c),
s3 AS (SELECT [a.c, b.c, d.c] AS items, count(*) AS freq FROM bk a
       JOIN bk b ON a.order_id = b.order_id AND a.c < b.c JOIN bk d ON a.order_id = d.order_id AND b.c < d.c
       GROUP BY a.c, b.c, d.c),
fi AS (SELECT items, freq, freq / n AS support, len(items) AS size FROM (
         SELECT * FROM s1 UNION ALL SELECT * FROM s2 UNION ALL SELECT * FROM s3), nb
       WHERE freq >= ceil(CAST({_S} AS DOUBLE) * n)),
splits AS (
  SELECT items, support, [items[1]] AS ant, [items[2]] AS cons FROM fi WHERE size = 2
  UNION ALL SELECT items, support, [items[2]], [items[1]] FROM fi WHERE size = 2
  UNION ALL SELECT items, support, [items[1]], [items[2], items[3]] FROM fi WHERE size = 3
  UNION ALL SELECT items, support, [items[2]], [items[1], items[3]] FROM fi WHERE size = 3
  UNION ALL SELECT items, support, [items[3]], [items[1], items[2]] FROM fi WHERE size = 3
  UNION ALL SELECT items, support, [items[2], items[3]], [items[1]] FROM fi WHERE size = 3
  UNION ALL SELECT items, support, [items[1], items[3]], [items[2]] FROM fi WHERE size = 3
  UNION ALL SELECT items, support, [items[1], items[2]], [items[3]] FROM fi WHERE size = 3),
r0 AS (SELECT s.ant, s.cons, s.support, a.support AS ant_support, c.support AS cons_support,
              s.support / a.support AS confidence
       FROM splits s JOIN fi a ON a.items = s.ant JOIN fi c ON c.items = s.cons),
rules AS (SELECT ant, cons, array_to_string(ant, ', ') AS antecedents_str, array_to_string(cons, ', ') AS consequents_str,
                 ant_support, cons_support, support, confidence, confidence / cons_support AS lift,
                 support - ant_support * cons_support AS leverage,
                 CASE WHEN confidence >= 1.0 THEN 'inf'::DOUBLE
                      ELSE (1.0 - cons_support) / (1.0 - confidence) END AS conviction
          FROM r0 WHERE confidence / cons_support >= 1.0),
top30 AS (SELECT * FROM rules ORDER BY lift DESC, antecedents_str, consequents_str LIMIT {B.TOP_RULES})"""


def _j(spark, sf):
    return jobs(spark, sf)


@query("L1_baskets", with_base("""
SELECT order_id, array_to_string(list_sort(list(DISTINCT product_category_name_english)), ', ') AS items_str,
       count(DISTINCT product_category_name_english) AS n_items
FROM master WHERE product_category_name_english IS NOT NULL GROUP BY order_id"""))
def l1(spark, sf):
    b = _j(spark, sf).baskets
    return b.select("order_id", F.array_join("items", ", ").alias("items_str"), F.size("items").cast("long").alias("n_items"))


@query("L2_frequent_itemsets", with_base(f"""{_ITEMSETS}
SELECT array_to_string(items, ', ') AS items_str, freq, {R('support', 6)} AS support, CAST(size AS INTEGER) AS size FROM fi"""))
def l2(spark, sf):
    s = _j(spark, sf).itemsets
    return rounded(s.select(F.array_join("items", ", ").alias("items_str"), "freq", "support", "size"), {"support": 6})


_RULE_COLS = ["antecedents_str", "consequents_str", "ant_support", "cons_support", "support", "confidence", "lift",
              "leverage"]


def _rule_sql(src: str) -> str:
    cols = ", ".join(f"{R(c, 6)} AS {c}" if c not in ("antecedents_str", "consequents_str") else c for c in _RULE_COLS)
    return f"SELECT {cols}, CASE WHEN isinf(conviction) THEN conviction ELSE {R('conviction', 6)} END AS conviction FROM {src}"


def _rule_df(df):
    return rounded(df.select(*_RULE_COLS, "conviction"),
                   {c: 6 for c in _RULE_COLS if c not in ("antecedents_str", "consequents_str")} | {"conviction": 6})


@query("L5_association_rules", with_base(f"{_ITEMSETS}\n{_rule_sql('rules')}"))
def l5(spark, sf):
    return _rule_df(_j(spark, sf).rules)


@query("L6_bundles", with_base(f"""{_ITEMSETS},
pc AS (SELECT product_category_name_english AS cat, {MSUM('price')} AS s, count(price) AS c FROM master
       WHERE product_category_name_english IS NOT NULL GROUP BY 1),
od AS (SELECT count(DISTINCT order_id) AS orders FROM master),
b AS (SELECT t.*, (coalesce(pa.s, 0.0) + coalesce(pb.s, 0.0)) AS ts, (coalesce(pa.c, 0) + coalesce(pb.c, 0)) AS tc
      FROM top30 t LEFT JOIN pc pa ON pa.cat = t.antecedents_str LEFT JOIN pc pb ON pb.cat = t.consequents_str)
SELECT antecedents_str || ' + ' || consequents_str AS bundle_name, antecedents_str AS primary_category,
       consequents_str AS addon_category, {R('lift', 2)} AS lift_score, {R('confidence * 100.0', 1)} AS confidence_pct,
       {R('support * 100.0', 2)} AS support_pct,
       CASE WHEN tc > 0 THEN {R('ts / tc * 1.8', 2)} END AS estimated_bundle_price,
       CASE WHEN tc > 0 THEN {R('ts / tc * 1.8 * support * orders', 2)} END AS projected_revenue_potential,
       'Promote joint ''' || antecedents_str || ' & ' || consequents_str || ''' bundle with 10% discount on '
         || consequents_str || '.' AS merchandising_strategy
FROM b, od"""))
def l6(spark, sf):
    j = _j(spark, sf)
    return B.bundles(j.rules, j.r.master)


@query("L7_cross_sell", with_base(f"""{_ITEMSETS}
SELECT antecedents_str AS trigger_category, consequents_str AS recommended_cross_sell,
       {R('confidence * 100.0', 1)} AS conversion_probability, 'Checkout Pop-up / Post-Purchase Email' AS marketing_channel,
       'Add ' || consequents_str || ' to your order and save!' AS promotional_headline FROM top30"""))
def l7(spark, sf):
    return B.cross_sell(_j(spark, sf).rules)


@query("L8_basket_metrics", with_base(f"""{_ITEMSETS}
SELECT (SELECT count(DISTINCT order_id) FROM bk) AS total_transactions,
       (SELECT count(DISTINCT c) FROM bk) AS unique_categories, (SELECT count(*) FROM fi) AS frequent_itemsets_count,
       count(*) AS association_rules_count, coalesce({R('avg(lift)', 4)}, 0.0) AS avg_lift,
       coalesce({R('avg(confidence)', 4)}, 0.0) AS avg_confidence FROM rules"""))
def l8(spark, sf):
    j = _j(spark, sf)
    return B.basket_metrics(j.baskets, j.itemsets, j.rules)


@query("L9_filtered_rules", with_base(f"""{_ITEMSETS}
{_rule_sql("rules WHERE (contains(lower(antecedents_str), 'brand_1') OR contains(lower(consequents_str), 'brand_1')) AND confidence >= 0.05 AND lift >= 1.02")}"""))
def l9(spark, sf):
    return _rule_df(B.filter_rules(_j(spark, sf).rules, text="brand_1", min_confidence=0.05, min_lift=1.02))


@query("L10_rule_network_nodes", with_base(f"""{_ITEMSETS}
SELECT DISTINCT node FROM (SELECT antecedents_str AS node FROM top30 UNION ALL SELECT consequents_str FROM top30)"""))
def l10_nodes(spark, sf):
    return B.rule_network(_j(spark, sf).rules)[0]


@query("L10_rule_network_edges", with_base(f"""{_ITEMSETS}
SELECT antecedents_str AS source, consequents_str AS target, {R('lift', 6)} AS lift,
       {R('confidence', 6)} AS confidence, {R('support', 6)} AS support FROM top30"""))
def l10_edges(spark, sf):
    return rounded(B.rule_network(_j(spark, sf).rules)[1], {"lift": 6, "confidence": 6, "support": 6})


@query("L11_segment_baskets", with_base(f"""
, m AS (SELECT master.*, fs.rfm_segment FROM master JOIN fs USING (customer_unique_id)),
po AS (SELECT rfm_segment, order_id, count(order_item_id) AS items, {MSUM('price')} AS rev FROM m GROUP BY ALL),
seg AS (SELECT rfm_segment, count(*) AS transactions, {R('avg(items)', 6)} AS avg_basket_size,
               {R('avg(rev)', 6)} AS aov FROM po GROUP BY 1),
mc AS (SELECT rfm_segment, product_category_name_english AS most_purchased_category FROM (
         SELECT rfm_segment, product_category_name_english,
                row_number() OVER (PARTITION BY rfm_segment ORDER BY count(*) DESC, product_category_name_english) AS k
         FROM m WHERE product_category_name_english IS NOT NULL GROUP BY rfm_segment, product_category_name_english)
       WHERE k = 1)
SELECT seg.rfm_segment AS segment, transactions, avg_basket_size, aov, most_purchased_category
FROM seg LEFT JOIN mc USING (rfm_segment)"""))
def l11(spark, sf):
    r = retail(spark, sf)
    return rounded(B.segment_baskets(r.master, r.feature_store), {"avg_basket_size": 6, "aov": 6})


@query("L12_cooccurrence", with_base("""
, topc AS (SELECT product_category_name_english AS c FROM master WHERE product_category_name_english IS NOT NULL
           GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 10),
per AS (SELECT order_id, product_category_name_english AS c, count(*) AS n FROM master
        WHERE product_category_name_english IN (SELECT c FROM topc) GROUP BY ALL)
SELECT a.c AS category_a, b.c AS category_b, CAST(sum(a.n * b.n) AS BIGINT) AS weight
FROM per a JOIN per b USING (order_id) GROUP BY ALL"""))
def l12(spark, sf):
    return B.cooccurrence(retail(spark, sf).master, 10)


@query("L13_seasonal_baskets", with_base(f"""
, po AS (SELECT strftime(order_purchase_timestamp, '%Y-%m') AS year_month, order_id, count(order_item_id) AS items,
                {MSUM('price')} AS rev FROM master WHERE order_purchase_timestamp IS NOT NULL GROUP BY ALL)
SELECT year_month, count(*) AS total_orders, CAST(sum(items) AS BIGINT) AS basket_items, {MSUM('rev')} AS revenue,
       {R('sum(items) / count(*)', 2)} AS avg_items_per_order FROM po GROUP BY 1"""))
def l13(spark, sf):
    return B.seasonal_baskets(retail(spark, sf).master)


@query("L14_product_search", with_base(f"""{_ITEMSETS},
cats AS (SELECT product_category_name_english, count(*) AS units, {MSUM('price')} AS revenue FROM master
         WHERE contains(lower(product_category_name_english), 'brand_2') GROUP BY 1),
men AS (SELECT x AS product_category_name_english, count(*) AS rules_mentioning
        FROM (SELECT unnest(list_distinct(list_concat(ant, cons))) AS x FROM rules) GROUP BY 1)
SELECT cats.product_category_name_english, units, revenue, coalesce(rules_mentioning, 0) AS rules_mentioning
FROM cats LEFT JOIN men USING (product_category_name_english)"""))
def l14(spark, sf):
    j = _j(spark, sf)
    return B.product_search(j.r.master, j.rules, "brand_2")


@query("L15_basket_kpis", with_base(f"""{_ITEMSETS},
ipo AS (SELECT order_id, count(order_item_id) AS k FROM master GROUP BY 1),
tb AS (SELECT antecedents_str || ' + ' || consequents_str AS b FROM top30
       ORDER BY lift DESC, antecedents_str, consequents_str LIMIT 1)
SELECT kpi, value FROM (
  SELECT 'total_transactions' AS kpi, CAST((SELECT count(DISTINCT order_id) FROM bk) AS VARCHAR) AS value
  UNION ALL SELECT 'unique_categories', CAST((SELECT count(DISTINCT c) FROM bk) AS VARCHAR)
  UNION ALL SELECT 'frequent_itemsets', CAST((SELECT count(*) FROM fi) AS VARCHAR)
  UNION ALL SELECT 'association_rules', CAST((SELECT count(*) FROM rules) AS VARCHAR)
  UNION ALL SELECT 'high_lift_rules', CAST((SELECT count(*) FROM rules WHERE lift >= 2.0) AS VARCHAR)
  UNION ALL SELECT 'avg_basket_size', printf('%.2f Items', (SELECT avg(k) FROM ipo))
  UNION ALL SELECT 'top_bundle', coalesce((SELECT b FROM tb), 'N/A')
  UNION ALL SELECT 'cross_sell_opportunities', CAST((SELECT count(*) FROM rules) AS VARCHAR))"""))
def l15(spark, sf):
    j = _j(spark, sf)
    return B.basket_kpis(j.r.master, j.baskets, j.itemsets, j.rules)
