"""M15 — entity search over an index of short character runs, with each entity's summary.

``entities`` makes one row with its summary for every customer, order, seller, product and
category in one pass over the items. ``gram_index`` lists, for every run of one to three characters of the
lower-cased ids, the entities that hold it, each file sorted by run, so that a lookup reads only the
pages of its runs. ``search`` intersects the lists of the query's three-letter runs (of the
query itself where it is shorter), checks the text literally and keeps the hits of the first kind of entity
that has any, in the order customer, order, seller, product, category.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbitcart.functions.columns import money_sum

KEY, CAT = "customer_unique_id", "product_category_name_english"
# The kinds of entity in the order they are tried.
KINDS = (("customer", KEY), ("order", "order_id"), ("seller", "seller_id"), ("product", "product_id"), ("category", CAT))
GRAM = 3
#: Entities whose runs a part of the index holds.
ENTITIES_PER_PART = 100_000


def entities(master: DataFrame, fs: DataFrame) -> DataFrame:
    """(priority, entity_type, entity_id, summary columns); columns that a kind lacks are null.

    Items are first added up by entity and order, so no distinct count is needed. Rows that lie
    together by order, as the master's do, are added up in place, and the busiest entity is combined
    before it is exchanged. A column that only one kind shows is null in the others' rows from the start.
    """
    def only(kind: str, c: str) -> Column:
        return F.when(F.col("e.entity_type") == kind, F.col(c)).alias(c)

    names = F.explode(F.array(*[F.struct(F.lit(i).alias("priority"), F.lit(kind).alias("entity_type"), F.col(c).cast("string").alias("entity_id"))
                                for i, (kind, c) in enumerate(KINDS)])).alias("e")
    items = master.select(names, F.col("order_id").alias("of_order"), "price", "order_status", "order_purchase_timestamp", "seller_state", CAT)
    items = items.where("e.entity_id IS NOT NULL").select(
        "e.*", "of_order", "price", only("order", "order_status"), only("order", "order_purchase_timestamp"), only("seller", "seller_state"), only("product", CAT))
    key = ["priority", "entity_type", "entity_id"]
    own = [F.min(c).alias(c) for c in ("order_status", "order_purchase_timestamp", "seller_state", CAT)]
    per_order = items.groupBy(*key, "of_order").agg(F.count(F.lit(1)).alias("items"), money_sum("price").alias("revenue"), *own)
    per = per_order.groupBy(*key).agg(F.count("of_order").alias("orders"), F.sum("items").alias("items"), money_sum("revenue").alias("revenue"), *own)
    per = per.select(*key, "orders", "items", "revenue", F.round(F.col("revenue") / F.greatest("orders", F.lit(1)), 2).alias("avg_order_value"),
                     F.col("order_status").alias("status"), F.col("order_purchase_timestamp").alias("purchased_at"),
                     F.col("seller_state").alias("state"), F.col(CAT).alias("category"))
    known = fs.select(F.lit(0).alias("priority"), F.lit("customer").alias("entity_type"), F.col(KEY).cast("string").alias("entity_id"), "rfm_segment",
                      F.when(F.coalesce("churn_label", F.lit(0)) == 0, "Low Risk").otherwise("High Risk").alias("churn_risk"),
                      F.round("total_spending", 2).alias("customer_value"))
    # joined on the whole key, by which the entities lie already
    out = per.join(known, key, "left")
    return out.select("entity_type", "entity_id", "priority", *out.columns[3:])


def _grams(text: Column, size: int) -> Column:
    """The distinct runs of ``size`` characters of a text of at least that length."""
    starts = F.sequence(F.lit(1), F.length(text) - size + 1)
    return F.when(F.length(text) >= size, F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, size)))).otherwise(
        F.array().cast("array<string>"))


def gram_index(entity_table: DataFrame, num_partitions: int | None = None) -> DataFrame:
    """(gram, priority, entity_type, entity_id), each part in the order of the runs, ready to be written.

    The entities are dealt out by id before their runs are listed: only ids are exchanged, not their
    some twenty runs, a very common run is in all parts, and a part's runs are few enough to be sorted.
    """
    parts = num_partitions or max(1, -(-entity_table.count() // ENTITIES_PER_PART))
    dealt = entity_table.select("priority", "entity_type", "entity_id").repartition(parts, "entity_id", "entity_type")
    text = F.lower("entity_id")
    runs = F.concat(*[_grams(text, size) for size in range(1, GRAM + 1)])
    return dealt.select("priority", "entity_type", "entity_id", F.explode(runs).alias("gram")).sortWithinPartitions("gram", "entity_id", "entity_type")


def search(index: DataFrame, entity_table: DataFrame, q: str, *, kinds: Sequence[str] | None = None, limit: int | None = None) -> DataFrame:
    """The summaries of the first kind's entities whose id holds ``q`` (any case, literal text; blanks around it do not
    count). ``kinds`` narrows the kinds tried, ``limit`` gives the first hits by id. No text, no hit."""
    needle = q.strip().lower()
    size = min(GRAM, len(needle))
    grams = sorted({needle[i:i + size] for i in range(len(needle) - size + 1)}) if needle else []
    rows = index.where(F.col("gram").isin(grams) if grams else F.lit(False))
    if kinds:
        rows = rows.where(F.col("entity_type").isin(list(kinds)))
    hits = rows.groupBy("priority", "entity_type", "entity_id").agg(F.count(F.lit(1)).alias("n"))
    hits = hits.where((F.col("n") == len(grams)) & F.lower("entity_id").contains(needle))
    first = hits.agg(F.min("priority")).scalar()
    hits = hits.where(F.col("priority") == first)
    if limit:
        hits = hits.orderBy("entity_id").limit(limit)
    return entity_table.join(hits.select("entity_type", "entity_id"), ["entity_type", "entity_id"], "left_semi").drop("priority")
