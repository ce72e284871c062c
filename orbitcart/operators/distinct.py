"""M4/M11/L15/N1 — distinct customers and orders of any slice from one stored table of bitmaps.

Each customer and each order gets a number; the stored table holds, for every cell (month,
customer state, category) and every 32,768 numbers, the bitmap of those that occur. Bitmaps
of cells are joined by OR and their bits counted, so any slice, by any of the dimensions, is
exact without the rows being read again, and new months only add rows to the table.

Numbers follow (state, first month) of their owner: a cell of a state meets few bitmaps,
and a bitmap is well filled. They are dealt over ranges, so no task numbers all customers.

Defined cases: null ids are not counted (as by SQL); null dimensions are cells of their own;
an empty table gives no cells, and totals of 0.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbitcart.functions.ordering import with_global_row_number
from orbitcart.operators.executive import TS

KEY = "customer_unique_id"
ENTITIES = {"customer": KEY, "order": "order_id"}


def cells(master: DataFrame) -> DataFrame:
    """month, state, category, customer and order of each item: all that the bitmaps need."""
    return master.select(F.date_trunc("month", F.col(TS).cast("timestamp")).cast("date").alias("month"), F.col("customer_state").alias("state"),
                         F.col("product_category_name_english").alias("category"), KEY, "order_id")


def numbered(facts: DataFrame, key: str) -> DataFrame:
    """key, number (from 1): dense, by the state and month in which the key occurs first."""
    first = facts.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct("state", "month")).alias("home"))
    return with_global_row_number(first, [F.col("home.state"), F.col("home.month"), F.col(key)], "number").select(key, "number")


def distinct_state(master: DataFrame, written: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """entity, month, state, category, bucket, bits: the stored table.

    ``written`` stores a frame and gives it back; ids are joined with their numbers once.
    """
    facts = cells(master)
    parts = None
    for entity, key in ENTITIES.items():
        pairs = facts.select("month", "state", "category", key).filter(F.col(key).isNotNull()).distinct()
        numbers = written(numbered(facts, key), f"numbers-{entity}")
        placed = pairs.join(numbers, key)
        bits = placed.groupBy("month", "state", "category", F.expr("bitmap_bucket_number(number)").alias("bucket")).agg(
            F.expr("bitmap_construct_agg(bitmap_bit_position(number))").alias("bits"))
        part = bits.select(F.lit(entity).alias("entity"), "month", "state", "category", "bucket", "bits")
        parts = part if parts is None else parts.unionByName(part)
    return written(parts, "distinct-state")


def distinct_counts(state: DataFrame, by: Sequence[str] = (), where: Column | None = None) -> DataFrame:
    """``by`` columns, customers, orders: exact distinct counts of the slice ``where``."""
    chosen = state.filter(where) if where is not None else state
    joined = chosen.groupBy(*by, "entity", "bucket").agg(F.expr("bitmap_or_agg(bits)").alias("bits"))
    count = F.expr("bitmap_count(bits)")
    return joined.groupBy(*by).agg(*[F.coalesce(F.sum(F.when(F.col("entity") == e, count)), F.lit(0)).cast("long").alias(f"{e}s") for e in ENTITIES])
