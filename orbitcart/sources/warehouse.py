"""A6/M16/M17 — the master laid out for slices: blocks of an interleaved key and their zone map.

A row's place has three coordinates: the band of its purchase time, and hashes of its customer
state and category. Their bits are interleaved, so rows that agree in any of the three lie
near each other. The first bits of the key are the table's partition column ``block``; within
a file rows follow the whole key, so row groups have narrow minima and maxima. Tasks are
dealt by (key, hash of the order), which spreads a block that holds a third of all rows.

The zone map has one row a block: minima and maxima of time, price and seller, and 64-bit
masks of hashed states, categories and payment types. A slice joins the table with the blocks that pass,
so Spark prunes partitions when it runs (dynamic partition pruning), and the slice's own
filters are pushed to the Parquet scan. The map has at most 2 ** (3 * MOST_BITS) rows, a size
that bounds its broadcast.

Defined cases: rows without time, state or category are kept (time band 0, hash of null); an
empty master gives an empty table and map; a slice without filters reads all blocks.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orbitcart.operators.executive import TS

STATE, CATEGORY, PAYMENT = "customer_state", "product_category_name_english", "preferred_payment_type"
#: Rows that one block should hold, and the bits of a coordinate that name blocks: at least, at most.
BLOCK_ROWS, LEAST_BITS, MOST_BITS = 4_000_000, 1, 4
#: Bits of a coordinate in the whole key.
KEY_BITS = 8
#: Bits of a mask of hashed values.
MASK_BITS = 64


def interleaved(coordinates: Sequence[Column], bits: int) -> Column:
    """The bits of non-negative integers, highest first, in turn."""
    key = F.lit(0).cast("long")
    for bit in reversed(range(bits)):
        for c in coordinates:
            key = F.shiftleft(key, 1).bitwiseOR(F.shiftright(c.cast("long"), bit).bitwiseAND(F.lit(1)))
    return key


def hashed(value: Column, size: int) -> Column:
    return F.pmod(F.xxhash64(F.upper(value.cast("string"))), F.lit(size)).cast("int")


def mask(value: Column) -> Column:
    """The bit of a value in a 64-bit mask; masks of several values are joined by OR."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), hashed(value, MASK_BITS))


def block_bits(rows: int) -> int:
    """Bits of each coordinate that name blocks, by the table's rows."""
    bits = LEAST_BITS
    while bits < MOST_BITS and rows > BLOCK_ROWS << 3 * bits:
        bits += 1
    return bits


def write_clustered(master: DataFrame, path: str, *, bits: int | None = None) -> str:
    """Write ``master`` below ``path`` (table and zone map). The order of the bits is fixed by
    the first write; new months are laid out by a new write to a path of their own."""
    spark = master.sparkSession
    ts = F.unix_micros(F.col(TS).cast("timestamp"))
    size = master.agg(F.count("*").alias("n"), F.min(ts).alias("lo"), F.max(ts).alias("hi")).first()  # one row
    bits = bits or block_bits(size["n"])
    lo, width = size["lo"] or 0, max(1, (size["hi"] or 0) - (size["lo"] or 0) + 1)
    band = F.coalesce(F.floor((ts - F.lit(lo)) / F.lit(width) * (1 << KEY_BITS)).cast("int"), F.lit(0))
    coordinates = [band, hashed(F.col(STATE), 1 << KEY_BITS), hashed(F.col(CATEGORY), 1 << KEY_BITS)]
    laid = master.withColumn("zkey", interleaved(coordinates, KEY_BITS))
    laid = laid.withColumn("block", F.shiftright("zkey", 3 * (KEY_BITS - bits)).cast("int"))
    writer = laid.repartitionByRange("zkey", F.xxhash64("order_id")).sortWithinPartitions("zkey", TS).write.mode("overwrite")
    # without rows there would be no folder to read the columns from
    (writer.partitionBy("block") if size["n"] else writer).parquet(f"{path}/rows")
    zones(spark.read.parquet(f"{path}/rows")).coalesce(1).write.mode("overwrite").parquet(f"{path}/zones")
    return path


def zones(rows: DataFrame) -> DataFrame:
    """One row a block: minima, maxima, masks and the number of rows."""
    return rows.groupBy("block").agg(
        F.count("*").alias("n_rows"), F.min(TS).alias("ts_min"), F.max(TS).alias("ts_max"),
        F.min("price").alias("price_min"), F.max("price").alias("price_max"),
        *[F.bit_or(mask(F.col(c))).alias(f"{name}_mask") for name, c in
          (("state", STATE), ("seller_state", "seller_state"), ("category", CATEGORY), ("payment", PAYMENT))])


def _meets(column: str, values: Sequence[str]) -> Column:
    wanted = functools.reduce(lambda a, b: a.bitwiseOR(b), [mask(F.lit(v)) for v in values])
    return F.col(column).bitwiseAND(wanted) != 0


def live_blocks(zone_map: DataFrame, *, start=None, end=None, states: Sequence[str] | None = None, customer_states: Sequence[str] | None = None,
                categories: Sequence[str] | None = None, payments: Sequence[str] | None = None,
                price_range: tuple[float, float] | None = None) -> DataFrame:
    """The blocks that may hold a row of the slice; none that does is left out."""
    tests = []
    if start is not None:
        tests.append(F.col("ts_max") >= F.lit(start).cast("timestamp"))
    if end is not None:
        tests.append(F.col("ts_min") <= F.lit(end).cast("timestamp"))
    if states:
        tests.append(_meets("state_mask", states) | _meets("seller_state_mask", states))
    if customer_states:
        tests.append(_meets("state_mask", customer_states))
    if categories:
        tests.append(_meets("category_mask", categories))
    if payments:
        tests.append(_meets("payment_mask", payments))
    if price_range:
        tests.append((F.col("price_max") >= float(price_range[0])) & (F.col("price_min") <= float(price_range[1])))
    return zone_map.filter(functools.reduce(lambda a, b: a & b, tests)).select("block") if tests else zone_map.select("block")


def read_slice(spark: SparkSession, path: str, fs: DataFrame | None = None, *, customer_states: Sequence[str] | None = None, **filters) -> DataFrame:
    """M16/M17 a slice of the written table; filters as those of ``filter_master``.

    ``customer_states`` keeps customers of these states only (``states`` also sellers of them).
    """
    from orbitcart.operators.executive import filter_master
    rows = spark.read.parquet(f"{path}/rows")
    pruning = {k: filters.get(k) for k in ("start", "end", "states", "categories", "payments", "price_range")}
    if customer_states or any(v is not None for v in pruning.values()):
        live = live_blocks(spark.read.parquet(f"{path}/zones"), customer_states=customer_states, **pruning)
        rows = rows.join(F.broadcast(live), "block", "left_semi")  # at most 2 ** (3 * MOST_BITS) rows
    if customer_states:
        rows = rows.filter(F.col(STATE).isin(list(customer_states)))
    return filter_master(rows, fs, **filters).drop("zkey", "block")
