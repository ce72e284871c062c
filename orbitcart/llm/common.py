"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orbitcart.session import ensure_checkpoint_dir

# Fixed value: the word separators of the shared text contract (space, \t \n \v \f \r).
WORD_SPACE = " \t\n\x0b\x0c\r"


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name for an intermediate table, below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from the files (cuts lineage)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def saved(df: DataFrame, name: str) -> DataFrame:
    """Like ``cut`` for larger tables: written as Parquet to the shared folder and read again."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def only(df: DataFrame, **columns: str) -> DataFrame:
    """The named columns under the operator's own names; all others stay outside."""
    return df.select(*[F.col(f"`{source}`").alias(name) for name, source in columns.items()])


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut to few rows, so that what a task builds from one batch stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def bounded(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Batches halved until they hold ``most`` bytes or one row."""
    for batch in batches:
        if batch.num_rows > 1 and batch.nbytes > most:
            half = batch.num_rows // 2
            yield from bounded(iter([batch.slice(0, half), batch.slice(half)]), most)
        else:
            yield batch


#: Rows that one partition of a small table may hold.
PARTITION_ROWS = 200_000


def packed(df: DataFrame, rows: int) -> DataFrame:
    """A written table of ``rows`` rows in no more partitions than its size asks for."""
    return df.coalesce(max(1, -(-rows // PARTITION_ROWS)))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected edges (a, b): rows (id, component = smallest id).

    Alternating large-star and small-star rounds: each keeps the components and moves every
    node nearer to its smallest one, until all are stars. Only edges are moved, each round's
    edges are written to the shared folder, and a hub's edges are combined before shuffles.
    """
    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    # tables, not checkpoints: those would keep the joins' estimated sizes, which multiply
    edges = saved(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                  .filter("u <> v").distinct(), "edges")
    seen = state(edges)
    while seen[0]:
        edges = packed(edges, seen[0])
        both = edges.select(F.col("u").alias("x"), F.col("v").alias("y")).union(edges.select("v", "u"))
        both = packed(both, 2 * seen[0])
        low = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("low"))
        large = both.join(low, "x").filter("y > x").select(F.col("y").alias("u"), F.col("low").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("low"))
        small = (large.join(low, "u").filter("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
                 .union(low.select("u", "low")))
        edges = saved(packed(small, seen[0]).distinct(), "edges")
        now = state(edges)
        if now == seen:
            break
        seen = now
    return packed(edges, seen[0]).select(F.col("u").alias("id"), F.col("v").alias("component"))
