"""Global order statistics without funnelling rows through one task.

A window with ``orderBy`` and no ``partitionBy`` moves every row to a single task. These
helpers instead range-partition on the full sort key (Spark samples the key to pick the
bounds, so heavy ties in the leading column are split by the tie-break columns), number
rows inside each range, and add the row count of all earlier ranges. The per-range count
table has one row per partition, so broadcasting it is bounded by the partition count.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orbitcart.functions.ranks import exact_percentiles  # noqa: F401

_LOCAL_BITS = 33  # monotonically_increasing_id = partition index << 33 | row position


def _partitions(df: DataFrame, num_partitions: int | None) -> int:
    if num_partitions:
        return num_partitions
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))


def _ranged(df: DataFrame, order_by: Sequence[Column], num_partitions: int | None) -> DataFrame:
    """Range-partition, sort and index the rows, materialised once.

    The per-range offsets and the per-row positions must come from the same partitioning.
    Re-evaluating a range exchange can sample different bounds (shuffle fetch order feeds the
    sampler), so the indexed frame is written once to the shared checkpoint folder and both
    consumers read that copy; a lost executor re-reads it instead of re-sampling.
    """
    n = _partitions(df, num_partitions)
    ranged = (df.repartitionByRange(n, *order_by)
                .sortWithinPartitions(*order_by)
                .withColumn("__mid", F.monotonically_increasing_id())
                .withColumn("__pid", F.shiftright(F.col("__mid"), _LOCAL_BITS))
                .withColumn("__local", F.col("__mid").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1))))
    return materialize(ranged)


def materialize(df: DataFrame, join: bool = False) -> DataFrame:
    """Compute once (persisted while writing) and read back from a reliable checkpoint.

    With ``join``, partitions of a large frame that hold few rows are joined first (``packed``).
    """
    from pyspark import StorageLevel

    from orbitcart.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(df.sparkSession)
    kept = df.persist(StorageLevel.MEMORY_AND_DISK)
    out = (packed(kept) if join else kept).checkpoint(eager=True)
    kept.unpersist()
    return out


#: Rows that a task of an iterative fit takes, and rows up to which a frame keeps its partitions.
ROWS_PER_TASK, KEEPS_PARTITIONS = 50_000, 100_000


def packed(stored: DataFrame, rows: int = ROWS_PER_TASK, keeps: int = KEEPS_PARTITIONS) -> DataFrame:
    """All rows of a stored frame in as many partitions as they fill, for fits of many small stages.

    Each stage of such a fit sends one result a task to the driver, so the tasks should follow the rows
    and not the number of shuffle partitions. Partitions are joined without a shuffle, at least one for
    each core stays. Random draws of the fits follow the partitions; frames of up to ``keeps`` rows
    keep theirs, so their models do not depend on the cores at hand.
    """
    n = stored.count()
    if n <= keeps:
        return stored
    return stored.coalesce(max(stored.sparkSession.sparkContext.defaultParallelism, -(-n // rows)))


def packed_small(stored: DataFrame, rows: int = ROWS_PER_TASK, up_to: int = KEEPS_PARTITIONS) -> DataFrame:
    """All rows of a frame that ``packed`` leaves alone in as few partitions as they fill, for fits that do not
    draw rows by partition; larger frames stay as they are."""
    n = stored.count()
    return stored.coalesce(max(1, -(-n // rows))) if n <= up_to else stored


def _offsets(ranged: DataFrame, weight: Column | None = None) -> DataFrame:
    agg = F.count(F.lit(1)) if weight is None else F.sum(weight)
    per = ranged.groupBy("__pid").agg(agg.alias("__w"))
    # one row per partition: a single-task window here is bounded by the partition count
    w = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    return per.select("__pid", F.coalesce(F.sum("__w").over(w), F.lit(0)).alias("__off"))


def with_global_row_number(df: DataFrame, order_by: Sequence[Column], out: str = "rn",
                           num_partitions: int | None = None) -> DataFrame:
    """``row_number() over (order by ...)`` computed in parallel.

    ``order_by`` must be a total order (end with a unique key) for a repeatable answer.
    """
    ranged = _ranged(df, order_by, num_partitions)
    offsets = _offsets(ranged)
    return (ranged.join(F.broadcast(offsets), "__pid")
                  .withColumn(out, F.col("__off") + F.col("__local") + F.lit(1))
                  .drop("__mid", "__pid", "__local", "__off"))


def with_global_running_sum(df: DataFrame, order_by: Sequence[Column], value: str | Column | dict,
                            out: str | None = None, num_partitions: int | None = None) -> DataFrame:
    """Inclusive running ``sum(value) over (order by ... rows unbounded preceding)``.

    ``value`` may be a dict ``{out_name: column}`` to get several running sums (e.g. a row
    number as the running sum of 1 next to a cumulative revenue) from one range shuffle.
    """
    values = value if isinstance(value, dict) else {out: value}
    tmp = {f"__val{i}": (F.col(v) if isinstance(v, str) else v) for i, v in enumerate(values.values())}
    ranged = _ranged(df.withColumns(tmp), order_by, num_partitions)
    per = ranged.groupBy("__pid").agg(*[F.sum(k).alias(f"__w{i}") for i, k in enumerate(tmp)])
    wo = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per.select("__pid", *[F.coalesce(F.sum(f"__w{i}").over(wo), F.lit(0)).alias(f"__off{i}")
                                    for i in range(len(tmp))])
    w = Window.partitionBy("__pid").orderBy("__local").rowsBetween(Window.unboundedPreceding, 0)
    res = ranged.withColumns({f"__run{i}": F.sum(k).over(w) for i, k in enumerate(tmp)}) \
                .join(F.broadcast(offsets), "__pid")
    res = res.withColumns({name: F.col(f"__off{i}") + F.col(f"__run{i}") for i, name in enumerate(values)})
    drop = ["__mid", "__pid", "__local", *tmp, *[f"__off{i}" for i in range(len(tmp))],
            *[f"__run{i}" for i in range(len(tmp))]]
    return res.drop(*drop)


def with_rank_min(df: DataFrame, value: str, out: str, descending: bool = True,
                  num_partitions: int | None = None) -> DataFrame:
    """``rank()`` (ties share the lowest rank) over one column, without a single-task window.

    Counts per distinct value are combined map-side, so a value held by a third of all rows
    costs one row here; ranks come from a running sum over the distinct values.
    """
    counts = df.groupBy(value).agg(F.count(F.lit(1)).alias("__c"))
    order = [F.col(value).desc() if descending else F.col(value).asc()]
    ranks = with_global_running_sum(counts, order, "__c", "__cum", num_partitions)
    ranks = ranks.select(value, (F.col("__cum") - F.col("__c") + 1).cast("int").alias(out))
    return df.join(ranks, value, "left")


def min_max(df: DataFrame, value: str) -> tuple[Column, Column]:
    """(min, max) of a column as two lazily evaluated scalar-subquery columns."""
    return df.agg(F.min(value)).scalar(), df.agg(F.max(value)).scalar()
