"""Column-level helpers shared by the operators (all native Spark expressions)."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MICROS_PER_DAY = 86_400_000_000.0


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def first_present(df: DataFrame, candidates: Sequence[str], default: str | None = None) -> str | None:
    """First candidate column name present in ``df`` (resolved at plan-build time, no job)."""
    cols = set(df.columns)
    for c in candidates:
        if c in cols:
            return c
    return default


def days_between(later: str | Column, earlier: str | Column) -> Column:
    """Fractional days ``later - earlier`` (timedelta.total_seconds()/86400)."""
    return (F.unix_micros(col(later).cast("timestamp")) -
            F.unix_micros(col(earlier).cast("timestamp"))) / F.lit(MICROS_PER_DAY)


def to_ts(c: str | Column) -> Column:
    """Coerce to timestamp; unparsable text becomes null (pandas errors='coerce')."""
    return F.try_to_timestamp(col(c).cast("string"))


def coerce_timestamp(df: DataFrame, name: str) -> DataFrame:
    if name not in df.columns:
        return df
    dtype = df.schema[name].dataType
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return df
    if isinstance(dtype, T.DateType):
        return df.withColumn(name, F.col(name).cast("timestamp"))
    return df.withColumn(name, to_ts(name))


def title_case(c: str | Column) -> Column:
    """Trimmed title case (initcap capitalises after spaces only; see README)."""
    return F.initcap(F.trim(col(c)))


# Money is held in cents. Sums are snapped back to the cent grid: the exact sum of cent
# values lies on it, and the snap removes the summation-order noise of doubles, so a result
# does not depend on how Spark partitioned the input.
MONEY_SCALE = 2


def money(c: str | Column, digits: int = MONEY_SCALE) -> Column:
    return F.round(col(c), digits)


def money_sum(c: str | Column, digits: int = MONEY_SCALE) -> Column:
    return F.round(F.sum(col(c)), digits)


def money_avg(c: str | Column, digits: int = MONEY_SCALE) -> Column:
    """Mean of a money column from its snapped sum (``avg`` is ``sum / count`` too)."""
    return F.round(F.sum(col(c)), digits) / F.count(col(c))


def safe_div(num: Column, den: Column, default: float | None = 0.0) -> Column:
    d = F.lit(default) if default is not None else F.lit(None).cast("double")
    return F.when(den != 0, num / den).otherwise(d)


def pct(num: Column, den: Column, digits: int = 2) -> Column:
    return F.round(safe_div(num * 100.0, den), digits)


def when_chain(pairs: Iterable[tuple[Column, object]], otherwise: object) -> Column:
    expr = None
    for cond, value in pairs:
        v = value if isinstance(value, Column) else F.lit(value)
        expr = F.when(cond, v) if expr is None else expr.when(cond, v)
    other = otherwise if isinstance(otherwise, Column) else F.lit(otherwise)
    return other if expr is None else expr.otherwise(other)


def dedupe_first(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column] | None = None) -> DataFrame:
    """Keep one row per key: the first by ``order`` (default: scan position).

    A hash aggregate with ``min_by`` so a hot key is combined map-side instead of being
    sorted in one task as a ``row_number`` window would be.
    """
    cols = df.columns
    if order is None:
        df = df.withColumn("__pos", F.monotonically_increasing_id())
        order_col = F.col("__pos")
    else:
        order_col = F.struct(*[col(o) for o in order])
    rest = [c for c in cols if c not in keys]
    if not rest:
        return df.select(*keys).distinct()
    packed = F.min_by(F.struct(*[F.col(c) for c in rest]), order_col).alias("__row")
    return df.groupBy(*keys).agg(packed).select(*keys, *[F.col(f"__row.{c}").alias(c) for c in rest]).select(*cols)


def unpivot_metrics(df: DataFrame, ids: Sequence[str], metrics: Sequence[str],
                    name_col: str = "metric", value_col: str = "value") -> DataFrame:
    """Wide one-row metric frame -> long (metric, value) rows, values as double."""
    casted = df.select(*ids, *[F.col(m).cast("double").alias(m) for m in metrics])
    return casted.unpivot(list(ids), list(metrics), name_col, value_col)


def trunc_like(unit: str, df: DataFrame, name: str) -> Column:
    """``date_trunc`` that keeps the input column's timestamp type (Spark returns a zoned
    timestamp even for TIMESTAMP_NTZ input)."""
    return F.date_trunc(unit, F.col(name)).cast(df.schema[name].dataType)
