"""B — data quality: counts, duplicate rows, null cells, key duplicates, domain checks,
per-table summary, quality score and column profile.

Everything is one or two aggregation passes per table; the column profile counts distinct
values per column from an unpivoted (column, value) table so wide tables do not multiply
rows once per ``count(distinct)`` expression.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Per-table key and domain checks of the reference.
KEY_CHECKS = {"orders": "order_id", "customers": "customer_id"}
NEGATIVE_CHECKS = {"order_items": ("price", "freight_value"), "payments": ("payment_value",)}
STATUS_CHECK = ("orders", "order_status")


def table_stats(name: str, df: DataFrame) -> DataFrame:
    """B1-B6 one row: rows, columns, duplicate rows (all but the first copy), null cells,
    duplicate keys, missing status, negative value counts."""
    cols = df.columns
    nulls = [F.count_if(F.col(c).isNull()).alias(f"null__{c}") for c in cols]
    base = df.agg(F.count(F.lit(1)).alias("total_rows"), *nulls)
    dup_rows = df.groupBy(*cols).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("d")).scalar()
    extra = {}
    key = KEY_CHECKS.get(name)
    if key and key in cols:
        # pandas duplicated() treats null as one value: rows - distinct non-null keys - (1 if any null)
        k = df.agg((F.count(F.lit(1)) - F.countDistinct(key) -
                    F.max(F.col(key).isNull().cast("int"))).alias("k")).scalar()
        extra["duplicate_keys"] = F.coalesce(k, F.lit(0)).cast("long")
    if name == STATUS_CHECK[0] and STATUS_CHECK[1] in cols:
        extra["missing_status"] = F.col(f"null__{STATUS_CHECK[1]}")
    negs = [F.count_if(F.col(c) < 0) for c in NEGATIVE_CHECKS.get(name, ()) if c in cols]
    neg_total = df.agg(*[n.alias(f"n{i}") for i, n in enumerate(negs)]).select(
        functools.reduce(lambda a, b: a + b, [F.col(f"n{i}") for i in range(len(negs))])).scalar() if negs else None
    null_total = functools.reduce(lambda a, b: a + b, [F.col(f"null__{c}") for c in cols]) if cols else F.lit(0)
    out = base.select(F.lit(name).alias("table_name"), "total_rows", F.lit(len(cols)).alias("total_columns"),
                      dup_rows.alias("duplicate_rows"), null_total.alias("missing_cells"),
                      *[v.alias(k) for k, v in extra.items()],
                      *([neg_total.alias("negative_values")] if neg_total is not None else []))
    return out


def missing_by_column(name: str, df: DataFrame) -> DataFrame:
    """B3 null cells per column, only columns with at least one null."""
    cols = df.columns
    wide = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    long = wide.unpivot([], cols, "column_name", "null_cells")
    return long.where(F.col("null_cells") > 0).select(F.lit(name).alias("table_name"), "column_name", "null_cells")


def quality_summary(tables: dict[str, DataFrame]) -> DataFrame:
    """B7 per table: rows, columns, duplicate rows and missing cells with rates (2 decimals)."""
    rows = [table_stats(n, df).select("table_name", "total_rows", "total_columns", "duplicate_rows", "missing_cells")
            for n, df in tables.items()]
    s = functools.reduce(DataFrame.unionByName, rows)
    return s.withColumns({
        "duplicate_rate_pct": F.round(F.when(F.col("total_rows") > 0, F.col("duplicate_rows") * 100.0 /
                                             F.col("total_rows")).otherwise(0.0), 2),
        "missing_rate_pct": F.round(F.when(F.col("total_rows") * F.col("total_columns") > 0,
                                           F.col("missing_cells") * 100.0 / (F.col("total_rows") * F.col("total_columns")))
                                    .otherwise(0.0), 2)})


def quality_score(summary: DataFrame) -> DataFrame:
    """B8 max(100 - (2 x missing % + 3 x duplicate %), 0) over all tables."""
    t = summary.agg(F.sum("missing_cells").alias("m"), F.sum(F.col("total_rows") * F.col("total_columns")).alias("c"),
                    F.sum("duplicate_rows").alias("d"), F.sum("total_rows").alias("r"))
    miss = F.when(F.col("c") > 0, F.col("m") * 100.0 / F.col("c")).otherwise(0.0)
    dup = F.when(F.col("r") > 0, F.col("d") * 100.0 / F.col("r")).otherwise(0.0)
    return t.select(F.round(F.greatest(100.0 - (2.0 * miss + 3.0 * dup), F.lit(0.0)), 2).alias("quality_score"),
                    F.round(miss, 2).alias("missing_pct"), F.round(dup, 2).alias("duplicate_pct"))


def column_profile(name: str, df: DataFrame, max_columns: int | None = None, approximate: bool = False) -> DataFrame:
    """B9 type, null count and distinct count of every column, or of the first ``max_columns``."""
    cols = df.columns[:max_columns]
    types = dict(df.dtypes)
    nulls = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols]).unpivot([], cols, "column_name", "null_count")
    if approximate:
        dist = df.agg(*[F.approx_count_distinct(c).alias(c) for c in cols]).unpivot(
            [], cols, "column_name", "distinct_count")
    else:
        long = df.select(*[F.col(c).cast("string").alias(c) for c in cols]).unpivot([], cols, "column_name", "v")
        dist = long.where(F.col("v").isNotNull()).distinct().groupBy("column_name").agg(
            F.count(F.lit(1)).alias("distinct_count"))
    tdf = df.sparkSession.createDataFrame([(c, types[c], i) for i, c in enumerate(cols)],
                                          "column_name string, data_type string, position int")
    return (tdf.join(nulls, "column_name").join(dist, "column_name", "left")
               .select(F.lit(name).alias("table_name"), "position", "column_name", "data_type", "null_count",
                       F.coalesce("distinct_count", F.lit(0)).cast("long").alias("distinct_count")))
