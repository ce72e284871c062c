"""Registry of named queries over the test tables, each with its DuckDB oracle text.

Names start with the operator id from the survey (``G5_segment_summary``). A query is a
function ``(spark, sf_dir) -> DataFrame``; the oracle is SQL over the driver's views or
``None`` when the operator is not expressible in SQL (models, streaming).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QueryFn = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, QueryFn] = {}
_ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in _QUERIES:
            raise ValueError(f"duplicate query {name}")
        _QUERIES[name] = fn
        if sql is not None:
            _ORACLE[name] = sql
        return fn
    return deco


def rounded(df: DataFrame, digits: dict[str, int]) -> DataFrame:
    """Round the named double columns (both engines sum in different orders)."""
    return df.withColumns({c: F.round(F.col(c), d) for c, d in digits.items()})


def _load_all() -> None:
    # importing the catalogue modules registers their queries
    from orbitcart.plans import catalog_core  # noqa: F401
    from orbitcart.plans import catalog_dash  # noqa: F401
    from orbitcart.plans import catalog_customers  # noqa: F401
    from orbitcart.plans import catalog_pages  # noqa: F401
    from orbitcart.plans import catalog_basket  # noqa: F401
    from orbitcart.plans import catalog_churn_clv  # noqa: F401
    from orbitcart.plans import catalog_scores  # noqa: F401
    from orbitcart.plans import catalog_reco  # noqa: F401
    from orbitcart.plans import catalog_quality_drift  # noqa: F401
    from orbitcart.plans import catalog_segment  # noqa: F401
    from orbitcart.plans import catalog_stream_io  # noqa: F401
    from orbitcart.plans import catalog_store  # noqa: F401


def all_queries() -> dict[str, QueryFn]:
    _load_all()
    return dict(_QUERIES)


def all_oracle_sql() -> dict[str, str]:
    _load_all()
    return dict(_ORACLE)
