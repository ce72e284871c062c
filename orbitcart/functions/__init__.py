"""Reusable column expressions and distributed order statistics."""

from orbitcart.functions.columns import (  # noqa: F401
    days_between, dedupe_first, first_present, money, money_avg, money_sum, pct, safe_div, title_case, to_ts,
    unpivot_metrics, when_chain,
)
from orbitcart.functions.ordering import (  # noqa: F401
    exact_percentiles, min_max, with_global_row_number, with_global_running_sum, with_rank_min,
)
