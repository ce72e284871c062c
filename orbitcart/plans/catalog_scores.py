"""Registered queries: the churn and CLV pages on the stored scores of the fitted models (I7, J6).

The pages are those of ``catalog_churn_clv``. The driver's tables hold no scores, so these queries
have no oracle SQL there; ``sql_over_scores`` is the page's own SQL with the rule replaced by the
views ``churn_scores`` and ``clv_scores``, and tests run it over the stored tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from orbitcart.operators import churn as I
from orbitcart.plans import catalog_churn_clv as pages
from orbitcart.plans.jobs import jobs
from orbitcart.plans.registry import _ORACLE, query

Page = Callable[[DataFrame], DataFrame]

CHURN_PAGES: dict[str, Page] = {
    "I9_risk_tiers": pages.risk_page,
    "I10_retention_actions": pages.actions_page,
    "I11_high_risk_roster": pages.roster_page,
    "I12_risk_distribution": I.risk_distribution,
    "I13_churn_kpis": pages.churn_kpi_page,
    "I18_batch_summary": pages.batch_page,
    "I19_retention_targets": I.retention_targets,
}

CLV_PAGES: dict[str, Page] = {
    "J7_value_tiers": pages.tier_page,
    "J8_opportunities": pages.opportunity_page,
    "J9_high_value_roster": pages.value_roster_page,
    "J10_monthly_projection": pages.projection_page,
}


def model_name(name: str) -> str:
    """``I12_risk_distribution`` -> ``I12_model_risk_distribution``."""
    return name.replace("_", "_model_", 1)


def sql_over_scores(name: str) -> str:
    """The page's SQL over the views churn_scores / clv_scores (customer_unique_id and the score)."""
    by_rule = {f"{pages._P} AS churn_probability FROM fs": "s.churn_probability FROM fs JOIN churn_scores s USING (customer_unique_id)",
               "greatest(clv_target, 0.0) AS predicted_clv FROM cf1": "s.predicted_clv FROM cf1 JOIN clv_scores s USING (customer_unique_id)"}
    sql = _ORACLE[name]
    for rule, stored in by_rule.items():
        sql = sql.replace(rule, stored)
    if sql == _ORACLE[name]:
        raise ValueError(f"{name} reads no score")
    return sql


def _register(name: str, page: Page, frame: str) -> None:
    @query(model_name(name))
    def run(spark, sf):
        return page(getattr(jobs(spark, sf), frame))


for _name, _page in CHURN_PAGES.items():
    _register(_name, _page, "model_scored")
for _name, _page in CLV_PAGES.items():
    _register(_name, _page, "model_clv")
