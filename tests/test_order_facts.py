"""Order-level queries give identical results from the master and from the order facts."""
from orbitcart.operators import customers as N
from orbitcart.operators import executive as X
from orbitcart.plans.pipeline import retail

SF = "/root/testdata/sf0.001"


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_facts_paths_equal_master_paths(spark):
    r = retail(spark, SF)
    m, o, fs = r.master, r.order_facts, r.feature_store
    assert _rows(X.revenue_trend(m, "monthly")) == _rows(X.revenue_trend(m, "monthly", o))
    assert _rows(X.customer_growth(m)) == _rows(X.customer_growth(m, o))
    assert _rows(X.revenue_by_state(m)) == _rows(X.revenue_by_state(m, o))
    assert _rows(N.customer_spend(m)) == _rows(N.customer_spend(m, o))
    assert _rows(N.loyalty_trend(m)) == _rows(N.loyalty_trend(m, o))
    assert _rows(N.recently_active(m, 50)) == _rows(N.recently_active(m, 50, o))
    assert _rows(X.executive_kpis(m, fs)) == _rows(X.executive_kpis(m, fs, o))
