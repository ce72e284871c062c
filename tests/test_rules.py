"""Rules with a default: label fallback, movements of spend, one list of states, audit entries in order."""

import datetime as dt

from orbitcart.operators import churn, clv, executive
from orbitcart.sources import io


def test_label_probability_falls_back_to_a_quarter(spark):
    df = spark.createDataFrame([(1, 1), (2, 0), (3, None)], "customer_unique_id long, churn_label int")
    got = {r["customer_unique_id"]: round(r["churn_probability"], 6) for r in churn.rule_probability(df, "label").collect()}
    assert got == {1: 0.85, 2: 0.10, 3: 0.25}
    assert {r["churn_probability"] for r in churn.rule_probability(df.drop("churn_label"), "label").collect()} == {0.25}


def test_spend_movers(spark):
    end = dt.datetime(2020, 6, 30)
    day = dt.timedelta(days=1)
    sales = [(1, end, 130.0), (1, end - 40 * day, 100.0),  # up 30 %
             (2, end - 5 * day, 75.0), (2, end - 31 * day, 60.0), (2, end - 59 * day, 40.0),  # down 25 %
             (3, end - 10 * day, 500.0),  # nothing before
             (4, end - 35 * day, 50.0), (4, end - 70 * day, 900.0),  # all gone; what lies further back does not count
             (5, end - 1 * day, 100.0), (5, end - 45 * day, 100.0), (6, None, 10.0)]
    master = spark.createDataFrame(sales, "customer_unique_id long, order_purchase_timestamp timestamp, price double")
    spent = {r["customer_unique_id"]: (r["spend_last"], r["spend_before"]) for r in clv.spend_of_periods(master).collect()}
    assert spent == {1: (130.0, 100.0), 2: (75.0, 100.0), 3: (500.0, 0.0), 4: (0.0, 50.0), 5: (100.0, 100.0)}
    # the tier follows the lifetime value: find a Silver one by the rule itself
    tiers = spark.range(0, 3000, 100).selectExpr("cast(id as double) AS v")
    silver = next(r["v"] for r in tiers.select("v", clv.fixed_tier(tiers.v).alias("t")).collect() if r["t"] == "Silver")
    df = spark.createDataFrame([(i, silver) for i in range(1, 8)], "customer_unique_id long, historical_clv double")
    got = {r["opportunity_group"].split(":")[0]: (r["candidate_count"], r["total_clv"]) for r in clv.spend_movers(df, master).collect()}
    assert got == {"Growing": (1, silver), "Declining": (2, 2 * silver)}
    none = clv.spend_movers(df, master.limit(0)).collect()
    assert [(r["candidate_count"], r["total_clv"]) for r in none] == [(0, 0.0), (0, 0.0)]


def test_states_of_customers_and_sellers_are_one_list(spark):
    master = spark.createDataFrame([("SP", "RJ"), ("SP", "SP"), (None, "AM")], "customer_state string, seller_state string")
    fs = spark.createDataFrame([("Champions", "Gold"), (None, "Gold")], "rfm_segment string, spending_tier string")
    got = sorted(tuple(r) for r in executive.united_options(master, fs).collect())
    assert got == [("segment", "Champions"), ("segment", "Gold"), ("state", "AM"), ("state", "RJ"), ("state", "SP")]


def test_audit_entries_newest_first(spark, tmp_path):
    line = "[2024-01-0{} 00:00:00] [AUDIT] Model='m' Version='v' Entity='{}' Action='a' Details='it''s {}'"
    (tmp_path / "a.log").write_text("\n".join([line.format(1, "x", 1), "noise", line.format(2, "b", 2), line.format(2, "a", 3)]))
    got = [(r["ts"].day, r["entity"], r["details"]) for r in io.parse_audit_log(spark, str(tmp_path), 2).collect()]
    assert got == [(2, "a", "it''s 3"), (2, "b", "it''s 2")]
