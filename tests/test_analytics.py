"""Property checks of the custom operators against brute force on small inputs."""
import itertools

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from orbitcart.operators import basket, drift, pages, recommend
from orbitcart.sources import io


def test_association_rules_brute_force(spark):
    rows = [(i, items) for i, items in enumerate(
        [["a", "b", "c"]] * 6 + [["a", "b"]] * 4 + [["b", "c"]] * 3 + [["a"]] * 2 + [["c", "d"]] * 2)]
    bsk = spark.createDataFrame(rows, "order_id long, items array<string>")
    sets = basket.frequent_itemsets(bsk, 0.2, None)
    rules = {(r.antecedents_str, r.consequents_str): r for r in basket.association_rules(sets, 0.0).collect()}
    n = len(rows)
    baskets = [set(b) for _, b in rows]
    sup = lambda s: sum(1 for b in baskets if set(s) <= b) / n
    frequent = [s for k in (1, 2, 3) for s in itertools.combinations("abcd", k) if sup(s) >= 0.2]
    expected = 0
    for s in frequent:
        if len(s) < 2:
            continue
        for k in range(1, len(s)):
            for ant in itertools.combinations(s, k):
                cons = tuple(x for x in s if x not in ant)
                expected += 1
                r = rules[(", ".join(ant), ", ".join(cons))]
                assert abs(r.confidence - sup(s) / sup(ant)) < 1e-12
                assert abs(r.lift - sup(s) / sup(ant) / sup(cons)) < 1e-12
    assert len(rules) == expected and any(len(k[1].split(", ")) == 2 for k in rules)  # multi-item consequents


def test_ks_statistic_brute_force(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(0, 1, 300).round(2), rng.normal(0.3, 1, 200).round(2)
    ref = spark.createDataFrame(pd.DataFrame({"x": a}))
    cur = spark.createDataFrame(pd.DataFrame({"x": b}))
    got = drift.ks_test(ref, cur, ["x"]).first()
    grid = np.union1d(a, b)
    d = np.max(np.abs(np.searchsorted(np.sort(a), grid, "right") / len(a) -
                      np.searchsorted(np.sort(b), grid, "right") / len(b)))
    assert abs(got.ks_statistic - round(d, 4)) < 1e-9
    assert 0.0 <= got.p_value <= 1.0 and got.drift_detected == (got.p_value < 0.05)


def _shop(spark, seed=5):
    """Purchases of 60 customers among 40 products in 4 categories, one customer with all of them."""
    rng = np.random.default_rng(seed)
    rows = [(c, int(p), int(rng.integers(1, 4))) for c in range(60) for p in rng.choice(40, rng.integers(1, 12), replace=False)]
    rows += [(99, p, 1) for p in range(40)]
    inter = spark.createDataFrame([(c, p, n, f"cat_{p % 4}") for c, p, n in rows], "customer_unique_id long, product_id long, n long, category string")
    pop = inter.groupBy("product_id", F.col("category").alias(recommend.CAT)).agg(F.sum("n").alias("total_units"), F.lit(3.0).alias("avg_rating"))
    return rows, inter, pop


def _cosines(rows):
    x = np.zeros((100, 40))
    for c, p, n in rows:
        x[c, p] = n
    return (x.T @ x) / np.outer(np.linalg.norm(x, axis=0), np.linalg.norm(x, axis=0))


def test_neighbours_have_exact_cosines(spark):
    rows, inter, _ = _shop(spark)
    sim = _cosines(rows)
    for bucket in (256, 2):  # with 2 every bucket is split by the second hash
        near = recommend.neighbours(inter, 6, bucket=bucket).collect()
        assert near and all(abs(r.sim - sim[r.product_id, r.neighbour_id]) < 1e-9 and r.product_id != r.neighbour_id for r in near)
        for p in {r.product_id for r in near}:
            own = sorted((-r.sim, r.neighbour_id) for r in near if r.product_id == p)
            assert [r[1] for r in own] == [r.neighbour_id for r in sorted((r for r in near if r.product_id == p), key=lambda r: r["rank"])]


def test_neighbours_are_the_best_of_all_products(spark):
    rows, inter, _ = _shop(spark)
    sim = _cosines(rows)
    best = {(p, q, rank) for p in range(40) for rank, q in enumerate(sorted((q for q in range(40) if q != p and sim[p, q] > 0),
                                                                           key=lambda q: (-round(sim[p, q], 10), q))[:6], 1)}
    for bucket in (256, 20, 8, 2):  # customers with more products than these count by profiles
        near = recommend.neighbours(inter, 6, bucket=bucket).collect()
        assert {(r.product_id, r.neighbour_id, r["rank"]) for r in near} == best
        assert all(abs(r.sim - sim[r.product_id, r.neighbour_id]) < 1e-9 for r in near)


def test_recommendations_equal_brute_force(spark):
    rows, inter, pop = _shop(spark)
    near = recommend.neighbours(inter, 6)
    sims = {(r.product_id, r.neighbour_id): r.sim for r in near.collect()}
    units = {r.product_id: r.total_units for r in pop.collect()}
    affinity = recommend.content_affinity(inter, recommend.category_similarity(pop))
    got = {}
    for r in recommend.recommend(inter, near, affinity, pop, 5).collect():
        got.setdefault(r.customer_unique_id, []).append((r.rec_rank, r.product_id, round(r.hybrid_score, 8)))
    bought = {}
    for c, p, _ in rows:
        bought.setdefault(c, set()).add(p)
    for c, own in bought.items():
        scores = {t: sum(0.6 * sims.get((p, t), 0) + 0.4 * (p % 4 == t % 4) for p in own) for t in units if t not in own}
        best = sorted((-round(s, 10), -units[t], t) for t, s in scores.items() if s > 0)[:5]
        assert sorted(got.get(c, [])) == [(i, t, round(-s, 8)) for i, (s, _, t) in enumerate(best, 1)]


def test_category_similarity_of_several_words(spark):
    pop = spark.createDataFrame([(1, "home decor"), (2, "home garden"), (3, "the toys"), (4, "home decor")], f"product_id long, {recommend.CAT} string")
    got = {(r.category, r.other): r.sim for r in recommend.category_similarity(pop).collect()}
    assert got["home decor", "home decor"] == 1 and got["the toys", "the toys"] == 1
    assert 0 < got["home decor", "home garden"] < 1 and ("the toys", "home decor") not in got


def test_cold_start_and_priorities(spark):
    _, inter, pop = _shop(spark)
    pop = pop.withColumn("avg_price", F.lit(2.0))
    customers = spark.range(5).select(F.col("id").alias("customer_unique_id"))
    cold = recommend.cold_start(customers, customers.where("customer_unique_id < 3"), pop, 4).collect()
    assert sorted({r.customer_unique_id for r in cold}) == [3, 4] and len(cold) == 8 and {r.rec_rank for r in cold} == {1, 2, 3, 4}
    recs = spark.createDataFrame([(1, 7, "a", 1.0, "hybrid"), (2, 7, "a", 1.0, "upsell"), (3, 7, "a", 1.0, "x"), (4, 7, "a", 1.0, "upsell")],
                                 "customer_unique_id long, product_id long, category string, hybrid_score double, recommendation_type string")
    ctx = spark.createDataFrame([(1, "Gold (Top 20%)", "High"), (2, "Bronze", "Low"), (4, "Platinum (Top 5%)", "Low")],
                                "customer_unique_id long, clv_value_tier string, risk_level string")
    got = {r.customer_unique_id: r.priority[:2] for r in recommend.opportunity_matrix(recs, ctx).collect()}
    assert got == {1: "P1", 2: "P3", 3: "P4", 4: "P2"}


def test_category_ratings_and_basket_kpis_are_whole(spark, tmp_path):
    names = [f"category number {i:02d}" for i in range(9)]
    master = spark.createDataFrame([(o, c, 1, 3.0 + o % 2) for o in range(4) for c in names[o % 2:]],
                                   f"order_id long, {pages.CAT} string, order_item_id long, avg_review_score double")
    assert {r[0] for r in pages.category_rating_radar(master).collect()} == set(names)
    assert [r[0] for r in pages.category_rating_radar(master, 6).orderBy(pages.CAT).collect()] == names[:6]
    rules = spark.createDataFrame([(f"first side {i:02d}", "second side", 1.0 + i / 100) for i in range(45)],
                                  "antecedents_str string, consequents_str string, lift double")
    sets = spark.createDataFrame([(["a"],)], "items array<string>")
    bsk = basket.baskets(master)

    def kpis(**cuts):
        return {r.kpi: r.value for r in basket.basket_kpis(master, bsk, sets, rules, **cuts).collect()}

    whole, shown = kpis(), kpis(name_chars=18, cross_sell_rules=30)
    assert whole["top_bundle"] == "first side 44 + second side" and whole["cross_sell_opportunities"] == "45"
    assert shown["top_bundle"] == "first side 44 + se" and shown["cross_sell_opportunities"] == "30"
    assert {k for k in whole if whole[k] != shown[k]} == {"top_bundle", "cross_sell_opportunities"}
    none = {r.kpi: r.value for r in basket.basket_kpis(master, bsk, sets, rules.limit(0)).collect()}
    assert none["top_bundle"] == "N/A" and none["cross_sell_opportunities"] == "0"
    with open(tmp_path / "audit.log", "w") as f:
        f.write("".join(f"[2024-01-01 00:00:{i:02d}] [AUDIT] Model='m' Version='v1' Entity='{i}' Action='a' Details='d'\n" for i in range(60)))
    assert io.parse_audit_log(spark, str(tmp_path / "audit.log")).count() == 60
    assert io.parse_audit_log(spark, str(tmp_path / "audit.log"), 50).count() == 50
