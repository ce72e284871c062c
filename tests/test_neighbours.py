import numpy as np

from orbitcart.operators import recommend as K
from orbitcart.session import written_table

SCHEMA = "customer_unique_id long, product_id long, n long, category string"


def brute_force(counts, n):
    m = np.zeros((1 + max(c for c, _, _ in counts), 1 + max(p for _, p, _ in counts)))
    for c, p, k in counts:
        m[c, p] = k
    dots, norm = m.T @ m, np.sqrt((m * m).sum(0))
    out = []
    for p in np.flatnonzero(norm):
        with np.errstate(divide="ignore", invalid="ignore"):
            sims = np.round(dots[p] / (norm[p] * norm), K.SCORE_DIGITS)
        others = [(-sims[q], q) for q in np.flatnonzero(dots[p]) if q != p]
        out += [(p, q, -s, r + 1) for r, (s, q) in enumerate(sorted(others)[:n])]
    return sorted(out)


def check(spark, counts, n, bucket):
    inter = spark.createDataFrame([(c, p, k, "x") for c, p, k in counts], SCHEMA)
    got = sorted((r.product_id, r.neighbour_id, r.sim, r["rank"]) for r in K.neighbours(inter, n, bucket).collect())
    want = brute_force(counts, n)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:2] == w[:2] and g[3] == w[3] and abs(g[2] - w[2]) < 2e-10


def busy_counts(rng):
    """A customer with every product, 12 busy ones with 60 products of their own each, light ones across them."""
    counts = {}
    for p in range(720):
        counts[0, p] = int(rng.integers(1, 40))
        counts[1 + p // 60, p] = int(rng.integers(1, 40))
    for c in range(20, 60):
        for p in rng.choice(720, 6, replace=False):
            counts[c, int(p)] = int(rng.integers(1, 4))
    for p in range(720, 780):
        counts[0, p] = 1 + p % 2  # products of the first customer alone
    return [(c, p, k) for (c, p), k in counts.items()]


def test_busy_customers_exact(spark):
    check(spark, busy_counts(np.random.default_rng(2)), 5, 20)


def test_bounds_leave_most_pairs_out(spark):
    rng = np.random.default_rng(3)
    counts = [(0, p, int(rng.integers(1, 60))) for p in range(1500)] + [(1 + p // 100, p, int(rng.integers(1, 60))) for p in range(1500)]
    inter = spark.createDataFrame([(c, p, k, "x") for c, p, k in counts], SCHEMA)
    rows = inter.select(K.KEY, "product_id", "n")
    members = written_table(K._profiles(rows))
    entries = rows.join(members, "product_id").select(K.KEY, "profile", "n").distinct()
    norms = rows.selectExpr("product_id", "n * n AS s").groupBy("product_id").sum("s").selectExpr("product_id AS neighbour_id", "sqrt(`sum(s)`) AS norm")
    shelf = members.withColumnRenamed("product_id", "neighbour_id").join(norms, "neighbour_id")
    _, pairs = K.best_of_busy(entries, shelf, 6)
    assert pairs.count() < 0.15 * members.select("profile").distinct().count() ** 2
    check(spark, counts, 5, 20)


def test_equal_counts_and_ties(spark):
    """Every customer bought every product once or twice: whole profiles tie."""
    check(spark, [(c, p, 1 + (p % 3 == 0)) for c in range(4) for p in range(60)], 7, 10)


def test_fewer_neighbours_than_asked(spark):
    check(spark, [(0, p, p + 1) for p in range(4)] + [(1, 10, 1), (1, 11, 2), (2, 20, 5)], 5, 1)


def test_light_customers_need_no_table_of_pairs(spark, monkeypatch):
    """Many small tasks, sums in several steps, rows given twice, customers without id: same as brute force."""
    rng = np.random.default_rng(5)
    counts = [(c, int(p), int(rng.integers(1, 4))) for c in range(40) for p in rng.choice(50, 8, replace=False)]

    def no_pairs(*_):
        raise AssertionError("pairs of products were joined")

    monkeypatch.setattr(K, "_shared", no_pairs)
    monkeypatch.setattr(K, "TASK_PAIRS", 100)
    check(spark, counts, 4, 256)
    rows = spark.createDataFrame([(c, p, k) for c, p, k in counts] + [(None, 1, 2), (None, 2, 2)], "customer_unique_id long, product_id long, n long")
    near = K._near_by_baskets(rows, K._numbers(rows), 4, task_pairs=300)
    assert near.rdd.getNumPartitions() >= 1 and {(r.product_id, r.neighbour_id) for r in near.collect()} > set()
    norm, dots = {}, {}
    for c, p, k in [*counts, (None, 1, 2), (None, 2, 2)]:
        norm[p] = norm.get(p, 0) + k * k
    for c, p, k in counts:
        for d, q, m in counts:
            if c == d and p != q:
                dots[p, q] = dots.get((p, q), 0) + k * m
    for r in near.collect():
        assert abs(r.sim - dots[r.product_id, r.neighbour_id] / (norm[r.product_id] * norm[r.neighbour_id]) ** 0.5) < 2e-10


def test_recommendations_are_cut_before_they_are_joined(spark, monkeypatch):
    """Scores as by adding up all targets, with sums in several steps; targets outside the best reach no join."""
    from pyspark.sql import functions as F
    rng = np.random.default_rng(6)
    kind = {p: f"k{p % 4}" for p in range(60)}
    counts = [(c, int(p), 1) for c in range(50) for p in rng.choice(60, 9, replace=False)]
    inter = spark.createDataFrame([(c, p, k, kind[p]) for c, p, k in counts], SCHEMA)
    pop = spark.createDataFrame([(p, kind[p], 1 + p % 5, 3.0) for p in kind], "product_id long, product_category_name_english string, total_units long, avg_rating double")
    near = K.neighbours(inter, 8)
    affinity = K.content_affinity(inter, K.category_similarity(pop))
    monkeypatch.setattr(K, "TASK_PAIRS", 200)
    emitted = []
    best_collab = K._best_collab

    def counted(*args):
        emitted.append(best_collab(*args))
        return emitted[-1]

    monkeypatch.setattr(K, "_best_collab", counted)
    got = {(r.customer_unique_id, r.rec_rank): (r.product_id, round(r.hybrid_score, 9)) for r in K.recommend(inter, near, affinity, pop, 5).collect()}
    assert emitted  # the targets are cut where they are added up
    like = {(r.customer_unique_id, r.category): r.affinity for r in affinity.collect()}
    sims = {}
    for r in near.select("product_id", "neighbour_id", F.col("sim")).collect():
        sims.setdefault(r.product_id, []).append((r.neighbour_id, r.sim))
    want = {}
    for c in range(50):
        bought = {p for d, p, _ in counts if d == c}
        score = {p: 0.4 * like.get((c, kind[p]), 0.0) for p in kind}
        for p in bought:
            for q, s in sims.get(p, []):
                score[q] += 0.6 * s
        ranked = sorted((-round(s, 10), -(1 + p % 5), p) for p, s in score.items() if p not in bought and s > 0)
        want |= {(c, i + 1): (p, round(-s, 9)) for i, (s, _, p) in enumerate(ranked[:5])}
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-8 for k in want)


def test_pairs_are_exchanged_in_rounds(spark, monkeypatch):
    """Before, all baskets and all purchases' neighbours were on the disks at once."""
    rng = np.random.default_rng(8)
    counts = [(c, int(p), int(rng.integers(1, 4)), f"k{p % 3}") for c in range(40) for p in rng.choice(50, 8, replace=False)]
    inter = spark.createDataFrame(counts, SCHEMA)
    pop = spark.createDataFrame([(p, f"k{p % 3}", 1 + p % 5, 3.0) for p in range(50)], "product_id long, product_category_name_english string, total_units long, avg_rating double")
    affinity = K.content_affinity(inter, K.category_similarity(pop))
    stored = {}

    def counted(df, name="step"):
        out = written_table(df, name)
        stored.setdefault(name, []).append(out.count())
        return out

    def run():
        near = written_table(K.neighbours(inter, 4))
        return sorted(map(tuple, near.collect())), sorted(map(tuple, K.recommend(inter, near, affinity, pop, 5).collect()))

    at_once = run()
    monkeypatch.setattr(K, "written_table", counted)
    monkeypatch.setattr(K, "ROUND_PAIRS", 1_000)  # of 40 x 8 x 8 and 40 x 8 x 20 pairs
    assert run() == at_once
    assert len(stored["near-round"]) == 3 and len(stored["collab-round"]) == 7 and min(stored["near-round"]) > 0
