import numpy as np
from pyspark.sql import functions as F

from orbitcart.llm import raking


def docs_of(spark, rows):
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return frame.select("*", F.lit("x").alias("mass"), F.lit("y").alias("key"), F.lit("z").alias("topic"))


def plain_rake(table, targets, rounds=200):
    """numpy raking of a dense array to marginals along each axis."""
    w = table.astype(float).copy()
    for _ in range(rounds):
        for axis, goal in enumerate(targets):
            now = w.sum(axis=tuple(a for a in range(w.ndim) if a != axis))
            factor = np.where(now > 0, goal / np.where(now > 0, now, 1), 1)
            w *= factor.reshape([-1 if a == axis else 1 for a in range(w.ndim)])
    return w


def test_rake_equals_plain_raking_and_meets_marginals(spark):
    rnd = np.random.default_rng(1)
    table = rnd.integers(1, 50, (4, 3, 2))
    goals = [np.array([10, 20, 30, 40.0]), np.array([50, 25, 25.0]), np.array([60, 40.0])]
    cells = spark.createDataFrame([(f"s{i}", f"l{j}", k, int(table[i, j, k])) for i, j, k in np.ndindex(table.shape)],
                                  "source string, lang string, topic int, mass long")
    targets = {"source": spark.createDataFrame([(f"s{i}", float(g)) for i, g in enumerate(goals[0])], "source string, target double"),
               "lang": spark.createDataFrame([(f"l{i}", float(g)) for i, g in enumerate(goals[1])], "lang string, target double"),
               "topic": spark.createDataFrame([(i, float(g)) for i, g in enumerate(goals[2])], "topic int, target double")}
    raked = raking.rake(cells, targets, tolerance=1e-4).collect()
    expected = plain_rake(table, goals)
    got = {(r.source, r.lang, r.topic): r.weight for r in raked}
    for i, j, k in np.ndindex(table.shape):
        assert abs(got[f"s{i}", f"l{j}", k] - expected[i, j, k]) < 0.02
    for i, g in enumerate(goals[0]):
        assert abs(sum(v for (s, _, _), v in got.items() if s == f"s{i}") - g) < 0.02


def test_probabilities_spend_the_budget(spark):
    cells = spark.createDataFrame([(i, m, w) for i, (m, w) in enumerate([(100, 300.0), (500, 250.0), (400, 450.0), (0, 0.0)])],
                                  "cell int, mass long, weight double")
    for budget in (0.1, 0.6, 0.95, 1.0):
        rows = raking.probabilities(cells, budget).collect()
        assert abs(sum(r.mass * r.probability for r in rows) - budget * 1000) < 0.01
        open_cells = [r.probability / (r.weight / r.mass) for r in rows if r.mass and r.probability < 1]
        assert max(open_cells, default=1) - min(open_cells, default=1) < 1e-9


def test_mix_on_documents(spark):
    rnd = np.random.default_rng(2)
    rows = [(i, " ".join(f"word{x:04d}" for x in rnd.integers(0, 300, rnd.integers(5, 60))), ["en", "de", "fr"][i % 7 % 3],
             "src0" if i % 3 == 0 else f"src{i % 5}", 0) for i in range(900)]
    out = raking.mix(docs_of(spark, rows)).collect()
    tokens = {i: len(t.split()) for i, t, *_ in rows}
    assert {r.doc_id: r.n_tokens for r in out} == tokens
    whole, kept = sum(tokens.values()), sum(r.n_tokens for r in out if r.kept)
    assert abs(kept / whole - raking.BUDGET) < 0.06
    # expected tokens follow the raked weights: sources meet their tempered shares
    masses, raked = {}, {}
    for r in out:
        masses[r.source] = masses.get(r.source, 0) + r.n_tokens
        raked[r.source] = raked.get(r.source, 0) + r.n_tokens * r.weight
    powers = {s: m ** raking.EXPONENTS["source"] for s, m in masses.items()}
    for s in masses:
        assert abs(raked[s] - whole * powers[s] / sum(powers.values())) < 0.01 * whole


def test_unusual_rows(spark):
    rows = [(1, None, None, None, 0), (2, "", "en", None, 0), (2, "words here", None, "s", 0), (None, "longer words", "en", "s", 0), (3, "w " * 20_000, "en", "t", 1)]
    out = raking.mix(docs_of(spark, rows)).collect()
    assert len(out) == 5 and all(0 <= r.probability <= 1 and r.kept is not None for r in out)
    assert raking.mix(docs_of(spark, [])).count() == 0
