"""Order statistics by brackets against numpy: ties, hot values, empty columns, small brackets."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from orbitcart.functions import ranks as R
from orbitcart.operators import labels

rng = np.random.default_rng(11)
CASES = {
    "spread": rng.normal(0, 1e6, 3000),
    "hot": np.where(rng.random(3000) < 0.35, 7.0, rng.integers(0, 50, 3000)),
    "two": rng.integers(0, 2, 3000).astype(float),
    "equal": np.full(500, 3.25),
    "heavy ends": np.concatenate([np.full(1400, -1.0), rng.random(200), np.full(1400, 9.0)]),
    "one": np.array([5.0]),
}


def _frame(spark, values):
    rows = [(i, float(v)) for i, v in enumerate(values)] + [(-1, None)]
    return spark.createDataFrame(rows, "id long, v double").repartition(3)


@pytest.mark.parametrize("name", CASES)
def test_ranks_and_percentiles(spark, name):
    x = CASES[name]
    df = _frame(spark, x).cache()
    s, n = np.sort(x), len(x)
    wanted = sorted({1, (n + 1) // 3 or 1, (n + 1) // 2, n})
    got = R.values_at_ranks(df, "v", wanted, small=20, accuracy=50)
    assert got == [(s[k - 1], int((x < s[k - 1]).sum())) for k in wanted]
    probs = [0.0, 0.2, 0.5, 0.8, 0.95, 1.0]
    for bounds in ({"small": 20, "accuracy": 50}, {}):
        q = spark.range(1).select(R.exact_percentiles(df, "v", probs, **bounds).alias("q")).first().q
        assert np.allclose(q, np.quantile(x, probs), rtol=1e-12)
    ids = np.arange(n)
    order = np.lexsort((ids, x))
    rows = R.rows_at_ranks(df.filter("v IS NOT NULL"), "v", "id", wanted, small=20, accuracy=50)
    assert rows == [(x[order[k - 1]], order[k - 1]) for k in wanted]
    df.unpersist()


def test_no_values(spark):
    df = _frame(spark, [])
    assert R.values_at_ranks(df, "v", [0, 1, 2]) == [(None, 0)] * 3
    assert spark.range(1).select(R.exact_percentiles(df, "v", [0.5]).alias("q")).first().q == [None]


def test_quintiles_of_ranks_equal_numpy(spark):
    """F3 with a value that a third of the rows hold, and for very few rows."""
    for x in (CASES["hot"], CASES["spread"][:7], np.array([2.0]), np.array([2.0, 1.0])):
        df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "customer_unique_id long, v double")
        got = {r[0]: r.score for r in labels.rank_quintile(df, "v", "score").collect()}
        place = np.empty(len(x), dtype=int)
        place[np.lexsort((np.arange(len(x)), x))] = np.arange(len(x))
        exp = {i: max(1, int(np.ceil(5.0 * p / (len(x) - 1)))) if len(x) > 1 else 1 for i, p in enumerate(place)}
        assert got == exp


def test_quintiles_with_text_ids(spark):
    df = spark.range(50).select(F.concat(F.lit("c"), F.lpad(F.col("id").cast("string"), 3, "0")).alias("customer_unique_id"),
                                (F.col("id") % 3).cast("double").alias("v"))
    sizes = labels.rank_quintile(df, "v", "score").groupBy("score").count().collect()
    assert sorted(r["score"] for r in sizes) == [1, 2, 3, 4, 5] and all(9 <= r["count"] <= 11 for r in sizes)
