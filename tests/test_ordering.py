"""Distributed order statistics equal single-task windows / NumPy on data with heavy ties."""
import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from orbitcart.functions.ordering import (exact_percentiles, packed, with_global_row_number,
                                          with_global_running_sum, with_rank_min)


def _frame(spark, n=500, seed=7):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame({"id": np.arange(n), "v": rng.integers(0, 20, n).astype(float)})  # many ties
    pdf.loc[: n // 3, "v"] = 5.0  # a third of all rows share one value
    return spark.createDataFrame(pdf).repartition(7), pdf


def test_row_number_matches_window(spark):
    df, _ = _frame(spark)
    got = with_global_row_number(df, [F.col("v").asc(), F.col("id").asc()], "rn", num_partitions=5)
    ref = df.withColumn("rn2", F.row_number().over(Window.orderBy("v", "id")))
    j = got.join(ref, "id")
    assert j.where(F.col("rn") != F.col("rn2")).count() == 0
    assert got.count() == 500


def test_running_sum_matches_window(spark):
    df, _ = _frame(spark)
    got = with_global_running_sum(df, [F.col("v").desc(), F.col("id").asc()], {"cum": F.col("v"),
                                                                            "rank": F.lit(1).cast("long")}, None, 6)
    w = Window.orderBy(F.desc("v"), "id").rowsBetween(Window.unboundedPreceding, 0)
    ref = df.withColumns({"cum2": F.sum("v").over(w), "rank2": F.row_number().over(Window.orderBy(F.desc("v"), "id"))})
    j = got.join(ref, "id")
    assert j.where((F.abs(F.col("cum") - F.col("cum2")) > 1e-9) | (F.col("rank") != F.col("rank2"))).count() == 0


def test_rank_min_matches_pandas(spark):
    df, pdf = _frame(spark)
    got = with_rank_min(df, "v", "r", descending=True).toPandas().sort_values("id")
    expected = pdf["v"].rank(ascending=False, method="min").astype(int).to_numpy()
    assert (got["r"].to_numpy() == expected).all()


def test_exact_percentiles_match_numpy(spark):
    df, pdf = _frame(spark)
    probs = [0.0, 0.2, 0.5, 0.8, 0.95, 1.0]
    got = spark.range(1).select(exact_percentiles(df, "v", probs).alias("q")).first()["q"]
    assert np.allclose(got, np.percentile(pdf["v"], [p * 100 for p in probs]))


def test_percentile_edge_case_small(spark):
    df = spark.createDataFrame([(float(x),) for x in [1, 2, 2, 3, 10, 10]], "v double")
    got = spark.range(1).select(exact_percentiles(df, "v", [0.5, 0.8, 0.95]).alias("q")).first()["q"]
    assert np.allclose(got, [2.5, 10.0, 10.0])


def test_row_number_unique_on_shuffled_input(spark):
    """Ranking the output of a fresh aggregation (non-deterministic row order inside shuffle
    partitions) must still give each row one unique, consecutive number."""
    rng = np.random.default_rng(11)
    pdf = pd.DataFrame({"k": rng.integers(0, 3000, 20000), "v": rng.integers(0, 50, 20000)})
    agg = spark.createDataFrame(pdf).repartition(9).groupBy("k").agg(F.sum("v").alias("s"))
    got = with_global_row_number(agg, [F.col("s").asc(), F.col("k").asc()], "rn", num_partitions=6)
    n = agg.count()
    stats = got.agg(F.countDistinct("rn").alias("d"), F.min("rn").alias("lo"), F.max("rn").alias("hi"),
                    F.count(F.lit(1)).alias("c")).first()
    assert (stats.d, stats.lo, stats.hi, stats.c) == (n, 1, n, n)


def test_purchase_timeline_with_hot_customer(spark):
    """A customer with a third of all orders: sequence numbers and gaps equal a per-customer
    window, without that customer's orders being sorted in one task."""
    from datetime import datetime, timedelta

    from orbitcart.operators.churn import purchase_timeline
    rng = np.random.default_rng(2)
    rows, base = [], datetime(2020, 1, 1)
    for oid in range(3000):
        cust = 0 if oid % 3 == 0 else int(rng.integers(1, 200))
        ts = base + timedelta(days=int(rng.integers(0, 900)))
        rows.append((cust, oid, ts, float(rng.integers(1, 100)), f"brand_{oid % 4}", "card" if oid % 5 else None))
    # an order's second line has another category and payment
    lines = rows + [(*r[:4], "brand_9", "boleto") for r in rows if r[1] % 7 == 0]
    m = spark.createDataFrame(lines, "customer_unique_id long, order_id long, order_purchase_timestamp timestamp, price double, "
                                     "product_category_name_english string, preferred_payment_type string").repartition(6)
    got = purchase_timeline(m).toPandas().sort_values(["customer_unique_id", "ts", "order_id"])
    pdf = pd.DataFrame(rows, columns=["customer_unique_id", "order_id", "ts", "price", "category", "payment"]) \
        .sort_values(["customer_unique_id", "ts", "order_id"])
    pdf["seq"] = pdf.groupby("customer_unique_id").cumcount() + 1
    pdf["gap"] = pdf.groupby("customer_unique_id")["ts"].diff().dt.total_seconds() / 86400
    assert (got["order_seq"].to_numpy() == pdf["seq"].to_numpy()).all()
    g1, g2 = got["days_since_prev"].to_numpy(), pdf["gap"].to_numpy()
    assert np.allclose(np.nan_to_num(g1.astype(float), nan=-1), np.nan_to_num(g2, nan=-1))
    second = (pdf["order_id"] % 7 == 0).to_numpy()
    assert list(got["categories"]) == [c + ", brand_9" if two else c for c, two in zip(pdf["category"], second)]
    first_of = [min(x for x in (p, "boleto" if two else None) if x) if p or two else None for p, two in zip(pdf["payment"], second)]
    assert [p if isinstance(p, str) else None for p in got["payment_method"]] == first_of
    assert list(got["items"]) == [2 if two else 1 for two in second]


def test_packed_partitions_follow_the_rows(spark):
    """All rows stay; partitions are as many as the rows fill, one a core at least; small frames keep theirs."""
    df = spark.range(1200).repartition(60).checkpoint()
    cores = spark.sparkContext.defaultParallelism
    for rows, expected in ((30, max(40, cores)), (1000, max(2, cores)), (1, 60)):
        got = packed(df, rows=rows, keeps=100)
        assert got.rdd.getNumPartitions() == expected
        assert sorted(r.id for r in got.collect()) == list(range(1200))
    assert packed(df, rows=30, keeps=1200).rdd.getNumPartitions() == 60


def test_fits_take_packed_rows(spark, monkeypatch):
    """The models of both pages are fitted on rows whose partitions follow their number."""
    from orbitcart.operators import churn, clv
    seen = {}
    for module in (churn, clv):
        def watch(frame, name=module.__name__):
            seen[name] = packed(frame, rows=100, keeps=10)
            return seen[name]
        monkeypatch.setattr(module, "packed", watch)
    n = 400
    cols = sorted({*churn.CHURN_FEATURES, *clv.CLV_FEATURES} - {"purchase_velocity", "spending_trend", "engagement_score"})
    rows = [(i, float(i % 2), *[float((i * (j + 3)) % 17) for j in range(len(cols))]) for i in range(n)]
    fs = spark.createDataFrame(rows, ["customer_unique_id", churn.LABEL, *cols]).repartition(32).checkpoint()
    churn.train_churn_models(fs, models=("logistic",))
    clv.train_clv_models(fs, models=("linear",))
    assert {k: v.rdd.getNumPartitions() for k, v in seen.items()} == {m.__name__: max(4, spark.sparkContext.defaultParallelism) for m in (churn, clv)}
