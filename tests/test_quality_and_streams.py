"""Quality counters on a literal frame (pandas semantics) and streaming jobs vs batch twins."""
import pandas as pd
from pyspark.sql import functions as F

from orbitcart.operators import drift, quality
from orbitcart.plans.pipeline import retail
from orbitcart.sources.testdata import read_table
from orbitcart.streaming import jobs as S

SF = "/root/testdata/sf0.001"


def test_table_stats_pandas_semantics(spark):
    rows = [(1, "a", 1.0), (1, "a", 1.0), (2, None, -3.0), (None, "b", 2.0), (None, "c", 2.0)]
    df = spark.createDataFrame(rows, "order_id long, order_status string, price double")
    st = quality.table_stats("orders", df).first()
    pdf = pd.DataFrame(rows, columns=["order_id", "order_status", "price"])
    assert st.total_rows == 5 and st.total_columns == 3
    assert st.duplicate_rows == int(pdf.duplicated().sum())
    assert st.missing_cells == int(pdf.isnull().sum().sum())
    assert st.duplicate_keys == int(pdf["order_id"].duplicated().sum())
    assert st.missing_status == 1


def test_quality_score_formula(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, "x")], "a long, b string")
    summ = quality.quality_summary({"t": df})
    row = quality.quality_score(summ).first()
    miss, dup = 2 * 100.0 / 6, 1 * 100.0 / 3
    assert abs(row.quality_score - round(max(100 - (2 * miss + 3 * dup), 0), 2)) < 1e-9


def _ingest(spark, copies=1):
    """Line items as unordered files, one a micro-batch, each line delivered ``copies`` times."""
    r = retail(spark, SF)
    li = read_table(spark, SF, "lineitem")
    path = S.scratch(spark, "test_lineitem")
    for _ in range(copies):
        li.repartition(4, F.xxhash64("l_orderkey", "l_linenumber")).write.mode("append").parquet(path)
    stream = S.file_stream(spark, path, li.schema, max_files=1)
    return S.ingest_stream(S.canonical_items_stream(stream), r._cut(r.cleaned["products"]), r._cut(r.cleaned["sellers"]))


def test_ingest_stream_equals_batch(spark):
    batch = retail(spark, SF).cleaned["order_items"]
    for copies in (1, 2):
        out = S.read_batches(spark, S.run_available_now(_ingest(spark, copies), S.scratch(spark, "test_t2")))
        assert out.count() == batch.count()
        assert out.where(F.col("category").isNull()).count() == 0
        assert out.select("batch_id").distinct().count() >= 4


def test_running_state_matches_features(spark):
    r = retail(spark, SF)
    step = S.customer_partials(r._cut(r.cleaned["orders"]), r._cut(r.cleaned["customers"]))
    out = S.customer_state_view(S.read_batches(spark, S.run_available_now(_ingest(spark), S.scratch(spark, "test_t3"), step)))
    fs = r.customer_features.select("customer_unique_id", F.col("total_spending").alias("fs_spend"), "total_orders",
                                    "total_items_purchased")
    j = out.join(fs, "customer_unique_id")
    assert j.count() == fs.count()
    assert j.where((F.abs(F.col("total_spending") - F.col("fs_spend")) > 1e-6) | (F.col("orders") != F.col("total_orders")) |
                   (F.col("items") != F.col("total_items_purchased"))).count() == 0


def test_drift_stream_tests_each_batch(spark):
    fs = retail(spark, SF).feature_store
    ref, cur = drift.split_by_time(fs)
    path = S.scratch(spark, "test_t6_src")
    cur.select(*drift.DRIFT_FEATURES).repartition(2, F.xxhash64(*drift.DRIFT_FEATURES)).write.parquet(path)
    stream = S.file_stream(spark, path, spark.read.parquet(path).schema, max_files=1)
    out = S.read_batches(spark, S.run_available_now(stream, S.scratch(spark, "test_t6"), S.drift_step(ref)))
    assert out.groupBy("batch_id").count().select("count").distinct().collect()[0][0] == len(drift.DRIFT_FEATURES)
    assert out.select("batch_id").distinct().count() == 2
