"""The clustered warehouse, stored distinct counts and CSV intake."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from orbitcart.operators import distinct as D
from orbitcart.operators import executive as X
from orbitcart.session import written_table
from orbitcart.sources import intake, warehouse

SCHEMA = ("order_id long, customer_unique_id long, order_purchase_timestamp timestamp, customer_state string, seller_state string, "
          "product_category_name_english string, preferred_payment_type string, price double, customer_city string")


def _rows(n, seed=1):
    draw = random.Random(seed)
    start = dt.datetime(2020, 1, 1)
    return [(i // 2, draw.randrange(n // 4 + 1), None if i % 97 == 0 else start + dt.timedelta(hours=draw.randrange(20_000)),
             None if i % 89 == 0 else draw.choice(["SP", "SP", "SP", "RJ", "MG", "BA"]), draw.choice(["SP", "AM"]),
             None if i % 83 == 0 else draw.choice(["toys", "books", "music", "garden"]), draw.choice(["card", "slip"]),
             float(draw.randrange(1, 500)), "x") for i in range(n)]


@pytest.fixture(scope="module")
def master(spark):
    return spark.createDataFrame(_rows(4000), SCHEMA)


@pytest.fixture(scope="module")
def path(master, tmp_path_factory):
    return warehouse.write_clustered(master, str(tmp_path_factory.mktemp("warehouse")), bits=2)


@pytest.mark.parametrize("filters", [
    {}, {"start": "2020-05-01", "end": "2020-06-01"}, {"categories": ["toys"]}, {"states": ["MG", "am"]}, {"payments": ["CARD"]},
    {"categories": ["books"], "start": "2021-01-01", "price_range": (10.0, 50.0)}, {"categories": ["none"]}])
def test_slice_equals_filtered_master(spark, master, path, filters):
    own = warehouse.read_slice(spark, path, **filters)
    expected = X.filter_master(master, **filters)
    assert own.columns == master.columns
    assert sorted(map(repr, own.collect())) == sorted(map(repr, expected.collect()))


def test_slice_prunes_blocks_and_pushes_filters(spark, path):
    zones = spark.read.parquet(f"{path}/zones")
    live = warehouse.live_blocks(zones, start="2020-05-01", end="2020-05-20", categories=["toys"])
    assert live.count() < zones.count() / 2
    plan = warehouse.read_slice(spark, path, start="2020-05-01", end="2020-05-20", categories=["toys"])._jdf.queryExecution().toString()
    assert "dynamicpruning" in plan
    pushed = plan[plan.index("PushedFilters"):]
    assert "order_purchase_timestamp" in pushed and "product_category_name_english" in pushed


def test_hot_block_is_dealt_to_several_tasks(spark, tmp_path):
    rows = [(i, i, dt.datetime(2020, 1, 1), "SP", "SP", "toys", "card", 1.0, "x") for i in range(4000)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # the rows are few
    try:
        path = warehouse.write_clustered(spark.createDataFrame(rows, SCHEMA), str(tmp_path), bits=1)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    files = spark.read.parquet(f"{path}/rows").groupBy("block", F.col("_metadata.file_path")).count().collect()
    assert len({f["block"] for f in files}) == 1 and len(files) > 1
    assert max(f["count"] for f in files) < 3000


def test_empty_warehouse(spark, tmp_path):
    path = warehouse.write_clustered(spark.createDataFrame([], SCHEMA), str(tmp_path))
    assert warehouse.read_slice(spark, path, categories=["toys"]).count() == 0


def test_block_bits_follow_the_rows():
    assert [warehouse.block_bits(n) for n in (0, 10**6, 10**8, 10**9, 10**12)] == [1, 1, 2, 3, 4]


@pytest.mark.parametrize("by, where", [((), None), (("state",), None), (("month", "category"), None), (("category",), "state IN ('SP', 'BA')"),
                                       ((), "month >= DATE '2021-01-01' AND category = 'toys'")])
def test_distinct_counts_of_slices(spark, master, by, where):
    with_nulls = master.withColumn("customer_unique_id", F.when(F.col("customer_unique_id") % 11 != 0, F.col("customer_unique_id")))
    state = D.distinct_state(with_nulls, written_table)
    cells = D.cells(with_nulls)
    expected = (cells.filter(where) if where else cells).groupBy(*by).agg(F.countDistinct("customer_unique_id"), F.countDistinct("order_id"))
    own = D.distinct_counts(state, by, F.expr(where) if where else None)
    assert own.columns == [*by, "customers", "orders"]
    assert sorted(map(repr, map(tuple, own.collect()))) == sorted(map(repr, map(tuple, expected.collect())))


def test_distinct_counts_over_several_bitmaps(spark):
    rows = spark.range(100_000).select(F.col("id").alias("order_id"), (F.col("id") % 70_001).alias("customer_unique_id"),
                                       F.lit("2020-01-01").cast("timestamp").alias("order_purchase_timestamp"),
                                       (F.col("id") % 3).cast("string").alias("customer_state"), F.lit("toys").alias("product_category_name_english"))
    state = D.distinct_state(rows, written_table)
    assert state.filter("entity = 'customer'").agg(F.max("bucket")).first()[0] >= 3
    assert tuple(D.distinct_counts(state).first()) == (70_001, 100_000)


def test_distinct_counts_of_nothing(spark):
    state = D.distinct_state(spark.createDataFrame([], SCHEMA), written_table)
    assert tuple(D.distinct_counts(state).first()) == (0, 0)


def test_intake_sorts_rows_out(spark, tmp_path):
    head = "name,id,price,seen"
    (tmp_path / "a.csv").write_bytes("\n".join([head, "Ana,1,2.5,2020-01-02 03:04:05", "São,2,,", '"x, ""y""",3,1,', "", "bad,4,abc,2020-01-01",
                                               "few,5", "late,six,1.0,never", "much,7,1,,9"]).encode())
    (tmp_path / "b.csv").write_bytes((head + "\r\nJosé,8,3.0,2021-01-01 00:00:00\r\n,,4.0,\r\n").encode("iso-8859-1"))
    schema = spark.createDataFrame([], "id int, name string, price double, seen timestamp").schema
    good, bad = intake.take_in(spark, str(tmp_path), schema, required=["id"])
    got = {r["id"]: (r["name"], r["price"], r["seen"]) for r in good.collect()}
    assert got == {1: ("Ana", 2.5, dt.datetime(2020, 1, 2, 3, 4, 5)), 2: ("São", None, None), 3: ('x, "y"', 1.0, None),
                   8: ("José", 3.0, dt.datetime(2021, 1, 1))}
    found = {(r["line"], r["reason"], tuple(r["bad_columns"] or ())) for r in bad.collect()}
    assert found == {("bad,4,abc,2020-01-01", "values", ("price",)), ("few,5", "columns", ()), ("late,six,1.0,never", "values", ("id", "seen")),
                     ("much,7,1,,9", "columns", ()), (",,4.0,", "required", ("id",))}
    assert {r["file"].rsplit("/", 1)[1] for r in bad.collect()} == {"a.csv", "b.csv"}


def test_intake_reads_each_line_once(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id\n1\n2\n")
    schema = spark.createDataFrame([], "id int").schema
    plan = intake.parsed(spark, str(tmp_path), schema)._jdf.queryExecution().toString()
    assert plan.split("== Physical Plan ==")[1].count("FileScan text") == 1


def test_intake_without_rows_or_columns(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,name\n")
    schema = spark.createDataFrame([], "id int").schema
    good, bad = intake.take_in(spark, str(tmp_path), schema)
    assert good.count() == bad.count() == 0
    with pytest.raises(ValueError, match="lacks"):
        intake.take_in(spark, str(tmp_path), spark.createDataFrame([], "id int, price double").schema)
