"""The stored items: all rows of the master in few columns; features and recommendations read nothing else."""
import glob
import time
from datetime import datetime

import pytest

from orbitcart.operators import executive
from orbitcart.plans import jobs, pipeline
from orbitcart.plans.registry import all_queries


@pytest.fixture
def folder(spark, tmp_path):
    tables = {
        "nation": (["n_nationkey", "n_name"], [(1, "N1"), (2, "N2")]),
        "customer": (["c_custkey", "c_nationkey", "c_mktsegment"], [(1, 1, "A"), (2, 2, "B"), (3, 9, None), (3, 9, None)]),
        "supplier": (["s_suppkey", "s_nationkey"], [(1, 1)]),
        "part": (["p_partkey", "p_name", "p_brand", "p_size"], [(1, "x", "Brand#1", 3), (2, "y", "Brand#2", 4), (2, "y", "Brand#2", 4), (3, None, "Brand#1", None)]),
        "orders": (["o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate"],
                   [(k, 1 + k % 4, "O", datetime(1996, 1 + k, 2)) for k in range(1, 8)] + [(7, 4, "O", datetime(1996, 8, 2))]),
        "lineitem": (["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_tax", "l_shipdate", "l_returnflag", "l_linestatus"],
                     [(k, n, 1 + (k + n) % 4, 1 + n, 2.0, 10.0 * k + n, 0.1, datetime(1996, 1 + k, 9), "R" if n else "A", "F")
                      for k in range(1, 9) for n in (0, 1, 1)] + [(None, 1, 1, 1, 1.0, 5.0, 0.1, None, "A", "F")]),
    }
    for name, (columns, rows) in tables.items():
        spark.createDataFrame(rows, columns).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_items_are_the_masters_rows(spark, folder):
    r = pipeline.Retail(spark, folder)
    assert r.items.columns == list(pipeline.ITEM_COLUMNS)
    rows, whole = r.items.collect(), r.master.select(*pipeline.ITEM_COLUMNS).collect()
    assert len(rows) > 8 and sorted(map(str, rows)) == sorted(map(str, whole))


@pytest.mark.parametrize("name", ["K6_hybrid_recommendations", "K17_ranking_evaluation", "I10_retention_actions", "M4_distinct_by_state"])
def test_wide_master_is_not_built(spark, folder, name):
    """Before, each of these exchanged and held the master with all its columns."""
    assert all_queries()[name](spark, folder).collect()
    r = pipeline.retail(spark, folder)
    assert "items" in r.__dict__ and "master" not in r.__dict__
    assert r.items.inputFiles() and not r.items.is_cached  # read from files
    stored = [t for t in ("popularity", "interactions", "neighbours", "affinity") if t in jobs.jobs(spark, folder).__dict__]
    assert name != "K6_hybrid_recommendations" or len(stored) == 4


def test_executive_summary_reads_the_items(spark, folder):
    """Before, the wide master was persisted for it, next to the items that its customers come from."""
    got = all_queries()["M10_executive_summary"](spark, folder).collect()
    r = pipeline.retail(spark, folder)
    assert "items" in r.__dict__ and "master" not in r.__dict__
    whole = pipeline.Retail(spark, folder, persist=False)
    assert got == executive.executive_summary(whole.master, whole.feature_store, whole.order_facts).collect() and len(got) == 1


def test_items_leave_no_shuffle_files(spark, folder):
    """Before, they stayed on the disks until the driver's heap happened to be collected."""
    def files():
        dirs = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().localDirs()
        return {f for d in dirs for f in glob.glob(f"{d.getPath()}/*/shuffle_*")}

    r = pipeline.Retail(spark, folder)
    r.raw, before = r.raw, files()
    assert r.items.inputFiles()
    until = time.time() + 20
    while files() - before and time.time() < until:
        time.sleep(0.2)
    assert not files() - before
