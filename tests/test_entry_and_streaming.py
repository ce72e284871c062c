"""Driver contract smoke test, oracle agreement on a few core queries, and stream = batch twin."""
import os
import sys

import duckdb
from pyspark.sql import functions as F

from orbitcart.operators import drift
from orbitcart.sources.testdata import TABLES, read_table
from orbitcart.streaming import jobs as S

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SF = "/root/testdata/sf0.001"


def _entry():
    sys.path.insert(0, ROOT)
    import __spark_entry__ as E
    return E


def test_entry_runs(spark):
    df = _entry().entry(spark)
    assert df.count() >= 0 and "rfm_segment_label" in df.columns


def test_every_query_has_name_and_oracle_subset():
    E = _entry()
    q, s = E.queries(), E.oracle_sql()
    assert set(s) <= set(q) and len(q) > 100


def _norm(v):
    return round(v, 6) if isinstance(v, float) else v


def test_core_queries_match_oracle(spark):
    E = _entry()
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    for name in ["G5_segment_summary", "M11_executive_kpis", "N14_revenue_bands", "L5_association_rules",
                 "J14_revenue_forecast_quarterly", "P1_ks_drift_by_time"]:
        sdf = E.queries()[name](spark, SF)
        cols = sorted(sdf.columns)
        got = sorted((tuple(_norm(r[c]) for c in cols) for r in sdf.collect()), key=repr)
        cur = con.execute(E.oracle_sql()[name])
        dcols = [d[0] for d in cur.description]
        exp = sorted((tuple(_norm(r[dcols.index(c)]) for c in cols) for r in cur.fetchall()), key=repr)
        assert got == exp, name


def _events(spark, files=5):
    """The events as several files in no order of time, one a micro-batch."""
    ev = read_table(spark, SF, "events")
    path = S.scratch(spark, "test_events")
    ev.repartition(files, F.xxhash64("event_id")).write.parquet(path)
    return ev, S.file_stream(spark, path, ev.schema, max_files=1)


def test_telemetry_stream_equals_batch(spark):
    ev, stream = _events(spark)
    out = S.run_available_now(stream, S.scratch(spark, "test_t1"), S.telemetry_partials)
    got = S.telemetry_view(S.read_batches(spark, out))
    exp = drift.windowed_telemetry(ev)
    cols = ["window_start", "event_type", "requests", "alerts"]
    assert S.read_batches(spark, out).select("batch_id").distinct().count() == 5
    assert sorted(got.select(cols).collect()) == sorted(exp.select(cols).collect())


def test_session_stream_keeps_every_event_and_equals_one_batch(spark):
    ev, stream = _events(spark)
    out = S.run_available_now(stream, S.scratch(spark, "test_t4"), S.session_partials)
    got = S.session_view(S.read_batches(spark, out))
    plain = ev.groupBy("user_id", F.session_window(F.col("ts").cast("timestamp"), "30 minutes").alias("s")).agg(
        F.count(F.lit(1)).alias("events")).select("user_id", "s.start", "s.end", "events")
    assert sorted(got.select("user_id", "session_start", "session_end", "events").collect()) == sorted(plain.collect())
    assert got.agg(F.sum("events")).first()[0] == ev.count()


def test_replayed_batch_doubles_nothing(spark):
    ev = read_table(spark, SF, "events")
    path = S.scratch(spark, "test_replay")
    sink = S.batch_sink(path, S.session_partials)
    halves = ev.where("event_id % 2 = 0"), ev.where("event_id % 2 = 1")
    for batch_id, half in enumerate(halves):
        sink(half, batch_id)
    sink(halves[1], 1)  # as after a failure
    assert S.read_batches(spark, path).agg(F.sum("events")).first()[0] == ev.count()
    assert sorted(S.session_view(S.read_batches(spark, path)).collect()) == sorted(S.sessions(ev).collect())
