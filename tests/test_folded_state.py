"""Folded stream state: the cover of runs, replays, cut-off folds, and folded = plain partials."""
import os

import pytest
from pyspark.sql import functions as F

from orbitcart.sources.testdata import read_table
from orbitcart.streaming import folded as Z
from orbitcart.streaming import jobs as S

SF = "/root/testdata/sf0.001"


def _sum(df):
    return df.groupBy("k").agg(F.sum("v").alias("v"))


def _batch(spark, n):
    return spark.createDataFrame([(n % 3, n + 1), (7, 1)], "k long, v long")


def test_cover_takes_widest_runs_once():
    runs = {(0, 15), (0, 3), (12, 15), (16, 19), (16, 16), (19, 19), (20, 20)}
    assert Z.cover(runs) == [(0, 15), (16, 19), (20, 20)]
    assert Z.cover(set()) == []
    with pytest.raises(ValueError):
        Z.cover({(0, 3), (2, 5)})


def test_due_folds():
    assert Z.due_folds(2, 4) == []
    assert Z.due_folds(7, 4) == [((4, 7), (0, 3))]
    assert [new for new, _ in Z.due_folds(15, 4)] == [(12, 15), (0, 15)]


def test_many_batches_are_read_from_few_runs_and_replays_double_nothing(spark):
    path = S.scratch(spark, "test_fold")
    sink = Z.folded_sink(path, lambda b: b, _sum, fanout=2)
    for n in range(19):
        sink(_batch(spark, n), n)
        if n in (7, 10, 15):  # as after a failure: a batch that ends folds, and one that ends none
            sink(_batch(spark, n), n)
    runs = Z.cover(Z.complete_runs(spark, path))
    assert runs == [(0, 15), (16, 17), (18, 18)]
    assert len(Z.complete_runs(spark, path)) <= 16  # the runs of older folds are gone
    got = {r.k: r.v for r in _sum(Z.read_state(spark, path)).collect()}
    assert got == {k: sum(n + 1 for n in range(19) if n % 3 == k) for k in range(3)} | {7: 19}


def test_cut_off_fold_is_not_read(spark):
    path = S.scratch(spark, "test_fold_cut")
    sink = Z.folded_sink(path, lambda b: b, _sum, fanout=4)
    for n in range(4):
        sink(_batch(spark, n), n)
    os.remove(Z.run_path(path, (0, 3)).removeprefix("file:") + "/_SUCCESS")
    assert Z.cover(Z.complete_runs(spark, path)) == [(n, n) for n in range(4)]
    assert _sum(Z.read_state(spark, path)).filter("k = 7").first().v == 4
    sink(_batch(spark, 3), 3)
    assert Z.cover(Z.complete_runs(spark, path)) == [(0, 3)]
    assert _sum(Z.read_state(spark, path)).filter("k = 7").first().v == 4


def test_folded_sessions_and_telemetry_equal_one_batch(spark):
    ev = read_table(spark, SF, "events")
    src = S.scratch(spark, "test_fold_events")
    ev.repartition(5, F.xxhash64("event_id")).write.parquet(src)
    for step, fold, view in ((S.session_partials, S.fold_sessions, S.session_view),
                             (S.telemetry_partials, S.fold_telemetry, S.telemetry_view)):
        stream = S.file_stream(spark, src, ev.schema, max_files=1)
        out = Z.fold_available_now(stream, S.scratch(spark, "test_fold_out"), step, fold, fanout=2)
        assert Z.cover(Z.complete_runs(spark, out)) == [(0, 3), (4, 4)]
        digits = {c: F.round(c, 6) for c in ("avg_latency_ms", "avg_throughput", "total_value")}
        got, exp = view(Z.read_state(spark, out)), view(step(ev))
        own = {c: e for c, e in digits.items() if c in got.columns}
        assert sorted(got.withColumns(own).collect()) == sorted(exp.withColumns(own).collect())


def test_sessions_over_midnight_and_of_a_busy_user(spark):
    """A user with an event every 10 minutes for four days is one session; others end at the gap."""
    busy = spark.range(4 * 144).select(F.lit(1).cast("long").alias("user_id"), (F.lit(1700000000) + F.col("id") * 600).alias("t"))
    late = spark.createDataFrame([(2, 1700006399), (2, 1700006399 + 1799), (2, 1700006399 + 3599)], "user_id long, t long")
    ev = busy.union(late).select("user_id", F.timestamp_seconds("t").alias("ts"), F.lit(1.0).alias("value"))
    rows = {(r.user_id, r.events) for r in S.sessions(ev).collect()}
    assert rows == {(1, 576), (2, 2), (2, 1)}
