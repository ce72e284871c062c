"""Stream state that is folded level by level.

Each micro-batch writes its partials as a *run* of its own. When ``fanout`` runs of a level are
complete, ``fold`` joins them to one run of the next level, so n batches are read from at most
``(fanout - 1) * log(n)`` runs and a row is rewritten ``log(n)`` times in all. ``fold`` has to give
rows of the columns it takes, and the same in any order and grouping (sums, maxima, merged
intervals).

A run is a folder ``first-last`` named by the batches in it. It counts once its ``_SUCCESS`` file is
there, so a fold that a failure cut off is not seen and the runs below it are read instead. A
replayed batch overwrites its run and the folds that end with it. The runs a fold was made of stay
until the next fold of that level is written: a replay finds them, and so does a reader that
listed them before.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

FANOUT = 4

Step = Callable[[DataFrame], DataFrame]
Run = tuple[int, int]


def run_path(out_path: str, run: Run) -> str:
    return f"{out_path}/{run[0]:012d}-{run[1]:012d}"


def _hadoop(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def complete_runs(spark: SparkSession, out_path: str) -> set[Run]:
    """All runs that are wholly written."""
    fs, path = _hadoop(spark, out_path)
    done = fs.globStatus(_hadoop(spark, f"{out_path}/*-*/_SUCCESS")[1]) if fs.exists(path) else None
    names = [status.getPath().getParent().getName() for status in done or []]
    return {(int(a), int(b)) for a, b in (name.split("-") for name in names)}


def cover(runs: set[Run]) -> list[Run]:
    """The widest runs that hold every batch once."""
    chosen: list[Run] = []
    for run in sorted(runs, key=lambda r: (r[0], -r[1])):
        if not chosen or run[0] > chosen[-1][1]:
            chosen.append(run)
        elif run[1] > chosen[-1][1]:
            raise ValueError(f"runs {chosen[-1]} and {run} overlap: the folder was written with several fanouts")
    return chosen


def due_folds(batch_id: int, fanout: int) -> list[tuple[Run, Run]]:
    """(new run, run before it of the same level) of the folds that end with this batch."""
    out, width = [], fanout
    while (batch_id + 1) % width == 0:
        first = batch_id + 1 - width
        out.append(((first, batch_id), (first - width, first - 1)))
        width *= fanout
    return out


def folded_sink(out_path: str, step: Step, fold: Step, fanout: int = FANOUT) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: ``step`` of the batch as a run, then the folds that are due."""
    if fanout < 2:
        raise ValueError("fanout must be 2 or more")

    def sink(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        step(batch).write.mode("overwrite").parquet(run_path(out_path, (batch_id, batch_id)))
        for new, before in due_folds(batch_id, fanout):
            runs = complete_runs(spark, out_path)
            parts = cover({r for r in runs if new[0] <= r[0] and r[1] <= new[1] and r != new})
            fold(read_runs(spark, out_path, parts)).write.mode("overwrite").parquet(run_path(out_path, new))
            if before in runs:
                expire(spark, out_path, before, runs)
    return sink


def expire(spark: SparkSession, out_path: str, run: Run, runs: set[Run]) -> None:
    """Remove the runs that went into ``run``."""
    for old in runs:
        if run[0] <= old[0] and old[1] <= run[1] and old != run:
            fs, path = _hadoop(spark, run_path(out_path, old))
            fs.delete(path, True)


def read_runs(spark: SparkSession, out_path: str, runs: list[Run]) -> DataFrame:
    return spark.read.parquet(*(run_path(out_path, r) for r in runs))


def read_state(spark: SparkSession, out_path: str) -> DataFrame:
    """The partials of all batches, older ones folded. Raises where no batch was written yet."""
    return read_runs(spark, out_path, cover(complete_runs(spark, out_path)))


def fold_available_now(sdf: DataFrame, out_path: str, step: Step, fold: Step, fanout: int = FANOUT) -> str:
    """Drain the stream into folded state and wait for the end."""
    q = (sdf.writeStream.trigger(availableNow=True).option("checkpointLocation", out_path + "_ckpt")
            .foreachBatch(folded_sink(out_path, step, fold, fanout)).start())
    q.awaitTermination()
    return out_path
