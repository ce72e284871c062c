"""I3 — interpolating oversampler (SMOTE): new minority points on lines between near neighbours.

Near neighbours come from hashing. Each of several tables hashes a point by random projections
that are cut into steps, and interleaves the bits of these step numbers into one key, so that points
near in space tend to be near in the order of the keys. The points are numbered in that
order (a distributed row number) and fall into overlapping blocks of ``BLOCK`` numbers, inside
which exact distances are compared. Blocks are equally large whatever the data: equal points or
a crowd are dealt over as many blocks as they fill, and no bucket is cut. Tables are added until the
neighbours of a sample of points, compared with all points, are found with the wanted recall.

The draw is repeatable: which neighbour and which place on the line follow from hashes of the
point's id and the number of the new point.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orbitcart.functions.ordering import with_global_row_number

K, MIN_RECALL = 5, 0.9
#: Consecutive points of a table that are compared with one another; projections in a key; bits of each.
BLOCK, PROJECTIONS, BITS = 256, 8, 7
#: Points whose true neighbours measure the recall, and the most tables tried.
RECALL_POINTS, MAX_TABLES = 200, 32


def _keys(points: DataFrame, table: int, dims: int, seed: int) -> Column:
    """The interleaved bits of the cut projections of ``x`` as a long."""
    rng = np.random.default_rng([seed, table])
    lines = np.linalg.qr(rng.normal(size=(max(dims, PROJECTIONS), dims)))[0] if dims > 1 else np.ones((1, 1))
    lines = [lines[i % len(lines)] for i in range(min(PROJECTIONS, len(lines)))]
    places = [F.aggregate(F.zip_with("x", F.array(*[F.lit(float(v)) for v in line]), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
              for line in lines]
    spread = points.select(*[F.struct(F.avg(p).alias("m"), F.stddev_pop(p).alias("s")).alias(f"p{i}") for i, p in enumerate(places)]).first()
    key = F.lit(0).cast("long")
    steps = []
    for i, (place, shift) in enumerate(zip(places, rng.uniform(0, 1, len(places)))):
        mean, deviation = spread[f"p{i}"]["m"] or 0.0, spread[f"p{i}"]["s"] or 1.0
        step = F.floor((place - mean) / deviation * 2 ** (BITS - 3) + 2 ** (BITS - 1) + float(shift)).cast("long")
        steps.append(F.least(F.greatest(step, F.lit(0)), F.lit(2 ** BITS - 1)))
    for bit in reversed(range(BITS)):
        for step in steps:
            key = F.shiftleft(key, 1).bitwiseOR(F.shiftright(step, bit).bitwiseAND(F.lit(1)))
    return key


def _nearest(block: pd.DataFrame, k: int) -> pd.DataFrame:
    """(row, near, distance) of the k nearest other points of each point of one block."""
    x, rows = np.stack(block["x"].to_numpy()), block["row"].to_numpy()
    order = np.argsort(rows)
    x, rows = x[order], rows[order]
    squares = (x * x).sum(1)
    gap = np.maximum(squares[:, None] + squares[None, :] - 2 * x @ x.T, 0.0)
    np.fill_diagonal(gap, np.inf)
    best = np.argsort(gap, axis=1, kind="stable")[:, :k]
    own = np.arange(len(rows))[:, None]
    keep = np.isfinite(gap[own, best])
    return pd.DataFrame({"row": np.broadcast_to(rows[:, None], best.shape)[keep], "near": rows[best][keep],
                         "distance": np.sqrt(((x[own] - x[best]) ** 2).sum(-1))[keep]})


def _blocks(points: DataFrame, table: int, dims: int, seed: int, k: int, block: int) -> DataFrame:
    """Candidates of one table: each point meets those of two blocks that overlap by a half."""
    keyed = points.withColumn("key", _keys(points, table, dims, seed))
    placed = with_global_row_number(keyed, [F.col("key"), F.col("row")], "place")
    both = F.explode(F.array(F.floor((F.col("place") - 1) / block) * 2, F.floor((F.col("place") - 1 + block // 2) / block) * 2 + 1))
    return placed.select("row", "x", both.alias("block")).groupBy("block").applyInPandas(
        lambda rows: _nearest(rows, k), "row long, near long, distance double")


def _best(candidates: DataFrame, k: int) -> DataFrame:
    """row, nearest: the k nearest distinct candidates of each row in order (k rows a table at most)."""
    once = candidates.groupBy("row", "near").agg(F.min("distance").alias("distance"))
    listed = F.slice(F.array_sort(F.collect_list(F.struct("distance", "near"))), 1, k)
    return once.groupBy("row").agg(listed.alias("nearest"))


def recall(found: DataFrame, points: DataFrame, k: int, asked: int = RECALL_POINTS) -> float:
    """The share of true k nearest neighbours found, for ``asked`` points by hash against all points.

    Only the asked points pass the driver; a batch of points leaves its k best for each of them.
    """
    some = points.orderBy(F.xxhash64("row"), "row").limit(asked).select("row", "x").collect()
    if not some:
        return 1.0
    rows, y = np.array([r["row"] for r in some]), np.array([r["x"] for r in some], float)

    def nearest(batches):
        for batch in batches:
            x, ids = np.stack(batch["x"].to_numpy()), batch["row"].to_numpy()
            for row, point in zip(rows, y):
                gap = np.sqrt(((x - point) ** 2).sum(1))[ids != row]
                yield pd.DataFrame({"asked": row, "gap": np.sort(gap)[:k]})

    best = points.select("row", "x").mapInPandas(nearest, "asked long, gap double")
    w = Window.partitionBy("asked").orderBy("gap")
    # the k-th least distance: neighbours at equal distance are as good as one another
    true = best.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).groupBy("asked").agg(
        F.max("gap").alias("last"), F.count(F.lit(1)).alias("n"))
    both = true.join(found, true.asked == found.row, "left")
    hits = F.coalesce(F.size(F.filter("nearest", lambda n: n["distance"] <= F.col("last") * (1 + 1e-9))), F.lit(0))
    got = both.agg(F.sum(F.least(hits, F.col("n"))).alias("hits"), F.sum("n").alias("all")).first()
    return got["hits"] / got["all"] if got["all"] else 1.0


def neighbours(points: DataFrame, dims: int, *, written: Callable[[DataFrame], DataFrame], k: int = K, min_recall: float = MIN_RECALL,
               block: int = BLOCK, seed: int = 42, max_tables: int = MAX_TABLES) -> tuple[DataFrame, float]:
    """((row, nearest: array of (distance, near)), measured recall) for points (row, x)."""
    candidates, found, share = None, None, 0.0
    for table in range(max_tables):
        more = _blocks(points, table, dims, seed, k, block)
        candidates = written(more if candidates is None else candidates.unionByName(more))
        found = written(_best(candidates, k))
        share = recall(found, points, k)
        if share >= min_recall:
            return found, share
        # only the best so far go on to the next table
        candidates = found.select("row", F.explode("nearest").alias("n")).select("row", "n.near", "n.distance")
    raise ValueError(f"recall {share:.3f} after {max_tables} tables; take larger blocks or a lower min_recall")


def oversample(rows: DataFrame, *, label: str, id_col: str, vector: str, written: Callable[[DataFrame], DataFrame], k: int = K,
               seed: int = 42, min_recall: float = MIN_RECALL, block: int = BLOCK) -> DataFrame:
    """(id, label, x, near_id, gap): all rows, and new rows of the smaller of two classes until both are
    equally large. A new row's x lies at ``gap`` (0 to 1) on the line from its point's x to that of
    ``near_id``; original rows have null there.

    A class of 5 rows or fewer stays as it is (as do equal classes and one class alone), rows
    with a null or incomplete vector or label take no part and come back unchanged; ids may repeat.
    """
    given = rows.select(F.col(id_col).alias("id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("x"))
    none = [F.lit(None).cast(given.schema["id"].dataType).alias("near_id"), F.lit(None).cast("double").alias("gap")]
    whole = F.coalesce(F.forall("x", lambda v: F.abs(v) < float("inf")), F.lit(False)) & F.col("label").isNotNull()
    usable = given.where(whole)
    sizes = sorted((r["n"], r["label"]) for r in usable.groupBy("label").agg(F.count(F.lit(1)).alias("n")).limit(3).collect())
    if len(sizes) != 2 or sizes[0][0] <= 5 or sizes[0][0] == sizes[1][0]:
        return given.select("*", *none)
    (few, value), (many, _) = sizes
    points = written(usable.where(F.col("label") == value).withColumn("row", F.monotonically_increasing_id()))
    dims = points.agg(F.max(F.size("x"))).first()[0]
    found, _ = neighbours(points.select("row", "x"), dims, written=written, k=min(k, few - 1), min_recall=min_recall, block=block, seed=seed)
    dealt = with_global_row_number(points, [F.xxhash64(F.lit(seed), "row"), F.col("row")], "place")
    more = F.lit((many - few) // few) + (F.col("place") <= (many - few) % few).cast("int")
    new = dealt.join(found, "row").withColumn("copies", more).where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    pick = F.pmod(F.xxhash64(F.lit(seed), "row", "copy"), F.size("nearest")).cast("int")
    gap = F.pmod(F.xxhash64(F.lit(seed + 1), "row", "copy"), F.lit(1 << 53)) / float(1 << 53)
    new = new.select("id", "label", "x", F.get("nearest", pick)["near"].alias("near"), gap.alias("gap"))
    ends = points.select(F.col("row").alias("near"), F.col("id").alias("near_id"), F.col("x").alias("y"))
    new = new.join(ends, "near").select("id", "label", F.zip_with("x", "y", lambda a, b: a + F.col("gap") * (b - a)).alias("x"), "near_id", "gap")
    return given.select("*", *none).unionByName(new)
