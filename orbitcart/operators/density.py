"""H8 — density clustering (DBSCAN) on a grid, for any number of points and any crowding.

A point is core if at least ``min_points`` points, itself included, lie within ``eps``. Core points
within ``eps`` of one another form a cluster, other points within ``eps`` of a core point are its
border, the rest is noise (label -1). A cluster's label is the smallest id of its core points; a border point
near several clusters takes the smallest label.

Points live in cells whose diagonal is ``eps``, so

* a cell with ``min_points`` points or more holds core points only, whatever else is near;
* only points of emptier cells (fewer than ``min_points`` each) are compared with the cells
  around them, so a point meets a bounded number of others (``compare``). The points of a crowded
  cell are dealt over parts of ``PART`` points, and pairs are counted where they are found;
  A crowded cell's rows meet its one row of counts in joins that adaptive execution splits;
* all core points of a cell are one cluster, so clusters are components of cells. Whether two
  cells touch is decided from boxes around their core points: boxes wholly within ``eps`` touch,
  boxes wholly beyond do not, pairs of few points are compared, and the others are cut into boxes of half the
  side and asked again (``touching``). Cells already joined are not asked again.

Points with null, NaN or infinite coordinates take no part and get a null label; equal points and repeated ids are points of their own.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbitcart.functions.graph import components

NOISE = -1
EPS, MIN_POINTS = 0.8, 5
#: Points of a crowded cell that one part of it holds.
PART = 4096
#: Pairs of points that are compared for one pair of boxes; with more the boxes are halved.
PAIRS = 4096


def _squared(a: Sequence[Column], b: Sequence[Column]) -> Column:
    return functools.reduce(lambda x, y: x + y, [(p - q) * (p - q) for p, q in zip(a, b)])


def _cells(axes: Sequence[str], side: float) -> Column:
    return F.array(*[F.floor(F.col(c) / side).cast("long") for c in axes])


def _offsets(dims: int, side: float, eps: float) -> list[tuple[int, ...]]:
    """Steps to the cells that may hold a point within ``eps``, the cell itself left out."""
    reach = math.ceil(eps / side)
    gap = lambda step: max(0, abs(step) - 1) * side
    return [o for o in itertools.product(range(-reach, reach + 1), repeat=dims)
            if any(o) and sum(gap(s) ** 2 for s in o) <= eps * eps]


def _around(cell: Column, offsets: Sequence[tuple[int, ...]]) -> Column:
    steps = F.array(*[F.array(*[F.lit(s).cast("long") for s in o]) for o in offsets])  # folds to a constant
    return F.explode(F.transform(steps, lambda o: F.zip_with(cell, o, lambda x, step: x + step)))


def compare(asking: DataFrame, points: DataFrame, counts: DataFrame, axes: Sequence[str], offsets: Sequence[tuple[int, ...]],
            eps: float, found: Column) -> DataFrame:
    """row, found: an aggregate over the points within ``eps`` in the cells around each asking point.

    ``points`` (cell, part, axes, ...) are dealt over the parts of their cell, and an asking
    point goes to each part of each cell around it; ``counts`` holds (cell, parts).
    """
    sent = asking.select("row", *[F.col(c).alias(f"q_{c}") for c in axes], _around(F.col("cell"), offsets).alias("cell"))
    sent = sent.join(counts, "cell").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")
    near = _squared([F.col(f"q_{c}") for c in axes], [F.col(c) for c in axes]) <= eps * eps
    return sent.join(points, ["cell", "part"]).where(near).groupBy("row").agg(found.alias("found"))


def _boxes(core: DataFrame, axes: Sequence[str], side: float) -> DataFrame:
    """(cell, box, n, lows, highs): the core points' boxes of the given side inside each cell."""
    return core.groupBy("cell", _cells(axes, side).alias("box")).agg(
        F.count(F.lit(1)).alias("n"), F.array(*[F.min(c) for c in axes]).alias("lows"), F.array(*[F.max(c) for c in axes]).alias("highs"))


def _box_distances(dims: int) -> tuple[Column, Column]:
    """Squared least and greatest distance of the boxes a_lows..a_highs and b_lows..b_highs."""
    def gap(i: int) -> Column:
        return F.greatest(F.col("a_lows")[i] - F.col("b_highs")[i], F.col("b_lows")[i] - F.col("a_highs")[i], F.lit(0.0))

    def span(i: int) -> Column:
        return F.greatest(F.col("a_highs")[i] - F.col("b_lows")[i], F.col("b_highs")[i] - F.col("a_lows")[i])

    add = functools.partial(functools.reduce, lambda x, y: x + y)
    return add([gap(i) * gap(i) for i in range(dims)]), add([span(i) * span(i) for i in range(dims)])


def touching(core: DataFrame, axes: Sequence[str], side: float, eps: float, offsets: Sequence[tuple[int, ...]],
             written: Callable[[DataFrame], DataFrame], pairs: int = PAIRS) -> DataFrame:
    """(a, b): pairs of cells with core points within ``eps``; of cells that others join already not all pairs."""
    dims, limit = len(axes), eps * eps
    low, high = _box_distances(dims)
    half = [o for o in offsets if o > (0,) * dims]  # each pair of cells once
    cells = core.select("cell").distinct()
    asked = written(cells.select(F.col("cell").alias("a"), _around(F.col("cell"), half).alias("b")).join(
        cells.withColumnRenamed("cell", "b"), "b").select("a", "b"))
    links, finer = [], side
    ask = asked.withColumns({"box_a": F.col("a"), "box_b": F.col("b")})
    while True:
        boxes = written(_boxes(core, axes, finer))
        sides = [boxes.select(F.col("cell").alias(x), F.col("box").alias(f"box_{x}"), F.col("n").alias(f"n_{x}"),
                              F.col("lows").alias(f"{x}_lows"), F.col("highs").alias(f"{x}_highs")) for x in "ab"]
        judged = written(ask.join(sides[0], ["a", "box_a"]).join(sides[1], ["b", "box_b"]).where(low <= limit)
                         .withColumn("sure", high <= limit).withColumn("few", F.col("n_a") * F.col("n_b") <= pairs))
        few = judged.where("few AND NOT sure")
        ends = [core.select(F.col("cell").alias(x), _cells(axes, finer).alias(f"box_{x}"), *[F.col(c).alias(f"{x}_{c}") for c in axes]) for x in "ab"]
        close = _squared([F.col(f"a_{c}") for c in axes], [F.col(f"b_{c}") for c in axes]) <= limit
        met = few.select("a", "b", "box_a", "box_b").join(ends[0], ["a", "box_a"]).join(ends[1], ["b", "box_b"]).where(close)
        links.append(written(judged.where("sure").select("a", "b").unionByName(met.select("a", "b")).distinct()))
        joined = functools.reduce(DataFrame.unionByName, links)
        rest = judged.where("NOT few AND NOT sure").select("a", "b", "box_a", "box_b")
        if rest.isEmpty():
            return joined
        named = written(components(joined, written))
        for x in "ab":
            rest = rest.join(named.select(F.col("id").alias(x), F.col("component").alias(f"in_{x}")), x, "left")
        rest = rest.where("in_a IS NULL OR in_b IS NULL OR in_a <> in_b").select("a", "b", "box_a", "box_b")
        finer /= 2
        corners = list(itertools.product((0, 1), repeat=dims))

        def halves(box: str) -> Column:
            return _around(F.transform(box, lambda x: 2 * x), corners)

        within = [boxes_of.select(x, f"box_{x}") for x, boxes_of in zip("ab", [
            _boxes(core, axes, finer).select(F.col("cell").alias(y), F.col("box").alias(f"box_{y}")) for y in "ab"])]
        ask = rest.withColumn("box_a", halves("box_a")).join(within[0], ["a", "box_a"])
        ask = written(ask.withColumn("box_b", halves("box_b")).join(within[1], ["b", "box_b"]).select("a", "b", "box_a", "box_b"))


def density_clusters(points: DataFrame, axes: Sequence[str], *, id_col: str, eps: float = EPS, min_points: int = MIN_POINTS,
                     written: Callable[[DataFrame], DataFrame], part: int = PART, pairs: int = PAIRS) -> DataFrame:
    """(id_col, label, is_core) of each point. ``written`` materialises a table in the shared folder."""
    side = eps / math.sqrt(len(axes)) * (1 - 1e-9)  # the diagonal stays within eps in floating point too
    offsets = _offsets(len(axes), side, eps)
    given = points.select(F.col(id_col).alias("id"), *[F.col(c).cast("double").alias(c) for c in axes])
    known = functools.reduce(lambda a, b: a & b, [F.abs(F.col(c)) < float("inf") for c in axes])  # no null, NaN or infinity
    known = F.coalesce(known, F.lit(False))
    rows = written(given.where(known).withColumn("cell", _cells(axes, side)).withColumn("row", F.monotonically_increasing_id()))
    counts = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).withColumn("parts", (F.floor((F.col("n") - 1) / part) + 1).cast("long"))
    counts = written(counts)
    sized = written(rows.join(counts, "cell").withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")))
                    .withColumn("crowded", F.col("n") >= min_points).drop("parts"))
    lone, parts = sized.where(~F.col("crowded")), counts.select("cell", "parts")
    near = compare(lone, sized.select("cell", "part", *axes), parts, axes, offsets, eps, F.count(F.lit(1)))
    core = written(sized.join(near, "row", "left").select(
        "row", "id", "cell", "part", *axes, (F.col("crowded") | (F.col("n") + F.coalesce("found", F.lit(0)) >= min_points)).alias("is_core")))
    inner = core.where("is_core")
    links = touching(inner, axes, side, eps, offsets, written, pairs)
    named = components(links, written)
    cells = inner.groupBy("cell").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")).join(
        named.withColumnRenamed("id", "cell"), "cell", "left").withColumn("component", F.coalesce("component", "cell"))
    cells = written(cells)
    labels = cells.groupBy("component").agg(F.min("least").alias("label"))
    labelled = written(cells.join(labels, "component").select("cell", "label"))
    outer = core.where("NOT is_core")
    heads = inner.select("cell", "part", *axes).join(labelled, "cell")
    border = compare(outer, heads, parts, axes, offsets, eps, F.min("label")).unionByName(
        outer.join(labelled, "cell").select("row", F.col("label").alias("found"))).groupBy("row").agg(F.min("found").alias("found"))
    out = inner.join(labelled, "cell").select("id", "label", "is_core").unionByName(
        outer.join(border, "row", "left").select("id", F.coalesce("found", F.lit(NOISE)).alias("label"), "is_core"))
    lost = given.where(~known).select("id", F.lit(None).cast("long").alias("label"), F.lit(False).alias("is_core"))
    return out.unionByName(lost).withColumnRenamed("id", id_col)


def standardised(points: DataFrame, features: Sequence[str], digits: int = 6) -> DataFrame:
    """The features as z-scores (population deviation, rounded), all other columns as they are."""
    for c in features:
        stats = points.agg(F.avg(c).alias("m"), F.stddev_pop(c).alias("s")).select(F.struct("m", "s")).scalar()
        points = points.withColumn(c, F.round((F.col(c) - stats["m"]) / stats["s"], digits))
    return points
