"""Exact top-k search by inner product as a Voronoi join (operator 1).

Pivots (a bounded sample of the vectors) divide the space; each query belongs to the cell of
its nearest pivot. For a cell with pivot p whose queries lie within radius R, any query q of
it and any vector x satisfy  p.x - R|x| <= q.x <= p.x + R|x|.  A summary pass over the data
keeps, per cell, the k + 1 highest lower bounds (one of them may be the query's own row); the
lowest of these is a score that every query of the cell reaches. A second pass sends a vector
only to the cells whose bound it can reach, and there the search is solved locally.

A cell's queries are dealt out in blocks and its vectors in chunks, so neither a full cell nor
a vector that very many rows repeat meets in one task; each block-chunk group is one matrix
product, gives at most k rows a query, and these are merged by score. Vectors move without
their bounds. In many dimensions bounds are wide and most vectors go to most cells; the number
of cells then grows with the queries (one cell a QUERY_BLOCK), not with the data.

Components are floor(scale * x) as integers; scores are exact while they fit in a long.

Defined cases: vectors that are null or hold a null or non-finite component take no part, nor
do rows with a null id; shorter vectors count as filled up with zeros; equal scores go to the
smaller id; rows that repeat an id are candidates each, a query's own id never is; a query
repeated with its vector is one query, with another vector one more of the same id; fewer than
k candidates give fewer rows; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orbitcart.llm.common import cut, only, saved

#: Pivots at least and at most; queries and vectors in one local block.
PIVOTS_LEAST, PIVOTS_MOST, QUERY_BLOCK, DATA_CHUNK = 8, 512, 2048, 16_384
_VECTOR = "vec_id long, vector array<long>"


def integer_vectors(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """vec_id, vector (floor(scale * x) of each component) of the rows that take part."""
    def finite(x: Column) -> Column:
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))

    rows = only(vectors, vec_id=id_col, x=vector_col).select(F.col("vec_id").cast("long"), F.col("x").cast("array<double>").alias("x"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("x").isNotNull()).filter(F.forall("x", finite))
    return rows.select("vec_id", F.transform("x", lambda v: F.floor(v * scale).cast("long")).alias("vector"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """The vectors of an Arrow list column as rows filled up to ``width``."""
    at, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    sizes = np.diff(at)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = flat[at[0]:at[-1]]
    return out


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products; through floating point where that is exact."""
    reach = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if reach < 2 ** 53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


def top_k(queries: DataFrame, data: DataFrame, k: int = 5, *, query_block: int = QUERY_BLOCK, data_chunk: int = DATA_CHUNK,
          seed: int = 1) -> DataFrame:
    """query_id, rank, vec_id, score: for each query the k best rows of ``data`` with another id.

    Both frames have vec_id and vector (``integer_vectors``).
    """
    spark = data.sparkSession
    data, queries = saved(data, "vectors"), saved(queries.dropDuplicates(["vec_id", "vector"]), "query-vectors")
    schema = "query_id long, rank int, vec_id long, score long"
    n_queries, width = queries.agg(F.count("*"), F.max(F.size("vector"))).first()
    n_data, data_width = data.agg(F.count("*"), F.max(F.size("vector"))).first()
    if not n_queries or not n_data:
        return spark.createDataFrame([], schema)
    width = max(width, data_width, 1)

    wanted = min(PIVOTS_MOST, max(PIVOTS_LEAST, -(-n_queries // query_block)))
    picked = data.sample(min(1.0, 4 * wanted / n_data + 0.001), seed).orderBy(F.xxhash64("vec_id"), "vec_id").limit(wanted).collect() or data.limit(wanted).collect()
    pivots = np.zeros((len(picked), width), np.int64)
    for i, row in enumerate(picked):
        pivots[i, :len(row["vector"])] = row["vector"]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pivots.astype(np.float64)
        for batch in batches:
            x = _matrix(batch.column("vector"), width).astype(np.float64)
            square = (x * x).sum(1)[:, None] + (own * own).sum(1) - 2 * x @ own.T
            cell = square.argmin(1)
            # a little more than the distance, so that rounding never loses a neighbour
            away = np.sqrt(np.maximum(square[np.arange(len(x)), cell], 0)) * (1 + 1e-9) + 1e-6
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("vector"), pa.array(cell.astype(np.int32)), pa.array(away)],
                                             names=["vec_id", "vector", "cell", "away"])

    placed = saved(queries.mapInArrow(assign, _VECTOR + ", cell int, away double"), "placed-queries")
    cells = placed.groupBy("cell").agg(F.max("away").alias("radius"), F.count("*").alias("n")).collect()  # one row a pivot
    number = np.array(sorted(r["cell"] for r in cells))
    radius = np.array([r["radius"] for r in sorted(cells, key=lambda r: r["cell"])])
    size = {r["cell"]: r["n"] for r in cells}
    own = pivots[number]

    def bounds(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        x = _matrix(batch.column("vector"), width)
        middle = x.astype(np.float64) @ own.T.astype(np.float64)
        slack = np.sqrt((x.astype(np.float64) ** 2).sum(1))[:, None] * radius * (1 + 1e-9) + 1e-6 * (1 + np.abs(middle))
        return middle - slack, middle + slack

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.full((0, len(number)), 0.0)
        for batch in batches:
            best = np.sort(np.concatenate([best, bounds(batch)[0]]), axis=0)[-(k + 1):]
        yield pa.RecordBatch.from_arrays([pa.array(np.tile(number.astype(np.int32), len(best))), pa.array(best.ravel())], names=["cell", "low"])

    # an id may fill several rows, so the k + 1 best count distinct ids only where ids are distinct
    lows = data.mapInArrow(summarise, "cell int, low double")
    ranked = lows.withColumn("place", F.row_number().over(Window.partitionBy("cell").orderBy(F.desc("low"))))
    reached = {r["cell"]: r["low"] for r in ranked.filter(F.col("place") == k + 1).collect()}
    repeated = data.groupBy("vec_id").count().filter("count > 1").limit(1).count() > 0
    floor = np.array([-np.inf if repeated else reached.get(c, -np.inf) for c in number])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, cell = np.nonzero(bounds(batch)[1] >= floor)
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(at), batch.column("vector").take(at), pa.array(number[cell].astype(np.int32))],
                                             names=["vec_id", "vector", "cell"])

    chunks = max(1, -(-n_data // data_chunk))
    blocks = F.create_map(*[F.lit(int(x)) for c in number for x in (c, -(-size[c] // query_block))])
    # every block of a cell's queries meets every chunk of the vectors sent there
    left = (placed.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.element_at(blocks, F.col("cell"))).cast("int"))
            .withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
            .select("cell", "block", "chunk", F.lit(0).alias("role"), "vec_id", F.xxhash64("vector").alias("own"), "vector"))
    right = (data.mapInArrow(route, _VECTOR + ", cell int")
             .withColumn("chunk", F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(chunks)).cast("int"))
             .withColumn("block", F.explode(F.sequence(F.lit(0), F.element_at(blocks, F.col("cell")) - 1)))
             .select("cell", "block", "chunk", F.lit(1).alias("role"), "vec_id", F.lit(0).cast("long").alias("own"), "vector"))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, query_ids, owns, query_rows = None, [], [], []
        best: list[tuple[np.ndarray, np.ndarray]] = []

        def answers() -> pa.RecordBatch:
            rows = [(q, o, v, s) for q, o, (vs, ss) in zip(query_ids, owns, best) for v, s in zip(vs.tolist(), ss.tolist())]
            columns = zip(*rows) if rows else ((),) * 4
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query_id", "own", "vec_id", "score"])

        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("cell", "block", "chunk", "role")], axis=1)
            starts = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(1)]))
            for a, b in zip(starts, np.append(starts[1:], len(keys))):
                part = batch.slice(a, b - a)
                if tuple(keys[a, :3]) != group:
                    yield answers()
                    group, query_ids, owns, query_rows, best = tuple(keys[a, :3]), [], [], [], []
                ids, x = part.column("vec_id").to_numpy(), _matrix(part.column("vector"), width)
                if keys[a, 3] == 0:
                    query_ids.extend(ids.tolist())
                    owns.extend(part.column("own").to_pylist())
                    query_rows.append(x)
                    best.extend([(np.empty(0, np.int64), np.empty(0, np.int64))] * len(ids))
                    continue
                if not query_ids:
                    continue
                query_rows = [np.concatenate(query_rows)]
                scores = _products(query_rows[0], x)
                for i, q in enumerate(query_ids):
                    line, other = scores[i], ids != q
                    if len(line) > 4 * k:  # ties with the k-th of the other ids stay in
                        line = np.where(other, line, np.iinfo(np.int64).min)
                        other &= line >= np.partition(line, -k)[-k]
                    v, s = np.concatenate([best[i][0], ids[other]]), np.concatenate([best[i][1], line[other]])
                    first = np.lexsort((v, -s))[:k]
                    best[i] = v[first], s[first]
        yield answers()

    rows = left.union(right).repartition("cell", "block", "chunk").sortWithinPartitions("cell", "block", "chunk", "role")
    found = rows.mapInArrow(solve, "query_id long, own long, vec_id long, score long")
    order = Window.partitionBy("query_id", "own").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int"), "vec_id", "score"))
