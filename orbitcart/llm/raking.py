"""Mixing documents to target weights by iterative proportional fitting (operator 8).

Documents fall in cells of (source, language, topic); a cell's mass is its token count.
Raking multiplies cell weights in turn so that the sources', the languages' and the topics'
totals meet their targets, until all three do. A cell's ratio is its raked weight over its
mass. Documents are drawn with probability min(1, scale * ratio), where the scale makes the
expected tokens equal to the budget; the draw compares a hash of the document with it, so a
repeated run draws the same documents.

Texts are read once for tokens and topics; raking works on the cells, which are written anew
each round. Totals are combined before they are shuffled, so no source gathers in a task.

A topic is the one of TOPICS word groups (by hash) that holds most of the text's distinct
long words, unless a topic column is given.

Defined cases: null and empty texts have no tokens, belong to topic 0 and are drawn like
others of their cell; null sources and languages are groups of their own; a cell without mass
has ratio 1; rows that repeat an id are drawn alike; an empty table gives no rows; other
columns are kept by ``mix`` and not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbitcart.llm.common import cut, only, packed, saved, slices, text_or_empty

TOPICS, LONG_WORD = 8, 6
#: Share of all tokens that is drawn; exponents of the default targets (0: equal, 1: as they are).
BUDGET, EXPONENTS = 0.6, {"source": 0.7, "lang": 0.7, "topic": 0.5}
ROUNDS, TOLERANCE = 30, 1e-4
DIMENSIONS = ("source", "lang", "topic")


class _Groups(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        group = self[word] = xxhash.xxh32_intdigest(word) % TOPICS
        return group


_groups = _Groups()


def topic_of(words: set[bytes]) -> int:
    long = [_groups[w] for w in words if len(w) >= LONG_WORD]
    return int(np.bincount(long, minlength=TOPICS).argmax()) if long else 0


def describe(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
             lang_col: str = "lang") -> DataFrame:
    """doc_id, source, lang, topic, n_tokens (white-space words) of each row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words = [t.encode().lower().split() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("doc_id", "source", "lang")]
                + [pa.array([topic_of(set(w)) for w in words], pa.int32()), pa.array([len(w) for w in words], pa.int64())],
                names=["doc_id", "source", "lang", "topic", "n_tokens"])

    rows = only(docs, doc_id=id_col, source=source_col, lang=lang_col, text=text_col)
    rows = rows.select(F.col("doc_id").cast("long"), *[F.col(c).cast("string") for c in ("source", "lang")], text_or_empty().alias("text"))
    return rows.mapInArrow(run, "doc_id long, source string, lang string, topic int, n_tokens long")


def tempered_targets(cells: DataFrame, dimension: str, exponent: float) -> DataFrame:
    """Target totals of one dimension: shares to the power of ``exponent``, scaled to the whole mass."""
    totals = cells.groupBy(dimension).agg(F.sum("mass").alias("total"))
    whole = totals.agg(F.sum("total").alias("mass"), F.sum(F.pow("total", F.lit(exponent))).alias("powers"))
    return totals.crossJoin(F.broadcast(whole)).select(  # one row
        dimension, F.when(F.col("total") > 0, F.col("mass") * F.pow("total", F.lit(exponent)) / F.col("powers")).otherwise(0.0).alias("target"))


def rake(cells: DataFrame, targets: dict[str, DataFrame], *, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """``cells`` (dimensions, mass) with ``weight``: marginal totals meet the targets.

    Each target frame has its dimension and ``target``. Rounds end when the first dimension's
    totals, off again after the others' turns, are within ``tolerance`` of their targets.
    """
    cells = saved(cells.withColumn("weight", F.col("mass").cast("double")), "cells")
    count = cells.count()
    cells = packed(cells, count)
    goals = {d: saved(t.select(d, F.col("target").cast("double")), "targets") for d, t in targets.items()}
    goals = {d: packed(goal, goal.count()) for d, goal in goals.items()}
    columns = cells.drop("weight").columns
    for _ in range(rounds):
        off = None
        for dimension, goal in goals.items():
            # each step is written as a table: a checkpoint would keep the joins' estimated sizes, which multiply
            now = cells.groupBy(dimension).agg(F.sum("weight").alias("now"))
            step = now.join(goal, now[dimension].eqNullSafe(goal[dimension])).select(
                now[dimension].alias("key"), F.when(F.col("now") > 0, F.col("target") / F.col("now")).otherwise(1.0).alias("factor"))
            turned = cells.join(step, cells[dimension].eqNullSafe(step["key"])).select(
                *columns, (F.col("weight") * F.col("factor")).alias("weight"), "factor")
            turned = packed(saved(turned, "raked-cells"), count)
            if off is None:
                off = turned.agg(F.max(F.abs(F.col("factor") - 1))).first()[0]
            cells = turned.drop("factor")
        if not off or off <= tolerance:
            break
    return cells


def probabilities(cells: DataFrame, budget: float) -> DataFrame:
    """Raked cells with ``probability``: min(1, scale * weight / mass), expected tokens = budget * mass."""
    cells = cells.withColumn("ratio", F.when(F.col("mass") > 0, F.col("weight") / F.col("mass")).otherwise(1.0))
    mass, least = cells.agg(F.sum("mass"), F.min(F.when(F.col("ratio") > 0, F.col("ratio")))).first()
    low, high = 0.0, 1 / least if least else 1.0  # at the upper end every cell is taken whole
    for _ in range(4):  # each pass tries 63 scales at once and narrows the bracket 64 times
        grid = np.linspace(low, high, 65)[1:-1]
        tried = cells.select("mass", "ratio", F.explode(F.array(*[F.lit(float(x)) for x in grid])).alias("scale"))
        taken = tried.groupBy("scale").agg(F.sum(F.col("mass") * F.least(F.lit(1.0), F.col("scale") * F.col("ratio"))).alias("mass")).collect()
        below = sum((t["mass"] or 0.0) < budget * (mass or 0) for t in taken)
        step = (high - low) / 64
        low, high = low + below * step, low + (below + 1) * step
    return cells.withColumn("probability", F.least(F.lit(1.0), F.lit(float(high)) * F.col("ratio")))


def draw(doc_id: Column, seed: int = 8) -> Column:
    """A number in [0, 1) that is fixed for a document."""
    return F.shiftrightunsigned(F.xxhash64(doc_id, F.lit(seed)), 11) / float(1 << 53)


def mix(docs: DataFrame, targets: dict[str, DataFrame] | None = None, *, budget: float = BUDGET, seed: int = 8, id_col: str = "doc_id",
        text_col: str = "text", source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """doc_id, source, lang, topic, n_tokens, weight, probability, kept of each row."""
    described = saved(describe(docs, id_col=id_col, text_col=text_col, source_col=source_col, lang_col=lang_col), "described")
    cells = cut(described.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("mass")))
    cells = packed(cells, cells.count())
    targets = targets or {d: tempered_targets(cells, d, EXPONENTS[d]) for d in DIMENSIONS}
    raked = probabilities(rake(cells, targets), budget)
    raked = cut(raked.select(*[F.col(d).alias(f"cell_{d}") for d in DIMENSIONS], F.col("ratio").alias("weight"), "probability"))
    same = [described[d].eqNullSafe(raked[f"cell_{d}"]) for d in DIMENSIONS]
    out = described.join(raked, same[0] & same[1] & same[2], "left").select("doc_id", *DIMENSIONS, "n_tokens", "weight", "probability")
    return out.withColumn("kept", draw(F.col("doc_id"), seed) < F.col("probability"))
