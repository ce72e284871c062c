"""Quality scores from preference pairs (operator 2).

A Bradley-Terry model: each document has a score w.x of its text features x, and the chance
that one is preferred to another is the logistic function of their score difference. Pairs of
a good and a bad labelled document are fitted by logistic loss on feature differences (no
intercept). The scores' threshold lies halfway between the bad documents' high quantile and
the good documents' low quantile of the labelled sample; ``score`` is the logistic function
of the distance to it, so 0.5 is the threshold.

All labelled documents are read. They are dealt to buckets by a hash and meet those of the other label in
theirs: PAIRS_PER_ROW or more on average (at least PAIRS pairs in all, or all pairs if there are fewer),
so that fewer than one in 2,000 meets none. The quantiles are exact; features use the text alone.
``sample_rows`` fits on a hash sample instead; no query uses it.

Defined cases: null and empty texts have all-zero features and a score like any other; a
document labelled more than once counts as good if most of its labels are; without good or
without bad labelled documents all scores are 0.5; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbitcart.functions.ranks import exact_percentiles
from orbitcart.llm.common import cut, only, slices, text_or_empty

#: Pairs that are fitted: at least PAIRS, if there are as many, and PAIRS_PER_ROW for each labelled document.
PAIRS, PAIRS_PER_ROW = 60_000, 8
#: Quantiles of the bad (high) and the good (low) scores that the threshold lies between.
BAD_QUANTILE, GOOD_QUANTILE = 0.98, 0.02

FEATURES = ("log_words", "word_bytes", "capitals", "digits", "punctuation", "exclamations", "symbols", "lone_signs",
            "log_repetition", "same_as_last", "repeated_lines")
_SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)
_SIGNS = np.zeros(256, bool)
_SIGNS[np.r_[33:48, 58:65, 91:97, 123:127]] = True
_SPACES = np.zeros(256, bool)
_SPACES[[9, 10, 11, 12, 13, 32]] = True


def text_features(text: str) -> list[float]:
    data = text.encode()
    words = data.split()
    if not words:
        return [0.0] * len(FEATURES)
    n, codes = len(words), np.frombuffer(data, np.uint8)
    counts = np.bincount(codes, minlength=256)
    letters = counts[65:91].sum() + counts[97:123].sum() + counts[128:].sum()
    space = np.concatenate([[True], _SPACES[codes], [True]])
    lone = int((_SIGNS[codes] & space[:-2] & space[2:]).sum())
    same = sum(map(operator.eq, words, words[1:]))
    lines = [x for x in data.split(b"\n") if x.strip()]
    return [np.log1p(n), min(50.0, len(data) / n), counts[65:91].sum() / max(1, letters), counts[48:58].sum() / len(data),
            min(3.0, counts[[44, 46]].sum() / n), min(3.0, counts[33] / n), min(3.0, counts[_SYMBOLS].sum() / n), lone / n,
            np.log(n / len(set(words))), same / n, 1 - len(set(lines)) / len(lines)]


@dataclass(frozen=True)
class Model:
    weights: tuple[float, ...]
    threshold: float

    def scores(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features @ np.array(self.weights) - self.threshold, -500, 500)))


def with_features(docs: DataFrame) -> DataFrame:
    """doc_id, text -> doc_id, features."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [text_features(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.list_(pa.float64()))], names=["doc_id", "features"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, features array<double>")


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
        sample_rows: int | None = None, pairs: int = PAIRS, seed: int = 2) -> Model:
    """Fit the pairwise model on the labelled rows of ``docs``."""
    marks = only(labels, doc_id=id_col, mark=label_col).filter("doc_id IS NOT NULL AND mark IS NOT NULL")
    marks = marks.groupBy("doc_id").agg((F.avg("mark") >= 0.5).alias("good"))
    if sample_rows is not None:
        # a hash of the id decides, so the sample is the same in any order of the rows and each time it is read
        share = min(1.0, sample_rows / max(1, marks.count()))
        marks = marks.filter(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)) < int(share * (1 << 30)))
    rows = only(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), text_or_empty().alias("text"))
    # texts are read where they lie: only their numbers are sent to the labels
    known = cut(with_features(rows.filter("doc_id IS NOT NULL")).join(marks, "doc_id"))
    sizes = {r["good"]: r["count"] for r in known.groupBy("good").count().collect()}
    if len(sizes) < 2:
        return Model((0.0,) * len(FEATURES), 0.0)

    # each good document meets the bad ones of its bucket
    wanted = max(pairs, PAIRS_PER_ROW * (sizes[True] + sizes[False]))
    buckets = max(1, round(sizes[True] * sizes[False] / wanted))

    def side(good: bool, name: str) -> DataFrame:
        own = known.filter("good" if good else "NOT good")
        return own.select(F.pmod(F.xxhash64("doc_id", F.lit(good)), F.lit(buckets)).alias("bucket"), F.col("features").alias(name))

    met = side(True, "x").join(side(False, "y"), "bucket")
    # half of the differences are turned round, so that both outcomes occur
    turned = F.pmod(F.xxhash64("x", "y"), F.lit(2)) == 1
    difference = F.zip_with("x", "y", lambda a, b: F.when(turned, b - a).otherwise(a - b))
    train = cut(met.select(array_to_vector(difference).alias("features"), F.when(turned, 0.0).otherwise(1.0).alias("label")))
    fitted = LogisticRegression(fitIntercept=False, regParam=1e-3, maxIter=60).fit(train)
    weights = tuple(map(float, fitted.coefficients))

    raw = F.aggregate(F.zip_with("features", F.array(*map(F.lit, weights)), lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    told = cut(known.select("good", raw.alias("raw")))
    bad, good = (exact_percentiles(told, F.when(F.col("good") == side_, F.col("raw")), [q])[0] for side_, q in ((False, BAD_QUANTILE), (True, GOOD_QUANTILE)))
    ends = told.sparkSession.range(1).select(bad.alias("bad"), good.alias("good")).first()
    return Model(weights, (ends["bad"] + ends["good"]) / 2)


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score (0 to 1) of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = np.array([text_features(t) for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.scores(found))], names=["doc_id", "score"])

    rows = only(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), text_or_empty().alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double")


def held_out(doc_id: Column) -> Column:
    """True for the fold whose labels are not learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def keep_good(docs: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score 0.5 or more, all their columns unchanged."""
    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        found = np.array([text_features(t) for t in texts]).reshape(-1, len(FEATURES))
        return pd.Series(model.scores(found))

    own = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    return docs.filter(scored(own) >= 0.5)
