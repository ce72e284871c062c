import numpy as np
import pytest
from pyspark.sql import functions as F

from orbitcart.operators.oversample import neighbours, oversample, recall
from orbitcart.session import written_table


def frame(spark, x, labels, ids=None):
    ids = range(len(x)) if ids is None else ids
    rows = [(int(i), None if y is None else float(y), [float(v) for v in p] if p is not None else None, "other") for i, y, p in zip(ids, labels, x)]
    return spark.createDataFrame(rows, "cid long, churned double, features array<double>, row string")


def test_classes_are_balanced_by_points_between_near_neighbours(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(0, 1, (400, 6)), rng.normal(2, .5, (90, 6)), np.full((30, 6), 5.0)])
    labels = [0] * 400 + [1] * 120
    options = {"label": "churned", "id_col": "cid", "vector": "features", "written": written_table, "block": 64}
    got = oversample(frame(spark, x, labels), **options).collect()
    old, new = [r for r in got if r.gap is None], [r for r in got if r.gap is not None]
    assert sorted(r.id for r in old) == list(range(520)) and len(new) == 280 and {r.label for r in new} == {1.0}
    made = np.bincount([r.id for r in new], minlength=520)
    assert made[:400].sum() == 0 and set(made[400:]) == {2, 3}  # dealt evenly
    gaps = np.sqrt(((x[400:, None] - x[None, 400:]) ** 2).sum(-1))
    np.fill_diagonal(gaps, np.inf)
    fifth = np.sort(gaps, axis=1)[:, 4]
    for r in new:
        assert 0 <= r.gap < 1 and r.near_id >= 400 and r.id >= 400
        assert np.allclose(r.x, x[r.id] + r.gap * (x[r.near_id] - x[r.id]))
    near = [gaps[r.id - 400, r.near_id - 400] <= fifth[r.id - 400] * (1 + 1e-9) for r in new]
    assert np.mean(near) >= 0.9
    again = oversample(frame(spark, x, labels), **options).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, again), key=repr)


def test_recall_is_measured_right_and_blocks_bound_the_work(spark):
    """Half of all points are equal; blocks of 64 hold neighbours of most others."""
    rng = np.random.default_rng(9)
    x = np.concatenate([np.zeros((600, 4)), rng.normal(0, 1, (600, 4))])
    points = frame(spark, x, [1] * 1200).select(F.col("cid").alias("row"), F.col("features").alias("x"))
    found, share = neighbours(points, 4, written=written_table, block=64)
    assert share >= 0.9 and share == recall(found, points, 5)
    gaps = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(gaps, np.inf)
    fifth = np.sort(gaps, axis=1)[:, 4]
    hits = [sum(n.distance <= fifth[r.row] * (1 + 1e-9) for n in r.nearest) / 5 for r in found.collect()]
    assert np.mean(hits) >= 0.88
    with pytest.raises(ValueError, match="recall"):
        neighbours(points, 4, written=written_table, block=8, min_recall=1.0, max_tables=1)


def test_rows_that_cannot_be_balanced_stay(spark):
    options = {"label": "churned", "id_col": "cid", "vector": "features", "written": written_table}
    few = frame(spark, [[i, 1.0] for i in range(25)], [1] * 5 + [0] * 20)
    assert oversample(few, **options).count() == 25
    assert oversample(few.where("churned = 0"), **options).count() == 20
    assert oversample(few.limit(0), **options).collect() == []
    odd = frame(spark, [[i, 1.0] for i in range(30)] + [None, [float("nan"), 1.0]], [1] * 10 + [0] * 19 + [None, 1, 1])
    got = oversample(odd, **options)
    assert got.where("gap IS NULL").count() == 32 and got.where("gap IS NOT NULL").count() == 9


def test_model_fitted_on_balanced_rows(spark):
    """A rare class: the model fitted on interpolated rows finds most of it among unseen customers."""
    from orbitcart.operators.churn import CHURN_FEATURES, fit_oversampled
    rng = np.random.default_rng(6)
    label = (rng.uniform(size=900) < 0.06).astype(float)
    x = rng.normal(0, 1, (900, len(CHURN_FEATURES))) + 1.2 * label[:, None]
    rows = spark.createDataFrame([(i, float(y), *map(float, v)) for i, (y, v) in enumerate(zip(label, x))],
                                 "customer_unique_id long, churn_label double, " + ", ".join(f"{c} double" for c in CHURN_FEATURES))
    model = fit_oversampled(rows.where("customer_unique_id < 600"))
    got = model.transform(rows.where("customer_unique_id >= 600")).select("churn_label", "prediction").toPandas()
    assert got[got.churn_label == 1].prediction.mean() >= 0.8
    assert got[got.churn_label == 0].prediction.mean() <= 0.2
