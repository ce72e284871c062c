import numpy as np
import pytest

from orbitcart.functions.graph import components
from orbitcart.operators.density import density_clusters
from orbitcart.session import written_table


def brute_force(ids, x, eps, min_points):
    near = ((x[:, None, :] - x[None, :, :]) ** 2).sum(-1) <= eps * eps
    core = near.sum(1) >= min_points
    label = {}
    for start in sorted(np.flatnonzero(core), key=lambda i: ids[i]):
        if start in label:
            continue
        todo, label[start] = [start], ids[start]
        while todo:
            for other in np.flatnonzero(near[todo.pop()] & core):
                if other not in label:
                    label[other] = ids[start]
                    todo.append(other)
    out = []
    for i in range(len(ids)):
        heads = [label[j] for j in np.flatnonzero(near[i] & core)]
        out.append((ids[i], label[i] if core[i] else min(heads, default=-1), bool(core[i])))
    return sorted(out)


def clusters(spark, ids, x, eps, min_points, **options):
    rows = [(int(i), *map(float, p), "other") for i, p in zip(ids, x)]
    points = spark.createDataFrame(rows, "cid long, " + ", ".join(f"a{k} double" for k in range(x.shape[1])) + ", cell string")
    got = density_clusters(points, [f"a{k}" for k in range(x.shape[1])], id_col="cid", eps=eps, min_points=min_points,
                           written=written_table, **options)
    assert got.columns == ["cid", "label", "is_core"]
    return sorted(tuple(r) for r in got.collect())


def blobs(rng, dims):
    centres = rng.uniform(-3, 3, (6, dims))
    crowd = np.concatenate([c + rng.normal(0, s, (n, dims)) for c, s, n in zip(centres, (.05, .1, .3, .6, .02, 1.0), (150, 60, 60, 60, 40, 30))])
    line = np.zeros((40, dims))
    line[:, 0] = np.linspace(-8, 8, 40)
    copies = np.repeat(rng.uniform(-6, 6, (3, dims)), (7, 4, 5), axis=0)
    return np.concatenate([crowd, line, copies, rng.uniform(-9, 9, (60, dims))])


@pytest.mark.parametrize("dims, options", [(3, {}), (2, {"part": 16, "pairs": 8})])
def test_equals_brute_force(spark, dims, options):
    """Clusters, border points and noise; small ``pairs`` halve the boxes, small ``part`` deals out crowded cells."""
    rng = np.random.default_rng(dims)
    x = blobs(rng, dims)
    ids = rng.permutation(len(x))
    want = brute_force(ids, x, 0.45, 5)
    assert {b for _, _, b in want} == {True, False} and any(label == -1 for _, label, _ in want)
    assert any(not c and label >= 0 for _, label, c in want)  # border points
    assert clusters(spark, ids, x, 0.45, 5, **options) == want


def test_crowded_cells_just_apart(spark):
    """Two crowds whose least distance is just under, then just over eps: decided without comparing all pairs."""
    rng = np.random.default_rng(1)
    for gap, joined in ((0.2499, 1), (0.2501, 2)):
        left, right = rng.uniform(0, 0.1, (300, 2)) - [0.1, 0], rng.uniform(0, 0.1, (300, 2)) + [gap, 0]
        left[7], right[9] = (0, 0.05), (gap, 0.05)
        x = np.concatenate([left, right])
        got = clusters(spark, np.arange(600), x, 0.25, 5, pairs=50)
        assert len({label for _, label, _ in got}) == joined
        assert got == brute_force(np.arange(600), x, 0.25, 5)


def test_awkward_rows(spark):
    rows = [(1, None, 0.0), (2, float("nan"), 0.0), (3, 0.0, float("inf")), (4, 0.0, 0.0), (4, 0.0, 0.0), (None, 0.0, 0.0)]
    points = spark.createDataFrame(rows, "cid long, x double, y double")
    got = density_clusters(points, ["x", "y"], id_col="cid", eps=1.0, min_points=3, written=written_table)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(
        [(1, None, False), (2, None, False), (3, None, False), (4, 4, True), (4, 4, True), (None, 4, True)], key=repr)
    assert density_clusters(points.limit(0), ["x", "y"], id_col="cid", written=written_table).collect() == []


def test_components_of_long_paths(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 5000 + i) for i in range(50)] + [(7, 7), (3, 900), (900, 3)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long"), written_table).collect()))
    assert got == {**{i: 0 for i in [*range(201), 900]}, **{i: 1000 for i in [1000, *range(5000, 5050)]}}
