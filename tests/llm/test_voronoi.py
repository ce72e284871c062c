import math

import pytest

from orbitcart.llm import voronoi

VECTOR = "vec_id long, embedding array<float>, cell int"


def brute(rows, k, pick):
    own = {(i, tuple(math.floor(256 * float(x)) for x in v)) for i, v in rows
           if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    every = [(i, tuple(math.floor(256 * float(x)) for x in v)) for i, v in rows
             if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, x in own:
        if pick(q):
            best = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in every if i != q)[:k]
            out += [(q, rank, i, -s) for rank, (s, i) in enumerate(best, 1)]
    return sorted(out)


def solve(spark, rows, k, pick, **options):
    frame = spark.createDataFrame([(i, v, 1) for i, v in rows], VECTOR)
    vectors = voronoi.integer_vectors(frame)
    return sorted(tuple(r) for r in voronoi.top_k(vectors.filter(pick), vectors, k, **options).collect())


def test_matches_brute_force_with_ties_and_unusable_rows(spark):
    import random
    rnd = random.Random(1)
    rows = [(i, [rnd.gauss(0, 0.3) for _ in range(6)]) for i in range(300)]
    rows += [(1000 + i, [0.5] * 6) for i in range(40)]  # equal vectors: ties go to smaller ids
    rows += [(2000, None), (2010, [0.1, None]), (2020, [float("nan")]), (2030, [float("inf"), 0.0]), (None, [0.5] * 6),
             (2040, [0.25, 0.25]), (2050, [])]
    expected = brute(rows, 5, lambda q: q % 10 == 0)
    assert solve(spark, rows, 5, "vec_id % 10 = 0") == expected
    # small blocks and chunks: many groups for each cell
    assert solve(spark, rows, 5, "vec_id % 10 = 0", query_block=7, data_chunk=50) == expected


def test_clusters_are_pruned_without_loss(spark):
    import random
    rnd = random.Random(2)
    centres = [[rnd.gauss(0, 3) for _ in range(4)] for _ in range(12)]
    rows = [(i, [c + rnd.gauss(0, 0.01) for c in centres[i % 12]]) for i in range(400)]
    assert solve(spark, rows, 3, "vec_id % 20 = 0", query_block=4) == brute(rows, 3, lambda q: q % 20 == 0)


def test_few_rows_repeated_ids_and_empty_tables(spark):
    assert solve(spark, [(0, [1.0]), (1, [2.0])], 5, "vec_id = 0") == [(0, 1, 1, 256 * 512)]
    rows = [(0, [1.0]), (0, [2.0]), (0, [2.0]), (1, [1.0]), (1, [3.0]), (2, [0.5])]
    assert solve(spark, rows, 2, "vec_id = 0") == brute(rows, 2, lambda q: q == 0)
    assert solve(spark, [], 5, "vec_id = 0") == []
    assert solve(spark, [(7, None)], 5, "vec_id = 7") == []


def test_an_id_of_many_rows_hides_no_other(spark):
    rows = [(0, [1.0 + i % 7, 0.0]) for i in range(50)] + [(i, [0.5, i / 64]) for i in range(1, 41)]
    assert solve(spark, rows, 5, "vec_id in (0, 7)") == brute(rows, 5, lambda q: q in (0, 7))


@pytest.mark.parametrize("big", [1e6, 1e7])
def test_large_components_stay_exact(spark, big):
    rows = [(0, [big, 1 / 256]), (1, [big, 1 / 256]), (2, [big, 2 / 256]), (3, [-big, 0.0])]
    assert solve(spark, rows, 3, "vec_id = 0") == brute(rows, 3, lambda q: q == 0)
