import re

import numpy as np
import pytest

from orbitcart.llm import common, oph


def word_set(text):
    words = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    """doc_id -> (n_shingles, component, kept); ids are distinct and not null."""
    sets, root = {i: word_set(t) for i, t in rows}, {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def sentence(n, seed):
    rnd = np.random.default_rng(seed)
    return [f"w{x}" for x in rnd.integers(0, 10_000, n)]


def edited(words, share, seed):
    rnd, words = np.random.default_rng(seed), list(words)
    for i in np.flatnonzero(rnd.random(len(words)) < share):
        words[i] = f"e{seed}x{i}"
    return words


def corpus():
    rows = [(i, " ".join(sentence(60 + i, i))) for i in range(20)]
    base = sentence(300, 100)
    rows += [(100 + i, " ".join(edited(base, 0.02, i))) for i in range(30)]  # a chain of near copies
    template = sentence(120, 200)  # alike but mostly below the threshold
    rows += [(200 + i, " ".join(template + sentence(60, 300 + i))) for i in range(25)]
    rows += [(300 + i, " ".join(template + sentence(25, 400 + i))) for i in range(10)]
    rows += [(400, rows[0][1]), (401, rows[0][1].upper().replace("W", "w")), (402, "  " + rows[0][1].replace(" ", "\n\t")), (403, None), (404, ""),
             (405, " \n"), (406, "one two"), (407, "One  TWO"), (408, "one two three"), (409, "long " * 20_000), (410, "long " * 15_000),
             (411, "ÀB c d e f"), (412, "àb c d e f")]
    return rows


def test_matches_brute_force(awkward):
    rows = corpus()
    got = {r.doc_id: tuple(r)[1:] for r in oph.near_duplicates(awkward(rows)).collect()}
    assert got == brute(rows)


def test_repeated_rows_null_ids_and_empty_tables(awkward):
    text = " ".join(sentence(50, 1))
    got = oph.near_duplicates(awkward([(5, text), (5, text), (3, text), (None, text), (7, "else where"), (7, "some thing"), (None, None)])).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in got) == [
        (0, 0, True), (0, 0, True), (3, 3, True), (5, 3, False), (5, 3, False), (7, 7, True), (7, 7, True)]
    assert oph.near_duplicates(awkward([])).count() == 0
    assert [r.kept for r in oph.near_duplicates(awkward([(1, None)])).collect()] == [True]


@pytest.mark.parametrize("size", [3, 40, 2000])
def test_bins_agree_as_often_as_sets(size):
    rnd, agree, bins = np.random.default_rng(size), [], 240
    for _ in range(60):
        values = rnd.integers(0, 1 << 64, 5 * size // 4 + 2, dtype=np.uint64)
        a, b = np.unique(values[:size]), np.unique(values[size // 4:])
        both = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        agree.append((oph.signature(a, bins) == oph.signature(b, bins)).mean() - both)
    assert abs(np.mean(agree)) < 0.05


def test_components_equal_union_find(spark):
    rnd = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rnd.integers(0, 400, (260, 2))] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, 2000 + i) for i in range(50)]
    root = {}

    def find(i):
        root.setdefault(i, i)
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        low, high = sorted((find(a), find(b)))
        root[high] = low
    got = {r.id: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: find(i) for i in root if find(i) != i}
