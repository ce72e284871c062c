import hashlib
from collections import Counter

import numpy as np
import pytest

from orbitcart.llm import prefix_free, rolling

LENGTH = prefix_free.LENGTH


def brute(rows):
    """(doc_id, n_bytes, n_removed, n_spans, sha256 of the rest) of each row, sorted."""
    datas = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(d[a:a + LENGTH] for _, d in datas for a in range(len(d) - LENGTH + 1))
    out = []
    for i, d in datas:
        gone = np.zeros(len(d) + 1, bool)
        for a in range(len(d) - LENGTH + 1):
            if seen[d[a:a + LENGTH]] > 1:
                gone[a:a + LENGTH] = True
        spans = int((gone[1:] & ~gone[:-1]).sum()) + int(gone[0])
        rest = np.frombuffer(d, np.uint8)[~gone[:-1]].tobytes()
        out.append((i, len(d), int(gone.sum()), spans, hashlib.sha256(rest).hexdigest()))
    return sorted(out, key=repr)


def words(n, seed):
    rnd = np.random.default_rng(seed)
    return " ".join("".join(rnd.choice(list("abcdefghé"), rnd.integers(2, 9))) for _ in range(n))


def corpus():
    rows = [(i, words(120, i)) for i in range(6)]
    passages = [words(n, 50 + n) for n in (58, 70, 90, 200)]  # from just under the length upwards
    k = 10
    for p in passages:
        for j in range(5):
            rows.append((k, words(30 + j, 200 + k) + p + words(20, 300 + k)))
            k += 1
    shared = words(200, 77)
    rows += [(60 + j, shared[11 * j:600 + 17 * j] + words(15, 400 + j)) for j in range(12)]  # overlaps of many lengths
    rows += [(80, rows[0][1]), (81, rows[0][1] + "."), (82, "ab" * 700), (83, "a" * 399), (84, "a" * 400), (85, "a" * 402), (86, ""), (87, None)]
    rows += [(90, words(40, 5) + shared + words(10, 6) + shared)]
    return rows


@pytest.mark.parametrize("group", [prefix_free.GROUP, 1, 3])
def test_matches_brute_force(awkward, group):
    docs = awkward(corpus())
    got = prefix_free.digests(docs, prefix_free.remove_repeats(docs, group=group)).collect()
    assert sorted(map(tuple, got), key=repr) == brute(corpus())


def test_repeated_rows_null_ids_and_empty_tables(awkward):
    text = words(150, 1)
    rows = [(1, text), (1, text), (2, words(150, 2)), (2, words(150, 3)), (None, text), (None, None)]
    docs = awkward(rows)
    got = prefix_free.digests(docs, prefix_free.remove_repeats(docs)).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)
    empty = awkward([])
    assert prefix_free.digests(empty, prefix_free.remove_repeats(empty)).count() == 0


def test_every_string_lies_in_one_phrase_found_by_its_content():
    text = words(300, 9)
    first, last, trigger, core, phrase = prefix_free.parse(text)
    starts = len(text.encode()) - LENGTH + 1
    assert first[0] == 0 and last[-1] == starts - 1 and (first[1:] == last[:-1] + 1).all()
    assert ((trigger >= last) & (trigger < first + prefix_free.RANGE)).all()
    moved = prefix_free.parse("xyz " + text)
    assert set(phrase[2:-1]) <= set(moved[4])
    assert prefix_free.parse("short") is None


def test_common_lengths_and_rolling_hashes():
    rnd = np.random.default_rng(4)
    strings = ["".join(rnd.choice(list("ab"), rnd.integers(0, 9))).encode() for _ in range(30)]
    table = prefix_free.common_lengths(strings)
    for i, a in enumerate(strings):
        for j, b in enumerate(strings):
            if i != j:
                assert table[i, j] == next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    data = np.frombuffer((words(50, 1) * 2).encode(), np.uint8)
    hashes = rolling.Rolling(data).windows(20)
    half = len(data) // 2
    assert (hashes[:half - 19] == hashes[half:]).all() and len(set(hashes[:half - 19].tolist())) == half - 19
    values = rnd.integers(0, 1 << 63, 400, dtype=np.uint64)
    low = rolling.window_minima(values, 64)
    assert all(low[i] == i + np.argmin(values[i:i + 64] >> np.uint64(32)) for i in range(len(low)))
