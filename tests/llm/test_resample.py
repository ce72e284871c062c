import hashlib
import math
import random
import re
import zlib

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from orbitcart.llm import ngram_table, resample

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, longest=3):
    words = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return words, [" ".join(words[i:i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1)]


def brute_force(docs, target, percent=5):
    counts = []
    for texts in ([t for _, t in docs], target):
        c = [0] * 10000
        for text in texts:
            for f in features(text)[1]:
                c[zlib.crc32(f.encode()) % 10000] += 1
        counts.append(c)
    s, t = counts
    gain = [math.floor(1000 * math.log((t[i] + 1) * (sum(s) + 10000) / ((s[i] + 1) * (sum(t) + 10000)))) for i in range(10000)]
    out = []
    for i, text in docs:
        words, found = features(text)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[zlib.crc32(f.encode()) % 10000] for f in found)
        out.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words)])
    able = sorted((o for o in out if o[5] >= 20), key=lambda o: (-o[3], -1 if o[0] is None else o[0], o[1], o[2]))
    for place, o in enumerate(able[:percent * len(able) // 100]):
        o[4] = place + 1
    return sorted((tuple(o[:5]) for o in out), key=repr)


@given(st.lists(st.binary(max_size=90), min_size=1, max_size=60))
@settings(max_examples=60, deadline=None)
def test_hashes_and_entries(strings):
    strings += strings[::2]
    data = np.frombuffer(b"".join(strings) + bytes(ngram_table.PADDING), np.uint8)
    length = np.array([len(x) for x in strings])
    start = np.cumsum(length) - length
    eight = ngram_table.lanes(data)
    assert [int(x) for x in ngram_table.xxhash64(eight, start, length)] == [xxhash.xxh64_intdigest(x) for x in strings]
    assert [int(x) for x in ngram_table.crc32(data, start, length)] == [zlib.crc32(x) for x in strings]
    for keys in (None, np.zeros(len(strings), np.uint64)):  # equal keys: only the bytes tell strings apart
        entries, slots = ngram_table.intern(eight, start, length, keys)
        assert len(entries) == len(set(strings))
        assert [strings[entries[s]] for s in slots] == strings


@given(st.lists(st.text(alphabet="aB1 é\n-_", max_size=40), min_size=1, max_size=6), st.integers(1, 30))
@settings(max_examples=60, deadline=None)
def test_segments_hold_every_feature_once(texts, segment):
    got = [[] for _ in texts]
    for found in resample.interned([t.encode() for t in texts], segment=segment):
        assert found.count.sum() == len(found.slots)
        for slot, owner in zip(found.slots, found.owner):
            got[owner].append(int(found.bucket[slot]))
    assert [sorted(g) for g in got] == [sorted(zlib.crc32(f.encode()) % 10000 for f in features(t)[1]) for t in texts]


def test_equals_brute_force(spark, awkward):
    rng = random.Random(3)
    vocabulary = ["Alpha", "beta", "é", "don't", "x_y", "7", "gamma-ray", "ÄB", "w" * 70]
    docs = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 3, 19, 20, 21, 60])))) for i in range(120)]
    docs += [(200, None), (201, ""), (202, " \n"), (203, docs[7][1]), (7, docs[7][1]), (None, docs[9][1]), (None, None),
             (204, "beta gamma " * 200_000)]
    target = ["alpha beta beta", None, "", "Gamma ray 7"]
    got = resample.importance_resample(awkward(docs), spark.createDataFrame([(t,) for t in target], "text string"), percent=30)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_force(docs, target, 30)


def test_empty_tables(spark, awkward):
    target = spark.createDataFrame([("alpha beta",)], "text string")
    assert resample.importance_resample(awkward([]).limit(0), target).collect() == []
    docs = [(i, "one two three four five " * 5) for i in range(40)]
    got = resample.importance_resample(awkward(docs), target.limit(0)).collect()
    assert sorted(map(tuple, got), key=repr) == brute_force(docs, [])
    assert sorted(r.rank for r in got if r.rank) == [1, 2]
