import random

import numpy as np
import pyarrow as pa
import xxhash

from orbitcart.llm import chunking


def plain_ends(data, least=chunking.LEAST, most=chunking.MOST):
    """Byte by byte, as the definition says."""
    h, at, ends = 0, 0, []

    def inside(i):
        return i < len(data) and 0x80 <= data[i] < 0xC0

    def forced(at):
        return max(i for i in range(at + most - 3, at + most + 1) if not inside(i))

    for i, byte in enumerate(data, 1):
        h = ((h << 1) + int(chunking._GEAR[byte])) & 0xFFFFFFFF
        if h & chunking.MASK or inside(i):
            continue
        while i - at > most:
            at = forced(at)
            ends.append(at)
        if i - at >= least:
            at = i
            ends.append(at)
    while len(data) - at > most:
        at = forced(at)
        ends.append(at)
    return ends + [len(data)] * (at < len(data))


def random_text(n, seed, words=400):
    rnd = np.random.default_rng(seed)
    lexicon = ["".join(rnd.choice(list("abcdefghijklmnopé"), rnd.integers(2, 9))) for _ in range(words)]
    return " ".join(rnd.choice(lexicon, n))


def test_ends_equal_the_sequential_definition():
    for text in (random_text(900, 1), "a" * 5000, "", "x", "ab" * 900, "é" * 3000, "🙂é日" * 500):
        data = text.encode()
        assert chunking.chunk_ends(np.frombuffer(data, np.uint8)) == plain_ends(data)


def test_insertion_moves_only_near_ends():
    text = random_text(2000, 2).encode()
    cut = text[:3000] + b"inserted words " + text[3000:]
    a, b = (chunking.chunk_ends(np.frombuffer(t, np.uint8)) for t in (text, cut))
    after = {x + 15 for x in a if x > 3400}
    assert len(after - set(b)) == 0 and {x for x in a if x <= 3000} <= set(b)


def brute(rows, run_bytes=chunking.RUN):
    placed, runs_of = {}, {}
    for doc_id, text in rows:
        data, at = (text or "").encode(), 0
        for end in chunking.chunk_ends(np.frombuffer(data, np.uint8)):
            placed.setdefault(data[at:end], []).append((doc_id, at))
            at = end
    out = {}
    for doc_id, text in rows:
        data, at, marks = (text or "").encode(), 0, []
        for end in chunking.chunk_ends(np.frombuffer(data, np.uint8)):
            where = placed[data[at:end]]
            if len(where) > 1:
                marks.append({"a": at, "b": end, "gone": (doc_id, at) != min(where)})
            at = end
        found = chunking.passages(marks, len(data), run_bytes)
        gone = [m for m in found if m["gone"]]
        keep = bytearray()
        for i, byte in enumerate(data):
            if not any(m["a"] <= i < m["b"] for m in gone):
                keep.append(byte)
        out[doc_id] = (len(data), len(found), len(gone), sum(m["b"] - m["a"] for m in gone), keep.decode())
    return out


def test_matches_brute_force(spark, awkward):
    passage = random_text(80, 3)
    rows = [(i, random_text(150, 10 + i)) for i in range(8)]
    rows += [(20 + i, random_text(60, 40 + i) + " " + passage + " " + random_text(60, 60 + i)) for i in range(6)]
    rows += [(40, rows[0][1]), (41, rows[0][1]), (42, None), (43, ""), (44, "same same " * 900), (45, "tiny"), (46, "tiny")]
    got = {r.doc_id: tuple(r)[1:] for r in chunking.dedup_chunks(awkward(rows)).collect()}
    assert got == brute(rows)
    assert all(got[i][1] == 0 for i in range(1, 8)) and all(got[20 + i][2] > 0 for i in range(1, 6))
    assert got[41][4] == "" and got[0][4] == rows[0][1] and got[46][4] == ""


def test_every_repeated_chunk_goes_without_a_least_run(awkward):
    line = random_text(20, 4)
    rows = [(i, random_text(80, 110 + i) + " " + line + " " + random_text(80, 130 + i)) for i in range(12)] + [(20, "é" * 2000), (21, "x" + "é" * 2000)]
    got = {r.doc_id: tuple(r)[1:] for r in chunking.dedup_chunks(awkward(rows), run_bytes=0).collect()}
    assert got == brute(rows, 0)
    assert sum(v[2] > 0 for v in got.values()) > 6


def test_common_bytes_are_found_as_by_comparing_all(spark):
    """Each chunk lies in RUN common bytes just where such bytes around it occur at another place."""
    rnd = np.random.default_rng(11)
    words = [random_text(1, 200 + i) + "xyz" for i in range(40)]
    texts = [" ".join(rnd.choice(words, 25)) for _ in range(60)]
    texts += [" ".join(rnd.choice(words, 8)) + texts[i][k:k + 90 + i] + " ".join(rnd.choice(words, 8)) for i, k in enumerate(rnd.integers(0, 40, 20))]
    run, marks = chunking.RUN, []
    for row, text in enumerate(texts):
        data, starts = text.encode(), [0, *chunking.chunk_ends(np.frombuffer(text.encode(), np.uint8))]
        marks += [(row, a, b, data) for a, b in zip(starts, starts[1:])]
    held, expected = {}, set()
    for row, a, b, data in marks:
        for at in range(max(0, b - run), min(a, len(data) - run) + 1):
            held.setdefault(data[at:at + run], set()).add((row, at))
    for row, a, b, data in marks:
        if any(len(held[data[at:at + run]]) > 1 for at in range(max(0, b - run), min(a, len(data) - run) + 1)):
            expected.add((row, a))
    expected = {x for x in expected if x[0] % 3}
    lists = {}
    for row, a, b, _ in marks:
        lists.setdefault(row, []).append((a, b, row % 3 > 0))
    frame = spark.createDataFrame(list(enumerate(texts)), "row long, text string")
    given = spark.createDataFrame(list(lists.items()), "row long, marks array<struct<a:int,b:int,asks:boolean>>")
    got = {tuple(r) for r in chunking._common_chunks(frame, given, run).collect()}
    assert got == expected and 0 < len(got) < len(marks) / 2


def test_repeated_rows_null_ids_and_empty_tables(awkward):
    text = random_text(200, 5)
    rows = chunking.dedup_chunks(awkward([(None, text), (1, text), (1, text), (None, None)])).collect()
    assert sorted((r.doc_id or 0, r.removed_bytes) for r in rows) == [(0, 0), (0, 0), (1, len(text.encode())), (1, len(text.encode()))]
    assert chunking.dedup_chunks(awkward([])).count() == 0


def test_planted_passages_of_51_short_words_are_found(awkward):
    rnd = np.random.default_rng(7)
    words = ["".join(rnd.choice(list("abcdefghijklmnopqrstuvwxyz"), rnd.integers(2, 7))) for _ in range(3000)]
    rows, pairs = [], 400
    for i in range(pairs):
        passage = rnd.choice(words, 51)
        rows += [(2 * i + k, " ".join([*rnd.choice(words, 60), *passage, *rnd.choice(words, 60)])) for k in (0, 1)]
    line = " ".join(words[:9])  # a shared line of its own stays
    rows += [(1000 + i, " ".join([*rnd.choice(words, 60), line, *rnd.choice(words, 60)])) for i in range(30)]
    removed = {r.doc_id: r.removed_bytes for r in chunking.dedup_chunks(awkward(rows)).collect()}
    missed = sum(removed[2 * i + 1] == 0 for i in range(pairs))
    assert len(line) < chunking.RUN and missed == 0
    assert sum(v for i, v in removed.items() if i % 2 == 0 or i >= 1000) == 0


def test_a_piece_of_a_longer_passage_is_found(awkward):
    long = random_text(100, 70).encode()
    ends = chunking.chunk_ends(np.frombuffer(long, np.uint8))
    # from inside one chunk to inside another: whole chunks between make less than RUN, all bytes more
    first, last = next((i, j) for i in range(2, len(ends)) for j in range(i + 1, len(ends) - 1)
                       if ends[j] - ends[i] < chunking.RUN <= ends[j + 1] - ends[i - 1] - 2)
    piece = long[ends[first - 1] + 1:ends[last + 1] - 1].decode("utf-8", "ignore")
    rows = [(i, random_text(60, 80 + i) + " " + long.decode() + " " + random_text(60, 90 + i)) for i in (1, 2)]
    rows += [(3, "Z" * 40 + piece + "Q" * 40)]
    removed = {r.doc_id: r.removed_bytes for r in chunking.dedup_chunks(awkward(rows)).collect()}
    assert removed[1] == 0 and removed[2] > 0 and removed[3] > 0


def test_runs_of_a_batch_are_those_of_each_text():
    rnd = random.Random(12)
    texts = []
    for row in range(200):
        ends = sorted(rnd.sample(range(1, 400), rnd.randrange(1, 24)))
        marks = [{"a": a, "b": b, "gone": rnd.random() < 0.7, "common": rnd.random() < 0.1, "high": a, "low": -b}
                 for a, b in zip([0, *ends], ends) if rnd.random() < 0.7]
        rnd.shuffle(marks)
        texts.append({"row": row, "marks": marks, "size": ends[-1]})
    kind = pa.struct([("a", pa.int32()), ("b", pa.int32()), ("gone", pa.bool_()), ("common", pa.bool_()), ("high", pa.int64()), ("low", pa.int64())])
    schema = pa.schema([("row", pa.int64()), ("marks", pa.list_(kind)), ("size", pa.int32())])
    batch = pa.RecordBatch.from_pylist(texts, schema)
    for some in (batch, batch.slice(30, 40), batch.slice(0, 0)):
        got = [r for b in chunking._long_runs(96)(iter([some])) for r in b.to_pylist()]
        short = [r for b in chunking._short_runs(96)(iter([some])) for r in b.to_pylist()]
        want, want_short = [], []
        for t in some.to_pylist():
            found = chunking.passages(t["marks"], t["size"], 96)
            gone = [m for m in found if m["gone"]]
            want.append({"row": t["row"], "n_repeated": len(found), "n_removed": len(gone), "removed_bytes": sum(m["b"] - m["a"] for m in gone),
                         "spans": [{"a": m["a"], "b": m["b"]} for m in gone]})
            kept = {m["a"] for m in chunking.passages([m | {"common": False} for m in t["marks"]], t["size"], 96)}
            want_short += [{"row": t["row"], **{c: m[c] for c in ("a", "high", "low")}} for m in sorted(t["marks"], key=lambda m: m["a"]) if m["a"] not in kept]
        assert got == want
        assert short == want_short


def test_chunk_digests_are_those_of_the_library(spark):
    rows = spark.createDataFrame([(1, 5, "first text of some chunks, " * 20), (None, 6, "é日🙂 " * 50), (3, 7, "")], "doc_id long, row long, text string")
    got = sorted((r.row, r.a, r.b, r.high, r.low, r.doc_id, r.size) for r in chunking.chunks(rows).collect())
    want = []
    for doc_id, row, text in rows.collect():
        data, at = text.encode(), 0
        for end in chunking.chunk_ends(np.frombuffer(data, np.uint8)):
            digest = xxhash.xxh3_128_intdigest(data[at:end])
            want.append((row, at, end, (digest >> 64) - (1 << 63), (digest & (1 << 64) - 1) - (1 << 63), doc_id, len(data)))
            at = end
    assert got == sorted(want)
