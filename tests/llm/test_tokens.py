import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from orbitcart.llm import bpe, common, orc_tokens, pieces, queries

SMOKE_DIR = "/root/testdata/sf0.001"

ODD = ["", " ", "\n", "a", " a", "a ", "a  b", "a\n\nb", "a \nb", "a\n b", "a\t \tb", "\tx", "x y", "it's we'LL they're 'd", "a<|endoftext|>b",
       "<|endoftext|>", " <|endoftext|> x <|endoftext|>", "naïve café éèç", "日本語 テキスト", "🙂🙂 emoji👩‍👩‍👧", "՘࢏ new letters \U000105c0", "x\x1cy\x85z",
       "1234567 89,0.5%", "word.\nNext, word; end!", "a" * 5000, "ab " * 3000, "ßäöü.\nÄ", "tab\tend\r\nline\x0b\x0c", " sep　wide", "'", "é'"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(queries.tokenizer_path())


def random_texts(n, seed=4):
    rnd = random.Random(seed)
    symbols = list("abc ABC\n\t .,'!?19é日🙂") + ["<|endoftext|>", "  ", "\n\n", " "]
    return ["".join(rnd.choice(symbols) for _ in range(rnd.randrange(60))) for _ in range(n)]


def test_encoders_equal_the_library(library):
    coder, fast = bpe.coder(queries.tokenizer_path()), orc_tokens._library(queries.tokenizer_path())
    texts, limit = ODD + random_texts(1500), 2000  # a tight cache: its halves are dropped again and again
    for size in (1, 400):
        caches = pieces.Generations(limit), pieces.Generations(limit)
        batches = [texts[at:at + size] for at in range(0, len(texts), size)]
        assert [x for b in batches for x in coder.encode_batch(b, caches[0])] == [x for b in batches for x in fast.encode_batch(b, caches[1])]
        assert all(c.used <= limit for c in caches)
    for text, coded in zip(texts, coder.encode_batch(texts, pieces.Generations())):
        ids = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(coded, "<u4").tolist() == ids, repr(text)
        assert coder.decode(np.frombuffer(coded, "<u4")) == library.decode(ids, skip_special_tokens=False), repr(text)
        assert fast.encode_batch([text], pieces.Generations()) == [coded], repr(text)


def plain_merge(symbols, pairs):
    symbols = list(symbols)
    while True:
        found = [(pairs[p][0], i) for i, p in enumerate(zip(symbols, symbols[1:])) if p in pairs]
        if not found:
            return symbols
        _, i = min(found)
        symbols[i:i + 2] = [pairs[symbols[i], symbols[i + 1]][1]]


def test_segment_tree_merges_like_the_definition():
    rnd = random.Random(6)
    for _ in range(300):
        pairs, names = {}, list(range(4))
        for rank in range(rnd.randrange(12)):
            names.append(100 + rank)
            pairs.setdefault((rnd.choice(names), rnd.choice(names)), (rank, 100 + rank))
        symbols = [rnd.randrange(4) for _ in range(rnd.randrange(40))]
        assert bpe.merge(symbols, pairs) == plain_merge(symbols, pairs)


def test_matrix_of_trees_merges_like_the_definition():
    rnd = random.Random(8)
    for levels in (1, 2, 3, 5):
        pairs, names = {}, list(range(4))
        for rank in range(14):
            names.append(100 + rank)
            pairs.setdefault((rnd.choice(names), rnd.choice(names)), (rank, 100 + rank))
        rows = [[rnd.randrange(4) for _ in range(rnd.randint(1, 2 ** levels + 1))] for _ in range(400)]
        symbols = np.array([r + [0] * (2 ** levels + 1 - len(r)) for r in rows])
        alive = bpe.merge_many(symbols, np.array([len(r) for r in rows]), bpe.PairTable(pairs))
        assert [s[a].tolist() for s, a in zip(symbols, alive)] == [plain_merge(r, pairs) for r in rows]


def test_invalid_utf8_is_replaced_as_the_library_does(library):
    coder = bpe.coder(queries.tokenizer_path())
    ids = library.encode("é日🙂", add_special_tokens=False).ids
    for cut in range(len(ids)):
        assert coder.decode(np.array(ids[cut:])) == library.decode(ids[cut:], skip_special_tokens=False)


def test_bpe_query_on_awkward_rows(spark, awkward, library):
    rows = list(enumerate(ODD)) + [(None, "no id"), (3, "again"), (900, None)]
    path = queries.tokenizer_path()
    got = bpe.digests(awkward(rows), path).collect()
    expected = []
    for i, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        expected.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, expected))
    assert bpe.encode(awkward([]), path).count() == 0


def test_orc_round_trip(spark, awkward, library):
    rows = [(i * 3, t) for i, t in enumerate(ODD)] + [(6, "twice"), (None, "no id"), (-5, None)]
    path = common.scratch(spark, "orc-test")
    orc_tokens.write_tokens(awkward(rows), path, queries.tokenizer_path())
    got = orc_tokens.read_tokens(spark, path).collect()
    texts = {}
    for i, t in rows:
        texts.setdefault(i, []).append([*library.encode(t or "", add_special_tokens=False).ids, 0])
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at and r["n_tokens"] == len(r["ids"]) and r["ids"] in texts[r["doc_id"]]
        at += r["n_tokens"]
    order = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert order == [None, *sorted(i for i, _ in rows if i is not None)]
    assert [r["ids"] for r in orc_tokens.lookup(spark, path, [9]).collect()] == texts[9]


def test_orc_digests_and_empty_table(spark, awkward, library):
    docs = spark.read.parquet(f"{SMOKE_DIR}/documents.parquet").orderBy("doc_id").collect()
    got = {r.doc_id: r for r in queries.op4_orc_token_ids(spark, SMOKE_DIR).collect()}
    at = 0
    for d in docs:
        ids = np.array([*library.encode(d.text or "", add_special_tokens=False).ids, 0], "<u4")
        assert tuple(got[d.doc_id])[1:] == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    path = common.scratch(spark, "orc-empty")
    orc_tokens.write_tokens(awkward([]), path, queries.tokenizer_path())
    assert orc_tokens.read_tokens(spark, path).count() == 0


def test_orc_files_hold_bloom_filters_and_ranges(spark, awkward):
    import glob
    path = common.scratch(spark, "orc-bloom")
    orc_tokens.write_tokens(awkward([(i, f"text {i}") for i in range(500)]), path, queries.tokenizer_path())
    files = glob.glob(path.removeprefix("file:") + "/*.orc")
    assert files and any(b"zstd" in open(f, "rb").read() or "zstd" in f for f in files)
    plan = orc_tokens.lookup(spark, path, [3, 7])._jdf.queryExecution().toString()
    assert "PushedFilters: [In(doc_id, [3,7])]" in plan


def test_words_are_encoded_once_whatever_marks_or_white_space_follow(library):
    fast, cache, sent = orc_tokens._Library(queries.tokenizer_path()), pieces.Generations(), []

    class Spy:
        def encode_batch_fast(self, texts, add_special_tokens):
            sent.extend(texts)
            return library.encode_batch_fast(texts, add_special_tokens=add_special_tokens)

    fast.library = Spy()
    texts = ["x sevenfold. sevenfold, sevenfold!! sevenfold sevenfold;", "x  twofold sevenfold\n\n\ttwofold twofold "] * 50
    texts += ["it's. <|endoftext|>. 7, é! ʞ. 日. a'. \n. .. b\".", "&& a&&b.. <|endoftext|", " .a. 's. ²! ½; ª,"]
    for batch in (texts, texts[::-1]):
        assert [np.frombuffer(x, "<u4").tolist() for x in fast.encode_batch(batch, cache)] == [library.encode(t, add_special_tokens=False).ids for t in batch]
    assert "".join(sent).count("sevenfold") == 1 and "".join(sent).count("twofold") <= 3


def test_batches_are_halved_to_their_bytes():
    batch = pa.RecordBatch.from_pydict({"text": ["a" * 100] * 7 + ["b" * 5000] + ["c"] * 9})
    parts = list(common.bounded(iter([batch]), 600))
    assert pa.Table.from_batches(parts).to_pylist() == batch.to_pylist()
    assert all(p.num_rows == 1 or p.nbytes <= 600 for p in parts)
