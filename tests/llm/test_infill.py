import hashlib
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from orbitcart.llm import infill
from orbitcart.llm.wavelet import WaveletMatrix

TOKEN = re.compile("[A-Za-z]+|[^A-Za-z]")


def expected(i, text):
    text = text or ""
    tokens = TOKEN.findall(text)
    digest = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h = [int(digest[8 * k:8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(tokens) + 1), h[1] % (len(tokens) + 1)))
    prefix, middle, suffix = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return i, len(tokens), "plain", None, None, text
    if h[3] % 100 < 20:
        return i, len(tokens), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return i, len(tokens), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


@given(st.lists(st.integers(0, 3), max_size=300))
@settings(max_examples=60, deadline=None)
def test_ranks(codes):
    array = np.array(codes, np.uint8)
    matrix, at = WaveletMatrix(array), np.arange(len(codes) + 1)
    for code in range(4):
        assert list(matrix.rank(code, at)) == [codes[:i].count(code) for i in at]


@given(st.lists(st.text(alphabet="aZ é9\n𝒳<", max_size=30), min_size=1, max_size=8), st.data())
@settings(max_examples=60, deadline=None)
def test_cuts_of_a_block(texts, data):
    draws = [np.array([data.draw(st.integers(0, 2**32 - 1)) for _ in texts]) for _ in range(2)]
    n, first, second = infill._block(texts, *draws)
    for i, text in enumerate(texts):
        tokens = TOKEN.findall(text)
        a, b = sorted(int(d[i]) % (len(tokens) + 1) for d in draws)
        assert (n[i], first[i], second[i]) == (len(tokens), len("".join(tokens[:a])), len("".join(tokens[:b])))


def test_texts_and_restoring(awkward):
    texts = [None, "", " ", "a", "Ab c", "naïve 𝒳 text", "x<P>y", "<S>", "a<M>b<P>", "< P><S", "<<P", "line\nline\r\n\n", "1234", "é" * 50,
             "word, " * 300]
    docs = [(i, texts[i % len(texts)]) for i in range(300)] + [(None, "null id text"), (4, "Ab c"), (4, "Ab c"), (999, "long words " * 200_000)]
    made = infill.fill_in_middle(awkward(docs))
    assert made.columns == ["doc_id", "text", "n", "form", "prefix_chars", "middle_chars", "output"]
    rows = made.withColumn("again", infill.restore(F.col("output"), F.col("form"))).collect()
    assert sorted((tuple(r[c] for c in ("doc_id", "n", "form", "prefix_chars", "middle_chars", "output")) for r in rows), key=repr) == sorted(
        (expected(*d) for d in docs), key=repr)
    assert all(r.again == r.text for r in rows)
    assert {r.form for r in rows} == {"plain", "psm", "spm"}


def test_empty_table(awkward):
    assert infill.fill_in_middle(awkward([]).limit(0)).collect() == []


def test_rates_and_seed(awkward):
    docs = [(i, "some text of words") for i in range(400)]
    none_plain = infill.fill_in_middle(awkward(docs), plain_percent=0, spm_percent=100, seed=5)
    assert {r.form for r in none_plain.collect()} == {"spm"}
    assert {r.form for r in infill.fill_in_middle(awkward(docs), plain_percent=100).collect()} == {"plain"}
