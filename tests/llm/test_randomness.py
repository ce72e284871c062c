import hashlib
import math
import random
import re
import string

import numpy as np
from pyspark.sql import functions as F

from orbitcart.llm import queries, randomness

SMOKE_DIR = "/root/testdata/sf0.001"
PATTERNS = [("assign", re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[1]) >= 8),
            ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16), ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 32)]


def base(text):
    return sorted((m.start(), k, m.end()) for k, (_, rx, ok) in enumerate(PATTERNS) for m in rx.finditer(text or "") if ok(m))


def listed(spans):
    return ",".join(f"{randomness.KINDS[k]}:{a}:{b}" for a, k, b in spans)


def key(n, seed, alphabet=string.ascii_letters + string.digits + "+/"):
    return "".join(random.Random(seed).choices(alphabet, k=n))


def texts():
    rnd = random.Random(1)
    parts = ["password", "PassWd", "secret", "token", "api_key", "APIKEY", "api-key", ": ", " = ", "='", '":"', "abcdefgh", "abcdefg", "x/y+z_.=-12", "AKIA",
             "AKIAABCDEFGHIJKL", "AKIAABCDEFGHIJK", "0123456789abcdef", "0123456789abcdef0123456789abcdef", "é", "🙂", "\n", " ", "  ", "word", "'", '"']
    out = ["".join(rnd.choice(parts) for _ in range(rnd.randrange(1, 25))) for _ in range(400)]
    return out + ["", None, "password: token: abcdefgh12", "token=secret=abcdefghij", "🙂 secret = '🙂' secret='abcdefgh🙂'", "a" * 100_000,
                  "password=abcdefgh " * 800, " é".join(f"{i:032x}" for i in range(3000)), "token=abcdefgh1 " * 256 + "y" * 30, "ſecret=abcdefgh1 toKen=abcdefgh1"]


def test_base_spans_match_brute_force(awkward):
    rows = list(enumerate(texts())) + [(None, "token=abcdefgh"), (3, "token=abcdefgh")]
    got = randomness.find_secrets(awkward(rows)).collect()
    expected = []
    for i, t in rows:
        found = base(t)
        expected.append((i, *[sum(k == j for _, k, _ in found) for j in range(3)], hashlib.sha256(listed(found).encode()).hexdigest()))
    assert sorted(repr(tuple(r)[:5]) for r in got) == sorted(map(repr, expected))
    assert randomness.find_secrets(awkward([])).count() == 0


def plain_battery(run):
    """The tests by numpy and the error function."""
    for pattern, symbols in randomness.ALPHABETS:
        if re.match(pattern, run):
            break
    else:
        symbols = randomness.BASE64
    k, n, v = len(symbols), len(run), np.array([symbols.index(c) for c in run], float)
    chi = k / n * (np.unique(v, return_counts=True)[1].astype(float) ** 2).sum() - n
    z = ((chi / (k - 1)) ** (1 / 3) - (1 - 2 / (9 * (k - 1)))) / math.sqrt(2 / (9 * (k - 1)))
    tail = lambda x: math.erfc(abs(x) / math.sqrt(2))
    high, w = v > (k - 1) / 2, v - (k - 1) / 2
    runs = ((high[1:] != high[:-1]).sum() - (n - 1) / 2) / math.sqrt((n - 1) / 4)
    serial = (w[1:] * w[:-1]).sum() / ((k * k - 1) / 12) / math.sqrt(n - 1)
    return min(1.0, 3 * min(tail(z) / 2 if z > 0 else 1.0, tail(runs), tail(serial)))


def test_battery_matches_plain_computation(spark):
    runs = [key(n, n) for n in (20, 33, 64, 200)] + [key(40, 7, "0123456789abcdef"), key(40, 8, "0123456789ABCDEF"), key(32, 9, "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
            "internationalisation", "ABABABABABABABABABABABAB", "some-long-kebab-case-identifier", "A" * 25, "x" * 3000]
    frame = spark.createDataFrame([(r,) for r in runs], "run string")
    for row in frame.select("run", randomness.uniformity(F.col("run")).alias("p")).collect():
        assert abs(row.p - plain_battery(row.run)) < 1e-5, row.run


def prose(n, seed):
    rnd = random.Random(seed)
    return " ".join("".join(rnd.choices("etaoinshrdlucm", k=rnd.randrange(2, 10))) for _ in range(n))


def test_planted_keys_are_found_and_words_are_not(awkward):
    planted = {i: key(40, i) for i in range(30)} | {50 + i: key(36, 90 + i, string.ascii_uppercase + "234567") for i in range(5)}
    rows = [(i, f"{prose(30, i)} {planted.get(i, 'counterrevolutionaries')} {prose(20, i + 500)} some-long-kebab-case-identifier") for i in range(120)]
    got = {r.doc_id: r.spans for r in randomness.find_secrets(awkward(rows)).collect()}
    found = {i for i, s in got.items() if "random" in s}
    assert found <= set(planted) and len(found) >= 0.9 * len(planted)
    for i in found:
        a, b = map(int, re.search(r"random:(\d+):(\d+)", got[i]).groups())
        assert rows[i][1][a:b] == planted[i]


def test_masking(awkward):
    rows = [(1, "x password = 'abcdefgh1' y"), (2, None), (3, "clean text"), (4, "token=0123456789abcdef0123456789abcdef and AKIAABCDEFGHIJKLMN."), (4, "clean")]
    docs = awkward(rows)
    masked = randomness.mask_secrets(docs)
    assert masked.columns == docs.columns
    assert sorted((r.doc_id, r.text or "") for r in masked.collect()) == [
        (1, "x [secret]' y"), (2, ""), (3, "clean text"), (4, "[secret] and [secret]."), (4, "clean")]
    assert masked.filter("text IS NULL").count() == 1
    assert randomness.mask_secrets(awkward([])).count() == 0


def test_query_is_native_and_complete(spark):
    docs = spark.read.parquet(f"{SMOKE_DIR}/documents.parquet")
    out = queries.op10_randomness_secrets(spark, SMOKE_DIR)
    expected = {r.doc_id: hashlib.sha256(listed(base(r.text)).encode()).hexdigest() for r in docs.collect()}
    assert {r.doc_id: r.base_sha256 for r in out.collect()} == expected
    plan = randomness.scan(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
