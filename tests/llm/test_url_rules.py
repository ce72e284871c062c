import itertools
import random

import pytest
from pyspark.sql import functions as F

from orbitcart.llm import url_rules

SCHEMA = "page_id long, url string, html string, host string, tokens string, label string, row string, rule string"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, "h", "host", "t", "l", "r", "x") for i, u in rows], SCHEMA)


def verdicts(df):
    return {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in df.collect()}


def test_parts_and_stated_rules(spark):
    rows = [(0, None), (1, ""), (2, "no scheme.com/en/"), (3, "HTTP://A.B.COM/en/1?x#y"), (4, "https://example.com/en/5"),
            (5, "https://WWW.example.com/en/5"), (6, "https://m.www.example.com/en/"), (7, "http://x.net/es/"), (8, "http://x.net/fr"),
            (9, "http://notexample.com/en/"), (10, "http://example.com"), (11, "http://example.com?q=/en/"), (12, "http://example.com#/en/"),
            (13, "a://b://example.com/en/"), (14, "http://ÄB.com/É"), (15, "http://com/"), (16, "://"), (17, "http://xnet/es/")]
    got = verdicts(url_rules.filter_urls(pages(spark, rows)))
    assert [got[i][:3] for i in range(18)] == [
        ("", "", None), ("", "", None), ("", "", None), ("a.b.com", "/en/1", "com/"), ("example.com", "/en/5", "example.com/en/"),
        ("www.example.com", "/en/5", "www.example.com/en/"), ("m.www.example.com", "/en/", "www.example.com/en/"), ("x.net", "/es/", "net/es/"),
        ("x.net", "/fr", None), ("notexample.com", "/en/", "com/"), ("example.com", "", None), ("example.com", "", None),
        ("example.com", "", None), ("b:", "//example.com/en/", None), ("Äb.com", "/É", "com/"), ("com", "/", "com/"), ("", "", None), ("xnet", "/es/", None)]
    assert [got[i][3] for i in (0, 1, 2, 3, 4, 5, 6, 7, 9, 15, 16)] == ["allow"] * 4 + ["block", "allow", "allow", "block", "allow", "allow", "allow"]


def brute_force_rules(sets, min_support, min_confidence):
    """{(label, tokens): (support, confidence)} of all token combinations, from [(tokens, label)]."""
    counts = {}
    for tokens, label in sets:
        for k in range(1, len(tokens) + 1):
            for combination in itertools.combinations(sorted(tokens), k):
                counts.setdefault(combination, {}).setdefault(label, 0)
                counts[combination][label] += 1
    return {(label, c): (n, n / sum(by.values())) for c, by in counts.items() for label, n in by.items()
            if n >= min_support * len(sets) and n / sum(by.values()) >= min_confidence}


def best_of(tokens, rules):
    fitting = [(confidence, support, label == "block", label) for (label, c), (support, confidence) in rules.items() if set(c) <= set(tokens)]
    return max(fitting)[3] if fitting else None


@pytest.mark.parametrize("broadcast_rules", [url_rules.BROADCAST_RULES, 0])
def test_mined_rules_decide_as_all_combinations_do(spark, broadcast_rules):
    rng = random.Random(5)
    urls = {f"u{i}": frozenset(rng.sample("abcdefg", rng.randint(1, 5))) for i in range(150)}
    label = {u: "block" if "a" in t and "b" in t or rng.random() < 0.2 else "allow" for u, t in urls.items()}
    rows = [(u, sorted(t), label[u]) for u, t in urls.items()]
    labelled = spark.createDataFrame(rows + rows[:40] * 3, "url string, tokens array<string>, label string")  # repeats count once
    mined = url_rules.mine(labelled, min_support=0.03, min_confidence=0.6)
    rules = brute_force_rules([(t, label[u]) for u, t in urls.items()], 0.03, 0.6)
    for r in mined.collect():
        assert rules[(r.label, tuple(r.tokens))] == (r.support, pytest.approx(r.confidence))
    asked = [(i, sorted(rng.sample("abcdefgh", rng.randint(1, 6)))) for i in range(200)]
    found = url_rules.best_rules(spark.createDataFrame(asked, "row long, tokens array<string>"), mined, broadcast_rules, 3)
    got = {r.row: r.label for r in found.collect()}
    assert [got.get(i) for i, _ in asked] == [best_of(t, rules) for _, t in asked]


def test_tokens_of_equal_urls_are_one_item_and_long_paths_end(spark):
    deep = "/".join(f"{c}{d}" for c in "abcdefghijklmnop" for d in "xyz")  # 48 tokens in a third of all urls
    rows = [(i, f"http://s{chr(97 + i % 7)}.org/{deep}/{'bad' if i % 2 else 'good'}") for i in range(60)] + [
        (100 + i, f"http://t.org/{'bad' if i % 2 else 'good'}/{i}") for i in range(120)]
    labelled = spark.createDataFrame([(u, "block" if "bad" in u else "allow") for _, u in rows], "url string, label string")
    asked = pages(spark, [(1, "http://q.org/bad"), (2, "http://q.org/good"), (3, "http://q.org/other"), (None, "http://q.org/bad"), (1, "http://q.org/bad")])
    got = url_rules.filter_urls(asked, rules=(), labelled=labelled, min_confidence=0.9)
    assert sorted(((r.page_id or 0), r.verdict) for r in got.collect()) == [(0, "block"), (1, "block"), (1, "block"), (2, "allow"), (3, "allow")]


def test_without_labels_or_rows(spark):
    asked = pages(spark, [(1, "http://a.org/x"), (2, None)])
    assert {r.verdict for r in url_rules.filter_urls(asked).collect()} == {"allow"}
    assert url_rules.filter_urls(asked.limit(0)).collect() == []


def test_fit_is_bounded_and_repeatable(spark):
    urls = spark.range(5000).select(F.concat(F.lit("u"), "id").alias("url"), F.array(F.lit("t")).alias("tokens"), F.lit("block").alias("label"))
    once = {r.url for r in url_rules.training_sets(urls, 500).collect()}
    assert 350 < len(once) < 650
    assert once == {r.url for r in url_rules.training_sets(urls.orderBy(F.desc("url")), 500).collect()}
