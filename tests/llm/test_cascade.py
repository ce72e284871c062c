import re
from collections import Counter

import duckdb
from pyspark.sql import functions as F

from orbitcart.llm import cascade

TEXTS = ["", None, " \n\t", "one", "one two", "a b c a b c", "a a a a", "x " * 60, "\n".join(["same line here"] * 5 + ["other", "", " "]),
         " ".join(f"w{i}" for i in range(80)), "# $ % & | < > *" * 9, "ALL CAPS " * 40, "no wordsep\xa0here " * 30, "tab\tvt\x0bff\x0ccr\rlf\nend",
         " ".join(["long"] * 30_000), "🙂 é ñ " * 20, "1 2 3 4 5 6 7 " * 20, "a b c d a b c", "\x85odd\x1cspace " * 4]


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0d]+", text)
    windows = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0d]", x)]
    return (len(words), len(lines), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


def test_statistics_match_brute_force(awkward):
    rows = list(enumerate(TEXTS)) + [(None, "null id"), (3, "again again")]
    got = cascade.statistics(awkward(rows)).drop("text").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr((i, *brute(t))) for i, t in rows)


def test_verdict_does_not_depend_on_the_order(awkward):
    docs = awkward([(i, t) for i, t in enumerate(TEXTS)] + [(100 + i, " ".join(f"word{i}x{j}" for j in range(70))) for i in range(5)])
    stats = cascade.statistics(docs)
    rules = cascade.quality_rules()
    judged = {r.doc_id: r for r in cascade.judge(docs).collect()}
    turned = {r.doc_id: r for r in cascade.judge(docs, dict(reversed(rules.items()))).collect()}
    every = {r.doc_id: r for r in stats.select("doc_id", *[F.coalesce(v, F.lit(False)).alias(k) for k, v in rules.items()]).collect()}
    for i, row in judged.items():
        n, *_, repeats = brute(dict(enumerate(TEXTS)).get(i, None)) if i < 100 else (70, 0)
        assert row.kept == turned[i].kept == (row.rejected_by is None)
        assert row.base_failed == (n < 50 or 100 * repeats > 50 * n)
        assert row.kept == (not row.base_failed and not any(every[i][k] for k in rules))
    assert all(judged[100 + i].kept for i in range(5))


def test_rules_are_ordered_by_rejection_per_cost(spark, awkward):
    stats = cascade.statistics(awkward([(i, "# " * 60 if i % 2 else f"plain text {i}") for i in range(40)]))
    ordered = cascade.order_rules(stats, cascade.quality_rules())
    gains = [share / cost for _, cost, share in ordered]
    assert gains == sorted(gains, reverse=True) and {n for n, _, s in ordered if s > 0} >= {"symbols"}
    assert cascade.judge(awkward([])).count() == 0


def test_no_python_in_the_plan(awkward):
    plan = cascade.judge(awkward([(1, "text")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_sql_agrees_on_awkward_rows(spark, awkward):
    from orbitcart.llm import queries
    rows = [(i, t) for i, t in enumerate(TEXTS)]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    found = con.execute(queries.ORACLE_SQL["op7_rule_cascade"])
    names = [d[0] for d in found.description]
    expected = sorted(found.fetchall())
    assert sorted(tuple(r) for r in cascade.judge(awkward(rows)).select(*names).collect()) == expected
