"""Text quality rules as a short-circuit cascade (operator 7), in DataFrame functions only.

Text statistics are computed once per document. Each rule is a predicate on them or on the
text; a bounded random sample gives every rule's cost (seconds per document, each rule timed
alone) and selectivity (share rejected). Rules run in the order of rejection per cost, and a
document that one rule rejects is not tried by the next (CASE evaluates lazily). The order
changes the time only: a document is kept when no rule rejects it.

Three-word windows are compared by 64-bit hashes within one text.

Defined cases: a null text has no words (all counts 0, base_failed); empty texts likewise;
repeated rows are judged each; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbitcart.llm.common import WORD_SPACE, cut, only, text_or_empty

#: Documents in the sample that orders the rules.
SAMPLE_ROWS = 2000

# Symbol characters, thresholds of the base rules.
SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 50, 50, 3


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once per row."""
    return F.element_at(F.transform(F.array(value), use), 1)


def count_of(text: Column, characters: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, characters, ""))).cast("long")


def words_of(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(WORD_SPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[\\x20\\x09-\\x0D]+"))


def repeated_words(words: Column) -> Column:
    """Words that lie in a window of three words found twice or more."""
    def starts(windows: Column) -> Column:
        def twin(x: Column, k: Column) -> Column:
            return x["h"].eqNullSafe(F.get(windows, k - 1)["h"]) | x["h"].eqNullSafe(F.get(windows, k + 1)["h"])
        return F.sort_array(F.transform(F.filter(windows, twin), lambda x: x["i"]))

    def covered(acc: Column, at: Column) -> Column:
        return F.struct((acc["n"] + F.least(F.lit(WINDOW), at - acc["last"])).cast("long").alias("n"), at.alias("last"))

    windows = F.transform(F.sequence(F.lit(0), F.size(words) - WINDOW),
                          lambda i: F.struct(F.xxhash64(*(F.get(words, i + k) for k in range(WINDOW))).alias("h"), i.alias("i")))
    total = F.aggregate(let(F.sort_array(windows), starts),
                        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last")), covered)["n"]
    return F.when(F.size(words) < WINDOW, F.lit(0).cast("long")).otherwise(total)


def statistics(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text and the text statistics that the rules use."""
    rows = only(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), text_or_empty().alias("text"))
    lines = F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(WORD_SPACE)) != "")
    rows = rows.withColumns({"words": words_of(F.col("text")), "lines": lines})
    return rows.select(
        "doc_id", "text", F.size("words").cast("long").alias("n_words"), F.size("lines").cast("long").alias("n_lines"),
        F.length(F.translate("text", WORD_SPACE, "")).cast("long").alias("word_chars"),
        count_of(F.col("text"), SYMBOLS).alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def quality_rules() -> dict[str, Column]:
    """The rules by name; a rule is true for documents it rejects."""
    text, words = F.col("text"), F.col("n_words")
    # Thresholds of the rules.
    return {
        "symbols": 10 * F.col("n_symbols") > words,
        "repeated_lines": 10 * F.col("n_dup_lines") > 3 * F.col("n_lines"),
        "word_length": (F.col("word_chars") < 3 * words) | (F.col("word_chars") > 12 * words),
        "capitals": 2 * count_of(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ") > F.col("word_chars"),
        "exclamations": 2 * count_of(text, "!?") > words,
        "digits": 2 * count_of(text, "0123456789") > F.col("word_chars"),
        "no_letters": ~text.rlike("\\p{L}"),
    }


def order_rules(stats: DataFrame, rules: dict[str, Column]) -> list[tuple[str, float, float]]:
    """(rule, seconds per document, share rejected) by rejection per cost, from a sample's statistics."""
    stats = cut(stats)
    shares = stats.agg(F.count("*").alias("n"), *[F.avg(F.coalesce(r, F.lit(False)).cast("int")).alias(k) for k, r in rules.items()]).first()
    found = []
    for name, rule in rules.items():
        began = time.perf_counter()
        stats.agg(F.count_if(rule)).first()
        cost = (time.perf_counter() - began) / max(1, shares["n"])
        found.append((name, cost, shares[name] or 0.0))
    return sorted(found, key=lambda x: -x[2] / x[1])


def judge(docs: DataFrame, rules: dict[str, Column] | None = None, *, id_col: str = "doc_id", text_col: str = "text",
          sample_rows: int = SAMPLE_ROWS, seed: int = 7) -> DataFrame:
    """Each row's statistics with base_failed, rejected_by (first rule that rejects, else null) and kept."""
    rules = quality_rules() if rules is None else rules
    total = docs.count()
    sample = docs.sample(min(1.0, sample_rows / max(1, total)), seed)  # drawn before anything is computed
    cascade = F.when(base_failed(), "base")
    for name, _, _ in order_rules(statistics(sample, id_col=id_col, text_col=text_col), rules):
        cascade = cascade.when(rules[name], name)
    stats = statistics(docs, id_col=id_col, text_col=text_col)
    return (stats.withColumn("base_failed", base_failed()).withColumn("rejected_by", cascade)
            .withColumn("kept", F.col("rejected_by").isNull()))
