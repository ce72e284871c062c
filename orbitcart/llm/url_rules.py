"""URL filter by stated rules and mined association rules (operator 12).

A stated rule names a host and the start of a path; it fits the host and its subdomains, and the
longest that fits decides. The urls it decides are labelled; from them Spark's FP-growth mines
token combinations (``mine``): a url's items are its distinct tokens and its label, and a frequent
itemset with a label, without it, is the antecedent of a rule. Support and confidence prune the
rules, and a rule goes when leaving one of its tokens out gives a rule for the same label with
at least its confidence. Urls without a stated rule get the label of the most confident mined rule
whose tokens they all have (then the greater support, then block), or allow. Rules are found by an
inverted index: each rule lies under its rarest token only, so a url meets the rules of its own tokens, whose
others are then compared.

Bounds. Mining reads at most about ``FIT_URLS`` distinct labelled urls, picked by a hash of the url
(all of them where there are no more), and the ``MOST_ITEMS`` most telling tokens of each, so no long path makes
exponentially many itemsets; tokens found in the same urls count as one item. Neither bound
touches the urls that are judged. The index is broadcast only up to ``BROADCAST_RULES`` counted
rules; beyond it is joined by token, with the urls of a token dealt over ``SALTS`` parts.

Defined cases: null urls and urls without ``://`` have empty host and path, no tokens and the verdict
allow; repeated rows are judged each; null ids stay; an empty table gives no rows; without
labelled urls, or with one label only, no rule is mined; ties among stated rules of one length go to the longer host,
then to block; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbitcart.llm.common import only, saved

Rule = tuple[str, str, str]  # verdict, host, path
ALLOW, BLOCK = "allow", "block"
# The stated rules.
RULES: Sequence[Rule] = ((ALLOW, "com", "/"), (BLOCK, "example.com", "/en/"), (ALLOW, "www.example.com", "/en/"),
                         (BLOCK, "net", "/es/"), (BLOCK, "net", "/fr/"))
MIN_SUPPORT, MIN_CONFIDENCE = 0.01, 0.6
FIT_URLS, MOST_ITEMS = 200_000, 12
BROADCAST_RULES, SALTS = 20_000, 64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LABELS = (ALLOW, BLOCK)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def url_parts(url: Column) -> dict[str, Column]:
    """scheme, host, path and rest (query and fragment) of a url; all empty without ``://``."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    at = F.instr(url, F.lit("://"))
    after = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(after, "^[^/?#]*", 0)
    tail = F.substr(after, F.length(host) + 1)
    path = F.regexp_extract(tail, "^[^?#]*", 0)
    return {"scheme": F.when(at > 0, F.substr(url, F.lit(1), at - 1)).otherwise(""), "host": lower_ascii(host),
            "path": path, "rest": F.substr(tail, F.length(path) + 1)}


def stated_rule(host: Column, path: Column, rules: Sequence[Rule] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest stated rule that fits, null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    best = sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r[0] != BLOCK))
    for label, at, start in reversed(best):  # the outermost condition is the longest rule's
        fits = ((host == at) | F.endswith(host, F.lit("." + at))) & F.startswith(path, F.lit(start))
        rule, verdict = F.when(fits, at + start).otherwise(rule), F.when(fits, label).otherwise(verdict)
    return rule, verdict


def tokens(scheme: Column, host: Column, path: Column, rest: Column) -> Column:
    """Distinct tokens: the scheme, the host's labels and the words of path and query, each with
    its place; runs of digits in words are one sign."""
    def words(text: Column, pattern: str, place: str) -> Column:
        found = F.filter(F.split(F.regexp_replace(lower_ascii(text), "[0-9]+", "0"), pattern), lambda x: x != "")
        return F.transform(found, lambda x: F.concat(F.lit(place), x))

    begin = F.when(scheme == "", F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("scheme:"), lower_ascii(scheme))))
    return F.array_distinct(F.concat(begin, words(host, "[.]", "host:"), words(path, "[/._-]+", "path:"), words(rest, "[?#&=]+", "rest:")))


def split_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: Sequence[Rule] = RULES) -> DataFrame:
    """page_id, host, path, tokens, rule and stated (the rule's verdict) of each row."""
    rows = only(pages, page_id=id_col, url=url_col)
    rows = rows.select("page_id", *[c.alias(k) for k, c in url_parts(F.col("url")).items()])
    rule, verdict = stated_rule(F.col("host"), F.col("path"), rules)
    return rows.select("page_id", "host", "path", tokens(*map(F.col, ("scheme", "host", "path", "rest"))).alias("tokens"),
                       rule.alias("rule"), verdict.alias("stated"))


def training_sets(labelled: DataFrame, fit_urls: int = FIT_URLS) -> DataFrame:
    """url, tokens, label of a bounded number of distinct urls, the same ones in any run."""
    urls = labelled.groupBy("url").agg(F.first("tokens").alias("tokens"), F.max("label").alias("label"))
    total = urls.count()
    share = min(1.0, fit_urls / max(1, total))
    return saved(urls.filter(F.pmod(F.xxhash64("url"), F.lit(1 << 20)) < int(share * (1 << 20))), "url-fit")


def items(sets: DataFrame, most: int = MOST_ITEMS) -> tuple[DataFrame, DataFrame]:
    """(item, tokens) and (url, label, items): tokens of equal urls are one item; an item of all
    urls says nothing and is left out; of each url the ``most`` items whose label shares differ most."""
    flat = sets.select("url", "label", F.explode("tokens").alias("token"))
    covers = flat.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("label") == BLOCK).cast("double")).alias("share"), *[
        F.sum(F.xxhash64(F.lit(seed), "url").cast("decimal(20,0)")).alias(f"cover{seed}") for seed in (1, 2)])
    whole = sets.agg(F.count(F.lit(1)).alias("urls"), F.avg((F.col("label") == BLOCK).cast("double")).alias("base"))
    named = covers.groupBy("n", "cover1", "cover2").agg(
        F.min("token").alias("item"), F.array_sort(F.collect_list("token")).alias("tokens"), F.first("share").alias("share"))
    telling = F.round(F.abs(F.col("share") - whole.select("base").scalar()) * F.sqrt("n"), 9)
    named = named.filter(F.col("n") < whole.select("urls").scalar()).select("item", "tokens", "n", telling.alias("telling"))
    named = saved(named, "url-items")
    listed = flat.join(named.select(F.col("item").alias("token"), "telling"), "token").groupBy("url", "label").agg(
        F.transform(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("telling")).alias("t"), "token"))), 1, most),
                    lambda x: x["token"]).alias("items"))  # a url's own tokens
    return named.drop("telling"), listed


def mine(labelled: DataFrame, *, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE,
         fit_urls: int = FIT_URLS, most_items: int = MOST_ITEMS) -> DataFrame:
    """Mined rules (label, items, tokens, anchor, support, confidence) from labelled rows (url, tokens, label).

    support counts the urls with antecedent and label; the floor ``min_support`` is a share of all
    urls read. Antecedents are not empty.
    """
    sets = training_sets(labelled, fit_urls)
    named, listed = items(sets, most_items)
    total = sets.count()
    with_label = listed.select(F.concat("items", F.array(F.concat(F.lit("label:"), "label"))).alias("items"))
    floor = max(1, -(-int(round(min_support * total * 1e6)) // 1_000_000))
    n_sets = max(1, listed.count())
    found = FPGrowth(itemsCol="items", minSupport=(floor - 0.5) / n_sets, minConfidence=0.0).fit(with_label).freqItemsets
    found = saved(found.select("items", F.col("freq").alias("support")), "url-itemsets")
    marks = F.array(*[F.lit("label:" + x) for x in LABELS])
    key = F.array_sort(F.array_except("items", marks))
    sides = found.select(key.alias("items"), F.get(F.array_intersect("items", marks), F.lit(0)).alias("mark"), "support").filter(F.size("items") > 0)
    counts = sides.filter("mark IS NULL").select("items", F.col("support").alias("n"))
    rules = sides.filter("mark IS NOT NULL").join(counts, "items").select(
        F.substring("mark", 7, 100).alias("label"), "items", "support", (F.col("support") / F.col("n")).alias("confidence"))
    rules = saved(rules.filter(F.col("confidence") >= min_confidence), "url-rules")
    shorter = rules.select("label", "items", "confidence", F.explode(F.transform("items", lambda x: F.array_remove("items", x))).alias("less"))
    bare = rules.select("label", F.col("items").alias("less"), F.col("confidence").alias("less_confidence"))
    useless = shorter.join(bare, ["label", "less"]).filter("less_confidence >= confidence").select("label", "items").distinct()
    kept = rules.join(useless, ["label", "items"], "left_anti")
    spelled = kept.select("*", F.explode("items").alias("item")).join(named, "item").groupBy("label", "items", "support", "confidence").agg(
        F.array_sort(F.flatten(F.collect_list("tokens"))).alias("tokens"), F.min_by("item", F.struct("n", "item")).alias("anchor"))
    return saved(spelled, "url-index")


def best_rules(urls: DataFrame, rules: DataFrame, broadcast_rules: int = BROADCAST_RULES, salts: int = SALTS) -> DataFrame:
    """row, label, confidence of the best mined rule of each row (row, tokens); rows without one are left out."""
    index = rules.select(F.col("anchor").alias("token"), F.col("tokens").alias("wanted"), "label", "support", "confidence")
    flat = urls.select("row", "tokens", F.explode("tokens").alias("token"))
    if rules.count() <= broadcast_rules:
        met = flat.join(F.broadcast(index), "token")
    else:
        parts = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
        met = flat.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(salts)).cast("int")).join(index.withColumn("part", parts), ["token", "part"])
    met = met.filter(F.size(F.array_except("wanted", "tokens")) == 0)
    best = F.max(F.struct("confidence", "support", (F.col("label") == BLOCK).alias("blocks"), "label")).alias("best")
    return met.groupBy("row").agg(best).select("row", "best.label", "best.confidence")


def filter_urls(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", rules: Sequence[Rule] = RULES,
                labelled: DataFrame | None = None, **mining: float) -> DataFrame:
    """page_id, host, path, rule, verdict, mined_confidence of each row.

    ``labelled`` (url, label) are the urls to learn from; by default those that a stated rule decides.
    """
    pages = only(pages, page_id=id_col, url=url_col)
    rows = saved(split_urls(pages, rules=rules).withColumn("row", F.monotonically_increasing_id()), "urls")
    if labelled is None:
        named = pages.select("url", *[c.alias(k) for k, c in url_parts(F.col("url")).items()])
        learn = named.select("url", tokens(*map(F.col, ("scheme", "host", "path", "rest"))).alias("tokens"),
                             stated_rule(F.col("host"), F.col("path"), rules)[1].alias("label"))
    else:
        learn = only(labelled, url="url", label="label").select(
            "url", tokens(*url_parts(F.col("url")).values()).alias("tokens"), "label")
    mined = mine(learn.filter(F.col("label").isin(*LABELS) & (F.size("tokens") > 0)), **mining)
    found = best_rules(rows.filter("stated IS NULL").select("row", "tokens"), mined)
    return rows.join(found, "row", "left").select(
        "page_id", "host", "path", "rule", F.coalesce("stated", "label", F.lit(ALLOW)).alias("verdict"),
        F.when(F.col("stated").isNull(), F.col("confidence")).alias("mined_confidence"))
