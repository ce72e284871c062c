"""K — hybrid recommender over the whole catalogue: popularity, nearest neighbours by item-item
cosine on purchase counts, TF-IDF content affinity on category text, hybrid scoring for all
customers, cold start, similar products, KPIs.

Scale design
* Neighbours are the ``NEIGHBOURS`` best exact cosines among all products with a common customer.
  A customer with up to ``BUCKET`` products sends its basket, as numbers, once to each of its products,
  and a product's pairs are added up and cut to the best where its baskets arrive: one shuffle, no
  table of pairs. Customers with more are busy, and products
  with equal counts of them are compared as one profile; profiles are scored only where bounds from
  the order of weights and remaining lengths let them enter a best list, so a customer who bought a
  whole catalogue does not pair it. No pair is left out and no pair table is dense.
* Content needs no product pairs: products of one category are equal in text, so a customer's
  content score is one number per category.
* Scoring sends each purchase's neighbour list to its customer as arrays of numbers, where it is added up
  and cut, and joins as many of a category's most popular products as can matter; nothing is
  broadcast by force.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import RegexTokenizer, StopWordsRemover
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orbitcart.functions.columns import money_avg, money_sum
from orbitcart.functions.ordering import with_global_row_number
from orbitcart.session import release_shuffles, written_table

KEY = "customer_unique_id"
CAT = "product_category_name_english"
NEIGHBOURS = 20                   # neighbours kept per product (part of the definition)
BUCKET = 256                      # products that a customer pairs; those with more are busy
BLOCK = 64                        # profiles next to one another in a busy customer's list that are scored first
TASK_PAIRS = 4_000_000            # pairs of products that a task adds up, on average
ROUND_PAIRS = 1_000_000_000       # pairs that are exchanged at once, some 4 GB; more go in rounds
ANGLE_BINS = 512                  # bins of a list per radian of angle
COLLAB_WEIGHT, CONTENT_WEIGHT = 0.6, 0.4
SCORE_DIGITS = 10                 # scores are stabilised before ranking (engine-independent ties)


# ------------------------------------------------------------------ K1-K3

def popularity(master: DataFrame) -> DataFrame:
    """K1 per (product, category): units, revenue, mean price, mean rating (null categories drop)."""
    return (master.where(F.col(CAT).isNotNull()).groupBy("product_id", CAT).agg(
        F.count("order_item_id").alias("total_units"), money_sum("price").alias("total_revenue"),
        money_avg("price").alias("avg_price"),
        F.round(F.avg("avg_review_score"), 10).alias("avg_rating")))  # stable ranking ties


def trending(pop: DataFrame, n: int) -> DataFrame:
    """Top-n trending products: units desc, rating desc, id."""
    return pop.orderBy(F.desc("total_units"), F.desc("avg_rating"), "product_id").limit(n)


def interactions(master: DataFrame, pop: DataFrame) -> DataFrame:
    """K2/K3 purchase counts per (customer, product) of the catalogue (products with a category)."""
    counts = master.groupBy(KEY, "product_id").agg(F.count("order_item_id").alias("n"))
    return counts.join(pop.select("product_id", F.col(CAT).alias("category")), "product_id")


# ------------------------------------------------------------------ K4 nearest neighbours

def _best(rows: DataFrame, key: str, value: Column, n: int) -> DataFrame:
    """The n rows of each key with the highest value, ties to the smaller neighbour id, with their rank."""
    w = Window.partitionBy(key).orderBy(F.desc(value), "neighbour_id")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def _sims(dots: DataFrame, norms: DataFrame) -> DataFrame:
    """Pairs a, b with dot -> a, b, sim (cosine)."""
    na, nb = (norms.select(F.col("product_id").alias(c), F.col("norm").alias(f"norm_{c}")) for c in ("a", "b"))
    return dots.join(na, "a").join(nb, "b").select(
        "a", "b", F.round(F.col("dot") / (F.col("norm_a") * F.col("norm_b")), SCORE_DIGITS).alias("sim"))


def _shared(counts: DataFrame, item: str) -> DataFrame:
    """Pairs a < b of items with a common customer, and the dot product of their counts."""
    x = counts.select(KEY, F.col(item).alias("a"), F.col("n").alias("na"))
    y = counts.select(KEY, F.col(item).alias("b"), F.col("n").alias("nb"))
    return x.join(y, KEY).where(F.col("a") < F.col("b")).groupBy("a", "b").agg(F.sum(F.col("na") * F.col("nb")).alias("dot"))


def _numbers(counts: DataFrame) -> DataFrame:
    """product_id, norm, square, number (from 1, in the order of norm and id)."""
    squares = counts.groupBy("product_id").agg(F.sum(F.col("n") * F.col("n")).alias("square"))
    numbered = with_global_row_number(squares, [F.col("square"), F.col("product_id")], "number")
    return written_table(numbered.select("product_id", F.sqrt(F.col("square").cast("double")).alias("norm"), "square",
                                         F.col("number").cast("int").alias("number")), "product-numbers")


def _added(keys: list[np.ndarray], values: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Different keys in order, and the sum of each key's values."""
    key, value = np.concatenate(keys), np.concatenate(values)
    order = np.argsort(key)
    key, value = key[order], value[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    return key[first], np.add.reduceat(value, first) if len(first) else value


def _near_the_best(owner: np.ndarray, score: np.ndarray, n: int) -> np.ndarray:
    """Mask of the rows whose score may round to one of the n best of their owner; owners are in order."""
    edges = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1], True]) if len(owner) else np.zeros(0, np.int64)
    keep = np.ones(len(owner), bool)
    for lo, hi in zip(edges[:-1], edges[1:]):
        if hi - lo > n:
            keep[lo:hi] = score[lo:hi] >= np.partition(score[lo:hi], hi - lo - n)[hi - lo - n] - 2 * 10.0 ** -SCORE_DIGITS
    return keep


def _first_of_equal(columns: list[np.ndarray], number: np.ndarray, n: int) -> np.ndarray:
    """Positions of the n smallest numbers among the rows that are equal in all ``columns``."""
    order = np.lexsort((number, *columns))
    new = np.ones(len(order), bool)
    new[1:] = np.any([x[order][1:] != x[order][:-1] for x in columns], axis=0)
    begin = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    return order[np.arange(len(order)) - begin < n]


def _nearest(n: int, starts: np.ndarray, norms: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of rows number, n, others, counts (a product, its count and the basket it is in): number, other, dot of
    the pairs that can be among the n best. All rows of a product are in one partition. ``starts`` are the
    first numbers of each norm."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, dots, held, limit = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0, TASK_PAIRS
        for batch in batches:
            others, counts = batch.column("others"), batch.column("counts")
            sizes = np.diff(others.offsets.to_numpy())
            own = np.repeat(batch.column("number").to_numpy().astype(np.int64), sizes)
            other = others.flatten().to_numpy()
            dot = np.repeat(batch.column("n").to_numpy(), sizes) * counts.flatten().to_numpy()
            away = own != other
            keys.append((own[away] << 31) | other[away])
            dots.append(dot[away])
            held += int(away.sum())
            if held > limit:  # only different pairs are held
                key, dot = _added(keys, dots)
                keys, dots, held, limit = [key], [dot], len(key), TASK_PAIRS + 2 * len(key)
        key, dot = _added(keys, dots)
        own, other = key >> 31, key & ((1 << 31) - 1)
        norm_of = lambda number: np.searchsorted(starts, number, "right") - 1
        kind = norm_of(other)
        sim = dot / (norms[norm_of(own)] * norms[kind])
        keep = _near_the_best(own, sim, n)
        own, other, dot, kind = own[keep], other[keep], dot[keep], kind[keep]
        # with equal dot and norm the smaller ids, which have the smaller numbers, come first
        best = _first_of_equal([kind, dot, own], other, n)
        for part in range(0, len(best), 100_000):
            rows = best[part:part + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(own[rows].astype(np.int32)), pa.array(other[rows].astype(np.int32)), pa.array(dot[rows])],
                                             names=["number", "other", "dot"])

    return run


def _in_rounds(pairs: int, step: Callable[[int, int], DataFrame], name: str) -> DataFrame:
    """The rows of step(i, n) for all i < n. With more pairs than ``ROUND_PAIRS`` there are several steps, each stored
    before the next one begins, so that the disks hold the exchange of one round only."""
    rounds = max(1, -(-pairs // ROUND_PAIRS))
    if rounds == 1:
        return step(0, 1)
    stored = []
    for i in range(rounds):
        stored.append(written_table(step(i, rounds), name))
        release_shuffles(stored[-1].sparkSession)
    return functools.reduce(DataFrame.unionByName, stored)


def _near_by_baskets(counts: DataFrame, numbers: DataFrame, n: int, task_pairs: int = TASK_PAIRS) -> DataFrame:
    """product_id, neighbour_id, sim: the n best of each product (and what rounds to the same) by the dots of
    ``counts`` alone, whose customers have short baskets.

    A basket goes to each of its products as an array of numbers. Numbers are in the order of norm and
    id, so a norm is found from its first number; there are fewer different norms than the root of
    twice the sum of all squares.
    """
    steps = numbers.groupBy("square").agg(F.min("number").alias("start"), F.min("norm").alias("norm")).select("start", "norm").toPandas().sort_values("start")
    own = counts.where(F.col(KEY).isNotNull()).join(numbers.select("product_id", "number"), "product_id")
    baskets = own.groupBy(KEY).agg(F.collect_list(F.struct("number", "n")).alias("basket"))
    pairs = counts.where(F.col(KEY).isNotNull()).groupBy(KEY).agg(F.count(F.lit(1)).alias("size")).agg(F.sum(F.col("size") * F.col("size"))).first()[0] or 0
    if pairs > ROUND_PAIRS:
        baskets = written_table(baskets, "baskets")

    def part(i: int, rounds: int) -> DataFrame:
        """Of every ``rounds``-th product: all baskets that it is in."""
        own = F.filter("basket", lambda b: b["number"] % rounds == i) if rounds > 1 else F.col("basket")
        sent = baskets.select(F.explode(own).alias("own"), F.col("basket.number").alias("others"), F.col("basket.n").alias("counts"))
        sent = sent.select("own.number", "own.n", "others", "counts").repartition(max(1, -(-pairs // (rounds * task_pairs))), "number")
        return sent.mapInArrow(_nearest(n, steps["start"].to_numpy(), steps["norm"].to_numpy()), "number int, other int, dot long")

    best = _in_rounds(pairs, part, "near-round")
    a = numbers.select("number", F.col("product_id"), F.col("norm").alias("norm_a"))
    b = numbers.select(F.col("number").alias("other"), F.col("product_id").alias("neighbour_id"), F.col("norm").alias("norm_b"))
    return best.join(a, "number").join(b, "other").select(
        "product_id", "neighbour_id", F.round(F.col("dot") / (F.col("norm_a") * F.col("norm_b")), SCORE_DIGITS).alias("sim"))


def _profiles(busy_counts: DataFrame) -> DataFrame:
    """product_id, profile: products with equal counts of the same busy customers have one profile
    (two sums of 64-bit hashes, so no product's customers are gathered)."""
    return busy_counts.groupBy("product_id").agg(F.concat_ws(":", *[
        F.sum(F.xxhash64(F.lit(seed), KEY, "n").cast("decimal(20,0)")).cast("string") for seed in (1, 2)]).alias("profile"))


def _scored(pairs: DataFrame, entries: DataFrame) -> DataFrame:
    """asked, profile, busy_dot of pairs of profiles from their counts of the customers they share."""
    own = entries.select(F.col("profile").alias("asked"), KEY, F.col("n").alias("na"))
    other = entries.select("profile", KEY, F.col("n").alias("nb"))
    return pairs.join(own, "asked").join(other, ["profile", KEY]).groupBy("asked", "profile").agg(
        F.sum(F.col("na") * F.col("nb")).alias("busy_dot"))


def _shelf_scores(dots: DataFrame, shelf: DataFrame) -> DataFrame:
    """asked, neighbour_id, busy_dot, score: the products of the scored profiles; score = busy_dot / norm."""
    return dots.join(shelf.select("profile", "neighbour_id", "norm"), "profile").select(
        "asked", "neighbour_id", "busy_dot", F.round(F.col("busy_dot") / F.col("norm"), SCORE_DIGITS).alias("score"))


def _angle(w: Column) -> Column:
    return F.acos(F.least(w, F.lit(1.0)))


def best_of_busy(entries: DataFrame, shelf: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """(the n best products by busy_dot / norm for each profile, the pairs of profiles scored for it), exact.

    A profile's counts make a vector; divided by its length its entry for a customer is w. Let t be
    the n-th best score known so far, divided by the asking profile's length: no cosine below t helps.
    First each profile is scored against those next to it in the list of its least busy
    customer, which is in order of w; that gives t. Then (1) the entries of its busiest customers are
    left out as long as their remaining length is below t: a profile that shares only these
    has a cosine below t; (2) in the list of each customer kept, a pair's cosine is at most
    cos(angle - other angle) with angle = acos(w), so only a range of the list is read. What is
    left is scored in full. Lists are read by ranges, so nobody's list is paired with itself
    unless its profiles cannot be told apart by any bound.
    """
    sizes = entries.groupBy(KEY).agg(F.count(F.lit(1)).alias("size"))
    lengths = entries.groupBy("profile").agg(F.sqrt(F.sum(F.col("n") * F.col("n")).cast("double")).alias("length"))
    rows = written_table(entries.join(sizes, KEY).join(lengths, "profile").withColumn("w", F.col("n") / F.col("length")), "busy-entries")

    least = rows.groupBy("profile").agg(F.min(F.struct("size", F.col(KEY).alias("who"))).alias("first"))
    lists = with_global_row_number(rows.select(KEY, "profile", "w"), [F.col(KEY), F.col("w"), F.col("profile")], "place")
    lists = lists.select(KEY, "profile", F.floor(F.col("place") / BLOCK).alias("block"))
    begin = lists.join(least.select("profile", F.col("first.who").alias(KEY)), [KEY, "profile"])
    nearby = begin.withColumnRenamed("profile", "asked").join(lists, [KEY, "block"]).select("asked", "profile")
    itself = lengths.select(F.col("profile").alias("asked"), "profile")
    first = written_table(_scored(nearby.unionByName(itself).distinct(), rows), "busy-first")
    known = _best(_shelf_scores(first, shelf), "asked", F.col("score"), n).groupBy("asked").agg(
        F.min("score").alias("worst"), F.count(F.lit(1)).alias("found"))
    floor = known.join(lengths.withColumnRenamed("profile", "asked"), "asked").select(
        F.col("asked").alias("profile"), F.when(F.col("found") >= n, F.col("worst") / F.col("length") - 1e-8).otherwise(-1.0).alias("t"))

    # (1) by classes of busyness, which are few for any profile
    sized = rows.withColumn("busyness", F.floor(F.log2("size")).cast("int"))
    classes = sized.groupBy("profile", "busyness").agg(F.sum(F.col("w") * F.col("w")).alias("square"))
    rest = Window.partitionBy("profile").orderBy(F.desc("busyness"))  # as many rows as classes
    needed = classes.withColumn("rest", F.sqrt(F.sum("square").over(rest))).join(floor, "profile").where(
        F.col("rest") >= F.col("t")).select("profile", "busyness", "t")
    asking = sized.join(needed, ["profile", "busyness"]).select(KEY, F.col("profile").alias("asked"), _angle(F.col("w")).alias("angle"),
                                                               F.when(F.col("t") <= 0, F.lit(2.0)).otherwise(F.acos(F.least("t", F.lit(1.0)))).alias("reach"))
    # (2) by ranges of angles
    bins = F.sequence(F.floor((F.col("angle") - F.col("reach")) * ANGLE_BINS).cast("int"), F.floor((F.col("angle") + F.col("reach")) * ANGLE_BINS).cast("int"))
    reached = F.filter(bins, lambda x: (x >= 0) & (x <= int(2 * ANGLE_BINS)))
    told = rows.select(KEY, "profile", _angle(F.col("w")).alias("other"), F.floor(_angle(F.col("w")) * ANGLE_BINS).cast("int").alias("bin"))
    met = asking.withColumn("bin", F.explode(reached)).join(told, [KEY, "bin"]).where(
        F.abs(F.col("angle") - F.col("other")) <= F.col("reach") + 1e-9).select("asked", "profile").distinct()
    fresh = written_table(met.join(first, ["asked", "profile"], "left_anti"), "busy-pairs")
    dots = first.unionByName(_scored(fresh, rows))
    return _best(_shelf_scores(dots, shelf), "asked", F.col("score"), n), first.select("asked", "profile").unionByName(fresh)


def neighbours(inter: DataFrame, n: int = NEIGHBOURS, bucket: int = BUCKET) -> DataFrame:
    """K4 (product_id, neighbour_id, sim, rank): the n best exact cosines of purchase counts of each
    product, ties to the smaller neighbour id. Every pair with a common customer counts.

    Customers with at most ``bucket`` products send their baskets to their products (``_near_by_baskets``).
    For the others ("busy") equal
    profiles are compared instead: of the products of one profile only those with the n + 1
    smallest norms can be among the n best of any product that has nothing but busy customers in
    common with them (``best_of_busy`` finds the best profiles by bounds), and pairs of products of busy
    customers that other customers link are also added up in full. A pair without a busy customer in common
    keeps its place or a better one among the dots of the others alone, so cutting those loses none.
    """
    counts = inter.where(F.col("product_id").isNotNull()).select(KEY, "product_id", F.col("n").cast("long").alias("n"))
    numbers = _numbers(counts)
    norms = numbers.select("product_id", "norm")
    busy = counts.groupBy(KEY).agg(F.count(F.lit(1)).alias("products")).where(F.col("products") > bucket).select(KEY)
    hot = not busy.isEmpty()
    light = counts.join(busy, KEY, "left_anti") if hot else counts
    near = _near_by_baskets(light, numbers, n)
    if not hot:
        return _best(near, "product_id", F.col("sim"), n)
    busy_counts = counts.join(busy, KEY, "left_semi")
    members = written_table(_profiles(busy_counts), "profiles")
    entries = written_table(busy_counts.join(members, "product_id").select(KEY, "profile", "n").distinct(), "profile-entries")
    # pairs of light customers: the busy customers they also share are joined to these pairs alone
    dots = _shared(light.join(members, "product_id", "left_semi"), "product_id")
    ma, mb = (members.select(F.col("product_id").alias(c), F.col("profile").alias(p)) for c, p in (("a", "asked"), ("b", "profile")))
    dots = written_table(dots.join(ma, "a").join(mb, "b"), "light-pairs")
    meeting = _scored(dots.select("asked", "profile").distinct(), entries)
    dots = dots.join(meeting, ["asked", "profile"], "left").select("a", "b", (F.col("dot") + F.coalesce("busy_dot", F.lit(0))).alias("dot"))
    sims = _sims(dots, norms)
    near = near.unionByName(sims.select(F.col("a").alias("product_id"), F.col("b").alias("neighbour_id"), "sim")).unionByName(
        sims.select(F.col("b").alias("product_id"), F.col("a").alias("neighbour_id"), "sim"))
    # one more than n, as a product is found among its own profile
    shelf = written_table(_best(members.join(norms, "product_id").withColumnRenamed("product_id", "neighbour_id"), "profile", -F.col("norm"), n + 1), "shelf")
    found, _ = best_of_busy(entries, shelf, n + 1)
    linked = members.join(found.select(F.col("asked").alias("profile"), "neighbour_id", "busy_dot"), "profile").where(
        F.col("product_id") != F.col("neighbour_id"))
    linked = _sims(linked.select(F.col("product_id").alias("a"), F.col("neighbour_id").alias("b"), F.col("busy_dot").alias("dot")), norms)
    # a pair found both ways has its whole cosine in ``near``
    both = near.select("product_id", "neighbour_id", "sim").unionByName(linked.toDF("product_id", "neighbour_id", "sim"))
    return _best(both.groupBy("product_id", "neighbour_id").agg(F.max("sim").alias("sim")), "product_id", F.col("sim"), n)


# ------------------------------------------------------------------ K5 content affinity

def category_similarity(pop: DataFrame) -> DataFrame:
    """K5 cosine of the categories' TF-IDF vectors (category, other, sim), itself included.
    Tokens are ``\\w\\w+`` runs without English stop words; idf = ln((1+n)/(1+df)) + 1 over the
    products. With one-token names only a category itself is similar (Q16)."""
    docs = pop.groupBy(CAT).agg(F.countDistinct("product_id").alias("products")).select(
        F.col(CAT).alias("category"), "products", F.lower(CAT).alias("text"))
    tok = RegexTokenizer(inputCol="text", outputCol="tokens", pattern="\\w\\w+", gaps=False, toLowercase=True)
    sw = StopWordsRemover(inputCol="tokens", outputCol="terms")
    terms = sw.transform(tok.transform(docs)).select("category", "products", F.explode("terms").alias("term"))
    tf = terms.groupBy("category", "products", "term").agg(F.count(F.lit(1)).alias("tf"))
    n = docs.agg(F.sum("products")).scalar()
    df_ = tf.groupBy("term").agg(F.sum("products").alias("df"))
    w = tf.join(df_, "term").withColumn("w", F.col("tf") * (F.log((1.0 + n) / (1.0 + F.col("df"))) + 1.0))
    norm = w.groupBy("category").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    unit = w.join(norm, "category").select("category", "term", (F.col("w") / F.col("norm")).alias("w"))
    other = unit.select(F.col("category").alias("other"), "term", F.col("w").alias("v"))
    return unit.join(other, "term").groupBy("category", "other").agg(
        F.round(F.sum(F.col("w") * F.col("v")), SCORE_DIGITS).alias("sim"))


def content_affinity(inter: DataFrame, similarity: DataFrame) -> DataFrame:
    """K5 per (customer, category): summed similarity of the customer's products to the category,
    and how many of its products the customer has."""
    own = inter.groupBy(KEY, "category").agg(F.count(F.lit(1)).alias("bought"))
    near = own.join(similarity, "category").groupBy(KEY, F.col("other").alias("category")).agg(
        F.round(F.sum(F.col("bought") * F.col("sim")), SCORE_DIGITS).alias("affinity"))
    return near.join(own, [KEY, "category"], "left").fillna({"bought": 0})


# ------------------------------------------------------------------ K6-K10 recommendations

def _best_collab(n: int, starts: np.ndarray, key_type: pa.DataType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Customer, number, units of the targets that can be among a customer's n best with their collab part.

    Rows are a customer's product with its neighbours' numbers and cosines (in units of the last
    digit, the low 31 bits and the others), or, without a product, the customer's affinities by categories'
    first numbers. All rows of a customer are in one partition. ``starts`` are the categories' first numbers.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        customers: dict = {}
        keys, units, held, limit = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0, TASK_PAIRS
        owned, liked, liking = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        for batch in batches:
            coded = batch.column(KEY).dictionary_encode(null_encoding="encode")
            known = np.array([customers.setdefault(k, len(customers)) for k in coded.dictionary.to_pylist()], np.int64)
            owner = known[coded.indices.to_numpy()]
            for product in (True, False):
                rows = pa.array(np.asarray(batch.column("number").is_valid()) == product)
                part, own = batch.filter(rows), owner[np.asarray(rows)] << 31
                others = part.column("others")
                key = np.repeat(own, np.diff(others.offsets.to_numpy())) | others.flatten().to_numpy()
                if product:
                    keys.append(key)
                    units.append(part.column("low").flatten().to_numpy() + (part.column("high").flatten().to_numpy().astype(np.int64) << 31))
                    owned.append(own | part.column("number").to_numpy())
                    held += len(key)
                else:
                    liked.append(key)
                    liking.append(part.column("affinities").flatten().to_numpy())
            if held > limit:  # only different targets are held
                key, unit = _added(keys, units)
                keys, units, held, limit = [key], [unit], len(key), TASK_PAIRS + 2 * len(key)
        key, unit = _added(keys, units)
        fresh = ~np.isin(key, np.concatenate(owned))
        key, unit = key[fresh], unit[fresh]
        owner, number = key >> 31, key & ((1 << 31) - 1)
        category = np.searchsorted(starts, number, "right") - 1
        liked, liking = np.concatenate(liked), np.concatenate(liking)
        order = np.argsort(liked)
        liked, liking = liked[order], liking[order]
        asked = (owner << 31) | starts[category] if len(owner) else key
        place = np.minimum(np.searchsorted(liked, asked), max(len(liked) - 1, 0))
        affinity = np.where(liked[place] == asked, liking[place], 0.0) if len(liked) else np.zeros(len(asked))
        score = unit / 10.0 ** SCORE_DIGITS * COLLAB_WEIGHT + affinity * CONTENT_WEIGHT
        keep = _near_the_best(owner, score, n)
        owner, number, unit, category = owner[keep], number[keep], unit[keep], category[keep]
        # a category's products are numbered in the order that ties are broken by
        best = _first_of_equal([category, unit, owner], number, n)
        names = pa.array(list(customers), key_type)
        for part in range(0, len(best), 100_000):
            rows = best[part:part + 100_000]
            yield pa.RecordBatch.from_arrays([names.take(pa.array(owner[rows])), pa.array(number[rows].astype(np.int32)), pa.array(unit[rows])],
                                             names=[KEY, "number", "units"])

    return run


def recommend(inter: DataFrame, near: DataFrame, affinity: DataFrame, pop: DataFrame, n: int = 5) -> DataFrame:
    """K6 top-n hybrid recommendations for every customer with purchases in the catalogue.

    score(c, t) = sum over purchased p of 0.6 collab(p, t) + 0.4 content(p, t), t not purchased.
    Targets are the neighbours of purchases and, of each category the customer has affinity to,
    the n + bought most popular products: at least n of them are not purchased, and any other
    product of the category scores no more and comes later, so the top n are exact.

    A purchase brings its product's neighbours to the customer as arrays of numbers; they are added up
    and cut to those that can be among the n best there. Categories are read in the order of
    affinity until those before offer n products that are not purchased.
    """
    shelf = pop.select("product_id", F.col(CAT).alias("category"), "total_units", "avg_rating")
    # numbered over all categories, so no category is sorted in one task
    order = [F.col("category"), F.desc("total_units"), F.desc("avg_rating"), F.col("product_id")]
    numbered = written_table(with_global_row_number(shelf, order, "number").withColumn("number", F.col("number").cast("int")), "shelf-numbers")
    first = numbered.groupBy("category").agg(F.min("number").alias("first"), F.count(F.lit(1)).alias("products"))
    starts = np.array(sorted(r["first"] for r in first.collect()), np.int64)  # one row per category

    units = F.round(F.col("sim") * 10.0 ** SCORE_DIGITS).cast("long")
    listed = near.join(numbered.select(F.col("product_id").alias("neighbour_id"), F.col("number").alias("other")), "neighbour_id").withColumn("units", units)
    listed = listed.groupBy("product_id").agg(F.collect_list(F.struct(  # a product's n neighbours
        "other", F.col("units").bitwiseAND(F.lit((1 << 31) - 1)).cast("int").alias("low"), F.shiftright("units", 31).cast("byte").alias("high"))).alias("near"))
    own = inter.join(numbered.select("product_id", "category", "number"), ["product_id", "category"]).select(KEY, "product_id", "number")
    likings = affinity.join(first, "category").groupBy(KEY).agg(F.collect_list(F.struct("first", "affinity")).alias("likes"))
    none = {"low": F.lit(None).cast("array<int>"), "high": F.lit(None).cast("array<tinyint>"), "affinities": F.lit(None).cast("array<double>")}
    pairs = inter.count() * NEIGHBOURS
    from pyspark.sql.pandas.types import to_arrow_type
    key_type = inter.schema[KEY].dataType

    def part(i: int, rounds: int) -> DataFrame:
        """Of every ``rounds``-th customer by hash: all purchases' neighbours, added up."""
        mine = F.pmod(F.xxhash64(KEY), F.lit(rounds)) == i if rounds > 1 else F.lit(True)
        sent = own.where(mine).join(listed, "product_id", "left").select(
            KEY, "number", *[F.coalesce(f"near.{c}", F.array().cast(f"array<{t}>")).alias(as_) for c, t, as_ in
                             (("other", "int", "others"), ("low", "int", "low"), ("high", "tinyint", "high"))], none["affinities"].alias("affinities"))
        liked = likings.where(mine).select(KEY, F.lit(None).cast("int").alias("number"), F.col("likes.first").alias("others"), none["low"].alias("low"),
                                           none["high"].alias("high"), F.col("likes.affinity").alias("affinities"))
        return sent.unionByName(liked).repartition(max(1, -(-pairs // (rounds * TASK_PAIRS))), KEY).mapInArrow(
            _best_collab(n, starts, to_arrow_type(key_type)), f"{KEY} {key_type.simpleString()}, number int, units long")

    collab = _in_rounds(pairs, part, "collab-round")
    collab = written_table(collab, "collab")  # few rows, and the cold start asks for them again
    collab = collab.select(KEY, "number", (F.col("units") / 10.0 ** SCORE_DIGITS * COLLAB_WEIGHT).alias("collab"))

    offered = affinity.join(first, "category").withColumn("offered", F.least(F.col("products"), n + F.col("bought")) - F.col("bought"))
    likelier = Window.partitionBy(KEY).orderBy(-F.floor(F.col("affinity") * 1e9)).rangeBetween(Window.unboundedPreceding, -2)  # rows <= categories
    needed = offered.withColumn("before", F.coalesce(F.sum("offered").over(likelier), F.lit(0))).where(F.col("before") < n)
    popular = numbered.join(first, "category").select("number", "category", (F.col("number") - F.col("first") + 1).cast("long").alias("place"))
    places = needed.select(KEY, "category", F.explode(F.sequence(F.lit(1).cast("long"), n + F.col("bought"))).alias("place"))
    content = places.join(popular, ["category", "place"]).select(KEY, "number").join(own.select(KEY, "number"), [KEY, "number"], "left_anti")
    targets = collab.unionByName(content.withColumn("collab", F.lit(0.0))).groupBy(KEY, "number").agg(F.sum("collab").alias("collab"))
    scored = (targets.join(numbered, "number").join(affinity.select(KEY, "category", "affinity"), [KEY, "category"], "left")
              .withColumn("hybrid_score", F.round(F.col("collab") + F.coalesce("affinity", F.lit(0.0)) * CONTENT_WEIGHT, SCORE_DIGITS))
              .where(F.col("hybrid_score") > 0))
    order = Window.partitionBy(KEY).orderBy(F.desc("hybrid_score"), F.desc("total_units"), F.desc("avg_rating"), "product_id")
    return scored.withColumn("rec_rank", F.row_number().over(order).cast("int")).where(F.col("rec_rank") <= n).select(
        KEY, "product_id", "category", "hybrid_score", "rec_rank")


# The explanations of recommendations.
HYBRID_REASON = "Recommended because this customer purchases products in '%s' and matches high-affinity buyer behavior."
TRENDING_REASON = "Top Trending Recommendation (%s)"


def with_product_info(recs: DataFrame, pop: DataFrame) -> DataFrame:
    out = recs.join(pop.select("product_id", F.round("avg_price", 2).alias("avg_price")), "product_id")
    return out.withColumn("explanation", F.format_string(HYBRID_REASON, F.col("category"))).withColumn(
        "recommendation_type", F.lit("hybrid"))


def cold_start(customers: DataFrame, scored_customers: DataFrame, pop: DataFrame, n: int = 5,
               reason: str = "New Customer Cold-Start Fallback") -> DataFrame:
    """K7 customers without hybrid scores get the top-n trending products with score 1.0."""
    top = trending(pop, n).agg(F.array_sort(F.collect_list(F.struct(  # n rows
        (-F.col("total_units")).alias("units"), (-F.col("avg_rating")).alias("rating"), "product_id",
        F.col(CAT).alias("category"), F.round("avg_price", 2).alias("avg_price"))))).scalar()
    missing = customers.select(KEY).distinct().join(scored_customers.select(KEY).distinct(), KEY, "left_anti")
    out = missing.select(KEY, F.posexplode(top).alias("pos", "t"))
    return out.select(KEY, "t.product_id", "t.category", "t.avg_price", F.lit(1.0).alias("hybrid_score"),
                      (F.col("pos") + 1).cast("int").alias("rec_rank"),
                      F.lit(TRENDING_REASON % reason).alias("explanation"), F.lit("cold_start").alias("recommendation_type"))


def similar_products(near: DataFrame, n: int = 5) -> DataFrame:
    """K8 top-n most similar products per product (self excluded), ties by product id."""
    return near.where(F.col("rank") <= n).select("product_id", F.col("neighbour_id").alias("similar_product_id"),
                                                 F.round("sim", 6).alias("similarity_score"), F.col("rank").cast("long"))


def product_profiles(pop: DataFrame, near: DataFrame, q: str | None = None, n: int = 5) -> DataFrame:
    """K13 popularity profile with the ids of the n most similar products; ``q`` filters by id."""
    similar = near.where(F.col("rank") <= n).groupBy("product_id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("rank", "neighbour_id"))), lambda x: x["neighbour_id"].cast("string")), ", ").alias("similar_products"))
    own = pop.where(F.col("product_id").cast("string").contains(q)) if q else pop
    return own.join(similar, "product_id", "left")


def cross_and_up_sell(pop: DataFrame, n: int = 50) -> tuple[DataFrame, DataFrame]:
    """K9 cross-sell = trending head n; up-sell = n products by mean price descending."""
    cross = trending(pop, n)
    up = pop.orderBy(F.desc("avg_price"), "product_id").limit(n)
    return cross, up


def reco_kpis(recs: DataFrame, products: DataFrame) -> DataFrame:
    """K11 total, customers, mean per customer, catalogue coverage %, category diversity,
    most recommended product and category (constants dropped, Q6)."""
    n_products = products.agg(F.count_distinct("product_id")).scalar()
    top_p = recs.groupBy("product_id").count().orderBy(F.desc("count"), "product_id").limit(1).select(
        F.col("product_id").cast("string")).scalar()
    top_c = recs.groupBy("category").count().orderBy(F.desc("count"), "category").limit(1).select("category").scalar()
    return recs.agg(F.count(F.lit(1)).alias("total_recommendations"), F.countDistinct(KEY).alias("customers"),
                    F.countDistinct("product_id").alias("distinct_products"),
                    F.countDistinct("category").alias("category_diversity")).select(
        "total_recommendations", "customers",
        (F.col("total_recommendations") / F.greatest(F.col("customers"), F.lit(1))).alias("avg_per_customer"),
        (F.col("distinct_products") / n_products * 100.0).alias("catalog_coverage_pct"),
        "category_diversity", top_p.alias("most_recommended_product"), top_c.alias("most_recommended_category"))


def customer_context(fs: DataFrame, master: DataFrame, clv_tiers: DataFrame | None = None,
                     risk: DataFrame | None = None, top: int = 3) -> DataFrame:
    """K12 features + CLV tier + churn risk + top-3 favourite categories for all customers."""
    cats = master.where(F.col(CAT).isNotNull()).groupBy(KEY, CAT).count()
    w = Window.partitionBy(KEY).orderBy(F.desc("count"), CAT)  # rows per customer <= categories
    fav = cats.withColumn("r", F.row_number().over(w)).where(F.col("r") <= top).groupBy(KEY).agg(
        F.array_join(F.array_sort(F.collect_list(F.struct("r", CAT))).getField(CAT), ", ").alias("favourite_categories"))
    out = fs.select(KEY, "total_orders", "total_spending", "recency_days", "rfm_segment").join(fav, KEY, "left")
    if clv_tiers is not None:
        out = out.join(clv_tiers.select(KEY, "clv_value_tier"), KEY, "left").fillna({"clv_value_tier": "Silver"})
    if risk is not None:
        out = out.join(risk.select(KEY, "risk_level"), KEY, "left").fillna({"risk_level": "Low"})
    return out


# Priority labels of the opportunity matrix.
PRIORITIES = ("P1 - At-Risk Retention Target", "P2 - VIP Cross-Sell Expansion", "P3 - High Value Upsell",
              "P4 - Standard Personalization")


def opportunity_matrix(recs: DataFrame, ctx: DataFrame, limit: int | None = None) -> DataFrame:
    """K14 recommendations joined to CLV tier and risk (D15: defaults Silver / Low Risk), with a
    priority: risk high or critical, then tier platinum or gold, then up-sell, then the rest.
    All distinct rows; ``limit`` gives the first by priority and score."""
    m = recs.join(ctx.select(KEY, "clv_value_tier", "risk_level"), KEY, "left").fillna(
        {"clv_value_tier": "Silver", "risk_level": "Low Risk"})
    risk, tier = F.lower("risk_level"), F.lower("clv_value_tier")
    pr = (F.when(risk.contains("critical") | risk.contains("high"), PRIORITIES[0])
           .when(tier.contains("platinum") | tier.contains("gold"), PRIORITIES[1])
           .when(F.lower("recommendation_type").contains("upsell"), PRIORITIES[2])
           .otherwise(PRIORITIES[3]))
    out = m.select(KEY, "product_id", "category", "recommendation_type", "hybrid_score", "clv_value_tier", "risk_level",
                   pr.alias("priority")).distinct()
    return out.orderBy("priority", F.desc("hybrid_score"), KEY, "product_id").limit(limit) if limit else out


def filter_recommendations(recs: DataFrame, ctx: DataFrame | None = None, *, categories=None, min_score: float | None = None,
                           types=None, tiers=None, risks=None) -> DataFrame:
    """K15 filters (category, minimum score, type, CLV tier, churn risk); tier and risk come from
    ``ctx`` (K12) with the defaults of D15 where a customer has none."""
    out = recs
    if tiers or risks:
        out = out.join(ctx.select(KEY, "clv_value_tier", "risk_level"), KEY, "left").fillna(
            {"clv_value_tier": "Silver", "risk_level": "Low Risk"})
    for column, values in (("category", categories), ("recommendation_type", types), ("clv_value_tier", tiers), ("risk_level", risks)):
        if values:
            out = out.where(F.col(column).isin(list(values)))
    if min_score is not None:
        out = out.where(F.col("hybrid_score") >= min_score)
    return out


def business_modes(recs: DataFrame, pop: DataFrame) -> DataFrame:
    """K16 most recommended category and product, top trending category."""
    def most(column: str) -> Column:  # counted by an aggregation, not in one buffer
        return recs.groupBy(column).count().orderBy(F.desc("count"), column).limit(1).select(column).scalar()

    one = recs.sparkSession.range(1)
    return one.select(most("category").alias("most_recommended_category"), most("product_id").alias("most_recommended_product"),
                      trending(pop, 1).select(CAT).scalar().alias("top_trending_category"))


def holdout_cut(master: DataFrame, holdout_share: float = 0.2) -> Column:
    """The time that the last ``holdout_share`` of the purchase period starts at."""
    ts = F.col("order_purchase_timestamp").cast("timestamp")
    b = master.agg(F.unix_micros(F.min(ts)).alias("lo"), F.unix_micros(F.max(ts)).alias("hi"))
    return b.select(F.timestamp_micros(F.col("hi") - F.floor((F.col("hi") - F.col("lo")) * holdout_share).cast("long"))).scalar()


def ranking_evaluation(master: DataFrame, k_eval: int = 10, holdout_share: float = 0.2, cut=lambda df: df) -> DataFrame:
    """K17 time-based hold-out: fit on purchases before the cut, recommend top-k for customers
    active in both parts (S3); precision@k, recall@k and MAP@k (average precision over
    min(k, relevant products)) as means over customers, and catalogue coverage %."""
    ts, at = F.col("order_purchase_timestamp").cast("timestamp"), holdout_cut(master, holdout_share)
    train, test = cut(master.where(ts < at)), master.where(ts >= at)
    pop = cut(popularity(train))
    inter = cut(interactions(train, pop))
    affinity = cut(content_affinity(inter, category_similarity(pop)))
    recs = cut(recommend(inter, cut(neighbours(inter)), affinity, pop, k_eval))
    truth = test.select(KEY, "product_id").distinct()
    relevant = truth.groupBy(KEY).agg(F.count(F.lit(1)).alias("relevant"))
    hits = recs.join(truth.withColumn("hit", F.lit(1)), [KEY, "product_id"], "left").withColumn("hit", F.coalesce("hit", F.lit(0)))
    so_far = Window.partitionBy(KEY).orderBy("rec_rank")  # k rows
    hits = hits.withColumn("found", F.sum("hit").over(so_far))
    per = hits.groupBy(KEY).agg(F.sum("hit").alias("hits"), F.sum(F.col("hit") * F.col("found") / F.col("rec_rank")).alias("ap")).join(relevant, KEY)
    n_recommended = recs.agg(F.count_distinct("product_id")).scalar()
    n_products = pop.agg(F.count_distinct("product_id")).scalar()
    return per.agg(F.count(F.lit(1)).alias("customers_evaluated"), F.avg(F.col("hits") / k_eval).alias("precision_at_k"),
                   F.avg(F.col("hits") / F.col("relevant")).alias("recall_at_k"),
                   F.avg(F.col("ap") / F.least(F.col("relevant"), F.lit(k_eval))).alias("map_at_k")).select(
        "*", (n_recommended / n_products * 100.0).alias("catalog_coverage_pct"))
