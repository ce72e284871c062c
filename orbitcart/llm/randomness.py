"""Secret scan with a randomness test battery (operator 10), in DataFrame functions only.

Base kinds are patterns (``assign``, ``access``, ``hex``). The battery adds spans of kind
``random``: unbroken runs of 20 or more token characters that

* pass as uniform draws from the alphabet of their inferred encoding (hex, base32, base64 or
  its URL form): a chi-squared test of symbol counts, a runs test about the alphabet's middle
  and a test of serial correlation, with Bonferroni's bound over the three; and
* are not words: under the hypothesis "word" a character is a digit, sign or inner capital
  with a small rate, and the Chernoff bound of the count seen gives a p-value that falls with
  length. Benjamini-Hochberg over all candidates of the corpus keeps the share of words among
  the added spans below a level, so a short run needs stronger evidence than a long one.

Positions are code points, end exclusive, found by pairing the pieces of ``split`` with the
matches of the same pattern.

Defined cases: a null text is empty (no spans); rows that repeat an id are scanned each; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbitcart.llm.cascade import let
from orbitcart.llm.common import only, saved, text_or_empty

# The base patterns, their shortest accepted lengths, and the kinds' order.
ASSIGN = """(?i:password|passwd|secret|token|api_?key)["']?\\x20*[:=]\\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{12,}"  # a run of 16 or more
HEX = "[0-9a-f]{32,}"
ASSIGN_VALUE = 8
KINDS = ("assign", "access", "hex", "random")
RUN = "[A-Za-z0-9+/_-]{20,}"
_DIGITS, _CAPITALS = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SMALL = _CAPITALS.lower()
ALPHABETS = (("^[0-9a-f]+$", _DIGITS + "abcdef"), ("^[0-9A-F]+$", _DIGITS + "ABCDEF"), ("^[A-Z2-7]+$", _CAPITALS + "234567"),
             ("^[A-Za-z0-9_-]+$", _CAPITALS + _SMALL + _DIGITS + "-_"))
BASE64 = _CAPITALS + _SMALL + _DIGITS + "+/"
# Coefficients of the normal tail (Abramowitz and Stegun, 26.2.17).
_TAIL = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)

#: Level of the uniformity tests, rate of unusual characters in words, false-discovery level.
UNIFORM_LEVEL, WORD_RATE, DISCOVERY_LEVEL = 0.001, 0.05, 0.01
_BINS, _MOST_BITS = 8, 1000

#: Matches of a text that are handled together: appending to a list copies it, so lists are built in
#: blocks of this size and joined once.
BLOCK = 256

_SPAN = "struct<start:int,kind:int,end:int,match:string>"
_BARE = "struct<start:int,kind:int,end:int>"


def _blocks(values: Column) -> Column:
    """A filled array as an array of arrays of BLOCK values."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / BLOCK).cast("int")), lambda i: F.slice(values, i * BLOCK + 1, F.lit(BLOCK)))


def matches(text: Column, pattern: str, kind: str, value_group: int = 0, shortest: int = 0) -> Column:
    """Spans and texts of the leftmost non-overlapping matches; those whose group is too short are dropped."""
    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match"),
                         F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group)).alias("value"))

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["match"])
        span = F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("kind"), end.alias("end"), x["match"].alias("match"))
        keep = F.coalesce(F.length(x["value"]) >= shortest, F.lit(False))
        return F.struct(F.coalesce(end, acc["at"]).alias("at"), F.when(keep, F.concat(acc["found"], F.array(span))).otherwise(acc["found"]).alias("found"))

    none = F.array().cast(f"array<{_SPAN}>")

    def placed(blocks: Column) -> Column:
        sizes = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda n, x: n + F.length(x["gap"]) + F.coalesce(F.length(x["match"]), F.lit(0))))
        offsets = F.aggregate(sizes, F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
        return let(offsets, lambda at: F.flatten(F.transform(blocks, lambda b, i: F.aggregate(
            b, F.struct(F.coalesce(F.get(at, i), F.lit(0)).alias("at"), none.alias("found")), add)["found"])))

    return F.when(text.rlike(pattern), let(let(pairs, _blocks), placed)).otherwise(none)


def spans(text: Column, pattern: str, kind: str, value_group: int = 0, shortest: int = 0) -> Column:
    """Spans of ``matches``."""
    return F.transform(matches(text, pattern, kind, value_group, shortest),
                       lambda m: F.struct(m["start"].alias("start"), m["kind"].alias("kind"), m["end"].alias("end")))


def base_spans(text: Column) -> Column:
    none = F.array().cast(f"array<{_BARE}>")
    low = F.lower(text)
    named = F.contains(low, F.lit("passw")) | F.contains(low, F.lit("secret")) | F.contains(low, F.lit("token")) | F.contains(low, F.lit("api"))
    return F.array_sort(F.concat(
        F.when(named, spans(text, ASSIGN, "assign", 1, ASSIGN_VALUE)).otherwise(none),
        F.when(F.contains(text, F.lit("AKIA")), spans(text, ACCESS, "access")).otherwise(none),
        spans(text, HEX, "hex")))


def normal_tail(z: Column) -> Column:
    """P(|Z| > |z|) of a standard normal variable."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    series = F.lit(0.0)
    for c in reversed(_TAIL):
        series = (series + c) * t
    return F.least(F.lit(1.0), 2 * F.exp(-z * z / 2) / 2.5066282746310002 * series)


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def uniformity(run: Column) -> Column:
    """Smallest p-value, times three, of the battery on a run of characters."""
    alphabet = F.when(run.rlike(ALPHABETS[0][0]), ALPHABETS[0][1])
    for pattern, symbols in ALPHABETS[1:]:
        alphabet = alphabet.when(run.rlike(pattern), symbols)
    alphabet = alphabet.otherwise(BASE64)

    def tests(x: Column) -> Column:
        k, n, values = x["k"], x["n"], x["values"]
        middle = (k - 1) / 2
        counts = F.transform(F.array_distinct(values), lambda v: F.size(F.filter(values, lambda w: w == v)).cast("double"))
        chi = k / n * _sum(F.transform(counts, lambda c: c * c)) - n
        df = k - 1
        z_chi = (F.pow(F.greatest(chi, F.lit(0.0)) / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
        p_chi = F.when(z_chi > 0, normal_tail(z_chi) / 2).otherwise(1.0)
        pairs = F.transform(F.sequence(F.lit(1), F.size(values) - 1),
                            lambda i: F.struct((F.get(values, i - 1) - middle).alias("a"), (F.get(values, i) - middle).alias("b")))
        turns = _sum(F.transform(pairs, lambda p: ((p["a"] > 0) != (p["b"] > 0)).cast("double")))
        p_runs = normal_tail((turns - (n - 1) / 2) / F.sqrt((n - 1) / 4))
        products = _sum(F.transform(pairs, lambda p: p["a"] * p["b"]))
        p_serial = normal_tail(products / ((k * k - 1) / 12) / F.sqrt(n - 1))
        return F.least(F.lit(1.0), 3 * F.least(p_chi, p_runs, p_serial))

    def numbers(abc: Column) -> Column:
        symbols = F.filter(F.split(run, ""), lambda c: c != "")
        return F.struct(F.length(abc).cast("double").alias("k"), F.length(run).cast("double").alias("n"),
                        F.transform(symbols, lambda c: (F.position(c, abc) - 1).cast("double")).alias("values"))

    return let(let(alphabet, numbers), tests)


def word_p(run: Column) -> Column:
    """Bound of the chance that a word of this length has so many digits, signs and inner capitals."""
    n = F.length(run).cast("double")
    inner = F.substring(run, 2, 1 << 30)
    odd = n - 1 - F.length(F.translate(inner, _DIGITS + _CAPITALS + "+/_-", ""))
    f = F.greatest(odd / n, F.lit(WORD_RATE))
    divergence = f * F.log(f / WORD_RATE) + F.when(f < 1, (1 - f) * F.log((1 - f) / (1 - WORD_RATE))).otherwise(0.0)
    return F.exp(-n * divergence)


def candidates(text: Column, base: Column) -> Column:
    """Runs apart from base spans that pass as uniform: span and ``bits`` (-log2 of the word p-value)."""
    def weigh(s: Column) -> Column:
        run = s["match"]
        return F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"),
                        F.least(-F.log2(F.greatest(word_p(run), F.lit(1e-300))), F.lit(float(_MOST_BITS))).alias("bits"),
                        uniformity(run).alias("uniform"))

    def meets(s: Column, b: Column) -> Column:
        return (b["start"] < s["end"]) & (s["start"] < b["end"])

    def bounds(block: Column) -> Column:
        return F.struct(F.array_min(F.transform(block, lambda b: b["start"])).alias("start"),
                        F.array_max(F.transform(block, lambda b: b["end"])).alias("end"), block.alias("spans"))

    found = matches(text, RUN, "random")
    # base spans are sorted, so a run meets few of their blocks
    apart = let(F.transform(_blocks(base), bounds), lambda known: F.filter(
        found, lambda s: ~F.exists(known, lambda k: meets(s, k) & F.exists(k["spans"], lambda b: meets(s, b)))))
    return F.transform(F.when(F.size(base) > 0, apart).otherwise(found), weigh)


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base (sorted spans) and runs (candidates with their evidence) of each row."""
    rows = only(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), text_or_empty().alias("text"))
    rows = rows.withColumn("base", base_spans(F.col("text")))
    return rows.select("doc_id", "base", candidates(F.col("text"), F.col("base")).alias("runs"))


def evidence_needed(scanned: DataFrame, *, level: float = DISCOVERY_LEVEL) -> float:
    """Benjamini-Hochberg's threshold, in bits, over all candidates (counted in steps of 1/8 bit)."""
    steps = (scanned.select(F.explode("runs").alias("x")).groupBy(F.floor(F.col("x.bits") * _BINS).cast("int").alias("step"),
                                                                  (F.col("x.uniform") >= UNIFORM_LEVEL).alias("uniform"))
             .count().collect())  # at most 16,002 rows, whatever the input
    total, above, best = sum(r["count"] for r in steps), 0, float("inf")
    for step in sorted({r["step"] for r in steps}, reverse=True):
        above += sum(r["count"] for r in steps if r["step"] == step)
        if 2 ** (-step / _BINS) * total <= level * above:
            best = step / _BINS
    return best


def all_spans(base: Column, runs: Column, bits: float) -> Column:
    """Base spans and accepted runs, sorted."""
    accepted = F.filter(runs, lambda x: (x["bits"] >= bits) & (x["uniform"] >= UNIFORM_LEVEL))
    return F.array_sort(F.concat(base, F.transform(
        accepted, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))))


def listed(found: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def report(scanned: DataFrame, bits: float) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans (all, as text)."""
    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")

    return scanned.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
                          listed(all_spans(F.col("base"), F.col("runs"), bits)).alias("spans"))


def find_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", level: float = DISCOVERY_LEVEL) -> DataFrame:
    scanned = saved(scan(docs, id_col=id_col, text_col=text_col), "secret-spans")  # spans only, no texts
    return report(scanned, evidence_needed(scanned, level=level))


def masked(text: Column, found: Column, mask: str) -> Column:
    """The text with each span, or union of overlapping spans, replaced."""
    def join(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, -1)
        wider = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))
        own = F.struct(s["start"].alias("start"), s["end"].alias("end"))
        meets = (F.size(acc) > 0) & F.coalesce(F.try_element_at(acc, F.lit(-1))["end"] > s["start"], F.lit(False))
        return F.when(meets, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(wider))).otherwise(F.concat(acc, F.array(own)))

    merged = F.aggregate(found, F.array().cast("array<struct<start:int,end:int>>"), join)
    cleaned = F.aggregate(F.reverse(merged), text, lambda t, s: F.overlay(t, F.lit(mask), s["start"] + 1, s["end"] - s["start"]))
    return F.when(F.size(found) > 0, cleaned).otherwise(text)


def mask_secrets(docs: DataFrame, *, text_col: str = "text", mask: str = "[secret]", level: float = DISCOVERY_LEVEL) -> DataFrame:
    """``docs`` with every secret in ``text_col`` masked; null texts stay null, no row goes."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    base, runs = "__base", "__runs"
    while {base, runs} & set(docs.columns):
        base, runs = base + "_", runs + "_"
    scanned = docs.withColumn(base, base_spans(text))
    scanned = scanned.withColumn(runs, candidates(text, F.col(base)))
    bits = evidence_needed(scanned.select(F.col(runs).alias("runs")), level=level)
    found = all_spans(F.col(base), F.col(runs), bits)
    clean = F.when(F.col(f"`{text_col}`").isNotNull(), masked(text, found, mask))
    return scanned.select(*[clean.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])
