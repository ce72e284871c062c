"""Removal of repeated byte strings by prefix-free parsing (operator 9).

Every byte covered by a string of ``length`` bytes that also starts anywhere else goes.

1. Parse. A rolling hash over 16 bytes gives each position a value; the trigger of a string
   start is the leftmost smallest value among the next RANGE positions. Consecutive starts
   with one trigger form a phrase: the bytes from the first of these starts to the end of the
   last one's string. Phrases overlap so that each string of ``length`` bytes lies in exactly
   one phrase, and equal strings lie at the same distance from their triggers.
2. Dictionary. A phrase is known by its hash, and by the hash of its core: the bytes after the
   trigger that any of its strings must contain. Phrases with a core of their own hold no
   repeated string; a phrase that occurs twice is repeated as a whole.
3. Order. Distinct phrases that share a core are compared by bytes: their parts before the
   trigger are sorted from the trigger backwards (the dictionary's order), their parts after
   it forwards (the order of what follows in the parse), each with the lengths common to
   neighbours. Both orders together give the common length of any two phrases around the
   trigger, and so the repeated strings of phrases that occur once.
4. Very common cores (over GROUP distinct phrases) are not gathered: their strings' hashes are
   counted by an aggregation that combines before it shuffles.

Phrases and documents are known by 64-bit hashes. Moved are the phrase hashes, the texts that
hold a repeated core and the bytes of phrases in step 3.

Defined cases: a null text is empty; texts shorter than ``length`` keep everything; rows that
repeat an id or a text are documents of their own; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbitcart.llm.common import only, saved, slices, text_or_empty
from orbitcart.llm.rolling import Rolling, window_minima

LENGTH = 400
#: Bytes of the trigger's rolling hash; starts that a trigger is chosen for (a power of 2).
TRIGGER_BYTES, RANGE = 16, 128
#: Distinct phrases of one core that are compared in one group.
GROUP = 32

_PHRASE = "row long, s int, e int, trigger int, core long, phrase long"


def parse(text: str, length: int = LENGTH) -> tuple[np.ndarray, ...] | None:
    """First and last start, trigger, core hash and phrase hash of each phrase of a text."""
    data = np.frombuffer(text.encode(), np.uint8)
    starts = len(data) - length + 1
    if starts < 1:
        return None
    rolling = Rolling(data)
    trigger_of = window_minima(rolling.windows(TRIGGER_BYTES), RANGE)[:starts]
    first = np.flatnonzero(np.concatenate([[True], trigger_of[1:] != trigger_of[:-1]]))
    last = np.append(first[1:], starts) - 1
    trigger = trigger_of[first]
    core = rolling.spans(trigger, trigger + length - RANGE + 1)
    return first, last, trigger, core.view(np.int64), rolling.spans(first, last + length).view(np.int64)


def phrases(docs: DataFrame, length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            parts = []
            for row, text in zip(batch.column("row").to_pylist(), batch.column("text").to_pylist()):
                found = parse(text, length)
                if found:
                    parts.append((np.full(len(found[0]), row), *found))
            if parts:
                row, s, e, trigger, core, phrase = map(np.concatenate, zip(*parts))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row), *(pa.array(x.astype(np.int32)) for x in (s, e, trigger)), pa.array(core), pa.array(phrase)],
                    names=["row", "s", "e", "trigger", "core", "phrase"])

    return docs.select("row", "text").mapInArrow(run, _PHRASE)


def common_lengths(strings: list[bytes]) -> np.ndarray:
    """Common prefix length of each two strings, from sorted order and neighbours' lengths."""
    n = len(strings)
    order = sorted(range(n), key=strings.__getitem__)
    near = np.zeros(n, np.int64)  # of a string and the next in order
    for k in range(n - 1):
        a, b = strings[order[k]], strings[order[k + 1]]
        m = min(len(a), len(b))
        differ = np.flatnonzero(np.frombuffer(a, np.uint8, m) != np.frombuffer(b, np.uint8, m))
        near[k] = differ[0] if len(differ) else m
    out = np.zeros((n, n), np.int64)
    for k in range(n - 1):
        low = np.minimum.accumulate(near[k:n - 1])
        out[order[k], order[k + 1:]] = low
        out[order[k + 1:], order[k]] = low
    return out


def repeated_starts(befores: list[bytes], afters: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each phrase: the distances before the trigger at which a repeated string starts."""
    n, reach = len(befores), max(map(len, befores)) + 2
    most = common_lengths([b[::-1] for b in befores])
    least = np.maximum(length - common_lengths(afters), 0)
    x, y = np.nonzero((least <= most) & ~np.eye(n, dtype=bool))
    steps = np.zeros((n, reach), np.int64)
    np.add.at(steps, (x, least[x, y]), 1)
    np.add.at(steps, (x, most[x, y] + 1), -1)
    return [np.flatnonzero(line) for line in np.cumsum(steps, axis=1) > 0]


def _runs(values: np.ndarray) -> Iterator[tuple[int, int]]:
    """First and last of each run of consecutive numbers in sorted ``values``."""
    if len(values):
        breaks = np.flatnonzero(np.diff(values) > 1)
        yield from zip(values[np.append(0, breaks + 1)].tolist(), values[np.append(breaks, len(values) - 1)].tolist())


def _compare(length: int):
    """Rows of distinct phrases sorted by core -> repeated starts (row, a, b) of those that occur once."""
    def solve(group: list[tuple]) -> Iterator[tuple[int, int, int]]:
        if len(group) > 1:
            found = repeated_starts([g[4][:g[3]] for g in group], [g[4][g[3]:] for g in group], length)
            for (row, s, times, before, _), distances in zip(group, found):
                if times == 1:
                    yield from ((row, s + before - b, s + before - a) for a, b in _runs(distances))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        core, group = None, []
        for batch in slices(batches, 4096):
            out = []
            names = ("core", "row", "s", "times", "before", "data")
            for own, *rest in zip(*(batch.column(c).to_pylist() for c in names)):
                if own != core:
                    out.extend(solve(group))
                    core, group = own, []
                group.append(tuple(rest))
            yield _spans(out)
        yield _spans(list(solve(group)))

    return run


def _spans(rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
    row, a, b = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), pa.array(a, pa.int32()), pa.array(b, pa.int32())], names=["row", "a", "b"])


def _string_hashes(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            parts = []
            for row, s, phrase, times, data in zip(*(batch.column(c).to_pylist() for c in ("row", "s", "phrase", "times", "data"))):
                hashes = Rolling(np.frombuffer(data, np.uint8)).windows(length).view(np.int64)
                n = len(hashes)
                parts.append((hashes, np.full(n, phrase), np.full(n, times), np.full(n, row), s + np.arange(n)))
            if parts:
                hashes, phrase, times, row, at = map(np.concatenate, zip(*parts))
                yield pa.RecordBatch.from_arrays([pa.array(hashes), pa.array(phrase), pa.array(times), pa.array(row), pa.array(at.astype(np.int32))],
                                                 names=["string", "phrase", "times", "row", "a"])

    return run


def _phrase_bytes(length: int):
    """Texts with the phrases wanted from them -> a row with the bytes of each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            out = []
            for row, text, wanted in zip(*(batch.column(c).to_pylist() for c in ("row", "text", "wanted"))):
                data = text.encode()
                out.extend((w["core"], w["phrase"], w["times"], row, w["s"], w["trigger"] - w["s"], data[w["s"]:w["e"] + length]) for w in wanted)
            core, phrase, times, rows, s, before, data = zip(*out) if out else ((),) * 7
            yield pa.RecordBatch.from_arrays(
                [pa.array(core, pa.int64()), pa.array(phrase, pa.int64()), pa.array(times, pa.int64()), pa.array(rows, pa.int64()),
                 pa.array(s, pa.int32()), pa.array(before, pa.int32()), pa.array(data, pa.binary())],
                names=["core", "phrase", "times", "row", "s", "before", "data"])

    return run


def _remove(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            kept, removed, spans = [], [], []
            for text, starts in zip(batch.column("text").to_pylist(), batch.column("starts").to_pylist()):
                data = np.frombuffer(text.encode(), np.uint8)
                steps = np.zeros(len(data) + 1, np.int32)
                np.add.at(steps, [x["a"] for x in starts], 1)
                np.add.at(steps, [x["b"] + length for x in starts], -1)
                gone = np.cumsum(steps[:-1]) > 0
                kept.append(data[~gone].tobytes())
                removed.append(int(gone.sum()))
                spans.append(int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(kept, pa.binary()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64())],
                                             names=["row", "kept", "n_removed", "n_spans"])

    return run


def _row_key() -> Column:
    return F.xxhash64("doc_id", "text")


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
                   group: int = GROUP) -> DataFrame:
    """row, kept (remaining bytes), n_removed, n_spans of the documents that lose bytes.

    ``row`` is ``xxhash64(id, text)`` with a null text as the empty one.
    """
    if length < RANGE + TRIGGER_BYTES:
        raise ValueError(f"length must be at least {RANGE + TRIGGER_BYTES} bytes")
    rows = only(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), text_or_empty().alias("text"))
    rows = rows.select(_row_key().alias("row"), "text")
    parsed = phrases(rows, length)

    cores = saved(parsed.groupBy("core").agg(F.count("*").alias("times"), F.min("phrase").alias("one"), F.max("phrase").alias("other"))
                  .filter("times > 1").select("core", F.expr("one <> other").alias("several")), "cores")
    marked = saved(parsed.join(cores, "core"), "phrases")
    whole = marked.filter("NOT several").select("row", F.col("s").alias("a"), F.col("e").alias("b"))

    # phrases that share a core with others: those that occur again are repeated as a whole
    shared = marked.filter("several")
    distinct = saved(shared.groupBy("core", "phrase")
                     .agg(F.count("*").alias("times"), F.min(F.struct("row", "s", "e", "trigger")).alias("at")), "dictionary")
    again = shared.join(distinct.filter("times > 1").select("phrase").distinct(), "phrase", "left_semi").select(
        "row", F.col("s").alias("a"), F.col("e").alias("b"))

    texts = saved(rows.dropDuplicates(["row"]).join(marked.select("row").distinct(), "row"), "texts")
    wanted = distinct.groupBy(F.col("at.row").alias("row")).agg(F.collect_list(
        F.struct("core", "phrase", "times", "at.s", "at.e", "at.trigger")).alias("wanted"))
    sizes = saved(distinct.groupBy("core").agg(F.count("*").alias("n")), "core-sizes")
    data = texts.join(wanted, "row").mapInArrow(
        _phrase_bytes(length), "core long, phrase long, times long, row long, s int, before int, data binary")
    data = saved(data.join(sizes, "core"), "phrase-bytes")

    few = data.filter(F.col("n") <= group).select("core", "row", "s", "times", "before", "data")
    compared = few.repartition("core").sortWithinPartitions("core").mapInArrow(_compare(length), "row long, a int, b int")
    strings = data.filter(F.col("n") > group).select("row", "s", "phrase", "times", "data").mapInArrow(
        _string_hashes(length), "string long, phrase long, times long, row long, a int")
    repeated = saved(strings.groupBy("string").agg(F.min("phrase").alias("one"), F.max("phrase").alias("other"))
                     .filter("one <> other").select("string"), "strings")
    counted = strings.filter("times = 1").join(repeated, "string", "left_semi").select("row", "a", F.col("a").alias("b"))

    starts = (whole.union(again).union(compared).union(counted).groupBy("row")
              .agg(F.collect_list(F.struct("a", "b")).alias("starts")))
    return texts.join(starts, "row").mapInArrow(_remove(length), "row long, kept binary, n_removed long, n_spans long")


def digests(docs: DataFrame, removed: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row of ``docs``."""
    rows = only(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), text_or_empty().alias("text"))
    rows = rows.select("doc_id", _row_key().alias("row"), F.octet_length("text").cast("long").alias("n_bytes"),
                       F.sha2("text", 256).alias("own_sha256"))
    changed = removed.select("row", "n_removed", "n_spans", F.sha2("kept", 256).alias("sha256"))
    return rows.join(changed, "row", "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).alias("n_spans"), F.coalesce("sha256", "own_sha256").alias("kept_sha256"))
