"""Substring deduplication by content-defined chunks (operator 3).

A gear rolling hash (h = 2h + gear[byte], 32 bits) runs over each text's bytes; a chunk ends
where MASK's bits of h are zero, after LEAST bytes at least and MOST at most. The mask's bits
depend on the last 20 bytes, so an insertion shifts the chunks around it and the next ends
fall in their old places. Chunks are known by a 128-bit digest. Of each digest's occurrences
the first in (id, offset) order stays. Others are cut out where neighbouring repeated chunks
make a run of RUN bytes or a whole text, or lie in RUN bytes that occur elsewhere too; a lone
line that many texts share stays.

Only digests and positions are shuffled for counting, combined before the shuffle; then the
texts that lose chunks are read once more. For chunks of shorter runs the RUN bytes around
them are compared as well, so a passage whose ends lie inside chunks is seen whole. Each RUN
bytes choose a part of themselves by their content alone, so many choose the same; the parts
are counted first, and only RUN bytes whose part occurs twice, and around a chunk of a short
run once at least, are hashed and counted. A passage is missed only where no whole chunk lies in it. ``run_bytes=0``
removes every repeated chunk, lone ones too.

Chunks end where a character does, so what is left of a text is UTF-8 and nothing else goes.

Defined cases: null and empty texts have no chunks; rows that repeat an id or a text are
documents of their own, but of rows equal in id and text each loses what an earlier document
holds and all of them keep the same; a null id sorts first; an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbitcart.llm.common import only, saved, slices, text_or_empty
from orbitcart.llm.rolling import Rolling, window_minima

#: Chunk bytes: at least, at most; the mask's four bits give 16 more on average.
LEAST, MOST, MASK = 16, 512, 0b1111 << 15
#: Bytes of neighbouring repeated chunks, or of common text around them, that count as a repeated passage.
RUN = 96

_GEAR = np.random.default_rng(3).integers(0, 1 << 32, 256, dtype=np.uint32)


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """h at every byte: the sum of gear[byte j back] << j, built by doubling the reach."""
    h, reach = _GEAR[data], 1
    while reach < 32:
        step = h.copy()
        step[reach:] += h[:-reach] << np.uint32(reach)
        h, reach = step, 2 * reach
    return h


def chunk_ends(data: np.ndarray, least: int = LEAST, most: int = MOST) -> list[int]:
    """End offsets of the chunks of a UTF-8 byte string; all lie between characters."""
    n, at, ends = len(data), 0, []
    between = np.append((data & 0xC0) != 0x80, True)
    cuts = np.flatnonzero((gear_hashes(data) & np.uint32(MASK)) == 0) + 1 if n else np.empty(0, np.int64)

    def forced(at: int) -> int:
        end = at + most
        while not between[end]:
            end -= 1
        return end

    for cut in cuts[between[cuts]].tolist():
        while cut - at > most:
            at = forced(at)
            ends.append(at)
        if cut - at >= least:
            at = cut
            ends.append(at)
    while n - at > most:
        at = forced(at)
        ends.append(at)
    if at < n:
        ends.append(n)
    return ends


def chunks(rows: DataFrame) -> DataFrame:
    """row, doc_id, text -> a row for each chunk: high, low (digest), doc_id, row, a, b."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            digests, a, b, counts, sizes = [], [], [], [], []
            for text in batch.column("text").to_pylist():
                data = text.encode()
                ends = chunk_ends(np.frombuffer(data, np.uint8))
                starts = [0, *ends[:-1]] if ends else ends
                digests.extend([xxhash.xxh3_128_digest(data[at:end]) for at, end in zip(starts, ends)])
                a.extend(starts)
                b.extend(ends)
                counts.append(len(ends))
                sizes.append(len(data))
            text_of = np.repeat(np.arange(len(counts)), counts)
            # big-endian halves, moved to the signed range in order
            halves = (np.frombuffer(b"".join(digests), ">u8").astype(np.uint64) ^ np.uint64(1 << 63)).view(np.int64).reshape(-1, 2)
            own = pa.array(text_of)
            yield pa.RecordBatch.from_arrays(
                [pa.array(halves[:, 0]), pa.array(halves[:, 1]), batch.column("doc_id").take(own), batch.column("row").take(own),
                 pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(np.array(sizes, np.int32)[text_of])],
                names=["high", "low", "doc_id", "row", "a", "b", "size"])

    return rows.select("doc_id", "row", "text").mapInArrow(run, "high long, low long, doc_id long, row long, a int, b int, size int")


def _runs(marks: list[dict]) -> list[list[dict]]:
    """A text's repeated chunks as runs of neighbours."""
    runs: list[list[dict]] = []
    for mark in sorted(marks, key=lambda m: m["a"]):
        if runs and runs[-1][-1]["b"] == mark["a"]:
            runs[-1].append(mark)
        else:
            runs.append([mark])
    return runs


def passages(marks: list[dict], size: int, run_bytes: int = RUN) -> list[dict]:
    """The repeated chunks (a, b, gone) of a text of ``size`` bytes that lie in long enough runs,
    or in runs marked as ``common`` (within ``run_bytes`` that occur elsewhere too): the definition
    for one text, which ``Runs`` applies to a batch."""
    return [m for run in _runs(marks) if run[-1]["b"] - run[0]["a"] >= min(run_bytes, size) or any(m.get("common") for m in run) for m in run]


class Runs:
    """The repeated chunks of a batch of texts (marks: structs with a, b; size) as runs of neighbours.

    ``columns`` holds the structs' fields by text and offset, ``text`` each chunk's text, ``run`` its
    run and ``long`` whether the run has ``run_bytes`` bytes or the whole text.
    """

    def __init__(self, batch: pa.RecordBatch, run_bytes: int = RUN):
        marks = batch.column("marks")
        flat = marks.flatten()
        text = np.repeat(np.arange(len(marks)), np.diff(marks.offsets.to_numpy()))
        columns = {f.name: flat.field(f.name).to_numpy(zero_copy_only=False) for f in flat.type}
        order = np.lexsort((columns["a"], text))
        self.columns, self.text = {name: column[order] for name, column in columns.items()}, text[order]
        a, b = self.columns["a"], self.columns["b"]
        begins = np.ones(len(a), bool)
        begins[1:] = (self.text[1:] != self.text[:-1]) | (b[:-1] != a[1:])
        self.first = np.flatnonzero(begins)
        self.run = np.cumsum(begins) - 1
        last = np.append(self.first[1:], len(a)) - 1 if len(a) else self.first
        sizes = batch.column("size").to_numpy(zero_copy_only=False)[self.text[self.first]]
        self.long = (b[last] - a[self.first] >= np.minimum(run_bytes, sizes))[self.run]

    def any(self, marked: np.ndarray) -> np.ndarray:
        """For each chunk, whether one of its run is marked."""
        return np.logical_or.reduceat(marked, self.first)[self.run] if len(marked) else marked


def _short_runs(run_bytes: int):
    """The repeated chunks whose run is shorter than ``run_bytes``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            runs = Runs(batch, run_bytes)
            short = ~runs.long
            yield pa.RecordBatch.from_arrays(
                [batch.column("row").take(pa.array(runs.text[short])), *[pa.array(runs.columns[c][short]) for c in ("a", "high", "low")]],
                names=["row", "a", "high", "low"])

    return run


_PLACED = "row long, at int, hash long, asks boolean"


def _placed(batch: pa.RecordBatch, places: list[np.ndarray], hashes: list[np.ndarray], asks: list[np.ndarray]) -> pa.RecordBatch:
    rows = np.repeat(batch.column("row").to_numpy(zero_copy_only=False), [len(x) for x in places])
    return pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(np.concatenate(places).astype(np.int32)),
                                       pa.array(np.concatenate(hashes).view(np.int64)), pa.array(np.concatenate(asks))],
                                      names=["row", "at", "hash", "asks"])


def holding(marks: list[dict], size: int, run_bytes: int) -> np.ndarray:
    """Which starts of RUN bytes in a text of ``size`` bytes hold one of the marks."""
    held = np.zeros(max(0, size - run_bytes + 1), bool)
    for m in marks:
        held[max(0, m["b"] - run_bytes):m["a"] + 1] = True
    return held


def window_parts(data: np.ndarray, marks: list[dict], run_bytes: int) -> tuple[np.ndarray, np.ndarray, int, Rolling]:
    """Starts of the RUN bytes that hold a mark, the start of the part each chooses, the part's length and the hashes.

    Of RUN bytes the leftmost smallest hash of a string names an anchor; the part is the anchor
    with half of the remaining bytes, on the side that has them.
    """
    strings = 1 << (run_bytes * 2 // 3).bit_length() - 1
    length, half = run_bytes - strings + 1, strings // 2
    rolled = Rolling(data)
    starts = np.flatnonzero(holding(marks, len(data), run_bytes))
    if not len(starts):
        return starts, starts, length + half, rolled
    anchor = window_minima(rolled.windows(length), strings)[starts]
    return starts, np.where(anchor - starts >= half, anchor - half, anchor), length + half, rolled


def _parts(run_bytes: int):
    """The parts that RUN bytes around marked chunks choose, once each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            places, hashes, asks = [], [], []
            for text, marks in zip(batch.column("text").to_pylist(), batch.column("marks").to_pylist()):
                data = np.frombuffer(text.encode(), np.uint8)
                starts, chosen, length, rolled = window_parts(data, marks, run_bytes)
                asking = holding([m for m in marks if m["asks"]], len(data), run_bytes)[starts]
                places.append(np.unique(chosen))
                hashes.append(rolled.windows(length)[places[-1]] if len(chosen) else np.empty(0, np.uint64))
                asks.append(np.isin(places[-1], chosen[asking]))
            yield _placed(batch, places, hashes, asks)

    return run


def _windows(run_bytes: int):
    """The RUN bytes around marked chunks whose part is one of ``alive``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            places, hashes, asks = [], [], []
            for text, marks, alive in zip(*(batch.column(c).to_pylist() for c in ("text", "marks", "alive"))):
                data = text.encode()
                starts, chosen, _, _ = window_parts(np.frombuffer(data, np.uint8), marks, run_bytes)
                places.append(starts[np.isin(chosen, alive)])
                asks.append(holding([m for m in marks if m["asks"]], len(data), run_bytes)[places[-1]])
                hashes.append(np.fromiter((xxhash.xxh3_64_intdigest(data[at:at + run_bytes]) for at in places[-1].tolist()), np.uint64, len(places[-1])))
            yield _placed(batch, places, hashes, asks)

    return run


def _covered(run_bytes: int):
    """row, a of the marks that lie in RUN bytes starting at one of ``common``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows, starts = [], []
            for row, marks, common in zip(*(batch.column(c).to_pylist() for c in ("row", "marks", "common"))):
                common = np.sort(common)
                a, b = (np.array([m[c] for m in marks]) for c in "ab")
                inside = a[np.searchsorted(common, a, "right") > np.searchsorted(common, b - run_bytes)]
                rows.extend([row] * len(inside))
                starts.extend(inside.tolist())
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(starts, pa.int32())], names=["row", "a"])

    return run


def _twice(placed: DataFrame, name: str) -> DataFrame:
    """row and the offsets, as a list, of what some place asks for and occurs at two places at
    least: in two texts, or at two offsets of one."""
    place = F.struct("row", "at")
    twice = placed.groupBy("hash").agg(F.min(place).alias("low"), F.max(place).alias("high"), F.max("asks").alias("asked"))
    twice = twice.filter("asked AND low <> high").select("hash")
    return placed.join(twice, "hash", "left_semi").groupBy("row").agg(F.collect_list("at").alias(name))  # no more than the text's bytes


def _common_chunks(texts: DataFrame, marks: DataFrame, run_bytes: int) -> DataFrame:
    """row, a of the asking chunks (row, marks: a, b, asks) that lie in ``run_bytes`` bytes that
    another place around a marked chunk holds too."""
    marks = saved(marks, "short-marks")
    around = texts.join(marks, "row")
    parts = saved(around.mapInArrow(_parts(run_bytes), _PLACED), "chosen-parts")
    windows = saved(around.join(_twice(parts, "alive"), "row").mapInArrow(_windows(run_bytes), _PLACED), "common-windows")
    asking = marks.select("row", F.filter("marks", lambda m: m["asks"]).alias("marks")).filter("size(marks) > 0")
    return asking.join(_twice(windows, "common"), "row").mapInArrow(_covered(run_bytes), "row long, a int")


def _long_runs(run_bytes: int):
    """Of each text the repeated chunks that lie in long enough runs, or in runs marked as ``common``
    (within ``run_bytes`` that occur elsewhere too), and which of them go."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            runs, n = Runs(batch, run_bytes), batch.num_rows
            found = runs.long | runs.any(runs.columns["common"])
            gone = found & runs.columns["gone"]
            a, b, text = runs.columns["a"][gone], runs.columns["b"][gone], runs.text[gone]
            removed = np.bincount(text, minlength=n)
            spans = pa.ListArray.from_arrays(np.cumsum([0, *removed]).astype(np.int32), pa.StructArray.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(np.bincount(runs.text[found], minlength=n), pa.int64()), pa.array(removed, pa.int64()),
                 pa.array(np.bincount(text, weights=b - a, minlength=n).astype(np.int64)), spans],
                names=["row", "n_repeated", "n_removed", "removed_bytes", "spans"])

    return run


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 64):
        kept = []
        for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
            data = np.frombuffer(text.encode(), np.uint8)
            keep = np.ones(len(data), bool)
            for span in spans:
                keep[span["a"]:span["b"]] = False
            kept.append(data[keep].tobytes().decode())
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(kept, pa.string())], names=["row", "kept_text"])


def dedup_chunks(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", run_bytes: int = RUN) -> DataFrame:
    """doc_id, n_bytes, n_repeated (chunks in repeated passages), n_removed, removed_bytes, kept_text."""
    rows = only(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), text_or_empty().alias("text"))
    rows = rows.withColumn("row", F.xxhash64("doc_id", "text"))
    found = chunks(rows)
    place = F.struct("doc_id", "row", "a")
    digests = saved(found.groupBy("high", "low").agg(F.count("*").alias("times"), F.min(place).alias("first"))
                    .filter("times > 1").select("high", "low", "first"), "chunk-digests")
    marked = found.join(digests, ["high", "low"])
    marked = marked.groupBy("row", "a", "b").agg(F.first("size").alias("size"), F.first("high").alias("high"), F.first("low").alias("low"), F.first(~place.eqNullSafe(F.col("first"))).alias("gone"))
    marked = saved(marked, "chunk-marks")
    texts = rows.dropDuplicates(["row"]).select("row", "text")
    if run_bytes:
        marks = marked.groupBy("row").agg(  # no more than the text's chunks
            F.first("size").alias("size"), F.collect_list(F.struct("a", "b", "high", "low")).alias("marks"))
        short = saved(marks.mapInArrow(_short_runs(run_bytes), "row long, a int, high long, low long"), "short-runs")
        # all their occurrences, as one of them may lie in a longer run elsewhere; of equal texts one
        # is enough, as all their chunks are in runs that are long enough
        one = rows.groupBy(F.xxhash64("text").alias("t"), F.octet_length("text").alias("n")).agg(F.min("row").alias("row")).select("row")
        marks = marked.join(short.select("high", "low").distinct(), ["high", "low"], "left_semi").join(one, "row", "left_semi")
        marks = marks.join(short.select("row", "a", F.lit(True).alias("asks")), ["row", "a"], "left")
        marks = marks.groupBy("row").agg(F.collect_list(F.struct("a", "b", F.coalesce("asks", F.lit(False)).alias("asks"))).alias("marks"))
        common = _common_chunks(texts, marks, run_bytes).withColumn("common", F.lit(True))
        marked = marked.join(common, ["row", "a"], "left")
    else:
        marked = marked.withColumn("common", F.lit(True))
    marks = marked.groupBy("row").agg(
        F.first("size").alias("size"), F.collect_list(F.struct("a", "b", "gone", F.coalesce("common", F.lit(False)).alias("common"))).alias("marks"))
    per_row = saved(marks.mapInArrow(
        _long_runs(run_bytes), "row long, n_repeated long, n_removed long, removed_bytes long, spans array<struct<a:int,b:int>>"), "chunk-spans")
    cut = saved(texts.join(per_row.filter("n_removed > 0").select("row", "spans"), "row")
                .mapInArrow(_cut_out, "row long, kept_text string"), "cut-texts")
    changes = per_row.drop("spans").join(cut, "row", "left")
    return rows.join(changes, "row", "left").select(
        "doc_id", F.octet_length("text").cast("long").alias("n_bytes"),
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_repeated", "n_removed", "removed_bytes")],
        F.coalesce("kept_text", "text").alias("kept_text"))
