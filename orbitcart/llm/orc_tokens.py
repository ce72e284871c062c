"""Token-id output as ORC files (operator 4).

Documents are range-partitioned and sorted by id *as text* (smaller than their ids), encoded
where they are written, and stored with ORC's run-length integer encoding, row indexes and
Bloom filters on the document id. Readers prune stripes and row groups by document id and
read stripes in parallel. Each file is one contiguous range of documents in ascending order.

Defined cases: a null text is an empty one (only the end id is written); a null id sorts
first; rows that repeat an id are each written, ordered by text hash; an empty table gives
no rows; other columns are not read.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orbitcart.llm.common import bounded, only, slices, text_or_empty
from orbitcart.llm.pieces import TAIL, Generations, cut_at_space, cut_tail

#: New pieces that one call of the library encodes.
PIECES_A_CALL = 4096
#: Texts that are cut at once, and their bytes if they are several.
BATCH_ROWS, BATCH_BYTES = 2048, 8 << 20
_STORED = "doc_id long, part int, part_start long, n_tokens long, ids array<int>"


def _strings(array: pa.Array) -> list[str]:
    return array.to_numpy(zero_copy_only=False).tolist()


class _Library:
    """The tokenizers library on the text pieces of a batch.

    A batch is cut into pieces and its distinct pieces are found by Arrow's kernels; each new one is
    encoded once, marks at its end apart: new pieces are joined, encoded by one call and told apart by
    the tokens that begin with a space or a line break. Texts in which white space meets a cut are cut between other
    characters and white space only, and their pieces are encoded apart.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        vocab = self.library.get_vocab(with_added_tokens=True)
        self.begins = np.zeros(max(vocab.values()) + 1, bool)
        self.begins[[i for token, i in vocab.items() if token[0] in "\u0120\u010a"]] = True  # a space, a line break

    def apart(self, texts: list[str]) -> list[bytes]:
        return [np.array(coded.ids, "<u4").tobytes() for coded in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def joined(self, pieces: list[str]) -> list[bytes]:
        """The ids of each piece; every piece begins with its only space or line break and ends without one."""
        ids = np.array(self.library.encode_batch_fast(["".join(pieces)], add_special_tokens=False)[0].ids, "<u4")
        cuts = (4 * np.append(np.flatnonzero(self.begins[ids]), len(ids))).tolist()
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def remember(self, cache: Generations, pieces: Iterable[str], encode: Callable[[list[str]], list[bytes]]) -> None:
        new = [piece for piece in pieces if piece not in cache]
        for at in range(0, len(new), PIECES_A_CALL):
            some = new[at:at + PIECES_A_CALL]
            for piece, ids in zip(some, encode(some), strict=True):
                cache.put(piece, ids)

    def coded(self, texts: pa.Array, cache: Generations, end: bytes = b"") -> tuple[pa.Array, np.ndarray]:
        """The ids of all texts, one after the other, and how many each has; ``end`` (ids) closes each text."""
        cut = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        distinct = cut.flatten().dictionary_encode()
        ends = cut.offsets.to_numpy().astype(np.int64)
        counts, first, codes = np.diff(ends), ends[:-1] - ends[0], distinct.indices.to_numpy()
        n, found = len(distinct.dictionary), distinct.dictionary
        heads = _strings(found.take(pa.array(codes[first])))  # a text's head has no space before it
        keys = pc.if_else(pc.starts_with(found, "\n"), found, pc.binary_join_element_wise("", found, " "))
        trimmed = pc.utf8_rtrim(keys, TAIL)
        names, cores = _strings(keys), _strings(trimmed)
        blank = np.fromiter((name[-1].isspace() for name in names), bool, n)
        blank_heads = np.fromiter((not head or head[-1].isspace() for head in heads), bool, len(heads))
        inner = blank[codes]
        inner[first] = blank_heads
        odd = np.logical_or.reduceat(inner, first) if len(first) else blank_heads
        used, rest = np.zeros(n, bool), ~np.repeat(odd, counts)  # rest: pieces of texts that are not odd
        rest[first] = False
        used[codes[rest]] = True

        tails = {}
        marked = used & pc.not_equal(pc.binary_length(keys), pc.binary_length(trimmed)).to_numpy(zero_copy_only=False)
        for at in np.flatnonzero(marked).tolist():
            cores[at], tails[at] = cut_tail(names[at], cores[at])
        for at in np.flatnonzero(~used).tolist():
            cores[at] = ""
        self.remember(cache, dict.fromkeys(filter(None, cores)), self.joined)
        starts = [cut_at_space(texts[at].as_py()) if o else [head] for at, (head, o) in enumerate(zip(heads, odd.tolist(), strict=True))]
        self.remember(cache, dict.fromkeys([*filter(None, tails.values()), *(piece for pieces in starts for piece in pieces)]), self.apart)
        get = cache.__getitem__
        ids = [get(core) if core else b"" for core in cores]
        for at, tail in tails.items():
            if tail:
                ids[at] += get(tail)
        ids += [b"".join(map(get, pieces)) for pieces in starts]  # a whole odd text stands at its head's place
        ids.append(end)
        cache.shrink()

        rest[first] = True
        codes = codes.astype(np.int32)
        codes[first] = n + np.arange(len(heads), dtype=np.int32)
        counts = np.where(odd, 1, counts)
        closed = np.full(counts.sum() + len(counts), n + len(heads), np.int32)
        pieces = np.ones(len(closed), bool)
        pieces[np.cumsum(counts + 1) - 1] = False
        closed[pieces] = codes[rest]
        offsets = np.cumsum([0, *map(len, ids)], dtype=np.int64) // 4
        lists = pa.LargeListArray.from_arrays(offsets, np.frombuffer(b"".join(ids), np.int32))
        taken = lists.take(pa.array(closed))
        sizes = np.diff(taken.offsets.to_numpy()[np.append(0, np.cumsum(counts + 1))])
        return taken.flatten(), sizes

    def encode_batch(self, texts: list[str], cache: Generations) -> list[bytes]:
        ids, sizes = self.coded(pa.array(texts, pa.string()), cache)
        ends = (4 * np.cumsum(sizes)).tolist()
        raw = ids.to_numpy().tobytes()
        return [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)]


@lru_cache(maxsize=2)
def _library(path: str) -> _Library:
    return _Library(path)


def write_tokens(docs: DataFrame, path: str, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text",
                 end_id: int = 0, stripe_bytes: int = 16 << 20, index_rows: int = 1000) -> None:
    """Encode ``text_col`` with the tokenizers file ``tokenizer`` and write ORC files to ``path``.

    Stored per document: doc_id, part (the file's place in document order), part_start (ids
    before it in that file), n_tokens (with ``end_id``) and ids.
    """
    end = np.array([end_id], "<u4").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library, cache, part, start = _library(tokenizer), Generations(), TaskContext.get().partitionId(), 0
        for batch in bounded(slices(batches, BATCH_ROWS), BATCH_BYTES):
            coded, sizes = library.coded(batch.column("text"), cache, end)
            ends = np.concatenate([[0], np.cumsum(sizes)])
            ids = pa.ListArray.from_arrays(ends.astype(np.int32), coded)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.full(len(sizes), part, np.int32)), pa.array(start + ends[:-1]),
                 pa.array(sizes), ids], names=["doc_id", "part", "part_start", "n_tokens", "ids"])
            start += int(ends[-1])

    rows = only(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), text_or_empty().alias("text"))
    # the text's hash and the row number spread an id that very many rows repeat
    order = [F.col("doc_id"), F.xxhash64("text"), F.monotonically_increasing_id()]
    (rows.repartitionByRange(*order).sortWithinPartitions("doc_id", F.xxhash64("text"))
         .mapInArrow(encode, _STORED).write
         .option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01")
         .option("orc.create.index", "true").option("orc.row.index.stride", str(index_rows))
         .option("orc.stripe.size", str(stripe_bytes)).option("compression", "zstd")
         .orc(path))


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The stored rows with ``start``, the number of ids in all documents before.

    The files' totals come from the two small columns alone; they are one row per file, so
    they go to every task, and the ids are read stripe by stripe and not moved.
    """
    stored = spark.read.schema(_STORED).orc(path)
    totals = stored.groupBy("part").agg(F.sum("n_tokens").alias("part_tokens"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("part", F.coalesce(F.sum("part_tokens").over(before), F.lit(0)).alias("before"))
    return (stored.join(F.broadcast(offsets), "part")
            .select("doc_id", (F.col("before") + F.col("part_start")).alias("start"), "n_tokens", "ids"))


def lookup(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """Token ids of a few documents; the filter reaches ORC's indexes and Bloom filters."""
    return spark.read.schema(_STORED).orc(path).filter(F.col("doc_id").isin(doc_ids)).select("doc_id", "ids")


def digests(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (unsigned, of the ids as little-endian 32-bit integers)."""
    def crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            at, flat = ids.offsets.to_numpy(), ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            sums = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"), pa.array(sums, pa.int64())],
                names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return tokens.mapInArrow(crc, "doc_id long, start long, n_tokens long, ids_crc32 long")
