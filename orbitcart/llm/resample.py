"""Target-distribution importance resampling (operator 11) with hashed word n-grams.

Words are runs of digits, letters a-z (A-Z lower-cased) and characters beyond ASCII; features
are all runs of 1 to 3 words joined by one space, each counted in the bucket crc32 mod
``BUCKETS``. A bucket's gain is the floored logarithm of its smoothed frequency in the target
texts over that in all documents; a document's weight is the sum over its features, and a
Gumbel draw from its id turns weights into a sample without replacement by the highest scores.

Both passes over the documents intern the n-grams of a segment of text in an open-addressed
NumPy table (``ngram_table``): each distinct n-gram has one entry with its bucket and its
count, and every occurrence the number of its entry. The first pass adds counts by bucket; the
second gathers gains by entry number and sums them by document. Bucket counts leave a task as at most
``BUCKETS`` rows; only the summed counts of the buckets reach the driver, and their gains the tasks
(a number of rows that the parameter fixes). Ranks come from a distributed row number.

Defined cases: null and empty texts have no words, no features and weight 0; a null id hashes as
an empty one and comes first among equal scores; repeated rows each take a rank of their own; an
empty table gives no rows, an empty target only its smoothing; other columns are not read. Very
long texts are processed whole, in segments of about ``SEGMENT`` bytes that overlap by two words.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbitcart.functions.ordering import with_global_row_number
from orbitcart.llm.common import only, saved, slices, text_or_empty
from orbitcart.llm.ngram_table import PADDING, crc32, intern, lanes

BUCKETS, LONGEST, MIN_WORDS, PERCENT, SEED = 10_000, 3, 20, 5, 42
#: Bytes of text whose n-grams share one table.
SEGMENT = 1 << 19
#: Rows of an Arrow batch that are handled together.
BATCH_ROWS = 256
SPACE, END = 0x20, 0x0A


def _byte_classes() -> bytes:
    """Upper-case letters to lower-case ones, word bytes to themselves, all else to a space."""
    table = bytearray([SPACE]) * 256
    for byte in (*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)):
        table[byte] = byte
    for byte in range(0x41, 0x5B):
        table[byte] = byte + 32
    return bytes(table)


BYTE_CLASSES = _byte_classes()


class Interned(NamedTuple):
    """The n-grams of a segment: bucket and count of each entry, entry and text of each occurrence."""
    bucket: np.ndarray
    count: np.ndarray
    slots: np.ndarray
    owner: np.ndarray
    words: np.ndarray  # the text of each word


def _past(flags: np.ndarray, at: int, value: bool) -> int:
    """The first position from ``at`` on that does not hold ``value``."""
    rest = flags[at:]
    step = int(rest.argmin() if value else rest.argmax()) if len(rest) else 0
    return at + step if step < len(rest) and rest[step] != value else len(flags)


def normal_form(texts: list[bytes]) -> np.ndarray:
    """The words of all texts, one space after each word at most, and an end byte after each text."""
    data = np.frombuffer(bytes([END]).join([t.translate(BYTE_CLASSES) for t in texts] + [b""]), np.uint8)
    drop = data == SPACE
    drop[1:] &= (data[:-1] == SPACE) | (data[:-1] == END)
    return data[~drop]


def interned(texts: list[bytes], buckets: int = BUCKETS, longest: int = LONGEST, segment: int = SEGMENT) -> Iterator[Interned]:
    data = normal_form(texts)
    is_word = (data != SPACE) & (data != END)
    begin, texts_before = 0, 0
    while begin < len(data):
        end = min(len(data), begin + segment)
        if is_word[end - 1]:
            end = _past(is_word, end, True)
        reach = end
        for _ in range(longest - 1):
            reach = _past(is_word, _past(is_word, reach, False), True)
        part = np.concatenate([data[begin:reach], np.zeros(PADDING, np.uint8)])
        edges = np.flatnonzero(np.diff(np.concatenate([[False], is_word[begin:reach], [False]]).astype(np.int8)))
        first, last = edges[::2], edges[1::2]
        text = texts_before + np.searchsorted(np.flatnonzero(part == END), first)
        own = int(np.searchsorted(first, end - begin))
        starts, lengths, owners = [], [], []
        for words in range(1, longest + 1):
            at = np.arange(min(own, len(first) - words + 1))
            at = at[text[at] == text[at + words - 1]]
            starts.append(first[at])
            lengths.append(last[at + words - 1] - first[at])
            owners.append(text[at])
        start, length, owner = map(np.concatenate, (starts, lengths, owners))
        entries, slots = intern(lanes(part), start, length)
        yield Interned(crc32(part, start[entries], length[entries]) % buckets,
                       np.bincount(slots, minlength=len(entries)), slots, owner, text[:own])
        texts_before += int(np.count_nonzero(data[begin:end] == END))
        begin = end


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return batch.column("text").cast(pa.binary()).to_pylist()


def bucket_counts(texts: DataFrame, buckets: int, longest: int) -> np.ndarray:
    """How many features of all texts fall into each bucket."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in slices(batches, BATCH_ROWS):
            for found in interned(_texts(batch), buckets, longest):
                total += np.bincount(found.bucket, found.count, buckets).astype(np.int64)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], ["bucket", "n"])

    rows = texts.select("text").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    for row in rows:  # as many rows as buckets at most
        out[row["bucket"]] = row["n"]
    return out


def gains(all_counts: np.ndarray, target_counts: np.ndarray) -> np.ndarray:
    """floor(1000 ln of a bucket's smoothed share in the target over that in all documents)."""
    buckets = len(all_counts)
    share = (target_counts + 1) * float(all_counts.sum() + buckets) / ((all_counts + 1) * float(target_counts.sum() + buckets))
    return np.floor(1000 * np.log(share)).astype(np.int64)


def weighted(rows: DataFrame, gain: np.ndarray, longest: int) -> DataFrame:
    """doc_id, n_words, n_features, weight of each row (doc_id, text)."""
    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, BATCH_ROWS):
            n = batch.num_rows
            words, features, weight = np.zeros((3, n), np.int64)
            for found in interned(_texts(batch), len(gain), longest):
                words += np.bincount(found.words, minlength=n)
                features += np.bincount(found.owner, minlength=n)
                weight += np.bincount(found.owner, gain[found.bucket][found.slots], n).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, (words, features, weight))],
                                             ["doc_id", "n_words", "n_features", "weight"])

    return rows.mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")


def gumbel(seed: int, id_col: str) -> Column:
    """floor(-1000 ln(-ln u)) with u from the first 8 hex digits of the sha256 of ``seed:id``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))


def importance_resample(docs: DataFrame, target: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                        target_col: str = "text", buckets: int = BUCKETS, longest: int = LONGEST,
                        min_words: int = MIN_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score and rank (null where not drawn) of every document.

    Of the documents with ``min_words`` words or more, ``percent`` percent (floored) are drawn.
    """
    rows = only(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), text_or_empty().alias("text"))
    wanted = only(target, text=target_col).select(text_or_empty().alias("text"))
    gain = gains(bucket_counts(rows, buckets, longest), bucket_counts(wanted, buckets, longest))
    scored = weighted(rows, gain, longest).withColumn("score", F.col("weight") + gumbel(seed, "doc_id"))
    scored = saved(scored, "resample-scores")
    able = scored.filter(F.col("n_words") >= min_words)
    drawn = able.agg(F.floor(percent * F.count(F.lit(1)) / 100)).scalar()
    order = [F.desc("score"), F.asc("doc_id"), F.asc("n_features"), F.asc("weight")]
    ranked = with_global_row_number(able, order, "place").withColumn("rank", F.when(F.col("place") <= drawn, F.col("place")))
    columns = ["doc_id", "n_features", "weight", "score", F.col("rank").cast("long").alias("rank")]
    rest = scored.filter(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long"))
    return ranked.select(*columns).unionByName(rest.select(*columns))
