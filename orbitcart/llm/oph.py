"""Near-duplicate documents by one-permutation MinHash (operator 5).

1. One pass over the texts gives each document its shingle-set size, a 128-bit digest of the
   set and a one-permutation MinHash signature: each shingle hash falls in one bin, a bin
   keeps its smallest; an empty bin borrows from the first filled bin of its own random probe
   order (optimal densification), so a bin of two documents agrees with probability equal to
   their similarity. Bins are grouped in bands, and a band's values make a bucket key.
2. Documents of equal sets are one class; only one representative goes on.
3. In each bucket one member is the hub; only hub-member pairs (a star) are candidates, so a
   bucket of m members gives m - 1 pairs. Pairs are confirmed on the full sets.
4. Confirmed links give components. Only buckets that still hold several components go on:
   there the members outside the bucket's largest component are looked up in an inverted index
   of all members' sets, so no link within a bucket is lost and no pairs are listed. An index
   holds a block of members of bounded size; a large bucket has several blocks.

Shingles are compared by 64-bit hashes (a set of a million shingles has two equal hashes
with a probability of 3e-8). With 48 bands of 5 bins a pair of similarity 0.75 misses all
buckets with a probability of 2e-6.

Defined cases: null and wordless texts have no shingles and link with nothing; fewer words
than a shingle are one shingle; rows of equal texts are one class; a null id takes no part
(component null, kept true); texts whose smallest ids are equal count as one document; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbitcart.llm.common import components, cut, only, packed, saved, slices, text_or_empty

BANDS, BAND_BINS = 48, 5
SHINGLE_WORDS, PERCENT = 5, 75
#: Members of one hub that are confirmed in one group.
STAR_ROWS = 64
#: Shingles in one block of an open bucket's index.
BLOCK_SHINGLES = 1_000_000

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xFF51AFD7ED558CCD)
_SHIFT = np.uint64(33)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 150_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_words = _WordHashes()


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _SHIFT)) * _MIX
    return h ^ (h >> _SHIFT)


def shingle_set(text: str, words: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles (A-Z lower-cased)."""
    found = text.encode().lower().split()
    if not found:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(_words.__getitem__, found), np.uint64, len(found))
    width = min(words, len(found))
    out = np.full(len(found) - width + 1, width, np.uint64)
    for at in range(width):
        out = out * _ODD + hashes[at:at + len(out)]
    return np.unique(_mixed(out))


@lru_cache(maxsize=4)
def _probe_ranks(bins: int) -> np.ndarray:
    """Row i: the place of each bin in the probe order of bin i."""
    return np.random.default_rng(5).permuted(np.tile(np.arange(bins, dtype=np.uint16), (bins, 1)), axis=1)


def signature(shingles: np.ndarray, bins: int) -> np.ndarray:
    """One-permutation MinHash with optimal densification of sorted shingle hashes."""
    own = ((shingles >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)
    first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    filled = own[first].astype(np.intp)
    sig = np.zeros(bins, np.uint64)
    sig[filled] = shingles[first]  # sorted, so the first of a bin is its smallest
    if len(filled) < bins:
        empty = np.setdiff1d(np.arange(bins), filled, assume_unique=True)
        donors = filled[np.argmin(_probe_ranks(bins)[np.ix_(empty, filled)], axis=1)]
        sig[empty] = sig[donors]
    return sig


def band_keys(sig: np.ndarray, bands: int) -> np.ndarray:
    rows = sig.reshape(bands, -1)
    keys = np.arange(1, bands + 1, dtype=np.uint64)
    for at in range(rows.shape[1]):
        keys = _mixed(keys * _ODD + rows[:, at])
    return keys


def signatures(docs: DataFrame, *, bands: int = BANDS, band_bins: int = BAND_BINS, words: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, n_shingles, high, low (128-bit digest of the set), bands (null if no shingles)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sizes, high, low, keys = [], [], [], []
            for text in batch.column("text").to_pylist():
                shingles = shingle_set(text, words)
                digest = xxhash.xxh3_128_digest(shingles.tobytes())
                sizes.append(len(shingles))
                high.append(int.from_bytes(digest[:8], "big", signed=True))
                low.append(int.from_bytes(digest[8:], "big", signed=True))
                keys.append(band_keys(signature(shingles, bands * band_bins), bands).view(np.int64) if len(shingles) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(high, pa.int64()), pa.array(low, pa.int64()),
                 pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "high", "low", "bands"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, high long, low long, bands array<long>")


def confirm(pairs: DataFrame, texts: DataFrame, *, words: int = SHINGLE_WORDS, percent: int = PERCENT) -> DataFrame:
    """The pairs (hub, member) whose full sets have 100 * intersection >= percent * union.

    A hub's members are dealt out in groups of about STAR_ROWS, each with a copy of the hub;
    a task streams its sorted groups and holds one hub's set at a time.
    """
    sized = pairs.groupBy("hub").agg(F.ceil(F.count("*") / STAR_ROWS).alias("parts"))
    dealt = pairs.join(sized, "hub").withColumn("part", F.pmod(F.xxhash64("member"), F.col("parts")))
    texts = texts.select(F.col("doc_id").alias("id"), "text")
    members = dealt.join(texts, dealt.member == texts.id).select("hub", "part", F.lit(1).alias("role"), "id", "text")
    hubs = dealt.select("hub", "part").distinct()
    hubs = hubs.join(texts, hubs.hub == texts.id).select("hub", "part", F.lit(0).alias("role"), "id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, sets = None, []
        for batch in slices(batches):
            hub_ids, member_ids = [], []
            for hub, part, role, ident, text in zip(*(batch.column(c).to_pylist() for c in ("hub", "part", "role", "id", "text"))):
                if (hub, part) != group:
                    group, sets = (hub, part), []
                shingles = shingle_set(text, words)
                if role == 0:
                    sets.append(shingles)
                    continue
                for own in sets:
                    few, many = sorted((len(own), len(shingles)))
                    if 100 * few < percent * many:
                        continue
                    both = len(np.intersect1d(own, shingles, assume_unique=True))
                    if 100 * both >= percent * (few + many - both):
                        hub_ids.append(hub)
                        member_ids.append(ident)
                        break
            yield pa.RecordBatch.from_arrays([pa.array(hub_ids, pa.int64()), pa.array(member_ids, pa.int64())], names=["hub", "member"])

    rows = members.union(hubs).repartition("hub", "part").sortWithinPartitions("hub", "part", "role")
    return rows.mapInArrow(run, "hub long, member long").distinct()


class _Index:
    """Shingle sets of a block of documents, by shingle."""

    def __init__(self, ids: list[int], labels: list[int], sets: list[np.ndarray]):
        self.ids, self.labels, self.sizes = ids, np.array(labels), np.array([len(x) for x in sets])
        shingles, owners = np.concatenate(sets), np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(shingles, kind="stable")
        self.owners = owners[order]
        self.shingles, self.starts = np.unique(shingles[order], return_index=True)
        self.ends = np.append(self.starts[1:], len(order))

    def links(self, own: np.ndarray, label: int, percent: int) -> list[int]:
        """One similar document of each other component."""
        at = np.searchsorted(self.shingles, own)
        at = at[(at < len(self.shingles)) & (self.shingles[np.minimum(at, len(self.shingles) - 1)] == own)]
        starts, counts = self.starts[at], self.ends[at] - self.starts[at]
        places = np.repeat(starts - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum()) if len(at) else at
        both = np.bincount(self.owners[places], minlength=len(self.ids))
        found = np.flatnonzero((100 * both >= percent * (self.sizes + len(own) - both)) & (self.labels != label))
        return [self.ids[i] for i in found[np.unique(self.labels[found], return_index=True)[1]]]


def look_up(active: DataFrame, texts: DataFrame, *, words: int = SHINGLE_WORDS, percent: int = PERCENT) -> DataFrame:
    """Links (hub, member) between components within each bucket of ``active`` (bucket, node, n, label)."""
    per_label = active.groupBy("bucket", "label").agg(F.count("*").alias("m"), F.sum("n").alias("shingles"))
    buckets = per_label.groupBy("bucket").agg(F.max_by("label", F.struct("m", "label")).alias("main"),
                                              F.ceil(F.sum("shingles") / BLOCK_SHINGLES).cast("int").alias("blocks"))
    placed = active.join(buckets, "bucket")
    index = placed.select("bucket", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"), F.lit(0).alias("role"), "node", "label")
    asked = placed.filter("label <> main").select("bucket", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
                                                  F.lit(1).alias("role"), "node", "label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, members, index = None, [], None
        for batch in slices(batches):
            hubs, found = [], []
            for bucket, block, role, node, label, text in zip(*(batch.column(c).to_pylist() for c in ("bucket", "block", "role", "node", "label", "text"))):
                if (bucket, block) != group:
                    group, members, index = (bucket, block), [], None
                shingles = shingle_set(text, words)
                if role == 0:
                    members.append((node, label, shingles))
                elif members:
                    index = index or _Index(*zip(*members))
                    linked = index.links(shingles, label, percent)
                    hubs.extend([node] * len(linked))
                    found.extend(linked)
            yield pa.RecordBatch.from_arrays([pa.array(hubs, pa.int64()), pa.array(found, pa.int64())], names=["hub", "member"])

    rows = index.union(asked).join(texts.select(F.col("doc_id").alias("node"), "text"), "node")
    rows = rows.repartition("bucket", "block").sortWithinPartitions("bucket", "block", "role")
    return rows.mapInArrow(run, "hub long, member long").distinct()


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", bands: int = BANDS,
                    band_bins: int = BAND_BINS, words: int = SHINGLE_WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs``."""
    spark = docs.sparkSession
    rows = only(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), text_or_empty().alias("text"))
    signed = saved(signatures(rows, bands=bands, band_bins=band_bins, words=words), "signatures")
    taking_part = signed.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = (taking_part.groupBy("high", "low")
               .agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")))
    keyed = classes.select("node", "n", F.explode("bands").alias("bucket"))
    shared = saved(keyed.groupBy("bucket").agg(F.count("*").alias("m")).filter("m > 1").select("bucket"), "buckets")
    members = saved(keyed.join(shared, "bucket"), "members")
    # the texts that any pair may need, written once; all rounds read these
    texts = saved(rows.join(members.select(F.col("node").alias("doc_id")).distinct(), "doc_id"), "texts")


    # the first star: each bucket's hub and its members
    hub = F.struct(F.xxhash64("node").alias("place"), "node", "n").alias("hub")
    first = members.groupBy("bucket").agg(F.min(hub).alias("hub"))
    met = members.join(first, "bucket").filter("node <> hub.node")
    met = met.filter(f"100 * least(n, hub.n) >= {percent} * greatest(n, hub.n)")
    pairs = cut(met.select(F.col("hub.node").alias("hub"), F.col("node").alias("member")).distinct())
    links = cut(confirm(packed(pairs, pairs.count()), texts, words=words, percent=percent))
    labels = components(links.toDF("a", "b"))

    # buckets that hold several components
    named = members.join(labels, members.node == labels.id, "left").select("bucket", "node", "n", F.coalesce("component", "node").alias("label"))
    several = saved(named.groupBy("bucket").agg(F.min("label").alias("least"), F.max("label").alias("most"))
                    .filter("least <> most").select("bucket"), "open-buckets")
    active = saved(named.join(several, "bucket"), "open-members")
    found = cut(look_up(active, texts, words=words, percent=percent))
    if not found.isEmpty():
        labels = components(links.union(found).toDF("a", "b"))

    nodes = classes.select("high", "low", "node").join(labels, F.col("node") == labels.id, "left").select(
        "high", "low", F.coalesce("component", "node").alias("class_component"))
    component = F.when(F.col("n_shingles") > 0, F.coalesce("class_component", "doc_id")).otherwise(F.col("doc_id"))
    return (signed.join(nodes, ["high", "low"], "left")
            .select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))))
