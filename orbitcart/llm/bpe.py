"""Byte-level BPE encoding and decoding with a segment tree over pair ranks (operator 6).

Each pre-token is a leaf row of adjacent pairs; a leaf holds (merge rank, position) and each
inner node the smaller of its two children, so the root is the leftmost pair of lowest rank.
A merge changes at most three leaves, each with a logarithmic number of node updates, until
no pair can be merged. A pre-token of n bytes costs O(n log n), however long it is. The trees of
all new short pre-tokens of a batch are the rows of one matrix and merge together, one pair of each
a round (``merge_many``); long pre-tokens have a tree of their own (``merge``).

A task keeps the ids of text pieces in a cache that is bounded in bytes and ends with the task;
only the vocabulary's tables stay in a worker.

Defined cases: a null text is an empty one (no ids, empty decoding); every row is answered,
repeated ids and texts too; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbitcart.llm.common import only, slices, text_or_empty
from orbitcart.llm.pieces import STABLE, Generations, cut_pieces

# Fixed value: the published pre-token pattern of the byte-level BPE vocabulary.
PRE_TOKENS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Longest pre-token in bytes that merges in the matrix of its batch.
SHORT = 64
_NO_PAIR = 1 << 62
_POSITION = (1 << 32) - 1


def byte_symbols() -> list[str]:
    """The character that stands for each byte: printable bytes themselves, others from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


def merge(symbols: list[int], pairs: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """Merge ``symbols``; ``pairs`` gives the (rank, merged symbol) of each mergeable pair."""
    n = len(symbols)
    if n < 2:
        return symbols
    size = 1 << (n - 2).bit_length()
    tree = [_NO_PAIR] * (2 * size)
    for i in range(n - 1):
        found = pairs.get((symbols[i], symbols[i + 1]))
        if found:
            tree[size + i] = found[0] << 32 | i
    for node in range(size - 1, 0, -1):
        left, right = tree[2 * node], tree[2 * node + 1]
        tree[node] = left if left < right else right
    if tree[1] == _NO_PAIR:
        return symbols
    symbols = symbols[:]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))

    def put(leaf: int, value: int) -> None:
        node = size + leaf
        tree[node] = value
        while node > 1:
            other, node = tree[node ^ 1], node >> 1
            if other < value:
                value = other
            if tree[node] == value:
                return
            tree[node] = value

    while tree[1] != _NO_PAIR:
        i = tree[1] & _POSITION
        j = after[i]
        symbols[i] = pairs[symbols[i], symbols[j]][1]
        after[i] = k = after[j]
        if j < n - 1:
            put(j, _NO_PAIR)
        if k < n:
            before[k] = i
            found = pairs.get((symbols[i], symbols[k]))
            put(i, found[0] << 32 | i if found else _NO_PAIR)
        else:
            put(i, _NO_PAIR)
        h = before[i]
        if h >= 0:
            found = pairs.get((symbols[h], symbols[i]))
            put(h, found[0] << 32 | h if found else _NO_PAIR)
    out, i = [], 0
    while i < n:
        out.append(symbols[i])
        i = after[i]
    return out


class PairTable:
    """(rank, merged symbol) of each mergeable pair, for many pairs at once."""

    def __init__(self, pairs: dict[tuple[int, int], tuple[int, int]]):
        keys = np.array([a << 32 | b for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys = np.append(keys[order], np.iinfo(np.int64).max)
        self.ranks = np.append(np.array([r for r, _ in pairs.values()], np.int64)[order], 0)
        self.merged = np.zeros(1 + max((r for r, _ in pairs.values()), default=0), np.int64)
        for rank, symbol in pairs.values():
            self.merged[rank] = symbol

    def leaves(self, left: np.ndarray, right: np.ndarray, position: np.ndarray) -> np.ndarray:
        """rank and position of each pair as one number, _NO_PAIR where it cannot be merged."""
        keys = left << 32 | right
        at = np.searchsorted(self.keys, keys)
        return np.where(self.keys[at] == keys, self.ranks[at] << 32 | position, _NO_PAIR)


def merge_many(symbols: np.ndarray, lengths: np.ndarray, table: PairTable) -> np.ndarray:
    """Merge each row of ``symbols`` (``lengths`` used symbols, 2^k + 1 columns) in place.

    Row w's tree is tree[w], root at 1, its leaf i the pair that begins at i. Returns which
    symbols are left.
    """
    rows, width = symbols.shape
    size = width - 1
    place = np.arange(width)
    alive = place < lengths[:, None]
    after = np.broadcast_to(place + 1, symbols.shape).copy()
    before = np.broadcast_to(place - 1, symbols.shape).copy()
    tree = np.full((rows, 2 * size), _NO_PAIR, np.int64)
    w, i = np.nonzero(place[:-1] + 1 < lengths[:, None])
    tree[w, size + i] = table.leaves(symbols[w, i], symbols[w, i + 1], i)
    level = size
    while level > 1:
        level >>= 1
        tree[:, level:2 * level] = np.minimum(tree[:, 2 * level:4 * level:2], tree[:, 2 * level + 1:4 * level:2])
    live = np.flatnonzero(tree[:, 1] != _NO_PAIR)
    while len(live):
        root = tree[live, 1]
        i = root & _POSITION
        symbols[live, i] = table.merged[root >> 32]
        j = after[live, i]
        alive[live, j] = False
        k = after[live, j]
        after[live, i] = k
        more, h = k < lengths[live], before[live, i]
        before[live[more], k[more]] = i[more]
        own, last = symbols[live, i], np.minimum(k, size)
        right = np.where(more, table.leaves(own, symbols[live, last], i), _NO_PAIR)
        left = np.where(h >= 0, table.leaves(symbols[live, h], own, h), _NO_PAIR)
        spent = np.minimum(j, size - 1)  # the last symbol begins no pair
        tree[live, size + spent] = _NO_PAIR
        tree[live, size + i] = right
        some = h >= 0
        tree[live[some], size + h[some]] = left[some]
        nodes = [size + spent, size + i, size + np.where(some, h, i)]
        while nodes[0][0] > 1:
            nodes = [node >> 1 for node in nodes]
            for node in nodes:
                tree[live, node] = np.minimum(tree[live, 2 * node], tree[live, 2 * node + 1])
        live = live[tree[live, 1] != _NO_PAIR]
    return alive


class Coder:
    """Encoder and decoder of one tokenizers file (byte-level BPE without normalizer)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, symbols = spec["model"]["vocab"], byte_symbols()
        self.byte_id = np.array([vocab[c] for c in symbols], np.int64)
        self.pairs = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.pairs[vocab[left], vocab[right]] = rank, vocab[left + right]
        self.table = PairTable(self.pairs)
        value = {c: b for b, c in enumerate(symbols)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = {i: bytes(value[c] for c in token) for token, i in vocab.items() if token not in self.special}
        self.bytes_of |= {i: token.encode() for token, i in self.special.items()}
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.find = regex.compile(PRE_TOKENS).findall
        self.library = None
        self.path = path

    def pre_tokens(self, text: str) -> list[str]:
        """The pre-tokens of a text; special tokens are pre-tokens too."""
        if text.isascii() or ord(max(text)) < STABLE:
            find = self.find
        else:
            if self.library is None:  # newer letters: the library's own classes decide
                from tokenizers import Tokenizer
                self.library = Tokenizer.from_file(self.path).pre_tokenizer
            find = lambda part: [part[a:b] for _, (a, b) in self.library.pre_tokenize_str(part)]
        if not self.special or not any(s in text for s in self.special):
            return find(text)
        out = []
        for part in self.split_special.split(text):
            out.extend([part] if part in self.special else find(part) if part else ())
        return out

    def merged(self, tokens: list[str]) -> dict[str, bytes]:
        """The ids of distinct pre-tokens as little-endian unsigned 32-bit integers."""
        out: dict[str, bytes] = {}
        names: list[list[str]] = [[] for _ in range(SHORT.bit_length() + 1)]  # by the trees' levels
        data: list[list[bytes]] = [[] for _ in names]
        for token in tokens:
            if token in self.special:
                out[token] = np.array([self.special[token]], "<u4").tobytes()
                continue
            raw = token.encode()
            if len(raw) <= SHORT:
                levels = max(1, (len(raw) - 2).bit_length()) if len(raw) > 1 else 1
                names[levels].append(token)
                data[levels].append(raw)
            else:
                out[token] = np.array(merge(self.byte_id[list(raw)].tolist(), self.pairs), "<u4").tobytes()
        for levels, group in enumerate(names):
            if not group:
                continue
            lengths = np.fromiter(map(len, data[levels]), np.int64, len(group))
            symbols = np.zeros((len(group), (1 << levels) + 1), np.int64)
            symbols[np.arange(symbols.shape[1]) < lengths[:, None]] = self.byte_id[np.frombuffer(b"".join(data[levels]), np.uint8)]
            alive = merge_many(symbols, lengths, self.table)
            ids = symbols[alive].astype("<u4").tobytes()
            ends = np.cumsum(4 * alive.sum(1)).tolist()
            out.update(zip(group, map(ids.__getitem__, map(slice, [0, *ends], ends))))
        return out

    def encode_batch(self, texts: list[str], cache: Generations) -> list[bytes]:
        """The ids of each text; ``cache`` holds those of text pieces and pre-tokens already met."""
        plans = []  # the cache's keys that make up a text
        for text in texts:
            pieces = cut_pieces(text)
            plans.append(self.pre_tokens(text) if pieces is None and text else pieces or [])
        new = [key for key in set().union(*plans) if key not in cache]
        words = [key for key in new if key[0] == " " and key[1:].isalpha() and ord(max(key)) < STABLE]  # one pre-token each
        parts = {key: self.pre_tokens(key) for key in set(new).difference(words)}
        tokens = set(words).union(*parts.values())
        found = self.merged([t for t in tokens if t not in cache])
        for key, ts in parts.items():
            if key not in found:
                found[key] = b"".join([found[t] if t in found else cache[t] for t in ts])
        for key in new:
            cache.put(key, found[key])
        get = cache.__getitem__
        out = [b"".join([found[k] if k in found else get(k) for k in plan]) for plan in plans]
        cache.shrink()
        return out

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def coder(path: str) -> Coder:
    return Coder(path)


def _coded(batches: Iterator[pa.RecordBatch], tokenizer: str) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Slices of the batches with the ids of each text; the cache lives as long as the iterator."""
    encoder, cache = coder(tokenizer), Generations()
    for batch in slices(batches):
        yield batch, [np.frombuffer(c, "<u4") for c in encoder.encode_batch(batch.column("text").to_pylist(), cache)]


def _id_lists(ids: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0] + [len(x) for x in ids]).astype(np.int32)
    return pa.ListArray.from_arrays(ends, np.concatenate(ids).view(np.int32) if ids else np.zeros(0, np.int32))


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return only(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), text_or_empty().alias("text"))


def encode(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids array<int> of every whole text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, ids in _coded(batches, tokenizer):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), _id_lists(ids)], names=["doc_id", "ids"])

    return _texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def round_trip(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids, text of every whole text, the text decoded from the ids, in one pass."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode_ids = coder(tokenizer).decode
        for batch, ids in _coded(batches, tokenizer):
            texts = pa.array([decode_ids(x) for x in ids], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), _id_lists(ids), texts], names=["doc_id", "ids", "text"])

    return _texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>, text string")


def decode(tokens: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, ids -> doc_id, ids, text (the ids' bytes read as UTF-8, invalid ones replaced)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode_ids = coder(tokenizer).decode
        for batch in slices(batches):
            ids = batch.column("ids")
            at, flat = ids.offsets.to_numpy(), ids.values.to_numpy(zero_copy_only=False)
            texts = [decode_ids(flat[a:b]) for a, b in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids, pa.array(texts, pa.string())],
                                             names=["doc_id", "ids", "text"])

    return tokens.mapInArrow(run, "doc_id long, ids array<int>, text string")


def digests(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (of the ids decoded) of every whole text, in one pass."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode_ids = coder(tokenizer).decode
        for batch, ids in _coded(batches, tokenizer):
            coded = [hashlib.sha256(x.tobytes()).hexdigest() for x in ids]
            texts = [hashlib.sha256(decode_ids(x).encode()).hexdigest() for x in ids]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(x) for x in ids], pa.int64()), pa.array(coded, pa.string()), pa.array(texts, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
