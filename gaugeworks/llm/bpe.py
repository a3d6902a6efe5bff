"""Byte-level BPE: encoding with a segment tree of pair ranks, and decoding.

Each pre-token is merged on its own. A segment tree over its byte positions holds, in every node, the
smallest ``rank * width + position`` below it, so the root is the leftmost pair of least rank. A merge
changes three leaves (the merged pair, its live left neighbour and the swallowed position) and the
paths from them to the root. Short pre-tokens are merged many at a time, one row of a numpy tree each;
long ones use the same tree over flat arrays.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import text_chunks
from .pretokens import splitter

FREE = np.int64(1) << 60
WIDTHS = (4, 8, 16, 32, 64)
CACHE_ENTRIES = 400_000  # of pre-tokens of at most CACHED characters, so the cache is bounded in bytes too
CACHED = 64
SHIFT = 17


class BytePairs:
    """A rank file as arrays: token bytes by id, and the rank of every mergeable pair of ids."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        size = max(self.ranks.values()) + 1
        by_id = [b""] * size
        for token, rank in self.ranks.items():
            by_id[rank] = token
        self.lengths = np.array([len(t) for t in by_id], dtype=np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.bytes = np.frombuffer(b"".join(by_id), dtype=np.uint8)
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        pairs = {}
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                left, right = self.ranks.get(token[:i]), self.ranks.get(token[i:])
                if left is not None and right is not None:
                    pairs[left << SHIFT | right] = rank
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), dtype=np.int64)
        self.values = np.array([pairs[k] for k in self.keys.tolist()], dtype=np.int64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair; FREE where it doesn't merge or an id is -1."""
        key = (left << SHIFT) + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.values[at], FREE)

    def merge_rows(self, words: list[bytes], width: int) -> list[bytes]:
        """Packed little-endian ids of words of at most ``width`` bytes, a tree per row."""
        n = len(words)
        level = width.bit_length() - 1
        raw = np.frombuffer(b"".join([w.ljust(width, b"\0") for w in words]), dtype=np.uint8).reshape(n, width)
        size = np.fromiter(map(len, words), dtype=np.int64, count=n)
        place = np.arange(width)
        ids = np.full((n, width + 1), -1, dtype=np.int64)
        ids[:, :width] = np.where(place < size[:, None], self.byte_ids[raw], -1)
        after = np.tile(np.arange(1, width + 2), (n, 1))
        after[:, width] = width
        before = np.tile(np.arange(-1, width), (n, 1))
        tree = np.full((n, 2 * width), FREE, dtype=np.int64)
        rank = self.pair_ranks(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(n, width)
        tree[:, width:] = np.where(rank < FREE, rank * width + place, FREE)
        for k in range(level - 1, -1, -1):
            a = 1 << k
            tree[:, a : 2 * a] = np.minimum(tree[:, 2 * a : 4 * a : 2], tree[:, 2 * a + 1 : 4 * a : 2])
        flat, flat_ids, flat_after, flat_before = tree.ravel(), ids.ravel(), after.ravel(), before.ravel()
        live = np.arange(n)
        while True:
            best = tree[live, 1]
            open_ = best < FREE
            live, best = live[open_], best[open_]
            if not len(live):
                break
            at, merged = best & (width - 1), best >> level
            row, links = live * (2 * width), live * (width + 1)
            gone = flat_after[links + at]
            following = flat_after[links + gone]
            flat_ids[links + at] = merged
            flat_ids[links + gone] = -1
            flat_after[links + at] = following
            flat_before[links + following] = at
            left = flat_before[links + at]
            first = left < 0
            left = np.where(first, at, left)
            flat[row + width + gone] = FREE
            both = self.pair_ranks(
                np.concatenate([merged, flat_ids[links + left]]), np.concatenate([flat_ids[links + following], merged])
            )
            right_rank, left_rank = both[: len(live)], both[len(live) :]
            flat[row + width + left] = np.where(left_rank < FREE, left_rank * width + left, FREE)
            flat[row + width + at] = np.where(right_rank < FREE, right_rank * width + at, FREE)
            nodes = np.concatenate([gone, at, left]) + width
            rows = np.concatenate([row, row, row])
            for _ in range(level):
                nodes >>= 1
                below = rows + 2 * nodes
                flat[rows + nodes] = np.minimum(flat[below], flat[below + 1])
        kept = ids[:, :width] >= 0
        packed = ids[:, :width][kept].astype("<u4").tobytes()
        ends = (np.cumsum(kept.sum(axis=1)) * 4).tolist()
        return [packed[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def merge_long(self, word: bytes) -> bytes:
        """Packed ids of one word of any length."""
        n = len(word)
        width = 1 << max(1, (n - 1).bit_length())
        none = int(FREE)
        get = self.pairs.get
        # Arrays of machine numbers: 40 bytes for a byte of the word, and no object each.
        ids = array("q", self.byte_ids[np.frombuffer(word, dtype=np.uint8)].tobytes())
        after, before = array("i", range(1, n + 1)), array("i", range(-1, n - 1))

        def leaf(a: int, b: int) -> int:
            r = get(ids[a] << SHIFT | ids[b]) if a >= 0 and b < n else None
            return none if r is None else r * width + a

        packed = np.frombuffer(ids, dtype=np.int64)
        rank = self.pair_ranks(packed[:-1], packed[1:])
        leaves = np.full(2 * width, FREE, dtype=np.int64)
        leaves[width : width + n - 1] = np.where(rank < FREE, rank * width + np.arange(n - 1), FREE)
        for k in range(width.bit_length() - 2, -1, -1):
            a = 1 << k
            leaves[a : 2 * a] = np.minimum(leaves[2 * a : 4 * a : 2], leaves[2 * a + 1 : 4 * a : 2])
        tree = array("q", leaves.tobytes())
        del packed, leaves

        def put(i: int, value: int) -> None:
            i += width
            tree[i] = value
            while i > 1:
                i >>= 1
                a, b = tree[2 * i], tree[2 * i + 1]
                value = a if a < b else b
                if tree[i] == value:
                    break
                tree[i] = value

        while tree[1] < none:
            at, rank = tree[1] % width, tree[1] // width
            gone = after[at]
            following = after[gone]
            ids[at], ids[gone], after[at] = rank, -1, following
            if following < n:
                before[following] = at
            put(gone, none)
            put(at, leaf(at, following))
            if before[at] >= 0:
                put(before[at], leaf(before[at], at))
        left = np.frombuffer(ids, dtype=np.int64)
        return left[left >= 0].astype("<u4").tobytes()

    def merge_all(self, words: list[str]) -> dict[str, bytes]:
        """Packed ids of each distinct pre-token."""
        out, by_width = {}, {w: [] for w in WIDTHS}
        for word in words:
            raw = word.encode()
            whole = self.ranks.get(raw)
            if whole is not None:
                out[word] = whole.to_bytes(4, "little")
            elif len(raw) > WIDTHS[-1]:
                out[word] = self.merge_long(raw)
            else:
                by_width[max(WIDTHS[0], 1 << (len(raw) - 1).bit_length())].append((word, raw))
        for width, some in by_width.items():
            for i in range(0, len(some), 8192):
                part = some[i : i + 8192]
                out.update(zip([w for w, _ in part], self.merge_rows([r for _, r in part], width), strict=True))
        return out

    def decode(self, packed: bytes) -> bytes:
        """The bytes of packed ids."""
        parts = []
        for i in range(0, len(packed), 1 << 18):
            ids = np.frombuffer(packed[i : i + (1 << 18)], dtype="<u4")
            size = self.lengths[ids]
            ends = np.cumsum(size)
            parts.append(self.bytes[np.arange(ends[-1]) + np.repeat(self.starts[ids] - ends + size, size)].tobytes())
        return b"".join(parts)


@lru_cache(maxsize=4)
def load(path: str) -> BytePairs:
    """The rank file, once per Python worker."""
    return BytePairs(path)


@lru_cache(maxsize=4)
def _cache(path: str) -> dict[str, bytes]:
    return {}


def encode_texts(texts: list[str], path: str, pattern: str) -> list[bytes]:
    """Packed ids of each text; the worker's cache of pre-tokens is bounded and only saves time."""
    bpe, cache, split = load(path), _cache(path), splitter(pattern)
    if len(cache) > CACHE_ENTRIES:
        cache.clear()
    pieces = [split(t) for t in texts]
    missing = list({p for doc in pieces for p in doc if p not in cache})
    cache.update(bpe.merge_all(missing))
    packed = [b"".join(map(cache.__getitem__, doc)) for doc in pieces]
    for p in [p for p in missing if len(p) > CACHED]:
        del cache[p]
    return packed


def encode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Encode every whole text, decode it again, and digest both.

    Returns ``id_col``, ``n_tokens``, ``ids_sha256`` (ids as little-endian unsigned 32-bit integers),
    ``decoded_sha256`` and, with ``keep_ids``, ``token_ids`` (array of int). One row per input row, so
    repeated rows repeat; a null or empty text has no tokens and the digests of no bytes; a null id is
    kept. Other columns are ignored. A narrow map: no shuffle, and a lost task is simply run again.
    """
    fields = [pa.field("n_tokens", pa.int64()), pa.field("ids_sha256", pa.string()), pa.field("decoded_sha256", pa.string())]
    fields += [pa.field("token_ids", pa.list_(pa.int32()))] * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for start, chunk in text_chunks(texts):
                packed = encode_texts(chunk, path, pattern)
                columns = [
                    ids.slice(start, len(chunk)),
                    pa.array([len(p) // 4 for p in packed], pa.int64()),
                    pa.array([hashlib.sha256(p).hexdigest() for p in packed]),
                    pa.array([hashlib.sha256(bpe.decode(p)).hexdigest() for p in packed]),
                ]
                if keep_ids:
                    ends = np.cumsum([0, *(len(p) // 4 for p in packed)]).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(packed), "<i4"))))
                yield pa.RecordBatch.from_arrays(columns, schema=pa.schema([pa.field("id", ids.type), *fields]))

    rows = df.select(df[id_col].alias("id"), df[text_col].alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", token_ids array<int>" * keep_ids
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def decode(df: DataFrame, path: str, ids_col: str = "token_ids", text_col: str = "text") -> DataFrame:
    """Add ``text_col``, the text of an array of ids (bytes that aren't UTF-8 become U+FFFD); null stays null."""
    from pyspark.sql import functions as F

    @F.pandas_udf("string")
    def run(ids):
        bpe = load(path)
        return ids.map(lambda x: None if x is None else bpe.decode(np.asarray(x, dtype="<u4").tobytes()).decode("utf-8", "replace"))

    return df.withColumn(text_col, run(df[ids_col]))
