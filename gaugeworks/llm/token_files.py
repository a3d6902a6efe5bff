"""Token-id output: documents as ids of a public tokenizer, in files of range-coded blocks.

A file row is a chunk: some documents in order of their id, their lengths, and their ids as independently
coded, checksummed blocks. Rows are written and read by Spark's Parquet reader and writer, so a lost task
leaves nothing behind and any store that Spark can reach will do.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import range_coder
from .common import text_runs

END = 1  # id behind each document
CHUNK = range_coder.BLOCK * range_coder.LANES  # a chunk ends with the document that reaches so many ids
RUN = 8_000_000  # bytes of text that are encoded together
CACHE_ENTRIES, CACHE_WORDS = 800_000, 100_000  # of pre-tokens and words of at most CACHED bytes, so the caches are bounded in bytes too
CACHED = 48
GAPS = re.compile(r"[ \t\n\r]+")
#: Control characters that some engines count as white space, and the start of a special token's string: not for the caches.
ODD = re.compile(r"[\x1c-\x1f]|<\|")
# Bytes of lower-case texts of ASCII and of the letters from U+00C0 to U+017F: white space, letters, digits, others.
SPACE, LETTER, DIGIT, OTHER = range(4)
CLASSES = np.full(256, OTHER, np.uint8)
CLASSES[[9, 10, 11, 12, 13, 32]] = SPACE
CLASSES[[*range(ord("a"), ord("z") + 1), *range(0x80, 256)]] = LETTER
CLASSES[ord("0") : ord("9") + 1] = DIGIT
# Bytes that such texts don't have, and pairs of bytes: multiplication and division sign, dotted capital I, and as in ODD.
FOREIGN = np.zeros(256, bool)
FOREIGN[[*range(0x1C, 0x20), 0xC2, *range(0xC6, 256)]] = True
FOREIGN_PAIRS = ((0xC3, 0x97), (0xC3, 0xB7), (0xC4, 0xB0), (ord("<"), ord("|")))
# The pre-tokens of the public word-level vocabulary are these, single digits, and runs of letters and of others.
SHORT_ENDS, LONG_ENDS = (b"s", b"t", b"m", b"d"), (b"re", b"ve", b"ll")


class _Words:
    """The library with bounded caches of pre-tokens and of words, one to a Python worker."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        # The same for pre-tokens that are ready: in lower case, one to a line.
        self.lines = Tokenizer.from_file(path)
        self.lines.normalizer = normalizers.Sequence([])
        by_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, trim_offsets=True, use_regex=False)
        self.lines.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split("\n", "removed"), by_bytes])
        vocab = self.library.get_vocab()
        self.last = np.zeros(max(vocab.values()) + 1, bool)
        self.last[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.words: dict[str, bytes] = {}
        self.clear()

    def clear(self) -> None:
        """Forget all pre-tokens: their numbers, and under each number where its ids stand among all ids."""
        self.parts: dict[bytes, int] = {}
        self.ids, self.ends = np.zeros(0, np.uint16), np.zeros(1, np.int32)

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        found = self.library.encode_batch_fast(texts, add_special_tokens=False) if texts else []
        return [np.array(x.ids, dtype=np.uint16) for x in found]

    def learn(self, parts: list[bytes]) -> int:
        """Encode pre-tokens many to a call, each ends with its first token that ends a word, and number them from what is returned."""
        ids, sizes = [self.ids], []
        for i in range(0, len(parts), 512):
            some = b"\n".join(parts[i : i + 512]).decode()
            found = np.array(self.lines.encode_batch_fast([some], add_special_tokens=False)[0].ids, dtype=np.uint16)
            ends, n = np.flatnonzero(self.last[found]) + 1, min(512, len(parts) - i)
            if len(ends) == n and ends[-1] == len(found):
                ids.append(found)
                sizes.append(np.diff(ends, prepend=0))
            else:
                each = self.whole(some.split("\n"))
                ids += each
                sizes.append(np.array([len(x) for x in each], np.int64))
        self.ids = np.concatenate(ids)
        first = len(self.ends) - 1
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(np.concatenate(sizes), dtype=np.int32)])
        self.parts.update(zip(parts, range(first, first + len(parts)), strict=True))
        return first

    def forget(self, parts: np.ndarray) -> None:
        """Drop those that were learned last."""
        for p in parts:
            del self.parts[p]
        self.ends = self.ends[: len(self.ends) - len(parts)]
        self.ids = self.ids[: self.ends[-1]]

    def foreign(self, text: str) -> np.ndarray:
        """Any text: word by word, or whole if it has ODD parts."""
        if ODD.search(text):
            return self.whole([text])[0]
        words, cache = GAPS.split(text), self.words
        if len(cache) > CACHE_WORDS:
            cache.clear()
        new = list({w for w in words if w not in cache})
        cache.update(zip(new, [x.tobytes() for x in self.whole(new)], strict=True))
        out = np.frombuffer(b"".join(map(cache.__getitem__, words)), dtype=np.uint16)
        for w in new:
            if len(w) > CACHED:
                del cache[w]
        return out


@lru_cache(maxsize=2)
def _words(path: str) -> _Words:
    return _Words(path)


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of texts that are not null, and where each begins and the last ends."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _foreign(texts: pa.Array) -> np.ndarray:
    """Which texts have other bytes than those of ASCII and of Latin letters that no normalisation but lower case changes."""
    data, offsets = _bytes(texts)
    found = FOREIGN[data]
    for a, b in FOREIGN_PAIRS:
        found[:-1] |= (data[:-1] == a) & (data[1:] == b)
    out = np.zeros(len(texts), bool)
    out[np.searchsorted(offsets, np.flatnonzero(found), side="right") - 1] = True
    return out


def _pre_tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All pre-tokens of lower-case texts, and where those of each text begin and the last end."""
    data, offsets = _bytes(texts)
    kind = CLASSES[data]
    edge = np.ones(len(data), bool)
    np.not_equal(kind[1:], kind[:-1], out=edge[1:])
    edge |= kind == DIGIT
    edge[offsets[:-1][offsets[:-1] < len(data)]] = True
    # An apostrophe that begins a pre-token takes in some endings.
    at = np.flatnonzero((data == ord("'")) & edge)
    left = offsets[np.searchsorted(offsets, at, side="right")] - at - 1
    one, two = data.take(at + 1, mode="clip"), data.take(at + 2, mode="clip")
    size = np.zeros(len(at), np.int64)
    for a in SHORT_ENDS:
        size[(one == a[0]) & (left > 0)] = 1
    for a, b in LONG_ENDS:
        size[(one == a) & (two == b) & (left > 1)] = 2
    at, size = at[size > 0], size[size > 0]
    edge[at + 1] = False
    behind = at + size + 1
    edge[behind[behind < len(data)]] = True
    solid = kind != SPACE
    starts = np.flatnonzero(edge & solid)
    packed = data[solid]
    bounds = np.append(np.flatnonzero(edge[solid]), len(packed)).astype(np.int32)
    parts = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(packed)])
    return parts, np.searchsorted(starts, offsets)


def _encode_latin(texts: pa.Array, own: _Words) -> list[np.ndarray]:
    parts, offsets = _pre_tokens(pc.utf8_lower(texts))
    if not len(parts):
        return [own.ids[:0]] * len(texts)
    if len(own.parts) > CACHE_ENTRIES:
        own.clear()
    coded = parts.dictionary_encode()
    names = coded.dictionary.to_numpy(zero_copy_only=False)
    number = np.fromiter(map(own.parts.get, names, repeat(-1)), np.int32, len(names))
    new = np.flatnonzero(number < 0)
    long = 0
    if len(new):
        sizes = np.array([len(p) for p in names[new]])
        long = int((sizes > CACHED).sum())
        new = new[np.argsort(sizes, kind="stable")]  # the long ones last
        number[new] = own.learn(names[new].tolist()) + np.arange(len(new))
    start, size = own.ends[number], own.ends[number + 1] - own.ends[number]
    which = coded.indices.to_numpy()
    size = size.take(which)
    ends = np.cumsum(size, dtype=np.int64)
    at = np.repeat((start.take(which) - (ends - size)).astype(np.int32), size)
    at += np.arange(len(at), dtype=np.int32)
    ids = own.ids.take(at)
    if long:
        own.forget(names[new[-long:]])  # known for this call only
    return np.split(ids, np.append(0, ends)[offsets[1:-1]])


def encode_texts(texts: list[str] | pa.Array, path: str) -> list[np.ndarray]:
    """The library's ids of each text, without special tokens added; null is empty.

    The tokenizer never joins what white space or the bounds of a pre-token separate. So Latin texts are cut
    into pre-tokens, all texts at once, and the library encodes each distinct one that the worker's bounded
    cache lacks; other texts are encoded word by word, and those with ODD parts whole.
    """
    own = _words(path)
    texts = pc.fill_null(pa.array(texts, pa.string()) if isinstance(texts, list) else texts.cast(pa.string()), "")
    if not len(texts):
        return []
    foreign = _foreign(texts)
    latin = iter(_encode_latin(texts.filter(pa.array(~foreign)) if foreign.any() else texts, own) if not foreign.all() else [])
    return [own.foreign(texts[i].as_py()) if x else next(latin) for i, x in enumerate(foreign)]


def write(df: DataFrame, folder: str, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every whole text and write ``folder`` in ascending order of the id (nulls first, then by text hash).

    Each document ends with id END; null and empty texts have only that. Rows:
    ``part, seq, ids array, lengths array<long>, blocks array<binary>, sizes array<int>, checks array<long>``.
    Documents are dealt out by ranges of their id, so a part holds a run of ids and parts follow each other.
    """
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 2)  # the more blocks in step, the less time each takes
    rows = df.select(df[id_col].alias("id"), df[text_col].alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    fields = [("part", pa.int32()), ("seq", pa.int64()), ("ids", None), ("lengths", pa.list_(pa.int64())), ("blocks", pa.list_(pa.binary())), ("sizes", pa.list_(pa.int32())), ("checks", pa.list_(pa.int64()))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, held, names = TaskContext.get().partitionId(), 0, [], []

        def chunk(id_type: pa.DataType) -> pa.RecordBatch:
            lengths, ids = [len(x) for x in held], np.concatenate(held)
            held.clear()
            values = [part, seq, names, lengths, *range_coder.encode(ids)]
            return pa.RecordBatch.from_arrays([pa.array([v], t or pa.list_(id_type)) for v, (_, t) in zip(values, fields, strict=True)], [n for n, _ in fields])

        id_type, size = None, 0
        for batch in batches:
            id_type, ids = batch.schema.field(0).type, batch.column(0).to_pylist()
            for start, texts in text_runs(batch.column(1), RUN):
                for k, found in enumerate(encode_texts(texts, path)):
                    held.append(np.append(found, np.uint16(END)))
                    names.append(ids[start + k])
                    size += len(held[-1])
                    if size >= CHUNK:
                        yield chunk(id_type)
                        names, size, seq = [], 0, seq + 1
        if held:
            yield chunk(id_type)

    ordered = rows.repartitionByRange(parts, F.col("id").asc_nulls_first()).sortWithinPartitions(F.col("id").asc_nulls_first(), F.xxhash64("text"))
    schema = f"part int, seq long, ids array<{kind}>, lengths array<long>, blocks array<binary>, sizes array<int>, checks array<long>"
    ordered.mapInArrow(run, schema).write.parquet(folder)


def read(spark: SparkSession, folder: str, id_col: str = "doc_id", keep_ids: bool = False) -> DataFrame:
    """The documents of a folder: ``id_col, start`` (ids of all documents before it), ``n_tokens, ids_crc32``.

    ``keep_ids`` adds ``token_ids``. Every block is decoded and its checksum compared; a damaged one is an
    error. Rows come as they were written, so equal documents repeat; no rows give an empty result.
    """
    chunks = spark.read.parquet(folder)
    kind = chunks.schema["ids"].dataType.elementType.simpleString()
    size = F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)
    in_part = W.partitionBy("part").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    sizes = chunks.select("part", "seq", size.alias("size")).withColumn("before", F.coalesce(F.sum("size").over(in_part), F.lit(0)))
    totals = sizes.groupBy("part").agg(F.sum("size").alias("total"))
    # One row for each part, of which there are as many as partitions.
    firsts = totals.select(F.col("part").alias("p"), F.coalesce(F.sum("total").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("first"))
    offsets = sizes.join(firsts, sizes["part"] == F.col("p")).select("part", "seq", (F.col("first") + F.col("before")).alias("offset"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                part, seq, ids, lengths, blocks, sizes_, checks = (c.slice(row, 1) for c in batch.columns)
                lengths = lengths[0].as_py()
                decoded = range_coder.decode(blocks[0].as_py(), sizes_[0].as_py(), checks[0].as_py())
                ends = np.cumsum(lengths)
                starts = ends - lengths
                n = len(lengths)
                columns = [pa.array([part[0].as_py()] * n, pa.int32()), pa.array([seq[0].as_py()] * n, pa.int64()), ids.flatten(), pa.array(starts), pa.array(lengths, pa.int64())]
                columns.append(pa.array([zlib.crc32(decoded[a:b]) for a, b in zip(starts, ends, strict=True)], pa.int64()))
                names = ["part", "seq", "id", "at", "n_tokens", "ids_crc32"]
                if keep_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array([0, *ends], pa.int32()), pa.array(decoded.astype(np.int32))))
                    names.append("token_ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"part int, seq long, id {kind}, at long, n_tokens long, ids_crc32 long" + ", token_ids array<int>" * keep_ids
    docs = chunks.select("part", "seq", "ids", "lengths", "blocks", "sizes", "checks").mapInArrow(run, schema)
    out = docs.join(offsets, ["part", "seq"]).withColumn("start", F.col("offset") + F.col("at")).withColumnRenamed("id", id_col)
    return out.select(id_col, "start", "n_tokens", "ids_crc32", *["token_ids"] * keep_ids)
