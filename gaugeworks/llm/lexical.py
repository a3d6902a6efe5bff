"""Ranked lexical search by pipelined term partitioning.

Terms are owned by STAGES owners, from the rarest to the most common; documents are dealt to shards. A bundle is one
item on one shard: its terms with their weights, and a sparse accumulator of documents and scores. Bundles pass
through the owners in turn. At each, a cogroup brings the bundles of a shard together with the owner's postings
of that shard, and integer contributions are added. What the terms still to come can add at most tells which
documents can no longer be among the best of their shard: those are left out, exactly. After the last owner every
bundle has its best documents, and the best of all shards are selected.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import shared_folder, stored, text_chunks
from .decontaminate import term_filter, words_of

TOP = 20
EDGES = (256, 32, 4)  # an owner has the terms in at most one of so many documents, the last one all others
STAGES = len(EDGES) + 1
SHARD = 16_384  # about so many documents,
ITEMS = 1024  # and so many items, meet in one task at a time
SLOT_BITS = 22  # hashes of terms that the owners are kept for: 2 MB at any number of terms
CACHE_ENTRIES = 400_000  # of words of at most CACHED bytes
CACHED = 64
FLUSH = 200_000  # terms that a task counts before it passes them on


class _Cache(dict):
    """What ``find`` gives for the hash of a word, kept for short words."""

    def __init__(self, find: Callable[[int], int]):
        self.find = find

    def __missing__(self, word: bytes) -> int:
        value = self.find(xxhash.xxh64_intdigest(word, 42))
        if len(word) <= CACHED:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[word] = value
        return value


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``item`` (a number of the row), ``item_id, term, times`` of every term of every item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        no = TaskContext.get().partitionId() << 40
        for batch in batches:
            for first, texts in text_chunks(batch.column(1)):
                counts = [Counter(words_of(t)) for t in texts]
                sizes = [len(c) for c in counts]
                at = np.repeat(np.arange(len(texts)), sizes)
                terms = [w.decode() for c in counts for w in c]
                times = [n for c in counts for n in c.values()]
                yield pa.RecordBatch.from_arrays([pa.array(no + at), batch.column(0).take(pa.array(first + at)), pa.array(terms, pa.string()), pa.array(times, pa.int64())], ["item", "item_id", "term", "times"])
                no += len(texts)

    rows = items.select(items[id_col].alias("item_id"), items[text_col].alias("text"))
    return rows.mapInArrow(run, f"item long, item_id {rows.schema['item_id'].dataType.simpleString()}, term string, times long")


def statistics(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """``term, df, most, least`` of the terms of ``terms`` (column ``term``) in all ``docs`` (``text``): documents, largest
    count in one, fewest terms of one; and a row with a null term: documents with terms, all terms.

    Other terms with the hash of one may have rows too.
    """
    sent = docs.sparkSession.sparkContext.broadcast(term_filter(terms))
    names = ["term", "df", "most", "least"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, mask = memoryview(sent.value.tobytes()), 8 * len(sent.value) - 1
        wanted = _Cache(lambda h: bits[(h & mask) >> 3] >> (h & 7) & 1)
        found: dict[bytes, list[int]] = {}
        n_docs = n_terms = 0

        def flush() -> pa.RecordBatch:
            rows = [(None, n_docs, n_terms, 0), *((w.decode(), *x) for w, x in found.items())]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names)

        for batch in batches:
            for _, texts in text_chunks(batch.column(0)):
                for text in texts:
                    words = words_of(text)
                    n_docs, n_terms = n_docs + bool(words), n_terms + len(words)
                    for word, tf in Counter(words).items():
                        if wanted[word]:
                            seen = found.get(word)
                            if seen is None:
                                found[word] = [1, tf, len(words)]
                            else:
                                seen[0] += 1
                                if tf > seen[1]:
                                    seen[1] = tf
                                if len(words) < seen[2]:
                                    seen[2] = len(words)
                    if len(found) >= FLUSH:
                        yield flush()
                        found.clear()
                        n_docs = n_terms = 0
        yield flush()

    parts = docs.select("text").mapInArrow(run, "term string, df long, most long, least long")
    # The row without a term adds up in both counts.
    most = F.when(F.col("term").isNull(), F.sum("most")).otherwise(F.max("most"))
    return parts.groupBy("term").agg(F.sum("df").alias("df"), most.alias("most"), F.min("least").alias("least"))


def _owners(terms: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """``slot, owner`` (from 1) of each hash that a term of ``terms`` (``term, class``) has, and the same as an array of 4 bits a slot.

    Terms with one hash have one owner, that of the most common.
    """
    slot = F.xxhash64("term").bitwiseAND(F.lit((1 << SLOT_BITS) - 1))
    slots = terms.groupBy(slot.alias("slot")).agg(F.max("class").alias("owner"))
    parts = slots.groupBy(F.shiftright("slot", 3).alias("at")).agg(F.sum(F.expr("shiftleft(cast(owner AS bigint), cast(4 * (slot & 7) AS int))")).alias("bits")).toPandas()
    out = np.zeros(1 << (SLOT_BITS - 3), dtype="<u4")
    out[parts["at"].to_numpy(np.int64)] = parts["bits"].to_numpy(np.int64).astype("<u4")
    return slots, out.view(np.uint8)


def postings(docs: DataFrame, owners: np.ndarray, n_docs: int, n_terms: int, shards: int) -> DataFrame:
    """``owner, shard, row, doc_id, m, terms, counts``: for each document and owner its terms, joined by spaces, and their counts.

    ``row`` numbers the rows of ``docs`` (``doc_id, text``); ``m`` is the document's length factor.
    """
    sent = docs.sparkSession.sparkContext.broadcast(owners)
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
    names = ["owner", "shard", "row", "doc_id", "m", "terms", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, mask = memoryview(sent.value.tobytes()), (1 << SLOT_BITS) - 1
        owner_of = _Cache(lambda h: table[(h & mask) >> 1] >> 4 * (h & 1) & 15)
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for first, texts in text_chunks(batch.column(1)):
                out = []
                for doc, text in zip(batch.column(0).slice(first, len(texts)).to_pylist(), texts, strict=True):
                    words, row = words_of(text), row + 1
                    lists: list[tuple[list, list]] = [([], []) for _ in range(STAGES + 1)]
                    for word, tf in Counter(words).items():
                        at = lists[owner_of[word]]
                        at[0].append(word)
                        at[1].append(tf)
                    shard = xxhash.xxh64_intdigest(row.to_bytes(8, "little")) % shards
                    m = 75 + 25 * len(words) * n_docs // n_terms if words else 0
                    out += [(k, shard, row, doc, m, b" ".join(ws).decode(), np.array(tfs, "<i8").tobytes()) for k, (ws, tfs) in enumerate(lists) if k and ws]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [()] * len(names), kinds, strict=True)], names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "owner int, shard int, row long, doc_id long, m long, terms string, counts binary")


def _lists(posts: pa.Table, wanted: set[str]) -> tuple[np.ndarray, pa.Array, dict[str, tuple[np.ndarray, np.ndarray]]]:
    """Row numbers in order, their ids, and for each wanted term the places among them and the factor that multiplies its weight."""
    posts = posts.sort_by("row").combine_chunks()
    rows, m = posts["row"].to_numpy(), posts["m"].to_numpy()
    split = pc.split_pattern(posts["terms"], " ").combine_chunks()
    if isinstance(split, pa.ChunkedArray):
        split = split.chunk(0) if split.num_chunks else pa.array([], pa.list_(pa.string()))
    doc = np.repeat(np.arange(len(rows)), pc.list_value_length(split).to_numpy(zero_copy_only=False))
    tf = np.frombuffer(b"".join(posts["counts"].to_pylist()), "<i8")
    vocabulary = pa.array(sorted(wanted), pa.string())
    code = pc.fill_null(pc.index_in(split.flatten(), value_set=vocabulary), -1).to_numpy(zero_copy_only=False)
    kept = np.flatnonzero(code >= 0)
    kept = kept[np.argsort(code[kept], kind="stable")]
    doc, tf = doc[kept], tf[kept]
    factor = 1_000_000_000 * tf // (1000 * tf + 12 * m[doc])
    edges = np.searchsorted(code[kept], np.arange(len(vocabulary) + 1))
    return rows, posts["doc_id"].combine_chunks(), {t: (doc[a:b], factor[a:b]) for t, a, b in zip(vocabulary.to_pylist(), edges[:-1], edges[1:], strict=True) if b > a}


def _best(rows: np.ndarray, ids: np.ndarray, scores: np.ndarray, top: int) -> np.ndarray:
    """Places of the ``top`` highest scores, equal ones by id (none: last) and row, highest first."""
    none = np.array([i is None for i in ids], dtype=bool)
    return np.lexsort((rows, np.where(none, 0, ids).astype(np.int64), none, -scores))[:top]


def _add(stage: int, top: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The step of the cogroup at one owner: bundles and postings of a shard in, bundles out."""

    def step(bundles: pa.Table, posts: pa.Table) -> pa.Table:
        items = bundles.to_pylist()
        own = [[x for x in b["terms"] if x["owner"] == stage] for b in items]
        rows, ids, lists = _lists(posts, {x["term"] for xs in own for x in xs})
        ids = np.array(ids.to_pylist(), dtype=object)
        out = []
        for b, terms in zip(items, own, strict=True):
            have, have_ids, scores = np.array(b["rows"], np.int64), np.array(b["ids"], object), np.array(b["scores"], np.int64)
            to_come = sum(x["most"] for x in b["terms"] if x["owner"] > stage)
            here = sum(x["most"] for x in terms)
            sums = np.zeros(len(rows), np.int64)
            for x in terms:
                if x["term"] in lists:
                    at, factor = lists[x["term"]]
                    sums[at] += x["weight"] * factor
            # What the accumulator has already gets its sums; rows of a bundle stay in order.
            if len(have) and len(rows):
                at = np.minimum(np.searchsorted(rows, have), len(rows) - 1)
                there = rows[at] == have
                scores[there] += sums[at[there]]
                sums[at[there]] = 0
            # A document that comes in here can't pass the bar if all that is left is less.
            bar = np.partition(scores, -top)[-top] if len(scores) >= top else 0
            if here + to_come >= bar:
                new = np.flatnonzero(sums)
                have, have_ids, scores = np.concatenate([have, rows[new]]), np.concatenate([have_ids, ids[new]]), np.concatenate([scores, sums[new]])
            bar = np.partition(scores, -top)[-top] if len(scores) >= top else 0
            kept = np.flatnonzero(scores + to_come >= bar)
            if stage == STAGES:
                kept = kept[_best(have[kept], have_ids[kept], scores[kept], top)]
            out.append(b | {"rows": have[kept].tolist(), "ids": have_ids[kept].tolist(), "scores": scores[kept].tolist()})
        longs, asked = pa.list_(pa.int64()), pa.list_(pa.struct([("term", pa.string()), ("owner", pa.int32()), ("weight", pa.int64()), ("most", pa.int64())]))
        known = {"terms": asked, "rows": longs, "ids": longs, "scores": longs}
        return pa.Table.from_pylist(out, schema=pa.schema([(f.name, known.get(f.name, f.type)) for f in bundles.schema]))

    return step


def search(docs: DataFrame, items: DataFrame, top: int = TOP, doc_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """The ``top`` highest-scoring documents of each item: ``item_id, rank`` (from 1), ``doc_id, score``.

    Every row of both tables counts, repeated ones too. Equal scores are ranked by id; rows without an id come
    last among them, keep a null id. Null and empty texts have no terms: such documents are in no result, such
    items have no rows. Very long texts are read whole, one at a time. An empty table on either side gives an
    empty result; other columns are ignored. Sums and products are 64-bit integers.
    """
    spark, kind = docs.sparkSession, items.schema[item_col].dataType.simpleString()
    docs = docs.select(docs[doc_col].alias("doc_id"), docs[text_col].alias("text"))
    asked = stored(item_terms(items, item_col, text_col))
    stats = stored(statistics(docs, asked.select("term").distinct()))
    total = stats.filter("term IS NULL").first()
    n_docs, n_terms = (total["df"], total["most"]) if total else (0, 0)
    n_items = asked.select("item").distinct().count()
    if not n_docs or not n_items:
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    found = stats.filter("term IS NOT NULL").join(asked.select("term").distinct(), "term", "left_semi")
    rank = F.lit(STAGES)
    for k, edge in reversed(list(enumerate(EDGES, 1))):
        rank = F.when(F.col("df") * edge <= n_docs, k).otherwise(rank)
    found = stored(found.withColumn("class", rank))
    slots, owners = _owners(found)
    weight = F.floor(1000 * F.log((2.0 * n_docs + 2) / (2.0 * F.col("df") + 1))).cast("long")
    most = F.expr(f"(1000000000L * most) div (1000L * most + 12L * (75L + (25L * least * {n_docs}L) div {n_terms}L))")
    found = found.withColumn("slot", F.xxhash64("term").bitwiseAND(F.lit((1 << SLOT_BITS) - 1))).join(slots, "slot").select("term", "owner", weight.alias("w"), most.alias("factor"))
    shards, blocks = -(-n_docs // SHARD), -(-n_items // ITEMS)

    path = f"{shared_folder(spark)}/postings-{uuid.uuid4().hex}"
    posted = postings(docs, owners, n_docs, n_terms, shards)
    posted.write.partitionBy("owner").parquet(path)
    posted = spark.read.schema(posted.schema).parquet(path)

    times = F.col("w") * F.col("times")
    of_item = asked.join(found, "term").select("item", "item_id", F.struct("term", "owner", times.alias("weight"), (times * F.col("factor")).alias("most")).alias("t"))
    of_item = of_item.groupBy("item").agg(F.any_value("item_id").alias("item_id"), F.collect_list("t").alias("terms"))
    none = F.array().cast("array<long>")
    bundles = of_item.select(
        F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.pmod(F.xxhash64("item"), F.lit(blocks)).cast("int").alias("block"),
        "item", "item_id", "terms", none.alias("rows"), none.alias("ids"), none.alias("scores"),
    )
    shape = f"shard int, block int, item long, item_id {kind}, terms array<struct<term:string,owner:int,weight:long,most:long>>, rows array<long>, ids array<long>, scores array<long>"
    key = ["shard", "block"]
    for stage in range(1, STAGES + 1):
        own = posted.filter(F.col("owner") == stage).drop("owner").select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
        bundles = bundles.groupBy(key).cogroup(own.groupBy(key)).applyInArrow(_add(stage, top), shape)
    each = bundles.select("item", "item_id", F.explode(F.arrays_zip("rows", "ids", "scores")).alias("x"))
    each = each.select("item", "item_id", "x.rows", F.col("x.ids").alias("doc_id"), F.col("x.scores").alias("score")).filter("score > 0")
    best = W.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last(), "rows")
    return each.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")
