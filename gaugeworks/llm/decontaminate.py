"""Benchmark decontamination with a distributed positional inverted index.

The index holds, for every document, the places of every word that a benchmark has. A window is 13
consecutive words of a benchmark item. Its terms are taken from the rarest on, by their count in all
documents: the list of the rarest term, shifted by its offset in the window, gives starts, and the lists
of the next ones, shifted alike, are intersected with them. Starts that the rarest lists agree on are
intersected with the lists of all other words of the window; where all agree, the phrase stands there.
Starts where the rarest lists meet only within a few words are proximity matches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stored, text_chunks

WINDOW = 13
ANCHORS = 3
SLOP = 2
SEGMENT = 512  # words of a document whose places are one list, so no list grows with the document
FILTER_BITS = 24  # a set of hashes of 2 MB at any benchmark size tells which words to post; a word too many does no harm
CACHE_ENTRIES = 400_000  # of words of at most CACHED bytes
CACHED = 64

# Lower-case A-Z, keep 0-9, a-z and all bytes beyond ASCII, and make all else a space.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """The words of a text as lower-cased UTF-8; null has none."""
    return (text or "").encode().translate(_FOLD).split()


def text_key(text: str | None) -> int:
    """Spark's ``xxhash64`` of a text, which tells rows with the same id apart."""
    value = 42 if text is None else xxhash.xxh64_intdigest(text.encode(), 42)
    return value - (1 << 64) if value >> 63 else value


def windows(bench: DataFrame, size: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``item_id`` (string), ``phrase`` (words joined by spaces) and ``n`` of each distinct window of each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = words_of(text)
                spans = {b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()
                out += [(item, s.decode(), s.count(b" ") + 1) for s in sorted(spans)]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True) if out else ([], [], []), (pa.string(), pa.string(), pa.int32()), strict=True)], ["item_id", "phrase", "n"])

    return bench.select(bench[id_col].cast("string"), bench[text_col]).mapInArrow(run, "item_id string, phrase string, n int").distinct()


def term_filter(terms: DataFrame) -> np.ndarray:
    """A bit for each hash of FILTER_BITS bits that a ``term`` of ``terms`` has, as bytes: 2 MB whatever their number."""
    slot = F.xxhash64("term").bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
    slots = terms.select(slot.alias("slot")).groupBy(F.shiftright("slot", 5).alias("at"))
    parts = slots.agg(F.expr("bit_or(shiftleft(1L, cast(slot & 31 AS int)))").alias("bits")).toPandas()
    out = np.zeros(1 << (FILTER_BITS - 5), dtype="<u4")
    out[parts["at"].to_numpy(np.int64)] = parts["bits"].to_numpy(np.int64).astype("<u4")
    return out.view(np.uint8)


class _Codes(dict):
    """A number for each word that the filter lets pass, -1 for any other."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.terms = memoryview(bits.tobytes()), []

    def __missing__(self, word: bytes) -> int:
        slot = xxhash.xxh64_intdigest(word, 42) & ((1 << FILTER_BITS) - 1)
        code = -1
        if self.bits[slot >> 3] >> (slot & 7) & 1:
            code = len(self.terms)
            self.terms.append(word.decode())
        self[word] = code
        return code


def index(docs: DataFrame, terms: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Postings of every document: ``id, text_key, n_words, term, segment, n, first, places``.

    A row for each term of ``terms`` (column ``term``) in each SEGMENT words of a document, with its ``n`` places
    in order: the ``first``, and if there are more, all of them in ``places``; words with the hash of a term may have rows too. Each document also has one row without a
    term, which alone has ``n_words``.
    """
    sent = docs.sparkSession.sparkContext.broadcast(term_filter(terms))
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["id", "text_key", "n_words", "term", "segment", "n", "first", "places"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = _Codes(sent.value)
        for batch in batches:
            for first, texts in text_chunks(batch.column(1)):
                if len(codes) > CACHE_ENTRIES:
                    codes = _Codes(sent.value)
                words = [words_of(t) for t in texts]
                sizes = np.fromiter(map(len, words), np.int64, len(words))
                keys = np.array([text_key(t) if batch.column(1)[first + i].is_valid else text_key(None) for i, t in enumerate(texts)], np.int64)
                found = np.concatenate([np.fromiter(map(codes.__getitem__, w), np.int64, len(w)) for w in words])
                doc = np.repeat(np.arange(len(words)), sizes)
                place = np.arange(len(found)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                kept = np.flatnonzero(found >= 0)
                found, doc, place = found[kept], doc[kept], place[kept]
                # By document, segment and term; places stay in order.
                segment = place // SEGMENT
                list_of = (doc * (int(segment.max(initial=0)) + 1) + segment) * max(1, len(codes.terms)) + found
                order = np.argsort(list_of, kind="stable")
                list_of = list_of[order]
                edge = np.flatnonzero(np.diff(list_of, prepend=-1))
                at = order[edge]
                ids = batch.column(0).slice(first, len(texts))
                ends = np.append(edge, len(order))
                # Most words stand once in a segment and need no list.
                several = np.diff(ends) > 1
                kept = np.repeat(several, np.diff(ends))
                offsets = np.concatenate([[0], np.cumsum(np.where(several, np.diff(ends), 0))])
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(place[order][kept], pa.int32()), mask=pa.array(~several))
                n = len(at)
                columns = [ids.take(pa.array(doc[at])), pa.array(keys[doc[at]]), pa.nulls(n, pa.int64()), pa.array(codes.terms, pa.string()).take(pa.array(found[at])), pa.array(segment[at], pa.int32()), pa.array(np.diff(ends), pa.int32()), pa.array(place[at], pa.int32()), lists]
                yield pa.RecordBatch.from_arrays(columns, names)
                m = len(texts)
                columns = [ids, pa.array(keys), pa.array(sizes), pa.nulls(m, pa.string()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(columns, names)
                for w in {x for doc_words in words for x in doc_words if len(x) > CACHED}:
                    if (code := codes.pop(w)) >= 0:
                        codes.terms[code] = ""

    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    return rows.mapInArrow(run, f"id {kind}, text_key long, n_words long, term string, segment int, n int, first int, places array<int>")


def _meet(wanted: DataFrame, lists: DataFrame, slop: int) -> DataFrame:
    """The rows of ``wanted`` (``id, text_key, term, place``) whose term stands within ``slop`` words of the place, with ``exact``."""
    low, high = F.floor((F.col("place") - slop) / SEGMENT).cast("int"), F.floor((F.col("place") + slop) / SEGMENT).cast("int")
    wanted = wanted.withColumn("segment", F.explode(F.sequence(low, high))) if slop else wanted.withColumn("segment", low)
    there = lists.select(F.col("id").alias("p_id"), F.col("text_key").alias("p_key"), F.col("term").alias("p_term"), F.col("segment").alias("p_segment"), "first", "places")
    on = F.col("id").eqNullSafe(F.col("p_id")) & (F.col("text_key") == F.col("p_key")) & (F.col("term") == F.col("p_term")) & (F.col("segment") == F.col("p_segment"))
    place = F.col("place").cast("int")
    near = F.lit(False)
    for k in range(-slop, slop + 1):
        near |= F.array_contains("places", place + k)
    near = F.when(F.col("places").isNull(), F.abs(F.col("first") - place) <= slop).otherwise(near)
    exact = F.when(F.col("places").isNull(), F.col("first") == place).otherwise(F.array_contains("places", place))
    return wanted.join(there, on & near).withColumn("exact", exact).drop("p_id", "p_key", "p_term", "p_segment", "first", "places", "segment")


def contamination(
    docs: DataFrame, bench: DataFrame, size: int = WINDOW, slop: int = SLOP, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Words of each document inside occurrences of benchmark windows.

    Returns ``id_col, n_words, n_hit, n_items, items`` (sorted array of item ids as strings) and ``n_near``
    (windows whose rarest terms all occur within ``slop`` words of their places although the window itself
    doesn't stand there), one row per input row. Null or wordless texts have no words and no hits; an
    item of fewer words than a window is one window, an item without words none. Repeated rows repeat;
    rows that share an id but not a text are told apart by a hash of the text. Very long texts are read
    whole, one at a time. Empty tables of either kind give no hits. Other columns are ignored.
    """
    if not 1 <= size <= 63:
        raise ValueError("a window has 1 to 63 words")
    spans = stored(windows(bench, size).withColumn("window", F.xxhash64("phrase")))
    phrases = spans.select("window", "phrase", "n").distinct()
    placed = stored(phrases.select("window", "n", F.posexplode(F.split("phrase", " ")).alias("offset", "term")))
    posted = stored(index(docs, placed.select("term").distinct(), id_col, text_col))
    lists = posted.filter("term IS NOT NULL").select("id", "text_key", "term", "segment", "first", "places")
    counts = posted.filter("term IS NOT NULL").groupBy("term").agg(F.sum("n").alias("freq"))
    # A window with a term that no document has can't occur, so it has no anchors.
    of_window = W.partitionBy("window")
    whole = placed.join(counts, "term").withColumn("there", F.count("*").over(of_window)).filter("there = n")
    first = whole.groupBy("window", "n", "term", "freq").agg(F.min("offset").alias("offset"))
    ranked = first.withColumn("rank", F.row_number().over(of_window.orderBy("freq", "term"))).filter(F.col("rank") <= ANCHORS)
    anchor = F.array_sort(F.collect_list(F.struct("rank", "term", "offset")))
    anchors = stored(ranked.groupBy("window", "n").agg(anchor.alias("anchors")).withColumn("parts", F.size("anchors")))

    # The rarest list of each window: where the window would start.
    doc = ["id", "text_key"]
    led = anchors.select("window", "n", "parts", F.col("anchors")[0]["term"].alias("term"), F.col("anchors")[0]["offset"].alias("offset"), F.slice("anchors", 2, ANCHORS).alias("others"))
    lead = lists.join(led, "term").select(*doc, "window", "n", "parts", "others", "offset", F.explode(F.coalesce("places", F.array("first"))).alias("place"))
    lead = lead.select(*doc, "window", "n", "parts", (F.col("place") - F.col("offset")).alias("start"), "others").filter("start >= 0")
    # The other rare lists, where they meet it up to ``slop``.
    candidate = [*doc, "window", "n", "parts", "start"]
    wanted = lead.filter("parts > 1").select(*candidate, F.explode("others").alias("o"))
    wanted = wanted.select(*candidate, F.col("o.rank").alias("rank"), F.col("o.term").alias("term"), (F.col("start") + F.col("o.offset")).alias("place"))
    rare = anchors.select(F.explode(F.slice("anchors", 2, ANCHORS)).alias("o")).select("o.term").distinct()
    met = _meet(wanted, lists.join(rare, "term", "left_semi"), slop).groupBy(*candidate)
    # A bit for each rank: no list counts twice, however often a document is repeated.
    bit = F.expr("shiftleft(1L, rank - 1)")
    all_others = F.expr("shiftleft(1L, parts) - 2")
    met = met.agg(F.bit_or(bit).alias("close"), F.bit_or(F.when(F.col("exact"), bit).otherwise(F.lit(0).cast("long"))).alias("agree")).filter(F.col("close") == all_others)
    met = met.withColumn("agreed", F.col("agree") == all_others)
    alone = lead.filter("parts = 1").select(*candidate).distinct().withColumn("agreed", F.lit(True))
    met = stored(met.select(*candidate, "agreed").unionByName(alone))
    # Starts that all rare lists agree on: the lists of every other word of the window.
    agreed = met.filter("agreed").select(*doc, "window", "n", "start")
    known = anchors.select("window", F.explode("anchors").alias("o")).select("window", F.col("o.offset").alias("offset"))
    other = placed.select("window", "offset", "term").join(known, ["window", "offset"], "left_anti").groupBy("window").agg(
        F.collect_list(F.struct("offset", "term")).alias("rest"), F.bit_or(F.expr("shiftleft(1L, offset)")).alias("wanted")
    )
    rest = agreed.join(other, "window", "left").select(*doc, "window", "n", "start", F.explode_outer("rest").alias("o"), "wanted")
    certain = rest.filter("o IS NULL").select(*doc, "window", "n", "start")
    rest = rest.filter("o IS NOT NULL").select(*doc, "window", "n", "start", "wanted", F.col("o.offset").alias("offset"), F.col("o.term").alias("term"), (F.col("start") + F.col("o.offset")).alias("place"))
    # Written, so that its size is known before the join: the postings are not shuffled for a set that Spark can send.
    in_docs = stored(agreed.select(*[F.col(c).alias(f"a_{c}") for c in doc]).distinct())
    searched = lists.join(in_docs, F.col("id").eqNullSafe(F.col("a_id")) & (F.col("text_key") == F.col("a_text_key")), "left_semi")
    full = _meet(rest, searched, 0).groupBy(*doc, "window", "n", "start", "wanted").agg(F.bit_or(F.expr("shiftleft(1L, offset)")).alias("there"))
    full = full.filter("there = wanted").select(*doc, "window", "n", "start").unionByName(certain)
    found = stored(full.select(*doc, "window", "start", (F.col("start") + F.col("n")).alias("end")))

    reached = F.max("end").over(W.partitionBy(*doc).orderBy("start", "end").rowsBetween(W.unboundedPreceding, -1))
    new = F.greatest(F.lit(0), F.col("end") - F.greatest("start", F.coalesce(reached, F.col("start"))))
    hit = found.select(*doc, "start", "end").distinct().withColumn("new", new).groupBy(*doc).agg(F.sum("new").alias("n_hit"))
    items = found.select(*doc, "window").distinct().join(spans.select("window", "item_id"), "window").groupBy(*doc).agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    stands = found.select(*[F.col(c).alias(f"f_{c}") for c in (*doc, "window")]).distinct()
    same = F.col("id").eqNullSafe(F.col("f_id")) & (F.col("text_key") == F.col("f_text_key")) & (F.col("window") == F.col("f_window"))
    near = met.select(*doc, "window").distinct().join(stands, same, "left_anti").groupBy(*doc).agg(F.count("*").alias("n_near"))

    every = posted.filter("term IS NULL").select(*doc, "n_words")
    for part in (hit, items, near):
        part = part.withColumnsRenamed({"id": "p_id", "text_key": "p_key"})
        every = every.join(part, every["id"].eqNullSafe(part["p_id"]) & (every["text_key"] == part["p_key"]), "left").drop("p_id", "p_key")
    none = F.array().cast("array<string>")
    return every.select(
        F.col("id").alias(id_col), "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(F.coalesce("items", none)).cast("long").alias("n_items"),
        F.coalesce("items", none).alias("items"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "text_key",
    )


def verdict(n_hit: Column, n_words: Column) -> Column:
    """Contaminated: at least one word in twenty is hit."""
    return (n_hit > 0) & (20 * n_hit >= n_words)
