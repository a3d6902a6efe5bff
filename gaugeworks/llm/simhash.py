"""SimHash fingerprints and multi-index hashing.

Two fingerprints within 2 bits agree on the upper half but for at most 1 bit, or on the lower half
exactly. So the table has every fingerprint under both of its halves, and a search enumerates the ball of
radius 1 around its upper half and of radius 0 around its lower half, fetches what the table holds there
and verifies the whole distance. Where many fingerprints share a half (a large group of near copies), the
search goes on with the ball of the other half, so it fetches single fingerprints and no half is
searched pair by pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut
from .components import components

BUSY = 64  # a half that more fingerprints share is searched by the balls of the other half
BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
LOW = 0xFFFFFFFF


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The 64-bit SimHash of a text's word shingles, as an unsigned number; 0 without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*[words[i:] for i in range(shingle)], strict=False))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(g, 42) for g in grams], dtype=">u8")
    # Set bits by counting the values of each of the eight bytes.
    seen = np.stack([np.bincount(b, minlength=256) for b in hashes.view(np.uint8).reshape(-1, 8).T])
    ones = (seen @ BITS).ravel()
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(df: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``bits``, the fingerprint of each whole text as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t, shingle) for t in batch.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["id", "bits"])

    rows = df.select(df[id_col].alias("id"), df[text_col].alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, bits long").withColumnRenamed("id", id_col)


def _ball(value: Column, radius: int) -> Column:
    """All 32-bit numbers within ``radius`` (0 to 2) bits of ``value``."""
    one = [F.lit(1 << i) for i in range(32)]
    masks = [F.lit(0)] + one * (radius > 0) + [F.lit(1 << i | 1 << j) for i in range(32) for j in range(i)] * (radius > 1)
    return F.transform(F.array(*[m.cast("long") for m in masks]), lambda m: value.bitwiseXOR(m))


def links(prints: DataFrame) -> DataFrame:
    """All pairs ``src < dst`` of distinct fingerprints (column ``bits``) that differ in 1 or 2 bits."""
    bits = F.col("bits")
    high, low = F.shiftrightunsigned("bits", 32), bits.bitwiseAND(F.lit(LOW))
    table = prints.select("bits", F.explode(F.array(F.struct(F.lit(0).alias("half"), high.alias("key")), F.struct(F.lit(1).alias("half"), low.alias("key")))).alias("at"))
    table = table.select("bits", "at.half", "at.key")
    tries = F.concat(F.transform(_ball(high, 1), lambda k: F.struct(F.lit(0).alias("half"), k.alias("key"))), F.array(F.struct(F.lit(1).alias("half"), low.alias("key"))))
    search = prints.select("bits", F.explode(tries).alias("at")).select("bits", "at.half", "at.key")
    busy = table.groupBy("half", "key").count().filter(F.col("count") > BUSY).select("half", "key")

    few = table.join(busy, ["half", "key"], "left_anti").withColumnRenamed("bits", "other")
    close = lambda d: d.filter((bits < F.col("other")) & (F.bit_count(bits.bitwiseXOR(F.col("other"))) <= 2)).select(bits.alias("src"), F.col("other").alias("dst"))
    # Spark takes an explode to keep the number of rows: 34 for each fingerprint would seem small enough to broadcast.
    found = close(search.hint("merge").join(few, ["half", "key"]))

    many = search.join(busy, ["half", "key"], "left_semi")
    same = F.when(F.col("half") == 0, F.col("key") == high).otherwise(F.lit(True))
    rest = F.when(F.col("half") == 0, low).otherwise(high)
    around = F.when(same, _ball(rest, 2)).otherwise(_ball(rest, 1))
    join_halves = lambda r: F.when(F.col("half") == 0, F.shiftleft("key", 32).bitwiseOR(r)).otherwise(F.shiftleft(r, 32).bitwiseOR(F.col("key")))
    single = many.select("bits", F.explode(F.transform(around, join_halves)).alias("other")).filter(bits < F.col("other"))
    exact = single.join(prints.select(bits.alias("other")), "other", "left_semi")
    return found.union(close(exact)).distinct()


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """Fingerprint and component of every document: ``id_col, fingerprint, component_id``.

    Documents link where their fingerprints differ in at most 2 bits; ``component_id`` is the least id
    that links reach, null if all ids there are null. A null or empty text has fingerprint zero and links
    like any other. One row per input row: repeated rows repeat and share a component. An empty table
    gives an empty one; other columns are ignored.
    """
    marks = cut(fingerprints(df, shingle, id_col, text_col))
    classes = marks.groupBy("bits").agg(F.min(id_col).alias("least"))
    found = components(links(classes.select("bits")))
    known = classes.join(found.withColumnRenamed("node", "bits"), "bits", "left").select("bits", "least", F.coalesce("component", "bits").alias("component"))
    lowest = known.groupBy("component").agg(F.min("least").alias("component_id"))
    named = cut(known.join(lowest, "component").select("bits", "component_id"))
    text = F.lower(F.lpad(F.hex("bits"), 16, "0"))
    return marks.join(named, "bits").select(id_col, text.alias("fingerprint"), "component_id")
