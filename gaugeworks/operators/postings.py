"""A lexical index of impact-ordered posting blocks, and exact top-k search that reads only the blocks that can matter.

A posting is a term's part of a chunk's BM25 score. The postings of a term lie in blocks by falling part; each block is
known by its largest. A search first scores the chunks of each query's rarest terms, which gives a bar: the k-th best
score so far. With the query's terms in order of their largest part, a block of t and the largest parts of the terms
behind t bound what a chunk can have from there on. Blocks from where less than half of the bar can be reached aren't
read; those of common terms stand last in that order. A chunk that can be among the best has the other half in the
blocks that are read: only such chunks are scored in full.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import stored

STEPS = 4  # blocks for each doubling of the part
SEED = 64  # postings of the rarest terms that set the bar, in multiples of k
POOL = 8  # chunks of these that are scored in full, in multiples of k
SHARE = 0.5  # of the bar: blocks that can't reach so much aren't read, and a chunk needs the rest from those that are
SLACK = 2e-6  # scores are rounded to 6 digits; a chunk this close to the bar may tie with it


def _words(text: str | Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def terms(docs: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """``id, term, tf, size`` of lower-cased words; ``size`` is the number of words of the row."""
    words = docs.select(F.col(id_col), _words(text_col).alias("words"))
    each = words.select(id_col, F.size("words").alias("size"), F.explode("words").alias("term"))
    return each.groupBy(id_col, "term").agg(F.count("*").alias("tf"), F.first("size").alias("size"))


def _counted(chunks: DataFrame, wanted: DataFrame | None) -> DataFrame:
    """``chunk_id, term, tf, size``; words that aren't wanted are left out before they are counted.

    A row with an empty term stands for the chunk itself, so one pass gives the chunks' number and sizes too.
    """
    words = chunks.select("chunk_id", F.coalesce(_words("text"), F.array().cast("array<string>")).alias("words"))
    each = words.select("chunk_id", F.size("words").alias("size"), F.explode(F.array_append("words", F.lit(""))).alias("term"))
    if wanted is not None:
        own = chunks.sparkSession.range(1).select(F.lit("").alias("term"))
        each = each.join(wanted.select("term").union(own).distinct(), "term", "left_semi")
    return each.groupBy("chunk_id", "term").agg(F.count("*").alias("tf"), F.first("size").alias("size"))


@dataclass(frozen=True)
class Index:
    """``postings``: ``term, block, chunk_id, part``; ``blocks``: ``term, block, n, bound`` (its largest part)."""

    postings: DataFrame
    blocks: DataFrame


def build_index(chunks: DataFrame, wanted: DataFrame | None = None, k1: float = 1.2, b: float = 0.75) -> Index:
    """The index of ``chunks`` (``chunk_id, text``), written once; with ``wanted`` (``term``) of those terms only.

    Document frequencies, the number of chunks and their mean size are those of all chunks.
    """
    counted = stored(_counted(chunks, wanted))
    whole = counted.filter("term = ''").agg(F.sum("tf").alias("n"), (F.sum(F.col("size") * F.col("tf")) / F.sum("tf")).alias("mean"))  # one row
    df = counted.filter("term <> ''").groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("size") / F.col("mean")))
    parts = counted.filter("term <> ''").join(df, "term").crossJoin(F.broadcast(whole)).select("term", "chunk_id", (idf * weight).alias("part"))
    postings = stored(parts.withColumn("block", F.floor(STEPS * F.log2("part")).cast("int")))
    return Index(postings, stored(postings.groupBy("term", "block").agg(F.count("*").alias("n"), F.max("part").alias("bound"))))


def _scores(pairs: DataFrame, q: DataFrame, index: Index) -> DataFrame:
    """The whole score of each of ``pairs`` (``query_id, chunk_id``)."""
    met = pairs.join(q.select("query_id", "term", "q_tf"), "query_id").join(index.postings.select("term", "chunk_id", "part"), ["term", "chunk_id"])
    return met.groupBy("query_id", "chunk_id").agg(F.round(F.sum(F.col("part") * F.col("q_tf")), 6).alias("score"))


def top(scored: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(order) - 1).filter(F.col("rank") < k).select("query_id", "chunk_id", "score", "rank")


def weighed_terms(queries: DataFrame, index: Index, k: int) -> DataFrame:
    """``query_id, term, q_tf, most, after, seed``: of each term that the index has its largest part of a score, the sum of
    those of the query's terms behind it in that order, and whether it is one of the rarest, which set the bar.
    """
    known = index.blocks.groupBy("term").agg(F.sum("n").alias("df"), F.max("bound").alias("bound"))
    q = terms(queries, "query_id").select("query_id", "term", F.col("tf").alias("q_tf")).join(known, "term")
    most = F.col("q_tf") * F.col("bound")
    behind = W.partitionBy("query_id").orderBy(F.desc("most"), "term").rowsBetween(1, W.unboundedFollowing)
    rarer = W.partitionBy("query_id").orderBy("df", "term").rowsBetween(W.unboundedPreceding, -1)
    q = q.withColumn("most", most).withColumn("after", F.coalesce(F.sum("most").over(behind), F.lit(0.0)))
    return q.withColumn("seed", F.coalesce(F.sum("df").over(rarer), F.lit(0)) < SEED * k).select("query_id", "term", "q_tf", "most", "after", "seed")


def wanted_blocks(q: DataFrame, index: Index, k: int) -> DataFrame:
    """``query_id, term, block, q_tf, bound, n, bar, read``: every block of every term of ``q`` (of ``weighed_terms``), and whether it is to be read.

    ``bar`` is the k-th best score of the chunks that the rarest terms have; null, and all is read, where there are fewer.
    """
    seeds = q.filter("seed").join(index.postings, "term").groupBy("query_id", "chunk_id").agg(F.sum(F.col("part") * F.col("q_tf")).alias("score"))
    first = _scores(top(seeds, POOL * k).select("query_id", "chunk_id"), q, index)
    bars = top(first, k).filter(F.col("rank") == k - 1).select("query_id", F.col("score").alias("bar"))
    reach = F.col("q_tf") * F.col("bound") + F.col("after")
    met = q.join(bars, "query_id", "left").join(index.blocks, "term")
    return met.select("query_id", "term", "block", "q_tf", "bound", "n", "bar", F.coalesce(reach >= SHARE * F.col("bar") - SLACK, F.lit(True)).alias("read"))


def search(queries: DataFrame, index: Index, k: int = 30) -> DataFrame:
    """The ``k`` chunks of best BM25 for each query (``query_id, text``): ``query_id, chunk_id, score, rank`` (from 0).

    Exact: equal to scoring every chunk that has a term of the query, ties by ``chunk_id``.
    """
    q = stored(weighed_terms(queries, index, k))
    blocks = stored(wanted_blocks(q, index, k))
    # What isn't read adds less than SHARE of the bar to any chunk: of each term the largest part of those blocks.
    unread = blocks.groupBy("query_id", "term").agg(F.any_value("bar").alias("bar"), F.coalesce(F.max(F.when(~F.col("read"), F.col("q_tf") * F.col("bound"))), F.lit(0.0)).alias("part"))
    unread = unread.groupBy("query_id").agg(F.any_value("bar").alias("bar"), F.sum("part").alias("unread"))
    read = blocks.filter("read").select("query_id", "term", "block", "q_tf").join(index.postings, ["term", "block"])
    known = read.groupBy("query_id", "chunk_id").agg(F.sum(F.col("part") * F.col("q_tf")).alias("known"))
    open_ = known.join(unread, "query_id").filter(F.col("bar").isNull() | (F.col("known") + F.col("unread") >= F.col("bar") - SLACK))
    return top(_scores(open_.select("query_id", "chunk_id"), q, index), k)
