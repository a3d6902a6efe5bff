"""Devices alike in their sets of codes: exact top-k set similarity.

Devices of equal codes and model are one class. Classes that hold a device asked about meet all classes block by block
(see ``blocks``): common codes are a product of matrices, so pairs are cells of a bounded matrix, however many devices
share a code. A class is known by its smallest id and names its ``k + 1`` smallest, which is all that a best list can need.

``candidates`` is a join for large vocabularies of rare codes, by a bound: the codes of a set stand in one global order,
the rarest first. If the first code that two sets share is the i-th of a query's a codes, they share at most a-i+1, which
bounds their Jaccard by the size b of the other set. The rarest codes, the smallest sets of the last code and devices of
the same model give a bar, the k-th best of what pairs have at least. Cells (code, size, model) are opened only if their
bound reaches the bar. Two sets that share nothing but the query's last code have a score that follows from b alone, so of
that code, which is the most common one, only the smallest sets are needed.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import stored
from . import blocks

SEED = 16  # devices of the rarest codes that set the bar, in multiples of k
SLACK = 0.001  # scores are rounded to 3 digits
SAME_MODEL = 0.5


def code_sets(codes: DataFrame, info: DataFrame) -> DataFrame:
    """``device_id, model, codes, size``: the sorted distinct codes of each device that has any (``device_id, error_code``)."""
    sets = codes.filter("error_code IS NOT NULL").groupBy("device_id").agg(F.array_sort(F.collect_set("error_code")).alias("codes"))
    return sets.join(info.select("device_id", "model"), "device_id", "left").select("device_id", "model", "codes", F.size("codes").alias("size"))


def _posted(sets: DataFrame, k: int) -> DataFrame:
    """``error_code, other_id, b, other_model`` of every set; of devices with equal sets and models only the ``k + 1`` smallest ids, as all have equal scores."""
    nth = F.row_number().over(W.partitionBy("codes", "model").orderBy("device_id"))
    kept = sets.withColumn("nth", nth).filter(F.col("nth") <= k + 1)
    return kept.select(F.explode("codes").alias("error_code"), F.col("device_id").alias("other_id"), F.col("size").alias("b"), F.col("model").alias("other_model"))


def _ordered(asked: DataFrame, posted: DataFrame, k: int) -> DataFrame:
    """``device_id, model, a, error_code, i, seed``: the codes of the sets of ``asked``, the rarest first."""
    freq = posted.groupBy("error_code").agg(F.count("*").alias("freq"))
    each = asked.select("device_id", "model", F.col("size").alias("a"), F.explode("codes").alias("error_code")).join(freq, "error_code")
    order = W.partitionBy("device_id").orderBy("freq", "error_code")
    before = F.coalesce(F.sum("freq").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return each.select("device_id", "model", "a", "error_code", F.row_number().over(order).alias("i"), (before < SEED * k).alias("seed"))


def _bonus(weight: float) -> Column:
    return F.when(F.col("model") == F.col("other_model"), weight).otherwise(0.0)


def _smallest(last: DataFrame, posted: DataFrame, k: int, by_model: bool) -> DataFrame:
    """Pairs with the smallest sets of a query's last code, of all devices and, if ``by_model``, of those of the same model.

    Of each size the ``k + 1`` smallest ids, of sizes up to that of the ``k + 1``-th set and those that round to the same score.
    """
    # A group is a code's sets, or those of one model: each set and each query stands in both.
    models = lambda c: F.explode(F.array_compact(F.array(F.struct(F.lit(True).alias("any"), F.lit("").alias("of")), F.when(F.col(c).isNotNull() & F.lit(by_model), F.struct(F.lit(False).alias("any"), F.col(c).alias("of"))))))
    group = ["error_code", "g"]
    nth = F.row_number().over(W.partitionBy(*group, "b").orderBy("other_id"))
    first = posted.withColumn("g", models("other_model")).withColumn("nth", nth).filter(F.col("nth") <= k + 1).drop("nth")
    counts = first.groupBy(*group, "b").agg(F.count("*").alias("n"))
    in_order = W.partitionBy(*group).orderBy("b")
    counts = counts.withColumn("passed", F.sum("n").over(in_order) - F.col("n"))
    counts = counts.withColumn("end", F.max(F.when(F.col("passed") <= k, F.col("b"))).over(W.partitionBy(*group)))
    near = 1 / (F.col("a") + F.col("b") - 1) >= 1 / (F.col("a") + F.col("end") - 1) - SLACK
    sizes = last.withColumn("g", models("model")).join(counts, group).filter(near).select("device_id", "model", "a", *group, "b")
    met = sizes.join(first, [*group, "b"]).filter("device_id <> other_id")
    return met.select("device_id", "model", "a", "other_id", "b", "other_model").distinct()


def candidates(asked: DataFrame, sets: DataFrame, k: int, model_weight: float, alike: DataFrame | None = None) -> DataFrame:
    """``device_id, other_id``: every pair with a common code that can be among the ``k`` best of a device of ``asked`` (its rows of ``sets``).

    ``alike`` has pairs of equal models, which have ``model_weight`` at least.
    """
    posted = stored(_posted(sets, k))
    q = stored(_ordered(asked, posted, k))
    last = q.filter(F.col("i") == F.col("a"))
    met = q.filter("seed").join(posted, "error_code").filter("device_id <> other_id")
    met = met.groupBy("device_id", "model", "a", "other_id", "b", "other_model").agg(F.count("*").alias("n"))
    small = stored(_smallest(last, posted, k, model_weight > 0))
    # What pairs have at least.
    least = met.unionByName(small.withColumn("n", F.lit(1).cast("long")))
    least = least.select("device_id", "other_id", (F.col("n") / (F.col("a") + F.col("b") - F.col("n")) + _bonus(model_weight)).alias("least"))
    if alike is not None:
        least = least.unionByName(alike.select("device_id", "other_id", F.lit(model_weight).alias("least")))
    least = least.groupBy("device_id", "other_id").agg(F.max("least").alias("least"))
    nth = F.row_number().over(W.partitionBy("device_id").orderBy(F.desc("least")))
    bars = least.withColumn("nth", nth).filter(F.col("nth") == k).select("device_id", F.col("least").alias("bar"))
    # Cells that can reach the bar; the last code has its own way above.
    cells = posted.select("error_code", "b", "other_model").distinct()
    most = (F.col("a") - F.col("i") + 1) / F.greatest(F.col("a"), F.col("i") - 1 + F.col("b")) + _bonus(model_weight)
    opened = q.filter(F.col("i") < F.col("a")).join(bars, "device_id", "left").join(cells, "error_code").filter(F.col("bar").isNull() | (most >= F.col("bar") - SLACK))
    opened = opened.select("device_id", "error_code", "b", F.coalesce("other_model", F.lit("")).alias("m"), F.col("other_model").isNull().alias("none"))
    rows = posted.select("error_code", "b", F.coalesce("other_model", F.lit("")).alias("m"), F.col("other_model").isNull().alias("none"), "other_id")
    found = opened.join(rows, ["error_code", "b", "m", "none"]).filter("device_id <> other_id").select("device_id", "other_id")
    return found.union(small.select("device_id", "other_id")).distinct()


def same_value(asked: DataFrame, info: DataFrame, col: str, k: int) -> DataFrame:
    """``device_id, other_id`` of an equal ``col``: what is alike only there ranks by id, so the ``k + 1`` smallest ids of each value are enough."""
    nth = F.row_number().over(W.partitionBy(col).orderBy("device_id"))
    first = info.filter(F.col(col).isNotNull()).withColumn("nth", nth).filter(F.col("nth") <= k + 1).select(col, F.col("device_id").alias("other_id"))
    return info.join(asked, "device_id", "left_semi").join(first, col).filter("device_id <> other_id").select("device_id", "other_id")


def _rounded(score: np.ndarray) -> np.ndarray:
    """Scores to 3 digits, half up in decimals as Spark's ``round``; they have few distinct values."""
    few, at = np.unique(score, return_inverse=True)
    return np.array([float(Decimal(repr(s)).quantize(Decimal("0.001"), ROUND_HALF_UP)) for s in few.tolist()])[at]


def _near(classes: DataFrame, asked: DataFrame, k: int, model_weight: float) -> DataFrame:
    """``query, other, score``: of each class of ``asked`` the ``k`` best of all ``classes`` (``class, model, codes``), itself among them, by rounded score and name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, open_, models, known = blocks.Block(), True, [], {None: -1}
        for batch in batches:
            asks, _, model, _, _ = batch.columns
            rows, query = (batch.filter(m) for m in (pc.invert(asks), asks))
            numbered = lambda c: np.array([known.setdefault(m, len(known)) for m in c.to_pylist()], np.int64)
            block.add(rows.column(1), rows.column(4))
            models.append(numbered(rows.column(2)))
            if not query.num_rows:
                continue
            if open_:
                block.close(lambda tf, size: np.ones(len(tf)))
                of, open_ = np.concatenate(models), False
            names, own, sizes = query.column(3).to_pylist(), numbered(query.column(2)), query.column(4).value_lengths().to_numpy()
            for first, n in block.scores(query.column(4)):
                these = slice(first, first + len(n))
                either = sizes[these, None] + block.sizes - n
                score = n / np.maximum(either, 1) + model_weight * ((own[these, None] == of) & (of >= 0))
                at, cols = blocks.best(np.where(score > 0, score, -np.inf), k, SLACK + 1e-6, _rounded)
                yield pa.RecordBatch.from_arrays([pa.array([names[first + i] for i in at], pa.string()), pa.array([block.names[i] for i in cols], pa.string()), pa.array(score[at, cols])], ["query", "other", "score"])

    rows = classes.select("class", "model", "codes")
    met = blocks.dealt(rows, "class", rows.join(asked, "class", "left_semi").withColumnRenamed("class", "query"), classes.count())
    found = met.select("asks", "class", "model", "query", "codes").mapInArrow(run, "query string, other string, score double")
    nth = F.row_number().over(W.partitionBy("query").orderBy(F.desc(F.round("score", 3)), "other"))
    return found.withColumn("nth", nth).filter(F.col("nth") <= k).drop("nth")


def most_alike(codes: DataFrame, info: DataFrame, queries: DataFrame, k: int, model_weight: float = SAME_MODEL) -> DataFrame:
    """``device_id, other_id, score, codes``: pairs that hold the ``k`` best of each of ``queries``, with their whole score and shared codes.

    The score is the Jaccard of the code sets, and ``model_weight`` if the models are equal.
    """
    sets = code_sets(codes, info)
    every = info.select("device_id", "model").join(sets.select("device_id", "codes"), "device_id", "full")
    every = stored(every.select("device_id", "model", F.coalesce("codes", F.array().cast("array<string>")).alias("codes")))
    nth = F.row_number().over(W.partitionBy("codes", "model").orderBy("device_id"))
    first = every.withColumn("nth", nth).filter(F.col("nth") <= k + 1)
    classes = stored(first.groupBy("codes", "model").agg(F.min("device_id").alias("class"), F.collect_list("device_id").alias("ids")))
    own = every.join(queries.select("device_id").distinct(), "device_id", "left_semi").alias("e").join(classes.alias("c"), F.expr("e.codes = c.codes AND e.model <=> c.model"))
    asked = stored(own.select("device_id", F.col("class").alias("query")))
    near = _near(classes, asked.select(F.col("query").alias("class")).distinct(), k + 1, model_weight)
    other = classes.select(F.col("class").alias("other"), F.col("codes").alias("other_codes"), "ids")
    both = near.join(classes.select(F.col("class").alias("query"), "codes"), "query").join(other, "other")
    each = both.select("query", "score", F.array_intersect("codes", "other_codes").alias("codes"), F.explode("ids").alias("other_id"))
    # A device is among its own best, so one more than k are kept.
    nth = F.row_number().over(W.partitionBy("query").orderBy(F.desc(F.round("score", 3)), "other_id"))
    each = each.withColumn("nth", nth).filter(F.col("nth") <= k + 1)
    return asked.join(each, "query").filter("device_id <> other_id").select("device_id", "other_id", "score", "codes")
