"""Approximate nearest neighbours on shifted space-filling curves.

Each curve is a random rotation of the vectors to a few dimensions, shifted, cut to a grid and ordered by
Hilbert key. Spark range-partitions all curves by key; runs of consecutive rows are blocks. A query meets
the blocks within a reach of its own on every curve, the windows of all curves are merged, and the
candidates are ranked by their exact inner products. The reach is fitted: for a bounded sample of queries
the true neighbours are found by brute force, and the reach is the distance along the best curve within
which the wanted share of them lies.

Equal vectors are one class, so any number of copies costs one row; a class keeps its smallest ids, as
many as a query can return.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut

CURVES, DIMS, BITS = 8, 8, 6
SAMPLE = 64  # queries for fitting the reach
WITHIN = 0.95  # share of the sample's true neighbours that the reach takes in
BLOCK = (128, 8192)  # least and most rows of a block
ASKED = 4096  # about so many queries meet a block in one group; beyond that, the block has a group for each part of them


def hilbert_keys(grid: np.ndarray, bits: int) -> np.ndarray:
    """Place of each row of non-negative numbers below ``2 ** bits`` on the Hilbert curve (Skilling's transform)."""
    x = grid.T.astype(np.int64).copy()
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(len(x)):
            on = (x[i] & q) > 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(on, low, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    gray = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        gray ^= np.where((x[-1] & q) > 0, q - 1, 0)
        q >>= 1
    x ^= gray
    key = np.zeros(len(grid), dtype=np.int64)
    for b in range(bits - 1, -1, -1):
        for row in x:
            key = key << 1 | (row >> b & 1)
    return key


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)


def usable(df: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, int]:
    """``id, vec`` of the rows that take part, and their dimension.

    Left out: null ids, vectors that are null, empty, zero or hold a null or non-finite component, and vectors
    of another length than the most common one (of equally common ones, the longest). Repeated rows count once.
    """
    rows = df.select(df[id_col].alias("id"), df[vec_col].alias("vec")).filter("id IS NOT NULL AND vec IS NOT NULL")
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = rows.filter(~F.exists("vec", odd) & F.exists("vec", lambda x: x != 0))
    sizes = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    size = sizes[0].n if sizes else 0
    return rows.filter(F.size("vec") == size), size


def moments(vecs: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance of all vectors, from sums by task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size + 1, size + 1))
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(0), size)
                x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
                total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["at", "value"])

    sums = vecs.select("vec").mapInArrow(run, "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).toPandas()
    total = np.zeros((size + 1) ** 2)
    total[sums["at"]] = sums["value"]
    total = total.reshape(size + 1, size + 1)
    n = max(total[-1, -1], 1)
    mean = total[-1, :-1] / n
    return mean, total[:-1, :-1] / n - np.outer(mean, mean)


def _curves(mean: np.ndarray, cov: np.ndarray, curves: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rotation, scale, offset) of each curve."""
    size, out = len(mean), []
    for c in range(curves):
        rng = np.random.default_rng(c)
        rotation = np.linalg.qr(rng.normal(size=(size, size)))[0][:, : min(DIMS, size)]
        scale = 1 / np.sqrt(np.maximum(np.einsum("ij,ik,kj->j", rotation, cov, rotation), 1e-30))
        out.append((rotation, scale, rng.normal(0, 0.3, len(scale)) - mean @ rotation * scale))
    return out


def order(classes: DataFrame, size: int, curves: int = CURVES) -> DataFrame:
    """All classes on all curves in key order: ``curve, key, rep, vec, asks, part, seq``, cut by partition."""
    plans = classes.sparkSession.sparkContext.broadcast(_curves(*moments(classes, size), curves))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1), size)
            for c, (rotation, scale, offset) in enumerate(plans.value):
                y = x @ rotation * scale + offset
                grid = np.clip((y + 3) / 6 * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), c, dtype=np.int32)), pa.array(hilbert_keys(grid, BITS)), *batch.columns], ["curve", "key", *batch.schema.names])

    placed = classes.select("rep", "vec", "asks").mapInArrow(run, f"curve int, key long, rep long, vec {classes.schema['vec'].dataType.simpleString()}, asks boolean")
    parts = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = placed.repartitionByRange(parts, "curve", "key", "rep").sortWithinPartitions("curve", "key", "rep")
    numbered = ranged.withColumn("row", F.monotonically_increasing_id())
    return cut(numbered.withColumn("part", F.shiftright("row", 33)).withColumn("seq", F.col("row").bitwiseAND(F.lit((1 << 33) - 1))).drop("row"))


def brute(queries: DataFrame, classes: DataFrame, size: int, k: int) -> DataFrame:
    """The ``k`` classes of largest inner product for a bounded number of queries (``rep, vec``), excluding themselves."""
    asked = [(r.rep, np.array(r.vec, dtype=np.float64)) for r in queries.collect()]
    sent = classes.sparkSession.sparkContext.broadcast(asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reps = np.array([r for r, _ in sent.value], dtype=np.int64)
        q = np.array([v for _, v in sent.value]).reshape(-1, size)
        for batch in batches:
            if not batch.num_rows or not len(reps):
                continue
            own = batch.column(0).to_numpy()
            score = q @ _matrix(batch.column(1), size).T
            score[reps[:, None] == own] = -np.inf
            top = np.argsort(-score, axis=1, kind="stable")[:, :k]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(reps, top.shape[1])), pa.array(own[top].ravel()), pa.array(np.take_along_axis(score, top, axis=1).ravel())], ["q_rep", "rep", "score"])

    found = classes.select("rep", "vec").mapInArrow(run, "q_rep long, rep long, score double").filter(F.col("score") > float("-inf"))
    best = W.partitionBy("q_rep").orderBy(F.desc("score"), "rep")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).drop("rank")


def _fit_reach(ordered: DataFrame, offsets: DataFrame, classes: DataFrame, size: int, k: int, within: float) -> int:
    sample = classes.filter("asks").orderBy(F.xxhash64("rep")).limit(SAMPLE).select("rep", "vec")
    true = cut(brute(sample, classes, size, k).select("q_rep", "rep"))
    place = ordered.join(F.broadcast(offsets), ["curve", "part"]).select("curve", "rep", (F.col("first") + F.col("seq")).alias("place"))
    mine = place.join(F.broadcast(sample.select("rep")), "rep").withColumnsRenamed({"rep": "q_rep", "place": "q_place"})
    theirs = place.join(F.broadcast(true.select("rep").distinct()), "rep")  # at most SAMPLE * k rows
    gaps = true.join(theirs, "rep").join(mine, ["q_rep", "curve"]).groupBy("q_rep", "rep").agg(F.min(F.abs(F.col("place") - F.col("q_place"))).alias("gap"))
    at = gaps.agg(F.percentile("gap", F.lit(within)).alias("at")).first()["at"]
    return 1 if at is None else max(1, int(np.ceil(at)))


def _search(blocks: DataFrame, size: int, k: int) -> DataFrame:
    """Per block, the best classes for each query that meets it: ``q_rep, rep, score``."""

    def run(table: pa.Table) -> pa.Table:
        asks = table.column("q").to_numpy()
        vecs = _matrix(table.column("vec").combine_chunks(), size)
        reps = table.column("rep").to_numpy()
        q_reps, own, x = reps[asks], reps[~asks], vecs[~asks]
        out = []
        for i in range(0, len(q_reps) if len(own) else 0, 1024):
            score = vecs[asks][i : i + 1024] @ x.T
            top = np.argsort(-score, axis=1, kind="stable")[:, :k] if len(own) <= 4 * k else None
            if top is None:
                some = np.sort(np.argpartition(-score, k, axis=1)[:, : 2 * k], axis=1)
                top = np.take_along_axis(some, np.argsort(-np.take_along_axis(score, some, axis=1), axis=1, kind="stable"), axis=1)[:, :k]
            out.append((np.repeat(q_reps[i : i + 1024], top.shape[1]), own[top].ravel(), np.take_along_axis(score, top, axis=1).ravel()))
        parts = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table({"q_rep": pa.array(parts[0], pa.int64()), "rep": pa.array(parts[1], pa.int64()), "score": pa.array(parts[2], pa.float64())})

    return blocks.groupBy("curve", "block", "part").applyInArrow(run, "q_rep long, rep long, score double")


def nearest(df: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", curves: int = CURVES, within: float = WITHIN) -> DataFrame:
    """The ``k`` nearest found of each query: ``query_id, rank`` (from 1), ``vec_id, score``.

    Queries are the rows whose id is divisible by ``every``; candidates are all rows but the query's own;
    nearness is the inner product in double precision, ties go to the smaller id; fewer candidates give
    fewer rows. ``usable`` says which rows take part. Ids are whole numbers; other columns are ignored; no
    usable rows give an empty result.
    """
    rows, size = usable(df, id_col, vec_col)
    empty = "SELECT cast(null AS long) AS query_id, cast(null AS int) AS rank, cast(null AS long) AS vec_id, cast(null AS double) AS score LIMIT 0"
    if not size:
        return df.sparkSession.sql(empty)
    rows = rows.withColumn("id", F.col("id").cast("long"))
    # A class per distinct vector, with its k + 1 smallest ids: a query never returns more, its own aside.
    few = rows.distinct().withColumn("nth", F.row_number().over(W.partitionBy("vec").orderBy("id"))).filter(F.col("nth") <= k + 1)
    listed = few.groupBy("vec").agg(F.array_sort(F.collect_list("id")).alias("ids")).withColumn("rep", F.element_at("ids", 1))
    asking = rows.filter(F.col("id") % every == 0).select("vec").distinct().withColumn("asks", F.lit(True))
    classes = cut(listed.join(asking, "vec", "left").withColumn("asks", F.coalesce("asks", F.lit(False))))
    queries = rows.filter(F.col("id") % every == 0).select(F.col("id").alias("query_id"), "vec").distinct().join(classes.select("vec", "rep"), "vec").select("query_id", F.col("rep").alias("q_rep"))

    ordered = order(classes, size, curves)
    sizes = ordered.groupBy("curve", "part").count()  # a row per partition and curve
    offsets = cut(sizes.withColumn("first", F.sum("count").over(W.partitionBy("curve").orderBy("part").rowsBetween(W.unboundedPreceding, -1))).select("curve", "part", F.coalesce("first", F.lit(0)).alias("first"), "count"))
    starts = ordered.groupBy("curve", "part").agg(F.min("seq").alias("low"))
    offsets = cut(offsets.join(starts, ["curve", "part"]).select("curve", "part", (F.col("first") - F.col("low")).alias("first")))
    total = classes.count()
    reach = _fit_reach(ordered, offsets, classes, size, k, within)
    block = int(min(max(reach // 2, BLOCK[0]), BLOCK[1]))
    last = (total - 1) // block
    around = -(-reach // block)

    placed = ordered.join(F.broadcast(offsets), ["curve", "part"])
    placed = placed.withColumn("block", ((F.col("first") + F.col("seq")) / block).cast("long")).select("curve", "block", "rep", "vec", "asks")
    near = F.sequence(F.greatest(F.col("block") - around, F.lit(0).cast("long")), F.least(F.col("block") + around, F.lit(last).cast("long")))
    # The queries that reach a block grow with the table, so they are dealt to parts, each with a copy of the block.
    meeting = classes.filter("asks").count() * min(1.0, (2 * around + 1) * block / total)
    parts = max(1, int(np.ceil(meeting / ASKED)))
    asked = placed.filter("asks").withColumn("part", F.pmod(F.xxhash64("rep"), F.lit(parts)).cast("int")).withColumn("block", F.explode(near))
    asked = asked.select("curve", "block", "part", "rep", "vec", F.lit(True).alias("q"))
    own = placed.select("curve", "block", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "rep", "vec", F.lit(False).alias("q"))
    found = _search(own.unionByName(asked), size, k + 1)

    best = W.partitionBy("q_rep").orderBy(F.desc("score"), "rep")
    kept = found.groupBy("q_rep", "rep").agg(F.max("score").alias("score")).withColumn("nth", F.row_number().over(best)).filter(F.col("nth") <= k + 1)
    ids = kept.join(classes.select("rep", "ids"), "rep").select("q_rep", "score", F.explode("ids").alias("vec_id"))
    first = W.partitionBy("q_rep").orderBy(F.desc("score"), "vec_id")
    ids = cut(ids.withColumn("nth", F.row_number().over(first)).filter(F.col("nth") <= k + 1))
    # A query's own id takes a place of its class's list; those behind it move up.
    own = ids.select(F.col("q_rep").alias("o_rep"), F.col("vec_id").alias("query_id"), F.col("nth").alias("own"))
    ranked = queries.join(own, (F.col("q_rep") == F.col("o_rep")) & (queries["query_id"] == own["query_id"]), "left").select(queries["query_id"], "q_rep", "own").join(ids, "q_rep")
    ranked = ranked.filter((F.col("own").isNull()) | (F.col("nth") != F.col("own"))).withColumn("rank", F.col("nth") - F.when(F.col("nth") > F.col("own"), 1).otherwise(0))
    return ranked.filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
