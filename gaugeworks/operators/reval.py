"""Retrieval quality of ranked results (``query_id, chunk_id, rank`` from 1) against expected chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

METRICS = ("recall_at_5", "recall_at_10", "precision_at_5", "mrr", "ndcg_at_10", "hit_rate")


def ir_metrics(results: DataFrame, expected: DataFrame) -> DataFrame:
    """Per query of ``expected`` (``query_id, scenario, expected`` array): recall, precision, MRR, nDCG and ``hit``, rounded to 4.

    A query that expects nothing has recall and nDCG 1.
    """
    want = expected.select("query_id", "scenario", F.array_distinct("expected").alias("expected"))
    each = want.select("query_id", F.explode("expected").alias("chunk_id"))
    return _measured(want.select("query_id", "scenario", F.size("expected").alias("n")), _first(results).join(each, ["query_id", "chunk_id"], "left_semi"))


def ir_metrics_of_groups(results: DataFrame, queries: DataFrame, members: DataFrame) -> DataFrame:
    """``ir_metrics`` where queries (``query_id, scenario, group``) share what they expect: the members (``group, chunk_id``) of a group.

    Pairs of queries and members aren't made. A query whose group has no member is left out.
    """
    own = members.filter("group IS NOT NULL").select("group", "chunk_id").distinct()
    want = queries.join(own.groupBy("group").agg(F.count("*").cast("int").alias("n")), "group")
    ranks = _first(results).join(queries.select("query_id", "group"), "query_id").join(own, ["group", "chunk_id"], "left_semi")
    return _measured(want.select("query_id", "scenario", "n"), ranks)


def _first(results: DataFrame) -> DataFrame:
    return results.select("query_id", "chunk_id", "rank").filter("rank <= 10")


def _measured(want: DataFrame, ranks: DataFrame) -> DataFrame:
    """The measures of queries that expect ``n`` chunks, from their ``ranks`` of those."""
    hits = ranks.groupBy("query_id").agg(F.count_if(F.col("rank") <= 5).alias("h5"), F.count("*").alias("h10"), F.min("rank").alias("first"), F.sum(1 / F.log2(F.col("rank") + 1)).alias("dcg"))
    n = F.col("n")
    ideal = F.aggregate(F.when(n > 0, F.sequence(F.lit(1), F.least(n, F.lit(10)))).otherwise(F.array().cast("array<int>")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1.0))
    zero = lambda c: F.coalesce(c, F.lit(0))
    share = lambda c: F.round(F.when(n == 0, 1.0).otherwise(zero(c) / n), 4)
    return want.join(hits, "query_id", "left").select(
        "query_id", "scenario", share("h5").alias("recall_at_5"), share("h10").alias("recall_at_10"), F.round(zero("h5") / 5, 4).alias("precision_at_5"),
        F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 4).alias("mrr"), F.round(F.when(n == 0, 1.0).otherwise(F.coalesce("dcg", F.lit(0.0)) / ideal), 4).alias("ndcg_at_10"),
        ((n == 0) | (zero("h10") > 0)).alias("hit"),
    )


def ir_summary(metrics: DataFrame) -> DataFrame:
    """Means overall (``scenario`` "all") and per scenario, in one pass."""
    rows = metrics.withColumn("hit_rate", F.col("hit").cast("double")).withColumn("scenario", F.coalesce("scenario", F.lit("none")))
    name = F.when(F.grouping("scenario") == 1, "all").otherwise(F.col("scenario"))
    sets = rows.groupingSets([[], [F.col("scenario")]], F.col("scenario"))
    return sets.agg(name.alias("name"), F.count("*").alias("queries"), *[F.round(F.avg(m), 6).alias(m) for m in METRICS]).select(F.col("name").alias("scenario"), "queries", *METRICS)


def ir_gate(summaries: DataFrame, least_recall: float = 0.70, least_mrr: float = 0.50) -> DataFrame:
    """Overall figures of each run (``run`` and the columns of ``ir_summary``): passed or not, and change since the run before."""
    overall = summaries.filter("scenario = 'all'")
    order = W.orderBy("run")  # one row per run
    delta = lambda c: F.round(F.col(c) - F.lag(c).over(order), 6).alias(f"{c}_delta")
    return overall.select("run", "recall_at_5", "mrr", ((F.col("recall_at_5") >= least_recall) & (F.col("mrr") >= least_mrr)).alias("passed"), delta("recall_at_5"), delta("mrr"))
