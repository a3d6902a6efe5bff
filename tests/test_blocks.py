"""Searches block by block: what they hold at a time, against plain sums, and groups of expected chunks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gaugeworks.operators import blocks, retrieval, reval

from .test_postings import brute, frames


def test_dense_search_holds_few_scores_at_a_time(spark, monkeypatch):
    """Many queries in one block are scored in runs, and equal scores go by the id."""
    monkeypatch.setattr(blocks, "CELLS", 400)
    r = np.random.default_rng(3)
    v = r.integers(-2, 3, (120, 3)).astype(float)
    v[v.any(axis=1) == 0] = 1
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "chunk_id long, vector array<double>")
    got = retrieval.dense_topk(rows.withColumnRenamed("chunk_id", "query_id"), rows, 5).collect()
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    cos = np.round(unit @ unit.T, 6)
    want = {(q, int(c), n) for q in range(120) for n, c in enumerate(np.lexsort((np.arange(120), -cos[q]))[:5])}
    assert {(x["query_id"], x["chunk_id"], x["rank"]) for x in got} == want
    widths = []
    monkeypatch.setattr(blocks, "best", lambda score, k, *a, f=blocks.best: widths.append(score.size) or f(score, k, *a))
    run = {}
    grouped = type(rows.groupBy("chunk_id").cogroup(rows.groupBy("chunk_id")))
    monkeypatch.setattr(grouped, "applyInPandas", lambda self, f, s, g=grouped.applyInPandas: run.setdefault("f", f) and g(self, f, s))
    retrieval.dense_topk(rows.withColumnRenamed("chunk_id", "query_id"), rows, 5)
    pd = rows.toPandas()
    assert len(run["f"](pd.set_axis(["q_id", "q_vec"], axis=1), pd.set_axis(["c_id", "c_vec"], axis=1))) == 600 and max(widths) <= 400 < 120 * 120


@pytest.mark.parametrize("cells, common", [(2_000_000, 256), (300, 2), (300, 0)])
def test_scores_are_sums_of_products(monkeypatch, cells, common):
    """Common words by a matrix, others by postings, in runs of any length; words that no row has, empty rows and queries."""
    monkeypatch.setattr(blocks, "CELLS", cells)
    monkeypatch.setattr(blocks, "COMMON", common)
    r = np.random.default_rng(7)
    rows = [[f"w{min(r.zipf(1.4), 90)}" for _ in range(r.integers(0, 20))] for _ in range(70)] + [[], ["only"]]
    asked = [sorted({f"w{min(r.zipf(1.4), 99)}" for _ in range(12)}) for _ in range(33)] + [[], ["nowhere"]]
    weights = [[float(len(w) + i) for i, w in enumerate(q)] for q in asked]
    block = blocks.Block()
    for at in (0, 50):
        block.add(pa.array(range(at, min(at + 50, 72))), pa.array(rows[at : at + 50], pa.list_(pa.string())))
    block.close(lambda tf, size: tf / (1 + size))
    out = np.zeros((35, 72))
    for first, score in block.scores(pa.array(asked, pa.list_(pa.string())), pa.array(weights, pa.list_(pa.float64()))):
        assert score.size <= max(cells, 72)
        out[first : first + len(score)] = score
    want = [[sum(x * row.count(w) / (1 + len(row)) for w, x in zip(q, ws, strict=True)) for row in rows] for q, ws in zip(asked, weights, strict=True)]
    assert np.allclose(out, want) and ((out > 0) == (np.array(want) > 0)).all()


@pytest.mark.parametrize("cells, common, k", [(2_000_000, 256, 5), (300, 2, 7), (300, 0, 1), (2_000_000, 256, 100)])
def test_top_is_exact(monkeypatch, cells, common, k):
    """Sums in single precision only tell which rows can be among the best: near ties go by the whole sum, equal ones by row."""
    monkeypatch.setattr(blocks, "CELLS", cells)
    monkeypatch.setattr(blocks, "COMMON", common)
    monkeypatch.setattr(blocks, "SHORT", 9)
    r = np.random.default_rng(11)
    rows = [[f"w{min(r.zipf(1.3), 60)}" for _ in range(r.integers(0, 25))] for _ in range(90)]
    rows += rows[:10] + [["near"] * 2] * 3 + [["near"]] * 9
    asked = [sorted({f"w{min(r.zipf(1.4), 70)}" for _ in range(15)}) for _ in range(30)] + [[], ["nowhere"], ["near"]]
    weights = [[1000 + float(r.random()) for _ in q] for q in asked]
    block = blocks.Block()
    block.add(pa.array(range(len(rows))), pa.array(rows, pa.list_(pa.string())))
    block.close(lambda tf, size: 1 + 1e-7 * tf)  # single precision can't tell these apart
    got = {i: (at.tolist(), score.tolist()) for i, at, score in block.top(pa.array(asked, pa.list_(pa.string())), pa.array(weights, pa.list_(pa.float64())), k)}
    for i, (q, ws) in enumerate(zip(asked, weights, strict=True)):
        sums = [round(sum(x * (1 + 1e-7 * row.count(w)) for w, x in zip(q, ws, strict=True) if w in row), 6) for row in rows]
        want = sorted((n for n, s in enumerate(sums) if s > 0), key=lambda n: (-sums[n], n))[:k]
        assert got[i][0] == want and np.allclose(got[i][1], [sums[n] for n in want], rtol=0, atol=2e-6)


def test_only_texts_of_queries_are_read_as_queries(spark, monkeypatch):
    """No condition takes the words of all texts to find those of the few that are queries."""
    plans = []
    monkeypatch.setattr(retrieval, "stored", lambda df, f=retrieval.stored: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or f(df))
    chunks = spark.createDataFrame([(i, f"w{i % 7} w{i % 3}") for i in range(100)], "chunk_id long, text string")
    queries = chunks.filter("chunk_id % 50 = 0").withColumnRenamed("chunk_id", "query_id")
    assert retrieval.lexical_topk(queries, chunks, 3).count() == 6
    filters = [line for plan in plans for line in plan.splitlines() if "Filter" in line and "split" in line and "% 50" in line]
    assert plans and not filters


def test_long_queries_move_no_pairs(spark):
    """Every chunk as a query: what is shuffled are chunks, queries and the best of each block."""
    r = np.random.default_rng(5)
    chunks = [(i, " ".join(f"w{min(r.zipf(1.3), 400)}" for _ in range(40))) for i in range(300)]
    q, c = frames(spark, chunks[::5], chunks)
    out = retrieval.lexical_topk(q, c, 7)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Join" not in plan
    got = [(x["query_id"], x["chunk_id"], x["rank"]) for x in out.collect()]
    assert sorted(got) == [(a, b, d) for a, b, _, d in brute(chunks[::5], chunks, 7)]


def test_ids_of_other_types(spark):
    q, c = frames(spark, [(1, "a b"), (2, None)], [(5, "b b"), (3, "a a c"), (4, "z")])
    out = retrieval.lexical_topk(q.withColumn("query_id", F.concat(F.lit("q"), "query_id")), c.withColumn("chunk_id", F.concat(F.lit("c"), "chunk_id")))
    assert sorted((x["query_id"], x["chunk_id"]) for x in out.collect()) == [("q1", "c3"), ("q1", "c5")]


def test_groups_of_expected_chunks(spark):
    """The same as with each query's own list, without pairs of queries and members."""
    members = spark.range(60).selectExpr("CASE WHEN id < 50 THEN id % 3 END AS `group`", "id AS chunk_id")
    queries = spark.range(9).selectExpr("id AS query_id", "CASE WHEN id % 2 = 0 THEN 'even' END AS scenario", "CASE WHEN id = 7 THEN 9 WHEN id < 8 THEN id % 3 END AS `group`")
    results = spark.range(9).selectExpr("id AS query_id", "explode(sequence(1, 12)) AS rank").selectExpr("query_id", "query_id * 5 + rank AS chunk_id", "rank")
    lists = queries.join(members, "group").groupBy("query_id", "scenario").agg(F.collect_list("chunk_id").alias("expected"))
    out = reval.ir_metrics_of_groups(results, queries, members)
    assert sorted(map(repr, out.collect())) == sorted(map(repr, reval.ir_metrics(results, lists).collect())) and out.count() == 7
    assert "expected" not in out._jdf.queryExecution().optimizedPlan().toString()
