"""The pruned lexical search against scoring every chunk, and what it leaves unread."""

from __future__ import annotations

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gaugeworks.operators import postings, retrieval


def brute(queries, chunks, k, k1=1.2, b=0.75):
    words = {c: t.lower().split() for c, t in chunks}
    n, mean = len(words), sum(map(len, words.values())) / len(words)
    df = Counter(w for ws in words.values() for w in set(ws))
    out = []
    for q, text in queries:
        asked, scored = Counter(text.lower().split()), []
        for c, ws in words.items():
            tf = Counter(ws)
            met = [w for w in asked if w in tf]
            s = sum(asked[w] * math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] * (k1 + 1) / (tf[w] + k1 * (1 - b + b * len(ws) / mean)) for w in met)
            if met:
                scored.append((-round(s, 6), c))
        out += [(q, c, -s, rank) for rank, (s, c) in enumerate(sorted(scored)[:k])]
    return sorted(out)


def frames(spark, queries, chunks):
    return spark.createDataFrame(queries, "query_id long, text string"), spark.createDataFrame(chunks, "chunk_id long, text string")


@pytest.mark.parametrize("seed, pool, share", [(64, 8, 0.5), (1, 1, 1.0)])
def test_equals_scoring_every_chunk(spark, monkeypatch, seed, pool, share):
    monkeypatch.setattr(postings, "SEED", seed)
    monkeypatch.setattr(postings, "POOL", pool)
    monkeypatch.setattr(postings, "SHARE", share)
    r = random.Random(4)
    vocabulary = [f"w{i}" for i in range(60)]
    text = lambda n: " ".join(r.choices(vocabulary, [1 / (i + 1) for i in range(60)], k=n))
    chunks = [(i, text(r.choice([1, 5, 30]))) for i in range(150)]
    chunks += [(200 + i, chunks[i % 3][1]) for i in range(60)] + [(300, ""), (301, "W0 w0")]  # ties, an empty text
    queries = [(i, text(r.choice([1, 3, 12]))) for i in range(8)] + [(20, "w0 w0 w59"), (21, "nothing"), (22, "")]
    q, c = frames(spark, queries, chunks)
    got = sorted((x["query_id"], x["chunk_id"], round(x["score"], 6), x["rank"]) for x in retrieval.lexical_topk(q, c, 7).collect())
    want = brute(queries, chunks, 7)
    assert [x[:2] + x[3:] for x in got] == [x[:2] + x[3:] for x in want] and all(abs(a[2] - b[2]) < 2e-6 for a, b in zip(got, want, strict=True))


def test_a_common_word_does_not_send_every_chunk_to_every_query(spark):
    chunks = [(i, f"the the topic{i % 20} of kind{i % 7} thing{i % 50}") for i in range(2000)]
    queries = [(i, f"the topic{i % 20} of the kind{i % 7} thing{i % 50}") for i in range(40)]
    q, c = frames(spark, queries, chunks)
    index = postings.build_index(c)
    blocks = postings.wanted_blocks(postings.weighed_terms(q, index, 5), index, 5)
    whole, read, common = blocks.agg(F.sum("n"), F.sum(F.when(F.col("read"), F.col("n"))), F.sum(F.when(F.col("read") & F.col("term").isin("the", "of"), F.col("n")))).first()
    assert whole > 40 * 2 * 2000 and not common and read < whole / 10
    assert sorted((x["query_id"], x["chunk_id"]) for x in postings.search(q, index, 5).collect()) == sorted((a, b) for a, b, _, _ in brute(queries, chunks, 5))


def test_empty_tables(spark):
    q, c = frames(spark, [(1, "a b")], [(1, "a"), (2, None)])
    assert [x["chunk_id"] for x in retrieval.lexical_topk(q, c).collect()] == [1]
    assert retrieval.lexical_topk(q, c.limit(0)).collect() == [] == retrieval.lexical_topk(q.limit(0), c).collect()
