"""Ranked lexical search against brute force."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest

from gaugeworks.llm import lexical, queries


def words(text):
    return [w.translate({c: c + 32 for c in range(65, 91)}) for w in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]


def brute(docs, items, top=20):
    """Rows of (item_id, rank, doc_id, score) of every item, as the contract has it."""
    counts = [(i, words(t)) for i, t in docs]
    counts = [(i, Counter(w), len(w)) for i, w in counts if w]
    n_all, long = len(counts), sum(n for _, _, n in counts)
    df = Counter(w for _, c, _ in counts for w in c)
    out = []
    for item, text in items:
        asked, scored = Counter(words(text)), []
        for doc, c, n in counts:
            m = 100 - 25 + 25 * n * n_all // long
            s = sum(q * math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[w] + 1))) * (1_000_000_000 * c[w] // (1000 * c[w] + 12 * m)) for w, q in asked.items() if w in c)
            if s > 0:
                scored.append((-s, doc is None, doc or 0, doc))
        out += [(item, k, x[3], -x[0]) for k, x in enumerate(sorted(scored, key=lambda x: x[:3])[:top], 1)]
    return sorted(out, key=repr)


def rows_of(df):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect()), key=repr)


def corpus(seed, n, ties=False):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(200)]
    weights = [1 / (k + 1) for k in range(200)]
    text = lambda: " ".join(r.choices(vocabulary, weights, k=r.choice([0, 1, 3, 20, 60])))
    docs = [(k, text()) for k in range(n)]
    return docs + [(1000 + k, docs[k % 7 if ties else k][1]) for k in range(n // 2)]


@pytest.mark.parametrize("shard, items", [(7, 2)])
@pytest.mark.parametrize("ties", [False, True])
def test_equals_brute_force(spark, monkeypatch, shard, items, ties):
    """Many shards and blocks, and many equal scores, change nothing."""
    monkeypatch.setattr(lexical, "SHARD", shard)
    monkeypatch.setattr(lexical, "ITEMS", items)
    docs = corpus(1, 120, ties)
    asked = [(k, t) for k, (_, t) in enumerate(corpus(2, 12))] + [(50, "w0 w0 w1"), (51, "unknown"), (52, None), (53, "W5, w5!")]
    got = lexical.search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(asked, "item_id long, text string"))
    want = brute(docs, asked)
    assert rows_of(got) == want and len(want) > 100


def test_terms_that_share_a_hash(spark, monkeypatch):
    """With two slots nearly all terms share an owner; the result stays."""
    monkeypatch.setattr(lexical, "SLOT_BITS", 4)
    docs, asked = corpus(3, 60), [(1, "w0 w9 w150"), (2, "w1 w2")]
    got = lexical.search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(asked, "item_id long, text string"), top=5)
    assert rows_of(got) == brute(docs, asked, 5)


def test_odd_rows(spark, edges, empty):
    docs = [(r["doc_id"], r["text"]) for r in edges.collect()]
    asked = [(1, "a B c"), (1, "a B c"), (None, "word id 中文"), (3, None), (4, "!?")]
    items = spark.createDataFrame([(*x, 1, "x") for x in asked], "item_id long, text string, row long, terms string")
    want = brute(docs, asked)
    assert rows_of(lexical.search(edges, items)) == want and len(want) > 6
    assert lexical.search(empty, items).collect() == [] and lexical.search(edges, items.limit(0)).collect() == []
    assert lexical.search(edges, items).columns == ["item_id", "rank", "doc_id", "score"]


def test_query_on_the_whole_table(spark, data):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    assert rows_of(queries.op11_lexical_search(spark, data)) == brute(docs, items)
