"""The prefix trie of conversations against a trie built turn by turn."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from gaugeworks.llm import prefix_trie, queries

NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            convs[conv].append((turn is not None, turn or 0, role or "", text or ""))
    convs = {c: [x[2:] for x in sorted(t)] for c, t in convs.items()}
    built = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        first = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        built[c] = tuple(convs.get(first, [])[:h] + own[h:])
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
        ends[turns].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    totals = {}
    for p in sorted(members, key=len, reverse=True):
        below = [totals[k] for k in kids[p]]
        own = (len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0
        totals[p] = (sum(x[0] for x in below) or 1, own + sum(x[1] for x in below))
    digest = lambda p: hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), *totals[p], digest(p)) for p, m in members.items())


def got(df):
    return sorted(tuple(r[c] for c in NAMES) for r in df.collect())


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "h") for r in rows], "conv_id long, turn long, role string, text string, d long, hash string")


def talks(seed, convs=60, kinds=3, longest=12):
    r = random.Random(seed)
    return [(c, t, r.choice(["user", "assistant"]) if kinds > 1 else "user", f"say {r.randrange(kinds)} é") for c in range(convs) for t in range(r.randrange(longest))]


@pytest.mark.parametrize("kinds", [2])
def test_equals_a_plain_trie(spark, kinds):
    rows = talks(kinds, kinds=kinds)
    want = brute(rows)
    assert got(prefix_trie.trie(table(spark, rows))) == want and len(want) > 10


@pytest.mark.parametrize("piece, block", [(2, 3)])
def test_long_chains_and_large_groups(spark, monkeypatch, piece, block):
    """A conversation that many tasks hold, chains that cross conversations, and many that end at one node."""
    monkeypatch.setattr(prefix_trie, "PIECE", piece)
    monkeypatch.setattr(prefix_trie, "BLOCK", block)
    rows = [(5, t, "user", f"t{t % 11}") for t in range(260)]
    # Conversations that are prefixes of one another in falling order of id, so each node has another least member.
    rows += [(100 + c, t, "user", f"p{t}") for c in range(30) for t in range(40 - c)]
    rows += [(1000 + c, t, "user", "same") for c in range(50) for t in range(9)]
    want = brute(rows)
    assert got(prefix_trie.trie(table(spark, rows).repartition(7))) == want


def test_odd_rows(spark):
    rows = [
        (1, None, None, None), (1, 2, "a", "x"), (1, 2, "a", "x"), (1, 2, "a", None), (1, 1, None, "y" * 200_000), (2, 0, "a", "x"), (None, 0, "a", "x"), (None, None, None, None),
        (-3, 0, "a", "x"), (-5, 0, "b", "x"), (-5, 1, "b", "ü"), (2**63 - 1, 0, "a", "x"), (-(2**63), 0, "a", "x"), (7, 5, "ab", "c"), (8, 5, "a", "bc"),
    ]
    assert got(prefix_trie.trie(table(spark, rows))) == brute(rows)
    assert got(prefix_trie.trie(table(spark, rows[6:8]))) == [] == got(prefix_trie.trie(table(spark, []))) and brute([]) == []
    one = [(7, 0, "u", "x")]
    assert got(prefix_trie.trie(table(spark, one))) == brute(one)


def test_query_on_the_whole_table(spark, data):
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(queries.op13_prefix_trie(spark, data)) == brute(rows)
