"""The set-similarity join against all pairs, and the pairs that it makes."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeworks.operators import similar


def brute(sets, models, asked, k, weight):
    out = []
    for d in asked:
        scored = []
        for o in models:
            a, b = sets.get(d, set()), sets.get(o, set())
            s = (len(a & b) / len(a | b) if a | b else 0) + weight * (models[d] is not None and models[d] == models[o])
            if o != d and s > 0:
                scored.append((-round(s, 3), o))
        out += [(d, o, -s) for s, o in sorted(scored)[:k]]
    return sorted(out)


def frames(spark, sets, models, asked):
    codes = spark.createDataFrame([(d, c) for d, cs in sets.items() for c in cs] or [("x", None)], "device_id string, error_code string")
    return codes, spark.createDataFrame(list(models.items()), "device_id string, model string"), spark.createDataFrame([(d,) for d in asked], "device_id string")


def best(pairs, k):
    by = {}
    for r in pairs.collect():
        by.setdefault(r["device_id"], []).append((-round(r["score"], 3), r["other_id"]))
    return sorted((d, o, -s) for d, rows in by.items() for s, o in sorted(rows)[:k])


@pytest.mark.parametrize("weight, seed", [(0.5, 1), (0.0, 16)])
def test_equals_all_pairs(spark, monkeypatch, weight, seed):
    """Skewed codes, equal sets, devices without codes or model."""
    monkeypatch.setattr(similar, "SEED", seed)
    r = random.Random(8)
    names = [f"C{i}" for i in range(25)]
    sets = {f"D{i:03d}": set(r.choices(names, [1 / (1 + j) ** 1.5 for j in range(25)], k=r.choice([1, 1, 2, 4, 9]))) for i in range(140)}
    sets |= {f"E{i:02d}": {"C0"} for i in range(30)} | {f"F{i:02d}": set(names) for i in range(5)}
    models = {d: r.choice(["a", "b", "c", None]) for d in sets} | {f"G{i}": "a" for i in range(5)}
    asked = sorted(models)[::4] + ["G0", "E00"]
    want = brute(sets, models, sorted(set(asked)), 6, weight)
    assert best(similar.most_alike(*frames(spark, sets, models, asked), 6, weight), 6) == want


def test_a_code_on_all_devices_makes_few_pairs(spark):
    n, k = 3000, 5
    sets = {f"D{i:04d}": {"HOT", f"K{i // 30}", f"L{i % 700}"} for i in range(n)}
    models = {d: f"m{i % 4}" for i, d in enumerate(sets)}
    asked = sorted(sets)[::50]
    codes, info, queries = frames(spark, sets, models, asked)
    found = similar.code_sets(codes, info)
    made = similar.candidates(found.join(queries, "device_id", "left_semi"), found, k, 0.5, similar.same_value(queries, info, "model", k))
    assert made.count() < 60 * 120 < 60 * n / 20
    assert made.groupBy("device_id").count().agg(F.min("count")).first()[0] >= k
    assert best(similar.most_alike(codes, info, queries, k), k) == brute(sets, models, asked, k, 0.5)


def test_equal_sets_of_many_devices(spark):
    """Of thousands of equal devices only the smallest ids are met."""
    sets = {f"D{i:04d}": {"A", "B"} for i in range(2000)}
    models = dict.fromkeys(sets, "m")
    codes, info, queries = frames(spark, sets, models, ["D0000", "D1999"])
    found = similar.code_sets(codes, info)
    assert similar.candidates(found.join(queries, "device_id", "left_semi"), found, 4, 0.5).count() <= 2 * 10
    assert best(similar.most_alike(codes, info, queries, 4), 4) == brute(sets, models, ["D0000", "D1999"], 4, 0.5)


def test_long_sets_of_common_codes_make_no_pairs(spark):
    """Sets of half of all codes: every pair shares some, so a bound on one code opens all; scores that round to a tie."""
    r = random.Random(2)
    names = [f"C{i}" for i in range(32)]
    sets = {f"D{i:03d}": set(r.sample(names, r.choice([1, 15, 16, 17]))) for i in range(200)} | {f"E{i}": set(names[:16]) for i in range(9)}
    models = {d: r.choice(["a", None]) for d in sets} | {"G": None, "H": "a"}
    asked = sorted(models)[::9] + ["E3", "G", "H"]
    codes, info, queries = frames(spark, sets, models, asked)
    made = similar.most_alike(codes, info, queries, 4)
    assert best(made, 4) == brute(sets, models, sorted(set(asked)), 4, 0.5)
    assert made.count() <= len(set(asked)) * 5 < len(asked) * 200 / 20


def test_rounding_is_that_of_spark(spark):
    scores = sorted({n / d + w for d in range(1, 90) for n in range(d + 1) for w in (0.0, 0.5)})
    want = spark.createDataFrame([(i, s) for i, s in enumerate(scores)], "i int, s double").select("i", F.round("s", 3).alias("r")).orderBy("i").collect()
    assert [x["r"] for x in want] == similar._rounded(np.array(scores)).tolist()
