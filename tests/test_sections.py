"""Model identification and bookmark sections against plain loops, and their plans."""

from __future__ import annotations

import random

import pytest

from gaugeworks.operators import docs as D


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_models_equal_a_plain_search(spark):
    r = random.Random(2)
    names = ["the building", "building", "ab", "x", "Ünï 300", "kyo 2554ci", "kyo 2554", "a.b*c", "  "]
    aliases = [(n, n.upper() + " M", f"{i:02d}") for i, n in enumerate(names)]
    pieces = ["The Building ", "buil ding", "AB", "kyo 2554CI", "kyo", "2554", "ünï 300", "A.B*C", "zzz\n", "中文"]
    text = lambda: r.choice([None, "".join(r.choices(pieces, k=r.randrange(5)))])
    rows = [(f"D{i % 70}", text(), text()) for i in range(80)]
    df = spark.createDataFrame(rows, "document_id string, file_name string, first_page string")
    table = spark.createDataFrame(aliases, "alias string, canonical string, alias_no string")
    out = D.identify_model(df, table)

    def want(name, page):
        for text in (name, page):
            for a, c, _ in aliases:
                if a.strip() and a.lower() in (text or "").lower():
                    return c, c.split(" ")[0]
        return None, None

    got = sorted(((r["document_id"], r["file_name"], r["first_page"], r["model"], r["vendor"]) for r in out.collect()), key=repr)
    assert got == sorted(((d, n, p, *want(n, p)) for d, n, p in rows), key=repr)
    assert "NestedLoop" not in plan(out) and "Cartesian" not in plan(out)
    assert [r["model"] for r in D.identify_model(df, table.limit(0)).select("model").distinct().collect()] == [None]
    assert D.identify_model(df.limit(0), table).collect() == []


def test_a_hundred_thousand_characters_are_searched_once(spark):
    df = spark.createDataFrame([("D", "f", "word " * 40_000 + "kyo 2554ci"), ("E", "f", "word " * 40_000)], "document_id string, file_name string, first_page string")
    table = spark.createDataFrame([("kyo 2554ci", "KYO 2554", "1")], "alias string, canonical string, alias_no string")
    assert {r["document_id"]: r["model"] for r in D.identify_model(df, table).collect()} == {"D": "KYO 2554", "E": None}


@pytest.mark.parametrize("back", [False, True])
def test_bookmarks_equal_plain_ranges(spark, back):
    r = random.Random(3)
    pages = [(f"D{d}", p, f"t{d}.{p}" if r.random() < 0.9 else "") for d in range(6) for p in range(1, 30)]
    marks = []
    for d in range(8):
        at = [r.randrange(-1, 33) for _ in range(r.randrange(7))]
        marks += [(f"D{d}", i, r.choice([1, 2, 3, 4]), f"m{i}", p) for i, p in enumerate(at if back else sorted(at))]
    want = []
    for d in {m[0] for m in marks}:
        own = [m for m in marks if m[0] == d and m[2] <= 3]
        for i, (_, no, _, title, page) in enumerate(own):
            until = max(own[i + 1][4], 1) if i + 1 < len(own) else 10**9
            text = "\n\n".join(t for x, p, t in sorted(pages) if x == d and max(page, 1) <= p < until).strip(" ")
            want += [(d, no, title, page, text)] if text else []
    got = D.split_bookmarks(spark.createDataFrame(pages, "document_id string, page_no int, text string"), spark.createDataFrame(marks, "document_id string, mark_no int, level int, title string, page int"))
    assert sorted(tuple(x) for x in got.collect()) == sorted(want)


def test_many_pages_meet_their_mark_once(spark):
    """Pages and marks are ordered together: no join of a document's pages with its marks."""
    pages = spark.range(1, 100_001).selectExpr("'D' document_id", "cast(id as int) page_no", "'t' text")
    marks = spark.range(1, 50_001).selectExpr("'D' document_id", "cast(id as int) mark_no", "1 level", "'m' title", "cast(2 * id as int) page")
    out = D.split_bookmarks(pages, marks)
    assert out.count() == 50_000 and out.filter("length(text) = 4").count() == 49_999
