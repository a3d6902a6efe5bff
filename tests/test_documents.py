import pytest

from gaugeworks.operators import docs as D
from gaugeworks.operators import retrieval as S
from gaugeworks.operators import reval as E


def docs(spark, *texts):
    return spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(texts)], "document_id string, text string")


def test_composition(spark):
    assert D.clean(docs(spark, "café", None)).select("text").collect()[0][0] == "café"


def test_headings(spark):
    got = D.split_headings(docs(spark, "start\n# One #\nbody\n\nSAFETY FIRST\n## Empty\n")).orderBy("section_no").collect()
    assert [(r.section, r.text) for r in got] == [("Introduction", "start"), ("One", "body")]


def sized(text, most, overlap):
    """Brute force of the size-bounded split."""
    if len(text.split()) <= most:
        return [text]
    sep = next((s for s in ("\n\n", "\n", ". ", " ") if len(text.split(s)) > 1), None)
    parts = text.split(sep) if sep else [text]
    out, now, size = [], None, 0
    for p in parts:
        n = len(p.split())
        if now is not None and size + n > most:
            out.append(now)
            words = now.split()
            if len(words) > overlap:
                now, size = (" ".join(words[-overlap:]) if overlap else None), overlap
            else:
                size = len(words)
        now = p if now is None else now + sep + p
        size += n
    return out + [now]


@pytest.mark.parametrize("most,overlap", [(5, 2), (5, 0), (3, 3)])
def test_sized_parts(spark, most, overlap):
    texts = ["a b c", "a b c d e f g h", "one two three four. five six. seven eight nine ten", "x y z\nu v w q\nr s t", "p q r s t u\n\nv w\n\nx", "single-word"]
    got = D.split_sized(docs(spark, *texts), most, overlap).orderBy("document_id", "part_no").collect()
    for i, t in enumerate(texts):
        assert [r.text for r in got if r.document_id == f"d{i}"] == sized(t, most, overlap)


def test_chunk_and_upsert(spark):
    d = docs(spark, "# A\none two\n# B\nthree", "x\n\ny")
    got = D.chunk(d, "hierarchical").orderBy("chunk_id").collect()
    assert [(r.chunk_id, r.section, r.tokens) for r in got] == [("d0_c0", "A", 2), ("d0_c1", "B", 1), ("d1_c0", "Introduction", 2)]
    assert [r.text for r in D.chunk(d, "per_record").filter("document_id = 'd1'").orderBy("chunk_id").collect()] == ["x", "y"]
    now = D.chunk(d).select("document_id", "text")
    new = spark.createDataFrame([("d0", "new")], "document_id string, text string")
    once = D.upsert_chunks(now, new)
    assert sorted(once.collect()) == sorted(D.upsert_chunks(once, new).collect())


def test_metrics(spark):
    results = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("q", "c", 3)], "query_id string, chunk_id string, rank int")
    expected = spark.createDataFrame([("q", "s", ["b", "z"]), ("none", "s", []), ("miss", None, ["y"])], "query_id string, scenario string, expected array<string>")
    got = {r.query_id: r for r in E.ir_metrics(results, expected).collect()}
    assert (got["q"].recall_at_5, got["q"].mrr, got["q"].precision_at_5) == (0.5, 0.5, 0.2)
    assert (got["none"].recall_at_10, got["none"].ndcg_at_10) == (1.0, 1.0)
    assert (got["miss"].mrr, got["miss"].hit) == (0.0, False)


def test_search_pieces(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 0.0]), (4, [1.0, 0.0])], "chunk_id long, vector array<double>")
    queries = spark.createDataFrame([(7, [2.0, 0.0])], "query_id long, vector array<double>")
    assert [(r.chunk_id, r["rank"]) for r in S.dense_topk(queries, vectors, 2).orderBy("rank").collect()] == [(1, 0), (4, 1)]
    assert S.dense_topk(queries.limit(0), vectors, 2).count() == 0
    hits = spark.createDataFrame([(1, i, i, "x" * 400) for i in range(9)], "query_id int, rank int, chunk_id int, text string")
    assert S.pack_context(hits, budget=1000).first().n == 2
    a = spark.createDataFrame([(1, "x", 0.5, 0)], "query_id int, chunk_id string, score double, rank int")
    b = spark.createDataFrame([(1, "y", 0.5, 0)], "query_id int, chunk_id string, score double, rank int")
    assert {r.chunk_id: r.fused for r in S.rrf(a, b).collect()} == {"x": round(1 / 61, 9), "y": round(1 / 61, 9)}
    assert S.search_with_fallback(a.select("query_id", "chunk_id", "rank").limit(0), b, a).first().stage == "filtered"
