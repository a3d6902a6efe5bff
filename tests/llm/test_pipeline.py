import public_tokenizers as P
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from gaugeworks.llm import decontaminate, langid, secrets, simhash

from .conftest import make


def test_stages(spark, docs, data, tmp_path):
    before = docs
    for k, (name, stage) in enumerate(pipeline.STAGES):
        stage(spark, before, data).write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        if k < len(pipeline.STAGES) - 1:
            assert after.columns == docs.columns
        if name == "near_dedup":
            groups = simhash.near_duplicates(before)
            assert {r.doc_id for r in after.collect()} == {r.component_id for r in groups.collect()}
        elif name == "decontamination":
            found = decontaminate.contamination(before, spark.read.parquet(f"{data}/benchmark.parquet"))
            clean = found.filter(~decontaminate.verdict(F.col("n_hit"), F.col("n_words")))
            assert {r.doc_id for r in after.collect()} == {r.doc_id for r in clean.collect()}
        elif name == "secret_scan":
            assert after.count() == before.count() and not any(secrets.base_spans(r.text) for r in after.collect())
        else:
            assert after.count() == before.count()
        before = after


def test_run(spark, data):
    assert pipeline.run(spark, data).filter("n_tokens > 0").count() > 0


def test_edges(spark, edges, empty, data):
    rows = edges.select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in pipeline.STAGES:
        assert stage(spark, empty.select(rows.columns), data).count() == 0
        assert stage(spark, rows, data).count() > 0, name
    kept = pipeline.near_dedup(spark, rows, data)
    assert kept.filter("doc_id = 3").count() == 1 and kept.filter("doc_id IS NULL").count() == 1
    assert kept.filter("text IS NULL OR trim(text) = ''").count() == 1  # all without words are alike
    langs, probs = langid.train(rows, P.path("piece_bpe_32k.model"))
    assert {r.doc_id for r in pipeline.language_id(spark, rows, data).collect()} == {None, 3, 5, 6, 7, 9} and langs == ["en"]
    twice = make(spark, [(1, "one two three four"), (1, "five six seven eight"), (None, "nine ten eleven"), (None, "nine ten eleven")]).select(rows.columns)
    assert pipeline.near_dedup(spark, twice, data).count() == 3
