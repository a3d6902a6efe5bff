"""Loads that leave other files alone, stages that compile, and gatherings that stay bounded."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from gaugeworks.operators import fleet_stats as A
from gaugeworks.operators import store as S
from gaugeworks.sources import loads


def files_of(folder):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet")}


def events(spark, day, n):
    return spark.range(n).selectExpr("concat('D', id) device_id", f"timestamp'2024-01-{day:02d} 10:00:00' + make_interval(0, 0, 0, 0, 0, 0, id) ts", "'C1000' error_code", "id row_no")


def test_loads(spark, tmp_path):
    at = str(tmp_path / "store")
    assert loads.reference_time(spark, at).first()["ref"] is None
    assert loads.add_load({"events": events(spark, 1, 5), "snapshots": events(spark, 2, 1)}, at, "a")
    first = files_of(at)
    assert loads.add_load({"events": events(spark, 1, 3).union(events(spark, 3, 2))}, at, "2024-01-03")
    second = files_of(at)
    assert first.items() <= second.items() and len(second) > len(first)
    assert not loads.add_load({"events": events(spark, 9, 9)}, at, "a") and files_of(at) == second
    read = loads.read_table(spark, at, "events")
    assert sorted((r["load"], str(r["event_date"]), r["count"]) for r in read.groupBy("load", "event_date").count().collect()) == [("2024-01-03", "2024-01-01", 3), ("2024-01-03", "2024-01-03", 2), ("a", "2024-01-01", 5)]
    assert str(loads.reference_time(spark, at).first()["ref"]) == "2024-01-03 10:00:01"
    # A load that broke off before its entry is not read, and is written again over its own rows.
    events(spark, 5, 4).withColumn("load", F.lit("load b")).withColumn("event_date", F.to_date("ts")).write.mode("append").partitionBy("event_date", "load").parquet(f"{at}/events")
    assert read.count() == loads.read_table(spark, at, "events").count() == 10
    assert loads.add_load({"events": events(spark, 5, 4)}, at, "b") and loads.read_table(spark, at, "events").count() == 14
    recent = S.events_in_window(loads.read_table(spark, at, "events"), loads.reference_time(spark, at), 1)
    assert recent.count() == 4 and "event_date" in recent.columns


def test_the_reference_time_reads_no_event(spark, tmp_path):
    at = str(tmp_path / "store")
    loads.add_load({"events": events(spark, 1, 5)}, at, "a")
    read = loads.reference_time(spark, at).inputFiles()
    assert read and all("/store/loads/" in f for f in read)


@pytest.mark.parametrize("name", ["o18_quarantine", "o20_route_rows"])
def test_stages_compile(spark, name):
    """Without a way back to interpreted code a stage that is too long fails."""
    spark.conf.set("spark.sql.codegen.fallback", "false")
    try:
        assert __spark_entry__.queries()[name](spark, "/root/testdata/sf0.1").count() > 1000
    finally:
        spark.conf.unset("spark.sql.codegen.fallback")


def test_a_code_of_many_descriptions(spark):
    many = spark.range(20_000).selectExpr("concat('C', 1 + id % 1) error_code", "concat('text ', lpad(id, 6, '0')) error_description")
    health = spark.sql("SELECT 'D1' device_id, array(named_struct('label', 'C1 (High)', 'source', 'x')) contributions")
    out = A.mass_errors(health, many)
    row = out.first()
    assert row["descriptions"] == ["text 000000", "text 000001", "text 000002"] and row["events"] == 20_000
    assert "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()


def test_merged_evidence(spark):
    old = spark.createDataFrame([("s", "o", [f"D{i:03d}" for i in range(80)]), ("s", "none", [])], "scope string, observation string, evidence array<string>")
    new = spark.createDataFrame([("s", "o", ["A1", "D000", None]), ("s", "p", ["Z"])], "scope string, observation string, evidence array<string>")
    got = {r["observation"]: r["evidence"] for r in A.merge_patterns(old, new).collect()}
    assert got == {"o": ["A1"] + [f"D{i:03d}" for i in range(49)], "none": [], "p": ["Z"]}
