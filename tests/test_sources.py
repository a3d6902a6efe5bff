import json

import pytest

from gaugeworks.operators import store
from gaugeworks.sources import files, longform, mapping


def put(tmp_path, name, text, encoding="utf-8"):
    path = tmp_path / name
    path.write_text(text, encoding=encoding)
    return str(path)


def rows(df):
    return [tuple(r)[1:] if df.columns[0] == "row_no" else tuple(r) for r in df.collect()]


def test_delimiters(spark, tmp_path):
    for sep in ",;\t|":
        path = put(tmp_path, f"a{ord(sep)}.csv", f"id{sep}code\nD1{sep}C1000\nD2{sep}\n")
        assert rows(files.read_delimited(spark, path)) == [("D1", "C1000"), ("D2", None)]


def test_delimited_edges(spark, tmp_path):
    assert files.read_delimited(spark, put(tmp_path, "twice.csv", "a,a,b\n1,2,3\n")).columns == ["row_no", "a", "a_1", "b"]
    assert rows(files.read_delimited(spark, put(tmp_path, "short.csv", "a,b\n1\n"))) == [("1", None)]
    assert rows(files.read_delimited(spark, put(tmp_path, "quoted.csv", 'a,b\n"x, y",2\n'))) == [("x, y", "2")]
    assert rows(files.read_delimited(spark, put(tmp_path, "cp.csv", "a,b\nмир,2\n", "cp1251"), encoding="windows-1251")) == [("мир", "2")]
    with pytest.raises(files.EmptyFile):
        files.read_delimited(spark, put(tmp_path, "empty.csv", "a,b\n"))
    with pytest.raises(files.Malformed):
        files.read_delimited(spark, put(tmp_path, "long.csv", "a,b\n1,2,3\n"))
    with pytest.raises(files.Malformed):
        files.read_delimited(spark, put(tmp_path, "open.csv", 'a,b\n"1,2\n'))


def test_preamble(spark, tmp_path):
    path = put(tmp_path, "export.csv", "﻿-- made by hand\n\nselect a, b from t\na,b\nfrom here,2\n")
    assert rows(files.read_delimited(spark, path, preamble=True)) == [("from here", "2")]


def test_json(spark, tmp_path):
    expected = [("D1", "C1")]
    for text in ([{"id": "D1", "e": {"code": "C1"}}], {"id": "D1", "e": {"code": "C1"}}, {"rows": [{"id": "D1", "e": {"code": "C1"}}]}):
        df = files.read_log(spark, put(tmp_path, f"{len(json.dumps(text))}.json", json.dumps(text)))
        assert [(r["id"], r["e.code"]) for r in df.collect()] == expected
    assert rows(files.read_log(spark, put(tmp_path, "a.jsonl", '{"a": 1}\n\n{"a": null}\n'))) == [("1",), (None,)]
    with pytest.raises(Exception, match="(?i)malformed|fail"):
        files.read_jsonl(spark, put(tmp_path, "bad.jsonl", '{"a": 1}\n{"a": \n')).collect()


def test_store_round_trip(spark, tmp_path):
    events = spark.sql("SELECT 'D1' AS device_id, timestamp'2024-01-01 10:00:00' AS ts, 'C1' AS error_code")
    files.write_store({"events": events}, str(tmp_path / "store"))
    read = files.read_store(spark, str(tmp_path / "store"), ("events",))["events"]
    assert read.drop("event_date").collect() == events.collect() and str(read.first().event_date) == "2024-01-01"


def test_window_prunes_the_store(spark, tmp_path, capsys):
    events = spark.sql("SELECT 'D' AS device_id, timestamp'2024-01-31 12:00:00' - make_dt_interval(id) AS ts, 'C1' AS error_code, id AS row_no FROM range(90)")
    files.write_store({"events": events}, str(tmp_path / "store"))
    read = files.read_store(spark, str(tmp_path / "store"), ("events",))["events"]
    got = store.events_in_window(read, spark.sql("SELECT timestamp'2024-01-31 12:00:00' AS ref"), 10)
    assert sorted(r.row_no for r in got.collect()) == list(range(11))
    got.explain("formatted")
    plan = capsys.readouterr().out
    assert "PartitionFilters: [isnotnull(event_date" in plan and "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts" in plan and "Join" not in plan
    assert store.events_in_window(read, spark.sql("SELECT cast(null AS timestamp) AS ref")).count() == 0


def test_line_ends_inside_quotes(spark, tmp_path):
    text = 'id;history;code\nD1;"first line\nsecond; line";C1000\nD2;"one ""two""";C2\n"D\n3";x;\n'
    got = files.read_delimited(spark, put(tmp_path, "lines.csv", text))
    assert [tuple(r) for r in got.collect()] == [(2, "D1", "first line\nsecond; line", "C1000"), (3, "D2", 'one "two"', "C2"), (4, "D\n3", "x", None)]
    with pytest.raises(files.Malformed):
        files.read_delimited(spark, put(tmp_path, "wide.csv", 'a,b\n"1\n",2,3\n'))
    with pytest.raises(files.Malformed):
        files.read_delimited(spark, put(tmp_path, "odd.csv", 'a,b\n"1\n",2\n"3,4\n'))


@pytest.mark.parametrize("preamble", ["", "-- made by hand\n\nselect a, b from t\n"])
def test_a_file_of_many_splits_with_line_ends_inside_quotes(spark, tmp_path, preamble):
    import csv
    import io
    import random

    r = random.Random(6)
    field = lambda: "".join(r.choices(["a", "bc", "\n", "\n\n", '"', ";", "é", " x"], k=r.randrange(1, 30)))
    want = [[f"D{i}", field().strip() or "v", "z" * r.randrange(1, 40)] for i in range(600)]
    out = io.StringIO()
    csv.writer(out, delimiter=";", lineterminator="\n").writerows([["id", "note", "code"], *want])
    path = put(tmp_path, "many.csv", preamble + out.getvalue())
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        assert spark.read.text(path).rdd.getNumPartitions() > 10
        got = files.read_delimited(spark, path, preamble=bool(preamble)).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert [list(x)[1:] for x in sorted(got)] == want and sorted(x.row_no for x in got) == list(range(2, 602))


def test_mapping(spark):
    df = spark.createDataFrame([(i, f"SN{i:05d}", "2024-01-01", "C1000", str(i), "9") for i in range(30)], "row_no long, `Serial Number` string, When string, Fault string, `Toner left` string, other string")
    out, found, origin, rest = mapping.map_columns(df)
    assert found == {"Serial Number": "device_id", "When": "timestamp", "Fault": "error_code", "Toner left": "toner_level"}
    assert origin["Fault"] == "content" and origin["Serial Number"] == "synonym" and rest == ["other"]
    assert out.columns == ["row_no", "device_id", "timestamp", "error_code", "toner_level"]
    saved = {mapping.signature(df.columns[1:]): {"other": "device_id"}}
    assert mapping.map_columns(df, saved=saved)[1] == {"other": "device_id"}
    with pytest.raises(mapping.NoDeviceColumn):
        mapping.map_columns(df.select("row_no", "other"))


def test_names():
    assert mapping.by_synonym(["Счетчик", "Серийный номер", "Дата-время (UTC)", "Toner.Level", "toner"]) == {"Счетчик": "mileage", "Серийный номер": "device_id", "Дата-время (UTC)": "timestamp", "Toner.Level": "toner_level"}


def test_long_form(spark):
    rows_ = [
        ("h1", "100", "SupplLev[toner]", "30"), ("h1", "20", "SupplLev[toner]", "90"), ("h1", "20", "SupplMax[toner]", "60"), ("h1", "50", "LifeCount", "777"),
        ("h1", "60", "errDisp", "jam"), ("h1", "60", "errDisp", "jam"), ("h1", "70", "errDisp", " "), ("h2", "5", "ping", "1"),
    ]
    df = spark.createDataFrame(rows_, "host string, clock string, item_key string, metric_value string")
    assert longform.is_long(df.columns)
    got = {r.device_id: r for r in longform.pivot_long(df).collect()}
    assert (got["h1"].timestamp, got["h1"].error_description, got["h1"].toner_level, got["h1"].mileage) == ("60", "jam", 50.0, "777")
    assert (got["h2"].timestamp, got["h2"].error_description, got["h2"].toner_level) == ("5", None, None)
