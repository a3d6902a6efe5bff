from gaugeworks.streaming import live


def test_dropped_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("device_id,timestamp,error_code,toner_level\nD1,2024-01-01,C1000,40\nD1,2024-01-01,C1000,40\n,2024-01-01,C1,\n")
    aliases = spark.createDataFrame([("m", "M")], "alias string, canonical string")
    out = str(tmp_path / "out")
    for name in ("b.csv", None):
        live.run(live.read_dropped(spark, str(tmp_path / "in"), ["device_id", "timestamp", "error_code", "toner_level"]), aliases, out, str(tmp_path / "state")).awaitTermination()
        if name:
            (tmp_path / "in" / name).write_text("device_id,timestamp,error_code,toner_level\nD2,2024-01-02,,50\n")
    assert [r.error_code for r in spark.read.parquet(f"{out}/events").collect()] == ["C1000"]
    assert {r.device_id: r.toner_level for r in spark.read.parquet(f"{out}/snapshots").collect()} == {"D1": 40, "D2": 50}
    assert spark.read.parquet(f"{out}/invalid").count() == 1
