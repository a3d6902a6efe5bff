import datetime as dt

import pytest
from pyspark.sql import functions as F

from gaugeworks.fixed import Weights
from gaugeworks.operators import fleet_stats as A
from gaugeworks.operators import health as H
from gaugeworks.operators import normalize as N
from gaugeworks.operators import registry as R
from gaugeworks.operators import store as S

UTC = dt.UTC
DAY = dt.datetime(2024, 1, 31, 12, tzinfo=UTC)
EVENT = "device_id string, ts timestamp, error_code string, error_description string, row_no long"


def events(spark, *rows):
    return spark.createDataFrame([(d, DAY - dt.timedelta(days=age), code, text, i) for i, (d, age, code, text) in enumerate(rows)], EVENT)


def ref(spark):
    return spark.createDataFrame([(DAY,)], "ref timestamp")


def test_window_bound_is_inclusive(spark):
    e = events(spark, ("D", 30, "C1", None), ("D", 30.0001, "C2", None), ("D", -1, "C3", None))
    assert {r.error_code for r in S.events_in_window(e, ref(spark)).collect()} == {"C1", "C3"}


def test_latest_by_code_ties_and_keys(spark):
    e = events(spark, ("D", 1, "C1", None), ("D", 1, "C1", None), ("D", 2, None, "text"), ("D", 3, None, None))
    assert {(r.key, r.row_no) for r in S.latest_by_code(e).collect()} == {("C1", 0), ("text", 2), ("", 3)}


def test_zero_repetitions_count_as_one(spark):
    e = events(spark, ("D", 20, "C1", None))
    devices = spark.sql("SELECT 'D' AS device_id, 'M' AS model, 'V' AS vendor")
    registry = spark.createDataFrame([], "vendor string, model_slug string, code string, severity string, component string, description string, vendor_order int")
    overrides = spark.createDataFrame([("C1", "High", 0.5)], "code string, severity string, confidence double")
    row = H.build_factors(e, ref(spark), devices, registry, overrides, Weights()).first()
    assert (row.n, row.severity, row.age_days, row.r) == (1, "High", 20, 1.0)


FACTOR = "device_id string, error_code string, severity string, ts timestamp, penalty double, s double, r double, c double, a double, source string"


def factors(spark, *rows):
    return spark.createDataFrame([(d, code, sev, DAY, p, p, 1.0, 1.0, 1.0, "x") for d, code, sev, p in rows], FACTOR)


def test_critical_cap(spark):
    f = factors(spark, ("D", "C2", "Critical", 60.0), ("D", "C1", "Critical", 60.0), ("D", "C3", "High", 20.0), ("D", "C4", "High", 20.0))
    assert {r.error_code for r in H.cap_critical(f).collect()} == {"C1", "C3", "C4"}


@pytest.mark.parametrize("penalties,index", [((0.5,), 100), ((1.5,), 98), ((75.6, 9.0), 15), ((500.0,), 1)])
def test_index_rounds_half_to_even(spark, penalties, index):
    f = factors(spark, *[("D", f"C{i}", "High", p) for i, p in enumerate(penalties)])
    assert H.health_index(f).first().health_index == index


def test_bad_penalty_is_an_error(spark):
    with pytest.raises(Exception, match="finite"):
        H.health_index(factors(spark, ("D", "C1", "High", float("nan")))).collect()


def test_confidence(spark):
    flags = spark.createDataFrame([("D", 2, True, True, False, False, None)], "device_id string, rag_missing_count long, missing_resources boolean, missing_model boolean, abnormal_daily_jump boolean, anomalous_event_count boolean, no_events_and_no_resources boolean")
    row = H.confidence(flags, Weights()).first()
    assert row.confidence == round(0.7**2 * 0.85 * 0.6, 4) and len(row.reasons) == 3
    assert H.confidence(flags.withColumn("rag_missing_count", F.lit(9)), Weights()).first().confidence == 0.2


def test_silent_modes(spark):
    ids = spark.createDataFrame([("A",), ("B",)], "device_id string")
    none = factors(spark)
    history = spark.createDataFrame([("A", 1, 40, 0.5), ("A", 2, 30, 0.6)], "device_id string, calculated_at int, health_index int, confidence double")
    get = lambda *a: {r.device_id: (r.health_index, r.confidence) for r in H.silent_devices(ids, none, *a).collect()}
    assert get("optimistic") == {"A": (100, 1.0), "B": (100, 1.0)}
    assert get("data_quality")["A"] == (100, 0.9)
    assert get("carry_forward", history) == {"A": (30, 0.6), "B": (100, 0.9)}


def test_every_device_once_and_empty(spark):
    e, snaps = events(spark, ("D", 1, "C1", None), ("D", 2, "C1", None)), spark.createDataFrame([("S", DAY)], "device_id string, ts timestamp")
    devices = spark.createDataFrame([("M", "m", "v")], "device_id string, model string, vendor string")
    registry = spark.createDataFrame([("v", "m", "C1", "Critical", None, None, 1)], "vendor string, model_slug string, code string, severity string, component string, description string, vendor_order int")
    overrides = spark.createDataFrame([], "code string, severity string, confidence double")
    got = {r.device_id: r.health_index for r in H.score_fleet(e, snaps, devices, registry, overrides).collect()}
    assert got.keys() == {"D", "S", "M"} and got["S"] == got["M"] == 100 and got["D"] < 100
    none = H.score_fleet(e.limit(0), snaps.limit(0), devices.limit(0), registry, overrides)
    assert none.count() == 0
    assert A.fleet_summary(none).first().devices == 0 and A.fleet_summary(none).first().average_index == 0.0
    assert A.index_distribution(none).count() == 10


def test_registry_vendor_order(spark):
    codes = spark.createDataFrame([("zz", "m", "C1"), ("b", "m", "C1"), (None, None, "C1")], "vendor string, model string, key string")
    registry = spark.createDataFrame([("a", "m", "C1", "High", None, None, 2), ("b", "m", "C1", "Low", None, None, 3), ("c", "m", "C1", "Info", None, None, 1)], "vendor string, model_slug string, code string, severity string, component string, description string, vendor_order int")
    got = {r.vendor: (r.severity, r.source) for r in R.classify(codes, registry, spark.createDataFrame([], "code string, severity string, confidence double")).collect()}
    assert got == {"zz": ("Info", "vendor_model_registry"), "b": ("Low", "vendor_model_registry"), None: ("Medium", "fallback")}


def test_normalise_edges(spark):
    rows = [(1, "D1", "2024-01-01", "C1000", None, "0.5"), (2, " ", "2024-01-01", "C1000", None, None), (3, "D1", "soon", None, None, None), (4, "D2", None, None, None, None), (5, "x" * 101, "2024-01-01", None, None, "1"), (6, "D3", "2024-01-02", None, None, None)]
    df = spark.createDataFrame(rows, "row_no long, device_id string, timestamp string, error_code string, error_description string, toner_level string")
    store = N.normalize(df, spark.createDataFrame([("m", "M")], "alias string, canonical string"))
    assert {(r.row_no, r.field) for r in store["invalid"].collect()} == {(2, "device_id"), (3, "timestamp"), (4, "timestamp"), (5, "device_id")}
    assert [r.error_code for r in store["events"].collect()] == ["C1000"]
    assert {r.device_id: r.toner_level for r in store["snapshots"].collect()} == {"D1": 50, "D3": None}
    assert store["summary"].first().total_rows == 6


def test_similar_devices_one(spark):
    e = events(spark, ("A", 1, "C1", None), ("A", 1, "C2", None), ("B", 1, "C1", None), ("C", 40, "C1", None))
    devices = spark.createDataFrame([("A", "m", None), ("B", "m", None), ("C", None, None)], "device_id string, model string, location string")
    got = A.similar_devices(e, ref(spark), devices, devices.filter("device_id = 'A'")).collect()
    assert [(r.other_id, r.score, r.shared_codes) for r in got] == [("B", 1.0, ["C1"])]


NO_REGISTRY = "vendor string, model_slug string, code string, severity string, component string, description string, vendor_order int"
NO_OVERRIDES = "code string, severity string, confidence double"


def test_one_critical_event(spark):
    """A file of one event: one factor, one contribution, a context coefficient of at most 1.5."""
    overrides = spark.createDataFrame([("C6000", "Critical", 0.9)], NO_OVERRIDES)
    devices = spark.createDataFrame([("MFP-1", "m", "v")], "device_id string, model string, vendor string")
    row = H.score_fleet(events(spark, ("MFP-1", 0, "C6000", None)), events(spark, ("MFP-1", 0, None, None)).select("device_id", "ts"), devices, spark.createDataFrame([], NO_REGISTRY), overrides).first()
    (part,) = row.contributions
    assert (part.label, part.r, part.a, part.penalty) == ("C6000 (Critical)", 1.0, 1.0, 60.0) and part.c <= 1.5
    assert (row.health_index, row.zone) == (40, "yellow")


def test_golden_record(spark):
    """Penalties 75.6 and 9.0 give index 15, red; one code without documents gives confidence 0.7, medium."""
    flags = spark.createDataFrame([("D", 1, False, False, False, False, False)], "device_id string, rag_missing_count long, missing_resources boolean, missing_model boolean, abnormal_daily_jump boolean, anomalous_event_count boolean, no_events_and_no_resources boolean")
    row = H.score(factors(spark, ("D", "C1", "Critical", 75.6), ("D", "C2", "High", 9.0)), flags.select("device_id"), flags, Weights()).first()
    assert (row.health_index, row.zone, row.confidence, row.confidence_zone) == (15, "red", 0.7, "medium")


def test_mass_problem(spark):
    """A file of 80 events where 20 of 30 devices share a code."""
    rows = [(f"D{i:02d}", 1 + i % 3, "C7000", "jam") for i in range(20)] + [(f"D{i % 30:02d}", 2 + i % 5, f"C8{i:03d}", "single") for i in range(60)]
    e = events(spark, *rows)
    devices = spark.createDataFrame([(f"D{i:02d}", "m", "v") for i in range(30)], "device_id string, model string, vendor string")
    health = H.score_fleet(e, e.select("device_id", "ts").limit(0), devices, spark.createDataFrame([], NO_REGISTRY), spark.createDataFrame([], NO_OVERRIDES)).cache()
    first = A.mass_errors(health, e).orderBy(F.desc("devices")).first()
    assert health.count() == 30 and (first.error_code, first.devices, first.events) == ("C7000", 20, 20)
    assert A.mass_scale(A.mass_errors(health, e), health).filter("error_code = 'C7000'").first().scale == "fleet-wide"


def test_similar_devices_are_those_of_all_pairs(spark):
    n = 60
    e = events(spark, *[(f"D{i:02d}", 1, f"C{(i * k) % 11}", None) for i in range(n) for k in (1, 2)])
    model = {f"D{i:02d}": None if i % 13 == 0 else f"m{i % 3}" for i in range(n)}
    devices = spark.createDataFrame([(d, m, m) for d, m in model.items()], "device_id string, model string, location string")
    codes = {f"D{i:02d}": {f"C{(i * k) % 11}" for k in (1, 2)} for i in range(n)}
    for dim in ("errors", "error_and_model", "model", "location"):
        got = {}
        for r in A.similar_devices(e, ref(spark), devices, devices.filter("device_id < 'D20'"), dim, 5).collect():
            got.setdefault(r.device_id, []).append((-r.score, r.other_id, tuple(r.shared_codes)))
        for d in sorted(model)[:20]:
            want = []
            for o in model:
                both = codes[d] & codes[o] if "error" in dim else set()
                same = model[d] is not None and model[d] == model[o]
                bonus = {"errors": 0.0, "error_and_model": 0.5, "model": 0.5, "location": 1.0}[dim] if same else 0.0
                score = round(len(both) / len(codes[d] | codes[o]) + bonus, 3) if both else bonus
                if o != d and (both or bonus):
                    want.append((-score, o, tuple(sorted(both))))
            assert sorted(got.get(d, [])) == sorted(want)[:5], (dim, d)


def test_duplicates_and_spellings_of_codes(spark):
    """70 rows: two events of each of ten devices twice, and three spellings of one code on each."""
    rows = [(f"D{d}", f"2024-01-2{k} 10:00:00", f"C100{k}", "x") for d in range(10) for k in (1, 2) for _ in range(2)]
    rows += [(f"D{d}", f"2024-01-25 1{k}:00:00", code, "tray") for d in range(10) for k, code in enumerate(("75-530-00", "75 530 00", "75_530_00"))]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "row_no long, device_id string, timestamp string, error_code string, error_description string")
    store = N.normalize(df, spark.createDataFrame([("m", "M")], "alias string, canonical string"), lenient=True)
    events_ = store["events"].cache()
    assert events_.count() == 70 and N.drop_duplicates(events_).count() == 50
    twice = N.duplicates(events_)
    assert twice.count() == 20 and twice.agg(F.sum("copies")).first()[0] == 40
    counts = {(r.device_id, r.error_code): r.n for r in S.count_repetitions(events_, S.reference_time(events_, store["snapshots"]), 30).collect()}
    assert len(counts) == 30 and all(counts[f"D{d}", "75-530-00"] == 3 for d in range(10)) and counts["D0", "C1001"] == 2
