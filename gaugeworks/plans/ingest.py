"""Registered queries of the readers, the column mapping, the long-format pivot and the normalisation, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import normalize as N
from ..operators import registry as R
from ..sources import files, loads, longform, mapping
from ..sources.scratch import scratch_folder
from .model import Model, duck

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, **more: str):
    """Register a function of a Model under a name, with its SQL over the model's tables."""

    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(Model(spark, sf_dir))
        if sql:
            ORACLES[name] = duck(sql, **more)
        return f

    return add


def folder(m: Model) -> str:
    """A new folder of the session's shared one for files that a query writes and reads back."""
    return scratch_folder(m.spark)


EVENT_ROWS = "SELECT row_no, device_id, error_code, error_description FROM ev"
COUNTS = "SELECT device_id, error_code, error_description, count(*) AS n FROM ev GROUP BY ALL"


def _counts(df: DataFrame) -> DataFrame:
    """Every distinct row that was read, and how often."""
    return df.groupBy("device_id", "error_code", "error_description").agg(F.count("*").alias("n"))


def _named(m: Model) -> DataFrame:
    return m.sql(EVENT_ROWS).drop("row_no")


@query("o01_read_delimited", COUNTS)
def _(m):
    at = folder(m)
    _named(m).coalesce(1).write.csv(at, sep=";", header=True, nullValue="", quoteAll=False)
    return _counts(files.read_delimited(m.spark, at))


@query("o02_read_json", COUNTS)
def _(m):
    # One document per device: an object whose only key holds an array of objects.
    at = folder(m)
    part = F.struct("device_id", F.struct("error_code", "error_description").alias("e"))
    documents = _named(m).groupBy("device_id").agg(F.to_json(F.struct(F.collect_list(part).alias("rows"))).alias("value"))
    documents.select("value").write.text(at)
    read = files.read_json(m.spark, at, multi_line=False).withColumnsRenamed({"e.error_code": "error_code", "e.error_description": "error_description"})
    return _counts(read)


@query("o03_read_jsonl", COUNTS)
def _(m):
    at = folder(m)
    _named(m).write.json(at)
    return _counts(files.read_jsonl(m.spark, at))


@query("o04_strip_preamble", "SELECT count(*) AS n, min(event_id) AS first, max(event_id) AS last FROM base WHERE event_id >= (SELECT min(event_id) FROM base WHERE event_id > 20)")
def _(m):
    # The first lines by number are a comment, blanks and SQL; later ones like them stay.
    lines = m.sql("SELECT event_id AS n, CASE WHEN event_id <= 20 OR event_id % 50 = 0 THEN CASE event_id % 3 WHEN 0 THEN '-- note' WHEN 1 THEN ' ' ELSE 'select a, b from t' END ELSE 'row ' || CAST(k AS STRING) END AS value FROM base")
    return files.strip_preamble(lines).agg(F.count("*").alias("n"), F.min("n").alias("first"), F.max("n").alias("last"))


@query("o05_store", "SELECT row_no, device_id, error_code, error_description, @us(ts) AS ts_us, CAST(CAST(ts AS DATE) AS STRING) AS day FROM ev")
def _(m):
    at = folder(m)
    files.write_store({"events": m.ev, "devices": m.dev}, at)
    events = files.read_store(m.spark, at, ("events",))["events"]
    return events.select("row_no", "device_id", "error_code", "error_description", F.unix_micros("ts").alias("ts_us"), F.col("event_date").cast("string").alias("day"))


def three_loads(m: Model) -> str:
    """A store of all events and snapshots in three loads, the first of them loaded twice."""
    at = folder(m)
    for k in (0, 1, 2, 0):
        loads.add_load({n: t.filter(F.col("row_no") % 3 == k) for n, t in (("events", m.ev), ("snapshots", m.snap))}, at, f"part {k}")
    return at


@query("o05_loads", "SELECT row_no, device_id, error_code, @us(ts) AS ts_us, CAST(CAST(ts AS DATE) AS STRING) AS day, 'part ' || CAST(row_no % 3 AS STRING) AS load FROM ev")
def _(m):
    return loads.read_table(m.spark, three_loads(m), "events").select("row_no", "device_id", "error_code", F.unix_micros("ts").alias("ts_us"), F.col("event_date").cast("string").alias("day"), "load")


@query("o25_reference_of_loads", "SELECT @us(max(ts)) AS ref_us FROM (SELECT ts FROM ev UNION ALL SELECT ts FROM snap)")
def _(m):
    return loads.reference_time(m.spark, three_loads(m)).select(F.unix_micros("ref").alias("ref_us"))


PROFILED = ("device_id", "error_code", "toner_level", "mileage")


@query(
    "o06_profile_columns",
    """SELECT c AS "column", count(*) AS filled, round(count(DISTINCT v) / count(*), 6) AS distinct_ratio, min(length(v)) AS min_length, max(length(v)) AS max_length,
      round(avg(CASE WHEN nth <= 200 THEN CASE WHEN TRY_CAST(v AS DOUBLE) IS NULL THEN 0 ELSE 1 END END), 6) AS numeric_rate,
      round(avg(CASE WHEN nth <= 200 THEN CASE WHEN regexp_matches(upper(v), '^(?:[CJEF]\\d{3,5}|S\\d{3,5}|SC\\d{3,4}|\\d{2}-\\d{3}-\\d{2})$') THEN 1 ELSE 0 END END), 6) AS code_rate
    FROM numbered GROUP BY c""",
    cells=" UNION ALL ".join(f"SELECT row_no, '{c}' AS c, nullif(trim({c}), '') AS v FROM raw" for c in PROFILED),
    numbered="SELECT *, row_number() OVER (PARTITION BY c ORDER BY row_no) AS nth FROM cells WHERE v IS NOT NULL",
)
def _(m):
    out = mapping.profile_columns(m.raw, list(PROFILED))
    return out.select("column", "filled", F.round("distinct_ratio", 6).alias("distinct_ratio"), F.col("min_length").cast("long").alias("min_length"), F.col("max_length").cast("long").alias("max_length"), F.round("numeric_rate", 6).alias("numeric_rate"), F.round("code_rate", 6).alias("code_rate"))


@query("o07_map_columns", "SELECT device_id, count(*) AS n, count(error_code) AS codes, count(toner_level) AS levels FROM raw GROUP BY device_id")
def _(m):
    foreign = m.raw.select("row_no", F.col("device_id").alias("Serial Number"), F.col("timestamp").alias("Date (UTC)"), F.col("timestamp").alias("Event-Time"), F.col("error_code").alias("Error Code"), F.col("toner_level").alias("Toner.Level"), F.col("model").alias("Display Name"))
    out, found, _, _ = mapping.map_columns(foreign, overrides={"Date (UTC)": "timestamp"})
    assert {"device_id", "timestamp", "error_code", "toner_level", "model"} == set(found.values())
    return out.groupBy("device_id").agg(F.count("*").alias("n"), F.count("error_code").alias("codes"), F.count("toner_level").alias("levels"))


_NUM = "TRY_CAST(clock AS BIGINT)"
META = {
    "meta": f"SELECT device_id, coalesce(arg_min(inventory_model, {_NUM}) FILTER (inventory_model <> 'none'), arg_min(inventory_type, {_NUM})) AS model, arg_min(inventory_vendor, {_NUM}) AS vendor, arg_min(inventory_location, {_NUM}) AS location FROM long GROUP BY device_id"
}
SUPPLY = {
    "kinds": f"SELECT device_id, CASE WHEN item_key LIKE '%Toner' THEN 'toner' WHEN item_key LIKE '%Drum' THEN 'drum' ELSE 'fuser' END AS kind, item_key LIKE 'SupplMax%' AS cap, {_NUM} AS t, CAST(value AS DOUBLE) AS v FROM long WHERE item_key LIKE 'Suppl%' OR item_key LIKE 'prtMarker%'",
    "eachkind": "SELECT device_id, kind, arg_max(v, (t, v)) FILTER (NOT cap) AS level, max(v) FILTER (cap) AS cap FROM kinds GROUP BY ALL",
    "shares": "SELECT device_id, kind, CASE WHEN cap = 100 THEN least(level, 100) WHEN cap > 0 THEN round(level / cap * 100, 1) WHEN level <= 100 THEN level END AS share FROM eachkind",
    "supply": "SELECT device_id, max(share) FILTER (kind = 'toner') AS toner_level, max(share) FILTER (kind = 'drum') AS drum_level, max(share) FILTER (kind = 'fuser') AS fuser_level FROM shares GROUP BY device_id",
}
COUNTER = {"counter": f"SELECT device_id, arg_max(value, ({_NUM}, value)) AS mileage FROM long WHERE item_key = 'LifeCount' GROUP BY device_id"}
ERRORS = {"errors": "SELECT DISTINCT device_id, clock, value AS error_description FROM long WHERE item_key LIKE 'errDisplay%' AND trim(value) <> ''"}


@query("o08_long_metadata", "SELECT * FROM meta", **META)
def _(m):
    return longform.long_metadata(m.long)


@query("o09_long_supplies", "SELECT * FROM supply", **SUPPLY)
def _(m):
    return longform.long_supplies(m.long)


@query("o10_latest_metric", "SELECT * FROM counter", **COUNTER)
def _(m):
    return longform.latest_metric(m.long, "LifeCount", "mileage")


@query("o11_long_errors", "SELECT * FROM errors", **ERRORS)
def _(m):
    return longform.long_errors(m.long)


@query(
    "o12_pivot_long",
    "SELECT l.device_id, coalesce(e.clock, l.last_clock) AS timestamp, e.error_description, model, vendor, location, mileage, toner_level, drum_level, fuser_level FROM (SELECT device_id, CAST(max(TRY_CAST(clock AS BIGINT)) AS STRING) AS last_clock FROM long GROUP BY device_id) l LEFT JOIN meta USING (device_id) LEFT JOIN supply USING (device_id) LEFT JOIN counter USING (device_id) LEFT JOIN errors e USING (device_id)",
    **META, **SUPPLY, **COUNTER, **ERRORS,
)
def _(m):
    return longform.pivot_long(m.long.withColumnRenamed("value", "metric_value").withColumnRenamed("device_id", "host"))


def parsed(m: Model) -> DataFrame:
    return N.parse(m.raw, m.alias)


def routed(m: Model) -> DataFrame:
    return N.route_rows(N.split_valid(parsed(m))[0])


GOOD = {"good": "SELECT *, error_code IS NOT NULL OR error_description IS NOT NULL AS is_event, coalesce(mileage, toner_level, drum_level, fuser_level) IS NOT NULL AS has_value FROM parsed WHERE reason IS NULL"}
ROUTED = GOOD | {"routed": "SELECT *, has_value OR NOT is_event AS is_snapshot FROM good"}


@query("o13_parse_ts", "SELECT row_no, @us(ts) AS ts_us FROM parsed")
def _(m):
    return m.raw.select("row_no", F.unix_micros(C.parse_ts(F.col("timestamp"))).alias("ts_us"))


@query("o14_norm_code", "SELECT row_no, CASE WHEN event_type = 'error' THEN error_code END AS error_code FROM parsed")
def _(m):
    return m.raw.select("row_no", C.norm_code(F.col("error_code")).alias("error_code"))


@query("o15_canonical_model", "SELECT row_no, model FROM parsed")
def _(m):
    return R.canonical_model(m.raw.select("row_no", F.col("model").alias("raw")), m.alias, "raw", "model").select("row_no", "model")


@query("o16_detect_units", "SELECT 1.0::DOUBLE AS toner_level_multiplier, FALSE AS toner_level_raw, 100.0::DOUBLE AS drum_level_multiplier, FALSE AS drum_level_raw, 1.0::DOUBLE AS fuser_level_multiplier, max(k * 30) > 100 AS fuser_level_raw FROM base WHERE event_type = 'click'")
def _(m):
    return N.detect_units(m.raw)


@query("o17_coerce_levels", "SELECT row_no, toner_level, drum_level, fuser_level, mileage FROM parsed")
def _(m):
    return N.coerce_levels(m.raw, N.detect_units(m.raw)).select("row_no", "toner_level", "drum_level", "fuser_level", "mileage")


@query("o18_quarantine", "SELECT row_no, reason, CASE reason WHEN 'no device_id' THEN 'device_id' ELSE 'timestamp' END AS field FROM parsed WHERE reason IS NOT NULL")
def _(m):
    return N.split_valid(parsed(m))[1].select("row_no", "reason", "field")


@query("o19_backfill_code", "SELECT row_no, error_code, error_description FROM parsed")
def _(m):
    return N.backfill_code(m.raw).select("row_no", "error_code", "error_description")


@query("o20_route_rows", "SELECT row_no, is_event, is_snapshot FROM routed", **ROUTED)
def _(m):
    return routed(m).select("row_no", "is_event", "is_snapshot")


@query("o21_latest_snapshot", "SELECT device_id, @us(ts) AS ts_us, toner_level, drum_level, fuser_level, mileage FROM routed WHERE is_snapshot QUALIFY row_number() OVER (PARTITION BY device_id ORDER BY ts DESC, row_no) = 1", **ROUTED)
def _(m):
    return N.latest_snapshot(N.snapshots_of(routed(m))).select("device_id", F.unix_micros("ts").alias("ts_us"), "toner_level", "drum_level", "fuser_level", "mileage")


@query("o22_device_metadata", "SELECT device_id, arg_min(model, row_no) AS model, arg_min(raw_model, row_no) AS raw_model, arg_min(vendor, row_no) AS vendor, arg_min(location, row_no) AS location FROM routed GROUP BY device_id", **ROUTED)
def _(m):
    return N.device_metadata(routed(m))


@query(
    "o23_ingest_summary",
    """SELECT (SELECT count(*) FROM parsed) AS total_rows, count(*) FILTER (is_event) AS valid_events, count(*) FILTER (is_snapshot) AS valid_snapshots, (SELECT count(*) FROM parsed WHERE reason IS NOT NULL) AS invalid,
      count(DISTINCT device_id) AS devices, @us(min(ts)) AS first_us, @us(max(ts)) AS last_us, (SELECT count(*) FROM base WHERE event_id % 8 = 3) AS unix_timestamps, (SELECT count(error_code) FROM parsed) AS codes,
      (SELECT count(*) FROM parsed WHERE model <> raw_model) AS canonicalised FROM routed""",
    **ROUTED,
)
def _(m):
    out = N.ingest_summary(parsed(m))
    return out.select("total_rows", "valid_events", "valid_snapshots", "invalid", "devices", F.unix_micros("first_ts").alias("first_us"), F.unix_micros("last_ts").alias("last_us"), "unix_timestamps", "codes", "canonicalised")


TWICE = "SELECT device_id, error_code, error_description, CAST(ts AS DATE) AS day, row_no FROM ev"


@query("o24_duplicates", "SELECT device_id, error_code, error_description, CAST(day AS STRING) AS day, count(*) AS copies, min(row_no) AS first_row FROM twice GROUP BY ALL HAVING count(*) > 1", twice=TWICE)
def _(m):
    return N.duplicates(m.sql(TWICE)).withColumn("day", F.col("day").cast("string"))


@query("o24_drop_duplicates", "SELECT min(row_no) AS row_no FROM twice GROUP BY device_id, error_code, error_description, day", twice=TWICE)
def _(m):
    return N.drop_duplicates(m.sql(TWICE)).select("row_no")
