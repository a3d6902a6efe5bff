"""The test tables as the model: events, snapshots, devices, a code registry, raw logs, documents.

Each table is SQL that Spark and DuckDB both run, so a query and the SQL it must match start from the same
rows. Everything is derived from the whole of the given tables.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

SOURCES = ("events", "customer", "nation", "region", "documents", "pages", "benchmark", "labels", "embeddings", "conversations")

_BAND = "CASE WHEN {0} < 5 THEN 'Critical' WHEN {0} < 15 THEN 'High' WHEN {0} < 35 THEN 'Medium' WHEN {0} < 70 THEN 'Low' ELSE 'Info' END"
_CODE = "'C' || lpad(CAST(k AS STRING), 4, '0')"
_DASHED = "lpad(CAST(k AS STRING), 2, '0') || '-' || lpad(CAST(k * 7 AS STRING), 3, '0') || '-' || lpad(CAST((k * 3) % 100 AS STRING), 2, '0')"
_DAY = "part.d || {0} || part.mo || {0} || part.y"
_CLOCK = "part.h || ':' || part.mi || ':' || part.s"

#: In order: a table may use those before it. @epoch, @us and @trunc are the only words that differ by engine.
TABLES: dict[str, str] = {
    "base": "SELECT event_id, CAST(ts AS TIMESTAMP) AS ts, user_id, event_type, value, CAST(regexp_extract(props, '[0-9]+', 0) AS INT) AS k, 'DEV-' || CAST(user_id AS STRING) AS device_id FROM {events}",
    "ev": f"""
        SELECT device_id, ts, CASE WHEN event_type = 'error' THEN {_CODE} WHEN event_type = 'signup' THEN {_DASHED} END AS error_code,
          CASE WHEN event_type = 'error' THEN 'fault ' || CAST(k % 9 AS STRING) WHEN event_type = 'purchase' AND k % 4 > 0 THEN 'note ' || CAST(k % 5 AS STRING) END AS error_description,
          event_id AS row_no
        FROM base WHERE event_type IN ('error', 'signup', 'purchase')""",
    "snap": """
        SELECT device_id, ts, CAST(CAST(floor(value) AS BIGINT) % 101 AS INT) AS toner_level, k AS drum_level, CASE WHEN k % 3 > 0 THEN 100 - k END AS fuser_level,
          event_id * 10 AS mileage, 50000 AS service_interval, FALSE AS unit_raw, event_id AS row_no
        FROM base WHERE event_type IN ('view', 'click')""",
    "dev": """
        SELECT 'DEV-' || CAST(c_custkey AS STRING) AS device_id, CASE WHEN c_custkey % 11 > 0 THEN c_mktsegment END AS model, r_name AS vendor, CASE WHEN c_custkey % 13 > 0 THEN n_name END AS location
        FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey""",
    "reg": f"""
        SELECT vendor, model, lower(model) AS model_slug, {_CODE} AS code, 'code ' || CAST(k AS STRING) AS description, {_BAND.format("(k + CASE WHEN model = 'MACHINERY' AND k % 5 = 0 THEN 10 ELSE 0 END)")} AS severity,
          CASE k % 4 WHEN 0 THEN 'print' WHEN 1 THEN 'quality' WHEN 2 THEN 'fusing' ELSE 'jam' END AS component, CASE WHEN k % 6 = 0 THEN 'note' END AS notes,
          CASE vendor WHEN 'EUROPE' THEN 1 WHEN 'ASIA' THEN 2 WHEN 'AMERICA' THEN 3 ELSE 4 END AS vendor_order
        FROM (SELECT DISTINCT vendor, model, k FROM base JOIN dev ON base.device_id = dev.device_id WHERE event_type = 'error' AND model IS NOT NULL AND k % 10 <> 9) AS seen""",
    "over": f"SELECT DISTINCT {_CODE} AS code, 'Low' AS severity, CAST(0.5 AS DOUBLE) AS confidence FROM base WHERE k % 20 = 9",
    "alias": "SELECT DISTINCT lower(model) AS alias, model AS canonical FROM dev WHERE model IS NOT NULL UNION ALL SELECT DISTINCT 'the ' || lower(model), model FROM dev WHERE model IS NOT NULL",
    "part": """
        SELECT event_id, CAST(extract(YEAR FROM ts) AS STRING) AS y, lpad(CAST(extract(MONTH FROM ts) AS STRING), 2, '0') AS mo, lpad(CAST(extract(DAY FROM ts) AS STRING), 2, '0') AS d,
          lpad(CAST(extract(HOUR FROM ts) AS STRING), 2, '0') AS h, lpad(CAST(extract(MINUTE FROM ts) AS STRING), 2, '0') AS mi, lpad(CAST(CAST(floor(extract(SECOND FROM ts)) AS INT) AS STRING), 2, '0') AS s,
          extract(DAY FROM ts) AS day_no
        FROM base""",
    "raw": f"""
        SELECT base.event_id AS row_no, CASE WHEN base.event_id % 97 = 0 THEN '  ' ELSE ' ' || base.device_id END AS device_id,
          CASE base.event_id % 8 WHEN 0 THEN {_DAY.format("'.'")} || ' ' || {_CLOCK} WHEN 1 THEN part.y || '-' || part.mo || '-' || part.d || ' ' || {_CLOCK}
            WHEN 2 THEN {_DAY.format("'/'")} || ' ' || {_CLOCK} WHEN 3 THEN CAST(@epoch(base.ts) AS STRING) WHEN 4 THEN part.y || '-' || part.mo || '-' || part.d WHEN 5 THEN 'not a date'
            WHEN 6 THEN CASE WHEN day_no > 12 THEN part.mo || '/' || part.d || '/' || part.y || ' ' || {_CLOCK} ELSE part.y || '-' || part.mo || '-' || part.d || 'T' || {_CLOCK} END END AS timestamp,
          CASE WHEN event_type = 'error' THEN CASE k % 4 WHEN 0 THEN {_CODE} WHEN 1 THEN 'error: c-' || lpad(CAST(k AS STRING), 4, '0') WHEN 2 THEN 'Код C00 ' || lpad(CAST(k AS STRING), 2, '0') ELSE {_CODE} || ' (see notes)' END
            WHEN event_type = 'purchase' THEN 'odd ' || CAST(k AS STRING) END AS error_code,
          CASE WHEN event_type = 'signup' THEN 'unit ' || {_DASHED} || ' stopped' WHEN event_type = 'purchase' AND k % 2 = 0 THEN ' noted ' END AS error_description,
          CASE base.event_id % 3 WHEN 0 THEN lower(model) WHEN 1 THEN model || ' SN123456' ELSE model || ' X' END AS model, vendor, location, CAST(NULL AS STRING) AS status,
          CASE WHEN event_type = 'view' THEN CASE WHEN k % 17 = 0 THEN 'bad' ELSE CAST(base.event_id * 10 AS STRING) END END AS mileage,
          CASE WHEN event_type IN ('view', 'click') THEN CAST(CAST(floor(value) AS BIGINT) % 101 AS STRING) END AS toner_level,
          CASE WHEN event_type = 'view' THEN '0.' || lpad(CAST(k AS STRING), 2, '0') END AS drum_level, CASE WHEN event_type = 'click' THEN CAST(k * 30 AS STRING) END AS fuser_level
        FROM base JOIN part ON base.event_id = part.event_id LEFT JOIN dev ON base.device_id = dev.device_id""",
    # What ``raw`` must become, from how it was made.
    "parsed": f"""
        SELECT base.event_id AS row_no, CASE WHEN base.event_id % 97 > 0 THEN base.device_id END AS device_id,
          CASE WHEN base.event_id % 8 IN (5, 7) THEN NULL WHEN base.event_id % 8 = 4 THEN @trunc('day', base.ts) ELSE @trunc('second', base.ts) END AS ts,
          CASE WHEN event_type = 'error' THEN {_CODE} WHEN event_type = 'signup' THEN {_DASHED} END AS error_code,
          CASE WHEN event_type = 'signup' THEN 'unit ' || {_DASHED} || ' stopped' WHEN event_type = 'purchase' THEN CASE WHEN k % 2 = 0 THEN 'noted' ELSE 'odd ' || CAST(k AS STRING) END END AS error_description,
          CASE base.event_id % 3 WHEN 2 THEN model || ' X' ELSE model END AS model, CASE base.event_id % 3 WHEN 0 THEN lower(model) WHEN 1 THEN model || ' SN123456' ELSE model || ' X' END AS raw_model, vendor, location,
          CASE WHEN event_type = 'view' AND k % 17 > 0 THEN base.event_id * 10 END AS mileage,
          CASE WHEN event_type IN ('view', 'click') THEN CAST(CAST(floor(value) AS BIGINT) % 101 AS INT) END AS toner_level, CASE WHEN event_type = 'view' THEN k END AS drum_level,
          CASE WHEN event_type = 'click' THEN CAST(least(100, k * 30) AS INT) END AS fuser_level, event_type,
          CASE WHEN base.event_id % 8 = 5 THEN 'bad timestamp' WHEN base.event_id % 97 = 0 THEN 'no device_id' WHEN base.event_id % 8 = 7 THEN 'no timestamp' END AS reason
        FROM base LEFT JOIN dev ON base.device_id = dev.device_id""",
    "long": """
        SELECT base.device_id, CAST(@epoch(ts) AS STRING) AS clock,
          CASE event_type WHEN 'error' THEN 'errDisplay[' || CAST(k % 3 AS STRING) || ']' WHEN 'view' THEN CASE k % 3 WHEN 0 THEN 'SupplLev Toner' WHEN 1 THEN 'SupplLev Drum' ELSE 'prtMarkerSuppliesLevel fuser' END
            WHEN 'click' THEN CASE k % 3 WHEN 0 THEN 'SupplMax Toner' WHEN 1 THEN 'SupplMax Drum' ELSE 'other' END WHEN 'purchase' THEN 'LifeCount' ELSE 'ping' END AS item_key,
          CASE event_type WHEN 'error' THEN CASE WHEN k % 10 = 0 THEN ' ' ELSE 'fault ' || CAST(k % 9 AS STRING) END WHEN 'view' THEN CAST(k AS STRING) WHEN 'click' THEN CASE WHEN k % 3 = 0 THEN '100' ELSE '400' END ELSE CAST(event_id AS STRING) END AS value,
          CASE WHEN event_id % 2 = 0 THEN 'none' ELSE model END AS inventory_model, model || ' type' AS inventory_type, vendor AS inventory_vendor, location AS inventory_location
        FROM base LEFT JOIN dev ON base.device_id = dev.device_id""",
    "doc": """
        SELECT 'D' || CAST(doc_id AS STRING) AS document_id, source || '_' || lang || '.txt' AS file_name, lang, source, doc_id,
          'phone +7 (912) 345-67-' || lpad(CAST(doc_id % 100 AS STRING), 2, '0') || ' code C' || lpad(CAST(doc_id % 1000 AS STRING), 4, '0') || ' fuser unit  x' || chr(10) || chr(10) || chr(10) || text AS text
        FROM {documents}""",
    "vec": "SELECT vec_id, embedding, label FROM {embeddings}",
}


def _dialect(sql: str, duck: bool) -> str:
    words = {"@epoch": "epoch_s" if duck else "unix_seconds", "@us": "epoch_us" if duck else "unix_micros", "@trunc": "date_trunc"}
    for k, v in words.items():
        sql = sql.replace(k, v)
    return sql.replace("epoch_s(", "CAST(floor(epoch(").replace("base.ts) AS STRING", "base.ts)) AS BIGINT) AS STRING").replace("(ts) AS STRING", "(ts)) AS BIGINT) AS STRING") if duck else sql


def _needed(sql: str) -> list[str]:
    """Names of TABLES that ``sql`` uses, with what those use, in order."""
    names: set[str] = set()
    todo = [sql]
    while todo:
        text = todo.pop()
        for name in TABLES:
            if name not in names and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text):
                names.add(name)
                todo.append(TABLES[name])
    return [n for n in TABLES if n in names]


def duck(sql: str, **more: str) -> str:
    """DuckDB SQL of a query over TABLES, and over further named queries in order."""
    body = "\n".join([*more.values(), sql])
    ctes = [f"{n} AS ({_dialect(TABLES[n], True)})" for n in _needed(body)] + [f"{n} AS ({_dialect(q, True)})" for n, q in more.items()]
    text = (f"WITH RECURSIVE {', '.join(ctes)} " if ctes else "") + _dialect(sql, True)
    for source in SOURCES:
        text = text.replace(f"{{{source}}}", source)
    return text


class Model:
    """The tables of one data folder as DataFrames, by name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def source(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def sql(self, sql: str) -> DataFrame:
        ctes = [f"{n} AS ({_dialect(TABLES[n], False)})" for n in _needed(sql)]
        text = (f"WITH {', '.join(ctes)} " if ctes else "") + _dialect(sql, False)
        return self.spark.sql(text, **{s: self.source(s) for s in SOURCES if f"{{{s}}}" in text})

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        return self.sql(f"SELECT * FROM {name}")
