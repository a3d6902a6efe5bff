"""From mapped text columns to events, snapshots, device metadata and rejected rows.

Input rows have ``row_no`` (long) and any of the text columns in FIELDS; a missing one is taken as null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from . import registry as R

FIELDS = ("device_id", "timestamp", "error_code", "error_description", "model", "vendor", "location", "status", "mileage", "toner_level", "drum_level", "fuser_level")
LEVELS = ("toner_level", "drum_level", "fuser_level")
RESOURCES = (*LEVELS, "mileage")


def backfill_code(df: DataFrame, lenient: bool = False) -> DataFrame:
    """Normalise ``error_code``; text that isn't a code becomes the description where there is none, and a missing code is read from the description."""
    code = C.norm_code(F.col("error_code"), lenient)
    description = F.coalesce(F.trim("error_description"), F.when(code.isNull(), C.text_or_null(F.col("error_code"))))
    return df.withColumns({"error_code": F.coalesce(code, C.norm_code(description, lenient)), "error_description": description})


def detect_units(df: DataFrame, hints: dict[str, float] | None = None) -> DataFrame:
    """One row with ``<level>_multiplier`` and ``<level>_raw`` of each level column, from all its numbers.

    A hint decides; all numbers within 0..1 with any above 0 are fractions (times 100); all within 0..100
    percentages; else the column is raw. So a column of only 0 and 1 percent is read as fractions.
    """
    hints = hints or {}
    numbers = {c: F.trim(F.col(c)).try_cast("double") for c in LEVELS}
    one = df.agg(*[f(numbers[c]).alias(f"{c}_{n}") for c in LEVELS for n, f in (("low", F.min), ("high", F.max))])
    out = []
    for c in LEVELS:
        low, high = F.col(f"{c}_low"), F.col(f"{c}_high")
        fraction, percent = (low >= 0) & (high <= 1) & (high > 0), (low >= 0) & (high <= 100)
        if c in hints:
            out += [F.lit(float(hints[c])).alias(f"{c}_multiplier"), F.lit(False).alias(f"{c}_raw")]
        else:
            out += [F.when(fraction, 100.0).otherwise(1.0).alias(f"{c}_multiplier"), F.coalesce(~fraction & ~percent, F.lit(False)).alias(f"{c}_raw")]
    return one.select(out)


def coerce_levels(df: DataFrame, units: DataFrame) -> DataFrame:
    """Levels as percentages, mileage as a number, and ``unit_raw`` of the first level that has a value."""
    joined = df.crossJoin(F.broadcast(units))  # units is one row
    levels = {c: C.coerce_level(F.col(c), F.col(f"{c}_multiplier")) for c in LEVELS}
    raw = F.coalesce(*[F.when(levels[c].isNotNull(), F.col(f"{c}_raw")) for c in LEVELS], F.lit(False))
    out = joined.withColumns({**levels, "mileage": C.coerce_count(F.col("mileage")), "unit_raw": raw})
    return out.drop(*[f"{c}_{x}" for c in LEVELS for x in ("multiplier", "raw")])


def parse(df: DataFrame, aliases: DataFrame, hints: dict[str, float] | None = None, lenient: bool = False) -> DataFrame:
    """All columns parsed, with ``has_code_column``, ``has_resource_columns``, ``raw`` (the text columns as read) and ``why``, the number in REASONS of what rejects a row."""
    present = [c for c in FIELDS if c in df.columns]
    text = df.select("row_no", *[(F.col(c).cast("string") if c in present else F.lit(None).cast("string")).alias(c) for c in FIELDS])
    text = text.withColumn("raw", F.struct(*FIELDS))
    text = text.withColumn("raw_timestamp", F.col("timestamp")).withColumn("unix_time", C.is_unix(F.col("timestamp")))
    text = coerce_levels(text, detect_units(text, hints))
    text = text.withColumn("raw_code", C.text_or_null(F.col("error_code")))
    text = backfill_code(text, lenient)
    text = R.canonical_model(text.withColumn("raw_model", F.trim("model")), aliases, "raw_model", "model")
    # Read once, as a row of its own: written as a column, the long expression would be repeated in every filter on it.
    text = text.select("*", F.inline(F.array(F.struct(C.parse_ts(F.col("timestamp")).alias("ts")))))
    out = text.withColumns({
        "device_id": C.text_or_null(F.col("device_id")),
        "vendor": F.trim("vendor"), "location": F.trim("location"), "status": F.trim("status"),
        "has_code_column": F.lit("error_code" in present), "has_resource_columns": F.lit(any(c in present for c in RESOURCES)),
    })
    # A time that is there but was not read comes first, so without a time only a missing one is left below it.
    why = (
        F.when(F.col("raw_timestamp").isNotNull() & F.col("ts").isNull(), 1)
        .when(F.col("device_id").isNull(), 2)
        .when(F.col("raw_timestamp").isNull(), 3)
        .when(F.length("device_id") > 100, 4)
        .when(F.col("mileage") < 0, 5)
    )
    return out.withColumn("why", why).drop("timestamp", "raw_timestamp")


#: What rejects a row, and the field it is in; ``why`` counts from 1.
REASONS = (("bad timestamp", "timestamp"), ("no device_id", "device_id"), ("no timestamp", "timestamp"), ("device_id too long", "device_id"), ("negative mileage", "mileage"))


def split_valid(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that stand, and rejected ones as ``row_no, raw_data, reason, field``; only these get a map of their raw values."""
    pairs = F.map_from_arrays(F.array(*[F.lit(c) for c in FIELDS]), F.array(*[F.col("raw")[c] for c in FIELDS]))
    named = [F.element_at(F.array(*[F.lit(r[i]) for r in REASONS]), F.col("why")).alias(n) for i, n in enumerate(("reason", "field"))]
    bad = parsed.filter("why IS NOT NULL").select("row_no", F.map_filter(pairs, lambda k, v: v.isNotNull()).alias("raw_data"), *named)
    return parsed.filter("why IS NULL"), bad


def route_rows(valid: DataFrame) -> DataFrame:
    """Add ``is_event`` and ``is_snapshot``; a row can be both or, without any matching column, neither.

    An event has a code, or a description where the table has a code column. A snapshot has any resource value.
    Other rows are snapshots of tables with resource columns, else events of tables with a code column.
    """
    event = F.col("error_code").isNotNull() | (F.col("has_code_column") & F.col("error_description").isNotNull())
    resource = F.coalesce(*[F.col(c).cast("long") for c in RESOURCES]).isNotNull()
    neither = ~event & ~resource
    return valid.withColumns({"is_event": event | (neither & ~F.col("has_resource_columns") & F.col("has_code_column")), "is_snapshot": resource | (neither & F.col("has_resource_columns"))})


def events_of(routed: DataFrame) -> DataFrame:
    return routed.filter("is_event").select("device_id", "ts", "error_code", "error_description", "model", "vendor", "location", "status", "row_no")


def snapshots_of(routed: DataFrame) -> DataFrame:
    return routed.filter("is_snapshot").select("device_id", "ts", *LEVELS, "mileage", F.lit(None).cast("int").alias("service_interval"), "unit_raw", "row_no")


def latest_snapshot(snapshots: DataFrame) -> DataFrame:
    """The latest snapshot of each device; equal times go to the first row."""
    columns = [c for c in snapshots.columns if c not in ("device_id", "row_no")]
    last = snapshots.groupBy("device_id").agg(F.max_by(F.struct(*columns), F.struct("ts", (-F.col("row_no")).alias("first"))).alias("s"))
    return last.select("device_id", *[f"s.{c}" for c in columns])


def device_metadata(routed: DataFrame) -> DataFrame:
    """First non-empty model (canonical and as read), vendor and location of each device, over events and snapshots."""
    first = lambda c: F.min_by(F.col(c), F.when(C.text_or_null(F.col(c)).isNotNull(), F.col("row_no"))).alias(c)
    rows = routed.filter("is_event OR is_snapshot")
    out = rows.groupBy("device_id").agg(first("model"), first("raw_model"), first("vendor"), first("location"))
    blank = lambda c: C.text_or_null(F.col(c)).alias(c)
    return out.select("device_id", blank("model"), blank("raw_model"), blank("vendor"), blank("location"))


def ingest_summary(parsed: DataFrame) -> DataFrame:
    """One row of counts, time range and a 16-digit checksum over all rows, whatever their order."""
    routed = route_rows(parsed).withColumn("ok", F.col("why").isNull())
    row = F.sha2(F.to_json(F.struct("row_no", F.col("raw").alias("raw_data"))), 256)
    number = F.conv(F.substring(row, 1, 15), 16, 10).cast("decimal(38,0)")
    ok = F.col("ok")
    return routed.agg(
        F.count("*").alias("total_rows"), F.count_if(ok & F.col("is_event")).alias("valid_events"), F.count_if(ok & F.col("is_snapshot")).alias("valid_snapshots"),
        F.count_if(~ok).alias("invalid"), F.count_distinct(F.when(ok, F.col("device_id"))).alias("devices"),
        F.min(F.when(ok, F.col("ts"))).alias("first_ts"), F.max(F.when(ok, F.col("ts"))).alias("last_ts"),
        F.count_if("unix_time").alias("unix_timestamps"), F.count_if(F.col("error_code").isNotNull()).alias("codes"),
        F.count_if(F.col("model") != F.col("raw_model")).alias("canonicalised"),
        F.substring(F.sha2(F.coalesce(F.sum(number), F.lit(0)).cast("string"), 256), 1, 16).alias("checksum"),
    )


def duplicates(events: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Groups of events that are equal in all ``columns`` (all but the row number), with ``copies`` and their first row."""
    columns = columns or [c for c in events.columns if c != "row_no"]
    return events.groupBy(*columns).agg(F.count("*").alias("copies"), F.min("row_no").alias("first_row")).filter("copies > 1")


def drop_duplicates(events: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The first row of each group of equal events."""
    columns = columns or [c for c in events.columns if c != "row_no"]
    return events.groupBy(*columns).agg(F.min("row_no").alias("row_no")).select(events.columns)


def normalize(df: DataFrame, aliases: DataFrame, hints: dict[str, float] | None = None, lenient: bool = False) -> dict[str, DataFrame]:
    """The whole store: ``events, snapshots`` (latest of each device), ``devices, invalid, summary``."""
    parsed = parse(df, aliases, hints, lenient)
    valid, invalid = split_valid(parsed)
    routed = route_rows(valid)
    return {"events": events_of(routed), "snapshots": latest_snapshot(snapshots_of(routed)), "devices": device_metadata(routed), "invalid": invalid, "summary": ingest_summary(parsed)}
