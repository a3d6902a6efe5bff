"""Queries over the normalised store of events, snapshots and devices."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

DAY = 86_400_000_000  # microseconds


def event_key():
    """What an event is counted by: its code, else its description, else ""."""
    return F.coalesce("error_code", "error_description", F.lit(""))


def reference_time(events: DataFrame, snapshots: DataFrame) -> DataFrame:
    """One row ``ref``: the latest time of any event or snapshot; null without rows."""
    return events.select("ts").union(snapshots.select("ts")).agg(F.max("ts").alias("ref"))


def reference_micros(ref: DataFrame) -> int | None:
    """The one value of ``ref`` in microseconds, so that what it bounds can be pruned."""
    return ref.select(F.unix_micros("ref").alias("us")).first()["us"]


def events_in_window(events: DataFrame, ref: DataFrame | int | None, days: int = 30) -> DataFrame:
    """Events from ``days`` before the reference time on, that instant included, with ``ref`` added.

    ``ref`` is one row, or its value as ``reference_micros`` reads it: the bound is a literal that reaches the
    scan, and a store that is partitioned by ``event_date`` is pruned to the days of the window. Without a
    reference time there are no events.
    """
    at = reference_micros(ref) if isinstance(ref, DataFrame) else ref
    if at is None:
        return events.limit(0).withColumn("ref", F.lit(None).cast("timestamp"))
    bound = at - days * DAY
    kept = events.filter(F.col("ts") >= _literal(bound))
    if "event_date" in events.columns:
        kept = kept.filter(F.col("event_date") >= F.lit(date(1970, 1, 1) + timedelta(days=bound // DAY - 1)))  # a day more: dates are of the session's zone
    return kept.withColumn("ref", _literal(at))


def _literal(us: int) -> Column:
    return F.expr(f"timestamp_micros({us}L)")


def count_repetitions(events: DataFrame, ref: DataFrame | int | None, days: int = 14) -> DataFrame:
    """``device_id, error_code, n``: events of each code of each device in the window; rows without a code are left out."""
    return events_in_window(events, ref, days).filter("error_code IS NOT NULL").groupBy("device_id", "error_code").agg(F.count("*").alias("n"))


def list_devices(events: DataFrame, snapshots: DataFrame, devices: DataFrame) -> DataFrame:
    """Every device id that any table names, once."""
    ids = [t.select("device_id") for t in (events, snapshots, devices)]
    return ids[0].union(ids[1]).union(ids[2]).distinct()


def latest_by_code(events: DataFrame) -> DataFrame:
    """The latest event of each device and key (code, else description, else ""); equal times go to the first row."""
    order = W.partitionBy("device_id", "key").orderBy(F.desc("ts"), "row_no")
    return events.withColumn("key", event_key()).withColumn("nth", F.row_number().over(order)).filter("nth = 1").drop("nth")


def recent_events(events: DataFrame, ref: DataFrame | int | None, days: int = 30, cap: int = 50, keyless: int = 10) -> DataFrame:
    """A digest of each device: the latest event of each key and the last ``keyless`` without one, newest ``cap``.

    ``device_id, total, truncated, unique_codes`` (sorted) and ``events``, newest first.
    """
    recent = events_in_window(events, ref, days).withColumn("key", event_key())
    order = W.partitionBy("device_id", "key").orderBy(F.desc("ts"), "row_no")
    kept = recent.withColumn("nth", F.row_number().over(order)).filter((F.col("nth") == 1) | ((F.col("key") == "") & (F.col("nth") <= keyless)))
    newest = W.partitionBy("device_id").orderBy(F.desc("ts"), "row_no")
    shown = kept.withColumn("place", F.row_number().over(newest)).filter(F.col("place") <= cap)
    event = F.struct("place", "ts", F.col("error_code").alias("code"), F.col("error_description").alias("description"))
    listed = shown.groupBy("device_id").agg(F.transform(F.array_sort(F.collect_list(event)), lambda e: e.dropFields("place")).alias("events"))
    totals = recent.groupBy("device_id").agg(F.count("*").alias("total"), F.array_sort(F.collect_set("error_code")).alias("unique_codes"))
    sizes = kept.groupBy("device_id").agg((F.count("*") > cap).alias("truncated"))
    return totals.join(sizes, "device_id").join(listed, "device_id").select("device_id", "total", "truncated", "unique_codes", "events")


def device_dossier(events: DataFrame, snapshots: DataFrame, health: DataFrame, last: int = 20, top: int = 3, width: int = 120) -> DataFrame:
    """What a report shows of a device: its last events as lines, its resources as text, its heaviest factors."""
    order = W.partitionBy("device_id").orderBy(F.desc("ts"), "row_no")
    recent = events.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= last)
    line = F.concat_ws(" ", F.date_format("ts", "yyyy-MM-dd HH:mm"), F.coalesce("error_code", F.lit("-")), F.substring(F.coalesce("error_description", F.lit("")), 1, width))
    lines = recent.groupBy("device_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", line.alias("line")))), lambda x: x["line"]).alias("timeline"))
    part = lambda name, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{name}="), F.col(c).cast("string")))
    resources = snapshots.select("device_id", F.concat_ws(", ", part("toner", "toner_level"), part("drum", "drum_level"), part("fuser", "fuser_level"), part("mileage", "mileage")).alias("resources"))
    factors = health.select("device_id", "health_index", "zone", F.transform(F.slice("contributions", 1, top), lambda c: c["label"]).alias("top_factors"))
    return factors.join(lines, "device_id", "left").join(resources, "device_id", "left").select("device_id", "health_index", "zone", "timeline", "resources", "top_factors")
