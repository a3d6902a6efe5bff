"""Metric-per-row exports as wide rows.

Rows have ``device_id, clock, item_key, value`` (text) and, where the export has them, inventory columns.
``clock`` is compared as a time or number, not as text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed import CLOCK_COLUMNS, DEVICE_COLUMNS, ERROR_KEYS, LEVEL_KEYS, MAX_KEYS, SUPPLIES, VALUE_COLUMNS
from ..functions import columns as C

MODEL_COLUMNS = ("inventory_model", "inventory_type", "inventory_type_full", "host_display_name")


def is_long(columns: list[str]) -> bool:
    """True for exports with an item key and a metric value."""
    return {"item_key", "metric_value"} <= {c.lower().strip() for c in columns}


def standard(df: DataFrame) -> DataFrame:
    """The export under standard names, from the first of each list of column names that it has."""
    by_name = {c.lower().strip(): c for c in df.columns}
    pick = lambda names: next((F.col(f"`{by_name[n]}`") for n in names if n in by_name), None)
    needed = {"device_id": pick(DEVICE_COLUMNS), "clock": pick(CLOCK_COLUMNS), "item_key": pick(("item_key",)), "value": pick(VALUE_COLUMNS)}
    if any(c is None for c in needed.values()):
        raise ValueError("not a metric-per-row export: " + ", ".join(k for k, c in needed.items() if c is None))
    extra = {n: by_name[n] for n in (*MODEL_COLUMNS, "inventory_vendor", "inventory_location") if n in by_name}
    out = df.select(*[c.cast("string").alias(k) for k, c in needed.items()], *[F.col(f"`{c}`").cast("string").alias(n) for n, c in extra.items()])
    return out.filter("device_id IS NOT NULL")


def moment(c: Column) -> Column:
    """A clock as a number that orders it: Unix seconds, or microseconds of a date as seconds."""
    return F.coalesce(F.trim(c).try_cast("double"), F.unix_micros(C.parse_ts(c)) / 1e6)


def _starts(key: Column, prefixes: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [key.startswith(p) for p in prefixes])


def long_metadata(df: DataFrame) -> DataFrame:
    """Model, vendor and location of each device: the earliest usable value; the model from the first column that has one."""
    first = lambda c: F.min_by(C.usable(F.col(c)), F.when(C.usable(F.col(c)).isNotNull(), F.struct(moment(F.col("clock")), F.col(c)))) if c in df.columns else F.lit(None).cast("string")
    model = F.coalesce(*[first(c) for c in MODEL_COLUMNS])
    return df.groupBy("device_id").agg(model.alias("model"), first("inventory_vendor").alias("vendor"), first("inventory_location").alias("location"))


def long_supplies(df: DataFrame) -> DataFrame:
    """``toner_level, drum_level, fuser_level`` of each device with any supply level, as percentages.

    The latest level against the largest maximum: of 100, the level up to 100; above 0, the share rounded to
    one digit; without a maximum, the level if it is at most 100, else null.
    """
    key, low = F.col("item_key"), F.lower("item_key")
    kind = reduce(lambda a, n: a.when(reduce(lambda x, y: x | y, [low.contains(h) for h in SUPPLIES[n]]), n), list(SUPPLIES)[1:], F.when(low.contains(SUPPLIES["toner"][0]), "toner"))
    number = F.trim("value").try_cast("double")
    level, cap = F.when(_starts(key, LEVEL_KEYS), number), F.when(_starts(key, MAX_KEYS), number)
    rows = df.select("device_id", kind.alias("kind"), moment(F.col("clock")).alias("at"), level.alias("level"), cap.alias("cap")).filter("kind IS NOT NULL AND (level IS NOT NULL OR cap IS NOT NULL)")
    each = rows.groupBy("device_id", "kind").agg(F.max_by("level", F.when(F.col("level").isNotNull(), F.struct("at", "level"))).alias("level"), F.max("cap").alias("cap"))
    share = F.when(F.col("cap") == 100, F.least("level", F.lit(100.0))).when(F.col("cap") > 0, F.round(F.col("level") / F.col("cap") * 100, 1)).when(F.col("level") <= 100, F.col("level"))
    wide = each.withColumn("share", share).groupBy("device_id").pivot("kind", list(SUPPLIES)).agg(F.first("share"))
    return wide.select("device_id", *[F.col(k).alias(f"{k}_level") for k in SUPPLIES])


def latest_metric(df: DataFrame, key: str, out: str = "value") -> DataFrame:
    """The latest value of one key on each device; equal times go to the larger text."""
    rows = df.filter(F.col("item_key") == key)
    return rows.groupBy("device_id").agg(F.max_by(F.trim("value"), F.struct(moment(F.col("clock")), F.col("value"))).alias(out))


def long_errors(df: DataFrame) -> DataFrame:
    """Distinct (clock, text) of each device's error keys with a text."""
    rows = df.filter(_starts(F.lower("item_key"), ERROR_KEYS)).select("device_id", "clock", F.trim("value").alias("error_description"))
    return rows.filter("error_description <> ''").dropDuplicates()


def pivot_long(df: DataFrame) -> DataFrame:
    """Wide rows: each device's metadata, levels and counter with each of its errors, or once at its last time if it has none."""
    rows = standard(df) if "item_key" not in df.columns or "device_id" not in df.columns else df
    base = rows.groupBy("device_id").agg(F.max_by("clock", F.struct(moment(F.col("clock")), F.col("clock"))).alias("last_clock"))
    for part in (long_metadata(rows), long_supplies(rows), latest_metric(rows, "LifeCount", "mileage")):
        base = base.join(part, "device_id", "left")
    wide = base.join(long_errors(rows), "device_id", "left")
    return wide.select("device_id", F.coalesce("clock", "last_clock").alias("timestamp"), "error_description", "model", "vendor", "location", "mileage", "toner_level", "drum_level", "fuser_level")
