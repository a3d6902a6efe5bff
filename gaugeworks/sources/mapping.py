"""Mapping of foreign column names and contents onto the fields of the model."""

from __future__ import annotations

import hashlib
import re
import unicodedata

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixed import CODE, LEVEL_HINTS, MILEAGE_HINTS, SYNONYMS
from ..functions import columns as C

SAMPLE = 200
LEAST_ROWS = 20


class NoDeviceColumn(ValueError):
    """No column can be the device id."""


def normal_name(name: str) -> str:
    """Lower case, without brackets and diacritics, separators as one underscore."""
    s = re.sub(r"\(.*?\)", "", name.lower()).strip()
    s = "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))
    return re.sub(r"[\s\-.]+", "_", s).strip("_")


def signature(columns: list[str]) -> str:
    """SHA-256 of the sorted normalised names."""
    return hashlib.sha256("|".join(sorted(map(normal_name, columns))).encode()).hexdigest()


def profile_columns(df: DataFrame, cols: list[str], sample: int = SAMPLE) -> DataFrame:
    """A row per column: rates over the first ``sample`` non-empty values, and distinct ratio and lengths over all.

    ``column, filled, code_rate, ts_rate, numeric_rate, low, high, distinct_ratio, min_length, max_length``.
    The first values are those of the smallest ``row_no`` and are taken column by column as a top-k, so one
    small aggregate of the samples joins one aggregate of the whole table.
    """
    every = [F.struct(F.lit(c).alias("column"), C.text_or_null(F.col(c).cast("string")).alias("value")) for c in cols]
    values = df.select("row_no", F.explode(F.array(*every)).alias("x")).select("row_no", "x.column", "x.value").filter("value IS NOT NULL")
    whole = values.groupBy("column").agg(F.count("*").alias("filled"), (F.count_distinct("value") / F.count("*")).alias("distinct_ratio"), F.min(F.length("value")).alias("min_length"), F.max(F.length("value")).alias("max_length"))
    from pyspark.sql import Window as W

    first = values.withColumn("nth", F.row_number().over(W.partitionBy("column").orderBy("row_no"))).filter(F.col("nth") <= sample)
    number = F.col("value").try_cast("double")
    rates = first.groupBy("column").agg(
        F.avg(F.upper("value").rlike(CODE).cast("double")).alias("code_rate"), F.avg(C.parse_ts(F.col("value")).isNotNull().cast("double")).alias("ts_rate"),
        F.avg(number.isNotNull().cast("double")).alias("numeric_rate"), F.min(number).alias("low"), F.max(number).alias("high"),
    )
    return whole.join(rates, "column").select("column", "filled", "code_rate", "ts_rate", "numeric_rate", "low", "high", "distinct_ratio", "min_length", "max_length")


def by_synonym(columns: list[str], synonyms: dict[str, list[str]] | None = None) -> dict[str, str]:
    """Columns whose normalised name is a field's; each field once, the first column wins."""
    table = {normal_name(s): field for field, names in (synonyms or SYNONYMS).items() for s in names}
    out: dict[str, str] = {}
    for c in columns:
        field = table.get(normal_name(c))
        if field and field not in out.values():
            out[c] = field
    return out


def by_content(profiles: dict[str, dict], columns: list[str], used: set[str]) -> dict[str, str]:
    """Columns whose values look like a field's, by the rules in order; each field once."""
    out: dict[str, str] = {}
    for c in columns:
        p = profiles.get(c)
        if not p:
            continue
        name, free = normal_name(c), lambda f: f not in used
        percent = p["numeric_rate"] >= 0.8 and p["low"] >= 0 and p["high"] <= 100
        level = next((f for f, hints in LEVEL_HINTS.items() if free(f) and any(h in name for h in hints)), None)
        if free("error_code") and p["code_rate"] == 1:
            field = "error_code"
        elif percent and level:
            field = level
        elif free("timestamp") and p["ts_rate"] >= 0.9:
            field = "timestamp"
        elif free("mileage") and any(h in name for h in MILEAGE_HINTS) and p["numeric_rate"] >= 0.8 and p["high"] > 1000:
            field = "mileage"
        elif free("device_id") and p["filled"] >= LEAST_ROWS and p["distinct_ratio"] > 0.9 and p["min_length"] >= 3 and p["max_length"] <= 20:
            field = "device_id"
        else:
            continue
        out[c] = field
        used.add(field)
    return out


def map_columns(df: DataFrame, synonyms: dict[str, list[str]] | None = None, saved: dict[str, dict[str, str]] | None = None, overrides: dict[str, str] | None = None) -> tuple[DataFrame, dict[str, str], dict[str, str], list[str]]:
    """The table under field names, the mapping, where each entry comes from, and the columns left over.

    A saved mapping (by ``signature``) wins; else names, then contents, then ``overrides`` on top. Needs
    ``row_no``. Without a device id the table is rejected. Only one row per unmapped column reaches the driver.
    """
    columns = [c for c in df.columns if c != "row_no"]
    found = (saved or {}).get(signature(columns))
    if found is not None:
        mapping, origin = dict(found), dict.fromkeys(found, "saved")
    else:
        mapping = by_synonym(columns, synonyms)
        origin = dict.fromkeys(mapping, "synonym")
        rest = [c for c in columns if c not in mapping]
        if rest:
            profiles = {r["column"]: r.asDict() for r in profile_columns(df, rest).collect()}
            content = by_content(profiles, rest, set(mapping.values()))
            mapping |= content
            origin |= dict.fromkeys(content, "content")
    for column, target in (overrides or {}).items():
        mapping = {c: f for c, f in mapping.items() if f != target} | {column: target}
        origin[column] = "override"
    if "device_id" not in mapping.values():
        raise NoDeviceColumn(", ".join(columns))
    out = df.select("row_no", *[F.col(f"`{c}`").cast("string").alias(f) for c, f in mapping.items()])
    return out, mapping, {c: origin[c] for c in mapping}, [c for c in columns if c not in mapping]
