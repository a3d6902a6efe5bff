"""Fleet statistics over scored devices (``health``), their metadata and run history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import columns as C
from . import similar

ZONES = ("green", "yellow", "red")


def _summary_columns():
    counts = [F.count_if(F.col("zone") == z).alias(f"{z}_count") for z in ZONES]
    zero = lambda c: F.coalesce(F.round(c, 6), F.lit(0.0))
    return [F.count("*").alias("devices"), zero(F.avg("health_index")).alias("average_index"), zero(F.median("health_index")).alias("median_index"), *counts, zero(F.avg("confidence")).alias("average_confidence")]


def fleet_summary(health: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Count, mean, median, zone counts and mean confidence; of an empty fleet zeros."""
    return health.groupBy(*by).agg(*_summary_columns()) if by else health.agg(*_summary_columns())


def delta_vs_previous(runs: DataFrame) -> DataFrame:
    """``calculated_at, average_index, previous_index, delta`` of every run in ``calculated_at, health_index`` rows."""
    each = runs.groupBy("calculated_at").agg(F.round(F.avg("health_index"), 6).alias("average_index"))  # one row per run
    order = W.orderBy("calculated_at")
    return each.withColumn("previous_index", F.lag("average_index").over(order)).withColumn("delta", F.round(F.col("average_index") - F.col("previous_index"), 6))


def fleet_statistics(health: DataFrame, devices: DataFrame, model: str | None = None, location: str | None = None, zone: str | None = None) -> DataFrame:
    """Averages overall, by model and by location in one pass: ``model, location, level, devices, average_index``.

    A text filter keeps devices whose value contains it in any case, and those without a value.
    """
    rows = health.select("device_id", "health_index", "zone").join(devices.select("device_id", "model", "location"), "device_id", "left")
    for c, wanted in (("model", model), ("location", location)):
        if wanted:
            rows = rows.filter(F.col(c).isNull() | F.lower(c).contains(wanted.lower()))
    if zone:
        rows = rows.filter(F.col("zone") == zone)
    known = rows.select(F.coalesce("model", F.lit("unknown")).alias("model"), F.coalesce("location", F.lit("unknown")).alias("location"), "health_index")
    sets = known.groupingSets([[], [F.col("model")], [F.col("location")]], F.col("model"), F.col("location"))
    level = F.when(F.grouping("model") == 0, "model").when(F.grouping("location") == 0, "location").otherwise("all")
    return sets.agg(level.alias("level"), F.count("*").alias("devices"), F.round(F.avg("health_index"), 6).alias("average_index"))


def index_distribution(health: DataFrame) -> DataFrame:
    """``bin, low, high, devices``: ten bins of the index, the last one up to 100; empty bins stay."""
    bins = health.sparkSession.range(10).select(F.col("id").cast("int").alias("bin"))
    counts = health.groupBy(F.least(F.floor(F.col("health_index") / 10), F.lit(9)).cast("int").alias("bin")).agg(F.count("*").alias("devices"))
    high = F.when(F.col("bin") == 9, 100).otherwise(F.col("bin") * 10 + 9)
    return bins.join(counts, "bin", "left").select("bin", (F.col("bin") * 10).alias("low"), high.alias("high"), F.coalesce("devices", F.lit(0).cast("long")).alias("devices"))


def category_breakdown(health: DataFrame, devices: DataFrame) -> DataFrame:
    """A summary by model if there are several, else by location if there are several, else by confidence zone."""
    rows = health.join(devices.select("device_id", "model", "location"), "device_id", "left")
    named = rows.withColumns({c: F.coalesce(c, F.lit("unknown")) for c in ("model", "location")})
    kinds = named.agg(F.count_distinct("model").alias("models"), F.count_distinct("location").alias("locations"))  # one row
    by = F.when(F.col("models") > 1, "model").when(F.col("locations") > 1, "location").otherwise("confidence_zone")
    chosen = named.crossJoin(F.broadcast(kinds.select(by.alias("category"))))
    value = F.when(F.col("category") == "model", F.col("model")).when(F.col("category") == "location", F.col("location")).otherwise(F.col("confidence_zone"))
    return chosen.withColumn("value", value).groupBy("category", "value").agg(*_summary_columns())


def device_cards(health: DataFrame, devices: DataFrame, snapshots: DataFrame, history: DataFrame | None = None, points: int = 10) -> DataFrame:
    """One card per device: score, metadata, resources, top problem, review flag (low confidence) and recent history."""
    out = health.join(devices.select("device_id", "model", "location"), "device_id", "left").join(snapshots.select("device_id", "toner_level", "drum_level", "fuser_level", "mileage"), "device_id", "left")
    top = F.transform("contributions", lambda x: x["label"])
    columns = ["device_id", "health_index", "zone", "confidence", "confidence_zone", "model", "location", "toner_level", "drum_level", "fuser_level", "mileage", F.try_element_at(top, F.lit(1)).alias("top_problem"), F.slice(top, 1, 3).alias("top_factors"), (F.col("confidence_zone") == "low").alias("needs_review")]
    if history is not None:
        last = device_history(history, points).groupBy("device_id").agg(F.array_sort(F.collect_list(F.struct("calculated_at", "health_index"))).alias("history"))
        out, columns = out.join(last, "device_id", "left"), [*columns, "history"]
    return out.select(*columns)


def red_zone(cards: DataFrame, sort_by: str = "health_index", limit: int = 20) -> DataFrame:
    """The worst red devices by index or confidence: a top-k."""
    return cards.filter("zone = 'red'").orderBy(sort_by, "device_id").limit(limit).select("device_id", "health_index", "confidence", "model", "location", "top_factors")


def worst_devices(health: DataFrame, k: int = 5) -> DataFrame:
    return health.orderBy("health_index", "device_id").limit(k).select("device_id", "health_index", "zone")


def frequent_problems(health: DataFrame, k: int = 5) -> DataFrame:
    """The contribution labels of the most devices."""
    labels = health.select(F.explode("contributions").alias("c")).groupBy(F.col("c.label").alias("label")).agg(F.count("*").alias("devices"))
    return labels.orderBy(F.desc("devices"), "label").limit(k)


def _by_code(health: DataFrame) -> DataFrame:
    return health.select("device_id", F.explode("contributions").alias("c")).select("device_id", F.regexp_extract("c.label", r"^(.*) \((\w+)\)$", 1).alias("error_code"), F.regexp_extract("c.label", r"^(.*) \((\w+)\)$", 2).alias("severity"))


def mass_errors(health: DataFrame, events: DataFrame, k: int = 10) -> DataFrame:
    """Codes on the most devices: devices, factor rows (``occurrences``), true events, severity and up to three descriptions."""
    codes = _by_code(health).groupBy("error_code").agg(F.count_distinct("device_id").alias("devices"), F.count("*").alias("occurrences"), F.min("severity").alias("severity"))
    top = codes.orderBy(F.desc("devices"), "error_code").limit(k)
    # Counts of each text of the top codes; of a code only three texts leave a task, however many it has.
    texts = events.join(top.select("error_code"), "error_code", "left_semi").groupBy("error_code", "error_description").agg(F.count("*").alias("events"))
    counts = texts.groupBy("error_code").agg(F.sum("events").alias("events"))
    first = smallest(texts.filter("error_description IS NOT NULL"), ["error_code"], "error_description", 3, "descriptions")
    out = top.join(counts, "error_code", "left").join(first, "error_code", "left")
    return out.select("error_code", "devices", "occurrences", F.coalesce("events", F.lit(0).cast("long")).alias("events"), "severity", F.coalesce("descriptions", F.array().cast("array<string>")).alias("descriptions"))


def smallest(rows: DataFrame, by: list[str], value: str, k: int, name: str) -> DataFrame:
    """The sorted ``k`` smallest of the distinct values of each group as ``name``; each task passes on at most ``k`` rows of a group."""
    distinct = rows.select(*by, value).distinct()
    nth = F.row_number().over(W.partitionBy(*by).orderBy(value))
    return distinct.withColumn("nth", nth).filter(F.col("nth") <= k).groupBy(*by).agg(F.array_sort(F.collect_list(value)).alias(name))


def mass_scale(mass: DataFrame, fleet: DataFrame) -> DataFrame:
    """Share of the fleet in whole percent, events per device, and how wide the error is."""
    size = fleet.agg(F.count_distinct("device_id").alias("fleet"))
    share = F.floor(100 * F.col("devices") / F.greatest("fleet", F.lit(1))).cast("int")
    label = F.when(F.col("share_percent") >= 20, "fleet-wide").when(F.col("share_percent") >= 5, "significant").otherwise("isolated")
    out = mass.crossJoin(F.broadcast(size)).withColumn("share_percent", share).withColumn("scale", label)
    return out.select("error_code", "devices", "share_percent", F.round(F.col("events") / F.col("devices"), 6).alias("events_per_device"), "scale")


def list_mass_errors(mass: DataFrame, documents: DataFrame, severity: str | None = None, limit: int = 20) -> DataFrame:
    """Mass errors with the severity of registry documents, heaviest first, unknown last."""
    rank = lambda c: F.array_position(F.array(*[F.lit(x) for x in ("Critical", "High", "Medium", "Low", "Info")]), c)
    found = documents.select(F.explode("error_codes").alias("error_code"), F.col("severity").alias("listed")).groupBy("error_code").agg(F.min_by("listed", rank(F.col("listed"))).alias("listed"))
    out = mass.select("error_code", "devices").join(found, "error_code", "left").select("error_code", "devices", F.coalesce("listed", F.lit("unknown")).alias("severity"))
    if severity:
        out = out.filter(F.lower("severity") == severity.lower())
    order = F.when(rank(F.col("severity")) > 0, rank(F.col("severity"))).otherwise(9)
    return out.orderBy(order, F.desc("devices"), "error_code").limit(limit)


def similar_devices(events: DataFrame, ref: DataFrame, devices: DataFrame, queries: DataFrame, dim: str = "error_and_model", k: int = 20, days: int = 30) -> DataFrame:
    """The ``k`` devices most like each of ``queries`` (``device_id``): ``device_id, other_id, score, shared_codes``.

    The query set is stated and goes against all devices; pairs of the whole fleet are not made.

    Errors give the Jaccard of the codes of 30 days, an equal model adds 0.5 (see ``similar``); by ``location``, an
    equal one gives 1.
    """
    from .store import events_in_window

    info = devices.select("device_id", C.text_or_null(F.col("model")).alias("model"), C.text_or_null(F.col("location")).alias("location"))
    asked = queries.select("device_id").distinct()
    none = F.array().cast("array<string>")
    if dim in ("errors", "error_and_model"):
        codes = events_in_window(events, ref, days).select("device_id", "error_code").distinct()
        pairs = similar.most_alike(codes, info, asked, k, similar.SAME_MODEL * (dim == "error_and_model"))
    else:
        value = 1.0 if dim == "location" else similar.SAME_MODEL
        pairs = similar.same_value(asked, info, dim, k).select("device_id", "other_id", F.lit(value).alias("score"), none.alias("codes"))
    scored = pairs.withColumn("score", F.round("score", 3))
    order = W.partitionBy("device_id").orderBy(F.desc("score"), "other_id")
    best = scored.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= k)
    return best.select("device_id", "other_id", "score", F.col("codes").alias("shared_codes"))


def history_append(history: DataFrame, health: DataFrame, calculated_at) -> DataFrame:
    """The history with one more run."""
    return history.unionByName(health.select("device_id", calculated_at.alias("calculated_at"), "health_index", "confidence"))


def device_history(history: DataFrame, n: int = 10) -> DataFrame:
    """The last ``n`` runs of each device."""
    order = W.partitionBy("device_id").orderBy(F.desc("calculated_at"))
    return history.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= n).drop("nth")


def daily_jump(history: DataFrame, bound: int = 30) -> DataFrame:
    """Every run with its change since the one before; ``abnormal_daily_jump`` where it is more than ``bound`` either way."""
    change = F.col("health_index") - F.lag("health_index").over(W.partitionBy("device_id").orderBy("calculated_at"))
    out = history.withColumn("change", change)
    return out.select("device_id", "calculated_at", "health_index", "change", F.coalesce(F.abs("change") > bound, F.lit(False)).alias("abnormal_daily_jump"))


def mine_patterns(health: DataFrame, least: int = 2, evidence: int = 10) -> DataFrame:
    """Labels on at least ``least`` devices: ``scope`` (their source or fleet), ``observation, devices, evidence`` (first ids)."""
    rows = health.select("device_id", F.explode("contributions").alias("c")).select("device_id", F.col("c.label").alias("label"), F.coalesce("c.source", F.lit("fleet")).alias("scope")).distinct()
    first = smallest(rows, ["scope", "label"], "device_id", evidence, "evidence")
    counts = rows.groupBy("scope", "label").agg(F.count("*").alias("devices")).filter(F.col("devices") >= least)
    return counts.join(first, ["scope", "label"]).select("scope", F.concat(F.lit("factor "), "label").alias("observation"), "devices", "evidence")


def merge_patterns(old: DataFrame, new: DataFrame, evidence: int = 50, per_scope: int = 50) -> DataFrame:
    """Patterns by scope and observation with joined evidence, the widest ``per_scope`` of each scope."""
    both = old.select("scope", "observation", "evidence").unionByName(new.select("scope", "observation", "evidence"))
    ids = both.select("scope", "observation", F.explode_outer("evidence").alias("id"))
    # A pattern without evidence has a null here, which the gathering leaves out.
    merged = smallest(ids, ["scope", "observation"], "id", evidence + 1, "evidence").withColumn("evidence", F.slice("evidence", 1, evidence))
    order = W.partitionBy("scope").orderBy(F.desc(F.size("evidence")), "observation")
    return merged.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= per_scope).drop("nth")


def get_patterns(patterns: DataFrame, scope: str) -> DataFrame:
    """Patterns of a scope, and those of the whole fleet."""
    return patterns.filter(F.col("scope").isin(scope, "fleet"))


def trace_summary(traces: DataFrame) -> DataFrame:
    """Mean tool and model calls, restarts (several attempts) and the number of flagged devices of ``device_id, tool_calls, llm_calls, attempts, flagged``."""
    return traces.agg(F.count("*").alias("runs"), F.round(F.avg("tool_calls"), 6).alias("mean_tool_calls"), F.round(F.avg("llm_calls"), 6).alias("mean_llm_calls"), F.count_if(F.col("attempts") > 1).alias("restarts"), F.count_distinct(F.when(F.col("flagged"), F.col("device_id"))).alias("n_flagged"))


def flagged_devices(traces: DataFrame) -> DataFrame:
    """``device_id, runs`` of every device with a flagged run: a table, as any number of devices can be."""
    return traces.filter("flagged AND device_id IS NOT NULL").groupBy("device_id").agg(F.count("*").alias("runs"))


def report_summary(cards: DataFrame, mass: DataFrame, worst: int = 5) -> DataFrame:
    """One row: devices, red ones, mass codes, mean index and the worst red ids."""
    reds = red_zone(cards, limit=worst).agg(F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("health_index", "device_id"))), lambda x: x["device_id"])).alias("worst_red"))
    one = cards.agg(F.count("*").alias("devices"), F.count_if(F.col("zone") == "red").alias("red_zone"), F.round(F.avg("health_index"), 6).alias("average_index"))
    return one.crossJoin(reds).crossJoin(mass.agg(F.count("*").alias("mass_codes")))  # three rows of one


def build_report(health: DataFrame, events: DataFrame, devices: DataFrame, snapshots: DataFrame) -> dict[str, DataFrame]:
    """All tables of a report; ``health`` should be written or cached by the caller, as each table reads it."""
    cards, mass = device_cards(health, devices, snapshots), mass_errors(health, events)
    return {
        "summary": fleet_summary(health), "distribution": index_distribution(health), "breakdown": category_breakdown(health, devices), "cards": cards, "red_zone": red_zone(cards),
        "worst": worst_devices(health), "problems": frequent_problems(health), "mass_errors": mass, "overview": report_summary(cards, mass), "profile": health.select("snapshot").distinct(),
    }
