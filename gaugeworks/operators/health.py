"""Health scoring: factors, contributions, index, confidence and zones of every device in one plan."""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..fixed import Weights
from ..functions import columns as C
from . import registry as R
from . import store as S


def context_modifiers(factors: DataFrame, snapshots: DataFrame, w: Weights) -> DataFrame:
    """``multipliers`` of each factor: rules whose resource is past its bound, for the factor's component.

    Names that end in ``_low`` bind below their bound, ``_high`` above it; the mileage rule binds beyond the
    service interval. A device without a snapshot has none.
    """
    joined = factors.join(snapshots.select("device_id", "toner_level", "drum_level", "fuser_level", "mileage", "service_interval"), "device_id", "left")
    rules = []
    for m in w.modifiers:
        value = F.col(m.resource)
        past = value > F.col("service_interval") if m.threshold is None else value < m.threshold if m.name.endswith("_low") else value > m.threshold
        fits = F.lit(True) if "*" in m.components else F.col("component").isin(*m.components)
        rules.append(F.when(past & fits, F.lit(float(m.multiplier))))
    return joined.withColumn("multipliers", F.array_compact(F.array(*rules))).drop("toner_level", "drum_level", "fuser_level", "mileage", "service_interval")


def coefficients(factors: DataFrame, w: Weights, strict: bool = False) -> DataFrame:
    """Add ``s, r, c, a`` to raw factors (``severity, n, age_days, multipliers``).

    A count of zero repetitions, which a key without a code has, counts as one; ``strict`` keeps it for the
    caller to reject.
    """
    n = F.col("n") if strict else F.greatest("n", F.lit(1))
    return factors.withColumns({"n": n, "s": C.weight_s(F.col("severity"), w), "r": C.coef_r(n, w), "c": C.coef_c(F.col("multipliers"), w), "a": C.coef_a(F.col("age_days"), w)})


def raw_factors(events: DataFrame, ref: DataFrame, devices: DataFrame, code_registry: DataFrame, overrides: DataFrame, w: Weights) -> DataFrame:
    """One row per device and key in the window, classified and counted, before any weight."""
    at = S.reference_micros(ref)
    recent = S.latest_by_code(S.events_in_window(events, at, w.window_days))
    counts = S.count_repetitions(events, at, w.repeat_days).withColumnRenamed("error_code", "key")
    keyed = recent.join(counts, ["device_id", "key"], "left").join(devices.select("device_id", "model", "vendor"), "device_id", "left")
    named = R.classify(keyed.select("device_id", "key", "ts", "ref", F.coalesce("n", F.lit(0)).alias("n"), "vendor", "model"), code_registry, overrides)
    return named.select("device_id", F.col("key").alias("error_code"), "severity", "component", "source", "ts", "n", C.age_days(F.col("ts"), F.col("ref")).alias("age_days"), F.array().cast("array<double>").alias("multipliers"))


def build_factors(events: DataFrame, ref: DataFrame, devices: DataFrame, code_registry: DataFrame, overrides: DataFrame, w: Weights) -> DataFrame:
    """``raw_factors`` with coefficients and ``penalty``."""
    return coefficients(raw_factors(events, ref, devices, code_registry, overrides, w), w).withColumn("penalty", penalty())


def penalty() -> Column:
    """The penalty of a factor with coefficients."""
    return F.col("s") * F.col("r") * F.col("c") * F.col("a")


def cap_critical(factors: DataFrame, limit: int = 1) -> DataFrame:
    """At most ``limit`` critical factors of a device and UTC day: the heaviest, equal ones by code; all others stay."""
    critical = F.col("severity") == "Critical"
    order = W.partitionBy("device_id", F.to_date("ts"), critical).orderBy(F.desc("penalty"), "error_code")
    return factors.withColumn("nth", F.row_number().over(order)).filter(~critical | (F.col("nth") <= limit)).drop("nth")


def _contributions() -> Column:
    label = F.concat("error_code", F.lit(" ("), "severity", F.lit(")"))
    part = F.struct((-F.col("penalty")).alias("order"), label.alias("label"), F.round("penalty", 2).alias("penalty"), *[F.round(x, 4).alias(x) for x in "srca"], "source")
    return F.transform(F.array_sort(F.collect_list(part)), lambda x: x.dropFields("order")).alias("contributions")


def _total_penalty() -> Column:
    finite = F.col("penalty").isNotNull() & ~F.isnan("penalty") & (F.abs("penalty") != float("inf"))
    return F.sum(F.when(F.assert_true(finite, F.lit("a penalty is not a finite number")).isNull(), F.col("penalty"))).alias("total_penalty")


def _index(total: str) -> Column:
    return F.greatest(F.lit(1), F.bround(100 - F.col(total), 0).cast("int")).alias("health_index")


def contributions(factors: DataFrame) -> DataFrame:
    """``device_id, contributions``: label, penalty and coefficients of each factor, heaviest first, then by label."""
    return factors.groupBy("device_id").agg(_contributions())


def health_index(factors: DataFrame) -> DataFrame:
    """``device_id, total_penalty, health_index``: 100 less the unrounded penalties, rounded half to even, at least 1.

    A penalty that isn't a finite number fails the query.
    """
    return factors.groupBy("device_id").agg(_total_penalty()).select("device_id", "total_penalty", _index("total_penalty"))


def confidence(flags: DataFrame, w: Weights) -> DataFrame:
    """Add ``confidence`` (rounded to 4) and ``reasons`` from ``rag_missing_count`` and five flags."""
    rules = [
        ("missing_resources", w.missing_resources, "no resource data"), ("missing_model", w.missing_model, "device model unknown"),
        ("abnormal_daily_jump", w.abnormal_daily_jump, "index jumped by more than 30"), ("anomalous_event_count", w.anomalous_event_count, "anomalous number of events"),
        ("no_events_and_no_resources", w.no_events_and_no_resources, "neither events nor resources"),
    ]
    missing = F.col("rag_missing_count")
    value, reasons = F.when(missing > 0, F.pow(F.lit(w.rag_not_found), missing)).otherwise(1.0), [F.when(missing > 0, F.concat(missing.cast("string"), F.lit(" codes not found")))]
    for name, penalty, reason in rules:
        on = F.coalesce(F.col(name), F.lit(False))
        value = value * F.when(on, F.lit(penalty)).otherwise(1.0)
        reasons.append(F.when(on, F.lit(reason)))
    return flags.withColumn("confidence", F.round(F.greatest(F.lit(w.confidence_min), value), 4)).withColumn("reasons", F.array_compact(F.array(*reasons)))


def confidence_flags(ids: DataFrame, snapshots: DataFrame, devices: DataFrame, factors: DataFrame | None = None) -> DataFrame:
    """What confidence depends on, for every device; with ``factors``, codes that no registry knew count as not found."""
    seen = snapshots.select("device_id").distinct().withColumn("has_snapshot", F.lit(True))
    models = devices.select("device_id", "model")
    out = ids.join(seen, "device_id", "left").join(models, "device_id", "left")
    out = out.select("device_id", F.col("has_snapshot").isNull().alias("missing_resources"), C.text_or_null(F.col("model")).isNull().alias("missing_model"))
    out = out.withColumns({k: F.lit(False) for k in ("abnormal_daily_jump", "anomalous_event_count", "no_events_and_no_resources")})
    if factors is None:
        return out.withColumn("rag_missing_count", F.lit(0).cast("long"))
    unknown = factors.filter("source = 'fallback'").groupBy("device_id").agg(F.count("*").alias("rag_missing_count"))
    return out.join(unknown, "device_id", "left").withColumn("rag_missing_count", F.coalesce("rag_missing_count", F.lit(0).cast("long")))


def _silent(mode: str) -> tuple[Column, Column]:
    """Confidence and reasons of a device without factors."""
    reasons = F.array().cast("array<string>") if mode == "optimistic" else F.array(F.lit(f"no events: {mode}"))
    return F.lit(1.0 if mode == "optimistic" else 0.9), reasons


def _last(history: DataFrame) -> DataFrame:
    """The index and confidence of each device's last run, as ``last``."""
    return history.groupBy("device_id").agg(F.max_by(F.struct("health_index", "confidence"), "calculated_at").alias("last"))


def silent_devices(ids: DataFrame, factors: DataFrame, mode: str = "data_quality", history: DataFrame | None = None) -> DataFrame:
    """Devices without factors: index 100 and green; flags don't matter to them.

    Confidence is 1.0 if ``optimistic``, else 0.9. ``carry_forward`` with ``history`` takes the last index and
    confidence from there where there is one.
    """
    out = ids.join(factors.select("device_id").distinct(), "device_id", "left_anti")
    index, (sure, reasons) = F.lit(100), _silent(mode)
    if mode == "carry_forward" and history is not None:
        out = out.join(_last(history), "device_id", "left")
        index, sure = F.coalesce("last.health_index", index), F.coalesce("last.confidence", sure)
    return out.select("device_id", index.cast("int").alias("health_index"), sure.alias("confidence"), reasons.alias("reasons"))


def score(factors: DataFrame, ids: DataFrame, flags: DataFrame, w: Weights, history: DataFrame | None = None) -> DataFrame:
    """Every device of ``ids`` exactly once, from factors with penalties.

    ``device_id, health_index, confidence, zone, confidence_zone, contributions, reasons, snapshot`` (the profile).
    The factors are aggregated once; devices without any get what ``silent_devices`` gives them.
    """
    active = cap_critical(factors, w.critical_per_day).groupBy("device_id").agg(_total_penalty(), _contributions())
    sure = confidence(flags, w).select("device_id", F.col("confidence").alias("active_confidence"), F.col("reasons").alias("active_reasons"))
    rows = ids.join(sure, "device_id", "left").join(active, "device_id", "left")
    silent, index, (still, reasons) = F.col("total_penalty").isNull(), F.lit(100), _silent(w.silent_mode)
    if w.silent_mode == "carry_forward" and history is not None:
        rows = rows.join(_last(history), "device_id", "left")
        index, still = F.coalesce("last.health_index", index), F.coalesce("last.confidence", still)
    rows = rows.select(
        "device_id", F.when(silent, index.cast("int")).otherwise(_index("total_penalty")).alias("health_index"), F.when(silent, still).otherwise(F.col("active_confidence")).alias("confidence"),
        F.coalesce("contributions", F.array().cast(active.schema["contributions"].dataType)).alias("contributions"), F.when(silent, reasons).otherwise(F.col("active_reasons")).alias("reasons"),
    )
    return rows.select(
        "device_id", "health_index", "confidence", C.zone(F.col("health_index"), w).alias("zone"), C.confidence_zone(F.col("confidence")).alias("confidence_zone"),
        "contributions", "reasons", F.lit(json.dumps(asdict(w), sort_keys=True)).alias("snapshot"),
    )


def score_fleet(events: DataFrame, snapshots: DataFrame, devices: DataFrame, code_registry: DataFrame, overrides: DataFrame, w: Weights | None = None) -> DataFrame:
    """The whole of scoring in one plan: window, classification, factors, index, confidence and zones."""
    w = w or Weights()
    ref, ids = S.reference_time(events, snapshots), S.list_devices(events, snapshots, devices)
    factors = build_factors(events, ref, devices, code_registry, overrides, w)
    return score(factors, ids, confidence_flags(ids, snapshots, devices), w)


def rescore(raw: DataFrame, ids: DataFrame, flags: DataFrame, w: Weights) -> DataFrame:
    """Score saved raw factors under another profile; nothing is classified again."""
    return score(coefficients(raw, w).withColumn("penalty", penalty()), ids, flags, w)


def score_profiles(raw: DataFrame, ids: DataFrame, flags: DataFrame, profiles: list[Weights]) -> DataFrame:
    """Index and zone of every device under each of a few profiles: ``profile`` and the columns of ``score``."""
    parts = [rescore(raw, ids, flags, w).withColumn("profile", F.lit(w.name)) for w in profiles]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def compare_runs(before: DataFrame, after: DataFrame) -> DataFrame:
    """Devices whose index differs between two runs: ``device_id, before, after, delta``."""
    b, a = before.select("device_id", F.col("health_index").alias("before")), after.select("device_id", F.col("health_index").alias("after"))
    return b.join(a, "device_id").filter("before <> after").withColumn("delta", F.col("after") - F.col("before"))


def top_of(contribs: Column) -> Column:
    """Label of the heaviest contribution, or null."""
    return F.try_element_at(F.transform(contribs, lambda x: x["label"]), F.lit(1))
