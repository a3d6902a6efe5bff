"""Registered queries of the store, scoring and registry operators, each with its SQL."""

from __future__ import annotations

import re
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixed import Weights
from ..functions import columns as C
from ..operators import health as H
from ..operators import normalize as N
from ..operators import registry as R
from ..operators import store as S
from .model import Model, duck

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
W = Weights()
SHARP = replace(W, name="sharp", severity={"Critical": 80.0, "High": 30.0, "Medium": 10.0, "Low": 2.0, "Info": 0.0}, age_tau=7.0, silent_mode="optimistic")


def query(name: str, sql: str | None = None, **more: str):
    """Register a function of a Model under a name, with its SQL over the model's tables."""

    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(Model(spark, sf_dir))
        if sql:
            ORACLES[name] = duck(sql, **more)
        return f

    return add


us = lambda c: F.unix_micros(c)


def ref_of(m: Model) -> DataFrame:
    return S.reference_time(m.ev, N.latest_snapshot(m.snap))


def raw_factors(m: Model) -> DataFrame:
    return H.raw_factors(m.ev, ref_of(m), m.dev, m.reg, m.over, W)


def factors_of(m: Model, w: Weights = W) -> DataFrame:
    return H.coefficients(raw_factors(m), w).withColumn("penalty", H.penalty())


def ids_of(m: Model) -> DataFrame:
    return S.list_devices(m.ev, m.snap, m.dev)


def flags_of(m: Model) -> DataFrame:
    return H.confidence_flags(ids_of(m), m.snap, m.dev)


def health_of(m: Model) -> DataFrame:
    return H.score_fleet(m.ev, N.latest_snapshot(m.snap), m.dev, m.reg, m.over)


# SQL of the same steps, written on its own.
REF = {"ref": "SELECT max(ts) AS ref FROM (SELECT ts FROM ev UNION ALL SELECT ts FROM snap)"}
RECENT = REF | {"recent": "SELECT ev.*, ref, coalesce(error_code, error_description, '') AS key FROM ev, ref WHERE ts >= ref - INTERVAL 30 DAY"}
REPS = RECENT | {"reps": "SELECT device_id, error_code, count(*) AS n FROM ev, ref WHERE ts >= ref - INTERVAL 14 DAY AND error_code IS NOT NULL GROUP BY ALL"}
LATEST = REPS | {"latest": "SELECT * FROM recent QUALIFY row_number() OVER (PARTITION BY device_id, key ORDER BY ts DESC, row_no) = 1"}
CLASSED = LATEST | {
    "hits": "SELECT vendor, model_slug, code, severity, component FROM reg",
    "firsts": "SELECT model_slug, code, arg_min(severity, (vendor_order, vendor)) AS severity FROM reg GROUP BY ALL",
    "classed": """
        SELECT l.device_id, l.key AS error_code, l.ts, l.ref, d.vendor, d.model, coalesce(own.severity, firsts.severity, over.severity, 'Medium') AS severity,
          CASE WHEN own.severity IS NOT NULL OR firsts.severity IS NOT NULL THEN 'vendor_model_registry' WHEN over.severity IS NOT NULL THEN 'override' ELSE 'fallback' END AS source
        FROM latest l LEFT JOIN dev d ON l.device_id = d.device_id LEFT JOIN hits own ON own.vendor = d.vendor AND own.model_slug = lower(d.model) AND own.code = l.key
        LEFT JOIN firsts ON firsts.model_slug = lower(d.model) AND firsts.code = l.key LEFT JOIN over ON over.code = l.key""",
}
_S = "CASE {0} WHEN 'Critical' THEN {1} WHEN 'High' THEN {2} WHEN 'Medium' THEN {3} WHEN 'Low' THEN {4} ELSE {5} END"


def factor_sql(w: Weights) -> dict[str, str]:
    s = _S.format("severity", *[float(w.severity[k]) for k in ("Critical", "High", "Medium", "Low", "Info")])
    return CLASSED | {
        "counted": "SELECT c.*, greatest(coalesce(n, 0), 1) AS n, CAST(floor((epoch_us(ref) - epoch_us(c.ts)) / 86400000000) AS BIGINT) AS age_days FROM classed c LEFT JOIN reps r ON c.device_id = r.device_id AND c.error_code = r.error_code",
        "weighed": f"SELECT *, CAST({s} AS DOUBLE) AS s, least({float(w.repeat_max)}, 1 + ln(n) / ln({float(w.repeat_base)})) AS r, CAST(1.0 AS DOUBLE) AS c, exp(-age_days / {float(w.age_tau)}) AS a FROM counted",
        "factors": "SELECT *, s * r * c * a AS penalty FROM weighed",
        "capped": "SELECT * FROM factors QUALIFY severity <> 'Critical' OR row_number() OVER (PARTITION BY device_id, CAST(ts AS DATE), severity ORDER BY penalty DESC, error_code) <= 1",
        "indexed": "SELECT device_id, sum(penalty) AS total, CAST(greatest(1, round_even(100 - sum(penalty), 0)) AS INT) AS health_index FROM capped GROUP BY device_id",
    }


FACTORS = factor_sql(W)
IDS = {"ids": "SELECT device_id FROM ev UNION SELECT device_id FROM snap UNION SELECT device_id FROM dev"}
_CONF = "round(greatest(0.2, CASE WHEN ids.device_id IN (SELECT device_id FROM snap) THEN 1 ELSE 0.85 END * CASE WHEN d.model IS NULL THEN 0.6 ELSE 1 END), 4)"
_ZONE = "CASE WHEN {0} >= 75 THEN 'green' WHEN {0} >= 40 THEN 'yellow' ELSE 'red' END"


def health_sql(w: Weights) -> dict[str, str]:
    silent = 1.0 if w.silent_mode == "optimistic" else 0.9
    return factor_sql(w) | IDS | {
        "scored": f"SELECT ids.device_id, coalesce(health_index, 100) AS health_index, CAST(CASE WHEN health_index IS NULL THEN {silent} ELSE {_CONF} END AS DOUBLE) AS confidence FROM ids LEFT JOIN indexed ON ids.device_id = indexed.device_id LEFT JOIN dev d ON ids.device_id = d.device_id",
        "health": f"SELECT *, {_ZONE.format('health_index')} AS zone, CASE WHEN confidence >= 0.85 THEN 'high' WHEN confidence >= 0.6 THEN 'medium' ELSE 'low' END AS confidence_zone FROM scored",
    }


HEALTH = health_sql(W)


@query("o25_reference_time", "SELECT @us(ref) AS ref_us FROM ref", **REF)
def _(m):
    return ref_of(m).select(us("ref").alias("ref_us"))


@query("o26_events_in_window", "SELECT row_no, device_id, @us(ts) AS ts_us FROM recent", **RECENT)
def _(m):
    return S.events_in_window(m.ev, ref_of(m)).select("row_no", "device_id", us("ts").alias("ts_us"))


@query("o27_count_repetitions", "SELECT * FROM reps", **REPS)
def _(m):
    return S.count_repetitions(m.ev, ref_of(m))


@query("o28_list_devices", "SELECT * FROM ids", **IDS)
def _(m):
    return ids_of(m)


@query("o29_latest_by_code", "SELECT device_id, coalesce(error_code, error_description, '') AS key, row_no FROM ev QUALIFY row_number() OVER (PARTITION BY device_id, coalesce(error_code, error_description, '') ORDER BY ts DESC, row_no) = 1")
def _(m):
    return S.latest_by_code(m.ev).select("device_id", "key", "row_no")


@query(
    "o30_recent_events",
    """SELECT t.device_id, t.total, k.n > 50 AS truncated, t.codes AS unique_codes, s.codes AS shown
    FROM (SELECT device_id, count(*) AS total, coalesce(string_agg(DISTINCT error_code, ',' ORDER BY error_code), '') AS codes FROM recent GROUP BY device_id) t
    JOIN (SELECT device_id, count(*) AS n FROM kept GROUP BY device_id) k ON t.device_id = k.device_id
    JOIN (SELECT device_id, string_agg(coalesce(error_code, '-'), ',' ORDER BY place) AS codes FROM shown GROUP BY device_id) s ON t.device_id = s.device_id""",
    **RECENT,
    kept="SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY device_id, key ORDER BY ts DESC, row_no) AS nth FROM recent) WHERE nth = 1 OR (key = '' AND nth <= 10)",
    shown="SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY ts DESC, row_no) AS place FROM kept QUALIFY place <= 50",
)
def _(m):
    shown = F.array_join(F.transform("events", lambda e: F.coalesce(e["code"], F.lit("-"))), ",")
    return S.recent_events(m.ev, ref_of(m)).select("device_id", "total", "truncated", F.array_join("unique_codes", ",").alias("unique_codes"), shown.alias("shown"))


@query(
    "o31_device_dossier",
    """SELECT h.device_id, h.health_index, h.zone, lines.timeline, CASE WHEN s.device_id IS NOT NULL THEN concat_ws(', ', 'toner=' || s.toner_level, 'drum=' || s.drum_level, 'fuser=' || s.fuser_level, 'mileage=' || s.mileage) END AS resources, coalesce(tops.top_factors, '') AS top_factors
    FROM health h LEFT JOIN lines ON h.device_id = lines.device_id LEFT JOIN last s ON h.device_id = s.device_id LEFT JOIN tops ON h.device_id = tops.device_id""",
    **HEALTH,
    last="SELECT * FROM snap QUALIFY row_number() OVER (PARTITION BY device_id ORDER BY ts DESC, row_no) = 1",
    lines="SELECT device_id, string_agg(strftime(ts, '%Y-%m-%d %H:%M') || ' ' || coalesce(error_code, '-') || ' ' || coalesce(error_description, ''), '|' ORDER BY ts DESC, row_no) AS timeline FROM (SELECT * FROM ev QUALIFY row_number() OVER (PARTITION BY device_id ORDER BY ts DESC, row_no) <= 20) GROUP BY device_id",
    tops="SELECT device_id, string_agg(error_code || ' (' || severity || ')', '|' ORDER BY penalty DESC, error_code) AS top_factors FROM (SELECT * FROM capped QUALIFY row_number() OVER (PARTITION BY device_id ORDER BY penalty DESC, error_code) <= 3) GROUP BY device_id",
)
def _(m):
    out = S.device_dossier(m.ev, N.latest_snapshot(m.snap), health_of(m))
    return out.select("device_id", "health_index", "zone", F.array_join("timeline", "|").alias("timeline"), "resources", F.coalesce(F.array_join("top_factors", "|"), F.lit("")).alias("top_factors"))


@query("o32_classify", "SELECT device_id, error_code, severity, source FROM classed", **CLASSED)
def _(m):
    return raw_factors(m).select("device_id", "error_code", "severity", "source")


@query(
    "o33_coerce_severity",
    "SELECT word, count(*) AS n, max(CASE lower(trim(word)) WHEN 'critical' THEN 'Critical' WHEN 'high' THEN 'High' WHEN 'major' THEN 'High' WHEN 'medium' THEN 'Medium' WHEN 'warning' THEN 'Medium' WHEN 'minor' THEN 'Low' WHEN 'low' THEN 'Low' WHEN 'info' THEN 'Info' END) AS severity FROM words GROUP BY word",
    words="SELECT CASE k % 9 WHEN 0 THEN 'CRITICAL' WHEN 1 THEN ' high' WHEN 2 THEN 'Major' WHEN 3 THEN 'minor ' WHEN 4 THEN 'Warning' WHEN 5 THEN 'info' WHEN 6 THEN 'severe' WHEN 7 THEN '' ELSE 'low' END AS word FROM base",
)
def _(m):
    words = m.sql("SELECT CASE k % 9 WHEN 0 THEN 'CRITICAL' WHEN 1 THEN ' high' WHEN 2 THEN 'Major' WHEN 3 THEN 'minor ' WHEN 4 THEN 'Warning' WHEN 5 THEN 'info' WHEN 6 THEN 'severe' WHEN 7 THEN '' ELSE 'low' END AS word FROM base")
    return words.groupBy("word").agg(F.count("*").alias("n")).withColumn("severity", C.coerce_severity(F.col("word")))


CODE_ROWS = "SELECT event_id AS row_no, CASE WHEN k % 12 = 0 THEN ' ' ELSE 'c' || lpad(CAST(k AS STRING), 4, '0') END AS code, CASE WHEN event_id % 5 = 0 THEN '' ELSE 'text ' || CAST(event_id AS STRING) END AS description, CASE event_id % 4 WHEN 0 THEN 'major' WHEN 1 THEN 'LOW' WHEN 2 THEN 'info' ELSE 'odd' END AS severity, CAST(NULL AS STRING) AS component, CAST(NULL AS STRING) AS notes FROM base WHERE event_type = 'error'"


@query(
    "o34_load_registry",
    """SELECT 'loaded' AS kind, upper(code) AS code, description AS detail FROM (SELECT * FROM rows WHERE trim(code) <> '' AND description <> '' AND severity <> 'odd' QUALIFY row_number() OVER (PARTITION BY code ORDER BY row_no DESC) = 1)
    UNION ALL SELECT 'rejected', upper(code), CASE WHEN description = '' THEN 'no description' ELSE 'unknown severity' END || ' ' || row_no FROM rows WHERE trim(code) <> '' AND (description = '' OR severity = 'odd')""",
    rows=CODE_ROWS,
)
def _(m):
    good, bad = R.load_registry(m.sql(CODE_ROWS), "acme", "one")
    return good.select(F.lit("loaded").alias("kind"), "code", F.col("description").alias("detail")).unionByName(bad.select(F.lit("rejected").alias("kind"), "code", F.concat_ws(" ", "reason", F.col("row_no").cast("string")).alias("detail")))


@query("o35_slugs", "SELECT device_id, lower(replace(vendor, ' ', '_')) AS vendor_slug, coalesce(lower(model), 'unknown') AS model_slug FROM dev")
def _(m):
    return R.slugs(m.dev, m.alias).select("device_id", "vendor_slug", "model_slug")


INCOMING = "SELECT vendor, model, code, 'new ' || description AS description, severity, component, notes FROM reg WHERE vendor = 'ASIA' AND code LIKE '%0'"
NOW = "SELECT vendor, model, code, description, severity, component, notes FROM reg"


@query("o36_merge_registry", "SELECT 'upsert' AS kind, vendor, model, code, coalesce(i.description, r.description) AS description FROM now r LEFT JOIN inc i USING (vendor, model, code) UNION ALL SELECT 'replace', vendor, model, code, description FROM (SELECT * FROM inc UNION ALL SELECT * FROM now WHERE (vendor, model) NOT IN (SELECT (vendor, model) FROM inc))", inc=INCOMING, now=NOW)
def _(m):
    now, inc = m.sql(NOW), m.sql(INCOMING)
    parts = [R.merge_registry(now, inc, r).select(F.lit("replace" if r else "upsert").alias("kind"), "vendor", "model", "code", "description") for r in (False, True)]
    return parts[0].unionByName(parts[1])


@query(
    "o37_find_conflicts",
    """SELECT a.vendor, a.code, a.model AS model_a, b.model AS model_b, f.field, CASE f.field WHEN 'severity' THEN a.severity WHEN 'description' THEN a.description ELSE a.component END AS value_a, CASE f.field WHEN 'severity' THEN b.severity WHEN 'description' THEN b.description ELSE b.component END AS value_b
    FROM reg a JOIN reg b ON a.vendor = b.vendor AND a.code = b.code AND a.model < b.model, (VALUES ('severity'), ('description'), ('component')) f(field)
    WHERE CASE f.field WHEN 'severity' THEN a.severity IS DISTINCT FROM b.severity WHEN 'description' THEN a.description IS DISTINCT FROM b.description ELSE a.component IS DISTINCT FROM b.component END""",
)
def _(m):
    return R.find_conflicts(m.reg)


@query("o38_sync_models", "SELECT r.vendor, r.model, r.code, coalesce(s.severity, r.severity) AS severity FROM reg r LEFT JOIN reg s ON s.vendor = 'ASIA' AND s.model = 'MACHINERY' AND r.vendor = 'ASIA' AND s.code = r.code")
def _(m):
    return R.sync_models(m.sql(NOW), "ASIA", "MACHINERY")[0].select("vendor", "model", "code", "severity")


@query(
    "o38_sync_models_affected",
    "SELECT r.model, count(*) AS changed FROM reg r JOIN reg s ON s.vendor = 'ASIA' AND s.model = 'MACHINERY' AND r.vendor = 'ASIA' AND s.code = r.code WHERE (r.description, r.severity, r.component, r.notes) IS DISTINCT FROM (s.description, s.severity, s.component, s.notes) GROUP BY r.model",
)
def _(m):
    return R.sync_models(m.sql(NOW), "ASIA", "MACHINERY")[1]


CHANGES = """SELECT DISTINCT CASE k % 5 WHEN 0 THEN 'New ' || model WHEN 1 THEN 'the ' || lower(model) WHEN 2 THEN lower(model) WHEN 3 THEN ' ' ELSE 'gone ' || model END AS alias,
  CASE WHEN k % 7 = 0 THEN 'BUILDING' WHEN k % 11 = 0 THEN 'NOBODY' ELSE model END AS canonical, CASE WHEN k % 2 = 0 THEN 'add' ELSE 'remove' END AS kind, k % 3 = 0 AS force
  FROM base JOIN dev ON base.device_id = dev.device_id WHERE model IS NOT NULL"""


@query(
    "o39_alias_actions",
    """SELECT DISTINCT alias, canonical, kind, previous, CASE WHEN kind = 'add' THEN CASE WHEN alias = '' OR NOT known THEN 'invalid' WHEN previous = canonical THEN 'noop' WHEN previous IS NULL THEN 'added' WHEN force THEN 'reassigned' ELSE 'conflict' END
      ELSE CASE WHEN head THEN 'refused' WHEN previous IS NULL THEN 'noop' ELSE 'removed' END END AS action
    FROM (SELECT lower(trim(c.alias)) AS alias, c.canonical, c.kind, c.force, (SELECT max(canonical) FROM alias a WHERE a.alias = lower(trim(c.alias))) AS previous, lower(trim(c.alias)) IN (SELECT lower(canonical) FROM alias) AS head, c.canonical IN (SELECT canonical FROM alias) AS known FROM changes c)""",
    changes=CHANGES,
)
def _(m):
    return R.alias_apply(m.alias, m.sql(CHANGES))[1].distinct()


@query("o40_models_by_slug", "SELECT lower(canonical) AS slug, canonical || '|' || string_agg(alias, '|' ORDER BY length(alias), alias) AS names FROM alias GROUP BY canonical")
def _(m):
    return R.models_by_slug(m.alias).select("slug", F.array_join("names", "|").alias("names"))


@query("o41_registry_documents", "SELECT substr(sha256(vendor || '|' || model || '|' || code), 1, 32) AS chunk_id, code, concat_ws(' ', code, '(' || severity || ')', description, component, notes) AS text FROM reg")
def _(m):
    return R.registry_documents(m.reg).select("chunk_id", F.col("error_codes")[0].alias("code"), "text")


@query("o41_registry_counts", "SELECT vendor, count(*) AS codes, count(DISTINCT model) AS models FROM reg GROUP BY vendor")
def _(m):
    return R.registry_counts(m.reg)


@query("o42_o46_coefficients", "SELECT device_id, error_code, round(s, 6) AS s, round(r, 6) AS r, c, age_days, round(a, 6) AS a FROM factors", **FACTORS)
def _(m):
    return factors_of(m).select("device_id", "error_code", F.round("s", 6).alias("s"), F.round("r", 6).alias("r"), "c", "age_days", F.round("a", 6).alias("a"))


MODS = "list_filter([CASE WHEN toner_level < 10 AND component IN ('print', 'quality') THEN 1.5 END, CASE WHEN drum_level > 90 AND component = 'quality' THEN 1.3 END, CASE WHEN fuser_level > 90 AND component IN ('fusing', 'jam') THEN 1.5 END, CASE WHEN mileage > service_interval THEN 1.2 END], lambda x: x IS NOT NULL)"


@query(
    "o45_context_modifiers",
    f"SELECT device_id, error_code, len({MODS}) AS n_modifiers, CAST(round(least(1.5, coalesce(list_product({MODS}), 1)), 6) AS DOUBLE) AS c FROM joined",
    **CLASSED,
    last="SELECT * FROM snap QUALIFY row_number() OVER (PARTITION BY device_id ORDER BY ts DESC, row_no) = 1",
    joined="SELECT c.device_id, c.error_code, coalesce(own.component, f.component) AS component, s.toner_level, s.drum_level, s.fuser_level, s.mileage, s.service_interval FROM classed c LEFT JOIN reg own ON own.vendor = c.vendor AND own.model_slug = lower(c.model) AND own.code = c.error_code LEFT JOIN (SELECT model_slug, code, arg_min(component, (vendor_order, vendor)) AS component FROM reg GROUP BY ALL) f ON f.model_slug = lower(c.model) AND f.code = c.error_code LEFT JOIN last s ON s.device_id = c.device_id",
)
def _(m):
    out = H.coefficients(H.context_modifiers(raw_factors(m).drop("multipliers"), N.latest_snapshot(m.snap), W), W)
    return out.select("device_id", "error_code", F.size("multipliers").cast("long").alias("n_modifiers"), F.round("c", 6).alias("c"))


@query("o47_build_factors", "SELECT device_id, error_code, severity, n, round(penalty, 6) AS penalty FROM factors", **FACTORS)
def _(m):
    return factors_of(m).select("device_id", "error_code", "severity", "n", F.round("penalty", 6).alias("penalty"))


@query("o48_cap_critical", "SELECT device_id, error_code, severity FROM capped", **FACTORS)
def _(m):
    return H.cap_critical(factors_of(m)).select("device_id", "error_code", "severity")


@query("o49_contributions", "SELECT device_id, count(*) AS n, string_agg(error_code || ' (' || severity || ')', '|' ORDER BY penalty DESC, error_code || ' (' || severity || ')') AS labels FROM capped GROUP BY device_id", **FACTORS)
def _(m):
    out = H.contributions(H.cap_critical(factors_of(m)))
    return out.select("device_id", F.size("contributions").cast("long").alias("n"), F.array_join(F.transform("contributions", lambda c: c["label"]), "|").alias("labels"))


@query("o50_health_index", "SELECT device_id, round(total, 6) AS total_penalty, health_index FROM indexed", **FACTORS)
def _(m):
    return H.health_index(H.cap_critical(factors_of(m))).select("device_id", F.round("total_penalty", 6).alias("total_penalty"), "health_index")


@query(
    "o51_confidence",
    "SELECT ids.device_id, round(greatest(0.2, CASE WHEN u.n > 0 THEN pow(0.7, u.n) ELSE 1 END * CASE WHEN ids.device_id IN (SELECT device_id FROM snap) THEN 1 ELSE 0.85 END * CASE WHEN d.model IS NULL THEN 0.6 ELSE 1 END), 4) AS confidence, (CASE WHEN u.n > 0 THEN 1 ELSE 0 END + CASE WHEN ids.device_id IN (SELECT device_id FROM snap) THEN 0 ELSE 1 END + CASE WHEN d.model IS NULL THEN 1 ELSE 0 END)::BIGINT AS reasons FROM ids LEFT JOIN dev d ON ids.device_id = d.device_id LEFT JOIN (SELECT device_id, count(*) AS n FROM classed WHERE source = 'fallback' GROUP BY device_id) u ON u.device_id = ids.device_id",
    **CLASSED, **IDS,
)
def _(m):
    flags = H.confidence_flags(ids_of(m), m.snap, m.dev, raw_factors(m))
    return H.confidence(flags, W).select("device_id", "confidence", F.size("reasons").cast("long").alias("reasons"))


@query("o52_confidence_flags", "SELECT ids.device_id, ids.device_id NOT IN (SELECT device_id FROM snap) AS missing_resources, d.model IS NULL AS missing_model FROM ids LEFT JOIN dev d ON ids.device_id = d.device_id", **IDS)
def _(m):
    return flags_of(m).select("device_id", "missing_resources", "missing_model")


@query("o53_zones", "SELECT device_id, zone, confidence_zone FROM health", **HEALTH)
def _(m):
    return health_of(m).select("device_id", "zone", "confidence_zone")


PAST = "SELECT 'DEV-' || CAST(user_id AS STRING) AS device_id, max(ts) AS calculated_at, 55 AS health_index, CAST(0.7 AS DOUBLE) AS confidence FROM base WHERE user_id % 2 = 0 GROUP BY user_id UNION ALL SELECT device_id, TIMESTAMP '2020-01-01 00:00:00', 33, CAST(0.5 AS DOUBLE) FROM dev"


@query("o54_silent_devices", "SELECT ids.device_id, coalesce(arg_max(p.health_index, p.calculated_at), 100) AS health_index, coalesce(arg_max(p.confidence, p.calculated_at), 0.9) AS confidence FROM ids LEFT JOIN past p ON p.device_id = ids.device_id WHERE ids.device_id NOT IN (SELECT device_id FROM recent) GROUP BY ids.device_id", **RECENT, **IDS, past=PAST)
def _(m):
    return H.silent_devices(ids_of(m), raw_factors(m), "carry_forward", m.sql(PAST)).select("device_id", "health_index", "confidence")


@query("o55_score_fleet", "SELECT device_id, health_index, confidence, zone FROM health", **HEALTH)
def score_fleet(m):
    return health_of(m).select("device_id", "health_index", "confidence", "zone")


@query("o56_rescore", "SELECT device_id, health_index, confidence, zone FROM health", **health_sql(SHARP))
def _(m):
    return H.rescore(raw_factors(m), ids_of(m), flags_of(m), SHARP).select("device_id", "health_index", "confidence", "zone")


def beside(ctes: dict[str, str], suffix: str) -> dict[str, str]:
    """The same SQL with what depends on the profile under other names."""
    own = ("weighed", "factors", "capped", "indexed", "scored", "health")
    return {f"{n}{suffix}": re.sub(rf"\b(FROM|JOIN) ({'|'.join(own)})\b", rf"\1 \2{suffix}", ctes[n]).replace("indexed.", f"indexed{suffix}.") for n in own}


@query(
    "o57_score_profiles",
    f"SELECT 'sharp' AS profile, zone, count(*) AS devices FROM health GROUP BY zone UNION ALL SELECT '{W.name}', zone, count(*) FROM health_w GROUP BY zone",
    **health_sql(SHARP), **beside(health_sql(W), "_w"),
)
def _(m):
    return H.score_profiles(raw_factors(m), ids_of(m), flags_of(m), [W, SHARP]).groupBy("profile", "zone").agg(F.count("*").alias("devices"))


@query(
    "o58_compare_runs",
    "SELECT a.device_id, a.health_index AS before, b.health_index AS after, b.health_index - a.health_index AS delta FROM indexed a JOIN sharp b ON a.device_id = b.device_id WHERE a.health_index <> b.health_index",
    **FACTORS,
    s_weighed=f"SELECT *, CAST({_S.format('severity', 80.0, 30.0, 10.0, 2.0, 0.0)} AS DOUBLE) * least(5.0, 1 + ln(n) / ln(2.0)) * exp(-age_days / 7.0) AS penalty FROM counted",
    s_capped="SELECT * FROM s_weighed QUALIFY severity <> 'Critical' OR row_number() OVER (PARTITION BY device_id, CAST(ts AS DATE), severity ORDER BY penalty DESC, error_code) <= 1",
    sharp="SELECT device_id, CAST(greatest(1, round_even(100 - sum(penalty), 0)) AS INT) AS health_index FROM s_capped GROUP BY device_id",
)
def _(m):
    raw, ids, flags = raw_factors(m), ids_of(m), flags_of(m)
    return H.compare_runs(H.rescore(raw, ids, flags, W), H.rescore(raw, ids, flags, SHARP))
