"""Registered queries of the fleet statistics, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import fleet_stats as A
from ..operators import normalize as N
from ..operators import registry as R
from .ingest import folder
from .model import Model, duck
from .scoring import HEALTH, RECENT, health_of, ref_of

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


def health_once(m: Model) -> DataFrame:
    """The scored fleet, written once for queries that read it several times."""
    at = f"{folder(m)}/health"
    health_of(m).write.parquet(at)
    return m.spark.read.parquet(at)


SUMMARY = "count(*) AS devices, round(avg(health_index), 6) AS average_index, round(median(health_index), 6) AS median_index, count(*) FILTER (zone = 'green') AS green_count, count(*) FILTER (zone = 'yellow') AS yellow_count, count(*) FILTER (zone = 'red') AS red_count, round(avg(confidence), 6) AS average_confidence"
LABELS = HEALTH | {"labels_": "SELECT device_id, error_code, severity, source, error_code || ' (' || severity || ')' AS label, penalty FROM capped"}
RUNS = "SELECT device_id, CAST(ts AS DATE) AS calculated_at, CAST(min(k) AS INT) AS health_index, CAST(0.5 AS DOUBLE) AS confidence FROM base GROUP BY ALL"


@query("o59_fleet_summary", f"SELECT {SUMMARY} FROM health", **HEALTH)
def _(m):
    return A.fleet_summary(health_of(m))


@query("o60_delta_vs_previous", "SELECT CAST(calculated_at AS STRING) AS run, a AS average_index, round(a - lag(a) OVER (ORDER BY calculated_at), 6) AS delta FROM (SELECT calculated_at, round(avg(health_index), 6) AS a FROM runs GROUP BY calculated_at)", runs=RUNS)
def _(m):
    return A.delta_vs_previous(m.sql(RUNS)).select(F.col("calculated_at").cast("string").alias("run"), "average_index", "delta")


@query(
    "o61_fleet_statistics",
    """SELECT CASE WHEN grouping(model) = 0 THEN model END AS model, CASE WHEN grouping(location) = 0 THEN location END AS location, CASE WHEN grouping(model) = 0 THEN 'model' WHEN grouping(location) = 0 THEN 'location' ELSE 'all' END AS level, count(*) AS devices, round(avg(health_index), 6) AS average_index
    FROM (SELECT coalesce(d.model, 'unknown') AS model, coalesce(d.location, 'unknown') AS location, health_index FROM health h LEFT JOIN dev d ON h.device_id = d.device_id WHERE d.location IS NULL OR lower(d.location) LIKE '%an%') GROUP BY GROUPING SETS ((), (model), (location))""",
    **HEALTH,
)
def _(m):
    return A.fleet_statistics(health_of(m), m.dev, location="AN").select("model", "location", "level", "devices", "average_index")


@query("o62_index_distribution", "SELECT CAST(b AS INT) AS bin, CAST(b * 10 AS INT) AS low, CAST(CASE WHEN b = 9 THEN 100 ELSE b * 10 + 9 END AS INT) AS high, (SELECT count(*) FROM health WHERE least(health_index // 10, 9) = b) AS devices FROM range(10) r(b)", **HEALTH)
def _(m):
    return A.index_distribution(health_of(m))


@query("o63_category_breakdown", f"SELECT 'model' AS category, coalesce(d.model, 'unknown') AS value, {SUMMARY} FROM health h LEFT JOIN dev d ON h.device_id = d.device_id GROUP BY coalesce(d.model, 'unknown')", **HEALTH)
def _(m):
    return A.category_breakdown(health_of(m), m.dev)


CARDS = LABELS | {
    "last": "SELECT * FROM snap QUALIFY row_number() OVER (PARTITION BY device_id ORDER BY ts DESC, row_no) = 1",
    "tops": "SELECT device_id, arg_max(label, penalty) AS top_problem, string_agg(label, '|' ORDER BY penalty DESC, label) AS top_factors FROM (SELECT * FROM labels_ QUALIFY row_number() OVER (PARTITION BY device_id ORDER BY penalty DESC, label) <= 3) GROUP BY device_id",
    "cards": "SELECT h.device_id, h.health_index, h.zone, h.confidence, d.model, d.location, s.toner_level, s.mileage, coalesce(t.top_factors, '') AS top_factors, h.confidence_zone = 'low' AS needs_review FROM health h LEFT JOIN dev d ON h.device_id = d.device_id LEFT JOIN last s ON h.device_id = s.device_id LEFT JOIN tops t ON h.device_id = t.device_id",
}


def cards_of(m: Model, health: DataFrame | None = None):
    return A.device_cards(health or health_of(m), m.dev, N.latest_snapshot(m.snap))


@query("o64_device_cards", "SELECT * FROM cards", **CARDS)
def _(m):
    return cards_of(m).select("device_id", "health_index", "zone", "confidence", "model", "location", "toner_level", "mileage", F.array_join("top_factors", "|").alias("top_factors"), "needs_review")


@query("o65_red_zone", "SELECT device_id, health_index, confidence, model, location, top_factors FROM cards WHERE zone = 'red' ORDER BY health_index, device_id LIMIT 20", **CARDS)
def _(m):
    return A.red_zone(cards_of(m)).withColumn("top_factors", F.array_join("top_factors", "|"))


@query("o66_worst_devices", "SELECT device_id, health_index, zone FROM health ORDER BY health_index, device_id LIMIT 5", **HEALTH)
def _(m):
    return A.worst_devices(health_of(m))


@query("o66_frequent_problems", "SELECT label, count(*) AS devices FROM labels_ GROUP BY label ORDER BY devices DESC, label LIMIT 5", **LABELS)
def _(m):
    return A.frequent_problems(health_of(m))


MASS = LABELS | {
    "mass_": "SELECT error_code, count(DISTINCT device_id) AS devices, count(*) AS occurrences, min(severity) AS severity FROM labels_ GROUP BY error_code ORDER BY devices DESC, error_code LIMIT 10",
    "mass": "SELECT m.*, coalesce(e.n, 0) AS events, coalesce(e.texts, '') AS descriptions FROM mass_ m LEFT JOIN (SELECT error_code, count(*) AS n, array_to_string(list_sort(list(DISTINCT error_description))[1:3], '|') AS texts FROM ev GROUP BY error_code) e ON e.error_code = m.error_code",
}


def mass_of(m: Model, health: DataFrame | None = None):
    return A.mass_errors(health or health_of(m), m.ev)


@query("o67_mass_errors", "SELECT error_code, devices, occurrences, events, severity, descriptions FROM mass", **MASS)
def _(m):
    return mass_of(m).withColumn("descriptions", F.array_join("descriptions", "|"))


@query("o68_mass_scale", "SELECT error_code, devices, CAST(100 * devices // (SELECT count(*) FROM health) AS INT) AS share_percent, round(events / devices, 6) AS events_per_device, CASE WHEN 100 * devices // (SELECT count(*) FROM health) >= 20 THEN 'fleet-wide' WHEN 100 * devices // (SELECT count(*) FROM health) >= 5 THEN 'significant' ELSE 'isolated' END AS scale FROM mass", **MASS)
def _(m):
    health = health_once(m)
    return A.mass_scale(mass_of(m, health), health.select("device_id"))


_RANK = "CASE {0} WHEN 'Critical' THEN 1 WHEN 'High' THEN 2 WHEN 'Medium' THEN 3 WHEN 'Low' THEN 4 WHEN 'Info' THEN 5 ELSE 9 END"


@query("o69_list_mass_errors", f"SELECT m.error_code, devices, coalesce(r.severity, 'unknown') AS severity FROM mass m LEFT JOIN (SELECT code, arg_min(severity, {_RANK.format('severity')}) AS severity FROM reg GROUP BY code) r ON r.code = m.error_code", **MASS)
def _(m):
    return A.list_mass_errors(mass_of(m), R.registry_documents(m.reg))


ASKING = {"asking": "SELECT device_id FROM (SELECT device_id FROM ev UNION SELECT device_id FROM dev) AS known WHERE CAST(substr(device_id, 5) AS INT) % 50 = 0"}


def asking(m: Model):
    """Every device whose number is divisible by 50."""
    return m.sql(ASKING["asking"])


@query(
    "o70_similar_devices",
    """SELECT device_id, other_id, score, coalesce(codes, '') AS shared_codes FROM (SELECT p.device_id, p.other_id, round(sum(p.score), 3) AS score, max(p.codes) AS codes FROM pairs p GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY device_id ORDER BY score DESC, other_id) <= 20""",
    **RECENT, **ASKING,
    codes="SELECT DISTINCT device_id, error_code FROM recent WHERE error_code IS NOT NULL",
    sizes="SELECT device_id, count(*) AS size FROM codes GROUP BY device_id",
    shared="SELECT a.device_id, b.device_id AS other_id, count(*) AS n, string_agg(a.error_code, ',' ORDER BY a.error_code) AS codes FROM codes a JOIN asking USING (device_id) JOIN codes b ON a.error_code = b.error_code AND a.device_id <> b.device_id GROUP BY ALL",
    pairs="SELECT s.device_id, s.other_id, n / (a.size + b.size - n) AS score, codes FROM shared s JOIN sizes a ON a.device_id = s.device_id JOIN sizes b ON b.device_id = s.other_id UNION ALL SELECT a.device_id, b.device_id, 0.5, NULL FROM dev a JOIN asking USING (device_id) JOIN dev b ON a.model = b.model AND a.device_id <> b.device_id",
)
def _(m):
    return A.similar_devices(m.ev, ref_of(m), m.dev, asking(m)).withColumn("shared_codes", F.array_join("shared_codes", ","))


@query("o70_similar_by_location", "SELECT a.device_id, b.device_id AS other_id, CAST(1.0 AS DOUBLE) AS score FROM dev a JOIN asking USING (device_id) JOIN dev b ON a.location = b.location AND a.device_id <> b.device_id QUALIFY row_number() OVER (PARTITION BY a.device_id ORDER BY b.device_id) <= 20", **ASKING)
def _(m):
    return A.similar_devices(m.ev, ref_of(m), m.dev, asking(m), "location").select("device_id", "other_id", "score")


@query("o71_device_history", "SELECT device_id, CAST(calculated_at AS STRING) AS run, health_index FROM runs QUALIFY row_number() OVER (PARTITION BY device_id ORDER BY calculated_at DESC) <= 10", runs=RUNS)
def _(m):
    return A.device_history(m.sql(RUNS)).select("device_id", F.col("calculated_at").cast("string").alias("run"), "health_index")


@query("o71_daily_jump", "SELECT device_id, CAST(calculated_at AS STRING) AS run, health_index, health_index - lag(health_index) OVER w AS change, coalesce(abs(health_index - lag(health_index) OVER w) > 30, FALSE) AS abnormal_daily_jump FROM runs WINDOW w AS (PARTITION BY device_id ORDER BY calculated_at)", runs=RUNS)
def _(m):
    return A.daily_jump(m.sql(RUNS)).withColumnRenamed("calculated_at", "run").withColumn("run", F.col("run").cast("string"))


MINED = LABELS | {"mined": "SELECT source AS scope, 'factor ' || label AS observation, count(*) AS devices, array_to_string(list_sort(list(device_id))[1:10], ',') AS evidence FROM (SELECT DISTINCT device_id, label, source FROM labels_) GROUP BY ALL HAVING count(*) >= 2"}


@query("o72_mine_patterns", "SELECT * FROM mined", **MINED)
def _(m):
    return A.mine_patterns(health_of(m)).withColumn("evidence", F.array_join("evidence", ","))


OLD = "SELECT DISTINCT CASE WHEN k % 2 = 0 THEN 'fleet' ELSE 'model' END AS scope, 'seen ' || CAST(k % 60 AS STRING) AS observation, device_id FROM base WHERE k % 3 > 0"
NEW = "SELECT DISTINCT CASE WHEN k % 2 = 0 THEN 'fleet' ELSE 'vendor' END AS scope, 'seen ' || CAST(k % 70 AS STRING) AS observation, device_id FROM base WHERE k % 3 = 0"


@query(
    "o72_merge_patterns",
    "SELECT scope, observation, array_to_string(evidence[1:50], ',') AS evidence FROM (SELECT scope, observation, list_sort(list(DISTINCT device_id)) AS evidence FROM (SELECT * FROM old UNION ALL SELECT * FROM new) GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY scope ORDER BY least(len(evidence), 50) DESC, observation) <= 50",
    old=OLD, new=NEW,
)
def _(m):
    gathered = [m.sql(q).select("scope", "observation", F.array("device_id").alias("evidence")) for q in (OLD, NEW)]
    return A.merge_patterns(*gathered).withColumn("evidence", F.array_join("evidence", ","))


@query("o72_get_patterns", "SELECT scope, observation, count(*) AS devices FROM old WHERE scope IN ('model', 'fleet') GROUP BY ALL", old=OLD)
def _(m):
    return A.get_patterns(m.sql(OLD).groupBy("scope", "observation").agg(F.count("*").alias("devices")), "model")


TRACES = "SELECT device_id, k AS tool_calls, k % 7 AS llm_calls, 1 + k % 3 AS attempts, k = 13 AS flagged FROM base"


@query("o73_trace_summary", "SELECT count(*) AS runs, round(avg(tool_calls), 6) AS mean_tool_calls, round(avg(llm_calls), 6) AS mean_llm_calls, count(*) FILTER (attempts > 1) AS restarts, count(DISTINCT device_id) FILTER (flagged) AS n_flagged FROM traces", traces=TRACES)
def _(m):
    return A.trace_summary(m.sql(TRACES))


@query("o73_flagged_devices", "SELECT device_id, count(*) AS runs FROM traces WHERE flagged GROUP BY device_id", traces=TRACES)
def _(m):
    return A.flagged_devices(m.sql(TRACES))


@query("o74_report_summary", "SELECT (SELECT count(*) FROM cards) AS devices, (SELECT count(*) FROM cards WHERE zone = 'red') AS red_zone, (SELECT round(avg(health_index), 6) FROM cards) AS average_index, (SELECT string_agg(device_id, ',' ORDER BY health_index, device_id) FROM (SELECT * FROM cards WHERE zone = 'red' ORDER BY health_index, device_id LIMIT 5)) AS worst_red, (SELECT count(*) FROM mass) AS mass_codes", **(CARDS | MASS))
def _(m):
    health = health_once(m)
    return A.report_summary(cards_of(m, health), mass_of(m, health))


@query(
    "o75_build_report",
    """SELECT 'summary' AS part, 'average_index' AS item, round(avg(health_index), 6)::DOUBLE AS value FROM health UNION ALL SELECT 'summary', 'red_count', count(*) FILTER (zone = 'red') FROM health
    UNION ALL SELECT 'distribution', CAST(b AS STRING), (SELECT count(*) FROM health WHERE least(health_index // 10, 9) = b) FROM range(10) r(b)
    UNION ALL SELECT 'breakdown', coalesce(d.model, 'unknown'), count(*) FROM health h LEFT JOIN dev d ON h.device_id = d.device_id GROUP BY coalesce(d.model, 'unknown')
    UNION ALL SELECT 'cards', device_id, health_index FROM health UNION ALL SELECT 'mass_errors', error_code, devices FROM mass
    UNION ALL SELECT 'worst', device_id, health_index FROM (SELECT * FROM health ORDER BY health_index, device_id LIMIT 5) UNION ALL SELECT 'red_zone', device_id, health_index FROM (SELECT * FROM health WHERE zone = 'red' ORDER BY health_index, device_id LIMIT 20)
    UNION ALL SELECT 'problems', label, n FROM (SELECT label, count(*) AS n FROM labels_ GROUP BY label ORDER BY n DESC, label LIMIT 5)""",
    **MASS,
)
def _(m):
    report = A.build_report(health_once(m), m.ev, m.dev, N.latest_snapshot(m.snap))
    items = [
        ("summary", "'average_index'", "average_index"), ("summary", "'red_count'", "red_count"), ("distribution", "bin", "devices"), ("breakdown", "value", "devices"), ("cards", "device_id", "health_index"),
        ("mass_errors", "error_code", "devices"), ("worst", "device_id", "health_index"), ("red_zone", "device_id", "health_index"), ("problems", "label", "devices"),
    ]
    parts = [report[p].selectExpr(f"'{p}' AS part", f"CAST({item} AS STRING) AS item", f"CAST({value} AS DOUBLE) AS value") for p, item, value in items]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
