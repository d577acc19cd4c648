"""Queries on evaluation, calibrated scores, messages and redaction, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions.exprs import severity
from tidewatch.operators import evaluation, records, scoring, serving
from tidewatch.plans.core import FUSE_SQL, LEVEL, rounded, window_features
from tidewatch.plans.lifecycle import ENRICHED_SQL, R, enriched
from tidewatch.sources import adapters
from tidewatch.sources.adapters import EVIDENCE_SQL, table

QUERIES, ORACLES = {}, {}
FROM = 1705276800


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _profile_sql(names: list[str]) -> str:
    parts = [k for k in names if k in scoring.WEIGHTS]
    w = " + ".join(f"CASE WHEN {k} IS NULL THEN 0 ELSE {scoring.WEIGHTS[k]} END" for k in parts)
    s = " + ".join(f"coalesce({k} * {scoring.WEIGHTS[k]}, 0)" for k in parts)
    raw = f"coalesce(({s}) / nullif({w}, 0), 0)" + (" * (1 - 0.35 * coalesce(legitimate, 0))" if "legitimate_event_score" in names else "")
    return f"round_even(least(1.0, greatest(0.0, CASE WHEN coalesce(market_score, 0) < 0.35 THEN least(0.59, {raw}) ELSE {raw} END)), 6)"


@query(f"""WITH {ENRICHED_SQL},
p AS ({' UNION ALL '.join(f"SELECT {i} AS step, '{k}' AS profile, window_start AS t, {_profile_sql(v)} AS score, confidence, n_missing, market_data_freshness_seconds AS fresh, (5 + trade_count * 37 % 11) * 1000.0 AS ms FROM fu" for i, (k, v) in enumerate(evaluation.PROFILES.items()))}),
l AS (SELECT *, {LEVEL('score')} AS level, row_number() OVER (PARTITION BY step ORDER BY ms) - 1 AS place, count(*) OVER (PARTITION BY step) AS n FROM p),
m AS (
  SELECT step, profile, count(*) AS observations, count(*) FILTER (level IN ('HIGH', 'CRITICAL')) AS alerts, min(t) FILTER (level <> 'NORMAL') AS first_watch, min(t) FILTER (level IN ('HIGH', 'CRITICAL')) AS first_high, min(t) FILTER (level = 'CRITICAL') AS first_critical,
    {FROM} - min(t) FILTER (level <> 'NORMAL') AS lead_seconds, count(*) FILTER (level IN ('HIGH', 'CRITICAL') AND t >= {FROM}) AS right_, count(*) FILTER (level IN ('HIGH', 'CRITICAL') AND t < {FROM}) AS wrong, count(*) FILTER (t < {FROM}) AS negatives,
    avg(confidence) AS mean_confidence, avg(n_missing / 7) AS missing_output_rate, avg(fresh) AS mean_data_freshness_seconds, max(score) AS peak_score, max(ms) FILTER (place = round_even((n - 1) * 0.5, 0)) AS p50_latency_ms, max(ms) FILTER (place = round_even((n - 1) * 0.95, 0)) AS p95_latency_ms
  FROM l GROUP BY ALL)
SELECT profile, observations, alerts, first_watch, first_high, first_critical, CAST(lead_seconds AS DOUBLE) AS lead_seconds, {R('CASE WHEN alerts > 0 THEN right_ / alerts ELSE 1 END')} AS precision_proxy, {R('CASE WHEN negatives > 0 THEN wrong / negatives ELSE 0 END')} AS false_positive_rate,
  {R('mean_confidence')} AS mean_confidence, {R('missing_output_rate')} AS missing_output_rate, {R('mean_data_freshness_seconds')} AS mean_data_freshness_seconds, {R('peak_score')} AS peak_score,
  {R('round(peak_score - coalesce(lag(peak_score) OVER (ORDER BY step), 0), 6)')} AS contribution_delta, CAST(p50_latency_ms AS DOUBLE) AS p50_latency_ms, CAST(p95_latency_ms AS DOUBLE) AS p95_latency_ms FROM m""")
def evl_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All metrics of every profile over the enriched scores."""
    rows = enriched(spark, sf_dir).withColumns({"missing_output_count": F.size("missing_outputs"), "data_freshness_seconds": F.col("market_data_freshness_seconds"), "processing_latency_ms": (5 + F.col("trade_count") * 37 % 11) * 1000.0})
    out = evaluation.evaluated(rows, FROM, "window_start").withColumn("lead_seconds", F.col("lead_seconds").cast("double"))
    return rounded(out.drop("step", "watch_or_higher"))


SLOPE, INTERCEPT = 1.7, -0.3
CALIBRATED_SQL = FUSE_SQL.replace("ELSE raw_score END AS floored FROM f1)", "ELSE raw_score END AS floored FROM fc)").replace(
    "f2 AS (SELECT *,",
    f"fc AS (SELECT * REPLACE (CASE WHEN baseline_confidence >= 0.5 THEN 1 / (1 + exp(-({SLOPE} * ln(greatest(1e-6, least(1 - 1e-6, raw_score)) / (1 - greatest(1e-6, least(1 - 1e-6, raw_score)))) + {INTERCEPT}))) ELSE raw_score END AS raw_score) FROM f1),\nf2 AS (SELECT *,",
)


@query(f"WITH {CALIBRATED_SQL} SELECT asset_id, window_start, baseline_confidence >= 0.5 AS is_calibrated, severity, {R('fusion_score')} AS fusion_score FROM f")
def fus_calibrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of a calibrated model, where there is history enough."""
    out = scoring.fuse(scoring.detect(window_features(spark, sf_dir)), (SLOPE, INTERCEPT))
    return rounded(out.select("asset_id", "window_start", "is_calibrated", "severity", "fusion_score"))


@query(f"""WITH {EVIDENCE_SQL}, k AS (SELECT string_agg(printf('%02x', xor(54, b)), '' ORDER BY i) AS inner_pad, string_agg(printf('%02x', xor(92, b)), '' ORDER BY i) AS outer_pad FROM (SELECT i, CASE WHEN i <= 6 THEN ascii(substring('pepper', i, 1)) ELSE 0 END AS b FROM range(1, 65) AS t(i))),
c AS (SELECT * FROM (VALUES (0, 'WEBHOOK', true), (1, 'WEBHOOK', false), (2, 'SLACK', false), (3, 'TEAMS', false)) AS t(channel_id, channel_type, signs)),
e AS (SELECT evidence_id % 4 AS channel_id, CAST(evidence_id AS VARCHAR) AS event_id, asset_id, status AS alert_type, {LEVEL('score')} AS severity, epoch FROM ev),
b AS (
  SELECT channel_id, event_id, channel_type, signs, CASE channel_type WHEN 'SLACK' THEN '{{"text":"desk ' || severity || ' alert: ' || alert_type || ' for ' || asset_id || '"}}' WHEN 'TEAMS' THEN '{{"text":"desk ' || severity || ' alert: ' || alert_type || ' for ' || asset_id || '","type":"message"}}'
    ELSE '{{"alert_id":"a' || event_id || '","alert_type":"' || alert_type || '","asset_id":"' || asset_id || '","campaign_id":null,"event_id":"' || event_id || '","event_time":' || epoch || ',"event_type":"alert.created","severity":"' || severity || '","status":"OPEN"}}' END AS body FROM e JOIN c USING (channel_id))
SELECT channel_id, event_id, event_id AS idempotency_key, channel_type, body, CASE WHEN signs THEN 'sha256=' || sha256(unhex(outer_pad) || unhex(sha256(unhex(inner_pad) || encode(body)))) END AS signature FROM b, k""")
def ntf_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    channels = spark.createDataFrame([(0, "WEBHOOK", "pepper"), (1, "WEBHOOK", None), (2, "SLACK", None), (3, "TEAMS", None)], "channel_id int, channel_type string, secret string")
    ev = adapters.evidence(spark, sf_dir)
    sent = ev.select(
        (F.col("evidence_id") % 4).cast("int").alias("channel_id"), F.col("evidence_id").cast("string").alias("event_id"), F.concat(F.lit("a"), "evidence_id").alias("alert_id"), F.lit(None).cast("string").alias("campaign_id"), "asset_id",
        F.col("status").alias("alert_type"), severity(F.col("score")).alias("severity"), F.lit("OPEN").alias("status"), F.col("epoch").alias("event_time"), F.lit("alert.created").alias("event_type"),
    )
    return serving.messages(sent, channels, "desk")


@query("""SELECT event_id, 'API_KEY=[REDACTED];Access-Token=[REDACTED];apikey=' || user_id || ';authorization=[REDACTED];' || CASE WHEN user_id % 2 = 0 THEN 'db_password=[REDACTED];' ELSE 'url=' || event_type || ';' END || 'user=' || user_id AS settings FROM events""")
def prj_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings with secret values masked."""
    user = F.col("user_id").cast("string")
    settings = F.create_map(F.lit("API_KEY"), user, F.lit("Access-Token"), F.col("event_type"), F.lit("apikey"), user, F.lit("authorization"), user, F.when(F.col("user_id") % 2 == 0, "db_password").otherwise("url"), F.col("event_type"), F.lit("user"), user)
    pairs = F.transform(F.map_entries(records.redact(settings)), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return table(spark, sf_dir, "events").select("event_id", F.array_join(pairs, ";").alias("settings"))
