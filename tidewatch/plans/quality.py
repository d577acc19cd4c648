"""Queries on source quality, campaigns, graphs and serving, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions.exprs import severity, uuid5
from tidewatch.operators import campaigns, graph, quality, scoring, serving, text, windows
from tidewatch.plans.core import LEVEL, scored
from tidewatch.plans.core import ORACLES as CORE_SQL
from tidewatch.sources import adapters
from tidewatch.sources.adapters import EVIDENCE_SQL, SIGNALS_SQL, THREADS_SQL, table
from tidewatch.sources.tables import shared_folder

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def books(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    epoch = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return e.select((F.col("user_id") % 5).cast("string").alias("source"), F.concat(F.lit("A"), F.col("user_id") % 20).alias("asset_id"), F.col("event_id").alias("arrival"), epoch.alias("epoch"), (epoch + k).alias("ingested_epoch"), (F.col("event_type") == "view").alias("is_orderbook"))


BOOKS_SQL = """
b0 AS (
  SELECT CAST(user_id % 5 AS VARCHAR) AS source, 'A' || (user_id % 20) AS asset_id, event_id AS arrival, epoch_us(ts) / 1e6 AS epoch, CAST(json_extract_string(props, '$.k') AS INTEGER) AS age, event_type = 'view' AS book FROM events),
b AS (SELECT *, arrival // 40 AS seq FROM b0)"""


@query(f"""WITH {BOOKS_SQL},
p AS (SELECT *, max(seq) OVER (PARTITION BY source, asset_id ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm FROM b),
g AS (SELECT *, coalesce(seq > pm + 1 OR seq <= pm, false) AS gap FROM p),
i AS (
  SELECT *, sum(CASE WHEN seq > pm + 1 THEN seq - pm - 1 ELSE 0 END) OVER w AS gap_count, sum(CASE WHEN seq <= pm THEN 1 ELSE 0 END) OVER w AS out_of_order_count, book AND (age > 30 OR gap) AS bad,
    sum(CASE WHEN book AND (age > 30 OR gap) THEN 1 ELSE 0 END) OVER w AS island FROM g WINDOW w AS (PARTITION BY source, asset_id ORDER BY arrival)),
k AS (SELECT *, sum(CAST(book AS INTEGER)) OVER (PARTITION BY source, asset_id, island ORDER BY arrival) - CAST(island > 0 AS INTEGER) AS k FROM i),
s AS (SELECT *, CASE WHEN book THEN CASE WHEN island = 0 THEN 'VALID' WHEN bad AND age > 30 THEN 'STALE' WHEN bad THEN 'GAP_DETECTED' WHEN k = 1 THEN 'RESYNCING' WHEN k = 2 THEN 'RECOVERED' ELSE 'VALID' END END AS st FROM k)
SELECT source, asset_id, arrival, CAST(gap_count AS BIGINT) AS gap_count, CAST(out_of_order_count AS BIGINT) AS out_of_order_count, st AS orderbook_state,
  CASE WHEN age > 30 OR gap OR coalesce(st NOT IN ('VALID', 'RECOVERED'), false) THEN 'DEGRADED' ELSE 'HEALTHY' END AS status FROM s""")
def dq_observe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = books(spark, sf_dir).withColumn("sequence", F.expr("arrival div 40")).withColumn("ingested_epoch", F.round(F.col("ingested_epoch"), 6)).withColumn("epoch", F.round("epoch", 6))
    return observed(quality.observe(rows, 30.0005))


@query(ORACLES["dq_observe"])
def dq_observe_in_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with each source's history scanned by many tasks."""
    rows = books(spark, sf_dir).withColumn("sequence", F.expr("arrival div 40")).withColumn("ingested_epoch", F.round(F.col("ingested_epoch"), 6)).withColumn("epoch", F.round("epoch", 6))
    return observed(quality.observe_in_slices(rows, 30.0005))


def observed(out: DataFrame) -> DataFrame:
    return out.select("source", "asset_id", "arrival", "gap_count", "out_of_order_count", "orderbook_state", "status")


@query(f"""WITH {SIGNALS_SQL}, l AS (SELECT asset_id, source_domain, max(epoch_us(event_time) / 1e6) AS last FROM sig GROUP BY ALL)
SELECT asset_id, source_domain, round(last, 6) AS last, max(last) OVER (PARTITION BY asset_id) - last >= 3600 AS idle FROM l""")
def dq_idle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.idle_domains(adapters.signals(spark, sf_dir), 3600).select("asset_id", "source_domain", F.round("last", 6).alias("last"), "idle")


@query(f"""WITH {SIGNALS_SQL} SELECT source_domain, count(*) AS n, round(1706745600 - max(epoch_us(event_time) / 1e6), 6) AS age FROM sig GROUP BY ALL""")
def dq_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.freshness(adapters.signals(spark, sf_dir), 1706745600.0).select("source_domain", "n", F.round("age", 6).alias("age"))


@query(f"""WITH {SIGNALS_SQL}, d AS (SELECT * FROM sig UNION ALL SELECT * FROM sig WHERE kind = 'MARKET_TRADE')
SELECT event_id, asset_id, kind, round(price, 6) AS price FROM d QUALIFY row_number() OVER (PARTITION BY scope_id, event_id ORDER BY ingested_at) = 1""")
def flt_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = adapters.signals(spark, sf_dir).select("scope_id", "event_id", "asset_id", "kind", "price", "ingested_at")
    twice = s.unionAll(s.where("kind = 'MARKET_TRADE'"))
    return windows.first_per_key(twice, ["scope_id", "event_id"], "ingested_at").select("event_id", "asset_id", "kind", F.round("price", 6).alias("price"))


@query(f"""WITH {EVIDENCE_SQL},
o AS (SELECT *, CAST(coalesce(epoch - lag(epoch) OVER (PARTITION BY asset_id ORDER BY epoch, evidence_id) > 7776000, false) AS INTEGER) AS opens FROM ev),
s AS (SELECT *, sum(opens) OVER (PARTITION BY asset_id ORDER BY epoch, evidence_id) AS session, CASE WHEN score >= 0.8 THEN 3 WHEN score >= 0.6 THEN 2 WHEN score >= 0.35 THEN 1 ELSE 0 END AS rk FROM o)
SELECT asset_id, CAST(session AS BIGINT) AS session, min(epoch) AS first_evidence, max(epoch) AS last_evidence, count(*) AS versions,
  ['NORMAL', 'WATCH', 'HIGH', 'CRITICAL'][max(rk) + 1] AS max_severity, arg_max(status, (epoch, evidence_id)) AS current_status FROM s GROUP BY asset_id, session""")
def cmp_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = adapters.evidence(spark, sf_dir).withColumn("severity", severity(F.col("score")))
    return campaigns.roll_up(ev, 7_776_000)


@query(f"""WITH {EVIDENCE_SQL}, x AS (SELECT *, max((epoch, evidence_id)) OVER (PARTITION BY asset_id ORDER BY evidence_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM ev)
SELECT evidence_id, asset_id, coalesce((epoch, evidence_id) <= m, false) AS stale FROM x""")
def cmp_stale_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = adapters.evidence(spark, sf_dir).withColumn("arrival", F.col("evidence_id"))
    return campaigns.stale_evidence(ev, ["epoch", "evidence_id"]).select("evidence_id", "asset_id", "stale")


ALERT_STATE_SQL = f"""al AS (SELECT asset_id, window_start AS epoch, alert_type, list_position(['NORMAL', 'WATCH', 'HIGH', 'CRITICAL'], alert_severity) - 1 AS rk FROM ({CORE_SQL['cmp_alert_rules']})),
o AS (SELECT *, row_number() OVER w AS occurrence, max(rk) OVER w AS top FROM al WINDOW w AS (PARTITION BY asset_id, alert_type ORDER BY epoch)),
p AS (SELECT *, lag(top) OVER (PARTITION BY asset_id, alert_type ORDER BY epoch) AS before FROM o)"""


@query(f"""WITH {ALERT_STATE_SQL} SELECT asset_id, alert_type, epoch, occurrence, ['NORMAL', 'WATCH', 'HIGH', 'CRITICAL'][top + 1] AS max_severity,
  CASE WHEN before IS NULL THEN 'created' WHEN top > before THEN 'severity_changed' ELSE 'refreshed' END AS event FROM p""")
def cmp_alert_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = scoring.alerts(scored(spark, sf_dir), ["asset_id", "window_start"]).withColumnRenamed("window_start", "epoch")
    return campaigns.alert_state(a)


@query(f"""WITH RECURSIVE {ALERT_STATE_SQL}, n AS (SELECT *, CASE WHEN before IS NULL THEN 'created' WHEN top > before THEN 'severity_changed' ELSE 'refreshed' END AS event FROM p),
s AS (SELECT asset_id, alert_type, epoch, occurrence, top, event, false AS suppressed, epoch AS last FROM n WHERE occurrence = 1
  UNION ALL SELECT n.asset_id, n.alert_type, n.epoch, n.occurrence, n.top, n.event, n.event = 'refreshed' AND n.epoch - s.last < 43200, CASE WHEN n.event = 'refreshed' AND n.epoch - s.last < 43200 THEN s.last ELSE n.epoch END
  FROM s JOIN n ON n.asset_id = s.asset_id AND n.alert_type = s.alert_type AND n.occurrence = s.occurrence + 1)
SELECT asset_id, alert_type, epoch, occurrence, ['NORMAL', 'WATCH', 'HIGH', 'CRITICAL'][top + 1] AS max_severity, event, suppressed, CASE WHEN suppressed THEN 'COOLDOWN' END AS reason FROM s""")
def cmp_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return campaigns.notified(cmp_alert_state(spark, sf_dir), 43_200)


@query(f"""WITH {THREADS_SQL},
n AS (SELECT thread_id, author_id, count(*) AS n FROM th GROUP BY ALL), p AS (SELECT *, sum(n) OVER (PARTITION BY thread_id) AS total FROM n)
SELECT thread_id, CAST(sum(n) AS BIGINT) AS posts, count(*) AS authors, round(max(n / total), 9) AS community_concentration,
  round(CASE WHEN count(*) > 1 THEN sum(-(n / total) * ln(n / total)) / ln(count(*)) ELSE 0 END, 9) AS community_entropy, round(least(1.0, count(*) / sum(n)), 9) AS cross_community_spread FROM p GROUP BY thread_id""")
def grf_authorship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.authorship(adapters.threads(spark, sf_dir), "thread_id").select("thread_id", "posts", "authors", *(F.round(c, 9).alias(c) for c in ("community_concentration", "community_entropy", "cross_community_spread")))


@query(f"""WITH {THREADS_SQL}, g AS (SELECT thread_id, epoch - lag(epoch) OVER (PARTITION BY thread_id ORDER BY epoch, post_id) AS gap FROM th)
SELECT thread_id, coalesce(avg(CAST(gap <= 5 AS DOUBLE)), 0) AS synchronized_posting FROM g GROUP BY thread_id""")
def grf_synchronized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.synchronized(adapters.threads(spark, sf_dir), "thread_id")


@query(f"""WITH RECURSIVE {THREADS_SQL}, c AS (
  SELECT thread_id, post_id, 0 AS d FROM th WHERE reply_to IS NULL OR reply_to NOT IN (SELECT post_id FROM th)
  UNION ALL SELECT th.thread_id, th.post_id, c.d + 1 FROM th JOIN c ON th.reply_to = c.post_id AND th.thread_id = c.thread_id)
SELECT thread_id, max(d) AS propagation_depth FROM c GROUP BY thread_id""")
def grf_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared_folder(spark)
    return graph.depth(adapters.threads(spark, sf_dir), "thread_id")


@query(f"""WITH {THREADS_SQL}, f AS (SELECT thread_id, author_id, min(epoch) AS t FROM th GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY t, author_id) AS n, min(t) OVER (PARTITION BY thread_id) AS t0 FROM f)
SELECT thread_id, max(t - t0) FILTER (n = 2) AS time_to_2, max(t - t0) FILTER (n = 3) AS time_to_3 FROM r GROUP BY thread_id""")
def grf_time_to_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.time_to_authors(adapters.threads(spark, sf_dir), "thread_id", (2, 3))


@query(f"""WITH {THREADS_SQL} SELECT author_id AS src, 'POSTED' AS rel, post_id AS dst FROM th UNION SELECT post_id, 'MEMBER_OF', CAST(thread_id AS VARCHAR) FROM th UNION SELECT post_id, 'REPLIES_TO', reply_to FROM th WHERE reply_to IS NOT NULL""")
def grf_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.edges(adapters.threads(spark, sf_dir), "thread_id")


@query("""WITH l AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) SELECT user_id, event_type, event_id, round(value, 6) AS value FROM l WHERE r = 1""")
def src_latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "ts", F.round("value", 6).alias("value"))
    return serving.latest(e, ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


@query("""SELECT user_id, event_id, rn AS place FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 5""")
def qry_score_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return serving.newest(e, ["user_id"], [F.desc("ts"), F.desc("event_id")], 5).select("user_id", "event_id", "place")


@query("""WITH u AS (SELECT 'order' AS kind, o_orderkey AS id, o_orderdate AS t FROM orders UNION ALL SELECT 'event', event_id, ts FROM events)
SELECT kind, id FROM u ORDER BY t DESC, kind, id DESC LIMIT 100""")
def qry_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "orders").select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("at"))
    b = table(spark, sf_dir, "events").select(F.lit("event").alias("kind"), F.col("event_id").alias("id"), F.col("ts").alias("at"))
    return serving.timeline([a, b], [F.desc("at"), F.asc("kind"), F.desc("id")], 100).select("kind", "id")


@query("""WITH k AS (SELECT event_id, event_type FROM events, (SELECT max(event_id) AS m FROM events) WHERE event_id > m - 500)
SELECT min(event_id) - 1 AS event_id, 'stream.reset_required' AS kind FROM k HAVING min(event_id) > 11 UNION ALL SELECT event_id, event_type FROM k WHERE event_id > 10""")
def src_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.feed(table(spark, sf_dir, "events"), 10, 500)


SUBSCRIPTIONS = [("mail", "HIGH", [], []), ("desk", "WATCH", ["C1", "C2", "C3", "C5", "C8"], []), ("page", "CRITICAL", [], ["O"])]


@query(f"""WITH {EVIDENCE_SQL},
s AS (SELECT * FROM (VALUES ('mail', 2, CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[])), ('desk', 1, ['C1', 'C2', 'C3', 'C5', 'C8'], CAST([] AS VARCHAR[])), ('page', 3, CAST([] AS VARCHAR[]), ['O'])) AS t(channel, minimum, assets, types)),
a AS (SELECT *, {LEVEL('score')} AS severity, CASE WHEN score >= 0.8 THEN 3 WHEN score >= 0.6 THEN 2 WHEN score >= 0.35 THEN 1 ELSE 0 END AS rk FROM ev)
SELECT DISTINCT channel, evidence_id AS alert_id, severity, asset_id FROM a JOIN s ON rk >= minimum AND (len(assets) = 0 OR list_contains(assets, asset_id)) AND (len(types) = 0 OR list_contains(types, status))""")
def ntf_fan_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    subs = spark.createDataFrame(SUBSCRIPTIONS, "channel string, minimum string, assets array<string>, types array<string>")
    a = adapters.evidence(spark, sf_dir).select(F.col("evidence_id").alias("alert_id"), "asset_id", F.col("status").alias("alert_type"), severity(F.col("score")).alias("severity"))
    return serving.fan_out(a, subs).select("channel", "alert_id", "severity", "asset_id")


@query("""SELECT event_id, CASE WHEN event_type = 'view' THEN 'DELIVERED' WHEN user_id % 7 >= 5 THEN 'FAILED' ELSE 'RETRY' END AS status,
  CASE WHEN event_type <> 'view' AND user_id % 7 < 5 THEN 1000 + CAST(least(900, 5 * pow(2, user_id % 7)) AS BIGINT) END AS next_attempt FROM events""")
def ntf_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "events").select("event_id", (F.col("event_type") == "view").alias("ok"), (F.col("user_id") % 7).alias("attempts"))
    return serving.retry_state(d, 1000).select("event_id", "status", "next_attempt")


@query("""SELECT user_id, 'actor_' || substring(sha256(unhex(outer_pad) || unhex(sha256(unhex(inner_pad) || encode('forum:' || user_id)))), 1, 32) AS actor
FROM (SELECT DISTINCT user_id FROM events), (SELECT string_agg(printf('%02x', xor(54, b)), '' ORDER BY i) AS inner_pad, string_agg(printf('%02x', xor(92, b)), '' ORDER BY i) AS outer_pad
  FROM (SELECT i, CASE WHEN i <= 6 THEN ascii(substring('pepper', i, 1)) ELSE 0 END AS b FROM range(1, 65) AS t(i)))""")
def prj_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = table(spark, sf_dir, "events").select("user_id").distinct()
    return text.pseudonyms(u.withColumn("author", F.col("user_id")), "pepper", "forum", "author")


@query("""WITH h AS (SELECT event_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('event:' || event_id)) AS h FROM events)
SELECT event_id, substring(h, 1, 8) || '-' || substring(h, 9, 4) || '-5' || substring(h, 14, 3) || '-' || printf('%02x', (CAST('0x' || substring(h, 17, 2) AS INTEGER) & 63) | 128) || substring(h, 19, 2) || '-' || substring(h, 21, 12) AS id FROM h""")
def prj_uuid5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", uuid5(F.concat(F.lit("event:"), F.col("event_id"))).alias("id"))


@query(f"""WITH RECURSIVE {EVIDENCE_SQL},
v AS (SELECT asset_id, row_number() OVER (PARTITION BY asset_id ORDER BY epoch, evidence_id) AS version, sha256(evidence_id || '|' || status || '|' || priority) AS content_hash FROM ev),
c AS (SELECT asset_id, version, content_hash, sha256('' || '|' || content_hash || '|' || version) AS chain_hash FROM v WHERE version = 1
  UNION ALL SELECT v.asset_id, v.version, v.content_hash, sha256(c.chain_hash || '|' || v.content_hash || '|' || v.version) FROM v JOIN c ON v.asset_id = c.asset_id AND v.version = c.version + 1)
SELECT * FROM c""")
def evd_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    ev = adapters.evidence(spark, sf_dir).withColumn("version", F.row_number().over(Window.partitionBy("asset_id").orderBy("epoch", "evidence_id")))
    return serving.evidence_chain(ev, "asset_id", "version", ["evidence_id", "status", "priority"])


@query(f"""WITH {EVIDENCE_SQL}, w AS (SELECT *, row_number() OVER p AS version, lead(epoch) OVER p AS effective_to FROM ev WINDOW p AS (PARTITION BY asset_id ORDER BY epoch, evidence_id))
SELECT asset_id, evidence_id, version, effective_to, effective_to IS NULL AS current FROM w""")
def ver_scd2(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = adapters.evidence(spark, sf_dir).withColumn("at", F.struct("epoch", "evidence_id"))
    return serving.scd2(ev, "asset_id", "at").select("asset_id", "evidence_id", "version", F.col("effective_to.epoch").alias("effective_to"), "current")


@query("""WITH d AS (SELECT doc_id, doc_id % 40 AS k, sha256(coalesce(text, '')) AS h FROM documents), c AS (SELECT *, lag(h) OVER (PARTITION BY k ORDER BY doc_id) AS b FROM d),
v AS (SELECT * FROM c WHERE b IS NULL OR b <> h) SELECT doc_id, k AS document_key, row_number() OVER w AS version, CASE WHEN lead(h) OVER w IS NULL THEN 'CURRENT' ELSE 'SUPERSEDED' END AS status FROM v WINDOW w AS (PARTITION BY k ORDER BY doc_id)""")
def ver_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 40).alias("document_key"), "text")
    return serving.versions(d, "document_key", "doc_id", "text").select("doc_id", "document_key", "version", "status")


@query(f"""WITH {SIGNALS_SQL}, q AS (SELECT asset_id, event_time AS t, event_id AS quality_id, source_gap_count FROM sig WHERE kind = 'DATA_QUALITY'), l AS (SELECT asset_id, event_id, event_time AS t FROM sig WHERE kind = 'MARKET_TRADE')
SELECT l.asset_id, l.event_id, q.quality_id, q.source_gap_count FROM l ASOF LEFT JOIN q ON l.asset_id = q.asset_id AND l.t >= q.t""")
def join_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = adapters.signals(spark, sf_dir)
    left = s.where("kind = 'MARKET_TRADE'").select("asset_id", "event_id", F.col("event_time").alias("t"))
    right = s.where("kind = 'DATA_QUALITY'").select("asset_id", F.col("event_time").alias("t"), F.col("event_id").alias("quality_id"), "source_gap_count")
    return serving.as_of(left, right, "asset_id", "t", "t", ["quality_id", "source_gap_count"]).drop("t")


POLICIES = [("p1", None, 1704067200, None, 86_400 * 3), ("p2", "A3", 1704067200, 1705276800, 86_400), ("p3", "A7", 1704672000, None, 3_600)]


@query(f"""WITH {SIGNALS_SQL},
p AS (SELECT * FROM (VALUES ('p1', NULL, 1704067200, NULL, 259200), ('p2', 'A3', 1704067200, 1705276800, 86400), ('p3', 'A7', 1704672000, NULL, 3600)) AS t(policy_id, policy_asset, ef, et, ms)),
runs AS (SELECT 'p' || (1 + user_id % 3) AS policy_id, epoch(ts) AS started, epoch(ts) + 60 AS completed, CASE WHEN value > 400 THEN 'FAILED' ELSE 'SUCCESS' END AS status, event_id FROM events WHERE event_type = 'error'),
a AS (SELECT DISTINCT asset_id, CAST(floor(epoch(event_time) / 86400) * 86400 AS BIGINT) AS epoch FROM sig),
j AS (SELECT * FROM a JOIN p ON (policy_asset IS NULL OR policy_asset = asset_id) AND ef <= epoch AND (et IS NULL OR epoch < et)),
r AS (SELECT j.asset_id, j.epoch, j.policy_id, j.ms, arg_max(status, (started, completed)) AS st, arg_max(completed, (started, completed)) AS co FROM j LEFT JOIN runs ON runs.policy_id = j.policy_id AND completed <= j.epoch GROUP BY ALL)
SELECT asset_id, epoch, count(*) AS policies, count(*) FILTER (st IS NULL OR st <> 'SUCCESS' OR epoch - co > ms) AS degraded, count(*) FILTER (st IS NULL OR st <> 'SUCCESS' OR epoch - co > ms) = 0 AS complete FROM r GROUP BY ALL""")
def dq_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    policies = spark.createDataFrame(POLICIES, "policy_id string, policy_asset string, effective_from long, effective_to long, max_staleness long")
    t = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    runs = table(spark, sf_dir, "events").where("event_type = 'error'").select(F.concat(F.lit("p"), 1 + F.col("user_id") % 3).alias("policy_id"), t.alias("started"), (t + 60).alias("completed"), F.when(F.col("value") > 400, "FAILED").otherwise("SUCCESS").alias("status"))
    at = adapters.signals(spark, sf_dir).select("asset_id", (F.floor(F.unix_micros(F.col("event_time").cast("timestamp")) / 1e6 / 86_400) * 86_400).cast("long").alias("epoch")).distinct()
    return quality.coverage(policies, runs, at)
