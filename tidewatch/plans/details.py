"""Queries on matches of assets, fetches of feeds, promotion, details of alerts, explanations and readers, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions.exprs import uuid5
from tidewatch.operators import evaluation, narratives, records, serving, threat
from tidewatch.plans.core import DETECT_SQL, scored
from tidewatch.plans.texts import ORACLES as TEXTS_SQL
from tidewatch.sources import adapters, landing
from tidewatch.sources.adapters import EVIDENCE_SQL, table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def nines(c):
    return F.round(c + 1.7e-11, 9)


@query(f"""WITH c AS ({TEXTS_SQL['thr_candidates']}), i AS (SELECT indicator_type, indicator_value, min(doc_id) * 60 + 600 AS fetched_at FROM c GROUP BY ALL HAVING min(doc_id) % 5 <> 0),
m AS (SELECT doc_id, unnest([doc_id % 20, doc_id % 7]) AS a FROM documents WHERE doc_id % 11 <> 0)
SELECT DISTINCT c.doc_id, 'A' || a AS asset_id, indicator_type, indicator_value, greatest(c.doc_id * 60, fetched_at) AS evidence_cutoff, CAST(0.7 AS DOUBLE) AS confidence FROM c JOIN i USING (indicator_type, indicator_value) JOIN m ON c.doc_id = m.doc_id""")
def thr_asset_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches of documents' candidates with active indicators for the assets of each document."""
    d = table(spark, sf_dir, "documents")
    found = threat.written(threat.candidates(d, "doc_id"))
    first = found.groupBy("indicator_type", "indicator_value").agg(F.min("doc_id").alias("d"))
    known = first.select("indicator_type", "indicator_value", uuid5(F.concat_ws(":", "indicator_type", "indicator_value")).alias("indicator_id"), (F.col("d") * 60 + 600).alias("fetched_at"), (F.col("d") % 5 != 0).alias("active"))
    at = F.col("doc_id")
    mentions = d.where(at % 11 != 0).select(at, F.lit("LIVE").alias("scope_id"), F.explode(F.array(*(F.concat(F.lit("A"), at % k) for k in (20, 7)))).alias("asset_id"), (at * 60).alias("event_time"))
    return threat.asset_matches(found, known, mentions, "doc_id").select("doc_id", "asset_id", "indicator_type", "indicator_value", "evidence_cutoff", "confidence")


#: Deliveries of a feed, made of events: two fetches, each with repeats of ids, and hashes that are not hexadecimal.
FETCHES_SQL = """f AS (SELECT event_id % 9000 AS provider_id, CASE WHEN user_id % 13 = 0 THEN 'broken' ELSE md5(CAST(user_id % 400 AS VARCHAR)) END AS value, CAST(floor(epoch_us(ts) / 1e6) AS BIGINT) AS created, CASE WHEN event_id % 3 = 0 THEN CAST(floor(epoch_us(ts) / 1e6) AS BIGINT) + 50 END AS modified, event_id AS pulse, event_id % 2 AS turn FROM events),
g AS (SELECT *, coalesce(modified, created) AS seen FROM f WHERE value <> 'broken')"""


def fetched(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    e = table(spark, sf_dir, "events")
    at = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).cast("long")
    i = F.col("event_id")
    value = F.when(F.col("user_id") % 13 == 0, "broken").otherwise(F.md5((F.col("user_id") % 400).cast("string")))
    rows = e.select((i % 9000).alias("provider_id"), F.lit("FileHash-MD5").alias("type"), value.alias("indicator"), at.alias("created"), F.when(i % 3 == 0, at + 50).alias("modified"), i.alias("pulse_modified"), (i % 2).alias("fetch"))
    none = spark.createDataFrame([], "indicator_id string, indicator_type string, indicator_value string, first_seen long, last_seen long, fetched_at long, active boolean")
    log = spark.createDataFrame([], "provider_id long, indicator_id string, observed_at long, fetched_at long")
    kept, log, _ = threat.ingest(none, log, rows.where("fetch = 0").drop("fetch"), 100)
    return threat.ingest(kept, log, rows.where("fetch = 1").drop("fetch"), 200)


@query(f"""WITH {FETCHES_SQL}, b AS (SELECT value, turn, min(created) AS first_seen, arg_max(seen, (pulse, provider_id)) AS last_seen FROM g GROUP BY ALL)
SELECT value AS indicator_value, arg_min(first_seen, turn) AS first_seen, arg_max(last_seen, turn) AS last_seen, 100 + 100 * max(turn) AS fetched_at FROM b GROUP BY value""")
def thr_ingested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indicators after two fetches."""
    return fetched(spark, sf_dir)[0].select("indicator_value", "first_seen", "last_seen", "fetched_at")


@query(f"""WITH {FETCHES_SQL}, o AS (SELECT provider_id, turn, arg_min(struct_pack(v := value, s := seen), pulse) AS r FROM g GROUP BY ALL), k AS (SELECT provider_id, arg_min(r, turn) AS r, min(turn) AS turn FROM o GROUP BY ALL)
SELECT provider_id, r.v AS indicator_value, r.s AS observed_at, 100 + 100 * turn AS fetched_at, (SELECT max(pulse) FROM f WHERE turn = 1) AS watermark FROM k""")
def thr_ingested_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations after two fetches, each provider's id once, with the feed's watermark."""
    kept, log, mark = fetched(spark, sf_dir)
    rows = log.join(kept.select("indicator_id", "indicator_value"), "indicator_id").crossJoin(F.broadcast(mark))  # one row
    return rows.select("provider_id", "indicator_value", "observed_at", "fetched_at", "watermark")


@query("""WITH c AS (SELECT c_custkey AS artifact_id, c_nationkey AS family, c_custkey % 3 AS version FROM customer), k AS (SELECT o_custkey AS artifact_id, arg_max(struct_pack(samples := o_orderkey % 90, ece := round(o_totalprice / 1e6, 4), auc := round(1 - o_totalprice / 1e6, 4), brier := round(o_totalprice / 2e6, 4)), o_orderkey) AS m FROM orders WHERE o_orderstatus <> 'F' GROUP BY ALL),
a AS (SELECT c_nationkey AS family, min(c_custkey) AS champion_id FROM customer WHERE c_nationkey % 4 <> 0 GROUP BY ALL), d AS (SELECT user_id % 25 AS family, user_id % 3 AS version, arg_max(CASE WHEN value > 300 THEN 'DRIFTED' ELSE 'STABLE' END, event_id) AS drift_status FROM events WHERE event_type = 'view' GROUP BY ALL),
p AS (SELECT user_id % 25 AS family, user_id % 3 AS version, count(*) AS n FROM events WHERE event_type = 'error' AND floor(epoch_us(ts) / 1e6) >= 1707000000 - 30 * 86400 GROUP BY ALL),
i AS (SELECT artifact_id, c.family, c.version, k.m.samples AS samples, k.m.ece AS ece, k.m.auc AS auc, k.m.brier AS brier, champion_id IS NOT NULL AND champion_id <> artifact_id AS required, drift_status, coalesce(p.n, 0) AS false_positives, champion_id FROM c JOIN k USING (artifact_id) LEFT JOIN a ON c.family = a.family LEFT JOIN d ON c.family = d.family AND c.version = d.version LEFT JOIN p ON c.family = p.family AND c.version = p.version),
j AS (SELECT i.*, CASE WHEN required THEN k.m.brier END AS champion_brier FROM i LEFT JOIN k ON k.artifact_id = i.champion_id)
SELECT artifact_id, false_positives, champion_brier, drift_status, CASE WHEN NOT (samples >= 20 AND ece <= 0.25 AND auc >= 0.6 AND coalesce(drift_status <> 'DRIFTED', true) AND false_positives <= 40 AND (NOT required OR coalesce(brier <= champion_brier + 0.02, false))) THEN 'REJECTED' WHEN artifact_id % 2 = 0 THEN 'PROMOTED' ELSE 'APPROVED' END AS status FROM j""")
def gov_promotion_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as model artifacts of nations, their orders as calibrations, the least of a nation as its champion; even ones are to be applied."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("artifact_id"), F.col("c_nationkey").alias("family"), (F.col("c_custkey") % 3).alias("version"))
    price = F.col("o_totalprice")
    k = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("artifact_id"), F.when(F.col("o_orderstatus") == "F", "RETIRED").otherwise("ACTIVE").alias("status"), F.col("o_orderkey").alias("created"), (F.col("o_orderkey") % 90).alias("samples"), F.round(price / 1e6, 4).alias("ece"), F.round(1 - price / 1e6, 4).alias("auc"), F.round(price / 2e6, 4).alias("brier"))
    a = c.where("family % 4 <> 0").groupBy("family").agg(F.min("artifact_id").alias("artifact_id")).select("family", F.lit("CHAMPION").alias("alias"), "artifact_id")
    e = table(spark, sf_dir, "events").withColumns({"family": F.col("user_id") % 25, "version": F.col("user_id") % 3})
    d = e.where("event_type = 'view'").select("family", "version", F.col("event_id").alias("observed"), F.when(F.col("value") > 300, "DRIFTED").otherwise("STABLE").alias("drift_status"))
    r = e.where("event_type = 'error'").select("family", "version", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("created"))
    rows = evaluation.promotion_inputs(c, k, a, d, r, 1_707_000_000)
    out = evaluation.promotion(rows, 20, 0.25, 0.6, 40, 0.02, F.col("champion_required"), F.col("artifact_id") % 2 == 0)
    return out.select("artifact_id", "false_positives", "champion_brier", "drift_status", "status")


@query(f"""WITH {EVIDENCE_SQL}, l AS (SELECT asset_id, arg_max(evidence_id, (epoch, evidence_id)) AS score_id, round(arg_max(score, (epoch, evidence_id)) + 1.7e-11, 9) AS score FROM ev GROUP BY asset_id),
g AS (SELECT 'C' || (user_id % 1500) AS asset_id, arg_max(event_id, (ts, event_id)) AS campaign_id, arg_max(event_type, (ts, event_id)) AS stage FROM events GROUP BY ALL)
SELECT 'C' || c_custkey AS asset_id, score_id, score, campaign_id, stage FROM customer LEFT JOIN l ON 'C' || c_custkey = l.asset_id LEFT JOIN g ON 'C' || c_custkey = g.asset_id""")
def qry_asset_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every asset with its latest score and its latest campaign."""
    assets = table(spark, sf_dir, "customer").select(F.concat(F.lit("C"), F.col("c_custkey")).alias("asset_id"))
    s = adapters.evidence(spark, sf_dir).select("asset_id", "epoch", "evidence_id", "score")
    c = table(spark, sf_dir, "events").select(F.concat(F.lit("C"), F.col("user_id") % 1500).alias("asset_id"), "ts", "event_id", "event_type")
    out = serving.overview(assets, s, c, "asset_id", ["epoch", "evidence_id"], ["ts", "event_id"])
    return out.select("asset_id", F.col("latest_score.evidence_id").alias("score_id"), nines(F.col("latest_score.score")).alias("score"), F.col("latest_campaign.event_id").alias("campaign_id"), F.col("latest_campaign.event_type").alias("stage"))


@query("""WITH a AS (SELECT l_orderkey AS alert_id, l_linenumber, l_linestatus AS action, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_linestatus) AS place, count(*) OVER (PARTITION BY l_orderkey) AS actions FROM lineitem WHERE l_returnflag <> 'N')
SELECT o_orderkey AS alert_id, o_orderstatus AS status, action, place, coalesce(actions, 0) AS actions FROM orders LEFT JOIN a ON o_orderkey = alert_id""")
def qry_alert_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as alerts, their returned or accepted items as actions."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("alert_id"), F.col("o_orderstatus").alias("status"))
    a = table(spark, sf_dir, "lineitem").where("l_returnflag <> 'N'").select(F.col("l_orderkey").alias("alert_id"), F.col("l_linestatus").alias("action"), "l_shipdate", "l_linenumber")
    return serving.alert_detail(o, a, "alert_id", ["l_shipdate", "l_linenumber", "action"]).select("alert_id", "status", "action", "place", "actions")


NAMES = ["market_score", "social_score", "coordination_score", "temporal_score"]


@query(f"""WITH {DETECT_SQL}, x AS (SELECT asset_id, window_start, market_score AS m, {', '.join(NAMES)}, CASE WHEN window_start % 3 = 0 THEN ['SUPPORTED', 'CONFLICTING', 'SUPPORTED'] WHEN window_start % 7 = 0 THEN ['UNKNOWN'] ELSE CAST([] AS VARCHAR[]) END AS results FROM d),
y AS (SELECT asset_id, window_start, unnest([{', '.join(NAMES)}]) AS v, unnest([0, 1, 2, 3]) AS i, unnest({NAMES}) AS n FROM x),
z AS (SELECT asset_id, window_start, string_agg(n, ',' ORDER BY abs(v) DESC, i) AS c, first(n ORDER BY abs(v) DESC, i) AS top FROM y WHERE v IS NOT NULL GROUP BY ALL)
SELECT x.asset_id, x.window_start, coalesce(c, '') AS contributors, 'ALERT_THRESHOLD=HIGH;MARKET_CORROBORATION=' || CASE WHEN coalesce(m, 0) >= 0.35 THEN 'true' ELSE 'false' END || CASE WHEN len(results) > 0 THEN ';CLAIM_VERIFICATION=' || array_to_string(list_sort(list_distinct(results)), ',') ELSE '' END AS rules,
  'HIGH COORDINATED_ATTENTION for ' || x.asset_id || '; the strongest recorded contributor was ' || coalesce(top, 'available evidence') || '.' AS summary FROM x LEFT JOIN z ON x.asset_id = z.asset_id AND x.window_start = z.window_start""")
def evd_explained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every window's scores explained as those of an alert."""
    w = F.col("window_start")
    given = lambda *x: F.array(*(F.lit(v) for v in x))
    results = F.when(w % 3 == 0, given("SUPPORTED", "CONFLICTING", "SUPPORTED")).when(w % 7 == 0, given("UNKNOWN")).otherwise(F.expr("cast(array() as array<string>)"))
    rows = scored(spark, sf_dir).withColumns({"results": results, "fusion_score": F.lit(0.7), "severity": F.lit("HIGH"), "alert_type": F.lit("COORDINATED_ATTENTION")})
    out = records.explained(rows, NAMES, "severity", "results", ["alert_type", "asset_id"])
    rules = F.array_join(F.transform("rules", lambda r: F.concat(r["rule"], F.lit("="), r["outcome"])), ";")
    return out.select("asset_id", "window_start", F.array_join(F.transform("contributors", lambda c: c["feature"]), ",").alias("contributors"), rules.alias("rules"), "summary")


@query("""WITH v AS (SELECT label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), c AS (SELECT label, i, avg(e[i]) AS m FROM (SELECT label, e, unnest(range(1, len(e) + 1)) AS i FROM v) GROUP BY ALL), n AS (SELECT label, sqrt(sum(m * m)) AS size FROM c GROUP BY ALL)
SELECT c.label, CAST(i - 1 AS INTEGER) AS i, round(m / size + 1.7e-11, 9) AS value FROM c JOIN n ON c.label = n.label""")
def nar_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The centroid of each label, of length 1."""
    v = table(spark, sf_dir, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("vector"))
    return narratives.centroids(v, "label").select("label", "i", nines(F.col("value")).alias("value"))


@query("""WITH d AS (SELECT doc_id, doc_id % 40 AS k, sha256(coalesce(text, '')) AS h FROM documents), c AS (SELECT *, lag(h) OVER (PARTITION BY k ORDER BY doc_id) AS b FROM d)
SELECT doc_id, k AS document_key, row_number() OVER (PARTITION BY k ORDER BY doc_id) AS version, greatest(doc_id * 60, doc_id * 50 + 3000) AS available_at FROM c WHERE b IS NULL OR b <> h""")
def ver_available(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions with the time from which they are available."""
    n = F.col("doc_id")
    d = table(spark, sf_dir, "documents").select("doc_id", (n % 40).alias("document_key"), "text", (n * 60).alias("observed"), (n * 50 + 3000).alias("ingested"))
    return serving.versions(d, "document_key", "doc_id", "text", "observed", "ingested").select("doc_id", "document_key", "version", "available_at")


@query("""WITH n AS (SELECT o_custkey % 50 AS company, 'f' || (o_orderkey % 700) AS accession, 0 AS old, o_orderkey AS pos FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT o_custkey % 50, 'f' || (o_orderkey % 700), 1, o_orderkey FROM orders WHERE o_orderstatus <> 'O'),
o AS (SELECT company, accession, min((old, pos)) AS o FROM n GROUP BY ALL) SELECT company, accession, row_number() OVER (PARTITION BY company ORDER BY o, accession) AS place FROM o QUALIFY place <= 100""")
def src_seen_filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred newest keys of each company after a run: open orders are of this run, the others were seen before."""
    o = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("company"), F.concat(F.lit("f"), F.col("o_orderkey") % 700).alias("accession"), F.col("o_orderkey").alias("n"), (F.col("o_orderstatus") == "O").alias("new"))
    return landing.seen_filings(o.where("new"), o.where("not new").withColumnRenamed("n", "place"), 100).select("company", "accession", "place")


@query("""WITH k AS (SELECT c_custkey, i FROM customer, range(4) AS t(i) WHERE i < c_custkey % 4 - 1)
SELECT 'C' || c_custkey AS asset_id, 1704067200 + i * 60 AS epoch, CAST(c_custkey + i AS DOUBLE) AS open, CAST(c_custkey + i + 5 AS DOUBLE) AS close, CAST(i AS DOUBLE) AS volume FROM k""")
def src_closed_candles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads of up to three candles for each customer; the last of each is still open."""
    n = F.col("c_custkey").cast("long")
    row = lambda i: F.array(*(x.cast("string") for x in ((1704067200 + i.cast("long") * 60) * 1000, n + i, n + i + 9, n + i - 9, n + i + 5, i)))
    body = F.to_json(F.transform(F.slice(F.array(F.lit(0), F.lit(1), F.lit(2)), 1, n % 4), row))
    raw = table(spark, sf_dir, "customer").select(F.concat(F.lit("C"), n).alias("asset_id"), body.alias("body"))
    return landing.candles(raw).select("asset_id", F.unix_timestamp("event_time").alias("epoch"), "open", "close", "volume")
