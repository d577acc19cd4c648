"""Queries on records: visibility, validity, evidence, ranking, governance, lists, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators import evaluation, graph, records, serving
from tidewatch.plans.core import DETECT_SQL, FUSE_SQL, LEVEL, scored
from tidewatch.sources import adapters, landing
from tidewatch.sources.adapters import EVIDENCE_SQL, SIGNALS_SQL, THREADS_SQL, table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query("""WITH r AS (SELECT event_id, concat_ws(',', CASE WHEN epoch(ts) > 1705276800 + 300 THEN 'FUTURE_EVENT_TIME' END, CASE WHEN value / 400 > 1 OR value < 0 THEN 'INVALID_SOURCE_TRUST' END,
  CASE WHEN value / 400 >= 0 AND value / 400 < 0.25 THEN 'LOW_TRUST_SOURCE' END, CASE WHEN length(props) > 1000000 THEN 'PAYLOAD_TOO_LARGE' END) AS reasons FROM events)
SELECT event_id, reasons, CASE WHEN reasons = '' THEN 0.0 ELSE round(least(1.0, 0.4 * (1 + length(reasons) - length(replace(reasons, ',', '')))), 6) END AS risk FROM r""")
def flt_guard_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"), (F.col("value") / 400).alias("trust"), "props")
    return records.guard_payload(e, 1705276800, "t", "trust", "props").select("event_id", F.array_join("reasons", ",").alias("reasons"), F.round("risk", 6).alias("risk"))


@query("""WITH c AS (SELECT 's' || (c_custkey % 50) AS scope_id, 'A' || (c_nationkey % 20) AS asset_id, 't' || (c_custkey % 3) AS tenant_id FROM customer), z AS (SELECT 's' || (s_suppkey % 50) AS scope_id, 't' || (s_nationkey % 3) AS tenant_id FROM supplier),
r AS (SELECT event_id, 's' || (user_id % 50) AS scope_id, 'A' || (user_id % 20) AS asset_id FROM events)
SELECT * FROM r WHERE EXISTS (SELECT 1 FROM c WHERE c.tenant_id = 't1' AND c.scope_id = r.scope_id AND c.asset_id = r.asset_id) OR EXISTS (SELECT 1 FROM z WHERE z.tenant_id = 't1' AND z.scope_id = r.scope_id)""")
def flt_visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = lambda p, c: F.concat(F.lit(p), c)
    c = table(spark, sf_dir, "customer").select(name("s", F.col("c_custkey") % 50).alias("scope_id"), name("A", F.col("c_nationkey") % 20).alias("asset_id"), name("t", F.col("c_custkey") % 3).alias("tenant_id"))
    z = table(spark, sf_dir, "supplier").select(name("s", F.col("s_suppkey") % 50).alias("scope_id"), name("t", F.col("s_nationkey") % 3).alias("tenant_id"))
    r = table(spark, sf_dir, "events").select("event_id", name("s", F.col("user_id") % 50).alias("scope_id"), name("A", F.col("user_id") % 20).alias("asset_id"))
    return records.visible(r, c, z, "t1")


@query("""WITH o AS (SELECT o_custkey, o_orderkey, CAST(epoch(o_orderdate) AS BIGINT) AS a, CAST(epoch(o_orderdate) AS BIGINT) + 86400 * (o_orderkey % 90) AS b FROM orders),
m AS (SELECT *, max(b) OVER (PARTITION BY o_custkey ORDER BY a, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e FROM o) SELECT o_custkey, o_orderkey FROM m WHERE a < e""")
def flt_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.unix_timestamp("o_orderdate")
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", t.alias("a"), (t + 86_400 * (F.col("o_orderkey") % 90)).alias("b"))
    return records.overlaps(o, "o_custkey", "o_orderkey", "a", "b").select("o_custkey", "o_orderkey")


@query("""SELECT o_orderkey FROM orders WHERE epoch(o_orderdate) <= 852076800 AND 852076800 < epoch(o_orderdate) + 86400 * 200""")
def flt_in_force(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.unix_timestamp("o_orderdate")
    o = table(spark, sf_dir, "orders").select("o_orderkey", t.alias("effective_from"), (t + 86_400 * 200).alias("effective_to"))
    return records.in_force(o, F.lit(852_076_800)).select("o_orderkey")


PARTS = ["market_score", "social_score", "coordination_score", "temporal_score"]


@query(f"""WITH {DETECT_SQL}, n AS (SELECT asset_id, window_start, market_score, social_score, coordination_score, temporal_score,
  (market_score IS NOT NULL)::INT + (social_score IS NOT NULL)::INT + (coordination_score IS NOT NULL)::INT + (temporal_score IS NOT NULL)::INT AS n FROM d)
SELECT asset_id, window_start, round_even(n / 4, 4) AS completeness, concat_ws(',', CASE WHEN market_score IS NULL THEN 'market_score' END, CASE WHEN social_score IS NULL THEN 'social_score' END,
  CASE WHEN coordination_score IS NULL THEN 'coordination_score' END, CASE WHEN temporal_score IS NULL THEN 'temporal_score' END) AS missing FROM n""")
def evd_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.completeness(scored(spark, sf_dir), PARTS).select("asset_id", "window_start", "completeness", F.array_join("missing", ",").alias("missing"))


@query(f"""WITH {DETECT_SQL}, u AS (SELECT asset_id, window_start, unnest([market_score, social_score, coordination_score, temporal_score]) AS v, unnest(['market_score', 'social_score', 'coordination_score', 'temporal_score']) AS n FROM d)
SELECT d.asset_id, d.window_start, coalesce(string_agg(n, ',' ORDER BY abs(v) DESC, n) FILTER (coalesce(v, 0) <> 0), '') AS contributors FROM d JOIN u ON d.asset_id = u.asset_id AND d.window_start = u.window_start GROUP BY ALL""")
def evd_contributors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.contributions(scored(spark, sf_dir), PARTS).select("asset_id", "window_start", F.array_join("contributors", ",").alias("contributors"))


@query("""WITH m AS (SELECT o_orderkey % 300 AS claim_id, o_custkey % 10 AS document_id, o_orderkey AS chunk_id, o_totalprice AS score, CASE WHEN o_orderstatus <> 'O' THEN 'RETROSPECTIVE' WHEN o_orderpriority LIKE '1%' THEN 'CONFLICTING' ELSE 'SUPPORTING' END AS relation FROM orders),
b AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY claim_id, document_id, relation ORDER BY score DESC, chunk_id) = 1)
SELECT claim_id, document_id, chunk_id, relation, row_number() OVER (PARTITION BY claim_id ORDER BY score DESC, chunk_id) AS place FROM b""")
def ver_ranked_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 300).alias("claim_id"), (F.col("o_custkey") % 10).alias("document_id"), F.col("o_orderkey").alias("chunk_id"), F.col("o_totalprice").alias("score"), (F.col("o_orderstatus") == "O").alias("before"), F.col("o_orderpriority").startswith("1").alias("conflict"))
    return records.rank_evidence(m, "claim_id", "document_id", "chunk_id").select("claim_id", "document_id", "chunk_id", "relation", "place")


@query("""WITH d AS (SELECT doc_id % 40 AS document_key, row_number() OVER (PARTITION BY doc_id % 40 ORDER BY doc_id) AS version, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE source END AS asset_id, 1704067200 + doc_id * 60 AS published, 1704067200 + doc_id * 60 + (doc_id % 5) * 86400 AS available FROM documents),
c AS (SELECT item_id AS claim_id, 'src' || (item_id % 20) AS asset_id, 1704067200 + item_id * 7200 AS t FROM benchmark),
n AS (SELECT claim_id, document_key, version, published, available <= t AS before, max(CASE WHEN available <= t THEN version END) OVER (PARTITION BY claim_id, document_key) AS last FROM c JOIN d ON (d.asset_id IS NULL OR d.asset_id = c.asset_id) AND published BETWEEN t - 2592000 AND t + 604800)
SELECT claim_id, document_key, version, before, place FROM (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY published DESC, document_key, version) AS place FROM n WHERE NOT before OR version = last) WHERE place <= 500""")
def ver_candidates_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    doc = table(spark, sf_dir, "documents").select("doc_id", "source")
    published = F.lit(1704067200) + F.col("doc_id") * 60
    key = F.col("doc_id") % 40
    d = doc.select(key.alias("document_key"), F.row_number().over(Window.partitionBy(key).orderBy("doc_id")).alias("version"), F.when(F.col("doc_id") % 3 != 0, F.col("source")).alias("asset_id"), published.alias("published"), (published + (F.col("doc_id") % 5) * 86_400).alias("available"))
    c = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("claim_id"), F.concat(F.lit("src"), F.col("item_id") % 20).alias("asset_id"), (F.lit(1704067200) + F.col("item_id") * 7200).alias("t"))
    return records.candidates_as_of(c, d, 30 * 86_400, 7 * 86_400)


@query("""SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, count(*) AS changes FROM events GROUP BY user_id""")
def qry_fold_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.fold_log(table(spark, sf_dir, "events"), "user_id", "event_type", ["ts", "event_id"], "NONE")


@query(f"""WITH {EVIDENCE_SQL}, l AS (SELECT asset_id, arg_max(evidence_id, (epoch, evidence_id)) AS latest, max(epoch) AS epoch, round(arg_max(score, (epoch, evidence_id)) + 1.7e-11, 9) AS score FROM ev GROUP BY asset_id)
SELECT 'C' || c_custkey AS asset_id, c_name AS name, latest, epoch, score FROM customer LEFT JOIN l ON 'C' || c_custkey = l.asset_id""")
def qry_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every asset with its latest score, if it has one."""
    assets = table(spark, sf_dir, "customer").select(F.concat(F.lit("C"), F.col("c_custkey")).alias("asset_id"), F.col("c_name").alias("name"))
    last = serving.latest(adapters.evidence(spark, sf_dir), ["asset_id"], ["epoch", "evidence_id"]).select("asset_id", F.col("evidence_id").alias("latest"), "epoch", F.round(F.col("score") + 1.7e-11, 9).alias("score"))
    return assets.join(last, "asset_id", "left")


@query(f"""WITH {EVIDENCE_SQL} SELECT asset_id, count(*) AS n, string_agg(CAST(evidence_id AS VARCHAR), ',' ORDER BY epoch, evidence_id) AS evidence FROM ev GROUP BY asset_id""")
def qry_campaign_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.alert_trail(adapters.evidence(spark, sf_dir), "asset_id", ["epoch", "evidence_id"], "evidence_id")


@query("""SELECT o_orderkey AS case_id, o_orderstatus AS status, epoch(o_orderdate) < 852076800 AND o_orderstatus <> 'F' AS breached FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')""")
def qry_investigations(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"))
    return serving.cases(o, F.unix_timestamp("o_orderdate"), F.col("o_orderstatus"), 852_076_800, "F").select(F.col("o_orderkey").alias("case_id"), F.col("o_orderstatus").alias("status"), "breached")


@query("""SELECT c_nationkey AS list_id, n_name AS name, count(*) AS assets, md5(string_agg(CAST(c_custkey AS VARCHAR), ',' ORDER BY c_custkey)) AS assets_hash FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL""")
def qry_watchlists(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("list_id"), "c_custkey")
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("list_id"), F.col("n_name").alias("name"))
    return serving.watchlists(c, n, "list_id", "c_custkey").select("list_id", "name", "assets", "assets_hash")


@query("""SELECT event_type AS topic, user_id % 6 AS partition, max(event_id) AS last_offset, max(epoch_us(ts)) AS last_event FROM events GROUP BY ALL""")
def qry_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.progress(table(spark, sf_dir, "events"), "event_type", F.col("user_id") % 6, "event_id", F.unix_micros(F.col("ts").cast("timestamp")))


@query("""SELECT event_type AS reason, user_id % 10 AS model_id, count(*) AS n FROM events WHERE epoch(ts) >= 1704672000 AND epoch(ts) < 1705881600 GROUP BY ALL""")
def gov_false_positives(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumns({"reason": F.col("event_type"), "model_id": F.col("user_id") % 10})
    return evaluation.false_positives(e, F.unix_micros(F.col("ts").cast("timestamp")) / 1e6, 1704672000, 1705881600, ["reason", "model_id"])


@query("""SELECT user_id AS model_id, CASE WHEN arg_max(value, (ts, event_id)) >= 300 THEN 'DRIFTED' ELSE 'STABLE' END AS drift FROM events WHERE event_type = 'error' GROUP BY ALL""")
def gov_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("event_type = 'error'").withColumnRenamed("user_id", "model_id")
    return evaluation.last_drift(e, "model_id", ["ts", "event_id"], "value", 300)


@query(f"""WITH {FUSE_SQL}, s AS (SELECT asset_id, window_start, severity, fusion_score, {LEVEL('least(1.0, greatest(0.0, coalesce((coalesce(market_score * 0.75, 0) + coalesce(social_score * 0.25, 0)) / nullif(CASE WHEN market_score IS NULL THEN 0 ELSE 0.75 END + CASE WHEN social_score IS NULL THEN 0 ELSE 0.25 END, 0), 0)))')} AS shadow FROM f)
SELECT severity, shadow, count(*) AS n, count(*) FILTER (severity = shadow) AS agreeing FROM s GROUP BY ALL""")
def evl_shadow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Severities of another model's weights beside the champion's."""
    return evaluation.agreement(evaluation.shadow(scored(spark, sf_dir), {"market_score": 0.75, "social_score": 0.25}))


@query(f"""WITH {THREADS_SQL},
n AS (SELECT thread_id, author_id, count(*) AS n FROM th GROUP BY ALL), p AS (SELECT *, sum(n) OVER (PARTITION BY thread_id) AS total FROM n),
a AS (SELECT thread_id, sum(n) AS posts, max(n / total) AS conc, CASE WHEN count(*) > 1 THEN sum(-(n / total) * ln(n / total)) / ln(count(*)) ELSE 0 END AS ent FROM p GROUP BY thread_id),
g AS (SELECT thread_id, epoch - lag(epoch) OVER (PARTITION BY thread_id ORDER BY epoch, post_id) AS gap FROM th), y AS (SELECT thread_id, coalesce(avg(CAST(gap <= 5 AS DOUBLE)), 0) AS sync FROM g GROUP BY thread_id),
o1 AS (SELECT thread_id, author_id, count(*) AS k FROM th GROUP BY ALL UNION ALL SELECT thread_id, lower(string_split(text, ' ')[1]), count(*) FROM th WHERE text IS NOT NULL GROUP BY ALL), o AS (SELECT thread_id, max(k) AS k FROM o1 GROUP BY ALL),
d1 AS (SELECT thread_id, turns, CASE WHEN turns > 0 THEN turns - 1 ELSE 0 END AS depth FROM (SELECT thread_id, count(*) AS turns FROM th GROUP BY ALL)),
v AS (SELECT thread_id, avg(least(1.0, length(text) / 100.0)) AS sim FROM th GROUP BY ALL)
SELECT thread_id, round(least(1.0, greatest(0.0, 0.22 * conc + 0.20 * sync + 0.18 * least(1.0, o.k / posts) + 0.15 * least(1.0, depth / 5) + 0.15 * sim + 0.10 * (1 - ent))) + 1.7e-11, 9) AS graph_score FROM a JOIN y USING (thread_id) JOIN o USING (thread_id) JOIN d1 USING (thread_id) JOIN v USING (thread_id)""")
def grf_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All six terms: an author counts as the repeated url, a first word as the tag, and the lengths of texts stand for the
    similarity of nodes, which embeddings would give."""
    th = adapters.threads(spark, sf_dir)
    words = F.when(F.col("text").isNotNull(), F.array(F.get(F.split("text", " "), F.lit(0)))).otherwise(F.expr("cast(array() as array<string>)"))
    parts = [
        graph.authorship(th, "thread_id"), graph.synchronized(th, "thread_id"), graph.depth(th, "thread_id"),
        records.amplifier_overlap(th.withColumns({"urls": F.array("author_id"), "tags": words}), "thread_id", "urls", "tags"), th.groupBy("thread_id").agg(F.avg(F.least(F.lit(1.0), F.length("text") / 100.0)).alias("node_similarity")),
    ]
    f = parts[0]
    for p in parts[1:]:
        f = f.join(p, "thread_id")
    return graph.score(f).select("thread_id", F.round(F.col("graph_score") + 1.7e-11, 9).alias("graph_score"))


@query("""SELECT page_id, md5(trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(html, '(?s)<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&apos;', ''''), '&nbsp;', ' '), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'), '\\s+', ' ', 'g'))) AS text_hash FROM pages""")
def src_plain_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.md5(landing.plain_text(F.col("html"))).alias("text_hash"))


@query(f"""WITH {SIGNALS_SQL} SELECT source_domain, count(*) AS seen, CASE source_domain WHEN 'market' THEN 4500 ELSE 5000 END AS expected FROM sig GROUP BY ALL""")
def src_expected_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    expected = spark.createDataFrame([("market", 4500), ("social", 5000)], "source_domain string, expected int")
    return serving.expected_counts(adapters.signals(spark, sf_dir), expected, "source_domain")


@query("""WITH s AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS source_sequence FROM events) SELECT event_id, 'replay-1' AS scope_id, source_sequence FROM s""")
def src_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("source"), F.col("ts").alias("event_time"), F.lit(None).cast("long").alias("source_sequence"))
    return landing.replayed(e, "replay-1", ["event_time", "event_id"]).select("event_id", "scope_id", "source_sequence")




@query(f"""WITH {SIGNALS_SQL}, p AS (SELECT asset_id, event_id AS post_id, epoch(event_time) AS e FROM sig WHERE kind = 'SOCIAL_POST'),
w AS (SELECT DISTINCT asset_id, CAST(floor(epoch(event_time) / 21600) * 21600 AS BIGINT) AS window_start FROM sig WHERE kind = 'MARKET_TRADE')
SELECT asset_id, window_start, post_id FROM p JOIN w USING (asset_id) WHERE e >= window_start AND e < window_start + 21600""")
def nar_posts_in_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = adapters.signals(spark, sf_dir)
    t = F.unix_micros(F.col("event_time").cast("timestamp")) / 1e6
    w = s.where("kind = 'MARKET_TRADE'").select("asset_id", (F.floor(t / 21_600) * 21_600).cast("long").alias("window_start"), F.lit(21_600).alias("interval_seconds")).distinct()
    p = s.where("kind = 'SOCIAL_POST'").select("asset_id", F.col("event_id").alias("post_id"), t.alias("epoch"))
    return records.posts_in_windows(w, p).select("asset_id", "window_start", "post_id")


@query("""SELECT user_id % 40 AS indicator, min(epoch_us(ts)) AS first_seen, max(epoch_us(ts)) AS last_seen, count(*) AS observations FROM events GROUP BY ALL""")
def thr_observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 40).alias("indicator"), F.unix_micros(F.col("ts").cast("timestamp")).alias("seen"), "event_type")
    return records.observed(e.where("event_type = 'view'"), e.where("event_type <> 'view'"), ["indicator"], "seen")


@query("""SELECT l_partkey, l_orderkey, l_linenumber, l_suppkey, l_quantity FROM lineitem QUALIFY rank() OVER (PARTITION BY l_partkey ORDER BY l_shipdate DESC) = 1""")
def thr_last_with_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.last_with_ties(table(spark, sf_dir, "lineitem"), "l_partkey", "l_shipdate").select("l_partkey", "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity")


@query("""SELECT event_id AS delivery_id, user_id AS next_attempt FROM events WHERE event_type IN ('view', 'click') AND user_id <= 100 ORDER BY user_id, event_id LIMIT 50""")
def ntf_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("event_type") == "view", "PENDING").when(F.col("event_type") == "click", "RETRY").otherwise("DELIVERED")
    d = table(spark, sf_dir, "events").select(F.col("event_id").alias("delivery_id"), status.alias("status"), F.col("user_id").alias("next_attempt"))
    return records.due(d, 100).select("delivery_id", "next_attempt")


@query("""WITH r AS (SELECT c_custkey AS policy, 0 AS t, round(c_acctbal, 2) AS trust FROM customer UNION ALL SELECT o_custkey, CAST(epoch(o_orderdate) AS BIGINT) * 100000 + o_orderkey, round(o_totalprice, 2) FROM orders)
SELECT policy, t AS effective_from, lead(t) OVER w AS effective_to, trust, row_number() OVER w AS version FROM r WINDOW w AS (PARTITION BY policy ORDER BY t)""")
def ver_patched_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("policy"), F.lit(0).cast("long").alias("effective_from"), F.lit(None).cast("long").alias("effective_to"), F.round("c_acctbal", 2).alias("trust"))
    c = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("policy"), (F.unix_timestamp("o_orderdate") * 100_000 + F.col("o_orderkey")).alias("at"), F.round("o_totalprice", 2).alias("trust"))
    return records.patched(p, c, "policy")


@query(f"""WITH {EVIDENCE_SQL}, n AS (SELECT asset_id, count(*) AS n FROM ev GROUP BY ALL), c AS (SELECT 'C' || c_custkey AS asset_id, c_mktsegment AS segment FROM customer)
SELECT evidence_id, ev.asset_id, n AS campaign_n, segment FROM ev LEFT JOIN n ON ev.asset_id = n.asset_id LEFT JOIN c ON ev.asset_id = c.asset_id""")
def evd_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = adapters.evidence(spark, sf_dir)
    n = ev.groupBy("asset_id").agg(F.count(F.lit(1)).alias("n"))
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("C"), F.col("c_custkey")).alias("asset_id"), "c_mktsegment")
    out = records.assemble(ev.select("evidence_id", "asset_id"), {"campaign": n, "asset": c}, ["asset_id"])
    return out.select("evidence_id", "asset_id", F.col("campaign.n").alias("campaign_n"), F.col("asset.c_mktsegment").alias("segment"))


@query(f"""WITH {SIGNALS_SQL}, p AS (SELECT asset_id, url, hashtag FROM sig WHERE kind = 'SOCIAL_POST'), n AS (SELECT asset_id, count(*) AS n FROM p GROUP BY ALL),
m AS (SELECT asset_id, max(k) AS k FROM (SELECT asset_id, url, count(*) AS k FROM p GROUP BY ALL UNION ALL SELECT asset_id, hashtag, count(*) FROM p GROUP BY ALL) GROUP BY asset_id)
SELECT asset_id, round(least(1.0, k / n) + 1.7e-11, 9) AS repeated_amplifier_overlap FROM n JOIN m USING (asset_id)""")
def grf_amplifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = adapters.signals(spark, sf_dir).where("kind = 'SOCIAL_POST'")
    return records.amplifier_overlap(p, "asset_id", "urls", "hashtags").select("asset_id", F.round(F.col("repeated_amplifier_overlap") + 1.7e-11, 9).alias("repeated_amplifier_overlap"))
