"""Queries on the typed coordination graph, and on scores made of what the graph, claim and threat operators give, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators import graph, narratives, threat
from tidewatch.plans.core import DETECT_SQL, rounded, window_features
from tidewatch.plans.lifecycle import FUSION_SQL, R
from tidewatch.plans.records import ORACLES as RECORDS_SQL
from tidewatch.plans.records import grf_score
from tidewatch.plans.texts import ORACLES as TEXTS_SQL
from tidewatch.plans.texts import ver_verdicts
from tidewatch.sources import adapters
from tidewatch.sources.adapters import THREADS_SQL, table
from tidewatch.streaming import rescoring

QUERIES, ORACLES = {}, {}
CUTOFF = 1704067200 + 90 * 3600


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def coordinated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as posts of an asset: every fourth reposts the turn before last in place of a reply; the first of each fifth thread
    replies to a post from elsewhere; some have an address or a tag."""
    th = adapters.threads(spark, sf_dir)
    turn = F.element_at(F.split("post_id", ":"), 2).cast("int")
    post = lambda n: F.concat_ws(":", F.col("thread_id").cast("string"), n.cast("string"))
    empty = F.expr("cast(array() as array<string>)")
    return th.select(
        "thread_id", "post_id", "author_id", "epoch", F.concat(F.lit("A"), F.col("thread_id") % 20).alias("asset_id"), F.concat(F.lit("n"), F.col("thread_id") % 7).alias("narrative_id"), F.lit("LIVE").alias("scope_id"),
        F.when((turn == 0) & (F.col("thread_id") % 5 == 0), F.concat(F.lit("ext:"), F.col("thread_id"))).when(turn % 4 != 3, F.col("reply_to")).alias("reply_to"), F.when(turn % 4 == 3, post(turn - 2)).alias("repost_of"),
        F.when(turn % 3 == 0, F.array(F.lit("http://h.example/"))).otherwise(empty).alias("urls"), F.when(turn % 4 == 1, F.array(F.lit("x"))).otherwise(empty).alias("hashtags"),
    )


def groups(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    posts = coordinated(spark, sf_dir)
    n = F.substring("asset_id", 2, 9).cast("int")
    assets = posts.select("asset_id").distinct()
    alerts = assets.where(n % 4 == 0).select("asset_id", F.explode(F.array(F.concat(F.lit("p"), "asset_id"), F.concat(F.lit("q"), "asset_id"))).alias("alert_id"))
    return posts, assets.where(n < 10).select("asset_id", F.concat(F.lit("c"), "asset_id").alias("campaign_id")), alerts


POSTS_SQL = f"""{THREADS_SQL},
t0 AS (SELECT *, CAST(split_part(post_id, ':', 2) AS INTEGER) AS turn FROM th),
po AS (
  SELECT thread_id, post_id, author_id, epoch, 'A' || (thread_id % 20) AS asset_id, 'n' || (thread_id % 7) AS narrative_id, 'LIVE' AS scope_id,
    CASE WHEN turn = 0 AND thread_id % 5 = 0 THEN 'ext:' || thread_id WHEN turn % 4 <> 3 THEN reply_to END AS reply_to, CASE WHEN turn % 4 = 3 THEN thread_id || ':' || (turn - 2) END AS repost_of, turn % 3 = 0 OR turn % 4 IN (1, 3) AS amplifies FROM t0),
pc AS (SELECT * FROM po WHERE epoch <= {CUTOFF}), ga AS (SELECT DISTINCT asset_id, narrative_id, CAST(asset_id[2:] AS INTEGER) AS n FROM pc),
al AS (SELECT asset_id, narrative_id, unnest(['p' || asset_id, 'q' || asset_id]) AS alert_id FROM ga WHERE n % 4 = 0),
ed AS (
  SELECT 'Actor' AS src_label, author_id AS src, 'POSTED' AS relation, 'Post' AS dst_label, post_id AS dst FROM pc UNION SELECT 'Post', post_id, 'MENTIONS', 'Asset', asset_id FROM pc
  UNION SELECT 'Post', post_id, 'MEMBER_OF', 'Narrative', narrative_id FROM pc UNION SELECT 'Post', post_id, 'REPLIES_TO', 'Post', reply_to FROM pc WHERE reply_to IS NOT NULL
  UNION SELECT 'Post', post_id, 'REPOSTS', 'Post', repost_of FROM pc WHERE repost_of IS NOT NULL UNION SELECT 'Post', post_id, 'AMPLIFIES', 'Narrative', narrative_id FROM pc WHERE amplifies
  UNION SELECT 'Campaign', 'c' || asset_id, 'TARGETS', 'Asset', asset_id FROM ga WHERE n < 10 UNION SELECT 'Narrative', narrative_id, 'EVIDENCE_FOR', 'Campaign', 'c' || asset_id FROM ga WHERE n < 10
  UNION SELECT 'Narrative', narrative_id, 'EVIDENCE_FOR', 'Alert', alert_id FROM al)"""
COUNTS_SQL = """
c1 AS (SELECT asset_id, count(DISTINCT author_id) + count(*) + count(DISTINCT narrative_id) + 1 AS n, sum(3 + CAST(reply_to IS NOT NULL AS INTEGER) + CAST(repost_of IS NOT NULL AS INTEGER) + CAST(amplifies AS INTEGER)) AS r FROM pc GROUP BY ALL),
pr AS (SELECT asset_id, n + CASE WHEN CAST(asset_id[2:] AS INTEGER) < 10 THEN 1 ELSE 0 END + CASE WHEN CAST(asset_id[2:] AS INTEGER) % 4 = 0 THEN 2 ELSE 0 END AS nodes, CAST(r AS BIGINT) AS relations FROM c1)"""


@query(f"WITH {POSTS_SQL} SELECT * FROM ed")
def grf_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All eight relations, each once."""
    return graph.relations(*groups(spark, sf_dir), "asset_id", CUTOFF)


@query(f"""WITH {POSTS_SQL}, e AS (SELECT src_label AS label, src AS id FROM ed UNION SELECT dst_label, dst FROM ed)
SELECT label, id, epoch AS event_epoch, scope_id FROM e LEFT JOIN pc ON label = 'Post' AND id = post_id""")
def grf_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes after two batches, of which the second holds the later posts and half of the first ones again."""
    posts, campaigns, alerts = groups(spark, sf_dir)
    first = graph.nodes(posts, campaigns, alerts, "asset_id", CUTOFF - 30 * 3600, 1)
    second = graph.nodes(posts.where(f"epoch > {CUTOFF - 60 * 3600}"), campaigns, alerts, "asset_id", CUTOFF, 2)
    return graph.merged(first.unionByName(second)).select("label", "id", "event_epoch", "scope_id")


@query(f"WITH {POSTS_SQL}, {COUNTS_SQL} SELECT * FROM pr")
def grf_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.projection_counts(*groups(spark, sf_dir), "asset_id", CUTOFF)


@query(f"""WITH RECURSIVE {POSTS_SQL}, up AS (SELECT thread_id, post_id, coalesce(reply_to, repost_of) AS parent FROM po),
c AS (
  SELECT thread_id, post_id, 0 AS d FROM up WHERE parent IS NULL OR parent NOT IN (SELECT post_id FROM up)
  UNION ALL SELECT up.thread_id, up.post_id, c.d + 1 FROM up JOIN c ON up.parent = c.post_id AND up.thread_id = c.thread_id)
SELECT thread_id, max(d) AS propagation_depth FROM c GROUP BY thread_id""")
def grf_repost_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains that go on over replies and reposts."""
    return graph.depth(coordinated(spark, sf_dir), "thread_id")


@query(f"""WITH {POSTS_SQL}, {COUNTS_SQL}, gs AS ({RECORDS_SQL['grf_score']}),
w AS (SELECT DISTINCT thread_id, 'A' || (thread_id % 20) AS asset_id, 1 + thread_id % 3 AS revision FROM th), s AS (SELECT w.*, CASE WHEN thread_id % 5 <> 2 THEN graph_score END AS graph_score, thread_id % 11 = 3 AS failed FROM w JOIN gs USING (thread_id)),
h AS (SELECT s.*, pr.nodes, pr.relations, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('graph:' || thread_id || ':' || revision)) AS h FROM s LEFT JOIN pr USING (asset_id))
SELECT thread_id, CASE WHEN failed THEN 0 ELSE coalesce(nodes, 0) END AS nodes, CASE WHEN failed THEN 0 ELSE coalesce(relations, 0) END AS relations, CASE WHEN graph_score IS NULL THEN 'MISSING' ELSE 'AVAILABLE' END AS graph_score_status,
  CASE WHEN failed THEN 'DEGRADED' ELSE 'COMPLETE' END AS projection_status,
  substring(h, 1, 8) || '-' || substring(h, 9, 4) || '-5' || substring(h, 14, 3) || '-' || printf('%02x', (CAST('0x' || substring(h, 17, 2) AS INTEGER) & 63) | 128) || substring(h, 19, 2) || '-' || substring(h, 21, 12) AS graph_snapshot_id FROM h""")
def grf_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graph snapshots of threads as windows: some without a score, some whose projection failed."""
    windows = adapters.threads(spark, sf_dir).select("thread_id").distinct().withColumn("revision", 1 + F.col("thread_id") % 3)
    counts = graph.projection_counts(*groups(spark, sf_dir), "asset_id", CUTOFF)
    projected = windows.select("thread_id", F.concat(F.lit("A"), F.col("thread_id") % 20).alias("asset_id")).join(counts, "asset_id").drop("asset_id")
    out = narratives.graph_snapshots(windows, grf_score(spark, sf_dir).where("thread_id % 5 <> 2"), projected, ["thread_id"], F.col("thread_id") % 11 == 3)
    return out.select("thread_id", "nodes", "relations", "graph_score_status", "projection_status", "graph_snapshot_id")


def inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts of all windows: features of the events, graph scores of the threads of a window, claims of its asset, threats known at its
    end. Of graph and verification there is an earlier revision too, which no longer counts."""
    f = window_features(spark, sf_dir)
    slot = lambda c: (F.floor(c / 21_600) * 21_600).cast("long")
    key = lambda rows: rows.withColumns({"scope_id": F.lit("LIVE"), "interval_seconds": F.lit(21_600)})
    at = F.lit(1704067200) + F.col("thread_id") * 3600
    g = key(grf_score(spark, sf_dir).select(F.concat(F.lit("A"), F.col("thread_id") % 20).alias("asset_id"), slot(at).alias("window_start"), "graph_score"))
    v = ver_verdicts(spark, sf_dir).select(F.concat(F.lit("A"), F.col("claim_id") % 20).alias("asset_id"), (F.lit(1704067200) + 21_600 * (F.col("claim_id") % 116)).alias("window_start"), "claim_risk", "legitimate")
    v = key(v.groupBy("asset_id", "window_start").agg(F.max("claim_risk").alias("claim_risk"), F.max("legitimate").alias("legitimate_event_score")))
    e = table(spark, sf_dir, "events").where("event_type = 'error' and value > 480")
    seen = F.round(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).cast("long")
    hits = e.select(F.concat(F.lit("A"), F.col("user_id") % 20).alias("asset_id"), F.col("event_id").alias("match_id"), seen.alias("epoch"), (seen + 3600).alias("fetched_at"))
    known = threat.context(f.select("asset_id", F.col("window_end").alias("cutoff")), hits)
    t = key(known.select("asset_id", (F.col("cutoff") - 21_600).alias("window_start"), F.col("status").alias("threat_status"), "threat_score", F.lit(0.7).alias("threat_confidence")))
    part = rescoring.part
    out = part(f, "FEATURES").unionAll(part(g, "GRAPH", F.lit(2))).unionAll(part(v, "VERIFICATION", F.lit(2))).unionAll(part(t, "THREAT"))
    return out.unionAll(part(g.withColumn("graph_score", F.lit(0.0)), "GRAPH")).unionAll(part(v.withColumn("claim_risk", F.lit(0.5)), "VERIFICATION"))


@query(f"""WITH {DETECT_SQL}, gs AS ({RECORDS_SQL['grf_score']}), gp AS (SELECT 'A' || (thread_id % 20) AS asset_id, CAST(floor((1704067200 + thread_id * 3600) / 21600) * 21600 AS BIGINT) AS window_start, graph_score FROM gs),
vs AS ({TEXTS_SQL['ver_verdicts']}), vp AS (SELECT 'A' || (claim_id % 20) AS asset_id, 1704067200 + 21600 * (claim_id % 116) AS window_start, max(claim_risk) AS claim_risk, max(legitimate) AS legitimate FROM vs GROUP BY ALL),
hi AS (SELECT 'A' || (user_id % 20) AS asset_id, CAST(epoch(ts) AS BIGINT) AS at FROM events WHERE event_type = 'error' AND value > 480),
tp AS (SELECT d.asset_id, d.window_start, least(20, count(hi.at)) AS hits FROM d LEFT JOIN hi ON hi.asset_id = d.asset_id AND hi.at + 3600 <= d.window_start + 21600 GROUP BY ALL),
g AS (SELECT d.*, claim_risk, legitimate, graph_score, CASE WHEN hits > 0 THEN 'MATCHED' ELSE 'NO_MATCH' END AS ts, least(1.0, hits / 3) AS tscore, 0.7 AS tc FROM d LEFT JOIN gp USING (asset_id, window_start) LEFT JOIN vp USING (asset_id, window_start) LEFT JOIN tp USING (asset_id, window_start)),
{FUSION_SQL} SELECT asset_id, window_start, severity, profile AS enrichment_profile, n_missing, {R('fusion_score')} AS fusion_score, {R('confidence')} AS confidence FROM fu""")
def fus_rescored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scores that re-scoring ends in, of what the graph, claim and threat operators give."""
    out = rescoring.scores(rescoring.latest_inputs(inputs(spark, sf_dir)))
    return rounded(out.select("asset_id", "window_start", "severity", "enrichment_profile", F.size("missing_outputs").alias("n_missing"), "fusion_score", "confidence"))
