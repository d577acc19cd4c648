"""Queries on live feeds and filtered search, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators import narratives
from tidewatch.sources.adapters import table
from tidewatch.streaming import live_feed

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query("""WITH k AS (SELECT event_type AS feed, event_id, CAST(user_id AS VARCHAR) AS body, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS r FROM events),
o AS (SELECT feed, min(event_id) AS oldest, max(event_id) AS newest FROM k WHERE r <= 500 GROUP BY feed),
s AS (SELECT feed, oldest, n_name AS subscriber, CASE n_nationkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 10 WHEN 2 THEN newest - n_nationkey * 20 END AS after FROM o, nation)
SELECT s.feed, subscriber, event_id, 'event' AS kind, body FROM s JOIN k ON s.feed = k.feed AND r <= 500 AND event_id > after WHERE after = 0 OR after >= oldest
UNION ALL SELECT feed, subscriber, oldest, 'stream.reset_required', NULL FROM s WHERE after > 0 AND after < oldest""")
def src_live_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A feed for each type of event, and subscribers from the start, from an old cursor, from a late one, and from now on."""
    e = table(spark, sf_dir, "events")
    last = e.groupBy(F.col("event_type").alias("feed")).agg(F.max("event_id").alias("newest"))
    n = table(spark, sf_dir, "nation").select("n_name", F.col("n_nationkey").alias("n"))
    kind = F.col("n") % 4
    cursor = F.when(kind == 0, F.lit(0)).when(kind == 1, F.lit(10)).when(kind == 2, F.col("newest") - F.col("n") * 20)
    asked = live_feed.subscribed(last.join(n), F.col("feed"), F.col("n_name"), cursor)  # 25 nations, five feeds
    rows = live_feed.published(e, F.col("event_type"), F.col("event_id"), F.col("user_id")).unionByName(asked)
    return live_feed.live_feed(rows, 500)


@query("""WITH q AS (SELECT * FROM embeddings WHERE vec_id % 20 = 0),
p AS (SELECT q.vec_id AS query_id, e.vec_id, least(1.0, greatest(0.0, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])))) AS s FROM q JOIN embeddings e ON q.vec_id <> e.vec_id AND q.label IS NOT DISTINCT FROM e.label AND e.vec_id % 3 <> 1)
SELECT query_id, vec_id, round(s + 1.7e-11, 9) AS similarity, r AS place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS r FROM p) WHERE r <= 5""")
def nar_nearest_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of one label whose payload (vec_id mod 3 is not 1) passes, of every row whose id is divisible by 20."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    out = narratives.nearest(e.where("id % 20 = 0"), e, 5, within=("label",), where=F.expr("id % 3 <> 1"))
    return out.select("query_id", F.col("id").alias("vec_id"), F.round(F.col("similarity") + 1.7e-11, 9).alias("similarity"), "place")
