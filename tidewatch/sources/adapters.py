"""The given tables as inputs of the surveillance operators (see FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ASSETS = 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as feature signals: purchases are trades, views order books, clicks posts, signups mentions, errors quality rows."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    kind = {"purchase": "MARKET_TRADE", "view": "ORDERBOOK", "click": "SOCIAL_POST", "signup": "ASSET_MENTION", "error": "DATA_QUALITY"}
    is_a = lambda t: F.col("event_type") == t
    pick = lambda t, c: F.when(is_a(t), c)
    domain = F.when(F.col("event_type").isin("purchase", "view"), "market").when(is_a("error"), F.when(F.col("event_id") % 2 == 0, "market").otherwise("social")).otherwise("social")
    return e.select(
        F.col("event_id").cast("string").alias("event_id"), F.lit("LIVE").alias("scope_id"), F.concat(F.lit("A"), F.col("user_id") % ASSETS).alias("asset_id"),
        F.col("ts").alias("event_time"), (F.col("ts") + F.make_dt_interval(secs=k)).alias("ingested_at"),
        F.element_at(F.create_map(*(F.lit(x) for p in kind.items() for x in p)), F.col("event_type")).alias("kind"), domain.alias("source_domain"),
        pick("purchase", F.col("value")).alias("price"), pick("purchase", k.cast("double")).alias("quantity"), pick("purchase", F.when(F.col("event_id") % 2 == 0, "BUY").otherwise("SELL")).alias("side"),
        F.lit(None).cast("double").alias("close"), F.lit(None).cast("double").alias("volume"), F.lit(None).cast("double").alias("baseline_volume"),
        pick("view", F.col("value") / 10000).alias("spread"), pick("view", k.cast("double")).alias("top_n_depth"), pick("view", (k - 50) / 50.0).alias("imbalance"), pick("view", F.col("event_id") % 10 != 0).alias("book_valid"),
        pick("click", F.col("user_id").cast("string")).alias("author_id"), pick("click", F.array(F.concat(F.lit("k"), k % 5))).alias("hashtags"), pick("click", F.array(F.concat(F.lit("http://h"), k % 7, F.lit(".example/")))).alias("urls"),
        F.lit(None).cast("string").alias("reply_to"), pick("click", F.when(k % 3 == 0, (F.col("event_id") - 1).cast("string"))).alias("repost_of"),
        pick("error", k % 4).alias("source_gap_count"), pick("error", F.lit(True)).alias("source_active"), pick("error", F.lit(False)).alias("source_idle"), pick("error", F.col("value") > 250).alias("source_degraded"),
    )


#: The same in DuckDB's SQL, as the first of a query's common table expressions.
SIGNALS_SQL = """
k0 AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
sig AS (
  SELECT CAST(event_id AS VARCHAR) AS event_id, 'LIVE' AS scope_id, 'A' || (user_id % 20) AS asset_id, ts AS event_time, ts + to_seconds(k) AS ingested_at,
    CASE event_type WHEN 'purchase' THEN 'MARKET_TRADE' WHEN 'view' THEN 'ORDERBOOK' WHEN 'click' THEN 'SOCIAL_POST' WHEN 'signup' THEN 'ASSET_MENTION' WHEN 'error' THEN 'DATA_QUALITY' END AS kind,
    CASE WHEN event_type IN ('purchase', 'view') THEN 'market' WHEN event_type = 'error' AND event_id % 2 = 0 THEN 'market' ELSE 'social' END AS source_domain,
    CASE WHEN event_type = 'purchase' THEN value END AS price, CASE WHEN event_type = 'purchase' THEN CAST(k AS DOUBLE) END AS quantity,
    CASE WHEN event_type = 'purchase' THEN CASE WHEN event_id % 2 = 0 THEN 'BUY' ELSE 'SELL' END END AS side,
    CASE WHEN event_type = 'view' THEN value / 10000 END AS spread, CASE WHEN event_type = 'view' THEN CAST(k AS DOUBLE) END AS top_n_depth,
    CASE WHEN event_type = 'view' THEN (k - 50) / 50.0 END AS imbalance, CASE WHEN event_type = 'view' THEN event_id % 10 <> 0 END AS book_valid,
    CASE WHEN event_type = 'click' THEN CAST(user_id AS VARCHAR) END AS author_id, CASE WHEN event_type = 'click' THEN 'k' || (k % 5) END AS hashtag,
    CASE WHEN event_type = 'click' THEN 'http://h' || (k % 7) || '.example/' END AS url,
    CASE WHEN event_type = 'click' AND k % 3 = 0 THEN CAST(event_id - 1 AS VARCHAR) END AS repost_of,
    CASE WHEN event_type = 'error' THEN k % 4 END AS source_gap_count, CASE WHEN event_type = 'error' THEN value > 250 END AS source_degraded
  FROM k0)"""


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as trades of parts: the bench's large input."""
    li = table(spark, sf_dir, "lineitem")
    rid = F.sha2(F.concat_ws("|", *(F.col(c).cast("string") for c in li.columns)), 256)
    side = F.when(F.col("l_returnflag") == "A", "BUY").when(F.col("l_returnflag") == "R", "SELL")
    none = lambda t: F.lit(None).cast(t)
    return li.select(
        rid.alias("event_id"), F.lit("LIVE").alias("scope_id"), F.col("l_partkey").cast("string").alias("asset_id"), F.col("l_shipdate").alias("event_time"), F.col("l_shipdate").alias("ingested_at"),
        F.lit("MARKET_TRADE").alias("kind"), F.lit("market").alias("source_domain"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_quantity").alias("quantity"), side.alias("side"),
        *(none("double").alias(c) for c in ("close", "volume", "baseline_volume", "spread", "top_n_depth", "imbalance")), none("boolean").alias("book_valid"), none("string").alias("author_id"),
        none("array<string>").alias("hashtags"), none("array<string>").alias("urls"), none("string").alias("reply_to"), none("string").alias("repost_of"), none("int").alias("source_gap_count"),
        *(none("boolean").alias(c) for c in ("source_active", "source_idle", "source_degraded")),
    )


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as posts of an author (their source), a minute apart."""
    d = table(spark, sf_dir, "documents")
    at = F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 60)
    return d.select(F.col("doc_id").alias("post_id"), F.col("source").alias("author_id"), at.alias("event_time"), "text", "lang")


def threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as posts that reply to the turn before."""
    c = table(spark, sf_dir, "conversations")
    post = F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    parent = F.when(F.col("turn") > 0, F.concat_ws(":", F.col("conv_id").cast("string"), (F.col("turn") - 1).cast("string")))
    at = F.lit(1704067200) + F.col("conv_id") * 3600 + F.col("turn") * 3
    return c.select(F.col("conv_id").alias("thread_id"), post.alias("post_id"), F.concat("role", (F.col("conv_id") % 50).cast("string")).alias("author_id"), at.alias("epoch"), parent.alias("reply_to"), "text")


THREADS_SQL = """
th AS (
  SELECT conv_id AS thread_id, conv_id || ':' || turn AS post_id, role || (conv_id % 50) AS author_id, 1704067200 + conv_id * 3600 + turn * 3 AS epoch,
    CASE WHEN turn > 0 THEN conv_id || ':' || (turn - 1) END AS reply_to, text FROM conversations)"""


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as scored evidence of an asset (their customer)."""
    o = table(spark, sf_dir, "orders")
    score = F.col("o_totalprice") / 500000.0
    return o.select(F.col("o_orderkey").alias("evidence_id"), F.concat(F.lit("C"), F.col("o_custkey")).alias("asset_id"), F.unix_timestamp("o_orderdate").alias("epoch"), F.least(F.lit(1.0), score).alias("score"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))


EVIDENCE_SQL = """
ev AS (
  SELECT o_orderkey AS evidence_id, 'C' || o_custkey AS asset_id, CAST(epoch(o_orderdate) AS BIGINT) AS epoch, least(1.0, o_totalprice / 500000.0) AS score,
    o_orderstatus AS status, o_orderpriority AS priority FROM orders)"""
