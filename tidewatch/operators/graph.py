"""Coordination graph features of groups of posts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.exprs import clamp
from tidewatch.sources.tables import shared_folder


def authorship(posts: DataFrame, group: str) -> DataFrame:
    """Per group: posts, authors, concentration, entropy of authors, spread."""
    n = posts.groupBy(group, "author_id").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(group))
    p = F.col("n") / F.col("total")
    out = n.withColumn("total", total).groupBy(group).agg(F.sum("n").alias("posts"), F.count(F.lit(1)).alias("authors"), F.max(p).alias("community_concentration"), F.sum(-p * F.ln(p)).alias("h"))
    entropy = F.when(F.col("authors") > 1, F.col("h") / F.ln("authors")).otherwise(0.0)
    return out.select(group, "posts", "authors", "community_concentration", entropy.alias("community_entropy"), F.least(F.lit(1.0), F.col("authors") / F.col("posts")).alias("cross_community_spread"))


def synchronized(posts: DataFrame, group: str, within: int = 5) -> DataFrame:
    """Per group: the share of gaps between consecutive posts of at most `within` seconds; 0 for one post."""
    gap = F.col("epoch") - F.lag("epoch").over(Window.partitionBy(group).orderBy("epoch", "post_id"))
    return posts.withColumn("gap", gap).groupBy(group).agg(F.coalesce(F.avg((F.col("gap") <= within).cast("double")), F.lit(0.0)).alias("synchronized_posting"))


def climbed(posts: DataFrame, group: str, largest: int) -> DataFrame:
    """posts: (group, id, up). Pointer doubling: after i rounds each post knows the ancestor 2^i steps up, so a chain of n
    needs log2(n) joins. Adds d (the steps made), low (the least id met) and top (the last post met); up stays only on
    posts that still climb after as many steps as the largest group has posts: those that come to a cycle."""
    now = posts.select(group, "id", "up", F.when(F.col("up").isNotNull(), 1).otherwise(0).cast("long").alias("d"), F.col("id").alias("low"), F.coalesce("up", "id").alias("top"))
    step = 1
    while step < 2 * largest and not now.where("up is not null").isEmpty():
        above = now.select(group, F.col("id").alias("up"), F.col("up").alias("next"), F.col("d").alias("more"), F.col("low").alias("lower"), F.col("top").alias("higher"))
        now = now.join(above, [group, "up"], "left").select(
            group, "id", F.col("next").alias("up"), (F.col("d") + F.coalesce("more", F.lit(0))).alias("d"), F.least("low", "lower").alias("low"), F.coalesce("higher", "top").alias("top"),
        ).checkpoint()
        step *= 2
    return now


def depth(posts: DataFrame, group: str) -> DataFrame:
    """Per group: the longest chain of replies and reposts inside it, of any length; a post's parent is what it replies to, or else
    what it reposts (column repost_of, where there is one). A chain that comes to a cycle ends before the first post that it has
    met: it counts its own steps and all posts of the cycle but one."""
    shared_folder(posts.sparkSession)
    given = lambda c: F.when(F.col(c) != "", F.col(c))
    parent = F.coalesce(given("reply_to"), given("repost_of")) if "repost_of" in posts.columns else given("reply_to")
    now = posts.select(group, F.col("post_id").alias("id"), parent.alias("up"))
    ids = now.select(group, F.col("id").alias("up"), F.lit(True).alias("there"))
    links = now.join(ids, [group, "up"], "left").select(group, "id", F.when(F.col("there"), F.col("up")).alias("up"))
    largest = now.groupBy(group).count().agg(F.max("count")).first()[0] or 0
    now = climbed(links, group, largest)
    ends, endless = now.where("up is null").select(group, "d"), now.where("up is not null")
    if not endless.isEmpty():
        on = endless.select(group, F.col("up").alias("id")).distinct()
        ring = climbed(links.join(on, [group, "id"]), group, largest).select(group, F.col("id").alias("top"), "low")
        ring = ring.join(ring.groupBy(group, "low").agg(F.count(F.lit(1)).alias("size")), [group, "low"])
        to = links.join(endless.select(group, "id"), [group, "id"]).join(on.withColumn("on", F.lit(True)), [group, "id"], "left")
        tails = climbed(to.select(group, "id", F.when(F.col("on").isNull(), F.col("up")).alias("up")), group, largest)
        ends = ends.unionAll(tails.join(ring, [group, "top"]).select(group, F.col("d") + F.col("size") - 1))
    return ends.groupBy(group).agg(F.max("d").alias("propagation_depth"))


def time_to_authors(posts: DataFrame, group: str, counts: tuple[int, ...]) -> DataFrame:
    """Per group: seconds from the first post until so many distinct authors had posted; null if they never did."""
    first = posts.groupBy(group, "author_id").agg(F.min("epoch").alias("t"))
    w = Window.partitionBy(group).orderBy("t", "author_id")
    ranked = first.withColumns({"n": F.row_number().over(w), "t0": F.min("t").over(Window.partitionBy(group))})
    return ranked.groupBy(group).agg(*(F.max(F.when(F.col("n") == k, F.col("t") - F.col("t0"))).alias(f"time_to_{k}") for k in counts))


def score(features: DataFrame) -> DataFrame:
    """Adds graph_score from concentration, synchrony, overlap, depth, similarity and entropy."""
    s = 0.22 * F.col("community_concentration") + 0.20 * F.col("synchronized_posting") + 0.18 * F.col("repeated_amplifier_overlap") + 0.15 * F.least(F.lit(1.0), F.col("propagation_depth") / 5) + 0.15 * F.col("node_similarity") + 0.10 * (1 - F.col("community_entropy"))
    return features.withColumn("graph_score", F.when(F.col("posts") > 0, clamp(s)))


def edges(posts: DataFrame, group: str) -> DataFrame:
    """Distinct edges of the coordination graph: POSTED, MEMBER_OF, REPLIES_TO."""
    e = lambda a, rel, b, rows=posts: rows.select(F.col(a).cast("string").alias("src"), F.lit(rel).alias("rel"), F.col(b).cast("string").alias("dst"))
    return e("author_id", "POSTED", "post_id").unionByName(e("post_id", "MEMBER_OF", group)).unionByName(e("post_id", "REPLIES_TO", "reply_to", posts.where("reply_to is not null"))).distinct()


def amplifies() -> Column:
    """Whether a post passes something on: it is a repost, or has addresses or tags."""
    return F.coalesce(F.col("repost_of") != "", F.lit(False)) | (F.coalesce(F.size("urls"), F.lit(0)) > 0) | (F.coalesce(F.size("hashtags"), F.lit(0)) > 0)


EDGE = ["src_label", "src", "relation", "dst_label", "dst"]


def relations(posts: DataFrame, campaigns: DataFrame, alerts: DataFrame, group: str, cutoff: int) -> DataFrame:
    """posts: group, post_id, author_id, asset_id, narrative_id, scope_id, epoch, reply_to, repost_of, urls, hashtags; campaigns: group,
    campaign_id; alerts: group, alert_id. The typed edges of the coordination graph, each once, of posts up to the cutoff: POSTED,
    MENTIONS, MEMBER_OF, REPLIES_TO, REPOSTS, AMPLIFIES; and of a group's campaigns and alerts TARGETS and EVIDENCE_FOR."""
    own = posts.where(F.col("epoch") <= cutoff)
    text = lambda c: F.col(c).cast("string")

    def edge(rows: DataFrame, a: str, src: str, relation: str, b: str, dst: str) -> DataFrame:
        return rows.select(F.lit(a).alias("src_label"), text(src).alias("src"), F.lit(relation).alias("relation"), F.lit(b).alias("dst_label"), text(dst).alias("dst"))

    in_group = own.select(group, "asset_id", "narrative_id").distinct()
    campaign, alert = in_group.join(campaigns, group), in_group.join(alerts, group)
    found = [
        edge(own, "Actor", "author_id", "POSTED", "Post", "post_id"), edge(own, "Post", "post_id", "MENTIONS", "Asset", "asset_id"), edge(own, "Post", "post_id", "MEMBER_OF", "Narrative", "narrative_id"),
        edge(own.where("reply_to <> ''"), "Post", "post_id", "REPLIES_TO", "Post", "reply_to"), edge(own.where("repost_of <> ''"), "Post", "post_id", "REPOSTS", "Post", "repost_of"),
        edge(own.where(amplifies()), "Post", "post_id", "AMPLIFIES", "Narrative", "narrative_id"), edge(campaign, "Campaign", "campaign_id", "TARGETS", "Asset", "asset_id"),
        edge(campaign, "Narrative", "narrative_id", "EVIDENCE_FOR", "Campaign", "campaign_id"), edge(alert, "Narrative", "narrative_id", "EVIDENCE_FOR", "Alert", "alert_id"),
    ]
    out = found[0]
    for f in found[1:]:
        out = out.unionAll(f)
    return out.distinct()


def nodes(posts: DataFrame, campaigns: DataFrame, alerts: DataFrame, group: str, cutoff: int, write: int = 0) -> DataFrame:
    """The nodes of these relations, each once: label, id, event_epoch and scope_id of posts, and write, the number of the batch. A
    parent that is not among the posts is a node that nothing is known of."""
    ends = relations(posts, campaigns, alerts, group, cutoff)
    named = ends.select(F.col("src_label").alias("label"), F.col("src").alias("id")).unionAll(ends.select("dst_label", "dst"))
    none = lambda k: F.lit(None).cast(k)
    known = posts.where(F.col("epoch") <= cutoff).select(F.lit("Post").alias("label"), F.col("post_id").cast("string").alias("id"), F.col("epoch").alias("event_epoch"), "scope_id", F.lit(write).alias("write"))
    return merged(known.unionByName(named.select("label", "id", none("bigint").alias("event_epoch"), none("string").alias("scope_id"), F.lit(write).alias("write"))))


def merged(rows: DataFrame) -> DataFrame:
    """Nodes of any number of batches as one row each, with the properties of the last write that knew any: a batch that is written
    again, or comes out of order, changes nothing."""
    known = F.when(F.col("event_epoch").isNotNull() | F.col("scope_id").isNotNull(), F.struct("write", "event_epoch", "scope_id"))
    last = rows.groupBy("label", "id").agg(F.max(known).alias("last"), F.max("write").alias("any"))
    return last.select("label", "id", "last.event_epoch", "last.scope_id", F.coalesce("last.write", "any").alias("write"))


def projection_counts(posts: DataFrame, campaigns: DataFrame, alerts: DataFrame, group: str, cutoff: int) -> DataFrame:
    """Per group what a projection of it counts: nodes (actors, posts, narratives, the asset, a campaign, alerts) and relations of its
    posts (posted, mentions, member, and replies, reposts and amplifications)."""
    own = posts.where(F.col("epoch") <= cutoff)
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    own = own.groupBy(group).agg(F.count_distinct("author_id").alias("actors"), F.count(F.lit(1)).alias("posts"), F.count_distinct("narrative_id").alias("narratives"), F.sum(3 + flag(F.col("reply_to") != "") + flag(F.col("repost_of") != "") + flag(amplifies())).alias("relations"))
    c = campaigns.groupBy(group).agg(F.count_distinct("campaign_id").alias("campaigns"))
    a = alerts.groupBy(group).agg(F.count_distinct("alert_id").alias("alerts"))
    out = own.join(c, group, "left").join(a, group, "left").na.fill(0, ["campaigns", "alerts"])
    return out.select(group, (F.col("actors") + F.col("posts") + F.col("narratives") + 1 + F.col("campaigns") + F.col("alerts")).alias("nodes"), "relations")
