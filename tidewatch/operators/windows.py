"""Event-time feature windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.operators import serving

KEY = ["scope_id", "asset_id", "interval_seconds", "window_start"]
#: Order and names of the model's inputs (fixed values).
FEATURES = (
    "price_return volume relative_volume volatility spread top_n_depth orderbook_imbalance orderbook_valid trade_count buy_sell_pressure "
    "market_data_freshness_seconds market_source_active market_source_idle market_source_degraded mention_count unique_author_count "
    "author_concentration repost_reply_ratio hashtag_velocity url_concentration new_author_ratio social_data_freshness_seconds "
    "social_source_active social_source_idle social_source_degraded social_lead_seconds source_gap_count data_quality_score baseline_confidence"
).split()


def seconds(c: Column | str) -> Column:
    """Seconds since the epoch, with fractions."""
    return F.unix_micros(F.col(c).cast("timestamp") if isinstance(c, str) else c.cast("timestamp")) / 1e6


def assign(signals: DataFrame, intervals: list[int]) -> DataFrame:
    """Each signal in its tumbling window of every interval; window_start is in seconds since the epoch."""
    at = seconds("event_time")
    rows = signals.withColumn("interval_seconds", F.explode(F.array(*(F.lit(i) for i in intervals))))
    return rows.withColumns({"t": at, "window_start": (F.floor(at / F.col("interval_seconds")) * F.col("interval_seconds")).cast("long")})


def first_per_key(df: DataFrame, keys: list[str], arrival: str) -> DataFrame:
    """Delivery de-duplication: the row that arrives first of each key, by aggregation rather than a sort of whole groups."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), arrival).alias("r")).select(*keys, "r.*")


DOMAINS = ("market", "social")


def quality_of(domain: str, order: Column) -> list[Column]:
    """Aggregates of a window's rows: the last quality signal of a domain, its time, and that of the last other signal."""
    own, judged = F.col("source_domain") == domain, F.col("kind") == "DATA_QUALITY"
    return [
        F.max_by(F.struct("source_active", "source_idle", "source_degraded"), F.when(own & judged, order)).alias(f"{domain}_quality"),
        F.max(F.when(own & judged, order)).alias(f"{domain}_quality_at"), F.max(F.when(own & ~judged, order)).alias(f"{domain}_other_at"),
    ]


def source_states(base: DataFrame) -> DataFrame:
    """base: windows with the aggregates of quality_of. Adds for each domain its state at the end of the window, in event time:
    the last quality signal up to then; a later signal of another kind makes the source active and not idle."""
    upto = Window.partitionBy("scope_id", "asset_id", "interval_seconds").orderBy("window_start").rowsBetween(Window.unboundedPreceding, 0)
    parts = [f"{d}_{c}" for d in DOMAINS for c in ("quality", "quality_at", "other_at")]
    known = base.withColumns({c: F.last(c, True).over(upto) for c in parts})

    def state(d: str) -> Column:
        quality, at, other = F.col(f"{d}_quality"), F.col(f"{d}_quality_at"), F.col(f"{d}_other_at")
        later = other.isNotNull() & (at.isNull() | (other > at))
        return F.struct(
            F.when(later, True).otherwise(F.coalesce(quality["source_active"], F.lit(False))).alias("active"),
            F.when(later, False).otherwise(F.coalesce(quality["source_idle"], F.lit(False))).alias("idle"),
            # A source that was never judged counts as degraded only until something comes from it.
            F.coalesce(quality["source_degraded"], ~later).alias("degraded"),
        )

    return known.withColumns({d: state(d) for d in DOMAINS}).drop(*parts)


def features(signals: DataFrame, intervals: list[int], history: int = 20) -> DataFrame:
    """One row for each window with signals: the key, the features in order, and lineage."""
    rows = signals_in = assign(signals, intervals)
    order = F.struct("t", "event_id")
    is_a = lambda k: F.col("kind") == k
    valid = is_a("ORDERBOOK") & F.coalesce("book_valid", F.lit(True))
    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    # By the key alone, so that the aggregation below needs no other shuffle; the kinds follow one another.
    priced = Window.partitionBy(*KEY).orderBy("kind", "t", "event_id")
    price = F.when(is_a("MARKET_TRADE"), zero("price")).when(is_a("MARKET_CANDLE"), zero("close"))
    before = F.when(F.lag("kind").over(priced) == F.col("kind"), F.lag("series_price").over(priced))
    rows = rows.withColumn("series_price", price).withColumn("step", F.when(F.col("series_price").isNotNull() & (before != 0), F.col("series_price") / before - 1))
    market = F.col("kind").isin("MARKET_TRADE", "MARKET_CANDLE", "ORDERBOOK")
    social = F.col("kind").isin("SOCIAL_POST", "ASSET_MENTION")
    post = is_a("SOCIAL_POST")

    def series(kind: str) -> list[Column]:
        at = F.when(is_a(kind), order)
        return [F.min_by("series_price", at).alias(f"{kind}_first"), F.max_by("series_price", at).alias(f"{kind}_last"), F.count_if(is_a(kind)).alias(f"{kind}_n"), F.stddev_pop(F.when(is_a(kind), F.col("step"))).alias(f"{kind}_dev"), F.count(F.when(is_a(kind), F.col("step"))).alias(f"{kind}_steps")]

    base = rows.groupBy(*KEY).agg(
        *series("MARKET_TRADE"), *series("MARKET_CANDLE"),
        F.coalesce(F.sum(F.when(is_a("MARKET_TRADE"), zero("quantity") * F.coalesce("price", F.lit(1.0)))), F.lit(0.0)).alias("traded"), F.coalesce(F.sum(F.when(is_a("MARKET_CANDLE"), zero("volume"))), F.lit(0.0)).alias("candled"),
        F.avg(F.when(zero("baseline_volume") > 0, F.col("baseline_volume"))).alias("given_baseline"),
        F.avg(F.when(valid, zero("spread"))).alias("spread"), F.avg(F.when(valid, zero("top_n_depth"))).alias("top_n_depth"), F.avg(F.when(valid, zero("imbalance"))).alias("orderbook_imbalance"),
        F.max(F.when(is_a("ORDERBOOK"), valid.cast("int"))).alias("orderbook_valid"),
        F.sum(F.when(is_a("MARKET_TRADE") & (F.col("side") == "BUY"), zero("quantity")).otherwise(0.0)).alias("buys"), F.sum(F.when(is_a("MARKET_TRADE") & (F.col("side") == "SELL"), zero("quantity")).otherwise(0.0)).alias("sells"),
        F.max(F.when(market, F.col("t"))).alias("market_last"), F.min(F.when(market, F.col("t"))).alias("market_first"), F.max(F.when(social, F.col("t"))).alias("social_last"), F.min(F.when(social, F.col("t"))).alias("social_first"),
        F.count_if(is_a("ASSET_MENTION")).alias("mentions"), F.count_if(post).alias("posts"), F.count_if(post & (F.coalesce("repost_of", "reply_to").isNotNull())).alias("reposts"),
        F.sum(F.when(post, F.coalesce(F.size("hashtags"), F.lit(0))).otherwise(0)).alias("tags"),
        F.max(F.when(is_a("DATA_QUALITY"), zero("source_gap_count"))).alias("gaps"),
        F.count(F.lit(1)).alias("source_event_count"), F.min("t").alias("min_event_time"), F.max("t").alias("max_event_time"),
        *(c for d in DOMAINS for c in quality_of(d, order)),
    )
    # Concentrations by two levels of counts, so that no window's authors or urls are gathered.
    seen = Window.partitionBy("scope_id", "asset_id", "interval_seconds", "author_id")
    authors = signals_in.where(post & F.col("author_id").isNotNull()).groupBy(*KEY, "author_id").agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("first_here"))
    authors = authors.withColumn("first_seen", F.min("first_here").over(seen))
    authors = authors.groupBy(*KEY).agg(F.count(F.lit(1)).alias("authors"), (F.max("n") / F.sum("n")).alias("author_share"), F.count_if(F.col("first_seen") >= F.col("window_start")).alias("new_authors"))
    urls = signals_in.where(post).select(*KEY, F.explode("urls").alias("url")).groupBy(*KEY, "url").count().groupBy(*KEY).agg((F.max("count") / F.sum("count")).alias("url_share"))
    out = source_states(base.join(authors, KEY, "left").join(urls, KEY, "left"))
    earlier = Window.partitionBy("scope_id", "asset_id", "interval_seconds").orderBy("window_start")
    trailing = earlier.rowsBetween(-history, -1)
    out = out.withColumn("volume", F.when(F.col("traded") != 0, F.col("traded")).otherwise(F.col("candled")))
    out = out.withColumn("baseline", F.coalesce("given_baseline", F.avg(F.when(F.col("volume") > 0, F.col("volume"))).over(trailing), "volume"))
    return finished(out.withColumn("earlier", F.row_number().over(earlier) - 1))


def finished(out: DataFrame) -> DataFrame:
    """out: windows with their aggregates, those of authors and urls, source states, volume, baseline, and how many windows are earlier:
    the features of each, in order."""
    end = F.col("window_start") + F.col("interval_seconds")
    by_trade = F.col("MARKET_TRADE_n") > 0
    pick = lambda c: F.when(by_trade, F.col(f"MARKET_TRADE_{c}")).otherwise(F.col(f"MARKET_CANDLE_{c}"))
    available = F.col("social.active") & ~F.col("social.degraded")
    flag = lambda d, c: F.col(f"{d}.{c}").cast("int").alias(f"{d}_source_{c}")
    fresh = F.greatest(F.lit(0.0), F.coalesce(end - F.col("market_last"), F.col("interval_seconds").cast("double")))
    social_fresh = F.greatest(F.lit(0.0), end - F.col("social_last"))
    penalty = F.least(F.lit(1.0), (fresh + F.coalesce(F.when(F.col("social_last").isNotNull(), social_fresh), F.lit(0.0))) / 600.0)
    gaps = F.coalesce(F.col("gaps"), F.lit(0.0)).cast("int")
    quality = F.greatest(F.lit(0.0), 1 - penalty - 0.25 * (F.col("market.degraded").cast("int") + F.col("social.degraded").cast("int")) - F.least(F.lit(0.5), gaps * 0.1))
    both = F.col("buys") + F.col("sells")
    return out.select(
        *KEY, end.alias("window_end"),
        F.when((pick("n") > 1) & (pick("first") != 0), pick("last") / pick("first") - 1).otherwise(0.0).alias("price_return"), "volume",
        F.when(F.col("baseline") != 0, F.col("volume") / F.col("baseline")).otherwise(0.0).alias("relative_volume"), F.when(pick("steps") > 1, pick("dev")).otherwise(0.0).alias("volatility"),
        "spread", "top_n_depth", "orderbook_imbalance", "orderbook_valid", F.col("MARKET_TRADE_n").alias("trade_count"), F.when(both != 0, (F.col("buys") - F.col("sells")) / both).otherwise(0.0).alias("buy_sell_pressure"),
        fresh.alias("market_data_freshness_seconds"), flag("market", "active"), flag("market", "idle"), flag("market", "degraded"),
        F.when(available, F.col("mentions")).alias("mention_count"), F.when(available, F.coalesce("authors", F.lit(0))).alias("unique_author_count"), F.when(available, F.coalesce("author_share", F.lit(0.0))).alias("author_concentration"),
        F.when(available, F.when(F.col("posts") > 0, F.col("reposts") / F.col("posts")).otherwise(0.0)).alias("repost_reply_ratio"), F.when(available, F.col("tags") / F.greatest(F.lit(1.0), F.col("interval_seconds") / 60.0)).alias("hashtag_velocity"),
        F.when(available, F.coalesce("url_share", F.lit(0.0))).alias("url_concentration"), F.when(available, F.coalesce(F.col("new_authors") / F.col("authors"), F.lit(0.0))).alias("new_author_ratio"),
        F.when(F.col("social_last").isNotNull(), social_fresh).alias("social_data_freshness_seconds"), flag("social", "active"), flag("social", "idle"), flag("social", "degraded"),
        (F.col("market_first") - F.col("social_first")).alias("social_lead_seconds"), gaps.alias("source_gap_count"), quality.alias("data_quality_score"),
        F.least(F.lit(1.0), F.col("earlier") / 20.0).alias("baseline_confidence"),
        "source_event_count", "min_event_time", "max_event_time",
    )


def watermarks(signals: DataFrame, required: tuple[str, ...] = ("market", "social"), lateness: int = 120, idle_after: int = 300) -> DataFrame:
    """Per asset: each domain's watermark (none while unseen or degraded; the key's overall time if idle) and their least."""
    t = seconds("event_time")
    last = signals.groupBy("scope_id", "asset_id").agg(
        F.max(t).alias("all_last"), *(F.max(F.when(F.col("source_domain") == d, t)).alias(f"{d}_last") for d in required),
        *(F.max_by("source_degraded", F.when((F.col("source_domain") == d) & (F.col("kind") == "DATA_QUALITY"), F.struct(t.alias("t"), "event_id"))).alias(f"{d}_degraded") for d in required),
    )
    mark = lambda d: F.when(F.col(f"{d}_last").isNull() | F.coalesce(f"{d}_degraded", F.lit(False)), None).when(F.col("all_last") - F.col(f"{d}_last") >= idle_after, F.col("all_last") - lateness).otherwise(F.col(f"{d}_last") - lateness)
    marks = last.select("scope_id", "asset_id", *(mark(d).alias(f"{d}_watermark") for d in required))
    every = F.lit(True)
    for d in required:
        every = every & F.col(f"{d}_watermark").isNotNull()
    return marks.withColumn("fusion_watermark", F.when(every, F.least(*(F.col(f"{d}_watermark") for d in required))))


def lineage(signals: DataFrame, intervals: list[int]) -> DataFrame:
    """The ordered ids of a window's rows as one hash, with count and time bounds. No list of a window is held."""
    rows = assign(signals, intervals)
    bounds = rows.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("min_event_time"), F.max("t").alias("max_event_time"))
    ids = serving.digests(rows, KEY, ["t", "event_id"], "event_id").select(*KEY, F.col("digest").alias("lineage_hash"))
    return bounds.join(ids, KEY, "left").select(*KEY, F.coalesce("lineage_hash", F.sha2(F.lit(""), 256)).alias("lineage_hash"), "n", "min_event_time", "max_event_time")


__all__ = ["FEATURES", "KEY", "assign", "features", "first_per_key", "lineage", "source_states", "watermarks"]
