"""Relational operators over records: visibility, validity in time, assembly of evidence, verification ranking, governance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def guard_payload(rows: DataFrame, now: int, time: str, trust: str, payload: str) -> DataFrame:
    """Adds reasons (codes of what is wrong with a delivery) and risk."""
    codes = [("FUTURE_EVENT_TIME", F.col(time) > now + 300), ("INVALID_SOURCE_TRUST", ~F.col(trust).between(0, 1)), ("LOW_TRUST_SOURCE", F.col(trust).between(0, 1) & (F.col(trust) < 0.25)), ("PAYLOAD_TOO_LARGE", F.length(payload) > 1_000_000)]
    df = rows.withColumn("reasons", F.array_compact(F.array(*(F.when(test, F.lit(k)) for k, test in codes))))
    return df.withColumn("risk", F.least(F.lit(1.0), F.size("reasons") * 0.4))


def visible(rows: DataFrame, campaigns: DataFrame, sessions: DataFrame, tenant: str) -> DataFrame:
    """Rows that a tenant may see: it has a campaign of their scope and asset, or a session of their scope."""
    a = rows.join(campaigns.where(F.col("tenant_id") == tenant), ["scope_id", "asset_id"], "left_semi")
    b = rows.join(sessions.where(F.col("tenant_id") == tenant), ["scope_id"], "left_semi")
    return a.unionByName(b).distinct()


def in_force(rows: DataFrame, at: Column, since: str = "effective_from", until: str = "effective_to") -> DataFrame:
    return rows.where((F.col(since) <= at) & (F.col(until).isNull() | (at < F.col(until))))


def overlaps(rows: DataFrame, key: str, row: str, since: str, until: str) -> DataFrame:
    """Rows of a key that begin before an earlier one of it has ended: a running maximum of the ends, so no pairs."""
    w = Window.partitionBy(key).orderBy(since, row).rowsBetween(Window.unboundedPreceding, -1)
    end = F.coalesce(F.col(until), F.lit(1 << 60))
    return rows.withColumn("latest_end", F.max(end).over(w)).where(F.col(since) < F.col("latest_end"))


def redact(settings: Column) -> Column:
    """A map of settings with secret values masked."""
    return F.transform_values(settings, lambda k, v: F.when(F.lower(k).rlike("token|password|secret|api_key|authorization"), F.lit("[REDACTED]")).otherwise(v))


def completeness(rows: DataFrame, parts: list[str]) -> DataFrame:
    """Adds the share of parts that are there (4 decimals, half to even) and the names of those that aren't."""
    n = sum((F.col(p).isNotNull().cast("int") for p in parts), F.lit(0))
    return rows.withColumns({"completeness": F.bround(n / len(parts), 4), "missing": F.array_compact(F.array(*(F.when(F.col(p).isNull(), F.lit(p)) for p in parts)))})


def contributions(rows: DataFrame, parts: list[str]) -> DataFrame:
    """Adds the parts that contribute, the largest absolute value first (ties by name), and a summary."""
    each = F.array_compact(F.array(*(F.when(F.coalesce(F.col(p), F.lit(0.0)) != 0, F.struct((-F.abs(F.col(p))).alias("o"), F.lit(p).alias("name"))) for p in parts)))
    names = F.transform(F.array_sort(each), lambda x: x["name"])
    return rows.withColumn("contributors", names).withColumn("summary", F.when(F.size(names) == 0, "no evidence").otherwise(F.concat(F.lit("mainly "), F.array_join(F.slice(names, 1, 2), " and "))))


def explained(rows: DataFrame, parts: list[str], severity: str, results: str, name: list[str]) -> DataFrame:
    """Adds to an alert's evidence the contributors with their values, the largest absolute one first (equal ones in the order of parts),
    the rules that were triggered with outcome, and a summary. results: the results of its verifications, an array; name: the columns of alert type
    and asset. The rules: ALERT_THRESHOLD (its outcome is the severity, with the fusion score), MARKET_CORROBORATION (a market score of 0.35 at
    least), and CLAIM_VERIFICATION where there are verifications (their results, each once, in order)."""
    each = F.array_compact(F.array(*(F.when(F.col(p).isNotNull(), F.struct((-F.abs(F.col(p))).alias("o"), F.lit(i).alias("i"), F.lit(p).alias("feature"), F.col(p).alias("value"))) for i, p in enumerate(parts))))
    rule = lambda k, outcome, score=None: F.struct(F.lit(k).alias("rule"), outcome.cast("string").alias("outcome"), (F.lit(None) if score is None else score).cast("double").alias("fusion_score"))
    checked = F.when(F.size(results) > 0, rule("CLAIM_VERIFICATION", F.array_join(F.array_sort(F.array_distinct(results)), ",")))
    rules = F.array_compact(F.array(rule("ALERT_THRESHOLD", F.col(severity), F.col("fusion_score")), rule("MARKET_CORROBORATION", F.coalesce("market_score", F.lit(0.0)) >= 0.35), checked))
    out = rows.withColumns({"contributors": F.transform(F.array_sort(each), lambda x: F.struct(x["feature"], x["value"])), "rules": rules})
    top = F.coalesce(F.get("contributors", F.lit(0))["feature"], F.lit("available evidence"))
    return out.withColumn("summary", F.concat(F.concat_ws(" ", severity, name[0]), F.lit(" for "), F.col(name[1]), F.lit("; the strongest recorded contributor was "), top, F.lit(".")))


def rank_evidence(matches: DataFrame, claim: str, document: str, chunk: str) -> DataFrame:
    """matches: claim, document, chunk, score, before, conflict. One row for each document and relation, the best chunk, ranked."""
    relation = F.when(~F.col("before"), "RETROSPECTIVE").when(F.col("conflict"), "CONFLICTING").otherwise("SUPPORTING")
    first = Window.partitionBy(claim, document, "relation").orderBy(F.desc("score"), chunk)
    order = Window.partitionBy(claim).orderBy(F.desc("score"), chunk)
    best = matches.withColumn("relation", relation).withColumn("r", F.row_number().over(first)).where("r = 1").drop("r")
    return best.withColumn("place", F.row_number().over(order))


def candidates_as_of(claims: DataFrame, documents: DataFrame, back: int, ahead: int, most: int = 500) -> DataFrame:
    """claims: claim_id, asset_id, t; documents: document_key, version, asset_id (null: all), published, available. For each
    claim, of documents published around t, the latest version that was available at t and every version that came
    later, newest first. The range join is an equality on asset and day; documents of no asset are met by day alone, and a
    claim asks for each day of its range."""
    day = 86_400
    d = documents.withColumn("day", F.floor(F.col("published") / day))
    c = claims.withColumnRenamed("asset_id", "claim_asset").withColumn("day", F.explode(F.sequence(F.floor((F.col("t") - back) / day), F.floor((F.col("t") + ahead) / day))))
    own = c.join(d.where("asset_id is not null").withColumn("claim_asset", F.col("asset_id")), ["claim_asset", "day"])
    near = own.unionByName(c.join(d.where("asset_id is null"), "day")).where((F.col("published") >= F.col("t") - back) & (F.col("published") <= F.col("t") + ahead))
    before = F.col("available") <= F.col("t")
    last = F.max(F.when(before, F.col("version"))).over(Window.partitionBy("claim_id", "document_key"))
    near = near.withColumn("before", before).withColumn("last", last).where("not before or version = last")
    order = Window.partitionBy("claim_id").orderBy(F.desc("published"), "document_key", "version")
    return near.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).select("claim_id", "document_key", "version", "before", "place")


def fold_log(log: DataFrame, key: str, value: str, order: list[str], initial: str) -> DataFrame:
    """The current value of each key by a log of changes, and how many there were."""
    return log.groupBy(key).agg(F.coalesce(F.max_by(value, F.struct(*order)), F.lit(initial)).alias(value), F.count(F.lit(1)).alias("changes"))


def posts_in_windows(windows: DataFrame, posts: DataFrame) -> DataFrame:
    """windows: asset_id, window_start, interval_seconds; posts: asset_id, post_id, epoch. Each post of an asset with the windows
    that hold it. The range join is an equality: a post's window of an interval follows from its time."""
    spans = windows.agg(F.collect_set("interval_seconds").alias("spans"))  # one row: a deployment has a few intervals
    placed = posts.crossJoin(F.broadcast(spans)).withColumn("interval_seconds", F.explode("spans")).drop("spans").withColumn("window_start", (F.floor(F.col("epoch") / F.col("interval_seconds")) * F.col("interval_seconds")).cast("long"))
    return placed.join(windows.select("asset_id", "window_start", "interval_seconds"), ["asset_id", "window_start", "interval_seconds"]).dropDuplicates(["asset_id", "window_start", "interval_seconds", "post_id"])


def observed(indicators: DataFrame, batch: DataFrame, key: list[str], seen: str) -> DataFrame:
    """Indicators after a batch of observations: first and last seen, observations."""
    both = indicators.select(*key, seen).unionByName(batch.select(*key, seen))
    return both.groupBy(*key).agg(F.min(seen).alias("first_seen"), F.max(seen).alias("last_seen"), F.count(F.lit(1)).alias("observations"))


def last_with_ties(rows: DataFrame, key: str, at: str) -> DataFrame:
    """All rows of a key at its last time."""
    return rows.withColumn("r", F.rank().over(Window.partitionBy(key).orderBy(F.desc(at)))).where("r = 1").drop("r")


def due(deliveries: DataFrame, now: int, most: int = 50) -> DataFrame:
    """The deliveries whose time has come, the longest waiting first."""
    return deliveries.where(F.col("status").isin("PENDING", "RETRY") & (F.col("next_attempt") <= now)).orderBy("next_attempt", "delivery_id").limit(most)


def patched(policies: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """policies: key, effective_from, effective_to, trust; changes: key, at, trust. A change ends the version in force and begins the
    next, which lasts until the next change or, as the version before it, for good."""
    rows = policies.select(key, F.col("effective_from").alias("at"), "trust").unionByName(changes.select(key, "at", "trust"))
    w = Window.partitionBy(key).orderBy("at")
    return rows.select(key, F.col("at").alias("effective_from"), F.lead("at").over(w).alias("effective_to"), "trust", F.row_number().over(w).alias("version"))


def assemble(alerts: DataFrame, parts: dict[str, DataFrame], key: list[str]) -> DataFrame:
    """An alert's evidence: the part of each kind, as a struct, where there is one. Each part has a row for a key at most."""
    out = alerts
    for name, part in parts.items():
        rest = [c for c in part.columns if c not in key]
        out = out.join(part.select(*key, F.struct(*rest).alias(name)), key, "left")
    return out


def amplifier_overlap(posts: DataFrame, group: str, url: str, tag: str) -> DataFrame:
    """Per group: the most frequent url's or tag's share of the posts, 1 at most."""
    n = posts.groupBy(group).agg(F.count(F.lit(1)).alias("posts"))
    each = lambda c: posts.select(group, F.explode(c).alias("x")).groupBy(group, F.lower("x")).agg(F.count(F.lit(1)).alias("k"))
    most = each(url).unionByName(each(tag)).groupBy(group).agg(F.max("k").alias("k"))
    return n.join(most, group, "left").select(group, F.least(F.lit(1.0), F.coalesce("k", F.lit(0)) / F.col("posts")).alias("repeated_amplifier_overlap"))
