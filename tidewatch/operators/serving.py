"""Latest state, timelines, top lists, routing of notifications, evidence chains."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.exprs import SEVERITIES, hmac_pads, hmac_sha256_by, rank_of, uuid5


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by `order`: an aggregation, so no group is sorted."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, "r.*")


def newest(rows: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each key."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("place") <= n)


def timeline(parts: list[DataFrame], order: list[Column], n: int) -> DataFrame:
    """The newest n rows of several kinds of events together."""
    return reduce(DataFrame.unionByName, parts).orderBy(*order).limit(n)


def feed(events: DataFrame, cursor: int, length: int) -> DataFrame:
    """The events after a cursor among the newest `length`; if the cursor has fallen out of these, a reset row comes first."""
    last = events.agg(F.max("event_id").alias("m"))
    kept = events.crossJoin(last).where(F.col("event_id") > F.col("m") - length)  # one row on that side
    oldest = kept.agg(F.min("event_id").alias("event_id"))
    reset = oldest.where(F.col("event_id") > cursor + 1).select((F.col("event_id") - 1).alias("event_id"), F.lit("stream.reset_required").alias("kind"))
    return reset.unionByName(kept.where(F.col("event_id") > cursor).select("event_id", F.col("event_type").alias("kind")))


def fan_out(alerts: DataFrame, subscriptions: DataFrame, made: DataFrame | None = None) -> DataFrame:
    """A delivery for each alert and channel whose subscription it meets: severity at least the minimum, and asset and
    type in the subscription's lists where it has any, and the tenant's own where both have a tenant_id. Deliveries that were
    made (by delivery_id) are not made again.

    A subscription is a row for each severity, asset and type that it takes (null: every one), and an alert asks for its own
    and for null: an equality join, whatever the number of subscriptions."""
    some = lambda c: F.explode(F.when(F.size(c) == 0, F.array(F.lit(None).cast("string"))).otherwise(F.array_distinct(c)))
    taken = F.explode(F.filter(F.array(*(F.lit(x) for x in SEVERITIES)), lambda x: rank_of(x) >= rank_of(F.col("minimum"))))
    tenant = ["tenant_id"] if "tenant_id" in subscriptions.columns and "tenant_id" in alerts.columns else []
    s = subscriptions.select("channel", *tenant, "minimum", "types", some("assets").alias("a")).select("channel", *tenant, "minimum", "a", some("types").alias("t")).select("channel", *tenant, "a", "t", taken.alias("severity"))
    null = F.lit(None).cast("string")
    asked = alerts.withColumn("a", F.explode(F.array("asset_id", null))).withColumn("t", F.explode(F.array("alert_type", null))).alias("x")
    same = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in tenant]
    hit = reduce(Column.__and__, same, F.col("x.severity") == F.col("y.severity")) & F.col("x.a").eqNullSafe(F.col("y.a")) & F.col("x.t").eqNullSafe(F.col("y.t"))
    out = asked.join(s.alias("y"), hit).groupBy("channel", "alert_id").agg(F.first("x.severity").alias("severity"), F.first("asset_id").alias("asset_id"))
    out = out.withColumn("delivery_id", uuid5(F.concat_ws(":", F.lit("delivery"), "channel", F.col("alert_id").cast("string"))))
    return out if made is None else out.join(made.select("delivery_id"), "delivery_id", "left_anti")


def retry_state(deliveries: DataFrame, now: int, most: int = 5) -> DataFrame:
    """deliveries: ok, attempts. Adds status and the time of the next attempt (exponential, at most 900 s)."""
    status = F.when(F.col("ok"), "DELIVERED").when(F.col("attempts") >= most, "FAILED").otherwise("RETRY")
    wait = F.least(F.lit(900.0), 5 * F.pow(F.lit(2.0), F.col("attempts")))
    return deliveries.withColumn("status", status).withColumn("next_attempt", F.when(F.col("status") == "RETRY", (now + wait).cast("long")))


MESSAGE = ["alert_id", "alert_type", "asset_id", "campaign_id", "event_id", "event_time", "event_type", "severity", "status"]
#: Parts of a channel: its deliveries are dealt over so many keys of the join.
SPREAD = 64


def messages(deliveries: DataFrame, channels: DataFrame, sender: str = "") -> DataFrame:
    """deliveries: channel_id and the fields of MESSAGE; channels: channel_id, channel_type, secret. What is sent to each: body, the fields
    as JSON by name (chats get one line of text), the idempotency key, and for a webhook with a secret the body's signature. What a secret gives is worked out once for its channel, and a
    channel's deliveries lie in many tasks, however few the channels are."""
    pads = F.when((F.col("channel_type") == "WEBHOOK") & (F.col("secret") != ""), hmac_pads(F.col("secret")))
    own = channels.select("channel_id", "channel_type", pads.alias("__pads")).withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    rows = deliveries.withColumn("__part", F.pmod(F.xxhash64("event_id"), F.lit(SPREAD)).cast("int")).join(own, ["channel_id", "__part"])
    whole = F.to_json(F.struct(*MESSAGE), {"ignoreNullFields": "false"})
    line = F.concat_ws(" ", F.lit(sender) if sender else F.lit(None), F.format_string("%s alert: %s for %s", "severity", "alert_type", "asset_id")).alias("text")
    body = F.when(F.col("channel_type") == "SLACK", F.to_json(F.struct(line))).when(F.col("channel_type") == "TEAMS", F.to_json(F.struct(line, F.lit("message").alias("type")))).otherwise(whole)
    rows = rows.withColumn("body", body)
    signature = F.concat(F.lit("sha256="), hmac_sha256_by(F.col("__pads"), F.col("body")))
    return rows.select("channel_id", "event_id", F.col("event_id").alias("idempotency_key"), "channel_type", "body", signature.alias("signature"))


def evidence_chain(rows: DataFrame, key: str, version: str, fields: list[str]) -> DataFrame:
    """The hash of each version's content, chained with that of the version before: (key, version, content_hash,
    chain_hash). Each hash needs the one before it, so a key's rows come sorted by Spark and are folded one at a time: no
    list of a key is held, however long its chain."""
    content = F.sha2(F.concat_ws("|", *(F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields)), 256)
    links = rows.select(F.col(key).cast("string").alias(key), F.col(version).cast("long").alias("version"), content.alias("content_hash"))
    ordered = links.repartition(key).sortWithinPartitions(key, "version", "content_hash")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last = None, ""
        for b in batches:
            out = []
            for k, v, h in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                last = hashlib.sha256(f"{last if k == now else ''}|{h}|{v}".encode()).hexdigest()
                now = k
                out.append(last)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string())], names=[key, "version", "content_hash", "chain_hash"])

    return ordered.mapInArrow(fold, f"{key} string, version long, content_hash string, chain_hash string")


def digests(rows: DataFrame, keys: list[str], order: list[str], value: str, sep: str = ",", algorithm: str = "sha256") -> DataFrame:
    """Per key the hash of its values (as text, joined by sep, by order; nulls left out) and their number n: what a list of
    the group, sorted and hashed, would give. Spark sorts the rows, spilling where it must, and each task folds them in constant memory.
    Keys are strings, integers or booleans."""
    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    named = rows.where(F.col(value).isNotNull()).select(F.to_json(F.struct(*keys)).alias("__k"), F.col(value).cast("string").alias("__v"), *(F.col(o).alias(f"__o{i}") for i, o in enumerate(order)))
    ordered = named.repartition("__k").sortWithinPartitions("__k", *(f"__o{i}" for i in range(len(order)))).select("__k", "__v")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, hashed, n = None, None, 0
        for b in batches:
            done = [], [], []
            for k, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if k != now:
                    if now is not None:
                        for column, x in zip(done, (now, hashed.hexdigest(), n), strict=True):
                            column.append(x)
                    now, hashed, n = k, hashlib.new(algorithm), 0
                hashed.update((sep + v if n else v).encode())
                n += 1
            yield pa.RecordBatch.from_arrays([pa.array(done[0], pa.string()), pa.array(done[1], pa.string()), pa.array(done[2], pa.int64())], names=["k", "digest", "n"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.string()), pa.array([hashed.hexdigest()], pa.string()), pa.array([n], pa.int64())], names=["k", "digest", "n"])

    folded = ordered.mapInArrow(fold, "k string, digest string, n long")
    return folded.select(F.from_json("k", kinds).alias("k"), "digest", "n").select("k.*", "digest", "n")


def scd2(changes: DataFrame, key: str, at: str) -> DataFrame:
    """Each change in force from its time until the next one of its key."""
    w = Window.partitionBy(key).orderBy(at)
    return changes.withColumn("effective_to", F.lead(at).over(w)).withColumn("version", F.row_number().over(w)).withColumn("current", F.col("effective_to").isNull())


def versions(docs: DataFrame, key: str, order: str, content: str, first_observed: str | None = None, ingested: str | None = None) -> DataFrame:
    """Documents that differ from the one before them under their key, with version numbers; the last is CURRENT. Where there are times
    of observation and ingestion, a version is available from the later of them (available_at)."""
    if first_observed and ingested:
        docs = docs.withColumn("available_at", F.greatest(first_observed, ingested))
    w = Window.partitionBy(key).orderBy(order)
    changed = docs.withColumn("hash", F.sha2(F.coalesce(F.col(content), F.lit("")), 256)).withColumn("before", F.lag("hash").over(w)).where(F.col("before").isNull() | (F.col("hash") != F.col("before")))
    return changed.withColumn("version", F.row_number().over(w)).withColumn("status", F.when(F.lead("hash").over(w).isNull(), "CURRENT").otherwise("SUPERSEDED")).drop("before")


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, since: str, columns: list[str]) -> DataFrame:
    """Each row of left with the last row of right of its key that is not later. Both are one ordered stream per key:
    linear, without pairs."""
    a = left.select(key, F.col(at).alias("__t"), F.lit(1).alias("__side"), F.struct(*left.columns).alias("__l"), *(F.lit(None).cast(right.schema[c].dataType).alias(c) for c in columns))
    b = right.select(key, F.col(since).alias("__t"), F.lit(0).alias("__side"), F.lit(None).cast(a.schema["__l"].dataType).alias("__l"), *columns)
    w = Window.partitionBy(key).orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b)
    value = F.last(F.when(F.col("__side") == 0, F.struct(*columns)), True).over(w)
    return both.withColumn("__v", value).where("__side = 1").select("__l.*", *(F.col(f"__v.{c}").alias(c) for c in columns))


def alert_trail(alerts: DataFrame, key: str, order: list[str], alert: str) -> DataFrame:
    """Per campaign: how many alerts it has, and these in order; a campaign's alerts are few."""
    ids = F.transform(F.sort_array(F.collect_list(F.struct(*order, F.col(alert).alias("__id")))), lambda x: x["__id"].cast("string"))
    return alerts.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.array_join(ids, ",").alias("evidence"))


def overview(assets: DataFrame, scores: DataFrame, campaigns: DataFrame, key: str, score_order: list[str], campaign_order: list[str]) -> DataFrame:
    """Each asset with its latest score and its latest campaign, as structs, where it has them."""
    last = lambda rows, order, name: rows.groupBy(key).agg(F.max_by(F.struct(*(c for c in rows.columns if c != key)), F.struct(*order)).alias(name))
    return assets.join(last(scores, score_order, "latest_score"), key, "left").join(last(campaigns, campaign_order, "latest_campaign"), key, "left")


def alert_detail(alerts: DataFrame, actions: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Alerts with their actions in order: a row for each action with its place and how many there are, and one with place null for an alert
    without any; so no row grows with an alert's history."""
    w = Window.partitionBy(key)
    own = actions.withColumns({"place": F.row_number().over(w.orderBy(*order)), "actions": F.count(F.lit(1)).over(w)})
    return alerts.join(own, key, "left").na.fill(0, ["actions"])


def cases(rows: DataFrame, opened: Column, status: Column, deadline: int, closed: str) -> DataFrame:
    """Adds whether a case that is not closed was opened before the deadline."""
    return rows.withColumn("breached", (opened < deadline) & (status != closed))


def watchlists(members: DataFrame, lists: DataFrame, key: str, asset: str) -> DataFrame:
    """Each list with its name, how many assets it has and a hash of them in order."""
    own = digests(members.select(key, asset).distinct(), [key], [asset], asset, algorithm="md5")
    return own.join(lists, key).withColumnsRenamed({"digest": "assets_hash", "n": "assets"})


def progress(events: DataFrame, topic: str, partition: Column, offset: str, at: Column) -> DataFrame:
    """Per topic and partition the last offset and its time."""
    return events.groupBy(F.col(topic).alias("topic"), partition.alias("partition")).agg(F.max(offset).alias("last_offset"), F.max(at).alias("last_event"))


def expected_counts(seen: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """What was seen of each key beside what was expected, also of keys that only one side has."""
    return expected.join(seen.groupBy(key).agg(F.count(F.lit(1)).alias("seen")), key, "full_outer")
