"""Threat indicators: normal forms, candidates in texts, matches, context."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.functions.exprs import uuid5
from tidewatch.operators import scans
from tidewatch.sources.tables import shared_folder

#: Names of feeds' indicator types and what they are here (fixed values).
TYPES = {
    "domain": "DOMAIN", "hostname": "DOMAIN", "url": "URL", "uri": "URL", "ipv4": "IPV4", "ipv6": "IPV6", "md5": "MD5", "filehash-md5": "MD5", "sha1": "SHA1", "filehash-sha1": "SHA1",
    "sha256": "SHA256", "filehash-sha256": "SHA256", "email": "EMAIL", "email-address": "EMAIL", "bitcoinaddress": "WALLET", "cryptocurrency-address": "WALLET",
}
LABELS = r"^(?=.{1,253}$)([a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?\.)*[a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?$"


@F.pandas_udf(T.StringType())
def _address(values: pd.Series) -> pd.Series:
    """The short form of an IPv6 address; the JVM has no function for it."""

    def one(v: str | None) -> str | None:
        try:
            return ipaddress.IPv6Address(v).compressed
        except ValueError:
            return None

    return values.map(one)


def domain(value: Column) -> Column:
    """In lower case, without dots at the end, in its ASCII form (IDNA, by the JVM's own function); null if that is no domain."""
    v = F.lower(F.regexp_replace(value, r"\.+$", ""))
    v = F.when(v.rlike(r"^[\x00-\x7f]*$"), v).otherwise(F.lower(F.try_reflect(F.lit("java.net.IDN"), F.lit("toASCII"), v)))
    return F.when(v.rlike(LABELS), v)


def url(value: Column) -> Column:
    """Scheme and host in lower case, without user, the ports 80 and 443 and fragment; an empty path is /."""
    part = lambda i: F.regexp_extract(value, r"(?i)^(https?)://(?:[^/?#@\s]*@)?([^/?#:@\s]+)(:\d+)?((?:/[^?#\s]*)?)(\?[^#\s]*)?(#\S*)?$", i)
    scheme, host, port, path = F.lower(part(1)), domain(part(2)), part(3), part(4)
    port = F.when(port.isin(":80", ":443"), "").otherwise(port)
    return F.when(scheme != "", F.concat(scheme, F.lit("://"), host, port, F.when(path == "", "/").otherwise(path), part(5)))


def normalize(rows: DataFrame, kind: str = "type", value: str = "indicator") -> DataFrame:
    """Adds indicator_type, indicator_value, identity_hash and indicator_id; rows of unknown types or broken values go."""
    v = F.trim(F.col(value))
    t = F.element_at(F.create_map(*(F.lit(x) for p in TYPES.items() for x in p)), F.lower(F.trim(F.col(kind))))
    digest = lambda n: F.when(F.lower(v).rlike(f"^[0-9a-f]{{{n}}}$"), F.lower(v))
    octet = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
    email = F.when(v.contains("@"), F.concat(F.lower(F.regexp_extract(v, "^(.+)@([^@]*)$", 1)), F.lit("@"), domain(F.regexp_extract(v, "^(.+)@([^@]*)$", 2))))
    df = rows.withColumn("indicator_type", t).withColumn("__six", _address(F.when(t == "IPV6", v)))
    c = F.col("indicator_type")
    norm = F.when(c == "DOMAIN", domain(v)).when(c == "URL", url(v)).when(c == "IPV4", F.when(v.rlike(rf"^{octet}(\.{octet}){{3}}$"), v)).when(c == "IPV6", F.col("__six")).when(c == "MD5", digest(32)).when(c == "SHA1", digest(40)).when(c == "SHA256", digest(64)).when(c == "EMAIL", email).when(c == "WALLET", F.when(v.rlike("^[A-Za-z0-9]{26,128}$"), v))
    df = df.withColumn("indicator_value", norm).drop("__six").where("indicator_value is not null")
    identity = F.concat_ws(":", "indicator_type", "indicator_value")
    return df.withColumn("identity_hash", F.sha2(identity, 256)).withColumn("indicator_id", uuid5(identity))


HOST = r"(?i)^https?://(?:[^/?#@]*@)?([^/?#:@\s]+)"
#: Runs of the characters that addresses have which may be something: with a colon, with a dot between others, or of 32 hexadecimal digits and more.
CHARACTERS, OTHERS = "[A-Za-z0-9:@._/%?=&+-]", "[A-Za-z0-9:@_/%?=&+-]"
RUN = rf"(?<!{CHARACTERS})(?=\.*[0-9A-Fa-f]{{32}}|{CHARACTERS}*?(?::|{OTHERS}\.+{OTHERS}))({CHARACTERS}+)"


def candidates(posts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """What of a text may be an indicator: (key, indicator_type, indicator_value), distinct. Its addresses and their hosts;
    and of its runs of the characters that addresses have, those that are a domain, an IP address or a hash as a whole. Plain words,
    which are most runs, are passed over as the text is read."""
    t = F.col(text)
    strip = lambda x: F.regexp_replace(x, r"^[.,;()\[\]]+|[.,;()\[\]]+$", "")
    runs = F.transform(F.regexp_extract_all(t, F.lit(RUN), F.lit(1)), strip)
    urls = F.transform(F.regexp_extract_all(F.when(t.contains("://"), t).otherwise(""), F.lit(r"(?i)(https?://[^\s<>()]+)"), F.lit(1)), lambda u: F.regexp_replace(u, r"[.,;:!?]+$", ""))
    v = F.col("v")
    address, hexadecimal = v.rlike("(?i)^https?://"), v.rlike("^[0-9a-fA-F]+$")
    tests = [("url", address, v), ("domain", address, F.regexp_extract(v, HOST, 1)), ("domain", ~address & v.contains("."), v), ("ipv4", v.rlike(r"^[0-9]+(\.[0-9]+){3}$"), v), ("ipv6", v.rlike(":.*:"), v), *((k, hexadecimal & (F.length(v) == n), v) for k, n in (("md5", 32), ("sha1", 40), ("sha256", 64)))]
    maybe = F.array_compact(F.array(*(F.when(test, F.struct(F.lit(k).alias("type"), x.alias("indicator"))) for k, test, x in tests)))
    each = posts.select(key, F.explode(F.array_distinct(F.concat(runs, urls))).alias("v")).select(key, F.explode(maybe).alias("c")).select(key, "c.*")
    return normalize(each).select(key, "indicator_type", "indicator_value").distinct()


def matches(found: DataFrame, indicators: DataFrame) -> DataFrame:
    """Candidates that are indicators: an equality join on type and value."""
    return found.join(indicators.select("indicator_type", "indicator_value", "indicator_id", "fetched_at"), ["indicator_type", "indicator_value"])


def asset_matches(found: DataFrame, indicators: DataFrame, mentions: DataFrame, key: str, confidence: float = 0.7) -> DataFrame:
    """Matches with active indicators for each asset that the post was resolved to. mentions: key, scope_id, asset_id, event_time; indicators
    may have `active`. A match counts from the later of the post and the indicator's fetch (evidence_cutoff), and there is one for a
    scope, asset, post and indicator, however often the post names them. Posts that are resolved to no asset have none."""
    active = indicators.where(F.coalesce("active", F.lit(True))) if "active" in indicators.columns else indicators
    own = mentions.where(F.col("asset_id").isNotNull()).select(key, "scope_id", "asset_id", "event_time").dropDuplicates([key, "scope_id", "asset_id"])
    rows = matches(found, active).join(own, key).dropDuplicates([key, "scope_id", "asset_id", "indicator_id"])
    match_id = uuid5(F.concat_ws(":", F.lit("threat-match"), "scope_id", "asset_id", F.col(key).cast("string"), "indicator_id"))
    return rows.withColumns({"match_id": match_id, "match_type": F.lit("EXACT"), "evidence_cutoff": F.greatest("event_time", "fetched_at"), "confidence": F.lit(confidence)})


def ingest(indicators: DataFrame, observations: DataFrame, batch: DataFrame, fetched_at: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A fetch of a feed taken into what is kept. batch: provider_id, type, indicator, created, modified (null: created) and pulse_modified.

    Returns the indicators after it (by indicator_id: first_seen as first kept, the least of those that are new; last_seen, of the greatest
    (pulse_modified, provider_id) of the newest fetch; fetched_at; active), the observations (each provider_id once, the first one kept; of a
    batch that of the least pulse_modified) and one row with the feed's watermark: the greatest pulse_modified, also of pulses whose
    indicators are broken. Taking a batch again changes nothing but fetched_at."""
    seen = F.coalesce("modified", "created")
    good = normalize(batch).withColumn("seen", seen)
    order = F.struct("pulse_modified", "provider_id")
    fresh = good.groupBy("indicator_id").agg(F.first("indicator_type").alias("indicator_type"), F.first("indicator_value").alias("indicator_value"), F.min("created").alias("first_seen"), F.max_by("seen", order).alias("last_seen")).withColumns({"fetched_at": F.lit(fetched_at).cast("long"), "active": F.lit(True)})
    both = indicators.select(*fresh.columns).withColumn("__at", F.lit(0)).unionByName(fresh.withColumn("__at", F.lit(1)))
    rest = ["last_seen", "fetched_at", "active"]
    kept = both.groupBy("indicator_id", "indicator_type", "indicator_value").agg(F.min_by("first_seen", "__at").alias("first_seen"), F.max_by(F.struct(*rest), "__at").alias("r")).select("indicator_id", "indicator_type", "indicator_value", "first_seen", "r.*")
    new = good.select("provider_id", "indicator_id", F.col("seen").alias("observed_at"), F.lit(fetched_at).cast("long").alias("fetched_at"), "pulse_modified")
    once = new.groupBy("provider_id").agg(F.min_by(F.struct("indicator_id", "observed_at", "fetched_at"), F.struct("pulse_modified", "observed_at", "indicator_id")).alias("r")).select("provider_id", "r.*")
    log = observations.select(*once.columns).unionByName(once.join(observations.select("provider_id"), "provider_id", "left_anti"))
    return kept, log, batch.agg(F.max("pulse_modified").alias("watermark"))


def written(found: DataFrame) -> DataFrame:
    """Candidates in the shared folder, for what reads them more than once: the texts are then read once."""
    shared_folder(found.sparkSession)
    return found.checkpoint()


def new_matches(found: DataFrame, indicators: DataFrame, made: DataFrame, key: str, since: int, most: int = 1000) -> DataFrame:
    """Backfill: matches of posts with the newest `most` indicators fetched since then that are not among those made."""
    recent = scans.first_rows(indicators.where(F.col("fetched_at") >= since), [F.desc("fetched_at"), F.asc("indicator_id")], most)
    rows = matches(found, recent).withColumn("match_id", uuid5(F.concat_ws(":", F.lit("match"), F.col(key).cast("string"), "indicator_id")))
    return rows.join(made.select("match_id"), "match_id", "left_anti")


def context(at: DataFrame, hits: DataFrame, newest: int = 20, feed: DataFrame | None = None, enabled: bool = True, fresh: int = 3600) -> DataFrame:
    """at: asset_id, cutoff; hits: asset_id, match_id, epoch, fetched_at, and confidence (0.7 where there is none). The newest hits
    known at each cutoff: their number n, status, score and greatest confidence. feed: one row with last_success and now, where its
    health counts: without a success it is UNAVAILABLE, after `fresh` seconds STALE; not enabled, DISABLED. Then there is no score.

    Hits, as they become known, and cutoffs are one ordered stream; the newest few so far are a small list, and two lists make one, so an
    asset's stream is cut into pieces for many tasks. Work grows with hits and cutoffs, not with their pairs."""
    confidence = F.col("confidence").cast("double") if "confidence" in hits.columns else F.lit(0.7)
    kind = f"array<struct<age:bigint,match_id:{hits.schema['match_id'].dataType.simpleString()},confidence:double>>"
    one = F.struct((-F.col("epoch")).cast("long").alias("age"), "match_id", confidence.alias("confidence"))
    none = F.expr(f"cast(array() as {kind})")
    stream = hits.where("epoch is not null and fetched_at is not null").select("asset_id", F.greatest("epoch", "fetched_at").cast("double").alias("t"), F.lit(0).alias("rank"), F.array(one).cast(kind).alias("hit"))
    asked = at.select("asset_id", "cutoff").distinct()
    stream = stream.unionAll(asked.select("asset_id", F.col("cutoff").cast("double"), F.lit(1), none))
    keys, order = ["asset_id"], ["t", "rank"]
    merge = lambda a, b: F.slice(F.array_sort(F.concat(a, b)), 1, newest)
    known = scans.folded(scans.in_ranges(stream, keys, order), keys, order, F.col("hit"), merge, none, kind).where("rank = 1")
    known = known.select("asset_id", F.col("t").alias("__t"), F.size("before").alias("n"), F.array_max(F.transform("before", lambda x: x["confidence"])).alias("known"))
    out = at.withColumn("__t", F.col("cutoff").cast("double")).join(known, ["asset_id", "__t"]).drop("__t")
    state = F.lit(None).cast("string") if enabled else F.lit("DISABLED")
    if enabled and feed is not None:
        health = feed.agg(F.max("last_success").alias("last_success"), F.max("now").alias("now"))  # one row, also of none
        out = out.crossJoin(F.broadcast(health))
        state = F.when(F.col("last_success").isNull(), "UNAVAILABLE").when(F.col("last_success") < F.col("now") - fresh, "STALE")
    out = out.withColumn("status", F.coalesce(state, F.when(F.col("n") > 0, "MATCHED").otherwise("NO_MATCH"))).drop("last_success", "now")
    judged = F.col("status").isin("MATCHED", "NO_MATCH")
    return out.withColumns({"threat_score": F.when(judged, F.least(F.lit(1.0), F.col("n") / 3)), "threat_confidence": F.when(judged, F.coalesce("known", F.lit(0.0)))}).drop("known")


def shared(found: DataFrame, key: str, least: int = 2) -> DataFrame:
    """Candidates whose value at least so many texts have, with their number."""
    own = ["indicator_type", "indicator_value"]
    n = found.groupBy(*own).agg(F.count_distinct(key).alias("docs")).where(F.col("docs") >= least)
    return found.join(n, own)
