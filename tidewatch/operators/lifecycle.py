"""From windows and scores to what is kept of them: latest states, model inputs, re-scoring, explanations, accounts of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.exprs import canonical_hash, uuid5
from tidewatch.operators import scans, scoring, serving


def latest_windows(revisions: DataFrame, key: list[str]) -> DataFrame:
    """The newest window of each key, in its last revision."""
    return serving.latest(revisions, key, ["window_start", "revision"])


def revisions_of(revisions: DataFrame, key: list[str]) -> DataFrame:
    """All revisions of each window, with how many there are and whether the row is the last."""
    w = Window.partitionBy(*key, "window_start")
    return revisions.withColumns({"revisions": F.count(F.lit(1)).over(w), "last": F.col("revision") == F.max("revision").over(w)})


def baselines(features: DataFrame, key: list[str], history: int = 20) -> DataFrame:
    """The baseline of each asset after its newest window: volume, volatility, relative volume and how many windows it rests on."""
    last = serving.latest(features.select(*key, "window_start", "volume", "volatility", "relative_volume", "baseline_confidence"), key, ["window_start"])
    return last.withColumn("history_window_count", F.bround(F.coalesce("baseline_confidence", F.lit(0.0)) * history).cast("int"))


def regime_changes(detected: DataFrame, key: list[str]) -> DataFrame:
    """The regime history: a row for each window whose regime is not that of the window before."""
    before = F.lag("market_regime").over(Window.partitionBy(*key).orderBy("window_start"))
    return detected.withColumn("before", before).where(F.col("before").isNull() | (F.col("before") != F.col("market_regime")))


def liquidity(detected: DataFrame, key: list[str]) -> DataFrame:
    """The current liquidity class of each key."""
    return serving.latest(detected.select(*key, "window_start", "liquidity_class", "liquidity_confidence"), key, ["window_start"])


def quality_signals(observed: DataFrame, mentioned: DataFrame | None = None) -> DataFrame:
    """What was observed of a source as DATA_QUALITY rows; of social sources a row for each asset that the datum mentions
    (mentioned: arrival, asset_id)."""
    rows = observed if mentioned is None else observed.drop("asset_id").join(mentioned.distinct(), "arrival")
    return rows.select(
        F.concat_ws(":", F.lit("quality"), F.col("arrival").cast("string"), "asset_id").alias("event_id"), "asset_id", "source", F.lit("DATA_QUALITY").alias("kind"), F.col("gap_count").alias("source_gap_count"),
        F.lit(True).alias("source_active"), F.lit(False).alias("source_idle"), (F.col("status") != "HEALTHY").alias("source_degraded"),
    )


def social_signals(posts: DataFrame, mentions: DataFrame) -> DataFrame:
    """posts: post_id, event_id, event_time and more; mentions: post_id, start, asset_id (null if not resolved). One SOCIAL_POST for
    each asset that a post mentions, and one ASSET_MENTION for each mention, numbered within post and asset."""
    own = mentions.where("asset_id is not null")
    post = posts.join(own.select("post_id", "asset_id").distinct(), "post_id").select("post_id", "asset_id", "event_time", F.concat_ws(":", F.col("event_id").cast("string"), F.lit("post"), "asset_id").alias("event_id"), F.lit("SOCIAL_POST").alias("kind"))
    n = F.row_number().over(Window.partitionBy("post_id", "asset_id").orderBy("start"))
    each = posts.select("post_id", F.col("event_id").alias("__e"), "event_time").join(own.select("post_id", "asset_id", n.alias("n")), "post_id")
    return post.unionByName(each.select("post_id", "asset_id", "event_time", F.concat_ws(":", F.col("__e").cast("string"), F.lit("mention"), "asset_id", F.col("n").cast("string")).alias("event_id"), F.lit("ASSET_MENTION").alias("kind")))


def model_input(snapshots: DataFrame, manifest: list[str], keys: list[str], version: str) -> DataFrame:
    """The features as a vector in the manifest's order, with the schema's version and hash. Names that are missing, or
    there beside the keys and the manifest, are an error."""
    missing, other = [n for n in manifest if n not in snapshots.columns], [c for c in snapshots.columns if c not in manifest and c not in keys]
    if missing or other:
        raise ValueError(f"features differ from the schema: missing {missing}, unknown {other}")
    schema = F.sha2(F.lit(version + ":" + ",".join(manifest)), 256)
    return snapshots.select(*keys, F.array(*(F.col(n).cast("double") for n in manifest)).alias("vector"), F.lit(version).alias("schema_version"), schema.alias("schema_hash"))


def derived_events(rows: DataFrame, prefix: str, state: str, source: str, fields: list[str], caused_by: str) -> DataFrame:
    """An envelope for each row that an operator put out: its type by the row's state, its cause, and the row as payload."""
    kind = F.concat(F.lit(prefix + "."), F.lower(state))
    identity = F.concat_ws(":", kind, *(F.col(f).cast("string") for f in fields))
    return rows.select(
        uuid5(identity).alias("event_id"), kind.alias("event_type"), F.lit(source).alias("source"), "asset_id", F.col("asset_id").alias("partition_key"),
        F.struct(F.col(caused_by).cast("string").alias("causation_id")).alias("trace"), F.to_json(F.struct(*fields)).alias("payload"),
    )


def enriched(windows: DataFrame, graph: DataFrame, verification: DataFrame, threat: DataFrame, key: list[str]) -> DataFrame:
    """Windows that are final or corrected, scored with what is known of them by now: graph features, verification and threat
    context, each a row for a window at most. Run again when one of these arrives: the identity of a score holds
    which it was made of."""
    joined = windows.where(F.col("revision_state").isin("FINAL", "CORRECTED")) if "revision_state" in windows.columns else windows
    for part in (graph, verification, threat):
        joined = joined.join(part, key, "left")
    return scoring.fuse(scoring.detect(joined))


def identified(scores: DataFrame, identity: dict[str, Column]) -> DataFrame:
    """Adds the idempotency key, a hash of what a score was made of, and the score's id; one row for each key."""
    key = scores.withColumn("idempotency_key", canonical_hash(identity))
    return key.withColumn("model_score_id", uuid5(F.concat(F.lit("model-score:"), F.col("idempotency_key")))).dropDuplicates(["idempotency_key"])


def not_yet(rows: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not stored, each once."""
    return rows.dropDuplicates([key]).join(stored.select(key), key, "left_anti")


def explanations(contributions: DataFrame, key: str) -> DataFrame:
    """contributions: key, component, contribution. One explanation for each score: its components by name, and their hash."""
    part = F.concat_ws("=", "component", F.format_string("%.6f", F.col("contribution")))
    rows = contributions.groupBy(key).agg(F.array_join(F.sort_array(F.collect_list(part)), ";").alias("explanation"))
    return rows.withColumn("explanation_hash", F.sha2("explanation", 256))


def connector_runs(documents: DataFrame, run: list[str], before: DataFrame | None = None) -> DataFrame:
    """documents: run, outcome (INGESTED, UNCHANGED, ERROR, RATE_LIMITED), published and completed. The account of each run: counts,
    status, watermark and lag. A run with errors keeps the watermark of the run before (before: run, watermark)."""
    is_a = lambda o: F.count_if(F.col("outcome") == o)
    n = documents.groupBy(*run).agg(
        F.count(F.lit(1)).alias("fetched"), is_a("INGESTED").alias("ingested"), is_a("UNCHANGED").alias("unchanged"), is_a("ERROR").alias("errors"), is_a("RATE_LIMITED").alias("limited"),
        F.max(F.when(F.col("outcome") == "INGESTED", F.col("published"))).alias("newest"), F.max("completed").alias("completed"),
    )
    n = n.join(before, run, "left") if before is not None else n.withColumn("watermark", F.lit(None).cast("long"))
    status = F.when(F.col("limited") > 0, "RATE_LIMITED").when(F.col("errors") == 0, "SUCCESS").when(F.col("ingested") > 0, "PARTIAL").otherwise("FAILED")
    n = n.withColumn("status", status).withColumn("watermark", F.when(F.col("status") == "SUCCESS", F.greatest("watermark", "newest")).otherwise(F.col("watermark")))
    return n.withColumn("lag_seconds", F.greatest(F.lit(0), F.col("completed") - F.col("watermark"))).drop("newest", "limited")


def references(snapshots: DataFrame, key: str, parts: dict[str, Column]) -> DataFrame:
    """What an evidence snapshot refers to: a row for each part that it has, with type, id and a digest."""
    each = F.array_compact(F.array(*(F.when(c.isNotNull(), F.struct(F.lit(k).alias("reference_type"), c.cast("string").alias("reference_id"))) for k, c in parts.items())))
    return snapshots.select(key, F.explode(each).alias("r")).select(key, "r.*").withColumn("digest", F.sha2(F.concat_ws(":", "reference_type", "reference_id"), 256))


def snapshot_with_references(snapshots: DataFrame, refs: DataFrame, alert: str, version: str, key: str) -> DataFrame:
    """The last snapshot of each alert, with how many references it has and the hash of them all in order."""
    last = serving.latest(snapshots, [alert], [version])
    own = serving.digests(refs.join(last.select(key), key), [key], ["reference_id"], "reference_id").withColumnsRenamed({"digest": "references_hash", "n": "references"})
    return last.join(own, key, "left").na.fill(0, ["references"])


def intact(stored: DataFrame, recomputed: DataFrame, key: list[str]) -> DataFrame:
    """Per link of a chain: whether the hash that is stored is the one recomputed; false too where either is missing."""
    both = stored.select(*key, F.col("chain_hash").alias("__s")).join(recomputed.select(*key, F.col("chain_hash").alias("__r")), key, "full")
    return both.select(*key, F.coalesce(F.col("__s") == F.col("__r"), F.lit(False)).alias("intact"))


def campaign_evidence(campaigns: DataFrame, snapshots: DataFrame, dominant: DataFrame, key: list[str]) -> DataFrame:
    """Campaigns with the latest graph snapshot of their scope and asset and their dominant narrative, if there are any."""
    return campaigns.join(serving.latest(snapshots, key, ["window_end"]), key, "left").join(dominant, key, "left")


def listed(rows: DataFrame, tests: dict[str, list], order: list[Column], most: int, within: DataFrame | None = None, key: list[str] = ()) -> DataFrame:
    """The newest rows whose columns have one of the given values, and that lie within another table where one is given."""
    for c, values in tests.items():
        rows = rows.where(F.col(c).isin(values))
    rows = rows if within is None else rows.join(within, list(key), "left_semi")
    return rows.orderBy(*order).limit(most)


def adjudicated(feedback: DataFrame, label: str, status: str) -> DataFrame:
    """Feedback by label and status, with each status's share of its label."""
    n = feedback.groupBy(label, status).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(label)))


def current_alias(history: DataFrame, family: str, order: list[str]) -> DataFrame:
    """The alias in force of each family: the last of its history."""
    return serving.latest(history, [family], order)


def alert_claims(alerts: DataFrame, narratives: DataFrame, claims: DataFrame) -> DataFrame:
    """alerts: alert_id, scope_id, asset_id, last_triggered; narratives: narrative_id, scope_id, asset_id; claims: claim_id, narrative_id,
    extracted. The claims of an alert: of its asset's narratives, extracted by the time that it was last triggered."""
    own = alerts.join(narratives, ["scope_id", "asset_id"]).join(claims, "narrative_id")
    return own.where("extracted <= last_triggered").select("alert_id", "claim_id", "narrative_id", "extracted")


def alert_claim_counts(alerts: DataFrame, narratives: DataFrame, claims: DataFrame) -> DataFrame:
    """Inputs as of alert_claims. Per alert with claims: how many there are, and when the newest was extracted; what alert_claims would give when
    counted, without its pairs. Claims by their time, and alerts, are one ordered stream of their asset with running sums, cut into ranges for
    many tasks: work grows with claims and alerts."""
    keys, order = ["scope_id", "asset_id"], ["t", "rank"]
    known = [F.col(k).isNotNull() for k in keys]
    found = claims.where("extracted is not null").groupBy("narrative_id", "extracted").agg(F.count(F.lit(1)).alias("n"))
    found = found.join(narratives.where(known[0] & known[1]), "narrative_id").groupBy(*keys, F.col("extracted").alias("t")).agg(F.sum("n").alias("n"))
    due = alerts.where(known[0] & known[1] & F.col("last_triggered").isNotNull())
    asked = due.select(*keys, F.col("last_triggered").alias("t")).distinct()
    stream = found.select(*keys, "t", F.lit(0).alias("rank"), "n").unionByName(asked.select(*keys, "t", F.lit(1).alias("rank"), F.lit(0).cast("long").alias("n")))
    upto = scans.prefixed(scans.in_ranges(stream, keys, order), keys, order, {"claims": F.col("n")}, {"newest": F.when(F.col("rank") == 0, F.col("t"))})
    upto = upto.where("rank = 1 and claims > 0").select(*keys, F.col("t").alias("last_triggered"), "claims", "newest")
    return due.join(upto, [*keys, "last_triggered"]).groupBy("alert_id").agg(F.sum("claims").alias("claims"), F.max("newest").alias("newest"))


def document_versions(wanted: DataFrame, documents: DataFrame, key: str, licence: Column, text: str) -> DataFrame:
    """All versions of the wanted documents (rows with key), the text only where the licence allows it."""
    rows = documents.join(wanted.select(key).distinct(), key, "left_semi")
    return rows.withColumn("masked", ~licence).withColumn(text, F.when(licence, F.col(text)))
