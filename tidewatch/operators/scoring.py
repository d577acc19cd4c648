"""Detectors, market regime, liquidity and fusion: column expressions over feature windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.exprs import clamp, number, settled, severity

#: Weight of each component of the fused score (fixed values).
WEIGHTS = {"market_score": 0.40, "social_score": 0.10, "coordination_score": 0.18, "temporal_score": 0.10, "claim_risk": 0.12, "graph_score": 0.10}
WATCH, HIGH, CRITICAL = 0.35, 0.60, 0.80
THREAT_CAP = 0.10


def detect(windows: DataFrame) -> DataFrame:
    """Adds the four detectors' scores (null with a *_missing reason where they can't judge), regime and liquidity."""
    n = number
    has_market = (n("trade_count") > 0) | (n("volume") > 0)
    book = F.coalesce(F.col("orderbook_valid") == 1, F.lit(False))
    direction = 0.30 * clamp(F.abs(n("price_return")) / 0.10)
    activity = 0.35 * (0.70 * clamp((n("relative_volume") - 1) / 4) + 0.30 * clamp(n("trade_count") / 30))
    stress = 0.20 * clamp(n("volatility") / 0.05)
    micro = 0.15 * (0.65 * clamp(F.abs(n("orderbook_imbalance"))) + 0.35 * clamp(n("spread") / 0.02))
    market = F.when(has_market, clamp(F.when(book, direction + activity + stress + micro).otherwise((direction + activity + stress) / 0.85)))
    no_social = F.col("mention_count").isNull() & F.col("unique_author_count").isNull()
    social = F.when(~no_social, clamp(0.40 * clamp(n("mention_count") / 12) + 0.25 * clamp(n("unique_author_count") / 8) + 0.20 * clamp(n("hashtag_velocity") / 10) + 0.15 * clamp(n("new_author_ratio"))))
    coordination = F.when(F.col("mention_count").isNotNull(), clamp(0.40 * n("author_concentration") + 0.35 * n("repost_reply_ratio") + 0.25 * n("url_concentration")))
    lead = F.col("social_lead_seconds")
    ret, vol = F.abs(n("price_return")), n("volatility")
    liquidity = n("volume") + n("top_n_depth")
    return settled(windows.withColumns({
        "market_score": market,
        "market_missing": F.when(market.isNull(), F.when(n("market_source_degraded") > 0, "SOURCE_DEGRADED").otherwise("SOURCE_UNAVAILABLE")),
        "social_score": social,
        "social_missing": F.when(no_social, F.when(n("social_source_idle") > 0, "SOURCE_IDLE").when(n("social_source_degraded") > 0, "SOURCE_DEGRADED").otherwise("SOURCE_UNAVAILABLE")),
        "coordination_score": coordination,
        "coordination_missing": F.when(coordination.isNull(), "SOURCE_UNAVAILABLE"),
        "temporal_score": F.when(lead <= 0, 0.0).otherwise(clamp(lead / 300)),
        "temporal_missing": F.when(lead.isNull(), "SOURCE_UNAVAILABLE"),
        "market_regime": F.when((ret >= 0.20) | (vol >= 0.10), "DISLOCATED").when(vol >= 0.04, "VOLATILE").when(ret >= 0.05, "TRENDING").otherwise("CALM"),
        "market_regime_confidence": F.when((ret >= 0.20) | (vol >= 0.10), clamp(F.greatest(ret / 0.4, vol / 0.2))).when(vol >= 0.04, clamp(vol / 0.10)).when(ret >= 0.05, clamp(ret / 0.20)).otherwise(clamp(1 - F.greatest(ret / 0.05, vol / 0.04))),
        "liquidity_class": F.when((n("volume") <= 0) & (n("top_n_depth") <= 0), "UNKNOWN").when(liquidity < 10_000, "LOW").when(liquidity < 250_000, "MEDIUM").otherwise("HIGH"),
        "liquidity_confidence": F.when((n("volume") <= 0) & (n("top_n_depth") <= 0), 0.0).when(liquidity < 10_000, clamp(1 - liquidity / 10_000)).when(liquidity < 250_000, clamp(liquidity / 250_000)).otherwise(clamp(liquidity / 1_000_000)),
    }))


def cross_asset(windows: DataFrame) -> DataFrame:
    """Adds cross_asset_score: how far a window's return lies from its peers' of the same window, in a quarter of their
    standard deviations; null with under 3 peers. The peers' moments are the window's less the own row: no pairs."""
    peers = Window.partitionBy("scope_id", "interval_seconds", "window_start")
    x = number("price_return")
    n, s, ss = F.count(F.lit(1)).over(peers) - 1, F.sum(x).over(peers) - x, F.sum(x * x).over(peers) - x * x
    mean = s / n
    variance = ss / n - mean * mean
    return windows.withColumn("peers", n).withColumn("cross_asset_score", F.when(n < 3, None).when(variance <= 1e-18, 0.0).otherwise(clamp(F.abs((x - mean) / F.sqrt(variance)) / 4)))


def fuse(scored: DataFrame, calibration: tuple[float, float] | None = None) -> DataFrame:
    """Adds the fused risk. Optional inputs, null columns where scored lacks them: claim_risk, legitimate_event_score,
    graph_score, threat_status, threat_score, threat_confidence."""
    for name, kind in (("claim_risk", "double"), ("legitimate_event_score", "double"), ("graph_score", "double"), ("threat_status", "string"), ("threat_score", "double"), ("threat_confidence", "double")):
        if name not in scored.columns:
            scored = scored.withColumn(name, F.lit(None).cast(kind))
    c = F.col
    weighted = sum((F.coalesce(c(k) * w, F.lit(0.0)) for k, w in WEIGHTS.items()), F.lit(0.0))
    present = sum((F.when(c(k).isNotNull(), w).otherwise(0.0) for k, w in WEIGHTS.items()), F.lit(0.0))
    reasons = [("market_score", F.col("market_missing")), ("social_score", c("social_missing")), ("coordination_score", c("coordination_missing")), ("temporal_score", c("temporal_missing")), *((k, F.lit("NOT_PROVIDED")) for k in ("claim_risk", "legitimate_event_score", "graph_score"))]
    missing = F.array_compact(F.array(*(F.when(c(k).isNull(), F.struct(F.lit(k).alias("name"), r.alias("reason"))) for k, r in reasons)))
    df = scored.withColumns({"available_weight": present, "raw_weighted_score": F.when(present > 0, weighted / present).otherwise(0.0), "missing_outputs": missing})
    base = number("baseline_confidence")
    confidence = clamp((1 - F.size("missing_outputs") / 7.0) * (0.4 + 0.35 * base + 0.25 * number("data_quality_score")))
    raw = clamp(c("raw_weighted_score"))
    calibrated = F.lit(False)
    if calibration:
        calibrated = base >= 0.5
        raw = F.when(calibrated, platt(raw, *calibration)).otherwise(raw)
    df = settled(df.withColumns({"is_calibrated": calibrated, "raw_cross_domain_risk": raw}))
    df = df.withColumn("after_legitimate", c("raw_cross_domain_risk") * (1 - 0.35 * clamp(F.coalesce(c("legitimate_event_score"), F.lit(0.0)))))
    matched = F.coalesce((c("threat_status") == "MATCHED") & c("threat_score").isNotNull(), F.lit(False))
    uplift = F.least(F.lit(THREAT_CAP), c("threat_score") * F.coalesce(c("threat_confidence"), F.lit(0.0)) * THREAT_CAP)
    df = df.withColumn("after_threat", F.when(matched, F.least(F.lit(1.0), c("after_legitimate") + uplift)).otherwise(c("after_legitimate")))
    floor = F.coalesce((c("market_score") >= 0.65) & (c("coordination_score") >= 0.65), F.lit(False))
    df = df.withColumn("after_floor", F.when(floor, F.greatest(c("after_threat"), F.lit(WATCH))).otherwise(c("after_threat")))
    weak = c("market_score").isNull() | (c("market_score") < 0.35)
    df = df.withColumn("after_cap", F.when(weak, F.least(c("after_floor"), F.lit(HIGH - 0.01))).otherwise(c("after_floor")))
    threat_only = F.coalesce(c("threat_status") == "MATCHED", F.lit(False)) & (c("after_legitimate") < HIGH)
    df = df.withColumn("fusion_score", F.when(threat_only, F.least(c("after_cap"), F.lit(HIGH - 0.01))).otherwise(c("after_cap")))
    df = df.withColumn("confidence", F.when(F.coalesce(c("threat_status").isin("UNAVAILABLE", "STALE"), F.lit(False)), confidence * 0.85).otherwise(confidence))
    df = settled(df)
    corroborated = F.coalesce(F.greatest(*(F.coalesce(c(k), F.lit(-1.0)) for k in WEIGHTS if k != "market_score")) >= 0.55, F.lit(False))
    level = severity(c("fusion_score"))
    strong = F.coalesce((c("market_score") >= 0.65) & corroborated & (c("confidence") >= 0.4), F.lit(False))
    level = F.when((level == "CRITICAL") & ~strong, "HIGH").otherwise(level)
    level = F.when(c("market_score").isNull() & level.isin("HIGH", "CRITICAL"), "WATCH").otherwise(level)
    social_weight = F.when(c("social_score").isNotNull(), 0.30).otherwise(0.0) + F.when(c("coordination_score").isNotNull(), 0.70).otherwise(0.0)
    social = F.when(social_weight > 0, (F.coalesce(c("social_score") * 0.30, F.lit(0.0)) + F.coalesce(c("coordination_score") * 0.70, F.lit(0.0))) / social_weight)
    graph, verified = c("graph_score").isNotNull(), c("claim_risk").isNotNull() | c("legitimate_event_score").isNotNull()
    df = settled(df.withColumns({"severity": level, "social_coordination_risk": social}))
    return df.withColumns({
        "market_anomaly_severity": severity(F.coalesce(c("market_score"), F.lit(0.0))),
        "social_coordination_severity": severity(F.coalesce(c("social_coordination_risk"), F.lit(0.0))),
        "enrichment_profile": F.when(graph & verified, "GRAPH_AND_VERIFICATION").when(graph, "GRAPH").when(verified, "VERIFICATION").otherwise("BASE"),
        "fusion_revision": F.when(graph & verified, 3).when(graph | verified, 2).otherwise(1),
        "threat_contribution": c("after_threat") - c("after_legitimate"),
    })


def trace(fused: DataFrame, keys: list[str]) -> DataFrame:
    """The decision trace, a row for each component: its value, weight, effective weight and contribution."""
    part = lambda k, w: F.struct(F.lit(k).alias("component"), F.col(k).alias("value"), F.lit(w).alias("weight"), F.when(F.col(k).isNotNull() & (F.col("available_weight") > 0), w / F.col("available_weight")).otherwise(0.0).alias("effective_weight"))
    rows = fused.select(*keys, F.explode(F.array(*(part(k, w) for k, w in WEIGHTS.items()))).alias("c")).select(*keys, "c.*")
    return rows.withColumn("contribution", F.coalesce(F.col("value") * F.col("effective_weight"), F.lit(0.0)))


def platt(score: Column, slope: float, intercept: float) -> Column:
    """A calibrated probability: the logistic function of the score's log odds."""
    p = F.least(F.lit(1 - 1e-6), F.greatest(F.lit(1e-6), score))
    return 1 / (1 + F.exp(-(slope * F.ln(p / (1 - p)) + intercept)))


def alerts(fused: DataFrame, keys: list[str]) -> DataFrame:
    """The alert rules, a row for each that fires: type and severity."""
    z = lambda k: F.coalesce(F.col(k).cast("double"), F.lit(0.0))
    market, social, ret = z("market_score"), z("social_coordination_risk"), z("price_return")
    at_least_watch = lambda level: F.when(level == "NORMAL", "WATCH").otherwise(level)
    own, mine, theirs = F.col("severity"), F.col("market_anomaly_severity"), F.col("social_coordination_severity")
    rules = [
        ("SOCIAL_HYPE_SURGE", social >= 0.35, theirs), ("COORDINATED_PROMOTION", z("coordination_score") >= 0.55, theirs), ("UNVERIFIED_NARRATIVE", z("claim_risk") >= 0.60, at_least_watch(own)),
        ("MARKET_VOLUME_ANOMALY", (market >= 0.35) & (z("relative_volume") >= 2.5), mine), ("MARKET_PRICE_ANOMALY", F.abs(ret) >= 0.08, mine),
        ("MARKET_MICROSTRUCTURE_ANOMALY", (z("spread") >= 0.02) | (F.abs(z("orderbook_imbalance")) >= 0.70), mine), ("CROSS_DOMAIN_MANIPULATION_RISK", (z("fusion_score") >= 0.35) & (market >= 0.35) & (social >= 0.35), own),
        ("POSSIBLE_DUMP_PHASE", (ret <= -0.05) | (z("buy_sell_pressure") <= -0.35), at_least_watch(mine)),
    ]
    fired = F.array_compact(F.array(*(F.when(test, F.struct(F.lit(k).alias("alert_type"), s.alias("alert_severity"))) for k, test, s in rules)))
    return fused.select(*keys, F.explode(fired).alias("a")).select(*keys, "a.*")
