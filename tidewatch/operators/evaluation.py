"""Evaluation of scores, calibration, governance."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.exprs import severity
from tidewatch.operators.scoring import WEIGHTS, platt
from tidewatch.sources.tables import shared_folder

FOUR = ["market_score", "social_score", "coordination_score", "temporal_score"]
#: The components of each cumulative profile, in order (fixed values).
PROFILES = {"MARKET_ONLY": FOUR[:1], "MARKET_SOCIAL": FOUR[:2], "COORDINATION": FOUR, "GRAPH": [*FOUR, "graph_score"], "VERIFICATION": [*FOUR, "graph_score", "claim_risk", "legitimate_event_score"]}


def profile_score(names: list[str]) -> Column:
    """The weighted mean of the given components, less what a legitimate event explains if that is among them; at most 0.59 without
    market evidence. Rounded half to even."""
    w = sum((F.when(F.col(k).isNotNull(), WEIGHTS[k]).otherwise(0.0) for k in names if k in WEIGHTS), F.lit(0.0))
    s = sum((F.coalesce(F.col(k) * WEIGHTS[k], F.lit(0.0)) for k in names if k in WEIGHTS), F.lit(0.0))
    raw = F.when(w > 0, s / w).otherwise(0.0)
    if "legitimate_event_score" in names:
        raw = raw * (1 - 0.35 * F.coalesce(F.col("legitimate_event_score"), F.lit(0.0)))
    return F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(F.coalesce(F.col("market_score"), F.lit(0.0)) < 0.35, F.least(raw, F.lit(0.59))).otherwise(raw))), 6)


def ablation(scored: DataFrame) -> DataFrame:
    """Each row once for each profile, with its score and severity."""
    rows = scored.withColumn("p", F.explode(F.array(*(F.struct(F.lit(i).alias("step"), F.lit(k).alias("profile"), profile_score(v).alias("score")) for i, (k, v) in enumerate(PROFILES.items())))))
    return rows.select("*", "p.*").drop("p").withColumn("level", severity(F.col("score")))


def metrics(rows: DataFrame, positive_from: float, keys: list[str], time: str = "epoch") -> DataFrame:
    """Alert counts, first times, lead time, precision and false-positive proxies, peak score per group; and, where rows have
    missing_output_count and data_freshness_seconds, the rate of missing outputs (of seven) and the mean freshness."""
    t = F.col(time)
    high, watch = F.col("level").isin("HIGH", "CRITICAL"), F.col("level") != "NORMAL"
    n_high, negatives = F.count_if(high), F.count_if(t < positive_from)
    first = F.min(F.when(watch, t))
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("observations"), n_high.alias("alerts"), F.count_if(watch).alias("watch_or_higher"), first.alias("first_watch"), F.min(F.when(high, t)).alias("first_high"), F.min(F.when(F.col("level") == "CRITICAL", t)).alias("first_critical"),
        (positive_from - first).alias("lead_seconds"), F.when(n_high > 0, F.count_if(high & (t >= positive_from)) / n_high).otherwise(1.0).alias("precision_proxy"),
        F.when(negatives > 0, F.count_if(high & (t < positive_from)) / negatives).otherwise(0.0).alias("false_positive_rate"), F.avg("confidence").alias("mean_confidence"), F.max("score").alias("peak_score"),
        *([F.avg(F.col("missing_output_count") / 7).alias("missing_output_rate")] if "missing_output_count" in rows.columns else []), *([F.avg("data_freshness_seconds").alias("mean_data_freshness_seconds")] if "data_freshness_seconds" in rows.columns else []),
    )


def evaluated(scored: DataFrame, positive_from: float, time: str = "epoch") -> DataFrame:
    """The metrics of each cumulative profile, what it adds to the peak score of the profile before (contribution_delta), and the median
    and 95th percentile of the processing latency, if rows have processing_latency_ms."""
    rows = ablation(scored)
    out = metrics(rows, positive_from, ["step", "profile"], time)
    out = out.withColumn("contribution_delta", F.round(F.col("peak_score") - F.coalesce(F.lag("peak_score").over(Window.orderBy("step")), F.lit(0.0)), 6))  # a row for each profile
    if "processing_latency_ms" not in scored.columns:
        return out
    # An observation's latency is the same for all profiles: kept apart, as the percentiles read it several times.
    shared_folder(scored.sparkSession)
    latency = scored.select(F.lit(True).alias("all"), "processing_latency_ms").checkpoint()
    for name, fraction in (("p50_latency_ms", 0.50), ("p95_latency_ms", 0.95)):
        at = exact_percentile(latency, ["all"], "processing_latency_ms", fraction).agg(F.max("percentile").alias(name))
        out = out.crossJoin(F.broadcast(at))  # one row
    return out


def exact_percentile(rows: DataFrame, keys: list[str], value: str, fraction: float, slices: int = 4096) -> DataFrame:
    """The value at place round((n - 1) * fraction), half to even, per group; nulls don't count.

    Values are counted by slices of their group's range; only the rows of the slice that holds the place are sorted."""
    v = F.col(value)
    own = rows.where(v.isNotNull()).select(*keys, v)
    spans = own.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.min(v).alias("__low"), F.max(v).alias("__high"))
    placed = own.join(spans, keys).withColumn("__slice", F.when(F.col("__high") > F.col("__low"), F.floor((v - F.col("__low")) / (F.col("__high") - F.col("__low")) * slices)).otherwise(0).cast("long"))
    place = F.bround((F.col("__n") - 1) * fraction).cast("long")
    counts = placed.groupBy(*keys, "__slice").agg(F.count(F.lit(1)).alias("__m"), F.first(place).alias("__place"))
    before = F.coalesce(F.sum("__m").over(Window.partitionBy(*keys).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    held = counts.withColumn("__before", before).where((F.col("__before") <= F.col("__place")) & (F.col("__place") < F.col("__before") + F.col("__m")))
    at = F.row_number().over(Window.partitionBy(*keys).orderBy(value)) - 1 + F.col("__before")
    found = placed.join(held.select(*keys, "__slice", "__before", "__place"), [*keys, "__slice"]).withColumn("__at", at)
    return found.where(F.col("__at") == F.col("__place")).select(*keys, v.alias("percentile"))


def calibration_metrics(rows: DataFrame, p: str, label: str, bins: int = 10, keys: tuple[str, ...] = (), slices: int = 1024) -> DataFrame:
    """Brier score, log loss, calibration error over equal bins, area under the curve: a row for each of the keys, or one."""
    keys = list(keys)
    rows = rows if keys else rows.withColumn("__all", F.lit(1))
    own = keys or ["__all"]
    y, x = F.col(label).cast("double"), F.col(p)
    clip = lambda c: F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), c))
    edge = sum((F.when(x >= i / bins, 1).otherwise(0) for i in range(1, bins)), F.lit(0))
    base = rows.groupBy(*own).agg(F.count(F.lit(1)).alias("n"), F.sum(y).alias("positives"), F.avg((x - y) * (x - y)).alias("brier"), (-F.avg(y * F.ln(clip(x)) + (1 - y) * F.ln(clip(1 - x)))).alias("log_loss"))
    per_bin = rows.groupBy(*own, edge.alias("bin")).agg(F.count(F.lit(1)).alias("__m"), F.avg(x).alias("__c"), F.avg(y).alias("__a"))
    ece = per_bin.groupBy(*own).agg((F.sum(F.col("__m") * F.abs(F.col("__c") - F.col("__a"))) / F.sum("__m")).alias("ece"))
    # Distinct scores with the negatives below them: each positive beats those, and half of those beside it. The negatives
    # below are those of lower slices of the range, of which there are few, and those below within the slice.
    scores = rows.groupBy(*own, x.alias("x")).agg(F.sum(y).alias("pos"), F.sum(1 - y).alias("neg")).withColumn("slice", F.floor(F.col("x") * slices))
    before = lambda keys_, order: Window.partitionBy(*keys_).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    lower = scores.groupBy(*own, "slice").agg(F.sum("neg").alias("s")).select(*own, "slice", F.coalesce(F.sum("s").over(before(own, "slice")), F.lit(0.0)).alias("lower"))
    below = F.col("lower") + F.coalesce(F.sum("neg").over(before([*own, "slice"], "x")), F.lit(0.0))
    wins = scores.join(lower, [*own, "slice"]).withColumn("wins", F.col("pos") * (below + F.col("neg") / 2))
    auc = wins.groupBy(*own).agg(F.when((F.sum("pos") > 0) & (F.sum("neg") > 0), F.sum("wins") / (F.sum("pos") * F.sum("neg"))).otherwise(0.5).alias("auc"))
    return base.join(ece, own).join(auc, own).drop("__all")


def fit_platt(rows: DataFrame, score: str, label: str, steps: int = 1500, rate: float = 0.05, most: int = 2_000_000) -> tuple[float, float]:
    """Slope and intercept by full-batch gradient steps from (1, 0), of the scores as they are. Equal scores are counted; the driver
    holds `most` distinct ones at most, and beyond that a step would have to be an aggregation of its own, so it is an error."""
    counts = rows.groupBy(F.col(score).cast("double").alias("s"), F.col(label).cast("double").alias("y")).agg(F.count(F.lit(1)).alias("n"))
    got = counts.limit(most + 1).toPandas().sort_values(["s", "y"])
    if len(got) > most:
        raise ValueError(f"over {most} distinct scores: round them to the precision that counts")
    total = int(got["n"].sum())
    if total < 20 or got["y"].nunique() < 2:
        raise ValueError("at least 20 labels of both outcomes are required")
    s, y, n = (got[k].to_numpy(np.float64) for k in ("s", "y", "n"))
    s = np.clip(s, 1e-6, 1 - 1e-6)
    x = np.log(s / (1 - s))
    a, b = 1.0, 0.0
    for _ in range(steps):
        error = n * (1 / (1 + np.exp(-(a * x + b))) - y)
        a, b = a - rate * float(error @ x) / total, b - rate * float(error.sum()) / total
    return round(a, 10), round(b, 10)


def calibrated(rows: DataFrame, score: str, slope: float, intercept: float) -> DataFrame:
    return rows.withColumn("calibrated", platt(F.col(score), slope, intercept))


def promotion_inputs(candidates: DataFrame, calibrations: DataFrame, aliases: DataFrame, drifts: DataFrame, reports: DataFrame, now: int, days: int = 30) -> DataFrame:
    """What promotion asks of each candidate (artifact_id, family, version): its latest active calibration (without one it is left out), the
    champion of its family with the Brier score of that one's latest active calibration, the latest drift status of its version, and the
    false positives reported in the last days. A candidate that is its family's champion is compared with none.

    calibrations: artifact_id, status, created, samples, ece, auc, brier; aliases: family, alias, artifact_id; drifts and reports: family,
    version, and observed and drift_status, or created."""
    last = calibrations.where("status = 'ACTIVE'").groupBy("artifact_id").agg(F.max_by(F.struct("samples", "ece", "auc", "brier"), "created").alias("c"))
    champions = aliases.where("alias = 'CHAMPION'").select("family", F.col("artifact_id").alias("champion_id"))
    briers = last.select(F.col("artifact_id").alias("champion_id"), F.col("c.brier").alias("champion_brier"))
    moved = drifts.groupBy("family", "version").agg(F.max_by("drift_status", "observed").alias("drift_status"))
    wrong = reports.where(F.col("created") >= now - days * 86_400).groupBy("family", "version").agg(F.count(F.lit(1)).alias("false_positives"))
    rows = candidates.join(last, "artifact_id").select(*candidates.columns, "c.*").join(champions, "family", "left")
    other = F.col("champion_id").isNotNull() & (F.col("champion_id") != F.col("artifact_id"))
    rows = rows.withColumn("champion_required", other).join(briers, "champion_id", "left").withColumn("champion_brier", F.when(F.col("champion_required"), F.col("champion_brier")))
    return rows.join(moved, ["family", "version"], "left").join(wrong, ["family", "version"], "left").na.fill(0, ["false_positives"])


def promotion(candidates: DataFrame, minimum_samples: int, maximum_ece: float, minimum_auc: float, false_positive_budget: int, tolerance: float = 0.0, champion_required: bool | Column = False, apply: Column | None = None) -> DataFrame:
    """candidates: samples, ece, auc, brier, champion_brier (null: none), drift_status and false_positives. Adds the gates and the
    status: if all are met PROMOTED, or APPROVED where the decision is not to be applied; else REJECTED. The champion counts where one is
    required."""
    champion = F.col("champion_brier")
    free = ~champion_required if isinstance(champion_required, Column) else F.lit(not champion_required)
    gates = {
        "enough_samples": F.col("samples") >= minimum_samples, "calibrated": F.col("ece") <= maximum_ece, "discriminates": F.col("auc") >= minimum_auc,
        "drift_stable": F.coalesce(F.col("drift_status") != "DRIFTED", F.lit(True)), "within_false_positives": F.col("false_positives") <= false_positive_budget,
        "champion_available": free | champion.isNotNull(), "not_worse": free | F.coalesce(F.col("brier") <= champion + tolerance, F.lit(False)),
    }
    every = F.lit(True)
    for g in gates:
        every = every & F.col(g)
    return candidates.withColumns(gates).withColumn("status", F.when(~every, "REJECTED").when(F.lit(True) if apply is None else F.coalesce(apply, F.lit(False)), "PROMOTED").otherwise("APPROVED"))


def drift(values: DataFrame, key: str, value: str, reference: str, limit: float = 0.2, bins: int = 10) -> DataFrame:
    """Population stability index of a value in 0..1 between reference rows and the others, by equal bins; DRIFTED from the limit."""
    bin_ = F.least(F.lit(bins - 1), F.floor(F.col(value) * bins))
    n = values.groupBy(key, bin_.alias("bin")).agg(F.count_if(F.col(reference)).alias("a"), F.count_if(~F.col(reference)).alias("b"))
    total = lambda c: F.sum(c).over(Window.partitionBy(key))
    part = lambda c: F.greatest(F.try_divide(F.col(c), total(c)), F.lit(1e-6))
    rows = n.withColumns({"p": part("a"), "q": part("b")})
    out = rows.groupBy(key).agg(F.sum((F.col("q") - F.col("p")) * F.ln(F.col("q") / F.col("p"))).alias("psi"))
    return out.withColumn("drift_status", F.when(F.col("psi") >= limit, "DRIFTED").otherwise("STABLE"))


def labels_of(labels: DataFrame, family: str, version: int, partition: str, segment: dict[str, str] | None = None) -> DataFrame:
    """The calibration labels of a model's family and version in a partition, of one segment where it is named (a map, equal
    whatever the order of its keys), by time and id."""
    rows = labels.where((F.col("family") == family) & (F.col("version") == version) & (F.col("data_partition") == partition))
    if segment is not None:
        want = F.array(*(F.struct(F.lit(k).alias("key"), F.lit(v).alias("value")) for k, v in sorted(segment.items()))) if segment else F.expr("cast(array() as array<struct<key:string,value:string>>)")
        rows = rows.where(F.sort_array(F.map_entries("segment")) == want)
    return rows.orderBy("epoch", "label_id")


def observations(scores: DataFrame, windows: DataFrame) -> DataFrame:
    """Scores with the window revision they were made of (same scope, asset, window and revision): event time, latency in
    ms, freshness and severity of each."""
    key = ["scope_id", "asset_id", "window_start", "revision"]
    joined = scores.join(windows.select(*key, "window_end", "freshness"), key)
    return joined.withColumn("latency_ms", (F.col("scored_at") - F.col("window_end")) * 1000.0)


def shadow(scored: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Adds the severity that another model's weights give (shadow)."""
    present = sum((F.when(F.col(k).isNotNull(), x).otherwise(0.0) for k, x in weights.items()), F.lit(0.0))
    total = sum((F.coalesce(F.col(k) * x, F.lit(0.0)) for k, x in weights.items()), F.lit(0.0))
    return scored.withColumn("shadow", severity(F.when(present > 0, total / present).otherwise(0.0)))


def agreement(scored: DataFrame) -> DataFrame:
    """Per pair of severities, the champion's and the shadow's: how many rows, and how many of them agree."""
    return scored.groupBy("severity", "shadow").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("severity") == F.col("shadow")).alias("agreeing"))


def false_positives(feedback: DataFrame, at: Column, since: float, until: float, keys: list[str]) -> DataFrame:
    """Feedback within a time, counted by keys."""
    return feedback.where((at >= since) & (at < until)).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def last_drift(measured: DataFrame, key: str, order: list[str], value: str, limit: float) -> DataFrame:
    """The drift status of each model by its last measurement."""
    last = measured.groupBy(key).agg(F.max_by(value, F.struct(*order)).alias(value))
    return last.select(key, F.when(F.col(value) >= limit, "DRIFTED").otherwise("STABLE").alias("drift"))
